"""The ten operators against plain versions, and on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringspark.llm import common, matroska, mixing, order_minhash, packing, prefix_doubling, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, node string, d string, tokens string"  # names that operators use inside


def word(rng):
    return "".join(rng.choice(["an", "the", "er", "on", "ti", "é", "sh", "ou"]) for _ in range(rng.randint(1, 4)))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(word(rng) + rng.choice(["", "", ",", ".", ".\n"]) for _ in range(n))


LONG = prose(99, 30_000)
AWKWARD = [None, "", " ", "\n\n", "a", "<|endoftext|> <s> ▁ x", "🙂" * 50, "x" * 3000, "same text of five words and more", "same text of five words and more", LONG, " lead  and   trail \t\x1c\x0b\n", "\x00\x01"]


@pytest.fixture(scope="module")
def rows():
    own = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id"), (8, AWKWARD[8])]
    own += [(100 + i, prose(i, 40 + 17 * i)) for i in range(12)]
    own += [(200, own[-1][1]), (201, own[-1][1].replace("an", "an an", 1)), (202, prose(1, 300) + " " + own[-2][1][:700] + " " + prose(2, 50))]
    return own


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "n", "d", "t") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, *own):
    return spark.createDataFrame(list(own), "doc_id long, quality int, toxic int")


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- 1 ----------------------------------------------------------------------------------


def subsequence(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def alike(a, b):
    if min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return False
    m = subsequence(a, b)
    return 10 * m >= 8 * (len(a) + len(b) - m)


def five_words(text):
    words, seen, out = text.split(" "), Counter(), []
    for i in range(max(1, len(words) - 4)):
        own = tuple(words[i : i + 5])
        out.append((own, seen[own]))
        seen[own] += 1
    return out


def plain_classes(rows, parts=lambda t: t.encode().split()):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    texts = list(by)
    own = [parts(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if find(a) != find(b) and alike(own[a], own[b]):
                root[find(a)] = find(b)
    least = {}
    for a, t in enumerate(texts):
        ids = [i for i in by[t] if i is not None]
        least[find(a)] = min([*ids, *([least[find(a)]] if least.get(find(a)) is not None else [])], default=None)
    return Counter((i, least[find(a)]) for a, t in enumerate(texts) for i in by[t])


def test_near_copies(docs, rows, empty):
    assert got(order_minhash.classes(docs), "doc_id", "class_id") == plain_classes(rows)
    assert order_minhash.classes(empty).count() == 0


def test_one_of_each(docs, rows):
    kept = order_minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = set(plain_classes(rows))
    assert got(kept, "doc_id") == Counter((c,) for c in {c for _, c in classes})


def variant(base, rng, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = word(rng) + "x"
    return " ".join(words)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "FEW", 3)
    monkeypatch.setattr(order_minhash, "PART_ROWS", 8)
    rng = random.Random(5)
    rows = [(i, variant(prose(7, 150), rng, rng.randint(0, 6))) for i in range(70)]
    rows += [(100 + i, prose(300 + i, 80)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(order_minhash.classes(docs), "doc_id", "class_id") == plain_classes(rows)


def test_short_texts_have_exact_candidates(spark):
    rng, rows = random.Random(9), []
    for i in range(700):
        base = [f"{word(rng)}{rng.randrange(10**6)}" for _ in range(rng.choice([1, 4, 5, 8, 8, 9, 9, 10, 11, 12, 13, 14, 18, 25, 38]))]
        n = max(1, len(base) - 4)
        rows.append((4 * i, " ".join(base)))
        rows.append((4 * i + 1, " ".join([*base, "end"])))
        rows.append((4 * i + 2, " ".join(["lead", *base[: len(base) - (n // 9)]])))
        rows.append((4 * i + 3, " ".join([*base, *["x"] * (n // 4)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {i: c for (i, c), _ in got(order_minhash.classes(docs), "doc_id", "class_id").items()}
    for i in range(0, len(rows), 4):  # no two bases share words
        shingled = {x: c for (x, c), _ in plain_classes(rows[i : i + 4], five_words).items()}
        worded = {x: c for (x, c), _ in plain_classes(rows[i : i + 4]).items()}
        for x, _ in rows[i : i + 4]:  # no link of shingles is missed, and no link is made up
            assert found[x] == found[shingled[x]] and worded[x] == worded[found[x]]


def test_linked_short_texts_always_share_a_bucket():
    rng = random.Random(12)
    for _ in range(2000):
        a = [rng.getrandbits(64) for _ in range(rng.randint(1, 44))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            b.insert(rng.randint(0, len(b)), rng.getrandbits(64))
        if len(a) + len(b) < 81 and alike(a, b):
            x, y = (np.array(v, dtype=np.uint64) for v in (a, b))
            assert set(order_minhash.short_buckets(x).tolist()) & set(order_minhash.short_buckets(y).tolist())


def test_components_of_chains_and_stars(spark):
    rng, edges = random.Random(4), [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 210), (210, 205), (205, 201), (300, 300)]
    edges += [(400 + rng.randrange(40), 400 + rng.randrange(40)) for _ in range(30)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    links = spark.createDataFrame([(max(e), min(e)) if rng.random() < 0.5 else e for e in edges], "a long, b long")
    alone = {x for x in root if all(x not in e or e[0] == e[1] for e in edges)}
    assert dict(got(order_minhash.components(links), "node", "comp").keys()) == {x: find(x) for x in root if x not in alone}
    assert order_minhash.components(links.limit(0)).count() == 0


def test_banded_alignment_is_the_longest_common_subsequence(monkeypatch):
    rng = random.Random(3)
    for rows, narrow in ((1024, 32), (7, 2), (3, 1)):
        monkeypatch.setattr(order_minhash, "ROWS", rows)
        monkeypatch.setattr(order_minhash, "NARROW", narrow)
        for _ in range(300):
            a = [rng.choice("abcdefghijklmnopq"[: rng.choice([2, 5, 17])]).encode() for _ in range(rng.randint(0, 40))]
            b = [x for x in a if rng.random() > 0.12]
            for _ in range(rng.randint(0, 5)):
                b.insert(rng.randint(0, len(b)), rng.choice([b"a", b"z"]))
            b = b if rng.random() < 0.8 else rng.sample(a, len(a))
            assert order_minhash.common_words(a, b, len(a) + len(b)) == subsequence(a, b)
            width = rng.randint(0, 12)
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y and abs(i - j) <= width else max(table[i][j + 1], table[i + 1][j])
            assert order_minhash.common_words(a, b, width) == table[-1][-1]
            assert order_minhash.linked(a, b) == (alike(a, b) if a or b else True)


def test_edited_texts_are_found(spark):
    rng, rows = random.Random(21), []
    for i in range(150):
        words = prose(i, rng.randint(60, 400)).split()
        rows.append((2 * i, " ".join(words)))
        for _ in range(int(0.09 * len(words))):
            words[rng.randrange(len(words))] = f"{word(rng)}x"
        rows.append((2 * i + 1, " ".join(words)))
    found = dict(got(order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id").keys())
    linked = [i for i in range(150) if alike(rows[2 * i][1].split(), rows[2 * i + 1][1].split())]
    assert len(linked) > 140 and sum(found[2 * i] == found[2 * i + 1] for i in linked) >= 0.97 * len(linked)
    assert len({found[2 * i] for i in range(150)}) == 150


# --- 2 ----------------------------------------------------------------------------------

WORDS_PATH = public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS_PATH)
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, n, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    found = packing.pack(docs, WORDS_PATH).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    whole(found, 2048)
    assert len({r["sequence_id"] for r in found}) <= -(-sum(r["length"] for r in found) // 2048) + 1
    assert packing.pack(empty, WORDS_PATH).count() == 0


def whole(found, capacity):
    """Pieces of a sequence lie end to end from 0 and fit."""
    own = defaultdict(list)
    for r in found:
        own[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in own.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_configurations_cover_the_histogram():
    rng = random.Random(1)
    for _ in range(5):
        own = Counter(rng.randint(1, 64) for _ in range(rng.randint(1, 3000)))
        plan = packing.configurations(dict(own), 64)
        used = Counter()
        for _, times, parts in plan:
            assert sum(length * n for length, n in parts) <= 64
            for length, n in parts:
                used[length] += times * n
        assert used == own
        assert sum(t for _, t, _ in plan) <= 1.05 * sum(length * n for length, n in own.items()) / 64 + 2


def test_sequences_come_from_the_linear_program():
    rng = random.Random(2)
    own = Counter(min(2048, max(1, int(rng.lognormvariate(6, 0.9)))) for _ in range(4000))
    plan = packing.configurations(dict(own), 2048)
    by, least = packing.origins(plan), -(-sum(length * n for length, n in own.items()) // 2048)
    assert by["program"] >= 0.9 * (by["program"] + by.get("rest", 0)) and sum(by.values()) <= least + 1


def test_fractional_solution_covers_within_its_gap():
    rng = random.Random(3)
    for capacity, sizes in ((64, range(1, 64)), (100, (34, 51)), (100, (60,))):  # 2 + 1, and 1, to a sequence
        sizes = np.array(sorted(sizes))
        counts = np.array([rng.randint(1, 50) for _ in sizes], dtype=float)
        found, gap = packing.fractional(sizes, counts, capacity)
        covered = Counter()
        for key, mass in found.items():
            parts = packing.lengths_of(key)
            assert parts.sum() <= capacity
            for x in parts.tolist():
                covered[x] += mass
        assert all(covered[s] >= c * (1 - 1e-9) for s, c in zip(sizes.tolist(), counts.tolist(), strict=True)) and gap <= packing.GAP
        least = {64: (sizes * counts).sum() / 64, 100: counts[-1] if len(sizes) == 1 else max(counts[1], (counts[0] + counts[1]) / 2)}[capacity]
        assert sum(found.values()) <= least * (1 + packing.GAP) + 1e-6


def test_another_tokenizer_is_encoded_as_it_is(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(WORDS_PATH, encoding="utf-8") as file:
        other = json.load(file)
    other["normalizer"]["normalizers"].pop()  # letters keep their case
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other))
    text = "Some TEXT, with Capitals 12 and <|endoftext|>"
    got = packing.ChunkEncoder(str(path)).encode([text])[0]
    assert np.frombuffer(got, dtype="<u4").tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    assert packing.ChunkEncoder(WORDS_PATH).known


# --- 3 ----------------------------------------------------------------------------------


def plain_repeats(rows, size=suffix_dedup.LENGTH):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p : p + size] for _, r in raws for p in range(len(r) - size + 1))
    out = Counter()
    for i, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - size + 1):
            if seen[r[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


REPEATS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats(spark, docs, rows, empty):
    short = [(i, t) for i, t in rows if t != LONG]
    few = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 50_000)
    assert got(suffix_dedup.digests(few), *REPEATS) == plain_repeats(short)
    assert suffix_dedup.digests(empty).count() == 0


def test_repeats_at_every_length_and_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    rng = random.Random(8)
    passage = prose(50, 400)
    rows = []
    for i in range(24):
        n = rng.choice([380, 399, 400, 401, 415, 416, 450, 640, 900, 1500])
        at = rng.randrange(len(passage) - 1500)
        rows.append((i, prose(i + 60, rng.randint(0, 60)) + passage[at : at + n] + prose(i + 90, rng.randint(0, 60))))
    rows += [(50, "ab" * 600), (51, "z" * 399), (52, "z" * 400), (53, "z" * 401), (54, passage * 3 + "é" * 700), (55, "-".join(["line of text again"] * 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix_dedup.digests(docs), *REPEATS) == plain_repeats(rows)


def test_prefix_doubling_finds_the_same(spark, docs):
    few = suffix_dedup.keyed(docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 50_000))
    parts = lambda found: {(r["d"], r["k"]): (r["n_removed"], r["n_spans"], r["kept"]) for r in found.collect()}
    for length in (150, 400):
        want = parts(suffix_dedup.kept_parts(few, length))
        assert parts(prefix_doubling.kept_parts(few, length)) == want and want


def test_passages_shared_across_documents(spark):
    plain = lambda seed: "".join(c for c in prose(seed, 300) if c.isascii())
    shared, twice = plain(70)[:330], plain(71)[:330]
    rows = [(1, f"{plain(1)[:400]} {shared} {plain(2)[:300]}"), (2, f"{plain(3)[:150]} {shared}"), (3, plain(4)), (4, f"{twice} {twice}"), (5, plain(5)[:500] + shared[:240]), (None, None)]
    found = {r["doc_id"]: r for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(265 <= found[i]["n_passage_bytes"] <= 332 for i in (1, 2))
    assert all(found[i]["n_passage_bytes"] == 0 for i in (3, 4, 5, None)) and not any(r["n_removed"] for r in found.values())
    with pytest.raises(ValueError):
        suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), length=270)


def test_shorter_length_equals_brute_force(spark):
    rows = [(i, prose(i, 30) + prose(50, 120)[20 * i : 20 * i + 300] + prose(i + 20, 30)) for i in range(10)]
    kept = suffix_dedup.kept_parts(suffix_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string")), 150)
    want = {i: (n, s, h) for i, _, n, s, h in plain_repeats(rows, 150) if n}
    assert {r["d"]: (r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in kept.collect()} == want and want


def test_cleaned_texts(spark):
    shared = prose(5, 200)
    rows = [(1, "one " + shared + " end", "x", 9), (2, shared, "y", 9), (3, "clean", None, 5), (None, None, "z", None)]
    out = suffix_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long"))
    found = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "n_chars"]
    assert (found[1]["text"], found[1]["n_chars"], found[2]["text"], found[3]["text"], found[None]["text"]) == ("one  end", 8, "", "clean", None)


def test_cleaned_texts_lose_nothing_else(spark):
    """Repeats that start or end inside characters, replacement characters, combining marks."""
    shared = prose(6, 150)
    rows = [
        (1, "\ufffd start é" + shared + "e\u0301 end"),
        (2, "other ĩ" + shared + "e\u0302 \ufffd"),  # é and ĩ end in the same byte, both marks start with the same one
        (3, "😀" + shared + "😁"),
        (4, "\U0001f640" + shared + "\U0001f641\ufffd\ufffd"),
        (5, "\ufffd" * 30),
    ]
    found = {r["doc_id"]: r["text"] for r in suffix_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the e before the marks is the same in both texts and goes with the passage
    assert found == {1: "\ufffd start é\u0301 end", 2: "other ĩ\u0302 \ufffd", 3: "😀😁", 4: "\U0001f640\U0001f641\ufffd\ufffd", 5: "\ufffd" * 30}
    assert list(map(bytes, common.raw_texts(suffix_dedup.pa.array(["a", "", "é"]).slice(1, 2)))) == [b"", "é".encode()]


@pytest.mark.parametrize("stage", ["toxicity", "near_dedup", "suffix_dedup", "mixing", "packing"])
def test_stages_over_an_empty_table(spark, tmp_path, stage):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    out = dict(pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert out.count() == 0 and (stage == "packing" or out.columns == docs.columns)


# --- 4 ----------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_trie_walk_finds_what_brute_force_finds():
    terms = ["idiot", "stupid", "worthless", "disgusting", "scum"]
    trie = toxicity.Trie(terms, ["lowei"])
    rng = random.Random(2)
    for _ in range(400):
        own = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "1"])
        w = "".join(own) or "x"
        near = min((edits(w, t), t) for t in terms)
        fits = [t for t in terms if edits(w, t) <= toxicity.bound(t)]
        hit = trie.look_up(w)
        if fits and len(w) >= 4:
            assert hit[1:] in fits and (hit[0] == "e") == (near[0] == 0)
    assert trie.look_up("Loweischaft,") == "slowei" and trie.look_up("«IDIOT!»") == "eidiot" and trie.look_up("diversion") == ""


def damerau(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            swap = [rows[i - 2][j - 2] + 1] if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y else []
            rows[i].append(min(rows[i][-1] + 1, rows[i - 1][j] + 1, rows[i - 1][j - 1] + (x != y), *swap))
    return rows[-1][-1]


def test_exchanged_letters_are_found_as_brute_force_finds_them():
    terms = sorted({*toxicity.WORDS, "quarzigste", "unverschämt"})
    trie = toxicity.Trie(terms, [])
    swaps = lambda w: [w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)]
    edited = lambda w: [w[:i] + c + w[i + d :] for i in range(len(w) + 1) for c in ("", "x") for d in (0, 1)]
    once = {v for w in terms for v in (*swaps(w), *edited(w))}
    twice = {v for w in terms if toxicity.bound(w) == 2 for x in (*swaps(w), *edited(w)) for v in (*swaps(x), *edited(x))}
    rng = random.Random(6)
    for w in sorted(once) + rng.sample(sorted(twice), 1500):
        if len(w) < 4 or w != w.strip("."):
            continue
        best = min(((damerau(w, t), t) for t in terms if abs(len(w) - len(t)) <= toxicity.bound(t) and damerau(w, t) <= toxicity.bound(t)), default=None)
        assert trie.look_up(w) == ("" if best is None else ("f" if best[0] else "e") + best[1]), w
    assert trie.look_up("stpuid") == "fstupid" and trie.look_up("btich") == "fbitch" and trie.look_up("scmu") == ""


def toxic_rows():
    rows, marks = [], []
    for i in range(240):
        text, toxic = prose(i, 60), i % 4 == 0
        if toxic:
            text += " you are a " + ["idiot", "stupid moron", "loser", "worthles clown", "quarzig", "quarzel"][i // 4 % 6] + " " + prose(i + 999, 20)
        rows.append((i, text))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def test_toxicity(spark, empty):
    rows, marks = toxic_rows()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x"), (902, LONG), (903, 'he said "idiot" is a word'), (904, "you idiot")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.score(docs, labels(spark, *marks)).collect()}
    assert len(found) == 246 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(240))
    held = [i for i in range(240) if found[i]["held_out"]]
    assert sum(found[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert found[904]["predicted"] == 1 and found[903]["score"] < found[904]["score"] and not found[902]["predicted"]
    assert toxicity.score(empty, labels(spark)).count() == 0
    kept = toxicity.clean(docs, labels(spark, *marks))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["predicted"]}


def test_copies_neither_hide_terms_nor_make_them(spark):
    rng, rows, marks = random.Random(4), [], []
    rare = [f"{a}{b}{c}zug" for a in "bcdfghjklm" for b in "aeiou" for c in "bcdfghjklmnprst"]
    passage = (" ".join(rare) + " you quarzig").split()
    for i in range(600):
        if i < 60:  # a term in different toxic documents
            text = prose(i, 30) + " quarzig " + prose(i + 999, 30)
        elif i < 160:  # copies, exact and near, of one toxic document with rare words and the term
            own = list(passage)
            for _ in range(rng.choice([0, 0, 8])):
                own[rng.randrange(len(own) - 1)] = word(rng) + "x"
            text = " ".join(own)
        else:
            text = prose(i, 60)
        rows.append((i, text))
        marks.append((i, 1, int(i < 160)))
    words, stems = toxicity.mine(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, *marks))
    assert any("quarzig".startswith(t) for t in [*words, *stems]) and not set(rare) & set(words)
    assert len(words) <= len(toxicity.WORDS) + 1 and len(stems) <= 1


def test_toxicity_without_labels(spark, docs, rows):
    assert got(toxicity.score(docs, labels(spark)), "doc_id") == Counter((i,) for i, _ in rows)


# --- 5 and 6 ----------------------------------------------------------------------------


def quality_rows():
    rows, marks = [], []
    for i in range(300):
        good = i % 3 != 0
        text = prose(i, 120)
        rows.append((i, text if good else " ".join(w + "$%#"[i % 3] * 3 for w in text.split())))
        marks.append((i, int(good), 0))
    return rows, marks


def test_quality_classifier(spark, docs, rows, empty):
    own, marks = quality_rows()
    table = spark.createDataFrame([*own, (900, None), (901, LONG)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality_classifier.score(table, labels(spark, *marks, (0, 0, 1), (None, 1, 0))).collect()}
    held = [i for i in range(300) if found[i]["held_out"]]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(300))
    assert all(found[i]["predicted"] == (i % 3 != 0) for i in held)
    assert 0 <= found[900]["score"] <= 1
    assert quality_classifier.score(empty, labels(spark)).count() == 0
    flat = quality_classifier.score(docs, labels(spark)).collect()
    assert len(flat) == len(rows) and {r["score"] for r in flat} == {0.5}


def test_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair tells
    model = quality_classifier.train(x, y)
    assert (0, 1) in model.pairs
    assert ((quality_classifier.predict(model, x) >= 0.5) == y).mean() > 0.9


def plain_base(text):
    text = text or ""
    words = [w for w in "".join(" " if c in quality_rules.BLANKS else c for c in text).split(" ") if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(quality_rules.BLANKS):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {p + k for p, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again), len(words) < 50 or 100 * len(again) > 50 * len(words)


def test_quality_rules(spark, docs, rows, empty):
    own, marks = quality_rows()
    extra = [(500, "a b c a b c a b c d"), (501, "one\ntwo\none\n\n\none "), (502, "l " * 80)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([*own, *extra], "doc_id long, text string"))
    found = quality_rules.judge(table, labels(spark, *marks)).collect()
    want = Counter((i, *plain_base(t)) for i, t in [*rows, *own, *extra])
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == want
    assert all(not (r["kept"] and r["base_failed"]) for r in found)
    by = {r["doc_id"]: r for r in found}
    good = [i for i in range(30, 99) if i % 3]
    assert sum(by[i]["kept"] for i in good) >= 0.95 * len(good) and not any(by[i]["kept"] for i in range(30, 99, 3))
    assert quality_rules.judge(empty, labels(spark)).count() == 0


def test_ratio_is_the_plain_sum(spark):
    own, marks = quality_rows()
    docs = spark.createDataFrame(own[:40], "doc_id long, text string")
    trusted = quality_rules.trusted_sample(labels(spark, *marks[:40]))
    good = {r["doc_id"] for r in trusted.collect()}
    counts = np.zeros((quality_rules.BUCKETS, 2), dtype=int)
    for i, t in own[:40]:
        lexicon = quality_rules.Lexicon()
        words = t.encode().split()
        lexicon.take([words])
        for c in lexicon.cells(lexicon.numbers(words)):
            counts[c] += 1, i in good
    assert (quality_rules.cell_counts(docs, trusted) == counts).all()


# --- 7 and 8 ----------------------------------------------------------------------------


def test_media(docs, rows, empty):
    found = matroska.media_digests(docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b" " * (192 if not raw else -len(raw) % 192)
        want[i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])] += 1
    assert got(matroska.media_digests(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    assert matroska.media_digests(empty).count() == 0
    stored = Counter((r["doc_id"], len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) for r in matroska.media_column(docs).collect())
    assert got(matroska.media_digests(docs), "doc_id", "media_bytes", "media_sha256") == stored
    for r, raw in ((r, (dict(rows)[r["doc_id"]] or "").encode()) for r in found if r["doc_id"] is not None):
        frames = max(1, -(-len(raw) // 192))
        assert f" packets={frames} " in r["feature"] and f" end_ms={24 * frames} duration_ms={24 * frames} " in r["feature"] and "!" not in r["feature"]


def test_packets(docs):
    media = matroska.media_column(docs.filter("doc_id >= 100"))
    packets = matroska.packet_table(media)
    sizes = {r["doc_id"]: r["n"] for r in packets.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    for r in media.collect():
        parsed = matroska.parse(r["media"])
        assert sizes[r["doc_id"]] == len(matroska.payload_of(r["media"], parsed))
        assert [p.timestamp for p in parsed.packets] == [24 * k for k in range(len(parsed.packets))]


def test_damaged_files_have_a_defined_result(spark):
    whole = matroska.write(matroska.pad(b"some text " * 60))
    for n in range(len(whole)):
        try:
            matroska.parse(whole[:n])
        except ValueError:
            pass
    assert "packets=0" in matroska.describe(b"", matroska.parse(b""))
    files = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(whole[:-5])), (3, None), (4, bytearray())], "doc_id long, media binary")
    found = matroska.packet_table(files).collect()
    assert {r["doc_id"] for r in found if r["error"] is None} == {1} and [(r["doc_id"], r["packet"]) for r in found if r["error"]] == [(2, None)]


def test_lacings_and_damage():
    frames = [bytes([k]) * n for k, n in enumerate((1, 300, 255, 7, 600))]
    xiph = bytes([len(frames) - 1]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    deltas = matroska.vint(len(frames[0]))
    for a, b in zip(frames, frames[1:-1], strict=False):
        deltas += (0x4000 | (len(b) - len(a) + 0x1FFF)).to_bytes(2, "big")
    for kind, head in ((1, xiph), (3, bytes([len(frames) - 1]) + deltas)):
        body = b"\x81\x00\x00" + bytes([kind << 1]) + head + b"".join(frames)
        data = matroska.HEAD + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + matroska.TRACK_LIST + matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.uint(matroska.STAMP, 5) + matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, body))
        parsed = matroska.parse(data)
        assert [data[p.start : p.start + p.length] for p in parsed.packets] == frames and parsed.packets[0].timestamp == 5
        assert len({p.timestamp for p in parsed.packets}) == 5 and parsed.packets[4].timestamp == 5 + 4 * 24
    for lasts, step in ((b"", 0), (matroska.uint(matroska.LASTS, 40_000_000), 40)):
        track = matroska.element(matroska.TRACKS, matroska.element(matroska.TRACK, lasts + matroska.uint(matroska.NUMBER, 2)))
        block = matroska.element(matroska.SIMPLE, b"\x82\x00\x03\x84\x02" + bytes(9))
        body = track + matroska.element(matroska.CLUSTER, matroska.uint(matroska.STAMP, 100) + block)
        parsed = matroska.parse(matroska.element(matroska.EBML, b"") + matroska.element(matroska.SEGMENT, body))
        assert [p.timestamp for p in parsed.packets] == [103, 103 + step, 103 + 2 * step]
    whole_file = matroska.write(b" " * 192 * 20)
    with pytest.raises((ValueError, IndexError)):
        matroska.parse(whole_file[:-5])


def test_token_counts(docs, rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in rows)
    assert got(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(empty, path).count() == 0


# --- 9 ----------------------------------------------------------------------------------


def test_archives(spark):
    same, other = "s" * 150, "o" * 99
    rows = [(7, "http://a/\r\nX: y", same), (3, None, same), (5, "u", same), (9, "u", other), (1, "u", other), (2, "u", None), (4, "u", ""), (3, "u", same), (None, "u", same), (8, "u", "é" * 60 + "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, "k", 0) for r in rows], "page_id long, url string, html string, kind string, first int").repartition(3)
    want = Counter()
    for i, _, t in rows:
        raw = (t or "").encode()
        again = t == same and i not in (3, None)
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got(warc.archive(pages), *columns) == want
    assert warc.archive(pages.limit(0)).count() == 0
    files = []
    for part in (pages, pages.repartition(7)):  # the same table gives the same files, rolled at a size
        folder = common.scratch(spark, "test-warc")
        manifest = warc.write(part, folder, shards=2, roll_bytes=400)
        files.append(sorted((r["final"], r["records"], r["sha256"]) for r in manifest.collect()))
        assert got(warc.read(manifest, folder), *columns) == want
    assert files[0] == files[1] and len(files[0]) > 2


# --- 10 ---------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark, docs, rows, empty):
    own, marks = quality_rows()
    table = spark.createDataFrame(own, "doc_id long, text string")
    domains = mixing.by_quality(labels(spark, *marks))
    found = mixing.rates(table, domains, {"good": 0.9, "poor": 0.1}).collect()
    share = sum(r["rate"] * r["tokens"] * r["p_0"] for r in found) / sum(r["rate"] * r["tokens"] for r in found)
    assert abs(share - 0.9) < 0.01
    assert all(r["rate"] == 1.0 and r["copies"] == 1 for r in found if r["doc_id"] % 3)
    more = mixing.rates(table, domains, {"good": 0.5, "poor": 0.5}, total=2.0 * sum(r["tokens"] for r in found)).collect()
    assert abs(sum(r["rate"] * r["tokens"] for r in more) / sum(r["tokens"] for r in more) - 2) < 0.02
    odd = mixing.rates(docs, domains, {"good": 0.9, "poor": 0.1})
    assert got(odd, "doc_id") == Counter((i,) for i, _ in rows)
    assert got(mixing.rates(docs, mixing.by_quality(labels(spark)), {"good": 0.9, "poor": 0.1}), "doc_id") == Counter((i,) for i, _ in rows)
    assert mixing.rates(empty, domains, {"good": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.rates(table, domains, {"good": 0.0})


def test_posteriors_are_plain_naive_bayes(spark):
    own, marks = quality_rows()
    table = spark.createDataFrame(own, "doc_id long, text string")
    rows = sorted(mixing.figures(table).collect(), key=lambda r: r["doc_id"])
    x, good = np.array([[r[c] for c in mixing.FIGURES] for r in rows]), np.array([q == 1 for _, q, _ in marks])
    logs = []
    for some in (x[good], x[~good]):
        mean, var = some.mean(0), some.var(0) + mixing.FLOOR
        logs.append(np.log((len(some) + 1) / (len(x) + 2)) - ((x - mean) ** 2 / (2 * var) + np.log(var) / 2).sum(1))
    want = 1 / (1 + np.exp(logs[1] - logs[0]))
    found = {r["doc_id"]: r["p_0"] for r in mixing.rates(table, mixing.by_quality(labels(spark, *marks)), {"good": 0.9, "poor": 0.1}).collect()}
    assert np.abs(np.array([found[r["doc_id"]] for r in rows]) - want).max() < 1e-9


def test_strong_thinning_meets_its_targets(spark):
    rng, rows = random.Random(7), []
    for i in range(3000):  # poor text is 97% of the tokens, good and poor are hard to tell apart
        good = rng.random() if i % 30 else 1.0 - rng.random() / 50
        rows.append((i, rng.randint(50, 900), 0.06 * good**4, 1 - 0.06 * good**4) if i % 30 else (i, rng.randint(50, 900), good, 1 - good))
    table = spark.createDataFrame(rows, "doc_id long, tokens long, p_0 double, p_1 double")
    for goal in (0.5, 0.8, 0.95):
        weights = np.array([goal, 1 - goal])
        steps = mixing.fit(table, weights)
        sums = table.agg(*(F.sum(F.col("tokens") * mixing.rate(steps) * F.col(c)) for c in ("p_0", "p_1"))).first()
        have = sum(r[1] * r[2] for r in rows)
        assert np.abs(np.array(sums) / (weights * have / goal) - 1).max() < 1e-4


def test_small_rates_are_not_rounded_away(spark):
    own, marks = [], []
    for i in range(400):
        good = i % 10 == 0
        text = prose(i, 120)
        own.append((i, text if good else " ".join(w + "$%#"[i % 3] * 3 for w in text.split())))
        marks.append((i, int(good), 0))
    table = spark.createDataFrame(own, "doc_id long, text string")
    found = mixing.rates(table, mixing.by_quality(labels(spark, *marks)), {"good": 0.97, "poor": 0.03}).collect()
    share = sum(r["rate"] * r["tokens"] * r["p_1"] for r in found) / sum(r["rate"] * r["tokens"] for r in found)
    assert abs(share - 0.03) < 1e-5


def test_mix_keeps_columns_and_good_rows(spark):
    own, marks = quality_rows()
    table = spark.createDataFrame([(i, t, "l") for i, t in own], "doc_id long, text string, copies string")
    out = mixing.mix(table, mixing.by_quality(labels(spark, *marks)), {"good": 0.95, "poor": 0.05})
    kept = Counter(r["doc_id"] for r in out.collect())
    assert out.columns == table.columns and all(kept[i] == 1 for i in range(300) if i % 3)
    assert sum(kept[i] for i in range(0, 300, 3)) < 60


CLASHING = ["key", "node", "least", "d", "k", "kept", "own_id", "copies", "found_key", "copy", "_key", "_id", "_d", "_k", "_node", "_copies", "_bad", "class_id", "text_"]


def test_columns_of_any_name_stay(spark):
    """Operators that give back the rows they were given leave all other columns alone."""
    shared = prose(5, 200)
    rows = [(1, "one " + shared + " end"), (2, "one " + shared + " end"), (3, "clean words"), (None, None), (4, shared)]
    rows = [(*r, *(f"{c}-{r[0]}" for c in CLASHING)) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))
    marks = labels(spark, (1, 1, 0), (3, 0, 0), (4, 1, 1))
    for out in (order_minhash.one_of_each(docs), suffix_dedup.cleaned(docs), toxicity.clean(docs, marks), mixing.mix(docs, mixing.by_quality(marks), {"good": 0.5, "poor": 0.5})):
        found = out.collect()
        assert out.columns == docs.columns and found
        assert all(r[c] == f"{c}-{r['doc_id']}" for r in found for c in CLASHING)


# --- the queries ------------------------------------------------------------------------


def test_queries_and_pipeline(spark):
    import __spark_entry__
    import corpus_pipeline

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, common.cut(stage(spark, at, sf), name)
        assert at.columns == docs.columns and 0 < at.count() <= before.count()
    found = corpus_pipeline.STAGES[-1][1](spark, at, sf).collect()
    whole(found, 2048)
    assert {r["doc_id"] for r in found} == {r["doc_id"] for r in at.select("doc_id").collect()} <= ids
