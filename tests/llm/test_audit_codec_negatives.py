"""Source audit, BPE codec and hard negatives against plain versions, and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ringspark.llm import bpe_codec, hard_negatives, queries, source_audit

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- 11 ---------------------------------------------------------------------------------


def plain_audit(rows, least=3, top=200):
    """(lang, source, part, item, value, rank) by the definition, term by term."""
    unit = 10**9
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or "", source or ""].update(words)
        in_docs[lang or ""].update(set(words))
    out = []
    for lang in in_docs:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        mine = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        whole = {t: sum(c[t] for c in mine.values()) for t in kept}

        def mass(own):
            return {t: 1 + unit * (own[t] + 1) // (sum(own.values()) + len(kept)) for t in kept}

        p, q = {s: mass(c) for s, c in mine.items()}, mass(whole)
        for s in mine:
            others = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in mine if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", others, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, n) for n, (item, value) in enumerate(items[:most], 1)]
    return Counter(out)


COLUMNS = ("lang", "source", "part", "item", "value", "rank")
AUDIT = "doc_id long, lang string, source string, text string, term string, n long, i string"


def audit_rows():
    rng = random.Random(5)
    words = ["Ab", "ab", "über", "ÜBER", "naïve", "日本", "x", "don't", "a1b2", "zz", "Ångström", "🙂"]
    rows = [("en", f"s{rng.randint(0, 6)}", " ".join(rng.choices(words, [2 ** (12 - i) for i in range(12)], k=rng.randint(0, 30)))) for _ in range(120)]
    rows += [("en", "none", ""), ("en", "none", None), (None, None, "ab ab"), (None, "s", "ab"), ("", None, "AB"), ("one", "only", "ab cd"), ("de", "u", "einmal"), ("de", "v", "1 2 3")]
    return rows + rows[:5]


def test_audit_equals_plain_version(spark, monkeypatch):
    rows = audit_rows()
    df = spark.createDataFrame([(i, *r, "t", 1, "i") for i, r in enumerate(rows)], AUDIT).repartition(3)
    want = plain_audit(rows)
    assert got(source_audit.audit(df), *COLUMNS) == want
    # sources in several blocks, tallies and counts in small parts
    for name, value in (("BLOCK", 2), ("CELLS", 40), ("HELD", 7), ("ROWS", 5)):
        monkeypatch.setattr(source_audit, name, value)
    assert got(source_audit.audit(df), *COLUMNS) == want


def test_audit_of_tables_without_rows_or_terms(spark):
    empty = spark.createDataFrame([], AUDIT)
    assert source_audit.audit(empty).count() == 0
    bare = spark.createDataFrame([(1, "en", "a", None, "", 0, ""), (2, "en", "b", "!", "", 0, "")], AUDIT)
    assert got(source_audit.audit(bare), *COLUMNS) == {("en", "a", "pair", "b", 0, 1): 1, ("en", "b", "pair", "a", 0, 1): 1}


def test_tallies_are_joint_counts():
    import pyarrow as pa

    rng = random.Random(1)
    n = 5
    terms = [{i: rng.randint(1, 3) for i in range(n) if rng.random() < 0.5} for _ in range(60)]
    lists = pa.array([[{"i": i, "n": c} for i, c in t.items()] for t in terms], pa.list_(pa.struct([("i", pa.int64()), ("n", pa.int64())])))
    fixed = [pa.array(["en"] * 60), *(pa.array([x] * 60, pa.int64()) for x in (n, 0, 0))]
    batches = source_audit.tallies(iter([pa.RecordBatch.from_arrays([*fixed, lists], ["lang", "n_sources", "a", "b", "counts"])]))
    found = Counter({(r["i"], r["j"], r["x"], r["y"]): r["m"] for b in batches for r in b.to_pylist()})
    want = Counter((i, j, t.get(i, 0), t.get(j, 0)) for t in terms for i in range(n) for j in range(i + 1, n) if i in t or j in t)
    assert found == want


# --- 12 ---------------------------------------------------------------------------------

TEXTS = [
    None, "", " ", "\n\n", "a", "<|endoftext|> hi<|startoftext|>x", "<|endoftext|", "ΑΣΣ Σίσυφος İstanbul", "a" * 3000, "é café\x1ca b\x85c é", "日本語テキスト 😀😀", "....!!!???---===" * 30,
    "don't WE'LL 's 't", "\x00\x01", "1234567890 12.5", "� ​ x", "same", "same", "Ǆ ß ﬁ", " lead  and   trail \t\x1c\x0b\n",
]


def library(path, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec_equals_the_library(spark, name):
    path, rng = public_tokenizers.path(name), random.Random(3)
    own = TEXTS + ["".join(rng.choice("abcdetns rhiolu.,'!-–é1290AB") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    df = spark.createDataFrame([(None if i == 3 else i, t, "n", "d") for i, t in enumerate(own)], "doc_id long, text string, n_tokens string, ids string").repartition(3)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for i, t in enumerate(own):
        ids, text = library(path, t)
        want[None if i == 3 else i, len(ids), digest(" ".join(map(str, ids))), digest(text)] += 1
    assert got(bpe_codec.round_trip(df, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    texts = {r["doc_id"]: r["text"] for r in bpe_codec.decode(bpe_codec.encode(df, path), path).collect()}
    assert texts == {None if i == 3 else i: library(path, t)[1] for i, t in enumerate(own)}
    assert bpe_codec.round_trip(df.limit(0), path).count() == 0


def plain_merges(word, rank):
    """The leftmost pair of least rank is joined, again and again."""
    parts = list(word)
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_backtracking_equals_merges_one_at_a_time():
    """Vocabularies of few letters have many overlapping tokens and equal pairs in a row."""
    for seed in range(30):
        rng = random.Random(seed)
        symbols = [c for c, _ in bpe_codec.byte_letters().items()]
        tokens, merges = list(symbols), []
        small = list("abc")
        while len(merges) < 25:
            pair = rng.choice(small), rng.choice(small)
            if (joined := "".join(pair)) not in tokens:
                merges.append(pair)
                tokens.append(joined)
                small.append(joined)
        names = {t: i for i, t in enumerate(tokens)}
        own = bpe_codec.Merges(names, merges)
        rank = {p: n for n, p in enumerate(merges)}
        for _ in range(150):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 24)))
            assert [tokens[i] for i in own.encode(word.encode())] == plain_merges(word, rank)


# --- 13 ---------------------------------------------------------------------------------


def plain_negatives(rows, every=100, k=5, m=5):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by the definition."""
    own = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        own[i] = min(own.get(i, one), one)
    out = Counter()
    for a in (i for i in own if i % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(own[a][1], v, strict=False)), i, label) for i, (label, v) in own.items() if i != a)
        for p, positive, _ in [s for s in scored if s[2] == own[a][0]][:k]:
            fit = [s for s in scored if s[2] != own[a][0] and 80 * -p <= 100 * -s[0] <= 100 * -p][:m]
            for n, (score, i, _) in enumerate(fit, 1):
                out[a, positive, n, i, -p, -score] += 1
    return out


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
VECTORS = "vec_id long, embedding array<float>, label int, vec string, unit string, score string"


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "v", "u", "s") for r in rows], VECTORS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return got(hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label=label), *NEGATIVES)


def clustered(seed, n):
    """Rows near few centres, a third of them the same row; labels do not follow the centres."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    hot = [0.5] * 6
    return [(i, hot if rng.random() < 0.33 else [round(x + rng.gauss(0, 0.1), 3) for x in rng.choice(centres)], rng.randint(0, 9)) for i in range(n)]


def test_negatives_equal_plain_version(spark, monkeypatch):
    rows = clustered(1, 900)
    rows += [(None, [1.0] * 6, 1), (2000, None, 1), (2100, [1.0, None, 1.0], 1), (2200, [float("nan")] * 6, 1), (2300, [float("inf")] * 6, 2), (2400, [1.0] * 6, None), (2500, [], 3), (2600, [0.9, 0.4], 3), (100, [0.0] * 6, 0), rows[300]]
    want = plain_negatives(rows)
    assert len(want) > 200 and mined(spark, rows) == want
    # many units: small blocks of anchors, small streams, few sampled rows
    for name, value in (("ANCHORS", 2), ("STREAM", 16), ("CELLS", 40), ("SAMPLE", 64), ("PIVOTS", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(spark, rows) == want


def test_bounds_rule_rows_out(spark):
    """Where clusters lie apart, rows go to few groups; the result is the whole one."""
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        axis = rng.randrange(8)
        rows.append((i, [round(rng.gauss(3.0 if x == axis else 0.0, 0.05), 3) for x in range(8)], rng.randint(0, 2)))
    assert mined(spark, rows) == plain_negatives(rows)
    own = hard_negatives.prepared(spark.createDataFrame([(*r, "", "", "") for r in rows], VECTORS), "vec_id", "embedding", F.col("label")).collect()
    space = hard_negatives.Space([r["vec_id"] for r in own], [r["label"] for r in own], [r["vec"] for r in own], 8, max(r["norm"] for r in own))
    import numpy as np

    data = np.array([np.frombuffer(r["vec"], "<i4") for r in own])
    anchors = data[::100]
    away, d = space.of_anchors(anchors), space.of_rows(data)
    true = np.sqrt(np.maximum(0, ((anchors.astype(float) ** 2).sum(1)[:, None] + space.largest - 2 * (anchors.astype(float) @ data.T))))
    for a in range(len(anchors)):
        nearest, farthest = np.abs(away[a] - d).max(axis=1), (away[a] + d).min(axis=1)
        assert (nearest <= true[a] + space.slack).all() and (true[a] <= farthest + space.slack).all()
        assert (nearest > np.sort(true[a])[20]).mean() > 0.5


def test_negatives_without_rows_or_anchors(spark):
    assert mined(spark, []) == Counter()
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == Counter()
    assert mined(spark, [(100, [1.0], 1), (101, [-1.0], 1), (102, [-0.9], 2)]) == plain_negatives([(100, [1.0], 1), (101, [-1.0], 1), (102, [-0.9], 2)])


def test_large_components_are_exact(spark):
    big = 60000.0
    rows = [(100, [big, -big, 1.0], 1), (101, [big, -big, 2.0], 1), (102, [big, -big, 1.5], 2), (103, [big, -big, 1.25], 2), (104, [70000.0, 0.0, 0.0], 2)]
    assert mined(spark, rows) == plain_negatives(rows[:4])


# --- SQL --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_source_audit", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want)
