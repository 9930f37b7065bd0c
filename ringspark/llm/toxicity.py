"""Toxicity by a fuzzy lexicon and the context of its hits.

The lexicon holds fixed whole words and terms mined from a bounded sample of labelled training
rows: whole words, and word stems, whose share among toxic documents is many times that among
clean ones.  Its terms form a trie; a Levenshtein automaton for each new word (its states are
rows of edit distances, dead once all exceed the bound) is run along the trie, so one walk finds
all terms within the bound.  Words that cannot be made equal to a term by leaving out letters of
both are not walked.  Stems are met at the start of a word.

Each hit is weighed by a window of words around it: quotation marks and verbs of reporting speak
for quotation, second persons for abuse.  The summed weights, by kind of hit, go through a
logistic regression that is fitted on a bounded sample of labelled rows outside the held-out
fold, with a documented prior, so that a kind which the sample lacks keeps its prior weight.

Defined results: a null or empty text has no hits and gets the score of a text without hits;
without labels the fixed words and the prior decide; repeated rows are scored as often as they
come; extra columns are not read by :func:`score` and are kept by :func:`clean`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, labelled, texts, worker_cache
from .order_minhash import sketches, word_bands

# Whole words that abuse people in English, reporting verbs, second persons, quotes.
WORDS = ("idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "scum", "trash", "clown", "worthless", "pathetic", "disgusting", "imbecile", "dumbass", "jerk", "bastard", "asshole", "bitch", "fuck", "fucking", "shit", "bullshit", "crap", "vermin", "filth")
REPORTS = {"said", "says", "say", "wrote", "writes", "called", "calls", "quote", "quoted", "quotes", "reported", "reports", "term", "word", "according", "sagte", "schrieb", "laut", "wort", "dit", "écrit", "selon", "mot", "dijo", "escribió", "según", "palabra"}
PERSONS = {"you", "your", "you're", "youre", "u", "du", "dich", "dein", "ihr", "euch", "tu", "te", "toi", "vous", "votre", "tú", "usted", "ustedes", "eres"}
QUOTES = "\"“”„«»‚‘’›‹"

CLASS_ROWS, TRAIN_ROWS, CACHE_ENTRIES, WINDOW = 5_000, 20_000, 400_000, 8
STEMS, LEAST_ODDS = (4, 5, 6), 25.0
NAMES = ("exact", "fuzzy", "stem", "quoted", "cluster", "density")
# Prior means of the regression: intercept, then NAMES; all with precision PRECISION.
PRIOR, PRECISION = np.array([-4.0, 6.0, 5.0, 6.0, -2.0, 0.5, 0.5]), 0.05
FOLDS, HELD = 5, 0


def bound(term: str) -> int:
    """Edits that a misspelling of a term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def without(word: str, n: int) -> list[str]:
    """The word with n letters left out, in every way."""
    if n == 0:
        return [word]
    if n == 1:
        return [word[:i] + word[i + 1 :] for i in range(len(word))]
    return [word[:i] + word[i + 1 : j] + word[j + 1 :] for i, j in combinations(range(len(word)), 2)]


class Trie:
    """Terms by letters, and the walk of a word's automaton along them."""

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems = set(words), set(stems)
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        # parts of a term of which one stays whole, in place, under the edits that it may have;
        # and what is left of a term without that many letters
        self.heads, self.tails, self.cuts = {}, {}, {}
        inner: set[str] = set()
        for k in (1, 2):
            own = [w for w in words if bound(w) == k]
            ends = [[len(w) * i // (k + 1) for i in range(k + 2)] for w in own]
            # an exchange over a border touches two parts: the letter beyond it stands at the border
            self.heads[k] = tuple({v for w, e in zip(own, ends, strict=True) for v in (w[: e[1]], w[: e[1] - 1] + w[e[1]])})
            self.tails[k] = tuple({v for w, e in zip(own, ends, strict=True) for v in (w[e[k] :], w[e[k] - 1] + w[e[k] + 1 :])})
            inner |= {w[e[1] : e[2]] for w, e in zip(own, ends, strict=True) if k == 2}
            self.cuts[k] = {v for w in own for n in range(k + 1) for v in without(w, n)}
        self.widest = max(map(len, words), default=0) + 2
        self.inner = re.compile("|".join(sorted(map(re.escape, inner))) or r"(?!)").search
        self.stem = re.compile("|".join(sorted(map(re.escape, stems), key=lambda s: (len(s), s))) or r"(?!)").match

    def likely(self, word: str) -> bool:
        """Whether the word and a term can be made equal by leaving out letters of both.

        Words within the bound of a term all can, so that only these few are walked.
        """
        if word.startswith(self.heads[1]) or word.endswith(self.tails[1]):
            if word in self.cuts[1] or not self.cuts[1].isdisjoint(without(word, 1)):
                return True
        if 6 < len(word) and (word.startswith(self.heads[2]) or word.endswith(self.tails[2]) or self.inner(word)):
            return word in self.cuts[2] or not all(self.cuts[2].isdisjoint(without(word, n)) for n in (1, 2))
        return False

    def near(self, word: str) -> tuple[int, str] | None:
        """The nearest term within its bound: (edits, term)."""
        best: tuple[int, str] | None = None
        stack = [(self.root, "", [*range(len(word) + 1)], [])]
        while stack:
            node, letter, row, above = stack.pop()
            for c, below in node.items():
                if c == "":
                    if row[-1] <= bound(below) and (best is None or (row[-1], below) < best):
                        best = row[-1], below
                    continue
                new = [row[0] + 1]
                for i, x in enumerate(word, 1):
                    cost = min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != c))
                    if above and i > 1 and x == letter and word[i - 2] == c:
                        cost = min(cost, above[i - 2] + 1)  # two letters exchanged
                    new.append(cost)
                if min(new) <= 2:
                    stack.append((below, c, new, row))
        return best

    def look_up(self, chunk: str) -> str:
        """e, f or s with the term for an exact, fuzzy or stem hit; empty for none."""
        word = chunk.lower().strip(".,;:!?()[]{}*#$%&|<>~_-" + QUOTES + "'")
        if word in self.words:
            return "e" + word
        if self.stems and (m := self.stem(word)):
            return "s" + m[0]
        if 4 <= len(word) <= self.widest and self.likely(word) and (hit := self.near(word)):
            return "f" + hit[1]
        return ""


def figures(words: list[str], at: list[int], hits: list[str]) -> tuple[float, ...]:
    """Weights of the hits by kind, after their context windows."""
    sums = dict.fromkeys(NAMES, 0.0)
    for i, hit in zip(at, hits, strict=True):
        window = words[max(0, i - WINDOW) : i + WINDOW + 1]
        bare = {w.lower().strip(".,;:!?" + QUOTES) for w in window}
        inner = words[max(0, i - 2) : i + 3]
        marks = sum(c in QUOTES for w in inner for c in (w[:1], w[-1:]))
        quotation = 0.5 * bool(marks) + 0.3 * (words[i][:1] in QUOTES or words[i].rstrip(".,;:!?")[-1:] in QUOTES) + 0.4 * bool(bare & REPORTS)
        weight = max(0.1, 1 + 0.3 * bool(bare & PERSONS) - quotation)
        sums[{"e": "exact", "f": "fuzzy", "s": "stem"}[hit[0]]] += weight
        sums["quoted"] += min(1.0, quotation)
    near = sum(b - a <= WINDOW for a, b in zip(at, at[1:], strict=False))
    squeeze = lambda x: min(1.0, x) + 0.25 * np.log1p(max(0.0, x - 1))
    return squeeze(sums["exact"]), squeeze(sums["fuzzy"]), squeeze(sums["stem"]), sums["quoted"] / max(1, len(at)), np.log1p(near), float(np.log1p(100 * len(at) / max(1, len(words))))


def feature_table(docs: DataFrame, terms: tuple[list[str], list[str]]) -> DataFrame:
    name = f"terms:{hash(repr(terms))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache(name)
        if not held:
            held["trie"], held["seen"] = Trie(*terms), {}
        trie, seen = held["trie"], held["seen"]
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                words = [t.split() for t in part.column(1).to_pylist()]
                if len(seen) > CACHE_ENTRIES:
                    seen.clear()
                for w in set().union(*words) - seen.keys():
                    seen[w] = trie.look_up(w)
                rows = []
                for own in words:
                    found = list(map(seen.__getitem__, own))
                    at = [i for i, hit in enumerate(found) if hit] if any(found) else []
                    rows.append(figures(own, at, [found[i] for i in at]) if at else (0.0,) * len(NAMES))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in np.array(rows, dtype=np.float64).reshape(-1, len(NAMES)).T)], ["doc_id", *NAMES])

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in NAMES))


def singled(sample: DataFrame) -> DataFrame:
    """One row (text, y) of each group of copies and near copies of a label in the bounded sample.

    Texts that share a bucket of the order min-hash hold much the same text and speak once.  At
    most one short row of sketches for each row of the sample comes to the driver.
    """
    rows = cut(sample.select(F.xxhash64("text", "y").alias("node"), "text", "y").dropDuplicates(["node"]), "toxic-texts")
    side = {r["node"]: r["y"] for r in rows.select("node", "y").collect()}
    root = {node: node for node in side}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first: dict[tuple[int, int, int], int] = {}
    for node, buckets in ((r["node"], r["buckets"]) for r in sketches(rows, word_bands).select("node", "buckets").collect()):
        for band, bucket in enumerate(buckets):
            a, b = find(node), find(first.setdefault((side[node], band, bucket), node))
            root[max(a, b)] = min(a, b)
    kept = [(node,) for node in root if root[node] == node]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(kept, "node long")), "node").select("text", "y")


def varied(sample: DataFrame, telling: list, least: int) -> list:
    """The terms that toxic documents hold between at least so many different pairs of words.

    A passage that many documents share holds its words in the same company each time, and tells
    of no more than that passage.  At most one row for each term comes to the driver.
    """
    terms = {kind: {x["term"] for x in telling if x["kind"] == kind} for kind in "ws"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, str, str]] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = ["", *(x.strip(".,;:!?()" + QUOTES) for x in text.lower().split()), ""]
                for before, w, after in zip(own, own[1:], own[2:], strict=False):
                    company = f"{before} {after}"
                    if w in terms["w"]:
                        found.add(("w", w, company))
                    found.update(("s", w[:n], company) for n in STEMS if w[:n] in terms["s"])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["kind", "term", "company"])

    pairs = sample.filter("y = 1").select("text").mapInArrow(run, "kind string, term string, company string").distinct()
    company = {(r["kind"], r["term"]): r["n"] for r in pairs.groupBy("kind", "term").agg(F.count("*").alias("n")).collect()}
    return [r for r in telling if company.get((r["kind"], r["term"]), 0) >= least]


def mine(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """(whole words, stems): the fixed words and what the labelled sample adds.

    At most CLASS_ROWS training rows of either label are read, of which copies and near copies
    count once; of them come document counts of words and stems, and of these counts all telling
    ones, and only these, reach the driver.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(fold("doc_id", FOLDS) != HELD)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    some = [marks.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CLASS_ROWS) for y in (0, 1)]
    sample = cut(singled(texts(docs).join(F.broadcast(some[0].union(some[1])), "doc_id")), "toxic-sample")
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return sorted(WORDS), []
    least = max(6, toxic // 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {"w": Counter(), "s": Counter()}
        clean_counts: dict[str, Counter] = {"w": Counter(), "s": Counter()}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in (x.strip(".,;:!?()" + QUOTES) for x in text.lower().split()) if 3 < len(w) < 24 and w.isalpha()}
                to = counts if y else clean_counts
                to["w"].update(words)
                to["s"].update({w[:n] for w in words for n in STEMS if len(w) >= n})
        for kind in "ws":
            for part, y in ((counts, 1), (clean_counts, 0)):
                keys = list(part[kind])
                for i in range(0, len(keys), 50_000):
                    own = keys[i : i + 50_000]
                    n = [part[kind][x] for x in own]
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own)), pa.array(own), pa.array([v * y for v in n], pa.int64()), pa.array([v * (1 - y) for v in n], pa.int64())], ["kind", "term", "n_toxic", "n_clean"])

    odds = (F.col("n_toxic") + 0.5) / (toxic + 1) / ((F.col("n_clean") + 0.5) / (clean + 1))
    counted = sample.select("text", "y").mapInArrow(run, "kind string, term string, n_toxic long, n_clean long").groupBy("kind", "term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    telling = counted.filter((F.col("n_toxic") >= least) & (odds >= LEAST_ODDS)).orderBy(F.desc("n_toxic"), "term").collect()
    telling = varied(sample, telling, least)
    words = {r["term"]: r["n_toxic"] for r in telling if r["kind"] == "w"}
    stems: list[str] = []
    for n_toxic, stem in sorted(((r["n_toxic"], r["term"]) for r in telling if r["kind"] == "s"), key=lambda x: (len(x[1]), x[1])):
        spread = [n for w, n in words.items() if w.startswith(stem)]
        # a stem stands for many words; where one word makes up most of it, that word is the term
        if not any(stem.startswith(s) for s in stems) and max(spread, default=0) < 0.6 * n_toxic:
            stems.append(stem)
    # a longer stem that nearly all of a stem's documents share is the better one
    shares = {r["term"]: r["n_toxic"] for r in telling if r["kind"] == "s"}
    for i, stem in enumerate(stems):
        stems[i] = max((s for s, n in shares.items() if s.startswith(stem) and n >= 0.9 * shares[stem]), key=lambda s: (len(s), s))
    return sorted({*WORDS, *(w for w in words if not any(w.startswith(s) for s in stems))}), stems


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a normal prior around PRIOR, by Newton steps with halving."""
    x = np.c_[np.ones(len(x)), x]

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + PRECISION / 2 * ((b - PRIOR) ** 2).sum())

    b = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - y) + PRECISION * (b - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(b)), grad)
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return b


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    features = cut(feature_table(docs, mine(docs, labels)), "toxicity")
    rows = labelled(features, labels, "toxic", fold("doc_id", FOLDS) != HELD, TRAIN_ROWS)
    data = np.array([[r[c] for c in (*NAMES, "y")] for r in rows], dtype=np.float64).reshape(-1, len(NAMES) + 1)
    weights = fit(data[:, :-1], data[:, -1])
    linear = F.lit(float(weights[0]))
    for c, w in zip(NAMES, weights[1:].tolist(), strict=True):
        linear = linear + F.col(c) * F.lit(w)
    p = 1 / (1 + F.exp(-linear))
    return features.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those of ids that are predicted toxic; all columns stay.

    Of rows that share an id, all go if one is toxic.  Rows with a null id stay only if no such
    row is toxic.
    """
    bad = score(docs, labels).filter("predicted = 1").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]), "left_anti")
