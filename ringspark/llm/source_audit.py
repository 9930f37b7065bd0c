"""Divergence between the sources of a language, from joint histograms of their term counts.

A term is a run of letters (A-Z lowered; all characters beyond ASCII count as letters).  A
language keeps the terms that at least ``least`` of its documents have.  Each group of one
language and source, and each language as a whole, gives a kept term with ``count`` occurrences
the mass  p = 1 + floor(UNIT * (count + 1) / (N + V))  for N occurrences of kept terms in the
group and V kept terms.  The divergence of a group from another is the sum over kept terms of
f = floor((p - q)^2 / q).

f depends only on the two counts, so for each pair of sources the terms are tallied by (count,
count), zero counts included, and f is evaluated once for a combination and taken as often as it
occurs.  Terms that neither source has are never written: their number is V less all others.

Texts are counted once, in tasks that sum up before they write; a table of (language, source,
term) is all that is shuffled.  For the tallies the sources of a language are numbered and dealt
into blocks of BLOCK; each pair of blocks meets term by term, so no row holds more than two
blocks of counts, and a task tallies a bounded matrix at a time.  Counts and sums are exact whole
numbers; where they could pass 64 bits they are decimals.

Defined results: null text, language and source are the empty string; repeated rows are different
documents; a group without terms has all counts 0; without kept terms all divergences are 0; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

UNIT, LEAST, TOP = 1_000_000_000, 3, 200
BLOCK = 128
HELD = 250_000
CELLS = 1_000_000
ROWS = 100_000
#: Every byte of a term as its small letter, everything else a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed within the task.

    The empty term stands for the group itself.
    """
    found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms, occurs, in_docs = [b"", *n], [0, *n.values()], [0, *map(docs.__getitem__, n)]
            for at in range(0, len(terms), ROWS):
                some = pa.array(terms[at : at + ROWS], pa.binary()).cast(pa.string())
                named = [pa.array([x] * len(some), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*named, some, pa.array(occurs[at : at + ROWS], pa.int64()), pa.array(in_docs[at : at + ROWS], pa.int64())], ["lang", "source", "term", "n", "docs"])
        found.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            for lang, source, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = raw.translate(LETTERS).split()
                n, docs = found[lang, source]
                before = len(n)
                n.update(words)
                docs.update(set(words))
                held += len(n) - before
                if held >= HELD:
                    yield from flush()
                    held = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), with a row of the empty term for each group."""
    empty = F.lit("")
    named = [F.coalesce(docs[c].cast("string"), empty).alias(c) for c in ("lang", "source")]
    rows = docs.select(*named, F.coalesce(docs["text"].cast("string"), empty).cast("binary").alias("text"))
    found = rows.mapInArrow(counted_terms, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, i, j, x, y, m): how many terms occur x times in source i and y times in source j.

    A row comes with a language, its number of sources, two blocks of them and the counts of one
    term in these blocks; terms that neither i nor j has are left out.
    """
    waiting: dict[tuple, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
    sizes: Counter = Counter()
    names, kinds = ["lang", "i", "j", "x", "y", "m"], (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def tally(key: tuple) -> Iterator[pa.RecordBatch]:
        lang, n, a, b = key
        columns = np.r_[np.arange(a * BLOCK, min((a + 1) * BLOCK, n)), np.arange(b * BLOCK, min((b + 1) * BLOCK, n)) if a != b else np.arange(0)]
        place = np.zeros(n, dtype=np.int64)
        place[columns] = np.arange(len(columns))
        parts = waiting.pop(key)
        base = np.cumsum([0, *(p[0][-1] + 1 for p in parts)])
        term, source, count = (np.concatenate(x) for x in zip(*((p[0] + at, p[1], p[2]) for p, at in zip(parts, base, strict=False)), strict=True))
        counts = np.zeros((len(columns), base[-1]), dtype=np.int64)
        counts[place[source], term] = count
        values, code = np.unique(counts, return_inverse=True)
        code = code.reshape(counts.shape)
        own = min(BLOCK, n - a * BLOCK)
        out, rows = [], 0
        for i in range(own):
            for j in range(i + 1 if a == b else own, len(columns)):
                either = (counts[i] > 0) | (counts[j] > 0)
                cell, m = np.unique(code[i][either] * len(values) + code[j][either], return_counts=True)
                if len(cell):
                    out.append((np.full(len(cell), columns[i]), np.full(len(cell), columns[j]), values[cell // len(values)], values[cell % len(values)], m))
                    rows += len(cell)
                if rows >= ROWS:
                    yield batch_of(lang, out)
                    out, rows = [], 0
        if out:
            yield batch_of(lang, out)

    def batch_of(lang: str, out: list[tuple]) -> pa.RecordBatch:
        whole = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[lang] * len(whole[0]), *whole], kinds, strict=True)], names)

    for batch in batches:
        lists = batch.column(4)
        at, flat = lists.offsets.to_numpy(), lists.values
        source, count = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        keys: dict[tuple, list[int]] = defaultdict(list)
        for row, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
            keys[key].append(row)
        for key, rows in keys.items():
            index = np.array(rows)
            size = at[index + 1] - at[index]
            places = np.repeat(at[index] - np.cumsum(size) + size, size) + np.arange(size.sum())
            waiting[key].append((np.repeat(np.arange(len(index)), size), source[places], count[places]))
            sizes[key] += len(index) * min(2 * BLOCK, key[1])
            if sizes[key] >= CELLS or sizes.total() >= 4 * CELLS:
                for some in [key] if sizes[key] >= CELLS else list(waiting):
                    yield from tally(some)
                    del sizes[some]
    for key in list(waiting):
        yield from tally(key)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences from other sources, and the terms of most weight."""
    counts = cut(term_counts(docs), "term-counts", batch_rows=None)
    terms = counts.filter("term <> ''")
    kept = cut(terms.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs"), "kept-terms")
    own = cut(terms.drop("docs").join(kept, ["lang", "term"]), "own-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("n_own"))
    zero, w = F.lit(0).cast("long"), Window.partitionBy("lang")
    groups = counts.filter("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n_own", "n_lang", "v")), (F.row_number().over(w.orderBy("source")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n_sources"))
    groups = cut(groups, "source-groups")
    discard(counts, kept)
    return pairs(own, groups).unionByName(weights(own, groups, top))


def exact(fmt: str, **columns: str) -> Column:
    return F.expr(fmt.format(**columns))


#: p of a count, and f of two masses.  64 bits hold UNIT * (count + 1) for counts of under 9e9.
MASS = f"(1 + CASE WHEN {{n}} < 9000000000 THEN ({UNIT}L * ({{n}} + 1)) div ({{total}} + {{v}}) ELSE (CAST({UNIT} AS DECIMAL(18,0)) * CAST({{n}} + 1 AS DECIMAL(20,0))) div CAST({{total}} + {{v}} AS DECIMAL(20,0)) END)"
WEIGHT = "((({p} - {q}) * ({p} - {q})) div {q})"


def pairs(own: DataFrame, groups: DataFrame) -> DataFrame:
    """The part ``pair``: every other source of the language, by divergence."""
    block = F.floor(F.col("i") / BLOCK)
    dealt = own.join(groups.select("lang", "source", "i", "n_sources"), ["lang", "source"])
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_sources") - 1) / BLOCK)))
    dealt = dealt.select("lang", "term", "n_sources", "i", "n", block.alias("block"), other.alias("other"))
    met = dealt.groupBy("lang", "n_sources", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "term").agg(F.collect_list(F.struct("i", "n")).alias("counts"))
    cells = met.select("lang", "n_sources", "a", "b", "counts").mapInArrow(tallies, "lang string, i long, j long, x long, y long, m long")
    cells = cut(cells.groupBy("lang", "i", "j", "x", "y").agg(F.sum("m").alias("m")), "joint-counts", batch_rows=None)
    one, two = (groups.select("lang", F.col("source").alias(s), F.col("i").alias(c), F.col("n_own").alias(f"n_{c}"), *(["v"] if c == "i" else [])) for s, c in (("source", "i"), ("item", "j")))
    both = one.join(two, "lang").filter("i < j")
    rows = both.join(cells, ["lang", "i", "j"], "left")
    rows = rows.select("*", exact(MASS, n="x", total="n_i", v="v").alias("p"), exact(MASS, n="y", total="n_j", v="v").alias("q"))
    as_wide = lambda p, q: F.sum(exact(WEIGHT, p=p, q=q).cast("decimal(20,0)") * F.col("m").cast("decimal(18,0)"))
    summed = rows.groupBy("lang", "source", "item", "i", "j", "n_i", "n_j", "v").agg(as_wide("p", "q").alias("there"), as_wide("q", "p").alias("back"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
    # what neither source has
    none = F.when(F.col("v") > 0, exact(MASS, n="0L", total="n_i", v="v")), F.when(F.col("v") > 0, exact(MASS, n="0L", total="n_j", v="v"))
    summed = summed.select("*", none[0].alias("p0"), none[1].alias("q0"))
    value = lambda own_sum, p, q: (F.coalesce(own_sum, F.lit(0)) + F.when(F.col("v") > F.col("m"), exact(WEIGHT, p=p, q=q).cast("decimal(20,0)") * (F.col("v") - F.col("m")).cast("decimal(18,0)")).otherwise(0)).cast("long").alias("value")
    ends = F.array(F.struct(F.col("source").alias("s"), F.col("item").alias("o"), value(F.col("there"), "p0", "q0")), F.struct(F.col("item").alias("s"), F.col("source").alias("o"), value(F.col("back"), "q0", "p0")))
    out = summed.select("lang", F.explode(ends).alias("e")).select("lang", F.col("e.s").alias("source"), F.lit("pair").alias("part"), F.col("e.o").alias("item"), "e.value")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def weights(own: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The part ``term``: the terms that a group uses more than its language, by weight."""
    rows = own.join(groups.select("lang", "source", "n_own", "n_lang", "v"), ["lang", "source"])
    rows = rows.select("lang", "source", "term", exact(MASS, n="n", total="n_own", v="v").alias("p"), exact(MASS, n="total", total="n_lang", v="v").alias("q")).filter("p > q")
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), exact(WEIGHT, p="p", q="q").alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
