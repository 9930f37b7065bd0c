"""Near-duplicates by order min-hashing, verified by banded alignment of words.

Two texts are linked if an alignment matches words in order so that the matched ones are 0.8 or
more of all, m / (|a| + |b| - m).  Five-word shingles that match in order for 0.8 or more imply
this, so no link of such shingles is left out.

The k-mers of a text are its pairs of words, each labelled with how often it came before, so that
no two are alike.  For each of ``BANDS`` hash functions the ``TUPLE`` k-mers with the least
values are taken and put back into text order; the ordered tuple is the text's bucket in that
band.  Unlike a plain min-hash the bucket changes when text is moved around.  With one word in
ten replaced, about 0.68 of the pairs are common, and 32 bands of 4 miss two texts with a
probability below 0.001.

Short texts have few pairs to draw from.  There, candidates for five-word shingles are exact: two
texts of together t shingles are linked by them only if at most t / 9 of these are unmatched.
Shingles are dealt by a hash to one class more than that, so that some class holds only matched
ones, the same in both texts and in the same order; the ordered shingles of each class are a
bucket.  This is done for every such number up to ``APART``.

The alignment is a longest common subsequence within a band around the diagonal, kept as the bits
of an integer, a row of the table at a time.  The band starts narrow; it is widened, up to the
greatest number of unmatched words that a link allows, only if the words that the texts share in
any order could still reach the threshold.

Equal texts are one node from the start, by a 128-bit digest.  Nodes of a bucket are compared with
its least node first, which costs one comparison for each node and settles groups of near copies
however large.  Pairs of a bucket that are still in different classes after that are compared as
well, unless their sizes rule a link out; in large buckets that happens in blocks of bounded
size.  No link between different texts of a bucket that could join two classes is left out.

Defined results: a null or empty text is the text without words, and equals every other such
text; texts of under five words have one shingle; rows that repeat are copies of each other;
a null id takes part and has its class's id, which is null only if all ids of the class are;
an empty table gives no rows; extra columns are not read by :func:`classes` and are kept by
:func:`one_of_each`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, fresh, texts

WORDS, SIMILARITY = 5, 0.8
BANDS, KMER, TUPLE = 32, 2, 4
# Unmatched shingles up to which candidates are exact.
APART, AGAIN = 8, 4
MASK = (1 << 64) - 1
WIDE_ROWS = 50_000
# The first width of the band of an alignment, and rows that are taken at once.
NARROW, ROWS = 32, 1_024
# Buckets of over FEW nodes are compared in blocks of two parts.
FEW, PART_ROWS, PART_WORDS, COLUMNS = 24, 512, 400_000, 8_192


def labelled(values: np.ndarray) -> np.ndarray:
    """Values made different by how often each came before."""
    order = np.argsort(values, kind="stable")
    same = np.r_[False, values[order[1:]] == values[order[:-1]]]
    if same.any():
        at = np.arange(len(values))
        label = at - np.maximum.accumulate(np.where(same, 0, at))
        values = values.copy()
        values[order] += label.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    return values


def word_prints(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles(prints: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Fingerprints of the labelled shingles of a text, in text order; a shorter text is one shingle."""
    n, width = len(prints), min(width, len(prints))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        own = prints[i : n - width + 1 + i]
        out = out * np.uint64(0x9E3779B97F4A7C15) + (own ^ (own >> np.uint64(31)))
    return labelled(out)


def factors() -> np.ndarray:
    """One odd factor for each band."""
    i = np.arange(1, BANDS + 1, dtype=np.uint64)
    x = i * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)


def scrambled(x: np.ndarray, factor: np.ndarray) -> np.ndarray:
    x = x * factor
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def dealt(own: list[int], apart: int, salt: int, again: int = 0) -> list[int]:
    """Buckets of which two texts share one if at most ``apart`` of their shingles are unmatched.

    An empty class says nothing of a text; in its place come the buckets of another dealing, of
    which the same holds.
    """
    parts = [salt * (apart + 1) + c + 1 for c in range(apart + 1)]
    used = [False] * (apart + 1)
    for x in own:
        y = ((x ^ salt) * 0xD6E8FEB86659FD93) & MASK
        c = ((y ^ (y >> 32)) * 0xBF58476D1CE4E5B9 & MASK) % (apart + 1)
        used[c] = True
        y = ((parts[c] ^ x) * 0x9FB21C651E98DF25) & MASK
        parts[c] = y ^ (y >> 28)
    out = []
    for key, full in zip(parts, used, strict=True):
        key = key * 0x94D049BB133111EB & MASK
        out += [key] if full or again == AGAIN or not own else dealt(own, apart, key, again + 1)
    return out


def short_buckets(own: np.ndarray) -> np.ndarray:
    """Buckets for all numbers of unmatched shingles, up to APART, that a link of the text can have."""
    n, out = len(own), []
    listed = own.tolist() if n + -(-4 * n // 5) < 9 * (APART + 1) else []
    for apart in range((n + -(-4 * n // 5)) // 9, min(APART, (n + 5 * n // 4) // 9) + 1):
        out += dealt(listed, apart, 0x2545F4914F6CDD1D + apart)
    return np.array(out, dtype=np.uint64).view(np.int64)


def bands(own: np.ndarray) -> np.ndarray:
    """The bucket of each band: a hash of the least shingles in text order."""
    take, factor = min(TUPLE, len(own)), factors()
    if len(own) <= TUPLE:
        at = np.broadcast_to(np.arange(len(own)), (BANDS, len(own)))
    elif len(own) <= WIDE_ROWS:
        at = np.sort(np.argpartition(scrambled(own[None, :], factor[:, None]), take - 1, axis=1)[:, :take], axis=1)
    else:
        at = np.stack([np.sort(np.argpartition(scrambled(own, f), take - 1)[:take]) for f in factor])
    out = factor.copy()
    for i in range(take):
        out = (out ^ own[at[:, i]]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(28)
    return out.view(np.int64)


def word_bands(prints: np.ndarray) -> np.ndarray:
    """The buckets of the bands of a text's words; none for a text of one word."""
    return bands(shingles(prints, KMER)) if len(prints) >= KMER else np.zeros(0, dtype=np.int64)


def sketch(prints: np.ndarray) -> np.ndarray:
    """The buckets of the bands, and those of exact candidates."""
    return np.r_[word_bands(prints), short_buckets(shingles(prints))]


def common_words(a: list[bytes], b: list[bytes], width: int) -> int:
    """Words that the best alignment within ``width`` of the diagonal matches.

    Bit i of a row is 0 where taking in word i of ``a`` matches one more word.  Rows are taken
    ROWS at a time over the part of ``a`` that their band reaches; below it nothing changes any
    more, above it nothing has changed yet.
    """
    low, high, bits, zeros = 0, 0, 0, 0
    for first in range(0, len(b), ROWS):
        last = min(first + ROWS, len(b))
        start, end = min(max(0, first - width), len(a)), min(len(a), last + width)
        gone = min(start, high) - low
        zeros += gone - (bits & ((1 << gone) - 1)).bit_count()
        bits >>= gone
        if end > high:
            bits |= ((1 << (end - max(high, start))) - 1) << (max(high, start) - start)
        low, high = start, max(end, high)
        full, places = (1 << (high - low)) - 1, {}
        for i in range(low, high):
            places[a[i]] = places.get(a[i], 0) | 1 << (i - low)
        get, band = places.get, (1 << (2 * width + 1)) - 1
        narrow = max(high - 1 - first, last - 1 - low) > width
        for j in range(first, last):
            if here := get(b[j], 0):
                if narrow:
                    here &= band << (j - width - low) if j - width >= low else band >> (low - j + width)
                hit = bits & here
                bits = ((bits + hit) | (bits - hit)) & full
    return zeros + (high - low) - bits.bit_count()


def linked(a: list[bytes], b: list[bytes]) -> bool:
    """Whether m / (|a| + |b| - m) is SIMILARITY or more for the m words that an alignment matches.

    With at most ``most`` words unmatched, no match lies further than that off the diagonal.
    """
    total = len(a) + len(b)
    need = next(m for m in range(int(SIMILARITY * total / (1 + SIMILARITY)), total + 1) if m >= SIMILARITY * (total - m))
    if min(len(a), len(b)) < need:
        return False
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b, need = a[head : len(a) - tail], b[head : len(b) - tail], need - head - tail
    if need <= 0:
        return True
    most = len(a) + len(b) - 2 * need
    if most < 0 or (Counter(a) & Counter(b)).total() < need:
        return False
    width = NARROW
    while True:
        if common_words(a, b, min(width, most)) >= need:
            return True
        if width >= most:
            return False
        width *= 4


def sketches(docs: DataFrame, buckets: Callable[[np.ndarray], np.ndarray] = sketch) -> DataFrame:
    """(node, n, buckets) of rows (node, text); n counts words."""
    kind = docs.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                own = [word_prints(t.encode().split()) for t in part.column(1).to_pylist()]
                rows = [buckets(s) for s in own]
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in own], pa.int64()), lists], ["node", "n", "buckets"])

    return docs.select("node", "text").mapInArrow(run, f"node {kind}, n long, buckets array<long>")


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are linked."""
    both = pairs.join(bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None  # rows come in runs of one left node
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != last:
                    last, own = a, x.encode().split()
                if linked(own, y.encode().split()):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node that each linked node is connected with; links: (a, b).

    In each round every node moves to its least neighbour, and on to where that one moves; links
    are then carried over, and those within one node go.  All tables are written to the shared
    folder, and only whether links are left comes to the driver.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = None
    while True:
        ends = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a"))
        near = cut(ends.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("up")), "near")
        moved = cut(near.join(near.select(F.col("x").alias("up"), F.col("up").alias("top")), "up").select("x", F.col("top").alias("up")), "moved")
        if labels is None:
            new = moved.select(F.col("x").alias("node"), F.col("up").alias("comp"))
        else:
            new = labels.join(moved.select(F.col("x").alias("comp"), "up"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        new = cut(new, "labels")
        a, b = (moved.select(F.col("x").alias(end), F.col("up").alias(f"up_{end}")) for end in "ab")
        onward = edges.join(a, "a").join(b, "b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
        onward = cut(onward.filter("a <> b").distinct(), "edges")
        discard(edges, near, moved, *([labels] if labels else []))
        edges, labels = onward, new
        if edges.isEmpty():
            discard(edges)
            return labels


def sized(a: str, b: str):
    """Sizes under which a link is possible at all."""
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def alike(own: list[np.ndarray]) -> np.ndarray:
    """Labelled words that each pair of texts has in common, by products of incidence matrices."""
    n = np.array([len(x) for x in own])
    _, at, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(own)), n), count > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    row, column = row[keep], place[at[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(own), len(own)), dtype=np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((len(own), COLUMNS), dtype=np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out


def block(table: pa.Table) -> pa.Table:
    """Links that join classes among the rows (part, node, comp, text) of one block."""
    part, node, comp, text = (table.column(c).to_pylist() for c in ("part", "node", "comp", "text"))
    own = [t.encode().split() for t in text]
    n, common = np.array([len(x) for x in own]), alike([labelled(word_prints(x)) for x in own])
    side, group = np.array(part), np.unique(np.array(comp, dtype=object), return_inverse=True)[1]
    likely = (common >= SIMILARITY * (n[:, None] + n[None, :] - common) - 1e-3) & (group[:, None] != group[None, :])
    if side.min() != side.max():
        likely &= side[:, None] != side[None, :]
    root = {c: c for c in comp}

    def find(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    for i, j in zip(*np.nonzero(np.triu(likely, 1)), strict=True):
        a, b = find(comp[i]), find(comp[j])
        if a != b and linked(own[i], own[j]):
            root[a] = b
            links.append((node[i], node[j]))
    return pa.table([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])


def block_links(rest: DataFrame, sizes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(a, b): links between classes in buckets of more than FEW nodes.

    The largest class of a bucket and its other nodes are each dealt to parts of a bounded size.
    A block holds a part of the largest class and one of the others, or two of the others; pairs
    within the largest class are in none, and a node of it is copied once for each part of the
    others, which are few where a bucket is mostly one class.  A block counts common words of all
    its pairs at once and aligns only pairs whose count allows a link.  Pairs are never rows, and
    no block grows with its bucket.
    """
    key, many = ["band", "bucket"], sizes.filter(F.col("size") > FEW)
    by_class = rest.join(many.select(*key), key, "left_semi").groupBy(*key, "comp").agg(F.count("*").alias("size"), F.sum("n").alias("mass"))
    largest = by_class.groupBy(*key).agg(F.max(F.struct("size", "mass", "comp")).alias("top"))
    parts = lambda size, mass: F.ceil(F.greatest(size / PART_ROWS, mass / PART_WORDS)).cast("int")
    plan = many.join(largest, key).filter(F.col("size") > F.col("top.size"))
    plan = cut(plan.select(*key, F.col("top.comp").alias("top"), parts(F.col("top.size"), F.col("top.mass")).alias("p"), parts(F.col("size") - F.col("top.size"), F.col("mass") - F.col("top.mass")).alias("q")), "block-plan")
    own = F.col("comp") == F.col("top")
    at = F.xxhash64("node", F.lit("part"))
    dealt = rest.join(plan, key).withColumn("part", F.when(own, F.pmod(at, "p")).otherwise(F.col("p") + F.pmod(at, "q")).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block_of = lambda i, j: F.struct(F.least(i, j).cast("int").alias("i"), F.greatest(i, j).cast("int").alias("j"))
    others = F.transform(upto("q"), lambda j: block_of(F.col("part"), F.col("p") + j))
    blocks = F.when(own, others).otherwise(F.concat(F.transform(upto("p"), lambda i: block_of(i, F.col("part"))), others))
    rows = dealt.select(*key, "part", "node", "comp", F.explode(blocks).alias("block")).join(bodies, "node")
    return rows.groupBy(*key, "block").applyInArrow(block, "a binary, b binary").distinct()


def linked_nodes(rows: DataFrame) -> DataFrame:
    """(node, comp) of all nodes that are linked with another; rows: (node, text), repeats allowed."""
    seen = cut(sketches(rows), "sketches")
    one = seen.groupBy("node").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    # bands count from 0; what follows them, and all buckets of texts of one word, are of band BANDS
    buckets = one.select("node", "n", F.posexplode("buckets").alias("at", "bucket"))
    buckets = buckets.select("node", "n", F.when(F.col("n") < KMER, BANDS).otherwise(F.least("at", F.lit(BANDS))).alias("band"), "bucket")
    # the least node of each bucket that has two or more; a table, so that the join can split a hot bucket
    least = buckets.groupBy("band", "bucket").agg(F.min(F.struct("node", "n")).alias("c"), F.max("node").alias("last")).filter("c.node < last")
    least = cut(least.select("band", "bucket", F.col("c.node").alias("c"), F.col("c.n").alias("cn")), "least")
    held = cut(buckets.join(least, ["band", "bucket"]), "buckets")
    discard(seen, least)
    bodies = cut(rows.join(held.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "bodies")
    stars = cut(verified(held.filter((F.col("node") != F.col("c")) & sized("n", "cn")).select(F.col("c").alias("a"), F.col("node").alias("b")).distinct(), bodies), "stars")
    first = components(stars)
    own = cut(held.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("band", "bucket", "node", "n", "comp", "c"), "classed")
    mixed = cut(own.groupBy("band", "bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band", "bucket"), "mixed-buckets")
    rest = cut(own.join(mixed, ["band", "bucket"], "left_semi").filter("node <> c").select("band", "bucket", "node", "n", "comp"), "mixed")
    sizes = cut(rest.groupBy("band", "bucket").agg(F.count("*").alias("size"), F.sum("n").alias("mass")), "sizes")
    few = rest.join(sizes.filter(F.col("size") <= FEW), ["band", "bucket"], "left_semi")
    x, y = few.alias("x"), few.alias("y")
    apart = (F.col("x.band") == F.col("y.band")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
    cross = x.join(y, apart & sized("x.n", "y.n")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    more = cut(verified(cross, bodies).union(block_links(rest, sizes, bodies)), "more-links")
    # links between classes, and classes of classes
    ends = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
    classed = cut(ends.join(first.withColumn("met", F.lit(True)), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "met"), "ends")
    a, b = (classed.select(F.col("node").alias(f"node_{end}"), F.col("comp").alias(end)) for end in "ab")
    over = components(more.select(F.col("a").alias("node_a"), F.col("b").alias("node_b")).join(a, "node_a").join(b, "node_b").select("a", "b"))
    nodes = first.union(classed.filter("met is null").select("node", "comp"))
    out = cut(nodes.join(over.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "linked")
    discard(held, bodies, stars, own, mixed, rest, sizes, more, classed, first, over)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs, id_col, text_col).withColumn("node", digest(F.col("text")))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, node) for every row: the least id of the rows that it is a near copy of."""
    rows = keyed(docs, id_col, text_col)
    linked = linked_nodes(rows)
    narrow = rows.select("doc_id", "node")
    named = cut(narrow.groupBy("node").agg(F.min("doc_id").alias("least")).join(linked, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp")), "named")
    ids = cut(named.groupBy("comp").agg(F.min("least").alias("class_id")), "class-ids")
    return narrow.join(named.join(ids, "comp").select("node", "class_id"), "node").select("doc_id", "class_id", "node")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that with the least id; all columns stay, whatever their names."""
    own = cut(classes(docs, id_col, text_col), "classes")
    keep = own.filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    key, node, least = (fresh(docs, c) for c in ("key", "node", "least"))
    stays = cut(keep.groupBy("doc_id", "class_id").agg(F.min("node").alias(node), F.count("*").alias("rows")), "stays")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    marked = docs.withColumn(key, digest(text))
    match = marked[id_col].cast("long").eqNullSafe(F.col(least)) & (F.col(key) == F.col(node))
    out = marked.join(stays.select(F.col("doc_id").alias(least), node), match, "left_semi")
    if stays.filter("rows > 1").limit(1).count():  # rows with one id and one class: one of them stays
        out = out.dropDuplicates([id_col, key])
    return out.select(*docs.columns)
