"""Places of rows in a sorted order without a task that holds a whole group.

Rows are range-sorted; each range numbers its own rows, and starts after the rows of its group in
the ranges before it.  Only the counts of (group, range) are brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import fresh, held


def dealt(rows: DataFrame, keys: list[str], order: list[str], part: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with the number of their range in the order of keys and order columns."""
    columns = [F.col(c) for c in [*keys, *order]]
    dealt_ = rows.repartitionByRange(*([ranges] if ranges else []), *columns)
    return held(dealt_.withColumn(part, F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, keys: list[str], order: list[str], place: str = "idx", total: str | None = None, weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """Add the place of each row, from 0, among those with the same keys in the order given.

    total: a column for the number of these rows.  weight: a column of whole numbers; the place is
    then the sum of the weights before the row.  Rows that are equal in the order come in any.
    """
    part, own, before, all_ = fresh(rows, "range", "own", "before", "all")
    split = dealt(rows, keys, order, part, ranges)
    size = F.sum(weight) if weight else F.count("*")
    counts = split.groupBy(*keys, part).agg(size.alias(own))
    inside = Window.partitionBy(*keys).orderBy(part)
    offsets = counts.select(*keys, part, (F.sum(own).over(inside) - F.col(own)).alias(before), F.sum(own).over(Window.partitionBy(*keys)).alias(all_))
    w = Window.partitionBy(*keys, part).orderBy(*order)
    here = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) if weight else F.row_number().over(w) - 1
    joined = split.withColumn(own, here)
    same = [joined[k].eqNullSafe(offsets[k]) for k in keys]
    on = joined[part] == offsets[part]
    for x in same:
        on &= x
    found = joined.join(offsets, on).select(*(joined[c] for c in rows.columns), (joined[own] + offsets[before]).cast("bigint").alias(place), *([offsets[all_].cast("bigint").alias(total)] if total else []))
    return found


def dense(vertices: DataFrame, ranges: int | None = None) -> DataFrame:
    """(graph_id, node_id, idx, n): place of each vertex among the sorted ids of its graph."""
    return numbered(vertices.select("graph_id", "node_id"), ["graph_id"], ["node_id"], "idx", "n", ranges=ranges)


def smallest_free(vertices: DataFrame, ranges: int | None = None) -> DataFrame:
    """(graph_id, free): the least number from 0 that is no vertex; graphs without any id from 0 on are left out.

    Ids run 0, 1, 2, ... up to the first gap, so it is the first place whose id is another.
    """
    rows = numbered(vertices.filter("node_id >= 0").select("graph_id", "node_id").distinct(), ["graph_id"], ["node_id"], ranges=ranges)
    return rows.groupBy("graph_id").agg(F.coalesce(F.min(F.when(F.col("node_id") != F.col("idx"), F.col("idx"))), F.count("*")).cast("bigint").alias("free"))
