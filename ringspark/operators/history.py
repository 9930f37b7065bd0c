"""Reports over runs: running bests, samples of every n-th row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indexes import dealt
from .lineage import fresh


def running_best(rows: DataFrame, order: str, value: str, key: str | None = None) -> DataFrame:
    """Add ``best_before``: the greatest earlier value, and whether the row beats it.

    Without a key the rows are dealt by ranges of the order; each range needs the greatest value
    of the ranges before it, which is one row for each range.
    """
    if key:
        before = F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        found = rows.withColumn("best_before", before)
    else:
        part, top, earlier, own, other = fresh(rows, "range", "top", "earlier", "own", "other")
        split = dealt(rows, [], [order], part)
        tops = split.groupBy(part).agg(F.max(value).alias(top))
        bests = tops.select(F.col(part).alias(other), F.max(top).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)).alias(earlier))
        here = F.max(value).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        found = split.withColumn(own, here).join(F.broadcast(bests), F.col(part) == F.col(other)).select(*rows.columns, F.greatest(own, earlier).alias("best_before"))
    return found.withColumn("is_best", F.coalesce(F.col(value) > F.col("best_before"), F.lit(True)))


def every(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.filter(F.pmod(F.col(order), F.lit(n)) == 0)


def changed(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Rows whose value is another than that of the key's row before; the first row counts as new."""
    w = Window.partitionBy(key).orderBy(*order)
    before, place = fresh(rows, "before", "place")
    marked = rows.select("*", F.lag(value).over(w).alias(before), F.row_number().over(w).alias(place))
    return marked.filter((F.col(place) == 1) | ~F.col(value).eqNullSafe(F.col(before))).select(*rows.columns)


def epoch_loss(rows: DataFrame) -> DataFrame:
    """(epoch, loss): mean of the steps' losses; rows: (epoch, loss)."""
    return rows.groupBy("epoch").agg(F.avg("loss").alias("loss"))


def best_epoch(rows: DataFrame) -> DataFrame:
    """The epoch of highest accuracy, least error among ties; rows: (epoch, accuracy, mae)."""
    return rows.agg(F.max_by(F.struct("epoch", "accuracy", "mae"), F.struct("accuracy", (-F.col("mae")).alias("e"), (-F.col("epoch")).alias("n"))).alias("x")).select("x.*")
