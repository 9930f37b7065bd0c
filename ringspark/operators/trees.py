"""Ancestors and sums over subtrees by pointer doubling: as many rounds as the depth has binary digits.

A tree is rows (node, parent), each node once; a parent without a row of its own is a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import held, released


def pointers(tree: DataFrame) -> DataFrame:
    """(node, up) with a row for every root as well."""
    rows = tree.select("node", F.col("parent").alias("up"))
    roots = tree.filter("parent is not null").select(F.col("parent").alias("node")).distinct().join(tree.select("node"), "node", "left_anti")
    return rows.union(roots.select("node", F.lit(None).cast(tree.schema["parent"].dataType)))


def rounds_of(rows: DataFrame) -> int:
    """After so many rounds no pointer is left: no path has more steps than there are nodes."""
    return rows.count().bit_length()


def propagate(tree: DataFrame, rewards: DataFrame) -> DataFrame:
    """(node, visits, value): rewards (node, reward) summed into every ancestor and the node itself.

    In round r a node holds what lies less than 2^r steps below it, and points 2^r steps up.  It
    adds to the node it points to, and takes that one's pointer: n rows in each round, and sums
    that are partly done before the shuffle, whatever the depth or the number of children.
    """
    given = rewards.groupBy("node").agg(F.count("*").alias("visits"), F.sum("reward").alias("value"))
    zero = F.lit(0).cast("bigint")
    rows = held(pointers(tree).join(given, "node", "left").select("node", "up", F.coalesce("visits", zero).alias("visits"), F.coalesce("value", zero).alias("value")), "subtrees")
    for _ in range(rounds_of(rows)):
        if rows.filter("up is not null").isEmpty():
            break
        below = rows.filter("up is not null and visits > 0").groupBy(F.col("up").alias("node")).agg(F.sum("visits").alias("more"), F.sum("value").alias("worth"))
        further = rows.select(F.col("node").alias("up"), F.col("up").alias("next"))
        new = rows.join(further, "up", "left").join(below, "node", "left")
        new = held(new.select("node", F.col("next").alias("up"), (F.col("visits") + F.coalesce("more", zero)).alias("visits"), (F.col("value") + F.coalesce("worth", zero)).alias("value")), "subtrees")
        released(rows)
        rows = new
    if not rows.filter("up is not null").isEmpty():
        raise ValueError("a node is its own ancestor")
    return rows.filter("visits > 0").select("node", "visits", "value")


def ancestors(tree: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, distance) of all nodes, or of those ``asked`` for; each is its own ancestor.

    In round r all ancestors less than 2^r steps up are there; those up to 2^(r+1) are found from
    them by one join with the pointers of 2^r steps.
    """
    up = held(pointers(tree), "pointers")
    found = (up if asked is None else asked).select("node", F.col("node").alias("ancestor"), F.lit(0).cast("bigint").alias("distance"))
    found = held(found.distinct(), "ancestors")
    span = 1
    for _ in range(rounds_of(up)):
        step = up.filter("up is not null").select(F.col("node").alias("ancestor"), "up")
        if step.isEmpty():
            break
        more = found.join(step, "ancestor").select("node", F.col("up").alias("ancestor"), F.col("distance") + span)
        longer = held(found.union(more), "ancestors")
        twice = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up", "left").select("node", F.col("next").alias("up"))
        twice = held(twice, "pointers")
        released(found, up)
        found, up, span = longer, twice, 2 * span
    if not up.filter("up is not null").isEmpty():
        raise ValueError("a node is its own ancestor")
    return found
