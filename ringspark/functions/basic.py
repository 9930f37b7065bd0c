"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Python's strip() removes, ASCII part; trim() alone removes blanks only.
WHITE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def strict_int(token: Column) -> Column:
    """Whole numbers with an optional sign; anything else, and what exceeds 64 bits, is null."""
    return F.when(token.rlike(r"^[+-]?[0-9]+$"), token.try_cast("bigint"))


def lenient_int(token: Column) -> Column:
    """The number that a token begins with, null if there is none."""
    return F.regexp_extract(token, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def round_half_even_nonnegative(c: Column) -> Column:
    return F.greatest(F.rint(c), F.lit(0.0))


def finite(c: Column) -> Column:
    """Infinity as null."""
    return F.when(c != F.lit(float("inf")), c)


def duration(seconds: Column) -> Column:
    """Under a second in ms, under a minute in s, else minutes and seconds."""
    whole = F.floor(seconds)
    return (
        F.when(seconds < 1, F.concat(F.round(seconds * 1000).cast("long").cast("string"), F.lit("ms")))
        .when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s")))
        .otherwise(F.concat((whole / 60).cast("long").cast("string"), F.lit("m "), (whole % 60).cast("long").cast("string"), F.lit("s")))
    )


def default(values: Column, key: str, otherwise) -> Column:
    """A map entry, or the default where it is missing."""
    return F.coalesce(F.try_element_at(values, F.lit(key)), F.lit(otherwise))


def short(c: Column, n: int = 8) -> Column:
    """The first characters of an id, as logs show it."""
    return F.substring(c, 1, n)


def same_text(c: Column, other: str) -> Column:
    """Equality that ignores the case of letters."""
    return F.lower(c) == other.lower()


def new_id() -> Column:
    """A new random id for each row; another one in every run."""
    return F.expr("uuid()")


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two moments, with fractions."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000


def percentage(c: Column, low: float, high: float) -> Column:
    """Where a value lies between two others, 0 to 100; what is outside counts as the border."""
    return 100.0 * (F.least(F.greatest(c, F.lit(low)), F.lit(high)) - low) / (high - low)


def camel(rows: DataFrame) -> DataFrame:
    """The rows with names like nodeId in place of node_id."""
    return rows.select(*(F.col(c).alias(c.split("_")[0] + "".join(x.title() for x in c.split("_")[1:])) for c in rows.columns))
