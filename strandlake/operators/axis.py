"""Order along a long axis (positions on a contig) without one task a contig.

Rows go to buckets of `size` positions; windows run inside a bucket, and what crosses its
border comes from one summary row a bucket, of which a window over the contig is short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a bucket, unless the caller knows better.
SIZE = 1 << 20


def _ahead(d: DataFrame, keys: list[str], summary, carried, later: bool = False) -> DataFrame:
    """d with what `carried` makes of the earlier (or the later) buckets' summaries, as _carry."""
    rows = d.groupBy(*keys, "_b").agg(summary.alias("_s"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_b") if later else "_b").rowsBetween(Window.unboundedPreceding, -1)
    return d.join(rows.select(*keys, "_b", carried("_s").over(w).alias("_carry")), [*keys, "_b"])


def _bucketed(df: DataFrame, pos: str, size: int) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col(pos) / size))


def with_before(df: DataFrame, keys: list[str], pos: str = "pos", size: int = SIZE) -> DataFrame:
    """df with _before: the position ahead of each row's within keys; null for the first."""
    d = _ahead(_bucketed(df, pos, size), keys, F.max(pos), F.max)
    w = Window.partitionBy(*keys, "_b").orderBy(pos)
    return d.withColumn("_before", F.coalesce(F.lag(pos).over(w), "_carry")).drop("_b", "_carry")


def with_neighbours(df: DataFrame, keys: list[str], pos: str, value: str, size: float = SIZE) -> DataFrame:
    """df with _before and _after: value in the rows next to each one within keys, in order of pos, then value; null at the ends."""
    place = F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))
    d, w = _bucketed(df, pos, size), Window.partitionBy(*keys, "_b").orderBy(pos, value)
    d = d.withColumns({"_lag": F.lag(value).over(w), "_lead": F.lead(value).over(w)})
    d = _ahead(d, keys, F.max(place), F.max).withColumn("_before", F.coalesce("_lag", F.col("_carry.v"))).drop("_carry")
    d = _ahead(d, keys, F.min(place), F.min, later=True).withColumn("_after", F.coalesce("_lead", F.col("_carry.v")))
    return d.drop("_b", "_lag", "_lead", "_carry")


def with_known(df: DataFrame, keys: list[str], value: str, pos: str = "pos", size: float = SIZE) -> DataFrame:
    """df with _left and _right: the nearest value that isn't null before and behind each row within keys; positions differ."""
    w = Window.partitionBy(*keys, "_b").orderBy(pos)
    place = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    d = _bucketed(df, pos, size).withColumns({
        "_last": F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_first": F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    d = _ahead(d, keys, F.max(place), F.max).withColumn("_left", F.coalesce("_last", F.col("_carry.v"))).drop("_carry")
    d = _ahead(d, keys, F.min(place), F.min, later=True).withColumn("_right", F.coalesce("_first", F.col("_carry.v")))
    return d.drop("_b", "_last", "_first", "_carry")


def with_ordinal(df: DataFrame, keys: list[str], pos: str = "pos", size: int = SIZE) -> DataFrame:
    """df with _ordinal: the row's number within keys by position, from 0; positions differ."""
    d = _ahead(_bucketed(df, pos, size), keys, F.count("*"), F.sum)
    w = Window.partitionBy(*keys, "_b").orderBy(pos)
    return d.withColumn("_ordinal", F.coalesce("_carry", F.lit(0)) + F.row_number().over(w) - 1).drop("_b", "_carry")


def with_island(df: DataFrame, keys: list[str], gap: int, pos: str = "pos", size: int = SIZE, value: str | None = None) -> DataFrame:
    """df with _island: the first position (or value there) of the run with gaps up to `gap` that holds the row."""
    d = with_before(df, keys, pos, size)
    start = F.when(F.col("_before").isNull() | (F.col(pos) - F.col("_before") > gap), F.struct(F.col(pos).alias("p"), F.col(value or pos).alias("v")))
    d = _ahead(_bucketed(d.withColumn("_start", start), pos, size), keys, F.max("_start"), F.max)
    w = Window.partitionBy(*keys, "_b").orderBy(pos).rangeBetween(Window.unboundedPreceding, 0)  # rows at one position together
    found = F.coalesce(F.max("_start").over(w), "_carry").getField("v")
    return d.withColumn("_island", found).drop("_b", "_carry", "_start", "_before")
