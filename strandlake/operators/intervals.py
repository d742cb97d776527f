"""Interval operators; intervals are closed and 1-based, [lo, hi].

Overlap joins put each interval under every bucket of positions that it touches and join on
the bucket, so that the work spreads over (key, bucket) instead of a contig at a time.
Unions merge inside buckets first, and then what touches a bucket's border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .axis import SIZE


def _buckets(lo: Column, hi: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Pairs of overlapping rows; right's lo and hi come out as r_lo and r_hi.

    A pair that shares several buckets comes out of the first one only.
    """
    r = right.withColumnsRenamed({"lo": "r_lo", "hi": "r_hi"})
    lb = left.withColumn("_bucket", _buckets(F.col("lo"), F.col("hi"), size))
    rb = r.withColumn("_bucket", _buckets(F.col("r_lo"), F.col("r_hi"), size))
    hit = lb.join(rb, [*keys, "_bucket"]).filter((F.col("lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("hi")))
    first = F.floor(F.greatest("lo", "r_lo") / size)
    return hit.filter(F.col("_bucket") == first).drop("_bucket")


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], size: int, pos: str = "pos") -> DataFrame:
    """points with the columns of each interval that holds them; a point in none has nulls there."""
    i = intervals.withColumn("_bucket", _buckets(F.col("lo"), F.col("hi"), size))
    p = points.withColumn("_bucket", F.floor(F.col(pos) / size))
    ip, kp = i.alias("i"), p.alias("p")
    on = F.col(f"p.{pos}").between(F.col("i.lo"), F.col("i.hi")) & (F.col("p._bucket") == F.col("i._bucket"))
    for k in keys:
        on &= F.col(f"p.{k}") == F.col(f"i.{k}")
    rest = [F.col(f"i.{c}") for c in intervals.columns if c not in keys]
    return kp.join(ip, on, "left").select(*[F.col(f"p.{c}") for c in points.columns], *rest)


def _clipped(intervals: DataFrame, size: int) -> DataFrame:
    """Each interval once a bucket that it touches (_b), cut at the borders."""
    d = intervals.withColumn("_b", _buckets(F.col("lo"), F.col("hi"), size))
    return d.withColumns({"lo": F.greatest("lo", F.col("_b") * size), "hi": F.least("hi", F.col("_b") * size + (size - 1))})


def _merged(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps and islands within keys; adjacent intervals merge."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = intervals.select(*keys, "lo", "hi").withColumn("_new", F.when(F.col("lo") <= reach + 1, 0).otherwise(1))
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def union(intervals: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Merged intervals of each key; adjacent ones (lo = hi + 1) merge too."""
    d = _merged(_clipped(intervals.select(*keys, "lo", "hi"), size), [*keys, "_b"])
    border = (F.col("lo") == F.col("_b") * size) | (F.col("hi") == F.col("_b") * size + (size - 1))
    # at most two of each bucket touch its borders
    return d.filter(~border).drop("_b").unionByName(_merged(d.filter(border), keys))


def in_mask(points: DataFrame, mask: DataFrame, keys: list[str], size: int, pos: str = "pos") -> DataFrame:
    """points with in_mask; mask intervals may nest and overlap."""
    merged = union(mask, keys, size)
    return point_in_interval(points, merged, keys, size, pos).withColumn("in_mask", F.col("lo").isNotNull()).drop("lo", "hi")


def intersection(a: DataFrame, b: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Intersections of the two unions."""
    j = overlap_join(union(a, keys, size), union(b, keys, size), keys, size)
    return j.select(*keys, F.greatest("lo", "r_lo").alias("lo"), F.least("hi", "r_hi").alias("hi"))


def total(intervals: DataFrame, keys: list[str], name: str) -> DataFrame:
    return intervals.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias(name))


def geometry(a: DataFrame, b: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Per key: bp of a's union, of b's, of both, and the shared fraction of each (null for nothing)."""
    d = total(union(a, keys, size), keys, "a_bp").join(total(union(b, keys, size), keys, "b_bp"), keys, "full").join(total(intersection(a, b, keys, size), keys, "both_bp"), keys, "left")
    d = d.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("a_bp", "b_bp", "both_bp")])
    return d.withColumns({"of_a": F.try_divide("both_bp", "a_bp"), "of_b": F.try_divide("both_bp", "b_bp")})


def labelled_union(intervals: DataFrame, keys: list[str], label: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(union by label, overlaps of different labels: the conflicts that make it invalid)."""
    u = union(intervals, [*keys, label], size)
    r = u.withColumnRenamed(label, "other")
    clash = overlap_join(u, r, keys, size).filter(F.col(label) < F.col("other"))
    return u, clash.select(*keys, label, "other", F.greatest("lo", "r_lo").alias("lo"), F.least("hi", "r_hi").alias("hi"))


def complement(intervals: DataFrame, bounds: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """What the union leaves of each key's bounds (lo, hi)."""
    cell = [*keys, "_b"]
    b = _clipped(bounds.select(*keys, "lo", "hi"), size).select(*cell, F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    u = _merged(_clipped(intervals.select(*keys, "lo", "hi"), size), cell).join(b, cell).filter("hi >= b_lo and lo <= b_hi")
    w = Window.partitionBy(*cell).orderBy("lo")
    before = u.select(*cell, F.coalesce(F.lag("hi").over(w) + 1, F.col("b_lo")).alias("lo"), (F.col("lo") - 1).alias("hi"))
    end = u.groupBy(*cell).agg((F.max("hi") + 1).alias("lo"), F.first("b_hi").alias("hi"))
    empty = b.join(u, cell, "left_anti").select(*cell, F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"))
    return union(before.unionByName(end).unionByName(empty).filter("lo <= hi"), keys, size)


def set_overlap(a: DataFrame, b: DataFrame, keys: list[str], size: int) -> DataFrame:
    """geometry() with fractions 1.0 for an empty side, and the Jaccard index of exact records."""
    g = geometry(a, b, keys, size).withColumns({"of_a": F.coalesce("of_a", F.lit(1.0)), "of_b": F.coalesce("of_b", F.lit(1.0))})
    both = a.select(*keys, "lo", "hi").distinct().withColumn("_a", F.lit(1)).join(b.select(*keys, "lo", "hi").distinct().withColumn("_b", F.lit(1)), [*keys, "lo", "hi"], "full")
    j = both.groupBy(*keys).agg((F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count("*")).alias("record_jaccard"))
    return g.join(j, keys)


def overlay(a: DataFrame, b: DataFrame, keys: list[str], label: str, size: int) -> DataFrame:
    """bp by state over the overlaps of two labelled partitions: unobserved (a null label) before ambiguous ('?') before match or mismatch."""
    j = overlap_join(a, b.withColumnRenamed(label, "_other"), keys, size)
    one, two = F.col(label), F.col("_other")
    state = F.when(one.isNull() | two.isNull(), "unobserved").when((one == "?") | (two == "?"), "ambiguous").when(one == two, "match").otherwise("mismatch")
    return j.groupBy(*keys, state.alias("state")).agg(F.sum(F.least("hi", "r_hi") - F.greatest("lo", "r_lo") + 1).alias("bp"))


def edge_sweep(edges: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """edges: lo, hi and edge (0 to 3: haplotype pairs 11, 12, 21, 22). bp by number and kind of active edges.

    One event where an edge starts and one behind its end; running sums tell which edges are
    active between neighbouring positions, however many records an edge has there. Edges are
    cut at bucket borders, so a window is a bucket.
    """
    edges, by, keys = _clipped(edges.select(*keys, "lo", "hi", "edge"), size), keys, [*keys, "_b"]
    w = Window.partitionBy(*keys).orderBy("at")
    up = edges.select(*keys, F.col("lo").alias("at"), "edge", F.lit(1).alias("d"))
    down = edges.select(*keys, (F.col("hi") + 1).alias("at"), "edge", F.lit(-1).alias("d"))
    e = up.unionByName(down).groupBy(*keys, "at").agg(*[F.sum(F.when(F.col("edge") == k, F.col("d")).otherwise(0)).alias(f"d{k}") for k in range(4)])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.select(*keys, "at", F.lead("at").over(w).alias("next"), *[(F.sum(f"d{k}").over(run) > 0).alias(f"on{k}") for k in range(4)])
    n = sum((F.col(f"on{k}").cast("int") for k in range(1, 4)), F.col("on0").cast("int"))
    disjoint = (F.col("on0") & F.col("on3")) | (F.col("on1") & F.col("on2"))
    pattern = F.when(n == 1, "1").when((n == 2) & disjoint, "2_disjoint").when(n == 2, "2_shared").when(n == 3, "3").when(n == 4, "4")
    return e.filter(F.col("next").isNotNull() & (n > 0)).groupBy(*by, pattern.alias("pattern")).agg(F.sum(F.col("next") - F.col("at")).alias("bp"))


def interpolate(points: DataFrame, curve: DataFrame, keys: list[str], x: str, y: str, size: int) -> DataFrame:
    """points (x) with y by linear interpolation between the curve's knots (x, y); null outside them."""
    w = Window.partitionBy(*keys).orderBy(x)
    spans = curve.select(*keys, F.col(x).alias("lo"), F.col(y).alias("y0"), F.lead(x).over(w).alias("hi"), F.lead(y).over(w).alias("y1"))
    last = curve.groupBy(*keys).agg(F.max(x).alias("_end"))
    s = spans.filter("hi is not null").join(last, keys).withColumn("_at_end", F.col("hi") == F.col("_end"))
    # half-open spans, the last one closed: no point falls in two
    j = point_in_interval(points, s.withColumn("_hi", F.col("hi")).withColumn("hi", F.when(F.col("_at_end"), F.col("hi")).otherwise(F.col("hi") - 1)), keys, size, pos=x)
    value = F.col("y0") + (F.col(x) - F.col("lo")) * (F.col("y1") - F.col("y0")) / (F.col("_hi") - F.col("lo"))
    return j.select(*points.columns, value.alias(y))


def clip(intervals: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """intervals with clip_lo, clip_hi and status: FULL_MAP, CLIPPED or OUTSIDE_MAP (then null ends)."""
    b = bounds.select(*keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    d = intervals.join(b, keys, "left")
    a, z = F.greatest("lo", "_lo"), F.least("hi", "_hi")
    inside = F.coalesce(a <= z, F.lit(False)) & F.col("_lo").isNotNull()
    status = F.when(~inside, "OUTSIDE_MAP").when((a == F.col("lo")) & (z == F.col("hi")), "FULL_MAP").otherwise("CLIPPED")
    return d.select(*intervals.columns, F.when(inside, a).alias("clip_lo"), F.when(inside, z).alias("clip_hi"), status.alias("status"))


def clip_length(clipped: DataFrame, curve: DataFrame, keys: list[str], size: int) -> DataFrame:
    """clip()'s rows with length_cm between the clipped ends on the curve (pos, cm); null outside."""
    d = clipped
    for end in ("clip_lo", "clip_hi"):
        ends = clipped.filter(F.col(end).isNotNull()).select(*keys, F.col(end).alias("pos")).distinct()
        found = interpolate(ends, curve.withColumnRenamed("cm", f"_{end}"), keys, "pos", f"_{end}", size).withColumnRenamed("pos", end)
        d = d.join(found, [*keys, end], "left")
    return d.withColumn("length_cm", F.col("_clip_hi") - F.col("_clip_lo")).drop("_clip_lo", "_clip_hi")
