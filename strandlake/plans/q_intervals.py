"""Queries of the interval operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from . import domain as D

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


DAYS = 32


def _sql_union(name: str, source: str, keys: str) -> str:
    return f"""{name}_b AS (SELECT {keys}, lo, hi, CASE WHEN lo <= max(hi) OVER (PARTITION BY {keys} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM {source}),
{name}_c AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM {name}_b),
{name} AS (SELECT {keys}, min(lo) AS lo, max(hi) AS hi FROM {name}_c GROUP BY {keys}, island)"""


RAW = f"WITH {D.INTERVALS}, ra AS (SELECT contig, lo, hi FROM iv WHERE label = 'A'), rr AS (SELECT contig, lo, hi FROM iv WHERE label = 'R')"
BOTH = RAW + ", " + _sql_union("ua", "ra", "contig") + ", " + _sql_union("ur", "rr", "contig") + """,
x AS (SELECT ua.contig, greatest(ua.lo, ur.lo) AS lo, least(ua.hi, ur.hi) AS hi FROM ua JOIN ur ON ua.contig = ur.contig AND ua.lo <= ur.hi AND ur.lo <= ua.hi),
t AS (SELECT contig, sum(hi - lo + 1)::BIGINT AS a_bp FROM ua GROUP BY contig), u AS (SELECT contig, sum(hi - lo + 1)::BIGINT AS b_bp FROM ur GROUP BY contig),
v AS (SELECT contig, sum(hi - lo + 1)::BIGINT AS both_bp FROM x GROUP BY contig),
g AS (SELECT coalesce(t.contig, u.contig) AS contig, coalesce(a_bp, 0) AS a_bp, coalesce(b_bp, 0) AS b_bp, coalesce(both_bp, 0) AS both_bp
  FROM t FULL JOIN u ON t.contig = u.contig LEFT JOIN v ON v.contig = coalesce(t.contig, u.contig))"""


def side(s, d, label):
    return D.intervals(s, d).filter(F.col("label") == label).select("contig", "lo", "hi")


@query("WITH " + D.INTERVALS + ", ra AS (SELECT contig, lo, hi FROM iv), " + _sql_union("u", "ra", "contig") + " SELECT contig, lo, hi FROM u")
def interval_union(s, d):
    return I.union(D.intervals(s, d), ["contig"], 365)


@query(BOTH + " SELECT contig, a_bp, b_bp, both_bp, both_bp / nullif(a_bp, 0) AS of_a, both_bp / nullif(b_bp, 0) AS of_b FROM g")
def interval_geometry(s, d):
    return I.geometry(side(s, d, "A"), side(s, d, "R"), ["contig"], DAYS)


@query(f"""WITH {D.INTERVALS}, a AS (SELECT * FROM iv WHERE label = 'A'), b AS (SELECT contig, lo AS r_lo, hi AS r_hi, record AS r_record, part AS r_part FROM iv WHERE label = 'R')
SELECT a.contig, record, part, lo, hi, r_record, r_part, r_lo, r_hi FROM a JOIN b ON a.contig = b.contig AND lo <= r_hi AND r_lo <= hi""")
def interval_overlap(s, d):
    v = D.intervals(s, d)
    a = v.filter("label = 'A'").drop("label")
    b = v.filter("label = 'R'").select("contig", "lo", "hi", F.col("record").alias("r_record"), F.col("part").alias("r_part"))
    return I.overlap_join(a, b, ["contig"], DAYS)


POINTS = "pt AS (SELECT o_orderkey AS id, o_custkey % 100 AS contig, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS pos FROM orders)"


def points(s, d):
    return D.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("contig"), F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long").alias("pos"))


@query(f"""{RAW}, {POINTS}, {_sql_union('u', 'ra', 'contig')} SELECT id, pt.contig, pos, u.lo, u.hi FROM pt LEFT JOIN u ON u.contig = pt.contig AND pos BETWEEN u.lo AND u.hi""")
def point_in_interval(s, d):
    return I.point_in_interval(points(s, d), I.union(side(s, d, "A"), ["contig"], 365), ["contig"], DAYS)


@query(f"""{RAW}, {POINTS} SELECT id, contig, pos, EXISTS (SELECT 1 FROM rr WHERE rr.contig = pt.contig AND pos BETWEEN lo AND hi) AS in_mask FROM pt""")
def in_mask(s, d):
    return I.in_mask(points(s, d), side(s, d, "R"), ["contig"], DAYS)


@query(f"""WITH {D.INTERVALS}, {_sql_union('u', 'iv', 'contig, label')}
SELECT a.contig, a.label, b.label AS other, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi
FROM u a JOIN u b ON a.contig = b.contig AND a.label < b.label AND a.lo <= b.hi AND b.lo <= a.hi""")
def labelled_conflicts(s, d):
    return I.labelled_union(D.intervals(s, d), ["contig"], "label", DAYS)[1]


@query(f"""{RAW}, bounds AS (SELECT contig, min(lo) - 10 AS b_lo, max(hi) + 10 AS b_hi FROM iv GROUP BY contig), {_sql_union('u', 'ra', 'contig')},
w AS (SELECT contig, coalesce(lag(hi) OVER (PARTITION BY contig ORDER BY lo) + 1, b_lo) AS lo, lo - 1 AS hi FROM u JOIN bounds USING (contig)
  UNION ALL SELECT contig, max(hi) + 1, first(b_hi) FROM u JOIN bounds USING (contig) GROUP BY contig
  UNION ALL SELECT contig, b_lo, b_hi FROM bounds WHERE contig NOT IN (SELECT contig FROM u))
SELECT contig, lo, hi FROM w WHERE lo <= hi""")
def interval_complement(s, d):
    bounds = D.intervals(s, d).groupBy("contig").agg((F.min("lo") - 10).alias("lo"), (F.max("hi") + 10).alias("hi"))
    return I.complement(side(s, d, "A"), bounds, ["contig"], 365)


@query(BOTH + """, da AS (SELECT DISTINCT * FROM ra), dr AS (SELECT DISTINCT * FROM rr),
j AS (SELECT coalesce(da.contig, dr.contig) AS contig, count(*) FILTER (WHERE da.contig IS NOT NULL AND dr.contig IS NOT NULL) / count(*) AS record_jaccard
  FROM da FULL JOIN dr ON da.contig = dr.contig AND da.lo = dr.lo AND da.hi = dr.hi GROUP BY 1)
SELECT g.contig, a_bp, b_bp, both_bp, coalesce(both_bp / nullif(a_bp, 0), 1.0) AS of_a, coalesce(both_bp / nullif(b_bp, 0), 1.0) AS of_b, record_jaccard FROM g JOIN j USING (contig)""")
def segment_set_overlap(s, d):
    return I.set_overlap(side(s, d, "A"), side(s, d, "R"), ["contig"], DAYS)


@query(f"""WITH p AS (SELECT l_suppkey AS contig, l_linenumber AS line, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day, l_returnflag AS f FROM lineitem),
q AS (SELECT contig, line % 2 AS side, day, min(f) AS f FROM p GROUP BY ALL),
t AS (SELECT contig, side, day AS lo, coalesce(lead(day) OVER (PARTITION BY contig, side ORDER BY day) - 1, day) AS hi, CASE WHEN f = 'A' THEN NULL WHEN f = 'N' AND day % 3 = 0 THEN '?' ELSE f END AS label FROM q)
SELECT a.contig, CASE WHEN a.label IS NULL OR b.label IS NULL THEN 'unobserved' WHEN a.label = '?' OR b.label = '?' THEN 'ambiguous' WHEN a.label = b.label THEN 'match' ELSE 'mismatch' END AS state,
  sum(least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1)::BIGINT AS bp
FROM t a JOIN t b ON a.contig = b.contig AND a.side = 0 AND b.side = 1 AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL""")
def partition_overlay(s, d):
    from pyspark.sql import Window

    p = D.table(s, d, "lineitem").select(F.col("l_suppkey").alias("contig"), (F.col("l_linenumber") % 2).alias("side"), F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long").alias("day"), F.col("l_returnflag").alias("f"))
    q = p.groupBy("contig", "side", "day").agg(F.min("f").alias("f"))
    w = Window.partitionBy("contig", "side").orderBy("day")
    label = F.when(F.col("f") == "A", None).when((F.col("f") == "N") & (F.col("day") % 3 == 0), "?").otherwise(F.col("f"))
    t = q.select("contig", "side", F.col("day").alias("lo"), F.coalesce(F.lead("day").over(w) - 1, F.col("day")).alias("hi"), label.alias("label"))
    return I.overlay(t.filter("side = 0").drop("side"), t.filter("side = 1").drop("side"), ["contig"], "label", DAYS)


@query(f"""WITH {D.INTERVALS}, e AS (SELECT contig, lo AS x, part % 4 AS edge, 1 AS d FROM iv UNION ALL SELECT contig, hi + 1, part % 4, -1 FROM iv),
c AS (SELECT contig, x, sum(d) FILTER (WHERE edge = 0) AS d0, sum(d) FILTER (WHERE edge = 1) AS d1, sum(d) FILTER (WHERE edge = 2) AS d2, sum(d) FILTER (WHERE edge = 3) AS d3 FROM e GROUP BY ALL),
r AS (SELECT contig, x, lead(x) OVER w AS nxt, coalesce(sum(d0) OVER w > 0, false) AS a, coalesce(sum(d1) OVER w > 0, false) AS b, coalesce(sum(d2) OVER w > 0, false) AS c, coalesce(sum(d3) OVER w > 0, false) AS d
  FROM c WINDOW w AS (PARTITION BY contig ORDER BY x)),
n AS (SELECT *, a::INT + b::INT + c::INT + d::INT AS n FROM r)
SELECT contig, CASE WHEN n = 1 THEN '1' WHEN n = 2 AND ((a AND d) OR (b AND c)) THEN '2_disjoint' WHEN n = 2 THEN '2_shared' WHEN n = 3 THEN '3' ELSE '4' END AS pattern, sum(nxt - x)::BIGINT AS bp
FROM n WHERE nxt IS NOT NULL AND n > 0 GROUP BY ALL""")
def edge_sweep(s, d):
    v = D.intervals(s, d).select("contig", "lo", "hi", (F.col("part") % 4).alias("edge"))
    return I.edge_sweep(v, ["contig"], 365)


# Genetic map: parts in order on five chromosomes, cM the running sum of sizes over 1000.
MAP = """map AS (SELECT p_partkey % 5 + 1 AS chrom, p_partkey * 1000 AS pos,
  sum(p_size) OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) / 1000 AS cm FROM part)"""


def genetic_map(s, d):
    from pyspark.sql import Window

    p = D.table(s, d, "part")
    w = Window.partitionBy(F.col("p_partkey") % 5).orderBy("p_partkey")
    return p.select((F.col("p_partkey") % 5 + 1).alias("chrom"), (F.col("p_partkey") * 1000).alias("pos"), (F.sum("p_size").over(w) / 1000).alias("cm"))


QUERIES = "q AS (SELECT o_orderkey AS id, o_orderkey % 5 + 1 AS chrom, (o_orderkey * 7919) % 2200000 - 50000 AS pos FROM orders)"


def map_points(s, d):
    k = F.col("o_orderkey")
    return D.table(s, d, "orders").select(k.alias("id"), (k % 5 + 1).alias("chrom"), ((k * 7919) % 2_200_000 - 50_000).alias("pos"))


SPANS = "sp AS (SELECT chrom, pos AS x0, cm AS y0, lead(pos) OVER w AS x1, lead(cm) OVER w AS y1, max(pos) OVER (PARTITION BY chrom) AS xe FROM map WINDOW w AS (PARTITION BY chrom ORDER BY pos))"


@query(f"""WITH {MAP}, {SPANS}, {QUERIES}
SELECT id, q.chrom, q.pos, round(y0 + (q.pos - x0) * (y1 - y0) / (x1 - x0), 9) AS cm
FROM q LEFT JOIN sp ON sp.chrom = q.chrom AND x1 IS NOT NULL AND q.pos >= x0 AND (q.pos < x1 OR (q.pos = x1 AND x1 = xe))""")
def interpolate_cm(s, d):
    out = I.interpolate(map_points(s, d), genetic_map(s, d), ["chrom"], "pos", "cm", 20_000)
    return out.withColumn("cm", F.round("cm", 9))


@query(f"""WITH {D.INTERVALS}, b AS (SELECT contig, min(lo) + 200 AS b_lo, max(hi) - 200 AS b_hi FROM iv WHERE contig % 7 <> 0 GROUP BY contig),
c AS (SELECT iv.contig, record, part, lo, hi, greatest(lo, b_lo) AS a, least(hi, b_hi) AS z, b_lo FROM iv LEFT JOIN b USING (contig))
SELECT contig, record, part, lo, hi, CASE WHEN b_lo IS NOT NULL AND a <= z THEN a END AS clip_lo, CASE WHEN b_lo IS NOT NULL AND a <= z THEN z END AS clip_hi,
  CASE WHEN b_lo IS NULL OR a > z THEN 'OUTSIDE_MAP' WHEN a = lo AND z = hi THEN 'FULL_MAP' ELSE 'CLIPPED' END AS status FROM c""")
def clip_to_map(s, d):
    v = D.intervals(s, d).drop("label")
    b = v.filter("contig % 7 <> 0").groupBy("contig").agg((F.min("lo") + 200).alias("lo"), (F.max("hi") - 200).alias("hi"))
    return I.clip(v, b, ["contig"]).select("contig", "record", "part", "lo", "hi", "clip_lo", "clip_hi", "status")
