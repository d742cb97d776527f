"""Queries of ancestry, map, catalogue and relatedness operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ancestry as A
from ..operators import graph as G
from . import domain as D
from .lineage import cut
from .q_graph import EDGES, edges, labels, nodes
from .q_intervals import MAP, genetic_map, map_points
from .q_pairs import summary
from .q_stats import CUST, customers

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


# Painting: 100 kb segments of two codes each, from person, chromosome and segment; every 17th is not painted.
PAINT = f"""WITH {D.GENO}, cp AS (SELECT * FROM geno WHERE dosage > 0),
pt AS (SELECT DISTINCT sample_id, chrom, pos // 100000 * 100000 AS lo, pos // 100000 * 100000 + 99999 AS hi, (sample_id + chrom + pos // 100000) % 3 AS c0, (sample_id * 2 + pos // 100000) % 3 AS c1 FROM geno WHERE (sample_id + pos // 100000) % 17 <> 0),
at AS (SELECT c.sample_id, c.chrom, c.pos, dosage, coalesce(c0 IS NOT NULL AND (dosage = 2 OR c0 = c1), false) AS exact, c0, c1 FROM cp c LEFT JOIN pt ON pt.sample_id = c.sample_id AND pt.chrom = c.chrom AND c.pos BETWEEN lo AND hi),
ax AS (SELECT sample_id, chrom, pos, dosage, exact, -1 AS code, dosage::DOUBLE AS share FROM at WHERE c0 IS NULL UNION ALL SELECT sample_id, chrom, pos, dosage, exact, c0, dosage / 2 FROM at WHERE c0 IS NOT NULL UNION ALL SELECT sample_id, chrom, pos, dosage, exact, c1, dosage / 2 FROM at WHERE c0 IS NOT NULL)""".replace("at AS (", "att AS (").replace("FROM at ", "FROM att ")


def painting(s, d):
    k = F.floor(F.col("pos") / 100_000)
    g = D.genotypes(s, d).filter((F.col("sample_id") + k) % 17 != 0)
    return g.select("sample_id", "chrom", (k * 100_000).alias("lo"), (k * 100_000 + 99_999).alias("hi"), ((F.col("sample_id") + F.col("chrom") + k) % 3).alias("c0"), ((F.col("sample_id") * 2 + k) % 3).alias("c1")).distinct()


def attributed(s, d):
    c = D.genotypes(s, d).filter("dosage > 0")
    return A.copies_in_ancestry(c, painting(s, d), 100_000)


@query(PAINT + " SELECT code::BIGINT AS code, exact, count(*) AS n, sum(share) AS copies FROM ax GROUP BY ALL")
def copies_in_ancestry(s, d):
    return attributed(s, d).groupBy("code", "exact").agg(F.count("*").alias("n"), F.sum("share").alias("copies"))


def _enrich(keys: str) -> str:
    k, on = (f"{keys}, ", f"USING ({keys}, code)") if keys else ("", "USING (code)")
    part = f"PARTITION BY {keys}" if keys else ""
    return f""", o AS (SELECT {k}code, sum(share) AS observed FROM ax WHERE code >= 0 GROUP BY ALL), p AS (SELECT {k}code, sum(bp) AS bp FROM (SELECT chrom, c0 AS code, hi - lo + 1 AS bp FROM pt UNION ALL SELECT chrom, c1, hi - lo + 1 FROM pt) GROUP BY ALL),
j AS (SELECT {k}code, coalesce(observed, 0) AS observed, bp, sum(observed) OVER ({part}) AS total, sum(bp) OVER ({part}) AS all_bp FROM p LEFT JOIN o {on})
SELECT {k}code, observed, round(total * bp / all_bp, 6) AS expected, round(observed / nullif(total * bp / all_bp, 0), 6) AS ratio FROM j"""


@query(PAINT + _enrich("chrom"))
def rare_in_ancestry(s, d):
    return A.ancestry_enrichment(attributed(s, d), painting(s, d), ["chrom"]).withColumns({"expected": F.round("expected", 6), "ratio": F.round("ratio", 6)})


@query(PAINT + _enrich(""))
def rare_in_ancestry_genome(s, d):
    return A.ancestry_enrichment(attributed(s, d), painting(s, d), []).withColumns({"expected": F.round("expected", 6), "ratio": F.round("ratio", 6)})


@query(f"""WITH {MAP}, q AS (SELECT o_orderkey AS id, o_orderkey % 5 + 1 AS chrom, (o_orderkey % 997) / 50 AS cm FROM orders), k AS (SELECT chrom, cm, min(pos) AS a, max(pos) AS z FROM map GROUP BY ALL),
w AS (SELECT *, lead(cm) OVER v AS nc, lead(a) OVER v AS na FROM k WINDOW v AS (PARTITION BY chrom ORDER BY cm))
SELECT id, q.chrom, q.cm, round(CASE WHEN round(q.cm * 1000000) = round(w.cm * 1000000) THEN a ELSE z + (round(q.cm * 1000000) - round(w.cm * 1000000)) * (na - z) / (round(nc * 1000000) - round(w.cm * 1000000)) END, 3) AS lo_pos,
  round(CASE WHEN round(q.cm * 1000000) = round(w.cm * 1000000) THEN z ELSE z + (round(q.cm * 1000000) - round(w.cm * 1000000)) * (na - z) / (round(nc * 1000000) - round(w.cm * 1000000)) END, 3) AS hi_pos
FROM q LEFT JOIN w ON w.chrom = q.chrom AND (round(q.cm * 1000000) = round(w.cm * 1000000) OR (round(q.cm * 1000000) > round(w.cm * 1000000) AND round(q.cm * 1000000) < round(nc * 1000000)))""")
def inverse_cm(s, d):
    k = F.col("o_orderkey")
    p = D.table(s, d, "orders").select(k.alias("id"), (k % 5 + 1).alias("chrom"), (k % 997 / 50).alias("cm"))
    return A.inverse_map(p, genetic_map(s, d), ["chrom"]).withColumns({"lo_pos": F.round("lo_pos", 3), "hi_pos": F.round("hi_pos", 3)})


@query(f"""WITH {MAP}, b AS (SELECT chrom, min(cm) + 0.1::DOUBLE AS a, max(cm) - 0.1::DOUBLE AS z FROM map GROUP BY chrom)
SELECT chrom, r::BIGINT AS region, round(a + r * (z - a) / 4, 9) AS lo_cm, round(a + (r + 1) * (z - a) / 4, 9) AS hi_cm FROM b, (SELECT unnest(range(0, 4)) AS r) WHERE z > a""")
def map_regions(s, d):
    return A.equal_regions(genetic_map(s, d), ["chrom"], 4, 0.1).withColumns({"lo_cm": F.round("lo_cm", 9), "hi_cm": F.round("hi_cm", 9)})


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey % 100 AS contig, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS pos FROM orders),
e AS (SELECT l_suppkey AS contig, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS pos, l_quantity AS w FROM lineitem)
SELECT q.id, q.contig, q.pos, count(e.w) AS n, coalesce(sum(e.w), 0) AS total FROM q LEFT JOIN e ON e.contig = q.contig AND e.pos BETWEEN q.pos - 15 AND q.pos + 15 GROUP BY ALL""")
def query_burden(s, d):
    from .q_intervals import points

    e = D.table(s, d, "lineitem").select(F.col("l_suppkey").alias("contig"), F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long").alias("pos"), F.col("l_quantity").alias("w"))
    return A.burden_within(points(s, d), e, ["contig"], 15, "w")


def called(s, d, shift: int):
    g = D.genotypes(s, d)
    k = F.floor((F.col("pos") + shift) / 60_000)
    return g.select("sample_id", "chrom", "pos", ((F.col("sample_id") + k) % 3).alias("label"))


def _called(shift: int) -> str:
    return f"(SELECT sample_id, chrom, pos, (sample_id + (pos + {shift}) // 60000) % 3 AS label FROM geno)"


@query(f"""WITH {D.GENO}, x AS (SELECT *, lag(pos) OVER w AS p, lag(label) OVER w AS before FROM {_called(0)} WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY pos))
SELECT sample_id, chrom, (p + pos) / 2 AS midpoint, before, label AS after FROM x WHERE before <> label""")
def boundaries(s, d):
    return A.boundaries(called(s, d, 0), ["sample_id", "chrom"])


@query(None)
def boundary_matches(s, d):
    k = ["sample_id", "chrom"]
    return A.match_boundaries(A.boundaries(called(s, d, 0), k), A.boundaries(called(s, d, 5000), k), k, 20_000.0)


@query(None)
def boundary_matches_optimal(s, d):
    k = ["sample_id", "chrom"]
    return A.match_boundaries(A.boundaries(called(s, d, 0), k), A.boundaries(called(s, d, 5000), k), k, 20_000.0, True)


GRIDP = "gr AS (SELECT p_partkey % 5 + 1 AS chrom, p_partkey * 1000 AS pos, p_size / 60 AS a, (60 - p_size) / 120 AS b FROM part)"


@query(f"""WITH {GRIDP}, e AS (SELECT chrom, min(pos) AS lo, max(pos) AS hi FROM gr GROUP BY chrom), q AS (SELECT o_orderkey AS id, o_orderkey % 5 + 1 AS chrom, (o_orderkey * 7919) % 2200000 - 50000 AS pos FROM orders),
c AS (SELECT q.*, least(greatest(q.pos, lo), hi) AS x, hi FROM q JOIN e USING (chrom)), w AS (SELECT *, lead(pos) OVER v AS np, lead(a) OVER v AS na, lead(b) OVER v AS nb FROM gr WINDOW v AS (PARTITION BY chrom ORDER BY pos))
SELECT id, c.chrom, c.pos, round(a + (x - w.pos) * (na - a) / (np - w.pos), 9) AS p0, round(b + (x - w.pos) * (nb - b) / (np - w.pos), 9) AS p1 FROM c JOIN w ON w.chrom = c.chrom AND np IS NOT NULL AND x >= w.pos AND (x < np OR (x = np AND np = hi))""")
def projected_posterior(s, d):
    z = F.col("p_size")
    g = D.table(s, d, "part").select((F.col("p_partkey") % 5 + 1).alias("chrom"), (F.col("p_partkey") * 1000).alias("pos"), F.array(z / 60, (60 - z) / 120, (60 - z) / 120).alias("p"))
    out = A.project_posterior(map_points(s, d), g, ["chrom"], 20_000)
    return out.select("id", "chrom", "pos", F.round(F.get("p", F.lit(0)), 9).alias("p0"), F.round(F.get("p", F.lit(1)), 9).alias("p1"))


@query(f"""WITH {D.GENO}, m AS (SELECT *, pos // 1000 % 3 <> 0 AS common FROM geno), k AS (SELECT *, CASE WHEN common THEN dosage END AS v FROM m),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY sample_id, chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, first_value(v IGNORE NULLS) OVER (PARTITION BY sample_id, chrom ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM k)
SELECT l AS "left", r AS "right", dosage, count(*) AS n FROM w WHERE NOT common AND dosage IS NOT NULL GROUP BY ALL""")
def flank_table(s, d):
    m = D.genotypes(s, d).withColumn("common", F.floor(F.col("pos") / 1000) % 3 != 0)
    return A.flank_table(m, ["sample_id", "chrom"])


@query(f"""WITH {D.INTERVALS}, c AS (SELECT contig, part, record AS carrier, lo, hi FROM iv)
SELECT a.contig, a.part, a.carrier, b.carrier AS other, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM c a JOIN c b ON a.contig = b.contig AND a.part = b.part AND a.carrier < b.carrier AND a.lo <= b.hi AND b.lo <= a.hi""")
def copy_overlaps(s, d):
    c = D.intervals(s, d).select("contig", "part", F.col("record").alias("carrier"), "lo", "hi")
    return A.copy_overlaps(c, ["contig", "part"], 32)


OTHER = "o AS (SELECT chrom, pos, ref, CASE WHEN pos // 1000 % 6 = 0 THEN 'N' ELSE alt END AS alt FROM sites WHERE pos // 1000 % 4 <> 0)"


def other_sites(s, d):
    k = F.floor(F.col("pos") / 1000)
    return D.sites(s, d).filter(k % 4 != 0).withColumn("alt", F.when(k % 6 == 0, "N").otherwise(F.col("alt")))


@query(f"""WITH {D.SITES}, {OTHER}
SELECT s.chrom, CASE WHEN o.pos IS NULL THEN 'absent' WHEN o.alt = s.alt THEN 'exact' ELSE 'other_allele' END AS state, count(*) AS n FROM sites s LEFT JOIN o ON o.chrom = s.chrom AND o.pos = s.pos GROUP BY ALL""")
def axis_intersect(s, d):
    return A.axis_intersect(D.sites(s, d), other_sites(s, d))


@query("SELECT DISTINCT o_custkey AS cohort, o_orderkey % 50 AS id, o_custkey || '_' || (o_orderkey % 50) AS joint FROM orders")
def crosswalk(s, d):
    return A.crosswalk(D.table(s, d, "orders").select(F.col("o_custkey").alias("cohort"), (F.col("o_orderkey") % 50).alias("id")), "cohort", "id")


@query(f"""WITH {D.GENO}, c AS (SELECT chrom, pos, count(*) FILTER (WHERE sample_id % 4 = 0 AND dosage > 0) AS d, count(*) FILTER (WHERE sample_id % 4 = 1 AND dosage > 0) AS r FROM geno GROUP BY ALL)
SELECT CASE WHEN d > 0 AND r > 0 THEN 'both' WHEN d > 0 THEN 'donor_only' WHEN r > 0 THEN 'reference_only' ELSE 'none' END AS class, count(*) AS n FROM c GROUP BY 1""")
def joint_class(s, d):
    x = F.col("dosage") > 0
    c = D.genotypes(s, d).groupBy("chrom", "pos").agg(F.count_if((F.col("sample_id") % 4 == 0) & x).alias("d"), F.count_if((F.col("sample_id") % 4 == 1) & x).alias("r"))
    return c.groupBy(A.joint_class("d", "r").alias("class")).agg(F.count("*").alias("n"))


KIN = D.PAIRS + ", kn AS (SELECT sample_a, sample_b, CASE WHEN (sample_a + sample_b) % 13 <> 0 THEN total_shared_bp / 400000.0::DOUBLE END AS kin FROM pairs)"


def kin(s, d):
    return summary(s, d).select("sample_a", "sample_b", F.when((F.col("sample_a") + F.col("sample_b")) % 13 != 0, F.col("total_shared_bp") / 400_000).alias("kin"))


@query(f"WITH {KIN} SELECT CASE WHEN kin IS NULL THEN 'missing' WHEN kin >= 0.354 THEN 'duplicate' WHEN kin >= 0.177 THEN 'first' WHEN kin >= 0.0884 THEN 'second' WHEN kin >= 0.0442 THEN 'third' ELSE 'unrelated' END AS grade, count(*) AS n FROM kn GROUP BY 1")
def kin_grades(s, d):
    return kin(s, d).groupBy(A.kin_grade().alias("grade")).agg(F.count("*").alias("n"))


@query(f"WITH {KIN}, t AS (SELECT unnest([0.0442, 0.1, 5.0])::DOUBLE AS threshold) SELECT threshold, count(kin) AS n_pairs FROM t LEFT JOIN kn ON kin >= threshold GROUP BY threshold")
def kin_thresholds(s, d):
    return A.threshold_counts(kin(s, d), "kin", [0.0442, 0.1, 5.0])


@query(f"WITH {CUST} SELECT nation, count(*) AS available, count(*) FILTER (WHERE n_orders > 8) AS retained, count(*) FILTER (WHERE n_orders > 8) / count(*) AS fraction FROM cu GROUP BY nation")
def stratum_coverage(s, d):
    c = customers(s, d)
    return A.stratum_coverage(c, c.filter("n_orders > 8"), "id", "nation")


REACHED = f"""WITH RECURSIVE {KIN.replace('WITH ', '', 1)}, n AS (SELECT DISTINCT sample_id AS node FROM geno), h AS (SELECT node % 40 AS st, min(node) AS a FROM n GROUP BY 1),
e AS (SELECT sample_a AS a, sample_b AS b FROM kn WHERE kin >= 0.3 UNION SELECT a, node FROM n JOIN h ON h.st = node % 40 WHERE a <> node), y AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT node, node AS reached FROM n UNION SELECT r.node, y.b FROM r JOIN y ON y.a = r.reached) SELECT node, min(reached) AS component FROM r GROUP BY node"""


@query(REACHED)
def population_blocks(s, d):
    e = kin(s, d).filter("kin >= 0.3").select(F.col("sample_a").alias("a"), F.col("sample_b").alias("b"))
    return A.population_blocks(cut(e), nodes(s, d).withColumn("st", F.col("node") % 40), "node", "st")


@query(f"""WITH {KIN}, p AS (SELECT DISTINCT sample_id FROM geno WHERE sample_id % 6 <> 0) SELECT sample_a AS a, sample_b AS b FROM kn WHERE kin >= 0.3 AND NOT (sample_a IN (SELECT * FROM p) AND sample_b IN (SELECT * FROM p))""")
def duplicates_leaving(s, d):
    people = nodes(s, d).filter("node % 6 <> 0").withColumnRenamed("node", "sample_id")
    return A.duplicate_groups(cut(kin(s, d)), people, 0.3)[1]


@query(None)
def pair_targets(s, d):
    """Twenty positive and zero pairs of each block of people."""
    p = summary(s, d).select("sample_a", "sample_b", (F.col("sample_a") % 4).alias("block"), F.greatest(F.col("total_shared_bp") - 40_000, F.lit(0)).alias("w"))
    return A.pair_targets(p, "block", 20)


@query("""WITH c AS (SELECT DISTINCT p_size::BIGINT % 6 AS gap, p_partkey % 4 AS len FROM part)
SELECT 'gap' AS axis, gap AS x1, len AS y1, lead(gap) OVER w AS x2, lead(len) OVER w AS y2 FROM c WINDOW w AS (PARTITION BY len ORDER BY gap) QUALIFY x2 IS NOT NULL
UNION ALL SELECT 'len', gap, len, lead(gap) OVER w, lead(len) OVER w FROM c WINDOW w AS (PARTITION BY gap ORDER BY len) QUALIFY lead(gap) OVER w IS NOT NULL""")
def grid_neighbours(s, d):
    c = D.table(s, d, "part").select((F.col("p_size").cast("long") % 6).alias("gap"), (F.col("p_partkey") % 4).alias("len")).distinct()
    return A.grid_neighbours(c, "gap", "len")


@query(f"""WITH {CUST}, l AS (SELECT n_orders > 8 AS f, 'nation' AS "column", CASE WHEN id % 7 = 0 THEN 'UNKNOWN' ELSE nation::VARCHAR END AS level FROM cu UNION ALL SELECT n_orders > 8, 'seg', seg FROM cu)
SELECT "column", level, count(*) FILTER (WHERE f) AS n_in, count(*) FILTER (WHERE NOT f) AS n_out FROM l GROUP BY ALL""")
def nominal_composition(s, d):
    c = customers(s, d).withColumns({"f": F.col("n_orders") > 8, "nation": F.when(F.col("id") % 7 != 0, F.col("nation"))})
    return A.nominal_composition(c, "f", ["nation", "seg"])


@query(f"""WITH {CUST}, p AS (SELECT CASE WHEN id % 9 <> 0 THEN nation % 5 END AS lab, seg FROM cu),
x AS (SELECT 'cohort' AS scope, seg FROM p UNION ALL SELECT CASE WHEN lab IS NULL THEN 'unassigned' ELSE 'assigned' END, seg FROM p UNION ALL SELECT 'community:' || lab, seg FROM p WHERE lab IS NOT NULL),
n AS (SELECT scope, seg, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT scope, max(n) AS m, sum(n) AS size FROM n GROUP BY scope)
SELECT scope, size::BIGINT AS n, m / size AS purity, string_agg(seg, ';' ORDER BY seg) AS dominant, size < 30 AS small FROM n JOIN m USING (scope) WHERE n.n = m GROUP BY scope, size, m""")
def scope_summary(s, d):
    c = customers(s, d).withColumn("lab", F.when(F.col("id") % 9 != 0, F.col("nation") % 5))
    return A.scope_summary(c, "lab", "seg", 30)


@query(f"""WITH {CUST}, t AS (SELECT nation % 5 AS la, seg AS lb, count(*) AS n FROM cu GROUP BY ALL), z AS (SELECT sum(n) AS t FROM t), a AS (SELECT la, sum(n) AS na, max(n) AS top FROM t GROUP BY la), b AS (SELECT lb, sum(n) AS nb FROM t GROUP BY lb),
mi AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM t JOIN a USING (la) JOIN b USING (lb), z), ha AS (SELECT -sum(na / t * ln(na / t)) AS ha, sum(top) / max(t) AS purity FROM a, z), hb AS (SELECT -sum(nb / t * ln(nb / t)) AS hb FROM b, z)
SELECT round(2 * mi / (ha + hb), 9) AS nmi, round(purity, 9) AS purity FROM mi, ha, hb""")
def reference_scores(s, d):
    c = customers(s, d)
    t = c.groupBy((F.col("nation") % 5).alias("la"), F.col("seg").alias("lb")).agg(F.count("*").alias("n"))
    return A.mutual_information(cut(t)).select(F.round("nmi", 9).alias("nmi"), F.round("purity", 9).alias("purity"))


@query(f"""WITH {D.GENO}, l AS (SELECT chrom, pos, sum(dosage) FILTER (WHERE sample_id % 2 = 0) / nullif(2 * count(dosage) FILTER (WHERE sample_id % 2 = 0), 0) AS a, sum(dosage) FILTER (WHERE sample_id % 2 = 1) / nullif(2 * count(dosage) FILTER (WHERE sample_id % 2 = 1), 0) AS b, count(*) FILTER (WHERE dosage > 0) AS c FROM geno GROUP BY ALL),
t AS (SELECT unnest([0.2, 0.5, 0.7])::DOUBLE AS threshold)
SELECT threshold, count(c) AS n_loci, coalesce(sum(c), 0)::BIGINT AS n_carriers FROM t LEFT JOIN l ON greatest(coalesce(a, 0), coalesce(b, 0)) <= threshold GROUP BY threshold""")
def locus_masks(s, d):
    x, even = F.col("dosage"), F.col("sample_id") % 2 == 0
    freq = lambda c: F.try_divide(F.sum(F.when(c, x)), 2 * F.count(F.when(c, x)))
    l = D.genotypes(s, d).groupBy("chrom", "pos").agg(freq(even).alias("a"), freq(~even).alias("b"), F.count_if(x > 0).alias("n_carriers"))
    return A.locus_masks(l, ["a", "b"], [0.2, 0.5, 0.7])


@query("""WITH m AS (SELECT l_partkey % 5 + 1 AS chrom, l_suppkey * 1000 AS pos, substr('ACGT', (l_suppkey % 4 + 1)::INT, 1) AS ref, CASE WHEN l_linenumber = 7 THEN 'AT' ELSE substr('ACGT', ((l_suppkey + l_linenumber) % 4 + 1)::INT, 1) END AS alt FROM lineitem),
k AS (SELECT *, count(*) AS k FROM m GROUP BY ALL)
SELECT chrom, sum(k)::BIGINT AS records, coalesce(sum(k) FILTER (WHERE length(alt) = 1), 0)::BIGINT AS biallelic, count(*) FILTER (WHERE k > 1) AS repeated_keys, coalesce(sum(k) FILTER (WHERE pos NOT BETWEEN 5000 AND 90000), 0)::BIGINT AS outside FROM k GROUP BY chrom""")
def panel_audit(s, d):
    pick = lambda e: F.substr(F.lit("ACGT"), (e % 4 + 1).cast("int"), F.lit(1))
    m = D.table(s, d, "lineitem").select((F.col("l_partkey") % 5 + 1).alias("chrom"), (F.col("l_suppkey") * 1000).alias("pos"), pick(F.col("l_suppkey")).alias("ref"), F.when(F.col("l_linenumber") == 7, "AT").otherwise(pick(F.col("l_suppkey") + F.col("l_linenumber"))).alias("alt"))
    bounds = m.select("chrom").distinct().select("chrom", F.lit(5000).alias("lo"), F.lit(90_000).alias("hi"))
    return A.panel_audit(m, bounds)


@query(f"""WITH {D.SITES}, m AS (SELECT *, CASE pos // 1000 % 5 WHEN 0 THEN chrom || ':' || (pos + 1) || ':' || ref || ':' || alt WHEN 1 THEN chrom || ':' || pos || ':' || alt || ':' || ref WHEN 2 THEN 'rs' || pos ELSE chrom || ':' || pos || ':' || ref || ':' || alt END AS id FROM sites)
SELECT CASE pos // 1000 % 5 WHEN 0 THEN 'position_mismatch' WHEN 1 THEN 'swapped' WHEN 2 THEN 'malformed' ELSE 'same' END AS state, count(*) AS n FROM m GROUP BY 1""")
def marker_orientation(s, d):
    k = F.floor(F.col("pos") / 1000) % 5
    make = lambda p, x, y: F.concat_ws(":", F.col("chrom"), p, x, y)
    m = D.sites(s, d).withColumn("id", F.when(k == 0, make(F.col("pos") + 1, F.col("ref"), F.col("alt"))).when(k == 1, make(F.col("pos"), F.col("alt"), F.col("ref"))).when(k == 2, F.concat(F.lit("rs"), "pos")).otherwise(make(F.col("pos"), F.col("ref"), F.col("alt"))))
    return m.groupBy(A.marker_orientation("id", "pos", "ref", "alt").alias("state")).agg(F.count("*").alias("n"))


@query(f"""WITH {D.SITES}, {OTHER}, a AS (SELECT chrom, pos, alt FROM sites WHERE pos // 1000 % 9 <> 0)
SELECT CASE WHEN a.pos IS NULL THEN 'only_b' WHEN o.pos IS NULL THEN 'only_a' WHEN a.alt = o.alt THEN 'both' ELSE 'differs' END AS state, count(*) AS n FROM a FULL JOIN o ON a.chrom = o.chrom AND a.pos = o.pos GROUP BY 1""")
def role_catalogue(s, d):
    a = D.sites(s, d).filter("floor(pos / 1000) % 9 <> 0")
    return A.role_catalogue(a, other_sites(s, d), ["chrom", "pos"], ["alt"])


@query(f"""WITH {D.GENO}, g AS (SELECT 'm' || (chrom % 2) AS method, dosage, [0.2, 0.3 + (pos // 1000 % 3) / 10, 0.5 - (pos // 1000 % 3) / 10] AS p FROM geno WHERE dosage IS NOT NULL),
c AS (SELECT method, dosage, count(*) AS n, sum(-ln(p[dosage + 1])) AS loss, count(*) FILTER (WHERE list_position(p, list_max(p)) - 1 = dosage) AS ok FROM g GROUP BY ALL)
SELECT method, dosage, coalesce(n, 0) AS n, round(coalesce(loss, 0), 6) AS loss, coalesce(ok, 0) AS n_correct FROM (SELECT DISTINCT method FROM g) CROSS JOIN (SELECT DISTINCT dosage FROM g) LEFT JOIN c USING (method, dosage)""".replace("[0.2, 0.3 +", "[0.2::DOUBLE, 0.3::DOUBLE +").replace("0.5 -", "0.5::DOUBLE -"))
def loss_by_dose(s, d):
    k = F.floor(F.col("pos") / 1000) % 3 / 10
    g = D.genotypes(s, d).filter("dosage is not null").select(F.concat(F.lit("m"), F.col("chrom") % 2).alias("method"), "dosage", F.array(F.lit(0.2), 0.3 + k, 0.5 - k).alias("p"))
    return A.loss_by_dose(g, "dosage", "method", "p").withColumn("loss", F.round("loss", 6))


@query(f"""WITH {EDGES}, k AS (SELECT node, count(*) AS k FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node)
SELECT CASE WHEN k >= 40 THEN 40 WHEN k >= 20 THEN 20 WHEN k >= 5 THEN 5 WHEN k >= 1 THEN 1 END::BIGINT AS band, count(*) AS n, sum(k)::BIGINT AS total_degree FROM k GROUP BY 1""")
def degree_bands(s, d):
    return A.degree_bands(G.strength(edges(s, d)), [1, 5, 20, 40])


@query("""WITH v AS (SELECT label < 2 AS f, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), l AS (SELECT f, 'x' AS axis, x AS v FROM v UNION ALL SELECT f, 'y', y FROM v)
SELECT axis, round(sum(v * v) * sum(v * v) / sum(v * v * v * v), 6) AS participation, round(sum(CASE WHEN f THEN v * v ELSE 0 END) / sum(v * v), 6) AS subset_share FROM l GROUP BY axis""")
def axis_mass(s, d):
    v = D.table(s, d, "embeddings").select((F.col("label") < 2).alias("f"), F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    return A.axis_mass(v, ["x", "y"], "f").withColumns({"participation": F.round("participation", 6), "subset_share": F.round("subset_share", 6)})
