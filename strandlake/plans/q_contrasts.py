"""Queries of contrast operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contrasts as C
from ..operators import intervals as I
from ..operators import pairs as P
from ..operators import stats as T
from ..operators import summaries as S
from ..operators import windows as W
from . import domain as D
from .q_graph import LABELS, labels, nodes
from .lineage import cut, stored
from .q_intervals import genetic_map
from .q_pairs import COMP, PANEL, carriers, people, summary
from .q_stats import CUST, customers

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


@query("""WITH l AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT c_custkey AS k, count(*) AS n FROM customer WHERE c_custkey % 10 <> 0 GROUP BY 1),
j AS (SELECT l.n AS a, r.n AS b FROM l FULL JOIN r ON l.k = r.k),
x AS (SELECT 'repeated_left' AS rule, count(*) FILTER (WHERE a > 1) AS n FROM j UNION ALL SELECT 'repeated_right', count(*) FILTER (WHERE b > 1) FROM j UNION ALL SELECT 'only_left', count(*) FILTER (WHERE b IS NULL) FROM j UNION ALL SELECT 'only_right', count(*) FILTER (WHERE a IS NULL) FROM j)
SELECT * FROM x WHERE n > 0""")
def one_to_one_breaches(s, d):
    o = D.table(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return C.join_one_to_one(o, D.table(s, d, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("k"), "c_name"), ["k"])[1]


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM orders)
SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, date_diff('day', DATE '1970-01-01', ahead::DATE) AS ahead_day FROM x WHERE o_orderdate < ahead""")
def out_of_order(s, d):
    """Orders dated before an earlier one of the same customer."""
    o = D.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    day = lambda c: F.datediff(c, F.lit("1970-01-01")).cast("long")
    return C.out_of_order(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", day("o_orderdate").alias("day"), day("ahead").alias("ahead_day"))


CONTROLS = f"WITH {CUST}, t AS (SELECT nation, floor(bal / 1000)::BIGINT AS bin, count(*) AS n_targets FROM cu WHERE seg = 'BUILDING' GROUP BY ALL), p AS (SELECT nation, floor(bal / 1000)::BIGINT AS bin, count(*) AS n_pool FROM cu WHERE seg = 'MACHINERY' GROUP BY ALL)"


def controls(s, d):
    c = customers(s, d).withColumn("bin", F.floor(F.col("bal") / 1000).cast("long"))
    return C.match_controls(c.filter("seg = 'BUILDING'"), c.filter("seg = 'MACHINERY'"), ["nation", "bin"], "id")


@query(CONTROLS + " SELECT nation, bin, n_targets, coalesce(n_pool, 0) AS n_pool, greatest(n_targets - coalesce(n_pool, 0), 0) AS deficit FROM t LEFT JOIN p USING (nation, bin)")
def control_bins(s, d):
    return controls(s, d)[1]


@query(CONTROLS + " SELECT nation, bin, least(n_targets, n_pool) AS n FROM t JOIN p USING (nation, bin)")
def matched_controls(s, d):
    """How many controls each bin has; which ones is a matter of hashes."""
    return controls(s, d)[0].groupBy("nation", "bin").agg(F.count("*").alias("n"))


@query(None)
def markers_within(s, d):
    """Sites that nobody misses find the nearest on the map among those that somebody misses."""
    m = genetic_map(s, d).join(D.sites(s, d).select("chrom", "pos", "n_missing"), ["chrom", "pos"])
    t = m.filter("n_missing = 0").select("chrom", "cm", F.col("pos").alias("target"))
    return C.markers_within(t, m.filter("n_missing > 0").select("chrom", "cm", F.col("pos").alias("marker")), ["chrom"], "cm", 0.05, 0.1, 4)


@query(None)
def partition_concordance(s, d):
    b = customers(s, d).select(F.col("id").alias("node"), F.col("nation").alias("community"))
    return C.partition_concordance(labels(s, d), b, 19)


@query(f"""WITH {D.GENO}, {D.INTERVALS}, {LABELS}, r AS (SELECT record % 997 AS sample_id, sum((hi - lo + 1) / 1000) AS kb, count(*) AS n FROM iv GROUP BY 1), p AS (SELECT DISTINCT sample_id FROM geno WHERE sample_id % 6 <> 0),
x AS (SELECT community, p.sample_id AS known, CASE WHEN p.sample_id IS NOT NULL THEN coalesce(kb, 0) END AS kb, CASE WHEN p.sample_id IS NOT NULL THEN coalesce(n, 0) END AS n FROM lab LEFT JOIN p ON p.sample_id = node LEFT JOIN r ON r.sample_id = p.sample_id WHERE community IS NOT NULL),
g AS (SELECT community, count(*) AS n_people, count(known) AS n_known, avg(kb) AS mean_kb, median(kb) AS median_kb, avg(n) AS mean_segments, sum(kb) AS s1, sum(kb * kb) AS q FROM x GROUP BY community),
t AS (SELECT sum(q) AS q, sum(s1) AS s, sum(n_known) AS k, sum(s1 * s1 / n_known) AS b FROM g)
SELECT community, n_people, n_known, round(mean_kb, 6) AS mean_kb, round(median_kb, 6) AS median_kb, round(mean_segments, 6) AS mean_segments, round((b - s * s / k) / (t.q - s * s / k), 6) AS eta2 FROM g, t""")
def roh_by_community(s, d):
    r = D.intervals(s, d).select((F.col("record") % 997).alias("sample_id"), ((F.col("hi") - F.col("lo") + 1) / 1000).alias("kb"))
    people = D.genotypes(s, d).select("sample_id").distinct().filter("sample_id % 6 <> 0")  # the universe that was looked at
    out = C.roh_by_community(r, people, labels(s, d))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_kb", "median_kb", "mean_segments", "eta2")})


@query(f"""WITH {CUST}, x AS (SELECT nation::VARCHAR AS stratum, seg = 'BUILDING' AS chosen, bal, n_orders::DOUBLE AS n_orders FROM cu UNION ALL SELECT 'ALL', seg = 'BUILDING', bal, n_orders FROM cu),
u AS (SELECT stratum, chosen, 'bal' AS measure, bal AS v FROM x UNION ALL SELECT stratum, chosen, 'n_orders', n_orders FROM x)
SELECT stratum, measure, count(v) FILTER (WHERE chosen) AS n_chosen, count(v) FILTER (WHERE NOT chosen) AS n_other, round(avg(v) FILTER (WHERE chosen), 6) AS mean_chosen, round(avg(v) FILTER (WHERE NOT chosen), 6) AS mean_other,
  round((avg(v) FILTER (WHERE chosen) - avg(v) FILTER (WHERE NOT chosen)) / nullif(sqrt((var_samp(v) FILTER (WHERE chosen) + var_samp(v) FILTER (WHERE NOT chosen)) / 2), 0), 6) AS smd FROM u GROUP BY ALL""")
def representativeness(s, d):
    c = customers(s, d).withColumn("chosen", F.col("seg") == "BUILDING")
    out = C.representativeness(c, ["bal", "n_orders"], ["nation"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_chosen", "mean_other", "smd")})


CONTRAST = f"""WITH {D.PAIRS}, {LABELS}, q AS (SELECT c_custkey AS node, c_nationkey AS community FROM customer WHERE c_custkey % 13 <> 0),
j AS (SELECT total_shared_bp AS v, pa.community AS a, pb.community AS b, qa.community AS c, qb.community AS e FROM pairs LEFT JOIN lab pa ON pa.node = sample_a LEFT JOIN lab pb ON pb.node = sample_b LEFT JOIN q qa ON qa.node = sample_a LEFT JOIN q qb ON qb.node = sample_b),
k AS (SELECT * FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL),
m AS (SELECT avg(v) FILTER (WHERE a = b) - avg(v) FILTER (WHERE a <> b) AS delta_p, avg(v) FILTER (WHERE c = e) - avg(v) FILTER (WHERE c <> e) AS delta_q FROM k)"""


def contrast(s, d, replicates: int):
    q = D.table(s, d, "customer").filter("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community"))
    groups = nodes(s, d).select("node", F.col("node").alias("group"))
    return C.paired_partition_contrast(summary(s, d), labels(s, d), q, "total_shared_bp", groups, replicates)


@query(CONTRAST + " SELECT (SELECT count(*) FROM k) AS n_pairs, (SELECT count(*) FROM j) - (SELECT count(*) FROM k) AS n_rejected, round(delta_p, 6) AS delta_p, round(delta_q, 6) AS delta_q, round(delta_p - delta_q, 6) AS contrast FROM m")
def partition_contrast(s, d):
    return contrast(s, d, 0).withColumns({c: F.round(c, 6) for c in ("delta_p", "delta_q", "contrast")})


@query(None)
def partition_contrast_interval(s, d):
    return contrast(s, d, 100)


@query(f"""WITH {D.GENO}, b AS (SELECT sample_id, chrom, pos, greatest(0, dosage + a - 2) AS low, least(dosage, a) AS high FROM (SELECT *, (pos // 1000 + sample_id) % 3 AS a FROM geno) WHERE dosage IS NOT NULL)
SELECT x.sample_id AS sample_a, y.sample_id AS sample_b, x.chrom, sum(least(x.low, y.low))::BIGINT AS low, sum(least(x.high, y.high))::BIGINT AS high, count(*) AS n
FROM b x JOIN b y ON x.chrom = y.chrom AND x.pos = y.pos AND x.sample_id < y.sample_id AND x.high > 0 AND y.high > 0 GROUP BY ALL""")
def pair_bounds(s, d):
    g = D.genotypes(s, d).filter("dosage is not null").withColumn("ancestry", (F.floor(F.col("pos") / 1000) + F.col("sample_id")) % 3)
    return C.pair_bounds(P.dose_bands(g, "dosage", "ancestry"))


@query(f"""WITH {D.GENO}, p AS (SELECT a.sample_id AS a, b.sample_id AS b, a.chrom, count(*)::DOUBLE AS n, avg(a.dosage * b.dosage) AS k FROM geno a JOIN geno b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample_id < b.sample_id AND a.dosage IS NOT NULL AND b.dosage IS NOT NULL GROUP BY ALL)
SELECT a, b, sum(n) AS n, round(sum(n * k) / sum(n), 9) AS k FROM p GROUP BY a, b""")
def merged_relationship(s, d):
    g = stored(D.genotypes(s, d).filter("dosage is not null"))
    met = P.meetings(g, ["dosage"], P.LISTED, P.MEETINGS, ("chrom",)).withColumnsRenamed({"sample_a": "a", "sample_b": "b"})
    parts = met.groupBy("a", "b", "chrom").agg(F.count("*").cast("double").alias("n"), F.avg(F.col("dosage_a") * F.col("dosage_b")).alias("k"))
    return C.merged_relationship(parts).withColumn("k", F.round("k", 9))


@query(f"WITH {D.SITES}, x AS (SELECT least(ac, an - ac) AS ac FROM sites WHERE an > 0) SELECT r.ac::BIGINT AS ac, count(x.ac) AS n FROM (SELECT unnest(range(1, 21)) AS ac) r LEFT JOIN x ON x.ac = r.ac GROUP BY r.ac")
def rare_tail(s, d):
    return S.rare_tail(D.sites(s, d), 20, True)


@query(f"""WITH {D.SITES} SELECT chrom, min(pos) AS pos FROM sites WHERE an > 0 AND least(ac, an - ac) >= 0.25 * an AND n_missing <= 0.15 * (an / 2 + n_missing) GROUP BY chrom, pos // 10000""")
def linkage_sites(s, d):
    return S.linkage_sites(D.sites(s, d), 0.25, 0.15, 10_000)


@query(PANEL + """, dr AS (SELECT chrom, pos, ref, alt, CASE WHEN pos // 1000 % 3 = 0 THEN ac ELSE 1 END AS own FROM sites WHERE pos // 1000 % 2 = 0), pl AS (SELECT p.*, greatest(ac - coalesce(own, 0), 0) AS less FROM panel p LEFT JOIN dr USING (chrom, pos, ref, alt))
SELECT x.chrom, x.pos, x.ref, x.alt, state, panel_ac AS ac_full, CASE WHEN state IN ('carried', 'monomorphic') THEN CASE WHEN less > 0 THEN 'carried' ELSE 'monomorphic' END ELSE state END AS state_drop,
  CASE WHEN state IN ('carried', 'monomorphic') THEN less ELSE 0 END AS ac_drop, state = 'carried' AND less = 0 AS lost FROM x LEFT JOIN pl ON pl.chrom = x.chrom AND pl.pos = x.pos""")
def presence_without(s, d):
    t = D.sites(s, d)
    k = F.floor(F.col("pos") / 1000)
    panel = t.filter(k % 11 != 0).select("chrom", "pos", F.when(k % 7 == 0, F.col("alt")).otherwise(F.col("ref")).alias("ref"), F.when(k % 5 == 0, "N").otherwise(F.col("alt")).alias("alt"), F.when(k % 4 == 0, 0).otherwise(F.col("ac")).alias("ac"))
    own = t.filter(k % 2 == 0).select("chrom", "pos", "ref", "alt", F.when(k % 3 == 0, F.col("ac")).otherwise(1).alias("ac"))
    return S.presence_without(t.select("chrom", "pos", "ref", "alt"), panel, own)


@query(COMP + ", b AS (SELECT level, sum(n) / (SELECT sum(n) FROM c) AS background FROM c GROUP BY level) SELECT grp, level, n, fraction, round(background, 9) AS background, round(fraction / background, 9) AS ratio FROM c JOIN b USING (level)")
def composition_background(s, d):
    out = S.against_background(S.composition(people(s, d), "grp", "level"), "grp", "level")
    return out.withColumns({"background": F.round("background", 9), "ratio": F.round("ratio", 9)})


@query(f"""WITH {D.SITES}, o AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY chrom) AS n FROM sites),
w AS (SELECT chrom, pos, least(i // 7, (n - 1) // 7 - CASE WHEN n - (n - 1) // 7 * 7 < 3.5 AND (n - 1) // 7 > 0 THEN 1 ELSE 0 END)::BIGINT AS window_id FROM o)
SELECT chrom, window_id, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM w GROUP BY ALL""")
def equal_site_windows(s, d):
    return W.equal_site_windows(D.sites(s, d), ["chrom"], 7, 300_000)


WITHIN = f"""WITH {D.GENO}, c AS (SELECT sample_id, chrom, pos FROM geno WHERE dosage > 0), x AS (SELECT a.chrom, b.pos - a.pos AS distance FROM c a JOIN c b ON a.sample_id = b.sample_id AND a.chrom = b.chrom AND b.pos > a.pos AND b.pos - a.pos <= 50000)"""


def within(s, d):
    return W.distances_within(carriers(s, d), ["sample_id", "chrom"], 50_000).select("chrom", "distance")


@query(WITHIN + " SELECT chrom, count(*) AS n, round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS sd, round(exp(avg(ln(distance))), 6) AS geometric_mean FROM x GROUP BY chrom")
def distance_moments(s, d):
    return W.distance_moments(within(s, d), ["chrom"]).withColumns({c: F.round(c, 6) for c in ("mean", "sd", "geometric_mean")})


@query(WITHIN + """, h AS (SELECT chrom, greatest(0, least(7, floor((log10(distance) - 3.0) / 0.25)))::BIGINT AS bin, count(*) AS n FROM x GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY bin) AS u, sum(n) OVER (PARTITION BY chrom) AS t FROM h)
SELECT chrom, round(power(10.0, 3.0 + 0.25 * (bin + (0.5 * t - u + n) / n)), 6) AS value FROM k WHERE u >= 0.5 * t AND u - n < 0.5 * t""")
def distance_median(s, d):
    h = W.log_histogram(within(s, d), ["chrom"], 3.0, 5.0, 8)
    return W.histogram_quantile(h, ["chrom"], 3.0, 5.0, 8, 0.5).withColumn("value", F.round("value", 6))


@query(f"""WITH {CUST}, m AS (SELECT nation, seg, count(*) AS n FROM cu GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY n DESC, seg) AS k, sum(n) OVER (PARTITION BY nation) AS size FROM m), q AS (SELECT nation, median(bal) AS median_confidence FROM cu GROUP BY nation)
SELECT nation, seg, n / size AS fraction, size::BIGINT AS size, round(median_confidence, 6) AS median_confidence FROM r JOIN q USING (nation) WHERE k = 1""")
def modal_confidence(s, d):
    return T.modal_confidence(customers(s, d), "nation", "seg", "bal").withColumn("median_confidence", F.round("median_confidence", 6))


@query(f"""WITH {CUST}, k AS (SELECT rank() OVER (ORDER BY n_orders) + (count(*) OVER (PARTITION BY n_orders) - 1) / 2 AS rx, rank() OVER (ORDER BY bal) + (count(*) OVER (PARTITION BY bal) - 1) / 2 AS ry FROM cu)
SELECT quantile_cont(abs(ry - rx), 0.5) AS shift_p50, quantile_cont(abs(ry - rx), 0.95) AS shift_p95 FROM k""")
def rank_shifts(s, d):
    return T.rank_shifts(cut(customers(s, d).select("n_orders", "bal")), "n_orders", "bal")


@query(f"""WITH {CUST}, w AS (SELECT nation, seg, bal, 1.0 / count(*) OVER (PARTITION BY nation) AS w FROM cu), g AS (SELECT seg, sum(w) AS w, sum(w * bal) AS s, sum(w * bal * bal) AS q FROM w GROUP BY seg), t AS (SELECT sum(w) AS w, sum(s) AS s, sum(q) AS q, sum(s * s / w) AS b, count(*) AS groups FROM g)
SELECT groups, round((b - s * s / w) / (q - s * s / w), 6) AS eta2 FROM t""")
def balanced_eta_squared(s, d):
    return T.balanced_eta_squared(customers(s, d), "bal", "seg", "nation").withColumn("eta2", F.round("eta2", 6))


@query(f"""WITH {D.GENO}, r AS (SELECT *, CASE WHEN sample_id % 5 = 0 THEN 'test' ELSE 'train' END AS role FROM geno), x AS (SELECT * FROM r UNION ALL SELECT sample_id, chrom, pos, dosage, 'ALL' FROM geno),
c AS (SELECT role, count(*) AS n_joint, count(*) FILTER (WHERE (sample_id + pos // 1000) % 10 <> 0 OR dosage = 1) AS n_same FROM x WHERE dosage IS NOT NULL GROUP BY role)
SELECT *, n_same / n_joint AS concordance FROM c""")
def role_concordance(s, d):
    g = D.genotypes(s, d)
    other = g.withColumn("dosage", F.when((F.col("sample_id") + F.floor(F.col("pos") / 1000)) % 10 == 0, 2 - F.col("dosage")).otherwise(F.col("dosage")))
    role = F.when(F.col("sample_id") % 5 == 0, "test").otherwise("train")
    return S.concordance(g.withColumn("role", F.explode(F.array(role, F.lit("ALL")))), other, "role")


@query(f"""WITH {D.INTERVALS}, b AS (SELECT contig, min(lo) + 200 AS b_lo, max(hi) - 200 AS b_hi FROM iv WHERE contig % 7 <> 0 GROUP BY contig),
c AS (SELECT iv.contig, record, part, b_lo, greatest(lo, b_lo) AS a, least(hi, b_hi) AS z FROM iv LEFT JOIN b USING (contig))
SELECT contig, record, part, CASE WHEN b_lo IS NOT NULL AND a <= z THEN (z - a) / 50 END AS length_cm FROM c""")
def clip_length(s, d):
    """On an even map of 2 cM for 100 days."""
    v = D.intervals(s, d).drop("label")
    b = v.filter("contig % 7 <> 0").groupBy("contig").agg((F.min("lo") + 200).alias("lo"), (F.max("hi") - 200).alias("hi"))
    curve = b.select("contig", F.explode(F.array("lo", F.floor((F.col("lo") + F.col("hi")) / 2), "hi")).alias("pos")).withColumn("cm", F.col("pos") / 50)
    out = I.clip_length(I.clip(v, b, ["contig"]), curve, ["contig"], 365)
    return out.select("contig", "record", "part", F.round("length_cm", 9).alias("length_cm"))
