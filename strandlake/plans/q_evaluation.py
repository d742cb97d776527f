"""Queries of evaluation operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E

from ..operators import summaries as S
from . import domain as D
from .lineage import stored
from .q_ancestry import KIN, kin
from .q_graph import LABELS, labels, nodes
from .q_pairs import segments, summary
from .q_stats import CUST, TRUTH, customers, truth

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


@query(None)
def overlap_assignment(s, d):
    v = D.intervals(s, d)
    key = F.col("record") * 10 + F.col("part")
    t = v.filter("label = 'A'").select("contig", key.alias("truth"), "lo", "hi")
    return E.assign_overlaps(t, v.filter("label = 'R'").select("contig", key.alias("call"), "lo", "hi"), ["contig"], 32)


@query(None)
def tag_sites(s, d):
    g = D.genotypes(s, d)
    return E.tag_sites(S.ld_pairs(g, ["chrom"], 20_000), g.select("chrom", "pos").distinct(), 0.2)


@query(None)
def tag_counts(s, d):
    g = D.genotypes(s, d)
    return E.tag_counts(S.ld_pairs(g, ["chrom"], 20_000), g, [0.2, 0.8])


@query(f"""WITH {D.GENO}, x AS (SELECT CASE WHEN sample_id % 5 = 0 THEN 'test' ELSE 'train' END AS role, chrom::VARCHAR AS chrom, count(dosage) AS n_called, count(*) - count(dosage) AS n_missing FROM geno GROUP BY ALL)
SELECT coalesce(role, 'ALL') AS role, coalesce(chrom, 'ALL') AS chrom, sum(n_called)::BIGINT AS n_called, sum(n_missing)::BIGINT AS n_missing FROM x GROUP BY CUBE (role, chrom)""")
def support_review(s, d):
    g = D.genotypes(s, d).withColumn("role", F.when(F.col("sample_id") % 5 == 0, "test").otherwise("train"))
    c = g.groupBy("role", "chrom").agg(F.count("dosage").alias("n_called"), F.count_if(F.col("dosage").isNull()).alias("n_missing"))
    return E.support_cube(c, ["role", "chrom"], ["n_called", "n_missing"])


@query(f"""WITH {D.SEGMENTS}, c AS (SELECT n_shared_variants % 2 AS config, sample_a, sample_b, count(*) AS n_segments, sum(length_bp)::BIGINT AS bp, sum(n_shared_variants)::BIGINT AS n_sites, count(*) FILTER (WHERE length_bp = 1) AS p FROM segments GROUP BY ALL)
SELECT config, sample_a, sample_b, n_segments, bp, n_sites, round(n_sites * 1000 / nullif(bp, 0), 9) AS per_kb, p / n_segments AS point_share FROM c""")
def config_diagnostics(s, d):
    seg = segments(s, d).withColumn("config", F.col("n_shared_variants") % 2)
    return E.config_diagnostics(seg, "config").withColumn("per_kb", F.round("per_kb", 9))


@query(f"""WITH {D.SEGMENTS}, g AS (SELECT concat_ws('-', sample_a, sample_b, chrom, start_pos) AS seg, * FROM segments),
j AS (SELECT seg, sample_a, sample_b, g.chrom, a.pos, a.dosage AS x, b.dosage AS y FROM g JOIN geno a ON a.sample_id = sample_a AND a.chrom = g.chrom AND a.pos BETWEEN start_pos AND end_pos JOIN geno b ON b.sample_id = sample_b AND b.chrom = g.chrom AND b.pos = a.pos),
l AS (SELECT *, max(CASE WHEN x > 0 AND y > 0 THEN pos END) OVER (PARTITION BY seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM j)
SELECT seg, sample_a, sample_b, chrom, count(*) FILTER (WHERE x > 0 AND y > 0) AS n_both, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL AND (x > 0 OR y > 0)) AS n_either, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_called, max(CASE WHEN x > 0 AND y > 0 THEN pos - p END) AS max_gap FROM l GROUP BY ALL""")
def segment_evidence(s, d):
    g = stored(D.genotypes(s, d))  # read for the segments and for their evidence, made once
    seg = segments(s, d, g).select(F.concat_ws("-", "sample_a", "sample_b", "chrom", "start_pos").alias("seg"), "sample_a", "sample_b", "chrom", F.col("start_pos").alias("lo"), F.col("end_pos").alias("hi"))
    return E.segment_evidence(seg, g, 50_000)


KNOWN = LABELS + ", lk AS (SELECT * FROM lab WHERE community IS NOT NULL)"


def known(s, d):
    return labels(s, d).filter("community is not null")


@query(f"""WITH {D.PAIRS}, {KNOWN}, z AS (SELECT community, count(*) AS n FROM lk GROUP BY community), m AS (SELECT a.community, median(total_shared_bp) AS m FROM pairs JOIN lk a ON a.node = sample_a JOIN lk b ON b.node = sample_b WHERE a.community = b.community GROUP BY 1)
SELECT 'pair' AS kind, sample_a AS a, sample_b AS b, NULL::BIGINT AS community FROM pairs WHERE max_segment_bp >= 80000 UNION ALL SELECT 'community', NULL, NULL, community FROM m JOIN z USING (community) WHERE m >= 30000 AND n <= 60""")
def kin_candidates(s, d):
    return E.kin_candidates(summary(s, d), known(s, d), 80_000, 60, 30_000)


@query(f"""WITH {D.PAIRS}, {KNOWN}, j AS (SELECT a.community AS ca, b.community AS cb, total_shared_bp AS w FROM pairs JOIN lk a ON a.node = sample_a JOIN lk b ON b.node = sample_b),
i AS (SELECT ca AS community, median(w) AS within FROM j WHERE ca = cb GROUP BY 1), o AS (SELECT community, median(w) AS between_ FROM (SELECT ca AS community, w FROM j WHERE ca <> cb UNION ALL SELECT cb, w FROM j WHERE ca <> cb) GROUP BY 1), n AS (SELECT community, count(*) AS n FROM lk GROUP BY 1)
SELECT community, n, within, between_ AS "between", within / between_ AS ratio FROM n JOIN i USING (community) JOIN o USING (community) WHERE n >= 5 AND within / between_ >= 0.9""")
def founder_candidates(s, d):
    return E.founder_candidates(summary(s, d), known(s, d), 5, 0.9)


@query(None)
def ancestry_names(s, d):
    w = customers(s, d).groupBy((F.col("nation") % 5).alias("file"), F.col("seg").alias("label")).agg(F.avg("spent").alias("w"))
    return E.ancestry_names(w, 5).withColumn("enrichment", F.round("enrichment", 4))


@query(f"""WITH {D.PAIRS}, r AS (SELECT sample_a % 10 AS x, sample_b % 10 AS y, total_shared_bp - avg(total_shared_bp) OVER () AS u FROM pairs), c AS (SELECT least(x, y) AS ca, greatest(x, y) AS cb, sum(u) AS u FROM r GROUP BY ALL),
i AS (SELECT c, sum(u) AS u FROM (SELECT ca AS c, u FROM c UNION ALL SELECT cb, u FROM c WHERE ca <> cb) GROUP BY c)
SELECT (SELECT count(*) FROM pairs) AS n, round((SELECT avg(total_shared_bp) FROM pairs), 6) AS mean, round(((SELECT sum(u * u) FROM i) - (SELECT sum(u * u) FROM c WHERE ca <> cb)) / power((SELECT count(*) FROM pairs), 2), 3) AS variance""")
def dyadic_variance(s, d):
    c = nodes(s, d).withColumn("component", F.col("node") % 10)
    return E.dyadic_variance(summary(s, d), c, "total_shared_bp").select("n", F.round("mean", 6).alias("mean"), F.round("variance", 3).alias("variance"))


@query(f"""WITH {KIN}, pt AS (SELECT 'four' AS partition, node, node % 4 AS community FROM (SELECT DISTINCT sample_id AS node FROM geno) UNION ALL SELECT 'seven', node, node % 7 FROM (SELECT DISTINCT sample_id AS node FROM geno)),
j AS (SELECT a.partition, CASE WHEN a.community = b.community THEN 'within' ELSE 'between' END AS side, CASE WHEN kin IS NULL THEN 'unknown' WHEN kin >= 0.0442 THEN 'related' ELSE 'unrelated' END AS relation, total_shared_bp AS w
  FROM pairs JOIN kn USING (sample_a, sample_b) JOIN pt a ON a.node = sample_a JOIN pt b ON b.node = sample_b AND b.partition = a.partition)
SELECT partition, relation, side, count(*) AS n_pairs, sum(w)::BIGINT AS bp FROM (SELECT * FROM j UNION ALL SELECT partition, side, 'ALL', w FROM j) GROUP BY ALL""")
def sharing_by_partition(s, d):
    n = nodes(s, d)
    p = n.select(F.lit("four").alias("partition"), "node", (F.col("node") % 4).alias("community")).unionByName(n.select(F.lit("seven").alias("partition"), "node", (F.col("node") % 7).alias("community")))
    return E.sharing_by_partition(summary(s, d), p, kin(s, d).filter("kin is not null"))


@query(f"""WITH {D.INTERVALS}, v AS (SELECT contig, label, part % 2 = 0 AS same, lo, hi FROM iv), b AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY contig, label, same ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM v),
c AS (SELECT *, sum(new) OVER (PARTITION BY contig, label, same ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM b), u AS (SELECT contig, label, same, max(hi) - min(lo) + 1 AS bp FROM c GROUP BY contig, label, same, k), t AS (SELECT contig, label, same, sum(bp) AS bp FROM u GROUP BY ALL)
SELECT same, count(*) AS n_pairs, sum(bp)::BIGINT AS bp FROM t GROUP BY same""")
def copy_territory(s, d):
    v = D.intervals(s, d).withColumn("same", F.col("part") % 2 == 0)
    return E.territory(v, ["contig", "label"], "same")


@query(f"""WITH {D.GENO}, p AS (SELECT DISTINCT sample_id FROM geno)
SELECT sample_id, CASE WHEN sample_id % 3 <> 0 THEN sample_id % 4 END AS community, sample_id % 3 <> 0 AS has_community, CASE WHEN sample_id % 5 <> 0 THEN sample_id % 11 END AS grp, sample_id % 5 <> 0 AS has_group, c_mktsegment AS seg, c_custkey IS NOT NULL AS has_metadata
FROM p LEFT JOIN customer ON c_custkey = sample_id""")
def modeling_master(s, d):
    n = nodes(s, d).withColumnRenamed("node", "sample_id")
    meta = D.table(s, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("seg"))
    return E.modeling_master(n, n.filter("sample_id % 3 <> 0").withColumn("community", F.col("sample_id") % 4), n.filter("sample_id % 5 <> 0").withColumn("grp", F.col("sample_id") % 11), meta)


@query(f"""WITH {CUST}, p AS (SELECT seg, n_orders AS x, (n_orders * 7 + id % 5) AS y FROM cu WHERE n_orders > 0), q AS (SELECT seg AS scope, x, y FROM p UNION ALL SELECT 'ALL', x, y FROM p),
r AS (SELECT scope, x, y, rank() OVER (PARTITION BY scope ORDER BY x) + (count(*) OVER (PARTITION BY scope, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY scope ORDER BY y) + (count(*) OVER (PARTITION BY scope, y) - 1) / 2 AS ry FROM q)
SELECT scope, count(*) AS n, round(corr(rx, ry), 6) AS spearman, round(median(abs(y - x) / x), 6) AS relative_change FROM r GROUP BY scope""")
def compare_configs(s, d):
    c = customers(s, d).filter("n_orders > 0")
    out = E.compare_configs(c.select("id", "seg", F.col("n_orders").alias("v")), c.select("id", (F.col("n_orders") * 7 + F.col("id") % 5).alias("v")), ["id"], "v", "seg")
    return out.withColumns({"spearman": F.round("spearman", 6), "relative_change": F.round("relative_change", 6)})


@query(f"""WITH {D.INTERVALS}, x AS (SELECT label AS file, contig AS chrom, lo, hi, record % 300 AS id1, part AS id2 FROM iv)
SELECT coalesce(file, 'ALL') AS file, coalesce(chrom::VARCHAR, 'ALL') AS chrom, count(*) AS n, count(*) FILTER (WHERE id1 < 150 AND id2 < 6) AS n_known, min(lo) AS first, max(hi) AS last, min(hi - lo + 1) AS shortest, max(hi - lo + 1) AS longest FROM x GROUP BY ROLLUP (file, chrom)""")
def ibd_inventory(s, d):
    v = D.intervals(s, d).select(F.col("label").alias("file"), F.col("contig").alias("chrom"), "lo", "hi", (F.col("record") % 300).alias("id1"), F.col("part").alias("id2"))
    ids1 = v.filter("id1 < 150 or id1 < 6").select(F.col("id1").alias("sample_id")).distinct()
    # people are one universe: both sides use it, so second ids are lifted out of the way when unknown
    w = v.withColumn("id2", F.when(F.col("id2") < 6, F.col("id2")).otherwise(F.col("id2") + 1000))
    ids = ids1.unionByName(w.filter("id2 < 6").select(F.col("id2").alias("sample_id"))).distinct()
    return E.ibd_inventory(w, ids)


@query(f"""WITH {D.INTERVALS}, r AS (SELECT contig AS sample_id, lo, hi, CASE WHEN part = 3 THEN (hi - lo + 2) / 1000 ELSE (hi - lo + 1) / 1000 END AS kb FROM iv WHERE contig % 5 <> 0)
SELECT 'length' AS rule, count(*) FILTER (WHERE abs(kb - (hi - lo + 1) / 1000) > 0.0005) AS n FROM r UNION ALL SELECT 'unknown_person', count(DISTINCT sample_id) FILTER (WHERE sample_id % 3 = 0) FROM r
UNION ALL SELECT 'without_roh', count(DISTINCT contig) FROM iv WHERE contig % 3 <> 0 AND contig NOT IN (SELECT sample_id FROM r)""")
def roh_checks(s, d):
    v = D.intervals(s, d)
    r = v.filter("contig % 5 <> 0").select(F.col("contig").alias("sample_id"), "lo", "hi", (F.when(F.col("part") == 3, F.col("hi") - F.col("lo") + 2).otherwise(F.col("hi") - F.col("lo") + 1) / 1000).alias("kb"))
    return E.check_roh(r, v.filter("contig % 3 <> 0").select(F.col("contig").alias("sample_id")))


@query(f"""WITH {D.GENO}, m AS (SELECT sample_id, count(*) FILTER (WHERE dosage IS NULL) AS n_missing, count(*) AS n_sites FROM geno GROUP BY sample_id), p AS (SELECT *, n_missing / n_sites + CASE WHEN sample_id % 10 = 0 THEN 0.01 ELSE 0 END AS f_miss FROM m)
SELECT sample_id, n_missing, n_sites FROM p WHERE abs(f_miss - n_missing / n_sites) > 5e-7""")
def missingness_checks(s, d):
    m = D.genotypes(s, d).groupBy("sample_id").agg(F.count_if(F.col("dosage").isNull()).alias("n_missing"), F.count("*").alias("n_sites"))
    m = m.withColumn("f_miss", F.col("n_missing") / F.col("n_sites") + F.when(F.col("sample_id") % 10 == 0, 0.01).otherwise(0.0))
    return E.check_missingness(m).select("sample_id", "n_missing", "n_sites")


@query(f"""WITH {D.GENO}, {KNOWN}, f AS (SELECT community, node % 13 AS family FROM lk WHERE node % 8 <> 0), n AS (SELECT community, family, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT community, sum(n) AS n, count(*) AS n_families, max(n) AS top, sum(n * (n - 1) / 2) AS same FROM n GROUP BY community)
SELECT community, n::BIGINT AS n, n_families, top / n AS top_share, same / nullif(n * (n - 1) / 2, 0) AS same_family_pairs FROM t""")
def family_concentration(s, d):
    fam = nodes(s, d).select("node", F.when(F.col("node") % 8 != 0, F.col("node") % 13).alias("family"))
    return E.family_concentration(known(s, d), fam)


@query(f"""WITH {D.GENO}, l AS (SELECT chrom, pos, count(*) FILTER (WHERE dosage > 0) AS n FROM geno GROUP BY ALL), u AS (SELECT chrom, pos, sample_id % 3 AS code, count(*) FILTER (WHERE dosage IS NOT NULL) AS n FROM geno GROUP BY ALL), t AS (SELECT chrom, pos, sum(n) AS t FROM u GROUP BY ALL)
SELECT l.chrom, l.pos // 100000 AS window_id, code, round(sum(l.n * u.n / nullif(t, 0)), 6) AS burden, count(*) AS n_loci FROM l JOIN u USING (chrom, pos) JOIN t USING (chrom, pos) GROUP BY ALL""")
def support_burden(s, d):
    g = D.genotypes(s, d)
    loci = g.groupBy("chrom", "pos").agg(F.count_if(F.col("dosage") > 0).alias("n"))
    sup = g.groupBy("chrom", "pos", (F.col("sample_id") % 3).alias("code")).agg(F.count("dosage").alias("n"))
    return E.support_burden(loci, sup, 100_000).withColumn("burden", F.round("burden", 6))


@query(f"""WITH {TRUTH}, x AS (SELECT CASE truth WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS t, CASE call WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS c FROM tr), r AS (SELECT unnest(range(0, 6)) AS k),
s AS (SELECT k, (SELECT count(*) FROM x WHERE t = k) AS sup, (SELECT count(*) FROM x WHERE t = k AND c = k) AS hit, (SELECT count(*) FROM x WHERE c = k) AS called FROM r)
SELECT sum(sup)::BIGINT AS n, avg(2 * hit / greatest(sup + called, 1)) FILTER (WHERE sup > 0) AS supported_f1, CASE WHEN min(sup) > 0 THEN avg(2 * hit / greatest(sup + called, 1)) END AS fixed_f1 FROM s""")
def diploid_scores(s, d):
    code = lambda c: F.when(F.col(c) == "A", 0).when(F.col(c) == "N", 1).when(F.col(c) == "R", 2).cast("long")
    return E.diploid_scores(truth(s, d).select(code("truth").alias("t"), code("call").alias("c")), "t", "c", 6)


@query(None)
def stratified_bootstrap(s, d):
    out = E.stratified_bootstrap(customers(s, d), "seg", "nation", "bal", 200)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(None)
def pc_relate(s, d):
    c = nodes(s, d).select(F.col("node").alias("sample_id"), (F.col("node") % 7 / 7).alias("pc1"), (F.col("node") % 5 / 5).alias("pc2"))
    g = D.genotypes(s, d)
    return E.pc_relate(g, c, ["pc1", "pc2"]).withColumn("kinship", F.round("kinship", 6))


@query(f"""WITH {D.GENO}, c AS (SELECT f AS fold, sample_id, chrom, floor((pos - 1) / 100000)::BIGINT AS window_id, dosage, pos FROM geno, (SELECT unnest(range(0, 3)) AS f)),
q AS (SELECT f AS fold, chrom, pos, sum(dosage) AS ac, 2 * count(dosage) AS an FROM geno, (SELECT unnest(range(0, 3)) AS f) WHERE sample_id % 3 <> f GROUP BY ALL),
se AS (SELECT fold, chrom, pos, ac * 2 < an AS alt FROM q WHERE an > 0 AND 2 * ac <> an AND least(ac, an - ac) * 5 <= 2 * an AND least(ac, an - ac) >= 2)
SELECT c.fold, sample_id, c.chrom, window_id, sample_id % 3 = c.fold AS held_out, count(dosage) AS n_called, coalesce(sum(CASE WHEN alt THEN dosage ELSE 2 - dosage END), 0)::BIGINT AS rare_dosage FROM c JOIN se ON se.fold = c.fold AND se.chrom = c.chrom AND se.pos = c.pos GROUP BY ALL""")
def fold_window_features(s, d):
    """Rare sites are chosen on each fold's training people and applied to everybody."""
    from ..operators import variants as V

    g = D.genotypes(s, d).withColumn("fold", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    site = g.filter("sample_id % 3 <> fold").groupBy("fold", "chrom", "pos").agg(F.coalesce(F.sum("dosage"), F.lit(0)).alias("ac"), (2 * F.count("dosage")).alias("an"))
    site = site.withColumns({"orig_nalleles": F.lit(2), "ref": F.lit("A"), "alt": F.lit("C")})
    chosen = V.select_rare_minor(site, 2, 5, 2).select("fold", "chrom", "pos", "rare_allele")
    j = g.join(chosen, ["fold", "chrom", "pos"])
    rare = F.when(F.col("rare_allele") == 1, F.col("dosage")).otherwise(2 - F.col("dosage"))
    return j.groupBy("fold", "sample_id", "chrom", F.floor((F.col("pos") - 1) / 100_000).alias("window_id"), (F.col("sample_id") % 3 == F.col("fold")).alias("held_out")).agg(F.count("dosage").alias("n_called"), F.coalesce(F.sum(rare), F.lit(0)).alias("rare_dosage"))
