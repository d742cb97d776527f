"""Queries of pair, summary and window operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import summaries as S
from ..operators import windows as W
from . import domain as D

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def carriers(s, d, g=None):
    return (D.genotypes(s, d) if g is None else g).filter("dosage > 0").select("sample_id", "chrom", "pos")


def segments(s, d, g=None):
    return P.pair_segments(carriers(s, d, g), D.MAX_GAP, D.MIN_SITES)


def summary(s, d):
    return P.pair_summary(segments(s, d))


@query(f"WITH {D.PAIRS} SELECT * FROM pairs ORDER BY total_shared_bp DESC, sample_a, sample_b LIMIT 20")
def top_sharing_pairs(s, d):
    return P.top_pairs(summary(s, d), 20)


@query(f"WITH {D.SEGMENTS} SELECT sample_a, sample_b, chrom, start_pos, end_pos, length_bp, n_shared_variants, 1.0::DOUBLE AS jaccard FROM segments")
def pair_segments(s, d):
    return segments(s, d)


@query(f"WITH {D.PAIRS} SELECT * FROM pairs")
def pair_summary(s, d):
    return summary(s, d)


@query(f"""WITH {D.SEGMENTS}, e AS (SELECT sample_a AS id, sample_b AS other, chrom, length_bp FROM segments UNION ALL SELECT sample_b, sample_a, chrom, length_bp FROM segments)
SELECT id AS sample_id, count(DISTINCT other) AS n_sharing_partners, count(*) AS n_segments_involved, sum(length_bp)::BIGINT AS total_shared_bp, count(DISTINCT chrom) AS n_chromosomes_with_sharing FROM e GROUP BY id""")
def individual_summary(s, d):
    return P.individual_summary(segments(s, d))


@query("""WITH p AS (SELECT l_suppkey % 50 AS x, l_partkey % 50 AS y, l_quantity AS cm FROM lineitem)
SELECT least(x, y) AS sample_a, greatest(x, y) AS sample_b, sum(cm) AS total, count(*) AS n, max(cm) AS longest FROM p WHERE x <> y GROUP BY ALL""")
def ibd_pairs(s, d):
    p = D.table(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("x"), (F.col("l_partkey") % 50).alias("y"), F.col("l_quantity").alias("cm"))
    return P.weighted_pairs(p, "cm", "x", "y")


EVIDENCE = f"""WITH {D.GENO}, v AS (SELECT count(*) AS sites FROM (SELECT DISTINCT chrom, pos FROM geno)),
j AS (SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, a.dosage AS x, b.dosage AS y FROM geno a JOIN geno b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample_id < b.sample_id),
k AS (SELECT sample_a, sample_b, count(*) FILTER (WHERE x > 0 AND y > 0) AS n_both, count(*) FILTER (WHERE x IS NULL AND y IS NULL) AS n_blank,
  count(*) FILTER (WHERE (x > 0 AND y IS NULL) OR (x IS NULL AND y > 0)) AS n_lost FROM j GROUP BY ALL HAVING n_both + n_blank + n_lost > 0),
o AS (SELECT sample_id, count(*) FILTER (WHERE dosage > 0) AS c, count(*) FILTER (WHERE dosage IS NULL) AS m FROM geno GROUP BY sample_id),
e AS (SELECT sample_a, sample_b, n_both, a.c + b.c - n_lost - n_both AS n_either, sites - a.m - b.m + n_blank AS n_called
  FROM k JOIN o a ON a.sample_id = sample_a JOIN o b ON b.sample_id = sample_b, v)"""


def evidence(s, d):
    return P.pair_evidence(D.genotypes(s, d))


@query(EVIDENCE + " SELECT * FROM e")
def pair_evidence(s, d):
    return evidence(s, d)


@query(EVIDENCE + " SELECT *, n_both / nullif(n_either, 0) AS jaccard FROM e")
def masked_jaccard(s, d):
    return P.masked_jaccard(evidence(s, d))


@query(f"""WITH {D.PAIRS}, g AS (SELECT sample_id, sample_id % 7 AS grp FROM (SELECT DISTINCT sample_id FROM geno)),
n AS (SELECT grp, count(*) AS n FROM g GROUP BY grp), o AS (SELECT sample_a % 7 AS grp, count(*) AS observed FROM pairs WHERE sample_a % 7 = sample_b % 7 GROUP BY 1)
SELECT grp, n, (n * (n - 1)) // 2 AS possible, coalesce(observed, 0) AS observed, (n * (n - 1)) // 2 - coalesce(observed, 0) AS unknown FROM n LEFT JOIN o USING (grp)""")
def dyad_universe(s, d):
    g = D.genotypes(s, d).select("sample_id", (F.col("sample_id") % 7).alias("grp")).distinct()
    o = summary(s, d).filter("sample_a % 7 = sample_b % 7").select((F.col("sample_a") % 7).alias("grp"))
    return P.dyad_universe(g, o, "grp")


@query(f"""WITH {D.PAIRS}, n AS (SELECT DISTINCT sample_id, c_nationkey AS nation, c_mktsegment AS seg FROM geno JOIN customer ON c_custkey = sample_id)
SELECT a.nation, a.seg, a.sample_id AS sample_a, b.sample_id AS sample_b, total_shared_bp FROM n a JOIN n b ON a.nation = b.nation AND a.seg = b.seg AND a.sample_id < b.sample_id
LEFT JOIN pairs p ON p.sample_a = a.sample_id AND p.sample_b = b.sample_id""")
def pair_universe(s, d):
    """All pairs of one nation and market segment."""
    c = D.table(s, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"))
    return P.pair_universe(D.genotypes(s, d).select("sample_id").distinct().join(c, "sample_id"), summary(s, d), "total_shared_bp", ["nation", "seg"])


@query(f"""WITH {D.GENO}, j AS (SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, a.dosage AS x, b.dosage AS y FROM geno a JOIN geno b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample_id < b.sample_id
  WHERE a.dosage IS NOT NULL AND b.dosage IS NOT NULL),
k AS (SELECT sample_a, sample_b, count(*) FILTER (WHERE x = 1 AND y = 1) AS n_het_het, count(*) FILTER (WHERE abs(x - y) = 2) AS n_ibs0, count(*) FILTER (WHERE x = 1) AS n_het_a, count(*) FILTER (WHERE y = 1) AS n_het_b, count(*) AS n_called FROM j GROUP BY ALL)
SELECT *, (n_het_het - 2 * n_ibs0) / nullif(n_het_a + n_het_b, 0) AS kinship FROM k""")
def king_robust(s, d):
    return P.king_robust(D.genotypes(s, d))


@query(f"""WITH {D.GENO} SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, sum(a.dosage * b.dosage)::BIGINT AS gram
FROM geno a JOIN geno b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample_id <= b.sample_id WHERE a.dosage > 0 AND b.dosage > 0 GROUP BY ALL""")
def pair_gram(s, d):
    return P.pair_gram(D.genotypes(s, d))


@query(f"""WITH {D.GENO}, b AS (SELECT dosage AS d, CASE WHEN (pos // 1000 + sample_id) % 4 < 3 THEN (pos // 1000 + sample_id) % 4 END AS a FROM geno)
SELECT d AS dosage, a AS ancestry, CASE WHEN d IS NOT NULL AND a IS NOT NULL THEN greatest(0, d + a - 2) END AS low, CASE WHEN d IS NOT NULL AND a IS NOT NULL THEN least(d, a) END AS high,
  CASE WHEN d IS NULL AND a IS NULL THEN 'MISSING_BOTH' WHEN d IS NULL THEN 'MISSING_GT' WHEN a IS NULL THEN 'MISSING_ANCESTRY' WHEN greatest(0, d + a - 2) = least(d, a) THEN 'EXACT' ELSE 'BAND' END AS state, count(*) AS n
FROM b GROUP BY ALL""")
def dose_bands(s, d):
    k = (F.floor(F.col("pos") / 1000) + F.col("sample_id")) % 4
    g = D.genotypes(s, d).withColumn("ancestry", F.when(k < 3, k))
    return P.dose_bands(g, "dosage", "ancestry").groupBy("dosage", "ancestry", "low", "high", "state").agg(F.count("*").alias("n"))


@query(f"""WITH {D.SEGMENTS}, c AS (SELECT n_shared_variants % 2 AS config, sample_a, sample_b, sum(length_bp)::BIGINT AS bp FROM segments GROUP BY ALL), t AS (SELECT unnest([1, 50000, 100000]) AS min_bp)
SELECT config, min_bp::BIGINT AS min_bp, count(*) AS n_pairs, sum(bp)::BIGINT AS total_bp FROM c, t WHERE bp >= min_bp GROUP BY ALL""")
def close_then_filter(s, d):
    seg = segments(s, d).withColumn("config", F.col("n_shared_variants") % 2)
    return P.close_then_filter(seg, s.createDataFrame([(1,), (50_000,), (100_000,)], "min_bp long"), "config")


@query(f"""WITH {D.PAIRS}, k AS (SELECT sample_a, sample_b, (sample_a * 31 + sample_b) % 100 / 200 AS kin FROM pairs WHERE (sample_a + sample_b) % 3 <> 0)
SELECT CASE WHEN kin IS NULL THEN 'missing' WHEN kin >= 0.25 THEN 'related' ELSE 'unrelated' END AS relation, count(*) AS n_pairs, sum(total_shared_bp)::BIGINT AS total_shared_bp
FROM pairs LEFT JOIN k USING (sample_a, sample_b) GROUP BY 1""")
def kin_partition(s, d):
    p = summary(s, d)
    kin = p.filter("(sample_a + sample_b) % 3 <> 0").select("sample_a", "sample_b", ((F.col("sample_a") * 31 + F.col("sample_b")) % 100 / 200).alias("kin"))
    return P.kin_partition(p, kin, 0.25, "total_shared_bp")


# --- summaries

QC = f"""WITH {D.SITES}, e AS (SELECT chrom, pos, 1 - 2 * (ac / an) * (1 - ac / an) * an / (an - 1) AS e FROM sites WHERE an > 1 AND ac > 0 AND ac < an),
q AS (SELECT sample_id, count(*) AS n_sites, count(*) FILTER (WHERE dosage IS NULL) AS n_missing, count(*) FILTER (WHERE dosage <> 1 AND e IS NOT NULL) AS o_hom,
  sum(e) FILTER (WHERE dosage IS NOT NULL) AS e_hom, count(*) FILTER (WHERE dosage IS NOT NULL AND e IS NOT NULL) AS n_used FROM geno LEFT JOIN e USING (chrom, pos) GROUP BY sample_id)"""


def qc(s, d):
    return S.sample_qc(D.genotypes(s, d), D.sites(s, d))


@query(QC + " SELECT sample_id, n_sites, n_missing, o_hom, round(e_hom, 6) AS e_hom, n_used, round(n_missing / n_sites, 9) AS f_miss, round((o_hom - e_hom) / nullif(n_used - e_hom, 0), 6) AS f FROM q")
def sample_qc(s, d):
    return qc(s, d).withColumns({"e_hom": F.round("e_hom", 6), "f_miss": F.round("f_miss", 9), "f": F.round("f", 6)})


@query(QC + """, r AS (SELECT sample_id, n_missing / n_sites AS f_miss FROM q), m AS (SELECT avg(f_miss) AS m, stddev_pop(f_miss) AS s FROM r)
SELECT sample_id, round(f_miss, 9) AS f_miss, (abs(f_miss - m) > 2 * s OR f_miss > 0.2) AS f_miss_flag FROM r, m""")
def qc_report(s, d):
    return S.qc_flags(qc(s, d).select("sample_id", "f_miss"), ["f_miss"], 2.0, f_miss=0.2).withColumn("f_miss", F.round("f_miss", 9))


@query(f"""WITH {D.SITES}, c AS (SELECT chrom, count(*) AS records, count(*) AS snps, count(*) FILTER (WHERE ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS ti FROM sites GROUP BY chrom)
SELECT *, records - ti AS tv, ti / nullif(records - ti, 0) AS ti_tv FROM c""")
def site_stats(s, d):
    return S.site_stats(D.sites(s, d), ["chrom"])


@query(f"""WITH {D.SITES}, r AS (SELECT chrom, pos FROM sites WHERE an > 0 AND least(ac, an - ac) * 5 <= 2 * an),
c AS (SELECT sample_id, count(*) FILTER (WHERE dosage = 0) AS n_ref_hom, count(*) FILTER (WHERE dosage = 1) AS n_het, count(*) FILTER (WHERE dosage = 2) AS n_alt_hom, count(*) FILTER (WHERE dosage IS NULL) AS n_missing FROM geno JOIN r USING (chrom, pos) GROUP BY sample_id)
SELECT *, n_het + 2 * n_alt_hom AS rare_dosage, (n_het + 2 * n_alt_hom) / nullif(n_ref_hom + n_het + n_alt_hom, 0) AS density FROM c""")
def rare_density(s, d):
    return S.rare_density(D.genotypes(s, d), D.sites(s, d).filter("an > 0 and least(ac, an - ac) * 5 <= 2 * an"))


def _sfs_sql(folded: bool) -> str:
    count, scale, top = ("least(ac, an - ac)", 20, 0.5) if folded else ("ac", 10, 1.0)
    return f"""WITH {D.SITES}, b AS (SELECT least(({count} * {scale}) // an, 9) AS bin FROM sites WHERE an > 0 AND an * 20 >= 400)
SELECT r.bin::BIGINT AS bin, r.bin * {top / 10}::DOUBLE AS lo, (r.bin + 1) * {top / 10}::DOUBLE AS hi, count(b.bin) AS n FROM (SELECT unnest(range(0, 10)) AS bin) r LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin"""


@query(_sfs_sql(True))
def sfs_folded(s, d):
    return S.sfs(D.sites(s, d), 10, 200, (1, 20), True)


@query(_sfs_sql(False))
def sfs_unfolded(s, d):
    return S.sfs(D.sites(s, d), 10, 200, (1, 20), False)


@query(f"""WITH {D.SITES}, p AS (SELECT *, CASE WHEN pos // 1000 % 3 = 0 THEN 'ok_ref' WHEN pos // 1000 % 3 = 1 THEN 'ok_alt' ELSE 'mismatch' END AS status FROM sites)
SELECT chrom, pos, status, CASE WHEN status = 'ok_ref' THEN ac ELSE an - ac END AS dac, CASE WHEN status = 'ok_ref' THEN ac ELSE an - ac END / an AS daf FROM p WHERE status <> 'mismatch' AND an > 0""")
def derived_allele_counts(s, d):
    k = F.floor(F.col("pos") / 1000) % 3
    p = D.sites(s, d).withColumn("status", F.when(k == 0, "ok_ref").when(k == 1, "ok_alt").otherwise("mismatch"))
    return S.derived_counts(p).select("chrom", "pos", "status", "dac", "daf")


LD = f"""WITH {D.GENO}, g AS (SELECT * FROM geno WHERE dosage IS NOT NULL),
j AS (SELECT a.chrom, a.pos AS pos_a, b.pos AS pos_b, count(*) AS n, sum(a.dosage) AS sx, sum(b.dosage) AS sy, sum(a.dosage * b.dosage) AS sxy, sum(a.dosage * a.dosage) AS sxx, sum(b.dosage * b.dosage) AS syy
  FROM g a JOIN g b ON a.sample_id = b.sample_id AND a.chrom = b.chrom AND a.pos < b.pos AND b.pos - a.pos <= 20000 GROUP BY ALL),
l AS (SELECT chrom, pos_a, pos_b, n, ((n * sxy - sx * sy) * (n * sxy - sx * sy))::DOUBLE / nullif(((n * sxx - sx * sx) * (n * syy - sy * sy))::DOUBLE, 0) AS r2 FROM j)"""


@query(LD + " SELECT chrom, pos_a, pos_b, n, round(r2, 9) AS r2 FROM l")
def ld_pairs(s, d):
    return S.ld_pairs(D.genotypes(s, d), ["chrom"], 20_000).withColumn("r2", F.round("r2", 9))


@query(LD + " SELECT (pos_b - pos_a) // 5000 * 5000 AS bin, count(*) AS n, round(avg(r2), 9) AS mean_r2, round(median(r2), 9) AS median_r2 FROM l WHERE r2 IS NOT NULL GROUP BY 1")
def ld_decay(s, d):
    p = S.ld_pairs(D.genotypes(s, d), ["chrom"], 20_000)
    return S.ld_decay(p, 5000).withColumns({"mean_r2": F.round("mean_r2", 9), "median_r2": F.round("median_r2", 9)})


COMP = """WITH p AS (SELECT c_nationkey::BIGINT AS grp, CASE WHEN c_custkey % 11 = 0 THEN 'MISSING' ELSE c_mktsegment END AS level FROM customer),
n AS (SELECT grp, level, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT g.grp, l.level, coalesce(n, 0) AS n, coalesce(n, 0) / t AS fraction FROM (SELECT grp, count(*) AS t FROM p GROUP BY grp) g CROSS JOIN (SELECT DISTINCT level FROM p) l LEFT JOIN n USING (grp, level))"""


def people(s, d):
    return D.table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("grp"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("level"))


@query(COMP + " SELECT * FROM c")
def composition(s, d):
    return S.composition(people(s, d), "grp", "level")


@query(COMP + " SELECT grp, CASE WHEN n < 10 THEN 'SUPPRESSED' ELSE level END AS level, sum(n)::BIGINT AS n FROM c GROUP BY ALL")
def suppressed_composition(s, d):
    return S.suppressed(S.composition(people(s, d), "grp", "level"), "grp", "level", 10)


@query(COMP + """, k AS (SELECT grp, sum(n) AS t, sum(n * n) AS q, max(n) AS m FROM n GROUP BY grp)
SELECT grp, t::BIGINT AS n, q / (t * t) AS hhi, t * t / q AS effective, m / t AS top_fraction FROM k""")
def concentration(s, d):
    return S.concentration(people(s, d).na.fill({"level": "MISSING"}), "grp", "level")


@query("""SELECT l_returnflag AS flag, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS sd, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25,
round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1""")
def distribution(s, d):
    out = S.distribution(D.table(s, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), "l_extendedprice", ["flag"])
    return out.select("flag", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("flag", "n")])


@query(f"""WITH {D.GENO}, r AS (SELECT *, CASE WHEN sample_id % 5 = 0 THEN 'test' ELSE 'train' END AS role FROM geno), x AS (SELECT * FROM r UNION ALL SELECT sample_id, chrom, pos, dosage, 'ALL' FROM geno)
SELECT role, chrom, pos, count(dosage) AS n_called, count(*) - count(dosage) AS n_missing, coalesce(sum(dosage), 0)::BIGINT AS ac, 2 * count(dosage) AS an, count(*) FILTER (WHERE dosage > 0) AS n_carriers, count(*) FILTER (WHERE dosage = 2) AS n_hom FROM x GROUP BY ALL""")
def genotype_support(s, d):
    g = D.genotypes(s, d)
    roles = g.select("sample_id").distinct().withColumn("role", F.when(F.col("sample_id") % 5 == 0, "test").otherwise("train"))
    return S.genotype_support(g, roles)


@query(f"WITH {D.GENO} SELECT chrom, pos, count(*) FILTER (WHERE dosage = 0) AS n_0, count(*) FILTER (WHERE dosage = 1) AS n_1, count(*) FILTER (WHERE dosage = 2) AS n_2, count(*) FILTER (WHERE dosage IS NULL) AS n_missing FROM geno GROUP BY ALL")
def genotype_counts(s, d):
    return S.genotype_counts(D.genotypes(s, d))


@query(f"""WITH {D.GENO}, o AS (SELECT sample_id, chrom, pos, CASE WHEN (sample_id + pos // 1000) % 10 = 0 THEN 2 - dosage ELSE dosage END AS d2 FROM geno WHERE dosage IS NOT NULL AND pos // 1000 % 4 <> 0),
c AS (SELECT sample_id, count(*) AS n_joint, count(*) FILTER (WHERE dosage = d2) AS n_same FROM geno JOIN o USING (sample_id, chrom, pos) WHERE dosage IS NOT NULL GROUP BY sample_id)
SELECT *, n_same / n_joint AS concordance FROM c""")
def sample_concordance(s, d):
    g = D.genotypes(s, d)
    k = F.floor(F.col("pos") / 1000)
    other = g.filter((k % 4 != 0) & F.col("dosage").isNotNull()).withColumn("dosage", F.when((F.col("sample_id") + k) % 10 == 0, 2 - F.col("dosage")).otherwise(F.col("dosage")))
    return S.concordance(g, other, "sample_id")


PANEL = f"""WITH {D.SITES}, panel AS (SELECT chrom, pos, CASE WHEN pos // 1000 % 7 = 0 THEN alt ELSE ref END AS ref, CASE WHEN pos // 1000 % 5 = 0 THEN 'N' ELSE alt END AS alt, CASE WHEN pos // 1000 % 4 = 0 THEN 0 ELSE ac END AS ac
  FROM sites WHERE pos // 1000 % 11 <> 0),
x AS (SELECT s.chrom, s.pos, s.ref, s.alt, CASE WHEN p.ref IS NULL THEN 'absent' WHEN p.ref <> s.ref THEN 'ref_mismatch' WHEN p.alt <> s.alt THEN 'other_allele' WHEN p.ac > 0 THEN 'carried' ELSE 'monomorphic' END AS state,
  CASE WHEN p.ref = s.ref AND p.alt = s.alt THEN p.ac ELSE 0 END AS panel_ac FROM sites s LEFT JOIN panel p ON p.chrom = s.chrom AND p.pos = s.pos)"""


def presence(s, d):
    t = D.sites(s, d)
    k = F.floor(F.col("pos") / 1000)
    panel = t.filter(k % 11 != 0).select("chrom", "pos", F.when(k % 7 == 0, F.col("alt")).otherwise(F.col("ref")).alias("ref"), F.when(k % 5 == 0, "N").otherwise(F.col("alt")).alias("alt"), F.when(k % 4 == 0, 0).otherwise(F.col("ac")).alias("ac"))
    return S.external_presence(t.select("chrom", "pos", "ref", "alt"), panel)


@query(PANEL + " SELECT * FROM x")
def external_presence(s, d):
    return presence(s, d)


@query(PANEL + """, y AS (SELECT chrom::VARCHAR AS chrom, state FROM x UNION ALL SELECT 'ALL', state FROM x)
SELECT chrom, count(*) AS n, count(*) FILTER (WHERE state = 'carried') AS n_carried, count(*) FILTER (WHERE state = 'monomorphic') AS n_monomorphic, count(*) FILTER (WHERE state = 'other_allele') AS n_other_allele,
  count(*) FILTER (WHERE state = 'ref_mismatch') AS n_ref_mismatch, count(*) FILTER (WHERE state = 'absent') AS n_absent, count(*) FILTER (WHERE state = 'carried') / count(*) AS carried_fraction FROM y GROUP BY chrom""")
def presence_summary(s, d):
    return S.presence_summary(presence(s, d), ["chrom"])


# --- windows

@query(f"""WITH {D.GENO}, c AS (SELECT sample_id, chrom, pos FROM geno WHERE dosage > 0), f AS (SELECT chrom, min(pos) AS p0 FROM c GROUP BY chrom),
w AS (SELECT sample_id, c.chrom, pos, p0 + k * 50000 AS start FROM c JOIN f USING (chrom), LATERAL (SELECT unnest(range(greatest(0, floor((pos - p0 - 100000) / 50000)::BIGINT + 1), (pos - p0) // 50000 + 1)) AS k)),
o AS (SELECT chrom, start, sample_id, count(*) AS c FROM w GROUP BY ALL),
b AS (SELECT x.chrom, x.start, x.sample_id AS sample_a, y.sample_id AS sample_b, count(*) AS n FROM w x JOIN w y ON x.chrom = y.chrom AND x.start = y.start AND x.pos = y.pos AND x.sample_id < y.sample_id GROUP BY ALL),
j AS (SELECT b.*, n / (oa.c + ob.c - n) AS jaccard FROM b JOIN o oa ON oa.chrom = b.chrom AND oa.start = b.start AND oa.sample_id = sample_a JOIN o ob ON ob.chrom = b.chrom AND ob.start = b.start AND ob.sample_id = sample_b),
r AS (SELECT *, row_number() OVER (PARTITION BY chrom, start ORDER BY jaccard DESC, sample_a, sample_b) AS rk FROM j)
SELECT chrom, start, count(*) AS n_pairs, round(avg(jaccard), 9) AS mean_jaccard, round(max(jaccard), 9) AS max_jaccard,
  string_agg(sample_a || '-' || sample_b, ',' ORDER BY rk) FILTER (WHERE rk <= 3) || CASE WHEN count(*) > 3 THEN ',+' || (count(*) - 3) || ' more' ELSE '' END AS top_pairs FROM r GROUP BY chrom, start""")
def sharing_windows(s, d):
    out = W.sharing_windows(carriers(s, d), 100_000, 50_000, 3)
    return out.withColumns({"mean_jaccard": F.round("mean_jaccard", 9), "max_jaccard": F.round("max_jaccard", 9)})


SNPW = f"""WITH {D.SITES}, o AS (SELECT chrom, pos, row_number() OVER w - 1 AS i, lead(pos, 4) OVER w AS e FROM sites WHERE pos // 1000 % 7 <> 0 WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
w AS (SELECT chrom, i // 2 AS window_id, pos AS start, e AS "end", 5 * 1e6 / (e - pos + 1) AS per_mb FROM o WHERE e IS NOT NULL AND i % 2 = 0)"""


def snpw(s, d):
    return W.snp_windows(D.sites(s, d).filter("floor(pos / 1000) % 7 <> 0").select("chrom", "pos"), ["chrom"], 5, 2, 300_000)


@query(SNPW + ' SELECT chrom, window_id, start, "end", round(per_mb, 6) AS per_mb FROM w')
def snp_windows(s, d):
    return snpw(s, d).withColumn("per_mb", F.round("per_mb", 6))


ENR = SNPW + ", q AS (SELECT chrom, quantile_cont(per_mb, 0.6) AS cutoff FROM w GROUP BY chrom), en AS (SELECT w.* FROM w JOIN q USING (chrom) WHERE per_mb >= cutoff)"


@query(ENR + ' SELECT chrom, window_id, start, "end", round(per_mb, 6) AS per_mb FROM en')
def enriched_windows(s, d):
    return W.enriched(snpw(s, d), "per_mb", 0.6, ["chrom"]).withColumn("per_mb", F.round("per_mb", 6))


@query(ENR + """, n AS (SELECT *, CASE WHEN window_id - lag(window_id) OVER (PARTITION BY chrom ORDER BY window_id) > 2 THEN 1 ELSE 0 END AS new FROM en),
t AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY window_id ROWS UNBOUNDED PRECEDING) AS t FROM n)
SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n_windows, round(avg(per_mb), 6) AS mean_score, round(count(*) * 1e6 / (max("end") - min(start) + 1), 6) AS density,
  round((max("end") - min(start)) / 500000, 6) AS length_cm FROM t GROUP BY chrom, t""")
def tracts(s, d):
    """The map is even: 2 cM a Mb."""
    curve = D.sites(s, d).select("chrom", "pos", (F.col("pos") / 500_000).alias("cm"))
    out = W.tracts(W.enriched(snpw(s, d), "per_mb", 0.6, ["chrom"]), ["chrom"], 1, curve)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "density", "length_cm")})


GRID = f"""WITH {D.GENO}, x AS (SELECT *, floor((pos - 1) / 100000)::BIGINT AS window_id FROM geno),
f AS (SELECT sample_id, chrom, window_id, count(dosage) AS n_called, count(*) - count(dosage) AS n_missing, count(*) FILTER (WHERE dosage > 0) AS n_carried, coalesce(sum(dosage), 0)::BIGINT AS dosage_sum FROM x GROUP BY ALL),
g AS (SELECT sample_id, chrom, window_id, coalesce(n_called, 0) AS n_called, coalesce(n_missing, 0) AS n_missing, coalesce(n_carried, 0) AS n_carried, coalesce(dosage_sum, 0) AS dosage_sum
  FROM (SELECT DISTINCT sample_id FROM geno) CROSS JOIN (SELECT DISTINCT chrom, window_id FROM x) LEFT JOIN f USING (sample_id, chrom, window_id))"""


def grid(s, d, factor=1, phase=0):
    g = D.genotypes(s, d)
    return W.grid_features(g, g.select("sample_id").distinct(), 100_000, factor=factor, phase=phase)


@query(GRID + " SELECT *, dosage_sum / nullif(n_called, 0) AS rate FROM g")
def window_features(s, d):
    return grid(s, d)


@query(GRID + """, r AS (SELECT sample_id, chrom, floor((window_id + 1) / 3)::BIGINT AS window_id, sum(n_called)::BIGINT AS n_called, sum(n_missing)::BIGINT AS n_missing, sum(n_carried)::BIGINT AS n_carried, sum(dosage_sum)::BIGINT AS dosage_sum FROM g GROUP BY ALL)
SELECT *, dosage_sum / nullif(n_called, 0) AS rate FROM r""")
def regrid(s, d):
    return grid(s, d, 3, 1)


DIST = f"""WITH {D.GENO}, c AS (SELECT sample_id, chrom, lead(pos, 1) OVER w - pos AS d1, lead(pos, 2) OVER w - pos AS d2 FROM geno WHERE dosage > 0 WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY pos)),
x AS (SELECT chrom, d1 AS distance FROM c WHERE d1 IS NOT NULL UNION ALL SELECT chrom, d2 FROM c WHERE d2 IS NOT NULL)"""


@query(DIST + """ SELECT chrom, greatest(0, least(7, floor((log10(distance) - 3.7) / 0.25)))::BIGINT AS bin, count(*) AS n, count(*) FILTER (WHERE log10(distance) < 3.7) AS n_under, count(*) FILTER (WHERE log10(distance) >= 5.7) AS n_over FROM x GROUP BY ALL""")
def distance_modes(s, d):
    return W.log_histogram(W.nearest_distances(carriers(s, d), ["sample_id", "chrom"], 2), ["chrom"], 3.7, 5.7, 8)


def _gap_sql(name: str, source: str, keys: str) -> str:
    return f"""SELECT '{name}' AS universe, count(*) AS n, round(avg(gap), 6) AS mean_gap, median(gap) AS median_gap, max(gap) AS max_gap FROM
  (SELECT pos - lag(pos) OVER (PARTITION BY {keys} ORDER BY pos) AS gap FROM {source}) WHERE gap IS NOT NULL"""


@query(f"WITH {D.SEGMENTS} " + _gap_sql("catalogue", "(SELECT DISTINCT chrom, pos FROM carriers)", "chrom") + " UNION ALL " + _gap_sql("individual", "carriers", "sample_id, chrom") + " UNION ALL " + _gap_sql("pair", "shared", "sample_a, sample_b, chrom"))
def gap_stats(s, d):
    c = carriers(s, d)
    parts = [W.gap_stats(c.select("chrom", "pos").distinct(), ["chrom"], "catalogue"), W.gap_stats(c, ["sample_id", "chrom"], "individual"), W.gap_stats(P.shared_pairs(c), ["sample_a", "sample_b", "chrom"], "pair", None)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("mean_gap", F.round("mean_gap", 6))


def _sweep_sql() -> str:
    part = lambda g: f"""SELECT sample_a, sample_b, {g} AS max_gap, max(pos) - min(pos) + 1 AS len, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY sample_a, sample_b, chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM (
    SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY sample_a, sample_b, chrom ORDER BY pos) > {g} THEN 1 ELSE 0 END AS new FROM shared)) GROUP BY sample_a, sample_b, chrom, isl"""  # noqa: E731
    return f"""WITH {D.SEGMENTS}, ch AS ({part(20000)} UNION ALL {part(100000)}),
grid AS (SELECT g::BIGINT AS max_gap, l::BIGINT AS min_length, m::BIGINT AS min_sites FROM (SELECT unnest([20000, 100000]) AS g), (SELECT unnest([1, 50000]) AS l), (SELECT unnest([2, 3]) AS m))
SELECT grid.max_gap, min_length, min_sites, count(n) AS n_segments, count(DISTINCT CASE WHEN n IS NOT NULL THEN (sample_a, sample_b) END) AS n_pairs, coalesce(sum(len), 0)::BIGINT AS total_bp
FROM grid LEFT JOIN ch ON ch.max_gap = grid.max_gap AND len >= min_length AND n >= min_sites GROUP BY ALL"""


@query(_sweep_sql())
def segment_sweep(s, d):
    return W.segment_sweep(carriers(s, d), [20_000, 100_000], [1, 50_000], [2, 3])


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey % 100 AS contig, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS pos FROM orders),
e AS (SELECT l_suppkey AS contig, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS pos FROM lineitem)
SELECT id, q.contig, q.pos, (SELECT count(*) FROM e WHERE e.contig = q.contig AND e.pos BETWEEN q.pos - 15 AND q.pos + 15) AS n_events FROM q""")
def radius_counts(s, d):
    from .q_intervals import points

    e = D.table(s, d, "lineitem").select(F.col("l_suppkey").alias("contig"), F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long").alias("pos"))
    return W.radius_counts(points(s, d), e, ["contig"], 15, 365)


@query(f"""WITH {D.SITES}, w AS (SELECT chrom, pos, lag(pos) OVER v AS a, lead(pos) OVER v AS b FROM sites WINDOW v AS (PARTITION BY chrom ORDER BY pos))
SELECT chrom, pos, (a + pos) // 2 + 1 AS cell_lo, (pos + b) // 2 AS cell_hi FROM w""")
def voronoi_cells(s, d):
    return W.voronoi(D.sites(s, d).select("chrom", "pos"), ["chrom"])


@query(f"""WITH {D.SITES}, n AS (SELECT chrom, pos, CASE WHEN pos - lag(pos) OVER w > 5000 THEN 1 ELSE 0 END AS new FROM sites WHERE pos // 1000 % 11 <> 0 WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM n), i AS (SELECT *, (row_number() OVER (PARTITION BY chrom, run ORDER BY pos) - 1) // 4 AS w FROM r)
SELECT chrom, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM i GROUP BY chrom, run, w""")
def marker_windows(s, d):
    return W.marker_windows(D.sites(s, d).filter("floor(pos / 1000) % 11 <> 0").select("chrom", "pos"), ["chrom"], 4, 5000)
