"""Queries of audits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as X
from ..operators import cohort as H
from ..operators import evaluation as E
from . import domain as D
from .q_graph import nodes
from .q_pairs import summary

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


_BASE = "substr('ACGT', (({0}) % 4 + 1)::INT, 1)"


@query(f"""WITH {D.SITES}, p AS (SELECT l_partkey % 5 + 1 AS chrom, l_partkey * 1000 AS pos, CASE WHEN l_linenumber = 5 THEN '.' ELSE {_BASE.format('l_partkey // 7 + l_linenumber')} END AS a1, {_BASE.format('l_partkey // 7 + l_partkey // 3 + 1')} AS a2 FROM lineitem WHERE l_orderkey % 16 = 1),
j AS (SELECT s.chrom, s.pos, ref, alt, a1 IS NOT NULL AS row_, a1 IN ('A', 'C', 'G', 'T') AND a2 IN ('A', 'C', 'G', 'T') AND a1 <> a2 AS good, list_sort([a1, a2]) AS pair, list_sort([ref, alt]) AS own, list_sort([translate(ref, 'ACGT', 'TGCA'), translate(alt, 'ACGT', 'TGCA')]) AS other
  FROM sites s LEFT JOIN p ON p.chrom = s.chrom AND p.pos = s.pos),
g AS (SELECT chrom, pos, ref, alt, own, other, count(*) FILTER (WHERE row_) AS n_rows, count(*) FILTER (WHERE good AND pair = own) AS n_direct, count(*) FILTER (WHERE good AND pair = other) AS n_complement, count(*) FILTER (WHERE row_ AND NOT good) AS n_unsupported, count(DISTINCT CASE WHEN good THEN pair END) AS n_pairs FROM j GROUP BY ALL)
SELECT chrom, pos, ref, alt, n_rows, n_direct, n_complement, n_unsupported, n_pairs, CASE WHEN n_rows = 0 THEN 'no_row' WHEN n_rows > 1 THEN 'multiple' WHEN n_unsupported > 0 THEN 'unsupported' WHEN n_direct > 0 AND own = other THEN 'palindromic_ambiguous' WHEN n_direct > 0 THEN 'direct' WHEN n_complement > 0 THEN 'complement' ELSE 'mismatch' END AS state FROM g""")
def panel_correspondence(s, d):
    """Sites against a panel of rows by every sixteenth order's lines."""
    base = lambda e: F.substr(F.lit("ACGT"), (e % 4 + 1).cast("int"), F.lit(1))
    k = F.col("l_partkey")
    p = D.table(s, d, "lineitem").filter("l_orderkey % 16 = 1").select(
        (k % 5 + 1).alias("chrom"), (k * 1000).alias("pos"), F.when(F.col("l_linenumber") == 5, ".").otherwise(base(F.floor(k / 7) + F.col("l_linenumber"))).alias("a1"), base(F.floor(k / 7) + F.floor(k / 3) + 1).alias("a2"))
    return X.panel_correspondence(D.sites(s, d), p)


BLOCKS = f"""WITH {D.GENO}, b AS (SELECT chrom, pos // 20000 AS pattern, sample_id % 40 AS valid, count(dosage) AS called, count(*) FILTER (WHERE dosage = 2) AS carriers, count(*) FILTER (WHERE dosage = 1) AS unphased FROM geno GROUP BY ALL),
st AS (SELECT *, CASE WHEN called = 0 THEN 'UNEVALUABLE_CALLABILITY' WHEN carriers > 0 THEN 'PRESENT' WHEN unphased > 0 THEN 'UNEVALUABLE_PHASE' ELSE 'ABSENT' END AS state FROM b)"""


def blocks(s, d):
    g = D.genotypes(s, d).groupBy("chrom", F.floor(F.col("pos") / 20_000).alias("pattern"), (F.col("sample_id") % 40).alias("valid"))
    b = g.agg(F.count("dosage").alias("called"), F.count_if(F.col("dosage") == 2).alias("carriers"), F.count_if(F.col("dosage") == 1).alias("unphased"))
    return b.withColumn("state", X.phase_state("called", "carriers", "unphased"))


@query(BLOCKS + " SELECT state, count(*) AS n FROM st GROUP BY state")
def phase_states(s, d):
    return blocks(s, d).groupBy("state").agg(F.count("*").alias("n"))


@query(BLOCKS + """, p AS (SELECT chrom * 100 + valid AS unit, pattern, bool_or(state = 'PRESENT') AS present, bool_or(starts_with(state, 'UNEVALUABLE')) AS open_ FROM st GROUP BY ALL),
g AS (SELECT unit, count(*) FILTER (WHERE present) AS n_present, count(*) FILTER (WHERE NOT present AND open_) AS n_open FROM p GROUP BY unit)
SELECT *, CASE WHEN n_present >= 6 THEN 'PASS' WHEN n_present + n_open >= 6 THEN 'INCONCLUSIVE' ELSE 'STOP' END AS decision FROM g""")
def transfer_decision(s, d):
    return X.transfer_decision(blocks(s, d).withColumn("unit", F.col("chrom") * 100 + F.col("valid")), "unit", 6)


@query("""WITH c AS (SELECT o_custkey AS sample_id, l_partkey % 5 + 1 AS chrom, l_partkey // 10 AS pos, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN [1] WHEN l_linenumber = 5 THEN [NULL, 1] ELSE [l_linenumber % 3, l_partkey % 2] END AS alleles, l_suppkey % 2 = 0 AS phased FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS role, c_mktsegment AS ancestry, chrom, pos, phased, alleles IS NULL OR len(list_filter(alleles, lambda x: x IS NULL)) > 0 AS m, alleles FROM c JOIN customer ON c_custkey = sample_id),
x AS (SELECT *, NOT m AND len(alleles) = 2 AS k, CASE WHEN NOT m AND len(alleles) = 2 THEN len(list_filter(alleles, lambda x: x = 1)) ELSE 0 END AS n FROM f), y AS (SELECT * FROM x UNION ALL SELECT role, 'ALL', chrom, pos, phased, m, alleles, k, n FROM x)
SELECT role, ancestry, chrom, pos, count(*) FILTER (WHERE k) AS n_complete, count(*) FILTER (WHERE m) AS n_missing, count(*) FILTER (WHERE NOT k AND NOT m) AS n_non_diploid, sum(n)::BIGINT AS ac, 2 * count(*) FILTER (WHERE k) AS an, count(*) FILTER (WHERE n > 0) AS n_carriers,
  count(*) FILTER (WHERE k AND phased) AS n_phased, count(*) FILTER (WHERE n > 0 AND phased) AS n_phased_carriers, count(*) FILTER (WHERE n = 2) AS n_hom_carriers FROM y GROUP BY ALL""")
def call_support(s, d):
    """Calls by line: one allele for line 6, an unknown one for line 5, none for line 7."""
    n, one = F.col("l_linenumber"), F.lit(1).cast("long")
    li = D.table(s, d, "lineitem").join(D.table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    alleles = F.when(n == 7, F.lit(None)).when(n == 6, F.array(one)).when(n == 5, F.array(F.lit(None).cast("long"), one)).otherwise(F.array((n % 3).cast("long"), F.col("l_partkey") % 2))
    c = li.select(F.col("o_custkey").alias("sample_id"), (F.col("l_partkey") % 5 + 1).alias("chrom"), F.floor(F.col("l_partkey") / 10).alias("pos"), alleles.alias("alleles"), (F.col("l_suppkey") % 2 == 0).alias("phased"), F.lit(1).alias("allele"))
    people = D.table(s, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("role"), F.col("c_mktsegment").alias("ancestry"))
    return X.call_support(c, people)


MASTER = f"""WITH {D.GENO}, p AS (SELECT DISTINCT sample_id FROM geno), ms AS (SELECT sample_id, CASE WHEN sample_id % 3 <> 0 THEN sample_id % 4 END AS community, sample_id % 3 <> 0 AS has_community, CASE WHEN sample_id % 5 <> 0 THEN sample_id % 11 END AS grp, sample_id % 5 <> 0 AS has_group, c_custkey IS NOT NULL AS has_metadata FROM p LEFT JOIN customer ON c_custkey = sample_id)"""


def master(s, d):
    n = nodes(s, d).withColumnRenamed("node", "sample_id")
    meta = D.table(s, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("seg"))
    return E.modeling_master(n, n.filter("sample_id % 3 <> 0").withColumn("community", F.col("sample_id") % 4), n.filter("sample_id % 5 <> 0").withColumn("grp", F.col("sample_id") % 11), meta)


@query(MASTER + """ SELECT flag, n_people, n_rows, n_found, n_found / n_rows AS share FROM (SELECT unnest(['has_community', 'has_group', 'has_metadata']) AS flag, unnest([sum(has_community::INT), sum(has_group::INT), sum(has_metadata::INT)])::BIGINT AS n_found, count(DISTINCT sample_id) AS n_people, count(*) AS n_rows FROM ms)""")
def join_audit(s, d):
    return X.join_audit(master(s, d), ["has_community", "has_group", "has_metadata"])


@query(MASTER + """, c AS (SELECT grp AS a, community AS b, count(*) AS n FROM ms GROUP BY ALL) SELECT a, b, n, n / sum(n) OVER (PARTITION BY a) AS of_a, n / sum(n) OVER (PARTITION BY b) AS of_b FROM c""")
def kin_by_community(s, d):
    return X.crosstab(master(s, d), "grp", "community")


@query("""WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey::BIGINT END AS community FROM customer)
SELECT community, CASE WHEN community IS NULL THEN 'isolated' WHEN community = -1 THEN 'noise' ELSE 'community' END AS subtype, count(*) AS n FROM l GROUP BY ALL""")
def label_subtypes(s, d):
    k = F.col("c_custkey")
    c = D.table(s, d, "customer").select(F.when(k % 7 == 0, None).when(k % 5 == 0, -1).otherwise(F.col("c_nationkey").cast("long")).alias("community"))
    return c.withColumn("subtype", H.subtype()).groupBy("community", "subtype").agg(F.count("*").alias("n"))


@query(f"""WITH {D.GENO}, v AS (SELECT chrom, pos, count(*) AS n, count(*) - count(dosage) AS m, count(*) FILTER (WHERE dosage > 0) AS nz FROM geno GROUP BY ALL),
g AS (SELECT chrom, count(*) AS n_input, count(*) FILTER (WHERE m * 20 > n) AS n_dropped, count(*) FILTER (WHERE m * 20 <= n) AS n_retained, coalesce(sum(nz) FILTER (WHERE m * 20 <= n), 0)::BIGINT AS nnz FROM v GROUP BY chrom),
a AS (SELECT * FROM g UNION ALL SELECT NULL, sum(n_input)::BIGINT, sum(n_dropped)::BIGINT, sum(n_retained)::BIGINT, sum(nnz)::BIGINT FROM g), p AS (SELECT count(DISTINCT sample_id) AS n_people FROM geno)
SELECT a.*, n_people, round(1 - nnz / nullif(n_retained * n_people, 0), 9) AS sparsity FROM a, p""")
def matrix_summary(s, d):
    return X.matrix_summary(D.genotypes(s, d), (1, 20)).withColumn("sparsity", F.round("sparsity", 9))


@query("""WITH o AS (SELECT o_custkey AS sample_id, min(o_orderkey) AS k FROM orders GROUP BY 1), a AS (SELECT row_number() OVER (ORDER BY k) - 1 AS "at", sample_id FROM o), b AS (SELECT row_number() OVER (ORDER BY CASE WHEN sample_id % 50 = 0 THEN k + 40 ELSE k END, k) - 1 AS "at", sample_id FROM o WHERE sample_id % 97 <> 0)
SELECT coalesce(a."at", b."at") AS "at", a.sample_id AS found, b.sample_id AS expected FROM a FULL JOIN b ON a."at" = b."at" WHERE a.sample_id IS DISTINCT FROM b.sample_id""")
def order_differences(s, d):
    """People by first order against an order with some moved and some left out."""
    from ..operators.axis import with_ordinal

    o = D.table(s, d, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.min("o_orderkey").alias("k")).withColumn("all", F.lit(0))
    a = with_ordinal(o, ["all"], "k", 4096).select(F.col("_ordinal").alias("at"), "sample_id")
    moved = F.when(F.col("sample_id") % 50 == 0, F.col("k") + 40).otherwise(F.col("k")) * (1 << 32) + F.col("k")
    b = with_ordinal(o.filter("sample_id % 97 <> 0").withColumn("m", moved), ["all"], "m", 4096 << 32).select(F.col("_ordinal").alias("at"), "sample_id")
    return X.order_differences(a, b)


@query(f"""WITH t AS (SELECT l_suppkey AS chrom, l_orderkey * 8 + l_linenumber AS "at", l_orderkey // 4 + l_partkey % 3 AS pos, {_BASE.format('l_partkey')} AS ref, {_BASE.format('l_partkey // 5')} AS alt, CASE WHEN l_partkey % 4 = 0 THEN 'test' ELSE 'train' END AS role FROM lineitem),
w AS (SELECT *, lag(pos) OVER (PARTITION BY role, chrom ORDER BY "at", pos) AS p FROM t), k AS (SELECT chrom, pos, role, count(*) AS k FROM t GROUP BY ALL), l AS (SELECT chrom, pos, count(*) FILTER (WHERE k > 1) AS twice, count(*) AS roles FROM k GROUP BY ALL)
SELECT * FROM (SELECT 'unsorted' AS rule, count(*) AS n FROM w WHERE p > pos UNION ALL SELECT 'alleles', count(*) FROM t WHERE ref = alt UNION ALL SELECT 'repeated', sum(twice)::BIGINT FROM l UNION ALL SELECT 'role_overlap', count(*) FROM l WHERE roles > 1) WHERE n > 0""")
def site_contract(s, d):
    base = lambda e: F.substr(F.lit("ACGT"), (e % 4 + 1).cast("int"), F.lit(1))
    k = F.col("l_partkey")
    t = D.table(s, d, "lineitem").select(F.col("l_suppkey").alias("chrom"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), (F.floor(F.col("l_orderkey") / 4) + k % 3).alias("pos"), base(k).alias("ref"), base(F.floor(k / 5)).alias("alt"), F.when(k % 4 == 0, "test").otherwise("train").alias("role"))
    return X.site_contract(t)


UNITS = """WITH u AS (SELECT o_orderkey AS unit, CASE WHEN o_custkey % 10 = 0 THEN 'fit' WHEN o_custkey % 10 = 1 THEN 'select' ELSE 'other' END AS role, o_custkey::VARCHAR AS customer, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::DATE::VARCHAR END AS day FROM orders)"""


def units(s, d):
    role = F.when(F.col("o_custkey") % 10 == 0, "fit").when(F.col("o_custkey") % 10 == 1, "select").otherwise("other")
    return D.table(s, d, "orders").select(F.col("o_orderkey").alias("unit"), role.alias("role"), F.col("o_custkey").alias("customer"), F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate")).alias("day"))


@query(UNITS + """, l AS (SELECT role, 'customer' AS axis, customer AS v FROM u UNION ALL SELECT role, 'day', day FROM u), f AS (SELECT * FROM l WHERE role IN ('fit', 'select')), g AS (SELECT axis, v, bool_or(role = 'fit') AS a, bool_or(role = 'select') AS b FROM f WHERE v IS NOT NULL GROUP BY ALL)
SELECT axis, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, count(*) FILTER (WHERE a AND b) AS n_both, (SELECT count(*) FROM f WHERE f.axis = g.axis AND v IS NULL) AS n_incomplete FROM g GROUP BY axis""")
def role_separation(s, d):
    return X.role_separation(units(s, d), ["customer", "day"], "fit", "select")


@query(UNITS + """, l AS (SELECT DISTINCT unit, role, 'customer' AS axis, customer AS v FROM u UNION SELECT unit, role, 'day', day FROM u WHERE day IS NOT NULL), r AS (SELECT axis, v, count(DISTINCT role) AS k FROM l GROUP BY ALL)
SELECT unit, role, axis, count(*) AS n_identities, count(*) FILTER (WHERE k > 1) AS n_shared FROM l JOIN r USING (axis, v) GROUP BY ALL""")
def unit_overlaps(s, d):
    return X.unit_overlaps(units(s, d), ["customer", "day"])


EXCLUDED = f"""WITH {D.INTERVALS}, s AS (SELECT contig, lo, hi, 'a' AS source FROM iv WHERE label = 'A' UNION ALL SELECT contig, lo + 3, hi + 3, 'n' FROM iv WHERE label = 'N')"""


def _excluded(s, d):
    v = D.intervals(s, d)
    n = v.filter("label = 'N'").withColumns({"lo": F.col("lo") + 3, "hi": F.col("hi") + 3})
    return X.exclude_regions({"a": v.filter("label = 'A'"), "n": n}, ["contig"])


@query(EXCLUDED + """, o AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY contig ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM s), r AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT contig, min(lo) AS lo, max(hi) AS hi FROM r GROUP BY contig, k""")
def excluded_regions(s, d):
    return _excluded(s, d)[0]


@query(EXCLUDED + " SELECT source, count(*) AS n, sum(hi - lo + 1)::BIGINT AS bp FROM s GROUP BY source")
def excluded_sources(s, d):
    return _excluded(s, d)[1]


@query(f"""WITH {D.PAIRS}, t AS (SELECT sample_a % 4 AS block, total_shared_bp > 40000 AS pos FROM pairs), g AS (SELECT block, count(*) FILTER (WHERE pos) AS n_positive, count(*) FILTER (WHERE NOT pos) AS n_zero FROM t GROUP BY block)
SELECT block, n_positive, n_zero, 2::BIGINT AS requested_ratio, n_zero / nullif(n_positive, 0) AS achieved_ratio, n_zero < 2 * n_positive AS saturated FROM g""")
def target_balance(s, d):
    t = summary(s, d).select((F.col("sample_a") % 4).alias("block"), (F.col("total_shared_bp") > 40_000).alias("pos"))
    return X.target_balance(t, "block", "pos", 2)


@query(f"""WITH {D.GENO}, o AS (SELECT sample_id, chrom, pos, CASE WHEN (sample_id + pos // 1000) % 10 = 0 THEN 2 - dosage ELSE dosage END AS d2 FROM geno WHERE dosage IS NOT NULL AND pos // 1000 % 4 <> 0),
c AS (SELECT sample_id, count(*) AS n_joint, count(*) FILTER (WHERE dosage = d2) / count(*) AS concordance FROM geno JOIN o USING (sample_id, chrom, pos) WHERE dosage IS NOT NULL GROUP BY sample_id)
SELECT count(*) AS n, min(n_joint) AS n_joint_min, median(n_joint) AS n_joint_median, max(n_joint) AS n_joint_max, min(concordance) AS concordance_min, median(concordance) AS concordance_median, max(concordance) AS concordance_max, count(*) FILTER (WHERE n_joint < 10 OR concordance < 0.93) AS n_below FROM c""")
def concordance_summary(s, d):
    from .q_pairs import sample_concordance

    return X.concordance_summary(sample_concordance(s, d), 10, 0.93)


@query(f"""WITH {D.PAIRS}, lk AS (SELECT DISTINCT sample_id AS node, sample_id % 6 AS community FROM geno), j AS (SELECT a.community AS ca, b.community AS cb, total_shared_bp AS w FROM pairs JOIN lk a ON a.node = sample_a JOIN lk b ON b.node = sample_b),
i AS (SELECT ca AS community, median(w) AS within FROM j WHERE ca = cb GROUP BY 1), o AS (SELECT community, median(w) AS between_ FROM (SELECT ca AS community, w FROM j WHERE ca <> cb UNION ALL SELECT cb, w FROM j WHERE ca <> cb) GROUP BY 1), n AS (SELECT community, count(*) AS n FROM lk GROUP BY 1),
z AS (SELECT c_custkey % 6 AS community, avg(c_acctbal) / 10000 AS silhouette FROM customer GROUP BY 1)
SELECT community, n, within, between_ AS "between", within / between_ AS ratio, round(silhouette, 6) AS silhouette FROM n JOIN i USING (community) JOIN o USING (community) JOIN z USING (community) WHERE n >= 5 AND within / between_ >= 0.8 AND silhouette >= 0.44""")
def compact_founders(s, d):
    """Founder candidates that a made-up silhouette (by balance) confirms."""
    lab = nodes(s, d).withColumn("community", F.col("node") % 6)
    z = D.table(s, d, "customer").groupBy((F.col("c_custkey") % 6).alias("community")).agg((F.avg("c_acctbal") / 10_000).alias("silhouette"))
    return E.founder_candidates(summary(s, d), lab, 5, 0.8, z, 0.44).withColumn("silhouette", F.round("silhouette", 6))
