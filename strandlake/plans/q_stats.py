"""Queries of statistics and cohort operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import stats as T
from . import domain as D
from .lineage import cut

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


# Customers: balance as a value, an order count, segment and nation as labels.
CUST = """cu AS (SELECT c_custkey AS id, c_nationkey::BIGINT AS nation, c_mktsegment AS seg, c_acctbal AS bal, coalesce(n, 0) AS n_orders, coalesce(v, 0) AS spent
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""


def customers(s, d):
    o = D.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    c = D.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    return c.join(o, "id", "left").na.fill({"n_orders": 0, "spent": 0.0})


RANKS = f"WITH {CUST}, rk AS (SELECT *, rank() OVER (ORDER BY n_orders) + (count(*) OVER (PARTITION BY n_orders) - 1) / 2 AS r FROM cu)"
MW = RANKS + ", m AS (SELECT count(*) FILTER (WHERE seg = 'BUILDING') AS n1, count(*) FILTER (WHERE seg <> 'BUILDING') AS n0, sum(r) FILTER (WHERE seg = 'BUILDING') AS r1 FROM rk), u AS (SELECT n1, n0, r1 - n1 * (n1 + 1) / 2 AS u FROM m)"


def flagged(s, d):
    return customers(s, d).withColumn("pos", F.col("seg") == "BUILDING")


@query(RANKS + " SELECT n_orders, count(*) AS n, any_value(r)::DOUBLE AS rank FROM rk GROUP BY n_orders")
def average_ranks(s, d):
    return T.value_ranks(customers(s, d), "n_orders")


@query(MW + " SELECT n1, n0, u, u / (n1 * n0) AS auc, 2 * u / (n1 * n0) - 1 AS cliff_delta FROM u")
def mann_whitney(s, d):
    return T.mann_whitney(flagged(s, d), "n_orders", "pos")


@query(MW + """, v AS (SELECT avg(n_orders) FILTER (WHERE seg = 'BUILDING') AS m1, avg(n_orders) FILTER (WHERE seg <> 'BUILDING') AS m0, var_samp(n_orders) FILTER (WHERE seg = 'BUILDING') AS v1, var_samp(n_orders) FILTER (WHERE seg <> 'BUILDING') AS v0 FROM cu)
SELECT round(greatest(u / (n1 * n0), 1 - u / (n1 * n0)), 9) AS auc, round((m1 - m0) / sqrt((v1 + v0) / 2), 9) AS smd FROM u, v""")
def auc_smd(s, d):
    return T.auc_smd(flagged(s, d), "n_orders", "pos").select(F.round("auc", 9).alias("auc"), F.round("smd", 9).alias("smd"))


@query(f"""WITH {CUST}, p AS (SELECT n_orders AS x, spent / 100000 AS y FROM cu), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM p)
SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse,
  round(quantile_cont(y - x, 0.5), 6) AS delta_p50, round(quantile_cont(y - x, 0.95), 6) AS delta_p95, round(corr(rx, ry), 6) AS spearman FROM k""")
def compare_vectors(s, d):
    x = customers(s, d).select(F.col("n_orders").alias("x"), (F.round(F.col("spent"), 2) / 100_000).alias("y"))
    out = T.compare_vectors(cut(x), "x", "y")
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


CT = f"WITH {CUST}, t AS (SELECT nation AS la, seg AS lb, count(*) AS n FROM cu GROUP BY ALL), r AS (SELECT la, sum(n) AS ra FROM t GROUP BY la), c AS (SELECT lb, sum(n) AS cb FROM t GROUP BY lb), z AS (SELECT sum(n) AS t FROM t)"


@query(CT + """, f AS (SELECT sum((coalesce(n, 0) - ra * cb / z.t) * (coalesce(n, 0) - ra * cb / z.t) / (ra * cb / z.t)) AS chi2, count(DISTINCT r.la) AS r, count(DISTINCT c.lb) AS k, max(z.t) AS t FROM r CROSS JOIN c CROSS JOIN z LEFT JOIN t ON t.la = r.la AND t.lb = c.lb)
SELECT round(chi2, 6) AS chi2, round(sqrt(greatest(0, chi2 / t - (k - 1) * (r - 1) / (t - 1)) / least(r - (r - 1) * (r - 1) / (t - 1) - 1, k - (k - 1) * (k - 1) / (t - 1) - 1)), 6) AS cramers_v FROM f""")
def cramers_v(s, d):
    return T.cramers_v(T.contingency(customers(s, d), "nation", "seg")).select(F.round("chi2", 6).alias("chi2"), F.round("cramers_v", 6).alias("cramers_v"))


@query(None)
def enrichment(s, d):
    return T.enrichment(customers(s, d), "nation", "seg").select("nation", "seg", "n", "in_group", "of_level", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query(CT + """, k AS (SELECT *, row_number() OVER (PARTITION BY la ORDER BY n DESC, lb) AS rk FROM t) SELECT k.la AS nation, lb AS seg, n / ra AS fraction, ra::BIGINT AS size FROM k JOIN r ON r.la = k.la WHERE rk = 1""")
def community_labels(s, d):
    return T.modal_label(customers(s, d), "nation", "seg")


@query(f"""WITH {CUST}, g AS (SELECT nation, count(*) AS n, sum(bal) AS s, sum(bal * bal) AS q FROM cu GROUP BY nation), a AS (SELECT sum(n) AS n, count(*) AS k, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g)
SELECT n::BIGINT AS n, k AS groups, round(1 - (q - b) / (q - s * s / n), 6) AS eta2, round(1 - ((q - b) / (n - k)) / ((q - s * s / n) / (n - 1)), 6) AS adjusted, 'ok' AS status FROM a""")
def eta_squared(s, d):
    return T.eta_squared(customers(s, d), "bal", "nation").withColumns({"eta2": F.round("eta2", 6), "adjusted": F.round("adjusted", 6)})


@query(f"""WITH {CUST}, r AS (SELECT regr_r2(spent, n_orders) AS a FROM cu) SELECT (SELECT count(*) FROM cu) AS n, round(a, 6) AS partial_r2 FROM r""")
def partial_r2(s, d):
    """Of the order count alone: the base model is the intercept."""
    return T.partial_r2(customers(s, d), "spent", [], ["n_orders"]).withColumn("partial_r2", F.round("partial_r2", 6))


@query(f"""WITH {CUST}, c AS (SELECT CASE WHEN id % 10 <> 0 THEN nation END AS comp, n_orders FROM cu), g AS (SELECT comp, count(*) AS n FROM c WHERE comp IS NOT NULL GROUP BY comp)
SELECT (SELECT count(*) FROM c) AS n, (SELECT sum(n * (n - 1) // 2) FROM g)::BIGINT AS same, (SELECT count(comp) * (count(comp) - 1) // 2 FROM c) - (SELECT sum(n * (n - 1) // 2) FROM g)::BIGINT AS different,
  (SELECT count(*) * (count(*) - 1) // 2 - count(comp) * (count(comp) - 1) // 2 FROM c) AS unknown, (SELECT (sum(n_orders) * sum(n_orders) - sum(n_orders * n_orders)) / 2 FROM c)::DOUBLE AS product_sum""")
def pair_denominators(s, d):
    c = customers(s, d).withColumn("comp", F.when(F.col("id") % 10 != 0, F.col("nation")))
    return T.pair_denominators(c, "comp", "n_orders")


@query(None)
def bootstrap_mean(s, d):
    out = T.bootstrap_mean(customers(s, d), "nation", "bal", 200)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


TRUTH = "tr AS (SELECT l_returnflag AS truth, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 5 = 0 THEN 'A' ELSE l_returnflag END AS call FROM lineitem)"


def truth(s, d):
    call = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_partkey") % 5 == 0, "A").otherwise(F.col("l_returnflag"))
    return D.table(s, d, "lineitem").select(F.col("l_returnflag").alias("truth"), call.alias("call"))


@query(f"WITH {TRUTH} SELECT truth, coalesce(call, 'MISSING') AS call, count(*) AS n FROM tr GROUP BY ALL")
def confusion(s, d):
    return T.confusion(truth(s, d), "truth", "call")


@query(f"""WITH {TRUTH}, c AS (SELECT * FROM tr WHERE call IS NOT NULL), t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (WHERE truth = call) AS hit FROM c GROUP BY 1), p AS (SELECT call AS label, count(*) AS called FROM c GROUP BY 1)
SELECT label, coalesce(support, 0) AS support, coalesce(called, 0) AS called, coalesce(hit, 0) AS hit, hit / nullif(called, 0) AS precision, hit / nullif(support, 0) AS recall, 2 * hit / nullif(support + called, 0) AS f1 FROM t FULL JOIN p USING (label)""")
def label_metrics(s, d):
    return T.label_metrics(truth(s, d), "truth", "call")


PROB = "pr AS (SELECT quality::BIGINT AS y, n_chars / (n_chars + 1500) AS p FROM labels JOIN documents USING (doc_id))"


def scored(s, d):
    return D.table(s, d, "labels").join(D.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").cast("long").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1500)).alias("p"))


@query(f"""WITH {PROB}, q AS (SELECT y, p, least(floor(p * 15), 14) AS b FROM pr), b AS (SELECT b, count(*) AS n, sum(-CASE WHEN y = 1 THEN ln(greatest(p, 1e-12)) ELSE ln(1 - least(p, 1 - 1e-12)) END) AS ll, sum((p - y) * (p - y)) AS br, sum(p) AS sp, sum(y) AS sy FROM q GROUP BY b)
SELECT sum(n)::BIGINT AS n, round(sum(ll) / sum(n), 6) AS log_loss, round(sum(br) / sum(n), 6) AS brier, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM b""")
def probability_metrics(s, d):
    out = T.probability_metrics(scored(s, d), "p", "y")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("log_loss", "brier", "ece")])


@query(None)
def calibration(s, d):
    x = cut(scored(s, d).select(F.array(1 - F.col("p"), F.col("p")).alias("p"), "y"))
    return T.calibrate(x, "p", "y").select(F.round("temperature", 6).alias("temperature"), F.round("log_loss", 6).alias("log_loss"))


@query(f"""WITH {D.GENO}, o AS (SELECT sample_id, chrom, coalesce(sum(dosage), 0)::BIGINT AS own FROM geno GROUP BY ALL) SELECT sample_id, chrom, (sum(own) OVER (PARTITION BY sample_id) - own)::BIGINT AS rest FROM o""")
def leave_one_chromosome_out(s, d):
    g = D.genotypes(s, d).withColumn("dosage", F.coalesce("dosage", F.lit(0)))
    return T.leave_one_out(g, ["sample_id"], "chrom", "dosage")


@query(f"""WITH {D.PAIRS}, r AS (SELECT total_shared_bp AS w, CASE WHEN sample_a % 4 = sample_b % 4 THEN 'within' ELSE 'between' END AS relation FROM pairs), k AS (SELECT *, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2 AS r FROM r),
m AS (SELECT count(*) FILTER (WHERE relation = 'within') AS n1, count(*) FILTER (WHERE relation = 'between') AS n0, sum(r) FILTER (WHERE relation = 'within') AS r1, median(w) FILTER (WHERE relation = 'within') AS a, median(w) FILTER (WHERE relation = 'between') AS b FROM k)
SELECT n1, n0, r1 - n1 * (n1 + 1) / 2 AS u, (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc, 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) - 1 AS cliff_delta, a AS median_within, b AS median_between, a / b AS ratio FROM m""")
def intra_inter(s, d):
    from .q_graph import edges

    e = edges(s, d).withColumn("relation", F.when(F.col("a") % 4 == F.col("b") % 4, "within").otherwise("between"))
    return T.intra_inter(cut(e))


# --- cohort

@query("""SELECT c_custkey AS id, c_nationkey::BIGINT AS nation, n IS NOT NULL AS in_orders, coalesce(n, 0) AS n_orders, x IS NOT NULL AS in_events, coalesce(x, 0) AS n_events
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS x FROM events GROUP BY 1) ON user_id = c_custkey""")
def feature_store(s, d):
    base = D.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation"))
    o = D.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    e = D.table(s, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_events"))
    return C.feature_store(base, {"orders": o, "events": e}, "id", {"orders": ["n_orders"], "events": ["n_events"]})


@query("""SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'only_b' WHEN b.id IS NULL THEN 'only_a' ELSE 'both' END AS side
FROM (SELECT DISTINCT o_custkey AS id FROM orders) a FULL JOIN (SELECT DISTINCT user_id AS id FROM events) b ON a.id = b.id""")
def define_cohort(s, d):
    return C.define_cohort(D.table(s, d, "orders").select(F.col("o_custkey").alias("id")), D.table(s, d, "events").select(F.col("user_id").alias("id")), "id")


@query("""SELECT l_orderkey AS id, count(*) AS n_versions FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY 1 HAVING count(*) > 1""")
def metadata_conflicts(s, d):
    return C.unique_rows(D.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag"), "id")[1]


def fold_people(s, d):
    return C.grouped_folds(customers(s, d).withColumn("y", F.col("seg") == "BUILDING").withColumn("grp", F.floor(F.col("id") / 3)), "grp", "y", 5)


@query(None)
def grouped_folds(s, d):
    return fold_people(s, d).select("id", "grp", "y", "fold")


@query(None)
def fold_distance(s, d):
    return C.fold_distance(cut(fold_people(s, d)), "y", ["nation", "seg"]).withColumn("distance", F.round("distance", 9))


MODF = f"WITH {CUST}, pe AS (SELECT *, id % 5 AS fold, nation AS grp, seg = 'BUILDING' AS y FROM cu)"


def mod_people(s, d):
    return customers(s, d).withColumns({"fold": F.col("id") % 5, "grp": F.col("nation"), "y": F.col("seg") == "BUILDING"})


@query(MODF + """, g AS (SELECT fold, grp, count(*) AS n, count(*) FILTER (WHERE y) AS y FROM pe GROUP BY ALL), x AS (SELECT grp FROM pe GROUP BY grp HAVING count(DISTINCT fold) > 1)
SELECT fold, sum(n)::BIGINT AS size, sum(y) / sum(n) AS prevalence, count(*) AS n_groups, max(n) AS largest, count(*) FILTER (WHERE grp IN (SELECT grp FROM x)) AS crossed FROM g GROUP BY fold""")
def split_audit(s, d):
    return C.split_audit(mod_people(s, d), "grp", "y")


@query(MODF + """, n AS (SELECT f.fold AS of, CASE WHEN pe.fold = f.fold THEN 'assess' ELSE 'fit' END AS side, grp, count(*) AS n FROM pe CROSS JOIN (SELECT DISTINCT fold FROM pe) f GROUP BY ALL)
SELECT of AS fold, side, sum(n)::BIGINT AS size, max(n) / sum(n) AS top_share, sum(n) * sum(n) / sum(n * n) AS effective FROM n GROUP BY of, side""")
def support_tables(s, d):
    return C.support_tables(mod_people(s, d), "grp")


VAR = f"""WITH {D.GENO}, v AS (SELECT chrom, pos, count(*) AS n, count(*) - count(dosage) AS n_missing, count(*) FILTER (WHERE dosage > 0) AS n_carriers, coalesce(sum(dosage), 0)::BIGINT AS mac FROM geno GROUP BY ALL HAVING (count(*) - count(dosage)) * 5 <= count(*)),
k AS (SELECT chrom, pos, row_number() OVER (ORDER BY chrom, pos) - 1 AS col, n_carriers, mac, n_missing FROM v)"""


@query(VAR + " SELECT * FROM k")
def matrix_variants(s, d):
    return C.dosage_matrix(D.genotypes(s, d), (1, 5))[1]


@query(VAR + " SELECT sample_id, col, dosage FROM geno JOIN k USING (chrom, pos) WHERE dosage > 0")
def matrix_cells(s, d):
    return C.dosage_matrix(D.genotypes(s, d), (1, 5))[0]


@query(f"""WITH {D.GENO}, f AS (SELECT chrom, pos, sum(dosage) / (2 * count(dosage)) AS p FROM geno WHERE sample_id % 5 <> 0 GROUP BY ALL)
SELECT sample_id, chrom, pos, round(coalesce((dosage - 2 * p) / sqrt(2 * p * (1 - p)), 0), 9) AS z FROM geno JOIN f USING (chrom, pos) WHERE p > 0 AND p < 1""")
def standardised_dosage(s, d):
    g = D.genotypes(s, d)
    f = g.filter("sample_id % 5 <> 0").groupBy("chrom", "pos").agg((F.sum("dosage") / (2 * F.count("dosage"))).alias("p"))
    return C.standardise(g, f).select("sample_id", "chrom", "pos", F.round("z", 9).alias("z"))


@query(f"""WITH {D.GENO}, q AS (SELECT f AS fold, chrom, pos, sum(dosage) AS ac, 2 * count(dosage) AS an FROM geno, (SELECT unnest(range(0, 3)) AS f) WHERE sample_id % 3 <> f GROUP BY ALL),
se AS (SELECT fold, chrom, pos, ac * 2 < an AS allele FROM q WHERE an > 0 AND least(ac, an - ac) * 5 <= 2 * an AND least(ac, an - ac) >= 2), n AS (SELECT fold, count(*) AS n FROM se GROUP BY fold),
j AS (SELECT a.fold AS fa, b.fold AS fb, count(*) AS common, count(*) FILTER (WHERE a.allele <> b.allele) AS flips FROM se a JOIN se b ON a.chrom = b.chrom AND a.pos = b.pos AND a.fold < b.fold GROUP BY ALL)
SELECT fa AS fold_a, fb AS fold_b, common, x.n + y.n - common AS union, common / (x.n + y.n - common) AS jaccard, flips FROM j JOIN n x ON x.fold = fa JOIN n y ON y.fold = fb""".replace("AS union", 'AS "union"'))
def site_stability(s, d):
    g = D.genotypes(s, d).withColumn("fold", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))).filter("sample_id % 3 <> fold")
    q = g.groupBy("fold", "chrom", "pos").agg(F.sum("dosage").alias("ac"), (2 * F.count("dosage")).alias("an"))
    se = q.filter("an > 0 and least(ac, an - ac) * 5 <= 2 * an and least(ac, an - ac) >= 2").select("fold", "chrom", "pos", (F.col("ac") * 2 < F.col("an")).alias("allele"))
    return C.site_stability(se)


@query("""WITH p AS (SELECT l_suppkey % 50 AS a, l_partkey % 50 AS b, l_quantity - 2 AS v FROM lineitem)
SELECT 'self_pair' AS rule, count(*) AS n FROM p WHERE a = b HAVING count(*) > 0 UNION ALL SELECT 'bad_value', count(*) FROM p WHERE v < 0 HAVING count(*) > 0
UNION ALL SELECT 'repeated_pair', count(*) FROM (SELECT 1 FROM p GROUP BY least(a, b), greatest(a, b) HAVING count(*) > 1) HAVING count(*) > 0""")
def pair_violations(s, d):
    p = D.table(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("a"), (F.col("l_partkey") % 50).alias("b"), (F.col("l_quantity") - 2).alias("v"))
    return C.pair_violations(p, "a", "b", "v")


@query("""SELECT chrom, count(*) FILTER (WHERE k > 1) AS n_repeated, count(*) AS n_positions FROM (SELECT l_suppkey AS chrom, l_partkey AS pos, count(*) AS k FROM lineitem GROUP BY ALL) GROUP BY chrom""")
def axis_violations(s, d):
    return C.axis_violations(D.table(s, d, "lineitem").select(F.col("l_suppkey").alias("chrom"), F.col("l_partkey").alias("pos")))


@query("""SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT l_orderkey AS k, count(*) AS x FROM lineitem GROUP BY 1) a FULL JOIN (SELECT o_orderkey AS k, 1 + o_custkey % 6 AS y FROM orders) b ON a.k = b.k WHERE x IS NULL OR y IS NULL OR x <> y""")
def aggregates_differ(s, d):
    a = D.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("v"))
    return C.aggregates_differ(a, D.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_custkey") % 6).alias("v")), ["k"], "v")


@query("""SELECT * FROM (SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) AS n_values FROM lineitem UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem) WHERE n_values > 1""")
def mixed_contracts(s, d):
    return C.mixed_contracts(D.table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""WITH u AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS role, o_custkey, o_orderdate::DATE AS day FROM orders),
l AS (SELECT role, 'customer' AS axis, o_custkey::VARCHAR AS identity FROM u UNION ALL SELECT role, 'day', day::VARCHAR FROM u)
SELECT axis, identity, count(DISTINCT role) AS n_roles FROM l GROUP BY ALL HAVING count(DISTINCT role) > 1""")
def role_collisions(s, d):
    u = D.table(s, d, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("role"), F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("day"))
    return C.role_collisions(u, ["customer", "day"])


@query("""SELECT (SELECT count(*) FROM lineitem) AS n_children, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0)) AS n_linked,
(SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0)) AS n_orphaned, (SELECT count(*) FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n_childless""")
def link_audit(s, d):
    return C.link_audit(D.table(s, d, "lineitem"), D.table(s, d, "orders").filter("o_orderkey % 9 <> 0"), "l_orderkey", "o_orderkey")
