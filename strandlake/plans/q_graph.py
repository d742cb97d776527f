"""Queries of graph operators over pairs of people that share segments, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities as C
from ..operators import graph as G
from . import domain as D
from .lineage import cut
from .q_pairs import summary

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add



EDGES = D.PAIRS + ", e AS (SELECT sample_a AS a, sample_b AS b, total_shared_bp::DOUBLE AS w, max_segment_bp FROM pairs)"
#: Edges of long segments only, so that there are several components.
LEAST = 40_000
LONG = EDGES + f", x AS (SELECT a, b, w FROM e WHERE w >= {LEAST}), n AS (SELECT DISTINCT sample_id AS node FROM geno)"
REACH = LONG.replace("WITH ", "", 1) + """, y AS (SELECT a, b FROM x UNION ALL SELECT b, a FROM x),
r AS (SELECT node, node AS at FROM n UNION SELECT r.node, y.b FROM r JOIN y ON y.a = r.at),
c AS (SELECT node, min(at) AS component FROM r GROUP BY node)"""
STRENGTH = "both_ends AS (SELECT a AS node, w FROM e UNION ALL SELECT b, w FROM e), st AS (SELECT node, count(*) AS degree, sum(w) AS strength FROM both_ends GROUP BY node)"


def edges(s, d):
    return G.weighted_edges(summary(s, d), "raw")


def long_edges(s, d):
    return edges(s, d).filter(F.col("w") >= LEAST)


def nodes(s, d):
    return D.genotypes(s, d).select(F.col("sample_id").alias("node")).distinct()


def labels(s, d):
    """A made-up partition: people modulo 4; every ninth is unassigned."""
    return nodes(s, d).select("node", F.when(F.col("node") % 9 != 0, F.col("node") % 4).alias("community"))


LABELS = "lab AS (SELECT node, CASE WHEN node % 9 <> 0 THEN node % 4 END AS community FROM (SELECT DISTINCT sample_id AS node FROM geno))"


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql.replace("AS at", "AS reached").replace("min(at)", "min(reached)").replace("r.at", "r.reached")


@query(_recursive(REACH) + " SELECT node, component FROM c")
def components(s, d):
    return G.components(nodes(s, d), long_edges(s, d))


@query(_recursive(REACH) + """, z AS (SELECT component, count(*) AS n FROM c GROUP BY component), k AS (SELECT node, count(*) AS k FROM (SELECT a AS node FROM x UNION ALL SELECT b FROM x) GROUP BY node)
SELECT (SELECT count(*) FROM c) AS n_nodes, (SELECT count(*) FROM z) AS n_components, (SELECT max(n) FROM z) AS largest, (SELECT max(n) FROM z) / (SELECT count(*) FROM c) AS giant_fraction,
  (SELECT count(*) FROM x) AS n_edges, (SELECT coalesce(sum(k), 0) FROM k) / (SELECT count(*) FROM c) AS mean_degree, (SELECT sum(k * k) / sum(k) FROM k) AS kappa""")
def component_report(s, d):
    e = cut(long_edges(s, d))
    return G.component_report(G.components(nodes(s, d), e), e)


@query(None)
def independent_set(s, d):
    """Unrelated people: by call rate, then id."""
    rank = D.genotypes(s, d).groupBy(F.col("sample_id").alias("node")).agg((-F.count("dosage") / F.count("*")).alias("r"))
    return G.independent_set(rank, cut(long_edges(s, d).select("a", "b")), ["r"])


@query("WITH " + D.PAIRS + " SELECT sample_a AS a, sample_b AS b, ln(1 + total_shared_bp) AS w FROM pairs WHERE total_shared_bp >= 20000 AND max_segment_bp >= 10000".replace("ln(1 +", "ln(1.0::DOUBLE +"))
def weighted_edges(s, d):
    return G.weighted_edges(summary(s, d), "log1p", 20_000, 10_000)


@query(f"WITH {EDGES}, {STRENGTH} SELECT e.a, e.b, round(e.w / sqrt(p.strength * q.strength), 9) AS w FROM e JOIN st p ON p.node = a JOIN st q ON q.node = b")
def normalised_graph(s, d):
    return G.normalise(edges(s, d)).withColumn("w", F.round("w", 9))


@query(f"""WITH {EDGES}, {STRENGTH}, {LABELS}, l AS (SELECT * FROM lab WHERE community IS NOT NULL), g AS (SELECT e.w, p.community AS ca, q.community AS cb FROM e JOIN l p ON p.node = a JOIN l q ON q.node = b),
m AS (SELECT sum(w) AS m, sum(CASE WHEN ca = cb THEN w ELSE 0 END) AS inside FROM g), s AS (SELECT community, sum(strength) AS s FROM l JOIN st USING (node) GROUP BY community)
SELECT round(inside / m - sum((s / (2 * m)) * (s / (2 * m))), 9) AS q FROM s, m GROUP BY inside, m""")
def modularity(s, d):
    return G.modularity(edges(s, d), labels(s, d).filter("community is not null")).withColumn("q", F.round("q", 9))


@query(None)
def communities(s, d):
    return C.communities(edges(s, d)).select("node", "community")


def runs(s, d):
    return C.community_runs(edges(s, d), nodes(s, d), [0.5, 1.0], 3, 3)


@query(None)
def community_runs(s, d):
    """Two resolutions and three seeds."""
    return runs(s, d).withColumn("q", F.round("q", 9))


def _consensus(s, d):
    r = runs(s, d).filter("resolution = 1.0").select(F.col("seed").alias("run"), "node", "community", "chosen")
    return cut(r)


@query(None)
def consensus(s, d):
    """Co-assignment over three seeds, by classes of people whom no seed parts."""
    return C.co_assignment(_consensus(s, d))[0]


@query(None)
def consensus_classes(s, d):
    return C.co_assignment(_consensus(s, d))[1]


@query(None)
def assignment_confidence(s, d):
    r = _consensus(s, d)
    return C.assignment_confidence(r, r.filter("chosen").select("node", "community"))


TABLE = f"{LABELS}, t AS (SELECT community AS la, node % 6 AS lb, count(*) AS n FROM lab WHERE community IS NOT NULL AND node % 7 <> 0 GROUP BY ALL)"


def table(s, d):
    other = nodes(s, d).filter("node % 7 <> 0").select("node", (F.col("node") % 6).alias("community"))
    return G.contingency(labels(s, d), other, "node", "community", "community")


@query(f"""WITH {D.GENO}, {TABLE}, c AS (SELECT sum(n * (n - 1) / 2) AS sc, sum(n) AS n FROM t), a AS (SELECT sum(x * (x - 1) / 2) AS sa FROM (SELECT sum(n) AS x FROM t GROUP BY la)), b AS (SELECT sum(x * (x - 1) / 2) AS sb FROM (SELECT sum(n) AS x FROM t GROUP BY lb))
SELECT n::BIGINT AS n, round((sc - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 9) AS ari FROM c, a, b""")
def adjusted_rand(s, d):
    return G.adjusted_rand(table(s, d)).withColumn("ari", F.round("ari", 9))


@query(f"""WITH {D.GENO}, {TABLE}, z AS (SELECT sum(n) AS z FROM t), h AS (SELECT -sum(n / z * ln(n / z)) AS h FROM t, z), a AS (SELECT -sum(n / z * ln(n / z)) AS ha FROM (SELECT sum(n) AS n FROM t GROUP BY la), z), b AS (SELECT -sum(n / z * ln(n / z)) AS hb FROM (SELECT sum(n) AS n FROM t GROUP BY lb), z)
SELECT round(2 * h - ha - hb, 9) AS vi FROM h, a, b""")
def partition_distance(s, d):
    return G.variation_of_information(table(s, d)).withColumn("vi", F.round("vi", 9))


@query(f"""WITH {D.GENO}, {TABLE}, b AS (SELECT la, lb, n, row_number() OVER (PARTITION BY la ORDER BY n DESC, lb) AS k FROM t), x AS (SELECT la, sum(n) AS ra FROM t GROUP BY la), y AS (SELECT lb, sum(n) AS cb FROM t GROUP BY lb)
SELECT la, lb, n, n / (ra + cb - n) AS jaccard FROM b JOIN x USING (la) JOIN y USING (lb) WHERE k = 1""")
def partition_matches(s, d):
    return G.match_partitions(table(s, d))


def _sweep_part(t: int) -> str:
    name = f"s{t}"
    return f"""{name}x AS (SELECT a, b FROM x WHERE w >= {t}), {name}y AS (SELECT a, b FROM {name}x UNION ALL SELECT b, a FROM {name}x),
{name}r AS (SELECT node, node AS reached FROM n UNION SELECT r.node, y.b FROM {name}r r JOIN {name}y y ON y.a = r.reached),
{name}c AS (SELECT node, min(reached) AS component FROM {name}r GROUP BY node),
{name}t AS (SELECT component AS la, community AS lb, count(*) AS n FROM {name}c JOIN lab USING (node) WHERE community IS NOT NULL GROUP BY ALL),
{name}z AS (SELECT sum(n) AS z, sum(n * (n - 1) / 2) AS sc FROM {name}t), {name}a AS (SELECT sum(x * (x - 1) / 2) AS sa FROM (SELECT sum(n) AS x FROM {name}t GROUP BY la)), {name}b AS (SELECT sum(x * (x - 1) / 2) AS sb FROM (SELECT sum(n) AS x FROM {name}t GROUP BY lb)),
{name}h AS (SELECT -sum(n / z * ln(n / z)) AS h FROM {name}t, {name}z), {name}ha AS (SELECT -sum(n / z * ln(n / z)) AS ha FROM (SELECT sum(n) AS n FROM {name}t GROUP BY la), {name}z), {name}hb AS (SELECT -sum(n / z * ln(n / z)) AS hb FROM (SELECT sum(n) AS n FROM {name}t GROUP BY lb), {name}z)"""


def _sweep_row(t: int) -> str:
    n = f"s{t}"
    return f"""SELECT {t}::DOUBLE AS threshold, (SELECT count(*) FROM {n}x) AS n_edges, (SELECT count(DISTINCT component) FROM {n}c) AS n_components, (SELECT max(k) FROM (SELECT count(*) AS k FROM {n}c GROUP BY component)) AS largest,
round((sc - sa * sb / (z * (z - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (z * (z - 1) / 2)), 9) AS ari, round(2 * h - ha - hb, 9) AS vi FROM {n}z, {n}a, {n}b, {n}h, {n}ha, {n}hb"""


@query(f"WITH RECURSIVE {LONG.replace('WITH ', '', 1)}, {LABELS}, {_sweep_part(LEAST)}, {_sweep_part(50000)} {_sweep_row(LEAST)} UNION ALL {_sweep_row(50000)}")
def graph_sweep(s, d):
    out = G.graph_sweep(long_edges(s, d), nodes(s, d), [LEAST, 50_000], labels(s, d).filter("community is not null"))
    return out.withColumns({"ari": F.round("ari", 9), "vi": F.round("vi", 9)})


@query(f"""WITH {EDGES}, {LABELS}, l AS (SELECT * FROM lab WHERE community IS NOT NULL), sm AS (SELECT a, b, w / (w + 100000) AS w FROM e), ev AS (SELECT a, b, w FROM sm UNION ALL SELECT b, a, w FROM sm),
z AS (SELECT community, count(*) AS size FROM l GROUP BY community),
f AS (SELECT l.node, l.community, z.size, o.community AS other, o.size AS osize FROM l JOIN z USING (community) CROSS JOIN z o),
u AS (SELECT f.*, coalesce((SELECT sum(w) FROM ev JOIN l k ON k.node = ev.b WHERE ev.a = f.node AND k.community = f.other), 0) AS sw FROM f),
v AS (SELECT node, community, size, max(CASE WHEN other = community THEN 1 - sw / (size - 1) END) AS a, min(CASE WHEN other <> community THEN 1 - sw / osize END) AS b FROM u GROUP BY ALL)
SELECT community, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM v GROUP BY community""")
def silhouette(s, d):
    sim = edges(s, d).withColumn("w", F.col("w") / (F.col("w") + 100_000))
    return G.silhouette(sim, labels(s, d).filter("community is not null")).withColumn("silhouette", F.round("silhouette", 6))


TWO = EDGES + ", p AS (SELECT a, b, w FROM e WHERE (a + b) % 5 <> 0), q AS (SELECT a, b, w FROM e WHERE (a + b) % 7 <> 0)"


def two(s, d):
    e = edges(s, d)
    return e.filter("(a + b) % 5 <> 0"), e.filter("(a + b) % 7 <> 0")


@query(f"""WITH {TWO}, j AS (SELECT p.a AS x, q.a AS y FROM p FULL JOIN q ON p.a = q.a AND p.b = q.b)
SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS common, count(*) FILTER (WHERE x IS NULL) AS added, count(*) FILTER (WHERE y IS NULL) AS removed,
  count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) / count(*) AS jaccard FROM j""")
def graph_diff(s, d):
    return G.graph_diff(*two(s, d))


@query(f"""WITH {TWO}, sp AS (SELECT node, count(*) AS k, sum(w) AS w FROM (SELECT a AS node, w FROM p UNION ALL SELECT b, w FROM p) GROUP BY node), sq AS (SELECT node, count(*) AS k, sum(w) AS w FROM (SELECT a AS node, w FROM q UNION ALL SELECT b, w FROM q) GROUP BY node)
SELECT coalesce(sp.node, sq.node) AS node, coalesce(sq.k, 0) - coalesce(sp.k, 0) AS degree_delta, coalesce(sq.w, 0) - coalesce(sp.w, 0) AS strength_delta FROM sp FULL JOIN sq ON sp.node = sq.node""")
def degree_delta(s, d):
    return G.degree_delta(*two(s, d))


@query(f"""WITH {EDGES}, {LABELS}, r AS (SELECT w, CASE WHEN p.community IS NULL OR q.community IS NULL THEN 'unassigned' WHEN p.community = q.community THEN 'within' ELSE 'between' END AS relation FROM e LEFT JOIN lab p ON p.node = a LEFT JOIN lab q ON q.node = b)
SELECT relation, count(*) AS n_edges, sum(w) AS w FROM r GROUP BY relation""")
def edge_relations(s, d):
    return G.edge_relation(edges(s, d), labels(s, d)).groupBy("relation").agg(F.count("*").alias("n_edges"), F.sum("w").alias("w"))


@query(f"""WITH {EDGES}, o AS (SELECT DISTINCT sample_id AS node, (sample_id % 5) / 4 AS dose FROM geno)
SELECT a, b, round(w / greatest(p.dose * q.dose, 0.01), 6) AS w FROM e JOIN o p ON p.node = a JOIN o q ON q.node = b""")
def dose_affinity(s, d):
    doses = nodes(s, d).withColumn("dose", F.col("node") % 5 / 4)
    return G.dose_affinity(edges(s, d), doses, 0.01).withColumn("w", F.round("w", 6))


@query(f"""WITH {TWO}, c AS (SELECT a, b, greatest(w - 50000, 0) AS w FROM q), sr AS (SELECT avg(w) AS s FROM p WHERE w > 0), sc AS (SELECT avg(w) AS s FROM c WHERE w > 0)
SELECT coalesce(p.a, c.a) AS a, coalesce(p.b, c.b) AS b, round(0.5 * coalesce(p.w, 0) / (SELECT s FROM sr) + coalesce(0.5 * coalesce(c.w, 0) / (SELECT s FROM sc), 0), 9) AS w FROM p FULL JOIN c ON p.a = c.a AND p.b = c.b""")
def combined_graph(s, d):
    rare, common = two(s, d)
    return G.combine(rare, common.withColumn("w", F.col("w") - 50_000)).withColumn("w", F.round("w", 9))


@query(None)
def graph_factors(s, d):
    e = G.normalise(cut(edges(s, d)))
    return G.sym_nmf(e, nodes(s, d), 3, 5).select("node", "dominant")
