"""Graph operators on edge and node DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def canonical(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct unordered pairs, the lesser end in a; self pairs and nulls go."""
    return edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def component_roots(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node of its component.

    Alternating star contraction: each round joins every node's larger neighbours to its
    least neighbour, then the lesser ones. Edges never grow in number by more than the
    nodes, a path of n nodes needs O(log n) rounds in practice, and each join is an
    equi-join that AQE can split. Rounds end when no edge changes.
    """
    have = cut(canonical(edges, a, b))
    state = None
    for _ in range(max_rounds):
        both = have.unionByName(have.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").filter("a != b").distinct()
        # small star: edges (a < b) seen from b
        least = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(least, "b").select(F.col("low"), "a", "b")
        small = small.select(F.explode(F.array(F.struct("low", F.col("b").alias("v")), F.struct("low", F.col("a").alias("v")))).alias("e")).select("e.low", "e.v")
        have = cut(small.filter("low != v").select(F.col("low").alias("a"), F.col("v").alias("b")).distinct())
        now = have.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return have.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(have.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """nodes with the least node of their component as `component`; nodes without edges keep themselves."""
    roots = component_roots(edges, a, b)
    return nodes.join(roots.select(F.col("node").alias(node), "root"), node, "left").select(*nodes.columns, F.coalesce("root", node).alias("component"))


def component_report(labelled: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """n_nodes, n_components, largest, giant_fraction, n_edges, mean degree and kappa = <k^2>/<k>.

    labelled: node, component. Nodes without edges have degree zero.
    """
    sizes = labelled.groupBy("component").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_components"), F.max("n").alias("largest"))
    e = canonical(edges, a, b)
    degree = e.select(F.explode(F.array("a", "b")).alias(node)).groupBy(node).agg(F.count("*").alias("k"))
    moments = degree.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("s1"), F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0)).alias("s2"))
    d = whole.crossJoin(moments)
    return d.select(
        "n_nodes", "n_components", "largest", (F.col("largest") / F.col("n_nodes")).alias("giant_fraction"), (F.col("s1") / 2).cast("long").alias("n_edges"),
        (F.col("s1") / F.col("n_nodes")).alias("mean_degree"), F.try_divide("s2", "s1").alias("kappa"),
    )


def independent_set(nodes: DataFrame, edges: DataFrame, rank: list, node: str = "node") -> DataFrame:
    """The set that going through the nodes in order of rank (then node) and taking each without a taken neighbour gives.

    Rounds: a node all of whose live neighbours come later is taken, its neighbours go. For
    a fixed total order that is the sequential result. Each round takes a node at least; in
    an order without structure few rounds do, but an order along a chain needs one for each two
    nodes of it (see evaluation.tag_sites for that). rank: sort columns of nodes.
    """
    order = F.struct(*rank, node)
    n = nodes.select(F.col(node).alias("v"), order.alias("o"))
    e = canonical(edges)
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("v"), F.col("b").alias("u"))
    live, links, taken = cut(n), cut(both.join(n, "v").withColumnRenamed("o", "vo").join(n.select(F.col("v").alias("u"), F.col("o").alias("uo")), "u")), None
    while True:
        blocked = links.filter("uo < vo").select("v").distinct()
        won = cut(live.join(blocked, "v", "left_anti").select("v"))
        if won.isEmpty():
            break
        taken = won if taken is None else taken.unionByName(won)
        lost = links.join(won.withColumnRenamed("v", "u"), "u", "left_semi").select("v").distinct()
        gone = cut(won.unionByName(lost).distinct())
        live = cut(live.join(gone, "v", "left_anti"))
        links = cut(links.join(gone, "v", "left_anti").join(gone.withColumnRenamed("v", "u"), "u", "left_anti"))
    return (taken if taken is not None else live.select("v")).select(F.col("v").alias(node))


def weighted_edges(pairs: DataFrame, weight: str, min_total: int = 0, min_segment: int = 0) -> DataFrame:
    """pairs as edges with w: raw bp, log1p of it, n_shared, or mean weight times segments; all three bounds hold."""
    w = {
        "raw": F.col("total_shared_bp").cast("double"), "log1p": F.log1p("total_shared_bp"),
        "n_shared": F.col("n_shared_variants_total").cast("double"), "jaccard_segments": F.col("n_segments").cast("double"),
    }[weight]
    d = pairs.select(F.col("sample_a").alias("a"), F.col("sample_b").alias("b"), w.alias("w"), "total_shared_bp", "max_segment_bp")
    return d.filter((F.col("total_shared_bp") >= min_total) & (F.col("max_segment_bp") >= min_segment) & (F.col("w") > 0)).select("a", "b", "w")


def strength(edges: DataFrame) -> DataFrame:
    """node, degree and strength (summed weight)."""
    return edges.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def normalise(edges: DataFrame) -> DataFrame:
    """Weights over the square root of both ends' strengths."""
    s = strength(edges)
    d = edges.join(s.select(F.col("node").alias("a"), F.col("strength").alias("sa")), "a").join(s.select(F.col("node").alias("b"), F.col("strength").alias("sb")), "b")
    return d.select("a", "b", (F.col("w") / F.sqrt(F.col("sa") * F.col("sb"))).alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: q of a weighted partition (node, community): within / m - resolution * sum (strength / 2m)^2."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    e = edges.join(la, "a").join(lb, "b")
    totals = e.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    s = strength(edges).join(labels, "node").groupBy("community").agg(F.sum("strength").alias("s"))
    d = s.crossJoin(F.broadcast(totals)).groupBy("m", "inside").agg(F.sum((F.col("s") / (2 * F.col("m"))) * (F.col("s") / (2 * F.col("m")))).alias("expected"))
    return d.select((F.col("inside") / F.col("m") - resolution * F.col("expected")).alias("q"))


def match_partitions(table: DataFrame) -> DataFrame:
    """Each la of a contingency table with the lb of the greatest overlap (ties to the least), n, and the Jaccard index of the two."""
    rows, cols = table.groupBy("la").agg(F.sum("n").alias("ra")), table.groupBy("lb").agg(F.sum("n").alias("cb"))
    d = table.groupBy("la").agg(F.min(F.struct((-F.col("n")).alias("m"), "lb")).alias("x")).select("la", "x.lb", (-F.col("x.m")).alias("n"))
    return d.join(rows, "la").join(cols, "lb").select("la", "lb", "n", (F.col("n") / (F.col("ra") + F.col("cb") - F.col("n"))).alias("jaccard"))


def graph_sweep(edges: DataFrame, nodes: DataFrame, thresholds: list[float], reference: DataFrame) -> DataFrame:
    """By threshold on w: edges, components, largest, and the partition's ari and vi against a reference partition (node, community)."""
    e, out = cut(edges), None
    for t in thresholds:
        kept = cut(e.filter(F.col("w") >= t))
        lab = cut(components(nodes.select("node"), kept))
        size = lab.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_components"), F.max("n").alias("largest"))
        table = cut(contingency(lab, reference, "node", "component", "community"))
        one = kept.agg(F.count("*").alias("n_edges")).crossJoin(size).crossJoin(adjusted_rand(table).select("ari")).crossJoin(variation_of_information(table))
        one = one.select(F.lit(float(t)).alias("threshold"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def contingency(x: DataFrame, y: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Counts of label pairs (la, lb) of the nodes that both label."""
    return x.select(key, F.col(a).alias("la")).join(y.select(key, F.col(b).alias("lb")), key).filter("la is not null and lb is not null").groupBy("la", "lb").agg(F.count("*").alias("n"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row: n and ari of a contingency table; null where it is degenerate."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = table.agg(two("n").alias("sc"), F.sum("n").alias("n"))
    rows = table.groupBy("la").agg(F.sum("n").alias("x")).agg(two("x").alias("sa"))
    cols = table.groupBy("lb").agg(F.sum("n").alias("x")).agg(two("x").alias("sb"))
    d = cells.crossJoin(rows).crossJoin(cols)
    expected = F.col("sa") * F.col("sb") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    return d.select("n", F.when((F.col("n") > 1) & (F.abs(top) > 1e-12), (F.col("sc") - expected) / top).alias("ari"))


def variation_of_information(table: DataFrame) -> DataFrame:
    """One row: vi (nats) = 2 H(a, b) - H(a) - H(b)."""
    total = F.broadcast(table.agg(F.sum("n").alias("t")))
    h = lambda df: df.crossJoin(total).agg(F.coalesce(-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))), F.lit(0.0)).alias("h"))
    ha = h(table.groupBy("la").agg(F.sum("n").alias("n"))).withColumnRenamed("h", "ha")
    hb = h(table.groupBy("lb").agg(F.sum("n").alias("n"))).withColumnRenamed("h", "hb")
    return h(table).crossJoin(ha).crossJoin(hb).select((2 * F.col("h") - F.col("ha") - F.col("hb")).alias("vi"))


def silhouette(similar: DataFrame, labels: DataFrame) -> DataFrame:
    """community, n, silhouette: the mean over members of (b - a) / max(a, b).

    Distance is 1 - w with w in [0, 1]; pairs without an edge are at distance 1 and are counted, not
    made. A member alone in its community has 0.
    """
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    both = similar.unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    sums = both.join(labels.select(F.col("node").alias("b"), F.col("community").alias("other")), "b").groupBy(F.col("a").alias("node"), "other").agg(F.sum("w").alias("sw"))
    own = labels.join(sizes, "community")
    d = own.join(sums, "node", "left").join(sizes.select(F.col("community").alias("other"), F.col("size").alias("osize")), "other", "left")
    inside = F.max(F.when(F.col("other") == F.col("community"), F.col("sw")))
    nearest = F.min(F.when(F.col("other") != F.col("community"), 1 - F.col("sw") / F.col("osize")))
    d = d.groupBy("node", "community", "size").agg(inside.alias("i"), nearest.alias("near"))
    a = 1 - F.coalesce("i", F.lit(0.0)) / (F.col("size") - 1)
    b = F.coalesce("near", F.lit(1.0))
    score = F.when(F.col("size") > 1, F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))).otherwise(0.0)
    d = d.withColumn("s", score)
    return d.groupBy("community").agg(F.count("*").alias("n"), F.avg("s").alias("silhouette"))


def graph_diff(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: edges in common, added, removed, and the Jaccard index of the edge sets."""
    j = canonical(x).withColumn("ix", F.lit(1)).join(canonical(y).withColumn("iy", F.lit(1)), ["a", "b"], "full")
    d = j.agg(F.count_if(F.col("ix").isNotNull() & F.col("iy").isNotNull()).alias("common"), F.count_if(F.col("ix").isNull()).alias("added"), F.count_if(F.col("iy").isNull()).alias("removed"))
    return d.withColumn("jaccard", F.try_divide(F.col("common"), F.col("common") + F.col("added") + F.col("removed")))


def degree_delta(x: DataFrame, y: DataFrame) -> DataFrame:
    """node, degree and strength in y less those in x; absent nodes count as zero."""
    a, b = strength(x).select("node", F.col("degree").alias("dx"), F.col("strength").alias("sx")), strength(y).select("node", F.col("degree").alias("dy"), F.col("strength").alias("sy"))
    d = a.join(b, "node", "full").na.fill(0)
    return d.select("node", (F.col("dy") - F.col("dx")).alias("degree_delta"), (F.col("sy") - F.col("sx")).alias("strength_delta"))


def edge_relation(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges with relation: within, between or unassigned (a null label)."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    d = edges.join(la, "a", "left").join(lb, "b", "left")
    return d.withColumn("relation", F.when(F.col("ca").isNull() | F.col("cb").isNull(), "unassigned").when(F.col("ca") == F.col("cb"), "within").otherwise("between"))


def dose_affinity(edges: DataFrame, doses: DataFrame, floor: float = 1e-9) -> DataFrame:
    """Weights over the product of both ends' doses, kept off zero."""
    d = edges.join(doses.select(F.col("node").alias("a"), F.col("dose").alias("da")), "a").join(doses.select(F.col("node").alias("b"), F.col("dose").alias("db")), "b")
    return d.select("a", "b", (F.col("w") / F.greatest(F.col("da") * F.col("db"), F.lit(floor))).alias("w"))


def combine(rare: DataFrame, common: DataFrame) -> DataFrame:
    """Half of each graph's weight over its mean positive weight; negative common weights count as zero."""
    c = common.withColumn("w", F.greatest("w", F.lit(0.0)))
    sr, sc = (F.broadcast(g.filter("w > 0").agg(F.avg("w").alias(name))) for g, name in ((rare, "sr"), (c, "sc")))
    d = rare.select("a", "b", F.col("w").alias("wr")).join(c.select("a", "b", F.col("w").alias("wc")), ["a", "b"], "full").na.fill(0.0, ["wr", "wc"]).crossJoin(sr).crossJoin(sc)
    return d.select("a", "b", (F.coalesce(0.5 * F.col("wr") / F.col("sr"), F.lit(0.0)) + F.coalesce(0.5 * F.col("wc") / F.col("sc"), F.lit(0.0))).alias("w"))


def sym_nmf(edges: DataFrame, nodes: DataFrame, k: int, rounds: int, seed: int = 0) -> DataFrame:
    """node, factor array, dominant (0-based, first of equals) of S ~ H H^T by multiplicative updates.

    H starts from hashes. S H is an edge join with vector sums, H^T H a k x k aggregate.
    """
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    unit = lambda i: (F.pmod(F.xxhash64("node", F.lit(i), F.lit(seed)), F.lit(1_000_003)) + 1) / 1_000_004
    h = cut(nodes.select("node", F.array(*[unit(i) for i in range(k)]).alias("h")))
    for _ in range(rounds):
        g = h.select(*[F.sum(F.get("h", F.lit(i)) * F.get("h", F.lit(j))).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
        sh = both.join(h.withColumnRenamed("node", "b"), "b").groupBy("a").agg(*[F.sum(F.col("w") * F.get("h", F.lit(i))).alias(f"s{i}") for i in range(k)])
        d = h.join(sh.withColumnRenamed("a", "node"), "node", "left").na.fill(0.0)
        low = [sum((F.get("h", F.lit(j)) * float(g[f"g{j}_{i}"]) for j in range(k)), F.lit(0.0)) for i in range(k)]
        h = cut(d.select("node", F.array(*[F.get("h", F.lit(i)) * (0.5 + 0.5 * F.col(f"s{i}") / F.greatest(low[i], F.lit(1e-12))) for i in range(k)]).alias("h")))
    return h.select("node", F.col("h").alias("factor"), (F.array_position("h", F.array_max("h")) - 1).alias("dominant"))
