"""Evaluation operators over pairs, partitions, copies and configurations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.assignment import matching
from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut, stored
from . import graph
from .intervals import overlap_join, point_in_interval, total, union
from .pairs import LISTED, MEETINGS, PAIR, meetings
from .stats import value_ranks

#: Parts of segments (a row for each person and bucket) that go to all tasks.
FEW_SEGMENTS = 200_000


def assign_overlaps(truth: DataFrame, calls: DataFrame, keys: list[str], size: int) -> DataFrame:
    """One-to-one assignment of calls (call, lo, hi) to truths (truth, lo, hi) of maximum total overlap; which of several best ones is fixed by their order.

    Overlaps are found by a bucketed join and fall into runs along the axis, which don't touch each
    other's choice; each run is solved exactly in its task, over the pairs that overlap only.
    A run is a union of what truths and calls cover from their first to their last overlap, so
    pairs that share a truth or a call are in one.
    """
    import pandas as pd

    j = overlap_join(truth, calls, keys, size)
    j = stored(j.select(*keys, "truth", "call", F.greatest("lo", "r_lo").alias("_lo"), F.least("hi", "r_hi").alias("_hi")).withColumn("bp", F.col("_hi") - F.col("_lo") + 1))
    reach = [j.groupBy(*keys, c).agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).select(*keys, "lo", "hi") for c in ("truth", "call")]
    runs = union(reach[0].unionByName(reach[1]), keys)
    fields = {f.name: f.dataType.simpleString() for f in j.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*keys, "truth", "call", "bp"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(pdf["truth"].unique()), sorted(pdf["call"].unique())
        r, c = pdf["truth"].map({x: i for i, x in enumerate(rows)}), pdf["call"].map({x: i for i, x in enumerate(cols)})
        kept = matching(zip(r.tolist(), c.tolist(), pdf["bp"].tolist()))
        return pdf.loc[[(i, k) in kept for i, k in zip(r, c)], [*keys, "truth", "call", "bp"]]

    return point_in_interval(j, runs.withColumn("_run", F.col("lo")), keys, 100 * size, pos="_lo").groupBy(*keys, "_run").applyInPandas(choose, schema)


def tag_sites(pairs: DataFrame, sites: DataFrame, r2: float) -> DataFrame:
    """Sites kept so that no two in linkage at r2 stay (pairs: chrom, pos_a, pos_b, r2): an independent set in the order of a hash, which settles in few rounds on chains of any length."""
    name = lambda p: F.concat_ws(":", F.col("chrom").cast("string"), F.lpad(F.col(p).cast("string"), 12, "0"))
    e = cut(pairs.filter(F.col("r2") >= r2).select(name("pos_a").alias("a"), name("pos_b").alias("b")))
    n = sites.select(name("pos").alias("node"))
    kept = graph.independent_set(n, e, [F.xxhash64("node")])
    return sites.withColumn("node", name("pos")).join(kept, "node", "left_semi").drop("node")


def tag_counts(pairs: DataFrame, sites: DataFrame, levels: list[float]) -> DataFrame:
    """By r2 level and chrom: sites and tags."""
    p, s, out = cut(pairs), cut(sites.select("chrom", "pos").distinct()), None
    for level in levels:
        n = s.groupBy("chrom").agg(F.count("*").alias("n_sites")).join(tag_sites(p, s, level).groupBy("chrom").agg(F.count("*").alias("n_tags")), "chrom", "left")
        part = n.na.fill(0, ["n_tags"]).withColumn("r2", F.lit(float(level)))
        out = part if out is None else out.unionByName(part)
    return out


def support_cube(support: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of values over every combination of keys; ALL stands for all levels of a key."""
    d = support.select(*[F.col(k).cast("string").alias(k) for k in keys], *values)
    return d.cube(*keys).agg(*[F.sum(v).alias(v) for v in values]).select(*[F.coalesce(k, F.lit("ALL")).alias(k) for k in keys], *values)


def config_diagnostics(segments: DataFrame, config: str) -> DataFrame:
    """Per configuration and pair: segments, bp, sites, sites a kb (null for no length), share of one-site segments."""
    d = segments.groupBy(config, *PAIR).agg(F.count("*").alias("n_segments"), F.sum("length_bp").alias("bp"), F.sum("n_shared_variants").alias("n_sites"), F.count_if(F.col("length_bp") == 1).alias("n_points"))
    return d.select(config, *PAIR, "n_segments", "bp", "n_sites", F.try_divide(F.col("n_sites") * 1000, F.col("bp")).alias("per_kb"), F.try_divide("n_points", "n_segments").alias("point_share"))


def segment_evidence(segments: DataFrame, genotypes: DataFrame, size: int) -> DataFrame:
    """For each segment (seg, sample_a, sample_b, chrom, lo, hi): sites where both, either (called in both) carry, sites called in both, longest gap of shared ones.

    Both people's cells are found by one join, before which few segments are broadcast, and
    meet by segment. Where a cell repeats, its largest dosage counts.
    """
    sides = F.explode(F.array(*[F.struct(F.col(c).alias("sample_id"), F.lit(k).alias("_side")) for k, c in enumerate(PAIR)])).alias("_s")
    s = segments.select("seg", *PAIR, "chrom", "lo", "hi", sides).select("*", "_s.*").drop("_s")
    s = stored(s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size)))))
    g = genotypes.select("sample_id", "chrom", "pos", "dosage", F.floor(F.col("pos") / size).alias("_b"))
    j = g.join(broadcast_if_small(s, FEW_SEGMENTS), ["sample_id", "chrom", "_b"]).filter("pos between lo and hi").select("seg", *PAIR, "chrom", "pos", "_side", "dosage").repartition("seg")
    of = lambda k: F.max(F.when(F.col("_side") == k, F.col("dosage")))
    j = j.groupBy("seg", *PAIR, "chrom", "pos").agg(of(0).alias("x"), of(1).alias("y"), (F.max("_side") - F.min("_side")).alias("_two")).filter("_two = 1")
    both = (F.col("x") > 0) & (F.col("y") > 0)
    called = F.col("x").isNotNull() & F.col("y").isNotNull()
    last = F.max(F.when(both, F.col("pos"))).over(Window.partitionBy("seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    j = j.withColumn("_gap", F.when(both, F.col("pos") - last))
    return j.groupBy("seg", *PAIR, "chrom").agg(F.count_if(both).alias("n_both"), F.count_if(called & ((F.col("x") > 0) | (F.col("y") > 0))).alias("n_either"), F.count_if(called).alias("n_called"), F.max("_gap").alias("max_gap"))


def kin_candidates(pairs: DataFrame, labels: DataFrame, segment: int, small: int, median: float) -> DataFrame:
    """kind, a, b or community: pairs with a long segment, and small communities with a high median of shared bp."""
    pairs = stored(pairs.select(*PAIR, "max_segment_bp", "total_shared_bp"))  # read twice, made once
    one = pairs.filter(F.col("max_segment_bp") >= segment).select(F.lit("pair").alias("kind"), F.col("sample_a").alias("a"), F.col("sample_b").alias("b"), F.lit(None).cast("long").alias("community"))
    sizes = labels.groupBy("community").agg(F.count("*").alias("n")).filter(F.col("n") <= small)
    la, lb = labels.select(F.col("node").alias("sample_a"), "community"), labels.select(F.col("node").alias("sample_b"), F.col("community").alias("_c"))
    inner = pairs.join(la, "sample_a").join(lb, "sample_b").filter("community = _c").groupBy("community").agg(F.median("total_shared_bp").alias("m")).filter(F.col("m") >= median)
    two = inner.join(sizes, "community").select(F.lit("community").alias("kind"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "community")
    return one.unionByName(two)


def founder_candidates(pairs: DataFrame, labels: DataFrame, least_size: int, ratio: float, silhouettes: DataFrame | None = None, least_silhouette: float = 0.0, least_reported: int = 0) -> DataFrame:
    """Communities of enough members whose median sharing within is a multiple of that with others: n, medians, ratio.

    With least_silhouette above 0 a community's silhouette (silhouettes: community,
    silhouette) must reach it as well, and one without fails; at 0 or below it is not asked.
    least_reported is a second floor on the size.
    """
    la, lb = labels.select(F.col("node").alias("sample_a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("sample_b"), F.col("community").alias("cb"))
    j = pairs.join(la, "sample_a").join(lb, "sample_b")
    inside = j.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.median("total_shared_bp").alias("within"))
    out = j.filter("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("community"), "total_shared_bp").groupBy("community").agg(F.median("total_shared_bp").alias("between"))
    n = labels.groupBy("community").agg(F.count("*").alias("n")).filter(F.col("n") >= least_size)
    d = n.join(inside, "community").join(out, "community").withColumn("ratio", F.try_divide("within", "between")).filter((F.col("ratio") >= ratio) & (F.col("n") >= least_reported))
    if least_silhouette <= 0 or silhouettes is None:
        return d
    return d.join(silhouettes.filter(F.col("silhouette") >= least_silhouette).select("community", "silhouette"), "community")


def ancestry_names(weights: DataFrame, k: int) -> DataFrame:
    """One-to-one names for files by enrichment: weights (file, label, w) less the label's mean, greatest first; confirmed where that is the file's own greatest one.

    Files and labels are few (k at most); the greedy choice runs on the driver over k x k rows.
    """
    mean = weights.groupBy("label").agg(F.avg("w").alias("m"))
    rows = weights.join(mean, "label").select("file", "label", (F.col("w") - F.col("m")).alias("e")).orderBy(F.desc("e"), "file", "label").limit(k * k).collect()
    files, labels, out, best = set(), set(), [], {}
    for r in rows:
        best.setdefault(r["file"], r["label"])
        if r["file"] not in files and r["label"] not in labels:
            files.add(r["file"])
            labels.add(r["label"])
            out.append((r["file"], r["label"], float(r["e"]), best[r["file"]] == r["label"]))
    return weights.sparkSession.createDataFrame(out, f"file {weights.schema['file'].dataType.simpleString()}, label {weights.schema['label'].dataType.simpleString()}, enrichment double, confirmed boolean")


def dyadic_variance(pairs: DataFrame, components: DataFrame, value: str) -> DataFrame:
    """One row: n, mean and its variance robust to pairs that share a component.

    Sum over components of squared sums of incident residuals, less squares of pairs counted
    with both ends in one component or in the same two.
    """
    ca, cb = components.select(F.col("node").alias("sample_a"), F.col("component").alias("ca")), components.select(F.col("node").alias("sample_b"), F.col("component").alias("cb"))
    j = pairs.join(ca, "sample_a").join(cb, "sample_b")
    whole = isinstance(pairs.schema[value].dataType, IntegralType)
    of = lambda c: F.col(c).cast("decimal(20,0)" if whole else "double")
    cell = cut(j.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.count("*").alias("n"), F.count(value).alias("k"), F.sum(of(value)).alias("v")))
    total = cell.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n"), F.sum("k").alias("_k"), F.sum("v").alias("_v"))
    # residuals times the number of pairs: of whole values they are whole, and nothing is lost before the squares
    u = F.col("v") * of("_k") - of("k") * F.col("_v")
    cell = cell.crossJoin(F.broadcast(total)).select("_k", "ca", "cb", (u.cast("decimal(38,0)") if whole else u).alias("u"))
    square = lambda d: d.agg(F.sum(F.pow(F.col("u").cast("double") / F.col("_k"), F.lit(2.0))).alias("s"))
    one = square(cell.select("_k", "u", F.explode(F.array_distinct(F.array("ca", "cb"))).alias("c")).groupBy("c", "_k").agg(F.sum("u").alias("u")))
    two = square(cell.filter("ca <> cb")).select(F.coalesce("s", F.lit(0.0)).alias("s2"))
    mean = F.try_divide(F.col("_v").cast("double"), F.col("_k"))
    return total.crossJoin(one).crossJoin(two).select(F.col("_n").alias("n"), mean.alias("mean"), F.try_divide(F.col("s") - F.col("s2"), F.col("_n") * F.col("_n")).alias("variance"))


def sharing_by_partition(pairs: DataFrame, partitions: DataFrame, kin: DataFrame) -> DataFrame:
    """By partition and relation (each, and ALL): pairs and bp within and between communities. partitions: partition, node, community."""
    pa, pb = partitions.select("partition", F.col("node").alias("sample_a"), F.col("community").alias("ca")), partitions.select("partition", F.col("node").alias("sample_b"), F.col("community").alias("cb"))
    j = pairs.join(kin, PAIR, "left").join(pa, "sample_a").join(pb, ["partition", "sample_b"])
    relation = F.when(F.col("kin").isNull(), "unknown").when(F.col("kin") >= 0.0442, "related").otherwise("unrelated")
    side = F.when(F.col("ca") == F.col("cb"), "within").otherwise("between")
    d = j.select("partition", side.alias("side"), F.explode(F.array(relation, F.lit("ALL"))).alias("relation"), "total_shared_bp")
    return d.groupBy("partition", "relation", "side").agg(F.count("*").alias("n_pairs"), F.sum("total_shared_bp").alias("bp"))


def territory(copies: DataFrame, pair_keys: list[str], within: str) -> DataFrame:
    """bp of each copy pair's territory, counted once, summed by the flag `within` (copies in one person or two)."""
    t = total(union(copies, [*pair_keys, within]), [*pair_keys, within], "bp")
    return t.groupBy(within).agg(F.count("*").alias("n_pairs"), F.sum("bp").alias("bp"))


def modeling_master(people: DataFrame, labels: DataFrame, groups: DataFrame, metadata: DataFrame) -> DataFrame:
    """people with community, kinship group and metadata, and flags of what was found; nothing is filled."""
    d = people
    for name, t in (("community", labels), ("group", groups), ("metadata", metadata)):
        d = d.join(t.withColumn(f"has_{name}", F.lit(True)), "sample_id", "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return d


def compare_configs(a: DataFrame, b: DataFrame, keys: list[str], value: str, stratum: str) -> DataFrame:
    """By stratum and ALL: n in both, Spearman correlation of values, median relative change."""
    j = a.select(*keys, stratum, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)
    j = j.withColumn("scope", F.explode(F.array(F.col(stratum).cast("string"), F.lit("ALL"))))
    j = cut(j.select("scope", "x", "y"))
    rx, ry = value_ranks(j, "x", ["scope"]).select("scope", "x", F.col("rank").alias("rx")), value_ranks(j, "y", ["scope"]).select("scope", "y", F.col("rank").alias("ry"))
    d = j.join(rx, ["scope", "x"]).join(ry, ["scope", "y"])
    return d.groupBy("scope").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman"), F.median(F.try_divide(F.abs(F.col("y") - F.col("x")), F.col("x"))).alias("relative_change"))


def ibd_inventory(segments: DataFrame, known: DataFrame) -> DataFrame:
    """By file and chromosome, by file, and over all: records, those with both people known, first and last position, shortest and longest."""
    ids = known.select("sample_id").distinct()
    d = segments.join(ids.select(F.col("sample_id").alias("id1"), F.lit(1).alias("_1")), "id1", "left").join(ids.select(F.col("sample_id").alias("id2"), F.lit(1).alias("_2")), "id2", "left")
    length = F.col("hi") - F.col("lo") + 1
    d = d.rollup("file", "chrom").agg(F.count("*").alias("n"), F.count_if(F.col("_1").isNotNull() & F.col("_2").isNotNull()).alias("n_known"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.min(length).alias("shortest"), F.max(length).alias("longest"))
    return d.select(F.coalesce(F.col("file").cast("string"), F.lit("ALL")).alias("file"), F.coalesce(F.col("chrom").cast("string"), F.lit("ALL")).alias("chrom"), "n", "n_known", "first", "last", "shortest", "longest")


def check_roh(roh: DataFrame, people: DataFrame, printed: float = 0.0005) -> DataFrame:
    """rule, n of breaches: kb that isn't (end - start + 1) / 1000 within print precision, people on one side only."""
    bad = roh.filter(F.abs(F.col("kb") - (F.col("hi") - F.col("lo") + 1) / 1000) > printed).agg(F.count("*").alias("n")).select(F.lit("length").alias("rule"), "n")
    p = people.select("sample_id").distinct().withColumn("_p", F.lit(1)).join(roh.select("sample_id").distinct().withColumn("_r", F.lit(1)), "sample_id", "full")
    alone = p.agg(F.count_if(F.col("_p").isNull()).alias("unknown_person"), F.count_if(F.col("_r").isNull()).alias("without_roh")).unpivot([], ["unknown_person", "without_roh"], "rule", "n")
    return bad.unionByName(alone)


def check_missingness(df: DataFrame, printed: float = 5e-7) -> DataFrame:
    """Rows whose f_miss isn't n_missing / n_sites within text rounding."""
    return df.filter(F.abs(F.col("f_miss") - F.try_divide("n_missing", "n_sites")) > printed)


def family_concentration(labels: DataFrame, families: DataFrame) -> DataFrame:
    """By community: n with a known family, families, the largest one's share, and pairs of one family over all pairs."""
    j = labels.join(families, "node").filter("family is not null")
    n = j.groupBy("community", "family").agg(F.count("*").alias("n"))
    d = n.groupBy("community").agg(F.sum("n").alias("n"), F.count("*").alias("n_families"), F.max("n").alias("top"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    return d.select("community", "n", "n_families", (F.col("top") / F.col("n")).alias("top_share"), F.try_divide(F.col("same"), F.col("n") * (F.col("n") - 1) / 2).alias("same_family_pairs"))


def support_burden(loci: DataFrame, support: DataFrame, window: int) -> DataFrame:
    """Windows of loci (chrom, pos, n): counts weighted by each ancestry's share of support (chrom, pos, code, n); null shares for none."""
    t = support.groupBy("chrom", "pos").agg(F.sum("n").alias("t"))
    s = support.join(t, ["chrom", "pos"]).select("chrom", "pos", "code", F.try_divide("n", "t").alias("share"))
    j = loci.withColumn("window_id", F.floor(F.col("pos") / window)).join(s, ["chrom", "pos"])
    return j.groupBy("chrom", "window_id", "code").agg(F.sum(F.col("n") * F.col("share")).alias("burden"), F.count("*").alias("n_loci"))


def diploid_brier(df: DataFrame, probabilities: tuple[str, str], truths: tuple[str, str]) -> DataFrame:
    """One row: n and brier, the mean over rows of the squared differences of both haplotypes' probabilities (arrays by class) to their true classes, over 4. Rows with a null in any are left out."""
    def off(p: str, y: str) -> Column:
        squares = F.transform(p, lambda x, k: F.pow(x - F.when(k == F.col(y), 1.0).otherwise(0.0), F.lit(2.0)))
        return F.when(F.col(y).isNotNull(), F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))

    parts = [off(p, y) for p, y in zip(probabilities, truths)]
    return df.select(((parts[0] + parts[1]) / 4).alias("b")).filter("b is not null").agg(F.count("*").alias("n"), F.avg("b").alias("brier"))


def dose_errors(df: DataFrame, probability: str, truth: str, doses: list[list[float]]) -> DataFrame:
    """ancestry, n, mae: the mean absolute difference of expected and true dose of each ancestry.

    probability: an array over states; truth: the true state; doses: each state's dose of each ancestry. Rows with a null are left out.
    """
    d = df.select(F.col(probability).alias("p"), F.col(truth).cast("int").alias("y")).filter("p is not null and y is not null")
    found = []
    for k in range(len(doses[0])):
        of = F.array(*[F.lit(float(s[k])) for s in doses])
        expected = F.aggregate(F.zip_with("p", of, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        found.append(F.struct(F.lit(k).cast("long").alias("ancestry"), F.abs(expected - F.get(of, F.col("y"))).alias("e")))
    return d.select(F.explode(F.array(*found)).alias("x")).groupBy("x.ancestry").agg(F.count("*").alias("n"), F.avg("x.e").alias("mae"))


def diploid_scores(df: DataFrame, truth: str, call: str, classes: int) -> DataFrame:
    """One row: n, macro F1 over the classes with support, and over all classes (null when one is absent)."""
    spark = df.sparkSession
    t = df.groupBy(F.col(truth).alias("c")).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(call)).alias("hit"))
    p = df.groupBy(F.col(call).alias("c")).agg(F.count("*").alias("called"))
    d = F.broadcast(spark.range(classes).select(F.col("id").alias("c"))).join(t, "c", "left").join(p, "c", "left").na.fill(0)
    f1 = 2 * F.col("hit") / F.greatest(F.col("support") + F.col("called"), F.lit(1))
    return d.agg(F.sum("support").alias("n"), F.avg(F.when(F.col("support") > 0, f1)).alias("supported_f1"), F.when(F.min("support") > 0, F.avg(f1)).alias("fixed_f1"))


def stratified_bootstrap(df: DataFrame, stratum: str, group: str, value: str, replicates: int, seed: int = 0) -> DataFrame:
    """One row: mean of strata means and the percentile interval of replicates that resample groups within strata, strata weighing the same."""
    g = df.groupBy(F.col(stratum).alias("_stratum"), F.col(group).alias("_group")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    u = (F.pmod(F.xxhash64("_stratum", "_group", "_r", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    w = sum((F.when(F.col("_u") > p, 1).otherwise(0) for p in (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815)), F.lit(0))
    d = g.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_r")).withColumn("_u", u).withColumn("_w", w)
    per = d.groupBy("_r", "_stratum").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("m"))
    m = per.groupBy("_r").agg(F.avg("m").alias("m")).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    point = g.groupBy("_stratum").agg((F.sum("_s") / F.sum("_n")).alias("m")).agg(F.avg("m").alias("mean"))
    return point.crossJoin(m)


def header_gate(columns: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Breaches of a header contract: columns (name, type) that are missing or of another type."""
    want = F.broadcast(columns.sparkSession.createDataFrame(list(needed.items()), "name string, want string"))
    j = want.join(columns, "name", "left")
    return j.filter(F.col("type").isNull() | (F.col("type") != F.col("want"))).select("name", "want", F.coalesce("type", F.lit("missing")).alias("found"))


def pc_relate(genotypes: DataFrame, components: DataFrame, names: list[str]) -> DataFrame:
    """Ancestry-adjusted kinship of pairs called at a common site.

    Each site's frequency is regressed on the components over its called people (normal
    equations aggregated by site and solved in a bounded pandas group of one row), residual
    products are summed over sites, over sqrt(p(1 - p)) products of both.
    """
    import numpy as np
    import pandas as pd

    x = ["_one", *names]
    g = stored(genotypes.filter("dosage is not null").join(components, "sample_id").select("sample_id", "chrom", "pos", "dosage", *names)).withColumn("_one", F.lit(1.0))
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    # a site's people are few: they go to it as they are, sums of a part of them would be wider
    site = g.repartition("chrom", "pos").groupBy("chrom", "pos").agg(*[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"g{i}_{j}") for i, j in cells], *[F.sum(F.col(c) * F.col("dosage") / 2).alias(f"y{i}") for i, c in enumerate(x)])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                m = np.zeros((len(x), len(x)))
                for i, j in cells:
                    m[i, j] = m[j, i] = getattr(r, f"g{i}_{j}")
                out.append((r.chrom, r.pos, *(np.linalg.pinv(m) @ np.array([getattr(r, f"y{i}") for i in range(len(x))])).tolist()))
            yield pd.DataFrame(out, columns=["chrom", "pos", *[f"b{i}" for i in range(len(x))]])

    beta = site.mapInPandas(solve, "chrom long, pos long, " + ", ".join(f"b{i} double" for i in range(len(x))))
    f = sum((F.col(f"b{i}") * F.col(c) for i, c in enumerate(x)), F.lit(0.0))
    r = g.join(beta, ["chrom", "pos"]).withColumn("f", F.greatest(F.lit(0.01), F.least(F.lit(0.99), f)))
    r = stored(r.select("sample_id", "chrom", "pos", "dosage", "f"))
    j = meetings(r, ["dosage", "f"], LISTED, MEETINGS)
    rest = lambda k: F.col(f"dosage_{k}") - 2 * F.col(f"f_{k}")
    root = lambda k: F.sqrt(F.col(f"f_{k}") * (1 - F.col(f"f_{k}")))
    return j.groupBy(*PAIR).agg((F.sum(rest("a") * rest("b")) / (4 * F.sum(root("a") * root("b")))).alias("kinship"), F.count("*").alias("n_sites"))
