"""Ancestry, map, catalogue and relatedness operators on tables."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..plans.lineage import stored
from . import graph
from .axis import SIZE, with_known
from .intervals import interpolate, overlap_join, point_in_interval


def copies_in_ancestry(copies: DataFrame, painting: DataFrame, size: int) -> DataFrame:
    """Copies of variants (sample_id, chrom, pos, dosage 1 or 2) laid on a painting (sample_id, chrom, lo, hi, c0, c1).

    code and share of each copy: homozygous carriers and equal codes are exact; a single
    copy between two codes gives half to each; positions outside the painting have code -1.
    """
    j = point_in_interval(copies, painting, ["sample_id", "chrom"], size)
    d = F.col("dosage")
    half = F.array(F.struct(F.col("c0").alias("code"), (d / 2).alias("share")), F.struct(F.col("c1").alias("code"), (d / 2).alias("share")))
    outside = F.array(F.struct(F.lit(-1).cast("long").alias("code"), d.cast("double").alias("share")))
    exact = F.col("c0").isNotNull() & ((d == 2) | (F.col("c0") == F.col("c1")))
    j = j.withColumn("exact", F.coalesce(exact, F.lit(False))).withColumn("_e", F.when(F.col("c0").isNull(), outside).otherwise(half))
    return j.select("sample_id", "chrom", "pos", "dosage", "exact", F.explode("_e").alias("e")).select("sample_id", "chrom", "pos", "dosage", "exact", "e.code", "e.share")


def ancestry_enrichment(attributed: DataFrame, painting: DataFrame, keys: list[str]) -> DataFrame:
    """By key and code: observed copies, those expected from the painted length, and their ratio; sums first, ratios last."""
    o = attributed.filter("code >= 0").groupBy(*keys, "code").agg(F.sum("share").alias("observed"))
    length = F.col("hi") - F.col("lo") + 1
    p = painting.withColumn("_bp", length).select(*keys, "_bp", F.explode(F.array("c0", "c1")).alias("code")).groupBy(*keys, "code").agg(F.sum("_bp").alias("bp"))
    if keys:
        total, all_bp = o.groupBy(*keys).agg(F.sum("observed").alias("all")), p.groupBy(*keys).agg(F.sum("bp").alias("all_bp"))
        d = p.join(o, [*keys, "code"], "left").join(total, keys).join(all_bp, keys)
    else:
        d = p.join(o, ["code"], "left").crossJoin(o.agg(F.sum("observed").alias("all"))).crossJoin(p.agg(F.sum("bp").alias("all_bp")))
    expected = F.col("all") * F.col("bp") / F.col("all_bp")
    seen = F.coalesce("observed", F.lit(0.0))
    return d.select(*keys, "code", seen.alias("observed"), expected.alias("expected"), F.try_divide(seen, expected).alias("ratio"))


def inverse_map(points: DataFrame, curve: DataFrame, keys: list[str], scale: int = 1_000_000) -> DataFrame:
    """points (cm) with lo_pos and hi_pos: the positions of that value, the ends of a plateau where it has one; null outside.

    cM are compared as integers of 1 / scale.
    """
    c = curve.select(*keys, "pos", F.round(F.col("cm") * scale).cast("long").alias("pos_cm"))
    knots = c.groupBy(*keys, "pos_cm").agg(F.min("pos").alias("a"), F.max("pos").alias("z"))
    w = Window.partitionBy(*keys).orderBy("pos_cm")
    spans = knots.select(*keys, F.col("pos_cm").alias("lo"), F.coalesce(F.lead("pos_cm").over(w) - 1, F.col("pos_cm")).alias("hi"), "a", "z", F.lead("a").over(w).alias("_next"), F.lead("pos_cm").over(w).alias("_ncm"))
    p = points.withColumn("_q", F.round(F.col("cm") * scale).cast("long"))
    j = point_in_interval(p, spans, keys, scale, pos="_q")
    at = F.col("_q") == F.col("lo")
    between = F.col("z") + (F.col("_q") - F.col("lo")) * (F.col("_next") - F.col("z")) / (F.col("_ncm") - F.col("lo"))
    return j.select(*points.columns, F.when(at, F.col("a").cast("double")).otherwise(between).alias("lo_pos"), F.when(at, F.col("z").cast("double")).otherwise(between).alias("hi_pos"))


def equal_regions(curve: DataFrame, keys: list[str], n: int, margin: float) -> DataFrame:
    """n parts of equal cM of each key's map, margins (cM) at both ends left out: region, lo_cm, hi_cm."""
    d = curve.groupBy(*keys).agg((F.min("cm") + margin).alias("a"), (F.max("cm") - margin).alias("z")).filter("z > a")
    step = (F.col("z") - F.col("a")) / n
    return d.select(*keys, "a", step.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("region")).select(*keys, F.col("region").cast("long").alias("region"), (F.col("a") + F.col("region") * F.col("_s")).alias("lo_cm"), (F.col("a") + (F.col("region") + 1) * F.col("_s")).alias("hi_cm"))


def burden_within(queries: DataFrame, events: DataFrame, keys: list[str], radius: int, weight: str) -> DataFrame:
    """queries (id, pos) with n and total weight of events within the radius on either side.

    Events go to every bucket that their radius touches, queries to their own.
    """
    size = max(SIZE, 2 * radius)
    reach = F.explode(F.sequence(F.floor((F.col("pos") - radius) / size), F.floor((F.col("pos") + radius) / size))).alias("_b")
    e = events.select(*keys, "pos", F.lit(None).cast("long").alias("id"), F.col(weight).cast("double").alias("_w"), reach)
    u = queries.select(*keys, "pos", "id", F.lit(None).cast("double").alias("_w"), F.floor(F.col("pos") / size).alias("_b")).unionByName(e)
    w = Window.partitionBy(*keys, "_b").orderBy("pos").rangeBetween(-radius, radius)
    return u.withColumns({"n": F.count("_w").over(w), "total": F.coalesce(F.sum("_w").over(w), F.lit(0.0))}).filter("id is not null").select("id", *keys, "pos", "n", "total")


def transition_scores(truth: DataFrame, calls: DataFrame, keys: list[str], tolerances: list[float]) -> DataFrame:
    """tolerance, n_truth, n_called, matched, precision, recall, f1, false_per_morgan, mean_error of changes of label along a map.

    truth and calls: keys (a haplotype or person), pos (cM), label. Changes match one to one
    within the tolerance where they go from and to the same labels, as many as can. False
    ones are called changes without a match, over the summed map lengths of all keys of
    truth in Morgan; null where that is zero. Keys that one side lacks have no changes there.
    """
    t, c = stored(boundaries(truth, keys)), stored(boundaries(calls, keys))
    span = truth.groupBy(*keys).agg((F.max("pos") - F.min("pos")).alias("s")).agg((F.sum("s") / 100).alias("morgan"))
    whole = t.agg(F.count("*").alias("n_truth")).crossJoin(c.agg(F.count("*").alias("n_called"))).crossJoin(span)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = {float(x): [0, 0.0] for x in tolerances}
            for row in zip(*(pdf[f"_{x}_{c}"] for x in "tc" for c in ("midpoint", "before", "after"))):
                for tolerance, sums in found.items():
                    pairs = _matched(*row, tolerance, True)
                    sums[0] += len(pairs)
                    sums[1] += sum(abs(a - b) for a, b in pairs)
            yield pd.DataFrame([(x, *sums) for x, sums in found.items()], columns=["tolerance", "matched", "error"])

    m = _gathered(t, c, keys).mapInPandas(score, "tolerance double, matched long, error double")  # boundaries meet once for all tolerances
    m = m.groupBy("tolerance").agg(F.sum("matched").alias("matched"), F.sum("error").alias("error"))
    asked = truth.sparkSession.createDataFrame([(float(x),) for x in tolerances], "tolerance double")
    out = asked.join(m, "tolerance", "left").na.fill(0, ["matched"]).withColumn("mean_error", F.try_divide("error", "matched")).crossJoin(whole)
    p, r = F.try_divide("matched", "n_called"), F.try_divide("matched", "n_truth")
    false = F.try_divide(F.col("n_called") - F.col("matched"), "morgan")
    return out.select("tolerance", "n_truth", "n_called", "matched", p.alias("precision"), r.alias("recall"), F.try_divide(2 * F.col("matched"), F.col("n_called") + F.col("n_truth")).alias("f1"), false.alias("false_per_morgan"), "mean_error")


def boundaries(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of label between neighbouring positions: midpoint, before, after."""
    w = Window.partitionBy(*keys).orderBy("pos")
    d = labels.withColumns({"_p": F.lag("pos").over(w), "before": F.lag("label").over(w)})
    return d.filter("before <> label").select(*keys, ((F.col("_p") + F.col("pos")) / 2).alias("midpoint"), "before", F.col("label").alias("after"))


def _gathered(truth: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """keys and, of both sides' boundaries, arrays of midpoints and labels; haplotypes that one side lacks are left out."""
    place = F.struct(F.col("midpoint").cast("double").alias("midpoint"), "before", "after")
    both = truth.select(*keys, place.alias("_t"), F.lit(None).alias("_c")).unionByName(calls.select(*keys, F.lit(None).alias("_t"), place.alias("_c")))
    both = both.groupBy(*keys).agg(F.collect_list("_t").alias("_t"), F.collect_list("_c").alias("_c")).filter((F.size("_t") > 0) & (F.size("_c") > 0))
    return both.select(*keys, *[F.col(f"_{x}").getField(c).alias(f"_{x}_{c}") for x in "tc" for c in ("midpoint", "before", "after")])


def _matched(t_at, t_before, t_after, c_at, c_before, c_after, tolerance: float, optimal: bool) -> list[tuple[float, float]]:
    """(truth, called) midpoints that match in one haplotype."""
    from ..functions.assignment import matching

    near: dict[tuple, list[float]] = {}
    for at, *label in sorted(zip(c_at.tolist(), c_before.tolist(), c_after.tolist())):
        near.setdefault(tuple(label), []).append(at)
    pairs = []
    for at, *label in zip(t_at.tolist(), t_before.tolist(), t_after.tolist()):
        calls_at = near.get(tuple(label), ())
        pairs += [(abs(at - x), at, x) for x in calls_at[bisect_left(calls_at, at - tolerance) : bisect_right(calls_at, at + tolerance)]]
    pairs.sort()
    used_t, used_c, out = set(), set(), []
    if optimal and pairs:
        times_t, times_c = Counter(a for _, a, _ in pairs), Counter(b for _, _, b in pairs)
        # two that could only match each other do, as any match is worth more than its distance
        alone, others = [], []
        for d, a, b in pairs:
            (alone if times_t[a] == times_c[b] == 1 else others).append((d, a, b))
        rows, cols = sorted({a for _, a, _ in others}), sorted({b for _, _, b in others})
        row, col = ({x: i for i, x in enumerate(xs)} for xs in (rows, cols))
        # distances in parts of the tolerance, as whole numbers; any match is worth more than all of them
        parts, most = 1 << 20, min(len(times_t), len(times_c))
        gains = ((row[a], col[b], (parts + 1) * most + 1 - round(d / tolerance * parts) if tolerance else 1) for d, a, b in others)
        return sorted([(a, b) for _, a, b in alone] + [(rows[i], cols[k]) for i, k in matching(gains)])
    for _, a, b in pairs:
        if a not in used_t and b not in used_c:
            used_t.add(a)
            used_c.add(b)
            out.append((a, b))
    return out


def match_boundaries(truth: DataFrame, calls: DataFrame, keys: list[str], tolerance: float, optimal: bool = False) -> DataFrame:
    """One-to-one matches of boundaries with the same transition within a tolerance, by haplotype: nearest first, or (optimal) as many as can be and of these the nearest in all.

    Spark gathers a haplotype's boundaries, which are few, into a row; tasks match row by row.
    """
    both = _gathered(truth, calls, keys)
    kept = StructType([both.schema[k] for k in keys] + [StructField("_match", ArrayType(StructType([StructField("truth", DoubleType()), StructField("called", DoubleType())])))])

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_matched(*r, tolerance, optimal) for r in zip(*(pdf[f"_{x}_{c}"] for x in "tc" for c in ("midpoint", "before", "after")))]
            out = pdf[keys].copy()
            out["_match"] = [[{"truth": a, "called": b} for a, b in pairs] for pairs in found]
            yield out

    return both.mapInPandas(match, kept).select(*keys, F.explode("_match").alias("_m")).select(*keys, "_m.truth", "_m.called")


def project_posterior(queries: DataFrame, grid: DataFrame, keys: list[str], size: int) -> DataFrame:
    """queries (pos) with p (array) from a grid (pos, p): linear between grid positions, clamped at the ends, ties averaged."""
    width = 3
    g = grid.groupBy(*keys, "pos").agg(*[F.avg(F.get("p", F.lit(k))).alias(f"p{k}") for k in range(width)])
    ends = g.groupBy(*keys).agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    q = queries.join(ends, keys).withColumn("_pos", F.least(F.greatest("pos", "_lo"), F.col("_hi"))).drop("_lo", "_hi")
    out = q
    for k in range(width):
        # the same spans each time: one exchange of the grid is read again
        out = interpolate(out.withColumnRenamed("pos", "_own").withColumnRenamed("_pos", "pos"), g.select(*keys, "pos", F.col(f"p{k}").alias(f"_p{k}")), keys, "pos", f"_p{k}", size).withColumnRenamed("pos", "_pos").withColumnRenamed("_own", "pos")
    return out.select(*queries.columns, F.array(*[F.col(f"_p{k}") for k in range(width)]).alias("p"))


def flank_table(markers: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of target dosages by the nearest common markers' dosages to the left and right (null: none).

    markers: keys, pos, dosage, common.
    """
    known = F.when(F.col("common") & F.col("dosage").isNotNull(), F.col("dosage"))
    d = with_known(markers.withColumn("_known", known), keys, "_known").withColumnsRenamed({"_left": "left", "_right": "right"})
    d = d.filter(~F.col("common") & F.col("dosage").isNotNull())
    return d.groupBy("left", "right", "dosage").agg(F.count("*").alias("n"))


def copy_overlaps(copies: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Overlaps of different carriers' copies (carrier, lo, hi) of the same donor and copy."""
    j = overlap_join(copies, copies.select(*keys, F.col("carrier").alias("other"), "lo", "hi"), keys, size).filter("carrier < other")
    return j.select(*keys, "carrier", "other", F.greatest("lo", "r_lo").alias("lo"), F.least("hi", "r_hi").alias("hi"))


def axis_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sites of a against b (chrom, pos, ref, alt): exact, other_allele at the same position, or absent; counts by chromosome."""
    key = ["chrom", "pos", "ref", "alt"]
    exact = b.select(*key).distinct().withColumn("_e", F.lit(1))
    place = b.select("chrom", "pos").distinct().withColumn("_p", F.lit(1))
    d = a.join(exact, key, "left").join(place, ["chrom", "pos"], "left")
    state = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_p").isNotNull(), "other_allele").otherwise("absent")
    return d.groupBy("chrom", state.alias("state")).agg(F.count("*").alias("n"))


def crosswalk(rows: DataFrame, first: str, second: str) -> DataFrame:
    """first, second, joint key 'first_second', one row each; identical repeats collapse."""
    return rows.select(first, second).dropna().distinct().withColumn("joint", F.concat_ws("_", first, second))


def joint_class(donor: str, reference: str) -> Column:
    """Support class of a locus seen in donors and references (counts): both, donor_only, reference_only, none."""
    d, r = F.coalesce(F.col(donor), F.lit(0)) > 0, F.coalesce(F.col(reference), F.lit(0)) > 0
    return F.when(d & r, "both").when(d, "donor_only").when(r, "reference_only").otherwise("none")


#: Kinship bounds of degrees: half powers of two between the expected values.
GRADES = [("duplicate", 0.354), ("first", 0.177), ("second", 0.0884), ("third", 0.0442)]


def kin_grade(kin: str = "kin") -> Column:
    out = F.lit("unrelated")
    for name, bound in reversed(GRADES):
        out = F.when(F.col(kin) >= bound, name).otherwise(out)
    return F.when(F.col(kin).isNull(), "missing").otherwise(out)


def threshold_counts(pairs: DataFrame, kin: str, thresholds: list[float]) -> DataFrame:
    """Pairs at or above each threshold."""
    t = F.broadcast(pairs.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold double"))
    d = t.join(pairs, F.col(kin) >= F.col("threshold"), "left").groupBy("threshold").agg(F.count(kin).alias("n_pairs"))
    return d


def stratum_coverage(available: DataFrame, retained: DataFrame, key: str, stratum: str) -> DataFrame:
    d = available.join(retained.select(key).distinct().withColumn("_r", F.lit(1)), key, "left")
    g = d.groupBy(stratum).agg(F.count("*").alias("available"), F.count("_r").alias("retained"))
    return g.withColumn("fraction", F.col("retained") / F.col("available"))


def population_blocks(kin_edges: DataFrame, strata: DataFrame, node: str, stratum: str) -> DataFrame:
    """Components of kinship edges joined with strata: people of one stratum hang together through its least member."""
    hub = strata.groupBy(stratum).agg(F.min(node).alias("a"))
    star = strata.join(hub, stratum).select("a", F.col(node).alias("b"))
    return graph.components(strata.select(F.col(node).alias("node")), kin_edges.select("a", "b").unionByName(star))


def duplicate_groups(pairs: DataFrame, people: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, component of pairs at the threshold within the cohort; such links that leave it)."""
    e = pairs.filter(F.col("kin") >= threshold).select(F.col("sample_a").alias("a"), F.col("sample_b").alias("b"))
    ids = people.select("sample_id").distinct()
    inside = e.join(ids.withColumnRenamed("sample_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("sample_id", "b"), "b", "left_semi")
    leaving = e.join(inside, ["a", "b"], "left_anti")
    return graph.component_roots(inside).select("node", F.col("root").alias("component")), leaving


def pair_targets(pairs: DataFrame, stratum: str, per_stratum: int, seed: int = 0) -> DataFrame:
    """A sample of positive and zero pairs (w) of each stratum, the same on any cluster: least hashes first."""
    h = F.xxhash64("sample_a", "sample_b", F.lit(seed))
    d = pairs.withColumns({"positive": F.col("w") > 0, "_h": h})
    rank = F.row_number().over(Window.partitionBy(stratum, "positive", F.shiftright("_h", 56)).orderBy("_h", "sample_a", "sample_b"))
    d = d.withColumn("_r", rank).filter(F.col("_r") <= per_stratum)  # first within 256 hash ranges
    final = F.row_number().over(Window.partitionBy(stratum, "positive").orderBy("_h", "sample_a", "sample_b"))
    return d.withColumn("_k", final).filter(F.col("_k") <= per_stratum).drop("_h", "_r", "_k")


def grid_neighbours(configs: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs of configurations next to each other on either axis of a grid."""
    out = None
    for moving, fixed in ((x, y), (y, x)):
        w = Window.partitionBy(fixed).orderBy(moving)
        d = configs.select(F.lit(moving).alias("axis"), F.col(x).alias("x1"), F.col(y).alias("y1"), F.lead(x).over(w).alias("x2"), F.lead(y).over(w).alias("y2")).filter("x2 is not null")
        out = d if out is None else out.unionByName(d)
    return out


def nominal_composition(people: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    """Counts of each column's levels, UNKNOWN kept, for people with and without a flag."""
    long = people.select(flag, *[F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias(c) for c in columns]).unpivot([flag], columns, "column", "level")
    return long.groupBy("column", "level").agg(F.count_if(F.col(flag)).alias("n_in"), F.count_if(~F.col(flag)).alias("n_out"))


def scope_summary(people: DataFrame, label: str, level: str, small: int) -> DataFrame:
    """By scope (cohort, assigned, unassigned, each community): n, purity, dominant levels (ties joined by ;) and a small-n flag."""
    scopes = F.array(F.lit("cohort"), F.when(F.col(label).isNull(), "unassigned").otherwise("assigned"), F.when(F.col(label).isNotNull(), F.concat(F.lit("community:"), F.col(label).cast("string"))))
    d = people.select(F.explode(F.array_compact(scopes)).alias("scope"), F.coalesce(F.col(level), F.lit("UNKNOWN")).alias(level))
    n = d.groupBy("scope", level).agg(F.count("*").alias("n"))
    top = n.groupBy("scope").agg(F.max("n").alias("m"), F.sum("n").alias("size"))
    j = n.join(top, "scope").filter("n = m").groupBy("scope", "m", "size").agg(F.array_join(F.array_sort(F.collect_list(level)), ";").alias("dominant"))
    return j.select("scope", F.col("size").alias("n"), (F.col("m") / F.col("size")).alias("purity"), "dominant", (F.col("size") < small).alias("small"))


def expected_information(table: DataFrame) -> DataFrame:
    """One row: emi, the mean mutual information (nats) of tables with the same margins and random cells.

    Cells of equal margins have the same expectation, so it is taken once for each pair of
    different sizes (at most the root of twice the number of rows on either side).
    """
    total = F.broadcast(table.agg(F.sum("n").alias("t")))
    size = lambda c, name: table.groupBy(c).agg(F.sum("n").alias(name)).groupBy(name).agg(F.count("*").alias(f"k_{name}"))
    met = size("la", "a").crossJoin(F.broadcast(size("lb", "b"))).crossJoin(total)

    @F.pandas_udf("double")
    def cell(a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
        def expectation(a: int, b: int, t: int) -> float:
            lo, hi, found = max(1, a + b - t), min(a, b), 0.0
            fixed = sum(log_gamma(np.array([x + 1.0]))[0] for x in (a, b, t - a, t - b)) - log_gamma(np.array([t + 1.0]))[0]
            for first in range(lo, hi + 1, 1 << 20):
                n = np.arange(first, min(hi, first + (1 << 20) - 1) + 1, dtype=float)
                chance = np.exp(fixed - log_gamma(n + 1) - log_gamma(a - n + 1) - log_gamma(b - n + 1) - log_gamma(t - a - b + n + 1))
                found += float((n / t * np.log(n * t / (a * b)) * chance).sum())
            return found

        return pd.Series([expectation(*map(int, x)) for x in zip(a, b, t)], dtype=float)

    return met.agg(F.coalesce(F.sum(F.col("k_a") * F.col("k_b") * cell("a", "b", "t")), F.lit(0.0)).alias("emi"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1: Stirling's series, after stepping up to where it is exact."""
    x, low = np.array(x, float), np.zeros(len(x))
    for _ in range(9):
        small = x < 9
        low[small] += np.log(x[small])
        x[small] += 1
    z = 1 / (x * x)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - low


def adjusted_information(table: DataFrame) -> DataFrame:
    """One row: ami = (mi - emi) / (mean entropy - emi) of a contingency table (la, lb, n), and degenerate: fewer than two groups on a side or nothing to gain over chance, where ami is null."""
    table = table.filter("n > 0")
    total = F.broadcast(table.agg(F.sum("n").alias("t")))
    a, b = table.groupBy("la").agg(F.sum("n").alias("na")), table.groupBy("lb").agg(F.sum("n").alias("nb"))
    share = lambda c: F.col(c) / F.col("t")
    mi = table.join(a, "la").join(b, "lb").crossJoin(total).agg(F.coalesce(F.sum(share("n") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))), F.lit(0.0)).alias("mi"))
    h = lambda d, c: d.crossJoin(total).agg(F.coalesce(-F.sum(share(c) * F.log(share(c))), F.lit(0.0)).alias(f"h{c}"), F.count("*").alias(f"k{c}"))
    d = mi.crossJoin(h(a, "na")).crossJoin(h(b, "nb")).crossJoin(expected_information(table))
    room = (F.col("hna") + F.col("hnb")) / 2 - F.col("emi")
    flat = (F.col("kna") < 2) | (F.col("knb") < 2) | (F.abs(room) < 1e-12)
    return d.select(F.when(~flat, (F.col("mi") - F.col("emi")) / room).alias("ami"), flat.alias("degenerate"))


def mutual_information(table: DataFrame) -> DataFrame:
    """One row: nmi (arithmetic mean) and weighted purity of a contingency table (la: partition, lb: reference)."""
    total = F.broadcast(table.agg(F.sum("n").alias("t")))
    a, b = table.groupBy("la").agg(F.sum("n").alias("na"), F.max("n").alias("top")), table.groupBy("lb").agg(F.sum("n").alias("nb"))
    j = table.join(a, "la").join(b, "lb").crossJoin(total)
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))))
    ha = a.crossJoin(total).agg((-F.sum(F.col("na") / F.col("t") * F.log(F.col("na") / F.col("t")))).alias("ha"), (F.sum("top") / F.max("t")).alias("purity"))
    hb = b.crossJoin(total).agg((-F.sum(F.col("nb") / F.col("t") * F.log(F.col("nb") / F.col("t")))).alias("hb"))
    return j.agg(mi.alias("mi")).crossJoin(ha).crossJoin(hb).select(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")).alias("nmi"), "purity")


def locus_masks(loci: DataFrame, af: list[str], thresholds: list[float]) -> DataFrame:
    """Loci at or below each threshold in every ancestry's frequency, by threshold: n and the carriers they hold."""
    t = F.broadcast(loci.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold double"))
    top = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in af])
    d = loci.withColumn("_top", top).crossJoin(t).filter(F.col("_top") <= F.col("threshold"))
    return t.join(d.groupBy("threshold").agg(F.count("*").alias("n_loci"), F.sum("n_carriers").alias("n_carriers")), "threshold", "left").na.fill(0)


def panel_audit(markers: DataFrame, bounds: DataFrame) -> DataFrame:
    """By chromosome: records, biallelic single bases, repeated keys, positions outside the contig's bounds."""
    key = ["chrom", "pos", "ref", "alt"]
    d = markers.groupBy(*key).agg(F.count("*").alias("k")).join(F.broadcast(bounds), "chrom", "left")
    snv = F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$")
    return d.groupBy("chrom").agg(F.sum("k").alias("records"), F.sum(F.when(snv, F.col("k")).otherwise(0)).alias("biallelic"), F.count_if(F.col("k") > 1).alias("repeated_keys"), F.sum(F.when(F.col("pos").between(F.col("lo"), F.col("hi")), 0).otherwise(F.col("k"))).alias("outside"))


def marker_orientation(marker: str, pos: str, ref: str, alt: str) -> Column:
    """Of ids 'chr:pos:ref:alt': same, swapped, position_mismatch or malformed."""
    part = lambda k: F.regexp_extract(marker, r"^([^:]+):(\d+):([ACGT]+):([ACGT]+)$", k)
    r, a = F.col(ref), F.col(alt)
    return F.when(part(1) == "", "malformed").when(part(2).try_cast("long") != F.col(pos), "position_mismatch").when((part(3) == r) & (part(4) == a), "same").when((part(3) == a) & (part(4) == r), "swapped").otherwise("malformed")


def role_catalogue(a: DataFrame, b: DataFrame, keys: list[str], strata: list[str]) -> DataFrame:
    """Two role catalogues in lockstep: by state (both, only_a, only_b, differs in strata) the number of keys."""
    j = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in strata], F.lit(1).alias("_a")).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in strata], F.lit(1).alias("_b")), keys, "full")
    same = F.lit(True)
    for c in strata:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    state = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").when(same, "both").otherwise("differs")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def loss_by_dose(df: DataFrame, dose: str, method: str, p: str) -> DataFrame:
    """Cross entropy and correct calls by true dose and method; doses that a method lacks have zero rows. p: array by dose."""
    own = F.get(p, F.col(dose).cast("int"))
    called = F.array_position(p, F.array_max(p)) - 1
    g = df.groupBy(method, dose).agg(F.count("*").alias("n"), F.sum(-F.log(F.greatest(own, F.lit(1e-12)))).alias("loss"), F.count_if(called == F.col(dose)).alias("n_correct"))
    grid = df.select(method).distinct().crossJoin(F.broadcast(df.select(dose).distinct()))
    return grid.join(g, [method, dose], "left").na.fill(0, ["n", "n_correct"]).na.fill(0.0, ["loss"])


def degree_bands(degrees: DataFrame, bands: list[int]) -> DataFrame:
    """Nodes by band of degree: [bands[i], bands[i + 1]), the last one open."""
    band = F.lit(None).cast("long")
    for b in bands:
        band = F.when(F.col("degree") >= b, F.lit(b).cast("long")).otherwise(band)
    return degrees.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum("degree").alias("total_degree"))


def axis_mass(scores: DataFrame, axes: list[str], subset: str) -> DataFrame:
    """By axis: participation ratio (sum x^2)^2 / sum x^4, and the share of sum x^2 held by the subset."""
    long = scores.select(subset, *[F.col(c).cast("double").alias(c) for c in axes]).unpivot([subset], axes, "axis", "x")
    q = F.col("x") * F.col("x")
    d = long.groupBy("axis").agg(F.sum(q).alias("s2"), F.sum(q * q).alias("s4"), F.sum(F.when(F.col(subset), q).otherwise(0.0)).alias("sub"))
    return d.select("axis", F.try_divide(F.col("s2") * F.col("s2"), F.col("s4")).alias("participation"), F.try_divide("sub", "s2").alias("subset_share"))
