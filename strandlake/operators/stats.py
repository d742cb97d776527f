"""Statistics and evaluation on tables.

Ranks come from value counts: values are aggregated first, then cumulated over value ranges,
so no window runs over all rows in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut


def value_ranks(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """keys, value, n and the average rank of the value's rows (1-based) within keys.

    Counts by distinct value, cumulated in two steps: within buckets of equal leading
    digits of a range partition, then over bucket totals.
    """
    keys = keys or []
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    parts = cut(n.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()))  # written, so that a row's number stays
    inside = Window.partitionBy("_p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, "_p").agg(F.sum("n").alias("_t"))
    ahead = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    d = parts.join(broadcast_if_small(ahead), [*keys, "_p"])
    below = F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return d.select(*keys, value, "n", (below + (F.col("n") + 1) / 2).alias("rank"))


def mann_whitney(df: DataFrame, value: str, positive: str) -> DataFrame:
    """One row: n1, n0, u (of the positive rows, ties with average ranks), auc, cliff delta."""
    ranks = value_ranks(df, value)
    d = df.filter(F.col(value).isNotNull()).join(ranks.select(value, "rank"), value)
    one = d.agg(F.count_if(F.col(positive)).alias("n1"), F.count_if(~F.col(positive)).alias("n0"), F.sum(F.when(F.col(positive), F.col("rank"))).alias("r1"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    auc = F.try_divide(u, F.col("n1") * F.col("n0"))
    return one.select("n1", "n0", u.alias("u"), auc.alias("auc"), (2 * auc - 1).alias("cliff_delta"))


def auc_smd(df: DataFrame, value: str, positive: str) -> DataFrame:
    """One row: auc in the better direction, and the difference of means over the pooled deviation."""
    m = df.agg(*[f(F.when(F.col(positive) == flag, F.col(value))).alias(f"{name}{int(flag)}") for flag in (True, False) for name, f in (("m", F.avg), ("v", F.var_samp))])
    smd = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2))
    return mann_whitney(df, value, positive).crossJoin(m).select(F.greatest("auc", 1 - F.col("auc")).alias("auc"), smd.alias("smd"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx, ry = value_ranks(d, x).select(x, F.col("rank").alias("_rx")), value_ranks(d, y).select(y, F.col("rank").alias("_ry"))
    return d.join(rx, x).join(ry, y).agg(F.corr("_rx", "_ry").alias("spearman"))


def compare_vectors(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, pearson, spearman, slope, intercept, mae, rmse and quantiles of y - x."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    delta = (F.col(y) - F.col(x)).cast("double")
    one = d.agg(
        F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.avg(F.abs(delta)).alias("mae"), F.sqrt(F.avg(delta * delta)).alias("rmse"), F.percentile(delta, F.lit(0.5)).alias("delta_p50"), F.percentile(delta, F.lit(0.95)).alias("delta_p95"),
    )
    return one.crossJoin(spearman(d, x, y))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("la"), F.col(b).alias("lb")).agg(F.count("*").alias("n"))


def cramers_v(table: DataFrame) -> DataFrame:
    """One row: chi2 and the bias-corrected V of a contingency table."""
    rows, cols = table.groupBy("la").agg(F.sum("n").alias("ra")), table.groupBy("lb").agg(F.sum("n").alias("cb"))
    total = table.agg(F.sum("n").alias("t"))
    full = rows.crossJoin(F.broadcast(cols)).crossJoin(F.broadcast(total)).join(table, ["la", "lb"], "left").na.fill(0, ["n"])
    e = F.col("ra") * F.col("cb") / F.col("t")
    d = full.agg(F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("chi2"), F.countDistinct("la").alias("r"), F.countDistinct("lb").alias("k"), F.max("t").alias("t"))
    phi = F.greatest(F.lit(0.0), F.col("chi2") / F.col("t") - (F.col("k") - 1) * (F.col("r") - 1) / (F.col("t") - 1))
    rr, kk = F.col("r") - (F.col("r") - 1) * (F.col("r") - 1) / (F.col("t") - 1), F.col("k") - (F.col("k") - 1) * (F.col("k") - 1) / (F.col("t") - 1)
    return d.select("chi2", F.sqrt(F.try_divide(phi, F.least(rr - 1, kk - 1))).alias("cramers_v"))


@F.pandas_udf(T.DoubleType())
def _hypergeometric_tail(hit: pd.Series, inside: pd.Series, level: pd.Series, total: pd.Series) -> pd.Series:
    def tail(k: int, n: int, m: int, t: int) -> float:
        choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        whole = choose(t, n)
        return min(1.0, math.fsum(math.exp(choose(m, i) + choose(t - m, n - i) - whole) for i in range(max(k, n - (t - m)), min(n, m) + 1)))

    return pd.Series([tail(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(hit, inside, level, total)])


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """df with q: adjusted p values over all rows with one; null ones stay null.

    Equal p values share the highest of their ranks, and the least raw value from there on:
    both come from value counts by ranges, so no window runs over all rows.
    """
    ranks = value_ranks(df, p).withColumn("_k", F.col("rank") + (F.col("n") - 1) / 2)
    total = F.broadcast(ranks.agg(F.sum("n").alias("_n")))
    raw = ranks.crossJoin(total).select(p, (F.col(p) * F.col("_n") / F.col("_k")).alias("_raw"))
    parts = cut(raw.repartitionByRange(p).withColumn("_p", F.spark_partition_id()))
    after = parts.groupBy("_p").agg(F.min("_raw").alias("_m"))
    later = F.min("_m").over(Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    inside = F.min("_raw").over(Window.partitionBy("_p").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    q = parts.join(F.broadcast(after.select("_p", later.alias("_later"))), "_p").select(p, F.least(F.lit(1.0), inside, "_later").alias("q"))
    return df.join(q, p, "left")


def enrichment(df: DataFrame, group: str, level: str) -> DataFrame:
    """One-sided Fisher test of every group and level that meet, with BH adjustment over all of them; null levels are left out."""
    t = contingency(df, group, level)
    g, l = t.groupBy("la").agg(F.sum("n").alias("in_group")), t.groupBy("lb").agg(F.sum("n").alias("of_level"))
    total = F.broadcast(t.agg(F.sum("n").alias("total")))
    d = t.join(g, "la").join(l, "lb").crossJoin(total)
    d = d.withColumn("p", _hypergeometric_tail("n", "in_group", "of_level", "total"))
    return benjamini_hochberg(d, "p").select(F.col("la").alias(group), F.col("lb").alias(level), "n", "in_group", "of_level", "p", "q")


def modal_label(df: DataFrame, group: str, level: str) -> DataFrame:
    """Each group's most frequent level (ties to the least), its fraction, and the group's size."""
    n = df.filter(F.col(level).isNotNull()).groupBy(group, level).agg(F.count("*").alias("n"))
    d = n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(level).alias("l"))).alias("b"), F.sum("n").alias("size"))
    return d.select(group, F.col("b.l").alias(level), (-F.col("b.m") / F.col("size")).alias("fraction"), "size")


def eta_squared(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: n, groups, eta2 and its value adjusted for degrees of freedom; status for degenerate cases."""
    g = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    d = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    total = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    status = F.when(F.col("n") == 0, "empty").when(F.col("k") < 2, "one_group").when(F.col("n") <= F.col("k"), "no_freedom").when(total <= 0, "constant").otherwise("ok")
    eta = 1 - within / total
    adjusted = 1 - (within / (F.col("n") - F.col("k"))) / (total / (F.col("n") - 1))
    return d.select("n", F.col("k").alias("groups"), F.when(status == "ok", eta).alias("eta2"), F.when(status == "ok", adjusted).alias("adjusted"), status.alias("status"))


def partial_r2(df: DataFrame, y: str, base: list[str], extra: list[str], weight: str | None = None) -> DataFrame:
    """One row: r2 of the extra columns over the base ones (with an intercept), by weighted normal equations.

    The Gram matrix is one aggregate; only it reaches the driver.
    """
    import numpy as np

    names = ["_one", *base, *extra, y]
    w = F.col(weight) if weight else F.lit(1.0)
    d = df.select(F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in [*base, *extra, y]], w.alias("_w")).dropna()
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = d.agg(F.count("*").alias("n"), *[F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in cells]).first()
    g = np.zeros((len(names), len(names)))
    for i, j in cells:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0

    def residual(k: int) -> float:
        x, v = g[:k, :k], g[:k, -1]
        return float(g[-1, -1] - v @ np.linalg.pinv(x) @ v)

    small, full = residual(1 + len(base)), residual(1 + len(base) + len(extra))
    value = (small - full) / small if small > 0 else None
    return df.sparkSession.createDataFrame([(row["n"], value)], "n long, partial_r2 double")


def pair_denominators(nodes: DataFrame, component: str, value: str) -> DataFrame:
    """One row: possible pairs within and across components, of unknown component, and the sum of value products over all pairs."""
    c = nodes.filter(F.col(component).isNotNull()).groupBy(component).agg(F.count("*").alias("n"))
    same = c.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("same"))
    d = nodes.agg(F.count("*").alias("n"), F.count(component).alias("k"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).crossJoin(same)
    pairs = lambda x: (F.col(x) * (F.col(x) - 1) / 2).cast("long")
    return d.select("n", "same", (pairs("k") - F.col("same")).alias("different"), (pairs("n") - pairs("k")).alias("unknown"), ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("product_sum"))


def modal_confidence(df: DataFrame, group: str, level: str, confidence: str) -> DataFrame:
    """modal_label() with the median confidence of all of the group's rows."""
    return modal_label(df, group, level).join(df.groupBy(group).agg(F.median(confidence).alias("median_confidence")), group)


def rank_shifts(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: median and 95 % quantile of how far a row's average rank by y lies from that by x."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx, ry = value_ranks(d, x).select(x, F.col("rank").alias("_rx")), value_ranks(d, y).select(y, F.col("rank").alias("_ry"))
    shift = F.abs(F.col("_ry") - F.col("_rx"))
    return d.join(rx, x).join(ry, y).agg(F.percentile(shift, F.lit(0.5)).alias("shift_p50"), F.percentile(shift, F.lit(0.95)).alias("shift_p95"))


def balanced_eta_squared(df: DataFrame, value: str, group: str, component: str) -> DataFrame:
    """eta2 with rows weighted so that every component has weight one in all."""
    d = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    size = d.groupBy(component).agg((1 / F.count("*")).alias("_w"))
    g = d.join(size, component).groupBy(group).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col(value)).alias("s"), F.sum(F.col("_w") * F.col(value) * F.col(value)).alias("q"))
    t = g.agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("w")).alias("b"), F.count("*").alias("groups"))
    mean = F.col("s") * F.col("s") / F.col("w")
    return t.select("groups", F.try_divide(F.col("b") - mean, F.col("q") - mean).alias("eta2"))


def poisson_weight(h: Column) -> Column:
    """A Poisson(1) count from a 64-bit hash."""
    u, weight, below, p = (F.pmod(h, F.lit(1 << 30)) + 0.5) / (1 << 30), F.lit(0), 0.0, math.exp(-1)
    for k in range(8):
        below += p
        weight = weight + F.when(u > below, 1).otherwise(0)
        p /= k + 1
    return weight


def bootstrap_mean(df: DataFrame, group: str, value: str, replicates: int, seed: int = 0) -> DataFrame:
    """One row: mean and the percentile interval of group-resampled means.

    Groups are summed first. A replicate weighs each group by a Poisson count from a hash of
    group, replicate and seed, so it is the same on any cluster.
    """
    g = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    d = g.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r")).withColumn("w", poisson_weight(F.xxhash64(F.col(group), F.col("r"), F.lit(seed))))
    means = d.groupBy("r").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    ci = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return g.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(ci)


def bootstrap_delta(df: DataFrame, group: str, base: str, other: str, replicates: int, seed: int = 0, stratum: str | None = None) -> DataFrame:
    """One row: base and other (means over the rows with both), delta = other - base, and the percentile interval of the delta over replicates that resample groups.

    With a stratum, means are means of strata means, strata weighing the same, and groups
    are resampled within them. Both values of a row stay together; groups are summed
    first, and a replicate weighs them by hashed Poisson counts.
    """
    d = df.filter(F.col(base).isNotNull() & F.col(other).isNotNull())
    s = F.lit(0) if stratum is None else F.col(stratum)
    g = cut(d.groupBy(s.alias("_s"), F.col(group).alias("_g")).agg(F.sum(base).alias("a"), F.sum(other).alias("b"), F.count("*").alias("n")))
    share = lambda c: F.try_divide(F.sum(F.col("w") * F.col(c)), F.sum(F.col("w") * F.col("n"))).alias(c)
    point = g.withColumn("w", F.lit(1)).groupBy("_s").agg(share("a"), share("b")).agg(F.avg("a").alias("base"), F.avg("b").alias("other"))
    r = g.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", poisson_weight(F.xxhash64("_s", "_g", "r", F.lit(seed))))
    r = r.groupBy("r", "_s").agg(share("a"), share("b")).groupBy("r").agg((F.avg("b") - F.avg("a")).alias("d"))
    ci = r.agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
    return point.crossJoin(ci).select("base", "other", (F.col("other") - F.col("base")).alias("delta"), "low", "high")


def confusion(df: DataFrame, truth: str, call: str) -> DataFrame:
    return df.filter(F.col(truth).isNotNull()).groupBy(truth, F.coalesce(F.col(call), F.lit("MISSING")).alias(call)).agg(F.count("*").alias("n"))


def label_metrics(df: DataFrame, truth: str, call: str) -> DataFrame:
    """Per label: support, precision, recall and f1 (null on a zero denominator)."""
    c = df.filter(F.col(truth).isNotNull() & F.col(call).isNotNull())
    t = c.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(call)).alias("hit"))
    p = c.groupBy(F.col(call).alias("label")).agg(F.count("*").alias("called"))
    d = t.join(p, "label", "full").na.fill(0)
    pr, re = F.try_divide("hit", "called"), F.try_divide("hit", "support")
    return d.select("label", "support", "called", "hit", pr.alias("precision"), re.alias("recall"), F.try_divide(2 * F.col("hit"), F.col("support") + F.col("called")).alias("f1"))


def probability_metrics(df: DataFrame, p: str, y: str, bins: int = 15, floor: float = 1e-12) -> DataFrame:
    """One row: n, log loss, Brier score and expected calibration error (equal bins) of p for a 0/1 outcome."""
    q = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), F.col(p)))
    d = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("_b", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    per = d.groupBy("_b").agg(
        F.count("*").alias("n"), F.sum(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("ll"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("br"), F.sum(p).alias("sp"), F.sum(y).alias("sy")
    )
    n = F.sum("n")
    return per.agg(n.alias("n"), (F.sum("ll") / n).alias("log_loss"), (F.sum("br") / n).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"))


def temper(p: str, t: float) -> Column:
    """p^(1/t) over its sum; exact zeros stay, t = 1 changes nothing but rounding."""
    raised = F.transform(p, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.pow(x, F.lit(1 / t))))
    total = F.aggregate(raised, F.lit(0.0), lambda a, b: a + b)
    return F.transform(raised, lambda x: x / total)


def calibrate(df: DataFrame, p: str, y: str, rounds: int = 3, width: int = 9) -> DataFrame:
    """One row: the temperature in [0.05, 20] of the least log loss, by rounds that each try a small grid in one aggregate."""
    low, high = math.log(0.05), math.log(20)
    best = (0.0, math.inf)
    for _ in range(rounds):
        grid = [low + (high - low) * k / (width - 1) for k in range(width)]
        losses = [F.avg(-F.log(F.greatest(F.get(temper(p, math.exp(t)), F.col(y).cast("int")), F.lit(1e-12)))).alias(f"t{k}") for k, t in enumerate(grid)]
        row = df.agg(*losses).first()
        k = min(range(width), key=lambda i: row[i])
        best, step = (grid[k], row[k]), (high - low) / (width - 1)
        low, high = max(math.log(0.05), grid[k] - step), min(math.log(20), grid[k] + step)
    return df.sparkSession.createDataFrame([(math.exp(best[0]), float(best[1]))], "temperature double, log_loss double")


def leave_one_out(df: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """Each key's total without each of its parts."""
    own = df.groupBy(*keys, part).agg(F.sum(value).alias("own"))
    total = own.groupBy(*keys).agg(F.sum("own").alias("total"))
    return own.join(total, keys).select(*keys, part, (F.col("total") - F.col("own")).alias("rest"))


def intra_inter(edges: DataFrame) -> DataFrame:
    """edges: relation (within, between), w. One row: medians, their ratio, u, auc, cliff delta."""
    e = edges.filter(F.col("relation").isin("within", "between")).withColumn("_in", F.col("relation") == "within")
    m = e.agg(F.median(F.when(F.col("_in"), F.col("w"))).alias("median_within"), F.median(F.when(~F.col("_in"), F.col("w"))).alias("median_between"))
    return mann_whitney(e, "w", "_in").crossJoin(m).withColumn("ratio", F.try_divide("median_within", "median_between"))
