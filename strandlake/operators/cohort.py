"""Cohort tables: joins with explicit absence, splits, matrices, models, contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut


def feature_store(base: DataFrame, tables: dict[str, DataFrame], key: str, zero: dict[str, list[str]]) -> DataFrame:
    """base with each table left-joined; in_<name> tells presence before the named columns get zeros."""
    d = base
    for name, t in tables.items():
        d = d.join(t.withColumn(f"in_{name}", F.lit(True)), key, "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
        d = d.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero.get(name, [])})
    return d


def define_cohort(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: both, only_a or only_b."""
    j = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return j.select(key, F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("both").alias("side"))


def unique_rows(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(df with identical repeats of a key collapsed, keys whose rows conflict)."""
    d = df.distinct()
    return d, d.groupBy(key).agg(F.count("*").alias("n_versions")).filter("n_versions > 1")


def subtype() -> Column:
    """Label source of a person: community, noise (-1) or isolated (null)."""
    c = F.col("community")
    return F.when(c.isNull(), "isolated").when(c == -1, "noise").otherwise("community")


def grouped_folds(people: DataFrame, group: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """people with fold; a group is never split, and groups of each majority label are dealt in hash order.

    Dealing is by rank within label, cumulated over hash ranges, so that no task sees all groups.
    """
    g = people.groupBy(group).agg((F.avg(F.col(label).cast("double")) >= 0.5).alias("_y"))
    g = g.withColumn("_h", F.xxhash64(F.col(group), F.lit(seed))).withColumn("_range", F.shiftright("_h", 52))
    n = g.groupBy("_y", "_range").agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_y").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_y", "_range").orderBy("_h", group))
    dealt = g.withColumn("_r", rank).join(broadcast_if_small(cut(before)), ["_y", "_range"]).select(group, ((F.col("_before") + F.col("_r") - 1) % k).alias("fold"))
    return people.join(dealt, group)


def fold_distance(people: DataFrame, label: str, levels: list[str]) -> DataFrame:
    """fold and its distance from the whole: |difference of prevalence| plus half the summed level differences of each column."""
    y = F.col(label).cast("double")
    whole = people.agg(F.avg(y).alias("_p"))
    d = people.groupBy("fold").agg(F.avg(y).alias("p")).crossJoin(F.broadcast(whole)).select("fold", F.abs(F.col("p") - F.col("_p")).alias("distance"))
    for c in levels:
        n = people.groupBy("fold", c).agg(F.count("*").alias("n"))
        size = people.groupBy("fold").agg(F.count("*").alias("size"))
        all_n = people.groupBy(c).agg((F.count("*")).alias("an"))
        total = people.agg(F.count("*").alias("t"))
        grid = size.crossJoin(F.broadcast(all_n)).crossJoin(F.broadcast(total)).join(n, ["fold", c], "left").na.fill(0, ["n"])
        tvd = grid.groupBy("fold").agg((F.sum(F.abs(F.col("n") / F.col("size") - F.col("an") / F.col("t"))) / 2).alias("_d"))
        d = d.join(tvd, "fold").select("fold", (F.col("distance") + F.col("_d")).alias("distance"))
    return d


def split_audit(people: DataFrame, group: str, label: str) -> DataFrame:
    """By fold: n, prevalence, groups, largest group, and groups that cross folds (zero if right)."""
    crossed = people.groupBy(group).agg(F.countDistinct("fold").alias("k")).filter("k > 1")
    sizes = people.groupBy("fold", group).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("y"))
    c = people.join(crossed.select(group), group, "left_semi").groupBy("fold").agg(F.countDistinct(group).alias("crossed"))
    d = sizes.groupBy("fold").agg(F.sum("n").alias("size"), (F.sum("y") / F.sum("n")).alias("prevalence"), F.count("*").alias("n_groups"), F.max("n").alias("largest"))
    return d.join(c, "fold", "left").na.fill(0, ["crossed"])


def dosage_matrix(genotypes: DataFrame, max_missing: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(cells sample_id, col, dosage > 0; variants with col, n_carriers, mac, n_missing) of sites with few missing.

    Columns are numbered by chromosome and position through counts by range and offsets; missing cells are zero.
    """
    num, den = max_missing
    x = F.col("dosage")
    v = genotypes.groupBy("chrom", "pos").agg(F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_missing"), F.count_if(x > 0).alias("n_carriers"), F.coalesce(F.sum(x), F.lit(0)).alias("mac"))
    v = v.filter(F.col("n_missing") * den <= F.col("n") * num)
    v = v.withColumn("_range", F.floor(F.col("pos") / 1_000_000))
    n = v.groupBy("chrom", "_range").agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("chrom", "_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("chrom", "_range").orderBy("pos"))
    v = v.withColumn("_r", rank).join(broadcast_if_small(cut(before)), ["chrom", "_range"]).select("chrom", "pos", (F.col("_before") + F.col("_r") - 1).alias("col"), "n_carriers", "mac", "n_missing")
    cells = genotypes.filter("dosage > 0").join(v.select("chrom", "pos", "col"), ["chrom", "pos"]).select("sample_id", "col", "dosage")
    return cells, v


def standardise(genotypes: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(d - 2p) / sqrt(2p(1 - p)), missing 0; sites without variation in the fitting set are left out."""
    p = F.col("p")
    f = frequencies.filter((p > 0) & (p < 1)).select("chrom", "pos", "p")
    z = F.coalesce((F.col("dosage") - 2 * p) / F.sqrt(2 * p * (1 - p)), F.lit(0.0))
    return genotypes.join(f, ["chrom", "pos"]).withColumn("z", z)


def support_tables(people: DataFrame, group: str) -> DataFrame:
    """By fold and side (fit, assess): n, largest group's share, effective groups (1 / sum of squared shares)."""
    folds = people.select("fold").distinct().withColumnRenamed("fold", "of")
    d = people.crossJoin(F.broadcast(folds)).withColumn("side", F.when(F.col("fold") == F.col("of"), "assess").otherwise("fit"))
    n = d.groupBy("of", "side", group).agg(F.count("*").alias("n"))
    t = n.groupBy("of", "side").agg(F.sum("n").alias("size"), F.max("n").alias("top"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return t.select(F.col("of").alias("fold"), "side", "size", (F.col("top") / F.col("size")).alias("top_share"), (F.col("size") * F.col("size") / F.col("q")).alias("effective"))


def site_stability(selected: DataFrame) -> DataFrame:
    """selected: fold, chrom, pos, allele. For pairs of folds: common sites, union, Jaccard index, orientation flips."""
    a = selected.select(F.col("fold").alias("fold_a"), "chrom", "pos", F.col("allele").alias("x"))
    b = selected.select(F.col("fold").alias("fold_b"), "chrom", "pos", F.col("allele").alias("y"))
    n = selected.groupBy("fold").agg(F.count("*").alias("n"))
    j = a.join(b, ["chrom", "pos"]).filter("fold_a < fold_b").groupBy("fold_a", "fold_b").agg(F.count("*").alias("common"), F.count_if(F.col("x") != F.col("y")).alias("flips"))
    d = j.join(n.select(F.col("fold").alias("fold_a"), F.col("n").alias("na")), "fold_a").join(n.select(F.col("fold").alias("fold_b"), F.col("n").alias("nb")), "fold_b")
    union = F.col("na") + F.col("nb") - F.col("common")
    return d.select("fold_a", "fold_b", "common", union.alias("union"), (F.col("common") / union).alias("jaccard"), "flips")


# --- contract checks: each returns what breaks the rule

def pair_violations(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """rule, n: self pairs, pairs given twice (either way round), values that are negative or not finite."""
    v = F.col(value)
    one = pairs.select(F.when(F.col(a) == F.col(b), "self_pair").alias("r1"), F.when(v.isNull() | F.isnan(v.cast("double")) | (v < 0), "bad_value").alias("r2"))
    rows = one.select(F.explode(F.array_compact(F.array("r1", "r2"))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    twice = pairs.groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(F.count("*").alias("k")).filter("k > 1").agg(F.count("*").alias("n")).select(F.lit("repeated_pair").alias("rule"), "n").filter("n > 0")
    return rows.unionByName(twice)


def axis_violations(sites: DataFrame) -> DataFrame:
    """chrom, n_repeated: positions that a chromosome's axis holds more than once."""
    return sites.groupBy("chrom", "pos").agg(F.count("*").alias("k")).groupBy("chrom").agg(F.count_if(F.col("k") > 1).alias("n_repeated"), F.count("*").alias("n_positions"))


def aggregates_differ(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows of two aggregates that are missing on a side or differ by more than the tolerance."""
    j = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys, "full")
    return j.filter(F.col("x").isNull() | F.col("y").isNull() | (F.abs(F.col("x") - F.col("y")) > tolerance))


def mixed_contracts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_values of parameters that differ between the parts to be added up."""
    row = df.agg(*[F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "n_values").filter("n_values > 1")


def role_collisions(units: DataFrame, axes: list[str]) -> DataFrame:
    """axis, identity, n_roles of identities on any axis that occur in more than one role."""
    long = units.select("role", *[F.col(c).cast("string").alias(c) for c in axes]).unpivot(["role"], axes, "axis", "identity").filter("identity is not null")
    return long.groupBy("axis", "identity").agg(F.countDistinct("role").alias("n_roles")).filter("n_roles > 1")


def link_audit(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """One row: children, linked and orphaned ones, parents without children."""
    p, c = parents.select(F.col(parent_key).alias("k")).distinct(), children.select(F.col(child_key).alias("k"))
    n = c.groupBy("k").agg(F.count("*").alias("n"))
    j = n.join(p.withColumn("_p", F.lit(1)), "k", "full")
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_children"), F.coalesce(F.sum(F.when(F.col("_p").isNotNull(), F.col("n"))), F.lit(0)).alias("n_linked"), F.coalesce(F.sum(F.when(F.col("_p").isNull(), F.col("n"))), F.lit(0)).alias("n_orphaned"), F.count_if(F.col("n").isNull()).alias("n_childless"))
