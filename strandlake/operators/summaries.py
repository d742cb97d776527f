"""Cohort summaries: quality, spectra, linkage, composition, concordance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut

SITE = ["chrom", "pos"]


def sample_qc(genotypes: DataFrame, sites: DataFrame) -> DataFrame:
    """Per person: n_missing of n_sites, f_miss, observed and expected homozygotes and F = (O - E) / (N - E).

    E adds up 1 - 2pq * an / (an - 1) over the person's called sites that vary.
    """
    p = F.col("ac") / F.col("an")
    e = sites.filter("an > 1 and ac > 0 and ac < an").select(*SITE, (1 - 2 * p * (1 - p) * F.col("an") / (F.col("an") - 1)).alias("e"))
    d = genotypes.join(e, SITE, "left")
    used = F.col("dosage").isNotNull() & F.col("e").isNotNull()
    d = d.groupBy("sample_id").agg(
        F.count("*").alias("n_sites"), F.count_if(F.col("dosage").isNull()).alias("n_missing"), F.count_if(used & (F.col("dosage") != 1)).alias("o_hom"),
        F.sum(F.when(used, F.col("e"))).alias("e_hom"), F.count_if(used).alias("n_used"),
    )
    return d.withColumns({"f_miss": F.col("n_missing") / F.col("n_sites"), "f": F.try_divide(F.col("o_hom") - F.col("e_hom"), F.col("n_used") - F.col("e_hom"))})


def qc_flags(qc: DataFrame, columns: list[str], k: float = 3.0, **limits: float) -> DataFrame:
    """Flags of each column: above its limit, or off the mean by more than k population standard deviations."""
    stats = qc.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    d = qc.crossJoin(F.broadcast(stats))
    for c in columns:
        off = F.abs(F.col(c) - F.col(f"_m_{c}")) > k * F.col(f"_s_{c}")
        over = F.col(c) > limits[c] if c in limits else F.lit(False)
        d = d.withColumn(f"{c}_flag", F.coalesce(off | over, F.lit(False)))
    return d.drop(*[x for c in columns for x in (f"_m_{c}", f"_s_{c}")])


def is_transition(ref: str = "ref", alt: str = "alt") -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def site_stats(sites: DataFrame, keys: list[str]) -> DataFrame:
    """records, snps, ti, tv and ti_tv (null without transversions)."""
    snp = F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$")
    d = sites.groupBy(*keys).agg(F.count("*").alias("records"), F.count_if(snp).alias("snps"), F.count_if(snp & is_transition()).alias("ti"), F.count_if(snp & ~is_transition()).alias("tv"))
    return d.withColumn("ti_tv", F.try_divide("ti", "tv"))


def rare_density(genotypes: DataFrame, rare: DataFrame) -> DataFrame:
    """Per person over rare sites: hom-ref, het, hom-alt, missing, dosage (hets + 2 homs) and dosage a called site."""
    d = genotypes.join(rare.select(*SITE), SITE)
    x = F.col("dosage")
    d = d.groupBy("sample_id").agg(F.count_if(x == 0).alias("n_ref_hom"), F.count_if(x == 1).alias("n_het"), F.count_if(x == 2).alias("n_alt_hom"), F.count_if(x.isNull()).alias("n_missing"))
    dose = F.col("n_het") + 2 * F.col("n_alt_hom")
    return d.withColumns({"rare_dosage": dose, "density": F.try_divide(dose, F.col("n_ref_hom") + F.col("n_het") + F.col("n_alt_hom"))})


def sfs(sites: DataFrame, bins: int, n_people: int, least_called: tuple[int, int], folded: bool) -> DataFrame:
    """bin (0-based), lo, hi, n of allele frequencies at sites called in enough people; empty bins stay.

    Bins are half-open but the last, closed at the top (0.5 folded, 1 else).
    """
    num, den = least_called
    ac, an = F.col("ac"), F.col("an")
    d = sites.filter((an > 0) & (an * den >= 2 * n_people * num))
    count = F.least(ac, an - ac) if folded else ac
    scale = 2 * bins if folded else bins
    spark = sites.sparkSession
    d = d.select(F.least(F.floor(count * scale / an), F.lit(bins - 1)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    top = 0.5 if folded else 1.0
    dim = spark.range(bins).select(F.col("id").alias("bin"), (F.col("id") * (top / bins)).alias("lo"), ((F.col("id") + 1) * (top / bins)).alias("hi"))
    return dim.join(d, "bin", "left").na.fill(0, ["n"])


def rare_tail(sites: DataFrame, most: int, folded: bool) -> DataFrame:
    """ac, n: sites with 1 to `most` copies (folded: of the rarer allele); counts that don't occur have zero."""
    ac = F.least("ac", F.col("an") - F.col("ac")) if folded else F.col("ac")
    n = sites.filter("an > 0").select(ac.alias("ac")).groupBy("ac").agg(F.count("*").alias("n"))
    return sites.sparkSession.range(1, most + 1).select(F.col("id").alias("ac")).join(n, "ac", "left").na.fill(0, ["n"])


def linkage_sites(sites: DataFrame, min_maf: float, max_missing: float, thin: int) -> DataFrame:
    """Sites (ac, an, n_missing) common and called enough for linkage, the first of every `thin` bp of a chromosome."""
    ac, an = F.col("ac"), F.col("an")
    d = sites.filter((an > 0) & (F.least(ac, an - ac) >= min_maf * an) & (F.col("n_missing") <= max_missing * (an / 2 + F.col("n_missing"))))
    return d.groupBy("chrom", F.floor(F.col("pos") / thin).alias("_b")).agg(F.min("pos").alias("pos")).drop("_b")


def derived_counts(polarised: DataFrame) -> DataFrame:
    """dac and daf of sites whose ancestral base is ref or alt."""
    d = polarised.filter(F.col("status").isin("ok_ref", "ok_alt") & (F.col("an") > 0))
    dac = F.when(F.col("status") == "ok_ref", F.col("ac")).otherwise(F.col("an") - F.col("ac"))
    return d.withColumns({"dac": dac, "daf": dac / F.col("an")})


def ld_pairs(genotypes: DataFrame, keys: list[str], window: int) -> DataFrame:
    """pos_a, pos_b, n and r2 of dosages called in both, for sites up to `window` apart.

    A band join by buckets of the window's width: each site meets its own and the next bucket.
    """
    g = genotypes.filter("dosage is not null").select("sample_id", *keys, "pos", "dosage")
    a = g.select("sample_id", *keys, F.col("pos").alias("pos_a"), F.col("dosage").alias("x"), F.explode(F.array(F.floor(F.col("pos") / window), F.floor(F.col("pos") / window) + 1)).alias("_b"))
    b = g.select("sample_id", *keys, F.col("pos").alias("pos_b"), F.col("dosage").alias("y"), F.floor(F.col("pos") / window).alias("_b"))
    j = a.join(b, ["sample_id", *keys, "_b"]).filter((F.col("pos_a") < F.col("pos_b")) & (F.col("pos_b") - F.col("pos_a") <= window))
    s = j.groupBy(*keys, "pos_a", "pos_b").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"),
    )
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    r2 = F.try_divide((cov * cov).cast("double"), ((n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))).cast("double"))
    return s.select(*keys, "pos_a", "pos_b", "n", r2.alias("r2"))


def ld_decay(pairs: DataFrame, size: int) -> DataFrame:
    """Count, mean and median r2 by distance bin."""
    b = F.floor((F.col("pos_b") - F.col("pos_a")) / size) * size
    return pairs.filter("r2 is not null").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("r2").alias("mean_r2"), F.median("r2").alias("median_r2"))


def composition(people: DataFrame, group: str, level: str, missing: str = "MISSING") -> DataFrame:
    """Counts and fractions of every level in every group; levels that a group lacks have zero."""
    d = people.select(group, F.coalesce(F.col(level), F.lit(missing)).alias(level))
    n = d.groupBy(group, level).agg(F.count("*").alias("n"))
    grid = d.select(group).distinct().crossJoin(F.broadcast(d.select(level).distinct()))
    total = n.groupBy(group).agg(F.sum("n").alias("total"))
    out = grid.join(n, [group, level], "left").join(total, group).na.fill(0, ["n"])
    return out.select(group, level, "n", (F.col("n") / F.col("total")).alias("fraction"))


def suppressed(compositions: DataFrame, group: str, level: str, least: int) -> DataFrame:
    """Levels under `least` of a group are added up as SUPPRESSED."""
    name = F.when(F.col("n") < least, "SUPPRESSED").otherwise(F.col(level))
    return compositions.groupBy(group, name.alias(level)).agg(F.sum("n").alias("n"))


def against_background(compositions: DataFrame, group: str, level: str) -> DataFrame:
    """compositions (n, fraction) with background, the level's share of all groups together, and ratio of the two."""
    d = compositions.groupBy(level).agg(F.sum("n").alias("_n"))
    total = F.broadcast(d.agg(F.sum("_n").alias("_t")))
    b = d.crossJoin(total).select(level, (F.col("_n") / F.col("_t")).alias("background"))
    return compositions.join(b, level).withColumn("ratio", F.try_divide("fraction", "background"))


def concentration(people: DataFrame, group: str, level: str) -> DataFrame:
    """n, Herfindahl index, effective number of levels and the largest level's fraction."""
    n = people.groupBy(group, level).agg(F.count("*").alias("n"))
    d = n.groupBy(group).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.max("n").alias("top"))
    hhi = F.col("squares") / (F.col("total") * F.col("total"))
    return d.select(group, F.col("total").alias("n"), hhi.alias("hhi"), (1 / hhi).alias("effective"), (F.col("top") / F.col("total")).alias("top_fraction"))


def distribution(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, mean, median, population deviation and linear percentiles."""
    v = F.col(value).cast("double")
    p = F.percentile(v, F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    d = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), p.alias("_p"))
    return d.select(*keys, "n", "mean", "sd", *[F.get("_p", F.lit(k)).alias(f"p{q:02d}") for k, q in enumerate((5, 25, 50, 75, 95))])


def genotype_support(genotypes: DataFrame, roles: DataFrame) -> DataFrame:
    """By role, and over ALL: called, missing, ac, an, carriers, homozygous carriers of each site."""
    d = genotypes.join(broadcast_if_small(cut(roles)), "sample_id").withColumn("role", F.explode(F.array("role", F.lit("ALL"))))
    x = F.col("dosage")
    return d.groupBy("role", *SITE).agg(
        F.count("dosage").alias("n_called"), F.count_if(x.isNull()).alias("n_missing"), F.coalesce(F.sum(x), F.lit(0)).alias("ac"), (2 * F.count(x)).alias("an"), F.count_if(x > 0).alias("n_carriers"), F.count_if(x == 2).alias("n_hom"),
    )


def genotype_counts(genotypes: DataFrame) -> DataFrame:
    x = F.col("dosage")
    return genotypes.groupBy(*SITE).agg(*[F.count_if(x == k).alias(f"n_{k}") for k in range(3)], F.count_if(x.isNull()).alias("n_missing"))


def concordance(a: DataFrame, b: DataFrame, by: str | None = None) -> DataFrame:
    """n_joint, n_same and the fraction of genotypes called in both, by a column of a."""
    key = [by] if by else []
    j = a.filter("dosage is not null").join(b.filter("dosage is not null").select("sample_id", *SITE, F.col("dosage").alias("_d")), ["sample_id", *SITE])
    d = j.groupBy(*key).agg(F.count("*").alias("n_joint"), F.count_if(F.col("dosage") == F.col("_d")).alias("n_same"))
    return d.withColumn("concordance", F.try_divide("n_same", "n_joint"))


def external_presence(targets: DataFrame, panel: DataFrame) -> DataFrame:
    """state of each target (chrom, pos, ref, alt) in a panel (chrom, pos, ref, alt, ac, an): carried,
    monomorphic, other_allele, ref_mismatch or absent. A repeated panel allele counts with its maximum."""
    p = panel.groupBy(*SITE, F.col("ref").alias("_r"), F.col("alt").alias("_a")).agg(F.max("ac").alias("_ac"))
    j = targets.join(p, SITE, "left")
    same_ref, exact = F.col("_r") == F.col("ref"), (F.col("_r") == F.col("ref")) & (F.col("_a") == F.col("alt"))
    place = F.when(exact & (F.col("_ac") > 0), 1).when(exact, 2).when(same_ref, 3).when(F.col("_r").isNotNull(), 4).otherwise(5)
    d = j.groupBy(*SITE, "ref", "alt").agg(F.min(place).alias("_place"), F.coalesce(F.max(F.when(exact, F.col("_ac"))), F.lit(0)).alias("panel_ac"))
    names = F.array(*map(F.lit, ("carried", "monomorphic", "other_allele", "ref_mismatch", "absent")))
    return d.select(*SITE, "ref", "alt", F.get(names, F.col("_place") - 1).alias("state"), "panel_ac")


def presence_without(targets: DataFrame, panel: DataFrame, dropped: DataFrame) -> DataFrame:
    """external_presence() with the whole panel and without one sample (dropped: chrom, pos, ref, alt, ac of it): state, state_drop, and lost where only that sample carries the target."""
    key = [*SITE, "ref", "alt"]
    once = panel.groupBy(*key).agg(F.max("ac").alias("ac"))
    less = once.join(dropped.select(*key, F.col("ac").alias("_own")), key, "left").select(*key, F.greatest(F.col("ac") - F.coalesce("_own", F.lit(0)), F.lit(0)).alias("ac"))
    full, drop = external_presence(targets, once).withColumnRenamed("panel_ac", "ac_full"), external_presence(targets, less).select(*key, F.col("state").alias("state_drop"), F.col("panel_ac").alias("ac_drop"))
    return full.join(drop, key).withColumn("lost", (F.col("state") == "carried") & (F.col("state_drop") != "carried"))


def presence_summary(states: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of states by key and over all keys (ALL), with the carried fraction."""
    d = states
    for k in keys:
        d = d.withColumn(k, F.explode(F.array(F.col(k).cast("string"), F.lit("ALL"))))
    d = d.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col("state") == x).alias(f"n_{x}") for x in ("carried", "monomorphic", "other_allele", "ref_mismatch", "absent")])
    return d.withColumn("carried_fraction", F.col("n_carried") / F.col("n"))
