"""Operators on sites and genotypes: counting, selection, orientation, classes and states.

Genotype tables are long: one row a person and site, dosage null where any allele is missing.
Frequencies are compared as integers, never as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import complement

SITE = ["chrom", "pos"]


def allele_counts(gt: DataFrame, keys: list[str] = SITE) -> DataFrame:
    """gt: a0, a1 (null: missing). ac and an over called alleles; a partial genotype counts its known one."""
    a0, a1 = F.col("a0"), F.col("a1")
    one = F.coalesce((a0 > 0).cast("long"), F.lit(0)) + F.coalesce((a1 > 0).cast("long"), F.lit(0))
    called = a0.isNotNull().cast("long") + a1.isNotNull().cast("long")
    return gt.groupBy(*keys).agg(F.sum(one).alias("ac"), F.sum(called).alias("an"))


def mark_original_alleles(df: DataFrame) -> DataFrame:
    """df: chrom, pos, ref, alt. orig_nalleles: distinct ref and alt strings at the site before
    splitting; single_ref: whether they share one ref."""
    site = df.groupBy(*SITE).agg(
        F.size(F.array_distinct(F.concat(F.collect_set("ref"), F.collect_set("alt")))).cast("long").alias("orig_nalleles"), (F.size(F.collect_set("ref")) == 1).alias("single_ref")
    )
    return df.join(site, SITE)


def split_multiallelic(df: DataFrame) -> DataFrame:
    """df: chrom, pos, ref, alts array, a0, a1 (allele numbers). One row an alt; allele k becomes 1, others 0."""
    code = lambda a: F.when(F.col(a).isNotNull(), (F.col(a) == F.col("k") + 1).cast("long"))
    rest = [c for c in df.columns if c not in ("alts", "a0", "a1")]
    return df.select("*", F.posexplode("alts").alias("k", "alt")).select(*rest, "alt", code("a0").alias("a0"), code("a1").alias("a1"))


def filter_snv(df: DataFrame, max_maf: tuple[int, int] | None = None, passing: bool = False) -> DataFrame:
    """Biallelic sites of two single bases; with max_maf (a fraction), mac/an at most that; with passing, filter PASS."""
    keep = F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$") & (F.col("ref") != F.col("alt"))
    if max_maf:
        num, den = max_maf
        keep &= (F.col("an") > 0) & (F.least(F.col("ac"), F.col("an") - F.col("ac")) * den <= F.col("an") * num)
    if passing:
        keep &= F.col("filter") == "PASS"
    return df.filter(keep)


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, chrom, n of each named table; one union, one aggregate."""
    parts = [df.select(F.lit(name).alias("stage"), "chrom") for name, df in stages.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("stage", "chrom").agg(F.count("*").alias("n"))


def rare_reason(max_num: int = 1, max_den: int = 100, min_mac: int = 2) -> Column:
    """Why a site (ac, an, orig_nalleles, ref, alt) isn't rare-minor: the first reason that fits, or included."""
    ac, an = F.col("ac"), F.col("an")
    mac = F.least(ac, an - ac)
    return (
        F.when(F.col("orig_nalleles") > 2, "multiallelic")
        .when(~(F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$")), "non_snv")
        .when(an == 0, "all_missing")
        .when(2 * ac == an, "frequency_tie")
        .when(mac < min_mac, "mac_below_min")
        .when(mac * max_den > an * max_num, "maf_above_max")
        .otherwise("included")
    )


def select_rare_minor(sites: DataFrame, max_num: int = 1, max_den: int = 100, min_mac: int = 2) -> DataFrame:
    """Included sites with rare_allele (1: alt is minor), rare_ac, rare_an, rare_af; the frequency bound is inclusive."""
    ac, an = F.col("ac"), F.col("an")
    kept = sites.filter(rare_reason(max_num, max_den, min_mac) == "included")
    rare = F.least(ac, an - ac)
    return kept.withColumns({"rare_allele": (2 * ac < an).cast("long"), "rare_ac": rare, "rare_an": an, "rare_af": rare / an})


def rare_exclusions(sites: DataFrame, **options) -> DataFrame:
    """reason, n: exclusive counts."""
    return sites.groupBy(rare_reason(**options).alias("reason")).agg(F.count("*").alias("n"))


def rare_dosage(genotypes: DataFrame, rare: DataFrame) -> DataFrame:
    """Copies of the rare allele of each genotype at a selected site."""
    d = genotypes.join(rare.select(*SITE, "rare_allele"), SITE)
    return d.withColumn("rare_dosage", F.when(F.col("rare_allele") == 1, F.col("dosage")).otherwise(2 - F.col("dosage")))


def orientation_state(ac: str = "ac", an: str = "an") -> Column:
    ac_, an_ = F.col(ac), F.col(an)
    return F.when(an_ == 0, "all_missing").when(2 * ac_ == an_, "tie").when(2 * ac_ > an_, "alt_major").otherwise("alt_minor")


def carriers(genotypes: DataFrame, sites: DataFrame, mode: str = "historical_alt") -> DataFrame:
    """sample_id, chrom, pos of carriers: of alt, of the minor allele, or of alt where it isn't major."""
    d = genotypes.filter("dosage is not null").join(sites.select(*SITE, "ac", "an"), SITE)
    state = orientation_state()
    if mode == "historical_alt":
        d = d.filter("dosage > 0")
    elif mode == "minor_allele":
        d = d.filter(F.when(state == "alt_major", F.col("dosage") < 2).when(state == "alt_minor", F.col("dosage") > 0).otherwise(False))
    elif mode == "exclude_alt_major":
        d = d.filter((F.col("dosage") > 0) & (state != "alt_major"))
    else:
        raise ValueError(f"unknown mode {mode}")
    return d.select("sample_id", *SITE)


def source_minor_carriers(genotypes: DataFrame, rare: DataFrame) -> DataFrame:
    """Carriers with complete genotypes and a rare dosage above zero."""
    return rare_dosage(genotypes, rare).filter("rare_dosage > 0").select("sample_id", *SITE, "rare_dosage")


def mutation_class(ref: str = "ref", alt: str = "alt", before: str = "before", after: str = "after") -> Column:
    """cpg_ti, noncpg_ti, transversion or non_snv, given the neighbouring reference bases."""
    r, a = F.col(ref), F.col(alt)
    pair = F.concat(r, a)
    transition = pair.isin("AG", "GA", "CT", "TC")
    cpg = ((r == "C") & (F.col(after) == "G")) | ((r == "G") & (F.col(before) == "C"))
    return F.when(~(r.rlike("^[ACGT]$") & a.rlike("^[ACGT]$")) | (r == a), "non_snv").when(transition & cpg, "cpg_ti").when(transition, "noncpg_ti").otherwise("transversion")


def base_at(sites: DataFrame, reference: DataFrame, chunk: int, shift: int = 0, name: str = "base") -> DataFrame:
    """sites with the reference base at pos + shift. reference: chrom, chunk_start (1-based), bases; null outside."""
    at = F.col("pos") + shift
    start = F.floor((at - 1) / chunk) * chunk + 1
    r = reference.select(F.col("chrom").alias("_c"), F.col("chunk_start").alias("_s"), F.col("bases").alias("_b"))
    d = sites.withColumn("_at", at).join(r, (F.col("chrom") == F.col("_c")) & (start == F.col("_s")), "left")
    letter = F.upper(F.substr(F.col("_b"), (F.col("_at") - F.col("_s") + 1).cast("int"), F.lit(1)))
    return d.withColumn(name, F.when(letter != "", letter)).drop("_c", "_s", "_b", "_at")


def polarise(sites: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """ancestral, status (ok_ref, ok_alt, ambiguous, mismatch) and flip, from an ancestral sequence."""
    d = base_at(sites, reference, chunk, name="ancestral")
    status = (
        F.when(F.col("ancestral").isNull(), "mismatch").when(~F.col("ancestral").isin("A", "C", "G", "T"), "ambiguous")
        .when(F.col("ancestral") == F.col("ref"), "ok_ref").when(F.col("ancestral") == F.col("alt"), "ok_alt").otherwise("mismatch")
    )
    return d.withColumn("status", status).withColumn("flip", F.col("status") == "ok_alt")


def reference_audit(sites: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """chrom, n, n_match, n_mismatch, n_outside of ref against the reference sequence."""
    d = base_at(sites, reference, chunk)
    same = F.col("base") == F.col("ref")
    return d.groupBy("chrom").agg(F.count("*").alias("n"), F.count_if(same).alias("n_match"), F.count_if(~same).alias("n_mismatch"), F.count_if(F.col("base").isNull()).alias("n_outside"))


def allele_correspondence(a1: str, a2: str, b1: str, b2: str) -> Column:
    """direct, complement, palindromic_ambiguous or mismatch, of two unordered allele pairs."""
    pair = lambda x, y: F.array_sort(F.array(x, y))
    p, q, c = pair(F.col(a1), F.col(a2)), pair(F.col(b1), F.col(b2)), pair(complement(F.col(b1)), complement(F.col(b2)))
    return F.when((p == q) & (q == c), "palindromic_ambiguous").when(p == q, "direct").when(p == c, "complement").otherwise("mismatch")


def choose_record(targets: DataFrame, panel: DataFrame) -> DataFrame:
    """targets: chrom, pos, ref, alt; panel: chrom, pos, ref, alts. state of each target: exact,
    multiallelic (its alt among several), position_only, absent; n_compatible over 1 is an error to look at."""
    p = panel.select(*SITE, F.col("ref").alias("_r"), "alts")
    d = targets.join(p, SITE, "left")
    fits = (F.col("_r") == F.col("ref")) & F.array_contains("alts", F.col("alt"))
    d = d.groupBy(*SITE, "ref", "alt").agg(
        F.count_if(fits).alias("n_compatible"), F.coalesce(F.max(F.when(fits, F.size("alts"))), F.lit(0)).cast("long").alias("_n"), F.count("_r").alias("n_records")
    )
    state = F.when((F.col("n_compatible") > 0) & (F.col("_n") == 1), "exact").when(F.col("n_compatible") > 0, "multiallelic").when(F.col("n_records") > 0, "position_only").otherwise("absent")
    return d.select(*SITE, "ref", "alt", "n_compatible", "n_records", state.alias("state"))


def quality_state(depth: str, quality: str, least_depth: int, least_quality: int) -> Column:
    """pass, failed or missing (either value unknown)."""
    d, q = F.col(depth), F.col(quality)
    return F.when(d.isNull() | q.isNull(), "missing").when((d >= least_depth) & (q >= least_quality), "pass").otherwise("failed")


def block_state(markers: DataFrame, block: str, marker: str, allele: str, needed: int) -> DataFrame:
    """Callability of each block: UNEVALUABLE_FEW (under `needed` called markers),
    UNEVALUABLE_CONFLICT (a marker with two alleles), PRESENT (any allele above zero) or ABSENT."""
    per = markers.filter(F.col(allele).isNotNull()).groupBy(block, marker).agg(F.countDistinct(allele).alias("k"), F.max(allele).alias("top"))
    d = per.groupBy(block).agg(F.count("*").alias("n_called"), F.max("k").alias("k"), F.max("top").alias("top"))
    d = markers.select(block).distinct().join(d, block, "left").withColumn("n_called", F.coalesce("n_called", F.lit(0)))
    state = F.when(F.col("n_called") < needed, "UNEVALUABLE_FEW").when(F.col("k") > 1, "UNEVALUABLE_CONFLICT").when(F.col("top") > 0, "PRESENT").otherwise("ABSENT")
    return d.select(block, "n_called", state.alias("state"))


def classify_gvcf(targets: DataFrame, records: DataFrame, least_depth: int = 8, least_quality: int = 20, bucket: int = 4096) -> DataFrame:
    """State of each target (chrom, pos, ref, alt) in one person's gVCF.

    records: chrom, lo, hi, ref, alt (null: reference block), dosage (null: missing), dp, gq.
    Precedence: explicit_exact, other_alt_hom_ref, reference_block (dosage 0), missing,
    incompatible; no record: uncovered. Records below the gate count as missing.
    """
    from .intervals import overlap_join

    t = targets.withColumns({"lo": F.col("pos"), "hi": F.col("pos")})
    r = records.select("chrom", "lo", "hi", F.col("ref").alias("r_ref"), F.col("alt").alias("r_alt"), F.col("dosage").alias("r_dosage"), "dp", "gq")
    j = overlap_join(t, r, ["chrom"], bucket)
    good = F.coalesce((F.col("dp") >= least_depth) & (F.col("gq") >= least_quality), F.lit(False)) & F.col("r_dosage").isNotNull()
    exact = (F.col("r_lo") == F.col("pos")) & (F.col("r_ref") == F.col("ref")) & (F.col("r_alt") == F.col("alt"))
    place = (
        F.when(good & exact, 1).when(good & F.col("r_alt").isNotNull() & (F.col("r_dosage") == 0), 2).when(good & F.col("r_alt").isNull(), 3).when(~good, 4).otherwise(5)
    )
    best = j.groupBy("chrom", "pos", "ref", "alt").agg(F.min(F.struct(place.alias("place"), F.when(exact, F.col("r_dosage")).otherwise(0).alias("dosage"))).alias("b"))
    names = F.create_map(*[x for k, v in enumerate(["explicit_exact", "other_alt_hom_ref", "reference_block", "missing", "incompatible"], 1) for x in (F.lit(k), F.lit(v))])
    d = targets.join(best, ["chrom", "pos", "ref", "alt"], "left")
    return d.select("chrom", "pos", "ref", "alt", F.coalesce(names[F.col("b.place")], F.lit("uncovered")).alias("state"), F.when(F.col("b.place") <= 3, F.col("b.dosage")).cast("long").alias("dosage"))
