"""Audits of catalogues, roles, matrices and targets: counts of states and of breaches, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import complement
from ..plans.lineage import cut
from .axis import with_neighbours
from .intervals import union

SITE = ["chrom", "pos"]


def _snv_pair(a: Column, b: Column) -> Column:
    return F.coalesce(a.isin(*"ACGT") & b.isin(*"ACGT") & (a != b), F.lit(False))


def panel_correspondence(sites: DataFrame, rows: DataFrame) -> DataFrame:
    """Each site (chrom, pos, ref, alt) against the panel's rows at its position (chrom, pos, a1, a2).

    state: no_row, multiple (rows), unsupported (its row isn't two different bases),
    palindromic_ambiguous, direct, complement or mismatch. n_rows, n_direct, n_complement,
    n_unsupported, n_pairs (different unordered pairs of bases) say what is there.
    """
    unordered = lambda a, b: F.array_sort(F.array(a, b))
    d = sites.select(*SITE, "ref", "alt").join(rows.select(*SITE, "a1", "a2", F.lit(True).alias("_row")), SITE, "left")
    pair, own = unordered(F.col("a1"), F.col("a2")), unordered(F.col("ref"), F.col("alt"))
    other, good = unordered(complement(F.col("ref")), complement(F.col("alt"))), _snv_pair(F.col("a1"), F.col("a2"))
    d = d.groupBy(*SITE, "ref", "alt").agg(
        F.count("_row").alias("n_rows"), F.count_if(good & (pair == own)).alias("n_direct"), F.count_if(good & (pair == other)).alias("n_complement"),
        F.count_if(F.col("_row") & ~good).alias("n_unsupported"), F.count_distinct(F.when(good, pair)).alias("n_pairs"),
    )
    state = (
        F.when(F.col("n_rows") == 0, "no_row").when(F.col("n_rows") > 1, "multiple").when(F.col("n_unsupported") > 0, "unsupported")
        .when((F.col("n_direct") > 0) & (own == other), "palindromic_ambiguous").when(F.col("n_direct") > 0, "direct").when(F.col("n_complement") > 0, "complement").otherwise("mismatch")
    )
    return d.withColumn("state", state)


def phase_state(called: str, carriers: str, unphased: str) -> Column:
    """UNEVALUABLE_CALLABILITY (nobody called), PRESENT (carriers), UNEVALUABLE_PHASE (unphased heterozygotes only) or ABSENT."""
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    return F.when(c(called) == 0, "UNEVALUABLE_CALLABILITY").when(c(carriers) > 0, "PRESENT").when(c(unphased) > 0, "UNEVALUABLE_PHASE").otherwise("ABSENT")


def transfer_decision(patterns: DataFrame, group: str, needed: int = 2) -> DataFrame:
    """group, n_present, n_open, decision of patterns (group, pattern, state): PASS with enough present patterns, INCONCLUSIVE where unevaluable ones could make up for the rest, else STOP."""
    per = patterns.groupBy(group, "pattern").agg(F.max(F.col("state") == "PRESENT").alias("present"), F.max(F.col("state").startswith("UNEVALUABLE")).alias("open"))
    d = per.groupBy(group).agg(F.count_if("present").alias("n_present"), F.count_if(~F.col("present") & F.col("open")).alias("n_open"))
    decision = F.when(F.col("n_present") >= needed, "PASS").when(F.col("n_present") + F.col("n_open") >= needed, "INCONCLUSIVE").otherwise("STOP")
    return d.withColumn("decision", decision)


def call_support(calls: DataFrame, people: DataFrame) -> DataFrame:
    """role, ancestry (ALL for all of them), chrom, pos and counts of calls.

    calls: sample_id, chrom, pos, alleles (array of indexes, null ones missing), phased, and
    allele, the index that is counted. people: sample_id, role, ancestry. Complete calls
    have two known alleles; missing ones have none or an unknown one; others aren't diploid.
    """
    d = calls.join(people, "sample_id")
    g = F.col("alleles")
    missing = g.isNull() | (F.size(g) == 0) | F.exists(g, lambda x: x.isNull())
    complete = F.coalesce(~missing & (F.size(g) == 2), F.lit(False))
    dose = F.when(complete, F.size(F.filter(g, lambda x: x == F.col("allele")))).otherwise(0)
    d = d.select("role", "ancestry", *SITE, complete.alias("c"), missing.alias("m"), dose.alias("x"), F.coalesce("phased", F.lit(False)).alias("p"))
    d = d.groupBy("role", "ancestry", *SITE).agg(
        F.count_if("c").alias("n_complete"), F.count_if("m").alias("n_missing"), F.count_if(~F.col("c") & ~F.col("m")).alias("n_non_diploid"), F.sum("x").alias("ac"), (2 * F.count_if("c")).alias("an"),
        F.count_if(F.col("x") > 0).alias("n_carriers"), F.count_if(F.col("c") & F.col("p")).alias("n_phased"), F.count_if((F.col("x") > 0) & F.col("p")).alias("n_phased_carriers"), F.count_if(F.col("x") == 2).alias("n_hom_carriers"),
    )
    counts = [c for c in d.columns if c not in ("role", "ancestry", *SITE)]
    d = d.withColumn("ancestry", F.explode(F.array("ancestry", F.lit("ALL"))))  # counts are added up already
    return d.groupBy("role", "ancestry", *SITE).agg(*[F.sum(c).cast("long").alias(c) for c in counts])


def join_audit(master: DataFrame, flags: list[str]) -> DataFrame:
    """flag, n_people, n_rows, n_found, share: of a table that was joined to people, how many rows each source gave and whether people repeat."""
    row = master.agg(F.count("*").alias("n_rows"), F.countDistinct("sample_id").alias("n_people"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    d = row.unpivot(["n_people", "n_rows"], flags, "flag", "n_found")
    return d.select("flag", "n_people", "n_rows", "n_found", F.try_divide("n_found", "n_rows").alias("share"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, of_a, of_b: counts of both labels (nulls are one) with their shares of either."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    one = lambda c: cells.groupBy(F.col(c).alias(f"_{c}")).agg(F.sum("n").alias(f"n_{c}"))
    d = cells.join(one("a"), F.col("a").eqNullSafe(F.col("_a"))).join(one("b"), F.col("b").eqNullSafe(F.col("_b")))
    return d.select("a", "b", "n", (F.col("n") / F.col("n_a")).alias("of_a"), (F.col("n") / F.col("n_b")).alias("of_b"))


def matrix_summary(genotypes: DataFrame, max_missing: tuple[int, int]) -> DataFrame:
    """chrom (null: all), n_input, n_dropped (too many missing), n_retained, nnz, n_people, sparsity of the retained sites' matrix."""
    num, den = max_missing
    v = genotypes.groupBy(*SITE).agg(F.count("*").alias("n"), F.count_if(F.col("dosage").isNull()).alias("m"), F.count_if(F.col("dosage") > 0).alias("nz"))
    kept = F.col("m") * den <= F.col("n") * num
    per = cut(v.groupBy("chrom").agg(F.count("*").alias("n_input"), F.count_if(~kept).alias("n_dropped"), F.count_if(kept).alias("n_retained"), F.sum(F.when(kept, F.col("nz")).otherwise(0)).alias("nnz")))
    whole = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_input", "n_dropped", "n_retained", "nnz")]).select(F.lit(None).cast(per.schema["chrom"].dataType).alias("chrom"), "*")
    people = F.broadcast(genotypes.agg(F.countDistinct("sample_id").alias("n_people")))
    d = per.unionByName(whole).crossJoin(people)
    return d.withColumn("sparsity", 1 - F.try_divide("nnz", F.col("n_retained") * F.col("n_people")))


def order_differences(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """at, found, expected where two orders of people (at, sample_id) differ, also where one is longer."""
    j = rows.select("at", F.col("sample_id").alias("found")).join(expected.select("at", F.col("sample_id").alias("expected")), "at", "full")
    return j.filter(~F.col("found").eqNullSafe(F.col("expected")))


def site_contract(sites: DataFrame) -> DataFrame:
    """rule, n of breaches by sites (chrom, at, pos, ref, alt, role): unsorted (a position below the one before it in the given order), repeated (positions that a role has more than once), alleles (not two different bases), role_overlap (loci in more than one role). Rules without breaches are left out."""
    d = with_neighbours(sites.withColumn("_p", F.struct("at", "pos")), ["role", "chrom"], "at", "_p")
    unsorted = d.select(F.when(F.col("_before.pos") > F.col("pos"), "unsorted").alias("r1"), F.when(~_snv_pair(F.col("ref"), F.col("alt")), "alleles").alias("r2"))
    rows = unsorted.select(F.explode(F.array_compact(F.array("r1", "r2"))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    loci = sites.groupBy("chrom", "pos", "role").agg(F.count("*").alias("k")).groupBy("chrom", "pos").agg(F.count_if(F.col("k") > 1).alias("twice"), F.count("*").alias("roles"))
    more = loci.agg(F.sum("twice").alias("repeated"), F.count_if(F.col("roles") > 1).alias("role_overlap")).unpivot([], ["repeated", "role_overlap"], "rule", "n")
    return rows.unionByName(more.select("rule", F.coalesce("n", F.lit(0)).alias("n"))).filter("n > 0")


def role_separation(units: DataFrame, axes: list[str], a: str, b: str) -> DataFrame:
    """axis, n_a, n_b, n_both, n_incomplete of identities in two roles: different ones of each, those in both, and units of either that lack one."""
    d = units.filter(F.col("role").isin(a, b)).select("role", *[F.col(c).cast("string").alias(c) for c in axes]).unpivot(["role"], axes, "axis", "identity")
    blank = F.col("identity").isNull() | (F.col("identity") == "")
    incomplete = d.groupBy("axis").agg(F.count_if(blank).alias("n_incomplete"))
    one = d.filter(~blank).groupBy("axis", "identity").agg(F.max(F.col("role") == a).alias("in_a"), F.max(F.col("role") == b).alias("in_b"))
    n = one.groupBy("axis").agg(F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("n_both"))
    return incomplete.join(n, "axis", "left").na.fill(0, ["n_a", "n_b", "n_both"]).select("axis", "n_a", "n_b", "n_both", "n_incomplete")


def unit_overlaps(units: DataFrame, axes: list[str]) -> DataFrame:
    """unit, role, axis, n_identities, n_shared: of each unit's identities, how many occur in a unit of another role. Units of one identity never meet in pairs."""
    d = units.select("unit", "role", *[F.col(c).cast("string").alias(c) for c in axes]).unpivot(["unit", "role"], axes, "axis", "identity").filter("identity is not null").distinct()
    roles = d.groupBy("axis", "identity").agg(F.countDistinct("role").alias("roles"))
    return d.join(roles, ["axis", "identity"]).groupBy("unit", "role", "axis").agg(F.count("*").alias("n_identities"), F.count_if(F.col("roles") > 1).alias("n_shared"))


def exclude_regions(sources: dict[str, DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the union of all sources' intervals: keys, lo, hi; source, n, bp of each as it was given)."""
    rows = None
    for name, s in sources.items():
        part = s.select(*keys, "lo", "hi", F.lit(name).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    given = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("hi") - F.col("lo") + 1).alias("bp"))
    return union(rows.select(*keys, "lo", "hi"), keys), given


def target_balance(targets: DataFrame, stratum: str, positive: str, ratio: int) -> DataFrame:
    """stratum, n_positive, n_zero, requested_ratio, achieved_ratio, saturated: whether there are fewer zero pairs than were asked for."""
    d = targets.groupBy(stratum).agg(F.count_if(F.col(positive)).alias("n_positive"), F.count_if(~F.col(positive)).alias("n_zero"))
    return d.select(stratum, "n_positive", "n_zero", F.lit(ratio).cast("long").alias("requested_ratio"), F.try_divide("n_zero", "n_positive").alias("achieved_ratio"), (F.col("n_zero") < ratio * F.col("n_positive")).alias("saturated"))


def concordance_summary(people: DataFrame, least_joint: int, least_concordance: float) -> DataFrame:
    """One row over people (n_joint, concordance; null where nothing is called in both): n, range and median of both, and n_below a floor of either."""
    low = (F.col("n_joint") < least_joint) | F.col("concordance").isNull() | (F.col("concordance") < least_concordance)
    three = lambda c: (F.min(c).alias(f"{c}_min"), F.median(c).alias(f"{c}_median"), F.max(c).alias(f"{c}_max"))
    return people.agg(F.count("*").alias("n"), *three("n_joint"), *three("concordance"), F.count_if(low).alias("n_below"))
