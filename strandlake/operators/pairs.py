"""Pair operators: shared carriers, chains, summaries and joint-call evidence.

Pairs are unordered with sample_a < sample_b. Ratios are taken last, from summed counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..plans.lineage import stored

SITE = ["chrom", "pos"]
PAIR = ["sample_a", "sample_b"]
#: Meetings of two people at a site that one task counts by pair; people of a site that one list names, about.
MEETINGS, LISTED = 1 << 19, 256


def shared_pairs(carriers: DataFrame, min_shared: int = 1) -> DataFrame:
    """sample_a, sample_b, chrom, pos of each site that both carry; with min_shared, of pairs sharing so many on a chromosome.

    The pair join is an equi-join on the site, of which AQE splits heavily carried ones. The
    count runs over the same exchange by pair and chromosome that chains() works on.
    """
    a = carriers.select(F.col("sample_id").alias("sample_a"), *SITE)
    b = carriers.select(F.col("sample_id").alias("sample_b"), *SITE)
    out = a.join(b, SITE).filter("sample_a < sample_b").select(*PAIR, *SITE)
    if min_shared > 1:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy(*PAIR, "chrom"))).filter(F.col("_n") >= min_shared).drop("_n")
    return out


def segment_carriers(carriers: DataFrame, max_gap: int, min_sites: int, min_length: int = 0) -> DataFrame:
    """carriers where a pair's segment can be: in a person's own run, over gaps up to max_gap, of enough sites and length. A person's site that repeats counts once.

    Sites that follow each other in a pair's chain are in one run of either person, so no
    segment is lost or cut, and only what is kept meets other people.
    """
    w = Window.partitionBy("sample_id", "chrom").orderBy("pos")
    d = carriers.select("sample_id", *SITE).withColumn("_step", F.col("pos") - F.lag("pos").over(w)).filter("_step is null or _step > 0")
    d = d.withColumn("_run", F.count_if(F.col("_step") > max_gap).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("sample_id", "chrom", "_run")
    d = d.withColumns({"_n": F.count("*").over(run), "_length": F.max("pos").over(run) - F.min("pos").over(run) + 1})
    return d.filter((F.col("_n") >= min_sites) & (F.col("_length") >= min_length)).select("sample_id", *SITE)


def chains(shared: DataFrame, max_gap: int, keys: list[str], min_length: int = 0, min_sites: int = 1) -> DataFrame:
    """Maximal runs of positions with gaps up to max_gap: start_pos, end_pos, length_bp (inclusive), n_shared_variants."""
    w = Window.partitionBy(*keys).orderBy("pos")
    d = shared.withColumn("_new", F.when(F.col("pos") - F.lag("pos").over(w) > max_gap, 1).otherwise(0))
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = d.groupBy(*keys, "_island").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("n_shared_variants"))
    out = out.withColumn("length_bp", F.col("end_pos") - F.col("start_pos") + 1).drop("_island")
    return out.filter((F.col("length_bp") >= min_length) & (F.col("n_shared_variants") >= min_sites))


def pair_segments(carriers: DataFrame, max_gap: int, min_sites: int, min_length: int = 0) -> DataFrame:
    """Segments that pairs share; jaccard is the constant 1.0 of this format.

    Pairs with fewer sites than a segment needs fall with their chains: a pair's positions are
    shuffled once, and only those in runs of both people.
    """
    found = chains(shared_pairs(segment_carriers(carriers, max_gap, min_sites, min_length)), max_gap, [*PAIR, "chrom"], min_length, min_sites)
    return found.withColumn("jaccard", F.lit(1.0))


def pair_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*PAIR).agg(
        F.count("*").alias("n_segments"), F.sum("length_bp").alias("total_shared_bp"), F.countDistinct("chrom").alias("n_chromosomes"),
        F.sum("n_shared_variants").alias("n_shared_variants_total"), F.max("length_bp").alias("max_segment_bp"),
    )


def individual_summary(segments: DataFrame) -> DataFrame:
    """Per person: distinct partners, segments, bp, chromosomes with sharing."""
    both = segments.select("*", F.explode(F.array(F.struct(F.col("sample_a").alias("id"), F.col("sample_b").alias("other")), F.struct(F.col("sample_b").alias("id"), F.col("sample_a").alias("other")))).alias("e"))
    return both.groupBy(F.col("e.id").alias("sample_id")).agg(
        F.countDistinct("e.other").alias("n_sharing_partners"), F.count("*").alias("n_segments_involved"), F.sum("length_bp").alias("total_shared_bp"), F.countDistinct("chrom").alias("n_chromosomes_with_sharing"),
    )


def top_pairs(summary: DataFrame, k: int) -> DataFrame:
    """The k pairs of the most shared bp, ties by the pair's ids."""
    return summary.orderBy(F.desc("total_shared_bp"), *PAIR).limit(k)


def weighted_pairs(segments: DataFrame, weight: str, a: str, b: str) -> DataFrame:
    """Unordered pairs with the sum, count and maximum of a weight."""
    d = segments.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("sample_a"), F.greatest(a, b).alias("sample_b"), weight)
    return d.groupBy(*PAIR).agg(F.sum(weight).alias("total"), F.count("*").alias("n"), F.max(weight).alias("longest"))


def meetings(cells: DataFrame, values: list[str], listed: int, each: int, by: tuple[str, ...] = ()) -> DataFrame:
    """sample_a, sample_b, `by` and the values of both (as v_a and v_b) for each site where two people meet, dealt by sample_a.

    cells: a stored table of sample_id, chrom, pos and the values, a row a person and site.
    `by` are columns of the site. Whom a person meets at a site travels as one row of lists,
    whole numbers in the narrowest type that holds them all. Lists of `listed` people cut
    long ones, and parts are as many as `each` meetings ask for.
    """
    columns, cells = ["sample_id", *values], cells.filter("chrom is not null and pos is not null")
    whole = [c for c in columns if isinstance(cells.schema[c].dataType, IntegralType)]
    n = cells.groupBy(*SITE).agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in whole for f in (F.min, F.max)])
    met = n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("all"), F.max("n").alias("most"), *[f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for c in whole for f in (F.min, F.max)]).first().asDict()
    kind = {c: cells.schema[c].dataType.simpleString() for c in columns}
    small = kind | {c: next((t for t, bits in (("byte", 7), ("short", 15), ("int", 31)) if -(1 << bits) <= met[f"min_{c}"] and met[f"max_{c}"] < 1 << bits), kind[c]) for c in whole if met[f"max_{c}"] is not None}
    lists, parts = (max(1, -(-int(met[k] or 0) // size)) for k, size in (("most", listed), ("all", each)))
    named = F.array_sort(F.collect_list(F.struct(*columns))).alias("_l")
    if lists == 1:  # a site's people are one list, in which each meets those behind
        j = cells.groupBy(*SITE).agg(named).select(*SITE, "_l", F.posexplode("_l").alias("_i", "_a"))
        j = j.select(*by, "_a.*", F.slice("_l", F.col("_i") + 2, F.size("_l")).alias("_l"))
    else:
        b = cells.groupBy(*SITE, F.pmod(F.xxhash64("sample_id"), F.lit(lists)).alias("_list")).agg(named)
        j = cells.join(b, SITE)
    j = j.withColumn("_l", F.filter("_l", lambda x: x["sample_id"] > F.col("sample_id")))
    to = lambda c: F.transform("_l", lambda x: x[c].cast(small[c])).alias(f"{c}_b")
    j = j.filter(F.size("_l") > 0).select(*by, F.col("sample_id").alias("sample_a"), *[F.col(c).cast(small[c]).alias(f"{c}_a") for c in values], *[to(c) for c in columns]).repartition(parts, "sample_a")
    j = j.select(*by, "sample_a", *[f"{c}_a" for c in values], F.posexplode("sample_id_b").alias("_i", "sample_b"), *[F.col(f"{c}_b").alias(f"_{c}") for c in values])
    return j.select("sample_a", F.col("sample_b").cast(kind["sample_id"]).alias("sample_b"), *by, *[x.cast(kind[c]).alias(f"{c}_{k}") for c in values for k, x in (("a", F.col(f"{c}_a")), ("b", F.get(f"_{c}", "_i")))])


def pair_evidence(genotypes: DataFrame) -> DataFrame:
    """Joint-call evidence of all pairs with a site that both carry or that one or both miss.

    n_both: both carry; n_either: either carries, at sites called in both; n_called: sites
    called in both. Genotypes are sparse: a stored null is missing, what isn't stored is
    called without the allele. Pairs meet at stored sites only; the rest follows from each
    person's own counts and the number of sites.
    """
    g, w = stored(genotypes), Window.partitionBy("sample_id")
    sites = g.select(*SITE).distinct().agg(F.count("*").alias("sites"))
    g = g.withColumns({"c": F.count_if(F.col("dosage") > 0).over(w), "m": F.count_if(F.col("dosage").isNull()).over(w), "blank": F.col("dosage").isNull().cast("int")})
    g = stored(g.filter("dosage is null or dosage > 0").select("sample_id", *SITE, "blank", "c", "m"))
    d = meetings(g, ["blank", "c", "m"], LISTED, MEETINGS)
    blank = F.col("blank_a") + F.col("blank_b")
    d = d.groupBy(*PAIR).agg(*[F.count_if(blank == k).alias(n) for k, n in enumerate(("n_both", "n_lost", "n_blank"))], *[F.max(F.col(f"{c}_a") + F.col(f"{c}_b")).alias(f"_{c}") for c in "cm"]).crossJoin(F.broadcast(sites))
    return d.select(*PAIR, "n_both", (F.col("_c") - F.col("n_lost") - F.col("n_both")).alias("n_either"), (F.col("sites") - F.col("_m") + F.col("n_blank")).alias("n_called"))


def masked_jaccard(evidence: DataFrame) -> DataFrame:
    """Counts summed over parts first, then one ratio; null where nobody carries."""
    d = evidence.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in ("n_both", "n_either", "n_called")])
    return d.withColumn("jaccard", F.try_divide("n_both", "n_either"))


def dyad_universe(groups: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """possible (n(n-1)/2), observed and unknown pairs of each group; what wasn't observed is unknown, not zero."""
    d = groups.groupBy(key).agg(F.count("*").alias("n")).withColumn("possible", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    o = observed.groupBy(key).agg(F.count("*").alias("observed"))
    d = d.join(o, key, "left").na.fill(0, ["observed"])
    return d.withColumn("unknown", F.col("possible") - F.col("observed"))


def pair_universe(nodes: DataFrame, values: DataFrame, value: str, within: list[str], parts: int = 16) -> DataFrame:
    """All pairs of nodes of the same group (columns `within`) with their value; absent ones stay null.

    The pairs are as many as the squares of the groups' sizes, so they aren't shuffled: each
    node brings the values of its own pairs to the join of the groups, which is spread by
    `parts` of one side.
    """
    a, b = (nodes.select(*within, F.col("sample_id").alias(f"sample_{x}")) for x in "ab")
    inside = values.select(*PAIR, value).join(a, "sample_a").join(b, ["sample_b", *within], "left_semi").select(*PAIR, value).distinct()
    known = inside.groupBy("sample_a").agg(F.map_from_entries(F.collect_list(F.struct("sample_b", value))).alias("_known"))
    a = a.join(known, "sample_a", "left").withColumn("_part", F.pmod(F.xxhash64("sample_a"), F.lit(parts)))
    b = b.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    j = a.join(b, [*within, "_part"]).filter("sample_a < sample_b")
    return j.select(*within, *PAIR, F.try_element_at("_known", F.col("sample_b")).alias(value))


def king_robust(genotypes: DataFrame) -> DataFrame:
    """KING-robust kinship of pairs with jointly called heterozygous sites.

    (het-het - 2 * opposite homozygotes) / (het_a + het_b), over sites called in both.
    """
    g = stored(genotypes.filter("dosage is not null").select("sample_id", *SITE, "dosage"))
    j, x, y = meetings(g, ["dosage"], LISTED, MEETINGS), F.col("dosage_a"), F.col("dosage_b")
    d = j.groupBy(*PAIR).agg(
        F.count_if((x == 1) & (y == 1)).alias("n_het_het"), F.count_if(F.abs(x - y) == 2).alias("n_ibs0"),
        F.count_if(x == 1).alias("n_het_a"), F.count_if(y == 1).alias("n_het_b"), F.count("*").alias("n_called"),
    )
    return d.withColumn("kinship", F.try_divide(F.col("n_het_het") - 2 * F.col("n_ibs0"), F.col("n_het_a") + F.col("n_het_b")))


def pair_gram(genotypes: DataFrame, *by: str) -> DataFrame:
    """Sums of dosage products of pairs over sites (of each `by`, such as the chromosome), as integers; absent pairs are zero."""
    g = genotypes.filter("dosage > 0")
    a = g.select(F.col("sample_id").alias("sample_a"), *SITE, F.col("dosage").alias("x"))
    b = g.select(F.col("sample_id").alias("sample_b"), *SITE, F.col("dosage").alias("y"))
    return a.join(b, SITE).filter("sample_a <= sample_b").groupBy(*by, *PAIR).agg(F.sum(F.col("x") * F.col("y")).alias("gram"))


def dose_bands(df: DataFrame, dose: str, ancestry: str) -> DataFrame:
    """Bounds of copies of an allele on an ancestry given both doses (0 to 2): L = max(0, d + a - 2), U = min(d, a)."""
    d, a = F.col(dose), F.col(ancestry)
    low, high = F.greatest(F.lit(0), d + a - 2), F.least(d, a)
    state = F.when(d.isNull() & a.isNull(), "MISSING_BOTH").when(d.isNull(), "MISSING_GT").when(a.isNull(), "MISSING_ANCESTRY").when(low == high, "EXACT").otherwise("BAND")
    known = d.isNotNull() & a.isNotNull()
    return df.withColumns({"low": F.when(known, low), "high": F.when(known, high), "state": state})


def close_then_filter(segments: DataFrame, thresholds: DataFrame, config: str) -> DataFrame:
    """Each pair summed over all chromosomes first, then judged by each threshold (min_bp): pairs and bp left."""
    d = segments.groupBy(config, *PAIR).agg(F.sum("length_bp").alias("bp"))
    j = d.crossJoin(F.broadcast(thresholds)).filter(F.col("bp") >= F.col("min_bp"))
    return j.groupBy(config, "min_bp").agg(F.count("*").alias("n_pairs"), F.sum("bp").alias("total_bp"))


def kin_partition(pairs: DataFrame, kinship: DataFrame, threshold: float, measure: str) -> DataFrame:
    """Pairs and a measure by kinship: related, unrelated, missing. The parts add up to the whole."""
    d = pairs.join(kinship.select(*PAIR, "kin"), PAIR, "left")
    relation = F.when(F.col("kin").isNull(), "missing").when(F.col("kin") >= threshold, "related").otherwise("unrelated")
    return d.groupBy(relation.alias("relation")).agg(F.count("*").alias("n_pairs"), F.sum(measure).alias(measure))
