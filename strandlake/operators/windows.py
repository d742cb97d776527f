"""Window operators along positions: sliding windows, tracts, distances, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut
from .axis import SIZE, with_before, with_island, with_neighbours, with_ordinal
from .intervals import interpolate
from .pairs import PAIR, chains, segment_carriers, shared_pairs


def sharing_windows(carriers: DataFrame, size: int, step: int, top: int) -> DataFrame:
    """chrom, start, n_pairs, mean_jaccard, max_jaccard, top_pairs of bp windows from each chromosome's first position.

    Windows without sharing pairs are left out. top_pairs lists the best pairs by Jaccard index
    (ties by ids), with '+N more' behind them. People bring their counts of a window to where
    they meet, so a pair's site is shuffled once, to its window.
    """
    first = carriers.groupBy("chrom").agg(F.min("pos").alias("p0"))
    off = F.col("pos") - F.col("p0")
    lowest, highest = F.greatest(F.lit(0), F.floor((off - size) / step) + 1), F.floor(off / step)
    start = F.explode(F.transform(F.sequence(lowest, highest), lambda k: F.col("p0") + k * step)).alias("start")
    d = carriers.join(F.broadcast(first), "chrom").filter(lowest <= highest).select("sample_id", "chrom", "pos", start)
    d = d.withColumn("c", F.count("*").over(Window.partitionBy("chrom", "start", "sample_id")))
    a, b = (d.select("chrom", "start", "pos", F.col("sample_id").alias(f"sample_{x}"), F.col("c").alias(f"c{x}")) for x in "ab")
    met = a.join(b, ["chrom", "start", "pos"]).filter("sample_a < sample_b").select("chrom", "start", *PAIR, (F.col("ca") + F.col("cb")).alias("c"))
    j = met.repartition("chrom", "start").groupBy("chrom", "start", *PAIR).agg(F.count("*").alias("n"), F.max("c").alias("c"))
    j = j.withColumn("jaccard", F.col("n") / (F.col("c") - F.col("n")))
    rank = F.row_number().over(Window.partitionBy("chrom", "start").orderBy(F.desc("jaccard"), *PAIR))
    j = j.withColumn("rank", rank)
    name = F.when(F.col("rank") <= top, F.struct("rank", F.concat_ws("-", "sample_a", "sample_b").alias("name")))
    g = j.groupBy("chrom", "start").agg(F.count("*").alias("n_pairs"), F.avg("jaccard").alias("mean_jaccard"), F.max("jaccard").alias("max_jaccard"), F.array_sort(F.collect_list(name)).alias("names"))
    text = F.array_join(F.transform("names", lambda x: x["name"]), ",")
    more = F.when(F.col("n_pairs") > top, F.concat(text, F.lit(",+"), F.col("n_pairs") - top, F.lit(" more"))).otherwise(text)
    return g.select("chrom", "start", "n_pairs", "mean_jaccard", "max_jaccard", more.alias("top_pairs"))


def snp_windows(positions: DataFrame, keys: list[str], width: int, step: int, size: int = SIZE) -> DataFrame:
    """Windows of `width` consecutive positions, every `step`-th: window_id, start, end, per_mb."""
    d = with_ordinal(positions.select(*keys, "pos"), keys, size=size)
    end = d.select(*keys, (F.col("_ordinal") - (width - 1)).alias("_ordinal"), F.col("pos").alias("end"))
    d = d.filter(F.col("_ordinal") % step == 0).join(end, [*keys, "_ordinal"])
    return d.select(*keys, (F.col("_ordinal") / step).cast("long").alias("window_id"), F.col("pos").alias("start"), "end", (F.lit(width) * 1e6 / (F.col("end") - F.col("pos") + 1)).alias("per_mb"))


def enriched(windows: DataFrame, value: str, percentile: float, by: list[str]) -> DataFrame:
    """Windows at or above the percentile of their scope (by: [] for all)."""
    cutoff = windows.groupBy(*by).agg(F.percentile(value, F.lit(percentile)).alias("cutoff"))
    j = windows.join(broadcast_if_small(cut(cutoff)), by) if by else windows.crossJoin(F.broadcast(cutoff))
    return j.filter(F.col(value) >= F.col("cutoff")).drop("cutoff")


def tracts(windows: DataFrame, keys: list[str], gap: int, curve: DataFrame | None = None) -> DataFrame:
    """Enriched windows whose ids differ by up to gap + 1 merge: start, end, n_windows, mean_score, windows a Mb, and with a genetic map (keys, pos, cm) length_cm (null where an end is off the map)."""
    d = with_island(windows, keys, gap + 1, "window_id")
    d = d.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_windows"), F.avg("per_mb").alias("mean_score")).drop("_island")
    d = d.withColumn("density", F.col("n_windows") * 1e6 / (F.col("end") - F.col("start") + 1))
    if curve is None:
        return d
    for end in ("start", "end"):
        d = interpolate(d.withColumnRenamed(end, "pos"), curve.withColumnRenamed("cm", f"_{end}_cm"), keys, "pos", f"_{end}_cm", SIZE).withColumnRenamed("pos", end)
    return d.withColumn("length_cm", F.col("_end_cm") - F.col("_start_cm")).drop("_start_cm", "_end_cm")


def grid_features(genotypes: DataFrame, people: DataFrame, size: int, lengths: DataFrame | None = None, factor: int = 1, phase: int = 0) -> DataFrame:
    """Every person and window of a fixed grid: called and missing sites, carried sites, dosage, dosage a called site (null for none).

    Windows are those that hold any site; people without genotypes there have zeros. With
    lengths (chrom, length) windows are all that a chromosome has, empty ones included, the
    last one cut at its end, and there are bp (the window's own length) and variance
    (population variance of the called dosages, null for none). With a factor (not with
    lengths), windows are joined as by regrid(), before the grid is filled in.

    Sums are gathered by person and chromosome, and the windows, which are broadcast, are
    filled in last: what is shuffled are carried cells, not the grid.
    """
    x = F.col("dosage")
    d = genotypes.withColumn("window_id", F.floor((F.col("pos") - 1) / size))
    if factor > 1 or phase:
        if lengths is not None:
            raise ValueError("windows of whole chromosomes are joined by regrid()")
        d = d.withColumn("window_id", F.floor((F.col("window_id") + phase) / factor))
    sums = [F.count(x).alias("n_called"), F.count_if(x.isNull()).alias("n_missing"), F.count_if(x > 0).alias("n_carried"), F.coalesce(F.sum(x), F.lit(0)).alias("dosage_sum"), F.coalesce(F.sum(x * x), F.lit(0)).alias("_squares")]
    f = d.groupBy("sample_id", "chrom", "window_id").agg(*sums)
    cell = F.struct("n_called", "n_missing", "n_carried", "dosage_sum", "_squares")
    f = f.groupBy("sample_id", "chrom").agg(F.map_from_entries(F.collect_list(F.struct("window_id", cell))).alias("_cells"))
    if lengths is None:
        held = d.select("chrom", "window_id").distinct().withColumn("bp", F.lit(None).cast("long"))
    else:
        start = lambda w: w * size
        ws = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("window_id")
        held = lengths.filter("length > 0").select("chrom", "length", ws)
        held = held.select("chrom", "window_id", F.least(F.lit(size).cast("long"), F.col("length") - start(F.col("window_id"))).alias("bp"))
    held = cut(held)
    rows = people.crossJoin(F.broadcast(held.select("chrom").distinct())).join(f, ["sample_id", "chrom"], "left")  # a row a person and chromosome
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n_called", "n_missing", "n_carried", "dosage_sum", "_squares")])
    rows = rows.join(broadcast_if_small(held, 5_000_000), "chrom")
    rows = rows.select("sample_id", "chrom", "window_id", "bp", F.coalesce(F.try_element_at("_cells", F.col("window_id")), none).alias("_c"))
    rows = rows.select("sample_id", "chrom", "window_id", "bp", "_c.*").withColumn("rate", F.try_divide("dosage_sum", "n_called"))
    if lengths is None:
        return rows.drop("bp", "_squares")
    variance = F.when(F.col("n_called") > 0, F.greatest(F.lit(0.0), F.try_divide("_squares", "n_called") - F.col("rate") * F.col("rate")))
    return rows.withColumn("variance", variance).drop("_squares")


def regrid(features: DataFrame, factor: int, phase: int) -> DataFrame:
    """Windows joined `factor` at a time, the first boundary shifted by `phase` windows."""
    wide = F.floor((F.col("window_id") + phase) / factor)
    d = features.groupBy("sample_id", "chrom", wide.alias("window_id")).agg(*[F.sum(c).alias(c) for c in ("n_called", "n_missing", "n_carried", "dosage_sum")])
    return d.withColumn("rate", F.try_divide("dosage_sum", "n_called"))


def equal_site_windows(positions: DataFrame, keys: list[str], target: int, size: int = SIZE) -> DataFrame:
    """window_id, start, end, n of windows of `target` consecutive positions; a last one of under half joins the one before."""
    d = with_ordinal(positions.select(*keys, "pos"), keys, size=size)
    n = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    last = F.floor((F.col("_n") - 1) / target)
    short = (F.col("_n") - last * target < target / 2) & (last > 0)
    window = F.least(F.floor(F.col("_ordinal") / target), last - F.when(short, 1).otherwise(0))
    return d.join(n, keys).groupBy(*keys, window.alias("window_id")).agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"))


def distances_within(positions: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Distances of all pairs of positions of a key up to `most` apart, by a band join of buckets of that width."""
    b = F.floor(F.col("pos") / most)
    a = positions.select(*keys, F.col("pos").alias("_p"), F.explode(F.array(b, b + 1)).alias("_b"))
    c = positions.select(*keys, F.col("pos").alias("_q"), b.alias("_b"))
    j = a.join(c, [*keys, "_b"]).select(*keys, (F.col("_q") - F.col("_p")).alias("distance"))
    return j.filter((F.col("distance") > 0) & (F.col("distance") <= most))


def distance_moments(distances: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, population deviation and geometric mean of distances."""
    return distances.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("sd"), F.exp(F.avg(F.log("distance"))).alias("geometric_mean"))


def histogram_quantile(histogram: DataFrame, keys: list[str], low: float, high: float, bins: int, q: float) -> DataFrame:
    """keys, value: the q quantile of log10 bins (bin, n), interpolated inside its bin."""
    w = Window.partitionBy(*keys).orderBy("bin")
    d = histogram.withColumns({"_c": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum("n").over(Window.partitionBy(*keys))})
    aim, width = q * F.col("_t"), (high - low) / bins
    hit = d.filter((F.col("_c") >= aim) & (F.col("_c") - F.col("n") < aim))
    return hit.select(*keys, F.pow(F.lit(10.0), low + width * (F.col("bin") + (aim - F.col("_c") + F.col("n")) / F.col("n"))).alias("value"))


def nearest_distances(positions: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Distances to the next 1 to k positions of the same key."""
    d = with_ordinal(positions.select(*keys, "pos"), keys)
    near = d.select(*keys, "pos", F.explode(F.sequence(F.col("_ordinal") + 1, F.col("_ordinal") + k)).alias("_ordinal"))
    later = d.select(*keys, F.col("pos").alias("_later"), "_ordinal")
    return near.join(later, [*keys, "_ordinal"]).select(*keys, (F.col("_later") - F.col("pos")).alias("distance"))


def log_histogram(distances: DataFrame, keys: list[str], low: float, high: float, bins: int) -> DataFrame:
    """Counts by log10 bins in [low, high), with what lies beyond clipped into the end bins and counted as under and over."""
    v = F.log10("distance")
    raw = F.floor((v - low) / ((high - low) / bins))
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw)).cast("long")
    return distances.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.count_if(v < low).alias("n_under"), F.count_if(v >= high).alias("n_over"))


def gap_stats(positions: DataFrame, keys: list[str], universe: str, size: int | None = SIZE) -> DataFrame:
    """n, mean and median gap of neighbouring positions within keys, all keys together. With size None a key's positions are few and stay together, shuffled once."""
    if size is None:
        d = positions.withColumn("_before", F.lag("pos").over(Window.partitionBy(*keys).orderBy("pos")))
    else:
        d = with_before(positions, keys, size=size)
    d = d.select((F.col("pos") - F.col("_before")).alias("gap")).filter("gap is not null")
    return d.agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), F.max("gap").alias("max_gap")).select(F.lit(universe).alias("universe"), "*")


def geometric_sites(length: int, gap: int) -> int:
    """Fewest sites that a chain of `length` bp with gaps up to `gap` can have."""
    return 1 + -(-(length - 1) // gap) if length > 1 else 1


def sweep_classes(carriers: DataFrame, gaps: list[int], lengths: list[int], sites: list[int]) -> tuple[DataFrame, DataFrame]:
    """(results, aliases) of a grid whose configurations of equal effect are evaluated once.

    A chain of so many bp with gaps so short has a least number of sites anyhow, so what
    counts is the greater of that and the nominal number. results: max_gap, min_length,
    effective_sites, n_segments, n_pairs, total_bp. aliases: max_gap, min_length, min_sites
    (nominal), geometric_sites, effective_sites, a row for every nominal configuration.
    """
    grid = [(g, n, m, geometric_sites(n, g)) for g in sorted(set(gaps)) for n in sorted(set(lengths)) for m in sorted(set(sites))]
    if min(*gaps, *lengths, *sites) < 1:
        raise ValueError("gaps, lengths and sites are positive")
    spark = carriers.sparkSession
    aliases = spark.createDataFrame([(*x, max(x[2:])) for x in grid], "max_gap long, min_length long, min_sites long, geometric_sites long, effective_sites long")
    classes = aliases.select("max_gap", "min_length", "effective_sites").distinct()
    least = min(max(x[2:]) for x in grid)
    shared, made = cut(shared_pairs(segment_carriers(carriers, max(gaps), least, min(lengths)), least)), None
    for gap in sorted(set(gaps)):
        part = chains(shared, gap, [*PAIR, "chrom"]).withColumn("max_gap", F.lit(gap).cast("long"))
        made = part if made is None else made.unionByName(part)
    hit = made.join(F.broadcast(classes), "max_gap").filter((F.col("length_bp") >= F.col("min_length")) & (F.col("n_shared_variants") >= F.col("effective_sites")))
    keys = ["max_gap", "min_length", "effective_sites"]
    found = hit.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.countDistinct(*PAIR).alias("n_pairs"), F.sum("length_bp").alias("total_bp"))
    return F.broadcast(classes).join(found, keys, "left").na.fill(0), aliases


def segment_sweep(carriers: DataFrame, gaps: list[int], lengths: list[int], sites: list[int]) -> DataFrame:
    """n_segments, n_pairs, total_bp of every configuration; chains are made once a gap."""
    spark = carriers.sparkSession
    shared, made = cut(shared_pairs(segment_carriers(carriers, max(gaps), min(sites), min(lengths)), min(sites))), None
    for gap in gaps:
        part = chains(shared, gap, [*PAIR, "chrom"]).withColumn("max_gap", F.lit(gap).cast("long"))
        made = part if made is None else made.unionByName(part)
    grid = F.broadcast(spark.createDataFrame([(g, n, m) for g in gaps for n in lengths for m in sites], "max_gap long, min_length long, min_sites long"))
    hit = made.join(grid, "max_gap").filter((F.col("length_bp") >= F.col("min_length")) & (F.col("n_shared_variants") >= F.col("min_sites")))
    found = hit.groupBy("max_gap", "min_length", "min_sites").agg(F.count("*").alias("n_segments"), F.countDistinct(*PAIR).alias("n_pairs"), F.sum("length_bp").alias("total_bp"))
    return grid.join(found, ["max_gap", "min_length", "min_sites"], "left").na.fill(0)


def radius_counts(queries: DataFrame, events: DataFrame, keys: list[str], radius: int, size: int = SIZE) -> DataFrame:
    """queries (pos) with n_events: events (pos) of the same key within the radius on either side.

    Events go to every bucket that their radius touches; queries to their own.
    """
    reach = F.sequence(F.floor((F.col("pos") - radius) / size), F.floor((F.col("pos") + radius) / size))
    e = events.select(*keys, "pos", F.lit(None).cast("long").alias("id"), F.lit(1).alias("e"), F.explode(reach).alias("_b"))
    u = queries.select(*keys, "pos", "id", F.lit(0).alias("e"), F.floor(F.col("pos") / size).alias("_b")).unionByName(e)
    w = Window.partitionBy(*keys, "_b").orderBy("pos").rangeBetween(-radius, radius)
    return u.withColumn("n_events", F.sum("e").over(w)).filter("id is not null").select("id", *keys, "pos", "n_events")


def voronoi(positions: DataFrame, keys: list[str]) -> DataFrame:
    """cell_lo, cell_hi of each position: up to the midpoints to its neighbours, ties to the left one; ends stay open (null)."""
    d = with_neighbours(positions.select(*keys, "pos"), keys, "pos", "pos")
    return d.select(*keys, "pos", (F.floor((F.col("_before") + F.col("pos")) / 2) + 1).alias("cell_lo"), F.floor((F.col("pos") + F.col("_after")) / 2).alias("cell_hi"))


def map_weights(markers: DataFrame, keys: list[str], cm: str = "cm", size: float = 1.0) -> DataFrame:
    """markers with weight: the map length nearer to each than to any other of its key, within the first and last marker.

    Markers at one place on the map share nothing: all but the outer ones weigh 0. A key of
    markers at one place has weights 0 throughout. Neighbours are found across buckets of
    `size` cM in both directions.
    """
    d = with_neighbours(markers, keys, cm, cm, size)
    own = F.col(cm)
    return d.withColumn("weight", (F.coalesce("_after", own) - F.coalesce("_before", own)) / 2).drop("_before", "_after")


def marker_windows(positions: DataFrame, keys: list[str], size: int, max_gap: int) -> DataFrame:
    """Runs of up to `size` markers by ordinal, broken at gaps above max_gap: window, start, end, n."""
    d = with_island(with_ordinal(positions, keys), keys, max_gap, value="_ordinal")
    number = F.floor((F.col("_ordinal") - F.col("_island")) / size)
    return d.groupBy(*keys, "_island", number.alias("_w")).agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n")).drop("_island", "_w")
