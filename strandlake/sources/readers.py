"""Readers of text formats into typed tables. Every schema is given, none is inferred.

Files are read with spark.read.text, so any file system that Spark knows will do. A gzip
file is one task; the reader deals its lines out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import CHROMOSOMES, plain_chrom


def _fields(spark: SparkSession, path: str, pattern: str = r"\s+") -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), pattern).alias("f"), F.col("_metadata.file_path").alias("file"))


def _f(k: int) -> Column:
    return F.get("f", F.lit(k))


def read_vcf(spark: SparkSession, glob: str, partitions: int | None = None) -> DataFrame:
    """One row a record: chrom, pos, ref, alts, filters, info map, samples array<struct<a0, a1, phased>>, sample_ids.

    Files without a recognised chromosome in their lines give no rows. The header's sample
    names come from each file's own #CHROM line. partitions: deal lines out after reading.
    """
    lines = spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("file"))
    head = lines.filter(F.col("value").startswith("#CHROM")).select("file", F.slice(F.split("value", "\t"), 10, 1_000_000).alias("sample_ids"))
    body = lines.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    if partitions:
        body = body.repartition(partitions)
    d = body.select("file", F.split("value", "\t").alias("f")).join(F.broadcast(head), "file")
    info = F.when(_f(7) != ".", F.map_from_entries(F.transform(F.split(_f(7), ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("true").alias("v")))))
    gt_place = F.array_position(F.split(F.coalesce(_f(8), F.lit("")), ":"), "GT")

    def call(x: Column) -> Column:
        gt = F.get(F.split(x, ":"), (gt_place - 1).cast("int"))
        allele = lambda k: F.get(F.split(gt, "[/|]"), F.lit(k)).try_cast("tinyint")
        return F.struct(allele(0).alias("a0"), allele(1).alias("a1"), gt.contains("|").alias("phased"))

    chrom = plain_chrom(_f(0))
    return d.filter(chrom.isin(CHROMOSOMES)).select(
        chrom.alias("chrom"), _f(1).cast("long").alias("pos"), F.upper(_f(3)).alias("ref"), F.split(F.upper(_f(4)), ",").alias("alts"), F.split(_f(6), ";").alias("filters"),
        info.alias("info"), F.transform(F.slice("f", 10, 1_000_000), call).alias("samples"), "sample_ids",
    )


def long_genotypes(vcf: DataFrame) -> DataFrame:
    """One row a record and person: a0, a1, phased, and dosage, null where any allele is missing."""
    d = vcf.select("chrom", "pos", "ref", "alts", F.posexplode("samples").alias("k", "g"), "sample_ids")
    dosage = (F.col("g.a0") > 0).cast("long") + (F.col("g.a1") > 0).cast("long")
    return d.select("chrom", "pos", "ref", "alts", F.get("sample_ids", F.col("k")).alias("sample_id"), "g.a0", "g.a1", "g.phased", dosage.alias("dosage"))


def scan(df: DataFrame, chrom: str, lo: int, hi: int) -> DataFrame:
    """Records of a region, ends included; on a table partitioned by chrom and sorted by pos only that region is read."""
    return df.filter((F.col("chrom") == chrom) & F.col("pos").between(lo, hi))


def project_samples(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the listed people (ids: sample_id) only."""
    return df.join(ids.select("sample_id").distinct(), "sample_id", "left_semi")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, lo, hi, closed and 1-based; headers and short lines are skipped."""
    d = _fields(spark, path).filter(~_f(0).rlike("^(#|track|browser)") & (F.size("f") >= 3))
    return d.select(plain_chrom(_f(0)).alias("chrom"), (_f(1).try_cast("long") + 1).alias("lo"), _f(2).try_cast("long").alias("hi")).filter("lo is not null and hi >= lo")


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """Local-ancestry painting: chrom, spos, epos, sample_id, hap, code, one row a segment and haplotype.

    The first line (the code legend) is skipped; columns from the seventh on are haplotypes '<id>.0' and '<id>.1'.
    """
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.col("_metadata.file_path").alias("file"))
    is_head = _f(0).isin("#chm", "chm")
    head = lines.filter(is_head).select("file", F.slice("f", 7, 1_000_000).alias("haps"))
    body = lines.filter(~is_head & ~_f(0).startswith("#")).join(F.broadcast(head), "file")
    d = body.select(plain_chrom(_f(0)).alias("chrom"), _f(1).cast("long").alias("spos"), _f(2).cast("long").alias("epos"), F.posexplode(F.slice("f", 7, 1_000_000)).alias("k", "code"), "haps")
    hap = F.get("haps", F.col("k"))
    return d.select("chrom", "spos", "epos", F.regexp_replace(hap, r"\.[01]$", "").alias("sample_id"), F.regexp_extract(hap, r"\.([01])$", 1).try_cast("int").alias("hap"), F.col("code").try_cast("int").alias("code"))


def read_ibd(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """sample_a, sample_b (in order), cm: ids in fields 1 and 3, cM in field 8; short, non-numeric, self and unknown lines are skipped."""
    d = _fields(spark, path).filter(F.size("f") >= 8).select(_f(0).alias("x"), _f(2).alias("y"), _f(7).try_cast("double").alias("cm")).filter("cm is not null and x <> y")
    if known is not None:
        ids = known.select("sample_id").distinct()
        d = d.join(ids.withColumnRenamed("sample_id", "x"), "x", "left_semi").join(ids.withColumnRenamed("sample_id", "y"), "y", "left_semi")
    return d.select(F.least("x", "y").alias("sample_a"), F.greatest("x", "y").alias("sample_b"), "cm")


def read_refined_ibd(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, inventory): 9 columns id1 hap1 id2 hap2 chrom start end lod cm.

    Segments have haplotypes 1 or 2, no self pair, start up to end, finite LOD and cM.
    inventory: lines, valid ones and distinct valid ones by file and chromosome.
    """
    d = _fields(spark, path).select(
        "file", F.size("f").alias("width"), _f(0).alias("id1"), _f(1).try_cast("int").alias("hap1"), _f(2).alias("id2"), _f(3).try_cast("int").alias("hap2"), plain_chrom(_f(4)).alias("chrom"),
        _f(5).try_cast("long").alias("start"), _f(6).try_cast("long").alias("end"), _f(7).try_cast("double").alias("lod"), _f(8).try_cast("double").alias("cm"),
    )
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = (F.col("width") == 9) & F.col("hap1").isin(1, 2) & F.col("hap2").isin(1, 2) & (F.col("id1") != F.col("id2")) & (F.col("start") <= F.col("end")) & finite("lod") & finite("cm")
    d = d.withColumn("ok", F.coalesce(ok, F.lit(False)))
    row = F.when(F.col("ok"), F.struct("id1", "hap1", "id2", "hap2", "chrom", "start", "end", "lod", "cm"))
    inventory = d.groupBy("file", "chrom").agg(F.count("*").alias("n_lines"), F.count_if("ok").alias("n_valid"), F.countDistinct(row).alias("n_distinct"))
    return d.filter("ok").drop("ok", "width"), inventory


def extract_ibd_pairs(segments: DataFrame, wanted: DataFrame, min_lod: float = 3.0, min_cm: float = 2.0) -> DataFrame:
    """Segments of listed pairs (sample_a, sample_b) at both floors."""
    d = segments.filter((F.col("lod") >= min_lod) & (F.col("cm") >= min_cm)).withColumns({"sample_a": F.least("id1", "id2"), "sample_b": F.greatest("id1", "id2")})
    return d.join(wanted.select("sample_a", "sample_b").distinct(), ["sample_a", "sample_b"], "left_semi")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, cm of a genetic map with a header of those names; the first row of a repeated position counts.

    A chromosome with under two points, or with falling cM, raises.
    """
    raw = spark.read.csv(path, sep="\t", header=True, schema="chrom string, pos long, cm double").withColumn("_row", F.monotonically_increasing_id())
    d = raw.filter("pos is not null and cm is not null").withColumn("chrom", plain_chrom(F.col("chrom")))
    first = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("_row"))
    d = d.withColumn("_k", first).filter("_k = 1").select("chrom", "pos", "cm")
    w = Window.partitionBy("chrom").orderBy("pos")
    bad = d.withColumn("_fall", F.col("cm") < F.lag("cm").over(w)).groupBy("chrom").agg(F.count("*").alias("n"), F.count_if("_fall").alias("falls")).filter("n < 2 or falls > 0")
    if not bad.isEmpty():
        raise ValueError(f"genetic map: too few points or falling cM on {[r.chrom for r in bad.limit(5).collect()]}")
    return d


def read_kinship(spark: SparkSession, path: str) -> DataFrame:
    """sample_a, sample_b (in order), kin, k0, k2."""
    d = spark.read.csv(path, sep="\t", header=True, schema="ID1 string, ID2 string, kin double, k0 double, k2 double")
    return d.select(F.least("ID1", "ID2").alias("sample_a"), F.greatest("ID1", "ID2").alias("sample_b"), "kin", "k0", "k2")


def read_grm(spark: SparkSession, path: str, ids_path: str) -> DataFrame:
    """a, b (sample ids in order), n, k of a relationship triangle in text: lines of row, column (from 1), number of sites, value; k is null where n is 0.

    ids_path: lines of family and person, in the triangle's order. A row without an id raises.
    """
    rows = spark.read.csv(path, sep="\t", schema="i long, j long, n double, k double")
    ids = spark.read.csv(ids_path, sep="\t", schema="family string, sample_id string")
    # the place in the file: lines are numbered by part, and parts by their order
    numbered = ids.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    before = numbered.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = numbered.join(F.broadcast(before), "_p").select("sample_id", (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_at"))
    d = rows.join(place.select(F.col("_at").alias("i"), F.col("sample_id").alias("x")), "i", "left").join(place.select(F.col("_at").alias("j"), F.col("sample_id").alias("y")), "j", "left")
    if not d.filter("x is null or y is null").isEmpty():
        raise ValueError("relationship triangle: rows without an id")
    return d.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n", F.when(F.col("n") > 0, F.col("k")).alias("k"))


def read_roh(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, chrom, lo, hi, kb, n_sites of a table of homozygous runs (header IID, CHR, POS1, POS2, KB, NSNP; blanks between)."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    head = lines.filter(F.array_contains("f", "POS1")).first()
    if head is None:
        raise ValueError("no header with POS1")
    at = lambda name: F.get("f", F.lit(head["f"].index(name)))
    d = lines.filter(~F.array_contains("f", "POS1") & (F.size("f") == len(head["f"])))
    return d.select(at("IID").alias("sample_id"), plain_chrom(at("CHR")).alias("chrom"), at("POS1").cast("long").alias("lo"), at("POS2").cast("long").alias("hi"), at("KB").cast("double").alias("kb"), at("NSNP").cast("long").alias("n_sites"))


def read_gvcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, lo, hi, ref, alt (null for reference blocks), dosage, dp, gq of one person; blocks span to INFO END."""
    v = _fields(spark, path, "\t").filter(~_f(0).startswith("#"))
    value = lambda k: F.get(F.split(_f(9), ":"), (F.array_position(F.split(_f(8), ":"), k) - 1).cast("int"))
    end = F.regexp_extract(_f(7), r"(?:^|;)END=(\d+)", 1).try_cast("long")
    alts = F.filter(F.split(_f(4), ","), lambda x: ~x.isin("<NON_REF>", "<*>", "."))
    gt = F.transform(F.split(value("GT"), "[/|]"), lambda x: x.try_cast("int"))
    dosage = F.when(F.exists(gt, lambda x: x.isNull()), None).otherwise(F.size(F.filter(gt, lambda x: x > 0)))
    return v.select(
        plain_chrom(_f(0)).alias("chrom"), _f(1).cast("long").alias("lo"), F.coalesce(end, _f(1).cast("long") + F.length(_f(3)) - 1).alias("hi"), _f(3).alias("ref"),
        F.get(alts, F.lit(0)).alias("alt"), dosage.alias("dosage"), value("DP").try_cast("int").alias("dp"), value("GQ").try_cast("int").alias("gq"),
    )


#: Column names of the old and new layouts of two quality tables, and the one schema they become.
LAYOUTS = {
    "missing": ({"IID": "sample_id", "N_MISS": "n_missing", "N_GENO": "n_sites", "F_MISS": "f_miss"}, {"#IID": "sample_id", "MISSING_CT": "n_missing", "OBS_CT": "n_sites", "F_MISS": "f_miss"}),
    "het": ({"IID": "sample_id", "O(HOM)": "o_hom", "E(HOM)": "e_hom", "N(NM)": "n_called", "F": "f"}, {"#IID": "sample_id", "O(HOM)": "o_hom", "E(HOM)": "e_hom", "OBS_CT": "n_called", "F": "f"}),
}


def normalise_qc(df: DataFrame, kind: str) -> DataFrame:
    """A quality table of either layout in one schema; neither fitting raises."""
    for names in LAYOUTS[kind]:
        if set(names) <= set(df.columns):
            return df.select(*[F.col(f"`{a}`").cast("string" if b == "sample_id" else "double").alias(b) for a, b in names.items()])
    raise ValueError(f"columns of no known layout: {df.columns}")


def read_metadata(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """A table of strings with identical repeats of a key collapsed; conflicting ones raise."""
    d = spark.read.csv(path, sep="\t", header=True).select(key, *columns).distinct()
    bad = d.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    if not bad.isEmpty():
        raise ValueError(f"conflicting rows of {key}: {[r[0] for r in bad.limit(5).collect()]}")
    return d


def write_feature_store(df: DataFrame, path: str) -> DataFrame:
    """Writes Parquet and TSV below path (which must not exist yet); returns the manifest: column, type, n, n_null."""
    df.write.mode("errorifexists").parquet(f"{path}/features.parquet")
    back = df.sparkSession.read.parquet(f"{path}/features.parquet")
    back.write.mode("errorifexists").csv(f"{path}/features.tsv", sep="\t", header=True)
    counts = back.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in back.columns]).first()
    rows = [(c, t, counts["_n"], counts[c]) for c, t in back.dtypes]
    manifest = df.sparkSession.createDataFrame(rows, "column string, type string, n long, n_null long")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest.json")
    return manifest
