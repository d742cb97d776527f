"""Domain-shaped views of the driver's tables, each with the SQL that says the same.

genotypes: a person is a customer, a site a part; dosage is the line number
modulo 3, missing for line 7. Where a cell repeats, the largest dosage counts.
sites: allele count and number over called genotypes, with bases derived from the position.
intervals: a shipment from its date over as many days as its quantity, on the supplier as contig.
pairs: customers sharing parts, through segments of carriers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cell = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("sample_id"),
        (F.col("l_partkey") % 5 + 1).alias("chrom"),
        (F.col("l_partkey") * 1000).alias("pos"),
        F.when(F.col("l_linenumber") != 7, (F.col("l_linenumber") % 3).cast("long")).alias("dosage"),
    )
    return cell.groupBy("sample_id", "chrom", "pos").agg(F.max("dosage").alias("dosage"))


GENO = """geno AS (
  SELECT o_custkey AS sample_id, l_partkey % 5 + 1 AS chrom, l_partkey * 1000 AS pos,
    max(CASE WHEN l_linenumber <> 7 THEN (l_linenumber % 3)::BIGINT END) AS dosage
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""


def alleles(df: DataFrame) -> DataFrame:
    """ref and alt bases from the position; alt is never ref."""
    k = F.floor(F.col("pos") / 1000)
    step = F.floor(k / 4) % 3 + 1
    pick = lambda e: F.substr(F.lit("ACGT"), (e % 4 + 1).cast("int"), F.lit(1))
    return df.withColumns({"ref": pick(k), "alt": pick(k + step)})


ALLELES = """substr('ACGT', ((pos // 1000) % 4 + 1)::INT, 1) AS ref,
  substr('ACGT', ((pos // 1000 + (pos // 4000) % 3 + 1) % 4 + 1)::INT, 1) AS alt"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = genotypes(spark, sf_dir).groupBy("chrom", "pos").agg(
        F.coalesce(F.sum("dosage"), F.lit(0)).cast("long").alias("ac"), (2 * F.count("dosage")).alias("an"), F.count_if(F.col("dosage").isNull()).alias("n_missing")
    )
    return alleles(g)


SITES = GENO + f""",
sites AS (
  SELECT chrom, pos, coalesce(sum(dosage), 0)::BIGINT AS ac, 2 * count(dosage) AS an, count(*) - count(dosage) AS n_missing,
  {ALLELES}
  FROM geno GROUP BY chrom, pos)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("contig"),
        F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long").alias("lo"),
        (F.datediff("l_shipdate", F.lit("1970-01-01")) + F.col("l_quantity")).cast("long").alias("hi"),
        F.col("l_returnflag").alias("label"),
        F.col("l_orderkey").alias("record"),
        F.col("l_linenumber").cast("long").alias("part"),
    )


INTERVALS = """iv AS (
  SELECT l_suppkey AS contig, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS lo,
    (date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity)::BIGINT AS hi,
    l_returnflag AS label, l_orderkey AS record, l_linenumber::BIGINT AS part
  FROM lineitem)"""

#: Segments of the genotypes' carriers: pairs of people, chained over gaps of 50 kb at most, with two sites or more.
MAX_GAP, MIN_SITES = 50_000, 2

SEGMENTS = GENO + f""",
carriers AS (SELECT sample_id, chrom, pos FROM geno WHERE dosage > 0),
shared AS (
  SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, a.chrom, a.pos
  FROM carriers a JOIN carriers b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample_id < b.sample_id),
broken AS (
  SELECT *, CASE WHEN pos - lag(pos) OVER w > {MAX_GAP} THEN 1 ELSE 0 END AS new FROM shared
  WINDOW w AS (PARTITION BY sample_a, sample_b, chrom ORDER BY pos)),
chained AS (SELECT *, sum(new) OVER (PARTITION BY sample_a, sample_b, chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM broken),
segments AS (
  SELECT sample_a, sample_b, chrom, min(pos) AS start_pos, max(pos) AS end_pos, max(pos) - min(pos) + 1 AS length_bp,
    count(*) AS n_shared_variants
  FROM chained GROUP BY sample_a, sample_b, chrom, island HAVING count(*) >= {MIN_SITES})"""

PAIRS = SEGMENTS + """,
pairs AS (
  SELECT sample_a, sample_b, count(*) AS n_segments, sum(length_bp)::BIGINT AS total_shared_bp,
    count(DISTINCT chrom) AS n_chromosomes, sum(n_shared_variants)::BIGINT AS n_shared_variants_total, max(length_bp) AS max_segment_bp
  FROM segments GROUP BY sample_a, sample_b)"""
