from pyspark.sql import functions as F

from strandlake.functions import scalars as S


def test_scalars(spark):
    d = spark.createDataFrame([("chrM", 1), ("Chr2", None), ("x", 3)], "c string, v int")
    got = d.select(S.plain_chrom(F.col("c")).alias("p"), "v")
    assert [r.p for r in got.orderBy(S.chrom_rank(F.col("p"))).collect()] == ["2", "X", "MT"]
    row = d.agg(S.known_sum(F.col("v")).alias("a"), S.known_sum(F.lit(2)).alias("b"), S.id_digest(F.col("c")).alias("h")).first()
    assert row.a is None and row.b == 6 and len(row.h) == 64
    one = spark.range(1).select(S.complement(F.lit("ACGTn")).alias("c"), S.joined(F.array(*map(F.lit, "abcd")), 2).alias("j"), S.log2_odds(F.lit(0.8), F.lit(0.5)).alias("o"), S.log2_odds(F.lit(1.0), F.lit(0.5)).alias("n")).first()
    assert (one.c, one.j, round(one.o, 9), one.n) == ("TGCAn", "ab,+2 more".replace("ab", "a,b"), 2.0, None)
