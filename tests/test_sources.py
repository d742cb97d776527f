import pytest
from pyspark.sql import functions as F

from strandlake.operators import variants
from strandlake.sources import readers as R
from strandlake.streaming import chains

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
chr1\t100\t.\tA\tC\t.\tPASS\tAC=2;DB\tGT:DP\t0/1:9\t1|1:8\t0/.:3
chr1\t200\t.\tG\tA,T\t.\tq10;low\t.\tDP:GT\t3:0/2\t4:1/2\t5:./.
chrUn\t5\t.\tG\tA\t.\tPASS\t.\tGT\t0/0\t0/0\t0/0
"""


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    v = R.read_vcf(spark, str(tmp_path / "*.vcf"), 2)
    got = {r.pos: r for r in v.collect()}
    assert set(got) == {100, 200} and got[100].chrom == "1" and got[100].info == {"AC": "2", "DB": "true"} and got[200].info is None
    assert got[200].alts == ["A", "T"] and got[200].filters == ["q10", "low"]
    g = {(r.pos, r.sample_id): (r.a0, r.a1, r.phased, r.dosage) for r in R.long_genotypes(v).collect()}
    assert g[100, "s1"] == (0, 1, False, 1) and g[100, "s2"] == (1, 1, True, 2) and g[100, "s3"] == (0, None, False, None) and g[200, "s3"] == (None, None, False, None)
    two = variants.split_multiallelic(R.long_genotypes(v).filter("pos = 200"))
    assert sorted((r.alt, r.sample_id, r.a0, r.a1) for r in two.collect()) == [("A", "s1", 0, 0), ("A", "s2", 1, 0), ("A", "s3", None, None), ("T", "s1", 0, 1), ("T", "s2", 0, 1), ("T", "s3", None, None)]
    assert R.scan(v, "1", 100, 150).count() == 1
    ids = spark.createDataFrame([("s2",)], "sample_id string")
    assert R.project_samples(R.long_genotypes(v), ids).count() == 2


def test_bed_msp_ibd(spark, tmp_path):
    (tmp_path / "x.bed").write_text("track name=x\n#c\nchr1\t0\t10\nX 5 6\n1\tno\t4\n2\t3\n")
    assert sorted(map(tuple, R.read_bed(spark, str(tmp_path / "x.bed")).collect())) == [("1", 1, 10), ("X", 6, 6)]
    (tmp_path / "x.msp").write_text("#Subpopulation order/codes: A=0\tB=1\n#chm\tspos\tepos\tsgpos\tegpos\tn snps\tp1.0\tp1.1\n1\t10\t20\t0\t1\t5\t0\t1\n")
    assert sorted(map(tuple, R.read_msp(spark, str(tmp_path / "x.msp")).collect())) == [("1", 10, 20, "p1", 0, 0), ("1", 10, 20, "p1", 1, 1)]
    (tmp_path / "x.ibd").write_text("b 1 a 2 1 5 9 3.5\nb 1 b 2 1 5 9 3.5\nshort line\na 1 c 1 1 5 9 x\na 1 z 1 1 5 9 2\n")
    known = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    assert [tuple(r) for r in R.read_ibd(spark, str(tmp_path / "x.ibd"), known).collect()] == [("a", "b", 3.5)]
    (tmp_path / "r.ibd").write_text("b 1 a 2 1 5 9 4 2.5\nb 1 a 2 1 5 9 4 2.5\nb 3 a 2 1 5 9 4 2\nb 1 b 2 1 5 9 4 2\na 1 c 1 1 5 9 NaN 2\n")
    seg, inv = R.read_refined_ibd(spark, str(tmp_path / "r.ibd"))
    assert seg.count() == 2 and [(r.n_lines, r.n_valid, r.n_distinct) for r in inv.collect()] == [(5, 2, 1)]
    assert R.extract_ibd_pairs(seg, spark.createDataFrame([("a", "b")], "sample_a string, sample_b string")).count() == 2


def test_map_checks(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("chrom\tpos\tcm\nchr1\t1\t0\nchr1\t1\t9\nchr1\t5\t0.5\n1\t\t3\n")
    assert sorted(map(tuple, R.read_map(spark, str(tmp_path / "m.tsv")).collect())) == [("1", 1, 0.0), ("1", 5, 0.5)]
    (tmp_path / "n.tsv").write_text("chrom\tpos\tcm\n1\t1\t2\n1\t5\t0.5\n")
    with pytest.raises(ValueError):
        R.read_map(spark, str(tmp_path / "n.tsv"))


def test_gvcf_and_states(spark, tmp_path):
    (tmp_path / "g.vcf").write_text("#x\n1\t10\t.\tA\t<NON_REF>\t.\t.\tEND=20\tGT:DP:GQ\t0/0:30:50\n1\t21\t.\tC\tT,<NON_REF>\t.\t.\t.\tGT:DP:GQ\t0/1:30:50\n1\t22\t.\tG\tA\t.\t.\t.\tGT:DP:GQ\t./.:1:2\n")
    r = R.read_gvcf(spark, str(tmp_path / "g.vcf"))
    t = spark.createDataFrame([("1", 15, "A", "G"), ("1", 21, "C", "T"), ("1", 21, "C", "G"), ("1", 22, "G", "A"), ("1", 40, "A", "C")], "chrom string, pos long, ref string, alt string")
    got = {(x.pos, x.alt): (x.state, x.dosage) for x in variants.classify_gvcf(t, r).collect()}
    assert got == {(15, "G"): ("reference_block", 0), (21, "T"): ("explicit_exact", 1), (21, "G"): ("incompatible", None), (22, "A"): ("missing", None), (40, "C"): ("uncovered", None)}


def test_layouts_and_metadata(spark, tmp_path):
    old = spark.createDataFrame([("f", "i", 1, 10, 0.1)], ["FID", "IID", "N_MISS", "N_GENO", "F_MISS"])
    new = spark.createDataFrame([("i", 1, 10, 0.1)], ["#IID", "MISSING_CT", "OBS_CT", "F_MISS"])
    assert R.normalise_qc(old, "missing").collect() == R.normalise_qc(new, "missing").collect()
    with pytest.raises(ValueError):
        R.normalise_qc(old, "het")
    (tmp_path / "m.tsv").write_text("id\tv\n1\tx\n1\tx\n2\ty\n")
    assert R.read_metadata(spark, str(tmp_path / "m.tsv"), "id", ["v"]).count() == 2
    (tmp_path / "k.tsv").write_text("ID1\tID2\tkin\tk0\tk2\nb\ta\t0.25\t0\t0.25\n")
    assert [tuple(r) for r in R.read_kinship(spark, str(tmp_path / "k.tsv")).collect()] == [("a", "b", 0.25, 0.0, 0.25)]


def test_feature_store_is_written_once(spark, tmp_path):
    d = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    m = {r.column: (r.n, r.n_null) for r in R.write_feature_store(d, f"{tmp_path}/s").collect()}
    assert m == {"id": (2, 0), "v": (2, 1)} and spark.read.parquet(f"{tmp_path}/s/features.parquet").count() == 2
    with pytest.raises(Exception):
        R.write_feature_store(d, f"{tmp_path}/s")


def test_chains_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:10"), ("a", "2024-01-01 00:00:21"), ("b", "2024-01-01 00:00:05")]
    d = spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("t"))
    batch = sorted((r.k, str(r.first), str(r.last), r.n) for r in chains.sessions(d, "k", "t", "10 seconds").collect())
    assert [x[3] for x in batch] == [2, 1, 1]
    d.write.parquet(f"{tmp_path}/in")
    late = spark.createDataFrame([("z", "2024-01-02 00:00:00")], "k string, t string").select("k", F.to_timestamp("t").alias("t"))
    late.write.mode("append").parquet(f"{tmp_path}/in")
    s = chains.sessions(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), "k", "t", "10 seconds", late="1 minute")
    q = s.writeStream.format("memory").queryName("chains_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.k, str(r.first), str(r.last), r.n) for r in spark.table("chains_out").collect())
    assert got == batch
