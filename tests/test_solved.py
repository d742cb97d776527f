"""Operators without SQL against exhaustive or plain versions on small tables."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions.assignment import best_pairs
from strandlake.operators import ancestry, communities, contrasts, evaluation, stats
from strandlake.sources import readers


def test_best_pairs_equal_exhaustive_search():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = rng.integers(1, 6, 2)
        gain = rng.integers(0, 6, (n, m)) * rng.integers(0, 2, (n, m))
        small, wide = (gain, False) if n <= m else (gain.T, True)
        most = max(sum(small[i, j] for i, j in enumerate(p)) for p in permutations(range(small.shape[1]), small.shape[0]))
        got = best_pairs(gain)
        assert sum(gain[i, j] for i, j in got) == most
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and got == sorted(got)
    big = rng.integers(0, 1000, (60, 90))
    assert len(best_pairs(big)) == 60
    assert best_pairs(np.ones((2, 3), int)) == [(0, 0), (1, 1)]  # ties by order


def test_overlaps_are_assigned_for_the_greatest_total(spark):
    t = spark.createDataFrame([("x", 1, 1, 95), ("x", 2, 96, 160), ("y", 3, 1, 9)], "k string, truth long, lo long, hi long")
    c = spark.createDataFrame([("x", 7, 40, 160), ("x", 8, 101, 150), ("y", 9, 10, 20)], "k string, call long, lo long, hi long")
    got = sorted(map(tuple, evaluation.assign_overlaps(t, c, ["k"], 50).select("truth", "call", "bp").collect()))
    assert got == [(1, 7, 56), (2, 8, 50)]


def test_boundaries_match_nearest_or_as_many_as_can_be(spark):
    t = spark.createDataFrame([("h", 10.0, 0, 1), ("h", 18.0, 0, 1), ("h", 50.0, 1, 0)], "k string, midpoint double, before long, after long")
    c = spark.createDataFrame([("h", 14.5, 0, 1), ("h", 5.0, 0, 1), ("h", 51.0, 0, 1)], "k string, midpoint double, before long, after long")
    both = [sorted((r.truth, r.called) for r in ancestry.match_boundaries(t, c, ["k"], 6.0, x).collect()) for x in (False, True)]
    assert both == [[(10.0, 5.0), (18.0, 14.5)], [(10.0, 5.0), (18.0, 14.5)]]
    c2 = spark.createDataFrame([("h", 13.0, 0, 1), ("h", 4.0, 0, 1)], "k string, midpoint double, before long, after long")
    near, most = (sorted((r.truth, r.called) for r in ancestry.match_boundaries(t, c2, ["k"], 6.0, x).collect()) for x in (False, True))
    assert near == [(10.0, 13.0)] and most == [(10.0, 4.0), (18.0, 13.0)]


def test_tags_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(1, p, p + 1, 0.9) for p in range(300)], "chrom long, pos_a long, pos_b long, r2 double")
    sites = spark.createDataFrame([(1, p) for p in range(301)], "chrom long, pos long")
    kept = {r.pos for r in evaluation.tag_sites(pairs, sites, 0.5).collect()}
    assert not any(p + 1 in kept for p in kept)
    assert all({p - 1, p, p + 1} & kept for p in range(1, 300))  # none could be added


def test_names_go_one_to_one(spark):
    w = spark.createDataFrame([("f1", "A", 5.0), ("f1", "B", 4.0), ("f2", "A", 4.0), ("f2", "B", 1.0), ("f3", "A", 0.0), ("f3", "B", 1.0)], "file string, label string, w double")
    got = {(r.file, r.label, round(r.enrichment, 6), r.confirmed) for r in evaluation.ancestry_names(w, 3).collect()}
    assert got == {("f1", "A", 2.0, True), ("f2", "B", -1.0, False)} or got == {("f1", "A", 2.0, False), ("f2", "B", -1.0, False)}


def test_adjusted_p_values(spark):
    rng = random.Random(2)
    p = [rng.choice([0.001, 0.01, 0.02, 0.2, 0.5, 1.0]) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(p)), "i long, p double").repartition(5)
    got = {r.i: r.q for r in stats.benjamini_hochberg(d, "p").collect()}
    order = sorted(range(40), key=lambda i: p[i])
    want, low = {}, 1.0
    for k in range(39, -1, -1):
        low = min(low, p[order[k]] * 40 / (k + 1))
        want[order[k]] = low
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_stratified_bootstrap(spark):
    rows = [(s, g, float(10 * (s == "b") + g + k)) for s in "ab" for g in range(6) for k in range(3)]
    r = evaluation.stratified_bootstrap(spark.createDataFrame(rows, "s string, g long, v double"), "s", "g", "v", 200).first()
    means = [np.mean([v for s, _, v in rows if s == x]) for x in "ab"]
    assert abs(r.mean - np.mean(means)) < 1e-9 and r.low < r.mean < r.high and r.high - r.low < 4


def test_adjusted_kinship_equals_numpy(spark):
    rng = np.random.default_rng(3)
    n, m = 8, 30
    x, pc = rng.integers(0, 3, (n, m)), rng.normal(size=n)
    called = rng.random((n, m)) < 0.9
    g = spark.createDataFrame([(i, 1, j, int(x[i, j])) for i in range(n) for j in range(m) if called[i, j]], "sample_id long, chrom long, pos long, dosage long")
    got = {(r.sample_a, r.sample_b): r.kinship for r in evaluation.pc_relate(g, spark.createDataFrame([(i, float(pc[i])) for i in range(n)], "sample_id long, pc1 double"), ["pc1"]).collect()}
    top, low = np.zeros((n, n)), np.zeros((n, n))
    for j in range(m):
        c = np.flatnonzero(called[:, j])
        a = np.column_stack([np.ones(len(c)), pc[c]])
        f = np.clip(a @ np.linalg.pinv(a) @ (x[c, j] / 2), 0.01, 0.99)
        e, s = x[c, j] - 2 * f, np.sqrt(f * (1 - f))
        top[np.ix_(c, c)] += np.outer(e, e)
        low[np.ix_(c, c)] += np.outer(s, s)
    assert len(got) == n * (n - 1) // 2
    assert all(abs(v - top[a, b] / (4 * low[a, b])) < 1e-8 for (a, b), v in got.items())


def test_adjusted_kinship_shuffles_people_not_pairs(spark, monkeypatch):
    """Whom a person meets at a site goes to the person as one row; long lists are cut, with the same values."""
    rng = np.random.default_rng(4)
    g = spark.createDataFrame([(i, 1, j, float(rng.integers(0, 3)) / 2) for i in range(12) for j in range(9) if rng.random() < 0.8], "sample_id long, chrom long, pos long, dosage double").cache()
    pc = spark.createDataFrame([(i, i % 5 / 5) for i in range(12)], "sample_id long, pc1 double")
    got = []
    for listed, meetings in ((256, 1 << 19), (4, 50)):
        monkeypatch.setattr(evaluation, "LISTED", listed)
        monkeypatch.setattr(evaluation, "MEETINGS", meetings)
        d = evaluation.pc_relate(g, pc, ["pc1"])
        got.append({(r.sample_a, r.sample_b): (r.kinship, r.n_sites) for r in d.collect()})
        exchanges = [x for x in d._jdf.queryExecution().sparkPlan().toString().splitlines() + d._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
        assert exchanges and not any("sample_b" in x for x in exchanges)
    assert len(got[0]) == 66 and got[0].keys() == got[1].keys()
    assert all(abs(got[0][p][0] - got[1][p][0]) < 1e-12 and got[0][p][1] == got[1][p][1] for p in got[0])


def test_targets_are_the_sampled_pairs(spark):
    """Of each stratum no more than asked for, and only pairs that share elsewhere or nowhere as said."""
    from strandlake import registry

    from . import oracle

    rows = registry.queries()["pair_targets"](spark, oracle.DATA).collect()
    assert rows and len({tuple(r) for r in rows}) == len(rows)


def test_markers_within_reach_match_in_order(spark):
    rng = random.Random(4)
    t, m = sorted({rng.randint(0, 400) for _ in range(40)}), sorted({rng.randint(0, 400) for _ in range(40)})
    got = sorted((r.target, r.marker) for r in contrasts.markers_within(spark.createDataFrame([("c", float(x), x) for x in t], "k string, cm double, target long"), spark.createDataFrame([("c", float(x), x) for x in m], "k string, cm double, marker long"), ["k"], "cm", 6.0, 12.0, 64).collect())
    want, free = [], 0
    for x in t:
        left = [(abs(y - x), i) for i, y in enumerate(m) if i >= free]
        if left and min(left)[0] <= 6:
            want.append((x, m[min(left)[1]]))
            free = min(left)[1] + 1
    assert got == want and len(want) > 10


def test_concordance_of_equal_and_random_partitions(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(90)], "node long, community long")
    same = {r.community: (r.label, r.fraction, r.category) for r in contrasts.partition_concordance(a, a, 19).collect()}
    assert same == {k: (k, 1.0, "contained") for k in range(3)}
    b = a.withColumn("community", F.floor(F.col("node") / 3) % 2)
    assert all(r.category == "diffuse" and r.p > 0.05 for r in contrasts.partition_concordance(a, b, 19).collect())


def test_two_cliques_are_two_communities(spark):
    e = [(i, j, 1.0) for c in (0, 5) for i in range(c, c + 5) for j in range(i + 1, c + 5)] + [(4, 5, 1.0)]
    got = {r.node: r.community for r in communities.communities(spark.createDataFrame(e, "a long, b long, w double")).collect()}
    assert got == {i: 0 if i < 5 else 5 for i in range(10)}
    runs = spark.createDataFrame([(r, i, (0 if i < 5 else 5) if r or i != 4 else 5) for r in range(2) for i in range(10)], "run long, node long, community long")
    chosen = spark.createDataFrame([(i, 0 if i < 5 else 5) for i in range(10)] + [(99, None)], "node long, community long")
    sure = {r.node: r.confidence for r in communities.assignment_confidence(runs, chosen).collect()}
    assert sure[0] == 1.0 and sure[4] == 0.5 and sure[9] == 1.0 and len(sure) == 10


def test_relationship_and_run_readers(spark, tmp_path):
    (tmp_path / "g.grm").write_text("1\t1\t10\t0.9\n2\t1\t8\t0.1\n2\t2\t0\t0.5\n")
    (tmp_path / "g.id").write_text("f\tzoe\nf\tann\n")
    got = sorted(map(tuple, readers.read_grm(spark, str(tmp_path / "g.grm"), str(tmp_path / "g.id")).collect()))
    assert got == [("ann", "ann", 0.0, None), ("ann", "zoe", 8.0, 0.1), ("zoe", "zoe", 10.0, 0.9)]
    (tmp_path / "short.id").write_text("f\tzoe\n")
    with pytest.raises(ValueError):
        readers.read_grm(spark, str(tmp_path / "g.grm"), str(tmp_path / "short.id"))
    (tmp_path / "r.hom").write_text(" FID IID PHE CHR SNP1 SNP2 POS1 POS2 KB NSNP\n f a -9 chr2 x y 101 1100 1.000 5\n")
    assert [tuple(r) for r in readers.read_roh(spark, str(tmp_path / "r.hom")).collect()] == [("a", "2", 101, 1100, 1.0, 5)]


def test_late_events_fail_the_stream(spark, tmp_path):
    from datetime import datetime

    from strandlake.streaming import chains

    def batch(name, rows):
        spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name))

    schema = "user_id long, ts timestamp"
    batch("in/a", [(1, datetime(2024, 1, 1, 5)), (2, datetime(2024, 1, 1, 6))])

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = chains.in_order(stream, "user_id", "ts").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    batch("in/b", [(1, datetime(2024, 1, 1, 7))])
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    batch("in/c", [(2, datetime(2024, 1, 1, 4))])
    with pytest.raises(Exception, match="out of order"):
        run()


def test_boundaries_of_many_haplotypes_match_as_by_brute_force(spark):
    """Few rows a haplotype and many haplotypes: every haplotype by itself, none in a Python group of its own."""
    rng = np.random.default_rng(5)
    rows = {x: [(int(h), float(m), int(b), int(b) ^ 1) for h in range(300) for m, b in zip(rng.choice(400, 6, False), rng.integers(0, 2, 6))] for x in "tc"}
    t, c = (spark.createDataFrame(rows[x], "k long, midpoint double, before long, after long") for x in "tc")
    want, held = set(), set()
    for d, h, a, b in sorted((abs(a - b), h, a, b) for h, a, *s in rows["t"] for k, b, *z in rows["c"] if h == k and s == z and abs(a - b) <= 40):
        if (h, "t", a) not in held and (h, "c", b) not in held:
            held |= {(h, "t", a), (h, "c", b)}
            want.add((h, a, b))
    made = ancestry.match_boundaries(t, c, ["k"], 40.0)
    assert {tuple(r) for r in made.collect()} == want
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
