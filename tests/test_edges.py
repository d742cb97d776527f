"""Edge rules on tiny hand-made tables."""

from pyspark.sql import functions as F

from strandlake.operators import cohort, intervals, pairs, stats, summaries, variants


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_partial_genotype_counts_its_known_allele(spark):
    gt = spark.createDataFrame([(1, 10, 0, None), (1, 10, 1, 1), (1, 20, None, None)], "chrom long, pos long, a0 int, a1 int")
    assert rows(variants.allele_counts(gt), "pos", "ac", "an") == [(10, 2, 3), (20, 0, 0)]


def test_rare_reasons_in_their_order(spark):
    s = spark.createDataFrame(
        [(1, 3, "A", "C", 5, 400), (2, 2, "AT", "C", 5, 400), (3, 2, "A", "C", 0, 0), (4, 2, "A", "C", 200, 400), (5, 2, "A", "C", 1, 400), (6, 2, "A", "C", 5, 400), (7, 2, "A", "C", 4, 400), (8, 2, "A", "C", 396, 400)],
        "pos long, orig_nalleles int, ref string, alt string, ac long, an long",
    )
    got = [r[0] for r in s.orderBy("pos").select(variants.rare_reason()).collect()]
    assert got == ["multiallelic", "non_snv", "all_missing", "frequency_tie", "mac_below_min", "maf_above_max", "included", "included"]
    kept = variants.select_rare_minor(s.withColumn("chrom", F.lit(1)))
    assert rows(kept, "pos", "rare_allele", "rare_ac") == [(7, 1, 4), (8, 0, 4)]


def test_chains_break_above_the_gap_only(spark):
    p = spark.createDataFrame([(1, 2, 1, 0), (1, 2, 1, 100), (1, 2, 1, 201)], "sample_a long, sample_b long, chrom long, pos long")
    got = pairs.chains(p, 100, ["sample_a", "sample_b", "chrom"])
    assert rows(got, "start_pos", "end_pos", "n_shared_variants", "length_bp") == [(0, 100, 2, 101), (201, 201, 1, 1)]


def test_adjacent_intervals_merge(spark):
    i = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 11, 12), ("a", 2, 3)], "k string, lo long, hi long")
    assert rows(intervals.union(i, ["k"]), "lo", "hi") == [(1, 9), (11, 12)]
    b = spark.createDataFrame([("a", 0, 20), ("b", 1, 2)], "k string, lo long, hi long")
    assert rows(intervals.complement(i, b, ["k"]), "k", "lo", "hi") == [("a", 0, 0), ("a", 10, 10), ("a", 13, 20), ("b", 1, 2)]
    for size in (1, 2, 3, 5, 7):  # bucket borders must not show
        assert rows(intervals.union(i, ["k"], size), "lo", "hi") == [(1, 9), (11, 12)]
        assert rows(intervals.complement(i, b, ["k"], size), "k", "lo", "hi") == [("a", 0, 0), ("a", 10, 10), ("a", 13, 20), ("b", 1, 2)]


def test_order_along_an_axis(spark):
    import random

    from strandlake.operators import axis

    rng = random.Random(3)
    data = sorted({(k, rng.randint(0, 300)) for k in "ab" for _ in range(60)})
    d = spark.createDataFrame(data, "k string, pos long")
    want_before, want_ordinal, want_island = {}, {}, {}
    for k in "ab":
        p = [x for kk, x in data if kk == k]
        for i, x in enumerate(p):
            want_before[k, x], want_ordinal[k, x] = (p[i - 1] if i else None), i
            want_island[k, x] = x if i == 0 or x - p[i - 1] > 8 else want_island[k, p[i - 1]]
    for size in (10, 64, 1000):
        assert {(r.k, r.pos): r._before for r in axis.with_before(d, ["k"], size=size).collect()} == want_before
        assert {(r.k, r.pos): r._ordinal for r in axis.with_ordinal(d, ["k"], size=size).collect()} == want_ordinal
        assert {(r.k, r.pos): r._island for r in axis.with_island(d, ["k"], 8, size=size).collect()} == want_island


def test_points_on_ends_and_in_gaps(spark):
    i = spark.createDataFrame([("a", 10, 19), ("a", 21, 30)], "k string, lo long, hi long")
    p = spark.createDataFrame([("a", x) for x in (9, 10, 19, 20, 21, 30, 31)], "k string, pos long")
    got = {r.pos: r.lo for r in intervals.point_in_interval(p, i, ["k"], 4).collect()}
    assert got == {9: None, 10: 10, 19: 10, 20: None, 21: 21, 30: 21, 31: None}


def test_interpolation_is_null_outside_the_map(spark):
    m = spark.createDataFrame([("a", 10, 0.0), ("a", 20, 1.0), ("a", 40, 2.0)], "k string, pos long, cm double")
    p = spark.createDataFrame([("a", x) for x in (9, 10, 15, 20, 30, 40, 41)], "k string, pos long")
    got = {r.pos: r.cm for r in intervals.interpolate(p, m, ["k"], "pos", "cm", 7).collect()}
    assert got == {9: None, 10: 0.0, 15: 0.5, 20: 1.0, 30: 1.5, 40: 2.0, 41: None}


def test_spectrum_closes_only_the_last_bin(spark):
    s = spark.createDataFrame([(1, 1, 1, 10), (1, 2, 5, 10), (1, 3, 10, 10), (1, 4, 0, 0)], "chrom long, pos long, ac long, an long")
    got = {r.bin: r.n for r in summaries.sfs(s, 10, 5, (1, 2), False).collect()}
    assert got == {k: int(k in (1, 5, 9)) for k in range(10)}


def test_jaccard_is_null_without_carriers(spark):
    e = spark.createDataFrame([(1, 2, 0, 0, 5), (1, 3, 1, 2, 5), (1, 3, 1, 2, 5)], "sample_a long, sample_b long, n_both long, n_either long, n_called long")
    assert {(r.sample_b, r.jaccard) for r in pairs.masked_jaccard(e).collect()} == {(2, None), (3, 0.5)}


def test_absence_is_not_zero(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    t = spark.createDataFrame([(1, 0), (2, 4)], "id long, n long")
    got = cohort.feature_store(base, {"t": t}, "id", {"t": ["n"]})
    assert rows(got, "id", "in_t", "n") == [(1, True, 0), (2, True, 4), (3, False, 0)]


def test_metadata_repeats_and_conflicts(spark):
    m = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y")], "id long, v string")
    d, bad = cohort.unique_rows(m, "id")
    assert d.count() == 3 and rows(bad, "id", "n_versions") == [(2, 2)]


def test_pair_rules(spark):
    p = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 3, 1.0), (4, 5, float("nan")), (6, 7, -1.0)], "a long, b long, v double")
    assert rows(cohort.pair_violations(p, "a", "b", "v"), "rule", "n") == [("bad_value", 2), ("repeated_pair", 1), ("self_pair", 1)]


def test_presence_states(spark):
    t = spark.createDataFrame([(1, p, "A", "C") for p in range(1, 6)], "chrom long, pos long, ref string, alt string")
    p = spark.createDataFrame([(1, 1, "A", "C", 3, 9), (1, 1, "A", "C", 1, 9), (1, 2, "A", "C", 0, 9), (1, 3, "A", "G", 4, 9), (1, 4, "T", "C", 4, 9)], "chrom long, pos long, ref string, alt string, ac long, an long")
    got = {r.pos: (r.state, r.panel_ac) for r in summaries.external_presence(t, p).collect()}
    assert got == {1: ("carried", 3), 2: ("monomorphic", 0), 3: ("other_allele", 0), 4: ("ref_mismatch", 0), 5: ("absent", 0)}


def test_ranks_over_many_partitions(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 100).alias("v"))
    got = {r.v: r.rank for r in stats.value_ranks(d, "v").collect()}
    assert got == {v: 10 * v + 5.5 for v in range(100)}


def test_unions_of_many_equal_intervals(spark):
    """Equal intervals (ties of any order by their ends) merge as one, on either side of bucket borders."""
    from strandlake.operators import intervals as I

    one = [(c, lo, lo + n) for c in range(3) for lo, n in ((1, 4), (9, 40), (55, 2), (58, 9), (70, 31), (140, 0))]
    rows = spark.createDataFrame(one * 40, "contig long, lo long, hi long").repartition(7)
    want = set()
    for c in range(3):
        held = sorted({p for k, lo, hi in one if k == c for p in range(lo, hi + 1)})
        starts = [p for p in held if p - 1 not in held]
        ends = [p for p in held if p + 1 not in held]
        want |= set(zip([c] * len(starts), starts, ends))
    for size in (8, 32, 1 << 20):
        assert sorted(tuple(r) for r in I.union(rows, ["contig"], size).select("contig", "lo", "hi").collect()) == sorted(want)


def test_grids_and_universes_shuffle_what_is_stored_only(spark):
    """The grid and all pairs are filled in behind the last exchange; joined windows equal windows joined afterwards."""
    from strandlake.operators import windows as W

    g = spark.createDataFrame([(1, 1, 5, 1), (1, 1, 25, None), (2, 1, 45, 2), (3, 2, 7, 0), (3, 2, 99, 1), (1, 2, 99, 1)], "sample_id long, chrom long, pos long, dosage long")
    people = spark.createDataFrame([(1,), (2,), (3,), (4,)], "sample_id long")
    full = W.grid_features(g, people, 10)
    assert full.count() == 4 * 5
    for factor, phase in ((3, 1), (2, 0), (4, 3)):
        assert rows(W.grid_features(g, people, 10, factor=factor, phase=phase), *full.columns) == rows(W.regrid(full, factor, phase), *full.columns)
    plan = W.grid_features(g, people, 10, factor=3, phase=1)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.index("BroadcastHashJoin") < plan.index("SortMergeJoin" if "SortMergeJoin" in plan else "Exchange")

    n = spark.createDataFrame([(k, k % 2) for k in range(20)], "sample_id long, grp long")
    v = spark.createDataFrame([(0, 2, 7), (0, 1, 5), (3, 7, None), (4, 18, 9)], "sample_a long, sample_b long, w long")
    u = pairs.pair_universe(n, v, "w", ["grp"])
    known = {(0, 2): 7, (4, 18): 9}
    assert {tuple(r) for r in u.collect()} == {(a % 2, a, b, known.get((a, b))) for a in range(20) for b in range(a + 1, 20) if a % 2 == b % 2}
    assert u.count() == 90
    c = spark.createDataFrame([(k, 1, p) for k in range(4) for p in (10, 20, 900)] + [(9, 1, 10)], "sample_id long, chrom long, pos long")
    s = pairs.pair_segments(c, 50, 2)
    assert {(r.sample_a, r.sample_b, r.start_pos, r.end_pos) for r in s.collect()} == {(a, b, 10, 20) for a in range(4) for b in range(a + 1, 4)}
    assert s._jdf.queryExecution().executedPlan().toString().count("Join") <= 2  # sites meet once


def _exchanges_of(df, *columns):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return sum("Exchange hashpartitioning" in line and all(c in line for c in columns) for line in plan.splitlines())


def test_evidence_of_pairs_shuffles_them_once(spark):
    from strandlake.operators import windows as W

    got = [(1, 1, 10, 1), (2, 1, 10, 2), (3, 1, 10, None), (1, 1, 20, None), (2, 1, 20, None), (3, 2, 30, 1), (1, 2, 30, 0)]
    g = spark.createDataFrame(got, "sample_id long, chrom long, pos long, dosage long")
    e = pairs.pair_evidence(g)
    # 1 and 2 share site 10 and both miss 20; 3 misses 10 and carries 30
    assert rows(e, "sample_a", "sample_b", "n_both", "n_either", "n_called") == [(1, 2, 1, 1, 2), (1, 3, 0, 1, 1), (2, 3, 0, 1, 1)]
    assert _exchanges_of(pairs.masked_jaccard(e), "sample_a") <= 1
    p = spark.createDataFrame([(a, a + 1, 1, p) for a in range(3) for p in (5, 9, 2_000_000)], "sample_a long, sample_b long, chrom long, pos long")
    keys = ["sample_a", "sample_b", "chrom"]
    assert rows(W.gap_stats(p, keys, "pair", None), "n", "max_gap") == rows(W.gap_stats(p, keys, "pair"), "n", "max_gap") == [(6, 1_999_991)]
    assert _exchanges_of(W.gap_stats(p, keys, "pair", None), "sample_a") == 1 < _exchanges_of(W.gap_stats(p, keys, "pair"), "sample_a")


def test_dyadic_variance_of_large_whole_values_is_exact(spark):
    from fractions import Fraction

    from strandlake.operators import evaluation

    v = {(a, b): (1 << 52) + 3 * a + 7 * b + a * b % 5 for a in range(12) for b in range(a + 1, 12)}
    p = spark.createDataFrame([(a, b, x) for (a, b), x in v.items()], "sample_a long, sample_b long, bp long")
    c = spark.createDataFrame([(i, i % 4) for i in range(12)], "node long, component long")
    mean = Fraction(sum(v.values()), len(v))
    cell, incident = {}, {}
    for (a, b), x in v.items():
        k = tuple(sorted((a % 4, b % 4)))
        cell[k] = cell.get(k, 0) + x - mean
    for k, u in cell.items():
        for i in set(k):
            incident[i] = incident.get(i, 0) + u
    want = (sum(u * u for u in incident.values()) - sum(u * u for k, u in cell.items() if k[0] != k[1])) / len(v) ** 2
    r = evaluation.dyadic_variance(p, c, "bp").first()
    assert r.n == len(v) and r.mean == float(mean) and abs(r.variance - float(want)) < 1e-9
    none = evaluation.dyadic_variance(p.limit(0), c, "bp").collect()
    assert [tuple(x) for x in none] == [(0, None, None)]


def test_assignment_needs_no_rounds_of_components(spark, monkeypatch):
    from strandlake.operators import evaluation, graph

    def none(*_, **__):
        raise AssertionError("rounds over all pairs")

    monkeypatch.setattr(graph, "component_roots", none)
    t = spark.createDataFrame([(1, 1, 0, 40), (1, 2, 30, 90), (1, 3, 100, 110), (2, 4, 0, 40)], "contig long, truth long, lo long, hi long")
    c = spark.createDataFrame([(1, 11, 0, 10), (1, 12, 5, 35), (1, 13, 60, 104), (1, 14, 200, 210), (2, 15, 41, 50)], "contig long, call long, lo long, hi long")
    got = evaluation.assign_overlaps(t, c, ["contig"], 8)
    assert rows(got, "contig", "truth", "call", "bp") == [(1, 1, 12, 31), (1, 2, 13, 31)]


def test_sharing_windows_shuffle_pairs_by_window_only(spark):
    import re

    from strandlake.operators import windows

    c = spark.createDataFrame([(s, 1, p) for s in (1, 2, 3) for p in (10, 60, 130) if (s + p) % 4], "sample_id long, chrom long, pos long")
    out = windows.sharing_windows(c, 100, 50, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*sample_[ab]", plan)
    assert rows(out, "start", "n_pairs", "max_jaccard", "top_pairs") == [(10, 3, 1.0, '1-3,+2 more'), (60, 3, 1.0, '1-3,+2 more'), (110, 1, 1.0, '1-3')]


def test_king_parts_grow_with_meetings(spark, monkeypatch):
    g = spark.createDataFrame([(s, 1, p, (s * p) % 3) for s in range(1, 6) for p in range(1, 9)] + [(1, 1, 9, None), (2, 1, 9, 1)], "sample_id long, chrom long, pos long, dosage long")
    monkeypatch.setattr(pairs, "MEETINGS", 8)
    out = pairs.king_robust(g)
    assert out.rdd.getNumPartitions() == 10  # 8 sites of 10 meetings
    want = []
    for a in range(1, 6):
        for b in range(a + 1, 6):
            c = [((a * p) % 3, (b * p) % 3) for p in range(1, 9)]
            want.append((a, b, sum(x == y == 1 for x, y in c), sum(abs(x - y) == 2 for x, y in c), sum(x == 1 for x, _ in c), sum(y == 1 for _, y in c), 8))
    assert rows(out, "sample_a", "sample_b", "n_het_het", "n_ibs0", "n_het_a", "n_het_b", "n_called") == want


def test_whom_a_person_meets_travels_as_lists(spark, monkeypatch):
    """Pairs are dealt by one person, with the same counts for long lists, wide ids and people of one part."""
    from strandlake.plans import q_contrasts

    dosage = {(s, p): None if (s + p) % 5 == 0 else (s * p) % 3 for s in range(1, 9) for p in range(1, 7) if (s * p) % 7}
    for shift, listed, each in ((0, 256, 1 << 19), (1 << 40, 256, 20), (-4, 3, 7)):
        monkeypatch.setattr(pairs, "LISTED", listed)
        monkeypatch.setattr(pairs, "MEETINGS", each)
        g = spark.createDataFrame([(s + shift, 1 + p % 2, p, x) for (s, p), x in dosage.items()] + [(9 + shift, 1, None, 1), (10 + shift, 1, None, 1)], "sample_id long, chrom long, pos long, dosage long")
        monkeypatch.setattr(q_contrasts.D, "genotypes", lambda *_: g)
        evidence, king, merged = [], [], []
        for a in range(1, 9):
            for b in range(a + 1, 9):
                both = [(dosage[a, p], dosage[b, p]) for p in range(1, 7) if (a, p) in dosage and (b, p) in dosage]
                called = [(x, y) for x, y in both if x is not None and y is not None]
                pair = (a + shift, b + shift)
                if called:
                    king.append((*pair, sum(x == y == 1 for x, y in called), sum(abs(x - y) == 2 for x, y in called), len(called)))
                    merged.append((*pair, float(len(called)), round(sum(x * y for x, y in called) / len(called), 9)))
                if any((x is None or x > 0) and (y is None or y > 0) for x, y in both):
                    own = [sum((k, p) in dosage and bool(dosage[k, p]) for p in range(1, 7)) for k in (a, b)]
                    n_both, lost = sum(bool(x and y) for x, y in both), sum(x is None and bool(y) or y is None and bool(x) for x, y in both)
                    evidence.append((*pair, n_both, sum(own) - lost - n_both))
        found = pairs.king_robust(g), pairs.pair_evidence(g), q_contrasts.merged_relationship(spark, "")
        assert rows(found[0], "sample_a", "sample_b", "n_het_het", "n_ibs0", "n_called") == king
        assert rows(found[1], "sample_a", "sample_b", "n_both", "n_either") == evidence
        assert rows(found[2], "a", "b", "n", "k") == merged
        assert not any("Exchange" in line and ("sample_b" in line or "(a#" in line or " b#" in line) for d in found for line in d._jdf.queryExecution().executedPlan().toString().splitlines())


def test_only_sites_in_runs_of_both_people_meet(spark, monkeypatch):
    import random
    from itertools import combinations

    from strandlake.operators import windows

    def runs(positions, gap):
        out = []
        for p in sorted(positions):
            if out and p - out[-1][-1] <= gap:
                out[-1].append(p)
            else:
                out.append([p])
        return out

    rng = random.Random(5)
    held = {(s, c): set(rng.sample(range(400), 30)) for s in range(1, 9) for c in (1, 2)}
    held |= {(9, 1): {p for p in range(400) if p % 30 == 0}, (10, 1): {p for p in range(400) if p % 30 == 0}}  # nothing within 10
    rows_of = [(s, c, p) for (s, c), v in held.items() for p in v]
    d = spark.createDataFrame(rows_of + rows_of[:40] + [(1, 1, None), (None, 1, 7), (None, 1, 9)], "sample_id long, chrom long, pos long")
    met, chains = [], pairs.chains

    def seen(shared, *args, **kwargs):
        met.append(rows(shared, "sample_a", "sample_b", "chrom", "pos"))
        return chains(shared, *args, **kwargs)

    monkeypatch.setattr(pairs, "chains", seen)
    for gap, least, length in ((10, 2, 0), (25, 3, 0), (25, 2, 40), (8, 1, 0)):
        want = []
        for a, b in combinations(range(1, 11), 2):
            for c in (1, 2):
                for r in runs(held.get((a, c), set()) & held.get((b, c), set()), gap):
                    if len(r) >= least and r[-1] - r[0] + 1 >= length:
                        want.append((a, b, c, r[0], r[-1], len(r)))
        got = pairs.pair_segments(d, gap, least, length)
        assert rows(got, "sample_a", "sample_b", "chrom", "start_pos", "end_pos", "n_shared_variants") == sorted(want)
    kept = {(s, c, p) for (s, c), v in held.items() for r in runs(v, 10) if len(r) >= 2 for p in r}
    every = [(a, b, c, p) for a, b in combinations(range(1, 11), 2) for c in (1, 2) for p in held.get((a, c), set()) & held.get((b, c), set())]
    assert met[0] == sorted(x for x in every if (x[0], *x[2:]) in kept and (x[1], *x[2:]) in kept) and len(met[0]) < len(every)
    # a sweep pairs what the widest gap of its grid lets meet
    full, paired = {}, []
    for name, f in (("sweep", lambda: windows.segment_sweep(d, [5, 10], [1, 12], [2, 3])), ("classes", lambda: windows.sweep_classes(d, [5, 10], [1, 12], [2, 3])[0])):
        monkeypatch.setattr(windows, "cut", lambda x: paired.append(x.count()) or x)
        full[name] = {(r.max_gap, r.min_length, r[2]): (r.n_segments, r.n_pairs, r.total_bp) for r in f().collect()}
    for (gap, length, least), found in (full["sweep"] | full["classes"]).items():
        hit = [(a, b, r) for a, b in combinations(range(1, 11), 2) for c in (1, 2) for r in runs(held.get((a, c), set()) & held.get((b, c), set()), gap) if len(r) >= least and r[-1] - r[0] + 1 >= length]
        assert found == (len(hit), len({x[:2] for x in hit}), sum(r[-1] - r[0] + 1 for _, _, r in hit))
    alone = spark.createDataFrame([(s, 1, p) for s in range(6) for p in range(0, 400, 20)], "sample_id long, chrom long, pos long")
    paired.clear()
    assert {r.n_segments for r in windows.segment_sweep(alone, [5, 10], [1], [2]).collect()} == {0} and paired == [0]


def test_evidence_of_few_segments_shuffles_no_genotypes(spark, monkeypatch):
    from strandlake.operators import evaluation

    got = {(s, 1, p): (s * p + p // 7) % 4 for s in (1, 2, 3) for p in range(0, 200, 3) if (s + p) % 5}
    g = spark.createDataFrame([(*k, None if v == 3 else v) for k, v in got.items()], "sample_id long, chrom long, pos long, dosage long")
    seg = [("x", 1, 2, 1, 9, 131), ("y", 1, 3, 1, 60, 60), ("z", 2, 3, 1, 0, 198), ("none", 1, 2, 1, 500, 700), ("other", 1, 2, 2, 0, 198)]
    s = spark.createDataFrame(seg, "seg string, sample_a long, sample_b long, chrom long, lo long, hi long")
    want = []
    for name, a, b, c, lo, hi in seg:
        cells = [(p, got[a, c, p], got[b, c, p]) for p in range(lo, hi + 1) if (a, c, p) in got and (b, c, p) in got]
        both = [p for p, x, y in cells if x in (1, 2) and y in (1, 2)]
        called = [(x, y) for _, x, y in cells if x != 3 and y != 3]
        if cells:
            want.append((name, len(both), sum(x > 0 or y > 0 for x, y in called), len(called), max((q - p for p, q in zip(both, both[1:])), default=None)))
    few = evaluation.segment_evidence(s, g, 50)
    assert rows(few, "seg", "n_both", "n_either", "n_called", "max_gap") == sorted(want)
    assert _exchanges_of(few, "sample_") == 0
    monkeypatch.setattr(evaluation, "FEW_SEGMENTS", 0)
    assert rows(evaluation.segment_evidence(s, g, 50), "seg", "n_both", "n_either", "n_called", "max_gap") == sorted(want)
