"""Ordered marker matches, map weights, permutations in strata, transitions and adjusted information against brute force."""

import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions.assignment import matching
from strandlake.operators import ancestry as A
from strandlake.operators import axis
from strandlake.operators import contrasts as C
from strandlake.operators import evaluation as E
from strandlake.operators import models as M
from strandlake.operators import stats as T
from strandlake.operators import windows as W


def test_markers_are_kept_for_the_targets_to_come(spark):
    rng = random.Random(1)
    targets, markers = [], []
    for g in range(30):
        targets += [(g, rng.randint(0, 20) / 4, rng.randint(0, 50), 100 * g + i) for i in range(rng.randint(0, 6))]
        markers += [(g, rng.randint(0, 20) / 4, rng.randint(0, 50), 100 * g + i) for i in range(rng.randint(0, 8))]
    frame = lambda rows, name: spark.createDataFrame(rows, f"g long, cm double, bp long, {name} long")
    found, groups = C.match_markers(frame(targets, "target"), frame(markers, "marker"), ["g"])
    got = {(r.g, r.target): (r.marker, r.cm_distance, r.bp_distance) for r in found.collect()}
    state = {r.g: (r.n_targets, r.n_markers, r.matched) for r in groups.collect()}
    want = {}
    for g in range(30):
        t, m = sorted(x[1:] for x in targets if x[0] == g), sorted(x[1:] for x in markers if x[0] == g)
        if t or m:
            assert state[g] == (len(t), len(m), len(t) <= len(m))
        taken = -1
        for k, (cm, bp, name) in enumerate(t if len(t) <= len(m) else []):
            open_ = [i for i in range(len(m)) if taken < i <= len(m) - len(t) + k]
            before, behind = [i for i in open_ if m[i][0] < cm][-1:], [i for i in open_ if m[i][0] >= cm][:1]
            taken = min(before + behind, key=lambda i: (abs(m[i][0] - cm), abs(m[i][1] - bp), m[i][2]))
            want[g, name] = (m[taken][2], abs(m[taken][0] - cm), abs(m[taken][1] - bp))
    assert got == want and len(want) > 30 and not all(s[2] for s in state.values())


@pytest.mark.parametrize("size", [0.3, 5.0, 1000.0])
def test_neighbours_across_buckets(spark, size):
    rng = random.Random(2)
    rows = [(k, rng.choice([0.0, 0.5, 1.25, 7.0, 7.1, 30.0, 30.0, 99.0, rng.random() * 40]), i) for k in "ab" for i in range(30)] + [("one", 3.0, 0)]
    got = {}
    for r in W.map_weights(spark.createDataFrame(rows, "k string, cm double, i long"), ["k"], size=size).collect():
        got.setdefault(r.k, []).append((r.cm, round(r.weight, 9)))
    for k in ("a", "b", "one"):
        cms = sorted(c for x, c, _ in rows if x == k)
        edges = [cms[0], *((x + y) / 2 for x, y in zip(cms, cms[1:])), cms[-1]]
        assert np.allclose(sorted(got[k]), sorted((c, round(y - x, 9)) for c, x, y in zip(cms, edges, edges[1:])), atol=1e-8)
    d = spark.createDataFrame([("a", i, i if i % 7 == 3 else None) for i in range(60)], "k string, pos long, v long")
    for r in axis.with_known(d, ["k"], "v", size=8).collect():
        known = [i for i in range(60) if i % 7 == 3]
        assert (r._left, r._right) == (max((i for i in known if i < r.pos), default=None), min((i for i in known if i > r.pos), default=None))


def test_permutation_keeps_margins_in_strata(spark):
    rng = random.Random(3)
    cells = {(s, f"e{e}"): rng.choice([1, 1, 2]) for s in range(40) for e in range(30) if rng.random() < 0.2}
    closed = [(s, f"e{e}") for s in range(40) for e in range(30) if (s, f"e{e}") not in cells and rng.random() < 0.1]
    c = spark.createDataFrame([(s, e, d, s % 3) for (s, e), d in cells.items()], "sample_id long, event string, dosage long, stratum long")
    missing = spark.createDataFrame(closed, "sample_id long, event string")
    after, mixing = M.permute_carriers(c, missing, 4)
    rows = [tuple(r) for r in after.select("sample_id", "event", "dosage", "stratum").collect()]
    assert len({r[:2] for r in rows}) == len(rows) == len(cells) and not {r[:2] for r in rows} & set(closed)
    before = [(s, e, d, s % 3) for (s, e), d in cells.items()]
    for key in (lambda r: (r[0], r[2]), lambda r: (r[1], r[2], r[3]), lambda r: (r[0], r[3])):
        assert Counter(map(key, rows)) == Counter(map(key, before))
    moved = {r[:2] for r in rows} - set(cells)
    assert sum(r.moved for r in mixing.collect()) == len(moved) > 0.3 * len(cells) and all(0 <= r.moved_share <= 1 and r.swaps >= r.moved / 2 for r in mixing.collect())
    same, still = M.permute_carriers(c, missing, 0)
    assert same.count() == len(cells) and {r.moved for r in still.collect()} == {0}
    assert M.permute_carriers(c.limit(0), missing, 2)[1].count() == 0


def test_matching_is_optimal_and_large_parts_fit():
    rng = random.Random(4)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        gain = [[rng.choice([0, 0, 1, 2, 3, 9]) for _ in range(m)] for _ in range(n)]
        got = matching((i, j, gain[i][j]) for i in range(n) for j in range(m))
        wide = max(n, m)
        best = max(sum(gain[i][p[i]] for i in range(n) if p[i] < m) for p in permutations(range(wide), n))
        assert sum(gain[i][j] for i, j in got) == best and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    chain = [(i, i + k, rng.randint(1, 10_000)) for i in range(50_000) for k in (0, 1)]
    assert len(matching(chain)) > 40_000 and matching([]) == set() and matching([(0, 0, 0)]) == set()


def test_transition_scores(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        at = sorted(rng.sample(range(200), 12))
        rows += [(k, c / 10, rng.choice("ab"), rng.choice("ab")) for c in at]
    d = spark.createDataFrame(rows, "k long, pos double, truth string, call string")
    side = lambda c: d.select("k", "pos", F.col(c).alias("label"))
    got = {r.tolerance: r for r in A.transition_scores(side("truth"), side("call"), ["k"], [0.5, 3.0]).collect()}
    for tol in (0.5, 3.0):
        n_t = n_c = matched = 0
        span, errors = 0.0, 0.0
        for k in range(12):
            x = [r for r in rows if r[0] == k]
            span += x[-1][1] - x[0][1]
            change = lambda c: [((a[1] + b[1]) / 2, a[c], b[c]) for a, b in zip(x, x[1:]) if a[c] != b[c]]
            t, c = change(2), change(3)
            n_t, n_c = n_t + len(t), n_c + len(c)
            best = (0, 0.0)

            def walk(i, used, n, e):
                nonlocal best
                if i == len(t):
                    best = max(best, (n, -e))
                    return
                walk(i + 1, used, n, e)
                for j in range(len(c)):
                    if j not in used and c[j][1:] == t[i][1:] and abs(c[j][0] - t[i][0]) <= tol:
                        walk(i + 1, used | {j}, n + 1, e + abs(c[j][0] - t[i][0]))

            walk(0, frozenset(), 0, 0.0)
            matched, errors = matched + best[0], errors - best[1]
        r = got[tol]
        assert (r.n_truth, r.n_called, r.matched) == (n_t, n_c, matched)
        assert r.false_per_morgan == pytest.approx((n_c - matched) / (span / 100)) and r.mean_error == pytest.approx(errors / matched, abs=1e-5) and r.f1 == pytest.approx(2 * matched / (n_t + n_c))
    none = A.transition_scores(side("truth").limit(0), side("call").limit(0), ["k"], [0.5]).first()
    assert (none.n_truth, none.matched, none.f1, none.false_per_morgan) == (0, 0, None, None)


def test_permutation_pairs_carriers_once_a_round(spark, monkeypatch):
    """What a round pairs is stored before both its uses, not made again for each."""
    from strandlake.operators import models as M

    rng = random.Random(9)
    cells = sorted({(rng.randrange(20), f"e{rng.randrange(15)}") for _ in range(120)})
    c = spark.createDataFrame([(s, e, 1, s % 2) for s, e in cells], "sample_id long, event string, dosage long, stratum long")
    kept, whole = [], M.stored
    monkeypatch.setattr(M, "stored", lambda d: kept.append(d.columns) or whole(d))
    after, mixing = M.permute_carriers(c, c.limit(0).select("sample_id", "event"), 2)
    got = [(r.sample_id, r.event) for r in after.collect()]
    assert sum("s1" in columns for columns in kept) == 4 and not any("_k" in columns for columns in kept)
    assert len(set(got)) == len(cells) and Counter(s for s, _ in got) == Counter(s for s, _ in cells) and Counter(e for _, e in got) == Counter(e for _, e in cells)
    assert sum(r.moved for r in mixing.collect()) == len(set(got) - set(cells)) > 0


def test_transitions_match_once_for_all_tolerances(spark, monkeypatch):
    """Boundaries meet in one pass, and those that could only match each other need no search."""
    gathered, searched, whole = [], [], A._gathered
    monkeypatch.setattr(A, "_gathered", lambda *a: gathered.append(a) or whole(*a))
    d = spark.createDataFrame([(k, float(x), "ab"[x // 2 % 2]) for k in range(5) for x in range(20)], "k long, pos double, label string")
    got = A.transition_scores(d, d, ["k"], [0.0, 0.5, 1.0]).collect()
    assert len(gathered) == 1 and sorted((r.tolerance, r.matched, r.mean_error) for r in got) == [(t, 45, 0.0) for t in (0.0, 0.5, 1.0)]
    monkeypatch.setattr("strandlake.functions.assignment.matching", lambda pairs: searched.extend(pairs) or set())
    at, labels = np.arange(4.0), np.array(list("abab"))
    assert A._matched(at, labels, labels, at + 0.25, labels, labels, 0.5, True) == [(x, x + 0.25) for x in at.tolist()] and not searched


def brute_ami(table):
    t = sum(table.values())
    a, b = Counter(), Counter()
    for (x, y), n in table.items():
        a[x] += n
        b[y] += n
    lg = lambda n: math.lgamma(n + 1)
    mi = sum(n / t * math.log(n * t / (a[x] * b[y])) for (x, y), n in table.items() if n)
    emi = sum(n / t * math.log(n * t / (p * q)) * math.exp(lg(p) + lg(q) + lg(t - p) + lg(t - q) - lg(t) - lg(n) - lg(p - n) - lg(q - n) - lg(t - p - q + n)) for p in a.values() for q in b.values() for n in range(max(1, p + q - t), min(p, q) + 1))
    h = lambda c: -sum(n / t * math.log(n / t) for n in c.values())
    return (mi - emi) / ((h(a) + h(b)) / 2 - emi)


def test_adjusted_information_equals_brute_force(spark):
    rng = random.Random(6)
    for k in range(3):
        table = {(x, y): rng.choice([0, 1, 2, 30, 200]) for x in range(4) for y in range(3)}
        got = A.adjusted_information(spark.createDataFrame([(*k, n) for k, n in table.items()], "la long, lb long, n long")).first()
        assert got.ami == pytest.approx(brute_ami({k: n for k, n in table.items() if n}), abs=1e-9) and not got.degenerate
    same = spark.createDataFrame([(i, i, 5) for i in range(4)], "la long, lb long, n long")
    assert A.adjusted_information(same).first().ami == pytest.approx(1)
    for rows in ([(0, 0, 5), (0, 1, 3)], [(i, i, 1) for i in range(4)][:1], []):
        r = A.adjusted_information(spark.createDataFrame(rows, "la long, lb long, n long")).first()
        assert r.degenerate and r.ami is None
    x = np.array([1, 1.5, 2, 3, 8.9, 9, 10, 1e3, 1e9])
    assert A.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-13)


def test_paired_bootstrap(spark):
    rng = np.random.default_rng(7)
    x = [(int(g), "uv"[g % 2], float(a), None if i % 40 == 0 else float(a + 1 + rng.normal())) for i, (g, a) in enumerate(zip(rng.integers(0, 30, 400), rng.normal(0, 10, 400)))]
    d = spark.createDataFrame(x, "g long, s string, a double, b double")
    r = T.bootstrap_delta(d, "g", "a", "b", 400).first()
    full = [(g, a, b) for g, _, a, b in x if b is not None]
    assert r.base == pytest.approx(np.mean([a for _, a, _ in full])) and r.delta == pytest.approx(np.mean([b - a for _, a, b in full]))
    assert r.low < r.delta < r.high and r.high - r.low < 1  # the pairing takes the spread of the values out
    again = []
    for _ in range(400):
        pick = Counter(rng.integers(0, 30, 30).tolist())
        w = sum(pick[g] for g, *_ in full)
        again.append(sum(pick[g] * (b - a) for g, a, b in full) / w)
    assert np.quantile(again, [0.025, 0.975]) == pytest.approx([r.low, r.high], abs=0.08)
    s = T.bootstrap_delta(d, "g", "a", "b", 100, stratum="s").first()
    means = [np.mean([b - a for _, t, a, b in x if b is not None and t == u]) for u in "uv"]
    assert s.delta == pytest.approx(np.mean(means))


def test_scores_with_nulls_and_no_rows(spark):
    d = spark.createDataFrame([([0.5, 0.5, 0.0], [1.0, 0.0, 0.0], 0, 0), (None, [1.0, 0.0, 0.0], 0, 0), ([1.0, 0.0, 0.0], [1.0, 0.0, 0.0], None, 0)], "p array<double>, q array<double>, y long, z long")
    r = E.diploid_brier(d, ("p", "q"), ("y", "z")).first()
    assert (r.n, r.brier) == (1, 0.125)
    assert E.diploid_brier(d.limit(0), ("p", "q"), ("y", "z")).first().brier is None
    assert [(x.ancestry, x.n, x.mae) for x in E.dose_errors(d.select("q", "z"), "q", "z", [[2.0], [1.0], [0.0]]).collect()] == [(0, 3, 0.0)]
    assert W.geometric_sites(1, 10) == 1 and W.geometric_sites(2, 10) == 2 and W.geometric_sites(11, 10) == 2 and W.geometric_sites(12, 10) == 3
    with pytest.raises(ValueError):
        W.sweep_classes(spark.createDataFrame([], "sample_id long, chrom long, pos long"), [0], [1], [2])
