"""Values of graph factors and of the interval of a partition contrast."""

import random

import numpy as np
import pytest

from strandlake.operators import contrasts as C
from strandlake.operators import graph as G


def test_factors_equal_numpy(spark):
    rng = random.Random(1)
    edges = [(a, b, round(rng.random(), 3)) for a in range(15) for b in range(a + 1, 15) if rng.random() < 0.5]
    e, n = spark.createDataFrame(edges, "a long, b long, w double"), spark.createDataFrame([(i,) for i in range(16)], "node long")
    start = {r.node: r.factor for r in G.sym_nmf(e, n, 3, 0).collect()}
    h, s = np.array([start[i] for i in range(16)]), np.zeros((16, 16))
    for a, b, w in edges:
        s[a, b] = s[b, a] = w
    before = np.linalg.norm(s - h @ h.T)
    for _ in range(6):
        h = h * (0.5 + 0.5 * (s @ h) / np.maximum(h @ (h.T @ h), 1e-12))
    got = {r.node: (r.factor, r.dominant) for r in G.sym_nmf(e, n, 3, 6).collect()}
    assert np.allclose([got[i][0] for i in range(16)], h) and [got[i][1] for i in range(16)] == h.argmax(1).tolist()
    assert np.linalg.norm(s - h @ h.T) < before and np.allclose(h[15], h[15].min() * 0 + got[15][0])


def test_contrast_interval(spark):
    rng = np.random.default_rng(2)
    people, pairs = range(60), []
    p, q, g = ({i: int(rng.integers(3)) for i in people} for _ in range(3))
    g = {i: i // 4 for i in people}
    for a in people:
        for b in range(a + 1, 60):
            pairs.append((a, b, float(rng.random() + 2 * (p[a] == p[b]))))
    frame = lambda d, c: spark.createDataFrame([(k, v) for k, v in d.items() if k != 59], f"node long, {c} long")
    x = spark.createDataFrame(pairs, "sample_a long, sample_b long, w double")
    r = C.paired_partition_contrast(x, frame(p, "community"), frame(q, "community"), "w", frame(g, "group"), 400).first()
    known = [(a, b, w) for a, b, w in pairs if b != 59]

    def contrast(weight):
        def delta(part):
            w, k = np.array([w for *_, w in known]), np.array([weight[g[a]] for a, *_ in known])
            same = np.array([part[a] == part[b] for a, b, _ in known])
            return np.average(w[same], weights=k[same]) - np.average(w[~same], weights=k[~same])

        return delta(p) - delta(q)

    assert (r.n_pairs, r.n_rejected) == (len(known), 59) and r.contrast == pytest.approx(contrast(np.ones(15)))
    again = [contrast(rng.poisson(1, 15) + 1e-12) for _ in range(300)]
    assert r.low < r.contrast < r.high and [r.low, r.high] == pytest.approx(np.quantile(again, [0.025, 0.975]).tolist(), abs=0.12)
    same = C.paired_partition_contrast(x, frame(p, "community"), frame(p, "community"), "w", frame(g, "group"), 20).first()
    assert same.contrast == same.low == same.high == 0
