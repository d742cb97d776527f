"""Partition-local moving, runs, consensus and confidence against brute force."""

import itertools
import random
from collections import Counter
from statistics import median

import pytest

from strandlake import registry
from strandlake.operators import communities as C
from strandlake.operators import graph as G
from strandlake.plans.lineage import cut
from strandlake.plans.q_graph import edges as pair_edges

from .oracle import DATA

Q = registry.queries()


def clique(nodes, w=1.0):
    return [(a, b, w) for a, b in itertools.combinations(nodes, 2)]


def graph(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, w double")


def modularity(rows, label, resolution=1.0):
    m = sum(w for *_, w in rows)
    k = Counter()
    for a, b, w in rows:
        k[label[a]] += w
        k[label[b]] += w
    return sum(w for a, b, w in rows if label[a] == label[b]) / m - resolution * sum((x / (2 * m)) ** 2 for x in k.values())


def planted(groups, size, seed):
    rng = random.Random(seed)
    nodes = range(groups * size)
    return [(a, b, 1.0) for a, b in itertools.combinations(nodes, 2) if rng.random() < (0.6 if a // size == b // size else 0.02)]


@pytest.fixture(params=[1 << 20, 40])
def blocks(request, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_EDGES", request.param)


def test_cliques_are_found(spark, blocks):
    two = clique(range(6)) + clique(range(10, 16)) + [(5, 10, 0.5)]
    found = {r.node: r.community for r in C.communities(graph(spark, two)).collect()}
    assert found == {n: 0 if n < 6 else 10 for *ab, _ in two for n in ab}
    ring = [e for k in range(8) for e in clique(range(5 * k, 5 * k + 5))] + [(5 * k, 5 * ((k + 1) % 8) + 1, 1.0) for k in range(8)]
    found = {r.node: r.community for r in C.communities(graph(spark, ring)).collect()}
    assert found == {n: n // 5 * 5 for n in range(40)}


def test_planted_groups_and_hubs(spark, monkeypatch):
    rows = planted(6, 15, 1) + [(1000, n, 0.05) for n in range(90)]
    whole = {r.node: r.community for r in C.communities(graph(spark, rows)).collect()}
    monkeypatch.setattr(C, "BLOCK_EDGES", 60)  # 1000 has more edges than a block
    parted = {(r.seed, r.node): r.community for r in C.communities(graph(spark, rows), [(1.0, 0), (1.0, 1)]).collect()}
    best = max(modularity(rows, {n: parted[s, n] for n in whole}) for s in (0, 1))
    truth = modularity(rows, {n: min(n, 999) // 15 for n in whole})
    assert modularity(rows, whole) >= truth - 1e-9 and best >= 0.9 * truth


def test_odd_graphs(spark):
    odd = graph(spark, [(1, 1, 5.0), (1, 2, 0.0), (3, 4, -1.0), (None, 2, 1.0), (5, None, 1.0), (6, 7, None)])
    assert C.communities(odd.filter("a is not null and b is not null")).count() == 0
    assert C.communities(graph(spark, [])).count() == 0
    one = C.communities(graph(spark, [(7, 3, 2.0), (4, 4, 9.0)])).collect()
    assert {(r.node, r.community) for r in one} == {(3, 3), (7, 3)}


def test_all_runs_equal_their_own(spark):
    rows = planted(4, 10, 2)
    runs = [(r, s) for r in (0.5, 1.0, 3.0) for s in range(2)]
    e = graph(spark, rows)
    found = C.communities(e, runs).collect()
    for r, s in runs[::3]:
        alone = {x.node: x.community for x in C.communities(e, [(r, s)]).collect()}
        assert alone == {x.node: x.community for x in found if (x.resolution, x.seed) == (r, s)}
    q = {(x.resolution, x.seed): x.q for x in C.modularities(e, spark.createDataFrame(found)).collect()}
    assert all(q[r, s] == pytest.approx(modularity(rows, {x.node: x.community for x in found if (x.resolution, x.seed) == (r, s)}, r)) for r, s in runs)
    groups = lambda r: len({x.community for x in found if (x.resolution, x.seed) == (r, 0)})
    assert groups(0.5) <= groups(1.0) <= groups(3.0)


def test_person_communities(spark):
    e = cut(pair_edges(spark, DATA))
    found = cut(Q["communities"](spark, DATA))
    q = G.modularity(e, found).first().q
    assert q > G.modularity(e, found.select("node", found.node.alias("community"))).first().q + 0.05
    assert found.count() == found.select("node").distinct().count() and found.filter("community > node").count() == 0
    runs = Q["community_runs"](spark, DATA).collect()
    assert len({(r.resolution, r.seed) for r in runs}) == 6 and len(runs) == 6 * 150
    for r in (0.5, 1.0):
        by = {x.seed: (x.q, x.chosen) for x in runs if x.resolution == r}
        assert [c for _, c in by.values()].count(True) == 1 and max(by.values())[1]
        size = Counter((x.seed, x.community) for x in runs if x.resolution == r and x.community is not None)
        assert min(size.values()) >= 3


def made_runs(spark):
    rng = random.Random(5)
    rows = [(run, n, None if rng.random() < 0.1 else (n // 4 if rng.random() < 0.8 else rng.randint(0, 4))) for run in range(4) for n in range(20)]
    rows += [(run, n, 9) for run in range(4) for n in (30, 31, 32)] + [(run, 40, None) for run in range(4)]
    return rows, spark.createDataFrame(rows, "run int, node long, community int")


def frequencies(rows):
    label, nodes = {(r, n): c for r, n, c in rows}, sorted({n for _, n, _ in rows})
    return nodes, {(a, b): sum(label[r, a] is not None and label[r, a] == label[r, b] for r in range(4)) / 4 for a in nodes for b in nodes if a != b}


def test_consensus_equals_brute_force(spark):
    rows, runs = made_runs(spark)
    pairs, members = C.co_assignment(runs)
    of = {r.node: r["class"] for r in members.collect()}
    found = {(r.class_a, r.class_b): r.frequency for r in pairs.collect()}
    nodes, want = frequencies(rows)
    assert sorted(of) == nodes and of[30] == of[31] == of[32] == 30
    for a, b in itertools.combinations(nodes, 2):
        x, y = sorted((of[a], of[b]))
        assert found.get((x, y), 0.0) == want[a, b]
    assert len(of) > len(set(of.values()))


def test_confidence_equals_brute_force(spark):
    rows, runs = made_runs(spark)
    chosen = {n: c for r, n, c in rows if r == 0}
    got = {r.node: (r.community, r.confidence) for r in C.assignment_confidence(runs, runs.filter("run = 0").select("node", "community")).collect()}
    nodes, f = frequencies(rows)
    for n in nodes:
        if chosen[n] is None:
            assert n not in got
        else:
            others = [f[n, o] for o in nodes if o != n and chosen[o] == chosen[n]]
            assert got[n] == (chosen[n], pytest.approx(median(others)) if others else None)
    assert Q["assignment_confidence"](spark, DATA).filter("confidence < 0 or confidence > 1").count() == 0
    assert Q["consensus"](spark, DATA).filter("frequency > 1 or frequency <= 0").count() == 0 and Q["consensus_classes"](spark, DATA).count() == 150
