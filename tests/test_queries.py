import pytest

from strandlake import registry

from . import oracle

Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return oracle.database()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    oracle.same(spark, Q[name], SQL[name], db)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())


def test_independent_set_is_the_sequential_one(spark):
    from strandlake.plans.q_graph import long_edges
    from strandlake.plans import domain as D

    taken = {r.node for r in Q["independent_set"](spark, oracle.DATA).collect()}
    calls: dict = {}
    for r in D.genotypes(spark, oracle.DATA).collect():
        calls.setdefault(r.sample_id, []).append(r.dosage is not None)
    near: dict = {}
    for r in long_edges(spark, oracle.DATA).collect():
        near.setdefault(r.a, set()).add(r.b)
        near.setdefault(r.b, set()).add(r.a)
    want: set = set()
    for node in sorted(calls, key=lambda n: (-sum(calls[n]) / len(calls[n]), n)):
        if not near.get(node, set()) & want:
            want.add(node)
    assert taken == want


def test_enrichment_matches_exact_sums(spark):
    from math import comb

    rows = Q["enrichment"](spark, oracle.DATA).collect()
    total = spark.read.parquet(f"{oracle.DATA}/customer.parquet").count()
    for r in rows[:25]:
        exact = sum(comb(r.of_level, k) * comb(total - r.of_level, r.in_group - k) for k in range(r.n, min(r.in_group, r.of_level) + 1)) / comb(total, r.in_group)
        assert abs(exact - r.p) < 1e-6
    ordered = sorted(rows, key=lambda r: r.p)
    assert all(x.q <= y.q + 1e-9 for x, y in zip(ordered, ordered[1:])) and all(r.q >= r.p - 1e-9 for r in rows)


def test_folds_keep_groups_and_balance(spark):
    rows = Q["grouped_folds"](spark, oracle.DATA).collect()
    folds: dict = {}
    for r in rows:
        folds.setdefault(r.grp, set()).add(r.fold)
    assert all(len(x) == 1 for x in folds.values())
    sizes = [sum(1 for x in folds.values() if x == {k}) for k in range(5)]
    assert max(sizes) - min(sizes) <= 2
    assert len(Q["fold_distance"](spark, oracle.DATA).collect()) == 5


def test_bootstrap_interval_holds_the_mean(spark):
    r = Q["bootstrap_mean"](spark, oracle.DATA).first()
    assert r.low < r.mean < r.high


def test_calibration_is_near_the_best_on_a_fine_grid(spark):
    import math

    from strandlake.plans.q_stats import scored

    rows = [(r.p, r.y) for r in scored(spark, oracle.DATA).collect()]

    def loss(t):
        total = 0.0
        for p, y in rows:
            a, b = (1 - p) ** (1 / t), p ** (1 / t)
            total -= math.log(max((b if y else a) / (a + b), 1e-12))
        return total / len(rows)

    got = Q["calibration"](spark, oracle.DATA).first()
    best = min(loss(math.exp(math.log(0.05) + (math.log(20) - math.log(0.05)) * k / 300)) for k in range(301))
    assert got.log_loss <= best + 1e-3


def test_factors_have_no_negative_entries(spark):
    assert {r.dominant for r in Q["graph_factors"](spark, oracle.DATA).collect()} <= {0, 1, 2}
