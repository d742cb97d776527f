"""Audits on hand-made rows: each state and rule once, nulls, repeats and empty tables."""

from strandlake.operators import audits as X
from strandlake.operators import evaluation as E


def test_panel_states(spark):
    sites = spark.createDataFrame([("1", p, r, a) for p, r, a in ((1, "A", "C"), (2, "A", "C"), (3, "A", "T"), (4, "A", "C"), (5, "A", "C"), (6, "A", "C"), (7, "A", "C"), (8, None, "C"))], "chrom string, pos long, ref string, alt string")
    rows = spark.createDataFrame([("1", 1, "C", "A"), ("1", 2, "T", "G"), ("1", 3, "T", "A"), ("1", 4, "A", "G"), ("1", 5, "A", "C"), ("1", 5, "C", "A"), ("1", 6, "A", "."), ("1", 8, "A", "C"), ("1", 99, "A", "C")], "chrom string, pos long, a1 string, a2 string")
    got = {r.pos: (r.state, r.n_rows, r.n_pairs) for r in X.panel_correspondence(sites, rows).collect()}
    assert got == {1: ("direct", 1, 1), 2: ("complement", 1, 1), 3: ("palindromic_ambiguous", 1, 1), 4: ("mismatch", 1, 1), 5: ("multiple", 2, 1), 6: ("unsupported", 1, 0), 7: ("no_row", 0, 0), 8: ("mismatch", 1, 1)}
    assert X.panel_correspondence(sites, rows.limit(0)).filter("state <> 'no_row'").count() == 0


def test_phase_and_transfer(spark):
    d = spark.createDataFrame([(0, 5, 5), (3, 1, 9), (3, 0, 2), (3, 0, 0), (None, None, None)], "c long, k long, u long")
    assert [r[0] for r in d.select(X.phase_state("c", "k", "u")).collect()] == ["UNEVALUABLE_CALLABILITY", "PRESENT", "UNEVALUABLE_PHASE", "ABSENT", "UNEVALUABLE_CALLABILITY"]
    rows = [("a", 1, "PRESENT"), ("a", 2, "PRESENT"), ("a", 2, "PRESENT"), ("b", 1, "PRESENT"), ("b", 1, "UNEVALUABLE_PHASE"), ("b", 2, "UNEVALUABLE_PHASE"), ("c", 1, "PRESENT"), ("c", 2, "ABSENT"), ("c", 1, "UNEVALUABLE_PHASE")]
    got = {r.g: (r.n_present, r.n_open, r.decision) for r in X.transfer_decision(spark.createDataFrame(rows, "g string, pattern long, state string"), "g").collect()}
    assert got == {"a": (2, 0, "PASS"), "b": (1, 1, "INCONCLUSIVE"), "c": (1, 0, "STOP")}


def test_call_support(spark):
    calls = [(1, [0, 1], True), (2, [1, 1], False), (3, [None, 1], True), (4, [1], True), (5, None, None), (6, [], None), (7, [1, 1, 1], True), (8, [2, 0], True)]
    c = spark.createDataFrame([(s, "1", 9, g, p, 1) for s, g, p in calls], "sample_id long, chrom string, pos long, alleles array<int>, phased boolean, allele int")
    people = spark.createDataFrame([(s, "fit", "x" if s % 2 else "y") for s in range(1, 9)], "sample_id long, role string, ancestry string")
    got = {r.ancestry: tuple(r)[4:] for r in X.call_support(c, people).collect()}
    # complete, missing, not diploid, ac, an, carriers, phased, phased carriers, homozygous
    assert got == {"ALL": (3, 3, 2, 3, 6, 2, 2, 1, 1), "x": (1, 2, 1, 1, 2, 1, 1, 1, 0), "y": (2, 1, 1, 2, 4, 1, 1, 0, 1)}


def test_matrix_order_and_sites(spark):
    g = spark.createDataFrame([(s, c, p, None if (s, p) in ((1, 1), (2, 1)) else (s + p) % 3) for s in (1, 2, 3) for c in (1, 2) for p in (1, 2)], "sample_id long, chrom long, pos long, dosage long")
    got = {r.chrom: (r.n_input, r.n_dropped, r.n_retained, r.nnz, r.n_people) for r in X.matrix_summary(g, (1, 2)).collect()}
    assert got == {1: (2, 1, 1, 2, 3), 2: (2, 1, 1, 2, 3), None: (4, 2, 2, 4, 3)}
    none = X.matrix_summary(g.limit(0), (1, 2)).collect()
    assert [(r.chrom, r.n_input, r.sparsity) for r in none] == [(None, 0, None)]
    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "at long, sample_id string")
    b = spark.createDataFrame([(0, "x"), (1, "z")], "at long, sample_id string")
    assert {tuple(r) for r in X.order_differences(a, b).collect()} == {(1, "y", "z"), (2, "z", None)} and X.order_differences(a, a).count() == 0
    sites = spark.createDataFrame([(1, 0, 5, "A", "C", "fit"), (1, 1, 4, "A", "C", "fit"), (1, 2, 4, "A", "A", "fit"), (1, 3, 9, "A", None, "fit"), (1, 0, 5, "A", "C", "select"), (2, 9, 1, "N", "C", "fit")], "chrom long, at long, pos long, ref string, alt string, role string")
    assert {r.rule: r.n for r in X.site_contract(sites).collect()} == {"unsorted": 1, "alleles": 3, "repeated": 1, "role_overlap": 1}
    assert X.site_contract(sites.limit(0)).count() == 0


def test_roles_and_units(spark):
    u = spark.createDataFrame([(1, "fit", "p", "h"), (2, "fit", "q", None), (3, "select", "p", "i"), (4, "select", "", "i"), (5, "other", "q", "h")], "unit long, role string, person string, home string")
    got = {r.axis: tuple(r)[1:] for r in X.role_separation(u, ["person", "home"], "fit", "select").collect()}
    assert got == {"person": (2, 1, 1, 1), "home": (1, 1, 0, 1)}
    shared = {(r.unit, r.axis): (r.n_identities, r.n_shared) for r in X.unit_overlaps(u, ["person", "home"]).collect()}
    assert shared[1, "person"] == (1, 1) and shared[2, "person"] == (1, 1) and shared[3, "home"] == (1, 0) and shared[1, "home"] == (1, 1) and (2, "home") not in shared


def test_balance_floors_and_crosstab(spark):
    t = spark.createDataFrame([("a", True), ("a", False), ("a", False), ("b", True), ("b", False), ("c", False)], "s string, p boolean")
    got = {r.s: (r.n_positive, r.n_zero, r.achieved_ratio, r.saturated) for r in X.target_balance(t, "s", "p", 2).collect()}
    assert got == {"a": (1, 2, 2.0, False), "b": (1, 1, 1.0, True), "c": (0, 1, None, False)}
    people = spark.createDataFrame([(10, 0.9), (3, 1.0), (0, None), (20, 0.5)], "n_joint long, concordance double")
    r = X.concordance_summary(people, 5, 0.8).first()
    assert (r.n, r.n_joint_min, r.n_joint_median, r.concordance_min, r.concordance_median, r.n_below) == (4, 0, 6.5, 0.5, 0.9, 3)
    cells = {(x.a, x.b): (x.n, x.of_a, x.of_b) for x in X.crosstab(spark.createDataFrame([(1, None), (1, 2), (None, 2), (1, 2)], "a long, b long"), "a", "b").collect()}
    assert cells == {(1, None): (1, 1 / 3, 1.0), (1, 2): (2, 2 / 3, 2 / 3), (None, 2): (1, 1.0, 1 / 3)}


def test_founders_ask_for_a_silhouette_only_above_zero(spark):
    pairs = spark.createDataFrame([(1, 2, 90), (3, 4, 80), (1, 3, 10), (2, 4, 10)], "sample_a long, sample_b long, total_shared_bp long")
    lab = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 1)], "node long, community long")
    z = spark.createDataFrame([(0, 0.3)], "community long, silhouette double")
    found = lambda *a: {r.community for r in E.founder_candidates(pairs, lab, 2, 2.0, *a).collect()}
    assert found() == {0, 1} and found(z, 0.0) == {0, 1} and found(z, 0.2) == {0} and found(z, 0.4) == set() and found(None, 0.0, 3) == {1}
