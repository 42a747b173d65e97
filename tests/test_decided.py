"""Decision rules, oversampling and filters on small frames."""

import numpy as np
import pytest

from tidewatch.operators import clustering, decisions, measurements, metrics, oversample


def test_agents_take_classes_in_turn():
    team = decisions.agent_assignment(5, ["BENIGN", "DoS", "Bot", "Other"])
    assert team == [(0, "agent_DoS", 1), (1, "agent_Bot", 2), (2, "agent_DoS_2", 1), (3, "agent_Bot_2", 2), (4, "agent_DoS_3", 1)]
    assert [f for *_, f in decisions.agent_assignment(2, ["BENIGN"])] == [1, 1]


def test_rules_without_attacks_and_with_null_flags(spark):
    rows = spark.createDataFrame([(1, 1, 0), (2, None, 0)], "id long, flag int, cls int")
    got = decisions.decision_rules(rows, rows, [(0, "a", 3)]).select("id", "agent", *decisions.RULES).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 3, 0), (2, 0, 0, 0, 0)]


def test_rules_take_smallest_class_on_ties(spark):
    rows = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, 0, 0), (4, 0, 0), (5, 0, 0)], "id long, flag int, cls int")
    got = decisions.decision_rules(rows, rows, [(0, "a", 3)]).orderBy("id").select("detector").collect()
    assert [r[0] for r in got] == [1, 1, 0, 0, 0]


def points(spark, rare, rest, seed=3):
    x = np.random.default_rng(seed).normal(size=(rare + rest, 3))
    return spark.createDataFrame([(i, [float(v) for v in row], int(i < rare)) for i, row in enumerate(x)], "id long, vec array<double>, y int")


def test_adasyn_rows_lie_between_origin_and_neighbor(spark):
    d = points(spark, 6, 20)
    made = oversample.adasyn(d, "id", "vec", "y", 1).collect()
    assert len(made) == 14 and {r["y"] for r in made} == {1}
    assert len({r["id"] for r in made}) == 14
    at = {r["id"]: np.array(r["vec"]) for r in d.collect()}
    rare = {r["id"] for r in d.where("y = 1").collect()}
    for r in made:
        a, b, x = at[r["origin"]], at[r["neighbor"]], np.array(r["vec"])
        assert {r["origin"], r["neighbor"]} <= rare and r["origin"] != r["neighbor"]
        share = (x - a) @ (b - a) / ((b - a) @ (b - a))
        assert 0 <= share < 1 and np.allclose(x, a + share * (b - a))
    again = oversample.adasyn(d.repartition(5), "id", "vec", "y", 1).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))


@pytest.mark.parametrize("rare,rest", [(0, 5), (1, 5), (5, 5), (6, 2)])
def test_adasyn_edge_sizes(spark, rare, rest):
    assert oversample.adasyn(points(spark, rare, rest), "id", "vec", "y", 1).count() == 0


def test_adasyn_deals_evenly_where_nothing_is_near(spark):
    rows = [(i, [float(i)], 1) for i in range(4)] + [(10 + i, [1e6 + i], 0) for i in range(10)]
    d = spark.createDataFrame(rows, "id long, vec array<double>, y int")
    got = oversample.adasyn_quotas(d, "id", "vec", "y", 1, k=2).orderBy("id").collect()
    assert [(r["crowd"], r["quota"]) for r in got] == [(0, 2), (0, 2), (0, 1), (0, 1)]


def test_chi2_quantiles():
    # Tables of the chi-squared distribution
    for p, m, want in ((0.95, 1, 3.841459), (0.95, 2, 5.991465), (0.99, 10, 23.209251), (0.95, 60, 79.081944)):
        assert abs(measurements.chi2_quantile(p, m) - want) < 1e-5


def test_kalman_equals_replay_and_finds_a_jump(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(80, 2))
    z[60] += 8
    rows = [(k, i, float(z[i][0]), float(z[i][1])) for k in ("a", "b") for i in range(80)]
    d = spark.createDataFrame(rows, "k string, t int, z0 double, z1 double")
    q, r = np.eye(2) * 1e-3, np.eye(2)
    got = measurements.kalman_chi2_by_key(d, "k", ["t"], ["z0", "z1"], np.eye(2), q, r, [0, 0]).where("k = 'b'").orderBy("t").collect()
    x, p, want = np.zeros(2), np.eye(2), []
    for row in z:
        p = p + q
        s = np.linalg.inv(p + r)
        want.append((row - x) @ s @ (row - x))
        g = p @ s
        x, p = x + g @ (row - x), (np.eye(2) - g) @ p
    assert np.allclose([g["adi"] for g in got], want)
    assert got[60]["alarm"] == 1 and sum(g["alarm"] for g in got) < 16


def test_network_layers():
    x = np.array([[1.0, -2.0]])
    y = measurements.mlp_forward(x, [("linear", [[1, 0], [0, 1]], [0, 1]), ("leaky_relu", 0.1), ("batch_norm", [0, 0], [1, 1], [2, 2], [1, 1], 0.0)])
    assert np.allclose(y, [[3.0, 0.8]])
    with pytest.raises(ValueError):
        measurements.mlp_forward(x, [("tanh",)])


def test_residual_embedding_orders_by_energy(spark):
    d = spark.createDataFrame([(1.0, -2.0, 3.0)], "a double, b double, c double")
    got = d.select(measurements.residual_embedding({"a": 1.0, "b": 5.0, "c": 5.0}, 4).alias("e")).first()["e"]
    assert got == [-2.0, 3.0, 1.0, 0.0]


def test_adaptive_filter_learns_noise_but_not_an_attack(spark):
    rng = np.random.default_rng(9)
    z = rng.normal(0, 3, size=300)
    z[200:210] += 60
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(z)], "k string, t int, z double")
    got = measurements.adaptive_kalman_by_key(d, "k", ["t"], ["z"], [[1]], [[1e-3]], [[4]], [0]).orderBy("t").collect()
    assert sum(g["adapted"] for g in got[:5]) == 0 and all(g["adapted"] == 1 - g["alarm"] for g in got[5:])
    assert all(g["alarm"] for g in got[200:210])
    assert sum(g["alarm"] for g in got[50:200]) < 30


def test_adaptive_filter_in_its_warm_up_is_the_plain_one(spark):
    z = np.random.default_rng(2).normal(size=(30, 2))
    d = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(z)], "k string, t int, z0 double, z1 double")
    args = (d, "k", ["t"], ["z0", "z1"], np.eye(2), np.eye(2) * 0.01, np.eye(2), [0, 0])
    a = [r["adi"] for r in measurements.adaptive_kalman_by_key(*args, warmup=30).orderBy("t").collect()]
    b = [r["adi"] for r in measurements.kalman_chi2_by_key(*args).orderBy("t").collect()]
    assert np.allclose(a, b)


def test_matching_equals_all_permutations():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 6):
        for _ in range(20):
            cost = rng.random((n, n)).round(1)
            want = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))
            assert abs(clustering.assignment_cost(cost) - want) < 1e-9


def test_evolution_finds_separate_groups(spark):
    rng = np.random.default_rng(4)
    homes = np.array([[0, 0], [20, 0], [0, 20], [20, 20]], float)
    x = np.concatenate([h + rng.normal(size=(30, 2)) for h in homes])
    d = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(999, None)], "id long, vec array<double>")
    centres, inertia = clustering.evolutionary_kmeans(d, "id", "vec", 4, population=4, generations=4, refine=5)
    assert np.allclose(sorted(map(tuple, np.round(np.array(centres) / 20))), sorted(map(tuple, homes / 20)))
    c = np.array(centres)
    want = ((x[:, None] - c[None]) ** 2).sum(-1).min(axis=1).sum()
    assert abs(inertia - want) < 1e-6 * want
    with pytest.raises(ValueError):
        clustering.evolutionary_kmeans(d.limit(0), "id", "vec", 2)


def test_a_rare_far_group_is_among_the_candidates_and_gets_a_centre(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 2))
    x[[5, 7000]] = [[300.0, 300.0], [301.0, 300.0]]
    d = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(-1, None)], "id long, vec array<double>").repartition(8)
    rows = d.where("vec is not null")
    found, weights = clustering.candidates(rows, "id", "vec", 3)
    assert len(found) <= 31 and weights.sum() == 20_000 and (found[:, 0] > 200).any()
    again, _ = clustering.candidates(rows.repartition(3), "id", "vec", 3)
    assert np.array_equal(found, again)
    centres, _ = clustering.evolutionary_kmeans(d, "id", "vec", 3, population=3, generations=3, refine=3)
    assert any(np.allclose(c, [300.5, 300.0]) for c in centres)


def test_candidates_of_equal_rows(spark):
    d = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "id long, vec array<double>")
    found, weights = clustering.candidates(d, "id", "vec", 4)
    assert found.tolist() == [[1.0, 2.0]] and weights.tolist() == [50]
    assert len(clustering.candidates(d.limit(0), "id", "vec", 4)[0]) == 0
    centres, inertia = clustering.evolutionary_kmeans(d, "id", "vec", 2, population=2, generations=2, refine=2)
    assert inertia == 0 and [1.0, 2.0] in centres


def test_agents_of_a_table_as_of_a_list(spark):
    for classes in (["BENIGN", "DoS", "Bot", "Other"], ["BENIGN"], [], ["BENIGN", "Other"]):
        table = spark.createDataFrame([(c, i) for i, c in enumerate(classes)] + [(None, 9)], "class string, idx int")
        for n in (0, 1, 5):
            got = [tuple(r) for r in decisions.assigned_agents(table, n).orderBy("agent").collect()]
            assert got == decisions.agent_assignment(n, classes)


def test_leaders_by_class_ignore_unknown_values(spark):
    rows = [("a", "f1", 1, 0.5), ("b", "f1", 1, None), ("c", "f1", 1, float("nan")), ("d", "f1", 1, 0.5), ("a", "fpr", 2, 0.1), ("b", "fpr", 2, 0.2), ("b", "f1", 2, None)]
    d = spark.createDataFrame(rows, "detector string, metric string, cls int, value double")
    got = {(r.metric, r.cls): (r.winner, r.runner_up) for r in metrics.leaderboard(d, {"f1": True, "fpr": False}, by=("cls",)).collect()}
    assert got == {("f1", 1): ("a", "d"), ("fpr", 2): ("a", "b")}
