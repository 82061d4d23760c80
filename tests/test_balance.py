import numpy as np
import pytest

from episodica.operators import balance as bal

PERSONS = "person_id long, group string, one double, weight double"
LONG = "person_id long, covariate string, value double"


def wtd(x, w):
    mean = (w * x).sum() / w.sum()
    return mean, (w * (x - mean) ** 2).sum() / (w.sum() - 1)


def test_moments_equal_the_dense_formula(spark):
    rng = np.random.default_rng(2)
    n = 200
    arm = rng.integers(0, 2, n)
    w = rng.uniform(0.1, 1, n)
    dense = {f"c{j}": np.where(rng.random(n) < 0.2 + 0.1 * j, rng.integers(1, 6, n), 0) for j in range(4)}
    dense["only_one_arm"] = np.where(arm == 1, 1, 0) * (rng.random(n) < 0.5)
    dense["constant"] = np.ones(n)
    persons = spark.createDataFrame(
        [(i, ("unvaccinated", "vaccinated")[arm[i]], 1.0, float(w[i])) for i in range(n)], PERSONS)
    rows = spark.createDataFrame(
        [(i, c, float(v[i])) for c, v in dense.items() for i in range(n) if v[i] != 0], LONG)
    for pooled, smd in ((True, bal.smd_discrete), (False, bal.smd_continuous)):
        found = {(r.covariate, r.weighting): r for r in
                 smd(rows, persons, {"before": "one", "after": "weight"}).collect()}
        for c, v in dense.items():
            for name, ww in (("before", np.ones(n)), ("after", w)):
                m1, v1 = wtd(v[arm == 1], ww[arm == 1])
                m2, v2 = wtd(v[arm == 0], ww[arm == 0])
                r = found[(c, name)]
                assert (r.mean1, r.mean2) == pytest.approx((m1, m2))
                assert (r.var1, r.var2) == pytest.approx((v1, v2), abs=1e-12)
                if c == "constant":
                    assert r.smd is None or r.smd < 1e-6
                else:
                    spread = np.sqrt((v1 + v2) / 2 if pooled else v1 + v2)
                    assert r.smd == pytest.approx(abs(m1 - m2) / spread)


def test_factor_difference_equals_the_matrix_formula(spark):
    rng = np.random.default_rng(8)
    n, k = 500, 7
    arm = rng.integers(0, 2, n)
    level = np.where(arm == 1, rng.integers(0, k, n), rng.integers(0, k - 1, n))
    w = rng.uniform(0.1, 1, n)
    persons = spark.createDataFrame(
        [(i, ("unvaccinated", "vaccinated")[arm[i]], 1.0, float(w[i])) for i in range(n)], PERSONS)
    factors = spark.createDataFrame(
        [(i, f"care_site_id_=_{level[i]}", 1.0) for i in range(n)], LONG)
    shares = bal.factor_shares(factors, persons, {"before": "one", "after": "weight"})
    found = {r.weighting: r.smd for r in bal.smd_factor(shares).collect()}
    for name, ww in (("before", np.ones(n)), ("after", w)):
        p = [np.array([ww[(arm == a) & (level == j)].sum() for j in range(k)]) / ww[arm == a].sum()
             for a in (1, 0)]
        s = sum(np.diag(q[1:]) - np.outer(q[1:], q[1:]) for q in p) / 2
        d = (p[0] - p[1])[1:]
        assert found[name] == pytest.approx(np.sqrt(d @ np.linalg.pinv(s) @ d))


def test_balanced_share_counts_unknown_as_unbalanced(spark):
    rows = spark.createDataFrame([("a", "w", 0.05), ("b", "w", 0.2), ("c", "w", None), ("d", "w", 0.1)],
                                 "covariate string, weighting string, smd double")
    r = bal.balanced_share(rows).first()
    assert (r.n_covariates, r.n_balanced, r.share_balanced) == (4, 2, 0.5)


def test_weights(spark):
    rows = spark.createDataFrame([(1, "vaccinated", 0.3), (2, "unvaccinated", 0.3), (3, "unvaccinated", 0.0)],
                                 "person_id long, group string, ps double")
    weighted = bal.overlap_weights(rows)
    assert {r.person_id: r.weight for r in weighted.collect()} == {1: 0.7, 2: 0.3, 3: 0.0}
    assert bal.drop_zero_weight(weighted).count() == 2


SHARES = [
    ([0.5, 0.5, 0.0], [0.0, 0.0, 1.0]), ([0.0, 0.0, 1.0], [0.5, 0.5, 0.0]), ([0.2, 0.3, 0.5, 0, 0], [0, 0, 0, 0.4, 0.6]),
    ([0, 0.1, 0, 0.9], [0.7, 0, 0.3, 0]), ([0.2, 0.8, 0], [0, 0.5, 0.5]), ([0, 0.5, 0.5], [0.25, 0.25, 0.5]),
    ([0, 0.3, 0.7], [0, 0.6, 0.4]), ([0.1, 0.2, 0.7], [0.3, 0.3, 0.4]), ([0.5, 0.5], [0.5, 0.5]), ([1.0], [1.0]),
    ([1e-9, 1 - 1e-9], [1 - 1e-9, 1e-9]), ([0.25] * 4 + [0] * 3, [0] * 4 + [0.1, 0.2, 0.7]),
]
# The left-out level alone against an even spread: no direction of the covariance tells them apart.
UNDEFINED = [([1.0, 0.0], [0.0, 1.0]), ([0.0, 1.0], [1.0, 0.0]), ([1.0, 0, 0], [0, 0.5, 0.5])]


def test_factor_smd_is_the_general_inverse_on_any_overlap(spark):
    rows = [(f"v{k}", f"l{j}", "w", float(x), float(y)) for k, (p, q) in enumerate(SHARES + UNDEFINED)
            for j, (x, y) in enumerate(zip(p, q))]
    table = spark.createDataFrame(rows, "variable string, covariate string, weighting string, p1 double, p2 double")
    found = {r.variable: r.smd for r in bal.smd_factor(table).collect()}
    assert len(found) == len(SHARES + UNDEFINED)
    for k, (p, q) in enumerate(SHARES):
        used = np.flatnonzero(np.array(p) + np.array(q))
        p, q = np.array(p)[used][1:], np.array(q)[used][1:]
        s = sum(np.diag(x) - np.outer(x, x) for x in (p, q)) / 2
        length = np.sqrt((p - q) @ np.linalg.pinv(s) @ (p - q)) if len(p) else 0.0
        assert found[f"v{k}"] == pytest.approx(length, rel=1e-6, abs=1e-12)
    assert [found[f"v{k}"] for k in range(len(SHARES), len(found))] == [None] * len(UNDEFINED)


def test_disjoint_arms_do_not_count_as_balanced(spark):
    persons = spark.createDataFrame([(i, "vaccinated" if i < 10 else "unvaccinated", 1.0) for i in range(20)],
                                    "person_id long, group string, one double")
    factors = spark.createDataFrame([(i, "region_A" if i < 10 else "region_B", 1.0) for i in range(20)], LONG)
    shares = bal.factor_shares(factors, persons, {"before": "one"})
    table = bal.smd_factor(shares).select("variable", "weighting", "smd")
    assert [r.smd for r in table.collect()] == [None]
    assert bal.balanced_share(table).first().n_balanced == 0
