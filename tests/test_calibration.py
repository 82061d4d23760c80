import numpy as np
import pytest

from episodica.operators import calibration as cal


def log_likelihood(r, se, mu, sigma):
    v = sigma ** 2 + se ** 2
    return -0.5 * (np.log(v) + (r - mu) ** 2 / v).sum()


def test_error_model_beats_a_two_dimensional_grid(spark):
    rng = np.random.default_rng(12)
    groups = {}
    rows = []
    for g, (mu, sigma) in {"a": (0.1, 0.2), "b": (-0.2, 0.0)}.items():
        se = rng.uniform(0.05, 0.3, 40)
        r = rng.normal(mu, np.sqrt(sigma ** 2 + se ** 2))
        groups[g] = (r, se)
        rows += [(g, float(x), float(s)) for x, s in zip(r, se)]
    rows += [("a", None, 0.1), ("a", 0.3, None)]
    estimates = spark.createDataFrame(rows, "g string, log_rr double, se double")
    for found in cal.fit_error_model(estimates, ["g"]).collect():
        r, se = groups[found.g]
        best = log_likelihood(r, se, found.mu, found.sigma)
        grid = max(log_likelihood(r, se, m, s) for m in np.linspace(-0.5, 0.5, 101)
                   for s in np.linspace(0, 0.6, 121))
        assert best >= grid - 1e-6
        assert found.n_controls == 40


def test_single_control_has_no_spread(spark):
    one = spark.createDataFrame([("a", 0.4, 0.1)], "g string, log_rr double, se double")
    r = cal.fit_error_model(one, ["g"]).first()
    assert (r.mu, r.sigma) == (pytest.approx(0.4), 0.0)


def test_calibrated_interval(spark):
    one = spark.createDataFrame([(0.5, 0.2)], "log_rr double, se double")
    r = cal.calibrate(one, mu=0.1, sigma=0.15).first()
    assert r.cal_hr == pytest.approx(np.exp(0.4))
    assert r.cal_se_log == pytest.approx(0.25)
    assert r.cal_upper95 == pytest.approx(np.exp(0.4 + 1.959963984540054 * 0.25))
    assert r.cal_exp_se == pytest.approx(np.exp(0.25))


def test_coverage(spark):
    rows = spark.createDataFrame(
        [(0.0, 0.1, 0.0), (0.3, 0.1, 0.0), (-0.3, 0.1, 0.0), (0.7, 0.1, 0.6931471805599453), (None, 0.1, 0.0)],
        "log_rr double, se double, true_log_rr double")
    found = {round(r.true_rr, 6): r for r in cal.ci_coverage(rows).collect()}
    assert found[1.0].n_estimates == 3 and found[1.0].share_significant == pytest.approx(2 / 3)
    assert found[2.0].share_covered == 1.0
