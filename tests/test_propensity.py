import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.config import UNVACCINATED, VACCINATED, StudyConfig
from episodica.functions.random import fold
from episodica.operators import balance as bal
from episodica.operators import matrix as mx
from episodica.operators import propensity as ps
from tests.helpers import day

CONFIG = StudyConfig(lambda_exponents=(0.0, -2.0, -0.25), folds=3, lasso_tol=1e-8)


@pytest.fixture(scope="module")
def confounded(spark):
    """Arms that depend on two of twelve flags."""
    rng = np.random.default_rng(5)
    n, k = 600, 12
    x = (rng.random((n, k)) < 0.3).astype(float)
    p = 1 / (1 + np.exp(-(-0.4 + 1.8 * x[:, 0] - 1.6 * x[:, 1])))
    arm = (rng.random(n) < p).astype(int)
    members = spark.createDataFrame(
        [(i, day(i % 9), ("unvaccinated", "vaccinated")[arm[i]]) for i in range(n)],
        "person_id long, index_date date, group string").cache()
    flags = spark.createDataFrame(
        [(i, f"f{j:02d}", 1.0) for i in range(n) for j in range(k) if x[i, j]],
        "person_id long, covariate string, value double").cache()
    return x, arm, members, flags


def test_selection_finds_the_confounders(spark, confounded):
    x, arm, members, flags = confounded
    names = mx.covariate_names(flags)
    vectors = mx.flag_vectors(members, flags, names).cache()
    path = ps.lasso_path(vectors, flags, members, CONFIG)
    assert path.count() == len(CONFIG.lambdas())
    penalty = ps.one_se_lambda(path)
    chosen = {r.covariate: r.coefficient for r in ps.lasso_selected(vectors, names, penalty).collect()}
    assert chosen["f00"] > 0 > chosen["f01"]
    best = min(path.collect(), key=lambda r: r.mean_loss)
    assert penalty >= best["lambda"]

    # folds, losses and standard errors by hand for the empty model
    folds = {r.person_id: r.fold for r in members.select(
        "person_id", fold("person_id", CONFIG.folds, CONFIG.seed).alias("fold")).collect()}
    f = np.array([folds[i] for i in range(len(arm))])
    losses = []
    for k in range(CONFIG.folds):
        q = arm[f != k].mean()
        y = arm[f == k]
        losses.append(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    empty = path.where("not fitted").first()
    assert empty.mean_loss == pytest.approx(np.mean(losses))
    assert empty.se_loss == pytest.approx(np.std(losses, ddof=1) / np.sqrt(CONFIG.folds))


def test_empty_model_from_the_entry_penalty_on(spark, confounded):
    x, arm, members, flags = confounded
    names = mx.covariate_names(flags)
    vectors = mx.flag_vectors(members, flags, names).cache()
    everybody = ps._fold_facts(flags, members, CONFIG)[-1]
    gradient = np.abs(x.T @ (arm - arm.mean())) / len(arm) / x.std(axis=0, ddof=1)
    assert everybody.entry == pytest.approx(gradient.max())
    assert ps.lasso_selected(vectors, names, everybody.entry * 1.0001).count() == 0
    assert ps.lasso_selected(vectors, names, everybody.entry * 0.95).count() == 1


def test_fitted_part_of_the_path_equals_single_fits(spark, confounded):
    """Loss and optimality of the penalised fit on one training set."""
    x, arm, members, flags = confounded
    names = mx.covariate_names(flags)
    vectors = mx.flag_vectors(members, flags, names).cache()
    penalty = 0.03
    coefficients = {r.covariate: r.coefficient for r in
                    ps.lasso_selected(vectors, names, penalty, 1e-10).collect()}
    beta = np.array([coefficients.get(n, 0.0) for n in names])
    # intercept at its optimum
    b0 = 0.0
    for _ in range(50):
        mu = 1 / (1 + np.exp(-(b0 + x @ beta)))
        b0 += (arm - mu).sum() / (mu * (1 - mu)).sum()
    slope = x.T @ (arm - 1 / (1 + np.exp(-(b0 + x @ beta)))) / len(arm) / x.std(axis=0, ddof=1)
    assert np.all(np.abs(slope) <= penalty + 1e-4)
    assert np.allclose(slope[beta != 0], penalty * np.sign(beta[beta != 0]), atol=1e-4)


def test_scores_equal_a_logistic_fit_and_balance_improves(spark, confounded):
    x, arm, members, flags = confounded
    names = mx.covariate_names(flags)
    rows = flags.withColumn("kind", F.lit("discrete"))
    ages = members.select("person_id", F.lit("age").alias("covariate"),
                          (F.col("person_id") % 13 + 70).cast("double").alias("value"),
                          F.lit("continuous").alias("kind"))
    design = mx.design_vectors(members, rows.unionByName(ages), names[:2], []).cache()
    scores = ps.propensity_scores(design, CONFIG)
    got = np.array([r.ps for r in scores.orderBy("person_id").collect()])
    i = np.arange(len(arm))
    age = i % 13 + 70
    z = np.column_stack([np.ones(len(arm)), x[:, 0], x[:, 1], age, age ** 2, i % 9])
    z[:, 3:] = (z[:, 3:] - z[:, 3:].mean(axis=0)) / z[:, 3:].std(axis=0)
    b = np.zeros(z.shape[1])
    for _ in range(40):
        mu = 1 / (1 + np.exp(-z @ b))
        b += np.linalg.solve((z * (mu * (1 - mu))[:, None]).T @ z, z.T @ (arm - mu))
    assert np.allclose(got, 1 / (1 + np.exp(-z @ b)), atol=2e-3)

    persons = bal.overlap_weights(scores).withColumn("one", F.lit(1.0))
    smd = bal.before_after(bal.smd_discrete(flags, persons, {"before": "one", "after": "weight"}))
    found = {r.covariate: r for r in smd.collect()}
    assert found["f00"].smd_before > 0.3 and found["f00"].smd_after < 0.02
    assert found["f01"].smd_before > 0.3 and found["f01"].smd_after < 0.02


def test_sample_has_the_size_asked_for_and_does_not_move(spark):
    persons = spark.range(5000).withColumnRenamed("id", "person_id")
    for bins in (1 << 16, 8):
        sample = ps.sample_persons(persons, 700, 3, bins)
        ids = {r.person_id for r in sample.collect()}
        assert len(ids) == 700 == sample.count()
        again = ps.sample_persons(persons.repartition(11), 700, 3, bins)
        assert {r.person_id for r in again.collect()} == ids
    assert ps.sample_persons(persons, 9000, 3).count() == 5000
    assert ps.sample_persons(persons, 5000, 3).count() == 5000


def test_design_vector_by_hand(spark):
    members = spark.createDataFrame([(1, day(0), "vaccinated"), (2, day(1), "unvaccinated")],
                                    "person_id long, index_date date, group string")
    rows = spark.createDataFrame(
        [(1, "f", 1.0, "discrete"), (1, "other", 1.0, "discrete"), (1, "gender_Male", 1.0, "factor"),
         (1, "age", 80.0, "continuous"), (2, "observation_years", 2.5, "continuous")],
        "person_id long, covariate string, value double, kind string")
    got = {r.person_id: r for r in mx.design_vectors(members, rows, ["f"], ["gender_Male"]).collect()}
    n = len(mx.CONTINUOUS_NAMES)
    one, two = got[1].features.toArray(), got[2].features.toArray()
    assert len(one) == n + 4 and got[1].label == 1.0 and got[2].label == 0.0
    assert one[n - 2:].tolist() == [80.0, 0.0, 18628.0, 6400.0, 1.0, 1.0]
    assert two[n - 2:].tolist() == [0.0, 2.5, 18629.0, 0.0, 0.0, 0.0]


def test_sample_folds_and_index_dates_are_drawn_independently(spark):
    from episodica.functions.random import uniform

    persons = spark.range(20000).select(F.col("id").alias("person_id"))
    drawn = ps.sample_persons(persons, 4000, CONFIG.seed).select(
        uniform("person_id", CONFIG.seed, "index:AZ").alias("u"), fold("person_id", 5, CONFIG.seed).alias("fold")
    )
    sizes = [r["count"] for r in drawn.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 650
    low, mean, high = drawn.agg(F.min("u"), F.avg("u"), F.max("u")).first()
    assert low < 0.01 and high > 0.99 and abs(mean - 0.5) < 0.03


def test_folds_without_persons_are_left_out(spark, confounded):
    x, arm, members, flags = confounded
    left = members.where(fold("person_id", CONFIG.folds, CONFIG.seed) != 0)
    vectors = mx.flag_vectors(left, flags, mx.covariate_names(flags)).cache()
    few = StudyConfig(lambda_exponents=(0.0, -1.0, -0.5), folds=CONFIG.folds, lasso_tol=1e-8)
    path = ps.lasso_path(vectors, flags, left, few).collect()
    assert len(path) == len(few.lambdas())
    assert any(r.fitted for r in path) and all(np.isfinite([r.mean_loss, r.se_loss]).all() for r in path)
    with pytest.raises(ValueError):
        ps.lasso_path(vectors, flags, left.where(fold("person_id", CONFIG.folds, CONFIG.seed) == 1), few)


def test_models_apply_in_a_session_that_observed_metrics(spark, confounded):
    """The session of a model's training summary cannot be sent to tasks any more, once it manages observations."""
    from pyspark.sql import Observation

    x, arm, members, flags = confounded
    observed = Observation("rows")
    members.observe(observed, F.count("*").alias("n")).collect()
    assert observed.get["n"] == len(arm)
    names = mx.covariate_names(flags)
    vectors = mx.flag_vectors(members, flags, names).cache()
    few = StudyConfig(lambda_exponents=(0.0, -1.0, -0.5), folds=2, lasso_tol=1e-8)
    path = ps.lasso_path(vectors, flags, members, few).collect()
    assert len(path) == len(few.lambdas()) and any(r.fitted for r in path)
    scores = ps.propensity_scores(vectors.join(members.select("person_id", "group"), "person_id"), few)
    assert scores.where("ps > 0 and ps < 1").count() == len(arm)


def test_loss_of_a_training_part_with_one_arm_is_finite():
    assert ps.null_loss(10, 10, 5, 5) == pytest.approx(0, abs=1e-12)
    assert ps.null_loss(10, 0, 5, 1) == pytest.approx(-np.log(1e-15) / 5, rel=1e-9)


def test_optimality_certifies_the_fit_and_refuses_another(spark):
    rng = np.random.default_rng(8)
    n, k = 400, 12
    x = (rng.random((n, k)) < rng.uniform(0.1, 0.6, k)).astype(float)
    y = rng.random(n) < 1 / (1 + np.exp(-(x @ np.r_[1.5, -2.0, np.zeros(k - 2)])))
    persons = spark.createDataFrame([(i, VACCINATED if y[i] else UNVACCINATED) for i in range(n)], "person_id long, group string")
    flags = spark.createDataFrame([(i, f"f{j:02d}", 1.0) for i in range(n) for j in range(k) if x[i, j]], "person_id long, covariate string, value double")
    names = [f"f{j:02d}" for j in range(k)]
    vectors = mx.flag_vectors(persons, flags, names)
    coefficients, intercept = ps.lasso_model(vectors, names, 0.03, 1e-10)
    found = {r.covariate: r for r in ps.lasso_optimality(flags, persons, coefficients, intercept, 0.03).collect()}
    assert len(found) == k + 1 and not any(r.violated for r in found.values())
    chosen = {r.covariate: r.coefficient for r in coefficients.collect()}
    assert {"f00", "f01"} <= set(chosen) and len(chosen) < k
    b = np.array([chosen.get(c, 0.0) for c in names])
    slopes = x.T @ (1 / (1 + np.exp(-(x @ b + intercept))) - y) / n / x.std(axis=0, ddof=1)
    assert [found[c].slope for c in names] == pytest.approx(slopes.tolist())
    # One coefficient left out, one that is not zero, another intercept: each is no solution.
    fewer = coefficients.where("covariate <> 'f00'")
    more = fewer.unionByName(spark.createDataFrame([("f00", -chosen["f00"])], coefficients.schema))
    for wrong, start in ((fewer, intercept), (more, intercept), (coefficients, intercept + 1)):
        assert ps.lasso_optimality(flags, persons, wrong, start, 0.03).where("violated").count() > 0
    assert ps.lasso_optimality(flags, persons, coefficients, intercept + 1, 0.03).where("covariate is null and violated").count() == 1


def test_separation_and_scores_at_the_edges(spark):
    persons = spark.createDataFrame([(i, VACCINATED if i < 5 else UNVACCINATED) for i in range(10)], "person_id long, group string")
    held = {"both": range(10), "one arm": range(3), "other": range(7, 9), "stranger": [99], "zero": []}
    rows = [(i, "discrete", c, 1.0) for c, ids in held.items() for i in ids] + [(1, "factor", "level", 1.0), (1, "factor", "level", 1.0),
            (2, "continuous", "age", 1.0), (3, "discrete", "zero", 0.0)]
    table = spark.createDataFrame(rows, "person_id long, kind string, covariate string, value double")
    found = {(r.kind, r.covariate): (r.n_vaccinated, r.n_unvaccinated) for r in ps.separation(table, persons).collect()}
    assert found == {("discrete", "one arm"): (3, 0), ("discrete", "other"): (0, 2), ("factor", "level"): (1, 0)}
    scores = spark.createDataFrame([("a", 0.0), ("a", 1e-12), ("a", 0.5), ("b", 1.0), ("b", None), ("b", float("nan"))], "group string, ps double")
    assert {tuple(r) for r in ps.score_report(scores).collect()} == {("a", 3, 2, 0, 0), ("b", 3, 0, 1, 2)}
    assert ps.score_report(scores.where("false")).count() == 0
