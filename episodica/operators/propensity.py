"""Propensity scores: choice of flags by LASSO, then a logistic model, with MLlib."""

from __future__ import annotations

import math
import uuid

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.config import VACCINATED, StudyConfig
from episodica.functions.random import fold, uniform
from episodica.sources.stages import shared_dir

PATH_SCHEMA = "lambda double, mean_loss double, se_loss double, fitted boolean"


class BareLogisticRegression(LogisticRegression):
    """Logistic regression whose models hold what prediction needs and no training summary.

    The summary refers to the session, and once metrics were observed in that (``Observation``) it cannot travel with the
    tasks that apply the model. A model that is written and read again comes without it.
    """

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        path = f"{shared_dir(dataset.sparkSession)}/models/{uuid.uuid4().hex}"
        super()._fit(dataset).write().save(path)
        return LogisticRegressionModel.load(path)


def sample_persons(persons: DataFrame, size: int, seed: int, bins: int = 1 << 16) -> DataFrame:
    """Exactly ``min(size, n)`` persons, the same ones on any partitioning.

    Persons are ordered by a hash. Bins of equal width are counted first; bins below
    the cut are taken whole and only the bin at the cut is ranked, so no task sees
    more than one bin.
    """
    keyed = persons.withColumn("_u", uniform("person_id", seed, "sample")).withColumn(
        "_bin", F.floor(F.col("_u") * bins).cast("int")
    )
    upto = Window.partitionBy(F.lit(1)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = keyed.groupBy("_bin").agg(F.count("*").alias("_n"))
    cut = (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .select("_bin", (F.lit(size) - F.col("_upto") + F.col("_n")).alias("_room"), "_n")
        .where("_room > 0")
    )
    placed = keyed.join(F.broadcast(cut), "_bin")
    whole = placed.where("_n <= _room")
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_u", "person_id"))
    edge = placed.where("_n > _room").withColumn("_rank", rank).where("_rank <= _room")
    return whole.select(*persons.columns).unionByName(edge.select(*persons.columns))


def _fold_facts(vectors_long: DataFrame, persons: DataFrame, config: StudyConfig) -> list:
    """Per fold: training size, vaccinated among them, and the smallest penalty that
    leaves no flag in the model trained without the fold. One pass; one row per fold."""
    k = config.folds
    labelled = persons.select(
        "person_id",
        (F.col("group") == VACCINATED).cast("double").alias("y"),
        fold("person_id", k, config.seed).alias("fold"),
    )
    # left-out fold k stands for "none left out": the model on all persons
    outs = F.explode(F.sequence(F.lit(0), F.lit(k)))
    sizes = labelled.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    sizes = sizes.select("*", outs.alias("out")).groupBy("out").agg(
        F.sum(F.when(F.col("fold") != F.col("out"), F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("fold") != F.col("out"), F.col("y")).otherwise(0)).alias("ny"),
        F.sum(F.when(F.col("fold") == F.col("out"), F.col("n")).otherwise(0)).alias("n_out"),
        F.sum(F.when(F.col("fold") == F.col("out"), F.col("y")).otherwise(0)).alias("ny_out"),
    )
    x = F.col("value")
    sums = (
        vectors_long.join(labelled, "person_id").groupBy("covariate", "fold")
        .agg(F.sum(x).alias("x"), F.sum(x * x).alias("xx"), F.sum(x * F.col("y")).alias("xy"))
        .select("*", outs.alias("out")).where("fold <> out")
        .groupBy("covariate", "out").agg(*[F.sum(c).alias(c) for c in ("x", "xx", "xy")])
        .join(F.broadcast(sizes), "out")
    )
    spread = F.sqrt(F.greatest((F.col("xx") - F.col("x") * F.col("x") / F.col("n")), F.lit(0.0))
                    / (F.col("n") - 1))
    slope = F.abs(F.col("xy") - F.col("x") * F.col("ny") / F.col("n")) / F.col("n")
    entry = sums.groupBy("out").agg(
        F.max(F.try_divide(slope, F.when(spread > 0, spread))).alias("entry")
    )
    return sizes.join(entry, "out", "left").orderBy("out").collect()


def null_loss(n: float, ny: float, n_out: float, ny_out: float) -> float:
    """Mean log-loss on left-out persons of the share of vaccinated in the others.

    A share of 0 or 1 is moved inside by 1e-15, as MLlib's log-loss does.
    """
    p = min(max(ny / n, 1e-15), 1 - 1e-15)
    return -(ny_out * math.log(p) + (n_out - ny_out) * math.log(1 - p)) / n_out


def lasso_path(
    vectors: DataFrame,
    flags: DataFrame,
    persons: DataFrame,
    config: StudyConfig = StudyConfig(),
    parallelism: int = 8,
) -> DataFrame:
    """Cross-validated log-loss for each penalty: its mean and standard error over folds.

    A penalty at or above the largest gradient of the empty model gives the empty
    model, whose loss follows from counts; the model is fitted for the others only.
    Folds without persons are left out; fewer than two folds are an error.
    ``vectors`` (person_id, label, features) should be a stage table.
    """
    spark = vectors.sparkSession
    facts = _fold_facts(flags, persons, config)
    held_out = [r for r in facts if r.out < config.folds and r.n_out]
    if len(held_out) < 2:
        raise ValueError("cross-validation needs persons in at least two folds")
    entry = max((r.entry or 0.0) for r in facts)
    losses = [null_loss(r.n, r.ny, r.n_out, r.ny_out) for r in held_out]
    k = len(losses)
    mean = sum(losses) / k
    se = math.sqrt(sum((x - mean) ** 2 for x in losses) / (k - 1) / k)
    lambdas = config.lambdas()
    fitted = [x for x in lambdas if x < entry]
    rows = [(x, mean, se, False) for x in lambdas if x >= entry]
    if fitted:
        lr = BareLogisticRegression(elasticNetParam=1.0, standardization=True, maxIter=100, tol=config.lasso_tol)
        grid = ParamGridBuilder().addGrid(lr.regParam, fitted).build()
        present = F.array(*[F.lit(r.out) for r in held_out])
        own = fold("person_id", config.folds, config.seed)
        folded = vectors.withColumn("fold", (F.array_position(present, own) - 1).cast("int"))
        cv = CrossValidator(
            estimator=lr,
            estimatorParamMaps=grid,
            evaluator=MulticlassClassificationEvaluator(metricName="logLoss"),
            numFolds=k,
            foldCol="fold",
            parallelism=parallelism,
        ).fit(folded)
        # stdMetrics divides by the number of folds; the standard error needs n - 1
        rows += [
            (x, float(m), float(s) / math.sqrt(k - 1), True)
            for x, m, s in zip(fitted, cv.avgMetrics, cv.stdMetrics)
        ]
    return spark.createDataFrame(rows, PATH_SCHEMA)


def one_se_lambda(path: DataFrame) -> float:
    """The largest penalty whose loss is within one standard error of the best."""
    rows = path.collect()
    best = min(rows, key=lambda r: r.mean_loss)
    return max(r["lambda"] for r in rows if r.mean_loss <= best.mean_loss + best.se_loss)


def lasso_model(
    vectors: DataFrame, names: list[str], penalty: float, tol: float = 1e-6
) -> tuple[DataFrame, float]:
    """Non-zero coefficients of the flags at a penalty, and the intercept."""
    lr = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, standardization=True, maxIter=100, tol=tol
    )
    model = lr.fit(vectors)
    chosen = [(n, float(c)) for n, c in zip(names, model.coefficients.toArray()) if c != 0]
    table = vectors.sparkSession.createDataFrame(chosen, "covariate string, coefficient double")
    return table, float(model.intercept)


def lasso_selected(
    vectors: DataFrame, names: list[str], penalty: float, tol: float = 1e-6
) -> DataFrame:
    """Flags with a non-zero coefficient at a penalty, with the coefficient."""
    return lasso_model(vectors, names, penalty, tol)[0]


def lasso_optimality(
    flags: DataFrame, persons: DataFrame, coefficients: DataFrame, intercept: float, penalty: float, slack: float = 0.01
) -> DataFrame:
    """Whether a solution of the penalised likelihood is one: the optimality condition of each flag, from the long table.

    The loss' slope along a flag, measured in its own spread as the penalty is, lies between -penalty and penalty; it
    is -penalty or penalty, against the sign of the coefficient, where that is not zero. ``slack`` is the share of the
    penalty by which a solver of finite tolerance may miss it. One row per flag: covariate, coefficient, slope, violated; the
    row without a flag is the intercept's, whose slope is 0.

    Persons hold many flags and flags many persons: fitted probabilities are a sum per person over the chosen flags (their
    number is bounded by the model), slopes a sum per flag with partial sums in the tasks.
    """
    chosen = F.broadcast(coefficients)  # as many rows as the fitted model has coefficients
    margins = flags.join(chosen, "covariate").groupBy("person_id").agg(F.sum(F.col("value") * F.col("coefficient")).alias("m"))
    y = (F.col("group") == VACCINATED).cast("double")
    score = 1 / (1 + F.exp(-(F.coalesce("m", F.lit(0.0)) + F.lit(intercept))))
    residuals = persons.select("person_id", "group").join(margins, "person_id", "left").select("person_id", (score - y).alias("r"))
    whole = residuals.agg(F.count("*").alias("n"), F.sum("r").alias("sum_r"))
    n = whole.select("n").scalar()
    x = F.col("value")
    sums = flags.select("person_id", "covariate", "value").join(residuals, "person_id").groupBy("covariate").agg(
        F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * F.col("r")).alias("sxr")
    )
    spread = F.sqrt(F.greatest(F.col("sxx") - F.col("sx") * F.col("sx") / n, F.lit(0.0)) / (n - 1))
    slopes = sums.withColumn("slope", F.try_divide(F.col("sxr") / n, F.when(spread > 0, spread))).join(chosen, "covariate", "left")
    b, slope = F.coalesce("coefficient", F.lit(0.0)), F.coalesce("slope", F.lit(0.0))
    off = F.when(b == 0, F.greatest(F.abs(slope) - penalty, F.lit(0.0))).otherwise(F.abs(slope + F.signum(b) * penalty))
    rows = slopes.select("covariate", b.alias("coefficient"), slope.alias("slope"), (off > slack * penalty).alias("violated"))
    free = whole.select(
        F.lit(None).cast("string").alias("covariate"), F.lit(intercept).alias("coefficient"), (F.col("sum_r") / F.col("n")).alias("slope"),
        (F.abs(F.col("sum_r") / F.col("n")) > slack * penalty).alias("violated"),
    )
    return rows.unionByName(free)


def separation(covariates: DataFrame, persons: DataFrame) -> DataFrame:
    """Flags and levels that one arm alone holds: (kind, covariate, n_vaccinated, n_unvaccinated).

    Each of them sends an unpenalised coefficient to infinity, so a model with them has no finite solution.
    """
    held = covariates.where("kind in ('discrete', 'factor') and value <> 0").select("kind", "covariate", "person_id").distinct()
    rows = held.join(persons.select("person_id", "group"), "person_id")
    vaccinated = (F.col("group") == VACCINATED).cast("long")
    counts = rows.groupBy("kind", "covariate").agg(F.sum(vaccinated).alias("n_vaccinated"), F.sum(1 - vaccinated).alias("n_unvaccinated"))
    return counts.where("n_vaccinated = 0 or n_unvaccinated = 0")


def score_report(scores: DataFrame, edge: float = 1e-8) -> DataFrame:
    """Per arm: persons, scores at (within ``edge`` of) 0 and 1, and scores that are missing or no number."""
    ps = F.col("ps")
    known = ps.isNotNull() & ~F.isnan(ps)
    return scores.groupBy("group").agg(
        F.count("*").alias("n"),
        F.count(F.when(known & (ps <= edge), 1)).alias("n_at_zero"),
        F.count(F.when(known & (ps >= 1 - edge), 1)).alias("n_at_one"),
        F.count(F.when(~known, 1)).alias("n_unknown"),
    )


def propensity_scores(
    vectors: DataFrame, config: StudyConfig = StudyConfig(), ridge: float | None = None
) -> DataFrame:
    """person_id, group and the probability of being vaccinated.

    The model is fitted on a sample of persons and applied to all. ``ridge`` (by default the study's) keeps it finite where
    :func:`separation` finds covariates of one arm.
    """
    ridge = config.ridge if ridge is None else ridge
    training = sample_persons(vectors, config.ps_sample_size, config.seed)
    lr = BareLogisticRegression(regParam=ridge, elasticNetParam=0.0, maxIter=100, tol=1e-8)
    model = lr.fit(training)
    scored = model.transform(vectors)
    return scored.select(
        "person_id", "group", vector_to_array("probability")[1].alias("ps")
    )
