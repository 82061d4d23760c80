"""Systematic error from negative controls, and intervals that allow for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.operators.survival import Z95


def _profile(points: DataFrame, by: list[str]) -> DataFrame:
    """Log-likelihood of each spread ``sigma`` with the mean that suits it best."""
    variance = F.col("sigma") * F.col("sigma") + F.col("se") * F.col("se")
    w, r = 1 / variance, F.col("log_rr")
    sums = points.groupBy(*by, "sigma").agg(
        F.sum(w).alias("sw"),
        F.sum(w * r).alias("swr"),
        F.sum(w * r * r).alias("swrr"),
        F.sum(F.log(variance)).alias("slog"),
        F.count("*").alias("n_controls"),
        F.max("step").alias("step"),
    )
    mu = F.col("swr") / F.col("sw")
    fit = -0.5 * (F.col("slog") + F.col("swrr") - F.col("swr") * mu)
    best = F.max_by(F.struct("sigma", mu.alias("mu"), "step", "n_controls"), fit)
    return sums.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def fit_error_model(
    estimates: DataFrame, by: list[str], grid: int = 1000, refine: int = 50
) -> DataFrame:
    """Mean and spread of the error of estimates whose true effect is none.

    ``estimates``: log_rr, se and the columns ``by``. log_rr ~ N(mu, sigma^2 + se^2).
    The likelihood is taken on a grid from zero to the range of the estimates and
    again between the neighbours of the best point.
    """
    known = estimates.where(F.col("log_rr").isNotNull() & F.col("se").isNotNull())
    stratum = Window.partitionBy(*by)
    reach = F.max("log_rr").over(stratum) - F.min("log_rr").over(stratum)
    points = known.withColumn("step", reach / grid).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("i")
    ).withColumn("sigma", F.col("step") * F.col("i")).drop("i")
    coarse = _profile(points.select(*by, "log_rr", "se", "step", "sigma"), by).select(
        *by, F.col("sigma").alias("around"), "step"
    )
    offsets = F.explode(F.sequence(F.lit(-refine), F.lit(refine)))
    near = known.join(coarse, by).select("*", offsets.alias("i"))
    near = near.withColumn("sigma", F.col("around") + F.col("step") * F.col("i") / refine)
    fine = _profile(near.where("sigma >= 0").select(*by, "log_rr", "se", "step", "sigma"), by)
    return fine.select(*by, "mu", "sigma", "n_controls")


def calibrate(estimates: DataFrame, model: DataFrame | None = None, by: list[str] | None = None,
              mu: float | None = None, sigma: float | None = None) -> DataFrame:
    """Estimates and 95 % intervals corrected by an error model (joined ``by``, or fixed)."""
    if model is None:
        joined = estimates.withColumn("mu", F.lit(mu)).withColumn("sigma", F.lit(sigma))
    else:
        joined = estimates.join(model.select(*by, "mu", "sigma"), by, "left")
    se = F.sqrt(F.col("se") * F.col("se") + F.col("sigma") * F.col("sigma"))
    shifted = joined.withColumn("cal_log_rr", F.col("log_rr") - F.col("mu")).withColumn("se_log", se)
    return shifted.select(
        *[c for c in joined.columns if c not in ("mu", "sigma")],
        F.exp("cal_log_rr").alias("cal_hr"),
        F.exp(F.col("cal_log_rr") - Z95 * F.col("se_log")).alias("cal_low95"),
        F.exp(F.col("cal_log_rr") + Z95 * F.col("se_log")).alias("cal_upper95"),
        F.col("se_log").alias("cal_se_log"),
        F.exp("se_log").alias("cal_exp_se"),
    )


def ci_coverage(estimates: DataFrame) -> DataFrame:
    """Estimates and share of significant ones per true effect (log_rr, se, true_log_rr)."""
    low, high = F.col("log_rr") - Z95 * F.col("se"), F.col("log_rr") + Z95 * F.col("se")
    off = ((low > F.col("true_log_rr")) | (high < F.col("true_log_rr"))).cast("double")
    known = estimates.where(F.col("log_rr").isNotNull() & F.col("se").isNotNull())
    return known.groupBy(F.exp("true_log_rr").alias("true_rr")).agg(
        F.count("*").alias("n_estimates"),
        F.avg(off).alias("share_significant"),
        (1 - F.avg(off)).alias("share_covered"),
    )
