"""Covariate balance between the arms, from the long covariate table.

Zeros are not stored. A sum over all persons equals the sum over stored rows, and
only the arm totals need the persons without a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.config import UNVACCINATED, VACCINATED

ARMS = ((1, VACCINATED), (2, UNVACCINATED))


def overlap_weights(scores: DataFrame) -> DataFrame:
    """Vaccinated persons weigh 1 - ps, unvaccinated persons ps."""
    weight = F.when(F.col("group") == VACCINATED, 1 - F.col("ps")).otherwise(F.col("ps"))
    return scores.withColumn("weight", weight)


def drop_zero_weight(persons: DataFrame) -> DataFrame:
    return persons.where(F.col("weight") != 0)


def arm_moments(covariates: DataFrame, persons: DataFrame, weights: dict[str, str]) -> DataFrame:
    """Weighted mean and variance of each covariate per arm, for each weighting.

    ``weights`` maps the name of a weighting to the column of ``persons`` that holds
    it. All weightings are summed in one pass.
    """
    in_arm = {k: F.col("group") == arm for k, arm in ARMS}
    totals = persons.agg(
        F.struct(
            *[
                F.sum(F.when(in_arm[k], F.col(c).cast("double"))).alias(f"{name}_{k}")
                for name, c in weights.items()
                for k, _ in ARMS
            ]
        ).alias("t")
    ).scalar()
    rows = covariates.join(persons.select("person_id", "group", *set(weights.values())), "person_id")
    x, sums = F.col("value"), []
    for name, c in weights.items():
        for k, _ in ARMS:
            w = F.when(in_arm[k], F.col(c).cast("double")).otherwise(0.0)
            sums += [F.sum(w * x).alias(f"{name}_{k}_x"), F.sum(w * x * x).alias(f"{name}_{k}_xx")]
    keys = [c for c in ("kind", "covariate") if c in covariates.columns]
    sums_by_covariate = rows.groupBy(*keys).agg(*sums).withColumn("t", totals)

    def moments(name: str) -> Column:
        fields = [F.lit(name).alias("weighting")]
        for k, _ in ARMS:
            total = F.col(f"t.{name}_{k}")
            sx, sxx = F.col(f"{name}_{k}_x"), F.col(f"{name}_{k}_xx")
            spread = sxx - F.try_divide(sx * sx, total)
            fields += [
                F.try_divide(sx, total).alias(f"mean{k}"),
                F.try_divide(spread, total - 1).alias(f"var{k}"),
            ]
        return F.struct(*fields)

    return sums_by_covariate.select(
        *keys, F.explode(F.array(*[moments(name) for name in weights])).alias("m")
    ).select(*keys, "m.*")


def with_smd(moments: DataFrame, pooled: bool) -> DataFrame:
    """Standardised mean difference; ``pooled`` halves the sum of the two variances."""
    spread = F.col("var1") + F.col("var2")
    spread = F.sqrt(F.greatest(spread / 2 if pooled else spread, F.lit(0.0)))
    return moments.withColumn(
        "smd", F.try_divide(F.abs(F.col("mean1") - F.col("mean2")), spread)
    )


def smd_discrete(covariates: DataFrame, persons: DataFrame, weights: dict[str, str]) -> DataFrame:
    return with_smd(arm_moments(covariates, persons, weights), pooled=True)


def smd_continuous(
    covariates: DataFrame, persons: DataFrame, weights: dict[str, str], pooled: bool = False
) -> DataFrame:
    return with_smd(arm_moments(covariates, persons, weights), pooled)


def factor_variable() -> Column:
    """The multi-level factor a factor covariate belongs to."""
    name = F.col("covariate")
    return (
        F.when(name.startswith("age_group_"), "age_group")
        .when(name.contains("care_site"), "care_site")
        .when(name.contains("region"), "region")
    )


def factor_shares(factors: DataFrame, persons: DataFrame, weights: dict[str, str]) -> DataFrame:
    """Weighted share of each level among the persons of an arm that have the factor."""
    rows = (
        factors.withColumn("variable", factor_variable())
        .where(F.col("variable").isNotNull())
        .join(persons.select("person_id", "group", *set(weights.values())), "person_id")
    )
    sums = [
        F.sum(F.when(F.col("group") == arm, F.col(c).cast("double")).otherwise(0.0)).alias(
            f"{name}_{k}"
        )
        for name, c in weights.items()
        for k, arm in ARMS
    ]
    levels = rows.groupBy("variable", "covariate").agg(*sums)
    whole = Window.partitionBy("variable")

    def shares(name: str) -> Column:
        return F.struct(
            F.lit(name).alias("weighting"),
            *[
                F.try_divide(F.col(f"{name}_{k}"), F.sum(f"{name}_{k}").over(whole)).alias(f"p{k}")
                for k, _ in ARMS
            ],
        )

    return (
        levels.withColumn("rows", F.array(*[shares(name) for name in weights]))
        .select("variable", "covariate", F.explode("rows").alias("s"))
        .select("variable", "covariate", "s.*")
    )


def smd_factor(shares: DataFrame) -> DataFrame:
    """Overall difference of a factor: the length of the share differences measured
    in the general inverse of the arms' mean multinomial covariance, one level left out.

    Where the arms share a level the covariance has an inverse: diag(a) minus two rank-one
    terms, which needs only sums over levels and the inverse of a 2 by 2 matrix. Where
    they share none, it falls apart into a block per arm. The block of the arm with the left-out
    level has an inverse; in the other block every difference between levels counts, but not
    their total, which has no variance. A difference that lies wholly in what has no variance
    has no length: null, never 0. Equal shares have 0, and so has a factor of one level.
    """
    p1, p2 = F.col("p1"), F.col("p2")
    a, d = (p1 + p2) / 2, p1 - p2
    one = Window.partitionBy("variable", "weighting")
    used = shares.where(a > 0).withColumn("left_out", F.min("covariate").over(one))
    kept = F.col("covariate") != F.col("left_out")

    def total(term: Column, where: Column = kept) -> Column:
        return F.coalesce(F.sum(F.when(where, term)), F.lit(0.0))

    first, other = F.when(p1 > 0, p1), F.when(p2 > 0, p2)
    # Of the arm that holds the left-out level, its share there; of the other arm, its levels and their inverse shares.
    in_first = F.max(F.when(~kept, p1 > 0))
    s = used.groupBy("variable", "weighting").agg(
        total(d * d / a).alias("q"),
        (1 - total(p1 * p1 / a) / 2).alias("m11"),
        (1 - total(p2 * p2 / a) / 2).alias("m22"),
        (total(p1 * p2 / a) / 2).alias("m12"),
        total(p1 * d / a).alias("b1"),
        total(p2 * d / a).alias("b2"),
        F.max((p1 > 0) & (p2 > 0)).alias("overlap"),
        F.max(F.when(~kept, p1 + p2)).alias("p_out"),
        F.when(in_first, F.count(other)).otherwise(F.count(first)).alias("m"),
        F.when(in_first, F.sum(1 / other)).otherwise(F.sum(1 / first)).alias("inverse"),
    )
    det = F.col("m11") * F.col("m22") - F.col("m12") * F.col("m12")
    quad = (
        F.col("b1") * F.col("b1") * F.col("m22")
        + 2 * F.col("b1") * F.col("b2") * F.col("m12")
        + F.col("b2") * F.col("b2") * F.col("m11")
    ) / 2
    regular = F.greatest(F.col("q") + F.try_divide(quad, det), F.lit(0.0))
    blocks = 2 * ((1 - F.col("p_out")) / F.col("p_out") + F.col("inverse") / (F.col("m") * F.col("m")) - 1)
    apart = F.when(blocks > 1e-12, blocks)
    length = F.when(F.col("overlap"), regular).otherwise(apart)
    return s.select("variable", "weighting", F.sqrt(length).alias("smd"))


def balance_table(
    discrete: DataFrame,
    continuous: DataFrame,
    factors: DataFrame,
    persons: DataFrame,
    weights: dict[str, str],
) -> DataFrame:
    """SMD of every covariate and of the multi-level factors, one row per weighting."""
    flags = discrete.select("person_id", "covariate", "value").unionByName(
        factors.select("person_id", "covariate", "value")
    )
    numbers = continuous.select("person_id", "covariate", "value")
    shares = factor_shares(factors, persons, weights)
    return (
        smd_discrete(flags, persons, weights).select("covariate", "weighting", "smd")
        .unionByName(
            smd_continuous(numbers, persons, weights).select("covariate", "weighting", "smd")
        )
        .unionByName(
            smd_factor(shares).select(F.col("variable").alias("covariate"), "weighting", "smd")
        )
    )


def before_after(balance: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """One row per covariate with its SMD under two weightings."""

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("weighting") == name, F.col("smd")))

    return balance.groupBy("covariate").agg(
        pick(before).alias("smd_before"), pick(after).alias("smd_after")
    )


def balanced_share(balance: DataFrame, limit: float = 0.1) -> DataFrame:
    """Share of covariates whose SMD lies within the limit; an unknown SMD does not."""
    inside = F.coalesce(F.abs(F.col("smd")) <= limit, F.lit(False))
    return balance.groupBy("weighting").agg(
        F.count("*").alias("n_covariates"),
        F.sum(inside.cast("int")).alias("n_balanced"),
        F.avg(inside.cast("double")).alias("share_balanced"),
    )


def score_histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    """Persons per arm and equal-width score bin."""
    bin_no = F.least(F.floor(F.col("ps") * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy("group", bin_no.alias("bin")).agg(F.count("*").alias("n"))
