"""Fine-Gray regression of one binary covariate, the arm, from sums per day.

Spark reduces persons to one row per analysis and day. Risk sets are running sums
over days, so a group has at most as many rows as the study has days.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.config import CENSORED, DEATH, EVENT, VACCINATED

Z95 = NormalDist().inv_cdf(0.975)


def risk_sets(
    sums: DataFrame,
    keys: list[str],
    weightings: dict[str, str],
    weighted_censoring: bool = True,
) -> DataFrame:
    """Weight at risk per arm on each day with an event, for each analysis.

    ``sums`` comes from ``risk_sums``. ``weightings`` maps the name of an analysis to
    the prefix of its sums, ``n`` for counts. Persons who died stay at risk with a
    weight that shrinks as the probability of remaining uncensored does since their
    death. ``weighted_censoring`` estimates that probability from weights, otherwise
    from counts. On one day events and deaths come before censoring.
    """
    days = risk_days(sums, keys, weightings, weighted_censoring)
    return days.drop("free")


def risk_days(
    sums: DataFrame,
    keys: list[str],
    weightings: dict[str, str],
    weighted_censoring: bool = True,
    squares: dict[str, str] | None = None,
) -> DataFrame:
    """As :func:`risk_sets`, with ``free``, the probability of being uncensored before the day.

    With ``squares`` (for an analysis the prefix of the sums of its squared weights) all days are kept, and the squares
    of the rows that end on them as ``sq_ev`` ...
    """
    past = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    from_now = Window.partitionBy(*keys).orderBy(F.col("time").desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    prefixes = sorted({"n", *weightings.values()})

    def total(prefix: str, codes: str = "edc", arms: str = "vu") -> Column:
        return reduce(add, [F.col(f"{prefix}_{c}{a}") for c in codes for a in arms])

    at_risk = {f"{p}_risk_{a}": F.sum(total(p, arms=a)).over(from_now) for p in prefixes for a in "vu"}
    staged = sums.withColumns(at_risk)
    here = F.col("n_risk_v") + F.col("n_risk_u")
    nobody_left = (F.col("n_cv") + F.col("n_cu") > 0) & (here == total("n"))

    def log_step(p: str) -> Column:
        exposed = F.col(f"{p}_risk_v") + F.col(f"{p}_risk_u") - total(p, "ed")
        share = F.try_divide(total(p, "c"), exposed)
        return F.when(nobody_left | (total("n", "c") == 0), 0.0).otherwise(F.log(1 - share))

    ended = F.coalesce(F.max(nobody_left).over(past), F.lit(False))
    survival = {
        f"{p}_free": F.when(ended, 0.0).otherwise(
            F.exp(F.coalesce(F.sum(log_step(p)).over(past), F.lit(0.0)))
        )
        for p in prefixes
    }
    staged = staged.withColumns(survival)

    def free(p: str) -> Column:
        return F.col(f"{p if weighted_censoring else 'n'}_free")

    dead = {
        f"{p}_dead_{a}": F.coalesce(
            F.sum(F.try_divide(F.col(f"{p}_d{a}"), free(p))).over(past), F.lit(0.0)
        )
        for p in prefixes
        for a in "vu"
    }
    staged = staged.withColumns(dead)
    if squares is None:
        staged = staged.where(F.col("n_ev") + F.col("n_eu") > 0)
    ending = [f"{c}{a}" for c in "edc" for a in "vu"] if squares else []
    analyses = [
        F.struct(
            F.lit(name).alias("analysis"),
            *[F.col(f"{p}_e{a}").cast("double").alias(f"e{a}") for a in "vu"],
            *[(F.col(f"{p}_risk_{a}") + free(p) * F.col(f"{p}_dead_{a}")).alias(f"risk_{a}")
              for a in "vu"],
            free(p).alias("free"),
            *[F.col(f"{squares[name]}_{m}").cast("double").alias(f"sq_{m}") for m in ending],
        )
        for name, p in weightings.items()
    ]
    return staged.select(
        *keys,
        "time",
        (F.col("n_ev") + F.col("n_eu")).alias("n_events"),
        F.explode(F.array(*analyses)).alias("a"),
    ).select(
        *keys, "a.analysis", "time", "n_events", "a.ev", "a.eu", "a.risk_v", "a.risk_u", "a.free",
        *[f"a.sq_{m}" for m in ending],
    )


def tie_sums(n: np.ndarray, x: np.ndarray, direct: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Sums of 1 / (x - k) and of its square over k = 0 .. n - 1, for x >= n, in constant time each.

    The smallest ``direct`` terms are added one by one; the others are a difference of digamma (trigamma) values at
    arguments above ``direct``, taken term by term from the asymptotic series so that nothing cancels.
    """
    low = x - n + 1
    terms = 1 / (low[:, None] + np.arange(direct))
    terms[np.arange(direct) >= n[:, None]] = 0
    y, more = low + direct, np.maximum(n - direct, 0)
    ratio = np.log1p(more / y)

    def drop(power: int) -> np.ndarray:
        return -np.expm1(-power * ratio) / y**power

    first = ratio + drop(1) / 2 + drop(2) / 12 - drop(4) / 120 + drop(6) / 252 - drop(8) / 240
    second = drop(1) + drop(2) / 2 + drop(3) / 6 - drop(5) / 30 + drop(7) / 42 - drop(9) / 30
    return terms.sum(axis=1) + first, (terms**2).sum(axis=1) + second


def newton(
    n: np.ndarray, ev: np.ndarray, eu: np.ndarray, rv: np.ndarray, ru: np.ndarray, steps: int = 50
) -> tuple[float, float, bool]:
    """Log hazard ratio of the arm, its standard error and whether the steps settled.

    Ties by Efron's rule: the k-th of n events of a day sees the risk set without
    k/n of the events' weight. Each step takes constant time per day, however many events tie.
    """
    beta, info = 0.0, 0.0
    total = float(ev.sum())
    n, ev, eu, rv, ru = (c[ev + eu > 0] for c in (n, ev, eu, rv, ru))
    weight = (ev + eu) / n
    for _ in range(steps):
        ratio = np.exp(beta)
        at_risk, tied = rv * ratio + ru, ev * ratio + eu
        once, twice = tie_sums(n, n * at_risk / tied)
        # An event's share is top / (at_risk - k/n tied): a constant part and one over the shrinking risk set.
        flat = ev * ratio / tied
        slope = ratio * n * (rv * eu - ru * ev) / tied**2
        shares = n * flat + slope * once
        squares = n * flat**2 + 2 * flat * slope * once + slope**2 * twice
        score = total - float(weight @ shares)
        info = float(weight @ (shares - squares))
        if not info > 0:
            return np.nan, np.nan, False
        step = float(np.clip(score / info, -2.0, 2.0))
        beta += step
        if abs(step) < 1e-10:
            return beta, info ** -0.5, True
    return beta, info ** -0.5, False


ESTIMATE_FIELDS = [
    T.StructField("n_events", T.LongType()),
    T.StructField("log_hr", T.DoubleType()),
    T.StructField("se", T.DoubleType()),
    T.StructField("hr", T.DoubleType()),
    T.StructField("hr_inverse", T.DoubleType()),
    T.StructField("low95", T.DoubleType()),
    T.StructField("upper95", T.DoubleType()),
    T.StructField("converged", T.BooleanType()),
]


def fine_gray(risk: DataFrame, keys: list[str]) -> DataFrame:
    """Hazard ratio of vaccinated against unvaccinated persons for each analysis.

    An analysis with all events in one arm has no finite estimate and gets nulls.
    """
    types = {f.name: f for f in risk.schema.fields}
    schema = T.StructType([types[k] for k in keys] + ESTIMATE_FIELDS)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        n, ev, eu, rv, ru = (
            pdf[c].to_numpy(float) for c in ("n_events", "ev", "eu", "risk_v", "risk_u")
        )
        beta, se, settled = np.nan, np.nan, False
        if ev.sum() > 0 and eu.sum() > 0:
            beta, se, settled = newton(n, ev, eu, rv, ru)
        low, high = beta - Z95 * se, beta + Z95 * se
        out = {k: [pdf[k].iloc[0]] for k in keys}
        values = [int(n.sum()), beta, se, *np.exp([beta, -beta, low, high]), settled]
        out.update({f.name: [v] for f, v in zip(ESTIMATE_FIELDS, values)})
        return pd.DataFrame(out)

    fitted = risk.groupBy(*keys).applyInPandas(fit, schema)
    numbers = [f.name for f in ESTIMATE_FIELDS if isinstance(f.dataType, T.DoubleType)]
    return fitted.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in numbers else F.col(c) for c in fitted.columns]
    )


def estimate(
    sums: DataFrame,
    keys: list[str],
    weightings: dict[str, str],
    min_events: int = 1,
    weighted_censoring: bool = True,
) -> DataFrame:
    """Fine-Gray estimates of the analyses with enough events, from day sums."""
    risk = risk_sets(sums, keys, weightings, weighted_censoring)
    one = [*keys, "analysis"]
    events = F.sum("n_events").over(Window.partitionBy(*one))
    gated = risk.withColumn("_events", events).where(F.col("_events") >= min_events)
    return fine_gray(gated.drop("_events"), one)


# --- robust interval ------------------------------------------------------------------------

SCORES = [f"u_{c}{a}" for c in "edc" for a in "vu"]


def day_scores(
    n: np.ndarray, ev: np.ndarray, eu: np.ndarray, rv: np.ndarray, ru: np.ndarray, free: np.ndarray, beta: float
) -> dict[str, np.ndarray]:
    """What a row adds to the score of the fitted model per unit of its weight, by the day and way it ends and its arm.

    A row takes from the score its share in the events of all days it is at risk on; a row that has an event adds its own.
    A death stays at risk with a weight that shrinks from its day on. Days ascend; those without events only pass on the
    running sums. Tied events follow Efron's rule, in sums of constant time as in :func:`newton`.
    """
    ratio = np.exp(beta)
    at_risk, tied = rv * ratio + ru, ev * ratio + eu
    has = (n > 0) & (tied > 0)
    k, at, ties = n[has], at_risk[has], tied[has]
    once, twice = tie_sums(k, k * at / ties)
    one, two = once * k / ties, twice * (k / ties) ** 2  # sums of 1 / (risk set) and of its square over the tied events
    weight = (ev + eu)[has] / k
    # The vaccinated share of the shrinking risk set: a constant part and one over the risk set.
    flat = ev[has] * ratio / ties
    over = rv[has] * ratio - flat * at
    share = np.zeros(len(n))
    share[has] = flat + over * one / k
    spared_one, spared_two = at / ties * one - k / ties, at / ties * two - one / ties
    out = {}
    for arm, x, r in (("v", 1.0, ratio), ("u", 0.0, 1.0)):
        taken, spared = np.zeros(len(n)), np.zeros(len(n))
        taken[has] = weight * r * ((x - flat) * one - over * two)
        spared[has] = weight * r * ((x - flat) * spared_one - over * spared_two)
        so_far, weighted = np.cumsum(taken), np.cumsum(free * taken)
        later = np.divide(weighted[-1:] - weighted, free, out=np.zeros(len(n)), where=free > 0)
        out[f"u_e{arm}"] = x - share - (so_far - spared)
        out[f"u_d{arm}"] = -(so_far + later)
        out[f"u_c{arm}"] = -so_far
    return out


def score_table(days: DataFrame, keys: list[str], min_events: int = 1) -> DataFrame:
    """Per analysis and day the scores ``u_ev`` ... of a row that ends there, the fit, and the day's sum of squared scores.

    ``days`` from :func:`risk_days` with squares. Analyses with fewer events or without a finite fit have no rows.
    """
    types = {f.name: f for f in days.schema.fields}
    numbers = ["log_hr", "se", "squares", *SCORES]
    schema = T.StructType([types[k] for k in keys] + [types["time"], T.StructField("n_events", T.LongType())]
                          + [T.StructField(c, T.DoubleType()) for c in numbers])

    def scores(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        columns = [pdf[c].to_numpy(float) for c in ("n_events", "ev", "eu", "risk_v", "risk_u")]
        with_events = columns[0] > 0
        beta, se = np.nan, np.nan
        if columns[0].sum() >= min_events and columns[1].sum() > 0 and columns[2].sum() > 0:
            beta, se, _ = newton(*[c[with_events] for c in columns])
        if not np.isfinite(beta):
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})
        found = day_scores(*columns, pdf["free"].to_numpy(float), beta)
        squares = sum(pdf[f"sq_{c[2:]}"].to_numpy(float) * found[c] ** 2 for c in SCORES)
        events = int(columns[0].sum())
        names = {k: [pdf[k].iloc[0]] * len(pdf) for k in keys}
        return pd.DataFrame({**names, "time": pdf["time"].to_numpy(), "n_events": events, "log_hr": beta,
                             "se": se, "squares": squares, **found})

    return days.groupBy(*keys).applyInPandas(scores, schema)


def robust_effects(
    scores: DataFrame, rows: DataFrame, keys: list[str], weightings: dict[str, str | None], min_time: int = 1
) -> DataFrame:
    """Estimates with the sandwich standard error, rows of one person summed before they are squared.

    ``scores``: a stored :func:`score_table` over ``keys`` and analysis. Persons with one row of an analysis enter through the
    sums of squared weights per day; only those with several rows, all among ``rows`` (from ``event_rows``), are looked up one
    by one. ``weightings`` maps an analysis to the weight column of ``rows``, None for 1.
    """
    one = [*keys, "analysis"]
    person = [*keys, "person_id"]
    several = rows.where(F.col("time") >= min_time).withColumn("_n", F.count("*").over(Window.partitionBy(*person)))
    weights = F.array(*[
        F.struct(F.lit(name).alias("analysis"), (F.col(c).cast("double") if c else F.lit(1.0)).alias("w"))
        for name, c in weightings.items()
    ])
    several = several.where("_n > 1").select(*person, "group", "time", "event", F.explode(weights).alias("a"))
    several = several.select(*person, "group", "time", "event", "a.analysis", "a.w").alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*one, "time")])
    arm = F.col("r.group") == VACCINATED
    score = F.lit(None).cast("double")
    for code, event in (("e", EVENT), ("d", DEATH), ("c", CENSORED)):
        here = F.when(arm, F.col(f"s.u_{code}v")).otherwise(F.col(f"s.u_{code}u"))
        score = F.when(F.col("r.event") == event, here).otherwise(score)
    u = F.col("r.w") * score
    looked_up = several.join(scores.alias("s"), same).select(*[F.col(f"r.{c}") for c in (*one, "person_id")], u.alias("u"))
    crossed = looked_up.groupBy(*one, "person_id").agg((F.sum("u") * F.sum("u") - F.sum(F.col("u") * F.col("u"))).alias("x"))
    crossed = crossed.groupBy(*one).agg(F.sum("x").alias("x")).alias("x")
    fitted = scores.groupBy(*one).agg(
        F.max("n_events").alias("n_events"), F.max("log_hr").alias("log_hr"), F.max("se").alias("se"),
        F.sum("squares").alias("squares"),
    ).alias("f")
    same = reduce(lambda a, b: a & b, [F.col(f"f.{k}").eqNullSafe(F.col(f"x.{k}")) for k in one])
    joined = fitted.join(crossed, same, "left")
    meat = F.greatest(F.col("f.squares") + F.coalesce("x.x", F.lit(0.0)), F.lit(0.0))
    out = joined.select(*[F.col(f"f.{c}") for c in (*one, "n_events", "log_hr", "se")],
                        (F.sqrt(meat) * F.col("f.se") * F.col("f.se")).alias("robust_se"))
    return out.select(
        "*",
        F.exp(F.col("log_hr") - Z95 * F.col("robust_se")).alias("robust_low95"),
        F.exp(F.col("log_hr") + Z95 * F.col("robust_se")).alias("robust_upper95"),
    )
