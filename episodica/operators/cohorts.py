"""Outcome cohorts: infections followed by an outcome, under four censoring rules.

Dates are days, so a person has at most one infection, dose or outcome row per day
and kind once duplicates are gone. That bounds every per-person group below.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.config import (
    CENSORINGS,
    COMPOSITES,
    DOSE_IDS,
    INFECTION_ID,
    OUTCOME_NAMES,
    RISK_WINDOWS,
    StudyConfig,
)
from episodica.operators.joins import interval_join

PAIR = ["person_id", "outcome_id", "covid_date", "outcome_date"]
EPISODE = ["person_id", "outcome_id", "covid_date"]


def has_id(*ids: int) -> Column:
    """Cohort id filter. Equalities reach the branches of a derived id and prune them."""
    return reduce(or_, [F.col("cohort_definition_id") == i for i in ids])


def infections(cohort: DataFrame) -> DataFrame:
    return (
        cohort.where(has_id(INFECTION_ID))
        .select(F.col("subject_id").alias("person_id"), F.col("cohort_start_date").alias("covid_date"))
        .distinct()
    )


def doses(cohort: DataFrame) -> DataFrame:
    return (
        cohort.where(has_id(*DOSE_IDS))
        .select(F.col("subject_id").alias("person_id"), F.col("cohort_start_date").alias("vaccine_date"))
        .distinct()
    )


def outcome_events(cohort: DataFrame) -> DataFrame:
    return (
        cohort.where(F.col("cohort_definition_id").between(min(OUTCOME_NAMES), max(OUTCOME_NAMES)))
        .select(
            F.col("subject_id").alias("person_id"),
            F.col("cohort_definition_id").alias("outcome_id"),
            F.col("cohort_start_date").alias("outcome_date"),
        )
        .distinct()
    )


def pair_counts(infected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Number of (infection, outcome event) pairs per person and outcome.

    The pairs themselves are never laid out: both sides are counted first.
    """
    n_infections = infected.groupBy("person_id").agg(F.count("*").alias("n_infections"))
    n_events = outcomes.groupBy("person_id", "outcome_id").agg(F.count("*").alias("n_events"))
    return n_events.join(n_infections, "person_id").withColumn(
        "n_pairs", F.col("n_infections") * F.col("n_events")
    )


def pairs_between(
    infected: DataFrame, outcomes: DataFrame, min_days: int, max_days: int
) -> DataFrame:
    """Pairs of a person whose outcome comes ``min_days`` to ``max_days`` after infection."""
    return interval_join(
        infected, outcomes, ["person_id"], "covid_date", "outcome_date", min_days, max_days
    )


def within_horizon(infected: DataFrame, outcomes: DataFrame, days: int = 365) -> DataFrame:
    """Outcome strictly after infection, at most ``days`` later."""
    return pairs_between(infected, outcomes, 1, days).select(*PAIR)


def with_next_dose(infected: DataFrame, vaccine: DataFrame) -> DataFrame:
    """Each infection with the first dose on a later day.

    One pass over the person's days from last to first: an infection sees the
    doses of later days only, as it comes before a dose of its own day.
    """
    timeline = infected.select(
        "person_id", F.col("covid_date").alias("day"), F.lit(0).alias("is_dose")
    ).unionByName(
        vaccine.select("person_id", F.col("vaccine_date").alias("day"), F.lit(1).alias("is_dose"))
    )
    seen = (
        Window.partitionBy("person_id")
        .orderBy(F.col("day").desc(), F.col("is_dose").asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    next_dose = F.min(F.when(F.col("is_dose") == 1, F.col("day"))).over(seen)
    return (
        timeline.withColumn("next_dose", next_dose)
        .where("is_dose = 0")
        .select("person_id", F.col("day").alias("covid_date"), "next_dose")
    )


def flagged_pairs(
    infected: DataFrame,
    outcomes: DataFrame,
    vaccine: DataFrame | None = None,
    config: StudyConfig = StudyConfig(),
    washout_key: str = "episode",
) -> DataFrame:
    """Pairs after washout and horizon, with what the censoring rules need.

    ``washout_key="episode"`` drops an infection for an outcome the person had 1 to
    ``washout_days - 1`` days earlier. ``"row"`` takes out only the earlier outcome
    rows themselves, which the horizon drops anyway.

    ``is_nearest``: no later infection precedes this outcome. ``dose_between``: a dose
    lies strictly between infection and outcome. Both come from windows over the
    same (person, outcome) partitioning, so the pairs move once.
    """
    if washout_key not in ("episode", "row"):
        raise ValueError("washout_key is 'episode' or 'row'")
    left = infected.withColumn("next_dose", F.lit(None).cast("date"))
    if vaccine is not None:
        left = with_next_dose(infected, vaccine)
    look_back = 1 - config.washout_days if washout_key == "episode" else 1
    pairs = pairs_between(left, outcomes, min(look_back, 1), config.horizon_days).repartition(
        "person_id", "outcome_id"
    )
    gap = F.datediff("outcome_date", "covid_date")
    if washout_key == "episode":
        earliest = F.min(F.when(gap != 0, gap)).over(Window.partitionBy(*EPISODE))
        pairs = pairs.withColumn("_earliest", earliest).where("_earliest > 0").drop("_earliest")
    pairs = pairs.where(gap > 0)
    nearest = F.max("covid_date").over(
        Window.partitionBy("person_id", "outcome_id", "outcome_date")
    )
    return pairs.select(
        *PAIR,
        (F.col("covid_date") == nearest).alias("is_nearest"),
        F.coalesce(F.col("next_dose") < F.col("outcome_date"), F.lit(False)).alias("dose_between"),
    )


def kept_under(censoring: str) -> Column:
    """Rows of :func:`flagged_pairs` that a censoring rule keeps."""
    return {
        "none": F.lit(True),
        "covid": F.col("is_nearest"),
        "vaccine": ~F.col("dose_between"),
        "both": F.col("is_nearest") & ~F.col("dose_between"),
    }[censoring]


def censored_pairs(pairs: DataFrame, censoring: str) -> DataFrame:
    return pairs.where(kept_under(censoring)).select(*PAIR)


def risk_window(gap: Column, windows=RISK_WINDOWS) -> Column:
    """Number of the window a gap in days falls into, null outside all windows."""
    number = F.lit(None).cast("int")
    for window, first, last in reversed(windows):
        number = F.when(gap.between(first, last), F.lit(window)).otherwise(number)
    return number


def encode_cohort_id(outcome_id: Column, window: Column, censoring_code: Column) -> Column:
    """Ids 15 to 174: windows vary fastest, then outcomes, then censoring rules."""
    n_windows, n_outcomes = len(RISK_WINDOWS), len(OUTCOME_NAMES)
    position = (outcome_id - F.lit(min(OUTCOME_NAMES))) * n_windows + window
    return (position + F.lit(max(OUTCOME_NAMES)) + censoring_code * (n_windows * n_outcomes)).cast("int")


def classify(pairs: DataFrame, censoring: str = "none") -> DataFrame:
    """Distinct (cohort id, episode) rows: in which windows an outcome fell."""
    window = risk_window(F.datediff("outcome_date", "covid_date"))
    code = F.lit(CENSORINGS.index(censoring))
    return (
        pairs.withColumn("risk_window", window)
        .where(F.col("risk_window").isNotNull())
        .select(
            encode_cohort_id(F.col("outcome_id"), F.col("risk_window"), code).alias(
                "cohort_definition_id"
            ),
            "person_id",
            "outcome_id",
            "covid_date",
        )
        .distinct()
    )


def outcome_cohorts(
    pairs: DataFrame,
    censorings: tuple[str, ...] = CENSORINGS,
    end_in_window: bool = False,
) -> DataFrame:
    """Cohort rows of all outcomes, windows and censoring rules in one pass.

    The start is the infection. The end is the episode's earliest outcome under the
    rule, over all windows; ``end_in_window`` takes the earliest of the row's window.
    """
    ends = {c: f"end_{c}" for c in censorings}
    gap = F.datediff("outcome_date", "covid_date")
    per_window = (
        pairs.withColumn("risk_window", risk_window(gap))
        .where(F.col("risk_window").isNotNull())
        .groupBy(*EPISODE, "risk_window")
        .agg(
            *[
                F.min(F.when(kept_under(c), F.col("outcome_date"))).alias(name)
                for c, name in ends.items()
            ]
        )
    )
    episode = Window.partitionBy(*EPISODE)
    rows = [
        F.when(
            F.col(name).isNotNull(),
            F.struct(
                F.lit(CENSORINGS.index(c)).alias("code"),
                (F.col(name) if end_in_window else F.min(name).over(episode)).alias("end"),
            ),
        )
        for c, name in ends.items()
    ]
    return (
        per_window.withColumn("rows", F.array(*rows))
        .select("*", F.explode(F.array_compact("rows")).alias("r"))
        .select(
            encode_cohort_id(F.col("outcome_id"), F.col("risk_window"), F.col("r.code")).alias(
                "cohort_definition_id"
            ),
            F.col("person_id").alias("subject_id"),
            F.col("covid_date").alias("cohort_start_date"),
            F.col("r.end").alias("cohort_end_date"),
        )
    )


def build_outcome_cohorts(
    cohort: DataFrame,
    config: StudyConfig = StudyConfig(),
    washout_key: str = "episode",
    end_in_window: bool = False,
) -> DataFrame:
    """The 160 derived cohorts from a cohort table."""
    pairs = flagged_pairs(
        infections(cohort), outcome_events(cohort), doses(cohort), config, washout_key
    )
    return outcome_cohorts(pairs, end_in_window=end_in_window)


def decode_cohort_id(cohorts: DataFrame, id_column: str = "cohort_definition_id") -> DataFrame:
    """Add outcome id, censoring and window of derived cohort ids."""
    n_windows = len(RISK_WINDOWS)
    per_censoring = n_windows * len(OUTCOME_NAMES)
    position = F.col(id_column) - F.lit(max(OUTCOME_NAMES) + 1)
    within = position % per_censoring
    code = F.floor(position / per_censoring).cast("int")
    censoring = F.element_at(F.array(*[F.lit(c) for c in CENSORINGS]), code + 1)
    return (
        cohorts.withColumn(
            "outcome_id", (F.floor(within / n_windows) + min(OUTCOME_NAMES)).cast("int")
        )
        .withColumn("censoring", censoring)
        .withColumn("risk_window", (within % n_windows + 1).cast("int"))
    )


def composite_outcomes(cohorts: DataFrame) -> DataFrame:
    """Derived cohorts by outcome name, with the composite outcomes in place.

    Columns: person_id, outcome, censoring, risk_window, covid_date, outcome_date.
    """
    names = F.lit(None).cast("array<string>")
    for outcome_id, name in OUTCOME_NAMES.items():
        targets = [] if name in COMPOSITES else [name]
        targets += [c for c, members in COMPOSITES.items() if name in members]
        if targets:
            wanted = F.array(*[F.lit(t) for t in targets])
            names = F.when(F.col("outcome_id") == outcome_id, wanted).otherwise(names)
    return (
        decode_cohort_id(cohorts)
        .select("*", F.explode(names).alias("outcome"))
        .select(
            F.col("subject_id").alias("person_id"),
            "outcome",
            "censoring",
            "risk_window",
            F.col("cohort_start_date").alias("covid_date"),
            F.col("cohort_end_date").alias("outcome_date"),
        )
        .distinct()
    )
