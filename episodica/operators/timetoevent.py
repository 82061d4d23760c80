"""Study tables: time to event with death as a competing event.

In the reference form of such a table every person has a row for every outcome.
Most of these rows are the same for all outcomes: follow-up ends with death, leaving
or a dose. So the persons are kept once (:func:`follow_up`), and per outcome only
the persons who had it (:func:`event_rows`); sums over the full table are the sums
over everybody, less the replaced rows, plus the rows that replace them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.config import (
    CENSORED,
    CENSORINGS,
    COMPOSITES,
    DEATH,
    EVENT,
    OUTCOME_NAMES,
    RISK_WINDOWS,
    UNVACCINATED,
    VACCINATED,
    StudyConfig,
)
from episodica.functions.text import underscored
from episodica.operators.joins import person_join
from episodica.sources.readers import Cdm

CELL = ["censoring", "variant", "outcome", "risk_window"]

# Analyses a cohort row serves, by arm and censoring rule of the cohort. A dose always
# ends the follow-up of the unvaccinated; the "full" variant also takes their
# outcomes from the cohort censored at a dose.
SERVES = {
    VACCINATED: {
        "none": (("none", "partial"), ("none", "full")),
        "covid": (("covid", "partial"), ("covid", "full")),
        "vaccine": (("vaccine", None),),
        "both": (("both", None),),
    },
    UNVACCINATED: {
        "none": (("none", "partial"),),
        "covid": (("covid", "partial"),),
        "vaccine": (("none", "full"), ("vaccine", None)),
        "both": (("covid", "full"), ("both", None)),
    },
}
DOSE_CENSORED = ("vaccine", "both")


def dose_ends(censoring: Column | None = None) -> Column:
    """Whether a next dose ends follow-up in an analysis."""
    unvaccinated = F.col("group") == UNVACCINATED
    return unvaccinated if censoring is None else unvaccinated | censoring.isin(*DOSE_CENSORED)


def _end(limited: Column, event_date: Column | None) -> tuple[Column, Column]:
    """Days of follow-up and event code. Death wins a tie, then the event."""
    dose = F.when(limited, F.col("next_vaccine"))
    dates = [F.col("death_date"), F.col("leave_date"), dose]
    end = F.least(*dates, event_date) if event_date is not None else F.least(*dates)
    code = F.when(end == F.col("death_date"), DEATH)
    if event_date is not None:
        code = code.when(end == event_date, EVENT)
    return F.datediff(end, F.col("index_date")), code.otherwise(CENSORED)


def study_table(
    population: DataFrame, outcomes: DataFrame, censoring: str, min_time: int = 1
) -> DataFrame:
    """The full table of one outcome: every person, with the outcome rows they have.

    ``outcomes``: person_id, covid_date, outcome_date. A person with several
    infections has several rows; rows with less than ``min_time`` days are left out.
    """
    joined = population.join(
        outcomes.select("person_id", "covid_date", "outcome_date").distinct(), "person_id", "left"
    )
    time, event = _end(dose_ends(F.lit(censoring)), F.col("covid_date"))
    return (
        joined.withColumn("time", time).withColumn("event", event)
        .where(F.col("time") >= min_time).distinct()
    )


def follow_up(population: DataFrame) -> DataFrame:
    """Each person's follow-up without any outcome.

    Vaccinated persons have two rows, as a dose ends follow-up in some analyses
    only (``limited``).
    """
    both = F.when(F.col("group") == VACCINATED, F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(True))
    )
    rows = population.select("*", F.explode(both).alias("limited"))
    time, event = _end(F.col("limited"), None)
    return rows.withColumn("time", time).withColumn("event", event)


def _with_times(rows: DataFrame, event_date: str) -> DataFrame:
    time, event = _end(F.col("limited"), F.col(event_date))
    base_time, base_event = _end(F.col("limited"), None)
    return (
        rows.withColumn("time", time).withColumn("event", event)
        .withColumn("base_time", base_time).withColumn("base_event", base_event)
    )


def event_rows(
    population: DataFrame, outcomes: DataFrame, first_event_only: bool = False
) -> DataFrame:
    """Study rows of the persons who are in an outcome cohort, for every analysis.

    A person with several infections has several rows, unless ``first_event_only``.

    ``outcomes`` comes from ``composite_outcomes``. ``time`` and ``event`` belong to
    the row, ``base_time`` and ``base_event`` to the person's follow-up, which the first
    row of a person in a cohort ``replaces``.
    """
    def served(arm: str) -> Column:
        lists = F.lit(None).cast("array<struct<censoring:string,variant:string>>")
        for source, cells in SERVES[arm].items():
            wanted = F.array(
                *[
                    F.struct(F.lit(c).alias("censoring"), F.lit(v).cast("string").alias("variant"))
                    for c, v in cells
                ]
            )
            lists = F.when(F.col("source") == source, wanted).otherwise(lists)
        return lists

    # A person's rows of one analysis all come from one cohort, so the first of them is
    # found before the rows are copied to the analyses.
    cohort = ["person_id", "outcome", "censoring", "risk_window"]
    place = F.row_number().over(Window.partitionBy(*cohort).orderBy("covid_date", "outcome_date"))
    first = outcomes.select(*cohort, "covid_date", "outcome_date", (place == 1).alias("replaces"))
    if first_event_only:
        first = first.where("replaces")
    joined = first.withColumnRenamed("censoring", "source").join(population, "person_id")
    cells = F.when(F.col("group") == VACCINATED, served(VACCINATED)).otherwise(served(UNVACCINATED))
    rows = joined.select("*", F.explode(cells).alias("cell")).select(
        "*", "cell.censoring", "cell.variant"
    ).drop("cell", "source")
    return _with_times(rows.withColumn("limited", dose_ends(F.col("censoring"))), "covid_date")


def outcome_name(outcome_id: Column) -> Column:
    name = F.lit(None).cast("string")
    for number, text in OUTCOME_NAMES.items():
        name = F.when(outcome_id == number, text).otherwise(name)
    return name


def analysis_cells(spark: SparkSession) -> DataFrame:
    """The fixed list of analyses: 6 censoring variants x 11 outcomes x 4 windows."""
    outcomes = list(OUTCOME_NAMES.values()) + [c for c in COMPOSITES if c not in OUTCOME_NAMES.values()]
    variants = [("none", "partial"), ("none", "full"), ("covid", "partial"), ("covid", "full")]
    variants += [(c, None) for c in CENSORINGS if c in DOSE_CENSORED]
    rows = [(c, v, o, w) for c, v in variants for o in outcomes for w, _, _ in RISK_WINDOWS]
    return spark.createDataFrame(
        rows, "censoring string, variant string, outcome string, risk_window int"
    )


def event_counts(rows: DataFrame, keys: list[str], config: StudyConfig = StudyConfig()) -> DataFrame:
    """Events per arm of each analysis and whether there are enough for a model.

    A "full" analysis is run only where its "partial" counterpart is.
    """
    def events(arm: str) -> Column:
        hit = (F.col("event") == EVENT) & (F.col("group") == arm)
        return F.sum(hit.cast("int"))

    counts = rows.where(F.col("time") >= config.min_time).groupBy(*keys).agg(
        events(VACCINATED).alias("n_vaccinated"), events(UNVACCINATED).alias("n_unvaccinated")
    )
    enough = (F.col("n_vaccinated") + F.col("n_unvaccinated")) >= config.min_events
    if "variant" not in keys:
        return counts.withColumn("enough", enough)
    others = Window.partitionBy(*[k for k in keys if k != "variant"])
    partial = F.max(F.when(F.col("variant") == "partial", enough)).over(others)
    needs = (F.col("variant") == "full") & ~F.coalesce(partial, F.lit(False))
    return counts.withColumn("enough", enough & ~F.coalesce(needs, F.lit(False)))


def dropped_rows(rows: DataFrame, keys: list[str], config: StudyConfig = StudyConfig()) -> DataFrame:
    """Rows left out of each analysis: follow-up ends before ``min_time`` or has no end."""
    late = F.col("time") < config.min_time
    return rows.where(late | F.col("time").isNull()).groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.countDistinct("person_id").alias("n_persons")
    )


def censor_violations(rows: DataFrame) -> DataFrame:
    """Rows that count an event although the outcome came after a dose that censors.

    Applies to analyses of dose-censored cohorts; there should be none.
    """
    after = F.col("outcome_date") > F.col("next_vaccine")
    wrong = (F.col("event") == EVENT) & F.coalesce(after, F.lit(False))
    checked = F.col("censoring").isin(*DOSE_CENSORED) | (
        (F.col("variant") == "full") & (F.col("group") == UNVACCINATED)
    )
    return rows.where(checked).groupBy("censoring", "variant").agg(
        F.count("*").alias("n_rows"), F.sum(wrong.cast("int")).alias("n_violations")
    )


MEASURES = [f"{code}{arm}" for code in "edc" for arm in "vu"]


def _day_measures(n: Column, weights: dict[str, Column], group: Column, event: Column) -> list[Column]:
    """Sums by event code (e, d, c) and arm (v, u): counts ``n_ev`` ..., weights ``<name>_ev`` ..."""
    codes = {"e": EVENT, "d": DEATH, "c": CENSORED}
    arms = {"v": VACCINATED, "u": UNVACCINATED}
    sums = []
    for code, value in codes.items():
        for arm, name in arms.items():
            here = (event == value) & (group == name)
            sums.append(F.sum(F.when(here, n).otherwise(0)).alias(f"n_{code}{arm}"))
            for w, column in weights.items():
                sums.append(F.sum(F.when(here, column).otherwise(0.0)).alias(f"{w}_{code}{arm}"))
    return sums


def risk_sums(
    base: DataFrame,
    rows: DataFrame,
    cells: DataFrame,
    keys: list[str],
    limited: Column,
    weights: list[str],
    strata: list[str] | None = None,
    min_time: int = 1,
) -> DataFrame:
    """Counts and weights per analysis and day of the full study tables.

    ``base`` from :func:`follow_up`, ``rows`` from :func:`event_rows`. ``cells`` lists
    the analyses (columns ``keys``; a short list), ``limited`` says for a cell whether
    a dose ends the follow-up of its vaccinated. ``strata`` are columns of ``base`` and
    ``rows`` that separate populations. One row per stratum, cell and day with counts
    ``n_ev`` ... and, per column of ``weights``, sums ``<column>_ev`` ...; the letters
    are event, death, censored and vaccinated, unvaccinated.
    """
    strata = strata or []
    cell = [*strata, *keys]
    columns = [f"{p}_{m}" for p in ("n", *weights) for m in MEASURES]
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # everybody, once per day: two rows per stratum and day, by the vaccinated's rule
    serves = F.when(
        F.col("group") == VACCINATED, F.array(F.col("limited"))
    ).otherwise(F.array(F.lit(False), F.lit(True)))
    days = (
        base.where(F.col("time") >= min_time)
        .select("*", F.explode(serves).alias("dose_limits"))
        .groupBy(*strata, "dose_limits", "time")
        .agg(*_day_measures(F.lit(1), {w: F.col(w).cast("double") for w in weights},
                            F.col("group"), F.col("event")))
    )
    everybody = (
        cells.withColumn("dose_limits", limited)
        .repartition(tasks, *keys)
        .join(F.broadcast(days), "dose_limits")
        .select(*cell, "time", *columns)
    )

    # persons with an outcome: their rows, less their follow-up once per analysis
    change = F.array(
        F.struct(F.lit(1).alias("sign"), F.col("time").alias("t"), F.col("event").alias("e")),
        F.when(F.col("replaces"), F.struct(F.lit(-1).alias("sign"), F.col("base_time").alias("t"),
                                           F.col("base_event").alias("e"))),
    )
    sign = F.col("x.sign")
    changes = (
        rows.withColumn("change", change)
        .select(*cell, "group", *weights, F.explode(F.array_compact("change")).alias("x"))
        .where(F.col("x.t") >= min_time)
        .groupBy(*cell, F.col("x.t").alias("time"))
        .agg(*_day_measures(sign, {w: F.col(w).cast("double") * sign for w in weights},
                            F.col("group"), F.col("x.e")))
        .repartition(tasks, *keys)
    )

    # Both parts are bounded by analyses x days and lie by analysis already.
    total = everybody.unionByName(changes).groupBy(*cell, "time").agg(
        *[F.sum(c).alias(c) for c in columns]
    )
    # no person left: exactly zero, whatever the subtraction left behind
    exact = [
        F.when(F.col(f"n_{m}") > 0, F.col(f"{w}_{m}")).otherwise(0.0).alias(f"{w}_{m}")
        for w in weights for m in MEASURES
    ]
    counts = [f"n_{m}" for m in MEASURES]
    somebody = reduce(or_, [F.col(c) > 0 for c in counts])
    return total.where(somebody).select(*cell, "time", *counts, *exact)


def study_sums(population: DataFrame, rows: DataFrame, config: StudyConfig,
               weights: list[str], strata: list[str] | None = None) -> DataFrame:
    """Day sums of all analyses of the study; ``rows`` from :func:`event_rows`."""
    spark = population.sparkSession
    return risk_sums(
        follow_up(population), rows, analysis_cells(spark), CELL,
        F.col("censoring").isin(*DOSE_CENSORED), weights, strata, config.min_time,
    )


def first_controls(cdm: Cdm, nco: DataFrame, population: DataFrame, salts: int = 8) -> DataFrame:
    """First day of each negative-control concept after the index date.

    Only the concepts of the list are read further; a person's rows shrink to one
    per concept before the names are attached.
    """
    facts = cdm["condition_occurrence"].select(
        "person_id",
        F.col("condition_concept_id").alias("ConceptId"),
        F.col("condition_start_date").alias("event_date"),
    )
    listed = facts.join(nco.select("ConceptId").distinct(), "ConceptId", "left_semi")
    first = (
        person_join(listed, population.select("person_id", "index_date"),
                    ["ConceptId", "event_date"], salts)
        .where(F.col("event_date") > F.col("index_date"))
        .groupBy("person_id", "ConceptId")
        .agg(F.min("event_date").alias("event_date"))
    )
    return first.join(nco, "ConceptId").select(
        "person_id", "ConceptId", underscored(F.col("OutcomeName")).alias("outcome"), "event_date"
    )


def control_rows(population: DataFrame, first: DataFrame) -> DataFrame:
    """Study rows of the persons with a negative-control event.

    Concepts of one name count as one outcome, dated by the earliest.
    """
    dated = first.groupBy("person_id", "outcome").agg(F.min("event_date").alias("event_date"))
    rows = dated.join(population, "person_id").withColumn("limited", dose_ends())
    rows = rows.withColumn("replaces", F.lit(True))
    return _with_times(rows, "event_date")


def control_sums(population: DataFrame, first: DataFrame, nco: DataFrame, config: StudyConfig,
                 weights: list[str], strata: list[str] | None = None) -> DataFrame:
    """Day sums of all negative controls, those without an event included."""
    cells = nco.select(underscored(F.col("OutcomeName")).alias("outcome")).distinct()
    return risk_sums(
        follow_up(population), control_rows(population, first), cells, ["outcome"],
        F.lit(False), weights, strata, config.min_time,
    )
