"""The grid of effects: every analysis has its rows, fitted or not, under the ids and names of the cohort index list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from episodica.config import CENSORINGS, EVENT, OUTCOME_NAMES, RISK_WINDOWS, UNVACCINATED, VACCINATED
from episodica.operators.cohorts import decode_cohort_id
from episodica.operators.timetoevent import CELL, DOSE_CENSORED, analysis_cells, outcome_name

# Columns of a published effect table, and the composite whose rows bear another outcome's names.
REPORT_COLUMNS = {
    "hr": "HR", "hr_inverse": "HRinvers", "low95": "low95", "upper95": "upper95", "se": "SE",
    "n_vaccinated": "n_vaccinated", "n_unvaccinated": "n_unvaccinated",
}
NAMED_AFTER = {"ATE": "VTE"}


class StudyError(ValueError):
    """Rows that contradict the study's own rules."""


def index_names(index: DataFrame) -> DataFrame:
    """(outcome, censoring, risk_window, cohortId, cohortName) from a cohort index list (cohortId, cohortName).

    A composite outcome without a cohort of its own has no id and the name of the outcome it is named after.
    Of several rows for one cohort the smallest name counts.
    """
    first = max(OUTCOME_NAMES) + 1
    derived = F.col("cohortId").between(first, first - 1 + len(CENSORINGS) * len(OUTCOME_NAMES) * len(RISK_WINDOWS))
    listed = index.where(derived).groupBy("cohortId").agg(F.min("cohortName").alias("cohortName"))
    own = decode_cohort_id(listed, "cohortId").select(
        outcome_name(F.col("outcome_id")).alias("outcome"), "censoring", "risk_window", "cohortId", "cohortName"
    )
    for composite, model in NAMED_AFTER.items():
        lent = own.where(F.col("outcome") == model).select(
            F.lit(composite).alias("outcome"), "censoring", "risk_window", F.lit(None).cast("int").alias("cohortId"),
            F.replace("cohortName", F.lit(model), F.lit(composite)).alias("cohortName"),
        )
        own = own.unionByName(lent)
    return own


def report_keys(index: DataFrame, populations: list[str], analyses: list[str]) -> DataFrame:
    """All keys of the grid: populations x analyses x censoring variants x outcomes x windows, with id and name.

    The grid does not follow from the list: an analysis whose cohort the list lacks keeps its row, without a name.
    """
    spark = index.sparkSession
    lists = [F.explode(F.array(*[F.lit(x) for x in values])).alias(name)
             for name, values in (("population", populations), ("analysis", analyses))]
    cells = analysis_cells(spark).select("*", lists[0]).select("*", lists[1])
    return cells.join(F.broadcast(index_names(index)), ["outcome", "censoring", "risk_window"], "left")


def effect_report(keys: DataFrame, counts: DataFrame, fitted: DataFrame) -> DataFrame:
    """One row per key. Counts and estimates only where there are enough events, as ``event_counts`` says; null otherwise.

    ``counts``: population, the columns of an analysis, n_vaccinated, n_unvaccinated, enough. ``fitted``: the same
    columns, analysis and the estimates. Both are bounded by the grid.
    """
    cell = ["population", *CELL]
    k, c, f = keys.alias("k"), counts.where("enough").alias("c"), fitted.alias("f")
    same = _equal("k", "c", cell)
    fit = _equal("k", "f", [*cell, "analysis"]) & F.col("c.enough")
    source = {"n_vaccinated": "c", "n_unvaccinated": "c"}
    return k.join(c, same, "left").join(f, fit, "left").select(
        *[F.col(f"k.{x}") for x in (*cell, "analysis", "cohortId", "cohortName")],
        *[F.col(f"{source.get(x, 'f')}.{x}").alias(name) for x, name in REPORT_COLUMNS.items()],
    )


def calibrated_report(keys: DataFrame, calibrated: DataFrame) -> DataFrame:
    """The calibrated rows of one analysis in the same grid; an uncalibrated row is empty."""
    cell = ["population", *CELL]
    k, c = keys.alias("k"), calibrated.alias("c")
    columns = {"cal_hr": "HR", "cal_low95": "low95", "cal_upper95": "upper95", "cal_exp_se": "SE"}
    return k.join(c, _equal("k", "c", cell), "left").select(
        *[F.col(f"k.{x}") for x in (*cell, "cohortId", "cohortName")],
        *[F.col(f"c.{x}").alias(name) for x, name in columns.items()],
    )


def _equal(a: str, b: str, names: list[str]) -> Column:
    same = F.lit(True)
    for name in names:
        same = same & F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}"))
    return same


def checked(rows: DataFrame, name: str = "study rows") -> tuple[DataFrame, Observation]:
    """The rows of ``event_rows``, counted on the way: rows, and those that break a rule of the study.

    * ``late_events``: an event whose outcome came after a dose that ends follow-up. A dose on the day of infection does not:
      the event wins that tie, and the dose is not strictly between infection and outcome, so the cohort rules keep the row.
    * ``early_outcomes``: an outcome before its infection.
    * ``unknown_groups``: a row of neither arm.
    """
    observation = Observation(name)
    event = F.col("event") == EVENT
    dosed = F.col("censoring").isin(*DOSE_CENSORED) | ((F.col("variant") == "full") & (F.col("group") == UNVACCINATED))
    after = (F.col("outcome_date") > F.col("next_vaccine")) & (F.col("next_vaccine") != F.col("covid_date"))
    late = event & dosed & after
    early = F.col("outcome_date") < F.col("covid_date")
    unknown = ~F.col("group").isin(VACCINATED, UNVACCINATED)
    counted = rows.observe(
        observation,
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(late, 1)).alias("late_events"),
        F.count(F.when(early, 1)).alias("early_outcomes"),
        F.count(F.when(F.coalesce(unknown, F.lit(True)), 1)).alias("unknown_groups"),
    )
    return counted, observation


def stop_on_violations(observation: Observation) -> dict[str, int]:
    """The counts of a written ``checked`` table; raises :class:`StudyError` if a rule was broken."""
    counts = observation.get
    broken = {k: n for k, n in counts.items() if k != "rows" and n}
    if broken:
        raise StudyError(f"{broken} of {counts['rows']} study rows break a rule of the study")
    return counts

