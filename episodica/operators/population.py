"""Study population: arms, index dates and the dates that end follow-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.config import (
    FEMALE_CONCEPT_ID,
    UNVACCINATED,
    UNVACCINATED_ID,
    VACCINATED,
    VACCINATED_ID,
    StudyConfig,
)
from episodica.functions.dates import age_in_year
from episodica.functions.random import uniform
from episodica.operators.cohorts import doses, has_id
from episodica.operators.joins import person_join
from episodica.sources.readers import Cdm


def arm_members(
    cohort: DataFrame,
    vaccinated_id: int = VACCINATED_ID,
    unvaccinated_id: int = UNVACCINATED_ID,
) -> DataFrame:
    """Persons of the two arms with their index date."""
    arm = F.when(F.col("cohort_definition_id") == vaccinated_id, VACCINATED).otherwise(UNVACCINATED)
    return (
        cohort.where(has_id(vaccinated_id, unvaccinated_id))
        .select(
            F.col("subject_id").alias("person_id"),
            F.col("cohort_start_date").alias("index_date"),
            arm.alias("group"),
        )
        .distinct()
    )


def first_two_doses(vaccine: DataFrame) -> DataFrame:
    """First and second distinct dose day of each person."""
    rank = F.row_number().over(Window.partitionBy("person_id").orderBy("vaccine_date"))
    return (
        vaccine.select("person_id", "vaccine_date")
        .distinct()
        .withColumn("rank", rank)
        .where("rank <= 2")
        .groupBy("person_id")
        .agg(
            F.min(F.when(F.col("rank") == 1, F.col("vaccine_date"))).alias("first_dose"),
            F.min(F.when(F.col("rank") == 2, F.col("vaccine_date"))).alias("second_dose"),
        )
    )


def next_dose(members: DataFrame, vaccine: DataFrame) -> DataFrame:
    """Dose that may end follow-up.

    Vaccinated persons: the first dose later than their first one. Unvaccinated
    persons: their first dose. Null where there is none.
    """
    own = F.when(F.col("group") == VACCINATED, F.col("second_dose")).otherwise(F.col("first_dose"))
    return members.join(first_two_doses(vaccine), "person_id", "left").select(
        *members.columns, own.alias("next_vaccine")
    )


def observed_period(members: DataFrame, periods: DataFrame, salts: int = 8) -> DataFrame:
    """Observation period of each index date: the one that holds it, else the last."""
    start, end = F.col("observation_period_start_date"), F.col("observation_period_end_date")
    holds = F.col("index_date").between(start, end)
    best = F.max(F.struct(holds.alias("holds"), end.alias("end"), start.alias("start")))
    joined = person_join(
        periods.select("person_id", start, end),
        members.select("person_id", "index_date").distinct(),
        ["observation_period_start_date"],
        salts,
    )
    return (
        joined.groupBy("person_id", "index_date").agg(best.alias("p"))
        .select("person_id", "index_date", F.col("p.start").alias("enter_date"),
                F.col("p.end").alias("leave_date"))
    )


def build_population(
    cdm: Cdm,
    config: StudyConfig = StudyConfig(),
    vaccinated_id: int = VACCINATED_ID,
    unvaccinated_id: int = UNVACCINATED_ID,
) -> DataFrame:
    """One row per person and arm with index, censoring and death dates; weight 1."""
    members = next_dose(
        arm_members(cdm["cohort"], vaccinated_id, unvaccinated_id), doses(cdm["cohort"])
    )
    leave = observed_period(members, cdm["observation_period"], config.salts).drop("enter_date")
    death = cdm["death"].groupBy("person_id").agg(F.min("death_date").alias("death_date"))
    person = cdm["person"].select("person_id", "gender_concept_id", "year_of_birth")
    female = F.col("gender_concept_id") == FEMALE_CONCEPT_ID
    return (
        members.join(leave, ["person_id", "index_date"], "left")
        .join(death, "person_id", "left")
        .join(person, "person_id", "left")
        .select(
            "person_id",
            "index_date",
            "group",
            "next_vaccine",
            "leave_date",
            "death_date",
            F.when(female, "Female").when(~female, "Male").alias("gender"),
            age_in_year("year_of_birth", config.age_year).alias("age"),
            F.lit(1.0).alias("weight"),
        )
    )


def arm_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("group").agg(F.count("*").alias("population"))


def stratum_members(
    cohort: DataFrame, strata: dict[str, int], unvaccinated_id: int = UNVACCINATED_ID
) -> DataFrame:
    """Arms of several vaccine strata at once: (stratum, person_id, index_date, group).

    A stratum has its own vaccinated cohort; the unvaccinated belong to all of them.
    """
    names = F.array(*[F.lit(n) for n in strata])
    for name, cohort_id in strata.items():
        own = F.col("cohort_definition_id") == cohort_id
        names = F.when(own, F.array(F.lit(name))).otherwise(names)
    unvaccinated = F.col("cohort_definition_id") == unvaccinated_id
    return (
        cohort.where(has_id(unvaccinated_id, *strata.values()))
        .select(
            F.explode(names).alias("stratum"),
            F.col("subject_id").alias("person_id"),
            F.col("cohort_start_date").alias("index_date"),
            F.when(unvaccinated, UNVACCINATED).otherwise(VACCINATED).alias("group"),
        )
        .distinct()
    )


def index_date_distribution(members: DataFrame) -> DataFrame:
    """Vaccinated persons per stratum and index date, with the share of dates up to each.

    One row per stratum and calendar day, which bounds the windows below.
    """
    by_day = (
        members.where(F.col("group") == VACCINATED).groupBy("stratum", "index_date")
        .agg(F.count("*").alias("n"))
    )
    whole = Window.partitionBy("stratum")
    upto = F.sum("n").over(whole.orderBy("index_date").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(whole)
    return by_day.select(
        "stratum",
        "index_date",
        "n",
        (F.col("n") / total).alias("share"),
        ((upto - F.col("n")) / total).alias("lower"),
        (upto / total).alias("upper"),
    )


def assign_index_date(members: DataFrame, seed: int, bins: int = 4096) -> DataFrame:
    """Draw an index date for every unvaccinated person from those of the stratum's vaccinated.

    A person's number in [0, 1) comes from a hash that the stratum enters, so the draw does
    not depend on partitioning nor on draws for other purposes. The date whose share interval holds it is found by an equi-join on
    equal-width bins; the date table has at most days + 2 * bins rows per stratum.
    """
    table = index_date_distribution(members).select(
        "stratum",
        F.col("index_date").alias("drawn"),
        "lower",
        "upper",
        F.explode(
            F.sequence(F.floor(F.col("lower") * bins), F.floor(F.col("upper") * bins))
        ).alias("bin"),
    )
    drawn = (
        members.where(F.col("group") == UNVACCINATED)
        .withColumn("u", uniform("person_id", seed, F.concat(F.lit("index:"), "stratum")))
        .withColumn("bin", F.floor(F.col("u") * bins))
        .join(F.broadcast(table), ["stratum", "bin"])
        .where((F.col("u") >= F.col("lower")) & (F.col("u") < F.col("upper")))
        .select("stratum", "person_id", F.col("drawn").alias("index_date"), "group")
    )
    kept = members.where(F.col("group") == VACCINATED)
    return kept.unionByName(drawn)


def stratum_populations(base: DataFrame, members: DataFrame) -> DataFrame:
    """Persons of each stratum: columns of the base population, own index date."""
    dates = members.select("stratum", "person_id", "index_date")
    return base.drop("index_date").join(dates, "person_id").select("stratum", *base.columns)
