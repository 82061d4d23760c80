"""Covariates in long form: one row (person_id, covariate, value) per non-zero value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.config import (
    ANY_TEST_ID,
    FEMALE_CONCEPT_ID,
    INFECTION_ID,
    PCR_TEST_ID,
    StudyConfig,
)
from episodica.functions.dates import age_at, days_between, lookback_window, years_between
from episodica.functions.text import covariate_name
from episodica.operators.cohorts import has_id
from episodica.operators.joins import person_join, salted_join
from episodica.operators.population import observed_period
from episodica.sources.readers import Cdm

# Covariate families and names, spelled as in published result tables.
DRUG = "drug_era"
CONDITION = "condition_ocurrence"
VISIT = "visit_ocurrence"
TESTING = "covid19_and_testing"
VISIT_CONCEPT, VISIT_NAME = 581477, "Visit to GP"
TEST_NAMES = {
    ANY_TEST_ID: "Any covid19 test",
    PCR_TEST_ID: "PCR covid19 test",
    INFECTION_ID: "Diag+ covid19",
}
ANALYSIS_DRUG, ANALYSIS_CONDITION, ANALYSIS_VISIT, ANALYSIS_TEST = 1, 2, 3, 6
AGE_BAND_START, AGE_BAND_STOP, AGE_BAND_WIDTH = 75, 120, 5
FACTOR_FAMILIES = ("care_site", "region", "age_g", "gender")


def before_index(
    facts: DataFrame, individuals: DataFrame, salt_by: list[str], open_ended: bool, salts: int
) -> DataFrame:
    """Facts with a column ``day`` joined to the index date, with window label."""
    joined = person_join(
        facts, individuals.select("person_id", "index_date"), salt_by, salts
    ).withColumn("window", lookback_window(days_between("day", "index_date"), open_ended))
    return joined.where(F.col("window").isNotNull())


def concept_names(facts: DataFrame, concept: DataFrame) -> DataFrame:
    """Names of the concepts in use; an unknown concept has a null name."""
    used = facts.select("concept_id").distinct()
    return used.join(concept.select("concept_id", "concept_name"), "concept_id", "left")


def _named(rows: DataFrame, concept: DataFrame, salts: int) -> DataFrame:
    """Rows with ``concept_name``, null if unknown. One concept may hold very many rows."""
    names = concept.select("concept_id", "concept_name")
    return salted_join(rows, names, "concept_id", ["person_id"], salts, "left")


def _flags(
    facts: DataFrame,
    concept: DataFrame,
    individuals: DataFrame,
    family: str,
    open_ended: bool,
    salts: int,
) -> DataFrame:
    seen = (
        before_index(facts, individuals, ["concept_id", "day"], open_ended, salts)
        .select("person_id", "concept_id", "window")
        .distinct()
    )
    return (
        _named(seen, concept, salts)
        .select(
            "person_id",
            covariate_name(family, F.col("concept_name"), F.col("window")).alias("covariate"),
        )
        .distinct()
        .withColumn("value", F.lit(1.0))
    )


def drug_facts(cdm: Cdm) -> DataFrame:
    return cdm["drug_era"].select(
        "person_id",
        F.col("drug_concept_id").alias("concept_id"),
        F.col("drug_era_start_date").alias("day"),
    )


def condition_facts(cdm: Cdm) -> DataFrame:
    return cdm["condition_occurrence"].select(
        "person_id",
        F.col("condition_concept_id").alias("concept_id"),
        F.col("condition_start_date").alias("day"),
    )


def drug_flags(cdm: Cdm, individuals: DataFrame, salts: int = 8) -> DataFrame:
    """Drug eras that start 1 to 180 days before the index date."""
    return _flags(drug_facts(cdm), cdm["concept"], individuals, DRUG, False, salts)


def condition_flags(cdm: Cdm, individuals: DataFrame, salts: int = 8) -> DataFrame:
    """Conditions at any time before the index date, in three windows."""
    return _flags(condition_facts(cdm), cdm["concept"], individuals, CONDITION, True, salts)


def _count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("person_id", "covariate").agg(F.count("*").cast("double").alias("value"))


def visit_counts(cdm: Cdm, individuals: DataFrame, salts: int = 8) -> DataFrame:
    """Days with a visit before the index date, in three windows."""
    facts = cdm["visit_occurrence"].select("person_id", F.col("visit_start_date").alias("day"))
    days = before_index(facts, individuals, ["day"], True, salts).select(
        "person_id", "day", "window"
    )
    return _count(
        days.distinct().select(
            "person_id", covariate_name(VISIT, F.lit(VISIT_NAME), F.col("window")).alias("covariate")
        )
    )


def test_counts(cdm: Cdm, individuals: DataFrame, salts: int = 8) -> DataFrame:
    """Tests and diagnoses before the index date; every cohort row counts."""
    name = F.lit(None).cast("string")
    for cohort_id, text in TEST_NAMES.items():
        name = F.when(F.col("cohort_definition_id") == cohort_id, text).otherwise(name)
    facts = cdm["cohort"].where(has_id(*TEST_NAMES)).select(
        F.col("subject_id").alias("person_id"),
        F.col("cohort_start_date").alias("day"),
        name.alias("name"),
    )
    rows = before_index(facts, individuals, ["day"], True, salts)
    return _count(
        rows.select(
            "person_id", covariate_name(TESTING, F.col("name"), F.col("window")).alias("covariate")
        )
    )


def alltime_counts(
    facts: DataFrame, concept: DataFrame, individuals: DataFrame, family: str, salts: int = 8
) -> DataFrame:
    """Rows of each concept at any time before the index date."""
    rows = person_join(
        facts, individuals.select("person_id", "index_date"), ["concept_id", "day"], salts
    ).where(days_between("day", "index_date") > 0)
    per_concept = rows.groupBy("person_id", "concept_id").agg(F.count("*").alias("n"))
    name = covariate_name(family, F.col("concept_name"), F.lit("allTime"))
    return (
        _named(per_concept, concept, salts)
        .groupBy("person_id", name.alias("covariate"))
        .agg(F.sum("n").cast("double").alias("value"))
    )


def age_band(age: Column) -> Column:
    """Five-year band of an age, left closed, the last one closed; null outside."""
    band = F.lit(None).cast("string")
    last = AGE_BAND_STOP - AGE_BAND_WIDTH
    for low in range(AGE_BAND_START, AGE_BAND_STOP, AGE_BAND_WIDTH):
        high = low + AGE_BAND_WIDTH
        inside = (age >= low) & ((age <= high) if low == last else (age < high))
        band = F.when(inside, f"{low} to {high - 1} years").otherwise(band)
    return band


def _persons(cdm: Cdm, individuals: DataFrame) -> DataFrame:
    return individuals.select("person_id").distinct().join(cdm["person"], "person_id", "left")


def _one(rows: DataFrame) -> DataFrame:
    return rows.select("person_id", "covariate", F.lit(1.0).alias("value"))


def age_group_factor(cdm: Cdm, individuals: DataFrame, config: StudyConfig) -> DataFrame:
    """Age band of each person; an age outside the bands is a level of its own."""
    age = age_at("year_of_birth", config.age_date)
    name = covariate_name("age_group", age_band(age))
    return _one(_persons(cdm, individuals).withColumn("covariate", name))


def gender_factor(cdm: Cdm, individuals: DataFrame) -> DataFrame:
    female = F.col("gender_concept_id") == FEMALE_CONCEPT_ID
    name = covariate_name("gender", F.when(female, "Female").otherwise("Male"))
    known = _persons(cdm, individuals).where(F.col("gender_concept_id").isNotNull())
    return _one(known.withColumn("covariate", name))


def person_location(cdm: Cdm, individuals: DataFrame, config: StudyConfig) -> DataFrame:
    """Care site and merged location of each person, null where unknown."""
    merged, label = F.col("location_id"), F.col("location_source_value")
    for old, new in config.location_merge.items():
        merged = F.when(F.col("location_id") == old, new).otherwise(merged)
    for location_id, text in config.location_labels.items():
        label = F.when(F.col("location_id") == location_id, text).otherwise(label)
    return (
        _persons(cdm, individuals)
        .select("person_id", "care_site_id")
        .join(cdm["care_site"], "care_site_id", "left")
        .withColumn("location_id", merged)
        .join(cdm["location"], "location_id", "left")
        .select("person_id", "care_site_id", "location_id", label.alias("region"))
    )


def location_factor(cdm: Cdm, individuals: DataFrame, config: StudyConfig) -> DataFrame:
    """Care-site and region factors. Unknown and excluded regions are left out."""
    located = person_location(cdm, individuals, config)
    site = covariate_name("care_site_id", F.lit("="), F.col("care_site_id").cast("string"))
    region = covariate_name("region", F.col("region"))
    dropped = F.col("covariate").contains("region_NA")
    for name in config.excluded_regions:
        dropped = dropped | F.col("covariate").contains("region_" + name.replace(" ", "_"))
    both = located.select("person_id", F.explode(F.array(site, region)).alias("covariate"))
    return _one(both.where(~dropped)).distinct()


def care_site_codes(located: DataFrame) -> DataFrame:
    """Care sites numbered 1, 2, ... in order, the unknown one last."""
    sites = located.select("care_site_id").distinct()
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("care_site_id").asc_nulls_last())
    return sites.select("care_site_id", F.row_number().over(order).alias("value"))


def age_covariate(cdm: Cdm, individuals: DataFrame, config: StudyConfig) -> DataFrame:
    age = age_at("year_of_birth", config.age_date).cast("double")
    return _persons(cdm, individuals).select(
        "person_id", F.lit("age").alias("covariate"), age.alias("value")
    )


def observation_years(cdm: Cdm, individuals: DataFrame, salts: int = 8) -> DataFrame:
    """Years under observation before the index date, where positive."""
    period = observed_period(individuals, cdm["observation_period"], salts)
    years = years_between("enter_date", "index_date")
    return period.select(
        "person_id", F.lit("observation_years").alias("covariate"), years.alias("value")
    ).where("value > 0")


def covariate_dictionary(cdm: Cdm, individuals: DataFrame) -> DataFrame:
    """Covariates in use: feature id, concept, name and the analysis they belong to.

    A feature id is the concept id followed by three digits for its analysis.
    """
    persons = individuals.select("person_id").distinct()

    def used(facts: DataFrame, analysis: int) -> DataFrame:
        mine = facts.join(persons, "person_id", "left_semi")
        return concept_names(mine, cdm["concept"]).select(
            (F.col("concept_id") * 1000 + analysis).alias("feature_id"),
            F.col("concept_id").alias("covariate_id"),
            F.col("concept_name").alias("covariate_name"),
            F.lit(analysis).alias("analysis_id"),
        )

    visits = cdm["visit_occurrence"].join(persons, "person_id", "left_semi")
    visit = visits.select(
        F.lit(VISIT_CONCEPT * 1000 + ANALYSIS_VISIT).cast("bigint").alias("feature_id"),
        F.lit(VISIT_CONCEPT).cast("bigint").alias("covariate_id"),
        F.lit(VISIT_NAME).alias("covariate_name"),
        F.lit(ANALYSIS_VISIT).alias("analysis_id"),
    ).distinct()
    number, name = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    for position, (cohort_id, text) in enumerate(TEST_NAMES.items(), start=1):
        same = F.col("cohort_definition_id") == cohort_id
        number = F.when(same, F.lit(position * 1000 + ANALYSIS_TEST)).otherwise(number)
        name = F.when(same, text).otherwise(name)
    test = (
        cdm["cohort"].where(has_id(*TEST_NAMES))
        .withColumnRenamed("subject_id", "person_id")
        .join(persons, "person_id", "left_semi")
        .select(
            number.cast("bigint").alias("feature_id"),
            F.lit(None).cast("bigint").alias("covariate_id"),
            name.alias("covariate_name"),
            F.lit(ANALYSIS_TEST).alias("analysis_id"),
        )
        .distinct()
    )
    return (
        used(drug_facts(cdm), ANALYSIS_DRUG)
        .unionByName(used(condition_facts(cdm), ANALYSIS_CONDITION))
        .unionByName(visit)
        .unionByName(test)
    )


def discrete_covariates(cdm: Cdm, individuals: DataFrame, config: StudyConfig) -> DataFrame:
    return drug_flags(cdm, individuals, config.salts).unionByName(
        condition_flags(cdm, individuals, config.salts)
    )


def continuous_covariates(cdm: Cdm, individuals: DataFrame, config: StudyConfig) -> DataFrame:
    return (
        visit_counts(cdm, individuals, config.salts)
        .unionByName(test_counts(cdm, individuals, config.salts))
        .unionByName(age_covariate(cdm, individuals, config))
        .unionByName(observation_years(cdm, individuals, config.salts))
    )


def factor_covariates(cdm: Cdm, individuals: DataFrame, config: StudyConfig) -> DataFrame:
    return (
        age_group_factor(cdm, individuals, config)
        .unionByName(gender_factor(cdm, individuals))
        .unionByName(location_factor(cdm, individuals, config))
    )


def all_covariates(cdm: Cdm, individuals: DataFrame, config: StudyConfig) -> DataFrame:
    """Every covariate with its kind: discrete, continuous or factor."""
    return (
        discrete_covariates(cdm, individuals, config).withColumn("kind", F.lit("discrete"))
        .unionByName(
            continuous_covariates(cdm, individuals, config).withColumn("kind", F.lit("continuous"))
        )
        .unionByName(factor_covariates(cdm, individuals, config).withColumn("kind", F.lit("factor")))
    )


def covariate_frequencies(discrete: DataFrame, individuals: DataFrame, share: float) -> DataFrame:
    """Rows per covariate and whether they exceed the share of persons asked for."""
    threshold = individuals.agg(F.floor(F.count("*") * F.lit(share)).alias("t")).scalar()
    return (
        discrete.groupBy("covariate").agg(F.count("*").alias("n"))
        .withColumn("threshold", threshold)
        .withColumn("frequent", F.col("n") > F.col("threshold"))
    )


def drop_rare(discrete: DataFrame, individuals: DataFrame, share: float) -> DataFrame:
    """Keep covariates of more than ``floor(share * persons)`` rows.

    Spark broadcasts the kept names if their measured size allows, and splits a skewed name otherwise.
    """
    kept = covariate_frequencies(discrete, individuals, share).where("frequent").select("covariate")
    return discrete.join(kept, "covariate", "left_semi")


def rare_summary(discrete: DataFrame, individuals: DataFrame, share: float) -> DataFrame:
    return covariate_frequencies(discrete, individuals, share).agg(
        F.count("*").alias("n_covariates"),
        F.sum(F.when(F.col("frequent"), 0).otherwise(1)).alias("n_excluded"),
        F.max("threshold").alias("threshold"),
    )


def select_covariates(covariates: DataFrame, names: DataFrame) -> DataFrame:
    return covariates.join(names.select("covariate"), "covariate", "left_semi")


def restrict_to(covariates: DataFrame, members: DataFrame) -> DataFrame:
    """Stored covariates of the persons of each stratum; they keep the base index date."""
    return covariates.join(members.select("stratum", "person_id").distinct(), "person_id")


def reference_levels(factors: DataFrame) -> DataFrame:
    """The level of each factor family that a model leaves out: its smallest name."""
    family = F.lit(None).cast("string")
    for name in FACTOR_FAMILIES:
        family = F.when(F.col("covariate").contains(name), name).otherwise(family)
    return (
        factors.withColumn("family", family).where(F.col("family").isNotNull())
        .groupBy("family").agg(F.min("covariate").alias("covariate"))
    )
