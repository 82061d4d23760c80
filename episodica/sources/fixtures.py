"""Study tables derived from the driver's order tables (``FIXTURES.md``).

Each function is a plan over the whole parquet tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.config import CENSORINGS, OUTCOME_NAMES, RISK_WINDOWS, StudyConfig
from episodica.operators.cohorts import decode_cohort_id
from episodica.operators.timetoevent import outcome_name
from episodica.sources.readers import Cdm

FIXTURE_CONFIG = StudyConfig(
    location_merge={4: 3},
    location_labels={3: "EUROPE-CENTRAL"},
    excluded_regions=("AFRICA",),
)
ENROLMENT_DATE = "1996-07-01"
FIRST_DERIVED = max(OUTCOME_NAMES) + 1
CENSORING_LABELS = ("no censoring", "covid censoring", "vax censoring", "covid+vax censoring")


class OrderTables:
    """Study views over customer, orders, lineitem, part, nation and region."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def load(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("person_id"),
            "o_orderkey",
            F.to_date("o_orderdate").alias("day"),
            "o_orderstatus",
            "o_orderpriority",
        )

    def shipments(self) -> DataFrame:
        """One row per line item with its person and shipping day."""
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day")
        )
        owners = self.orders().select("person_id", F.col("o_orderkey").alias("l_orderkey"))
        return lines.join(owners, "l_orderkey")

    def person(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("person_id"),
            F.when(key % 3 == 0, 8507).otherwise(8532).alias("gender_concept_id"),
            (F.lit(1903) + key % 50).alias("year_of_birth"),
            F.col("c_nationkey").alias("care_site_id"),
        )

    def care_site(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("care_site_id"),
            F.col("n_regionkey").alias("location_id"),
        )

    def location(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_regionkey").alias("location_id"),
            F.col("r_name").alias("location_source_value"),
        )

    def observation_period(self) -> DataFrame:
        return self.orders().groupBy("person_id").agg(
            F.min("day").alias("observation_period_start_date"),
            F.max("day").alias("observation_period_end_date"),
        )

    def death(self) -> DataFrame:
        return (
            self.orders().where(F.col("person_id") % 7 == 0).groupBy("person_id")
            .agg(F.date_sub(F.max("day"), 100).alias("death_date"))
        )

    def condition_occurrence(self) -> DataFrame:
        return self.shipments().select(
            "person_id",
            (F.col("l_partkey") % 100).alias("condition_concept_id"),
            F.col("day").alias("condition_start_date"),
        )

    def drug_era(self) -> DataFrame:
        return self.orders().select(
            "person_id",
            (F.lit(1000) + F.col("o_orderkey") % 40).alias("drug_concept_id"),
            F.col("day").alias("drug_era_start_date"),
            F.date_add("day", 30).alias("drug_era_end_date"),
        )

    def visit_occurrence(self) -> DataFrame:
        return self.shipments().select("person_id", F.col("day").alias("visit_start_date"))

    def concept(self) -> DataFrame:
        conditions = self.table("part").select((F.col("p_partkey") % 100).alias("concept_id"))
        drugs = self.table("orders").select((F.col("o_orderkey") % 40).alias("k"))
        return (
            conditions.distinct()
            .select(
                "concept_id",
                F.concat(F.lit("Condition "), (F.col("concept_id") % 90).cast("string"))
                .alias("concept_name"),
            )
            .unionByName(
                drugs.distinct().select(
                    (F.lit(1000) + F.col("k")).alias("concept_id"),
                    F.concat(F.lit("Drug "), F.col("k").cast("string")).alias("concept_name"),
                )
            )
        )

    def vaccine(self) -> DataFrame:
        return (
            self.orders().where("o_orderstatus = 'P'")
            .select(
                F.when(F.col("o_orderpriority") < "3", 2).otherwise(3)
                .alias("cohort_definition_id"),
                F.col("person_id").alias("subject_id"),
                F.col("day").alias("cohort_start_date"),
            )
            .distinct()
        )

    def first_vaccine(self) -> DataFrame:
        label = F.concat(
            F.col("cohort_start_date").cast("string"),
            F.lit("#"),
            F.col("cohort_definition_id").cast("string"),
        )
        return self.vaccine().groupBy("subject_id").agg(
            F.min("cohort_start_date").alias("cohort_start_date"), F.min(label).alias("label")
        )

    def cohort(self) -> DataFrame:
        def part(df: DataFrame, cohort_id, day: str = "day", person: str = "person_id"):
            number = F.lit(cohort_id) if isinstance(cohort_id, int) else cohort_id
            return df.select(
                number.cast("int").alias("cohort_definition_id"),
                F.col(person).alias("subject_id"),
                F.col(day).alias("cohort_start_date"),
            )

        orders, first = self.orders(), self.first_vaccine()
        tests = orders.where("o_orderstatus = 'O'")
        early = self.vaccine().where(F.col("cohort_start_date") <= F.lit(ENROLMENT_DATE).cast("date"))
        never = (
            self.table("customer").select(F.col("c_custkey").alias("subject_id"))
            .where("subject_id % 2 = 1")
            .join(early.select("subject_id").distinct(), "subject_id", "left_anti")
            .withColumn("day", F.lit(ENROLMENT_DATE).cast("date"))
        )
        even = first.where("subject_id % 2 = 0")
        start = "cohort_start_date"
        az = F.col("label").endswith("#2")
        outcome = F.lit(5)
        for digit in range(1, 10):
            outcome = F.when(F.col("l_suppkey") % 10 == digit, 5 + digit).otherwise(outcome)
        parts = [
            part(orders.where("o_orderstatus = 'F'"), 4),
            part(self.vaccine(), F.col("cohort_definition_id"), start, "subject_id"),
            part(self.shipments(), outcome),
            part(tests, 175),
            part(tests.where("o_orderpriority = '1-URGENT'"), 176),
            part(never, 177, "day", "subject_id"),
            part(even, 178, start, "subject_id"),
            part(even, F.when(az, 185).otherwise(186), start, "subject_id"),
        ]
        rows = parts[0]
        for other in parts[1:]:
            rows = rows.unionByName(other)
        return rows.distinct().withColumn("cohort_end_date", F.col("cohort_start_date"))

    def nco_list(self) -> DataFrame:
        """Negative controls: concepts 0 to 9, two under each name."""
        return self.concept().where("concept_id < 10").select(
            F.concat(F.lit("Control "), (F.col("concept_id") % 5).cast("string"))
            .alias("OutcomeName"),
            F.col("concept_id").alias("ConceptId"),
        )

    def cohort_index(self) -> DataFrame:
        """Index list of the derived cohorts, named by outcome, days of the window and censoring."""
        ids = self.spark.range(FIRST_DERIVED, FIRST_DERIVED + len(CENSORINGS) * len(OUTCOME_NAMES) * len(RISK_WINDOWS))
        decoded = decode_cohort_id(ids.select(F.col("id").cast("int").alias("cohortId")), "cohortId")
        days = F.element_at(F.array(*[F.lit(f"{a} to {b}") for _, a, b in RISK_WINDOWS]), F.col("risk_window"))
        label = F.element_at(F.array(*[F.lit(x) for x in CENSORING_LABELS]), F.array_position(
            F.array(*[F.lit(c) for c in CENSORINGS]), F.col("censoring")).cast("int"))
        return decoded.select(
            "cohortId",
            F.concat_ws(" ", outcome_name(F.col("outcome_id")), days, label).alias("cohortName"),
        )


def fixture_cdm(spark: SparkSession, sf_dir: str) -> Cdm:
    return Cdm(OrderTables(spark, sf_dir).load)


def stand_in_score(person_id: str = "person_id"):
    """A deterministic propensity score, so that weighted results can be checked in SQL."""
    return F.lit(0.05) + F.lit(0.9) * ((F.col(person_id) * 37) % 101) / F.lit(101.0)
