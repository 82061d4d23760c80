"""Where study tables come from: parquet folders, JDBC relations, CSV lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.sources.schemas import SCHEMAS, conform

CDM_TABLES = (
    "person", "care_site", "location", "observation_period", "death", "concept",
    "drug_era", "condition_occurrence", "visit_occurrence", "cohort",
)


class Cdm:
    """Named study tables, bound lazily: nothing is read before a query needs it."""

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load
        self._bound: dict[str, DataFrame] = {}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._bound:
            self._bound[table] = conform(self._load(table), table)
        return self._bound[table]

    def cohort(self, ids: int | Iterable[int]) -> DataFrame:
        """Rows of some cohorts; prunes partitions of a table partitioned by id."""
        wanted = [ids] if isinstance(ids, int) else list(ids)
        return self["cohort"].where(F.col("cohort_definition_id").isin(wanted))

    def with_tables(self, **tables: DataFrame) -> Cdm:
        """The same source with some tables replaced."""
        return Cdm(lambda name: tables[name] if name in tables else self[name])


def parquet_cdm(spark: SparkSession, path: str, cohort_table: str = "cohort") -> Cdm:
    """Tables stored as one parquet folder each below ``path``."""
    names = {"cohort": cohort_table}
    return Cdm(lambda t: spark.read.parquet(f"{path}/{names.get(t, t)}"))


def catalog_cdm(
    spark: SparkSession, cdm_schema: str, results_schema: str, cohort_table: str
) -> Cdm:
    """Tables of the session catalog; the cohort table sits in the results schema."""

    def load(table: str) -> DataFrame:
        if table == "cohort":
            return spark.table(f"{results_schema}.{cohort_table}")
        return spark.table(f"{cdm_schema}.{table}")

    return Cdm(load)


def jdbc_cdm(
    spark: SparkSession,
    url: str,
    cdm_schema: str,
    results_schema: str,
    cohort_table: str,
    options: dict[str, str] | None = None,
    partitions: dict[str, tuple[str, int, int, int]] | None = None,
) -> Cdm:
    """Tables of a database.

    ``partitions`` maps a table to (column, lower, upper, count) so that a large
    table is read by many tasks at once.
    """

    def load(table: str) -> DataFrame:
        name = f"{results_schema}.{cohort_table}" if table == "cohort" else f"{cdm_schema}.{table}"
        reader = spark.read.format("jdbc").options(**(options or {})).option("url", url)
        if partitions and table in partitions:
            column, lower, upper, count = partitions[table]
            reader = (
                reader.option("partitionColumn", column)
                .option("lowerBound", lower)
                .option("upperBound", upper)
                .option("numPartitions", count)
            )
        return reader.option("dbtable", name).load()

    return Cdm(load)


def read_list(spark: SparkSession, path: str, table: str) -> DataFrame:
    """An analyst's CSV list (``nco_list`` or ``cohort_index``), columns found by name."""
    by_name = spark.read.option("header", True).csv(path)
    return conform(by_name, table)


def scan_fact(facts: DataFrame, columns: list[str], persons: DataFrame | None = None) -> DataFrame:
    """Project first, then keep the rows of the study persons."""
    narrow = facts.select(*columns)
    if persons is None:
        return narrow
    return narrow.join(persons.select("person_id").distinct(), "person_id", "left_semi")


__all__ = [
    "CDM_TABLES", "SCHEMAS", "Cdm", "catalog_cdm", "jdbc_cdm", "parquet_cdm",
    "read_list", "scan_fact",
]
