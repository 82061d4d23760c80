"""Where results go: the cohort table and CSV reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.sources.schemas import SCHEMAS, conform


def replace_cohorts(
    cohorts: DataFrame, path: str, files_per_cohort: int = 1, ids: Iterable[int] | None = None
) -> None:
    """Write cohorts into the cohort table; a cohort that is already there is replaced.

    The table is partitioned by cohort id. Only the partitions of the ids in
    ``cohorts`` change, so a rerun after a failure leaves the same table. Large
    cohorts are written by ``files_per_cohort`` tasks each. ``ids`` names the cohorts
    being replaced: those of them without rows now lose their old ones.
    """
    rows = conform(cohorts, "cohort").withColumn(
        "_part", F.pmod(F.xxhash64("subject_id"), F.lit(files_per_cohort))
    )
    (
        rows.repartition("cohort_definition_id", "_part")
        .drop("_part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("cohort_definition_id")
        .parquet(path)
    )
    if ids is not None:
        present = {r[0] for r in cohorts.select("cohort_definition_id").distinct().collect()}
        for cohort_id in set(ids) - present:
            _remove(cohorts.sparkSession, f"{path}/cohort_definition_id={int(cohort_id)}")


def _remove(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_cohorts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["cohort"]).parquet(path)


def remap_cohort_ids(cohorts: DataFrame, id_map: dict[int, int]) -> DataFrame:
    """Give cohorts of another table the ids used here; unlisted cohorts are left out."""
    spark = cohorts.sparkSession
    mapping = spark.createDataFrame(sorted(id_map.items()), "cohort_definition_id int, new_id int")
    return cohorts.join(F.broadcast(mapping), "cohort_definition_id").select(
        F.col("new_id").alias("cohort_definition_id"),
        "subject_id",
        "cohort_start_date",
        "cohort_end_date",
    )


REPORT_KEYS = ["analysis", "population", "censoring", "variant"]


def export_results(results: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """CSV reports, one folder per analysis, population, censoring and variant."""
    by = keys or [k for k in REPORT_KEYS if k in results.columns]
    (
        results.repartition(*by)
        .write.mode("overwrite")
        .option("header", True)
        .partitionBy(*by)
        .csv(path)
    )
