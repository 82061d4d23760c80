"""Stage tables: results of one step, written once and read by the steps after it.

A stage lies in the folder the cluster shares (``spark.checkpoint.dir``), so it
outlives the executors that wrote it and ends the lineage before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, or a folder in the warehouse: both are shared by all executors."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return path.rstrip("/") if path else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/episodica-stages"


class StageStore:
    """Parquet stages of one run, kept below ``root/run_id``."""

    def __init__(self, spark: SparkSession, root: str | None = None, run_id: str | None = None):
        self.spark = spark
        self.root = f"{root or shared_dir(spark)}/{run_id or uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write a stage, replacing an older one of this run, and hand back its reader."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))
