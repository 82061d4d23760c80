"""Design vectors for MLlib, assembled from the long covariate table."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.config import VACCINATED
from episodica.operators.features import TEST_NAMES, TESTING, VISIT, VISIT_NAME

_WINDOWS = ("1to30", "31to180", "+181")
CONTINUOUS_NAMES = tuple(
    "_".join((family, name, window)).replace(" ", "_")
    for family, names in ((VISIT, [VISIT_NAME]), (TESTING, TEST_NAMES.values()))
    for name in names
    for window in _WINDOWS
) + ("age", "observation_years")


def covariate_names(covariates: DataFrame) -> list[str]:
    """Distinct names in order. Call it on frequent covariates or factor levels only:
    a name held by more than a share s of persons occurs at most (mean names per
    person) / s times."""
    return [r.covariate for r in covariates.select("covariate").distinct().orderBy("covariate").collect()]


def _one_hot(df: DataFrame, names: list[str], column: str) -> DataFrame:
    model = CountVectorizerModel.from_vocabulary(
        names, inputCol=f"{column}_names", outputCol=column, minTF=1.0
    )
    return model.setBinary(True).transform(df)


def flag_vectors(persons: DataFrame, discrete: DataFrame, names: list[str]) -> DataFrame:
    """person_id, label (1 vaccinated) and a sparse vector of the named flags."""
    lists = discrete.groupBy("person_id").agg(F.collect_set("covariate").alias("flags_names"))
    empty = F.array().cast("array<string>")
    rows = persons.select("person_id", "group").join(lists, "person_id", "left").select(
        "person_id",
        (F.col("group") == VACCINATED).cast("double").alias("label"),
        F.coalesce("flags_names", empty).alias("flags_names"),
    )
    return _one_hot(rows, names, "flags").select(
        "person_id", "label", F.col("flags").alias("features")
    )


def design_vectors(
    individuals: DataFrame,
    covariates: DataFrame,
    flags: list[str],
    levels: list[str],
    keep: list[str] | None = None,
) -> DataFrame:
    """person_id, group, label and the features of the propensity model.

    ``covariates`` has a column ``kind``. Features: the chosen flags, the continuous
    covariates, the factor ``levels`` (reference levels left out), the index date as
    a number, and age squared. Zeros are filled in. One shuffle by person.
    """
    value = {
        name: F.sum(F.when(F.col("covariate") == name, F.col("value"))) for name in CONTINUOUS_NAMES
    }

    def names(kind: str):
        return F.collect_set(F.when(F.col("kind") == kind, F.col("covariate")))

    columns = [f"x{i}" for i in range(len(CONTINUOUS_NAMES))]
    wide = covariates.groupBy("person_id").agg(
        names("discrete").alias("flags_names"),
        names("factor").alias("levels_names"),
        *[value[name].alias(c) for name, c in zip(CONTINUOUS_NAMES, columns)],
    )
    empty = F.array().cast("array<string>")
    rows = individuals.join(wide, "person_id", "left").select(
        "person_id",
        "group",
        *(keep or []),
        (F.col("group") == VACCINATED).cast("double").alias("label"),
        *[F.coalesce(f"{k}_names", empty).alias(f"{k}_names") for k in ("flags", "levels")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns],
        F.unix_date("index_date").cast("double").alias("index_day"),
    )
    age = columns[CONTINUOUS_NAMES.index("age")]
    rows = rows.withColumn("age2", F.col(age) * F.col(age))
    inputs = columns + ["index_day", "age2"]
    for column, vocabulary in (("flags", flags), ("levels", levels)):
        if vocabulary:
            rows = _one_hot(rows, vocabulary, column)
            inputs.append(column)
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)
    return assembled.select("person_id", "group", *(keep or []), "label", "features")
