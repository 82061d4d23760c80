"""Schemas of the study tables and the cast that brings an input to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_long, _int, _date, _text = T.LongType(), T.IntegerType(), T.DateType(), T.StringType()

SCHEMAS: dict[str, T.StructType] = {
    "person": _schema(
        person_id=_long, gender_concept_id=_int, year_of_birth=_int, care_site_id=_int
    ),
    "care_site": _schema(care_site_id=_int, location_id=_int),
    "location": _schema(location_id=_int, location_source_value=_text),
    "observation_period": _schema(
        person_id=_long,
        observation_period_start_date=_date,
        observation_period_end_date=_date,
    ),
    "death": _schema(person_id=_long, death_date=_date),
    "concept": _schema(concept_id=_long, concept_name=_text),
    "drug_era": _schema(
        person_id=_long,
        drug_concept_id=_long,
        drug_era_start_date=_date,
        drug_era_end_date=_date,
    ),
    "condition_occurrence": _schema(
        person_id=_long, condition_concept_id=_long, condition_start_date=_date
    ),
    "visit_occurrence": _schema(person_id=_long, visit_start_date=_date),
    "cohort": _schema(
        cohort_definition_id=_int,
        subject_id=_long,
        cohort_start_date=_date,
        cohort_end_date=_date,
    ),
    "nco_list": _schema(OutcomeName=_text, ConceptId=_long),
    "cohort_index": _schema(cohortId=_int, cohortName=_text),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Keep the columns the study uses, cast to its types (timestamps become dates)."""
    schema = SCHEMAS[table]
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"table {table} lacks columns {missing}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
