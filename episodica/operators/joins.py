"""Joins between persons and their dated events that stay balanced when a person is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(
    anchors: DataFrame,
    events: DataFrame,
    on: list[str],
    anchor_date: str,
    event_date: str,
    min_days: int,
    max_days: int,
    bucket_days: int = 365,
) -> DataFrame:
    """Pairs whose event falls ``min_days`` to ``max_days`` after the anchor.

    The join key is the person *and* a slice of the calendar: an event lies in one
    slice, an anchor is copied to the slices its interval touches. A person with
    very many events is thus spread over tasks and only near dates are compared.
    """

    def slice_of(day: Column) -> Column:
        return F.floor(F.unix_date(day) / F.lit(bucket_days)).cast("int")

    first = slice_of(F.date_add(F.col(anchor_date), min_days))
    last = slice_of(F.date_add(F.col(anchor_date), max_days))
    a = anchors.withColumn("_slice", F.explode(F.sequence(first, last)))
    e = events.withColumn("_slice", slice_of(F.col(event_date)))
    gap = F.datediff(F.col(event_date), F.col(anchor_date))
    return a.join(e, on + ["_slice"]).where(gap.between(min_days, max_days)).drop("_slice")


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: str,
    salt_by: list[str],
    salts: int = 8,
    how: str = "inner",
) -> DataFrame:
    """Rows with the columns a small table holds for their key.

    When Spark's own size check lets it broadcast ``lookup`` the rows do not move;
    otherwise the rows of one key are spread over ``salts`` tasks by the columns
    ``salt_by``, and the lookup rows are copied to each. ``how`` is inner or left.
    """
    if salts <= 1:
        return rows.join(lookup, on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def person_join(
    facts: DataFrame, persons: DataFrame, salt_by: list[str], salts: int = 8
) -> DataFrame:
    """Facts with the columns of their person; a person may hold very many facts."""
    return salted_join(facts, persons, "person_id", salt_by, salts)
