"""Small tables for tests and a comparison of rows."""

from datetime import date, timedelta

DAY0 = date(2021, 1, 1)


def day(n):
    return None if n is None else DAY0 + timedelta(days=n)


def cohort_table(spark, rows):
    """rows: (cohort id, person, day number)."""
    data = [(c, p, day(d), day(d)) for c, p, d in rows]
    return spark.createDataFrame(
        data, "cohort_definition_id int, subject_id long, cohort_start_date date, cohort_end_date date"
    )


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
