import pytest

from episodica.config import REMAP_STRATA, StudyConfig
from episodica.sources import sinks
from episodica.sources.readers import parquet_cdm, read_list, scan_fact
from episodica.sources.schemas import conform
from episodica.sources.stages import StageStore, shared_dir
from tests.helpers import cohort_table, day, rows_of


def test_conform_casts_and_checks(spark):
    df = spark.createDataFrame([(1, "2021-02-03 10:00:00", 9)], "person_id int, d string, x int")
    death = df.selectExpr("person_id", "cast(d as timestamp) death_date", "x")
    row = conform(death, "death").first()
    assert row.asDict() == {"person_id": 1, "death_date": day(33)}
    with pytest.raises(ValueError, match="death_date"):
        conform(df, "death")


def test_parquet_source_prunes_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, day(1), "wide"), (2, 7, day(2), "wide")],
                                 "person_id long, condition_concept_id long, condition_start_date date, note string")
    rows.write.parquet(f"{tmp_path}/condition_occurrence")
    cdm = parquet_cdm(spark, str(tmp_path))
    persons = spark.createDataFrame([(1,), (1,)], "person_id long")
    facts = scan_fact(cdm["condition_occurrence"], ["person_id", "condition_concept_id"], persons)
    assert rows_of(facts, "person_id", "condition_concept_id") == [(1, 7)]
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "note" not in plan and "condition_start_date" not in plan


def test_replace_cohorts_touches_only_its_ids(spark, tmp_path):
    path = f"{tmp_path}/cohort"
    sinks.replace_cohorts(cohort_table(spark, [(4, 1, 5), (15, 1, 6)]), path)
    for _ in range(2):
        sinks.replace_cohorts(cohort_table(spark, [(15, 2, 7), (16, 2, 8)]), path, files_per_cohort=3)
    found = rows_of(sinks.read_cohorts(spark, path), "cohort_definition_id", "subject_id")
    assert found == [(4, 1), (15, 2), (16, 2)]
    sinks.replace_cohorts(cohort_table(spark, [(15, 3, 7)]), path, ids=[15, 16])
    found = rows_of(sinks.read_cohorts(spark, path), "cohort_definition_id", "subject_id")
    assert found == [(4, 1), (15, 3)]


def test_remap(spark):
    moved = sinks.remap_cohort_ids(cohort_table(spark, [(9, 1, 5), (13, 2, 6), (11, 3, 7)]), REMAP_STRATA)
    assert rows_of(moved, "cohort_definition_id", "subject_id") == [(185, 1), (187, 2)]


def test_list_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "nco.csv").write_text("n,ConceptId,OutcomeName\n1,42,Broken nail\n")
    assert rows_of(read_list(spark, f"{tmp_path}/nco.csv", "nco_list"), "OutcomeName", "ConceptId") == [
        ("Broken nail", 42)
    ]


def test_export_keeps_unused_variants(spark, tmp_path):
    rows = spark.createDataFrame([("crude", "any", "none", "full", 1.5), ("crude", "any", "both", None, 2.5)],
                                 "analysis string, population string, censoring string, variant string, hr double")
    sinks.export_results(rows, f"{tmp_path}/out")
    back = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert {(r.censoring, r.variant, r.hr) for r in back.collect()} == {("none", "full", "1.5"), ("both", None, "2.5")}


def test_stages_live_in_the_session_folder(spark, tmp_path):
    assert shared_dir(spark) == shared_dir(spark)
    store = StageStore(spark, str(tmp_path), "run")
    store.save(spark.range(3), "a")
    assert store.save(spark.range(5), "a").count() == 5
    assert store.load("a").count() == 5


def test_penalties():
    grid = StudyConfig().lambdas()
    assert len(grid) == 51 and grid[0] == 100 and grid[-1] == pytest.approx(1e-3)
