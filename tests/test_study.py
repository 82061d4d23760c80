"""The whole study on the smallest tables, its reports and the checks that stop it."""

import dataclasses
import datetime
import os

import pytest
from pyspark.sql import functions as F

from episodica.operators import effects
from episodica.plans.study import run_study
from episodica.sources.fixtures import FIXTURE_CONFIG, OrderTables, fixture_cdm
from episodica.sources.stages import StageStore

SF_DIR = "/root/testdata/sf0.001"
CONFIG = dataclasses.replace(FIXTURE_CONFIG, lambda_exponents=(-1.0, -1.4, -0.2), folds=2)


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    if not os.path.isdir(SF_DIR):
        pytest.skip("driver tables not here")
    tables = OrderTables(spark, SF_DIR)
    reports = str(tmp_path_factory.mktemp("reports"))
    index = tables.cohort_index().where("cohortId <> 20")
    return run_study(fixture_cdm(spark, SF_DIR), tables.nco_list(), StageStore(spark), CONFIG, reports, index), reports


def test_every_analysis_has_its_row(spark, ran):
    study, reports = ran
    grid = study.estimates
    assert grid.count() == 3 * 2 * 6 * 44 == grid.select("population", "analysis", "censoring", "variant", "outcome", "risk_window").distinct().count()
    assert grid.where("outcome = 'ATE' and cohortId is not null").count() == 0
    assert grid.where("outcome = 'ATE' and cohortName like 'ATE %'").count() == 3 * 2 * 6 * 4
    # A cohort that the list lacks keeps its rows, without a name.
    assert grid.where("cohortName is null").select("outcome", "risk_window", "censoring").distinct().count() == 1
    assert grid.where("cohortName is null").count() == 3 * 2 * 2
    filled = grid.where("n_vaccinated is not null")
    assert 0 < filled.count() < grid.count()
    assert filled.where("n_vaccinated + n_unvaccinated < 5").count() == 0
    assert grid.where("n_vaccinated is null and HR is not null").count() == 0
    written = spark.read.option("header", True).csv(f"{reports}/estimates")
    assert written.count() == grid.count() and {"cohortId", "cohortName", "HR", "HRinvers", "SE"} <= set(written.columns)


def test_calibrated_rows_match_the_grid(spark, ran):
    study, reports = ran
    assert study.calibrated.count() == 3 * 6 * 44
    known = study.estimates.where("analysis = 'adjusted' and HR is not null").count()
    assert 0 < study.calibrated.where("HR is not null").count() <= known
    assert spark.read.option("header", True).csv(f"{reports}/calibrated").count() == 3 * 6 * 44


def test_checks_count_rows_and_find_nothing(ran):
    study, _ = ran
    assert study.checks["rows"] > 0
    assert {k: n for k, n in study.checks.items() if k != "rows"} == {"late_events": 0, "early_outcomes": 0, "unknown_groups": 0}


ROW = "person_id long, `group` string, censoring string, variant string, covid_date date, outcome_date date, next_vaccine date, event int"


@pytest.mark.parametrize("change,broken", [
    ({}, None),
    ({"outcome_date": datetime.date(2021, 3, 1), "next_vaccine": datetime.date(2021, 2, 1)}, "late_events"),
    ({"outcome_date": datetime.date(2020, 1, 1)}, "early_outcomes"),
    ({"group": "neither"}, "unknown_groups"),
    ({"group": None}, "unknown_groups"),
    ({"outcome_date": None, "next_vaccine": None, "covid_date": None}, None),
])
def test_a_planted_violation_stops_the_run(spark, change, broken):
    day = datetime.date(2021, 1, 1)
    good = {"person_id": 1, "group": "vaccinated", "censoring": "vaccine", "variant": None, "covid_date": day,
            "outcome_date": day, "next_vaccine": None, "event": 1}
    rows = spark.createDataFrame([tuple((good | c).values()) for c in ({}, {}, change)], ROW).repartition(2)
    stored, observed = effects.checked(rows)
    assert StageStore(spark).save(stored, "rows").count() == 3
    if broken is None:
        assert effects.stop_on_violations(observed)["rows"] == 3
    else:
        with pytest.raises(effects.StudyError, match=broken):
            effects.stop_on_violations(observed)


@pytest.mark.parametrize("dose,broken", [(0, None), (1, "late_events"), (-1, "late_events")])
def test_a_dose_on_the_day_of_infection_stops_nothing(spark, dose, broken):
    """An event wins the tie with a dose of its day, which lies not between infection and outcome; doses of other days do not."""
    day = datetime.date(2021, 1, 10)
    change = {"outcome_date": day + datetime.timedelta(30), "next_vaccine": day + datetime.timedelta(dose)}
    rows = spark.createDataFrame([tuple(({"person_id": 1, "group": "vaccinated", "censoring": "both", "variant": None, "covid_date": day,
                                          "outcome_date": day, "next_vaccine": None, "event": 1} | change).values())], ROW)
    stored, observed = effects.checked(rows)
    assert StageStore(spark).save(stored, "ties").count() == 1
    if broken is None:
        assert effects.stop_on_violations(observed) == {"rows": 1, "late_events": 0, "early_outcomes": 0, "unknown_groups": 0}
    else:
        with pytest.raises(effects.StudyError, match=broken):
            effects.stop_on_violations(observed)


def test_index_names(spark):
    listed = spark.createDataFrame([(15, "VTE 0 to 30 no"), (15, "VTE again"), (174, None), (3, "dose"), (None, "x"), (5000, "y")],
                                   "cohortId int, cohortName string")
    found = {(r.outcome, r.risk_window, r.censoring): (r.cohortId, r.cohortName) for r in effects.index_names(listed).collect()}
    assert found == {
        ("VTE", 1, "none"): (15, "VTE 0 to 30 no"),
        ("ATE", 1, "none"): (None, "ATE 0 to 30 no"),
        ("HF", 4, "both"): (174, None),
    }
    keys = effects.report_keys(listed.where("false"), ["any"], ["crude"])
    assert keys.count() == 264 and keys.where(F.col("cohortName").isNotNull()).count() == 0
