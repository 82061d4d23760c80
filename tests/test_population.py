from episodica.config import StudyConfig
from episodica.operators import cohorts as co
from episodica.operators import features as fe
from episodica.operators import population as po
from episodica.sources.readers import Cdm
from tests.helpers import cohort_table, day, rows_of

SCHEMAS = {
    "person": "person_id long, gender_concept_id int, year_of_birth int, care_site_id int",
    "care_site": "care_site_id int, location_id int",
    "location": "location_id int, location_source_value string",
    "observation_period":
        "person_id long, observation_period_start_date date, observation_period_end_date date",
    "death": "person_id long, death_date date",
    "concept": "concept_id long, concept_name string",
    "drug_era":
        "person_id long, drug_concept_id long, drug_era_start_date date, drug_era_end_date date",
    "condition_occurrence":
        "person_id long, condition_concept_id long, condition_start_date date",
    "visit_occurrence": "person_id long, visit_start_date date",
}


def cdm_of(spark, cohort=(), **tables):
    def load(name):
        if name == "cohort":
            return cohort_table(spark, list(cohort))
        return spark.createDataFrame(list(tables.get(name, [])), SCHEMAS[name])

    return Cdm(load)


def test_next_dose(spark):
    cohort = [(178, p, 100) for p in (1, 2, 3, 4)] + [(177, p, 100) for p in (5, 6)]
    cohort += [(2, 1, 100), (2, 2, 100), (3, 2, 150), (2, 3, 100), (3, 3, 100), (2, 5, 120), (3, 5, 140)]
    table = cohort_table(spark, cohort)
    found = po.next_dose(po.arm_members(table), co.doses(table))
    assert dict(rows_of(found, "person_id", "next_vaccine")) == {
        1: None, 2: day(150), 3: None, 4: None, 5: day(120), 6: None
    }


def test_population_dates_and_defaults(spark):
    cdm = cdm_of(
        spark,
        [(178, 1, 100), (177, 2, 100), (177, 3, 100)],
        person=[(1, 8532, 1945, 1), (2, 8507, 1946, 1)],
        observation_period=[(1, day(0), day(50)), (1, day(60), day(300)), (1, day(400), day(500)),
                            (2, day(0), day(90))],
        death=[(1, day(290)), (1, day(280))],
    )
    found = {r.person_id: r for r in po.build_population(cdm).collect()}
    assert found[1].leave_date == day(300) and found[1].death_date == day(280)
    assert (found[1].gender, found[1].age, found[1].group) == ("Female", 76, "vaccinated")
    assert found[2].leave_date == day(90) and found[2].gender == "Male"
    assert found[3].leave_date is None and found[3].gender is None and found[3].weight == 1.0
    assert len(found) == 3


def test_assigned_dates_follow_the_vaccinated(spark):
    cohort = [(185, p, 10 if p < 30 else 20) for p in range(40)]
    cohort += [(177, p, 999) for p in range(100, 4100)] + [(186, 5, 70)]
    members = po.stratum_members(cohort_table(spark, cohort), {"AZ": 185, "PF": 186})
    drawn = po.assign_index_date(members, seed=5)
    assert drawn.where("stratum = 'AZ'").count() == 4040
    dates = {r.index_date: r["count"] for r in drawn.where(
        "stratum = 'AZ' and group = 'unvaccinated'").groupBy("index_date").count().collect()}
    assert set(dates) == {day(10), day(20)}
    assert abs(dates[day(10)] / 4000 - 0.75) < 0.03
    other = drawn.where("stratum = 'PF' and group = 'unvaccinated'")
    assert other.where("index_date <> date'2021-03-12'").count() == 0
    again = po.assign_index_date(members.repartition(7), seed=5)
    assert again.exceptAll(drawn).count() == 0


def test_age_bands(spark):
    born = [1945, 1946, 1947, 1903, 1902, 1900, 1948, 1949]
    cdm = cdm_of(spark, person=[(i, 8532, y, None) for i, y in enumerate(born)])
    people = spark.createDataFrame([(i, day(0)) for i in range(len(born) + 1)],
                                   "person_id long, index_date date")
    ages = dict(rows_of(fe.age_covariate(cdm, people, StudyConfig()).na.fill(-1.0), "person_id", "value"))
    assert [ages[i] for i in range(9)] == [76.0, 76.0, 75.0, 119.0, 120.0, 121.0, 74.0, 72.0, -1.0]
    bands = dict(rows_of(fe.age_group_factor(cdm, people, StudyConfig()), "person_id", "covariate"))
    assert bands[0] == "age_group_75_to_79_years"
    assert bands[3] == "age_group_115_to_119_years"
    assert [bands[i] for i in (4, 5, 6)] == [
        "age_group_115_to_119_years", "age_group_NA", "age_group_NA"
    ]
    assert bands[len(born)] == "age_group_NA"


def test_lookback_windows(spark):
    gaps = [0, 1, 30, 31, 180, 181]
    cdm = cdm_of(
        spark,
        concept=[(7, "A b"), (8, "A b")],
        drug_era=[(i, 7, day(500 - g), day(600)) for i, g in enumerate(gaps)] + [(1, 8, day(499), day(499))],
        condition_occurrence=[(i, 9, day(500 - g)) for i, g in enumerate(gaps)],
        visit_occurrence=[(i, day(500 - g)) for i, g in enumerate(gaps)] + [(1, day(499)), (1, day(498))],
    )
    people = spark.createDataFrame([(i, day(500)) for i in range(len(gaps))],
                                   "person_id long, index_date date")
    assert rows_of(fe.drug_flags(cdm, people), "person_id", "covariate") == [
        (1, "drug_era_A_b_1to30"), (2, "drug_era_A_b_1to30"),
        (3, "drug_era_A_b_31to180"), (4, "drug_era_A_b_31to180"),
    ]
    assert rows_of(fe.condition_flags(cdm, people), "person_id", "covariate") == [
        (1, "condition_ocurrence_NA_1to30"), (2, "condition_ocurrence_NA_1to30"),
        (3, "condition_ocurrence_NA_31to180"), (4, "condition_ocurrence_NA_31to180"),
        (5, "condition_ocurrence_NA_+181"),
    ]
    visits = fe.visit_counts(cdm, people)
    assert rows_of(visits.where("person_id = 1"), "covariate", "value") == [
        ("visit_ocurrence_Visit_to_GP_1to30", 2.0)
    ]


def test_unknown_site_is_a_level_and_unknown_region_is_not(spark):
    cdm = cdm_of(
        spark,
        person=[(1, 8532, 1940, 5), (2, 8532, 1940, None), (3, 8532, 1940, 6), (4, 8532, 1940, 7)],
        care_site=[(5, 10), (6, 1), (7, 2)],
        location=[(8, "Old name"), (1, "Northern Ireland"), (2, "North West")],
    )
    people = spark.createDataFrame([(i, day(0)) for i in (1, 2, 3, 4)], "person_id long, index_date date")
    assert rows_of(fe.location_factor(cdm, people, StudyConfig()), "person_id", "covariate") == [
        (1, "care_site_id_=_5"), (1, "region_South_East-Central"),
        (2, "care_site_id_=_NA"),
        (3, "care_site_id_=_6"),
        (4, "care_site_id_=_7"), (4, "region_North_West"),
    ]


def test_hot_person_and_hot_concept_in_fact_joins(spark):
    facts = [(1, 7, day(d % 400)) for d in range(3000)] + [(p, 7, day(10)) for p in range(2, 40)]
    cdm = cdm_of(spark, concept=[(7, "hot")], condition_occurrence=facts)
    people = spark.createDataFrame([(p, day(300)) for p in range(1, 40)], "person_id long, index_date date")
    unknown = cdm_of(spark, condition_occurrence=facts)
    for salts in (1, 8):
        flags = fe.condition_flags(cdm, people, salts)
        assert flags.count() == 3 + 38
        nameless = fe.condition_flags(unknown, people, salts)
        assert nameless.where("covariate like '%_NA_%'").count() == 3 + 38
        total = fe.alltime_counts(fe.condition_facts(cdm), cdm["concept"], people, fe.CONDITION, salts)
        assert dict(rows_of(total, "person_id", "value"))[1] == sum(1 for d in range(3000) if d % 400 < 300)


def test_rare_covariates(spark):
    people = spark.createDataFrame([(i, day(0)) for i in range(1000)], "person_id long, index_date date")
    rows = [(i, "five", 1.0) for i in range(5)] + [(i, "six", 1.0) for i in range(6)]
    flags = spark.createDataFrame(rows, "person_id long, covariate string, value double")
    assert {r.covariate for r in fe.drop_rare(flags, people, 0.005).collect()} == {"six"}
    summary = fe.rare_summary(flags, people, 0.005).first()
    assert (summary.n_covariates, summary.n_excluded, summary.threshold) == (2, 1, 5)


def test_a_tiny_share_keeps_all_but_empty_names(spark):
    people = spark.createDataFrame([(i, day(0)) for i in range(20)], "person_id long, index_date date")
    flags = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "person_id long, covariate string, value double")
    assert fe.drop_rare(flags, people, 0.0001).count() == 2
