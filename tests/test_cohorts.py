"""Outcome cohorts against hand-made boundaries and a brute-force computation."""

import random

import pytest

from episodica.config import CENSORINGS, OUTCOME_NAMES, RISK_WINDOWS, StudyConfig
from episodica.operators import cohorts as co
from tests.helpers import DAY0, cohort_table, day, rows_of


def derived_rows(spark, rows, **options):
    table = co.decode_cohort_id(co.build_outcome_cohorts(cohort_table(spark, rows), **options))
    return {
        (r.subject_id, r.outcome_id, r.censoring, r.risk_window,
         (r.cohort_start_date - DAY0).days, (r.cohort_end_date - DAY0).days)
        for r in table.collect()
    }


def test_horizon_and_window_boundaries(spark):
    gaps = [0, 1, 30, 31, 90, 91, 180, 181, 365, 366]
    rows = [(4, p, 1000) for p, _ in enumerate(gaps)] + [(5, p, 1000 + g) for p, g in enumerate(gaps)]
    found = {p: w for p, _, c, w, _, _ in derived_rows(spark, rows) if c == "none"}
    assert found == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3, 7: 4, 8: 4}


@pytest.mark.parametrize("before,kept", [(0, True), (1, False), (179, False), (180, True)])
def test_washout_boundaries(spark, before, kept):
    rows = [(4, 1, 1000), (6, 1, 1000 - before), (6, 1, 1010)]
    assert bool(derived_rows(spark, rows)) is kept


def test_washout_is_per_outcome_and_by_episode(spark):
    rows = [(4, 1, 1000), (6, 1, 950), (6, 1, 1010), (7, 1, 1010)]
    assert {o for _, o, *_ in derived_rows(spark, rows)} == {7}
    assert {o for _, o, *_ in derived_rows(spark, rows, washout_key="row")} == {6, 7}


def test_nearest_infection_gets_the_outcome(spark):
    rows = [(4, 1, 1000), (4, 1, 1050), (5, 1, 1060)]
    found = derived_rows(spark, rows)
    assert {r[4] for r in found if r[2] == "none"} == {1000, 1050}
    assert {r[4] for r in found if r[2] == "covid"} == {1050}


def test_two_outcomes_on_one_day_count_once(spark):
    rows = [(4, 1, 1000), (5, 1, 1010), (5, 1, 1010)]
    assert len([r for r in derived_rows(spark, rows) if r[2] == "none"]) == 1


@pytest.mark.parametrize("dose,censored", [(1000, False), (1001, True), (1009, True), (1010, False)])
def test_dose_between(spark, dose, censored):
    rows = [(4, 1, 1000), (5, 1, 1010), (2, 1, dose)]
    kinds = {r[2] for r in derived_rows(spark, rows)}
    assert ("vaccine" not in kinds) is censored
    assert ("both" not in kinds) is censored
    assert "none" in kinds


def test_end_date_ignores_the_window_unless_asked(spark):
    rows = [(4, 1, 1000), (5, 1, 1010), (5, 1, 1040)]
    literal = {(r[3], r[5]) for r in derived_rows(spark, rows) if r[2] == "none"}
    own = {(r[3], r[5]) for r in derived_rows(spark, rows, end_in_window=True) if r[2] == "none"}
    assert literal == {(1, 1010), (2, 1010)}
    assert own == {(1, 1010), (2, 1040)}


def brute_force(rows, config=StudyConfig()):
    """The cohorts by loops over a person's days."""
    by = {}
    for cohort, person, when in rows:
        by.setdefault(person, {}).setdefault(cohort, set()).add(when)
    out = set()
    for person, days in by.items():
        doses = days.get(2, set()) | days.get(3, set())
        for outcome in OUTCOME_NAMES:
            events = days.get(outcome, set())
            pairs = [
                (c, o) for c in days.get(4, set()) for o in events
                if 1 <= o - c <= config.horizon_days
                and not any(1 <= c - e < config.washout_days for e in events)
            ]
            near = {(c, o) for c, o in pairs if c == max(x for x, y in pairs if y == o)}
            free = {(c, o) for c, o in pairs if not any(c < d < o for d in doses)}
            for rule, kept in zip(CENSORINGS, (set(pairs), near, free, near & free)):
                for c in {c for c, _ in kept}:
                    ends = [o for x, o in kept if x == c]
                    for w, first, last in RISK_WINDOWS:
                        if any(first <= o - c <= last for o in ends):
                            out.add((person, outcome, rule, w, c, min(ends)))
    return out


def test_random_persons_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for person in range(60):
        rows += [(4, person, rng.randrange(900)) for _ in range(rng.randrange(5))]
        rows += [(rng.choice((2, 3)), person, rng.randrange(900)) for _ in range(rng.randrange(3))]
        rows += [(rng.randrange(5, 15), person, rng.randrange(900)) for _ in range(rng.randrange(25))]
    expected = brute_force(rows)
    assert len(expected) > 300
    assert derived_rows(spark, rows) == expected


def test_hot_person_holds_most_rows(spark):
    """One person with most rows, many of them repeated: same result as by loops."""
    rng = random.Random(3)
    hot = [(4, 1, d) for d in range(0, 900, 45)] * 5
    hot += [(5 + d % 3, 1, d) for d in range(0, 1200, 7)] * 5
    rows = hot + [(4, p, rng.randrange(500)) for p in range(2, 30)]
    rows += [(5, p, rng.randrange(700)) for p in range(2, 30)]
    config = StudyConfig(washout_days=2)
    table = co.decode_cohort_id(co.build_outcome_cohorts(cohort_table(spark, rows), config))
    found = {
        (r.subject_id, r.outcome_id, r.censoring, r.risk_window,
         (r.cohort_start_date - DAY0).days, (r.cohort_end_date - DAY0).days)
        for r in table.collect()
    }
    assert found == brute_force(rows, config)
    assert len(found) == table.count()


def test_ids_and_composites(spark):
    rows = [(4, p, 1000) for p in range(10)] + [(5 + p, p, 1000 + 40) for p in range(10)]
    derived = co.build_outcome_cohorts(cohort_table(spark, rows))
    ids = {r.cohort_definition_id for r in derived.collect()}
    assert len(ids) == 40 and min(ids) == 16 and max(ids) == 172
    named = co.composite_outcomes(derived).where("censoring = 'none'")
    got = {(r.person_id, r.outcome) for r in named.collect()}
    assert {(1, "DVT"), (1, "VTE"), (2, "PE"), (2, "VTE"), (4, "IS"), (4, "ATE"), (5, "TIA"),
            (5, "ATE"), (6, "MI"), (6, "ATE"), (3, "HS"), (7, "MP"), (8, "VACA"), (9, "HF")} == got


def test_both_is_the_intersection(spark):
    rng = random.Random(11)
    rows = [(rng.choice([2, 4, 4, 5, 6]), rng.randrange(40), rng.randrange(600)) for _ in range(900)]
    table = cohort_table(spark, rows)
    pairs = co.flagged_pairs(co.infections(table), co.outcome_events(table), co.doses(table))
    kept = {c: set(rows_of(co.censored_pairs(pairs, c), *co.PAIR)) for c in CENSORINGS}
    assert kept["both"] == kept["covid"] & kept["vaccine"]
    assert kept["covid"] < kept["none"] and kept["vaccine"] < kept["none"]
    nearest = [(p, o, d) for p, o, _, d in kept["covid"]]
    assert len(nearest) == len(set(nearest))


def test_pair_counts(spark):
    table = cohort_table(spark, [(4, 1, 10), (4, 1, 10), (4, 1, 20), (5, 1, 5), (5, 1, 6), (5, 2, 6)])
    counts = co.pair_counts(co.infections(table), co.outcome_events(table))
    assert rows_of(counts, "person_id", "outcome_id", "n_pairs") == [(1, 5, 4)]


def test_next_dose_is_strictly_later(spark):
    table = cohort_table(spark, [(4, 1, 10), (4, 1, 30), (2, 1, 10), (3, 1, 20), (2, 1, 25)])
    found = co.with_next_dose(co.infections(table), co.doses(table))
    assert rows_of(found.fillna({}), "covid_date", "next_dose") == [
        (day(10), day(20)), (day(30), None)
    ]
