"""Study tables and Fine-Gray estimates against row-level computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.config import StudyConfig
from episodica.operators import cohorts as co
from episodica.operators import survival as su
from episodica.operators import timetoevent as te
from tests.helpers import day

PERSON = ("person_id long, index_date date, group string, next_vaccine date, leave_date date, "
          "death_date date, weight double, one double")
OUTCOME = ("person_id long, outcome string, censoring string, risk_window int, covid_date date, "
           "outcome_date date")
ARMS = ("unvaccinated", "vaccinated")


def simulate(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    persons, outcomes = [], []
    for i in range(n):
        arm = ARMS[rng.integers(2)]

        def maybe(p, high):
            return day(int(rng.integers(-3, high))) if rng.random() < p else None

        persons.append((i, day(0), arm, maybe(0.4, 200), maybe(0.9, 250), maybe(0.3, 250),
                        float(rng.uniform(0.1, 0.9)), 1.0))
        for censoring in co.CENSORINGS:
            for outcome in ("DVT", "VTE", "HF"):
                for _ in range(rng.integers(0, 3)):
                    start = int(rng.integers(-10, 220))
                    outcomes.append((i, outcome, censoring, int(rng.integers(1, 5)), day(start),
                                     day(start + int(rng.integers(1, 300)))))
    return (spark.createDataFrame(persons, PERSON),
            spark.createDataFrame(outcomes, OUTCOME).distinct())


def dense_rows(population, outcomes, censoring, variant, outcome, window, people=None):
    """The study table of one analysis as the definition reads."""
    rows, of_person = [], {}
    for o in outcomes:
        if o.outcome == outcome and o.risk_window == window:
            of_person.setdefault(o.person_id, []).append(o)
    for p in population:
        limited = p.group == "unvaccinated" or censoring in ("vaccine", "both")
        source = censoring
        if variant == "full" and p.group == "unvaccinated":
            source = {"none": "vaccine", "covid": "both"}[censoring]
        mine = [o for o in of_person.get(p.person_id, []) if o.censoring == source]
        for o in mine or [None]:
            dates = [p.death_date, p.leave_date, o and o.covid_date, p.next_vaccine if limited else None]
            known = [d for d in dates if d]
            if not known:
                continue
            end = min(known)
            event = 2 if end == p.death_date else 1 if o and end == o.covid_date else 0
            time = (end - p.index_date).days
            if time >= 1:
                rows.append((p.group == "vaccinated", time, event, p.weight))
                if people is not None:
                    people.append(p.person_id)
    return rows


def row_level_fine_gray(rows, weighted=True):
    """Risk sets person by person, then the Efron likelihood by Newton steps."""
    x = np.array([r[0] for r in rows], float)
    t = np.array([r[1] for r in rows])
    e = np.array([r[2] for r in rows])
    w = np.array([r[3] for r in rows])
    g = w if weighted else np.ones_like(w)
    step = {}
    for s in sorted(set(t)):
        exposed = g[(t > s) | ((t == s) & (e == 0))].sum()
        lost = g[(t == s) & (e == 0)].sum()
        step[s] = 1 - lost / exposed if lost else 1.0

    def uncensored(at):
        return np.prod([v for s, v in step.items() if s < at])

    sets = []
    for s in sorted(set(t[e == 1])):
        risk = np.where(t >= s, w, 0.0)
        for i in np.flatnonzero((e == 2) & (t < s)):
            risk[i] = w[i] * uncensored(s) / uncensored(t[i])
        sets.append((risk, np.flatnonzero((e == 1) & (t == s))))
    beta = 0.0
    for _ in range(60):
        score = info = 0.0
        for risk, who in sets:
            score += (w[who] * x[who]).sum()
            for k in range(len(who)):
                left = risk.copy()
                left[who] -= k / len(who) * w[who]
                z = left * np.exp(beta * x)
                p = (z * x).sum() / z.sum()
                score -= w[who].mean() * p
                info += w[who].mean() * p * (1 - p)
        beta += score / info
    return beta, info ** -0.5


@pytest.fixture(scope="module")
def simulated(spark):
    population, outcomes = simulate(spark)
    return population.cache(), outcomes.cache()


@pytest.mark.parametrize("weighted", [True, False])
def test_estimates_equal_row_level(spark, simulated, weighted):
    population, outcomes = simulated
    sums = te.study_sums(population, te.event_rows(population, outcomes), StudyConfig(), ["weight"])
    analyses = {"crude": "n", "adjusted": "weight"}
    fitted = {
        (r.censoring, r.variant, r.outcome, r.risk_window, r.analysis): r
        for r in su.estimate(sums, te.CELL, analyses, 1, weighted).collect()
    }
    persons, events = population.collect(), outcomes.collect()
    cells = [("none", "partial", "DVT", 1), ("none", "full", "DVT", 2), ("covid", "full", "HF", 3),
             ("vaccine", None, "VTE", 4), ("both", None, "HF", 1)]
    for cell in cells:
        rows = dense_rows(persons, events, *cell)
        for analysis in ("crude", "adjusted"):
            used = rows if analysis == "adjusted" else [(a, b, c, 1.0) for a, b, c, _ in rows]
            beta, se = row_level_fine_gray(used, weighted)
            got = fitted[(*cell, analysis)]
            assert got.converged
            assert got.log_hr == pytest.approx(beta, abs=1e-8)
            assert got.se == pytest.approx(se, abs=1e-8)
            assert got.hr == pytest.approx(np.exp(beta)) and got.hr_inverse == pytest.approx(np.exp(-beta))
            assert got.low95 < got.hr < got.upper95


def test_event_counts_and_gate(spark, simulated):
    population, outcomes = simulated
    counts = te.event_counts(te.event_rows(population, outcomes), te.CELL)
    persons, events = population.collect(), outcomes.collect()
    for r in counts.collect():
        rows = dense_rows(persons, events, r.censoring, r.variant, r.outcome, r.risk_window)
        assert r.n_vaccinated == sum(1 for a, _, e, _ in rows if a and e == 1)
        assert r.n_unvaccinated == sum(1 for a, _, e, _ in rows if not a and e == 1)


def test_full_needs_its_partial(spark):
    def row(variant, n, arm):
        return [("none", variant, "HF", 1, arm, 1, 5)] * n

    rows = spark.createDataFrame(
        row("partial", 4, "vaccinated") + row("full", 9, "vaccinated"),
        "censoring string, variant string, outcome string, risk_window int, group string, event int, time int",
    )
    gate = {r.variant: r.enough for r in te.event_counts(rows, te.CELL).collect()}
    assert gate == {"partial": False, "full": False}


def test_one_study_table(spark, simulated):
    population, outcomes = simulated
    part = outcomes.where("outcome = 'DVT' and risk_window = 2 and censoring = 'vaccine'")
    table = te.study_table(population, part, "vaccine")
    expected = dense_rows(population.collect(), outcomes.collect(), "vaccine", None, "DVT", 2)
    got = [(r.group == "vaccinated", r.time, r.event, r.weight) for r in table.collect()]
    assert sorted(got) == sorted(expected)


def follow(spark, arm, death=None, leave=None, dose=None, infection=None, censoring="none"):
    population = spark.createDataFrame(
        [(1, day(0), arm, day(dose), day(leave), day(death), 1.0, 1.0)], PERSON)
    outcomes = spark.createDataFrame(
        [(1, day(infection), day(infection + 5))] if infection is not None else [],
        "person_id long, covid_date date, outcome_date date")
    rows = te.study_table(population, outcomes, censoring).collect()
    return [(r.time, r.event) for r in rows]


def test_time_to_event_boundaries(spark):
    assert follow(spark, "vaccinated", death=10, infection=10) == [(10, 2)]
    assert follow(spark, "vaccinated", leave=10, infection=10) == [(10, 1)]
    assert follow(spark, "vaccinated", leave=10) == [(10, 0)]
    assert follow(spark, "vaccinated", leave=50, dose=10, infection=20) == [(20, 1)]
    assert follow(spark, "unvaccinated", leave=50, dose=10, infection=20) == [(10, 0)]
    assert follow(spark, "vaccinated", leave=50, dose=10, infection=20, censoring="both") == [(10, 0)]
    assert follow(spark, "vaccinated", leave=50, infection=-5) == []
    assert follow(spark, "vaccinated", leave=50, infection=0) == []
    assert follow(spark, "vaccinated") == []
    assert follow(spark, "vaccinated", death=7) == [(7, 2)]


def estimate(spark, rows):
    """rows: (arm, time, event, weight)."""
    sums = {}
    for arm, time, event, weight in rows:
        key = {1: "e", 2: "d", 0: "c"}[event] + arm[0]
        s = sums.setdefault(time, {f"{c}{a}": [0, 0.0] for c in "edc" for a in "vu"})
        s[key][0] += 1
        s[key][1] += weight
    names = [f"{c}{a}" for c in "edc" for a in "vu"]
    data = [(1, t, *[s[n][0] for n in names], *[s[n][1] for n in names]) for t, s in sums.items()]
    schema = "k int, time int, " + ", ".join(f"n_{n} long" for n in names) + ", " + ", ".join(
        f"w_{n} double" for n in names)
    return su.estimate(spark.createDataFrame(data, schema), ["k"], {"a": "w"}).collect()


def test_no_deaths_is_a_plain_cox_model(spark):
    rng = np.random.default_rng(4)
    rows = [("vu"[i % 2], int(rng.integers(1, 30)), int(rng.integers(0, 2)), float(rng.uniform(0.2, 1)))
            for i in range(120)]
    arms = [({"v": "vaccinated", "u": "unvaccinated"}[a], t, e, w) for a, t, e, w in rows]
    got = estimate(spark, arms)[0]
    beta, se = row_level_fine_gray([(a == "v", t, e, w) for a, t, e, w in rows])
    assert got.log_hr == pytest.approx(beta, abs=1e-8) and got.se == pytest.approx(se, abs=1e-8)


def test_all_events_on_one_day(spark):
    rows = [("vaccinated", 5, 1, 1.0)] * 3 + [("unvaccinated", 5, 1, 1.0)] * 3
    assert estimate(spark, rows)[0].log_hr == pytest.approx(0.0, abs=1e-9)


def test_empty_arm_has_no_estimate(spark):
    rows = [("vaccinated", 5, 1, 1.0), ("vaccinated", 6, 0, 1.0), ("unvaccinated", 7, 0, 1.0)]
    got = estimate(spark, rows)[0]
    assert got.log_hr is None and got.hr is None and got.converged is False and got.n_events == 1


def test_no_event_gives_no_row(spark):
    assert estimate(spark, [("vaccinated", 5, 0, 1.0), ("unvaccinated", 6, 0, 1.0)]) == []


def test_no_effect_gives_a_ratio_near_one(spark):
    rng = np.random.default_rng(9)
    rows = [(("vaccinated", "unvaccinated")[i % 2], int(rng.exponential(60)) + 1,
             int(rng.choice([0, 1, 2], p=[.5, .3, .2])), 1.0) for i in range(4000)]
    got = estimate(spark, rows)[0]
    assert got.low95 < 1 < got.upper95


def test_controls_of_one_name_take_the_first_day(spark):
    population = spark.createDataFrame(
        [(1, day(0), "vaccinated", None, day(90), None, 0.5, 1.0),
         (2, day(0), "unvaccinated", None, day(90), None, 0.5, 1.0)], PERSON)
    first = spark.createDataFrame(
        [(1, 1, "A", day(20)), (1, 2, "A", day(10)), (2, 3, "B", day(5))],
        "person_id long, ConceptId long, outcome string, event_date date")
    nco = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3), ("C c", 4)], "OutcomeName string, ConceptId long")
    sums = te.control_sums(population, first, nco, StudyConfig(), [])
    got = {(r.outcome, r.time): (r.n_ev, r.n_eu, r.n_cv, r.n_cu) for r in sums.collect()}
    assert got == {("A", 10): (1, 0, 0, 0), ("A", 90): (0, 0, 0, 1), ("B", 5): (0, 1, 0, 0),
                   ("B", 90): (0, 0, 1, 0), ("C_c", 90): (0, 0, 1, 1)}


def test_violations(spark):
    population = spark.createDataFrame(
        [(1, day(0), "vaccinated", day(12), day(90), None, 0.5, 1.0)], PERSON)
    outcomes = spark.createDataFrame(
        [(1, "HF", "vaccine", 1, day(5), day(20)), (1, "HF", "both", 1, day(5), day(8))], OUTCOME)
    rows = te.event_rows(population, outcomes)
    got = {r.censoring: (r.n_rows, r.n_violations) for r in te.censor_violations(rows).collect()}
    assert got == {"vaccine": (1, 1), "both": (1, 0)}
    assert rows.where(F.col("event") == 1).count() == 2


def row_level_robust(rows, people, beta):
    """Sum over persons of the squared sums of their rows' score residuals, every tied event a term of its own."""
    x, t, e, w = (np.array([float(r[k]) for r in rows]) for k in range(4))
    step = {s: 1 - w[(t == s) & (e == 0)].sum() / max(w[(t > s) | ((t == s) & (e == 0))].sum(), 1e-300) for s in set(t)}

    def uncensored(at):
        return np.prod([v for s, v in step.items() if s < at])

    residual = np.zeros(len(rows))
    for s in sorted(set(t[e == 1])):
        who = np.flatnonzero((t == s) & (e == 1))
        at_risk = np.where(t >= s, 1.0, 0.0)
        for i in np.flatnonzero((t < s) & (e == 2)):
            at_risk[i] = uncensored(s) / uncensored(t[i])
        means = []
        for k in range(len(who)):
            part = at_risk.copy()
            part[who] -= k / len(who)
            risk = w * part * np.exp(beta * x)
            mean = (risk * x).sum() / risk.sum()
            residual -= risk / risk.sum() * w[who].mean() * (x - mean)
            means.append(mean)
        residual[who] += w[who] * (x[who] - np.mean(means))
    assert abs(residual.sum()) < 1e-6
    return sum(residual[np.array(people) == p].sum() ** 2 for p in set(people))


def test_robust_interval_equals_row_level(spark, simulated):
    population, outcomes = simulated
    squared = (F.col("weight") * F.col("weight")).alias("weight2")
    people, rows = population.select("*", squared), te.event_rows(population, outcomes).select("*", squared)
    assert rows.groupBy(*te.CELL, "person_id").count().where("count > 1").count() > 20
    sums = te.study_sums(people, rows, StudyConfig(), ["weight", "weight2"])
    days = su.risk_days(sums, te.CELL, {"crude": "n", "adjusted": "weight"}, squares={"crude": "n", "adjusted": "weight2"})
    scores = su.score_table(days, [*te.CELL, "analysis"], 5).cache()
    found = {
        (r.censoring, r.variant, r.outcome, r.risk_window, r.analysis): r
        for r in su.robust_effects(scores, rows, te.CELL, {"crude": None, "adjusted": "weight"}).collect()
    }
    persons, events = population.collect(), outcomes.collect()
    for cell in [("none", "partial", "DVT", 1), ("none", "full", "HF", 2), ("vaccine", None, "VTE", 4)]:
        for analysis in ("crude", "adjusted"):
            ids = []
            table = dense_rows(persons, events, *cell, ids)
            table = table if analysis == "adjusted" else [(a, b, c, 1.0) for a, b, c, _ in table]
            r = found[(*cell, analysis)]
            meat = row_level_robust(table, ids, r.log_hr)
            assert r.robust_se == pytest.approx(np.sqrt(meat) * r.se**2, rel=1e-8)
            assert r.robust_low95 == pytest.approx(np.exp(r.log_hr - su.Z95 * r.robust_se))
