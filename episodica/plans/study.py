"""The whole study as one chain of Spark jobs with a stage table after each step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.config import STRATUM_IDS, StudyConfig
from episodica.operators import balance, calibration, cohorts, effects, features, matrix
from episodica.operators import population as arms
from episodica.operators import propensity, survival, timetoevent
from episodica.sources.readers import Cdm
from episodica.sources.sinks import export_results
from episodica.sources.stages import StageStore

MAIN = "any"
ANALYSES = {"crude": "n", "adjusted": "weight"}
WEIGHTS = ["weight"]
WEIGHTINGS = {"before": "one", "after": "weight"}
GRID = ["population", *timetoevent.CELL]


@dataclass
class Study:
    """Readers of the stage tables a run leaves behind."""

    derived: DataFrame
    populations: DataFrame
    covariates: DataFrame
    balance: DataFrame
    controls: DataFrame
    error_model: DataFrame
    estimates: DataFrame
    calibrated: DataFrame
    checks: dict[str, int]


def score_population(
    store: StageStore, name: str, members: DataFrame, covariates: DataFrame, config: StudyConfig
) -> tuple[DataFrame, DataFrame]:
    """Propensity scores of one population and the covariates its model could choose from.

    ``members``: person_id, index_date, group. ``covariates``: long, with ``kind``.
    """
    mine = covariates.join(members.select("person_id").distinct(), "person_id", "left_semi")
    discrete = mine.where("kind = 'discrete'")
    flags = store.save(
        features.drop_rare(discrete, members, config.rare_share), f"{name}/flags"
    )
    others = mine.where("kind <> 'discrete'")
    names = matrix.covariate_names(flags)
    chosen: list[str] = []
    if names:
        vectors = store.save(matrix.flag_vectors(members, flags, names), f"{name}/vectors")
        path = propensity.lasso_path(vectors, flags, members, config)
        store.save(path, f"{name}/lasso_path")
        selected = propensity.lasso_selected(
            vectors, names, propensity.one_se_lambda(path), config.lasso_tol
        )
        chosen = [r.covariate for r in selected.collect()]
    factors = others.where("kind = 'factor'")
    reference = features.reference_levels(factors).select("covariate")
    levels = matrix.covariate_names(factors.join(F.broadcast(reference), "covariate", "left_anti"))
    usable = flags.select(*others.columns).unionByName(others)
    design = store.save(
        matrix.design_vectors(members, usable, chosen, levels), f"{name}/design"
    )
    scores = store.save(propensity.propensity_scores(design, config), f"{name}/scores")
    store.save(propensity.separation(usable, members), f"separation/population={name}")
    store.save(propensity.score_report(scores), f"score_report/population={name}")
    return scores, usable


def balance_of(covariates: DataFrame, scores: DataFrame) -> DataFrame:
    """SMD of every covariate before and after weighting."""
    persons = balance.overlap_weights(scores).withColumn("one", F.lit(1.0))
    kinds = [covariates.where(F.col("kind") == k) for k in ("discrete", "continuous", "factor")]
    return balance.before_after(balance.balance_table(*kinds, persons, WEIGHTINGS))


def run_study(
    cdm: Cdm,
    nco: DataFrame,
    store: StageStore,
    config: StudyConfig = StudyConfig(),
    report_path: str | None = None,
    index: DataFrame | None = None,
) -> Study:
    """Outcome cohorts, populations, scores, balance, negative controls and effects.

    ``index``: the cohort index list (cohortId, cohortName) whose ids and names the reports bear; without one they have
    the ids of the derived cohorts alone. The effect reports have a row for every analysis, empty where events were
    too few. Study rows that break a rule of the study end the run (:class:`effects.StudyError`).
    """
    derived = store.save(cohorts.build_outcome_cohorts(cdm["cohort"], config), "derived")
    base = store.save(arms.build_population(cdm, config), "base")
    everybody = base.select("person_id", "index_date")
    covariates = store.save(
        features.all_covariates(cdm, everybody, config), "covariates", ["kind"]
    )

    strata = store.save(
        arms.assign_index_date(arms.stratum_members(cdm["cohort"], STRATUM_IDS), config.seed),
        "strata",
        ["stratum"],
    )
    balances = []
    for name in (MAIN, *STRATUM_IDS):
        if name == MAIN:
            rows = base
        else:
            own = strata.where(F.col("stratum") == name)
            rows = arms.stratum_populations(base, own).drop("stratum")
        members = rows.select("person_id", "index_date", "group")
        scores, usable = score_population(store, name, members, covariates, config)
        weights = balance.overlap_weights(scores).select("person_id", "group", "weight")
        weighted = rows.drop("weight").join(weights, ["person_id", "group"])
        kept = balance.drop_zero_weight(weighted).withColumn("one", F.lit(1.0))
        store.save(kept, f"populations/population={name}")
        store.save(balance_of(usable, scores), f"balance/population={name}")
        balances.append(name)
    populations = store.load("populations")
    balance_rows = store.load("balance")

    control_sums = None
    for name in balances:
        mine = populations.where(F.col("population") == name)
        first = timetoevent.first_controls(cdm, nco, mine, config.salts)
        part = timetoevent.control_sums(mine, first, nco, config, WEIGHTS, ["population"])
        control_sums = part if control_sums is None else control_sums.unionByName(part)
    controls = store.save(
        survival.estimate(control_sums, ["population", "outcome"], ANALYSES), "controls"
    )
    known = controls.where("analysis = 'adjusted'").withColumnRenamed("log_hr", "log_rr")
    model = store.save(calibration.fit_error_model(known, ["population"]), "error_model")

    named = cohorts.composite_outcomes(derived)
    rows, observed = effects.checked(timetoevent.event_rows(populations, named))
    rows = store.save(rows, "event_rows")
    checks = effects.stop_on_violations(observed)
    counts = store.save(timetoevent.event_counts(rows, GRID, config), "event_counts")
    sums = timetoevent.study_sums(populations, rows, config, WEIGHTS, ["population"])
    fitted = store.save(survival.estimate(sums, GRID, ANALYSES, config.min_events), "fitted")
    if index is None:
        ids = derived.select(F.col("cohort_definition_id").alias("cohortId")).distinct()
        index = ids.withColumn("cohortName", F.lit(None).cast("string"))
    keys = effects.report_keys(index, [MAIN, *STRATUM_IDS], list(ANALYSES))
    estimates = store.save(effects.effect_report(keys, counts, fitted), "estimates")
    adjusted = estimates.where("analysis = 'adjusted' and HR is not null").select(
        *GRID, F.log("HR").alias("log_rr"), F.col("SE").alias("se")
    )
    calibrated = store.save(
        effects.calibrated_report(
            keys.where("analysis = 'adjusted'"), calibration.calibrate(adjusted, model, ["population"])
        ),
        "calibrated",
    )
    if report_path:
        export_results(estimates, f"{report_path}/estimates")
        export_results(calibrated.withColumn("analysis", F.lit("calibrated")),
                       f"{report_path}/calibrated")
        export_results(balance_rows, f"{report_path}/balance", ["population"])
        for name in ("separation", "score_report"):
            export_results(store.load(name), f"{report_path}/{name}", ["population"])
        export_results(controls, f"{report_path}/negative_controls", ["population", "analysis"])
    return Study(derived, populations, covariates, balance_rows, controls, model, estimates,
                 calibrated, checks)
