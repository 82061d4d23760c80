"""Registered queries: each operator of the library over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.config import (
    REMAP_MAIN,
    REMAP_STRATA,
    STRATUM_IDS,
    UNVACCINATED,
    VACCINATED,
)
from episodica.functions.random import uniform
from episodica.functions.text import underscored
from episodica.operators import balance as bal
from episodica.operators import calibration as cal
from episodica.operators import cohorts as co
from episodica.operators import effects as ef
from episodica.operators import features as fe
from episodica.operators import matrix as mx
from episodica.operators import population as po
from episodica.operators import propensity as ps
from episodica.operators import survival as su
from episodica.operators import timetoevent as te
from episodica.sources import sinks
from episodica.sources.fixtures import FIXTURE_CONFIG, OrderTables, fixture_cdm, stand_in_score
from episodica.sources.readers import read_list, scan_fact
from episodica.sources.stages import StageStore

SAMPLE_SIZE = 500
STAND_IN = {"before": "one", "after": "weight"}
ANALYSES = {"crude": "n", "adjusted": "weight"}
WEIGHTS = ["weight"]


def r6(name: str, source: Column | str | None = None) -> Column:
    return F.round(F.col(name) if source is None else source, 6).alias(name)


def off_tie(name: str, source: Column | str | None = None) -> Column:
    """Rounded sum, moved off the halves that exact fractions can hit."""
    return r6(name, (F.col(name) if source is None else source) + 1e-9)


class Study:
    """Tables of the study on one data folder, shared by the queries below.

    Tables are lazy, but for the hand-over points of the study, which are stage tables
    as in a full run: derived cohorts, weighted populations, covariates, model inputs.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.config = FIXTURE_CONFIG
        self.orders = OrderTables(spark, sf_dir)
        self.cdm = fixture_cdm(spark, sf_dir)
        self.cohort = self.cdm["cohort"]

    @cached_property
    def infections(self) -> DataFrame:
        return co.infections(self.cohort)

    @cached_property
    def outcomes(self) -> DataFrame:
        return co.outcome_events(self.cohort)

    @cached_property
    def doses(self) -> DataFrame:
        return co.doses(self.cohort)

    @cached_property
    def pairs(self) -> DataFrame:
        return co.flagged_pairs(self.infections, self.outcomes, self.doses, self.config)

    @cached_property
    def derived(self) -> DataFrame:
        return co.outcome_cohorts(self.pairs)

    @cached_property
    def stages(self) -> StageStore:
        return StageStore(self.spark)

    @cached_property
    def staged_derived(self) -> DataFrame:
        return self.stages.save(self.derived, "derived")

    @cached_property
    def named(self) -> DataFrame:
        return co.composite_outcomes(self.staged_derived)

    @cached_property
    def members(self) -> DataFrame:
        return po.arm_members(self.cohort)

    @cached_property
    def individuals(self) -> DataFrame:
        return self.members.select("person_id", "index_date")

    @cached_property
    def population(self) -> DataFrame:
        return po.build_population(self.cdm, self.config)

    @cached_property
    def stratum_arms(self) -> DataFrame:
        return po.stratum_members(self.cohort, STRATUM_IDS)

    @cached_property
    def stratum_members(self) -> DataFrame:
        return po.assign_index_date(self.stratum_arms, self.config.seed)

    def weigh(self, population: DataFrame) -> DataFrame:
        scored = population.withColumn("ps", stand_in_score())
        return bal.drop_zero_weight(bal.overlap_weights(scored)).withColumn("one", F.lit(1.0))

    @cached_property
    def weighted(self) -> DataFrame:
        return self.populations.where("population = 'any'").drop("population")

    @cached_property
    def populations(self) -> DataFrame:
        """The main population and the two vaccine strata, told apart by a column."""
        everybody = self.individuals.withColumn("stratum", F.lit("any")).unionByName(
            self.stratum_members.select("stratum", "person_id", "index_date")
        )
        rows = po.stratum_populations(self.population, everybody)
        weighted = self.weigh(rows.withColumnRenamed("stratum", "population"))
        return self.stages.save(weighted, "populations")

    @cached_property
    def arm_weights(self) -> DataFrame:
        """Arms with the weights before and after, as balance needs them."""
        return self.weigh(self.members.withColumn("weight", F.lit(1.0))).select(
            "person_id", "group", "one", "weight"
        )

    @cached_property
    def discrete(self) -> DataFrame:
        return fe.discrete_covariates(self.cdm, self.individuals, self.config)

    @cached_property
    def frequent(self) -> DataFrame:
        return fe.drop_rare(self.discrete, self.individuals, self.config.rare_share)

    @cached_property
    def staged_covariates(self) -> DataFrame:
        """All covariates with their kind, rare flags included."""
        rows = fe.all_covariates(self.cdm, self.individuals, self.config)
        return self.stages.save(rows, "covariates", ["kind"])

    def kind(self, name: str) -> DataFrame:
        return self.staged_covariates.where(F.col("kind") == name).drop("kind")

    @cached_property
    def staged_flags(self) -> DataFrame:
        flags = fe.drop_rare(self.kind("discrete"), self.individuals, self.config.rare_share)
        return self.stages.save(flags, "frequent")

    @cached_property
    def continuous(self) -> DataFrame:
        return self.kind("continuous")

    @cached_property
    def factors(self) -> DataFrame:
        return self.kind("factor")

    @cached_property
    def balance(self) -> DataFrame:
        return bal.balance_table(
            self.staged_flags, self.continuous, self.factors, self.arm_weights, STAND_IN
        )

    @cached_property
    def nco(self) -> DataFrame:
        return self.orders.nco_list()

    @cached_property
    def controls(self) -> DataFrame:
        return te.first_controls(self.cdm, self.nco, self.population, self.config.salts)

    @cached_property
    def event_rows(self) -> DataFrame:
        """Study rows of everybody with an outcome, kept only if none breaks a rule."""
        rows, observed = ef.checked(te.event_rows(self.populations, self.named))
        stored = self.stages.save(rows, "event_rows")
        ef.stop_on_violations(observed)
        return stored

    @cached_property
    def estimates(self) -> DataFrame:
        fitted = su.estimate(self.sums, GRID, ANALYSES, self.config.min_events)
        return self.stages.save(fitted, "estimates")

    @cached_property
    def sums(self) -> DataFrame:
        return te.study_sums(self.populations, self.event_rows, self.config, WEIGHTS, ["population"])

    @cached_property
    def control_sums(self) -> DataFrame:
        return te.control_sums(self.weighted, self.controls, self.nco, self.config, WEIGHTS)

    @cached_property
    def count_estimates(self) -> DataFrame:
        """Stand-in estimates from the sizes of the derived cohorts, with their censoring."""
        n = self.staged_derived.groupBy("cohort_definition_id").agg(F.count("*").alias("n"))
        return co.decode_cohort_id(n).select(
            "cohort_definition_id",
            "censoring",
            F.log((F.col("n") + 1) / 100.0).alias("log_rr"),
            (1 / F.sqrt(F.col("n") + 1)).alias("se"),
        )

    @cached_property
    def flag_names(self) -> list[str]:
        return mx.covariate_names(self.staged_flags)

    @cached_property
    def flag_vectors(self) -> DataFrame:
        vectors = mx.flag_vectors(self.members, self.staged_flags, self.flag_names)
        return self.stages.save(vectors, "flag_vectors")

    @cached_property
    def path(self) -> DataFrame:
        return ps.lasso_path(self.flag_vectors, self.staged_flags, self.members, self.config)

    @cached_property
    def selected(self) -> DataFrame:
        penalty = ps.one_se_lambda(self.path)
        return ps.lasso_selected(self.flag_vectors, self.flag_names, penalty)

    def design(self, flags: list[str]) -> DataFrame:
        reference = fe.reference_levels(self.factors).select("covariate")
        levels = self.factors.join(reference, "covariate", "left_anti")
        rows = (
            self.staged_flags.withColumn("kind", F.lit("discrete"))
            .unionByName(self.continuous.withColumn("kind", F.lit("continuous")))
            .unionByName(levels.withColumn("kind", F.lit("factor")))
        )
        return mx.design_vectors(self.members, rows, flags, mx.covariate_names(levels))

    @cached_property
    def scores(self) -> DataFrame:
        flags = [r.covariate for r in self.selected.collect()]
        design = self.stages.save(self.design(flags), "design")
        return ps.propensity_scores(design, self.config)


@lru_cache(maxsize=4)
def study(spark: SparkSession, sf_dir: str) -> Study:
    return Study(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    """Register a query under the name of its function."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(study(spark, sf_dir))
    return build


# --- sources and sinks -------------------------------------------------------


@query
def scan_person(s: Study) -> DataFrame:
    return s.cdm["person"]


@query
def scan_cohort(s: Study) -> DataFrame:
    return s.cohort.withColumnRenamed("subject_id", "person_id").drop("cohort_end_date")


@query
def scan_fact(s: Study, _scan=scan_fact) -> DataFrame:
    columns = ["person_id", "condition_concept_id", "condition_start_date"]
    return _scan(s.cdm["condition_occurrence"], columns, s.members)


@query
def nco_list(s: Study) -> DataFrame:
    path = s.stages.path("nco.csv")
    s.nco.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    listed = read_list(s.spark, path, "nco_list")
    facts = s.cdm["condition_occurrence"].groupBy("condition_concept_id").agg(
        F.count("*").alias("n_rows")
    )
    return listed.join(facts, F.col("ConceptId") == F.col("condition_concept_id"), "left").select(
        "OutcomeName", "ConceptId", "n_rows"
    )


@query
def code_filter(s: Study) -> DataFrame:
    return s.doses


@query
def stage_roundtrip(s: Study) -> DataFrame:
    return s.stages.save(fe.visit_counts(s.cdm, s.individuals, s.config.salts), "visits")


@query
def result_export(s: Study) -> DataFrame:
    path = s.stages.path("event_counts.csv")
    sinks.export_results(effect_grid_counts(s), path)
    schema = (
        "outcome string, risk_window int, n_vaccinated long, n_unvaccinated long, enough boolean, "
        "population string, censoring string, variant string"
    )
    return s.spark.read.option("header", True).schema(schema).csv(path)


@query
def cohort_append(s: Study) -> DataFrame:
    path = s.stages.path("cohort_table")
    sinks.replace_cohorts(s.cohort, path)
    for _ in range(2):  # the second time replaces the first
        sinks.replace_cohorts(s.staged_derived, path)
    # A rerun that finds nobody for a cohort takes its old members away.
    gone = s.cohort.limit(1).withColumn("cohort_definition_id", F.lit(9999))
    sinks.replace_cohorts(gone, path)
    sinks.replace_cohorts(gone.where("false"), path, ids=[9999])
    return sinks.read_cohorts(s.spark, path).groupBy("cohort_definition_id").agg(
        F.count("*").alias("n_rows"),
        F.min("cohort_start_date").alias("first_start"),
        F.max("cohort_end_date").alias("last_end"),
    )


@query
def cohort_remap(s: Study) -> DataFrame:
    main = sinks.remap_cohort_ids(s.cohort, REMAP_MAIN)
    return main.unionByName(sinks.remap_cohort_ids(s.cohort, REMAP_STRATA))


# --- outcome cohorts ---------------------------------------------------------


@query
def pairs_all(s: Study) -> DataFrame:
    return co.pair_counts(s.infections, s.outcomes)


@query
def pairs_horizon(s: Study) -> DataFrame:
    return co.within_horizon(s.infections, s.outcomes, s.config.horizon_days)


@query
def washout(s: Study) -> DataFrame:
    return co.flagged_pairs(s.infections, s.outcomes, None, s.config).select(*co.PAIR)


@query
def washout_literal(s: Study) -> DataFrame:
    pairs = co.flagged_pairs(s.infections, s.outcomes, None, s.config, washout_key="row")
    return pairs.select(*co.PAIR)


@query
def window_classify(s: Study) -> DataFrame:
    return co.classify(co.censored_pairs(s.pairs, "none"))


@query
def cohort_ids(s: Study) -> DataFrame:
    sizes = s.derived.groupBy("cohort_definition_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct("subject_id").alias("n_persons")
    )
    return co.decode_cohort_id(sizes)


@query
def cohort_end(s: Study) -> DataFrame:
    return co.outcome_cohorts(s.pairs, ("none",))


@query
def cohort_end_in_window(s: Study) -> DataFrame:
    return co.outcome_cohorts(s.pairs, end_in_window=True)


@query
def censor_none(s: Study) -> DataFrame:
    return co.censored_pairs(s.pairs, "none")


@query
def censor_covid(s: Study) -> DataFrame:
    return co.censored_pairs(s.pairs, "covid")


@query
def censor_vaccine(s: Study) -> DataFrame:
    return co.censored_pairs(s.pairs, "vaccine")


@query
def censor_both(s: Study) -> DataFrame:
    return co.censored_pairs(s.pairs, "both")


@query
def cohort_union(s: Study) -> DataFrame:
    first, *others = [co.outcome_cohorts(s.pairs, (c,)) for c in co.CENSORINGS]
    for rows in others:
        first = first.unionByName(rows)
    return co.decode_cohort_id(first).groupBy("censoring", "outcome_id", "risk_window").agg(
        F.count("*").alias("n_rows")
    )


@query
def outcome_cohorts(s: Study) -> DataFrame:
    return co.build_outcome_cohorts(s.cohort, s.config)


@query
def composite_outcome(s: Study) -> DataFrame:
    return s.named


@query
def join_full(s: Study) -> DataFrame:
    dose = s.doses.groupBy("person_id").agg(F.min("vaccine_date").alias("first_dose"))
    infection = s.infections.groupBy("person_id").agg(F.min("covid_date").alias("first_infection"))
    return dose.join(infection, "person_id", "full")


# --- population --------------------------------------------------------------


@query
def arm_members(s: Study) -> DataFrame:
    return s.members


@query
def next_dose_vaccinated(s: Study) -> DataFrame:
    return po.next_dose(s.members.where(F.col("group") == VACCINATED), s.doses)


@query
def next_dose_unvaccinated(s: Study) -> DataFrame:
    return po.next_dose(s.members.where(F.col("group") == UNVACCINATED), s.doses)


@query
def population(s: Study) -> DataFrame:
    return s.population


@query
def arm_sizes(s: Study) -> DataFrame:
    return po.arm_sizes(s.members)


@query
def index_date_distribution(s: Study) -> DataFrame:
    return po.index_date_distribution(s.stratum_arms).select(
        "stratum", "index_date", "n", r6("share"), r6("lower"), r6("upper")
    )


@query
def assign_index_date(s: Study) -> DataFrame:
    return s.stratum_members


@query
def stratum_population(s: Study) -> DataFrame:
    return s.populations.select(
        "population", "person_id", "index_date", "group", "next_vaccine", "leave_date",
        "death_date", "gender", "age", r6("weight"),
    )


# --- features ----------------------------------------------------------------


@query
def feat_drug(s: Study) -> DataFrame:
    return fe.drug_flags(s.cdm, s.individuals, s.config.salts)


@query
def feat_condition(s: Study) -> DataFrame:
    return fe.condition_flags(s.cdm, s.individuals, s.config.salts)


@query
def feat_visit(s: Study) -> DataFrame:
    return fe.visit_counts(s.cdm, s.individuals, s.config.salts)


@query
def feat_test(s: Study) -> DataFrame:
    return fe.test_counts(s.cdm, s.individuals, s.config.salts)


@query
def feat_alltime(s: Study) -> DataFrame:
    return fe.alltime_counts(
        fe.condition_facts(s.cdm), s.cdm["concept"], s.individuals, fe.CONDITION, s.config.salts
    )


@query
def factor_age_group(s: Study) -> DataFrame:
    return fe.age_group_factor(s.cdm, s.individuals, s.config)


@query
def factor_gender(s: Study) -> DataFrame:
    return fe.gender_factor(s.cdm, s.individuals)


@query
def factor_location(s: Study) -> DataFrame:
    return fe.location_factor(s.cdm, s.individuals, s.config)


@query
def care_site_code(s: Study) -> DataFrame:
    return fe.care_site_codes(fe.person_location(s.cdm, s.individuals, s.config))


@query
def feat_age(s: Study) -> DataFrame:
    return fe.age_covariate(s.cdm, s.individuals, s.config)


@query
def feat_obs_years(s: Study) -> DataFrame:
    years = fe.observation_years(s.cdm, s.individuals, s.config.salts)
    return years.select("person_id", "covariate", r6("value"))


@query
def covariate_dictionary(s: Study) -> DataFrame:
    rows = fe.covariate_dictionary(s.cdm, s.individuals)
    return rows.withColumn("covariate_id", F.col("covariate_id").cast("string"))


@query
def covariate_names(s: Study) -> DataFrame:
    return s.discrete.groupBy("covariate").agg(F.count("*").alias("n"))


@query
def covariates_long(s: Study) -> DataFrame:
    rows = fe.all_covariates(s.cdm, s.individuals, s.config)
    return rows.select("person_id", "covariate", r6("value"), "kind")


@query
def rare_filter(s: Study) -> DataFrame:
    return s.frequent.select("person_id", "covariate", "value")


@query
def rare_summary(s: Study) -> DataFrame:
    return fe.rare_summary(s.discrete, s.individuals, s.config.rare_share)


@query
def select_covariates(s: Study) -> DataFrame:
    names = fe.covariate_frequencies(s.discrete, s.individuals, 0.05).where("frequent")
    return fe.select_covariates(s.discrete, names).select("person_id", "covariate", "value")


@query
def restrict_population(s: Study) -> DataFrame:
    flags = fe.condition_flags(s.cdm, s.individuals, s.config.salts)
    return fe.restrict_to(flags, s.stratum_arms)


@query
def reference_levels(s: Study) -> DataFrame:
    return fe.reference_levels(s.factors)


@query
def pivot_small(s: Study) -> DataFrame:
    listed = s.nco.select(underscored(F.col("OutcomeName")).alias("name")).distinct()
    names = sorted(r.name for r in listed.collect())  # the names of the list, whatever they are
    return s.controls.groupBy("person_id").pivot("outcome", names).agg(F.min("event_date"))


@query
def design_matrix_stats(s: Study) -> DataFrame:
    values = vector_to_array("features")
    nonzero = F.filter(values, lambda x: x != 0)
    return s.design(s.flag_names).select(
        "person_id",
        "group",
        F.size(nonzero).alias("n_nonzero"),
        F.round(F.aggregate(nonzero, F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
    )


# --- propensity and balance --------------------------------------------------


@query
def lasso_path(s: Study) -> DataFrame:
    return s.path


@query
def lasso_selected(s: Study) -> DataFrame:
    return s.selected


@query
def lasso_at_penalty(s: Study) -> DataFrame:
    """Flags left at a small penalty, whatever the cross-validation prefers."""
    return ps.lasso_selected(s.flag_vectors, s.flag_names, 0.01, s.config.lasso_tol)


CERTIFIED_PENALTY = 0.01


@query
def lasso_optimality(s: Study) -> DataFrame:
    """Flags, and how many of them (and of the intercept) break the optimality condition of the fitted penalty."""
    coefficients, intercept = ps.lasso_model(s.flag_vectors, s.flag_names, CERTIFIED_PENALTY, 1e-9)
    rows = ps.lasso_optimality(s.staged_flags, s.members, coefficients, intercept, CERTIFIED_PENALTY)
    return rows.agg(
        F.count("covariate").alias("n_flags"),
        (F.count(F.when(F.col("covariate").isNotNull() & (F.col("coefficient") != 0), 1)) > 0).alias("selects"),
        F.sum(F.col("violated").cast("long")).alias("n_violated"),
    )


@query
def ps_report(s: Study) -> DataFrame:
    """Flags and levels of one arm alone."""
    held = s.staged_flags.withColumn("kind", F.lit("discrete")).unionByName(s.factors.withColumn("kind", F.lit("factor")), allowMissingColumns=True)
    return ps.separation(held, s.members)


@query
def ps_score_report(s: Study) -> DataFrame:
    """Scores at their edges; a tenth of the persons each has a score of 0, 1 and none."""
    place = F.col("person_id") % 10
    score = F.when(place == 0, 0.0).when(place == 1, 1.0).when(place == 2, F.lit(None).cast("double")).otherwise(stand_in_score())
    return ps.score_report(s.members.withColumn("ps", score))


@query
def ps_sample(s: Study) -> DataFrame:
    return ps.sample_persons(s.individuals, SAMPLE_SIZE, s.config.seed)


@query
def ps_scores(s: Study) -> DataFrame:
    return s.scores


@query
def ps_balance(s: Study) -> DataFrame:
    """Balance before and after weighting by the fitted scores."""
    persons = bal.overlap_weights(s.scores).withColumn("one", F.lit(1.0))
    table = bal.balance_table(s.staged_flags, s.continuous, s.factors, persons, STAND_IN)
    return bal.before_after(table)


@query
def overlap_weights(s: Study) -> DataFrame:
    scored = bal.overlap_weights(s.members.withColumn("ps", stand_in_score()))
    return scored.select("person_id", "group", r6("ps"), r6("weight"))


@query
def drop_zero_weight(s: Study) -> DataFrame:
    # a tenth of the persons gets a score of zero, so that there is something to drop
    score = F.when(F.col("person_id") % 10 == 0, 0.0).when(F.col("person_id") % 10 == 1, 0.0)
    scored = s.members.withColumn("ps", score.otherwise(stand_in_score()))
    kept = bal.drop_zero_weight(bal.overlap_weights(scored))
    return kept.select("person_id", "group", r6("weight"))


def _moments(df: DataFrame) -> DataFrame:
    return df.select(
        "covariate", "weighting", *[r6(c) for c in ("mean1", "var1", "mean2", "var2", "smd")]
    )


def _flags_and_levels(s: Study) -> DataFrame:
    columns = ["person_id", "covariate", "value"]
    return s.staged_flags.select(*columns).unionByName(s.factors.select(*columns))


@query
def smd_discrete(s: Study) -> DataFrame:
    return _moments(bal.smd_discrete(_flags_and_levels(s), s.arm_weights, {"before": "one"}))


@query
def smd_discrete_weighted(s: Study) -> DataFrame:
    return _moments(bal.smd_discrete(_flags_and_levels(s), s.arm_weights, {"after": "weight"}))


@query
def smd_continuous(s: Study) -> DataFrame:
    return _moments(bal.smd_continuous(s.continuous, s.arm_weights, STAND_IN))


@query
def smd_factor_shares(s: Study) -> DataFrame:
    shares = bal.factor_shares(s.factors, s.arm_weights, STAND_IN)
    return shares.select("variable", "covariate", "weighting", r6("p1"), r6("p2"))


@query
def smd_factor(s: Study) -> DataFrame:
    shares = bal.factor_shares(s.factors, s.arm_weights, STAND_IN)
    return bal.smd_factor(shares).select("variable", "weighting", r6("smd"))


@query
def balance_before_after(s: Study) -> DataFrame:
    both = bal.before_after(s.balance)
    return both.select("covariate", r6("smd_before"), r6("smd_after"))


@query
def balance_share(s: Study) -> DataFrame:
    shares = bal.balanced_share(s.balance)
    return shares.select("weighting", "n_covariates", "n_balanced", r6("share_balanced"))


@query
def ps_histogram(s: Study) -> DataFrame:
    return bal.score_histogram(s.members.withColumn("ps", stand_in_score()))


# --- study tables and effects ------------------------------------------------

GRID = ["population"] + te.CELL


@query
def follow_up(s: Study) -> DataFrame:
    return te.follow_up(s.population).select("person_id", "group", "limited", "time", "event")


def _rows(df: DataFrame) -> DataFrame:
    return df.where("time >= 1").select(
        *te.CELL, "person_id", "group", "covid_date", "outcome_date", "time", "event", r6("weight")
    )


@query
def study_table(s: Study) -> DataFrame:
    return _rows(te.event_rows(s.weighted, s.named))


@query
def study_table_full(s: Study) -> DataFrame:
    return _rows(te.event_rows(s.weighted, s.named).where("variant = 'full'"))


def _totals(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and days of the full study tables by arm and event."""
    codes = {"e": 1, "d": 2, "c": 0}
    arms = {"v": VACCINATED, "u": UNVACCINATED}
    parts = F.array(
        *[
            F.struct(
                F.lit(analysis).alias("analysis"),
                F.lit(arm).alias("group"),
                F.lit(code).alias("event"),
                F.col(f"n_{c}{a}").alias("n"),
                F.col(f"{prefix}_{c}{a}").cast("double").alias("w"),
            )
            for c, code in codes.items()
            for a, arm in arms.items()
            for analysis, prefix in ANALYSES.items()
        ]
    )
    rows = sums.select(*keys, "time", F.explode(parts).alias("p")).where("p.n > 0")
    return rows.groupBy(*keys, "p.analysis", "p.group", "p.event").agg(
        F.sum("p.n").alias("n_rows"),
        F.sum(F.col("p.n") * F.col("time")).alias("person_days"),
        off_tie("weight", F.sum("p.w")),
    )


@query
def study_table_totals(s: Study) -> DataFrame:
    return _totals(s.sums, GRID)


@query
def study_table_first(s: Study) -> DataFrame:
    """One row per person and analysis: the first infection alone counts."""
    return _rows(te.event_rows(s.weighted, s.named, first_event_only=True))


@query
def dropped_rows(s: Study) -> DataFrame:
    return te.dropped_rows(te.event_rows(s.populations, s.named), GRID, s.config)


@query
def censor_violations(s: Study) -> DataFrame:
    return te.censor_violations(te.event_rows(s.population, s.named))


@query
def event_counts(s: Study) -> DataFrame:
    return te.event_counts(te.event_rows(s.population, s.named), te.CELL, s.config)


@query
def effect_grid_counts(s: Study) -> DataFrame:
    return te.event_counts(s.event_rows, GRID, s.config)


def _risk(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys, "time", "n_events", *[off_tie(c) for c in ("ev", "eu", "risk_v", "risk_u")]
    )


@query
def fg_riskset(s: Study) -> DataFrame:
    return _risk(su.risk_sets(s.sums, GRID, ANALYSES), [*GRID, "analysis"])


@query
def fg_riskset_counted(s: Study) -> DataFrame:
    """The same for negative controls, with censoring estimated from counts."""
    risk = su.risk_sets(s.control_sums, ["outcome"], ANALYSES, weighted_censoring=False)
    return _risk(risk, ["outcome", "analysis"])


FITTED = ("log_hr", "se", "hr", "hr_inverse", "low95", "upper95")


def _fitted(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c) if c in FITTED else F.col(c) for c in df.columns])


@query
def fg_estimates(s: Study) -> DataFrame:
    return _fitted(s.estimates)


@query
def fg_robust(s: Study) -> DataFrame:
    """Intervals from the sandwich variance, a person's rows taken together."""
    squared = (F.col("weight") * F.col("weight")).alias("weight2")
    people, rows = s.populations.select("*", squared), s.event_rows.select("*", squared)
    sums = te.study_sums(people, rows, s.config, ["weight", "weight2"], ["population"])
    days = su.risk_days(sums, GRID, ANALYSES, squares={"crude": "n", "adjusted": "weight2"})
    scores = s.stages.save(su.score_table(days, [*GRID, "analysis"], s.config.min_events), "scores")
    found = su.robust_effects(scores, rows, GRID, {"crude": None, "adjusted": "weight"})
    return found.select(*GRID, "analysis", "n_events", *[r6(c) for c in ("log_hr", "se", "robust_se", "robust_low95", "robust_upper95")])


@query
def effect_report(s: Study) -> DataFrame:
    """The whole grid of results: 3 populations x 2 analyses x 6 censoring variants x 44 outcomes and windows."""
    path = s.stages.path("cohort_index.csv")
    s.orders.cohort_index().write.mode("overwrite").option("header", True).csv(path)
    index = read_list(s.spark, path, "cohort_index")
    keys = ef.report_keys(index, ["any", *STRATUM_IDS], list(ANALYSES))
    report = ef.effect_report(keys, te.event_counts(s.event_rows, GRID, s.config), s.estimates)
    return report.select(*[r6(c) if c in ("HR", "HRinvers", "low95", "upper95", "SE") else F.col(c) for c in report.columns])


@query
def nco_first(s: Study) -> DataFrame:
    return s.controls


@query
def nco_study_table(s: Study) -> DataFrame:
    return _totals(s.control_sums, ["outcome"])


@query
def fg_nco(s: Study) -> DataFrame:
    return _fitted(su.estimate(s.control_sums, ["outcome"], ANALYSES))


@query
def error_model(s: Study) -> DataFrame:
    model = cal.fit_error_model(s.count_estimates, ["censoring"])
    return model.select("censoring", F.round("mu", 4).alias("mu"), F.round("sigma", 4).alias("sigma"),
                        "n_controls")


@query
def calibrate_ci(s: Study) -> DataFrame:
    fixed = cal.calibrate(s.count_estimates, mu=0.1, sigma=0.15)
    return fixed.select(
        "cohort_definition_id",
        *[r6(c) for c in fixed.columns if c.startswith("cal_")],
    )


@query
def ci_coverage(s: Study) -> DataFrame:
    truth = s.count_estimates.withColumn(
        "true_log_rr", F.when(F.col("censoring") == "none", 0.0).otherwise(F.log(F.lit(2.0)))
    )
    shares = cal.ci_coverage(truth)
    return shares.select(
        r6("true_rr"), "n_estimates", r6("share_significant"), r6("share_covered")
    )


@query
def calibrated_nco(s: Study) -> DataFrame:
    """Negative controls calibrated by the error model of their own estimates."""
    estimates = su.estimate(s.control_sums, ["outcome"], ANALYSES).select(
        "outcome", "analysis", F.col("log_hr").alias("log_rr"), "se"
    )
    staged = s.stages.save(estimates, "nco_estimates")
    calibrated = cal.calibrate(staged, cal.fit_error_model(staged, ["analysis"]), ["analysis"])
    return calibrated.select("outcome", "analysis", r6("log_rr"), r6("se"),
                             *[F.round(c, 4).alias(c) for c in calibrated.columns if c.startswith("cal_")])


@query
def uniform_draw(s: Study) -> DataFrame:
    return s.individuals.select(
        "person_id", F.round(uniform("person_id", s.config.seed), 9).alias("u")
    )
