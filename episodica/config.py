"""Study parameters. Everything an analyst may change lives here."""

from __future__ import annotations

from dataclasses import dataclass, field

VACCINATED = "vaccinated"
UNVACCINATED = "unvaccinated"

# Cohort ids and outcome names of the study.
DOSE_IDS = (2, 3)
INFECTION_ID = 4
OUTCOME_NAMES = {
    5: "VTE", 6: "DVT", 7: "PE", 8: "HS", 9: "IS",
    10: "TIA", 11: "MI", 12: "MP", 13: "VACA", 14: "HF",
}
ANY_TEST_ID = 175
PCR_TEST_ID = 176
UNVACCINATED_ID = 177
VACCINATED_ID = 178
STRATUM_IDS = {"AZ": 185, "PF": 186}
FEMALE_CONCEPT_ID = 8532

# Risk windows after infection, in days, both ends included.
RISK_WINDOWS = ((1, 0, 30), (2, 31, 90), (3, 91, 180), (4, 181, 365))

# Censoring rules; the position is the code used in cohort ids.
CENSORINGS = ("none", "covid", "vaccine", "both")

# Outcomes made of other outcomes. VTE replaces its own cohort.
COMPOSITES = {"VTE": ("DVT", "PE"), "ATE": ("IS", "TIA", "MI")}

# Event codes of a competing-risk study table.
CENSORED, EVENT, DEATH = 0, 1, 2

# Id maps used when cohorts of another table are taken over.
REMAP_MAIN = {1: 177, 2: 178, 3: 179, 4: 180, 5: 181, 6: 182, 7: 183, 8: 184}
REMAP_STRATA = {9: 185, 10: 186, 13: 187, 14: 188, 17: 189, 18: 190, 21: 191, 22: 192}


@dataclass(frozen=True)
class StudyConfig:
    washout_days: int = 180
    horizon_days: int = 365
    age_date: str = "2022-01-01"
    age_year: int = 2021
    rare_share: float = 0.005
    min_time: int = 1
    min_events: int = 5
    ps_sample_size: int = 200_000
    folds: int = 5
    lambda_exponents: tuple[float, float, float] = (2.0, -3.0, -0.1)
    lasso_tol: float = 1e-4
    ridge: float = 0.0
    seed: int = 20221128
    # care-site locations folded into another one, with the label of the result
    location_merge: dict[int, int] = field(default_factory=lambda: {10: 8})
    location_labels: dict[int, str] = field(
        default_factory=lambda: {8: "South East-Central"}
    )
    excluded_regions: tuple[str, ...] = ("Northern Ireland",)
    # a person's rows are split over this many tasks in fact joins
    salts: int = 8

    def lambdas(self) -> list[float]:
        start, stop, step = self.lambda_exponents
        n = round((stop - start) / step) + 1
        return [10 ** (start + step * i) for i in range(n)]
