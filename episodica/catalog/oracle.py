"""The registered queries in plain SQL for DuckDB, written apart from the Spark code.

``VIEWS`` holds named sub-queries; an oracle gets those it mentions, and those they
mention, in front of it.
"""

from __future__ import annotations

import re
from statistics import NormalDist

from episodica.sources.fixtures import FIXTURE_CONFIG

SEED = FIXTURE_CONFIG.seed
Z = repr(NormalDist().inv_cdf(0.975))

VIEWS: dict[str, str] = {}
ORACLES: dict[str, str] = {}

# --- study tables over the driver's tables ------------------------------------

VIEWS["person"] = """
select c_custkey person_id, case when c_custkey%3=0 then 8507 else 8532 end gender_concept_id,
       1903+cast(c_custkey%50 as int) year_of_birth, c_nationkey care_site_id from customer"""
VIEWS["care_site"] = "select n_nationkey care_site_id, n_regionkey location_id from nation"
VIEWS["location"] = "select r_regionkey location_id, r_name location_source_value from region"
VIEWS["observation_period"] = """
select o_custkey person_id, cast(min(o_orderdate) as date) observation_period_start_date,
       cast(max(o_orderdate) as date) observation_period_end_date from orders group by o_custkey"""
VIEWS["death"] = """
select o_custkey person_id, cast(max(o_orderdate) - interval '100' day as date) death_date
from orders where o_custkey%7=0 group by o_custkey"""
VIEWS["condition_occurrence"] = """
select o_custkey person_id, l_partkey%100 condition_concept_id,
       cast(l_shipdate as date) condition_start_date
from lineitem join orders on l_orderkey=o_orderkey"""
VIEWS["drug_era"] = """
select o_custkey person_id, 1000+o_orderkey%40 drug_concept_id,
       cast(o_orderdate as date) drug_era_start_date,
       cast(o_orderdate + interval '30' day as date) drug_era_end_date from orders"""
VIEWS["visit_occurrence"] = """
select o_custkey person_id, cast(l_shipdate as date) visit_start_date
from lineitem join orders on l_orderkey=o_orderkey"""
VIEWS["concept"] = """
select distinct p_partkey%100 concept_id,
       concat('Condition ', cast(p_partkey%100%90 as string)) concept_name from part
union all select distinct 1000+o_orderkey%40, concat('Drug ', cast(o_orderkey%40 as string)) from orders"""
VIEWS["vaccine"] = """
select distinct case when o_orderpriority<'3' then 2 else 3 end cohort_definition_id,
       o_custkey subject_id, cast(o_orderdate as date) cohort_start_date
from orders where o_orderstatus='P'"""
VIEWS["first_vaccine"] = """
select subject_id, min(cohort_start_date) d,
       min(concat(cast(cohort_start_date as string),'#',cast(cohort_definition_id as string))) k
from vaccine group by subject_id"""
VIEWS["cohort"] = """
select distinct cast(i as int) cohort_definition_id, p subject_id, d cohort_start_date, d cohort_end_date
from (
  select 4 i, o_custkey p, cast(o_orderdate as date) d from orders where o_orderstatus='F'
  union all select cohort_definition_id, subject_id, cohort_start_date from vaccine
  union all select 5+cast(l_suppkey%10 as int), o_custkey, cast(l_shipdate as date)
            from lineitem join orders on l_orderkey=o_orderkey
  union all select 175, o_custkey, cast(o_orderdate as date) from orders where o_orderstatus='O'
  union all select 176, o_custkey, cast(o_orderdate as date) from orders
            where o_orderstatus='O' and o_orderpriority='1-URGENT'
  union all select 177, c_custkey, date '1996-07-01' from customer where c_custkey%2=1
            and c_custkey not in (select subject_id from vaccine where cohort_start_date <= date '1996-07-01')
  union all select 178, subject_id, d from first_vaccine where subject_id%2=0
  union all select case when k like '%#2' then 185 else 186 end, subject_id, d
            from first_vaccine where subject_id%2=0
)"""
VIEWS["nco"] = """
select concat('Control ', cast(concept_id % 5 as string)) outcome_name, concept_id
from concept where concept_id < 10"""

# --- outcome cohorts -----------------------------------------------------------

VIEWS["inf"] = """
select distinct subject_id person_id, cohort_start_date covid_date from cohort
where cohort_definition_id = 4"""
VIEWS["dose"] = """
select distinct subject_id person_id, cohort_start_date vaccine_date from cohort
where cohort_definition_id in (2, 3)"""
VIEWS["outc"] = """
select distinct subject_id person_id, cohort_definition_id outcome_id, cohort_start_date outcome_date
from cohort where cohort_definition_id between 5 and 14"""
VIEWS["pairs_h"] = """
select person_id, outcome_id, covid_date, outcome_date from inf join outc using (person_id)
where outcome_date > covid_date and outcome_date <= covid_date + 365"""
VIEWS["excluded"] = """
select distinct person_id, outcome_id, covid_date from inf join outc using (person_id)
where covid_date > outcome_date and covid_date < outcome_date + 180"""
VIEWS["washed"] = "select * from pairs_h anti join excluded using (person_id, outcome_id, covid_date)"
VIEWS["nearest"] = """
select person_id, outcome_id, max(covid_date) covid_date, outcome_date from washed
group by person_id, outcome_id, outcome_date"""
VIEWS["dosed"] = """
select distinct person_id, outcome_id, covid_date, outcome_date from washed join dose using (person_id)
where covid_date < vaccine_date and vaccine_date < outcome_date"""
VIEWS["undosed"] = """
select * from washed anti join dosed using (person_id, outcome_id, covid_date, outcome_date)"""
VIEWS["kept"] = """
select 0 code, * from washed
union all select 1, person_id, outcome_id, covid_date, outcome_date from nearest
union all select 2, * from undosed
union all select 3, person_id, outcome_id, covid_date, outcome_date from nearest
          semi join undosed using (person_id, outcome_id, covid_date, outcome_date)"""
VIEWS["kept_window"] = """
select *, case when outcome_date - covid_date between 0 and 30 then 1
               when outcome_date - covid_date between 31 and 90 then 2
               when outcome_date - covid_date between 91 and 180 then 3
               when outcome_date - covid_date between 181 and 365 then 4 end risk_window
from kept"""
VIEWS["derived"] = """
select cast(4*(outcome_id-4) - (4-w.risk_window) + 14 + 40*code as int) cohort_definition_id,
       person_id subject_id, covid_date cohort_start_date, e.outcome_date cohort_end_date,
       outcome_id, code, w.risk_window
from (select distinct code, person_id, outcome_id, covid_date, risk_window from kept_window) w
join (select code, person_id, outcome_id, covid_date, min(outcome_date) outcome_date from kept
      group by all) e using (code, person_id, outcome_id, covid_date)"""
VIEWS["censoring_names"] = """
select * from (values (0,'none'),(1,'covid'),(2,'vaccine'),(3,'both')) t(code, censoring)"""
VIEWS["members_of_outcome"] = """
select * from (values (6,'DVT'),(6,'VTE'),(7,'PE'),(7,'VTE'),(8,'HS'),(9,'IS'),(9,'ATE'),
 (10,'TIA'),(10,'ATE'),(11,'MI'),(11,'ATE'),(12,'MP'),(13,'VACA'),(14,'HF')) t(outcome_id, outcome)"""
VIEWS["named"] = """
select distinct subject_id person_id, outcome, censoring, risk_window,
       cohort_start_date covid_date, cohort_end_date outcome_date
from derived join members_of_outcome using (outcome_id) join censoring_names using (code)"""

# --- population ------------------------------------------------------------------

VIEWS["members"] = """
select distinct subject_id person_id, cohort_start_date index_date,
       case when cohort_definition_id = 178 then 'vaccinated' else 'unvaccinated' end grp
from cohort where cohort_definition_id in (177, 178)"""
VIEWS["dose_first"] = "select person_id, min(vaccine_date) first_dose from dose group by person_id"
VIEWS["dose_second"] = """
select person_id, min(vaccine_date) second_dose from dose join dose_first using (person_id)
where vaccine_date > first_dose group by person_id"""
VIEWS["members_next"] = """
select m.*, case when grp = 'vaccinated' then second_dose else first_dose end next_vaccine
from members m left join dose_first using (person_id) left join dose_second using (person_id)"""
VIEWS["pop"] = """
select person_id, index_date, grp, next_vaccine, observation_period_end_date leave_date, death_date,
       case when gender_concept_id = 8532 then 'Female' when gender_concept_id is not null then 'Male' end gender,
       2021 - year_of_birth age, 1.0::double weight
from members_next left join observation_period using (person_id) left join death using (person_id)
left join person using (person_id)"""
VIEWS["strata"] = "select * from (values ('AZ', 185), ('PF', 186)) t(stratum, vaccinated_id)"
VIEWS["date_shares"] = """
select stratum, index_date, n, sum(n) over (partition by stratum order by index_date) - n below,
       sum(n) over (partition by stratum) total
from (select stratum, cohort_start_date index_date, count(*) n from cohort join strata
      on cohort_definition_id = vaccinated_id group by all)"""
VIEWS["drawn"] = f"""
select stratum, person_id, index_date, 'unvaccinated' grp
from (select stratum, subject_id person_id,
             cast('0x' || substr(md5(cast(subject_id as varchar) || '#{SEED}#index:' || stratum), 1, 13) as bigint) / 4503599627370496.0 u
      from (select distinct subject_id from cohort where cohort_definition_id = 177), strata) p
join date_shares using (stratum)
where u >= below / total and u < (below + n) / total"""
VIEWS["stratum_members"] = """
select stratum, subject_id person_id, cohort_start_date index_date, 'vaccinated' grp
from cohort join strata on cohort_definition_id = vaccinated_id
union all select * from drawn"""
VIEWS["scores"] = """
select person_id, 0.05::double + 0.9::double * ((person_id*37) % 101) / 101.0::double ps from person"""
VIEWS["pops"] = """
select population, p.* replace (case when grp = 'vaccinated' then 1 - ps else ps end as weight)
from (select 'any' population, * from pop
      union all
      select stratum, pop.person_id, s.index_date, pop.grp, next_vaccine, leave_date, death_date, gender, age, weight
      from stratum_members s join pop using (person_id)) p
join scores using (person_id)"""

# --- covariates --------------------------------------------------------------------

VIEWS["drug_rows"] = """
select person_id, drug_concept_id concept_id, index_date - drug_era_start_date gap
from drug_era join members using (person_id)"""
VIEWS["condition_rows"] = """
select person_id, condition_concept_id concept_id, index_date - condition_start_date gap
from condition_occurrence join members using (person_id)"""
VIEWS["feat_drug"] = """
select distinct person_id, replace('drug_era_' || coalesce(concept_name, 'NA') || '_' ||
       case when gap <= 30 then '1to30' else '31to180' end, ' ', '_') covariate, 1.0::double "value"
from drug_rows left join concept using (concept_id) where gap > 0 and gap <= 180"""
VIEWS["feat_condition"] = """
select distinct person_id, replace('condition_ocurrence_' || coalesce(concept_name, 'NA') || '_' ||
       case when gap <= 30 then '1to30' when gap <= 180 then '31to180' else '+181' end, ' ', '_') covariate,
       1.0::double "value"
from condition_rows left join concept using (concept_id) where gap > 0"""
VIEWS["feat_visit"] = """
select person_id, covariate, count(*)::double "value" from (
  select distinct person_id, visit_start_date, 'visit_ocurrence_Visit_to_GP_' ||
         case when index_date - visit_start_date <= 30 then '1to30'
              when index_date - visit_start_date <= 180 then '31to180' else '+181' end covariate
  from visit_occurrence join members using (person_id) where visit_start_date < index_date)
group by all"""
VIEWS["feat_test"] = """
select person_id, 'covid19_and_testing_' || name || '_' ||
       case when index_date - cohort_start_date <= 30 then '1to30'
            when index_date - cohort_start_date <= 180 then '31to180' else '+181' end covariate,
       count(*)::double "value"
from cohort join members on subject_id = person_id
join (values (175, 'Any_covid19_test'), (176, 'PCR_covid19_test'), (4, 'Diag+_covid19')) t(id, name)
  on id = cohort_definition_id
where cohort_start_date < index_date group by all"""
VIEWS["aged"] = """
select person_id, floor((date '2022-01-01' - make_date(year_of_birth, 1, 1)) / 365.25) age
from (select distinct person_id from members) left join person using (person_id)"""
VIEWS["factor_age_group"] = """
select person_id, 'age_group_' || case when age between 75 and 120 then
       least(75 + 5 * cast(floor((age - 75) / 5) as int), 115) || '_to_' ||
       (least(75 + 5 * cast(floor((age - 75) / 5) as int), 115) + 4) || '_years' else 'NA' end covariate,
       1.0::double "value" from aged"""
VIEWS["factor_gender"] = """
select distinct person_id, case when gender_concept_id = 8532 then 'gender_Female' else 'gender_Male' end covariate,
       1.0::double "value"
from members join person using (person_id) where gender_concept_id is not null"""
VIEWS["located"] = """
select person_id, care_site_id, case when location_id = 4 then 3 else location_id end location_id
from (select distinct person_id from members) left join person using (person_id)
left join care_site using (care_site_id)"""
VIEWS["factor_location"] = """
select * from (
  select distinct person_id, 'care_site_id_=_' || coalesce(cast(care_site_id as varchar), 'NA') covariate,
         1.0::double "value" from located
  union all
  select distinct person_id, 'region_' || replace(case when location_id = 3 then 'EUROPE-CENTRAL'
         else coalesce(location_source_value, 'NA') end, ' ', '_'), 1.0::double
  from located left join location using (location_id))
where not contains(covariate, 'region_NA') and not contains(covariate, 'region_AFRICA')"""
VIEWS["feat_age"] = "select person_id, 'age' covariate, age::double \"value\" from aged"
VIEWS["feat_obs_years"] = """
select person_id, 'observation_years' covariate,
       (index_date - observation_period_start_date) / 365.25::double "value"
from members join observation_period using (person_id) where index_date > observation_period_start_date"""
VIEWS["discrete"] = "select * from feat_drug union all select * from feat_condition"
VIEWS["continuous"] = """
select * from feat_visit union all select * from feat_test union all select * from feat_age
union all select * from feat_obs_years"""
VIEWS["factors"] = """
select * from factor_age_group union all select * from factor_gender union all select * from factor_location"""
VIEWS["frequency"] = """
select covariate, count(*) n, (select cast(floor(count(*) * 0.005) as bigint) from members) threshold
from discrete group by covariate"""
VIEWS["frequent"] = """
select * from discrete where covariate in (select covariate from frequency where n > threshold)"""

# --- balance -------------------------------------------------------------------------

VIEWS["arms"] = """
select person_id, grp, weighting,
       case when weighting = 'before' then 1.0::double when grp = 'vaccinated' then 1 - ps else ps end w
from members join scores using (person_id), (values ('before'), ('after')) t(weighting)"""


def _moments(table: str, pooled: str) -> str:
    """Moments over a dense grid of persons and covariates, zeros filled in."""
    return f"""
with dense as (
  select a.weighting, a.grp, c.covariate, a.w, coalesce(v."value", 0) x
  from arms a cross join (select distinct covariate from {table}) c
  left join {table} v on v.person_id = a.person_id and v.covariate = c.covariate),
means as (
  select weighting, grp, covariate, sum(w) sw, sum(w * x) / sum(w) m from dense group by all),
spreads as (
  select weighting, grp, covariate, any_value(m) m,
         sum(w * (x - m) * (x - m)) / nullif(any_value(sw) - 1, 0) v
  from dense join means using (weighting, grp, covariate) group by all)
select a.covariate, a.weighting, a.m mean1, a.v var1, b.m mean2, b.v var2,
       abs(a.m - b.m) / nullif(sqrt((a.v + b.v){pooled}), 0) smd
from spreads a join spreads b using (weighting, covariate)
where a.grp = 'vaccinated' and b.grp = 'unvaccinated'"""


VIEWS["flags_levels"] = "select * from frequent union all select * from factors"
VIEWS["smd_flags"] = _moments("flags_levels", " / 2")
VIEWS["smd_numbers"] = _moments("continuous", "")
VIEWS["factor_rows"] = """
select person_id, covariate, case when covariate like 'age\\_group\\_%' escape '\\' then 'age_group'
       when contains(covariate, 'care_site') then 'care_site' else 'region' end variable
from factors where covariate not like 'gender%'"""
VIEWS["shares"] = """
select variable, covariate, weighting, p1 / sum(p1) over v p1, p2 / sum(p2) over v p2
from (select variable, covariate, weighting, sum(case when grp = 'vaccinated' then w else 0 end) p1,
             sum(case when grp = 'unvaccinated' then w else 0 end) p2
      from factor_rows join arms using (person_id) group by all)
window v as (partition by variable, weighting)"""
# Elimination of the covariance matrix level by level: the quadratic form is a sum over pivots.
VIEWS["smd_factors"] = """
select variable, weighting, sqrt(quad) smd from (
  with recursive lists as (
    select variable, weighting, list(p1 order by covariate) p, list(p2 order by covariate) q, count(*) - 1 n
    from shares where p1 + p2 > 0 group by all
  ), elim as (
    select variable, weighting, n, 1 j, 0.0::double quad, list_transform(range(2, n + 2), lambda r: list_transform(
      range(2, n + 3), lambda c: case when c = n + 2 then p[r] - q[r] else
        (case when r = c then p[r] + q[r] else 0 end - p[r] * p[c] - q[r] * q[c]) / 2 end)) m
    from lists
    union all
    select variable, weighting, n, j + 1, quad + m[j][n + 1] * m[j][n + 1] / m[j][j],
      list_transform(range(1, n + 1), lambda r: case when r <= j then m[r] else
        list_transform(range(1, n + 2), lambda c: m[r][c] - m[r][j] / m[j][j] * m[j][c]) end)
    from elim where j <= n
  ) select variable, weighting, quad from elim where j = n + 1)"""
VIEWS["balance"] = """
select covariate, weighting, smd from smd_flags union all select covariate, weighting, smd from smd_numbers
union all select variable, weighting, smd from smd_factors"""

# --- study tables ------------------------------------------------------------------------

VIEWS["cells"] = """
select censoring, variant, outcome, risk_window
from (values ('none','partial'),('none','full'),('covid','partial'),('covid','full'),
             ('vaccine',null),('both',null)) a(censoring, variant),
     (select distinct outcome from members_of_outcome) b, (values (1),(2),(3),(4)) c(risk_window)"""
# every person in every analysis, as one table per analysis would hold them
VIEWS["dense"] = """
select *, case when ends = death_date then 2 when ends = covid_date then 1 else 0 end event,
       ends - index_date time
from (
  select p.*, c.*, covid_date, outcome_date,
         least(death_date, leave_date, covid_date,
               case when grp = 'unvaccinated' or c.censoring in ('vaccine', 'both') then next_vaccine end) ends
  from pops p cross join cells c
  left join named o on o.person_id = p.person_id and o.outcome = c.outcome and o.risk_window = c.risk_window
   and o.censoring = case when grp = 'unvaccinated' and c.variant = 'full'
                          then case when c.censoring = 'none' then 'vaccine' else 'both' end
                          else c.censoring end)"""
VIEWS["dense_valid"] = "select * from dense where ends - index_date >= 1"
VIEWS["counts"] = """
select population, censoring, variant, outcome, risk_window,
       sum(case when event = 1 and grp = 'vaccinated' then 1 else 0 end) nv,
       sum(case when event = 1 and grp = 'unvaccinated' then 1 else 0 end) nu
from dense_valid where covid_date is not null group by all"""
VIEWS["counts_gated"] = """
select c.*, c.nv + c.nu >= 5 and (c.variant is distinct from 'full' or coalesce(p.nv + p.nu >= 5, false)) enough
from counts c left join counts p on p.population = c.population and p.censoring = c.censoring
 and p.variant = 'partial' and p.outcome = c.outcome and p.risk_window = c.risk_window"""
VIEWS["control_first"] = """
select person_id, concept_id, replace(outcome_name, ' ', '_') outcome, min(condition_start_date) event_date
from members join condition_occurrence using (person_id) join nco on concept_id = condition_concept_id
where condition_start_date > index_date group by all"""
VIEWS["control_dense"] = """
select *, case when ends = death_date then 2 when ends = event_date then 1 else 0 end event,
       ends - index_date time
from (
  select p.*, c.outcome, event_date,
         least(death_date, leave_date, event_date, case when grp = 'unvaccinated' then next_vaccine end) ends
  from (select * from pops where population = 'any') p
  cross join (select distinct replace(outcome_name, ' ', '_') outcome from nco) c
  left join (select person_id, outcome, min(event_date) event_date from control_first group by all) o
    on o.person_id = p.person_id and o.outcome = c.outcome)
where ends - index_date >= 1"""


def _totals(keys: str, table: str) -> str:
    return f"""
select {keys}, analysis, grp "group", event, count(*) n_rows, sum(time) as person_days,
       round(sum(case when analysis = 'crude' then 1 else weight end) + 1e-9, 6) weight
from {table}, (values ('crude'), ('adjusted')) t(analysis) group by all"""


def _risk_sets(keys: str, table: str, weighted: bool, rounded: bool = True, every_day: bool = False) -> str:
    """Risk sets by day from the full study tables, on request of every day and with the share still uncensored, g."""
    w = "w" if weighted else "1"

    def shown(x: str) -> str:
        return f"round({x} + 1e-9, 6)" if rounded else x

    return f"""
with days as (
  select {keys}, analysis, time,
         sum(case when event = 1 then 1 else 0 end) n_events,
         sum(case when event = 1 and grp = 'vaccinated' then w else 0 end) ev,
         sum(case when event = 1 and grp <> 'vaccinated' then w else 0 end) eu,
         sum(case when event = 2 and grp = 'vaccinated' then w else 0 end) dv,
         sum(case when event = 2 and grp <> 'vaccinated' then w else 0 end) du,
         sum(case when grp = 'vaccinated' then w else 0 end) wv,
         sum(case when grp <> 'vaccinated' then w else 0 end) wu,
         sum({w}) g_all, sum(case when event = 0 then {w} else 0 end) g_cens, count(*) n,
         sum(case when event = 0 then 1 else 0 end) n_cens
  from (select *, case when analysis = 'crude' then 1.0::double else weight end w
        from {table}, (values ('crude'), ('adjusted')) t(analysis))
  group by all),
at_risk as (
  select *, sum(wv) over later yv, sum(wu) over later yu, sum(n) over later yn, sum(g_all) over later yg
  from days
  window later as (partition by {keys}, analysis order by time desc rows unbounded preceding)),
steps as (
  select *, case when n_cens = 0 then 1.0::double when n_cens > 0 and yn = n then 0.0::double
                 else 1 - g_cens / (yg - (g_all - g_cens)) end step
  from at_risk),
surviving as (
  select *, coalesce(product(step) over (partition by {keys}, analysis order by time
                     rows between unbounded preceding and 1 preceding), 1) g
  from steps)
select {keys}, analysis, time, n_events,{' g,' if every_day else ''} {shown('ev')} ev, {shown('eu')} eu,
       {shown('yv + g * coalesce(cv, 0)')} risk_v, {shown('yu + g * coalesce(cu, 0)')} risk_u
from (select *, sum(dv / nullif(g, 0)) over earlier cv, sum(du / nullif(g, 0)) over earlier cu from surviving
      window earlier as (partition by {keys}, analysis order by time
                         rows between unbounded preceding and 1 preceding))
{'' if every_day else 'where n_events > 0'}"""


GRID = "population, censoring, variant, outcome, risk_window"


def _fits(keys: str, table: str, least: int = 1) -> str:
    """Newton's steps on the risk sets, every tied event a term of its own (Efron's rule)."""
    return f"""
select {keys}, analysis, n_events, log_hr, se, exp(log_hr) hr, exp(-log_hr) hr_inverse, exp(log_hr - {Z} * se) low95,
       exp(log_hr + {Z} * se) upper95, log_hr is not null converged
from (
  with recursive terms as (
    select {keys}, analysis, sum(n_events) over one n_events, sum(ev) over one tv, sum(eu) over one tu,
           (ev + eu) / n_events w, risk_v - k * ev / n_events a, risk_u - k * eu / n_events b
    from (select *, unnest(range(n_events::bigint)) k, n_events n from ({_risk_sets(keys, table, True, False)}))
    window one as (partition by {keys}, analysis)
  ), lists as (
    select {keys}, analysis, count(*) n_events, sum(case when tv > 0 and tu > 0 then 1 else 0 end) > 0 both_arms,
           sum(w) total, list(w) ws, list(a) a, list(b) b
    from terms group by all having count(*) >= {least}
  ), arms as (
    select {keys}, analysis, sum(ev) tv from ({_risk_sets(keys, table, True, False)}) group by all
  ), steps as (
    select l.*, tv, 0 step, 0.0::double beta, null::double info
    from lists l join arms r on {_same(keys + ", analysis", "l", "r")}
    union all
    select * exclude (p, beta, info, step), step + 1,
      beta + greatest(-2, least(2, (tv - list_dot_product(ws, p)) / list_dot_product(ws, list_transform(p, lambda x: x * (1 - x))))),
      list_dot_product(ws, list_transform(p, lambda x: x * (1 - x)))
    from (select *, list_transform(range(1, len(ws) + 1), lambda i: a[i] / (a[i] + b[i] * exp(-beta))) p
          from steps where both_arms and step < 30)
  )
  select {keys}, analysis, n_events, case when both_arms then beta end log_hr, case when both_arms then 1 / sqrt(info) end se
  from steps where step = case when both_arms then 30 else 0 end)"""


def _same(keys: str, a: str, b: str) -> str:
    return " and ".join(f"{a}.{k.strip()} is not distinct from {b}.{k.strip()}" for k in keys.split(","))


VIEWS["fits"] = _fits(GRID, "dense_valid", 5)
VIEWS["control_fits"] = _fits("outcome", "control_dense")

# --- calibration ----------------------------------------------------------------------------

VIEWS["count_estimates"] = """
select cohort_definition_id, censoring, ln((count(*) + 1) / 100.0::double) log_rr, 1 / sqrt(count(*) + 1) se
from derived join censoring_names using (code) group by cohort_definition_id, censoring"""


def _profile(points: str, by: str) -> str:
    return f"""
select {by}, arg_max(sigma, fit) sigma, arg_max(mu, fit) mu, any_value(step) step, any_value(n) n
from (select {by}, sigma, any_value(step) step, count(*) n,
             sum(log_rr / (sigma*sigma + se*se)) / sum(1 / (sigma*sigma + se*se)) mu,
             -0.5 * (sum(ln(sigma*sigma + se*se)) + sum(log_rr*log_rr / (sigma*sigma + se*se))
                     - sum(log_rr / (sigma*sigma + se*se)) * sum(log_rr / (sigma*sigma + se*se))
                       / sum(1 / (sigma*sigma + se*se))) fit
      from {points} group by {by}, sigma)
group by {by}"""


def _error_model(name: str, estimates: str, by: str) -> None:
    """Views <name>_coarse_points, <name>_coarse, <name>_fine_points and <name>_model over estimates (log_rr, se)."""
    VIEWS[f"{name}_coarse_points"] = f"""
select *, step * i sigma from (
  select e.*, (max(log_rr) over c - min(log_rr) over c) / 1000 step from {estimates} e where log_rr is not null
  window c as (partition by {by})), range(0, 1001) t(i)"""
    VIEWS[f"{name}_coarse"] = _profile(f"{name}_coarse_points", by)
    VIEWS[f"{name}_fine_points"] = f"""
select e.{by}, log_rr, se, step, c.sigma + step * i / 50 sigma
from {estimates} e join {name}_coarse c using ({by}), range(-50, 51) t(i)
where c.sigma + step * i / 50 >= 0 and log_rr is not null"""
    VIEWS[f"{name}_model"] = _profile(f"{name}_fine_points", by)


_error_model("counted", "count_estimates", "censoring")
VIEWS["control_estimates"] = "select outcome, analysis, log_hr log_rr, se from control_fits"
_error_model("control", "control_estimates", "analysis")


# --- oracles ----------------------------------------------------------------------------------


def _used(body: str) -> list[str]:
    """Views a query mentions, each after those it mentions itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                if VIEWS[name] is text:
                    continue
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    return order


def oracle(name: str, body: str) -> None:
    views = [f"{v} as ({VIEWS[v].strip()})" for v in _used(body)]
    head = "with " + ",\n".join(views) + "\n" if views else ""
    ORACLES[name] = head + f"select * from ({body.strip()}) answer"


oracle("scan_person", "select * from person")
oracle("scan_cohort", "select cohort_definition_id, subject_id person_id, cohort_start_date from cohort")
oracle("scan_fact", "select * from condition_occurrence where person_id in (select person_id from members)")
oracle("nco_list", """
select outcome_name "OutcomeName", concept_id "ConceptId", n_rows from nco left join
(select condition_concept_id, count(*) n_rows from condition_occurrence group by all) c
on concept_id = condition_concept_id""")
oracle("code_filter", "select * from dose")
oracle("stage_roundtrip", "select * from feat_visit")
oracle("result_export", f"select {GRID}, nv n_vaccinated, nu n_unvaccinated, enough from counts_gated")
oracle("cohort_append", """
select cohort_definition_id, count(*) n_rows, min(cohort_start_date) first_start, max(cohort_end_date) last_end
from (select * from cohort union all
      select cohort_definition_id, subject_id, cohort_start_date, cohort_end_date from derived) group by all""")
oracle("cohort_remap", """
select cast(new_id as int) cohort_definition_id, subject_id, cohort_start_date, cohort_end_date from cohort
join (values (1,177),(2,178),(3,179),(4,180),(5,181),(6,182),(7,183),(8,184),(9,185),(10,186),(13,187),
 (14,188),(17,189),(18,190),(21,191),(22,192)) t(old_id, new_id) on old_id = cohort_definition_id""")

oracle("pairs_all", """
select person_id, outcome_id, count(distinct covid_date) n_infections,
       count(distinct outcome_date) n_events, count(*) n_pairs
from inf join outc using (person_id) group by all""")
oracle("pairs_horizon", "select * from pairs_h")
oracle("washout", "select * from washed")
oracle("washout_literal", """
select p.person_id, p.outcome_id, p.covid_date, p.outcome_date
from (select * from inf join outc using (person_id)) p
where not exists (select 1 from inf i join outc o using (person_id)
  where i.covid_date > o.outcome_date and i.covid_date < o.outcome_date + 180
    and i.person_id = p.person_id and o.outcome_id = p.outcome_id
    and i.covid_date = p.covid_date and o.outcome_date = p.outcome_date)
  and p.covid_date < p.outcome_date and p.covid_date >= p.outcome_date - 365""")
oracle("window_classify", """
select distinct cast(4*(outcome_id-4) - (4-risk_window) + 14 as int) cohort_definition_id, person_id,
       outcome_id, covid_date from kept_window where code = 0""")
oracle("cohort_ids", """
select cohort_definition_id, count(*) n_rows, count(distinct subject_id) n_persons, outcome_id, censoring,
       risk_window from derived join censoring_names using (code)
group by cohort_definition_id, outcome_id, censoring, risk_window""")
COHORT_COLUMNS = "cohort_definition_id, subject_id, cohort_start_date, cohort_end_date"
oracle("cohort_end", f"select {COHORT_COLUMNS} from derived where code = 0")
oracle("cohort_end_in_window", """
select cast(4*(outcome_id-4) - (4-risk_window) + 14 + 40*code as int) cohort_definition_id,
       person_id subject_id, covid_date cohort_start_date, min(outcome_date) cohort_end_date
from kept_window group by code, person_id, outcome_id, covid_date, risk_window""")
for _code, _name in enumerate(("none", "covid", "vaccine", "both")):
    oracle(f"censor_{_name}", f"""
select person_id, outcome_id, covid_date, outcome_date from kept where code = {_code}""")
oracle("cohort_union", """
select censoring, outcome_id, risk_window, count(*) n_rows
from derived join censoring_names using (code) group by all""")
oracle("outcome_cohorts", f"select {COHORT_COLUMNS} from derived")
oracle("composite_outcome", "select * from named")
oracle("join_full", """
select person_id, first_dose, first_infection from dose_first full join
(select person_id, min(covid_date) first_infection from inf group by person_id) i using (person_id)""")

oracle("arm_members", 'select person_id, index_date, grp "group" from members')
for _arm in ("vaccinated", "unvaccinated"):
    oracle(f"next_dose_{_arm}", f"""
select person_id, index_date, grp "group", next_vaccine from members_next where grp = '{_arm}'""")
oracle("population", 'select * exclude (grp), grp "group" from pop')
oracle("arm_sizes", 'select grp "group", count(*) population from members group by grp')
oracle("index_date_distribution", """
select stratum, index_date, n, round(n / total, 6) "share", round(below / total, 6) "lower",
       round((below + n) / total, 6) "upper" from date_shares""")
oracle("assign_index_date", 'select stratum, person_id, index_date, grp "group" from stratum_members')
oracle("stratum_population", """
select population, person_id, index_date, grp "group", next_vaccine, leave_date, death_date, gender, age,
       round(weight, 6) weight from pops""")

for _name in ("feat_drug", "feat_condition", "feat_visit", "feat_test", "factor_age_group",
              "factor_gender", "factor_location", "feat_age"):
    oracle(_name, f"select * from {_name}")
oracle("feat_alltime", """
select person_id, replace('condition_ocurrence_' || coalesce(concept_name, 'NA') || '_allTime', ' ', '_') covariate,
       count(*)::double "value"
from condition_rows left join concept using (concept_id) where gap > 0 group by all""")
oracle("care_site_code", """
select care_site_id, row_number() over (order by care_site_id nulls last) "value"
from (select distinct care_site_id from located)""")
oracle("feat_obs_years", 'select person_id, covariate, round("value", 6) "value" from feat_obs_years')
oracle("covariate_dictionary", """
select concept_id * 1000 + analysis_id feature_id, cast(concept_id as varchar) covariate_id, concept_name covariate_name, analysis_id
from (select distinct concept_id, 1 analysis_id from drug_rows union all
      select distinct concept_id, 2 from condition_rows) left join concept using (concept_id)
union all select 581477003, '581477', 'Visit to GP', 3
where exists (select 1 from visit_occurrence join members using (person_id))
union all select distinct feature_id, null, name, 6 from cohort join members on subject_id = person_id
join (values (175, 1006, 'Any covid19 test'), (176, 2006, 'PCR covid19 test'), (4, 3006, 'Diag+ covid19'))
  t(id, feature_id, name) on id = cohort_definition_id""")
oracle("covariate_names", "select covariate, count(*) n from discrete group by covariate")
oracle("covariates_long", """
select person_id, covariate, round("value", 6) "value", kind from (
select *, 'discrete' kind from discrete union all select *, 'continuous' from continuous
union all select *, 'factor' from factors)""")
oracle("rare_filter", "select * from frequent")
oracle("rare_summary", """
select count(*) n_covariates, sum(case when n > threshold then 0 else 1 end) n_excluded,
       max(threshold) threshold from frequency""")
oracle("select_covariates", """
select * from discrete where covariate in (select covariate from frequency
 where n > (select floor(count(*) * 0.05) from members))""")
oracle("restrict_population", """
select f.*, stratum from feat_condition f join strata on true
where exists (select 1 from cohort where subject_id = person_id
              and (cohort_definition_id = vaccinated_id or cohort_definition_id = 177))""")
oracle("reference_levels", """
select family, min(covariate) covariate from factors
join (values ('care_site'), ('region'), ('age_g'), ('gender')) t(family) on contains(covariate, family)
group by family""")
oracle("pivot_small", "select person_id, " + ", ".join(
    f"min(case when outcome = 'Control_{i}' then event_date end) \"Control_{i}\"" for i in range(5)
) + " from control_first group by person_id")
oracle("design_matrix_stats", """
select person_id, grp "group", cast(count(case when x <> 0 then 1 end) as int) n_nonzero, round(sum(x), 4) total
from (select person_id, "value" x from frequent
      union all select person_id, "value" from continuous
      union all select person_id, "value" from factors where covariate not in (
        select min(covariate) from factors
        join (values ('care_site'), ('region'), ('age_g'), ('gender')) t(family) on contains(covariate, family)
        group by family)
      union all select person_id, index_date - date '1970-01-01' from members
      union all select person_id, age * age from aged)
join members using (person_id) group by person_id, grp""")

oracle("ps_sample", f"""
select person_id, index_date from members
order by md5(cast(person_id as varchar) || '#{SEED}#sample')[1:13], person_id limit 500""")
oracle("uniform_draw", f"""
select person_id, round(cast('0x' || substr(md5(cast(person_id as varchar) || '#{SEED}'), 1, 13) as bigint)
       / 4503599627370496.0, 9) u from members""")
oracle("overlap_weights", """
select person_id, grp "group", round(ps, 6) ps,
       round(case when grp = 'vaccinated' then 1 - ps else ps end, 6) weight
from members join scores using (person_id)""")
oracle("lasso_optimality", "select count(distinct covariate) n_flags, true selects, 0 n_violated from frequent")
oracle("ps_report", """
select * from (
  select kind, covariate, sum(case when grp = 'vaccinated' then 1 else 0 end) n_vaccinated,
         sum(case when grp = 'unvaccinated' then 1 else 0 end) n_unvaccinated
  from (select distinct 'discrete' kind, covariate, person_id from frequent
        union all select distinct 'factor', covariate, person_id from factors) join members using (person_id)
  group by all)
where n_vaccinated = 0 or n_unvaccinated = 0""")
oracle("ps_score_report", """
select grp "group", count(*) n, sum(case when person_id % 10 = 0 then 1 else 0 end) n_at_zero,
       sum(case when person_id % 10 = 1 then 1 else 0 end) n_at_one, sum(case when person_id % 10 = 2 then 1 else 0 end) n_unknown
from members group by grp""")
oracle("drop_zero_weight", """
select person_id, grp "group", round(weight, 6) weight
from (select person_id, grp, case when grp = 'vaccinated' then 1 - p else p end weight
      from (select *, case when person_id % 10 < 2 then 0 else ps end p
            from members join scores using (person_id)))
where weight <> 0""")
ROUNDED = ", ".join(f"round({c}, 6) {c}" for c in ("mean1", "var1", "mean2", "var2", "smd"))
oracle("smd_discrete", f"select covariate, weighting, {ROUNDED} from smd_flags where weighting = 'before'")
oracle("smd_discrete_weighted", f"select covariate, weighting, {ROUNDED} from smd_flags where weighting = 'after'")
oracle("smd_continuous", f"select covariate, weighting, {ROUNDED} from smd_numbers")
oracle("smd_factor_shares", "select variable, covariate, weighting, round(p1, 6) p1, round(p2, 6) p2 from shares")
oracle("smd_factor", "select variable, weighting, round(smd, 6) smd from smd_factors")
oracle("balance_before_after", """
select covariate, round(max(case when weighting = 'before' then smd end), 6) smd_before,
       round(max(case when weighting = 'after' then smd end), 6) smd_after from balance group by covariate""")
oracle("balance_share", """
select weighting, count(*) n_covariates, sum(case when smd between -0.1 and 0.1 then 1 else 0 end) n_balanced,
       round(avg(case when smd between -0.1 and 0.1 then 1.0::double else 0 end), 6) share_balanced
from balance group by weighting""")
oracle("ps_histogram", """
select grp "group", cast(least(floor(ps * 20), 19) as int) bin, count(*) n
from members join scores using (person_id) group by all""")

oracle("follow_up", """
select person_id, grp "group", limited, ends - index_date time,
       case when ends = death_date then 2 else 0 end event
from (select *, least(death_date, leave_date, case when limited then next_vaccine end) ends
      from pop join (values (false), (true)) t(limited) on limited or grp = 'vaccinated')""")
STUDY_COLUMNS = """censoring, variant, outcome, risk_window, person_id, grp "group", covid_date, outcome_date,
 time, event, round(weight, 6) weight"""
oracle("study_table", f"""
select {STUDY_COLUMNS} from dense_valid where population = 'any' and covid_date is not null""")
oracle("study_table_full", f"""
select {STUDY_COLUMNS} from dense_valid where population = 'any' and covid_date is not null and variant = 'full'""")
oracle("study_table_first", f"""
select {STUDY_COLUMNS} from (
  select *, row_number() over (partition by population, censoring, variant, outcome, risk_window, person_id
                               order by covid_date, outcome_date) place
  from dense where covid_date is not null)
where population = 'any' and place = 1 and time >= 1""")
oracle("dropped_rows", f"""
select {GRID}, count(*) n_rows, count(distinct person_id) n_persons from dense
where covid_date is not null and (time < 1 or time is null) group by all""")
oracle("study_table_totals", _totals(GRID, "dense_valid"))
oracle("censor_violations", """
select censoring, variant, count(*) n_rows,
       sum(case when event = 1 and outcome_date > next_vaccine then 1 else 0 end) n_violations
from dense where population = 'any' and covid_date is not null
 and (censoring in ('vaccine', 'both') or (variant = 'full' and grp = 'unvaccinated')) group by all""")
oracle("event_counts", """
select censoring, variant, outcome, risk_window, nv n_vaccinated, nu n_unvaccinated, enough
from counts_gated where population = 'any'""")
oracle("effect_grid_counts", f"select {GRID}, nv n_vaccinated, nu n_unvaccinated, enough from counts_gated")
oracle("fg_riskset", _risk_sets(GRID, "dense_valid", True))
oracle("fg_riskset_counted", _risk_sets("outcome", "control_dense", False))
FITTED = "round(log_hr, 6) log_hr, round(se, 6) se, round(hr, 6) hr, round(hr_inverse, 6) hr_inverse, " \
    "round(low95, 6) low95, round(upper95, 6) upper95, converged"
oracle("fg_estimates", f"select {GRID}, analysis, n_events, {FITTED} from fits")
oracle("fg_nco", f"select outcome, analysis, n_events, {FITTED} from control_fits")
# Score residuals row by row, with every tied event a term of its own, summed per person and squared.
oracle("fg_robust", f"""
with fitted as (select * from fits where log_hr is not null),
days as (
  select d.*, exp(f.log_hr) r from ({_risk_sets(GRID, 'dense_valid', True, False, True)}) d
  join fitted f on {_same(GRID + ', analysis', 'd', 'f')}
), ties as (
  select {GRID}, analysis, time, k / n_events part, r, (ev + eu) / n_events / ((risk_v - k / n_events * ev) * r + risk_u - k / n_events * eu) h,
         (risk_v - k / n_events * ev) * r / ((risk_v - k / n_events * ev) * r + risk_u - k / n_events * eu) mean
  from (select *, unnest(range(n_events::bigint)) k from days where n_events > 0)
), taken as (
  select {GRID}, analysis, time, sum(r * h * (1 - mean)) av, sum(-h * mean) au, sum(part * r * h * (1 - mean)) bv,
         sum(-part * h * mean) bu, avg(mean) mean
  from ties group by all
), running as (
  select d.*, t.bv, t.bu, t.mean, sum(coalesce(av, 0)) over upto sv, sum(coalesce(au, 0)) over upto su,
         sum(g * coalesce(av, 0)) over upto cv, sum(g * coalesce(au, 0)) over upto cu,
         sum(g * coalesce(av, 0)) over whole tv, sum(g * coalesce(au, 0)) over whole tu
  from days d left join taken t on d.time = t.time and {_same(GRID + ', analysis', 'd', 't')}
  window upto as (partition by {', '.join('d.' + x.strip() for x in GRID.split(','))}, d.analysis order by d.time),
         whole as (partition by {', '.join('d.' + x.strip() for x in GRID.split(','))}, d.analysis)
), residuals as (
  select {', '.join('d.' + x.strip() for x in GRID.split(','))}, d.analysis, person_id, case when d.analysis = 'crude' then 1 else weight end *
    case when grp = 'vaccinated'
      then case event when 1 then 1 - mean - (sv - bv) when 0 then -sv else -(sv + coalesce((tv - cv) / nullif(g, 0), 0)) end
      else case event when 1 then 0 - mean - (su - bu) when 0 then -su else -(su + coalesce((tu - cu) / nullif(g, 0), 0)) end end u
  from dense_valid p join running d on p.time = d.time and {_same(GRID, 'p', 'd')}
), spread as (
  select {GRID}, analysis, sum(u * u) meat from (select {GRID}, analysis, person_id, sum(u) u from residuals group by all) group by all
)
select {', '.join('f.' + x.strip() for x in GRID.split(','))}, f.analysis, n_events, round(log_hr, 6) log_hr, round(se, 6) se, round(sqrt(meat) * se * se, 6) robust_se,
       round(exp(log_hr - {Z} * sqrt(meat) * se * se), 6) robust_low95, round(exp(log_hr + {Z} * sqrt(meat) * se * se), 6) robust_upper95
from fitted f join spread s on {_same(GRID + ', analysis', 'f', 's')}""")
oracle("effect_report", f"""
select {', '.join(f'k.{x.strip()}' for x in GRID.split(','))}, k.analysis, k.cohortId "cohortId", k.cohortName "cohortName",
       round(hr, 6) "HR", round(hr_inverse, 6) "HRinvers", round(low95, 6) "low95", round(upper95, 6) "upper95",
       round(se, 6) "SE", case when enough then nv end "n_vaccinated", case when enough then nu end "n_unvaccinated"
from (
  select *, case when outcome <> 'ATE' then cast(15 + 40 * code + 4 * place + risk_window - 1 as int) end cohortId,
         concat_ws(' ', outcome, days, label) cohortName
  from (values ('any'), ('AZ'), ('PF')) p(population), (values ('crude'), ('adjusted')) a(analysis),
       (values ('none','partial',0,'no'),('none','full',0,'no'),('covid','partial',1,'covid'),('covid','full',1,'covid'),
               ('vaccine',null,2,'vax'),('both',null,3,'covid+vax')) c(censoring, variant, code, what),
       (values ('VTE',0),('DVT',1),('PE',2),('HS',3),('IS',4),('TIA',5),('MI',6),('MP',7),('VACA',8),('HF',9),('ATE',0))
         o(outcome, place),
       (values (1,'0 to 30'),(2,'31 to 90'),(3,'91 to 180'),(4,'181 to 365')) w(risk_window, days),
       (select what || ' censoring' label, what from (values ('no'),('covid'),('vax'),('covid+vax')) t(what)) l
  where l.what = c.what) k
left join counts_gated g on {_same(GRID, 'g', 'k')}
left join fits f on enough and {_same(GRID + ', analysis', 'f', 'k')}""")
oracle("nco_first", """
select person_id, concept_id "ConceptId", outcome, event_date from control_first""")
oracle("nco_study_table", _totals("outcome", "control_dense"))
oracle("error_model", "select censoring, round(mu, 4) mu, round(sigma, 4) sigma, n n_controls from counted_model")
oracle("calibrated_nco", f"""
select outcome, analysis, round(log_rr, 6) log_rr, round(se, 6) se,
       round(exp(log_rr - mu), 4) cal_hr, round(exp(log_rr - mu - {Z} * s), 4) cal_low95,
       round(exp(log_rr - mu + {Z} * s), 4) cal_upper95, round(s, 4) cal_se_log, round(exp(s), 4) cal_exp_se
from (select e.*, mu, sqrt(se*se + sigma*sigma) s from control_estimates e join control_model using (analysis))""")
oracle("calibrate_ci", f"""
select cohort_definition_id, round(exp(log_rr - 0.1), 6) cal_hr,
       round(exp(log_rr - 0.1 - {Z} * s), 6) cal_low95, round(exp(log_rr - 0.1 + {Z} * s), 6) cal_upper95,
       round(s, 6) cal_se_log, round(exp(s), 6) cal_exp_se
from (select *, sqrt(se*se + 0.15*0.15) s from count_estimates)""")
oracle("ci_coverage", f"""
select round(exp(truth), 6) true_rr, count(*) n_estimates, round(avg(off), 6) share_significant,
       round(1 - avg(off), 6) share_covered
from (select truth, case when log_rr - {Z} * se > truth or log_rr + {Z} * se < truth then 1.0::double else 0 end off
      from (select *, case when censoring = 'none' then 0 else ln(2.0::double) end truth from count_estimates))
group by truth""")
