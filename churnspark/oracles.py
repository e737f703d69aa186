"""Independent DuckDB SQL for every SQL-expressible registered query.

Each text starts from the raw test tables through the fixture CTEs
(``sources/fixture_sql.py``).  Column names equal the Spark side's; ratios are cast
to double and integer sums to bigint on both sides.
"""

from __future__ import annotations

from .sources.fixture_sql import (TENURE_CODE_SQL, _mode, _services_count, with_fixtures,
                                  with_views)

SERVICES = ["online_security", "online_backup", "device_protection", "tech_support", "streaming_tv",
            "streaming_movies"]
BASE_STRINGS = ["gender", "partner", "dependents", "phone_service", "multiple_lines", "internet_service", *SERVICES,
                "contract", "paperless_billing", "payment_method", "churn"]
YES_NO = ["partner", "dependents", "phone_service", "paperless_billing", "churn"]

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def two_sided_p_sql(z: str) -> str:
    """Two-sided normal p-value as erfc(|z| / sqrt 2): the series of erf for small arguments, the continued fraction
    beyond.  The engine uses rational approximations; nothing of them is in here."""
    x = f"(abs({z}) / sqrt(2.0))"
    series = (f"list_reduce(list_prepend(1.0::double, list_transform(range(80, 0, -1), lambda k: k::double)), "
              f"lambda a, k: 1.0 + 2.0 * {x} * {x} / (2.0 * k + 1.0) * a)")
    fraction = (f"list_reduce(list_prepend({x}, list_transform(range(120, 0, -1), lambda k: k::double)), "
                f"lambda a, k: {x} + k / 2.0 / a)")
    return (f"(case when {x} < 2.0 then 1.0 - 2.0 / sqrt(pi()) * exp(-{x} * {x}) * {x} * {series} "
            f"else exp(-{x} * {x}) / sqrt(pi()) / {fraction} end)")


# shared CTE text: the base preparation chain
PREP_CTES = f"""
p1 as (select * replace (case when try_cast(trim(total_charges) as double) is null and tenure=0 then 0.0
  else try_cast(trim(total_charges) as double) end as total_charges) from base),
p2 as (select * replace (coalesce(total_charges, (select avg(total_charges) from p1)) as total_charges,
  coalesce(monthly_charges, (select avg(monthly_charges) from p1)) as monthly_charges) from p1),
p3 as (select * replace ({', '.join(f'coalesce({c}, {_mode(c, "p2")}) as {c}' for c in BASE_STRINGS)}) from p2),
prep as (select * replace ({', '.join(f"case {c} when 'Yes' then 1 when 'No' then 0 end as {c}" for c in YES_NO)})
  from p3)"""

# ---------------------------------------------------------------- 2.1 sources
oracle("read_subscriptions", with_fixtures("select * from base"))
oracle("read_all_sources", with_fixtures("""
select 'subscriptions' as source, count(*) as row_count, 21 as column_count from base
union all select 'crm', count(*), 14 from crm
union all select 'zip_population', count(*), 2 from zip_population
union all select 'data_dictionary', 21 + 14 + 2, 3"""))
oracle("read_enhanced", with_views("""
select customer_id, customer_status,
  case when customer_status='Churned' then 1 when customer_status='Stayed' then 0 end as churn
from integrated"""))

# ---------------------------------------------------------------- 2.2 cleaning
oracle("coerce_total_charges", with_fixtures(
    "select customer_id, tenure, try_cast(trim(total_charges) as double) as total_charges from base"))
oracle("zero_new_customer_charges", with_fixtures("select customer_id, tenure, total_charges from p1", PREP_CTES))
oracle("mean_impute", with_fixtures("select customer_id, monthly_charges, total_charges from p2", PREP_CTES))
oracle("mode_impute", with_fixtures(
    f"select customer_id, {', '.join(f'coalesce({c}, {_mode(c, 'base')}) as {c}' for c in SERVICES)} from base"))
oracle("zero_fill", with_fixtures("""
select customer_id, coalesce(number_of_referrals, 0) as number_of_referrals,
  coalesce(avg_monthly_gb_download, 0) as avg_monthly_gb_download,
  coalesce(avg_monthly_long_distance_charges, 0) as avg_monthly_long_distance_charges from subscriptions"""))
oracle("encode_yes_no", with_fixtures(
    "select customer_id, " + ", ".join(f"case {c} when 'Yes' then 1 when 'No' then 0 end as {c}" for c in YES_NO)
    + " from base"))
oracle("normalize_churn", with_fixtures("""
select customer_id, churn, coalesce(case when churn='Yes' then 1 when churn='No' then 0 end,
  try_cast(try_cast(churn as double) as integer), 0) as churn_flag from base"""))
oracle("target_from_status", with_fixtures("""
select customer_id, customer_status,
  case when customer_status='Churned' then 1 when customer_status='Stayed' then 0 end as churn from crm"""))
_SUB_COLS = ["customer_id", "gender", "senior_citizen", "partner", "dependents", "tenure", "phone_service",
             "multiple_lines", "internet_service", *SERVICES, "contract", "paperless_billing", "payment_method",
             "monthly_charges", "total_charges", "churn", "zip_code", "city", "number_of_referrals",
             "avg_monthly_gb_download", "avg_monthly_long_distance_charges"]
oracle("null_profile", with_fixtures(" union all ".join(
    f"select '{c}' as column_name, cast(count(*) - count({c}) as bigint) as null_count from subscriptions"
    for c in _SUB_COLS)))
oracle("drop_identifier_columns", with_fixtures("select * exclude (customer_id, churn) from base"))
oracle("standardize_crm", with_fixtures("select * from crm"))
oracle("churn_details", with_fixtures(
    "select customer_id, customer_status, churn_category, churn_reason from crm where customer_status='Churned'"))
oracle("usage_metrics", with_fixtures("""
select customer_id, avg_monthly_long_distance_charges, avg_monthly_gb_download, total_extra_data_charges,
  total_long_distance_charges from crm"""))
oracle("segment_filter", with_fixtures("""
select customer_id, contract, internet_service, monthly_charges from base
where contract='Month-to-month' and internet_service='Fiber optic'"""))
oracle("preprocess", with_fixtures("select * from prep", PREP_CTES))

# ---------------------------------------------------------------- 2.3 joins
oracle("common_customers", with_fixtures("""
select count(*) as common_customers from
  (select customer_id from subscriptions intersect select customer_id from crm where customer_status <> 'Joined')"""))
oracle("integrate_inner_join", with_fixtures("""
select b.*, c.* exclude (customer_id, gender) from base b join crm c on c.customer_id = b.customer_id
where c.customer_status <> 'Joined'"""))
oracle("join_zip_population", with_fixtures("""
select c.customer_id, c.zip_code, c.latitude, c.longitude, z.population,
  cast(z.population as double)/10.0 as population_density
from crm c left join zip_population z on z.zip_code = c.zip_code and z.zip_code >= 100"""))

# ---------------------------------------------------------------- 2.4 features
oracle("service_features", with_fixtures(f"""
select customer_id, {_services_count()} as total_services,
  case when tech_support='Yes' then 1 else 0 end as has_tech_support,
  case when online_security='Yes' then 1 else 0 end as has_online_security,
  case when streaming_tv='Yes' and streaming_movies='Yes' then 1 else 0 end as streaming_services
from base"""))
oracle("financial_features", with_fixtures("""
select customer_id, coalesce(tenure*monthly_charges, 0.0) as clv,
  coalesce(total_charges / (case when tenure=0 then 1 else tenure end), 0.0) as avg_monthly_spend from prep""",
                                           PREP_CTES))
oracle("tenure_contract_features", with_fixtures(f"""
select customer_id, tenure as tenure_months, {TENURE_CODE_SQL} as tenure_group,
  case contract when 'Month-to-month' then 2 when 'One year' then 1 when 'Two year' then 0 end
    as contract_risk_factor from base"""))
oracle("contract_risk_two_vocab", with_fixtures("""
select customer_id, case contract when 'Month-to-month' then 'Monthly' when 'One year' then 'One Year'
  else 'Two Year' end as contract_type,
  case contract when 'Month-to-month' then 2 when 'One year' then 1 else 0 end as contract_risk_factor from base"""))
oracle("geo_features", with_views("""
select customer_id, zip_code, count(*) over (partition by zip_code) as customers_in_zip,
  case when population = 0 then null else cast(count(*) over (partition by zip_code) as double) / cast(population as double) end
    as zip_penetration_rate
from integrated"""))
oracle("has_referrals", with_fixtures("""
select customer_id, number_of_referrals, cast(coalesce(number_of_referrals > 0, false) as integer) as has_referrals
from crm"""))
oracle("engineer_features", with_fixtures(f"""
select * replace (coalesce(tenure_group, 0) as tenure_group, coalesce(contract_risk_factor, 0) as contract_risk_factor)
from (select *, {_services_count()} as total_services,
  case when tech_support='Yes' then 1 else 0 end as has_tech_support,
  case when online_security='Yes' then 1 else 0 end as has_online_security,
  case when streaming_tv='Yes' and streaming_movies='Yes' then 1 else 0 end as streaming_services,
  coalesce(tenure*monthly_charges, 0.0) as clv,
  coalesce(total_charges / (case when tenure=0 then 1 else tenure end), 0.0) as avg_monthly_spend,
  tenure as tenure_months, {TENURE_CODE_SQL} as tenure_group,
  case contract when 'Month-to-month' then 2 when 'One year' then 1 when 'Two year' then 0 end
    as contract_risk_factor
  from prep)""", PREP_CTES))
oracle("engineer_additional_features", with_views("select * from engineered"))
oracle("revenue_per_service", with_fixtures(f"""
select customer_id, total_services, monthly_charges,
  monthly_charges / (case when total_services=0 then 1 else total_services end) as revenue_per_service
from (select customer_id, monthly_charges, {_services_count()} as total_services from base)"""))
oracle("clamp_probability", with_fixtures("""
select customer_id, least(greatest(case when isfinite(x) then x else 0.0 end, 0.0), 1.0) as churn_probability
from (select customer_id, churn_probability*1.5 - 0.25 as x from scored)"""))



# ---------------------------------------------------------------- 2.5 binning
def _tenure_label_sql(c: str = "tenure") -> str:
    return (f"case when {c} is null or {c}<=0 then null when {c}<=12 then '0-12 months' when {c}<=24 then "
            f"'13-24 months' when {c}<=36 then '25-36 months' when {c}<=48 then '37-48 months' when {c}<=60 then "
            f"'49-60 months' else '60+ months' end")


def _year_label_sql(c: str = "tenure_group") -> str:
    return (f"case when {c} is null then null when {c}=0 then '0-1 year' when {c}=1 then '1-2 years' "
            f"when {c}=2 then '2-3 years' when {c}=3 then '3-4 years' when {c}=4 then '4-5 years' "
            f"when {c}=5 then '5+ years' else concat('Group ', cast({c} as varchar)) end")


def _referral_sql(c: str = "number_of_referrals") -> str:
    return (f"case when {c} is null or {c}<=-1 then null when {c}<=0 then '0' when {c}<=1 then '1' "
            f"when {c}<=2 then '2' when {c}<=3 then '3' else '4+' end")


def _quartile_case(v: str, e: list[str], labels: list[str]) -> str:
    return (f"case when {v} is null then null when {v} < {e[0]} then null when {v} <= {e[1]} then '{labels[0]}' "
            f"when {v} <= {e[2]} then '{labels[1]}' when {v} <= {e[3]} then '{labels[2]}' "
            f"when {v} <= {e[4]} then '{labels[3]}' end")


POP_LABELS = ["Low Population", "Medium-Low Population", "Medium-High Population", "High Population"]
Q_LABELS = ["Low", "Medium-Low", "Medium-High", "High"]
POP_CTES = f"""
pe as (select min(cast(population as double)) e0, quantile_cont(cast(population as double), 0.25) e1,
  quantile_cont(cast(population as double), 0.5) e2, quantile_cont(cast(population as double), 0.75) e3,
  max(cast(population as double)) e4 from analysis),
popq as (select a.*, {_quartile_case('cast(a.population as double)', ['e0', 'e1', 'e2', 'e3', 'e4'], POP_LABELS)}
  as population_segment from analysis a, pe)"""

_USAGE = [("avg_monthly_gb_download", False), ("avg_monthly_long_distance_charges", False),
          ("total_services", True), ("streaming_services", True)]
_CYCLE = ["Very Low", "Low", "Medium-Low", "Medium", "Medium-High", "High", "Very High"]
_TS = ["No Services", "Very Low (1)", "Low (2)", "Medium (3)", "Medium-High (4)", "High (5)", "Very High (6)"]


def _txt(v: str) -> str:
    ints = ", ".join(f"'{m}'" for m, i in _USAGE if i)
    return f"(case when u.metric in ({ints}) then cast(cast({v} as bigint) as varchar) else cast({v} as varchar) end)"


USAGE_CTES = f"""
u as ({' union all '.join(f"select customer_id, churn_flag, '{m}' as metric, cast({m} as double) as value from analysis"
                          for m, _ in _USAGE)}),
ust as (select metric, count(distinct value) nu, min(value) mn, max(value) mx, quantile_cont(value, 0.25) q1,
  quantile_cont(value, 0.5) q2, quantile_cont(value, 0.75) q3 from u group by metric),
urk as (select metric, value, row_number() over (partition by metric order by value) - 1 as rk
  from (select distinct metric, value from u where value is not null)
  where metric in (select metric from ust where nu <= 10)),
ug as (
select u.customer_id, u.churn_flag, u.metric, u.value, case
  when ust.nu = 2 then (case when u.value = ust.mn then 'Low (' || {_txt('ust.mn')} || ')'
                             when u.value = ust.mx then 'High (' || {_txt('ust.mx')} || ')' end)
  when u.metric = 'total_services' then (case when u.value in (0,1,2,3,4,5,6)
       then {'[' + ', '.join(f"'{s}'" for s in _TS) + ']'}[cast(u.value as integer) + 1]
       else 'Premium (' || {_txt('u.value')} || ')' end)
  when ust.nu <= 10 then {'[' + ', '.join(f"'{s}'" for s in _CYCLE) + ']'}[cast(urk.rk % 7 as integer) + 1]
  when ust.mn < ust.q1 and ust.q1 < ust.q2 and ust.q2 < ust.q3 and ust.q3 < ust.mx
    then {_quartile_case('u.value', ['ust.mn', 'ust.q1', 'ust.q2', 'ust.q3', 'ust.mx'], Q_LABELS)}
  else {_quartile_case('u.value', ['ust.mn', 'ust.mn + (ust.mx-ust.mn)/4.0', 'ust.mn + (ust.mx-ust.mn)*0.5',
                                   'ust.mn + (ust.mx-ust.mn)*0.75', 'ust.mx'], Q_LABELS)}
  end as usage_level
from u join ust on ust.metric = u.metric left join urk on urk.metric = u.metric and urk.value = u.value
where ust.nu > 1)"""

oracle("tenure_code", with_fixtures(f"select customer_id, tenure, {TENURE_CODE_SQL} as tenure_code from base"))
oracle("tenure_labels", with_fixtures(f"select customer_id, tenure, {_tenure_label_sql()} as tenure_label from base"))
oracle("tenure_year_labels", with_views(
    f"select customer_id, tenure_group, {_year_label_sql()} as tenure_year_label from analysis"))
oracle("tenure_bounded_labels", with_fixtures("""
select customer_id, tenure, case when tenure is null or tenure<=0 then null when tenure<=12 then '0-1 year'
  when tenure<=24 then '1-2 years' when tenure<=36 then '2-3 years' when tenure<=48 then '3-4 years'
  when tenure<=60 then '4-5 years' when tenure<=72 then '5-6 years' end as tenure_bounded from base"""))
oracle("referral_bins", with_fixtures(
    f"select customer_id, number_of_referrals, {_referral_sql()} as referral_group from crm"))
oracle("risk_segment", with_views("select customer_id, churn_probability, risk_segment from scored_r"))
oracle("risk_category_point", with_fixtures("""
select customer_id, churn_probability, case when churn_probability < 0.25 then 'Low Risk'
  when churn_probability < 0.5 then 'Medium-Low Risk' when churn_probability < 0.75 then 'Medium-High Risk'
  else 'High Risk' end as risk_category from scored"""))
oracle("population_quartiles", with_views("select customer_id, population, population_segment from popq", POP_CTES))
oracle("usage_group", with_views("select * from ug", USAGE_CTES))
oracle("equal_width_bins", with_fixtures(f"""
select customer_id, monthly_charges, {_quartile_case('monthly_charges', ['mn', 'mn + (mx-mn)/4.0', 'mn + (mx-mn)*0.5',
                                                                           'mn + (mx-mn)*0.75', 'mx'], Q_LABELS)}
  as charge_group
from base, (select min(monthly_charges) mn, max(monthly_charges) mx from base)"""))

# ---------------------------------------------------------------- 2.6 reports
RATE = "avg(cast(churn_flag as double))*100.0 as churn_rate, count(*) as customer_count"
oracle("churn_by_dimension", with_views(f"""
select 'Contract' as dimension, contract as segment, {RATE} from analysis where contract is not null group by 2
union all select 'TenureGroup', {_year_label_sql()}, {RATE} from analysis where tenure_group is not null group by 2
union all select 'InternetService', internet_service, {RATE} from analysis where internet_service is not null group by 2
union all select 'PaymentMethod', payment_method, {RATE} from analysis where payment_method is not null group by 2"""))
CITY = f"select city, {RATE} from analysis group by city having count(*) >= 30"
oracle("churn_by_city", with_views(CITY))
oracle("top_churn_cities", with_views(f"select * from ({CITY}) order by churn_rate desc, city limit 10"))
oracle("bottom_churn_cities", with_views(f"select * from ({CITY}) order by churn_rate asc, city desc limit 10"))
oracle("churn_by_population", with_views(
    f"select population_segment, {RATE} from popq where population_segment is not null group by 1", POP_CTES))
oracle("churn_by_usage", with_views(
    f"select metric, usage_level, {RATE} from ug where usage_level is not null group by 1, 2", USAGE_CTES))
oracle("service_efficiency", with_views(f"""
select total_services, avg(monthly_charges / (case when total_services=0 then 1 else total_services end))
  as avg_revenue_per_service, {RATE} from analysis group by total_services having count(*) >= 30"""))
oracle("churn_by_tenure", with_views(f"""
select tenure_label, {RATE} from (select *, {_tenure_label_sql()} as tenure_label from analysis)
where tenure_label is not null group by 1"""))
oracle("churn_by_referrals", with_views(f"""
select referrals, {RATE} from (select *, {_referral_sql()} as referrals from analysis)
where referrals is not null group by 1"""))
oracle("churn_by_contract", with_views(
    "select contract, avg(cast(churn_flag as double)) as churn_rate, count(*) as customer_count "
    "from analysis group by contract"))
FIN = """select count(*) as total_customers, sum(monthly_charges) as monthly_revenue,
  avg(monthly_charges) as avg_monthly_charge,
  coalesce(sum(case when churn_flag=1 then monthly_charges end), 0.0)*12.0 as annual_revenue_at_risk,
  avg(cast(churn_flag as double))*100.0 as churn_rate from analysis"""
oracle("financial_summary", with_views(FIN))
oracle("revenue_metrics", with_views(f"""
select total_customers, monthly_revenue, churn_rate, annual_revenue_at_risk as revenue_at_risk,
  case when monthly_revenue > 0 then annual_revenue_at_risk / (monthly_revenue*12.0) * 100.0 else 0.0 end
    as revenue_at_risk_percentage from ({FIN})"""))
oracle("risk_segment_summary", with_views(f"""
select l.risk_segment, l.risk_order, g.churn_rate, coalesce(g.customer_count, 0) as customer_count,
  coalesce(g.monthly_revenue, 0.0) as monthly_revenue,
  cast(coalesce(g.customer_count, 0) as double) / t.n * 100.0 as segment_pct
from (select * from (values ('Low Risk', 0), ('Medium-Low Risk', 1), ('Medium-High Risk', 2), ('High Risk', 3))
      v(risk_segment, risk_order)) l
left join (select risk_segment, {RATE}, sum(monthly_charges) as monthly_revenue from analysis group by 1) g
  on g.risk_segment = l.risk_segment
cross join (select count(*) as n from analysis) t"""))
DRIVERS = f"""
select d.*, o.overall_churn, case when o.overall_churn = 0 then null else d.churn_rate / o.overall_churn end
  as relative_risk
from (
  select 'Contract' as feature, 'Relationship' as category, contract as segment, {RATE} from analysis
    where contract is not null group by 3
  union all select 'InternetService', 'Service', internet_service, {RATE} from analysis
    where internet_service is not null group by 3
  union all select 'PaymentMethod', 'Billing', payment_method, {RATE} from analysis
    where payment_method is not null group by 3
  union all select 'TenureGroup', 'Relationship', tl, {RATE}
    from (select *, {_tenure_label_sql()} as tl from analysis) where tl is not null group by 3) d,
  (select avg(cast(churn_flag as double))*100.0 as overall_churn from analysis) o"""
oracle("churn_drivers", with_views(DRIVERS))
oracle("union_drivers", with_views(DRIVERS))
oracle("top_risk_factors", with_views(
    f"select * from ({DRIVERS}) order by relative_risk desc nulls last, feature, segment limit 10"))
CORR = ["tenure", "monthly_charges", "total_charges", "churn_flag", "total_services", "clv", "contract_risk_factor"]
oracle("feature_correlation", with_views(" union all ".join(
    f"select '{c}' as feature, corr(cast({c} as double), cast(churn_flag as double)) as correlation from analysis"
    for c in CORR if c != "churn_flag")))
oracle("correlation_matrix", with_views(" union all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, corr(cast({a} as double), cast({b} as double)) as correlation "
    f"from analysis" for i, a in enumerate(CORR) for b in CORR[i + 1:])))

SEG_CTES = f"""
seg as (
select * from (
  select 'Risk Level' as segment_type, risk_segment as segment_value, * from analysis
  union all select 'Contract Type', contract, * from analysis
  union all select 'Internet Service', internet_service, * from analysis
  union all select 'Tenure Group', {_year_label_sql()}, * from analysis
  union all select 'Payment Method', payment_method, * from analysis) where segment_value is not null)"""
oracle("segment_profile", with_views(f"""
select segment_type, segment_value, count(*) as segment_size, cast(count(*) as double) / o.n * 100.0 as segment_pct,
  avg(cast(churn_flag as double))*100.0 as churn_rate, avg(cast(churn_flag as double))*100.0 - o.overall as churn_diff,
  sum(monthly_charges) as monthly_revenue
from seg, (select count(*) as n, avg(cast(churn_flag as double))*100.0 as overall from analysis) o
group by segment_type, segment_value, o.n, o.overall""", SEG_CTES))
NUMC = ["senior_citizen", "monthly_charges", "total_charges", "tenure", "total_services"]
CATC = ["gender", "partner", "dependents", "internet_service", "online_security", "online_backup",
        "device_protection", "tech_support", "streaming_tv", "streaming_movies", "phone_service", "multiple_lines",
        "contract", "payment_method", "paperless_billing"]
INSIGHT_CTES = SEG_CTES + f""",
nl as ({' union all '.join(f"select segment_type, segment_value, '{c}' as column_name, cast({c} as double) as v from seg"
                           for c in NUMC)}),
nov as ({' union all '.join(f"select '{c}' as column_name, avg(cast({c} as double)) as overall_mean from analysis"
                            for c in NUMC)}),
num_ins as (
select * from (select segment_type, segment_value, nl.column_name, avg(v) as segment_mean, nov.overall_mean,
  (avg(v) - nov.overall_mean) / nov.overall_mean * 100.0 as diff_pct
  from nl join nov on nov.column_name = nl.column_name
  group by segment_type, segment_value, nl.column_name, nov.overall_mean
  having min(v) < max(v) and nov.overall_mean > 0) where abs(diff_pct) >= 10.0),
cl as ({' union all '.join(f"select segment_type, segment_value, '{c}' as column_name, cast({c} as varchar) as v "
                           f"from seg" for c in CATC)}),
ccnt as (select segment_type, segment_value, column_name, v, count(*) as n from cl where v is not null
  group by all),
cagg as (select segment_type, segment_value, column_name, sum(n) over w as tot, count(*) over w as nu, v, n,
  row_number() over (partition by segment_type, segment_value, column_name order by n desc, v) as r
  from ccnt window w as (partition by segment_type, segment_value, column_name)),
oc as (select column_name, v, count(*) as n from ({' union all '.join(
    f"select '{c}' as column_name, cast({c} as varchar) as v from analysis" for c in CATC)}) where v is not null
  group by all),
op as (select column_name, v, n * 100.0 / sum(n) over (partition by column_name) as overall_pct from oc),
cat_ins as (
select * from (select a.segment_type, a.segment_value, a.column_name, a.v as top_value,
  cast(a.n as double) / a.tot * 100.0 as segment_pct, coalesce(op.overall_pct, 0.0) as overall_pct,
  cast(a.n as double) / a.tot * 100.0 - coalesce(op.overall_pct, 0.0) as diff_pct
  from cagg a left join op on op.column_name = a.column_name and op.v = a.v
  where a.r = 1 and a.nu > 1) where abs(diff_pct) >= 10.0)"""
oracle("segment_numeric_insights", with_views("select * from num_ins", INSIGHT_CTES))
oracle("segment_categorical_insights", with_views("select * from cat_ins", INSIGHT_CTES))
_DEMO = ["gender", "senior_citizen", "partner", "dependents"]
_SERV = ["internet_service", "online_security", "online_backup", "device_protection", "tech_support",
         "streaming_tv", "streaming_movies", "phone_service", "multiple_lines", "total_services"]
_FINC = ["monthly_charges", "total_charges", "contract", "payment_method", "paperless_billing", "tenure", "clv",
         "avg_monthly_spend"]


def _inlist(xs):
    return ", ".join(f"'{x}'" for x in xs)


oracle("insight_category", with_views(f"""
select segment_type, segment_value, column_name, diff_pct, kind,
  case when column_name in ({_inlist(_DEMO)}) then 'demographic' when column_name in ({_inlist(_SERV)})
    then 'service' when column_name in ({_inlist(_FINC)}) then 'financial' end as category
from (select segment_type, segment_value, column_name, diff_pct, 'numeric' as kind from num_ins
      union all select segment_type, segment_value, column_name, diff_pct, 'categorical' from cat_ins)""",
                                       INSIGHT_CTES))
oracle("service_adoption", with_views(f"""
select s.segment_type, s.segment_value, s.service, s.segment_adoption, o.overall_adoption from
 (select segment_type, segment_value, service, avg(y)*100.0 as segment_adoption from
   ({' union all '.join(f"select segment_type, segment_value, '{c}' as service, case when {c}='Yes' then 1.0 else 0.0 end as y from seg" for c in SERVICES)})
   group by all) s
 join (select service, avg(y)*100.0 as overall_adoption from
   ({' union all '.join(f"select '{c}' as service, case when {c}='Yes' then 1.0 else 0.0 end as y from analysis" for c in SERVICES)})
   group by all) o on o.service = s.service""", SEG_CTES))


def _dist_sql(attrs: list[tuple[str, str]]) -> str:
    seg_rows = " union all ".join(f"select segment_type, segment_value, '{a}' as attribute, cast({e} as varchar) as value "
                                  f"from seg" for a, e in attrs)
    all_rows = " union all ".join(f"select '{a}' as attribute, cast({e} as varchar) as value from analysis"
                                  for a, e in attrs)
    return f"""
select s.segment_type, s.segment_value, s.attribute, s.value, s.segment_pct, coalesce(o.overall_pct, 0.0) as overall_pct
from (select segment_type, segment_value, attribute, value,
        n * 100.0 / sum(n) over (partition by segment_type, segment_value, attribute) as segment_pct
      from (select segment_type, segment_value, attribute, value, count(*) as n from ({seg_rows})
            where value is not null group by all)) s
left join (select attribute, value, n * 100.0 / sum(n) over (partition by attribute) as overall_pct
      from (select attribute, value, count(*) as n from ({all_rows}) where value is not null group by all)) o
  on o.attribute = s.attribute and o.value = s.value"""


oracle("demographic_distribution", with_views(_dist_sql([
    ("gender", "gender"), ("senior_citizen", "case when senior_citizen=1 then 'Yes' when senior_citizen=0 then 'No' end"),
    ("partner", "partner"), ("dependents", "dependents")]), SEG_CTES))
oracle("tenure_distribution", with_views(_dist_sql([("tenure_group", _year_label_sql())]), SEG_CTES))
oracle("charge_histogram", with_views("""
select segment_type, segment_value, floor(monthly_charges/5.0)*5.0 as charge_bin, count(*) as customer_count
from seg group by all
union all select 'All Customers', 'All Customers', floor(monthly_charges/5.0)*5.0, count(*) from analysis group by 3""",
                                      SEG_CTES))
oracle("services_vs_charges", with_views("""
select total_services, floor(monthly_charges/5.0)*5.0 as charge_bin, churn_flag, count(*) as customer_count
from analysis group by all"""))
oracle("segment_values", with_views("""
select segment_type, segment_value, cast(row_number() over (partition by segment_type order by k) as integer) as position
from (select segment_type, segment_value, min(case when segment_type='Tenure Group' then lpad(cast(tenure_group as varchar), 4, '0')
      else segment_value end) as k from seg where segment_type <> 'Risk Level' group by all)
union all select * from (values ('Risk Level', 'High Risk', 1), ('Risk Level', 'Medium-High Risk', 2),
  ('Risk Level', 'Medium-Low Risk', 3), ('Risk Level', 'Low Risk', 4)) v(segment_type, segment_value, position)""",
                                    SEG_CTES))
oracle("churn_within_segment", with_views(f"""
select segment_type, segment_value, factor, factor_value, {RATE} from (
  select segment_type, segment_value, churn_flag, 'Contract' as factor, contract as factor_value from seg
  union all select segment_type, segment_value, churn_flag, 'InternetService', internet_service from seg
  union all select segment_type, segment_value, churn_flag, 'TenureGroup', {_year_label_sql()} from seg
  union all select segment_type, segment_value, churn_flag, 'PaymentMethod', payment_method from seg)
where factor_value is not null group by all""", SEG_CTES))

# ---------------------------------------------------------------- 2.7 windows
oracle("zip_customer_counts", with_views(
    "select customer_id, zip_code, count(*) over (partition by zip_code) as customers_in_zip from integrated"))


# ---------------------------------------------------------------- 2.9 retention
CATALOG_SQL = """
cat0 as (select * from (values
  ('High Risk', 'Contract Upgrade with Bonus', 100.0, 0.35, 'High Risk customers on month-to-month contracts'),
  ('High Risk', 'Service Bundle Upgrade', 120.0, 0.30, 'High Risk customers with fiber service but no protection'),
  ('High Risk', 'Premium Customer Service', 40.0, 0.25, 'High Risk customers with high monthly charges'),
  ('Medium-High Risk', 'Loyalty Rewards Program', 30.0, 0.25, 'Medium-High Risk customers with 12+ months tenure'),
  ('Medium-Low Risk', 'Service Review & Optimization', 10.0, 0.15, 'Medium-Low Risk customers with high bills'),
  ('Low Risk', 'Appreciation Communication', 2.0, 0.05, 'Low Risk customers with long tenure'))
  v(risk_segment, strategy, cost_per_customer, retention_rate, target_segment)),
cat as (select risk_segment, strategy, cast(cost_per_customer as double) as cost_per_customer,
  cast(retention_rate as double) as retention_rate, target_segment,
  case when lower(target_segment) like '%month-to-month%' then 'month_to_month'
       when lower(target_segment) like '%fiber%' then 'fiber'
       when lower(target_segment) like '%high%' and lower(target_segment) like '%charge%' then 'high_charge'
       when lower(target_segment) like '%12+%' or lower(target_segment) like '%tenure%' then 'tenure_12'
       else 'all' end as rule from cat0),
med as (select quantile_cont(monthly_charges, 0.5) as charge_threshold from analysis),
tgt as (select a.*, c.strategy, c.cost_per_customer, c.retention_rate, c.rule, m.charge_threshold
  from analysis a join cat c on c.risk_segment = a.risk_segment cross join med m
  where case c.rule when 'month_to_month' then a.contract = 'Month-to-month'
    when 'fiber' then a.internet_service = 'Fiber optic' when 'high_charge' then a.monthly_charges > m.charge_threshold
    when 'tenure_12' then a.tenure >= 12 else true end),
cmp as (select risk_segment, strategy, count(*) as target_customers,
  count(*) * cost_per_customer as total_cost,
  sum(monthly_charges*churn_probability)*12.0*retention_rate as revenue_saved,
  case when count(*) * cost_per_customer > 0 then
    (sum(monthly_charges*churn_probability)*12.0*retention_rate - count(*) * cost_per_customer)
    / (count(*) * cost_per_customer) else 0.0 end * 100.0 as roi_pct
  from tgt group by risk_segment, strategy, cost_per_customer, retention_rate)"""

oracle("retention_roi", with_views("""
select p.target, coalesce(g.n, 0) as customers_targeted, g.cm*100.0 as segment_churn_rate,
  cast(coalesce(g.n, 0) as double)*50.0 as intervention_cost, coalesce(g.rev, 0.0) as monthly_revenue,
  coalesce(g.risk, 0.0) as annual_revenue_at_risk, coalesce(g.risk, 0.0)*0.2 as potential_annual_revenue_saved,
  case when coalesce(g.n,0)*50.0 > 0 then (coalesce(g.risk,0.0)*0.2 - g.n*50.0)/(g.n*50.0) else 0.0 end as estimated_roi,
  case when coalesce(g.n,0)*50.0 > 0 then (coalesce(g.risk,0.0)*0.2 - g.n*50.0)/(g.n*50.0) else 0.0 end*100.0
    as estimated_roi_percent,
  g.clv as avg_customer_clv, g.clv*coalesce(g.n,0)*g.cm*0.2 as potential_clv_impact,
  case when coalesce(g.n,0)*50.0 > 0 then (g.clv*g.n*g.cm*0.2 - g.n*50.0)/(g.n*50.0) else 0.0 end as clv_roi,
  case when coalesce(g.n,0)*50.0 > 0 then (g.clv*g.n*g.cm*0.2 - g.n*50.0)/(g.n*50.0) else 0.0 end*100.0
    as clv_roi_percent
from (values ('All Customers'), ('Low Risk'), ('Medium-Low Risk'), ('Medium-High Risk'), ('High Risk')) p(target)
left join (select target, count(*) as n, sum(monthly_charges) as rev, avg(cast(churn_flag as double)) as cm,
    sum(monthly_charges*churn_probability)*12.0 as risk, avg(clv) as clv
  from (select 'All Customers' as target, * from analysis
        union all select risk_segment, * from analysis where risk_segment is not null) group by target) g
  on g.target = p.target"""))
oracle("strategy_catalog", with_views("""
select c.risk_segment, c.strategy, c.cost_per_customer, c.retention_rate, c.target_segment, c.rule,
  coalesce(s.n, 0) as segment_customers
from cat c left join (select risk_segment, count(*) as n from analysis group by 1) s on s.risk_segment = c.risk_segment""",
                                      CATALOG_SQL))
oracle("strategy_target_rules", with_views("""
select risk_segment, strategy, rule, charge_threshold, count(*) as targeted_customers from tgt group by all""",
                                           CATALOG_SQL))
oracle("strategy_targets", with_views("select customer_id, risk_segment, strategy from tgt", CATALOG_SQL))
oracle("segment_revenue", with_views("""
select l.risk_segment, coalesce(g.n, 0) as customers, coalesce(g.rev, 0.0) as monthly_revenue,
  coalesce(g.rev, 0.0)*12.0 as annual_revenue
from (values ('Low Risk'), ('Medium-Low Risk'), ('Medium-High Risk'), ('High Risk')) l(risk_segment)
left join (select risk_segment, count(*) as n, sum(monthly_charges) as rev from analysis group by 1) g
  on g.risk_segment = l.risk_segment"""))
oracle("strategy_comparison", with_views("select * from cmp where target_customers > 0 order by roi_pct desc, strategy",
                                         CATALOG_SQL))
oracle("top_strategies", with_views(
    "select * from cmp where target_customers > 0 order by roi_pct desc, strategy limit 5", CATALOG_SQL))

# ---------------------------------------------------------------- 2.10 experiments
_ALPHA = repr(1 - 95 / 100)
EXP_CTES = f"""
seg6 as (select * from (
  select 'All Customers' as segment_type, 'All Customers' as segment_value, * from analysis
  union all select 'Risk Level', risk_segment, * from analysis
  union all select 'Contract Type', contract, * from analysis
  union all select 'Internet Service', internet_service, * from analysis
  union all select 'Tenure Group', {_year_label_sql()}, * from analysis
  union all select 'Payment Method', payment_method, * from analysis) where segment_value is not null),
asg as (select *, row_number() over (partition by segment_type, segment_value
  order by round(churn_probability, 9), customer_id) - 1 as position from seg6),
asg2 as (select *, case when position % 2 = 0 then 'test' else 'control' end as arm from asg),
strat as (select sid, strategy, cast(cost_per_customer as double) as cost_per_customer,
  cast(base_retention_rate as double) as base_retention_rate,
  least(greatest(cast(base_retention_rate as double) * (1 + 0/100.0), 0.0), 1.0) as adjusted_rate
  from (values (0, 'Contract Upgrade Incentive', 100.0, 0.35), (1, 'Service Bundle Upgrade', 120.0, 0.30),
    (2, 'Premium Customer Service', 40.0, 0.25), (3, 'Loyalty Rewards Program', 30.0, 0.25),
    (4, 'Service Review & Optimization', 10.0, 0.15), (5, 'Appreciation Communication', 2.0, 0.05),
    (6, 'Custom Strategy', 50.0, 0.20)) v(sid, strategy, cost_per_customer, base_retention_rate)),
arms as (select segment_type, segment_value,
  cast(sum(case when arm='test' then 1 else 0 end) as bigint) as test_size,
  cast(sum(case when arm='control' then 1 else 0 end) as bigint) as control_size,
  avg(case when arm='test' then churn_probability end) as test_avg_churn_prob,
  avg(case when arm='control' then churn_probability end) as control_avg_churn_prob,
  avg(case when arm='test' then monthly_charges end) as test_avg_monthly_charges,
  avg(case when arm='control' then monthly_charges end) as control_avg_monthly_charges,
  cast(sum(case when arm='control' and churn_probability > 0.5 then 1 else 0 end) as bigint) as control_churns,
  cast(sum(case when arm='test' and churn_probability > 0.5 then 1 else 0 end) as bigint) as test_churns_baseline,
  cast(sum(cast(case when arm='test' then monthly_charges else 0.0 end as decimal(20,6))) as double) as monthly_revenue_test,
  avg(case when arm='test' then clv end) as test_clv,
  avg(cast(churn_flag as double))*100.0 as baseline_churn_rate
  from asg2 group by all),
treated as (select a.segment_type, a.segment_value, s.strategy,
  cast(sum(case when a.arm='test' and a.churn_probability*(1.0 - s.adjusted_rate) > 0.5 then 1 else 0 end) as bigint)
    as test_churns_treated
  from asg2 a cross join strat s group by all),
eff as (select a.*, s.*, t.test_churns_treated,
  case when a.control_size > 0 then cast(a.control_churns as double) / a.control_size * 100.0 end as control_churn_rate,
  cast(a.test_churns_baseline as double) / a.test_size * 100.0 as test_churn_rate_baseline,
  cast(t.test_churns_treated as double) / a.test_size * 100.0 as test_churn_rate_treated
  from arms a cross join strat s
  join treated t on t.segment_type = a.segment_type and t.segment_value = a.segment_value and t.strategy = s.strategy),
eff2 as (select *, test_churn_rate_baseline - test_churn_rate_treated as absolute_lift,
  case when test_churn_rate_baseline > 0 then (test_churn_rate_baseline - test_churn_rate_treated)
    / test_churn_rate_baseline * 100.0 else 0.0 end as relative_lift from eff),
fin0 as (select *, monthly_revenue_test * adjusted_rate * (test_churn_rate_baseline / 100.0) as monthly_revenue_saved,
  test_size * cost_per_customer as total_cost, test_clv * adjusted_rate as clv_saved_per_customer from eff2),
fin as (select *, monthly_revenue_saved*12.0 as annual_revenue_saved,
  monthly_revenue_saved * (90/30.0) as test_period_revenue_saved,
  clv_saved_per_customer * test_churns_baseline as total_clv_saved,
  (clv_saved_per_customer * test_churns_baseline - total_cost) / nullif(total_cost, 0) * 100.0 as clv_roi,
  case when total_cost > 0 then (monthly_revenue_saved*12.0 - total_cost) / total_cost * 100.0 else 0.0 end as roi,
  case when total_cost > 0 then (monthly_revenue_saved*(90/30.0) - total_cost) / total_cost * 100.0 else 0.0 end
    as test_period_roi from fin0),
zt0 as (select *, (cast(test_churns_treated + control_churns as double)) / (test_size + control_size) as pooled from fin),
zt1 as (select *, case when control_size > 0 then sqrt(pooled*(1.0-pooled)*(1.0/test_size + 1.0/control_size)) end as se
  from zt0),
zt as (select *, case when control_size > 0 and se > 0 then
    (cast(test_churns_treated as double)/test_size - cast(control_churns as double)/control_size) / se end as z_stat
  from zt1),
zp as (select *, case when z_stat is not null then {two_sided_p_sql('z_stat')} end as p_value from zt),
zs as (select *, case when p_value is not null then p_value < {_ALPHA}
  else absolute_lift > baseline_churn_rate * 0.1 end as is_significant from zp),
days as (select *, case when coalesce(p_value, 0.5) >= 0.5 then null when is_significant then 45.0
  else least(90.0 * pow(coalesce(p_value, 0.5) / {_ALPHA}, 2), 365.0) end as estimated_days_to_significance from zs),
months as (select * from range(1, 13) t(month)),
proj as (select f.segment_type, f.segment_value, f.strategy, cast(m.month as integer) as month,
  f.total_cost as cumulative_cost, f.monthly_revenue_saved * m.month as cumulative_savings,
  f.monthly_revenue_saved * m.month - f.total_cost as net_impact from fin f cross join months m),
rates as (select cast(r as double) as retention_rate from (values (0.1), (0.2), (0.30000000000000004), (0.4), (0.5), (0.6)) v(r)),
sens as (select f.segment_type, f.segment_value, f.strategy, r.retention_rate,
  case when f.total_cost > 0 then (f.monthly_revenue_test * r.retention_rate * (f.test_churn_rate_baseline/100.0) * 12.0
    - f.total_cost) / f.total_cost * 100.0 else 0.0 end as roi from fin f cross join rates r)"""
KEYS = "segment_type, segment_value, strategy"
EFFECT_COLS = (f"{KEYS}, test_size, control_size, control_churns, test_churns_baseline, test_churns_treated, "
               "control_churn_rate, test_churn_rate_baseline, test_churn_rate_treated, absolute_lift, relative_lift")
FIN_COLS = (f"{KEYS}, monthly_revenue_saved, annual_revenue_saved, test_period_revenue_saved, clv_saved_per_customer, "
            "total_clv_saved, total_cost, clv_roi, roi, test_period_roi")


def _x(body: str) -> str:
    return with_views(body, EXP_CTES)


oracle("experiment_sizes", _x("""
select segment_type, segment_value, count(*) as segment_size, cast(floor(count(*)*0.5) as bigint) as test_size,
  count(*) - cast(floor(count(*)*0.5) as bigint) as control_size from seg6 group by all"""))
oracle("assign_systematic", _x("select segment_type, segment_value, customer_id, position, arm from asg2"))
oracle("every_nth_row", with_views("""
select customer_id, risk_segment, position, position % 3 = 0 as is_test from
 (select customer_id, risk_segment, row_number() over (partition by risk_segment
   order by round(churn_probability, 9), customer_id) - 1 as position from scored_r where risk_segment is not null)"""))
oracle("group_balance", _x("""
select segment_type, segment_value, test_size, control_size, test_avg_churn_prob, control_avg_churn_prob,
  test_avg_monthly_charges, control_avg_monthly_charges,
  case when control_avg_churn_prob > 0 then (test_avg_churn_prob - control_avg_churn_prob) / control_avg_churn_prob
    * 100.0 else 0.0 end as churn_prob_diff_pct,
  case when control_avg_monthly_charges > 0 then (test_avg_monthly_charges - control_avg_monthly_charges)
    / control_avg_monthly_charges * 100.0 else 0.0 end as charges_diff_pct from arms"""))
oracle("experiment_baseline", _x("""
select segment_type, segment_value, avg(cast(churn_flag as double))*100.0 as baseline_churn_rate,
  avg(monthly_charges) as avg_monthly_charges, avg(clv) as baseline_clv, avg(churn_probability) as avg_churn_prob,
  count(*) as segment_size, avg(monthly_charges)*avg(churn_probability)*count(*) as monthly_revenue_at_risk
from seg6 group by all"""))
oracle("adjusted_rate", _x("""
select *, customers_at_risk * adjusted_rate as expected_retained from (
select g.segment_type, g.segment_value, s.strategy, cast(a.adj as integer) as effectiveness_adjustment,
  least(greatest(s.base_retention_rate * (1.0 + a.adj/100.0), 0.0), 1.0) as adjusted_rate, g.customers_at_risk
from (select segment_type, segment_value, cast(sum(case when churn_probability > 0.5 then 1 else 0 end) as bigint)
        as customers_at_risk from seg6 group by all) g cross join strat s
cross join (values (-50), (0), (50)) a(adj))"""))
oracle("treatment_effect", _x(f"select {EFFECT_COLS} from eff2"))
oracle("experiment_financials", _x(f"select {FIN_COLS} from fin"))
oracle("value_per_customer", _x(f"""
select {KEYS}, 'Cost Per Customer' as metric, cost_per_customer as amount from fin
union all select {KEYS}, 'Revenue Saved Per Customer', case when test_churns_baseline > 0
  then annual_revenue_saved / test_churns_baseline else 0.0 end from fin
union all select {KEYS}, 'CLV Saved Per Customer', clv_saved_per_customer from fin"""))
oracle("two_proportion_ztest", _x(f"select {KEYS}, z_stat, p_value, is_significant from zs"))
oracle("days_to_significance", _x(f"select {KEYS}, p_value, is_significant, estimated_days_to_significance from days"))
oracle("cumulative_projection", _x("select * from proj"))
oracle("impact_projection", _x("select *, 3 as test_end_month, month <= 3 as in_test_period from proj"))
oracle("breakeven_month", _x(f"""
select {KEYS}, min(case when net_impact > 0 then month end) as breakeven_month, 3 as test_end_month,
  min(case when net_impact > 0 then month end) <= 3 as breakeven_in_test from proj group by all"""))
oracle("retention_sensitivity", _x("select * from sens"))
oracle("sensitivity_breakeven_rate", _x(f"""
select s.segment_type, s.segment_value, s.strategy,
  case when f.test_churn_rate_baseline >= 0.01 and s.mn < 0 and s.mx > 0 then s.b end as breakeven_rate_pct
from (select {KEYS}, min(roi) as mn, max(roi) as mx,
    arg_min(case when cr then x1 + (x2 - x1) * (0.0 - y1) / (y2 - y1) end, case when cr then retention_rate end) as b
  from (select *, retention_rate*100.0 as x1, roi as y1,
      lead(retention_rate) over w * 100.0 as x2, lead(roi) over w as y2,
      (roi < 0 and lead(roi) over w > 0) or (roi > 0 and lead(roi) over w < 0) as cr
    from sens window w as (partition by {KEYS} order by retention_rate)) group by all) s
join fin f on f.segment_type = s.segment_type and f.segment_value = s.segment_value and f.strategy = s.strategy"""))
oracle("duration_sensitivity", _x(f"""
select {KEYS}, cast(d.duration_days as integer) as duration_days,
  case when total_cost > 0 then (monthly_revenue_saved * (d.duration_days / 30.0) - total_cost) / total_cost * 100.0
    else 0.0 end as test_period_roi
from fin cross join (values (30), (60), (90), (120), (150), (180)) d(duration_days)"""))
oracle("recommendation_tier", _x(f"""
select {KEYS}, roi, case when roi > 50 then 'Strong Recommendation' when roi > 20 then 'Recommended'
  when roi > 0 then 'Conditionally Recommended' else 'Not Recommended' end as recommendation from fin"""))
oracle("experiment_warnings", _x(f"""
select {KEYS}, w as warning from (
  select {KEYS}, case when test_period_roi <= 0 and roi > 0 then
    'Loses money during the test period, but the yearly ROI is positive.' end as w from days
  union all select {KEYS}, case when not is_significant then
    'Not statistically significant: use a larger sample or a longer test.' end from days
  union all select {KEYS}, case when not is_significant and estimated_days_to_significance is not null then
    'About ' || cast(cast(round(estimated_days_to_significance) as bigint) as varchar)
    || ' days of testing are needed for significance.' end from days
  union all select {KEYS}, case when relative_lift < 10 then 'Low relative lift' end from days) where w is not null"""))


# ---------------------------------------------------------------- 2.8 machine learning (SQL-expressible parts)
OHE = ["gender", "multiple_lines", "internet_service", *SERVICES, "contract", "payment_method"]
oracle("one_hot_encode", with_fixtures(" union all ".join(
    f"select customer_id, '{c}_' || {c} as dummy from base where {c} is not null and {c} > (select min({c}) from base)"
    for c in OHE)))
oracle("align_features", with_fixtures(" union all ".join(f"""
select '{c}_' || l.v as feature, cast(count(s.customer_id) as bigint) as customers
from (select distinct {c} as v from base where {c} is not null and {c} > (select min({c}) from base)) l
left join (select * replace (case when payment_method = 'Mailed check' then 'Prepaid' else contract end as contract)
  from base) s on s.{c} = l.v group by l.v""" for c in OHE)))
oracle("stratified_split", with_views("""
select customer_id, churn_flag, case when rn <= floor(n*0.2 + 0.5) then 'test' else 'train' end as split
from (select customer_id, churn_flag,
  row_number() over (partition by churn_flag order by md5('42|' || cast(customer_id as varchar)), customer_id) as rn,
  count(*) over (partition by churn_flag) as n from analysis)"""))
oracle("balanced_class_weight", with_views("""
select churn_flag, count(*) as class_count,
  cast((select count(*) from analysis) as double) / (2.0 * count(*)) as weight from analysis group by churn_flag"""))
oracle("roc_auc", with_views("""
select (sum(case when churn_flag = 1 then cast(rk as double) + (cast(c as double) - 1.0) / 2.0 end)
        - sum(cast(churn_flag as double)) * (sum(cast(churn_flag as double)) + 1.0) / 2.0)
       / nullif(sum(cast(churn_flag as double)) * (count(*) - sum(cast(churn_flag as double))), 0.0) as auc
from (select churn_flag, rank() over (order by churn_probability) as rk,
  count(*) over (partition by churn_probability) as c from analysis)"""))
oracle("classification_metrics", with_views("""
select cast(correct as double) / n as accuracy, precision, recall,
  coalesce(2.0 * precision * recall / nullif(precision + recall, 0.0), 0.0) as f1
from (select correct, n, coalesce(cast(tp as double) / nullif(tp + fp, 0), 0.0) as precision,
  coalesce(cast(tp as double) / nullif(tp + fn, 0), 0.0) as recall
from (select sum(case when churn_probability >= 0.5 and churn_flag = 1 then 1 else 0 end) as tp,
  sum(case when churn_probability >= 0.5 and churn_flag = 0 then 1 else 0 end) as fp,
  sum(case when churn_probability < 0.5 and churn_flag = 1 then 1 else 0 end) as fn,
  count(*) as n, sum(case when (churn_probability >= 0.5) = (churn_flag = 1) then 1 else 0 end) as correct
  from analysis))"""))
REPORT_CTES = """
c as (select cast(sum(case when churn_probability > 0.5 and churn_flag = 1 then 1 else 0 end) as double) as tp1,
  cast(sum(case when churn_probability > 0.5 and churn_flag = 0 then 1 else 0 end) as double) as fp1,
  cast(sum(case when churn_probability <= 0.5 and churn_flag = 1 then 1 else 0 end) as double) as fn1,
  cast(sum(case when churn_probability <= 0.5 and churn_flag = 0 then 1 else 0 end) as double) as tn1 from analysis),
k as (select coalesce(tn1/nullif(tn1+fn1, 0), 0.0) as p0, coalesce(tn1/nullif(tn1+fp1, 0), 0.0) as r0,
  coalesce(tp1/nullif(tp1+fp1, 0), 0.0) as p1, coalesce(tp1/nullif(tp1+fn1, 0), 0.0) as r1,
  tn1+fp1 as s0, tp1+fn1 as s1, (tp1+tn1)/nullif(tp1+tn1+fp1+fn1, 0) as acc from c),
f as (select *, coalesce(2.0*p0*r0/nullif(p0+r0, 0.0), 0.0) as f0, coalesce(2.0*p1*r1/nullif(p1+r1, 0.0), 0.0) as f1
  from k)"""
oracle("classification_report", with_views("""
select '0' as label, p0 as precision, r0 as recall, f0 as f1_score, s0 as support from f
union all select '1', p1, r1, f1, s1 from f
union all select 'accuracy', null, null, acc, s0 + s1 from f
union all select 'macro avg', (p0+p1)/2, (r0+r1)/2, (f0+f1)/2, s0 + s1 from f
union all select 'weighted avg', (p0*s0+p1*s1)/(s0+s1), (r0*s0+r1*s1)/(s0+s1), (f0*s0+f1*s1)/(s0+s1), s0 + s1 from f""",
                                            REPORT_CTES))
oracle("risk_factor_flags", with_views("""
select customer_id, 'Month-to-month contract' as risk_factor from analysis where contract = 'Month-to-month'
union all select customer_id, 'Customer tenure less than 1 year' from analysis where tenure < 12
union all select customer_id, 'Fiber optic without security or tech support' from analysis
  where internet_service = 'Fiber optic' and (online_security = 'No' or tech_support = 'No')
union all select customer_id, 'Payment by electronic check' from analysis where payment_method = 'Electronic check'
union all select customer_id, 'Low service adoption' from analysis where total_services <= 1 and internet_service <> 'No'
union all select customer_id, 'No major risk factor' from analysis where not coalesce(contract = 'Month-to-month', false)
  and not coalesce(tenure < 12, false) and not coalesce(internet_service = 'Fiber optic'
    and (online_security = 'No' or tech_support = 'No'), false) and not coalesce(payment_method = 'Electronic check', false)
  and not coalesce(total_services <= 1 and internet_service <> 'No', false)"""))
oracle("retention_recommendations", with_views("""
select customer_id, 'Offer contract upgrade incentives' as recommendation from analysis
  where churn_probability > 0.5 and contract = 'Month-to-month'
union all select customer_id, 'Promote online security services' from analysis
  where churn_probability > 0.5 and internet_service = 'Fiber optic' and online_security = 'No'
union all select customer_id, 'Offer complimentary tech support' from analysis
  where churn_probability > 0.5 and tech_support = 'No'
union all select customer_id, 'Bundle additional services at discount' from analysis
  where churn_probability > 0.5 and total_services <= 2
union all select customer_id, 'Regular satisfaction checks' from analysis where not (churn_probability > 0.5)
union all select customer_id, 'Loyalty rewards program' from analysis where not (churn_probability > 0.5)"""))
oracle("scoring_agreement", with_fixtures("select customer_id, true as same_score from base"))


# ---------------------------------------------------------------- sinks: the same rows read back
for _name, _same in (("write_primary", "engineer_additional_features"), ("write_primary_csv", "engineer_additional_features"),
                     ("write_engineered", "engineer_features"), ("write_churn_details", "churn_details"),
                     ("write_usage_metrics", "usage_metrics")):
    oracle(_name, ORACLES[_same])
oracle("write_geo", with_views("select customer_id, zip_code, city, latitude, longitude, population from integrated"))
oracle("write_reports", f"""
select 'churn_by_city' as report, city as key, churn_rate from ({ORACLES['churn_by_city']})
union all select 'churn_risk_factors', segment, churn_rate from ({ORACLES['churn_drivers']})""")
oracle("save_load_model", ORACLES["scoring_agreement"])

_NUMERIC_FEATURES = ["senior_citizen", "partner", "dependents", "tenure", "phone_service", "paperless_billing", "monthly_charges",
                     "total_charges", "total_services", "has_tech_support", "has_online_security", "streaming_services",
                     "clv", "avg_monthly_spend", "tenure_months", "tenure_group", "contract_risk_factor"]
_DUMMY_ROWS = " union all ".join(
    f"select {i} as i, '{c}' as c, {c} as v from base where {c} > (select min({c}) from base) group by {c}" for i, c in enumerate(OHE))
oracle("feature_columns", with_fixtures(" union all ".join(
    f"select cast({i} as integer) as position, '{c}' as feature" for i, c in enumerate(_NUMERIC_FEATURES)) + f"""
union all select cast({len(_NUMERIC_FEATURES)} + row_number() over (order by i, v) - 1 as integer), c || '_' || v
from ({_DUMMY_ROWS})"""))

# ---------------------------------------------------------------- trained models
from . import oracles_ml  # noqa: E402

POINT_RISK_SQL = """case when churn_probability < 0.25 then 'Low Risk' when churn_probability < 0.5 then 'Medium-Low Risk'
  when churn_probability < 0.75 then 'Medium-High Risk' else 'High Risk' end"""
ORACLES.update(oracles_ml.oracles(_NUMERIC_FEATURES, OHE, BASE_STRINGS, YES_NO, POINT_RISK_SQL))
ENHANCED_NUMBERS = 26
ENHANCED_STRINGS = ["gender", "partner", "dependents", "phone_service", "multiple_lines", "internet_service", *SERVICES, "contract",
                    "paperless_billing", "payment_method", "city"]
oracle("sparse_one_hot", oracles_ml.sparse_one_hot(ENHANCED_NUMBERS, ENHANCED_STRINGS))

# ---------------------------------------------------------------- many definitions, densities, checked reads, kept reports
DEFINITION_COLUMNS = ["gender", "contract", "internet_service", "payment_method", "senior_citizen", "tech_support"]
_LEVELS = ", ".join(f"l{i} as (select distinct cast({c} as varchar) as v from base where {c} is not null union all select null)"
                    for i, c in enumerate(DEFINITION_COLUMNS))
_DEFINITIONS = f"""{_LEVELS},
defs as (select {' || '.join(f"'|' || coalesce(l{i}.v, '*')" for i in range(len(DEFINITION_COLUMNS)))} as definition,
  {', '.join(f'l{i}.v as {c}' for i, c in enumerate(DEFINITION_COLUMNS))} from {', '.join(f'l{i}' for i in range(len(DEFINITION_COLUMNS)))})"""
_MEETS = " and ".join(f"(d.{c} is null or d.{c} = cast(b.{c} as varchar))" for c in DEFINITION_COLUMNS)
oracle("segment_definitions", with_fixtures(f"""
select definition, count(*) as customers, cast(sum(tenure) as bigint) as months from defs d join base b on {_MEETS} group by definition""", _DEFINITIONS))
oracle("definition_roi", with_views(f"""
select definition, coalesce(n, 0) as customers_targeted, coalesce(n, 0) * 50.0::double as intervention_cost, coalesce(rev, 0.0) as monthly_revenue,
  rate as segment_churn_rate, case when n > 0 then (risk * 0.2 - n * 50.0) / (n * 50.0) else 0.0 end as estimated_roi
from (select d.definition, count(b.customer_id) as n, sum(b.monthly_charges) as rev, avg(cast(b.churn_flag as double)) * 100.0 as rate,
    sum(b.monthly_charges * b.churn_probability) * 12.0 as risk
  from defs d left join analysis b on {_MEETS} group by d.definition)""", _DEFINITIONS))
DENSITY_CTES = SEG_CTES + """,
val as (select segment_type, segment_value, monthly_charges as v from seg
  union all select 'All Customers', 'All Customers', monthly_charges from analysis),
st0 as (select segment_type, segment_value, count(*) as n, min(v) as low, max(v) as high, stddev_samp(v) as s,
  quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as iqr from val group by all),
st1 as (select *, least(greatest(2.0 * iqr * pow(n, -1.0 / 3.0), (high - low) / sqrt(n) / 2), (high - low) / (log2(n) + 1.0)) as w from st0),
st as (select *, case when w > 0 then cast(ceil((high - low) / w) as bigint) else 1 end as bins, coalesce(s * pow(n, -0.2), 0.0) as h from st1)"""
oracle("charge_bins", with_views("""
select s.segment_type, s.segment_value, b as bin, low0 + b * width as low, low0 + (b + 1) * width as high,
  cast((select count(*) from val v where v.segment_type = s.segment_type and v.segment_value = s.segment_value
    and least(cast(floor((v.v - low0) / width) as bigint), bins - 1) = b) as bigint) as customer_count
from (select *, unnest(range(0, bins)) as b, case when high > low then low else low - 0.5 end as low0,
  case when high > low then (high - low) / bins else 1.0 end as width from st) s""", DENSITY_CTES))
oracle("charge_density", with_views("""
select g.segment_type, g.segment_value, g.cell, g.start + (g.cell + 0.5) * g.step as at,
  sum(m * exp(-0.5 * pow((g.cell - c.k) * g.step / g.h, 2))) / (g.n * g.h * sqrt(2.0 * pi())) as density
from (select *, low - 6.0 * h as start, (high - low + 12.0 * h) / 256 as step, unnest(range(0, 256)) as cell from st where h > 0) g
join (select v.segment_type, v.segment_value, cast(floor((v.v - (low - 6.0 * h)) / ((high - low + 12.0 * h) / 256)) as bigint) as k, count(*) as m
  from val v join st on v.segment_type = st.segment_type and v.segment_value = st.segment_value where h > 0 group by all) c
  on c.segment_type = g.segment_type and c.segment_value = g.segment_value
group by g.segment_type, g.segment_value, g.cell, g.start, g.step, g.n, g.h""", DENSITY_CTES))
oracle("read_checked", with_fixtures("""
select case when customer_id % 97 = 1 then 'short' when customer_id % 101 = 2 then 'long' when customer_id % 103 = 5 then 'quote'
  when customer_id % 107 = 3 then 'value:monthly_charges' else 'good' end as reason, count(*) as row_count, cast(sum(customer_id) as bigint) as ids
from base group by 1"""))
oracle("kept_reports", ORACLES["write_reports"])

# ---------------------------------------------------------------- stored sketches and bucketed tables
oracle("sketch_quantiles", """select column_name, p::double as p, true as within_error
from (values ('monthly_charges'), ('total_charges'), ('population'), ('avg_monthly_gb_download')) c(column_name), (values (0.25), (0.5), (0.75)) q(p)""")
oracle("integrate_bucketed", ORACLES["integrate_inner_join"])
