"""The fixture views as ANSI SQL, for the independent DuckDB oracles.

``with_fixtures(body, extra)`` prefixes a query with the four views as CTEs.  The
Spark side builds the same views with the DataFrame API (``fixtures.py``).
"""

SUBSCRIPTIONS_SQL = """
subscriptions as (
with li as (
  select l_orderkey, count(*) as n_lines, sum(l_quantity) as gb, avg(l_extendedprice)/1000.0 as ld,
    sum(case when l_returnflag='R' then 1 else 0 end) as refs,
    max(case when p_type='ECONOMY' then 1 else 0 end) as s1, max(case when p_type='SMALL' then 1 else 0 end) as s2,
    max(case when p_type='MEDIUM' then 1 else 0 end) as s3, max(case when p_type='PROMO' then 1 else 0 end) as s4,
    max(case when p_type='STANDARD' then 1 else 0 end) as s5, max(case when p_type='LARGE' then 1 else 0 end) as s6
  from lineitem join part on p_partkey = l_partkey group by l_orderkey),
b as (
  select o.*, c.c_nationkey, c.c_mktsegment, n.n_name, li.*,
    24020 - (year(o_orderdate)*12 + month(o_orderdate)) as ten,
    case when o_orderpriority in ('1-URGENT','2-HIGH') then 'Month-to-month' when o_orderpriority='3-MEDIUM' then 'One year' else 'Two year' end as ctr,
    case when c_mktsegment in ('AUTOMOBILE','BUILDING') then 'Fiber optic' when c_mktsegment in ('FURNITURE','HOUSEHOLD') then 'DSL' else 'No' end as inet
  from orders o join customer c on c_custkey=o_custkey join nation n on n_nationkey=c_nationkey left join li on l_orderkey=o_orderkey)
select o_orderkey as customer_id,
  case when o_custkey%2=0 then 'Male' else 'Female' end as gender,
  case when o_custkey%6=0 then 1 else 0 end as senior_citizen,
  case when o_orderkey%2=0 then 'Yes' else 'No' end as partner,
  case when o_custkey%3=0 then 'Yes' else 'No' end as dependents,
  ten as tenure,
  case when o_orderkey%10<>0 then 'Yes' else 'No' end as phone_service,
  case when o_orderkey%10=0 then 'No phone service' when o_custkey%5<2 then 'Yes' else 'No' end as multiple_lines,
  inet as internet_service,
  case when inet='No' then 'No internet service' when s1=1 then 'Yes' when s1=0 then 'No' end as online_security,
  case when inet='No' then 'No internet service' when s2=1 then 'Yes' when s2=0 then 'No' end as online_backup,
  case when inet='No' then 'No internet service' when s3=1 then 'Yes' when s3=0 then 'No' end as device_protection,
  case when inet='No' then 'No internet service' when s4=1 then 'Yes' when s4=0 then 'No' end as tech_support,
  case when inet='No' then 'No internet service' when s5=1 then 'Yes' when s5=0 then 'No' end as streaming_tv,
  case when inet='No' then 'No internet service' when s6=1 then 'Yes' when s6=0 then 'No' end as streaming_movies,
  ctr as contract,
  case when o_orderkey%5<3 then 'Yes' else 'No' end as paperless_billing,
  case o_orderkey%4 when 0 then 'Electronic check' when 1 then 'Mailed check' when 2 then 'Bank transfer (automatic)' else 'Credit card (automatic)' end as payment_method,
  o_totalprice/5000.0 + 18.0 as monthly_charges,
  case when ten=0 then ' ' when n_lines is null then 'n/a' else cast(o_totalprice as varchar) end as total_charges,
  case when (o_orderstatus='F' and ctr<>'Two year') or (o_orderstatus='P' and ctr='Month-to-month' and ten<=24) or (o_orderstatus='F' and ten<=12) then 'Yes' else 'No' end as churn,
  c_nationkey*100 + o_custkey%20 as zip_code, concat(n_name,'/',c_mktsegment) as city,
  cast(refs as bigint) as number_of_referrals, gb as avg_monthly_gb_download, ld as avg_monthly_long_distance_charges
from b)"""

CRM_SQL = """
crm as (
select customer_id, gender, zip_code, city, 30.0 + cast(zip_code as double)/1000.0 as latitude, -120.0 + cast(zip_code as double)/1000.0 as longitude,
  number_of_referrals, avg_monthly_gb_download, avg_monthly_long_distance_charges,
  avg_monthly_long_distance_charges*tenure as total_long_distance_charges,
  cast(case when customer_id%4=0 then 10 else 0 end as double) as total_extra_data_charges,
  case when churn='Yes' then 'Churned' when tenure<=3 then 'Joined' else 'Stayed' end as customer_status,
  case when churn='Yes' then case customer_id%3 when 0 then 'Competitor' when 1 then 'Price' else 'Attitude' end end as churn_category,
  case when churn='Yes' then concat('reason ', cast(customer_id%5 as varchar)) end as churn_reason
from subscriptions)"""

ZIP_SQL = """
zip_population as (
select distinct zip_code, 1000 + (zip_code*7919)%50000 as population from subscriptions)"""

SCORED_SQL = """
scored as (
select s.*, case when churn='Yes' then 1 else 0 end as churn_flag,
  1.0/(1.0+exp(-(-1.0 + 0.9*(case contract when 'Month-to-month' then 2 when 'One year' then 1 else 0 end)
    - 0.03*tenure + 0.02*(monthly_charges-65.0)))) as churn_probability
from subscriptions s)"""

BASE_SQL = """
base as (
select customer_id, gender, senior_citizen, partner, dependents, tenure, phone_service, multiple_lines,
  internet_service, online_security, online_backup, device_protection, tech_support, streaming_tv,
  streaming_movies, contract, paperless_billing, payment_method, monthly_charges, total_charges, churn
from subscriptions)"""

FIXTURE_CTES = ",".join([SUBSCRIPTIONS_SQL, CRM_SQL, ZIP_SQL, SCORED_SQL, BASE_SQL])


def with_fixtures(body: str, extra_ctes: str = "") -> str:
    """``WITH <fixtures>[, <extra>] <body>``."""
    ctes = FIXTURE_CTES + ("," + extra_ctes if extra_ctes.strip() else "")
    return f"with {ctes}\n{body}"


def _services_count(prefix: str = "") -> str:
    cols = ["online_security", "online_backup", "device_protection", "tech_support", "streaming_tv",
            "streaming_movies"]
    return " + ".join(f"(case when {prefix}{c} in ('No','No internet service') then 0 else 1 end)" for c in cols)


def _mode(col: str, table: str) -> str:
    return f"(select {col} from {table} where {col} is not null group by {col} order by count(*) desc, {col} limit 1)"


TENURE_CODE_SQL = ("case when tenure is null or tenure<=0 then null when tenure<=12 then 0 when tenure<=24 then 1 "
                   "when tenure<=36 then 2 when tenure<=48 then 3 when tenure<=60 then 4 else 5 end")
RISK_SQL = ("case when churn_probability is null or churn_probability<=0 then null "
            "when churn_probability<=0.25 then 'Low Risk' when churn_probability<=0.5 then 'Medium-Low Risk' "
            "when churn_probability<=0.75 then 'Medium-High Risk' when churn_probability<=1.0 then 'High Risk' end")
PROB_SQL = ("1.0/(1.0+exp(-(-1.0 + 0.9*(case contract when 'Month-to-month' then 2 when 'One year' then 1 else 0 end)"
            " - 0.03*tenure + 0.02*(monthly_charges-65.0))))")

_ZERO_FILLED = ["number_of_referrals", "avg_monthly_gb_download", "avg_monthly_long_distance_charges",
                "total_long_distance_charges", "total_extra_data_charges", "latitude", "longitude", "population",
                "population_density", "customers_in_zip", "zip_penetration_rate", "tenure_group",
                "contract_risk_factor", "clv", "avg_monthly_spend", "monthly_charges", "tenure", "senior_citizen",
                "zip_code", "total_charges"]
_MODE_FILLED = ["online_security", "online_backup", "device_protection", "tech_support", "streaming_tv",
                "streaming_movies", "churn_category", "churn_reason", "city", "customer_status"]

INTEGRATED_SQL = """
integrated as (
select b.*, c.zip_code, c.city, c.latitude, c.longitude, c.number_of_referrals, c.avg_monthly_gb_download,
  c.avg_monthly_long_distance_charges, c.total_long_distance_charges, c.total_extra_data_charges,
  c.customer_status, c.churn_category, c.churn_reason, z.population,
  cast(z.population as double)/10.0 as population_density
from base b join crm c on c.customer_id = b.customer_id left join zip_population z on z.zip_code = c.zip_code)"""

ENGINEERED_SQL = f"""
eng0 as (
select i.* replace (coalesce(try_cast(trim(i.total_charges) as double), 0.0) as total_charges),
  {_services_count('i.')} as total_services,
  case when i.tech_support='Yes' then 1 else 0 end as has_tech_support,
  case when i.online_security='Yes' then 1 else 0 end as has_online_security,
  case when i.streaming_tv='Yes' and i.streaming_movies='Yes' then 1 else 0 end as streaming_services,
  i.tenure*i.monthly_charges as clv,
  coalesce(try_cast(trim(i.total_charges) as double), 0.0) / (case when i.tenure=0 then 1 else i.tenure end)
    as avg_monthly_spend,
  zc.customers_in_zip,
  case when i.population = 0 then null else cast(zc.customers_in_zip as double) / cast(i.population as double) end as zip_penetration_rate,
  cast(coalesce(i.number_of_referrals > 0, false) as integer) as has_referrals,
  i.tenure as tenure_months,
  {TENURE_CODE_SQL.replace('tenure', 'i.tenure')} as tenure_group,
  case i.contract when 'Month-to-month' then 2 when 'One year' then 1 when 'Two year' then 0
    when 'Monthly' then 2 when 'One Year' then 1 when 'Two Year' then 0 end as contract_risk_factor
from integrated i left join (select zip_code, count(*) as customers_in_zip from integrated
  where zip_code is not null group by zip_code) zc on zc.zip_code = i.zip_code),
eng1 as (
select * replace ({', '.join(f'coalesce({c}, 0) as {c}' for c in _ZERO_FILLED)}) from eng0),
engineered as (
select * replace ({', '.join(f"coalesce({c}, {_mode(c, 'eng1')}, 'Unknown') as {c}" for c in _MODE_FILLED)})
from eng1)"""

ANALYSIS_SQL = f"""
analysis0 as (
select e.*, coalesce(case when churn='Yes' then 1 when churn='No' then 0 end,
  try_cast(try_cast(churn as double) as integer), 0) as churn_flag, {PROB_SQL} as churn_probability
from engineered e),
analysis as (select *, {RISK_SQL} as risk_segment from analysis0)"""

SCORED_RISK_SQL = f"""
scored_r as (select *, {RISK_SQL} as risk_segment from scored)"""

DERIVED_CTES = ",".join([INTEGRATED_SQL, ENGINEERED_SQL, ANALYSIS_SQL, SCORED_RISK_SQL])


def with_views(body: str, extra_ctes: str = "") -> str:
    """Fixtures plus the derived views ``integrated``, ``engineered``, ``analysis``, ``scored_r``."""
    return with_fixtures(body, DERIVED_CTES + ("," + extra_ctes if extra_ctes.strip() else ""))
