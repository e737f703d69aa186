"""DuckDB SQL of the trained models, from the raw tables alone.

The logistic model is fitted again in SQL: features in long form, Newton steps as a chain of CTEs, each solved by
Gauss-Jordan elimination on one row that holds the matrix as lists.  Nothing of the engine's fit goes in.
"""

from __future__ import annotations

from .sources.fixture_sql import RISK_SQL, TENURE_CODE_SQL, _mode, _services_count, with_fixtures, with_views

STEPS = 10
C = 0.8


def prepared(source: str, to: str, strings: list[str], yes_no: list[str]) -> str:
    """CTEs ``to`` (and its steps): the raw table ``source`` cleaned, filled and with the base features."""
    a = f"{to}_"
    return f"""
{a}1 as (select * replace (case when try_cast(trim(total_charges) as double) is null and tenure=0 then 0.0
  else try_cast(trim(total_charges) as double) end as total_charges) from {source}),
{a}2 as (select * replace (coalesce(total_charges, (select avg(total_charges) from {a}1)) as total_charges,
  coalesce(monthly_charges, (select avg(monthly_charges) from {a}1)) as monthly_charges) from {a}1),
{a}3 as (select * replace ({', '.join(f'coalesce({c}, {_mode(c, f"{a}2")}) as {c}' for c in strings)}) from {a}2),
{a}4 as (select * replace ({', '.join(f"case {c} when 'Yes' then 1 when 'No' then 0 end as {c}" for c in yes_no)}) from {a}3),
{to} as (select * replace (coalesce(tenure_group, 0) as tenure_group, coalesce(contract_risk_factor, 0) as contract_risk_factor)
from (select *, {_services_count()} as total_services,
  case when tech_support='Yes' then 1 else 0 end as has_tech_support,
  case when online_security='Yes' then 1 else 0 end as has_online_security,
  case when streaming_tv='Yes' and streaming_movies='Yes' then 1 else 0 end as streaming_services,
  coalesce(tenure*monthly_charges, 0.0) as clv,
  coalesce(total_charges / (case when tenure=0 then 1 else tenure end), 0.0) as avg_monthly_spend,
  tenure as tenure_months, {TENURE_CODE_SQL} as tenure_group,
  case contract when 'Month-to-month' then 2 when 'One year' then 1 when 'Two year' then 0 end as contract_risk_factor
  from {a}4))"""


def _long(table: str, numeric: list[str], strings: list[str]) -> str:
    """(customer_id, j, v): every number, unscaled, and a 1 for each level that has a feature."""
    numbers = " union all ".join(f"select customer_id, {j} as j, cast({c} as double) as v from {table}" for j, c in enumerate(numeric))
    levels = " union all ".join(f"select t.customer_id, d.j, 1.0::double from {table} t join dict d on d.c = {i} and d.v = t.{c}"
                                for i, c in enumerate(strings))
    return f"{numbers} union all {levels}"


def design_ctes(numeric: list[str], strings: list[str], base_strings: list[str], yes_no: list[str]) -> str:
    """``customers`` (features, label, split), ``dict`` (c, v, j, name), ``x`` (customer_id, j, v) of all customers."""
    levels = " union all ".join(f"select {i} as c, '{c}' as name, {c} as v from customers group by {c}" for i, c in enumerate(strings))
    return prepared("base", "features", base_strings, yes_no) + f""",
customers as (select *, churn as y, case when row_number() over (partition by churn order by md5('42|' || cast(customer_id as varchar)),
    customer_id) <= floor(count(*) over (partition by churn) * 0.2 + 0.5) then 'test' else 'train' end as split from features),
dict as (select c, v, name, {len(numeric)} + row_number() over (order by c, v) - 1 as j
  from (select *, row_number() over (partition by c order by v) as nth from ({levels}) where v is not null) where nth > 1),
x as materialized ({_long('customers', numeric, strings)})"""


def fit_ctes(numeric: list[str]) -> str:
    """``fitted`` (j, coefficient of the unscaled feature; -1: intercept) and ``certificate`` (j, mean gradient)."""
    p = len(numeric)
    out = f""",
label as materialized (select customer_id, cast(y as double) as y, (select count(*) from customers where split = 'train')
    / (2.0 * count(*) over (partition by y)) as w from customers where split = 'train'),
scale as materialized (select j, m, case when s > 1e-12 * greatest(1.0, abs(m)) then s else 1.0 end as s from (
  select j, avg(v) as m, stddev_pop(v) as s from x semi join label using (customer_id) where j < {p} group by j)),
z as materialized (select customer_id, x.j, case when x.j < {p} then (v - m) / s else v end as v
    from x semi join label using (customer_id) left join scale using (j)
  union all select customer_id, -1, 1.0 from label),
pen as materialized (select j, case when j < 0 then 0.0 else 1.0 / ({C} * coalesce(s * s, 1.0)) end as pen, row_number() over (order by j) as i
  from (select distinct j from z) left join scale using (j)),
b0 as (select j, 0.0::double as b from pen)"""
    for k in range(STEPS):
        out += f""",
q{k} as materialized (select customer_id, any_value(w) as w, any_value(y) as y, 1.0 / (1.0 + exp(-sum(v * b))) as q
  from z join b{k} using (j) join label using (customer_id) group by customer_id),
g{k} as materialized (select j, sum(v * w * (q - y)) + any_value(pen * b) as g from z join q{k} using (customer_id) join pen using (j)
  join b{k} using (j) group by j),
h{k} as materialized (select a.j as j, c.j as l, sum(a.v * c.v * w * q * (1 - q)) as h
  from z a join z c using (customer_id) join q{k} using (customer_id) group by 1, 2),
m{k} as materialized (select list(row_ order by i) as m, count(*) as n from (
  select p.i, list_append(list(coalesce(h, 0.0) + case when p.j = c.j then p.pen else 0.0 end order by c.i), any_value(-g)) as row_
  from pen p cross join pen c left join h{k} on h{k}.j = p.j and h{k}.l = c.j join g{k} on g{k}.j = p.j group by p.i)),
s{k} as (select 1 as k, m, n from m{k} union all
  select k + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j:
    case when i = k then v / m[k][k] else v - r[k] * m[k][j] / m[k][k] end)), n from s{k} where k <= n),
b{k + 1} as materialized (select pen.j, b{k}.b + d.m[pen.i][d.n + 1] as b from pen join b{k} using (j) cross join (select m, n from s{k} where k = n + 1) d)"""
    return out + f""",
fitted as materialized (select b.j, b.b / coalesce(s, 1.0) as coefficient from b{STEPS} b left join scale using (j) where b.j >= 0
  union all select -1, any_value(i.b) - sum(b.b / s * m) from b{STEPS} b join scale using (j), (select b from b{STEPS} where j = -1) i),
certificate as (select j, g / coalesce(s, 1.0) / (select sum(w) from label) as gradient from g{STEPS - 1} left join scale using (j))"""


def scored(customers: str, x: str) -> str:
    """(customer_id, churn_probability) of the customers in ``x``."""
    return (f"select customer_id, 1.0 / (1.0 + exp(-(any_value(f0.coefficient) + sum(v * f.coefficient)))) as churn_probability "
            f"from {x} join fitted f using (j), (select coefficient from fitted where j = -1) f0 group by customer_id")


def _auc(split: str) -> str:
    return f"""(select (sum(case when y = 1 then cast(rk as double) + (cast(c as double) - 1.0) / 2.0 end)
    - sum(y) * (sum(y) + 1.0) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0.0)
  from (select cast(y as double) as y, rank() over (order by round(churn_probability, 9)) as rk,
    count(*) over (partition by round(churn_probability, 9)) as c
    from customers join scores using (customer_id) where split = '{split}'))"""


def oracles(numeric: list[str], strings: list[str], base_strings: list[str], yes_no: list[str], score_bands: str) -> dict[str, str]:
    design = design_ctes(numeric, strings, base_strings, yes_no)
    fit = design + fit_ctes(numeric)
    scores = f", scores as materialized ({scored('customers', 'x')})"
    names = " union all ".join(f"select {j} as j, '{c}' as feature" for j, c in enumerate(numeric)) + " union all select -1, '(intercept)'"
    names = f"({names} union all select j, name || '_' || v from dict)"
    new = fit + f""",
new_base as (select * replace (cast(monthly_charges * tenure as varchar) as total_charges) from base),""" + \
        prepared("new_base", "new_features", base_strings, yes_no) + f""",
new_x as materialized ({_long('new_features', numeric, strings)}),
scores as materialized ({scored('new_features', 'new_x')})"""

    def recursive(body: str, ctes: str) -> str:
        return with_fixtures(body, ctes).replace("with ", "with recursive ", 1)

    edges = f""",
train as materialized (select x.* from x join customers using (customer_id) where split = 'train'),
total as (select sum(0.5 - y) as tg, 0.25 * count(*) as th, count(*) as n from customers where split = 'train'),
cum as (select j, v, sum(count(*)) over (partition by j order by v) as upto, count(*) as here, sum(sum(0.5 - y)) over (partition by j order by v) as lg
  from train join customers using (customer_id) where j < {len(numeric)} group by j, v),
splits as (select j, v as split_value, lg, 0.25 * upto as lh from cum, total where upto < n
    and floor(upto * 64 / n) > floor((upto - here) * 64 / n)
  union all select j, null, any_value(tg) - sum(0.5 - y), any_value(th) - 0.25 * count(*) from train join customers using (customer_id), total
    where j >= {len(numeric)} group by j)"""
    return {
        "logistic_coefficients": recursive(f"""select feature, coefficient, coalesce(abs(gradient) < 1e-6, true) as gradient_is_zero
from fitted join {names} using (j) left join certificate using (j)""", fit),
        "train_logistic": recursive(f"select 'logistic_regression' as model, {_auc('train')} as train_auc, {_auc('test')} as test_auc",
                                    fit + scores),
        "score_churn": recursive(f"select customer_id, churn_probability, {RISK_SQL} as risk_segment from scores", fit + scores),
        "batch_customer_scoring": recursive(f"select customer_id, churn_probability, {score_bands} as risk_category from scores", new),
        "boosted_first_splits": with_fixtures(f"""select feature, split_value, cast(lg as double) as left_gradient, cast(lh as double) as left_hessian,
  (lg * lg / (lh + 1.0) + (tg - lg) * (tg - lg) / (th - lh + 1.0) - tg * tg / (th + 1.0)) / 2 as gain
from splits join {names} using (j), total""", design + edges),
    }


def sparse_one_hot(numeric: int, strings: list[str]) -> str:
    """(customer_id, feature) of the integrated table's levels; the first level of each column has none."""
    levels = " union all ".join(f"select {i} as c, {c} as v from engineered where {c} is not null group by {c}" for i, c in enumerate(strings))
    found = " union all ".join(f"select customer_id, {i} as c, {c} as v from engineered" for i, c in enumerate(strings))
    return with_views(f"""select customer_id, cast(feature as bigint) as feature from ({found}) join (
  select c, v, {numeric} + row_number() over (order by c, v) - 1 as feature
  from (select *, row_number() over (partition by c order by v) as nth from ({levels})) where nth > 1) using (c, v)""")
