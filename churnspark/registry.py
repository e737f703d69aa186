"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator key of
SURVEY §2.  Each reads the test tables (through the fixture views) in full."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clean, features, integrate
from .plans.lineage import materialize
from .plans.partitions import ROWS_PER_TASK
from .sources import fixtures, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def base(spark, sf):
    return fixtures.base_subscriptions(spark, sf)


# ---------------------------------------------------------------- 2.1 sources
def _csv_export(spark, sf, name, df):
    """Write a Spark-derived table as a CSV export in the shared folder (once per session)."""
    from .plans.session import table_path as _tp
    from .sources import io
    key = (spark.sparkContext.applicationId, f"csv_{name}", sf)
    if key not in _CSV:
        path = _tp(spark, f"csv_{name}_{fixtures.tag(spark, sf)}")
        io.write_csv(df, path)
        _CSV[key] = path
    return _CSV[key]


_CSV: dict = {}


@query("read_subscriptions")
def q_read_subscriptions(spark, sf):
    from .sources import io
    return io.read_subscriptions(spark, _csv_export(spark, sf, "subscriptions", base(spark, sf)))


@query("read_all_sources")
def q_read_all_sources(spark, sf):
    from .sources import io
    subs = fixtures.subscriptions(spark, sf)
    parts = [("subscriptions", io.read_subscriptions(spark, _csv_export(spark, sf, "subscriptions", base(spark, sf)))),
             ("crm", clean.standardize_crm(io.read_crm(spark, _csv_export(spark, sf, "crm",
                                                                        fixtures.raw_crm(spark, sf, subs))))),
             ("zip_population", io.read_zip_population(spark, _csv_export(
                 spark, sf, "zip", fixtures.zip_population(spark, sf, subs).withColumnsRenamed(
                     {"zip_code": "Zip Code", "population": "Population"}))))]
    from .plans.session import table_path as _tp
    path = _tp(spark, f"dictionary_{fixtures.tag(spark, sf)}")
    io.write_data_dictionary(io.data_dictionary(spark, {name: df.schema for name, df in parts}), path)
    parts.append(("data_dictionary", io.read_data_dictionary(spark, path).where(F.col("Description").contains("–"))))
    out = None
    for name, df in parts:
        c = df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("row_count"),
                   F.lit(len(df.columns)).alias("column_count"))
        out = c if out is None else out.unionByName(c)
    return out


@query("read_enhanced")
def q_read_enhanced(spark, sf):
    # the integrated table written without its target column: the reader derives it
    from .plans.session import table_path as _tp
    from .sources import io
    path = _tp(spark, f"enhanced_{fixtures.tag(spark, sf)}")
    io.write_table(views.integrated(spark, sf).drop("churn"), path)
    return io.read_enhanced(spark, path).select("customer_id", "customer_status", "churn")


# ---------------------------------------------------------------- 2.2 cleaning
@query("coerce_total_charges")
def q_coerce(spark, sf):
    return base(spark, sf).transform(clean.coerce_total_charges).select("customer_id", "tenure", "total_charges")


@query("zero_new_customer_charges")
def q_zero_new(spark, sf):
    return (base(spark, sf).transform(clean.coerce_total_charges).transform(clean.zero_new_customer_charges)
            .select("customer_id", "tenure", "total_charges"))


@query("mean_impute")
def q_mean_impute(spark, sf):
    return (base(spark, sf).transform(clean.coerce_total_charges).transform(clean.zero_new_customer_charges)
            .transform(clean.mean_impute).select("customer_id", "monthly_charges", "total_charges"))


@query("mode_impute")
def q_mode_impute(spark, sf):
    return base(spark, sf).transform(clean.mode_impute).select("customer_id", *features.SERVICES)


@query("zero_fill")
def q_zero_fill(spark, sf):
    df = fixtures.subscriptions(spark, sf).select("customer_id", "number_of_referrals", "avg_monthly_gb_download",
                                                  "avg_monthly_long_distance_charges")
    return df.transform(clean.zero_fill)


@query("encode_yes_no")
def q_encode(spark, sf):
    return base(spark, sf).transform(clean.encode_yes_no).select("customer_id", *clean.YES_NO_COLUMNS)


@query("normalize_churn")
def q_normalize(spark, sf):
    return base(spark, sf).transform(clean.normalize_churn).select("customer_id", "churn", "churn_flag")


@query("target_from_status")
def q_target(spark, sf):
    return (fixtures.crm(spark, sf).transform(clean.target_from_status)
            .select("customer_id", "customer_status", "churn"))


@query("null_profile")
def q_null_profile(spark, sf):
    return clean.null_profile(fixtures.subscriptions(spark, sf))


@query("drop_identifier_columns")
def q_drop_ids(spark, sf):
    return base(spark, sf).transform(clean.drop_identifier_columns)


@query("standardize_crm")
def q_standardize(spark, sf):
    return clean.standardize_crm(fixtures.raw_crm(spark, sf))


@query("churn_details")
def q_churn_details(spark, sf):
    return clean.churn_details(fixtures.crm(spark, sf))


@query("usage_metrics")
def q_usage_metrics(spark, sf):
    return clean.usage_metrics(fixtures.crm(spark, sf))


SEGMENT_DEFINITION = {"contract": "Month-to-month", "internet_service": "Fiber optic", "not_a_column": "x"}


@query("segment_filter")
def q_segment_filter(spark, sf):
    return (base(spark, sf).transform(lambda d: clean.segment_filter(d, SEGMENT_DEFINITION))
            .select("customer_id", "contract", "internet_service", "monthly_charges"))


@query("preprocess")
def q_preprocess(spark, sf):
    return base(spark, sf).transform(clean.preprocess)


# ---------------------------------------------------------------- 2.3 joins
@query("common_customers")
def q_common(spark, sf):
    subs = fixtures.subscriptions(spark, sf)
    return integrate.common_customers(subs.select("customer_id"), fixtures.established(fixtures.crm(spark, sf, subs)))


@query("integrate_inner_join")
def q_integrate(spark, sf):
    subs = fixtures.subscriptions(spark, sf)
    return integrate.integrate_inner_join(subs.select(*fixtures.SUBSCRIPTION_COLUMNS),
                                          fixtures.established(fixtures.crm(spark, sf, subs)))


@query("join_zip_population")
def q_join_zip(spark, sf):
    subs = fixtures.subscriptions(spark, sf)
    crm = fixtures.crm(spark, sf, subs)
    return integrate.join_zip_population(crm, fixtures.surveyed(fixtures.zip_population(spark, sf, subs))).select(
        "customer_id", "zip_code", "latitude", "longitude", "population", "population_density")


# ---------------------------------------------------------------- 2.4 features
@query("service_features")
def q_service(spark, sf):
    return base(spark, sf).transform(features.service_features).select(
        "customer_id", "total_services", "has_tech_support", "has_online_security", "streaming_services")


@query("financial_features")
def q_financial(spark, sf):
    return (base(spark, sf).transform(clean.preprocess).transform(features.financial_features)
            .select("customer_id", "clv", "avg_monthly_spend"))


@query("tenure_contract_features")
def q_tenure_contract(spark, sf):
    return base(spark, sf).transform(features.tenure_contract_features).select(
        "customer_id", "tenure_months", "tenure_group", "contract_risk_factor")


@query("contract_risk_two_vocab")
def q_two_vocab(spark, sf):
    # the CRM-style vocabulary in a ``contract_type`` column next to the base one
    df = base(spark, sf).select(
        "customer_id",
        F.when(F.col("contract") == "Month-to-month", "Monthly").when(F.col("contract") == "One year", "One Year")
         .otherwise("Two Year").alias("contract_type"))
    return df.transform(features.contract_risk_two_vocab)


@query("geo_features")
def q_geo(spark, sf):
    return views.integrated(spark, sf).transform(features.geo_features).select(
        "customer_id", "zip_code", "customers_in_zip", "zip_penetration_rate")


@query("has_referrals")
def q_has_referrals(spark, sf):
    return fixtures.crm(spark, sf).transform(features.has_referrals).select(
        "customer_id", "number_of_referrals", "has_referrals")


@query("engineer_features")
def q_engineer(spark, sf):
    return features.prepare_customers(base(spark, sf))


@query("engineer_additional_features")
def q_engineer_additional(spark, sf):
    return views.engineered(spark, sf)


@query("revenue_per_service")
def q_rps(spark, sf):
    return (base(spark, sf).transform(features.service_features).transform(features.revenue_per_service)
            .select("customer_id", "total_services", "monthly_charges", "revenue_per_service"))


@query("clamp_probability")
def q_clamp(spark, sf):
    # a shifted score that leaves [0, 1] on both sides
    df = fixtures.scored(spark, sf).select("customer_id", (F.col("churn_probability") * 1.5 - 0.25)
                                           .alias("churn_probability"))
    return df.transform(features.clamp_probability)


# ---------------------------------------------------------------- 2.5 binning
from .functions import bins as B  # noqa: E402
from .operators import binning, reports, segments  # noqa: E402


@query("tenure_code")
def q_tenure_code(spark, sf):
    return base(spark, sf).select("customer_id", "tenure", B.tenure_code("tenure").alias("tenure_code"))


@query("tenure_labels")
def q_tenure_labels(spark, sf):
    return base(spark, sf).select("customer_id", "tenure", B.tenure_label("tenure").alias("tenure_label"))


@query("tenure_year_labels")
def q_tenure_year_labels(spark, sf):
    return views.analysis(spark, sf).select("customer_id", "tenure_group",
                                            B.tenure_year_label("tenure_group").alias("tenure_year_label"))


@query("tenure_bounded_labels")
def q_tenure_bounded(spark, sf):
    return base(spark, sf).select("customer_id", "tenure", B.tenure_bounded_label("tenure").alias("tenure_bounded"))


@query("referral_bins")
def q_referral_bins(spark, sf):
    return fixtures.crm(spark, sf).select("customer_id", "number_of_referrals",
                                          B.referral_bin("number_of_referrals").alias("referral_group"))


@query("risk_segment")
def q_risk_segment(spark, sf):
    return views.scored(spark, sf).select("customer_id", "churn_probability", "risk_segment")


@query("risk_category_point")
def q_risk_point(spark, sf):
    return fixtures.scored(spark, sf).select("customer_id", "churn_probability",
                                             B.risk_category_point("churn_probability").alias("risk_category"))


@query("population_quartiles")
def q_population_quartiles(spark, sf):
    return binning.population_quartiles(views.analysis(spark, sf)).select("customer_id", "population",
                                                                          "population_segment")


@query("usage_group")
def q_usage_group(spark, sf):
    return binning.usage_group(views.analysis(spark, sf))


@query("equal_width_bins")
def q_equal_width(spark, sf):
    return binning.equal_width_bins(base(spark, sf), "monthly_charges", "charge_group").select(
        "customer_id", "monthly_charges", "charge_group")


# ---------------------------------------------------------------- 2.6 reports
def A(spark, sf):
    return views.analysis(spark, sf)


for _name, _fn in [
    ("churn_by_dimension", reports.churn_by_dimension), ("churn_by_city", reports.churn_by_city),
    ("top_churn_cities", reports.top_churn_cities), ("bottom_churn_cities", reports.bottom_churn_cities),
    ("churn_by_population", reports.churn_by_population), ("churn_by_usage", reports.churn_by_usage),
    ("service_efficiency", reports.service_efficiency), ("churn_by_tenure", reports.churn_by_tenure),
    ("churn_by_referrals", reports.churn_by_referrals), ("churn_by_contract", reports.churn_by_contract),
    ("financial_summary", reports.financial_summary), ("revenue_metrics", reports.revenue_metrics),
    ("risk_segment_summary", reports.risk_segment_summary), ("churn_drivers", reports.churn_drivers),
    ("top_risk_factors", reports.top_risk_factors), ("feature_correlation", reports.feature_correlation),
    ("correlation_matrix", reports.correlation_matrix), ("segment_profile", segments.segment_profile),
    ("segment_numeric_insights", segments.segment_numeric_insights),
    ("segment_categorical_insights", segments.segment_categorical_insights),
    ("insight_category", segments.segment_insights), ("service_adoption", segments.service_adoption),
    ("demographic_distribution", segments.demographic_distribution),
    ("tenure_distribution", segments.tenure_distribution), ("charge_histogram", segments.charge_histogram),
    ("services_vs_charges", reports.services_vs_charges), ("segment_values", segments.segment_values),
    ("churn_within_segment", segments.churn_within_segment), ("union_drivers", reports.union_drivers),
]:
    QUERIES[_name] = (lambda fn: (lambda spark, sf: fn(A(spark, sf))))(_fn)


# ---------------------------------------------------------------- 2.7 windows
@query("zip_customer_counts")
def q_zip_counts(spark, sf):
    return views.integrated(spark, sf).transform(features.geo_features).select(
        "customer_id", "zip_code", "customers_in_zip")


# ---------------------------------------------------------------- 2.9 retention
from .operators import experiments as X  # noqa: E402
from .operators import retention as R  # noqa: E402

# the registered ROI example: every risk segment and all customers as targets, with the
# custom-strategy defaults (cost 50, rate 0.2)
ROI_COST, ROI_RATE = 50.0, 0.2


@query("retention_roi")
def q_retention_roi(spark, sf):
    a = A(spark, sf)
    targets = a.withColumn("_t", F.explode(F.array(F.lit("All Customers"), F.col("risk_segment")))) \
               .where(F.col("_t").isNotNull()).withColumnRenamed("_t", "target")
    params = spark.createDataFrame([(t, ROI_COST, ROI_RATE) for t in ["All Customers", *B.RISK_LABELS]],
                                   "target string, cost_per_customer double, retention_rate double")
    return R.retention_roi(targets, ["target"], params)


@query("strategy_catalog")
def q_strategy_catalog(spark, sf):
    sizes = A(spark, sf).groupBy("risk_segment").agg(F.count(F.lit(1)).alias("segment_customers"))
    return R.strategy_catalog(spark).join(sizes, "risk_segment", "left").select(
        "risk_segment", "strategy", "cost_per_customer", "retention_rate", "target_segment", "rule",
        F.coalesce(F.col("segment_customers"), F.lit(0)).alias("segment_customers"))


@query("strategy_target_rules")
def q_strategy_rules(spark, sf):
    t = R.strategy_targets(A(spark, sf))
    return t.groupBy("risk_segment", "strategy", "rule", "charge_threshold").agg(
        F.count(F.lit(1)).alias("targeted_customers"))


@query("strategy_targets")
def q_strategy_targets(spark, sf):
    return R.strategy_targets(A(spark, sf)).select("customer_id", "risk_segment", "strategy")


@query("segment_revenue")
def q_segment_revenue(spark, sf):
    return R.segment_revenue(A(spark, sf))


@query("strategy_comparison")
def q_strategy_comparison(spark, sf):
    return R.strategy_comparison(A(spark, sf))


@query("top_strategies")
def q_top_strategies(spark, sf):
    return R.top_strategies(A(spark, sf))


# ---------------------------------------------------------------- 2.10 experiments
def _assignment(spark, sf):
    """The A/B assignment, made once per session: arms must stay fixed for every figure derived from
    them.  Its numbered customers are files; their rows, six a customer, are not written again."""
    return fixtures.kept(spark, "assignment", sf, lambda: X.assign_systematic(A(spark, sf)))


def _eff(spark, sf):
    return X.treatment_effect(_assignment(spark, sf))


def _fin(spark, sf):
    return X.experiment_financials(_eff(spark, sf))


def _z(spark, sf):
    return X.days_to_significance(X.two_proportion_ztest(_fin(spark, sf)))


@query("experiment_sizes")
def q_exp_sizes(spark, sf):
    return X.experiment_sizes(A(spark, sf))


@query("assign_systematic")
def q_assign(spark, sf):
    return _assignment(spark, sf).select("segment_type", "segment_value", "customer_id", "position", "arm")


@query("every_nth_row")
def q_every_nth(spark, sf):
    # every 3rd customer (pct 30 → n = 3) in score order within each risk segment
    s = views.scored(spark, sf).where(F.col("risk_segment").isNotNull()).select(
        "customer_id", "risk_segment", "churn_probability")
    from .plans.ordering import group_row_number
    n = group_row_number(s, ["risk_segment"], [F.round("churn_probability", 9), F.col("customer_id")], out="rn")
    return n.select("customer_id", "risk_segment", (F.col("rn") - 1).alias("position"),
                    (((F.col("rn") - 1) % 3) == 0).alias("is_test"))


@query("group_balance")
def q_group_balance(spark, sf):
    return X.group_balance(_assignment(spark, sf))


@query("experiment_baseline")
def q_exp_baseline(spark, sf):
    return X.experiment_baseline(A(spark, sf))


@query("adjusted_rate")
def q_adjusted_rate(spark, sf):
    return X.adjusted_rate(A(spark, sf))


@query("treatment_effect")
def q_treatment(spark, sf):
    return _eff(spark, sf).select(*X.EFFECT_COLUMNS)


@query("experiment_financials")
def q_financials(spark, sf):
    return _fin(spark, sf).select(*X.FINANCIAL_COLUMNS)


@query("value_per_customer")
def q_value_per_customer(spark, sf):
    return X.value_per_customer(_fin(spark, sf))


@query("two_proportion_ztest")
def q_ztest(spark, sf):
    return X.two_proportion_ztest(_fin(spark, sf)).select(*X.KEY, "z_stat", "p_value", "is_significant")


@query("days_to_significance")
def q_days(spark, sf):
    return _z(spark, sf).select(*X.KEY, "p_value", "is_significant", "estimated_days_to_significance")


@query("cumulative_projection")
def q_cumulative(spark, sf):
    return X.cumulative_projection(_fin(spark, sf))


@query("impact_projection")
def q_impact(spark, sf):
    return X.impact_projection(_fin(spark, sf))


@query("breakeven_month")
def q_breakeven(spark, sf):
    return X.breakeven_month(_fin(spark, sf))


@query("retention_sensitivity")
def q_ret_sens(spark, sf):
    return X.retention_sensitivity(_fin(spark, sf))


@query("sensitivity_breakeven_rate")
def q_sens_breakeven(spark, sf):
    return X.sensitivity_breakeven_rate(_fin(spark, sf))


@query("duration_sensitivity")
def q_dur_sens(spark, sf):
    return X.duration_sensitivity(_fin(spark, sf))


@query("recommendation_tier")
def q_tier(spark, sf):
    return X.recommendation_tier(_fin(spark, sf))


@query("experiment_warnings")
def q_warnings(spark, sf):
    return X.experiment_warnings(_z(spark, sf))


# ---------------------------------------------------------------- 2.8 machine learning
from .operators import ml as M  # noqa: E402
from .operators.features import engineer_features  # noqa: E402
from .plans.session import table_path  # noqa: E402

OHE_COLUMNS = ["gender", "multiple_lines", "internet_service", *features.SERVICES, "contract", "payment_method"]
_MODELS: dict = {}


def _dummies_long(df, names):
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    return (df.select("customer_id", F.expr(f"stack({len(names)}, {stack}) as (dummy, value)"))
              .where(F.col("value") == 1).select("customer_id", "dummy"))


@query("one_hot_encode")
def q_one_hot(spark, sf):
    b = base(spark, sf)
    v = M.fit_vocabulary(b, OHE_COLUMNS)
    return _dummies_long(M.one_hot_encode(b.select("customer_id", *OHE_COLUMNS), OHE_COLUMNS, v), v.dummy_names())


@query("align_features")
def q_align(spark, sf):
    b = base(spark, sf)
    v = M.fit_vocabulary(b, OHE_COLUMNS)
    # the whole table, with a contract that the vocabulary has never seen
    new = b.withColumn("contract", F.when(F.col("payment_method") == "Mailed check", "Prepaid").otherwise(F.col("contract")))
    aligned = M.align_features(new, v, ["tenure", "monthly_charges"])
    names = v.dummy_names()
    return aligned.agg(*[F.sum(F.col(n)).cast("bigint").alias(n) for n in names]).select(
        F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, `{n}`' for n in names)}) "
               f"as (feature, customers)"))


def _imputation(spark, sf):
    """Fill values of the training table, fitted once per session."""
    key = (spark.sparkContext.applicationId, "imputation", sf)
    if key not in _MODELS:
        _MODELS[key] = clean.fit_preprocessing(base(spark, sf))
    return _MODELS[key]


def _model_table(spark, sf):
    """Training table (written once per session, read by every fit) and its feature spec."""
    key = (spark.sparkContext.applicationId, "model_table", sf)
    if key not in _MODELS:
        df = features.prepare_customers(base(spark, sf), _imputation(spark, sf)).withColumnRenamed("churn", "churn_flag")
        tbl, spec = M.prepare_modeling_data(df, f"base_{fixtures.tag(spark, sf)}")
        _MODELS[key] = (fixtures.stored(spark, "model_table", sf, lambda: M.stratified_split(tbl)), spec)
    return _MODELS[key]


def _churn_model(spark, sf):
    return M.ChurnModel(_trained(spark, sf, "logistic_regression"), _imputation(spark, sf))


@query("stratified_split")
def q_split(spark, sf):
    s = views.analysis(spark, sf).select("customer_id", "churn_flag")
    return M.stratified_split(s).select("customer_id", "churn_flag", "split")


@query("balanced_class_weight")
def q_weights(spark, sf):
    return M.balanced_class_weight(views.analysis(spark, sf))


# what the integrated table knows only of customers who have left (or what is made from the target)
LEAKS = ["churn", "customer_status", "churn_category", "churn_reason"]


def _enhanced_table(spark, sf):
    """Training table of the integrated customers and its feature spec."""
    key = (spark.sparkContext.applicationId, "enhanced_table", sf)
    if key not in _MODELS:
        df = views.engineered(spark, sf).transform(clean.normalize_churn).drop(*LEAKS)
        tbl, spec = M.prepare_modeling_data(df, f"enhanced_{fixtures.tag(spark, sf)}")
        _MODELS[key] = (fixtures.stored(spark, "enhanced_table", sf, lambda: M.stratified_split(tbl)), spec)
    return _MODELS[key]


def _trained(spark, sf, name, table=_model_table):
    key = (spark.sparkContext.applicationId, name, table.__name__, sf)
    if key not in _MODELS:
        split, spec = table(spark, sf)
        train = M.with_class_weight(split.where(F.col("split") == "train"))
        _MODELS[key] = {"logistic_regression": M.train_logistic, "random_forest": M.train_random_forest,
                        "boosted_trees": M.train_boosted_trees}[name](train, spec)
    return _MODELS[key]


def _model_metrics(spark, sf, name, table=_model_table):
    split, _ = table(spark, sf)
    model = _trained(spark, sf, name, table)
    # rounded, so that equal customers tie whatever the order in which their features are added
    scored = M.score_churn(model, split).select("split", M.LABEL, F.round("churn_probability", 9).alias("churn_probability"))
    scored = materialize(scored, f"scored_{uuid.uuid4().hex}")  # both areas are of one scoring
    tr = M.roc_auc(scored.where(F.col("split") == "train")).withColumnRenamed("auc", "train_auc")
    te = M.roc_auc(scored.where(F.col("split") == "test")).withColumnRenamed("auc", "test_auc")
    return tr.crossJoin(te).select(F.lit(name).alias("model"), "train_auc", "test_auc")


for _m, _k in [("train_logistic", "logistic_regression"), ("train_random_forest", "random_forest"),
               ("train_boosted_trees", "boosted_trees")]:
    QUERIES[_m] = (lambda k: (lambda spark, sf: _model_metrics(spark, sf, k)))(_k)


@query("select_best_model")
def q_best(spark, sf):
    out = None
    for k in ("logistic_regression", "random_forest", "boosted_trees"):
        m = _model_metrics(spark, sf, k)
        out = m if out is None else out.unionByName(m)
    return out.orderBy(F.col("test_auc").desc(), "model").limit(1)


@query("roc_auc")
def q_auc(spark, sf):
    return M.roc_auc(views.analysis(spark, sf))


@query("classification_metrics")
def q_metrics(spark, sf):
    return M.classification_metrics(views.analysis(spark, sf))


@query("classification_report")
def q_report(spark, sf):
    return M.classification_report(views.analysis(spark, sf))


@query("score_churn")
def q_score(spark, sf):
    split, _ = _model_table(spark, sf)
    return M.score_churn(_trained(spark, sf, "logistic_regression"), split).select(
        "customer_id", "churn_probability", "risk_segment")


@query("batch_customer_scoring")
def q_batch_scoring(spark, sf):
    s = _churn_model(spark, sf).score(base(spark, sf).drop("churn"))
    return s.select("customer_id", "churn_probability",
                    B.risk_category_point("churn_probability").alias("risk_category"))


@query("scoring_agreement")
def q_scoring_agreement(spark, sf):
    """Whether each customer gets the same score in the whole table and in one of eight parts, each scored by itself."""
    model, new = _churn_model(spark, sf), base(spark, sf).drop("churn", "total_charges")
    parts = [model.score(new.where(F.pmod(F.col("customer_id"), F.lit(8)) == i)) for i in range(8)]
    part = parts[0]
    for x in parts[1:]:
        part = part.unionByName(x)
    whole = model.score(new).select("customer_id", F.col("churn_probability").alias("whole"))
    return part.join(whole, "customer_id", "full").select(
        "customer_id", F.col("churn_probability").eqNullSafe(F.col("whole")).alias("same_score"))


@query("train_enhanced")
def q_enhanced(spark, sf):
    """The logistic model and the boosted trees of the integrated table."""
    a, b = (_model_metrics(spark, sf, k, _enhanced_table) for k in ("logistic_regression", "boosted_trees"))
    return a.unionByName(b)


@query("logistic_coefficients")
def q_coefficients(spark, sf):
    """Each feature's coefficient, and whether the gradient there is below 1e-6 of the sum of weights."""
    model = _trained(spark, sf, "logistic_regression")
    named = model.spec.encoder.names().unionByName(spark.createDataFrame([(-1, "(intercept)")], "feature long, name string"))
    fitted = M.logistic.coefficient_table(model.fit, spark)
    return fitted.join(named, "feature").select(F.col("name").alias("feature"), "coefficient",
                                                (F.abs("gradient") < 1e-6).alias("gradient_is_zero"))


@query("sparse_one_hot")
def q_sparse(spark, sf):
    """The features of each customer's levels in the integrated table (cities included)."""
    split, spec = _enhanced_table(spark, sf)
    rows = spec.encoder.encode(spec.filled(split), ["customer_id"])
    return rows.select("customer_id", F.explode("levels").alias("feature"))


@query("boosted_first_splits")
def q_first_splits(spark, sf):
    """Every split of the first round of boosting with its gain, all training rows."""
    split, spec = _model_table(spark, sf)
    design = M.boosting_design(split.where(F.col("split") == "train"), spec)
    splits = M.first_splits(design, spec.encoder)
    return splits.join(spec.encoder.names(), "feature").select(
        F.col("name").alias("feature"), "split_value", "left_gradient", "left_hessian", "gain")


@query("feature_importance")
def q_importance(spark, sf):
    return M.feature_importance(_trained(spark, sf, "random_forest"))


@query("risk_factor_flags")
def q_risk_flags(spark, sf):
    return (M.risk_factor_flags(views.analysis(spark, sf))
            .select("customer_id", F.explode(F.when(F.size("risk_factors") > 0, F.col("risk_factors"))
                                             .otherwise(F.array(F.lit(M.NO_RISK_FACTOR)))).alias("risk_factor")))


@query("retention_recommendations")
def q_recommendations(spark, sf):
    return (M.retention_recommendations(views.analysis(spark, sf))
            .select("customer_id", F.explode("recommendations").alias("recommendation")))


# ---------------------------------------------------------------- 2.1 sinks and persistence
@query("save_load_model")
def q_save_load(spark, sf):
    """Whether the model read back scores each customer as the one that was saved."""
    model = _churn_model(spark, sf)
    path = table_path(spark, f"model_lr_{fixtures.tag(spark, sf)}")
    model.save(path)
    new = base(spark, sf).drop("churn")
    a = model.score(new).select("customer_id", F.col("churn_probability").alias("a"))
    b = M.ChurnModel.load(spark, path).score(new).select("customer_id", F.col("churn_probability").alias("b"))
    return a.join(b, "customer_id", "full").select("customer_id", F.col("a").eqNullSafe(F.col("b")).alias("same_score"))


@query("feature_columns")
def q_feature_columns(spark, sf):
    names = M.feature_columns(_trained(spark, sf, "logistic_regression"))
    return _write_read(spark, sf, names.coalesce(1), "feature_columns", "csv")


def _write_read(spark, sf, df, name, fmt="parquet"):
    from .sources import io
    path = table_path(spark, f"{name}_{fixtures.tag(spark, sf)}")
    io.write_table(df, path, fmt)
    return io.read_csv(spark, path, df.schema) if fmt == "csv" else spark.read.parquet(path)


@query("write_primary")
def q_write_primary(spark, sf):
    return _write_read(spark, sf, views.engineered(spark, sf), "primary")


@query("write_primary_csv")
def q_write_primary_csv(spark, sf):
    return _write_read(spark, sf, views.engineered(spark, sf), "primary_csv", "csv")


@query("write_geo")
def q_write_geo(spark, sf):
    geo = views.integrated(spark, sf).select("customer_id", "zip_code", "city", "latitude", "longitude", "population")
    return _write_read(spark, sf, geo, "geo", "csv")


@query("write_churn_details")
def q_write_churn_details(spark, sf):
    return _write_read(spark, sf, clean.churn_details(fixtures.crm(spark, sf)), "churn_details", "csv")


@query("write_usage_metrics")
def q_write_usage_metrics(spark, sf):
    return _write_read(spark, sf, clean.usage_metrics(fixtures.crm(spark, sf)), "usage_metrics", "csv")


@query("write_engineered")
def q_write_engineered(spark, sf):
    return _write_read(spark, sf, features.prepare_customers(base(spark, sf)), "engineered")


@query("write_reports")
def q_write_reports(spark, sf):
    a = views.analysis(spark, sf)
    city = _write_read(spark, sf, reports.churn_by_city(a), "churn_by_city", "csv")
    drv = _write_read(spark, sf, reports.churn_drivers(a), "churn_drivers", "csv")
    return (city.select(F.lit("churn_by_city").alias("report"), F.col("city").alias("key"), "churn_rate")
            .unionByName(drv.select(F.lit("churn_risk_factors").alias("report"), F.col("segment").alias("key"),
                                    "churn_rate")))


# ---------------------------------------------------------------- many definitions, densities, checked reads, kept reports
from .operators import definitions as D  # noqa: E402
from .operators import density  # noqa: E402

DEFINITION_COLUMNS = ["gender", "contract", "internet_service", "payment_method", "senior_citizen", "tech_support"]


def _definitions(spark, sf):
    """(definitions, params): each combination of a level or none of six columns, the table's own levels; 2 880 or so."""
    b = base(spark, sf)
    combined = spark.range(1).select(F.lit("").alias("definition"), F.array().cast("array<struct<column_name:string,value:string>>").alias("c"))
    for c in DEFINITION_COLUMNS:
        level = b.select(F.col(c).cast("string").alias("v")).where("v IS NOT NULL").distinct().unionByName(
            spark.range(1).select(F.lit(None).cast("string").alias("v")))
        one = F.array(F.struct(F.lit(c).alias("column_name"), F.col("v").alias("value")))
        combined = combined.crossJoin(F.broadcast(level)).select(  # a few levels a column
            F.concat("definition", F.lit("|"), F.coalesce("v", F.lit("*"))).alias("definition"),
            F.when(F.col("v").isNull(), F.col("c")).otherwise(F.concat("c", one)).alias("c"))
    combined = fixtures.stored(spark, "definitions", sf, lambda: combined)
    params = combined.select("definition", F.lit(ROI_COST).alias("cost_per_customer"), F.lit(ROI_RATE).alias("retention_rate"))
    return combined.select("definition", F.explode_outer("c").alias("c")).select("definition", "c.*"), params


@query("segment_definitions")
def q_definitions(spark, sf):
    """Customers of every definition that has any."""
    definitions, _ = _definitions(spark, sf)
    alike = D.profiles(base(spark, sf), definitions, [F.count(F.lit(1)).alias("_n"), F.sum("tenure").alias("_months")])
    return D.segment_members(alike, definitions).groupBy("definition").agg(
        F.sum("_n").alias("customers"), F.sum("_months").alias("months"))


@query("definition_roi")
def q_definition_roi(spark, sf):
    """Retention ROI of every definition, those without customers included."""
    definitions, params = _definitions(spark, sf)
    roi = D.segment_roi(A(spark, sf), definitions, params)
    return roi.select("definition", "customers_targeted", "intervention_cost", "monthly_revenue", "segment_churn_rate", "estimated_roi")


@query("charge_bins")
def q_charge_bins(spark, sf):
    return density.automatic_histogram(A(spark, sf))


@query("charge_density")
def q_charge_density(spark, sf):
    return density.binned_density(A(spark, sf))


@query("read_checked")
def q_read_checked(spark, sf):
    """An export of the subscriptions with damaged lines (by customer number): rows and bad rows by reason."""
    from .plans.session import table_path as _tp
    from .sources import io, quarantine
    b, i = base(spark, sf), F.col("customer_id")
    cells = [F.coalesce(F.when(i % 107 == 3, F.lit("many")).otherwise(F.col(c).cast("string")) if c == "monthly_charges"
                        else F.col(c).cast("string"), F.lit("")) for c in fixtures.SUBSCRIPTION_COLUMNS]
    line = F.concat_ws(",", *cells)
    short = F.concat_ws(",", *cells[:-1])
    line = (F.when(i % 97 == 1, short).when(i % 101 == 2, F.concat(line, F.lit(",more"))).when(i % 103 == 5, F.concat(F.lit('"'), line)).otherwise(line))
    path = _tp(spark, f"damaged_{fixtures.tag(spark, sf)}")
    b.select(line.alias("value")).write.mode("overwrite").text(path)
    read = quarantine.read_checked(spark, path, io.SUBSCRIPTION_SCHEMA, header=False)
    good = read.rows.agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("row_count"), F.sum("customer_id").cast("bigint").alias("ids"))
    return good.unionByName(read.quarantine.groupBy("reason").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.regexp_extract("raw", r"^\"?(\d+)", 1).cast("bigint")).cast("bigint").alias("ids")))


@query("kept_reports")
def q_kept_reports(spark, sf):
    """City and driver reports from partial aggregates of five micro-batches."""
    from .plans.session import table_path as _tp
    from .streaming import reports as kept
    name = f"{fixtures.tag(spark, sf)}_{uuid.uuid4().hex[:8]}"
    source, store = _tp(spark, f"arriving_{name}"), _tp(spark, f"kept_{name}")
    a = A(spark, sf)
    files = a.count() // (5 * ROWS_PER_TASK) + 1  # of a batch, so that no task writes or reads a fifth of a large table
    a.repartition(5 * files).write.mode("overwrite").parquet(source)
    kept.start_report_stream(spark, source, a.schema, store, f"{store}/checkpoint", files_per_batch=files).awaitTermination()
    merged = kept.stored(spark, store)
    city = kept.churn_by_city(merged).select(F.lit("churn_by_city").alias("report"), F.col("city").alias("key"), "churn_rate")
    return city.unionByName(kept.churn_drivers(merged).select(F.lit("churn_risk_factors").alias("report"), F.col("segment").alias("key"), "churn_rate"))


# ---------------------------------------------------------------- stored sketches and bucketed tables
from .operators import sketches  # noqa: E402

SKETCHED = ["monthly_charges", "total_charges", "population", "avg_monthly_gb_download"]


@query("sketch_quantiles")
def q_sketches(spark, sf):
    """Quartiles from the merged sketches of five parts: whether each one's rank is within the stated error."""
    from .plans.session import table_path as _tp
    a = A(spark, sf)
    path = _tp(spark, f"sketches_{fixtures.tag(spark, sf)}")
    for part in range(5):
        sketches.store(a.where(F.pmod(F.xxhash64("customer_id"), F.lit(5)) == part), SKETCHED, path, part)
    found = sketches.rank_errors(a, sketches.quantiles(sketches.merged(spark, path), [0.25, 0.5, 0.75]))
    return found.select("column_name", "p", (F.col("rank_error") <= sketches.RANK_ERROR).alias("within_error"))


@query("integrate_bucketed")
def q_integrate_bucketed(spark, sf):
    """The customer join of the integration on tables in buckets of the customer, with no exchange under it."""
    from .plans import buckets
    subs = fixtures.subscriptions(spark, sf)
    tag = fixtures.tag(spark, sf)
    left = buckets.write_bucketed(subs.select(*fixtures.SUBSCRIPTION_COLUMNS), f"subscriptions_by_customer_{tag}", "customer_id", 8)
    right = buckets.write_bucketed(fixtures.established(fixtures.crm(spark, sf, subs)), f"crm_by_customer_{tag}", "customer_id", 8)
    return integrate.integrate_inner_join(left, right, check_overlap=False)
