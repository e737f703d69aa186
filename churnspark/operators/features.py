"""Scalar and per-ZIP features.  All native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bins
from ..functions.numeric import clamp01
from ..plans.broadcast import checked_broadcast
from .clean import (Imputation, coerce_total_charges, fit_imputation, mode_impute, preprocess, string_columns,
                    zero_fill)

SERVICES = ["online_security", "online_backup", "device_protection", "tech_support", "streaming_tv",
            "streaming_movies"]
# Contract vocabularies and their risk factor.
CONTRACT_RISK = {"Month-to-month": 2, "One year": 1, "Two year": 0}
CONTRACT_RISK_ALT = {"Monthly": 2, "One Year": 1, "Two Year": 0}


def _map(col: str, mapping: dict) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(col) == k, F.lit(v)) if expr is None else expr.when(F.col(col) == k, F.lit(v))
    return expr


def service_features(df: DataFrame) -> DataFrame:
    """``total_services`` counts service columns not in {No, No internet service}; a null
    value counts as subscribed (reference semantics).  Plus three Yes flags."""
    present = [c for c in SERVICES if c in df.columns]
    out = {}
    if present:
        out["total_services"] = sum((F.when(F.col(c).isin("No", "No internet service"), 0).otherwise(1)
                                     for c in present), F.lit(0))
    if "tech_support" in df.columns:
        out["has_tech_support"] = F.when(F.col("tech_support") == "Yes", 1).otherwise(0)
    if "online_security" in df.columns:
        out["has_online_security"] = F.when(F.col("online_security") == "Yes", 1).otherwise(0)
    if "streaming_tv" in df.columns and "streaming_movies" in df.columns:
        out["streaming_services"] = F.when((F.col("streaming_tv") == "Yes") & (F.col("streaming_movies") == "Yes"),
                                           1).otherwise(0)
    return df.withColumns(out)


def _safe_tenure() -> F.Column:
    return F.when(F.col("tenure") == 0, F.lit(1)).otherwise(F.col("tenure"))


def financial_features(df: DataFrame) -> DataFrame:
    """``clv = tenure·monthly``; ``avg_monthly_spend = total / tenure`` (only 0 → 1); nulls → 0."""
    return df.withColumns({
        "clv": F.coalesce(F.col("tenure") * F.col("monthly_charges"), F.lit(0.0)),
        "avg_monthly_spend": F.coalesce(F.col("total_charges").cast("double") / _safe_tenure(), F.lit(0.0)),
    })


def tenure_contract_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "tenure_months": F.col("tenure"),
        "tenure_group": bins.tenure_code("tenure"),
        "contract_risk_factor": _map("contract", CONTRACT_RISK),
    })


def contract_risk_two_vocab(df: DataFrame) -> DataFrame:
    """Risk factor from ``contract`` or, without it, ``contract_type``; both vocabularies
    (they are disjoint) map in one expression."""
    col = "contract" if "contract" in df.columns else ("contract_type" if "contract_type" in df.columns else None)
    if col is None:
        return df
    return df.withColumn("contract_risk_factor", _map(col, {**CONTRACT_RISK, **CONTRACT_RISK_ALT}))


def geo_features(df: DataFrame) -> DataFrame:
    """``customers_in_zip`` and ``zip_penetration_rate`` (null when population is 0/null).

    Counted with a partial GROUP BY and joined back on the ZIP (the per-ZIP table is broadcast
    under a checked bound, so the customers stay where they are) – not a window, which would
    put a hot ZIP into one task.
    """
    counts = df.where(F.col("zip_code").isNotNull()).groupBy("zip_code").agg(
        F.count(F.lit(1)).alias("customers_in_zip"))
    out = df.join(checked_broadcast(counts), "zip_code", "left")
    return out.withColumn("zip_penetration_rate",
                          F.try_divide(F.col("customers_in_zip").cast("double"), F.col("population").cast("double")))


def has_referrals(df: DataFrame, col: str = "number_of_referrals") -> DataFrame:
    return df.withColumn("has_referrals", F.coalesce(F.col(col) > 0, F.lit(False)).cast("int"))


def engineer_features(df: DataFrame, strings_filled: bool = False) -> DataFrame:
    """Base feature step: service → financial → tenure/contract → zero-fill → mode-fill.

    After :func:`~.clean.preprocess` (``strings_filled``) only all-null columns can still hold
    a null; they become "Unknown" without another statistics pass."""
    out = (df.transform(service_features)
             .transform(financial_features)
             .transform(tenure_contract_features)
             .transform(zero_fill))
    if strings_filled:
        return out.na.fill("Unknown")
    return mode_impute(out, all_null_value="Unknown")


def prepare_customers(df: DataFrame, imputation: Imputation | None = None) -> DataFrame:
    """Raw subscriptions → model features: preprocess and engineer, in training, for new
    tables and on streams alike."""
    return engineer_features(preprocess(df, imputation), strings_filled=True)


def engineer_additional_features(df: DataFrame) -> DataFrame:
    """Feature step of the integrated table, over whichever optional columns exist."""
    out = df.transform(service_features)
    if "tenure" in out.columns and "monthly_charges" in out.columns:
        out = out.withColumn("clv", F.col("tenure") * F.col("monthly_charges"))
        if "total_charges" in out.columns:
            out = coerce_total_charges(out).withColumn("total_charges", F.coalesce(F.col("total_charges"),
                                                                                   F.lit(0.0)))
            out = out.withColumn("avg_monthly_spend", F.col("total_charges") / _safe_tenure())
    if "population" in out.columns and "zip_code" in out.columns:
        out = geo_features(out)
    if "number_of_referrals" in out.columns:
        out = has_referrals(out)
    if "tenure" in out.columns:
        out = out.withColumns({"tenure_months": F.col("tenure"), "tenure_group": bins.tenure_code("tenure")})
    out = contract_risk_two_vocab(out)
    # the steps above change no string column but total_charges: modes come from the input
    strings = [c for c in string_columns(out) if c in df.columns]
    return fit_imputation(df, [], strings).apply(out.transform(zero_fill), all_null_value="Unknown")


def revenue_per_service(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue_per_service", F.col("monthly_charges") /
                         F.when(F.col("total_services") == 0, F.lit(1)).otherwise(F.col("total_services")))


def clamp_probability(df: DataFrame, col: str = "churn_probability") -> DataFrame:
    return df.withColumn(col, clamp01(col))
