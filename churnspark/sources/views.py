"""Derived tables every report reads: the integrated, engineered and scored table.

``analysis(spark, sf_dir)`` is the reference's ``--integrate-data`` output (base ⋈
CRM ⋈ ZIP, additional features, imputation) plus the numeric target
``churn_flag``, the deterministic ``churn_probability`` and its ``risk_segment``.
In production the table is written once with :func:`~churnspark.plans.lineage.materialize`
and every report reads the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins
from ..operators.clean import normalize_churn
from ..operators.features import engineer_additional_features
from ..operators.integrate import integrate_inner_join, join_zip_population
from . import fixtures


def integrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integrated table, written once per session: the feature step reads it three
    times (rows, per-ZIP counts, mode statistics), and re-deriving it would repeat the
    base ⋈ CRM shuffle join each time."""
    return fixtures.stored(spark, "integrated", sf_dir, lambda: build_integrated(spark, sf_dir))


def build_integrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = fixtures.subscriptions(spark, sf_dir)
    base = subs.select(*fixtures.SUBSCRIPTION_COLUMNS)
    crm = fixtures.crm(spark, sf_dir, subs)
    zips = fixtures.zip_population(spark, sf_dir, subs)
    # keys overlap by construction here, so the no-overlap probe (an extra job) is skipped
    return join_zip_population(integrate_inner_join(base, crm, check_overlap=False), zips)


def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engineer_additional_features(integrated(spark, sf_dir))


def add_score(df: DataFrame) -> DataFrame:
    return (df.withColumn("churn_probability", fixtures.churn_probability_expr())
              .withColumn("risk_segment", bins.risk_segment("churn_probability")))


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materialized once per session (the reference writes its primary table and the
    reports read it back)."""
    return fixtures.stored(spark, "analysis", sf_dir, lambda: build_analysis(spark, sf_dir))


def build_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engineered(spark, sf_dir).transform(normalize_churn).transform(add_score)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture ``scored`` view plus ``risk_segment``."""
    return fixtures.scored(spark, sf_dir).withColumn("risk_segment", bins.risk_segment("churn_probability"))
