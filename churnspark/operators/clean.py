"""Cleaning, encoding and imputation.

Statistics (means, modes, null counts) come from one pass over the table; one value per
column is collected and becomes a literal of the next plan, so rows are read once more
and never joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

YES_NO_COLUMNS = ["partner", "dependents", "phone_service", "paperless_billing", "churn"]


def numeric_columns(df: DataFrame, fractional_only: bool = False) -> list[str]:
    kinds = (T.FloatType, T.DoubleType) if fractional_only else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def coerce_total_charges(df: DataFrame, col: str = "total_charges") -> DataFrame:
    """Text → double; blanks and unparsable text → null (``try_cast``, ANSI-safe)."""
    return df.withColumn(col, F.expr(f"try_cast(trim(`{col}`) as double)"))


def zero_new_customer_charges(df: DataFrame, col: str = "total_charges", tenure: str = "tenure") -> DataFrame:
    """A missing charge of a customer with tenure 0 is 0."""
    return df.withColumn(col, F.when(F.col(col).isNull() & (F.col(tenure) == 0), F.lit(0.0))
                               .otherwise(F.col(col)))


@dataclass(frozen=True)
class Imputation:
    """Fitted fill values: the mean of every numeric column, the mode (ties → smallest) of
    every string column, and the numeric columns that had nulls.  One value per column."""
    means: dict[str, float | None]
    modes: dict[str, str | None]
    had_nulls: frozenset[str]

    def apply(self, df: DataFrame, everywhere: bool = False, all_null_value: str | None = None) -> DataFrame:
        """Fill nulls; numeric columns that had nulls when fitted become double, as a column
        with missing values is a float column in the reference.  ``everywhere`` fills and
        widens every numeric column (new customers may lack what the fitted table had)."""
        numeric = {c for c in self.means if c in df.columns and (everywhere or c in self.had_nulls)}

        def column(c: str) -> F.Column:
            if c in numeric:
                return F.coalesce(F.col(c).cast("double"), F.lit(self.means[c]).cast("double")).alias(c)
            if c in self.modes:
                fill = self.modes[c] if self.modes[c] is not None else all_null_value
                return F.coalesce(F.col(c), F.lit(fill).cast("string")).alias(c)
            return F.col(c)
        return df.select(*[column(c) for c in df.columns])

    def table(self, spark) -> DataFrame:
        """``(column_name, kind, mean, mode, had_nulls)``, to be stored with a model."""
        rows = [(c, "mean", v, None, c in self.had_nulls) for c, v in self.means.items()]
        rows += [(c, "mode", None, v, False) for c, v in self.modes.items()]
        return spark.createDataFrame(rows, "column_name string, kind string, mean double, mode string, had_nulls boolean")

    @staticmethod
    def from_table(df: DataFrame) -> Imputation:
        rows = df.collect()  # one row per column
        return Imputation({r["column_name"]: r["mean"] for r in rows if r["kind"] == "mean"},
                          {r["column_name"]: r["mode"] for r in rows if r["kind"] == "mode"},
                          frozenset(r["column_name"] for r in rows if r["had_nulls"]))


def fit_imputation(df: DataFrame, numeric: Sequence[str] | None = None, strings: Sequence[str] | None = None) -> Imputation:
    """Means, modes and null counts of all columns in **one** pass over ``df``.

    String columns are exploded into (column, value) pairs and counted; the numeric columns
    ride on the first pair of each row, so their sums come from the same partial aggregation.
    The result, one row per column, is collected: it is the fitted state of the table."""
    numeric = list(numeric) if numeric is not None else numeric_columns(df)
    strings = list(strings) if strings is not None else string_columns(df)
    if not numeric and not strings:
        return Imputation({}, {}, frozenset())
    first = [F.struct(F.lit(0).alias("k"), F.lit(None).cast("string").alias("v"),
                      *[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(numeric)])]
    rest = [F.struct(F.lit(j + 1).alias("k"), F.col(c).alias("v"),
                     *[F.lit(None).cast("double").alias(f"n{i}") for i in range(len(numeric))])
            for j, c in enumerate(strings)]
    pairs = df.select(F.explode(F.array(*first, *rest)).alias("p")).select("p.*")
    sums = [x for i in range(len(numeric)) for x in (F.sum(f"n{i}").alias(f"s{i}"), F.count(f"n{i}").alias(f"c{i}"))]
    counts = pairs.groupBy("k", "v").agg(F.count(F.lit(1)).alias("rows"), *sums)
    top = F.min_by("v", F.when(F.col("v").isNotNull(), F.struct((-F.col("rows")).alias("a"), F.col("v").alias("b"))))
    stats = counts.groupBy("k").agg(top.alias("mode"), F.sum("rows").alias("rows"),
                                    *[F.sum(f"{x}{i}").alias(f"{x}{i}") for i in range(len(numeric)) for x in "sc"])
    by = {r["k"]: r for r in stats.collect()}  # one row per string column and one for the numbers
    zero = by.get(0)
    means = {c: zero[f"s{i}"] / zero[f"c{i}"] if zero and zero[f"c{i}"] else None for i, c in enumerate(numeric)}
    nulls = frozenset(c for i, c in enumerate(numeric) if zero and zero[f"c{i}"] < zero["rows"])
    return Imputation(means, {c: by[j + 1]["mode"] if j + 1 in by else None for j, c in enumerate(strings)}, nulls)


def mean_impute(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null → column mean, for every numeric column (integer columns too) that has nulls;
    those come back as double, the others unchanged."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    return fit_imputation(df, cols, []).apply(df) if cols else df


def mode_impute(df: DataFrame, cols: Sequence[str] | None = None, all_null_value: str | None = None) -> DataFrame:
    """Null string → most frequent value (ties → smallest); all-null column → ``all_null_value``."""
    cols = list(cols) if cols is not None else string_columns(df)
    return fit_imputation(df, [], cols).apply(df, all_null_value=all_null_value) if cols else df


def zero_fill(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null numerics → 0 (the tail of both feature steps)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    return df.na.fill(0, subset=cols) if cols else df


def encode_yes_no(df: DataFrame, cols: Sequence[str] = YES_NO_COLUMNS) -> DataFrame:
    """Yes → 1, No → 0, anything else → null (present columns only)."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.when(F.col(c) == "Yes", 1).when(F.col(c) == "No", 0) for c in present})


def normalize_churn(df: DataFrame, col: str = "churn", out: str = "churn_flag") -> DataFrame:
    """Yes/No or numeric text → 0/1 integer, unparsable/null → 0 (decided per value)."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.NumericType):
        v = F.coalesce(c.cast("int"), F.lit(0))
    else:
        v = F.coalesce(F.when(c == "Yes", 1).when(c == "No", 0),
                       F.expr(f"try_cast(try_cast(`{col}` as double) as int)"), F.lit(0))
    return df.withColumn(out, v)


def target_from_status(df: DataFrame, status: str = "customer_status", out: str = "churn") -> DataFrame:
    """Churned → 1, Stayed → 0, anything else (e.g. Joined) → null."""
    s = F.col(status)
    return df.withColumn(out, F.when(s == "Churned", 1).when(s == "Stayed", 0))


def null_profile(df: DataFrame) -> DataFrame:
    """``(column_name, null_count)`` for every column, from one aggregate."""
    cols = df.columns
    counts = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("bigint").alias(f"_{i}")
                      for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', `_{i}`" for i, c in enumerate(cols))
    return counts.select(F.expr(f"stack({len(cols)}, {stack}) as (column_name, null_count)"))


def drop_identifier_columns(df: DataFrame, target: str = "churn", key: str = "customer_id") -> DataFrame:
    """Drop the target, the key and any column whose name ends in "id" (case-insensitive)."""
    drop = [c for c in df.columns if c in (target, key) or c.lower().endswith("id")]
    return df.drop(*drop)


# CRM export names → this package's names (reference renames plus snake_case).
CRM_RENAMES = {
    "Customer ID": "customer_id", "Gender": "gender", "Married": "marital_status",
    "Number of Dependents": "dependents_count", "Phone Service": "phone_service",
    "Internet Service": "internet_service", "Contract": "contract_type", "Paperless Billing": "paperless_billing",
    "Payment Method": "payment_method", "Monthly Charge": "monthly_charges", "Total Charges": "total_charges",
    "Tenure in Months": "tenure_months", "Zip Code": "zip_code", "City": "city", "Latitude": "latitude",
    "Longitude": "longitude", "Number of Referrals": "number_of_referrals",
    "Avg Monthly GB Download": "avg_monthly_gb_download",
    "Avg Monthly Long Distance Charges": "avg_monthly_long_distance_charges",
    "Total Long Distance Charges": "total_long_distance_charges",
    "Total Extra Data Charges": "total_extra_data_charges", "Customer Status": "customer_status",
    "Churn Category": "churn_category", "Churn Reason": "churn_reason",
}


def standardize_crm(raw: DataFrame) -> DataFrame:
    """Rename the CRM export's columns and encode its two Yes/No columns."""
    renamed = raw.withColumnsRenamed({k: v for k, v in CRM_RENAMES.items() if k in raw.columns})
    return encode_yes_no(renamed, ["phone_service", "paperless_billing"])


def churn_details(crm: DataFrame) -> DataFrame:
    """Churned customers with status, category and reason (missing columns → null)."""
    cols = ["customer_id", "customer_status", "churn_category", "churn_reason"]
    sel = [F.col(c) if c in crm.columns else F.lit(None).cast("string").alias(c) for c in cols]
    return crm.where(F.col("customer_status") == "Churned").select(*sel)


USAGE_COLUMNS = ["avg_monthly_long_distance_charges", "avg_monthly_gb_download", "total_extra_data_charges",
                 "total_long_distance_charges"]


def usage_metrics(crm: DataFrame) -> DataFrame:
    present = [c for c in USAGE_COLUMNS if c in crm.columns]
    if not present:
        raise ValueError(f"none of the usage columns {USAGE_COLUMNS} is present")
    return crm.select("customer_id", *present)


def segment_filter(df: DataFrame, definition: Mapping[str, object]) -> DataFrame:
    """Rows equal to every (column, value) of ``definition``; unknown columns are ignored.
    A tenure-group label ("0-1 year" …) selects the matching numeric tenure code."""
    from ..functions.bins import TENURE_YEAR_LABELS

    def value(k, v):
        numeric = isinstance(df.schema[k].dataType, T.NumericType)
        if k == "tenure_group" and numeric and isinstance(v, str) and v in TENURE_YEAR_LABELS:
            return TENURE_YEAR_LABELS.index(v)
        return v
    conds = [F.col(k) == F.lit(value(k, v)) for k, v in definition.items() if k in df.columns]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def fit_preprocessing(df: DataFrame) -> Imputation:
    """The fill values that :func:`preprocess` takes from ``df``; identifiers are never filled."""
    x = df.transform(coerce_total_charges).transform(zero_new_customer_charges)
    return fit_imputation(x, [c for c in numeric_columns(x) if not c.lower().endswith("id")])


def preprocess(df: DataFrame, imputation: Imputation | None = None) -> DataFrame:
    """Base preparation: coerce charges → zero new customers → mean and mode → Yes/No encoding.

    Without ``imputation`` the fill values come from ``df`` itself (one pass); with one, e.g. of
    the table a model was trained on, every row is filled the same whatever else is in ``df``."""
    x = df.transform(coerce_total_charges) if "total_charges" in df.columns else df
    x = zero_new_customer_charges(x) if "total_charges" in df.columns else x
    filled = imputation.apply(x, everywhere=True) if imputation else fit_preprocessing(df).apply(x)
    return filled.transform(encode_yes_no)
