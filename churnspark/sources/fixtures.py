"""Binding of the churn data model onto the TPC-H-shaped test tables.

One order plays one subscription.  The views are built with the DataFrame API so
Catalyst prunes every parquet scan to the handful of columns used:

* lineitem ⋈ part (on part key) is aggregated per order key – partial aggregation
  before the shuffle, one row per order afterwards;
* orders are joined to that per-order aggregate on the order key first: the
  aggregate is already hash-partitioned on the order key, so only ``orders`` is
  exchanged for that join;
* customers are joined on the customer key (shuffle join; AQE converts it to a
  broadcast only when run-time statistics show the side is small);
* nation (25 rows by the TPC-H schema, checked) is broadcast.

``SUBSCRIPTION_COLUMNS`` lists the base (reference "telco") columns; the view also
carries the CRM columns ``zip_code``, ``city``, ``number_of_referrals``,
``avg_monthly_gb_download`` and ``avg_monthly_long_distance_charges``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.broadcast import checked_broadcast
from ..plans.lineage import materialize
from ..plans.partitions import shuffle_partitions

# Fixed values of the fixture binding (FIXTURES.md §2)
PART_TYPES_FOR_SERVICES = ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"]
SERVICE_COLUMNS = ["online_security", "online_backup", "device_protection", "tech_support",
                   "streaming_tv", "streaming_movies"]
AUGUST_2001_MONTHS = 24020
PAYMENT_METHODS = ["Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)"]

SUBSCRIPTION_COLUMNS = [
    "customer_id", "gender", "senior_citizen", "partner", "dependents", "tenure", "phone_service",
    "multiple_lines", "internet_service", *SERVICE_COLUMNS, "contract", "paperless_billing",
    "payment_method", "monthly_charges", "total_charges", "churn",
]
CRM_CARRY_COLUMNS = ["zip_code", "city", "number_of_referrals", "avg_monthly_gb_download",
                     "avg_monthly_long_distance_charges"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _per_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
                                              "l_returnflag")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_type")
    flags = [F.max(F.when(F.col("p_type") == t, 1).otherwise(0)).alias(f"s{i + 1}")
             for i, t in enumerate(PART_TYPES_FOR_SERVICES)]
    return (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
              .groupBy("l_orderkey")
              .agg(F.count(F.lit(1)).alias("n_lines"),
                   F.sum("l_quantity").alias("gb"),
                   (F.avg("l_extendedprice") / F.lit(1000.0)).alias("ld"),
                   F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("refs"),
                   *flags))


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, name: str, sf_dir: str, build) -> DataFrame:
    """Write a derived table once per session into the shared folder and reuse the files.

    Reports then start from parquet (lineage cut: a lost executor recomputes a scan,
    not the whole derivation) and see real file statistics for join planning.
    """
    return kept(spark, name, sf_dir, lambda: materialize(build(), f"{name}_{tag(spark, sf_dir)}"))


def kept(spark: SparkSession, name: str, sf_dir: str, build) -> DataFrame:
    """A table that starts from files, made once per session with shuffle partitions in proportion to its input."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _TABLES:
        # from the files' footers; an order has a few narrow lines
        rows = _t(spark, sf_dir, "orders").count() + _t(spark, sf_dir, "lineitem").count() // 4
        with shuffle_partitions(spark, rows):
            _TABLES[key] = build()
    return _TABLES[key]


def forget(spark: SparkSession) -> None:
    """Drop the session's record of stored tables (their files are gone)."""
    for key in [k for k in _TABLES if k[0] == spark.sparkContext.applicationId]:
        del _TABLES[key]


def tag(spark: SparkSession, sf_dir: str) -> str:
    """A name part that differs between applications and inputs, the same in every process."""
    return hashlib.md5(f"{spark.sparkContext.applicationId}|{sf_dir}".encode()).hexdigest()[:12]


def established(crm_table: DataFrame) -> DataFrame:
    """The CRM as it is before the newly joined are entered: the gap that the join operators have to bridge."""
    return crm_table.where(F.col("customer_status") != "Joined")


def surveyed(zips: DataFrame) -> DataFrame:
    """The ZIP table without the first nation, which has no survey: ZIPs that find no population."""
    return zips.where(F.col("zip_code") >= 100)


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subscription table (materialized once per session, see :func:`stored`)."""
    return stored(spark, "subscriptions", sf_dir, lambda: build_subscriptions(spark, sf_dir))


def build_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base subscription table plus CRM carry-over columns (one row per order)."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                "o_orderdate", "o_orderpriority")
    customer = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = checked_broadcast(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), max_rows=10_000)
    li = _per_order_lines(spark, sf_dir)

    b = (orders.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
               .join(customer, F.col("c_custkey") == F.col("o_custkey"))
               .join(nation, F.col("n_nationkey") == F.col("c_nationkey")))

    okey, ckey = F.col("o_orderkey"), F.col("o_custkey")
    ten = (F.lit(AUGUST_2001_MONTHS) - (F.year("o_orderdate").cast("bigint") * 12
                                        + F.month("o_orderdate").cast("bigint")))
    ctr = (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Month-to-month")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "One year").otherwise("Two year"))
    inet = (F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "Fiber optic")
             .when(F.col("c_mktsegment").isin("FURNITURE", "HOUSEHOLD"), "DSL").otherwise("No"))
    b = b.withColumns({"ten": ten, "ctr": ctr, "inet": inet})

    def yes_no(cond):
        return F.when(cond, "Yes").otherwise("No")

    def service(flag: str):
        return (F.when(F.col("inet") == "No", "No internet service")
                 .when(F.col(flag) == 1, "Yes").when(F.col(flag) == 0, "No"))

    status = F.col("o_orderstatus")
    churn = ((status == "F") & (F.col("ctr") != "Two year")) \
        | ((status == "P") & (F.col("ctr") == "Month-to-month") & (F.col("ten") <= 24)) \
        | ((status == "F") & (F.col("ten") <= 12))
    pm = okey % 4
    return b.select(
        okey.alias("customer_id"),
        F.when(ckey % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.when(ckey % 6 == 0, 1).otherwise(0).alias("senior_citizen"),
        yes_no(okey % 2 == 0).alias("partner"),
        yes_no(ckey % 3 == 0).alias("dependents"),
        F.col("ten").alias("tenure"),
        yes_no(okey % 10 != 0).alias("phone_service"),
        F.when(okey % 10 == 0, "No phone service").when(ckey % 5 < 2, "Yes").otherwise("No")
         .alias("multiple_lines"),
        F.col("inet").alias("internet_service"),
        *[service(f"s{i + 1}").alias(c) for i, c in enumerate(SERVICE_COLUMNS)],
        F.col("ctr").alias("contract"),
        yes_no(okey % 5 < 3).alias("paperless_billing"),
        F.when(pm == 0, PAYMENT_METHODS[0]).when(pm == 1, PAYMENT_METHODS[1])
         .when(pm == 2, PAYMENT_METHODS[2]).otherwise(PAYMENT_METHODS[3]).alias("payment_method"),
        (F.col("o_totalprice") / F.lit(5000.0) + F.lit(18.0)).alias("monthly_charges"),
        F.when(F.col("ten") == 0, " ").when(F.col("n_lines").isNull(), "n/a")
         .otherwise(F.col("o_totalprice").cast("string")).alias("total_charges"),
        yes_no(churn).alias("churn"),
        (F.col("c_nationkey").cast("bigint") * 100 + ckey % 20).alias("zip_code"),
        F.concat(F.col("n_name"), F.lit("/"), F.col("c_mktsegment")).alias("city"),
        F.col("refs").cast("bigint").alias("number_of_referrals"),
        F.col("gb").alias("avg_monthly_gb_download"),
        F.col("ld").alias("avg_monthly_long_distance_charges"),
    )


def base_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the 21 base columns (the reference's basic-model table)."""
    return subscriptions(spark, sf_dir).select(*SUBSCRIPTION_COLUMNS)


def crm(spark: SparkSession, sf_dir: str, subs: DataFrame | None = None) -> DataFrame:
    """CRM table, already in this package's snake_case names; ``gender`` is also a base column."""
    s = subs if subs is not None else subscriptions(spark, sf_dir)
    cid = F.col("customer_id")
    zipd = F.col("zip_code").cast("double")
    churned = F.col("churn") == "Yes"
    cat = F.when(cid % 3 == 0, "Competitor").when(cid % 3 == 1, "Price").otherwise("Attitude")
    return s.select(
        cid, "gender", "zip_code", "city",
        (F.lit(30.0) + zipd / F.lit(1000.0)).alias("latitude"),
        (F.lit(-120.0) + zipd / F.lit(1000.0)).alias("longitude"),
        "number_of_referrals", "avg_monthly_gb_download", "avg_monthly_long_distance_charges",
        (F.col("avg_monthly_long_distance_charges") * F.col("tenure")).alias("total_long_distance_charges"),
        F.when(cid % 4 == 0, 10).otherwise(0).cast("double").alias("total_extra_data_charges"),
        F.when(churned, "Churned").when(F.col("tenure") <= 3, "Joined").otherwise("Stayed")
         .alias("customer_status"),
        F.when(churned, cat).alias("churn_category"),
        F.when(churned, F.concat(F.lit("reason "), (cid % 5).cast("string"))).alias("churn_reason"),
    )


# The CRM export's own column names, as the reference reads them.
RAW_CRM_NAMES = {
    "customer_id": "Customer ID", "gender": "Gender", "zip_code": "Zip Code", "city": "City",
    "latitude": "Latitude", "longitude": "Longitude", "number_of_referrals": "Number of Referrals",
    "avg_monthly_gb_download": "Avg Monthly GB Download",
    "avg_monthly_long_distance_charges": "Avg Monthly Long Distance Charges",
    "total_long_distance_charges": "Total Long Distance Charges",
    "total_extra_data_charges": "Total Extra Data Charges", "customer_status": "Customer Status",
    "churn_category": "Churn Category", "churn_reason": "Churn Reason",
}


def raw_crm(spark: SparkSession, sf_dir: str, subs: DataFrame | None = None) -> DataFrame:
    """The CRM table as its export names it (spaces, title case)."""
    return crm(spark, sf_dir, subs).withColumnsRenamed(RAW_CRM_NAMES)


def zip_population(spark: SparkSession, sf_dir: str, subs: DataFrame | None = None) -> DataFrame:
    """ZIP → population dimension."""
    s = subs if subs is not None else subscriptions(spark, sf_dir)
    z = s.select("zip_code").distinct()
    return z.select("zip_code", (F.lit(1000) + (F.col("zip_code") * 7919) % 50000).alias("population"))


def churn_probability_expr() -> F.Column:
    """Deterministic score that stands in for a trained model in oracled queries."""
    risk = (F.when(F.col("contract") == "Month-to-month", 2).when(F.col("contract") == "One year", 1)
             .otherwise(0))
    z = (F.lit(-1.0) + F.lit(0.9) * risk - F.lit(0.03) * F.col("tenure")
         + F.lit(0.02) * (F.col("monthly_charges") - F.lit(65.0)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def scored(spark: SparkSession, sf_dir: str, subs: DataFrame | None = None) -> DataFrame:
    s = subs if subs is not None else subscriptions(spark, sf_dir)
    return s.withColumns({
        "churn_flag": F.when(F.col("churn") == "Yes", 1).otherwise(0),
        "churn_probability": churn_probability_expr(),
    })
