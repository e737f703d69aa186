"""Readers and writers for the CSV sources (schema-first, no inference).

The subscription export keeps ``total_charges`` as text (it contains blanks); the
CRM export uses its own title-case names (``standardize_crm`` maps them); the data
dictionary is windows-1252 encoded.  Writers keep whitespace, so a blank charge
survives a round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import target_from_status

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _schema(fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SUBSCRIPTION_SCHEMA = _schema([
    ("customer_id", L), ("gender", S), ("senior_citizen", I), ("partner", S), ("dependents", S), ("tenure", L),
    ("phone_service", S), ("multiple_lines", S), ("internet_service", S), ("online_security", S),
    ("online_backup", S), ("device_protection", S), ("tech_support", S), ("streaming_tv", S),
    ("streaming_movies", S), ("contract", S), ("paperless_billing", S), ("payment_method", S),
    ("monthly_charges", D), ("total_charges", S), ("churn", S)])
CRM_RAW_SCHEMA = _schema([
    ("Customer ID", L), ("Gender", S), ("Zip Code", L), ("City", S), ("Latitude", D), ("Longitude", D),
    ("Number of Referrals", L), ("Avg Monthly GB Download", D), ("Avg Monthly Long Distance Charges", D),
    ("Total Long Distance Charges", D), ("Total Extra Data Charges", D), ("Customer Status", S),
    ("Churn Category", S), ("Churn Reason", S)])
ZIP_RAW_SCHEMA = _schema([("Zip Code", L), ("Population", L)])
DICTIONARY_SCHEMA = _schema([("Table", S), ("Field", S), ("Description", S)])

_CSV_OPTIONS = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                "nullValue": ""}


def _cp1252_fix() -> tuple[str, str]:
    """Latin-1 decodes byte b as U+00b; windows-1252 differs only in 0x80–0x9F.  The
    translation table is derived from Python's codec (undefined bytes stay as is)."""
    src, dst = [], []
    for b in range(0x80, 0xA0):
        ch = bytes([b]).decode("cp1252", errors="ignore")
        if ch:
            src.append(chr(b))
            dst.append(ch)
    return "".join(src), "".join(dst)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """Schema-first CSV.  Spark's CSV reader has no windows-1252 charset: such files are
    read as ISO-8859-1 and the 27 code points where the two differ are translated."""
    cp1252 = encoding.lower().replace("_", "-") in ("windows-1252", "cp1252")
    df = (spark.read.schema(schema).options(**_CSV_OPTIONS)
               .option("encoding", "ISO-8859-1" if cp1252 else encoding).csv(path))
    if not cp1252:
        return df
    src, dst = _cp1252_fix()
    return df.select(*[F.translate(F.col(f"`{f.name}`"), src, dst).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV_OPTIONS).csv(path)


def read_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SUBSCRIPTION_SCHEMA)


def read_crm(spark: SparkSession, path: str) -> DataFrame:
    """The CRM export in its own names (``clean.standardize_crm`` renames them)."""
    return read_csv(spark, path, CRM_RAW_SCHEMA)


def read_zip_population(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ZIP_RAW_SCHEMA).withColumnsRenamed({"Zip Code": "zip_code",
                                                                      "Population": "population"})


def read_data_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, DICTIONARY_SCHEMA, encoding="windows-1252")


def write_data_dictionary(df: DataFrame, path: str) -> None:
    """A dictionary as the source has it: windows-1252, one file (a row per field of a table)."""
    src, dst = _cp1252_fix()
    rows = df.select(*[F.translate(F.col(f"`{c}`"), dst, src).alias(c) for c in df.columns])
    rows.coalesce(1).write.mode("overwrite").options(**_CSV_OPTIONS).option("encoding", "ISO-8859-1").csv(path)


def data_dictionary(spark: SparkSession, tables: dict[str, T.StructType]) -> DataFrame:
    """``(Table, Field, Description)`` of the given schemas."""
    rows = [(t, f.name, f"{f.name} – {f.dataType.simpleString()}") for t, schema in tables.items() for f in schema.fields]
    return spark.createDataFrame(rows, DICTIONARY_SCHEMA)


def read_enhanced(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The integrated table; without a ``churn`` column the target is derived from the
    customer status, and without either a ``ValueError`` is raised."""
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.options(**_CSV_OPTIONS) \
        .option("inferSchema", "true").csv(path)
    if "churn" in df.columns:
        return df
    if "customer_status" in df.columns:
        return target_from_status(df)
    raise ValueError("the table has neither a churn column nor a customer_status to derive it from")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").parquet(path)
