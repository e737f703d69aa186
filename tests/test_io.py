"""CSV sources: schema-first readers, blanks survive, cp1252 dictionary, target derivation."""

import pytest

from churnspark.plans.session import table_path
from churnspark.sources import io


def test_blank_charge_round_trip(spark):
    rows = [(1, "Male", 0, "Yes", "No", 0, "Yes", "No", "DSL", "No", "No", "No", "No", "No", "No", "Month-to-month",
             "Yes", "Mailed check", 20.5, " ", "No")]
    df = spark.createDataFrame(rows, io.SUBSCRIPTION_SCHEMA)
    path = table_path(spark, "io_subs")
    io.write_csv(df, path)
    back = io.read_subscriptions(spark, path).first()
    assert back.total_charges == " " and back.monthly_charges == 20.5


def test_dictionary_windows_1252(spark, tmp_path):
    p = tmp_path / "dict.csv"
    p.write_bytes("Table,Field,Description\nCRM,City,Caf\u00e9 \u201cdistrict\u201d \u20ac\n".encode("cp1252"))
    assert io.read_data_dictionary(spark, str(p)).first().Description == "Caf\u00e9 \u201cdistrict\u201d \u20ac"


def test_read_enhanced_requires_target(spark):
    path = table_path(spark, "io_enh")
    spark.createDataFrame([(1, "x")], "customer_id long, other string").write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError):
        io.read_enhanced(spark, path)
