"""Many definitions, automatic bins and densities, normal tails, quarantined rows, kept reports."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnspark.functions.numeric import erfc, two_sided_p
from churnspark.operators import clean, definitions, density
from churnspark.plans.session import table_path
from churnspark.sources import fixtures, io, quarantine, views
from churnspark.streaming import reports as kept


# ---------------------------------------------------------------- definitions
def test_definitions_equal_one_filter_each(spark, sf_small):
    b = fixtures.base_subscriptions(spark, sf_small).withColumn("tenure_group", (F.col("tenure") % 6).cast("int"))
    wanted = {"none": {}, "unknown": {"not_a_column": "x"}, "one": {"contract": "Two year"}, "nobody": {"contract": "Ten years"},
              "three": {"contract": "Month-to-month", "internet_service": "Fiber optic", "gender": "Male"},
              "number": {"senior_citizen": 1}, "number as text": {"senior_citizen": "1", "not_a_column": "x"}, "label": {"tenure_group": "0-1 year"},
              "code": {"tenure_group": 3}, "no number": {"tenure": "x"}}
    rows = [(k, c, str(v)) for k, d in wanted.items() for c, v in d.items()] + [("none", None, None), ("one", "contract", "Two year"),
            ("two values", "contract", "One year"), ("two values", "contract", "Two year"), ("null", "contract", None)]
    got = definitions.segment_members(b, spark.createDataFrame(rows, "definition string, column_name string, value string"))
    assert got.columns == ["definition", *b.columns]
    found = {}
    for r in got.select("definition", "customer_id").collect():
        found.setdefault(r["definition"], []).append(r["customer_id"])
    for k, d in wanted.items():
        want = [] if k == "no number" else [r["customer_id"] for r in clean.segment_filter(b, d).select("customer_id").collect()]
        assert sorted(found.get(k, [])) == sorted(want), k
    assert "two values" not in found and "null" not in found


def test_roi_of_definitions_without_customers(spark):
    df = spark.createDataFrame([(1, "a", 10.0, 1), (2, "b", 20.0, 0)], "customer_id long, contract string, monthly_charges double, churn_flag int")
    d = spark.createDataFrame([("a", "contract", "a"), ("z", "contract", "z"), ("all", None, None)], "definition string, column_name string, value string")
    p = spark.createDataFrame([("a", 5.0, 0.5), ("z", 5.0, 0.5), ("all", 0.0, 0.5)], "definition string, cost_per_customer double, retention_rate double")
    r = {x["definition"]: x for x in definitions.segment_roi(df, d, p).collect()}
    assert (r["a"].customers_targeted, r["z"].customers_targeted, r["all"].customers_targeted) == (1, 0, 2)
    assert r["z"].estimated_roi == 0.0 and r["a"].estimated_roi == pytest.approx((10 * 12 * 0.5 - 5) / 5) and r["all"].estimated_roi == 0.0


# ---------------------------------------------------------------- bins and densities
def valued(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v), "High Risk" if i % 2 else None, "c", "DSL", 0, "p") for i, v in enumerate(values)],
                                 "customer_id long, monthly_charges double, risk_segment string, contract string, internet_service string, "
                                 "tenure_group int, payment_method string")


@pytest.mark.parametrize("values", [np.random.default_rng(1).gamma(2.0, 20.0, 900), [1, 1, 1, 1, 1, 1, 1, 2], [5.0], [3, 3, 3], [0, 0.25, 0.5, 0.75, 1.0, None]],
                         ids=["gamma", "IQR 0", "one", "equal", "edges"])
def test_automatic_bins_are_numpys(spark, values):
    got = [r for r in density.automatic_histogram(valued(spark, values)).where("segment_type = 'All Customers'").orderBy("bin").collect()]
    known = np.array([v for v in values if v is not None], dtype=float)
    n, edges = np.histogram(known, bins="auto")
    assert [r["customer_count"] for r in got] == n.tolist()
    assert np.allclose([r["low"] for r in got], edges[:-1]) and np.allclose([r["high"] for r in got], edges[1:])


def test_density_sums_to_one_and_follows_the_values(spark):
    values = np.random.default_rng(2).normal(60, 20, 2000)
    rows = density.binned_density(valued(spark, values)).collect()
    by = {}
    for r in rows:
        by.setdefault((r["segment_type"], r["segment_value"]), []).append((r["at"], r["density"]))
    assert len(by) == 6
    for points in by.values():
        points.sort()
        step = points[1][0] - points[0][0]
        assert len(points) == density.CELLS and sum(d for _, d in points) * step == pytest.approx(1.0, abs=1e-6)
    at, d = map(np.array, zip(*by[("All Customers", "All Customers")]))
    h = values.std(ddof=1) * len(values) ** -0.2
    exact = np.exp(-0.5 * ((at[:, None] - values[None, :]) / h) ** 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))
    assert np.abs(d - exact).max() < 0.01 * exact.max()


def test_density_of_equal_values_and_nothing(spark):
    assert density.binned_density(valued(spark, [3, 3, 3])).collect() == []
    assert density.automatic_histogram(valued(spark, [None, None])).collect() == []


# ---------------------------------------------------------------- normal tails
def test_erfc_to_full_precision(spark):
    x = [i / 64 for i in range(-640, 1690)] + [0.46875, 4.0, 1e-300, -0.0]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", erfc("x").alias("e")).collect()
    for r in rows:
        assert r["e"] == pytest.approx(math.erfc(r["x"]), rel=1e-13, abs=1e-303)


def test_p_values_against_stored_ones(spark):
    # high-precision values of 2 (1 - Phi(z))
    stored = {1.0: 0.31731050786291410283, 2.0: 0.045500263896358414402, 3.0: 0.0026997960632601889, 5.0: 5.7330314375838780e-7,
              10.0: 1.5239706048321061e-23, 20.0: 5.5072482372124673e-89, 37.0: 1.1451142445424148e-299}
    rows = spark.createDataFrame([(z,) for z in stored], "z double").select("z", two_sided_p("z").alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(stored[r["z"]], rel=1e-12)
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "z double").select(two_sided_p("z").alias("p")).collect()
    assert odd[0].p is None and math.isnan(odd[1].p) and odd[2].p == 0.0


# ---------------------------------------------------------------- quarantine
ZIP = io._schema([("zip", io.L), ("population", io.D), ("name", io.S)])


def put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def test_bad_rows_are_set_apart(spark, tmp_path):
    put(tmp_path, "a.csv", 'zip,population,name\n1,10.5,x\n2, 7 ,"with, comma"\n3\n4,1,x,y,z\nfive,1,x\n6,many,x\n7,1,"open\n8,,\n')
    put(tmp_path, "b.csv", b"\xef\xbb\xbfzip,population,name\n9,1,caf\xe9\n10,2,ok\n")
    put(tmp_path, "c.csv", "population,zip,name\n1,11,x\n2,12,y\n")
    put(tmp_path, "d.csv", "zip,people,name\n13,1,x\n")
    put(tmp_path, "e.csv", "zip,population,name\n")
    read = quarantine.read_checked(spark, str(tmp_path), ZIP)
    rows = {r["zip"]: (r["population"], r["name"]) for r in read.rows.collect()}
    assert rows == {1: (10.5, "x"), 2: (7.0, "with, comma"), 8: (None, None), 10: (2.0, "ok")}
    bad = {}
    for r in read.quarantine.collect():
        bad.setdefault(r["reason"], []).append((r["file"].rsplit("/", 1)[1], r["raw"]))
    assert {k: len(v) for k, v in bad.items()} == {"short": 1, "long": 1, "value:zip": 1, "value:population": 1, "quote": 1, "charset": 1, "header": 3}
    assert bad["long"] == [("a.csv", "4,1,x,y,z")] and bad["short"] == [("a.csv", "3")]
    report = {r["file"].rsplit("/", 1)[1]: r for r in read.report.collect()}
    assert {k: (r["header"], r["row_count"], r["bad_rows"]) for k, r in report.items()} == {
        "a.csv": ("as declared", 8, 5), "b.csv": ("as declared", 2, 1), "c.csv": ("another order", 2, 2),
        "d.csv": ("missing: population; unknown: people", 1, 1), "e.csv": ("as declared", 0, 0)}
    assert report["a.csv"]["reasons"] == {"short": 1, "long": 1, "value:zip": 1, "value:population": 1, "quote": 1}
    sink = table_path(spark, "quarantine_sink")
    read.write_quarantine(sink)
    assert spark.read.parquet(sink).count() == 9


# ---------------------------------------------------------------- kept reports
def report_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_kept_reports_after_replay_and_compaction(spark, sf_small):
    from churnspark.operators import reports
    a = views.analysis(spark, sf_small)
    source, store = table_path(spark, "kept_source"), table_path(spark, "kept_store")
    a.where("customer_id % 3 > 0").repartition(3).write.mode("overwrite").parquet(source)
    kept.start_report_stream(spark, source, a.schema, store, f"{store}/checkpoint", 1).awaitTermination()
    first = kept.stored(spark, store)
    assert first.where("report = 'overall'").first().customers == a.where("customer_id % 3 > 0").count()
    kept.compact(spark, store, 1)
    a.where("customer_id % 3 = 0").write.mode("append").parquet(source)
    kept.start_report_stream(spark, source, a.schema, store, f"{store}/checkpoint", 1).awaitTermination()
    # the last batch once more, as after a failure between the sink and the checkpoint
    last = spark.read.parquet(f"{store}/parts").agg(F.max("batch")).first()[0]
    files = sorted(f for f in spark.read.parquet(source).inputFiles())
    kept.merge_batch(a.where("customer_id % 3 = 0"), last, store) if len(files) == 4 else None
    merged = kept.stored(spark, store)
    assert report_rows(kept.churn_by_city(merged, 5)) == report_rows(reports.churn_by_city(a, 5))
    columns = ["feature", "category", "segment", "churn_rate", "customer_count", "overall_churn", "relative_risk"]
    assert report_rows(kept.churn_drivers(merged).select(*columns)) == report_rows(reports.churn_drivers(a).select(*columns))


# ---------------------------------------------------------------- sketches and buckets
def test_sketches_of_parts_merge(spark):
    from churnspark.operators import sketches
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 30000).cast("double")).alias("v"),
                                   F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("w"), F.lit(None).cast("double").alias("none"), "id")
    path = table_path(spark, "sketch_probe")
    for part in (0, 1, 2, 1):
        sketches.store(df.where(F.col("id") % 3 == part), ["v", "w", "none"], path, part)
    merged = sketches.merged(spark, path)
    assert {r["column_name"]: r["n"] for r in merged.collect()} == {"v": 30000, "w": 24000}
    errors = sketches.rank_errors(df, sketches.quantiles(merged, [0.01, 0.25, 0.5, 0.9])).collect()
    assert len(errors) == 8 and all(r["rank_error"] <= sketches.RANK_ERROR for r in errors)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_and_count_need_no_exchange(spark):
    from churnspark.plans import buckets
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = buckets.write_bucketed(spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"), F.col("id").alias("x")), "probe_a", "k", 4)
        b = buckets.write_bucketed(spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("y")), "probe_b", "k", 4)
        joined = a.join(b, "k")
        assert "Exchange" not in final_plan(joined) and joined.count() == 3000
        counts = a.groupBy("k").count()
        assert "Exchange" not in final_plan(counts) and counts.count() == 5000
        spark.sql("DROP TABLE probe_a")  # the files stay
        again = buckets.attach(spark, "probe_a")
        assert "Exchange" not in final_plan(again.join(b, "k")) and again.count() == 5000
        assert buckets.manifest(spark, "probe_a").buckets == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
