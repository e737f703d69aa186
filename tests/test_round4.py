"""Work in proportion to the input: profiles of customers, running counts, partitions by rows, blocks of boosting."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnspark import registry
from churnspark.operators import boosting, definitions, density, experiments, features, ml
from churnspark.plans import lineage, ordering, partitions
from churnspark.sources import fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def people(spark, n=600):
    i = F.col("id")
    return spark.range(n).select(i.alias("customer_id"), F.when(i % 7 != 0, F.concat(F.lit("p"), (i % 3).cast("string"))).alias("plan"),
                                 (i % 2).cast("int").alias("senior"), (i % 11).cast("double").alias("monthly_charges"), ((i % 5) / 5).alias("churn_probability"),
                                 (i % 13).cast("double").alias("clv"), (i % 4 == 0).cast("int").alias("churn_flag"))


WANTED = [("none", None, None), ("plan", "plan", "p1"), ("both", "plan", "p2"), ("both", "senior", "1"), ("nobody", "plan", "p9"), ("unknown", "x", "1")]


def test_definitions_join_profiles(spark):
    df = people(spark)
    d = spark.createDataFrame(WANTED, "definition string, column_name string, value string")
    alike = definitions.profiles(df, d, [F.count(F.lit(1)).alias("_n")])
    assert alike.count() == df.select("plan", "senior").distinct().count() == 8
    got = {r[0]: r[1] for r in definitions.segment_members(alike, d).groupBy("definition").agg(F.sum("_n")).collect()}
    assert got == {r[0]: r[1] for r in definitions.segment_members(df, d).groupBy("definition").count().collect()}
    assert definitions.segment_members(definitions.profiles(df.limit(0), d.limit(1), [F.count(F.lit(1)).alias("_n")]), d.limit(1)).count() == 0


def test_roi_of_profiles_is_that_of_customers(spark):
    df = people(spark)
    d = spark.createDataFrame(WANTED, "definition string, column_name string, value string")
    p = d.select("definition").distinct().select("definition", F.lit(3.0).alias("cost_per_customer"), F.lit(0.2).alias("retention_rate"))
    got = {r.definition: r for r in definitions.segment_roi(df, d, p).collect()}
    from churnspark.operators.retention import retention_roi
    want = {r.definition: r for r in retention_roi(definitions.segment_members(df, d), ["definition"], p).collect()}
    assert set(got) == set(want) and len(got) == 5
    for k, r in want.items():
        assert got[k].customers_targeted == r.customers_targeted
        assert [x is None for x in got[k]] == [x is None for x in r]
        assert np.allclose([x for x in got[k][2:] if x is not None], [x for x in r[2:] if x is not None])
    both = [r for r in df.collect() if r.plan == "p2" and r.senior == 1]
    assert got["both"].customers_targeted == len(both) and got["both"].avg_customer_clv == pytest.approx(np.mean([r.clv for r in both]))


def test_running_counts_of_ranges(spark):
    rows = [(i, (i * 7919) % 1000, None if i % 10 == 3 else f"v{i % 4}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, o long, g string").repartition(5)
    got = ordering.counted_order(df, ["o", "id"], ["g"], num_partitions=4).collect()
    offsets, seen = Counter(), Counter()
    for r in sorted(got, key=lambda r: (r.o, r.id)):
        if r.g is None:
            assert r._n0 is None
            continue
        if r._n0 == 0:
            offsets[r._part, r.g] = seen[r.g]
        assert offsets[r._part, r.g] + r._n0 == seen[r.g]
        seen[r.g] += 1
    assert len(got) == 3000 and len({r._part for r in got}) == 4


def test_assignment_sorts_customers_once(spark):
    df = people(spark).withColumnsRenamed({"plan": "contract"})
    assigned = experiments.assign_systematic(df)
    assert "Window" not in plan(assigned) and "Sort" not in plan(assigned)
    per = {k: sorted(r.position for r in assigned.collect() if (r.segment_type, r.segment_value) == k) for k in [("Contract Type", "p1"), ("All Customers",) * 2]}
    assert all(v == list(range(len(v))) and v for v in per.values())


def test_derived_tables_get_partitions_by_rows(spark, sf_small, monkeypatch):
    monkeypatch.setattr(partitions, "ROWS_PER_TASK", 100)
    before, seen = spark.conf.get(partitions.SETTING), []
    fixtures.stored(spark, "probe", sf_small, lambda: seen.append(int(spark.conf.get(partitions.SETTING))) or spark.range(3))
    assert seen[0] > 2 * int(before) and spark.conf.get(partitions.SETTING) == before
    with pytest.raises(ZeroDivisionError), partitions.shuffle_partitions(spark, 10 ** 6):
        1 / 0
    assert spark.conf.get(partitions.SETTING) == before


def test_zip_counts_leave_customers_where_they_are(spark):
    df = people(spark).withColumns({"zip_code": F.col("customer_id") % 9, "population": F.lit(100)})
    out = features.geo_features(df)
    assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
    assert {r.customers_in_zip for r in out.collect()} == {66, 67}


def test_value_counts_are_computed_once(spark):
    df = people(spark).withColumns({"risk_segment": F.lit("a"), "contract": F.lit("c"), "internet_service": F.lit("d"), "tenure_group": F.lit(0), "payment_method": F.lit("p")})
    counts = density.value_counts(df, "monthly_charges")
    assert "Range" not in plan(counts) and counts.count() == 11 * 6


def test_batches_of_many_files(spark, sf_small, monkeypatch):
    want = sorted(map(tuple, registry.QUERIES["kept_reports"](spark, sf_small).collect()))
    monkeypatch.setattr(registry, "ROWS_PER_TASK", 50)
    paths = []
    plain = registry.table_path
    monkeypatch.setattr("churnspark.plans.session.table_path", lambda s, n: paths.append(plain(s, n)) or paths[-1])
    assert sorted(map(tuple, registry.QUERIES["kept_reports"](spark, sf_small).collect())) == want
    arriving = next(p for p in paths if "arriving_" in p)
    store = next(p for p in paths if "kept_" in p)
    assert spark.read.parquet(arriving).select(F.input_file_name()).distinct().count() > 5
    assert spark.read.parquet(f"{store}/parts").select("batch").distinct().count() == 5


def test_boosting_reads_blocks(spark):
    df = lineage.materialize(people(spark, 3000).drop("churn_probability"), "blocks_people")
    table, spec = ml.prepare_modeling_data(df, "blocks")
    design = ml.boosting_design(table, spec)
    edges = boosting.bin_edges(design, len(spec.encoder.numeric))
    blocks = boosting.binned(design, edges, spec.encoder, "customer_id")
    columns = boosting._Columns(spec.encoder)
    assert blocks.count() == 1  # of 3 000 rows
    (label, deal, margin, codes), = boosting._blocks([blocks.toArrow().combine_chunks().to_batches()[0]], columns)
    by = {r.k: r for r in design.withColumn("k", F.xxhash64("customer_id")).collect()}
    assert len(by) == len(deal) == 3000 and not margin.any()
    for j in range(0, 3000, 97):
        r = by[deal[j]]
        assert label[j] == r.label and codes[:columns.p, j].tolist() == [int(np.searchsorted(e, x)) for e, x in zip(edges, r.numeric)]
        held = [int(s + c - 1) for s, c in zip(columns.start, codes[columns.p:, j]) if c]
        assert held == r.levels


def test_one_scoring_for_both_areas(spark, sf_small):
    before = len(lineage._WRITTEN[spark.sparkContext.applicationId])
    out = registry.QUERIES["train_logistic"](spark, sf_small)
    written = lineage._WRITTEN[spark.sparkContext.applicationId][before:]
    assert sum("/scored_" in p for p in written) == 1 and out.count() == 1


def test_forest_keeps_the_nodes_of_rows(spark):
    df = lineage.materialize(people(spark, 400).drop("churn_probability"), "forest_people")
    table, spec = ml.prepare_modeling_data(df, "forest")
    model = ml.train_random_forest(table, spec, num_trees=2, max_depth=3)
    assert model.forest.getCacheNodeIds() and model.forest.getNumTrees == 2
