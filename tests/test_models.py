"""Sparse encoding, Newton steps and histogram boosting against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnspark.operators import boosting, encoding, ml
from churnspark.plans.lineage import materialize
from churnspark.plans.session import table_path

CITIES = 5000


def customers(spark, rows=15000, cities=CITIES):
    """A third of the customers in one city, the others over thousands; cities, plan and age decide on churn."""
    i = F.col("id")
    u = F.pmod(F.xxhash64(i, F.lit(7)), F.lit(10_000)) / 10_000
    city = F.when(i % 3 == 0, F.lit("metropolis")).when(i % 49 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("city "), (i % cities).cast("string")))
    df = spark.range(rows).select(
        i.alias("customer_id"), city.alias("city"), F.when(i % 4 == 0, "a").when(i % 4 == 1, "b").when(i % 4 == 2, "c").alias("plan"),
        F.pmod(F.xxhash64(i, F.lit(1)), F.lit(80)).cast("double").alias("age"), (i % 7).alias("calls"), F.lit(3).alias("same"), u.alias("u"))
    z = F.when(F.col("city") == "metropolis", 1.0).otherwise(0.0) + F.when(F.col("plan") == "b", 0.8).otherwise(-0.4) - F.col("age") / 60
    return df.withColumn("churn_flag", (F.col("u") < 1 / (1 + F.exp(-z))).cast("int")).drop("u")


def prepared(spark, name, **more):
    df = materialize(customers(spark, **more), f"customers_{name}")
    table, spec = ml.prepare_modeling_data(df, name)
    return df, table, spec


@pytest.fixture(scope="module")
def wide(spark):
    return prepared(spark, "wide")


@pytest.fixture(scope="module")
def narrow(spark):
    return prepared(spark, "narrow", rows=3000, cities=20)


def dense(spec, df):
    """Features of each customer as dictionaries, one-hot encoded in plain Python."""
    rows = spec.filled(df).collect()
    names = {r["feature"]: r["name"] for r in spec.encoder.names().collect()}
    levels = {c: sorted({r[c] for r in rows if r[c] is not None}) for c in spec.encoder.sizes}
    want_names = [*spec.encoder.numeric, *[f"{c}_{v}" for c, vs in levels.items() for v in vs[1:]]]
    assert [names[i] for i in range(len(names))] == want_names
    at = {n: i for i, n in enumerate(want_names)}
    return {r["customer_id"]: sorted(at[f"{c}_{r[c]}"] for c, vs in levels.items() if r[c] in vs[1:]) for r in rows}


def test_sparse_encoding(spark, wide):
    df, table, spec = wide
    assert spec.encoder.width > CITIES - 10 and spec.encoder.sizes["city"] > encoding.MAP_LEVELS
    got = {r["customer_id"]: r for r in spec.encoder.encode(spec.filled(table), ["customer_id"]).collect()}
    want = dense(spec, df)
    assert {i: r["levels"] for i, r in got.items()} == want
    assert all(len(r["numeric"]) == 3 for r in got.values())


def test_unseen_null_and_absent_levels_are_all_zero(spark, wide):
    _, _, spec = wide
    new = spark.createDataFrame([(1, "nowhere", "a", 1.0), (2, None, None, None), (3, "metropolis", "c", 2.0)],
                                "customer_id long, city string, plan string, age double")
    rows = {r["customer_id"]: r for r in spec.encoder.encode(new, ["customer_id"]).collect()}
    names = {r["feature"]: r["name"] for r in spec.encoder.names().where("name like 'plan%' or name = 'city_metropolis'").collect()}
    assert rows[1]["levels"] == [] and rows[2]["levels"] == []
    assert [names[i] for i in rows[3]["levels"]] in (["city_metropolis", "plan_c"], ["plan_c", "city_metropolis"])
    assert rows[1]["numeric"] == [1.0, 0.0, 0.0] and rows[2]["numeric"] == [0.0, 0.0, 0.0]


def test_encoder_is_stored_with_the_model(spark, wide):
    _, table, spec = wide
    path = table_path(spark, "encoder_probe")
    spec.save(path)
    back = ml.FeatureSpec.load(spark, path)
    assert (back.encoder.numeric, back.encoder.sizes, back.encoder.rows) == (spec.encoder.numeric, spec.encoder.sizes, spec.encoder.rows)
    a, b = (x.encoder.encode(x.filled(table), ["customer_id"]).collect() for x in (spec, back))
    assert sorted(a) == sorted(b)


def test_vectors_equal_the_sparse_rows(spark, wide):
    _, table, spec = wide
    rows = spec.encoder.vectors(spec.filled(table)).join(spec.encoder.encode(spec.filled(table), ["customer_id"]), "customer_id").limit(500).collect()
    for r in rows:
        full = np.zeros(spec.encoder.width)
        full[:3], full[r["levels"]] = r["numeric"], 1.0
        assert np.array_equal(r["features"].toArray(), full)


def matrix(spec, table):
    rows = spec.encoder.encode(spec.filled(ml.with_class_weight(table)).withColumnRenamed(ml.LABEL, "label"), ["label", "weight", "customer_id"]).collect()
    x = np.zeros((len(rows), spec.encoder.width))
    for k, r in enumerate(rows):
        x[k, :len(r["numeric"])], x[k, r["levels"]] = r["numeric"], 1.0
    return x, np.array([float(r["label"]) for r in rows]), np.array([r["weight"] for r in rows])


def gradient(x, y, w, intercept, b, c=0.8):
    q = 1 / (1 + np.exp(-(intercept + x @ b)))
    return x.T @ (w * (q - y)) + b / c, float(np.sum(w * (q - y)))


def test_newton_steps_end_at_the_optimum(spark, narrow):
    _, table, spec = narrow
    model = ml.train_logistic(ml.with_class_weight(table), spec)
    x, y, w = matrix(spec, table)
    g, g0 = gradient(x, y, w, model.fit.intercept, model.fit.coefficients)
    assert np.abs(g).max() < 1e-6 and abs(g0) < 1e-6
    assert np.abs(model.fit.gradient).max() < 1e-9
    scored = {r["customer_id"]: r["churn_probability"] for r in model.score(table).collect()}
    assert len(scored) == len(y)


def test_wide_logistic_trains(spark, wide):
    """5 000 cities: L-BFGS on sparse vectors, scored from the coefficient table."""
    df, table, spec = wide
    model = ml.train_logistic(ml.with_class_weight(table), spec)
    assert model.fit is None
    x, y, w = matrix(spec, table)
    table_of = {r["feature"]: r["coefficient"] for r in model.linear.table.collect()}
    b = np.array([table_of[i] for i in range(spec.encoder.width)])
    g, _ = gradient(x, y, w, table_of[-1], b)
    assert np.abs(g).max() / w.sum() < 1e-3
    scored = model.score(df.drop("churn_flag"))
    assert scored.columns == [*[c for c in df.columns if c != "churn_flag"], "churn_probability"]
    assert scored.where("churn_probability between 0 and 1").count() == len(y)
    assert ml.roc_auc(scored.join(df.select("customer_id", "churn_flag"), "customer_id")).first().auc > 0.7


def test_scores_equal_the_formula(spark, narrow):
    _, table, spec = narrow
    model = ml.train_logistic(ml.with_class_weight(table), spec)
    rows = spec.encoder.encode(spec.filled(table), ["customer_id"]).collect()
    b, b0 = model.fit.coefficients, model.fit.intercept
    p = len(spec.encoder.numeric)
    want = {r["customer_id"]: 1 / (1 + np.exp(-(b0 + np.dot(r["numeric"], b[:p]) + b[r["levels"]].sum()))) for r in rows}
    for r in model.score(table).collect():
        assert r["churn_probability"] == pytest.approx(want[r["customer_id"]], abs=1e-12)


def test_logistic_without_rows_or_with_one_class(spark, narrow):
    _, table, spec = narrow
    one = ml.train_logistic(table.where("churn_flag = 0").withColumn("weight", F.lit(1.0)), spec)
    assert one.score(table).agg(F.max("churn_probability")).first()[0] < 0.5
    none = ml.train_logistic(table.limit(0).withColumn("weight", F.lit(1.0)), spec)
    assert {round(r["churn_probability"], 12) for r in none.score(table).limit(5).collect()} == {0.5}


# ---------------------------------------------------------------- boosting
def plain_boosting(x, numbers, y, keys, edges, params):
    """Margins after the rounds, trees grown on binned rows one node at a time."""
    bins = np.stack([np.searchsorted(edges[i], x[:, i], "left") if i < numbers else x[:, i] for i in range(x.shape[1])], axis=1)
    margin = np.zeros(len(y))
    for turn in range(params.rounds):
        drawn = boosting._sampled(keys, params.seed, turn, params.subsample)
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)

        def grow(rows, depth, weight):
            """Adds the leaf weights of a node to ``rows`` (all rows), split by what was drawn."""
            use = rows & drawn
            total_g, total_h = g[use].sum(), h[use].sum()
            best = (1e-12, None, None)
            if depth < params.depth:
                for f in range(x.shape[1]):
                    for b in (range(1, params.bins) if f < numbers else (1,)):
                        left = use & (bins[:, f] < b)
                        lg, lh = g[left].sum(), h[left].sum()
                        rg, rh = total_g - lg, total_h - lh
                        if lh >= 1 and rh >= 1:
                            gain = (lg * lg / (lh + 1) + rg * rg / (rh + 1) - total_g ** 2 / (total_h + 1)) / 2
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, f, b)
            if best[1] is None:
                margin[rows] += -params.rate * total_g / (total_h + 1)
                return
            for side in (bins[:, best[1]] < best[2], bins[:, best[1]] >= best[2]):
                grow(rows & side, depth + 1, None)

        grow(np.ones(len(y), dtype=bool), 0, None)
    return margin


@pytest.mark.parametrize("many", [boosting.MANY_LEVELS, 0], ids=["collected", "best level per node in the table"])
def test_boosting_equals_plain_trees(spark, narrow, monkeypatch, many):
    monkeypatch.setattr(boosting, "MANY_LEVELS", many)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 700)
    monkeypatch.setattr(boosting, "WRITE_MARGIN_EVERY", 2)
    _, table, spec = narrow
    params = boosting.BoostParams(rounds=4, depth=3, bins=8)
    design = ml.boosting_design(table, spec)
    model = boosting.fit_boosted(design, spec.encoder, params)
    x, y, _ = matrix(spec, table)
    rows = {r["customer_id"]: r["k"] for r in design.select("customer_id", F.xxhash64("customer_id").alias("k")).collect()}
    order = [r["customer_id"] for r in spec.encoder.encode(spec.filled(ml.with_class_weight(table)), ["customer_id"]).collect()]
    keys = np.array([rows[i] for i in order])
    numbers = len(spec.encoder.numeric)
    for i in range(numbers):
        v = np.sort(x[:, i])
        n = len(v)
        want = sorted({e for e in np.unique(v) if e < v[-1] and
                       np.searchsorted(v, e, "right") * 8 // n > np.searchsorted(v, e, "left") * 8 // n})
        assert model.edges[i].tolist() == want
    margin = plain_boosting(x, numbers, y, keys, model.edges, params)
    got = {r["customer_id"]: r["churn_probability"] for r in ml.TreesModel(spec, model).score(table).collect()}
    assert np.allclose([got[i] for i in order], 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_boosting_of_a_wide_table(spark, wide):
    df, table, spec = wide
    model = ml.train_boosted_trees(table, spec, boosting.BoostParams(rounds=15))
    scored = ml.score_churn(model, df)
    assert ml.roc_auc(scored).first().auc > 0.7
    top = {r["feature"] for r in ml.feature_importance(model, 3).collect()}
    assert "city_metropolis" in top


def test_boosting_of_nothing(spark, narrow):
    _, table, spec = narrow
    model = ml.train_boosted_trees(table.limit(0), spec, boosting.BoostParams(rounds=2))
    assert {r["churn_probability"] for r in model.score(table).limit(3).collect()} == {0.5}
