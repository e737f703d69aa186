"""Boosting rounds as one job a level, forests on blocks."""

import numpy as np
from pyspark.sql import functions as F

from churnspark.operators import boosting, forest, ml
from churnspark.plans import lineage


def people(spark, n=600):
    i = F.col("customer_id")
    z = F.pmod(F.xxhash64(i, F.lit(3)), F.lit(1000)) / 1000
    df = spark.range(n).withColumnRenamed("id", "customer_id").select(i, F.when(i % 7 != 0, F.concat(F.lit("p"), (i % 3).cast("string"))).alias("plan"),
                               F.concat(F.lit("z"), (i % 40).cast("string")).alias("zone"), (i % 2).cast("int").alias("senior"),
                               F.when(i % 31 != 0, (i % 97).cast("double")).alias("charges"), (i % 11).alias("calls"))
    return df.withColumn("churn_flag", (z < F.when(i % 3 == 1, 0.7).otherwise(0.2) + F.when(i % 97 > 60, 0.2).otherwise(0.0)).cast("int"))


def prepared(spark, name, n=600):
    return ml.prepare_modeling_data(lineage.materialize(people(spark, n), f"people_{name}"), name)


def jobs(spark, group, fn):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = fn()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group)), out


def test_a_level_is_one_job(spark):
    table, spec = prepared(spark, "levels")
    design = ml.boosting_design(table, spec)
    a, _ = jobs(spark, "one round", lambda: boosting.fit_boosted(design, spec.encoder, boosting.BoostParams(rounds=1, depth=3)))
    b, model = jobs(spark, "four rounds", lambda: boosting.fit_boosted(design, spec.encoder, boosting.BoostParams(rounds=4, depth=3)))
    assert len(model.trees) == 4 and b - a <= 3 * 3  # a tree may be done before its last level


def test_blocks_grow_the_trees_of_the_table(spark, monkeypatch):
    table, spec = prepared(spark, "both")
    design, params = ml.boosting_design(table, spec), boosting.BoostParams(rounds=3, depth=2, bins=16)
    monkeypatch.setattr(boosting, "MANY_LEVELS", 0)
    want = boosting.fit_boosted(design, spec.encoder, params)
    monkeypatch.setattr(boosting, "MANY_LEVELS", 4096)
    monkeypatch.setattr(boosting, "FOLD_EVERY", 2)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 100)
    for collected in (0, 1 << 20):
        monkeypatch.setattr(boosting, "COLLECTED_BYTES", collected)
        got = boosting.fit_boosted(design, spec.encoder, params)
        for a, b in zip(want.trees, got.trees, strict=True):
            assert a.feature.tolist() == b.feature.tolist() and a.bin.tolist() == b.bin.tolist() and np.allclose(a.weight, b.weight)


def test_joint_sums_are_those_of_each_column(spark):
    _, spec = prepared(spark, "joint")
    columns, edges, bins = boosting._Columns(spec.encoder), [np.arange(k) + 0.5 for k in (1, 30, 0)], 32
    joint, rng = boosting._Joint(columns, edges, bins), np.random.default_rng(1)
    assert columns.p == 3 and len(joint.groups) < sum(w > 1 for w in joint.width)
    codes = np.stack([rng.integers(0, w, 500) for w in joint.width]).astype(columns.dtype)
    node, g, h = rng.integers(0, 4, 500), rng.random(500), rng.random(500)
    packed = joint.codes(codes)
    sums = [np.stack([np.bincount(node * w + c, weights=x, minlength=4 * w) for x in (g, h)])
            for w, c in zip([*joint.wide, 1], [*packed, np.zeros(500, dtype=int)])]
    got = joint.spread(sums, 4)
    for r, w in enumerate(joint.width):
        for c in range(0 if r < 3 else 1, w if w > 1 else 0):
            cell = r * bins + c if r < 3 else int(columns.start[r - 3]) - 3 + 3 * bins + c - 1
            assert np.allclose(got[0, :, cell], [g[(node == k) & (codes[r] == c)].sum() for k in range(4)])
    assert np.allclose(got[1, :, -1], np.bincount(node, weights=h))


def test_margins_are_kept_or_made_again(spark, monkeypatch):
    _, spec = prepared(spark, "kept")
    columns, rng = boosting._Columns(spec.encoder), np.random.default_rng(2)
    codes = np.stack([rng.integers(0, 2, 50) for _ in range(columns.rows)]).astype(columns.dtype)
    trees = [boosting.Tree(np.array([0, -1, -1]), np.array([1, 0, 0]), np.array([0.0, -0.5 * k, 0.25])) for k in range(1, 5)]
    want = boosting._margins(trees, codes, columns)
    for most in (1 << 20, 0):
        monkeypatch.setattr(boosting, "KEPT_BYTES", most)
        for n in (1, 3, 2, 4, 4):
            got = boosting._kept_margin("fit", 0, np.zeros(50), trees[:n], codes, columns)
        assert np.allclose(got, want)
        boosting._KEPT.clear()


# ---------------------------------------------------------------- forests
def gini(rows, label, times):
    n, ones = times[rows].sum(), (times * label)[rows].sum()
    return 2 * ones * (n - ones) / n if n else 0.0


def test_forest_equals_plain_trees(spark, monkeypatch):
    table, spec = prepared(spark, "forest", 500)
    design, params = ml.boosting_design(table, spec), forest.ForestParams(trees=3, depth=4, bins=8)
    grown = []
    for piece, most, rows in ((64, 1, 100), (forest.PIECE, forest.PASS_BYTES, boosting.ROWS_PER_TASK)):  # several blocks and passes, or one
        monkeypatch.setattr(forest, "PIECE", piece)
        monkeypatch.setattr(forest, "PASS_BYTES", most)
        monkeypatch.setattr(boosting, "ROWS_PER_TASK", rows)
        grown.append(forest.fit_forest(design, spec.encoder, params))
    for a, b in zip(grown[0].trees, grown[1].trees, strict=True):
        assert a.feature.tolist() == b.feature.tolist() and a.bin.tolist() == b.bin.tolist() and np.allclose(a.weight, b.weight)
    model, p, width = grown[0], len(spec.encoder.numeric), spec.encoder.width
    data = design.withColumn("deal", F.xxhash64("customer_id")).collect()
    label, deal = np.array([r["label"] for r in data], dtype=float), np.array([r["deal"] for r in data])
    x = np.zeros((len(data), width), dtype=int)
    for i, r in enumerate(data):
        x[i, :p], x[i, r["levels"]] = [np.searchsorted(e, v) for e, v in zip(model.edges, r["numeric"])], 1
    want, lowered = np.zeros(len(data)), np.zeros(width)
    for number, tree in enumerate(model.trees):
        times, own = forest.draws(deal, params.seed, number).astype(float), np.zeros(width)
        alive = {0: np.ones(len(data), dtype=bool)}
        for depth in range(params.depth + 1):
            open_ = [at for at in sorted(alive) if at >= 2 ** depth - 1 and gini(alive[at], label, times) > 0] if depth else [0]
            dice = np.random.default_rng([params.seed, depth, number])
            drawn = forest._drawn(dice, len(open_), width, int(np.ceil(np.sqrt(width))))
            for at, features in zip(open_, drawn):
                rows = alive[at]
                cuts = [(gini(rows, label, times) - gini(rows & (x[:, f] < b), label, times) - gini(rows & (x[:, f] >= b), label, times), f, b)
                        for f in features for b in (range(1, 8) if f < p else (1,))]
                best = max(c[0] for c in cuts)
                if depth == params.depth or best <= 1e-9:
                    assert tree.feature[at] == -1
                    continue
                f, b = tree.feature[at], tree.bin[at]
                assert next(c[0] for c in cuts if c[1:] == (f, b)) >= best - 1e-7
                own[f] += best
                alive[2 * at + 1], alive[2 * at + 2] = rows & (x[:, f] < b), rows & (x[:, f] >= b)
        for at, rows in alive.items():
            if tree.feature[at] == -1:
                want[rows] += (times * label)[rows].sum() / times[rows].sum() / params.trees
        lowered += own / own.sum()
    assert np.allclose(model.importances, lowered / lowered.sum(), atol=1e-6)
    got = {r["customer_id"]: r["churn_probability"] for r in ml.ForestModel(spec, model).score(table).collect()}
    assert np.allclose([got[r["customer_id"]] for r in data], want, atol=1e-9)


def test_large_tables_are_fitted_on_blocks(spark, monkeypatch):
    """Written and kept are packed codes, not a draw and a node for each row and tree; the forest is as good as that of pyspark.ml."""
    table, spec = prepared(spark, "large", 2000)
    monkeypatch.setattr(ml, "FOREST_ROWS", 1999)
    written = lineage._WRITTEN[spark.sparkContext.applicationId]
    before = len(written)
    model = ml.train_random_forest(table, spec, num_trees=20, max_depth=6)
    assert isinstance(model.forest, forest.BlockForest) and len(model.forest.trees) == 20 and len(written) == before
    monkeypatch.setattr(ml, "FOREST_ROWS", 2000)
    other = ml.train_random_forest(table, spec, num_trees=20, max_depth=6)
    a, b = (ml.roc_auc(ml.score_churn(m, table)).first().auc for m in (model, other))
    assert a > 0.7 and abs(a - b) < 0.03
    top = ml.feature_importance(model).collect()
    assert len(top) == 15 and top[0]["feature"] in ("plan_p1", "charges") and sum(r["importance"] for r in model.importance().collect()) > 0.999


def test_draws(spark):
    deal = np.random.default_rng(4).integers(-2 ** 63, 2 ** 63 - 1, 100_000)
    times = forest.draws(deal, 42, 3)
    assert abs(times.mean() - 1) < 0.02 and abs((times == 0).mean() - np.exp(-1)) < 0.01 and abs(times.var() - 1) < 0.05
    assert abs(np.corrcoef(times, forest.draws(deal, 42, 4))[0, 1]) < 0.02
    same = forest._own(np.full(50_000, 42))  # rows without a key
    assert len(np.unique(same)) == 50_000 and abs(forest.draws(same, 42, 0).mean() - 1) < 0.03
    assert np.array_equal(forest._own(np.arange(9)), np.arange(9)) and len(forest._own(np.arange(0))) == 0


def test_wide_columns_and_empty_tables_in_a_forest(spark):
    table, spec = prepared(spark, "wide_forest")
    design = ml.boosting_design(table, spec)
    few = forest.fit_forest(design, spec.encoder, forest.ForestParams(trees=4, depth=4, bins=16))  # zones: 39 features, more than bins
    many = forest.fit_forest(design, spec.encoder, forest.ForestParams(trees=4, depth=4, bins=64))
    assert any((t.feature >= 3).any() for t in few.trees) and len(few.importances) == spec.encoder.width
    for a, b in zip(few.trees, many.trees, strict=True):
        if 0 <= a.feature[0] < 3 or 0 <= b.feature[0] < 3:
            continue
        assert a.feature[0] == b.feature[0]  # a level's split does not depend on how its column is counted
    none = forest.fit_forest(design.limit(0), spec.encoder, forest.ForestParams(trees=2, depth=2))
    assert all((t.feature == -1).all() for t in none.trees)
