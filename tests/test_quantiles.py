"""Exact distributed quantiles against numpy's linear interpolation (brute force)."""

import numpy as np

from churnspark.operators.stats import median_of, quantiles_long, quantiles_wide

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def _fixture(spark):
    rng = np.random.default_rng(1)
    # 3 groups, one of them hot (about half the rows), ties from rounding, 10 % nulls
    keys = rng.choice([0, 1, 2], size=600, p=[0.5, 0.3, 0.2])
    vals = rng.normal(size=600).round(1)
    rows = [(int(k), float(v) if rng.random() > 0.1 else None) for k, v in zip(keys, vals)]
    return rows, spark.createDataFrame(rows, "g int, v double")


def test_grouped_quantiles_match_numpy(spark):
    rows, df = _fixture(spark)
    wide = {r["g"]: [r[f"q{i}"] for i in range(len(PROBS))] for r in quantiles_wide(df, "v", PROBS, ["g"]).collect()}
    long = {(r["g"], r["p"]): r["q"] for r in quantiles_long(df, "v", PROBS, ["g"]).collect()}
    for g in range(3):
        expected = np.quantile([v for k, v in rows if k == g and v is not None], PROBS)
        assert np.allclose(wide[g], expected)
        assert np.allclose([long[(g, p)] for p in PROBS], expected)


def test_median_global_and_empty(spark):
    rows, df = _fixture(spark)
    assert np.isclose(median_of(df, "v").first()["median"], np.median([v for _, v in rows if v is not None]))
    # an empty column still yields its one row (callers cross-join it)
    empty = median_of(df.where("v > 1e9"), "v").collect()
    assert len(empty) == 1 and empty[0]["median"] is None


def test_quantile_by_counting_passes(spark, monkeypatch):
    import random

    from churnspark.operators import stats
    rnd = random.Random(6)
    monkeypatch.setattr(stats, "CELLS", 16)
    cases = [[5.0], [1.0, 2.0], [3.0] * 400, [float(i) for i in range(700)], [rnd.gauss(0, 1) for _ in range(900)],
             [5.0] * 500 + [rnd.random() * 10 for _ in range(300)], [0.0] * 300 + [1e9 + i for i in range(301)], [1e-300, 1.0, 1e300] * 50]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        ordered = sorted(values)
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            h = (len(ordered) - 1) * p
            lo = int(h)
            hi = min(lo + 1, len(ordered) - 1)
            assert stats.exact_quantile(df, "v", p) == ordered[lo] + (ordered[hi] - ordered[lo]) * (h - lo)
    assert stats.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None
