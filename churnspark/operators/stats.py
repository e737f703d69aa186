"""Exact quantiles and modes that scale.

Spark's exact ``percentile``/``median``/``mode`` keep a value→count map per group
and merge all of them in one final task: fine for a few hundred distinct values,
not for a continuous column over billions of rows.  Here

* quantiles come from the distinct values: ``GROUP BY value`` counts first (partial
  aggregation removes ties on the map side, so a value that a third of all rows have is
  one row), running counts over the sorted distinct values
  (:func:`~churnspark.plans.ordering.group_running_sum`) then say which value holds a
  rank; only the two neighbouring ranks of each probability are kept, and numpy's
  default linear interpolation ``v[lo] + (v[hi] − v[lo])·frac`` with ``h = (n − 1)·p``
  is applied – the same edges pandas ``quantile``/``qcut`` use;
* modes come from a distributed ``GROUP BY value`` count followed by a top-1 per
  column (ties → smallest value).

Both return small tables (one row per group / column) that callers join back with
a broadcast (bounded by the number of groups or columns).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.broadcast import checked_broadcast
from ..plans.ordering import group_running_sum


def value_counts(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """``(group…, _v, _n)``: the distinct values of ``value`` as doubles and their counts; nulls ignored."""
    return (df.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
              .groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n")))


def _neighbour_ranks(counts: DataFrame, probs: Sequence[float], gg: Sequence[str]) -> DataFrame:
    """Rows ``(gg…, p, _is_lo, _frac, _v)``: for each group and probability the values at
    the two ranks around ``h = (n − 1)·p`` (≤ 2·groups·probs rows), from value counts."""
    running, totals = group_running_sum(counts, gg, [F.col("_v")], "_n", out="_before")
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    wanted = (totals.select(*gg, F.col("group_total").alias("_t"), ps)
                    .withColumn("_h", (F.col("_t") - 1).cast("double") * F.col("p"))
                    .withColumn("_lo", F.floor("_h").cast("bigint") + 1)
                    .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_t")))
                    .withColumn("_frac", F.col("_h") - F.floor("_h")))
    roles = F.explode(F.array(F.struct(F.col("_lo").alias("_rn"), F.lit(True).alias("_is_lo")),
                              F.struct(F.col("_hi").alias("_rn"), F.lit(False).alias("_is_lo")))).alias("_r")
    # 2·groups·probs rows: the groups are the caller's, so the size is checked
    need = checked_broadcast(wanted.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(gg)], "p", "_frac", roles)
                                   .select(*[f"_g{i}" for i in range(len(gg))], "p", "_frac", "_r._rn", "_r._is_lo"))
    cond = (F.col("_before") < F.col("_rn")) & (F.col("_rn") <= F.col("_before") + F.col("_n"))
    for i, c in enumerate(gg):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return running.join(need, cond).select(*gg, "p", "_is_lo", "_frac", "_v")


def _interpolate(lo: F.Column, hi: F.Column, frac: F.Column) -> F.Column:
    return lo + (hi - lo) * frac


def quantiles_long(df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = (),
                   approx: bool = False) -> DataFrame:
    """One row per (group…, ``p``) with the quantile ``q`` of ``value`` (nulls ignored)."""
    g = list(group)
    plist = [float(p) for p in probs]
    if approx:
        v = df.select(*g, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
        out = v.groupBy(*g).agg(F.percentile_approx("_v", plist, 10000).alias("_qs"))
        return (out.select(*g, F.posexplode("_qs").alias("_i", "q"))
                   .withColumn("p", F.element_at(F.array(*[F.lit(p) for p in plist]), F.col("_i") + 1))
                   .drop("_i"))
    gg = g or ["_g"]
    src = df if g else df.withColumn("_g", F.lit(0))
    kept = _neighbour_ranks(value_counts(src, value, gg), plist, gg)
    lo, hi = F.col("_is_lo"), ~F.col("_is_lo")
    res = (kept.groupBy(*gg, "p")
               .agg(_interpolate(F.max(F.when(lo, F.col("_v"))), F.max(F.when(hi, F.col("_v"))),
                                 F.max("_frac")).alias("q")))
    return res.drop("_g") if not g else res


def quantiles_wide(df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = (),
                   prefix: str = "q", approx: bool = False) -> DataFrame:
    """One row per group with columns ``{prefix}0, {prefix}1, …`` in the order of ``probs``."""
    g = list(group)
    plist = [float(p) for p in probs]
    if approx:
        long = quantiles_long(df, value, plist, g, approx=True)
        aggs = [F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"{prefix}{i}") for i, p in enumerate(plist)]
        return long.groupBy(*g).agg(*aggs) if g else long.agg(*aggs)
    gg = g or ["_g"]
    src = df if g else df.withColumn("_g", F.lit(0))
    return quantiles_of_counts(value_counts(src, value, gg), plist, g, prefix)


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], group: Sequence[str], prefix: str = "q") -> DataFrame:
    """:func:`quantiles_wide` of a table of value counts ``(group… or _g, _v, _n)``."""
    kept = _neighbour_ranks(counts, list(probs), list(group) or ["_g"])
    # the kept ranks go straight to one row per group (one aggregation, no long form)
    aggs = []
    for i, p in enumerate(probs):
        at = F.col("p") == p
        aggs.append(_interpolate(F.max(F.when(at & F.col("_is_lo"), F.col("_v"))),
                                 F.max(F.when(at & ~F.col("_is_lo"), F.col("_v"))),
                                 F.max(F.when(at, F.col("_frac")))).alias(f"{prefix}{i}"))
    # without groups: a global aggregate, so an empty / all-null column still gives its
    # one row (of nulls) to the callers that cross-join it
    return kept.groupBy(*group).agg(*aggs) if group else kept.agg(*aggs)


def median_of(df: DataFrame, value: str, out: str = "median", approx: bool = False) -> DataFrame:
    """Exact median as a one-row table."""
    return quantiles_wide(df, value, [0.5], approx=approx).select(F.col("q0").alias(out))


CELLS = 4096


def exact_quantile(df: DataFrame, value: str, p: float) -> float | None:
    """One exact quantile (linear interpolation) of a column by narrowing histograms; null without values.

    A first pass gives count, smallest and largest value; each further one counts the rows of CELLS cells
    between the bounds and keeps the cell that holds the rank, until its values are all equal or so few that they are listed.
    No value is shuffled: a pass sends at most CELLS rows a task and to the driver."""
    rows = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not whole["n"]:
        return None
    h = (whole["n"] - 1) * p
    lo = int(h)
    found: dict[int, float] = {}
    # ranks still sought by the bounds (with the rows below) in which they lie
    sought = {(whole["low"], whole["high"], 0): sorted({lo, min(lo + 1, whole["n"] - 1)})}
    while sought:
        (low, high, below), ranks = sought.popitem()
        if low == high:
            found |= dict.fromkeys(ranks, low)
            continue
        inside = rows.where(F.col("v").between(low, high))
        cell = F.least(F.floor((F.col("v") - low) / (high - low) * CELLS), F.lit(CELLS - 1))
        cells = sorted(inside.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
        for rank in ranks:
            at = below
            for c in cells:
                if rank < at + c["n"]:
                    break
                at += c["n"]
            if c["n"] <= CELLS and c["low"] < c["high"]:
                listed = sorted(r["v"] for r in rows.where(F.col("v").between(c["low"], c["high"])).collect())  # at most CELLS
                found |= {r: listed[r - at] for r in ranks if at <= r < at + c["n"]}
            elif rank not in found:
                sought.setdefault((c["low"], c["high"], at), []).append(rank)
    v, w = found[lo], found[min(lo + 1, whole["n"] - 1)]
    return v + (w - v) * (h - lo)


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: ``(column_name, mode)``; ties → smallest value, nulls ignored."""
    cols = list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, mode string")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))
                                for c in cols])).alias("kv")
    counts = (df.select(pairs).select("kv.k", "kv.v").where(F.col("v").isNotNull())
                .groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))
    # top-1 per column as a partial aggregate: smallest (−count, value)
    return (counts.groupBy("k").agg(F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v").alias("b")))
                                    .alias("mode"))
                  .select(F.col("k").alias("column_name"), "mode"))
