"""Sparse one-hot encoding from a dictionary table.

The dictionary has a row (column_name, level, feature, customers) for each level that gets a feature; the
alphabetically first level of a column gets none (drop-first), and so do nulls and levels that were not there
when it was fitted: they are all zero.  It stays a table: a column may have any number of levels.

A row is encoded as its numbers (``numeric``, an array in the order of the numeric columns) and the sorted
features of its levels (``levels``): one entry per column instead of one column per level.  Columns with few
levels are looked up in a literal map; a column with more is joined with its part of the dictionary once.
That join deals hot levels by broadcast and gives nulls keys of their own, so neither gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.broadcast import split_by_heat
from ..plans.lineage import materialize
from ..plans.ordering import group_row_number

MAP_LEVELS = 64  # levels of a column that are kept in the plan


@dataclass
class Encoder:
    """``numeric`` and ``sizes`` (features of each categorical column, in order) and the dictionary table."""
    numeric: list[str]
    sizes: dict[str, int]
    rows: int
    dictionary: DataFrame

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(self.sizes.values())

    def offset(self, column: str) -> int:
        """The first feature of a categorical column."""
        names = list(self.sizes)
        return len(self.numeric) + sum(self.sizes[c] for c in names[:names.index(column)])

    def names(self) -> DataFrame:
        """Rows (feature, name) of all features, the columns of the one-hot encoded table."""
        spark = self.dictionary.sparkSession
        numbers = spark.createDataFrame(list(enumerate(self.numeric)), "feature long, name string")
        return numbers.unionByName(self.dictionary.select("feature", F.concat("column_name", F.lit("_"), "level").alias("name")))

    def codes(self, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """(df with the joins that wide columns need, the feature of each categorical column or null)."""
        found: dict[str, Column] = {}
        few = [c for c, n in self.sizes.items() if n <= MAP_LEVELS]
        known: dict[str, list] = {c: [] for c in few}
        for r in self.dictionary.where(F.col("column_name").isin(few)).collect():  # at most MAP_LEVELS per column
            known[r["column_name"]].append((r["level"], r["feature"]))
        for c in self.sizes:
            if c not in df.columns:
                found[c] = F.lit(None).cast("long")
            elif c in known:
                pairs = [F.lit(x) for pair in sorted(known[c]) for x in pair]
                found[c] = F.try_element_at(F.create_map(*pairs), F.col(c).cast("string")) if pairs else F.lit(None).cast("long")
            else:
                df, found[c] = self._joined(df, c)
        return df, found

    def _joined(self, df: DataFrame, column: str) -> tuple[DataFrame, Column]:
        part = self.dictionary.where(F.col("column_name") == column)
        hot, rest = split_by_heat(part, "customers", self.rows)
        at = f"_{self.offset(column)}"
        df = df.join(hot.select(F.col("level").alias(f"{at}_hot"), F.col("feature").alias(f"{at}_a")),
                     F.col(column).cast("string") == F.col(f"{at}_hot"), "left")
        # a key for each row that has its level already, or none: such rows find nothing wherever they go
        alone = F.concat(F.lit("\x00"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
        key = F.when(F.col(column).isNull() | F.col(f"{at}_a").isNotNull(), alone).otherwise(F.col(column).cast("string"))
        df = df.withColumn(f"{at}_key", key).join(rest.select(F.col("level").alias(f"{at}_key"), F.col("feature").alias(f"{at}_b")),
                                                  f"{at}_key", "left")
        return df, F.coalesce(F.col(f"{at}_a"), F.col(f"{at}_b"))

    def encode(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Rows (keep…, numeric, levels); a number that is missing is 0."""
        joined, found = self.codes(df)
        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in self.numeric]
        numeric = F.array(*numbers) if numbers else F.array().cast("array<double>")
        levels = F.array_compact(F.array(*found.values())) if found else F.array().cast("array<long>")
        return joined.select(*keep, numeric.alias("numeric"), levels.alias("levels"))

    def plain(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Rows (keep…, n0…, c0…): a plain column for each number and for the feature of each categorical column.

        A number that is missing is 0, a level without a feature is feature ``width``; columns without features are left out."""
        joined, found = self.codes(df)
        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in self.numeric]
        levels = [F.coalesce(code, F.lit(self.width)).cast("int") for c, code in found.items() if self.sizes[c]]
        return joined.select(*keep, *[x.alias(f"n{i}") for i, x in enumerate(numbers)], *[x.alias(f"c{i}") for i, x in enumerate(levels)])

    def vectors(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``df`` with sparse vectors of ``width`` features for ``pyspark.ml``."""
        names = df.columns
        joined, found = self.codes(df)
        numbers = {f"_n{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in names else F.lit(0.0)
                   for i, c in enumerate(self.numeric)}
        index = {}
        for i, (c, n) in enumerate(self.sizes.items()):
            if n:  # the last category stands for all zero and is dropped
                place = F.coalesce(found[c] - self.offset(c), F.lit(n)).cast("double")
                index[f"_c{i}"] = place.alias(f"_c{i}", metadata={"ml_attr": {"type": "nominal", "name": f"_c{i}", "num_vals": n + 1}})
        wide = joined.select(*names, *[e.alias(k) for k, e in numbers.items()], *index.values())
        if index:
            hot = OneHotEncoder(inputCols=list(index), outputCols=[f"{k}_v" for k in index], dropLast=True)
            wide = hot.fit(wide).transform(wide)
        parts = [*numbers, *[f"{k}_v" for k in index]]
        wide = VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep").transform(wide)
        return wide.select(*names, out)

    def save(self, path: str) -> None:
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
        spark = self.dictionary.sparkSession
        rows = ([("numeric", i, c, self.rows) for i, c in enumerate(self.numeric)]
                + [("levels", n, c, i) for i, (c, n) in enumerate(self.sizes.items())])
        spark.createDataFrame(rows, "kind string, n long, column_name string, more long").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Encoder:
        rows = spark.read.parquet(f"{path}/columns").collect()  # one row per column
        numeric = sorted((r for r in rows if r["kind"] == "numeric"), key=lambda r: r["n"])
        sizes = sorted((r for r in rows if r["kind"] == "levels"), key=lambda r: r["more"])
        return Encoder([r["column_name"] for r in numeric], {r["column_name"]: r["n"] for r in sizes},
                       numeric[0]["more"] if numeric else 0, spark.read.parquet(f"{path}/dictionary"))


def fit_encoder(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], name: str) -> Encoder:
    """Learn the dictionary of ``categorical`` in one pass; it is written under ``name``.

    Levels are counted before they are shuffled and numbered by ranges, so neither a level that most rows
    share nor a column with millions of levels gathers in one task."""
    numeric, categorical = list(numeric), list(categorical)
    spark = df.sparkSession
    pairs = [F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("level")) for i, c in enumerate(categorical)]
    if not pairs:
        empty = spark.createDataFrame([], "column_name string, level string, feature long, customers long")
        return Encoder(numeric, {}, df.count(), empty)
    counts = (df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy("c", "level")
              .agg(F.count(F.lit(1)).alias("customers")))
    counts = materialize(counts, f"levels_{name}")
    rows = counts.where("c = 0").agg(F.sum("customers")).first()[0] or 0
    numbered, sizes = group_row_number(counts.where("level IS NOT NULL"), ["c"], ["level"], out="nth", with_sizes=True)
    many = {r["c"]: r["group_size"] for r in sizes.collect()}  # one row per column
    features = {c: max(0, many.get(i, 0) - 1) for i, c in enumerate(categorical)}
    encoder = Encoder(numeric, features, rows, counts)
    first = [F.lit(encoder.offset(c)) for c in categorical]
    names = F.array(*[F.lit(c) for c in categorical])
    dictionary = numbered.where("nth > 1").select(
        F.get(names, F.col("c")).alias("column_name"), "level",
        (F.get(F.array(*first), F.col("c")) + F.col("nth") - 2).cast("long").alias("feature"), "customers")
    encoder.dictionary = materialize(dictionary, f"dictionary_{name}")
    return encoder
