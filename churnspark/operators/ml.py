"""Model preparation, training, evaluation and scoring.

* One-hot encoding keeps the reference's ``get_dummies(drop_first=True)`` meaning: levels sorted alphabetically,
  the first dropped, null and unknown → all zero.  :func:`one_hot_encode` gives one column per level, for columns of
  up to MAX_LEVELS levels; models are trained on the sparse encoding (``encoding.py``), whose dictionary is a
  table of any size that is stored with the model.
* Logistic regression by Newton steps (``logistic.py``), boosted trees on histograms (``boosting.py``), random
  forests by ``pyspark.ml`` up to ``FOREST_ROWS`` rows and on blocks of packed codes beyond (``forest.py``).  Their
  numeric kernels work on Arrow batches and blocks.
* Metrics are aggregates over the scored table; the AUC is exact (rank-sum with
  average ties) and distributed (ranks from the checkpointed global row number).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bins
from ..plans.broadcast import checked_broadcast
from ..plans.lineage import materialize, scratch
from ..plans.ordering import group_row_number, group_running_sum
from . import logistic
from .boosting import BoostedModel, BoostParams, first_splits, fit_boosted  # noqa: F401
from .clean import Imputation, drop_identifier_columns, fit_imputation
from .encoding import Encoder, fit_encoder
from .features import prepare_customers
from .forest import BlockForest, ForestParams, fit_forest
from .logistic import LinearModel, LogisticFit

LABEL = "churn_flag"
FOREST_ROWS = 250_000  # training rows that pyspark.ml's forest is given: it keeps a draw and a node for each row and tree


# ---------------------------------------------------------------- encoding
@dataclass(frozen=True)
class Vocabulary:
    """Sorted levels per categorical column (the fitted state of the encoder)."""
    levels: dict[str, list[str]]

    def dummy_names(self) -> list[str]:
        return [f"{c}_{lvl}" for c, lv in self.levels.items() for lvl in lv[1:]]


MAX_LEVELS = 1000


def fit_vocabulary(df: DataFrame, cols: list[str], max_levels: int = MAX_LEVELS) -> Vocabulary:
    """Alphabetical levels of each column, from a distributed distinct.

    A column with more than ``max_levels`` levels is an error that names it (a key or a free text
    was taken for a category): nothing is dropped, and no more than that reaches the driver."""
    if not cols:
        return Vocabulary({})
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("level")) for c in cols]))
    levels = df.select(pairs.alias("p")).select("p.*").where(F.col("level").isNotNull()).distinct()
    levels = levels.persist()
    try:
        wide = [(r["c"], r["count"]) for r in levels.groupBy("c").count().where(F.col("count") > max_levels).collect()]
        if wide:
            raise ValueError("too many levels for one-hot encoding (limit "
                             f"{max_levels}): " + ", ".join(f"{c} has {n}" for c, n in sorted(wide)))
        found: dict[str, list[str]] = {c: [] for c in cols}
        for r in levels.collect():  # at most max_levels per column
            found[r["c"]].append(r["level"])
    finally:
        levels.unpersist()
    return Vocabulary({c: sorted(v) for c, v in found.items()})


def one_hot_columns(vocab: Vocabulary) -> list[F.Column]:
    return [F.when(F.col(c) == lvl, 1).otherwise(0).alias(f"{c}_{lvl}")
            for c, lv in vocab.levels.items() for lvl in lv[1:]]


def one_hot_encode(df: DataFrame, cols: list[str] | None = None, vocab: Vocabulary | None = None) -> DataFrame:
    """Replace categorical columns by drop-first dummies (aligned to ``vocab`` if given)."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    v = vocab or fit_vocabulary(df, cols)
    keep = [c for c in df.columns if c not in v.levels]
    present = Vocabulary({c: lv for c, lv in v.levels.items() if c in df.columns})
    missing = [F.lit(0).alias(f"{c}_{lvl}") for c, lv in v.levels.items() if c not in df.columns for lvl in lv[1:]]
    return df.select(*keep, *one_hot_columns(present), *missing)


def align_features(df: DataFrame, vocab: Vocabulary, numeric: list[str]) -> DataFrame:
    """The model's feature columns in training order: absent numeric → 0, dummies from
    the stored vocabulary (unseen level → all zero), extra columns dropped."""
    enc = one_hot_encode(df, [c for c in vocab.levels if c in df.columns], vocab)
    num = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns
           else F.lit(0.0).alias(c) for c in numeric]
    extra = [c for c in ("customer_id", LABEL) if c in df.columns]
    return enc.select(*extra, *num, *[F.col(d) for d in vocab.dummy_names()])


# ---------------------------------------------------------------- split and weights
def stratified_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, label: str = LABEL,
                     key: str = "customer_id") -> DataFrame:
    """Reproducible stratified split: within each class, rows ordered by
    md5("seed|key"); the first ⌊fraction·n_class + ½⌋ are the test set."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    # only (class, hash, key) travels through the ordering; one row per class, the last
    # test row, comes back, and the wide rows are compared with it where they are
    narrow = df.select(F.col(label).alias("_l"), h.alias("_h"), F.col(key).alias("_k"))
    numbered, sizes = group_row_number(narrow, ["_l"], [F.col("_h"), F.col("_k")], out="_rn", with_sizes=True)
    cut = sizes.select(F.col("_l").alias("_cl"), F.floor(F.col("group_size") * F.lit(test_fraction) + F.lit(0.5))
                       .cast("bigint").alias("_cut"))
    last = (numbered.join(checked_broadcast(cut), F.col("_l").eqNullSafe(F.col("_cl")) & (F.col("_rn") == F.col("_cut")))
                    .select("_cl", F.struct("_h", "_k").alias("_last")))
    test = F.coalesce(F.struct(h.alias("_h"), F.col(key).alias("_k")) <= F.col("_last"), F.lit(False))
    return (df.join(checked_broadcast(last), F.col(label).eqNullSafe(F.col("_cl")), "left")
              .withColumn("split", F.when(test, "test").otherwise("train"))
              .drop("_cl", "_last"))


def balanced_class_weight(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Per class: count and weight N / (2·n_class) (sklearn ``class_weight='balanced'``)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_count"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return (g.crossJoin(F.broadcast(total))
             .select(label, "class_count", (F.col("_n") / (F.lit(2.0) * F.col("class_count"))).alias("weight")))


def with_class_weight(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    w = balanced_class_weight(df, label).select(label, F.col("weight").alias(out))
    return df.join(checked_broadcast(w), label)  # one row per class


# ---------------------------------------------------------------- evaluation
def roc_auc(scored: DataFrame, score: str = "churn_probability", label: str = LABEL,
            key: str = "customer_id") -> DataFrame:
    """Exact area under the ROC curve, one row ``auc``; null with one class only or no row.

    Rank-sum (Mann–Whitney) with average ranks for tied scores.  Rows are first counted
    per distinct score (partial aggregation); running counts over the distinct scores give
    each its first rank, and AUC = (Σ over positives of the average rank − P(P+1)/2) / (P·N).
    """
    per_score = (scored.select(F.col(score).cast("double").alias("_s"), F.col(label).cast("int").alias("_y"))
                 .groupBy("_s").agg(F.count(F.lit(1)).alias("_c"), F.sum("_y").alias("_ones")))
    running, _ = group_running_sum(per_score, [], [F.col("_s")], "_c", out="_before")
    avg_rank = F.col("_before").cast("double") + (F.col("_c").cast("double") + F.lit(1.0)) / F.lit(2.0)
    agg = running.agg(F.sum(F.col("_ones") * avg_rank).alias("_rs"), F.sum("_ones").cast("double").alias("_p"),
                      F.sum("_c").cast("double").alias("_t"))
    n_neg = F.col("_t") - F.col("_p")
    return agg.select(F.try_divide(F.col("_rs") - F.col("_p") * (F.col("_p") + F.lit(1.0)) / F.lit(2.0),
                                   F.col("_p") * n_neg).alias("auc"))


def _ratio(a: F.Column, b: F.Column) -> F.Column:
    """0 where nothing was predicted or nothing is there, so averages stay numbers."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_metrics(scored: DataFrame, score: str = "churn_probability", label: str = LABEL,
                           threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 of ``score ≥ threshold`` in one aggregate."""
    pred = (F.col(score) >= threshold).cast("int")
    y = F.col(label)
    c = scored.agg(F.sum(((pred == 1) & (y == 1)).cast("int")).alias("tp"),
                   F.sum(((pred == 1) & (y == 0)).cast("int")).alias("fp"),
                   F.sum(((pred == 0) & (y == 1)).cast("int")).alias("fn"),
                   F.count(F.lit(1)).alias("n"), F.sum((pred == y).cast("int")).alias("correct"))
    prec = _ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    rec = _ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    return c.select(F.try_divide(F.col("correct"), F.col("n")).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), _ratio(F.lit(2.0) * prec * rec, prec + rec).alias("f1"))


def classification_report(scored: DataFrame, score: str = "churn_probability", label: str = LABEL,
                          threshold: float = 0.5) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages at
    ``score > threshold`` (strict, as the reference's report)."""
    pred = (F.col(score) > threshold).cast("int")
    y = F.col(label)
    c = scored.agg(*[F.sum(((pred == a) & (y == b)).cast("int")).cast("double").alias(f"p{a}y{b}")
                     for a in (0, 1) for b in (0, 1)])
    rows = []
    for k in (0, 1):
        tp, fp, fn = F.col(f"p{k}y{k}"), F.col(f"p{k}y{1 - k}"), F.col(f"p{1 - k}y{k}")
        pr, rc = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
        rows.append((str(k), pr, rc, _ratio(F.lit(2.0) * pr * rc, pr + rc), tp + fn))
    per = c.select(*[e.alias(f"{n}_{r}") for r, pr, rc, f1, sup in rows
                     for n, e in (("precision", pr), ("recall", rc), ("f1", f1), ("support", sup))],
                   F.try_divide(F.col("p0y0") + F.col("p1y1"), F.col("p0y0") + F.col("p0y1") + F.col("p1y0")
                                + F.col("p1y1")).alias("accuracy"))
    stack = []
    for r in ("0", "1"):
        stack.append(f"'{r}', precision_{r}, recall_{r}, f1_{r}, support_{r}")
    stack.append("'accuracy', cast(null as double), cast(null as double), accuracy, support_0 + support_1")
    stack.append("'macro avg', (precision_0 + precision_1) / 2, (recall_0 + recall_1) / 2, (f1_0 + f1_1) / 2, "
                 "support_0 + support_1")
    stack.append("'weighted avg', try_divide(precision_0 * support_0 + precision_1 * support_1, support_0 + support_1), "
                 "try_divide(recall_0 * support_0 + recall_1 * support_1, support_0 + support_1), "
                 "try_divide(f1_0 * support_0 + f1_1 * support_1, support_0 + support_1), support_0 + support_1")
    return per.select(F.expr(f"stack({len(stack)}, {', '.join(stack)}) as (label, precision, recall, f1_score, "
                             f"support)"))


# ---------------------------------------------------------------- rules on a scored customer
# Rule texts of the prediction page.
RISK_FACTOR_TEXTS = ["Month-to-month contract", "Customer tenure less than 1 year",
                     "Fiber optic without security or tech support", "Payment by electronic check",
                     "Low service adoption"]
RECOMMENDATION_TEXTS = ["Offer contract upgrade incentives", "Promote online security services",
                        "Offer complimentary tech support", "Bundle additional services at discount"]
NO_RISK_FACTOR = "No major risk factor"  # own wording
DEFAULT_RECOMMENDATIONS = ["Regular satisfaction checks", "Loyalty rewards program"]


def risk_factor_flags(df: DataFrame) -> DataFrame:
    """Array of triggered risk-factor texts per customer."""
    t = RISK_FACTOR_TEXTS
    arr = F.array_compact(F.array(
        F.when(F.col("contract") == "Month-to-month", F.lit(t[0])),
        F.when(F.col("tenure") < 12, F.lit(t[1])),
        F.when((F.col("internet_service") == "Fiber optic")
               & ((F.col("online_security") == "No") | (F.col("tech_support") == "No")), F.lit(t[2])),
        F.when(F.col("payment_method") == "Electronic check", F.lit(t[3])),
        F.when((F.col("total_services") <= 1) & (F.col("internet_service") != "No"), F.lit(t[4]))))
    return df.withColumn("risk_factors", arr)


def retention_recommendations(df: DataFrame, score: str = "churn_probability") -> DataFrame:
    r = RECOMMENDATION_TEXTS
    high = F.array_compact(F.array(
        F.when(F.col("contract") == "Month-to-month", F.lit(r[0])),
        F.when((F.col("internet_service") == "Fiber optic") & (F.col("online_security") == "No"), F.lit(r[1])),
        F.when(F.col("tech_support") == "No", F.lit(r[2])),
        F.when(F.col("total_services") <= 2, F.lit(r[3]))))
    low = F.array(*[F.lit(x) for x in DEFAULT_RECOMMENDATIONS])
    return df.withColumn("recommendations", F.when(F.col(score) > 0.5, high).otherwise(low))


# ---------------------------------------------------------------- training
@dataclass
class FeatureSpec:
    """What turns a table into features: fill values of the training table and the encoder."""
    encoder: Encoder
    imputation: Imputation

    def filled(self, df: DataFrame) -> DataFrame:
        return self.imputation.apply(df, everywhere=True, all_null_value="Unknown")

    def save(self, path: str) -> None:
        self.encoder.save(path)
        self.imputation.table(SparkSession.getActiveSession()).write.mode("overwrite").parquet(f"{path}/fill")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeatureSpec:
        return FeatureSpec(Encoder.load(spark, path), Imputation.from_table(spark.read.parquet(f"{path}/fill")))


def prepare_modeling_data(df: DataFrame, name: str, label: str = LABEL, key: str = "customer_id") -> tuple[DataFrame, FeatureSpec]:
    """Drop target/key/id columns, learn fill values (mean / mode / "Unknown") and the dictionary of levels
    (written under ``name``); returns the table (key, label, columns…) and the feature spec."""
    feats = drop_identifier_columns(df.drop(label), target=label, key=key)
    cat = [f.name for f in feats.schema.fields if isinstance(f.dataType, T.StringType)]
    num = [f.name for f in feats.schema.fields if isinstance(f.dataType, T.NumericType)]
    base = df.select(key, label, *num, *cat)
    spec = FeatureSpec(Encoder(num, {}, 0, None), fit_imputation(df, num, cat))
    spec.encoder = fit_encoder(spec.filled(base), num, cat, name)
    return base, spec


@dataclass
class LogisticModel:
    spec: FeatureSpec
    linear: LinearModel
    fit: LogisticFit | None = None

    def score(self, df: DataFrame) -> DataFrame:
        return _with_rows(self.linear.score, df, self.spec)

    def importance(self) -> DataFrame:
        """Rows (feature, importance): the absolute coefficients."""
        return self.linear.table.where("feature >= 0").select("feature", F.abs("coefficient").alias("importance"))

    def save(self, path: str) -> None:
        self.spec.save(path)
        self.linear.table.write.mode("overwrite").parquet(f"{path}/coefficients")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LogisticModel:
        spec = FeatureSpec.load(spark, path)
        return LogisticModel(spec, LinearModel(spec.encoder, spark.read.parquet(f"{path}/coefficients")))


@dataclass
class ForestModel:
    spec: FeatureSpec
    forest: RandomForestClassificationModel | BlockForest

    def score(self, df: DataFrame) -> DataFrame:
        if isinstance(self.forest, BlockForest):
            return _with_rows(self.forest.score, df, self.spec)

        def scored(filled: DataFrame) -> DataFrame:
            out = self.forest.transform(self.spec.encoder.vectors(filled))
            return out.select(*filled.columns, vector_to_array(F.col("probability")).getItem(1).alias("churn_probability"))
        return _with_rows(scored, df, self.spec)

    def importance(self) -> DataFrame:
        """Rows (feature, importance), one per feature of the model."""
        if isinstance(self.forest, BlockForest):
            return self.forest.importance(SparkSession.getActiveSession())
        values = enumerate(self.forest.featureImportances.toArray().tolist())
        return SparkSession.getActiveSession().createDataFrame([(i, float(v)) for i, v in values], "feature long, importance double")


@dataclass
class TreesModel:
    spec: FeatureSpec
    boosted: BoostedModel

    def score(self, df: DataFrame) -> DataFrame:
        return _with_rows(self.boosted.score, df, self.spec)

    def importance(self) -> DataFrame:
        return self.boosted.importance(SparkSession.getActiveSession())


def _with_rows(score, df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """``df`` as it is (nulls not filled) with the probability of its filled rows."""
    used = [c for c in [*spec.encoder.numeric, *spec.encoder.sizes] if c in df.columns]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    scored = score(spec.filled(df.select(row, *used)))
    return scored.select("_row", "churn_probability").select("_row.*", "churn_probability")


def train_logistic(train: DataFrame, spec: FeatureSpec) -> LogisticModel:
    """``C = 0.8`` and balanced weights (column ``weight``), by Newton steps."""
    linear, fit = logistic.train_logistic(spec.filled(train).withColumnRenamed(LABEL, "label"), spec.encoder)
    return LogisticModel(spec, linear, fit)


def train_random_forest(train: DataFrame, spec: FeatureSpec, num_trees: int = 100, max_depth: int = 12, seed: int = 42) -> ForestModel:
    if train.count() > FOREST_ROWS:
        with scratch(train.sparkSession):  # the model needs none of the tables it is fitted on
            return ForestModel(spec, fit_forest(boosting_design(train, spec), spec.encoder, ForestParams(num_trees, max_depth, seed)))
    # each row keeps its node of every tree: a level moves it one step, not down from the root
    forest = RandomForestClassifier(labelCol=LABEL, featuresCol="features", numTrees=num_trees, maxDepth=max_depth,
                                    minInstancesPerNode=1, featureSubsetStrategy="sqrt", seed=seed,
                                    cacheNodeIds=True, checkpointInterval=-1)
    return ForestModel(spec, forest.fit(spec.encoder.vectors(spec.filled(train)).select(LABEL, "features")))


def boosting_design(train: DataFrame, spec: FeatureSpec, key: str = "customer_id") -> DataFrame:
    """Written rows (key, label, numeric, levels)."""
    rows = spec.encoder.encode(spec.filled(train).withColumnRenamed(LABEL, "label"), [key, "label"])
    return materialize(rows, f"design_{uuid.uuid4().hex}")


def train_boosted_trees(train: DataFrame, spec: FeatureSpec, params: BoostParams = BoostParams()) -> TreesModel:
    with scratch(train.sparkSession):
        return TreesModel(spec, fit_boosted(boosting_design(train, spec), spec.encoder, params))


def score_churn(model, df: DataFrame) -> DataFrame:
    """Probability of class 1 and the (right-closed) risk segment; ``model`` is one of the models above."""
    return model.score(df).withColumn("risk_segment", bins.risk_segment("churn_probability"))


# ---------------------------------------------------------------- scoring raw customers
def prepare_new_customers(df: DataFrame, imputation: Imputation) -> DataFrame:
    """Features of customers as the single-customer form has them: total charges = monthly ×
    tenure, everything missing filled with the values of the training table.  Per-row
    expressions only, so one customer, a table and a stream get the same features."""
    total = (F.col("monthly_charges") * F.col("tenure")).cast("string")
    return prepare_customers(df.withColumn("total_charges", total), imputation)


@dataclass
class ChurnModel:
    """A fitted model with the fill values of the raw table it was trained on."""
    model: LogisticModel
    imputation: Imputation

    def score(self, raw: DataFrame) -> DataFrame:
        """Scores of raw customers: the same for a customer alone and in any table."""
        return score_churn(self.model, prepare_new_customers(raw, self.imputation))

    def save(self, path: str) -> None:
        self.model.save(f"{path}/model")
        spark = SparkSession.getActiveSession()
        self.imputation.table(spark).write.mode("overwrite").parquet(f"{path}/imputation")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ChurnModel:
        return ChurnModel(LogisticModel.load(spark, f"{path}/model"),
                          Imputation.from_table(spark.read.parquet(f"{path}/imputation")))


def feature_importance(model, top: int = 15) -> DataFrame:
    """Features by importance (trees) or |coefficient| (logistic), top ``top``."""
    named = model.importance().join(model.spec.encoder.names(), "feature").select(F.col("name").alias("feature"), "importance")
    return named.orderBy(F.col("importance").desc(), "feature").limit(top)


def feature_columns(model) -> DataFrame:
    """Ordered feature names (position, feature) of a model."""
    return model.spec.encoder.names().select(F.col("feature").cast("int").alias("position"), F.col("name").alias("feature"))
