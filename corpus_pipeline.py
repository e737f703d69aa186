"""A corpus from raw documents to packed training windows.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last return the columns of docs.
A stage's own intermediate tables are deleted when the next one starts, so its result must have been written by then.
Null texts, empty tables, repeated rows and extra columns are handled as the operators define.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm import langid, line_dedup, mixing, near_dedup, packing
from churnspark.llm.spark import delete, numbered, recorded, small_batches, table, written

LEAST_SCORE = 0.2  # of the nearest language profile; real text of a learned language is far above
TOKENIZER = "word_bpe_49k.json"


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_TABLES: dict[tuple[str, str], list[str]] = {}  # intermediate tables by application and stage


def _after(before: str | None) -> Callable[[Stage], Stage]:
    """A stage that starts when what ``before`` returned is written."""
    def stage(fn: Stage) -> Stage:
        @wraps(fn)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            app = spark.sparkContext.applicationId
            small_batches(spark)
            delete(spark, _TABLES.pop((app, before), []))
            with recorded() as paths:
                out = fn(spark, docs, sf_dir)
            _TABLES.setdefault((app, fn.__name__), []).extend(paths)
            return out
        return run_stage
    return stage


@_after(None)
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled documents have; the rest go."""
    profiles = langid.fit(docs, F.lit(True))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    held = docs.select(others.alias("doc"), F.col("text").cast("string").alias("text"))
    known = langid.predict(held, profiles, keep=("doc", "text"))
    known = known.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])


@_after("language_id")
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals but for at most one edit."""
    return _with_length(line_dedup.drop_similar_lines(docs).select(*docs.columns))


@_after("drop_lines")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    rows = numbered(docs)
    texts = rows.select("row", F.col("doc.text").alias("text"), F.col("doc.doc_id").alias("doc_id"))
    group = near_dedup.near_duplicates(texts, key="row", shingle=5).select("row", "component_id")
    group = written(group.join(texts.select("row", "doc_id"), "row"), "groups")
    first = group.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("s"))
    # the rows that stay are their groups' firsts: what is not such a row is dropped
    dropped = group.join(first.select(F.col("s.row").alias("row")), "row", "left_anti").select("row")
    return rows.join(dropped, "row", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


@_after("near_duplicates")
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources reads them."""
    return _with_length(mixing.mixed_documents(docs))


@_after("mix_sources")
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training windows, with their token ids."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None  # SQL expresses neither profiles nor token ids; tests/llm checks each stage by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
