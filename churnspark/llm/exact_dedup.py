"""Exact duplicates by stateful streaming over a content store.

1. The normalised texts are written once as a content store with a digest and a row number, which is the
   locator of a text in the store (the number of the writing task and the place in its file).
2. A stream reads the store's files; its keyed state holds, per digest, the smallest identifier, that
   row's locator and the number of rows.  The state is kept on disk (RocksDB) without expiry and
   checkpointed in the shared folder: files that arrive later meet everything seen before
   (:func:`stream_state` on the same folders), and a lost executor's part is loaded from the checkpoint.  Rows
   are added up before they are shuffled, so a text that a third of all rows share is one row a task.
3. The state is read as a table.  A digest with more than one row is a hit: each of its rows is compared with
   the full text at the state's locator.  The texts of one digest are dealt over copies of that text, one for
   every SHARE rows, so a hot text is many small joins.
4. Rows that differ from the text their digest points to go through the same steps once more with a longer digest.

Built from DataFrame functions and Structured Streaming alone; nothing runs in Python on the executors.

Cases: a null text counts as empty, and all empty texts are equal; white space at the ends counts as one
space; of equal ids, and of null ids, which come after all others, the row that was read first stays;
repeated rows are duplicates; an empty table gives no row.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.broadcast import split_by_heat
from .spark import fresh_path, table, written

SHARE = 64
FILES_PER_BATCH = 100_000
# state on disk; a store of a partition may be small, so no disk is reserved in advance
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def normalised(text: str) -> Column:
    """The text with each run of ASCII white space replaced by one space; null: empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _longer(text: Column, level: int) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(f"{level}:"), text), 512))


@contextmanager
def _disk_state(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_store(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id",
                digest: Callable[[Column], Column] = sha256) -> None:
    """Append (key, row, text, digest) of ``docs`` to the content store at ``path``."""
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), normalised(text).alias("text"))
    rows.withColumn("digest", digest(F.col("text"))).write.mode("append").option("compression", "zstd").parquet(path)


def stream_state(spark: SparkSession, store: str, checkpoint: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Bring the keyed state at ``checkpoint`` up to date with the files of ``store``; returns it.

    Rows (digest, keep_key, keep_row, many).  A second call reads only files that are new."""
    with _disk_state(spark):
        rows = (spark.readStream.schema(spark.read.parquet(store).schema)
                .option("maxFilesPerTrigger", files_per_batch).parquet(store))
        first = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("row")))
        state = rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("many"))
        query = (state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        kept = spark.read.format("statestore").load(checkpoint)
    return kept.select(F.col("key.digest").alias("digest"), F.col("value.min.key").alias("keep_key"),
                       F.col("value.min.row").alias("keep_row"), F.col("value.count").alias("many"))


def _hits(rows: DataFrame, hot: DataFrame, rest: DataFrame) -> DataFrame:
    return rows.join(hot, "digest").unionByName(rows.join(rest, "digest"))


def _strays(store: DataFrame, hits: DataFrame, rows: int) -> DataFrame:
    """Rows (digest, key, row, text) of hits that differ from the text at their digest's locator."""
    hot, rest = split_by_heat(hits, "many", rows)
    copies = F.floor((F.col("many") - 1) / F.lit(SHARE))
    found = _hits(store, hot, rest)
    others = (found.where("row <> keep_row")
              .select("digest", "key", "row", "text", F.pmod(F.xxhash64("row"), copies + 1).alias("copy")))
    located = (found.where("row = keep_row")
               .select("digest", F.col("text").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), copies)).alias("copy")))
    return others.join(located, ["digest", "copy"]).where("text <> of").select("digest", "key", "row", "text")


def _grouped(spark: SparkSession, store_path: str, level: int) -> DataFrame:
    """Rows (key, row, digest, keep_key, keep_row, group_size) of a content store."""
    store = spark.read.parquet(store_path)
    state = stream_state(spark, store_path, fresh_path(spark, "dedup-state"))
    hits = written(state.where("many > 1"), "hits")
    rows = store.count()
    strays = written(_strays(store, hits, rows), "strays")
    clean = strays.isEmpty()
    if not clean:
        fewer = strays.groupBy("digest").agg(F.count(F.lit(1)).alias("strayed"))
        hits = written(hits.join(fewer, "digest", "left"), "hits")
    else:
        hits = hits.withColumn("strayed", F.lit(0).cast("long"))
    hot, rest = split_by_heat(hits, "many", rows)
    narrow = store.select("key", "row", "digest")
    marked = narrow.join(hot, "digest").unionByName(
        narrow.join(hot, "digest", "left_anti").join(rest, "digest", "left"), allowMissingColumns=True)
    size = F.col("many") - F.coalesce("strayed", F.lit(0))
    marked = marked.select("key", "row", "digest", F.when(F.col("many").isNull(), F.col("key")).otherwise(F.col("keep_key")).alias("keep_key"),
                           F.coalesce("keep_row", "row").alias("keep_row"), F.coalesce(size, F.lit(1)).alias("group_size"))
    if clean:
        return marked
    path = fresh_path(spark, "strays")
    again = strays.select("key", "row", "text", _longer(F.col("text"), level + 1).alias("digest"))
    again.write.option("compression", "zstd").parquet(path)
    resolved = _grouped(spark, path, level + 1).drop("digest").join(strays.select("row", "digest"), "row")
    return marked.join(strays.select("row"), "row", "left_anti").unionByName(resolved)


def duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id",
               digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Rows (key, keep_key, group_size, kept, digest), one for each row of ``docs``."""
    path = fresh_path(docs.sparkSession, "content")
    write_store(docs, path, text, key, digest)
    out = _grouped(docs.sparkSession, path, 0)
    return out.select("key", "keep_key", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts of all ``documents``."""
    found = duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM texts
WINDOW same AS (PARTITION BY t)
"""
