"""Near-duplicate documents by an inverted join on the coordinates of MinHash signatures.

A document is the set of its distinct word shingles; two are linked if their sets' Jaccard similarity is
at least ``threshold``.  Documents with equal sets are one text from the start.

1. Every text gets a signature of ``COORDINATES`` minima.  It is posted under each (coordinate, value).
2. Only pairs that agree on at least ``MATCHES`` coordinates count.  Values that one text has alone are
   left out; texts with fewer than MATCHES values left have no partner.  In the order from rare to
   common values, two texts with MATCHES values in common share one among the first
   ``values - MATCHES + 1`` of either (prefix filter): common values skip the merge.
3. Links first: each posting list is linked to a few hubs, not to all pairs.  The pairs' agreeing
   coordinates are counted, and those with MATCHES are confirmed on the full sets.
4. The lists are then merged again without what the links have joined already: pairs of one list in
   different components are counted and confirmed as well; in long lists, only if sketches of SKETCH
   one-bit minima allow it.  So a group of thousands of copies costs a few links per copy, texts that are almost near to
   such a group are not listed with each member, and no link between different components is lost.

Full sets decide every link.  What can be lost is a pair that is never a candidate: at a similarity of exactly 0.8
two signatures agree on fewer than MATCHES of COORDINATES with a probability of 1.1e-6 (binomial), and the sketches, which
only long lists use, exceed their bounds (5 and, of 256 bits, 5.5 standard deviations) with 9.1e-7; both fall fast above 0.8.  Values before a
list's are kept as 32-bit marks: that two texts seem to share an earlier list and do not has a chance of 1e-7.

Cases: a null or empty text, or one of white space alone, has an empty set and is linked with nothing;
a text with fewer words than a shingle is one shingle; repeated rows are documents of the same set and
share a component; an empty table gives no row.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.broadcast import checked_broadcast
from . import textops
from .spark import components, table, written

COORDINATES = 40
MATCHES = 19
HUBS = 2
SKETCH = 4096
DEVIATIONS = 5.0  # of a sketch's distance, above that of sets at the threshold
LONG_LIST = 128
THRESHOLD = 0.8
_MULTIPLIER = (np.random.default_rng(11).integers(0, 2**63, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z count as lower case."""
    words = textops.Words(texts, lower=True)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        h, n = words.hash[a:b], min(size, int(b - a))
        s = np.full(max(0, b - a - n + 1) if n else 0, n, dtype=np.uint64)
        for j in range(n):
            s += h[j:j + len(s)] * textops.POSITION_WEIGHT[j]
        out.append(np.unique(textops.mix(s)))
    return out


def _print(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signatures(docs: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """Rows (key, n, print, signature): set size, 128-bit hash of the set, minima; null for empty sets."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n", T.LongType()),
                           T.StructField("print", T.BinaryType()), T.StructField("signature", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in textops.slices(batch.column(1)):
                sets = shingle_sets(texts, shingle)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                least = np.zeros((len(full), COORDINATES), dtype=np.int32)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    at = np.cumsum(n[full]) - n[full]
                    for j in range(COORDINATES):
                        low = np.minimum.reduceat(every * _MULTIPLIER[j], at)
                        least[:, j] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
                rows: list = [None] * len(sets)
                for i, row in zip(full, least):
                    rows[i] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n),
                     pa.array([_print(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array(rows, pa.list_(pa.int32()))], ["key", "n", "print", "signature"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _of_sets(ids: DataFrame, reps: DataFrame, docs: DataFrame, text: str, key: str, shingle: int, kind: str,
             column: Callable[[list[np.ndarray]], pa.Array], name: str) -> DataFrame:
    """Rows (rep, value): ``column`` of the shingle sets of the texts ``ids`` (rep), read from ``docs`` again."""
    need = written(ids.distinct().join(reps.select("rep", "key", "print"), "rep")
                   .select(F.col("key").alias("need"), "rep", "print"), f"{name}_of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in textops.slices(batch.column(0)):
                found = shingle_sets(texts, shingle)
                yield pa.RecordBatch.from_arrays([pa.array([_print(s) for s in found], pa.binary()), column(found)],
                                                 ["print", "value"])

    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    # ids are broadcast if they are few enough, else joined by a shuffle
    mine = texts.join(checked_broadcast(need.select("need").distinct()), F.col("key").eqNullSafe(F.col("need")), "left_semi")
    values = (mine.select("text").mapInArrow(run, f"print binary, value {kind}")
              .groupBy("print").agg(F.first("value").alias("value")))
    return written(need.join(values, "print").select("rep", "value"), name)


def _members(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(every.view(np.int64)))


def _bits(sets: list[np.ndarray]) -> pa.Array:
    """One bit of each of SKETCH further minima, as 64-bit words."""
    out = np.zeros((len(sets), SKETCH), dtype=bool)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        every = np.concatenate([sets[i] for i in full])
        size = np.array([len(sets[i]) for i in full])
        at = np.cumsum(size) - size
        odd = (np.random.default_rng(12).integers(0, 2**63, SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        for j in range(SKETCH):
            out[full, j] = np.minimum.reduceat(every * odd[j], at) >> np.uint64(24) & np.uint64(1)
    words = np.packbits(out, axis=1).view(np.int64).reshape(len(sets), -1)
    ends = np.arange(len(sets) + 1, dtype=np.int32) * (SKETCH // 64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(words.ravel()))


def _low_bytes(signature: str) -> Column:
    """A byte of each coordinate: signatures agree on at least as many bytes as coordinates, in a quarter of the space."""
    return F.transform(signature, lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("byte"))


def _counted(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree on MATCHES coordinates (bytes of them)."""
    sig = reps.select("rep", _low_bytes("signature").alias("signature"))
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
    return (pairs.join(sig.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
            .join(sig.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
            .where(agree >= MATCHES).select("a", "b"))


def _confirmed(counted: DataFrame, reps: DataFrame, docs: DataFrame, text: str, key: str, shingle: int,
               threshold: float) -> DataFrame:
    """The pairs (a, b) of a written table with enough of their full sets in common."""
    if counted.isEmpty():
        return counted
    ids = counted.select(F.col("a").alias("rep")).union(counted.select("b"))
    members = _of_sets(ids, reps, docs, text, key, shingle, "array<bigint>", _members, "members")
    both = (counted.join(members.select(F.col("rep").alias("a"), F.col("value").alias("ma")), "a")
            .join(members.select(F.col("rep").alias("b"), F.col("value").alias("mb")), "b"))
    common, all_of = F.size(F.array_intersect("ma", "mb")), F.size("ma") + F.size("mb")
    similar = F.lit(100) * common >= F.lit(round(100 * threshold)) * (all_of - common)
    return written(both.where(similar).select("a", "b"), "links")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5,
                    threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, n_shingles, component_id, kept): the smallest key of each component, whose first row is kept."""
    sig = written(signatures(docs, text, key, shingle).withColumn("row", F.monotonically_increasing_id()), "signatures")
    first_row = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("row"))
    reps = (sig.where("n > 0").groupBy("print")
            .agg(F.min(F.struct("row", "key", "n", "signature")).alias("s"), F.min(first_row).alias("least"))
            .select("print", F.col("s.row").alias("rep"), "s.key", "s.n", "s.signature", "least"))
    reps = written(reps, "texts")
    value = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = (reps.select("rep", "n", F.posexplode("signature")).select("rep", "n", value.alias("value")))
    common = written(posted.groupBy("value").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "common")
    prefix = (posted.join(common, "value")
              .groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("many", "value"))).alias("v"))  # at most COORDINATES
              .where(F.size("v") >= MATCHES)
              .select("rep", "n", F.size("v").alias("common"),
                      F.slice(F.col("v.value"), F.lit(1), F.size("v") - (MATCHES - 1)).alias("v"))
              .select("rep", "n", "common", "v", F.posexplode("v").alias("place", "value")))
    # lists by value and band of set sizes: similar sets lie in one band or in two next to each other
    band = F.floor(F.log("n") / F.log(F.lit(1 / threshold)) + 1e-9)
    marks = F.transform(F.slice("v", F.lit(1), F.col("place")), lambda x: F.hash(x))  # of the values before
    prefix = (prefix.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
              .select("rep", "n", "common", "own", marks.alias("v"),
                      F.xxhash64("value", F.when(F.col("own"), band).otherwise(band + 1)).alias("list")))
    prefix = written(prefix, "prefix")
    percent = round(100 * threshold)
    a_size = F.lit(100) * F.least("n", "m") >= percent * F.greatest("n", "m")

    # hubs are texts with the fewest values of their own: what has a partner in the list, has most likely one there
    hub = [F.min(F.struct(-F.col("common"), F.xxhash64("rep", F.lit(j)), "rep", "n")).alias(f"h{j}") for j in range(HUBS)]
    hubs = written(prefix.groupBy("list").agg(F.count(F.lit(1)).alias("many"), *hub).where("many > 1"), "hubs")
    linked = (prefix.join(hubs, "list")
              .select("rep", "n", F.explode(F.array(*[F.struct(F.col(f"h{j}.rep"), F.col(f"h{j}.n").alias("m"))
                                                      for j in range(HUBS)])).alias("h"))
              .select("rep", "n", F.col("h.rep").alias("hub"), F.col("h.m").alias("m")).where("rep <> hub").where(a_size)
              .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())
    linked = written(linked, "pairs")
    first = _confirmed(written(_counted(linked, reps), "counted"), reps, docs, text, key, shingle, threshold)

    # what the links have not joined: pairs of one list in different components
    label = components(first).withColumnRenamed("id", "rep")
    known = F.coalesce("component", "rep")
    # the components of a list from narrow rows; values and sketches only of lists with several
    of = prefix.select("rep", "list").join(label, "rep", "left").select("list", known.alias("component"))
    lists = (of.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("many"))
             .where("low < high").select("list", "many"))
    member = prefix.join(written(lists, "open"), "list").join(label, "rep", "left").withColumn("component", known)
    member = written(member, "open_members")
    second = None
    if not member.isEmpty():
        # sketches for the texts of long lists; in short ones the signatures are enough
        bits = _of_sets(member.where(F.col("many") > LONG_LIST).select("rep"), reps, docs, text, key, shingle,
                        "array<bigint>", _bits, "sketches").withColumnRenamed("value", "bits")
        member = member.join(bits, "rep", "left").join(reps.select("rep", _low_bytes("signature").alias("signature")), "rep")

        def side(rep: str, n: str, mark: str) -> DataFrame:
            return member.select(F.col("list").alias(f"list{mark}"), F.col("rep").alias(rep), F.col("n").alias(n),
                                 *[F.col(c).alias(f"{c}{mark}") for c in ("own", "component", "v", "bits", "signature")])

        # a pair is listed in the first list that both are in, and only if its sketches differ as little as
        # those of similar sets (first four words of them, then all) and its signatures agree
        fair = (1 - threshold) / 2

        def close(words: int, deviations: float) -> Column:
            x, y = (F.slice(f"bits{m}", 1, words) for m in "12")
            differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)
            most = 64 * words * fair + deviations * (64 * words * fair * (1 - fair)) ** 0.5
            return F.coalesce(differ <= F.lit(int(most)), F.lit(True))

        def word(i: int) -> Column:
            return F.bit_count(F.get("bits1", F.lit(i)).bitwiseXOR(F.get("bits2", F.lit(i))))

        few = F.coalesce(word(0) + word(1) + word(2) + word(3) <= int(256 * fair + (DEVIATIONS + 0.5) * (256 * fair * (1 - fair)) ** 0.5), F.lit(True))
        agree = F.size(F.filter(F.zip_with("signature1", "signature2", lambda p, q: p == q), lambda e: e)) >= MATCHES
        near = ((F.col("list1") == F.col("list2")) & (F.col("a") < F.col("b")) & (F.col("component1") != F.col("component2"))
                & (F.col("own1") | F.col("own2")) & a_size & few & ~F.arrays_overlap("v1", "v2")
                & close(SKETCH // 64, DEVIATIONS) & agree)
        rest = side("a", "n", "1").join(side("b", "m", "2"), near).select("a", "b").join(linked, ["a", "b"], "left_anti")
        second = _confirmed(written(rest, "rest"), reps, docs, text, key, shingle, threshold)
    if second is not None and not second.isEmpty():
        label = components(first.unionByName(second)).withColumnRenamed("id", "rep")

    # the least (key, row) of each component, from its distinct texts
    joined = written(label.join(reps.select("rep", "least"), "rep"), "joined")
    least = joined.groupBy("component").agg(F.min("least").alias("of_all"))
    group = written(joined.select("rep", "component").join(least, "component").select("rep", "of_all"), "groups")
    out = (sig.join(reps.select("print", "rep", "least"), "print", "left").join(group, "rep", "left")
           .withColumn("of", F.coalesce("of_all", "least", first_row)))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("of.key").alias("component_id"),
                      (F.col("row") == F.col("of.row")).alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents`` on 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
