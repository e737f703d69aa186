"""Packing documents into training windows by non-negative least squares.

1. Every text is tokenised once (words through a cache of encoded words) and its ids are written.
2. A document longer than the window gives whole windows and a remainder.  Remainders are counted in
   length classes of ``width`` tokens: a histogram of at most ``window / width`` rows.
3. All combinations of at most ``depth`` classes that fill a window exactly are listed.  Non-negative
   least squares gives each a repeat count so that the counts explain the histogram; they are rounded
   and held to the histogram.  This solves a problem whose size depends on the parameters alone.
4. Documents are ranked in their class by distributed running totals; the first ranks take the places
   of the combinations.  The residual documents are packed greedily: one behind the other, each window
   filled before the next begins, cutting the document at its end.

Cases: a null or empty text has only the end token; an empty table gives no row; repeated rows are
packed once each; a text of any length is cut into as many windows as it needs.  Columns other than
the id and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations_with_replacement
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .spark import running_totals, table, written

WINDOW = 4096
WIDTH = 8
DEPTH = 3
END_ID = 2
DOCS_PER_BIN = 2048
CACHED_WORDS = 2_000_000


class _WordEncoder:
    """Token ids of words by their 64-bit hash; a word of an unseen hash is encoded once.

    The tokenizer never joins text across white space, so a text's ids are its words' ids in order."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        normalizer = self.tokenizer.normalizer
        self.lower = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self._clear()

    @staticmethod
    def of_this_worker(path: str) -> _WordEncoder:
        """The encoder that earlier tasks of this Python worker have filled, or a new one."""
        kept = sys.modules.setdefault("encoders_of_this_worker", ModuleType("encoders_of_this_worker")).__dict__
        return kept.setdefault(path, None) or kept.update({path: _WordEncoder(path)}) or kept[path]

    def _clear(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)  # sorted
        self.start = np.empty(0, dtype=np.int64)
        self.size = np.empty(0, dtype=np.int32)
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.used = 0

    def _add(self, hashes: np.ndarray, place: np.ndarray, words: list[str]) -> None:
        """Encodes the words and puts them into the sorted cache at ``place``."""
        sizes, parts = [], []
        for i in range(0, len(words), 8192):
            part = words[i:i + 8192]
            whole = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            # a token belongs to the word in which it begins
            ends = np.cumsum([len(w) + 1 for w in part])
            begins = np.fromiter((o[0] for o in whole.offsets), np.int64, len(whole))
            sizes.append(np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(part)))
            parts.append(np.array(whole.ids, dtype=np.uint32))
        size, flat = np.concatenate(sizes), np.concatenate(parts)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used:self.used + len(flat)] = flat
        start = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.keys = np.insert(self.keys, place, hashes)
        self.start = np.insert(self.start, place, start)
        self.size = np.insert(self.size, place, size.astype(np.int32))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, with the end token."""
        # a tokenizer that lower-cases gives Word the ids of word; special tokens are matched before that
        words = textops.Words(texts, lower=self.lower and not any(b"<|" in t for t in texts))
        seen, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.keys) > CACHED_WORDS:
            self._clear()
        at = np.searchsorted(self.keys, seen)
        known = np.zeros(len(seen), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == seen[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            data, w = words.buf.tobytes(), first[new]
            self._add(seen[new], at[new], [data[a:b].decode("utf-8", "replace")
                                           for a, b in zip(words.start[w].tolist(), words.end[w].tolist())])
            at = np.searchsorted(self.keys, seen)
        code = at[inverse]
        size = self.size[code]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(total[-1]) - np.repeat(total[:-1], size) + np.repeat(self.start[code], size)]
        cut = total[words.first]
        return [np.append(ids[a:b], np.uint32(END_ID)) for a, b in zip(cut[:-1], cut[1:])]


def tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc, n, ids): a document's number of ids and the ids as little-endian unsigned 32-bit."""
    schema = T.StructType([T.StructField("doc", docs.schema[key].dataType), T.StructField("n", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _WordEncoder.of_this_worker(tokenizer_path)
        for batch in batches:
            for a, b, texts in textops.slices(batch.column(1)):
                ids = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([textops.binary(x.astype("<u4")) for x in ids], pa.binary())], ["doc", "n", "ids"])

    return docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def fillings(classes: int, depth: int = DEPTH) -> np.ndarray:
    """All multisets of at most ``depth`` lengths from 1 to ``classes`` that add up to ``classes``; 0: no piece."""
    out = []
    for k in range(1, depth + 1):
        if k == 1:
            out.append((classes,))
            continue
        for head in combinations_with_replacement(range(1, classes // 2 + 1), k - 2):
            rest, low = classes - sum(head), (head[-1] if head else 1)
            out += [(*head, x, rest - x) for x in range(low, rest // 2 + 1)]
    return np.array([(*x, *[0] * (depth - len(x))) for x in out], dtype=np.int64)


def nnls(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, A[c, s] = how often pattern s has class c.

    Accelerated projected gradient; A has at most ``depth`` entries a column and is only gathered."""
    size = len(histogram)

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for col in patterns.T:
            out += np.bincount(col, weights=x, minlength=size)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[patterns].sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(forward(v))))
    target = histogram.astype(float).copy()
    target[0] = 0
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - step * back(forward(y) - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[int, int, int, int]]:
    """Places for documents of each class: rows (class, first rank, end rank, first sequence).

    The place of rank r is sequence ``first sequence + r - first rank``."""
    if not histogram.any():
        return []
    patterns = fillings(len(histogram) - 1, depth)
    repeats = np.floor(nnls(patterns, histogram) + 0.5).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    taken = np.zeros_like(left)
    rows, sequence = [], 0
    for s in np.argsort(-repeats, kind="stable"):
        if repeats[s] <= 0:
            break
        pieces = [int(c) for c in patterns[s] if c]
        many = min(int(repeats[s]), *[int(left[c]) // pieces.count(c) for c in pieces])
        if many <= 0:
            continue
        for c in pieces:
            rows.append((c, int(taken[c]), int(taken[c]) + many, sequence))
            taken[c] += many
            left[c] -= many
        sequence += many
    return rows


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, width: int = WIDTH, depth: int = DEPTH,
         text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, sequence_id, offset) of all documents; ``ids`` is binary."""
    spark = docs.sparkSession
    doc = tokens(docs, tokenizer_path, text, key).withColumn("row", F.monotonically_increasing_id())
    doc = written(doc.withColumn("rest", F.col("n") % window), "tokens")  # written: row ids stay as they are
    bins = max(64, doc.count() // DOCS_PER_BIN)
    lengths = doc.select(F.pmod(F.xxhash64("doc", "n"), F.lit(bins)).alias("bin"), "row", "rest",
                         (F.col("n") - F.col("rest")).alias("whole"),
                         F.ceil(F.col("rest") / width).cast("int").alias("class"))

    counted = lengths.where("class > 0").groupBy("class").count().collect()  # at most window / width rows
    histogram = np.zeros(window // width + 1, dtype=np.int64)
    for r in counted:
        histogram[r["class"]] = r["count"]
    places = plan(histogram, depth)  # at most depth times the number of fillings
    packed = max([p[3] + p[2] - p[1] for p in places], default=0)
    by_class: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c in {p[0] for p in places}:
        mine = [p for p in places if p[0] == c]
        by_class[c] = (np.array([p[2] for p in mine]), np.array([p[3] - p[1] for p in mine]))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            out = np.full(len(cls), -1, dtype=np.int64)
            for c in np.unique(cls):
                if c in by_class:
                    ends, shift = by_class[c]
                    at = np.flatnonzero(cls == c)
                    k = np.searchsorted(ends, rank[at], side="right")
                    fits = k < len(ends)
                    out[at[fits]] = rank[at[fits]] + shift[k[fits]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["row", "seat"])

    ranked = running_totals(lengths.withColumn("one", F.lit(1)), ["class"], ["bin", "row"], {"rank": "one"}, bins)
    seated = ranked.select("row", "class", "rank").mapInArrow(seat, "row long, seat long")
    # offsets among the few pieces of a combination
    inside = F.sum("rest").over(_behind("seat", "row"))
    seated = written(lengths.join(seated, "row"), "seats")
    combined = (seated.where("seat >= 0")
                .withColumn("offset", F.coalesce(inside, F.lit(0))).select("row", "seat", "offset"))
    # residual documents behind each other, whole windows behind these
    stream = seated.withColumns({"left": F.when(F.col("seat") < 0, F.col("rest")).otherwise(0),
                                 "full": (F.col("whole") / window).cast("long")})
    stream = running_totals(stream, [], ["bin", "row"], {"at": "left", "full_at": "full"}, bins)
    total = seated.where("seat < 0").agg(F.sum("rest")).first()[0] or 0
    full_from = packed + -(-total // window)
    where = (stream.select("row", "seat", "at", "full_at")
             .join(combined.select("row", F.col("offset").alias("o")), "row", "left")
             .select("row", F.when(F.col("seat") >= 0, F.col("seat"))
                     .otherwise(packed + F.floor(F.col("at") / window)).alias("seq"),
                     F.when(F.col("seat") >= 0, F.col("o")).otherwise(F.col("at") % window).alias("off"),
                     (F.col("full_at") + full_from).alias("full_seq")))
    # a document's pieces: its whole windows, then the remainder, cut once where a window ends
    piece = "named_struct('start', {}, 'length', {}, 'sequence_id', {}, 'offset', {})".format
    w = window
    whole = (f"if(n < {w}, array(), transform(sequence(0L, n div {w} - 1), "
             f"i -> {piece(f'i * {w}L', f'{w}L', 'full_seq + i', '0L')}))")
    fit = f"least(rest, {w}L - off)"
    ends = f"array({piece('n - rest', fit, 'seq', 'off')}, {piece(f'n - rest + {fit}', f'rest - {fit}', 'seq + 1', '0L')})"
    schema = "array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>"
    pieces = f"filter(concat(cast({whole} as {schema}), cast({ends} as {schema})), p -> p.length > 0)"
    cut = ("transform({}, p -> struct(p.start, p.length, p.sequence_id, p.offset, "
           "substring(ids, cast(4 * p.start + 1 as int), cast(4 * p.length as int)) as ids))").format(pieces)
    return (doc.join(where, "row").select(F.col("doc").alias(key), F.col("n").alias("doc_tokens"),
                                          F.explode(F.expr(cut)).alias("p"))
               .select(key, "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset"))


def _behind(group: str, order: str):
    from pyspark.sql import Window
    return Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in windows of 4096 ids; a digest of each piece instead of its ids."""
    import public_tokenizers
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
