"""Removing repeated word windows, found through difference-cover anchors.

A word is removed if a window of ``WINDOW`` consecutive words covers it whose word sequence also starts
earlier (smaller document id, or earlier in the same document); all windows are judged on the input.

1. Of the word positions of a document only those of a difference cover modulo ``PERIOD`` carry an
   anchor, the hash of the next ``ANCHOR`` words.  For any two starts i and j some d < PERIOD brings
   both i + d and j + d onto the cover, so two equal windows share an aligned anchor if
   ``PERIOD - 1 + ANCHOR <= WINDOW``.
2. Anchors that occur twice anywhere are extended: each window around one is hashed, and the windows'
   first starts are found.
3. The words that later starts cover are cut from the texts.

Documents are worked on in blocks (by a residue of their id).  A block sends each distinct hash once
to the hash's bucket, with its first place in the block, and a bucket answers the blocks concerned.
So a passage that a third of all documents share costs one entry per block, and neither a block nor a
bucket grows with a hash's frequency.  All three visits to the blocks read the same shuffled text.

Cases: a null or empty text has no words; a document with fewer words than a window loses none; repeated
rows with one id are earlier and later documents in the order of their texts; a null id counts as
smaller than all others; an empty table gives no row.  Columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .blocks import NO_ID, among, answers_to, block_count, bucket_count, in_blocks, mail_from
from .spark import table

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)  # every residue modulo 13 is a difference of two of these
ANCHOR = WINDOW - PERIOD + 1


class _Block:
    """The documents of a block in the order of (id, text), and their words."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("key", "ascending"), ("text", "ascending")])
        keys = rows.column("key").combine_chunks()
        self.null_key = pc.is_null(keys).to_numpy(zero_copy_only=False)
        self.keys = pc.fill_null(keys, NO_ID).to_numpy()
        order = np.argsort(self.keys, kind="stable")  # null ids first
        self.keys, self.null_key = self.keys[order], self.null_key[order]
        texts = textops.text_bytes(rows.column("text"))
        self.words = textops.Words([texts[i] for i in order])
        self.count = np.diff(self.words.first)
        self.of = self.words.text_of_word()
        self.place = self.words.place()

    def starts(self, length: int) -> np.ndarray:
        """All word indices at which ``length`` words of one document begin."""
        return np.flatnonzero(self.place + length <= self.count[self.of])

    def anchors(self, window: int, period: int, cover: tuple[int, ...], anchor: int) -> np.ndarray:
        on = np.zeros(period, dtype=bool)
        on[list(cover)] = True
        return np.flatnonzero(on[self.place % period] & (self.place + anchor <= self.count[self.of])
                              & (self.count[self.of] >= window))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW,
                   period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Rows (key, text, n_words, n_removed): each document's kept words, joined by one space."""
    anchor = window - period + 1
    if anchor < 1 or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("cover must be a difference cover modulo period, and period at most window")
    blocks = block_count(docs.count())
    buckets = bucket_count(docs.sparkSession, blocks)
    texts = in_blocks(docs, text, key, blocks)
    mail = T.StructType.fromDDL("bucket int, block int, h binary, twice binary")
    starts = T.StructType.fromDDL("bucket int, block int, h binary, key binary")
    answer = T.StructType.fromDDL("block int, h binary")
    out = T.StructType.fromDDL("key long, text string, n_words long, n_removed long")

    def send_anchors(rows: pa.Table) -> pa.Table:
        b = _Block(rows)
        h = textops.windows(b.words.hash, b.anchors(window, period, cover, anchor), anchor)
        h, n = np.unique(h, return_counts=True)
        return mail_from(rows.column("block")[0].as_py(), h, buckets, twice=n > 1)

    def shared_anchors(rows: pa.Table) -> pa.Table:
        h, sizes = textops.joined(rows.column("h"), np.uint64)
        twice, _ = textops.joined(rows.column("twice"), bool)
        block = np.repeat(rows.column("block").to_numpy(), sizes)
        _, group, n = np.unique(h, return_inverse=True, return_counts=True)
        often = n > 1
        often[group[twice]] = True
        return answers_to(block[often[group]], h[often[group]])

    def send_windows(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return mail_from(0, np.empty(0, np.uint64), 1, key=np.empty(0, np.int64))
        b = _Block(rows)
        at = b.anchors(window, period, cover, anchor)
        at = at[among(textops.windows(b.words.hash, at, anchor), answers)]
        # windows around an anchor start up to period - 1 words before it
        around = np.zeros(len(b.place) + 1, dtype=np.int32)
        np.add.at(around, at - np.minimum(b.place[at], period - 1), 1)
        np.add.at(around, at + 1, -1)
        may = b.starts(window)
        may = may[np.cumsum(around[:-1])[may] > 0]
        h, first = np.unique(textops.windows(b.words.hash, may, window), return_index=True)
        return mail_from(rows.column("block")[0].as_py(), h, buckets, key=b.keys[b.of[may[first]]])

    def later_windows(rows: pa.Table) -> pa.Table:
        h, sizes = textops.joined(rows.column("h"), np.uint64)
        keys, _ = textops.joined(rows.column("key"), np.int64)
        block = np.repeat(rows.column("block").to_numpy(), sizes)
        order = np.lexsort((keys, h))
        later = order[1:][h[order[1:]] == h[order[:-1]]]  # all but the first block of a hash
        return answers_to(block[later], h[later])

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(out.fields, (pa.int64(), pa.string(), pa.int64(), pa.int64()))})
        b = _Block(rows)
        at = b.starts(window)
        h = textops.windows(b.words.hash, at, window)
        later = among(h, answers)
        again = np.ones(len(at), dtype=bool)
        again[np.unique(h, return_index=True)[1]] = False
        at = at[later | again]
        covered = np.zeros(len(b.place) + 1, dtype=np.int32)
        covered[at] += 1
        covered[at + window] -= 1
        gone = np.cumsum(covered[:-1]) > 0
        removed = np.bincount(b.of[gone], minlength=len(b.keys))
        return pa.table({"key": pa.array(b.keys, pa.int64(), mask=b.null_key),
                         "text": pa.array(b.words.kept_texts(~gone), pa.string()),
                         "n_words": pa.array(b.count, pa.int64()), "n_removed": pa.array(removed, pa.int64())})

    shared = texts.groupBy("block").applyInArrow(send_anchors, mail).groupBy("bucket").applyInArrow(shared_anchors, answer)
    later = (texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_windows, starts)
             .groupBy("bucket").applyInArrow(later_windows, answer))
    return (texts.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(cut, out)
            .withColumnRenamed("key", key))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without repeated 20-word windows; a digest instead of the kept text."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
