"""Spelling variants: words at one edit from each other, grouped under much more frequent ones.

1. Words are letter runs of whole texts, A-Z lower-cased.  ``deletions`` takes a code point out of a run whose
   hash with its document's id is divisible by ``one_in`` (a source of misspellings for tests of the grouping).  Runs are
   counted per word before the shuffle.
2. Two words are at one edit if their common prefix and common suffix together reach the longer length L
   minus one.  Then for a step g one of the places j = 0, g, 2g, ... has a common suffix of j and a common
   prefix of L - j - g code points.  So words of length L and L - 1 are posted under these parts: only words
   that share one can be near.  A pair is reported by the first place that fits it, so no pair comes twice.
3. The words under one key form blocks of at most about SIDE words.  Each pair of blocks is a tile;
   a word goes to the tiles of its block.  Tiles are shuffled, and those that come together are compared densely: a padded matrix
   of code points against another gives all first differences, from the left for prefixes, from the right for suffixes.
4. Each word's form is the near word with the largest count, if that is RATIO times its own.  Counts grow
   along forms, so chains are short and have an end; they are followed by doubling.

A word has at most (2L + 1) times the alphabet's size near words, so neither grouping by word nor the chains
can have a hot key.

Cases: a null text has no words; a null id counts as an empty string; repeated rows count again; words of
equal count are ordered by code point; a run of any length is one word, and long words make small tiles; an
empty table gives no row.  Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.broadcast import split_by_heat
from .spark import table, written

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
ONE_IN = 31
STEP = 4    # code points that a place leaves open
PLACES = 4  # at most; the step grows with very long words
SIDE = 256
ROWS = 64        # compared at once with as many others; many tiles are smaller
CELLS = 1 << 20  # at most: words x words x code points


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id", letters: str = LETTERS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Rows (key, run): every maximal run of ``letters`` with at least ``least_length`` code points, A-Z lower-cased.

    A greedy match takes a run whole, and deletions only shorten it: shorter runs give no word."""
    found = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"{letters}{{{least_length},}}"), F.lit(0))
    return (docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(found).alias("run"))
            .withColumn("run", F.translate("run", UPPER, LOWER)))


def deletions(found: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """The runs with a code point deleted where ``one_in`` divides crc32 of ``<key>:<run>``, at that hash modulo the length."""
    h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return found.withColumn("h", h).select("key", F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("run"))


def vocabulary(found: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n) of the runs with enough code points and occurrences."""
    return (found.where(F.char_length("run") >= least_length).groupBy(F.col("run").alias("word"))
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


def _step(length: Column) -> Column:
    return F.greatest(F.lit(STEP), F.ceil(length / F.lit(PLACES))).cast("int")


def postings(words: DataFrame) -> DataFrame:
    """Rows (word, n, longer, step, place, part): a word under each part of it that a near word can share.

    ``longer`` is the longer length of the pairs meant: the word's own, and one more."""
    length = F.char_length("word")
    both = (words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer"))
            .withColumn("step", _step(F.col("longer"))))
    placed = both.withColumn("place", F.explode(F.sequence(F.lit(0), F.floor((F.col("longer") - 1) / F.col("step")).cast("int"))))
    after = F.col("place") * F.col("step")
    prefix = F.substring(F.col("word"), F.lit(1), F.greatest(F.lit(0), F.col("longer") - after - F.col("step")))
    suffix = F.when(after > 0, F.substring(F.col("word"), -after, after)).otherwise("")
    return placed.withColumn("part", F.xxhash64("longer", "place", prefix, F.lit("/"), suffix))


def tiles(posted: DataFrame) -> DataFrame:
    """Rows (part, lo, hi, block, word, n, longer, step, place): each word in the tiles of its block.

    The words of a part are dealt over blocks by a hash.  Parts of one word are left out."""
    counts = written(posted.groupBy("part").agg(F.count(F.lit(1)).alias("many"), F.max("longer").alias("_longer"))
                     .where("many > 1"), "parts")
    hot, rest = split_by_heat(counts.select("part", "many"), "many", posted.count())
    sized = posted.join(hot, "part").unionByName(posted.join(rest, "part"))
    side = F.greatest(F.lit(1), F.least(F.lit(SIDE), F.floor(F.sqrt(F.lit(float(CELLS)) / F.col("longer")))))
    blocks = F.ceil(F.col("many") / side).cast("int")
    sized = sized.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    sized = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return sized.select("part", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block",
                        "word", "n", "longer", "step", "place")


def _first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of ``a`` with each row of ``b`` (equal rows: 0)."""
    return np.argmax(a[:, None, :] != b[None, :, :], axis=2)


def _matrix(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def compare(tile: np.ndarray, block: np.ndarray, lo: np.ndarray, hi: np.ndarray, longer: np.ndarray, step: np.ndarray,
            place: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words at one edit among rows of whole tiles, ordered by tile.

    Rows are compared as blocks of consecutive rows, whatever tiles they belong to, as long as two blocks
    have a tile in common; what belongs to different tiles is masked."""
    width = int(longer.max())
    left, right = _matrix(words, width), _matrix([w[::-1] for w in words], width)
    length = np.array([len(w) for w in words])
    side = max(1, min(ROWS, int((CELLS / width) ** 0.5)))
    first, last = np.searchsorted(tile, tile, "left"), np.searchsorted(tile, tile, "right")
    out_a, out_b = [], []
    for i in range(0, len(words), side):
        a = slice(i, min(i + side, len(words)))
        for j in range(int(first[i]) // side * side, i + 1, side):
            b = slice(j, min(j + side, len(words)))
            if last[b.stop - 1] <= i and j < i:
                continue
            prefix, suffix = _first_difference(left[a], left[b]), _first_difference(right[a], right[b])
            long = longer[a][:, None]
            near = (tile[a][:, None] == tile[b][None, :]) & (prefix + suffix >= long - 1)
            near &= (long == longer[b][None, :]) & (np.maximum(length[a][:, None], length[b][None, :]) == long)
            # two blocks of one part: pairs inside one of them belong to that block's own tile
            near &= (lo[a] == hi[a])[:, None] | (block[a][:, None] != block[b][None, :])
            # the first place that fits the pair reports it
            fits = np.maximum(0, -(-(long - prefix) // step[a][:, None]) - 1)
            near &= fits == place[a][:, None]
            x, y = np.nonzero(near)
            if j == i:
                x, y = x[x > y], y[x > y]
            out_a.append(x + i)
            out_b.append(y + j)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, int), np.empty(0, int))


_TILE = ["part", "lo", "hi"]


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (word, n, near, near_n), each pair of words at one edit in both directions."""
    placed = tiles(written(postings(words), "postings"))
    dealt = placed.repartition(*_TILE).sortWithinPartitions("longer", *_TILE)

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        col = {c: rows.column(c).to_numpy() for c in ("part", "lo", "hi", "block", "longer", "step", "place", "n")}
        new = np.zeros(len(col["part"]), dtype=np.int64)
        for c in _TILE:
            new[1:] |= col[c][1:] != col[c][:-1]
        names = rows.column("word").to_pylist()
        a, b = compare(np.cumsum(new), col["block"], col["lo"], col["hi"], col["longer"], col["step"], col["place"], names)
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in x], pa.string()), pa.array(col["n"][x]),
                                           pa.array([names[i] for i in y], pa.string()), pa.array(col["n"][y])],
                                          ["word", "n", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows from the start of a tile that may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            keys = [rows.column(c).to_numpy() for c in _TILE]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            others = np.flatnonzero(~same)
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut:
                yield from by_width(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and len(held):
            yield from by_width(held)

    def by_width(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows are ordered by length; a stretch of lengths that need similar widths is one comparison."""
        longer = rows.column("longer").to_numpy()
        at = 0
        while at < len(longer):
            end = int(np.searchsorted(longer, max(longer[at] + 8, longer[at] * 5 // 4), "right"))
            yield pairs(rows.slice(at, end - at))
            at = end

    return dealt.mapInArrow(run, "word string, n long, near string, near_n long")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Rows (word, n, form, n_near, form_n) of the words: how many are near, and the one to write instead."""
    near = near_pairs(words)
    per = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("b"))
    out = words.join(per, "word", "left")
    much = -F.col("b.m") >= F.col("n") * ratio
    return out.select("word", "n", F.when(much, F.col("b.near")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                      F.when(much, -F.col("b.m")).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """``formed`` (a written table) with ``root``, the last word of each chain of forms."""
    links = written(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:  # doubling: the logarithm of the longest chain in rounds
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = links.join(onward, "root")
        if step.isEmpty():
            break
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", one_in: int | None = None) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of the words of ``docs``."""
    found = runs(docs, text, key)
    words = written(vocabulary(found if one_in is None else deletions(found, one_in)), "words")
    formed = written(forms(words), "forms")
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all ``documents``, with deletions by hash."""
    return variants(table(spark, sf_dir, "documents"), one_in=ONE_IN)
