"""Language identification by rank-order profiles of letter n-grams.

A profile is the list of a language's most frequent 1- to 3-grams of letters, words padded with one
blank on each side, in the order of their frequency.  A document's own most frequent n-grams are ranked
in the same way; its out-of-place distance to a profile is the sum over them of the difference of the two
ranks, at most ``PROFILE`` and ``PROFILE`` for an n-gram that the profile lacks.  The nearest profile wins,
and the score is one minus its distance over the largest possible one.

Profiles are fitted on a sample of each language's labelled documents, chosen by a hash of the id (of the
text where the id is null): all of a language with at most ``SAMPLE`` documents and about ``SAMPLE`` of a
larger one (the documented bound of the fit), so every label has a profile at every table size.  All
documents are predicted from whole texts.

Cases: null text, or one without a letter, gives ``und`` with score 0, and so does every text if there is
no labelled document; ties go to the language first in code point order; repeated rows get equal rows; an
empty table gives no row.  Only the text is used in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .spark import table, written

PROFILE = 400
SAMPLE = 20_000
MOST_LANGUAGES = 10_000  # bounds what is broadcast and what the driver holds
UNKNOWN = "und"
_SLICE = 1 << 20  # bytes of text at once
_BITS = 18  # of a letter's code: 0 pads an n-gram, 1 is a blank, letters follow
_DOCS = 1 << (64 - 3 * _BITS)  # texts at once: their number and an n-gram are one 64-bit key
_LAST = 0x34000  # above all code points of letters


def letter_codes() -> np.ndarray:
    """Code of every code point: letters are numbered, upper case as lower case, 0 for anything else."""
    codes, number = np.zeros(0x110000, dtype=np.uint32), {}
    for c in range(_LAST):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            codes[c] = number.setdefault(low if len(low) == 1 else ch, len(number) + 2)
    return codes


def _slices(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of texts of about ``_SLICE`` bytes and at most ``_DOCS`` texts."""
    for a, b, texts in textops.slices(column, _SLICE):
        for i in range(0, b - a, _DOCS):
            yield a + i, min(a + i + _DOCS, b), texts[i:i + _DOCS]


def _grams(texts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) of all n-grams, ordered by document and n-gram."""
    raw = b"\n".join([*texts, b""])
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    first = np.array([len(t.decode("utf-8", "replace")) + 1 for t in texts], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), first)
    c = codes[points].astype(np.uint64)
    letter = c > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank behind each word
    c, doc, letter = c[keep], doc[keep], letter[keep]
    c[~letter] = 1
    if not len(c):
        none = np.empty(0, np.int64)
        return none, none, none
    c, doc, letter = np.append(np.uint64(1), c), np.append(0, doc), np.append(False, letter)
    d = doc.astype(np.uint64) << np.uint64(3 * _BITS)
    two, both = c[:-1] << np.uint64(_BITS) | c[1:], letter[:-1] | letter[1:]
    three = two[:-1] << np.uint64(_BITS) | c[2:]
    keys = np.concatenate([(d | c)[letter], (np.where(letter[:-1], d[:-1], d[1:]) | two)[both],
                           (d[1:-1] | three)[letter[1:-1]]])
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> np.uint64(3 * _BITS)).astype(np.int64), (keys & np.uint64((1 << 3 * _BITS) - 1)).astype(np.int64), count


def fit(docs: DataFrame, labelled: Column, text: str = "text", lang: str = "lang", key: str = "doc_id",
        profile: int = PROFILE, sample: int = SAMPLE) -> list[tuple[str, list[int]]]:
    """The languages of the rows where ``labelled`` holds and their profiles, at most ``profile`` n-grams each."""
    rows = docs.where(labelled & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
        F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text))), F.lit(1 << 40)).alias("deal"))
    # a row per language, fewer than the profile rows that are collected below; the smallest hash is always in
    most = written(rows.groupBy(F.col("lang").alias("_lang")).agg(F.greatest(F.min("deal"), F.floor(
        F.least(F.lit(1.0), F.lit(float(sample)) / F.count(F.lit(1))) * (1 << 40))).alias("most")), "languages")
    if (many := most.count()) > MOST_LANGUAGES:
        raise ValueError(f"column {lang} has {many} values, more than {MOST_LANGUAGES}: it does not name languages")
    rows = rows.join(F.broadcast(most), F.col("lang") == F.col("_lang")).where("deal <= most")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = letter_codes()
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for name in sorted(set(names)):
                for _, _, texts in _slices(batch.column(1).filter(pa.array(names == name))):
                    _, gram, n = _grams(texts, codes)
                    gram, group = np.unique(gram, return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(gram), pa.string()), pa.array(gram, pa.int64()),
                         pa.array(np.bincount(group, weights=n, minlength=len(gram)).astype(np.int64))], ["lang", "gram", "n"])

    counts = (rows.select("lang", "text")
              .mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").select("lang", "gram").collect():  # profile rows per language
        out.setdefault(r["lang"], []).append(r["gram"])
    return sorted(out.items())


def predict(docs: DataFrame, profiles: list[tuple[str, list[int]]], text: str = "text", keep: tuple[str, ...] = (),
            size: int = PROFILE) -> DataFrame:
    """Rows of the columns ``keep``, then lang_pred and score.  The text is read from ``keep`` if it is there."""
    keep = list(keep)
    place = keep.index(text) if text in keep and docs.schema[text].dataType == T.StringType() else len(keep)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    names = [name for name, _ in profiles]
    vocabulary = np.unique(np.array([g for _, grams in profiles for g in grams], dtype=np.int64))
    ranks = np.full((len(vocabulary) + 1, len(profiles)), size, dtype=np.int64)  # last row: n-grams of no profile
    for j, (_, grams) in enumerate(profiles):
        ranks[np.searchsorted(vocabulary, grams), j] = np.arange(len(grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = letter_codes()
        for batch in batches:
            for a, b, texts in _slices(batch.column(place)):
                n = b - a
                doc, gram, count = _grams(texts, codes)
                order = np.lexsort((gram, -count, doc)) if n == 1 else _ranked(doc, gram, count)
                doc, gram = doc[order], gram[order]
                rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(n))[doc]
                top = rank < size
                doc, gram, rank = doc[top], gram[top], rank[top]
                at = np.minimum(np.searchsorted(vocabulary, gram), max(len(vocabulary) - 1, 0))
                if len(vocabulary):
                    at[vocabulary[at] != gram] = len(vocabulary)
                far = np.zeros((n, len(names)))
                for j in range(len(names)):
                    theirs = ranks[at, j]
                    apart = np.where(theirs < size, np.minimum(np.abs(theirs - rank), size), size)
                    far[:, j] = np.bincount(doc, weights=apart, minlength=n)
                most = np.bincount(doc, minlength=n) * float(size)
                known = most > 0 if names else np.zeros(n, dtype=bool)
                best = np.argmin(far, axis=1) if names else np.zeros(n, dtype=np.int64)
                score = np.where(known, 1 - (far[np.arange(n), best] if names else 0) / np.maximum(most, 1), 0.0)
                label = [names[i] if k else UNKNOWN for i, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i)[a:b] for i in range(len(keep))],
                                                  pa.array(label, pa.string()), pa.array(score, pa.float64())], schema.names)

    more = [F.col(text).cast("string").alias("_text")] if place == len(keep) else []
    return docs.select(*keep, *more).mapInArrow(run, schema)


def _ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Order by document, falling count, n-gram: rows come ordered by (document, n-gram)."""
    high = np.uint64((1 << 24) - 1)
    place = np.arange(len(doc), dtype=np.uint64)
    if len(doc) >= 1 << 26 or len(doc) and (doc[-1] >= 1 << 14 or count.max() >= 1 << 24):
        return np.lexsort((gram, -count, doc))
    packed = doc.astype(np.uint64) << np.uint64(50) | (high - count.astype(np.uint64)) << np.uint64(26) | place
    packed.sort()
    return (packed & np.uint64((1 << 26) - 1)).astype(np.int64)


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all ``documents``, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs, ~F.coalesce(held_out(), F.lit(False)))
    return predict(docs, profiles, keep=("doc_id",)).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
