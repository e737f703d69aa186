"""Fill-in-the-middle transformation by repeated-capture matching.

One ``fullmatch`` of ``(unit)*`` with the regex library covers a text and keeps the end of every repetition:
``match.ends(1)`` gives the number of units and, looked up at two places, both cuts.  Units are lines with
their line feed.  The places come from a hash of the document's id, so a rerun cuts alike.

A document becomes ``<S>suffix<P>prefix<M>middle`` (spm), ``<P>prefix<S>suffix<M>middle`` (psm) or, if it is empty,
holds a marker or is not drawn, stays as it is (plain).  :func:`restored` rebuilds the text from output and form.

Cases: a null text counts as empty; an empty text has no unit and is plain; a null id is hashed as an empty
string; rows with equal ids are cut at equal draws, each in its own text; parts may be empty; an empty table
gives no row.  Columns other than the id and the text are ignored, whatever their names.  Very long texts are
matched whole, one at a time: the memory of a task grows with its longest text and with MOST_UNITS.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark import table
from .textops import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# possessive: a line is never given back, so the matcher keeps no states to return to
LINE = r"[^\n]*+\n|[^\n]++"
MOST_UNITS = 1 << 18
SEED = 7
RATE = 100
SPM_RATE = 50


def draws(key: Column, seed: int = SEED, count: int = 4) -> list[Column]:
    """The first 8-digit groups of the hexadecimal sha256 of ``<seed>:<key>`` as integers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def unit_pattern(unit: str = LINE) -> regex.Pattern:
    return regex.compile(f"({unit}){{0,{MOST_UNITS}}}+")


def unit_ends(text: str, units: regex.Pattern) -> Sequence[int]:
    """The end of each unit, from one match of the whole text.

    A match keeps about 300 bytes for a repetition, so a text of more than MOST_UNITS units is covered by
    several matches, each from the end of the one before."""
    whole = units.fullmatch(text)
    if whole:
        return whole.ends(1)
    ends, at = array("q"), 0
    while at < len(text):
        ends.extend(units.match(text, at).ends(1))
        if not ends or ends[-1] == at:
            raise ValueError(f"the unit does not match the text from position {at}")
        at = ends[-1]
    return ends


def transform(text: str, h1: int, h2: int, h3: int, h4: int, units: regex.Pattern, rate: int, spm_rate: int) -> tuple:
    """(n, form, prefix, middle and suffix length, output) of one text; lengths in code points, None if plain."""
    ends = unit_ends(text, units)
    n = len(ends)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    if h4 % 100 < spm_rate:
        out, form = f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}", "spm"
    else:
        out, form = f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}", "psm"
    return n, form, a, b - a, len(text) - b, out


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = LINE, seed: int = SEED,
                   rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Rows (key, n, form, prefix_chars, middle_chars, suffix_chars, output), one for each row of ``docs``.

    ``rate`` and ``spm_rate`` are percentages: of documents that are transformed, and of these in the form spm.
    ``unit`` must match every text as a whole when repeated."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n", T.LongType()),
                           T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                           T.StructField("middle_chars", T.LongType()), T.StructField("suffix_chars", T.LongType()),
                           T.StructField("output", T.StringType())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = unit_pattern(unit)
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                drawn = [batch.column(j).slice(a, b - a).to_pylist() for j in range(2, 6)]
                rows = [transform(t.decode("utf-8", "replace"), *h, units, rate, spm_rate) for t, *h in zip(texts, *drawn)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], schema.names)

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"),
                       *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col(key), seed), 1)]).mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that a row's output was made of.

    Transformed texts hold no marker, and a marker cannot begin inside the text before another one, so the
    first of each is the one that was put there."""
    out, kind = F.col(output), F.col(form)

    def between(left: str, right: str | None) -> Column:
        after = F.substring(out, F.locate(left, out) + F.lit(len(left)), F.char_length(out))
        return F.substring_index(after, right, 1) if right else after

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(kind == "plain", out).when(kind == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, forms and digests of all ``documents``."""
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select(F.col("key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1,
         CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c3,
         CAST('0x' || h[25:32] AS BIGINT) % 100 AS c4
  FROM units
), cut AS (
  SELECT doc_id, t, n, least(c1, c2) AS lo, greatest(c1, c2) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 100 THEN 'plain'
              WHEN c4 < 50 THEN 'spm' ELSE 'psm' END AS form, u
  FROM drawn
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m,
         array_to_string(u[hi + 1:n], '') AS s
  FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
