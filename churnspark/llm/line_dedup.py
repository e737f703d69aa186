"""Removing lines that an earlier line equals but for at most one edit.

A line that is not blank is dropped if an earlier line (smaller document id, then smaller line number)
equals it or differs from it by one inserted, deleted or replaced character.  Lines are judged on the
input, not on what is left, so the earliest of a group stays.

1. Equal lines: blocks send the hashes of their lines, and buckets answer which have an earlier place.
2. A coarse pass over the first places of distinct lines leaves those that may have a neighbour: two
   lines within one edit agree outside one of ``SEGMENTS`` parts, so lines send one hash for each part
   left out, and only parts whose hash another line shares are looked at further.
3. The deletion neighbourhood of such a part: every variant of the line with one character of the part
   deleted.  Lines that share a variant *and* the place of the deletion differ by a replacement; a line
   that equals another's variant differs by an insertion.  Either group needs only its earliest member,
   so no pairs are listed, however many lines share a variant.
4. Each line found is joined with the text of its earlier neighbour, and their edit distance verified.

Cases: null text stays null and has no lines; blank lines are never dropped; repeated rows with one id
are earlier and later documents in the order of their texts; a null id counts as smaller than all
others; an empty table gives no row.  Other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .blocks import NO_ID, among, answers_to, block_count, bucket_count, in_blocks, mail_from
from .spark import table

SEGMENTS = 4
QUANTUM = 16
REPLACED, LONGER, ITSELF = 0, 1, 2


def _line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def _weights(n: int) -> np.ndarray:
    return textops.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _Lines:
    """The lines of a block, in the order of (id, text, line number); blank lines are left out."""

    def __init__(self, rows: pa.Table):
        keys = rows.column("key").combine_chunks()
        order = pc.sort_indices(pa.table({"k": pc.fill_null(keys, NO_ID), "t": rows.column("text")}),
                                sort_keys=[("k", "ascending"), ("t", "ascending")])
        self.order = order.to_numpy()
        self.keys = pc.fill_null(keys, NO_ID).to_numpy()[self.order]
        column = rows.column("text").to_pylist()
        self.texts = [column[i] for i in self.order]
        self.split = [t.split("\n") if t is not None else [] for t in self.texts]
        self.line, self.doc, self.number, hashes = [], [], [], []
        before, last = 0, None
        for d, lines in enumerate(self.split):
            # rows of one id count their lines on, so that (id, number) stays a place
            before = before if last == self.keys[d] else 0
            last = self.keys[d]
            for i, x in enumerate(lines):
                if x and not x.isspace():
                    self.line.append(x)
                    self.doc.append(d)
                    self.number.append(before + i)
                    hashes.append(_line_hash(x))
            before += len(lines)
        self.hash = np.array(hashes, dtype=np.uint64)
        self.doc = np.array(self.doc, dtype=np.int64)
        self.number = np.array(self.number, dtype=np.int64)
        self.key = self.keys[self.doc] if len(self.doc) else np.empty(0, np.int64)
        self.first = np.unique(self.hash, return_index=True)[1]


def _parts(line: str, segments: int, quantum: int) -> list[tuple[int, int, int]]:
    """(hash of the line without the part, from, to) for each part; none for a line too short to divide.

    Part sizes come from a rounded length, and from those of lengths one off, so that two lines within
    one edit have a division in common."""
    n = len(line)
    out = []
    for size in {(m // quantum) * (quantum // segments) for m in (n - 1, n, n + 1)}:
        for j in range(segments if size else 0):
            a, b = j * size, n - (segments - 1 - j) * size
            if a <= b:
                rest = f"{size} {j} {line[:a]}\0{line[b:]}"
                out.append((xxhash.xxh3_64_intdigest(rest.encode("utf-8", "surrogatepass")), a, b))
    return out


def _variants(line: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash of the line without character i, i) for the i of the spans, and the hash of the line itself."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(c)
    w = _weights(n)
    own = np.concatenate([[np.uint64(0)], np.cumsum(c * w)])
    moved = np.concatenate([[np.uint64(0), np.uint64(0)], np.cumsum(c[1:] * w[:-1])])  # one place to the left
    at = np.unique(np.concatenate([np.arange(a, b) for a, b in spans])) if spans else np.empty(0, np.int64)
    at = at.astype(np.int64)
    h = own[at] + moved[n] - moved[at + 1] + np.uint64(n - 1)
    return textops.mix(h), at, int(textops.mix(own[n:n + 1] + np.uint64(n))[0])


def drop_similar_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", segments: int = SEGMENTS,
                       quantum: int = QUANTUM) -> DataFrame:
    """The rows of ``docs`` with ``text`` cut to its kept lines; adds n_lines (not blank) and n_removed."""
    blocks = block_count(docs.count())
    buckets = bucket_count(docs.sparkSession, blocks)
    others = [c for c in docs.columns if c not in (text, key)]
    texts = in_blocks(docs, text, key, blocks, F.struct(*[F.col(f"`{c}`") for c in others]) if others else None)
    mail = T.StructType.fromDDL("bucket int, block int, h binary, key binary")
    part_mail = T.StructType.fromDDL("bucket int, block int, h binary, line binary, more binary")
    variant_mail = T.StructType.fromDDL("bucket int, block int, h binary, role binary, key binary, number binary")
    answer = T.StructType.fromDDL("block int, kind int, h binary")
    found = T.StructType.fromDDL("key long, number long, earlier_key long, earlier_number long")
    line_text = T.StructType.fromDDL("key long, number long, line string")
    EQUAL, PART = 0, 1

    def send_lines(rows: pa.Table) -> pa.Table:
        b = _Lines(rows)
        return mail_from(rows.column("block")[0].as_py(), b.hash[b.first], buckets, key=b.key[b.first])

    def later_lines(rows: pa.Table) -> pa.Table:
        h, sizes = textops.joined(rows.column("h"), np.uint64)
        keys, _ = textops.joined(rows.column("key"), np.int64)
        block = np.repeat(rows.column("block").to_numpy(), sizes)
        order = np.lexsort((keys, h))
        later = order[1:][h[order[1:]] == h[order[:-1]]]
        out = answers_to(block[later], h[later])
        return out.add_column(1, "kind", pa.array(np.full(out.num_rows, EQUAL), pa.int32()))

    def send_parts(rows: pa.Table) -> pa.Table:
        b = _Lines(rows)
        one: dict[int, int] = {}
        more: set[int] = set()
        for i in b.first:
            own = int(b.hash[i])
            for h, _, _ in _parts(b.line[i], segments, quantum):
                if one.setdefault(h, own) != own:
                    more.add(h)
        return mail_from(rows.column("block")[0].as_py(), np.fromiter(one, np.uint64, len(one)), buckets,
                         line=np.fromiter(one.values(), np.uint64, len(one)),
                         more=np.fromiter((h in more for h in one), bool, len(one)))

    def shared_parts(rows: pa.Table) -> pa.Table:
        h, sizes = textops.joined(rows.column("h"), np.uint64)
        line, _ = textops.joined(rows.column("line"), np.uint64)
        more, _ = textops.joined(rows.column("more"), bool)
        block = np.repeat(rows.column("block").to_numpy(), sizes)
        seen, group = np.unique(h, return_inverse=True)
        shared = np.zeros(len(seen), dtype=bool)
        shared[group[more]] = True
        order = np.lexsort((line, h))
        differs = (h[order[1:]] == h[order[:-1]]) & (line[order[1:]] != line[order[:-1]])
        shared[group[order[1:][differs]]] = True
        out = answers_to(block[shared[group]], h[shared[group]])
        return out.add_column(1, "kind", pa.array(np.full(out.num_rows, PART), pa.int32()))

    def candidates(rows: pa.Table, answers: pa.Table):
        """(lines of the block, [(index of a line that is first anywhere, spans to look at)])"""
        b = _Lines(rows)
        later = among(b.hash[b.first], answers.filter(pc.equal(answers.column("kind"), EQUAL)))
        shared, _ = textops.joined(answers.filter(pc.equal(answers.column("kind"), PART)).column("h"), np.uint64)
        shared = set(shared.tolist())
        out = []
        for i, is_later in zip(b.first, later):
            if not is_later:
                parts = _parts(b.line[i], segments, quantum)
                spans = [(x, y) for h, x, y in parts if h in shared]
                if len(b.line[i]) <= quantum:  # a neighbour may be too short to divide
                    spans = [(0, len(b.line[i]))]
                if spans:
                    out.append((int(i), spans))
        return b, out

    def send_variants(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            none = np.empty(0, np.int64)
            return mail_from(0, none.astype(np.uint64), 1, role=none.astype(np.int8), key=none, number=none.astype(np.int64))
        b, some = candidates(rows, answers)
        h, role, of = [], [], []
        for i, spans in some:
            v, at, own = _variants(b.line[i], spans)
            h += [textops.mix(v ^ textops.mix(at.astype(np.uint64) + np.uint64(1))), v, np.array([own], np.uint64)]
            role += [np.full(len(v), REPLACED, np.int8), np.full(len(v), LONGER, np.int8), np.array([ITSELF], np.int8)]
            of.append(np.full(2 * len(v) + 1, i))
        of = np.concatenate(of) if of else np.empty(0, np.int64)
        return mail_from(rows.column("block")[0].as_py(), np.concatenate(h) if h else np.empty(0, np.uint64), buckets,
                         role=np.concatenate(role) if role else np.empty(0, np.int8), key=b.key[of],
                         number=b.number[of])

    def neighbours(rows: pa.Table) -> pa.Table:
        h, _ = textops.joined(rows.column("h"), np.uint64)
        role, _ = textops.joined(rows.column("role"), np.int8)
        key, _ = textops.joined(rows.column("key"), np.int64)
        number, _ = textops.joined(rows.column("number"), np.int64)
        inserted = role != REPLACED
        losers, winners = [], []

        def earliest(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the entries ``some``: each one's hash group, and the first entry of each group."""
            order = some[np.lexsort((number[some], key[some], h[some]))]
            start = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]])) if len(order) else np.empty(0, np.int64)
            return order, np.repeat(order[start], np.diff(np.append(start, len(order))))

        order, first = earliest(np.flatnonzero(~inserted))
        losers.append(order), winners.append(first)
        # a line that equals variants: the earlier of it and the longer lines
        selves = np.flatnonzero(role == ITSELF)
        longer, first = earliest(np.flatnonzero(role == LONGER))
        if len(selves) and len(longer):
            selves = selves[np.argsort(h[selves], kind="stable")]
            at = np.minimum(np.searchsorted(h[selves], h[longer]), len(selves) - 1)
            has = h[selves][at] == h[longer]
            losers += [longer[has], selves[at[has]]]
            winners += [selves[at[has]], first[has]]
        loser, winner = np.concatenate(losers), np.concatenate(winners)
        later = (key[winner] < key[loser]) | ((key[winner] == key[loser]) & (number[winner] < number[loser]))
        loser, winner = loser[later], winner[later]
        pairs = np.unique(np.stack([key[loser], number[loser], key[winner], number[winner]], axis=1), axis=0)
        return pa.table({n: pa.array(pairs[:, i], pa.int64()) for i, n in enumerate(found.names)})

    def texts_of(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "number": pa.array([], pa.int64()), "line": pa.array([], pa.string())})
        b, some = candidates(rows, answers)
        at = [i for i, _ in some]
        return pa.table({"key": pa.array(b.key[at], pa.int64()), "number": pa.array(b.number[at], pa.int64()),
                         "line": pa.array([b.line[i] for i in at], pa.string())})

    equal = texts.groupBy("block").applyInArrow(send_lines, mail).groupBy("bucket").applyInArrow(later_lines, answer)
    parts = texts.groupBy("block").applyInArrow(send_parts, part_mail).groupBy("bucket").applyInArrow(shared_parts, answer)
    told = texts.groupBy("block").cogroup(equal.unionByName(parts).groupBy("block"))
    pairs = told.applyInArrow(send_variants, variant_mail).groupBy("bucket").applyInArrow(neighbours, found).distinct()
    lines = told.applyInArrow(texts_of, line_text)
    near = (pairs.join(lines, ["key", "number"])
            .join(lines.select(F.col("key").alias("earlier_key"), F.col("number").alias("earlier_number"),
                               F.col("line").alias("earlier")), ["earlier_key", "earlier_number"])
            .where(F.levenshtein("line", "earlier", 1) >= 0).select("key", "number").distinct())
    # decisions by block: hashes with an earlier place, and places of lines with an earlier neighbour
    block = F.pmod(F.when(F.col("key") == NO_ID, 0).otherwise(F.col("key")), F.lit(blocks)).cast("int")
    decided = (equal.select("block", "h", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("number"))
               .unionByName(near.select(block.alias("block"), F.lit(None).cast("binary").alias("h"), "key", "number")))
    out = T.StructType([*texts.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.append_column("n_lines", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64()))
        b = _Lines(rows)
        drop = among(b.hash, answers.filter(pc.is_valid(answers.column("h"))))
        again = np.ones(len(b.hash), dtype=bool)
        again[b.first] = False
        drop |= again
        places = answers.filter(pc.is_valid(answers.column("number")))
        places = set(zip(places.column("key").to_pylist(), places.column("number").to_pylist()))
        if places:
            drop |= np.fromiter(((int(k), int(n)) in places for k, n in zip(b.key, b.number)), bool, len(b.key))
        gone: dict[int, list[int]] = {}
        base = {}
        before, last = 0, None
        for d, lines in enumerate(b.split):
            before = before if last == b.keys[d] else 0
            last, base[d] = b.keys[d], before
            before += len(lines)
        for i in np.flatnonzero(drop):
            d = int(b.doc[i])
            gone.setdefault(d, []).append(int(b.number[i]) - base[d])
        new = list(b.texts)
        for d, numbers in gone.items():
            hide = set(numbers)
            new[d] = "\n".join(x for i, x in enumerate(b.split[d]) if i not in hide)
        rows = rows.take(pa.array(b.order))
        rows = rows.set_column(rows.column_names.index("text"), "text", pa.array(new, pa.string()))
        n = np.bincount(b.doc, minlength=len(new)) if len(b.doc) else np.zeros(len(new), np.int64)
        removed = np.array([len(gone.get(d, ())) for d in range(len(new))], dtype=np.int64)
        return rows.append_column("n_lines", pa.array(n, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    done = texts.groupBy("block").cogroup(decided.groupBy("block")).applyInArrow(cut, out)
    back = [F.col("key").cast(docs.schema[c].dataType).alias(c) if c == key else F.col("text").alias(c) if c == text
            else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return done.select(*back, *[F.col(c) for c in ("n_lines", "n_removed") if c not in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without repeated or nearly repeated lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_similar_lines(docs)
