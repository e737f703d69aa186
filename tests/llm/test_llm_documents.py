"""Operators on documents: brute force on small tables and the cases that their docstrings define."""

import collections
import math
import random
import re
import zlib

import brute_force as brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from churnspark.llm import langid, licenses, line_dedup, mixing, near_dedup, packing, queries, substring_dedup
from churnspark.llm.spark import components, running_totals

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"
DDL = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, block string, rank int, class int"
ALIKE = " ".join(f"w{i}" for i in range(60))


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"long{i % 977}x{i % 31}" for i in range(30000))
    rows = [(1, ALIKE, "en", "a"), (2, ALIKE, "en", "a"), (2, ALIKE, "en", "a"), (3, None, None, None), (None, "null id here", "en", "b"),
            (4, "", "en", "b"), (5, " \t\n ", "fr", None), (6, "one", "en", "c"), (7, "one", "en", "c"), (8, long, "en", "c"),
            (9, long + " tail", "en", "d"), (10, "One", None, "d"), (11, "same line\nsame line\nsame lime\nother\n\n", "en", "e"),
            (-12, "same line\n" + ALIKE + "\nx", "de", "e"), (13, "ÉÀ ñ b\x1fc 😀 ſ", "fr", "é"), (14, "\x00a\x00 b", "en", ""), (2**40, "far", "en", "a")]
    return spark.createDataFrame([(i, t, la, s, None, "r", "k", "b", 1, 2) for i, t, la, s in rows], DDL)


def empty(spark):
    return odd_documents(spark).limit(0)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def in_order(docs):
    """By id, null first, rows of one id by text."""
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))


# ---------------------------------------------------------------- packing
@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def check_pieces(rows, docs, tokenizer, window):
    ids = {}
    for i, text in docs:
        ids.setdefault(i, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID])
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) == sum(map(len, ids[i]))
        for p in pieces:
            assert any(len(x) == p["doc_tokens"] and np.array(x[p["start"]:p["start"] + p["length"]], "<u4").tobytes() == p["ids"]
                       for x in ids[i])
    return by_sequence


@pytest.mark.parametrize("window, width", [(4096, 8), (64, 4)])
def test_packing_odd(spark, tokenizer, window, width):
    docs = odd_documents(spark)
    rows = packing.pack(docs, tokenizer[0], window, width).collect()
    check_pieces(rows, pairs(docs), tokenizer[1], window)
    assert packing.pack(empty(spark), tokenizer[0]).count() == 0


def test_packing_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = check_pieces(packing.pack(docs, tokenizer[0]).collect(), pairs(docs), tokenizer[1], 4096)
    sizes = [sum(p["length"] for p in s) for s in got.values()]
    assert sum(4096 - n for n in sizes if n & (n - 1)) < 0.05 * sum(sizes)
    first = queries.QUERIES["op1_packing"](spark, SF).collect()
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in first}
    assert all(crc[p["doc_id"], p["start"]] == zlib.crc32(p["ids"]) for s in got.values() for p in s)


def test_words_have_their_own_ids(tokenizer):
    encoder, r = packing._WordEncoder(tokenizer[0]), random.Random(3)
    letters = list("aZé́İßΣς \x1f‍😀中'sdl.,-1\x85ﬁ") + [" ", "\n", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(500)]
    for text, got in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert got.tolist() == tokenizer[1].encode(text, add_special_tokens=False).ids + [packing.END_ID]


def test_plan_holds_to_the_histogram():
    rng = np.random.default_rng(0)
    for scale in (1, 50, 5000):
        histogram = np.append(0, rng.integers(0, scale + 1, 64))
        places = packing.plan(histogram)
        used, seen = np.zeros(65, int), {}
        for c, a, b, s in places:
            used[c] += b - a
            for k in range(a, b):
                seen[s + k - a] = seen.get(s + k - a, 0) + c
        assert (used <= histogram).all() and set(seen.values()) <= {64}
        if scale == 5000:  # combinations explain most of an even histogram
            assert used.sum() > 0.6 * histogram.sum()
    # 6 windows of two halves, 2 of 1 + 7, 1 whole one
    x = packing.nnls(packing.fillings(8), np.array([0, 2, 0, 0, 12, 0, 0, 2, 1.0]))
    got = {tuple(p): round(v) for p, v in zip(packing.fillings(8).tolist(), x) if v > 0.5}
    assert got == {(4, 4, 0): 6, (1, 7, 0): 2, (8, 0, 0): 1}


# ---------------------------------------------------------------- language
def test_language_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = ~langid.held_out()
    profiles = langid.fit(docs, labelled, profile=60)
    codes = langid.letter_codes()

    def grams(text):
        count = {}
        for w in "".join(c if codes[ord(c)] else " " for c in text).split():
            c = [1, *(int(codes[ord(x)]) for x in w), 1]
            for n in (1, 2, 3):
                for i in range(len(c) - n + 1):
                    g = c[i:i + n]
                    if any(x != 1 for x in g):
                        k = sum(x << langid._BITS * (n - 1 - j) for j, x in enumerate(g))
                        count[k] = count.get(k, 0) + 1
        return sorted(count, key=lambda k: (-count[k], k))[:60]

    got = {r["doc_id"]: r for r in langid.predict(docs, profiles, keep=("doc_id",), size=60).collect()}
    for r in docs.collect():
        top = grams(r["text"] or "")
        far = []
        for name, p in profiles:
            place = {g: j for j, g in enumerate(p)}
            far.append((sum(min(abs(place[g] - i), 60) if g in place else 60 for i, g in enumerate(top)), name))
        best = min(far) if top else (0, "und")
        # a word's first blank is the one behind the word before: the first word of a text has none of its own
        assert got[r["doc_id"]]["lang_pred"] == best[1]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - best[0] / (60 * len(top)) if top else 0, abs=0.02)


def test_language_accuracy_and_odd(spark):
    out = queries.QUERIES["op2_language_id"](spark, SF_MORE)
    truth = spark.read.parquet(f"{SF_MORE}/documents.parquet").select("doc_id", "lang")
    held = out.join(truth, "doc_id").where("held_out and lang is not null")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    docs = odd_documents(spark)
    profiles = langid.fit(docs, F.lit(True))
    got = langid.predict(docs, profiles, keep=("doc_id",)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[3] == by[4] == by[5] == "und" and by[1] != "und"
    assert langid.predict(docs, [], keep=("doc_id",)).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty(spark), langid.fit(empty(spark), F.lit(True)), keep=("doc_id",)).count() == 0


def test_every_language_is_learned(spark):
    rows = [(i, f"the cat and dog {i}", "en") for i in range(3000)] + [(None, f"le chat et le chien {i}", "fr") for i in range(3000)]
    rows += [(5000, "\u03bb\u03cc\u03b3\u03bf\u03c2 \u03ba\u03b1\u03b9", "el")] * 2 + [(6000, "ordet", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for sample in (1, 40, 20000):
        profiles = langid.fit(docs, F.lit(True), sample=sample)
        assert [name for name, _ in profiles] == ["el", "en", "fr"]
        got = langid.predict(docs, profiles, keep=("lang",)).where("lang = 'el'").collect()
        assert [r["lang_pred"] for r in got] == ["el", "el"] and all(r["score"] >= 0.2 for r in got)


def test_scripts_keep_their_letters_apart(spark):
    """Russian, Ukrainian, Greek, Chinese and Japanese: letters that share low bits of their code points."""
    words = {"ru": "это был один из тех дней когда всё шло не так", "uk": "це був один із тих днів коли все йшло не так ї є",
             "el": "αυτή ήταν μία από εκείνες τις ημέρες που όλα", "zh": "这是一个天气很好的日子我们去公园玩人们都很高兴", "ja": "これは天気のいい日でしたのでわたしたちは公園へ"}
    rnd = random.Random(2)

    def text(lang):
        some = list(words[lang]) if lang in ("zh", "ja") else words[lang].split()
        return ("" if lang in ("zh", "ja") else " ").join(rnd.choice(some) for _ in range(60))

    rows = [(i, text(lang), lang) for i, lang in enumerate(list(words) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit(docs.where("doc_id < 30"), F.lit(True))
    got = langid.predict(docs.where("doc_id >= 30"), profiles, keep=("lang",)).collect()
    assert len(got) == 30 and all(r["lang"] == r["lang_pred"] for r in got)
    codes = langid.letter_codes()
    some = [chr(c) for c in range(langid._LAST) if chr(c).isalpha() and len(chr(c).lower()) == 1]
    assert len({int(codes[ord(x)]) for x in some}) == len({x.lower() for x in some}) and codes.max() < 1 << langid._BITS


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="lang has 5"):
        langid.fit(docs, F.lit(True))


# ---------------------------------------------------------------- licences
def test_license_scan(spark):
    rows = [("p/LICENSE", "Released under the MIT License."), ("p/a.py", "code"), ("p/q/b.py", "code here"),
            ("p/q/LICENSE", "Licensed under the Apache License, Version 2.0."), ("p/q/r/c.py", None),
            ("z/own.py", "All rights reserved.\n" + ALIKE), ("z/none.py", ""), (None, "x"), ("LICENSE", "Licensed under CC BY-NC 4.0."),
            ("top.py", "x"), ("p/a.py", "code"), ("pq/x", "y")]
    files = spark.createDataFrame([(i, p, t, "r", 1) for i, (p, t) in enumerate(rows)], "id long, path string, text string, row string, line int")
    got = {r["id"]: (r["own_license"], r["license"], r["license_dir"], r["is_license_file"]) for r in licenses.scan(files, "id", "path").collect()}
    assert got[0] == ("MIT", "MIT", None, True)
    assert got[1] == (None, "MIT", "p", False) == got[10]
    assert got[2] == got[4] == (None, "Apache-2.0", "p/q", False)
    assert got[5] == ("Proprietary", "Proprietary", None, False)
    assert got[6] == got[9] == got[11] == (None, "CC-BY-NC-4.0", "", False)
    assert got[7] == (None, None, None, False)
    assert licenses.scan(files.limit(0), "id", "path").count() == 0


@pytest.mark.parametrize("times", [1, 20])
def test_license_lines_with_ordinary_words(spark, times):
    r = random.Random(7)
    common, known = "for on it at we he she they".split(), sorted({w for _, s in licenses.TEMPLATES for w in re.findall(r"[^\W_]+", s.lower())})
    texts = ["Released under the MIT License for on", "It is for on: Licensed under the Apache License, Version 2.0", "All rights reserved for we"]
    texts += [s + " " + " ".join(r.sample(common + ["rare", "seldom"], r.randint(0, 6))) for _, s in licenses.TEMPLATES for _ in range(4)]
    texts += [" ".join(r.sample(known, r.randint(1, 6)) + r.sample(common, 3)) for _ in range(40)]
    texts += [" ".join([*common, f"w{i}"]) for i in range(300 * times)]
    bags = [set(re.findall(r"[^\W_]+", x.lower())) for x in texts]
    df = collections.Counter(w for b in bags for w in b)
    w2 = {w: (math.log((1 + len(bags)) / (1 + df[w])) + 1) ** 2 for w in {*df, *known}}
    templates = [(name, set(re.findall(r"[^\W_]+", s.lower()))) for name, s in licenses.TEMPLATES]

    def best(bag):
        size = sum(w2[w] for w in bag)
        return min((-round(sum(w2[w] for w in bag & t) / math.sqrt(size * sum(w2[w] for w in t)), 6), name) for name, t in templates)

    files = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {x["row"]: (x["license"], x["score"]) for x in licenses.line_licenses(files).collect()}
    assert [got[i][0] for i in range(3)] == ["MIT", "Apache-2.0", "Proprietary"]
    for i, bag in enumerate(bags):
        score, name = best(bag)
        assert got.get(i, (None,))[0] == (name if -score >= licenses.COSINE else None), texts[i]
        assert i not in got or got[i][1] == pytest.approx(-score, abs=2e-6)


def license_files(spark):
    """Whole licence texts with lines broken anywhere, wrapped headers, and ordinary files below them."""
    r = random.Random(3)
    rows = []
    for k, (name, text) in enumerate(licenses.FILE_TEMPLATES):
        words = f"Copyright (c) 20{k:02} Some Name {text}".split()
        lines, at = [], 0
        while at < len(words):
            n = r.randint(5, 14)
            lines.append(" ".join(words[at:at + n]))
            at += n
        rows += [(f"d{k}/LICENSE", "\n".join(lines), name), (f"d{k}/x/y.py", "import this\nprint(1)", name)]
    rows += [("w/a.py", "# This work is licensed under the\n\n# GNU General Public License, version 3\n" + "some code of the file here\n" * 9, "GPL-3.0"), ("w/b.py", "code", None),
             ("v/README", "My program does things.\n" * 9 + "It is Released under the MIT License", "MIT"), ("v/c.py", None, None)]
    return rows


def test_whole_texts_are_licence_files(spark):
    rows = license_files(spark)
    ordinary = [(f"o/{i}.txt", f"line {i} of some text\nthe software and the terms of use w{i}", None) for i in range(300)]
    files = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows + ordinary)], "id long, path string, text string")
    got = {x["path"]: x for x in licenses.scan(files, "id", "path").collect()}
    for path, _, want in rows + ordinary:
        assert got[path]["license"] == want, path
        assert got[path]["is_license_file"] == path.endswith("LICENSE"), path


def test_license_sql_on_texts_and_ordinary_words(spark):
    r = random.Random(11)
    common = "for on it at we he she they".split()
    texts = [t for _, t, _ in license_files(spark)] + [s + " " + " ".join(r.sample([*common, "rare", "seldom"], r.randint(0, 6))) for _, s in licenses.TEMPLATES]
    texts += ["", "\n\n", " ".join(common)] + [" ".join([*common, f"w{i}"]) for i in range(200)]
    docs = spark.createDataFrame([(i * 7, t, None, "ab"[i % 2], 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    import tempfile
    folder = tempfile.mkdtemp(prefix="licenses-")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(licenses.OP3_SQL)
    names = [d[0] for d in want.description]
    want = sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in want.fetchall()), key=str)
    got = queries.QUERIES["op3_license_scan"](spark, folder).select(*names).collect()
    assert sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in got), key=str) == want
    assert sum(row[names.index("is_license_file")] for row in want) >= len(licenses.FILE_TEMPLATES)


def same_as_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    spark_rows = queries.QUERIES[name](spark, sf).toPandas()
    sql_rows = con.sql(queries.ORACLES[name]).df()
    columns = sorted(spark_rows.columns)
    assert columns == sorted(sql_rows.columns)
    one, two = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (spark_rows, sql_rows))
    assert one.equals(two)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    same_as_sql(spark, name, SF)


# ---------------------------------------------------------------- near duplicates
def check_near(spark, docs, size):
    rows = pairs(docs)
    want = brute.near_groups(rows, size)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, shingle=size).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i)
        assert got[i]["n_shingles"] == len(brute.shingles(text, size))


@pytest.mark.parametrize("size", [2, 5])
def test_near_whole_table(spark, size):
    check_near(spark, spark.read.parquet(f"{SF}/documents.parquet"), size)


def test_near_chain_and_large_group(spark):
    r = random.Random(5)
    base = [f"a{i}" for i in range(120)]
    rows = []
    for i in range(120):  # near copies of one text, some of which are near only to others
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(120)] = f"z{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):  # each near to the next only
        rows.append((step, " ".join([f"d{k}" for k in range(6 * step)] + chain[6 * step:])))
    check_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2)


def test_near_pairs_that_fewer_coordinates_lose(spark):
    """Pairs at exactly 80 %, four of which 32 coordinates with 17 matches lose."""
    some = [216, 1483, 25794, 33937, *range(60)]
    rows = [(2 * k + side, " ".join(f"p{i}w{j}" for j in (range(37) if side == 0 else range(4, 41))))
            for k, i in enumerate(some) for side in (0, 1)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize("many", [40, 200])
def test_near_pairs_at_the_threshold_in_lists(spark, many):
    """Texts that share most words, linked at exactly 80 % in chains, with lists below and above LONG_LIST."""
    rnd = random.Random(many)
    common = [f"c{j}" for j in range(30)]
    rows = []
    for k in range(many):
        own = [f"k{k}w{j}" for j in range(8)]
        first = common + own
        second = first[:-4] + [f"k{k}v{j}" for j in range(3)] if k % 2 else first[4:] + [f"k{k}v{j}" for j in range(4)]
        rows += [(2 * k, " ".join(first)), (2 * k + 1, " ".join(second))]
    rnd.shuffle(rows)
    check_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2)


def test_near_odd(spark):
    got = near_dedup.near_duplicates(odd_documents(spark), shingle=2).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == odd_documents(spark).count()
    # -12 holds the same words and a few more
    assert {r["component_id"] for i in (1, 2, -12) for r in by[i]} == {-12}
    assert by[-12][0]["kept"] and not any(r["kept"] for i in (1, 2) for r in by[i])
    assert by[7][0]["component_id"] == by[10][0]["component_id"] == 6
    assert all(by[i][0]["n_shingles"] == 0 and by[i][0]["kept"] for i in (3, 4, 5))
    assert by[9][0]["component_id"] == 8 and by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    want = brute.union_find({x for e in edges for x in e}, edges)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(a != b and k in (a, b) for a, b in edges)}


# ---------------------------------------------------------------- lines and windows
def same_texts(got, rows, want, third):
    have = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, *((r[c] is not None, r[c] if r[c] is not None else "") for c in third)) for r in got))
    must = sorted((i is not None, i or 0, *((v is not None, v if v is not None else "") for v in w)) for (i, _), w in zip(rows, want))
    assert have == must


def line_cases(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdé ") for _ in range(n)) for n in (3, 10, 15, 16, 17, 31, 32, 33, 64, 200) for _ in range(3)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(6):
            s = list(r.choice(base))
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                k = r.randrange(len(s))
                kind = r.randrange(3)
                s[k:k + (kind != 0)] = [] if kind == 1 else [r.choice("abx")]
                s = s or ["q"]
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("which", ["cases", "odd", "table"])
def test_lines(spark, which):
    docs = {"cases": line_cases, "odd": odd_documents, "table": lambda s: s.read.parquet(f"{SF}/documents.parquet")}[which](spark)
    rows = in_order(pairs(docs))
    got = line_dedup.drop_similar_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    same_texts(got.collect(), rows, brute.kept_lines(rows), ("text", "n_lines", "n_removed"))


def test_lines_empty_and_hot(spark):
    assert line_dedup.drop_similar_lines(empty(spark)).count() == 0
    rows = [(i, f"common line of all\nthe same start of a long line and then {i:05d} it goes on") for i in range(600)]
    got = line_dedup.drop_similar_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same_texts(got, rows, brute.kept_lines(rows), ("text", "n_lines", "n_removed"))


@pytest.mark.parametrize("which", ["odd", "table", "repeats"])
def test_windows(spark, which):
    r = random.Random(4)
    few = spark.createDataFrame([(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 300)))) for i in range(40)], "doc_id long, text string")
    docs = {"repeats": few, "odd": odd_documents(spark), "table": spark.read.parquet(f"{SF}/documents.parquet")}[which]
    rows = in_order(pairs(docs))
    got = substring_dedup.remove_repeats(docs)
    same_texts(got.collect(), rows, brute.kept_words(rows), ("text", "n_words", "n_removed"))
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_windows_other_covers(spark):
    docs = spark.createDataFrame([(1, " ".join("abcdefgh")), (2, " ".join("xbcdefgy"))], "doc_id long, text string")
    rows = pairs(docs)
    got = substring_dedup.remove_repeats(docs, window=5, period=3, cover=(0, 1)).collect()
    same_texts(got, rows, brute.kept_words(rows, 5), ("text", "n_words", "n_removed"))
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs, window=5, period=5, cover=(0, 1))


# ---------------------------------------------------------------- mixing
def test_mixing_odd(spark):
    docs = odd_documents(spark)
    sizes = mixing.sized(docs)
    out, takes = mixing.mix(sizes, block_words=4)
    taken = {r["row"]: r["t"] for r in takes.groupBy("row").agg(F.sum(F.expr("word_to - word_from")).alias("t")).collect()}
    rows = out.collect()
    assert len(rows) == docs.count()
    total, per = sum(r["size"] for r in rows), {}
    for r in rows:
        assert taken.get(r["row"], 0) <= 3 * r["size"]
        per.setdefault(r["source"], []).append(r)
    assert sum(x[0]["target"] for x in per.values()) == pytest.approx(total)
    for x in per.values():
        assert x[0]["target"] <= 3 * x[0]["source_size"] + 1e-9
        assert abs(sum(taken.get(r["row"], 0) for r in x) - x[0]["target"]) <= 4
    assert mixing.mix(mixing.sized(empty(spark)))[0].count() == 0


def test_mixed_documents(spark):
    docs = odd_documents(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    have = {(r["doc_id"], tuple(brute.words(r["text"]))) for r in docs.collect()}
    for r in out.collect():
        w = brute.words(r["text"])
        assert w and any(i == r["doc_id"] and any(list(x[k:k + len(w)]) == w for k in range(len(x) - len(w) + 1)) for i, x in have)
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_mix_of_very_large_sources(spark):
    unit = 10**14
    rows = [(i, "ab"[i % 2], (i + 1) * unit // 3, i) for i in range(60)]
    out, takes = mixing.mix(spark.createDataFrame(rows, "key long, source string, size long, row long"), block_words=unit)
    taken = {r["row"]: r["t"] for r in takes.groupBy("row").agg(F.sum(F.expr("word_to - word_from")).alias("t")).collect()}
    per = {}
    for r in out.collect():
        assert 0 <= taken.get(r["row"], 0) <= 3 * r["size"]
        per.setdefault(r["source"], []).append(r)
    for x in per.values():
        assert abs(sum(taken.get(r["row"], 0) for r in x) - x[0]["target"]) <= unit


def test_mix_repeats_itself(spark):
    one, two = (sorted(tuple(r) for r in queries.QUERIES["op9_mixing"](spark, SF).collect()) for _ in range(2))
    assert one == two


def test_running_totals(spark):
    df = spark.createDataFrame([(i % 3, i % 5, i, i * i % 7) for i in range(200)], "g int, bin int, k int, v int")
    got = running_totals(df, ["g"], ["bin", "k"], {"before": "v"}, 5).collect()
    for r in got:
        assert r["before"] == sum(i * i % 7 for i in range(200) if i % 3 == r["g"] and (i % 5, i) < (r["bin"], r["k"]))
