"""Fill-in-the-middle, spelling variants and exact duplicates."""

import collections
import hashlib
import random

import brute_force as brute
import pytest
from pyspark.sql import functions as F
from test_llm_documents import SF_MORE, empty, odd_documents, pairs

from churnspark.llm import exact_dedup, fim, queries, spelling
from churnspark.llm.spark import fresh_path, written


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- fill in the middle
def lines(spark):
    rnd = random.Random(1)
    texts = ["", None, "\n", "\n\n\n", "a", "a\n", "a\nb", "\na", "x\r\ny z\x0b\n", "has <P> in it\nx", "<S>", "a<\nS>M>\n<", "é😀\n" * 5,
             "".join(rnd.choice("ab\n<PS>M") for _ in range(3000)), "word \n" * 20000]
    rows = [(i, t, "c") for i, t in enumerate(texts * 3)] + [(None, "a\nb\nc", "c"), (7, "again\n", None), (7, "again\n", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string")


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0)])
def test_fim_equals_brute_force(spark, rate, spm):
    docs = lines(spark).unionByName(odd_documents(spark).select("doc_id", "text", F.lit("x").alias("form")))
    got = fim.fill_in_middle(docs, rate=rate, spm_rate=spm).withColumn("back", fim.restored()).collect()
    want = collections.Counter((i, *brute.fill_in_middle(i, t, rate, spm)) for i, t in pairs(docs))
    assert collections.Counter((r["key"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == want
    assert (collections.Counter((r["key"], r["back"]) for r in got)
            == collections.Counter((i, t or "") for i, t in pairs(docs)))
    assert {r["form"] for r in got} >= {"plain", "psm"}
    assert all(r["form"] == "plain" or r["suffix_chars"] is not None for r in got)


def test_fim_of_no_rows(spark):
    assert fim.fill_in_middle(empty(spark)).collect() == []


def test_fim_beyond_one_match(monkeypatch):
    monkeypatch.setattr(fim, "MOST_UNITS", 3)
    units = fim.unit_pattern()
    for text in ["", "a", "a\nb\nc", "a\nb\nc\n", "a\n\n\n\n\nb", "x\n" * 50]:
        assert list(fim.unit_ends(text, units)) == [m.end() for m in brute.LINE.finditer(text)]
    with pytest.raises(ValueError):
        fim.unit_ends("a\n" * 9 + "?", fim.unit_pattern("a\n"))


def test_fim_of_many_lines():
    text = "ab\n" * 400_000
    assert fim.transform(text, 1, 399_999, 0, 99, fim.unit_pattern(), 100, 50)[:5] == (400_000, "psm", 3, 3 * 399_998, 3)


def test_fim_query(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_fill_in_middle"](spark, SF_MORE).collect()}
    docs = pairs(spark.read.parquet(f"{SF_MORE}/documents.parquet"))
    assert len(got) == len(docs)
    for i, t in docs:
        n, form, p, m, out = brute.fill_in_middle(i, t)
        assert (got[i]["n"], got[i]["form"], got[i]["prefix_chars"], got[i]["middle_chars"]) == (n, form, p, m)
        assert got[i]["output_sha256"] == sha(out) and got[i]["restored_sha256"] == sha(t or "")


# ---------------------------------------------------------------- spelling variants
def spelled(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_spelling_equals_brute_force(spark):
    rnd = random.Random(3)
    letters = "abcéÿ"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 14))) for _ in range(60)]
    words = []
    for w in base:
        words += [w] * rnd.choice([1, 2, 30, 400])
        for _ in range(12):
            at, c = rnd.randrange(len(w)), rnd.choice(letters)
            words += [rnd.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]])] * rnd.choice([1, 2, 3, 5, 40])
    for k in range(5):  # a chain of forms
        words += ["chainword" + "xyzvw"[:k]] * (2 * 10 ** (4 - k) if k < 4 else 2)
    rnd.shuffle(words)
    docs = [(rnd.choice([i, None, 5]), " ".join(words[k:k + 50])) for i, k in enumerate(range(0, len(words), 50))]
    df = spark.createDataFrame([(i, t, "w", 3) for i, t in docs], "doc_id long, text string, word string, n int")
    for one_in in (31, 3, None):
        got = spelling.variants(df, one_in=one_in).collect()
        want = brute.spelling(docs, one_in)
        assert len(got) == len(want) and spelled(got) == want
    assert want["chainwordxyzv"][1] == "chainword"


def test_spelling_in_many_blocks(spark, monkeypatch):
    """Large parts (a prefix that all words share), cut into blocks and batches."""
    monkeypatch.setattr(spelling, "SIDE", 16)
    rnd = random.Random(4)
    docs = [(i, " ".join(["common" + "".join(rnd.choice("ab") for _ in range(rnd.randint(4, 8)))] * 2 + ["X" + "".join(rnd.choice("ab") for _ in range(9))] * 30))
            for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = spelling.variants(df, one_in=31).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert spelled(got) == brute.spelling(docs)


def test_spelling_cases(spark):
    long = "q" * 20000
    docs = [(1, "GRÜSSE grüsse ÀÉÎÕÜ× ABCDEFG"), (2, None), (None, f"{long} {long} {long}x {long}x a{long[2:]}y a{long[2:]}y"), (3, ""), (3, "abcdefg abcdefgh abcdefgh")]
    df = spark.createDataFrame([(i, t, None) for i, t in docs], "doc_id long, text string, key string")
    assert spelled(spelling.variants(df, one_in=31).collect()) == brute.spelling(docs)
    assert spelling.variants(empty(spark), one_in=31).collect() == []
    odd = odd_documents(spark)
    assert spelled(spelling.variants(odd, one_in=31).collect()) == brute.spelling(pairs(odd))


def test_spelling_query(spark):
    got = spelled(queries.QUERIES["op12_spelling_variants"](spark, SF_MORE).collect())
    assert got == brute.spelling(pairs(spark.read.parquet(f"{SF_MORE}/documents.parquet")))


# ---------------------------------------------------------------- exact duplicates
def groups(rows):
    return collections.Counter((r["key"], r["keep_key"], r["group_size"]) for r in rows)


def wanted(docs):
    return collections.Counter((k, keep, n) for k, keep, n, _ in brute.exact_groups(docs))


def many_copies(spark):
    rows = [(i, "hot  text\n" if i % 2 else "hot text ", i) for i in range(900)] + [(i, f"text {i % 40}", 0) for i in range(900, 1100)]
    return spark.createDataFrame(rows + [(None, "hot text ", 0), (2000, None, 0), (2001, "", None), (5, "text 1", 1), (5, "text 1", 1)],
                                 "doc_id long, text string, many long").repartition(7)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.unhex(F.md5(t)), 1, 1), lambda t: F.lit(b"same")],
                         ids=["sha256", "one byte", "one value"])
def test_exact_dedup_equals_brute_force(spark, digest):
    """Also with digests under which most texts collide: full texts decide."""
    docs = many_copies(spark).unionByName(odd_documents(spark).select("doc_id", "text", F.lit(1).cast("long").alias("many")))
    docs = written(docs, "docs")
    got = exact_dedup.duplicates(docs, digest=digest).collect()
    assert groups(got) == wanted(pairs(docs))
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({t for *_, t in brute.exact_groups(pairs(docs))})
    assert all(r["key"] == r["keep_key"] for r in kept)


def test_exact_dedup_state_goes_on(spark):
    """Files that come later meet the state; the files before are not read again."""
    store, checkpoint = fresh_path(spark, "store"), fresh_path(spark, "state")
    docs = written(many_copies(spark), "docs")
    first, second = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0 OR doc_id IS NULL")
    exact_dedup.write_store(second, store)
    some = {r["digest"]: r["many"] for r in exact_dedup.stream_state(spark, store, checkpoint, files_per_batch=2).collect()}
    exact_dedup.write_store(first, store)
    state = exact_dedup.stream_state(spark, store, checkpoint, files_per_batch=2).collect()
    want = {}
    for k, keep, n, t in brute.exact_groups(pairs(docs)):
        want[hashlib.sha256(t.encode()).digest()] = (keep, n)
    assert {bytes(r["digest"]): (r["keep_key"], r["many"]) for r in state} == want
    assert sum(some.values()) == second.count() and sum(r["many"] for r in state) == docs.count()


def test_exact_dedup_of_no_rows(spark):
    assert exact_dedup.duplicates(empty(spark)).collect() == []


def test_exact_dedup_keeps_the_session(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    exact_dedup.duplicates(odd_documents(spark)).count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_exact_dedup_query(spark):
    got = queries.QUERIES["op13_exact_dedup"](spark, SF_MORE).collect()
    docs = pairs(spark.read.parquet(f"{SF_MORE}/documents.parquet"))
    want = collections.Counter((k, keep, n, k == keep, sha(t)) for k, keep, n, t in brute.exact_groups(docs))
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
