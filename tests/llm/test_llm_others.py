"""Operators on pages and vectors, and the pipeline."""

import math
import random
import time
import tracemalloc

import brute_force as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from churnspark.llm import ann, html_text, packing, queries, top_search

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- pages
def text_of(spark, rows):
    pages = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, low string, _host string")
    return {r["page_id"]: r["text"] for r in html_text.extract(pages, keep=("page_id", "url", "low")).collect()}


def test_html_cases(spark):
    cases = [
        ("<p>a &amp; b&nbsp;c<br>d</p><p>e  <b>f</b>\n g", "a & b c d\n\ne f g"),
        ("<nav>m</nav><header>h</header><article><h1>T</h1><p>x</article><footer>f</footer>", "T\n\nx"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p>x</p><!-- <p>no</p> -->", "x"),
        ("<div class='cookie-notice'>n</div><div class='post-body'>b</div><div id=comments><p>c</p></div>", "b"),
        ("<div class='article-header'>keep</div><div class='header'>gone</div><div class=layout-with-sidebar>keep too</div>", "keep\n\nkeep too"),
        ("<main><p>in</p><article class='comment'><p>c</p></article></main><p>out</p>", "in"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb\n\n1 2\n\n3"),
        ("<form><p>f</p><button>go</button></form><p hidden>h</p><p>x", "x"),
        ("a<div>b</div>c", "a\n\nb\n\nc"), ("<p>unclosed <i>tag", "unclosed tag"), ("", ""), (None, ""), ("<p", "<p"), ("< 3 & 4 > 2", "< 3 & 4 > 2"),
        ("<p>x</p></div></p></body>y", "x\n\ny"), ("<P CLASS=ad>no</P><P>yes</P>", "yes"), ("&lt;p&gt; &eacute; &#x41; &#65;", "<p> é A A"),
        ("<nav>only</nav>", ""), ("<title>t</title><textarea>q</textarea><select><option>o</select><p>x", "x"), ("<p>a</p>" * 3000, "\n\n".join(["a"] * 3000)),
    ]
    got = text_of(spark, [(f"http://h{i}.org/", h) for i, (h, _) in enumerate(cases)])
    for i, (h, want) in enumerate(cases):
        assert got[i] == want, h
    assert text_of(spark, [(None, "<p>x"), (None, "<p>x")]) == {0: "x", 1: "x"}


def test_names_do_not_drop_the_article(spark):
    long = "Words of the article. " * 20
    cases = [
        (f"<div class='content-sidebar-wrap'><main><p>{long}</p></main><div class=sidebar>s</div></div><p>foot", long.strip()),
        (f"<div class='elementor-widget-container'><p>{long}</p></div><p>All rights", long.strip() + "\n\nAll rights"),
        (f"<div class='elementor-widget-container'><p>{long}</p></div>", long.strip()),
        (f"<form id=aspnetForm><nav>n</nav><div class=post><p>{long}</p></div><div class=sidebar>s</div></form>", long.strip()),
        (f"<div class='content-sidebar-wrap'><article><p>{long}</p></article><aside>a</aside></div>", long.strip()),
        (f"<div class=post>{long}</div><div class=related><article>card one</article><article>card two</article></div>", long.strip()),
        (f"<article>{long}</article><div class=comments><article>{long * 9}</article></div>", long.strip()),
        (f"<div class=post>{long}</div><div class=sidebar>{long}</div>", long.strip()),
    ]
    got = text_of(spark, [(f"http://h{i}.org/", h) for i, (h, _) in enumerate(cases)])
    for i, (h, want) in enumerate(cases):
        assert got[i] == want, h


def test_site_tree_drops_what_a_host_repeats(spark):
    site = [("http://site.org/%d" % i, f"<div class=box><p>Same words on every page</p></div><div class=text><p>Own words {i} of this page</p></div>") for i in range(30)]
    few = [("http://few.org/%d" % i, "<div class=box><p>Same words on every page</p></div><div class=text><p>same</p></div>") for i in range(3)]
    copies = [("http://copies.org/%d" % i, "<div class=text><p>all the same</p></div>") for i in range(40)]
    got = text_of(spark, site + few + copies)
    assert [got[i] for i in range(30)] == [f"Own words {i} of this page" for i in range(30)]
    assert {got[i] for i in range(30, 33)} == {"Same words on every page\n\nsame"}
    assert {got[i] for i in range(33, 73)} == {"all the same"}  # never less than the unpruned page


def test_salted_join_equals_broadcast(spark, monkeypatch):
    rows = [("http://site.org/%d" % i, f"<div class=box><p>Same</p></div><p>Own {i}</p>") for i in range(30)]
    want = text_of(spark, rows)
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", -1)
    assert text_of(spark, rows) == want


def test_pages_whole_table(spark):
    out = queries.QUERIES["op4_html_extraction"](spark, SF)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = out.collect()
    assert out.columns == ["page_id", "url", "text", "n_chars"] and len(rows) == len(pages)
    for r in rows:
        _, blocks = html_text.parse(pages[r["page_id"]] or "")
        inside = [b for b in blocks if b[2] >= 0] or blocks
        assert set(r["text"].split("\n\n")) <= {b[1] for b in inside} | {""} and r["n_chars"] == len(r["text"])


WORDS = "some different words of this comment or article which nobody else has written yet".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(1000)) for _ in range(n))


def test_comments_sidebars_and_notices_go_whatever_their_size(spark):
    """Thirty pages of a host, other words on each: a short article, a long part with a telling name."""
    for name in ("comments", "comment-list", "sidebar", "cookie-notice", "disqus_thread", "main-menu", "ad-box"):
        site = [(f"http://site.org/{i}", f"<article><p>{prose(i, 20)}</p></article><div class='{name}'><p>{prose(100 + i, 150)}</p></div>") for i in range(30)]
        body = [(u, h.replace("<article>", "<div class=text>").replace("</article>", "</div>")) for u, h in site]
        for rows in (site, body):
            got = text_of(spark, rows[:30])
            assert [got[i] for i in range(30)] == [prose(i, 20) for i in range(30)], name


def test_a_teaser_is_not_the_article(spark):
    rows = [(f"http://site.org/{i}", f"<div class=text><p>{prose(i, 120)}</p></div><article><p>teaser {i}</p></article>") for i in range(30)]
    got = text_of(spark, rows)
    assert all(prose(i, 120) in got[i] for i in range(30))


def test_classes_of_one_page_do_not_part_the_tree(spark):
    rows = [(f"http://site.org/{i}", f"<body class='postid-{i} home'><div class='box b{i}'><p>Same words on every page</p></div>"
             f"<div class='text t{i}'><p>{prose(i, 30)}</p></div></body>") for i in range(30)]
    got = text_of(spark, rows)
    assert [got[i] for i in range(30)] == [prose(i, 30) for i in range(30)]


@pytest.mark.parametrize("html", ["<b>" * 8000 + "</i>" * 8000 + "x", "<a \"" * 8000, "<a \"" * 8000 + ">", "<div>" * 200_000 + "x", "<b>" * 60_000 + "<div>a</div>" * 60_000,
                                  "<p><b>" * 60_000, "<li><b>" * 60_000, "<b>" * 60_000 + "<li>" * 60_000, "<" * 1_000_000, "<script>" * 100_000, "</p>" * 250_000,
                                  "<table><tr><td>" * 60_000, "<!--" * 250_000, "<div class='" * 80_000],
                         ids=range(14))
def test_bad_html_takes_time_in_proportion(html):
    before = time.process_time()
    tracemalloc.start()
    nodes, _ = html_text.parse(html)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.process_time() - before < 12 and peak < 200 << 20  # tracing takes most of the time
    assert len(nodes) < len(html)


def random_page(rnd, i):
    box = rnd.choice(["<div class='top a'><p>Same</p><p>Menu</p></div>", "<div class='top b'><p>Same</p></div>", ""])
    side = "<div><ul><li>one<li>two</ul></div>" if rnd.random() < 0.8 else f"<div><ul><li>{prose(i, 3)}</ul></div>"
    return f"<body class=p{i}>{box}<section><div class='x'><p>{prose(i, 12)}</p></div></section>{side}<div>foot</div></body>"


def test_style_tree_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(f"http://{rnd.choice(['a', 'b', 'b', 'c'])}.org/{i}", random_page(rnd, i)) for i in range(120)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    parsed = html_text.parsed(pages, keep=("page_id",))
    common = html_text.common_classes(parsed)
    found = html_text.importance(html_text.features(html_text._with_host(parsed, common))).collect()
    by_host = {}
    for u, h in rows:
        by_host.setdefault(u[7:12], []).append(html_text.parse(h))
    want = {}
    for host, some in by_host.items():
        want |= {(host, *k): v for k, v in brute.style_tree(some, html_text.PAGES, html_text.GAMMA).items()}
    got = {(r["host"], r["node"]): (r["m"], r["importance"], r["most"]) for r in found}
    paths = {}
    for host, some in by_host.items():
        common_of = frozenset(next((r["common"] for r in common.collect() if r["host"] == host), []))
        for nodes, _ in some:
            ids, _ = html_text.style_ids(nodes, common_of)
            for i, one in enumerate(ids):
                path = []
                while i > 0:
                    tag, *classes = nodes[i][1].split(".")
                    path.append(".".join([tag, *[c for c in classes if c in common_of]]))
                    i = nodes[i][0]
                paths[host, one] = (host, *reversed(path))
    assert {paths[k] for k in got} == set(want)
    for k, v in got.items():
        assert v == pytest.approx(want[paths[k]], abs=1e-9), paths[k]


def test_the_tree_decides_on_the_given_pages(spark):
    """The tree alone, without names: pages of which it removes blocks."""
    pages = spark.read.parquet(f"{SF_MORE}/pages.parquet").withColumn("url", F.lit("http://one.org/"))
    rows = html_text.parsed(pages, keep=("page_id",))
    weighed = html_text.importance(html_text.features(html_text._with_host(rows, html_text.common_classes(rows))))
    assert weighed.where("m >= 10").count() > 5 and weighed.where("most > importance").count() >= 0
    text = {r["page_id"]: r["text"] for r in html_text.extract(pages, keep=("page_id",)).collect()}
    assert all(text.values())


# ---------------------------------------------------------------- vectors
def odd_vectors(spark, size=6, n=400):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, size)).round(2)
    x[50:150] = x[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(i, v) for i, v in ((1000, None), (1050, [None] * size), (1100, [float("nan")] * size), (1150, [float("inf")] * size), (1200, [0.0] * size),
                                 (None, [1.0] * size), (1250, [1.0, 2.0]), (1300, [2.0, 1.0]), (1350, []), (100, x[0].tolist()))]
    return spark.createDataFrame([(i, v, 1, "q", "r") for i, v in rows], "vec_id long, embedding array<double>, size int, qb string, rb string")


def by_id(df, zero):
    out = {}
    for r in df.collect():
        v = r["embedding"]
        if r["vec_id"] is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (zero and not any(v)):
            continue
        out[r["vec_id"]] = min(out.get(r["vec_id"], v), v)
    return out


def test_top_products(spark):
    df = odd_vectors(spark)
    whole = {i: [math.floor(256 * x) for x in v] for i, v in by_id(df, False).items()}
    got = {}
    for r in top_search.top_products(df, 50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, v in whole.items():
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q and len(w) == len(v))[:5]
            assert sorted(got.pop(q, [])) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert not got and top_search.top_products(df.limit(0), 50).count() == 0


def test_top_products_beyond_floats(spark):
    rows = [(i, [1e5 * (i + 1) + 0.25, -3e5]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for r in top_search.top_products(df, 10, k=1).collect():
        want = max((sum(a * b for a, b in zip(whole[r["query_id"]], w)), -i) for i, w in whole.items() if i != r["query_id"])
        assert (r["score"], -r["vec_id"]) == want


def test_trees_prune():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.integers(-2000, 2000, (20, 8)), 100, axis=0) + rng.integers(-5, 5, (2000, 8))
    x = x.astype(float)
    ids = np.arange(2000)
    score, best = top_search.best_products(x[::50], ids[::50], x, ids, 5)
    for row, (s, b) in enumerate(zip(score, best)):
        want = sorted((-v, i) for i, v in enumerate(x @ x[50 * row]) if i != 50 * row)[:5]
        assert [(-a, i) for a, i in zip(s, b)] == want

    def covered(n):
        pts = n.points if n.points is not None else np.concatenate([covered(c) for c in n.children])
        assert np.sqrt(((x[pts] - n.centre) ** 2).sum(axis=1)).max() <= n.radius + 1e-9
        return pts
    assert sorted(covered(top_search.cover_tree(x, ids))) == list(ids)


def test_nearest(spark):
    df = odd_vectors(spark)
    some = by_id(df, True)
    got = {}
    for r in ann.nearest(df, 100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, v in some.items():
        if q % 100 == 0:  # fewer rows than the least number of candidates: all are searched
            s = sorted((math.dist(v, w), i) for i, w in some.items() if i != q and len(w) == len(v))[:10]
            mine = sorted(got.pop(q, []))
            assert [i for _, i, _ in mine] == [i for _, i in s] and [x for *_, x in mine] == pytest.approx([d for d, _ in s], abs=1e-12)
    assert not got and ann.nearest(df.limit(0), 100).count() == 0


def test_forest_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    forest = ann.Forest(x)
    hits = 0
    for i, some in zip(range(0, len(x), 100), forest.candidates(x[::100], int(ann.SHARE * len(x)))):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10]) & set(some.tolist()))
    assert hits >= 0.9 * 10 * len(range(0, len(x), 100))


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_MORE}/documents.parquet").limit(150)
    odd = spark.createDataFrame([(10**6 + k, t, None, s, None) for k, (t, s) in enumerate(((None, "a"), ("", None), ("123 456", "a")))], docs.schema)
    docs.unionByName(odd).unionByName(docs.limit(1)).write.parquet(str(tmp_path / "0"))
    docs = spark.read.parquet(str(tmp_path / "0"))
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k + 1)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k + 1)))
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "line_dedup":
            rows = sorted(((r["doc_id"], r["text"]) for r in before.collect()))
            want = sorted((i, t) for (i, _), (t, *_) in zip(rows, brute.kept_lines(rows)))
            assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == want
        if name == "minhash_near_dedup":
            rows = {r["doc_id"]: r["text"] for r in before.collect()}
            want = brute.near_groups(list(rows.items()), 5)
            kept = [r["doc_id"] for r in docs.collect()]
            assert set(kept) == {i for i, c in want.items() if i == c}
    assert counts[0] == 154 and counts[1] == 151
    assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_pipeline_runs(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(out.columns)
    total = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert total.where(f"n > {packing.WINDOW}").count() == 0


def test_pipeline_takes_an_empty_table(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
