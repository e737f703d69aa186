"""Main text of web pages by a site style tree.

1. Pages are parsed once, into style nodes (tag and classes below their parent, down to DEPTH levels; what is deeper
   counts with its ancestor there) and blocks of text.  A class that fewer than ``PAGES`` pages of the host show, such as a
   page's number, is left out of its nodes, so pages of one template share them.
2. Pages of one host are merged into a style tree.  A node has the ways in which its children are laid out
   (presentation) and the texts of its blocks (content), each with the number of pages that show it: plain counts by
   (host, node, feature), so a host with a third of all pages is counted in many tasks.
3. Importance: a node's presentation entropy says how varied its layouts are over the m pages that have it; a leaf's
   content importance is one minus the mean of its texts' entropies, log(pages with the text) / log(m): a menu that every
   page repeats has 0, text of one page has 1.  Inner nodes weigh their own presentation against the importance of their
   children, level by level from the deepest, each level one ``groupBy(host, parent)``.
4. Branches whose nodes are all below ``LEAST`` importance are removed from each page, if at least ``PAGES``
   pages show them.  The tree holds all blocks, whatever their names.
5. Names are the prior of that importance, also on hosts with too few pages.  Elements that are no text (``nav``,
   ``footer``) and branches named as comments, notices, adverts, menus or sidebars have 0, whatever their size, unless
   they hold the page's main element, or an article with most of the page's text where none is outside such branches.
   Names that wrappers have as well (``form``, ``widget``, a sidebar's ``wrap``) count a quarter of their text against
   the text beside them.
6. If a page has a main element, or an article as long as the text outside of articles, its text is taken from there.
   If nothing would be left, the page keeps its unpruned article or body.

Cases: null or empty html gives empty text; a null url is a host of its own; unclosed elements end with
their parent, and an open ``p`` with the next block; repeated rows are pages of their own; an empty table
gives no row.  Columns other than the id, the url and the html are ignored.  Parsing takes time and memory in
proportion to the page, also where elements are badly nested or thousands deep.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark import table, written

LEAST = 0.15
PAGES = 10
GAMMA = 0.9
NAMED = 0.25
DEPTH = 64
SALTS = 64
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 16 << 20  # of a table of hosts

# fixed values of HTML: elements that end or hold a block of text, that have no content, that are not text
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
                  "p pre search section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NOT_TEXT = frozenset("head script style title textarea iframe noembed noframes template svg math canvas object audio video map "
                     "nav footer header aside form button select input noscript menu dialog search".split())
# words of a class, id or role that mark a part of a page that is not its article; the second set only
# where no word of the third stands beside it, as in "article-header"
ASIDE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted "
                  "nav navbar navigation breadcrumb breadcrumbs footer sidebar aside widget cookie cookies consent gdpr popup "
                  "modal overlay paywall newsletter subscribe subscription signup login search comment comments reply replies "
                  "disqus respond sharing related recommended recommendations pager pagination contentinfo "
                  "complementary menu menus notice notices".split())
ASIDE_ALONE = frozenset("banner banners header masthead topbar alert social share toolbar form".split())
NEVER = NOT_TEXT - {"form"}  # a form may be the whole page's wrapper
CONTENT = frozenset("article content main post entry story body text".split())
# names of parts that are never the article, whatever stands beside them, and of those that wrappers have as well
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
WRAPPER = frozenset("widget form header masthead banner banners topbar toolbar wrap wrapper container layout inner outer page".split())
ITEMS = {"li": {"li"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"},
         "option": {"option"}}
ENDS_P = BLOCK - {"body", "html", "head", "title", "option", "optgroup", "tr", "tbody", "thead", "tfoot",
                  "caption", "legend", "li", "dd", "dt"}
_TOKEN = re.compile(r"""<(?:(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([A-Za-z][^\s/>]*)([^>]*)>)""", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_MARKS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


PLAIN, WRAPS, ASIDES, TALK = range(4)  # what the names of an element say


def _named(words: list[str]) -> int:
    """What the words of one class, id or role say."""
    if {"with", "has", "no"} & set(words):
        return PLAIN
    if not COMMENTS.isdisjoint(words):
        return TALK
    if ASIDE.isdisjoint(words) and (ASIDE_ALONE.isdisjoint(words) or not CONTENT.isdisjoint(words)):
        return PLAIN
    return ASIDES if WRAPPER.isdisjoint(words) else WRAPS


def _marked(tag: str, attributes: str) -> tuple[str, int, bool]:
    """(style of an element: tag and classes, what its names say, whether it is never text)"""
    style, kind, never = tag, WRAPS if tag in NOT_TEXT else PLAIN, tag in NEVER
    if attributes and not attributes.isspace():
        for m in _MARKS.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "class":
                style = tag + "." + ".".join(sorted(set(value.split())))
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                never = True
            elif name != "aria-hidden" and tag not in ("html", "body"):
                # an article has classes of many kinds: only a class that is one such word counts
                article = tag in ("article", "main")
                for one in value.split():
                    words = [one.lower()] if article else _WORD.findall(_CAMEL.sub(" ", one).lower())
                    kind = max(kind, _named(words))
    return style, kind, never


def _kept(named: list[tuple[int, int]], own: list[int], articles: list[tuple[int, bool, int]], rest: int) -> tuple[list[bool], list[bool]]:
    """Of each named branch, whether its text stays; of each article, whether it is the page's.

    ``named``: the next outer branch of each, or -1, and what its names say; ``own``: text in each and in no inner branch,
    then text in none; ``articles``: (branch that holds it or -1, whether it is a main element, its text);
    ``rest``: text in no branch and no article."""
    whole, talk = own[:], [False] * len(named)
    for e, (outer, kind) in enumerate(named):
        talk[e] = kind == TALK or outer >= 0 and talk[outer]
    for e in range(len(named) - 1, -1, -1):
        whole[named[e][0]] += whole[e]
    holds, outside = [False] * len(named), any(e < 0 for e, *_ in articles)
    pages = [(e < 0 or not talk[e]) and (e < 0 or main or not outside and 2 * size > whole[-1]) for e, main, size in articles]
    for (e, *_), page in zip(articles, pages):
        while page and e >= 0:
            holds[e], e = True, named[e][0]
    # teasers beside the text are not the article
    longest = max((size for (_, _, size), page in zip(articles, pages) if page), default=0)
    pages = [page and (main or longest >= rest) for (_, main, _), page in zip(articles, pages)]
    kept, beside = [False] * len(named), [0] * len(named) + [own[-1]]
    for e, (outer, kind) in enumerate(named):
        kept[e] = (outer < 0 or kept[outer]) and (holds[e] or kind == WRAPS and NAMED * whole[e] > beside[outer])
        beside[e] = beside[outer] + own[e]
    return kept, pages


Block = tuple[int, str, int, int]


def parse(html: str) -> tuple[list[tuple[int, str]], list[Block]]:
    """(style nodes: (parent, style) in the order of their first element, node 0 is the page; blocks: (node, text,
    number of its article or -1, 1 if its names leave it out)).

    A block's node is that of the innermost block element; white space is collapsed and references are decoded."""
    out: list[Block] = []
    nodes: list[tuple[int, str]] = [(-1, "")]
    number: dict[tuple[int, str], int] = {}
    depth_of = [0]
    # open elements: (tag, node, named branch or -1, -2: never text, article, whether it ends a block)
    stack: list[tuple[str, int, int, int, bool]] = [("", 0, -1, -1, False)]
    opened: dict[str, int] = {}  # tags of open elements
    piece: list[str] = []
    named: list[tuple[int, int]] = []  # next outer named branch, what its names say
    articles: list[tuple[int, bool]] = []  # its named branch, whether it is a main element

    def flush() -> None:
        text = " ".join(("".join(piece) if len(piece) > 1 else piece[0]).split())
        piece.clear()
        _, node, other, article, _ = stack[-1]
        if text:
            if "&" in text:
                text = " ".join(html_entities.unescape(text).split())
            if text:
                out.append((node, text, article, other))

    def close(depth: int) -> None:
        if piece and any(x[4] for x in stack[depth:]):
            flush()
        for x in stack[depth:]:
            opened[x[0]] -= 1
        del stack[depth:]

    at, size, last = 0, len(html), html.rfind(">")
    search = _TOKEN.search
    while at < size:
        m = search(html, at) if at <= last else None  # nothing ends without a bracket, but comments
        if m is None:
            rest = html.find("<!--", at)
            piece.append(html[at:] if rest < 0 else html[at:rest])
            break
        start = m.start()
        if start > at:
            piece.append(html[at:start])
        at = m.end()
        end, tag, attributes, end2, tag2, attributes2 = m.groups()
        if not tag:
            if not tag2:
                continue  # a comment or declaration
            end, tag, attributes = end2, tag2, attributes2
        tag = tag.lower()
        block = tag in BLOCK
        if tag in ("br", "td", "th"):
            piece.append(" ")
        if end:
            if stack[-1][0] == tag:
                close(len(stack) - 1)
            elif opened.get(tag):
                for depth in range(len(stack) - 1, 0, -1):
                    name, *_, is_block = stack[depth]
                    if name == tag:
                        close(depth)
                        break
                    if is_block and name not in ("option", "optgroup") and (not block or tag == "p"):
                        break  # a stray end tag
            continue
        if block:
            if piece:
                flush()
            # an open paragraph or item ends where the next block of its kind begins
            if tag in ENDS_P and opened.get("p"):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p":
                        close(depth)
                        break
                    if stack[depth][4]:
                        break
        if tag in ITEMS and any(opened.get(t) for t in ITEMS[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ITEMS[tag]:
                    close(depth)
                    break
                if stack[depth][0] in ("ul", "ol", "table", "tr", "dl", "select", "menu"):
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            ending = _RAW_END[tag].search(html, at) if at <= last else None
            at = ending.end() if ending else size
            continue
        _, node, other, article, _ = stack[-1]
        style, kind, never = ((tag, WRAPS if tag in NOT_TEXT else PLAIN, tag in NEVER) if not attributes or attributes.isspace()
                              else _marked(tag, attributes))
        if attributes.endswith("/") and not block:
            continue
        # a header of the article itself, with its heading, is part of the article
        if tag == "header" and article >= 0 and style == "header":
            kind, never = PLAIN, False
        main = tag == "main" or 'role="main"' in attributes
        if other != -2 and not kind and not never and article < 0 and (main or tag == "article"):
            article = len(articles)
            articles.append((other, main))
        if never or other == -2:
            other = -2
        elif kind:
            named.append((other, kind))
            other = len(named) - 1
        if block and depth_of[node] < DEPTH:
            child = number.setdefault((node, style), len(nodes))
            if child == len(nodes):
                nodes.append((node, style))
                depth_of.append(depth_of[node] + 1)
            node = child
        stack.append((tag, node, other, article, block))
        opened[tag] = opened.get(tag, 0) + 1
    if piece:
        flush()
    own, sizes, rest = [0] * (len(named) + 1), [0] * len(articles), 0
    for _, text, article, other in out:
        if other != -2:
            own[other] += len(text)
            if article >= 0:
                sizes[article] += len(text)
            elif other == -1:
                rest += len(text)
    kept, pages = _kept(named, own, [(e, main, size) for (e, main), size in zip(articles, sizes)], rest)
    kept, pages = [*kept, False, True], [*pages, False]  # -2, -1: never text, no branch; -1: no article
    return nodes, [(node, text, article if kept[other] and pages[article] else -1, int(not kept[other]))
                   for node, text, article, other in out]


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_ids(nodes: list[tuple[int, str]], common: frozenset[str]) -> tuple[list[int], dict[int, tuple[int, int, dict[str, None]]]]:
    """(the id of each node's place in the style tree; per id: (parent's id, depth, styles of its children in order)).

    Classes that are not ``common`` on the host are left out of the styles."""
    ids, tree = [0], {0: (0, 0, {})}
    for parent, style in nodes[1:]:
        tag, *classes = style.split(".")
        style = ".".join([tag, *[c for c in classes if c in common]])
        above = ids[parent]
        tree[above][2][style] = None
        one = xxhash.xxh3_64_intdigest(f"{above}/{style}".encode("utf-8", "replace")) - 2**63
        ids.append(one)
        if one not in tree:
            tree[one] = (above, tree[above][1] + 1, {})
    return ids, tree


def parsed(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the columns ``keep``, then _host, _blocks (node, text, article, named) and _nodes (parent, style)."""
    keep = list(keep)
    schema = T.StructType([*[pages.schema[c] for c in keep], *T.StructType.fromDDL(
        "_host string, _blocks array<struct<node:int,text:string,article:int,named:int>>, "
        "_nodes array<struct<parent:int,style:string>>").fields])

    def lists(sizes: list[int], names: list[str], columns: list[pa.Array]) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(p or "") for p in batch.column(len(keep) + 1).to_pylist()]
            blocks, nodes = [b for _, r in rows for b in r], [n for n, _ in rows for n in n]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep) + 1], lists(
                [len(r) for _, r in rows], ["node", "text", "article", "named"],
                [pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.string()),
                 pa.array([b[2] for b in blocks], pa.int32()), pa.array([b[3] for b in blocks], pa.int32())]), lists(
                [len(n) for n, _ in rows], ["parent", "style"],
                [pa.array([p for p, _ in nodes], pa.int32()), pa.array([x for _, x in nodes], pa.string())])], schema.names)

    return pages.select(*keep, host_of(url).alias("_host"), F.col(html).cast("string").alias("_html")).mapInArrow(run, schema)


def common_classes(pages: DataFrame, enough: int = PAGES) -> DataFrame:
    """Rows (host, common): the classes that at least ``enough`` pages of a host show."""
    classes = F.array_distinct(F.flatten(F.transform("_nodes.style", lambda s: F.slice(F.split(s, "[.]"), F.lit(2), F.size(F.split(s, "[.]"))))))
    counts = (pages.select(F.col("_host").alias("host"), F.explode(classes).alias("class"))
              .groupBy("host", "class").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= enough))
    return counts.groupBy("host").agg(F.sort_array(F.collect_list("class")).alias("common"))


def _with_host(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """``rows`` with the columns of their host: by broadcast if there are few hosts with any, else by host and salt,
    as a host may have a third of the pages."""
    hosts = hosts.withColumnRenamed("host", "_of")
    size = hosts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(F.to_json(F.struct(*hosts.columns[1:])))).alias("chars")).first()
    if size["n"] <= BROADCAST_ROWS and (size["chars"] or 0) <= BROADCAST_CHARS:
        return rows.join(F.broadcast(hosts), F.col("_of").eqNullSafe(F.col("_host")), "left").drop("_of")
    salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.withColumn("_deal", F.pmod(F.xxhash64("_nodes", "_blocks"), F.lit(SALTS)))
            .join(salted, F.col("_of").eqNullSafe(F.col("_host")) & (F.col("_deal") == F.col("_salt")), "left")
            .drop("_of", "_deal", "_salt"))


def _each_host(batch: pa.RecordBatch, columns: list[str]) -> Iterator[list[frozenset]]:
    """The sets of a page's host, for each row; a host's are read once a batch."""
    seen: dict[str | None, list[frozenset]] = {}
    lists = [batch.column(c) for c in columns]
    for i, host in enumerate(batch.column("_host").to_pylist()):
        if host not in seen:
            seen[host] = [frozenset(c[i].as_py() or ()) for c in lists]
        yield seen[host]


def features(pages: DataFrame) -> DataFrame:
    """Rows (host, node, parent, depth, kind, feature) of pages with ``common``: each node of a page (p), its layout (l)
    and the texts of its blocks (t), once a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            hosts, nodes, blocks = (batch.column(c).to_pylist() for c in ("_host", "_nodes", "_blocks"))
            for host, node, block, (common,) in zip(hosts, nodes, blocks, _each_host(batch, ["common"])):
                ids, tree = style_ids([(n["parent"], n["style"]) for n in node], common)
                for one, (parent, depth, kids) in tree.items():
                    rows.append((host, one, parent, depth, "p", 0))
                    if kids:
                        rows.append((host, one, parent, depth, "l", xxhash.xxh3_64_intdigest("\0".join(kids).encode("utf-8", "replace")) - 2**63))
                for one, text in {(ids[b["node"]], b["text"]): None for b in block}:
                    parent, depth, _ = tree[one]
                    rows.append((host, one, parent, depth, "t", xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - 2**63))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             ["host", "node", "parent", "depth", "kind", "feature"])

    return pages.select("_host", "_nodes", "_blocks", "common").mapInArrow(
        run, "host string, node long, parent long, depth int, kind string, feature long")


def importance(found: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """Rows (host, node, m, importance, most) of the style trees of :func:`features`; ``most`` is the largest importance of a
    node and those below it.  One step a level, at most DEPTH."""
    counts = found.groupBy("host", "node", "parent", "depth", "kind", "feature").agg(F.count(F.lit(1)).alias("pages"))
    # sums of c log c give the entropies once m, the pages with the node, is known
    clog = F.col("pages") * F.log("pages")
    node = written(counts.groupBy("host", "node", "parent", "depth").agg(
        F.sum(F.when(F.col("kind") == "p", F.col("pages"))).alias("m"),
        F.sum(F.when(F.col("kind") == "l", F.col("pages"))).alias("layouts"),
        F.sum(F.when(F.col("kind") == "l", clog)).alias("layout_log"),
        F.count(F.when(F.col("kind") == "t", 1)).alias("texts"),
        F.sum(F.when(F.col("kind") == "t", F.log("pages"))).alias("text_log")), "nodes")
    log_m = F.log("m")
    several = F.col("m") > 1
    own = F.when((F.col("texts") > 0) & several, 1 - F.col("text_log") / F.col("texts") / log_m).otherwise(1.0)
    layout = F.when(several & (F.col("layouts") > 0), F.least(F.lit(1.0), (F.log("layouts") - F.col("layout_log") / F.col("layouts")) / log_m)).otherwise(1.0)
    weight = F.pow(F.lit(gamma), F.col("kids"))
    below = F.when(F.col("texts") > 0, F.greatest("below", own)).otherwise(F.col("below"))
    value = F.when(F.col("kids").isNull(), own).otherwise((1 - weight) * layout + weight * below)
    most = F.when(F.col("kids").isNull(), own).otherwise(F.greatest(value, "most_below", F.when(F.col("texts") > 0, own).otherwise(0.0)))
    done: DataFrame | None = None
    level: DataFrame | None = None
    for depth in range((node.agg(F.max("depth")).first()[0] or 0), -1, -1):
        here = node.where(F.col("depth") == depth)
        if level is None:
            here = here.withColumns({"kids": F.lit(None).cast("long"), "below": F.lit(None).cast("double"), "most_below": F.lit(None).cast("double")})
        else:
            kids = level.groupBy(F.col("host").alias("_h"), F.col("parent").alias("_p")).agg(
                F.count(F.lit(1)).alias("kids"), (F.sum(F.col("m") * F.col("importance")) / F.sum("m")).alias("below"), F.max("most").alias("most_below"))
            here = here.join(kids, F.col("host").eqNullSafe(F.col("_h")) & (F.col("node") == F.col("_p")), "left").drop("_h", "_p")
        level = written(here.select("host", "node", "parent", "m", value.alias("importance"), most.alias("most")), "level")
        done = level if done is None else done.unionByName(level)
    return done.drop("parent")


def low_branches(weighed: DataFrame, least: float = LEAST, enough: int = PAGES) -> DataFrame:
    """Rows (host, low): the nodes of each host's style tree whose importance, and that of all below them, is under
    ``least`` and which at least ``enough`` pages show."""
    low = weighed.where((F.col("node") != 0) & (F.col("most") < least) & (F.col("m") >= enough))
    return low.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("low"))


def main_text(nodes: list[tuple[int, str]], blocks: list[Block], common: frozenset[str], low: frozenset[int]) -> str:
    """The text of a page without the low branches of its host."""
    ids, _ = style_ids(nodes, common)
    pruned = [False] * len(nodes)
    for i, (parent, _) in enumerate(nodes):
        pruned[i] = ids[i] in low or parent >= 0 and pruned[parent]
    inside = [b for b in blocks if b[2] >= 0] or [b for b in blocks if not b[3]]
    left = [b[1] for b in inside if not pruned[b[0]]]
    return "\n\n".join(left or [b[1] for b in inside])


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the columns ``keep`` and text: the blocks of the article without the low branches."""
    held = pages.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("held"),
                        F.col(html).alias("html"), F.col(url).alias("url"))
    rows = written(parsed(held, keep=("held",)), "parsed")
    common = written(common_classes(rows), "classes")
    named = _with_host(rows, common)
    low = written(low_branches(importance(features(named))), "branches")
    both = _with_host(named, low)
    schema = T.StructType([both.schema["held"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for node, block, sets in zip(batch.column("_nodes").to_pylist(), batch.column("_blocks").to_pylist(), _each_host(batch, ["common", "low"])):
                texts.append(main_text([(n["parent"], n["style"]) for n in node],
                                       [(b["node"], b["text"], b["article"], b["named"]) for b in block], *sets))
            yield pa.RecordBatch.from_arrays([batch.column("held"), pa.array(texts, pa.string())], ["held", "text"])

    out = both.select("held", "_host", "_nodes", "_blocks", "common", "low").mapInArrow(run, schema)
    return out.select(*[F.col("held").getField(c).alias(c) for c in keep], "text")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    out = extract(table(spark, sf_dir, "pages"), keep=("page_id", "url"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
