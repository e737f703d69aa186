"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text: str | None, size: int) -> set:
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    if not w:
        return set()
    n = min(size, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def near_groups(docs: list[tuple[int, str | None]], size: int, percent: int = 80) -> dict[int, int]:
    sets = [(i, shingles(t, size)) for i, t in docs]
    edges = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k]
             if s and t and 100 * len(s & t) >= percent * len(s | t)]
    return union_find([i for i, _ in docs], edges)


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return len(b) - len(a) <= 1 and (a[i:] == b[i + 1:] or a[i + 1:] == b[i + 1:])


def kept_lines(docs: list[tuple[int, str | None]]) -> list[tuple[str | None, int, int]]:
    """(text, lines that are not blank, lines removed) of documents in their order."""
    seen: list[str] = []
    out = []
    for _, text in docs:
        if text is None:
            out.append((None, 0, 0))
            continue
        kept, n, removed = [], 0, 0
        for line in text.split("\n"):
            if not line or line.isspace():
                kept.append(line)
                continue
            n += 1
            if any(abs(len(line) - len(o)) <= 1 and one_edit(line, o) for o in seen):
                removed += 1
            else:
                kept.append(line)
            seen.append(line)
        out.append(("\n".join(kept), n, removed))
    return out


def kept_words(docs: list[tuple[int, str | None]], window: int = 20) -> list[tuple[str, int, int]]:
    """(kept words, words, words removed) of documents in their order."""
    seen: set[tuple] = set()
    out = []
    for _, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            s = tuple(w[i:i + window])
            if s in seen:
                gone[i:i + window] = [True] * window
            seen.add(s)
        out.append((" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return out


LINE = re.compile(r"[^\n]*\n|[^\n]+")


def fill_in_middle(key, text: str | None, rate: int = 100, spm: int = 50) -> tuple:
    """(n, form, prefix length, middle length, output)."""
    text = text or ""
    units = LINE.findall(text)
    digits = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def spelling(docs, one_in: int | None = 31) -> dict:
    """word: (form, root, n, n_near, form_n), by deletion neighbourhoods and an edit check."""
    count: collections.Counter = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if one_in and h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 2}
    by_variant = collections.defaultdict(set)
    for w in words:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_variant[v].add(w)
    near = collections.defaultdict(set)
    for same in by_variant.values():
        for a in same:
            near[a] |= {b for b in same if a != b and one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def exact_groups(docs) -> list[tuple]:
    """(key, keep key, group size, rows kept in the group) for each document."""
    groups = collections.defaultdict(list)
    for key, text in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(key)
    return [(k, min(g, key=lambda x: (x is None, x or 0)), len(g), t) for t, g in groups.items() for k in g]


def style_tree(pages, enough: int, gamma: float) -> dict:
    """Style path: (pages with it, importance, largest importance from there down) of one host's parsed pages."""
    shown = collections.Counter(c for nodes, _ in pages for c in {c for _, s in nodes for c in s.split(".")[1:]})
    m: collections.Counter = collections.Counter()
    layouts, texts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    children = collections.defaultdict(set)
    for nodes, blocks in pages:
        paths, kids = [()], {(): {}}
        for parent, style in nodes[1:]:
            tag, *classes = style.split(".")
            name = ".".join([tag, *[c for c in classes if shown[c] >= enough]])
            kids[paths[parent]][name] = None
            children[paths[parent]].add((*paths[parent], name))
            paths.append((*paths[parent], name))
            kids.setdefault(paths[-1], {})
        for path, names in kids.items():
            m[path] += 1
            if names:
                layouts[path][tuple(names)] += 1
        for path, text in {(paths[b[0]], b[1]) for b in blocks}:
            texts[path][text] += 1
    out: dict = {}

    def weigh(path):
        for kid in children[path]:
            weigh(kid)
        log_m = math.log(m[path])
        own = 1.0
        if texts[path] and log_m:
            own = 1 - sum(math.log(n) for n in texts[path].values()) / len(texts[path]) / log_m
        if not children[path]:
            out[path] = (m[path], own, own)
            return
        layout = 1.0
        if log_m and layouts[path]:
            total = sum(layouts[path].values())
            layout = min(1.0, -sum(n / total * math.log(n / total) for n in layouts[path].values()) / log_m)
        below = sum(out[k][0] * out[k][1] for k in children[path]) / sum(out[k][0] for k in children[path])
        if texts[path]:
            below = max(below, own)
        weight = gamma ** len(children[path])
        value = (1 - weight) * layout + weight * below
        out[path] = (m[path], value, max(value, own if texts[path] else 0.0, *(out[k][2] for k in children[path])))

    weigh(())
    return out
