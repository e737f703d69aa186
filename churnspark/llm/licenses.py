"""Licence scan: headers and licence files against templates, and inheritance down the directories.

1. Every line is a set of terms (letters or digits, lower case); so are two lines that follow each other, for
   statements that are wrapped, and whole files.  Terms are weighed by inverse document frequency over all lines of
   all files, inside and outside the templates' vocabulary.
2. Headers: a line's licence is the statement with the highest cosine, if it is at least ``COSINE``.  Two lines that have none
   alone may have one together.  Licence files: a file's licence is the whole licence text with the highest cosine, if it is
   at least ``FILE_COSINE``.  What no template can reach, even if its other terms had the least possible weight, is left out
   before any term is joined.
3. A file whose terms are mostly in licence lines, or that is like a whole licence text, is a licence file: its licence holds in
   its directory and below.
4. A file without a licence of its own takes that of the nearest ancestor directory: each directory is
   joined with its ancestors once, and files with their directory.

Built from DataFrame functions alone; the vocabulary and the templates are fixed tables.

Cases: null or empty text has no licence of its own but may inherit one; a null path inherits nothing; a whole text goes before
lines; of equal cosines the licence and then the line first in order wins, and of several licence files in a
directory the one with the highest cosine, then the smallest licence and path; repeated rows are files of
their own; an empty table gives no row.  Columns other than the key, the path and the text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.broadcast import checked_broadcast
from .license_texts import FILE_TEMPLATES
from .spark import table, written

# fixed values: statements that name a licence, as headers and licence files have them
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Licensed under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
COSINE = 0.6
FILE_COSINE = 0.45
MOSTLY = 0.5
TERM = r"[\p{L}\p{N}]+"


def template_terms(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """Rows (template, license, term) of the fixed table."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)],
                                 "template int, license string, statement string")
    return rows.select("template", "license", F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("statement"), F.lit(TERM), F.lit(0)))).alias("term"))


def bags_of(files: DataFrame, text: str = "text") -> DataFrame:
    """Rows (row, line, all): the distinct terms of each line that is not blank."""
    return (files.select("row", F.posexplode(F.split(text, "\n")).alias("line", "words"))
            .withColumn("all", F.array_distinct(F.regexp_extract_all(F.lower("words"), F.lit(TERM), F.lit(0))))
            .where(F.size("all") > 0).select("row", "line", "all"))


def frequencies(lines: DataFrame) -> DataFrame:
    """Written rows (term, df): lines with each term; the empty term stands for all lines."""
    return written(lines.select(F.explode(F.array_append("all", F.lit(""))).alias("term")).groupBy("term")
                   .agg(F.count(F.lit(1)).alias("df")), "terms")


def similar(bags: DataFrame, key: list[str], seen: DataFrame, templates, cosine: float, name: str) -> DataFrame:
    """Written rows (key…, license, score): the best template of each bag (``all``), if its cosine is at least ``cosine``."""
    spark = bags.sparkSession
    terms = template_terms(spark, templates)
    many = (seen.where("term = ''").first() or ("", 0))[1]
    weight = F.log(F.lit(1.0 + many) / (1 + F.coalesce("df", F.lit(0)))) + 1
    idf = written(terms.select("term").distinct().join(seen, "term", "left")
                  .select("term", (weight * weight).alias("w2")), "idf")  # a row per term of the fixed table
    of = terms.join(idf, "term")
    of = written(of.join(of.groupBy("template").agg(F.sum("w2").alias("t2")), "template"), "templates")
    # the templates in the plan, as a fixed table
    w2 = {r["term"]: r["w2"] for r in idf.orderBy("term").collect()}
    texts: dict[int, list[str]] = {}
    for r in of.select("template", "term").orderBy("template", "term").collect():
        texts.setdefault(r["template"], []).append(r["term"])
    vocabulary = F.lit(list(w2))
    weights = F.create_map(*[F.lit(x) for pair in w2.items() for x in pair])

    def total(some: Column) -> Column:
        return F.aggregate(some, F.lit(0.0), lambda sum_, t: sum_ + weights[t])

    # the square of the cosine is at most the common terms' weight / t2.  A template's lightest terms, which together
    # reach half of what is needed, leave the other half to its heavy ones: so many of these must be there
    least = (cosine - 1e-6) ** 2  # scores are rounded
    fixed, heavy_terms, fewest = [], set(), math.inf
    for terms_of in texts.values():
        t2 = sum(w2[t] for t in terms_of)
        heavy, light = sorted(terms_of, key=lambda t: (w2[t], t)), 0.0
        while heavy and light + w2[heavy[0]] <= least * t2 / 2:
            light += w2[heavy.pop(0)]
        few = (least * t2 - light) / w2[heavy[-1]]
        fewest, heavy_terms = min(fewest, few), heavy_terms | set(heavy)
        fixed.append(F.struct(F.lit(few).alias("few"), F.lit(t2).alias("t2"), F.lit(heavy).alias("heavy"), F.lit(terms_of).alias("terms")))
    fixed = F.array(*fixed)
    bags = bags.withColumn("_heavy", F.array_intersect("all", F.lit(sorted(heavy_terms)))).where(F.size("_heavy") >= fewest)
    bags = bags.where(F.exists(fixed, lambda t: F.size(F.array_intersect("_heavy", t["heavy"])) >= t["few"]))
    # any term weighs at least 1, whatever its frequency: a bound without the weights of terms that no template has
    bags = bags.withColumn("known", F.array_intersect("all", vocabulary)).withColumn("known2", total(F.col("known")))
    reach = F.exists(fixed, lambda t: F.pow(total(F.array_intersect("known", t["terms"])), 2)
                     >= least * t["t2"] * (F.col("known2") + F.size("all") - F.size("known")))
    may = written(bags.where(reach).select(*key, "all", "known"), name)
    strange = (may.select(*key, F.explode(F.array_except("all", "known")).alias("term")).join(seen, "term")
               .groupBy(*key).agg(F.sum(weight * weight).alias("strange")))
    term = may.select(*key, F.explode("known").alias("term"))
    norm = (term.join(F.broadcast(idf), "term").groupBy(*key).agg(F.sum("w2").alias("norm2"))
            .join(strange, key, "left").select(*key, (F.col("norm2") + F.coalesce("strange", F.lit(0.0))).alias("norm2")))
    dot = (term.join(F.broadcast(of), "term").groupBy(*key, "template", "license")
           .agg(F.sum("w2").alias("dot"), F.first("t2").alias("t2")))
    score = F.round(F.col("dot") / F.sqrt(F.col("norm2") * F.col("t2")), 6)
    best = (dot.join(norm, key).withColumn("score", score).where(F.col("score") >= cosine)
            .groupBy(*key).agg(F.min(F.struct(-F.col("score"), "license")).alias("b"))
            .select(*key, F.col("b.license").alias("license"), (-F.col("b.col1")).alias("score")))
    return written(best, f"{name}-found")


def line_licenses(files: DataFrame, text: str = "text", templates=TEMPLATES, cosine: float = COSINE, seen: DataFrame | None = None) -> DataFrame:
    """Rows (row, line, license, score) of the lines with a licence, alone or with the line before or after.

    ``files`` has a unique long column ``row``."""
    seen = frequencies(bags_of(files, text)) if seen is None else seen
    bags = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), F.array_distinct(
        F.regexp_extract_all(F.lower(x), F.lit(TERM), F.lit(0))).alias("all"))), lambda b: F.size(b["all"]) > 0)
    # each line, and each with the next that is not blank; ``next`` is -1 for a line alone
    single = F.transform("bags", lambda b: F.struct(b["line"].alias("line"), F.lit(-1).alias("next"), b["all"].alias("all")))
    pairs = F.transform(F.slice("bags", F.lit(2), F.greatest(F.size("bags") - 1, F.lit(0))), lambda b, i: F.struct(
        F.get(F.col("bags"), i)["line"].alias("line"), b["line"].alias("next"), F.array_union(F.get(F.col("bags"), i)["all"], b["all"]).alias("all")))
    each = files.select("row", bags.alias("bags")).select("row", F.explode(F.concat(single, pairs)).alias("p")).select("row", "p.*")
    found = similar(each, ["row", "line", "next"], seen, templates, cosine, "lines")
    alone = found.where("next < 0").drop("next")
    taken = alone.select("row", "line")
    windows = (found.where("next >= 0").join(taken, ["row", "line"], "left_anti")
               .join(taken.withColumnRenamed("line", "next"), ["row", "next"], "left_anti"))
    parts = windows.select("row", F.explode(F.array("line", "next")).alias("line"), "license", "score")
    best = parts.groupBy("row", "line").agg(F.min(F.struct(-F.col("score"), "license")).alias("b"))
    return alone.unionByName(best.select("row", "line", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("score")))


def file_licenses(files: DataFrame, seen: DataFrame, text: str = "text", templates=FILE_TEMPLATES, cosine: float = FILE_COSINE) -> DataFrame:
    """Rows (row, license, score) of the files that are like a whole licence text."""
    bags = files.select("row", F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("all"))
    return similar(bags, ["row"], seen, templates, cosine, "files")


def directory(path: str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, key: str, path: str, text: str = "text", templates=TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """Rows (key, path, license_lines, own_license, own_score, is_license_file, license, license_dir).

    ``license`` is the file's own or the inherited one; ``license_dir`` the directory it is inherited from."""
    rows = written(files.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(path).cast("string").alias("path"),
                                F.col(text).cast("string").alias("text")), "rows")  # once: a number computed anew may differ
    seen = frequencies(bags_of(rows))
    lines = written(line_licenses(rows, "text", templates, cosine, seen), "licensed")
    # only files with such lines are asked for how much of them it is
    some = bags_of(rows.join(checked_broadcast(lines.select("row").distinct()), "row", "left_semi")).join(lines, ["row", "line"], "left")
    own = some.groupBy("row").agg(
        F.count("license").alias("license_lines"),
        (F.sum(F.when(F.col("license").isNotNull(), F.size("all"))) / F.sum(F.size("all"))).alias("part"),
        F.min(F.when(F.col("license").isNotNull(), F.struct(-F.col("score"), "license", "line"))).alias("b"))
    whole = file_licenses(rows, seen).select("row", F.col("license").alias("file_license"), F.col("score").alias("file_score"))
    found = written(rows.select("row", "key", "path").join(own, "row", "left").join(whole, "row", "left").select(
        "key", "path", directory("path").alias("dir"), F.coalesce("license_lines", F.lit(0)).cast("long").alias("license_lines"),
        F.coalesce("file_license", "b.license").alias("own_license"), F.coalesce("file_score", -F.col("b.col1")).alias("own_score"),
        (F.col("file_license").isNotNull() | F.coalesce(F.col("part") >= MOSTLY, F.lit(False))).alias("is_license_file")), "found")
    # directories, not files, are joined with their ancestors
    holds = (found.where(F.col("is_license_file") & F.col("path").isNotNull()).groupBy("dir")
             .agg(F.min(F.struct(-F.col("own_score"), "own_license", "path")).alias("b"))
             .select(F.col("dir").alias("license_dir"), F.col("b.own_license").alias("license")))
    parts = F.split("dir", "/")
    ancestor = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    dirs = found.where(F.col("path").isNotNull()).select("dir").distinct().select("dir", ancestor.alias("license_dir")).distinct()
    nearest = (dirs.join(holds, "license_dir").groupBy("dir")
               .agg(F.max(F.struct(F.length("license_dir"), "license_dir", "license")).alias("b"))
               .select("dir", F.col("b.license").alias("inherited"), F.col("b.license_dir").alias("license_dir")))
    nearest = written(nearest, "directories")  # both sides of the join are read from files: a hot directory can be split
    return (found.join(nearest, "dir", "left")
            .select(F.col("key").alias(key), F.col("path").alias(path), "license_lines", "own_license", "own_score",
                    "is_license_file", F.coalesce("own_license", F.when(F.col("path").isNotNull(), F.col("inherited"))).alias("license"),
                    F.when(F.col("own_license").isNull() & F.col("path").isNotNull(), F.col("license_dir")).alias("license_dir")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all ``documents``, filed by source, thousand and hundred of their id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"),
                       F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.withColumn("path", path), "doc_id", "path")


def _values(templates) -> str:
    return "select * from (values " + ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(templates)) \
        + ") t(template, license, statement)"


def _similar_sql(name: str, bags: str, key: str, templates, cosine: float) -> str:
    """CTE ``name`` (key, license, score): the best template of each row (key, bag) of ``bags``."""
    return rf"""
{name}_terms as materialized (
  select template, license, unnest(list_distinct(regexp_extract_all(lower(statement), '[\p{{L}}\p{{N}}]+'))) as term from ({_values(templates)})),
{name}_of as materialized (select template, license, term, pow(ln((1.0::double + many) / (1 + coalesce(d.df, 0))) + 1, 2) as w2
  from {name}_terms t cross join total left join df d using (term)),
{name}_each as materialized (select {key}, unnest(bag) as term from {bags}),
{name}_norms as (select {key}, sum(pow(ln((1.0::double + many) / (1 + d.df)) + 1, 2)) as norm2 from {name}_each join df d using (term) cross join total group by {key}),
{name}_dots as (select {key}, template, license, sum(w2) as dot from {name}_each join {name}_of using (term) group by {key}, template, license),
{name}_sizes as (select template, sum(w2) as t2 from {name}_of group by template),
{name} as materialized (
  select {key}, license, score from (
    select {key}, license, round(dot / sqrt(norm2 * t2), 6) as score from {name}_dots join {name}_norms using ({key}) join {name}_sizes using (template))
  where score >= {cosine} qualify row_number() over (partition by {key} order by score desc, license) = 1)"""


OP3_SQL = r"""
with files as materialized (
  select doc_id, row_number() over () as line_of, text,
         concat_ws('/', coalesce(source, 'none'), floor(doc_id / 1000.0)::bigint, floor(doc_id / 100.0)::bigint) as dir,
         concat_ws('/', coalesce(source, 'none'), floor(doc_id / 1000.0)::bigint, floor(doc_id / 100.0)::bigint,
                   doc_id || '.txt') as path
  from documents),
split_lines as (
  select line_of, unnest(string_split(text, chr(10))) as words, unnest(range(len(string_split(text, chr(10))))) as line from files),
lines as materialized (
  select line_of, line, bag, len(bag) as terms from (
    select line_of, line, list_distinct(regexp_extract_all(lower(words), '[\p{L}\p{N}]+')) as bag from split_lines) where len(bag) > 0),
total as materialized (select count(*) as many from lines),
df as materialized (select term, count(*) as df from (select unnest(bag) as term from lines) group by term),
pairs as (
  select line_of, line, next, list_distinct(list_concat(bag, more)) as bag from (
    select line_of, line, bag, lead(line) over w as next, lead(bag) over w as more from lines window w as (partition by line_of order by line))
  where next is not null),
whole as (select line_of, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as bag from files where text is not null),
""" + ",".join([
    _similar_sql("alone", "lines", "line_of, line", TEMPLATES, COSINE), _similar_sql("together", "pairs", "line_of, line, next", TEMPLATES, COSINE),
    _similar_sql("like_files", "whole", "line_of", FILE_TEMPLATES, FILE_COSINE)]) + r""",
apart as (
  select t.* from together t left join alone a on a.line_of = t.line_of and a.line = t.line left join alone b on b.line_of = t.line_of and b.line = t.next
  where a.line is null and b.line is null),
matched as (
  select line_of, line, license, score from alone
  union all select line_of, line, license, score from (
    select line_of, line, license, score, row_number() over (partition by line_of, line order by score desc, license) as nth from (
      select line_of, line, license, score from apart union all select line_of, next, license, score from apart)) where nth = 1),
own as (
  select l.line_of, count(m.license) as license_lines,
         sum(case when m.license is not null then l.terms end) / sum(l.terms)::double as part,
         min(struct_pack(s := -m.score, l := m.license, n := l.line)) filter (m.license is not null) as b
  from lines l left join matched m using (line_of, line) group by l.line_of),
found as (
  select f.doc_id, f.path, f.dir, coalesce(o.license_lines, 0)::bigint as license_lines, coalesce(w.license, o.b.l) as own_license,
         coalesce(w.score, -o.b.s) as own_score, w.license is not null or coalesce(o.part >= 0.5, false) as is_license_file
  from files f left join own o using (line_of) left join like_files w using (line_of)),
holds as (
  select dir as license_dir, own_license as held from found where is_license_file
  qualify row_number() over (partition by dir order by own_score desc, own_license, path) = 1),
nearest as (
  select d.dir, h.license_dir, h.held from (select distinct dir from found) d
  join holds h on d.dir = h.license_dir or starts_with(d.dir, h.license_dir || '/')
  qualify row_number() over (partition by d.dir order by length(h.license_dir) desc) = 1)
select f.doc_id, f.path, f.license_lines, f.own_license, f.own_score, f.is_license_file,
       coalesce(f.own_license, n.held) as license, case when f.own_license is null then n.license_dir end as license_dir
from found f left join nearest n using (dir)
"""
