"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled (by the md5 of their id) into one stream of words, which is cut
into equal blocks of about ``block_words`` words.  Slot i of the schedule is the golden-ratio point
``frac(i * phi)`` mapped through the cumulative target weights, so any run of slots holds the sources
in nearly their target shares.  Slots are ranked per source; the slot of rank r takes the source's
block ``r mod blocks`` in its pass ``r div blocks``.  A source's quota of slots is its target in blocks,
rounded: slots beyond the quota are void, and the few that a source may lack come at the end.

Built from DataFrame functions alone.  Sources are a table that is never collected; totals per source
and ranks per source are running totals over bins, so a hot source is spread over many tasks.

Cases: a null text has size 0 and is never taken, and so is a source without words; sources that are
null come last; repeated rows are separate documents of the stream; an empty table gives no row.
Columns other than the id, the source and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.broadcast import checked_broadcast
from .spark import numbered, running_totals, table, words_column, written

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 64
DOCS_PER_BIN = 2048
SLOTS_PER_BIN = 16384
CELLS = 4096
PHI = 0.6180339887498949


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
          row: Column | None = None) -> DataFrame:
    """Rows (key, source, size, row), written once; ``row`` tells repeated rows apart."""
    row = F.monotonically_increasing_id() if row is None else row
    return written(docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                               words_column(text).alias("size"), row.alias("row")), "sizes")


def targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Rows (source, source_size, target): water-filling in closed form over the table of sources.

    Sources are capped in the order of cap / weight: with those below a level capped, the level of the
    others is what is left of the total divided by their weights.  One row per source passes through
    the windows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("nth", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    per = per.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(max_passes))})
    all_rows = Window.partitionBy()
    per = per.withColumns({"total": F.sum("source_size").over(all_rows), "all_weight": F.sum("weight").over(all_rows)})
    before = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
                           "capped_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight")))
    # the level rises with each source that has to be capped and falls after them
    per = per.withColumn("final", F.max("level").over(all_rows))
    return per.select("source", "source_size", "nth", F.least("cap", F.col("weight") * F.col("final")).alias("target"))


def quotas(goal: DataFrame, block_words: int, max_passes: int) -> DataFrame:
    """Adds blocks (equal blocks of the source) and quota (slots); takes no source without words."""
    return (goal.where("source_size > 0")
            .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
            .withColumn("quota", F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"),
                                         F.col("blocks") * max_passes)))


def schedule(goal: DataFrame) -> DataFrame:
    """Slots (slot, nth, rank, block, pass): the order in which blocks are read."""
    spark = goal.sparkSession
    slots = goal.agg(F.sum("quota")).first()[0] or 0
    share = F.sum("quota").over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    bounds = (goal.withColumn("high", share / F.lit(float(max(slots, 1))))
              .withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("nth")), F.lit(0.0)))
              .where("quota > 0")
              .select("nth", "quota", "blocks", "low", "high",
                      F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(
                          F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell")))
    # cells: an equality join of points and weight intervals, and a few sources in each cell
    point = F.col("slot") * F.lit(PHI) - F.floor(F.col("slot") * F.lit(PHI))
    points = (spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", point)
              .withColumn("cell", F.floor(F.col("u") * CELLS)))
    drawn = written(points.join(bounds, "cell").where("u >= low and u < high")
                    .select("slot", "nth", F.lit(1).alias("one"), F.floor(F.col("slot") / SLOTS_PER_BIN).alias("bin")),
                    "slots")
    ranked = running_totals(drawn, ["nth"], ["bin", "slot"], {"rank": "one"}, 0).select("slot", "nth", "rank")
    counts = drawn.groupBy("nth").agg(F.count(F.lit(1)).alias("drawn"))
    lacking = (goal.join(counts, "nth", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
               .where("drawn < quota")
               .select("nth", F.explode(F.expr("sequence(drawn, quota - 1)")).alias("rank"))
               .select((F.lit(slots) + F.col("rank")).alias("slot"), "nth", "rank"))
    plan = goal.select("nth", "quota", "blocks")
    return (ranked.unionByName(lacking).join(plan, "nth").where("rank < quota")
            .select("slot", "nth", "rank", (F.col("rank") % F.col("blocks")).alias("block"),
                    F.floor(F.col("rank") / F.col("blocks")).alias("pass")))


def mix(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES,
        block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, takes) of rows (key, source, size, row).

    documents: a row per input row with ``source_size`` and ``target``.  takes: rows (row, pass,
    slot, word_from, word_to), the words of a document that a slot reads."""
    bins = max(64, sizes.count() // DOCS_PER_BIN)
    goal = written(quotas(targets(sizes, weights, max_passes), block_words, max_passes)
                   .unionByName(targets(sizes, weights, max_passes).where("source_size = 0"), True), "targets")
    docs = written(sizes.withColumn("deal", F.md5(F.col("key").cast("string")))
                   .withColumn("bin", F.floor(F.coalesce(F.conv(F.substring("deal", 1, 8), 16, 10).cast("long"), F.lit(0))
                                              * bins / F.lit(2.0 ** 32)))  # rises with deal
                   .join(goal, sizes["source"].eqNullSafe(goal["source"])).drop(goal["source"]), "mixed")
    stream = running_totals(docs.where("size > 0").select("row", "nth", "bin", "deal", "size", "source_size", "blocks"),
                            ["nth"], ["bin", "deal", "row"], {"at": "size"}, bins)
    # block k holds the words from floor(k * size / blocks) of the source's stream; the products are beyond a long
    def product(a: str, b: str) -> str:
        return f"cast({a} as decimal(19,0)) * cast({b} as decimal(18,0))"
    parts = stream.withColumn("block", F.explode(F.sequence(
        F.expr(f"({product('at', 'blocks')}) div source_size"),
        F.expr(f"least(({product('at + size', 'blocks')}) div source_size, blocks - 1)"))))
    low, high = (f"({product('source_size', k)} + blocks - 1) div blocks" for k in ("block", "block + 1"))
    parts = (parts.withColumns({"word_from": F.expr(f"greatest(at, {low}) - at"),
                                "word_to": F.expr(f"least(at + size, {high}) - at")})
             .where("word_to > word_from").select("row", "nth", "block", "word_from", "word_to"))
    reads = schedule(goal.where("source_size > 0").select("nth", "quota", "blocks"))
    takes = parts.join(reads, ["nth", "block"]).select("row", "pass", "slot", "word_from", "word_to")
    return docs.drop("deal", "bin", "blocks", "quota"), takes


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents that the mix reads: a row of ``docs`` for each pass over one, cut to the words read.

    A pass reads the blocks of a source in their order, so the words that it takes of a document are a
    run of words; a document that is read in part is cut there, and its words are joined by one space."""
    held = numbered(docs)
    sizes = sized(held.select("row", *[F.col("doc").getField(c).alias(n) for c, n in ((key, "key"), (source, "source"), (text, "text"))]),
                  "key", "source", "text", F.col("row"))
    _, takes = mix(sizes)
    reads = takes.groupBy("row", "pass").agg(F.min("word_from").alias("from"), F.max("word_to").alias("to"))
    reads = written(reads, "reads")
    words = F.regexp_extract_all(F.col(f"doc.`{text}`"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, F.col("from") + 1, F.col("to") - F.col("from")), " ")
    whole = (F.col("from") == 0) & (F.col("to") == words_column(f"doc.`{text}`"))
    # a row a pass over a document: small beside the texts, which stay where they are if it may be broadcast
    out = held.join(checked_broadcast(reads), "row").withColumn("read", F.when(whole, F.col(f"doc.`{text}`")).otherwise(cut))
    return out.select(*[F.col("read").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all ``documents`` takes."""
    docs, takes = mix(sized(table(spark, sf_dir, "documents")))
    taken = takes.groupBy("row").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    return (docs.join(taken, "row", "left")
            .select(F.col("key").alias("doc_id"), "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


OP9_SQL = r"""
with docs as (
  select doc_id, source, row_number() over () as line,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
per as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as nth
  from docs group by source),
weighed as (
  select *, case nth % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
         3.0::double * source_size as cap from per),
levels as (
  select *, (sum(source_size) over ()::double - coalesce(sum(cap) over before, 0.0::double))
            / (sum(weight) over () - coalesce(sum(weight) over before, 0.0::double)) as level
  from weighed
  window before as (order by cap / weight, nth rows between unbounded preceding and 1 preceding)),
goals as (
  select source, source_size, nth, least(cap, weight * max(level) over ()) as target from levels),
plan as (
  select *, ceil(source_size / 64.0::double)::bigint as blocks,
         case when source_size > 0 then
           least(floor(target / source_size * ceil(source_size / 64.0::double) + 0.5)::bigint,
                 ceil(source_size / 64.0::double)::bigint * 3) end as quota
  from goals),
stream as (
  select d.line, p.nth, d.size, p.source_size, p.blocks,
         sum(d.size) over (partition by p.nth order by md5(d.doc_id::varchar), d.line) - d.size as begins
  from docs d join plan p on d.source is not distinct from p.source where d.size > 0),
parts as (
  select line, nth, block,
         least(begins + size, ((block + 1) * source_size + blocks - 1) // blocks)
           - greatest(begins, (block * source_size + blocks - 1) // blocks) as words
  from (select *, unnest(range((begins * blocks // source_size)::bigint,
                               least((begins + size) * blocks // source_size, blocks - 1)::bigint + 1)) as block
        from stream)),
ends as (
  select nth, quota, blocks, sum(quota) over (order by nth) / (sum(quota) over ())::double as high
  from plan where quota is not null),
bounds as (select *, coalesce(lag(high) over (order by nth), 0.0::double) as low from ends),
slots as (
  select slot, slot * 0.6180339887498949::double - floor(slot * 0.6180339887498949::double) as u
  from range((select coalesce(sum(quota), 0)::bigint from plan)) r(slot)),
ranked as (
  select b.nth, row_number() over (partition by b.nth order by s.slot) - 1 as rank
  from slots s join bounds b on s.u >= b.low and s.u < b.high),
lacking as (
  select p.nth, unnest(range(coalesce(c.n, 0)::bigint, p.quota)) as rank
  from plan p left join (select nth, count(*) as n from ranked group by nth) c using (nth)
  where p.quota is not null),
reads as (
  select p.nth, r.rank % p.blocks as block, count(*) as times
  from (select * from ranked union all select * from lacking) r join plan p using (nth)
  where r.rank < p.quota group by all),
taken as (select line, sum(words * times) as taken from parts join reads using (nth, block) where words > 0 group by line)
select d.doc_id, d.size, p.source_size, p.target, coalesce(t.taken, 0)::bigint as taken
from docs d join plan p on d.source is not distinct from p.source left join taken t using (line)
"""
