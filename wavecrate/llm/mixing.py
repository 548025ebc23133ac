"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot i of the schedule is the golden-ratio point frac(i * phi), kept as a 47-bit integer. It falls into one source's part
of the cumulative weights; its rank among that source's slots names the block to take. A source's documents, in the
order of md5(seed, doc_id), form one stream of words cut into blocks of equal size; rank r takes block r modulo the
number of blocks, so a source is repeated evenly and never more than twice. A source plays exactly its quota of slots:
points are made for twice as many slots as all quotas together, and ranks beyond a quota are left out. Any n golden-ratio
points leave no gap of 2 / n, so each part of the weights that a quota stands for holds a point and no source is short,
however small it is.

Hot sources: ranks and running word counts are prefix sums in two steps (within small ranges of slots or hash ranges of
documents, then over the ranges), so no task holds a whole source.

Defined results: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own,
last in order; repeated rows are separate documents; an empty table gives an empty result; rows whose doc_id is null
come last in their source, by size. Extra columns are ignored. Of rows that share a doc_id, mixed_documents() repeats
each as its own words were taken; rows that are equal in all columns stand for one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrate.llm.common import materialise, table

BLOCK_WORDS = 64  # words of a block, and so of a slot
SHARE, MOST_REPEATS, CYCLE = 1.5, 2, (3, 1, 2)
SLOT_RANGE = 8_192  # slots ranked together
BITS, GOLDEN = 47, 86_980_551_294_885  # 2**47 / golden ratio, odd
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def golden_point(i: Column) -> Column:
    """i * GOLDEN modulo 2**BITS without overflow, for i under 2**BITS."""
    part = lambda shift: F.shiftright(i, shift).bitwiseAND(F.lit(65_535)) * F.lit(GOLDEN)
    rest = lambda x, shift: x.bitwiseAND(F.lit((1 << BITS - shift) - 1)) * F.lit(1 << shift)
    return (part(0).bitwiseAND(F.lit((1 << BITS) - 1)) + rest(part(16), 16) + rest(part(32), 32)).bitwiseAND(F.lit((1 << BITS) - 1))


def source_targets(sizes: DataFrame) -> DataFrame:
    """A row per source: sid, source, source_size, target, quota (slots) and n_blocks.

    The water level is found in closed form: sources in order of the level at which they reach their cap; the first
    whose own cap isn't reached by the level of all that remain fixes the level. One row per source is sorted in one
    task; the documents themselves are aggregated first.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in CYCLE]), ((F.col("sid") - 1) % len(CYCLE) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(MOST_REPEATS)))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / free)
    open_level = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))
    ranked = ranked.withColumn("level", F.max(open_level).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.withColumn("target", target).select(
        "sid", "source", "source_size", "target", F.ceil(F.col("target") / BLOCK_WORDS).alias("quota"), F.ceil(F.col("source_size") / BLOCK_WORDS).alias("n_blocks")
    )


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """The slots that are played: slot (ascending in the order of play), sid, rank among the source's slots, and block."""
    spark = sources.sparkSession
    upto = F.sum("quota").over(Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    edge = lambda c: F.expr(f"(cast({c} as decimal(20, 0)) * {1 << BITS}BD) div cast({max(slots, 1)} as decimal(20, 0))")
    parts = sources.filter("quota > 0").withColumn("upto", upto).withColumn("lo", edge("upto - quota")).withColumn("hi", edge("upto"))
    # Cells of equal width turn the range join into an equi-join that no wide source can skew.
    cell = lambda c: F.shiftright(c, BITS - 12)
    cells = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1)))).select("cell", "lo", "hi", "sid", "quota", "n_blocks")
    points = spark.range(2 * slots).withColumn("u", golden_point(F.col("id"))).withColumn("cell", cell(F.col("u")))
    hit = points.join(cells, (points["cell"] == cells["cell"]) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    hit = hit.select("id", F.expr(f"id div {SLOT_RANGE}").alias("span"), "sid", "quota", "n_blocks")
    base = hit.groupBy("sid", "span").agg(F.count("*").alias("n"))
    base = base.select("sid", "span", (F.sum("n").over(Window.partitionBy("sid").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("sid", "span").orderBy("id")) - 1 + F.col("base")
    ranked = hit.join(base, ["sid", "span"]).withColumn("rank", rank).filter("rank < quota")
    return ranked.select(F.col("id").alias("slot"), "sid", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"))


def measured(docs: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame, int]:
    """doc_id, source and size of every row (and more columns), the sources, and the number of slots."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialise(docs.select("doc_id", "source", size.alias("size"), *more), "sizes")
    sources = materialise(source_targets(sizes), "sources")
    return sizes, sources, sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).cast("long")).first()[0]  # one number


def block_schedule(docs: DataFrame) -> DataFrame:
    """The mix as an order of play: slot (ascending, with gaps), source, rank and block of each slot that is played."""
    _, sources, slots = measured(docs)
    return schedule(sources, slots).join(sources.select("sid", "source"), "sid").select("slot", "source", "rank", "block")


def mix(docs: DataFrame, spread_digits: int = 3, key: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot, last_slot. spread_digits: 16**n hash ranges a source.

    The slots are where the schedule first and last plays a block with words of the document; null if it never does.

    key: a column that tells rows apart, returned as `key`; it also orders rows that share a doc_id and size.
    """
    named = [] if key is None else ["key"]
    sizes, sources, slots = measured(docs, *([] if key is None else [key.alias("key")]))
    rows = sizes.withColumn("__md5", F.when(F.col("doc_id").isNotNull(), F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string")).cast("binary"))))
    # Rows without an id come after all hexadecimal ranges, in ranges of their sizes.
    rows = rows.withColumn("range", F.coalesce(F.substring("__md5", 1, spread_digits), F.concat(F.lit("~"), F.lpad(F.col("size").cast("string"), 20, "0"))))
    rows = rows.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")
    ranges = rows.groupBy("sid", "range").agg(F.sum("size").alias("n"))
    ranges = ranges.select("sid", "range", (F.sum("n").over(Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    running = F.sum("size").over(Window.partitionBy("sid", "range").orderBy("__md5", "doc_id", "size", *named).rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.filter("size > 0").join(ranges, ["sid", "range"]).withColumn("stop", running + F.col("base")).withColumn("start", F.col("stop") - F.col("size"))
    first, last = F.expr(f"start div {BLOCK_WORDS}"), F.expr(f"(stop - 1) div {BLOCK_WORDS}")
    own = ["sid", "start", "doc_id", "size", "source_size", "target", *named]
    spans = placed.withColumn("block", F.explode(F.sequence(first, last))).select(*own, "stop", "block")
    spans = spans.withColumn("overlap", F.least(F.col("stop"), (F.col("block") + 1) * BLOCK_WORDS) - F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS))
    times = schedule(sources, slots).groupBy("sid", "block").agg(F.count("*").alias("times"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    played = spans.join(times, ["sid", "block"], "left")
    words = F.sum(F.col("overlap") * F.coalesce(F.col("times"), F.lit(0))).cast("long")
    taken = played.groupBy(*own).agg(words.alias("taken"), F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot"))
    out = ["doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot", *named]
    none = rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*out).unionByName(none.select(*out[:5], *[F.lit(None).cast("long").alias(c) for c in out[5:7]], *named))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs after mixing: each document as often as its words were taken, to the nearest whole number (0, 1 or 2)."""
    row = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("long")
    times = mix(docs, key=row).withColumn("copies", copies).groupBy("doc_id", "key").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__n"))
    times = materialise(times.filter("__copies > 0").withColumnRenamed("doc_id", "__id").withColumnRenamed("key", "__key"), "copies")
    marked = docs.withColumn("__own", row)
    both = marked.join(times, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")))
    alone = both.filter("__n = 1").select(*docs.columns, "__copies")
    if not times.filter("__n > 1").isEmpty():  # equal rows: one of them stands for all
        one = both.filter("__n > 1").groupBy("__id", "__key").agg(F.first(F.struct(*docs.columns)).alias("__row"), F.first("__copies").alias("__copies"))
        alone = alone.unionByName(one.select("__row.*", "__copies"))
    return alone.withColumn("__copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op10_mixing": op10_mixing}

#: DuckDB: the same schedule with plain windows, over twice as many points as slots, so that every source plays its quota. u is exact in 128-bit integers.
ORACLE = {
    "op10_mixing": rf"""
        WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END AS size FROM documents),
        t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM t),
        w AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
        v AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lv FROM w
              WINDOW b AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT max(CASE WHEN cap / weight >= lv THEN lv END) AS level FROM v),
        s AS (SELECT sid, source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM v, l),
        q AS (SELECT *, CAST(ceil(target / {BLOCK_WORDS}) AS BIGINT) AS quota, CAST(ceil(source_size / {BLOCK_WORDS}::DOUBLE) AS BIGINT) AS n_blocks FROM s),
        e AS (SELECT *, sum(quota) OVER (ORDER BY sid)::HUGEINT AS upto, sum(quota) OVER ()::HUGEINT AS slots FROM q),
        p AS (SELECT sid, quota, n_blocks, ((upto - quota) * {1 << BITS}) // slots AS lo, (upto * {1 << BITS}) // slots AS hi FROM e WHERE quota > 0),
        g AS (SELECT i, (i::HUGEINT * {GOLDEN}) % {1 << BITS} AS u FROM (SELECT unnest(range((SELECT 2 * CAST(coalesce(sum(quota), 0) AS BIGINT) FROM q))) AS i)),
        h AS (SELECT g.i, p.*, row_number() OVER (PARTITION BY p.sid ORDER BY g.i) - 1 AS rnk FROM g JOIN p ON g.u >= p.lo AND g.u < p.hi),
        y AS (SELECT sid, rnk % n_blocks AS block, count(*) AS times, min(i) AS first_slot, max(i) AS last_slot FROM h WHERE rnk < quota GROUP BY ALL),
        o AS (SELECT d.doc_id, d.size, q.sid, q.source_size, q.target, row_number() OVER () AS own,
                     CAST(sum(d.size) OVER (PARTITION BY q.sid ORDER BY md5('{SEED}:' || d.doc_id), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
              FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
        x AS (SELECT *, unnest(CASE WHEN size > 0 THEN range((stop - size) // {BLOCK_WORDS}, (stop - 1) // {BLOCK_WORDS} + 1) ELSE [-1] END) AS block FROM o)
        SELECT x.doc_id, CAST(x.size AS BIGINT) AS size, x.source_size, x.target,
               CAST(sum(CASE WHEN x.block < 0 THEN 0 ELSE (least(x.stop, (x.block + 1) * {BLOCK_WORDS}) - greatest(x.stop - x.size, x.block * {BLOCK_WORDS})) * coalesce(y.times, 0) END) AS BIGINT) AS taken,
               min(y.first_slot)::BIGINT AS first_slot, max(y.last_slot)::BIGINT AS last_slot
        FROM x LEFT JOIN y ON x.sid = y.sid AND x.block = y.block
        GROUP BY x.own, x.doc_id, x.size, x.source_size, x.target
    """
}
