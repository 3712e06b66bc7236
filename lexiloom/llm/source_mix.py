"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. One scan counts the words of every document; the text is dropped and the sizes are written to the shared folder.
2. Sources get targets: weights 1, 2, 3, repeating in order of the source, share all words. A target stops at
   ``most`` times the size of its source; the excess goes to the others by weight. Only the common level (words for
   a unit of weight) and two sums reach the driver, once a round.
3. Each source is cut into shards of about ``rows_per_shard`` documents, so a hot source is many shards. A shard's
   claim is its part of the source's target. Blocks of ``block`` words are given to shards one by one to the highest
   quotient claim / (2 s + 1), s being the blocks it has: the number of quotients above a level is summed over the
   shards for many levels at once, and the level is narrowed until it yields the wanted number of blocks. Equal
   quotients at the level are settled in order of source and shard.
4. In a shard, documents are laid end to end in seeded order. A quota is whole passes over the shard and, for the
   rest, a run of blocks from a seeded block on, around the end. A document's share is its overlap with that run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import ranked, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)


def hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def water_level(sources: DataFrame, most: int) -> float:
    """Words for a unit of weight, so that targets of at most ``most`` sizes add up to all words."""
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    level, before = total / weights, None
    while level != before:
        before = level
        above = F.col("weight") * F.lit(level) > most * F.col("source_size")
        capped, rest = sources.agg(F.sum(F.when(above, most * F.col("source_size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        level = (total - capped) / rest if rest else level
    return level


def apportion(cells: DataFrame, blocks: int, *order: str) -> DataFrame:
    """``cells`` with ``seats``: ``blocks`` seats given by highest quotients of ``claim``, ties in ``order``."""
    seats = lambda level: F.floor(F.col("claim") / F.lit(level) + 0.5)
    top = cells.agg(F.max("claim"), F.sum("claim")).first()
    if not blocks or not top[0]:
        return cells.withColumn("seats", F.lit(0).cast("long"))
    high, low = 4.0 * top[0], 0.5 * top[1] / (blocks + cells.count())  # none at high; enough at low
    while True:
        steps = [low + (high - low) * k / 32 for k in range(1, 32)]
        steps = sorted({s for s in steps if low < s < high})
        if not steps:
            break
        got = cells.agg(*[F.sum(seats(s)).alias(f"s{k}") for k, s in enumerate(steps)]).first()
        if exact := [s for s, n in zip(steps, got, strict=True) if n == blocks]:
            return cells.withColumn("seats", seats(exact[0]).cast("long"))
        low = max([low, *(s for s, n in zip(steps, got, strict=True) if n > blocks)])
        high = min([high, *(s for s, n in zip(steps, got, strict=True) if n < blocks)])
    given = cells.withColumn("seats", seats(high).cast("long"))
    tied = F.col("seats") < seats(low)
    left = blocks - given.agg(F.sum("seats")).first()[0]
    lucky = ranked(given.where(tied).select(*order), *order, name="_tie").where(F.col("_tie") < left).withColumn("_one", F.lit(1))
    return given.join(lucky.drop("_tie"), list(order), "left").withColumn("seats", F.col("seats") + F.coalesce("_one", F.lit(0))).drop("_one")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, block: int = 64, rows_per_shard: int = 512, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, shard, taken, copies, parts.

    ``copies`` is how often the whole document is taken, ``parts`` (array of struct(first, last), word positions, end
    exclusive) what is taken once more. Null text has size 0, null sources are one source and come last; a null id is
    like an empty one. Rows that repeat an id are separate documents. An empty table, or one without words, gives
    targets and takes of 0. Other columns of ``docs`` are ignored.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    draw = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sizes = written(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), key.alias("_key"), F.md5(draw).alias("_draw"), hash32(draw).alias("_hash"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size")), "sizes")

    sources = sizes.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = ranked(sources, (F.col("_key") == "").asc(), F.col("_key").asc(), name="_order")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_order") % len(WEIGHTS) + 1).cast("int"))
    sources = written(sources.withColumn("weight", weight).withColumn("_shards", F.ceil(F.col("_rows") / rows_per_shard)), "sources")
    level = water_level(sources, most)
    target = F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double"))
    sources = sources.withColumn("target", target)

    sharded = sizes.join(sources.select("_key", "_order", "source_size", "target", "_shards"), "_key").withColumn("shard", (F.col("_hash") % F.col("_shards")).cast("int"))
    cells = sharded.groupBy("_key", "_order", "shard").agg(F.sum("size").alias("cell_size"), F.first("target").alias("_target"), F.first("source_size").alias("_source_size"))
    claim = F.when(F.col("_source_size") > 0, F.col("_target") * F.col("cell_size") / F.col("_source_size")).otherwise(0.0)
    cells = written(cells.withColumn("claim", claim), "cells")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cells_with = apportion(cells, round(total / block), "_order", "shard")

    take = F.least(F.col("seats") * block, most * F.col("cell_size"))
    size = F.greatest(F.col("cell_size"), F.lit(1))
    start = block * (hash32(F.concat_ws(":", F.lit(seed), "_order", "shard")) % F.ceil(size / block))
    cells_with = cells_with.withColumn("_take", take).select("_key", "shard", "cell_size", F.expr("_take div greatest(cell_size, 1)").alias("copies"), (F.col("_take") % size).alias("_rest"), start.alias("_start"))

    before = F.sum("size").over(Window.partitionBy("_key", "shard").orderBy("_draw", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = sharded.withColumn("_at", before).join(cells_with, ["_key", "shard"])

    def part(first: Column, last: Column) -> Column:
        a = F.greatest(first - F.col("_at"), F.lit(0))
        b = F.least(last - F.col("_at"), F.col("size"))
        return F.struct(a.cast("long").alias("first"), F.greatest(a, b).cast("long").alias("last"))

    end = F.col("_start") + F.col("_rest")
    parts = F.filter(F.array(part(F.col("_start"), F.least(end, F.col("cell_size"))), part(F.lit(0), end - F.col("cell_size"))), lambda x: x["last"] > x["first"])
    taken = F.col("copies") * F.col("size") + F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return placed.withColumn("parts", parts).select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", "shard", taken.cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"), "parts")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS draw, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, ceil(count(*) / 512.0)::BIGINT AS shards, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS ord FROM sizes GROUP BY source),
w AS (SELECT *, ord % 3 + 1 AS weight, (SELECT sum(source_size) FROM src)::BIGINT AS total FROM src),
level AS (
  SELECT 0 AS i, (SELECT max(total) / sum(weight) FROM w)::DOUBLE AS v, -1::DOUBLE AS was
  UNION ALL
  SELECT i + 1, (SELECT (max(total) - coalesce(sum(3 * source_size) FILTER (weight * l.v > 3 * source_size), 0)) / sum(weight) FILTER (weight * l.v <= 3 * source_size) FROM w)::DOUBLE, v
  FROM level l WHERE v <> was),
t AS (SELECT w.*, least(weight * (SELECT v FROM level ORDER BY i DESC LIMIT 1), (3 * source_size)::DOUBLE) AS target FROM w),
d AS (SELECT s.*, t.ord, t.source_size, t.target, ('0x' || substr(draw, 1, 8))::BIGINT % t.shards AS shard FROM sizes s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
cell AS (SELECT ord, shard, sum(size)::BIGINT AS cell_size, any_value(target) AS target, any_value(source_size) AS source_size FROM d GROUP BY ALL),
claim AS (SELECT *, CASE WHEN source_size > 0 THEN target * cell_size / source_size ELSE 0 END AS claim FROM cell),
m AS (SELECT round_even((SELECT max(total) FROM w) / 64.0, 0)::BIGINT AS blocks),
q AS (SELECT ord, shard, claim / (s + 0.5) AS quotient FROM claim, unnest(range(0, ceil(claim / 64)::BIGINT + 3)) u(s) WHERE claim > 0),
won AS (SELECT ord, shard, count(*) AS seats FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, ord, shard) AS r FROM q) WHERE r <= (SELECT blocks FROM m) GROUP BY ALL),
c AS (SELECT cell.*, least(coalesce(seats, 0) * 64, 3 * cell_size)::BIGINT AS take, greatest(cell_size, 1) AS n,
             64 * (('0x' || substr(md5('mix:' || ord || ':' || shard), 1, 8))::BIGINT % ceil(greatest(cell_size, 1) / 64.0)::BIGINT) AS start
      FROM cell LEFT JOIN won USING (ord, shard)),
p AS (SELECT d.*, c.cell_size, c.take // c.n AS copies, c.start, c.start + c.take % c.n AS stop,
             (sum(size) OVER (PARTITION BY d.ord, d.shard ORDER BY draw, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS lead_words
      FROM d JOIN c USING (ord, shard))
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (copies * size + greatest(0, least(least(stop, cell_size) - lead_words, size) - greatest(start - lead_words, 0)) + greatest(0, least(stop - cell_size - lead_words, size) - greatest(-lead_words, 0)))::BIGINT AS taken
FROM p
"""
