"""Mixing sources to target weights by systematic sampling.

Every document of a source is worth the same expected number of copies; their prefix sum
within the source, plus one random offset for the source, crosses an integer boundary once
for each copy that the mix takes. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"
#: Random offsets tried for each source; the one that meets the target best is used.
OFFSETS = 32


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(key, source_size, target) from a table of ``source`` and ``size``.

    Sources in code point order, null last, take the weights in turn and share ``share``
    times all sizes; a target stops at ``most`` times its source's size and the excess goes
    to the others by weight. With sources sorted by the ratio at which they stop, that is
    one pass of running sums over the (short) table of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("double"))
    everything = Window.partitionBy()
    per = per.withColumn("ratio", most * F.col("source_size") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (share * F.sum("source_size").over(everything) - most * before) / left)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return per.select(_source_key(F.col("source")).alias("key"), "source_size", F.least(most * F.col("source_size"), F.coalesce(level, F.lit(0.0)) * F.col("w")).alias("target"))


def _ranked(scratch: Scratch, sizes: DataFrame) -> DataFrame:
    """``rank`` of each row within its source, by size, then a hash of the id.

    Rows are range partitioned by source and order, so a large source spans many tasks;
    each task ranks its part, and the counts of the parts before it are added.
    """
    spread = sizes.repartitionByRange("key", "size", "hash", "doc", "row").withColumn("part", F.spark_partition_id())
    spread = scratch.stored(spread, "ranges")
    counts = spread.groupBy("key", "part").agg(F.count("*").alias("c"))
    before = counts.select("key", "part", F.coalesce(F.sum("c").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy("size", "hash", "doc", "row"))
    return spread.withColumn("own", own).join(before, ["key", "part"]).withColumn("rank", F.col("own") + F.col("before"))


def _copies(rank: Column, each: Column, offset: Column) -> Column:
    return (F.floor(rank * each + offset) - F.floor((rank - 1) * each + offset)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``; a size is a word count.

    Documents stand in order of size, so that neighbours in the prefix sum are alike and a
    source's words come near its target; of ``OFFSETS`` equally spaced offsets, turned by a
    hash of the source, the nearest is used. Reruns give the same mix. Null or wordless
    texts have size 0; rows repeating an id are documents of their own (those equal in id,
    source and text share a ``row``, and which of them is taken makes no difference); null
    sources are one source. A source of size 0 has target 0; an empty table gives no rows.
    Other columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        own_id = F.xxhash64(*[F.col(c) for c in (id_col, source_col, text_col)])
        sizes = docs.select(F.col(id_col).alias("doc"), own_id.alias("row"), F.col(source_col).alias("source"), size.alias("size"))
        sizes = scratch.stored(sizes.withColumn("key", _source_key(F.col("source"))).withColumn("hash", F.md5(F.coalesce(F.col("doc").cast("string"), F.lit("")).cast("binary"))), "sizes")
        goal = scratch.stored(targets(sizes.select("source", "size"), weights, share, most), "targets")
        each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        ranked = _ranked(scratch, sizes).join(goal, "key").withColumn("each", each)
        ranked = scratch.stored(ranked.select("key", "doc", "row", "size", "rank", "each", "source_size", "target"), "ranked")
        turn = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        offsets = [(turn + F.lit(float(j)) / F.lit(float(OFFSETS))) % F.lit(1.0) for j in range(OFFSETS)]
        words = [F.sum(F.col("size") * _copies(F.col("rank"), F.col("each"), x)).alias(f"w{j}") for j, x in enumerate(offsets)]
        sums = ranked.groupBy("key").agg(F.first("target").alias("target"), *words)
        best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{j}") - F.col("target")).alias("miss"), F.lit(j).alias("j"), x.alias("offset")) for j, x in enumerate(offsets)]))
        chosen = ranked.join(sums.select("key", best["offset"].alias("offset")), "key")
        copies = _copies(F.col("rank"), F.col("each"), F.col("offset")).alias("copies")
        return scratch.result(chosen.select(F.col("doc").alias(id_col), "row", "size", "source_size", "target", copies), "mix")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, key, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source, key
), r AS (
  SELECT *, 2.0e0 * source_size / w AS ratio FROM s
), l AS (
  SELECT *, (1.5e0 * (sum(source_size) OVER ())::DOUBLE - 2.0e0 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), g AS (
  SELECT key, source_size, least(2.0e0 * source_size, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 0.0e0) * w) AS target FROM l
), k AS (
  SELECT d.doc_id, d.size, d.key, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0e0 END AS each,
         row_number() OVER (PARTITION BY d.key ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id)::DOUBLE AS rank
  FROM d JOIN g USING (key)
), o AS (
  SELECT key, j, ((('0x' || substr(md5(key), 1, 8))::BIGINT::DOUBLE / 4294967296.0e0) + j / {OFFSETS}.0e0) % 1.0e0 AS off
  FROM g, range({OFFSETS}) t(j)
), m AS (
  SELECT k.key, o.j, o.off, abs(sum(size * (floor(rank * each + off) - floor((rank - 1) * each + off))) - any_value(target)) AS miss
  FROM k JOIN o USING (key) GROUP BY k.key, o.j, o.off
), b AS (
  SELECT key, arg_min(off, (miss, j)) AS off FROM m GROUP BY key
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rank * each + off) - floor((rank - 1) * each + off)))::BIGINT AS taken
FROM k JOIN b USING (key)
"""
