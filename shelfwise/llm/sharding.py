"""Sharding by proportional stratified interleaving.

Within each source the rows stand in a seeded random order, and a row's rank, divided by the
number of rows of its source, is its fractional rank. Sorted by fractional rank, every stretch of
the whole table has the mixture of sources that the table has; the shards are equal stretches.

Both ranks are taken without a window over a source: rows are range-partitioned and sorted, a
partition's rows are numbered as they stand, and the counts of the partitions before it, which
are a small table, are added. So one source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, written


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows in the global order, with part (its partition) and place (from 0 in the partition)."""
    at = F.monotonically_increasing_id()
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    return written(laid.select(*rows.columns, part.alias("part"), place.alias("place")), name)


def stratified_shards(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, text_crc32, fraction, shard, slot.

    Law: the shards' row counts are at most one apart. A shard's share of a source differs from
    the source's share of the table by a row or two. size is the text's bytes in UTF-8 plus 1; a
    null text counts as empty. A null source is a source of its own. Rows that are equal in
    everything stand in any order. Equal texts aren't kept together. slot runs from 0 in each
    shard without gaps. Other columns of docs aren't read. An empty table gives an empty result;
    with fewer rows than shards, some shards are empty.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"))
    ordered = _numbered(rows, ["source", "shuffled", "doc_id"], "by_source")

    runs = ordered.groupBy("source", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    of_source = Window.partitionBy("source")
    before = F.sum("n").over(of_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("source").alias("_source"), F.col("part").alias("_part"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(of_source).alias("of"))
    ranked = ordered.join(runs, ordered["source"].eqNullSafe(runs["_source"]) & (ordered["part"] == runs["_part"]))
    fraction: Column = (F.col("place") + F.col("shift") + 0.5) / F.col("of")
    ranked = ranked.select(*rows.columns, fraction.alias("fraction"))
    laid = _numbered(ranked, ["fraction", "shuffled", "source", "doc_id"], "by_fraction")

    counts = laid.groupBy("part").agg(F.count("*").alias("n"))
    whole = Window.orderBy("part")  # a row for each partition
    counts = counts.select("part", (F.sum("n").over(whole) - F.col("n")).alias("before"), F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    placed = laid.join(F.broadcast(counts), "part").withColumn("at", F.col("before") + F.col("place"))
    shard = F.expr(f"cast(at * {shards} div total as int)")
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", "fraction", "shard", (F.col("at") - start).alias("slot"))
