"""Longest-processing-time sharding of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written


def lpt_turns(loads: list[int], size: int, count: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """How a heap of loads deals out `count` items of one size: turns, and the loads after.

    Turns are (first item, shards): from that item on the shards take items in this order, over and over. A shard of
    load l takes its items at loads l, l + size, ..., and the heap pops them in the order of (load, shard). Each stretch
    [r * size, (r + 1) * size) holds one of them for every shard with l // size <= r, so the order only changes where
    another shard joins: there are at most as many turns as shards, whatever the count.
    """
    joins = sorted({load // size for load in loads})
    turns, dealt = [], 0
    for k, level in enumerate(joins):
        members = [j for _, j in sorted((load % size, j) for j, load in enumerate(loads) if load // size <= level)]
        turns.append((dealt, members))
        span = (joins[k + 1] - level) * len(members) if k + 1 < len(joins) else count - dealt
        take = min(span, count - dealt)
        each, over = divmod(take, len(members))
        for i, j in enumerate(members):
            loads[j] += size * (each + (i < over))
        dealt += take
        if dealt >= count:
            break
    return turns, loads


def lpt_reference(sizes: list[int], shards: int) -> list[int]:
    """The plain heap over sizes in the given (descending) order: shard of each."""
    heap = [(0, j) for j in range(shards)]
    out = []
    for s in sizes:
        load, j = heapq.heappop(heap)
        out.append(j)
        heapq.heappush(heap, (load + s, j))
    return out


def shard_rows(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row with its shard and its slot there: doc_id, size, text_crc32, shard, slot.

    Rows of equal text form a group, which one shard takes whole; a null text counts as a group of its own (size 1 a
    row). Groups go by total size, largest first (ties: by digest), to the shard of the least load. Only the counts of
    groups by size reach the driver, read in order through an iterator; there the heap deals out each size in one step.
    Rows that repeat a doc_id are rows of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("none")).alias("digest"),
    )
    rows = written(rows)
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("total")))
    loads, turns = [0] * shards, []
    for total, count in groups.groupBy("total").count().orderBy(F.desc("total")).toLocalIterator():
        steps, loads = lpt_turns(loads, total, count)
        ends = [first for first, _ in steps[1:]] + [count]
        turns += [(total, first, end, members) for (first, members), end in zip(steps, ends)]
    schema = T.StructType([T.StructField("total", T.LongType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("members", T.ArrayType(T.IntegerType()))])
    turns = spark.createDataFrame(turns, schema)

    # The place of a group among those of its size: a sorted table in pieces, the pieces' counts, and the place in its piece.
    dealt = written(groups.repartitionByRange(F.desc("total"), F.col("digest")).withColumn("piece", F.spark_partition_id()))
    before = Window.partitionBy("total").orderBy("piece")
    pieces = dealt.groupBy("total", "piece").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(before) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("piece", "total").orderBy("digest")) - 1
    placed = dealt.withColumn("place", place).join(pieces, ["total", "piece"]).withColumn("place", F.col("place") + F.col("base"))
    at = F.expr("members[cast((place - first) % size(members) as int)]")
    homes = placed.join(turns, "total").where("place >= first and place < end").select("digest", at.alias("shard"))

    # Slots: a running count in each piece of each shard, after the counts of the pieces before it.
    put = written(rows.join(homes, "digest").select("doc_id", "size", "text_crc32", "shard").withColumn("piece", F.spark_partition_id()))
    before = Window.partitionBy("shard").orderBy("piece")
    pieces = put.groupBy("shard", "piece").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(before) - F.col("n")).drop("n")
    slot = F.row_number().over(Window.partitionBy("piece", "shard").orderBy("doc_id", "text_crc32")) - 1
    return put.withColumn("slot", slot).join(pieces, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("base")).cast("long").alias("slot")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
