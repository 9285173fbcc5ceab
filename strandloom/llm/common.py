"""What the operators of this subpackage share: tables, row keys, scratch tables, connected components.

A row's key is its doc_id where doc_ids are unique; it is the same whenever the row is read again, so that a lost executor
changes nothing. Where they are not, the rows are numbered once and written.
"""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset and one machine does all the work, as in tests.
OWN_CHECKPOINT_DIR = "/tmp/checkpoints"
_SCRATCH: set[str] = set()
#: Seconds between two releases of shuffle files, at least.
RELEASE_S = 5.0
_RELEASED = [0.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; it is deleted when the session's process ends."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = OWN_CHECKPOINT_DIR
    root = f"{base.rstrip('/')}/strandloom-{sc.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH.add(root)
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), root)
    return root


def _remove(jvm, conf, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the JVM may be gone already; the folder is only scratch
        pass


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if time.monotonic() - _RELEASED[0] > RELEASE_S:
        # what made the tables can go: its shuffle files stay until the driver's JVM has collected their owners
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _RELEASED[0] = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing reads any more."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if any(root.rpartition("/")[2] in f for root in _SCRATCH):
            sc = df.sparkSession.sparkContext
            _remove(sc._jvm, sc._jsc.hadoopConfiguration(), f)


def ordered(docs: DataFrame, rest: bool = False) -> DataFrame:
    """doc_id, text (null: empty), with rest a struct of all columns as they were, and key: a long of its own for every row,
    in the order of doc_id (nulls first) and, where rows share a doc_id, of the text's hash. Where doc_ids are unique, as
    they should be, they are the keys."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    docs = docs.select(*own, *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("rest")] * rest))
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("key", F.col("doc_id"))
    tie = F.xxhash64("text")
    pieces = written(docs.repartitionByRange(F.asc_nulls_first("doc_id"), tie).withColumn("piece", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("piece").orderBy(F.asc_nulls_first("doc_id"), tie))
    return written(pieces.withColumn("key", F.shiftleft(F.col("piece").cast("long"), 40) + place).drop("piece"))


def pieces(batch, rows: int = 512):
    """An Arrow batch in pieces of a few rows, so that a task holds few texts as Python strings at once."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def crc_mod(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; ids that are null count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) of longs: root is the smallest node it reaches.

    Alternating large and small stars: each round points every node's larger (smaller) neighbours at its smallest
    one, so that trees become stars in about log n rounds. The minimum of a node is a hash aggregate with a map-side
    part, and the join that brings it back is one that adaptive execution splits where a node has very many links.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop_written(now)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """That every larger end has one link, and is no link's smaller end: the smaller ends are then the roots."""
    ends = edges.selectExpr("stack(2, u, 1, v, 0) as (node, larger)")
    nodes = ends.groupBy("node").agg(F.sum("larger").alias("n"), F.min("larger").alias("least"))
    return nodes.where("n > 1 or n = 1 and least = 0").isEmpty()
