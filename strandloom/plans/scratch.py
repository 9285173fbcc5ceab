"""Tables between stages: written to the shared folder, so that lineage is cut and no executor's loss is felt."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset and one machine does all the work, as in tests.
OWN_CHECKPOINT_DIR = "/tmp/checkpoints"
_KNOWN: set[str] = set()


def folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = OWN_CHECKPOINT_DIR
    root = f"{base.rstrip('/')}/stages-{sc.applicationId}"
    if root not in _KNOWN:
        _KNOWN.add(root)
        atexit.register(remove, sc._jvm, sc._jsc.hadoopConfiguration(), root)
    return root


def remove(jvm, conf, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the JVM may be gone already; the folder is only scratch
        pass


def written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Grown:
    """A table that is added to: parts go below one folder, so that reading it stays one scan however many there are."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema, self.parts = spark, f"{folder(spark)}/{uuid.uuid4().hex}", None, 0

    def add(self, df: DataFrame) -> DataFrame:
        """Writes df and returns it as it is read from there."""
        path = f"{self.path}/{self.parts}"
        df.write.option("compression", "zstd").parquet(path)
        self.schema, self.parts = df.schema, self.parts + 1
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
