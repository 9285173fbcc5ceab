"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

import uuid
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, scratch, table, written

#: Query vectors of a block on average, and vectors that are multiplied at once.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 512


def _product(q: np.ndarray, x: np.ndarray, wide: bool) -> np.ndarray:
    """Exact integer products: by floating point where it can't round, and by Python's numbers where 64 bits may not hold them."""
    if q.size and x.size and float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * q.shape[1] < 2**53:
        return np.rint(q.astype(float) @ x.astype(float).T).astype(object if wide else np.int64)
    return q.astype(object) @ x.astype(object).T if wide else q @ x.T


def _padded(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scaled(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component. Rows whose id or vector is null, or that hold a null, NaN or
    infinite component, are left out. A component whose floor no long holds is an error."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        "vec_id", F.transform(F.col("x"), lambda c: F.floor(F.when(F.abs(c * scale) < 2.0**63, c * scale).otherwise(F.raise_error(F.lit("a component that no long holds")).cast("double")))).alias("v")
    )


def top_k(vectors: DataFrame, is_query, k: int = 10, lists: int = 2, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every row (vec_id, v) where is_query holds with
    all rows but those of its own id, ties to the smaller vec_id; all, if there are fewer.

    The components are cut into `lists` runs; each is one list of partial scores, spread over the cluster in pieces. For
    a block of queries at a time: (1) every list names its k + 1 highest partial scores of each query, and the exact
    totals of what they name give a cutoff that the answer can't fall below; (2) the cutoff t is sent out, and every
    list returns all entries of at least t / lists - a total of t or more has one in some list; (3) what came from
    all lists is summed, the missing parts of the rest are computed, and totals below t go.

    Equal vectors are one class, with its k + 1 smallest ids: more can't be in an answer. Shorter vectors count as if
    padded with zeros. Queries of equal vectors are searched once. What a block has found is written before the next
    begins. Where components are so large that 64 bits may not hold a sum, sums are decimals of 38 digits; a score of an answer
    that no long holds is an error.
    """
    spark = vectors.sparkSession
    first = Window.partitionBy("v").orderBy("vec_id")
    vectors = written(vectors)
    few = vectors.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = written(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id()))
    asked = written(vectors.where(is_query).select("v", F.col("vec_id").alias("query_id")).distinct().join(classes.select("v", "cid"), "v").select("query_id", "cid"))
    most = classes.agg(F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    width, n_queries = max(most[0] or 0, 1), asked.select("cid").distinct().count()
    wide = max(most[1] or 0, -(most[2] or 0)) ** 2 * width >= 2**62
    number = "decimal(38,0)" if wide else "long"
    as_column = (lambda x: [Decimal(int(i)) for i in x]) if wide else (lambda x: x)
    step = -(-width // lists)
    parts = F.expr(f"inline(transform(sequence(0, {lists - 1}), p -> struct(p as part, slice(v, p * {step} + 1, {step}) as piece)))")
    slices = written(classes.select("cid", parts))
    n_blocks = max(1, -(-n_queries // block))
    searched = written(asked.select("cid").distinct().join(classes.select("cid", "v"), "cid").withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(n_blocks))))

    one = "cast(%s as decimal(19,0))" if wide else "%s"
    exact = F.expr(f"aggregate(zip_with(qv, v, (a, b) -> cast(coalesce({one % 'a'} * {one % 'b'}, 0) as {number})), cast(0 as {number}), (s, x) -> cast(s + x as {number}))")
    found_in = f"{scratch(spark)}/{uuid.uuid4().hex}"
    found_schema = f"q long, cid long, score {number}"
    spark.createDataFrame([], found_schema).write.parquet(found_in)
    for b in range(n_blocks):
        queries = searched.where(F.col("block") == b).select(F.col("cid").alias("q"), F.col("v").alias("qv"))
        rows = queries.collect()  # about `block` vectors
        if not rows:
            continue
        q_ids = np.array([r.q for r in rows], np.int64)
        whole = _padded([r.qv for r in rows], step * lists)
        shared = spark.sparkContext.broadcast((q_ids, [whole[:, p * step : (p + 1) * step] for p in range(lists)]))

        def highest(batches, shared=shared):
            q_ids, pieces = shared.value
            best = {}  # part -> ids and scores of the best so far, by query
            for part, ids, scores in _products(batches, pieces, step, wide):
                ids = np.broadcast_to(ids, scores.shape)
                if part in best:
                    ids, scores = np.hstack([best[part][0], ids]), np.hstack([best[part][1], scores])
                if scores.shape[1] > k + 1:
                    top = np.argpartition(scores, -(k + 1), axis=1)[:, -(k + 1) :]
                    ids, scores = np.take_along_axis(ids, top, 1), np.take_along_axis(scores, top, 1)
                best[part] = ids, scores
            for part, (ids, scores) in best.items():
                n = ids.shape[1]
                yield pd.DataFrame({"q": np.repeat(q_ids, n), "part": part, "cid": ids.ravel(), "score": as_column(scores.ravel())})

        entry = f"q long, part int, cid long, score {number}"
        leaders = Window.partitionBy("q", "part").orderBy(F.desc("score"), "cid")
        named = slices.mapInPandas(highest, entry).withColumn("n", F.row_number().over(leaders)).where(F.col("n") <= k + 1).select("q", "cid").distinct()
        totals = named.join(classes.select("cid", "v"), "cid").join(queries, "q").select("q", "cid", exact.alias("score"))
        ranked = totals.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"))))
        cutoffs = {q: int(t) for q, t in ranked.where(F.col("n") == k + 1).select("q", "score").collect()}
        least = spark.sparkContext.broadcast(np.array([cutoffs.get(q, -(10**37) if wide else -(2**62)) for q in q_ids.tolist()], object if wide else np.int64))

        def sufficient(batches, shared=shared, least=least):
            q_ids, pieces = shared.value
            floor = -(-least.value // lists)[:, None]  # in whole numbers, part * lists >= t
            for part, ids, scores in _products(batches, pieces, step, wide):
                i, j = np.nonzero(scores >= floor)
                yield pd.DataFrame({"q": q_ids[i], "part": part, "cid": ids[j], "score": as_column(scores[i, j])})

        came = slices.mapInPandas(sufficient, entry).groupBy("q", "cid").agg(F.sum("score").cast(number).alias("sum"), F.count("*").alias("n"))
        came = written(came)
        summed = came.where(F.col("n") == lists).select("q", "cid", F.col("sum").alias("score"))
        rest = came.where(F.col("n") < lists).join(classes.select("cid", "v"), "cid").join(queries, "q").select("q", "cid", exact.alias("score"))
        cut = spark.createDataFrame([(q, Decimal(t) if wide else t) for q, t in cutoffs.items()], f"q long, least {number}")
        found = summed.unionByName(rest).join(F.broadcast(cut), "q", "left").where("least is null or score >= least").select("q", "cid", "score")
        found.write.mode("append").parquet(found_in)
        drop_written(came)
    out = spark.read.schema(found_schema).parquet(found_in)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ids = out.join(classes.select("cid", "ids"), "cid").select("q", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    own = asked.withColumnRenamed("cid", "q").join(written(ids.drop("n")), "q").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def _products(batches, pieces: list[np.ndarray], step: int, wide: bool):
    for b in batches:
        for part, group in b.groupby("part"):
            for i in range(0, len(group), VECTOR_BLOCK):
                some = group.iloc[i : i + VECTOR_BLOCK]
                yield int(part), some["cid"].to_numpy(np.int64), _product(pieces[int(part)], _padded(some["piece"].tolist(), step), wide)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(scaled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
