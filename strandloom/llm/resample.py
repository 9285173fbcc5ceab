"""Importance resampling towards a target's distribution of hashed words, over a sparse matrix of documents and buckets."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, table, written

BUCKETS = 10_000
#: ASCII letters (lower case) and digits, and everything that isn't ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of text and documents in a block of the matrix, at most (a longer text is a block by itself), and words remembered from text to text.
BLOCK_BYTES, BLOCK_DOCS, KEPT_WORDS = 4_000_000, 4096, 500_000
MATRIX = "doc_id array<long>, starts array<int>, buckets array<int>, counts array<int>"


class _Bucket(dict):
    def __missing__(self, word: bytes) -> int:
        b = self[word] = zlib.crc32(word) % BUCKETS
        return b


def _csr(ids: list, rows: list[np.ndarray]) -> pa.RecordBatch:
    """One block: starts has a row's first place in buckets and counts, which have its distinct buckets in order."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    cells, counts = np.unique(np.repeat(np.arange(len(rows)), sizes) * BUCKETS + np.concatenate(rows), return_counts=True)
    starts = np.searchsorted(cells, np.arange(len(rows) + 1) * BUCKETS)
    cols = [(ids, pa.int64()), (starts, pa.int32()), (cells % BUCKETS, pa.int32()), (counts, pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([c], pa.list_(t)) for c, t in cols], ["doc_id", "starts", "buckets", "counts"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of the matrix of rows (key and text), one at a time."""
    bucket, ids, found, size = _Bucket(), [], [], 0
    for b in (x for batch in batches for x in pieces(batch)):
        for i, t in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            if ids and (size + len(t) > BLOCK_BYTES or len(ids) == BLOCK_DOCS):
                yield _csr(ids, found)
                ids, found, size = [], [], 0
            ids.append(i)
            found.append(np.fromiter(map(bucket.__getitem__, WORD.findall(t.lower())), np.int64))  # bytes: A-Z only
            size += len(t)
            if len(bucket) > KEPT_WORDS:
                bucket.clear()
    if ids:
        yield _csr(ids, found)


def _texts(rows: DataFrame, key: str) -> DataFrame:
    return rows.selectExpr(f"cast({key} as long) key", "coalesce(cast(text as string), '') text")


def count_matrix(rows: DataFrame, key: str) -> DataFrame:
    """The matrix of rows (by key) and buckets of their words, as CSR blocks: a row of the result is a block."""
    return _texts(rows, key).mapInArrow(_blocks, MATRIX)


def column_sums(rows: DataFrame, key: str) -> np.ndarray:
    """Features by bucket. Tasks add up the blocks of their rows, and what reaches the driver is a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in _blocks(batches):
            buckets, counts = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("buckets", "counts"))
            np.add.at(total, buckets, counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    sums = np.zeros(BUCKETS, np.int64)
    for r in _texts(rows, key).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[r.bucket] = r.n
    return sums


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of the target's and the corpus's share of each bucket, both smoothed by one."""
    s_all, t_all = float(own.sum()), float(target.sum())
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(own.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def weighed(rows: DataFrame, key: str, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_features, weight and score of every row: the product of the matrix with the gains, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            ids, starts, buckets, counts = (block.column(c)[0].values for c in ("doc_id", "starts", "buckets", "counts"))
            starts, counts = starts.to_numpy(), counts.to_numpy().astype(np.int64)
            upto = lambda x: np.concatenate([[0], np.cumsum(x)])[starts]  # noqa: E731, B023
            n, total = np.diff(upto(counts)), np.diff(upto(counts * gain[buckets.to_numpy()]))
            weight = total // np.maximum(n, 1)
            score = weight + np.array([gumbel(x, seed) for x in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(weight), pa.array(score)], ["doc_id", "n_features", "weight", "score"])

    return _texts(rows, key).mapInArrow(run, "doc_id long, n_features long, weight long, score long")


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with rank, from 1 in the given order: a running count in each piece of a range partitioning, after those of the pieces before it."""
    cut = written(rows.repartitionByRange(*order).withColumn("piece", F.spark_partition_id()))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("piece").agg(F.count("*").alias("n")).select("piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("piece").orderBy(*order))
    return cut.withColumn("place", place).join(F.broadcast(base), "piece").withColumn("rank", F.col("place") + F.col("base")).drop("piece", "place", "base")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, target_key: str = "item_id") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank counts the drawn ones, null: not drawn.

    Drawn are `percent` of the rows with `least_words` words or more, those of the highest score; ties go to the smaller doc_id (nulls
    last), then to fewer features, and rows that agree in all of it are alike. Null and empty texts have no words, weight 0
    and no part in the draw. Ids that repeat are rows of their own; a null id is drawn by the empty one. Empty tables: no
    rows, or a target without words. Columns other than the keys and texts aren't read.

    The matrix is made twice, for the sums and for the product, and a task holds one block of it: written blocks, of which a reader takes
    thousands together, cost memory with the size of the files. Scores are whole numbers of some 10^5 values (gains and noise
    are logarithms), so counts by score give the lowest score drawn, and only rows from there on are put in order.
    """
    gain = gains(column_sums(docs, "doc_id"), column_sums(target, f"try_cast({target_key} as long)"))
    rows = written(weighed(docs, "doc_id", gain, seed))
    able = F.col("n_features") >= least_words
    by_score = rows.where(able).groupBy("score").count()
    drawn = by_score.agg(F.sum("count")).first()[0]
    drawn = (drawn or 0) * percent // 100
    above = F.sum("count").over(Window.orderBy(F.desc("score")))
    low = by_score.withColumn("above", above).where(F.col("above") - F.col("count") < drawn).agg(F.min("score")).first()[0]
    if low is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    may = able & (F.col("score") >= low)
    ranked = numbered(rows.where(may), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
    return ranked.unionByName(rows.where(~may).withColumn("rank", F.lit(None).cast("long")))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with recursive bits(i, c, k) as (
  select i::bigint, i::bigint, 0 from range(256) r(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), crc_table as (select list(c order by i) t from bits where k = 8
), texts as (
  select 1 own, doc_id id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents
  union all select 0, 0, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
), found as (select own, id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w from texts
), words as (select own, id, w, count(*) n from found group by all
), spelt as (select w, hex(encode(w)) h from (select distinct w from words)
), steps(w, h, p, crc) as (
  select w, h, 1, 4294967295::bigint from spelt
  union all
  select w, h, p + 2, xor(crc >> 8, t[(xor(crc, 16 * (strpos('0123456789ABCDEF', h[p]) - 1) + strpos('0123456789ABCDEF', h[p + 1]) - 1) & 255)::int + 1])
  from steps, crc_table where p < length(h)
), bucket as (select w, xor(crc, 4294967295) % 10000 b from steps where p > length(h)
), cells as (select own, id, b, sum(n) n from words join bucket using (w) group by all
), sums as (select i b, coalesce(sum(n) filter (own = 1), 0)::double s, coalesce(sum(n) filter (own = 0), 0)::double t from range(10000) r(i) left join cells on b = i group by all
), gain as (select b, floor(1000 * ln((t + 1) * ((select sum(s) from sums) + 10000) / ((s + 1) * ((select sum(t) from sums) + 10000))))::bigint g from sums
), weight as (select id, sum(n)::bigint n, floor(sum(n * g) / sum(n))::bigint w from cells join gain using (b) where own = 1 group by all
), scored as (
  select doc_id, coalesce(n, 0) n_features, coalesce(w, 0) weight,
    coalesce(w, 0) + floor(-1000 * ln(-ln(((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint) + 0.5::double) / 4294967296)))::bigint score
  from documents left join weight on id = doc_id
), placed as (select doc_id, row_number() over (order by score desc, doc_id) place, 10 * count(*) over () // 100 drawn from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when place <= drawn then place end as rank from scored left join placed using (doc_id)
"""
