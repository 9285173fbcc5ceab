"""What each filter takes out in every order of five filters, from the edges of the lattice of their subsets."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

#: Filters by letter; a set of them is a number with bit i for FILTERS[i].
FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
MIN_WORDS, LEAST_DISTINCT_PCT, MOST_UPPER_PCT, SYMBOLS = 50, 65, 5, b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails, as a set."""
    words, raw = text.split(), np.frombuffer(text, np.uint8)  # bytes are split at 0x20 and 0x09 to 0x0D only
    upper, points = np.count_nonzero((raw >= 65) & (raw <= 90)), np.count_nonzero((raw & 0xC0) != 0x80)
    failed = BIT["A"] * (len(words) < MIN_WORDS) + BIT["B"] * (100 * len(set(words)) < LEAST_DISTINCT_PCT * len(words))
    return failed + BIT["C"] * (100 * upper > MOST_UPPER_PCT * points) + BIT["D"] * any(c in text for c in SYMBOLS)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (16 bytes of the text's) and failed (A to D) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in pieces(batch)):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), digests, pa.array(map(failures, texts), pa.int32())], ["doc_id", "part", "digest", "failed"])

    own = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(source as string), '') part", "coalesce(cast(text as string), '') text")
    return own.mapInArrow(run, "doc_id long, part string, digest binary, failed int")


def failure_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed, n, good and toxic: rows of each part by the set of all filters that they fail, and those labelled good and toxic.

    Rows of one text agree on A to D, and those of its smallest doc_id pass E; so rows of a text are counted by part, with those of
    the part's smallest doc_id apart, and only these few rows meet to find which part has the smallest of all. No row is joined
    to others of its text.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = judged(docs).groupBy("doc_id", "digest", "part", "failed").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    tally = F.struct("n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")).alias("t")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")).alias("first")
    parts = rows.select("doc_id", "digest", "part", "failed", tally).groupBy("digest", "part", "failed").agg(first, *(F.sum(f"t.{c}").alias(c) for c in ("n", "good", "toxic")))
    least = parts.groupBy("digest").agg(F.min(F.struct("first.last", "first.doc_id")).alias("least"))
    parts = parts.join(least, "digest").withColumn("here", F.struct("first.last", "first.doc_id") == F.col("least"))
    side = lambda e, rest: F.struct((F.col("failed") + e).alias("failed"), *((F.when(F.col("here"), F.col(f"first.t.{c}")).otherwise(0) if not rest else F.col(c) - F.when(F.col("here"), F.col(f"first.t.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "toxic")))
    both = parts.select("part", F.inline(F.array(side(0, False), side(BIT["E"], True)))).where("n > 0")
    return both.groupBy("part", "failed").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def edges(sets: DataFrame) -> DataFrame:
    """The lattice's 80 edges of every part, as part, applied (a set of filters), filter and the sums of COUNTS along each."""
    all_edges = [(s, b) for s in range(32) for b in BIT.values() if not s & b]
    at = sets.select("*", F.inline(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(b).alias("bit")) for s, b in all_edges))))
    fails, before = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("applied")) != 0
    here = fails & ~before
    what = {"kept": (~fails & ~before, "n"), "removed": (here, "n"), "redundant": (fails & before, "n"), "unique_fails": (F.col("failed") == F.col("bit"), "n"), "good_lost": (here, "good"), "toxic_lost": (here, "toxic")}
    return at.groupBy("part", "applied", "bit").agg(*(F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(name) for name, (cond, c) in what.items()))


def steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, the filters applied before it and its own, for the 600 steps of the 120 orders."""
    return [("".join(p), i + 1, sum(BIT[f] for f in p[:i]), BIT[p[i]]) for p in itertools.permutations(FILTERS) for i in range(5)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, COUNTS and shapley: 600 rows a part, zeros included.

    A row counts once, also where it repeats another; it is good or toxic if any label of its doc_id says so. Null texts are
    empty, a null source is the part '', and a null doc_id comes after all others and has no label. Other columns aren't read. No rows: no parts.
    Documents are counted by the filters that they fail (32 sets a part at most), which go along 80 edges; an order is a path of
    five of them, so 600 steps of a fixed table are joined to the sums.
    """
    spark = docs.sparkSession
    lattice = edges(failure_sets(docs, labels))
    path = spark.createDataFrame(steps(), "filter_order string, step int, applied int, bit int")
    # an edge that comes after s filters is in s! (4 - s)! orders
    orders = F.element_at(F.array(*(F.lit(math.factorial(s) * math.factorial(4 - s)) for s in range(5))), F.bit_count("applied") + 1)
    shapley = lattice.groupBy("part", "bit").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    return lattice.join(shapley, ["part", "bit"]).join(F.broadcast(path), ["applied", "bit"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), marks as (
  select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id
), f as (
  select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
    (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(d.doc_id > min(d.doc_id) over (partition by t), count(d.doc_id) over (partition by t) > 0)::int failed
  from d left join marks using (doc_id)
), s as (select part, failed, count(*) n, sum(good) good, sum(toxic) toxic from f group by all
), l as (select chr(65 + i::int) c, 1 << i::int b from range(5) r(i)
), o as (
  select a.c || b.c || c.c || d.c || e.c filter_order, unnest([a.b, b.b, c.b, d.b, e.b]) bit, unnest([1, 2, 3, 4, 5]) step,
    unnest([0, a.b, a.b + b.b, a.b + b.b + c.b, 31 - e.b]) applied
  from l a, l b, l c, l d, l e where a.b + b.b + c.b + d.b + e.b = 31 and (a.b | b.b | c.b | d.b | e.b) = 31
), r as (
  select part, filter_order, step::int step, bit,
    sum(n) filter (failed & (applied | bit) = 0) kept, sum(n) filter (failed & bit <> 0 and failed & applied = 0) removed,
    sum(n) filter (failed & bit <> 0 and failed & applied <> 0) redundant, sum(n) filter (failed = bit) unique_fails,
    sum(good) filter (failed & bit <> 0 and failed & applied = 0) good_lost, sum(toxic) filter (failed & bit <> 0 and failed & applied = 0) toxic_lost
  from s, o group by all
)
select part, filter_order, step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant,
  coalesce(unique_fails, 0)::bigint unique_fails, coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost,
  coalesce(sum(removed) over (partition by part, bit), 0)::bigint shapley
from r
"""
