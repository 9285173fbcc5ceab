"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop_written, ordered, pieces, table, written
from .similar import BAND_HASHES, RANGES, roots_of, shared_buckets

_STEP = 4096  # shingles whose bits are counted at a time


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64 bits: each is set where it is set in more than half of the shingles' hashes; 0 for a text without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and no white space but ASCII's
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        ones += np.unpackbits(hashes[i : i + _STEP], axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs with a column fp (long: the fingerprint's bits as a signed number) instead of text."""
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text") + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in pieces(batch)):
            fps = np.array([fingerprint(t or "", width) for t in b.column("text").to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(fps)], [*rest, "fp"])

    return docs.mapInArrow(run, schema)


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Every pair (a, b), a < b, of different fingerprints (column fp, distinct) that differ in at most `distance` (0 to 3) bits.

    Each fingerprint has two segments of 32 bits. Of two that differ in 3 bits or fewer, one segment differs in 1 at most,
    so a ball of radius 1 around each segment finds them all. Where a segment differs in one bit, one of the two has a 0
    there: flipping zeros only halves the ball. The join compares whole fingerprints before it puts out a row, and
    adaptive execution splits a segment value that very many fingerprints share.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments and balls of radius 1 cover distances up to 3")
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    segments = fps.selectExpr("fp", f"inline(array(struct(0 as part, {low} as seg), struct(1 as part, {high} as seg)))")
    ball = F.expr("concat(array(seg), transform(filter(sequence(0, 31), i -> shiftright(seg, i) & 1L = 0L), i -> seg | shiftleft(1L, i)))")
    probes = segments.select(F.col("fp").alias("a"), "part", F.explode(ball).alias("seg"))
    near = probes.join(segments.withColumnRenamed("fp", "b"), ["part", "seg"]).where(f"a <> b and bit_count(a ^ b) <= {distance}")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """key, doc_id, fp, component_id (the smallest doc_id of those linked, directly or through others), stays (this is
    the first row of its component) and first_key (that row's key) of every row.

    Equal fingerprints are one class and links join classes, so that copies are never paired. A null text counts as
    empty; texts without words share the fingerprint 0. Rows that repeat a doc_id stay rows, the first of them by their text's
    hash; a component without any doc_id but nulls has a null component_id.
    """
    rows = written(fingerprints(ordered(docs).select("key", "doc_id", "text"), width))
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("key").alias("first_key")))
    roots = components(links(classes.select("fp"), distance))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.min("first_key").alias("first_key"))
    found = rows.join(placed.select("fp", "root").join(named, "root").select("fp", "component_id", "first_key"), "fp")
    return found.select("key", "doc_id", "fp", "component_id", (F.col("key") == F.col("first_key")).alias("stays"), "first_key")


def keep_one_of_each(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """The first row, unchanged, of every component of near-duplicates."""
    columns = docs.columns
    docs = ordered(docs, rest=True)
    go = written(near_duplicates(docs.select("key", "doc_id", "text"), width, distance).where("not stays").select("key"))
    return docs.join(go, "key", "left_anti").select(*(F.col(f"rest.`{c}`") for c in columns))


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """node and root (keys; the smallest of a component) of the rows of (key, text) whose sets of `width` words in a row have a
    Jaccard similarity of `similarity` or more, directly or through others. Fingerprints of such texts differ in up to 17 bits
    and more, so MinHash bands find the candidates (similar.with_bands: at 0.8 with a probability of 0.97), all pairs of a
    band's bucket meet, and the sets decide. Equal sets are one class. Texts without words are left to the fingerprints."""

    texts = docs.select("key", "text")
    rows = written(_over_sets(texts, "key long, same long, size int, bands array<long>", lambda s: [_digest(s), len(s), numpy_bands(s)], width))
    equal = rows.groupBy("same").agg(F.min("key").alias("lid"))
    named = written(rows.join(equal, "same").select("key", "lid", "size", "bands"))
    met = written(shared_buckets(named.where("key = lid").select("lid", "size", "bands")))
    # the sets themselves, of those rows alone that share a bucket
    wanted = texts.join(met.select(F.col("lid").alias("key")).distinct(), "key", "left_semi")
    sets = written(_over_sets(wanted, "lid long, set array<long>, size int", lambda s: [s, len(s)], width))
    roots = roots_of(met, sets, similarity)
    same = named.where("key <> lid").select(F.col("key").alias("a"), F.col("lid").alias("b"))
    found = components(same.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    for done in (rows, named, met, sets, roots):
        drop_written(done)
    return found


def _digest(hashes: np.ndarray, seed: int = 0) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), seed)).astype(np.int64))


def numpy_bands(hashes: np.ndarray) -> list[int | None]:
    """Bands of different hashes in order, as similar.with_bands() makes them: of each range the smallest ones."""
    cuts = [*np.searchsorted(hashes, [i * (1 << 64) // RANGES - (1 << 63) for i in range(RANGES)]).tolist(), len(hashes)]
    return [_digest(hashes[x : min(x + BAND_HASHES, y)], i) if x < y else None for i, (x, y) in enumerate(itertools.pairwise(cuts))]


def _over_sets(texts: DataFrame, schema: str, values, width: int) -> DataFrame:
    """A row (key, *values(set)) for each of (key, text) that has words; set: the hashes of its `width` words in a row, in order."""
    kinds = [{"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}[c.split()[1]] for c in schema.split(", ")]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in pieces(batch)):
            rows = []
            for key, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                words = (t or "").encode().lower().split()
                if words:
                    found = {b" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))}
                    rows.append([key, *values(np.unique(np.array([xxhash.xxh64_intdigest(x) for x in found], np.uint64).astype(np.int64)))])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return texts.mapInArrow(run, schema)


def keep_one_of_copies(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The first row, unchanged, of every component of rows that are near-duplicates by fingerprint or near copies."""
    columns = docs.columns
    docs = ordered(docs, rest=True)
    texts = docs.select("key", "doc_id", "text")
    prints = near_duplicates(texts).where("not stays").select(F.col("key").alias("a"), F.col("first_key").alias("b"))
    copies = near_copies(texts, similarity).where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    go = written(components(prints.unionByName(copies)).where("node <> root").select(F.col("node").alias("key")))
    return docs.join(go, "key", "left_anti").select(*(F.col(f"rest.`{c}`") for c in columns))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
