"""Fuzzy line dedup by MinHash. Lines are cut, joined and linked in DataFrame operations; their shingles are hashed in numpy,
a block of lines at a time (see the README: at every character, DataFrame functions don't meet the limits)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, ordered, table, written
from .similar import SKETCH_LONGS, roots_of, shared_buckets

#: Characters of a shingle, least Jaccard similarity of a link.
SHINGLE, SIMILARITY = 12, 0.8
#: Ranges that a line's hashes fall into, and smallest hashes of a range that make its band: a pair of similarity 0.8 shares one
#: of the bands with a probability of 0.997.
RANGES, BAND_HASHES = 8, 3
#: White space that is taken from a line's ends.
_SPACE = " \t\r\f\x0b"
#: Characters and lines hashed at once, at most (a longer line is a block by itself); bits of a hash beside the line's number.
BLOCK_CHARS, BLOCK_LINES, HASH_BITS = 1 << 17, 1 << 17, 44
#: Lines sketched at once, at most.
SKETCH_LINES = 1 << 10
#: Fills up a line shorter than a shingle: a code that no valid text holds.
_FILL = "\ud800"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd factors, so different values stay different."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(lines: list[str], length: int = SHINGLE) -> np.ndarray:
    """The different shingles of each line, sorted, as line's number << HASH_BITS | hash: `length` characters from every
    character that has as many from it on. A shorter line is one shingle."""
    lines = [x if len(x) >= length else x.ljust(length, _FILL) for x in lines]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = _mixed(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    # hashes of runs of 1, 2, 4 ... codes; those of the bits of `length` put together
    run, width, whole, done, factor = codes, 1, None, 0, int(_ODD)
    while True:
        if length & width:
            whole = run.copy() if whole is None else whole[: len(run) - done] * np.uint64(factor) + run[done:][: len(whole)]
            done += width
        if width * 2 > length:
            break
        run = run[:-width] * np.uint64(factor) + run[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    ends = np.cumsum(sizes)
    line = np.repeat(np.arange(len(lines), dtype=np.uint64), sizes - length + 1)
    counts = sizes - length + 1
    at = np.arange(len(line)) + np.repeat(ends - sizes - (np.cumsum(counts) - counts), counts)
    found = (line << np.uint64(HASH_BITS)) | (_mixed(whole[at]) >> np.uint64(64 - HASH_BITS))
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])[: len(found)]]


def bands_of(lines: list[str], length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each line, bands of each line, and all their bands, line by line.

    One permutation serves for all bands, as in similar.with_bands: hashes are cut into RANGES ranges by their value, the
    BAND_HASHES smallest of a range (all, if it has fewer) make its band, and an empty range has none.
    """
    found = shingles(lines, length)
    line, value = found >> np.uint64(HASH_BITS), found & np.uint64((1 << HASH_BITS) - 1)
    part = line * np.uint64(RANGES) + (value * np.uint64(RANGES) >> np.uint64(HASH_BITS))
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(part)))
    band = part[starts] % np.uint64(RANGES)
    for i in range(BAND_HASHES):
        has = sizes > i
        band[has] = _mixed(band[has] * _ODD + value[starts[has] + i])
    count = lambda x: np.bincount(x.astype(np.int64), minlength=len(lines))
    return count(line), count(line[starts]), band.view(np.int64)


def alike(a: list[str], b: list[str], similarity: float, length: int = SHINGLE) -> np.ndarray:
    """Of pairs of lines, which have a Jaccard similarity of `similarity` or more, by all their shingles."""
    x, y = shingles(a, length), shingles(b, length)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    count = lambda v: np.bincount((v >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(a))
    common = count(both[:-1][both[1:] == both[:-1]])
    # in whole numbers of thousandths, so that a similarity of exactly the bound counts
    bound = round(similarity * 1000)
    return common * (1000 + bound) >= bound * (count(x) + count(y))


def sketches(lines: list[str], length: int = SHINGLE) -> np.ndarray:
    """For similar.may_be_alike(), a row of SKETCH_LONGS longs a line: bit i is set if an odd number of the line's shingles have a
    hash of i modulo the bits."""
    bits = 64 * SKETCH_LONGS
    found = shingles(lines, length)
    at = (found >> np.uint64(HASH_BITS)) * np.uint64(bits) + found % np.uint64(bits)
    odd = np.bincount(at.astype(np.int64), minlength=len(lines) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(lines), SKETCH_LONGS)


def _blocks(sizes: list[int], most: int = BLOCK_LINES) -> Iterator[slice]:
    """Runs of `most` lines and BLOCK_CHARS characters together, or one longer line."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > BLOCK_CHARS or i - start >= most):
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def _with_bands(lines: DataFrame, length: int) -> DataFrame:
    """key, no, lid, size (number of shingles) and bands of lines (key, no, lid, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("line").to_pylist()
            for s in _blocks([len(x) for x in texts]):
                size, n, band = bands_of(texts[s], length)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(band))
                kept = [batch.column(c).slice(s.start, s.stop - s.start) for c in ("key", "no", "lid")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(size, pa.int32()), bands], ["key", "no", "lid", "size", "bands"])

    return lines.select("key", "no", "lid", "line").mapInArrow(run, "key long, no int, lid long, size int, bands array<long>")


def _alike(similarity: float, length: int):
    """alike() for columns."""

    @F.pandas_udf("boolean")
    def decide(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.tolist(), b.tolist()
        found = [alike(a[s], b[s], similarity, length) for s in _blocks([len(x) + len(y) for x, y in zip(a, b)])]
        return pd.Series(np.concatenate(found) if found else np.zeros(0, bool))

    return decide


def _sketched(length: int):
    """sketches() for a column."""

    @F.pandas_udf("array<long>")
    def make(lines: pd.Series) -> pd.Series:
        lines = lines.tolist()
        return pd.Series([row for s in _blocks([len(x) for x in lines], SKETCH_LINES) for row in sketches(lines[s], length)], dtype=object)

    return make


def lines_of(docs: DataFrame) -> DataFrame:
    """key, no (from 0), line (without white space at its ends) and lid, its 64-bit hash, of all lines but blank ones."""
    lines = docs.select("key", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).withColumn("line", F.btrim("line", F.lit(_SPACE)))
    return lines.where("line <> ''").withColumn("lid", F.xxhash64("line"))


def line_classes(docs: DataFrame, similarity: float = SIMILARITY, length: int = SHINGLE) -> DataFrame:
    """key, no, root and first (smallest key that has a line of the root) of the lines that others repeat or resemble.

    Copies are one line throughout. Lines that share a MinHash band (bands_of) are candidates; the Jaccard similarity of
    all their shingles decides, and links make components (similar.roots_of). What moves up to there are hashes; only of
    lines that share a bucket do the texts move, once to each line they are compared with.
    """
    kinds = written(_with_bands(lines_of(docs), length).groupBy("lid", "size", "bands").agg(F.count("*").alias("n"), F.min("key").alias("first")), "snappy")
    met = written(shared_buckets(kinds))
    shared = written(met.select("lid").distinct().join(kinds, "lid").select("lid", "size", "n", "first"))
    texts = _texts(docs, shared.select("lid", "size", "first"))
    roots = roots_of(met, texts, similarity, _alike(similarity, length), _sketched(length))

    # copies, and single lines that share a bucket: no others can be linked
    some = kinds.where("n > 1").select("lid", "n", "first").unionByName(shared.where("n = 1").select("lid", "n", "first"))
    named = some.join(roots.withColumnRenamed("node", "lid"), "lid", "left")
    named = written(named.where("n > 1 or root is not null").select("lid", F.coalesce("root", "lid").alias("root"), "first"))
    whole = named.groupBy("root").agg(F.min("first").alias("first"))
    classes = named.select("lid", "root").join(whole, "root").select("lid", "root", "first")
    # lines are cut once more: keeping a row of each with its bands would take more disk than that takes time
    found = written(lines_of(docs).select("key", "no", "lid").join(classes, "lid").select("key", "no", "root", "first"))
    for done in (kinds, met, shared, texts, roots, named):
        drop_written(done)
    return found


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """lid, size and set (the line itself) of each wanted line, from the text of the first row that has it."""
    of = wanted.groupBy(F.col("first").alias("key")).agg(F.collect_list(F.struct("lid", "size")).alias("lids"))
    once = F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE))))
    lines = docs.select("key", "text").join(of, "key").select("lids", F.explode(once).alias("set")).withColumn("lid", F.xxhash64("set"))
    return written(lines.withColumn("size", F.expr("get(filter(lids, x -> x.lid = lid), 0).size")).where("size is not null").select("lid", "size", "set"))


def without_fuzzy_lines(docs: DataFrame, similarity: float = SIMILARITY, length: int = SHINGLE) -> DataFrame:
    """doc_id, text, rest (all columns as they were), n_lines and n_removed of every row: of each component of lines that
    resemble each other, directly or through others, the earliest line stays (smallest doc_id, then place) and the others
    are taken out of the text.

    Blank lines stay where they are. White space at a line's ends doesn't count. A null text counts as empty: one blank line.
    Rows that share a doc_id come in the order of their text's hash, null doc_ids first.
    """
    docs = ordered(docs, rest=True)
    of = line_classes(docs.select("key", "text"), similarity, length)
    late = of.where("key <> first").select("key", "no")
    again = of.where("key = first").withColumn("n", F.row_number().over(Window.partitionBy("key", "root").orderBy("no"))).where("n > 1").select("key", "no")
    gone = late.unionByName(again).withColumn("before", F.lag("no", 1, -1).over(Window.partitionBy("key").orderBy("no")))
    # the lines that stay, as runs: what lies between two that go, and after the last
    run = F.struct((F.col("before") + 2).alias("at"), (F.col("no") - F.col("before") - 1).alias("n"))
    runs = gone.groupBy("key").agg(F.count("*").alias("n_gone"), F.sort_array(F.collect_list(run)).alias("runs"), F.max("no").alias("last"))
    kept = "concat(flatten(transform(runs, r -> slice(lines, r.at, r.n))), slice(lines, last + 2, size(lines)))"
    docs = docs.join(runs, "key", "left").withColumn("lines", F.split("text", "\n", -1))
    text = F.when(F.col("n_gone").isNull(), F.col("text")).otherwise(F.array_join(F.expr(kept), "\n"))
    return docs.select("doc_id", text.alias("text"), "rest", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_removed"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the text that stays) of every document."""
    kept = without_fuzzy_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
