"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, ordered, pieces, table, written

#: Words of the shortest tile, and the part of a test item's words that tiles must cover.
LEAST_MATCH, LEAST_COVER = 5, 0.5
#: Bits of the map of seeds that is broadcast: 8 MB, however large the benchmark.
MAP_BITS = 1 << 26

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_PRIME, _RADIX = (1 << 61) - 1, 1_000_003


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; all ASCII signs but letters and digits part them."""
    return (text or "").encode().translate(_LETTERS).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def hashes_of(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def seeds_of(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` word hashes, as a signed number; runs of another width have others."""
    if len(words) < width:
        return np.zeros(0, np.int64)
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(_BASE) + words[i : i + len(out)]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, words) of tiles, each the longest match left when it is set.

    A running Karp-Rabin search looks for matches of a length s or more among words that no tile has taken; where it
    meets one of over 2 s it begins again with that length, else the matches are set longest first, and s is halved.
    Ids below 0 match nothing.
    """
    free_i, free_t = [x >= 0 for x in item], [x >= 0 for x in text]
    s, out = max(least, min(len(item), len(text)) // 2), []
    while True:
        found, longest = _search(item, text, free_i, free_t, s)
        if longest > 2 * s:
            s = longest
            continue
        for length, p, t in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            while length >= s and not (free_i[p] and free_t[t]):
                length, p, t = length - 1, p + 1, t + 1
            k = 0
            while k < length and free_i[p + k] and free_t[t + k]:
                k += 1
            if k >= s:
                out.append((p, t, k))
                free_i[p : p + k] = free_t[t : t + k] = [False] * k
        if found and any(free_i[p] and free_t[t] for _, p, t in found) and _search(item, text, free_i, free_t, s)[0]:
            continue  # what tiles have cut short may still be long enough
        if s == least:
            return out
        s = max(least, s // 2)


def _search(item, text, free_i, free_t, s):
    """Maximal matches of s or more free words, and the longest length; ends early at one of over 2 s."""
    at = defaultdict(list)
    for p, h in _running(item, free_i, s):
        at[h].append(p)
    found, longest = [], 0
    for t, h in _running(text, free_t, s) if at else ():
        for p in at.get(h, ()):
            if p and t and free_i[p - 1] and free_t[t - 1] and item[p - 1] == text[t - 1]:
                continue  # part of a match that began earlier
            k = 0
            while p + k < len(item) and t + k < len(text) and free_i[p + k] and free_t[t + k] and item[p + k] == text[t + k]:
                k += 1
            if k > 2 * s:
                return [], k
            if k >= s:
                found.append((k, p, t))
                longest = max(longest, k)
    return found, longest


def _running(words, free, s):
    """(start, Karp-Rabin hash) of every run of s free words: the hash runs along, a word comes in and the oldest goes out."""
    oldest = pow(_RADIX, s - 1, _PRIME)
    n = h = 0
    for i, (w, f) in enumerate(zip(words, free)):
        if not f:
            n = h = 0
            continue
        if n == s:
            h -= (words[i - s] + 1) * oldest
        else:
            n += 1
        h = (h * _RADIX + w + 1) % _PRIME
        if n == s:
            yield i - s + 1, h


def tiled(item: np.ndarray, words: np.ndarray, least: int, cover: float) -> tuple[int, int] | None:
    """(words that tiles cover, tiles), if they cover the part `cover` of the item's words. What lies outside the seeds that item
    and text share can't be in a tile, and is passed over."""
    width = min(least, len(item))
    starts = np.flatnonzero(np.isin(seeds_of(words, width), seeds_of(item, width)))
    need = cover * len(item)
    if not len(starts) or np.minimum(np.diff(starts), width).sum() + width < need:
        return None
    number: dict[int, int] = {}
    own = [number.setdefault(w, len(number)) for w in item.tolist()]
    near, end = [], None
    for s in starts.tolist():
        if end is None or s > end:
            near.append(-1)
            end = s
        near += [number.get(w, -1) for w in words[end : s + width].tolist()]
        end = s + width
    found = tiles(own, near, width)
    covered = sum(k for _, _, k in found)
    return (covered, len(found)) if covered >= need else None


def _items(benchmark: DataFrame, least: int) -> DataFrame:
    """item (a number for each row), item_id, words (hashes) and seeds (distinct) of all items that have words."""

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch)):
            words = [hashes_of(t) for t in b.column("text").to_pylist()]
            seeds = [np.unique(seeds_of(w, min(least, len(w)))) if len(w) else () for w in words]
            own = pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("item_id"), own, pa.array(seeds, pa.list_(pa.int64()))], ["item", "item_id", "words", "seeds"])

    rows = benchmark.selectExpr("monotonically_increasing_id() item", "cast(item_id as long) item_id", "cast(text as string) text")
    return written(rows.mapInArrow(run, "item long, item_id long, words array<long>, seeds array<long>").where("size(words) > 0"))


def _map_of(seeds: DataFrame) -> np.ndarray:
    """MAP_BITS bits, of which those of the seeds (column seed) are set; made on the cluster, at most a row for each 64 bits."""
    bit = F.shiftrightunsigned("seed", 64 - MAP_BITS.bit_length() + 1)
    rows = seeds.select(F.shiftright(bit, 6).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("bits"))
    got = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def _contaminated(docs: DataFrame, benchmark: DataFrame, least: int, cover: float) -> DataFrame:
    """key, doc_id, item_id, item_words, covered and n_tiles of every pair of a row of docs (key, doc_id, text) and an item that it covers."""
    items = _items(benchmark, least)
    seeds = items.select(F.explode("seeds").alias("seed"), "item")
    widths = [r.n for r in items.select(F.least(F.size("words"), F.lit(least)).alias("n")).distinct().collect()]  # `least` at most
    shared = docs.sparkSession.sparkContext.broadcast(_map_of(seeds))

    def meet(batches):
        """Rows that hold seeds of the map: the words in them, a 0 wherever others stand between, and the seeds with how often each occurs."""
        bits = shared.value
        shift = np.uint64(64 - MAP_BITS.bit_length() + 1)
        for b in (x for batch in batches for x in pieces(batch)):
            rows = []
            for key, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "text"))):
                words = hashes_of(text)
                inside, found = np.zeros(len(words) + 1, np.int64), []
                for n in widths:
                    own = seeds_of(words, n)
                    at = own.view(np.uint64) >> shift
                    hit = np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                    found.append(own[hit])
                    np.add.at(inside, hit, 1)
                    np.add.at(inside, hit + n, -1)
                found, times = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
                if len(found):
                    take = np.cumsum(inside[:-1]) > 0
                    first = take & ~np.concatenate([[False], take[:-1]])
                    near = np.insert(words[take], np.flatnonzero(first[take]), 0).view(np.int64)
                    rows.append((key, doc_id, near, found, times))
            kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["key", "doc_id", "near", "seeds", "times"])

    def tile(batches):
        for b in batches:
            out = []
            for key, doc_id, near, item_id, words in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "near", "item_id", "words"))):
                got = tiled(np.array(words, np.int64).view(np.uint64), np.array(near, np.int64).view(np.uint64), least, cover)
                if got:
                    out.append((key, doc_id, item_id, len(words), *got))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [()] * 6], ["key", "doc_id", "item_id", "item_words", "covered", "n_tiles"])

    met = written(docs.select("key", "doc_id", "text").mapInArrow(meet, "key long, doc_id long, near array<long>, seeds array<long>, times array<long>"))
    hits = met.select("key", F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("key", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))
    pairs = hits.join(seeds, "seed").groupBy("key", "item").agg(F.sum("times").alias("n"))
    # so many seeds can't cover enough
    enough = pairs.join(items.select("item", "item_id", "words"), "item").where(f"n * least({least}, size(words)) >= {cover} * size(words)")
    found = enough.drop("n").join(met.select("key", "doc_id", "near"), "key").select("key", "doc_id", "near", "item_id", "words")
    found = written(found.mapInArrow(tile, "key long, doc_id long, item_id long, item_words long, covered long, n_tiles long"))
    drop_written(met)
    drop_written(items)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_MATCH, cover: float = LEAST_COVER) -> DataFrame:
    """doc_id, item_id, item_words, covered, n_tiles and coverage of every pair whose tiles, of `least` words or more, cover
    at least the part `cover` of the item, in whatever order they stand in the text.

    Seeds of `least` words (a shorter item: the whole of it) of all texts are held against a map of the items' seeds, whose
    size is fixed; those it has are joined with the items', and pairs that share enough seeds are tiled. Only a text's words in
    such seeds move. Items without words, and null or empty texts, match nothing. Repeated rows and items each make
    pairs of their own.
    """
    found = _contaminated(ordered(docs), benchmark, least, cover)
    return found.drop("key").withColumn("coverage", F.col("covered") / F.col("item_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_MATCH, cover: float = LEAST_COVER) -> DataFrame:
    """The rows, unchanged and with all their columns, that cover no test item so far."""
    columns = docs.columns
    docs = ordered(docs, rest=True)
    go = written(_contaminated(docs, benchmark, least, cover).select("key").distinct())
    return docs.join(go, "key", "left_anti").select(*(F.col(f"rest.`{c}`") for c in columns))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
