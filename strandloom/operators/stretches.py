"""K-mers dealt out as stretches: bases whose k-mers, one after another, go to the same part travel as one long.

A k-mer's part comes from the smallest hash among its m-mers, each taken with its reverse complement as one, so that both strands of a
k-mer go to the same part and neighbours mostly do. A stretch of 32 bases at most takes 9 bytes for all its k-mers, where a row a k-mer
takes some 10 after compression. Codes are those of functions.dna.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASES, M = 32, 11  # bases of a stretch; of an m-mer
PIECE = 1 << 20  # bases of a fragment that are looked at together
BLOCK = 1 << 22  # bases of a block on the way out; k-mers of one on the way in
MB_A_PART, MOST_PARTS, UNKNOWN = 4, 8000, 1 << 50
_CODES = np.zeros(256, np.uint8)
_CODES[[ord(b) for b in "ACTG"]] = range(4)
_OTHER = np.ones(256, bool)
_OTHER[[ord(b) for b in "ACTG"]] = False
_SWAPS = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF))


def parts_for(table: DataFrame) -> int:
    """In how many parts a table's k-mers go: by the size of the files behind it, so that a part stays small enough for one task. What has
    no files (rows given by the caller) has no known size and counts as small."""
    leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    size = sum(x for x in sizes if x < UNKNOWN)
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // (MB_A_PART << 20), MOST_PARTS))


def composed(one: np.ndarray, width: int, join) -> np.ndarray:
    """Of every width values in a row what join(a, b, values of a, values of b) makes of them."""
    out, n, power, w = None, 0, one, 1
    while True:
        if width & w:
            out = power if out is None else join(out[: len(power) - n], power[n:][: len(out)], n, w)
            n += w
        if n == width:
            return out
        power, w = join(power[:-w], power[w:], w, w), 2 * w


def ahead(kind):
    return lambda a, b, n, w: a << kind(2 * w) | b


def turned(kind):
    return lambda a, b, n, w: b << kind(2 * n) | a


def revcomp(x: np.ndarray) -> np.ndarray:
    """Reverse complement of 32 bases."""
    x = x ^ np.uint64(0xAAAAAAAAAAAAAAAA)
    for width, keep in _SWAPS:
        x = (x >> np.uint64(width)) & np.uint64(keep) | (x & np.uint64(keep)) << np.uint64(width)
    return x >> np.uint64(32) | x << np.uint64(32)


def part_of(codes: np.ndarray, k: int, parts: int) -> np.ndarray:
    """The part of the k-mer at every place."""
    m, u = min(k, M), np.uint32
    c = codes.astype(u)
    mmers = np.minimum(composed(c, m, ahead(u)), composed(c ^ u(2), m, turned(u)))
    least = composed(mmers * u(0x9E3779B1), k - m + 1, lambda a, b, n, w: np.minimum(a, b))
    # small hashes are what least has, so they are mixed once more
    return ((least * u(0x85EBCA6B)) >> u(8)) % u(parts)


def cut(codes: np.ndarray, lengths: np.ndarray, k: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """part, stretch (its last base in the lowest bits) and number of k-mers of the stretches of fragments that stand one after the other."""
    n = np.maximum(lengths - k + 1, 0)
    total, first = int(n.sum()), np.cumsum(n) - n
    if not total:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    at = np.repeat(np.cumsum(lengths) - lengths - first, n) + np.arange(total)
    part = part_of(codes, k, parts)[at]
    new = np.empty(total, bool)
    new[1:] = part[1:] != part[:-1]
    new[first[n > 0]] = True
    start = np.flatnonzero(new)
    size, most = np.diff(start, append=total), BASES - k + 1
    pieces = -(-size // most)
    no = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, size = np.repeat(start, pieces) + most * no, np.minimum(np.repeat(size, pieces) - most * no, most)
    whole = composed(np.concatenate([codes, np.zeros(BASES, np.uint8)]).astype(np.uint64), BASES, ahead(np.uint64))[at[start]]
    return part[start], whole >> (2 * (BASES - k + 1 - size)).astype(np.uint64), size.astype(np.uint8)


def blobs(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row a part, with its values of each column as bytes."""
    order = np.argsort(part.astype(np.uint16), kind="stable")
    part = part[order]
    start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.append(start, len(part))
    arrays = [pa.array(part[start].astype(np.int32))]
    for i, c in enumerate(columns):
        offsets = pa.py_buffer((ends * c.itemsize).astype(np.int32))
        arrays.append(pa.Array.from_buffers(pa.binary(), len(start), [None, offsets, pa.py_buffer(np.ascontiguousarray(c[order]))]))
    return pa.RecordBatch.from_arrays(arrays, names=["part", *(f"c{i}" for i in range(len(columns)))])


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts together, and the length of each."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(column) else np.zeros(0, np.uint8), np.diff(offsets)


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts together, and the length of each."""
    raw, lengths = _raw(column)
    return _CODES[raw], lengths


def runs(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: codes of the runs of A, C, G and T of k bases or more, one after the other, the text that each lies in, and its length."""
    raw, lengths = _raw(column)
    other = _OTHER[raw]
    if not other.any() and (len(lengths) == 0 or lengths.min() >= k):
        return _CODES[raw], np.arange(len(lengths)), lengths
    edge = np.zeros(len(raw) + 1, bool)
    first = np.cumsum(lengths) - lengths
    edge[first] = edge[-1] = True
    on = ~other
    start = np.flatnonzero(on & (edge[:-1] | np.concatenate([[True], other[:-1]])))
    end = np.flatnonzero(on & (edge[1:] | np.concatenate([other[1:], [True]]))) + 1
    long = end - start >= k
    start, size = start[long], (end - start)[long]
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    return _CODES[raw[at]], np.searchsorted(first, start, "right") - 1, size


def dealt(frags: DataFrame, k: int, parts: int) -> DataFrame:
    """part, c0 and c1 of all stretches of fragments (seq, of A, C, G and T only), each part in one partition: stretches of many fragments are
    a row, as longs and their numbers of k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bases = [], 0
        for batch in batches:
            codes, lengths = _text(batch.column(0))
            ends = np.cumsum(lengths)
            at = 0
            while at < len(lengths):
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + BLOCK - bases, "right")))
                held.append((codes[done : int(ends[to - 1])], lengths[at:to]))
                bases, at = bases + int(ends[to - 1]) - done, to
                if bases >= BLOCK // 2:
                    yield from out(held)
                    held, bases = [], 0
        yield from out(held)

    def out(held):
        if held:
            part, stretch, size = cut(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), k, parts)
            if len(part):
                yield blobs(part, stretch, size)

    # long fragments go in pieces, which have k - 1 bases in common
    first = F.sequence(F.lit(0), F.greatest(F.length("seq") - k, F.lit(0)), F.lit(PIECE))
    pieces = F.when(F.length("seq") <= PIECE, F.array("seq")).otherwise(F.transform(first, lambda i: F.substring(F.col("seq"), i + 1, F.lit(PIECE + k - 1))))
    rows = frags.where(F.length("seq") >= k).select(F.explode(pieces).alias("seq"))
    return rows.mapInArrow(run, "part int, c0 binary, c1 binary").repartitionById(parts, F.col("part"))


def strands(stretch: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers of stretches, and their reverse complements."""
    n = size.astype(np.int64)
    total = int(n.sum())
    place = (np.arange(total) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    bases = (n + k - 1).astype(np.uint64)
    back = revcomp(stretch) >> np.uint64(2) * (np.uint64(BASES) - bases)
    keep, two = np.uint64((1 << 2 * k) - 1), np.uint64(2)
    here = np.repeat(stretch, n) >> two * (np.repeat(n.astype(np.uint64) - np.uint64(1), n) - place)
    return here & keep, (np.repeat(back, n) >> two * place) & keep


def canons(stretch: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The k-mers of stretches, a k-mer and its reverse complement being one."""
    return np.minimum(*strands(stretch, size, k))


def counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each stands there (or the sum of n)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.diff(start, append=len(keys)) if n is None else np.add.reduceat(n, start)


def counts(frags: DataFrame, k: int) -> DataFrame:
    """canon and cnt of all k-mers. A task holds the different k-mers of its part, not their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, levels = [], 0, []
        for batch in batches:
            for s, size in zip(batch.column(1), batch.column(2), strict=True):
                size = np.frombuffer(size.as_buffer(), np.uint8)
                held.append((np.frombuffer(s.as_buffer(), np.uint64), size))
                n += int(size.sum())
                if n >= BLOCK:
                    add(levels, held)
                    held, n = [], 0
        if held:
            add(levels, held)
        while len(levels) > 1:
            merge(levels)
        for keys, times in levels:
            for i in range(0, len(keys), BLOCK // 8):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + BLOCK // 8].view(np.int64)), pa.array(times[i : i + BLOCK // 8])], names=["canon", "cnt"])

    def add(levels: list, held: list) -> None:
        levels.append(counted(canons(np.concatenate([s for s, _ in held]), np.concatenate([x for _, x in held]), k)))
        while len(levels) > 1 and len(levels[-2][0]) <= 2 * len(levels[-1][0]):
            merge(levels)

    def merge(levels: list) -> None:
        (a, m), (b, n) = levels.pop(), levels.pop()
        levels.append(counted(np.concatenate([a, b]), np.concatenate([m, n])))

    return dealt(frags, k, parts_for(frags)).mapInArrow(run, "canon long, cnt long")


_ODD = 0x9E3779B97F4A7C15


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones ...: high ones, mostly alike, compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def summed(counts: DataFrame, k: int) -> DataFrame:
    """canon and the sum of cnt of k-mers that occur several times. A k-mer is multiplied by an odd number modulo 4^k, which is undone after; parts are
    ranges of the products, so that many in order are small steps. A task holds the different k-mers of its part."""
    parts, u = parts_for(counts), np.uint64
    keep, odd, undo = u((1 << 2 * k) - 1), u(_ODD & (1 << 2 * k) - 1), u(pow(_ODD, -1, 1 << 2 * k))
    ends = np.array([-(-(i << 2 * k) // parts) for i in range(1, parts)], u)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK // 4:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    def out(held: list) -> pa.RecordBatch:
        canon, cnt = (np.concatenate([np.asarray(b.column(i)) for b in held]) for i in (0, 1))
        keys, cnt = counted(canon.astype(u) * odd & keep, cnt)
        at = [0, *np.searchsorted(keys, ends).tolist(), len(keys)]
        some = [(p, a, b) for p, (a, b) in enumerate(zip(at, at[1:])) if a < b]
        steps = [planes(np.diff(keys[a:b], prepend=u(0))) for _, a, b in some]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in some], pa.int32()), pa.array(steps, pa.binary()), pa.array([planes(cnt[a:b]) for _, a, b in some], pa.binary())], names=["part", "c0", "c1"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = []
        for batch in batches:
            for a, b in zip(batch.column(1), batch.column(2), strict=True):
                levels.append((np.cumsum(from_planes(a.as_py(), u), dtype=u), from_planes(b.as_py(), np.int64)))
                while len(levels) > 1 and len(levels[-2][0]) <= 2 * len(levels[-1][0]):
                    merge(levels)
        while len(levels) > 1:
            merge(levels)
        for keys, times in levels:
            for i in range(0, len(keys), BLOCK // 8):
                canon = (keys[i : i + BLOCK // 8] * undo & keep).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(canon), pa.array(times[i : i + BLOCK // 8])], names=["canon", "cnt"])

    def merge(levels: list) -> None:
        (a, m), (b, n) = levels.pop(), levels.pop()
        levels.append(counted(np.concatenate([a, b]), np.concatenate([m, n])))

    rows = counts.select(F.col("canon").cast("long"), F.col("cnt").cast("long")).mapInArrow(deal, "part int, c0 binary, c1 binary")
    return rows.repartitionById(parts, F.col("part")).mapInArrow(unite, "canon long, cnt long")
