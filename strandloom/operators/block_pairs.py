"""Pairs of junctions of a fragment, from blocks of junction results (places.results_of()): no row a junction and none a pair.

What operators.pairs makes of a row a junction. Results by fragment name it by read_id and run_no: reads cut from documents have one frag_no. Which pairs are known is asked block by block: a block's different k-mers go to the parts of the
known pairs, their partners come back, and the pairs of each fragment are gone through in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stretches
from .places import RESULTS, _batched, _revcomp, _rows

#: Pairs made different together, at most (and a block more).
HELD = 1 << 21
_ASKED = "part int, c0 binary, c1 binary, block long"


def _opened(row: dict) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(row[c], t) for c, t in RESULTS.items()}


def _canon(x: np.ndarray, k: int) -> np.ndarray:
    x = x.view(np.uint64)
    return np.minimum(x, _revcomp(x, k))


def _different(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(a, b), np.maximum(a, b)


def short_pairs(found: DataFrame, k: int) -> DataFrame:
    """k1 and k2, as pairs.short_pairs() has them."""

    def own(row: dict) -> tuple[np.ndarray, np.ndarray]:
        x = _opened(row)
        n = x["n"].astype(np.int64)
        left, canon = np.repeat(np.cumsum(n), n) - np.arange(int(n.sum())), _canon(x["real"], k)
        many = np.flatnonzero((np.repeat(n, n) > 2) & (left > 2))
        two = (np.cumsum(n) - n)[n == 2]
        on, next_on = x["onward"][two], x["onward"][two + 1]
        two = two[(on == next_on) | (~on & next_on & (x["tpos"][two] >> 1 <= x["tpos"][two + 1] >> 1))]
        return _keys(np.concatenate([canon[many], canon[two]]), np.concatenate([canon[many + 2], canon[two + 1]]))

    def out(held: list) -> Iterator[pa.RecordBatch]:
        a, b = _different(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for i in range(0, len(a), 1 << 19):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 19)].view(np.int64)) for x in (a, b)], names=["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for row in _rows(batches):
            held.append(_different(*own(row)))
            n += len(held[-1][0])
            if n >= HELD:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    return found.select(*RESULTS).mapInArrow(run, "k1 long, k2 long").distinct()


class Known:
    """The known pairs among a block's k-mers, by the numbers that these have in order (no)."""

    def __init__(self, canon: np.ndarray, answers: list[tuple[np.ndarray, np.ndarray]]):
        self.kmers, self.no = np.unique(canon, return_inverse=True)
        a, b = (np.concatenate([x[i] for x in answers]) if answers else np.zeros(0, np.uint64) for i in (0, 1))
        at = np.minimum(np.searchsorted(self.kmers, b), len(self.kmers) - 1)
        own = self.kmers[at] == b
        self.pairs = np.sort(np.searchsorted(self.kmers, a[own]) * len(self.kmers) + at[own])
        self.bits = max(16, int(8 * len(self.pairs)).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._hash(self.pairs)] = True

    def _hash(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A pair's number, or -1 for one that is not known, of the junctions at a and b of the block."""
        a, b = self.no[a], self.no[b]
        pair = np.minimum(a, b) * len(self.kmers) + np.maximum(a, b)
        may = np.flatnonzero(self.seen[self._hash(pair)])
        at = np.minimum(np.searchsorted(self.pairs, pair[may]), len(self.pairs) - 1) if len(self.pairs) else may
        out = np.full(len(pair), -1)
        if len(self.pairs):
            hit = self.pairs[at] == pair[may]
            out[may[hit]] = at[hit]
        return out


def with_known(found: DataFrame, pairs: DataFrame, k: int, use: Callable, schema: str) -> DataFrame:
    """What use(x, known) makes of each block: x its columns (see RESULTS), known the pairs (k1, k2) among its k-mers."""
    parts = stretches.parts_for(found)

    def part_of(x: np.ndarray) -> np.ndarray:
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)

    def row(part: np.ndarray, block: int, *columns: np.ndarray) -> pa.RecordBatch:
        b = stretches.blobs(part, *columns)
        empty = [pa.array([b""] * b.num_rows, pa.binary())] * (2 - len(columns))
        return pa.RecordBatch.from_arrays([*b.columns, *empty, pa.array([block] * b.num_rows, pa.int64())], names=["part", "c0", "c1", "block"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            x = np.unique(_canon(np.frombuffer(r["real"], np.int64), k))
            if len(x):
                yield row(part_of(x), r["block"], x)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _batched(batches):
            a, b = a.view(np.uint64), b.view(np.uint64)
            yield row(part_of(a), -1, a, b)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, second = [], None, None
        for batch in batches:
            for c0, c1, block in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                a = np.frombuffer(c0.as_buffer(), np.uint64)
                if block < 0:
                    held.append((a, np.frombuffer(c1.as_buffer(), np.uint64)))
                    continue
                if not held:
                    continue
                if first is None:
                    first, second = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(first, kind="stable")
                    first, second = first[order], second[order]
                start, end = np.searchsorted(first, a), np.searchsorted(first, a, "right")
                some = end > start
                a, start, n = a[some], start[some], (end - start)[some]
                if len(a):
                    b = second[np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                    yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([x.tobytes()], pa.binary()) for x in (a, n.astype(np.int32), b))], names=["block", "a", "n", "b"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            x = _opened(r)
            if len(x["real"]):
                got = [(np.repeat(np.frombuffer(y["a"], np.uint64), np.frombuffer(y["n"], np.int32)), np.frombuffer(y["b"], np.uint64)) for y in r["answers"] or []]
                batch = use(x, Known(_canon(x["real"], k), got))
                yield from (batch.slice(i, 20_000) for i in range(0, batch.num_rows, 20_000))

    sent = found.select("real", "block").mapInArrow(ask, _ASKED).unionByName(pairs.select(F.col("k1").cast("long"), F.col("k2").cast("long")).mapInArrow(deal, _ASKED))
    answers = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("block").mapInArrow(look, "block long, a binary, n binary, b binary")
    answers = answers.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("a", "n", "b")).alias("answers"))
    return found.repartition(parts, "block").join(answers, "block", "left").mapInArrow(back, schema)


def _in_order(n: np.ndarray, most: int, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of junctions of a fragment, each with itself and those after it, up to `most` half bases on: by how many junctions apart they are."""
    left = np.repeat(np.cumsum(n), n) - np.arange(int(n.sum()))
    a, apart = np.arange(len(left)), 0
    while len(a):
        yield a, a + apart
        apart += 1
        a = a[left[a] > apart]
        a = a[at[a + apart] - at[a] <= most]


def _fragment(x: dict) -> np.ndarray:
    return np.repeat(np.arange(len(x["n"])), x["n"])


def score(found: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """read_id, run_no and score of fragments: how many different known pairs their junctions in a row make; without any, no row."""

    def use(x: dict, known: Known) -> pa.RecordBatch:
        frag = _fragment(x)
        a = np.flatnonzero(frag[1:] == frag[:-1])
        pair = known.of(a, a + 1)
        of, _ = _different(frag[a[pair >= 0]], pair[pair >= 0])
        of, n = np.unique(of, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(x["read_id"][of]), pa.array(x["run_no"][of]), pa.array(n)], names=["read_id", "run_no", "score"])

    return with_known(found, pairs, k, use, "read_id long, run_no int, score long")


def insert_sums(found: DataFrame, pairs: DataFrame, k: int, most: int = 2000) -> DataFrame:
    """read_id, run_no, n, s and q of fragments: number, sum and sum of squares of the distances of known pairs up to `most` half bases."""

    def use(x: dict, known: Known) -> pa.RecordBatch:
        frag, t = _fragment(x), x["tpos"].astype(np.int64)
        sums = np.zeros((3, len(x["n"])), np.int64)
        for a, b in _in_order(x["n"].astype(np.int64), most, t):
            hit = known.of(a, b) >= 0
            of, d = frag[a[hit]], (t[b] - t[a])[hit]
            for i in range(3):
                # whole numbers far below 2^53
                sums[i] += np.bincount(of, d.astype(float) ** i, len(x["n"])).astype(np.int64)
        some = np.flatnonzero(sums[0])
        return pa.RecordBatch.from_arrays([pa.array(x["read_id"][some]), pa.array(x["run_no"][some]), *(pa.array(y[some]) for y in sums)], names=["read_id", "run_no", "n", "s", "q"])

    return with_known(found, pairs, k, use, "read_id long, run_no int, n long, s long, q long")


def distance_histogram(found: DataFrame, pairs: DataFrame, k: int, step: int = 20, most: int = 2000) -> DataFrame:
    """bucket (its lower end), known and unknown: pairs of junctions of one fragment by their distance."""
    size = most // step

    def use(x: dict, known: Known) -> pa.RecordBatch:
        t = x["tpos"].astype(np.int64)
        n = np.zeros((2, size), np.int64)
        for a, b in _in_order(x["n"].astype(np.int64), most, t):
            d, hit = (t[b] - t[a]) // step, known.of(a, b) >= 0
            for i, some in enumerate((hit, ~hit)):
                n[i] += np.bincount(d[some], minlength=size + 1)[:size]
        some = np.flatnonzero(n.sum(axis=0))
        return pa.RecordBatch.from_arrays([pa.array(some * step), *(pa.array(y[some]) for y in n)], names=["bucket", "known", "unknown"])

    rows = with_known(found, pairs, k, use, "bucket long, known long, unknown long")
    return rows.groupBy("bucket").agg(F.sum("known").alias("known"), F.sum("unknown").alias("unknown"))
