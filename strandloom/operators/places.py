"""Sets of k-mers looked up at every place of many fragments, and the extensions of k-mers, without a row a place.

Fragments are written in blocks of 2 bits a base. A block's k-mers go out as stretches (see stretches), the set's k-mers to the same parts, and what
comes back to the block is a bit a place and direction, in the order in which the block's stretches went out. K-mers meet their extensions
in the part of the k - 1 bases that both have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.scratch import written
from . import stretches
from .stretches import BASES, BLOCK

_IDS = {"read_id": np.int64, "frag_no": np.int32, "run_no": np.int32}
_LETTERS = np.frombuffer(dna.BASES.encode(), np.uint8)
FROM_STEM, FROM_TAIL = np.uint64(1 << 62), np.uint64(1 << 63)


def packed(codes: np.ndarray) -> bytes:
    c = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes()


def unpacked(data: np.ndarray, n: int) -> np.ndarray:
    return (data[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).astype(np.uint8).ravel()[:n]


def blocks(frags: DataFrame, k: int, extra: int | None = None) -> DataFrame:
    """Fragments (seq, of A, C, G and T only, k bases or more) with their ids, many a row, written. A long one is a row of its own. With extra,
    frags are reads: their fragments are numbered among those of k + extra bases or more, and shorter ones have the number -1."""
    given = [c for c in frags.columns if c in _IDS]
    ids = given + ["frag_no"] * (extra is not None)

    def numbered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        codes, read, lengths = stretches.runs(batch.column(1), k)
        full = lengths >= k + extra
        before = np.cumsum(full) - full
        first = np.concatenate([[True], read[1:] != read[:-1]])[: len(read)]
        no = np.where(full, before - before[first][np.cumsum(first) - 1], -1) if len(read) else before
        return codes, lengths, [batch.column(0).to_numpy()[read], no]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bases = [], 0
        for batch in batches:
            if extra is None:
                (codes, lengths), own = stretches._text(batch.column(len(ids))), [batch.column(i).to_numpy() for i in range(len(ids))]
            else:
                codes, lengths, own = numbered(batch)
            ends, at = np.cumsum(lengths), 0
            while at < len(lengths):
                done = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, done + BLOCK // 2 - bases, "right"))
                if to <= at and held:
                    yield row(held)
                    held, bases = [], 0
                    continue
                to = max(at + 1, to)
                held.append((codes[done : int(ends[to - 1])], lengths[at:to], *(x[at:to] for x in own)))
                bases, at = bases + int(ends[to - 1]) - done, to
        if held:
            yield row(held)

    def row(held: list) -> pa.RecordBatch:
        codes, lengths, *own = (np.concatenate(x) for x in zip(*held, strict=True))
        values = [packed(codes), lengths.astype(np.int32).tobytes(), *(x.astype(_IDS[c]).tobytes() for c, x in zip(ids, own, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["codes", "lengths", *ids])

    kinds = {"read_id": "long", "frag_no": "int", "run_no": "int"}
    rows = frags.where(F.length("seq") >= k).dropna(subset=given).select(*(F.col(c).cast(kinds[c]).alias(c) for c in given), "seq")
    found = rows.mapInArrow(run, ", ".join(f"{c} binary" for c in ("codes", "lengths", *ids)))
    return written(found.withColumn("block", F.monotonically_increasing_id()))


def _pieces(codes: np.ndarray, lengths: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A block, or a long fragment in pieces with k - 1 bases in common, whose k-mers follow each other."""
    if len(lengths) > 1 or len(codes) <= BLOCK:
        yield 0, codes, lengths
    else:
        for i in range(0, len(codes) - k + 1, stretches.PIECE):
            piece = codes[i : i + stretches.PIECE + k - 1]
            yield i // stretches.PIECE, piece, np.array([len(piece)])


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
    return unpacked(np.frombuffer(row["codes"], np.uint8), int(lengths.sum())), lengths


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_STRETCHES = "part int, c0 binary, c1 binary, block long, piece int"


def _sent(table: DataFrame, k: int, parts: int) -> DataFrame:
    """The stretches of blocks, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            for i, codes, lengths in _pieces(*_opened(row), k):
                part, stretch, size = stretches.cut(codes, lengths, k, parts)
                if len(part):
                    b = stretches.blobs(part, stretch, size)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([row["block"]] * b.num_rows, pa.int64()), pa.array([i] * b.num_rows, pa.int32())], names=["part", "c0", "c1", "block", "piece"])

    return table.select("codes", "lengths", "block").mapInArrow(run, _STRETCHES)


def _revcomp(x: np.ndarray, k: int) -> np.ndarray:
    return stretches.revcomp(x) >> np.uint64(2 * (BASES - k))


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of many batches together, so that a part gets many k-mers at once."""
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= BLOCK // 4:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _searched(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """np.searchsorted() of many values, in their order, which spares the memory's latency."""
    order = np.argsort(x)
    at = np.empty(len(x), np.int64)
    at[order] = np.searchsorted(keys, x[order])
    return at


def _set(kmers: DataFrame, k: int, parts: int) -> DataFrame:
    """K-mers (oriented ones) by part: the smaller of both strands, and which of them are meant (1: it, 2: the other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (x,) in _batched(batches):
            x = x.astype(np.uint64)
            back = _revcomp(x, k)
            canon, way = np.minimum(x, back), ((x <= back) | (x >= back) * 2).astype(np.uint8)
            b = stretches.blobs(part_of_kmers(canon, k, k, parts), canon, way)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([-1] * b.num_rows, pa.int64()), pa.array([0] * b.num_rows, pa.int32())], names=["part", "c0", "c1", "block", "piece"])

    return kmers.mapInArrow(run, _STRETCHES)


def part_of_kmers(x: np.ndarray, n: int, k: int, parts: int) -> np.ndarray:
    """The part of each n bases (in a long), as stretches.part_of() has it: the same on both strands, and for n = k that of a k-mer in a stretch."""
    m, u = min(k, stretches.M, max(n, 1)), np.uint32
    keep, back, least = np.uint64((1 << 2 * m) - 1), _revcomp(x, n) if n else x, None
    for s in range(max(n, 1) - m + 1):
        two = np.minimum((x >> np.uint64(2 * s) & keep).astype(u), (back >> np.uint64(2 * (max(n, 1) - m - s)) & keep).astype(u)) * u(0x9E3779B1)
        least = two if least is None else np.minimum(least, two)
    return ((least * u(0x85EBCA6B)) >> u(8)) % u(parts)


def met(table: DataFrame, kmers: DataFrame | None, k: int, both: bool, use: Callable, schema: str, least: int = 0, parts: int = 0, keep: bool = False):
    """What use(row, codes, lengths, flags) makes of each block: flags has for every place of its fragments, one after the other, whether its k-mer is
    in the set; with both, a second column says so of the reverse complement there. kmers has a column of longs, oriented if both; without
    it, the set is what occurs in all blocks at least so often (least), and a task holds the stretches of its part while it counts them. With
    keep, that set (keys, see unpacked_set()) is returned as well; it is written with what is found, so that k-mers are dealt out and counted once."""
    parts, planes = parts or stretches.parts_for(table.unionByName(kmers.select(F.lit(0).alias("block")), True)), 2 if both else 1
    counting = kmers is None
    if counting:
        sent = _sent(table, k, parts).repartitionById(parts, F.col("part"))
    else:
        sent = _sent(table, k, parts).unionByName(_set(kmers, k, parts)).repartitionById(parts, F.col("part")).sortWithinPartitions("block")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = entries(batches)
        if counting:
            rows = list(rows)
            keys, ways = occurring(rows)
            if keep and len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([_steps(keys)], pa.binary())], names=["block", "piece", "part", "bits"])
        else:
            held, first = [], None
            for first in rows:
                if first[0] >= 0:
                    break
                held.append(first[3:])
            if first is None or first[0] < 0:
                return
            (keys, ways), rows = united(held), chain([first], rows)
        for group in grouped(rows, BLOCK // 2):
            yield found(group, keys, ways)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            numbers = [batch.column(i).to_pylist() for i in (3, 4, 0)]
            for block, piece, part, a, b in zip(*numbers, batch.column(1), batch.column(2), strict=True):
                yield block, piece, part, np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint8)

    def grouped(rows, most: int) -> Iterator[list[tuple]]:
        group, n = [], 0
        for x in rows:
            group.append(x)
            n += int(x[4].sum())
            if n >= most:
                yield group
                group, n = [], 0
        if group:
            yield group

    def occurring(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        levels = []
        for group in grouped(rows, BLOCK):
            levels.append(stretches.counted(stretches.canons(np.concatenate([x[3] for x in group]), np.concatenate([x[4] for x in group]), k)))
            while len(levels) > 1 and len(levels[-2][0]) <= 2 * len(levels[-1][0]):
                merge(levels)
        while len(levels) > 1:
            merge(levels)
        keys = levels[0][0][levels[0][1] >= least] if levels else np.zeros(0, np.uint64)
        return keys, np.ones(len(keys), np.uint8)

    def merge(levels: list) -> None:
        (a, m), (b, n) = levels.pop(), levels.pop()
        levels.append(stretches.counted(np.concatenate([a, b]), np.concatenate([m, n])))

    def united(held: list) -> tuple[np.ndarray, np.ndarray]:
        if not held:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        keys, ways = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
        order = np.argsort(keys, kind="stable")
        keys, ways = keys[order], ways[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[start], np.bitwise_or.reduceat(ways, start)

    def found(group: list[tuple], keys: np.ndarray, ways: np.ndarray) -> pa.RecordBatch:
        here, back = stretches.strands(np.concatenate([x[3] for x in group]), np.concatenate([x[4] for x in group]), k)
        canon = np.minimum(here, back)
        flags = np.zeros((len(canon), planes), bool)
        if len(keys):
            at = np.minimum(_searched(keys, canon), len(keys) - 1)
            way = np.where(keys[at] == canon, ways[at], 0)
            if both:
                ahead = here <= back
                flags[:, 0], flags[:, 1] = way & np.where(ahead, 1, 2) > 0, way & np.where(ahead, 2, 1) > 0
            else:
                flags[:, 0] = way > 0
        n = np.array([int(x[4].sum()) for x in group]) * planes
        width = -(-n // 8)
        bits = np.zeros(int(width.sum()) * 8, np.uint8)
        bits[np.repeat(8 * (np.cumsum(width) - width) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = flags.ravel()
        offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(group), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(bits))])
        own = (pa.array([x[i] for x in group], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32())))
        return pa.RecordBatch.from_arrays([*own, data], names=["block", "piece", "part", "bits"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            codes, lengths = _opened(row)
            answers = {(x["piece"], x["part"]): x["bits"] for x in row["answers"]}
            flags = []
            for i, c, n in _pieces(codes, lengths, k):
                part, _, size = stretches.cut(c, n, k, parts)
                order = np.argsort(part.astype(np.uint16), kind="stable")
                size = size.astype(np.int64)
                first, part = (np.cumsum(size) - size)[order], part[order]
                start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                n = np.add.reduceat(size[order], start)
                bits = np.concatenate([np.unpackbits(np.frombuffer(answers[i, int(p)], np.uint8), count=int(m) * planes) for p, m in zip(part[start], n, strict=True)])
                size, out = size[order], np.zeros((int(size.sum()), planes), bool)
                out[np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(out))] = bits.reshape(-1, planes) > 0
                flags.append(out)
            batch = use(row, codes, lengths, np.concatenate(flags))
            if batch is not None and batch.num_rows:
                yield from (batch.slice(i, 20_000) for i in range(0, batch.num_rows, 20_000))

    answers = sent.mapInArrow(look, "block long, piece int, part int, bits binary")
    if keep:
        answers = written(answers)
        keys, answers = answers.where("block < 0").select(F.col("bits").alias("keys")), answers.where("block >= 0")
    answers = answers.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("piece", "part", "bits")).alias("answers"))
    found = table.repartition(parts, "block").join(answers, "block").mapInArrow(back, schema)
    return (found, keys) if keep else found


def _steps(keys: np.ndarray) -> bytes:
    return stretches.planes(np.diff(keys, prepend=np.uint64(0))) if len(keys) else b""


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The k-mers of a packed set, a part of the set at a time."""
    for batch in batches:
        for x in batch.column(0):
            yield np.cumsum(stretches.from_planes(x.as_py(), np.uint64), dtype=np.uint64)


def unpacked_set(keys: DataFrame) -> DataFrame:
    """canon: a row for each k-mer of a packed set, whose rows hold many in order, as steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _keys(batches):
            for i in range(0, len(x), BLOCK // 8):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + BLOCK // 8].view(np.int64))], names=["canon"])

    return keys.mapInArrow(run, "canon long")


def _strings(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_LETTERS[codes[at]])])


def _ids(row: dict, at: np.ndarray, columns: tuple[str, ...]) -> list[pa.Array]:
    return [pa.array(np.frombuffer(row[c], _IDS[c])[at]) for c in columns]


def valid_runs(frags: DataFrame, solid: DataFrame | None, k: int, least: int = 0, extra: int = 0, keep: bool = False):
    """read_id, frag_no, run_no and seq of the maximal runs of at least k k-mers in a row whose canon is among the solid ones. Without these, frags
    are reads, and solid is what occurs in their fragments at least so often; those of less than k + extra bases count, but have no runs. With keep, the
    solid k-mers are returned as well, as a packed set."""

    def use(row: dict, codes: np.ndarray, lengths: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
        n, on = lengths - k + 1, flags[:, 0]
        first = np.cumsum(n) - n
        edge = np.zeros(len(on) + 1, bool)
        edge[first] = edge[-1] = True
        off = np.concatenate([[False], on[:-1]])
        start = np.flatnonzero(on & (edge[:-1] | ~off))
        end = np.flatnonzero(on & (edge[1:] | ~np.concatenate([on[1:], [False]]))) + 1
        frag = np.searchsorted(first, start, "right") - 1
        keep = (end - start >= k) & (np.frombuffer(row["frag_no"], np.int32)[frag] >= 0)
        frag, start, size = frag[keep], start[keep], (end - start)[keep]
        new = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]]))[: len(frag)]
        no = np.arange(len(frag)) - np.repeat(new, np.diff(new, append=len(frag)))
        seq = _strings(codes, start + frag * (k - 1), size + k - 1)
        return pa.RecordBatch.from_arrays([*_ids(row, frag, ("read_id", "frag_no")), pa.array(no.astype(np.int32)), seq], names=["read_id", "frag_no", "run_no", "seq"])

    schema = "read_id long, frag_no int, run_no int, seq string"
    if solid is None:
        return met(blocks(frags.select("read_id", "seq"), k, extra), None, k, False, use, schema, least, stretches.parts_for(frags), keep)
    return met(blocks(frags.select("read_id", "frag_no", "seq"), k), solid.select("canon"), k, False, use, schema)


def _sites(codes: np.ndarray, lengths: np.ndarray, flags: np.ndarray, k: int, j: int) -> tuple[np.ndarray, ...]:
    """The fragment (its number in the block), tpos, to_end, kmer and ext of the flagged places of a block, where a scan looks."""
    u = np.uint64
    n = lengths - k + 1
    first = np.cumsum(n) - n
    at, turned = np.nonzero(flags)
    frag = np.searchsorted(first, at, "right") - 1
    pos = at - first[frag]
    tpos = 2 * pos + 1 - turned
    to_end = 2 * lengths[frag] - tpos - 2 * k + 1
    keep = (tpos >= 2 * j + 1) & (to_end >= 2 * j + 1)
    frag, tpos, to_end, turned, base = frag[keep], tpos[keep], to_end[keep], turned[keep], (at + frag * (k - 1))[keep]
    kmer = _kmers(codes, base, k)
    kmer = np.where(turned == 1, _revcomp(kmer, k), kmer).astype(np.int64)
    return frag, tpos, to_end, kmer, np.where(turned == 1, codes[np.maximum(base - 1, 0)] ^ 2, codes[np.minimum(base + k, len(codes) - 1)]).astype(np.int32)


def _kmers(codes: np.ndarray, base: np.ndarray, k: int) -> np.ndarray:
    kmer = np.zeros(len(base), np.uint64)
    for i in range(k):
        kmer = kmer << np.uint64(2) | codes[base + i].astype(np.uint64)
    return kmer


def sites_of(valid: DataFrame, keys: DataFrame, k: int, j: int) -> DataFrame:
    """Those rows of junctions.sites() whose oriented k-mer is among keys (kmer)."""
    columns = ("read_id", "frag_no", "run_no")

    def use(row: dict, codes: np.ndarray, lengths: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
        frag, tpos, to_end, kmer, ext = _sites(codes, lengths, flags, k, j)
        arrays = [*_ids(row, frag, columns), *(pa.array(x.astype(np.int32)) for x in (tpos, to_end)), pa.array(kmer), pa.array(ext)]
        return pa.RecordBatch.from_arrays(arrays, names=[*columns, "tpos", "to_end", "kmer", "ext"])

    schema = "read_id long, frag_no int, run_no int, tpos int, to_end int, kmer long, ext int"
    return met(blocks(valid.where(F.length("seq") >= k + 2 * j + 1).select(*columns, "seq"), k), keys.select("kmer"), k, True, use, schema)


#: Fragments (ids, and n, the number of their junctions) and their junctions (tpos, real and onward) as bytes, many fragments a row.
RESULTS = {"read_id": np.int64, "frag_no": np.int32, "run_no": np.int32, "n": np.int32, "tpos": np.int32, "real": np.int64, "onward": np.bool_}


def results_of(valid: DataFrame, keys: DataFrame, k: int, j: int) -> DataFrame:
    """What pairs.results() makes of sites_of() and the markers of junctions.fake_junctions(), in blocks of whole fragments (see RESULTS) with their
    number, block; written. Junctions of a fragment follow each other by tpos."""
    u = np.uint64

    def use(row: dict, codes: np.ndarray, lengths: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
        frag, tpos, _, kmer, ext = _sites(codes, lengths, flags, k, j)
        bare = np.flatnonzero(np.bincount(frag, minlength=len(lengths)) == 0)
        base = (np.cumsum(lengths) - lengths)[bare] + lengths[bare] // 2 - k // 2
        frag, tpos = np.concatenate([frag, bare]), np.concatenate([tpos, np.zeros(len(bare), np.int64)])
        kmer, ext = np.concatenate([kmer.astype(u), _kmers(codes, base, k)]), np.concatenate([ext, codes[np.minimum(base + k, len(codes) - 1)]])
        onward = tpos & 1 == 1
        onward[len(onward) - len(bare) :] = True
        order = np.lexsort((tpos, frag))
        real = (kmer << u(2) | ext.astype(u)) & u((1 << 2 * k) - 1)
        found = {"n": np.bincount(frag, minlength=len(lengths)), "tpos": tpos[order], "real": real[order], "onward": onward[order]}
        values = [row[c] if c in row else found[c].astype(t).tobytes() for c, t in RESULTS.items()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=list(RESULTS))

    whole = met(blocks(valid.select("read_id", "frag_no", "run_no", "seq"), k), keys.select("kmer"), k, True, use, ", ".join(f"{c} binary" for c in RESULTS))
    return written(whole.withColumn("block", F.monotonically_increasing_id()))


def masks(kmers: DataFrame, k: int, canons: bool = False, silent: str | None = None, branching: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """kmer and mask of every k-mer: bit b is set if its last k - 1 bases and base b make one of them too. kmers is a column of different oriented
    k-mers, or a packed set of them (keys); with canons it has one of each two strands and both are meant. Where the column silent is true, a k-mer
    extends no other. With branching, only k-mers with none or several extensions have a row; with asked (keys, packed sets that may overlap), only
    these k-mers, which are taken as they are oriented."""
    parts, u = stretches.parts_for(kmers), np.uint64
    keep, low = u((1 << 2 * k) - 1), u((1 << 2 * (k - 1)) - 1)

    packed, only = kmers.columns == ["keys"], asked is not None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, *ends in ((x,) for x in _keys(batches)) if packed else _batched(batches):
            x = x.astype(u)
            stem, tail = part_of_kmers(x >> u(2), k - 1, k, parts), part_of_kmers(x & low, k - 1, k, parts)
            speaks = ~ends[0].astype(bool) if ends else np.ones(len(x), bool)
            same = stem == tail
            two = speaks & ~same
            rows = np.concatenate([x | FROM_TAIL | np.where(speaks & same, FROM_STEM, u(0)), x[two] | FROM_STEM])
            yield stretches.blobs(np.concatenate([tail, stem[two]]), rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _keys(batches):
            yield stretches.blobs(part_of_kmers(x & low, k - 1, k, parts), x)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_buffer(), u) for batch in batches for x in batch.column(1)]
        if not held:
            return
        x = np.concatenate(held)
        stem, tail, x = x & FROM_STEM > 0, x & FROM_TAIL > 0, x & keep
        sources, meant = x[stem], x[tail]
        if canons:
            back = _revcomp(x, k)
            other = back != x
            sources, meant = np.concatenate([sources, back[tail & other]]), np.concatenate([meant, back[stem & other]])
        if only:
            meant = np.unique(x[~stem & ~tail])
        sources = np.sort(sources)
        ends = sources >> u(2)
        start = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))[: len(ends)]
        mask = np.zeros(len(meant), np.int32)
        if len(ends):
            bits = np.bitwise_or.reduceat(np.left_shift(np.int32(1), (sources & u(3)).astype(np.int32)), start)
            ends = ends[start]
            at = np.minimum(_searched(ends, meant & low), len(ends) - 1)
            mask = np.where(ends[at] == meant & low, bits[at], 0).astype(np.int32)
        if branching:
            some = (mask == 0) | (mask & (mask - 1) != 0)
            meant, mask = meant[some], mask[some]
        for i in range(0, len(meant), BLOCK // 8):
            yield pa.RecordBatch.from_arrays([pa.array(meant[i : i + BLOCK // 8].view(np.int64)), pa.array(mask[i : i + BLOCK // 8])], names=["kmer", "mask"])

    rows = kmers if packed else kmers.select(F.col(kmers.columns[0]).alias("kmer"), *([F.col(silent)] if silent else []))
    sent = rows.mapInArrow(deal, "part int, c0 binary")
    if only:
        sent = sent.unionByName(asked.select("keys").mapInArrow(ask, "part int, c0 binary"))
    return sent.repartitionById(parts, F.col("part")).mapInArrow(meet, "kmer long, mask int")


def rescued(frags: DataFrame, counts: DataFrame, k: int, least: int) -> DataFrame:
    """canon (with repeats) of the k-mers that occur less than `least` times but lie on a fragment (seq) between two that occur so often, neither of
    which has more than one continuation towards them. counts: canon and cnt of all k-mers of the fragments.

    First the places of k-mers that occur so often are found, by a count of the blocks, and stay with the block; then of the k-mers at both ends of its
    gaps, each in the direction of the gap, those that have one continuation."""

    def gaps(lengths: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The places between two strong ones of a fragment, these two, and the first place of each fragment."""
        n = lengths - k + 1
        first, at = np.cumsum(n) - n, np.arange(len(on))
        start = np.repeat(first, n)
        left = np.maximum.accumulate(np.where(on, at, -1))
        right = np.minimum.accumulate(np.where(on, at, len(on))[::-1])[::-1]
        gap = at[~on & (left >= start) & (right < start + np.repeat(n, n))]
        return gap, left[gap], right[gap], first

    def there(codes: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _kmers(codes, at + (np.searchsorted(first, at, "right") - 1) * (k - 1), k)

    def strong(row: dict, codes: np.ndarray, lengths: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
        _, left, right, first = gaps(lengths, flags[:, 0])
        ends = np.unique(np.concatenate([there(codes, np.unique(left), first), _revcomp(there(codes, np.unique(right), first), k)]))
        values = row["codes"], row["lengths"], np.packbits(flags[:, 0]).tobytes(), _steps(ends)
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["codes", "lengths", "strong", "keys"])

    def use(row: dict, codes: np.ndarray, lengths: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
        gap, left, right, first = gaps(lengths, np.unpackbits(np.frombuffer(row["strong"], np.uint8), count=len(flags)) > 0)
        kmer = there(codes, gap[flags[left, 0] & flags[right, 1]], first)
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(kmer, _revcomp(kmer, k))).astype(np.int64))], names=["canon"])

    schema = "codes binary, lengths binary, strong binary, keys binary"
    own = met(blocks(frags.select("seq"), k), None, k, False, strong, schema, least, stretches.parts_for(frags))
    table = written(own.withColumn("block", F.monotonically_increasing_id()))
    one = masks(counts.select("canon"), k, canons=True, asked=table.where("octet_length(keys) > 0")).where("bit_count(mask) = 1").select("kmer")
    return met(table.drop("keys"), one, k, True, use, "canon long")
