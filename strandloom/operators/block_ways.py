"""Ways between junctions from blocks of fragments: no row a site, and no text of a way but of those that stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stretches
from .places import _sites, _strings, blocks, met, packed, unpacked

BACK = 4
#: What a way has besides its sequence (bases, and how many they are).
_COLUMNS = {"kmer": np.int64, "index": np.uint8, "linked": np.uint8, "dist": np.int32, "far": np.int64, "far_index": np.uint8, "bases": np.int32}
_SENT = ", ".join(["part int", *(f"{c} binary" for c in (*_COLUMNS, "seq"))])


def _gathered(codes: np.ndarray, start: np.ndarray, size: np.ndarray, room: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The bases of many pieces, each with room for some more; of the last `back` ones the reverse complement."""
    at = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room)
    n, turned = np.repeat(size, room), np.repeat(back, room)
    base = np.repeat(start, room) + np.where(turned, n - 1 - at, at)
    inside = at < n
    return np.where(inside, codes[np.where(inside, base, 0)] ^ (2 * turned).astype(np.uint8), 0).astype(np.uint8)


def _longest(x: dict[str, np.ndarray]) -> np.ndarray:
    """Which rows stay: of each kmer and index a linked one, or else the one of the largest distance."""
    order = np.lexsort((x["dist"], x["linked"], x["index"], x["kmer"]))
    kmer, index = x["kmer"][order], x["index"][order]
    last = np.ones(len(order), bool)
    last[:-1] = (kmer[1:] != kmer[:-1]) | (index[1:] != index[:-1])
    return order[last]


def ways(valid: DataFrame, keys: DataFrame, k: int, j: int) -> DataFrame:
    """What walks.ways() makes of the sites of valid fragments whose oriented k-mers are among keys (kmer). A block keeps one row for each way;
    they meet in the part of their k-mer."""
    columns = ("read_id", "frag_no", "run_no")
    table = blocks(valid.where(F.length("seq") >= k + 2 * j + 1).select(*columns, "seq"), k)
    parts = stretches.parts_for(table)

    def use(row: dict, codes: np.ndarray, lengths: np.ndarray, flags: np.ndarray) -> pa.RecordBatch | None:
        frag, tpos, to_end, kmer, ext = _sites(codes, lengths, flags, k, j)
        if not len(frag):
            return None
        order = np.lexsort((tpos, frag))
        frag, tpos, to_end, kmer, ext = (x[order] for x in (frag, tpos, to_end, kmer, ext))
        ahead, pos, one = tpos & 1 == 1, tpos >> 1, np.arange(len(frag))
        onward, back = np.where(ahead, ext, BACK), np.where(ahead, BACK, ext)
        more, less = np.zeros(len(frag), bool), np.zeros(len(frag), bool)
        more[:-1] = less[1:] = frag[1:] == frag[:-1]
        next_, last = np.where(more, one + 1, one), np.where(less, one - 1, one)
        n, first = lengths[frag], (np.cumsum(lengths) - lengths)[frag]
        to, since = np.where(more, pos[next_], n - k - j), np.where(less, pos[last], j)
        two = lambda a, b: np.concatenate([a, b])
        x = {
            "kmer": two(kmer, kmer), "index": two(onward, back), "linked": two(more, less), "dist": two(np.where(more, tpos[next_] - tpos, to_end - 2 * j), np.where(less, tpos - tpos[last], tpos - 2 * j)),
            "far": two(kmer[next_], kmer[last]), "far_index": two(back[next_], onward[last]), "bases": two(to - pos + k, pos - since + k),
        }
        start, turned = two(first + pos, first + since), two(np.zeros(len(frag), bool), np.ones(len(frag), bool))
        stays = _longest(x)
        part = ((x["kmer"][stays].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part, stays = part[order], stays[order]
        size = x["bases"][stays]
        room = size + -size % 4
        seq = packed(_gathered(codes, start[stays], size, room, turned[stays]))
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(at, len(part))
        arrays = [pa.array(part[at].astype(np.int32))]
        for c, t in _COLUMNS.items():
            arrays.append(_cut(x[c][stays].astype(t).tobytes(), ends * np.dtype(t).itemsize))
        arrays.append(_cut(seq, np.concatenate([[0], np.cumsum(room)])[ends] // 4))
        return pa.RecordBatch.from_arrays(arrays, names=["part", *_COLUMNS, "seq"])

    def _cut(data: bytes, ends: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, first, n = [], [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in _COLUMNS.items()}
                room = own["bases"].astype(np.int64)
                room += -room % 4
                held.append(own)
                first.append(n + np.cumsum(room) - room)
                n += int(room.sum())
                texts.append(np.frombuffer(batch.column("seq")[i].as_buffer(), np.uint8))
        if not held:
            return
        x = {c: np.concatenate([y[c] for y in held]) for c in _COLUMNS}
        stays, first, codes = _longest(x), np.concatenate(first), unpacked(np.concatenate(texts), n)
        for i in range(0, len(stays), 20_000):
            w = stays[i : i + 20_000]
            one = x["linked"][w] == 0
            arrays = [pa.array(x["kmer"][w]), pa.array(x["index"][w].astype(np.int32)), pa.array(~one), pa.array(x["dist"][w]), pa.array(x["far"][w], mask=one), pa.array(x["far_index"][w].astype(np.int32), mask=one)]
            yield pa.RecordBatch.from_arrays([*arrays, _strings(codes, first[w], x["bases"][w].astype(np.int64))], names=["kmer", "index", "linked", "dist", "far", "far_index", "seq"])

    sent = met(table, keys.select("kmer"), k, True, use, _SENT)
    return sent.repartitionById(parts, F.col("part")).mapInArrow(unite, "kmer long, index int, linked boolean, dist int, far long, far_index int, seq string")
