"""Paths of windows: how the two substring operators cut texts, and what must be compared with what.

A window is `width` units (words or bytes) in a row. Its anchor is the place of the smallest hash among the seeds (runs of
`seed` units) that it holds, the first of equals. Equal windows have equal anchors at the same place within, wherever they
stand. A path is a maximal run of windows of one text that share their anchor; so all places of a window lie in paths of
one and the same seed, and a text of n units has about 2 n / (width - seed + 2) paths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, written

_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.uint64(24)  # low bits of an anchor's key: its place among units hashed together
MOST_UNITS = 1 << 20  # of texts hashed together; a longer text is hashed in pieces that overlap


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as long as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(n, base & _MASK, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Of units (uint64, well mixed) times the base's powers; from them span_hash has the hash of any run."""
    up, _ = POWERS.to(len(units) + 1)
    out = np.zeros(len(units) + 1, np.uint64)
    np.add.accumulate(units * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the units from start to end (exclusive); the length is part of it."""
    _, down = POWERS.to(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def windows_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` keys in a row."""
    have = 1
    while have * 2 <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if have < width else keys


def paths(units: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """(seed hash, path hash, first window, number of windows) of each path of one text; nothing for a text of fewer than
    `width` units. A text longer than MOST_UNITS is cut into pieces that share width - 1 units, which loses no window."""
    out = []
    for at in range(0, max(len(units) - width + 1, 0), MOST_UNITS):
        sums = prefix_sums(units[at : at + MOST_UNITS + width - 1])
        n = len(sums) - 1
        places = np.arange(n - seed + 1)
        seeds = span_hash(sums, places, places + seed)
        keys = (seeds >> _PLACE << _PLACE) | places.astype(np.uint64)
        anchor = windows_min(keys, width - seed + 1)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(first, len(anchor)))
        place = (anchor[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
        out.append((seeds[place], span_hash(sums, first, first + count + width - 1), first + at, count))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out)) if len(out) > 1 else out[0]


# --- the same work over all texts -------------------------------------------------------------------------------------

#: Bytes of input for which one range of hashes is made, paths or windows that a task gathers before it packs them.
RANGE_BYTES, BLOCK_RECORDS = 4_000_000, 150_000
_RECORD = [("seed", np.uint64), ("name", np.uint64), ("key", np.int64), ("start", np.int32), ("n", np.int32), ("tag", np.uint32), ("flag", np.uint8)]
#: Different paths at a seed from which on its windows are dealt out one by one, and not together.
HOT_PATHS = 256
_PACKED = "range long, records binary, done binary"
#: key of a text; its runs of windows, as pairs of 4-byte numbers (first window, windows), or, to be opened, as _RUN.
_SPANS = "key long, open boolean, spans binary"


def repeated(docs: DataFrame, units_of, width: int, seed: int, first_stays: bool) -> DataFrame:
    """key and spans of every text (key, text) that holds windows which occur more than once: with first_stays all but the
    first of each (smallest key, then earliest), else all of them. spans: a list of packed runs of such windows.

    1. Tasks cut texts into paths, settle equal ones of their own block, and pack one of each by ranges of the seed's hash.
    2. A range sorts its paths. A seed met once: its windows are unique, and gone. Equal paths repeat as a whole. Where
       different paths share a seed, one of each is opened.
    3. Opened paths go back to their texts and are packed window by window: those of one seed together, so that windows in a row
       stay runs, but where very many paths share the seed by ranges of each window's own hash. Again blocks are settled
       before they are sent, so that no window, however common, brings a range more than one record a block.
    4. A range sorts its windows.
    Only hashes and coordinates move in 1, 2 and 4; a path's 64-bit hash counts only together with its seed's.
    """
    spark = docs.sparkSession
    estimate = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()  # follows the files' size
    n_ranges = max(-(-int(estimate) // RANGE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_ranges = min(n_ranges, 1 << 24)

    def pack_paths(batches):
        parts, size = [], 0
        for b in (x for batch in batches for x in pieces(batch)):
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                s, p, first, count = paths(units_of(text), width, seed)
                if len(s):
                    parts.append((s, p, np.full(len(s), key), first, count, _tag(s)))
                    size += len(s)
                if size >= BLOCK_RECORDS:
                    yield _pack(_records(parts), n_ranges, first_stays)
                    parts, size = [], 0
        if parts:
            yield _pack(_records(parts), n_ranges, first_stays)

    def settle_paths(group: pd.DataFrame) -> pd.DataFrame:
        r, done = _unpack(group)
        r, heads, covered, many = _settled(r, first_stays)
        at = np.flatnonzero(_new(r["seed"]))
        kinds = np.repeat(np.add.reduceat(heads.astype(int), at), np.diff(np.append(at, len(r)))) if len(r) else heads.astype(int)
        opened = heads & (kinds > 1)
        return pd.concat([_spans(np.concatenate([done, _span_rows(r[covered])])), _opened(r[opened], many[opened], kinds[opened] > HOT_PATHS)])

    def pack_windows(batches):
        parts, size = [], 0
        for b in (x for batch in batches for x in pieces(batch)):
            for key, text, runs in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist()):
                units = units_of(text)
                runs = np.concatenate([np.frombuffer(x, _RUN) for x in runs])
                runs = runs[np.argsort(runs["start"])]
                for k in range(0, len(runs), 4096):  # a very long text goes in parts
                    some = runs[k : k + 4096]
                    first, n = some["start"].astype(np.int64), some["n"]
                    low, high = int(first[0]), int((first + n).max()) + width - 1
                    sums = prefix_sums(units[low:high])
                    at = np.repeat(first - low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    half = span_hash(sums, at, at + width // 2)
                    rest = span_hash(sums, at + width // 2, at + width)
                    name = mixed(half * np.uint64(_BASE) + rest)
                    hot = np.repeat(some["hot"], n)
                    tag = np.where(hot > 0, _tag(name), np.repeat(some["tag"], n))
                    parts.append((half, name, np.full(len(at), key), at + low, np.ones(len(at), np.int32), tag, np.repeat(some["many"], n)))
                    size += len(at)
                    if size >= BLOCK_RECORDS:
                        yield _pack(_records(parts), n_ranges, first_stays)
                        parts, size = [], 0
        if parts:
            yield _pack(_records(parts), n_ranges, first_stays)

    def settle_windows(group: pd.DataFrame) -> pd.DataFrame:
        r, done = _unpack(group)
        r, _, covered, _ = _settled(r, first_stays)
        return _spans(np.concatenate([done, _span_rows(r[covered])]))

    packed = docs.select("key", "text").mapInArrow(pack_paths, _PACKED)
    found = written(packed.groupBy("range").applyInPandas(settle_paths, _SPANS))
    opened = found.where("open").groupBy("key").agg(F.collect_list("spans").alias("runs"))
    packed = docs.select("key", "text").join(opened, "key").mapInArrow(pack_windows, _PACKED)
    more = written(packed.groupBy("range").applyInPandas(settle_windows, _SPANS))
    return found.where("not open").unionByName(more).groupBy("key").agg(F.collect_list("spans").alias("spans"))


def _records(parts: list[tuple]) -> np.ndarray:
    cols = [np.concatenate(x) for x in zip(*parts)]
    out = np.zeros(len(cols[0]), _RECORD)
    for (name, _), x in zip(_RECORD, cols):
        out[name] = x
    return out


def _new(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]


def _settled(r: np.ndarray, first_stays: bool) -> tuple[np.ndarray, ...]:
    """The records sorted by seed, name, key and start, and for each: whether it is the first of its kind, whether its windows
    are to go, and whether its kind is known to occur more than once. flag: the record stands for several, or for windows
    that are settled already and only count for others."""
    r = r[np.lexsort((r["start"], r["key"], r["name"], r["seed"]))]
    heads = _new(r["seed"]) | _new(r["name"])
    if first_stays:
        return r, heads, ~heads, np.zeros(len(r), bool)
    at = np.flatnonzero(heads)
    size = np.diff(np.append(at, len(r)))
    many = np.repeat((size > 1) | (np.maximum.reduceat(r["flag"], at) > 0), size) if len(r) else heads
    return r, heads, many & (r["flag"] == 0), many


def _tag(hashes: np.ndarray) -> np.ndarray:
    """What decides the range: the hash mixed anew, as seeds are the smallest of many and so small themselves."""
    return (mixed(hashes) >> np.uint64(32)).astype(np.uint32)


def _pack(r: np.ndarray, n_ranges: int, first_stays: bool) -> pa.RecordBatch:
    r, heads, covered, many = _settled(r, first_stays)
    # a kind met only once in the block is settled later; one met again leaves its first record, to stand for it
    if not first_stays:
        covered &= np.repeat(np.diff(np.append(np.flatnonzero(heads), len(r))) > 1, np.diff(np.append(np.flatnonzero(heads), len(r)))) if len(r) else heads
    done = _merged(_span_rows(r[covered]))
    kept = r[heads]
    if not first_stays:
        kept["flag"] = many[heads]
    at = (kept["tag"].astype(np.uint64) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((kept["start"], kept["key"], at))
    kept, at = kept[order], at[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    starts = [0, *cuts]
    shares = np.array_split(done, len(starts))  # what is settled already travels with all ranges alike
    rows = [(int(at[a]), _columns(kept[a:b]), d.tobytes()) for a, b, d in zip(starts, [*cuts, len(kept)], shares)]
    ranges, records, dones = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(records, pa.binary()), pa.array(dones, pa.binary())], ["range", "records", "done"])


def _columns(r: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(r[name]).tobytes() for name, _ in _SENT)


_SENT = [x for x in _RECORD if x[0] != "tag"]  # a path's follows from its seed, a window's has done its work
_SIZE = sum(np.dtype(t).itemsize for _, t in _SENT)
_ROW = np.dtype([("key", np.int64), ("start", np.int32), ("n", np.int32)])


def _unpack(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(sum(map(len, group["records"])) // _SIZE, _RECORD)
    i = 0
    for blob in group["records"]:
        n, at = len(blob) // _SIZE, 0
        for name, t in _SENT:
            out[name][i : i + n] = np.frombuffer(blob, t, n, at)
            at += n * np.dtype(t).itemsize
        i += n
    out["tag"] = _tag(out["seed"])
    return out, np.frombuffer(b"".join(group["done"]), _ROW)


def _span_rows(r: np.ndarray) -> np.ndarray:
    out = np.zeros(len(r), _ROW)
    for name in _ROW.names:
        out[name] = r[name]
    return out


_RUN = np.dtype([("start", np.int32), ("n", np.int32), ("tag", np.uint32), ("many", np.uint8), ("hot", np.uint8)])


def _opened(r: np.ndarray, many: np.ndarray, hot: np.ndarray) -> pd.DataFrame:
    """Runs to be opened. many: they are settled already and only count for others."""
    runs = np.zeros(len(r), _RUN)
    for name in ("start", "n", "tag"):
        runs[name] = r[name]
    runs["many"], runs["hot"] = many, hot
    order = np.lexsort((r["start"], r["key"]))
    runs, key = runs[order], r["key"][order]
    at = np.flatnonzero(_new(key))
    return pd.DataFrame({"key": key[at], "open": True, "spans": [runs[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(runs)))]})


def _merged(rows: np.ndarray) -> np.ndarray:
    """Runs of windows in order, those that touch or overlap made one."""
    rows = rows[np.lexsort((rows["start"], rows["key"]))]
    if not len(rows):
        return rows
    end = rows["start"].astype(np.int64) + rows["n"]
    # an end counts for the runs after it in its text: running maxima by text, as texts come in order
    text = np.cumsum(_new(rows["key"]))
    reach = np.maximum.accumulate(end + (text << 33)) - (text << 33)
    at = np.flatnonzero(_new(rows["key"]) | np.concatenate([[True], rows["start"][1:] > reach[:-1]]))
    out = rows[at]
    out["n"] = np.maximum.reduceat(end, at) - out["start"]
    return out


def _spans(rows: np.ndarray) -> pd.DataFrame:
    rows = _merged(rows)
    at = np.flatnonzero(_new(rows["key"]))
    pairs = np.stack([rows["start"], rows["n"]], 1)
    blobs = [pairs[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(rows)))]
    return pd.DataFrame({"key": rows["key"][at], "open": False, "spans": blobs})


def covered_units(n_units: int, spans, width: int) -> np.ndarray:
    """Which units the windows of the packed runs cover."""
    out = np.zeros(n_units + 1, np.int64)
    for blob in spans or ():
        run = np.frombuffer(blob, np.int32).reshape(-1, 2).astype(np.int64)
        np.add.at(out, run[:, 0], 1)
        np.add.at(out, run[:, 0] + run[:, 1] + width - 1, -1)
    return np.cumsum(out[:-1]) > 0
