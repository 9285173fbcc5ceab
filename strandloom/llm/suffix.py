"""Substring dedup over bytes by grouping windows by the hash of their anchor, in place of prefix doubling."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ordered, pieces, table
from .paths import covered_units, mixed, repeated

THRESHOLD = 200
_UNIT = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_units(text: str) -> np.ndarray:
    return _UNIT[np.frombuffer(text.encode(), np.uint8)]


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (with_text: and kept, the remaining bytes) of every row.

    Windows of `threshold` bytes are grouped by the hash of their anchor, a place within them that is chosen by content alone
    (paths.repeated): windows whose anchor's seed, threshold // 2 bytes, is met once are unique. Runs of windows with
    equal text are settled as a whole. What is left is told apart by two hashes, of a window's first half and of the other. No
    ranks are made and none sorted in rounds: this takes the place of prefix doubling (README, with figures).

    A null text has no bytes, and a shorter text than the threshold keeps all. Rows that repeat are texts of their own.
    """
    docs = ordered(docs)
    spans = repeated(docs, byte_units, threshold, max(1, threshold // 2), False)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch)):
            rows = []
            for i, text, found in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist()):
                kept = raw = text.encode()
                n_spans = 0
                if found:
                    gone = covered_units(len(raw), found, threshold)
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((i, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept)[: 5 + with_text])
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            cols = list(zip(*rows)) or [()] * (5 + with_text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
