"""Byte-level BPE by replaying the merges over a vocabulary of words."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, table

#: Characters of text whose words are replayed together, and words that a task remembers from block to block.
BLOCK_CHARS, KEPT_WORDS = 6_000_000, 250_000
_LOADED: dict[tuple[str, str], MergeReplay] = {}


class MergeReplay:
    """Ranks of a byte-level BPE vocabulary, with encode and decode of words."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes = {r: b for b, r in self.rank.items()}
        self.byte = [self.rank[bytes([i])] for i in range(256)]
        self.words = regex.compile(pattern).findall
        self.pairs: dict[int, int] = {}  # left << 32 | right -> rank of what the two make
        for whole, r in self.rank.items():
            for i in range(1, len(whole)):
                left, right = self.rank.get(whole[:i]), self.rank.get(whole[i:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = r
        self.byte_or_end = np.array(self.byte, np.int64)
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(self.pairs.values(), np.int64, len(keys))[order]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word.

        All words lie in one row of positions, linked to their neighbours within the word. An index has the positions
        of each mergeable pair by the pair's rank. Ranks are replayed in rising order from a heap; a merge touches its two
        neighbours only, whose new pairs join the index. All positions of a rank merge as one array. A
        word in which a merge makes a pair of a lower rank than the one at hand (no trained vocabulary is known to need it) is
        encoded anew by itself, lowest pair first.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] + 1
        token = self.byte_or_end[np.frombuffer(b"".join([b"\0", *(w + b"\0" for w in words)]), np.uint8)]
        token[0] = -1
        token[starts + sizes] = -1
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        found = np.append(self.ranks_of(token[:-1], token[1:]), -1)
        index: dict[int, list[np.ndarray]] = {}
        self._enter(index, found, np.flatnonzero(found >= 0))
        heap = list(index)
        heapq.heapify(heap)
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            p = np.unique(np.concatenate(index.pop(r)))
            p = p[found[p] == r]
            q = after[p]
            if (found[q] == r).any():  # pairs that overlap: leftmost first
                taken, stay = set(), []
                for i, j in zip(p.tolist(), q.tolist()):
                    stay.append(i not in taken)
                    if stay[-1]:
                        taken.add(j)
                p, q = p[stay], q[stay]
            if not len(p):
                continue
            right = after[q]
            token[p], token[q], found[q], after[p], before[right] = r, -2, -1, right, p
            left = before[p]
            found[p], found[left] = self.ranks_of(token[p], token[right]), self.ranks_of(token[left], token[p])
            touched = np.concatenate([p, left])
            touched = touched[found[touched] >= 0]
            odd.append(touched[found[touched] < r])
            for new in self._enter(index, found, touched):
                heapq.heappush(heap, new)
        left = token[token != -2]
        ends = np.flatnonzero(left == -1)
        left = left.tolist()
        ids = [left[a + 1 : b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        for i in np.unique(np.searchsorted(starts, np.concatenate(odd), "right") - 1).tolist() if odd else ():
            ids[i] = self.encode_alone(words[i])
        return ids

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    @staticmethod
    def _enter(index: dict[int, list], found: np.ndarray, at: np.ndarray) -> list[int]:
        """Adds positions to the index; returns the ranks that are new to it."""
        if not len(at):
            return []
        at = at[np.argsort(found[at], kind="stable")]
        ranks = found[at]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        fresh = []
        for r, group in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if r in index:
                index[r].append(group)
            else:
                index[r] = [group]
                fresh.append(r)
        return fresh

    def encode_alone(self, word: bytes) -> list[int]:
        """One word by the definition: its lowest-ranked pair first, the leftmost of equals."""
        ids = [self.byte[c] for c in word]
        while len(ids) > 1:
            best = min((self.pairs.get(a << 32 | b, 1 << 62), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if best[0] == 1 << 62:
                break
            ids[best[1] : best[1] + 2] = [best[0]]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def loaded(path: str, pattern: str) -> MergeReplay:
    """The vocabulary, read once by each Python worker from the place where every machine has it installed."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = MergeReplay(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row (with_ids: and ids), in one pass without a shuffle.

    The corpus is replayed in blocks of whole texts, each over its distinct words, so that a task's memory is bounded and
    a word costs one replay a block, however often it occurs. A null or empty text has no tokens. A text longer than a
    block makes a block by itself. Rows that repeat are encoded alike; other columns are not read.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = loaded(path, pattern), _Words()
        for doc_ids, texts in _blocks(batches, lambda t: np.fromiter(map(known.__getitem__, bpe.words(t)), np.int32)):
            known.encode(bpe)
            size, ids, decoded = np.array(known.size, np.int64), known.ids, known.bytes
            n, joined, raw = [], [], []
            for words in texts:
                n.append(int(size[words].sum()))
                joined.append(",".join([ids[w] for w in words.tolist()]))
                raw.append(hashlib.sha256(b"".join([decoded[w] for w in words.tolist()])).hexdigest())
            cols = [doc_ids, n, [hashlib.sha256(x.encode()).hexdigest() for x in joined], raw] + [[[int(i) for i in x.split(",") if i] for x in joined]] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [f for f, _ in fields])
            if len(known) > KEPT_WORDS:
                known.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text").mapInArrow(run, schema)


class _Words(dict):
    """Numbers of words, and by number what their encoding comes to; words are numbered when they are first looked up."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.size: list[int] = []
        self.ids: list[str] = []
        self.bytes: list[bytes] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        n = self[word] = len(self)
        return n

    def encode(self, bpe: MergeReplay) -> None:
        for ids in bpe.encode_words([w.encode() for w in self.fresh]):
            self.size.append(len(ids))
            self.ids.append(",".join(map(str, ids)))
            self.bytes.append(bpe.decode(ids))
        self.fresh = []

    def forget(self) -> None:
        self.clear()
        self.__init__()


def _blocks(batches: Iterator[pa.RecordBatch], split) -> Iterator[tuple[list, list]]:
    """Ids and split texts, some BLOCK_CHARS at a time."""
    ids, texts, size = [], [], 0
    for b in (x for batch in batches for x in pieces(batch)):
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            ids.append(i)
            texts.append(split(t))
            size += len(t)
            if size >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
