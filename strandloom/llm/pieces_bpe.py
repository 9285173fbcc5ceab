"""SentencePiece's BPE by rounds of merges over flat arrays of symbols."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import KEPT_WORDS, _blocks
from .common import table

#: Characters whose symbols lie in one set of arrays, and the rank of pairs that make no piece.
CHUNK_CHARS, NONE = 1_000_000, 1 << 40
SPACE = "▁"
_LOADED: dict[str, MergeRounds] = {}


class MergeRounds:
    """A SentencePiece BPE model with byte fallback and without a normaliser of its own: encode and decode.

    A symbol is a piece or a single character; a pair of symbols may merge if their strings together are a piece, best score
    first and from the left among equals. The numbers of symbols are the pieces' ids, then characters that are in pieces only.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if sp.normalize(" a  Å ") != SPACE + " a  Å ".replace(" ", SPACE):
            raise ValueError("the model normalises texts in a way that is not carried out here")
        own = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in own):
            raise ValueError("pieces that are not to be used are not carried out here")
        self.id = {sp.id_to_piece(i): i for i in own}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if sum(map(sp.is_byte, range(n))) != 256:
            raise ValueError("a model without bytes for unknown characters is not carried out here")
        number = dict(self.id)
        for piece in self.id:
            for c in piece:
                number.setdefault(c, n + len(number))
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in own}, reverse=True))}
        pairs, near = {}, set()
        for piece, i in self.id.items():
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                near.add((ord(piece[cut - 1]) << 21) | ord(piece[cut]))
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (order[sp.get_score(i)], i)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        by_key = np.argsort(keys)
        self.pair_keys = keys[by_key]
        self.pair_rank, self.pair_id = np.array([pairs[x] for x in self.pair_keys.tolist()], np.int64).T
        #: Two characters that stand next to each other in some piece; between others nothing ever merges.
        self.near = np.array(sorted(near), np.int64)
        self.symbol = np.full(0x110000, -1, np.int64)
        for s, i in number.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        self.decoded = [b""] * n
        for i in own:
            self.decoded[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            self.decoded[i] = bytes([b])
        inner = {c for p in self.id if len(p) > 1 for c in p}
        apart = "".join(re.escape(c) for c in map(chr, range(32)) if c not in inner)
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            self.words = lambda text: [text]
        else:  # a word starts at its spaces; control characters are words of their own where no piece has them
            self.words = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + f"|[{apart}]" * bool(apart)).findall

    def normalised(self, text: str) -> str:
        return (" " + text).replace(" ", SPACE) if text else ""

    def merged(self, codes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of a row of characters, and the place that each one starts at; cut marks places where a word starts.

        A round: every pair's rank is known, each word's smallest is its segment's minimum, and all places that have it merge
        at once, from the left where they overlap. Symbols are then moved together, new pairs looked up, and words without
        pairs leave. If merges of one round make a pair of their rank or a better one, which order by order would have come
        in between, the word is done over by `alone`.
        """
        token = self.symbol[codes]
        start = np.arange(len(codes))
        between = np.concatenate([[False], _within(self.near, codes[:-1] << 21 | codes[1:])]) & ~cut
        word = np.cumsum(~between) - 1
        first = np.flatnonzero(~between)
        done_token, done_start, odd = [], [], []
        rank = self.ranks(token, word)
        while len(token):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(heads, len(word)))
            least = np.minimum.reduceat(rank, heads)
            over = np.repeat(least == NONE, sizes)
            done_token.append(token[over])
            done_start.append(start[over])
            hit = (rank == np.repeat(least, sizes)) & ~over
            # overlapping pairs: every other one of a run, from its left end
            at = np.flatnonzero(hit)
            run = np.concatenate([[True], np.diff(at) != 1]) if len(at) else np.zeros(0, bool)
            nth = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1] if len(at) else at
            at = at[nth % 2 == 0]
            token[at] = self.pair_id[_place(self.pair_keys, token[at] << 32 | token[at + 1])]
            keep = ~over
            keep[at + 1] = False
            changed = np.zeros(len(token), bool)
            changed[at] = True
            was = np.zeros(len(token), np.int64)
            was[at] = rank[at]
            token, start, word, rank, changed, was = (x[keep] for x in (token, start, word, rank, changed, was))
            fresh = np.flatnonzero(changed)
            near = np.unique(np.concatenate([fresh, fresh[fresh > 0] - 1]))
            rank[near] = self.ranks(token, word, near)
            early = near[rank[near] <= np.where(changed[near], was[near], was[np.minimum(near + 1, len(was) - 1)] if len(was) else 0)]
            odd.append(word[early])
        token, start = np.concatenate(done_token or [token]), np.concatenate(done_start or [start])
        odd = np.unique(np.concatenate(odd)) if odd else np.zeros(0, np.int64)
        if len(odd):
            keep = ~np.isin(np.searchsorted(first, start, "right") - 1, odd)
            ends = np.append(first, len(codes))
            again = [self.alone(codes[ends[w] : ends[w + 1]]) for w in odd.tolist()]
            token = np.concatenate([token[keep], *(t for t, _ in again)])
            start = np.concatenate([start[keep], *(s + ends[w] for (_, s), w in zip(again, odd.tolist()))])
        order = np.argsort(start)
        return token[order], start[order]

    def ranks(self, token: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of the pair that each place (or those at) makes with the next."""
        at = np.arange(len(token)) if at is None else at
        after = np.minimum(at + 1, max(len(token) - 1, 0))
        key = token[at] << 32 | token[after]
        place = _place(self.pair_keys, key)
        good = (self.pair_keys[place] == key) & (token[at] >= 0) & (token[after] >= 0) & (word[at] == word[after]) & (after > at)
        return np.where(good, self.pair_rank[place], NONE)

    def alone(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word by the definition: its best pair, the leftmost of equals, over and over."""
        token, start = self.symbol[codes], np.arange(len(codes))
        same = np.zeros(len(codes), np.int64)
        while len(token) > 1:
            rank = self.ranks(token, same[: len(token)])
            i = int(np.argmin(rank))
            if rank[i] == NONE:
                break
            token[i] = self.pair_id[_place(self.pair_keys, token[i] << 32 | token[i + 1])]
            token, start = np.delete(token, i + 1), np.delete(start, i + 1)
        return token, start

    def encode_words(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each normalised word; characters that are no piece become their bytes."""
        chunk, size = [], 0
        for w in words:
            if chunk and size + len(w) > CHUNK_CHARS:
                yield from self._encode(chunk)
                chunk, size = [], 0
            chunk.append(w)
            size += len(w)
        if chunk:
            yield from self._encode(chunk)

    def _encode(self, words: list[str]) -> Iterator[list[int]]:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cut = np.zeros(len(codes), bool)
        cut[np.concatenate([[0], ends])[:-1]] = True
        token, start = self.merged(codes, cut)
        lost = np.flatnonzero((token < 0) | (token >= len(self.decoded)))  # single characters without a piece
        raw = [chr(c).encode() for c in codes[start[lost]].tolist()]
        many = np.ones(len(token), np.int64)
        many[lost] = [len(b) for b in raw]
        ids, starts = np.repeat(token, many), np.repeat(start, many)
        ids[np.repeat(np.isin(np.arange(len(token)), lost), many)] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        at = np.searchsorted(starts, ends).tolist()
        ids = ids.tolist()
        for a, b in zip([0, *at], at):
            yield ids[a:b]

    def decode(self, ids: list[int]) -> str:
        """The text: pieces with their spaces, less the one that was put in front; bytes that are no character become U+FFFD."""
        raw = b"".join(map(self.decoded.__getitem__, ids))
        return self.text(raw[1:] if raw[:1] == b" " and ids[0] not in self.byte else raw)

    @staticmethod
    def text(raw: bytes) -> str:
        out = []
        while True:
            try:
                return "".join(out) + raw.decode()
            except UnicodeDecodeError as e:
                out.append(raw[: e.start].decode() + "�")
                raw = raw[e.start + 1 :]


def _place(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(keys, x), len(keys) - 1)


def _within(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    return keys[_place(keys, x)] == x


def loaded(path: str) -> MergeRounds:
    """The model, read once by each Python worker from the place where every machine has it installed."""
    if path not in _LOADED:
        _LOADED[path] = MergeRounds(path)
    return _LOADED[path]


class _Words(dict):
    """Numbers of words, and by number what their encoding comes to."""

    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.size: list[int] = []
        self.ids: list[str] = []
        self.bytes: list[bytes] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        n = self[word] = len(self)
        return n

    def encode(self, model: MergeRounds) -> None:
        for ids in model.encode_words(self.fresh):
            self.size.append(len(ids))
            self.ids.append(",".join(map(str, ids)))
            self.bytes.append(b"".join(map(model.decoded.__getitem__, ids)))
        self.fresh = []


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row (with_ids: and ids), in one pass without a shuffle.

    Blocks of whole texts are encoded over their distinct words, so that memory is bounded and a word costs its rounds once
    a block. A null or empty text has no tokens. A text longer than a block is a block by itself. Rows that repeat are encoded
    alike; other columns are not read.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = loaded(path), _Words()
        for doc_ids, texts in _blocks(batches, lambda t: np.fromiter(map(known.__getitem__, model.words(model.normalised(t))), np.int32)):
            known.encode(model)
            size, n, ids_sha, decoded_sha, all_ids = np.array(known.size, np.int64), [], [], [], []
            for words in texts:
                at = words.tolist()
                joined = ",".join([known.ids[w] for w in at])
                n.append(int(size[words].sum()))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(model.text(b"".join([known.bytes[w] for w in at])[1:]).encode()).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for i in joined.split(",") if i])
            cols = [doc_ids, n, ids_sha, decoded_sha] + [all_ids] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [f for f, _ in fields])
            if len(known) > KEPT_WORDS:
                known = _Words()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text").mapInArrow(run, schema)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
