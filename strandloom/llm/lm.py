"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, pieces, table, written

#: Bits of a filter that is broadcast, at most (32 MB), for each of its entries, and probes of an entry.
MAX_BITS, BITS_AN_ENTRY, PROBES = 1 << 28, 8, 5
#: Words of the table of exact counts that is broadcast, at most; rarer words are joined.
HEAD_WORDS = 100_000
#: Tokens that a task gathers before it hands them on, and tokens whose n-grams one reduce group gets.
BLOCK_TOKENS, GROUP_TOKENS, KEPT_HASHES = 400_000, 1_000_000, 100_000

END = b" "  # no word holds a space
#: An n-gram's key is the upper 48 bits of its hash, the lowest of them 1 for a pair and 0 for a word.
_KEY, _PAIR = np.uint64(0xFFFFFFFFFFFE0000), np.uint64(0x10000)
_START = np.uint64(0x5851F42D4C957F2D)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    """Numbers of words, in the order in which they are first looked up."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def ngrams(hashes: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token alone, and of each with the one before it in its text (_START before the first). tokens are numbers of
    words, whose hashes are given, of texts of the given sizes."""
    alone = (_mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & _KEY)[tokens]
    here = hashes[tokens]
    before = np.empty_like(here)
    before[1:] = here[:-1]
    before[_starts(sizes)] = _START
    return alone, _mix(before * np.uint64(0x9E3779B97F4A7C15) + here) & _KEY | _PAIR


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpacked(blobs) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.reshape(-1).view("<u8")


@dataclass
class Filter:
    """Levels of n-grams: one of level q (count 2^(q-1) to 2^q - 1) is entered q times, as level 1 to q; how many levels
    answer, one after the other, gives back q, never less. Each range of keys has a segment of its own, whose size follows from
    the entries of the range alone; a key is only looked up in its segment."""

    segments: list[np.ndarray]

    def __post_init__(self) -> None:
        sizes = np.array([len(s) for s in self.segments], np.int64)
        self.base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.mask = (sizes * 8 - 1).astype(np.uint64)
        self.flat = np.concatenate(self.segments)

    def __getstate__(self):
        return self.segments

    def __setstate__(self, segments) -> None:
        self.__init__(segments)

    @staticmethod
    def places(keys: np.ndarray, level: int, mask):
        g = _mix(keys + np.uint64(level * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        step = (g >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield ((g + np.uint64(i) * step) & mask).astype(np.int64)

    @classmethod
    def segment(cls, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
        bits = _power(max(64, int(levels.sum()) * BITS_AN_ENTRY))
        out = np.zeros(bits, bool)
        for q in range(1, int(levels.max(initial=0)) + 1):
            for p in cls.places(keys[levels >= q], q, np.uint64(bits - 1)):
                out[p] = True
        return np.packbits(out, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint8)
        own = segment_of(keys, len(self.segments))
        alive, base, mask, q = np.arange(len(keys)), self.base[own], self.mask[own], 0
        while len(alive):
            q += 1
            yes = np.ones(len(alive), bool)
            for p in self.places(keys[alive], q, mask[alive]):
                yes &= (self.flat[base[alive] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
            alive = alive[yes]
            out[alive] = q
        return out


def segment_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of keys, of n (a power of two)."""
    return (keys >> np.uint64(64 - int(math.log2(n)))).astype(np.int64) if n > 1 else np.zeros(len(keys), np.int64)


def _power(x: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(x, 1))))


def _in_blocks(batches):
    """(rows' other columns, sizes of the texts in tokens, all tokens as numbers of words, the words), some BLOCK_TOKENS at a time. A text
    has a token at least, its end."""
    rest, texts, n, known = [], [], 0, _Numbers()
    for b in (x for batch in batches for x in pieces(batch)):
        names = [c for c in b.schema.names if c != "text"]
        for row, text in zip(zip(*(b.column(c).to_pylist() for c in names)), b.column("text").to_pylist()):
            words = tokens_of(text)
            rest.append(row)
            texts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            n += len(words)
            if n >= BLOCK_TOKENS:
                yield rest, np.array([len(t) for t in texts]), np.concatenate(texts), list(known)
                rest, texts, n, known = [], [], 0, _Numbers()
    if rest:
        yield rest, np.array([len(t) for t in texts]), np.concatenate(texts), list(known)


def token_counts(docs: DataFrame) -> DataFrame:
    """word (binary) and c of every token of the texts; each task counts before it hands on."""

    def run(batches):
        seen: Counter[bytes] = Counter()
        for b in (x for batch in batches for x in pieces(batch)):
            for t in b.column("text").to_pylist():
                seen.update(tokens_of(t))
            if len(seen) > 2 * KEPT_HASHES:
                yield _pairs(seen)
                seen = Counter()
        yield _pairs(seen)

    def _pairs(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


_SETTLED = "block long, range long, data binary, pair int, level int, n long, total long"


def settled_ngrams(docs: DataFrame, ranges: int, answer: bool) -> DataFrame:
    """Tokens and pairs of the rows (row, learn, text), counted over those with learn, as a table of three kinds of rows:

    - pair (0 or 1), level, n, total: how many n-grams of a range have the level, and the sum of their counts;
    - with answer: block, range, data: the levels, a byte each, of the different n-grams of a block (named by its first row;
      all its texts, learn or not) that fall into the range, in the order of their keys;
    - without: range, data: the range's segment of the filter.

    Tasks count the n-grams of a block and pack them by ranges of keys; a group gets the range's blocks, adds up, makes
    the segment and probes it. Ranges are as many as the corpus needs for groups of a bounded size, and a segment has room for
    whatever its range holds: no n-gram is left out.
    """

    def pack(batches):
        for rows, sizes, tokens, words in _in_blocks(batches):
            learn = np.repeat(np.array([r[1] for r in rows], np.uint64), sizes)
            k = np.concatenate([x | learn for x in ngrams(hashes_of(words), tokens, sizes)])  # the lowest bits of a key are free
            k.sort()
            keys = k & (_KEY | _PAIR)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[first], np.add.reduceat(k & np.uint64(1), first).astype("<u4")
            at = segment_of(keys, ranges)
            cuts = np.flatnonzero(np.diff(at)) + 1
            cols = [(int(r), _packed(a), _planes(b)) for r, a, b in zip(at[np.concatenate([[0], cuts])], np.split(keys, cuts), np.split(n, cuts))]
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]] * len(cols), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*cols), (pa.int64(), pa.binary(), pa.binary())))], ["block", "range", "keys", "n"])

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        every = _unpacked(group["keys"])
        n = np.concatenate([_unplaned(x) for x in group["n"]]).astype(np.int64)
        order = np.argsort(every)
        keys = every[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[first], np.add.reduceat(n[order], first)
        keys, n = keys[n > 0], n[n > 0]
        levels = np.floor(np.log2(n)).astype(np.int64) + 1
        segment = Filter.segment(keys, levels)
        kind = ((keys & _PAIR) > 0) * 64 + levels
        number, total = np.bincount(kind, minlength=128), np.bincount(kind, n, 128)
        at = np.flatnonzero(number)
        out = pd.DataFrame({"block": None, "range": None, "data": None, "pair": at // 64, "level": at % 64, "n": number[at], "total": total[at].astype(np.int64)})
        if answer:
            ends = np.cumsum([len(x) // 6 for x in group["keys"]])[:-1]
            own = np.split(Filter([segment]).levels(every), ends)
            more = pd.DataFrame({"block": group["block"], "range": group["range"], "data": [x.tobytes() for x in own]})
        else:
            more = pd.DataFrame({"block": [None], "range": group["range"].iloc[:1], "data": [segment.tobytes()]})
        return pd.DataFrame({c: list(out[c]) + (list(more[c]) if c in more else [None] * len(more)) for c in out.columns})

    packed = docs.select("row", "learn", "text").mapInArrow(pack, "block long, range long, keys binary, n binary")
    return written(packed.groupBy("range").applyInPandas(settle, _SETTLED))


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 4 bytes, byte by byte: mostly small, so that three quarters are long runs of zeros."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


@dataclass
class Smoothing:
    """What turns levels into probabilities: for words and pairs the mean count of each level, the part of pairs that are not met
    once, the texts learnt from, and what words' counts are divided by."""

    words: np.ndarray
    pairs: np.ndarray
    seen: float
    texts: float
    whole: float

    @classmethod
    def of(cls, stats, texts: int, whole: int) -> Smoothing:
        """stats: (pair, level, n, total) of all levels."""
        means = np.zeros((2, 256))
        for pair, level, n, total in stats:
            means[pair, level] = total / n
        for row in means:  # a level that only wrong answers have, above all that are known
            top = int(np.flatnonzero(row).max(initial=0))
            row[top + 1 :] = row[top]
        once = sum(n for pair, level, n, _ in stats if pair and level == 1)
        total = sum(t for pair, _, _, t in stats if pair)
        return cls(means[0], means[1], 1 - min(once / max(total, 1), 0.95), max(float(texts), 1.0), float(whole))

    def scores(self, sizes: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """log10 of each text's probability, from the levels of all its tokens, and of their pairs with the tokens before."""
        c, c2 = self.words[words], self.pairs[pairs]
        starts = _starts(sizes)
        before = np.concatenate([[0.0], c[:-1]])
        before[starts] = self.texts
        m = np.where(before > 0, self.seen, 0.0)
        p = m * np.minimum(1, c2 / np.maximum(before, 1)) + (1 - m) * np.minimum(1, (c + 1) / self.whole)
        return np.add.reduceat(np.log10(p), starts)


def lm_scores(docs: DataFrame, train, max_bits: int = MAX_BITS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row, learnt from the rows where `train` holds.

    base_score is exact: counts of frequent words are broadcast (at most head_words), those of the rest are joined. score
    is the log10 probability under pairs of words: m * c(v w) / c(v) + (1 - m) * (c(w) + 1) / (N + V + 1). c is the mean
    count of the level that the filter gives back, so that levels change no sum over the corpus; m is by Good and Turing the part of pairs
    that are not met once; after a word that the filter lacks, m is 0; a text's first word follows as many texts as were
    learnt. As levels stand for counts, the probabilities after one word add up to about 1 and not to exactly 1.

    The filter has at most BITS_AN_ENTRY * 2 bits for each n-gram learnt. Where that bound is within max_bits it is broadcast.
    Otherwise each range of n-grams makes its segment and answers the blocks, whose n-grams come there to be counted;
    segments and scores are the same. A null text counts as empty: its one token is the end. Rows that repeat are learnt
    and scored as often as they stand. With no row to learn from, every token has probability 1.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).cast("int").alias("learn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    counts = written(token_counts(docs.where("learn = 1")))
    n_train, n_words, n_texts = (x or 0 for x in counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))).first())
    whole = n_train + n_words + 1
    bins = F.floor(F.log2("c") * 8)
    at_least, room = None, head_words
    for r in sorted(counts.groupBy(bins.alias("bin")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        at_least = r["bin"]
    head = {bytes(r.word): math.log10(r.c + 1) for r in counts.where(bins >= at_least).collect()} if at_least is not None else {}
    ranges = _power(2 * n_train / GROUP_TOKENS)
    small = 2 * (2 * n_train * BITS_AN_ENTRY + 64 * ranges) <= max_bits
    settled = settled_ngrams(docs if not small else docs.where("learn = 1"), ranges, not small)
    model = Smoothing.of([tuple(r) for r in settled.where("level is not null").groupBy("pair", "level").agg(F.sum("n"), F.sum("total")).collect()], n_texts, whole)
    sieve = None
    if small:
        own = {r["range"]: np.frombuffer(r["data"], np.uint8) for r in settled.where("range is not null").select("range", "data").collect()}
        sieve = Filter([own.get(i, np.zeros(8, np.uint8)) for i in range(ranges)])
    shared = spark.sparkContext.broadcast((head, sieve))

    def run(batches):
        head, sieve = shared.value
        for rest, sizes, tokens, words in _in_blocks(batches):
            score, starts, hashes = np.full(len(sizes), np.nan), _starts(sizes), hashes_of(words)
            if sieve:
                alone, both = ngrams(hashes, tokens, sizes)
                kinds, at = np.unique(both, return_inverse=True)
                _, first = np.unique(tokens, return_index=True)  # every word occurs
                score = model.scores(sizes, sieve.levels(alone[first])[tokens], sieve.levels(kinds)[at])
            else:
                parts = np.array([len(sizes), len(words)], "<i8"), np.array([r[0] for r in rest], "<i8"), sizes.astype("<i8"), hashes
                data = b"".join([*(x.tobytes() for x in parts), _planes(tokens)])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:-2]), pa.array([rest[0][0]], pa.int64()), pa.array([data], pa.binary())], schema=schema)
            logs = np.array([head.get(w, np.nan) for w in words])[tokens]
            rare = np.isnan(logs)
            n_heads = np.add.reduceat(~rare, starts, dtype=np.int64)
            heads = np.add.reduceat(np.where(rare, 0.0, logs), starts)
            # a text's rare words, each once, with how often it occurs
            text = np.repeat(np.arange(len(sizes)), sizes)[rare]
            pairs, n_rare = np.unique(text * np.int64(len(words)) + tokens[rare], return_counts=True)
            until = np.searchsorted(pairs // len(words), np.arange(len(sizes) + 1))
            found = pa.array([words[i] for i in (pairs % len(words)).tolist()], pa.binary())
            tails = pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.StructArray.from_arrays([found, pa.array(n_rare, pa.int64())], fields=list(pair)))
            ids = [pa.array(x, pa.int64()) for x in zip(*rest)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(sizes, pa.int64()), pa.array(n_heads, pa.int64()), pa.array(heads), pa.array(score), tails, *(pa.nulls(len(sizes), f.type) for f in list(schema)[-2:])], schema=schema)

    def put_together(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        raw = block["data"].iloc[0]
        n, n_words = np.frombuffer(raw, "<i8", 2).tolist()
        rows, sizes = np.frombuffer(raw, "<i8", 2 * n, 16).reshape(2, n)
        hashes = np.frombuffer(raw, "<u8", n_words, 16 + 16 * n)
        alone, both = ngrams(hashes, _unplaned(raw[16 + 16 * n + 8 * n_words :]), sizes)
        del raw, hashes
        keys, at = np.unique(np.concatenate([alone, both]), return_inverse=True)
        levels = np.frombuffer(b"".join(answers.sort_values("range")["data"]), np.uint8)
        if len(levels) != len(keys):
            raise RuntimeError("a block's rows have changed between two readings of the input")
        return pd.DataFrame({"row": rows, "score": model.scores(sizes, *np.split(levels[at], [len(alone)]))})

    pair = pa.struct([("word", pa.binary()), ("n", pa.int64())])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("head", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pair)), ("block", pa.int64()), ("data", pa.binary())])
    both = written(docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_tokens long, n_head long, head double, score double, tail array<struct<word: binary, n: long>>, block long, data binary"))
    rows = both.where("row is not null").drop("block", "data")
    if not small:
        sent = both.where("row is null").select("block", "data")
        answers = settled.where("block is not null").select("block", "range", "data")
        scores = written(sent.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(put_together, "row long, score double"))
        rows = rows.drop("score").join(scores, "row")
    rare = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n").join(counts, "word")
    rare = rare.groupBy("row").agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare"))
    found = rows.drop("tail").join(rare, "row", "left").na.fill(0, ["n_rare", "rare"])
    return found.select(
        "doc_id", "n_tokens", (F.col("n_head") + F.col("n_rare")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("head") + F.col("rare") - F.col("n_tokens") * math.log10(whole)).alias("base_score"), "score",
    )


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = lm_scores(docs, crc_mod("doc_id", 7) != 2)
    return scores.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
