"""Substring dedup over words: repeated paths of a de Bruijn graph whose edges are runs of 20 words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, ordered, pieces, table, written
from .paths import paths, prefix_sums, span_hash

#: Words of an edge, and of the seeds that bring edges together.
EDGE_WORDS, SEED_WORDS = 20, 6
#: Edges that a task sums up before it hands them on.
BLOCK_EDGES = 200_000
#: Seeds that are broadcast, at most: a row of three longs each.
HOT_SEEDS = 1000
#: size edges of a text from its edge `at` on are those of the text source_key from source_at on.
_SPAN = ["key", "at", "size", "source_key", "source_at"]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_units(text: str) -> np.ndarray:
    """A hash of each word; words are kept apart by ASCII white space alone."""
    words = text.encode().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _texts(batches):
    for b in (x for batch in batches for x in pieces(batch)):
        yield b, b.column("key").to_pylist(), b.column("text").to_pylist()


def _listed(column) -> list[dict[str, np.ndarray]]:
    """Of a column of lists of structs: the fields of each row's list."""
    cuts = np.cumsum(np.fromiter(pc.list_value_length(column).to_numpy(zero_copy_only=False), np.int64, len(column)))[:-1]
    whole = column.flatten()
    fields = {f.name: np.split(whole.field(i).to_numpy(zero_copy_only=False), cuts) for i, f in enumerate(whole.type)}
    return [{name: x[i] for name, x in fields.items()} for i in range(len(column))]


def stretches(docs: DataFrame, edge: int, seed: int) -> DataFrame:
    """key, first, n, seed and id of all stretches of the texts: runs of n edges in a row that share a seed, which is the run of `seed` words
    of the smallest hash among those of the edge. id is a hash of all words of the stretch. Equal edges share their seed,
    wherever they stand."""

    def run(batches):
        for _, keys, texts in _texts(batches):
            parts = [(key, *paths(word_units(t), edge, seed)) for key, t in zip(keys, texts)]
            key = np.repeat(np.array(keys, np.int64), [len(p[1]) for p in parts])
            s, i, first, n = (np.concatenate(x) for x in list(zip(*parts))[1:])
            cols = [key, first.astype(np.int32), n.astype(np.int32), s.view(np.int64), i.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "first", "n", "seed", "id"])

    return docs.select("key", "text").mapInArrow(run, "key long, first int, n int, seed long, id long")


def _edges(batches, edge: int, block: int):
    """Blocks of (key, at, size, id, next, prev): a stretch that always comes whole is one edge of several words more, any other its edges
    one by one. next and prev are 0 where no edge is left beside."""
    out, n = [], 0
    for b, keys, texts in _texts(batches):
        for key, text, x in zip(keys, texts, _listed(b.column("parts"))):
            order = np.argsort(x["first"])
            first, size, i, mixed = (x[c][order] for c in ("first", "n", "id", "mixed"))
            times = np.where(mixed, size, 1)
            at = np.repeat(first, times).astype(np.int64)
            at += np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            alone = np.repeat(mixed.astype(bool), times)
            i, size = np.repeat(i, times), np.where(alone, 1, np.repeat(size, times))
            if alone.any():
                sums = prefix_sums(word_units(text))
                i[alone] = span_hash(sums, at[alone], at[alone] + edge).view(np.int64)
            beside = at[:-1] + size[:-1] == at[1:]
            out.append((np.full(len(at), key), at, size, i, np.append(np.where(beside, i[1:], 0), 0), np.append(0, np.where(beside, i[:-1], 0))))
            n += len(at)
            if n >= block:
                yield [np.concatenate(c) for c in zip(*out)]
                out, n = [], 0
    if out:
        yield [np.concatenate(c) for c in zip(*out)]


def _runs(key, at, size, source_key, source_at) -> list[np.ndarray]:
    """Spans in order, those in a row whose sources are in a row made one."""
    order = np.lexsort((at, key))
    key, at, size, source_key, source_at = (x[order] for x in (key, at, size, source_key, source_at))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + size[:-1]) | (source_key[1:] != source_key[:-1]) | (source_at[1:] != source_at[:-1] + size[:-1])
    heads = np.flatnonzero(new)
    return [key[heads], at[heads], np.add.reduceat(size, heads) if len(heads) else size, source_key[heads], source_at[heads]]


def occurrences(docs: DataFrame, parts: DataFrame, edge: int, block: int) -> DataFrame:
    """Two kinds of rows, from blocks of texts: with an id, the first occurrence in the block (key, at, size) of an edge, with n, how
    many the block has, and the ids of the edge after and of the one before all of them (0 if they differ, or there is none); without,
    spans of edges (_SPAN) that stand in the block before."""

    def run(batches):
        for key, at, size, i, after, before in _edges(batches, edge, block):
            order = np.lexsort((at, key, i))
            key, at, size, i, after, before = (x[order] for x in (key, at, size, i, after, before))
            new = np.concatenate([[True], i[1:] != i[:-1]])
            heads = np.flatnonzero(new)
            n = np.diff(np.append(heads, len(i)))
            ends = [np.where((low := np.minimum.reduceat(x, heads)) == np.maximum.reduceat(x, heads), low, 0) for x in (after, before)]
            source = np.repeat(heads, n)[~new]
            spans = _runs(key[~new], at[~new], size[~new], key[source], at[source])
            k = len(spans[0])
            both = [np.concatenate([a[heads], b]) for a, b in zip((key, at, size), spans)]
            none = [np.concatenate([a, np.zeros(k, np.int64)]) for a in (i[heads], n, *ends)]
            sources = [np.concatenate([np.zeros(len(heads), np.int64), x]) for x in spans[3:]]
            is_span = np.arange(len(heads) + k) >= len(heads)
            cols = [pa.array(x.astype(np.int64)) for x in both + sources] + [pa.array(x.astype(np.int64), mask=is_span) for x in none]
            yield pa.RecordBatch.from_arrays(cols, [*_SPAN, "id", "n", "after", "before"])

    schema = ", ".join(f"{c} long" for c in [*_SPAN, "id", "n", "after", "before"])
    return docs.select("key", "text").join(parts, "key").mapInArrow(run, schema)


def compacted(repeated: DataFrame) -> DataFrame:
    """id (of the first edge) and whole (edges) of all nonbranching paths of the graph of repeated edges (id, size, key and at of the first
    occurrence, after, before: the edges that follow and precede all occurrences, or 0).

    An edge goes on into another if all its occurrences are followed by that one, and all of the other are preceded by it:
    then their occurrences run side by side. A join finds such pairs; as a path's first occurrence is a run of the text that
    has it, the edges that no other goes on into cut that text's edges into paths.
    """
    into = repeated.where("after <> 0").select(F.col("after").alias("id"), F.col("id").alias("from"))
    inner = repeated.where("before <> 0").select("id", F.col("before").alias("from")).join(into, ["id", "from"]).select("id", F.lit(0).alias("head"))
    rows = repeated.select("id", "size", "key", "at").join(inner, "id", "left").withColumn("head", F.coalesce("head", F.lit(1)))
    rows = rows.withColumn("path", F.sum("head").over(Window.partitionBy("key").orderBy("at")))
    return rows.groupBy("key", "path").agg(F.max(F.when(F.col("head") == 1, F.col("id"))).alias("id"), F.sum("size").alias("whole")).select("id", "whole")


def _by_seed(cut: DataFrame, seeds: DataFrame) -> DataFrame:
    """The stretches joined with their seeds. Seeds with a HOT_SEEDS-th of all stretches or more, which are HOT_SEEDS at most, are
    broadcast, so that none of their stretches move; the others' stretches go to their seeds."""
    seeds = written(seeds)
    common = f"times * {HOT_SEEDS} >= {cut.count()}"
    hot = F.broadcast(seeds.where(common))
    rest = cut.join(hot.select("seed"), "seed", "left_anti").join(seeds.where(f"not ({common})"), "seed")
    return cut.join(hot, "seed").unionByName(rest)


def repeats(docs: DataFrame, edge: int, seed: int, block: int) -> DataFrame:
    """key and spans (at, size, digest) of the texts (key, text) that have edges which stand earlier, too (smaller key, or same text and
    earlier). digest is that of the words at the span's source.

    1. Tasks cut texts into stretches (super-k-mers). A seed that is met once has unique edges only, and they are gone.
       Stretches of a seed that are all equal are edges of the graph as they are; where different ones share a seed,
       their edges are told apart one by one.
    2. Tasks sum up the edges of a block of texts, so that however often an edge occurs, few rows of it move; then edges
       are counted. Those that occur again make the graph.
    3. Nonbranching paths are compacted. Of each path the earliest occurrence is the source; the others are spans.
    4. Digests of the words at the sources' coordinates go with the spans.
    """
    cut = written(stretches(docs, edge, seed))
    seeds = cut.groupBy("seed").agg(F.count("*").alias("times"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("times > 1").select("seed", "times", F.expr("lo <> hi").alias("mixed"))
    part = F.struct("first", "n", F.when(~F.col("mixed"), F.col("id")).otherwise(0).alias("id"), "mixed")  # of a mixed one edges get their own ids
    parts = written(_by_seed(cut, seeds).groupBy("key").agg(F.collect_list(part).alias("parts")))
    drop_written(cut)
    found = written(occurrences(docs, parts, edge, block))
    drop_written(parts)
    same = Window.partitionBy("id")
    source = F.min(F.struct("key", "at")).over(same).alias("source")
    ends = [F.when(F.min(c).over(same) == F.max(c).over(same), F.col(c)).otherwise(0).alias(c) for c in ("after", "before")]
    edges = found.where("id is not null").select("id", "key", "at", "size", F.sum("n").over(same).alias("n"), source, *ends).where("n > 1")
    edges = edges.select("id", "key", "at", "size", F.col("source.key").alias("source_key"), F.col("source.at").alias("source_at"), "after", "before")
    first = "key = source_key and at = source_at"
    edges = written(edges.withColumns({c: F.when(F.expr(first), F.col(c)) for c in ("after", "before")}))
    whole = compacted(edges.where(first))
    spans = edges.where(f"not ({first})").join(whole, "id").select("key", "at", F.col("whole").alias("size"), "source_key", "source_at")
    spans = written(spans.unionByName(found.where("id is null").select(*_SPAN)))
    drop_written(found)
    drop_written(edges)

    def digest(batches):
        for b, keys, texts in _texts(batches):
            out = []
            for key, text, x in zip(keys, texts, _listed(b.column("asked"))):
                words = text.encode().split()
                out += [(key, a, n, _digest(words, a, n, edge)) for a, n in zip(x["source_at"].tolist(), x["size"].tolist())]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, kinds)], ["source_key", "source_at", "size", "digest"])

    asked = spans.select("source_key", "source_at", "size").distinct().groupBy(F.col("source_key").alias("key")).agg(F.collect_list(F.struct("source_at", "size")).alias("asked"))
    sources = docs.select("key", "text").join(asked, "key").mapInArrow(digest, "source_key long, source_at long, size long, digest binary")
    out = written(spans.join(sources, ["source_key", "source_at", "size"]).groupBy("key").agg(F.collect_list(F.struct("at", "size", "digest")).alias("spans")))
    drop_written(spans)
    return out


def _digest(words: list[bytes], at: int, size: int, edge: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[at : at + size + edge - 1]))


def without_repeats(docs: DataFrame, edge: int = EDGE_WORDS, with_text: bool = False, block: int = BLOCK_EDGES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (with_text: and text, the kept words) of every row.

    Every run of `edge` words is an edge of the graph, from its first words to its last. Of each edge the earliest source
    coordinate (smallest doc_id, then place) stays; repeated nonbranching paths are compacted (repeats()), and their words
    are taken out wherever else they stand, if they are indeed, by a digest of 128 bits, those at the source.

    A null text has no words. A text with fewer words than an edge keeps them all. Rows that share a doc_id come in the
    order of their text's hash, later ones counting as later documents; null doc_ids come first.
    """
    docs = ordered(docs)
    spans = repeats(docs, edge, min(SEED_WORDS, edge), block)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch)):
            rows = []
            for i, text, found in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist()):
                words = text.encode().split()
                kept = words
                if found:
                    gone = np.zeros(len(words), bool)
                    for x in found:
                        if _digest(words, x["at"], x["size"], edge) == x["digest"]:
                            gone[x["at"] : x["at"] + x["size"] + edge - 1] = True
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                rows.append((i, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode())[: 4 + with_text])
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows)) or [()] * (4 + with_text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text])

    return docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def op6_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), e AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY list_slice(w, s, s + 19) ORDER BY doc_id, s) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w)
), g AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM e WHERE n > 1
), r AS (
  SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id
), k AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
