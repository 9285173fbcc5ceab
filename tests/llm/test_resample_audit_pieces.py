"""Importance resampling, the filter audit and SentencePiece against plain versions, and on odd tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm import SCHEMA, SF, odd_rows

from strandloom.llm import audit, pieces_bpe, queries, resample

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 11 -------------------------------------------------------------------------------------------------------------------------


def drawn_by_force(rows, target, percent=10, least=20):
    def buckets(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [zlib.crc32(w.encode()) % 10000 for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]

    own, aim = collections.Counter(), collections.Counter()
    for _, t in rows:
        own.update(buckets(t))
    for t in target:
        aim.update(buckets(t))
    s_all, t_all = sum(own.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10000) / ((own[b] + 1) * (t_all + 10000))))
    out = []
    for i, t in rows:
        b = buckets(t)
        weight = sum(map(gain, b)) // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return sorted(map(str, out))


def test_resample(spark, docs, odd):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    aim = [r.text for r in target.collect()]
    for frame, rows, percent in ((docs, [(r.doc_id, r.text) for r in docs.collect()], 10), (odd, [(r[0], r[1]) for r in odd_rows()], 50)):
        got = resample.resample(frame, target, percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(str(list(r)) for r in got) == drawn_by_force(rows, aim, percent)
    assert resample.resample(docs.limit(0), target).count() == 0
    none = resample.resample(docs, target.limit(0)).collect()
    assert len(none) == docs.count() and any(r["rank"] == 1 for r in none)
    assert set(queries.QUERIES["op11_resample"](spark, SF).columns) >= {"doc_id", "n_features", "weight", "score", "rank"}


def test_matrix_blocks_hold_every_row(docs, monkeypatch):
    rows = resample.count_matrix(docs, "doc_id").collect()
    assert sorted(i for r in rows for i in r.doc_id) == sorted(r.doc_id for r in docs.collect())
    for r in rows:
        assert len(r.starts) == len(r.doc_id) + 1 and r.starts[-1] == len(r.buckets) == len(r.counts)
        for a, b in itertools.pairwise(r.starts):
            assert r.buckets[a:b] == sorted(set(r.buckets[a:b])) and min(r.counts[a:b], default=1) > 0


def test_ranks_over_many_pieces(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randrange(5)) for i in range(1000)]
    got = resample.numbered(spark.createDataFrame(rows, "doc_id long, score long").repartition(7), ["score", "doc_id"]).collect()
    assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows, key=lambda r: (r[1], r[0]))
    assert sorted(r["rank"] for r in got) == list(range(1, 1001))


# --- 12 -------------------------------------------------------------------------------------------------------------------------


def audit_by_force(rows, labels):
    rows = [(i, t or "", s or "") for i, t, s in rows]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        before = any(t == u and j is not None and (i is None or j < i) for j, u, _ in rows)
        return {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": before}

    failed = [(i, s, fails(i, t)) for i, t, s in rows]
    out = []
    for part in {s for _, s, _ in failed}:
        own, shapley, steps = [(i, f) for i, s, f in failed if s == part], collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for n, x in enumerate(order, 1):
                gone = [i for i, f in left if f[x]]
                redundant = sum(f[x] and any(f[y] for y in order[: n - 1]) for _, f in own)
                left = [(i, f) for i, f in left if not f[x]]
                shapley[x] += len(gone)
                steps.append(["".join(order), n, len(left), len(gone), redundant, sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(i in good for i in gone), sum(i in toxic for i in gone), x])
        out += [(part, *s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def test_audit(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    ours = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (6, 1, None), (None, 1, 1), (12, 1, 1), (12, 1, 1)], "doc_id long, quality int, toxic int")
    for frame, rows, marks in ((docs, [(r.doc_id, r.text, r.source) for r in docs.collect()], labels), (odd, [(r[0], r[1], r[3]) for r in odd_rows()], ours)):
        got = sorted(tuple(r) for r in audit.audit(frame, marks).select("part", "filter_order", "step", *audit.COUNTS, "shapley").collect())
        assert got == audit_by_force(rows, [tuple(r) for r in marks.collect()])
    assert audit.audit(docs.limit(0), labels).count() == 0
    alone = audit.audit(docs, labels.limit(0))
    assert alone.count() == 600 * docs.select("source").distinct().count() and alone.agg({"good_lost": "max"}).first()[0] == 0


# --- 13 -------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_sentencepiece(docs, odd, model):
    for frame, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, [(r[0], r[1]) for r in odd_rows()])):
        want = []
        for i, t in rows:
            ids = model.encode(t or "")
            want.append(str((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest(), ids)))
        assert sorted(str(tuple(r)) for r in pieces_bpe.encode_documents(frame, MODEL, with_ids=True).collect()) == sorted(want)
    assert pieces_bpe.encode_documents(docs.limit(0), MODEL).count() == 0


ODD = st.text(st.sampled_from(list("aehtino  ▁\n\t\x00é日本語😀́ßA01.,-_<>/=")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.one_of(ODD, st.text(max_size=40), st.lists(st.integers(259, 31999), max_size=20).map(lambda ids: "".join(pieces_bpe.loaded(MODEL).decoded[i].decode() for i in ids))))
def test_rounds_are_the_library(text):
    rounds = pieces_bpe.loaded(MODEL)
    ids = [i for w in rounds.encode_words(rounds.words(rounds.normalised(text))) for i in w]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert ids == library.encode(text) and rounds.decode(ids) == library.decode(ids)


def test_odd_ids_and_long_words(model, monkeypatch):
    rounds, rnd = pieces_bpe.loaded(MODEL), random.Random(1)
    for _ in range(500):
        ids = [rnd.choice([rnd.randint(3, 300), rnd.randint(3, 31999)]) for _ in range(12)]
        assert rounds.decode(ids) == model.decode(ids)
    long = "a" * 50_000 + "abcdefgh" * 5000 + "日本" * 3000
    monkeypatch.setattr(pieces_bpe, "CHUNK_CHARS", 1000)
    assert [i for w in rounds.encode_words(rounds.words(rounds.normalised(long))) for i in w] == model.encode(long)


def test_a_word_that_merges_out_of_order_is_done_over(monkeypatch):
    rounds = pieces_bpe.loaded(MODEL)
    words = ["▁there", "▁nation", "thethethe", "aaaaaaa"]
    codes = np.array([ord(c) for c in "".join(words)], np.int64)
    cut = np.zeros(len(codes), bool)
    cut[np.cumsum([0, *map(len, words)])[:-1]] = True
    token, _ = rounds.merged(codes, cut)
    alone = [rounds.alone(np.array([ord(c) for c in w], np.int64))[0].tolist() for w in words]
    assert token.tolist() == [i for w in alone for i in w]
