import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.operators import kmers, stretches
from strandloom.streaming import solid as stream


def encode(s):
    return int("".join(str("ACTG".index(c)) for c in s), 4)


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def canons(s, k):
    return [min(encode(s[i : i + k]), encode(turn(s[i : i + k]))) for i in range(len(s) - k + 1)]


def some(seed, n=60, most=200):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("ACGT" if rnd.random() < 0.7 else "A") for _ in range(rnd.randrange(most))) for _ in range(n)] + ["A" * 90, "ACGT" * 30]


def test_counts_against_plain_python(spark):
    for k in (1, 5, 12, 21, 31):
        seqs = some(k)
        frags = kmers.fragments(spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string"), k)
        assert {r.canon: r.cnt for r in stretches.counts(frags, k).collect()} == Counter(x for s in seqs for x in canons(s, k))


def test_long_fragments_go_in_pieces_and_counts_meet_once(spark, monkeypatch):
    monkeypatch.setattr(stretches, "PIECE", 50)
    monkeypatch.setattr(stretches, "BLOCK", 64)
    k, seqs = 9, some(7, most=400)
    frags = kmers.fragments(spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string"), k)
    assert {r.canon: r.cnt for r in stretches.counts(frags, k).collect()} == Counter(x for s in seqs for x in canons(s, k))


def test_a_kmer_is_not_a_row_of_the_shuffle(spark):
    seqs = some(3, n=400)
    frags = kmers.fragments(spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").coalesce(1), 21)
    n = sum(len(canons(s, 21)) for s in seqs)
    row = stretches.dealt(frags, 21, 4).agg(F.sum(F.length("c0") + F.length("c1")).alias("bytes"), F.sum(F.length("c1")).alias("stretches"), F.count("*").alias("rows")).first()
    assert row["bytes"] < 4 * n and row["rows"] <= 4 and row["stretches"] < n / 2


@pytest.mark.parametrize("k", [4, 21, 31])
def test_counts_of_batches_are_summed_up_without_a_row_a_kmer(spark, k):
    rnd = random.Random(k)
    rows = [(rnd.choice([rnd.randrange(4**k), rnd.randrange(50), 4**k - 1, 0]), rnd.choice([1, 3, 1 << 40])) for _ in range(3000)]
    want = {}
    for canon, n in rows:
        want[canon] = want.get(canon, 0) + n
    found = stream.total_counts(spark.createDataFrame(rows, "canon long, cnt long").repartition(5), k)
    assert found.dtypes == [("canon", "bigint"), ("cnt", "bigint")]
    assert sorted(map(tuple, found.collect())) == sorted(want.items())
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert stream.total_counts(spark.createDataFrame([], "canon long, cnt long"), k).count() == 0
