import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import kmers

CODE = {"A": 0, "C": 1, "T": 2, "G": 3}


def encode(s):
    return int("".join(str(CODE[c]) for c in s), 4)


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_occurrences_of_all_widths(spark):
    rnd = random.Random(1)
    for k in (1, 5, 16, 21, 31):
        seqs = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(k, 130))) for _ in range(20)] + ["A" * 40, "ACGT" * 10]
        df = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
        got = kmers.occurrences(kmers.fragments(df, k), k).collect()
        assert len(got) == sum(len(s) - k + 1 for s in seqs)
        for r in got:
            x = seqs[r.read_id][r.pos : r.pos + k]
            assert (r.kmer, r.canon) == (encode(x), min(encode(x), encode(turn(x))))


def test_expressions(spark):
    k = 27
    rnd = random.Random(2)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(k)) for _ in range(50)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string").withColumn("x", dna.encode("s"))
    rows = df.select(
        "s", "x", dna.decode("x", k).alias("back"), dna.decode(dna.revcomp("x", k), k).alias("rc"), dna.decode(dna.append("x", F.lit(3), k), k).alias("on"),
        dna.decode(dna.prepend("x", F.lit(1), k), k).alias("pre"), dna.last_code("x").alias("last"), dna.code_at("x", 3, k).alias("third"), dna.canon_seq("s").alias("cs"), dna.canon("x", k).alias("c"),
        dna.revcomp_seq("s").alias("rs"),
    ).collect()
    for r in rows:
        assert r.x == encode(r.s) and r.back == r.s and r.rc == r.rs == turn(r.s)
        assert r.on == r.s[1:] + "G" and r.pre == "C" + r.s[:-1] and r["last"] == CODE[r.s[-1]] and r.third == CODE[r.s[3]]
        assert r.cs == min(r.s, turn(r.s)) and r.c == min(encode(r.s), encode(turn(r.s)))


def test_bases_and_homopolymers(spark):
    rows = spark.createDataFrame([(c,) for c in "ACGTNacgt-"], "b string").select("b", dna.is_valid("b").alias("v"), dna.code("b").alias("c"), dna.base_of(dna.complement(dna.code("b"))).alias("m")).collect()
    for r in rows:
        assert r.v == (r.b in CODE) and r.c == CODE.get(r.b) and r.m == ({"A": "T", "T": "A", "C": "G", "G": "C"}.get(r.b))
    got = spark.createDataFrame([("AAAA",), ("AAAC",), ("G",)], "s string").select(dna.is_homopolymer("s").alias("h")).collect()
    assert [r.h for r in got] == [True, False, True]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ACGTN", max_size=40), min_size=1, max_size=8))
def test_fragments_keep_valid_runs(spark, seqs):
    import re

    df = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    got = sorted((r.read_id, r.frag_no, r.seq) for r in kmers.fragments(df, 5).collect())
    want = []
    for i, s in enumerate(seqs):
        want += [(i, n, x) for n, x in enumerate(x for x in re.findall("[ACGT]+", s) if len(x) >= 5)]
    assert got == sorted(want)


def test_sql_functions(spark):
    dna.register(spark)
    assert spark.sql("SELECT revcomp_dna('AACG') r, encode_dna('ACTG') e, canon('TTTT') c").first() == ("CGTT", 27, 0)
    assert [r.kmer for r in spark.sql("SELECT * FROM kmers_of('ACGTA', 3) ORDER BY pos").collect()] == ["ACG", "CGT", "GTA"]


def test_k_is_checked(spark):
    import pytest

    with pytest.raises(ValueError):
        dna.check_k(32)
