"""Pairs of junctions by block of fragments, against those of a row a junction."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.operators import block_pairs, junctions, kmers, pairs, places

K, J = 11, 1


def results(spark):
    """The same junction results in blocks and in rows: of reads of a genome with repeats and variants, among them ones without a junction."""
    rng = random.Random(11)
    part = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b, c, r = part(90), part(90), part(90), part(25)
    genomes = [a + r + b, b[:40] + r + c, c[:50] + "T" + c[50:], a[:30] + "G" + a[31:], part(120), "A" * 40 + part(40)]
    texts = [g[i : i + 60] for g in genomes for i in range(0, len(g) - 40, 3)]
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string").repartition(3)
    valid, solid = (places.written(x) for x in kmers.valid_and_solid(reads, K, 2 * J + 1))
    met = places.written(junctions.branching_sites(valid, solid, K, J))
    return junctions.branching_results(valid, solid, K, J), places.written(pairs.results(met, junctions.fake_junctions(valid, met, K, J), K))


def same(a, b):
    a, b = (sorted(map(tuple, x.select(*a.columns).collect())) for x in (a, b))
    assert a == b != []


def test_pairs_by_block(spark, monkeypatch):
    blocks, rows = results(spark)
    short = pairs.short_pairs(rows, K)
    same(block_pairs.short_pairs(blocks, K), short)
    order = Window.partitionBy("read_id", "run_no").orderBy("tpos")
    nexts = rows.select("read_id", "run_no", "real", F.lead("real").over(order).alias("next")).where("next is not null")
    same(block_pairs.score(blocks, short, K), pairs.score(nexts, short, ["read_id", "run_no"], "real", "next", K))
    along = rows.select(F.concat_ws("_", "read_id", "run_no").alias("contig_id"), F.col("tpos").alias("ord"), F.col("real").alias("kmer"), F.col("tpos").alias("distance"))
    for most in (2000, 20):
        sums = block_pairs.insert_sums(blocks, short, K, most).select(F.concat_ws("_", "read_id", "run_no").alias("contig_id"), "n", "s", F.col("q").cast("double").alias("q"))
        same(pairs.mean_and_deviation(sums), pairs.insert_size(along, short, K, most))
    same(block_pairs.distance_histogram(blocks, short, K), pairs.distance_histogram(along, short, K))
    none = block_pairs.distance_histogram(blocks, short.limit(0), K).collect()
    assert none and not any(x.known for x in none)


def test_junctions_of_a_fragment_make_no_rows_of_pairs(spark):
    """40 fragments of 300 junctions: 1.8 M pairs come as one row a fragment, and no operator of the plan has a row for each."""
    n = 300
    x = {"read_id": np.arange(40), "frag_no": np.zeros(40), "run_no": np.zeros(40), "n": np.full(40, n), "tpos": np.tile(np.arange(n), 40), "real": np.tile(np.arange(n) + (1 << 30), 40), "onward": np.ones(40 * n)}
    row = [bytearray(x[c].astype(t).tobytes()) for c, t in places.RESULTS.items()]
    blocks = places.written(spark.createDataFrame([(*row, 0)], ", ".join(f"{c} binary" for c in places.RESULTS) + ", block long"))
    sums = block_pairs.insert_sums(blocks, block_pairs.short_pairs(blocks, 21), 21)
    assert sorted((r.read_id, r.n, r.s, r.q) for r in sums.collect()) == [(i, n - 2, 2 * (n - 2), 4 * (n - 2)) for i in range(40)]
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
