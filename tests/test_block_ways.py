"""Ways between junctions by block of fragments, against those of a row a site."""

import random

from strandloom.operators import block_ways, junctions, kmers, places, walks

K, J = 11, 1


def test_ways_by_block(spark):
    rng = random.Random(12)
    part = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b, c, r = part(90), part(90), part(90), part(25)
    genomes = [a + r + b, b[:40] + r + c, c[:50] + "T" + c[50:], a[:30] + "G" + a[31:], part(120), "A" * 40 + part(40)]
    texts = [g[i : i + 60] for g in genomes for i in range(0, len(g) - 40, 3)]
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string").repartition(3)
    valid, solid = (places.written(x) for x in kmers.valid_and_solid(reads, K, 2 * J + 1))
    keys = places.written(junctions.branching(solid, K, J))
    want = walks.ways(valid, places.written(places.sites_of(valid, keys, K, J)), K, J)
    found = block_ways.ways(valid, keys, K, J)
    columns = ["kmer", "index", "linked", "dist", "far_index", "seq"]
    got = [(*tuple(x), x_far) for *x, x_far in found.select(*columns, "far").collect()]
    rows = [(*x, far if x[2] else None) for *x, far in want.select(*columns, "far").collect()]
    assert sorted(got, key=str) == sorted(rows, key=str) and any(x[2] for x in got) and not all(x[2] for x in got)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "max_by" not in plan  # no row a site is put in order, no text a read goes to its way
    assert block_ways.ways(valid.limit(0), keys, K, J).count() == 0
