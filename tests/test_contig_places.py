import random

from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import graph

K = 5
SCHEMA = "contig_id long, n1 long, ind1 int, n2 long, ind2 int, seq string, lead int, distances array<int>, coverages array<int>, circular boolean"


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def contigs_of(spark):
    rnd, rows = random.Random(1), []
    for i in range(80):
        n = rnd.randrange(0, 40)
        dist = [rnd.randrange(1, 9) for _ in range(rnd.randrange(0, 8))]
        cov = [rnd.randrange(1, 255) for _ in range(rnd.choice([len(dist) + 1, len(dist), 0]))]
        end = lambda: rnd.choice([(None, None), (7, 4), (9, rnd.randrange(4))])
        rows.append((i, *end(), *end(), "".join(rnd.choice("ACGT") for _ in range(n)), rnd.randrange(2), dist, cov, False))
    rows += [(100, None, None, None, None, None, 0, [1], [1, 2], False), (101, None, None, None, None, "ACGTACGT", 1, [], None, False)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def places(row):
    at = [0]
    for d in row[7]:
        at.append(at[-1] + d)
    return list(enumerate(zip(at, row[8] or []))) if row[5] else []


def test_places_against_plain_python(spark, monkeypatch):
    """Also where a block ends within a batch, and with a contig that is longer than a block."""
    monkeypatch.setattr(graph, "BLOCK_BASES", 30)
    monkeypatch.setattr(graph, "BLOCK_ROWS", 3)
    rows, table = contigs_of(spark)
    text = dna.decode("kmer", K).alias("kmer")
    want = [(r[0], i, at, r[5][at // 2 : at // 2 + K], c) for r in rows for i, (at, c) in places(r) if at // 2 + K <= len(r[5])]
    assert sorted(map(tuple, graph.interior(table, K).select("contig_id", "ord", "distance", text, "cov").collect())) == sorted(want) != []
    want = []
    for r in rows:
        for i, (at, c) in places(r):
            at += r[6]
            real, last = at + 2 if at % 2 else at - 2, 2 * (len(r[5]) - K) + 1
            if 0 <= real <= last:
                kmer = r[5][real // 2 : real // 2 + K]
                start = [int(x is not None and x < 4) for x in (r[2], r[4])]
                want.append((r[0], i, kmer if real % 2 else turn(kmer), c, real - start[0], last - real - start[1]))
    assert sorted(map(tuple, graph.junction_results(table, K).select("contig_id", "ord", text, "cov", "from1", "from2").collect())) == sorted(want) != []


def test_contigs_are_not_looked_at_one_by_one(spark, monkeypatch):
    """300 contigs in one partition take a few calls, not one a contig."""
    calls = spark.sparkContext.accumulator(0)
    table = spark.range(0, 300, 1, 1).select(F.col("id").alias("contig_id"), F.lit("ACGTACGT").alias("seq"), F.array(F.lit(2)).alias("distances"), F.array(F.lit(1), F.lit(2)).alias("coverages"))

    def put(contigs, more, rows, kinds):
        return real(contigs, more, lambda x: (calls.add(1), rows(x))[1], kinds)

    real = graph._places
    monkeypatch.setattr(graph, "_places", put)
    assert graph.interior(table, K).count() == 600
    assert 1 <= calls.value <= 10
