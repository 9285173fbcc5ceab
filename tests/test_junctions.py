"""Golden junction tables of small scans, and exact mode against a scan that does not depend on order."""

import random

from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import junctions, kmers, pairs
from strandloom.operators.parity import Scan, _canon, scan_in_order
from strandloom.streaming.solid import merge_junctions

LONG = "ACGGGCGAACTTTCATAGGATCGCACTCAC"


def table(text):
    out = {}
    for line in text.strip().splitlines():
        kmer, *rest = line.split()
        out[kmer] = ([int(x) for x in rest[:5]], [int(x) for x in rest[5:9]], [x == "1" for x in rest[9:]])
    return out


def all_kmers(reads, k):
    return {_canon(r[i : i + k]) for r in reads for i in range(len(r) - k + 1)}


def scan(spark, reads, k, valid=(), more=(), order=None):
    valid = all_kmers(reads, k) if not valid else {_canon(x) for x in valid}
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    got = scan_in_order(df, valid | {_canon(x) for x in more}, k, 0, 8).collect()
    return {r.kmer: (list(r.dist), list(r.cov), list(r.linked)) for r in got}


def test_one_read_without_junctions(spark):
    assert scan(spark, [LONG[:20]], 5) == table("AACTT 0 0 15 0 15 0 0 1 0 0 0 1 0 0\nTCCTA 0 0 15 0 1 0 0 1 0 0 0 1 0 0")


def test_one_read_with_a_branch(spark):
    want = table("CCTAT 0 0 0 15 3 0 0 0 1 0 0 0 1 0\nGAACT 0 0 15 0 13 0 0 1 0 0 0 1 0 0")
    assert scan(spark, [LONG[:20]], 5, more=["AACTC", "ACTCC"]) == want


# The k-mers taken as valid in the scan of one long read.
LONG_VALID = """ACGGG CGGGC GGGCG GGCGA GCGAA CGAAC GAACT AACTT ACTTT CTTTC TTTCA TTCAT TCATA CATAG ATAGG TAGGA
AGGAT GGATC GATCG ATCGC TCGCA CGCAC GCACT CACTC ACTCA CTCAC""".split()


def test_a_long_read(spark):
    want = table("""ATCGC 1 0 0 0 3 1 0 0 0 1 0 0 0 1
CGATC 0 1 0 0 3 0 1 0 0 0 1 0 0 1
GGATC 0 0 0 1 12 0 0 0 1 0 0 0 1 1
GGCGA 1 0 0 0 7 1 0 0 0 1 0 0 0 0
TGCGA 0 0 1 0 11 0 0 1 0 0 0 1 0 0
TTCAT 12 0 0 0 15 1 0 0 0 1 0 0 0 1
TTCGC 0 1 0 0 15 0 1 0 0 0 1 0 0 1""")
    assert scan(spark, [LONG], 5, valid=LONG_VALID) == want


def test_three_reads(spark):
    reads = ["ACGGGCGAACTTTCATAGGA", "GGCGAACTAGTCCAT", "AACTTTCATACGATT"]
    want = table("CTAGT 0 8 3 0 3 0 1 1 0 0 0 1 0 1\nGAACT 3 0 12 0 13 1 0 1 0 1 0 1 0 0\nTCATA 0 10 0 6 12 0 1 0 1 0 0 0 0 1")
    assert scan(spark, reads, 5) == want
    assert scan(spark, reads[::-1], 5) == want


def test_two_reads_of_seven(spark):
    want = table("AATCGCT 0 12 0 12 1 0 1 0 1 0 0 0 0 1\nAGCGATT 0 2 4 0 1 0 1 1 0 0 0 0 0 1")
    assert scan(spark, ["AAAAACAGCGATTC", "AAAAAGAGCGATTTA"], 7) == want


def test_jcheck(spark):
    reads = ["ACGGGCGAACTTTCATAGGA", "GGCGAACTAGTCCAT", "AACTTTCATACGATT"]
    valid = [(x,) for r in reads for x in {r[i : i + 5] for i in range(len(r) - 4)}]
    both = spark.createDataFrame(valid, "s string").select(dna.canon(dna.encode("s"), 5).alias("canon")).distinct()
    both = kmers.oriented(both, 5)
    for kmer, j, want in (("TCCAT", 1, False), ("GTCCA", 1, True), ("GAACT", 2, True), ("ACGAT", 2, False)):
        alive = {r.s for r in kmers.jchecked(both, 5, j).select(dna.decode("kmer", 5).alias("s")).collect()}
        assert (kmer in alive) == want
        assert Scan({_canon(x) for (x,) in valid}, 5, j, 8).leads_on(kmer, j) == want


def reads_of(seed, n=120, length=400):
    rnd = random.Random(seed)
    genome = "".join(rnd.choice("ACGT") for _ in range(length))
    other = genome[:200] + ("A" if genome[200] != "A" else "C") + genome[201:]
    return [(lambda g, p: g[p : p + 40])(rnd.choice([genome, other]), rnd.randrange(length - 39)) for _ in range(n)]


def exact(spark, reads, k, j):
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    solid = kmers.solid(kmers.kmer_counts(kmers.fragments(df, k), k)).cache()
    valid = kmers.valid_fragments(kmers.fragments(df, k, 2 * j + 1), solid, k).cache()
    sites = junctions.sites(valid, k, j)
    met = junctions.junction_sites(sites, junctions.junction_keys(sites, kmers.oriented(solid, k), k, j)).cache()
    return df, solid, valid, met


def test_exact_mode_against_plain_python(spark):
    k, j = 9, 1
    reads = reads_of(3)
    df, solid, valid, met = exact(spark, reads, k, j)
    counts = {}
    for r in reads:
        for i in range(len(r) - k + 1):
            counts[_canon(r[i : i + k])] = counts.get(_canon(r[i : i + k]), 0) + 1
    good = {x for x, n in counts.items() if n >= 2}
    plain = Scan(good, k, j, 10**9)
    frags = [f for r in reads for f in plain.fragments(r)]
    assert sorted(frags) == sorted(r.seq for r in valid.collect())
    places = [(f, t, *plain.at(f, t)) for f in frags for t in range(2 * j + 1, 2 * len(f) - 2 * k - 2 * j + 1)]
    keys = {p[2] for p in places if plain.branches(p[2], p[3])}
    cov = {x: [0] * 4 for x in keys}
    for _, _, kmer, ext, *_ in places:
        if kmer in keys:
            cov[kmer][ext] += 1
    got = {r.s: list(r.cov) for r in junctions.coverage(met).select(dna.decode("kmer", k).alias("s"), "cov").collect()}
    assert got == cov and len(cov) > 1


def test_order_of_reads_does_not_matter(spark):
    a, b = reads_of(4), reads_of(4)[::-1]
    ta, tb = (sorted(map(str, junctions.junctions(exact(spark, x, 9, 1)[3], 1).collect())) for x in (a, b))
    assert ta == tb and ta


def test_pairs_and_merge(spark):
    k, j = 9, 1
    _, _, valid, met = exact(spark, reads_of(5), k, j)
    fake = junctions.fake_junctions(valid, met, k, j)
    found = pairs.results(met, fake, k).cache()
    assert found.select("read_id", "frag_no", "run_no").distinct().count() == valid.count()
    known = pairs.short_pairs(found, k).cache()
    assert known.count() > 0 and known.where("k1 > k2").count() == 0
    t = junctions.junctions(met, j).cache()
    twice = {r.kmer: list(r.cov) for r in merge_junctions(t, t).collect()}
    assert twice == {r.kmer: [min(255, 2 * c) for c in r.cov] for r in t.collect()}
    row = known.select(F.lit(1).alias("g"), F.col("k1").alias("a"), F.col("k2").alias("b"))
    assert pairs.score(row.unionByName(row), known, ["g"], "a", "b", k).first().score == known.count()
    assert pairs.present(row, known, "b", "a", k).count() == known.count()


def test_insert_size(spark):
    places = [(0, 5, 0), (1, 6, 10), (2, 7, 30), (3, 5, 3000), (4, 6, 3010)]
    rows = spark.createDataFrame([(1, *p) for p in places[:3]] + [(2, *p) for p in places] + [(3, 0, 8, 0), (3, 1, 9, 4)], "contig_id long, ord int, kmer long, distance long")
    k = 31
    known = spark.createDataFrame([(5, 6), (5, 7)], "k1 long, k2 long").select(*pairs.pair_key("k1", "k2", k))
    got = {r.contig_id: (r["mean"], r["std"]) for r in pairs.insert_size(rows, known, k).collect()}
    assert got == {1: (20, 20), 2: (16, 13)}  # a contig without known pairs has no row; pairs 3000 apart are out of reach
    assert pairs.insert_size(rows, known.limit(0), k).count() == 0
    near = [(c, a[1], b[1], b[2] - a[2]) for c, own in ((1, places[:3]), (2, places)) for i, a in enumerate(own) for b in own[i:] if b[2] - a[2] <= 500]
    assert sorted((r.contig_id, r.kmer_a, r.kmer_b, r.distance) for r in pairs.within(rows.where("contig_id < 3"), 500).collect()) == sorted(near)
