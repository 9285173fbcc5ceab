import gzip

from pyspark.sql import functions as F

from strandloom.operators import coverage, kmers, sketch
from strandloom.sources import reads as source
from strandloom.streaming import solid as stream


def test_fastq_and_fasta(spark, tmp_path):
    seqs = ["ACGT", "GGNA", "TTTT", "CCCC"]
    fq = "".join(f"@r{i}\n{s}\n+\n@{'I' * (len(s) - 1)}\n" for i, s in enumerate(seqs))
    (tmp_path / "a.fq").write_text(fq)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(fq)
    got = [(r.read_id, r.pair_id, r.mate, r.seq) for r in source.read_sequences(spark, [f"{tmp_path}/a.fq", f"{tmp_path}/b.fq.gz"], fastq=True).orderBy("read_id").collect()]
    assert got == [(i, i // 2, i % 2, s) for i, s in enumerate(seqs * 2)]
    (tmp_path / "a.fa").write_text("".join(f">r{i}\n{s}\n" for i, s in enumerate(seqs)))
    assert [r.seq for r in source.read_sequences(spark, f"{tmp_path}/a.fa").orderBy("read_id").collect()] == seqs


def test_fastq_in_many_pieces(spark, tmp_path):
    (tmp_path / "a.fq").write_text("".join(f"@r{i}\n{'ACGT' * (i % 7 + 1)}\n+\n@@@@\n" for i in range(3000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        got = source.read_sequences(spark, f"{tmp_path}/a.fq", fastq=True).orderBy("read_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [(r.read_id, r.seq) for r in got] == [(i, "ACGT" * (i % 7 + 1)) for i in range(3000)]


def test_lines_of_kmers(spark):
    got = kmers.kmers_of_lines(spark.createDataFrame([("ACGTA",), ("ACG",)], "value string"), 4).collect()
    assert sum(r.bad for r in got) == 1 and len(got) == 3


def test_junction_text_round_trip(spark, tmp_path):
    (tmp_path / "j").write_text("ACGTA 1 2 3 4 5  1 0 2 0  3  1 0 0 0 1 \n")
    r = source.read_junctions(spark, f"{tmp_path}/j").first()
    assert (r.kmer, r.dist, r.cov, r.linked) == ("ACGTA", [1, 2, 3, 4, 5], [1, 0, 2, 0], [True, False, False, False, True])


def test_streams(spark, tmp_path):
    reads = ["ACGTACGTTT", "ACGTACGTTT", "GGGGGCCCCC"]
    for i, s in enumerate(reads):
        (tmp_path / f"in{i}").mkdir()
        (tmp_path / "landing").mkdir(exist_ok=True)
        (tmp_path / "landing" / f"{i}.txt").write_text(f">r\n{s}\n")
    q = stream.start_counts(source.read_stream(spark, f"{tmp_path}/landing", 1), 5, f"{tmp_path}/counts", f"{tmp_path}/cp")
    q.awaitTermination()
    got = {(r.canon, r.cnt) for r in stream.total_counts(spark.read.parquet(f"{tmp_path}/counts")).collect()}
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    assert got == {(r.canon, r.cnt) for r in kmers.kmer_counts(kmers.fragments(df, 5), 5).collect()}
    q = stream.solid_stream(source.read_stream(spark, f"{tmp_path}/landing"), 5).writeStream.format("memory").queryName("solid").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.canon, r.cnt) for r in spark.table("solid").collect()} == {x for x in got if x[1] >= 2}


def test_windowed_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", "ACGTA"), ("2024-01-01 00:00:20", "TACGT"), ("2024-01-01 01:00:00", "ACGTA")], "t string, seq string").select(F.col("t").cast("timestamp").alias("t"), "seq")
    rows.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = stream.windowed_counts(live, 5, "t", "10 minutes", "5 minutes").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.cnt for r in spark.table("win").collect()) == [1, 2]


def test_bloom_vectors(spark):
    s = sketch.seeds()
    assert s[:2] == [0xFFAA54FFE6E6E6E7, 0x1140AADA557088A4]
    import numpy as np

    keys = np.array([0, 1, 12345, 2**62 - 1], np.int64)
    assert sketch.hashes(keys, s[0]).tolist() == [6861592263401652007, 7314369031751636626, 8692072586082167546, 2538688608113292541]
    assert sketch.hashes(keys, s[1]).tolist() == [2724427018418534667, 3079178751457639345, 18358401329178928888, 14515605839779558937]
    assert sketch.optimal(10**9, sketch.first_rate(10**9, 2 * 10**8, 0.04)) == (1 << 33, 3)
    assert abs(sketch.first_rate(10**9, 2 * 10**8, 0.04) - 0.0705) < 1e-3
    assert sketch.two_hashes(100, 0.04) == (1024, 2)
    assert sketch.pair_filter_items(1000, True) == (50, 100) and sketch.pair_filter_items(1000, False, high_cov=True) == (500, 0)
    df = spark.range(1000).withColumnRenamed("id", "x")
    bits, n = sketch.optimal(500, 0.01)
    part = sketch.build(df.where("x % 2 = 0"), "x", bits, n)
    hit = {r.x for r in sketch.contains(df, "x", part, bits, n).collect()}
    assert hit >= set(range(0, 1000, 2)) and len(hit) < 540
    assert 0 < sketch.weight(part, bits).first().weight < 1


def test_coverage_statistics(spark):
    a, b, c = [10, 11, 12, 10, 11], [10, 11, 11, 10, 12], [30, 33, 31, 29, 32]
    df = spark.createDataFrame([(a, b), (a, c), (a, [5, 5]), ([4] * 5, [4] * 5)], "a array<int>, b array<int>")
    got = df.select(coverage.equivalent(F.col("a"), F.col("b"), 0.1).alias("e"), coverage.different(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(r.e, r.d) for r in got] == [(True, False), (False, True), (False, False), (False, False)]
    r = df.limit(1).select(coverage.mean("a").alias("m"), coverage.deviation("a").alias("s"), coverage.shifted_range("a", F.lit(250), 0, 1).alias("x")).first()
    assert (round(r.m, 3), round(r.s, 3), r.x) == (10.8, 0.837, [255, 255, 12, 10, 11])


def test_whole_texts_are_read(spark):
    texts = [(1, "a" * 99), (2, "c!" * 100), (3, "t" * 101), (4, "g" * 149 + "a"), (5, "t" * 160), (6, ""), (7, None), (None, "a" * 200), (8, "123")]
    got = {}
    for r in source.from_documents(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("read_id").collect():
        got.setdefault(r.read_id // source.READS_OF_A_TEXT, []).append(r.seq)
    letter = dict(zip(source.LETTERS, source.LETTER_BASES))
    a, c, g, t = (letter[x] for x in "acgt")
    assert got == {1: [a * 99], 2: [c * 100], 3: [t * 100] * 2, 4: [g * 100, g * 99 + a], 5: [t * 100] * 3}


def test_fastq_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fq").write_text("".join(f"@r{i}\n{'ACGT' * (i + 2)}\n+\n{'@' * 4 * (i + 2)}\n" for i in range(5)))
    q = source.read_stream(spark, f"{tmp_path}/in", fastq=True).writeStream.format("memory").queryName("fq").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.seq for r in spark.table("fq").collect()) == sorted("ACGT" * (i + 2) for i in range(5))


def test_files_of_any_size_arrive_in_batches(spark, tmp_path):
    """Files are cut into many tasks; a stream that is started again takes up the new ones only, and a batch that ran before its end runs again."""
    import random

    from strandloom.operators import junctions

    k, j, rnd = 9, 1, random.Random(4)
    genome = "".join(rnd.choice("ACGT") for _ in range(400))
    other = genome[:200] + ("A" if genome[200] != "A" else "C") + genome[201:]
    reads = [(lambda g, p: g[p : p + 40])(rnd.choice([genome, other]), rnd.randrange(361)) for _ in range(240)]
    (tmp_path / "in").mkdir()
    put = lambda n, part: (tmp_path / "in" / f"{n}.fq").write_text("".join(f"@r\n{s}\n+\n{'@' * len(s)}\n" for s in part))
    put(0, reads[:100]), put(1, reads[100:150])
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    solid = kmers.solid(kmers.kmer_counts(kmers.fragments(df, k), k)).cache()
    valid = kmers.valid_fragments(kmers.fragments(df, k, 2 * j + 1), solid, k).cache()
    sites = junctions.sites(valid, k, j)
    keys = junctions.junction_keys(sites, kmers.oriented(solid, k), k, j).cache()
    start = lambda: stream.start_junctions(spark, f"{tmp_path}/in", solid, keys, k, j, f"{tmp_path}/out", f"{tmp_path}/cp", files_a_batch=1).awaitTermination()
    merge = lambda: stream.junction_state(spark, f"{tmp_path}/out").writeStream.format("memory").queryName("state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        start()
        put(2, reads[150:])
        start()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    merge()
    want = sorted(map(str, junctions.junctions(junctions.junction_sites(sites, keys), j).collect()))
    assert sorted(map(str, spark.table("state").collect())) == want and len(want) > 1
    stream.start_file_counts(spark, f"{tmp_path}/in", k, f"{tmp_path}/counts", f"{tmp_path}/cp2").awaitTermination()
    got = {(r.canon, r.cnt) for r in stream.total_counts(spark.read.parquet(f"{tmp_path}/counts")).collect()}
    assert got == {(r.canon, r.cnt) for r in kmers.kmer_counts(kmers.fragments(df, k), k).collect()}


def test_long_sequences_are_packed_in_one_pass(spark):
    import random

    from strandloom.functions import dna

    rnd = random.Random(3)
    g = "".join(rnd.choice("ACGT") for _ in range(200_003))
    df = spark.createDataFrame([(g,)], "seq string").select(dna.blocks("seq").alias("b")).select(*(dna.kmer_at("b", F.lit(p), 31).alias(f"k{p}") for p in (0, 17, 100_000, 199_972)))
    want = [int("".join(str("ACTG".index(x)) for x in g[p : p + 31]), 4) for p in (0, 17, 100_000, 199_972)]
    assert list(df.first()) == want


def test_bloom_filter_against_plain_sets(spark, monkeypatch):
    """Keys of several blocks, with a column beside them, a key twice and a null one; no row a bit is shuffled."""
    monkeypatch.setattr(sketch, "BLOCK_KEYS", 64)
    df = spark.range(-300, 700, 1, 3).select((F.col("id") * 7919).alias("x"), F.col("id").cast("string").alias("s"))
    df = df.unionByName(df.where("x % 5 = 0")).unionByName(df.limit(1).select(F.lit(None).cast("long").alias("x"), "s"))
    bits, n = sketch.optimal(300, 0.2)
    h0, h1 = sketch.hash_column("x", 0, bits), sketch.hash_column("x", 1, bits)
    rows = df.where("x is not null").select("x", "s", h0.alias("h0"), h1.alias("h1")).collect()
    at = lambda r: {(r.h0 + i * r.h1) % bits for i in range(n)}
    on = set().union(*(at(r) for r in rows if r.x % 3 == 0))
    part = sketch.build(df.where("x % 3 = 0"), "x", bits, n)
    found = sketch.contains(df, "x", part, bits, n)
    want = sorted((r.x, r.s) for r in rows if at(r) <= on)
    assert sorted(map(tuple, found.collect())) == want and len({x for x, _ in want if x % 3}) > 0 < len(rows) - len(want)
    assert sketch.weight(part, bits).first().weight == len(on) / bits
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sketch.contains(df, "x", part.where("false"), bits, n).count() == 0
