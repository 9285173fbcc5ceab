"""Every query of the engine and its SQL, by name. All run over whole tables.

Documents play the part of DNA (sources.reads.from_documents). For graph operators, whose input SQL can hardly make, orders and
their lines play the part of contigs: orders_as_contigs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import block_pairs, block_ways, cleaning, coverage, disentangle, graph, junctions, kmers, pairs, sketch, walks
from ..sources import reads as source
from ..sources import sinks
from ..streaming import solid as streams
from . import oracle
from .assemble import assemble
from .config import Config
from .scratch import folder, written

K, J, READ, SPACER = 21, 1, 100, 25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_documents(_table(spark, sf_dir, "documents"))


def reads_with_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_documents(_table(spark, sf_dir, "documents"), breaks=True)


def read_codes(spark, sf_dir):
    """Of every read with its line ends: its first letter's code, complement and both as letters, whether it is a base, the smaller of both
    strands, and the code of its first k-mer."""
    r = reads_with_breaks(spark, sf_dir)
    first = F.substring("seq", 1, 1)
    whole = F.when(F.substring("seq", 1, K).rlike(f"^[ACGT]{{{K}}}$"), dna.encode(F.substring("seq", 1, K)))
    codes = r.select("read_id", dna.is_valid(first).alias("valid"), dna.code(first).cast("int").alias("code"), dna.canon_seq("seq").alias("canon"), whole.alias("kmer"))
    return codes.withColumn("complement", dna.complement("code").cast("int")).withColumns({"base": dna.base_of("code"), "other": dna.base_of("complement")})


def file_reads(spark, sf_dir):
    """Reads written as FASTQ files and read from them."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    record = F.concat(F.lit("@r"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("seq")))
    reads(spark, sf_dir).repartitionByRange("read_id").sortWithinPartitions("read_id").select(record.alias("value")).write.text(path)
    return source.read_sequences(spark, path, fastq=True)


def _landing(spark, sf_dir) -> str:
    """A folder of FASTQ files of all reads."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    record = F.concat(F.lit("@r\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("seq")))
    reads(spark, sf_dir).select(record.alias("value")).write.text(f"{path}/landing")
    return path


def streamed_counts(spark, sf_dir):
    """K-mer counts of a folder of FASTQ files that arrive as a stream."""
    path = _landing(spark, sf_dir)
    streams.start_file_counts(spark, f"{path}/landing", K, f"{path}/counts", f"{path}/progress").awaitTermination()
    return streams.total_counts(spark.read.schema("canon long, cnt long, batch int").parquet(f"{path}/counts"), K)


def streamed_junctions(spark, sf_dir):
    """The junction table of reads that arrive as FASTQ files, a few at a time, merged batch by batch."""
    path = _landing(spark, sf_dir)
    solid = written(solid_kmers(spark, sf_dir))
    sites = junctions.sites(_valid(spark, sf_dir), K, J)
    keys = written(junctions.junction_keys(sites, kmers.oriented(solid, K), K, J))
    streams.start_junctions(spark, f"{path}/landing", solid, keys, K, J, f"{path}/junctions", f"{path}/progress", files_a_batch=8).awaitTermination()
    rows = spark.read.schema(streams.JUNCTION + ", batch int").parquet(f"{path}/junctions").drop("batch")
    return sinks.junction_lines(streams.merge_junctions(rows, rows.limit(0)), K)


def kmer_lines(spark, sf_dir):
    """Both k-mers of lines of k + 1 bases, the heads of reads; bad counts shorter ones."""
    lines = reads(spark, sf_dir).select(F.substring("seq", 1, K + 1).alias("value"))
    return kmers.kmers_of_lines(lines, K).groupBy("canon").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))


def fragments(spark, sf_dir):
    return kmers.fragments(reads_with_breaks(spark, sf_dir), K)


def _frags(spark, sf_dir):
    return kmers.fragments(reads(spark, sf_dir), K)


def _counts(spark, sf_dir):
    return kmers.kmer_counts(_frags(spark, sf_dir), K)


def kmer_count(spark, sf_dir):
    return _counts(spark, sf_dir)


def solid_kmers(spark, sf_dir):
    return kmers.solid(_counts(spark, sf_dir))


def kmer_spectrum(spark, sf_dir):
    return kmers.spectrum(_counts(spark, sf_dir))


def kmer_strings(spark, sf_dir):
    """K-mers of all kinds of one another: text, reverse complement, ends and neighbours of every distinct one."""
    c = _counts(spark, sf_dir)
    return c.select(
        "canon", dna.decode("canon", K).alias("kmer"), dna.decode(dna.revcomp("canon", K), K).alias("turned"), dna.last_code("canon").alias("last_code"),
        dna.code_at("canon", 0, K).alias("first_code"), dna.append("canon", F.lit(3), K).alias("appended"), dna.prepend("canon", F.lit(1), K).alias("prepended"),
        dna.is_homopolymer(dna.decode("canon", K)).alias("homopolymer"),
    )


def mercy_kmers(spark, sf_dir):
    frags = _frags(spark, sf_dir)
    return kmers.mercy_kmers(frags, written(kmers.kmer_counts(frags, K)), K)


def kmer_extensions(spark, sf_dir):
    found = kmers.checked_extensions(solid_kmers(spark, sf_dir), K, 0)
    return found.select("kmer", F.bit_count("mask").alias("n_ext"), "mask")


def jcheck_1(spark, sf_dir):
    return kmers.leading_on(solid_kmers(spark, sf_dir), K, 1)


def jcheck_2(spark, sf_dir):
    return kmers.leading_on(solid_kmers(spark, sf_dir), K, 2)


def valid_extensions(spark, sf_dir):
    """The one valid extension of each oriented k-mer: -1 for none, -2 for several."""
    n = F.bit_count("mask")
    found = kmers.checked_extensions(solid_kmers(spark, sf_dir), K, J)
    return found.select("kmer", F.when(n == 0, -1).when(n > 1, -2).otherwise(F.expr("cast(log2(greatest(mask, 1)) as int)")).alias("extension"))


def _valid(spark, sf_dir):
    return kmers.own_valid_fragments(reads(spark, sf_dir), K, 2 * J + 1)


def valid_fragments(spark, sf_dir):
    return _valid(spark, sf_dir)


def _met(spark, sf_dir):
    valid, solid = kmers.valid_and_solid(reads(spark, sf_dir), K, 2 * J + 1)
    valid = written(valid)
    return valid, junctions.branching_sites(valid, solid, K, J)


def junction_keys(spark, sf_dir):
    return _met(spark, sf_dir)[1].select("kmer").distinct()


def junction_coverage(spark, sf_dir):
    cov = junctions.coverage(_met(spark, sf_dir)[1])
    return cov.select("kmer", *(F.col("cov")[i].alias(f"cov_{b.lower()}") for i, b in enumerate(dna.BASES)), junctions.paths_out("cov").alias("paths_out"))


def junction_opposites(spark, sf_dir):
    """The way through every junction from each index."""
    cov = junctions.coverage(_met(spark, sf_dir)[1]).select("kmer", "cov", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("index"))
    return cov.select("kmer", "index", junctions.opposite_index("index", "cov").alias("opposite"))


def junction_links(spark, sf_dir):
    ways = junctions.neighbours(_met(spark, sf_dir)[1], J)
    return ways.groupBy("kmer", "index").agg(F.max("dist").cast("int").alias("dist"), F.bool_or("linked").alias("linked"))


def junction_table(spark, sf_dir):
    return sinks.junction_lines(junctions.junctions(_met(spark, sf_dir)[1], J), K)


def spacer_sites(spark, sf_dir):
    """Places that are made junctions because no branching one lies within 2 SPACER - 1 half bases before them."""
    valid, met = _met(spark, sf_dir)
    return walks.spacers(valid, written(met), K, J, SPACER)


def junction_ways(spark, sf_dir):
    """Where each way from a branching junction leads: the next junction and the index back, or how far reads go."""
    valid, solid = kmers.valid_and_solid(reads(spark, sf_dir), K, 2 * J + 1)
    valid = written(valid)
    found = block_ways.ways(valid, junctions.branching(solid, K, J), K, J)
    return found.select("kmer", F.col("index").cast("int").alias("index"), "linked", F.col("dist").cast("int").alias("dist"), F.when(F.col("linked"), F.col("far")).alias("far"), F.col("far_index").cast("int").alias("far_index"), F.md5("seq").alias("seq_md5"))


def fake_junctions(spark, sf_dir):
    valid, met = _met(spark, sf_dir)
    return junctions.fake_junctions(valid, met, K, J)


def solidity_histogram(spark, sf_dir):
    return junctions.solidity_histogram(junctions.coverage(_met(spark, sf_dir)[1]))


def _found(spark, sf_dir):
    valid, met = _met(spark, sf_dir)
    met = written(met)
    return pairs.results(met, junctions.fake_junctions(valid, met, K, J), K)


def _results(spark, sf_dir):
    """Junction results in blocks, and the short pairs."""
    valid, solid = kmers.valid_and_solid(reads(spark, sf_dir), K, 2 * J + 1)
    found = junctions.branching_results(valid, solid, K, J)
    return found, block_pairs.short_pairs(found, K)


def short_pairs(spark, sf_dir):
    return _results(spark, sf_dir)[1]


def long_pairs(spark, sf_dir):
    return pairs.long_pairs(_found(spark, sf_dir), reads(spark, sf_dir), K)


def pair_scores(spark, sf_dir):
    """By fragment: how many different known pairs its junctions in a row make."""
    return block_pairs.score(*_results(spark, sf_dir), K)


def insert_sizes(spark, sf_dir):
    sums = block_pairs.insert_sums(*_results(spark, sf_dir), K)
    return pairs.mean_and_deviation(sums.select(F.concat_ws("_", "read_id", "run_no").alias("contig_id"), "n", "s", F.col("q").cast("double").alias("q")))


def pair_distances(spark, sf_dir):
    return block_pairs.distance_histogram(*_results(spark, sf_dir), K)


def scan_summary(spark, sf_dir):
    """One row: reads, fragments that are long enough, valid ones, sites looked at, junction sites, valid ones without a junction."""
    r = reads(spark, sf_dir)
    valid, met = _met(spark, sf_dir)
    met = written(met)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(r, "reads")
    for df, name in (
        (kmers.fragments(r, K, 2 * J + 1), "fragments"), (valid, "valid"), (junctions.sites(valid, K, J), "sites"), (met, "junction_sites"), (junctions.fake_junctions(valid, met, K, J), "without"),
    ):
        out = out.crossJoin(one(df, name))  # one row each
    return out


def unitigs(spark, sf_dir):
    """The contig graph of all documents' reads; SQL would take a step for each base of the longest contig."""
    c = graph.contig_graph(_counts(spark, sf_dir), K)
    return c.select("contig_id", "n1", "ind1", "n2", "ind2", F.length("seq").alias("length"), F.md5("seq").alias("seq_md5"), coverage.mean("coverages").alias("cov"), "circular")


def junction_contigs(spark, sf_dir):
    """Contigs between branching junctions and sinks of all documents' reads, before they are cleaned."""
    c = assemble(reads(spark, sf_dir), Config(k=K, j=J, read_length=READ, clean=False)).contigs
    return c.select("contig_id", "n1", "ind1", "n2", "ind2", F.length("seq").alias("length"), F.md5("seq").alias("seq_md5"), F.size("coverages").alias("junctions"), coverage.mean("coverages").alias("cov"), "circular")


def cleaned_contigs(spark, sf_dir):
    """The graph after cleaning, by length and coverage."""
    a = assemble(reads(spark, sf_dir), Config(k=K, j=J, read_length=READ))
    return a.contigs.select("contig_id", "n1", "n2", F.length("seq").alias("length"), coverage.mean("coverages").alias("cov"))


# --- orders as contigs ----------------------------------------------------------------------------------------------------------


def orders_as_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contig for each order, between two of eight nodes that its customer has: 8 custkey and the order's number modulo 8, and 8 custkey and
    7 thirds of that number modulo 8. Of a node's ends the first five, by order and side, have index 4, 0, 1, 2 and 3, and the others are
    sinks. Coverages are the quantities of the order's lines."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    node = lambda x: (F.col("o_custkey") * 8 + x % 8).cast("long").alias("node")
    ends = orders.select("o_orderkey", F.inline(F.array(F.struct(F.lit(1).alias("side"), node(F.col("o_orderkey"))), F.struct(F.lit(2).alias("side"), node(F.floor(F.col("o_orderkey") * 7 / 3))))))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("o_orderkey", "side"))
    ends = ends.withColumn("r", rank).where("r <= 5").select("o_orderkey", "side", "node", F.when(F.col("r") == 1, 4).otherwise(F.col("r") - 2).alias("ind"))
    at = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    ends = ends.groupBy("o_orderkey").agg(*(at(c, s).cast(t).alias(f"{c.replace('node', 'n')}{s}") for s in (1, 2) for c, t in (("node", "long"), ("ind", "int"))))
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("q"))
    lines = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.transform("q", lambda x: x["q"]).alias("coverages"))
    length = (50 + F.col("o_orderkey") % 150).cast("int")
    seq = F.substring(F.repeat(F.lit("ACTG"), 50), F.lit(1), length)
    joined = orders.join(lines, "o_orderkey").join(ends, "o_orderkey", "left")
    return joined.select(F.col("o_orderkey").cast("long").alias("contig_id"), "n1", "ind1", "n2", "ind2", seq.alias("seq"), F.when(F.col("ind1") < 4, 1).otherwise(0).alias("lead"), F.transform(F.slice("coverages", 2, F.size("coverages")), lambda c: F.lit(2)).alias("distances"), "coverages", F.lit(False).alias("circular"))


def contig_incidence(spark, sf_dir):
    return graph.with_outs(graph.incidence(orders_as_contigs(spark, sf_dir))).withColumn("cov", F.round("cov", 6))


def tips(spark, sf_dir):
    return graph.tips(orders_as_contigs(spark, sf_dir), READ)


def bubbles(spark, sf_dir):
    return graph.bubbles(orders_as_contigs(spark, sf_dir)).withColumns({"low_cov": F.round("low_cov", 6), "high_cov": F.round("high_cov", 6)})


def chimeras(spark, sf_dir):
    return graph.chimeras(orders_as_contigs(spark, sf_dir), ratio=1.2).withColumns({"ratio1": F.round("ratio1", 6), "ratio2": F.round("ratio2", 6)})


def collapsible_nodes(spark, sf_dir):
    return graph.collapsible(orders_as_contigs(spark, sf_dir))


def inverted_repeats(spark, sf_dir):
    return graph.inverted_repeats(orders_as_contigs(spark, sf_dir))


def degenerate_nodes(spark, sf_dir):
    return graph.degenerate(orders_as_contigs(spark, sf_dir))


def isolated_contigs(spark, sf_dir):
    return graph.isolated(orders_as_contigs(spark, sf_dir)).select("contig_id", F.length("seq").alias("length"))


def longest_contig(spark, sf_dir):
    return graph.longest(orders_as_contigs(spark, sf_dir)).select("contig_id", F.length("seq").alias("length"))


def contig_coverage_stats(spark, sf_dir):
    c = orders_as_contigs(spark, sf_dir)
    return c.select(
        "contig_id", F.round(coverage.mean("coverages"), 6).alias("mean"), F.round(coverage.deviation("coverages"), 6).alias("deviation"), F.round(coverage.mass("coverages", F.length("seq")), 4).alias("mass"),
        F.aggregate("distances", F.lit(0), lambda s, d: s + d).alias("distance"), F.array_join(F.transform(coverage.shifted("coverages", F.lit(230.5)), lambda x: x.cast("string")), " ").alias("shifted"),
        F.array_join(F.transform(coverage.scaled("coverages", F.lit(0.25)), lambda x: x.cast("string")), " ").alias("scaled"),
    )


def _neighbours(spark, sf_dir):
    """Each contig with the next one, by id, of its first node."""
    c = orders_as_contigs(spark, sf_dir).where("n1 is not null").select("n1", "contig_id", "coverages")
    order = Window.partitionBy("n1").orderBy("contig_id")
    return c.select(F.col("contig_id").alias("a"), F.lead("contig_id").over(order).alias("b"), F.col("coverages").alias("ca"), F.lead("coverages").over(order).alias("cb")).where("b is not null")


def coverage_equivalence(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("a", "b", coverage.equivalent(F.col("ca"), F.col("cb"), 0.9).alias("equivalent"))


def coverage_difference(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("a", "b", coverage.different(F.col("ca"), F.col("cb")).alias("different"))


def bloom_hashes(spark, sf_dir):
    """Two hashes of each order's key, modulo 2^40."""
    keys = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("key"))
    return keys.select("key", sketch.hash_column("key", 0, 1 << 40).alias("h0"), sketch.hash_column("key", 1, 1 << 40).alias("h1"))


def bloom_members(spark, sf_dir):
    """Which k-mers of all pass a filter of the solid ones: never fewer than those."""
    counts = written(_counts(spark, sf_dir))
    solid = kmers.solid(counts)
    bits, n = sketch.optimal(max(solid.count(), 1), 0.04)
    members = sketch.contains(counts, "canon", sketch.build(solid, "canon", bits, n), bits, n)
    return members.agg(F.count("*").alias("members"), F.count_if(F.col("cnt") >= 2).alias("solid"))


def bloom_sizing(spark, sf_dir):
    """Sizes of filters for each nation's customers, a row a nation."""
    nations = _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("int").alias("nation")).agg(F.count("*").alias("items")).collect()
    rows = [(r.nation, r["items"], *sketch.optimal(r["items"], 0.04), *sketch.two_hashes(r["items"], 0.04), *sketch.pair_filter_items(r["items"], True)) for r in nations]
    return spark.createDataFrame(rows, "nation int, items long, bits long, hashes int, bits2 long, hashes2 int, short_items long, long_items long")


def crossings(spark, sf_dir):
    """Contigs between two nodes that have two ways ahead each."""
    found = disentangle.crossings(orders_as_contigs(spark, sf_dir))
    return found.select("middle", "p", "q", *(F.col(f"{c}.contig_id").alias(c) for c in "abcd"))


def crossing_votes(spark, sf_dir):
    """What coverages say about them."""
    c = orders_as_contigs(spark, sf_dir)
    return disentangle.votes(disentangle.crossings(c), c, 2.0, 1.2).drop("p", "q", "a", "b", "c", "d")


def loops(spark, sf_dir):
    """Contigs that a loop brings back to their start."""
    return disentangle.loops(orders_as_contigs(spark, sf_dir)).select("middle", "p", "q", F.col("loop.contig_id").alias("loop"), F.col("l.contig_id").alias("before"), F.col("r.contig_id").alias("after"))


def bulges(spark, sf_dir):
    return cleaning.bulges(orders_as_contigs(spark, sf_dir), ratio=1.2).withColumn("low_cov", F.round("low_cov", 6))


def long_bulges(spark, sf_dir):
    found = cleaning.long_bulges(orders_as_contigs(spark, sf_dir), K, most=199, ratio=1.2)
    return found.select("node", "gone", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"), F.round("low_cov", 6).alias("low_cov"))


def contig_junctions(spark, sf_dir):
    return graph.interior(orders_as_contigs(spark, sf_dir), K)


def contig_results(spark, sf_dir):
    """The real extensions of the junctions along contigs, with their distances from both ends."""
    return graph.junction_results(orders_as_contigs(spark, sf_dir), K)


def pair_candidates(spark, sf_dir):
    """From every way of a node with two of them, the junctions within 12 half bases, across contigs, numbered by distance."""
    c = written(orders_as_contigs(spark, sf_dir))
    starts = graph.with_outs(graph.incidence(c)).where("outs = 2 and ind < 4").select("node", "ind", F.lit(12).cast("long").alias("most"))
    return disentangle.candidates(c, starts, K)


def graph_problems(spark, sf_dir):
    return graph.violations(orders_as_contigs(spark, sf_dir), K)


def contig_output(spark, sf_dir):
    return sinks.contig_records(orders_as_contigs(spark, sf_dir), READ, K)


def fasta_records(spark, sf_dir):
    return sinks.fasta_lines(contig_output(spark, sf_dir))


def fastg_records(spark, sf_dir):
    return sinks.fastg_lines(orders_as_contigs(spark, sf_dir))


def fastg_headers(spark, sf_dir):
    return sinks.fastg_lines(orders_as_contigs(spark, sf_dir)).select(F.split("value", "\n")[0].alias("header"))


QUERIES = {
    f.__name__: f
    for f in (
        reads, read_codes, file_reads, streamed_counts, streamed_junctions, kmer_lines, fragments, kmer_count, solid_kmers, kmer_spectrum, kmer_strings, mercy_kmers, kmer_extensions, jcheck_1, jcheck_2, valid_extensions, valid_fragments, junction_keys, junction_coverage,
        junction_opposites, junction_links, junction_table, spacer_sites, junction_ways, fake_junctions, solidity_histogram, short_pairs, long_pairs, pair_scores, insert_sizes, pair_distances, scan_summary, unitigs, junction_contigs, cleaned_contigs, contig_incidence, tips, bubbles, chimeras,
        collapsible_nodes, inverted_repeats, degenerate_nodes, isolated_contigs, longest_contig, contig_coverage_stats, coverage_equivalence, coverage_difference, bloom_hashes, bloom_sizing, bloom_members,
        crossings, crossing_votes, loops, bulges, long_bulges, contig_junctions, contig_results, pair_candidates, graph_problems, contig_output, fasta_records, fastg_records, fastg_headers,
    )
}
ORACLE_SQL = oracle.sql(K, J, READ, SPACER)
