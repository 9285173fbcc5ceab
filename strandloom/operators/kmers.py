"""From reads to solid k-mers and valid fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from . import places, stretches


def fragments(reads: DataFrame, k: int, extra: int = 0) -> DataFrame:
    """read_id, frag_no (from 0, left to right) and seq of the runs of A, C, G and T of at least k + extra bases."""
    runs = F.filter(F.split("seq", "[^ACGT]+"), lambda x: F.length(x) >= dna.check_k(k) + extra)
    return reads.select("read_id", F.posexplode(runs).alias("frag_no", "seq"))


def occurrences(frags: DataFrame, k: int) -> DataFrame:
    """read_id, frag_no, pos (from 0), kmer and canon of every place in the fragments, in reading direction. Both strands are
    packed once a fragment, so that neither k-mer costs more than shifts."""
    packed = frags.select("read_id", "frag_no", F.length("seq").alias("n"), dna.blocks("seq").alias("packed"), dna.blocks(dna.revcomp_seq("seq")).alias("turned"))
    places = packed.where(F.col("n") >= k).select("read_id", "frag_no", "n", "packed", "turned", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("pos"))
    both = places.select("read_id", "frag_no", "pos", dna.kmer_at("packed", "pos", k).alias("kmer"), dna.kmer_at("turned", F.col("n") - k - F.col("pos"), k).alias("turned"))
    return both.select("read_id", "frag_no", "pos", "kmer", F.least("kmer", "turned").alias("canon"))


def kmer_counts(frags: DataFrame, k: int) -> DataFrame:
    """canon and cnt of all k-mers, a k-mer and its reverse complement being one. Of a stream, whose counts are a state, each k-mer is a row."""
    if frags.isStreaming:
        return occurrences(frags, k).groupBy("canon").agg(F.count("*").alias("cnt"))
    return stretches.counts(frags, dna.check_k(k))


def solid(counts: DataFrame, least: int = 2) -> DataFrame:
    return counts.where(F.col("cnt") >= least)


def spectrum(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cnt").agg(F.count("*").alias("kmers"))


def kmers_of_lines(lines: DataFrame, k: int) -> DataFrame:
    """Left and right k-mer of each line (column value) of k + 1 bases; bad counts lines of other lengths."""
    good = F.length("value") == k + 1
    both = F.when(good, F.array(F.substring("value", 1, k), F.substring("value", 2, k)))
    rows = lines.select(F.explode_outer(both).alias("seq"), (~good).cast("int").alias("bad"))
    return rows.select(dna.canon(dna.encode("seq"), k).alias("canon"), "bad")


def oriented(solid_kmers: DataFrame, k: int) -> DataFrame:
    """kmer: each solid k-mer in both directions."""
    both = F.array(F.col("canon"), dna.revcomp("canon", k))
    return solid_kmers.select(F.explode(F.array_distinct(both)).alias("kmer"))


def extension_masks(kmers: DataFrame, k: int) -> DataFrame:
    """stem (k - 1 bases) and mask: bit b is set if stem and base b make one of the oriented k-mers. All k-mers that end in a
    stem share its extensions, so that one row serves them all."""
    bit = F.expr("shiftleft(1, cast(kmer & 3 as int))")
    return kmers.groupBy(dna.head("kmer").alias("stem")).agg(F.bit_or(bit).alias("mask"))


def with_extensions(kmers: DataFrame, masks: DataFrame, k: int, name: str = "mask") -> DataFrame:
    """kmers with the mask of their extensions (0: none)."""
    stems = masks.select(F.col("stem").alias("_stem"), F.col("mask").alias(name))
    joined = kmers.withColumn("_stem", dna.tail("kmer", k)).join(stems, "_stem", "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0))).drop("_stem")


def jchecked(kmers: DataFrame, k: int, j: int) -> DataFrame:
    """Those (different) oriented k-mers from which a path of j solid extensions leads on."""
    alive = kmers.select("kmer")
    for _ in range(j):
        alive = places.masks(alive, k).where("mask <> 0").select("kmer")
    return alive


def leading_on(solid_kmers: DataFrame, k: int, j: int) -> DataFrame:
    """kmer: the solid k-mers (canon), in both directions, from which a path of j solid extensions leads on."""
    alive = oriented(solid_kmers, k)
    for i in range(j):
        alive = places.masks(alive if i else solid_kmers.select("canon"), k, canons=not i).where("mask <> 0").select("kmer")
    return alive


def own_valid_fragments(reads: DataFrame, k: int, extra: int = 0, least: int = 2) -> DataFrame:
    """The same, in fragments of k + extra bases or more, of the k-mers that all fragments of the reads have at least so often: cut, counted and
    looked up in one pass."""
    return places.valid_runs(reads, None, dna.check_k(k), least, extra)


def valid_and_solid(reads: DataFrame, k: int, extra: int = 0, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """own_valid_fragments(), and the k-mers that occur so often, as a packed set (places.unpacked_set())."""
    return places.valid_runs(reads, None, dna.check_k(k), least, extra, keep=True)


def checked_extensions(solid_kmers: DataFrame, k: int, j: int) -> DataFrame:
    """kmer, each solid k-mer (canon) in both directions, and mask of its extensions from which j more lead on."""
    rows = places.masks(solid_kmers.select("canon"), k, canons=True)
    for _ in range(j):
        rows = places.masks(rows.select("kmer", (F.col("mask") == 0).alias("ends")), k, silent="ends")
    return rows


def valid_fragments(frags: DataFrame, solid_kmers: DataFrame, k: int) -> DataFrame:
    """read_id, frag_no, run_no and seq of the maximal runs of at least k solid k-mers in a row."""
    return places.valid_runs(frags, solid_kmers, k)


def mercy_kmers(frags: DataFrame, counts: DataFrame, k: int, least: int = 2) -> DataFrame:
    """canon of the k-mers that are not solid but lie on a read between two solid ones, neither of which has more than one
    continuation towards them among all k-mers that were seen."""
    return places.rescued(frags, counts, k, least).distinct()
