"""Junctions: oriented k-mers at which reads could have gone on differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.scratch import written
from . import places
from .kmers import extension_masks, jchecked, leading_on, with_extensions

BACK = 4  # index of the way back; 0 to 3 are the bases ahead


def sites(valid: DataFrame, k: int, j: int) -> DataFrame:
    """Every oriented k-mer that a scan of the valid fragments looks at: read_id, frag_no, run_no, tpos, to_end, kmer, ext.

    tpos counts half bases: at 2 pos + 1 the k-mer in reading direction, at 2 pos its reverse complement. The scan starts
    at 2 j + 1 and ends where fewer than 2 j + 1 half bases are left. ext is the code of the base that the read really
    has ahead of the oriented k-mer.
    """
    long_enough = valid.where(F.length("seq") >= k + 2 * j + 1)
    return sites_at(long_enough.withColumn("tpos", F.sequence(F.lit(2 * j + 1), 2 * F.length("seq") - 2 * k - 2 * j)), k)


def sites_at(places: DataFrame, k: int) -> DataFrame:
    """The sites at the half bases tpos (a number or several) of valid fragments."""
    packed = places.select("read_id", "frag_no", "run_no", "tpos", F.length("seq").alias("n"), dna.blocks("seq").alias("packed"), dna.blocks(dna.revcomp_seq("seq")).alias("turned"))
    if dict(packed.dtypes)["tpos"].startswith("array"):
        packed = packed.withColumn("tpos", F.explode("tpos"))
    # on the strand that the oriented k-mer lies on, the base ahead is the one after it
    ahead = F.col("tpos").bitwiseAND(1) == 1
    pos = F.shiftright("tpos", 1)
    places = packed.select(
        "read_id", "frag_no", "run_no", "tpos", (2 * F.col("n") - F.col("tpos") - 2 * k + 1).alias("to_end"),
        F.when(ahead, F.col("packed")).otherwise(F.col("turned")).alias("strand"), F.when(ahead, pos).otherwise(F.col("n") - k - pos).alias("pos"),
    )
    return places.select("read_id", "frag_no", "run_no", "tpos", "to_end", dna.kmer_at("strand", "pos", k).alias("kmer"), dna.kmer_at("strand", F.col("pos") + k, 1).cast("int").alias("ext"))


def junction_keys(all_sites: DataFrame, oriented_kmers: DataFrame, k: int, j: int) -> DataFrame:
    """kmer: those met at a site that have another extension than the read's, solid and followed by j more."""
    masks = extension_masks(jchecked(oriented_kmers, k, j), k)
    met = all_sites.groupBy("kmer").agg(F.bit_or(F.expr("shiftleft(1, ext)")).alias("read_mask"))
    # another than the read's: there are two or more, or one that some read did not take
    return with_extensions(met, masks, k).where("bit_count(mask) > 1 or (mask <> 0 and read_mask & ~mask <> 0)").select("kmer")


def branching(solid_kmers: DataFrame, k: int, j: int) -> DataFrame:
    """kmer: the solid k-mers (canon, or a packed set), in both directions, that have several extensions followed by j more. For j of 1 only the k-mers with several
    extensions move, and those without any, which take a way from them; not all k-mers a second time."""
    packed = solid_kmers.columns == ["keys"]
    if j != 1:
        solid_kmers = places.unpacked_set(solid_kmers) if packed else solid_kmers
        return places.masks(leading_on(solid_kmers, k, j), k).where("bit_count(mask) > 1").select("kmer")
    found = written(places.masks(solid_kmers if packed else solid_kmers.select("canon"), k, canons=True, branching=True))
    ends = extension_masks(found.where("mask = 0").select("kmer"), k)
    return with_extensions(found.where("mask <> 0"), ends, k, "ends").where("bit_count(mask & ~ends) > 1").select("kmer")


def branching_sites(valid: DataFrame, solid_kmers: DataFrame, k: int, j: int) -> DataFrame:
    """The sites of valid fragments, made of the solid k-mers, whose k-mers are junctions. A site's own extension is solid and followed by j
    more, so that another one makes two: what junction_keys() finds at sites are the branching k-mers."""
    return places.sites_of(valid, branching(solid_kmers, k, j), k, j)


def branching_results(valid: DataFrame, solid_kmers: DataFrame, k: int, j: int) -> DataFrame:
    """The same sites, and a marker in each fragment without any, as blocks of junction results (places.results_of())."""
    return places.results_of(valid, branching(solid_kmers, k, j), k, j)


def junction_sites(all_sites: DataFrame, keys: DataFrame) -> DataFrame:
    return all_sites.join(keys, "kmer", "left_semi")


def coverage(met: DataFrame) -> DataFrame:
    """kmer and cov: how often each base follows, at most 255."""
    counts = [F.least(F.count_if(F.col("ext") == b), F.lit(255)).cast("int") for b in range(4)]
    return met.groupBy("kmer").agg(F.array(*counts).alias("cov"))


def neighbours(met: DataFrame, j: int) -> DataFrame:
    """kmer, index, dist and linked: for both ways from each site the half bases to the next junction of the fragment
    (linked), or to its end."""
    order = Window.partitionBy("read_id", "frag_no", "run_no").orderBy("tpos")
    ahead = F.col("tpos").bitwiseAND(1) == 1
    rows = met.select(
        "kmer", F.when(ahead, F.col("ext")).otherwise(BACK).alias("onward"), F.when(ahead, BACK).otherwise(F.col("ext")).alias("back"),
        (F.lead("tpos").over(order) - F.col("tpos")).alias("to_next"), (F.col("tpos") - F.lag("tpos").over(order)).alias("to_last"),
        (F.col("to_end") - 2 * j).alias("to_end"), (F.col("tpos") - 2 * j).alias("to_start"),
    )
    way = lambda index, near, far: F.struct(F.col(index).alias("index"), F.coalesce(near, far).alias("dist"), F.col(near).isNotNull().alias("linked"))
    return rows.select("kmer", F.inline(F.array(way("onward", "to_next", "to_end"), way("back", "to_last", "to_start"))))


def junctions(met: DataFrame, j: int) -> DataFrame:
    """kmer, dist (5), cov (4) and linked (5): the largest distance, the count and any link of each index."""
    ways = neighbours(met, j)
    dist = F.array(*(F.coalesce(F.max(F.when(F.col("index") == i, F.least("dist", F.lit(255)))), F.lit(0)).cast("int") for i in range(5)))
    linked = F.array(*(F.coalesce(F.bool_or(F.when(F.col("index") == i, F.col("linked"))), F.lit(False)) for i in range(5)))
    return ways.groupBy("kmer").agg(dist.alias("dist"), linked.alias("linked")).join(coverage(met), "kmer").select("kmer", "dist", "cov", "linked")


def fake_junctions(valid: DataFrame, met: DataFrame, k: int, j: int) -> DataFrame:
    """A marker in the middle of each valid fragment without a junction: its keys, kmer, ext, and the distances back and on."""
    bare = valid.join(met.select("read_id", "frag_no", "run_no").distinct(), ["read_id", "frag_no", "run_no"], "left_anti")
    n = F.length("seq")
    pos = F.floor(n / 2).cast("int") - k // 2
    packed = dna.blocks("seq")
    tpos = 2 * pos + 1
    return bare.select(
        "read_id", "frag_no", "run_no", dna.kmer_at(packed, pos, k).alias("kmer"), dna.kmer_at(packed, pos + k, 1).cast("int").alias("ext"),
        (tpos - 2 * j).alias("dist_back"), (2 * n - tpos - 2 * k + 1 - 2 * j).alias("dist_on"),
    )


def paths_out(cov) -> Column:
    return F.size(F.filter(cov, lambda c: c > 0))


def opposite_index(index: str, cov: str) -> Column:
    """The way through a junction: from a base ahead back, from the back to the first base that is covered (null without one)."""
    return F.when(F.col(index) < BACK, F.lit(BACK)).otherwise(F.expr(f"get(filter(sequence(0, 3), i -> get({cov}, i) > 0), 0)"))


def is_solid(cov, least: int) -> Column:
    return F.size(F.filter(cov, lambda c: c >= least)) > 1


def solidity_histogram(cov: DataFrame) -> DataFrame:
    """i (0 to 4) and n: junctions of which two or more ways have a coverage of i at least."""
    return cov.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), "cov").groupBy("i").agg(F.count_if(F.expr("size(filter(cov, c -> c >= i)) > 1")).alias("n"))
