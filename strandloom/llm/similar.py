"""Sets of hashes that resemble each other: MinHash bands, exact Jaccard similarity, components. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_written, written

#: Ranges that the hashes fall into, and smallest hashes of a range that make its band.
RANGES, BAND_HASHES = 5, 3
#: Sets that lead in a bucket's second round (all, if it has fewer; else so many on average), and how many times as many in each one after it, until no set is left that has not met the others.
LEADERS, MORE = 64, 64
#: Longs of a sketch.
SKETCH_LONGS = 16


def with_bands(rows: DataFrame, hashes: str = "set") -> DataFrame:
    """rows with bands, an array of RANGES longs or nulls, from a column of different hashes.

    One permutation serves for all bands: the hashes are cut into RANGES ranges by their value, and the BAND_HASHES
    smallest of a range (all, if it has fewer) make its band; an empty range has none. Sets of Jaccard similarity s
    share a given band with a probability of s ** BAND_HASHES or more, so at 0.8 one of five with 0.97, at 0.9 with 0.999.
    Of small sets, whose ranges hold no more than a band's hashes, those that differ in fewer hashes than there are
    bands share one for certain.
    """
    ends = [i * (1 << 64) // RANGES - (1 << 63) for i in range(RANGES)]
    # the ends sorted in among the hashes; where they stand tells what is in a range
    row = F.sort_array(F.concat(hashes, F.array(*(F.lit(x).cast("long") for x in ends))))
    rows = rows.withColumn("_row", row)
    at = [F.array_position("_row", F.lit(x).cast("long")).cast("int") for x in ends]
    rows = rows.withColumn("_at", F.array(*at, F.size("_row") + 1))
    some = [f"get(_at, {i + 1}) - get(_at, {i}) - 1" for i in range(RANGES)]
    bands = [F.expr(f"CASE WHEN {n} > 0 THEN xxhash64({i}, slice(_row, get(_at, {i}) + 1, least({BAND_HASHES}, {n}))) END") for i, n in enumerate(some)]
    return rows.withColumn("bands", F.array(*bands)).drop("_row", "_at")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """band, lid, size and leader of the rows (lid, size, bands), a row for each band that another lid has too. The leader of
    a bucket is one of its lids, in an order that changes from band to band; finding it is a sum that starts before the
    shuffle."""
    rows = rows.select(F.explode("bands").alias("band"), "lid", "size").where("band is not null")
    leaders = rows.groupBy("band").agg(F.count("*").alias("n"), F.min(F.col("lid").bitwiseXOR(F.col("band"))).alias("first")).where("n > 1")
    # one row a band: a hash table of them spares sorting the rows
    return rows.join(leaders.hint("shuffle_hash"), "band").select("band", "lid", "size", F.expr("first ^ band").alias("leader"))


def close(a: str, b: str, similarity: float) -> str:
    """What sizes of two sets must hold for the similarity."""
    return f"least({a}, {b}) >= {similarity} * greatest({a}, {b})"


def alike(a: str, b: str, similarity: float) -> str:
    """That the Jaccard similarity of two sets is `similarity` or more, in decimals, with one intersection: common / union >= s
    is the same as common * (1 + s) >= s * (sum of the sizes)."""
    return f"size(array_intersect({a}, {b})) * (1 + {similarity}) >= {similarity} * (size({a}) + size({b}))"


def may_be_alike(a: str, b: str, size_a: str, size_b: str, similarity: float) -> str:
    """What the sketches of two sets of the similarity hold for certain. A sketch has a bit for each class of hashes, set if an
    odd number of the set's are of it; where two sketches differ, the sets do, and at least as often."""
    apart = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH_LONGS))
    bound = round(similarity * 1000)
    return f"({apart}) * {1000 + bound}L <= {1000 - bound}L * ({size_a} + {size_b})"


def roots_of(met: DataFrame, sets: DataFrame, similarity: float, decide=None, sketch=None) -> DataFrame:
    """node and root of all lids linked by pairs of `similarity` or more that share a bucket, directly or through others.

    met: shared_buckets(), sets: set and size by lid; decide: what tells of two columns of sets whether they are alike, by
    default alike() of arrays; sketch: what makes of a column of sets arrays of longs for may_be_alike(), if any. First every
    set of a bucket meets the leader. Where a bucket then holds sets of several components, more of them lead, dealt by hash:
    LEADERS, then MORE times as many in each round, and each meets all sets of other components that have not led. It ends
    when no bucket has two sets left that have not met and are of different components, so that the components are those of
    all pairs of every bucket. Pairs whose sizes or sketches alone rule the similarity out are passed over. In the rounds a
    set goes once to each of its buckets, and sets are compared within the join, which puts out links only; adaptive
    execution splits a bucket that is large, and nothing numbers or sorts its sets.
    """
    decide = decide or (lambda a, b: F.expr(alike(a, b, similarity)))
    pairs = met.where("lid <> leader").select(F.col("leader").alias("a"), F.col("lid").alias("b"), F.col("size").alias("size_b")).distinct()
    a = sets.select(F.col("lid").alias("a"), F.col("set").alias("set_a"), F.col("size").alias("size_a"))
    b = sets.select(F.col("lid").alias("b"), F.col("set").alias("set_b"))
    near = pairs.join(a, "a").where(close("size_a", "size_b", similarity)).drop("size_a", "size_b")
    links = written(near.join(b, "b").where(decide("set_a", "set_b")).select("a", "b"))
    roots = written(components(links))
    drop_written(links)
    left, leaders, rich = met.where("lid <> leader").select("band", "lid", "size"), LEADERS, None
    while True:
        named = left.join(roots.withColumnRenamed("node", "lid"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))
        mixed = named.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1")
        leads = F.expr(f"pmod(xxhash64(lid, band), n) < {leaders}").alias("leads")
        named = written(named.join(mixed, "band").select("band", "lid", "size", "root", leads))
        if leaders > LEADERS:
            drop_written(left)
        if named.isEmpty():
            drop_written(named)
            if rich is not None:
                drop_written(rich)
            return roots
        if rich is None:
            some = sets.select("lid", "set").join(named.select("lid").distinct(), "lid", "left_semi")
            rich = written(some.withColumn("sketch", sketch("set") if sketch else F.array().cast("array<bigint>")))
        whole = named.join(rich, "lid")
        a = whole.where("leads").select(*(F.col(c).alias(f"{c}_a") for c in ("band", "lid", "size", "root", "set", "sketch")))
        b = whole.select("band", "leads", *(F.col(c).alias(f"{c}_b") for c in ("lid", "size", "root", "set", "sketch")))
        meet = f"band = band_a and root_a <> root_b and (not leads or lid_a < lid_b) and {close('size_a', 'size_b', similarity)}"
        if sketch:
            meet += f" and {may_be_alike('sketch_a', 'sketch_b', 'size_a', 'size_b', similarity)}"
        joined = written(a.join(b, F.expr(meet)).where(decide("set_a", "set_b")).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
        wider = written(components(joined))
        new = roots.withColumnRenamed("root", "was").join(wider.select(F.col("node").alias("was"), "root"), "was", "left").select("node", F.coalesce("root", "was").alias("root"))
        more = written(new.unionByName(wider.join(roots.select("node"), "node", "left_anti")))
        for done in (roots, wider, joined):
            drop_written(done)
        # a bucket's leaders have met all others; the rest come again
        left = written(named.where("not leads").select("band", "lid", "size"))
        drop_written(named)
        roots, leaders = more, MORE * leaders
