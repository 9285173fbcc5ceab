"""The contig graph: unitigs between branching k-mers.

A node is an oriented solid k-mer with two extensions or more; its contigs have index 0 to 3 (the base ahead) or 4 (back). A
contig holds the k-mer of the node at each of its ends; n1 or n2 is null where it just ends (a sink).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..plans.scratch import written
from . import compaction
from .chains import chains

BACK = 4
ENDS = "n1 long, ind1 int, n2 long, ind2 int"


def contig_graph(counts: DataFrame, k: int, least: int = 2) -> DataFrame:
    """contig_id, n1, ind1, n2, ind2, seq, distances, coverages and circular of the graph of the k-mers (canon, cnt) with a count of
    `least` or more. contig_id is the smaller of the encoded first k-mers of both strands. coverages are the counts, at most
    255, of the k-mers along the contig; distances lie between them, in half bases.

    Two k-mers are joined if each is the other's only neighbour on that side. Chains are made part by part (compaction.pieces()); those that go on in
    other parts are ranked by doubling, and come in both directions, of which one is kept.
    """
    found = written(compaction.pieces(counts.where(F.col("cnt") >= least).select("canon", "cnt"), k))
    pieces = found.where(F.col("kind") == compaction.OPEN)
    links = pieces.where("next is not null").select(F.col("id").alias("node"), "next")
    ranks = written(chains(links, pieces.select(F.col("id").alias("node"))))
    joined = ranks.join(pieces.withColumnRenamed("last", "last_kmer"), F.col("node") == F.col("id"))
    step = F.struct((-F.col("togo")).alias("at"), "first", F.col("last_kmer").alias("last"), "n1", "ind1", "base1", "n2", "ind2", "base2", "tail", "cov")
    whole = joined.groupBy("last", "circular").agg(F.sort_array(F.collect_list(step)).alias("s"))
    # a piece begins with the k-mer that the one before it ends with
    begin, end = F.col("s")[0], F.element_at("s", -1)
    bases = F.array_join(F.transform("s", lambda p: p["tail"]), "")
    cov = F.flatten(F.transform("s", lambda p, i: F.when(i == 0, p["cov"]).otherwise(F.slice(p["cov"], 2, F.size(p["cov"])))))
    ends = ["n1", "ind1", "base1"], ["n2", "ind2", "base2"]
    whole = whole.select(begin["first"].alias("first"), end["last"].alias("last"), *(begin[c].alias(c) for c in ends[0]), *(end[c].alias(c) for c in ends[1]), bases.alias("tail"), cov.alias("cov"), "circular")
    own = found.where(F.col("kind").isin(compaction.CLOSED, compaction.CIRCLE)).select("first", "last", *ends[0], *ends[1], "tail", "cov", (F.col("kind") == compaction.CIRCLE).alias("circular"))
    lines = own.unionByName(whole.where("not circular").where(F.col("first") <= dna.revcomp("last", k)))
    lines = lines.unionByName(_circles(whole.where("circular"), k))
    # an end that comes into a node from ahead also holds that node's k-mer, one base more
    seq = F.concat(F.coalesce(dna.revcomp_seq("base1"), F.lit("")), dna.decode("first", k), "tail", F.coalesce("base2", F.lit("")))
    contigs = lines.select(F.col("first").alias("contig_id"), "n1", "ind1", "n2", "ind2", seq.alias("seq"), F.col("cov").alias("coverages"), "circular")
    # apart from unitigs' ids, which are below 2^62
    edge_id = F.lit(1 << 62).bitwiseOR(F.xxhash64("n1", "ind1").bitwiseAND(F.lit((1 << 62) - 1)))
    edges = found.where(F.col("kind") == compaction.EDGE).select(edge_id.alias("contig_id"), "n1", "ind1", "n2", "ind2", F.concat(dna.decode("first", k), "base1").alias("seq"), F.col("cov").alias("coverages"), F.lit(False).alias("circular"))
    contigs = contigs.unionByName(edges)
    return contigs.withColumn("distances", F.transform(F.slice("coverages", 2, F.size("coverages")), lambda c: F.lit(2))).select("contig_id", "n1", "ind1", "n2", "ind2", "seq", F.when(F.coalesce(F.col("ind1") < BACK, F.lit(False)), 3).otherwise(1).alias("lead"), "distances", "coverages", "circular")


def _circles(whole: DataFrame, k: int) -> DataFrame:
    """Circles of several pieces, from their smallest k-mer on, each in the direction that has the smaller one. What comes in ends with the k-mer that it begins with."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                codes = np.array([r["first"] >> 2 * i & 3 for i in range(k - 1, -1, -1)] + ["ACTG".index(b) for b in r["tail"]], np.uint8)
                n = len(r["cov"]) - 1
                here, back = (_kmers(codes, np.arange(n), k, t) for t in (False, True))
                if here.min() <= back.min():
                    at = int(here.argmin())
                    turn = np.concatenate([codes[at:n], codes[:at]])
                    codes = np.resize(turn, n + k - 1)
                    r |= {"first": int(here[at]), "last": int(here[at - 1]), "tail": "".join("ACTG"[c] for c in codes[k:]), "cov": r["cov"][at:n] + r["cov"][:at]}
                    yield pa.RecordBatch.from_pylist([r], schema=batch.schema)

    return whole.mapInArrow(run, whole.schema)


def incidence(contigs: DataFrame) -> DataFrame:
    """node, ind, contig_id, side, far, far_ind, length and cov (mean) of every contig at every node it touches."""
    cov = F.expr("aggregate(coverages, 0D, (s, c) -> s + c) / size(coverages)")
    end = lambda n, i, s, f, g: F.struct(F.col(n).alias("node"), F.col(i).alias("ind"), F.lit(s).alias("side"), F.col(f).alias("far"), F.col(g).alias("far_ind"))
    rows = contigs.select("contig_id", F.length("seq").alias("length"), cov.alias("cov"), F.explode(F.array(end("n1", "ind1", 1, "n2", "ind2"), end("n2", "ind2", 2, "n1", "ind1"))).alias("e"))
    return rows.select("e.*", "contig_id", "length", "cov").where("node is not null").select("node", "ind", "contig_id", "side", "far", "far_ind", "length", "cov")


def with_outs(at: DataFrame) -> DataFrame:
    """Incidence with outs, the number of contigs ahead of the node, and has_back."""
    node = Window.partitionBy("node")
    return at.withColumns({"outs": F.count_if(F.col("ind") < BACK).over(node), "has_back": F.count_if(F.col("ind") == BACK).over(node) > 0})


def by_node(contigs: DataFrame) -> DataFrame:
    """node, outs, backs, loops (a contig that comes back to the node), and what is ahead and back (contig_id and side; of several the largest),
    with ends, all of them. One aggregate, of five rows a node."""
    end, own = F.struct("contig_id", "side"), F.col("ind") == BACK
    return incidence(contigs).groupBy("node").agg(
        F.count_if(~own).alias("outs"), F.count_if(own).alias("backs"), F.coalesce(F.bool_or(F.col("far") == F.col("node")), F.lit(False)).alias("loops"),
        F.max(F.when(~own, end)).alias("front"), F.max(F.when(own, end)).alias("back"), F.collect_list(end).alias("ends"),
    )


def tips(contigs: DataFrame, read_length: int) -> DataFrame:
    """contig_id of the contigs that a pass of tip removal takes out: shorter than a read, and at the far end nothing, or the node itself.
    Ahead of a node they go in the order of their base while another remains; back they all go."""
    at = with_outs(incidence(contigs)).withColumn("tip", (F.col("length") < read_length) & (F.col("far").isNull() | (F.col("far") == F.col("node"))))
    ahead = at.where(F.col("tip") & (F.col("ind") < BACK)).withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("ind")))
    return ahead.where("n < outs").select("contig_id").unionByName(at.where(F.col("tip") & (F.col("ind") == BACK)).select("contig_id")).distinct()


def bubbles(contigs: DataFrame) -> DataFrame:
    """node, far, and the two contigs (the one of lower coverage first) of nodes whose two ways ahead meet in the same node."""
    at = with_outs(incidence(contigs)).where((F.col("ind") < BACK) & (F.col("outs") == 2))
    both = at.groupBy("node").agg(F.count("far").alias("n"), F.min("far").alias("far"), F.max("far").alias("far2"), F.sort_array(F.collect_list(F.struct("cov", "ind", "contig_id"))).alias("c"))
    return both.where("n = 2 and far = far2").select("node", "far", F.expr("c[0].contig_id").alias("low"), F.expr("c[1].contig_id").alias("high"), F.expr("c[0].cov").alias("low_cov"), F.expr("c[1].cov").alias("high_cov"))


def chimeras(contigs: DataFrame, length: int = 150, ratio: float = 3.0) -> DataFrame:
    """contig_id, node and far, ratio1 and ratio2 of the short contigs that have the lowest coverage ahead of both nodes they join, by a
    factor of `ratio` at the first: wrong joins. The first of equals is the lowest, the last of them the highest."""
    at = with_outs(incidence(contigs)).where((F.col("ind") < BACK) & (F.col("outs") > 1))
    ends = at.groupBy("node").agg(
        F.min_by(F.struct("contig_id", "ind", "far", "far_ind", "length", "cov"), F.struct("cov", "ind")).alias("p"), F.max("cov").alias("top")
    )
    ends = ends.select("node", "p.*", (F.col("top") / F.col("p.cov")).alias("ratio"))
    far = ends.select(F.col("node").alias("far"), F.col("contig_id").alias("far_p"), F.col("ratio").alias("ratio2"))
    return ends.where("far is not null and far <> node and far_ind < 4").join(far, "far").where(f"contig_id = far_p and length < {length} and ratio >= {ratio}").select("contig_id", "node", "far", F.col("ratio").alias("ratio1"), "ratio2")


def interior(contigs: DataFrame, k: int) -> DataFrame:
    """contig_id, ord (from 0), distance (half bases from the contig's first k-mer: the sum of the distances so far), kmer and cov of every
    place of a contig that has a coverage."""

    def rows(x: dict) -> dict:
        ok = (x["at"] >> 1) + k <= x["length"]
        base = (x["base"] + (x["at"] >> 1))[ok]
        return {"contig_id": x["contig_id"][ok], "ord": x["ord"][ok], "distance": x["at"][ok], "kmer": _kmers(x["codes"], base, k, False), "cov": x["cov"][ok]}

    return _places(contigs, [], rows, {"ord": "int", "distance": "long", "kmer": "long", "cov": "int"})


def junction_results(contigs: DataFrame, k: int, ends: bool = False) -> DataFrame:
    """contig_id, ord, kmer (the real extension of a junction on the contig: the k-mer one base on in the direction it faces), cov, and from1
    and from2, the half bases to it from the junctions at both ends. The k-mers at the ends of the contig have none outwards. With ends, n1, ind1,
    n2 and ind2 of the contig too, where -1 stands for an index at no node."""

    def rows(x: dict) -> dict:
        at = x["at"] + x["lead"]
        real, last = np.where(at % 2 == 1, at + 2, at - 2), 2 * (x["length"] - k) + 1
        ok = (real >= 0) & (real <= last)
        real, last = real[ok], last[ok]
        return {
            "contig_id": x["contig_id"][ok], "ord": x["ord"][ok], "kmer": _kmers(x["codes"], x["base"][ok] + (real >> 1), k, real % 2 == 0), "cov": x["cov"][ok],
            "from1": real - x["start1"][ok], "from2": last - real - x["start2"][ok],
        } | {c: x[c][ok] for c in nodes}

    start = lambda c: F.coalesce((F.col(c) < BACK).cast("long"), F.lit(0)).alias(f"start{c[-1]}")
    more = [F.col("lead").cast("long").alias("lead"), start("ind1"), start("ind2")]
    nodes = {"n1": "long", "ind1": "int", "n2": "long", "ind2": "int"} if ends else {}
    for i in (1, 2) if ends else ():
        more += [F.coalesce(F.col(f"n{i}").cast("long"), F.lit(0)).alias(f"n{i}"), F.coalesce(F.when(F.col(f"n{i}").isNotNull(), F.col(f"ind{i}").cast("long")), F.lit(-1)).alias(f"ind{i}")]
    return _places(contigs, more, rows, {"ord": "int", "kmer": "long", "cov": "int", "from1": "long", "from2": "long"} | nodes)


_CODE = np.zeros(256, np.uint8)
_CODE[list(b"ACTG")] = range(4)
#: Bases and places of contigs that are looked at together (a longer contig is looked at by itself), and rows put out together.
BLOCK_BASES, BLOCK_ROWS = 1 << 20, 20_000


def _kmers(codes: np.ndarray, at: np.ndarray, k: int, turned) -> np.ndarray:
    """The k-mers from these places on; where turned, their reverse complements."""
    here, back = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for i in range(k):
        c = codes[at + i].astype(np.int64)
        here, back = here << 2 | c, back | (c ^ 2) << 2 * i
    return np.where(turned, back, here)


def _list(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place and number of each list's values, and all values."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return np.cumsum(size) - size, size, np.asarray(column.flatten()).astype(np.int64)


def _places(contigs: DataFrame, more: list, rows, kinds: dict[str, str]) -> DataFrame:
    """What rows() makes of all places of many contigs: of each place contig_id, ord, at (half bases from the contig's first k-mer), cov, length of
    the contig, base (where it begins among the codes of all) and the columns more, longs. Running sums along a contig are linear here; as
    array expressions they would take its square. No contig is looked at by itself but long ones."""
    own = ["contig_id", "seq", "distances", "coverages"]

    def blocks(batch: pa.RecordBatch):
        size = np.asarray(pc.binary_length(batch.column(1))).astype(np.int64) + np.asarray(pc.list_value_length(batch.column(3))).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(ends):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_BASES, "right")))
            yield batch.slice(at, to - at)
            at = to

    def run(batches):
        for batch in batches:
            for block in blocks(batch):
                length = np.asarray(pc.binary_length(block.column(1))).astype(np.int64)
                (first, steps, d), (cov_at, covs, cov) = _list(block.column(2)), _list(block.column(3))
                n = np.where(length > 0, np.minimum(steps + 1, covs), 0)
                which = np.repeat(np.arange(len(n)), n)
                no = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                along = np.concatenate([[0], np.cumsum(d)])
                x = {"contig_id": np.asarray(block.column(0))[which], "ord": no, "at": along[first[which] + no] - along[first[which]], "cov": cov[cov_at[which] + no]}
                x |= {"length": length[which], "base": (np.cumsum(length) - length)[which], "codes": _CODE[np.frombuffer("".join(block.column(1).to_pylist()).encode(), np.uint8)]}
                found = rows(x | {c: np.asarray(block.column(i))[which] for i, c in enumerate(block.schema.names) if i >= len(own)})
                out = pa.RecordBatch.from_pydict({c: pa.array(found[c].astype(np.int32 if t == "int" else np.int64)) for c, t in ({"contig_id": "long"} | kinds).items()})
                yield from (out.slice(i, BLOCK_ROWS) for i in range(0, out.num_rows, BLOCK_ROWS))

    longs = [F.coalesce(F.col(c).cast("array<long>"), F.array().cast("array<long>")).alias(c) for c in own[2:]]
    whole = contigs.select(F.col("contig_id").cast("long").alias("contig_id"), F.coalesce("seq", F.lit("")).alias("seq"), *longs, *more)
    return whole.mapInArrow(run, ", ".join(["contig_id long", *(f"{c} {t}" for c, t in kinds.items())]))


def collapsible(contigs: DataFrame) -> DataFrame:
    """node, back and front: nodes with one contig on each side, neither of which comes back to its own start."""
    at = with_outs(incidence(contigs)).where("outs = 1 and has_back")
    loops = "max(case when far = node then 1 else 0 end)"
    n = at.groupBy("node").agg(F.max(F.when(F.col("ind") == BACK, F.col("contig_id"))).alias("back"), F.max(F.when(F.col("ind") < BACK, F.col("contig_id"))).alias("front"), F.expr(loops).alias("loops"))
    return n.where("loops = 0").select("node", "back", "front")


def inverted_repeats(contigs: DataFrame) -> DataFrame:
    """node and contig_id of contigs that leave a node by two ways ahead of it."""
    ahead = incidence(contigs).where(F.col("ind") < BACK)
    return ahead.groupBy("node", "contig_id").count().where("count > 1").select("node", "contig_id")


def degenerate(contigs: DataFrame) -> DataFrame:
    """node of those without a contig ahead, or without one back."""
    return with_outs(incidence(contigs)).where("outs = 0 or not has_back").select("node").distinct()


def isolated(contigs: DataFrame) -> DataFrame:
    return contigs.where("n1 is null and n2 is null")


def longest(contigs: DataFrame) -> DataFrame:
    """The longest contig that touches a node; of equals the smallest id."""
    return contigs.where("n1 is not null or n2 is not null").orderBy(F.desc(F.length("seq")), "contig_id").limit(1)


def violations(contigs: DataFrame, k: int) -> DataFrame:
    """contig_id and problem: what a valid graph has none of."""
    twice = incidence(contigs).groupBy("node", "ind").agg(F.count_distinct("contig_id").alias("n"), F.min("contig_id").alias("contig_id")).where("n > 1")
    end1 = F.when(F.col("ind1") == BACK, dna.encode(dna.revcomp_seq(F.substring("seq", 1, k)))).otherwise(dna.encode(F.substring("seq", 1, k)))
    tail_ = F.expr(f"right(seq, {k})")
    end2 = F.when(F.col("ind2") == BACK, dna.encode(tail_)).otherwise(dna.encode(dna.revcomp_seq(tail_)))
    return (
        twice.select("contig_id", F.lit("two contigs at one index").alias("problem"))
        .unionByName(contigs.where(F.length("seq") < k).select("contig_id", F.lit("shorter than k").alias("problem")))
        .unionByName(contigs.where(F.col("n1").isNotNull() & (F.col("n1") != end1)).select("contig_id", F.lit("first end is not its node").alias("problem")))
        .unionByName(contigs.where(F.col("n2").isNotNull() & (F.col("n2") != end2)).select("contig_id", F.lit("second end is not its node").alias("problem")))
        .unionByName(contigs.where("size(distances) <> size(coverages) - 1").select("contig_id", F.lit("distances do not fit coverages").alias("problem")))
    )
