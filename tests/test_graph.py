import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import chains, cleaning, graph, kmers
from strandloom.plans.assemble import assemble, write
from strandloom.plans.config import Config
from strandloom.sources import reads as source

K = 21


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def genome(seed, n):
    rnd = random.Random(seed)
    return "".join(rnd.choice("ACGT") for _ in range(n))


def reads_of(spark, seqs):
    return spark.createDataFrame([(i, i // 2, i % 2, s) for i, s in enumerate(seqs)], "read_id long, pair_id long, mate int, seq string")


def graph_of(spark, seqs):
    return graph.contig_graph(kmers.kmer_counts(kmers.fragments(reads_of(spark, seqs), K), K), K).cache()


def test_chains(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 21), (21, 22), (22, 20)]
    nodes = [(x,) for x in (1, 2, 3, 4, 10, 11, 20, 21, 22, 30)]
    got = chains.chains(spark.createDataFrame(links, "node long, next long"), spark.createDataFrame(nodes, "node long")).collect()
    assert {(r.node, r["last"], r.togo, r.circular) for r in got} == {
        (1, 4, 3, False), (2, 4, 2, False), (3, 4, 1, False), (4, 4, 0, False), (10, 11, 1, False), (11, 11, 0, False), (30, 30, 0, False), (20, 22, 2, True), (21, 22, 1, True), (22, 22, 0, True)
    }


def test_a_line_and_a_circle(spark):
    g = genome(1, 1500)
    line = graph_of(spark, [g[p : p + 100] for p in range(0, 1401, 10)])
    assert [r.seq in (g[10:-10], turn(g[10:-10])) for r in line.collect()] == [True]
    circle = graph_of(spark, [(g + g)[p : p + 100] for p in range(0, 1500, 10)]).collect()
    assert len(circle) == 1 and circle[0].circular and len(circle[0].seq) == 1500 + K - 1
    double = g + g
    assert circle[0].seq[:1500] in double or turn(circle[0].seq[:1500]) in double


def test_unitigs_against_plain_python(spark):
    rnd = random.Random(7)
    k = 7
    seqs = [genome(i, 60) for i in range(4)] * 2
    counts = kmers.kmer_counts(kmers.fragments(reads_of(spark, seqs), k), k)
    got = graph.contig_graph(counts, k)
    assert graph.violations(got, k).count() == 0
    solid = {x for s in seqs for i in range(len(s) - k + 1) for x in (s[i : i + k], turn(s[i : i + k]))}
    outs = {x: [x[1:] + b for b in "ACGT" if x[1:] + b in solid] for x in solid}
    linked = {x: o[0] for x, o in outs.items() if len(o) == 1 and len(outs[turn(o[0])]) == 1 and o[0] != turn(x)}
    starts = solid - set(linked.values())
    want = set()
    for x in starts:
        path = [x]
        while path[-1] in linked:
            path.append(linked[path[-1]])
        s = path[0] + "".join(p[-1] for p in path[1:])
        want.add(min(s, turn(s)))
    inner = set()
    for r in got.where("not circular and contig_id < 4611686018427387904").collect():
        s = r.seq[(r.n1 is not None and r.ind1 < 4) : len(r.seq) - (r.n2 is not None and r.ind2 < 4)]
        inner.add(min(s, turn(s)))
    assert inner == want and rnd


def test_cleaning_takes_out_a_tip_and_a_bubble(spark):
    g = genome(2, 3000)
    other = g[:1500] + ("A" if g[1500] != "A" else "C") + g[1501:]
    seqs = [g[p : p + 100] for p in range(0, 2901, 5)] + [other[p : p + 100] for p in range(1400, 1501, 20)] + [g[700:760] + "ACGTTGCAACGTAGGCTTAACCGT"] * 3
    found = graph_of(spark, seqs)
    assert found.count() == 6 and graph.violations(found, K).count() == 0
    assert graph.tips(found, 100).count() == 1 and graph.bubbles(found).count() == 2
    cleaned = cleaning.clean(found, K, 100)
    assert graph.violations(cleaned, K).count() == 0
    assert [r.seq in g or turn(r.seq) in g for r in cleaned.collect()] == [True]


def contigs(spark, rows):
    return spark.createDataFrame([(i, n1, i1, n2, i2, "A" * n, [2] * (len(c) - 1), c, False) for i, n1, i1, n2, i2, n, c in rows], "contig_id long, n1 long, ind1 int, n2 long, ind2 int, seq string, distances array<int>, coverages array<int>, circular boolean")


def test_graph_predicates(spark):
    c = contigs(spark, [(1, 7, 4, None, None, 300, [9]), (2, 7, 0, 8, 0, 100, [2]), (3, 7, 1, 8, 1, 90, [8]), (4, 8, 4, None, None, 80, [5]), (5, 9, 0, 9, 1, 50, [1]), (6, None, None, None, None, 400, [3]), (7, 10, 4, 11, 4, 60, [4]), (8, 10, 0, None, None, 200, [4])])
    assert {tuple(r) for r in graph.bubbles(c).select("node", "far", "low", "high").collect()} == {(7, 8, 2, 3), (8, 7, 2, 3), (9, 9, 5, 5)}
    assert {(r.contig_id, r.ratio1) for r in graph.chimeras(c).collect()} == {(2, 4.0)}
    assert {r.contig_id for r in graph.tips(c, 100).collect()} == {4, 5}
    assert {r.node for r in graph.collapsible(c).collect()} == {10}
    assert {r.node for r in graph.inverted_repeats(c).collect()} == {9}
    assert {r.node for r in graph.degenerate(c).collect()} == {9, 11}
    assert graph.longest(c).first().contig_id == 1 and graph.isolated(c).first().contig_id == 6


def test_whole_run_writes_and_reads(spark, tmp_path):
    g = genome(3, 1200)
    r = reads_of(spark, [g[p : p + 100] for p in range(0, 1101, 10)])
    c = Config(k=K, mercy=True)
    a = assemble(r, c)
    write(a, c, f"{tmp_path}/out")
    fasta = [x.value for x in spark.read.text(f"{tmp_path}/out.fasta").collect()]
    assert any(x in g or turn(x) in g for x in fasta if not x.startswith(">")) and ">Contig1" in fasta
    again = assemble(r, c, spark.read.parquet(f"{tmp_path}/out.solid"))
    assert [x.seq for x in again.contigs.collect()] == [x.seq for x in a.contigs.collect()]
    kept = source.read_junctions(spark, f"{tmp_path}/out.junctions")
    assert kept.count() == a.junctions.count()
    with pytest.raises(ValueError):
        Config(k=32)
    assert a.contigs.agg(F.max(F.length("seq"))).first()[0] >= 1150


def test_a_shared_repeat_is_copied(spark):
    from strandloom.operators import disentangle

    parts = [genome(i, 400) for i in range(20, 24)]
    repeat = genome(30, 45)
    one, two = parts[0] + repeat + parts[1], parts[2] + repeat + parts[3]
    seqs = [g[p : p + 100] for g in (one, two) for p in range(0, len(g) - 99, 4)]
    a = assemble(reads_of(spark, seqs), Config(k=K, clean=False))
    assert disentangle.crossings(a.contigs).count() == 1
    done, n = disentangle.parallel_paths(a.contigs, a.short_pairs, K)
    assert n == 1 and graph.violations(done, K).count() == 0
    found = [r.seq for r in done.collect()]
    assert len(found) == 2 and all(any(s in g or turn(s) in g for g in (one, two)) and len(s) > 800 for s in found)
    assert disentangle.parallel_paths(a.contigs, a.short_pairs.limit(0), K)[1] == 0


def test_a_loop_is_strung_out(spark):
    from strandloom.operators import disentangle

    repeat, inner = genome(31, 45), genome(33, 90)
    g = genome(34, 200) + repeat + inner + repeat + genome(35, 200)
    a = assemble(reads_of(spark, [g[p : p + 100] for p in range(0, len(g) - 99, 2)]), Config(k=K, clean=False))
    assert disentangle.loops(a.contigs).count() == 1
    done, n = disentangle.loop_paths(a.contigs, a.short_pairs, K, 100)
    assert n == 1 and graph.violations(done, K).count() == 0
    longest = max((r.seq for r in done.collect()), key=len)
    assert (longest in g or turn(longest) in g) and len(longest) > len(g) - 60
    assert disentangle.loop_paths(a.contigs, a.short_pairs.limit(0), K, 100)[1] == 0  # longer than a read, and no pair tells
    assert disentangle.loop_paths(a.contigs, a.short_pairs.limit(0), K, 200)[1] == 0  # it holds junctions, which no pair speaks for
    ends, d = F.array(F.element_at("coverages", 1), F.element_at("coverages", -1)), F.array(F.aggregate("distances", F.lit(0), lambda s, x: s + x))
    bare = a.contigs.withColumns({"coverages": ends, "distances": d})
    assert disentangle.loop_paths(bare, a.short_pairs.limit(0), K, 200)[1] == 1


def test_long_bulges(spark):
    c = contigs(spark, [(1, 7, 4, None, None, 300, [9]), (2, 7, 0, 9, 0, 120, [9, 9, 9]), (3, 7, 1, 8, 4, 60, [2, 2]), (4, 8, 0, 9, 1, 60, [2, 2]), (5, 8, 1, None, None, 300, [3]), (6, 9, 4, None, None, 300, [9])])
    assert {(r.node, r.gone, tuple(r.path), r.low_cov) for r in cleaning.long_bulges(c, K).collect()} == {(7, 2, (3, 4), 2.0), (9, 2, (4, 3), 2.0)}
    assert cleaning.long_bulges(c.where("contig_id <> 4"), K).count() == 0


def test_coverage_decides_a_crossing(spark):
    from strandloom.operators import disentangle

    low, high = [10, 11, 9, 10, 11, 10, 9, 10], [40, 41, 39, 40, 41, 40, 39, 40]
    rows = [(1, 7, 4, 8, 4, 60, [50] * 4), (2, 7, 0, None, None, 200, low), (3, 7, 1, None, None, 200, high), (4, 8, 0, None, None, 200, high), (5, 8, 1, None, None, 200, low)]
    c = contigs(spark, rows)
    crossed = disentangle.crossings(c)
    assert [(r.middle, r.straight) for r in disentangle.by_coverage(crossed, c).collect()] == [(1, False)]
    none = spark.createDataFrame([], "k1 long, k2 long")
    assert [(r.middle, r.straight) for r in disentangle.decided(crossed, c, none, K, 500).collect()] == [(1, False)]
    new, n = disentangle.parallel_paths(c, none, K)
    assert n == 1 and {len(r.seq) for r in new.collect()} == {200 + 60 + 200 - 2 * K}


def test_opposite_index(spark):
    from strandloom.operators import junctions

    df = spark.createDataFrame([(2, [0, 3, 0, 1]), (4, [0, 3, 0, 1]), (4, [0, 0, 0, 0])], "index int, cov array<int>")
    assert [r[0] for r in df.select(junctions.opposite_index("index", "cov")).collect()] == [4, 1, None]
