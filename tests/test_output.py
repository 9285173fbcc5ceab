"""Contigs as they are put out."""

from strandloom.plans import catalogue
from strandloom.sources import sinks

SF = "/root/testdata/sf0.001"


def test_contigs_are_made_once_for_output(spark):
    """What is put out is read from one table of the contigs' ends and texts: neither orders nor their lines are read for each use."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("contig_output", "fasta_records"):
        assert "lineitem" not in plan(catalogue.QUERIES[name](spark, SF)), name
    assert plan(catalogue.orders_as_contigs(spark, SF)).count("Window [row_number") == 1


def test_bubbles_put_out_with_a_contig_that_leaves_by_both_ways(spark):
    seq = ["A" * 30 + "C", "A" * 29 + "GT", "A" * 28 + "CTT", "ACGT" * 8]
    rows = [(1, 7, 4, None, None, seq[0]), (2, 7, 0, 7, 1, seq[1]), (3, None, None, 8, 2, seq[2]), (4, None, None, None, None, seq[3]), (5, None, None, None, None, "ACG")]
    contigs = spark.createDataFrame([(*r, [1], [], False) for r in rows], f"contig_id long, {'n1 long, ind1 int, n2 long, ind2 int'}, seq string, coverages array<int>, distances array<int>, circular boolean")
    got = sorted((r.origin, r.seq) for r in sinks.contig_records(contigs, 20, 21).collect())
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    canon = lambda s: min(s, turn(s))
    # its back contig ends at the node by side 1, so it is turned; each end of the other contig is met by each way
    paths = [canon(turn(seq[0]) + x[21:]) for x in (seq[1], turn(seq[1]))] * 2
    assert got == sorted([("bubble", p) for p in paths] + [("unitig", canon(seq[2])), ("isolated", canon(seq[3]))])


def test_copies_are_numbered_as_one(spark, monkeypatch):
    monkeypatch.setattr(sinks, "COPIES", 3)
    rows = [("unitig", "AC")] * 8 + [("bubble", "GT")] * 3 + [("bubble", "AA"), ("unitig", "AA")]
    got = sinks.fasta_lines(spark.createDataFrame(rows, "origin string, seq string").repartition(5))
    assert sorted(r.value for r in got.collect()) == sorted(f">Contig{i + 1}\n{s}" for i, (_, s) in enumerate(sorted(rows)))
