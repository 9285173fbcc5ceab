import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import junctions, kmers, places, stretches


def some(seed, n=60, most=200):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("ACGT" if rnd.random() < 0.7 else "A") for _ in range(rnd.randrange(most))) for _ in range(n)] + ["A" * 90, "ACGT" * 30]


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def input_of(spark, k, seed):
    """Fragments, and as solid ones two in three of their k-mers, both strands as text."""
    rnd = random.Random(seed)
    seqs = [x for x in some(seed) if len(x) >= k]
    seqs += [x[: len(x) // 2] + rnd.choice("ACGT") + x[len(x) // 2 :] for x in seqs[:30]]
    solid = {min(s[i : i + k], turn(s[i : i + k])) for s in seqs for i in range(len(s) - k + 1)}
    solid = {x for x in sorted(solid) if rnd.random() < 0.97}
    frags = spark.createDataFrame([(i // 2, i % 2, s) for i, s in enumerate(seqs)], "read_id long, frag_no int, seq string")
    table = spark.createDataFrame([(x,) for x in solid], "s string").select(dna.canon(dna.encode("s"), k).alias("canon"))
    return seqs, solid | {turn(x) for x in solid}, frags, table


def runs(s, solid, k):
    out, at = [], None
    for i in range(len(s) - k + 2):
        if i <= len(s) - k and s[i : i + k] in solid:
            at = i if at is None else at
        elif at is not None:
            out += [s[at : i + k - 1]] if i - at >= k else []
            at = None
    return out


@pytest.mark.parametrize("k", [4, 5, 12, 31])
def test_valid_runs_against_plain_python(spark, k):
    seqs, solid, frags, table = input_of(spark, k, k)
    want = sorted((i // 2, i % 2, no, r) for i, s in enumerate(seqs) for no, r in enumerate(runs(s, solid, k)))
    assert sorted(map(tuple, kmers.valid_fragments(frags, table, k).collect())) == want


def test_long_fragments_are_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(places, "BLOCK", 128)
    monkeypatch.setattr(stretches, "PIECE", 50)
    k = 7
    seqs, solid, frags, table = input_of(spark, k, 3)
    want = sorted((i // 2, i % 2, no, r) for i, s in enumerate(seqs) for no, r in enumerate(runs(s, solid, k)))
    assert sorted(map(tuple, kmers.valid_fragments(frags, table, k).collect())) == want


@pytest.mark.parametrize("k,j", [(4, 1), (5, 0), (5, 1), (9, 2)])
def test_extensions_and_paths_against_plain_python(spark, k, j):
    _, solid, _, table = input_of(spark, k, k + j)
    alive = solid
    for _ in range(j):
        alive = {x for x in solid if any(x[1:] + b in alive for b in "ACGT")}
    text = dna.decode("kmer", k).alias("s")
    assert sorted(r.s for r in kmers.leading_on(table, k, j).select(text).collect()) == sorted(alive)
    assert sorted(r.s for r in kmers.jchecked(kmers.oriented(table, k), k, j).select(text).collect()) == sorted(alive)
    want = sorted((x, sum(1 << i for i, b in enumerate(dna.BASES) if x[1:] + b in alive)) for x in solid)
    assert sorted((r.s, r.mask) for r in kmers.checked_extensions(table, k, j).select(text, "mask").collect()) == want


@pytest.mark.parametrize("k,j", [(4, 1), (5, 1), (9, 2), (12, 0)])
def test_branching_sites_are_those_of_junction_keys(spark, k, j):
    _, _, frags, table = input_of(spark, k, k + j)
    valid = kmers.valid_fragments(frags, table, k).cache()
    sites = junctions.sites(valid, k, j)
    want = junctions.junction_sites(sites, junctions.junction_keys(sites, kmers.oriented(table, k), k, j))
    got = junctions.branching_sites(valid, table, k, j)
    assert got.columns == ["read_id", "frag_no", "run_no", "tpos", "to_end", "kmer", "ext"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) != []


def test_no_row_a_place_is_shuffled(spark):
    _, _, frags, table = input_of(spark, 9, 1)
    plan = kmers.valid_fragments(frags, table, 9)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    assert "pos" not in plan.replace("posexplode", "")


def test_a_set_without_any_kmer(spark):
    _, _, frags, table = input_of(spark, 9, 1)
    assert kmers.valid_fragments(frags, table.limit(0), 9).count() == 0
    assert kmers.leading_on(table.where(F.lit(False)), 9, 1).count() == 0


def test_own_valid_fragments_are_those_of_counted_kmers(spark):
    k, extra = 7, 3
    _, _, frags, _ = input_of(spark, k, 5)
    reads = frags.groupBy("read_id").agg(F.array_join(F.sort_array(F.collect_list("seq")), "N").alias("seq"))
    solid = kmers.solid(kmers.kmer_counts(kmers.fragments(reads, k), k))
    want = kmers.valid_fragments(kmers.fragments(reads, k, extra), solid, k)
    assert sorted(map(tuple, kmers.own_valid_fragments(reads, k, extra).collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("k", [4, 9])
def test_branching_deals_all_kmers_out_once(spark, monkeypatch, k):
    """With the k-mers that plain Python finds to have two checked extensions."""
    _, solid, _, table = input_of(spark, k, k + 1)
    alive = {x for x in solid if any(x[1:] + b in solid for b in "ACGT")}
    calls, masks = [], places.masks
    monkeypatch.setattr(places, "masks", lambda *a, **b: (calls.append(a), masks(*a, **b))[1])
    got = sorted(r.s for r in junctions.branching(table, k, 1).select(dna.decode("kmer", k).alias("s")).collect())
    assert got == sorted(x for x in solid if sum(x[1:] + b in alive for b in "ACGT") > 1) != []
    assert len(calls) == 1


@pytest.mark.parametrize("k", [4, 12, 31])
def test_mercy_kmers_against_plain_python(spark, k):
    """Fragments that overlap, with letters changed in some, so that gaps between strong k-mers are there; no row a place."""
    rnd = random.Random(k)
    whole = "".join(rnd.choice("ACGT") for _ in range(400))
    seqs = [whole[i : i + 120] for i in range(0, 280, 20)] + ["A" * (k + 3), whole[:k], "ACG", whole[50:200] + turn(whole[60:190])]
    seqs = [x[: len(x) // 2] + rnd.choice("ACGT") + x[len(x) // 2 + 1 :] if i % 3 else x for i, x in enumerate(seqs)]
    once = "".join(rnd.choice("ACGT") for _ in range(150))
    seqs += [once, once[:60], turn(once[95:])]
    count = {}
    for s in seqs:
        for i in range(len(s) - k + 1):
            x = min(s[i : i + k], turn(s[i : i + k]), key=lambda y: ["ACTG".index(c) for c in y])
            count[x] = count.get(x, 0) + 1
    n_of = lambda x: count.get(x, 0) or count.get(turn(x), 0)
    single = lambda x: sum(n_of(x[1:] + b) > 0 for b in "ACGT") == 1
    want = set()
    for s in seqs:
        own = [s[i : i + k] for i in range(len(s) - k + 1)]
        on = [i for i, x in enumerate(own) if n_of(x) >= 2]
        for i, x in enumerate(own):
            if n_of(x) < 2 and on and on[0] < i < on[-1]:
                left, right = max(y for y in on if y < i), min(y for y in on if y > i)
                if single(own[left]) and single(turn(own[right])):
                    want.add(x if x in count else turn(x))
    frags = spark.createDataFrame([(i, 0, s) for i, s in enumerate(seqs)], "read_id long, frag_no int, seq string")
    found = kmers.mercy_kmers(frags, kmers.kmer_counts(frags, k), k)
    got = sorted(r.s for r in found.select(dna.decode("canon", k).alias("s")).collect())
    assert got == sorted(want) and (k == 4 or want)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_one_pass_hands_its_solid_kmers_on(spark, monkeypatch):
    """Branching k-mers come from the set that the pass over the reads has counted: reads are neither cut nor dealt out a second time."""
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    texts = [genome[i : i + 60] for i in range(0, 340, 7)] + [genome[100:130] + "ACCA" + genome[134:160]] * 2 + ["NNACGT", "", "ACGTN" + genome[5:40]]
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string")
    want = sorted(r.canon for r in kmers.solid(kmers.kmer_counts(kmers.fragments(reads, 11), 11)).collect())
    dealt, cut = [], stretches.dealt
    monkeypatch.setattr(stretches, "dealt", lambda *a: dealt.append(a) or cut(*a))
    valid, keys = kmers.valid_and_solid(reads, 11, 3)
    assert sorted(r.canon for r in places.unpacked_set(keys).collect()) == want != []
    assert sorted(map(tuple, valid.collect())) == sorted(map(tuple, kmers.own_valid_fragments(reads, 11, 3).collect()))
    for j in (1, 2):
        packed, rows = (junctions.branching(x, 11, j).collect() for x in (keys, places.unpacked_set(keys)))
        assert sorted(r.kmer for r in packed) == sorted(r.kmer for r in rows) and (j > 1 or rows)
    assert not dealt


def test_only_ends_of_gaps_are_looked_up_for_mercy(spark, monkeypatch):
    """Of the k-mers with one continuation those beside a gap are sent to the fragments, not all."""
    rng = random.Random(8)
    genome = "".join(rng.choice("ACGT") for _ in range(2000))
    texts = [genome[:1200]] * 2 + [genome[900:]] * 2 + [genome[300:500] + "ACGT"[("ACGT".index(genome[500]) + 1) % 4] + genome[501:700]]
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string")
    frags = kmers.fragments(reads, 21)
    counts = places.written(kmers.kmer_counts(frags, 21))
    sent, own = [], places._set
    monkeypatch.setattr(places, "_set", lambda x, *a: sent.append(x.count()) or own(x, *a))
    got = kmers.mercy_kmers(frags, counts, 21).collect()
    assert sent == [0] and got == []  # both ends have two continuations
    weak = genome[1190:1200] + "".join(rng.choice("ACGT") for _ in range(40)) + genome[1500:1600]
    reads = spark.createDataFrame(list(enumerate([*texts[:2], genome[1500:], genome[1500:], genome[1100:1200] + weak[10:]])), "read_id long, seq string")
    frags = kmers.fragments(reads, 21)
    counts = places.written(kmers.kmer_counts(frags, 21))
    sent.clear()
    got = {dna_text(r.canon) for r in kmers.mercy_kmers(frags, counts, 21).collect()}
    line = genome[1100:1200] + weak[10:]
    want = {min(line[i : i + 21], turn(line[i : i + 21]), key=lambda s: ["ACTG".index(c) for c in s]) for i in range(80, 140)}
    assert sent == [2] and got == want


def dna_text(x, k=21):
    return "".join("ACTG"[x >> 2 * i & 3] for i in range(k - 1, -1, -1))
