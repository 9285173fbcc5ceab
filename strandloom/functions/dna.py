"""Nucleotide and k-mer functions as column expressions.

A base has two bits, A 0, C 1, T 2, G 3, so that the complement is the code with its upper bit flipped. A k-mer (k up to 31)
is a long, its first base in the highest bits; it stays below 2^62, so signed order is the order of the codes.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BASES = "ACTG"
BLOCK = 16  # bases of a packed block
_PAIRS = {2: 0x3333333333333333, 4: 0x0F0F0F0F0F0F0F0F, 8: 0x00FF00FF00FF00FF, 16: 0x0000FFFF0000FFFF}


def check_k(k: int) -> int:
    if not (1 <= k <= 31):
        raise ValueError(f"k must be 1 to 31, not {k}")
    return k


def mask(k: int) -> int:
    return (1 << 2 * k) - 1


def code(base) -> Column:
    """Code of a base; only upper-case A, C, G and T have one."""
    base = _col(base)
    return F.when(is_valid(base), F.shiftright(F.ascii(base), 1).bitwiseAND(3))


def base_of(code_) -> Column:
    return F.when(_col(code_).isNotNull(), F.element_at(F.array(*map(F.lit, BASES)), _col(code_) + 1))


def complement(code_) -> Column:
    return _col(code_).bitwiseXOR(2)


def is_valid(base) -> Column:
    return _col(base).rlike("^[ACGT]$")


def encode(seq) -> Column:
    """A string of at most 31 bases as a long."""
    return F.conv(F.translate(_col(seq), "ACTG", "0123"), 4, 10).cast("long")


def decode(kmer, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_col(kmer).cast("string"), 10, 4), k, "0"), "0123", "ACTG")


def revcomp_seq(seq) -> Column:
    return F.reverse(F.translate(_col(seq), "ACGT", "TGCA"))


def canon_seq(seq) -> Column:
    """The smaller, in ASCII order, of a contig and its reverse complement."""
    return F.least(_col(seq), revcomp_seq(seq))


def revcomp(kmer, k: int) -> Column:
    """Reverse complement of a k-mer: complement all pairs of bits, then swap pairs, fours, eights, sixteens and halves.

    Each swap needs its input twice. Steps over an array of one keep the expression from doubling with each; where both
    strands of many k-mers are wanted, kmer_at on the packed reverse complement of the whole sequence is faster.
    """
    x = F.array(_col(kmer).bitwiseXOR(F.lit(0x2AAAAAAAAAAAAAAA)))
    for width, keep in _PAIRS.items():
        x = F.transform(x, _swap(width, keep))
    x = F.transform(x, lambda v: F.shiftrightunsigned(F.shiftrightunsigned(v, 32).bitwiseOR(F.shiftleft(v, 32)), 64 - 2 * k).bitwiseAND(F.lit(mask(k))))
    return F.element_at(x, 1)


def _swap(width: int, keep: int):
    return lambda v: F.shiftrightunsigned(v, width).bitwiseAND(F.lit(keep)).bitwiseOR(F.shiftleft(v.bitwiseAND(F.lit(keep)), width))


def canon(kmer, k: int) -> Column:
    return F.least(_col(kmer), revcomp(kmer, k))


def append(kmer, code_, k: int) -> Column:
    """The k-mer one base on."""
    return F.shiftleft(_col(kmer), 2).bitwiseOR(_col(code_).cast("long")).bitwiseAND(F.lit(mask(k)))


def prepend(kmer, code_, k: int) -> Column:
    return F.shiftright(_col(kmer), 2).bitwiseOR(F.shiftleft(_col(code_).cast("long"), 2 * k - 2))


def head(kmer) -> Column:
    """The first k - 1 bases."""
    return F.shiftright(_col(kmer), 2)


def tail(kmer, k: int) -> Column:
    """The last k - 1 bases."""
    return _col(kmer).bitwiseAND(F.lit(mask(k - 1)))


def last_code(kmer) -> Column:
    return _col(kmer).bitwiseAND(F.lit(3)).cast("int")


def code_at(kmer, i: int, k: int) -> Column:
    """Code of the i-th base from the left."""
    return F.shiftright(_col(kmer), 2 * (k - 1 - i)).bitwiseAND(F.lit(3)).cast("int")


def is_homopolymer(seq) -> Column:
    seq = _col(seq)
    return seq == F.repeat(F.substring(seq, 1, 1), F.length(seq))


def blocks(seq) -> Column:
    """The sequence as longs of 16 bases each, the last filled up: what kmer_at reads. One pass over the sequence cuts it."""
    pieces = F.regexp_extract_all(F.translate(_col(seq), "ACTG", "0123"), F.lit(".{1,%d}" % BLOCK), F.lit(0))
    return F.transform(pieces, lambda x: F.conv(F.rpad(x, BLOCK, "0"), 4, 10).cast("long"))


def kmer_at(packed, pos, k: int) -> Column:
    """The k-mer at pos (from 0) out of blocks(seq): three blocks hold it, and shifts put it together."""
    packed, pos = _col(packed), _col(pos)
    q, s = F.shiftright(pos, 4), F.lit(34) - F.lit(2) * pos.bitwiseAND(15)
    zero = F.lit(0).cast("long")
    a, b, c = (F.coalesce(F.get(packed, q + i), zero) for i in range(3))
    middle = F.when(s > 32, F.shiftright(b, 2)).otherwise(F.call_function("shiftleft", b, F.lit(32) - s))
    whole = F.call_function("shiftleft", a, F.lit(64) - s).bitwiseOR(middle).bitwiseOR(F.call_function("shiftrightunsigned", c, s))
    return F.shiftright(whole.bitwiseAND(F.lit(mask(31))), 2 * (31 - k))


def register(spark: SparkSession) -> None:
    """canon(kmer, k), revcomp_dna(seq) and the table function kmers_of(seq, k), for SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp_dna(seq STRING) RETURNS STRING RETURN reverse(translate(seq, 'ACGT', 'TGCA'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION encode_dna(seq STRING) RETURNS BIGINT RETURN cast(conv(translate(seq, 'ACTG', '0123'), 4, 10) AS BIGINT)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION canon(seq STRING) RETURNS BIGINT RETURN least(encode_dna(seq), encode_dna(revcomp_dna(seq)))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION kmers_of(seq STRING, k INT) RETURNS TABLE (pos INT, kmer STRING) "
        "RETURN SELECT p AS pos, substr(seq, p + 1, k) AS kmer FROM (SELECT explode(sequence(0, length(seq) - k)) AS p) WHERE length(seq) >= k"
    )


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
