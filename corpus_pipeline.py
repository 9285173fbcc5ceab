"""From documents to token ids: civil texts, without lines that repeat, one of each near-duplicate group, none of them a
benchmark's, as byte-level BPE.

Every stage takes what the one before it has kept, as a table, and works on all of it. A stage that filters returns its rows
whole and with the columns of documents; line dedup returns every row, with its text (and n_chars) without the lines
that went.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontaminate, lines, simhash, toxicity
from strandloom.llm.common import table, written


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learnt from the labelled ones, scores below its threshold."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; of lines that resemble each other only the earliest stays. A null text stays null."""
    found = lines.without_fuzzy_lines(docs)
    text = F.when(F.col("rest.text").isNotNull(), F.col("text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select(*(new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group of near-duplicates by fingerprint or of texts of Jaccard 0.8 or more in five words."""
    return simhash.keep_one_of_copies(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, in whatever order its parts stand."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", civil),
    ("line dedup", distinct_lines),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("byte-level BPE", encoded),
]
#: SQL can express neither the classifier nor the components; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
