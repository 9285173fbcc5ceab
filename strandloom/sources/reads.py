"""Reads from FASTA and FASTQ files, from a landing folder, and cut from documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What stands for each letter when documents play the part of DNA.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTER_BASES = "ACTGACTGACTGACTGACTGACTGACACTGACTGACTGACTGACTGACTGAC"
READ, STEP, READS_OF_A_TEXT = 100, 50, 100_000_000
#: Bytes of texts that are cut together (a longer text is cut by itself), and reads put out together.
BLOCK, ROWS = 1 << 22, 20_000


def spread(table: DataFrame, by: str) -> DataFrame:
    """A table that comes in fewer pieces than there are cores, dealt out by a column; one in enough pieces stays as it is. Whole
    rows move, before what they hold is taken apart. Only the sizes of files are looked at."""
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    piece = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return table.repartition(2 * cores, by) if max(len(table.inputFiles()), size // piece) < cores else table


def from_documents(docs: DataFrame, breaks: bool = False) -> DataFrame:
    """read_id, pair_id, mate and seq: windows of 100 bases, one every 50 and the last at the end, of each text with its letters turned into
    bases and all else left out; a text of fewer letters is one read, a text without any (or null) none. Two windows in a row are
    mates. With breaks, line ends stay as N. doc_ids are to be different; rows without one give no reads. A text has fewer windows
    than 10^8, as a string has at most 2^31 bytes."""
    base = np.zeros(256, np.uint8)
    base[list((LETTERS + "\n" * breaks).encode())] = list((LETTER_BASES + "N" * breaks).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            texts = batch.column(1).cast(pa.large_string())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data, first, at = np.frombuffer(texts.buffers()[2] or b"", np.uint8), batch.column(0).to_numpy(), 0
            while at < len(first):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
                yield from cut(first[at:to], base[data[ends[at] : ends[to]]], ends[at : to + 1] - ends[at])
                at = to

    def cut(first: np.ndarray, bases: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = bases > 0
        n = np.diff(np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[ends]) if len(first) > 1 else np.array([np.count_nonzero(kept)])
        bases, start = bases[kept], np.cumsum(n) - n
        last = np.maximum(n - READ, 0)
        reads = np.where(n > 0, -(-last // STEP) + 1, 0)
        short = np.flatnonzero((n > 0) & (n < READ))
        reads[short] = 0
        for i in range(0, len(short), ROWS):
            t = short[i : i + ROWS]
            yield out(first[t], np.zeros(len(t), np.int64), np.concatenate([bases[a : a + m] for a, m in zip(start[t], n[t])]), n[t])
        text = np.repeat(np.arange(len(n)), reads)
        no = np.arange(len(text)) - np.repeat(np.cumsum(reads) - reads, reads)
        at = start[text] + np.minimum(STEP * no, last[text])
        for i in range(0, len(text), ROWS):
            own = np.lib.stride_tricks.sliding_window_view(bases, READ)[at[i : i + ROWS]]
            yield out(first[text[i : i + ROWS]], no[i : i + ROWS], own.ravel(), np.full(len(own), READ))

    def out(first: np.ndarray, no: np.ndarray, bases: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        seq = pa.Array.from_buffers(pa.string(), len(no), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(bases)])
        return pa.RecordBatch.from_arrays([pa.array(first + no), pa.array(first + no // 2), pa.array((no % 2).astype(np.int32)), seq], names=["read_id", "pair_id", "mate", "seq"])

    whole = spread(docs.select("doc_id", "text").where("doc_id is not null"), "doc_id").where("text is not null")
    first = F.col("doc_id").cast("long") * READS_OF_A_TEXT
    return whole.select(first.alias("first"), F.col("text").cast("string").alias("text")).mapInArrow(run, "read_id long, pair_id long, mate int, seq string")


def _numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line_no (from 0, in each file) and value. Lines are counted by piece of file; only those counts are put in order."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("base")).alias("line_no"), "value")


def read_sequences(spark: SparkSession, path: str | list[str], fastq: bool = False) -> DataFrame:
    """read_id, pair_id, mate and seq of FASTA (two lines a record) or FASTQ (four) files, also compressed ones. Headers and qualities
    go; qualities may begin with any sign, since records are found by counting. Mates stand one after the other. read_id is the
    record's number, after those of the files before it by name."""
    lines = _numbered(spark, path)
    size = 4 if fastq else 2
    records = lines.where(F.col("line_no") % size == 1).select("file", F.floor(F.col("line_no") / size).alias("no"), F.col("value").alias("seq"))
    files = records.groupBy("file").agg(F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = files.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "base")
    number = F.col("base") + F.col("no")
    return records.join(files, "file").select(number.alias("read_id"), F.floor(number / 2).alias("pair_id"), (number % 2).cast("int").alias("mate"), "seq")


def read_stream(spark: SparkSession, folder: str, files_a_batch: int = 100, fastq: bool = False) -> DataFrame:
    """seq, as a stream, of the sequences in a folder: of files with one sequence a line or FASTA (headers go), or of FASTQ files, whose
    records have four lines. A FASTQ file is one row of this stream, cut into its records at once, so of 2 GB at most; each_files() takes any."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_a_batch)
    if not fastq:
        return rows.text(folder).where(~F.col("value").startswith(">")).select(F.col("value").alias("seq"))
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    return rows.text(folder, wholetext=True).select(F.explode(F.filter(lines, lambda x, i: i % 4 == 1)).alias("seq"))


#: The columns of a file source that has a row a file; of these only the path is asked for, so that no content is read.
_FILE = "path string, modificationTime timestamp, length long, content binary"


def each_files(spark: SparkSession, folder: str, put, checkpoint: str, fastq: bool = False, files_a_batch: int = 100):
    """Starts a stream over the files that arrive in a folder: put(reads, number) is called with the reads (as read_sequences() has them; read_id
    is of its own over all batches) of each batch of files. What streams is the files' names; a batch's files are then read as any
    others, in as many tasks as their size asks for, so that a file may have any size. Ends when there are no more."""

    def run(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]  # files_a_batch at most
        if paths:
            found = read_sequences(batch.sparkSession, paths, fastq)
            put(found.withColumns({"read_id": F.col("read_id") + (number << 40), "pair_id": F.col("pair_id") + (number << 39)}), number)

    names = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_a_batch).load(folder).select("path")
    return names.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_junctions(spark: SparkSession, path: str) -> DataFrame:
    """kmer (string), dist, cov and linked from lines of the text form."""
    part = F.split(F.trim("value"), r"\s+")
    ints = lambda a, n, kind: F.transform(F.slice(part, a, n), lambda x: x.cast(kind))
    return spark.read.text(path).where("trim(value) <> ''").select(part[0].alias("kmer"), ints(2, 5, "int").alias("dist"), ints(7, 4, "int").alias("cov"), F.transform(F.slice(part, 12, 5), lambda x: x == "1").alias("linked"))


def flags(linked) -> Column:
    return F.transform(linked, lambda x: x.cast("int"))
