import time

from pyspark.sql import functions as F

from strandloom.sources import reads as source


def test_windows_of_texts_of_any_length(spark):
    texts = ["b" * n + "dt" for n in (1, 97, 98, 99, 100, 147, 148, 149, 198, 248, 300)]
    got = {}
    for r in source.from_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("read_id").collect():
        got.setdefault(r.read_id // source.READS_OF_A_TEXT, []).append(r.seq)
    table = str.maketrans(source.LETTERS, source.LETTER_BASES)
    for i, t in enumerate(texts):
        t, last = t.translate(table), max(len(t) - 100, 0)
        assert got[i] == [t[min(50 * w, last) :][:100] for w in range((last + 49) // 50 + 1)]


def test_a_long_text_is_gone_through_once(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('thequickbrownfox', cast(id + 200000 as int))").alias("text"))
    began = time.time()
    assert source.from_documents(docs).count() == 63_999
    source.from_documents(docs).agg(F.sum(F.length("seq"))).collect()
    assert time.time() - began < 60
