"""What resampling keeps between its passes."""

from strandloom.llm import resample


def test_no_block_of_the_matrix_is_kept(spark, monkeypatch):
    """A reader of files takes thousands of rows together, so that tables between stages have a row a document, not a block."""
    kept, put = [], resample.written
    monkeypatch.setattr(resample, "written", lambda df, *a: kept.append(put(df, *a)) or kept[-1])
    docs = spark.createDataFrame([(i, f"word{i} " * 30) for i in range(100)], "doc_id long, text string")
    target = spark.createDataFrame([(1, "word7 word8")], "item_id long, text string")
    assert resample.resample(docs, target).where("rank is not null").count() == 10
    assert kept and not any(t.startswith("array") for df in kept for _, t in df.dtypes)
