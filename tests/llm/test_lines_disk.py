"""What line dedup keeps on disk."""

from strandloom.llm import lines


def test_no_row_a_line_with_its_bands_is_kept(spark, monkeypatch):
    """Of 600 copies of a line and 600 others, tables between stages hold one row with bands for each different line."""
    kept, put = [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, *a: kept.append(put(df, *a)) or kept[-1])
    monkeypatch.setattr(lines, "drop_written", lambda df: None)
    rows = [(i, f"a line that comes again and again\nand line {i * 7919} of its own {i ** 3}") for i in range(600)]
    got = {r.doc_id: r.n_removed for r in lines.without_fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and min(v for k, v in got.items() if k) >= 1
    banded = [df.count() for df in kept if "bands" in df.columns]
    assert banded == [601]
