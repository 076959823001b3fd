"""Plans of the operators that use DataFrame functions only, and what reaches the scans."""

import re

from quarryline.llm import exactdedup, linkgraph, mixing

PYTHON = re.compile("Python|Pandas|Arrow")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "A b", None)], "doc_id long, text string, source string")
    pages = spark.createDataFrame([(1, "http://a.example.com/en/", "<a href='http://b.org/'>")], "page_id long, url string, html string")
    for df in (exactdedup.exact_groups(docs), mixing.mix(docs), linkgraph.judge(pages)):
        assert not PYTHON.search(plan(df)) and "Cartesian" not in plan(df)


def test_scans_read_the_columns_they_need(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "s", "x" * 10)], "doc_id long, text string, source string, wide string").write.parquet(f"file://{tmp_path}/d")
    read = spark.read.parquet(f"file://{tmp_path}/d")
    text = read.select("doc_id", "text")
    assert "wide" not in plan(exactdedup.exact_groups(read)) and text.columns == ["doc_id", "text"]
