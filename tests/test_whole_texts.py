"""Queries over values beyond what the test tables hold."""

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.plans.registry import QUERIES


def test_clean_text_digests_whole_documents(spark, tmp_path):
    long = "ab " * 70_000
    spark.createDataFrame([(1, long + "x"), (2, long + "y"), (3, long + "y ")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["digest"] for r in QUERIES["clean_text"](spark, str(tmp_path)).collect()}
    assert got[1] != got[2] == got[3]
    assert len(X.clean_str(long)) <= 200_000  # a parsed unit keeps its limit


def test_column_names_of_any_index(spark):
    indexes = [-5, 0, 1, 26, 27, 702, 703, 18278, 18279, 20000, 475254, 475255, 2**31, 2**53 + 1, 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in indexes] + [(None,)], "i long")
    got = {r["i"]: r["n"] for r in df.select("i", X.column_name(F.col("i")).alias("n")).collect()}
    assert got == {i: X.excel_column_name(i) for i in indexes} | {None: None}
