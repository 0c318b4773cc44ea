"""Views of plain tables as the engine's ``files``, ``units``, ``cells`` and ``paragraphs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import model as M
from quarry.functions.text import stripped

#: Valid in Spark and in DuckDB alike; ``documents`` is the only input.
FILES_SQL = """
SELECT file_id, root_id, extension, file_name, lower(file_name) AS file_name_folded, relative_path,
       lower('D:' || chr(92) || 'corpus' || chr(92) || lang || chr(92) || relative_path) AS normalized_path,
       size_bytes, modified_time, content_status, fingerprint, last_seen_run_id
FROM (
  SELECT doc_id AS file_id, lang, extension, stem || extension AS file_name,
         CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 ELSE 5 END AS root_id,
         source || chr(92) || 'd' || lpad(CAST(doc_id AS STRING), 6, '0') || chr(92) || stem || extension AS relative_path,
         n_chars AS size_bytes, CAST(1704067200 + doc_id * 3600 AS DOUBLE) AS modified_time,
         CASE WHEN doc_id % 29 = 0 THEN 'failed' WHEN doc_id % 23 = 0 THEN 'no_text' ELSE 'indexed' END AS content_status,
         CAST(n_chars AS STRING) || ':' || CAST((1704067200 + doc_id * 3600) * 1000 AS STRING) || ':1' AS fingerprint,
         CAST(CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 2 END AS BIGINT) AS last_seen_run_id
  FROM (
    SELECT *, CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' ELSE '.xlsx' END AS extension,
           CASE doc_id % 7 WHEN 0 THEN 'Budget' WHEN 1 THEN 'budget_' || CAST(2560 + doc_id % 10 AS STRING) WHEN 2 THEN 'annual_budget'
             WHEN 3 THEN 'xxbudgetxx' WHEN 4 THEN 'report_' || CAST(2560 + doc_id % 10 AS STRING) WHEN 5 THEN 'Notes 100% (a) [b]' ELSE 'minutes' END AS stem
    FROM documents) a) b
"""

#: DuckDB's text of ``units``.
UNITS_SQL = r"""
SELECT file_id * 2147483648 + sequence AS unit_id, * FROM (
  SELECT file_id, root_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS INTEGER) AS sequence,
         'line' AS location_type, CAST(line_no AS INTEGER) AS line_no, text
  FROM (
    SELECT d.doc_id AS file_id, f.root_id, line_no, regexp_replace(regexp_replace(raw, '[ \t]{2,}', ' ', 'g'), '^[\s]+|[\s]+$', '', 'g') AS text
    FROM (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS raw, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) AS line_no FROM documents) d
    JOIN files f ON f.file_id = d.doc_id WHERE f.content_status = 'indexed') x
  WHERE text <> '') y
"""

CELLS_SQL = """
SELECT file_id, sheet, row_no, column_no, text, CAST(row_number() OVER (PARTITION BY file_id ORDER BY row_no, column_no) AS INTEGER) AS sequence
FROM (
  SELECT o_custkey AS file_id, 'orders' AS sheet, o_orderkey AS row_no, 1 AS column_no, CAST(o_orderkey AS STRING) AS text FROM orders
  UNION ALL SELECT o_custkey, 'orders', o_orderkey, 2, o_orderstatus FROM orders
  UNION ALL SELECT o_custkey, 'orders', o_orderkey, 3, o_orderpriority FROM orders) c
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILES_SQL.replace("FROM documents)", "FROM {docs})"), docs=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def lines_of(text):
    """Column: array of struct(line_no, text) of a text's non-blank lines, cleaned."""
    lines = F.transform(F.split(text, "\r\n|\r|\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), stripped(F.regexp_replace(x, "[ \t]{2,}", " ")).alias("text")))
    return F.filter(lines, lambda x: x["text"] != "")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of indexed documents.  Numbering is a position in an array, so no shuffle is needed."""
    docs = files_and_text(spark, sf_dir).filter("content_status = 'indexed'")
    exploded = docs.select("file_id", "root_id", F.posexplode(lines_of(F.col("text"))).alias("i", "line"))
    return exploded.select(
        (F.col("file_id") * M.UNIT_STRIDE + F.col("i") + 1).alias("unit_id"), "file_id", "root_id", (F.col("i") + 1).alias("sequence"),
        F.lit("line").alias("location_type"), F.col("line.line_no").alias("line_no"), F.col("line.text").alias("text"),
    )


def files_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that ``units`` needs of each document, in one scan (status and root as in ``files``)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    root = F.when(F.col("lang") == "de", 1).when(F.col("lang") == "en", 2).when(F.col("lang") == "es", 3).when(F.col("lang") == "fr", 4).otherwise(5)
    status = F.when(F.col("doc_id") % 29 == 0, "failed").when(F.col("doc_id") % 23 == 0, "no_text").otherwise("indexed")
    return d.select(F.col("doc_id").alias("file_id"), root.alias("root_id"), status.alias("content_status"), "text")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spreadsheet cells: three columns a row, numbered inside each file."""
    return spark.sql(CELLS_SQL.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as paragraphs."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).cast("int").alias("sequence"), F.lit("paragraph").alias("location_type"), "text")
