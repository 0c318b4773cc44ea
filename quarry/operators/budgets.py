"""Budgets of a file's units, as running sums over units that are stored already.

A file may have so many units, and so many characters, as its limits allow; the unit
that goes over the limit of characters is the last one.  A file's units are summed up
in stretches of STRETCH sequence numbers first, then over its stretches, then inside
each; so no task gathers a file, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import model as M

#: Sequence numbers that are summed up together.
STRETCH = 4096


def with_running(units: DataFrame) -> DataFrame:
    """``units`` with ``units_before`` and ``chars_before``: what the file's units before this one come to."""
    stretch = F.floor(F.col("sequence") / STRETCH).cast("long")
    own = units.withColumn("_stretch", stretch)
    totals = own.groupBy("file_id", "_stretch").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("text").cast("long")).alias("_chars"))
    above = Window.partitionBy("file_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for STRETCH units
    starts = totals.select("file_id", "_stretch", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"), F.coalesce(F.sum("_chars").over(above), F.lit(0)).alias("_chars"))
    inside = Window.partitionBy("file_id", "_stretch").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)  # STRETCH units at most
    found = own.join(starts, ["file_id", "_stretch"])
    n = F.col("_n") + F.count(F.lit(1)).over(inside)
    chars = F.col("_chars") + F.coalesce(F.sum(F.length("text").cast("long")).over(inside), F.lit(0))
    return found.withColumn("units_before", n).withColumn("chars_before", chars).drop("_stretch", "_n", "_chars")


def within(units: DataFrame, max_units: int, max_chars: int = M.MAX_DOCUMENT_CHARS) -> DataFrame:
    """The units that the budgets leave, in the columns of ``units``."""
    running = with_running(units)
    return running.filter((F.col("units_before") < max_units) & (F.col("chars_before") <= max_chars)).select(*units.columns)


def truncated(units: DataFrame, max_units: int, max_chars: int = M.MAX_DOCUMENT_CHARS) -> DataFrame:
    """(file_id, truncated, unit_count, char_count) of every file: whether something was cut, and what is left."""
    running = with_running(units)
    left = (F.col("units_before") < max_units) & (F.col("chars_before") <= max_chars)
    return running.groupBy("file_id").agg(
        (~F.bool_and(left)).alias("truncated"), F.count_if(left).alias("unit_count"), F.sum(F.when(left, F.length("text").cast("long")).otherwise(0)).alias("char_count")
    )


def cut(files: DataFrame, units: DataFrame, max_units: int, max_chars: int = M.MAX_DOCUMENT_CHARS) -> tuple[DataFrame, DataFrame]:
    """``files`` and ``units`` under the budgets: over-long files are cut and flagged, their counts are of what is left."""
    told = truncated(units, max_units, max_chars).withColumnsRenamed({"truncated": "_cut", "unit_count": "_units", "char_count": "_chars"})
    both = files.join(told, "file_id", "left")
    flags = {"truncated": F.coalesce(F.col("truncated"), F.lit(False)) | F.coalesce("_cut", F.lit(False)) if "truncated" in files.columns else F.coalesce("_cut", F.lit(False))}
    if "unit_count" in files.columns:
        flags["unit_count"] = F.coalesce(F.col("_units").cast("int"), F.col("unit_count"))
    if "char_count" in files.columns:
        flags["char_count"] = F.coalesce("_chars", "char_count")
    return both.withColumns(flags).drop("_cut", "_units", "_chars"), within(units, max_units, max_chars)
