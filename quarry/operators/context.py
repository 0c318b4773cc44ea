"""Neighbour frames and row context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import model as M
from quarry.functions.text import row_context


def with_neighbours(units: DataFrame, wanted: DataFrame, width: int = M.NEIGHBOUR_UNITS) -> DataFrame:
    """For the wanted (file_id, sequence): ``joined``, the texts of units at most ``width`` away in order.

    Only files with a wanted unit are read; each wanted unit asks for its 2 * width + 1
    sequences by an equi-join, so nothing is gathered beyond those.
    """
    asked = wanted.select("file_id", "sequence").distinct().withColumn("near", F.explode(F.sequence(F.col("sequence") - width, F.col("sequence") + width)))
    near = units.select("file_id", F.col("sequence").alias("near"), F.col("text").alias("near_text"))
    found = asked.join(near, ["file_id", "near"]).groupBy("file_id", "sequence").agg(F.array_sort(F.collect_list(F.struct("near", "near_text"))).alias("around"))
    pieces = F.filter(F.transform("around", lambda x: F.trim(x["near_text"])), lambda t: t != "")
    return found.select("file_id", "sequence", F.size("around").cast("long").alias("n_units"), F.concat_ws(" ", pieces).alias("joined"))


def with_row_context(cells: DataFrame, wanted: DataFrame, compat: bool = False) -> DataFrame:
    """For the wanted cells (file_id, sequence, sheet, row_no, text): ``context``, with up to ROW_CELLS others of the row.

    A row's first ROW_CELLS + 1 cells hold every cell's first ROW_CELLS others, so
    only they are joined, however wide a row is.  compat: only cells among the
    file's first ROW_SCAN others count.
    """
    keys = ["file_id", "sheet", "row_no"]
    asked = wanted.select(*keys).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("sequence"))
    first = cells.join(asked, keys, "left_semi").withColumn("place", place).filter(F.col("place") <= M.ROW_CELLS + 1)
    other = first.select(*keys, F.col("sequence").alias("other"), F.col("text").alias("other_text"))
    pairs = wanted.select(*keys, "sequence", "text").join(other, keys, "left")
    own = F.col("other") == F.col("sequence")
    seen = F.col("other").isNotNull() & ~own
    if compat:  # the unit itself is left out before counting
        seen &= F.col("other") <= M.ROW_SCAN + F.when(F.col("sequence") <= M.ROW_SCAN, 1).otherwise(0)
    listed = F.array_sort(F.collect_list(F.when(seen, F.struct("other", "other_text"))))  # at most ROW_CELLS + 1 each
    found = pairs.groupBy(*keys, "sequence", "text").agg(listed.alias("others"))
    texts = F.transform(F.slice("others", 1, M.ROW_CELLS), lambda x: x["other_text"])
    return found.select(*keys, "sequence", "text", row_context(F.col("text"), texts).alias("context"))
