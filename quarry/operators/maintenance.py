"""Incremental maintenance: fingerprint merge, upsert, stale and orphan rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import is_unchanged

_KEY = ["root_id", "normalized_path"]


def classify(old: DataFrame, scan: DataFrame, parser_version: int) -> DataFrame:
    """Full outer merge of the index with a scan: new, changed, unchanged or deleted."""
    o = old.select(*_KEY, F.col("file_id").alias("old_id"), F.col("size_bytes").alias("old_size"), F.col("modified_time").alias("old_mtime"), F.col("parser_version").alias("old_parser"), F.lit(True).alias("in_old"))
    s = scan.select(*_KEY, "size_bytes", "modified_time", F.lit(True).alias("in_scan"))
    both = o.join(s, _KEY, "full_outer")
    same = is_unchanged(F.col("old_parser"), F.col("old_size"), F.col("old_mtime"), F.lit(parser_version), F.col("size_bytes"), F.col("modified_time"))
    change = F.when(F.col("in_scan").isNull(), "deleted").when(F.col("in_old").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return both.select(*_KEY, "old_id", "size_bytes", "modified_time", change.alias("change"))


#: Rows that a task of ``in_order`` numbers, about.
NUMBERED_ROWS = 500_000


def in_order(rows: DataFrame, after: int, n: int, key: str = "normalized_path") -> tuple[DataFrame, DataFrame]:
    """(``rows`` with dense file_ids above ``after`` in the order of ``key``, a persisted table to release): neighbours get neighbouring ids.

    ``n``: their number.  Ranges are sampled, so they are held until the ids are used.
    """
    tasks = max(1, n // NUMBERED_ROWS, min(n // 1000, rows.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.repartitionByRange(tasks, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()).persist()
    task, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)  # as that function makes its numbers
    sizes = dealt.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each task
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_task", (before + after + 1).alias("_start"))
    found = dealt.withColumn("_task", task).join(F.broadcast(starts), "_task").withColumn("file_id", F.col("_start") + at)
    return found.drop("_at", "_task", "_start"), dealt


def upsert(old: DataFrame, written: DataFrame) -> DataFrame:
    """Rows by (root_id, normalized_path): written ones replace old ones and keep their ids; new rows get fresh ids.

    Fresh ids follow the largest known id; they are dense inside each task's
    range of a range-partitioned order, so no task holds all new rows.
    """
    columns = [c for c in old.columns if c not in (*_KEY, "file_id")]
    w = written.select(*_KEY, *(F.col(c).alias(f"w_{c}") for c in columns), F.lit(True).alias("in_new"))
    merged = old.withColumn("in_old", F.lit(True)).join(w, _KEY, "full_outer")
    out = merged.select(*_KEY, "file_id", *(F.when(F.col("in_new"), F.col(f"w_{c}")).otherwise(F.col(c)).alias(c) for c in columns))
    top = old.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("m")).first()["m"]
    known, fresh = out.filter("file_id IS NOT NULL"), out.filter("file_id IS NULL")
    return known.unionByName(_numbered(fresh, top))


#: Hash ranges in which fresh rows are numbered.
NUMBERING = 1024


def _numbered(rows: DataFrame, after: int) -> DataFrame:
    """file_id = after + 1, 2, ...: the rows of the hash ranges before, plus the rank inside the own one."""
    b = rows.withColumn("bucket", F.pmod(F.xxhash64(*_KEY), F.lit(NUMBERING)))
    sizes = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # at most NUMBERING rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", (F.coalesce(F.sum("n").over(before), F.lit(0)) + after).alias("start"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*_KEY))
    return b.withColumn("rank", rank).join(F.broadcast(starts), "bucket").withColumn("file_id", F.col("start") + F.col("rank")).drop("bucket", "rank", "start")


def stale_files(files: DataFrame, run_id: int) -> DataFrame:
    """Files that the given run did not see."""
    return files.filter(F.col("last_seen_run_id") != run_id)


def without_unseen(files: DataFrame, run_id: int, scan_complete: bool, unreadable: DataFrame | None = None) -> DataFrame:
    """Removes unseen files after a complete scan; what lies under an unreadable folder stays."""
    if not scan_complete:
        return files
    gone = stale_files(files, run_id).select("file_id", "normalized_path")
    if unreadable is not None:
        gone = gone.join(under(gone, unreadable).select("file_id"), "file_id", "left_anti")
    return files.join(gone.select("file_id"), "file_id", "left_anti")


def under(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files that are, or lie below, any of ``folders`` (folder: a normalized path), by an equi-join on each path and its ancestors."""
    parts = F.split("normalized_path", r"\\")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "\\"))
    above = files.select("file_id", F.explode(ancestors).alias("folder"))
    named = folders.select(F.regexp_replace("folder", r"\\+$", "").alias("folder")).distinct()
    return files.join(above.join(named, "folder", "left_semi").select("file_id").distinct(), "file_id", "left_semi")


def orphan_units(units: DataFrame, files: DataFrame) -> DataFrame:
    return units.join(files.select("file_id"), "file_id", "left_anti")


def replace_units(units: DataFrame, new_units: DataFrame, changed: DataFrame) -> DataFrame:
    """Units of changed files out, their new units in."""
    return units.join(changed.select("file_id").distinct(), "file_id", "left_anti").unionByName(new_units)


def touch(files: DataFrame, seen: DataFrame, run_id: int) -> DataFrame:
    marked = files.join(seen.select("file_id").distinct().withColumn("seen", F.lit(True)), "file_id", "left")
    return marked.withColumn("last_seen_run_id", F.when(F.col("seen"), F.lit(run_id).cast("long")).otherwise(F.col("last_seen_run_id"))).drop("seen")


def delete_root(table: DataFrame, root_id: int) -> DataFrame:
    return table.filter(F.col("root_id") != root_id)


def delete_files(files: DataFrame, gone: DataFrame) -> DataFrame:
    return files.join(gone.select("file_id").distinct(), "file_id", "left_anti")


def mark_status(files: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    marked = ids.select("file_id").distinct().withColumn("marked", F.lit(True))
    return files.join(marked, "file_id", "left").withColumn("content_status", F.when(F.col("marked"), F.lit(status)).otherwise(F.col("content_status"))).drop("marked")


def cascade(units: DataFrame, files: DataFrame) -> DataFrame:
    """Units whose file is still there."""
    return units.join(files.select("file_id"), "file_id", "left_semi")
