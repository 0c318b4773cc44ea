"""Catalog aggregates, runs and roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("root_id", "content_status").agg(F.count(F.lit(1)).alias("n"))


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("root_id", "extension").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "extension")


def root_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("root_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("n_bytes"))


def unit_stats(units: DataFrame) -> DataFrame:
    return units.groupBy("file_id").agg(F.count(F.lit(1)).alias("unit_count"), F.sum(F.length("text").cast("long")).alias("char_count"))


def total_units(units: DataFrame) -> DataFrame:
    return units.agg(F.count(F.lit(1)).alias("n_units"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run with the greatest id of each root: an aggregate, no window."""
    last = runs.groupBy("root_id").agg(F.max(F.struct("run_id", *(c for c in runs.columns if c not in ("run_id", "root_id")))).alias("run"))
    return last.select("root_id", "run.*")


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Files per outcome of a run (columns run_id, outcome)."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(f"files_{o}")
    return outcomes.groupBy("run_id").agg(F.count(F.lit(1)).alias("files_discovered"), *(n(o) for o in ("indexed", "unchanged", "no_text", "failed", "skipped", "deleted")))


def skip_counts(listing: DataFrame) -> DataFrame:
    """Skips per reason; unsupported types stay out of the headline number."""
    found = listing.filter("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("headline", F.col("skip_reason") != "not_supported")


def abandon_running(runs: DataFrame) -> DataFrame:
    return runs.withColumn("status", F.when(F.col("status") == "running", "abandoned").otherwise(F.col("status")))


def roots_by_name(roots: DataFrame) -> DataFrame:
    return roots.orderBy(F.lower("display_path"))


def units_of(units: DataFrame, file_id: int, limit: int | None = None) -> DataFrame:
    """A file's units in order, or the first ``limit`` of them."""
    rows = units.filter(F.col("file_id") == file_id).orderBy("sequence")
    return rows if limit is None else rows.limit(limit)


def run_started(runs: DataFrame, root_id: int, mode: str, version: str, run_id: int | None = None) -> DataFrame:
    """``runs`` with a running row of the given id, or of the next one."""
    next_id = run_id or (runs.agg(F.max("run_id")).first()[0] or 0) + 1
    row = runs.sparkSession.range(1).select(
        F.lit(next_id).cast("long").alias("run_id"), F.lit(root_id).alias("root_id"), F.current_timestamp().alias("started_at"),
        F.lit("running").alias("status"), F.lit(mode).alias("mode"), F.lit(version).alias("application_version"),
    )
    return runs.unionByName(row, allowMissingColumns=True)


def run_finished(runs: DataFrame, run_id: int, status: str, counters: dict[str, int] | None = None) -> DataFrame:
    """``runs`` with the run's end, and its counters where it has any."""
    own = F.col("run_id") == run_id
    for name, n in (counters or {}).items():
        runs = runs.withColumn(name, F.when(own, F.lit(n).cast("long")).otherwise(F.col(name)))
    elapsed = F.unix_micros(F.current_timestamp()) / 1e6 - F.unix_micros("started_at") / 1e6
    return runs.withColumns({
        "finished_at": F.when(own, F.current_timestamp()).otherwise(F.col("finished_at")), "status": F.when(own, F.lit(status)).otherwise(F.col("status")),
        "elapsed_seconds": F.when(own, elapsed).otherwise(F.col("elapsed_seconds")),
    })
