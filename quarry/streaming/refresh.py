"""Streaming refresh: what happens to files arrives as rows and is merged into a store.

An event says what a file holds since a time: root_id, relative_path, modified_time,
text (null: the file was deleted).  The store's ``files`` and ``tombstones`` hold the
version of every file that it has seen, so a batch that is repeated, or comes late,
changes nothing that is newer.  Files, units, postings and tombstones of a batch are
committed together; a batch that meets another writer's commit of the same parts is
merged anew.  Of units only the parts of the batch's files are read and written;
``files`` and ``tombstones``, narrow tables, are written anew for the root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from quarry import model as M
from quarry.functions.text import extension_of, fingerprint, folded, mime_category, normalized_path_str
from quarry.operators import grams, maintenance
from quarry.operators.indexing import by_root, of_root, part_facts, units_change
from quarry.sources.adapters import lines_of
from quarry.sources.store import WHOLE, Change, Snapshot, SnapshotStore, number_of

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TOMBSTONES = StructType([StructField("root_id", IntegerType()), StructField("normalized_path", StringType()), StructField("deleted_time", DoubleType())])


def document_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Documents that arrive as files, with the time of their file as ``modified_time``."""
    docs = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return docs.withColumn("modified_time", F.unix_micros("_metadata.file_modification_time") / 1e6)


def document_events(docs: DataFrame, root_id: int = 1) -> DataFrame:
    """Documents as events; their paths are made of source and id, a null text deletes."""
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("\\d"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".txt"))
    return docs.select(F.lit(root_id).alias("root_id"), name.alias("relative_path"), F.col("modified_time").cast("double").alias("modified_time"), "text")


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Windowed counts per event type with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def newest(events: DataFrame, base: str) -> DataFrame:
    """The last event of each file: by time, a deletion before a text, then by text."""
    path = F.concat(F.lit(base.rstrip("\\") + "\\"), folded(F.col("relative_path")))
    last = F.max(F.struct("modified_time", F.col("text").isNotNull().alias("alive"), "text", "relative_path")).alias("e")
    return events.withColumn("normalized_path", path).groupBy("normalized_path").agg(last).select("normalized_path", "e.modified_time", "e.alive", "e.text", "e.relative_path")


def accepted(at: Snapshot, root_id: int, events: DataFrame) -> DataFrame:
    """The events that are newer than what the snapshot knows of their files, with the file's id where it has one."""
    files = of_root(at, "files", M.FILES, root_id).select("normalized_path", F.col("file_id").alias("old_id"), F.col("modified_time").alias("known"))
    gone = of_root(at, "tombstones", TOMBSTONES, root_id).select("normalized_path", "deleted_time")
    both = events.join(files, "normalized_path", "left").join(gone, "normalized_path", "left")
    return both.filter(F.col("modified_time") > F.coalesce(F.greatest("known", "deleted_time"), F.lit(float("-inf")))).drop("known", "deleted_time")


def merge(store: SnapshotStore, events: DataFrame, root_id: int, base: str) -> bool:
    """Merges events of one root, whose paths lie below ``base``; False where none was newer than what is known."""
    spark, held, last = store.spark, [], newest(events.filter(F.col("root_id") == root_id), base).persist()

    def persisted(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    def build(at: Snapshot) -> Change | None:
        fresh = persisted(accepted(at, root_id, last))
        kinds = {(r["alive"], r["known"]): r["n"] for r in fresh.groupBy("alive", F.col("old_id").isNotNull().alias("known")).agg(F.count(F.lit(1)).alias("n")).collect()}  # four kinds
        if not kinds:
            return None
        ids = fresh.select("normalized_path", F.col("old_id").alias("file_id")).filter("file_id IS NOT NULL")
        if n := kinds.get((True, False), 0):
            least = 0 if "file_id" in at.counters or "files" not in at.tables else at.read("files").agg(F.max("file_id")).first()[0] or 0
            numbered, kept = maintenance.in_order(fresh.filter("alive AND old_id IS NULL").select("normalized_path"), store.reserve("file_id", n, least), n)
            held.append(kept)
            ids = ids.unionByName(numbered.select("normalized_path", "file_id"))
        rows = persisted(fresh.join(ids, "normalized_path", "left").withColumn("lines", F.when(F.col("alive"), lines_of(F.col("text")))))
        alive = rows.filter("alive")
        name = F.element_at(F.split("relative_path", r"\\"), -1)
        size = F.octet_length(F.col("text").cast("binary")).cast("long")
        has = F.size("lines") > 0
        written = alive.withColumn("file_name", name).withColumn("extension", extension_of(F.col("file_name"))).select(
            "file_id", F.lit(root_id).alias("root_id"), F.concat(F.lit(base.rstrip("\\") + "\\"), "relative_path").alias("display_path"), "normalized_path", "relative_path", "file_name",
            folded(F.col("file_name")).alias("file_name_folded"), "extension", mime_category(F.col("extension")).alias("mime_category"), size.alias("size_bytes"), F.lit(None).cast("double").alias("created_time"), "modified_time",
            fingerprint(size, F.col("modified_time"), F.lit(M.PARSER_VERSION)).alias("fingerprint"), F.when(has, "indexed").otherwise("no_text").alias("content_status"), F.lit(M.PARSER_VERSION).alias("parser_version"),
            F.size("lines").alias("unit_count"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, u: a + F.length(u["text"])).alias("char_count"), F.current_timestamp().alias("indexed_at"),
            F.lit(0).cast("long").alias("last_seen_run_id"), F.lit("").alias("error_code"), F.lit("").alias("error_message"), F.lit(False).alias("truncated"), F.lit("").alias("warnings"),
        )
        location = F.struct(*((F.col("line.line_no").cast("int") if f.name == "line" else F.lit(None).cast(f.dataType)).alias(f.name) for f in M.LOCATION))
        units = alive.select("file_id", F.posexplode("lines").alias("i", "line")).select(
            (F.col("file_id") * M.UNIT_STRIDE + F.col("i") + 1).alias("unit_id"), "file_id", F.lit(root_id).alias("root_id"), (F.col("i") + 1).alias("sequence"), F.lit("line").alias("location_type"),
            F.concat(F.lit("Line "), F.col("line.line_no")).alias("location_label"), location.alias("location"), F.col("line.text").alias("text"),
        )
        others = of_root(at, "files", M.FILES, root_id).join(fresh.select("normalized_path"), "normalized_path", "left_anti").select(*M.FILES.fieldNames())
        buried = of_root(at, "tombstones", TOMBSTONES, root_id).join(fresh.select("normalized_path"), "normalized_path", "left_anti").select(*TOMBSTONES.fieldNames())
        dead = rows.filter("NOT alive").select(F.lit(root_id).alias("root_id"), "normalized_path", F.col("modified_time").alias("deleted_time"))
        moved = rows.filter("old_id IS NOT NULL").select("file_id")
        touched = rows.filter("file_id IS NOT NULL").select(number_of(F.col("file_id")).alias("k"))
        numbers = [r["k"] for r in touched.distinct().collect()]  # a row for FILES_PER_PART files
        parts = {"files": by_root(at, "files", M.FILES, root_id, others.unionByName(written)), "tombstones": by_root(at, "tombstones", TOMBSTONES, root_id, buried.unionByName(dead))}
        told = part_facts(others.unionByName(written), root_id, numbers)
        return Change(parts | (units_change(at, root_id, moved, units, numbers) if numbers or WHOLE in at.parts("units") else {}), options=grams.OPTIONS, told=told)

    try:
        return store.update(build) is not None
    finally:
        for df in [last, *held]:
            df.unpersist()


def refresh(events: DataFrame, store: SnapshotStore, checkpoint: str, bases: dict[int, str], every: str = "20 seconds", once: bool = False) -> StreamingQuery:
    """Merges each batch of a stream of events; ``bases``: the paths of the roots by their ids."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            for root_id, base in bases.items():
                merge(store, rows, root_id, normalized_path_str(base))
        finally:
            rows.unpersist()

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
