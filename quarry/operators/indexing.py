"""The indexing run: scan -> classify -> parse what changed -> commit.

A run is recorded as running before it begins, and as completed, failed or
cancelled when it ends.  Files, units and the gram index are committed together, when
everything succeeded; a failed or cancelled run leaves them as they were.  Contents
are read for new and changed files alone, and only the parts of ``units`` that hold
changed or deleted files are written again.  Every table is parted by root, so runs of
several roots, and a streaming refresh of other files, go on side by side; a run whose
own parts another writer has changed meanwhile merges anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quarry import __version__
from quarry import model as M
from quarry.functions.text import fingerprint, folded, mime_category, normalized_path_str
from quarry.operators import catalog, grams, maintenance
from quarry.sources import listing
from quarry.sources.parsers import parse_bytes
from quarry.sources.store import WHOLE, Change, Damaged, Snapshot, SnapshotStore, number_of, part_of, row_sum

#: Bytes of contents that one parsing task reads, about.
TASK_BYTES = 16 << 20
_COUNTERS = ("files_discovered", "files_indexed", "files_unchanged", "files_no_text", "files_failed", "files_skipped", "files_deleted", "files_new")


def by_root(at: Snapshot, name: str, schema: StructType, root_id: int, rows: DataFrame) -> tuple[DataFrame, str, list[str]]:
    """A ``Change`` of one root's rows of a table; a table that was written whole is parted on the way."""
    rows, named = rows.select(*schema.fieldNames()), [str(root_id)]
    if WHOLE in at.parts(name):
        others = at.table(name, schema).filter(F.col("root_id") != root_id)
        named += [str(r["root_id"]) for r in others.select("root_id").distinct().collect()]  # a row for each root
        rows = others.unionByName(rows)
    return rows.withColumn("part", F.col("root_id").cast("string")), "part", named


def of_root(at: Snapshot, name: str, schema: StructType, root_id: int) -> DataFrame:
    return at.table(name, schema).filter(F.col("root_id") == root_id)


def units_change(at: Snapshot, root_id: int, gone: DataFrame, fresh: DataFrame, numbers: Iterable[int], rebuild: bool = False) -> dict:
    """The ``parts`` of a change that takes the units of files ``gone`` (file_id) out and puts ``fresh`` ones in, with their postings.

    ``numbers``: which parts of the root that touches, each FILES_PER_PART files.
    """
    known, parts = at.parts("units"), {f"{root_id}-{k}" for k in numbers}
    if rebuild:
        parts |= {p for p in known if p.startswith(f"{root_id}-")}
    whole = WHOLE in known  # a table that was written whole once: all of it is dealt to parts now
    old = at.read("units", None if whole else parts & set(known))
    own = at.table("units", M.UNITS) if old is None else old
    own = own.select(*((F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in M.UNITS))  # an adapter's table lacks some
    mine = F.col("root_id") == root_id
    kept = own.filter(~mine) if rebuild else own.filter(~mine).unionByName(own.filter(mine).join(gone.select("file_id"), "file_id", "left_anti"))
    fresh = fresh.select(*M.UNITS.fieldNames())
    units = kept.unionByName(fresh).withColumn("part", part_of(F.col("root_id"), F.col("file_id")))
    if whole:
        parts |= {r["part"] for r in units.select("part").distinct().collect()}  # a row for FILES_PER_PART files
    lists, column, names = grams.postings(units if whole else fresh)
    return {"units": (units, "part", parts), grams.TABLE: (lists, column, names + (at.parts(grams.TABLE) if whole else []))}


#: Extensions that are told of a part; of more nothing is told.
_EXTENSIONS = 32


def part_bounds(files: DataFrame, by: list[str]) -> DataFrame:
    """The least and the most of the files' sizes, times and paths, and their extensions."""
    bounds = [f(c).alias(f"{name}_{c}") for c in ("size_bytes", "modified_time", "normalized_path") for name, f in (("least", F.min), ("most", F.max))]
    return files.groupBy(*by).agg(*bounds, F.collect_set("extension").alias("extensions"))


def part_facts(files: DataFrame, root_id: int, numbers: list[int]) -> dict[str, dict[str, dict]]:
    """What the pointer says of parts of ``units``: the bounds of their files' attributes, by which searches leave parts out."""
    own = files.withColumn("k", number_of(F.col("file_id"))).filter(F.col("k").isin([int(k) for k in numbers]))
    found = part_bounds(own, ["k"]).collect()  # a row for FILES_PER_PART files
    out = {}
    for r in found:
        facts = {c: [r[f"least_{c}"], r[f"most_{c}"]] for c in ("size_bytes", "modified_time", "normalized_path")}
        out[f"{root_id}-{r['k']}"] = {"files": facts | ({"extension": sorted(r["extensions"])} if len(r["extensions"]) <= _EXTENSIONS else {})}
    return {"units": out}


def seen_counter(root_id: int) -> str:
    """The pointer's number of the last run in which all files of a root were seen as they are in ``files``."""
    return f"seen_run_of_root_{root_id}"


class Indexer:
    """Indexes roots into a store; tables files, units, postings, runs, roots, and skips of each root's last run."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, *, exclude: tuple[str, ...] = (), max_mb: int = M.MAX_FILE_MB, docx_headers: bool = True, **skip_options):
        """Options as ``Settings.for_indexer`` gives them; ``exclude``: folders of the program's own data."""
        self.spark, self.store, self.exclude, self.max_mb, self.docx_headers = spark, store, exclude, max_mb, docx_headers
        self.options = skip_options | {"max_mb": max_mb}

    def root_id(self, root: str, at: Snapshot | None = None) -> tuple[int, DataFrame, bool]:
        """The id of a root, the roots table with it, and whether it is new there."""
        roots = (at or self.store.snapshot()).table("roots", M.ROOTS)
        known = {r["normalized_path"]: r["root_id"] for r in roots.collect()}  # one row per configured root
        key = normalized_path_str(root)
        if key in known:
            return known[key], roots, False
        made = max(known.values(), default=0) + 1
        return made, roots.unionByName(self.spark.createDataFrame([(made, root, key)], M.ROOTS)), True

    def _next(self, counter: str, n: int, at: Snapshot, table: str) -> int:
        """``n`` numbers after the returned one; a store without that counter begins after its table's largest."""
        least = 0 if counter in at.counters or table not in at.tables else at.read(table).agg(F.max(counter)).first()[0] or 0
        return self.store.reserve(counter, n, least)

    def _started(self, root: str, mode: str) -> tuple[int, int]:
        """(root_id, run_id) of a run that is recorded as running."""
        run_id = self._next("run_id", 1, self.store.snapshot(), "runs") + 1
        found = []

        def build(at: Snapshot) -> Change:
            root_id, roots, new = self.root_id(root, at)
            found[:] = [root_id]
            runs = catalog.run_started(catalog.abandon_running(of_root(at, "runs", M.RUNS, root_id)), root_id, mode, __version__, run_id)
            return Change({"runs": by_root(at, "runs", M.RUNS, root_id, runs)}, {"roots": roots} if new else {}, reads=frozenset({"roots"} if new else ()))

        self.store.update(build)
        return found[0], run_id

    def _finished(self, at: Snapshot, root_id: int, run_id: int, status: str, counters: dict | None = None) -> DataFrame:
        return catalog.run_finished(of_root(at, "runs", M.RUNS, root_id), run_id, status, counters)

    def _ended(self, root_id: int, run_id: int, status: str) -> None:
        self.store.update(lambda at: Change({"runs": by_root(at, "runs", M.RUNS, root_id, self._finished(at, root_id, run_id, status))}))

    def run(self, root: str, rebuild: bool = False, cancelled: Callable[[], bool] = lambda: False) -> dict:
        """The run's row.  ``cancelled`` is asked between files and between steps."""
        verdict = listing.validate_root(root)
        if verdict != "ok":
            raise ValueError(f"root: {verdict}")
        root_id, run_id = self._started(root, "rebuild" if rebuild else "update")
        held: list[DataFrame] = []

        def build(at: Snapshot) -> Change:
            self._released(held)
            return self._update(at, root, root_id, run_id, rebuild, cancelled, held)

        try:
            self.store.update(build)
            grams.merged(self.store)
        except listing.Cancelled:
            self._ended(root_id, run_id, "cancelled")
        except BaseException:
            self._ended(root_id, run_id, "failed")
            raise
        finally:
            self._released(held)
        return self.store.read("runs", [str(root_id)]).filter(F.col("run_id") == run_id).first().asDict()

    @staticmethod
    def _released(held: list[DataFrame]) -> None:
        for df in held:
            df.unpersist()
            listing.forget(df)
        held.clear()

    def _update(self, at: Snapshot, root: str, root_id: int, run_id: int, rebuild: bool, cancelled: Callable[[], bool], held: list[DataFrame]) -> Change:
        def persisted(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        def checked() -> None:
            if cancelled():
                raise listing.Cancelled

        found = listing.list_files(self.spark, root, hidden=self.options.get("allow_hidden", False), exclude=self.exclude, cancelled=cancelled)
        held.append(found)
        base = normalized_path_str(root) + "\\"
        scan = listing.scanned(found, root, **self.options).withColumn("root_id", F.lit(root_id)).withColumn("normalized_path", F.concat(F.lit(base), folded(F.col("relative_path"))))
        scan = persisted(scan.withColumn("skip_reason", F.when(F.col("problem").isNull(), F.col("skip_reason")).otherwise(F.col("problem"))))
        reasons = scan.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"), row_sum("root_id", "path", "skip_reason").alias("sum")).collect()  # a row for each reason
        seen = {r["skip_reason"]: r["n"] for r in reasons}
        told = {"rows": sum(n for reason, n in seen.items() if reason), "sum": str(int(sum(r["sum"] for r in reasons if r["skip_reason"])))}
        same_skips = told.items() <= at.tables.get("skips", {}).get(str(root_id), {"rows": 0, "sum": "0"} if "skips" in at.tables else {}).items()
        skips = scan.filter("skip_reason IS NOT NULL").select("root_id", "path", "skip_reason")
        files = of_root(at, "files", M.FILES, root_id)
        if seen.get("unreadable"):
            folders = scan.filter("problem = 'unreadable'").select(F.when(F.col("path") == root, F.lit(normalized_path_str(root))).otherwise(F.col("normalized_path")).alias("folder"))
            stays = maintenance.under(files, folders).select("normalized_path")
        else:
            stays = files.select("normalized_path").limit(0)
        change = maintenance.classify(files, scan.filter("skip_reason IS NULL"), M.PARSER_VERSION)
        change = change.join(stays.withColumn("stays", F.lit(True)), "normalized_path", "left")
        kind = F.when((F.col("change") == "deleted") & F.col("stays"), "kept")
        if rebuild:
            kind = kind.when(F.col("change") == "unchanged", "changed")
        change = persisted(change.withColumn("change", kind.otherwise(F.col("change"))).drop("stays"))
        n = {r["change"]: (r["n"], r["bytes"] or 0) for r in change.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")).collect()}  # five classes
        checked()
        count = lambda c: n.get(c, (0, 0))[0]
        counts = dict.fromkeys(_COUNTERS, 0) | {
            "files_discovered": sum(count(c) for c in ("new", "changed", "unchanged")), "files_unchanged": count("unchanged"), "files_new": count("new"), "files_deleted": count("deleted"),
            "files_skipped": sum(v for reason, v in seen.items() if reason not in (None, "not_supported", "unreadable")),
        }

        def committed(parts: dict, told: dict | None = None) -> Change:
            parts["runs"] = by_root(at, "runs", M.RUNS, root_id, self._finished(at, root_id, run_id, "completed", counts))
            if not same_skips:
                parts["skips"] = by_root(at, "skips", M.SKIPS, root_id, skips)
            return Change(parts, options=grams.OPTIONS, counters={seen_counter(root_id): run_id}, told=told or {})

        if n.keys() <= {"unchanged"} and "files" in at.tables:  # every file is as it was: only the run that saw them moves, in the pointer
            return committed({})
        written = persisted(self._extracted(scan, change, at, n, run_id, held))
        states = {r["content_status"]: r["n"] for r in written.groupBy("content_status").agg(F.count(F.lit(1)).alias("n")).collect()}  # a few states
        counts |= {f"files_{c}": states.get(c, 0) for c in ("indexed", "no_text", "failed")}
        checked()
        touched = files.withColumn("last_seen_run_id", F.lit(run_id).cast("long"))
        same = touched.join(change.filter("change = 'unchanged'").select("normalized_path"), "normalized_path", "left_semi")
        same = same.unionByName(files.join(change.filter("change = 'kept'").select("normalized_path"), "normalized_path", "left_semi"))
        rows = same.unionByName(written.filter("content_status IS NOT NULL").select(*M.FILES.fieldNames()))
        moved = change.filter("change IN ('changed', 'deleted')").select(F.col("old_id").alias("file_id"))
        fresh = written.select("file_id", "root_id", F.explode("units").alias("u")).select("file_id", "root_id", "u.*")
        fresh = fresh.withColumn("unit_id", F.col("file_id") * M.UNIT_STRIDE + F.col("sequence"))
        number = number_of(F.col("file_id")).alias("k")
        numbers = [r["k"] for r in moved.select(number).union(written.select(number)).distinct().collect()]  # a row for FILES_PER_PART files
        checked()
        return committed(units_change(at, root_id, moved, fresh, numbers) | {"files": by_root(at, "files", M.FILES, root_id, rows)}, part_facts(rows, root_id, numbers))

    def _extracted(self, scan: DataFrame, change: DataFrame, at: Snapshot, n: dict, run_id: int, held: list[DataFrame]) -> DataFrame:
        """A row of ``files`` for each new and changed file, with ``units``.  Each file is opened once, on an executor.

        A file that is gone by now gives a row without a state; one that may not be opened is a failed file.
        """
        ids = change.filter("change = 'changed'").select("normalized_path", F.col("old_id").alias("file_id"))
        if "new" in n:
            new = change.filter("change = 'new'").select("normalized_path")
            numbered, kept = maintenance.in_order(new, self._next("file_id", n["new"][0], at, "files"), n["new"][0])
            held.append(kept)
            ids = ids.unionByName(numbered.select("normalized_path", "file_id"))
        dirty = scan.join(ids, "normalized_path").select("file_id", "root_id", "path", "normalized_path", "relative_path", "file_name", "extension", "size_bytes", "created_time", "modified_time")
        return self.parsed(dirty, sum(n.get(c, (0, 0))[0] for c in ("new", "changed")), sum(n.get(c, (0, 0))[1] for c in ("new", "changed")), run_id)

    def parsed(self, dirty: DataFrame, n_files: int, n_bytes: int, run_id: int) -> DataFrame:
        """``dirty`` files (file_id, root_id, path and what the listing tells) -> rows of ``files`` with ``units``."""
        max_mb, docx_headers, schema = self.max_mb, self.docx_headers, StructType([*dirty.schema.fields, *(f for f in M.PARSED if f.name != "path")])
        arrow = to_arrow_schema(schema)

        def read(path: str) -> tuple[bytes | None, M.Outcome | None]:
            try:
                with open(path, "rb") as f:
                    return f.read(), None
            except FileNotFoundError:
                return None, M.Outcome.MISSING
            except PermissionError:
                return None, M.Outcome.DENIED
            except OSError:
                return None, M.Outcome.ERROR

        def run(batches):
            for batch in batches:
                for own in batch.to_pylist():
                    data, problem = read(own["path"])
                    row = own | parse_bytes(own["path"], data, max_mb, problem, docx_headers)
                    for u in row["units"]:
                        u["location"] = {f.name: u["location"].get(f.name) for f in M.LOCATION}
                    yield pa.RecordBatch.from_pylist([row], schema=arrow)

        cores = int(self.spark.sparkContext.defaultParallelism)
        spread = dirty.repartition(max(1, min(n_files, max(cores, n_bytes // TASK_BYTES))))
        rows = spread.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in schema]))
        status = F.when(F.col("outcome") == "ok", "indexed").when(F.col("outcome") == "no_text", "no_text").when(F.col("outcome") != "missing", "failed")
        return rows.select(
            "file_id", "root_id", F.col("path").alias("display_path"), "normalized_path", "relative_path", "file_name", folded(F.col("file_name")).alias("file_name_folded"), "extension",
            mime_category(F.col("extension")).alias("mime_category"), "size_bytes", "created_time", "modified_time", fingerprint(F.col("size_bytes"), F.col("modified_time"), F.lit(M.PARSER_VERSION)).alias("fingerprint"),
            status.alias("content_status"), F.lit(M.PARSER_VERSION).alias("parser_version"), F.size("units").alias("unit_count"),
            F.aggregate("units", F.lit(0).cast("long"), lambda a, u: a + F.length(u["text"])).alias("char_count"), F.current_timestamp().alias("indexed_at"),
            F.lit(run_id).cast("long").alias("last_seen_run_id"), "error_code", "error_message", F.coalesce("truncated", F.lit(False)).alias("truncated"), F.array_join("warnings", ",").alias("warnings"), "units",
        )

    def repair(self) -> list[tuple[str, str, str]]:
        """Mends damaged parts, and returns what was damaged.

        Units are parsed again for the files of their parts alone, and what of these
        files is gone is left out; a damaged gram index is built anew from the units.
        Damage to other tables, which hold what no file tells, is raised.
        """
        damaged = self.store.damaged()
        others = [d for d in damaged if d[0] not in ("units", grams.TABLE) or d[:2] == ("units", WHOLE)]
        if others:
            raise Damaged(others)
        for _, part, _ in (d for d in damaged if d[0] == "units"):
            root, number = part.split("-")

            def build(at: Snapshot, root_id: int = int(root), number: int = int(number), part: str = part) -> Change:
                files = at.read("files").filter((F.col("root_id") == root_id) & (number_of(F.col("file_id")) == number))
                size = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")).first()
                again = self.parsed(files.select("file_id", "root_id", F.col("display_path").alias("path"), "normalized_path", "relative_path", "file_name", "extension", "size_bytes", "created_time", "modified_time"), size["n"], size["bytes"] or 0, 0)
                units = again.select("file_id", "root_id", F.explode("units").alias("u")).select("file_id", "root_id", "u.*").withColumn("unit_id", F.col("file_id") * M.UNIT_STRIDE + F.col("sequence"))
                return Change({"units": (units.select(*M.UNITS.fieldNames()).withColumn("part", F.lit(part)), "part", [part])}, told={"units": {part: {k: v for k, v in at.tables["units"][part].items() if k == "files"}}})

            self.store.update(build)
        if any(d[0] == grams.TABLE for d in damaged):
            grams.rebuilt(self.store)
        return damaged

    def _without(self, at: Snapshot, root_id: int) -> dict:
        """The parts of a change that takes a root's files, units and skips out."""
        nothing = lambda schema: self.spark.createDataFrame([], schema)
        units = units_change(at, root_id, nothing("file_id long"), nothing(M.UNITS), [], rebuild=True) if "units" in at.tables else {}
        return units | {name: by_root(at, name, schema, root_id, nothing(schema)) for name, schema in (("files", M.FILES), ("skips", M.SKIPS)) if name in at.tables}

    def clear_content(self, root: str) -> None:
        """The root's files and units go; the root and its runs stay."""

        def build(at: Snapshot) -> Change:
            root_id, roots, _ = self.root_id(root, at)
            return Change(self._without(at, root_id), {"roots": roots})

        self.store.update(build)

    def delete_root(self, root: str) -> None:
        def build(at: Snapshot) -> Change:
            root_id, roots, _ = self.root_id(root, at)
            runs = {"runs": by_root(at, "runs", M.RUNS, root_id, self.spark.createDataFrame([], M.RUNS))} if "runs" in at.tables else {}
            return Change(self._without(at, root_id) | runs, {"roots": roots.filter(F.col("root_id") != root_id)})

        self.store.update(build)
