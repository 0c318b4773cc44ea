"""Recursive file listing with ordered skip reasons, and root validation."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import model as M
from quarry.functions.text import display_path_str, extension_of, is_within, normalized_path_str

# Names and extensions that are never read.
EXCLUDED_DIRECTORIES = (
    "$recycle.bin", "system volume information", "$windows.~bt", "$windows.~ws", "recovery", "config.msi",
    "node_modules", "__pycache__", ".git", ".svn", ".hg",
)
DRIVE_ROOT_DIRECTORIES = (
    "windows", "program files", "program files (x86)", "programdata", "perflogs", "msocache", "$recycle.bin", "system volume information",
)
EXECUTABLE_EXTENSIONS = (
    ".exe", ".dll", ".sys", ".msi", ".com", ".scr", ".cpl", ".ocx", ".drv",
    ".bat", ".cmd", ".ps1", ".psm1", ".vbs", ".vbe", ".js", ".jse", ".wsf",
    ".wsh", ".hta", ".jar", ".msc", ".pif", ".reg", ".lnk", ".url", ".scf",
    ".docm", ".xlsm", ".xltm", ".dotm", ".pptm",
)
TEMP_PREFIXES = ("~$", ".~lock.")

LISTING_DDL = "path string, file_name string, size_bytes long, created_time double, modified_time double, hidden boolean, system boolean, is_link boolean"
ROWS_DDL = LISTING_DDL + ", problem string"


#: Kinds of drives that are no roots, and their verdicts.
_DRIVES = {"remote": "remote", "cdrom": "cdrom", "unknown": "unknown_drive"}


def validate_root(raw: str, *, require_directory: bool = True, drive_kind: Callable[[str], str] | None = None) -> str:
    """A verdict, decided on the string before the file system is touched; ``ok`` is good.

    ``drive_kind``: what the system calls the drive of a letter (fixed, removable, remote, cdrom, unknown).
    """
    text = raw.strip()
    if not text:
        return "empty"
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", text):
        return "url"
    if text.startswith(("\\\\.\\", "\\\\?\\GLOBALROOT")):
        return "device"
    if text.startswith("\\\\") and not text.startswith("\\\\?\\"):
        return "network"
    drive = re.match(r"(?:\\\\\?\\)?([A-Za-z]):", text)
    if not (text.startswith("/") if os.name == "posix" and drive_kind is None else drive):
        return "no_drive"
    if drive_kind is not None and (kind := drive_kind(drive[1].upper())) in _DRIVES:
        return _DRIVES[kind]
    if not os.path.exists(text):
        return "not_found"
    return "ok" if os.path.isdir(text) or not require_directory else "not_a_directory"


class Cancelled(Exception):
    """A run was asked to stop."""


def _kind(entry: os.DirEntry) -> str:
    if entry.is_symlink():
        return "link"
    return "folder" if entry.is_dir(follow_symlinks=False) else "file" if entry.is_file(follow_symlinks=False) else "other"


class _Tree:
    """How one folder is looked at; what it holds is not followed."""

    def __init__(self, root: str, hidden: bool = False, exclude: tuple[str, ...] = ()):
        self.root, self.hidden = root, hidden
        self.at_top = os.path.dirname(root.rstrip("/")) in ("", "/")
        self.own = {os.path.realpath(x) for x in exclude}

    def visit(self, folder: str) -> Iterator[tuple[str, object]]:
        """("file", row of LISTING_DDL), ("folder", path) and ("unreadable", path), as the system gives them.

        One stat per entry, links never followed.  Entries that vanish meanwhile are left out.
        """
        try:
            with os.scandir(folder) as found:
                for e in found:
                    yield from self._entry(folder, e)
        except FileNotFoundError:
            if folder == self.root:
                yield "unreadable", folder  # a root that is gone tells nothing about its files
        except OSError:
            yield "unreadable", folder

    def _entry(self, folder: str, e: os.DirEntry) -> Iterator[tuple[str, object]]:
        try:
            kind, low = _kind(e), e.name.lower()
            if kind == "folder":
                top = self.at_top and folder == self.root and low in DRIVE_ROOT_DIRECTORIES
                if not (low in EXCLUDED_DIRECTORIES or top or low.startswith(".") and not self.hidden or os.path.realpath(e.path) in self.own):
                    yield "folder", e.path
            elif kind != "other":
                st = e.stat(follow_symlinks=False)
                yield "file", (e.path, e.name, st.st_size, st.st_ctime, st.st_mtime, e.name.startswith("."), False, kind == "link")
        except FileNotFoundError:
            return
        except OSError:
            yield "unreadable", e.path


def walk(root: str, hidden: bool = False, unreadable: list[str] | None = None, exclude: tuple[str, ...] = (), cancelled: Callable[[], bool] = lambda: False) -> Iterator[tuple]:
    """The files of a tree, in this process.

    Folders and files that can't be read are left out and added to ``unreadable``.
    ``exclude``: further folders (the program's own data).  Raises Cancelled between entries.
    """
    tree, stack, closed = _Tree(root, hidden, exclude), [root], [] if unreadable is None else unreadable
    while stack:
        for kind, what in tree.visit(stack.pop()):
            if cancelled():
                raise Cancelled
            if kind == "file":
                yield what
            else:
                (stack if kind == "folder" else closed).append(what)


#: Entries of a tree that are looked at before executors are asked: a small tree needs no job.
HEAD_ENTRIES = 4096
#: Entries after which a task gives the folders that it still has back, to be dealt anew.
TASK_ENTRIES = 50_000
#: Open folders for each task of a round.
TASK_FOLDERS = 16
_ROWS = 2048


def _row(kind: str, what) -> tuple:
    """A row of ROWS_DDL."""
    return (*what, None) if kind == "file" else (what, *[None] * 7, kind)


def _staging(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/listing-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return "file://" + tempfile.mkdtemp(prefix="quarry-listing-")


def _round(tree: _Tree, entries: int):
    """mapInArrow: folders -> rows of ``list_files``, and the folders left over after ``entries`` entries (problem "open")."""
    fields = [f.strip().split(" ")[0] for f in ROWS_DDL.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[f.strip().split(" ")[1]]) for n, f in zip(fields, ROWS_DDL.split(","))])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        stack, rows, seen = [], [], 0
        for b in batches:
            stack += b.column(0).to_pylist()
        while stack and seen < entries:
            for kind, what in tree.visit(stack.pop()):
                seen += 1
                if kind == "folder":
                    stack.append(what)
                else:
                    rows.append(_row(kind, what))
                if len(rows) >= _ROWS:
                    yield batch(rows)
                    rows = []
        rows += [_row("open", folder) for folder in stack]
        if rows:
            yield batch(rows)

    return run


def list_files(spark: SparkSession, root: str, hidden: bool = False, exclude: tuple[str, ...] = (), cancelled: Callable[[], bool] = lambda: False, head: int = HEAD_ENTRIES) -> DataFrame:
    """The files of a tree, a row each, and a row with problem "unreadable" for what can't be read.

    Beyond the first ``head`` entries the executors look: round by round, each task
    walks down from some folders, and gives back what it has not come to when it has
    seen TASK_ENTRIES entries, so that deep and wide trees spread over all tasks.  The
    driver holds ``head`` rows and no more, and counts the open folders of a round.
    Rounds are written to the shared folder; ``forget`` deletes them.
    """
    tree, stack, rows, seen = _Tree(root, hidden, exclude), [root], [], 0
    while stack and seen < head:
        folder, own, below = stack.pop(), [], []
        for kind, what in tree.visit(folder):
            if cancelled():
                raise Cancelled
            seen += 1
            if kind == "folder":
                below.append(what)
            else:
                own.append(_row(kind, what))
            if seen >= head:  # too large a folder: an executor begins it anew
                own, below = [], [folder]
                break
        rows += own
        stack += below
    found = spark.createDataFrame(rows, ROWS_DDL)
    if not stack:
        return found
    staging, frontier, n, made = _staging(spark), spark.createDataFrame([(x,) for x in stack], "path string"), len(stack), []
    while n:
        if cancelled():
            raise Cancelled
        tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, n // TASK_FOLDERS)))
        made.append(f"{staging}/{len(made)}")
        frontier.repartition(tasks).mapInArrow(_round(tree, TASK_ENTRIES), ROWS_DDL).write.parquet(made[-1])
        frontier = spark.read.schema(ROWS_DDL).parquet(made[-1]).filter("problem = 'open'").select("path")
        n = frontier.count()
    found = found.unionByName(spark.read.schema(ROWS_DDL).parquet(*made).filter("problem IS NULL OR problem <> 'open'"))
    found._staging = staging
    return found


def forget(listing: DataFrame) -> None:
    """Deletes what ``list_files`` has written, when nothing reads it any more."""
    if staging := getattr(listing, "_staging", None):
        spark = listing.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(staging)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def list_store(spark: SparkSession, path: str) -> DataFrame:
    """Any store that Spark reads: paths, sizes and times only; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("file_name"), F.col("length").alias("size_bytes"), F.lit(None).cast("double").alias("created_time"), F.col("modificationTime").cast("double").alias("modified_time"), name.startswith(".").alias("hidden"), F.lit(False).alias("system"), F.lit(False).alias("is_link"), F.lit(None).cast("string").alias("problem"))


# Attribute bits of files that are temporary, or whose content is not on this machine (offline, recall on open, recall on access).
TEMPORARY_BIT, PLACEHOLDER_BITS = 0x100, 0x1000 | 0x40000 | 0x400000


def skip_reason(extensions: tuple[str, ...] = M.CORE_EXTENSIONS, max_mb: int = M.MAX_FILE_MB, allow_hidden: bool = False, attributes: str | None = None, path: str | None = None, root: str | None = None, own_data: str | None = None) -> Column:
    """The first reason that applies, in this order; null for a candidate.

    ``attributes``: a column of attribute bits; ``path``: a column of normalized
    paths, to be within ``root`` and not within ``own_data``.
    """
    name, ext = F.col("file_name"), extension_of(F.col("file_name"))
    bits = F.col(attributes) if attributes else F.lit(0)
    outside = ~is_within(F.col(path), F.lit(root)) if path and root else F.lit(False)
    inside = is_within(F.col(path), F.lit(own_data)) if path and own_data else F.lit(False)
    temp = F.lit(False)
    for p in TEMP_PREFIXES:
        temp = temp | name.startswith(p)
    return (
        F.when(temp, "temporary").when(ext.isin(*EXECUTABLE_EXTENSIONS), "executable").when(~ext.isin(*extensions), "not_supported")
        .when(F.col("system"), "system").when(F.col("hidden") & ~F.lit(allow_hidden), "hidden").when(F.col("is_link"), "link")
        .when(bits.bitwiseAND(F.lit(TEMPORARY_BIT)) != 0, "temporary").when(bits.bitwiseAND(F.lit(PLACEHOLDER_BITS)) != 0, "placeholder")
        .when(F.col("size_bytes") == 0, "empty_file").when(F.col("size_bytes") > max_mb * 1024 * 1024, "too_large")
        .when(outside, "outside_root").when(inside, "own_data")
    )


def scanned(listing: DataFrame, root: str, **options) -> DataFrame:
    """The listing with skip_reason and the engine's path columns."""
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.when(F.col("path").startswith(prefix), F.expr(f"substring(path, {len(prefix) + 1})")).otherwise(F.col("path")), "/", r"\\")
    return listing.withColumn("skip_reason", skip_reason(**options)).withColumn("extension", extension_of(F.col("file_name"))).withColumn("relative_path", rel)


__all__ = ["Cancelled", "display_path_str", "forget", "list_files", "list_store", "normalized_path_str", "scanned", "skip_reason", "validate_root", "walk"]
