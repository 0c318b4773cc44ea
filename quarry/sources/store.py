"""Snapshot store: Parquet version folders and numbered pointers.

A pointer is a small file that names each table's parts: a folder each, with the
number of its rows and a checksum that does not depend on their order.  Readers take
the last pointer, so they see a whole snapshot at any time, and a crash before a
pointer stands leaves the old one.  Paths go through Hadoop's file system, so any
shared store with an atomic rename works.

Commits are optimistic.  A writer reads from a ``Snapshot``, writes folders of its
own, and claims the next free number.  If others were first, it looks whether they
touched what it replaces or read: if not, its change is laid over theirs and it
claims the next number; if they did, ``commit`` raises Conflict, and ``update`` reads
and merges again.  A number can be claimed once: a pointer is written beside and
linked or renamed to its name, which fails if that is there.

Folders are deleted by ``expire`` alone.  It keeps what any pointer names, those of
savepoints and quarantined ones too, and what a running writer has not pointed to
yet: a writer leaves a mark beside its folder, which counts for LEASE seconds.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry import model as M

_POINTER, _SAVED, _BAD, _WRITING = "_snapshot-", "_saved-", "_bad-", "_writing-"
#: Pointers that stay beside the last one, for readers that have just listed them.
_KEPT_POINTERS = 3
_PART = "_part"
#: The one part of a table that was written whole.
WHOLE = ""
#: Seconds for which an unfinished writer's folder is safe from ``expire``.
LEASE = 24 * 3600
#: How often ``update`` merges anew after a conflict.
ATTEMPTS = 8
#: Tables of one commit that are written at a time.
WRITERS = 4

#: Steps from a schema version to the next: table name and DataFrame -> DataFrame.
MIGRATIONS: dict[int, Callable[[str, DataFrame], DataFrame]] = {}


#: Files with neighbouring ids whose units are written together.
FILES_PER_PART = 10_000


def number_of(file_id: Column) -> Column:
    """The number of a file's part among its root's."""
    return F.floor(file_id / FILES_PER_PART)


def part_of(root_id: Column, file_id: Column) -> Column:
    return F.concat_ws("-", root_id.cast("string"), number_of(file_id).cast("string"))


def row_sum(*columns: str) -> Column:
    """An aggregate that does not depend on the rows' order: the sum of their hashes."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


class SchemaTooNew(RuntimeError):
    pass


class Conflict(RuntimeError):
    """Another writer has meanwhile changed what this one replaces or has read."""


class Damaged(RuntimeError):
    """``parts``: (table, part, reason) of each part that is not as it was written."""

    def __init__(self, parts: list[tuple[str, str, str]]):
        super().__init__(", ".join(f"{t}/{p or 'whole'}: {why}" for t, p, why in parts))
        self.parts = parts


@dataclass
class Change:
    """What one commit does.

    ``parts``: table -> (rows, column that names a row's part, the parts that the rows
    replace); parts named without rows are gone afterwards, all others stay.
    ``whole``: tables that are replaced whole.  ``reads``: tables that may not have
    changed since the snapshot, beside those that are replaced.  ``options``: of a
    table's writer.  ``counters``: numbers that the pointer itself holds.  ``told``: what
    the pointer says of a table's parts besides, by part.
    """

    parts: dict[str, tuple[DataFrame, str, Iterable[str]]] = field(default_factory=dict)
    whole: dict[str, DataFrame] = field(default_factory=dict)
    partition_by: dict[str, list[str]] = field(default_factory=dict)
    reads: frozenset[str] = frozenset()
    options: dict[str, dict[str, str]] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    told: dict[str, dict[str, dict]] = field(default_factory=dict)


def _differ(told: dict, entry: dict) -> bool:
    """Are rows and checksum not what a part's entry says?"""
    return any(entry.get(k) != v for k, v in told.items())


class Snapshot:
    """One version of all tables; what is read from it stays as it is until ``expire``."""

    def __init__(self, store: SnapshotStore, pointer: dict | None):
        self._store, self.pointer = store, pointer
        self.tables: dict[str, dict[str, dict]] = pointer["tables"] if pointer else {}
        self.schemas: dict[str, dict] = pointer["schemas"] if pointer else {}
        self.counters: dict[str, int] = pointer.get("counters", {}) if pointer else {}
        self.number: int = pointer["number"] if pointer else 0

    def read(self, table: str, parts: Iterable[str] | None = None) -> DataFrame | None:
        """The table, or some of its parts; None where there is no such table."""
        if table not in self.tables:
            return None
        schema = StructType.fromJson(self.schemas[table])  # an empty table has no file to tell it
        wanted = None if parts is None else set(parts)
        paths = [self._store.path(p["at"]) for n, p in self.tables[table].items() if wanted is None or n in wanted]
        spark = self._store.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def parts(self, table: str) -> list[str]:
        return list(self.tables.get(table, {}))

    def table(self, name: str, schema: StructType) -> DataFrame:
        """The columns of ``schema``, of an empty table where there is none; columns that an older table lacks are null."""
        found = self.read(name)
        if found is None:
            return self._store.spark.createDataFrame([], schema)
        return found.select(*((F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # --- small files -----------------------------------------------------------------

    def _names(self, prefix: str) -> list[str]:
        at = self._path(self.root)
        if not self._fs.exists(at):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(at)) if n.startswith(prefix))

    def _json(self, name: str) -> dict:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        out = self._fs.create(self._path(self.path(name)), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _claim(self, temp: str, name: str) -> bool:
        """Gives a small file its name; False if the name is taken."""
        source, target = self._path(self.path(temp)), self._path(self.path(name))
        if self._fs.getUri().getScheme() == "file":  # a local rename would replace what is there; a link does not
            at = [str(p.toUri().getPath()) for p in (source, target)]
            try:
                os.link(*at)
            except FileExistsError:
                return False
            finally:
                self._fs.delete(source, False)
            return True
        if self._fs.exists(target) or not self._fs.rename(source, target):
            self._fs.delete(source, False)
            return False
        return True

    # --- reading -----------------------------------------------------------------------

    def current(self) -> dict | None:
        """The last pointer: number, version, schema_version, tables, schemas, counters; None for an empty store."""
        names = self._names(_POINTER)
        if not names:
            return None
        found = self._json(names[-1])
        if found["schema_version"] > M.SCHEMA_VERSION:
            raise SchemaTooNew(f"schema {found['schema_version']} is newer than {M.SCHEMA_VERSION}")
        return found | {"number": int(names[-1].removeprefix(_POINTER))}

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.current())

    def read(self, table: str, parts: Iterable[str] | None = None) -> DataFrame | None:
        """The table, or some of its parts, as of now."""
        return self.snapshot().read(table, parts)

    def parts(self, table: str) -> list[str]:
        return self.snapshot().parts(table)

    # --- writing -----------------------------------------------------------------------

    def publish(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> str:
        """Writes the tables whole as a new version; tables not given stay as they are."""
        return self.commit(Change(whole=tables, partition_by=partition_by or {}), self.snapshot())

    def replace(self, parts: dict[str, tuple[DataFrame, str, Iterable[str]]], whole: dict[str, DataFrame] | None = None) -> str:
        """Writes some parts of tables, and tables whole, as ``Change`` says."""
        return self.commit(Change(parts, whole or {}), self.snapshot())

    def update(self, build: Callable[[Snapshot], Change | None], attempts: int = ATTEMPTS) -> str | None:
        """Commits what ``build`` makes of a snapshot; after a conflict it is asked again, with the new one."""
        for left in range(attempts - 1, -1, -1):
            base = self.snapshot()
            change = build(base)
            if change is None:
                return None
            try:
                return self.commit(change, base)
            except Conflict:
                if not left:
                    raise
        raise ValueError("attempts must be positive")

    def commit(self, change: Change, base: Snapshot) -> str:
        """Writes a change that was made from ``base`` and points to it; Conflict if others touched the same meanwhile."""
        change = replace(change, parts={t: (df, column, tuple(named)) for t, (df, column, named) in change.parts.items()})
        version = uuid.uuid4().hex
        self._put(_WRITING + version, {"began": time.time()})
        try:
            made, schemas = self._written(change, version)
            return self._point(version, change, base, made, schemas)
        finally:
            self._fs.delete(self._path(self.path(_WRITING + version)), False)

    def _written(self, change: Change, version: str) -> tuple[dict[str, dict[str, dict]], dict[str, dict]]:
        """The folders that a change writes, by table and part, with rows and checksum; and the schemas."""
        def part_folders(name: str) -> dict[str, dict]:
            df, column, named = change.parts[name]
            at = f"{version}/{name}"
            if not named:
                return {}
            df.withColumnRenamed(column, _PART).write.options(**change.options.get(name, {})).partitionBy(_PART).parquet(self.path(at))
            found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path(at)))]
            return {n.removeprefix(f"{_PART}="): {"at": f"{at}/{n}"} for n in found if n.startswith(f"{_PART}=")}

        def whole_folder(name: str) -> dict[str, dict]:
            writer = change.whole[name].write.options(**change.options.get(name, {}))
            if by := change.partition_by.get(name):
                writer = writer.partitionBy(*by)
            writer.parquet(self.path(f"{version}/{name}"))
            return {WHOLE: {"at": f"{version}/{name}"}}

        # several tables' jobs run side by side: one table alone seldom keeps all executors busy
        tasks = {name: part_folders for name in change.parts} | {name: whole_folder for name in change.whole}
        with ThreadPoolExecutor(WRITERS) as pool:
            made = dict(zip(tasks, pool.map(inheritable_thread_target(self.spark)(lambda name: tasks[name](name)), tasks)))
        schemas = {name: df.drop(column).schema.jsonValue() for name, (df, column, _) in change.parts.items()} | {name: df.schema.jsonValue() for name, df in change.whole.items()}
        for (table, part), told in self._sums(made, schemas).items():
            made[table][part] |= told | change.told.get(table, {}).get(part, {})
        return made, schemas

    def _sums(self, tables: dict[str, dict[str, dict]], schemas: dict[str, dict]) -> dict[tuple[str, str], dict]:
        """(table, part) -> rows and checksum, all in one job that reads the folders."""
        found = []
        for table, parts in tables.items():
            schema = StructType.fromJson(schemas[table])
            for kind in {len(p["at"].split("/")) for p in parts.values()}:  # a folder of a part, or of a whole table
                own = {name: p["at"] for name, p in parts.items() if len(p["at"].split("/")) == kind}
                df = self.spark.read.schema(schema).parquet(*(self.path(at) for at in own.values()))
                key = F.element_at(F.split(F.element_at(F.split(F.col("_metadata.file_path"), f"/{table}/"), -1), "/"), 1)
                label = F.when(key.startswith(f"{_PART}="), F.substring_index(key, "=", -1)).otherwise(WHOLE) if kind == 3 else F.lit(WHOLE)
                found.append(df.select(F.lit(table).alias("t"), label.alias("p"), F.xxhash64(*schema.fieldNames()).alias("h")))
        if not found:
            return {}
        sums = reduce(DataFrame.unionByName, found).groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
        told = {(r["t"], r["p"]): {"rows": r["n"], "sum": str(int(r["h"]))} for r in sums.collect()}  # a row for each part
        return {(t, p): told.get((t, p), {"rows": 0, "sum": "0"}) for t, parts in tables.items() for p in parts}

    def _touched(self, change: Change, base: Snapshot, now: Snapshot) -> bool:
        """Has anything that the change replaces or has read changed between the two?"""
        if any(base.tables.get(t) != now.tables.get(t) for t in {*change.whole, *change.reads}):
            return True
        for table, (_, _, named) in change.parts.items():
            a, b = base.tables.get(table, {}), now.tables.get(table, {})
            if any(a.get(p) != b.get(p) for p in {WHOLE, *named}):
                return True
        return False

    def _next(self, now: Snapshot, version: str, tables: dict, schemas: dict, counters: dict[str, int]) -> bool:
        """Claims the number after ``now`` for a pointer; False if somebody has it."""
        pointer = {"version": version, "schema_version": M.SCHEMA_VERSION, "tables": tables, "schemas": schemas, "counters": counters}
        temp = f".{uuid.uuid4().hex}"
        self._put(temp, pointer)
        return self._claim(temp, f"{_POINTER}{now.number + 1:012d}")

    def _point(self, version: str, change: Change, base: Snapshot, made: dict, schemas: dict) -> str:
        while True:
            now = self.snapshot()
            if now.number != base.number and self._touched(change, base, now):
                raise Conflict(f"{base.number} -> {now.number}")
            stays = {t: {p: at for p, at in now.tables.get(t, {}).items() if t in change.parts and p not in {WHOLE, *change.parts[t][2]}} for t in made}
            if self._next(now, version, now.tables | {t: stays[t] | parts for t, parts in made.items()}, now.schemas | schemas, now.counters | change.counters):
                break
        for old in self._names(_POINTER)[: -1 - _KEPT_POINTERS]:
            self._fs.delete(self._path(self.path(old)), False)
        return version

    def reserve(self, counter: str, n: int, after: int = 0) -> int:
        """``n`` numbers above ``after`` that no other writer gets: those that follow the returned one."""
        while True:
            now = self.snapshot()
            last = max(now.counters.get(counter, 0), after)
            if self._next(now, uuid.uuid4().hex, now.tables, now.schemas, now.counters | {counter: last + n}):
                return last

    # --- savepoints and maintenance ------------------------------------------------------

    def savepoint(self, name: str) -> None:
        """Keeps the present version under a name, whatever is committed later."""
        at = self.current()
        if at is None:
            raise ValueError("the store is empty")
        self._put(_SAVED + name, at)

    def savepoints(self) -> list[str]:
        return [n.removeprefix(_SAVED) for n in self._names(_SAVED)]

    def release(self, name: str) -> None:
        self._fs.delete(self._path(self.path(_SAVED + name)), False)

    def restore(self, name: str) -> str:
        """A new version with the tables of a savepoint."""
        saved, version = self._json(_SAVED + name), uuid.uuid4().hex
        while True:
            now = self.snapshot()  # numbers that were given away stay so
            if self._next(now, version, saved["tables"], saved["schemas"], saved["counters"] | now.counters):
                return version

    def migrate(self) -> int:
        """Rewrites the tables step by step until they have the current schema version."""
        base = self.snapshot()
        if base.pointer is None:
            return M.SCHEMA_VERSION
        version, tables = base.pointer["schema_version"], {t: base.read(t) for t in base.tables}
        if version == M.SCHEMA_VERSION:
            return version
        for step in range(version, M.SCHEMA_VERSION):
            if step not in MIGRATIONS:
                raise RuntimeError(f"no migration from schema {step}")
            tables = {t: MIGRATIONS[step](t, df) for t, df in tables.items()}
        self.commit(Change(whole=tables), base)
        return M.SCHEMA_VERSION

    def damaged(self, at: Snapshot | None = None) -> list[tuple[str, str, str]]:
        """(table, part, reason) of the parts whose rows or checksum are not what was written, or that can't be read."""
        at = at or self.snapshot()
        try:
            sums = self._sums(at.tables, at.schemas)
            return [(t, p, "changed") for (t, p), told in sums.items() if _differ(told, at.tables[t][p])]
        except (Py4JJavaError, PySparkException):  # some part can't be read: each is tried alone
            bad = []
            for table, parts in at.tables.items():
                for part, entry in parts.items():
                    try:
                        ((_, told),) = self._sums({table: {part: entry}}, at.schemas).items()
                        if _differ(told, entry):
                            bad.append((table, part, "changed"))
                    except (Py4JJavaError, PySparkException):
                        bad.append((table, part, "unreadable"))
            return bad

    def verify(self) -> dict[str, int]:
        """Reads every row of every table and compares with what was written; rows per table.  Raises Damaged."""
        at = self.snapshot()
        if bad := self.damaged(at):
            raise Damaged(bad)
        return {table: sum(p["rows"] for p in parts.values()) for table, parts in at.tables.items()}

    def backup(self, to: str) -> None:
        """Copies the current version's tables into another store."""
        at = self.snapshot()
        SnapshotStore(self.spark, to).publish({t: at.read(t) for t in at.tables})

    def expire(self, lease: float = LEASE) -> list[str]:
        """Deletes version folders that no pointer names and no writer of the last ``lease`` seconds is making."""
        writing = {n.removeprefix(_WRITING): self._json(n)["began"] for n in self._names(_WRITING)}
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory()]
        # pointers are read after the folders were listed: a folder that is not in the list is never deleted
        named = [self._json(n) for prefix in (_POINTER, _SAVED, _BAD) for n in self._names(prefix)]
        used = {p["at"].split("/")[0] for pointer in named for parts in pointer["tables"].values() for p in parts.values()}
        now = time.time()
        gone = [n for n in found if n not in used and not (n in writing and now - writing[n] < lease)]
        for name in gone:
            self._fs.delete(self._path(self.path(name)), True)
        for version, began in writing.items():
            if now - began >= lease:
                self._fs.delete(self._path(self.path(_WRITING + version)), False)
        return gone

    def quarantine(self) -> str | None:
        """Renames the pointers so that the store opens empty; the data stay for inspection."""
        mark = f"{_BAD}{uuid.uuid4().hex[:8]}"
        names = self._names(_POINTER)
        for name in names:
            self._fs.rename(self._path(self.path(name)), self._path(self.path(f"{mark}-{name}")))
        return mark if names else None

    def compact(self, table: str, keys: list[str], files: int) -> str:
        """Rewrites a table range-partitioned and sorted by ``keys``."""
        return self.update(lambda at: Change(whole={table: at.read(table).repartitionByRange(files, *keys).sortWithinPartitions(*keys)}))
