"""Runs that end early, files that can't be opened, snapshots under a crash, incremental parts."""

import os

import pytest
from pyspark.sql import functions as F

from quarry import model as M
from quarry.operators import maintenance
from quarry.operators.indexing import Indexer
from quarry.operators.search import search_store
from quarry.sources import listing
from quarry.sources import store as store_module
from quarry.sources.parsers import parse_bytes
from quarry.sources.store import Change, Conflict, SnapshotStore


def _tree(root, names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(f"words of {name}".encode())


def _names(store):
    return sorted(r["file_name"] for r in store.read("files").collect())


def test_cancelled_and_failed_runs_change_nothing(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "docs", SnapshotStore(spark, str(tmp_path / "store"))
    _tree(root, ["a.txt", "b.txt"])
    index = Indexer(spark, store)
    assert index.run(str(root))["status"] == "completed"
    os.remove(root / "b.txt")
    _tree(root, ["c.txt"])
    assert index.run(str(root), cancelled=lambda: True)["status"] == "cancelled"
    asked = iter([False] * 4)
    assert index.run(str(root), cancelled=lambda: next(asked, True))["status"] == "cancelled"
    assert _names(store) == ["a.txt", "b.txt"]

    def broken(*args):
        raise OSError("the disk is full")

    with monkeypatch.context() as m:
        m.setattr(maintenance, "classify", broken)
        with pytest.raises(OSError):
            index.run(str(root))
    assert _names(store) == ["a.txt", "b.txt"]
    assert index.run(str(root))["files_deleted"] == 1 and _names(store) == ["a.txt", "c.txt"]
    statuses = [r["status"] for r in store.read("runs").orderBy("run_id").collect()]
    assert statuses == ["completed", "cancelled", "cancelled", "failed", "completed"]


def test_a_run_that_never_ended_is_abandoned(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "docs", SnapshotStore(spark, str(tmp_path / "store"))
    _tree(root, ["a.txt"])
    index = Indexer(spark, store)
    with monkeypatch.context() as m:
        m.setattr(Indexer, "_update", lambda *args: (_ for _ in ()).throw(KeyboardInterrupt))
        m.setattr(Indexer, "_finished", lambda *args: store.read("runs"))  # the process dies: nothing is recorded
        with pytest.raises(KeyboardInterrupt):
            index.run(str(root))
    assert store.read("runs").first()["status"] == "running"
    index.run(str(root))
    assert [r["status"] for r in store.read("runs").orderBy("run_id").collect()] == ["abandoned", "completed"]


def test_denied_files_fail_and_vanished_ones_go(spark, tmp_path):
    assert parse_bytes("a.txt", None, problem=M.Outcome.DENIED)["outcome"] == "denied"
    root, store = tmp_path / "docs", SnapshotStore(spark, str(tmp_path / "store"))
    _tree(root, ["a.txt", "b.txt"])
    index = Indexer(spark, store)
    index.run(str(root))
    _tree(root, ["a.txt"])
    os.utime(root / "a.txt", (1, 1))
    seen = listing.list_files(spark, str(root))
    os.remove(root / "a.txt")
    os.mkdir(root / "a.txt")  # it is there, but can't be opened as a file
    original = listing.list_files
    listing.list_files = lambda *args, **kw: seen
    try:
        row = index.run(str(root))
    finally:
        listing.list_files = original
    assert (row["files_failed"], row["files_deleted"]) == (1, 0)
    assert {r["file_name"]: (r["content_status"], r["error_code"]) for r in store.read("files").collect()}["a.txt"][0] == "failed"


class _Entry:
    """A directory entry whose file is gone, or whose attributes may not be read."""

    def __init__(self, entry, error):
        self.entry, self.error, self.name, self.path = entry, error, entry.name, entry.path

    def __getattr__(self, name):
        return getattr(self.entry, name)

    def stat(self, **kw):
        raise self.error


def test_walk_survives_entries_that_vanish(tmp_path, monkeypatch):
    _tree(tmp_path, ["a.txt", "b.txt", "c.txt", "own/d.txt"])
    scandir = os.scandir
    errors = {"a.txt": FileNotFoundError(), "b.txt": PermissionError()}

    class scanned(list):
        __enter__, __exit__ = (lambda self: self), (lambda self, *a: None)

    monkeypatch.setattr(os, "scandir", lambda p: scanned(_Entry(e, errors[e.name]) if e.name in errors else e for e in scandir(p)))
    closed = []
    assert [x[1] for x in listing.walk(str(tmp_path), unreadable=closed, exclude=(str(tmp_path / "own"),))] == ["c.txt"]
    assert closed == [str(tmp_path / "b.txt")]
    with pytest.raises(listing.Cancelled):
        list(listing.walk(str(tmp_path), cancelled=lambda: True))
    closed = []
    assert list(listing.walk(str(tmp_path / "gone"), unreadable=closed)) == [] and closed == [str(tmp_path / "gone")]


def test_unreadable_files_stay(spark):
    files = spark.createDataFrame([(1, "d:\\a\\x.txt"), (2, "d:\\a\\y.txt")], "file_id long, normalized_path string")
    folders = spark.createDataFrame([("d:\\a\\x.txt",)], "folder string")
    assert [r["file_id"] for r in maintenance.under(files, folders).collect()] == [1]


def test_skip_reasons_in_order(spark):
    rows = [("a.txt", 0x100, 1, "d:\\r\\a.txt"), ("b.txt", 0x400000, 1, "d:\\r\\b.txt"), ("c.txt", 0, 1, "d:\\s\\c.txt"), ("d.txt", 0, 1, "d:\\r\\own\\d.txt"), ("e.txt", 0x20, 1, "d:\\r\\e.txt"), ("~$f.txt", 0x1000, 0, "x")]
    df = spark.createDataFrame(rows, "file_name string, bits int, size_bytes long, path string")
    df = df.select("*", *(F.lit(False).alias(n) for n in ("hidden", "system", "is_link")))
    reason = listing.skip_reason(attributes="bits", path="path", root="d:\\r", own_data="d:\\r\\own")
    assert [r[0] for r in df.select(reason).collect()] == ["temporary", "placeholder", "outside_root", "own_data", None, "temporary"]


def test_a_crash_before_the_pointer_moves_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.publish({"t": spark.range(5)})
    with monkeypatch.context() as m:
        m.setattr(SnapshotStore, "_point", lambda *args: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            store.publish({"t": spark.range(9)})
    assert store.read("t").count() == 5
    reader = store.read("t")
    store.publish({"t": spark.range(7)})
    assert reader.count() == 5 and store.read("t").count() == 7  # an open reader keeps its version
    stale = store.snapshot()
    store.publish({"t": spark.range(8)})
    with pytest.raises(Conflict):
        store.commit(Change(whole={"t": spark.range(9)}), stale)
    assert store.read("t").count() == 8


def test_only_changed_parts_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FILES_PER_PART", 2)
    root, store = tmp_path / "docs", SnapshotStore(spark, str(tmp_path / "store"))
    _tree(root, [f"f{i}.txt" for i in range(7)])
    index = Indexer(spark, store)
    index.run(str(root))
    before = store.current()["tables"]["units"]
    assert len(before) > 2
    index.run(str(root))
    assert store.current()["tables"]["units"] == before  # nothing changed: nothing of it is written
    changed = {r["file_name"]: r["file_id"] for r in store.read("files").collect()}["f3.txt"]
    (root / "f3.txt").write_bytes(b"other words now")
    index.run(str(root))
    after = store.current()["tables"]["units"]
    assert [p for p in before if after.get(p) != before[p]] == [f"1-{changed // 2}"]
    assert store.read("units").count() == 7 and store.read("units").filter("text LIKE 'other%'").count() == 1
    store.compact("units", ["file_id"], 1)
    os.remove(root / "f5.txt")
    assert index.run(str(root))["files_deleted"] == 1 and store.read("units").count() == 6
    index.clear_content(str(root))
    assert store.read("files").count() == 0 and store.read("units").count() == 0 and store.read("roots").count() == 1
    assert index.run(str(root))["files_new"] == 6 and store.read("units").count() == 6
    index.delete_root(str(root))
    assert store.read("units").count() == 0 and store.read("roots").count() == 0


def test_unit_ids_of_long_files_do_not_meet(spark):
    df = spark.createDataFrame([(1, M.MAX_LINES), (2, 1), (3, (1 << 31) - 1), (4, 1)], "file_id long, sequence long")
    assert df.select((F.col("file_id") * M.UNIT_STRIDE + F.col("sequence")).alias("u")).distinct().count() == 4
    assert M.MAX_LINES < M.UNIT_STRIDE and M.MAX_CELLS < M.UNIT_STRIDE


def test_an_empty_root_and_a_rebuild(spark, tmp_path):
    root, store = tmp_path / "docs", SnapshotStore(spark, str(tmp_path / "store"))
    root.mkdir()
    index = Indexer(spark, store)
    assert index.run(str(root))["files_discovered"] == 0
    assert search_store(store, M.Request("words")).total == search_store(store, M.Request("words"), indexed=True).total == 0
    _tree(root, ["a.txt", "b.txt"])
    index.run(str(root))
    ids = {r["file_name"]: r["file_id"] for r in store.read("files").collect()}
    row = index.run(str(root), rebuild=True)
    assert (row["mode"], row["files_discovered"], row["files_indexed"], row["files_deleted"]) == ("rebuild", 2, 2, 0)
    assert {r["file_name"]: r["file_id"] for r in store.read("files").collect()} == ids  # a file keeps its id
    assert store.read("units").count() == 2 and search_store(store, M.Request("words", scope=M.Scope.CONTENT), indexed=True).total == 2
    os.remove(root / "a.txt")
    os.remove(root / "b.txt")
    assert index.run(str(root))["files_deleted"] == 2 and store.read("units").count() == 0
