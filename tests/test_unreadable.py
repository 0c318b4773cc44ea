"""An indexing run that cannot read a folder."""

import os

from quarry.operators import maintenance
from quarry.operators.indexing import Indexer
from quarry.sources.store import SnapshotStore


def test_unreadable_folder_keeps_files_and_units(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "Docs", SnapshotStore(spark, str(tmp_path / "store"))
    (root / "Sub" / "deep").mkdir(parents=True)
    for name in ("a.txt", "b.txt", "Sub/c.txt", "Sub/deep/d.txt"):
        (root / name).write_bytes(b"some words")
    index, scandir = Indexer(spark, store), os.scandir
    index.run(str(root))

    def closed(path):
        if str(path).endswith("Sub"):
            raise PermissionError(path)
        return scandir(path)

    monkeypatch.setattr(os, "scandir", closed)
    os.remove(root / "b.txt")
    assert index.run(str(root))["files_deleted"] == 1
    assert {r["file_name"] for r in store.read("files").collect()} == {"a.txt", "c.txt", "d.txt"}
    assert store.read("units").select("file_id").distinct().count() == 3


def test_many_unreadable_folders(spark):
    files = spark.createDataFrame([(1, "d:\\f7\\x\\a.txt", 1), (2, "d:\\f70000\\a.txt", 1), (3, "d:\\f7b\\a.txt", 2)], "file_id long, normalized_path string, last_seen_run_id long")
    folders = spark.range(10_500).selectExpr("concat('d:', chr(92), 'f', id) AS folder")
    assert sorted(r["file_id"] for r in maintenance.without_unseen(files, 2, True, folders).collect()) == [1, 3]
