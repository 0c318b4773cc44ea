"""Trees listed on the executors: the same rows as a walk, deep, wide and flat trees, folders that can't be read."""

import os

import pytest

from quarry.operators.indexing import Indexer
from quarry.sources import listing
from quarry.sources.store import SnapshotStore


def tree(root, folders=7, files=9, depth=3):
    """Nested folders with files, excluded and hidden ones, a link, odd names."""
    made = [str(root)]
    for _ in range(depth):
        made = [f"{at}/{n}" for at in made for n in [f"d{i}" for i in range(folders if at == str(root) else 2)]]
        for at in made:
            os.makedirs(at)
            for i in range(files):
                with open(f"{at}/file {i} é.txt", "w") as f:
                    f.write("x" * i)
    for at in (".git", "node_modules", ".hidden", "own"):
        os.makedirs(f"{root}/{at}/sub")
        open(f"{root}/{at}/sub/a.txt", "w").close()
    os.symlink(f"{root}/d0", f"{root}/linked")
    os.symlink(f"{root}/nowhere", f"{root}/d1/broken.txt")


def rows(df):
    return sorted(tuple(r)[:8] for r in df.collect() if r["problem"] is None)


@pytest.mark.parametrize("head,entries,folders", [(0, 50_000, 16), (1, 10, 1), (40, 25, 3), (10_000, 50_000, 16)])
def test_same_rows_as_a_walk(spark, tmp_path, monkeypatch, head, entries, folders):
    tree(tmp_path)
    monkeypatch.setattr(listing, "TASK_ENTRIES", entries)
    monkeypatch.setattr(listing, "TASK_FOLDERS", folders)
    for options in ({}, {"hidden": True}, {"exclude": (str(tmp_path / "own"),)}):
        found = listing.list_files(spark, str(tmp_path), head=head, **options)
        want = sorted(listing.walk(str(tmp_path), **options))
        assert len(want) > 100 and rows(found) == want
        assert found.filter("problem IS NOT NULL").count() == 0
        staging = getattr(found, "_staging", "").removeprefix("file://")
        assert bool(staging) == (head < 10_000)
        listing.forget(found)
        assert not staging or not os.path.exists(staging)


def test_a_large_folder_is_no_list_on_the_driver(spark, tmp_path):
    """Beyond ``head`` entries of one folder an executor begins it anew; nothing is there twice."""
    for i in range(3000):
        open(tmp_path / f"f{i}.txt", "w").close()
    os.mkdir(tmp_path / "sub")
    open(tmp_path / "sub" / "x.txt", "w").close()
    found = listing.list_files(spark, str(tmp_path), head=100)
    assert len(rows(found)) == 3001 and rows(found) == sorted(listing.walk(str(tmp_path)))


def deep(at):
    """A folder whose path is too long to be opened; its parents are made step by step."""
    os.makedirs(at, exist_ok=True)
    here = os.getcwd()
    try:
        os.chdir(at)
        for _ in range(20):
            name = "n" * 250
            os.mkdir(name)
            os.chdir(name)
        with open("lost.txt", "w") as f:
            f.write("never read")
    finally:
        os.chdir(here)


def test_what_cannot_be_read_comes_back_as_rows(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "docs", SnapshotStore(spark, str(tmp_path / "store"))
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"words")
    (root / "sub" / "b.txt").write_bytes(b"words")
    monkeypatch.setattr(listing, "HEAD_ENTRIES", 0)
    deep(str(root / "deep"))
    for head in (0, 10_000):
        found = listing.list_files(spark, str(root), head=head)
        closed = [r["path"] for r in found.filter("problem = 'unreadable'").collect()]
        assert len(closed) == 1 and len(closed[0]) > 4000 and closed[0].startswith(f"{root}/deep/n")
        assert [r[1] for r in rows(found)] == ["a.txt", "b.txt"]
    index = Indexer(spark, store)
    assert index.run(str(root))["files_new"] == 2
    assert [r["skip_reason"] for r in store.read("skips").collect()] == ["unreadable"]
    gone = listing.list_files(spark, str(tmp_path / "gone"), head=0)
    assert [(r["path"], r["problem"]) for r in gone.collect()] == [(str(tmp_path / "gone"), "unreadable")]


def test_cancelled_between_rounds(spark, tmp_path):
    tree(tmp_path)
    with pytest.raises(listing.Cancelled):
        listing.list_files(spark, str(tmp_path), cancelled=lambda: True)
    with pytest.raises(listing.Cancelled):
        listing.list_files(spark, str(tmp_path), head=0, cancelled=lambda: True)


def test_a_run_over_a_tree_listed_by_executors(spark, tmp_path, monkeypatch):
    def indexed(name):
        store = SnapshotStore(spark, str(tmp_path / name))
        Indexer(spark, store).run(str(root))
        return sorted((r["normalized_path"], r["content_status"], r["unit_count"]) for r in store.read("files").collect())

    root = tmp_path / "docs"
    root.mkdir()
    tree(root, folders=3, files=4, depth=2)
    here = indexed("one")
    monkeypatch.setattr(listing.list_files, "__kwdefaults__", None)
    monkeypatch.setattr(listing.list_files, "__defaults__", (*listing.list_files.__defaults__[:-1], 0))
    assert indexed("two") == here and len(here) == 27
