"""Metadata filters, roots and subfolders leave parts of units unread; ids follow paths."""

import os

import pytest

from quarry import model as M
from quarry.functions.text import normalized_path_str
from quarry.operators import maintenance
from quarry.operators.indexing import Indexer
from quarry.operators.search import SearchEngine, may_hold, search_store
from quarry.plans.query import parse
from quarry.sources import store as store_module
from quarry.sources.store import SnapshotStore
from quarry.streaming import refresh


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(store_module, "FILES_PER_PART", 3)
        base = tmp_path_factory.mktemp("trees")
        store = SnapshotStore(spark, str(tmp_path_factory.mktemp("store")))
        for r, root in enumerate(("one", "two")):
            for f, folder in enumerate(("alpha", "beta", "gamma")):
                os.makedirs(base / root / folder)
                for i in range(4):
                    path = base / root / folder / f"n{i}.{'txt' if folder != 'gamma' else 'md'}"
                    path.write_bytes(b"shared words " + b"x" * 100 * f)
                    os.utime(path, (1000 * (f + 1) + i, 1000 * (f + 1) + i))
            Indexer(spark, store, extensions=M.CORE_EXTENSIONS + M.OPTIONAL_EXTENSIONS).run(str(base / root))
        yield store, str(base)


def read(engine, request):
    """The parts of ``units`` that a search reads."""
    return {os.path.basename(os.path.dirname(p)).removeprefix("_part=") for p in engine._units(request, parse(request.query)).inputFiles()}


def test_ids_follow_paths(stored):
    files = sorted((r["root_id"], r["normalized_path"], r["file_id"]) for r in stored[0].read("files").collect())
    assert [i for *_, i in files] == list(range(1, 25))


@pytest.mark.parametrize("filters,share", [
    (M.Filters(min_size=150, max_size=220), 0.7), (M.Filters(max_size=20), 0.7), (M.Filters(modified_after=3000.0), 0.7), (M.Filters(modified_before=1500.0), 0.7), (M.Filters(extensions=frozenset({".md"})), 0.7),
    (M.Filters(min_size=10**9), 0.0), (M.Filters(extensions=frozenset({".pdf"})), 0.0), (M.Filters(modified_after=1e12), 0.0),
])
def test_filters_leave_parts_out(stored, monkeypatch, filters, share):
    monkeypatch.setattr(store_module, "FILES_PER_PART", 3)
    store, _ = stored
    for indexed in (False, True):
        engine, request = SearchEngine.open(store, indexed), M.Request("words", scope=M.Scope.CONTENT, filters=filters)
        parts = read(engine, request)
        assert len(parts) <= share * len(store.parts("units"))
        plain = SearchEngine(store.read("files"), store.read("units"))
        want = sorted(r["file_id"] for r in plain.hits(request).collect())
        assert sorted(r["file_id"] for r in engine.hits(request).collect()) == want
        assert bool(want) == bool(share)


def test_roots_and_subfolders(stored, monkeypatch):
    monkeypatch.setattr(store_module, "FILES_PER_PART", 3)
    store, base = stored
    engine = SearchEngine.open(store)
    request = M.Request("words", scope=M.Scope.CONTENT, root_id=2)
    assert read(engine, request) == {p for p in store.parts("units") if p.startswith("2-")} and engine.hits(request).count() == 12
    inside = M.Request("words", scope=M.Scope.CONTENT, root_id=2, filters=M.Filters(subfolder=f"{base}/two/beta"))
    assert len(read(engine, inside)) <= 3 and engine.hits(inside).count() == 4
    # a subfolder outside the searched root is ignored
    outside = M.Request("words", scope=M.Scope.CONTENT, root_id=2, filters=M.Filters(subfolder=f"{base}/one/beta"))
    assert read(engine, outside) == read(engine, request) and search_store(store, outside).total == 12
    # a subfolder's prefix counts in compat alone
    prefix = M.Filters(subfolder=f"{base}/one/bet")
    assert engine.hits(M.Request("words", scope=M.Scope.CONTENT, filters=prefix)).count() == 0
    assert engine.hits(M.Request("words", scope=M.Scope.CONTENT, filters=prefix, compat=True)).count() == 4


def test_bounds():
    facts = {"size_bytes": [10, 20], "modified_time": [None, None], "normalized_path": ["d:\\a\\x", "d:\\c\\y"], "extension": [".txt"]}
    yes = [M.Filters(), M.Filters(min_size=20), M.Filters(max_size=10), M.Filters(extensions=frozenset({".txt", ".pdf"})), M.Filters(subfolder="d:\\b"), M.Filters(subfolder="d:\\a"), M.Filters(subfolder="d:\\")]
    no = [M.Filters(min_size=21), M.Filters(max_size=9), M.Filters(modified_after=1.0), M.Filters(extensions=frozenset({".pdf"})), M.Filters(subfolder="d:\\d"), M.Filters(subfolder="c:\\x")]
    assert all(may_hold(facts, f) for f in yes) and not any(may_hold(facts, f) for f in no)
    assert all(may_hold(None, f) for f in [*yes, *no]) and may_hold({}, M.Filters(min_size=1, extensions=frozenset({".x"})))


def test_refresh_keeps_the_bounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FILES_PER_PART", 3)
    root, store = tmp_path / "docs", SnapshotStore(spark, str(tmp_path / "s"))
    root.mkdir()
    for i in range(6):
        (root / f"f{i}.txt").write_bytes(b"words")
        os.utime(root / f"f{i}.txt", (100, 100))
    Indexer(spark, store).run(str(root))
    late = M.Request("words", scope=M.Scope.CONTENT, filters=M.Filters(modified_after=5000.0))
    assert read(SearchEngine.open(store), late) == set()
    refresh.merge(store, spark.createDataFrame([(1, "f5.txt", 6000.0, "words again")], "root_id int, relative_path string, modified_time double, text string"), 1, normalized_path_str(str(root)))
    assert len(read(SearchEngine.open(store), late)) == 1 and search_store(store, late).total == 1


def test_numbers_in_order(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "NUMBERED_ROWS", 50)
    rows = spark.createDataFrame([(f"p{i:04d}",) for i in range(1000)], "normalized_path string").repartition(7)
    found, held = maintenance.in_order(rows, 41, 1000)
    assert [r["file_id"] for r in found.orderBy("normalized_path").collect()] == list(range(42, 1042))
    assert held.rdd.getNumPartitions() > 4
    held.unpersist()
    empty, _ = maintenance.in_order(rows.limit(0), 5, 0)
    assert empty.collect() == []
