"""Streaming refresh: stores of every make, repeats, late batches, deletes, the index after each."""

import os

import pytest
from pyspark.sql import functions as F

from quarry import model as M
from quarry.functions.text import normalized_path_str
from quarry.operators import grams
from quarry.operators.indexing import Indexer
from quarry.operators.search import SearchEngine, search_store
from quarry.sources import adapters
from quarry.sources import store as store_module
from quarry.sources.store import Change, SnapshotStore
from quarry.streaming import refresh

EVENT = "root_id int, relative_path string, modified_time double, text string"


def total(store, query, **options):
    """The hits with and without the index, which must be the same."""
    found = [sorted(r["normalized_path"] for r in SearchEngine.open(store, indexed).hits(M.Request(query, scope=M.Scope.CONTENT, **options)).collect()) for indexed in (False, True)]
    assert found[0] == found[1]
    return len(found[0])


def sound(store):
    """Units belong to files, once each; numbers agree with the manifest."""
    files, units = store.read("files"), store.read("units")
    assert files.count() == files.select("file_id").distinct().count() == files.select("root_id", "normalized_path").distinct().count()
    assert units.count() == units.select("unit_id").distinct().count()
    assert units.join(files, "file_id", "left_anti").count() == 0
    store.verify()


@pytest.fixture
def indexed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FILES_PER_PART", 2)
    root, store = tmp_path / "docs", SnapshotStore(spark, str(tmp_path / "store"))
    root.mkdir()
    for i in range(5):
        (root / f"f{i}.txt").write_bytes(f"common word{i}\nsecond line".encode())
        os.utime(root / f"f{i}.txt", (1000, 1000))
    Indexer(spark, store).run(str(root))
    return store, str(root), lambda *rows: refresh.merge(store, spark.createDataFrame(list(rows), EVENT), 1, normalized_path_str(str(root)))


def test_over_an_indexed_store(indexed):
    store, root, merge = indexed
    ids = {r["file_name"]: r["file_id"] for r in store.read("files").collect()}
    before = store.current()["tables"]["units"]
    assert merge((1, "f2.txt", 2000.0, "common changed\n\nthird"), (1, "sub\\New.txt", 2000.0, "common arrival"))
    assert [total(store, q) for q in ("word2", "changed", "arrival", "common")] == [0, 1, 1, 6]
    after = {r["file_name"]: r["file_id"] for r in store.read("files").collect()}
    assert ids.items() <= after.items() and after["New.txt"] not in ids.values()
    touched = {f"1-{after[n] // 2}" for n in ("f2.txt", "New.txt")}
    assert {p for p, at in store.current()["tables"]["units"].items() if before.get(p) != at} == touched
    sound(store)
    # a run afterwards finds the files by their paths and gives none a second entry
    Indexer(store.spark, store).run(root)
    assert [total(store, q) for q in ("word2", "changed", "arrival", "common")] == [1, 0, 0, 5]
    sound(store)


def test_repeated_and_late_batches_change_nothing(indexed):
    store, _, merge = indexed
    assert merge((1, "f1.txt", 3000.0, "newest words"))
    number = store.current()["number"]
    assert not merge((1, "f1.txt", 3000.0, "newest words"))
    assert not merge((1, "f1.txt", 2000.0, "late words"), (1, "f0.txt", 500.0, "older than the index"))
    assert not merge((2, "f1.txt", 9000.0, "another root"))
    assert store.current()["number"] == number
    assert [total(store, q) for q in ("newest", "late", "older", "word0")] == [1, 0, 0, 1]
    # of several events of one file in a batch the newest counts, whatever their order
    assert merge((1, "f1.txt", 4000.0, "b"), (1, "F1.TXT", 5000.0, "final text"), (1, "f1.txt", 4500.0, None))
    assert [total(store, q) for q in ("final", "newest")] == [1, 0]
    sound(store)


def test_deletes_arrive_as_tombstones(indexed):
    store, _, merge = indexed
    assert merge((1, "f3.txt", 2000.0, None), (1, "never.txt", 2000.0, None))
    assert total(store, "word3") == 0 and total(store, "common") == 4
    assert not merge((1, "f3.txt", 1500.0, "back from the dead"), (1, "never.txt", 1999.0, "x"))
    assert total(store, "dead") == 0
    assert merge((1, "f3.txt", 2500.0, "written again"))
    assert total(store, "again") == 1
    assert {(r["normalized_path"].rpartition("\\")[2], r["deleted_time"]) for r in store.read("tombstones").collect()} >= {("never.txt", 2000.0)}
    assert merge(*((1, f"f{i}.txt", 9000.0, None) for i in range(5)))
    assert store.read("files").count() == 0 and store.read("units").count() == 0
    sound(store)


def test_over_tables_that_were_published_whole(spark, sf_dir, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    files, units = adapters.files(spark, sf_dir), adapters.units(spark, sf_dir)
    store.publish({"files": files, "units": units}, {"files": ["root_id"], "units": ["root_id"]})
    n_files, n_units, tion = files.count(), units.count(), total(store, "tion")
    old = files.filter("root_id = 2 AND content_status = 'indexed'").orderBy("file_id").first()
    own = units.filter(F.col("file_id") == old["file_id"]).count()
    base = "d:\\corpus\\en"
    events = [(2, old["relative_path"], old["modified_time"] + 1, "zzq first\nzzq second"), (2, "src0\\new.txt", 1.0, "zzq third")]
    assert refresh.merge(store, spark.createDataFrame(events, EVENT), 2, base)
    assert store.read("files").count() == n_files + 1 and store.read("units").count() == n_units - own + 3
    assert {r["file_id"] for r in store.read("units").filter("text LIKE 'zzq%'").collect()} == {old["file_id"], files.agg(F.max("file_id")).first()[0] + 1}
    assert total(store, "zzq") == 2 and total(store, "tion") in (tion, tion - 1)
    sound(store)


def test_an_empty_store_and_a_stream(spark, sf_dir, tmp_path):
    source, store = tmp_path / "in", SnapshotStore(spark, str(tmp_path / "out"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    docs.write.parquet(str(source))

    def run():
        events = refresh.document_events(refresh.document_stream(spark, str(source)))
        refresh.refresh(events, store, str(tmp_path / "check"), {1: "d:\\in"}, once=True).awaitTermination(300)

    run()
    assert store.read("files").count() == docs.count() and set(store.parts("units")) == {"1-0"}
    first = store.current()["number"]
    run()  # nothing has arrived
    assert store.current()["number"] == first
    docs.limit(1).withColumn("text", F.lit("zzq arrived later")).write.mode("append").parquet(str(source))
    run()
    assert total(store, "zzq") == 1 and store.read("files").count() == docs.count()
    sound(store)


def test_a_batch_meets_another_writer(indexed, spark, monkeypatch):
    """Another writer commits the same part between reading and committing: the batch is merged anew."""
    store, root, merge = indexed
    original, calls = SnapshotStore.commit, []

    def commit(self, change, base):
        calls.append(base.number)
        if len(calls) == 1:
            with monkeypatch.context() as m:
                m.setattr(SnapshotStore, "commit", original)
                refresh.merge(SnapshotStore(spark, store.root), spark.createDataFrame([(1, "f1.txt", 7000.0, "from the other")], EVENT), 1, normalized_path_str(root))
        return original(self, change, base)

    with monkeypatch.context() as outer:
        outer.setattr(SnapshotStore, "commit", commit)
        assert merge((1, "f0.txt", 7000.0, "from this one"), (1, "f1.txt", 6000.0, "too late"))
    assert len(calls) == 2
    assert [total(store, q) for q in ("other", "this one", "late", "common")] == [1, 1, 0, 3]
    assert search_store(store, M.Request("other", scope=M.Scope.CONTENT)).total == 1
    sound(store)


def test_generations_are_merged(indexed):
    store, _, merge = indexed
    for i in range(3):
        merge((1, f"f{i}.txt", 2000.0 + i, f"common stage{i}"))
    assert len(grams.generations(store.snapshot())) == 4
    grams.merged(store, 2)
    assert len(grams.generations(store.snapshot())) == 1
    assert [total(store, q) for q in ("stage0", "stage2", "word0", "common")] == [1, 1, 0, 5]
    store.update(lambda at: Change())
    sound(store)
