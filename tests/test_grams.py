"""The gram index: never rules out a hit, reads a few lists, prunes parts, follows runs, refreshes and rebuilds."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry import model as M
from quarry.operators import grams
from quarry.operators.indexing import Indexer
from quarry.operators.search import SearchEngine, search_store
from quarry.plans import registry
from quarry.plans.query import parse
from quarry.sources import store as store_module
from quarry.sources.store import SnapshotStore


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    return registry._stored(spark, sf_dir)


def hits(engine, request):
    return sorted(map(tuple, engine.hits(request).select("file_id", "match_count", "score").collect()))


def test_lists_read_back():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(1 << rng.choice([3, 9, 14, 30])), rng.randint(1, 8))) for _ in range(rng.randint(1, 6))]
        starts = np.cumsum([0, *map(len, lists[:-1])])
        data, offsets = grams.encoded(np.array([x for own in lists for x in own]), starts)
        assert [grams.decoded(data[a:b].tobytes()).tolist() for a, b in zip(offsets, offsets[1:])] == lists
    assert grams.decoded(b"").tolist() == []


def test_buckets_are_the_same_in_python_and_spark(spark):
    some = [0, 1, 255, 1 << 16, (1 << 24) - 1, *random.Random(2).sample(range(1 << 24), 500)]
    got = spark.createDataFrame([(g,) for g in some], "gram int").select("gram", grams._bucket(F.col("gram")).alias("b")).collect()
    assert {r["gram"]: r["b"] for r in got} == dict(zip(some, grams.bucket_of(np.array(some)).tolist()))


def test_postings_list_every_gram(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, 20_000, 70_000, 4_000_000_000]), "".join(rng.choice("abcdeéΣς งบ") for _ in range(rng.randint(0, 60)))) for _ in range(200)]
    units = spark.createDataFrame([*rows, (5, None)], "file_id long, text string").repartition(4)
    want = {}
    for i, text in rows:
        for g in grams.grams_of(text.lower().replace("ς", "σ").encode()).tolist():
            want.setdefault((g, i >> grams.BLOCK_BITS), set()).add(i)
    lists, _, names = grams.postings(units)
    got = lists.collect()
    assert {(r["gram"], r["block"]): {(r["block"] << grams.BLOCK_BITS) + x for x in grams.decoded(r["ids"]).tolist()} for r in got} == want
    assert len(got) == len(want) and all(r["n"] == len(want[r["gram"], r["block"]]) and r["part"] in names for r in got)


@pytest.mark.parametrize("query,options", [
    ("tion", {}), ("ention the", {}), ("The", {"match_case": True}), ("th*tion", {}), ("é", {}), ("the", {"whole_word": True}), ("zzqxw", {}), ("e?t*ing", {"root_id": 2}),
    ("tion", {"compat": True}), ("*", {}), ("of the", {"exact_phrase": True}), ("tion", {"filters": M.Filters(extensions=frozenset({".txt"}))}),
])
def test_same_hits_with_and_without(stored, query, options):
    request = M.Request(query, scope=M.Scope.CONTENT, **options)
    assert hits(SearchEngine.open(stored, False), request) == hits(SearchEngine.open(stored, True), request)


def test_folding_depends_on_no_neighbour(spark, tmp_path):
    """A sigma that ends the query, but not the word, and an i that folding makes two characters of."""
    texts = ["ΟΔΟΣΑ και", "οδος", "İSTANBUL", "straße STRASSE", "ΑΣ", "K and k"]
    units = spark.createDataFrame([(i * M.UNIT_STRIDE + 1, i, 1, 1, "line", i, t) for i, t in enumerate(texts)], "unit_id long, file_id long, root_id int, sequence int, location_type string, line_no int, text string")
    files = spark.createDataFrame([(i, 1, f"f{i}", f"f{i}", f"f{i}", 1.0) for i in range(len(texts))], "file_id long, root_id int, file_name string, relative_path string, normalized_path string, modified_time double")
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.publish({"files": files, "units": units})
    grams.rebuilt(store)
    for query in ("ΟΔΟΣ", "οδος", "οδοσ", "İST", "ist", "STRASS", "straß", "ΑΣ", "and"):
        for options in ({}, {"match_case": True}, {"whole_word": True}, {"match_case": True, "whole_word": True}):
            request = M.Request(query, scope=M.Scope.CONTENT, **options)
            assert hits(SearchEngine.open(store, False), request) == hits(SearchEngine.open(store, True), request), (query, options)
    assert search_store(store, M.Request("ΟΔΟΣ", scope=M.Scope.CONTENT, match_case=True), indexed=True).total == 1


def test_a_query_reads_few_lists(spark, tmp_path):
    """Files that lack the grams do not make a query read more."""

    def read_bytes(n):
        words = spark.range(n).select(F.col("id").alias("file_id"), F.when(F.col("id") % 50 == 7, "needle").otherwise(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 512)))).alias("text"))
        words = words.filter("id < 500 OR text <> 'needle'") if n > 500 else words
        store = SnapshotStore(spark, str(tmp_path / f"s{n}"))
        units = words.select((F.col("file_id") * M.UNIT_STRIDE).alias("unit_id"), "file_id", F.lit(1).alias("root_id"), "text")
        store.replace({"units": (units.withColumn("part", store_module.part_of(F.col("root_id"), F.col("file_id"))), "part", [f"1-{k}" for k in range(n // store_module.FILES_PER_PART + 1)])})
        grams.rebuilt(store)
        at = store.snapshot()
        stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file")
        before = stats.getLong("bytesRead")
        found = grams.candidates(at, spark, parse("needle"))
        assert sorted(r["file_id"] for r in found.rows.collect()) == list(range(7, 500, 50))
        assert found.parts(at.parts("units")) == ["1-0"]
        return stats.getLong("bytesRead") - before, sum(p["rows"] for p in at.tables["postings"].values())

    few, lists = read_bytes(500)
    many, more = read_bytes(30_000)
    assert more > 3 * lists  # the index has grown
    assert many < 2 * few + 50_000, (few, many)


def test_an_absent_gram_ends_the_search(stored, spark):
    found = grams.candidates(stored.snapshot(), spark, parse("zzqxw"))
    assert found.rows.count() == 0 and found.parts(stored.parts("units")) == []
    assert grams.candidates(stored.snapshot(), spark, parse("zq")) is None


def test_large_candidate_sets_stay_on_the_executors(stored, spark, monkeypatch):
    request = M.Request("tion", scope=M.Scope.CONTENT)
    monkeypatch.setattr(grams, "COLLECTED", 0)
    found = grams.candidates(stored.snapshot(), spark, parse("tion"))
    assert found._numbers is None and set(found.parts(stored.parts("units"))) <= set(stored.parts("units"))
    assert hits(SearchEngine.open(stored, False), request) == hits(SearchEngine.open(stored, True), request)


def test_index_follows_the_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FILES_PER_PART", 2)
    root, store = tmp_path / "docs", SnapshotStore(spark, str(tmp_path / "store"))
    root.mkdir()
    for i in range(6):
        (root / f"f{i}.txt").write_bytes(f"common words and token{i}x{i}".encode())
    index = Indexer(spark, store)
    index.run(str(root))
    at = store.snapshot()
    assert len(grams.candidates(at, spark, parse("token3x3")).parts(at.parts("units"))) < len(at.parts("units"))
    (root / "f3.txt").write_bytes(b"something else")
    (root / "f1.txt").unlink()
    index.run(str(root))
    found = lambda q: search_store(store, M.Request(q, scope=M.Scope.CONTENT), indexed=True).total
    want = [0, 1, 0, 4]
    assert [found(q) for q in ("token3x3", "something", "token1x1", "common")] == want
    assert len(grams.generations(store.snapshot())) == 2
    for make in (lambda: grams.merged(store, 1), lambda: grams.rebuilt(store)):
        make()
        assert len(grams.generations(store.snapshot())) == 1
        assert [found(q) for q in ("token3x3", "something", "token1x1", "common")] == want
    index.clear_content(str(root))
    assert found("common") == 0


def test_codes_of_all_texts_at_once():
    """Grams end with their text: empty, null, short and sliced ones too."""
    texts = ["abcd", "", None, "ab", "xyz", "żółw", "abcabc", "q"]
    ids = np.array([7, 7, 8, 9, 9, 1 << 20, 7, 3])
    for start in (0, 3):
        want = sorted({(int(g) << 32) | int(f) for f, t in zip(ids[start:], texts[start:]) for g in grams.grams_of((t or "").encode())})
        assert grams.codes_of(ids[start:], pa.array(texts)[start:]).tolist() == want
    assert not len(grams.codes_of(ids[:2], pa.array(["", None])))


def test_parts_have_few_files(spark, tmp_path, monkeypatch):
    """However many tasks read the documents."""
    rows = [(i, "de", "s", f"line {i}\nmore attention therapying", 10) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, n_chars long").repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(registry.tempfile, "mkdtemp", lambda **k: str(tmp_path / "made"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "2k")
    try:
        store = registry._stored(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    entries = store.snapshot().tables["units"]
    assert store.read("units").count() == sum(2 for i in range(200) if i % 29 and i % 23)
    for e in entries.values():
        at = store.path(e["at"]).removeprefix("file://").removeprefix("file:")
        assert len([f for f in os.listdir(at) if f.endswith(".parquet")]) <= registry.FILES_OF_A_PART
