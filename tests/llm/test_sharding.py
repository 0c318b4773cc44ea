"""The hash tree's shares and movements, slots, edges; the query against its SQL."""

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from quarry.llm import registry, sharding
from quarry.llm.sharding import HashTree, Shard, base_tree, grown_tree, key_of

DDL = "doc_id long, text string, lang string, slot string, shard string, task string, salt string, size string"
KEYS = [key_of(i) for i in range(20_000)]


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(registry.ORACLE_SQL["op11_sharding"])
    got = registry.QUERIES["op11_sharding"](spark, sf_dir).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def shares(tree, keys=KEYS):
    found, weights = Counter(tree.place(keys)), tree.shards()
    total = sum(weights.values())
    for shard, weight in weights.items():
        want = len(keys) * weight / total
        assert abs(found[shard] - want) < 5 * want**0.5 + 1, (shard, found[shard], want)
    return found


def test_shares_follow_weights():
    assert set(shares(base_tree(8))) == set(range(8))
    shares(HashTree.of([Shard(0, "a", "x", 5.0), Shard(1, "a", "y", 0.5), Shard(2, "a", "y"), Shard(3, "b", "x", 2.5)]))
    shares(HashTree.of([Shard(0, "a", "x")]))


def test_one_more_shard_takes_rows_only_into_itself():
    """At every size, wherever in the tree the shard stands."""
    for n in range(1, 12):
        tree, more = grown_tree(1, n - 1), grown_tree(1, n)
        before, after = tree.place(KEYS), more.place(KEYS)
        assert {b for a, b in zip(before, after) if a != b} == {n}
        shares(more)


def test_movement_stays_in_what_changes():
    tree = base_tree(8)
    before = tree.place(KEYS)
    heavier = tree.grown([Shard(2, "region0", "rack1", 1.0), Shard(3, "region0", "rack1", 0.5)])
    after = heavier.place(KEYS)
    assert {b for a, b in zip(before, after) if a != b} == {2, 3}
    shares(heavier)
    lighter = tree.shrunk(5, 0.25)
    after = lighter.place(KEYS)
    assert {a for a, b in zip(before, after) if a != b} == {5}
    shares(lighter)
    gone = tree.shrunk(5, 0.25).shrunk(5, 0)
    after = gone.place(KEYS)
    assert 5 not in after and all(a == b for a, b in zip(before, after) if a != 5)


def test_bad_trees():
    for tree in (HashTree(), HashTree.of([Shard(0, "a", "x")]).shrunk(0, 0)):
        with pytest.raises(ValueError):
            tree.place(KEYS[:1])
    with pytest.raises(ValueError):
        HashTree.of([Shard(0, "a", "x", 0.0)])
    with pytest.raises(ValueError):
        base_tree(1).shrunk(0, 1.5)


def test_rows_slots_and_edges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_ROWS", 16)  # one id's rows are dealt to several tasks
    rows = [(i, f"text {i}") for i in range(60)] + [(7, "other"), (7, "text 7"), (None, None), (None, ""), (None, "ß É \U0001f600"), (3, "long " * 400_000)] + [(11, "hot")] * 120
    docs = spark.createDataFrame([(i, t, "l", "s", "s", "t", "s", "z") for i, t in rows], DDL).repartition(5)
    got = sharding.assign(docs, base_tree(8), grown_tree(8)).collect()
    assert len(got) == len(rows)
    by_shard, by_id = defaultdict(list), defaultdict(set)
    for r in got:
        by_shard[r["shard"]].append(r)
        by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(len(x) == 1 for x in by_id.values())
    for own in by_shard.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in own]
        assert order == sorted(order)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.assign(docs.limit(0), base_tree(8)).collect() == []
    assert {r["grown_shard"] for r in sharding.assign(docs.limit(3), base_tree(2)).collect()} == {None}
