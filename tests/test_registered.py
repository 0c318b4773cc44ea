"""Every registered engine query against its SQL, and the driver's entry points."""

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.operators import catalog
from quarry.plans.registry import ORACLE_SQL, QUERIES
from quarry.sources import store as S
from quarry import model as M

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    got = QUERIES[name](spark, sf_dir)
    if name not in ORACLE_SQL:
        assert got.count() > 0
        return
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_runs(spark):
    runs = spark.createDataFrame([], M.RUNS)
    runs = catalog.run_started(catalog.run_started(runs, 1, "update", "0"), 2, "rebuild", "0")
    done = catalog.run_finished(runs, 2, "completed")
    assert {(r["run_id"], r["status"], r["elapsed_seconds"] is not None) for r in done.collect()} == {(1, "running", False), (2, "completed", True)}


def test_store_maintenance(spark, tmp_path, monkeypatch):
    store = S.SnapshotStore(spark, str(tmp_path / "a"))
    assert store.migrate() == M.SCHEMA_VERSION and store.verify() == {}
    store.publish({"t": spark.range(7)})
    store.backup(str(tmp_path / "b"))
    assert S.SnapshotStore(spark, str(tmp_path / "b")).verify() == {"t": 7}
    monkeypatch.setattr(M, "SCHEMA_VERSION", 2)
    with pytest.raises(RuntimeError):
        store.migrate()
    monkeypatch.setitem(S.MIGRATIONS, 1, lambda name, df: df.withColumnRenamed("id", "key"))
    assert store.migrate() == 2 and store.read("t").columns == ["key"]
