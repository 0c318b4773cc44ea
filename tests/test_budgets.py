"""Budgets of units against a plain loop; long files are dealt to many tasks; runs tell what was cut."""

import random

from pyspark.sql import functions as F

from quarry import model as M
from quarry.operators import budgets
from quarry.operators.indexing import Indexer
from quarry.sources import parsers
from quarry.sources.store import SnapshotStore


def plain(rows, max_units, max_chars):
    left, told = [], {}
    for file_id in {r[0] for r in rows}:
        n = chars = 0
        own = sorted(r for r in rows if r[0] == file_id)
        for r in own:
            if n < max_units and chars <= max_chars:
                left.append(r)
                n, chars = n + 1, chars + len(r[2])
            else:
                break
        told[file_id] = (n < len(own), n, chars)
    return sorted(left), told


def test_against_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(budgets, "STRETCH", 7)
    rng = random.Random(6)
    rows = [(f, s, "x" * rng.randint(0, 9)) for f in range(12) for s in sorted(rng.sample(range(1, 200), rng.randint(1, 90)))]
    df = spark.createDataFrame(rows, "file_id long, sequence int, text string").repartition(5)
    for max_units, max_chars in ((1, 10**9), (10**9, 0), (20, 100), (10**9, 10**9), (50, 60)):
        want, told = plain(rows, max_units, max_chars)
        assert sorted(tuple(r) for r in budgets.within(df, max_units, max_chars).collect()) == want
        got = {r["file_id"]: (r["truncated"], r["unit_count"], r["char_count"]) for r in budgets.truncated(df, max_units, max_chars).collect()}
        assert got == told
    assert budgets.within(df.limit(0), 5).collect() == []


def test_no_task_gathers_a_file(spark):
    """The windows are over stretches, and over a file's stretches; no window is over a file's units."""
    df = spark.range(100_000).select(F.lit(1).cast("long").alias("file_id"), F.col("id").alias("sequence"), F.lit("abc").alias("text"))
    found = budgets.with_running(df)
    last = found.orderBy(F.desc("sequence")).first()
    assert (last["units_before"], last["chars_before"]) == (99_999, 299_997)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) == 2 and sum("_stretch" in line.partition("], [")[2] for line in windows) >= 1


def test_files_are_cut_and_flagged(spark):
    units = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bb"), (2, 1, "c")], "file_id long, sequence int, text string")
    files = spark.createDataFrame([(1, False, 2, 6), (2, False, 1, 1), (3, True, 0, 0)], "file_id long, truncated boolean, unit_count int, char_count long")
    own, left = budgets.cut(files, units, 5, 3)
    assert sorted(tuple(r) for r in own.collect()) == [(1, True, 1, 4), (2, False, 1, 1), (3, True, 0, 0)]
    assert left.count() == 2


def test_runs_tell_what_the_parsers_cut(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "docs", SnapshotStore(spark, str(tmp_path / "store"))
    root.mkdir()
    (root / "long.txt").write_text("y" * (M.MAX_LINE_CHARS + 5) + "\nshort")
    (root / "short.txt").write_text("words")
    Indexer(spark, store).run(str(root))
    assert {r["file_name"]: (r["truncated"], r["warnings"]) for r in store.read("files").collect()} == {"long.txt": (False, "limit_exceeded"), "short.txt": (False, "")}
    row = parsers.parse_bytes("a.txt", b"1\n2\n3")
    assert not row["truncated"] and row["warnings"] == []
    sink = parsers.Sink(2)
    assert [sink.add("line", t, 10, line=1, lines=1) for t in "abc"] == [True, False, False] and sink.meta["truncated"] and sink.meta["warnings"] == ["limit_exceeded"]
