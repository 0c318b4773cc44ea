import datetime as dt

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import catalog, maintenance


def one(spark, column, value="", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


CLEAN = [
    ("a\u2028b\x0bc\r", "a\nb\nc"), ("a\x00b\x7fc", "a b c"), ("\ufeffa\u200bb\u00ad", "ab"), ("a  \t\u00a0b", "a b"), ("\u3000 x \u2003", "x"),
    ("tab\there", "tab\there"), ("", ""), (None, ""), ("เ\u0e31ก  ข", "เ\u0e31ก ข"), ("1,250,000", "1,250,000"),
]


def test_clean_text_twins_agree(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CLEAN)], "i int, v string")
    got = {r["i"]: r["r"] for r in df.select("i", X.clean_text(F.col("v")).alias("r")).collect()}
    assert [got[i] for i in range(len(CLEAN))] == [c[1] for c in CLEAN] == [X.clean_str(c[0] or "") for c in CLEAN]
    assert one(spark, X.clean_text(F.col("v"), 4), "abc defg") == "abc" == X.clean_str("abc defg", 4)


def test_display(spark):
    assert one(spark, X.for_display(F.col("v")), " a\n\t b\u3000c ") == "a b c"


def test_paths(spark):
    v = F.col("v")
    for raw, want in {'"C:/a//b/../c/"': "C:\\a\\c", "\\\\?\\D:\\x\\.\\y": "D:\\x\\y", "d:": "d:\\", "d:\\..\\..\\x": "d:\\x", "//srv/share/a": "\\\\srv\\share\\a", "a/../../b": "..\\b"}.items():
        assert X.display_path_str(raw) == want
    assert X.normalized_path_str("D:\\Ab\\") == "d:\\ab" and X.normalized_path_str("D:\\") == "d:\\"
    assert one(spark, X.normalized_path(v), "D:/Ab//C/") == "d:\\ab\\c"
    for name, want in {"a.TXT": ".txt", ".bashrc": "", "a.": ".", "a.b.c": ".c", "none": ""}.items():
        assert one(spark, X.extension_of(v), name) == want
    assert one(spark, X.is_within(v, F.lit("d:\\a")), "d:\\ab\\c") is False and one(spark, X.is_within(v, F.lit("d:\\a")), "d:\\a\\c") is True
    assert one(spark, X.relative_path(v, F.lit("d:\\a")), "d:\\a\\c\\d") == "c\\d"
    assert one(spark, X.path_parts(v), "d:\\a\\b") == ["d:", "a", "b"] and one(spark, X.is_drive_root(v), "d:\\") is True


def test_numbers(spark):
    assert [X.excel_column_name(i) for i in (1, 26, 27, 702, 703, 18278)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]
    df = spark.range(1, 2000)
    assert all(r["n"] == X.excel_column_name(r["id"]) for r in df.select("id", X.column_name(F.col("id")).alias("n")).collect())
    for n, want in {0: "0 B", 1023: "1,023 B", 1536: "1.5 KB", 5 << 20: "5.0 MB", 3 << 30: "3.0 GB", 2 << 40: "2.0 TB"}.items():
        assert one(spark, X.format_size(F.col("v")), n, "long") == want


def test_fingerprints(spark):
    f = X.fingerprint(F.lit(10), F.lit(1.0005), F.lit(1))
    assert one(spark, f) == "10:1000:1"  # half to even
    assert tuple(one(spark, X.parse_fingerprint(F.col("v")), "10:1000:1")) == (10, 1000, 1)
    assert one(spark, X.parse_fingerprint(F.col("v")), "10:x:1") is None and one(spark, X.parse_fingerprint(F.col("v")), "") is None
    same = lambda a, b, p=1: one(spark, X.is_unchanged(F.lit(1), F.lit(5), F.lit(a), F.lit(p), F.lit(5), F.lit(b)))
    assert same(1.0, 2.0) and not same(1.0, 2.1) and not same(1.0, 1.0, 2)
    assert X.fast_content_hash(b"x" * 600_000) != X.fast_content_hash(b"x" * 600_001) and len(X.fast_content_hash(b"")) == 32


def test_labels_and_logs(spark):
    loc = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("page", "int"), ("paragraph", "int"), ("table", "int"), ("row", "int"), ("column", "int"), ("cell", "string"))), F.lit("x" * 70).alias("sheet"), F.lit(4).alias("line"))
    assert one(spark, X.location_label(F.lit("line"), loc)) == "Line 4" == X.location_label_str("line", {"line": 4})
    assert X.location_label_str("sheet_cell", {"sheet": "x" * 70, "cell": "F12"}) == "Sheet: " + "x" * 59 + "…, Cell: F12"
    assert one(spark, X.sanitize_for_log(F.col("v")), "no C:\\secret\\f.txt\n/home/u/x here") == "no <path> <path> here"
    assert one(spark, X.row_context(F.lit(" a "), F.array(F.lit("b  c"), F.lit(" "), F.lit(None).cast("string")))) == "a  |  b c"
    assert one(spark, X.end_of_day(F.lit(dt.date(2024, 1, 1)))) == 1704153599.0


def test_merge_keeps_ids(spark):
    ddl = "file_id long, root_id int, normalized_path string, size_bytes long, modified_time double, parser_version int"
    old = spark.createDataFrame([(7, 1, "a", 1, 1.0, 1), (9, 1, "b", 1, 1.0, 1), (4, 1, "gone", 1, 1.0, 1)], ddl)
    scan = spark.createDataFrame([(1, "a", 1, 1.9), (1, "b", 2, 1.0), (1, "new", 5, 1.0), (1, "new2", 5, 1.0)], "root_id int, normalized_path string, size_bytes long, modified_time double")
    change = maintenance.classify(old, scan, 1)
    assert {r["normalized_path"]: r["change"] for r in change.collect()} == {"a": "unchanged", "b": "changed", "new": "new", "new2": "new", "gone": "deleted"}
    merged = maintenance.upsert(old, change.filter("change in ('new', 'changed')").select("root_id", "normalized_path", "size_bytes", "modified_time", F.lit(1).alias("parser_version")))
    got = {r["normalized_path"]: (r["file_id"], r["size_bytes"]) for r in merged.collect()}
    assert got["a"] == (7, 1) and got["b"] == (9, 2) and {got["new"][0], got["new2"][0]} == {10, 11}
    again = maintenance.upsert(merged, merged.drop("file_id"))
    assert {r["normalized_path"]: r["file_id"] for r in again.collect()} == {k: v[0] for k, v in got.items()}


def test_maintenance(spark):
    files = spark.createDataFrame([(1, "d:\\x\\a", 1), (2, "d:\\x\\b", 2), (3, "d:\\y\\c", 1)], "file_id long, normalized_path string, last_seen_run_id long")
    keep = lambda **kw: sorted(r["file_id"] for r in maintenance.without_unseen(files, 2, **kw).collect())
    assert keep(scan_complete=False) == [1, 2, 3] and keep(scan_complete=True) == [2]
    assert keep(scan_complete=True, unreadable=spark.createDataFrame([("d:\\x",)], "folder string")) == [1, 2]
    runs = spark.createDataFrame([(1, 1, "completed"), (3, 1, "running"), (2, 2, "failed")], "run_id long, root_id int, status string")
    assert {tuple(r) for r in catalog.latest_run(runs).collect()} == {(1, 3, "running"), (2, 2, "failed")}
    assert catalog.abandon_running(runs).filter("status = 'abandoned'").count() == 1
    outcomes = spark.createDataFrame([(1, "indexed"), (1, "failed"), (1, "indexed")], "run_id long, outcome string")
    assert catalog.run_counters(outcomes).select("files_discovered", "files_indexed", "files_failed", "files_deleted").first() == (3, 2, 1, 0)
