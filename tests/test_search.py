import pytest
from pyspark.sql import functions as F

from quarry import model as M
from quarry.operators import context, ranking, snippets
from quarry.operators.search import SearchEngine, existence
from quarry.plans.query import parse


@pytest.fixture(scope="module")
def engine(spark):
    files = [
        (1, 1, "budget.txt", "a\\budget.txt", "d:\\r\\a\\budget.txt", ".txt", 100, 1000.0),
        (2, 1, "report_2560.docx", "ab\\report_2560.docx", "d:\\r\\ab\\report_2560.docx", ".docx", 2000, 5000.0),
        (3, 1, "notes.txt", "budget\\notes.txt", "d:\\r\\budget\\notes.txt", ".txt", 50, None),
        (4, 2, "budget.txt", "budget.txt", "d:\\s\\budget.txt", ".txt", 1, 1.0),
        (5, 1, "empty.txt", "empty.txt", "d:\\r\\empty.txt", ".txt", 0, 2000.0),
    ]
    units = [
        (1, 1, 1, "line", 1, "งบประมาณ annual Budget"), (2, 1, 1, "line", 2, "the total is 45000"), (3, 2, 1, "paragraph", 1, "Budget report"),
        (4, 2, 1, "paragraph", 2, "udget only"), (5, 3, 1, "line", 1, "annual"), (6, 3, 1, "line", 2, "report"), (7, 4, 2, "line", 1, "annual budget"),
    ]
    f = spark.createDataFrame(files, "file_id long, root_id int, file_name string, relative_path string, normalized_path string, extension string, size_bytes long, modified_time double")
    u = spark.createDataFrame(units, "unit_id long, file_id long, root_id int, location_type string, sequence int, text string")
    return SearchEngine(f, u)


def ids(engine, query, **kw):
    kw.setdefault("root_id", 1)
    return {r["file_id"]: r["match_source"] for r in engine.hits(M.Request(query, **kw)).collect()}


def test_scopes(engine):
    assert ids(engine, "budget") == {1: "both", 2: "content", 3: "name"}
    assert ids(engine, "budget", scope=M.Scope.NAME) == {1: "name", 3: "name"}
    assert ids(engine, "budget", scope=M.Scope.CONTENT) == {1: "content", 2: "content"}
    assert ids(engine, "budget", root_id=2) == {4: "both"}
    assert ids(engine, "งบ") == {1: "content"}


@pytest.fixture()
def stored(spark, sf_dir, tmp_path):
    from quarry.sources import adapters

    adapters.files(spark, sf_dir).write.parquet(str(tmp_path / "files"))
    adapters.units(spark, sf_dir).write.parquet(str(tmp_path / "units"))
    return SearchEngine(spark.read.parquet(str(tmp_path / "files")), spark.read.parquet(str(tmp_path / "units")))


@pytest.mark.parametrize("scope", list(M.Scope))
def test_units_are_scanned_once(stored, scope):
    request = M.Request("tion", scope=scope)
    for rows in (stored.hits(request), stored.ranked(request)):
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert sum("FileScan parquet" in line and "text#" in line for line in plan.splitlines()) == (scope != M.Scope.NAME), plan


def test_search_runs_the_page_alone(stored, spark):
    request = M.Request("tion", scope=M.Scope.CONTENT, limit=5)
    page = stored.search(request)
    assert page.total == stored.hits(request).count() > 5 and page.truncated and page.rows.count() == 5
    assert [r["file_id"] for r in page.rows.orderBy("rank").collect()] == [r["file_id"] for r in stored.ranked(request).orderBy("rank").collect()]
    beyond = stored.search(M.Request("tion", scope=M.Scope.CONTENT, limit=5, offset=10_000))
    assert beyond.total == page.total and beyond.rows.count() == 0


def test_every_term_needs_a_unit_of_the_file(engine):
    assert ids(engine, "annual report", scope=M.Scope.CONTENT) == {3: "content"}
    assert ids(engine, "annual nothing") == {}


def test_options(engine):
    c = M.Scope.CONTENT
    assert ids(engine, "Budget", scope=c, match_case=True) == {1: "content", 2: "content"}
    assert ids(engine, "budget", scope=c, match_case=True) == {}
    assert ids(engine, "udget", scope=c, whole_word=True) == {2: "content"}
    assert ids(engine, "bud?et r*t", scope=c) == {2: "content"}
    assert ids(engine, '"annual budget"', scope=c) == {1: "content"}


def test_compat_mode_ands_candidates_only(engine):
    args = dict(scope=M.Scope.CONTENT, whole_word=True)
    assert ids(engine, "udget budget", **args) == {2: "content"}
    assert ids(engine, "udge budget", **args) == {}
    assert ids(engine, "udge budget", compat=True, **args) == {1: "content", 2: "content"}


def test_filters(engine):
    assert ids(engine, "budget", filters=M.Filters(extensions=frozenset({".docx"}))) == {2: "content"}
    assert ids(engine, "budget", filters=M.Filters(modified_after=1000.0)) == {1: "both", 2: "content"}
    assert ids(engine, "budget", filters=M.Filters(max_size=100, min_size=100)) == {1: "both"}
    assert ids(engine, "budget", filters=M.Filters(subfolder="D:/r/a")) == {1: "both"}
    assert ids(engine, "budget", filters=M.Filters(subfolder="D:/r/a"), compat=True) == {1: "both", 2: "content"}


def test_scores_stay_in_their_bands(engine):
    scores = {r["file_id"]: r["score"] for r in engine.hits(M.Request("budget", root_id=1)).collect()}
    assert 960 <= scores[1] <= 975 and 600 <= scores[3] <= 675 and 200 <= scores[2] <= 255
    assert ranking.TERM + ranking.MATCH_CAP + ranking.RECENCY + ranking.BOTH < ranking.PHRASE


def test_sorting_and_paging(engine):
    page = lambda **kw: [r["file_id"] for r in engine.ranked(M.Request("budget", root_id=1, **kw)).orderBy("rank").collect()]
    assert page() == [1, 3, 2] and page(descending=False) == [2, 3, 1]
    assert page(sort=M.SortField.SIZE) == [2, 1, 3] and page(sort=M.SortField.MODIFIED) == [2, 1, 3]
    assert page(sort=M.SortField.NAME, descending=False) == [1, 3, 2]
    assert page(limit=1, offset=1) == [3] and page(offset=9) == []


def test_search_never_raises_for_bad_queries(engine):
    for raw, code in (("", "query_empty"), ("x" * 600, "query_too_long"), ("' OR 1=1 --", None), ("%_\\", None), ('"unclosed', None)):
        p = engine.search(M.Request(raw, root_id=1))
        assert p.total == 0 and (code is None or p.warnings == (code,))
    p = engine.search(M.Request("budget", root_id=1, limit=2))
    assert (p.total, p.truncated, p.rows.count()) == (3, True, 2)


def test_locations_and_existence(engine, spark):
    r = M.Request("budget", root_id=1, scope=M.Scope.CONTENT)
    found = engine.locations(r, engine.hits(r)).select("file_id", "sequence").collect()
    assert sorted(map(tuple, found)) == [(1, 1), (2, 1)]
    listing = spark.createDataFrame([("d:\\r\\a\\budget.txt",)], "normalized_path string")
    assert {r["file_id"]: r["exists"] for r in existence(engine.files, listing).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def _snippet(spark, text, query, **options):
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(snippets.snippet(parse(query).terms, F.col("t"), **options).alias("s")).first()["s"]
    return found and (found["snippet"], [tuple(h) for h in found["highlights"]])


def _spans(spark, text, query, **options):
    df = spark.createDataFrame([(text,)], "t string")
    return [tuple(s) for s in df.select(snippets.spans(parse(query).terms, F.col("t"), **options).alias("s")).first()["s"]]


def test_snippets(spark):
    text = "x " * 200 + "the Budget, again" + " y" * 400
    shown, marks = _snippet(spark, text, "budget")
    assert shown.startswith("… ") and shown.endswith(" …") and len(shown) <= M.SNIPPET_LENGTH + 4
    assert [shown[a:b] for a, b in marks] == ["Budget"]
    assert _snippet(spark, "nothing", "budget") is None and _snippet(spark, "", "budget") is None and _snippet(spark, None, "budget") is None
    assert _spans(spark, "bud x et bud", "bud*et") == [(0, 3), (6, 8), (9, 12)] and _spans(spark, "et bud", "bud*et") == []
    assert _spans(spark, "a ba a", "a", whole_word=True) == [(0, 1), (5, 6)]
    merged = spark.range(1).select(snippets.merged_spans(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(0, 2), (2, 4), (6, 7), (3, 5)]))).alias("m")).first()["m"]
    assert [tuple(s) for s in merged] == [(0, 5), (6, 7)]


def test_snippet_cases(spark):
    shown, marks = _snippet(spark, "prefix " * 40 + "NEEDLE" + " suffix" * 40, "needle")
    assert "NEEDLE" in shown and shown.startswith("… ") and shown.endswith(" …") and len(shown) <= M.SNIPPET_LENGTH + 4
    shown, marks = _snippet(spark, "งบประมาณครุภัณฑ์ประจำปี ๒๕๖๘ ของสำนักงานอธิการบดี", "ครุภัณฑ์")
    assert [shown[a:b] for a, b in marks] == ["ครุภัณฑ์"]
    shown, marks = _snippet(spark, "x" * 300 + "needle" + "y" * 300, "needle")
    assert shown.startswith("… ") and [shown[a:b] for a, b in marks] == ["needle"]
    assert _snippet(spark, "one\n\t budget  x", "budget") == ("one budget x", [(4, 10)])


def _plain_snippet(text, needle, context=130, longest=500, soft=" \t\n,.;:!?)]}ๆ"):
    """The rule of a snippet's window, letter by letter, for one lower-case literal."""
    at = [i for i in range(len(text)) if text.startswith(needle, i)][:32]
    if not at:
        return None

    def snapped(start, end):
        behind = [i + 1 for i in range(max(1, start - 13), min(start + 1, len(text))) if text[i] in soft] if start else []
        ahead = [i + 1 for i in range(end, min(end + 14, len(text))) if text[i] in soft]
        return (behind[-1] if behind else start), (ahead[0] if ahead else min(end, len(text)))

    start = max(0, at[0] - context)
    end = at[0] + len(needle)
    for i in at:
        if i + len(needle) - start > longest:
            break
        end = max(end, i + len(needle))
    start, end = snapped(start, min(len(text), end + context))
    if end - start > longest:
        start, end = snapped(start, start + longest)
    return "… " * (start > 0) + " ".join(text[start:end].split()) + " …" * (end < len(text))


def test_snippets_against_the_rule(spark):
    import random

    rng = random.Random(8)
    texts = ["".join(rng.choice(["needle", "x" * rng.randint(1, 40), " ", ", ", ".\n", "ๆ"]) for _ in range(rng.randint(1, 160))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", snippets.snippet(parse("needle").terms, F.col("t"))["snippet"].alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _plain_snippet(t, "needle"), repr(t)


def test_name_highlights(spark):
    df = spark.createDataFrame([("My Budget budget.txt",), ("none",), (None,)], "n string")
    got = [[tuple(s) for s in r[0]] for r in df.select(snippets.name_highlights(parse("budget my"), F.col("n"))).collect()]
    assert got == [[(0, 2), (3, 9), (10, 16)], [], []]


def test_snippet_column_widens_short_units(spark):
    df = spark.createDataFrame([("budget", "before it, budget, after it"), ("none", None)], "t string, j string")
    got = [tuple(r) for r in df.select(snippets.snippet_column(parse("budget"), F.col("t"), joined=F.col("j")).alias("s")).select("s.snippet", F.size("s.highlights")).collect()]
    assert got == [("before it, budget, after it", 1), (None, -1)] or got == [("before it, budget, after it", 1), (None, None)]


def test_native_spans(spark):
    df = spark.createDataFrame([("aXa.xA",), ("",), ("aaa",)], "t string")
    got = [[tuple(s) for s in r[0]] for r in df.select(snippets.literal_spans(F.col("t"), "a")).collect()]
    assert got == [[(0, 1), (2, 3), (5, 6)], [], [(0, 1), (1, 2), (2, 3)]]
    got = [[tuple(s) for s in r[0]] for r in df.select(snippets.merged_spans(snippets.literal_spans(F.col("t"), "a"))).collect()]
    assert got == [[(0, 1), (2, 3), (5, 6)], [], [(0, 3)]]


def test_contexts(spark):
    cells = spark.createDataFrame([(1, "s", 1, i, i, f"c{i}") for i in range(1, 12)] + [(1, "s", 2, 1, 12, "x"), (1, "t", 1, 1, 13, "y")], "file_id long, sheet string, row_no int, column_no int, sequence int, text string")
    got = {r["sequence"]: r["context"] for r in context.with_row_context(cells, cells.filter("sequence in (2, 12)")).collect()}
    assert got == {2: "c2  |  c1  |  c3  |  c4  |  c5  |  c6  |  c7  |  c8  |  c9", 12: "x"}
    units = spark.createDataFrame([(1, i, f" u{i} ") for i in range(1, 7)], "file_id long, sequence int, text string")
    got = {r["sequence"]: (r["n_units"], r["joined"]) for r in context.with_neighbours(units, units.filter("sequence in (1, 4)")).collect()}
    assert got == {1: (3, "u1 u2 u3"), 4: (5, "u2 u3 u4 u5 u6")}
