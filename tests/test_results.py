"""Snippets of a page, settings, page labels, drive verdicts, retries, subfolders."""


import pytest
from py4j.protocol import Py4JJavaError

from quarry import model as M
from quarry.operators import search
from quarry.operators.indexing import Indexer
from quarry.sources import listing
from quarry.sources.parsers import Pdf, parse_bytes
from quarry.sources.settings import Settings
from quarry.sources.store import SnapshotStore
from tests.test_sources import THAI, docx, pdf, xlsx


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root, at = tmp_path_factory.mktemp("docs"), SnapshotStore(spark, str(tmp_path_factory.mktemp("store")))
    (root / "b.xlsx").write_bytes(xlsx())
    (root / "d.docx").write_bytes(docx())
    (root / "n.md").write_bytes(b"first line\nthe budget\nlast line\n")
    Indexer(spark, at, **Settings(optional_formats=True, docx_headers=False).for_indexer()).run(str(root))
    return at


def _shown(store, query):
    engine = search.SearchEngine(store.read("files"), store.read("units"))
    request = M.Request(query, scope=M.Scope.CONTENT)
    return {(r["location_type"], r["sequence"]): (r["snippet"], [r["snippet"][h["start"] : h["end"]] for h in r["highlights"]]) for r in engine.snippets(request, engine.ranked(request)).collect()}


def test_cells_show_their_row_and_short_lines_their_neighbours(store):
    found = _shown(store, THAI.split()[0])
    assert found["sheet_cell", 1] == (f"{THAI}  |  45000", [THAI.split()[0]])
    assert found["paragraph", 1][1] == [THAI.split()[0]]
    assert _shown(store, "budget") == {("line", 2): ("first line the budget last line", ["budget"])}


def test_settings_reach_indexer_and_search(store):
    assert {r["file_name"] for r in store.read("files").collect()} == {"b.xlsx", "d.docx", "n.md"}
    assert store.read("units").filter("location_type = 'header'").count() == 0
    assert Settings(result_limit=17).request("x").limit == 17 and Settings().request("x", limit=3).limit == 3


def test_a_search_is_tried_again_once(store, monkeypatch):
    class Gone(Py4JJavaError):
        def __init__(self):
            Exception.__init__(self)

    calls = []
    original = search.SearchEngine.search

    def flaky(self, request):
        calls.append(1)
        if len(calls) < 2:
            raise Gone
        return original(self, request)

    monkeypatch.setattr(search.SearchEngine, "search", flaky)
    assert search.search_store(store, M.Request("budget")).total == 1 and len(calls) == 2
    calls[:] = [1] * -5
    monkeypatch.setattr(search.SearchEngine, "search", lambda self, r: (_ for _ in ()).throw(Gone))
    with pytest.raises(Gone):
        search.search_store(store, M.Request("budget"))


def test_a_subfolder_outside_the_root_is_ignored():
    inside, outside = M.Filters(subfolder="D:/Docs/a"), M.Filters(subfolder="D:/Docs2")
    assert search.within_root(inside, "d:\\docs") == inside and search.within_root(outside, "d:\\docs").subfolder is None
    assert search.within_root(M.Filters(subfolder="D:/Docs"), "d:\\docs").subfolder == "D:/Docs"


def test_drive_verdicts(tmp_path):
    kinds = {"C": "fixed", "N": "remote", "E": "cdrom", "Q": "unknown"}.get
    assert [listing.validate_root(f"{x}:\\data", drive_kind=kinds) for x in "CNEQ"] == ["not_found", "remote", "cdrom", "unknown_drive"]
    assert listing.validate_root("data", drive_kind=kinds) == "no_drive" and listing.validate_root(str(tmp_path)) == "ok"


def test_page_labels():
    data = pdf(["one", "two", "three", "four", "five"])
    data = data.replace(b"/Type /Catalog", b"/Type /Catalog /PageLabels << /Nums [ 0 << /S /r >> 2 << /S /D /St 7 /P (A-) >> 4 << /P (end) >> ] >>")
    assert Pdf(data).page_labels(5) == ["i", "ii", "A-7", "A-8", "end"]
    row = parse_bytes("a.pdf", data)
    assert [u["location"].get("page_label") for u in row["units"]] == ["i", "ii", "A-7", "A-8", "end"]
    assert [u["location"].get("page_label") for u in parse_bytes("a.pdf", pdf(["x", "y"]))["units"]] == [None, None]
