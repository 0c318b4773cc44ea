import io
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quarry import model as M
from quarry.operators.indexing import Indexer
from quarry.operators.search import SearchEngine
from quarry.sources import adapters, listing, settings
from quarry.sources.parsers import format_cell, is_binary, parse_bytes, parse_files
from quarry.sources.store import SchemaTooNew, SnapshotStore
from quarry.streaming import refresh

THAI = "งบประมาณ ครุภัณฑ์"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def docx() -> bytes:
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, span=1: f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/></w:tcPr>{p(t)}</w:tc>'
    body = p(THAI) + p("") + f"<w:tbl><w:tr>{cell('wide', 2)}{cell('x')}</w:tr><w:tr>{cell('a')}{cell('b')}{cell('c')}</w:tr></w:tbl>" + p("a &lt;b&gt;") + '<w:sectPr><w:headerReference w:type="default" r:id="h1"/></w:sectPr>'
    return zipped({
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/header1.xml": f"<w:hdr {W}>{p('top line')}</w:hdr>",
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="h1" Target="header1.xml"/></Relationships>',
    })


def xlsx() -> bytes:
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>45000</v></c></row><row r="12"><c r="F12" t="inlineStr"><is><t>deep</t></is></c><c r="G12"><v>1234.5</v></c><c r="H12" s="1"><v>45292</v></c><c r="I12" t="b"><v>1</v></c><c r="J12"><f>A1</f></c></row>'
    return zipped({
        "xl/workbook.xml": f'<workbook {W}><sheets><sheet name="งบ" r:id="r1"/><sheet name="no" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></R>',
        "xl/sharedStrings.xml": f"<sst><si><t>{THAI}</t></si></sst>",
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>",
        "xl/worksheets/sheet2.xml": '<worksheet><sheetData><row r="1"><c r="A1"><v>9</v></c></row></sheetData></worksheet>',
    })


def pdf(pages: list[str], encrypt: bool = False) -> bytes:
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(pages)))}] >>"]
    out = [b"%PDF-1.4\n"]
    streams = {}
    for i, text in enumerate(pages):
        objects.append(f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>")
        streams[len(objects)] = zlib.compress(f"BT /F1 12 Tf 72 720 Td ({text}) Tj ET".encode("latin-1"))
        objects.append("")
    for n, o in enumerate(objects, 1):
        if n - 1 in streams:
            s = streams[n - 1]
            out.append(f"{n} 0 obj << /Length {len(s)} /Filter /FlateDecode >>\nstream\n".encode() + s + b"\nendstream\nendobj\n")
        else:
            out.append(f"{n} 0 obj {o} endobj\n".encode())
    return b"".join(out) + (b"trailer << /Encrypt 9 0 R >>" if encrypt else b"trailer << /Root 1 0 R >>")


def parsed(name, data):
    row = parse_bytes(name, data)
    return row["outcome"], [(u["location_type"], u["location_label"], u["text"]) for u in row["units"]], row


def test_text_encodings():
    assert parsed("a.txt", f"{THAI}\n\nb  c\r\nd\re".encode())[1] == [("line", "Line 1", THAI), ("line", "Line 3", "b c"), ("line", "Line 4", "d"), ("line", "Line 5", "e")]
    for data, encoding in ((b"\xef\xbb\xbfx", "utf-8-sig"), ("x".encode("utf-16"), "utf-16"), ("x".encode("utf-32"), "utf-32"), (THAI.encode("cp874"), "cp874"), (b"\xe9", "cp874")):
        outcome, units, row = parsed("a.txt", data)
        assert (outcome, row["encoding"]) == ("ok", encoding) and "﻿" not in units[0][2]
    assert parsed("a.txt", bytes(range(32)) * 9)[0] == "no_text" and is_binary(b"\0") and not is_binary(b"plain\n")
    assert parsed("a.txt", b"")[0] == "empty" and parsed("a.txt", None)[0] == "missing" and parsed("a.exe", b"x")[0] == "unsupported"
    _, units, row = parsed("a.txt", b"x" * 250_000)
    assert len(units[0][2]) == M.MAX_LINE_CHARS and row["warnings"] == ["limit_exceeded"]


def test_docx():
    outcome, units, _ = parsed("a.docx", docx())
    assert outcome == "ok" and units == [
        ("paragraph", "Paragraph 1", THAI), ("table_cell", "Table 1, row 1, column 1", "wide"), ("table_cell", "Table 1, row 1, column 3", "x"),
        ("table_cell", "Table 1, row 2, column 1", "a"), ("table_cell", "Table 1, row 2, column 2", "b"), ("table_cell", "Table 1, row 2, column 3", "c"),
        ("paragraph", "Paragraph 3", "a <b>"), ("header", "Header", "top line"),
    ]
    assert parsed("a.docx", b"PK\x03\x04junk")[0] == "corrupt" and parsed("a.docx", zipped({"x": "y"}))[0] == "corrupt"
    assert parsed("a.docx", zipped({"word/document.xml": b"<a>" + b"0" * (20 << 20)}))[0] == "corrupt"
    assert parsed("a.docx", b"\xd0\xcf\x11\xe0" + b"x" * 600)[0] == "password_protected"


def test_xlsx():
    outcome, units, row = parsed("a.xlsx", xlsx())
    assert outcome == "ok" and row["sheet_count"] == 1
    assert [(u[1], u[2]) for u in units] == [("Sheet: งบ, Cell: A1", THAI), ("Sheet: งบ, Cell: B1", "45000"), ("Sheet: งบ, Cell: F12", "deep"), ("Sheet: งบ, Cell: G12", "1234.5"), ("Sheet: งบ, Cell: H12", "2024-01-01"), ("Sheet: งบ, Cell: I12", "TRUE")]
    assert [format_cell(v) for v in (None, True, 3, 2.0, 0.1 + 0.2, float("nan"))] == ["", "TRUE", "3", "2", "0.3", ""]


def test_pdf():
    outcome, units, row = parsed("a.pdf", pdf(["first page \\(one\\)", "", "third"]))
    assert outcome == "ok" and row["page_count"] == 3
    assert [(u["sequence"], u["text"]) for u in row["units"]] == [(1, "first page (one)"), (3, "third")]
    assert parsed("a.pdf", pdf(["x"], encrypt=True))[0] == "password_protected"
    assert parsed("a.pdf", b"junk")[0] == "corrupt" and parsed("a.pdf", pdf([""]))[0] == "no_text"


def test_parse_files_is_total(spark):
    df = spark.createDataFrame([("a.docx", bytearray(docx())), ("b.txt", bytearray(b"one\ntwo")), ("c.pdf", bytearray(b"x"))], "path string, content binary")
    got = {r["path"]: (r["outcome"], len(r["units"])) for r in parse_files(df).collect()}
    assert got == {"a.docx": ("ok", 8), "b.txt": ("ok", 2), "c.pdf": ("corrupt", 0)}


def test_listing_of_a_store(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": b"one", "sub/b.pdf": b"four", ".hidden.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["file_name"]: (r["size_bytes"], r["hidden"], r["modified_time"] > 1e9) for r in listing.list_store(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == (3, False, True) and got["b.pdf"] == (4, False, True)


def test_root_verdicts(tmp_path):
    for raw, want in {"": "empty", "http://x/y": "url", "\\\\.\\C:": "device", "\\\\srv\\x": "network", "rel": "no_drive", "/no/such": "not_found", __file__: "not_a_directory", str(tmp_path): "ok"}.items():
        assert listing.validate_root(raw) == want


def test_indexing_cycle(spark, tmp_path):
    root, store = tmp_path / "เอกสาร", SnapshotStore(spark, str(tmp_path / "store"))
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    for name, data in {"a.txt": THAI.encode(), "sub/b.docx": docx(), "c.xlsx": xlsx(), "bad.pdf": b"x", "blank.txt": b" \n", "~$lock.docx": b"x", "run.exe": b"x", "zero.txt": b"", ".git/x.txt": b"x", "pic.png": b"x"}.items():
        (root / name).write_bytes(data)
    index = Indexer(spark, store)
    first = index.run(str(root))
    assert (first["files_discovered"], first["files_indexed"], first["files_no_text"], first["files_failed"], first["files_skipped"]) == (5, 3, 1, 1, 3)
    ids = {r["file_name"]: r["file_id"] for r in store.read("files").collect()}
    second = index.run(str(root))
    assert (second["files_unchanged"], second["files_new"], second["files_deleted"]) == (5, 0, 0)
    (root / "a.txt").write_bytes(b"changed budget\n")
    (root / "d.txt").write_bytes(b"budget")
    os.remove(root / "c.xlsx")
    third = index.run(str(root))
    assert (third["files_unchanged"], third["files_new"], third["files_deleted"], third["files_indexed"]) == (3, 1, 1, 2)
    files, units = store.read("files"), store.read("units")
    now = {r["file_name"]: r["file_id"] for r in files.collect()}
    assert now["a.txt"] == ids["a.txt"] and "c.xlsx" not in now and now["d.txt"] not in ids.values()
    assert units.join(files.select("file_id"), "file_id", "left_anti").count() == 0
    engine = SearchEngine(files, units)
    assert {r["file_name"] for r in engine.hits(M.Request("budget", root_id=1)).collect()} == {"a.txt", "d.txt"}
    assert {r["file_name"] for r in engine.hits(M.Request("ครุภัณฑ์", root_id=1)).collect()} == {"b.docx"}
    before = store.read("units").count()
    assert store.read("runs").count() == 3 and store.expire() and store.expire() == [] and store.read("units").count() == before == units.count()
    index.delete_root(str(root))
    assert store.read("files").count() == 0 and store.read("roots").count() == 0


def test_store(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.current() is None and store.read("t") is None
    store.publish({"t": spark.range(10)})
    store.compact("t", ["id"], 2)
    assert store.read("t").count() == 10
    with pytest.raises(Exception):  # noqa: B017 - a failed write leaves the old version in place
        store.publish({"t": spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))})
    assert store.read("t").count() == 10
    monkeypatch.setattr(M, "SCHEMA_VERSION", 0)
    with pytest.raises(SchemaTooNew):
        store.current()
    monkeypatch.undo()
    assert store.quarantine() and store.current() is None


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert settings.load(path) == settings.Settings()
    settings.save(path, settings.Settings(result_limit=99_999))
    assert settings.load(path).result_limit == 5000
    (tmp_path / "s.json").write_text('{"result_limit": "x", "other": 1, "hidden_files": true}')
    assert settings.load(path) == settings.Settings(hidden_files=True)
    (tmp_path / "s.json").write_text("[")
    assert settings.load(path) == settings.Settings()


def test_adapters(spark, sf_dir):
    units = adapters.units(spark, sf_dir)
    assert units.filter("text = '' or sequence < 1").count() == 0
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_event_counts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert refresh.event_counts(events).agg(F.sum("n")).first()[0] == events.count()
