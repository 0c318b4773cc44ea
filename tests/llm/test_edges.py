"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, exact_dedup, html_extract, katz, langid, license_scan, media, packing, quality, simhash
from quarry.llm.common import staged

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string, pos string, score string, row string, fp string"
LONG = "the quick brown fox jumps over the lazy dog and runs " * 12_000


def _rows():
    texts = [(1, None), (2, ""), (3, "   \n"), (4, "Same text here."), (4, "Same text here."), (None, "Same  text here."), (5, LONG), (6, "x"), (None, None), (7, "the mit license is here"), (8, "ß É ﬁ <|endoftext|> \x00 \U0001f600")]
    return [(i, t, "en" if i != 6 else None, None, None, "k", "d", "p", "s", "r", "f") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DDL).repartition(3, "doc_id", "text")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return langid.train(langid.labelled_sample(d)), quality.train(quality.labelled_sample(d, spark.read.parquet(f"{sf_dir}/labels.parquet")))


OPERATORS = {
    "op1": lambda d, m: media.describe(d), "op2": lambda d, m: bpe.digests(d), "op3": lambda d, m: license_scan.scan_licenses(d), "op5": lambda d, m: quality.classify(d, m[1]),
    "op6": lambda d, m: exact_dedup.find_copies(d), "op7": lambda d, m: katz.score_documents(d, training=F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)), shards=16),
    "op9": lambda d, m: langid.identify(d, m[0]), "op10": lambda d, m: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(name, docs, none, model):
    got = OPERATORS[name](docs, model).collect()
    assert len(got) == len(_rows())
    assert sum(r[0] is None if name not in ("op1",) else r["doc_id"] is None for r in got) == 2
    assert OPERATORS[name](none, model).collect() == []


def test_values_of_missing_and_blank_texts(docs, model):
    """Rows 1 to 3 are null, empty and blank; the last one has neither id nor text."""
    import hashlib

    nothing, found = hashlib.sha256(b"").hexdigest(), {}
    for name in OPERATORS:
        for r in OPERATORS[name](docs, model).collect():
            key = r["doc_id"] if "doc_id" in r.asDict() else r["id"]
            if key in (1, 2, 3):
                found[name, key] = r
    for k in (1, 2):
        r = found["op1", k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["n_items"], r["position"], r["caption"]) == (0, 64, hashlib.sha256(bytes(64)).hexdigest(), 2, 0, None)
        assert found["op1", 3]["n_bytes"] == 4 and found["op1", 3]["n_items"] == 2
        assert (found["op2", k]["n_tokens"], found["op2", k]["ids_sha256"], found["op2", k]["decoded_sha256"]) == (0, nothing, nothing)
        r = found["op3", k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (0, 0, None, None, "", "", 0)
        assert found["op5", k]["score"] == found["op5", 1]["score"] and 0 <= found["op5", k]["score"] <= 1
        assert (found["op6", k]["keep_id"], found["op6", k]["group_size"], found["op6", k]["text_sha256"]) == (3, 4, nothing)
        assert (found["op7", k]["n_tokens"], found["op7", k]["n_known"]) == (1, 1) and found["op7", k]["score"] < 0
        assert (found["op9", k]["lang_pred"], found["op9", k]["score"], found["op9", k]["rejected"]) == ("und", 0, True)
        assert (found["op10", k]["fp"], found["op10", k]["component_id"]) == (0, 1)
    for name in ("op2", "op3", "op9", "op10"):
        drop = ("doc_id", "id", "held_out")
        assert [v for c, v in found[name, 3].asDict().items() if c not in drop] == [v for c, v in found[name, 1].asDict().items() if c not in drop], name


def test_packing_edges(docs, none):
    got = packing.pack(docs).collect()
    assert packing.pack(none).collect() == []
    by_doc = {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r["length"])
    assert sum(sum(v) for v in by_doc.values()) == sum(len(packing.token_ids(t or "")) for _, t, *_ in _rows())
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_html_edges(spark):
    ddl = "page_id long, url string, html string, text string"
    pages = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (3, "u", "<p>", "t"), (3, "u", "<p>", "t"), (None, "u", "no tags at all", "t"), (4, "u", "<div>" * 3000 + "deep", "t"), (5, "u", "<article><p>A long enough paragraph, really. It has two sentences.</p><p>cut off &am", "t")], ddl)
    got = html_extract.extract(pages).collect()
    assert len(got) == 7 and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, 2, 3)] == [""] * 4
    assert html_extract.extract(spark.createDataFrame([], ddl)).collect() == []


def test_dedup_ties_and_order(spark):
    rows = [(9, "a b"), (3, "ab"), (5, "a  b"), (7, "a  b"), (None, "a  b"), (1, "c"), (1, "c")]
    got = exact_dedup.find_copies(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    ab = [r for r in got if r["group_size"] == 5]
    assert len(ab) == 5 and {r["keep_id"] for r in ab} == {5} and [r["doc_id"] for r in ab if r["kept"]] == [5]
    assert sum(r["kept"] for r in got if r["keep_id"] == 1) == 1


def test_stages_keep_columns_and_handle_edges(spark, docs, none, sf_dir):
    for d in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, d, sf_dir)
            if name != "packing":
                assert got.columns == d.columns, name
            got.write.format("noop").mode("overwrite").save()
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, sf_dir).collect() if r["doc_id"] in (1, 2, 3)) == []
    kept = corpus_pipeline.exact_copies(spark, docs, sf_dir).collect()
    assert len(kept) == 6 and sum((r["text"] or "").startswith("Same") for r in kept) == 1
    assert next(r for r in kept if (r["text"] or "").startswith("Same"))["doc_id"] is None  # the longest original


def test_whole_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        sizes.append(docs.count() if name != "packing" else docs.select("doc_id").distinct().count())
    assert all(a >= b > 0 for a, b in zip(sizes, sizes[1:])) and sizes[-1] == sizes[-2]
