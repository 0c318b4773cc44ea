"""Every stage of the pipeline, and the scores of its classifiers, against plain versions."""

import itertools
import math
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import langid, packing, quality, registry
from quarry.llm.common import staged


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def language_model(docs):
    return langid.train(langid.labelled_sample(docs))


@pytest.fixture(scope="module")
def quality_model(spark, docs, sf_dir):
    return quality.train(quality.labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def plain_language(text, model):
    """The mean of the embeddings' logits over all n-grams, one by one."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    words = re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())
    data = b" " + b" ".join(words) + b" "
    total, n = np.zeros(len(model.langs)), 0
    for size in (2, 3, 4):
        for i in range(len(data) - size + 1):
            gram = data[i : i + size]
            if b" " in gram[1:-1]:
                continue
            number = int.from_bytes(gram, "big")
            total += model.weights[((number ^ (size * 0x3C6EF372) % 2**32) * 2654435761 % 2**32) >> 16]
            n += 1
    z = (total / n + model.bias) / model.temperature
    p = [math.exp(x - max(z)) for x in z]
    best = max(range(len(p)), key=lambda i: (p[i], -i))
    return model.langs[best], p[best] / sum(p)


def test_language_scores(spark, sf_dir, texts, language_model):
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_language_id"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        if len(text or "") > 6000:
            continue
        lang, score = plain_language(text, language_model)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-4


def test_languages_share_the_sample(spark):
    rows = [(i, f"{lang} word{i}", lang) for i, lang in enumerate(["a"] * 500 + ["b"] * 40 + ["c"] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.labelled_sample(df, 90)
    n = {lang: sum(x == lang for _, x in sample) for lang in "abc"}
    trained = {lang: sum(1 for i, _, x in rows if x == lang and __import__("zlib").crc32(str(i).encode()) % 3 != 1) for lang in "abc"}
    assert n["c"] == trained["c"] and n["b"] == min(trained["b"], 44) and 30 <= n["a"] <= 90 - n["b"] - n["c"]
    assert langid.labelled_sample(df.limit(0)) == []


def test_rejection(language_model):
    """Letters in no order of any language mostly fall below the threshold; whole documents of known ones do not."""
    rng = np.random.default_rng(1)
    noise = ["".join(rng.choice(list("qxzwkjvyp"), 8)) + " " + "".join(rng.choice(list("äßçøþ"), 5)) for _ in range(100)]
    scores = [language_model.predict(x)[1] for x in noise]
    assert 0 < language_model.threshold <= 0.5 and all(0 <= s <= 1 for s in scores)
    assert np.mean(scores) < 0.97


def plain_quality(text, model):
    """Marginals by enumeration of all labellings (short texts), by sums of logs otherwise; weighted mean; logistic."""
    x, weights = quality.document_features(text)
    u = []
    for t in range(len(x)):
        s = float(x[t] @ model.own)
        s += float(x[t - 1] @ model.prev) if t else 0.0
        s += float(x[t + 1] @ model.next) if t + 1 < len(x) else 0.0
        u.append(max(-30.0, min(30.0, s)))
    n, move = len(u), model.move
    if n <= 9:
        good, total = np.zeros(n), 0.0
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(s for s, on in zip(u, y) if on) + sum(move[a][b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        p = good / total
    else:
        unary = [(0.0, s) for s in u]
        f, b = [list(unary[0])], [[0.0, 0.0]]
        for t in range(1, n):
            f.append([np.logaddexp(f[-1][0] + move[0][y], f[-1][1] + move[1][y]) + unary[t][y] for y in (0, 1)])
        for t in range(n - 2, -1, -1):
            b.append([np.logaddexp(move[y][0] + unary[t + 1][0] + b[-1][0], move[y][1] + unary[t + 1][1] + b[-1][1]) for y in (0, 1)])
        b.reverse()
        p = np.array([1 / (1 + math.exp(max(-700.0, min(700.0, f[t][0] + b[t][0] - f[t][1] - b[t][1])))) for t in range(n)])
    z = model.slope * float(p @ weights / weights.sum()) + model.shift
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_quality_scores(spark, sf_dir, texts, quality_model):
    got = {r["doc_id"]: r for r in registry.QUERIES["op5_quality"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        score = plain_quality((text or "").encode(), quality_model)
        assert abs(got[i]["score"] - score) < 1e-6 and got[i]["predicted"] == (got[i]["score"] >= 0.7)


def _kept(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark, sf_dir, docs, texts):
    """Each stage's rows from a plain version of it, on what its predecessor kept."""
    now, held = docs, texts
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = staged(stage(spark, now, sf_dir), f"test-{name}")
        assert result.columns == docs.columns
        if name == "language_id":
            model = langid.train(langid.labelled_sample(now))
            want = {i for i, t in held.items() if model.predict(t or "")[0] != "und" and model.predict(t or "")[1] >= model.threshold}
        elif name == "quality":
            model = quality.train(quality.labelled_sample(now, spark.read.parquet(f"{sf_dir}/labels.parquet")))
            want = {i for i, t in held.items() if plain_quality((t or "").encode(), model) >= quality.THRESHOLD}
        elif name == "exact_dedup":
            best = {}
            for i, t in held.items():
                key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
                best[key] = min(best.get(key, (0, math.inf)), (-len(t or ""), i))
            want = {i for _, i in best.values()}
        else:
            want = _near(held)
        now, held = result, _kept(result)
        assert held.keys() == want, name
    pieces = corpus_pipeline.pack(spark, now, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in held.items():
        at = 0
        for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and 0 < r["length"] <= packing.CAPACITY
            at += r["length"]
        assert at == len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    ends = {}
    for r in pieces:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(o == sum(n for _, n in sorted(own)[:k]) for own in ends.values() for k, (o, _) in enumerate(sorted(own)))


def _near(held):
    """The least id of each component of the pairs with similarity 0.8 or more."""
    sets = {i: frozenset(tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))) if (t or "").split() else frozenset() for i, t in held.items()}
    root = {i: i for i in held}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(held), 2):
        a, b = sets[i], sets[j]
        if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i for i in held if find(i) == i}
