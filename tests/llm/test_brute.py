"""Operators against plain versions of their contracts."""

import hashlib
import html
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, exact_dedup, html_extract, katz, langid, license_scan, media, packing, quality, registry, simhash
from quarry.llm.common import crc_mod


@pytest.fixture(scope="module")
def rows(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", ["op3_license_scan", "op6_exact_dedup"])
def test_sql(name, spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def _png(payload):
    """The bytes of an 8-bit grey PNG, 64 samples a row, by the PNG format."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + payload[i : i + 64] for i in range(0, len(payload), 64))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def _feature(payload):
    """Average hash of 8 x 8 block means, mean and entropy, sample by sample."""
    height = len(payload) // 64
    edges = [int(x) for x in np.linspace(0, height, 9)]
    means = []
    for lo, hi in zip(edges, edges[1:]):
        lo = min(lo, height - 1)
        hi = max(hi, lo + 1)
        for c in range(8):
            cell = [payload[64 * r + 8 * c + i] for r in range(lo, hi) for i in range(8)]
            means.append(sum(cell) / (hi - lo))
    bits = "".join("1" if m > sum(means) / 64 else "0" for m in means)
    share = [n / len(payload) for n in Counter(payload).values()]
    return int(bits, 2), sum(payload) / len(payload), -sum(x * math.log2(x) for x in share)


def test_media(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_media_columns"](spark, sf_dir).collect()}
    assert got.keys() == {i for i, _ in rows}
    for i, text in rows:
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        stored = _png(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        bits, mean, entropy = r["feature"].split("-")
        want = _feature(payload)
        assert bin(int(bits, 16) ^ want[0]).count("1") <= 1 and abs(float(mean) - want[1]) < 1e-3 and abs(float(entropy) - want[2]) < 1e-3
        # the sequence: text blocks, the whole behind the first, the tail behind the last
        blocks = [b for b in (" ".join(x.split()) for x in (text or "").split("\n")) if b]
        first, last = (" ".join(b[:80].split()) for b in ((blocks[0], blocks[-1]) if blocks else ("", "")))
        assert (r["n_items"], r["position"], r["tail_position"]) == (len(blocks) + 2, min(1, len(blocks)), len(blocks) + 1)
        assert (r["caption"] or "", r["tail_caption"] or "") == (first, last)


def test_unknown_digests_and_inline_payloads(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="media:none" alt="x"><p>b</p><img src="media:k" alt="y">')], "doc_id long, html string")
    refs = media.references(media.sequences(pages))
    table_ = spark.createDataFrame([("k", bytearray(media.encode_png(b"q" * 64))), ("big", bytearray(media.encode_png(b"r" * 128)))], "digest string, stored binary")
    features = media.media_features(table_)
    got = {r["position"]: (r["caption"], r["payload"] and bytes(r["payload"]), r["payload_bytes"]) for r in media.resolve(refs, features).collect()}
    assert got == {1: ("x", None, None), 3: ("y", b"q" * 64, 64)}
    assert {r["digest"]: r["payload"] is None for r in features.collect()} == {"k": False, "big": True}


def test_media_sequences():
    got = media.parse_interleaved('<p>one</p><figure><img src="media:ab" alt="x"><figcaption>cap <b>t</b></figcaption></figure><script>no</script>two<img src="http://e/x.png" alt="alt">three')
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in got] == [(0, "text", "one", None, None), (1, "media", None, "ab", "cap t"), (2, "text", "two", None, None), (3, "media", None, None, "alt"), (4, "text", "three", None, None)]
    for n in (64, 128, 6400):
        payload = random.Random(n).randbytes(n)
        assert media.decode_png(media.encode_png(payload)).tobytes() == payload
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(b"\1" * 64)[:-20] + b"\0" * 20)


def _tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_bpe(spark, sf_dir, rows):
    tok = _tokenizer("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_bpe_roundtrip"](spark, sf_dir).collect()}
    for i, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        r = got[i]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_tokenizers_on_odd_texts():
    rng, alphabet = random.Random(3), "aAbB'sStTreE  \n\t12é É　ΣςßǅİǺ!?.日本😀\x85\x1c​\xa0ᲊฅ"
    words, bytes_, own = _tokenizer("word_bpe_49k.json"), _tokenizer("byte_bpe_50k.json"), bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) + ("<|endoftext|>z" if k % 5 == 0 else "") + chr(rng.randrange(0xE000, 0x110000) if k % 7 == 0 else rng.randrange(0xD000))
        e = words.encode(text, add_special_tokens=False)
        (ids,) = own.encode_block([text])
        assert e.ids == list(memoryview(ids).cast("I")) and words.decode(e.ids, skip_special_tokens=False).encode() == own.decode(ids), repr(text)
        assert [*bytes_.encode(text, add_special_tokens=False).ids, 1] == packing.token_ids(text).tolist(), repr(text)


def test_license_places(spark):
    text = "MIT License, mit-license; CC BY-SA; mit licenses. GNU General Public License version 3"
    index = license_scan.RareTokenIndex({b"": 5, b"license": 4})
    words = license_scan.words_of(text.encode())
    found = sorted((index.templates[t].label, p) for t, p in index.places(words))
    assert found == [("cc-by", 4), ("gpl", 9), ("gpl-3.0", 9), ("mit", 0), ("mit", 2)]
    rng, vocabulary = random.Random(1), [b"mit", b"license", b"gnu", b"general", b"public", b"cc", b"by", b"apache", b"x"]
    for _ in range(2000):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 14))]
        want = sorted((t, p) for t, x in enumerate(index.templates) if len(x.keys) == 1 for p in range(len(words)) if tuple(words[p : p + x.keys[0][1]]) == x.words[x.keys[0][0] : sum(x.keys[0])])
        assert sorted(index.places(words)) == want


def test_packing(spark, sf_dir, rows):
    got = registry.QUERIES["op4_packing"](spark, sf_dir).collect()
    ids = {i: packing.token_ids(t or "") for i, t in rows}
    at, sequences = {}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {i: len(x) for i, x in ids.items()}
    used = 0
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)]))[:-1]
        used += sum(n for _, n in own)
        assert sum(n for _, n in own) <= 2048
    assert used / (2048 * len(sequences)) > 0.98


def test_slack_plans():
    rng = random.Random(2)
    for k in range(60):
        counts = {rng.randint(1, 63): rng.randint(1, 4) for _ in range(rng.randint(1, 9))}
        best = packing.best_fill(counts, 64)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * j for s in sums for j in range(n + 1) if s + length * j <= 64}
        assert sum(x * n for x, n in best.items()) == max(sums) and all(n <= counts[x] for x, n in best.items())
    for histogram in ({1300: 5000}, {1300: 999, 7: 3}, {2047: 10, 1: 5}, {x: 1 + x % 7 for x in range(1, 2048)}, {1024: 1}, {}):
        places, n = packing.solve(histogram)
        total = sum(x * c for x, c in histogram.items())
        assert sum((hi - lo) * length for _, lo, hi, _, length, *_ in places.tolist()) == total
        assert n * 2048 - total < 2048 * max(2, n * 0.01)
    a, b = b"some bytes", b"and more of them"
    assert packing.crc_of_suffix(zlib.crc32(a + b), zlib.crc32(a), len(b)) == zlib.crc32(b)


def test_quality(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    got = registry.QUERIES["op5_quality"](spark, sf)
    held = got.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in held)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_chain_marginals_against_enumeration():
    crf, rng = quality.Crf(), np.random.default_rng(1)
    crf.own, crf.prev, crf.next, crf.move = rng.normal(size=20), rng.normal(size=20), rng.normal(size=20), rng.normal(size=(2, 2))
    x, _ = quality.document_features(b"One line.\nTWO!! LINES!!\n\nfour | five |")
    u = crf.potentials(x)
    weight = np.zeros((4, 2))
    for k in range(16):
        y = [k >> t & 1 for t in range(4)]
        w = math.exp(sum(u[t] * y[t] for t in range(4)) + sum(crf.move[a, b] for a, b in zip(y, y[1:])))
        for t in range(4):
            weight[t, y[t]] += w
    assert np.allclose(crf.marginals(x), weight[:, 1] / weight.sum(axis=1))


@pytest.mark.parametrize("digest, memtable", [(exact_dedup.sha256, 1 << 20), (exact_dedup.sha256, 500), (lambda b: hashlib.sha256(b).digest()[:1], 1 << 20)])
def test_dedup_in_many_runs_and_with_colliding_digests(docs, rows, digest, memtable):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    got = exact_dedup.find_copies(docs.repartition(3), digest_of=digest, memtable_bytes=memtable, filter_bits=1 << 15).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_dedup_of_more_hits_than_are_broadcast(docs):
    few, many = (sorted(map(tuple, exact_dedup.find_copies(docs, memtable_bytes=500, ranges=3, broadcast_hits=n).select("doc_id", "keep_id", "group_size", "kept").collect())) for n in (0, 10**6))
    assert few == many
    two = docs.limit(2).selectExpr("doc_id", "concat('text ', doc_id) AS text")
    for n in (0, 10):
        index = two.selectExpr("CAST('d' AS binary) AS digest", "2L AS runs").distinct()
        bodies = two.selectExpr("CAST('d' AS binary) AS digest", "CAST(text AS binary) AS body")
        assert not exact_dedup.verified(index, bodies, n) and exact_dedup.verified(index, bodies.limit(1), n)


def test_unknown_sizes(spark):
    """A plan that can't tell its size gets a bounded number of shards."""
    rdd = spark.sparkContext.parallelize([(1, "a b")])
    df = spark.createDataFrame(rdd, "doc_id long, text string")
    assert katz.shard_count(df) <= 1 << 8 and exact_dedup.range_count(df) <= 64


@pytest.mark.parametrize("block", [katz.BLOCK_BYTES, 60_000])
def test_katz(docs, rows, block):
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), "\n"] for i, t in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    words = Counter(w for i in train for w in tokens[i])
    pairs = Counter(p for i in train for p in zip(["\n", *tokens[i]], tokens[i]))
    n, v = sum(words.values()), len(words)

    def discounts(counts):
        c = Counter(counts.values())
        share = 6 * c[6] / c[1]
        out = {}
        for r in range(1, 6):
            d = ((r + 1) * c[r + 1] / (r * c[r]) - share) / (1 - share) if c[r] and share < 1 else 0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    d1, d2 = discounts(words), discounts(pairs)
    p = {w: d1.get(c, 1) * c / n for w, c in words.items()}
    unknown = 1 - sum(p.values())
    after = {}
    for (a, b), c in pairs.items():
        after.setdefault(a, {})[b] = c
    model = {}
    for a, s in after.items():
        c_a, shrink = words[a], 1.0
        kept = sum(d2.get(c, 1) * c for c in s.values()) / c_a
        if 1 - kept < 1 / (c_a + 1):
            shrink, kept = c_a / (c_a + 1) / kept, c_a / (c_a + 1)
        model[a] = ({b: shrink * d2.get(c, 1) * c / c_a for b, c in s.items()}, (1 - kept) / (1 - sum(p[b] for b in s)))
    for seen, alpha in list(model.values())[:200]:  # exactly normalised
        assert math.isclose(sum(seen.values()) + alpha * (unknown + sum(x for w, x in p.items() if w not in seen)), 1, rel_tol=1e-9)

    def log_p(a, b):
        seen, alpha = model.get(a, ({}, 1.0))
        return math.log10(seen[b] if b in seen else alpha * p.get(b, unknown))

    got = {r["doc_id"]: r for r in katz.score_documents(docs.repartition(3), training=crc_mod(F.col("doc_id"), 5) != 1, block_bytes=block, shards=16).collect()}
    for i, own in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in words for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(log_p(a, b) for a, b in zip(["\n", *own], own)), rel_tol=1e-9)


def test_katz_cells_grow_with_the_input(spark, monkeypatch):
    """More shards than a block has words: a cell for each word at most, none that is empty."""
    import pyarrow as pa

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(katz, "TaskContext", Context)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c", "c d"]), pa.array([False, False])], names=["doc_id", "text", "held_out"])
    for shards in (16, 1 << 16):
        kinds = [k for b in katz._blocks(shards, 1 << 20)([batch]) for k in b.column(0).to_pylist()]
        assert kinds.count("docs") == 1 and 0 < kinds.count("words") <= 5


def test_katz_parts():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 28, 1000)
    a[:500] >>= 20
    assert (katz.unvarints(katz.varints(a)) == a).all() and len(katz.unvarints(katz.varints(a[:0]))) == 0
    for x, y in zip(katz.unpack(katz.pack(a.astype(np.uint64), a[:0].astype(np.float32))), (a, a[:0])):
        assert (x == y).all()
    texts = [b"", b" a  B\n", b"a b", b"x" * 300 + b" " + b"x" * 301, b"x" * 300]
    h, n = katz.token_hashes(texts)
    assert n.tolist() == [1, 3, 3, 3, 2] and h[1] == h[4] and h[2] == h[5] and h[7] == h[10] != h[8] and len(set(h.tolist())) == 5


def test_html(spark, sf_dir):
    def plain(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>|</?p>|</?h1>", " ", body))).split())

    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall())
    got = {r["page_id"]: r["text"] for r in registry.QUERIES["op8_html_extraction"](spark, sf_dir).collect()}
    assert got == {i: plain(h) for i, h in pages.items()}


def test_html_foreign_attributes_and_deep_pages():
    """Attribute words that no made-up page has, and pages nested 100,000 deep."""
    import time

    trees = html_extract.model()
    prose = "".join(f"<p>Sentence number {i} of the story, which goes on for a while. It has two sentences.</p>" for i in range(6))
    page = f'<html><body><nav class="qzmenu"><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li><li><a href="/c">Help</a></li></ul></nav><article class="xqtopic">{prose}</article><footer class="zzend">All rights.</footer></body></html>'
    want = " ".join(f"Sentence number {i} of the story, which goes on for a while. It has two sentences." for i in range(6))
    assert html_extract.main_texts([page], trees) == [want]
    began = time.time()
    for tag in ("center", "div", "td", "li"):
        html_extract.main_texts([f"<{tag}>" * 100_000 + "deep" + "</section>" * 100_000], trees)
    assert time.time() - began < 60


def test_html_on_pages_not_seen():
    rng, trees = random.Random(77), html_extract.model()
    made = [html_extract.made_page(rng) for _ in range(150)]
    right = sum(t == " ".join(" ".join(b.split()) for b in blocks) for t, (_, blocks) in zip(html_extract.main_texts([h for h, _ in made], trees), made))
    assert right >= 130


def test_decoding_never_contradicts():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        parent = [-1, *(int(rng.integers(0, k)) for k in range(1, n))]
        logit = rng.normal(size=n)
        kept = html_extract.decode(parent, logit)
        legal = lambda y: all(not y[k] or parent[k] < 0 or y[parent[k]] for k in range(n))
        value = lambda y: sum(-np.logaddexp(0, -s if on else s) for s, on in zip(logit, y))
        options = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        assert legal(kept) and math.isclose(value(kept), max(value(y) for y in options if legal(y)))


def test_language(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    got = registry.QUERIES["op9_language_id"](spark, sf)
    held = got.filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert langid.train([]).predict("text") == ("und", 0.0)
    odd = spark.createDataFrame([(1, "123 !?"), (2, None), (3, "")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(odd, langid.train([("the and of", "en"), ("der und die", "de")])).collect()] == ["und"] * 3


def _print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def _components(prints: list[int]) -> list[int]:
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_simhash(spark, sf_dir, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.QUERIES["op10_simhash"](spark, sf_dir).collect()}
    prints = [_print(t) for _, t in rows]
    assert got == {i: (f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, _components(prints))}


@pytest.mark.parametrize("direct", [4, 256])
def test_links_of_clustered_fingerprints(spark, direct, monkeypatch):
    """Chains of links across buckets, and buckets beyond the direct size."""
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(prints)[:4]:
        x = centre
        for _ in range(120):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            prints.add(x)
            prints.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "DIRECT", direct)
    signed = [struct.unpack("<q", struct.pack("<Q", p))[0] for p in prints]
    # the batch function, as a task would run it
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(signed, pa.int64())], names=["fp"])
    keyed = sorted((k, f) for b in simhash._keys([batch]) for k, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    split = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([f for _, f in part])], names=["key", "fp"]) for part in (keyed[:777], keyed[777:780], keyed[780:])]
    edges = [(a, b) for out in simhash._links(split) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    roots = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = _components(prints)
    found = [roots.get(s, s) for s in signed]
    assert len(set(zip(want, found))) == len(set(want)) == len(set(found))


def test_pigeonring_budgets():
    assert simhash.chain_budgets() == [0] * 7 + [1] * 8 + [2]
    rng = random.Random(6)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2)))
        ring = np.array([diff], np.uint64)
        starts = [s for s in range(16) if int(simhash._rotated(ring, s)[0]) & int(simhash._CHAIN_MASK) == 0]
        assert any(len(simhash._within_budgets(simhash._rotated(ring, s))) for s in starts)


def test_very_long_texts_by_pieces(monkeypatch):
    text = ("The quick, brown é ﬁfox's <|endoftext|> jumps\n over 12 dogs " * 40).strip()
    own = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    (whole,) = own.encode_block([text])
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    assert len(list(bpe.pieces(text))) > 10 and own.encode_block([text]) == [whole]
    data = text.encode()
    assert b"".join(katz.pieces(data, 64)) == data
    h, n = katz.token_hashes([data])
    monkeypatch.setattr(katz, "_CHUNK", 64)
    monkeypatch.setattr(katz.pieces, "__defaults__", (64,))
    assert [list(map(len, c)) for c in katz._chunks([b"a", data, b"b"])] == [[1], [len(data)], [1]]
    again, m = katz.chunk_hashes([data])
    assert (again == h).all() and (m == n).all()
