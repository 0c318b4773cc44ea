"""The pipeline's near-dedup stage against all pairs compared by brute force."""

import itertools
import random

import numpy as np

import corpus_pipeline
from quarry.llm import near_dedup


def _shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def _kept(rows):
    """Ids that stay: the least of each component of the similar pairs."""
    sets = [_shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if label[i] != label[j] and _similar(sets[i], sets[j]):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    groups = {}
    for (i, _), x in zip(rows, label):
        groups.setdefault(x, []).append(i)
    return sorted(map(min, groups.values()))


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def _texts():
    rng = random.Random(4)
    texts = []
    for size in (1, 3, 5, 9, 14, 20, 40, 90, 200, 450):
        for _ in range(3):
            words = [f"w{rng.randrange(500)}" for _ in range(size)]
            texts.append(words)
            texts += [_edited(rng, words, rng.randint(1, 1 + size // 30)) for _ in range(4)]
            texts += [words[: size - size // 6], words + [f"t{i}" for i in range(size // 5)]]
    common = [f"c{i}" for i in range(60)]
    texts += [common + [f"u{k}_{i}" for i in range(12 + k % 8)] for k in range(40)]  # a common passage, links between some only by size
    return [(i, " ".join(x)) for i, x in enumerate(texts)]


def test_near_copies_stage_against_all_pairs(spark):
    rows = _texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = _kept(rows)
    assert len(want) < len(rows) - 60
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == want


def test_near_copies_stage_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == _kept(rows)


def test_common_passage_in_many_texts(spark):
    """Half of each text is one passage: no two link, whatever buckets they share, but for the planted pairs."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(400):
        own = [f"u{k}_{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((k, " ".join(own + passage)))
        if k % 100 == 0:
            rows.append((1000 + k, " ".join(own[:-2] + ["other", "words"] + passage)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == list(range(400))


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for _ in range(500):
        n = int(rng.integers(1, 400))
        both = rng.integers(0, 2**64, n, dtype=np.uint64)
        a = np.unique(np.concatenate([both, rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
            continue
        rows, n_of = np.array([1, 2]), np.array([len(a), len(b)])
        found = list(near_dedup._possible(rows, rows, n_of, [near_dedup.sketch(x).tobytes() for x in (a, b)]))
        apart = len(np.setxor1d(a, b))
        assert len(found) == 1 or 9 * apart > len(a) + len(b)


def test_similar_sets_share_a_key():
    """Any sizes, differences at the very bound; few hashes, so that ranges are empty."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        both = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        differ = len(both) // 4
        cut = int(rng.integers(0, differ + 1))
        a = np.unique(np.concatenate([both, rng.integers(0, 2**64, cut, dtype=np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 2**64, differ - cut, dtype=np.uint64)]))
        assert np.intersect1d(near_dedup.keys(a), near_dedup.keys(b)).size


def _chains(own, agreeing):
    """The keys under which a set stands after so many agreeing ranges, as ``_split`` derives them."""
    found = set()
    for r in near_dedup.ranges(own):
        now = {(r.level, (int(n),), (int(k),)) for n, k in zip(*r.first(1))}
        for level in range(2, agreeing + 1):
            places, made = (x.tolist() for x in r.first(level))
            now = {(r.level, (*at, n), (*ks, k)) for _, at, ks in now for n, k in zip(places, made) if n > at[-1]}
        found |= now
    return found


def test_linked_sets_agree_in_further_ranges():
    """Up to LEVELS of them, at the very bound, with empty ranges too."""
    rng = np.random.default_rng(8)
    for _ in range(400):
        n = int(rng.integers(1, 40))
        both = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        differ = len(both) // 4
        cut = int(rng.integers(0, differ + 1))
        a = np.unique(np.concatenate([both, rng.integers(0, 2**64, cut, dtype=np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 2**64, differ - cut, dtype=np.uint64)]))
        for agreeing in range(1, near_dedup.LEVELS + 1):
            assert _chains(a, agreeing) & _chains(b, agreeing), (len(a), len(b), agreeing)


def test_any_class_has_ranges_to_spare():
    for level in range(21):
        top = 1 << level
        assert near_dedup._ranges(top) - near_dedup.differing(top, top) >= near_dedup.LEVELS


def _with_passage(n, seed, planted=40):
    """Short texts that share a passage of 16 words; some have a near copy of their own."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(16)]
    texts = []
    for k in range(n):
        own = [f"u{k}_{i}" for i in range(rng.randint(4, 40))]
        at = rng.randint(0, len(own))
        texts.append(own[:at] + passage + own[at:])
    for k in range(planted):
        texts.append([*texts[k * 7], "end"] if k % 2 else [*texts[k * 7][:-1], "last"])
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, " ".join(texts[k])) for i, k in enumerate(order)]


def test_a_passage_of_many_short_texts(spark, monkeypatch):
    """Buckets are split, and the links are those of all pairs."""
    monkeypatch.setattr(near_dedup, "CROWDED", 48)
    rows, seen = _with_passage(900, 9), []
    original = near_dedup._uncrowded

    def watched(*args):
        out = original(*args)
        seen.append((args[0].groupBy("key").count().agg({"count": "max"}).first()[0], out.groupBy("key").count().agg({"count": "max"}).first()[0]))
        return out

    monkeypatch.setattr(near_dedup, "_uncrowded", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = _kept(rows)
    assert len(want) < len(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == want
    ((before, after),) = seen
    assert before > 3 * 48 and after <= 3 * 48


def test_blocks_of_what_stays_crowded(spark, monkeypatch):
    """Texts that differ in nothing that ranges tell: only blocks bound a task."""
    monkeypatch.setattr(near_dedup, "CROWDED", 10)
    monkeypatch.setattr(near_dedup, "LEVELS", 2)
    rows = _with_passage(250, 12, planted=20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == _kept(rows)


def test_small_buckets_are_pairs_alone():
    """Buckets of two and three rows come out as all their pairs; of four rows as a bucket too."""
    keys = np.array([1, 1, 2, 2, 2, 3, 3, 3, 3, 4], np.uint64) << np.uint64(8)
    rows = np.array([5, 6, 1, 8, 9, 2, 3, 4, 7, 5], np.int64)
    group = near_dedup.pa.table({"payload": [near_dedup.pack(near_dedup.deltas(keys), rows)]})
    found = near_dedup._crowded((near_dedup.pa.scalar(0),), group).to_pylist()
    assert [(r["x"], r["y"]) for r in found if r["kind"] == "bucket"] == [(3 << 8, y) for y in (2, 3, 4, 7)]
    pairs = {(r["x"], r["y"]) for r in found if r["kind"] == "pair"}
    assert pairs >= {(5, 6), (1, 8), (1, 9), (8, 9), (2, 3), (2, 4), (2, 7), (3, 4), (4, 7)}


def _rounds(spark, monkeypatch, rows):
    """(ids that stay, rounds in which buckets' rows met)."""
    names, original = [], near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", lambda df, name, *a, **k: names.append(name) or original(df, name, *a, **k))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    return left, names.count("near-cross")


def test_few_possible_pairs_take_one_round(spark, monkeypatch):
    rows = _with_passage(120, 10, planted=20)
    assert _rounds(spark, monkeypatch, rows) == (_kept(rows), 1)


def test_many_possible_pairs_take_the_nearest_first(spark, monkeypatch):
    """No bucket is done at once; texts are shuffled instead of picked."""
    monkeypatch.setattr(near_dedup, "FEW", 0)
    monkeypatch.setattr(near_dedup, "PICKED", 0)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(80):  # of four groups that share a passage; neighbours are of different groups
        rows.append((k, " ".join([f"y{k}", *base[:40], *(f"x{k % 4}_{i}" for i in range(20))])))
    assert _rounds(spark, monkeypatch, rows)[0] == _kept(rows) == [0, 1, 2, 3]


def test_pairs_of_a_bucket_are_all_or_the_nearest():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**64, 90, dtype=np.uint64)
    sets = [np.unique(np.append(both, rng.integers(0, 2**64, 1, dtype=np.uint64))) for _ in range(8)]
    rows, n = np.arange(8), np.array([len(x) for x in sets])
    sketches = [near_dedup.sketch(x).tobytes() for x in sets]
    found, whole = near_dedup._few_or_nearest(rows, rows, n, sketches, 4)
    assert whole and {tuple(sorted(p)) for a, b in found for p in zip(a.tolist(), b.tolist())} == set(itertools.combinations(range(8), 2))
    found, whole = near_dedup._few_or_nearest(rows, rows, n, sketches, 1)
    assert not whole and sum(len(a) for a, _ in found) == 8


def test_null_ids_and_rows_without_words(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (None, None), (5, ""), (6, " \n"), (None, "")]
    left = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"], (r["text"] or "").strip()) for r in left) == [(3, "a b c d e f g"), (5, "")]
