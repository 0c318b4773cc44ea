"""Language identification: averaged hashed subword embeddings, linear softmax.

Subwords are the 2- to 4-byte n-grams of lower-cased words with their
boundaries, hashed into BUCKETS rows of an embedding table.  A text is the mean
of its subwords' embeddings; a linear softmax reads the language off it.  Both
are trained together by stochastic gradient descent in numpy, on whole texts and
on short windows of them, from a bounded sample.  A temperature fitted on a part
of the sample kept aside calibrates the scores, and the rejection threshold is
the score that all but REJECTED of that part's rightly labelled texts reach,
at most 0.5.

The sample: of each language the distinct texts with the least xxhash64, of at most
SAMPLE_CHARS characters each: SAMPLE texts, or one of each language where there are
more languages, and SAMPLE_TOTAL characters.  Both are shared evenly by the languages
(what a rare one leaves of its texts goes to the others) and taken language by
language, the first text of each whatever its length; so no language is too rare to
be learned, and the size depends on the number of languages alone.

Defined results: ``und`` with score 0 (and rejected) for null, empty and
letterless texts; of several labels of one text the least counts; very long texts
are read whole; without any labelled text every document is ``und``; repeated rows
repeat; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, crc_mod, table, texts

BUCKETS = 1 << 16
DIM = 16
SAMPLE = 6000
SAMPLE_CHARS, SAMPLE_TOTAL = 200_000, 30_000_000
EPOCHS = 4
#: Share of rightly labelled texts that the rejection may cost.
REJECTED = 0.002
UNKNOWN = "und"

#: ASCII other than letters separates words.
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_PIECE = 1 << 20


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of all subwords of a text."""
    data = b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "
    parts = []
    for at in range(0, max(1, len(data) - 3), _PIECE):
        b = np.frombuffer(data, np.uint8, count=min(_PIECE + 3, len(data) - at), offset=at).astype(np.uint32)
        inner = b != 32
        g = b
        keep = np.ones(len(b), bool)
        for n in (2, 3, 4):
            if len(b) < n:
                break
            if n > 2:
                keep = keep[:-1] & inner[n - 2 : len(b) - 1]
            else:
                keep = keep[:-1]
            g = (g[:-1] << np.uint32(8)) | b[n - 1 :]
            parts.append((((g[keep] ^ np.uint32(n * 0x3C6EF372)) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32))
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.langs, self.weights, self.bias = langs, weights, bias
        self.temperature, self.threshold = temperature, threshold

    def logits(self, text: str) -> np.ndarray:
        own = subwords(text)
        return self.weights[own].mean(axis=0, dtype=np.float64) + self.bias if len(own) else self.bias.astype(np.float64)

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def _windows(text: str, rng: np.random.Generator) -> list[str]:
    """The text, and two short stretches of its words."""
    words = text.split()
    out = [text]
    for n in (int(rng.integers(1, 6)), int(rng.integers(6, 30))):
        if len(words) > n:
            at = int(rng.integers(0, len(words) - n))
            out.append(" ".join(words[at : at + n]))
    return out


def train(sample: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit on (text, lang) pairs; deterministic for a given list."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in sample})
    if not langs:
        return Model([], np.zeros((1, 1), np.float32), np.zeros(1), 1.0, 0.0)
    index = {lang: i for i, lang in enumerate(langs)}
    rows, aside = [], []
    for k, (text, lang) in enumerate(sample):
        for piece in _windows(text, rng):
            own, n = np.unique(subwords(piece), return_counts=True)
            if len(own):
                (aside if k % 5 == 4 else rows).append((own, (n / n.sum()).astype(np.float32), index[lang]))
    rows, aside = rows or aside, aside or rows
    table_ = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    share = np.bincount([y for *_, y in rows], minlength=len(langs)) / max(1, len(rows))
    balance = np.clip(1 / np.maximum(share * len(langs), 1e-9), 0.3, 4).astype(np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            own, n, y = rows[k]
            rate = np.float32(0.5 * (1 - done / steps) + 0.01) * balance[y]
            done += 1
            e = table_[own]
            x = n @ e
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= rate * np.outer(x, p)
            bias -= rate * np.float32(0.1) * p
            table_[own] = e - (rate * 20 * n)[:, None] * back  # a mean spreads the gradient thinly
    weights = table_ @ w
    z = np.array([n @ weights[own] + bias for own, n, _ in aside], np.float64)
    y = np.array([y for *_, y in aside])

    def soft(t):
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    temperature = min(np.geomspace(0.1, 10, 60), key=lambda t: -np.log(soft(t)[np.arange(len(y)), y] + 1e-12).mean())
    p = soft(temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    threshold = min(0.5, float(np.quantile(right, REJECTED))) if len(right) else 0.0
    return Model(langs, weights, bias, float(temperature), threshold)


def shares(counts: dict[str, int], limit: int) -> dict[str, int]:
    """How many texts each language gives: an even share, what a rare one leaves goes to the others, and one at least."""
    out, left, need = {}, limit, len(counts)
    for lang, n in sorted(counts.items(), key=lambda x: (x[1], x[0])):
        out[lang] = min(n, max(1, left // need))
        left, need = left - out[lang], need - 1
    return out


def labelled_sample(docs: DataFrame, limit: int = SAMPLE, total: int = SAMPLE_TOTAL) -> list[tuple[str, str]]:
    """(text, lang) of the training part, the least hashes of each language."""
    spark = docs.sparkSession
    rows = docs.filter((crc_mod(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = rows.select(F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class of the model
    if not counts:
        return []
    share = shares(counts, limit)
    # hashes are even: a little more than the share lies below this bound
    spread = spark.createDataFrame([(lang, min(1.0, (1.1 * share[lang] + 50) / n) * (1 << 32)) for lang, n in counts.items()], "lang string, below double")
    near = rows.join(F.broadcast(spread), "lang").filter(F.pmod("h", F.lit(1 << 32)) < F.col("below"))
    # hashes and lengths come first, then the texts that are wanted
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in near.groupBy("h").agg(F.min("lang").alias("lang"), F.max(F.length("text")).alias("n")).collect():
        sizes.setdefault(r["lang"], []).append((r["h"], r["n"]))
    wanted = []
    for lang, own in sorted(sizes.items()):
        left = total * share[lang] // sum(share.values())
        for k, (h, n) in enumerate(sorted(own)[: share[lang]]):
            left -= n
            if left < 0 and k:  # the first text is taken, whatever its length
                break
            wanted.append((h,))
    chosen = F.broadcast(spark.createDataFrame(wanted, "h long"))
    found = near.join(chosen, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
    return [(r["text"], r["lang"]) for r in sorted(found.collect(), key=lambda r: (r["lang"], r["h"]))]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the data

    def run(batches):
        m = shared.value
        for batch in batches:
            found = [m.predict(x) for x in texts(batch)]
            langs, scores = [x for x, _ in found], [x for _, x in found]
            gone = [lang == UNKNOWN or score < m.threshold for lang, score in found]
            yield arrow_rows(_SCHEMA, {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": langs, "score": scores, "rejected": gone})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            found = [m.predict(x) for x in texts(batch)]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= m.threshold for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(labelled_sample(docs)))
