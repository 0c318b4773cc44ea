"""Quality by a linear-chain conditional random field over lines.

Every line is good or bad.  A line's potential reads its own features and those
of the lines before and after it; transitions couple neighbouring labels.
Forward-backward gives each line's marginal, and the length-weighted mean of the
marginals, calibrated on the training documents, is the document's quality.

Only documents carry labels.  Training starts with each line under its
document's label, then relabels the lines of bad documents by their marginals
(the worst line stays bad) and fits again.

The sample: the SAMPLE labelled ids of the training part with the least xxhash64,
of their distinct texts those of at most SAMPLE_CHARS characters and SAMPLE_LINES
lines each, and of these, by their hash, as many as have SAMPLE_TOTAL characters
together, at most SAMPLE; so neither the driver's
memory nor its time depends on the data.  Labels, lang, source and doc_id are
never inputs of a score.

Defined results: null text counts as empty; an empty text is one empty line and
gets a score like any other; very long texts are scored whole, a few bytes in memory for
each of their lines; of different labels
of one id or text the greater counts; without any labelled document every score is
0.5; repeated rows repeat; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, bounded, crc_mod, table, utf8_texts

SAMPLE = 6000
SAMPLE_CHARS, SAMPLE_LINES, SAMPLE_TOTAL = 200_000, 4000, 30_000_000
THRESHOLD = 0.7
ROUNDS = 3

_ASCII = bytes(range(128))
_UPPER, _LOWER, _DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_SYMBOLS = b"!*$%#&|<>{}[]=_~^\\/@+"
_POINTS = b".,;:'\"?-()"
N_FEATURES = 20


@lru_cache(4096)
def _own_features(line: bytes) -> tuple[float, ...]:
    """A line's features, apart from those that other lines give it (16 and 17, here 0)."""
    n, words = len(line), line.split()
    nw = len(words) or 1
    upper, lower = n - len(line.translate(None, _UPPER)), n - len(line.translate(None, _LOWER))
    beyond = n - len(line.translate(None, _ASCII))
    symbols = n - len(line.translate(None, _SYMBOLS))
    points = n - len(line.translate(None, _POINTS))
    caps = upper / (upper + lower + beyond / 2 + 1)
    repeats = 1 - len(set(words)) / nw if len(words) >= 4 else 0.0
    first = line[:1]
    return (
        1.0, caps, float(caps > 0.3), min(1.0, symbols / nw / 3), float(symbols > 0.2 * nw), min(1.0, line.count(b"|") / nw),
        min(1.0, line.count(b"!!") / nw), (n - len(line.translate(None, _DIGITS))) / (n + 1), repeats, float(repeats > 0.5),
        min(1.0, n / nw / 20), float(n > 40 * nw), float(line[-1:] in b".!?" and n > 0), float(first.isupper() or first > b"\x7f"),
        float(len(words) < 3), min(1.0, math.log1p(n) / 8), 0.0, 0.0, points / (n + 1), float(not words),
    )


_LIKE_LAST, _SEEN = 16, 17
#: Lines longer than this are not remembered; lines that are taken up together.
_SHORT, LINES = 80, 4096


def lines_of(text: bytes) -> Iterator[list[bytes]]:
    """The lines of a text, LINES at a time, so that a text of many lines is never held as lines."""
    at, block = 0, []
    while (end := text.find(b"\n", at)) >= 0:
        block.append(text[at:end])
        at = end + 1
        if len(block) == LINES:
            yield block
            block = []
    yield [*block, text[at:]]


def _repeated(text: bytes) -> np.ndarray:
    """For each line, whether an equal one stands above it."""
    keys = np.concatenate([np.fromiter(map(hash, block), np.int64, len(block)) for block in lines_of(text)])
    first = np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first[order[np.concatenate([[True], keys[1:] != keys[:-1]])]] = True
    return ~first


def feature_blocks(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lines x N_FEATURES, weight of each line: its length, at least 1), LINES lines at a time."""
    seen, at, before = _repeated(text), 0, None
    for block in lines_of(text):
        x = np.array([_own_features(line) if len(line) <= _SHORT else _own_features.__wrapped__(line) for line in block], np.float32)
        x[:, _LIKE_LAST] = [a == b for a, b in zip(block, [before, *block[:-1]])]
        x[:, _SEEN] = seen[at : at + len(block)]
        yield x, np.array([max(1, len(line)) for line in block], np.float32)
        at, before = at + len(block), block[-1]


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All blocks as one."""
    x, weights = zip(*feature_blocks(text))
    return np.concatenate(x), np.concatenate(weights).astype(np.float64)


class Crf:
    """Weights of the line itself, the one before and the one after; transitions [from][to] (0 bad, 1 good)."""

    def __init__(self):
        self.own, self.prev, self.next = (np.zeros(N_FEATURES) for _ in range(3))
        self.move = np.zeros((2, 2))
        self.slope, self.shift = 0.0, 0.0

    def potentials(self, x: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """Of a text's lines, or of some between the lines ``before`` and ``after``."""
        u = x @ self.own
        u[1:] += x[:-1] @ self.prev
        u[:-1] += x[1:] @ self.next
        if before is not None:
            u[0] += before @ self.prev
        if after is not None:
            u[-1] += after @ self.next
        return u

    def _forward(self, odds: list[float], good: float | None) -> list[float]:
        """P(good) of each line given the lines above; ``good``: that of the line before, None at the top."""
        (m00, m01), (m10, m11) = np.exp(self.move).tolist()
        out = []
        for odd in odds:
            if good is None:
                good = 1 - 1 / (1 + odd)
            else:
                b, g = (1 - good) * m00 + good * m10, ((1 - good) * m01 + good * m11) * odd
                good = g / (b + g)
            out.append(good)
        return out

    def _backward(self, odds: list[float], forward: list[float], below: tuple[float, float]) -> tuple[list[float], tuple[float, float]]:
        """P(good) of each line, and what the line above these gets from below; ``below``: what the last of these gets."""
        (m00, m01), (m10, m11) = np.exp(self.move).tolist()
        out, (bb, bg) = [0.0] * len(odds), below
        for t in range(len(odds) - 1, -1, -1):
            g, b = forward[t] * bg, (1 - forward[t]) * bb
            out[t] = g / (g + b)
            gg = bg * odds[t]
            bb, bg = m00 * bb + m01 * gg, m10 * bb + m11 * gg
            s = bb + bg
            bb, bg = bb / s, bg / s
        return out, (bb, bg)

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """P(good) of each line, by scaled forward-backward."""
        odds = np.exp(np.clip(self.potentials(x), -30, 30)).tolist()
        return np.array(self._backward(odds, self._forward(odds, None), (0.5, 0.5))[0])

    def quality(self, text: bytes) -> float:
        """The length-weighted mean of the marginals.

        A text is taken up LINES lines at a time; of each line a potential and a
        weight stay.  Forward goes down once and leaves its state at each block's top;
        backward comes up block by block and goes down each block again.
        """
        u, weights, last = [], [], None
        for x, w in feature_blocks(text):
            if last is not None:
                u[-1][-1] += x[0] @ self.next
            u.append(self.potentials(x, before=last))
            weights.append(w)
            last = x[-1]
        odds = [np.exp(np.clip(own, -30, 30)) for own in u]
        del u
        tops: list[float | None] = [None]
        for own in odds[:-1]:
            tops.append(self._forward(own.tolist(), tops[-1])[-1])
        total, below = 0.0, (0.5, 0.5)
        for own, w, top in zip(reversed(odds), reversed(weights), reversed(tops)):
            own = own.tolist()
            out, below = self._backward(own, self._forward(own, top), below)
            total += float(np.array(out) @ w.astype(np.float64))
        return total / sum(float(w.sum(dtype=np.float64)) for w in weights)

    def score(self, text: bytes) -> float:
        z = self.slope * self.quality(text) + self.shift
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit_chain(crf: Crf, docs: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, l2: float = 1e-3, rate: float = 0.08):
    """Adam on the mean log-likelihood of (features, 0/1 label of each line); documents run side by side."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i][0]))
    docs = [docs[i] for i in order]
    lengths = np.array([len(x) for x, _ in docs])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    x = np.concatenate([d for d, _ in docs]).astype(np.float64)
    y = np.concatenate([d for _, d in docs]).astype(np.float64)
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    first[offsets[:-1]] = last[offsets[1:] - 1] = True
    xp = np.vstack([np.zeros((1, N_FEATURES)), x[:-1]])
    xp[first] = 0
    xn = np.vstack([x[1:], np.zeros((1, N_FEATURES))])
    xn[last] = 0
    full = np.hstack([x, xp, xn])
    alive = [int((lengths > t).sum()) for t in range(lengths[0])]
    yi = y.astype(int)
    seen_moves = np.zeros((2, 2))
    inner = np.flatnonzero(~last)
    np.add.at(seen_moves, (yi[inner], yi[inner + 1]), 1)
    seen_full = full.T @ y
    theta = np.concatenate([crf.own, crf.prev, crf.next, crf.move.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n_lines = len(x)
    for step in range(1, steps + 1):
        u = np.clip(full @ theta[:-4], -30, 30)
        phi = np.stack([np.ones_like(u), np.exp(u)], axis=1)
        move = np.exp(theta[-4:].reshape(2, 2))
        f = np.zeros((n_lines, 2))
        b = np.ones((n_lines, 2))
        for t, k in enumerate(alive):
            at = offsets[:k] + t
            f[at] = phi[at] if t == 0 else (f[at - 1] @ move) * phi[at]
            f[at] /= f[at].sum(axis=1, keepdims=True)
        want_moves = np.zeros((2, 2))
        for t in range(len(alive) - 2, -1, -1):
            at = offsets[: alive[t + 1]] + t
            g = b[at + 1] * phi[at + 1]
            pair = f[at][:, :, None] * move[None] * g[:, None, :]
            want_moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            g = g @ move.T
            b[at] = g / g.sum(axis=1, keepdims=True)
        post = f * b
        post /= post.sum(axis=1, keepdims=True)
        grad = np.concatenate([seen_full - full.T @ post[:, 1], (seen_moves - want_moves).ravel()]) / n_lines - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    crf.own, crf.prev, crf.next = theta[:N_FEATURES], theta[N_FEATURES : 2 * N_FEATURES], theta[2 * N_FEATURES : 3 * N_FEATURES]
    crf.move = theta[-4:].reshape(2, 2)


def train(sample: list[tuple[bytes, int]]) -> Crf:
    """Fit on (text, quality) pairs; deterministic for a given list."""
    crf = Crf()
    if not sample:
        return crf
    parts = [(*document_features(text), int(y)) for text, y in sample]
    labels = [np.full(len(x), y, np.int8) for x, _, y in parts]
    for _ in range(ROUNDS):
        _fit_chain(crf, [(x, own) for (x, _, _), own in zip(parts, labels)])
        for i, (x, _, y) in enumerate(parts):
            if y == 0:
                good = crf.marginals(x)
                labels[i] = (good > 0.5).astype(np.int8)
                labels[i][int(good.argmin())] = 0
    q = np.array([crf.marginals(x) @ w / w.sum() for x, w, _ in parts])
    y = np.array([p[2] for p in parts], np.float64)
    theta, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    design = np.stack([q, np.ones_like(q)], axis=1)
    for _ in range(40):  # Newton steps of a logistic fit
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge + 1e-9 * np.eye(2)
        theta = theta + np.linalg.solve(hessian, design.T @ (y - p) - ridge @ theta)
    crf.slope, crf.shift = map(float, theta)
    return crf


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> list[tuple[bytes, int]]:
    """(text, quality) of labelled documents whose crc32 remainder by 4 is not 2; ``limit`` and SAMPLE_TOTAL bound it."""
    known = labels.filter(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), 4) != 2))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most `limit` rows
    text = F.col("text").cast("string")
    rows = docs.filter(F.length(text) <= SAMPLE_CHARS).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    # counted behind the join, where few rows are left: the condition names both sides, so that it stays there
    short = F.when(F.col("quality").isNotNull(), F.size(F.split("text", "\n")) <= SAMPLE_LINES)
    labelled = rows.join(F.broadcast(some), "doc_id").filter(short).select("h", "text", "quality")
    return [(text.encode(), quality) for text, quality in bounded(labelled, "quality", limit, SAMPLE_TOTAL)]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def classify(docs: DataFrame, model: Crf) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            scores = [model.score(x) for x in utf8_texts(batch)]
            yield arrow_rows(_SCHEMA, {"doc_id": batch.column(0), "held_out": batch.column(2), "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Crf, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.score(x) >= threshold for x in utf8_texts(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(labelled_sample(docs, table(spark, sf_dir, "labels"))))
