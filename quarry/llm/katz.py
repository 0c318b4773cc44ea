"""LM scoring: a Katz backoff bigram model with Good-Turing discounts.

    p(w | v) = d(c(vw)) * c(vw) / c(v)   if the pair was seen in training,
               alpha(v) * p(w)           otherwise (alpha = 1 for an unknown v);
    p(w)     = d(c(w)) * c(w) / N        for a known word, and the mass left for unknown ones.

d(r) is the Good-Turing discount for counts up to MAX_DISCOUNTED, computed from
the counts of counts, 1 above.  alpha(v) is exact: the mass that v's seen pairs
leave, over the unigram mass of the words not seen after v.  A history's first
word follows the document end, so c(v) is the sum of v's pair counts.

Counts cover the whole table.  A task turns its texts into blocks of bounded
size: 64-bit word hashes, as sequences of numbers local to the block, plus the
block's distinct words with their training counts, cut into shards by hash.
Shards add the counts of all blocks, number the words, and answer each block in
the order it asked.  Blocks then count their distinct pairs of known words the
same way.  A frequent history is spread over as many shards as its share of the
tokens asks for, by the hash of the second word; a block adds the partial sums
of its shards.  All tables are Parquet in the shared folder, partitioned by
kind, with a row of packed arrays per block and shard that has rows for the
other (so at most as many rows as pairs); the driver sees only counts of counts.  Each block finally evaluates the recursion for its tokens.

Hash collisions: two of n distinct words share a 64-bit hash with probability
below n * n / 2**65 (3e-6 for ten million words).

Defined results: null and empty texts are their end token alone; a table
without training documents has N = V = 0: base_score is then log10(1) per token
and unknown words have probability 1; a very long text is hashed by pieces and
lies in one block; repeated rows repeat; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, deltas, distinct_at, gathered, input_bytes, pack, released, staged, table, unpack, utf8_texts

MAX_DISCOUNTED = 5
BLOCK_BYTES = 16 << 20
#: Input bytes for each shard of words or pairs.
SHARD_BYTES = 4 << 20
_CHUNK = 2 << 20
#: A block's documents travel in rows of this many bytes: the JVM gives larger arrays regions of their own.
PIECE = 256 << 10
_ROWS_DDL = "kind string, block long, shard long, payload binary"
_ROWS = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("shard", pa.int64()), ("payload", pa.binary())])

_POSITIONS = 64
_TABLE = np.random.default_rng(20240601).integers(0, 2**64, (_POSITIONS, 256), dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Hash of the document end.
END = np.uint64(0xD1B54A32D192ED03)


# --- packed numbers -------------------------------------------------------------


def varints(a: np.ndarray) -> np.ndarray:
    """Numbers below 2**28 as little-endian groups of 7 bits, frequent (small) numbers in one byte."""
    n = 1 + (a >= 1 << 7).astype(np.int64) + (a >= 1 << 14) + (a >= 1 << 21)
    start = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(4):
        has = n > k
        out[start[has] + k] = ((a[has] >> (7 * k)) & 127) | np.where(n[has] > k + 1, 128, 0)
    return out


def unvarints(b: np.ndarray) -> np.ndarray:
    last = b < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    n = ends - starts + 1
    for k in range(4):
        has = n > k
        out[has] |= (b[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def rows(kind: list[str], block: list[int], shard: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(block, pa.int64()), pa.array(shard, pa.int64()), pa.array(payload, pa.binary())], schema=_ROWS)


# --- tokens ----------------------------------------------------------------------


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' tokens in order, each text closed by END; tokens of each text)."""
    data = np.frombuffer(b"\n".join([*(t.lower() for t in texts), b""]), np.uint8)
    letter = (data != 32) & ((data < 9) | (data > 13))
    at = np.flatnonzero(letter)
    borders = np.cumsum([len(t) + 1 for t in texts])
    if len(at):
        first = np.concatenate([[True], np.diff(at) > 1])
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(at)))
        position = np.arange(len(at)) - np.repeat(starts, lengths)
        values = _TABLE[position & (_POSITIONS - 1), data[at]]
        if lengths.max() > _POSITIONS:  # long words: each further stretch with a factor of its own
            factor = np.power(_ODD, (position >> 6).astype(np.uint64))
            values = values * factor
        h = np.add.reduceat(values, starts)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        owner = np.searchsorted(borders, at[starts], side="right")
    else:
        h, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    n = np.bincount(owner, minlength=len(texts)) + 1
    out = np.full(int(n.sum()), END, np.uint64)
    out[np.arange(len(h)) + owner] = h
    return out, n


_BLANK = re.compile(rb"[ \t-\r]")


def pieces(text: bytes, size: int = _CHUNK):
    """A long text cut after blanks into pieces of about ``size`` bytes."""
    at = 0
    while len(text) - at > 2 * size and (cut := _BLANK.search(text, at + size)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def chunk_hashes(chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``token_hashes`` in bounded memory: a text longer than a chunk is alone in it and is hashed by pieces."""
    if len(chunk) > 1 or len(chunk[0]) <= 2 * _CHUNK:
        return token_hashes(chunk)
    h = np.concatenate([*(token_hashes([p])[0][:-1] for p in pieces(chunk[0])), np.array([END])])
    return h, np.array([len(h)])


def _chunks(texts):
    chunk, held = [], 0
    for t in texts:
        if chunk and len(t) > _CHUNK:
            yield chunk
            chunk, held = [], 0
        chunk.append(t)
        held += len(t)
        if held >= _CHUNK:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def _cells(shard: np.ndarray, *arrays: np.ndarray):
    """(shard, arrays' stretches) for each shard that occurs in the ascending ``shard``: a cell is never empty."""
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)]):
        yield int(shard[a]), [x[a:b] for x in arrays]


def _rows_of(kind: str, block: int, cells):
    """Rows of a block's (shard, payload) cells, some at a time."""
    cells = iter(cells)
    while some := list(itertools.islice(cells, 256)):
        yield rows([kind] * len(some), [block] * len(some), [s for s, _ in some], [x for _, x in some])


def _blocks(n_shards: int, block_bytes: int):
    """mapInArrow: (doc_id, text, held_out) -> a row of documents and the word cells of each block."""
    shift = np.uint64(64 - (n_shards.bit_length() - 1))

    def flush(block, ids, held, hashes, lengths):
        h, n = np.concatenate(hashes), np.concatenate(lengths)
        held = np.array(held, np.uint8)
        words, local = distinct_at(h)
        del h, hashes
        total = np.bincount(local, minlength=len(words))
        trained = np.bincount(local[np.repeat(held == 0, n)], minlength=len(words)).astype(np.uint32)
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        no_id = np.array([x is None for x in ids], np.uint8)
        docs = pack(np.array([x or 0 for x in ids], np.int64), no_id, held, n.astype(np.uint32), varints(rank[local]), order.astype(np.uint32))
        yield from _rows_of("docs", block, enumerate(docs[i : i + PIECE] for i in range(0, len(docs), PIECE)))
        shard = (words >> shift).astype(np.int64) if n_shards > 1 else np.zeros(len(words), np.int64)
        yield from _rows_of("words", block, ((s, pack(deltas(w), c)) for s, (w, c) in _cells(shard, words, trained)))

    def run(batches):
        block = TaskContext.get().partitionId() << 24
        ids, held, hashes, lengths, size = [], [], [], [], 0
        for batch in batches:
            own, out = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            at = 0
            for chunk in _chunks(utf8_texts(batch)):
                h, n = chunk_hashes(chunk)
                hashes.append(h)
                lengths.append(n)
                ids += own[at : at + len(chunk)]
                held += out[at : at + len(chunk)]
                at += len(chunk)
                size += sum(map(len, chunk))
                if size >= block_bytes:
                    yield from flush(block, ids, held, hashes, lengths)
                    block += 1
                    ids, held, hashes, lengths, size = [], [], [], [], 0
        if ids:
            yield from flush(block, ids, held, hashes, lengths)

    return run


class Docs:
    """A block's documents: ids, held-out flags, tokens of each, and the tokens as ranks of the words' numbers."""

    def __init__(self, payload: bytes, numbers: np.ndarray):
        ids, no_id, self.held, self.n, codes, order = unpack(payload)
        self.ids = [None if gone else int(i) for i, gone in zip(ids, no_id)]
        self.held = self.held.astype(bool)
        self.n = self.n.astype(np.int64)
        rank = np.empty(len(numbers), np.int32)
        rank[np.argsort(numbers)] = np.arange(len(numbers), dtype=np.int32)
        self.tokens = rank[order][unvarints(codes)]
        self.ends = np.cumsum(self.n)

    def histories(self, end: int) -> np.ndarray:
        """The word before each token; a document's first token follows the end."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.concatenate([[0], self.ends[:-1]])] = end
        return before


# --- discounts -------------------------------------------------------------------


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    """n_1 .. n_(MAX_DISCOUNTED + 1)."""
    return np.array([(counts == r).sum() for r in range(1, MAX_DISCOUNTED + 2)], np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0) .. d(MAX_DISCOUNTED + 1): Good-Turing in Katz's form; where the counts allow none, absolute 1/2."""
    k = MAX_DISCOUNTED
    d = np.ones(k + 2)
    d[0] = 0
    share = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        ratio = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
        value = (ratio - share) / (1 - share) if share < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


class Unigrams:
    """N, V, and the discounted unigram probabilities with the mass for unknown words."""

    def __init__(self, n_tokens: int, n_words: int, n: np.ndarray):
        self.n_tokens, self.n_words, self.d = n_tokens, n_words, discounts(n)
        lost = sum((1 - self.d[r]) * r * int(n[r - 1]) for r in range(1, MAX_DISCOUNTED + 1)) / max(1, n_tokens)
        self.unknown = max(lost, 1 / (n_tokens + 1)) if n_tokens else 1.0
        self.scale = (1 - self.unknown) / (1 - lost) if n_tokens and lost < 1 else 0.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        known = self.scale * self.d[np.minimum(counts, MAX_DISCOUNTED + 1)] * counts / max(1, self.n_tokens)
        return np.where(counts > 0, known, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))


# --- shards ------------------------------------------------------------------------


def _merge_words(n_shards: int):
    """Adds the training counts of one shard's words over all blocks, numbers the words, answers each block."""

    def merge(key, group):
        shard = key[0].as_py()
        blocks = group["block"].to_pylist()
        cells = [unpack(x.as_py()) for x in group["payload"]]
        words = [np.cumsum(w, dtype=np.uint64) for w, _ in cells]
        known, at = distinct_at(np.concatenate(words))
        counts = np.bincount(at, weights=np.concatenate([c for _, c in cells]), minlength=len(known)).astype(np.int64)
        # frequent words get small numbers, which pack well
        number = np.empty(len(known), np.uint64)
        number[np.argsort(-counts, kind="stable")] = np.arange(len(known), dtype=np.uint64) * np.uint64(n_shards) + np.uint64(shard)
        of_cell = np.repeat(np.arange(len(words)), [len(w) for w in words])
        out = [pack(c.astype(np.uint64), g) for _, (c, g) in _cells(of_cell, counts[at], number[at])]
        known = counts[counts > 0]
        stat = struct.pack(f"<{MAX_DISCOUNTED + 3}q", int(known.sum()), len(known), *counts_of_counts(known).tolist())
        n = len(out)
        return pa.Table.from_batches([rows(["found"] * n + ["stat"], [*blocks, -1], [shard] * (n + 1), [*out, stat])])

    return merge


def _pick(group, kind: str) -> list[bytes]:
    """Payloads of a kind, by shard."""
    found = [(s, p) for k, s, p in zip(group["kind"].to_pylist(), group["shard"].to_pylist(), group["payload"]) if k == kind]
    return [p.as_py() for _, p in sorted(found, key=lambda x: x[0])]


def _block_words(group) -> tuple[Docs, np.ndarray, np.ndarray]:
    """A block's documents, and the counts and numbers of its words, ascending by number."""
    cells = [unpack(p) for p in _pick(group, "found")]
    counts, numbers = np.concatenate([c for c, _ in cells]).astype(np.int64), np.concatenate([g for _, g in cells])
    docs = Docs(b"".join(_pick(group, "docs")), numbers)
    order = np.argsort(numbers)
    return docs, counts[order], numbers[order]


class Pairs:
    """A block's distinct pairs of known words and its known histories, dealt to shards.

    ``v`` and ``w`` are the pairs, ascending by the words' numbers; ``order``
    lists them by (shard, history, word), ``shard`` in that order.
    """

    def __init__(self, docs: Docs, counts: np.ndarray, numbers: np.ndarray, n_tokens: int, n_shards: int):
        n = len(counts)
        self.before = docs.histories(docs.tokens[docs.ends[0] - 1])
        self.known = (counts[self.before] > 0) & (counts[docs.tokens] > 0)
        code = self.before[self.known] * np.int64(n) + docs.tokens[self.known]
        order = np.argsort(code)
        code = code[order]
        new = np.ones(len(code), bool)
        np.not_equal(code[1:], code[:-1], out=new[1:])
        self.at = np.empty(len(code), np.int32)  # each known token's pair
        self.at[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        code = code[new]
        trained = np.repeat(~docs.held, docs.n)[self.known]
        self.trained = np.bincount(self.at[trained], minlength=len(code)).astype(np.uint32)
        self.v, self.w = (code // n).astype(np.int32), (code % n).astype(np.int32)
        del code, new, trained
        # shards of a history: as many as its share of all tokens asks for
        spread = np.maximum(1, np.ceil(counts / max(1, n_tokens) * n_shards)).astype(np.int32)
        mixed = (numbers * _ODD) >> np.uint64(33)
        first = (mixed % np.uint64(n_shards)).astype(np.int32)
        mixed = (mixed // np.uint64(n_shards)).astype(np.int32)
        kind = np.uint16 if n_shards <= 1 << 16 else np.int32  # 16 bits sort by radix
        shard = ((first[self.v] + mixed[self.w] % spread[self.v]) % n_shards).astype(kind)
        self.order = np.argsort(shard, kind="stable").astype(np.int32)
        self.shard = shard[self.order].astype(np.int64)
        asked = np.zeros(n, bool)
        asked[self.before] = True
        asked = np.flatnonzero(asked & (counts > 0))
        times = spread[asked]
        history = np.repeat(asked, times)
        step = np.arange(len(history)) - np.repeat(np.cumsum(times) - times, times)
        own = (first[history] + step) % n_shards
        by_shard = np.argsort(own, kind="stable")
        self.history, self.history_shard = history[by_shard], own[by_shard].astype(np.int64)

    def cells(self, *of_pairs: np.ndarray):
        """(shard, histories asked there, the arrays' stretches for its pairs)."""
        pairs = dict(_cells(self.shard, *of_pairs))
        histories = {s: h for s, (h,) in _cells(self.history_shard, self.history)}
        for s in sorted(pairs.keys() | histories.keys()):
            yield s, histories.get(s, self.history[:0]), pairs.get(s, [x[:0] for x in of_pairs])


def _count_pairs(n_tokens: int, n_shards: int):
    """A block's pairs as cells: history and word numbers, training count, the word's count; and the histories asked for."""

    def count(key, group):
        block = key[0].as_py()
        docs, counts, numbers = _block_words(group)
        pairs = Pairs(docs, counts, numbers, n_tokens, n_shards)
        del docs
        step = lambda x: np.diff(numbers[x].view(np.int64), prepend=np.int64(0))
        of_pairs = (x[pairs.order] for x in (pairs.v, pairs.w, pairs.trained))
        cells = ((s, pack(step(v), numbers[w], c, counts[w].astype(np.uint64), step(h))) for s, h, (v, w, c) in pairs.cells(*of_pairs))
        out = pa.Table.from_batches(list(_rows_of("pairs", block, cells)), _ROWS)
        del pairs
        released()
        return out

    return count


def _merge_pairs(unigrams: Unigrams):
    """Adds one shard's pair counts over all blocks; answers counts of pairs, and each history's sums."""

    def merge(key, group):
        shard = key[0].as_py()
        blocks = group["block"].to_pylist()
        cells = [unpack(x.as_py()) for x in group["payload"]]
        v = np.concatenate([np.cumsum(c[0]).view(np.uint64) for c in cells])
        w = np.concatenate([c[1] for c in cells])
        order = np.lexsort((w, v))
        new = np.ones(len(v), bool)
        new[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])
        group_of = np.empty(len(v), np.int64)
        group_of[order] = np.cumsum(new) - 1
        first = order[new]
        counts = np.bincount(group_of, weights=np.concatenate([c[2] for c in cells]), minlength=len(first)).astype(np.int64)
        p = unigrams.p(np.concatenate([c[3] for c in cells])[first].astype(np.int64))
        seen = counts > 0
        histories, at = distinct_at(v[first][seen])
        sums = [np.bincount(at, weights=(counts[seen] == r), minlength=len(histories)).astype(np.uint32) for r in range(1, MAX_DISCOUNTED + 1)]
        mass = np.bincount(at, weights=p[seen], minlength=len(histories))
        out, done = [], 0
        for c in cells:
            n = len(c[0])
            asked = np.cumsum(c[4]).view(np.uint64)
            k = np.minimum(np.searchsorted(histories, asked), max(0, len(histories) - 1))
            ok = histories[k] == asked if len(histories) else np.zeros(len(asked), bool)
            answer = [np.where(ok, s[k], 0).astype(np.uint32) if len(histories) else np.zeros(len(asked), np.uint32) for s in sums]
            answer.append(np.where(ok, mass[k], 0) if len(histories) else np.zeros(len(asked)))
            out.append(pack(counts[group_of[done : done + n]].astype(np.uint64), *answer))
            done += n
        released()
        stat = struct.pack(f"<{MAX_DISCOUNTED + 1}q", *counts_of_counts(counts[seen]).tolist())
        n = len(out)
        return pa.Table.from_batches([rows(["answer"] * n + ["stat"], [*blocks, -1], [shard] * (n + 1), [*out, stat])])

    return merge


_SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(unigrams: Unigrams, d: np.ndarray, n_shards: int):
    """Evaluates the recursion for every token of a block and adds up its documents."""

    def score(key, group):
        docs, counts, numbers = _block_words(group)
        pairs = Pairs(docs, counts, numbers, unigrams.n_tokens, n_shards)
        cells = [unpack(p) for p in _pick(group, "answer")]
        del group
        c = np.zeros(len(pairs.v), np.int64)
        h = pairs.history
        if cells:
            c[pairs.order] = np.concatenate([x[0] for x in cells]).astype(np.int64)
        else:
            cells = [[np.zeros(len(h))] * (MAX_DISCOUNTED + 2)]
        size = len(counts)
        per_count = [np.bincount(h, weights=np.concatenate([x[r] for x in cells]), minlength=size) for r in range(1, MAX_DISCOUNTED + 1)]
        mass = np.bincount(h, weights=np.concatenate([x[-1] for x in cells]), minlength=size)
        # what the seen pairs of each history take
        kept = counts - sum((1 - d[r]) * r * per_count[r - 1] for r in range(1, MAX_DISCOUNTED + 1))
        total = np.maximum(counts, 1).astype(np.float64)
        left = 1 - kept / total
        tight = left < 1 / (total + 1)  # hardly any mass left: reserve that of one more token
        shrink = np.where(tight, (total / (total + 1)) / np.maximum(kept / total, 1e-300), 1.0)
        left = np.where(tight, 1 / (total + 1), left)
        alpha = np.where(counts > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
        word_log = np.log10(unigrams.p(counts))
        result = np.log10(alpha)[pairs.before] + word_log[docs.tokens]
        del cells, per_count, mass
        seen = c > 0
        ratio = shrink[pairs.v[seen]] * d[np.minimum(c[seen], MAX_DISCOUNTED + 1)] * c[seen] / total[pairs.v[seen]]
        pair_log = np.full(len(c), np.nan)
        pair_log[seen] = np.log10(ratio)
        del c, seen, ratio
        own = pair_log[pairs.at]
        result[pairs.known] = np.where(np.isnan(own), result[pairs.known], own)
        del own, pair_log, pairs
        starts = np.concatenate([[0], docs.ends[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        released()
        return pa.table({
            "doc_id": pa.array(docs.ids, pa.int64()), "held_out": pa.array(docs.held, pa.bool_()), "n_tokens": pa.array(docs.n, pa.int64()),
            "n_known": pa.array(add((counts[docs.tokens] > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(len(docs.n), unigrams.n_tokens), pa.int64()),
            "base_score": pa.array(add(unigrams.base(counts)[docs.tokens]), pa.float64()), "score": pa.array(add(result), pa.float64()),
        })

    return score


def _stats(table_: DataFrame, n: int) -> list[int]:
    """Sums over the shards' statistics, a row of ``n`` numbers per shard, added up on the executors."""

    def numbers(batches):
        for batch in batches:
            found = [struct.unpack(f"<{n}q", x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(n)], names=[f"s{i}" for i in range(n)])

    found = table_.filter("kind = 'stat'").select("payload").mapInArrow(numbers, ", ".join(f"s{i} long" for i in range(n)))
    return [x or 0 for x in found.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(n))).first()]


def shard_count(docs: DataFrame) -> int:
    """A power of two that grows with the input's size."""
    return 1 << max(4, min(20, (input_bytes(docs) // SHARD_BYTES).bit_length()))


def score_documents(docs: DataFrame, *, training, shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document; ``training``: a boolean column, true where the model learns."""
    n_shards = shards or shard_count(docs)
    texts = gathered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~training).alias("held_out"))
    blocks = staged(texts.mapInArrow(_blocks(n_shards, block_bytes), _ROWS_DDL), "lm-blocks", "kind")
    own = blocks.filter("kind = 'docs'")
    words = staged(blocks.filter("kind = 'words'").groupBy("shard").applyInArrow(_merge_words(n_shards), _ROWS_DDL), "lm-words", "kind")
    n_tokens, n_words, *n = _stats(words, MAX_DISCOUNTED + 3)
    unigrams = Unigrams(n_tokens, n_words, np.array(n))
    found = words.filter("kind = 'found'")
    pairs = own.union(found).groupBy("block").applyInArrow(_count_pairs(n_tokens, n_shards), _ROWS_DDL)
    answers = staged(pairs.groupBy("shard").applyInArrow(_merge_pairs(unigrams), _ROWS_DDL), "lm-answers", "kind")
    d = discounts(np.array(_stats(answers, MAX_DISCOUNTED + 1)))
    everything = own.union(found).union(answers.filter("kind = 'answer'"))
    return everything.groupBy("block").applyInArrow(_score(unigrams, d, n_shards), _SCORE_DDL)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, training=crc_mod(F.col("doc_id"), 5) != 1)
