"""Packing by minimum bin slack over remaining lengths.

Documents become ids plus one end id.  Whole windows are cut off first and are
sequences of their own, without padding.  What is left of each document has one
of CAPACITY - 1 lengths, so the whole corpus' packing problem is a histogram of
that many counts; it alone goes to the driver.  There, windows are filled one
pattern at a time: the largest length left is placed, and a bitset subset-sum
over the multiset of remaining lengths (binary-split counts) finds the sum
closest to the capacity, whose counts are backtracked through the stored
bitsets.  A pattern repeats as often as its counts allow.  Where even the best
sum leaves GRID or more ids of slack, one further piece is cut to fill it and
its rest goes back into the multiset.

Each document finds its place by its rank among the rests of its length: the
rank inside its task plus the tasks before it (a running sum over tasks, per
length), so no length is ever gathered in one task; a task's running sums meet
its rows by one shuffle on the task's number, and nothing but the plan (bounded
by the capacity) is broadcast.  CRCs of cut pieces are
derived from prefix CRCs stored every GRID ids.

The number of patterns is bounded by the capacity alone: using a length k times
leaves fewer than k of it in the pattern that limits the repetitions, so a
length l limits at most 1 + CAPACITY / l patterns; the sum over l is under
20,000 for 2,048, with at most 63 different lengths in a pattern.

Defined results: null and empty texts are the end id alone; repeated rows are
packed each; an empty table gives an empty table; other columns are ignored;
a text of any length, one long word or one run of white space included, gives
the ids of the tokenizers file (runs of white space over RUN are encoded apart).
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, crc32, gathered, staged, table

CAPACITY = 2048
END = 1
#: Cut places inside a rest are multiples of this.
GRID = 16
VOCABULARY = "byte_bpe_50k.tiktoken"
#: An added token of byte_bpe_50k.json: in a text it is one id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Longer runs of white space don't go through the word pattern, whose lookahead takes a stack as deep as the run.
RUN = 10_000
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


@cache
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def _ordinary_ids(enc: tiktoken.Encoding, text: str):
    """Arrays of the ids of a text without special tokens.

    A long run of white space is one word of the pattern, but for its last
    character, which belongs to what follows.
    """
    at = 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield enc.encode_to_numpy(text[at : run.start()], disallowed_special=())
        yield enc._encode_single_piece(text[run.start() : end])
        at = end
    yield enc.encode_to_numpy(text[at:] if at else text, disallowed_special=())


def token_ids(text: str, path: str | None = None) -> np.ndarray:
    """The ids of byte_bpe_50k.json, and the end id."""
    enc = _encoding(path or public_tokenizers.path(VOCABULARY))
    parts = []
    for k, piece in enumerate(text.split(SPECIAL)):
        parts += [[SPECIAL_ID]] * (k > 0) + [*_ordinary_ids(enc, piece)]
    return np.concatenate([*parts, [END]]).astype("<u4")


_TOKENISED = pa.schema([
    ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("first_full", pa.int64()), ("full_crcs", pa.binary()),
    ("rest", pa.int64()), ("rest_rank", pa.int64()), ("prefix_crcs", pa.binary()),
])
_TOKENISED_DDL = "doc_id long, doc_tokens long, part long, first_full long, full_crcs binary, rest long, rest_rank long, prefix_crcs binary"


def _tokenise(capacity: int, path: str | None):
    def run(batches):
        part = TaskContext.get().partitionId()
        full, ranks = 0, [0] * capacity
        for batch in batches:
            out = {f.name: [] for f in _TOKENISED}
            for value in batch.column(1):
                ids = token_ids(value.as_py() or "", path)
                n = len(ids) // capacity
                rest = ids[n * capacity :]
                crcs, prefix = [], 0
                for at in range(0, len(rest), GRID):
                    prefix = zlib.crc32(rest[at : at + GRID].tobytes(), prefix)
                    crcs.append(prefix)
                out["doc_tokens"].append(len(ids))
                out["first_full"].append(full)
                out["full_crcs"].append(np.array([crc32(ids[i * capacity : (i + 1) * capacity].tobytes()) for i in range(n)], "<u4").tobytes())
                out["rest"].append(len(rest))
                out["rest_rank"].append(ranks[len(rest)])
                out["prefix_crcs"].append(np.array(crcs, "<u4").tobytes())
                full += n
                ranks[len(rest)] += 1
            rows = batch.num_rows
            yield arrow_rows(_TOKENISED, out | {"doc_id": batch.column(0), "part": [part] * rows})

    return run


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of ``counts`` (length -> copies) whose sum comes closest to ``capacity`` without passing it."""
    everything = (1 << (capacity + 1)) - 1
    sums, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & everything
            left -= take
            take *= 2
        if sums >> capacity & 1:
            break
    at, chosen = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:  # this step was needed to reach the sum
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


class _Pool:
    """Pieces of one length: ranges of ranks of (rest length, start inside the rest)."""

    def __init__(self):
        self.count = 0
        self.ranges: list[list[int]] = []

    def put(self, rest: int, start: int, lo: int, hi: int):
        self.ranges.append([rest, start, lo, hi])
        self.count += hi - lo

    def take(self, n: int):
        self.count -= n
        while n:
            rest, start, lo, hi = self.ranges[-1]
            m = min(n, hi - lo)
            yield rest, start, hi - m, hi
            if m == hi - lo:
                self.ranges.pop()
            else:
                self.ranges[-1][3] = hi - m
            n -= m


PLACE_FIELDS = ("rest", "lo", "hi", "start", "length", "copies", "item", "sequence", "offset")


def solve(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> tuple[np.ndarray, int]:
    """Places (rows of PLACE_FIELDS) for all rests, and the number of sequences.

    A place: the rests of length ``rest`` with ranks lo..hi-1 give their ids
    from ``start``, ``length`` of them; the j-th of them is item ``item`` + j,
    which goes to sequence ``sequence`` + item // copies at ``offset`` plus
    (item % copies) * length.
    """
    pools: dict[int, _Pool] = {}
    for length, n in histogram.items():
        if length and n:
            pools.setdefault(length, _Pool()).put(length, 0, 0, n)
    places, sequence = [], 0
    while pools:
        seed = max(pools)
        rest = {x: p.count - (x == seed) for x, p in pools.items() if p.count > (x == seed)}
        pattern = best_fill(rest, capacity - seed)
        pattern[seed] = pattern.get(seed, 0) + 1
        slack = (capacity - sum(x * k for x, k in pattern.items())) // grid * grid
        times = min(pools[x].count // k for x, k in pattern.items())
        cut = min((x for x, p in pools.items() if x > slack and p.count > pattern.get(x, 0)), default=None) if slack else None
        if cut:
            times = min(times, pools[cut].count // (pattern.get(cut, 0) + 1))
        offset = 0
        for x in sorted(pattern, reverse=True):
            item = 0
            for own, start, lo, hi in pools[x].take(pattern[x] * times):
                places.append((own, lo, hi, start, x, pattern[x], item, sequence, offset))
                item += hi - lo
            offset += x * pattern[x]
        if cut:
            item, back = 0, []
            for own, start, lo, hi in pools[cut].take(times):
                places.append((own, lo, hi, start, slack, 1, item, sequence, offset))
                back.append((own, start + slack, lo, hi))
                item += hi - lo
            for piece in back:
                pools.setdefault(cut - slack, _Pool()).put(*piece)
        sequence += times
        pools = {x: p for x, p in pools.items() if p.count}
    return np.array(places, dtype=np.int64).reshape(-1, len(PLACE_FIELDS)), sequence


@cache
def _zeros(n: int) -> tuple[bytes, int]:
    zeros = bytes(n)
    return zeros, zlib.crc32(zeros)


def crc_of_suffix(whole: int, prefix: int, n_suffix: int) -> int:
    """crc32 of the last n_suffix bytes, from the crc32 of the whole and of what stands before them."""
    zeros, plain = _zeros(n_suffix)
    return whole ^ zlib.crc32(zeros, prefix) ^ plain


_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _place(plan, n_sequences: int, capacity: int):
    """A task's tokenised rows and its bases (rests of each length in the tasks before it) -> the rows' pieces."""

    def run(key, own_rows, bases):
        places = plan.value
        base = np.zeros(capacity, np.int64)
        base[bases["rest"].to_numpy()] = bases["base"].to_numpy()
        order = np.lexsort((places[:, 1], places[:, 0], places[:, 3] > 0))
        uncut = places[order][: int((places[:, 3] == 0).sum())]
        cut = [p for p in places.tolist() if p[3] > 0]
        stride = np.int64(1) << 40
        firsts = uncut[:, 0] * stride + uncut[:, 1]
        out = []
        for batch in own_rows.to_batches(max_chunksize=10_000):
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ids = cols["doc_id"].to_pylist()
            tokens, part, first, rest, rank = (cols[x].to_numpy(zero_copy_only=False) for x in ("doc_tokens", "part", "first_full", "rest", "rest_rank"))
            rank = rank + base[rest]
            pieces: list[tuple] = []
            for i, crcs in enumerate(cols["full_crcs"]):
                crcs = crcs.as_py()
                for j in range(len(crcs) // 4):
                    crc = int.from_bytes(crcs[4 * j : 4 * j + 4], "little")
                    pieces.append((ids[i], j * capacity, capacity, crc, tokens[i], n_sequences + (int(part[i]) << 32) + int(first[i]) + j, 0))
            rows = np.flatnonzero(rest > 0)
            at = np.searchsorted(firsts, rest[rows].astype(np.int64) * stride + rank[rows].astype(np.int64), side="right") - 1
            found = [(i, uncut[k]) for i, k in zip(rows.tolist(), at.tolist())]
            for p in cut:
                found += [(i, p) for i in np.flatnonzero((rest == p[0]) & (rank >= p[1]) & (rank < p[2])).tolist()]
            for i, p in found:
                own, lo, _, start, length, copies, item, sequence, offset = map(int, p)
                crcs = np.frombuffer(cols["prefix_crcs"][i].as_py(), "<u4")
                crc = int(crcs[(start + length - 1) // GRID])
                if start:
                    crc = crc_of_suffix(crc, int(crcs[start // GRID - 1]), 4 * length)
                item += int(rank[i]) - lo
                pieces.append((ids[i], int(tokens[i]) - own + start, length, crc, tokens[i], sequence + item // copies, offset + item % copies * length))
            columns = list(zip(*pieces)) or [[]] * len(_PIECES)
            out.append(arrow_rows(_PIECES, {f.name: c for f, c in zip(_PIECES, columns)}))
        return pa.Table.from_batches(out, _PIECES)

    return run


def pack(docs: DataFrame, *, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = gathered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = staged(rows.mapInArrow(_tokenise(capacity, path), _TOKENISED_DDL), "packing-tokens")
    counts = staged(tokens.groupBy("rest", "part").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places, n_sequences = solve(histogram, capacity)
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("rest", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plan = spark.sparkContext.broadcast(places)  # its size depends on the capacity alone
    # a task's rows are one input split's, so these groups are bounded
    return tokens.groupBy("part").cogroup(bases.groupBy("part")).applyInArrow(_place(plan, n_sequences, capacity), _PIECES_DDL)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
