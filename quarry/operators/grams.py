"""An inverted index of grams: which files may hold a text, without reading their units.

A gram is three bytes of folded UTF-8 text.  The table ``postings`` has a row for each
gram and block of BLOCK file ids: how many of the block's files hold the gram, and
which, as the sorted ids' differences in variable-length bytes.  Its parts are named
by a bucket of grams and a generation, and sorted by gram, so a query opens the few
parts of its grams and reads a few pages there.  The rarest lists are intersected
first, block by block; a block without one of them is out at once.

Generations: a run adds lists for the files that it wrote and leaves the older ones.
What a file no longer holds stays listed until ``rebuilt``, and so do deleted files:
an index may say yes where the answer is no, and every hit is verified on its units,
but never no where it is yes.  ``merged`` makes one generation of many.

Texts and queries are folded in the same way, by character: what a search finds in
exact, lower-cased or folded text is also there when both sides are folded, wherever
a word ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import folded
from quarry.plans.query import Parsed
from quarry.sources import store as layout
from quarry.sources.store import Change, Snapshot, SnapshotStore, number_of

TABLE = "postings"
GRAM = 3
#: Files whose ids one list covers.
BLOCK_BITS = 14
BLOCK = 1 << BLOCK_BITS
#: Parts of a generation.
BUCKETS = 64
#: Lists that a query reads: the rarest of its grams.
LISTS = 4
#: Generations from which on a run merges them.
GENERATIONS = 8
#: (gram, file) pairs that a task holds before it passes them on.
_HELD = 1 << 22
#: Candidates that are brought to the driver, which then names the parts without a further job.
COLLECTED = 50_000

#: Of the writer: small pages, so that a few lists are read without their neighbours.
OPTIONS = {TABLE: {"parquet.page.row.count.limit": "256"}}

POSTINGS = T.StructType([T.StructField("gram", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType())])
_CELLS_DDL = "bucket int, block long, codes binary"
_LISTS_DDL = "bucket int, gram int, block long, n int, ids binary"


def grams_of(text: bytes) -> np.ndarray:
    """The distinct grams of a folded text, ascending."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.empty(0, np.uint32)
    found = np.sort((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:])
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def _distinct(a: np.ndarray) -> np.ndarray:
    """The distinct numbers, ascending, by sorting: for whole numbers faster than ``np.unique``."""
    a = np.sort(a)
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return a[new]


def codes_of(file_ids: np.ndarray, texts: pa.Array) -> np.ndarray:
    """The distinct (gram, file) codes of folded texts (null: none), ascending; all texts at once, as most are short."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint32)
    if len(data) < GRAM:
        return np.empty(0, np.uint64)
    size = np.diff(ends)
    left = np.repeat(ends[1:] - ends[0], size) - np.arange(len(data))  # bytes to the text's end
    at = np.flatnonzero(left >= GRAM)
    gram = ((data[at] << np.uint32(16)) | (data[at + 1] << np.uint32(8)) | data[at + 2]).astype(np.uint64)
    return _distinct((gram << np.uint64(32)) | np.repeat(file_ids.astype(np.uint64), size)[at])


def bucket_of(grams: np.ndarray) -> np.ndarray:
    x = grams.astype(np.uint32)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(2654435761)
    return ((x ^ (x >> np.uint32(16))) % np.uint32(BUCKETS)).astype(np.int64)


def encoded(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers in runs that begin at ``starts`` -> (bytes, offsets of each run): differences, seven bits a byte, lowest first."""
    deltas = np.diff(values, prepend=0)
    deltas[starts] = values[starts]
    size = np.ones(len(deltas), np.int64)
    for bits in (7, 14, 21, 28):
        size += deltas >> bits > 0
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(5):
        has = np.flatnonzero(size > k)
        out[ends[has] - size[has] + k] = ((deltas[has] >> 7 * k) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, np.concatenate([ends[starts] - size[starts], ends[-1:]]) if len(starts) else np.zeros(1, np.int64)


def decoded(data: bytes) -> np.ndarray:
    """The ascending numbers of one run."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.cumsum(np.add.reduceat((b & 127) << (7 * place), first)) if len(first) else np.empty(0, np.int64)


def _cells(batches):
    """(file_id, folded text) -> the distinct (gram, file) codes of each bucket and block."""
    held: list[np.ndarray] = []

    def out():
        codes = _distinct(np.concatenate(held))
        gram, file_id = codes >> np.uint64(32), (codes & np.uint64(0xFFFFFFFF)).astype(np.int64)
        bucket, block = bucket_of(gram), file_id >> BLOCK_BITS
        blocks = _distinct(block)
        cell = bucket * len(blocks) + np.searchsorted(blocks, block)
        order = np.argsort(cell.astype(np.uint16) if BUCKETS * len(blocks) < 1 << 16 else cell, kind="stable")  # codes stay ascending in each cell
        codes, bucket, block, cell = codes[order], bucket[order], block[order], cell[order]
        cuts = np.flatnonzero(np.diff(cell, prepend=-1))
        rows = [codes[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(codes)])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(block[cuts], pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "block", "codes"])

    n = 0
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ids):  # rows of about _HELD bytes at a time; a longer text is a piece of its own
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _HELD, side="right")))
            own = codes_of(ids[at:end], texts.slice(at, end - at))
            at = end
            if len(own):
                held.append(own)
                n += len(own)
            if n > _HELD:
                held = [_distinct(np.concatenate(held))]
                n = len(held[0])
                if n > _HELD // 2:
                    yield out()
                    held, n = [], 0
    if held:
        yield out()


def _rows(bucket: int, block: int, gram: np.ndarray, low: np.ndarray) -> pa.Table:
    """Lists of one cell; sorted by gram, then id."""
    starts = np.flatnonzero(np.diff(gram.astype(np.int64), prepend=-1))
    data, offsets = encoded(low.astype(np.int64), starts)
    ids = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    n = np.diff(np.concatenate([starts, [len(gram)]]))
    return pa.table([pa.array(np.full(len(starts), bucket), pa.int32()), pa.array(gram[starts].astype(np.int64), pa.int32()), pa.array(np.full(len(starts), block), pa.int64()), pa.array(n, pa.int32()), ids], names=["bucket", "gram", "block", "n", "ids"])


def _listed(key, group):
    """All codes of one bucket and block -> its lists."""
    codes = _distinct(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group["codes"]]))
    return _rows(key[0].as_py(), key[1].as_py(), codes >> np.uint64(32), codes & np.uint64(BLOCK - 1))


def _united(key, group):
    """Lists of several generations of one bucket and block -> one list for each gram."""
    codes = [(np.uint64(g) << np.uint64(32)) | decoded(x.as_py()).astype(np.uint64) for g, x in zip(group["gram"].to_pylist(), group["ids"])]
    codes = _distinct(np.concatenate(codes))
    return _rows(key[0].as_py(), key[1].as_py(), codes >> np.uint64(32), codes & np.uint64(BLOCK - 1))


def _parted(lists: DataFrame, generation: str) -> DataFrame:
    """Lists with the part that each is written to, dealt and sorted so that a part's files hold ranges of grams."""
    keys = ["bucket", "gram", "block"]
    part = F.concat_ws(".", F.col("bucket").cast("string"), F.lit(generation))
    return lists.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*POSTINGS.fieldNames(), part.alias("part"))


def _names(generation: str) -> list[str]:
    return [f"{b}.{generation}" for b in range(BUCKETS)]


def generations(at: Snapshot) -> set[str]:
    return {p.partition(".")[2] for p in at.parts(TABLE)}


def postings(units: DataFrame) -> tuple[DataFrame, str, list[str]]:
    """What a ``Change`` needs to add a generation for the files of ``units`` (file_id, text)."""
    generation = uuid.uuid4().hex[:12]
    cells = units.select(F.col("file_id").cast("long").alias("file_id"), folded(F.col("text")).alias("folded")).mapInArrow(_cells, _CELLS_DDL)
    lists = cells.groupBy("bucket", "block").applyInArrow(_listed, _LISTS_DDL)
    return _parted(lists, generation), "part", _names(generation)


def rebuilt(store: SnapshotStore) -> str | None:
    """Indexes all units anew; one generation, in which only what is there is listed."""

    def build(at: Snapshot) -> Change | None:
        units = at.read("units")
        if units is None:
            return None
        rows, column, names = postings(units)
        return Change({TABLE: (rows, column, [*at.parts(TABLE), *names])}, reads=frozenset({"units"}), options=OPTIONS)

    return store.update(build)


def merged(store: SnapshotStore, beyond: int = GENERATIONS) -> str | None:
    """Makes one generation of all, where there are more than ``beyond``."""

    def build(at: Snapshot) -> Change | None:
        if len(generations(at)) <= beyond:
            return None
        generation = uuid.uuid4().hex[:12]
        lists = at.read(TABLE).withColumn("bucket", _bucket(F.col("gram")))
        rows = _parted(lists.groupBy("bucket", "block").applyInArrow(_united, _LISTS_DDL), generation)
        return Change({TABLE: (rows, "part", [*at.parts(TABLE), *_names(generation)])}, options=OPTIONS)

    return store.update(build)


def _bucket(gram: Column) -> Column:
    """``bucket_of`` as an expression."""
    word = F.lit(0xFFFFFFFF).cast("long")
    x = gram.cast("long")
    x = (x.bitwiseXOR(F.shiftright(x, 13)) * F.lit(2654435761)).bitwiseAND(word)
    return (x.bitwiseXOR(F.shiftright(x, 16)) % BUCKETS).cast("int")


def needed(spark: SparkSession, parsed: Parsed) -> list[int]:
    """The grams that every file has in which each term has a match."""
    runs = sorted({r for t in parsed.terms for r in t.runs})
    if not runs:
        return []
    row = spark.createDataFrame([tuple(runs)], ", ".join(f"r{i} string" for i in range(len(runs))))
    texts = row.select(*(folded(F.col(c)) for c in row.columns)).first()
    return sorted({int(g) for x in texts for g in grams_of(x.encode())})


def _intersected(lists: int):
    """Rows of one block -> the ids that all ``lists`` grams have, from the rarest list on."""

    def run(key, group):
        by_gram: dict[int, list[np.ndarray]] = {}
        for gram, ids in zip(group["gram"].to_pylist(), group["ids"]):
            by_gram.setdefault(gram, []).append(decoded(ids.as_py()))
        found = np.empty(0, np.int64)
        if len(by_gram) == lists:
            own = sorted((np.unique(np.concatenate(x)) for x in by_gram.values()), key=len)
            found = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), own)
        return pa.table({"file_id": pa.array((key[0].as_py() << BLOCK_BITS) + found, pa.int64())})

    return run


class Candidates:
    """Files that may hold every term: ``rows`` (file_id), and the parts of ``units`` that they lie in."""

    def __init__(self, rows: DataFrame, numbers: Iterable[int] | None):
        self.rows, self._numbers = rows, None if numbers is None else set(numbers)

    def parts(self, of: Iterable[str]) -> list[str]:
        """Those of the parts ``root-number`` that hold a candidate."""
        if self._numbers is None:  # a number for FILES_PER_PART files
            self._numbers = {r["k"] for r in self.rows.select(number_of(F.col("file_id")).alias("k")).distinct().collect()}
        return [p for p in of if not p.rpartition("-")[2].isdigit() or int(p.rpartition("-")[2]) in self._numbers]


def candidates(at: Snapshot, spark: SparkSession, parsed: Parsed) -> Candidates | None:
    """What the index says; None where there is none, or no term has a gram to ask for."""
    if TABLE not in at.tables:
        return None
    wanted = needed(spark, parsed)
    if not wanted:
        return None

    def lists(grams: list[int]) -> DataFrame:
        buckets = {str(b) for b in bucket_of(np.array(grams)).tolist()}
        return at.read(TABLE, [p for p in at.parts(TABLE) if p.partition(".")[0] in buckets]).filter(F.col("gram").isin(grams))

    sizes = {r["gram"]: r["n"] for r in lists(wanted).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each gram of the query
    if len(sizes) < len(wanted):
        return Candidates(spark.createDataFrame([], "file_id long"), ())
    rarest = sorted(wanted, key=lambda g: (sizes[g], g))[:LISTS]
    found = lists(rarest).select("block", "gram", "ids").groupBy("block").applyInArrow(_intersected(len(rarest)), "file_id long")
    if sizes[rarest[0]] > COLLECTED:
        return Candidates(found, None)
    ids = [r["file_id"] for r in found.collect()]  # no more than the rarest list
    return Candidates(spark.createDataFrame([(i,) for i in ids], "file_id long"), (i // layout.FILES_PER_PART for i in ids))
