"""Exact dedup by a log-structured merge index.

Tasks fill memtables keyed by the digest of the normalised text.  A full
memtable is flushed as a run: one entry per digest (its smallest identifier and
its number of copies), sorted by digest, cut into segments by digest range, each
with a filter of its own; the compressed bodies go beside it.  Equal digests
inside a memtable are verified byte by byte on the spot.  Compaction takes one
range of all runs: entries that no second run's filter may hold pass as they
are, the others are merged in digest order, where the smallest identifier comes
first.  Digests that more than one run holds are hits: their bodies are picked by
a filter sized from the number of hits (by a semi-join where there are too many
to broadcast one), and each hit's bodies are compared byte by byte.  If two
different texts ever share a digest, ``find_copies`` starts again with the text
itself as the key, so the result is exact in any case.

Order of identifiers: most code points in the original text, then smallest
``doc_id`` (nulls last), then position in the input.

Defined results: null text counts as empty; empty and blank texts are copies of
each other; of repeated rows (same id, same text) exactly one is kept; very long
texts are like any other (a memtable holds one text at least); an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, discarded, fresh_name, gathered, input_bytes, parallelism, staged, table

#: Characters that do not count: space, tab, LF, VT, FF, CR.
BLANKS = b" \t\n\x0b\x0c\r"
MEMTABLE_BYTES = 32 << 20
#: Input bytes for each digest range.
RANGE_BYTES = 16 << 20
#: Bits of a segment's filter.  More entries than it is made for make compaction merge more, never less.
SEGMENT_BITS = 1 << 14
FILTER_HASHES = 3
#: Up to this many hits, a filter over them (two bytes each) is broadcast; more of them are shuffled.
BROADCAST_HITS = 4_000_000

_LEVEL0 = pa.schema([
    ("kind", pa.string()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("n_chars", pa.int64()),
    ("range", pa.int64()), ("entries", pa.binary()), ("filter", pa.binary()), ("body", pa.binary()),
])
_LEVEL0_DDL = "kind string, digest binary, doc_id long, pos long, n_chars long, range long, entries binary, filter binary, body binary"
_ENTRY = pa.schema([("digest", pa.binary()), ("n_chars", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("n", pa.int64())])


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _identifier(doc_id, pos, n_chars):
    """Smallest first: the order that the module's docstring names."""
    return -n_chars, doc_id is None, doc_id or 0, pos


def _level0(kind: str, n: int, **columns) -> pa.RecordBatch:
    return arrow_rows(_LEVEL0, {name: columns.get(name, [None] * n) for name in _LEVEL0.names} | {"kind": [kind] * n})


def _bits_of(digests: list[bytes], bits: int) -> np.ndarray:
    """The filter positions of each digest, a row of FILTER_HASHES each."""
    words = np.array([[int.from_bytes((d + bytes(24))[i * 8 : i * 8 + 8], "little") for i in range(FILTER_HASHES)] for d in digests], dtype=np.uint64)
    return (words % np.uint64(bits)).astype(np.int64).reshape(-1, FILTER_HASHES)


def _set_bits(known: np.ndarray, digests: list[bytes]) -> None:
    at = _bits_of(digests, 8 * len(known)).ravel()
    np.bitwise_or.at(known, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _maybe(known: np.ndarray, digests: list[bytes]) -> np.ndarray:
    at = _bits_of(digests, 8 * len(known))
    return ((known[at >> 3] >> (at & 7)) & 1).all(axis=1)


def _flush_runs(digest_of, memtable_bytes: int, ranges: int, bits: int):
    """mapInArrow: (doc_id, text) -> members (a row per document), segments of sorted runs, and bodies."""

    def range_of(digest: bytes) -> int:
        return int.from_bytes(digest[:4].ljust(4, b"\0")) * ranges >> 32

    def run(batches):
        pos = TaskContext.get().partitionId() << 36
        memtable: dict[bytes, list] = {}
        held = 0
        pack = zstandard.ZstdCompressor(level=1)

        def flush():
            nonlocal held
            for own, digests in itertools.groupby(sorted(memtable), key=range_of):
                digests = list(digests)
                some = [memtable[k] for k in digests]
                entries = arrow_rows(_ENTRY, {"digest": digests, "doc_id": [x[0] for x in some], "pos": [x[1] for x in some], "n_chars": [x[2] for x in some], "n": [x[3] for x in some]})
                known = np.zeros(bits // 8, np.uint8)
                _set_bits(known, digests)
                yield _level0("segment", 1, range=[own], entries=[entries.serialize().to_pybytes()], filter=[known.tobytes()])
                for at in range(0, len(digests), 2000):
                    bodies = [pack.compress(x[4]) for x in some[at : at + 2000]]
                    yield _level0("body", len(bodies), digest=digests[at : at + 2000], body=bodies)
            memtable.clear()
            held = 0

        for batch in batches:
            ids = batch.column(0).to_pylist()
            members = {"digest": [], "pos": [], "n_chars": []}
            for doc_id, value in zip(ids, batch.column(1)):
                text = value.as_py() or ""
                n_chars, body = len(text), text.encode().translate(None, BLANKS)
                digest = digest_of(body)
                entry = memtable.get(digest)
                if entry is not None and entry[4] != body:  # another text under this digest: a run of its own, so that compaction sees both
                    yield from flush()
                    entry = None
                if entry is None:
                    memtable[digest] = [doc_id, pos, n_chars, 1, body]
                    held += len(body) + 300
                else:
                    entry[3] += 1
                    if _identifier(doc_id, pos, n_chars) < _identifier(*entry[:3]):
                        entry[:3] = doc_id, pos, n_chars
                members["digest"].append(digest)
                members["pos"].append(pos)
                members["n_chars"].append(n_chars)
                pos += 1
            yield _level0("member", len(ids), doc_id=ids, **members)
            if held > memtable_bytes:
                yield from flush()
        yield from flush()

    return run


_INDEX = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_pos", pa.int64()), ("group_size", pa.int64()), ("runs", pa.int64())])
_INDEX_DDL = "digest binary, keep_id long, keep_pos long, group_size long, runs long"


def _compact(key, group):
    """One digest range of all runs -> its index entries, ascending."""
    filters = [np.frombuffer(x.as_py(), np.uint8) for x in group["filter"]]
    once, twice = np.zeros_like(filters[0]), np.zeros_like(filters[0])
    for own in filters:  # what at least two runs' filters hold
        twice |= once & own
        once |= own
    alone, runs = [], []
    for entries in group["entries"]:
        run = pa.ipc.read_record_batch(pa.BufferReader(entries.as_buffer()), _ENTRY)
        shared = _maybe(twice, run.column(0).to_pylist())
        alone.append(run.filter(pa.array(~shared)))
        several = run.filter(pa.array(shared))
        columns = (several.column(i).to_pylist() for i in range(5))
        runs.append([(d, *_identifier(i, p, c), i, n) for d, c, i, p, n in zip(*columns)])
    merged = []
    for digest, found in itertools.groupby(heapq.merge(*runs, key=lambda x: x[:5]), key=itemgetter(0)):
        found = list(found)
        *_, pos, doc_id, _ = found[0]
        merged.append((digest, doc_id, pos, sum(x[-1] for x in found), len(found)))
    alone = pa.Table.from_batches(alone, _ENTRY)
    alone = pa.table([alone["digest"], alone["doc_id"], alone["pos"], alone["n"], pa.array([1] * len(alone), pa.int64())], schema=_INDEX)
    merged = pa.table([pa.array(x, f.type) for x, f in zip(list(zip(*merged)) or [[]] * 5, _INDEX)], schema=_INDEX)
    return pa.concat_tables([alone, merged]).sort_by("digest")


def hit_filter(hits: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` over the digests of ``hits``, put together on the executors by pages."""
    page = 4096

    def partial(batches):
        own = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            if batch.num_rows:
                _set_bits(own, batch.column(0).to_pylist())
        for at in np.flatnonzero(own.reshape(-1, page).any(axis=1)):
            yield pa.RecordBatch.from_pydict({"page": pa.array([at], pa.int64()), "bits": pa.array([own[at * page : at * page + page].tobytes()], pa.binary())})

    def merged(key, pages):
        one = np.bitwise_or.reduce(np.stack([np.frombuffer(x.as_py(), np.uint8) for x in pages["bits"]]))
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([one.tobytes()], pa.binary())})

    whole = np.zeros(bits // 8, dtype=np.uint8)
    pages = hits.select("digest").coalesce(parallelism(hits.sparkSession)).mapInArrow(partial, "page long, bits binary")
    for found in pages.groupBy("page").applyInArrow(merged, "page long, bits binary").collect():  # bits / 8 bytes in all
        whole[found["page"] * page : found["page"] * page + page] = np.frombuffer(found["bits"], np.uint8)
    return whole


def _picked(known):
    def run(batches):
        own = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_maybe(own, batch.column(0).to_pylist())))

    return run


def verified(index: DataFrame, bodies: DataFrame, broadcast_hits: int = BROADCAST_HITS) -> bool:
    """Whether the bodies of each hit are equal, byte by byte."""
    spark = index.sparkSession
    hits = index.filter("runs > 1").select("digest")
    n = hits.count()
    if not n:
        return True
    if n <= broadcast_hits:
        known = spark.sparkContext.broadcast(hit_filter(hits, max(1 << 15, 1 << (16 * n - 1).bit_length())).tobytes())
        bodies = bodies.mapInArrow(_picked(known), "digest binary, body binary")
    else:
        bodies = bodies.join(hits.hint("merge"), "digest", "left_semi")
    # One compressor at one level: bodies are equal if and only if their compressed bytes are.
    return bodies.groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a <> b").isEmpty()


def range_count(docs: DataFrame) -> int:
    return max(16, min(1 << 20, input_bytes(docs) // RANGE_BYTES))


def _copies(docs: DataFrame, digest_of=sha256, memtable_bytes: int = MEMTABLE_BYTES, filter_bits: int = SEGMENT_BITS, ranges: int | None = None, broadcast_hits: int = BROADCAST_HITS) -> tuple[DataFrame, list[DataFrame]]:
    """(a row per document as ``find_copies`` says, the staged tables that it reads)."""
    rows = gathered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    flushed = rows.mapInArrow(_flush_runs(digest_of, memtable_bytes, ranges or range_count(docs), filter_bits), _LEVEL0_DDL)
    level0 = staged(flushed, "dedup-runs", "kind")
    index = staged(level0.filter("kind = 'segment'").groupBy("range").applyInArrow(_compact, _INDEX_DDL), "dedup-index")
    if not verified(index, level0.filter("kind = 'body'").select("digest", "body"), broadcast_hits):
        discarded(level0, index)
        return _by_text(docs)
    members = level0.filter("kind = 'member'").select("doc_id", "digest", "pos")
    found = members.join(index, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("pos") == F.col("keep_pos")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "pos", "keep_pos",
    )
    return found, [level0, index]


def find_copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, pos, keep_pos: one row per document."""
    return _copies(docs, **options)[0]


def _best():
    """A struct that orders rows as this module says; the least one stays."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("pos").alias("pos"))


def _by_text(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The same with whole texts as keys, for a digest that two texts share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(text, r"[\x20\x09-\x0D]", "").alias("digest"), F.length(text).cast("long").alias("n_chars"))
    rows = staged(rows.withColumn("pos", F.monotonically_increasing_id()), "dedup-texts")
    index = rows.groupBy("digest").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    found = rows.join(index, "digest").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("pos") == F.col("best.pos")).alias("kept"),
        F.sha2(F.col("digest"), 256).alias("text_sha256"), "pos", F.col("best.pos").alias("keep_pos"),
    )
    return found, [rows]


#: Above this many rows to drop, ``deduplicated`` shuffles instead of broadcasting them (8 bytes each).
BROADCAST_ROWS = 1_000_000


def without(rows: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """Anti-join on ``key``; the rows to drop are broadcast only when they were counted and are few."""
    drop = staged(drop.select(key), "drop", narrow=True)
    if drop.count() <= BROADCAST_ROWS:
        drop = F.broadcast(drop)
    return rows.join(drop, key, "left_anti")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    row = fresh_name(docs, "row")
    whole = staged(gathered(docs).withColumn(row, F.monotonically_increasing_id()), "dedup-rows")
    rows = whole.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # the row number takes the place of an id that may be missing or repeated
    found, read = _copies(rows.select(F.col("row").alias("doc_id"), "text"), **options)
    found = found.filter("group_size > 1").select(F.col("doc_id").alias("row"), "text_sha256")
    several = staged(found.join(rows.select("row", "id", F.length("text").alias("n")), "row"), "dedup-several", narrow=True)
    discarded(*read)
    order = F.struct((-F.coalesce("n", F.lit(0))).alias("less"), F.col("id").isNull().alias("no_id"), "id", "row")
    # a table of its own, so that the join can split the rows of a frequent text
    best = staged(several.groupBy("text_sha256").agg(F.min(order).alias("best")), "dedup-best", narrow=True)
    drop = several.join(best, "text_sha256").filter(F.col("row") != F.col("best.row")).select(F.col("row").alias(row))
    left = without(whole, drop, row).drop(row)
    discarded(several, best)
    return left


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         row_number() OVER w AS rn,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""

__all__ = ["find_copies", "deduplicated", "without", "op6_exact_dedup", "OP6_SQL"]
