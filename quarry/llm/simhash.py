"""SimHash near-dedup with pigeonring filtering.

A fingerprint is 64 bits; two link at ``TAU`` = 2 or fewer differing bits.
Pigeonring: cut the ring of 64 bits into ``SEGMENTS`` segments.  If two
fingerprints differ in at most tau bits, some start i exists for which every
chain of l consecutive segments from i differs in at most l * tau / SEGMENTS
bits.  With 16 segments of 4 bits the budgets are 0 for chains up to 7, then 1
up to 15, then 2.  So candidates share the 28 bits of 7 consecutive segments
(the shuffle key, one of 16 starts), must then stay within the budgets of the
longer chains, and only those left get the full Hamming check.

Equal fingerprints collapse before any candidate is made, so a group of copies,
however large, is one row.  A bucket yields a forest of links, not its pairs;
a bucket too large for comparing its members directly is solved by looking up
each member's neighbours (all flips of up to 2 of the 36 bits outside the
chain), which is linear in the bucket and exact.  Components come from
alternating large-star and small-star steps on tables in the shared folder.

A bucket is gathered in one task as eight bytes for each of its distinct
fingerprints; those that share 28 given bits are about one in 2**28.

Defined results: null, empty and blank texts have fingerprint zero and link
like any other; very long texts are fingerprinted whole; repeated rows share a
component; a null id never becomes a component's id unless the whole component has
no id; of ids in a component the least names it, so ties need no rule; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discarded, gathered, parallelism, staged, table, utf8_texts

BITS, TAU, SEGMENTS = 64, 2, 16
WIDTH = BITS // SEGMENTS
#: Chains up to this length have a budget of no differing bit.
CHAIN = (SEGMENTS - 1) // TAU
SEED = 42
SHINGLE = 3
#: Members that a bucket may have for comparing them all with each other.
DIRECT = 256
ONE = np.uint64(1)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a UTF-8 text's shingles, repeats included; of fewer words, of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(g, SEED) for g in grams), dtype=np.uint64)


def fingerprint_of(h: np.ndarray) -> int:
    """The 64 bits that over half the hashes have set."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    return fingerprint_of(shingle_hashes(text, shingle))


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(x) for x in utf8_texts(batch)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit number."""
    return gathered(docs).select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "id long, fp long")


def _rotated(fp: np.ndarray, start: int) -> np.ndarray:
    """Segment ``start`` moved to the lowest bits, the rest following around the ring."""
    s = np.uint64(start * WIDTH)
    return fp if start == 0 else (fp >> s) | (fp << np.uint64(BITS - start * WIDTH))


def chain_budgets(segments: int = SEGMENTS, tau: int = TAU) -> list[int]:
    """Differing bits allowed in a chain of 1, 2, ... segments."""
    return [length * tau // segments for length in range(1, segments + 1)]


_BUDGETS = chain_budgets()
_CHAIN_MASK = np.uint64((1 << (CHAIN * WIDTH)) - 1)


def _keys(batches):
    """Each fingerprint under its 16 chain keys (the start in the high bits)."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(SEGMENTS):
            key = (_rotated(fp, start) & _CHAIN_MASK) | np.uint64(start << 32)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])


def _within_budgets(diff: np.ndarray) -> np.ndarray:
    """For rotated differences: does every longer chain keep its budget (the last is the Hamming check)?"""
    alive = np.arange(len(diff))
    for length in range(CHAIN + 1, SEGMENTS + 1):
        mask = np.uint64((1 << (length * WIDTH)) - 1) if length < SEGMENTS else ~np.uint64(0)
        alive = alive[np.bitwise_count(diff[alive] & mask) <= _BUDGETS[length - 1]]
        if not len(alive):
            break
    return alive


def _bucket_links(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that link in one bucket of distinct rotated fingerprints with equal chains."""
    n = len(ring)
    if n <= DIRECT:
        a, b = np.triu_indices(n, 1)
        ok = _within_budgets(ring[a] ^ ring[b])
        return a[ok], b[ok]
    order = np.argsort(ring)
    ranked = ring[order]
    free = [ONE << np.uint64(i) for i in range(CHAIN * WIDTH, BITS)]
    masks = np.array(free + [x | y for i, x in enumerate(free) for y in free[i + 1 :]], dtype=np.uint64)
    masks = masks[_within_budgets(masks)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for mask in masks:
        want = ranked ^ mask
        at = np.minimum(np.searchsorted(ranked, want), n - 1)
        hit = np.flatnonzero((ranked[at] == want) & (want > ranked))
        if len(hit):
            found.append((order[hit], order[at[hit]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the least member that the links reach."""
    label = np.arange(n)
    while len(a):
        lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = lo != hi
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(label, hi[open_], lo[open_])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def _links(batches):
    """Sorted by (key, fp): the links of each bucket, as a forest.  A bucket that spans batches is carried on."""
    held_key, held = None, []

    def solve(key: int, fp: np.ndarray):
        fp = np.unique(fp)
        if len(fp) < 2:
            return None
        a, b = _bucket_links(_rotated(fp, (key >> 32) & 0xFFFF))
        label = _forest(len(fp), a, b)
        at = np.flatnonzero(label != np.arange(len(fp)))
        return (fp[at], fp[label[at]]) if len(at) else None

    def out(parts):
        parts = [x for x in parts if x is not None]
        if parts:
            a, b = (np.concatenate([p[i] for p in parts]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        parts = []
        if held_key is not None:
            if key[0] == held_key:
                held.append(fp[: ends[0]].copy())
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                parts.append(solve(held_key, np.concatenate(held)))
                held_key, held = None, []
        if len(starts):
            for s, e in zip(starts[:-1], ends[:-1]):
                if e - s > 1:
                    parts.append(solve(int(key[s]), fp[s:e]))
            held_key, held = int(key[-1]), [fp[starts[-1] :].copy()]
        yield from out(parts)
    if held_key is not None:
        yield from out([solve(held_key, np.concatenate(held))])


def links(prints: DataFrame, column: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints that span each linked group of each bucket."""
    n = parallelism(prints.sparkSession)
    keyed = prints.select(F.col(column).alias("fp")).mapInArrow(_keys, "key long, fp long")
    return keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of ``edges`` (a, b).

    Alternating large-star and small-star; every step is a table in the shared
    folder.  The least neighbour of a node is an aggregate, so a node with very
    many neighbours is never gathered in one task.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", narrow=True)

    def signature(df):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    before = signature(now)
    while before[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "cc", narrow=True)
        discarded(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "u").alias("u"), "v", "m", F.col("u").alias("own"))
        small = small.select(F.explode(F.array(F.struct(F.col("own").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = staged(small.filter("u <> v").distinct(), "cc", narrow=True)
        discarded(large)
        after = signature(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, fp, component_id): one row per document; component_id is the least id reachable."""
    prints = staged(fingerprints(docs, id_column), "simhash")
    own = staged(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-distinct", narrow=True)
    roots = components(links(own))
    joined = own.join(roots, own.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    joined = staged(joined, "simhash-roots", narrow=True)
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = joined.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
