"""Near-dedup of the pipeline: texts with Jaccard similarity 0.8 or more of their 5-word shingles link.

Candidates come from two sources, and every link is checked on the whole texts.

The SimHash operator's pigeonring filter, over fingerprints of 5-word shingles,
finds texts that differ in up to ``simhash.TAU`` bits.  Alone it can't do: texts
of similarity 0.8 differ in about 10 of 64 bits, which no chain of segments can
look up.  So the pigeonhole is also put to the shingles themselves, exactly:

A text is the set of its shingles (64-bit hashes stand for them; a text of fewer
words is one shingle, a text without words the empty set).  Sets of n1 <= n2
shingles with similarity 4/5 have n2 <= 5/4 n1 and differ in at most
(n1 + n2) / 9 shingles.  A class of sizes cuts the hashes into ranges.  A set
allows for D = (n + min(5/4 n, class top)) / 9 differing shingles, each of which
spoils one range.  Its ranges stand in a row: those with shingles in ascending order,
then the empty ones.  Two linked sets agree in all ranges but D at most, and those in
which they agree stand in the same order in both rows; so the l-th of these is among
the first D + l of either row.  The first D + 1 are a set's keys, and no pair is lost.
Classes double, and a text whose partners may lie in the next class has keys there
too.

Crowded buckets: a passage that many texts share fills ranges of many short texts with
nothing else, and puts them all in one bucket.  A bucket of more than CROWDED rows is
split by a second agreeing range, one behind the first among the first D + 2, what is
still crowded by a third, up to LEVELS (a class has so many ranges more than can
differ).  Few texts are filled by the passage alone in several ranges, so buckets
shrink from level to level.  Where they don't, or where but CROWDED rows lie outside
the bucket's largest component, as among near copies, it is dealt to pairs of blocks of
CROWDED rows instead; rows of that component meet those of others only.  So no task
ever holds more than two blocks.

Large groups: members of a bucket are first checked against its least member and
their neighbours, which are all pairs of up to COVERED members; only larger buckets go
on.  In those that these links leave in several components, the pairs that are still
possible come next where they are few, and the bucket is done.  Where they are many, each
member meets the nearest one of another component, round after round (as in
Boruvka's algorithm, so a round is linear in the bucket too), until a round finds no
link; last come the pairs that are still possible.  Near and possible are told by
sizes and parity sketches: each differing shingle changes one bit of the parities
of the shingles' hashes, so more differing bits than shingles may differ rule a
pair out, for certain.

Defined results: texts without words link with each other; repeated rows too;
null texts are texts without words; very long texts are like any other; other
columns travel along; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import deltas, discarded, distinct, distinct_at, fresh_name, gathered, input_bytes, pack, parallelism, released, staged, unpack, utf8_texts
from quarry.llm.exact_dedup import without
from quarry.llm.simhash import components, fingerprint_of, links, shingle_hashes

SHINGLE = 5
#: Input bytes for each shard of keys.
SHARD_BYTES = 2 << 20
#: Rounds in which each member meets the nearest one of another component.
ROUNDS = 4
#: Members of a bucket whose pairs are all among those with the least one and with neighbours.
COVERED = 3
#: Possible pairs for each member up to which a bucket passes them all on at once.
FEW = 4
#: Up to this many texts that pairs ask for, their rows are broadcast to pick them; for more, all texts are shuffled.
PICKED = 500_000
#: Bits of a sketch at least.
LEAST_BITS = 512
#: Pairs of a bucket that one batch holds.
PAIRS = 1 << 18
#: Rows of a bucket that are compared with each other in one task.
CROWDED = 1024
#: Agreeing ranges by which buckets are split at most: any class has this many ranges more than can differ.
LEVELS = 4
_BATCH_KEYS = 1 << 20
_KEY_BITS = np.uint64(40)
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, ascending."""
    return distinct(shingle_hashes(text, SHINGLE))


def differing(n: int, top: int) -> int:
    """Shingles in which a set of ``n`` may differ from a set of its size or more, up to ``top``."""
    return (n + min(n * 5 // 4, top)) // 9


def _ranges(top: int) -> int:
    """Ranges of a class: more than can differ, and mostly not empty for the class's sizes."""
    return top // 4 + 4


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _PRIMES[2]
    return x ^ (x >> np.uint64(29))


class Ranges(NamedTuple):
    """A set's ranges in one class, the full ones in ascending order before the empty ones: places in that order, and keys."""

    level: int
    wanted: int
    places: np.ndarray
    keys: np.ndarray

    def first(self, agreeing: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(places, keys) of the ranges among which the first so many are that agree with a linked set's."""
        return self.places[: self.wanted + agreeing - 1], self.keys[: self.wanted + agreeing - 1]


def ranges(own: np.ndarray) -> list[Ranges]:
    """Of a set of shingles that is not empty, in each class in which it may have a partner."""
    n = len(own)
    level = (n - 1).bit_length()  # sizes up to 2 ** level
    made = []
    for level in (level, level + 1) if n * 5 // 4 > 1 << level else (level,):
        top = 1 << level
        m = _ranges(top)
        at = ((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascending, as the hashes are
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        full, empty = at[starts], np.setdiff1d(np.arange(m, dtype=np.uint64), at[starts])
        sums = np.concatenate([np.add.reduceat(own, starts), np.zeros(len(empty), np.uint64)])
        salt = _PRIMES[:1] * np.uint64(level)  # as an array, which wraps silently
        places = np.concatenate([full, empty + np.uint64(m)])
        made.append(Ranges(level, differing(n, top) + 1, places.astype(np.int64), _mixed(sums + salt + places * _PRIMES[1])))
    return made


def keys(own: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; two linked sets share one at least."""
    return np.concatenate([r.first()[1] for r in ranges(own)]) if len(own) else np.zeros(1, np.uint64)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the set's hashes over a power of two bits, two to four for each shingle."""
    bits = max(LEAST_BITS, 2 << (len(own) - 1).bit_length()) if len(own) else LEAST_BITS
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _folded(words: np.ndarray, n: int) -> np.ndarray:
    """Rows of sketch words folded to ``n`` words: what a smaller sketch of the same sets would hold."""
    while words.shape[1] > n:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


_ENTRIES = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("payload", pa.binary())])
_ENTRIES_DDL = "kind string, shard long, payload binary"


def _entries(n_shards: int):
    """(row, text) -> the cells of each shard (keys, rows), and of each row its fingerprint and size."""
    bits = np.uint64(n_shards.bit_length() - 1)

    def out(kind, found):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(found), pa.string()), pa.array([s for s, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], schema=_ENTRIES)

    def flush(rows, parts, prints, sizes):
        key = np.concatenate(parts)
        row = np.repeat(np.array(rows, np.int64), [len(p) for p in parts])
        order = np.argsort(key)
        key, row = key[order], row[order]
        shard = (key >> (np.uint64(64) - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
        short = (key << bits) >> (np.uint64(64) - _KEY_BITS)
        starts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
        yield out("cell", [(int(shard[a]), pack(deltas(short[a:b]), row[a:b])) for a, b in zip(starts, [*starts[1:], len(key)])])
        yield out("print", [(0, pack(np.array(rows, np.int64), np.array(prints, np.uint64), np.array(sizes, np.int64)))])

    def run(batches):
        rows, parts, prints, sizes, held = [], [], [], [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), utf8_texts(batch)):
                hashes = shingle_hashes(text, SHINGLE)
                prints.append(fingerprint_of(hashes))
                own = distinct(hashes)
                parts.append(keys(own))
                rows.append(row)
                sizes.append(len(own))
                held += len(parts[-1]) + 8
                if held >= _BATCH_KEYS:
                    yield from flush(rows, parts, prints, sizes)
                    rows, parts, prints, sizes, held = [], [], [], [], 0
        if rows:
            yield from flush(rows, parts, prints, sizes)
        released()

    return run


def _prints(batches):
    for batch in batches:
        for payload in batch.column(0):
            row, fp, n = unpack(payload.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(fp.view(np.int64)), pa.array(n)], names=["row", "fp", "n"])


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, the lesser number first."""
    values, at = distinct_at(np.concatenate([a, b]))
    a, b = at[: len(a)], at[len(a) :]
    code = distinct(np.minimum(a, b) * len(values) + np.maximum(a, b))
    return values[code // max(1, len(values))], values[code % max(1, len(values))]


_FOUND = pa.schema([("kind", pa.string()), ("x", pa.int64()), ("y", pa.int64())])


def _crowded(key, group):
    """A shard's cells -> its buckets (key, row) of more than COVERED rows, and pairs: each row with the least of its bucket and with its neighbour."""
    cells = [unpack(x.as_py()) for x in group["payload"]]
    k = np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _ in cells])
    r = np.concatenate([x for _, x in cells])
    order = np.lexsort((r, k))
    k, r = k[order], r[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    k, r = k[fresh], r[fresh]
    same = np.concatenate([[False], k[1:] == k[:-1]])  # as the one before
    several = same.copy()
    several[:-1] |= same[1:]
    k, r, same = k[several], r[several], same[several]
    least = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
    later = np.flatnonzero(same)
    a, b = _unique_pairs(np.concatenate([r[least[later]], r[later - 1]]), np.concatenate([r[later], r[later]]))
    starts = np.flatnonzero(~same)
    large = np.repeat(np.diff(np.append(starts, len(k))) > COVERED, np.diff(np.append(starts, len(k))))
    k, r = k[large], r[large]
    whole = (k | np.uint64(key[0].as_py() << int(_KEY_BITS))).view(np.int64) if len(k) else k.view(np.int64)
    released()
    return pa.table([pa.array(["bucket"] * len(k) + ["pair"] * len(a), pa.string()), pa.array(np.concatenate([whole, a])), pa.array(np.concatenate([r, b]))], schema=_FOUND)


def _groups(batches):
    """Sorted by key: each key with the further columns of its rows, as lists of Arrow arrays' chunks joined."""
    held_key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and key[s] != held_key:
                yield int(held_key), [pa.concat_arrays(x) for x in zip(*held)]
                held = []
            held_key = key[s]
            held.append([c.slice(s, e - s) for c in batch.columns[1:]])
    if held:
        yield int(held_key), [pa.concat_arrays(x) for x in zip(*held)]


def _batched(pairs):
    """Pairs (a < b), without repetition inside a batch."""
    held, n = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _unique_pairs(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))], names=["a", "b"])

    for a, b in pairs:
        held.append((a, b))
        n += len(a)
        if n >= PAIRS:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _compared(root: np.ndarray, n: np.ndarray, sketches: list[bytes]):
    """(member, others, differing bits): each member against all that come after it by size, have another root, and may link as sizes and sketches tell."""
    order = np.argsort(n, kind="stable")
    by_width: dict[int, list[int]] = {}
    for at in order.tolist():
        by_width.setdefault(len(sketches[at]), []).append(at)
    # a set's partners have sketches as wide as its own or twice
    for width, own in by_width.items():
        low = np.stack([np.frombuffer(sketches[i], np.uint64) for i in own])
        wide = by_width.get(2 * width, [])
        high = _folded(np.stack([np.frombuffer(sketches[i], np.uint64) for i in wide]), width // 8) if wide else low[:0]
        members, words = np.array(own + wide), np.concatenate([low, high])
        size, group = n[members], root[members]
        for k in range(len(own)):
            end = int(np.searchsorted(size, size[k] * 5 // 4, side="right"))
            at = np.arange(k + 1, end)[group[k + 1 : end] != group[k]]
            if len(at):
                apart = np.bitwise_count(words[at] ^ words[k]).sum(axis=1, dtype=np.int64)
                may = 9 * apart <= size[at] + size[k]
                if may.any():
                    yield members[k], members[at[may]], apart[may]


def _possible(row: np.ndarray, root: np.ndarray, n: np.ndarray, sketches: list[bytes]):
    """All pairs of one bucket's rows with different roots that may link."""
    for i, others, _ in _compared(root, n, sketches):
        yield np.repeat(row[i], len(others)), row[others]


def _few_or_nearest(row: np.ndarray, root: np.ndarray, n: np.ndarray, sketches: list[bytes], few: int):
    """(pairs, are these all): the pairs of one bucket's rows with different roots that may link, up to ``few`` a row.

    Of more, each row with the one of another root that it may link with and that is nearest.
    """
    best, who = np.full(len(row), np.iinfo(np.int64).max), np.full(len(row), -1)
    held, seen = [], 0
    for i, others, apart in _compared(root, n, sketches):
        seen += len(others)
        if seen <= few * len(row):
            held.append((np.repeat(row[i], len(others)), row[others]))
        k = int(apart.argmin())
        if apart[k] < best[i]:
            best[i], who[i] = apart[k], others[k]
        better = apart < best[others]
        best[others[better]], who[others[better]] = apart[better], i
    if seen <= few * len(row):
        return held, True
    has = np.flatnonzero(who >= 0)
    return [(row[has], row[who[has]])], False


def _crossing(last: bool, few: int):
    """Of each key's rows (row, root, n, sketch): pairs (a, b) with different roots, and (key, null) where more may link; in the ``last`` round all pairs."""

    def run(batches):
        more = []

        def pairs():
            for key, (row, root, n, sketches) in _groups(batches):
                row, root, n = (x.to_numpy(zero_copy_only=False) for x in (row, root, n))
                if (root == root[0]).all():
                    continue
                if last:
                    yield from _possible(row, root, n, sketches.to_pylist())
                    continue
                found, all_ = _few_or_nearest(row, root, n, sketches.to_pylist(), few)
                yield from found
                if not all_:
                    more.append(key)

        yield from _batched(pairs())
        if more:
            yield pa.RecordBatch.from_arrays([pa.array(more, pa.int64()), pa.nulls(len(more), pa.int64())], names=["a", "b"])

    return run


def _bodies(batches):
    """(row, text) -> (row, sketch, the text's words compressed)."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [b" ".join(x.lower().split()) for x in utf8_texts(batch)]
        sketches = [sketch(shingles(x)).tobytes() for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches, pa.binary()), pa.array(map(packer.compress, texts), pa.binary())], names=["row", "sketch", "body"])


def _checked(batches):
    """Sorted by a: the pairs (a, b, of_a, of_b) whose sets have similarity 4/5 at least, in whole numbers."""
    last, own, unpacker = None, np.empty(0, np.uint64), zstandard.ZstdDecompressor()
    for batch in batches:
        keep = []
        for a, of_a, of_b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if a != last:
                last, own = a, shingles(unpacker.decompress(of_a.as_py()))
            other = shingles(unpacker.decompress(of_b.as_py()))
            both = np.concatenate([own, other])
            both.sort()
            keep.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _may_link(batches):
    """The pairs (a, b, sketch of a, of b, shingles of both) that their sketches allow."""
    for batch in batches:
        keep = []
        for x, y, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist()):
            x, y = sorted((np.frombuffer(v.as_py(), np.uint64)[None] for v in (x, y)), key=lambda v: v.shape[1])
            keep.append(9 * int(np.bitwise_count(x ^ _folded(y, x.shape[1])).sum()) <= n)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shard_and_short(key: np.ndarray, bits: int) -> np.ndarray:
    """What ``_crowded`` calls a bucket: the shard in the high bits, and the key's further bits."""
    key = key.astype(np.uint64)
    shard = key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)
    return ((shard << _KEY_BITS) | ((key << np.uint64(bits)) >> (np.uint64(64) - _KEY_BITS))).view(np.int64)


def _described_ranges(batches):
    """(row, body) -> (row, what ``_split`` needs of its ranges)."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for body in batch.column(1):
            own = shingles(unpacker.decompress(body.as_py()))
            found = ranges(own) if len(own) else []
            head = np.array([x for r in found for x in (r.level, r.wanted)], np.int64)
            out.append(pack(head, *(x for r in found for x in (r.places, r.keys))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["row", "ranges"])


def _split(agreeing: int, shard_bits: int):
    """(key, row, level, last, ranges, rows) -> (key, row, level, last, rows): the row under each further range that may agree.

    ``level``, ``last``: the class and the range's place that the key came from; at first only the key tells.
    """

    def out(parts):
        columns = [np.concatenate(x) for x in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), pa.array(columns[1]), pa.array(columns[2], pa.int32()), pa.array(columns[3]), pa.array(columns[4])], names=["key", "row", "level", "last", "parent"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for key, row, level, last, packed, rows in zip(*(batch.column(i).to_pylist() for i in range(6))):
                arrays = unpack(packed)
                for k, (own_level, wanted) in enumerate(arrays[0].reshape(-1, 2).tolist()):
                    own = Ranges(own_level, wanted, *arrays[1 + 2 * k : 3 + 2 * k])
                    if level is None:
                        places, made = own.first()
                        came = places[_shard_and_short(made, shard_bits) == key]
                    else:
                        came = [last] if own_level == level else []
                    places, found = own.first(agreeing)
                    for place in came:
                        later = places > place
                        new = _mixed(found[later] + _mixed(np.array([key], np.int64).view(np.uint64)) * _PRIMES[0])
                        parts.append((new, np.full(len(new), row), np.full(len(new), own_level), places[later], np.full(len(new), rows)))
                        held += len(new)
                if held >= PAIRS:
                    yield out(parts)
                    parts, held = [], 0
        if held:
            yield out(parts)

    return run


def _uncrowded(open_: DataFrame, known: DataFrame, bodies: DataFrame, shards: int) -> DataFrame:
    """The buckets (key, row) with the crowded ones split; (key, row).

    Rows meet in the same buckets, or in buckets that stand for them, if they can link.
    """

    roots = known.select("row", "root")

    def sized(buckets):
        """With their number of rows, their largest component and its rows; buckets whose rows are all in one component go."""
        counts = buckets.join(roots, "row").groupBy("key", "root").agg(F.count(F.lit(1)).alias("own"))
        spread = counts.groupBy("key").agg(F.sum("own").alias("rows"), F.max("own").alias("mains"), F.max_by("root", F.struct("own", "root")).alias("main")).filter("rows > mains")
        return staged(buckets.join(spread, "key"), "near-sized-buckets", narrow=True)

    bits = shards.bit_length() - 1
    first = open_.select("key", "row", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("parent"))
    now, told, done, used = sized(first), None, [], []
    for agreeing in range(2, LEVELS + 2):
        # what is mostly one component, or has not shrunk to half, is not split: its rows agree, and would only stand under more keys
        crowded = (F.col("rows") - F.col("mains") > CROWDED) & (F.col("parent").isNull() | (2 * F.col("rows") <= F.col("parent"))) & F.lit(agreeing <= LEVELS)
        used.append(now)
        done.append(now.filter(~crowded))
        now = now.filter(crowded)
        if now.isEmpty():
            break
        if told is None:
            told = staged(bodies.join(now.select("row").distinct(), "row", "left_semi").select("row", "body").mapInArrow(_described_ranges, "row long, ranges binary"), "near-ranges")
        split = now.join(told.hint("merge"), "row").select("key", "row", "level", "last", "ranges", "rows").mapInArrow(_split(agreeing, bits), "key long, row long, level int, last long, parent long")
        several = staged(split.distinct(), "near-split", narrow=True)
        now = sized(several)
        discarded(several)
    whole = reduce(DataFrame.unionByName, done).select("key", "row", "rows", "mains", "main").distinct()
    of_main, of_rest = (F.ceil(n / CROWDED).cast("int") for n in (F.col("mains"), F.col("rows") - F.col("mains")))
    own = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    mains = F.transform(numbers(of_rest), lambda o: F.struct(F.lit(1).alias("kind"), o.alias("x"), own(of_main).alias("y")))
    apart = F.transform(numbers(of_main), lambda o: F.struct(F.lit(1).alias("kind"), own(of_rest).alias("x"), o.alias("y")))
    among = F.transform(numbers(of_rest), lambda o: F.struct(F.lit(0).alias("kind"), F.least(own(of_rest), o).alias("x"), F.greatest(own(of_rest), o).alias("y")))
    dealt = whole.filter(F.col("rows") > CROWDED).join(roots, "row").withColumn("m", F.when(F.col("root") == F.col("main"), mains).otherwise(F.concat(apart, among)))
    dealt = dealt.select("key", "row", F.explode("m").alias("m")).select(F.xxhash64("key", "m.kind", "m.x", "m.y").alias("key"), "row")
    out = staged(whole.filter(F.col("rows") <= CROWDED).select("key", "row").unionByName(dealt).distinct(), "near-buckets", narrow=True)
    discarded(*used, *([told] if told is not None else []))
    return out


def _linked(pairs: DataFrame, described: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) that link.  Sizes and sketches come first; then one text of each pair left travels, and meets the other."""
    of = lambda x: described.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    sized = pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").filter("5 * na >= 4 * nb AND 5 * nb >= 4 * na")
    near = staged(sized.select("a", "b", "sa", "sb", F.expr("na + nb").alias("n")).mapInArrow(_may_link, "a long, b long"), "near-sized", narrow=True)

    def of_pairs(x):
        """The bodies that the pairs ask for: few of all, so the others stay where they are."""
        rows = staged(near.select(F.col(x).alias("row")).distinct(), "near-asked", narrow=True)
        few = rows.count() <= PICKED
        return bodies.select("row", "body").join(F.broadcast(rows) if few else rows.hint("merge"), "row", "left_semi").select(F.col("row").alias(x), F.col("body").alias(f"of_{x}"))

    met = near.join(of_pairs("b").hint("merge"), "b").join(of_pairs("a").hint("merge"), "a")
    return met.select("a", "b", "of_a", "of_b").mapInArrow(_checked, "a long, b long")


def _print_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) that SimHash links: rows of one fingerprint with the least of them, and the least rows of linked fingerprints."""
    own = staged(prints.groupBy("fp").agg(F.min("row").alias("least")), "near-prints", narrow=True)
    same = prints.join(own, "fp").filter("row <> least").select(F.col("least").alias("a"), F.col("row").alias("b"))
    found = links(own).withColumnsRenamed({"a": "fa", "b": "fb"})
    found = found.join(own.select(F.col("fp").alias("fa"), F.col("least").alias("x")), "fa").join(own.select(F.col("fp").alias("fb"), F.col("least").alias("y")), "fb")
    return same.union(found.select(F.least("x", "y"), F.greatest("x", "y")))


def shard_count(rows: DataFrame) -> int:
    """A power of two that grows with the input's size."""
    return 1 << max(4, min(20, (input_bytes(rows) // SHARD_BYTES).bit_length()))


def near_groups(texts: DataFrame, shards: int | None = None) -> DataFrame:
    """(node, root) for every row of ``texts`` (row, text; rows distinct) that links with another; root is the least row.

    Staged tables go as soon as nothing needs them any more.
    """
    n = parallelism(texts.sparkSession)
    n_shards = shards or shard_count(texts)
    texts = texts.select(F.col("row").cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    entries = staged(gathered(texts).mapInArrow(_entries(n_shards), _ENTRIES_DDL), "near-entries", "kind")
    prints = staged(entries.filter("kind = 'print'").select("payload").mapInArrow(_prints, "row long, fp long, n long"), "near-rows")
    found = staged(entries.filter("kind = 'cell'").groupBy("shard").applyInArrow(_crowded, "kind string, x long, y long"), "near-found", "kind")
    discarded(entries)
    buckets = found.filter("kind = 'bucket'").select(F.col("x").alias("key"), F.col("y").alias("row"))
    pairs = found.filter("kind = 'pair'").select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = staged(pairs.union(_print_pairs(prints)).distinct(), "near-pairs", narrow=True)
    members = first.select(F.col("a").alias("row")).union(first.select("b")).distinct()
    bodies = staged(texts.join(members, "row", "left_semi").mapInArrow(_bodies, "row long, sketch binary, body binary"), "near-bodies")
    described = staged(bodies.select("row", "sketch").join(prints.select("row", "n"), "row"), "near-described")
    edges = [staged(_linked(first, described, bodies), "near-edges")]
    checked, used, rounds, split = [first], [], 0, None
    all_of = lambda tables: reduce(DataFrame.unionByName, tables)
    while True:
        roots = components(all_of(edges))
        known = staged(described.join(roots, F.col("row") == F.col("node"), "left").select("row", F.coalesce("root", "row").alias("root"), "n", "sketch"), "near-known", narrow=True)
        if split is None:
            split = buckets = _uncrowded(buckets, known, bodies, n_shards)
        # only buckets whose members aren't all in one component go on
        spread = buckets.join(known.select("row", "root"), "row").groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"))
        open_ = staged(buckets.join(spread.filter("least <> most").select("key"), "key", "left_semi"), "near-open", narrow=True)
        if open_.isEmpty():
            discarded(known, open_)
            break
        dealt = open_.join(known, "row").select("key", "row", "root", "n", "sketch").repartition(n, "key").sortWithinPartitions("key")
        last = rounds == ROUNDS
        met = staged(dealt.mapInArrow(_crossing(last, FEW), "a long, b long").distinct(), "near-met", narrow=True)
        fresh = staged(met.filter("b IS NOT NULL").join(all_of(checked), ["a", "b"], "left_anti"), "near-cross", narrow=True)
        discarded(known)
        more = staged(_linked(fresh, described, bodies), "near-edges")
        edges.append(more)
        checked.append(fresh)
        used += [open_, met]
        left = met.filter("b IS NULL").select(F.col("a").alias("key"))
        if last or left.isEmpty():
            break
        buckets = open_.join(left, "key", "left_semi")  # all others are done
        rounds = rounds + 1 if not more.isEmpty() else ROUNDS  # no link any more: what is left comes last
    discarded(found, bodies, prints, described, split, *checked, *used)
    roots = components(all_of(edges))
    discarded(*edges)
    return roots


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each near-duplicate group: smallest id, then input order."""
    row = fresh_name(docs, "row")
    whole = staged(gathered(docs).withColumn(row, F.monotonically_increasing_id()), "near-rows")
    rows = whole.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("own"), "text")
    found = near_groups(rows.select("row", "text")).select(F.col("node").alias("row"), F.col("root").alias("group"))
    # ``components`` may leave the root itself out
    found = found.union(found.select(F.col("group").alias("row"), "group")).distinct()
    several = staged(found.join(rows.select("row", "own"), "row"), "near-several", narrow=True)
    # tables of their own, so that joins can split the rows of a large group
    best = staged(several.groupBy("group").agg(F.min(F.struct(F.col("own").isNull().alias("no_id"), "own", "row")).alias("best")), "near-best", narrow=True)
    drop = several.join(best, "group").filter(F.col("row") != F.col("best.row")).select(F.col("row").alias(row))
    left = without(whole, drop, row).drop(row)
    discarded(several, best)
    return left
