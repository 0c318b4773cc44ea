"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A key descends the tree.  At each level every child draws -ln(u) / weight, u being
a hash of the key and the child's name, and the least draw wins; so a child gets its
weight's share, and a draw changes only with the child itself.

Growth: what a change adds is a layer of its own, a small tree that holds the added
weight alone.  At the root the regions of all layers draw against each other, and
the descent goes on inside the winner's layer.  A sibling's draws stay what they
were, so a key that moves has been won by the new layer, which leads to the grown
shards only: adding a shard, or weight to one, moves keys into it and nowhere else.
(Were the new weight put into the old region's own draw, keys that it wins would be
dealt anew among that region's old shards.)

Shrinking: a shard keeps a key with the probability that is left of its weight, told
by a further hash of the key; keys that are turned away descend again by the draws of
the next attempt.  Only keys of the shrunk shards move.

Slots number a shard's rows in the order of doc_id (nulls first), checksum and size.
The rows are range-partitioned in that order, so that a shard's rows, and the rows of
one doc_id too, are dealt to many tasks; each task numbers its own, and adds what the
tasks before it hold of its first shard.

Defined results: the law is ``key``.  A null doc_id is a key like any other; a null
text has size 1 and the checksum of no bytes; very long texts are like any other;
rows of one doc_id stay together, whatever their texts; repeated rows have slots of
their own, in any order, as they can't be told apart; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, gathered, parallelism, staged, table

#: Bits of a draw; a double holds them exactly.
DRAW_BITS = 52


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def draw(key: bytes, node: bytes) -> float:
    """A number between 0 and 1, from the hash of the node's name and the key."""
    return ((int.from_bytes(hashlib.md5(node + key).digest()[:8], "big") >> (64 - DRAW_BITS)) + 0.5) / (1 << DRAW_BITS)


def _node(attempt: int, *path: object) -> bytes:
    return "/".join(map(str, (attempt, *path))).encode() + b":"


@dataclass(frozen=True)
class HashTree:
    """Layers of region -> rack -> shard -> weight; ``left``: what a shrunk shard has left of its weight, as a share."""

    layers: tuple[dict[str, dict[str, dict[int, float]]], ...] = ()
    left: dict[int, float] = field(default_factory=dict)

    @classmethod
    def of(cls, shards: Iterable[Shard]) -> HashTree:
        return cls().grown(shards)

    def grown(self, added: Iterable[Shard]) -> HashTree:
        """The tree with the given weights added, to shards that it has or to new ones."""
        layer: dict[str, dict[str, dict[int, float]]] = {}
        for s in added:
            if not s.weight > 0:
                raise ValueError(f"weight of shard {s.number}: {s.weight}")
            rack = layer.setdefault(s.region, {}).setdefault(s.rack, {})
            rack[s.number] = rack.get(s.number, 0.0) + s.weight
        return HashTree((*self.layers, layer), self.left) if layer else self

    def shrunk(self, number: int, share: float) -> HashTree:
        """The tree in which a shard has ``share`` of its present weight; 0 takes it out."""
        if not 0 <= share <= 1:
            raise ValueError(f"share: {share}")
        return HashTree(self.layers, self.left | {number: self.left.get(number, 1.0) * share})

    def shards(self) -> dict[int, float]:
        """Each shard's present weight."""
        out: dict[int, float] = {}
        for layer in self.layers:
            for racks in layer.values():
                for rack in racks.values():
                    for number, weight in rack.items():
                        out[number] = out.get(number, 0.0) + weight * self.left.get(number, 1.0)
        return out

    def _children(self, attempt: int):
        """The draws of an attempt: [(name, weight, racks: [(name, weight, shards: [(name, weight, number)])])]."""
        regions = []
        for at, layer in enumerate(self.layers):
            for region, racks in layer.items():
                inner = []
                for rack, shards in racks.items():
                    leaves = [(_node(attempt, at, region, rack, number), weight, number) for number, weight in shards.items()]
                    inner.append((_node(attempt, at, region, rack), sum(shards.values()), leaves))
                regions.append((_node(attempt, at, region), sum(w for _, w, _ in inner), inner))
        return regions

    def place(self, keys: list[bytes]) -> list[int]:
        """The shard of each key."""
        if not any(w > 0 for w in self.shards().values()):
            raise ValueError("no shard has weight")
        out, open_, attempt = [0] * len(keys), range(len(keys)), 0
        while open_:
            regions, again = self._children(attempt), []
            for i in open_:
                key, level = keys[i], regions
                for _ in range(3):  # region, rack, shard
                    level = level[0][2] if len(level) == 1 else min(level, key=lambda c: -math.log(draw(key, c[0])) / c[1])[2]
                share = self.left.get(level, 1.0)
                if share == 1.0 or draw(key, _node(attempt, "left", level)) < share:
                    out[i] = level
                else:
                    again.append(i)
            open_, attempt = again, attempt + 1
        return out


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else str(doc_id).encode()


#: Racks of a region, and shards of a rack, of ``base_tree``.
RACKS, SHARDS_OF_RACK = 2, 2


def base_tree(shards: int) -> HashTree:
    """Equal weights: two shards a rack, two racks a region."""
    return HashTree.of(Shard(i, f"region{i // (RACKS * SHARDS_OF_RACK)}", f"rack{i // SHARDS_OF_RACK}") for i in range(shards))


def grown_tree(shards: int, by: int = 1) -> HashTree:
    """``base_tree`` with ``by`` more shards, one after the other, at the places that a tree of so many would give them."""
    tree = base_tree(shards)
    for i in range(shards, shards + by):
        tree = tree.grown([Shard(i, f"region{i // (RACKS * SHARDS_OF_RACK)}", f"rack{i // SHARDS_OF_RACK}")])
    return tree


_PLACED = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("shard", pa.int32()), ("grown_shard", pa.int32())])


def placed(docs: DataFrame, tree: HashTree, grown: HashTree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard (by ``grown``, else null): one row per document."""

    def run(batches):
        for batch in batches:
            keys = [key_of(x) for x in batch.column(0).to_pylist()]
            later = grown.place(keys) if grown is not None else [None] * len(keys)
            yield arrow_rows(_PLACED, {"doc_id": batch.column(0), "size": batch.column(1), "text_crc32": batch.column(2), "shard": tree.place(keys), "grown_shard": later})

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = gathered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, grown_shard int")


#: Rows of one task of ``numbered``, about.
TASK_ROWS = 1 << 20


def _counted(batches):
    """Sorted by shard: each row's task, and its number among the task's rows of its shard."""
    task, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        at = []
        for shard in batch.column(batch.schema.get_field_index("shard")).to_pylist():
            n = n + 1 if shard == last else 0
            last = shard
            at.append(n)
        columns = [*batch.columns, pa.array([task] * len(at), pa.int64()), pa.array(at, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "task", "at"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``: their number in their shard, from 0, in the given order of columns.

    ``rows`` must be a table that reads the same each time; it may not have columns
    salt, task, at or before.
    """
    spark = rows.sparkSession
    keys = ["shard", *order, "salt"]  # the salt lets rows that are alike be dealt to several tasks
    tasks = max(rows.count() // TASK_ROWS, min(parallelism(spark), spark.sparkContext.defaultParallelism))
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop("salt")
    # ranges are sampled, so they are written once and read back
    dealt = staged(dealt.mapInArrow(_counted, ", ".join(f"{c} {t}" for c, t in [*rows.dtypes, ("task", "long"), ("at", "long")])), "sharding-slots")
    held = dealt.groupBy("shard", "task").agg((F.max("at") + 1).alias("n"))  # a row for each task and shard in it
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = staged(held.select("shard", "task", before.alias("before")), "sharding-starts", narrow=True)
    return dealt.join(starts, ["shard", "task"]).withColumn("slot", F.col("at") + F.col("before")).drop("task", "at", "before")


def assign(docs: DataFrame, tree: HashTree, grown: HashTree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard, slot: one row per document."""
    return numbered(staged(placed(docs, tree, grown), "sharding-rows"), ["doc_id", "text_crc32", "size"])


SHARDS = 8


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(table(spark, sf_dir, "documents"), base_tree(SHARDS), grown_tree(SHARDS))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _draw_sql(node: str, weight: str) -> str:
    return f"-ln((('0x' || substr(md5({node} || ':' || key), 1, {DRAW_BITS // 4}))::BIGINT + 0.5) / {1 << DRAW_BITS}) / {weight}"


def _levels_sql(shards: int) -> str:
    """The rows (layer, region, rack, shard) of ``grown_tree(shards)``."""
    tree = grown_tree(shards)
    return ", ".join(f"({at}, '{region}', '{rack}', {number})" for at, layer in enumerate(tree.layers) for region, racks in layer.items() for rack, leaves in racks.items() for number in leaves)


#: Checksums by the bytewise table method of CRC-32 (reflected polynomial 0xEDB88320); draws by weights of 1 a shard.
OP11_SQL = f"""
WITH RECURSIVE rounds(b, c, k) AS (
  SELECT range, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM rounds WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM rounds WHERE k = 8),
bytes AS (SELECT map(list(printf('%02X', range)), list(range::BIGINT)) AS of FROM range(256)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: of[x]),
                         lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, crc, bytes),
shards(layer, region, rack, shard) AS (VALUES {_levels_sql(SHARDS)}),
trees AS (SELECT unnest([0, 1]) AS last),
regions AS (
  SELECT r, key, last, arg_min((layer, region), {_draw_sql("'0/' || layer || '/' || region", "w")}) AS won
  FROM d, trees, (SELECT layer, region, count(*) AS w FROM shards GROUP BY ALL) WHERE layer <= last GROUP BY r, key, last),
racks AS (
  SELECT r, key, last, won, arg_min(rack, {_draw_sql("'0/' || layer || '/' || region || '/' || rack", "w")}) AS rack
  FROM regions JOIN (SELECT layer, region, rack, count(*) AS w FROM shards GROUP BY ALL) ON won = (layer, region) GROUP BY r, key, last, won),
leaves AS (
  SELECT r, key, last, arg_min(shard, {_draw_sql("'0/' || layer || '/' || region || '/' || shards.rack || '/' || shard", "1")}) AS shard
  FROM racks JOIN shards ON won = (layer, region) AND racks.rack = shards.rack GROUP BY r, key, last),
found AS (
  SELECT d.*, a.shard, b.shard AS grown_shard
  FROM d JOIN leaves a ON a.r = d.r AND a.last = 0 JOIN leaves b ON b.r = d.r AND b.last = 1)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM found
"""
