"""Helpers shared by the operators: reading tables, shared staging, Arrow columns."""

from __future__ import annotations

import ctypes
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder stands in, but only while driver and
    executors are one process: on a cluster the executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    made = getattr(spark, "_quarry_shared_dir", None)
    if made is None:
        made = spark._quarry_shared_dir = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return made


def input_bytes(df: DataFrame) -> int:
    """The size of ``df`` as its plan estimates it; where the plan can't tell, 64 MB for each shuffle partition."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else parallelism(df.sparkSession) << 26


#: Input bytes for each task that ``gathered`` leaves.
TASK_BYTES = 4 << 20


def gathered(docs: DataFrame) -> DataFrame:
    """``docs`` in no more tasks than its size or the cluster's cores ask for: an input of many tiny files would make as many tiny files."""
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, min(1 << 30, input_bytes(docs) // TASK_BYTES)))


#: Shuffle partitions that one task of a narrow table writes together.
NARROW = 16


def staged(df: DataFrame, name: str, *partition_by: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor costs only the files' readers a retry, nothing upstream.
    ``narrow``: rows of a few numbers, of which a shuffle partition makes too small
    a file; every file costs the store several calls.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, parallelism(spark) // NARROW))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # the schema is given, so that an empty table can be read back too
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_path = path
    return found


def discarded(*tables: DataFrame) -> None:
    """Delete staged tables that nothing, no lazy result either, will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_mod(column: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % F.lit(mod)


def bounded(rows: DataFrame, label: str, limit: int, total: int, least: bool = False) -> list[tuple[str, object]]:
    """(text, label) of distinct texts of ``rows`` (h, text, label) with the least ``h``: at most ``limit``, of at most ``total`` characters together.

    The driver first sees hashes and lengths alone.  Of several labels of a text
    the greatest counts (or the ``least``).
    """
    sizes = rows.groupBy("h").agg(F.max(F.length("text")).alias("n")).orderBy("h").limit(limit).collect()
    last, held = None, 0
    for r in sizes:
        held += r["n"]
        if held > total:
            break
        last = r["h"]
    if last is None:
        return []
    # texts are picked by hash; two texts of one hash would both be there, and the first in order stays
    pick = F.min if least else F.max
    found = rows.filter(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("text").alias("text"), pick(label).alias("label"))
    return [(r["text"], r["label"]) for r in sorted(found.collect(), key=lambda r: r["h"])]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def utf8_texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The column's strings as UTF-8, null as empty, without decoding them."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    for x in col.cast(kind):
        yield x.as_py() or b""


def arrow_rows(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def blocks(values: list[str], chars: int):
    """Consecutive texts in lists of about ``chars`` characters; a longer text is a list of its own."""
    block, held = [], 0
    for text in values:
        if block and len(text) > chars:
            yield block
            block, held = [], 0
        block.append(text)
        held += len(text)
        if held >= chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as zstd-compressed byte planes."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.size else b""
        parts += [a.dtype.str.encode().ljust(4), struct.pack("<Q", a.size), planes]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        kind = np.dtype(data[at : at + 4].decode().strip())
        (n,) = struct.unpack_from("<Q", data, at + 4)
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at + 12).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 12 + n * kind.itemsize
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct numbers, ascending (by sorting, which is far faster than ``np.unique`` for whole numbers)."""
    a = np.sort(a)
    return a[_firsts(a)]


def distinct_at(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, ascending, and each number's place among them."""
    order = np.argsort(a)
    ranked = a[order]
    new = _firsts(ranked)
    at = np.empty(len(a), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


def _firsts(ranked: np.ndarray) -> np.ndarray:
    new = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    return new


def released() -> None:
    """Gives memory that is free in this Python worker back to the system (workers are kept for further tasks)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
