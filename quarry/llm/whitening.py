"""Embedding whitening by MLlib's singular value decomposition of the centred rows.

Entries become whole numbers; the fit list is each distinct vector of them once, so
copies count once.  Sums and deviations over it are exact.  The centred rows go to
``RowMatrix.computeSVD``, whose Gramian is summed on the executors; with all d
singular values asked for it is decomposed densely, to double precision (fewer would
be found by iteration, to a tolerance).  A singular value s of the centred rows is
the eigenvalue s * s / n of their covariance; the right singular vectors are its
eigenvectors.  The total variance does not come from the singular values but from the
exact deviations.  The driver holds the d x d vectors and a few sums of d numbers.

Defined results: rows whose vector is null, or holds null or a non-finite entry, give
no rows; nor do vectors of another length than most have (of lengths equally
frequent, the greatest counts), or of length 0.  Entries beyond LARGEST / 64 count as
LARGEST / 64, so that they fit in a long.  Components whose variance is below RANK of
the first's are none: fewer distinct vectors than dimensions, or constant dimensions,
give fewer components, and a fit list of one vector gives no rows.  A component's sign
is such that its largest entry is positive.  Repeated rows and null ids repeat; an
empty table gives an empty table; other columns are ignored.  ``deviation`` is a
decimal of 38 digits; the query's long raises an error where it does not hold it.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import gathered, staged, table

SCALE, SHIFT = 64, 1_000_000
#: Greatest absolute value of a scaled entry: beyond it a double has no fractions.
LARGEST = 1 << 53
COMPONENTS = 16
#: A component's variance is at least this share of the first one's: below it are the Gramian's rounding errors.
RANK = 1e-10


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray  # d x components, unit columns
    variances: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.variances))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n for whole numbers x; the mean's whole part is taken off exactly."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        return (x - np.array(whole, np.int64)).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """sum((n * x - S) ** 2) of each row, exactly."""
    if not x.size:
        return [0] * len(x)
    far = max(abs(n * int(v) - s) for edge in (x.min(axis=0), x.max(axis=0)) for v, s in zip(edge, sums))
    if far * far * len(sums) < 1 << 63 and max(map(abs, sums)) < 1 << 62 and n * int(np.abs(x).max()) < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(sums, dtype=object)
    return (d * d).sum(axis=1).tolist()


def whole_numbers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that count, with their entries as whole numbers."""
    entries = F.col(vector).cast("array<double>")
    sound = entries.isNotNull() & ~F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(entries, lambda c: F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), c * SCALE))) + SHIFT)
    found = staged(gathered(rows).filter(sound & (F.size(entries) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")), "whitening-rows")
    lengths = found.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return found.filter(F.size("x") == (lengths[0]["d"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _by_dimension(of_block):
    """mapInArrow over (x): a task's (dim, total) of what ``of_block`` sums up, as whole numbers of any size."""

    def run(batches):
        totals = None
        for batch in batches:
            if batch.num_rows:
                own = of_block(_matrix(batch.column(0)))
                totals = own if totals is None else [a + b for a, b in zip(totals, own)]
        if totals is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int32()), pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))], names=["dim", "total"])

    return run


def _totals(fit: DataFrame, of_block) -> list[int]:
    found = fit.select("x").mapInArrow(_by_dimension(of_block), "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total"))
    return [int(r["total"]) for r in sorted(found.collect(), key=lambda r: r["dim"])]  # a row for each dimension


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of distinct vectors ``x``; None where it has none or but one."""
    n = fit.count()
    if n < 2:
        return None
    sums = tuple(_totals(fit, lambda x: [int(s) + SHIFT * len(x) for s in (x - SHIFT).sum(axis=0, dtype=object if np.abs(x - SHIFT).max() > 1 << 40 else None)]))
    (spread,) = _totals(fit, lambda x: [sum(deviations(x, n, sums))])
    total = spread / n**3  # whole numbers, divided once
    whole = [s // n for s in sums]
    mean: Column = F.array(*(F.struct(F.lit(w).cast("long").alias("whole"), F.lit((s - w * n) / n).alias("rest")) for s, w in zip(sums, whole)))
    centred = fit.select(array_to_vector(F.zip_with("x", mean, lambda v, m: (v - m["whole"]).cast("double") - m["rest"])).alias("v"))
    d = len(sums)
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, d).computeSVD(d, False, RANK**0.5)
    variances = np.asarray(svd.s.toArray()) ** 2 / n
    vectors = np.asarray(svd.V.toArray())
    held = np.flatnonzero((variances > 0) & (variances >= RANK * variances[0]))[:components] if len(variances) else []
    vectors, variances = vectors[:, held], variances[held]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(held))] < 0, -1.0, 1.0)
    return Whitening(n, sums, vectors, variances, variances / total)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""

    def run(batches):
        own = None
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(_matrix(batch.column(0)))
                own = w.T @ w if own is None else own + w.T @ w
        if own is not None:
            i, j = (a.ravel() for a in np.indices(own.shape))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(own.ravel())], names=["i", "j", "total"])

    found = fit.select("x").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    return max((abs(r["total"] / model.n - (r["i"] == r["j"])) for r in found.collect()), default=0.0)  # a row for two components


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64())])
_OUT_DDL = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"
#: Rows of vectors whose output rows make one batch.
_BLOCK = 1024


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained) of every row (vec_id, x) and component."""
    k = len(model.variances)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                ids, x = batch.column(0).slice(at, _BLOCK), _matrix(batch.column(1).slice(at, _BLOCK))
                each = np.repeat(np.arange(len(ids)), k)
                far = pa.array([Decimal(v) for v in deviations(x, model.n, model.sums)], pa.decimal128(38, 0))
                columns = [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))), pa.array(np.full(len(each), model.n)), far.take(pa.array(each)), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, len(ids)))]
                yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    return rows.select("vec_id", "x").mapInArrow(run, _OUT_DDL)


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each sound vector and component."""
    found = whole_numbers(rows, vector)
    fit = staged(found.select("x").distinct(), "whitening-fit")
    model = fitted(fit, components)
    if model is None or not len(model.variances):
        return rows.sparkSession.createDataFrame([], _OUT_DDL + ", identity_error double")
    return whitened(found, model).withColumn("identity_error", F.lit(identity_error(fit, model)))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
