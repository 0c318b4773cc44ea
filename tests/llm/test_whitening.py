"""Whitening against numpy, exact deviations, vectors that do not count, tables of low rank."""

import math

import duckdb
import numpy as np
import pytest

from quarry.llm import registry, whitening

DDL = "vec_id long, embedding array<float>, label int, x string, n string, component string, d string"
NAN, INF = math.nan, math.inf


def plain(vectors, components=16):
    """(deviations, whitened up to sign, explained) by eigh over distinct vectors."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    v, e = v[:, e > 1e-9 * e[0]], e[e > 1e-9 * e[0]]
    return n, [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x], ((x - sums / n) @ v) / np.sqrt(e), e / np.trace(cov)


def agree(found, ids, vectors):
    n, far, want, explained = plain(vectors)
    assert len(found) == len(vectors) * len(explained)
    once = {(r["vec_id"], r["component"]): r for r in found}  # rows of one id have one vector here
    assert all(r == once[r["vec_id"], r["component"]] for r in found)
    keep = [k for k, i in enumerate(ids) if i not in ids[:k]]
    ids, far, want, vectors = [ids[k] for k in keep], [far[k] for k in keep], want[keep], [vectors[k] for k in keep]
    rows = sorted((i is not None, i or 0, c, r) for (i, c), r in once.items())
    got = np.array([r["whitened"] for *_, r in rows]).reshape(len(vectors), -1)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    want = want[order]
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * signs, want, atol=1e-7)
    assert [r["component"] for *_, r in rows[: len(explained)]] == list(range(1, len(explained) + 1))
    assert [int(r["deviation"]) for *_, r in rows[:: len(explained)]] == [far[i] for i in order]
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-6
    assert np.allclose([r["explained"] for *_, r in rows[: len(explained)]], explained, rtol=1e-9)


def test_query_against_numpy(spark, sf_dir):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet'").fetchall()
    found = registry.QUERIES["op12_embedding_whitening"](spark, sf_dir)
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    agree(found.collect(), [i for i, _ in rows], [v for _, v in rows])


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", "n", "c", "d") for i, v in rows], DDL).repartition(3)


def test_rows_that_count(spark):
    rng = np.random.default_rng(5)
    sound = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(40)]
    sound += [(100 + i, sound[0][1]) for i in range(30)] + [(7, sound[7][1])]  # copies count once, and are whitened each
    others = [(200, None), (201, [1.0, None, 0, 0, 0]), (202, [NAN, 0, 0, 0, 0]), (203, [0, INF, 0, 0, 0]), (204, [0, 0, -INF, 0, 0]), (205, []), (206, [1.0, 2.0]), (None, [0.5, 1, 2, 3, 4.25])]
    got = whitening.whiten(frame(spark, sound + others)).collect()
    kept = sound + others[-1:]
    agree(got, [i for i, _ in kept], [v for _, v in kept])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])] * 5, [(1, [])]])
def test_no_component(spark, rows):
    found = whitening.whiten(frame(spark, rows))
    assert found.collect() == [] and "identity_error" in found.columns


def test_low_rank(spark):
    """Three vectors have two components; a constant dimension has no share."""
    rows = [(1, [1.0, 5.0, 0.0, 9.0]), (2, [2.0, 5.0, 1.0, 9.0]), (3, [4.0, 5.0, -7.0, 9.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2}
    agree(got, [1, 2, 3], [v for _, v in rows])
    assert abs(sum(r["explained"] for r in got) / 3 - 1) < 1e-12


def test_large_numbers_are_exact(spark):
    x = np.array([[10**15, 3], [5, -(10**15)], [7, 7]], dtype=np.int64)
    sums = tuple(int(s) for s in x.sum(axis=0))
    assert whitening.deviations(x, 3, sums) == [sum((3 * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x[:0], 3, sums) == []
    got = whitening.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and all(math.isfinite(r["whitened"]) for r in got)
