"""Whitening against numpy's eigendecomposition; the updates against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from markhive.llm import queries, whitening
from markhive.llm.whitening import Spectrum, rank_one

SF01 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def _dense(values, vectors):
    return vectors @ np.diag(values) @ vectors.T


@pytest.mark.parametrize("dim", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["full", "equal", "pairs", "zero", "tiny gaps"])
def test_rank_one_update(dim, kind):
    rng = np.random.default_rng(dim)
    for sparse in (False, True):
        matrix = {
            "full": lambda: (lambda a: a @ a.T)(rng.normal(size=(dim, dim)) * 10 ** rng.uniform(-3, 3, size=dim)),
            "equal": lambda: 3 * np.eye(dim),
            "pairs": lambda: np.diag(np.repeat([1.0, 5.0], [dim - dim // 2, dim // 2])),
            "zero": lambda: np.zeros((dim, dim)),
            "tiny gaps": lambda: np.diag(1 + 1e-14 * np.arange(dim)),
        }[kind]()
        v = rng.normal(size=dim) * 10 ** rng.uniform(-8, 4)
        if sparse:
            v[rng.random(dim) < 0.5] = 0
        values, vectors = rank_one(*np.linalg.eigh(matrix), v)
        wanted = matrix + np.outer(v, v)
        size = max(np.abs(wanted).max(), 1e-300)
        assert np.abs(_dense(values, vectors) - wanted).max() < 1e-12 * size
        assert np.abs(vectors.T @ vectors - np.eye(dim)).max() < 1e-12
        assert (np.diff(values) >= 0).all()


def test_blocks_and_single_vectors_give_one_spectrum():
    rows = np.floor(8 * np.random.default_rng(5).normal(size=(300, 12))).astype(np.int8)
    centred = rows - rows.mean(axis=0)
    for block in (1, 7, 64, 1000):
        parts = [Spectrum.empty(12) for _ in range(3)]
        for own, some in zip(parts, (rows[:1], rows[1:140], rows[140:]), strict=True):
            for start in range(0, len(some), block):
                own.absorb(some[start : start + block])
        whole = parts[0]
        for other in parts[1:]:
            whole.add(other)
        assert whole.n == 300 and whole.sums == rows.sum(axis=0, dtype=int).tolist()
        assert np.allclose(whole.mean, rows.mean(axis=0))
        assert np.allclose(_dense(whole.values, whole.vectors), centred.T @ centred, rtol=1e-12, atol=1e-9)


def brute(vectors, components=16):
    """(x - mean) on the components over their deviation, shares, deviations and the number of distinct vectors."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    moved = distinct - 1_000_000
    mean = moved.sum(axis=0) / n
    covariance = (moved - mean).T @ (moved - mean) / n
    e, u = np.linalg.eigh(covariance)
    keep = np.argsort(-e)[:components]
    keep = keep[e[keep] > 1e-10 * np.trace(covariance)]
    return (x - 1_000_000 - mean) @ u[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(covariance), ((n * x - sums) ** 2).sum(axis=1), n


def compare(df, ids, vectors, tolerance=1e-7):
    got = df.toPandas().sort_values(["vec_id", "component"])
    order = np.argsort(ids)
    wanted, shares, deviations, n = brute([vectors[k] for k in order])
    k = len(shares)
    assert len(got) == len(ids) * k
    w = got.whitened.to_numpy().reshape(-1, k)
    w = w * np.sign((w * wanted).sum(axis=0))
    assert np.abs(w - wanted).max() < tolerance
    assert np.allclose(got.explained.to_numpy().reshape(-1, k), shares, rtol=1e-9)
    assert (got.deviation.to_numpy().reshape(-1, k) == deviations[:, None]).all()
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    assert got.component.tolist() == list(range(1, k + 1)) * len(ids)


def test_query_is_the_eigendecomposition(spark):
    rows = spark.read.parquet(f"{SF01}/embeddings.parquet").collect()
    compare(queries.op11_embedding_whitening(spark, SF01), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_copies_count_once_and_many_tasks_combine(spark):
    rng = np.random.default_rng(2)
    vectors = [v.tolist() for v in rng.normal(size=(200, 6)) * [4, 3, 2, 1, 0.5, 0.25]]
    rows = [(i, vectors[0 if i % 3 == 0 else i % 200], 1) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(70)
    compare(whitening.by_component(df), [r[0] for r in rows], [r[1] for r in rows])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), float(i * i % 7), float(i % 3) / 8], i) for i in range(40)]
    odd = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [1.0, nan, 2.0], 1), (103, [inf, 0.0, 0.0], 1), (104, [-inf, 0.0, 0.0], None)]
    short = [(200, [1.0], None), (201, [], 3)]
    df = spark.createDataFrame(good + odd + short, SCHEMA).withColumn("vector", F.lit("x")).withColumn("N", F.lit(1))
    padded = [(i, [*v, *[0.0] * (3 - len(v))]) for i, v, _ in good + short]
    compare(whitening.by_component(df), [i for i, _ in padded], [v for _, v in padded])


def test_without_variance(spark):
    for rows in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1)], [(i, [0.5, 0.5], 1) for i in range(9)], [(1, [], 1), (2, [], 1)]):
        out = whitening.by_component(spark.createDataFrame(rows, SCHEMA))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_null_ids_and_large_entries(spark):
    rows = [(None, [1e30, 0.0], 1), (2, [0.0, 1.0], 1), (3, [5.0, -1.0], 1), (3, [5.0, -1.0], 1)]
    got = whitening.by_component(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id for r in got} == {None, 2, 3} and len(got) == 4 * max(r.component for r in got)
    assert {r.deviation for r in got if r.vec_id is None} == {None}  # beyond a long


def test_deviations_are_exact_in_large_tables():
    x = np.array([[3, -2], [0, 1]], np.int8)
    n, sums = 10**9, [10**9 + 7, -5]
    assert whitening.deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, 10**12, sums)[0] is None


def test_whitened_column(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 11)], i) for i in range(30)], SCHEMA)
    model = whitening.fit(df, components=2)
    more = spark.createDataFrame([(1, [2.0, 900.0], 1), (2, None, 2), (3, [1.0], 3), (4, [1.0, 2.0, 3.0], 4)], SCHEMA).withColumn("__vector", F.lit(7))
    out = whitening.whitened(more, model)
    assert out.columns == [*more.columns, "whitened"]
    got = {r.vec_id: r for r in out.collect()}
    assert set(got) == {1, 3} and got[1]["__vector"] == 7
    x = np.floor(64 * np.array([2.0, 900.0]))
    assert np.allclose(got[1].whitened, (x - model.mean) @ model.turn)
    with pytest.raises(ValueError):
        whitening.whitened(df.withColumn("Whitened", F.lit(1)), model)
