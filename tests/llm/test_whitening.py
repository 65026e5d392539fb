"""Whitening against exact fractions and plain sums."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rangeloom.llm import registry, whitening

SHAPE = "vec_id long, embedding array<float>, EMBEDDING_ string"


def table(spark, rows: list, parts: int = 3):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], SHAPE).repartition(parts)


def sample(n: int = 200, dims: int = 12) -> list:
    rng = np.random.default_rng(3)
    base = rng.normal(size=(n, dims)) * np.linspace(3, 0.2, dims) + rng.normal(size=dims)
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]


def brute_force(vectors: list[list[float]]) -> tuple[list[list[int]], np.ndarray]:
    x = [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    mean = [Fraction(sum(v[d] for v in x), n) for d in range(dims)]
    return x, np.array([[float(sum((v[a] - mean[a]) * (v[b] - mean[b]) for v in x) / n) for b in range(dims)] for a in range(dims)])


def checked(got: list, rows: list) -> None:
    x, covariance = brute_force([v for _, v in rows])
    n, values = len(x), np.linalg.eigvalsh(covariance)[::-1]
    sums = [sum(v[d] for v in x) for d in range(len(x[0]))]
    want = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for (i, _), v in zip(rows, x)}
    whitened: dict[int, dict] = {}
    for r in got:
        assert r["n"] == n and r["deviation"] == want[r["vec_id"]] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(covariance), rel=1e-9)
        whitened.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    assert len(whitened) == n
    w = np.array([[whitened[i][k + 1] for k in range(len(whitened[i]))] for i, _ in rows])
    k = w.shape[1]
    assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-8)
    z = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in x])
    axes = np.linalg.lstsq(z, w * np.sqrt(values[:k]), rcond=None)[0]
    assert np.allclose(covariance @ axes, axes * values[:k], rtol=1e-7, atol=1e-7 * values[0]) and np.allclose((axes**2).sum(0), 1)


def test_equals_fractions(spark):
    rows = sample()
    broken = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [1.0, 2.0]), (905, [])]
    got = whitening.components(whitening.Whitening(table(spark, rows + broken))).collect()
    assert len(got) == 200 * 8
    checked(got, rows)


def test_result_does_not_depend_on_the_tasks(spark):
    one, many = (whitening.Whitening(table(spark, sample(), parts)) for parts in (1, 7))
    assert one.sums == many.sums and np.array_equal(one.values, many.values) and np.array_equal(one.axes, many.axes)


def test_registered_query_over_all_vectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    checked(registry.op11_embedding_whitening(spark, sf).collect(), [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)])


def test_products_of_slices_are_exact():
    rng = np.random.default_rng(1)
    for bits in (5, 19, 20, 33, 61):
        y = rng.integers(-(1 << bits), 1 << bits, (50, 4))
        want = y.astype(object).T @ y.astype(object)
        assert (whitening.products(y) == want).all()
        back = np.zeros((4, 4), object)
        for i, j, digit, value in zip(*(c.to_pylist() for c in whitening.digits(want).columns)):
            back[i, j] += value << whitening.DIGIT * digit
        assert (np.triu(want) == back).all()
    huge = np.array([[3 << 80, -(5 << 90)], [1, -1]], object)
    assert (whitening.products(huge) == huge.T @ huge).all()
    many = np.full((20_000, 2), -(1 << 19), np.int64)
    assert whitening.products(many)[0, 1] == 20_000 << 38


def test_few_equal_large_and_no_vectors(spark):
    run = lambda rows: whitening.components(whitening.Whitening(table(spark, rows))).collect()
    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(i, [1.0, 2.0]) for i in range(5)]) == []
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)]
    assert {r["component"] for r in run(line)} == {1}
    again = [(None, [1.0, 0.5]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (8, [-2.0, 1.0]), (9, [0.25, -3.0])]
    got = run(again)
    assert len(got) == 10 and sorted({r["vec_id"] or 0 for r in got}) == [0, 7, 8, 9]
    large = run([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 4.0])])
    assert {r["vec_id"] for r in large} == {1, 2, 3} and all(r["deviation"] is None for r in large if r["vec_id"] != 3)
