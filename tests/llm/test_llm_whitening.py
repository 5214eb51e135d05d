"""Whitening against numpy on the whole covariance."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def twin(rows, k=4):
    """{(place, component): (n, deviation, whitened, explained)} of the usable rows, by numpy."""
    x = np.array([[int(np.floor(256.0 * np.float32(c))) for c in v] for v in rows])
    fits = np.unique(x, axis=0)
    n, s = len(fits), fits.sum(axis=0)
    c = fits - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes / np.sqrt(values), values / np.trace(c.T @ c / n)


def planted(seed=1, n=400, d=40):
    rng = np.random.default_rng(seed)
    scales = np.concatenate([[3, 2.5, 2, 1.5], np.linspace(1.2, 0.3, d - 4)])
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    return (rng.standard_normal((n, d)) * scales) @ turn + 5


@pytest.mark.parametrize("d", [3, 40])
def test_equals_numpy(spark, d):
    vectors = planted(d=max(d, 8))[:, :d].astype(np.float32).tolist()
    vectors += vectors[:50] * 3 + [vectors[7]] * 200
    broken = [None, [None] * d, [float("nan")] * d, [1.0] * (d - 1) + [float("inf")], [1.0] * (d + 1), [], [1.0] * (d - 1) + [None]]
    rows = [(k, v, 0, "x", "y") for k, v in enumerate(vectors)] + [(9000 + k, v, 0, "x", "y") for k, v in enumerate(broken)]
    rows += [(None, vectors[3], None, None, None)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).toPandas()
    n, deviation, whitened, explained = twin(vectors)
    k = min(4, d)
    assert len(got) == k * (len(vectors) + 1) and set(got["n"]) == {n}
    assert set(got["vec_id"].dropna()) == set(range(len(vectors)))
    own = got[got["vec_id"].notna()].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((own * whitened).sum(axis=0))
    assert np.abs(own * signs - whitened).max() < 1e-9
    first = got[got["component"] == 1].set_index("vec_id")["deviation"]
    assert [first[float(i)] for i in range(len(vectors))] == deviation.tolist()
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9, atol=0)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10


class Local:
    """A covariance held as a matrix."""

    def __init__(self, matrix):
        self.matrix, self.length, self.passes = matrix, len(matrix), 0

    def times(self, q):
        self.passes += 1
        return self.matrix @ q


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 0.9, 300), np.geomspace(1e6, 1e-6, 300), np.r_[np.ones(6), np.full(294, 0.5)], np.r_[5, 4, 3, 2, np.zeros(296)],
    np.r_[np.full(150, 1.0), np.full(150, 1 - 1e-7)], np.zeros(300), np.r_[1.0, np.zeros(299)]])
def test_iteration_is_certified(spectrum):
    turn = np.linalg.qr(np.random.default_rng(2).standard_normal((300, 300)))[0]
    v = Local((turn * spectrum) @ turn.T)
    values, axes = whitening.principal(v, 4, 12)
    assert np.allclose(values, spectrum[:4], rtol=1e-10, atol=1e-12 * spectrum[0])
    assert np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12
    assert np.abs(v.matrix @ axes - axes * values).max() <= 1e-9 * max(spectrum[0], 1e-300)
    if spectrum[0] > spectrum[1] and spectrum[3] > 0:
        assert np.abs(np.abs((turn[:, :4] * axes).sum(axis=0)) - 1).max() < 1e-9


def test_filter_is_the_chebyshev_polynomial():
    values = np.array([3.0, 2.0, 0.9, 0.5, 0.0])
    v, edge, degree = Local(np.diag(values)), 1.0, 7
    q = np.eye(5)
    found = whitening._filtered(v, q, v.times(q), 3.0, edge, degree)
    coefficients = [0] * degree + [1]
    plain = np.polynomial.chebyshev.chebval(2 * values / edge - 1, coefficients)
    assert np.allclose(np.diag(found), plain / plain[0], rtol=1e-10) and v.passes == degree


def test_defined_cases(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    only_broken = spark.createDataFrame([(1, None, 0, "", ""), (2, [], 0, "", "")], SCHEMA)
    assert whitening.whiten(only_broken).collect() == []
    same = whitening.whiten(spark.createDataFrame([(k, [0.5, 0.25], 0, "", "") for k in range(9)], SCHEMA)).collect()
    assert len(same) == 18 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, 0.0, 0.0)}
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0, 2.0], 0, "", ""), (2, [1.0, 1.0, 2.0], 0, "", "")], SCHEMA)).collect()
    assert {(r.component, r.whitened is None) for r in two} == {(1, False), (2, True), (3, True)}
    assert sorted(abs(round(r.whitened, 12)) for r in two if r.component == 1) == [1.0, 1.0]


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(c) for c in v]) for k, v in enumerate([[2**40, 1, -3], [-(2**40), 2, 5], [7, 2**33, 9], [1e300, 0, 0]])]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()}
    assert len(got) == 4 and all(r.deviation is None for r in got.values())
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame([(k, [c * 2.0**12]) for k, c in enumerate((1.0, 900.0, 4.0))], "vec_id long, embedding array<double>")).collect()}
    x = [int(256 * c * 2**12) for c in (1, 900, 4)]
    assert [got[k].deviation for k in range(3)] == [(3 * a - sum(x)) ** 2 for a in x]


def test_packing_round_trip():
    x = np.array([[1, -2], [40_000, 3], [2**40, -1], [0, 0]])
    packed = whitening._packed(x)
    assert [len(b) for b in packed.to_pylist()] == [4, 8, 16, 4]
    assert (whitening._unpacked(packed, 2) == x).all()
