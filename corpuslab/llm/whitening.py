"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers x = floor(256 * c); the fit list holds each distinct x vector once.
A pass over the fit list multiplies the covariance with a block Q of a few columns: every task
centres its vectors, sums (x - S/n)' ((x - S/n) Q), and Spark adds these small matrices up. The
covariance itself is never formed, and neither vectors nor their number reach the driver.

One round filters the block with a Chebyshev polynomial of such products: its three-term
recurrence keeps what lies below the block's smallest Ritz value within 1 and lets what lies
above grow. A QR factorisation and a Rayleigh-Ritz step then give eigenvalues and vectors, whose
residuals the next product measures. The round is repeated until each wanted vector is certified:
its residual, divided by the distance to the next eigenvalue, is at the level of rounding. Where
eigenvalues lie so close that this would take long, random columns widen the block; at the full
number of dimensions one product is exact, so the iteration always ends.

Defined cases: rows with a null vector or a null or non-finite entry are dropped, and so are
vectors of another length than the most frequent one (ties: the longest); entries too large for a
long are clipped to it; a null key, ties and repeated rows are kept, each row gives its own result
rows; a component without variance (fewer distinct vectors than components, constant entries) has
null whitened and explained 0, and does not count for identity_error; an empty table gives no
row; extra columns are ignored. A deviation that no long holds is null.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.words import text_batches
from corpuslab.storage import materialize

#: A pass reads all vectors, so a wide block that needs fewer passes is cheaper than a narrow one.
SCALE, COMPONENTS, GUARDS, SEED = 256, 4, 28, 11

#: Products per round at most; one round's growth of the unwanted part stays within double precision.
DEGREE, GROWTH = 24, 1e10

#: A vector is certified when its error is below this, or its residual at the level of rounding.
ERROR, ROUNDING = 1e-11, 64 * np.finfo(float).eps

#: Expected products from which the block is widened instead.
PATIENCE = 64

#: A component with less than this share of the largest variance counts as having none.
NO_VARIANCE = 1e-10

LONG = np.iinfo(np.int64)


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite entry."""
    # NaN is larger than infinity.
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _whole(vectors: pa.Array, length: int) -> np.ndarray:
    """x of a batch of usable vectors, one row each."""
    entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    floors = np.floor(SCALE * entries.reshape(-1, length))
    big = floors >= 2.0**63
    out = np.where(big, 0.0, np.maximum(floors, float(LONG.min))).astype(np.int64)
    out[big] = LONG.max
    return out


def _packed(x: np.ndarray) -> pa.Array:
    """Rows as bytes, in the fewest bytes per entry that a row needs, so that equal rows have equal bytes."""
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    out = np.empty(len(x), object)
    todo = np.ones(len(x), bool)
    for kind in (np.int16, np.int32, np.int64):
        fits = todo & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        out[fits] = [row.tobytes() for row in x[fits].astype(np.dtype(kind).newbyteorder("<"))]
        todo &= ~fits
    return pa.array(out, pa.binary())


def _unpacked(rows: pa.Array, length: int) -> np.ndarray:
    raw = rows.to_pylist()
    out = np.empty((len(raw), length), np.int64)
    sizes = np.array([len(r) for r in raw])
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        joined = b"".join([raw[k] for k in at])
        out[at] = np.frombuffer(joined, f"<i{width // length}").reshape(-1, length)
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """(n * x - S) / n, with an exact numerator."""
    return _numerators(x, n, sums).astype(np.float64) / n


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    bound = max((max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n, *map(abs, sums)))
    if 2 * bound <= LONG.max:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def fit_list(vectors: DataFrame, vector: str, length: int) -> DataFrame:
    """Each distinct x vector once, as packed bytes in the column `x`; a written table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_packed(_whole(batch.column(0), length))], ["x"])

    # Spark drops a task's repeats before the shuffle, so a vector of many rows moves once per task.
    return materialize(vectors.select(vector).mapInArrow(pack, "x binary").distinct(), "fit-list")


def _length(vectors: DataFrame, vector: str) -> int:
    """The most frequent length, the longest of ties; 0 without vectors."""
    lengths = vectors.groupBy(F.size(vector).alias("size")).count().where("size > 0")
    first = lengths.orderBy(F.col("count").desc(), F.col("size").desc()).first()
    return first["size"] if first else 0


class Covariance:
    """The covariance of the fit list as something to multiply with."""

    def __init__(self, fits: DataFrame, length: int):
        self.fits, self.length, self.passes = fits, length, 0
        totals = fits.mapInArrow(self._sums(), "k int, v decimal(38, 0)").groupBy("k").agg(F.sum("v").alias("v")).collect()
        found = {r["k"]: int(r["v"]) for r in totals}
        self.n = found.get(-1, 0)
        self.sums = [found.get(k, 0) for k in range(length)]

    def _sums(self):
        length = self.length

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = 0, [0] * length
            for batch in batches:
                x = _unpacked(batch.column(0), length)
                # Halves of 32 bits, so that no batch can overflow.
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                n += len(x)
                sums = [s + (int(h) << 32) + int(b) for s, h, b in zip(sums, high, low)]
            yield _sparse([-1, *range(length)], [n, *sums], pa.decimal128(38, 0))

        return add

    def _added(self, contribution) -> np.ndarray:
        """Sum over all tasks of what `contribution` makes of a batch of centred vectors."""
        n, sums, length = self.n, self.sums, self.length
        self.passes += 1

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                part = contribution(_centred(_unpacked(batch.column(0), length), n, sums))
                total = part if total is None else total + part
            if total is not None:
                yield _sparse(range(total.size), total.ravel(), pa.float64())

        rows = self.fits.mapInArrow(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.empty(len(rows))
        for r in rows:
            out[r["k"]] = r["v"]
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """The product with a block of columns: one pass over the fit list."""
        return self._added(lambda c: c.T @ (c @ q)).reshape(q.shape) / self.n

    def trace(self) -> float:
        return float(self._added(lambda c: np.array([(c * c).sum()]))[0]) / self.n

    def of_scores(self, projection: np.ndarray) -> np.ndarray:
        """Covariance of the centred vectors times `projection`."""
        k = projection.shape[1]

        def moments(c: np.ndarray) -> np.ndarray:
            w = c @ projection
            return np.vstack([w.T @ w, w.sum(axis=0)])

        found = self._added(moments).reshape(k + 1, k) / self.n
        return found[:k] - np.outer(found[k], found[k])


def _sparse(keys, values, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(values, kind)], ["k", "v"])


def _filtered(v: Covariance, q: np.ndarray, vq: np.ndarray, top: float, edge: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the covariance that is within 1 on 0..edge and 1 at `top`, times q.

    `vq` is the product with q that the Rayleigh-Ritz step knows already. The scaling by the
    value at `top` runs along with the recurrence, so that nothing overflows."""
    centre = half = edge / 2
    scale = first = half / (top - centre)
    before, now = q, (vq - centre * q) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, 2 * (v.times(now) - centre * now) * (following / half) - scale * following * before
        scale = following
    return now


def _rate(value: float, edge: float) -> float:
    """Growth per degree of what lies at `value`, against what lies on 0..edge."""
    x = 2 * value / edge - 1
    return x + np.sqrt(max(x * x - 1, 0.0))


def principal(v: Covariance, components: int = COMPONENTS, guards: int = GUARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns), certified."""
    d, draw = v.length, np.random.default_rng(seed)
    wanted, width = min(components, d), min(components + guards, d)
    q = np.linalg.qr(draw.standard_normal((d, width)))[0] if width < d else np.eye(d)
    while True:
        vq = v.times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = np.maximum(values[::-1], 0.0), turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = values[0]
        if width == d or top == 0.0:
            return values[:wanted], q[:, :wanted]
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        apart = -np.diff(values)
        gap = np.minimum(apart[:wanted], np.concatenate([[np.inf], apart[: wanted - 1]]))
        if np.all((residual <= ERROR * gap) | (residual <= ROUNDING * top)):
            return values[:wanted], q[:, :wanted]
        edge = values[-1]
        rate = _rate(values[wanted - 1], edge) if edge > 0.0 else np.inf
        missing = float(np.max(residual / np.maximum(gap * ERROR, ROUNDING * top)))
        if rate <= 1.0 or np.log(missing) / np.log(rate) > PATIENCE:
            # Too close together for this block: more columns move the edge away from the wanted part.
            more = draw.standard_normal((d, min(width, d - width)))
            width += more.shape[1]
            q = np.linalg.qr(np.hstack([q, more]))[0] if width < d else np.eye(d)
            continue
        if edge <= ROUNDING * top:
            # Nothing to damp: the covariance has no more rank than the block.
            q = np.linalg.qr(vq + edge * q)[0]
            continue
        spread = _rate(top, edge)
        degree = int(np.clip(min(np.log(missing) / np.log(rate), np.log(GROWTH) / np.log(spread)) + 1, 2, DEGREE))
        q = np.linalg.qr(_filtered(v, q, vq, top, edge, degree))[0]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    text_batches(spark)
    typed = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    typed = typed.where(usable(F.col("vector")))
    schema = f"`{key}` {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = _length(typed, "vector")
    if not length:
        return spark.createDataFrame([], schema)
    typed = typed.where(F.size("vector") == length)
    v = Covariance(fit_list(typed, "vector", length), length)
    values, axes = principal(v, components)
    k, trace = len(values), v.trace()
    varies = values > NO_VARIANCE * max(values[0], 0.0)
    scaled = np.where(varies, axes / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    error = 0.0
    if varies.any():
        own = v.of_scores(scaled[:, varies])
        error = float(np.abs(own - np.eye(len(own))).max())
    explained = values / trace if trace > 0.0 else np.zeros(k)
    n, sums = v.n, v.sums

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            upper = _numerators(_whole(batch.column(1), length), n, sums)
            largest = max(abs(int(upper.max())), abs(int(upper.min())))
            exact = upper if largest**2 * length <= LONG.max else upper.astype(object)
            deviation = (exact * exact).sum(axis=1)
            whitened = (upper.astype(np.float64) / n) @ scaled
            rows = np.repeat(np.arange(batch.num_rows), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(len(rows), n, np.int64)),
                pa.array([int(x) if x <= LONG.max else None for x in deviation], pa.int64()).take(pa.array(rows)),
                pa.array(whitened.ravel(), mask=np.tile(~varies, batch.num_rows)),
                pa.array(np.tile(np.where(varies, explained, 0.0), batch.num_rows)),
                pa.array(np.full(len(rows), error)),
            ], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return typed.mapInArrow(project, schema)
