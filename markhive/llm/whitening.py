"""Whitening of embeddings by incremental eigendecomposition.

Every task keeps the eigenvalues and eigenvectors of the centred scatter of the
vectors it has read.  A vector enters by a rank-one update: the new eigenvalues
are the roots of the secular equation, found between the old ones, after
components that the update does not touch, and equal eigenvalues, have been
deflated; the new eigenvectors follow from the roots.  BLOCK vectors enter
together as the rows of their triangular factor, which has the same scatter, so
that a block takes as many updates as there are dimensions (``block=1`` updates
with each vector).  Another rank-one update moves the mean.

Spectra of tasks are combined by successive rank-one updates, FAN_IN at a time,
in tasks again.  Rounding of all these updates is removed by a last distributed
Rayleigh-Ritz step: all vectors are centred and projected on the basis, the
covariance of the projections is summed over the tasks, and its eigenvectors
turn the basis.  One more pass measures the whitened covariance.

Cases: rows whose vector is null or holds null or non-finite entries are left
out; shorter vectors count as padded with zeros (see ``vectors``).  Equal vectors
count once in the fit and each have a result.  A direction without variance has
no component, so that one distinct vector, or none, gives no rows.  A deviation
that does not fit a long is null.  A null id stays null; other columns of the
table are not read by the query and stay as they are in ``whitened``.

The fit list is shuffled once in its binary form (a byte or two an entry); of
the rest, one spectrum a task (dim * dim numbers) moves, and one reaches the
driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markhive.llm.common import per_task, stored, with_field
from markhive.llm.vectors import Form, form_of, free_name, numbers, packed

#: Entries are scaled by this, floored, and moved by OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components of the query.
COMPONENTS = 16
#: Vectors that enter a spectrum together, and spectra that one task combines.
BLOCK, FAN_IN = 1024, 16
EPS = float(np.finfo(float).eps)


# ------------------------------------------------------------------ rank-one updates


def _roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(z^2 / (d - x)), one above each of the ascending ``d``.

    Each as the place of the nearest of ``d`` and the distance from it, which
    keeps differences to ``d`` accurate.  Steps solve the equation that has the
    two poles around the root and the value and slopes of the sums to its left
    and right; a step that leaves the bracket becomes a bisection.
    """
    k, squares = len(d), z * z
    own = np.arange(k)
    if k == 1:
        return own, squares
    gap = np.append(np.diff(d), squares.sum())
    above = 1 + (squares / (d - d[:, None] - gap[:, None] / 2)).sum(axis=1) < 0  # the root is in the upper half
    origin = own + (above & (own < k - 1))
    delta = d - d[origin][:, None]
    start = delta[own, own]
    low, high = np.where(above, start + gap / 2, start), np.where(above, start + gap, start + gap / 2)
    low[origin > own] = -gap[origin > own] / 2
    high[origin > own] = 0.0
    left = own <= own[:, None]
    after = np.minimum(own + 1, k - 1)
    mu = (low + high) / 2
    for _ in range(120):
        far = delta - mu[:, None]
        part = squares / far
        w = 1 + part.sum(axis=1)
        if (done := (np.abs(w) <= 4 * EPS * (1 + np.abs(part).sum(axis=1))) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))).all():
            break
        slopes = part / far
        slope_left = (slopes * left).sum(axis=1)
        slope_right = slopes.sum(axis=1) - slope_left
        low, high = np.where(w < 0, mu, low), np.where(w < 0, high, mu)
        d1, d2 = far[own, own], far[own, after]
        c = w - d1 * slope_left - d2 * slope_right
        a = (d1 + d2) * w - d1 * d2 * (slope_left + slope_right)
        b = d1 * d2 * w
        with np.errstate(all="ignore"):
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            c_last = w[-1] - d1[-1] * slope_left[-1]
            step[-1] = d1[-1] * (1 + d1[-1] * slope_left[-1] / c_last)
            tried = mu + step
        inside = (tried > low) & (tried < high)
        mu = np.where(done, mu, np.where(inside, tried, (low + high) / 2))
    return origin, mu


def _merged_equal(d: np.ndarray, z: np.ndarray, vectors: np.ndarray, active: np.ndarray, tol: float) -> np.ndarray:
    """Deflates close eigenvalues: a rotation of two of them leaves one untouched by the update."""
    kept, p = [], active[0]
    for q in active[1:]:
        r = float(np.hypot(z[p], z[q]))
        c, s = z[q] / r, -z[p] / r
        if abs((d[q] - d[p]) * c * s) <= tol:
            z[q], z[p] = r, 0.0
            vectors[:, [p, q]] = np.stack([c * vectors[:, p] + s * vectors[:, q], c * vectors[:, q] - s * vectors[:, p]], axis=1)
            d[p], d[q] = d[p] * c * c + d[q] * s * s, d[p] * s * s + d[q] * c * c
        else:
            kept.append(p)
        p = q
    return np.array([*kept, p])


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``vectors diag(values) vectors^T + v v^T``."""
    z = vectors.T @ v
    size = float(z @ z)
    tol = 8 * EPS * max(float(np.abs(values).max(initial=0.0)), size)
    active = np.flatnonzero(np.abs(z) * np.sqrt(size) > tol)
    if not len(active):
        return values, vectors
    d, vectors = values.copy(), vectors.copy()
    p, q = active[:-1], active[1:]
    if (np.diff(d[active]) * np.abs(z[p] * z[q]) <= tol * (z[p] ** 2 + z[q] ** 2)).any():
        active = _merged_equal(d, z, vectors, active, tol)
        active = active[np.argsort(d[active], kind="stable")]
    poles, z = d[active], z[active]
    origin, mu = _roots(poles, z)
    away = poles - poles[origin][:, None] - mu[:, None]  # pole j minus root i
    # weights for which the roots are exact: eigenvectors come out orthogonal
    between = poles - poles[:, None]  # pole j minus pole i
    np.fill_diagonal(between, 1.0)
    ratio = away / between
    np.fill_diagonal(ratio, -np.diag(away))
    weights = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=0))), z)
    turn = weights / away
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    vectors[:, active] = vectors[:, active] @ turn.T
    d[active] = poles[origin] + mu
    order = np.argsort(d, kind="stable")
    return d[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number, exact sums, mean and centred scatter (as eigenvalues and eigenvectors) of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, [0] * dim, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def _update(self, v: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, v)

    def _move(self, n: int, mean: np.ndarray) -> None:
        """The part of the scatter that lies between two means, and the common mean."""
        gap, both = mean - self.mean, self.n + n
        if self.n:
            self._update(np.sqrt(self.n / both * n) * gap)
        self.mean = self.mean + gap * (n / both)
        self.n = both

    def absorb(self, rows: np.ndarray) -> None:
        """Takes in the rows of integers."""
        n = len(rows)
        if not n:
            return
        self.sums = [a + b for a, b in zip(self.sums, exact_sums(rows), strict=True)]
        rows = rows.astype(float)
        mean = rows.mean(axis=0)
        if n > 1:
            rows -= mean
            for v in np.linalg.qr(rows, mode="r") if n > rows.shape[1] else rows:
                self._update(v)
        self._move(n, mean)

    def add(self, other: Spectrum) -> None:
        """Takes in another spectrum, one eigenvector after the other."""
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        for value, v in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self._update(np.sqrt(value) * v)
        self._move(other.n, other.mean)


def exact_sums(rows: np.ndarray) -> list[int]:
    """Sums of integer columns, whatever their size."""
    if len(rows) * max(abs(int(rows.min(initial=0))), abs(int(rows.max(initial=0)))) < 1 << 63:
        return rows.sum(axis=0, dtype=np.int64).tolist()
    return [sum(column) for column in rows.T.tolist()]


# ------------------------------------------------------------------ tasks

SPECTRUM = "n long, sums array<string>, mean array<double>, axes binary"


def _row(s: Spectrum) -> pa.RecordBatch:
    told = {"n": [s.n], "sums": [list(map(str, s.sums))], "mean": [s.mean.tolist()], "axes": [s.values.tobytes() + s.vectors.tobytes()]}
    return pa.RecordBatch.from_pydict(told, schema=pa.schema({"n": pa.int64(), "sums": pa.list_(pa.string()), "mean": pa.list_(pa.float64()), "axes": pa.binary()}))


def _spectrum_of(row: dict) -> Spectrum:
    dim = len(row["sums"])
    axes = np.frombuffer(row["axes"])
    return Spectrum(row["n"], list(map(int, row["sums"])), np.array(row["mean"], float), axes[:dim], axes[dim:].reshape(dim, dim))


def _spectra(batches: Iterable[pa.RecordBatch], form: Form, block: int) -> Iterator[pa.RecordBatch]:
    own, held, waiting = Spectrum.empty(form.dim), [], 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            rows = numbers(batch.column(0).slice(start, block - waiting), form)
            held.append(rows)
            start, waiting = start + len(rows), waiting + len(rows)
            if waiting == block:
                own.absorb(np.concatenate(held))
                held, waiting = [], 0
    if held:
        own.absorb(np.concatenate(held))
    if own.n:
        yield _row(own)


def _combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = None
    for batch in batches:
        for row in batch.to_pylist():
            other = _spectrum_of(row)
            if own is None:
                own = other
            else:
                own.add(other)
    if own is not None:
        yield _row(own)


def folded(df: DataFrame, make: Callable, *args) -> DataFrame:
    """``make`` over FAN_IN tasks' rows at a time, until one task is left."""
    parts = df.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        df = per_task(df.repartition(parts), make, df.schema, *args)
    return df


def _projected(batches: Iterable[pa.RecordBatch], form: Form, mean: np.ndarray, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Number, mean and centred scatter of the centred vectors' projections on the basis."""
    told = None
    for batch in batches:
        y = (numbers(batch.column(0), form) - mean) @ basis
        if len(y):
            middle = y.mean(axis=0)
            y -= middle
            told = _both(told, (len(y), middle, y.T @ y))
    if told is not None:
        yield _scatter_row(told)


def _both(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    gap, n = b[1] - a[1], a[0] + b[0]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] / n * b[0])


def _scatter_row(told: tuple) -> pa.RecordBatch:
    n, mean, scatter = told
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([scatter.tobytes()], pa.binary())], names=["n", "mean", "scatter"])


def _scatters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    told = None
    for batch in batches:
        for row in batch.to_pylist():
            mean = np.frombuffer(row["mean"])
            told = _both(told, (row["n"], mean, np.frombuffer(row["scatter"]).reshape(len(mean), len(mean))))
    if told is not None:
        yield _scatter_row(told)


def covariance(fit_list: DataFrame, form: Form, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of the vectors' projections on the columns of ``basis``, summed in tasks."""
    parts = per_task(fit_list, _projected, "n long, mean binary, scatter binary", form, mean, basis)
    row = folded(parts, _scatters).first()
    size = basis.shape[1]
    return np.frombuffer(row["scatter"]).reshape(size, size) / row["n"]


# ------------------------------------------------------------------ the fit


@dataclass
class Whitening:
    """What whitens a vector: the fit list's size, sums and mean, and components by falling eigenvalue.

    Sums and mean are of the scaled floors without OFFSET.
    """

    form: Form
    n: int = 0
    sums: list[int] = field(default_factory=list)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # a column each
    trace: float = 0.0
    identity_error: float = 0.0

    @property
    def turn(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, block: int = BLOCK) -> Whitening:
    """The whitening of the distinct vectors of ``df``."""
    form = form_of(df, vector, scale)
    fit_list = stored(packed(df.select(F.col(f"`{vector}`").alias("vector")), "vector", scale, form).distinct(), "fit-list")
    found = folded(per_task(fit_list, _spectra, SPECTRUM, form, block), _combined).first()
    if found is None or not form.dim:
        return Whitening(form, found["n"] if found else 0)
    spectrum = _spectrum_of(found.asDict())
    mean = np.array([s / spectrum.n for s in spectrum.sums])
    # Rayleigh-Ritz: the covariance on the basis, and the turn that makes it diagonal
    basis = np.linalg.qr(spectrum.vectors[:, ::-1])[0]
    on_basis = covariance(fit_list, form, mean, basis)
    values, turn = np.linalg.eigh((on_basis + on_basis.T) / 2)
    trace = float(np.trace(on_basis))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > 64 * form.dim * EPS * trace]
    out = Whitening(form, spectrum.n, spectrum.sums, mean, values[order], np.linalg.qr(basis @ turn[:, order])[0], trace)
    if len(order):
        out.identity_error = float(np.abs(covariance(fit_list, form, mean, out.turn) - np.eye(len(order))).max())
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None] | np.ndarray:
    """sum over the entries of (n * x - sum)^2, exact; None where a long can't hold it."""
    largest = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums), default=0)
    if x.shape[1] * largest * largest < 1 << 63:
        return ((n * x.astype(np.int64) - np.array(sums, np.int64)) ** 2).sum(axis=1)
    exact = (sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


# ------------------------------------------------------------------ results


def _components(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own: Whitening = model.value
    k = len(own.values)
    for batch in batches:
        for start in range(0, batch.num_rows if k else 0, 4096):
            part = batch.slice(start, 4096)
            x = numbers(part.column("vector"), own.form)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, own.n)),
                    pa.array(deviations(x, own.n, own.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(((x - own.mean) @ own.turn).ravel()),
                    pa.array(np.tile(own.values / own.trace, m)),
                    pa.array(np.full(m * k, own.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def by_component(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each whole vector and component."""
    model = fit(df, "embedding", components)
    rows = packed(df.select("vec_id", F.col("embedding").alias("vector")), "vector", SCALE, model.form)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return per_task(rows, _components, schema, df.sparkSession.sparkContext.broadcast(model))


def _whitened(batches: Iterable[pa.RecordBatch], model, form: Form, vector: str, name: str) -> Iterator[pa.RecordBatch]:
    own: Whitening = model.value
    for batch in batches:
        x = numbers(batch.column(vector), form)
        out = (x - own.mean) @ own.turn if len(own.values) else np.zeros((len(x), 0))
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(out.shape[1]))
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != vector]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=[n for n, _ in rest] + [name])


def whitened(df: DataFrame, model: Whitening, vector: str = "embedding", name: str = "whitened", scale: float = SCALE) -> DataFrame:
    """The rows of ``df`` with a whole vector no longer than the fit's, and their whitened vector (array<double>) as the last column."""
    if name.lower() in map(str.lower, df.columns):
        raise ValueError(f"column {name} exists; name another one")
    raw = free_name("__vector", df.columns)
    fitting = df.where(F.size(f"`{vector}`") <= model.form.dim).withColumn(raw, F.col(f"`{vector}`"))
    form = replace(form_of(fitting, raw, scale), dim=model.form.dim)
    schema = with_field(df.schema, name, "array<double>")
    return per_task(packed(fitting, raw, scale, form), _whitened, schema, df.sparkSession.sparkContext.broadcast(model), form, raw, name)
