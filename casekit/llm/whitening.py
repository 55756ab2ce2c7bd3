"""Operator 12: embedding whitening by Chebyshev-filtered subspace iteration.

The fit list is every distinct vector once: n vectors with exact integer sums S. The leading eigenvectors
of its covariance are found without forming it: all work on the data are passes Q -> X'XQ / n over the
centred vectors, whose partial products are summed by Spark; the driver holds only matrices of dimension x ``subspace``.

A sweep applies a Chebyshev polynomial of the covariance to the block by the three-term recurrence. It is
small over [a, b], the unwanted part of the spectrum, and grows above b. b is the block's smallest
Ritz value; a starts at zero and is raised to a Lanczos estimate whose vectors ride along with the first passes.
(A wrong a costs speed only.) Then QR, one pass, Rayleigh-Ritz. The block is certified when the residual
norm of every wanted pair is below ``TOLERANCE`` of the largest eigenvalue; sweeps then go on until the residuals
stop falling (``_SETTLED``), since close eigenvalues magnify them in the vectors. A spectrum on which
``_MAX_SWEEPS`` don't reach the tolerance raises; no uncertified result is returned.

Entries are integers (``lattice`` rounds floats), so that centring is exact: n * x - S is an integer, and
x minus the integer nearest the mean is what products are made of.

Defined results: vectors that are null, hold null or non-finite entries, or entries of 2^46 and more in
size (whose lattice point has no exact arithmetic) are dropped, and so are vectors whose dimension is not the
most frequent one (ties: the largest). Components whose eigenvalue is zero to double precision are left
out; so no vectors, one distinct vector or empty vectors give no rows. Repeated vectors count
once in the fit and get equal results; null ids stay. A deviation beyond the range of a long is null. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.session import cut_lineage

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: The block's vectors for each component wanted.
WIDTH = 3
DEGREE = 8
LANCZOS = 10
TOLERANCE = 1e-11
_SETTLED = 0.2
_MAX_SWEEPS = 60
_LARGEST = float(1 << 46)
_BLOCK_BYTES = 1 << 20
#: Bytes of blocks that one task of a pass reads.
_TASK_BYTES = 32 << 20


def lattice(rows: DataFrame, column: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x``: each entry c, as double, becomes the long floor(scale * c) + shift; bad vectors are dropped."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= _LARGEST))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))
    return rows.where(F.col(column).isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


@dataclass
class Whitening:
    """A fitted transform: ``vectors`` (dimension x components, unit columns) by falling ``values``."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int
    identity_error: float = 0.0


def _dimension(rows: DataFrame) -> int:
    found = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()
    return found.m.d if found.m else 0


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(rows: DataFrame, d: int) -> DataFrame:
    """The distinct vectors of ``rows`` in blocks of bytes, ``width`` bytes an entry."""

    def pack(batches):
        for b in batches:
            x = _matrix(b.column("x"), d)
            narrow = (np.abs(x) < 1 << 31).all(1)
            for part, kind in ((x[narrow], "<i4"), (x[~narrow], "<i8")):
                width = d * int(kind[2])
                ends = pa.py_buffer(np.arange(len(part) + 1, dtype=np.int32) * width)
                data = pa.Array.from_buffers(pa.binary(), len(part), [None, ends, pa.py_buffer(part.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays([data], names=["v"])

    def stack(batches):
        most = max(1, _BLOCK_BYTES // (8 * d))
        for b in batches:
            parts = {}
            for v in b.column("v").to_pylist():
                parts.setdefault(len(v) // d, []).append(v)
            for width, vs in parts.items():
                for i in range(0, len(vs), most):
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([b"".join(vs[i: i + most])], pa.binary())],
                                                     names=["width", "data"])

    distinct = rows.select("x").mapInArrow(pack, "v binary").distinct()
    blocks = cut_lineage(distinct.mapInArrow(stack, "width int, data binary"))
    size = blocks.agg(F.sum(F.length("data"))).first()[0] or 0
    # passes are many, so small tables get no more tasks than run at once
    return blocks.coalesce(max(blocks.sparkSession.sparkContext.defaultParallelism, -(-size // _TASK_BYTES)))


def _total(blocks: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all blocks of the arrays (of one shape) that ``part`` makes of a block's vectors, flat."""

    def task(batches):
        total = None
        for b in batches:
            for width, data in zip(b.column("width").to_pylist(), b.column("data")):
                made = part(np.frombuffer(data.as_buffer(), f"<i{width}").reshape(-1, d))
                total = made if total is None else total + made
        if total is not None:
            flat = np.ascontiguousarray(total).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

    sums = blocks.mapInArrow(task, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(sums.num_rows, np.int64 if kind == "long" else np.float64)
    out[sums["i"].to_numpy()] = sums["v"].to_numpy()
    return out


class _Lanczos:
    """A Lanczos run whose vector rides along with the block's passes; ``lower`` bounds the spectrum from below, nearly."""

    def __init__(self, d: int, steps: int, rng: np.random.Generator):
        v = rng.standard_normal(d)
        self.basis, self.alpha, self.beta, self.steps = [v / np.linalg.norm(v)], [], [], min(steps, d)
        self.lower: float | None = None

    def take(self, w: np.ndarray) -> None:
        self.alpha.append(self.basis[-1] @ w)
        b = np.array(self.basis)
        for _ in range(2):
            w = w - b.T @ (b @ w)
        norm = np.linalg.norm(w)
        if len(self.alpha) == self.steps or norm <= 1e-12 * abs(self.alpha[0]):
            t = np.diag(self.alpha) + np.diag(self.beta, 1) + np.diag(self.beta, -1)
            values, vectors = np.linalg.eigh(t)
            self.lower = max(0.0, values[0] - norm * abs(vectors[-1, 0]))
        else:
            self.beta.append(norm)
            self.basis.append(w / norm)


def fit(rows: DataFrame, components: int = COMPONENTS, seed: int = 12) -> Whitening | None:
    """Whitening of ``rows(x)``'s distinct vectors, all of the most frequent dimension; None without a nonzero component."""
    d = _dimension(rows)
    if not d:
        return None
    blocks = _blocks(rows.where(F.size("x") == d), d)
    sums = _total(blocks, d, lambda x: np.append(x.sum(0, dtype=np.int64), len(x)), "long")
    n, sums = int(sums[-1]), sums[:-1]
    middle = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)  # nearest the mean
    rest = np.array([int(s) - n * int(m) for s, m in zip(sums, middle)], float) / n
    passes = 0

    def centred(x):
        return (x - middle).astype(float) - rest

    def times(q):
        nonlocal passes
        passes += 1

        def part(x):
            c = centred(x)
            return c.T @ (c @ q)

        return _total(blocks, d, part, "double").reshape(q.shape) / n

    trace = float(_total(blocks, d, lambda x: (centred(x) ** 2).sum(keepdims=True).ravel(), "double")[0]) / n
    if not trace:
        return None
    rng = np.random.default_rng(seed)
    k, width = min(components, d), min(d, WIDTH * components)
    probe = _Lanczos(d, LANCZOS, rng) if width < d else None

    def ride(q):
        if probe is None or probe.lower is not None:
            return times(q)
        z = times(np.column_stack([q, probe.basis[-1]]))
        probe.take(z[:, -1])
        return z[:, :-1]

    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    before = np.inf
    for _ in range(_MAX_SWEEPS):
        z = ride(q)
        h = q.T @ z
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        residual = float(np.linalg.norm(z[:, :k] - q[:, :k] * values[:k], axis=0).max() / values[0])
        if residual <= TOLERANCE and (residual >= _SETTLED * before or width == d):
            break
        before = residual
        q = _filtered(q, z, values, probe.lower if probe and probe.lower is not None else 0.0, ride)
    else:
        raise ArithmeticError(f"no certified components after {_MAX_SWEEPS} sweeps: residual {residual:.1e}")
    real = values[:k] > d * np.finfo(float).eps * values[0]
    vectors, values = q[:, :k][:, real], values[:k][real]
    w = vectors / np.sqrt(values)
    cov = _total(blocks, d, lambda x: (lambda y: y.T @ y)(centred(x) @ w), "double").reshape(len(values), -1) / n
    return Whitening(n, sums, vectors, values, trace, residual, passes, float(np.abs(cov - np.eye(len(values))).max()))


def _filtered(q: np.ndarray, z: np.ndarray, values: np.ndarray, low: float, times: Callable) -> np.ndarray:
    """An orthonormal basis of the Chebyshev filter's image of the block ``q``, given ``z``, the covariance times ``q``.

    The recurrence is scaled by the polynomial's value at the largest eigenvalue, so that nothing overflows."""
    high, top = values[-1], values[0]
    if high <= 1e-10 * top:  # the block holds the whole range already: a power step
        return np.linalg.qr(z)[0]
    low = low if low < 0.99 * high else 0.0
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    old, new = q, (z - centre * q) * (first / half)
    for _ in range(DEGREE - 1):
        after = 1 / (2 / first - sigma)
        old, new = new, (times(new) - centre * new) * (2 * after / half) - (sigma * after) * old
        sigma = after
    return np.linalg.qr(new)[0]


def transform(rows: DataFrame, w: Whitening) -> DataFrame:
    """One row per vector of ``rows(vec_id, x)`` and component: see ``whitened``."""
    d, k, n, sums = len(w.sums), len(w.values), w.n, w.sums
    turn, part, error = w.vectors / np.sqrt(w.values), w.values / w.trace, w.identity_error

    def deviations(x):
        wide = (np.abs(x).max() + 1) * 2.0 * n >= 2.0 ** 62 if len(x) else False
        gap = x.astype(object) * n - [int(s) for s in sums] if wide else x * n - sums
        size = (gap.astype(float) ** 2).sum(1)
        if not wide and (size < 2.0 ** 62).all():
            return gap, pa.array((gap ** 2).sum(1), pa.int64())
        exact = [sum(int(g) ** 2 for g in row) for row in gap.tolist()]
        return gap, pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())

    def task(batches):
        for b in batches:
            gap, deviation = deviations(_matrix(b.column("x"), d))
            white = (gap.astype(float) / n) @ turn
            m = len(white)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n)), deviation.take(each), pa.array(white.ravel()),
                 pa.array(np.tile(part, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == d).mapInArrow(
        task, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``rows(vec_id, x)``, x integers."""
    w = fit(rows, components)
    if w is None:
        d = 1
        w = Whitening(1, np.zeros(d, np.int64), np.zeros((d, 0)), np.zeros(0), 1.0, 0.0, 0)
        return transform(rows.where("false"), w)
    return transform(rows, w)
