"""Whitening of vectors: a distributed covariance, its eigenvectors in single precision, corrected in a higher one."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flightlens.llm.topk import matrix, quantized
from flightlens.session import stored

COMPONENTS = 16
ROWS = 4096  # vectors that a task multiplies at once
ROUNDS = 30  # corrections at most; each doubles the digits, so three or four do unless eigenvalues are close
LONG = 2**63 - 1


def refine(a: np.ndarray, x: np.ndarray, values: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One correction of approximate eigenvectors ``x`` of the symmetric ``a`` by matrix products (Ogita and Aishima).

    Returns corrected vectors, eigenvalues, and which neighbours (in order of the values) lie too close to be told apart by
    the correction: for those only orthogonality is mended.
    """
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ a @ x
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    delta = max(2 * float(np.sqrt((off**2).sum()) + np.abs(values).max(initial=0) * np.sqrt((r**2).sum())), apart)
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= delta
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
    return x + x @ e, values, close


def clusters(close: np.ndarray) -> list[np.ndarray]:
    """Sets of two or more places that are connected by ``close``."""
    left, out = set(range(len(close))), []
    while left:
        wave, group = [left.pop()], []
        while wave:
            i = wave.pop()
            group.append(i)
            near = [j for j in np.flatnonzero(close[i]).tolist() if j in left]
            left.difference_update(near)
            wave += near
        if len(group) > 1:
            out.append(np.array(sorted(group)))
    return out


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Columns made orthonormal by Newton steps x (3 - x'x) / 2; they must be nearly so already."""
    for _ in range(ROUNDS):
        r = np.eye(x.shape[1], dtype=x.dtype) - x.T @ x
        if np.abs(r).max(initial=0) <= 4 * np.finfo(x.dtype).eps * max(1, x.shape[1]):
            break
        x = x + x @ r / 2
    return x


def eigenvectors(a: np.ndarray, precision: type = np.longdouble) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of a symmetric matrix, in order of falling value, to double precision.

    Starts from eigenvectors in single precision and corrects them with matrix products in ``precision``. Where values lie
    too close for a correction, the vectors span the right space but are mixed within it: then the cluster is solved by
    itself, in double precision, with its middle value taken off first so that the small gaps count, and turned.
    """
    n = len(a)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    size = float(np.abs(a).max()) or 1.0
    wide = a.astype(precision) / precision(size)
    values, x = np.linalg.eigh((a / size).astype(np.float32))
    x, values = orthonormal(x.astype(precision)), values.astype(precision)
    eps = float(np.finfo(np.float64).eps)
    before = np.inf
    for _ in range(ROUNDS):
        x, values, close = refine(wide, x, values, 0.0)
        for group in clusters(close):
            part = orthonormal(x[:, group])
            middle = values[group].mean()
            inner = part.T @ (wide @ part - middle * part)
            inner = (inner + inner.T) / 2
            scale = np.abs(inner).max()
            if scale > 0:
                turn = np.linalg.eigh((inner / scale).astype(np.float64))[1].astype(precision)
                part = part @ orthonormal(turn)
            x[:, group] = part
        x = orthonormal(x)
        s = x.T @ wide @ x
        left = float(np.abs(s - np.diag(np.diag(s))).max())
        if left <= eps * 1e-2 or (left >= before / 2 and left <= 16 * eps):
            break
        before = left
    values = np.diag(x.T @ wide @ x) * precision(size)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), x[:, order].astype(np.float64)


def moments(fit: DataFrame, shift: np.ndarray, rest: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """Sum over all rows of ``fit`` (x: whole numbers) of z z', where z = x - shift - rest, times ``turn`` if given.

    ``shift`` is whole and taken off exactly, so the centred values keep all digits. A task sends one row per dimension;
    rows of one dimension are added up before they reach the driver, which gets one square matrix.
    """
    wide = len(shift) if turn is None else turn.shape[1]

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                z = (matrix(batch.column(0).slice(start, ROWS)) - shift).astype(float) - rest
                z = z if turn is None else z @ turn
                total += z.T @ z
        yield rows_of(total, range(wide))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(row)
        if sums:
            yield rows_of(np.array(list(sums.values())), sums)

    def rows_of(total, names):
        return pa.RecordBatch.from_arrays([pa.array(list(names), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    schema = "i int, row binary"
    added = fit.select("x").mapInArrow(gram, schema).repartition("i").mapInArrow(add, schema).collect()
    total = np.zeros((wide, wide))
    for r in added:
        total[r["i"]] = np.frombuffer(r["row"])
    return (total + total.T) / 2


def totals(fit: DataFrame) -> DataFrame:
    """(i, s, n): the exact sum of every dimension and the number of vectors; a task sends one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = None, 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column(0).slice(start, ROWS))
                # upper and lower halves apart, so no sum overflows
                high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                own = [(h << 32) + k for h, k in zip(high, low, strict=True)]
                sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
                n += len(x)
        if sums is not None:
            shown = pa.array([Decimal(v) for v in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), shown, pa.array([n] * len(sums))], ["i", "s", "n"])

    parts = fit.select("x").mapInArrow(run, "i int, s decimal(38,0), n long")
    return parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


class Whitening:
    """Fitted on each distinct vector of ``vectors`` (x: arrays of whole numbers of one length) once.

    ``n``: distinct vectors; ``sums``: per dimension, exact; ``values``, ``vectors``: eigenvalues and unit eigenvectors of
    their covariance (divisor n) in order of falling value; ``explained``: value over trace; ``error``: the largest entry
    by which the covariance of the whitened vectors, added up over all of them, is off the identity. Directions without
    spread, whose value is below the rounding of the largest, can't be whitened and are left out.
    """

    def __init__(self, vectors: DataFrame, components: int = COMPONENTS, name: str = "whiten"):
        fit = stored(vectors.groupBy("x").agg(F.lit(0).alias("_")).select("x"), f"{name}-fit")
        rows = sorted(totals(fit).collect())
        self.n = rows[0]["n"] if rows else 0
        self.sums = [int(r["s"]) for r in rows]
        self.shift = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])
        self.values, self.vectors, self.explained, self.error = np.zeros(0), np.zeros((len(rows), 0)), np.zeros(0), 0.0
        if not rows:
            return
        self.covariance = moments(fit, self.shift, self.rest) / self.n
        values, vectors = eigenvectors(self.covariance)
        trace = float(np.trace(self.covariance))
        kept = min(components, int((values > len(values) * np.finfo(float).eps * max(values[0], 0)).sum()))
        self.values, self.vectors, self.explained = values[:kept], vectors[:, :kept], values[:kept] / (trace or 1.0)
        self.turn = self.vectors / np.sqrt(self.values)
        if kept:
            whitened = moments(fit, self.shift, self.rest, self.turn) / self.n
            self.error = float(np.abs(whitened - np.eye(kept)).max())

    def apply(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

        ``deviation`` is the exact sum of (n * x - sum)**2 over the dimensions, null where it is beyond 64 bits.
        """
        state = vars(self)
        sc = vectors.sparkSession.sparkContext
        fitted = sc.broadcast({k: state.get(k) for k in ("n", "sums", "shift", "rest", "turn", "explained", "error")})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = fitted.value
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    yield rows_of(batch.slice(start, ROWS), f)

        def rows_of(batch: pa.RecordBatch, f: dict) -> pa.RecordBatch:
            kept = len(f["explained"])
            x = matrix(batch.column("x"))
            each = np.repeat(np.arange(len(x)), kept)
            white = ((x - f["shift"]).astype(float) - f["rest"]) @ f["turn"] if kept else np.zeros((len(x), 0))
            far = deviations(x, f["n"], f["sums"])
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), f["n"])),
                    pa.array([far[i] for i in each.tolist()], pa.int64()),
                    pa.array(white.reshape(-1)),
                    pa.array(np.tile(f["explained"], len(x))),
                    pa.array(np.full(len(each), f["error"])),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

        return vectors.select("vec_id", "x").mapInArrow(
            run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum of (n * x - sum)**2 per row; None beyond 64 bits."""
    most = max((n * int(np.abs(x[:, j]).max(initial=0)) + abs(s) for j, s in enumerate(sums)), default=0)
    if most < LONG:
        off = n * x - np.array(sums, dtype=np.int64)
        if int(np.abs(off).max(initial=0)) ** 2 * max(1, len(sums)) <= LONG:
            return (off**2).sum(1).tolist()
        off = off.astype(object)
    else:
        off = n * x.astype(object) - np.array(sums, dtype=object)
    return [int(v) if v <= LONG else None for v in (off**2).sum(1)]


def one_length(vectors: DataFrame) -> DataFrame:
    """The vectors of the most frequent length that is not 0; of two as frequent, the larger one."""
    sizes = vectors.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).filter("dim > 0")
    first = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    return vectors.filter(F.size("x") == (first["dim"] if first else 0)).filter(F.size("x") > 0)


def op13_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whitened over the 16 widest directions, in steps of 1/64.

    Rows whose vector is null or holds null, infinite or undefined entries are dropped; so are vectors of another length
    than the most frequent one, which no direction fits, and empty ones. Repeated rows and rows without a key are returned
    as often as they are there; the fit counts equal vectors once. If all vectors are equal nothing can be whitened, and
    like an empty table they give an empty result. Entries beyond 2**62 / 64 are out of range.
    """
    raw = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 64)
    vectors = stored(raw.select("vec_id", F.transform("x", lambda c: c + 1_000_000).alias("x")), "whiten-whole")
    vectors = one_length(vectors)
    return Whitening(vectors).apply(vectors)
