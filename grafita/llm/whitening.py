"""Whitening of vectors, from a Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Rows stay in Spark, packed into blocks of about two MB; the driver holds vectors of one
row's length only.  A step multiplies the centred matrix X with a vector and X' with the
result, in one pass over the blocks:

    alpha u = X v - beta u'        r = X'u - alpha v        beta v'' = r

A left vector u is as long as the table, so it is never formed: it is kept as the
combination g with u = X g, and the pass returns X'X g.  Inner products of left vectors
then cost no pass (u'·u = (X'u')·g), which is what full reorthogonalisation of both sides
needs.  The singular values of the small bidiagonal matrix, squared and divided by the
number of rows, are the covariance's eigenvalues; its right vectors, turned by those of
the steps, are the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafita.llm.common import cut

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries whose whole number is no 64-bit integer can't take part.
REACH = 2.0**62 / SCALE
BLOCK_BYTES = 2 << 20
_LONG = 2**63


def _taking_part(vector: str) -> Column:
    v = F.col(f"`{vector}`")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < REACH))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good, F.lit(False))


def _packed(rows: DataFrame, dim: int) -> DataFrame:
    """Blocks of rows: ids (a list) and data (the whole numbers of their vectors, row by row)."""
    per = max(1, BLOCK_BYTES // (8 * dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, per):
                part = batch.slice(at, per)
                c = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.floor(c * SCALE).astype(np.int64) + SHIFT
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "data"])

    kind = rows.schema[0].dataType.simpleString()
    return cut(rows.mapInArrow(pack, f"ids array<{kind}>, data binary"))


@dataclass
class Centre:
    """What centres a row exactly: the number of rows and the sum of each dimension."""

    n: int
    sums: list[int]
    #: Largest |n * x - sum| of each dimension.
    most: list[int]

    def __post_init__(self) -> None:
        self.exact = max(self.most) < _LONG and self.n * (max(self.most) // self.n + max(map(abs, self.sums)) // self.n + 2) < _LONG
        self.squares = self.exact and sum(m * m for m in self.most) < _LONG

    def offsets(self, data: bytes) -> np.ndarray:
        """n * x - sum: int64 where that holds every value, else Python's integers."""
        x = np.frombuffer(data, np.int64).reshape(-1, len(self.sums))
        if self.exact:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, data: bytes) -> np.ndarray:
        return self.offsets(data).astype(np.float64) / self.n

    def deviations(self, data: bytes) -> list[int | None]:
        """Sum of squared offsets of each row; None where no long holds it."""
        d = self.offsets(data)
        if self.squares:
            return (d * d).sum(1).tolist()
        d = d.astype(object)
        return [s if s < _LONG else None for s in (d * d).sum(1)]


def _centre(blocks: DataFrame, dim: int) -> Centre | None:
    """Counts and sums over all rows, whole: a task adds the high and low halves of its numbers apart."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        least, most = np.full(dim, np.iinfo(np.int64).max), np.full(dim, np.iinfo(np.int64).min)
        for batch in batches:
            for data in batch.column("data"):
                x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dim)
                n += len(x)
                high += (x >> 32).sum(0)
                low += (x & 0xFFFFFFFF).sum(0)
                least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (np.arange(dim), np.full(dim, n), high, low, least, most)], ["d", "n", "high", "low", "least", "most"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = blocks.select("data").mapInArrow(add, "d long, n long, high long, low long, least long, most long")
    found = parts.groupBy("d").agg(whole("n"), whole("high"), whole("low"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
    if not found:
        return None
    found.sort(key=lambda r: r.d)
    n = int(found[0].n)
    sums = [(int(r.high) << 32) + int(r.low) for r in found]
    return Centre(n, sums, [max(abs(n * r.least - s), abs(n * r.most - s)) for r, s in zip(found, sums, strict=True)])


def _pass(blocks: DataFrame, centre: Centre, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of what ``of`` makes (``width`` numbers) of a block's centred rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for data in batch.column("data"):
                total += of(centre.rows(data.as_buffer()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["d", "v"])

    out = np.zeros(width)
    for d, v in blocks.select("data").mapInArrow(work, "d long, v double").groupBy("d").agg(F.sum("v")).collect():
        out[d] = v
    return out


def _apart(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """x without its share in each of others (orthonormal rows), twice over."""
    for _ in range(2 * bool(len(others))):
        x = x - others.T @ (others @ x)
    return x


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], dim: int, total: float, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` singular values of X and their right vectors (columns), largest first.

    product(w) returns X'X w; total is the sum of squares of X.  Ends after ``dim`` steps, or
    once the values' residuals are below rounding and what the steps have not seen of ``total``
    is less than the least of them, so that no equal or larger one is hidden.  Where a step
    comes to nothing (fewer ranks than dimensions, equal values), a fresh direction goes on.
    """
    rng = np.random.default_rng(seed)
    scale = np.sqrt(total)
    right, g, z = np.zeros((0, dim)), np.zeros((0, dim)), np.zeros((0, dim))
    alphas, betas = [], []
    v, beta = rng.standard_normal(dim), 0.0
    v /= np.linalg.norm(v)
    while True:
        right = np.vstack([right, v])
        w = v - beta * g[-1] if len(g) else v
        zw = product(w)
        for _ in range(2 * bool(len(g))):  # the shares in earlier left vectors, u·Xw = (X'u)·w
            share = z @ w
            w, zw = w - g.T @ share, zw - z.T @ share
        alpha = np.sqrt(max(0.0, float(w @ zw)))
        alpha = alpha if alpha > 1e-13 * scale else 0.0
        g = np.vstack([g, w / alpha if alpha else np.zeros(dim)])
        z = np.vstack([z, zw / alpha if alpha else np.zeros(dim)])
        alphas.append(alpha)
        k = len(alphas)
        b = np.diag(alphas) + np.diag(betas, 1)
        p, s, qt = np.linalg.svd(b)
        if k == dim:
            break
        r = _apart(z[-1] - alpha * v, right)
        beta = float(np.linalg.norm(r))
        top = min(wanted, k)
        settled = k >= wanted and np.all(beta * np.abs(p[-1, :top]) <= 1e-16 * s[0]) and total - float(s @ s) < 0.5 * s[top - 1] ** 2
        if settled:
            break
        if beta <= 1e-13 * scale:
            beta, r = 0.0, _apart(rng.standard_normal(dim), right)
        v = _apart(r / np.linalg.norm(r), right)
        v /= np.linalg.norm(v)
        betas.append(beta)
    top = min(wanted, len(s))
    return s[:top], right.T @ qt[:top].T


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding", seed: int = 1) -> DataFrame:
    """A row for each vector that takes part and each of its ``components`` largest principal components.

    Vectors that are null, empty, or hold an entry that is null, not finite or of 2**62 / 1024
    and more take no part, nor do those whose length is not the commonest (of equally
    common ones the larger).  An entry c counts as the whole number floor(1024 c) + 100000.
    Returns the key, component (from 1, by falling eigenvalue e; the sign is such that the
    entry of largest size is positive), n (vectors), deviation (exact sum of squared
    n * x - S; null where no long holds it), whitened, explained (e / trace) and
    identity_error.  Equal rows and null keys each count; other columns are left out.
    Components of no variance are left out, so vectors that are all equal give no rows,
    as an empty table does.
    """
    good = vectors.where(_taking_part(vector)).select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = int(common.d)
    blocks = _packed(good.where(F.size("v") == dim), dim)
    centre = _centre(blocks, dim)
    total = float(_pass(blocks, centre, 1, lambda x: np.array([np.square(x).sum()]))[0])
    if not total:
        return vectors.sparkSession.createDataFrame([], schema)
    n = centre.n
    s, q = bidiagonalise(lambda w: _pass(blocks, centre, dim, lambda x: x.T @ (x @ w)), dim, total, min(components, dim), seed)
    seen = s > 1e-11 * s[0]
    s, q = s[seen], q[:, seen]
    q = q * np.sign(q[np.abs(q).argmax(0), np.arange(len(s))])
    m, e = len(s), s**2 / n
    turn = q / np.sqrt(e)
    mean = _pass(blocks, centre, m, lambda x: (x @ turn).sum(0)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        y = x @ turn - mean
        return (y.T @ y).ravel()

    error = float(np.abs(_pass(blocks, centre, m * m, spread).reshape(m, m) / n - np.eye(m)).max())
    explained = s**2 / total

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("data"), strict=True):
                y = centre.rows(data.as_buffer()) @ turn
                k = len(y)
                each = np.repeat(np.arange(k), m)
                deviation = pa.array(centre.deviations(data.as_buffer()), pa.int64())
                columns = [
                    ids.values.take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, n)),
                    deviation.take(pa.array(each)), pa.array(y.ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(project, schema)
