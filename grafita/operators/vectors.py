"""Exact cosine search and vector upkeep."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafita.sources.shared import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, where: Column | None = None, block: int = 4096, rows: int = 65_536) -> DataFrame:
    """query_id, vec_id, score (6 digits) of the k best of each query, ties by vec_id.

    A stated set of queries against all vectors.  The queries are counted: up to ``block``
    of them go to every task as a matrix; more are dealt into blocks, the vectors into
    slices of about ``rows``, and a task gets one block and one slice.  The payload filter
    runs before the scores, the threshold is inclusive.  Null and zero vectors, and those of
    another length than the query's, are no neighbours and have none.
    """
    v = vectors if where is None else vectors.where(where)
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull()) & F.exists("embedding", lambda x: x != 0)
    queries, v = queries.where(whole), v.where(whole)
    unit = lambda c: F.sqrt(dot(c, c))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), unit(F.col("embedding")).alias("qn"))
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", unit(F.col("embedding")).alias("n"))
    blocks = -(-queries.count() // block)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if blocks <= 1:
        best = _best_of_tasks(queries.select("vec_id", "embedding").toArrow(), v, k, least)
        return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    slices = max(1, -(-v.count() // rows))
    q = q.withColumn("__block", deal("query_id", blocks)).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    v = v.withColumn("__slice", deal("vec_id", slices)).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    s = q.join(v, ["__block", "__slice"])
    s = s.where((F.col("query_id") != F.col("vec_id")) & (F.size("q") == F.size("embedding")))
    s = s.withColumn("score", F.round(dot(F.col("q"), F.col("embedding")) / (F.col("qn") * F.col("n")), 6))
    if least is not None:
        s = s.where(F.col("score") >= least)
    return s.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Scores that a task holds at once.
_SCORES = 4 << 20


def _best_of_tasks(queries: pa.Table, vectors: DataFrame, k: int, least: float | None) -> DataFrame:
    """query_id, vec_id, score: the k best of each query among the vectors of each task, by matrix products.

    A task sends k rows a query at most, however many vectors it reads.
    """
    ids = queries["vec_id"].to_numpy()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    lists = queries["embedding"].to_pylist()
    for d in {len(x) for x in lists}:
        at = np.array([i for i, x in enumerate(lists) if len(x) == d])
        q = np.array([lists[i] for i in at], np.float64)
        by_size[d] = at, q / np.linalg.norm(q, axis=1, keepdims=True)

    def keep(found: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        """The k first of each query by falling score, then vec_id."""
        q, v, s = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        return [(q[place < k], v[place < k], s[place < k])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            for d, (at, q) in by_size.items():
                mine = np.flatnonzero(size == d)
                for i in range(0, len(mine), max(1, _SCORES // len(at))):
                    part = mine[i : i + max(1, _SCORES // len(at))]
                    x = batch.column(1).take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), d)
                    vid = batch.column(0).take(pa.array(part)).to_numpy()
                    s = np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6) + 0.0
                    s[ids[at][:, None] == vid[None]] = -np.inf
                    floor = np.partition(s, -k, axis=1)[:, -k] if len(part) > k else np.full(len(at), -2.0)
                    floor = np.maximum(floor, -2.0 if least is None else least)
                    a, b = np.nonzero(s >= floor[:, None])
                    found.append((at[a], vid[b], s[a, b]))
            found = keep(found)
        q, v, s = keep(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "query_id long, vec_id long, score double")


def validate(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors by length, and whether it is the expected one."""
    return vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).withColumn("ok", F.col("dim") == dim)


def check_batch(batch: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows to store, each with an id, and rows that can't be, with their error.

    batch: id (or null), embedding, metadata.  A vector of another length, or none, is
    ``dimension``; a row without metadata is ``metadata``.  A missing id becomes a UUID: the
    same one however often the row is computed, made of its place in the batch.
    """
    rows = cut(batch.withColumn("__at", F.monotonically_increasing_id()))
    error = F.when(~F.coalesce(F.size("embedding") == dim, F.lit(False)), "dimension").when(F.col("metadata").isNull(), "metadata")
    h = F.md5(F.concat_ws("|", F.lit(str(uuid4())), F.col("__at").cast("string")))
    made = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    t = rows.withColumn("error", error)
    good = t.where("error is null").withColumn("id", F.coalesce(F.nullif(F.col("id"), F.lit("")), made)).drop("__at", "error")
    return good, t.where("error is not null").select("id", "error")


def existing(stored: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """The values already stored."""
    return values.join(stored, key, "left_semi")
