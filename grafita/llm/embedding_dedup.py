"""Near-duplicate vectors: sign hashing in several tables, exact cosine, components.

A table's code of a vector is the signs of ``bits`` random projections.  Vectors that
share a code in any table are compared exactly, in double precision.  Equal vectors
are compared once, with a weight; large buckets are cut into blocks of bounded size
and every pair of blocks is a unit of work, so no bucket meets in one task.  A pair
counts in the first table that has it, so counts need no shuffle of pairs; of the
links themselves a task sends only a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from grafita.llm.common import cut
from grafita.llm.components import components, spread
from grafita.llm.vectors import dimension, matrix, usable

_BLOCK = 512
_TASK_ROWS = 20_000


def _links(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, code: np.ndarray, block: np.ndarray, t: int, lo: int, hi: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one pair of blocks: linked ids, how many links each has first in table t, and a root each."""
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    linked = x[left] @ x[right].T >= threshold
    if lo == hi:
        np.fill_diagonal(linked, False)
    i, j = np.nonzero(linked)
    i, j = left[i], right[j]
    first = ~(code[i, :t] == code[j, :t]).any(1) if len(i) < 1 << 16 else np.concatenate([~(code[i[s : s + 65536], :t] == code[j[s : s + 65536], :t]).any(1) for s in range(0, len(i), 65536)])
    i, j = i[first], j[first]
    count = np.bincount(i, weight[j], len(ids)).astype(np.int64)
    if lo != hi:
        count += np.bincount(j, weight[i], len(ids)).astype(np.int64)
    label = np.arange(len(ids))
    while len(i):  # a spanning forest of the links found here
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[label]
        if (label == before).all():
            break
    use = count > 0
    return ids[use], count[use], ids[label[use]]


def plan_tables(rows: int, threshold: float, miss: float = 1e-3, bucket_rows: int = 160) -> tuple[int, int]:
    """Bits and tables: about bucket_rows rows a bucket; a pair at the threshold is missed with chance ``miss``."""
    bits = max(4, min(30, math.ceil(math.log2(max(rows, 1) / bucket_rows)))) if rows > bucket_rows else 4
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-same)))


def near_duplicates(table: DataFrame, threshold: float = 0.9, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding).

    Null, zero or non-finite vectors, and those whose length is not the commonest, link
    with nothing: 0 links, a component of their own.  Other columns are left out.  Rows with a null vec_id link with nothing either and keep a null component.
    Repeated vec_ids are each a row, and count as links of each other if their vectors
    do.  Threshold must be above 0.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable() & F.col("vec_id").isNotNull(), F.col("embedding")).alias("embedding"))
    # rows with equal vectors are one representative, of a number of its own, with a weight
    distinct = cut(rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")).withColumn("rep", F.monotonically_increasing_id()))
    dim, n, other = dimension(distinct)
    if other:
        rows = rows.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")))
        distinct = cut(distinct.where(F.size("embedding") == dim))
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    bits, tables = plan_tables(n, threshold)
    planes = np.random.default_rng(seed).standard_normal((dim, bits * tables))
    weights = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf(ArrayType(IntegerType()))
    def codes_of(v: pd.Series) -> pd.Series:
        signs = (np.array(v.tolist(), np.float64) @ planes > 0).reshape(len(v), tables, bits)
        return pd.Series(list((signs @ weights).astype(np.int32)))

    coded = cut(distinct.withColumn("codes", codes_of("embedding")))
    entries = coded.select("rep", F.posexplode("codes").alias("t", "code"))
    sizes = cut(entries.groupBy("t", "code").agg(F.count("*").alias("size")).where("size > 1"))
    blocks = entries.join(sizes, ["t", "code"]).withColumn("nb", F.ceil(F.col("size") / _BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep", "t"), F.col("nb")).cast("int"))
    # every unordered pair of a bucket's blocks is one unit; a row goes to the nb units that have its block
    units = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("rep", "t", "code", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    full = units.join(coded, "rep").select("t", "code", "lo", "hi", "block", "rep", "weight", "embedding", "codes")

    names = ["t", "code", "lo", "hi"]

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(n, "ascending") for n in [*names, "rep"]])
        key = np.stack([rows[n].to_numpy() for n in names])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        ids, weight, block = rows["rep"].to_numpy(), rows["weight"].to_numpy(), rows["block"].to_numpy()
        x, code = matrix(rows["embedding"]), matrix(rows["codes"]).astype(np.int32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out = [(np.zeros(0, np.int64),) * 3]
        for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            out.append(_links(ids[a:b], weight[a:b], x[a:b], code[a:b], block[a:b], *key[[0, 2, 3], a], threshold))
        rep, count, root = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"rep": rep, "n": count, "root": root})

    # a row of a bucket of nb blocks is in nb units
    sent = sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / _BLOCK))).first()[0] or 0
    groups = max(1, int(sent) // _TASK_ROWS)
    dealt = full.withColumn("p", F.pmod(F.xxhash64(*names), F.lit(groups)))
    found = cut(dealt.groupBy("p").applyInArrow(compare, "rep long, n long, root long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = cut(components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep").join(distinct.select("rep", "first"), "rep"))
    heads = cut(parts.groupBy(F.col("component").alias("head")).agg(F.min("first").alias("least")))
    parts = spread(parts, "component", heads, "head", heads.count()).select("rep", "least")
    per_rep = distinct.join(counts, "rep", "left").join(parts, "rep", "left")
    per_rep = cut(per_rep.select(F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id")))
    out = rows.join(per_rep, F.col("embedding") == F.col("e"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
