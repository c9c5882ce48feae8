"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product is turned into smallest distance: with M the largest norm, a
vector x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0).  Each table
hashes with ``hashes`` Gaussian (2-stable) projections, floor((a.x + b) / w).  A query
looks into its own bucket and into perturbed ones, moving some hashes by one cell, in
the order of the summed squared distances to the crossed cell borders, that is of the
estimated chance to hold a near vector.  The order is worked out once, for the expected
distances of sorted borders, and mapped to each query's own borders.

How many buckets to probe is found on a bounded sample: the fewest at which sample
queries find the wished share of their true neighbours in the sample.  If the most
perturbations that are tried don't reach it, tables are doubled; if the most tables
don't either, all rows are compared, in blocks.  Every row is indexed.  Candidates of
all tables are ranked by their exact inner product.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from grafita.llm.common import cut, small
from grafita.llm.vectors import dimension, matrix, usable

_BLOCK = 4096
_TASK_ROWS = 20_000


def perturbations(hashes: int, count: int) -> list[tuple[int, ...]]:
    """The first ``count`` valid sets of ranks (0 .. 2*hashes-1) by expected summed squared distance.

    Rank r is a query's r-th nearest cell border; ranks r and 2*hashes-1-r are the two
    borders of one hash, so a set has at most one of them.  Sets are grown from a heap
    by shifting or extending their largest rank.
    """
    m = 2 * hashes
    z = [(r + 1) * (r + 2) / (4 * (hashes + 1) * (hashes + 2)) if r < hashes else 1 - (m - r) / (hashes + 1) + (m - r) * (m - r + 1) / (4 * (hashes + 1) * (hashes + 2)) for r in range(m)]
    out: list[tuple[int, ...]] = [()]
    heap = [(z[0], (0,))]
    while heap and len(out) < count:
        score, ranks = heapq.heappop(heap)
        if len({min(r, m - 1 - r) for r in ranks}) == len(ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < m:
            heapq.heappush(heap, (score - z[last] + z[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + z[last + 1], (*ranks, last + 1)))
    return out


@dataclass
class Index:
    """Projections of all tables, the cell width, the largest norm and the probe order."""

    a: np.ndarray  # (dim + 1, tables * hashes)
    b: np.ndarray
    width: float
    norm: float
    tables: int
    hashes: int
    probes: list[tuple[int, ...]]
    keys: np.ndarray

    def cells(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            # only a query's direction matters; at length M it is at its nearest to the rows
            x = x * (self.norm / np.linalg.norm(x, axis=1, keepdims=True))
            extra = np.zeros(len(x))
        else:
            extra = np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(1)))
        return (np.column_stack([x, extra]) @ self.a + self.b) / self.width

    def bucket(self, cell: np.ndarray) -> np.ndarray:
        """64-bit keys of integer cells (..., hashes)."""
        return (cell.astype(np.int64) * self.keys).sum(-1) * np.int64(0x61C8864680B583EB) >> np.int64(8)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return self.bucket(np.floor(self.cells(x, False)).reshape(len(x), self.tables, self.hashes))

    def probed(self, x: np.ndarray, count: int) -> np.ndarray:
        """(rows, tables, count) bucket keys in the order to visit them."""
        pos = self.cells(x, True).reshape(len(x), self.tables, self.hashes)
        base = np.floor(pos)
        low = pos - base
        sides = np.concatenate([low, 1 - low], -1)  # border below: move by -1; above: by +1
        order = np.argsort(sides, -1, kind="stable")
        # a hash's two borders mirror each other in the order, as the probe sets assume
        out = np.repeat(self.bucket(base)[..., None], count, -1)
        step = np.concatenate([-self.keys, self.keys])
        for k, ranks in enumerate(self.probes[:count]):
            if ranks:
                cell = base.astype(np.int64)
                raw = (cell * self.keys).sum(-1) + step[order[..., list(ranks)]].sum(-1)
                out[..., k] = raw * np.int64(0x61C8864680B583EB) >> np.int64(8)
        return out


def build(sample: np.ndarray, norm: float, rows: int, k: int, recall: float, tables: int = 6, most_tables: int = 24, seed: int = 3) -> tuple[Index, int, float]:
    """An index for ``rows`` rows, the probes a table, and the recall reached on the sample (rows at random).

    A query's true neighbours in the sample lie about as far off as those in the table, or
    farther.  Hashes grow with the log of the rows, at 0.45 a doubling: buckets then grow,
    too, more slowly than the table, and so do the probes that a query needs.
    """
    dim = sample.shape[1]
    hashes = int(np.clip(round(0.45 * np.log2(max(rows, 2))), 1, 24))
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((dim + 1, tables * hashes))
    lifted = np.column_stack([sample, np.sqrt(np.maximum(0, norm**2 - (sample * sample).sum(1)))])
    spread = float(np.median((lifted @ a).std(0))) or 1.0
    width = 2.5 * spread
    keys = rng.integers(1, 1 << 62, hashes) | 1
    index = Index(a, rng.uniform(0, width, tables * hashes), width, norm, tables, hashes, perturbations(hashes, 3 ** min(hashes, 7)), keys)
    queries = sample[: max(1, min(200, len(sample)))]
    most = len(index.probes)
    if len(sample) <= k + 1:
        return index, most, 0.0  # too few to tell: the caller compares all rows
    score = queries @ sample.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    near = np.argsort(-score, 1, kind="stable")[:, :k]
    held = index.buckets(sample)
    probed = index.probed(queries, most)
    first = np.full(near.shape, most)
    for q in range(len(queries)):
        for t in range(tables):
            place = {int(b): i for i, b in reversed(list(enumerate(probed[q, t])))}
            at = np.array([place.get(int(b), most) for b in held[near[q], t]])
            first[q] = np.minimum(first[q], at)
    # found[c]: the share of neighbours in the first c probes
    found = np.concatenate([[0], np.cumsum(np.bincount(first.ravel(), minlength=most + 1)[:most])]) / first.size
    if found[-1] < recall and 2 * tables <= most_tables:
        return build(sample, norm, rows, k, recall, 2 * tables, most_tables, seed)
    count = min(int(np.searchsorted(found, recall)), most)
    return index, count, float(found[count])


_FOUND = "qid long, query_id long, rid long, vec_id long, score double"


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95, sample_rows: int = 4096, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k rows of largest inner product found.

    ``table`` and ``queries`` hold (vec_id, embedding).  A row is no candidate of a query
    with its own vec_id; every other row is, repeats of a vec_id too, and each query row
    has a list of its own.  Ties go to the smaller vec_id.  Null, zero or non-finite
    vectors, those whose length is not the commonest of the table, and rows without vec_id,
    take no part.  Other columns are left out.  A query for which the probes found
    fewer than k candidates is compared with all rows, in blocks, and so are all queries
    if the index does not reach ``recall`` on its sample.  No rows give no rows.
    """
    usual = lambda df, key: cut(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable() & F.col("vec_id").isNotNull()).withColumn(key, F.monotonically_increasing_id()))
    rows = usual(table, "rid")
    asked = usual(queries, "qid").withColumnRenamed("vec_id", "query_id").withColumnRenamed("embedding", "q")
    dim, n, other = dimension(rows)
    if other:
        rows = cut(rows.where(F.size("embedding") == dim))
    asked = asked.where(F.size("q") == dim)
    if not n:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    norm = float(np.sqrt(rows.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]))
    # about 1.6 times the sample passes the test, so tasks send few vectors whatever their number
    draw = F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(1 << 40))
    some = rows.where(draw <= int(min(1.0, 1.6 * sample_rows / n) * (1 << 40)))
    sample = matrix(some.orderBy(draw, "rid").limit(sample_rows).select("embedding").toArrow()["embedding"])
    index, probes, reached = build(sample, norm, n, k, recall, seed=seed)
    if reached < recall:
        return _named(_top(_all_rows(rows, asked, n, asked.count(), k), k))
    tables = index.tables

    @F.pandas_udf(ArrayType(LongType()))
    def held(v: pd.Series) -> pd.Series:
        return pd.Series(list(index.buckets(np.array(v.tolist(), np.float64))))

    @F.pandas_udf(ArrayType(ArrayType(LongType())))
    def visited(v: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(v), 256):
            out += [list(x) for x in index.probed(np.array(v[at : at + 256].tolist(), np.float64), probes)]
        return pd.Series(out)

    placed = cut(rows.select("rid", F.posexplode(held("embedding")).alias("t", "bucket")))
    sizes = placed.groupBy("t", "bucket").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    groups = max(1, n * tables // _TASK_ROWS)
    task = F.pmod(F.xxhash64("t", "bucket", "block"), F.lit(groups)).cast("int")
    # buckets of more than one block are few; a hot one would be a hot key of a shuffled join
    wide = cut(sizes.where("blocks > 1").withColumnsRenamed({"t": "t2", "bucket": "b2"}))
    wide = small(wide, wide.count())
    same = (F.col("t") == F.col("t2")) & (F.col("bucket") == F.col("b2"))
    data = placed.join(wide, same, "left").withColumn("block", F.pmod(F.xxhash64("rid"), F.coalesce("blocks", F.lit(1))).cast("int")).select(task.alias("p"), "t", "bucket", "block", "rid").join(rows, "rid")
    probe = asked.select("qid", F.posexplode(visited("q")).alias("t", "list")).select("qid", "t", F.explode(F.array_distinct("list")).alias("bucket"))
    probe = probe.join(sizes.withColumnsRenamed({"t": "t2", "bucket": "b2"}), same).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a query goes once to each task that holds some of its buckets
    probe = probe.withColumn("p", task).groupBy("p", "qid").agg(F.collect_list(F.struct("t", "bucket", "block")).alias("visits")).join(asked, "qid")

    def rank(rows: pa.Table, probes: pa.Table) -> pa.Table:
        if not rows.num_rows or not probes.num_rows:
            return _none()
        names = ("t", "bucket", "block")
        column = [rows[c].to_numpy().astype(np.int64) for c in names]
        order = np.lexsort(column[::-1])
        keys = np.stack(column)[:, order]
        cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [len(order)]])
        place = {tuple(keys[:, a].tolist()): i for i, a in enumerate(cuts[:-1])}
        visitors: dict[int, list[int]] = {}
        for i, visits in enumerate(probes["visits"].to_pylist()):
            for v in visits:
                at = place.get((v["t"], v["bucket"], v["block"]))
                if at is not None:
                    visitors.setdefault(at, []).append(i)
        best = _Best(probes, rows.take(pa.array(order)), k)
        for at, who in visitors.items():
            best.offer(np.array(who), int(cuts[at]), int(cuts[at + 1]))
        return best.table()

    found = data.groupBy("p").cogroup(probe.groupBy("p")).applyInArrow(rank, _FOUND)
    best = cut(_top(found, k))
    short = cut(asked.join(best.groupBy("qid").agg(F.count("*").alias("got")), "qid", "left").where(F.coalesce("got", F.lit(0)) < min(k, n)).drop("got"))
    left = short.count()
    if not left:
        return _named(best)
    rest = _top(_all_rows(rows, short, n, left, k), k)
    return _named(best.join(short.select("qid"), "qid", "left_anti").unionByName(rest))


def _all_rows(rows: DataFrame, asked: DataFrame, n: int, queries: int, k: int) -> DataFrame:
    """Every bucket of one table is visited: all rows, in blocks of a bounded number of rows and queries."""
    strips, blocks = max(1, n // _TASK_ROWS), max(1, queries // 1000)
    every = rows.select(F.pmod(F.xxhash64("rid"), F.lit(strips)).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("g"), "rid", "vec_id", "embedding")
    each = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))).alias("p"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("g"), "qid", "query_id", "q")

    def rank(rows: pa.Table, probes: pa.Table) -> pa.Table:
        if not rows.num_rows or not probes.num_rows:
            return _none()
        best = _Best(probes, rows, k)
        for at in range(0, rows.num_rows, _BLOCK):
            best.offer(np.arange(probes.num_rows), at, min(at + _BLOCK, rows.num_rows))
        return best.table()

    return every.groupBy("p", "g").cogroup(each.groupBy("p", "g")).applyInArrow(rank, _FOUND)


class _Best:
    """The k best rows of each query so far; what can't be among them is dropped at once.

    Products of matrices may differ in the last digit for equal vectors, so they are
    compared after rounding, ties going to the smaller id; the scores given out are summed
    anew, in one order for all.
    """

    def __init__(self, queries: pa.Table, rows: pa.Table, k: int):
        self.qid, self.query_id, self.q = queries["qid"].to_numpy(), queries["query_id"].to_numpy(), matrix(queries["q"])
        self.rid, self.ids, self.x, self.k = rows["rid"].to_numpy(), rows["vec_id"].to_numpy(), matrix(rows["embedding"]), k
        self.edge = np.full(len(self.qid), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def offer(self, who: np.ndarray, a: int, b: int) -> None:
        """Rows a:b to the queries who."""
        for at in range(0, len(who), 1024):
            rows = who[at : at + 1024]
            score = self.q[rows] @ self.x[a:b].T
            score[self.query_id[rows][:, None] == self.ids[None, a:b]] = -np.inf
            if b - a > self.k:  # these rows alone hold k that reach their k-th score
                self.edge[rows] = np.maximum(self.edge[rows], np.partition(score, -self.k, axis=1)[:, -self.k])
            # a product under the edge by less than the rounding counts as a tie
            i, j = np.nonzero((score >= (self.edge[rows] - 1e-10)[:, None]) & (score > -np.inf))
            self.held.append((rows[i], a + j, np.round(score[i, j], 11)))
            self.size += len(i)
            if self.size > 300_000:
                self.trim()

    def trim(self) -> None:
        who, row, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((self.rid[row], self.ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        rid = self.rid[row]
        new = np.concatenate([[True], (who[1:] != who[:-1]) | (rid[1:] != rid[:-1])])  # tables overlap
        who, row, score = who[new], row[new], score[new]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        last = rank == self.k - 1
        self.edge[who[last]] = np.maximum(self.edge[who[last]], score[last] - 1e-11)
        keep = rank < self.k
        self.held = [(who[keep], row[keep], score[keep])]
        self.size = int(keep.sum())

    def table(self) -> pa.Table:
        if not self.size:
            return _none()
        self.trim()
        who, row, _ = self.held[0]
        score = np.einsum("ij,ij->i", self.q[who], self.x[row])
        columns = [self.qid[who], self.query_id[who], self.rid[row], self.ids[row], score]
        return pa.table([pa.array(c) for c in columns], schema=_none().schema)


def _none() -> pa.Table:
    return pa.schema([(n, {"long": pa.int64(), "double": pa.float64()}[t]) for n, t in (c.split() for c in _FOUND.split(", "))]).empty_table()


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid")
    distinct = found.groupBy("qid", "rid").agg(F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
    return distinct.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def _named(best: DataFrame) -> DataFrame:
    return best.select("query_id", "rank", "vec_id", "score")
