"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A document is the multiset of its runs of five words.  A shingle's weights are the
integer levels below its count, cut into the dyadic blocks [0,1), [1,2), [2,4), ...
Each block of each shingle has a Poisson process of its length as rate; a point has a
register, and a level within the block, and counts for every document in which the
shingle's weight is above that level.  A register keeps its earliest point.  Two
documents agree in a register with the chance of their weighted Jaccard similarity.
Points of a shingle come in order of time, so a shingle is done as soon as its next
point is later than the latest register: most are looked at once.

Signatures are banded.  Texts with equal words are one candidate.  In each bucket all
members are compared with two of them, the smallest and the largest id; the multisets
are compared exactly.  Where a bucket then still holds more than one component, all
pairs across its components are compared too, in blocks of bounded size whose
intersections are one matrix product, and of the links only a spanning forest leaves the
task: no link of a bucket is lost, and a large group never turns into rows of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafita.llm.common import cut
from grafita.llm.components import components
from grafita.llm.textkit import Words, give_back, hash_keys, mix, slices, texts_of

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_LOW48 = _U((1 << 48) - 1)
_BLOCK = 512
_TASK_ROWS = 2_000


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, count) of the distinct runs of k words; shorter texts are one run of all their words."""
    keys = []
    owner = words.text_of_words().astype(_U)
    if len(words.hash) >= k:
        ok = words.run_starts(k)
        keys.append((owner[: len(ok)][ok] << _U(48)) | (words.run_hash(k)[ok] >> _U(16)))
    for c in range(1, k):
        short = np.flatnonzero(words.counts == c)
        if len(short):
            at = words.first[short]
            keys.append((short.astype(_U) << _U(48)) | (words.run_hash(c, seed=c)[at] >> _U(16)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    both, count = np.unique(np.concatenate(keys), return_counts=True)
    return (both >> _U(48)).astype(np.int64), both & _LOW48, count


def bag_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int, seed: int = 0) -> np.ndarray:
    """(n, m) signatures of n multisets given as (text, element, integer weight)."""
    # one row for each dyadic block that a weight reaches into
    parts = [(np.arange(len(text)), np.zeros(len(text), np.int64), np.ones(len(text), np.int64))]
    low = 1
    while True:
        reach = np.flatnonzero(weight > low)
        if not len(reach):
            break
        parts.append((reach, np.full(len(reach), low), np.full(len(reach), low)))
        low *= 2
    row, low_, size = (np.concatenate(c) for c in zip(*parts, strict=True))
    key = mix(mix(element[row] + _U(seed)) + low_.astype(_U) * _GOLDEN)
    doc, top = text[row], weight[row]
    time = np.zeros(len(row))
    best = np.full(n * m, np.inf)
    value = np.zeros(n * m, np.uint32)
    drawn = 0
    while len(key):
        batch = max(1, min(64, 8192 // len(key)))
        step = np.arange(drawn + 1, drawn + batch + 1, dtype=_U) * _GOLDEN
        a = mix(key[:, None] + step)
        b = mix(a ^ _U(0x5851F42D4C957F2D))
        gap = -np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / size[:, None]
        at = np.cumsum(gap, 1) + time[:, None]
        level = low_[:, None] + (((b >> _U(40)) * size[:, None].astype(_U)) >> _U(24)).astype(np.int64)
        slot = doc[:, None] * m + ((b & _U(0xFFFFFFFF)) * _U(m) >> _U(32)).astype(np.int64)
        use = (level < top[:, None]) & (at < best[slot])
        s, t, v = slot[use], at[use], (a[use] >> _U(32)).astype(np.uint32)
        np.minimum.at(best, s, t)
        won = best[s] == t
        value[s[won]] = v[won]
        time = at[:, -1]
        drawn += batch
        alive = time < best.reshape(n, m).max(1)[doc]
        key, doc, top, size, low_, time = key[alive], doc[alive], top[alive], size[alive], low_[alive], time[alive]
    return value.reshape(n, m)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two multisets as (sorted elements, counts)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    common = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(common / max(1, a[1].sum() + b[1].sum() - common))


def _bags(column: pa.Array, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    text, element, count = shingles(Words(*texts_of(column)), k)
    cuts = np.searchsorted(text, np.arange(len(column) + 1))
    return [(element[i:j], count[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def signatures(documents: DataFrame, bands: int = 24, rows: int = 6, k: int = 5) -> DataFrame:
    """doc_id, w1 and w2 (a 128-bit hash of the words, null without words) and the band keys."""
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lanes = hash_keys(77, rows), np.arange(bands, dtype=_U) * _GOLDEN
        for part in slices(batches):
            words = Words(*texts_of(part.column(1)))
            value = bag_minhash(*shingles(words, k), part.num_rows, m)
            band = mix((value.reshape(-1, bands, rows).astype(_U) * keys).sum(2) + lanes).view(np.int64)
            none = words.counts == 0
            one, two = (h.view(np.int64) for h in words.text_hash())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(one, mask=none), pa.array(two, mask=none), pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(band.ravel()))],
                names=["doc_id", "w1", "w2", "bands"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, w1 long, w2 long, bands array<long>")


def _packed(documents: DataFrame) -> DataFrame:
    """doc_id and the text, compressed: what comparing pairs moves about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for part in batches:
            packed = [squeeze.compress((t or "").encode()) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])
            give_back()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, packed binary")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (a, b) whose multisets' weighted Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                part = whole.slice(at, 128)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                where: dict[int, int] = {}
                raw: list[bytes] = []
                for ids, column in ((a, part.column(2)), (b, part.column(3))):
                    for i, x in zip(ids, column, strict=True):
                        if i not in where:
                            where[i] = len(raw)
                            raw.append(open_(x.as_py()))
                bags = _bags(pa.array(raw, pa.binary()).cast(pa.string()), k)
                hit = [i for i in range(len(a)) if weighted_jaccard(bags[where[a[i]]], bags[where[b[i]]]) >= threshold]
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in hit], pa.int64()), pa.array([b[i] for i in hit], pa.int64())], names=["a", "b"])
            give_back()

    left = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("pa"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("pb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


def _common(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sizes of the intersections of all pairs of multisets, by products of 0/1 matrices of (element, level)."""
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    element, count = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    row = np.repeat(np.arange(len(element)), count)
    level = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    _, column, times = np.unique(mix(element[row] + level.astype(_U) * _GOLDEN), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    column, owner = place[column[use]], owner[row][use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(bags), len(bags)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [at, at + 4096])
        hold = np.zeros((len(bags), 4096), np.float32)
        hold[owner[i:j], column[i:j] - at] = 1
        out += hold @ hold.T
    return out


def _links_across(rows: pa.Table, threshold: float, k: int) -> pa.Table:
    """Links between members of different components, of each pair of blocks in rows.

    A pair is looked at in the first band it shares, and no more than a spanning forest of
    the links of a unit is sent.
    """
    rows = rows.sort_by([("key", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("rep", "ascending")])
    unit = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("key", "lo", "hi")])
    cuts = np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(0)) + 1
    ids, label, block = rows["rep"].to_numpy(), rows["label"].to_numpy(), rows["block"].to_numpy()
    bands = np.stack(rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
    packed = rows["packed"].combine_chunks()
    open_ = zstandard.ZstdDecompressor().decompress
    found: list[tuple[int, int]] = []
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
        key, lo, hi = unit[:, s]
        lane = int(np.flatnonzero((bands[s] == key))[0])
        want = (label[s:e, None] != label[None, s:e]) & (block[s:e, None] == lo) & (block[None, s:e] == hi)
        for t in range(lane):
            want &= bands[s:e, t, None] != bands[None, s:e, t]
        need = np.flatnonzero(want.any(0) | want.any(1))
        if not len(need):
            continue
        bags = _bags(pa.array([open_(packed[s + int(i)].as_py()) for i in need], pa.binary()).cast(pa.string()), k)
        size = np.array([b[1].sum() for b in bags], np.float64)
        common = _common(bags)
        i, j = np.nonzero(want[np.ix_(need, need)] & (common >= threshold * (size[:, None] + size[None, :] - common)))
        parent = list(range(len(need)))

        def root(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[ry] = rx
                found.append((int(ids[s + need[x]]), int(ids[s + need[y]])))
    give_back()
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def near_duplicates(documents: DataFrame, threshold: float = 0.8, k: int = 5, bands: int = 24, rows: int = 6) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its group) and kept (doc_id = class_id) for every row.

    A pair at similarity 0.8 shares a bucket with a chance over 0.999.  Null and empty
    texts, and texts of white space, are in no group but their own; a text of fewer than
    five words is one shingle.  Rows with a null doc_id stay alone, with a null class and
    kept.  Rows of one doc_id with the same words are one document; with other words,
    each row is judged by its own text.  An empty table gives an empty one.
    """
    sig = cut(signatures(documents, bands, rows, k))
    usable = sig.where("w1 is not null and doc_id is not null")
    unlike = usable.groupBy("doc_id").agg(F.min("w1").alias("x"), F.max("w1").alias("y"), F.min("w2").alias("v"), F.max("w2").alias("w")).where("x <> y or v <> w")
    if not unlike.isEmpty():
        return _by_text(documents, threshold, k, bands, rows)
    reps = cut(usable.groupBy("w1", "w2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    entries = reps.select("rep", F.explode("bands").alias("key"))
    stats = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("c > 1").drop("c")
    members = cut(entries.join(stats, "key").select("key", "rep", "lo", "hi"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tested = cut(members.select("rep", F.explode(F.array("lo", "hi")).alias("leader")).where("rep <> leader").select(*pair(F.col("rep"), F.col("leader"))).distinct())
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = cut(_packed(documents.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    edges = cut(_verified(tested, texts, threshold, k))
    labels = components(edges)
    # buckets that still hold several components: every pair across them, block by block
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c")).where("x < y and c > 2").select("key", F.ceil(F.col("c") / _BLOCK).cast("int").alias("nb"))
    placed = named.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    units = placed.select("key", "rep", "label", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    units = cut(units)
    tasks = max(1, units.count() // _TASK_ROWS)
    full = units.join(reps.select("rep", "bands"), "rep").join(texts.select(F.col("doc_id").alias("rep"), "packed"), "rep").withColumn("p", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(tasks)))

    def compare(rows: pa.Table) -> pa.Table:
        return _links_across(rows, threshold, k)

    more = cut(full.select("p", "key", "lo", "hi", "block", "rep", "label", "bands", "packed").groupBy("p").applyInArrow(compare, "a long, b long"))
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    classes = reps.select("w1", "w2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("w1", "w2", F.coalesce("component", "rep").alias("class_id"))
    out = sig.select("doc_id", "w1", "w2").join(classes, ["w1", "w2"], "left")
    cls = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", cls.alias("class_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _by_text(documents: DataFrame, threshold: float, k: int, bands: int, rows: int) -> DataFrame:
    """near_duplicates of a table in which some doc_id has texts of other words: each (doc_id, text) gets a number of its own."""
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.lit(1), "text"))
    key = ["doc_id", "a", "b"]
    # numbers are in the order of doc_id, so a class's smallest number has its smallest doc_id
    numbers = cut(named.where("doc_id is not null").select(*key).distinct().repartitionByRange(*key).sortWithinPartitions(*key).withColumn("n", F.monotonically_increasing_id()))
    one = named.join(numbers, key).groupBy("n").agg(F.first("text").alias("text"))
    found = cut(near_duplicates(one.withColumnRenamed("n", "doc_id"), threshold, k, bands, rows).select(F.col("doc_id").alias("n"), F.col("class_id").alias("cn")))
    classes = numbers.join(found, "n").join(numbers.select(F.col("n").alias("cn"), F.col("doc_id").alias("class_id")), "cn").select(*key, "class_id")
    return named.join(classes, key, "left").select("doc_id", "class_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
