"""Importance resampling of documents towards a target, by hashed n-grams.

A document is scanned once, with its words joined by one space each, storing the running
CRC register after each byte.  The CRC-32 of any n-gram then follows from two of the
registers: the one at its start, shifted by as many zero bytes as the n-gram has (a linear
map over GF(2)), cancels all that came before.  The scan runs over many blocks at once;
the registers at their starts are chained by the same shift, in rounds that double.

Counts by bucket are summed in tasks and then by Spark; the only things sent out are the
gains, one number a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafita.llm.common import cut
from grafita.llm.textkit import slices, texts_of

_POLYNOMIAL, _ALL = 0xEDB88320, np.uint32(0xFFFFFFFF)
_BLOCK = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all of characters outside ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _one_byte() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


_STEP = _one_byte()


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map, given by its values for each of the four bytes of a register."""
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Maps for 0 .. _BLOCK - 1 zero bytes, and for 2**k of them."""
    few = np.empty((_BLOCK, 4, 256), np.uint32)
    few[0] = np.arange(256, dtype=np.uint32)[None] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for i in range(1, _BLOCK):
        few[i] = _STEP[few[i - 1] & 255] ^ few[i - 1] >> 8
    powers = np.empty((40, 4, 256), np.uint32)
    powers[0] = few[1]
    for k in range(1, 40):
        powers[k] = _apply(powers[k - 1], powers[k - 1])
    return few, powers


_FEW, _POWERS = _shifts()


def shift(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers c after n more zero bytes each."""
    low = n & (_BLOCK - 1)
    out = _FEW[low, 0, c & 255] ^ _FEW[low, 1, c >> 8 & 255] ^ _FEW[low, 2, c >> 16 & 255] ^ _FEW[low, 3, c >> 24]
    k, high = 8, n >> 8
    while high.any():
        at = np.flatnonzero(high & 1)
        out[at] = _apply(_POWERS[k], out[at])
        k, high = k + 1, high >> 1
    return out


class RunningCrc:
    """Registers after each byte of a stream, from 0 at its start."""

    def __init__(self, stream: np.ndarray):
        rows = -(-len(stream) // _BLOCK) + 1
        padded = np.zeros(rows * _BLOCK, np.uint8)
        padded[: len(stream)] = stream
        columns = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)
        self.inside = np.zeros((_BLOCK + 1, rows), np.uint32)
        c = self.inside[0]
        for j in range(_BLOCK):
            c = _STEP[(c ^ columns[j]) & 255] ^ c >> 8
            self.inside[j + 1] = c
        chained, k, d = c.copy(), 8, 1
        while d < rows:
            chained[d:] ^= _apply(_POWERS[k], chained[:-d])
            k, d = k + 1, d * 2
        self.begin = np.concatenate([np.zeros(1, np.uint32), chained[:-1]])

    def at(self, p: np.ndarray) -> np.ndarray:
        block, inside = p // _BLOCK, p % _BLOCK
        return shift(self.begin[block], inside) ^ self.inside[inside, block]

    def crc32(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of the bytes start:end, each from two registers."""
        return self.at(end) ^ shift(self.at(start) ^ _ALL, end - start) ^ _ALL


class Grams:
    """Words of n texts and the buckets of their n-grams."""

    def __init__(self, column: pa.Array):
        data, offsets = texts_of(column)
        size = len(data)
        word = np.zeros(size + 2, bool)
        word[1:-1] = _WORD[data]
        fresh = np.zeros(size + 1, bool)
        fresh[offsets] = True
        start = np.flatnonzero(word[1:-1] & (~word[:-2] | fresh[:-1]))
        end = np.flatnonzero(word[1:-1] & (~word[2:] | fresh[1:])) + 1
        self.first = np.searchsorted(start, offsets)
        self.words = np.diff(self.first)
        self.text = np.repeat(np.arange(len(column)), self.words)
        later = np.ones(len(start), bool)
        later[self.first[:-1][self.words > 0]] = False
        keep = word[1:-1].copy()
        keep[start[later] - 1] = True  # the last separator before a word stands for all of them
        place = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
        self.start, self.end = place[start], place[end]
        self.crc = RunningCrc(np.where(word[1:-1], _LOWER[data], np.uint8(32))[keep])

    def buckets(self, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and bucket of each run of k words."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return self.text[at], self.crc.crc32(self.start[at], self.end[at + k - 1]).astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int, longest: int, text: str = "text") -> DataFrame:
    """bucket and n: features of all texts in it.  A task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, "text"):
            grams = Grams(part.column("text"))
            for k in range(1, longest + 1):
                total += np.bincount(grams.buckets(k, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, text: str = "text") -> DataFrame:
    """bucket and gain: 1000 times the log of its smoothed share in target over that in documents, floored."""
    s = bucket_counts(documents, buckets, longest, text).withColumnRenamed("n", "s")
    t = bucket_counts(target, buckets, longest, text).withColumnRenamed("n", "t")
    both = cut(documents.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0))
    whole = both.agg(F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))
    ratio = f"(cast(t + 1 as double) * cast(s_all + {buckets} as double)) / (cast(s + 1 as double) * cast(t_all + {buckets} as double))"
    return both.join(F.broadcast(whole)).select("bucket", F.expr(f"floor(1000 * ln({ratio}))").alias("gain"))


def weigh(documents: DataFrame, gains: np.ndarray, longest: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, n_words, n_features and weight (the floored mean gain of its features) of each row."""
    kind = documents.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            grams = Grams(part.column("text"))
            n, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for k in range(1, longest + 1):
                of, bucket = grams.buckets(k, len(gains))
                n += np.bincount(of, minlength=part.num_rows)
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(gains[bucket])])
                total += np.diff(sums[np.searchsorted(of, np.arange(part.num_rows + 1))])
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(grams.words), pa.array(n), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(work, f"id {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, per_partition: int = 1_000_000) -> DataFrame:
    """rows with ``rank``, from 1 in the given order, over all of them: sorted range by range, then counted before each range."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_partition))
    placed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n")).select("__p", before.alias("__before"))  # a row for each range
    inside = F.col("__at") - F.shiftleft(F.col("__p"), 33) + 1
    return placed.join(F.broadcast(sizes), part == F.col("__p")).withColumn("rank", (inside + F.col("__before")).cast("long")).drop("__at", "__p", "__before")


def resample(documents: DataFrame, target: DataFrame, share: int = 10, min_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Draws ``share`` percent of the documents of at least ``min_words`` words, likelier the more they resemble target.

    Returns a row for each row of documents: the key, n_features, weight, score (weight plus
    Gumbel noise that the key and seed settle) and rank, the place among those drawn, by
    falling score, then key; null for the rest.  A draw without replacement by the largest
    such scores takes documents with chances in proportion to exp(weight / 1000).  Null texts
    have no features and a weight of 0; a null key counts as an empty one and comes last among
    ties; equal rows are each drawn or not.  Other columns are left out.  Empty documents give
    no rows; an empty target leaves every gain to the smoothing.
    """
    documents = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = documents.schema["id"].dataType.simpleString()
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in bucket_gains(documents, target.select(F.col(f"`{text}`").alias("text")), buckets, longest).collect():  # one row a bucket
        gains[bucket] = gain
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # texts are read twice in all, by the counts and here
    rows = cut(weigh(documents, gains, longest, "id").withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("row", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= min_words
    # scores are whole numbers within the range of the gains and of the noise: tens of thousands of values, whatever the rows
    by_score = sorted(rows.where(fit).groupBy("score").count().collect(), key=lambda r: -r["score"])
    drawn = share * sum(r["count"] for r in by_score) // 100
    seen, least = 0, None
    for r in by_score:
        if seen >= drawn:
            break
        seen, least = seen + r["count"], r["score"]
    names = [F.col("id").alias(key), "n_features", "weight", "score"]
    if least is None:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    top = fit & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("id") if kind != "void" else F.asc("row"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    inside = ranked(rows.where(top), order).select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return inside.unionByName(rows.where(~top).select(*names, F.lit(None).cast("long").alias("rank")))
