"""Toxicity scoring: a linear classifier on character n-grams scaled by naive Bayes.

Features are the n-grams of the lower-cased text's characters (code points), present or
absent, hashed into a table.  Each is scaled by its naive Bayes log-count ratio between the two classes;
a logistic regression on the scaled features gives the weights.  Learning uses a
bounded sample of labelled rows (``sample_rows``, ``sample_bytes``: those of smallest
hash); scoring reads every whole text and needs only the weight table, whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, DoubleType, IntegerType

from grafita.llm.common import cut, quoted, set_aside
from grafita.llm.textkit import slices, texts_of

#: Lower case of each code point that has one of a single code point; beyond the second plane none has.
_LOWER = np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x20000)], np.uint32)
_U = np.uint64
_SLICE = 1 << 19


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of UTF-8 texts, and the offsets of the texts among them."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[starts].astype(np.uint32)
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    point = np.where(size == 1, lead, lead & (0xFF >> (size + 1)))
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        at = np.minimum(starts[more] + k, len(data) - 1)
        point[more] = point[more] << 6 | (data[at] & 0x3F)
    low = point < len(_LOWER)
    point[low] = _LOWER[point[low]]
    return point, np.searchsorted(starts, offsets)


@dataclass(frozen=True)
class NgramSpace:
    """Lengths of the n-grams and bits of the table they are hashed into."""

    lengths: tuple[int, ...] = (3, 5)
    bits: int = 20

    def features(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: the slot of the n-gram at each character, and the index of its text."""
        low, offsets = characters(data, offsets)
        low = low.astype(_U) + _U(1)
        owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        for n in self.lengths:
            if len(low) < n:
                continue
            value = low[: len(low) - n + 1].copy()
            for j in range(1, n):
                value = value * _U(0x100000001B3) + low[j : len(low) - n + 1 + j]
            whole = owner[: len(value)] == owner[n - 1 :]
            slot = ((value * _U(0x9E3779B97F4A7C15) + _U(n)) >> _U(64 - self.bits)).astype(np.int32)
            yield slot[whole], owner[: len(value)][whole]

    def present(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, slot) pairs; keep: mask of the slots that count."""
        pairs = []
        for slot, owner in self.features(data, offsets):
            if keep is not None:
                use = keep[slot]
                slot, owner = slot[use], owner[use]
            pairs.append(np.unique((owner.astype(np.int64) << self.bits) | slot))
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return both >> self.bits, both & ((1 << self.bits) - 1)


@dataclass
class ToxicityModel:
    space: NgramSpace
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, slot = self.space.present(data, offsets, self.weights != 0)
        total = np.bincount(doc, self.weights[slot], minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _slices_of(texts: Sequence[str] | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of slices of bounded size."""
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.large_string())
    at = 0
    for part in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), limit=_SLICE):
        yield at, *texts_of(part.column(0))
        at += part.num_rows


def fit(texts: Sequence[str] | pa.ChunkedArray, toxic: np.ndarray, space: NgramSpace = NgramSpace(), features: int = 1 << 14, l2: float = 1e-3, rounds: int = 150) -> ToxicityModel:
    """Learns from texts and 0/1 labels.  One class only, or no rows: scores are that constant share.

    The ``features`` slots whose naive Bayes ratio tells most (absolute ratio times the
    root of the rows that have the slot) take part; Adam minimises the log loss.  The
    texts are read twice, slice by slice: once for the counts, once for the chosen
    slots, which are all that is kept.
    """
    size = 1 << space.bits
    toxic = np.asarray(toxic, float)
    if not len(texts) or toxic.min() == toxic.max():
        share = 0.5 if not len(texts) else float(np.clip(toxic.mean(), 0.01, 0.99))
        return ToxicityModel(space, np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    counts = np.zeros((2, size), np.int32)
    for at, data, offsets in _slices_of(texts):
        doc, slot = space.present(data, offsets)
        for label in (0, 1):
            counts[label] += np.bincount(slot[toxic[doc + at] == label], minlength=size).astype(np.int32)
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    seen = np.flatnonzero(counts.sum(0) >= 3)
    counts = counts[:, seen]
    rate = (counts + 1) / (n[:, None] + 2)
    ratio = np.log(rate[1] / rate[0])
    told = np.abs(ratio) * np.sqrt(counts.sum(0))
    best = np.argsort(-told, kind="stable")[:features]
    best = best[told[best] > 0]
    chosen, scale = seen[best], ratio[best]
    column = np.full(size, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    blocks = []
    for at, data, offsets in _slices_of(texts):
        doc, slot = space.present(data, offsets, column >= 0)
        blocks.append((slice(at, at + len(offsets) - 1), doc.astype(np.min_scalar_type(len(offsets))), column[slot].astype(np.min_scalar_type(len(chosen)))))
    weight, bias = np.zeros(len(chosen)), float(np.log(n[1] / n[0]))
    first, second, step = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0.02
    balance = np.where(toxic == 1, min(n[0] / n[1], 4.0), 1.0)
    balance /= balance.sum()
    for t in range(1, rounds + 1):
        scaled, pull, lean = weight * scale, np.zeros(len(chosen)), 0.0
        for span, rows, cols in blocks:
            z = np.bincount(rows, scaled[cols], minlength=span.stop - span.start) + bias
            gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic[span]) * balance[span]
            pull += np.bincount(cols, gap[rows], minlength=len(chosen))
            lean += gap.sum()
        grad = np.append(pull * scale + l2 * weight, lean)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        move = step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        weight -= move[:-1]
        bias -= move[-1]
    table = np.zeros(size, np.float32)
    table[chosen] = weight * scale
    return ToxicityModel(space, table, float(bias))


def fit_from_tables(documents: DataFrame, labels: DataFrame, sample_rows: int = 6000, sample_bytes: int = 96 << 20, space: NgramSpace = NgramSpace()) -> ToxicityModel:
    """Fits on labelled rows whose crc32(doc_id as text) mod 5 is not 0: at most ``sample_rows``, of ``sample_bytes`` in all.

    The rows of smallest hash of doc_id are taken, as far as their texts come to
    sample_bytes together; texts of over a sixteenth of that are passed over.  Rows with
    a null id or label are left out; an id labelled twice counts as toxic if either label
    says so, and of an id with several texts the smallest is read.
    """
    known = labels.where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    ids = known.agg(F.approx_count_distinct("doc_id")).first()[0]
    # about twice the rows wanted pass this test, so a task sends few whatever the number of tasks
    share = min(1.0, 2.5 * sample_rows / max(1, ids)) if ids > 4 * sample_rows else 1.0
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    few = known.where(draw <= int(share * (1 << 40))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(draw, "doc_id").limit(sample_rows)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= sample_bytes // 16)
    sample = cut(texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    # at most sample_rows rows, each an id and a size: one task adds the sizes up, without the texts
    so_far = F.sum("bytes").over(Window.orderBy(draw, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sample.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).withColumn("so_far", so_far)
    fitting = sizes.where(F.col("so_far") <= sample_bytes).select("doc_id")
    got = sample.join(F.broadcast(fitting), "doc_id").orderBy("doc_id").select("text", "toxic").toArrow()
    return fit(got["text"], got["toxic"].to_numpy(), space)


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5) to every row.

    A null text counts as empty.  Equal texts have equal scores, repeated rows stay
    repeated, columns of the two names are replaced, an empty table gives an empty one.
    """
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast(model)  # a table of fixed size
    rows, back = set_aside(documents.select(*[F.col(quoted(n)) for n in documents.columns if n not in ("score", "predicted")]), "text")
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType(), False), StructField("predicted", IntegerType(), False)])
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=_SLICE):
            p = shared.value.scores(*texts_of(part.column(at)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, schema).select(*back, "score", "predicted")
