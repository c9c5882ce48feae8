"""Packing documents into sequences of a fixed length by the sum-of-squares rule.

A document's pieces are placed one after another.  With N(h) the open sequences that
hold h tokens, a piece of length s goes where the sum of the squares of N after the
placement is smallest.  An open sequence that stays open changes the sum by
2 (N(h + s) - N(h)) + 2; a new sequence takes no square away, and a full one adds none,
so each of these is one less.  One placement costs one pass over at most ``capacity``
counters.

Work is dealt by a hash of the piece into groups of about ``group_pieces`` pieces, so
no group grows with the input; each leaves at most ``capacity`` levels of open
sequences, a share that does not depend on the size of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from grafita.llm.common import comparable, cut, quoted, set_aside
from grafita.llm.textkit import slices

Encoder = Callable[[list[str]], list[list[int]]]


def byte_bpe_encoder(vocabulary: str) -> Encoder:
    """Encoder for a byte-level BPE vocabulary in the JSON form of the tokenizers library.

    The merge ranks are read from that file and run by tiktoken, which gives the same
    ids several times faster.  That holds for a file of the plain kind alone (see
    ``_plain``); any other goes through tokenizers, and so do texts in which one of the
    file's special tokens is spelled out, as its default treats them specially.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    if not _plain(spec, special):
        return lambda texts: [exact.encode(t, add_special_tokens=False).ids for t in texts]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    # fixed value: the pattern of the byte-level pre-tokeniser, which files name without spelling it out
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [exact.encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]

    return encode


def _plain(spec: dict, special: list[str]) -> bool:
    """Whether a vocabulary file asks for byte-level BPE alone: no normaliser, the usual split, ids in the order of merges."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return False
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    letters = {t for t in model["vocab"] if len(t) == 1}
    ids = [model["vocab"][t] for t in merged]
    return len(letters) == 256 and ids == sorted(set(ids)) and set(model["vocab"]) == letters | set(merged) | (set(special) & set(model["vocab"])) and max(model["vocab"][t] for t in letters) < min(ids)


def tokenize_pieces(documents: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its text's ids and then ``end_id``; a null text is empty.  Documents
    longer than ``capacity`` are cut into pieces of that length, of which the first may
    be shorter.  Repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe_encoder(vocabulary)
        for part in slices(batches, limit=1 << 20):
            texts = part.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in texts]), strict=True):
                ids.append(end_id)
                whole = np.array(ids, "<u4")
                start, piece = 0, 0
                step = len(ids) % capacity or capacity
                while start < len(ids):
                    cut = whole[start : start + step]
                    for column, value in zip(out, (doc, piece, start, len(cut), zlib.crc32(cut.tobytes()), cut if with_ids else None), strict=True):
                        column.append(value)
                    start, piece, step = start + step, piece + 1, capacity
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(out[5], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class SumOfSquares:
    """Open sequences by level; ``place`` puts one piece and tells its sequence and offset."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # [0] and [capacity] stay 0: new and full ones aren't open
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        top = self.capacity - size
        gain = 2 * (self.count[size:] - self.count[: top + 1])
        gain[1:][self.count[1 : top + 1] == 0] = 1 << 40
        gain[0] -= 1  # a new sequence takes no square away
        gain[-1] -= 1  # a full one adds none
        # ties: the fullest level, so that a sequence closes rather than a new one opens
        level = top - int(np.argmin(gain[::-1]))
        if level == 0:
            sequence = self.made
            self.made += 1
        else:
            sequence = self.open[level].pop()
            self.count[level] -= 1
        if level + size < self.capacity:
            self.open[level + size].append(sequence)
            self.count[level + size] += 1
        return sequence, level


def pack(pieces: DataFrame, capacity: int = 1024, group_pieces: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to ``capacity``.

    Within a group the longest pieces come first; ties are broken by all columns'
    hash, so a lost task gives the same sequences again.  Full-length pieces fill a
    sequence alone.  Lengths outside the range are an error.  Repeated rows each take a
    place; columns of the two names are replaced.  An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces, back = set_aside(pieces.select(*[F.col(quoted(n)) for n in pieces.columns if n not in ("sequence_id", "offset")]), "doc_id", "piece", "length")
    pieces = cut(pieces)  # tokenising is the dear part: once, not once for the count and once more
    rows = pieces.count()
    groups = max(1, round(rows / group_pieces))
    names = pieces.columns
    # an integer key of known bounds: group g is dealt by range, so each task holds whole groups
    keyed = pieces.withColumn("__h", F.xxhash64(*comparable(pieces))).withColumn("__g", F.pmod(F.col("__h"), F.lit(groups)).cast("int"))
    dealt = keyed.repartition(max(groups, min(2 * groups, int(spark.conf.get("spark.sql.shuffle.partitions")))), "__g").sortWithinPartitions("__g", F.desc("length"), "__h", *[n for n in ("doc_id", "piece") if n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rule = None, SumOfSquares(capacity)
        for part in batches:
            length = part.column(part.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            of = part.column(part.schema.get_field_index("__g")).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for i, (g, size) in enumerate(zip(of.tolist(), length.tolist(), strict=True)):
                if g != group:
                    group, rule = g, SumOfSquares(capacity)
                if not 0 < size <= capacity:
                    raise ValueError(f"a piece of {size} tokens can't go into {capacity}")
                sequence[i], offset[i] = rule.place(size)
                sequence[i] += g << 40
            columns = [part.column(part.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return dealt.mapInArrow(run, schema).select(*back, "sequence_id", "offset")
