"""Exact counts of distinct keys whose rows are many and whose keys are long."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one bucket on average at most, and rows that a task packs at once.
BUCKET_ROWS, PACK_ROWS = 4_000_000, 1_000_000
_BLOBS = "name string, bucket int, n long, n_keys int, size int, keys binary"
_SCHEMA = pa.schema([("name", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("n_keys", pa.int32()), ("size", pa.int32()), ("keys", pa.binary())])


def _pack(rows: pa.Table) -> pa.RecordBatch:
    """A row for each name and bucket: its rows, and its keys without repeats in the order they come, compressed after their lengths."""
    names = rows["name"].combine_chunks().dictionary_encode("encode")
    code, bucket = names.indices.to_numpy(), rows["bucket"].combine_chunks().to_numpy()
    order = np.lexsort((bucket, code))
    code, bucket = code[order], bucket[order]
    keys = rows["key"].combine_chunks().cast(pa.binary()).take(pa.array(order))
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])])
    zstd, out = pa.Codec("zstd"), []
    for a, b in zip(first, [*first[1:], len(code)], strict=True):
        k = keys.slice(a, b - a).drop_null().unique()
        raw = b""
        if len(k):
            ends = np.frombuffer(k.buffers()[1], np.int32)[k.offset : k.offset + len(k) + 1]
            raw = np.diff(ends).tobytes() + memoryview(k.buffers()[2] or b"")[ends[0] : ends[-1]]
        out.append((names.dictionary[code[a]].as_py(), bucket[a], b - a, len(k), len(raw), zstd.compress(raw, asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= PACK_ROWS:
            yield _pack(pa.Table.from_batches(held))
            held = []
    if any(x.num_rows for x in held):
        yield _pack(pa.Table.from_batches(held))


def _unpack(n: int, size: int, blob: bytes) -> pa.Array:
    raw = pa.Codec("zstd").decompress(blob, size)
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.frombuffer(raw, np.int32, n) if n else [], out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), raw.slice(4 * n)])


def _counted(rows: pa.Table) -> pa.Table:
    """n and ids of one name's bucket."""
    keys = [_unpack(n, size, blob) for n, size, blob in zip(*(rows[c].to_pylist() for c in ("n_keys", "size", "keys")), strict=True)]
    return pa.table({"name": rows["name"][:1].combine_chunks(), "n": pa.array([pc.sum(rows["n"]).as_py()], pa.int64()), "ids": pa.array([pc.count_distinct(pa.chunked_array(keys, pa.binary())).as_py()], pa.int64())})


def counts(df: DataFrame, rows: int, name: str, *key: str) -> DataFrame:
    """name, n, ids: rows and distinct keys (without nulls) of each name, for about ``rows`` rows in all.

    Keys go to buckets by their hash, packed by the task that reads them, and are compared whole
    where they meet.  Keys that lie beside others like them, as in sorted files, take least.
    """
    k = [F.col(c).cast("string") for c in key]
    whole = F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in k[:-1]], k[-1])
    bucket = F.pmod(F.xxhash64(*k), F.lit(math.ceil(rows / BUCKET_ROWS) or 1)).cast("int")
    blobs = df.select(F.col(name).alias("name"), bucket.alias("bucket"), whole.alias("key")).mapInArrow(_packed, _BLOBS)
    return blobs.groupBy("name", "bucket").applyInArrow(_counted, "name string, n long, ids long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
