"""Removing passages that repeat, by repeated-phrase automata.

Documents are dealt into shards of bounded size, as compressed Arrow blobs.

1. Confirm.  A shard sends the distinct hashes of its windows of ``window`` words, in
   sorted packets, to buckets; a bucket answers with one bit a hash: does the window
   start anywhere else?  Hashes are of 64 bits, and the bucket is chosen by a second,
   independent hash, so false recurrence stays rare as the input grows.
2. Compile.  Runs of confirmed windows are the shard's recurring passages.  Each becomes
   a pattern of an Aho-Corasick automaton whose letters are words (a word is mapped to
   one code point), so a shard has its own automaton of bounded size.
3. Stream.  All the shard's documents are read by it; every occurrence is checked by
   the hash of its words, and the words it covers are removed.

A frequent passage sends at most one entry a shard to its bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from grafita.llm.common import quoted, set_aside
from grafita.llm.textkit import Words, give_back, mix, slices, texts_of

_U = np.uint64
_SECOND = 0x6A09E667F3BCC909
_SHARD_BYTES = 6 << 20
_BUCKET_WINDOWS = 1 << 19


def _squeeze(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: differences, byte planes apart, compressed."""
    gaps = np.diff(x, prepend=_U(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unsqueeze(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(_U).ravel(), dtype=_U)


def _blobs(documents: DataFrame, shards: int) -> DataFrame:
    """(shard, part, blob): whole rows of documents, dealt by a hash of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, limit=8 << 20):
            _, offsets = texts_of(part.column("text"))
            ids = part.column("doc_id").cast(pa.int64())
            # rows without an id are dealt by their length and place
            key = np.where(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), offsets[1:] + (1 << 40)).astype(np.int64).view(_U)
            shard = (mix(key + _U(99)) % _U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            names, blobs = [], []
            for s in np.unique(shard):
                rows = part.take(pa.array(order[cuts[s] : cuts[s + 1]]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                names.append(int(s))
                blobs.append(squeeze.compress(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    return documents.mapInArrow(run, "shard long, blob binary")


def _rows(blobs: pa.ChunkedArray) -> list[pa.RecordBatch]:
    """A shard's rows, in an order that does not depend on how its blobs arrived."""
    out = []
    for blob in sorted(b.as_py() for b in blobs):
        out += list(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)))
    return list(slices(iter(out)))


def _windows(parts: list[pa.RecordBatch], window: int, buckets: int) -> tuple[list[Words], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: its words; the sorted distinct windows with their buckets and counts; for each window, which it is."""
    words, first, second = [], [np.zeros(0, _U)], [np.zeros(0, _U)]
    for part in parts:
        w = Words(*texts_of(part.column("text")))
        ok = w.run_starts(window)
        words.append(w)
        first.append(w.rolling_hash(window)[ok])
        second.append(w.rolling_hash(window, _SECOND)[ok])
    one = np.concatenate(first)
    bucket = (np.concatenate(second) % _U(buckets)).astype(np.int64)
    distinct, at, inverse, count = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
    return words, distinct, bucket[at], count, inverse


def _covered(words: list[Words], repeated: np.ndarray, window: int) -> list[np.ndarray]:
    """For each part the mask of its words that lie in a repeated window, located by the shard's automaton."""
    at, spans = 0, []
    for w in words:
        ok = w.run_starts(window)
        hit = np.zeros(len(ok) + 2, np.int8)
        hit[1:-1][ok] = repeated[at : at + ok.sum()]
        at += int(ok.sum())
        # a run of repeated windows ends where the text ends, too
        text = w.text_of_words()[: len(ok)]
        step = np.diff(hit)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(ok):
            broken = np.flatnonzero((hit[1:-2] == 1) & (hit[2:-1] == 1) & (text[1:] != text[:-1])) + 1
            start, end = np.sort(np.concatenate([start, broken])), np.sort(np.concatenate([end, broken]))
        spans.append((start, end + window - 1))
    letters = [((w.hash >> _U(44)).astype(np.uint32) % np.uint32(0x100000) + np.uint32(0x10000)).astype("<u4") for w in words]
    totals = [w.prefix() for w in words]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    known: dict[tuple[str, int], None] = {}
    for w, letter, total, (start, end) in zip(words, letters, totals, spans, strict=True):
        digest = w.span_hash(total, start, end).tolist()
        for s, e, d in zip(start.tolist(), end.tolist(), digest, strict=True):
            known[letter[s:e].tobytes().decode("utf-32-le"), d] = None
    values: dict[str, list[int]] = {}
    for passage, d in known:
        values.setdefault(passage, []).append(d)
    for passage, digests in values.items():
        automaton.add_word(passage, (len(passage), tuple(digests)))
    if values:
        automaton.make_automaton()
    out = []
    for w, letter, total in zip(words, letters, totals, strict=True):
        ends, lengths, wants, texts = [], [], [], []
        if values:
            for i in range(w.n):
                a, b = int(w.first[i]), int(w.first[i + 1])
                if b - a >= window:
                    for end, (length, digests) in automaton.iter(letter[a:b].tobytes().decode("utf-32-le")):
                        ends.append(a + end + 1)
                        lengths.append(length)
                        wants.append(digests[0])
                        texts.append(digests)
        cover = np.zeros(len(w.hash) + 1, np.int64)
        if ends:
            e = np.array(ends)
            s = e - np.array(lengths)
            digest = w.span_hash(total, s, e)
            true = digest == np.array(wants, _U)
            for k in np.flatnonzero(~true):  # passages that share their letters
                true[k] = int(digest[k]) in texts[k]
            np.add.at(cover, s[true], 1)
            np.add.at(cover, e[true], -1)
        out.append(np.cumsum(cover)[:-1] > 0)
    return out


def _kept_bytes(w: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the kept words of each text, joined by one space."""
    start, end = w.start[kept], w.end[kept]
    owner = w.text_of_words()[kept]
    more = np.zeros(len(start), bool)
    if len(start):
        more[:-1] = owner[1:] == owner[:-1]
    size = (end - start) + more
    data = w.data.copy()
    data[end[more]] = 0x20
    step = np.zeros(len(data) + 2, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end + more, -1)
    per_text = np.bincount(owner, size, w.n).astype(np.int64) if len(start) else np.zeros(w.n, np.int64)
    return data[np.cumsum(step)[: len(data)] > 0], np.concatenate([[0], np.cumsum(per_text)])


def remove_repeats(documents: DataFrame, window: int = 35) -> DataFrame:
    """Every row of documents, with what is left of its text.

    Adds n_words, n_removed, kept_text (words joined by one space) and kept_sha256.  A word
    goes if it lies in ``window`` consecutive words of its document that also start
    anywhere else, in the same document or another; repeated rows count as other
    documents.  A null text has no words.  Texts shorter than the window keep all.
    Columns of those four names are replaced; an empty table gives an empty table.
    """
    documents, back = set_aside(documents.select(*[F.col(quoted(n)) for n in documents.columns if n not in ("n_words", "n_removed", "kept_text", "kept_sha256")]), "doc_id", "text")
    names = documents.columns
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // _SHARD_BYTES))
    buckets = max(1, -(-size // (6 * _BUCKET_WINDOWS)))
    blobs = _blobs(documents, shards)

    def send(key: tuple, blobs: pa.Table) -> pa.Table:
        _, distinct, bucket, count, _ = _windows(_rows(blobs["blob"]), window, buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        to, packets, twice = [], [], []
        for b in np.unique(bucket):
            mine = order[cuts[b] : cuts[b + 1]]
            to.append(int(b))
            packets.append(_squeeze(distinct[mine]))
            twice.append(np.packbits(count[mine] > 1).tobytes())
        return pa.table({"bucket": pa.array(to, pa.int64()), "shard": pa.array([key[0].as_py()] * len(to), pa.int64()), "packet": pa.array(packets, pa.binary()), "twice": pa.array(twice, pa.binary())})

    def answer(key: tuple, packets: pa.Table) -> pa.Table:
        lists = [_unsqueeze(p.as_py()) for p in packets["packet"]]
        every = np.concatenate(lists)
        own = np.concatenate([np.unpackbits(np.frombuffer(t.as_py(), np.uint8), count=len(x)) for t, x in zip(packets["twice"], lists, strict=True)])
        order = np.argsort(every, kind="stable")
        run = every[order]
        fresh = np.concatenate([[True], run[1:] != run[:-1]])
        group = np.cumsum(fresh) - 1
        times = np.bincount(group, 1 + own[order])
        repeated = np.zeros(len(every), bool)
        repeated[order] = times[group] > 1
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(repeated, cuts)]
        return pa.table({"shard": packets["shard"], "bucket": packets["bucket"], "bits": pa.array(bits, pa.binary())})

    def finish(key: tuple, blobs: pa.Table, answers: pa.Table) -> pa.Table:
        parts = _rows(blobs["blob"])
        words, distinct, bucket, _, inverse = _windows(parts, window, buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        repeated = np.zeros(len(distinct), bool)
        for b, bits in zip(answers["bucket"].to_pylist(), answers["bits"], strict=True):
            mine = order[cuts[b] : cuts[b + 1]]
            repeated[mine] = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(mine)).astype(bool)
        out = []
        for part, w, gone in zip(parts, words, _covered(words, repeated[inverse], window), strict=True):
            data, offsets = _kept_bytes(w, ~gone)
            raw = data.tobytes()
            digest = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            removed = np.bincount(w.text_of_words(), gone, w.n).astype(np.int64) if len(gone) else np.zeros(w.n, np.int64)
            text = pa.LargeStringArray.from_buffers(w.n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))
            columns = [part.column(n) for n in names]
            out.append(pa.RecordBatch.from_arrays([*columns, pa.array(w.counts.astype(np.int64)), pa.array(removed), text.cast(pa.string()), pa.array(digest, pa.string())], names=[*names, "n_words", "n_removed", "kept_text", "kept_sha256"]))
        give_back()
        return pa.Table.from_batches(out)

    packets = blobs.groupBy("shard").applyInArrow(send, StructType([StructField("bucket", LongType()), StructField("shard", LongType()), StructField("packet", BinaryType()), StructField("twice", BinaryType())]))
    answers = packets.groupBy("bucket").applyInArrow(answer, "shard long, bucket long, bits binary")
    schema = StructType([*documents.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType()), StructField("kept_sha256", StringType())])
    return blobs.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(finish, schema).select(*back, "n_words", "n_removed", "kept_text", "kept_sha256")
