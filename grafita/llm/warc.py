"""Writing WARC archives, and reading them back by boundary-chain verification.

Archives are written by Spark's text writer: a record is a line, the record separator
the line end.  They are read by Spark's text reader with the version line as line end,
so large files are read in splits, in parallel, from any store Spark knows.

The version line may also stand inside a payload.  A task therefore emits, for every
place where it stands, a candidate record with the offset of its successor: the end of
the block that its Content-Length tells.  True records are those that the chain from the
start of the file reaches.  A task follows chains inside its split; between splits they
are followed by pointer jumping, so the rounds grow with the log of a file's splits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafita.llm.common import BROADCAST_ROWS, cut
from grafita.llm.textkit import give_back

MAGIC = b"WARC/1.0\r\n"
_END = b"\r\n\r\n"


def payload_digest(payload: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(payloads: DataFrame, key: str = "page_id", least_bytes: int = 0) -> DataFrame:
    """payloads (key, payload_digest, payload_bytes) with refers_to: for a repeated payload the smallest key.

    Payloads of fewer than ``least_bytes`` bytes refer to none; nor do rows without a key.
    """
    heads = payloads.where(F.col(key).isNotNull() & (F.col("payload_bytes") >= least_bytes)).groupBy("payload_digest").agg(F.min(key).alias("head"), F.count("*").alias("c")).where("c > 1").select(F.col("payload_digest").alias("d"), "head")
    joined = payloads.join(heads, F.col("payload_digest") == F.col("d"), "left")
    refers = F.when((F.col("payload_bytes") >= least_bytes) & (F.col(key) > F.col("head")), F.col("head"))
    return joined.withColumn("refers_to", refers).drop("d", "head")


def write_warc(records: DataFrame, path: str, compression: str | None = None) -> None:
    """Writes records (id long, uri string, payload binary, payload_digest, refers_to long) as WARC files.

    A row with refers_to is a revisit record without payload; others are response records.
    Null payloads are empty, null uris are left out.  One file a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for key, uri, payload, digest, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                body = b"" if refers is not None else payload or b""
                head = [f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(body)}"]
                if key is not None:
                    head.append(f"WARC-Record-ID: <urn:row:{key}>")
                if refers is not None:
                    head += [f"WARC-Refers-To: <urn:row:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
                if uri is not None:
                    # no line of the head may end like a version line
                    head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", uri) + " " * uri.endswith("WARC/1.0"))
                out.append(MAGIC + "\r\n".join(head).encode("utf-8", "replace") + _END + body)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows = records.select("id", "uri", "payload", "payload_digest", "refers_to").mapInArrow(run, "record binary")
    # a string column may hold any bytes; the text writer writes them as they are
    writer = rows.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", _END.decode())
    (writer.option("compression", compression) if compression else writer).text(path)


def _head(data: bytes, start: int = 0, stop: int | None = None) -> tuple[dict[str, str], int] | None:
    """Headers of a candidate in data[start:stop] (what follows its version line), and where its body starts."""
    end = data.find(_END, start, stop)
    if end < 0:
        return None
    fields = {}
    for line in data[start:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    # a length of more than 18 digits is no length: what follows would lie beyond any file
    return (fields, end + 4) if re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")) else None


def _row_number(name: str) -> int | None:
    """The 64-bit number of a record id or reference as this writer gives them, else None."""
    m = re.fullmatch(r"<urn:row:(-?[0-9]{1,19})>", name)
    return n if m and -(2**63) <= (n := int(m[1])) < 2**63 else None


_CANDIDATE = "file string, block long, at long, next long, exit long, type string, id long, uri string, refers_to long, digest string, length long, sha1 string, payload binary, total long"


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between version lines, in file order within a partition, with its file and split."""
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _candidates(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """A row per candidate record; at, next and exit count from the split's first segment.

    exit is where the chain from the candidate leaves the split, or null if it breaks.  A
    candidate whose block runs on past the segments of its split has no digest (sha1 null),
    nor has one that would bring what is hashed to over twice the split's size: it is read
    again if it proves to be a record.  The last row of a split has total, its bytes.
    """

    def flush(file: str, block: int, data: bytes, base: list[int]) -> pa.RecordBatch:
        # data: the split's bytes with its version lines; base: where its segments begin.
        # Segment i > 0 starts after a version line; segment 0 of a later split does too.
        rows: list[dict] = []
        place = {}
        view = memoryview(data)
        # payloads may hold records, and those again: what may be hashed beforehand is bounded by the split's size
        hashed, most = 0, 2 * len(data) + (1 << 20)
        for i in range(0 if block else 1, len(base)):
            stop = base[i + 1] - len(MAGIC) if i + 1 < len(base) else len(data)
            got = _head(data, base[i], stop)
            if got is None:
                continue
            fields, body = got
            length = int(fields["content-length"])
            whole = len(data) - body >= length + 2
            # the last record of a file may end without the blank lines
            if whole and data[body + length : body + length + 4] not in (_END, _END[:2], b""):
                continue
            at = base[i] - len(MAGIC)
            place[at] = len(rows)
            hashed += length if whole else 0
            known = whole and (hashed <= most or length < 1 << 10)
            payload = view[body : body + length] if known else b""
            rows.append({
                "file": file, "block": block, "at": at, "next": body + length + 4, "exit": None, "type": fields.get("warc-type"), "id": _row_number(fields.get("warc-record-id", "")),
                "uri": fields.get("warc-target-uri"), "refers_to": _row_number(fields.get("warc-refers-to", "")), "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                "length": length, "sha1": payload_digest(payload) if known else None, "payload": bytes(payload) if payloads and known else None, "total": None,
            })
        end = len(data)
        for row in reversed(rows):
            nxt = row["next"]
            row["exit"] = rows[place[nxt]]["exit"] if nxt in place else nxt if nxt >= end else None
        rows.append(dict.fromkeys(rows[0] if rows else [c.split()[0] for c in _CANDIDATE.split(", ")]) | {"file": file, "block": block, "total": len(data) + len(MAGIC)})
        return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, data, base = None, bytearray(), []
        for part in batches:
            for value, file, block in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if (file, block) != key:
                    if key is not None:
                        yield flush(*key, bytes(data), base)
                    key, data, base = (file, block), bytearray(), []
                elif base:
                    data += MAGIC
                base.append(len(data))
                data += value
        if key is not None:
            yield flush(*key, bytes(data), base)
        give_back()

    return _segments(spark, path).mapInArrow(run, _CANDIDATE)


_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _CANDIDATE.split(", "))])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The true records under path: file, offset, type, id, uri, refers_to, digest, length, sha1 (and payload).

    digest is what the header tells, sha1 that of the payload as read.  A payload that
    holds version lines and runs past the end of its split is put together from the
    splits it touches.  Bytes after a broken record of a file are not reached.
    """
    found = cut(_candidates(spark, path, False)) if not payloads else _candidates(spark, path, True)
    totals = found.where("total is not null").select("file", "block", "total")
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(totals.withColumn("base", F.coalesce(F.sum("total").over(order), F.lit(0))).select(F.col("file").alias("f"), F.col("block").alias("k"), "base"))
    same = (F.col("file") == F.col("f")) & (F.col("block") == F.col("k"))
    narrow = found.where("total is null").select("file", "block", "at", "next", "exit").join(base, same)
    # a later split's first segment follows a version line that ends the split before
    abs_ = narrow.select("file", "block", (F.col("at") + F.col("base")).alias("at"), (F.col("next") + F.col("base")).alias("next"), (F.col("exit") + F.col("base")).alias("exit"))
    abs_ = cut(abs_)
    # only places where some chain enters a split can be entries
    exits = abs_.where("exit is not null").select("file", F.col("exit").alias("at")).distinct()
    starts = abs_.where("at = 0").select("file", "at")
    jump = cut(abs_.join(exits.unionByName(starts).distinct(), ["file", "at"]).select("file", "at", F.col("exit").alias("to")))
    reached = cut(starts)
    count = reached.count()
    while True:
        step = reached.join(jump, ["file", "at"]).where("to is not null").select("file", F.col("to").alias("at"))
        reached = cut(reached.unionByName(step).distinct())
        now = reached.count()
        if now == count:
            break
        count = now
        jump = cut(jump.alias("x").join(jump.alias("y"), F.expr("x.file = y.file and x.to = y.at"), "left").select("x.file", "x.at", F.col("y.to").alias("to")))
    entries = abs_.join(reached, ["file", "at"]).select(F.col("file").alias("ef"), F.col("block").alias("eb"), F.col("at").alias("entry"))

    def follow(rows: pa.Table, entry: pa.Table) -> pa.Table:
        step = dict(zip(rows["at"].to_pylist(), rows["next"].to_pylist(), strict=True))
        true: set[int] = set()
        for at in entry["entry"].to_pylist():
            while at in step and at not in true:
                true.add(at)
                at = step[at]
        f, b = (entry["ef"][0].as_py(), entry["eb"][0].as_py()) if entry.num_rows else (None, None)
        return pa.table({"file": pa.array([f] * len(true), pa.string()), "block": pa.array([b] * len(true), pa.int64()), "offset": pa.array(sorted(true), pa.int64())})

    true = abs_.groupBy("file", "block").cogroup(entries.groupBy("ef", "eb")).applyInArrow(follow, "file string, block long, offset long")
    true = true.join(base, same).select(F.col("file").alias("tf"), F.col("block").alias("tb"), (F.col("offset") - F.col("base")).alias("ta"), "offset")
    records = found.where("total is null").join(true, (F.col("file") == F.col("tf")) & (F.col("block") == F.col("tb")) & (F.col("at") == F.col("ta")))
    columns = ["file", "offset", "type", "id", "uri", "refers_to", "digest", "length", "sha1"] + ["payload"] * payloads
    stop = F.col("offset") - F.col("at") + F.col("next")
    torn = cut(records.where("sha1 is null").withColumn("stop", stop).select(*columns, "stop").drop("sha1", "payload"))
    records = records.select(*columns)
    n_torn = torn.count()
    if not n_torn:
        return records
    pieces = _torn_payloads(spark, path, torn, base, n_torn)
    mended = torn.join(pieces.select(F.col("file").alias("pf"), F.col("offset").alias("po"), "sha1", "payload"), (F.col("file") == F.col("pf")) & (F.col("offset") == F.col("po"))).select(*columns)
    return records.where("sha1 is not null").unionByName(mended)


def _torn_payloads(spark: SparkSession, path: str, torn: DataFrame, base: DataFrame, n_torn: int) -> DataFrame:
    """file, offset, sha1 and payload of records that run over several splits (one at most per split)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for part in batches:
            out = []
            for value, file, block in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if (file, block) != key:
                    key, at = (file, block), 0
                out.append({"file": file, "block": block, "rel": at, "value": value})
                at += len(value) + len(MAGIC)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("value", pa.binary())]))

    placed = _segments(spark, path).mapInArrow(place, "file string, block long, rel long, value binary")
    placed = placed.join(base, (F.col("file") == F.col("f")) & (F.col("block") == F.col("k"))).select("file", (F.col("rel") + F.col("base")).alias("pos"), "value")
    want = torn.select(F.col("file").alias("tf"), "offset", "length", "stop")
    want = F.broadcast(want) if n_torn <= BROADCAST_ROWS else want
    # a record touches what stands before its successor, however long its head is
    hits = placed.join(want, (F.col("file") == F.col("tf")) & (F.col("pos") > F.col("offset")) & (F.col("pos") < F.col("stop")))

    def mend(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        block = MAGIC.join(v.as_py() for v in rows["value"])
        body, length = _head(block)[1], rows["length"][0].as_py()
        payload = block[body : body + length]
        return pa.table({"file": rows["file"][:1], "offset": rows["offset"][:1], "sha1": pa.array([payload_digest(payload)]), "payload": pa.array([payload], pa.binary())})

    return hits.groupBy("file", "offset").applyInArrow(mend, "file string, offset long, sha1 string, payload binary")


def archive_round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0, compression: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC records under path and reads them back.

    page_id, payload_bytes, payload_digest, record_type and refers_to for every row, all from
    the archives; a revisit's size is that of the record it refers to.  A null html is an
    empty payload.  Rows without page_id are responses.  Rows that repeat a page_id are
    judged each by its own payload; those with the smallest page_id of a payload are all
    responses.  Payloads are not shuffled: the list of revisits, which is narrow, goes to
    the rows if it is within the broadcast bound, and only beyond it are both shuffled.
    Fewer or more records than rows are an error.  An empty table gives an empty one.
    """
    spark = pages.sparkSession
    if path is None:
        where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or cut(spark.range(1)) and spark.sparkContext.getCheckpointDir()
        path = f"{where}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hexed = F.sha1(html)

    @F.pandas_udf("string")
    def base32(h):  # noqa: ANN001, ANN202
        return h.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())

    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("uri"), html.alias("payload"), hexed.alias("hexed"))
    marks = mark_revisits(rows.select(F.col("id"), F.col("hexed").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")), "id", least_bytes)
    revisits = cut(marks.where("refers_to is not null").select(F.col("id").alias("rid"), F.col("payload_digest").alias("rdigest"), "refers_to").distinct())
    n = revisits.count()
    if n:
        rows = rows.join(F.broadcast(revisits) if n <= BROADCAST_ROWS else revisits, (F.col("id") == F.col("rid")) & (F.col("hexed") == F.col("rdigest")), "left").drop("rid", "rdigest")
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    write_warc(rows.withColumn("payload_digest", base32("hexed")), path, compression)
    back = cut(read_warc(spark, path, payloads=False).select("id", "type", "refers_to", "digest", "length", "sha1"))
    written, found = pages.count(), back.count()
    if written != found:
        raise RuntimeError(f"{written} rows written to {path}, {found} records read back")
    meant = back.where("refers_to is not null").select(F.col("refers_to").alias("of"), F.col("digest").alias("as")).distinct()
    sizes = back.where("type = 'response' and id is not null").select(F.col("id").alias("of"), F.col("sha1").alias("as"), F.col("length").alias("full")).join(meant, ["of", "as"], "left_semi").distinct()
    out = back.join(sizes, (F.col("refers_to") == F.col("of")) & (F.col("digest") == F.col("as")), "left")
    revisit = F.col("type") == "revisit"
    return out.select(
        F.col("id").alias("page_id"), F.when(revisit, F.col("full")).otherwise(F.col("length")).alias("payload_bytes"), F.when(revisit, F.col("digest")).otherwise(F.col("sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )
