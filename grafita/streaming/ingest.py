"""Ingestion as streams: folders read as they fill, batches merged once, first rows kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grafita.operators.store import first_by
from grafita.sources.shared import cut
from grafita.sources.versions import Store

_PAIR = ["project", "topic"]


def stream_rows(spark: SparkSession, folder: str, schema: str, form: str = "json", files_a_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(form).load(folder)


def dedup_stream(stream: DataFrame, keys: Sequence[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key (L03).  With an event time, state is kept for ``delay`` only."""
    if event_time is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def _once(store: Store, stream: str, n: int) -> bool:
    """Whether batch n of a stream is still to be stored; its number is noted in the version that has its rows."""
    return store.manifest()["notes"].get(stream, -1) < n


def ingest(stream: DataFrame, store: Store, checkpoint: str, keys: Sequence[str], value: str, seq: str) -> StreamingQuery:
    """Each batch's rows, good ones and errors, into the store; ends when the folder is read.

    Rows and errors of a batch come in one version, which also notes the batch: one that is
    run again after a failure finds its number and stores nothing.  Parts of similar size are
    merged key by key after each batch.  Rows without a key are errors, as data.
    """
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(k).isNull()

    def put(batch: DataFrame, n: int) -> None:
        if _once(store, "ingest", n):
            errors = batch.where(bad).withColumn("error", F.lit("missing_key"))
            store.append({"rows": (merged(batch.where(~bad), keys, value, seq), keys), "errors": (errors, keys)}, {"ingest": n})
        store.compact("rows", lambda df: merged(df, keys, value, seq))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(rows: DataFrame, keys: Sequence[str], value: str, seq: str) -> DataFrame:
    """The value of the greatest seq of each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def stored(store: Store, keys: Sequence[str], value: str, seq: str) -> DataFrame:
    """The store's last value of each key: a few parts, each merged before."""
    return merged(store.read("rows"), keys, value, seq)


def keep_first(stream: DataFrame, store: Store, checkpoint: str, keys: Sequence[str], order: Sequence[str], name: str = "first") -> StreamingQuery:
    """The first row of each key into the store, without state in the stream.

    A batch keeps its own first rows whose key no earlier batch has stored.  It reads the
    buckets that its keys fall in, whose size is bounded, so its work does not grow with
    the batches before it.  A batch that is run again stores nothing.  Null keys equal each
    other.
    """

    def put(batch: DataFrame, n: int) -> None:
        if not _once(store, name, n):
            return
        new = first_by(batch, keys, order)
        if name in store.manifest()["tables"]:
            new = cut(new)
            known = store.read(name, near=new).select(*[F.col(k).alias(f"__{k}") for k in keys])
            new = new.join(known, [new[k].eqNullSafe(known[f"__{k}"]) for k in keys], "left_anti")
        store.append({name: (new, keys)}, {name: n})
        store.compact(name)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_graph(stream: DataFrame, store: Store, checkpoint: str, known: DataFrame) -> StreamingQuery:
    """Admit, extract, score and upsert each batch of rows (project, topic, score, seq).

    admit    rows without a project or topic, and those of projects that aren't in known (project),
             are errors, as data.
    extract  a project node for each project, a topic node for each topic, an edge for each pair.
    score    an edge carries the score of the pair's greatest seq.
    upsert   nodes, edges and errors of a batch come in one version, which notes the batch; parts
             are merged by key, so a pair scored again in a later batch is replaced.
    check    graph_of keeps the edges whose last score is at least a bound; topicless then names
             the projects left without a topic.
    """
    missing = F.col("project").isNull() | F.col("topic").isNull()

    def put(batch: DataFrame, n: int) -> None:
        if _once(store, "graph", n):
            keyed = batch.where(~missing)
            admitted = keyed.join(known.select("project").distinct(), "project", "left_semi")
            lost = keyed.join(known.select("project"), "project", "left_anti").select(*batch.columns, F.lit("not_admitted").alias("error"))
            errors = batch.where(missing).withColumn("error", F.lit("missing_key")).unionByName(lost)
            node = lambda label, c: admitted.select(F.lit(label).alias("label"), F.col(c).alias("id"))
            nodes = node("Proyecto", "project").unionByName(node("Topico", "topic")).distinct()
            edges = merged(admitted, _PAIR, "score", "seq")
            store.append({"errors": (errors, ["project"]), "edges": (edges, _PAIR), "nodes": (nodes, ["label", "id"])}, {"graph": n})
        store.compact("edges", lambda df: merged(df, _PAIR, "score", "seq"))
        store.compact("nodes", DataFrame.distinct)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graph_of(store: Store, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges with at least a score of ``least``, and errors of what ingest_graph stored."""
    edges = merged(store.read("edges"), _PAIR, "score", "seq").select(*_PAIR, "score")
    return store.read("nodes").distinct(), edges.where(F.col("score") >= least), store.read("errors")


def topicless(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Projects of the store without a topic (L02's check)."""
    return nodes.where("label = 'Proyecto'").join(edges.select(F.col("project").alias("id")), "id", "left_anti")


def progress(query: StreamingQuery) -> list[dict]:
    """Batch, rows read and rows a second of each batch run."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rate": p.get("processedRowsPerSecond")} for p in query.recentProgress]
