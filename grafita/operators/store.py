"""Keeping a graph up to date: merging, resolving, cleaning, upserting."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafita.operators.labels import with_labels
from grafita.sources.shared import cut
from grafita.sources.versions import Store, ddl


def last_wins(df: DataFrame, keys: Sequence[str], value: str, seq: str) -> DataFrame:
    """One row a key: the value of the greatest seq at the place (first) of the least."""
    return df.groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.min(seq).alias("first"))


def keep_filled(df: DataFrame, keys: Sequence[str], value: str, seq: str) -> DataFrame:
    """The last value that is neither null nor empty, or null (the four fields of a researcher in D11)."""
    filled = F.nullif(F.col(value), F.lit(""))
    return df.groupBy(*keys).agg(F.max_by(filled, F.when(filled.isNotNull(), F.col(seq))).alias(value))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def duplicate_report(df: DataFrame) -> DataFrame:
    """Ids seen more than once, with their labels counted: same-label or cross-label."""
    return df.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).where("n > 1").select("id", "n", F.when(F.col("labels") > 1, "cross").otherwise("same").alias("kind"))


def resolve(edges: DataFrame, batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges with a status for their ends: ok, inexistente or ambiguo.

    An id of the batch wins; else a stored id counts if it has exactly one label.
    """
    b = batch.select("id").distinct().withColumn("w", F.lit(0))
    s = stored.groupBy("id").agg(F.countDistinct("label").alias("c")).select("id", F.when(F.col("c") == 1, 0).otherwise(1).alias("w"))
    best = b.unionByName(s).groupBy("id").agg(F.min("w").alias("w"))
    a = best.select(F.col("id").alias("source_id"), F.col("w").alias("ws"))
    z = best.select(F.col("id").alias("target_id"), F.col("w").alias("wt"))
    bad = F.when(F.col("ws").isNull() | F.col("wt").isNull(), "inexistente").when((F.col("ws") == 1) | (F.col("wt") == 1), "ambiguo").otherwise("ok")
    return edges.join(a, "source_id", "left").join(z, "target_id", "left").withColumn("status", bad).drop("ws", "wt")


def clean_edges(edges: DataFrame, nodes: DataFrame, endpoints: DataFrame, seq: str) -> DataFrame:
    """Edges with a verdict: self, illegal, repeated or kept (D15).  An edge that is not legal never blocks a later one."""
    e = with_labels(edges, nodes).join(F.broadcast(endpoints.withColumn("legal", F.lit(True))), ["type", "src_label", "dst_label"], "left")
    plain = (F.col("source_id") != F.col("target_id")) & F.col("legal")
    w = Window.partitionBy("type", "source_id", "target_id", F.coalesce(plain, F.lit(False))).orderBy(seq)
    n = F.row_number().over(w)
    return e.withColumn("verdict", F.when(F.col("source_id") == F.col("target_id"), "self").when(F.col("legal").isNull(), "illegal").when(n > 1, "repeated").otherwise("kept")).drop("legal")


def upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MERGE of (keys, props map): given properties overwrite, null ones go, absent ones stay; created tells new rows."""
    b = batch.select(*keys, F.col("props").alias("new"), F.lit(True).alias("in_batch"))
    s = stored.select(*keys, F.col("props").alias("old"), F.lit(True).alias("in_store"))
    both = s.join(b, list(keys), "full_outer")
    empty = F.expr("map()").cast("map<string,string>")
    old, new = F.coalesce("old", empty), F.coalesce("new", empty)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    props = F.map_filter(F.map_concat(kept, new), lambda _, v: v.isNotNull())
    return both.select(*keys, props.alias("props"), F.col("in_store").isNull().alias("created"))


def upsert_edges(stored: DataFrame, batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """MERGE of edges (type, source_id, target_id, props); those of the batch with an end that is no node are left out."""
    ids = nodes.select("id").distinct()
    ends = batch.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return upsert(stored, ends, ["type", "source_id", "target_id"])


def admit(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files of known projects, report of the others: path, year, form); both tables have year and form."""
    keys = ["year", "form"]
    return files.join(known.select(*keys).distinct(), keys, "left_semi"), files.join(known.select(*keys), keys, "left_anti").select("path", *keys)


def ingest_report(skipped: DataFrame, errors: DataFrame) -> DataFrame:
    """outcome, type and n: skipped paths, each counted once, and errors by type."""
    one = skipped.select("path").distinct().agg(F.count("*").alias("n")).select(F.lit("skipped").alias("outcome"), F.lit(None).cast("string").alias("type"), "n")
    return one.unionByName(errors.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("error").alias("outcome"), "type", "n"))


def health(stores: dict[str, DataFrame]) -> DataFrame:
    """store, n and empty of each named table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n", (F.col("n") == 0).alias("empty")) for name, df in stores.items()])


def store_health(store: Store, names: Sequence[str]) -> DataFrame:
    """store, n and empty of tables in a store of versions, from its manifest alone."""
    return store.spark.createDataFrame([(n, store.rows(n), store.rows(n) == 0) for n in names], "store string, n long, empty boolean")


def delete_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """The graph without a node and its edges."""
    return nodes.where(F.col("id") != node_id), edges.where((F.col("source_id") != node_id) & (F.col("target_id") != node_id))


def repair_directions(edges: DataFrame, nodes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Edges whose ends are legal only the other way round, turned round."""
    fwd = F.broadcast(endpoints.select("type", F.col("src_label").alias("sl"), F.col("dst_label").alias("tl"), F.lit(True).alias("ok")))
    rev = F.broadcast(endpoints.select("type", F.col("dst_label").alias("sl"), F.col("src_label").alias("tl"), F.lit(True).alias("turn")))
    e = with_labels(edges, nodes).withColumnsRenamed({"src_label": "sl", "dst_label": "tl"}).join(fwd, ["type", "sl", "tl"], "left").join(rev, ["type", "sl", "tl"], "left")
    swap = F.col("ok").isNull() & F.col("turn").isNotNull()
    return e.select("type", F.when(swap, F.col("target_id")).otherwise(F.col("source_id")).alias("source_id"), F.when(swap, F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"), swap.alias("turned"))


def insert_if_new(stored: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is not stored, the first of each by ``order``."""
    return first_by(batch.join(stored.select(key), key, "left_anti"), [key], order)


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, size and what to do: new, changed or skip."""
    m = manifest.select("path", F.col("size").alias("known"))
    return files.join(m, "path", "left").select("path", "size", F.when(F.col("known").isNull(), "new").when(F.col("known") != F.col("size"), "changed").otherwise("skip").alias("action"))


def ingest_changed(store: Store, files: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Works on new and changed files alone; path and action: new, changed, skip or failed.

    work takes files (path, size, action) and gives rows with path and error (null if the
    row is good).  Rows of a file without error replace its former ones, and the manifest
    takes the file's size in the same version, so only after success: a file with an error,
    or any file if work raises, is due again.  Errors are kept as rows of ``errors``.
    """
    base = store.version()
    m = store.manifest(base)
    known = store.read("files", base) if "files" in m["tables"] else files.limit(0)
    told = cut(changed_files(files, known))
    rows = cut(work(told.where("action <> 'skip'")))
    failed = cut(rows.where("error is not null").select("path").distinct())
    due = told.where("action <> 'skip'").join(failed, "path", "left_anti")
    good, bad = rows.where("error is null").drop("error"), rows.where("error is not null").select("path", "error")
    parts = {"rows": (good.join(failed, "path", "left_anti"), ["path"]), "files": (due.select("path", "size"), ["path"]), "errors": (bad, ["path"])}
    again = cut(due.select("path"))
    for name, (df, keys) in parts.items():
        if name in m["tables"] and name != "errors":
            store.without(m, name, again)
        store.add(m, name, keys, ddl(df), store.part(df, keys))
    store.commit(base, m)
    lost = failed.withColumn("lost", F.lit(True))
    return told.join(lost, "path", "left").select("path", F.when(F.col("lost"), "failed").otherwise(F.col("action")).alias("action"))
