"""Labels of edges' ends, where a few nodes may be the end of most edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafita.sources.shared import cut, stored

#: An end of more edges than this may be hot, if it has a share of more than 1 / HOT_IDS of all ends.
HOT_ROWS, HOT_IDS = 10_000, 1_000
#: Ends are counted by buckets first, and by themselves in the buckets that hold enough for a hot one.
_BUCKETS = 4096
_NAMES = {"source_id": "src_label", "target_id": "dst_label"}


def hot_ends(edges: DataFrame, ends: Sequence[str], rows: int | None = None) -> DataFrame:
    """end and id of the commonest ends, less than HOT_IDS: years and areas, most often.

    Buckets are counted first, a bounded number of rows, and only ends in those that may
    hold a hot one are counted by themselves, so the others are not dealt for it.
    """
    spark = edges.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("id")) for e in ends])).alias("e")
    t = edges.select(each).select("e.end", "e.id", F.pmod(F.xxhash64("e.id"), F.lit(_BUCKETS)).alias("b"))
    buckets = t.groupBy("end", "b").count().collect()
    least = max(HOT_ROWS if rows is None else rows, sum(r["count"] for r in buckets) // HOT_IDS)
    full = [(r["end"], r["b"]) for r in buckets if r["count"] > least]
    if not full:
        return spark.createDataFrame([], "end string, id string")
    near = t.join(F.broadcast(spark.createDataFrame(full, "end string, b long")), ["end", "b"], "left_semi")
    counts = near.groupBy("end", "id").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return cut(counts.select("end", "id"))


def with_labels(edges: DataFrame, nodes: DataFrame, how: str = "left", ends: Sequence[str] = ("source_id", "target_id"), rows: int | None = None) -> DataFrame:
    """edges with src_label and dst_label (or one of them), the label of the node at each end.

    An edge comes once for each label of its end's id; with ``how`` left one whose end is
    no node has a null.  Labels of hot ends, a bounded number, are broadcast; only the edges
    of the other ends are dealt by them, so no task gets the edges of one year.  Edges and
    labels are read for each end and for the count, so they are made once and stored.
    """
    edges = stored(edges)
    hot = hot_ends(edges, ends, rows)
    found = {r[0] for r in hot.select("end").distinct().collect()}
    labels = stored(nodes.select(F.col("id").alias("__id"), F.col("label").alias("__label")))
    out = edges
    for e in ends:
        named = labels.withColumnRenamed("__label", _NAMES[e])
        on = F.col(e) == F.col("__id")
        if e not in found:
            out = out.join(named, on, how).drop("__id")
            continue
        mine = F.broadcast(hot.where(F.col("end") == e).select(F.col("id").alias("__hot")))
        known = F.broadcast(named.join(mine, F.col("__id") == F.col("__hot"), "left_semi"))
        common = out.join(mine, F.col(e) == F.col("__hot"), "left_semi").join(known, on, how).drop("__id")
        rare = out.join(mine, F.col(e) == F.col("__hot"), "left_anti").join(named, on, how).drop("__id")
        out = common.unionByName(rare)
    return out
