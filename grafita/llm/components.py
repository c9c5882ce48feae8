"""Distributed connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafita.llm.common import BROADCAST_ROWS, cut


_SALTS = 32


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node reachable) of each node of edges (a, b).

    Each round a node takes the smallest label among its own and its neighbours', and then
    that label's label, so the rounds grow with the log of the longest chain.  Labels only
    ever fall; a sum that no longer falls ends the loop.

    Two joins have keys that one large component may hold nearly alone: the neighbours of
    a hub, and the members of a label.  Their other side has one narrow row a key.  It is
    broadcast if its counted rows are within the bound, else it is repeated under
    ``_SALTS`` salts and the large side is dealt by key and salt.  Nulls and loops are no
    edges; no edges give no rows.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    nodes = labels.count()
    last = None
    for _ in range(max_rounds):
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count("*")).first()
        if not now[1] or now == last:
            break
        last = now
        offers = spread(both, "b", labels, "node", nodes).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("offer"))
        near = cut(labels.join(offers, F.col("node") == F.col("at"), "left").select("node", F.least("label", F.coalesce("offer", "label")).alias("label"), F.col("label").alias("own")))
        # a label is itself a node: it moves to its own label (pointer jumping) and to what its members found (hooking)
        moves = near.where("label < node").select(F.col("node").alias("root"), F.col("label").alias("to")).unionByName(near.where("label < own").select(F.col("own").alias("root"), F.col("label").alias("to")))
        hooks = cut(moves.join(near.select(F.col("label").alias("root")).distinct(), "root", "left_semi").groupBy("root").agg(F.min("to").alias("to")))
        labels = cut(spread(near.select("node", "label"), "label", hooks, "root", hooks.count(), "left").select("node", F.least("label", F.coalesce("to", "label")).alias("label")))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))


def spread(wide: DataFrame, key: str, narrow: DataFrame, by: str, rows: int, how: str = "inner") -> DataFrame:
    """wide joined with narrow, which has ``rows`` rows, one a key: broadcast if it is small, else salted."""
    if rows <= BROADCAST_ROWS:
        return wide.join(F.broadcast(narrow), F.col(key) == F.col(by), how)
    salted = narrow.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    dealt = wide.withColumn("__t", F.pmod(F.xxhash64(*wide.columns), F.lit(_SALTS)).cast("int"))
    return dealt.join(salted, (F.col(key) == F.col(by)) & (F.col("__t") == F.col("__s")), how).drop("__s", "__t")
