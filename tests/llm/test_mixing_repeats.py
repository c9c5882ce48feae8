"""Mixing where most rows are wholly equal."""

import collections

from pyspark.sql import functions as F

from grafita.llm import mixing


def test_equal_rows_are_placed_as_one_and_each_comes_out(spark):
    equal = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("one two three").alias("text"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    rest = spark.range(2, 402).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "b").alias("source"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.create_map(F.lit("k"), F.lit(2)).alias("m"))
    twice = rest.where("doc_id < 12")
    docs = equal.unionByName(rest).unionByName(twice)
    held = []
    before = mixing._copies
    mixing._copies = lambda placed, n: held.append(placed.groupBy("__n", "mix_block").count().agg(F.max("count")).first()[0]) or before(placed, n)
    try:
        out = mixing.mix(docs, block_rows=500).cache()
    finally:
        mixing._copies = before
    assert held[0] <= 700  # rows that a block's window sorts
    reads = collections.Counter((r.doc_id, r.mix_round) for r in out.select("doc_id", "mix_round").collect())
    assert reads[1, 0] == 30_000 and all(reads[i, 0] == (2 if i < 12 else 1) for i in range(2, 402))
    # a round reads each source's tokens without a gap
    spans = out.where("mix_round = 0").select("source", "mix_at", "mix_tokens").orderBy("source", "mix_at").collect()
    at = collections.defaultdict(int)
    for s, a, n in spans:
        assert a == at[s]
        at[s] = a + n
    assert at["a"] == 90_000 and {r.m["k"] for r in out.where("doc_id = 1").select("m").limit(5).collect()} == {1}
    again = mixing.mix(docs.repartition(3), block_rows=500)
    key = lambda df: sorted(map(tuple, df.groupBy("doc_id", "mix_round", "mix_block").agg(F.sum("mix_at")).collect()), key=repr)
    assert key(again) == key(out)
