"""Labels where a few ends have most edges, and searches by trigrams."""

import random

from pyspark.sql import functions as F

from grafita.operators import labels, search
from grafita.sources.versions import Store


def test_hot_ends_give_the_rows_of_a_plain_join(spark):
    rng = random.Random(2)
    nodes = [("Anio", "2020"), ("Area", "2020"), ("Anio", "2021")] + [("Proyecto", f"p{i}") for i in range(300)]
    edges = [("INICIO_EN", f"p{rng.randrange(320)}", rng.choice(["2020"] * 8 + ["2021", "gone", None])) for _ in range(3000)]
    n, e = spark.createDataFrame(nodes, "label string, id string"), spark.createDataFrame(edges, "type string, source_id string, target_id string")
    a, z = n.select(F.col("id").alias("source_id"), F.col("label").alias("src_label")), n.select(F.col("id").alias("target_id"), F.col("label").alias("dst_label"))
    for how in ("left", "inner"):
        want = e.join(a, "source_id", how).join(z, "target_id", how).select("type", "source_id", "target_id", "src_label", "dst_label")
        got = labels.with_labels(e, n, how, rows=100).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    hot = {tuple(r) for r in labels.hot_ends(e, ["source_id", "target_id"], 100).collect()}
    assert ("target_id", "2020") in hot and not any(x == "source_id" for x, _ in hot)
    dealt = labels.with_labels(e, n, rows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert dealt.count("LeftAnti") == 1  # the years are taken out before edges are dealt by their target


def test_search_verifies_few_rows(spark, tmp_path):
    rows = [(i, f"Row {i} says {'Ünïque' if i % 500 == 3 else 'plain'} things", None if i % 3 else "Extra") for i in range(2000)] + [(2000, None, None), (2001, "", "ab")]
    df = spark.createDataFrame(rows, "key long, text string, more string")
    store = Store(spark, f"file://{tmp_path}/s")
    search.index_texts(store, df.where("key < 1500"), "key", ["text", "more"])
    search.index_texts(store, df.where("key >= 1500"), "key", ["text", "more"])
    for term in ("ünïQUE", "row 19", "extra", "ab", "", "s", "nothing like it", "1 says plain"):
        want = sorted(i for i, t, m in rows if any(x is not None and term.lower() in x.lower() for x in (t, m)))
        assert sorted(r.key for r in search.search(store, term).collect()) == want, term
    assert search.candidates(store, "ünïque").count() == 4 and search.candidates(store, "ab") is None
