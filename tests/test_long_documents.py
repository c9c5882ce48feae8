"""Chunks of documents too long for one task equal those of the loop over a document."""

import random

from pyspark.sql import functions as F

from grafita.operators import extract, ordered


def test_long_documents_have_the_chunks_of_the_loop(spark):
    rng = random.Random(8)
    rows = []
    for doc, n, heads in (("one", 3000, 0.0), ("two", 3000, 0.05), ("three", 40, 0.3), ("four", 2500, 1.0), ("five", 2500, 0.001)):
        for i in range(n):
            head = rng.random() < heads
            size = rng.choice([0, 1, 1, 2, 3, 5, 9, 29, 30, 31, 75])
            rows.append((doc, i * 3, "section_header" if head else rng.choice([None, "text", "list_item"]), f"H{i}" if head else " ".join(f"{doc}{i}w{k}" for k in range(size)), i // 50))
    items = spark.createDataFrame(rows, "doc string, pos long, label string, text string, page int")
    names = ["doc", "chunk_id", "text", "tokens", "pages", "heading", "element"]
    loop = sorted(map(str, extract.chunk_items(items, 30).select(*names).collect()))
    many = sorted(map(str, extract.chunk_items(items, 30, whole=100).select(*names).collect()))
    assert loop == many and len(loop) > 1000
    long_ = spark.range(3000).select(F.lit("one").alias("doc"), F.col("id").alias("pos"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would else come together
    try:
        t = ordered.running(long_, ["doc"], ["pos"], {"n": F.lit(1).cast("long")})
        held = t.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).filter(lambda n: n > 0).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) > 1 and sum(held) == 3000


def test_running_sums_and_last_values(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 5), rng.choice([None, None, f"x{i}"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i long, v long, s string").repartition(7)
    got = {r.i: (r.total, r.last) for r in ordered.running(df, ["g"], ["i"], {"total": F.col("v")}, {"last": F.col("s")}).collect()}
    total, last = {}, {}
    for g, i, v, s in rows:
        total[g] = total.get(g, 0) + v
        last[g] = s or last.get(g)
        assert got[i] == (total[g], last[g])
    assert ordered.running(df.limit(0), ["g"], ["i"], {"total": F.col("v")}).count() == 0


def test_documents_go_through_tasks_in_batches_not_one_call_each(spark):
    rng = random.Random(10)
    rows, want = [], {}
    for d in range(700):
        bins, used, scope = [], 0, None
        for i in range(rng.randint(1, 40)):
            head, size = rng.random() < 0.1, rng.choice([0, 1, 4, 10, 11, 25])
            rows.append((f"d{d}", i, "section_header" if head else None, "H" if head else "\n ".join(["w\t"] * size), i))
            if head:
                scope = i
            for n in [] if head else [10] * (size // 10) + [size % 10] * (size % 10 > 0):
                if not bins or bins[-1][0] != scope or used + n > 10:
                    bins, used = [*bins, [scope, 0]], 0
                used = bins[-1][1] = used + n
        want |= {f"d{d}#chunk{k}": n for k, (_, n) in enumerate(bins)}
    items = spark.createDataFrame(rows, "doc string, pos long, label string, text string, page int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # documents go on in the next batch
    try:
        c = extract.chunk_items(items, 10)
        assert "FlatMapGroups" not in c._jdf.queryExecution().optimizedPlan().toString()
        assert {r.chunk_id: r.tokens for r in c.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
