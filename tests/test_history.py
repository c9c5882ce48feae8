"""The store of versions, and the history over four tables."""

import threading

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafita.operators import history as hi
from grafita.sources import versions as vs


@pytest.fixture
def store(spark, tmp_path):
    return vs.Store(spark, f"file://{tmp_path}/store")


def rows(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))


def test_two_bootstraps_at_once_give_one_load(spark, store):
    meet, out = threading.Barrier(2), []

    def load():
        meet.wait(60)  # both have seen the empty store
        return {"t": (rows(spark, 0, 100), ["k"])}

    threads = [threading.Thread(target=lambda: out.append(store.bootstrap(load))) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(out) == [(1, False), (1, True)] and store.rows("t") == store.read("t").count() == 100
    assert store.bootstrap(load) == (1, False)
    assert len(store.files.names("data")) == 1  # the other's part is gone


def test_readers_of_an_old_version_finish(spark, store):
    store.append({"t": (rows(spark, 0, 50), ["k"]), "u": (rows(spark, 0, 9), ["k"])})
    old = store.read("t")
    assert store.clear("t") == {"t": 50} and store.rows("t") == 0 and store.read("t").count() == 0
    assert old.count() == 50 and store.rows("u") == 9
    store.recreate("t", "k long, w string", ["k"])
    assert store.read("t").columns == ["k", "w"] and old.count() == 50
    assert store.vacuum() == 1 and store.read("u").count() == 9


def test_a_writer_that_dies_leaves_the_old_version(spark, store, monkeypatch):
    store.append({"t": (rows(spark, 0, 50), ["k"])})
    monkeypatch.setattr(store, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.append({"t": (rows(spark, 50, 60), ["k"])})
    assert store.read("t").count() == 50 and store.version() == 1


def test_a_second_writer_tries_again(spark, store):
    store.append({"t": (rows(spark, 0, 10), ["k"])})
    other, calls = vs.Store(spark, store.root), []

    def edit(m, base):
        if not calls:
            other.append({"t": (rows(spark, 10, 30), ["k"])})
        calls.append(base)
        m["notes"]["x"] = "y"

    assert store.change(edit) == 3 and calls == [1, 2] and store.rows("t") == 30 and store.manifest()["notes"] == {"x": "y"}


def test_batches_read_the_buckets_they_touch(spark, store, monkeypatch):
    monkeypatch.setattr(vs, "BUCKET_ROWS", 40)
    sizes = []
    for n in range(6):
        store.append({"t": (rows(spark, 400 * n, 400 * n + 400 - 300 * (n == 5)), ["k"])})
        store.compact("t")
        near = store.read("t", near=spark.createDataFrame([(3,)], "k long"))
        assert near.where("k = 3").count() == 1
        sizes.append(near.count())
    parts = store.manifest()["tables"]["t"]["parts"]
    assert 2 <= len(parts) <= 4 and store.read("t").count() == 2100 and store.read("t").select("k").distinct().count() == 2100
    assert max(sizes) < 150  # of up to 2100 rows
    assert store.compact("t", whole=True) and len(store.manifest()["tables"]["t"]["parts"]) == 1 and store.rows("t") == 2100
    gone = store.remove({"t": spark.createDataFrame([(3,), (4,), (99_999,)], "k long")})
    assert gone == {"t": 2} and store.rows("t") == store.read("t").count() == 2098


def history(spark):
    q = spark.createDataFrame([("a", 0, "rag", "uno"), ("b", 0, "graph", "dos"), ("c", 0, "graph", None)], "ref string, seq long, type string, query_text string")
    c = spark.createDataFrame([("a", 1, "x", "tx", 0.5), ("a", 0, "y", "ty", 0.25), ("zz", 0, "lost", "l", 0.1)], "ref string, seq long, id string, text string, score double")
    g = spark.createDataFrame([("b", 0, "x", None, "old", 2), ("b", 1, "", "x", "new", 0), ("b", 2, None, None, "none", None)], "ref string, seq long, chunk_id string, id string, chunk_text string, page int").withColumn("chunk_page", F.lit(0))
    e = spark.createDataFrame([("b", 1, "x", "e2", "Topico"), ("b", 0, "x", "e1", "Area"), ("b", 2, None, "e3", "Anio"), ("b", 3, "gone", "e4", "Anio")], "ref string, seq long, chunk_id string, entity_id string, entity_label string")
    return {"queries": q, "chunks": c, "graph_chunks": g, "chunk_entities": e}


def test_history_over_four_tables(spark, store):
    first = {r.ref: r.id for r in hi.append_history(store, history(spark)).collect()}
    second = {r.ref: r.id for r in hi.append_history(store, history(spark)).collect()}
    assert first == {"a": 1, "b": 2, "c": 3} and second == {"a": 4, "b": 5, "c": 6} and store.version() == 2
    nested = {r.id: r for r in hi.nested_history(*[store.read(n) for n in hi.KEYS]).collect()}
    assert sorted(nested) == [1, 2, 3, 4, 5, 6] and nested[3].chunks == [] and nested[1].query_text == "uno"
    assert [(c.chunk_id, c.chunk_text, c.score, c.entities) for c in nested[1].chunks] == [("y", "ty", 0.25, None), ("x", "tx", 0.5, None)]
    for q in (2, 5):  # the later of two graph chunks of one chunk_id has the entities; nulls match nulls
        assert [(c.chunk_id, c.chunk_text, c.chunk_page, [e.entity_id for e in c.entities]) for c in nested[q].chunks] == [("x", "old", 2, []), ("x", "new", 0, ["e1", "e2"]), (None, "none", None, ["e3"])]
    gone = hi.delete_history(store, spark.createDataFrame([(2,), (77,), (None,)], "id long"))
    assert gone == {"queries": 1, "chunks": 0, "graph_chunks": 3, "chunk_entities": 4} and store.version() == 3
    assert {r.query_id for r in store.read("chunk_entities").collect()} == {5} and store.rows("queries") == 5
    assert hi.delete_history(store) == {"queries": 5, "chunks": 4, "graph_chunks": 3, "chunk_entities": 4}
    assert all(store.read(n).count() == 0 for n in hi.KEYS)


@pytest.mark.parametrize("most", [250_000, 4])
def test_children_get_ids_by_question_and_seq(spark, store, monkeypatch, most):
    from grafita.sources import shared

    monkeypatch.setattr(shared, "TASK_ROWS", most)  # questions of more children are numbered range by range
    orders, held = [], []
    plain, persist = hi.numbered, DataFrame.persist
    monkeypatch.setattr(hi, "numbered", lambda rows, order, *a, **k: orders.append(list(order)) or plain(rows, order, *a, **k))
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: held.append(1) or persist(self, *a))
    refs = ["a", "b", "b", "c", "d", None]  # b is two questions, which both have its children
    q = spark.createDataFrame([(r, i, f"q{i}") for i, r in enumerate(refs)], "ref string, seq long, query_text string")
    kids = [("a", 3), ("b", 9), ("lost", 1), (None, 2), ("c", 1)] + [("d", i) for i in range(11, 0, -1)] + [("a", i) for i in (7, 5, 6, 4, 2)] + [("lost", i) for i in range(9)]
    c = spark.createDataFrame([(r, i, f"{r}{i}") for r, i in kids], "ref string, seq long, id string").repartition(5)
    for n in range(2):
        hi.append_history(store, {"queries": q, "chunks": c, "chunk_entities": c.where("seq > 5").withColumnRenamed("id", "chunk_id")})
        ids = {r.query_text: r.id for r in store.read("queries").where(f"id > {6 * n}").collect()}
        assert ids == {"q5": 6 * n + 1, "q0": 6 * n + 2, "q1": 6 * n + 3, "q2": 6 * n + 4, "q3": 6 * n + 5, "q4": 6 * n + 6}
        for table, least, per in (("chunks", 0, 20), ("chunk_entities", 6, 10)):
            mine = sorted((ids[f"q{j}"], s, f"{r}{s}") for j, x in enumerate(refs) for r, s in kids if x is not None and r == x and s >= least)
            got = store.read(table).where(f"query_id > {6 * n}").select("id", "query_id", "chunk_id").collect()
            assert len(mine) == per and sorted(map(tuple, got)) == [(per * n + i + 1, qid, cid) for i, (qid, _, cid) in enumerate(mine)]
    assert store.read("graph_chunks").count() == 0 and store.rows("chunks") == 40 and store.rows("chunk_entities") == 20
    # children are put in one order only where a task could not number a question's, and none are held and counted
    assert not held and orders.count(["query_id", "seq"]) == (0 if most > 100 else 4)


def test_a_batch_that_differs_when_read_again_is_refused(spark, store, tmp_path):
    def rows(batches):
        for b in batches:
            yield b.iloc[: 3 if (tmp_path / "read").exists() else 2]
            (tmp_path / "read").touch()

    q = spark.createDataFrame([("a", 0, "q")], "ref string, seq long, query_text string")
    c = spark.range(3, numPartitions=1).selectExpr("'a' as ref", "id as seq", "'x' as id").mapInPandas(rows, "ref string, seq long, id string")
    with pytest.raises(Exception, match="differ from one reading"):
        hi.append_history(store, {"queries": q, "chunks": c})
    assert store.version() == 0


def test_files_enter_the_manifest_after_success(spark, store):
    from grafita.operators.store import ingest_changed

    files = lambda *f: spark.createDataFrame(f, "path string, size long")
    good = lambda todo: todo.select("path", F.col("size").alias("v"), F.when(F.col("path") == "bad", "broken").alias("error"))
    done = lambda f, work=good: {r.path: r.action for r in ingest_changed(store, f, work).collect()}
    assert done(files(("a", 1), ("b", 2), ("bad", 3))) == {"a": "new", "b": "new", "bad": "failed"}
    assert done(files(("a", 1), ("b", 5), ("bad", 3))) == {"a": "skip", "b": "changed", "bad": "failed"}
    assert sorted(map(tuple, store.read("rows").select("path", "v").collect())) == [("a", 1), ("b", 5)]
    before = store.version()
    with pytest.raises(Exception, match="no"):
        done(files(("c", 9)), lambda todo: todo.select(F.raise_error(F.lit("no")).alias("path"), F.lit(None).cast("string").alias("error")))
    assert store.version() == before and done(files(("c", 9), ("bad", 3)), lambda todo: good(todo).withColumn("error", F.lit(None).cast("string"))) == {"c": "new", "bad": "new"}
    assert store.rows("files") == 4 and store.rows("errors") == 2


def test_a_batch_run_again_stores_nothing(spark, store, tmp_path):
    from grafita.streaming import ingest as ig

    rows = [(1, "a", 1.0), (2, "a", 2.0), (3, None, 3.0), (4, "b", 4.0)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "seq long, k string, v double").write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: ig.stream_rows(spark, f"{tmp_path}/in", "seq long, k string, v double", "parquet", files_a_batch=1)
    ig.ingest(read(), store, f"{tmp_path}/state", ["k"], "v", "seq").awaitTermination()
    version, notes = store.version(), store.manifest()["notes"]
    ig.ingest(read(), store, f"{tmp_path}/other", ["k"], "v", "seq").awaitTermination()  # the same batches, from a lost checkpoint
    assert store.read("errors").count() == 1 and {(r.k, r.v) for r in ig.stored(store, ["k"], "v", "seq").collect()} == {("a", 2.0), ("b", 4.0)}
    assert store.manifest()["notes"] == notes and store.version() - version <= 2
