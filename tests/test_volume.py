"""What keeps time, disk and memory in bounds on large tables."""

import io
import zipfile

import pandas as pd

from grafita.operators import evaluate, labels
from grafita.sources import files


def test_entries_of_archives_go_out_in_batches():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(300):
            z.writestr(f"a/{i}.txt", str(i))

    class Files:  # gives the function that tasks run
        select = lambda self, *_: self
        mapInPandas = lambda self, run, _: run  # noqa: E731, N815

    run = files.expand_archives(Files())
    got = list(run(iter([pd.DataFrame({"path": ["x", "y", "z"], "content": [out.getvalue(), b"broken", out.getvalue()]})])))
    assert len(got) == 1 and len(got[0]) == 601 and got[0]["error"].notna().sum() == 1


def test_exported_graph_is_compressed_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE_ROWS", 40, raising=False)
    props = "map('created_at', 'x', 'valor', 'v') as props"
    n = spark.range(100).selectExpr("'n' || id as id", "'L' as label", props).coalesce(1)
    e = spark.range(100).selectExpr("'T' as type", "'n' || id as source_id", "'n' || (id + 1) as target_id", props).coalesce(1)
    files.export_graph(n, e, str(tmp_path / "g"))
    files.append_graph(n, e, str(tmp_path / "g"))
    nodes, edges = files.import_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == edges.count() == 200
    assert nodes.select("id", "props.created_at").distinct().count() == 200 and nodes.where("props['created_at'] is null").count() == 100
    for part in ("entities", "relationships"):
        written = [p for p in (tmp_path / "g" / part).iterdir() if p.name.startswith("part-")]
        assert all(p.name.endswith(".gz") for p in written) and len(written) >= 4


def test_labels_read_the_edges_from_one_copy(spark):
    n = spark.range(50).selectExpr("'n' || id as id", "'L' as label")
    seen = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    e = spark.range(3000).selectExpr("'T' as type", "'n' || (id % 3) as source_id", "'n' || (id % 50) as target_id").mapInPandas(rows, "type string, source_id string, target_id string")
    assert labels.with_labels(e, n, rows=100).where("src_label = 'L' and dst_label = 'L'").count() == 3000
    assert seen.value == 3000  # the edges are worked out once, not once for each end and count


def test_topic_queries_deal_rows_by_their_number(spark, monkeypatch):
    from grafita.plans import q_more
    from grafita.sources import shared

    monkeypatch.setattr(shared, "TASK_ROWS", 100, raising=False)
    sf = "/root/testdata/sf0.001"
    want = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    for name, key in (("op_e02", "l_orderkey"), ("op_e03", "l_orderkey"), ("op_e04", "project"), ("op_e05", "project"), ("op_e08", "project")):
        plan = q_more.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        dealt = [x for x in plan.splitlines() if f"RepartitionByExpression [{key}#" in x]
        assert dealt and all(x.rstrip().endswith(f"], {want}") for x in dealt), (name, dealt)


def test_sets_are_compared_in_one_shuffle_of_their_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z"), (None, "z")], "k long, v string")
    got = evaluate.compare(a, b, ["k", "v"])
    assert got.select("tp", "fp", "fn").collect() == [(1, 2, 2)]
    by = {r.v: (r.tp, r.fp, r.fn) for r in evaluate.compare(a, b, ["k", "v"], ["v"]).collect()}
    assert by == {"x": (1, 0, 0), "y": (0, 1, 1), "z": (0, 1, 1)}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_folded_by_many_tasks(spark, monkeypatch):
    from grafita.plans import q_more

    monkeypatch.setattr(q_more, "FOLD_ROWS", 20, raising=False)
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    assert q_more.QUERIES["op_c03"](spark, sf).rdd.getNumPartitions() == -(-n // 20) > 1


def test_snapshot_works_out_its_edges_once(spark):
    from grafita.operators import match
    from grafita.plans.derived import Graph

    n = spark.range(20).selectExpr("'L' as label", "'n' || id as id", "'x' as name", "'x' as display")
    seen = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    e = spark.range(40).selectExpr("'T' as type", "'n' || (id % 20) as source_id", "'n' || (id % 7) as target_id", "'p' as prop").mapInPandas(rows, "type string, source_id string, target_id string, prop string")
    assert match.snapshot(Graph(n, e), 500, 1200)[1].count() == 40
    assert seen.value == 40


def test_evidence_meets_a_project_once_a_researcher(spark):
    from pyspark.sql import functions as F

    from grafita.operators.match import PathSpec, Step, match
    from grafita.plans.derived import Graph

    n = spark.createDataFrame([("Grupo", "g1"), ("Grupo", "g2"), ("Investigador", "i1"), ("Investigador", "i2")], "label string, id string").selectExpr("label", "id", "id as name", "id as display")
    took = [("P", i, g, None) for i, g in (("i1", "g1"), ("i1", "g2"), ("i2", "g2"))]
    e = spark.createDataFrame(took + [("X", f"c{k}", "i1", None) for k in range(50)], "type string, source_id string, target_id string, prop string")
    steps = [Step("P", "inv", ("Investigador",), out=False), Step("X", "chunk", out=False, optional=True, totals={"n": F.count("chunk"), "first": F.min("chunk")})]
    rows = match(Graph(n, e), PathSpec("pid", ("Grupo",), None, steps)).select("pid", "inv", "n", "first").collect()
    assert sorted(map(tuple, rows)) == [("g1", "i1", 50, "c0"), ("g2", "i1", 50, "c0"), ("g2", "i2", None, None)]


def counting(spark, df):
    """df, and how many of its rows were worked out."""
    seen = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(rows, df.schema), seen


def test_subgraphs_work_out_edges_once_and_keep_ends_against_the_rules(spark):
    from grafita.operators.scoring import project_subgraphs
    from grafita.plans.derived import Graph

    n = spark.createDataFrame([("Proyecto", "p1", "x"), ("Proyecto", "p2", "x"), ("Grupo", "g", "x"), ("Documento", "d1", "tabla"), ("Documento", "d2", "informe")], "label string, id string, name string")
    rows = [("ES_DESCRITO_POR", "p1", "d1"), ("ES_DESCRITO_POR", "p1", "d2"), ("PARTICIPO_EN", "i", "p2"), ("PARTICIPO_EN", "i", "p2"), ("PARTICIPO_EN", "i", "g"), ("PARTICIPO_EN", "d1", "p2"),
            ("TIENE_TOPICO", "p1", "p2"), ("TIENE_TOPICO", "p2", "p2"), ("TIENE_TOPICO", "x", "p1"), ("TIENE_TOPICO", "d1", "p1"), ("TIENE_TOPICO", "p1", None), ("TIENE_TOPICO", None, "p2"), ("TITULO_EXTRAIDO_DE", "p1", "c")]
    e, seen = counting(spark, spark.createDataFrame([(*r, None) for r in rows], "type string, source_id string, target_id string, prop string"))
    got = sorted(map(str, project_subgraphs(Graph(n, e), ["ES_DESCRITO_POR", "PARTICIPO_EN", "TIENE_TOPICO", "TITULO_EXTRAIDO_DE"]).collect()))
    want = {(p, t, a, b) for t, a, b in rows if t[:2] != "TI" or t == "TIENE_TOPICO" for p, far in ((a, b), (b, a)) if p in ("p1", "p2") and far != "d1"}
    assert got == sorted(f"Row(project_id={p!r}, type={t!r}, source_id={a!r}, target_id={b!r})" for p, t, a, b in want)
    assert seen.value == len(rows)


def test_chunks_of_files_are_worked_out_once(spark):
    from grafita.operators.tabular import extract_chunks

    rows = [("f1", "in/a.pdf", i, f"a{i}", f"t{i}", [i], None) for i in range(4)] + [("f2", "b.pdf", i, f"b{i}", None, [i], "InvalidChunk" if i == 2 else None) for i in range(4)] + [("f3", "z.pdf", i, f"z{i}", "t", [i], "InvalidChunk") for i in range(3)]
    c, seen = counting(spark, spark.createDataFrame(rows, "file string, source string, pos int, chunk_id string, text string, pages array<int>, bad string"))
    nodes, edges, errors = extract_chunks(c, spark.createDataFrame([("A", "a"), ("B", "b")], "doc string, basename string"))
    assert sorted(map(tuple, nodes.collect())) == [(f"a{i}", f"t{i}", [i]) for i in range(4)] + [(f"b{i}", "", [i]) for i in range(2)]
    assert sorted(map(tuple, edges.where("type <> 'DE_DOCUMENTO'").collect())) == [("PRIMER_CHUNK", "A", "a0"), ("PRIMER_CHUNK", "B", "b0"), ("SIGUIENTE_CHUNK", "a0", "a1"), ("SIGUIENTE_CHUNK", "a1", "a2"), ("SIGUIENTE_CHUNK", "a2", "a3"), ("SIGUIENTE_CHUNK", "b0", "b1")]
    assert edges.where("type = 'DE_DOCUMENTO'").count() == 6 and sorted(map(tuple, errors.collect())) == [("f2", 2, "InvalidChunk"), ("f3", None, "MissingDocumentForChunks")]
    assert seen.value == len(rows)


def test_researchers_projects_are_dealt_by_their_number(spark, monkeypatch):
    from grafita.plans import q_match
    from grafita.sources import shared

    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    sf = "/root/testdata/sf0.001"
    want = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    plan = q_match.QUERIES["op_f22"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    for key in ("l_orderkey#", "pid#", "inv#"):
        dealt = [x for x in plan.splitlines() if f"RepartitionByExpression [{key}" in x]
        assert dealt and all(x.rstrip().endswith(f"], {want}") for x in dealt), (key, plan)


def test_distinct_keys_are_packed_and_counted_whole(spark, monkeypatch):
    import pyarrow as pa

    from grafita.operators import distinct

    monkeypatch.setattr(distinct, "BUCKET_ROWS", 300)
    rows = [(t, a, b) for t in ("x", "y", None) for a in ("", "1", "1:1", "ñandú", None) for b in ("", "1", "1:", ":1", None)] * 3
    rows += [("z", f"s{i % 40}", f"t{i % 70}") for i in range(2000)] + [("hub", "s", "t")] * 900 + [("none", None, "t")] * 2
    df = spark.createDataFrame(rows, "name string, a string, b string").repartition(5)
    want = {n: (sum(r[0] == n for r in rows), len({r for r in rows if r[0] == n and None not in r[1:]})) for n in {r[0] for r in rows}}
    got = distinct.counts(df, len(rows), "name", "a", "b")
    assert {r.name: (r.n, r.ids) for r in got.collect()} == want and got.columns == ["name", "n", "ids"]
    assert distinct.counts(df.where("false"), 0, "name", "a").collect() == []
    monkeypatch.setattr(distinct, "PACK_ROWS", 100)
    one = pa.record_batch({"name": ["x"] * 60, "bucket": pa.array([i % 2 for i in range(60)], pa.int32()), "key": [f"key {i // 4:09}" for i in range(60)]})
    packed = list(distinct._packed(iter([one] * 5)))
    assert [p["n"].to_pylist() for p in packed] == [[60, 60], [60, 60], [30, 30]] and all(p["n_keys"].to_pylist() == [15, 15] for p in packed)


def test_graph_is_sorted_in_tasks_of_bounded_rows_and_leaves_no_shuffle(spark, tmp_path, monkeypatch):
    import glob
    import time

    monkeypatch.setattr(files, "FILE_ROWS", 40)
    root = spark.sparkContext.getConf().get("spark.local.dir")
    shuffles = lambda: set(glob.glob(f"{root}/**/shuffle_*.data", recursive=True))
    before = shuffles()
    n = spark.range(200, 0, -1).selectExpr("'n' || lpad(id, 3, '0') as id", "'L' as label", "map('valor', 'v') as props")
    e = spark.range(200).selectExpr("'T' as type", "'n' || (id % 7) as source_id", "'n' || id as target_id", "map('valor', 'v') as props")
    files.export_graph(n, e, str(tmp_path / "g"))
    for part in ("entities", "relationships"):
        assert len({p.name[:10] for p in (tmp_path / "g" / part).iterdir() if p.name.startswith("part-")}) >= 4  # tasks
    lines = [r.id for p in sorted(glob.glob(f"{tmp_path}/g/entities/part-*")) for r in spark.read.json(p).collect()]
    assert lines == [f"n{i:03}" for i in range(1, 201)]
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before


def test_graph_export_drops_its_derived_copy(spark):
    import pathlib

    from grafita.plans import q_files

    top = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(top.iterdir()) if top.exists() else set()
    q_files.QUERIES["op_a14_a15"](spark, "/root/testdata/sf0.001").collect()
    left = [p.name.split("-")[0] for p in set(top.iterdir()) - before]
    assert "export" in left and "derived" not in left
