"""Small goldens of files, layouts, history, audits and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from grafita.operators import checks, evidence, extract, history, scoring
from grafita.sources import files, versions
from grafita.streaming import ingest


def test_scans(spark, tmp_path):
    for name in ("a.txt", "b.PDF", "c.exe", "in/d.md", ".h/e.txt", "in/.f.txt"):
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"xy")
    got = {r.path.rsplit("root/", 1)[-1] for r in files.scan_corpus(spark, str(tmp_path / "root"), recursive=False, content=False).collect()}
    assert got == {"a.txt", "b.PDF"}
    assert {r.path for r in files.scan_folder(spark, str(tmp_path / "root")).collect()} == {"root/a.txt", "root/b.PDF", "root/c.exe", "root/in/d.md"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.scan_corpus(spark, str(tmp_path / "absent")).collect()


def test_archives_keep_going(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/b.txt", "hi")
        z.writestr("a/", "")
        z.writestr("__MACOSX/a", "no")
        z.writestr("a/.c", "no")
    rows = [("x.zip", out.getvalue()), ("y.zip", b"broken"), ("z.zip", None)]
    got = files.expand_archives(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sorted((r.archive, r.path, bytes(r.content or b""), r.error) for r in got if r.archive == "x.zip") == [("x.zip", "a/b.txt", b"hi", None)]
    assert {r.archive: r.error for r in got if r.error} == {"y.zip": "BadZipFile", "z.zip": "BadZipFile"}


def test_chunk_files(spark, tmp_path):
    good = {"source": "s", "chunks": [{"chunk_id": "c0", "text": "t", "metadata": {"page": 1}}, {"chunk_id": "c1", "text": "u"}]}
    for name, body in (("good.json", json.dumps(good, indent=1)), ("list.json", "[1]"), ("odd.json", '{"chunks": 3}'), ("cut.json", '{"chunks": [')):
        (tmp_path / name).write_text(body)
    chunks, errors = files.read_chunks(spark, str(tmp_path))
    assert [(r.source, r.pos, r.chunk_id, r.metadata) for r in chunks.orderBy("pos").collect()] == [("s", 0, "c0", {"page": "1"}), ("s", 1, "c1", None)]
    assert {r.file: r.error for r in errors.collect()} == {"list.json": "InvalidJson", "odd.json": "InvalidChunksFile", "cut.json": "InvalidJson"}


def test_questions_and_taxonomy(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"question": " a "}, {"question": " "}, {"id": "7", "question": "b"}]))
    assert [(r.id, r.question) for r in files.read_questions(spark, str(tmp_path / "q.json")).collect()] == [("1", "a"), ("7", "b")]
    (tmp_path / "t.json").write_text(json.dumps({"F": {"S": ["x", " ", "y"]}, " ": {"S": ["z"]}}))
    assert [(r.field, r.subfield, r.topic, r.topic_pos) for r in files.read_taxonomy(spark, str(tmp_path / "t.json")).collect()] == [("F", "S", "x", 0), ("F", "S", "y", 2)]


def test_headings(spark):
    h = "section_header"
    items = spark.createDataFrame([("d", i, label, level) for i, (label, level) in enumerate([(h, 1), (h, 1), (h, 2), ("text", None), (h, 2), (h, None), (h, 3)])], "doc string, pos int, label string, level int")
    assert [r.new_level for r in extract.promote_headings(items).orderBy("pos").collect()] == [1, 2, 3, None, 2, None, 3]


def test_layout_of_nested_groups(spark):
    items = spark.createDataFrame([("d", "g", None, 0), ("d", "h", "g", 0), ("d", "a", "h", 0), ("d", "b", None, 1), ("d", "n", None, 2), ("d", "c", None, 3)], "doc string, item string, parent string, pos int")
    boxes = spark.createDataFrame([("d", "a", 1, 50.0, 0.0), ("d", "b", 1, 90.0, 0.0), ("d", "b", 2, 10.0, 0.0), ("d", "c", 1, 50.0, -3.0)], "doc string, item string, page int, top double, left double")
    assert [r.item for r in extract.order_layout(items, boxes).orderBy("place").collect()] == ["b", "c", "g", "n"]


def test_history_ids_are_gapless(spark):
    stored = spark.createDataFrame([(3, "x")], "id long, q string")
    batch = spark.range(1000).select(F.concat(F.lit("q"), F.format_string("%04d", "id")).alias("q"))
    new = history.numbered(batch, ["q"], 3)
    assert [(r.id, r.q) for r in new.orderBy("id").collect()] == [(4 + i, f"q{i:04d}") for i in range(1000)] and stored.first().id == 3


def test_answers(spark):
    q = spark.createDataFrame([("1", "a", "c", None), ("2", "b", "c", "kept"), ("3", "d", "none", " ")], "id string, question string, context string, answer string")
    got = {r.id: (r.answer, r.ok) for r in evidence.answer_batch(q, lambda s: s.str.upper(), ["none"]).collect()}
    assert got == {"1": ("A", True), "2": ("kept", True), "3": ("none", True)}

    def fails(questions):
        raise ValueError("no")

    got = {r.id: (r.answer, r.error) for r in evidence.answer_batch(q, fails, ["none"]).collect()}
    assert got["1"] == (None, "ValueError: no")


def test_judgements(spark):
    texts = ['ok {"matched": ["a"], "missing": [], "extra": ["b"]}', '{"matched": [1], "missing": [], "extra": []}', '{"matched": ["a"], "missing": []}', "none", None, '{"matched": "a", "missing": [], "extra": []}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, judge string")
    got = scoring.score_judgements(df).orderBy("i").collect()
    assert [r.valid for r in got] == [True] + [False] * 5
    assert (got[0].precision, got[0].recall) == (0.5, 1.0)


def test_audit_of_an_empty_and_a_broken_graph(spark):
    nodes = spark.createDataFrame([("Topico", " "), ("Nada", "x"), ("Topico", "t"), ("Topico", "t")], "label string, id string")
    edges = spark.createDataFrame([("T", "t", "gone"), ("ODD", "t", "t")], "type string, source_id string, target_id string")
    ends = spark.createDataFrame([("T", "Topico", "Topico")], "type string, src_label string, dst_label string")
    labels = spark.createDataFrame([("Topico",)], "label string")
    got = {(r.issue, r.item) for r in checks.structural_issues(nodes, edges, ends, labels).collect()}
    assert got == {("duplicate_id", "t"), ("blank_id", "Topico"), ("unknown_label", "x"), ("no_target", "T|t|gone"), ("unknown_type", "ODD|t|t")}
    assert checks.structural_issues(nodes.limit(0), edges.limit(0), ends, labels).count() == 0


def test_stream_reads_each_file_once(spark, tmp_path):
    folder, store, state = str(tmp_path / "in"), versions.Store(spark, f"file://{tmp_path}/store"), str(tmp_path / "state")
    schema = "k string, v string, seq long"
    for batch in ([("a", "1", 1), (None, "e", 2)], [("a", "2", 3), ("b", "3", 4)]):
        spark.createDataFrame(batch, schema).write.mode("append").json(folder)
        q = ingest.ingest(ingest.stream_rows(spark, folder, schema), store, state, ["k"], "v", "seq")
        q.awaitTermination()
    assert {(r.k, r.v) for r in ingest.stored(store, ["k"], "v", "seq").collect()} == {("a", "2"), ("b", "3")}
    assert store.read("errors").count() == 1
    assert all("rows" in p for p in ingest.progress(q))


def test_no_valid_file_is_an_error(spark):
    bad = spark.createDataFrame([("x/a.pdf",), ("y/b.pdf",)], "path string")
    with pytest.raises(files.NoValidFiles, match="roots: x, y"):
        files.rename_corpus(bad)
    assert tuple(files.rename_corpus(bad.limit(0))[2].first()) == (0, 0, 0)
