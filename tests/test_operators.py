"""Small goldens and properties of the library's operators."""

from pyspark.sql import functions as F

from grafita.functions import text as tx
from grafita.operators import extract, store, tabular, vectors


def test_path_names(spark):
    rows = [
        ("proyectos_2019/informes_2020/123/Informe/x.pdf", "proy_2020_123_informe.pdf"),
        ("grupos/2018/77/Propuesta.docx", "gi_2018_77_propuesta.docx"),
        ("proyectos 2017/tablas 2017/datos.xlsx", "proy_2017_table.xlsx"),
        ("varios/2016/acta.pdf", "admin_2016_acta.pdf"),
        ("varios/sin_anio/acta.pdf", "invalid_path_structure.pdf"),
    ]
    got = spark.createDataFrame(rows, "path string, want string").select(tx.canonical_name(F.col("path")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_names(spark):
    r = spark.range(1).select(tx.fold(F.lit("ÁRBOL Ñandú são")).alias("a"), tx.display_name(F.lit("o'neil"), F.lit("perez-gil")).alias("b"), tx.researcher_id(F.lit("CO"), F.lit("C.C."), F.lit(" 12-3 ")).alias("c")).first()
    assert tuple(r) == ("arbol ñandu são", "O'Neil Perez-Gil", "co_c_c_12_3")


def test_upsert_is_idempotent(spark):
    s = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", {"x": "9"})], "id string, props map<string,string>")
    b = spark.createDataFrame([("a", {"x": None, "z": "3"}), ("c", {"q": "7"})], "id string, props map<string,string>")
    once = store.upsert(s, b, ["id"])
    twice = store.upsert(once.drop("created"), b, ["id"])
    as_dict = lambda df: {r.id: r.props for r in df.collect()}
    assert as_dict(once) == as_dict(twice) == {"a": {"y": "2", "z": "3"}, "b": {"x": "9"}, "c": {"q": "7"}}
    assert {r.id for r in once.where("created").collect()} == {"c"}


def test_csv_repair(spark):
    lines = spark.createDataFrame([("f", 1, "12,a"), ("f", 2, "more"), ("f", 3, " "), ("f", 4, "13,b")], "file string, line_no int, line string")
    assert sorted(r.line for r in tabular.repair_csv(lines).collect()) == ["12,a more", "13,b"]


def test_csv_merge_keeps_repeats_of_the_batch(spark):
    old = spark.createDataFrame([(1, "a", None)], "row_id int, k string, v string")
    new = spark.createDataFrame([("a", None), ("b", "x"), ("b", "x")], "k string, v string")
    assert sorted((r.k, r.v) for r in tabular.merge_csv(old, new).collect() if r.k == "b") == [("b", "x"), ("b", "x")]
    assert tabular.merge_csv(old, new).count() == 3


def test_csv_repair_over_partitions(spark):
    rows = [("f", i, f"{i},x" if i % 50 == 0 else "y") for i in range(400)] + [("g", 1, "lost"), ("g", 2, "7"), ("g", 3, "z")]
    lines = spark.createDataFrame(rows, "file string, line_no int, line string").repartition(7)
    got = {(r.file, r.row): r.line for r in tabular.repair_csv(lines).collect()}
    assert got == {("f", k): f"{k},x" + " y" * 49 for k in range(0, 400, 50)} | {("g", 2): "7 z"}


def test_csv_audit(spark):
    lines = spark.createDataFrame([("a", i, "1,2" if i < 7 else '1,"x,y",3') for i in range(9)] + [("b", 1, "1,2,3")], "file string, line_no int, line string")
    a, b = tabular.audit_csv(lines, 3).orderBy("file").collect()
    assert (a.rows, a.wrong, a.valid, [tuple(x) for x in a.offenders]) == (9, 7, False, [(i, 2, 3) for i in range(5)])
    assert (b.rows, b.wrong, b.valid, b.offenders) == (1, 0, True, None)
    assert {r.file: r["count"] for r in tabular.sample_csv(lines).groupBy("file").count().collect()} == {"a": 5, "b": 1}


def test_knn_blocks_equal_broadcast(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    rows = lambda **kw: sorted(map(tuple, vectors.knn_join(v.where("vec_id % 2 = 0"), v, 4, **kw).collect()))
    assert rows() == rows(block=7, rows=11)


def test_layout_groups_of_groups(spark):
    items = spark.createDataFrame([("d", "g", None, 0), ("d", "x", None, 1), ("d", "in", "g", 0), ("d", "leaf", "g", 1), ("d", "deep", "in", 0)], "doc string, item string, parent string, pos int")
    boxes = spark.createDataFrame([("d", "leaf", 3, 1, 1), ("d", "x", 2, 1, 1), ("d", "deep", 1, 1, 1)], "doc string, item string, page int, top int, left int")
    assert [r.item for r in extract.order_layout(items, boxes).orderBy("place").collect()] == ["g", "x"]


def test_chunks_by_heading(spark):
    rows = [("d", 0, "text", "a b", 1), ("d", 1, "section_header", "H", 1), ("d", 2, None, "c d e f g", 2), ("d", 3, "list", "h", 3), ("d", 4, "text", "i j", 3), ("d", 5, "section_header", "K", 4), ("d", 6, "text", " ", 4)]
    c = extract.chunk_items(spark.createDataFrame(rows, "doc string, pos int, label string, text string, page int"), 4).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.text, r.tokens, r.pages, r.heading, r.element) for r in c] == [("d#chunk0", "a b", 2, [1], None, "text"), ("d#chunk1", "c d e f", 4, [2], "H", "text"), ("d#chunk2", "g h i j", 4, [2, 3], "H", "text")]


def test_display_by_label(spark):
    rows = [
        ("Investigador", {"nombre_de_despliegue": "", "nombre": "ana"}, "inv_1", "ana", "ana (Investigador)"),
        ("Grupo", {"valor": "v"}, "gi_1", "gi_1", "v (Grupo)"),
        ("Anio", {"anio": "2001"}, "a", "2001", "a (Anio)"),
        ("Chunk", {"valor": "v"}, None, "v", "v (Chunk)"),
        ("Topico", None, None, "Topico", " (Topico)"),
    ]
    t = spark.createDataFrame(rows, "label string, props map<string,string>, id string, display string, mention string")
    args = F.col("label"), F.col("props"), F.col("id")
    got = t.select(tx.display_value(*args).alias("a"), tx.mention(*args).alias("b"), "display", "mention").collect()
    assert [(r.a, r.b) for r in got] == [(r.display, r.mention) for r in got]


def test_knn_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0]), (8, [None, 1.0]), (9, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (4096, 3):
        got = sorted(map(tuple, vectors.knn_join(v, v, 2, block=block).collect()))
        assert [r[1:] for r in got if r[0] == 0] == [(1, 1, 1.0), (2, 2, 1.0)] and [r[2] for r in got if r[0] == 3] == [9, 0]
        assert {r[0] for r in got} == {0, 1, 2, 3, 4, 9} and not {r[2] for r in got} & {5, 6, 7, 8}
    assert vectors.knn_join(v.where("vec_id = 6"), v, 2).count() == 0
    assert [tuple(r) for r in vectors.knn_join(v.where("vec_id = 9"), v, 9, 0.7).orderBy("rank").collect()] == [(9, i + 1, x, 0.707107) for i, x in enumerate((0, 1, 2, 3))]
