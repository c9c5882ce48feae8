"""Registered queries for files, audits and streams; files are written from the tables by Spark, then read back."""
# ruff: noqa: ANN001, ANN201, ANN202

from __future__ import annotations

from pyspark.sql import functions as F

from grafita import schema
from grafita.operators import checks as ck
from grafita.operators.distinct import counts
from grafita.plans.derived import graph, table, union
from grafita.plans.registrar import registrar
from grafita.sources import files as fs
from grafita.sources import versions as vs
from grafita.sources.shared import cut, shared_folder, swept
from grafita.streaming import ingest as ig

QUERIES, ORACLE, reg = registrar()


@reg("a01", "select 'txt' as ext, sum(strlen(coalesce(text, '')) + 1) as bytes from documents")
def a01(s, d):
    root = shared_folder(s, "corpus")
    t = table(s, d, "documents").select(F.coalesce("text", F.lit("")).alias("value"))
    t.write.text(f"{root}/one/two")
    t.select(F.lit(1).alias("x")).write.json(f"{root}/other")
    return fs.scan_corpus(s, root, content=False).groupBy("ext").agg(F.sum("size").alias("bytes"))


@reg("a02", "select lang, sum(strlen(coalesce(text, '')) + 1) as bytes from documents group by 1")
def a02(s, d):
    root = shared_folder(s, "folder")
    t = table(s, d, "documents").select("lang", F.coalesce("text", F.lit("")).alias("value"))
    t.write.partitionBy("lang").text(f"{root}/box")
    t.select("value").write.text(f"{root}/box/lang=xx/.hidden")
    f = fs.scan_folder(s, f"{root}/box").where("path like '%.txt'")
    return f.groupBy(F.regexp_extract("path", "^box/lang=([^/]+)/", 1).alias("lang")).agg(F.sum(F.length("content")).alias("bytes"))


@reg("a03_a22", "select 'proyectos_' || year(o_orderdate) as root, count(*) filter (o_orderkey % 5 <> 0) as processed, count(*) filter (o_orderkey % 5 = 0) as ignored, sum(length('orden ' || o_orderkey)) as bytes from orders group by 1")
def a03_a22(s, d):
    """Archives of a customer's orders each, packed in tasks, opened again; every fifth order lies where no project's file may."""
    import io
    import zipfile

    @F.udf("binary", useArrow=True)
    def pack(paths, texts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for path, text in zip(paths, texts, strict=True):
                z.writestr(path, text)
            z.writestr("__MACOSX/x", "junk")
            z.writestr("a/.hidden", "junk")
        return out.getvalue()

    k, y = F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string")
    below = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("/Informe/a"), k)).otherwise(F.concat(F.lit("/"), k, F.lit("/Informe/a")))
    path = F.concat(F.lit("proyectos_"), y, F.lit("/informes_"), y, below, F.lit(".pdf"))
    t = table(s, d, "orders").select("o_custkey", path.alias("path"), F.concat(F.lit("orden "), k).alias("text"))
    each = t.groupBy("o_custkey").agg(F.collect_list(F.struct("path", "text")).alias("f"))
    archives = each.select(F.concat(F.col("o_custkey").cast("string"), F.lit(".zip")).alias("path"), pack("f.path", "f.text").alias("content"))
    inner = cut(fs.expand_archives(archives).where("error is null").select("path", F.length("content").alias("size")))  # opened once
    kept = fs.prepare_corpus(inner)
    return kept.join(inner.groupBy(F.get(F.split("path", "/"), 0).alias("root")).agg(F.sum("size").alias("bytes")), "root")


A22 = """with o as (select o_orderkey, '20' || right(year(o_orderdate)::varchar, 2) as y from orders),
p as (select o_orderkey as k, y, case when o_orderkey % 5 = 0 then 'varios_' || o_orderkey % 3 || '/a' || o_orderkey || '.pdf' else 'proyectos_' || y || '/informes_' || y || '/' || (o_orderkey - o_orderkey % 2) || '/Informe/a' || o_orderkey || '.PDF' end as path from o),
v as (select *, 'proy_' || y || '_' || (k - k % 2) || '_informe.pdf' as n from p where k % 5 <> 0)
select 'renamed' as what, max(path) as path, n as name, null as files from v group by n
union all select 'invalid', null, 'varios_' || k % 3, count(*) from p where k % 5 = 0 group by k % 3 union all select 'invalid', null, 'broken.zip', 1
union all select 'processed', null, null, count(*) from v union all select 'overwritten', null, null, count(*) - count(distinct n) from v union all select 'ignored', null, null, count(*) + 1 from p where k % 5 = 0"""


@reg("a22_rename", A22)
def a22_rename(s, d):
    """Orders as files: pairs of a year that share a name, every fifth below no project, and an archive that can't be opened."""
    k, y = F.col("o_orderkey"), F.concat(F.lit("20"), F.date_format("o_orderdate", "yy"))
    t = lambda c: c.cast("string")
    good = F.concat(F.lit("proyectos_"), y, F.lit("/informes_"), y, F.lit("/"), t(k - k % 2), F.lit("/Informe/a"), t(k), F.lit(".PDF"))
    path = F.when(k % 5 == 0, F.concat(F.lit("varios_"), t(k % 3), F.lit("/a"), t(k), F.lit(".pdf"))).otherwise(good)
    renamed, invalid, report = fs.rename_corpus(table(s, d, "orders").select(path.alias("path")), s.createDataFrame([("in/broken.zip",)], "path string"))
    none = F.lit(None).cast("string")
    counts = report.select(F.explode(F.create_map(*[x for c in report.columns for x in (F.lit(c), F.col(c))])).alias("what", "files"))
    return union(renamed.select(F.lit("renamed").alias("what"), "path", F.col("new_name").alias("name"), F.lit(None).cast("long").alias("files")),
                 invalid.select(F.lit("invalid").alias("what"), none.alias("path"), F.col("root").alias("name"), "files"), counts.select("what", none.alias("path"), none.alias("name"), "files"))


@reg("a04", "select c_custkey as k, c_name as name, 'a' || chr(10) || '\"' || c_mktsegment || '\", b' as note from customer")
def a04(s, d):
    root = shared_folder(s, "csv")
    c = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("name"), F.concat(F.lit('a\n"'), F.col("c_mktsegment"), F.lit('", b')).alias("note"))
    c.write.csv(root, header=True, quote='"', escape='"')
    r = fs.read_project_csv(s, root, ["k", "name", "note"])
    return r.where("row_number >= 2").select(F.col("k").cast("long").alias("k"), "name", "note")


LINES = "with l as (select conv_id as file, turn + 1 as line_no, case when turn % 4 = 1 and conv_id % 2 = 0 then turn || ',' || role when turn = 1 then ' ' else role end as line from conversations) "


def lines(s, d):
    t = F.col("turn")
    text = F.when((t % 4 == 1) & (F.col("conv_id") % 2 == 0), F.concat_ws(",", t.cast("string"), "role")).when(t == 1, " ").otherwise(F.col("role"))
    return table(s, d, "conversations").select(F.col("conv_id").alias("file"), (t + 1).alias("line_no"), text.alias("line"))


@reg("a06", LINES + ", f as (select file, first(line order by line_no) as line from l where line_no > 1 and trim(line) <> '' group by 1) select distinct l.file, coalesce(regexp_full_match(trim(split_part(f.line, ',', 1)), '[0-9]+'), false) as repair from l left join f using (file)")
def a06(s, d):
    return fs.needs_repair(lines(s, d))


@reg("a09", ", c as (select doc_id, pos, chunk_id, texto from chunk where doc_id % 10 <> 0) select 'd' || doc_id as source, pos, chunk_id, texto as text, cast(pos as varchar) as page from c", True)
def a09(s, d):
    from grafita.plans.derived import chunks

    root = shared_folder(s, "chunks")
    one = F.struct("pos", "chunk_id", F.col("texto").alias("text"))
    t = chunks(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    good = F.to_json(F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"), F.create_map(F.lit("page"), x["pos"].cast("string")).alias("metadata"))).alias("chunks")))
    t.select(F.when(F.col("doc_id") % 20 == 0, '["no object"]').when(F.col("doc_id") % 10 == 0, '{"chunks": "no list"}').otherwise(good).alias("value")).write.text(root)
    c, _ = fs.read_chunks(s, root, multi_line=False)
    return c.select("source", F.col("pos").cast("long").alias("pos"), "chunk_id", "text", F.col("metadata")["page"].alias("page"))


@reg("a10_a11", "with o as (select *, o_orderkey % 5 = 0 as bad from orders) select 'nodes' as what, count(*) as n from o where not bad and o_orderstatus = 'F' union all select 'edges', count(*) from o where o_orderkey % 7 <> 0 and not bad and o_orderstatus = 'F' union all select 'error ' || case when o_orderkey % 10 = 0 then 'entity_without_id' else 'unknown_label' end, count(*) from o where bad group by 1 union all select 'error relationship_without_type', count(*) from o where o_orderkey % 7 = 0 having count(*) > 0")
def a10_a11(s, d):
    root = shared_folder(s, "graph")
    k = F.col("o_orderkey")
    name = F.concat(F.lit("o"), k.cast("string"))
    node = F.struct(F.when(k % 10 != 0, name).alias("id"), F.when(k % 5 == 0, "Otro").otherwise("Proyecto").alias("label"), F.create_map(F.lit("estado"), F.col("o_orderstatus")).alias("properties"))
    rel = F.struct(F.when(k % 7 != 0, "INICIO_EN").alias("type"), name.alias("source_id"), F.year("o_orderdate").cast("string").alias("target_id"))
    table(s, d, "orders").select(F.to_json(F.struct(F.array(node).alias("entities"), F.array(rel).alias("relationships"))).alias("value")).write.text(root)
    nodes, edges, bad = fs.read_graph(s, root, ["Proyecto", "Anio"], multi_line=False)
    n, e = fs.load_subset(nodes, edges, "Proyecto", "estado", "F")
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return union(one(n, "nodes"), one(e, "edges"), bad.groupBy(F.concat(F.lit("error "), F.col("error")).alias("what")).agg(F.count("*").alias("n")))


@reg("a12", "select distinct p_type as field, p_brand as subfield, p_name as topic from part where p_brand <> 'Brand#1'")
def a12(s, d):
    root = shared_folder(s, "taxonomy")
    brand = F.when(F.col("p_brand") == "Brand#1", " ").otherwise(F.col("p_brand"))
    t = table(s, d, "part").select("p_type", brand.alias("b"), "p_name").distinct().groupBy("p_type", "b").agg(F.array_append(F.array_sort(F.collect_list("p_name")), " ").alias("x"))
    t = t.groupBy("p_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "x")))).alias("m"))
    t.select(F.to_json(F.create_map("p_type", "m")).alias("value")).write.text(root)
    return fs.read_taxonomy(s, root, multi_line=False).select("field", "subfield", "topic")


@reg("a13", """with v as (select label as file, vec_id as pos, case when vec_id % 200 = 7 then embedding[2:] else embedding end as e from embeddings),
most as (select max(len(e)) as dim from v)
select file, count(*) as n_vectors, count(*) filter (pos % 150 <> 1) as n_meta, count(*) = count(*) filter (pos % 150 <> 1) as equal, min(len(e)) = any_value(dim) and max(len(e)) = any_value(dim) as one_dim,
count(*) filter (pos % 150 <> 1) as aligned, max(file || '_chunk_' || pos) filter (pos % 150 <> 1) as last_id, max(cast(e[1] as double)) filter (pos % 150 <> 1) as first_component
from v, most group by file""")
def a13(s, d):
    """Some vectors have no row of meta, some lack a component: not every file agrees."""
    v = table(s, d, "embeddings").select(F.col("label").alias("file"), F.col("vec_id").alias("pos"), "embedding")
    v = v.withColumn("embedding", F.when(F.col("pos") % 200 == 7, F.expr("slice(embedding, 2, size(embedding) - 1)")).otherwise(F.col("embedding")))
    meta = v.where("pos % 150 <> 1").select("file", "pos")
    aligned = fs.align_embeddings(v, meta).groupBy("file").agg(
        F.count("*").alias("aligned"), F.max("semantic_id").alias("last_id"), F.max(F.get("embedding", F.lit(0)).cast("double")).alias("first_component")
    )
    return fs.embedding_report(v, meta).join(aligned, "file", "left").select("file", "n_vectors", "n_meta", "equal", "one_dim", "aligned", "last_id", "first_component")


@reg("a14_a15", "select 'node' as kind, label as name, count(*) * 2 as n, count(*) as ids from nodes group by label union all select 'edge', type, count(*) * 2, count(distinct (source_id, target_id)) from edges group by type", True)
def a14_a15(s, d):
    """The graph is derived once, exported and appended; then its one copy goes, and what was written is counted."""
    root, once = shared_folder(s, "export"), shared_folder(s, "derived")
    g = graph(s, d)
    with swept(s):
        g.nodes.select("id", "label", "name").sortWithinPartitions("id").write.parquet(f"{once}/nodes", compression="zstd")
        g.edges.select("type", "source_id", "target_id").sortWithinPartitions("type", "source_id", "target_id").write.parquet(f"{once}/edges", compression="zstd")
    n, e = s.read.parquet(f"{once}/nodes"), s.read.parquet(f"{once}/edges")
    sizes = 2 * n.count(), 2 * e.count()
    n = n.select("id", "label", F.create_map(F.lit("created_at"), F.lit("x"), F.lit("valor"), F.col("name")).alias("props"))
    e = e.withColumn("props", F.create_map(F.lit("updated_at"), F.lit("x")))
    fs.export_graph(n, e, root)
    fs.append_graph(n, e, root)
    vs.Files(s, once).delete(".")
    nodes, edges = fs.import_graph(s, root)
    counted = lambda df, kind, *of: counts(df, *of).select(F.lit(kind).alias("kind"), "name", "n", "ids")
    return union(counted(nodes, "node", sizes[0], "label", "id"), counted(edges, "edge", sizes[1], "type", "source_id", "target_id"))


@reg("a18_a19", "select conv_id || '-' || turn as id, trim(text, ' ') as question, true as ok from conversations where role = 'user' and trim(text, ' ') <> ''")
def a18_a19(s, d):
    root = shared_folder(s, "questions")
    c = table(s, d, "conversations").where("role = 'user'")
    q = F.array(F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("question")), F.struct(F.lit("x").alias("id"), F.lit("  ").alias("question")))
    c.select(F.when(F.col("turn") % 4 == 0, F.to_json(q)).otherwise(F.to_json(F.struct(q.alias("questions")))).alias("value")).write.text(f"{root}/in")
    fs.write_answers(fs.read_questions(s, f"{root}/in", multi_line=False).withColumn("ok", F.lit(True)), f"{root}/out")
    return s.read.schema("id string, question string, answer string, ok boolean").json(f"{root}/out").select("id", "question", "ok")


@reg("b06", """with x as (select doc_id, length('passage: ' || coalesce(text, '')) as a, [unicode(c) for c in string_split(substr('passage: ' || coalesce(text, ''), 1, 18), '')] as u from documents),
y as (select doc_id, a, list_sum(u) as b from x)
select doc_id, 2 as dim, round(a / sqrt(a * a + b * b), 6) as x, round(b / sqrt(a * a + b * b), 6) as y from y""")
def b06(s, d):
    def encoder(texts):
        return [[len(t), sum(map(ord, t[:18]))] for t in texts]

    v = fs.embed(table(s, d, "documents").select("doc_id", "text"), encoder)
    at = lambda i: F.round(F.get("embedding", F.lit(i)), 6)
    return v.select("doc_id", F.size("embedding").alias("dim"), at(0).alias("x"), at(1).alias("y"))


@reg("i01", """, i as (select 'Topico' as label, replace(p_name, ' ', '_') as id, 'valor' as field, case when min(p_partkey) % 3 = 0 then 'missing' when min(p_partkey) % 3 = 1 then 'blank' end as issue from part group by 1, 2, 3)
select label, field, issue, count(*) as n from (select * from i where issue is not null union all select 'Documento', id, 'tipo', 'wrong_type' from nodes where label = 'Documento' and name = 'tabla' union all select 'Documento', id, 'extra', 'undeclared' from nodes where label = 'Documento' union all select 'Rareza', id, null, 'unknown_label' from nodes where label = 'Anio') group by 1, 2, 3""", True)
def i01(s, d):
    g = graph(s, d)
    t = table(s, d, "part").groupBy(F.replace("p_name", F.lit(" "), F.lit("_")).alias("id")).agg(F.min("p_partkey").alias("k"))
    none = F.expr("cast(map() as map<string,string>)")
    t = t.select(F.lit("Topico").alias("label"), "id", F.when(F.col("k") % 3 == 0, none).otherwise(F.create_map(F.lit("valor"), F.when(F.col("k") % 3 == 1, " ").otherwise("v"))).alias("props"))
    tipo = F.when(F.col("name") == "tabla", "dibujo").otherwise(F.col("name"))
    doc = g.nodes_of("Documento").select("label", "id", F.create_map(F.lit("nombre_base"), F.col("id"), F.lit("es_grupo"), F.lit("proy"), F.lit("anio_publicacion"), F.lit("2000"), F.lit("tipo"), tipo, F.lit("extra"), F.lit("x")).alias("props"))
    year = g.nodes_of("Anio").select(F.lit("Rareza").alias("label"), "id", none.alias("props"))
    issues = ck.entity_issues(union(t, doc, year), schema.label_fields(s), ["Documento"])
    return issues.groupBy("label", "field", "issue").agg(F.count("*").alias("n"))


ENDS = "ends(type, sl, dl) as (values " + ", ".join(f"('{t}', '{a}', '{b}')" for t, (aa, bb, _, _) in schema.EDGE_RULES.items() for a in aa for b in bb) + ")"


@reg("i12", ", " + ENDS + """, n as (select label, id from nodes union all select label, id from nodes where label = 'Anio' union all select 'Rareza', 'r' union all select 'Area', ' '),
e as (select type, source_id, target_id from edges union all select type, target_id, source_id from edges where type = 'INICIO_EN' union all select type, source_id, 'no' || target_id from edges where type = 'INICIO_EN' union all select 'OTRO', source_id, target_id from edges where type = 'INICIO_EN'),
i as (select id, min(label) as label, count(*) as c from n group by 1),
x as (select e.type, e.type || '|' || source_id || '|' || target_id as item, a.label as sl, b.label as dl, e.type in (select type from ends) as known from e left join i a on a.id = source_id left join i b on b.id = target_id)
select 'duplicate_id' as issue, id as item from i where c > 1 union all select 'blank_id', 'Area' union all select 'unknown_label', 'r'
union all select 'unknown_type', item from x where not known union all select 'no_source', item from x where sl is null union all select 'no_target', item from x where dl is null
union all select 'illegal_ends', item from x where known and sl is not null and dl is not null and (type, sl, dl) not in (select (type, sl, dl) from ends)""", True)
def i12(s, d):
    """The whole graph, with years twice, two odd nodes, and the edges to years turned, lost and of no known type."""
    g = graph(s, d)
    odd = s.createDataFrame([("Rareza", "r"), ("Area", " ")], "label string, id string")
    n = union(g.nodes.select("label", "id"), g.nodes_of("Anio").select("label", "id"), odd)
    e = g.edges_of("INICIO_EN").select("type", "source_id", "target_id")
    turned = e.select("type", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    lost = e.withColumn("target_id", F.concat(F.lit("no"), F.col("target_id")))
    all_ = union(g.edges.select("type", "source_id", "target_id"), turned, lost, e.withColumn("type", F.lit("OTRO")))
    return ck.structural_issues(n, all_, schema.edge_endpoints(s), schema.label_fields(s))


@reg("i13", """, d as (select id from nodes where label = 'Documento' and name <> 'tabla'), c as (select source_id as id, count(*) as n from edges where type = 'PERTENECE_A_SUBCAMPO' group by 1)
select 'error' as severity, 'project.title' as rule, id from nodes where label = 'Proyecto' and id not in (select source_id from edges where type = 'TITULO_EXTRAIDO_DE')
union all select 'error', 'document.first_chunk', id from d where id not in (select source_id from edges where type = 'PRIMER_CHUNK')
union all select 'error', 'document.chunks', id from d where id not in (select target_id from edges where type = 'DE_DOCUMENTO')
union all select 'error', 'topic.subfields', id from c where n > 1""", True)
def i13(s, d):
    return ck.constraint_issues(graph(s, d))


@reg("l02", "select event_type, user_id, last(value order by event_id) as value from events where user_id % 9 <> 0 group by 1, 2")
def l02(s, d):
    """A folder of files read as a stream into a store, merged by key."""
    root = shared_folder(s, "ingest")
    user = F.when(F.col("user_id") % 9 != 0, F.col("user_id"))
    table(s, d, "events").select("event_id", "event_type", user.alias("user_id"), "value").write.parquet(f"{root}/in")
    t = ig.stream_rows(s, f"{root}/in", "event_id long, event_type string, user_id long, value double", "parquet")
    store = vs.Store(s, f"{root}/store")
    ig.ingest(t, store, f"{root}/state", ["event_type", "user_id"], "value", "event_id").awaitTermination()
    return ig.stored(store, ["event_type", "user_id"], "value", "event_id").select("event_type", "user_id", "value")


@reg("l03", "select event_type, user_id, min(event_id) as event_id from events group by all")
def l03(s, d):
    """Events come in four loads, each read by a stream that goes on where the last one ended."""
    root = shared_folder(s, "first")
    store = vs.Store(s, f"{root}/store")
    e = table(s, d, "events").select("event_id", "event_type", "user_id")
    top = e.agg(F.max("event_id")).first()[0] or 0
    for i in range(4):
        e.where(F.least(F.floor(F.col("event_id") * 4 / (top + 1)), F.lit(3)) == i).write.mode("append").parquet(f"{root}/in")
        t = ig.stream_rows(s, f"{root}/in", "event_id long, event_type string, user_id long", "parquet")
        ig.keep_first(t, store, f"{root}/state", ["event_type", "user_id"], ["event_id"]).awaitTermination()
    return store.read("first").select("event_type", "user_id", "event_id")


@reg("l02_graph", """with r as (select case when event_id % 11 <> 0 then user_id end as project, event_type as topic, value as score, event_id as seq from events), k as (select * from r where project is not null and project % 9 <> 0),
e as (select project, topic, last(score order by seq) as score from k group by all), f as (select * from e where score >= 50)
select 'error' as kind, case when project is null then 'missing_key' else 'not_admitted' end as name, count(*) as n from r where project is null or project % 9 = 0 group by 2
union all select 'node', 'Proyecto', count(distinct project) from k union all select 'node', 'Topico', count(distinct topic) from k
union all select 'edge', topic, count(*) from f group by topic union all select 'issue', 'project_without_topic', (select count(distinct project) from k where project not in (select project from f))""")
def l02_graph(s, d):
    """Events as scored rows in several batches; projects whose number 9 divides are not admitted."""
    root = shared_folder(s, "graph")
    e = table(s, d, "events")
    rows = e.select(F.when(F.col("event_id") % 11 != 0, F.col("user_id")).cast("string").alias("project"), F.col("event_type").alias("topic"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    rows.repartition(3, "seq").write.parquet(f"{root}/in")
    t = ig.stream_rows(s, f"{root}/in", "project string, topic string, score double, seq long", "parquet", files_a_batch=1)
    known = e.where("user_id % 9 <> 0").select(F.col("user_id").cast("string").alias("project")).distinct()
    store = vs.Store(s, f"{root}/store")
    ig.ingest_graph(t, store, f"{root}/state", known).awaitTermination()
    nodes, edges, errors = ig.graph_of(store, 50.0)
    count = lambda df, kind, name: df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    issue = ig.topicless(nodes, edges).agg(F.count("*").alias("n")).select(F.lit("issue").alias("kind"), F.lit("project_without_topic").alias("name"), "n")
    return union(count(errors, "error", "error"), count(nodes, "node", "label"), count(edges, "edge", "topic"), issue)
