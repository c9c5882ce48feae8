"""Registered queries for extraction, taxonomy, layout and cutting."""
# ruff: noqa: ANN001, ANN201, ANN202

from __future__ import annotations

from pyspark.sql import functions as F

from grafita.operators import extract as ex
from grafita.plans.derived import chunks, projects, table, union
from grafita.plans.registrar import registrar

QUERIES, ORACLE, reg = registrar()

#: Project rows out of orders: a customer and a year make a project, so projects repeat across files.
ROWS = """with csv as (select 'tabla_' || o_orderstatus || '.csv' as file, o_orderkey as row_number, cast(o_orderkey as varchar) as row_id, case when o_orderkey % 11 = 0 then null else cast(o_custkey as varchar) end as id_formulario,
  cast(year(o_orderdate) as varchar) as anio, case when o_orderpriority = '1-URGENT' then 'Grupo' else 'Proyecto' end as tipo_archivo, case when o_orderkey % 13 = 0 then null else 'Titulo ' || o_orderpriority end as titulo,
  case when o_orderkey % 7 = 0 then null else c_mktsegment end as area from orders join customer on o_custkey = c_custkey),
ok as (select *, case when tipo_archivo = 'Grupo' then 'gi_' else 'proy_' end || anio || '_' || id_formulario as pid from csv where id_formulario is not null and titulo is not null),
firsts as (select * from ok qualify row_number() over (partition by pid order by file, row_number) = 1) """


def rows(s, d):
    k, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    none = F.lit(None).cast("string")
    t = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return t.select(
        F.concat(F.lit("tabla_"), F.col("o_orderstatus"), F.lit(".csv")).alias("file"), k.alias("row_number"), k.cast("string").alias("row_id"), F.when(k % 11 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("id_formulario"),
        year.alias("anio"), F.when(F.col("o_orderpriority") == "1-URGENT", "Grupo").otherwise("Proyecto").alias("tipo_archivo"), F.when(k % 13 != 0, F.concat(F.lit(" Titulo "), F.col("o_orderpriority"))).alias("titulo"), none.alias("descripcion"),
        F.col("o_orderpriority").alias("palabras_claves"), F.lit(" ").alias("palabras_claves2"), none.alias("palabras_claves3"), F.when(k % 7 == 0, "").otherwise(F.col("c_mktsegment")).alias("area"),
    )


FILES = "with f as (select p.*, case okey % 5 when 0 then '_Informe.pdf' when 1 then '_propuesta.PDF' when 2 then '.csv' when 3 then '_informe.exe' else 'x.docx' end as tail from (select o_orderkey as okey, year(o_orderdate) as y, o_orderkey % 3 = 0 as listed from orders) p) "


def files(s, d):
    k = F.col("okey")
    tail = F.when(k % 5 == 0, "_Informe.pdf").when(k % 5 == 1, "_propuesta.PDF").when(k % 5 == 2, ".csv").when(k % 5 == 3, "_informe.exe").otherwise("x.docx")
    p = projects(s, d)
    key = F.concat_ws("_", F.lit("proy"), F.col("year").cast("string"), k.cast("string"))
    name = F.when(k % 5 == 4, F.concat(k.cast("string"), tail)).otherwise(F.concat(key, tail))
    return p.select(name.alias("name")), p.where("okey % 3 = 0").select(key.alias("id_archivo"))


@reg("d01", FILES + """select case when okey % 5 = 4 then okey || tail else 'proy_' || y || '_' || okey || tail end as name, case when okey % 5 = 2 or (okey % 5 < 2 and listed) then 'ok' when okey % 5 = 3 then 'extension' when okey % 5 = 4 then 'name' else 'key' end as status from f""")
def d01(s, d):
    f, csv = files(s, d)
    bad = ex.documents(f, csv)[2]
    return f.join(bad, "name", "left").select("name", F.coalesce("error", F.lit("ok")).alias("status"))


@reg("d01_nodes_d03", FILES + "select 'proy_' || y || '_' || okey as key, case okey % 5 when 0 then 'informe' else 'propuesta' end as tipo from f where okey % 5 < 2 and listed")
def d01_nodes_d03(s, d):
    nodes, edges, _ = ex.documents(*files(s, d))
    return ex.project_keys(nodes).join(edges.select(F.col("source_id").alias("key"), F.col("target_id").alias("id")), "key").join(nodes, "id").select("key", "tipo")


@reg("d06", ROWS + "select tipo_archivo as label, pid as id, lower(titulo) as titulo, titulo as titulo_de_despliegue, substr(titulo, 8) as words from firsts")
def d06(s, d):
    return ex.projects(rows(s, d)).select("label", "id", "titulo", "titulo_de_despliegue", F.array_join("palabras_clave", "|").alias("words"))


@reg("d07", ROWS + "select distinct 'PERTENECE_A_AREA' as type, pid as source_id, 'area_' || lower(area) as target_id from ok where area is not null union all select distinct 'INICIO_EN', pid, anio from ok where area is not null")
def d07(s, d):
    return ex.areas_and_years(rows(s, d))[1]


@reg("d09", ROWS + "select 'TITULO_EXTRAIDO_DE' as type, pid as source_id, file || '#Chunk' || row_id as target_id from firsts union all select 'ES_DESCRITO_POR', pid, file from firsts")
def d09(s, d):
    return ex.title_evidence(rows(s, d))


@reg("d10", ROWS + """select 'node ' || tipo_archivo as what, count(*) as n from firsts group by 1 union all select 'node Area', count(distinct area) from ok where area is not null union all select 'node Anio', count(distinct anio) from ok where area is not null
union all select 'edge PERTENECE_A_AREA', count(*) from (select distinct pid, area from ok where area is not null) union all select 'edge INICIO_EN', count(*) from (select distinct pid, anio from ok where area is not null)
union all select 'edge TITULO_EXTRAIDO_DE', count(*) from firsts union all select 'edge ES_DESCRITO_POR', count(*) from firsts
union all select 'error MissingProjectID', count(*) from csv where id_formulario is null or titulo is null union all select 'error MissingAreaID', count(*) from ok where area is null""")
def d10(s, d):
    nodes, edges, errors = ex.from_directory(rows(s, d))
    one = lambda df, what, c: df.groupBy(F.concat(F.lit(what), F.col(c)).alias("what")).agg(F.count("*").alias("n"))
    return union(one(nodes, "node ", "label"), one(edges, "edge ", "type"), one(errors, "error ", "error"))


@reg("d21", "select distinct p_name as name, last(upper(p_name) || ' ' || p_partkey order by p_type, p_partkey) over (partition by p_name order by p_type, p_partkey rows between unbounded preceding and unbounded following) as translated from part")
def d21(s, d):
    p = table(s, d, "part")
    at = [F.col("p_type").alias("field"), F.col("p_partkey").alias("topic")]
    return ex.align_taxonomy(p.select(*at, F.concat(F.lit(" "), F.col("p_name")).alias("name")), p.select(*at, F.concat_ws(" ", F.upper("p_name"), F.col("p_partkey").cast("string")).alias("name")), ["field", "topic"])


@reg("e06", """with s as (select l_orderkey as project, p_name as topic, avg(l_discount) as coverage, sum(l_quantity) as confidence, count(*) as mentions from lineitem join part on l_partkey = p_partkey group by 1, 2),
m as (select distinct l_orderkey as project, p_name as topic, l_orderkey || '#' || l_linenumber as chunk from lineitem join part on l_partkey = p_partkey), t as (select *, case when topic like 'c%' then 't_' || replace(topic, ' ', '_') else replace(topic, ' ', '_') end as tid from s)
select 'TIENE_TOPICO' as type, 'p' || project as source_id, tid as target_id, round(coverage, 6) as coverage, round(confidence, 6) as confidence, mentions from t union all select distinct 'EXTRAIDO_DE', chunk, tid, null, null, null from m join t using (project, topic)""")
def e06(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumns({"project": F.concat(F.lit("p"), F.col("l_orderkey").cast("string")), "topic": F.col("p_name")})
    sel = li.groupBy("project", "topic").agg(F.avg("l_discount").alias("coverage"), F.sum("l_quantity").alias("confidence"), F.count("*").alias("mentions"), F.lit(False).alias("fallback"))
    told = li.select("project", "topic", F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk"))
    names = table(s, d, "part").where("p_name like 'c%'").select(F.col("p_name").alias("topic"), F.concat(F.lit("t "), F.col("p_name")).alias("translated")).distinct()
    e = ex.topic_edges(sel, told, names)
    return e.select("type", "source_id", "target_id", F.round("coverage", 6).alias("coverage"), F.round("confidence", 6).alias("confidence"), "mentions")


@reg("e07", "with l as (select source as project, doc_id as doc from documents where doc_id not in (select doc_id from labels where toxic is not null)), f as (select distinct project from l order by 1 limit 3) select project, doc from l where project in (from f)")
def e07(s, d):
    docs = table(s, d, "documents").select(F.col("source").alias("project"), F.col("doc_id").alias("doc"))
    done = ex.mark_done(s.createDataFrame([], "doc long, label string"), table(s, d, "labels").where("toxic is not null").select(F.col("doc_id").alias("doc")), "Topico")
    return ex.pending_docs(docs, done, "Topico", 3)


@reg("b01_b02", """with i as (select conv_id as doc, turn as pos, role, length(text) as l from conversations), h as (select *, role = 'user' as head, sum((role <> 'user')::int) over (partition by doc order by pos) as run from i),
p as (select doc, pos, case when head then 1 + row_number() over (partition by doc, run, head order by pos) - 1 else 0 end as new_level from h)
select p.doc, p.pos, new_level, row_number() over (partition by p.doc order by i.l % 3, -(i.l % 7), i.l, p.pos) - 1 as place from p join i using (doc, pos)""")
def b01_b02(s, d):
    n = F.length("text")
    c = table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "section_header").otherwise("text").alias("label"), F.when(F.col("role") == "user", 1).otherwise(0).alias("level"), (n % 3).alias("page"), (n % 7).alias("top"), n.alias("left"))
    # every item lies in a group of its own, whose place comes from what it holds
    group = c.select("doc", F.concat(F.lit("g"), F.col("pos").cast("string")).alias("item"), F.lit(None).cast("string").alias("parent"), "pos")
    leaf = c.select("doc", F.concat(F.lit("t"), F.col("pos").cast("string")).alias("item"), F.concat(F.lit("g"), F.col("pos").cast("string")).alias("parent"), "pos")
    boxes = c.select("doc", F.concat(F.lit("t"), F.col("pos").cast("string")).alias("item"), "page", "top", "left")
    place = ex.order_layout(union(group, leaf), boxes).withColumn("pos", F.substring("item", 2, 20).cast(c.schema["pos"].dataType))
    return ex.promote_headings(c).select("doc", "pos", "new_level").join(place.select("doc", "pos", "place"), ["doc", "pos"])


@reg("b05", "with w as (select doc_id, string_split(text, ' ') as w, unnest([100, 300]) as size from documents where text is not null), n as (select *, unnest(range(0, cast(ceil(len(w) / cast(size as double)) as bigint))) as pos from w) select doc_id, size, pos, array_to_string(w[pos * size + 1 : pos * size + size], ' ') as texto from n")
def b05(s, d):
    return ex.rechunk(table(s, d, "documents"), [100, 300])
