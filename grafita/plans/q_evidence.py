"""Registered queries for evidence, contexts, answers and history."""
# ruff: noqa: ANN001, ANN201, ANN202

from __future__ import annotations

from pyspark.sql import functions as F

from grafita.operators import evidence as ed
from grafita.plans.derived import graph, table
from grafita.plans.registrar import registrar

QUERIES, ORACLE, reg = registrar()


def matches(s, d):
    """A question for each order: chunks of its lines, suppliers as direct and parts as collected entities."""
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").cast("long").alias("seq"), "l_suppkey", "l_partkey")
    chunk = F.struct(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("id"), F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("texto "), F.col("seq").cast("string"))).alias("texto"), F.when(F.col("l_suppkey") % 2 == 0, F.array(F.col("seq").cast("int"))).alias("paginas"))
    one = lambda label, x: F.array(F.struct(F.lit(label).alias("label"), F.col(x).cast("string").alias("ref")))
    return li.select("question", "seq", F.array(chunk).alias("chunks"), one("Investigador", "l_suppkey").alias("direct"), one("Topico", "l_partkey").alias("collected"))


@reg("g01", "with m as (select * from lineitem where l_suppkey % 5 <> 0) select distinct l_orderkey as question, 'c' || l_suppkey as chunk_id, 'texto ' || min(l_linenumber) over w as text, case when l_suppkey % 2 = 0 then min(l_linenumber) over w else 1 end as page from m window w as (partition by l_orderkey, l_suppkey)")
def g01(s, d):
    return ed.evidence(matches(s, d))[0]


@reg("g01_pairs", "select distinct l_orderkey as question, 'c' || l_suppkey as chunk_id, 'Investigador' as label, cast(l_suppkey as varchar) as ref from lineitem where l_suppkey % 5 <> 0")
def g01_pairs(s, d):
    return ed.evidence(matches(s, d))[2]


@reg("g02", ", n as (select label, id, display from nodes where label <> 'Chunk') select label, id, case when label in ('Investigador', 'Topico', 'Area') then display when label in ('Proyecto', 'Grupo') then 'T ' || display || ' (' || id || ')' when label in ('Documento', 'Anio') then id end as ref from n", True)
def g02(s, d):
    g = graph(s, d)
    n = g.nodes.where("label <> 'Chunk'")
    props = F.create_map(F.lit("nombre"), F.col("display"), F.lit("valor"), F.col("display"), F.lit("titulo"), F.concat(F.lit("T "), F.col("display")), F.lit("anio"), F.col("id"))
    return n.select("label", "id", ed.entity_ref(F.col("label"), F.col("id"), props).alias("ref"))


@reg("g03", """with e as (select distinct l_orderkey as question, 'Investigador' as label, cast(l_suppkey as varchar) as ref, 'nombre: ' || l_suppkey as line from lineitem union all select distinct l_orderkey, 'Topico', cast(l_partkey as varchar), 'valor: ' || l_partkey from lineitem),
b as (select question, label, string_agg('  - ' || line, chr(10) order by ref) as t from e group by 1, 2)
select question, '=== ENTIDADES ENCONTRADAS EN EL GRAFO ===' || chr(10) || string_agg(chr(10) || case label when 'Investigador' then 'Investigadores' else 'Tópicos' end || ':' || chr(10) || t, chr(10) order by label) as context from b group by 1""")
def g03(s, d):
    told = ed.evidence(matches(s, d).withColumn("chunks", F.col("chunks")))[1]
    line = F.concat(F.when(F.col("label") == "Topico", "valor: ").otherwise("nombre: "), F.col("ref"))
    return ed.entity_context(told.withColumn("line", line), "question")


@reg("g04_g09", """with r as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) as n from orders), c as (select o_custkey as id, '=== QUERY RESULTS ===' || chr(10) || chr(10) || string_agg(n || '. pedido: ' || o_orderkey || ', estado: [' || o_orderstatus || ', x]', chr(10) order by n) as t from r group by 1)
select c_custkey as id, case when c_custkey % 3 = 0 then 'sin patrón' else coalesce(t, 'sin datos') end as result from customer left join c on id = c_custkey""")
def g04_g09(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pedido"), F.array("o_orderstatus", F.lit("x")).alias("estado"))
    q = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "otro").otherwise("pedidos").alias("pattern"))
    return ed.refresh_gold(q, {"pedidos": ed.rows_context(o, "id", ["pedido"], ["pedido", "estado"])}, "sin patrón", "sin datos")


@reg("g06", "select distinct 'CHUNK_EVIDENCE_FOR' as type, 'c' || l_orderkey as source_id, 'e' || l_suppkey as target_id from lineitem")
def g06(s, d):
    tied = table(s, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.concat(F.lit("e"), F.col("l_suppkey").cast("string"))).alias("entities"))
    return ed.evidence_edges(tied.withColumn("chunk_id", F.concat(F.lit("c"), F.col("l_orderkey").cast("string"))))


@reg("g07", "with t(prompt, system, a) as (values ('base', 'responde', 'P: '), ('corto', 'breve', '')) select item_id as id, prompt, system, a || 'tema' || chr(10) || text as user from benchmark, t")
def g07(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("tema").alias("question"), F.col("text").alias("context"))
    return ed.build_messages(q, s.createDataFrame([("base", "responde", "P: {question}\n{context}"), ("corto", "breve", "{question}\n{context}")], "prompt string, system string, template string"))


@reg("g08", "select conv_id, turn, case when turn % 3 = 0 then 'R' || length(text) when turn % 3 = 1 then 'ya' else 'fijo' end as answer, true as ok from conversations where role = 'user'")
def g08(s, d):
    c = table(s, d, "conversations").where("role = 'user'")
    q = c.select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("question"), F.when(F.col("turn") % 3 == 2, " fijo ").otherwise("libre").alias("context"), F.when(F.col("turn") % 3 == 1, "ya").otherwise(" ").alias("answer"))
    q = q.withColumn("id", F.to_json("id"))
    a = ed.answer_batch(q, lambda questions: "R" + questions.fillna("").str.len().astype(str), ["fijo"])
    return a.select(F.get_json_object("id", "$.conv_id").cast("long").alias("conv_id"), F.get_json_object("id", "$.turn").cast("long").alias("turn"), "answer", "ok")


@reg("k02", "select event_id as id, case when event_type in ('click', 'view') then 'graphrag' else 'rag' end as type, '' as response, coalesce(nullif(event_type, 'error'), 'otro') as chunk_text, case when user_id % 2 = 0 then user_id else 0 end as page from events")
def k02(s, d):
    t = F.col("event_type")
    chunk = F.struct(t.alias("chunk_id"), F.lit("").alias("chunk_text"), F.when(t != "error", t).alias("chunk"), F.lit("otro").alias("text"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("int")).alias("chunk_page"), F.col("value").alias("score"))
    kind = F.when(t == "click", "graph_rag").when(t == "view", "graphrag").otherwise(t)
    h = table(s, d, "events").select(F.col("event_id").alias("id"), kind.alias("type"), t.alias("query_text"), F.lit(None).cast("string").alias("response"), F.array(chunk).alias("chunks"))
    n = ed.normalize_history(h)
    return n.select("id", "type", "response", F.col("chunks")[0]["chunk_text"].alias("chunk_text"), F.col("chunks")[0]["chunk_page"].cast("long").alias("page"))
