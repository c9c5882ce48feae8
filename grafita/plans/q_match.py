"""Registered queries over the derived graph: catalogs and path questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from grafita.operators import match as m
from grafita.operators.match import PathSpec, Step
from grafita.plans.derived import SQL, graph, table

PROJECTS = ("Proyecto", "Grupo")
TITLE = Step("TITULO_EXTRAIDO_DE", "chunk", optional=True)
QUERIES = {}
ORACLE = {}


def reg(name, sql=None):  # noqa: ANN001, ANN201
    """Registers a query under op_<name>, with its SQL over the derived graph."""

    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f"op_{name}"] = f
        if sql:
            ORACLE[f"op_{name}"] = SQL + sql
        return f

    return put


@reg("f01", "select label, id, display from nodes where label <> 'Chunk' and contains(lower(concat_ws(chr(1), id, name, display)), 'ring') order by display, id limit 100")
def f01(s, d):  # noqa: ANN001, ANN201
    return m.catalog(graph(s, d).nodes, "ring", None, 500)


NC = ", ne as (select e.* from edges e where source_id in (select id from nodes where label <> 'Chunk') and target_id in (select id from nodes where label <> 'Chunk'))"


PROJ = """with nn as (select count(*) as n from documents), proj as (select o_orderkey as okey, case when o_orderpriority = '1-URGENT' then 'Grupo' else 'Proyecto' end as label, case when o_orderpriority = '1-URGENT' then 'gi_' else 'proy_' end || year(o_orderdate) || '_' || o_orderkey as pid from orders)"""


# around a researcher are their projects, and chunks, which are left out
ORACLE["op_f02"] = PROJ + """, t as (select distinct label, pid from lineitem join proj on l_orderkey = okey where l_suppkey = 3), k as (select pid from t order by pid limit 1200)
select label, pid as id, pid as display, case when k.pid is null then 0 else 1 end as degree from t left join k using (pid)
union all select 'Investigador', 'inv_3', s_name, (select count(*) from k) from supplier where s_suppkey = 3 and (select count(*) from t) > 0"""


@reg("f02")
def f02(s, d):  # noqa: ANN001, ANN201
    return m.neighborhood(graph(s, d), "inv_3", 1200)[0]


@reg("f03", NC + """, deg as (select id, count(*) as degree from (select unnest([source_id, target_id]) as id from ne) group by id),
top as (select label, id, coalesce(degree, 0) as degree from nodes left join deg using (id) where label <> 'Chunk' order by degree desc, id limit 500)
select type, source_id, target_id from ne where source_id in (select id from top) and target_id in (select id from top) order by 1, 2, 3 limit 1200""")
def f03(s, d):  # noqa: ANN001, ANN201
    return m.snapshot(graph(s, d), 500, 1200)[1]


@reg("f04", "select label, id from nodes where id = 'area_machinery' order by label limit 5")
def f04(s, d):  # noqa: ANN001, ANN201
    return m.lookup(graph(s, d).nodes, "area_machinery")


@reg("f05", "select a.label as src_label, type, b.label as dst_label, count(*) as n, count(prop) as n_prop from edges join nodes a on source_id = a.id join nodes b on target_id = b.id group by all")
def f05(s, d):  # noqa: ANN001, ANN201
    return m.discover_schema(graph(s, d))


@reg("f05_names", """, n as (select label, case when name is null then [] else ['name'] end || case when display is null then [] else ['display'] end as ks from nodes), e as (select a.label as sl, type, b.label as dl, case when prop is null then [] else ['rol'] end as ks from edges join nodes a on source_id = a.id join nodes b on target_id = b.id),
x as (select 1 as section, '- ' || label as head, unnest(case when len(ks) = 0 then [null] else ks end) as k from n union all select 2, '- (:' || sl || ')-[:' || type || ']->(:' || dl || ')', unnest(case when len(ks) = 0 then [null] else ks end) from e)
select section, head || coalesce(': ' || string_agg(distinct k, ', ' order by k), '') as line from x group by section, head""")
def f05_names(s, d):  # noqa: ANN001, ANN201
    g = graph(s, d)
    filled = lambda **c: F.map_filter(F.create_map(*[x for k, v in c.items() for x in (F.lit(k), F.col(v))]), lambda _, v: v.isNotNull())
    nodes = g.nodes.select("id", "label", filled(name="name", display="display").alias("props"))
    return m.schema_properties(nodes, g.edges.select("type", "source_id", "target_id", filled(rol="prop").alias("props")))[2]


ORACLE["op_f06"] = PROJ + """, a as (select distinct 'inv_' || s_suppkey as inv, pid, okey from supplier join lineitem on l_suppkey = s_suppkey join proj on l_orderkey = okey where lower(s_name) like '%00001'),
t as (select distinct l_orderkey as okey, replace(p_name, ' ', '_') as topic from lineitem join part on l_partkey = p_partkey where contains(p_name, 'ring'))
select inv, pid, topic from a left join t using (okey)"""


@reg("f06")
def f06(s, d):  # noqa: ANN001, ANN201
    spec = PathSpec("inv", ("Investigador",), F.col("name").endswith("00001"), [Step("PARTICIPO_EN", "pid", PROJECTS), Step("TIENE_TOPICO", "topic", ("Topico",), where=F.col("name").contains("ring"), optional=True)])
    return m.match(graph(s, d), spec).select("inv", "pid", "topic")


def _of_researcher(s, d, name, prop=None, edges=0):  # noqa: ANN001, ANN202
    return m.match(graph(s, d), PathSpec("inv", ("Investigador",), F.col("name").contains(name), [Step("PARTICIPO_EN", "pid", PROJECTS, prop=prop)]), edges)


PART = "from nodes i join edges e on e.source_id = i.id and e.type = 'PARTICIPO_EN' join nodes p on p.id = e.target_id where i.label = 'Investigador' and contains(i.name, "


@reg("f07", f"select count(distinct p.id) as n {PART} '#000000007')")
def f07(s, d):  # noqa: ANN001, ANN201
    return _of_researcher(s, d, "#000000007").agg(F.countDistinct("pid").alias("n"))


@reg("f08", f"select count(distinct p.id) as n {PART} '#00000000') and e.prop = 'responsable'")
def f08(s, d):  # noqa: ANN001, ANN201
    return _of_researcher(s, d, "#00000000", "responsable").agg(F.countDistinct("pid").alias("n"))


def _hop(s, d, type_, label, target=None):  # noqa: ANN001, ANN202
    """Projects and groups with a neighbour of a label."""
    return m.match(graph(s, d), PathSpec("pid", PROJECTS, None, [Step(type_, "to", (label,), where=None if target is None else F.col("id") == target)]))


@reg("f09", "select count(*) as n from edges where type = 'INICIO_EN' and target_id = '1997'")
def f09(s, d):  # noqa: ANN001, ANN201
    return _hop(s, d, "INICIO_EN", "Anio", "1997").agg(F.count("*").alias("n"))


TITLES = "left join edges c on c.source_id = e.source_id and c.type = 'TITULO_EXTRAIDO_DE'"


@reg("f10", f"select e.source_id as pid, c.target_id as chunk from edges e {TITLES} where e.type = 'TIENE_TOPICO' and e.target_id = 'old_rod'")
def f10(s, d):  # noqa: ANN001, ANN201
    g = graph(s, d)
    found = m.match(g, PathSpec("topic", ("Topico",), F.col("id") == "old_rod", [Step("TIENE_TOPICO", "pid", PROJECTS, out=False), TITLE]))
    return found.select("pid", "chunk")


@reg("f11", "select label, count(*) as n from nodes where label in ('Investigador', 'Grupo') group by label")
def f11(s, d):  # noqa: ANN001, ANN201
    return graph(s, d).nodes_of("Investigador", "Grupo").groupBy("label").agg(F.count("*").alias("n"))


@reg("f12", "select distinct a.source_id as pid from edges a join edges b on a.target_id = b.source_id and b.type = 'PERTENECE_A_SUBCAMPO' where a.type = 'TIENE_TOPICO' and b.target_id = 'economy'")
def f12(s, d):  # noqa: ANN001, ANN201
    spec = PathSpec("sub", ("Subcampo",), F.col("id") == "economy", [Step("PERTENECE_A_SUBCAMPO", "topic", ("Topico",), out=False), Step("TIENE_TOPICO", "pid", PROJECTS, out=False)])
    return m.match(graph(s, d), spec).select("pid").distinct()


@reg("f13", "select n.label, count(*) as n from edges e join nodes n on n.id = e.source_id where e.type = 'PERTENECE_A_AREA' and e.target_id = 'area_machinery' group by n.label")
def f13(s, d):  # noqa: ANN001, ANN201
    g = graph(s, d)
    found = m.match(g, PathSpec("area", ("Area",), F.col("id") == "area_machinery", [Step("PERTENECE_A_AREA", "id", PROJECTS, out=False)]))
    return found.select("id").join(g.nodes_of(*PROJECTS).select("id", "label"), "id").groupBy("label").agg(F.count("*").alias("n"))


EVID = "left join edges x on x.target_id = e.source_id and x.type = 'EXTRAIDO_DE'"


def _told():  # noqa: ANN202
    """What a researcher's evidence comes to: one row to meet their projects, not one for each chunk."""
    return {"chunks": F.count("chunk"), "first_chunk": F.min("chunk")}


@reg("f14", f"select e.target_id as pid, e.source_id as inv, count(x.source_id) as chunks, min(x.source_id) as first_chunk from edges e {EVID} where e.type = 'PARTICIPO_EN' and e.target_id like 'gi_1997_%' group by 1, 2")
def f14(s, d):  # noqa: ANN001, ANN201
    spec = PathSpec("pid", ("Grupo",), F.col("id").startswith("gi_1997_"), [Step("PARTICIPO_EN", "inv", ("Investigador",), out=False), Step("EXTRAIDO_DE", "chunk", out=False, optional=True, totals=_told())])
    return m.match(graph(s, d), spec).groupBy("pid", "inv").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.min("first_chunk").alias("first_chunk"))


@reg("f15", f"select e.target_id as pid, e.source_id as inv, count(x.source_id) as chunks from edges e {EVID} where e.type = 'PARTICIPO_EN' and e.prop = 'responsable' and e.target_id like 'proy_1996_%' group by 1, 2")
def f15(s, d):  # noqa: ANN001, ANN201
    spec = PathSpec("pid", ("Proyecto",), F.col("id").startswith("proy_1996_"), [Step("PARTICIPO_EN", "inv", ("Investigador",), out=False, prop="responsable"), Step("EXTRAIDO_DE", "chunk", out=False, optional=True, totals=_told())])
    return m.match(graph(s, d), spec).groupBy("pid", "inv").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


@reg("f16", "select n.id as pid, c.target_id as chunk from nodes n left join edges c on c.source_id = n.id and c.type = 'TITULO_EXTRAIDO_DE' where n.label in ('Proyecto', 'Grupo') and contains(n.name, '_1998_1')")
def f16(s, d):  # noqa: ANN001, ANN201
    return m.match(graph(s, d), PathSpec("pid", PROJECTS, F.col("name").contains("_1998_1"), [TITLE])).select("pid", "chunk")


@reg("f17", f"select e.source_id as inv, e.target_id as pid, c.target_id as chunk from edges e left join edges c on c.source_id = e.target_id and c.type = 'TITULO_EXTRAIDO_DE' where e.type = 'PARTICIPO_EN' and e.source_id in ('inv_1', 'inv_2')")
def f17(s, d):  # noqa: ANN001, ANN201
    spec = PathSpec("inv", ("Investigador",), F.col("id").isin("inv_1", "inv_2"), [Step("PARTICIPO_EN", "pid", PROJECTS), TITLE])
    return m.match(graph(s, d), spec).select("inv", "pid", "chunk")


@reg("f18", "select a.source_id as pid, a.target_id as doc, b.source_id as chunk from edges a join edges b on b.target_id = a.target_id and b.type = 'DE_DOCUMENTO' where a.type = 'ES_DESCRITO_POR' and a.source_id like 'gi_1995_%'")
def f18(s, d):  # noqa: ANN001, ANN201
    spec = PathSpec("pid", ("Grupo",), F.col("id").startswith("gi_1995_"), [Step("ES_DESCRITO_POR", "doc", ("Documento",)), Step("DE_DOCUMENTO", "chunk", ("Chunk",), out=False)])
    return m.match(graph(s, d), spec).select("pid", "doc", "chunk")


@reg("f19", """, leg as (select source_id as id, type, target_id as other from edges where type in ('TIENE_TOPICO', 'PERTENECE_A_AREA', 'INICIO_EN', 'ES_DESCRITO_POR')
union all select target_id, type, source_id from edges where type = 'PARTICIPO_EN')
select n.id, count(distinct other) filter (type = 'TIENE_TOPICO') as topics, count(distinct other) filter (type = 'PARTICIPO_EN') as people, min(other) filter (type = 'PERTENECE_A_AREA') as area,
min(other) filter (type = 'INICIO_EN') as year, min(other) filter (type = 'ES_DESCRITO_POR') as doc from nodes n left join leg using (id) where n.label = 'Grupo' group by n.id""")
def f19(s, d):  # noqa: ANN001, ANN201
    """Each leg is aggregated before it is joined, so legs never multiply."""
    g = graph(s, d)
    out = g.nodes_of("Grupo").select("id")
    legs = {"topics": ("TIENE_TOPICO", True), "people": ("PARTICIPO_EN", False), "area": ("PERTENECE_A_AREA", True), "year": ("INICIO_EN", True), "doc": ("ES_DESCRITO_POR", True)}
    for name, (type_, forward) in legs.items():
        near, far = ("source_id", "target_id") if forward else ("target_id", "source_id")
        agg = F.countDistinct(far) if name in ("topics", "people") else F.min(far)
        out = out.join(g.edges_of(type_).groupBy(F.col(near).alias("id")).agg(agg.alias(name)), "id", "left")
    return out.fillna(0, ["topics", "people"])


@reg("f20", f"select e.source_id as pid, e.target_id as year, c.target_id as chunk from edges e {TITLES} where e.type = 'INICIO_EN' and e.target_id = '1996'")
def f20(s, d):  # noqa: ANN001, ANN201
    spec = PathSpec("year", ("Anio",), F.col("id") == "1996", [Step("INICIO_EN", "pid", PROJECTS, out=False), TITLE])
    return m.match(graph(s, d), spec).select("pid", "year", "chunk")


@reg("f21", "select target_id as topic, count(distinct source_id) as n from edges where type = 'TIENE_TOPICO' group by 1 order by n desc, topic limit 10")
def f21(s, d):  # noqa: ANN001, ANN201
    rows = _hop(s, d, "TIENE_TOPICO", "Topico").withColumnRenamed("to", "topic")
    return m.top_by(rows, "topic", "pid")


@reg("f22", "select n.display as inv, count(distinct target_id) as n from edges join nodes n on n.id = source_id where type = 'PARTICIPO_EN' group by 1 order by n desc, inv limit 10")
def f22(s, d):  # noqa: ANN001, ANN201
    n = table(s, d, "lineitem").count()  # no more pairs than lines
    return m.top_by(_of_researcher(s, d, "", edges=n).select(F.col("inv_display").alias("inv"), "pid"), "inv", "pid", about=n)


SUBYEAR = "from edges a join edges b on a.target_id = b.source_id and b.type = 'PERTENECE_A_SUBCAMPO' join edges y on y.source_id = a.source_id and y.type = 'INICIO_EN' where a.type = 'TIENE_TOPICO' and a.target_id in (select id from nodes where label = 'Topico' and name like '%ing')"


@reg("f23", f"select distinct a.target_id as topic {SUBYEAR} and try_cast(y.target_id as integer) >= 1996 and a.target_id not in (select a.target_id {SUBYEAR} and try_cast(y.target_id as integer) < 1996)")
def f23(s, d):  # noqa: ANN001, ANN201
    spec = PathSpec("sub", ("Subcampo",), None, [Step("PERTENECE_A_SUBCAMPO", "topic", ("Topico",), out=False, where=F.col("name").endswith("ing")), Step("TIENE_TOPICO", "pid", PROJECTS, out=False), Step("INICIO_EN", "year", ("Anio",))])
    rows = m.match(graph(s, d), spec).select("topic", F.expr("try_cast(year as int)").alias("y"))
    return rows.where("y >= 1996").select("topic").distinct().join(rows.where("y < 1996").select("topic"), "topic", "left_anti")


@reg("f24", "select source_id as pid from edges where type = 'INICIO_EN' and try_cast(target_id as integer) >= 1999")
def f24(s, d):  # noqa: ANN001, ANN201
    return _hop(s, d, "INICIO_EN", "Anio").where(F.expr("try_cast(to as int) >= 1999")).select("pid")


@reg("f25", "select distinct i.display as inv, p.display as pid from edges e join nodes i on i.id = e.source_id join nodes p on p.id = e.target_id where e.type = 'PARTICIPO_EN' and e.source_id = 'inv_5'")
def f25(s, d):  # noqa: ANN001, ANN201
    spec = PathSpec("inv", ("Investigador",), F.col("id") == "inv_5", [Step("PARTICIPO_EN", "pid", PROJECTS)])
    return m.with_display(m.match(graph(s, d), spec), ["inv", "pid"]).distinct()


@reg("f26", "select type, count(distinct (least(source_id, target_id), greatest(source_id, target_id))) as n from edges where type <> 'DE_DOCUMENTO' group by type")
def f26(s, d):  # noqa: ANN001, ANN201
    return m.pair_counts(graph(s, d).edges, ["DE_DOCUMENTO"])


@reg("f26_related", "select distinct type, coalesce(n.display, n.id) as display from (select type, case when source_id = 'area_machinery' then target_id else source_id end as id from edges where source_id = 'area_machinery' or target_id = 'area_machinery') join nodes n using (id)")
def f26_related(s, d):  # noqa: ANN001, ANN201
    return m.related(graph(s, d), "area_machinery")


@reg("f27", """, tax as (select distinct p_brand as field, p_type as subfield, p_name as topic from part), h as (select *, contains(lower(topic), 'e') as ht, contains(lower(subfield), 'e') as hs, contains(lower(field), 'e') as hf from tax),
a as (select *, bool_or(ht) over (partition by field, subfield) as anyt from h) select field, subfield, topic from a where ht or ((hs or hf) and not anyt)""")
def f27(s, d):  # noqa: ANN001, ANN201
    tax = table(s, d, "part").select(F.col("p_brand").alias("field"), F.col("p_type").alias("subfield"), F.col("p_name").alias("topic")).distinct()
    return m.search_taxonomy(tax, "e")
