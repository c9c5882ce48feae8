"""Registered queries for text functions, checks, store, topics, evaluation, vectors, history."""
# ruff: noqa: ANN001, ANN201, ANN202

from __future__ import annotations

from pyspark.sql import functions as F

from grafita import schema
from grafita.functions import text as tx
from grafita.operators import checks as ck
from grafita.operators import evaluate as ev
from grafita.operators import extract as ex
from grafita.operators import store as st
from grafita.operators import tabular as tb
from grafita.operators import vectors as vc
from grafita.plans.derived import SQL, chunks, graph, participation, projects, table, union
from grafita.sources.shared import dealt

QUERIES = {}
ORACLE = {}


def reg(name, sql=None, derived=False):
    def put(f):
        QUERIES[f"op_{name}"] = f
        if sql:
            ORACLE[f"op_{name}"] = (SQL if derived else "") + sql
        return f

    return put


# --- C: text functions over the tables' own strings
PATHS = """with p as (select o_orderkey as k, 'proyectos_' || year(o_orderdate) || '/' || (case o_orderkey % 3 when 0 then 'informes' when 1 then 'docs' else 'Propuesta' end) || '_' || year(o_orderdate) || '/' || o_orderkey || '/' || (case o_orderkey % 4 when 0 then 'Informe' when 1 then 'Propuesta' else 'x' end) || '/a.pdf' as path, year(o_orderdate) as y from orders) """


def paths(s, d):
    k = F.col("o_orderkey")
    y = F.year("o_orderdate").cast("string")
    mid = F.when(k % 3 == 0, "informes").when(k % 3 == 1, "docs").otherwise("Propuesta")
    leaf = F.when(k % 4 == 0, "Informe").when(k % 4 == 1, "Propuesta").otherwise("x")
    return table(s, d, "orders").select(k.alias("k"), F.concat(F.lit("proyectos_"), y, F.lit("/"), mid, F.lit("_"), y, F.lit("/"), k.cast("string"), F.lit("/"), leaf, F.lit("/a.pdf")).alias("path"), y.alias("y"))


# letters from several scripts, composed or not, by the row's number; the oracle strips accents with DuckDB's own Unicode data
KEPT, SPARE = "ñãõĩũẽỹṽ", "".join(chr(0xE000 + i) for i in range(8))
# letters with a tilde and another mark: the tilde stays
MORE, LESS = "ẫễỗṍṏṹȭẵữỡ", "ãẽõõõũõãũõ"
C01 = """with t as (select doc_id, coalesce(text, '') || ' ' || chr((192 + doc_id % 400)::int) || ' ' || chr((880 + doc_id % 260)::int) || ' ' || chr((7680 + doc_id % 500)::int) || ' n' || chr(771) || ' e' || chr(769) || ' S' || chr(780) || chr(807) as s from documents)
select doc_id, translate(strip_accents(translate(translate(nfc_normalize(lower(s)), '{m}', '{l}'), '{k}', '{p}')), '{p}', '{k}') as folded from t""".format(k=KEPT, p=SPARE, m=MORE, l=LESS)


def lettered():
    letter = lambda first, n: F.element_at(F.array(*[F.lit(chr(first + i)) for i in range(n)]), (F.col("doc_id") % n + 1).cast("int"))
    more = [letter(192, 400), letter(880, 260), letter(7680, 500), F.lit("ñ"), F.lit("é"), F.lit("Ş̌")]
    return F.concat_ws(" ", F.coalesce("text", F.lit("")), *more)


@reg("c01", C01)
def c01(s, d):
    return table(s, d, "documents").select("doc_id", tx.fold(lettered()).alias("folded"))


NAMES = """with n as (select c_custkey as k, chr((192 + c_custkey % 400)::int) || c_mktsegment || chr((7680 + c_custkey % 250)::int) || 'n' || chr(771) || ' /é,' || c_name as s from customer),
f as (select k, s, translate(strip_accents(translate(translate(nfc_normalize(lower(s)), '{m}', '{l}'), '{k}', '{p}')), '{p}', '{k}') as folded from n)
""".format(k=KEPT, p=SPARE, m=MORE, l=LESS)


#: Customers whose names a task folds.
FOLD_ROWS = 10_000


def names(s, d):
    """Customers with letters of several scripts in their names."""
    letter = lambda first, n: F.element_at(F.array(*[F.lit(chr(first + i)) for i in range(n)]), (F.col("c_custkey") % n + 1).cast("int"))
    c = table(s, d, "customer")
    c = c.repartition(-(-c.count() // FOLD_ROWS) or 1, "c_custkey")  # folding takes long, and a file of a few MB is few tasks
    return c.select(F.col("c_custkey").alias("k"), F.concat(letter(192, 400), F.col("c_mktsegment"), letter(7680, 250), F.lit("ñ /é,"), F.col("c_name")).alias("s"))


@reg("c02", NAMES + "select k, translate(replace(folded, ',', ''), ' /', '__') as id from f")
def c02(s, d):
    return names(s, d).select("k", tx.taxonomy_id(F.col("s")).alias("id"))


@reg("c03", NAMES + "select k, trim(regexp_replace(strip_accents(translate(translate(nfc_normalize(lower('N' || k || '_CC_' || s)), '{m}', '{l}'), '{k}', '________')), '[^a-z0-9]+', '_', 'g'), '_') as id from f where k % 400 not in (114, 115, 127, 128, 137, 191, 260, 261, 262, 263, 264, 265, 266, 267, 268, 305, 306, 307) and k % 250 not in (154, 155)".replace("{k}", KEPT).replace("{m}", MORE).replace("{l}", LESS))
def c03(s, d):
    """Letters that stand for several others are left to a test, as DuckDB does not decompose them."""
    wide = "k % 400 not in (114, 115, 127, 128, 137, 191, 260, 261, 262, 263, 264, 265, 266, 267, 268, 305, 306, 307) and k % 250 not in (154, 155)"
    return names(s, d).where(wide).select("k", tx.researcher_id(F.concat(F.lit("N"), F.col("k").cast("string")), F.lit("CC"), F.col("s")).alias("id"))


@reg("c04", NAMES + "select k, 'area_' || replace(folded, ' ', '_') as id from f")
def c04(s, d):
    return names(s, d).select("k", tx.area_id(F.col("s")).alias("id"))


@reg("c05", "select o_orderkey, case when o_orderpriority = '1-URGENT' then 'gi' else 'proy' end || '_' || year(o_orderdate) || '_' || o_orderkey as id from orders")
def c05(s, d):
    return table(s, d, "orders").select("o_orderkey", tx.project_id(F.col("o_orderpriority") == "1-URGENT", F.year("o_orderdate"), F.col("o_orderkey")).alias("id"))


@reg("c06", "select distinct p_partkey, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) as shown from part")
def c06(s, d):
    return table(s, d, "part").select("p_partkey", tx.display_name(F.col("p_name")).alias("shown")).distinct()


@reg("c07", "select event_id, nullif(trim(case when user_id % 5 = 0 then '  ' else ' ' || event_type end), '') as cell from events")
def c07(s, d):
    return table(s, d, "events").select("event_id", tx.cell(F.when(F.col("user_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("event_type")))).alias("cell"))


@reg("c08", "select event_id, coalesce(nullif(lower(trim(case when user_id % 5 = 0 then ' ' else upper(event_type) end)), ''), 'integrante') as role from events")
def c08(s, d):
    return table(s, d, "events").select("event_id", tx.role(F.when(F.col("user_id") % 5 == 0, " ").otherwise(F.upper("event_type"))).alias("role"))


@reg("c09", """with c as (select *, o_orderkey % 4 as r, cast(year(o_orderdate) as varchar) as y, cast(o_orderkey as varchar) as id from orders)
select o_orderkey, case r when 3 then 'proy' when 1 then 'gi' end as grupo, case when r in (1, 3) then y end as anio, case r when 3 then id when 1 then id || '_a' end as sub_id, case r when 3 then 'informe' when 1 then 'propuesta' end as tipo from c""")
def c09(s, d):
    """Names with and without an ending, with an underscore in the id, with a short year, and no canonical name."""
    r, y, k = F.col("o_orderkey") % 4, F.year("o_orderdate").cast("string"), F.col("o_orderkey").cast("string")
    name = F.when(r == 0, "notes of the year.pdf").when(r == 1, F.concat(F.lit("GI_"), y, F.lit("_"), k, F.lit("_a_Propuesta")))
    name = name.when(r == 2, F.concat(F.lit("proy_99_"), k, F.lit("_informe.pdf"))).otherwise(F.concat(F.lit("PROY_"), y, F.lit("_"), k, F.lit("_Informe.PDF")))
    return table(s, d, "orders").select("o_orderkey", tx.document_name(name).alias("n")).select("o_orderkey", "n.*")


@reg("c10_c16", PATHS + """, x as (select *, k % 5 >= 3 and k % 7 <> 0 as valid from p)
select k, case when k % 5 < 2 then 'gi' when k % 5 = 2 then '' else 'proy' end as prefix, case when k % 4 = 0 or k % 3 = 0 then 'informe' when k % 4 = 1 or k % 3 = 2 then 'propuesta' when k % 4 = 2 then 'resumen' end as kind,
case when valid then y || '_' || k end as key, valid from x""")
def c10_c16(s, d):
    """Paths below five kinds of first folder; every seventh lacks the folder of digits."""
    k, y = F.col("k"), F.col("y")
    roots = F.array(F.concat(F.lit("GI_"), y), F.concat(F.lit("Grupos "), y), F.lit("varios"), F.concat(F.lit("PROYECTOS "), y), F.concat(F.lit("proyectos_"), y))
    below = F.regexp_replace("path", "^[^/]+", "")
    below = F.when(k % 4 == 2, F.replace(below, F.lit("/x/"), F.lit("/RESUMEN/"))).otherwise(below)
    below = F.when(k % 7 == 0, F.regexp_replace(below, "/[0-9]+/", "/")).otherwise(below)
    p = paths(s, d).select("k", F.concat(F.get(roots, (k % 5).cast("int")), below).alias("path"))
    return p.select("k", tx.path_group(F.col("path")).alias("prefix"), tx.document_kind(F.col("path")).alias("kind"), tx.path_project_key(F.col("path")).alias("key"), tx.valid_project_path(F.col("path")).alias("valid"))


@reg("c21", """with c as (select c_custkey as k, case c_custkey % 5 when 0 then 'Investigador' when 1 then 'Grupo' when 2 then 'Topico' when 3 then 'Anio' else 'Documento' end as label, case c_custkey % 3 when 0 then c_name end as f, case when c_custkey % 2 = 0 then c_mktsegment end as g, case when c_custkey % 7 <> 0 then 'i' || c_custkey end as id from customer)
select k, case when k % 5 < 2 then coalesce(f, g, id, label) when k % 5 < 4 then coalesce(f, id, label) else coalesce(id, f, label) end as display,
case when k % 5 < 2 then coalesce(f, g, id, '') when k % 5 = 3 then coalesce(id, '') else coalesce(f, id, '') end || ' (' || label || ')' as mention from c""")
def c21(s, d):
    """Nodes of five labels whose first choice is there, blank or absent."""
    k = F.col("c_custkey")
    label = F.get(F.array(*map(F.lit, ["Investigador", "Grupo", "Topico", "Anio", "Documento"])), (k % 5).cast("int"))
    first, second = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, ""), F.when(k % 2 == 0, F.col("c_mktsegment"))
    value = lambda name, of, v: (F.lit(name), F.when(k % 5 == of, v))
    person = value("nombre_de_despliegue", 0, first) + value("nombre", 0, second) + value("titulo_de_despliegue", 1, first) + value("titulo", 1, second)
    props = F.create_map(*person, F.lit("valor"), F.when((k % 5).isin(2, 4), first), *value("anio", 3, first))
    n = table(s, d, "customer").select(k.alias("k"), label.alias("label"), props.alias("props"), F.when(k % 7 != 0, F.concat(F.lit("i"), k.cast("string"))).alias("id"))
    args = F.col("label"), F.col("props"), F.col("id")
    return n.select("k", tx.display_value(*args).alias("display"), tx.mention(*args).alias("mention"))


@reg("c13_c14", PATHS + """, y as (select *, k % 4 in (0, 1) or k % 3 in (0, 2) as placed, case when y between 2000 and 2099 then cast(y as varchar) else coalesce(nullif(regexp_extract(cast(k as varchar), '20[0-9][0-9]'), ''), 'unknown') end as year from p)
select k, year, case when placed then 'proy_' || year || '_' || k || '_' || (case when k % 4 = 0 or k % 3 = 0 then 'informe' else 'propuesta' end) || '.pdf' else 'invalid_path_structure.pdf' end as name from y""")
def c13_c14(s, d):
    return paths(s, d).select("k", tx.relevant_year(F.col("path")).alias("year"), tx.canonical_name(F.col("path")).alias("name"))


@reg("c17_c18", "select conv_id, turn, lower(trim(regexp_replace(regexp_replace('T10001: ' || text, '^T?[0-9]+: ', ''), '\\s+', ' ', 'g'), ' ')) as plain from conversations")
def c17_c18(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", tx.collapsed(tx.strip_label(F.concat(F.lit("T10001: "), F.col("text")))).alias("plain"))


@reg("c19_c20", "select n_nationkey, 'a=' || lower(n_name) || ';b=' || n_regionkey as txt, case when n_regionkey < 2 then 'Proyecto:' || n_nationkey else 'Area:' || lower(n_name) end as key from nation")
def c19_c20(s, d):
    m = F.create_map(F.lit("b"), F.col("n_regionkey").cast("string"), F.lit("a"), F.col("n_name"))
    label = F.when(F.col("n_regionkey") < 2, "Proyecto").otherwise("Area")
    return table(s, d, "nation").select("n_nationkey", tx.comparable(m).alias("txt"), tx.entity_key(label, F.col("n_nationkey").cast("string"), F.col("n_name")).alias("key"))


@reg("c19_kinds", "select event_id, '[' || lower(event_type) || ';;' || user_id || ']' as list, lower(trim(' ' || upper(event_type) || ' ')) as scalar, 'x=' || event_type || ';y=' as map, case user_id % 4 when 0 then 'Investigador:' || event_type when 1 then 'Anio:' || user_id when 2 then 'Documento:d' || event_id else 'Area:valor=' || event_type end as key, 'T|' || event_id || '|' || user_id as edge from events")
def c19_kinds(s, d):
    """Lists, scalars, maps with nulls, keys of nodes by their properties, and of edges."""
    t, u, e = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    none = F.lit(None).cast("string")
    label = F.element_at(F.array(*map(F.lit, ("Investigador", "Anio", "Documento", "Area"))), (F.col("user_id") % 4 + 1).cast("int"))
    props = F.map_filter(F.create_map(F.lit("nombre"), F.when(label == "Investigador", F.upper(t)), F.lit("anio"), F.when(label == "Anio", u), F.lit("valor"), F.when(label == "Area", t)), lambda _, v: v.isNotNull())
    return table(s, d, "events").select(
        "event_id", tx.comparable(F.array(F.upper(t), none, u), "list").alias("list"), tx.comparable(F.concat(F.lit(" "), F.upper(t), F.lit(" ")), "scalar").alias("scalar"),
        tx.comparable(F.create_map(F.lit("y"), none, F.lit("x"), t)).alias("map"), tx.props_key(label, F.concat(F.lit("d"), e), props).alias("key"), tx.edge_key(F.lit("T"), e, u).alias("edge"),
    )


@reg("c22_c24", "select event_id, contains(event_type, 'count') or contains(event_type, 'total') as counting, (greatest(1, least(5, user_id % 7)) - 1) / 4.0 as unit, case when user_id % 2 = 0 then 'Area' else event_type end as label from events")
def c22_c24(s, d):
    labels = F.when(F.col("user_id") % 2 == 0, F.array("event_type", F.lit("Area"))).otherwise(F.array("event_type"))
    return table(s, d, "events").select("event_id", tx.counting(F.col("event_type")).alias("counting"), tx.unit_score(F.col("user_id") % 7).alias("unit"), tx.primary_label(labels, ["Area", "Chunk"]).alias("label"))


# --- I: checks
ENDS = "ends(type, sl, dl) as (values " + ", ".join(f"('{t}', '{a}', '{b}')" for t, (aa, bb, _, _) in schema.EDGE_RULES.items() for a in aa for b in bb) + ")"
RULES = "rules(label, type, least, most) as (values " + ", ".join(f"('{a}', '{t}', {low}, {'null' if high < 0 else high})" for t, (aa, _, low, high) in schema.EDGE_RULES.items() for a in aa if (low, high) != (0, -1)) + ")"


@reg("i02", ", " + ENDS + """, t as (select type, target_id as source_id, source_id as target_id from edges union all select type, source_id, 'no' || target_id from edges where type = 'INICIO_EN'),
l as (select t.type, a.label as sl, b.label as dl from t left join nodes a on a.id = source_id left join nodes b on b.id = target_id),
i as (select l.type, case when l.sl is null then 'no_source' when l.dl is null then 'no_target' when ends.type is null then 'illegal' end as issue from l left join ends on ends.type = l.type and ends.sl = l.sl and ends.dl = l.dl)
select type, issue, count(*) as n from i where issue is not null group by all""", True)
def i02(s, d):
    """All edges turned round, and those to years with ends that are not there."""
    g = graph(s, d)
    turned = g.edges.select("type", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    lost = g.edges_of("INICIO_EN").select("type", "source_id", F.concat(F.lit("no"), F.col("target_id")).alias("target_id"))
    return ck.endpoint_issues(turned.unionByName(lost), g.nodes, schema.edge_endpoints(s))


@reg("i03", ", " + ENDS + ", " + RULES + """, c as (select e.source_id, e.type, ends.sl, count(*) as n from edges e join nodes b on b.id = e.target_id join ends on ends.type = e.type and ends.dl = b.label group by all),
d as (select nodes.label, rules.type, nodes.id, coalesce(n, 0) as n, least, most from nodes join rules on rules.label = nodes.label left join c on c.source_id = nodes.id and c.type = rules.type and c.sl = nodes.label),
b as (select *, row_number() over (partition by label, type order by id) as k from d where n < least or n > most)
select label as src_label, type, count(*) as offenders, string_agg(id, ';' order by id) filter (k <= 5) as examples from b group by 1, 2""", True)
def i03(s, d):
    g = graph(s, d)
    return ck.cardinalities(g.nodes, g.edges.select("type", "source_id", "target_id"), schema.edge_endpoints(s), schema.edge_cardinality(s))


@reg("i04", "select id from nodes where label = 'Proyecto' and id not in (select source_id from edges where type = 'TIENE_TOPICO')", True)
def i04(s, d):
    return ck.without_topic(graph(s, d))


@reg("i05", "select e.source_id, e.target_id from edges e join edges a on a.type = 'DE_DOCUMENTO' and a.source_id = e.source_id join edges b on b.type = 'DE_DOCUMENTO' and b.source_id = e.target_id where e.type = 'SIGUIENTE_CHUNK' and a.target_id <> b.target_id", True)
def i05(s, d):
    return ck.cross_document_links(graph(s, d))


@reg("i06", "select chunk_id as id from chunk where doc_id % 97 = 0 and pos > 0", True)
def i06(s, d):
    return ck.unreachable_chunks(graph(s, d))


@reg("i07", "select chunk_id as id from chunk where doc_id % 101 = 0 and last > 0 and doc_id % 97 <> 0", True)
def i07(s, d):
    return ck.chunks_on_cycles(graph(s, d))


WITHOUT = """with nn as (select count(*) as n from documents), claim as (select distinct l_orderkey as okey, {what} as what from lineitem{more}),
told as (select distinct l_orderkey % n as doc, {what} as what from lineitem{more}, nn where l_returnflag <> 'N' and l_orderkey % n in (select doc_id from documents where text is not null)),
proj as (select o_orderkey as okey, case when o_orderpriority = '1-URGENT' then 'gi_' else 'proy_' end || year(o_orderdate) || '_' || o_orderkey as pid from orders)
select pid, what from (select pid, okey % n as doc, what from claim join proj using (okey), nn) c anti join told on told.doc = c.doc and told.what = c.what"""


@reg("i08", WITHOUT.format(what="'inv_' || l_suppkey", more=""))
def i08(s, d):
    return ck.participation_without_evidence(graph(s, d))


@reg("i09", WITHOUT.format(what="replace(p_name, ' ', '_')", more=" join part on l_partkey = p_partkey"))
def i09(s, d):
    return ck.topic_without_evidence(graph(s, d))


I10 = "select x.source_id as pid, x.target_id as chunk from edges x where type = 'TITULO_EXTRAIDO_DE' and not exists (select 1 from edges c join edges p on p.type = 'ES_DESCRITO_POR' and p.target_id = c.target_id where c.type = 'DE_DOCUMENTO' and c.source_id = x.target_id and p.source_id = x.source_id)"


@reg("i10", I10, True)
def i10(s, d):
    return ck.foreign_titles(graph(s, d))


@reg("i11", f""", bad as ({I10}), o as (select 'foreign_title' as rule, pid || '|' || chunk as id from bad union all select 'no_topic', id from nodes where label = 'Proyecto' and id not in (select source_id from edges where type = 'TIENE_TOPICO')),
k as (select *, row_number() over (partition by rule order by id) as k from o)
select r.rule, case when r.rule <> 'broken' then count(k.id) end as offenders, coalesce(string_agg(k.id, ';' order by k.id) filter (k.k <= 5), '') as examples, case when r.rule = 'broken' then 'AnalysisException' end as error
from (values ('foreign_title'), ('no_topic'), ('broken')) r(rule) left join k on k.rule = r.rule group by r.rule""", True)
def i11(s, d):
    g = graph(s, d)
    return ck.run_checks(s, {"foreign_title": lambda: ck.foreign_titles(g), "no_topic": lambda: ck.without_topic(g), "broken": lambda: g.nodes.select("absent")})


@reg("i17", "select doc_id, case when doc_id % 50 = 0 then lang || '2' else lang end as lang, 'b' as side from documents where doc_id % 50 = 0 union all select doc_id, lang, 'a' from documents where doc_id % 50 = 0")
def i17(s, d):
    a = table(s, d, "documents").select("doc_id", "lang")
    return ck.graph_difference(a, a.withColumn("lang", F.when(F.col("doc_id") % 50 == 0, F.concat("lang", F.lit("2"))).otherwise(F.col("lang"))).orderBy(F.desc("doc_id")))


@reg("i14", "select penalty, greatest(0, 100 - penalty) as score, case when 100 - penalty >= 95 then 'excellent' when 100 - penalty >= 80 then 'good' when 100 - penalty >= 60 then 'fair' else 'poor' end as verdict from (select coalesce(sum(case when event_type = 'error' then 5 when user_id % 3 = 0 then 2 else 1 end), 0) as penalty from events)")
def i14(s, d):
    e = F.col("event_type") == "error"
    severity, category = F.when(e, "error").otherwise("warning"), F.when(e, "structure").when(F.col("user_id") % 3 == 0, "constraint").otherwise("value")
    return ck.score_issues(table(s, d, "events").groupBy(severity.alias("severity"), category.alias("category")).agg(F.count("*").alias("n")))


@reg("i15", "select 'edge' as kind, type as name, count(*) as n from edges group by type union all select 'node', label, count(*) from nodes group by label union all select 'edge', 'all', count(*) from edges union all select 'node', 'all', count(*) from nodes", True)
def i15(s, d):
    return ck.statistics(graph(s, d))


@reg("i16", "select conv_id, turn, case when trim(coalesce(text, '')) = '' then 'blank' when regexp_matches(upper(text), '\\b(CREATE|MERGE|DELETE|SET|REMOVE|DROP)\\b') then 'write' when not regexp_matches(upper(text), '\\bMATCH\\b') or not regexp_matches(upper(text), '\\bRETURN\\b') then 'no_match_return' end as reason from conversations where role = 'user'")
def i16(s, d):
    return ck.audit_query_log(table(s, d, "conversations").where("role = 'user'"), "text").select("conv_id", "turn", "reason")


# --- D: store
ROLES = """with r as (select l_orderkey as okey, l_suppkey as suppkey, case l_returnflag when 'R' then 'responsable' when 'A' then 'integrante' else 'otros' end as calidad, max(row(l_linestatus, l_linenumber, l_partkey)) as seq from lineitem group by all) """


@reg("d08", ROLES + "select okey, suppkey, calidad from r")
def d08(s, d):
    return participation(s, d).select("okey", "suppkey", "calidad")


@reg("d08_evidence", """with r as (select *, case l_returnflag when 'R' then 'responsable' when 'A' then 'integrante' else 'otros' end as calidad from lineitem)
select 'PARTICIPO_EN' as type, 'inv_' || l_suppkey as source_id, 'p_' || l_orderkey as target_id, calidad, null as texto from r group by all
union all select 'EXTRAIDO_DE', 't_' || l_orderkey || '#Chunk0', 'inv_' || l_suppkey, null, first(calidad || ' ' || l_linenumber order by l_linenumber, calidad) from r group by l_orderkey, l_suppkey""")
def d08_evidence(s, d):
    li = table(s, d, "lineitem")
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    role = F.when(F.col("l_returnflag") == "R", " Responsable").when(F.col("l_returnflag") == "A", "").otherwise("OTROS ")
    told = F.concat_ws(" ", tx.role(F.col("calidad")), F.col("seq").cast("string"))
    rows = li.select(key("p_", "l_orderkey").alias("project"), key("inv_", "l_suppkey").alias("researcher"), role.alias("calidad"), F.concat(key("t_", "l_orderkey"), F.lit("#Chunk0")).alias("chunk"), F.col("l_linenumber").alias("seq"))
    return ex.participation_edges(rows.withColumn("texto", told))


@reg("d12", ROLES + "select okey, suppkey, last(calidad order by seq, calidad) as calidad from r group by all")
def d12(s, d):
    p = participation(s, d).withColumn("at", F.struct("seq", "calidad"))
    return st.last_wins(p, ["okey", "suppkey"], "calidad", "at").drop("first")


@reg("d11", "with b as (select s_suppkey as id, 1 as seq, s_name as v from supplier union all select s_suppkey, 2, case when s_suppkey % 2 = 0 then '' else lower(s_name) end from supplier) select id, coalesce(max(case when seq = 2 then nullif(v, '') end), max(case when seq = 1 then v end)) as v from b group by id")
def d11(s, d):
    p = table(s, d, "supplier")
    b = p.select(F.col("s_suppkey").alias("id"), F.lit(1).alias("seq"), F.col("s_name").alias("v")).unionByName(p.select(F.col("s_suppkey").alias("id"), F.lit(2).alias("seq"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.lower("s_name")).alias("v")))
    return st.keep_filled(b, ["id"], "v", "seq")


@reg("d13", "with b as (select s_suppkey % 50 as id, case when s_suppkey % 3 = 0 then 'A' else 'B' end as label from supplier) select id, count(*) as n, case when count(distinct label) > 1 then 'cross' else 'same' end as kind from b group by id having count(*) > 1")
def d13(s, d):
    return st.duplicate_report(table(s, d, "supplier").select((F.col("s_suppkey") % 50).alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "A").otherwise("B").alias("label")))


@reg("d14", """with w as (select s_suppkey as id, s_suppkey % 4 = 2 as twice from supplier where s_suppkey % 4 <> 3)
select l_suppkey as source_id, l_suppkey + l_linenumber as target_id, case when a.id is null or z.id is null then 'inexistente' when a.twice or z.twice then 'ambiguo' else 'ok' end as status, count(*) as n
from lineitem left join w a on a.id = l_suppkey left join w z on z.id = l_suppkey + l_linenumber group by 1, 2, 3""")
def d14(s, d):
    """Ids in the batch and stored with two labels, stored with one, stored with two, and nowhere."""
    p = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"))
    batch = p.where("id % 4 = 0")
    stored = union(p.where("id % 4 <> 3").withColumn("label", F.lit("A")), p.where("id % 4 in (0, 2)").withColumn("label", F.lit("B")))
    e = table(s, d, "lineitem").select(F.lit("X").alias("type"), F.col("l_suppkey").alias("source_id"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("target_id"))
    return st.resolve(e, batch, stored).groupBy("source_id", "target_id", "status").agg(F.count("*").alias("n"))


@reg("d15", """, raw as (select 'PARTICIPO_EN' as type, 'inv_' || l_suppkey as source_id, case when l_suppkey = l_partkey then 'inv_' || l_suppkey when l_tax = 0 then 'inv_0' else pid end as target_id, row(l_linestatus, l_linenumber, l_partkey, l_extendedprice) as seq, l_partkey from lineitem join proj on okey = l_orderkey),
v as (select *, case when source_id = target_id then 'self' when target_id like 'inv_%' then 'illegal' end as bad, row_number() over (partition by type, source_id, target_id order by seq) as n from raw)
select coalesce(bad, case when n > 1 then 'repeated' else 'kept' end) as verdict, source_id, count(*) as n, cast(sum(l_partkey) as bigint) as parts from v group by 1, 2""", True)
def d15(s, d):
    li, p = table(s, d, "lineitem"), projects(s, d)
    inv = F.concat(F.lit("inv_"), F.col("l_suppkey").cast("string"))
    e = li.join(p, li.l_orderkey == p.okey).select(F.lit("PARTICIPO_EN").alias("type"), inv.alias("source_id"), F.when(F.col("l_suppkey") == F.col("l_partkey"), inv).when(F.col("l_tax") == 0, "inv_0").otherwise(F.col("pid")).alias("target_id"), F.struct("l_linestatus", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"))
    g = graph(s, d)
    return st.clean_edges(e, union(g.nodes_of("Proyecto", "Grupo"), g.nodes_of("Investigador")), schema.edge_endpoints(s), "seq").groupBy("verdict", "source_id").agg(F.count("*").alias("n"), F.sum("seq.l_partkey").alias("parts"))


@reg("d16", """with a as (select distinct l_suppkey as k from lineitem where l_linestatus = 'F' and l_returnflag = 'R'), b as (select distinct l_suppkey as k from lineitem where l_linestatus = 'O')
select coalesce(a.k, b.k) as id, case when b.k is null or b.k % 2 = 1 then case when a.k is not null then 'old' end end as x, case when b.k is not null then 'new' end as y, a.k is null as created from a full join b on a.k = b.k""")
def d16(s, d):
    li = table(s, d, "lineitem")
    a = li.where("l_linestatus = 'F' and l_returnflag = 'R'").select(F.col("l_suppkey").alias("id")).distinct().withColumn("props", F.create_map(F.lit("x"), F.lit("old")))
    b = li.where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("id")).distinct()
    b = b.withColumn("props", F.when(F.col("id") % 2 == 0, F.create_map(F.lit("x"), F.lit(None).cast("string"), F.lit("y"), F.lit("new"))).otherwise(F.create_map(F.lit("y"), F.lit("new"))))
    return st.upsert(a, b, ["id"]).select("id", F.col("props")["x"].alias("x"), F.col("props")["y"].alias("y"), "created")


@reg("d18", "select type as name, count(*) as n from edges where source_id <> 'inv_3' and target_id <> 'inv_3' group by type union all select label, count(*) from nodes where id <> 'inv_3' group by label", True)
def d18(s, d):
    g = graph(s, d)
    ns, es = st.delete_node(g.nodes, g.edges, "inv_3")
    return es.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).unionByName(ns.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")))


@reg("d17", """with a as (select distinct l_suppkey as k, l_partkey as p from lineitem where l_returnflag = 'R'), b as (select distinct l_suppkey as k, l_partkey as p from lineitem where l_returnflag = 'A' and l_suppkey % 3 <> 0 and l_partkey % 5 <> 0)
select 'X' as type, coalesce(a.k, b.k) as source_id, coalesce(a.p, b.p) as target_id, case when a.k is not null then 'old' end as x, case when b.k is not null then 'new' end as y, a.k is null as created from a full join b on a.k = b.k and a.p = b.p""")
def d17(s, d):
    li = table(s, d, "lineitem").select(F.lit("X").alias("type"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), "l_returnflag")
    of = lambda flag, k, v: li.where(F.col("l_returnflag") == flag).drop("l_returnflag").distinct().withColumn("props", F.create_map(F.lit(k), F.lit(v)))
    # sources and targets share one table of ids here, told apart by their kind
    kind = lambda e: e.withColumns({"source_id": F.concat(F.lit("s"), F.col("source_id")), "target_id": F.concat(F.lit("t"), F.col("target_id"))})
    ids = union(table(s, d, "supplier").where("s_suppkey % 3 <> 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id")), table(s, d, "part").where("p_partkey % 5 <> 0").select(F.concat(F.lit("t"), F.col("p_partkey")).alias("id")))
    out = st.upsert_edges(kind(of("R", "x", "old")), kind(of("A", "y", "new")), ids)
    back = lambda c: F.expr(f"cast(substr({c}, 2) as bigint)").alias(c)
    return out.select("type", back("source_id"), back("target_id"), F.col("props")["x"].alias("x"), F.col("props")["y"].alias("y"), "created")


@reg("d19", "select 'INICIO_EN' as type, pid as source_id, cast(year as varchar) as target_id, okey % 2 = 0 as turned from proj", True)
def d19(s, d):
    p = projects(s, d)
    y = F.col("year").cast("string")
    even = F.col("okey") % 2 == 0
    e = p.select(F.lit("INICIO_EN").alias("type"), F.when(even, y).otherwise(F.col("pid")).alias("source_id"), F.when(even, F.col("pid")).otherwise(y).alias("target_id"))
    g = graph(s, d)
    return st.repair_directions(e, union(g.nodes_of("Proyecto", "Grupo"), g.nodes_of("Anio")), schema.edge_endpoints(s))


D05 = """with r as (select 'f' as file, s_suppkey * 10 + i as row_number, case when s_suppkey % 7 = 0 and i = 1 then ' ' else s_suppkey::varchar end as documento, case when s_suppkey % 5 = 0 and i = 1 or s_suppkey % 11 = 0 or s_suppkey % 4 = 0 and i = 3 then null else 'ana' end as nombres, i from supplier, (values (1), (2), (3)) v(i)),
g as (select documento, min(row_number) as first from r where trim(documento) <> '' and nombres is not null group by 1)
select 'co_cc_' || documento as id, null as type, first as row_number, 'Ana Supplier' as display, 'ana supplier' as name from g
union all select null, 'MissingResearcherID', row_number, null, null from r where trim(documento) = ''
union all select 'co_cc_' || r.documento, 'MissingResearcherName', row_number, null, null from r left join g using (documento) where trim(r.documento) <> '' and nombres is null and (first is null or row_number < first)"""


@reg("d05", D05)
def d05(s, d):
    """Three rows a researcher: some lack their document, some their name before or after a good row."""
    k, i = F.col("s_suppkey"), F.col("i")
    r = table(s, d, "supplier").select(k, F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i"))
    nameless = ((k % 5 == 0) & (i == 1)) | (k % 11 == 0) | ((k % 4 == 0) & (i == 3))
    named = lambda x: F.when(~nameless, x)
    doc = F.when((k % 7 == 0) & (i == 1), F.lit(" ")).otherwise(k.cast("string"))
    rows = r.select(F.lit("f").alias("file"), (k * 10 + i).alias("row_number"), F.lit("CO").alias("pais"), F.lit("CC").alias("tipo"), doc.alias("documento"), named(F.lit("ana")).alias("nombres"), named(F.lit("SUPPLIER")).alias("apellidos"), F.lit("").alias("sexo"))
    good, bad = tb.researchers(rows)
    return union(good.select("id", F.lit(None).cast("string").alias("type"), "row_number", "display", "name"), bad.select("id", "type", "row_number", F.lit(None).cast("string").alias("display"), F.lit(None).cast("string").alias("name")))


@reg("d02", "select type, source_id, target_id from edges where type in ('PRIMER_CHUNK', 'DE_DOCUMENTO') union all select 'SIGUIENTE_CHUNK', a.chunk_id, b.chunk_id from chunk a join chunk b on a.doc_id = b.doc_id and b.pos = a.pos + 1", True)
def d02(s, d):
    return tb.chunk_edges(chunks(s, d).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc"), "pos", "chunk_id"))


D02 = """, f as (select *, case when doc_id % 9 = 4 and pos = 1 then 'InvalidChunk' when doc_id % 9 = 5 and pos in (0, 2) then 'InvalidChunkIndex' end as bad from chunk),
s as (select doc_id, min(pos) filter (bad is not null) as stop from f group by 1),
k as (select f.* from f join s using (doc_id) where (stop is null or pos < stop) and doc_id % 10 <> 3)
select 'PRIMER_CHUNK' as what, 'D' || doc_id as a, chunk_id as b, null as text from k where pos = 0
union all select 'SIGUIENTE_CHUNK', x.chunk_id, y.chunk_id, null from k x join k y on x.doc_id = y.doc_id and y.pos = x.pos + 1
union all select 'DE_DOCUMENTO', chunk_id, 'D' || doc_id, null from k
union all select 'Chunk', chunk_id, '[' || pos || ']', texto from k
union all select 'MissingDocumentForChunks', 'in/doc.' || doc_id || '.json', null, null from s where doc_id % 10 = 3
union all select bad, 'in/doc.' || doc_id || '.json', pos::varchar, null from f join s using (doc_id) where pos = stop and doc_id % 10 <> 3"""


@reg("d02_files", D02, True)
def d02_files(s, d):
    """Files of chunks: some whose document is not there, some that stop at a chunk that is none."""
    k = F.col("doc_id")
    name = F.concat(F.lit("in/doc."), k.cast("string"))
    bad = F.when((k % 9 == 4) & (F.col("pos") == 1), "InvalidChunk").when((k % 9 == 5) & F.col("pos").isin(0, 2), "InvalidChunkIndex")
    c = chunks(s, d).select(F.concat(name, F.lit(".json")).alias("file"), F.concat(name, F.lit(".pdf")).alias("source"), "pos", "chunk_id", F.col("texto").alias("text"), F.array(F.col("pos").cast("int")).alias("pages"), bad.alias("bad"))
    docs = table(s, d, "documents").where("doc_id % 10 <> 3").select(F.concat(F.lit("D"), k.cast("string")).alias("doc"), F.concat(F.lit("doc."), k.cast("string")).alias("basename"))
    nodes, edges, errors = tb.extract_chunks(c, docs)
    none = F.lit(None).cast("string")
    return union(edges.select(F.col("type").alias("what"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), none.alias("text")),
                 nodes.select(F.lit("Chunk").alias("what"), F.col("id").alias("a"), F.col("paginas").cast("string").alias("b"), F.col("texto").alias("text")),
                 errors.select(F.col("type").alias("what"), F.col("file").alias("a"), F.col("pos").cast("string").alias("b"), none.alias("text")))


@reg("d04", PATHS + "select path, y as year, k as form from p where k % 2 <> 0")
def d04(s, d):
    files = paths(s, d).select("path", F.col("y").cast("long").alias("year"), F.col("k").alias("form"))
    known = table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderkey").alias("form"))
    return st.admit(files, known)[1]


@reg("c11_c12", PATHS + """, m as (select k, lower(path) as low from p)
select k, (select min(nullif(strpos(low, w), 0)) - 1 from (values ('informe'), ('propuesta'), ('resumen')) x(w)) as at, case when contains(low, 'informe') or contains(low, 'propuesta') or contains(low, 'resumen') then 'narrative' else 'tabular' end as class from m""")
def c11_c12(s, d):
    return paths(s, d).select("k", tx.kind_position(F.col("path")).alias("at"), tx.narrative(F.col("path")).alias("class"))


@reg("d20", """with t as (select p_name, p_type, replace(p_name, ' ', '_') as t, replace(lower(p_type), ' ', '_') as s from part)
select 'node' as kind, 'Topico' as label, t as id, null as to, min(p_name) as display from t group by t union all select 'node', 'Subcampo', s, null, min(p_type) from t group by s
union all select distinct 'edge', 'PERTENECE_A_SUBCAMPO', t, s, null from t""")
def d20(s, d):
    # every topic twice, once in capitals: equal names collapse
    p = table(s, d, "part").select(F.col("p_name").alias("topic"), F.col("p_type").alias("subfield"))
    return ex.taxonomy_graph(union(p, p.withColumn("topic", F.initcap("topic")))).withColumn("display", F.when(F.col("label") == "Topico", F.lower("display")).otherwise(F.col("display")))


# --- A, B: sources and chunks
@reg("a05", "select 'f' as file, o_orderkey * 2 as row, o_orderkey || ',a b' as line from orders")
def a05(s, d):
    k = F.col("o_orderkey")
    lines = table(s, d, "orders").select(F.lit("f").alias("file"), F.explode(F.array(F.struct((k * 2).alias("line_no"), F.concat(k.cast("string"), F.lit(",a")).alias("line")), F.struct((k * 2 + 1).alias("line_no"), F.lit("b").alias("line")))).alias("x")).select("file", "x.*")
    return tb.repair_csv(lines)


@reg("a07", """with l as (select 'f' || (o_orderkey % 4) as file, o_orderkey as k, o_orderkey % 9 = 0 as bad from orders), b as (select *, row_number() over (partition by file order by k) as i from l where bad),
c as (select file, count(*) as rows, count(*) filter (bad) as wrong from l group by file), o as (select file, string_agg(k || ':2:3', ';' order by k) as offenders from b where i <= 5 group by file)
select file, rows, 3 as columns, wrong, wrong = 0 as valid, offenders, least(rows, 5) as sampled from c left join o using (file)""")
def a07(s, d):
    k = F.col("o_orderkey")
    lines = table(s, d, "orders").select(F.concat(F.lit("f"), (k % 4).cast("string")).alias("file"), k.alias("line_no"), F.when(k % 9 == 0, "1,2").otherwise('1,"a,b",3').alias("line"))
    told = F.array_join(F.transform("offenders", lambda x: F.concat_ws(":", x["line"].cast("string"), x["found"].cast("string"), x["expected"].cast("string"))), ";")
    return tb.audit_csv(lines, 3).withColumn("offenders", told).join(tb.sample_csv(lines).groupBy("file").agg(F.count("*").alias("sampled")), "file")


@reg("a08", "select o_orderkey, o_orderstatus, case when o_orderstatus = 'F' then 1 end as row_id from orders where o_orderstatus in ('F', 'O')")
def a08(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    m = tb.merge_csv(o.where("o_orderstatus = 'F'").withColumn("row_id", F.lit(1)), o.where("o_orderstatus in ('F', 'O')"))
    return m.select("o_orderkey", "o_orderstatus", "row_id")


STORES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@reg("a20", " union all ".join(f"select '{t}' as store, count(*) as n, count(*) = 0 as empty from {t}" for t in STORES))
def a20(s, d):
    return st.health({t: table(s, d, t) for t in STORES})


@reg("b03", "select doc_id, pos, chunk_id, texto, last from chunk", True)
def b03(s, d):
    return chunks(s, d)


@reg("b03_chunks", """with recursive i as (select 'c' || conv_id as doc, turn as pos, text, turn % 3 as page from conversations union all select 'd' || doc_id, 1, text, 0 from documents),
t as (select doc, pos, page, regexp_extract_all(text, '[^ \t\n\r]+') as w from i where pos > 0),
x as (select doc, pos, page, unnest(range(0, (len(w) + 299) // 300)) as part, w from t where len(w) > 0),
p as (select doc, pos, page, part, w[part * 300 + 1 : part * 300 + 300] as piece, row_number() over (partition by doc order by pos, part) as k from x),
g as (select doc, k, 0 as bin, len(piece) as used from p where k = 1 union all select p.doc, p.k, case when g.used + len(piece) > 300 then g.bin + 1 else g.bin end, case when g.used + len(piece) > 300 then len(piece) else g.used + len(piece) end from g join p on p.doc = g.doc and p.k = g.k + 1)
select doc, doc || '#chunk' || bin as chunk_id, string_agg(array_to_string(piece, ' '), ' ' order by k) as text, sum(len(piece))::bigint as tokens, array_to_string(list_sort(list(distinct page)), ',') as pages, any_value(h.text) as heading, 'text' as element
from g join p using (doc, k) left join (select doc, text from i where pos = 0) h using (doc) group by doc, bin""")
def b03_chunks(s, d):
    """Turns of a conversation below its first one, and whole documents, in chunks of 300 tokens."""
    c = table(s, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc"), F.col("turn").alias("pos"), F.when(F.col("turn") == 0, "section_header").alias("label"), "text", (F.col("turn") % 3).alias("page"))
    o = table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), F.lit(1).cast("long").alias("pos"), F.lit(None).cast("string").alias("label"), "text", F.lit(0).cast("long").alias("page"))
    return ex.chunk_items(union(c, o)).withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))


@reg("b04", "select 'part#Chunk' || p_partkey as chunk_id, 'p_name: ' || p_name || ' | p_brand: ' || p_brand as text, 5 + length(p_name) - length(replace(p_name, ' ', '')) + 1 - 1 as tokens from part")
def b04(s, d):
    p = table(s, d, "part").withColumns({"file": F.lit("part"), "p_empty": F.lit(" ")})
    return tb.row_chunks(p, ["p_name", "p_empty", "p_brand"], "file", "p_partkey").withColumn("tokens", F.col("tokens").cast("long"))


@reg("b07", "select doc_id, '<TITLE> ' || coalesce(nullif(trim(source), ''), 'NONE') || chr(10) || '<ABSTRACT> ' || left(trim(text, ' '), 2500) as input from documents")
def b07(s, d):
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("<TITLE> "), F.coalesce(tx.cell(F.col("source")), F.lit("NONE")), F.lit("\n<ABSTRACT> "), F.substring(F.trim("text"), 1, 2500)).alias("input"))


@reg("b08", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def b08(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


# --- E: topics
RAW = """with raw as (select o_custkey as project, l_orderkey as doc, l_orderkey || '#' || l_linenumber as chunk, p_name as topic, max(l_discount) as score, max(l_quantity) as logit from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey group by 1, 2, 3, 4),
tot as (select project, count(distinct chunk) as total from raw group by 1) """


def raw(s, d):
    """Dealt by order, which all keys but the project's hold: they are grouped where they lie."""
    li = table(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    n = li.count()
    named = dealt(li, n, "l_partkey").join(table(s, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
    t = dealt(named, n, "l_orderkey").join(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return t.groupBy(F.col("o_custkey").alias("project"), F.col("l_orderkey").alias("doc"), F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk"), F.col("p_name").alias("topic")).agg(F.max("l_discount").alias("score"), F.max("l_quantity").alias("logit"))


def totals(r):
    """Chunks of a project; a chunk is of one doc, so docs' counts add up."""
    return r.groupBy("project", "doc").agg(F.countDistinct("chunk").alias("n")).groupBy("project").agg(F.sum("n").alias("total"))


def by_project(s, d, rows):
    return dealt(rows, table(s, d, "lineitem").count(), "project")


@reg("e02", RAW + "select doc, chunk, topic, round(exp(logit - m) / z, 6) as p from (select doc, chunk, topic, logit, max(logit) over w as m, sum(exp(logit - 50)) over w * exp(50 - max(logit) over w) as z from raw window w as (partition by doc, chunk))")
def e02(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc", "chunk")
    r = raw(s, d).withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return r.select("doc", "chunk", "topic", F.round(F.col("e") / F.sum("e").over(w), 6).alias("p"))


DT = RAW + ", dt as (select project, doc, topic, count(*) as mentions, sum(logit) as logit, max(round(score, 4)) as best, min(chunk) as first_chunk from raw where score >= 0.08 group by 1, 2, 3) "


@reg("e03", DT + "select project, doc, topic, mentions, logit, best, first_chunk from dt")
def e03(s, d):
    return ev.doc_topics(raw(s, d), 0.08)


PT = DT + ", pt as (select project, topic, sum(mentions) as mentions, min(first_chunk) as first_chunk, round(sum(mentions) / any_value(total), 6) as coverage, round(sum(logit) / sum(mentions), 6) as confidence from dt join tot using (project) group by 1, 2) "


@reg("e04", PT + "select project, topic, mentions, first_chunk, coverage, confidence from pt")
def e04(s, d):
    r = raw(s, d)
    return ev.project_topics(by_project(s, d, ev.doc_topics(r, 0.08)), totals(r))


@reg("e05", PT + """, f as (select *, coverage >= 0.02 and confidence >= 30 as pass from pt), g as (select *, sum(pass::int) over (partition by project) as passed, row_number() over (partition by project, pass order by coverage desc, confidence desc, first_chunk, topic) as n from f)
select project, topic, not pass as fallback from g where pass or n <= 1 - passed""")
def e05(s, d):
    r = raw(s, d)
    return ev.select_topics(ev.project_topics(by_project(s, d, ev.doc_topics(r, 0.08)), totals(r)), 0.02, 30, 1)


GRID = [(f"{a}_{b}_{c}", a, b, c) for a in (0.05, 0.08) for b in (0.02, 0.2) for c in (20.0, 30.0)]


@reg("e08", RAW + ", grid(cfg, floor, cov, conf) as (values " + ", ".join(f"('{n}', {a}, {b}, {c})" for n, a, b, c in GRID) + """), s as (select cfg, cov, conf, project, topic, count(*) as m, sum(logit) as l from raw join grid on score >= floor group by all), pr as (select distinct cfg, project, topic from s join tot using (project) where m / total >= cov and l / m >= conf),
go as (select distinct cfg, o_custkey as project, p_name as topic from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey, grid where l_returnflag = 'R'),
b as (select cfg, sum((p.topic is not null and g.topic is not null)::int) as tp, sum((g.topic is null)::int) as fp, sum((p.topic is null)::int) as fn from pr p full join go g using (cfg, project, topic) group by cfg)
select cfg, tp, fp, fn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from b""")
def e08(s, d):
    r = raw(s, d)
    li = table(s, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_orderkey")
    n = li.count()
    named = dealt(li, n, "l_partkey").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_name").alias("topic"))
    gold = dealt(named, n, "l_orderkey").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("project"), "topic")
    gold = dealt(gold, table(s, d, "lineitem").count(), "project", "topic").distinct()
    return ev.sweep(by_project(s, d, r), totals(r), gold, s.createDataFrame(GRID, "cfg string, floor double, cov double, conf double"))


# --- J: evaluation
PG = "with p as (select distinct l_orderkey as k, l_suppkey as v, l_shipdate_y as y from (select *, l_orderkey % 10 as l_shipdate_y from lineitem) where l_returnflag <> 'N'), g as (select distinct l_orderkey as k, l_suppkey as v, l_orderkey % 10 as y from lineitem where l_linestatus = 'F'), b as (select y, sum((p.k is not null and g.k is not null)::int) as tp, sum((g.k is null)::int) as fp, sum((p.k is null)::int) as fn from p full join g using (k, v, y) group by y), j as (select *, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from b) "


def pair(s, d):
    c = [F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("v"), (F.col("l_orderkey") % 10).alias("y")]
    li = table(s, d, "lineitem")
    return li.where("l_returnflag <> 'N'").select(*c), li.where("l_linestatus = 'F'").select(*c)


@reg("j02", PG + "select y, tp, fp, fn, precision, recall, f1 from j")
def j02(s, d):
    return ev.compare(*pair(s, d), ["k", "v", "y"], ["y"])


@reg("j03", PG + "select coalesce(p.k, g.k) as k, coalesce(p.v, g.v) as v, case when p.k is null then 'FALTA EN PRED' when g.k is null then 'SOBRA EN PRED' else 'MATCH' end as status from p full join g on p.k = g.k and p.v = g.v")
def j03(s, d):
    return ev.diff(*pair(s, d), ["k", "v"])


@reg("j04", PG + "select round(avg(precision), 4) as precision, round(avg(recall), 4) as recall, round(avg(f1), 4) as f1, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from j")
def j04(s, d):
    return ev.macro(ev.compare(*pair(s, d), ["k", "v", "y"], ["y"]))


@reg("j09", "with u as (select doc_id from labels), c as (select sum((quality = 1 and toxic = 1)::int) as tp, sum((quality = 1 and toxic = 0)::int) as fp, sum((quality = 0 and toxic = 1)::int) as fn, count(*) filter (quality = 1 or toxic = 1) as n from labels) select tp, fp, fn, n - tp - fp - fn as tn from c")
def j09(s, d):
    x = table(s, d, "labels").select("doc_id", F.lit(1).alias("item"), "quality", "toxic")
    return ev.confusion(x.where("quality = 1").select("doc_id", "item"), x.where("toxic = 1").select("doc_id", "item"), "doc_id", "item")


EVT = "with e as (select event_type, user_id % 4 as model, value, event_type = 'error' as sentinel, event_id % 3 = 0 as is_right, cast(json_extract(props, '$.k') as bigint) as k from events), r as (select *, k % 5 as tp, k % 3 as fp, k % 4 as fn from e) "


def records(s, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(s, d, "events").select("event_type", (F.col("user_id") % 4).alias("model"), "value", (F.col("event_type") == "error").alias("sentinel"), (F.col("event_id") % 3 == 0).alias("right"), (k % 5).alias("tp"), (k % 3).alias("fp"), (k % 4).alias("fn"))


@reg("j13", EVT + """, f as (select *, case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1 from r)
select model, count(*) as n, sum(tp) filter (not sentinel) as tp, sum(fp) filter (not sentinel) as fp, sum(fn) filter (not sentinel) as fn, round(avg(f1) filter (not sentinel), 4) as f1, round(avg(case when sentinel then is_right::int else f1 end), 4) as quality, round(avg(is_right::int) filter (sentinel), 4) as sentinel_accuracy from f group by model""")
def j13(s, d):
    return ev.retrieval_summary(records(s, d), ["model"])


J13 = """with r as (select event_type as category, user_id % 4 as model, event_id % 10 = 0 as sentinel, event_id % 3 = 0 as is_right, event_id % 7 = 1 as chat, user_id % 3 as tp, event_id % 4 as fp, event_id % 2 as fn from events),
f as (select *, case when chat or tp + fp = 0 then 0 else tp / (tp + fp) end as p, case when chat or tp + fn = 0 then 0 else tp / (tp + fn) end as r, case when chat or 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1 from r)
select model, category, count(*) as n, sum(tp) filter (not sentinel) as tp, sum(fp) filter (not sentinel) as fp, sum(fn) filter (not sentinel) as fn, round(avg(f1) filter (not sentinel), 4) as f1, round(avg(case when sentinel then is_right::int else f1 end), 4) as quality,
round(avg(is_right::int) filter (sentinel), 4) as sentinel_accuracy, round(avg(p) filter (not sentinel), 4) as precision, round(avg(r) filter (not sentinel), 4) as recall, round(avg(case when sentinel then is_right::int else (p + r) / 2 end), 4) as by_category from f group by 1, 2"""


@reg("j13_categories", J13)
def j13_categories(s, d):
    """By model and category, with rows taken for small talk."""
    e, u = F.col("event_id"), F.col("user_id")
    r = table(s, d, "events").select(F.col("event_type").alias("category"), (u % 4).alias("model"), (e % 10 == 0).alias("sentinel"), (e % 3 == 0).alias("right"), (e % 7 == 1).alias("chat"), (u % 3).alias("tp"), (e % 4).alias("fp"), (e % 2).alias("fn"))
    return ev.retrieval_summary(r, ["model"], "category")


J03 = """with p as (select distinct l_orderkey as project, l_returnflag as kind, 't' || l_suppkey as id from lineitem where l_linenumber % 3 > 0), g as (select distinct l_orderkey as project, l_returnflag as kind, 't' || l_suppkey as id from lineitem where l_linenumber % 4 > 0),
i as (select coalesce(p.project, g.project) as project, coalesce(p.kind, g.kind) as kind, coalesce(p.id, g.id) as id, case when p.id is not null then '{"a":"' || p.id || '","b":"p"}' end as pred, case when g.id is not null then '{"a":"' || g.id || '","b":"g"}' end as gold from p full join g on p.project = g.project and p.kind = g.kind and p.id = g.id),
s as (select *, case when pred is null then 'FALTA EN PRED' when gold is null then 'SOBRA EN PRED' else 'MATCH' end as status from i),
c as (select project, count(*) filter (status = 'MATCH') as m, count(*) filter (status = 'FALTA EN PRED') as f, count(*) filter (status = 'SOBRA EN PRED') as x from s group by 1)
select project, kind, id, pred, gold, status, null as n, null as f1 from s union all select project, null, null, m::varchar, f::varchar, case when round(2 * m / (2 * m + f + x), 6) > 0.7 then 'good' else 'bad' end, x, round(2 * m / (2 * m + f + x), 6) from c"""


@reg("j03_report", J03)
def j03_report(s, d):
    """Topics of lines by project: items side by side, then the projects' counts and verdicts."""
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("project"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("id"), "l_linenumber")
    with_ = lambda of: F.create_map(F.lit("b"), F.lit(of), F.lit("a"), F.col("id")).alias("props")
    items, groups = ev.diff_report(li.where("l_linenumber % 3 > 0").select("project", "kind", "id", with_("p")), li.where("l_linenumber % 4 > 0").select("project", "kind", "id", with_("g")), ["project"], ["kind", "id"])
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    told = groups.select("project", null("string", "kind"), null("string", "id"), F.col("matches").cast("string").alias("pred"), F.col("missing").cast("string").alias("gold"), F.col("verdict").alias("status"), F.col("extra").alias("n"), "f1")
    return items.select("project", "kind", "id", "pred", "gold", "status", null("long", "n"), null("double", "f1")).unionByName(told)


J04 = """with p as (select distinct l_orderkey as project, l_returnflag as kind, l_suppkey as id from lineitem where l_linenumber % 3 > 0), g as (select distinct l_orderkey as project, l_returnflag as kind, l_suppkey as id from lineitem where l_linenumber % 4 > 0),
i as (select coalesce(p.project, g.project) as project, coalesce(p.kind, g.kind) as kind, p.id is not null as inp, g.id is not null as ing from p full join g on p.project = g.project and p.kind = g.kind and p.id = g.id),
c as (select project, kind, count(*) filter (inp and ing) as tp, count(*) filter (inp and not ing) as fp, count(*) filter (ing and not inp) as fn from i group by 1, 2),
s as (select *, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c)
select kind, round(avg(precision), 4) as precision, round(avg(recall), 4) as recall, round(avg(f1), 4) as f1, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from s group by kind"""


@reg("j04_labels", J04)
def j04_labels(s, d):
    """Means by kind, over the projects that have it."""
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("project"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("id"), "l_linenumber")
    scores = ev.compare(li.where("l_linenumber % 3 > 0"), li.where("l_linenumber % 4 > 0"), ["project", "kind", "id"], ["project", "kind"], 2 * li.count())
    return ev.macro(scores, by=["kind"])


@reg("j16", EVT + "select model, round(avg(value), 2) as mean, round(median(value), 2) as median, round(quantile_cont(value, 0.95), 2) as p95, count(*) as n from r group by model")
def j16(s, d):
    return ev.latency(records(s, d), "value", ["model"])


# --- H: vectors
KNN = "with s as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score from embeddings q, embeddings v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id {}), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) select query_id, rank, vec_id, score from r where rank <= {}"


@reg("h01", "with s as (select v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score from embeddings q, embeddings v where q.vec_id = 0 and v.vec_id <> 0) select 0 as query_id, row_number() over (order by score desc, vec_id) as rank, vec_id, score from s order by score desc, vec_id limit 5")
def h01(s, d):
    e = table(s, d, "embeddings")
    return vc.knn_join(e.where("vec_id = 0"), e, 5)


@reg("h02_h03", KNN.format("and v.label = 1 and round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) >= 0.1", 5))
def h02_h03(s, d):
    e = table(s, d, "embeddings")
    return vc.knn_join(e.where("vec_id % 100 = 0"), e, 5, 0.1, F.col("label") == 1)


@reg("h04", KNN.format("", 3))
def h04(s, d):
    e = table(s, d, "embeddings")
    return vc.knn_join(e.where("vec_id % 100 = 0"), e, 3)


@reg("h06_h07", "select vec_id, 'first' as source from embeddings where vec_id % 3 = 0 and vec_id % 2 <> 0")
def h06_h07(s, d):
    e = table(s, d, "embeddings")
    copy = lambda name, seq: e.where("vec_id % 3 = 0").select("vec_id", F.lit(seq).alias("seq"), F.lit(name).alias("source"))
    return st.insert_if_new(e.where("vec_id % 2 = 0"), union(copy("second", 2), copy("first", 1)), "vec_id", ["seq"]).select("vec_id", "source")


@reg("h08", "select len(embedding) as dim, count(*) as n, len(embedding) = 64 as ok from embeddings group by 1")
def h08(s, d):
    return vc.validate(table(s, d, "embeddings"), 64)


@reg("h08_batch", "select case when vec_id % 3 = 0 then 'made' else 'v' || vec_id end as id, vec_id as meta, null as error from embeddings where vec_id % 5 <> 1 and vec_id % 7 <> 2 union all select case when vec_id % 3 <> 0 then 'v' || vec_id end, null, case when vec_id % 5 = 1 then 'dimension' else 'metadata' end from embeddings where vec_id % 5 = 1 or vec_id % 7 = 2")
def h08_batch(s, d):
    """Vectors without ids get one of their own; some lack a component or their metadata."""
    k = F.col("vec_id")
    b = table(s, d, "embeddings").select(F.when(k % 3 != 0, F.concat(F.lit("v"), k.cast("string"))).alias("id"), F.when(k % 5 == 1, F.slice("embedding", 2, 3)).otherwise(F.col("embedding")).alias("embedding"), F.when(k % 7 != 2, F.struct("vec_id")).alias("metadata"))
    good, bad = vc.check_batch(b, 64)
    n = good.count()
    if good.select("id").distinct().count() != n:
        raise ValueError("ids repeat")
    made = F.when(F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "made").otherwise(F.col("id"))
    return union(good.select(made.alias("id"), F.col("metadata.vec_id").alias("meta"), F.lit(None).cast("string").alias("error")), bad.select("id", F.lit(None).cast("long").alias("meta"), "error"))


# --- G, K, L
@reg("g05", ", r as (select doc_id, pos, sum(length(texto)) over (partition by doc_id order by pos) as used from chunk) select doc_id, pos, used from r where used <= 12000", True)
def g05(s, d):
    return tb.pack_context(chunks(s, d), "doc_id", "pos", "texto", 12_000).select("doc_id", "pos", "used")


@reg("k01_turns", "with t as (select *, lead(role) over w as nr, lead(text) over w as nt from conversations window w as (partition by conv_id order by turn)) select conv_id, turn, text as query_text, case when nr = 'assistant' then nt end as response from t where role = 'user'")
def k01_turns(s, d):
    return tb.turns(table(s, d, "conversations"))


@reg("k03", "with t as (select *, lead(role) over w as nr, lead(text) over w as nt from conversations window w as (partition by conv_id order by turn)) select conv_id, turn from t where role = 'user' and (contains(lower(text), 'the') or contains(lower(case when nr = 'assistant' then nt end), 'the'))")
def k03(s, d):
    return tb.search_history(tb.turns(table(s, d, "conversations")), "the").select("conv_id", "turn")


@reg("k04", "select 'skipped' as outcome, null as type, count(distinct user_id) as n from events where event_type <> 'error' union all select 'error', 't' || (user_id % 3), count(*) from events where event_type = 'error' group by 2")
def k04(s, d):
    e = table(s, d, "events")
    skipped = e.where("event_type <> 'error'").select(F.col("user_id").cast("string").alias("path"))
    return st.ingest_report(skipped, e.where("event_type = 'error'").select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("type")))


@reg("l01", "select 'd' || doc_id as path, n_chars as size, case when doc_id % 3 = 0 then 'new' when doc_id % 3 = 1 then 'changed' else 'skip' end as action from documents")
def l01(s, d):
    f = table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), "doc_id")
    known = f.where("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 3 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return st.changed_files(f.drop("doc_id"), known)
