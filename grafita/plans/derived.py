"""The property graph derived from the relational tables, as lazy DataFrames.

Orders are projects (urgent ones groups), suppliers researchers, part names topics, part
types subfields, market segments areas, and documents, cut into chunks of 50 words, the
evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafita.sources.shared import together


class Graph(NamedTuple):
    """nodes (label, id, name, display) and edges (type, source_id, target_id, prop).

    A graph kept by label and type tells how to make one of them alone, so that a question
    about two edge types plans those two and not a union of all.
    """

    nodes: DataFrame
    edges: DataFrame
    by_label: dict[str, Callable[[], DataFrame]] | None = None
    by_type: dict[str, Callable[[], DataFrame]] | None = None

    def nodes_of(self, *labels: str) -> DataFrame:
        if not labels:
            return self.nodes
        if self.by_label is None:
            return self.nodes.where(F.col("label").isin(*labels))
        parts = {id(self.by_label[x]): self.by_label[x] for x in labels}
        return union(*[f() for f in parts.values()]).where(F.col("label").isin(*labels))

    def edges_of(self, *types: str) -> DataFrame:
        if self.by_type is None:
            return self.edges.where(F.col("type").isin(*types))
        return union(*[self.by_type[t]() for t in types])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def projects(spark: SparkSession, sf: str) -> DataFrame:
    """okey, custkey, status, year, label, pid."""
    o = table(spark, sf, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    year = F.year("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), year.alias("year"),
        F.when(urgent, "Grupo").otherwise("Proyecto").alias("label"), F.concat_ws("_", F.when(urgent, "gi").otherwise("proy"), year.cast("string"), F.col("o_orderkey").cast("string")).alias("pid"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, pos, chunk_id, texto, last: windows of 50 space-separated words."""
    d = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("w"))
    n = F.ceil(F.size("w") / 50).cast("int")
    d = d.select("doc_id", "w", (n - 1).alias("last"), F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return d.select("doc_id", "pos", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("#chunk"), F.col("pos").cast("string")).alias("chunk_id"), F.array_join(F.slice("w", F.col("pos") * 50 + 1, F.lit(50)), " ").alias("texto"), "last")


def _node(df: DataFrame, label: object, id_: object, name: object, display: object) -> DataFrame:
    return df.select(label.alias("label"), id_.alias("id"), name.alias("name"), display.alias("display"))


def node_parts(spark: SparkSession, sf: str) -> dict[str, Callable[[], DataFrame]]:
    """How to make the nodes of each label; Proyecto and Grupo come together."""
    p = lambda: projects(spark, sf)
    part = lambda c: table(spark, sf, "part").select(c).distinct()
    seg = F.col("c_mktsegment")
    kind = F.get(F.array(*[F.lit(k) for k in ("informe", "propuesta", "resumen", "tabla")]), (F.col("doc_id") % 4).cast("int"))
    doc = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    year = F.col("year").cast("string")
    none = F.lit(None).cast("string")
    both = lambda: _node(p(), F.col("label"), F.col("pid"), F.col("pid"), F.col("pid"))
    return {
        "Proyecto": both, "Grupo": both,
        "Investigador": lambda: _node(table(spark, sf, "supplier"), F.lit("Investigador"), F.concat(F.lit("inv_"), F.col("s_suppkey").cast("string")), F.lower("s_name"), F.col("s_name")),
        "Topico": lambda: _node(part("p_name"), F.lit("Topico"), F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_name"), F.col("p_name")),
        "Subcampo": lambda: _node(part("p_type"), F.lit("Subcampo"), F.lower("p_type"), F.lower("p_type"), F.col("p_type")),
        "Area": lambda: _node(table(spark, sf, "customer").select("c_mktsegment").distinct(), F.lit("Area"), F.concat(F.lit("area_"), F.lower(seg)), F.lower(seg), seg),
        "Anio": lambda: _node(p().select("year").distinct(), F.lit("Anio"), year, year, year),
        "Documento": lambda: _node(table(spark, sf, "documents"), F.lit("Documento"), doc, kind, doc),
        "Chunk": lambda: _node(chunks(spark, sf), F.lit("Chunk"), F.col("chunk_id"), none, none),
    }


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return union(*[f() for k, f in node_parts(spark, sf).items() if k != "Grupo"])


def _role() -> Column:
    flag = F.col("l_returnflag")
    return F.when(flag == "R", "responsable").when(flag == "A", "integrante").otherwise("otros")


def participation(spark: SparkSession, sf: str) -> DataFrame:
    """okey, suppkey, calidad, seq: one row for each pair and role."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("okey"), F.col("l_suppkey").alias("suppkey"), _role().alias("calidad")).agg(F.max(F.struct("l_linestatus", "l_linenumber", "l_partkey")).alias("seq"))


def edge_parts(spark: SparkSession, sf: str) -> dict[str, Callable[[], DataFrame]]:
    """How to make the edges of each type; prop is the role of a participation, else null."""
    p, li, part, c = projects(spark, sf), table(spark, sf, "lineitem"), table(spark, sf, "part"), chunks(spark, sf)
    topic = F.replace("p_name", F.lit(" "), F.lit("_"))
    doc = lambda x: F.concat(F.lit("doc_"), x.cast("string"))
    none = F.lit(None).cast("string")
    edge = lambda df, t, s, d, prop=none: df.select(F.lit(t).alias("type"), s.alias("source_id"), d.alias("target_id"), prop.alias("prop"))
    here, there = F.col("chunk_id"), F.concat(doc(F.col("doc_id")), F.lit("#chunk"), (F.col("pos") + 1).cast("string"))

    def numbered(df: DataFrame, key: str) -> DataFrame:
        # one value of a scalar: the number of documents
        n = table(spark, sf, "documents").agg(F.count("*").alias("n"))
        return df.join(F.broadcast(n)).withColumn("k", F.col(key) % F.col("n"))

    def participates() -> DataFrame:
        # the last role of a pair, from its lines at once
        # dealt by order once, for the pairs and for the orders' own rows
        pair = together(li, li.count(), "l_orderkey").groupBy(F.col("l_orderkey").alias("okey"), F.col("l_suppkey").alias("suppkey")).agg(F.max(F.struct("l_linestatus", "l_linenumber", "l_partkey", _role().alias("calidad")))["calidad"].alias("calidad"))
        return edge(pair.join(p, "okey"), "PARTICIPO_EN", F.concat(F.lit("inv_"), F.col("suppkey").cast("string")), F.col("pid"), F.col("calidad"))

    def has_topic() -> DataFrame:
        # dealt by order once, for the distinct topics and for the orders' own rows
        seen = together(li.join(part, li.l_partkey == part.p_partkey).select("l_orderkey", topic.alias("t")), li.count(), "l_orderkey").distinct()
        return edge(seen.join(p, F.col("l_orderkey") == F.col("okey")), "TIENE_TOPICO", F.col("pid"), F.col("t"))

    def extracted() -> DataFrame:
        # dealt by document once, a row a line
        seen = numbered(li.where("l_returnflag <> 'N'").join(part, li.l_partkey == part.p_partkey), "l_orderkey").select("k", F.concat(F.lit("inv_"), F.col("l_suppkey").cast("string")).alias("i"), topic.alias("t"))
        pairs = together(seen, li.count(), "k").select("k", F.explode(F.array("i", "t")).alias("t")).distinct()
        return edge(pairs, "EXTRAIDO_DE", F.concat(doc(F.col("k")), F.lit("#chunk0")), F.col("t"))

    def titled() -> DataFrame:
        t = F.concat(doc(F.when(F.col("status") == "F", F.col("k")).otherwise((F.col("k") + 1) % F.col("n"))), F.lit("#chunk0"))
        return edge(numbered(p, "okey").where("status <> 'P'"), "TITULO_EXTRAIDO_DE", F.col("pid"), t)

    return {
        "PARTICIPO_EN": participates,
        "TIENE_TOPICO": has_topic,
        "PERTENECE_A_SUBCAMPO": lambda: edge(part.select(topic.alias("t"), F.lower("p_type").alias("s")).distinct(), "PERTENECE_A_SUBCAMPO", F.col("t"), F.col("s")),
        "PERTENECE_A_AREA": lambda: edge(p.join(table(spark, sf, "customer"), F.col("custkey") == F.col("c_custkey")), "PERTENECE_A_AREA", F.col("pid"), F.concat(F.lit("area_"), F.lower("c_mktsegment"))),
        "INICIO_EN": lambda: edge(p, "INICIO_EN", F.col("pid"), F.col("year").cast("string")),
        "ES_DESCRITO_POR": lambda: edge(numbered(p, "okey"), "ES_DESCRITO_POR", F.col("pid"), doc(F.col("k"))),
        "PRIMER_CHUNK": lambda: edge(c.where("pos = 0"), "PRIMER_CHUNK", doc(F.col("doc_id")), here),
        "DE_DOCUMENTO": lambda: edge(c, "DE_DOCUMENTO", here, doc(F.col("doc_id"))),
        # every 97th document lacks its first link, every 101st ends in a cycle
        "SIGUIENTE_CHUNK": lambda: union(
            edge(c.where("pos < last and not (pos = 0 and doc_id % 97 = 0)"), "SIGUIENTE_CHUNK", here, there),
            edge(c.where("pos = last and pos > 0 and doc_id % 101 = 0"), "SIGUIENTE_CHUNK", here, F.concat(doc(F.col("doc_id")), F.lit("#chunk0"))),
        ),
        "EXTRAIDO_DE": extracted,
        "TITULO_EXTRAIDO_DE": titled,
    }


def graph(spark: SparkSession, sf: str) -> Graph:
    types = edge_parts(spark, sf)
    return Graph(nodes(spark, sf), union(*[f() for f in types.values()]), node_parts(spark, sf), types)


#: The same graph for DuckDB.
SQL = """
with recursive nn as (select count(*) as n from documents),
proj as (select o_orderkey as okey, o_custkey as custkey, o_orderstatus as status, year(o_orderdate) as year,
  case when o_orderpriority = '1-URGENT' then 'Grupo' else 'Proyecto' end as label,
  case when o_orderpriority = '1-URGENT' then 'gi_' else 'proy_' end || year(o_orderdate) || '_' || o_orderkey as pid from orders),
ws as (select doc_id, string_split(text, ' ') as w from documents where text is not null),
wn as (select doc_id, w, cast(ceil(len(w) / 50.0) as integer) - 1 as last from ws),
chunk as (select doc_id, pos, 'doc_' || doc_id || '#chunk' || pos as chunk_id, array_to_string(w[pos * 50 + 1 : pos * 50 + 50], ' ') as texto, last
  from (select doc_id, w, last, unnest(range(0, last + 1)) as pos from wn)),
nodes as (
  select label, pid as id, pid as name, pid as display from proj
  union all select 'Investigador', 'inv_' || s_suppkey, lower(s_name), s_name from supplier
  union all select distinct 'Topico', replace(p_name, ' ', '_'), p_name, p_name from part
  union all select distinct 'Subcampo', lower(p_type), lower(p_type), p_type from part
  union all select distinct 'Area', 'area_' || lower(c_mktsegment), lower(c_mktsegment), c_mktsegment from customer
  union all select distinct 'Anio', cast(year as varchar), cast(year as varchar), cast(year as varchar) from proj
  union all select 'Documento', 'doc_' || doc_id, case doc_id % 4 when 0 then 'informe' when 1 then 'propuesta' when 2 then 'resumen' else 'tabla' end, 'doc_' || doc_id from documents
  union all select 'Chunk', chunk_id, null, null from chunk),
part_role as (select l_orderkey as okey, l_suppkey as suppkey, case l_returnflag when 'R' then 'responsable' when 'A' then 'integrante' else 'otros' end as calidad,
  max(row(l_linestatus, l_linenumber, l_partkey)) as seq from lineitem group by all),
part_pair as (select okey, suppkey, calidad from part_role qualify row_number() over (partition by okey, suppkey order by seq desc, calidad desc) = 1),
evid as (select distinct 'doc_' || (l_orderkey % n) || '#chunk0' as c, unnest(['inv_' || l_suppkey, replace(p_name, ' ', '_')]) as t from lineitem join part on l_partkey = p_partkey, nn where l_returnflag <> 'N'),
edges as (
  select 'PARTICIPO_EN' as type, 'inv_' || suppkey as source_id, pid as target_id, calidad as prop from part_pair join proj using (okey)
  union all select distinct 'TIENE_TOPICO', pid, replace(p_name, ' ', '_'), null from lineitem join part on l_partkey = p_partkey join proj on l_orderkey = okey
  union all select distinct 'PERTENECE_A_SUBCAMPO', replace(p_name, ' ', '_'), lower(p_type), null from part
  union all select 'PERTENECE_A_AREA', pid, 'area_' || lower(c_mktsegment), null from proj join customer on custkey = c_custkey
  union all select 'INICIO_EN', pid, cast(year as varchar), null from proj
  union all select 'ES_DESCRITO_POR', pid, 'doc_' || (okey % n), null from proj, nn
  union all select 'PRIMER_CHUNK', 'doc_' || doc_id, chunk_id, null from chunk where pos = 0
  union all select 'DE_DOCUMENTO', chunk_id, 'doc_' || doc_id, null from chunk
  union all select 'SIGUIENTE_CHUNK', chunk_id, 'doc_' || doc_id || '#chunk' || (pos + 1), null from chunk where pos < last and not (pos = 0 and doc_id % 97 = 0)
  union all select 'SIGUIENTE_CHUNK', chunk_id, 'doc_' || doc_id || '#chunk0', null from chunk where pos = last and pos > 0 and doc_id % 101 = 0
  union all select 'EXTRAIDO_DE', c, t, null from evid
  union all select 'TITULO_EXTRAIDO_DE', pid, 'doc_' || (case status when 'F' then okey % n else (okey % n + 1) % n end) || '#chunk0', null from proj, nn where status <> 'P')
"""
