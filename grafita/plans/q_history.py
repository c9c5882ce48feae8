"""Registered queries for the history and the store of versions."""
# ruff: noqa: ANN001, ANN201, ANN202

from __future__ import annotations

from pyspark.sql import functions as F

from grafita.operators import history as hi
from grafita.operators import search as se
from grafita.operators import store as st
from grafita.plans.derived import table, union
from grafita.plans.registrar import registrar
from grafita.sources import versions as vs
from grafita.sources.shared import shared_folder

QUERIES, ORACLE, reg = registrar()

LINES = "l as (select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as n from lineitem)"


def lines(s, d):
    """Order lines with a number each."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return hi.numbered(table(s, d, "lineitem").select(*order), order, 0, "n")


K01 = f"with {LINES}," + """ g as (select l_orderkey as q, n as id, case when l_suppkey % 3 > 0 then 'c' || l_suppkey % 3 end as c, l_partkey as p from l where l_linenumber % 2 = 0),
e as (select l_orderkey as q, n as id, case when l_suppkey % 3 > 0 then 'c' || l_suppkey % 3 end as c, 'e' || l_partkey as e from l),
ends as (select q, c, max(id) as id from g group by 1, 2),
owned as (select ends.id, string_agg(e.e, ' ' order by e.id) as es from ends join e on e.q = ends.q and e.c is not distinct from ends.c group by 1),
items as (select l_orderkey as q, 0 as kind, n as id, 'd' || l_suppkey as chunk_id, null as page, l_quantity as score, null as es from l where l_linenumber % 2 = 1
  union all select q, 1, g.id, c, p, null, coalesce(es, '') from g left join owned on owned.id = g.id)
select o_orderkey as id, o_orderstatus as type, (row_number() over (partition by q order by kind, items.id) - 1) as pos, chunk_id, page, cast(score as double) as score, es as entities
from orders left join items on q = o_orderkey where o_orderkey % 7 <> 0 and q is not null
union all select o_orderkey, o_orderstatus, null, null, null, null, null from orders where o_orderkey % 7 <> 0 and o_orderkey not in (select q from items)"""


@reg("k01", K01)
def k01(s, d):
    """Orders as questions, lines as chunks of both kinds; a chunk_id comes twice in many orders, and may be null."""
    li = lines(s, d).withColumnRenamed("n", "id")
    shared = F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string"))).alias("chunk_id")
    q = table(s, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"))
    base = [F.col("id"), F.col("l_orderkey").alias("query_id")]
    own = F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("chunk_id")
    plain = li.where("l_linenumber % 2 = 1").select(*base, own, F.lit("t").alias("chunk_text"), F.col("l_quantity").cast("double").alias("score"))
    graph = li.where("l_linenumber % 2 = 0").select(*base, shared, F.lit("t").alias("chunk_text"), F.col("l_partkey").cast("int").alias("chunk_page"))
    tied = li.select(*base, shared, F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("entity_id"), F.lit("Topico").alias("entity_label"))
    nested = hi.nested_history(q, plain, graph, tied)
    flat = nested.select("id", "type", F.posexplode_outer("chunks").alias("pos", "c"))
    names = F.array_join(F.transform("c.entities", lambda e: e["entity_id"]), " ")
    return flat.select("id", "type", F.col("pos").cast("long").alias("pos"), "c.chunk_id", F.col("c.chunk_page").cast("long").alias("page"), "c.score", names.alias("entities"))


A16 = f"with {LINES}," + """ q as (select o_orderkey as k, row_number() over (order by o_orderkey % 2, o_orderkey) as id, o_orderpriority as t from orders),
m as (select id as query_id, n, 'x' || l_suppkey as c, 'l' || l_partkey as t, n % 3 as page from l join q on k = l_orderkey),
a as (select 'queries' as tab, id, id as query_id, null as chunk_id, t as text, null as page from q
union all select 'chunks', row_number() over (order by query_id, n), query_id, c, t, null from m where n % 2 = 1
union all select 'graph_chunks', row_number() over (order by query_id, n), query_id, c, t, page from m where n % 2 = 0
union all select 'chunk_entities', row_number() over (order by query_id, n), query_id, c, t, null from m where n % 5 <= 2)
select tab, id, query_id, chunk_id, text, page, false as gone from a where query_id % 5 <> 0
union all select tab, count(*), null, null, null, null, true from a where query_id % 5 = 0 group by tab"""


@reg("a16_a17", A16)
def a16_a17(s, d):
    """Orders and lines as two batches over four tables, in both spellings; every fifth question goes, with all of its own."""
    store = vs.Store(s, shared_folder(s, "history"))
    # lines that these four columns do not tell apart are the same to all that follows
    o, order = table(s, d, "orders"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = hi.numbered(table(s, d, "lineitem").select(*order), order, 0, "n")
    for odd in (0, 1):
        mine = li.where(f"l_orderkey % 2 = {odd}").select(F.col("l_orderkey").alias("ref"), F.col("n").alias("seq"), F.concat(F.lit("x"), F.col("l_suppkey").cast("string")).alias("c"), F.concat(F.lit("l"), F.col("l_partkey").cast("string")).alias("t"))
        n = F.col("seq")
        either = F.when(n % 4 == 0, F.col("c"))
        graph = mine.where("seq % 2 = 0").select("ref", "seq", either.alias("chunk_id"), F.when(n % 4 != 0, F.col("c")).alias("id"), F.lit("").alias("chunk_text"), F.col("t").alias("text"), (n % 3).cast("int").alias("page"))
        batch = {
            "queries": o.where(f"o_orderkey % 2 = {odd}").select(F.col("o_orderkey").alias("ref"), F.lit(0).alias("seq"), F.col("o_orderpriority").alias("query_text")),
            "chunks": mine.where("seq % 2 = 1").select("ref", "seq", F.col("c").alias("id"), F.col("t").alias("text"), F.lit(0.5).alias("score")),
            "graph_chunks": graph,
            "chunk_entities": mine.where("seq % 5 <= 2").select("ref", "seq", F.col("c").alias("chunk_id"), F.col("t").alias("entity_id"), F.lit("Topico").alias("entity_label")),
        }
        hi.append_history(store, batch)
    gone = hi.delete_history(store, store.read("queries").where("id % 5 = 0").select("id"))
    none = F.lit(None).cast("string")
    parts = [store.read("queries").select(F.lit("queries").alias("tab"), "id", F.col("id").alias("query_id"), none.alias("chunk_id"), F.col("query_text").alias("text"), F.lit(None).cast("long").alias("page"))]
    for t, text, page in (("chunks", "chunk_text", F.lit(None)), ("graph_chunks", "chunk_text", F.col("chunk_page")), ("chunk_entities", "entity_id", F.lit(None))):
        parts.append(store.read(t).select(F.lit(t).alias("tab"), "id", "query_id", "chunk_id", F.col(text).alias("text"), page.cast("long").alias("page")))
    left = union(*parts).withColumn("gone", F.lit(False))
    counts = s.createDataFrame([(t, n, None, None, None, None, True) for t, n in gone.items() if n], left.schema)
    return left.unionByName(counts)


@reg("a16_one_table", "with h as (select event_id as id, event_type from events where event_id % 2 = 0), b as (select event_id, event_type, row_number() over (order by event_id) as n from events where event_id % 2 = 1) select id, event_type from h union all select (select max(id) from h) + n, event_type from b")
def a16_one_table(s, d):
    """Ids after the greatest stored one, given in an explicit order."""
    e = table(s, d, "events").select(F.col("event_id").alias("id"), "event_type")
    stored = e.where("id % 2 = 0")
    new = hi.numbered(e.where("id % 2 = 1").withColumnRenamed("id", "at"), ["at"], stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    return stored.unionByName(new.select("id", "event_type"))


A20 = """with n as (select 'nodes' as store, (select count(*) from part) as n union all select 'edges', (select count(*) from lineitem) union all select 'vectors', (select count(*) from embeddings))
select 'loaded' as step, store, n, n = 0 as empty from n union all select 'cleared', store, case when store = 'edges' then 0 else n end, store = 'edges' or n = 0 from n
union all select 'recreated', store, case when store = 'vectors' then (select count(*) from embeddings where vec_id % 2 = 0) when store = 'edges' then 0 else n end, store = 'edges' or n = 0 from n
union all select 'read', store, case when store = 'vectors' then (select count(*) from embeddings where vec_id % 2 = 0) when store = 'edges' then 0 else n end, store = 'edges' or n = 0 from n"""


@reg("a20_a21", A20)
def a20_a21(s, d):
    """An empty store is loaded once, then one table cleared and one made anew; counts from manifests, then from the tables."""
    store = vs.Store(s, shared_folder(s, "loaded"))
    names = ["nodes", "edges", "vectors"]
    v = table(s, d, "embeddings").select("vec_id", "embedding")

    def load():
        part, li = table(s, d, "part"), table(s, d, "lineitem")
        return {"nodes": (part.select("p_partkey", "p_name"), ["p_partkey"]), "edges": (li.select("l_orderkey", "l_partkey"), ["l_orderkey"]), "vectors": (v, ["vec_id"])}

    told = []
    for step in ("loaded", "cleared", "recreated"):
        store.bootstrap(load)  # the second and third time there is something
        if step == "cleared":
            store.clear("edges")
        if step == "recreated":
            store.recreate("vectors", vs.ddl(v), ["vec_id"])
            store.append({"vectors": (v.where("vec_id % 2 = 0"), ["vec_id"])})
        told.append(st.store_health(store, names).withColumn("step", F.lit(step)))
    told.append(st.health({n: store.read(n) for n in names}).withColumn("step", F.lit("read")))
    return union(*told).select("step", "store", "n", "empty")


@reg("l01_store", "select 'd' || doc_id as path, case when doc_id % 10 = 0 or doc_id % 7 = 0 then 'new' when doc_id % 3 = 1 then 'changed' else 'skip' end as action, n_chars + case when doc_id % 3 = 1 then 1 else 0 end as size from documents")
def l01_store(s, d):
    """Documents as files, twice: every tenth fails at first, every seventh comes later, every third has grown."""
    store = vs.Store(s, shared_folder(s, "files"))
    k = F.col("doc_id")
    f = table(s, d, "documents").select(k, F.concat(F.lit("d"), k.cast("string")).alias("path"), F.col("n_chars").alias("size"))
    work = lambda fails: lambda todo: todo.select("path", F.col("size").alias("v"), F.when(fails, "failed").alias("error"))
    st.ingest_changed(store, f.where("doc_id % 7 <> 0").select("path", "size"), work(F.col("path").endswith("0")))
    second = f.select("path", F.when(k % 3 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    told = st.ingest_changed(store, second, work(F.lit(False)))
    return told.join(store.read("rows").select("path", F.col("v").alias("size")), "path").select("path", "action", "size")


TERMS = ["rror", "THE", "worthless", "ñ", "no such phrase at all"]
K03 = "with t(term) as (values " + ", ".join(f"('{t}')" for t in TERMS) + ") select term, conv_id, turn from conversations, t where contains(lower(text), lower(term)) or contains(lower(role), lower(term))"


@reg("k03_index", K03)
def k03_index(s, d):
    """Turns of conversations, searched for a few terms by postings."""
    store = vs.Store(s, shared_folder(s, "search"))
    c = table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "conv_id", "turn", "role", "text")
    se.index_texts(store, c, "key", ["text", "role"])
    return union(*[se.search(store, t).select(F.lit(t).alias("term"), "conv_id", "turn") for t in TERMS])


@reg("f01_index", "with p as (select 'p' || p_partkey as id, p_name as name, p_type as display from part) select id, name from p where contains(lower(id), '19') or contains(lower(name), '19') or contains(lower(display), '19') union all select id, name from p where contains(lower(id), 'ring') or contains(lower(name), 'ring') or contains(lower(display), 'ring')")
def f01_index(s, d):
    """Nodes by id, name or display: a term too short for postings, and one that is not; the index is made in two parts."""
    store = vs.Store(s, shared_folder(s, "catalog"))
    p = table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("display"), "p_partkey")
    for odd in (0, 1):
        se.index_texts(store, p.where(f"p_partkey % 2 = {odd}").drop("p_partkey"), "id", ["id", "name", "display"], "nodes")
    return union(*[se.search(store, t, "nodes").select("id", "name") for t in ("19", "Ring")])
