"""The history of questions over four tables: queries, their chunks and entities.

queries          id, type, query_text, cypher_query, response, created_at
chunks           id, query_id, chunk_id, chunk_text, score
graph_chunks     id, query_id, chunk_id, chunk_text, chunk_page
chunk_entities   id, query_id, chunk_id, entity_id, entity_label
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafita.sources import shared
from grafita.sources.shared import stored
from grafita.sources.versions import Store

#: Key columns of each table in a store.
KEYS = {"queries": ["id"], "chunks": ["query_id"], "graph_chunks": ["query_id"], "chunk_entities": ["query_id"]}
CHILDREN = ("chunks", "graph_chunks", "chunk_entities")
_ENTITIES = "array<struct<entity_id:string,entity_label:string>>"
_COLUMNS = {
    "queries": "type string, query_text string, cypher_query string, response string, created_at timestamp",
    "chunks": "chunk_id string, chunk_text string, score double",
    "graph_chunks": "chunk_id string, chunk_text string, chunk_page int",
    "chunk_entities": "chunk_id string, entity_id string, entity_label string",
}
_DIFFERS = "rows of the batch differ from one reading to the next"
#: The other spelling that a chunk's column may come in.
_SPELLINGS = {"chunk_id": "id", "chunk_text": "text", "chunk_page": "page"}


def nested_history(queries: DataFrame, chunks: DataFrame, graph_chunks: DataFrame, chunk_entities: DataFrame) -> DataFrame:
    """queries with ``chunks``: an array of id, chunk_id, chunk_text, chunk_page, score and entities.

    Plain chunks come first, then graph chunks, each by id.  Entities, by id, belong to the
    last graph chunk of their query and chunk_id (null ones equal each other); the other
    graph chunks have none, plain chunks a null.  Rows of a query that is not there are
    left out; a query without chunks has an empty array.  A query's chunks are one value,
    as many as its retrieval gave.
    """
    entity = F.struct("id", "entity_id", "entity_label")
    chunk = F.struct("id", "chunk_id", "chunk_text", "chunk_page")
    key = ["query_id", "chunk_id"]
    both = graph_chunks.select(*key, chunk.alias("c")).unionByName(chunk_entities.select(*key, entity.alias("e")), allowMissingColumns=True)
    tied = both.groupBy(*key).agg(F.collect_list("c").alias("cs"), F.max("c.id").alias("last"), F.array_sort(F.collect_list("e")).alias("es"))
    bare = F.transform("es", lambda e: F.struct(e["entity_id"].alias("entity_id"), e["entity_label"].alias("entity_label")))
    none = F.array().cast(_ENTITIES)
    names = ("id", "chunk_id", "chunk_text", "chunk_page", "score", "entities")
    item = lambda kind, *values: F.struct(F.lit(kind).alias("kind"), *[v.alias(n) for n, v in zip(names, values, strict=True)]).alias("x")
    c = [F.col(f"c.{n}") for n in names[:4]]
    owned = F.when(F.col("c.id") == F.col("last"), F.col("es")).otherwise(none)
    graph = tied.select("query_id", F.explode("cs").alias("c"), "last", bare.alias("es")).select("query_id", item(1, *c, F.lit(None).cast("double"), owned))
    p = [F.col(n) for n in names[:3]]
    plain = chunks.select("query_id", item(0, *p, F.lit(None).cast("int"), F.col("score").cast("double"), F.lit(None).cast(_ENTITIES)))
    # kind, then id: both are numbers, and ids of a kind differ
    ordered = F.array_sort(F.collect_list(F.struct(F.col("x.kind").alias("k"), F.col("x.id").alias("i"), "x")), lambda a, b: _compare(a, b))
    gathered = plain.unionByName(graph).groupBy(F.col("query_id").alias("__q")).agg(ordered.alias("xs"))
    xs = F.coalesce("xs", F.array().cast(gathered.schema["xs"].dataType))
    shown = F.transform(xs, lambda y: F.struct(*[y["x"][n].alias(n) for n in names]))
    return queries.join(gathered, F.col("id") == F.col("__q"), "left").withColumn("chunks", shown).drop("__q", "xs")


def _compare(a: Column, b: Column) -> Column:
    return F.when(a["k"] != b["k"], a["k"] - b["k"]).when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)


def numbered(rows: DataFrame, order: Sequence[str], start: int, name: str = "id", sums: Sequence[str] = ()) -> DataFrame:
    """rows with numbers from start + 1 on, in an order; range by range, so no task sees all rows.

    Each column among ``sums`` becomes its total over the rows before, in that order.  The
    rows are written once, as another run could draw other bounds.
    """
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    at = stored(at, plain=True).withColumn("__p", F.shiftright("__m", 33))
    sizes = at.groupBy("__p").agg(F.count("*").alias("__c"), *[F.sum(c).alias(f"__{c}") for c in sums])
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    before = sizes.select("__p", total("__c").alias("__o"), *[total(f"__{c}").alias(f"__{c}") for c in sums])
    place = F.col("__m") - F.shiftleft(F.col("__p"), 33) + F.col("__o") + F.lit(start + 1)
    inner = Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    run = {c: F.col(f"__{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in sums}
    out = at.join(F.broadcast(before), "__p").withColumn(name, place.cast("long"))
    return out.withColumns(run).drop("__m", "__p", "__o", *[f"__{c}" for c in sums])


def _filled(c: str, kind: str) -> Column:
    empty = F.lit(0) if kind in ("int", "double") else F.lit("")
    return F.nullif(F.col(c).cast(kind), empty)


def spelled(rows: DataFrame, columns: str) -> DataFrame:
    """ref, seq and the columns of a table; a chunk's may come in either spelling, the first that is filled."""
    out = []
    for name, kind in (x.split(" ") for x in columns.split(", ")):
        other = _SPELLINGS.get(name)
        here = [n for n in (name, other) if n in rows.columns]
        value = F.lit(None) if not here else F.coalesce(_filled(name, kind), F.col(other)) if len(here) == 2 else F.col(here[0])
        out.append(value.cast(kind).alias(name))
    return rows.select("ref", "seq", *out)


def append_history(store: Store, batch: dict[str, DataFrame]) -> DataFrame:
    """Adds questions and what belongs to them in one version; ref and the id that each got.

    batch: tables by name, any of the children missing.  Questions have ref, a name within
    the batch, and children the ref of their question; seq orders a ref's rows.  Ids follow
    the largest stored one.  Children whose ref is no question of the batch are left out.
    A second writer at the same time makes this one start again from the new ids.

    A child's id is the number of children of earlier questions, which the questions are
    numbered with, and its place in its own; so children are not put in one order.  They
    are read twice, and an error ends the call if they differ.
    """
    from grafita.sources.versions import Conflict, size

    kids = {n: spelled(batch[n], _COLUMNS[n]) for n in CHILDREN if n in batch}
    asked = _counted(spelled(batch["queries"], _COLUMNS["queries"]), kids)
    for _ in range(20):
        base = store.version()
        m = store.manifest(base)
        top = lambda n: (store.read(n, base).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if n in m["tables"] else 0)
        had = [f"n_{n}" for n in CHILDREN]
        new = numbered(asked.select("*", *[F.col(n).alias(h) for n, h in zip(CHILDREN, had, strict=True)]), ["ref", "seq"], top("queries"), sums=CHILDREN)
        ids = stored(new.select("ref", "id", *CHILDREN, *had), plain=True)
        sizes = ids.agg(F.count("*").alias("queries"), *[F.coalesce(F.sum(h), F.lit(0)).alias(n) for n, h in zip(CHILDREN, had, strict=True)]).first()
        parts = {"queries": store.part(new.select("id", *_names("queries")), KEYS["queries"], sizes["queries"])}
        for n in kids:
            mine = ids.where(f"n_{n} > 0").select("ref", F.col("id").alias("query_id"), F.col(n).alias("__before"), F.col(f"n_{n}").alias("__rows"))
            placed = _placed(kids[n], mine).withColumn("id", F.col("id") + F.lit(top(n)))
            parts[n] = store.part(placed.select("id", *_names(n), "query_id"), KEYS[n], sizes[n])
            if size(parts[n]) != sizes[n]:
                raise ValueError(_DIFFERS)
        for n, columns in _COLUMNS.items():
            schema = f"id long, {columns}" + (", query_id long" if n != "queries" else "")
            store.add(m, n, KEYS[n], schema, parts.get(n, {"buckets": {}}))
        try:
            store.commit(base, m)
        except Conflict:
            continue
        return ids.select("ref", "id")
    raise Conflict("20 tries")


def _names(table: str) -> list[str]:
    return [c.split(" ")[0] for c in _COLUMNS[table].split(", ")]


def _counted(queries: DataFrame, kids: dict[str, DataFrame]) -> DataFrame:
    """queries with the rows that their ref has in each table."""
    if not kids:
        return queries.select("*", *[F.lit(0).cast("long").alias(n) for n in CHILDREN])
    each = [df.select("ref", *[F.lit(int(n == t)).alias(n) for n in CHILDREN]) for t, df in kids.items()]
    counts = reduce(DataFrame.unionByName, each).groupBy("ref").agg(*[F.sum(n).alias(n) for n in CHILDREN])
    return queries.join(counts, "ref", "left").na.fill(0, list(CHILDREN))


def _placed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with query_id and their number by query_id and seq, from 1.

    ids: ref, query_id, and the rows of earlier questions (__before) and of this one
    (__rows).  Rows of a question that has too many for a task are numbered range by range.
    """
    at = lambda place: F.when(place <= F.col("__rows"), F.col("__before") + place).otherwise(F.raise_error(F.lit(_DIFFERS)).cast("long"))
    own = Window.partitionBy("query_id", "ref").orderBy("seq")
    many = F.col("__rows") > shared.TASK_ROWS
    theirs = ids.where(many)
    if not theirs.take(1):
        return rows.join(ids.hint("shuffle_hash"), "ref").withColumn("id", at(F.row_number().over(own)))
    few = rows.join(F.broadcast(theirs.select("ref").distinct()), "ref", "left_anti").join(ids.where(~many).hint("shuffle_hash"), "ref")
    w = Window.orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1)  # at most one row for TASK_ROWS children
    skip = theirs.withColumn("__skip", F.coalesce(F.sum("__rows").over(w), F.lit(0)))
    long = numbered(rows.join(F.broadcast(skip), "ref"), ["query_id", "seq"], 0, "__n")
    return few.withColumn("id", at(F.row_number().over(own))).unionByName(long.withColumn("id", at(F.col("__n") - F.col("__skip"))).drop("__n", "__skip"))


def delete_history(store: Store, ids: DataFrame | None = None) -> dict[str, int]:
    """Takes questions (id), or all, and all that belongs to them out in one version; rows gone by table."""
    if ids is None:
        return store.clear(*KEYS)
    gone = stored(ids.select("id").where("id is not null").distinct(), plain=True)
    child = gone.withColumnRenamed("id", "query_id")
    return store.remove({n: gone if n == "queries" else child for n in KEYS})
