"""Nodes and edges out of project rows, file names and chosen topics.

Project rows have file, row_number, row_id, id_formulario, anio, tipo_archivo, titulo,
descripcion, palabras_claves, palabras_claves2, palabras_claves3 and area, all strings but
row_number.  Whatever comes first in (file, row_number) wins, in one aggregation that
combines before it shuffles, so a project with very many rows is no hot task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafita.functions import text as tx
from grafita.operators.ordered import next_at_least, reachable, running
from grafita.sources.shared import cut

#: The columns a project row must fill, and those with its keywords.
REQUIRED = ("id_formulario", "anio", "titulo")
KEYWORDS = ("palabras_claves", "palabras_claves2", "palabras_claves3")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def edge(df: DataFrame, kind: str, source: str, target: str) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), F.col(source).alias("source_id"), F.col(target).alias("target_id"))


def project_rows(rows: DataFrame) -> DataFrame:
    """rows with trimmed cells, the project's pid and label, and error: MissingProjectID, MissingAreaID or null.

    Blank cells become null.  A row without a project id has no pid.
    """
    names = [*REQUIRED, "tipo_archivo", "descripcion", *KEYWORDS, "area"]
    r = rows.withColumns({c: tx.cell(F.col(c)) for c in names})
    group = F.coalesce(F.col("tipo_archivo") == "Grupo", F.lit(False))
    lacking = F.col("id_formulario").isNull() | F.col("anio").isNull() | F.col("titulo").isNull()
    pid = F.when(~lacking, tx.project_id(group, F.col("anio"), F.col("id_formulario")))
    return r.withColumns({
        "pid": pid, "label": F.when(group, "Grupo").otherwise("Proyecto"),
        "error": F.when(lacking, "MissingProjectID").when(F.col("area").isNull(), "MissingAreaID"),
    })


def projects(rows: DataFrame) -> DataFrame:
    """label, id, titulo, titulo_de_despliegue, palabras_clave, descripcion: the first row of each project."""
    r = project_rows(rows).where("pid is not null")
    words = F.filter(F.array(*KEYWORDS), lambda x: x.isNotNull())
    return first_row(r, ["pid"], ["file", "row_number"]).select("label", F.col("pid").alias("id"), tx.fold(F.col("titulo")).alias("titulo"), F.col("titulo").alias("titulo_de_despliegue"), words.alias("palabras_clave"), "descripcion")


def areas_and_years(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, id, valor) and edges; a row without an area gives neither area nor year."""
    r = project_rows(rows).where("error is null").withColumn("area_id", tx.area_id(F.col("area")))
    area = first_row(r.select(F.col("area_id").alias("id"), tx.fold(F.col("area")).alias("valor"), "file", "row_number"), ["id"], ["file", "row_number"])
    year = r.select(F.lit("Anio").alias("label"), F.col("anio").alias("id"), F.col("anio").alias("valor")).distinct()
    nodes = area.select(F.lit("Area").alias("label"), "id", "valor").unionByName(year)
    return nodes, edge(r, "PERTENECE_A_AREA", "pid", "area_id").unionByName(edge(r, "INICIO_EN", "pid", "anio")).distinct()


def title_evidence(rows: DataFrame) -> DataFrame:
    """The chunk and the table that a project's title comes from, of its first row in all files."""
    r = project_rows(rows).where("pid is not null").select("pid", "file", "row_number", "row_id")
    r = first_row(r, ["pid"], ["file", "row_number"]).withColumn("chunk", F.concat("file", F.lit("#Chunk"), F.coalesce("row_id", F.lit("None"))))
    return edge(r, "TITULO_EXTRAIDO_DE", "pid", "chunk").unionByName(edge(r, "ES_DESCRITO_POR", "pid", "file"))


def from_directory(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (label, id), edges and error rows (file, row_number, error) of all files."""
    nodes, edges = areas_and_years(rows)
    nodes = projects(rows).select("label", "id").unionByName(nodes.select("label", "id"))
    return nodes, edges.unionByName(title_evidence(rows)), project_rows(rows).where("error is not null").select("file", "row_number", "error")


def documents(files: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Document nodes, ES_DESCRITO_POR edges and errors (name, error) of files (name).

    Table files (csv, xlsx) match any name and are of kind tabla.  Narrative files must
    have a document's name, and their project's key must be an id_archivo of the rows.
    Errors: extension, name, key.
    """
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    base = F.regexp_replace("name", r"\.[^.]+$", "")
    f = files.select("name", base.alias("id"), ext.alias("ext"), tx.document_name(base).alias("n"))
    f = f.withColumns({"is_table": F.col("ext").isin("csv", "xlsx"), "narrative": F.col("ext").isin("pdf", "docx", "html", "md", "txt"), "key": F.when(F.col("n.sub_id") != "", F.concat_ws("_", "n.grupo", "n.anio", "n.sub_id"))})
    known = rows.select(F.col("id_archivo").cast("string").alias("key")).distinct().withColumn("known", F.lit(True))
    f = f.join(known, "key", "left")
    error = F.when(F.col("is_table"), None).when(~F.col("narrative"), "extension").when(F.col("key").isNull(), "name").when(F.col("known").isNull(), "key")
    f = f.withColumn("error", error)
    good = f.where("error is null")
    nodes = good.select(F.col("id"), F.when(F.col("is_table"), "tabla").otherwise(F.col("n.tipo")).alias("tipo"), F.when(~F.col("is_table"), F.col("n.grupo")).alias("es_grupo"), F.when(~F.col("is_table"), F.col("n.anio")).alias("anio_publicacion"), F.when(~F.col("is_table"), F.col("n.sub_id")).alias("sub_id"))
    return nodes, edge(good.where("not is_table"), "ES_DESCRITO_POR", "key", "id"), f.where("error is not null").select("name", "error")


def project_keys(docs: DataFrame) -> DataFrame:
    """The keys of all documents that are no tables."""
    return docs.where("tipo <> 'tabla'").select(F.concat_ws("_", "es_grupo", "anio_publicacion", "sub_id").alias("key")).distinct()


def align_taxonomy(one: DataFrame, other: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """name and translated: two taxonomies matched by position; of repeated names the last position counts."""
    a = one.select(*keys, F.trim(name).alias("name")).where("name <> ''")
    b = other.select(*keys, F.trim(name).alias("translated")).where("translated <> ''")
    return a.join(b, list(keys)).groupBy("name").agg(F.max_by("translated", F.struct(*keys)).alias("translated"))


def topic_edges(selected: DataFrame, mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    """TIENE_TOPICO edges with four properties and one EXTRAIDO_DE for each mention, ids in the mapped language.

    selected: project, topic, coverage, confidence, mentions, fallback; mentions: project,
    topic, chunk; mapping: topic, translated.  A topic without a translation keeps its name.
    """
    s = selected.join(mapping, "topic", "left").withColumn("tid", tx.taxonomy_id(F.coalesce("translated", "topic")))
    has = s.select(F.lit("TIENE_TOPICO").alias("type"), F.col("project").alias("source_id"), F.col("tid").alias("target_id"), "coverage", "confidence", "mentions", "fallback")
    told = mentions.join(s.select("project", "topic", "tid"), ["project", "topic"]).select(F.lit("EXTRAIDO_DE").alias("type"), F.col("chunk").alias("source_id"), F.col("tid").alias("target_id")).distinct()
    return has.unionByName(told, allowMissingColumns=True)


def pending_docs(docs: DataFrame, registry: DataFrame, label: str, most: int | None = None) -> DataFrame:
    """Documents (project, doc) not yet done for a label, of the first ``most`` projects by name if given."""
    left = docs.join(registry.where(F.col("label") == label).select("doc").distinct(), "doc", "left_anti")
    if most is None:
        return left
    first = left.select("project").distinct().orderBy("project").limit(most)
    return left.join(first, "project", "left_semi")


def mark_done(registry: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """The registry with the documents done for a label."""
    new = docs.select("doc", F.lit(label).alias("label")).distinct().join(registry, ["doc", "label"], "left_anti")
    return registry.unionByName(new, allowMissingColumns=True)


def promote_headings(items: DataFrame) -> DataFrame:
    """items (doc, pos, label, level) with new_level: within a run of headings one more each than the one before.

    A heading without a level and any other item end a run.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    heads = (F.col("label") == "section_header") & F.col("level").isNotNull()
    t = items.withColumn("__h", F.coalesce(heads, F.lit(False)))
    t = t.withColumn("__run", F.sum((~F.col("__h")).cast("int")).over(w))
    r = Window.partitionBy("doc", "__run", "__h").orderBy("pos")
    return t.withColumn("new_level", F.when(F.col("__h"), F.first("level").over(r) + F.row_number().over(r) - 1).otherwise(F.col("level"))).drop("__h", "__run")


def nesting(items: DataFrame, limit: int = 64) -> int:
    """How many levels of groups the items (doc, item, parent) have; an error beyond ``limit``, as in a cycle."""
    links = items.where("parent is not null").select("doc", "item", "parent")
    level, depth = links, 0
    while not level.isEmpty():
        depth += 1
        if depth > limit:
            raise ValueError(f"items are nested more than {limit} levels deep, or in a cycle")
        level = links.join(level.select("doc", F.col("item").alias("parent")).distinct(), ["doc", "parent"], "left_semi")
    return depth


def order_layout(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """items (doc, item, parent, pos) with place: top-level items by (page, -top, left) of their highest box.

    boxes: doc, item, page, top, left.  A group without a box takes the least key of what
    it holds, at whatever depth; items without any key come last, in their own order.
    """
    key = F.struct("page", (-F.col("top")).alias("up"), "left")
    own = boxes.groupBy("doc", "item").agg(F.max_by(key, F.struct("top", (-F.col("page")).alias("p"), (-F.col("left")).alias("l"))).alias("own"))
    keys = items.select("doc", "item", "parent").join(own, ["doc", "item"], "left").withColumn("key", F.col("own"))
    for _ in range(nesting(items)):
        up = keys.where("parent is not null").groupBy("doc", F.col("parent").alias("item")).agg(F.min("key").alias("below"))
        keys = keys.drop("key").join(up, ["doc", "item"], "left").select("doc", "item", "parent", "own", F.coalesce("own", "below").alias("key"))
    top = items.where("parent is null").join(keys.select("doc", "item", "key"), ["doc", "item"])
    w = Window.partitionBy("doc").orderBy(F.col("key").asc_nulls_last(), "pos")
    return top.select("doc", "item", (F.row_number().over(w) - 1).alias("place"))


def _bins(most: int):  # noqa: ANN202
    """Adds bin to pieces in order, documents one after the other: a new one for each heading, and where a piece would go beyond ``most`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, scope, number, used = object(), None, -1, 0  # a document may go on in the next batch
        for b in batches:
            out = []
            for d, s, n in zip(b["doc"].to_pylist(), b["scope"].to_pylist(), b["tokens"].to_pylist(), strict=True):
                if d != doc:
                    doc, scope, number = d, None, -1
                if s != scope or used + n > most:
                    number, scope, used = number + 1, s, 0
                used += n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "bin"])

    return run


def chunk_items(items: DataFrame, most: int = 300, whole: int = 100_000) -> DataFrame:
    """doc, chunk_id, text, tokens, pages, heading and element of chunks of at most ``most`` tokens.

    items: doc, pos, label, text, page.  A section_header opens a scope, is the heading of
    its chunks and not part of their text.  An item with more tokens than ``most`` is cut;
    neighbours of one scope are merged as long as they fit.  element is the label of the
    first item (text if it has none).  Tokens are runs without white space.  A task gets
    documents of at most ``whole`` items one after the other; longer ones, which give the same
    chunks, are dealt over many tasks (``long_bins``).
    """
    big = cut(items.groupBy(F.col("doc").alias("__d")).count().where(F.col("count") > whole).select("__d"))
    long_ = big.count() > 0
    head = F.coalesce(F.col("label") == "section_header", F.lit(False))

    def pieces(t: DataFrame) -> DataFrame:
        """Items with a scope as pieces of at most ``most`` tokens."""
        plain = F.replace(F.replace(F.replace("text", F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
        t = t.where(~head & F.col("text").rlike(r"[^ \t\n\r]")).withColumn("w", F.array_remove(F.split(plain, " "), ""))
        cuts = F.sequence(F.lit(0), F.ceil(F.size("w") / most).cast("int") - 1)
        each = F.transform(cuts, lambda i: F.struct(F.array_join(F.slice("w", i * most + 1, most), " ").alias("piece"), F.least(F.lit(most), F.size("w") - i * most).alias("tokens")))
        return t.select("doc", "scope", "heading", "pos", F.coalesce("label", F.lit("text")).alias("label"), "page", F.posexplode(each).alias("part", "x")).select("doc", "scope", "heading", "pos", "label", "page", "part", "x.piece", "x.tokens")

    w = Window.partitionBy("doc").orderBy("pos")
    short = (items.join(big, F.col("doc") == F.col("__d"), "left_anti") if long_ else items).repartition("doc")
    t = pieces(short.withColumn("scope", F.sum(head.cast("int")).over(w)).withColumn("heading", F.last(F.when(head, F.col("text")), ignorenulls=True).over(w)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema)
    t = t.sortWithinPartitions("doc", "scope", "pos", "part").mapInArrow(_bins(most), f"{fields}, bin int")
    if long_:
        few = items.join(big, F.col("doc") == F.col("__d"), "left_semi").select("doc", "pos", "label", "text", "page")
        scoped = running(few, ["doc"], ["pos"], {"scope": head.cast("long")}, {"heading": F.when(head, F.col("text"))})
        t = t.unionByName(long_bins(pieces(scoped), most).select(*[F.col(f.name).cast(f.dataType) for f in t.schema]))
    place = F.struct("pos", "part")
    c = t.groupBy("doc", "bin").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "piece"))), lambda x: x["piece"]), " ").alias("text"),
        F.sum("tokens").alias("tokens"), F.array_sort(F.collect_set("page")).alias("pages"), F.min_by("heading", place).alias("heading"), F.min_by("label", place).alias("element"),
    )
    return c.select("doc", F.concat(F.col("doc"), F.lit("#chunk"), F.col("bin").cast("string")).alias("chunk_id"), "text", "tokens", "pages", "heading", "element")


def long_bins(pieces: DataFrame, most: int) -> DataFrame:
    """pieces (doc, scope, pos, part, tokens, ...) with bin, as the loop over a document gives them, without one.

    From every piece a chunk could begin at, the next chunk begins at the first piece that no
    longer fits, if the scope goes on.  Which of them do begin is found by pointer jumping
    from the first piece of each scope; a piece's bin is then a running count of beginnings.
    """
    at = cut(running(pieces, ["doc"], ["pos", "part"], {"end": F.col("tokens").cast("long")}))
    narrow = at.select("doc", "scope", "end", (F.col("end") - F.col("tokens") + most + 1).alias("beyond"))
    found = next_at_least(narrow, "doc", "end", "beyond", 64 * most)
    scopes = narrow.select(F.col("doc").alias("__d"), F.col("end").alias("__e"), F.col("scope").alias("__s"))
    same = (F.col("doc") == F.col("__d")) & (F.col("next") == F.col("__e")) & (F.col("scope") == F.col("__s"))
    jump = found.join(scopes, same).select("doc", "end", "next")
    begins = reachable(jump, narrow.groupBy("doc", "scope").agg(F.min("end").alias("end")), ["doc", "end"], "next")
    marked = at.join(begins.withColumn("__begin", F.lit(1)), ["doc", "end"], "left")
    return running(marked, ["doc"], ["end"], {"__bins": F.coalesce("__begin", F.lit(0)).cast("long")}).withColumn("bin", F.col("__bins") - 1)

def participation_edges(rows: DataFrame) -> DataFrame:
    """type, source_id, target_id, calidad and texto of rows (project, researcher, calidad, chunk, texto, seq).

    Each row tells that a researcher took part in a project and which chunk of a table says
    so; of edges with the same type, ends and role the first by seq stays, of several the smallest text.
    """
    none = F.lit(None).cast("string")
    took = rows.select(F.lit("PARTICIPO_EN").alias("type"), F.col("researcher").alias("source_id"), F.col("project").alias("target_id"), tx.role(F.col("calidad")).alias("calidad"), none.alias("texto"), "seq")
    told = rows.where("chunk is not null").select(F.lit("EXTRAIDO_DE").alias("type"), F.col("chunk").alias("source_id"), F.col("researcher").alias("target_id"), none.alias("calidad"), "texto", "seq")
    return took.unionByName(told).groupBy("type", "source_id", "target_id", "calidad").agg(F.min(F.struct("seq", "texto"))["texto"].alias("texto"))


def rechunk(documents: DataFrame, sizes: Sequence[int], text: str = "text") -> DataFrame:
    """doc_id, size, pos, n_words: the documents cut anew at each size, from one scan."""
    d = documents.select("doc_id", F.split(text, " ").alias("w")).withColumn("size", F.explode(F.array(*[F.lit(int(x)) for x in sizes])))
    n = F.ceil(F.size("w") / F.col("size")).cast("int")
    d = d.select("doc_id", "size", "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return d.select("doc_id", "size", "pos", F.array_join(F.expr("slice(w, pos * size + 1, size)"), " ").alias("texto"))


def taxonomy_graph(topics: DataFrame) -> DataFrame:
    """Nodes and edges of topics (topic, subfield), both by their folded ids, so equal names collapse.

    Columns: kind (node or edge), label (of the node, or the edge's type), id and to; the
    display of a node is the smallest of its names.
    """
    from grafita.functions.text import taxonomy_id

    t = topics.select("topic", "subfield", taxonomy_id(F.col("topic")).alias("t"), taxonomy_id(F.col("subfield")).alias("s"))
    none = F.lit(None).cast("string")
    node = lambda label, id_, name: t.groupBy(F.col(id_).alias("id")).agg(F.min(name).alias("display")).select(F.lit("node").alias("kind"), F.lit(label).alias("label"), "id", none.alias("to"), "display")
    edges = t.select(F.lit("edge").alias("kind"), F.lit("PERTENECE_A_SUBCAMPO").alias("label"), F.col("t").alias("id"), F.col("s").alias("to"), none.alias("display")).distinct()
    return node("Topico", "t", "topic").unionByName(node("Subcampo", "s", "subfield")).unionByName(edges)
