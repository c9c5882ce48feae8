"""From project rows to nodes and edges, chunks and history (A05-A08, B03-B04, D01-D10, G, K)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafita.functions import text as tx
from grafita.operators.store import first_by
from grafita.sources.shared import cut, dealt, stored


def repair_csv(lines: DataFrame) -> DataFrame:
    """Logical rows of (file, line_no, line): a line starts a row if its first field is all digits, others continue it.

    Lines lie in range partitions of (file, line_no), so a long file is many tasks.  Each
    partition tells its last start; a continuation takes the last start of its own
    partition, or that of the nearest one before.  Lines before a file's first start go.
    """
    order = ["file", "line_no"]
    t = lines.where(F.trim("line") != "").withColumn("__start", F.when(F.col("line").rlike(r"^\d+(,|$)"), F.col("line_no")))
    t = cut(t.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    here = Window.partitionBy("__p", "file").orderBy("line_no")
    t = t.withColumn("row", F.last("__start", ignorenulls=True).over(here))
    # a row for each partition and file
    ends = t.groupBy("file", "__p").agg(F.max("__start").alias("__last"))
    before = Window.partitionBy("file").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "__p", F.last("__last", ignorenulls=True).over(before).alias("__before"))
    t = t.join(ends, ["file", "__p"]).withColumn("row", F.coalesce("row", "__before")).where("row is not null")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"]))
    return t.groupBy("file", "row").agg(F.array_join(parts, " ").alias("line"))


def audit_csv(lines: DataFrame, expected: int, most: int = 5) -> DataFrame:
    """file, rows, columns (expected), wrong, valid and the first ``most`` offenders as line, found, expected."""
    n = F.size(F.split("line", ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"))
    t = lines.select("file", "line_no", n.alias("found"))
    counts = t.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(F.col("found") != expected).alias("wrong"))
    w = Window.partitionBy("file").orderBy("line_no")
    bad = t.where(F.col("found") != expected).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    bad = bad.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("line"), "found", F.lit(expected).alias("expected")))).alias("offenders"))
    return counts.join(bad, "file", "left").select("file", "rows", F.lit(expected).alias("columns"), "wrong", (F.col("wrong") == 0).alias("valid"), "offenders")


def sample_csv(lines: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """n lines of each file, drawn by a seeded hash of their place, so the same at every run."""
    w = Window.partitionBy("file").orderBy(F.xxhash64("file", "line_no", F.lit(seed)), "line_no")
    return lines.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def merge_csv(existing: DataFrame, incoming: DataFrame, generated: Sequence[str] = ("row_id", "tipo_archivo", "id_archivo")) -> DataFrame:
    """existing and the incoming rows that it lacks, generated columns aside; repeats within incoming stay."""
    keys = [c for c in incoming.columns if c in existing.columns and c not in generated]
    same = [incoming[c].eqNullSafe(existing[c]) for c in keys]
    return existing.unionByName(incoming.join(existing, same, "left_anti"), allowMissingColumns=True)


def row_chunks(rows: DataFrame, columns: Sequence[str], file: str, row_id: str) -> DataFrame:
    """chunk_id, text (k: v | k: v of filled cells) and its words."""
    cells = F.array(*[F.when(F.trim(F.col(c)) != "", F.concat(F.lit(f"{c}: "), F.col(c))) for c in columns])
    t = rows.select(F.concat(F.col(file), F.lit("#Chunk"), F.col(row_id).cast("string")).alias("chunk_id"), F.array_join(F.filter(cells, lambda x: x.isNotNull()), " | ").alias("text"))
    return t.withColumn("tokens", F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.trim("text"), r"\s+"))))


def researchers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Researchers by the first good row of each id, and error rows.

    rows: file, row_number, pais, tipo, documento, nombres, apellidos, sexo.  A row without
    pais, tipo or documento is MissingResearcherID.  One without a name is
    MissingResearcherName, unless its id has had a good row before: an id already seen is
    not looked at again.  Errors: file, row_number, type, id.
    """
    cells = ("pais", "tipo", "documento", "nombres", "apellidos", "sexo")
    r = rows.withColumns({c: tx.cell(F.col(c)) for c in cells})
    missing = F.col("pais").isNull() | F.col("tipo").isNull() | F.col("documento").isNull()
    r = r.withColumns({"id": F.when(~missing, tx.researcher_id(F.col("pais"), F.col("tipo"), F.col("documento"))), "display": tx.display_name(F.col("nombres"), F.col("apellidos"))})
    r = r.withColumn("__at", F.struct("file", "row_number"))
    whole = F.struct("file", "row_number", "display", "documento", F.col("tipo").alias("tipo_documento"), F.col("pais").alias("pais_documento"), F.coalesce("sexo", F.lit("")).alias("sexo"))
    good = r.where("id is not null and display <> ''").groupBy("id").agg(F.min_by(whole, "__at").alias("r")).select("id", "r.*").withColumn("name", tx.fold(F.col("display")))
    firsts = good.select(F.col("id").alias("__id"), F.struct("file", "row_number").alias("__first"))
    nameless = r.where("id is not null and display = ''").join(firsts, F.col("id") == F.col("__id"), "left").where("__first is null or __at < __first")
    error = lambda df, kind: df.select("file", "row_number", F.lit(kind).alias("type"), "id")
    return good, error(r.where("id is null"), "MissingResearcherID").unionByName(error(nameless, "MissingResearcherName"))


def extract_chunks(chunks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunk nodes, their edges, and errors, from the chunks of files.

    chunks: file, source, pos, chunk_id, text, pages and bad, an error type where the entry is
    no chunk (null if it is one).  docs: doc and basename.  A file whose source's name,
    without folders and ending, is no basename gives one MissingDocumentForChunks and
    nothing else; a bad entry ends its file after the rows before it.  Nodes: id, texto,
    paginas; errors: file, pos, type.
    """
    stem = F.regexp_replace(F.element_at(F.split(F.translate("source", "\\", "/"), "/"), -1), r"(?<=.)\.[^.]+$", "")
    known = docs.groupBy(F.col("basename").alias("__stem")).agg(F.min("doc").alias("doc"))
    whole = stored(chunks.withColumns({"__stem": stem, "__row": F.monotonically_increasing_id()}))
    rows = whole.count()
    # places are found without the texts, which meet them by row at the end
    c = dealt(whole.select("__row", "__stem", "file", "pos", "chunk_id", "bad"), rows, "__stem").join(known, "__stem", "left").drop("__stem")
    bad = F.min(F.when(F.col("bad").isNotNull() & F.col("doc").isNotNull(), F.struct("pos", "bad"))).over(Window.partitionBy("file"))
    c = stored(dealt(c, rows, "file").withColumns({"__stop": bad, "prev": F.lag("chunk_id").over(Window.partitionBy("file", F.col("doc").isNull()).orderBy("pos"))}))
    lost = c.where("doc is null").select("file", F.lit(None).cast("long").alias("pos"), F.lit("MissingDocumentForChunks").alias("type")).distinct()
    c = c.where("doc is not null")
    errors = c.where("pos = __stop.pos").select("file", F.col("pos").cast("long").alias("pos"), F.col("bad").alias("type"))
    kept = c.where("__stop is null or pos < __stop.pos")
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("type"), F.col(a).alias("source_id"), F.col(b).alias("target_id"))
    edges = edge(kept.where("prev is null"), "PRIMER_CHUNK", "doc", "chunk_id").unionByName(edge(kept.where("prev is not null"), "SIGUIENTE_CHUNK", "prev", "chunk_id"))
    texts = dealt(whole.select("__row", "chunk_id", "text", "pages"), rows, "__row").join(kept.select("__row"), "__row", "left_semi")
    nodes = texts.select(F.col("chunk_id").alias("id"), F.coalesce("text", F.lit("")).alias("texto"), F.col("pages").alias("paginas"))
    return nodes, edges.unionByName(edge(kept, "DE_DOCUMENTO", "chunk_id", "doc")), lost.unionByName(errors)


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """First, next and of-document edges of (doc, pos, chunk_id)."""
    w = Window.partitionBy("doc").orderBy("pos")
    t = chunks.withColumn("prev", F.lag("chunk_id").over(w))
    edge = lambda df, k, a, b: df.select(F.lit(k).alias("type"), F.col(a).alias("source_id"), F.col(b).alias("target_id"))
    first = edge(t.where("prev is null"), "PRIMER_CHUNK", "doc", "chunk_id")
    return first.unionByName(edge(t.where("prev is not null"), "SIGUIENTE_CHUNK", "prev", "chunk_id")).unionByName(edge(t, "DE_DOCUMENTO", "chunk_id", "doc"))


def pack_context(ranked: DataFrame, by: str, order: str, text: str, budget: int = 12_000) -> DataFrame:
    """Chunks in rank order as long as their characters fit the budget; the first that doesn't ends it."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= budget)


def turns(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant's next one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = conversations.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    return t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query_text"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("response"))


def search_history(history: DataFrame, term: str) -> DataFrame:
    """Rows whose question or answer holds the term, newest first."""
    hit = lambda c: F.coalesce(F.lower(c).contains(term.lower()), F.lit(False))
    return history.where(hit("query_text") | hit("response")).orderBy(F.desc("conv_id"), F.desc("turn"))
