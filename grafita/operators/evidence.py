"""Evidence, contexts and messages for questions, and the history of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels in the order of a context, with their headings.
HEADINGS = {"Proyecto": "Proyectos", "Grupo": "Grupos", "Investigador": "Investigadores", "Topico": "Tópicos", "Documento": "Documentos", "Anio": "Año", "Area": "Áreas"}
#: The head lines of contexts and what stands for no result.
ENTITY_HEAD = "=== ENTIDADES ENCONTRADAS EN EL GRAFO ==="
ROWS_HEAD = "=== QUERY RESULTS ===\n"
NO_ROWS = "No aggregation results found."


def entity_ref(label: Column, id_: Column, props: Column) -> Column:
    """How an entity is named in evidence, by label; null for labels that are no entities (G02).  props: a map."""
    or_id = lambda key: F.coalesce(F.nullif(props[key], F.lit("")), id_)
    titled = F.when(F.coalesce(props["titulo"], F.lit("")) != "", F.concat(props["titulo"], F.lit(" ("), id_, F.lit(")"))).otherwise(id_)
    return (
        F.when(label == "Investigador", or_id("nombre")).when(label.isin("Proyecto", "Grupo"), titled).when(label == "Documento", id_)
        .when(label.isin("Topico", "Area"), or_id("valor")).when(label == "Anio", or_id("anio"))
    )


def evidence(matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, entities and pairs of both from rows of matches.

    matches: question, seq, chunks array<struct<id, texto, paginas array<int>>>, direct and
    collected array<struct<label, ref>>.  A chunk counts where it first comes with an id and
    a text; its page is its first, or 1.  Only direct entities are tied to chunks.
    """
    c = matches.select("question", "seq", "direct", F.posexplode("chunks").alias("n", "c")).where("c.id <> '' and c.texto <> ''")
    chunks = c.groupBy("question", F.col("c.id").alias("chunk_id")).agg(F.min_by(F.struct(F.col("c.texto").alias("text"), F.coalesce(F.get("c.paginas", 0), F.lit(1)).alias("page")), F.struct("seq", "n")).alias("r")).select("question", "chunk_id", "r.text", "r.page")
    pairs = c.select("question", F.col("c.id").alias("chunk_id"), F.explode("direct").alias("e")).select("question", "chunk_id", "e.label", "e.ref").where("ref <> '' and label <> ''").distinct()
    told = matches.select("question", F.explode(F.concat("direct", "collected")).alias("e")).select("question", "e.label", "e.ref").where("ref <> '' and label <> ''").distinct()
    return chunks, told, pairs


def entity_context(entities: DataFrame, by: str) -> DataFrame:
    """by and context: headings in their fixed order, entities sorted below them (G03).  entities: by, label, ref, line.

    A context is read by one prompt, so it is gathered as one value a question.
    """
    order = F.create_map(*[F.lit(x) for i, k in enumerate(HEADINGS) for x in (k, i)])
    heading = F.create_map(*[F.lit(x) for k, v in HEADINGS.items() for x in (k, v)])
    block = entities.where(F.col("label").isin(*HEADINGS)).groupBy(by, "label").agg(F.array_sort(F.collect_list(F.struct("ref", "line"))).alias("lines"))
    text = F.concat(F.lit("\n"), heading[F.col("label")], F.lit(":\n"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("  - "), x["line"])), "\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order[F.col("label")].alias("n"), text.alias("t")))), lambda x: x["t"])
    return block.groupBy(by).agg(F.concat(F.lit(ENTITY_HEAD + "\n"), F.array_join(parts, "\n")).alias("context"))


def rows_context(rows: DataFrame, by: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """by and context: numbered rows ``key: value, ...`` (G04).  Null values read None, arrays are bracketed."""

    def shown(name: str) -> Column:
        kind = rows.schema[name].dataType.typeName()
        value = F.concat(F.lit("["), F.array_join(name, ", "), F.lit("]")) if kind == "array" else F.col(name).cast("string")
        return F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("None")))

    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    t = rows.select(by, n.alias("n"), F.concat_ws(", ", *[shown(v) for v in values]).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["line"]))
    return t.groupBy(by).agg(F.concat(F.lit(ROWS_HEAD + "\n"), F.array_join(lines, "\n")).alias("context"))


def evidence_edges(tied: DataFrame) -> DataFrame:
    """Distinct CHUNK_EVIDENCE_FOR edges of a table (chunk_id, entities array<string>)."""
    return tied.select(F.lit("CHUNK_EVIDENCE_FOR").alias("type"), F.col("chunk_id").alias("source_id"), F.explode("entities").alias("target_id")).distinct()


def build_messages(questions: DataFrame, templates: DataFrame) -> DataFrame:
    """One row for each question and template: {question} and {context} put in.

    questions: id, question, context; templates: prompt, system, template, at most 1000 rows,
    which is checked before they go to every task.
    """
    if templates.limit(1001).count() > 1000:
        raise ValueError("more than 1000 templates")
    user = F.replace(F.replace("template", F.lit("{context}"), F.coalesce("context", F.lit(""))), F.lit("{question}"), F.coalesce("question", F.lit("")))
    return questions.join(F.broadcast(templates)).select("id", "prompt", "system", user.alias("user"))


def answer_batch(questions: DataFrame, responder: Callable[[pd.Series], pd.Series], sentinels: Sequence[str] = (), overwrite: bool = False) -> DataFrame:
    """questions (id, question, context, answer) with answer, ok and error filled in.

    responder maps a batch of questions to answers on the executors; if it raises, the
    batch's rows carry the error.  Filled answers stay unless ``overwrite``; a context that
    is a sentinel is the answer itself.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            try:
                p["answer"], p["ok"], p["error"] = responder(p["question"]), True, None
            except Exception as e:  # noqa: BLE001 - a failed batch is a result
                p["answer"], p["ok"], p["error"] = None, False, f"{type(e).__name__}: {e}"
            yield p[["id", "question", "context", "answer", "ok", "error"]]

    blank = F.trim(F.coalesce("answer", F.lit(""))) == ""
    fixed = F.coalesce(F.trim("context").isin(*sentinels), F.lit(False)) if sentinels else F.lit(False)
    q = questions.select("id", "question", "context", "answer", fixed.alias("fixed"), (F.lit(True) if overwrite else blank).alias("due"))
    schema = ", ".join(f"`{n}` {questions.schema[n].dataType.simpleString()}" for n in ("id", "question", "context")) + ", answer string, ok boolean, error string"
    asked = q.where("due and not fixed").select("id", "question", "context").mapInPandas(run, schema)
    still = q.where("not due or fixed").select("id", "question", "context", F.when(F.col("due") & F.col("fixed"), F.trim("context")).otherwise(F.col("answer")).alias("answer"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    return asked.unionByName(still)


def refresh_gold(questions: DataFrame, contexts: dict[str, DataFrame], missing: str, empty: str) -> DataFrame:
    """id and result: the context of each question's stored pattern, or a fixed text.

    questions: id, pattern; contexts: by pattern, a table (id, context).  The loop is over
    the patterns, which are plans, not rows.
    """
    found = None
    for name, df in contexts.items():
        part = df.select("id", F.lit(name).alias("pattern"), "context")
        found = part if found is None else found.unionByName(part)
    q = questions.join(found, ["id", "pattern"], "left") if found is not None else questions.withColumn("context", F.lit(None).cast("string"))
    known = F.col("pattern").isin(*contexts) if contexts else F.lit(False)
    return q.select("id", F.when(~F.coalesce(known, F.lit(False)), missing).otherwise(F.coalesce("context", F.lit(empty))).alias("result"))


def normalize_history(history: DataFrame) -> DataFrame:
    """Kind of retrieval and defaults for what a row lacks.

    history: id, type, query_text, response, chunks array<struct<chunk_id, chunk_text,
    chunk, text, chunk_page, score>>.
    """
    first = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))
    one = lambda c: F.struct(c["chunk_id"].alias("chunk_id"), first(c["chunk_text"], c["chunk"], c["text"]).alias("chunk_text"), F.coalesce(c["chunk_page"], F.lit(0)).alias("chunk_page"), c["score"].alias("score"))
    kind = F.when(F.col("type").isin("graph_rag", "graphrag"), "graphrag").otherwise("rag")
    return history.select("id", kind.alias("type"), F.coalesce("query_text", F.lit("")).alias("query_text"), F.coalesce("response", F.lit("")).alias("response"), F.transform(F.coalesce("chunks", F.array()), one).alias("chunks"))
