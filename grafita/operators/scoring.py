"""Gold sets, topic scores, judgements and summaries of many runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafita.functions import text as tx
from grafita.operators.evaluate import compare, safe
from grafita.plans.derived import Graph, union
from grafita.schema import EDGE_RULES
from grafita.sources.shared import dealt, stored

#: Gold texts that stand for questions without an answer.
SENTINELS = (
    "La consulta solicitada está fuera del alcance del esquema actual del grafo.",
    "No se encontró ningún elemento que cumpla con los criterios de la consulta.",
    "La consulta no puede responderse con la información del grafo.",
)


def merge_sweeps(previous: DataFrame, new: DataFrame, signature: Sequence[str]) -> DataFrame:
    """Results of two sweeps, one for each signature, the new one before the old."""
    both = previous.withColumn("__o", F.lit(1)).unionByName(new.withColumn("__o", F.lit(0)))
    rest = [c for c in previous.columns if c not in signature]
    return both.groupBy(*signature).agg(F.min_by(F.struct(*rest), "__o").alias("__r")).select(*signature, *[F.col("__r")[c].alias(c) for c in rest])


def parameter_report(sweep: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """parameter, values and whether it varies, from one pass."""
    n = sweep.agg(*[F.countDistinct(p).alias(p) for p in parameters])
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("n")) for p in parameters]))
    return n.select(pairs.alias("x")).select("x.parameter", F.col("x.n").alias("n"), (F.col("x.n") > 1).alias("varies"))


def project_subgraphs(g: Graph, types: Sequence[str], documents: str = "Documento") -> DataFrame:
    """project_id, type, source_id, target_id: the edges that touch a project, all projects in one pass.

    Edges to chunks stay out by their type, so no chunk is read; so do edges to documents of kind tabla.
    Edges are dealt by the end at which the rules allow a project, once.  The other ends are few
    different nodes; only types that have projects or such documents there, whatever the rules
    say, are also joined by them.
    """
    types = [t for t in types if "Chunk" not in EDGE_RULES[t][0] + EDGE_RULES[t][1]]
    p = g.nodes_of("Proyecto").select(F.col("id").alias("project_id"))
    out = g.nodes_of(documents).where("name = 'tabla'").select("id")
    e = stored(g.edges_of(*types).select("type", "source_id", "target_id"))
    ends = {(t, end): "Proyecto" in labels for t in types for end, labels in zip(("source_id", "target_id"), EDGE_RULES[t], strict=False)}
    others = [e.where(F.col("type") == t).select(F.lit(t).alias("type"), F.lit(end).alias("end"), F.col(end).alias("id")) for (t, end), ruled in ends.items() if not ruled]
    met = stored(union(*others).distinct())
    having = lambda ids: {tuple(r) for r in met.join(ids, "id", "left_semi").select("type", "end").distinct().collect()}
    stray, tables = having(p.withColumnRenamed("project_id", "id")), having(out)
    legs: dict[bool, list[DataFrame]] = {False: [], True: []}
    for (t, end), ruled in ends.items():
        far = "target_id" if end == "source_id" else "source_id"
        if ruled or (t, end) in stray:
            leg = e.where(F.col("type") == t).select(F.col(end).alias("project_id"), "type", F.col(far).alias("id"), F.col("source_id").eqNullSafe(F.col(end)).alias("__out"))
            legs[ends[t, far] or (t, far) in tables].append(leg)
    parts = ([union(*legs[True]).join(out, "id", "left_anti").select("project_id", "type", "id", "__out")] if legs[True] else []) + legs[False]
    rows = dealt(union(*parts), e.count(), "project_id").join(p, "project_id", "left_semi").distinct()
    source, target = F.when(F.col("__out"), F.col("project_id")).otherwise(F.col("id")), F.when(F.col("__out"), F.col("id")).otherwise(F.col("project_id"))
    return rows.select("project_id", "type", source.alias("source_id"), target.alias("target_id"))


def leaderboard(scores: DataFrame, quality: DataFrame) -> DataFrame:
    """Models by f1 and score, joined from their two summaries; place by (f1, score, model)."""
    both = scores.join(quality, "model", "full_outer")
    return both.orderBy(F.desc_nulls_last("f1"), F.desc_nulls_last("score"), "model")


def gold_topics(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Gold (project, topic) and (project, doc) of a gold graph; documents of kind tabla stay out."""
    p = g.nodes_of("Proyecto").select(F.col("id").alias("project"))
    topic = g.nodes_of("Topico").select(F.col("id").alias("tid"), "display")
    t = g.edges_of("TIENE_TOPICO").select(F.col("source_id").alias("project"), F.col("target_id").alias("tid")).join(p, "project", "left_semi").join(topic, "tid", "left")
    plain = F.replace(F.regexp_replace("tid", "_topic$", ""), F.lit("_"), F.lit(" "))
    docs = g.edges_of("ES_DESCRITO_POR").select(F.col("source_id").alias("project"), F.col("target_id").alias("doc")).join(p, "project", "left_semi")
    tables = g.nodes_of("Documento").where("name = 'tabla' or id like '%\\_table'").select(F.col("id").alias("doc"))
    return t.select("project", F.coalesce(F.nullif(F.trim("display"), F.lit("")), plain).alias("topic")).distinct(), docs.join(tables, "doc", "left_anti").select("project", "doc").distinct()


def project_titles(nodes: DataFrame) -> DataFrame:
    """project and title of projects and groups: the titulo of their properties, else their plain value; none is empty.

    nodes: id, label, props (a map, or null) and value (a text, or null).  Of an id given
    twice the last, by label and title, counts.
    """
    title = F.when(F.col("props").isNotNull(), F.col("props")["titulo"]).otherwise(F.col("value"))
    p = nodes.where(F.col("label").isin("Proyecto", "Grupo") & (F.col("props").isNotNull() | F.col("value").isNotNull()))
    t = F.coalesce(title, F.lit(""))
    return p.groupBy(F.col("id").alias("project")).agg(F.max_by(t, F.struct("label", t)).alias("title"))


def score_topics(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Per configuration: projects in both, macro and micro scores (J07).  pred: cfg, project, topic; gold: project, topic."""
    both = pred.select("cfg", "project").distinct().join(gold.select("project").distinct(), "project")
    p = pred.join(both, ["cfg", "project"], "left_semi")
    g = gold.join(both, "project").select("cfg", "project", "topic")
    one = compare(p, g, ["cfg", "project", "topic"], ["cfg", "project"])
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return one.groupBy("cfg").agg(
        F.count("*").alias("projects"), *[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        F.round(safe(tp, tp + fp), 4).alias("micro_precision"), F.round(safe(tp, tp + fn), 4).alias("micro_recall"), F.round(safe(2 * tp, 2 * tp + fp + fn), 4).alias("micro_f1"),
    )


def score_subfields(pred: DataFrame, gold: DataFrame, subfields: DataFrame) -> DataFrame:
    """score_topics after topics became their subfields (topic, subfield); one without keeps its name."""
    m = subfields.groupBy("topic").agg(F.min("subfield").alias("subfield"))
    up = lambda df, keys: df.join(m, "topic", "left").select(*keys, F.coalesce("subfield", "topic").alias("topic")).distinct()
    return score_topics(up(pred, ["cfg", "project"]), up(gold, ["project"]))


def sensitivity(sweep: DataFrame, parameters: Sequence[str], at: dict | None, by: str = "f1") -> DataFrame:
    """Slices through an operating point: parameter, value, the score; one parameter varies in each.

    Without a point, or with one that was not run, the best configuration is the point.
    """
    names = list(parameters)
    best = sweep.groupBy().agg(F.max_by(F.struct(*names), F.struct(by, *names)).alias("best"))
    if at is not None:
        there = sweep.where(F.expr(" and ".join(f"`{n}` = {at[n]!r}" for n in names))).groupBy().agg(F.first(F.struct(*names)).alias("there"))
        best = best.join(F.broadcast(there)).select(F.coalesce("there", "best").alias("best"))
    t = sweep.join(F.broadcast(best))
    same = {n: F.col(n) == F.col("best")[n] for n in names}
    slices = []
    for n in names:
        others = F.lit(True)
        for o in names:
            others = others & same[o] if o != n else others
        slices.append(F.when(others, F.struct(F.lit(n).alias("parameter"), F.col(n).cast("double").alias("value"))))
    return t.select(F.explode(F.array_compact(F.array(*slices))).alias("x"), by).select("x.parameter", "x.value", by)


def judgement(text: Column) -> Column:
    """struct(tp, fp, fn) of a judge's JSON, or null: exactly the lists matched, missing and extra, of non-blank strings."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    keys = F.array_sort(F.json_object_keys(body))
    raw = F.from_json(body, "map<string,string>")
    lists = F.from_json(body, "struct<matched:array<string>,missing:array<string>,extra:array<string>>")
    filled = lambda c: c.isNotNull() & F.coalesce(F.forall(c, lambda x: F.trim(x) != ""), F.lit(False))
    # only strings: as many quoted members as members
    strings = F.forall(F.map_values(raw), lambda v: v.rlike(r'^\[\s*("(\\.|[^"\\])*"\s*(,\s*"(\\.|[^"\\])*"\s*)*)?\]$'))
    ok = (keys == F.array(F.lit("extra"), F.lit("matched"), F.lit("missing"))) & filled(lists["matched"]) & filled(lists["missing"]) & filled(lists["extra"]) & strings
    return F.when(ok, F.struct(F.size(lists["matched"]).alias("tp"), F.size(lists["extra"]).alias("fp"), F.size(lists["missing"]).alias("fn")))


def score_judgements(records: DataFrame, text: str = "judge") -> DataFrame:
    """records with valid, tp, fp, fn, precision, recall, f1, to four places."""
    t = records.withColumn("__j", judgement(F.col(text)))
    tp, fp, fn = (F.col("__j")[c] for c in ("tp", "fp", "fn"))
    scored = {"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn)}
    return t.withColumns({"valid": F.col("__j").isNotNull(), "tp": tp, "fp": fp, "fn": fn} | {k: F.when(F.col("__j").isNotNull(), F.round(v, 4)) for k, v in scored.items()}).drop("__j")


def score_sentinels(records: DataFrame, gold: Sequence[str], candidate: str, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """records with sentinel and right: any gold column holds a fixed text or nothing; the candidate equals the first.

    Retrieval tests one gold column, generation two.
    """
    plain = lambda c: tx.collapsed(F.coalesce(F.col(c), F.lit("")))
    fixed = [" ".join(s.split()).lower() for s in (*sentinels, "")]
    hit = F.lit(False)
    for c in gold:
        hit = hit | plain(c).isin(*fixed)
    return records.withColumns({"sentinel": hit, "right": F.when(hit, plain(candidate) == plain(gold[0]))})


def norm_score(c: Column) -> Column:
    """1 to 5 as 0 to 1."""
    return (F.least(F.lit(5.0), F.greatest(F.lit(1.0), c)) - 1) / 4


def generation_summary(records: DataFrame, by: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Means of each dimension and of the quality, whose inner mean is rounded to four places first.

    records: by, dims (1 to 5, null if not judged), sentinel, right.
    """
    judged = F.col(dims[0]).isNotNull()
    inner = F.round(sum((F.col(d) for d in dims[1:]), F.col(dims[0])) / len(dims), 4)
    hit = F.when(F.col("sentinel"), F.coalesce(F.col("right"), F.lit(False)).cast("double"))
    return records.groupBy(*by).agg(
        F.count_if(judged).alias("n_judged"), F.count_if("sentinel").alias("n_sentinel"), *[F.round(F.avg(F.when(judged, norm_score(F.col(d)))), 4).alias(d) for d in dims],
        F.round(F.avg(F.when(judged, norm_score(inner))), 4).alias("quality"), F.round(F.avg(hit), 4).alias("sentinel_accuracy"), F.round(F.avg(F.coalesce(hit, F.when(judged, norm_score(inner)))), 4).alias("overall"),
    )


def e2e_summary(records: DataFrame, by: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """generation_summary and the numbers of failed queries and judgements (J15).  An errored sentinel is wrong.

    records also have query_error and judge_error (text, blank or null if none).
    """
    bad = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    r = records.withColumn("right", F.col("right") & ~bad("query_error"))
    errors = records.groupBy(*by).agg(F.count_if(bad("query_error")).alias("query_errors"), F.count_if(bad("judge_error")).alias("judge_errors"))
    return generation_summary(r, by, dims).join(errors, list(by))
