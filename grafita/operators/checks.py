"""Rules over a graph, each a table of offenders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafita.operators.labels import with_labels
from grafita.plans.derived import Graph, union
from grafita.schema import DOCUMENT_KINDS
from grafita.sources.shared import cut, stored


def cardinalities(nodes: DataFrame, edges: DataFrame, endpoints: DataFrame, rules: DataFrame) -> DataFrame:
    """label, type, how many nodes break the rule, and the five first of them.

    Edges are counted by source, type and target label before they meet their sources.
    """
    nodes = stored(nodes.select("id", "label"))
    seen = with_labels(edges, nodes, "inner", ["target_id"]).groupBy("source_id", "type", "dst_label").agg(F.count("*").alias("n"))
    counts = seen.join(F.broadcast(endpoints), ["type", "dst_label"]).groupBy("source_id", "type", "src_label").agg(F.sum("n").alias("n"))
    source = nodes.select(F.col("id").alias("source_id"), F.col("label").alias("src_label"))
    due = source.join(F.broadcast(rules), "src_label").join(counts, ["source_id", "type", "src_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = cut(due.where("n < least or n > most").select("src_label", "type", "source_id"))
    return examples(bad, ["src_label", "type"], "source_id")


def examples(bad: DataFrame, keys: list[str], id_: str, most: int = 5) -> DataFrame:
    """keys, offenders and examples: the smallest ``most`` ids of each key, joined by a semicolon.

    Only so many ids of a key leave a task, however many offend.
    """
    first = bad.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(id_))).where(F.col("__n") <= most)
    named = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(id_)), ";").alias("examples"))
    return bad.groupBy(*keys).agg(F.count("*").alias("offenders")).join(named, keys)


def without_topic(g: Graph) -> DataFrame:
    return g.nodes_of("Proyecto").select("id").join(g.edges_of("TIENE_TOPICO").select(F.col("source_id").alias("id")), "id", "left_anti")


def cross_document_links(g: Graph) -> DataFrame:
    """Chunk links between chunks of different documents."""
    of = g.edges_of("DE_DOCUMENTO")
    a = of.select("source_id", F.col("target_id").alias("d1"))
    b = of.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("d2"))
    return g.edges_of("SIGUIENTE_CHUNK").join(a, "source_id").join(b, "target_id").where("d1 <> d2").select("source_id", "target_id")


def unreachable_chunks(g: Graph) -> DataFrame:
    """Chunks that no first chunk leads to (I06), by pointer doubling: log of the longest chain in joins."""
    reached = cut(g.edges_of("PRIMER_CHUNK").select(F.col("target_id").alias("id")).distinct())
    jump = cut(g.edges_of("SIGUIENTE_CHUNK").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    n = reached.count()
    while True:
        reached = cut(reached.unionByName(reached.join(jump, reached.id == jump.a).select(F.col("b").alias("id"))).distinct())
        now = reached.count()
        if now == n:
            break
        n = now
        jump = cut(jump.alias("x").join(jump.alias("y"), F.expr("x.b = y.a")).select("x.a", "y.b").distinct())
    return g.nodes_of("Chunk").select("id").join(reached, "id", "left_anti")


def chunks_on_cycles(g: Graph) -> DataFrame:
    """Chunks on a cycle of links.

    Where every chunk has one successor at most, the images of the 2**k-th power of the
    successor map shrink to the chunks on cycles, and what lies behind them never stays.
    """
    jump = cut(g.edges_of("SIGUIENTE_CHUNK").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    live, n = jump, -1
    while True:
        image = live.select(F.col("b").alias("a")).distinct()
        now = cut(image)
        count = now.count()
        if count == n:
            return now.select(F.col("a").alias("id"))
        n = count
        live = cut(live.alias("x").join(live.alias("y"), F.expr("x.b = y.a")).select("x.a", "y.b"))


def participation_without_evidence(g: Graph) -> DataFrame:
    """Participations that no chunk of a document of the project speaks of."""
    return _without_evidence(g, g.edges_of("PARTICIPO_EN").select(F.col("target_id").alias("pid"), F.col("source_id").alias("what")))


def topic_without_evidence(g: Graph) -> DataFrame:
    return _without_evidence(g, g.edges_of("TIENE_TOPICO").select(F.col("source_id").alias("pid"), F.col("target_id").alias("what")))


def _without_evidence(g: Graph, claims: DataFrame) -> DataFrame:
    """Claims (pid, what), each once, that no chunk of a document of the project speaks of; claims are read once."""
    told = g.edges_of("EXTRAIDO_DE").select(F.col("source_id").alias("chunk"), F.col("target_id").alias("what"))
    of = g.edges_of("DE_DOCUMENTO").select(F.col("source_id").alias("chunk"), F.col("target_id").alias("doc"))
    docs = g.edges_of("ES_DESCRITO_POR").select("source_id", F.col("target_id").alias("doc")).withColumnRenamed("source_id", "pid")
    proof = told.join(of, "chunk").select("doc", "what").distinct().withColumn("seen", F.lit(True))
    return claims.join(docs, "pid", "left").join(proof, ["doc", "what"], "left").groupBy("pid", "what").agg(F.max("seen").alias("seen")).where("seen is null").select("pid", "what")


def foreign_titles(g: Graph) -> DataFrame:
    """Title chunks that are of no document of their project."""
    t = g.edges_of("TITULO_EXTRAIDO_DE").select(F.col("source_id").alias("pid"), F.col("target_id").alias("chunk"))
    of = g.edges_of("DE_DOCUMENTO").select(F.col("source_id").alias("chunk"), F.col("target_id").alias("doc"))
    own = t.join(of, "chunk").join(g.edges_of("ES_DESCRITO_POR").select(F.col("source_id").alias("pid"), F.col("target_id").alias("doc")), ["pid", "doc"], "left_semi").select("pid", "chunk")
    return t.join(own, ["pid", "chunk"], "left_anti")


def run_checks(spark: SparkSession, rules: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """rule, offenders, examples (five, joined by a semicolon) and error of each rule.

    A rule gives the table of its offenders.  Each is run on its own, and one that fails
    is a row with its error; the report has a row a rule, so it is made on the driver.
    """
    report = []
    for name, rule in rules.items():
        try:
            bad = rule()
            bad = bad.select(F.lit(name).alias("rule"), F.concat_ws("|", *bad.columns).alias("id"))
            got = examples(bad, ["rule"], "id").first()
            report.append((name, got.offenders if got else 0, got.examples if got else "", None))
        except (PySparkException, Py4JJavaError) as e:
            report.append((name, None, "", type(e).__name__))
    return spark.createDataFrame(report, "rule string, offenders long, examples string, error string")


def statistics(g: Graph) -> DataFrame:
    """kind (node or edge), name (label, type, or all) and n."""
    by = lambda kind, df, c: df.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "n")
    parts = by("edge", g.edges, "type").unionByName(by("node", g.nodes, "label"))
    return parts.cube("kind", "name").agg(F.sum("n").alias("n")).where("kind is not null").withColumn("name", F.coalesce("name", F.lit("all")))


def endpoint_issues(edges: DataFrame, nodes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Edges by issue: a missing end or illegal labels."""
    e = with_labels(edges, nodes).join(F.broadcast(endpoints.withColumn("legal", F.lit(True))), ["type", "src_label", "dst_label"], "left")
    issue = F.when(F.col("src_label").isNull(), "no_source").when(F.col("dst_label").isNull(), "no_target").when(F.col("legal").isNull(), "illegal")
    return e.withColumn("issue", issue).where("issue is not null").groupBy("type", "issue").agg(F.count("*").alias("n"))


def score_issues(issues: DataFrame) -> DataFrame:
    """Penalty by severity and category, a score of 100 less their sum, and a verdict.

    Fixed values: errors cost 5, 3 or 4 and warnings 2, 1 or 2 for structure, value and
    constraint; verdicts begin at 95, 80 and 60.
    """
    weight = F.create_map(*[F.lit(x) for k, v in {"error|structure": 5, "error|value": 3, "error|constraint": 4, "warning|structure": 2, "warning|value": 1, "warning|constraint": 2}.items() for x in (k, v)])
    total = issues.agg(F.coalesce(F.sum(weight[F.concat_ws("|", "severity", "category")] * F.col("n")), F.lit(0)).alias("penalty"))
    score = F.greatest(F.lit(0), 100 - F.col("penalty"))
    return total.select("penalty", score.alias("score"), F.when(score >= 95, "excellent").when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor").alias("verdict"))


def audit_query_log(log: DataFrame, text: str = "query_text") -> DataFrame:
    """Logged queries with the reason why they are not plain reads, or null (I16)."""
    t = F.upper(F.coalesce(F.col(text), F.lit("")))
    reason = F.when(F.trim(t) == "", "blank").when(t.rlike(r"\b(CREATE|MERGE|DELETE|SET|REMOVE|DROP)\b"), "write").when(~t.rlike(r"\bMATCH\b") | ~t.rlike(r"\bRETURN\b"), "no_match_return")
    return log.withColumn("reason", reason)


def graph_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one extraction has more often than the other, with the side that has them (I17); none if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def graphs_equal(a: DataFrame, b: DataFrame) -> bool:
    """The same rows, each as often, in whatever order."""
    return graph_difference(a, b).isEmpty()


def entity_issues(nodes: DataFrame, fields: DataFrame, closed: Sequence[str] = ()) -> DataFrame:
    """label, id, field, issue of nodes (label, id, props map<string,string>).

    Issues: unknown_label, missing (a required field that is absent), blank (a scalar without
    text), wrong_type (a list that is no JSON list, or an enum value outside the kinds) and
    undeclared (a field the label lacks, for the labels in ``closed``).
    """
    f = F.broadcast(fields)
    known = F.broadcast(fields.select("label").distinct())
    n = nodes.join(known, "label", "left_semi")
    value = F.col("props")[F.col("field")]
    due = n.join(f, "label").select("label", "id", "field", "type", "required", F.map_contains_key("props", F.col("field")).alias("there"), value.alias("value"))
    issue = (
        F.when(~F.col("there") & F.col("required"), "missing").when(F.col("there") & (F.col("type") == "list") & ~F.coalesce(F.col("value").rlike(r"^\s*\["), F.lit(False)), "wrong_type")
        .when(F.col("there") & F.col("required") & (F.trim(F.coalesce("value", F.lit(""))) == ""), "blank").when(F.col("there") & (F.col("type") == "enum") & ~F.col("value").isin(*DOCUMENT_KINDS), "wrong_type")
    )
    told = due.withColumn("issue", issue).where("issue is not null").select("label", "id", "field", "issue")
    given = n.where(F.col("label").isin(*closed)).select("label", "id", F.explode(F.map_keys("props")).alias("field"))
    extra = given.join(F.broadcast(fields.select("label", "field")), ["label", "field"], "left_anti").select("label", "id", "field", F.lit("undeclared").alias("issue"))
    alien = nodes.join(known, "label", "left_anti").select("label", "id", F.lit(None).cast("string").alias("field"), F.lit("unknown_label").alias("issue"))
    return union(told, extra, alien)


def issue_report(issues: DataFrame, by: Sequence[str], shown: int = 50) -> DataFrame:
    """Each kind's number of issues and the first ``shown`` of its ids.

    A kind with very many issues is first cut to its bucket's first ones, in 64 buckets.
    """
    total = issues.groupBy(*by).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by, "__b").orderBy("id")
    t = issues.select(*by, "id").withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= shown)
    ids = t.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("id")), 1, shown).alias("ids"))
    return total.join(ids, list(by))


def structural_issues(nodes: DataFrame, edges: DataFrame, endpoints: DataFrame, labels: DataFrame) -> DataFrame:
    """issue and item of each breach of structure.

    duplicate_id, blank_id, unknown_label, unknown_type, no_source, no_target, illegal_ends.
    Labels of an id are gathered before the joins, so an id seen often is one row there.
    """
    nodes = stored(nodes.select("id", "label"))
    name = F.concat_ws("|", "type", "source_id", "target_id")
    say = lambda df, issue, item: df.select(F.lit(issue).alias("issue"), item.alias("item"))
    twice = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    blank = nodes.where(F.trim(F.coalesce("id", F.lit(""))) == "")
    alien = nodes.join(F.broadcast(labels.select("label").distinct()), "label", "left_anti")
    types = F.broadcast(endpoints.select("type").distinct().withColumn("known", F.lit(True)))
    ends = nodes.groupBy("id").agg(F.min("label").alias("label"))
    legal = F.broadcast(endpoints.withColumn("legal", F.lit(True)))
    e = with_labels(edges, ends).join(types, "type", "left").join(legal, ["type", "src_label", "dst_label"], "left")
    found = F.array_compact(F.array(
        F.when(F.col("known").isNull(), "unknown_type"), F.when(F.col("src_label").isNull(), "no_source"), F.when(F.col("dst_label").isNull(), "no_target"),
        F.when(F.col("known").isNotNull() & F.col("src_label").isNotNull() & F.col("dst_label").isNotNull() & F.col("legal").isNull(), "illegal_ends"),
    ))
    return union(say(twice, "duplicate_id", F.col("id")), say(blank, "blank_id", F.col("label")), say(alien, "unknown_label", F.col("id")), e.select(F.explode(found).alias("issue"), name.alias("item")))


def constraint_issues(g: Graph) -> DataFrame:
    """severity, rule and id of what lacks its evidence.

    A project needs a title chunk; a document, tables aside, a first chunk and a chunk at
    all; a second first chunk is a warning; a topic needs exactly one subfield.
    """

    def count(ids: DataFrame, kind: str, end: str) -> DataFrame:
        n = g.edges_of(kind).groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"))
        return ids.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))

    say = lambda df, where, severity, rule: df.where(where).select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "id")
    docs = g.nodes_of("Documento").where("name <> 'tabla'").select("id")
    first = count(docs, "PRIMER_CHUNK", "source_id")
    field = count(g.nodes_of("Topico").select("id").distinct(), "PERTENECE_A_SUBCAMPO", "source_id")
    return union(
        say(count(g.nodes_of("Proyecto").select("id"), "TITULO_EXTRAIDO_DE", "source_id"), "n = 0", "error", "project.title"),
        say(first, "n = 0", "error", "document.first_chunk"), say(first, "n > 1", "warning", "document.first_chunks"),
        say(count(docs, "DE_DOCUMENTO", "target_id"), "n = 0", "error", "document.chunks"),
        say(field, "n = 0", "error", "topic.subfield"), say(field, "n > 1", "error", "topic.subfields"),
    )
