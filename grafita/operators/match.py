"""Read-only questions over a graph: catalogs, neighbourhoods, typed paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafita.operators.labels import with_labels
from grafita.plans.derived import Graph
from grafita.schema import LABEL_FIELDS
from grafita.sources.shared import dealt, stored


def _clamp(n: int, most: int) -> int:
    return max(1, min(most, n))


def catalog(nodes: DataFrame, search: str = "", label: str | None = None, limit: int = 100) -> DataFrame:
    """Nodes other than chunks whose id, name or display contains the text, by display then id."""
    if label is not None and label not in LABEL_FIELDS:
        raise ValueError(f"no label {label}")
    out = nodes.where("label <> 'Chunk'")
    if label:
        out = out.where(F.col("label") == label)
    if search:
        out = out.where(F.lower(F.concat_ws("\x01", "id", "name", "display")).contains(search.lower()))
    return out.select("label", "id", "display").orderBy(F.coalesce("display", "id"), "id").limit(_clamp(limit, 100))


def _non_chunk_edges(g: Graph) -> DataFrame:
    plain = g.nodes.where("label <> 'Chunk'").select("id")
    return g.edges.join(plain.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(plain.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def neighborhood(g: Graph, node_id: str, limit: int = 1200) -> tuple[DataFrame, DataFrame]:
    """(nodes with degree, edges) one step around a node; edges in the order type, ends."""
    touching = g.edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    edges = _non_chunk_edges(Graph(g.nodes, touching)).orderBy("type", "source_id", "target_id").limit(_clamp(limit, 1200))
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    around = touching.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    nodes = g.nodes.where("label <> 'Chunk'").join(around, "id", "left_semi").join(degree, "id", "left")
    return nodes.select("label", "id", "display", F.coalesce("degree", F.lit(0)).alias("degree")), edges


def snapshot(g: Graph, n: int = 500, m: int = 1200) -> tuple[DataFrame, DataFrame]:
    """The n nodes of highest degree and the first m edges among them."""
    edges = stored(_non_chunk_edges(g).select("type", "source_id", "target_id"))  # read for the degrees and for the edges
    degree = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    top = g.nodes.where("label <> 'Chunk'").join(degree, "id", "left").select("label", "id", "display", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "id").limit(_clamp(n, 500))
    ids = F.broadcast(top.select("id"))  # at most 500 rows
    induced = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return top, induced.select("type", "source_id", "target_id").orderBy("type", "source_id", "target_id").limit(_clamp(m, 1200))


def lookup(nodes: DataFrame, node_id: str) -> DataFrame:
    """Labels that hold an id, five at most."""
    return nodes.where(F.col("id") == node_id).select("label", "id").orderBy("label").limit(5)


def discover_schema(g: Graph) -> DataFrame:
    """(source label, type, target label) seen in the data, with counts and the properties seen."""
    e = with_labels(g.edges, g.nodes, "inner")
    return e.groupBy("src_label", "type", "dst_label").agg(F.count("*").alias("n"), F.count("prop").alias("n_prop"))


def schema_properties(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct property names by label, and by (source label, type, target label), and both as text.

    nodes: id, label, props; edges: type, source_id, target_id, props; props are maps, and a
    name counts whatever its value.  Texts: section (1 nodes, 2 edges) and line, by label.
    """
    names = F.array_sort(F.collect_set("name"))
    of = lambda df, *keys: df.groupBy(*keys).agg(names.alias("names"))
    n = of(nodes.select("label", F.explode_outer(F.map_keys("props")).alias("name")), "label")
    narrow = edges.select("type", "source_id", "target_id", F.map_keys("props").alias("ks"))
    ends = ["src_label", "type", "dst_label"]
    e = of(with_labels(narrow, nodes, "inner").select(*ends, F.explode_outer("ks").alias("name")), *ends)
    listed = F.when(F.size("names") > 0, F.concat(F.lit(": "), F.array_join("names", ", "))).otherwise(F.lit(""))
    text = n.select(F.lit(1).alias("section"), F.concat(F.lit("- "), "label", listed).alias("line"))
    return n, e, text.unionByName(e.select(F.lit(2).alias("section"), F.concat(F.lit("- (:"), "src_label", F.lit(")-[:"), "type", F.lit("]->(:"), "dst_label", F.lit(")"), listed).alias("line")))


@dataclass
class Step:
    """One leg of a path: edge type, direction (out or in), the label and conditions of the node it reaches."""

    type: str
    name: str
    label: Sequence[str] = ()
    out: bool = True
    where: Column | None = None  # over label, id, name, display
    prop: str | None = None
    optional: bool = False
    totals: dict[str, Column] | None = None  # aggregates over what it reaches, by name, in place of a row each


@dataclass
class PathSpec:
    """A typed path from a start node: what a pattern query states."""

    name: str
    label: Sequence[str] = ()
    where: Column | None = None
    steps: list[Step] = field(default_factory=list)


def _nodes(g: Graph, name: str, label: Sequence[str], where: Column | None) -> DataFrame:
    n = g.nodes_of(*label)
    if where is not None:
        n = n.where(where)
    return n.select(F.col("id").alias(name), F.col("display").alias(f"{name}_display"))


def match(g: Graph, spec: PathSpec, edges: int = 0) -> DataFrame:
    """One row for each way to match; columns <name> and <name>_display.

    Each step is an equi-join of the edges of one type; an optional one is a left join
    with what the step could reach, so it never removes a row.  A last step with totals is
    aggregated by the node it starts from before it is joined, so its rows never multiply.
    Of very many edges (about ``edges``) a task gets a bounded number.
    """
    rows = _nodes(g, spec.name, spec.label, spec.where)
    at = spec.name
    for s in spec.steps:
        e = g.edges_of(s.type)
        if s.prop is not None:
            e = e.where(F.col("prop") == s.prop)
        near, far = ("source_id", "target_id") if s.out else ("target_id", "source_id")
        leg = e.select(F.col(near).alias(at), F.col(far).alias(s.name))
        if s.label or s.where is not None:
            leg = dealt(leg, edges, s.name).join(_nodes(g, s.name, s.label, s.where), s.name)
        if s.totals:
            leg = leg.groupBy(at).agg(*[c.alias(n) for n, c in s.totals.items()])
        rows = rows.join(dealt(leg, edges, at), at, "left" if s.optional else "inner")
        at = s.name
    return rows


def with_display(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each id column replaced by its display."""
    return rows.select(*[F.coalesce(f"{n}_display", n).alias(n) for n in names])


def related(g: Graph, node_id: str) -> DataFrame:
    """Distinct (edge type, display of the other end) of a node."""
    touching = g.edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    other = touching.select("type", F.when(F.col("source_id") == node_id, F.col("target_id")).otherwise(F.col("source_id")).alias("id"))
    return other.join(g.nodes, "id").select("type", F.coalesce("display", "id").alias("display")).distinct()


def pair_counts(edges: DataFrame, hidden: Sequence[str] = ()) -> DataFrame:
    """Edges of each type, a pair of ends counted once whichever way it runs."""
    shown = edges.where(~F.col("type").isin(*hidden)) if hidden else edges
    return shown.select("type", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct().groupBy("type").agg(F.count("*").alias("n"))


def search_taxonomy(taxonomy: DataFrame, term: str) -> DataFrame:
    """Rows (field, subfield, topic) that a term meets; a parent that meets it keeps all its topics unless some of them do."""
    hit = lambda c: F.lower(c).contains(term.lower())
    t = taxonomy.withColumns({"ht": hit(F.col("topic")), "hs": hit(F.col("subfield")), "hf": hit(F.col("field"))})
    w = Window.partitionBy("field", "subfield")
    t = t.withColumn("any", F.max("ht").over(w))
    return t.where("ht or ((hs or hf) and not any)").select("field", "subfield", "topic")


def top_by(rows: DataFrame, key: str, counted: str, k: int = 10, about: int = 0) -> DataFrame:
    """The k keys with most distinct counted values; ties by key (F21, F22).  Of very many rows (``about``) a task gets a bounded number."""
    pairs = dealt(rows.select(key, counted), about, key, counted).distinct()
    return pairs.groupBy(key).agg(F.count(counted).alias("n")).orderBy(F.desc("n"), key).limit(k)
