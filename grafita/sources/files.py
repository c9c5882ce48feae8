"""Files as tables: folders, archives, CSV, chunk and graph JSON, taxonomies, questions, embeddings.

Nothing is read on the driver: Spark lists and reads the files, and what is wrong with one
of them is a row of the result, not a failure.
"""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafita.functions import text as tx
from grafita.sources.shared import cut, swept

#: Extensions of a corpus.
EXTENSIONS = ("pdf", "docx", "pptx", "xlsx", "html", "md", "txt")
#: Folders of archives that hold no content.
JUNK = ("__MACOSX",)
#: Entries of archives that a task hands on at once, and about how many bytes of them.
ENTRIES, ENTRY_BYTES = 10_000, 16_000_000
#: Rows of a file of an exported graph at most.
FILE_ROWS = 500_000


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def scan_corpus(spark: SparkSession, root: str, recursive: bool = True, extensions: Sequence[str] = EXTENSIONS, content: bool = True) -> DataFrame:
    """path, ext, size, modified and content of files with one of the extensions (A01).  A root that isn't there raises.

    Without ``content`` the bytes are not read.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    f = f.withColumn("ext", _extension(F.col("path"))).where(F.col("ext").isin(*extensions))
    return f.select("path", "ext", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """Every file, its path from the root's name on, but those below or named with a leading dot."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = F.concat(F.lit(name + "/"), F.element_at(F.split("path", f"/{name}/", 2), -1))
    hidden = F.exists(F.split(inner, "/"), lambda x: x.startswith("."))
    return f.select(inner.alias("path"), F.col("length").alias("size"), "content").where(~hidden)


def expand_archives(files: DataFrame) -> DataFrame:
    """archive, path, content, error: a row for each entry of each zip (path, content).

    Folders, hidden entries and junk folders are left out; a broken archive is one row with
    an error.  Entries go out in batches of at most ENTRIES and about ENTRY_BYTES.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        named = lambda: pd.DataFrame(rows, columns=["archive", "path", "content", "error"])
        for p in parts:
            for path, content in zip(p["path"], p["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for i in z.infolist():
                            steps = i.filename.split("/")
                            if not i.is_dir() and steps[0] not in JUNK and not any(s.startswith(".") for s in steps):
                                rows.append((path, i.filename, z.read(i), None))
                                held += i.file_size
                                if len(rows) >= ENTRIES or held >= ENTRY_BYTES:
                                    yield named()
                                    rows, held = [], 0
                except (zipfile.BadZipFile, TypeError) as e:
                    rows.append((path, None, None, type(e).__name__))
        if rows:
            yield named()

    return files.select("path", "content").mapInPandas(run, "archive string, path string, content binary, error string")


def prepare_corpus(files: DataFrame) -> DataFrame:
    """root, processed, ignored: what of files (path) lies where a project's files do."""
    root = F.get(F.split("path", "/"), 0)
    return files.groupBy(root.alias("root")).agg(F.count_if(tx.valid_project_path(F.col("path"))).alias("processed"), F.count_if(~tx.valid_project_path(F.col("path"))).alias("ignored"))


class NoValidFiles(ValueError):
    """Files are there, but none lies where a project's files do."""


def rename_corpus(files: DataFrame, broken: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files under their new names, what lay where no project's files do, and the report.

    files: path, and whatever belongs to it; broken: path of archives that can't be opened.
    Renamed: path, new_name and the other columns, for valid paths; of those that get one
    name the last by path keeps it, as each would overwrite the one before, and the report
    counts them all.  Invalid: root and files, one row for each first folder or broken
    archive.  Report: processed, ignored, overwritten.  Files without one valid path are an
    error that names the first hundred roots; no files at all are none.
    """
    marked = files.withColumn("__ok", F.coalesce(tx.valid_project_path(F.col("path")), F.lit(False)))
    lost = marked.where(~F.col("__ok")).select(F.get(F.split("path", "/"), 0).alias("root"))
    if broken is not None:
        lost = lost.unionByName(broken.select(F.element_at(F.split("path", "/"), -1).alias("root")))
    invalid = lost.groupBy("root").agg(F.count("*").alias("files"))
    kept = marked.where("__ok").drop("__ok").withColumn("new_name", tx.canonical_name(F.col("path")))
    last = kept.groupBy("new_name").agg(F.max("path").alias("__last"), F.count("*").alias("__n"))
    counts = last.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("processed"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("overwritten"))
    report = counts.join(invalid.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("ignored"))).select("processed", "ignored", "overwritten")
    n = report.first()
    if n.ignored and not n.processed:
        names = ", ".join(r.root for r in invalid.orderBy("root").limit(100).collect())
        raise NoValidFiles(f"no file lies below a project or group; roots: {names}")
    names = last.select(F.col("new_name").alias("__new"), "__last")
    renamed = kept.join(names, (F.col("new_name") == F.col("__new")) & (F.col("path") == F.col("__last")), "left_semi")
    return renamed, invalid, report


#: A field as CSV has it: quoted, with what follows its end, or bare, or empty; what is taken is never given back.
_FIELD = r'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+)?+'
_OPENS = rf'(?:{_FIELD},)*+"(?:[^"]|"")*+$'


def logical_lines(lines: DataFrame) -> DataFrame:
    """file, row (from 1) and line: lines joined where a quoted field goes on in the next.

    lines: file, block (a split's place in its file), seq (order within the split), line.
    Whether a line begins within quotes depends on all lines before it, but each line is a
    map of that one bit: it keeps it, turns it, or sets it.  Maps are followed within a
    split from both possible bits, then over a file's splits, so a long file is many tasks.
    Blank rows are left out and not counted.
    """
    opens, closes = F.col("line").rlike("^" + _OPENS), F.col("line").rlike(r'^(?:[^"]|"")*+"[^,]*+(?:$|,(?!' + _OPENS + "))")
    maps = lines.withColumns({"__0": opens, "__1": ~closes})  # inside after the line, if it begins outside or inside
    maps = maps.withColumns({"__set": F.when(F.col("__0") == F.col("__1"), F.col("__0")), "__turn": (F.col("__0") & ~F.col("__1")).cast("long")})

    def followed(t: DataFrame, by: Sequence[str], order: str) -> DataFrame:
        """What the lines (or splits) before each make of the bit: __s, if they set it, and __t, how often they turn it."""
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        t = t.withColumn("__u", F.coalesce(F.sum("__turn").over(before), F.lit(0)))
        last = F.last(F.when(F.col("__set").isNotNull(), F.struct(F.col("__set").alias("v"), (F.col("__u") + F.col("__turn")).alias("u"))), ignorenulls=True).over(before)
        t = t.withColumn("__l", last)
        turned = F.col("__u") - F.coalesce(F.col("__l.u"), F.lit(0))
        return t.withColumns({"__s": F.col("__l.v"), "__t": turned}).drop("__u", "__l")

    odd = lambda c: F.col(c) % 2 == 1
    inner = followed(maps, ["file", "block"], "seq")
    after_set, after_turn = F.coalesce("__set", F.col("__s")), F.when(F.col("__set").isNotNull(), 0).otherwise(F.col("__t") + F.col("__turn"))
    whole = inner.groupBy("file", "block").agg(F.max_by(F.struct(after_set.alias("s"), after_turn.alias("t")), "seq").alias("e"))
    whole = whole.select("file", "block", F.when(F.col("e.s").isNotNull(), F.col("e.s") != odd("e.t")).alias("__set"), F.when(F.col("e.s").isNull(), F.col("e.t") % 2).otherwise(0).cast("long").alias("__turn"))
    first = followed(whole, ["file"], "block").select(F.col("file").alias("__f"), F.col("block").alias("__b"), (F.coalesce("__s", F.lit(False)) != odd("__t")).alias("__in"))  # a row a split
    within = F.coalesce("__s", F.col("__in")) != odd("__t")
    t = inner.join(first, (F.col("file") == F.col("__f")) & (F.col("block") == F.col("__b"))).withColumn("__new", (~within).cast("long"))
    t = t.withColumn("__n", F.sum("__new").over(Window.partitionBy("file", "block").orderBy("seq")))
    rows = t.groupBy("file", "block").agg(F.sum("__new").alias("__c"))
    rows = rows.select(F.col("file").alias("__g"), F.col("block").alias("__h"), F.coalesce(F.sum("__c").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    t = t.join(rows, (F.col("file") == F.col("__g")) & (F.col("block") == F.col("__h")))
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "line")))
    joined = t.groupBy("file", (F.col("__n") + F.col("__o")).alias("at")).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("line"))
    return joined.withColumn("line", F.regexp_replace("line", "\r$", "")).where("line <> ''")


def read_project_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of CSV files with a header, all strings, with file and row_number from 2.

    Rows may span lines.  Files are read split by split; rows are numbered range by range.
    Columns go by their places, as in a file whose header names them in this order.
    """
    t = spark.read.option("lineSep", "\n").text(path)
    t = t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    rows = logical_lines(t)
    # blank rows are gone: what is left is numbered anew, file by file
    order = ["file", "at"]
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}))
    n = placed.groupBy("file", "__p").agg(F.count("*").alias("__c"), F.min("__m").alias("__first"))
    n = n.select(F.col("file").alias("__f"), F.col("__p").alias("__q"), "__first", F.coalesce(F.sum("__c").over(Window.partitionBy("file").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    t = placed.join(n, (F.col("file") == F.col("__f")) & (F.col("__p") == F.col("__q"))).withColumn("row_number", (F.col("__m") - F.col("__first") + F.col("__o") + 1).cast("int"))
    schema = ", ".join(f"`{c}` string" for c in columns)
    got = F.from_csv("line", F.lit(schema), {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return t.where("row_number > 1").select(got.alias("r"), F.element_at(F.split("file", "/"), -1).alias("file"), "row_number").select("r.*", "file", "row_number")


def needs_repair(lines: DataFrame) -> DataFrame:
    """file and whether its first line of data that isn't blank starts with digits (A06).  lines: file, line_no from 1, line."""
    filled = lines.where("line_no > 1 and trim(line) <> ''")
    first = filled.groupBy("file").agg(F.min_by("line", "line_no").alias("line"))
    return lines.select("file").distinct().join(first, "file", "left").select("file", F.coalesce(F.trim(F.get(F.split("line", ","), 0)).rlike(r"^\d+$"), F.lit(False)).alias("repair"))


def repaired_or_not(original: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired lines of each file, or its own where the repair left none."""
    return repaired.unionByName(original.join(repaired.select("file").distinct(), "file", "left_anti").select(*repaired.columns))


_CHUNK = "struct<chunk_id:string,text:string,metadata:map<string,string>>"


def read_chunks(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Chunks (source, pos, chunk_id, text, metadata) and errors (file, error) of JSON documents.

    A root that is no object is InvalidJson; chunks that are no list are InvalidChunksFile.
    With ``multi_line`` a file is a document, else each line is one.
    """
    t = spark.read.text(path, wholetext=multi_line).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    t = t.select("file", "value", F.from_json("value", "struct<source:string,chunks:string>").alias("d"), F.substring(F.trim("value"), 1, 1).alias("mark"))
    error = F.when((F.col("mark") != "{") | F.json_object_keys("value").isNull(), "InvalidJson").when(~F.coalesce(F.col("d.chunks").startswith("["), F.lit(False)), "InvalidChunksFile")
    t = t.withColumn("error", error)
    c = t.where("error is null").select(F.col("d.source").alias("source"), F.posexplode(F.from_json(F.col("d.chunks"), f"array<{_CHUNK}>")).alias("pos", "c"))
    return c.select("source", "pos", "c.chunk_id", "c.text", "c.metadata"), t.where("error is not null").select("file", "error")


_GRAPH = "struct<entities:array<struct<id:string,label:string,properties:map<string,string>>>,relationships:array<struct<type:string,source_id:string,target_id:string,properties:map<string,string>>>>"


def read_graph(spark: SparkSession, path: str, labels: Sequence[str], multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (label, id, props), edges (type, source_id, target_id, props) and errors (file, error) of graph JSON (A10).

    An entity without id or label or with an unknown one, and a relationship without type or
    ends, is an error and not in the graph; properties that are no object are an empty map.
    """
    t = spark.read.text(path, wholetext=multi_line).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.from_json("value", _GRAPH).alias("g"))
    none = F.expr("cast(map() as map<string,string>)")
    lacks = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    n = t.select("file", F.explode("g.entities").alias("e")).select("file", "e.label", "e.id", F.coalesce("e.properties", none).alias("props"))
    n = n.withColumn("error", F.when(lacks("id"), "entity_without_id").when(lacks("label"), "entity_without_label").when(~F.col("label").isin(*labels), "unknown_label"))
    e = t.select("file", F.explode("g.relationships").alias("e")).select("file", "e.type", "e.source_id", "e.target_id", F.coalesce("e.properties", none).alias("props"))
    e = e.withColumn("error", F.when(lacks("type"), "relationship_without_type").when(lacks("source_id") | lacks("target_id"), "relationship_without_ends"))
    bad = n.where("error is not null").select("file", "error").unionByName(e.where("error is not null").select("file", "error"))
    return n.where("error is null").drop("file", "error"), e.where("error is null").drop("file", "error"), bad


def load_subset(nodes: DataFrame, edges: DataFrame, label: str, field: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a label with a value in a field, and the edges that touch one.

    Two semi joins and a distinct union, as a join on either end would be a product.
    """
    n = nodes.where((F.col("label") == label) & (F.col("props")[field] == value))
    ids = n.select("id").distinct()
    a = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    touched = ids.withColumnRenamed("id", "target_id")
    b = edges.join(touched, "target_id", "left_semi").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    return n, a.select(*edges.columns).unionByName(b.select(*edges.columns))


def read_taxonomy(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """field, subfield, topic and their places of JSON {field: {subfield: [topics]}}, without blank names."""
    t = spark.read.text(path, wholetext=multi_line).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    t = t.select(F.posexplode("m").alias("field_pos", "field", "s")).select("field_pos", "field", F.posexplode("s").alias("sub_pos", "subfield", "x"))
    t = t.select("field_pos", "field", "sub_pos", "subfield", F.posexplode("x").alias("topic_pos", "topic"))
    return t.where("trim(field) <> '' and trim(subfield) <> '' and trim(topic) <> ''")


def align_embeddings(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """meta and vector of (file, pos), with semantic_id {file}_chunk_{pos}."""
    return meta.join(vectors.select("file", "pos", "embedding"), ["file", "pos"]).withColumn("semantic_id", F.concat(F.col("file"), F.lit("_chunk_"), F.col("pos").cast("string")))


def embedding_report(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """file, rows of both sides, whether they agree, and whether the file's one dimension is everyone's."""
    v = vectors.groupBy("file").agg(F.count("*").alias("n_vectors"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"))
    most = vectors.agg(F.max(F.size("embedding")).alias("dim"))
    m = meta.groupBy("file").agg(F.count("*").alias("n_meta"))
    t = v.join(m, "file", "full_outer").join(F.broadcast(most))
    return t.select("file", F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), F.coalesce("n_meta", F.lit(0)).alias("n_meta"), F.col("n_vectors").eqNullSafe(F.col("n_meta")).alias("equal"), ((F.col("low") == F.col("dim")) & (F.col("high") == F.col("dim"))).alias("one_dim"))


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, internal: Sequence[str] = ("created_at", "updated_at")) -> None:
    """Nodes by id and edges by (type, source, target) as JSON lines, gzipped, without bookkeeping properties.

    Both are counted first and sorted in tasks of about FILE_ROWS rows, which don't spill.
    """
    clean = F.map_filter("props", lambda k, _: ~k.isin(*internal))
    with swept(nodes.sparkSession):
        for rows, name, keys in ((nodes, "entities", ["id"]), (edges, "relationships", ["type", "source_id", "target_id"])):
            dealt = rows.withColumn("props", clean).repartitionByRange(math.ceil(rows.count() / FILE_ROWS) or 1, *keys)
            _json_lines(dealt.sortWithinPartitions(*keys), f"{path}/{name}")


def _json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A gzipped file is read by one task, so none has more than FILE_ROWS rows."""
    rows.write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).json(path, compression="gzip")


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What export_graph wrote."""
    props = "props map<string,string>"
    return spark.read.schema(f"id string, label string, {props}").json(f"{path}/entities"), spark.read.schema(f"type string, source_id string, target_id string, {props}").json(f"{path}/relationships")


def append_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """More nodes and edges beside those of an export; repeats stay."""
    _json_lines(nodes, f"{path}/entities", "append")
    _json_lines(edges, f"{path}/relationships", "append")


def read_questions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """id, question, answer of a JSON list or of {questions: list}; blank ones go, a missing id is the place."""
    item = "array<struct<id:string,question:string,answer:string>>"
    t = spark.read.text(path, wholetext=multi_line)
    listed = F.when(F.substring(F.trim("value"), 1, 1) == "[", F.from_json("value", item)).otherwise(F.from_json("value", f"struct<questions:{item}>")["questions"])
    q = t.select(F.posexplode(listed).alias("pos", "q")).where("trim(q.question) <> ''")
    return q.select(F.coalesce("q.id", (F.col("pos") + 1).cast("string")).alias("id"), F.trim("q.question").alias("question"), "q.answer")


def write_answers(answers: DataFrame, path: str) -> None:
    """id, question, answer, ok as JSON lines."""
    answers.select("id", "question", "answer", "ok").write.json(path)


def embed(texts: DataFrame, encoder, kind: str = "passage", text: str = "text") -> DataFrame:  # noqa: ANN001
    """texts with embedding: encoder(list of prefixed texts) -> matrix, in Arrow batches, scaled to length 1."""

    @F.pandas_udf("array<double>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in row] for row in encoder(list(t))])

    v = texts.withColumn("embedding", run(F.concat(F.lit(f"{kind}: "), F.coalesce(text, F.lit("")))))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("embedding", F.transform("embedding", lambda x: F.when(norm == 0, x).otherwise(x / norm)))
