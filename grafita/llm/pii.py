"""Personal data: base patterns, and what the contexts of their finds give away; DataFrame functions only.

Emails, IP addresses, cards and phones found by pattern are the seeds.  Every run of words
with a digit or an @ is a candidate; the two words before it, and the words on either
side, are its lexical patterns.  Patterns and instances (candidate texts) form a bipartite
graph that is scored in rounds: a pattern by the share of its instances that are known to
be of a kind, an instance by the patterns of sufficient score that it stands in.  Instances
of high score are known in the next round; all their occurrences are found.

Texts are read once.  What is kept of them is narrow: lengths between finds, the finds, and
up to ``CONTEXT`` code points beside each candidate.  The patterns for Spark's matcher are
written so that a text of any length is scanned in linear time: runs are entered at their
start alone and never given back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafita.llm.common import cut
from grafita.llm.components import spread

KINDS = ("email", "ip", "card", "phone")
#: Code points beside a candidate that its patterns come from, and those that an identifier may have.
CONTEXT, LONGEST = 64, 254

_SPACE = r"\x20\x09-\x0D"
_LOCAL = r"A-Za-z0-9._%+-"
_HELD = rf"[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
#: As Java's matcher takes them.  Same finds as the plain forms [..]+@[..]+(\.[..]+)+ and so on: what follows
#: a possessive run is never in it, and a find can only begin where a run does or where the last find ended.
_PATTERN = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "candidate": rf"(?<![^{_SPACE}]){_HELD}(?:\x20{_HELD})*+",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(found, '[^0-9]', '')"
_HOLDS = {
    "email": "true",
    "ip": rf"found rlike '^{_PART}(?:\\.{_PART}){{3}}$'",
    "card": f"length({_DIGITS}) between 12 and 19 and luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
#: What a candidate must look like to be of a kind; looser than the base patterns.
_FITS = {
    "email": "rlike(instance, '^[^@ ]+@[^@ ]+$')",
    "ip": "rlike(instance, '^[0-9a-f]*(?:[.:][0-9a-f]*){3,7}$') and rlike(instance, '[0-9]')",
    "card": "rlike(instance, '^[0-9 .-]+$') and length(regexp_replace(instance, '[^0-9]', '')) between 12 and 19",
    "phone": "rlike(instance, '^[0-9 ()./+-]+$') and length(regexp_replace(instance, '[^0-9]', '')) between 7 and 15",
}


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pieces(kind: str) -> str:
    """SQL: an array of a find and the text before it, as its length and (for candidates) its ends; the last has no find."""
    p = _literal(_PATTERN[kind])
    near = f"substring(p, -{CONTEXT}) as tail, substring(p, 1, {CONTEXT}) as head" if kind == "candidate" else "'' as tail, '' as head"
    zipped = f"arrays_zip(regexp_extract_all(text, {p}, 0), transform(split(text, {p}, -1), p -> struct(length(p) as n, {near})))"
    each = f"transform({zipped}, (x, i) -> struct('{kind}' as kind, i as i, x['0'] as found, x['1'].n as n, x['1'].tail as tail, x['1'].head as head))"
    return f"case when text rlike {p} then {each} else array() end"


def _read(documents: DataFrame, key: str, text: str) -> DataFrame:
    """id, row (a number of its own) and pieces of each document."""
    rows = documents.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    pieces = F.expr(f"concat({', '.join(map(_pieces, _PATTERN))})")
    return cut(rows.select("id", F.monotonically_increasing_id().alias("row"), pieces.alias("pieces")))


def _words(text: str) -> Column:
    """The words of a short text, A-Z lower-cased; none gives one empty word."""
    plain = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.regexp_replace(plain, f"^[{_SPACE}]+|[{_SPACE}]+$", ""), f"[{_SPACE}]+")


def spans(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base spans (row, kind, start, end) and candidates (row, start, end, instance, kind or null, two patterns).

    Places are running sums of lengths within a document; a candidate's kind is that of the
    base span it overlaps, of several the one that ends last.
    """
    each = read.select("row", F.inline("pieces")).repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("n") + F.coalesce(F.length("found"), F.lit(0))).over(order).cast("long")
    placed = each.withColumn("end", end).withColumn("after", F.lead("head").over(order)).where("found is not null").withColumn("start", F.col("end") - F.length("found"))
    holds = "case kind " + " ".join(f"when '{k}' then {test}" for k, test in _HOLDS.items()) + f" else length(found) <= {LONGEST} end"
    placed = placed.where(F.expr(holds)).withColumn("base", F.col("kind") != "candidate")
    # spans of a document, each base span at its start and each candidate at its end: the last to end that began before is at hand
    place = F.when(F.col("base"), F.col("start")).otherwise(F.col("end") - 1)
    seen = Window.partitionBy("row").orderBy("place", F.desc("base")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = cut(
        placed.withColumn("place", place).withColumn("over", F.max(F.when(F.col("base"), F.struct("end", "kind"))).over(seen))
        .select("row", "kind", "start", "end", "found", "tail", "after", "base", F.when(F.col("over.end") > F.col("start"), F.col("over.kind")).alias("seed"))
    )
    base = held.where("base").select("row", "kind", "start", "end")
    lead = F.regexp_extract("found", r"^[^0-9A-Za-z+(\x80-\x{10FFFF}]*+", 0)
    body = F.expr("substring(found, length(lead) + 1)")
    trimmed = held.where("not base").withColumn("lead", lead).withColumn("body", F.regexp_replace(body, r"[^0-9A-Za-z)\x80-\x{10FFFF}]+$", ""))
    low = F.translate("body", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    before, after = _words("tail"), F.get(_words("after"), 0)
    one, two = F.element_at(before, -1), F.coalesce(F.try_element_at(before, F.lit(-2)), F.lit(""))
    start = F.col("start") + F.length("lead")
    return base, trimmed.where("body <> ''").select(
        "row", start.alias("start"), (start + F.length("body")).alias("end"), low.alias("instance"), "seed",
        F.array(F.concat(F.lit("before "), two, F.lit(" "), one), F.concat(F.lit("between "), one, F.lit(" _ "), after)).alias("patterns"),
    )


def bootstrap(candidates: DataFrame, rounds: int = 3, support: int = 3, trust: float = 0.7, accept: float = 0.9) -> DataFrame | None:
    """key (kind and instance) and score of the instances that patterns give away; None if none can.

    A pattern's score for a kind is the number of its known instances over one more than
    those that fit; it counts if at least ``support`` are known and its score reaches
    ``trust``.  An instance's score is the chance that not all of its patterns err.  Scores
    are rounded to nine places before they are compared.
    """
    fits = F.filter(F.array(*[F.expr(f"case when seed = '{k}' or {test} then '{k}' end") for k, test in _FITS.items()]), lambda k: k.isNotNull())
    wide = candidates.select("instance", "seed", F.explode("patterns").alias("pattern"), fits.alias("kinds")).select("*", F.explode("kinds").alias("kind"))
    edges = wide.groupBy(F.concat_ws(" ", "kind", "pattern").alias("pattern"), F.concat_ws(" ", "kind", "instance").alias("instance")).agg(F.max(F.expr("seed <=> kind")).alias("known"))
    edges = cut(edges)
    able = cut(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.col("known").cast("int")).alias("seeds")).where(F.col("n") >= support))
    count = able.count()
    if not count or not able.where("n > seeds").count():
        return None
    edges = cut(spread(edges, "pattern", able.select(F.col("pattern").alias("p")), "p", count).drop("p"))
    scores = None
    for _ in range(rounds):
        known = F.sum(F.col("known").cast("int"))
        good = edges.groupBy(F.col("pattern").alias("p")).agg(known.alias("pos"), F.round(known / (F.count("*") + 1), 9).alias("s"))
        good = cut(good.where((F.col("pos") >= support) & (F.col("s") >= trust)).select("p", "s"))
        held = spread(edges, "pattern", good, "p", good.count())
        scores = held.groupBy(F.col("instance").alias("key")).agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("s")))), 9).alias("score"))
        scores = cut(scores.where(F.col("score") >= accept))
        edges = cut(spread(edges, "instance", scores, "key", scores.count(), "left").select("pattern", "instance", (F.col("known") | F.col("key").isNotNull()).alias("known")))
    return scores


def find(documents: DataFrame, key: str = "doc_id", text: str = "text", **bounds: float) -> DataFrame:
    """A row for each row of documents: the key, base counts, a digest of the base spans, and all spans.

    n_email, n_ip, n_card and n_phone count the base spans; base_sha256 is the SHA-256 of
    kind:start:end of each, by start, then kind, joined by commas; spans holds base spans and
    those found by context, in the same form; n_found counts the latter.  Places are code points,
    the end exclusive.  A null text is empty; null keys and repeated rows each give their row;
    other columns are left out.  Identifiers found by context have at most 254 code points.
    ``bounds`` are those of ``bootstrap``.  An empty table gives an empty table.
    """
    read = _read(documents, key, text)
    base, candidates = spans(read)
    candidates = cut(candidates)
    all_spans = base.withColumn("base", F.lit(True))
    scores = bootstrap(candidates, **bounds)
    if scores is not None:
        fits = F.array(*[F.expr(f"case when {test} then '{k}' end") for k, test in _FITS.items()])
        open_ = candidates.where("seed is null").select("row", "start", "end", "instance", F.explode(F.array_compact(fits)).alias("kind"))
        open_ = open_.withColumn("at", F.concat_ws(" ", "kind", "instance"))
        rank = F.struct(F.col("score"), *[F.col("kind") == k for k in KINDS])
        hit = spread(open_, "at", scores, "key", scores.count()).groupBy("row", "start", "end").agg(F.max_by("kind", rank).alias("kind"))
        all_spans = all_spans.unionByName(hit.withColumn("base", F.lit(False)))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    by_row = all_spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind", "base"))).alias("s"))
    joined = read.select("id", "row").join(by_row, "row", "left").withColumn("s", F.coalesce("s", F.array().cast(by_row.schema["s"].dataType)))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base_of = F.filter("s", lambda x: x["base"])
    counts = [F.expr(f"cast(size(filter(s, x -> x.base and x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return joined.select(
        F.col("id").alias(key), *counts, F.sha2(said(base_of), 256).alias("base_sha256"), said(F.col("s")).alias("spans"),
        F.size(F.filter("s", lambda x: ~x["base"])).cast("long").alias("n_found"),
    )
