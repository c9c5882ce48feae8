"""Scores of predictions against gold, summaries of runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafita.sources.shared import cut, dealt


def safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn", digits: int = 6) -> list[Column]:
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return [F.round(safe(t, t + p), digits).alias("precision"), F.round(safe(t, t + n), digits).alias("recall"), F.round(safe(2 * t, 2 * t + p + n), digits).alias("f1")]


def compare(pred: DataFrame, gold: DataFrame, keys: Sequence[str], by: Sequence[str] = (), rows: int = 0) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two sets of keys, for each group.

    Both sets are grouped by their keys at once; a null key equals none of the other set.
    With ``rows``, about how many both have, they are dealt by ``by`` over as many tasks
    as that takes, for groups that are small.
    """
    side = lambda df, p: df.select(*keys, F.lit(p).alias("p"), F.lit(1 - p).alias("g"))
    either = side(pred, 1).unionByName(side(gold, 0))
    alone = F.when(F.greatest(F.lit(False), *[F.col(k).isNull() for k in keys]), F.col("p")).alias("__alone")
    both = dealt(either, rows, *by).groupBy(*keys, alone).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    counts = both.groupBy(*by).agg(F.sum(F.col("p") * F.col("g")).alias("tp"), F.sum(F.col("p") * (1 - F.col("g"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("g")).alias("fn"))
    return counts.select(*by, "tp", "fp", "fn", *prf())


def diff(pred: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key with MATCH, FALTA EN PRED or SOBRA EN PRED."""
    p, g = pred.select(*keys).distinct().withColumn("p", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    return p.join(g, list(keys), "full_outer").select(*keys, F.when(F.col("p").isNull(), "FALTA EN PRED").when(F.col("g").isNull(), "SOBRA EN PRED").otherwise("MATCH").alias("status"))


def diff_report(pred: DataFrame, gold: DataFrame, by: Sequence[str], key: Sequence[str], good_above: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Items side by side, and groups with their counts and a verdict.

    pred and gold: by, key and props (a map).  Items: by, key, pred and gold (their props as
    JSON, keys in order; null where there is none) and status; of an item given twice the
    smaller JSON is shown.  Groups: by, matches, missing, extra, f1 and verdict, good above
    ``good_above``, else bad.  Null keys equal each other.
    """
    json = lambda df, name: df.groupBy(*by, *key).agg(F.min(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("props"))))).alias(name), F.lit(True).alias(f"in_{name}"))
    keys = [*by, *key]
    p, g = json(pred, "pred"), json(gold, "gold").withColumnsRenamed({k: f"__{k}" for k in keys})
    both = p.join(g, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "full_outer")
    status = F.when(F.col("in_pred").isNull(), "FALTA EN PRED").when(F.col("in_gold").isNull(), "SOBRA EN PRED").otherwise("MATCH")
    items = both.select(*[F.when(F.col("in_pred").isNull(), F.col(f"__{k}")).otherwise(F.col(k)).alias(k) for k in keys], "pred", "gold", status.alias("status"))
    n = lambda s: F.count_if(F.col("status") == s)
    counts = items.groupBy(*by).agg(n("MATCH").alias("matches"), n("FALTA EN PRED").alias("missing"), n("SOBRA EN PRED").alias("extra"))
    f1 = safe(2 * F.col("matches"), 2 * F.col("matches") + F.col("missing") + F.col("extra"))
    return items, counts.withColumn("f1", F.round(f1, 6)).withColumn("verdict", F.when(F.col("f1") > good_above, "good").otherwise("bad"))


def macro(scores: DataFrame, digits: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Means of the groups' scores and sums of their counts (J04); with ``by`` for each label or type, over the groups that have it."""
    return scores.groupBy(*by).agg(*[F.round(F.avg(c), digits).alias(c) for c in ("precision", "recall", "f1")], *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def confusion(pred: DataFrame, gold: DataFrame, key: str, item: str) -> DataFrame:
    """tp, fp, fn, tn over every group and every item seen at all (J09), without a product of the two."""
    c = compare(pred, gold, [key, item])
    every = pred.select(key, item).unionByName(gold.select(key, item))
    size = every.agg((F.countDistinct(key) * F.countDistinct(item)).alias("size"))
    return c.join(F.broadcast(size)).select("tp", "fp", "fn", (F.col("size") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def latency(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, median, p95 by linear interpolation, n (J16).  The quantiles are exact; no task holds a group's values."""
    q = quantiles(df, value, by, {"median": 0.5, "p95": 0.95})
    mean = df.groupBy(*by).agg(F.round(F.avg(value), 2).alias("mean"), F.count(value).alias("n"))
    shown = [F.round(c, 2).alias(c) for c in ("median", "p95")]
    if not by:
        return mean.join(F.broadcast(q)).select("mean", *shown, "n")
    names = {k: f"__k{i}" for i, k in enumerate(by)}
    same = [mean[k].eqNullSafe(F.col(n)) for k, n in names.items()]
    return mean.join(q.withColumnsRenamed(names), same, "left").select(*by, "mean", *shown, "n")


#: Points of a bracket's approximate distribution, its accuracy, and values of a group that may be sorted at once.
_POINTS, _ACCURACY, _SORTED = 256, 2000, 10_000


def quantiles(df: DataFrame, value: str, by: Sequence[str], wanted: dict[str, float], sorted_at_once: int = _SORTED) -> DataFrame:
    """by and the exact quantiles of each group, linear between neighbours, as percentile gives them.

    The value of a rank is found by narrowing a bracket: an approximate distribution of the
    values in it names four that enclose the rank for certain, as its error is less than the
    distance of its points; exact counts tell whether one of them is the value, or between
    which two it lies.  A bracket loses all but about a hundredth of its values in each
    round, whatever they are; once it has at most ``sorted_at_once`` they are sorted, and no
    others.  Counts and distributions are combined in tasks, so a group that has all rows is
    no hot task.  Nulls do not count; NaN sorts above all numbers; a group of nulls has nulls.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("__x"))
    every = cut(rows.groupBy(*keys).agg(F.count("__x").alias("__n")))
    places = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(p) * (F.col("__n") - 1)).alias("at")) for n, p in wanted.items()])
    asks = every.where("__n > 0").select(*keys, "__n", F.explode(places).alias("p")).select("*", "p.name", "p.at")
    ranks = asks.select(*keys, "__n", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("__rank")).distinct()
    none = F.lit(None).cast("double")
    # a bracket: the values between lo and hi (null: no bound), how many there are, and how many lie below
    state = [*keys, "__rank", "__lo", "__hi", "__in", "__below"]
    open_ = cut(ranks.select(*keys, "__rank", none.alias("__lo"), none.alias("__hi"), F.col("__n").alias("__in"), F.lit(0).cast("long").alias("__below")))
    inside = (F.col("__lo").isNull() | (F.col("__x") > F.col("__lo"))) & (F.col("__hi").isNull() | (F.col("__x") < F.col("__hi")))

    def held(brackets: DataFrame) -> DataFrame:
        """The values in each bracket; brackets are a few a group, and broadcast while they are few."""
        named = brackets.withColumnsRenamed({k: f"{k}b" for k in keys})
        named = F.broadcast(named) if not keys or named.count() <= 10_000 else named
        return rows.where("__x is not null").join(named, [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys] + [inside])

    flat, short = [], []
    while True:
        few = F.col("__in") <= sorted_at_once
        short.append(open_.where(few))
        open_ = open_.where(~few)
        if open_.isEmpty():
            break
        bracket = [*keys, "__rank", "__in", "__below"]
        points = F.percentile_approx("__x", [i / _POINTS for i in range(_POINTS + 1)], _ACCURACY)
        told = held(open_).groupBy(*bracket).agg(points.alias("__g"), F.min("__x").alias("__min"), F.max("__x").alias("__max"))
        i = F.floor((F.col("__rank") - F.col("__below")) * _POINTS / F.col("__in")).cast("int")
        at = lambda d: F.get("__g", F.least(F.greatest(i + d, F.lit(0)), F.lit(_POINTS)))  # noqa: B023, E731
        named = F.array_sort(F.array_distinct(F.array("__min", at(-1), at(0), at(1), at(2), "__max")))
        named = cut(told.select(*bracket, named.alias("__c")).join(open_.select(*keys, "__rank", "__lo", "__hi").withColumnsRenamed({k: f"{k}o" for k in keys} | {"__rank": "__ro"}), [F.col(k).eqNullSafe(F.col(f"{k}o")) for k in keys] + [F.col("__rank") == F.col("__ro")]).select(*state, "__c"))
        less = [F.sum((F.col("__x") < F.get("__c", j)).cast("long")).alias(f"__l{j}") for j in range(6)]
        upto = [F.sum((F.col("__x") <= F.get("__c", j)).cast("long")).alias(f"__u{j}") for j in range(6)]
        counted = held(named).groupBy(*bracket, "__c").agg(*less, *upto)
        r = F.col("__rank") - F.col("__below")
        is_, lo, hi, under, upper = none, none, none, F.lit(0).cast("long"), F.col("__in")
        for j in range(6):
            is_ = F.when((F.col(f"__l{j}") <= r) & (r < F.col(f"__u{j}")), F.get("__c", j)).otherwise(is_)
            lo, under = (F.when(F.col(f"__u{j}") <= r, x).otherwise(y) for x, y in ((F.get("__c", j), lo), (F.col(f"__u{j}"), under)))
        for j in reversed(range(6)):
            hi, upper = (F.when(F.col(f"__l{j}") > r, x).otherwise(y) for x, y in ((F.get("__c", j), hi), (F.col(f"__l{j}"), upper)))
        step = cut(counted.select(*keys, "__rank", is_.alias("__v"), lo.alias("__lo"), hi.alias("__hi"), (upper - under).alias("__in"), (F.col("__below") + under).alias("__below")))
        flat.append(step.where("__v is not null").select(*keys, "__rank", "__v"))
        open_ = step.where("__v is null").select(*state)
    nth = held(reduce(DataFrame.unionByName, short)).groupBy(*keys, "__rank", "__below").agg(F.array_sort(F.collect_list("__x")).alias("__xs"))
    sorted_ = nth.select(*keys, "__rank", F.get("__xs", (F.col("__rank") - F.col("__below")).cast("int")).alias("__v"))
    found = cut(reduce(DataFrame.unionByName, [*flat, sorted_]))
    for end in ("floor", "ceil"):
        names = {k: f"{k}{end}" for k in keys} | {"__rank": f"__r{end}", "__v": f"__v{end}"}
        side = found.withColumnsRenamed(names)
        asks = asks.join(side, [F.col(k).eqNullSafe(F.col(names[k])) for k in keys] + [F.expr(f"{end}(at)") == F.col(names["__rank"])])
    part = F.col("at") - F.floor("at")
    between = F.when(F.col("__vfloor") == F.col("__vceil"), F.col("__vfloor")).otherwise((1 - part) * F.col("__vfloor") + part * F.col("__vceil"))
    told = asks.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, between)).alias(n) for n in wanted]).withColumnsRenamed({k: f"{k}t" for k in keys})
    out = every.join(told, [F.col(k).eqNullSafe(F.col(f"{k}t")) for k in keys] or F.lit(True), "left")
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], *wanted)


def retrieval_summary(records: DataFrame, by: Sequence[str], category: str | None = None) -> DataFrame:
    """Per group: counts, mean scores of judged rows, quality over judged and sentinel rows.

    records: by, sentinel (boolean), right (boolean, of sentinels), tp, fp, fn and, if there
    is one, chat: a judged row taken for small talk, which scores 0 whatever was found.
    With ``category`` a row for each category, too: by_category is the mean over its judged
    rows of the mean of precision and recall, and over its sentinels of 0 or 1.
    """
    t, p, n = F.col("tp"), F.col("fp"), F.col("fn")
    judged = ~F.col("sentinel")
    lost = F.coalesce(F.col("chat"), F.lit(False)) if "chat" in records.columns else F.lit(False)
    scored = lambda x: F.when(lost, F.lit(0.0)).otherwise(x)
    precision, recall, f1 = scored(safe(t, t + p)), scored(safe(t, t + n)), scored(safe(2 * t, 2 * t + p + n))
    right = F.when(F.col("sentinel"), F.col("right").cast("double"))
    mean = lambda x: F.round(F.avg(x), 4)
    summary = [
        F.count("*").alias("n"), F.sum(F.when(judged, t)).alias("tp"), F.sum(F.when(judged, p)).alias("fp"), F.sum(F.when(judged, n)).alias("fn"),
        mean(F.when(judged, f1)).alias("f1"), mean(F.coalesce(right, f1)).alias("quality"), mean(right).alias("sentinel_accuracy"),
    ]
    if category is None:
        return records.groupBy(*by).agg(*summary)
    summary += [mean(F.when(judged, precision)).alias("precision"), mean(F.when(judged, recall)).alias("recall"), mean(F.coalesce(right, (precision + recall) / 2)).alias("by_category")]
    return records.groupBy(*by, category).agg(*summary)


def doc_topics(scored: DataFrame, floor: float) -> DataFrame:
    """(project, doc, topic): chunks at or above the floor, their summed logit, highest score and first chunk."""
    return scored.where(F.col("score") >= floor).groupBy("project", "doc", "topic").agg(F.count("*").alias("mentions"), F.sum("logit").alias("logit"), F.max(F.round("score", 4)).alias("best"), F.min("chunk").alias("first_chunk"))


def project_topics(topics: DataFrame, totals: DataFrame) -> DataFrame:
    """coverage (mentions over all chunks, blank ones too) and confidence (logit a mention)."""
    by = topics.groupBy("project", "topic").agg(F.sum("mentions").alias("mentions"), F.sum("logit").alias("logit"), F.min("first_chunk").alias("first_chunk"))
    return by.join(totals, "project").select("project", "topic", "mentions", "first_chunk", F.round(F.col("mentions") / F.col("total"), 6).alias("coverage"), F.round(F.col("logit") / F.col("mentions"), 6).alias("confidence"))


def select_topics(pt: DataFrame, coverage: float, confidence: float, least: int) -> DataFrame:
    """Topics past both thresholds; a project with fewer than ``least`` is filled up with its best others."""
    ok = (F.col("coverage") >= coverage) & (F.col("confidence") >= confidence)
    t = pt.withColumn("passing", ok)
    t = t.withColumn("passed", F.sum(F.col("passing").cast("int")).over(Window.partitionBy("project")))
    w = Window.partitionBy("project", "passing").orderBy(F.desc("coverage"), F.desc("confidence"), "first_chunk", "topic")
    return t.withColumn("place", F.row_number().over(w)).where(F.col("passing") | (F.col("place") <= least - F.col("passed"))).select("project", "topic", (~F.col("passing")).alias("fallback"))


def sweep(scored: DataFrame, totals: DataFrame, gold: DataFrame, grid: DataFrame) -> DataFrame:
    """Scores of every configuration (cfg, floor, cov, conf) in one job over the same raw scores.

    The grid is small by nature.  A raw row is counted once, in the band of the highest
    floor it reaches; a configuration adds up the bands from its own floor on.
    """
    floors = [r[0] for r in grid.select("floor").distinct().orderBy("floor").collect()]  # a value a floor
    band = sum((F.when(F.col("score") >= x, 1).otherwise(0) for x in floors), F.lit(0))
    own = sum((F.when(F.col("floor") >= x, 1).otherwise(0) for x in floors), F.lit(0))
    bands = scored.groupBy("project", "topic", band.alias("band")).agg(F.count("*").alias("mentions"), F.sum("logit").alias("logit")).where("band > 0")
    cfgs = F.broadcast(grid.select("cfg", "cov", "conf", own.alias("own")))
    by = bands.join(cfgs, F.col("band") >= F.col("own")).groupBy("cfg", "cov", "conf", "project", "topic").agg(F.sum("mentions").alias("mentions"), F.sum("logit").alias("logit")).join(totals, "project")
    passing = by.where((F.col("mentions") / F.col("total") >= F.col("cov")) & (F.col("logit") / F.col("mentions") >= F.col("conf"))).select("cfg", "project", "topic")
    g = gold.select("project", "topic").distinct().withColumn("g", F.lit(1))
    hits = passing.join(g, ["project", "topic"], "left").groupBy("cfg").agg(F.count("g").alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"))
    n = g.agg(F.count("*").alias("n"))  # one row
    t = grid.select("cfg").join(hits, "cfg", "left").crossJoin(F.broadcast(n)).select("cfg", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"), "n")
    return t.select("cfg", "tp", "fp", (F.col("n") - F.col("tp")).alias("fn")).select("cfg", "tp", "fp", "fn", *prf())


def best_combo(summary: DataFrame, label: str, quality: str) -> DataFrame:
    """Combos by quality, best first, with the display floor."""
    floor = F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.floor((F.min(quality) - 0.03) / 0.05) * 0.05))
    low = summary.agg(F.round(floor, 2).alias("floor"))  # one row
    return summary.select(label, quality).crossJoin(F.broadcast(low))
