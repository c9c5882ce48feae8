"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its token share to the power of an exponent a, normalised:
a = 1 keeps the shares, a = 0 makes all sources equal.  The exponent is bisected, on
the table of sources, to the largest one in [0, 1] whose weights reach a target
entropy; if no a <= 1 within a limit on repetition does, the limit wins.  Weights
become token budgets.  A source's rows are dealt into blocks of bounded size; the
blocks are permuted, and the rows in each; a budget is filled by reading this
permutation round after round until it is spent.

Nothing is ordered over a whole source: budgets are prefix sums over a source's
blocks (one row a block, in turn split into chunks) and then over one block's rows.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafita.llm.common import comparable, cut, quoted, small

_WAYS = 32


def word_count(text: str = "text") -> Column:
    """Runs of characters other than space, tab, LF, VT, FF and CR."""
    return F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_tokens(documents: DataFrame, source: str = "source") -> DataFrame:
    """name (the source; null is a source of its own) and tokens (words, at least one a row)."""
    return documents.groupBy(F.col(f"`{source}`").alias("name")).agg(F.sum(F.greatest(word_count(), F.lit(1))).alias("tokens"), F.count("*").alias("rows"))


def temperature(sources: DataFrame, target_entropy: float, max_repeat: float) -> tuple[float, float]:
    """The exponent, and ln of the budget in tokens for weight 1.

    ``target_entropy`` is a share of the largest possible entropy, the log of the number
    of sources.  The budget is the smallest at which no source is cut short, so the
    source with the least repetition is read once; the largest repetition is then
    (largest / smallest source) ** (1 - a), which the limit bounds.  Each pass over the
    sources halves the bracket five times: it tries the 31 points in between at once.
    """
    known = sources.where("tokens > 0").select(F.log(F.col("tokens").cast("double")).alias("x"))
    n, top, low = known.agg(F.count("*"), F.max("x"), F.min("x")).first()
    if not n or n == 1 or top == low:
        return 1.0, 0.0  # one source, or equal ones: each is read once
    # repetition: exp((1 - a) * (top - low)) <= max_repeat
    floor = max(0.0, 1.0 - log(max_repeat) / (top - low))
    a, b = floor, 1.0
    need = target_entropy * log(n)
    for _ in range(8):
        points = [a + (b - a) * k / _WAYS for k in range(_WAYS + 1)]
        sums = []
        for k, p in enumerate(points):
            w = F.exp((F.col("x") - F.lit(top)) * F.lit(p))
            sums += [F.sum(w).alias(f"z{k}"), F.sum(w * (F.col("x") - F.lit(top)) * F.lit(p)).alias(f"y{k}")]
        got = known.agg(*sums).first()
        entropy = [log(got[f"z{k}"]) - got[f"y{k}"] / got[f"z{k}"] for k in range(_WAYS + 1)]
        reached = [k for k in range(_WAYS + 1) if entropy[k] >= need]
        if not reached:
            return a, float(top - top * a)  # out of reach within the limit
        k = max(reached)
        if k == _WAYS:
            a = b
            break
        a, b = points[k], points[k + 1]
    return a, float(top - top * a)


def _counted_once(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """rows with __copies: rows that are equal in all columns become one, so they are one row of their block."""
    again = cut(narrow.groupBy(F.col("__i").alias("__ri"), F.col("__e").alias("__re")).count().where("count > 1").select("__ri", "__re"))
    n = again.count()
    one = rows.withColumn("__copies", F.lit(1).cast("long"))
    if not n:
        return one
    same, again = (F.col("__i") == F.col("__ri")) & (F.col("__e") == F.col("__re")), small(again, n)
    equal = rows.join(again, same, "left_semi").groupBy("__i", "__e").agg(F.first(F.struct(*[quoted(c) for c in rows.columns])).alias("__row"), F.count("*").alias("__copies"))
    return one.join(again, same, "left_anti").unionByName(equal.select("__row.*", "__copies"))


def _copies(placed: DataFrame, at_once: int) -> DataFrame:
    """Each of the equal rows again, one after the other in tokens; many copies are made by many tasks."""
    many = placed.where("__copies > 1").withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(at_once).cast("long")))).repartition("__i", "__from")
    each = F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + at_once, F.col("__copies")) - 1))
    many = many.withColumn("__k", each).withColumn("mix_at", F.col("mix_at") + F.col("__k") * F.col("mix_tokens")).drop("__from", "__k")
    return placed.where("__copies = 1").unionByName(many)


def mix(documents: DataFrame, target_entropy: float = 0.9, max_repeat: float = 2.0, block_rows: int = 5_000, seed: int = 7, source: str = "source", key: str = "doc_id") -> DataFrame:
    """Every row of documents, once for each time that its source's budget reads it.

    Adds mix_tokens, mix_block (the row's block, in the order read), mix_at (tokens of the
    source before the row) and mix_round (from 0); columns of these names are replaced.
    A source's budget is read round after round over one permutation: round r reads the
    row if r rounds and mix_at come to less than the budget, so a budget is met to within
    one row.  The budgets cut no source short: every row is read at least once, no row
    more than ceil(max_repeat) times.  A null source is a source of its own; a row
    without words counts as one token; equal rows each take a place, one after the other, and are placed as one row.  An empty table
    gives an empty table.
    """
    names = [n for n in documents.columns if n not in ("mix_tokens", "mix_block", "mix_at", "mix_round")]
    plain = comparable(documents)
    whole = [F.col(quoted(n)) if n in plain else F.to_json(F.col(quoted(n))) for n in names]
    rows = documents.select(
        *[F.col(quoted(n)) for n in names], F.greatest(word_count(), F.lit(1)).alias("mix_tokens"),
        F.xxhash64(F.lit(seed), *whole).alias("__i"), F.xxhash64(F.lit(seed + 2), *whole).alias("__e"),
    )
    # texts are counted here and once more when rows are given out; what lies between reads this narrow table
    narrow = cut(rows.select(F.col(quoted(source)).alias("__s"), "mix_tokens", "__i", "__e"))
    rows = _counted_once(rows, narrow)
    sizes = cut(narrow.groupBy(F.col("__s").alias("name")).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("rows")))
    a, scale = temperature(sizes, target_entropy, max_repeat)
    budgets = sizes.select(
        F.col("name").alias("__n"), F.col("tokens").alias("__all"),
        F.greatest(F.col("tokens"), F.floor(F.pow(F.col("tokens").cast("double"), F.lit(a)) * F.exp(F.lit(scale)) + F.lit(1e-6)).cast("long")).alias("__budget"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / block_rows)).cast("long").alias("__blocks"),
    )
    budgets = small(budgets, sizes.count())
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "__i"), F.col("__blocks"))
    rows = rows.join(budgets, F.col(quoted(source)).eqNullSafe(F.col("__n"))).withColumn("mix_block", block)
    dealt = narrow.join(budgets.select("__n", "__blocks"), F.expr("__s <=> __n")).withColumn("mix_block", block)
    # tokens before each block: over a source's chunks of 4096 blocks, then within a chunk
    blocks = cut(dealt.groupBy("__n", "mix_block").agg(F.sum("mix_tokens").alias("__bt")).withColumn("__c", F.shiftright(F.col("mix_block"), 12)))
    before = lambda over: F.coalesce(F.sum(over[0]).over(over[1].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = blocks.groupBy("__n", "__c").agg(F.sum("__bt").alias("__ct")).withColumn("__c0", before(("__ct", Window.partitionBy("__n").orderBy("__c"))))
    starts = blocks.withColumn("__b0", before(("__bt", Window.partitionBy("__n", "__c").orderBy("mix_block")))).join(chunks.withColumnRenamed("__n", "__m").withColumnRenamed("__c", "__d"), F.expr("__n <=> __m and __c = __d"))
    starts = starts.select(F.col("__n").alias("__sn"), F.col("mix_block").alias("__sb"), (F.col("__b0") + F.col("__c0")).alias("__start"))
    inside = Window.partitionBy("__n", "mix_block").orderBy("__i", F.col(quoted(key)))
    rows = rows.withColumn("__w", F.col("mix_tokens") * F.col("__copies"))
    placed = rows.withColumn("__p", before(("__w", inside))).join(starts, F.expr("__n <=> __sn and mix_block = __sb"))
    placed = _copies(placed.withColumn("mix_at", F.col("__p") + F.col("__start")), block_rows)
    reads = F.expr("(__budget - mix_at + __all - 1) div __all")
    out = placed.withColumn("mix_round", F.explode(F.sequence(F.lit(0), (F.greatest(reads, F.lit(1)) - 1).cast("int"))))
    return out.select(*[F.col(quoted(n)) for n in names], "mix_tokens", "mix_block", "mix_at", "mix_round")
