"""Running sums and places over long ordered groups, none of which one task has to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafita.operators.history import numbered as numbered  # noqa: PLC0414 - the same mechanism without groups
from grafita.sources.shared import cut


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, Column], lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows with running sums, and last values that aren't null, up to and with each row of its group.

    Rows lie in range partitions of group and order; each partition works on its own part
    of a group, and then takes over what those before it made, one row a partition and
    group.  Orders must be unique within a group for the same result at every run.
    """
    lasts = lasts or {}
    t = rows.withColumns({f"__v{i}": c for i, c in enumerate([*sums.values(), *lasts.values()])})
    t = cut(t.repartitionByRange(*group, *order).withColumn("__p", F.spark_partition_id()))
    names = [*sums, *lasts]
    add = lambda i, w: F.sum(f"__v{i}").over(w) if i < len(sums) else F.last(f"__v{i}", ignorenulls=True).over(w)
    here = Window.partitionBy(*group, "__p").orderBy(*order)
    part = t.groupBy(*group, "__p").agg(*[(F.sum(f"__v{i}") if i < len(sums) else F.max_by(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), F.struct(*order)))).alias(f"__v{i}") for i in range(len(names))])
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__p").alias("__q"), *[add(i, before).alias(f"__b{i}") for i in range(len(names))])
    same = F.col("__p") == F.col("__q")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    t = t.withColumns({n: add(i, here) for i, n in enumerate(names)}).join(part, same)
    total = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"__b{i}"), F.lit(0)) if i < len(sums) else F.coalesce(F.col(n), F.col(f"__b{i}")) for i, n in enumerate(names)}
    return t.withColumns(total).select(*rows.columns, *names)


def next_at_least(points: DataFrame, group: str, at: str, wanted: str, width: int) -> DataFrame:
    """points with next: the least ``at`` of its group that is not less than ``wanted`` (null if there is none).

    Points of a group must lie closer than ``width``; each stretch of it is sorted apart, and
    a point that finds nothing in its own takes the first of the next.
    """
    stretch = lambda c: F.floor(F.col(c) / width)
    p = points.select(group, F.col(at).alias("__x"), F.lit(0).alias("__ask"), F.col(at).alias("__of"))
    q = points.select(group, F.col(wanted).alias("__x"), F.lit(1).alias("__ask"), F.col(at).alias("__of"))
    both = p.unionByName(q).withColumn("__s", stretch("__x"))
    down = Window.partitionBy(group, "__s").orderBy(F.desc("__x"), "__ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__n", F.last(F.when(F.col("__ask") == 0, F.col("__x")), ignorenulls=True).over(down)).where("__ask = 1")
    firsts = p.groupBy(F.col(group).alias("__g"), (stretch("__x") - 1).alias("__t")).agg(F.min("__x").alias("__first"))
    found = found.join(firsts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__s") == F.col("__t")), "left")
    found = found.select(F.col(group).alias("__h"), F.col("__of").alias("__o"), F.coalesce("__n", "__first").alias("next"))
    return points.join(found, F.col(group).eqNullSafe(F.col("__h")) & (F.col(at) == F.col("__o"))).drop("__h", "__o")


def reachable(jump: DataFrame, starts: DataFrame, keys: Sequence[str], to: str, rounds: int = 64) -> DataFrame:
    """Keys that chains from the starts come to: pointers double in each round, so a chain of n takes log n rounds.

    jump: keys, of which the last is replaced by ``to`` (null at a chain's end); starts: keys.
    """
    *head, last = keys
    jump = cut(jump.where(F.col(to).isNotNull()).select(*keys, to))
    reached = cut(starts.select(*keys))
    seen = reached.count()
    for _ in range(rounds):
        step = reached.join(jump, list(keys)).select(*head, F.col(to).alias(last))
        reached = cut(reached.unionByName(step).distinct())
        now = reached.count()
        if now == seen:
            return reached
        seen = now
        far = jump.select(*head, F.col(last).alias(to), F.col(to).alias("__far"))
        jump = cut(jump.join(far, [*head, to]).select(*keys, F.col("__far").alias(to)))
    raise RuntimeError(f"chains are longer than 2 ** {rounds}")
