"""Search of texts by what they contain, by postings of their trigrams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafita.sources.versions import Store


def grams(text: Column) -> Column:
    """Distinct runs of three characters of a lower-cased text; shorter texts have none."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1)))
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def index_texts(store: Store, rows: DataFrame, key: str, texts: Sequence[str], name: str = "texts") -> None:
    """Keeps rows by their key, and the keys of each trigram of any of their texts, in one version.

    A row's key must be its own.  Null texts have no trigrams.  Postings lie in buckets by
    trigram, rows in buckets by key, so a search reads a few of both; a later call adds rows.
    """
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(F.col(t)), F.array().cast("array<string>")) for t in texts])))
    postings = rows.select(F.explode(every).alias("gram"), F.col(key).alias("key"))
    store.append({name: (rows, [key]), f"{name}_grams": (postings, ["gram"])}, {f"{name}_fields": ",".join([key, *texts])})
    for n in (name, f"{name}_grams"):
        store.compact(n)


def candidates(store: Store, term: str, name: str = "texts") -> DataFrame | None:
    """Keys of the rows that have all trigrams of a term; None if it is too short to have any."""
    low = term.lower()
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not wanted:
        return None
    asked = store.spark.createDataFrame([(g,) for g in wanted], "gram string")
    held = store.read(f"{name}_grams", near=asked).join(F.broadcast(asked), "gram", "left_semi")
    return held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= len(wanted)).select("key")


def search(store: Store, term: str, name: str = "texts") -> DataFrame:
    """Rows one of whose texts contains the term, whatever its case.

    Trigrams leave the rows that may; those are read and looked at.  A term of fewer than
    three characters is looked for in all rows; an empty one is in every row with a text.
    """
    key, *texts = store.manifest()["notes"][f"{name}_fields"].split(",")
    found = candidates(store, term, name)
    if found is None:
        rows = store.read(name)
    else:
        keys = found.withColumnRenamed("key", key)
        rows = store.read(name, near=keys).join(keys, key, "left_semi")
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(t)), F.lit(term.lower())), F.lit(False))
    return rows.where(hit)


