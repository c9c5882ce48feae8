"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as
Parquet and reads back as the next one's docs.  All but the last return the columns of
``documents``:

toxicity    a classifier learnt from ``labels`` scores every text; toxic ones go.
near_dedup  of each group of near-duplicate texts the smallest doc_id stays, and of rows
            that repeat a doc_id and text one; texts that share a doc_id are judged each.
substring   passages of 35 words that start anywhere else are cut out of all texts; a
            document that is left without words stays, with an empty text.
mixing      rows are read as often as their source's temperature weight tells, none never.
packing     pieces of at most 1024 tokens, placed into sequences.

Null texts count as empty, are never toxic by their words, duplicates of nothing, and are
packed as an end mark alone.  Rows with a null doc_id pass the first four stages.  Extra
columns are carried along as they are, whatever their names; of rows that repeat a doc_id
and text but differ elsewhere, the smallest stays.  Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafita.llm import minhash, mixing, packing, substring_dedup, toxicity
from grafita.llm.common import comparable, cut, set_aside, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_from_tables(docs, table(spark, sf_dir, "labels"))
    rows, back = set_aside(docs, "text")
    return toxicity.score(rows, model).where("predicted = 0").select(*back)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    same = ["doc_id", "__a", "__b"]
    docs, back = set_aside(docs, "doc_id", "text")
    names = docs.columns
    rows = docs.withColumn("__a", F.xxhash64("text")).withColumn("__b", F.xxhash64(F.lit(1), "text"))
    known = rows.where("doc_id is not null")
    # narrow: a row for each (doc_id, text), where a doc_id has more rows than one
    again = cut(known.join(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "doc_id", "left_semi").groupBy(same).agg(F.count("*").alias("__c")))
    if again.isEmpty():
        gone = minhash.near_duplicates(docs.select("doc_id", "text"), threshold=0.8).where("not kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*back)
    repeated = again.where("__c > 1").select(*same)
    one = known.join(repeated, same, "left_semi").groupBy(same).agg(F.min_by(F.struct(*names), F.struct(*comparable(docs))).alias("__row"))
    one = one.select("__row.*", "__a", "__b").select(*rows.columns)
    single = known.join(repeated, same, "left_anti").select(*rows.columns).unionByName(one)
    # each (doc_id, text) gets a number; numbers are in the order of doc_id
    numbers = cut(known.select(*same).distinct().repartitionByRange(*same).sortWithinPartitions(*same).withColumn("__n", F.monotonically_increasing_id()))
    single = single.join(numbers, same)
    gone = minhash.near_duplicates(single.select(F.col("__n").alias("doc_id"), "text"), threshold=0.8).where("not kept").select(F.col("doc_id").alias("__n"))
    return single.join(gone, "__n", "left_anti").select(*names).unionByName(docs.where("doc_id is null")).select(*back)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = set_aside(docs, "doc_id", "text", "n_chars")
    left = substring_dedup.remove_repeats(rows, window=35)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return left.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = set_aside(docs, "doc_id", "text", "source")
    return mixing.mix(rows, target_entropy=0.9, max_repeat=2.0).select(*back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024), 1024)


STAGES = [("toxicity", toxic_out), ("near_dedup", near_duplicates_out), ("substring", repeats_out), ("mixing", mixed), ("packing", packed)]

#: A classifier, signatures and a packing rule are not SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read back."""
    docs = table(spark, sf_dir, "documents")
    cut(spark.range(0))  # sees to the folder
    root = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
