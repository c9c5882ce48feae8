"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task gets on average at most where tables are dealt by their size.
TASK_ROWS = 250_000
#: Options of Parquet files without dictionaries.
PLAIN = {"parquet.enable.dictionary": "false"}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the checkpoint folder.  Only a session on one machine may have none; it gets a local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read back."""
    shared_folder(df.sparkSession, "")
    return df.checkpoint()


def stored(df: DataFrame, plain: bool = False) -> DataFrame:
    """df, written to the shared folder as Parquet and read back: a tenth of what ``cut`` takes, for tables that are read several times.

    ``plain`` is for columns of mostly different values: no dictionaries are tried, which takes half the time.
    """
    path = shared_folder(df.sparkSession, "stored")
    df.write.options(**PLAIN if plain else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about ``rows`` rows, dealt by keys over as many tasks as they need; few rows stay as Spark deals them."""
    n = math.ceil(rows / TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def together(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about ``rows`` rows, dealt by keys whatever their number, over as many tasks as they need if there are cores for fewer."""
    n = math.ceil(rows / TASK_ROWS)
    return df.repartition(*([n] if n > df.sparkSession.sparkContext.defaultParallelism else []), *keys)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What queries in it shuffle goes from the disks as each of them ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
