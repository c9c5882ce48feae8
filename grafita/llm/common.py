"""Small helpers shared by the operators: tables, checkpoints and bounded broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the cluster's checkpoint folder and cuts its lineage.

    The folder is the one named in spark.checkpoint.dir; only a session on one machine
    (a test) may have none and gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within the limit, else df as it is."""
    return F.broadcast(df) if rows <= limit else df


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def set_aside(df: DataFrame, *read: str) -> tuple[DataFrame, list[Column]]:
    """df with all columns but ``read`` under numbered names, which no operator adds, and the columns that bring the names back.

    Python functions over a DataFrame can't take names with dots either.
    """
    names = {n: n if n in read else f"__c{i}" for i, n in enumerate(df.columns)}
    return df.select(*[F.col(quoted(n)).alias(c) for n, c in names.items()]), [F.col(c).alias(n) for n, c in names.items()]


def comparable(df: DataFrame) -> list[str]:
    """Names of the columns that can be hashed and ordered: those without maps."""
    return [f.name for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def partitions(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions so that each holds about per_partition rows, no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))
