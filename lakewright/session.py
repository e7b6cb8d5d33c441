"""Session helpers: the shared checkpoint folder, plan cutting, shuffle clean-up, joins whose hot keys are known."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most keys that a join treats as hot and broadcasts.
HOT_KEYS = 1000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a machine's own only in local mode without a named one."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that executors share")
        named = tempfile.mkdtemp(prefix="lakewright-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables of an iteration, each written in the shared folder and read again.

    What is read has its real size as statistics. A checkpoint keeps the estimates of the plan that made it,
    which square with every join of a round with the one before; after some twenty rounds the planner would
    multiply numbers of millions of digits.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/round-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Remove all tables but the last ``keep``, which nothing may need any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        while len(self.paths) > keep:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(0))
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished phases that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_counted(rows: DataFrame, table: DataFrame, key: str, held: str, spread: str, value: str) -> DataFrame:
    """``rows`` with column ``value`` of ``table``, which has one row per key and in ``held`` how many rows have it.

    A left join. Keys that hold more than 1 / HOT_KEYS of all rows, fewer than HOT_KEYS of them whatever
    the data, are broadcast and their rows stay where they are; no other key's rows are more than that
    part of the table in one task. Rows with a found value are dealt on by ``spread``. Null keys find
    nothing. ``table`` should be materialised: it is read three times.
    """
    total = table.agg(F.sum(held)).first()[0] or 0
    most = max(1, total // HOT_KEYS)
    t = table.select(F.col(key).alias("__key"), F.col(held).alias("__held"), F.struct(F.col(value).alias("v")).alias("__found"))
    hot = t.filter(F.col("__held") > most).select("__key", F.col("__found").alias("__hot"))
    met = rows.join(F.broadcast(hot), rows[key] == F.col("__key"), "left").drop("__key")
    cold = F.col("__hot").isNull() & F.col(key).isNotNull()
    met = met.withColumns({"__k": F.when(cold, F.col(key)), "__s": F.when(~cold, F.xxhash64(spread))})
    rest = t.filter(F.col("__held") <= most).select(F.col("__key").alias("__k"), F.lit(None).cast("long").alias("__s"), "__found")
    same = met["__k"].eqNullSafe(rest["__k"]) & met["__s"].eqNullSafe(rest["__s"])
    out = met.join(rest, same, "left")
    return out.select(*rows.columns, F.coalesce("__hot", "__found")["v"].alias(value))
