"""Reading tables, spreading work and cutting lineage; everything here is shared by the operators."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` with at least as many partitions as the cluster has cores.

    A table of one small file is read as one task, which would leave a CPU-bound Python stage on one core. Large tables
    have enough splits and pass unchanged, so no shuffle is added where data are big.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; later jobs read it there and survive lost executors.

    The folder is the one of the session (``spark.checkpoint.dir``). Only where none is set, as in tests, a temporary
    one is made, and only in local mode, where the driver's disk is the executors' disk.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row for each value of ``keys``: the last delivered. Repeated deliveries differ in ``at`` alone.

    The maximum combines before the shuffle, so that a key with very many deliveries is no hot group. Rows whose ``at`` is
    null count as delivered first; of rows delivered at once the greater counts. Rows with a null key are one group.
    """
    rest = [c for c in df.columns if c not in keys and c != at]
    last = F.max(F.struct(F.col(at).isNotNull().alias("_known"), F.col(at), *[F.col(c) for c in rest])).alias("_last")
    own = {c: F.col(c) if c in keys else F.col(f"_last.{c}") for c in df.columns}
    return df.groupBy(*keys).agg(last).select(*own.values())


def latest_if_delivered(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """:func:`latest` for tables that have a delivery time, without it; others, such as an index, have each key once."""
    if at not in df.columns:
        return df
    return latest(df, keys, at).drop(at)


def numbered(df: DataFrame, group: str, order: list[str], name: str = "n") -> DataFrame:
    """``df`` with a number from 1 in each group, in the given order, also where one group has most of the rows.

    Rows are sorted over the whole cluster by range, counted in each range, and numbered within it from where the ranges
    before end. No task has more than its range, however large the group is. A null group is a group.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in (group, *order)]).withColumn("_range", F.spark_partition_id())
    ranged = checkpointed(ranged)  # the borders of the ranges come from a sample and must be the same below
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(group, "_range").count()
    starts = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    same = [F.equal_null(F.col(group), F.col("_group")), F.col("_range") == F.col("_of")]
    joined = ranged.withColumn("_within", within).join(starts, reduce(lambda a, b: a & b, same))
    return joined.withColumn(name, F.col("_start") + F.col("_within")).select(*df.columns, name)
