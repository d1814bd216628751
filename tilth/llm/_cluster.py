"""What the operators share about the cluster: the shared folder, lineage cuts, connected components."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local run (one process)
    gets a temporary folder; on a cluster it is an error, as executors wouldn't see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tilth-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps now, not when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts_for(df: DataFrame, size, per_part: int) -> int:
    """So many partitions that each gets about ``per_part`` of the column expression ``size`` summed over all rows."""
    total = df.select(F.sum(size).alias("s")).first()["s"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // per_part) + 1)


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links by alternating large and small stars; returns (node, component),
    one row for each node in a link, the component being its smallest node. Only minima and joins on a node are
    used, so a node with very many links is split like any skewed join and nothing comes to the driver but one
    checksum a round. Rounds end when nothing changes any more, after a logarithm of the nodes. Null ends and self links
    are ignored. No rows give no rows."""
    links = cut(
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        links = cut(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        after = state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def dealt_in_order(df: DataFrame, *order: str) -> DataFrame:
    """``df`` dealt out by ranges of ``order``, with each row's range number as ``pid``; the ranges hold from then on.
    A window over (pid, key) then stays within a bounded part of even the largest key, and what crosses a border can
    be carried over from one row a (key, pid)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()))
