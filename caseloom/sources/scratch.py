"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the warehouse where that is unset. On a cluster a warehouse on the driver's own disk raises ValueError."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if place.partition(":")[0] == "file" and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return place


def fresh_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no rerun."""
    path = fresh_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a kept table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def smallest_reachable(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node that a node is joined with by edges a, b (long).

    Each round a node takes the smallest root of its neighbours, then the root of that root, so that labels travel
    twice as far each time. Every round is written and the one before deleted.
    """
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    now = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), "node").alias("root")), "roots")
    for _ in range(most_rounds):
        near = both.join(now, both.b == now.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = now.join(near, "node").select("node", F.least("root", "near").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = kept(step.join(jump, "root").select("node", "above"), "roots")
        before, now = now, new.select("node", F.col("above").alias("root"))
        changed = now.join(before.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        dropped(before)
        if not changed:
            dropped(both)
            return now
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
