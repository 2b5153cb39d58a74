"""What the training-data operators share: the scratch folder, written tables, prefix sums, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset.

    A warehouse on the driver's own disk will do in local mode alone: on a cluster it raises an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if path.partition(":")[0] == "file" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{path}/_scratch"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def erase(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for f in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


_memory: dict[str, object] = {}


def remembered(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between its tasks: of one name at a time, so that operators' memories do not add up."""
    if name not in _memory:
        _memory.clear()
        _memory[name] = make()
    return _memory[name]


def forget() -> None:
    """Drop what the worker keeps of earlier tasks."""
    _memory.clear()


def with_offsets(df: DataFrame, keys: list[str], bucket: str, size: Column, order: list[Column], upto: str) -> DataFrame:
    """df with upto: the running sum of size within keys, ordered by bucket, then order, this row included.

    Two levels: sums of each (keys, bucket) go through a small window, and rows through a window of their
    own bucket, so that a key with most of the rows is shared by as many tasks as it has buckets.
    """
    df = df.withColumn("_w", size)
    sums = df.groupBy(*keys, bucket).agg(F.sum("_w").alias("_sum"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(sums, [*keys, bucket]).withColumn(upto, F.col("_before") + F.sum("_w").over(inside)).drop("_w", "_before")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """(node, root) of every node of the edges (two long columns): root is the smallest node it is joined with.

    Alternating large-star and small-star steps: each node hands its larger neighbours, then its smaller
    ones, to the smallest it knows. The edge list never grows, and each round is written to the shared folder.
    """
    old = written(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = old.select("u", "v").union(old.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        new = written(new.distinct(), "edges")
        was, mark = mark, new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        erase(old)
        old = new
        if was == mark:
            break
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = old.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return old.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
