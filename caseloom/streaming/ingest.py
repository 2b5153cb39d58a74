"""New records and states as they land: known keys and latest states are kept by the stream, not read from the target."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, key: str, checkpoint: str) -> int:
    """Append to target the rows of new files under source whose key it lacks; returns how many rows target has.

    Keys that came are the stream's state, one entry a key, and files seen in an earlier run are not read again: a batch
    reads its own files alone. What target holds before the first run is read once, as keys that are known. Of rows with
    one key the smallest stays; null is a key. A batch that runs again after a failure looks into target for what it wrote.
    """
    known = f"{checkpoint}-known"
    flagged = StructType([*schema.fields, StructField("_known", BooleanType())])
    if not _exists(spark, known):
        before = spark.read.schema(schema).parquet(target) if _exists(spark, target) else spark.createDataFrame([], schema)
        before.select(key).distinct().select(*(F.col(f.name) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in schema), F.lit(True).alias("_known")).write.parquet(known)

    def fresh(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, old = None, state.exists
        for p in parts:
            old = old or bool(p["_known"].eq(True).any())
            row = p.sort_values(list(p.columns)).head(1)
            first = row if first is None else pd.concat([first, row]).sort_values(list(p.columns)).head(1)
        if not state.exists:
            state.update((True,))
        if not old:
            yield first.drop(columns="_known")

    def append(batch: DataFrame, number: int) -> None:
        begun = f"{checkpoint}-begun/{number}"
        if _exists(spark, begun) and _exists(spark, target):
            batch = batch.join(spark.read.schema(schema).parquet(target).select(key), batch[key].eqNullSafe(F.col(key)), "left_anti")
        _touch(spark, begun)
        batch.write.mode("append").parquet(target)

    rows = spark.readStream.schema(schema).parquet(source).withColumn("_known", F.lit(None).cast("boolean"))
    rows = rows.unionByName(spark.readStream.schema(flagged).parquet(known))
    new = rows.groupBy(key).applyInPandasWithState(fresh, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)
    new.writeStream.foreachBatch(append).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(target).count() if _exists(spark, target) else 0


def latest_states(spark: SparkSession, source: str, schema: StructType, target: str, key: str, at: str, tie: str, checkpoint: str) -> DataFrame:
    """The latest state of each key, by `at`, then `tie`, after what landed under source since the last run.

    The latest state of a key is the stream's; a batch writes the keys that it changed to a folder of its own under target, so that
    a batch that runs again replaces what it wrote. Returned is the last one written of each key.
    """

    def changed(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/changes-{number:09d}")

    rows = spark.readStream.schema(schema).parquet(source)
    now = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*schema.names), F.struct(at, tie)).alias("s")).select("s.*")
    now.writeStream.foreachBatch(changed).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.option("recursiveFileLookup", True).parquet(target)
    return every.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*schema.names), "batch").alias("s")).select("s.*")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _touch(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
