"""Reading landed records and keeping tables: strict and tolerant scans, folds, upserts, skips, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W


def records(spark: SparkSession, path: str, schema: StructType, strict: bool = False, allowed: list[str] | None = None, skip: str | None = None) -> DataFrame:
    """JSON records under a folder, one a line, with path and _corrupt_record; strict stops at the first bad one.

    allowed: fields that may occur at all; a record with another is corrupt too. skip: paths that match it are no records. The last path of a key wins: see last_wins.
    """
    raw = spark.read.text(path, recursiveFileLookup=True).select(F.col("value").alias("raw"), F.input_file_name().alias("path")).where("trim(raw) <> ''")
    if skip:
        raw = raw.where(~F.col("path").rlike(skip))
    names = F.json_object_keys("raw")
    parsed = F.from_json("raw", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    bad = names.isNull()
    if allowed is not None:
        bad = bad | (F.size(F.array_except(names, F.lit(allowed))) > 0)
    if strict:
        bad = F.when(bad, F.raise_error(F.concat(F.lit("bad record in "), "path")).cast("boolean")).otherwise(False)
    return raw.select(F.when(~bad, parsed).alias("record"), "path", F.when(bad, F.col("raw")).alias("_corrupt_record"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: that of the last in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """doc_id, page_number, text from documents landed as one JSON file each, or one a line."""
    d = spark.read.schema("source_document_id string, page_count int, pages array<struct<page_number:int,text:string>>").json(path, multiLine=not lines, recursiveFileLookup=True)
    return d.select(F.col("source_document_id").alias("doc_id"), F.explode("pages").alias("p")).select("doc_id", "p.*")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old that new does not replace, and new."""
    return old.join(new, key, "left_anti").unionByName(new)


def with_sidecar(rules: DataFrame, sidecars: DataFrame, key: str) -> DataFrame:
    """Rules with their verification; those without have tier 0, not_run, unknown."""
    d = rules.join(sidecars, key, "left")
    return d.withColumns({"tier": F.coalesce("tier", F.lit(0)), "regression_status": F.coalesce("regression_status", F.lit("not_run")), "freshness_status": F.coalesce("freshness_status", F.lit("unknown"))})


def folded(rows: DataFrame, key: str, seq: str, code: str, first: list[str]) -> DataFrame:
    """One row a key: first values by seq, codes distinct in order, newest first."""
    codes = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct(seq, code))), lambda x: x[code]))
    return rows.groupBy(key).agg(*[F.min_by(c, seq).alias(c) for c in first], codes.alias("codes"))


def field_upserted(rows: DataFrame, new: DataFrame, key: str, field: str) -> DataFrame:
    """The field of the rows that new names; all else as it is."""
    n = new.select(key, F.col(field).alias("_v"))
    d = rows.join(n, key, "left")
    return d.select(*[F.coalesce("_v", field).alias(c) if c == field else F.col(c) for c in rows.columns])


def histories(turns: DataFrame, stub: str = "Hello") -> DataFrame:
    """conv_id and its turns in order as role: text, assistant as model, others as user."""
    role = F.when(F.col("role") == "assistant", "model").otherwise("user")
    t = F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), "text")))
    h = turns.groupBy("conv_id").agg(F.transform(t, lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit("")))).alias("history"))
    return h.withColumn("history", F.when(F.size("history") == 0, F.array(F.lit(f"user: {stub}"))).otherwise(F.col("history")))


def page_counts(pages: DataFrame) -> DataFrame:
    """Pages and characters of each document."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


def outcomes(items: DataFrame, outcome: Column) -> DataFrame:
    """How many items had each outcome."""
    return items.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
