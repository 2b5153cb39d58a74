"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from caseloom.llm.shared import WORD, with_offsets, written


def targets(sizes: DataFrame, weights: Sequence[float], share: float, passes: int) -> DataFrame:
    """(_key, source_size, weight, target) from (_key, source, source_size), one row per source.

    Sources by code point, null last, get the weights in turn. The budget is share times all sizes; a
    source stops at passes times its size, and what it leaves goes to the others by weight. That is the
    level L with sum(least(cap, L * weight)) = budget: with sources in order of cap / weight, those before
    a row are full, and the first row whose level does not pass its own cap / weight has L.
    """
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ring = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.get(ring, n % len(weights))).withColumn("_cap", passes * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("weight"), "_key")
    s = s.withColumn("_full", F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_level", (share * F.sum("source_size").over(everything) - F.col("_full")) / F.col("_left"))
    level = F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.col("_level"))).over(everything)
    target = F.least(F.col("_cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("_cap").cast("double")))
    return s.select("_key", "source_size", "weight", target.alias("target"))


#: Columns that queued adds.
ADDED = ("size", "source_size", "weight", "target", "finish", "times", "taken")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """row (all columns, apart from those used here), size, source, and the place in the source's queue: _key, _h, _bucket."""
    d = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")
    # MD5 of seed and doc_id: an order that any SQL engine can repeat. Its first 12 bits are the bucket.
    h = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    return d.select("row", "source", size.alias("size"), key.alias("_key"), h.alias("_h"), F.substring(h, 1, 3).alias("_bucket"))


def _upto(sized: DataFrame, sums: DataFrame) -> DataFrame:
    """sized with _upto (words of the source's queue up to and with the row), source_size, weight and target."""
    inside = W.partitionBy("_key", "_bucket").orderBy("_h", "size").rowsBetween(W.unboundedPreceding, 0)
    d = sized.join(sums, ["_key", "_bucket"])
    return d.withColumn("_upto", F.col("_before") + F.sum("size").over(inside)).drop("_before", "_bucket")


def _finish(i: Column | int) -> Column:
    """Virtual finish time in pass i (from 0): the source's words so far over its target. Null where the target is 0."""
    return F.when(F.col("target") > 0, (i * F.col("source_size") + F.col("_upto")) / F.col("target"))


def _cut(slim: DataFrame, share: float, passes: int) -> DataFrame:
    """One row, `cut`: where the stream of all documents and passes ends. The stream is range-sorted by finish time.

    Its running total goes in two levels, over the range partitions, then inside each. The cut is the place of the last
    document whose middle lies within the budget.
    """
    rows = slim.withColumn("_pass", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
    rows = rows.select(_finish(F.col("_pass")).alias("finish"), "_key", "_h", "size", "_pass").where("finish is not null")
    place = ["finish", "_key", "_h", "size", "_pass"]
    rows = written(rows.repartitionByRange(*place).withColumn("_part", F.spark_partition_id()), "stream")
    budget = share * slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    run = with_offsets(rows, [], "_part", F.col("size"), [F.col(c) for c in place], "_run")
    return run.where(2 * F.col("_run") - F.col("size") <= 2 * budget).agg(F.max(F.struct(*place)).alias("cut"))


def _queue(docs: DataFrame, weights: Sequence[float], share: float, passes: int, seed: int, rows: bool) -> DataFrame:
    """Rows of docs (or their doc_id alone) with the columns of ADDED, and _h, _upto."""
    sized = _sized(docs, seed)
    sums = written(sized.groupBy("_key", "_bucket").agg(F.first("source").alias("source"), F.sum("size").alias("_sum")), "queue-sums")
    goal = targets(sums.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size")), weights, share, passes)
    before = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(goal, "_key").drop("source", "_sum")
    slim = sized.select(F.col("row.doc_id").alias("doc_id"), "_key", "_h", "_bucket", "size")
    slim = written(_upto(slim, sums), "queue")
    # One row: the end of the stream, known to every task.
    q = (_upto(sized.drop("source"), sums) if rows else slim).join(F.broadcast(_cut(slim, share, passes)))
    place = lambda i: F.struct(_finish(i).alias("finish"), "_key", "_h", "size", F.lit(i).alias("_pass"))
    taken = [F.coalesce(place(i) <= F.col("cut"), F.lit(False)) & _finish(i).isNotNull() for i in range(passes)]
    times = sum((t.cast("int") for t in taken), F.lit(0)).cast("int")
    q = q.withColumn("finish", _finish(0)).withColumn("times", times)
    return q.withColumn("taken", (F.col("times") * F.col("size")).cast("long")).drop("cut")


def queued(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, passes: int = 2, seed: int = 9) -> DataFrame:
    """docs with size, source_size, weight, target, finish (virtual finish time of the first pass), times, taken.

    Size: words of the text. Documents of a source queue in the order of a seeded hash; the finish time of
    one is the source's words up to and with it over the source's target (its weight after the excess of sources
    that stop is reshared); a further pass comes a whole source later. All documents and passes form one stream, sorted
    by finish time, and cut where the budget ends: share times all words. Whole documents only; each source ends within
    a few documents of its target. times counts the passes taken, and taken = times * size.

    Null text: size 0. Null source: a source of its own, last in order. Documents without words are taken
    with the words around them. Null doc_ids queue by size. Repeated rows queue one by one (those with one
    doc_id and size are interchangeable). Sources without words: target 0, nothing taken. Empty input: no rows. Columns of docs
    that clash with those added are replaced.
    """
    q = _queue(docs, weights, share, passes, seed, True)
    return q.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def shares(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, passes: int = 2, seed: int = 9) -> DataFrame:
    """doc_id and the columns that queued adds, of the same rows: texts are read once and go through no shuffle."""
    return _queue(docs, weights, share, passes, seed, False).select("doc_id", *ADDED)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, passes: int = 2, seed: int = 9) -> DataFrame:
    """The mixed stream: columns of docs plus finish and pass_no, a row per taken document and pass, range-sorted by finish.

    The stream is cut where the budget ends (see queued). Same edge cases as queued.
    """
    q = _queue(docs, weights, share, passes, seed, True).where("times > 0")
    late = F.explode(F.transform(F.sequence(F.lit(1), "times"), lambda i: F.struct(i.alias("pass_no"), _finish(i - 1).alias("finish")))).alias("at")
    kept = [c for c in docs.columns if c not in ("finish", "pass_no")]
    out = q.select("row", "_key", "_h", "size", late)
    out = out.orderBy("at.finish", "_key", "_h", "size", "at.pass_no")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "at.finish", "at.pass_no")
