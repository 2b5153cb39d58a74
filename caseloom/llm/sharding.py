"""Balanced label propagation: linked documents gather in shards of even row counts. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.shared import with_offsets, written

GROUP = ("_g1", "_g2")


def shard(docs: DataFrame, shards: int = 8, cells: int = 256, buckets: int = 1024, seed: int = 2) -> DataFrame:
    """docs with size, text_crc32, law ('rows'), shard, slot, grown_shard (null): counts of the shards differ by one at most.

    Links join documents of equal text. Every linked row first gets a label by a hash. In each round a group
    turns to the shard that has most of its rows, of those with room for it, and the shards take whole groups in, the
    largest first, up to their exact room (two-level prefix sums). Rounds go on until no group can move, so that a group
    is cut only if no shard has room for it at the end: fewer than `shards` groups, and those larger than a shard. The
    latter go in `cells` pieces, which fill one shard after another. Documents without links are ballast: they fill
    the shards to their exact counts, after the rows of groups without a place.

    Size: UTF-8 bytes of the text plus 1 (null text: 1, in the group of empty texts). Null doc_ids and
    repeated rows are rows like any other. Empty input: no rows. Clashing columns are replaced. Slots are gapless from 0 in
    each shard. Shards do not depend on how the input is split.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    g1 = F.xxhash64(text)
    base = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        g1.alias("_g1"),
        F.xxhash64(F.lit("again"), text).alias("_g2"),
        F.xxhash64(F.lit(seed), "doc_id", g1).alias("_row"),
    )
    base = written(base, "shard-rows")
    total = base.count()
    full = [total // shards + (s < total % shards) for s in range(shards)]
    first = F.pmod(F.xxhash64(F.lit("first"), "_row"), F.lit(shards))
    groups = base.groupBy(*GROUP).agg(F.count("*").alias("n"), F.array(*[F.count_if(first == s) for s in range(shards)]).alias("held"))
    groups = written(groups.where("n > 1"), "shard-groups")
    huge = groups.where(F.col("n") > max(full)).select(*GROUP, F.lit(True).alias("_huge"))  # fewer than `shards` rows
    cell = F.when(F.col("_huge"), F.pmod(F.xxhash64(F.lit("cell"), "_row"), F.lit(cells))).otherwise(-1).cast("int")
    base = base.join(F.broadcast(huge), list(GROUP), "left").withColumn("_cell", cell)
    pieces = base.where("_huge").groupBy(*GROUP, "_cell").agg(F.count("*").alias("n")).withColumn("held", F.array_repeat(F.lit(0).cast("long"), shards))
    whole = groups.where(F.col("n") <= max(full)).select(*GROUP, F.lit(-1).alias("_cell"), "n", "held")

    room, settled, left = list(full), [], []
    for waiting in (pieces, whole):
        while True:
            step = written(_turned(waiting, room), "shard-round")
            got = step.where("at is not null").groupBy("at").agg(F.sum("n").alias("n")).collect()  # a row a shard
            if not got:
                left.append(step)
                break
            for r in got:
                room[r["at"]] -= r["n"]
            settled.append(step.where("at is not null").select(*GROUP, "_cell", "at"))
            waiting = step.where("at is null").drop("at")

    # Groups without a place: fewer than `shards`, and pieces of those larger than a shard.
    lost = reduce(DataFrame.union, [x.select(*GROUP) for x in left]).distinct().orderBy(*GROUP).collect()
    d = base
    if settled:
        d = d.join(reduce(DataFrame.union, settled).hint("merge"), [*GROUP, "_cell"], "left")
    else:
        d = d.withColumn("at", F.lit(None).cast("int"))
    rank = F.lit(len(lost))
    for i, r in enumerate(lost):
        rank = F.when((F.col("_g1") == r["_g1"]) & (F.col("_g2") == r["_g2"]), i).otherwise(rank)
    spread = F.pmod(F.xxhash64(F.lit("slot"), "_row"), F.lit(buckets))
    d = d.withColumn("_k", F.coalesce("at", F.lit(-1))).withColumn("_b", F.when(F.col("at").isNull(), rank * buckets).otherwise(0) + spread)
    d = with_offsets(d, ["_k"], "_b", F.lit(1).cast("long"), [F.col("_row"), F.col("doc_id")], "_nth")
    to, slot = F.col("at"), F.col("_nth") - 1
    start = 0
    for s in range(shards):  # rows without a place fill the room that is left, shard after shard
        here = F.col("at").isNull() & (F.col("_nth") > start) & (F.col("_nth") <= start + room[s])
        to = F.when(here, F.lit(s)).otherwise(to)
        slot = F.when(here, F.col("_nth") - 1 - start + full[s] - room[s]).otherwise(slot)
        start += room[s]
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), to.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _turned(waiting: DataFrame, room: list[int]) -> DataFrame:
    """One round: waiting (group, _cell, n, held) with at, the shard that took the unit in, or null."""

    def choice(s: int) -> Column:
        tie = F.when(F.col("_cell") < 0, F.pmod(F.xxhash64(F.lit(s), *GROUP), F.lit(1 << 30))).otherwise(F.lit(room[s]).cast("long"))
        return F.when(F.col("n") <= F.lit(room[s]), F.struct(F.get("held", F.lit(s)).alias("h"), tie.alias("t"), F.lit(s).alias("s")))

    units = waiting.withColumn("_best", F.array_max(F.array(*[choice(s) for s in range(len(room))])))
    units = units.withColumn("to", F.col("_best.s")).withColumn("_h", F.col("_best.h")).drop("_best")
    rest = units.where("to is null").select(*waiting.columns, F.lit(None).cast("int").alias("at"))
    # The largest first; those of one size are dealt to as many buckets as there may be of them.
    sub = F.pmod(F.xxhash64(*GROUP, "_cell"), F.greatest(F.lit(1).cast("long"), F.floor(F.lit(1024) / F.col("n"))))
    asked = units.where("to is not null").withColumn("_size", sub - 1024 * F.col("n"))
    asked = with_offsets(asked, ["to"], "_size", F.col("n"), [F.desc("_h"), *map(F.col, GROUP), F.col("_cell")], "_upto")
    fits = F.col("_upto") <= F.get(F.array(*[F.lit(r).cast("long") for r in room]), F.col("to"))
    return asked.select(*waiting.columns, F.when(fits, F.col("to")).cast("int").alias("at")).union(rest)
