"""Conversation prefix trie: nodes are distinct sequences of first turns, their subtree totals rolled up in depth bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from caseloom.llm.shared import written

#: Levels of a band: a node meets at most so many ancestors a round, and rounds are twice the logarithm of the depth to this base.
BAND = 8
#: Turns of one conversation that one task orders and folds; a multiple of BAND.
BLOCK = 4096
#: Conversation numbers that are joined into one string before the strings of a node are hashed in order.
ENDS = 12

#: The root's fingerprint: no turns at all.
ROOT = "named_struct('hi', 0L, 'lo', 0L)"


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, depth, said, size: the turns of each conversation numbered from 1; said: SHA-256 of role and text; size: UTF-8 bytes of the text.

    Turns go by turn (null first), then role and text; null roles and texts are empty. Repeated rows are turns like any
    other. Rows without a conv_id are left out. Rows are dealt by ranges of (conv_id, turn), so that a
    conversation with most of the rows is numbered by many tasks: a row's number is its place in its partition and
    what earlier partitions hold of its conversation.
    """
    t = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("conv_id"), F.asc_nulls_first("turn")]
    t = t.repartitionByRange(n, *by, F.substring("role", 1, 32), F.substring("text", 1, 64)).sortWithinPartitions(*by, "role", "text")
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    s = t.select("conv_id", F.monotonically_increasing_id().alias("at"), said.alias("said"), F.octet_length("text").cast("long").alias("size"))
    s = written(s, "turns").withColumn("part", F.shiftright("at", 33))
    here = s.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    here = here.select("conv_id", "part", (before - F.col("first") + 1).alias("shift"))
    return s.join(here, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("depth"), "said", "size")


def _prefixes(rows: DataFrame) -> DataFrame:
    """rows with node and parent: fingerprints of the turns up to this one, and up to the one before.

    A fingerprint is the exclusive or of two hashes of 64 bits of each (depth, turn): 128 bits, from SHA-256 of the
    turn. It needs no order within a block, and blocks are folded apart before their rows.
    """
    r = rows.withColumns({"a": F.xxhash64("depth", "said"), "b": F.xxhash64("said", "depth", F.lit(1)), "block": ((F.col("depth") - 1) / BLOCK).cast("long")})
    sums = r.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *(F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(s) for s in ("sa", "sb")))
    upto = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    r = r.join(sums, ["conv_id", "block"])
    r = r.withColumns({"hi": F.col("sa").bitwiseXOR(F.bit_xor("a").over(upto)), "lo": F.col("sb").bitwiseXOR(F.bit_xor("b").over(upto))})
    parent = F.struct(F.col("hi").bitwiseXOR(F.col("a")).alias("hi"), F.col("lo").bitwiseXOR(F.col("b")).alias("lo"))
    return r.select("conv_id", "block", "depth", "size", F.struct("hi", "lo").alias("node"), parent.alias("parent"))


def _banded(rows: DataFrame, step: int, *keys: str) -> DataFrame:
    """rows (at depths step, 2 step, ...) with path, the nodes of their band down to theirs, and root, the node above the band."""
    band = ((F.col("depth") / step - 1) / BAND).cast("long")
    w = W.partitionBy("conv_id", *keys, band).orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({"path": F.collect_list("node").over(w), "root": F.first("parent").over(w)})


def _at_top(step: int) -> Column:
    """Whether a node of a level of that step is the last of its band, and so a node of the level above."""
    return F.col("depth") % (step * BAND) == 0


def _spread(nodes: DataFrame) -> DataFrame:
    """node, leaves, saved: sums of what the nodes hand to themselves and their ancestors in their band."""
    up = nodes.select(F.explode("path").alias("node"), "leaves", "saved")
    return up.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _totals(levels: list[DataFrame]) -> DataFrame:
    """node, leaves, saved: subtree totals of all nodes but the trie's root.

    levels[0]: node, depth, path, root, leaves, saved; levels[k]: node, depth, path, root at depths BAND**k, 2 BAND**k, ...
    Upwards, the nodes of a band add up at the node above it, which is a node of the next level: a trie of a
    BAND-th of the depth. The highest level has one band. Downwards, the last nodes of a band come with their whole
    totals, the others with their own figures, and each hands them to its ancestors in the band.
    """
    own = [levels[0]]
    for k, level in enumerate(levels[1:]):
        to = F.when(_at_top(BAND**k), F.col("node")).otherwise(F.col("root")).alias("node")
        sums = own[k].select(to, "leaves", "saved").groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        own.append(written(level.join(sums, "node"), "bands"))
    total = _spread(own[-1])
    for k in range(len(levels) - 2, -1, -1):
        done = total.select("node", F.struct("leaves", "saved").alias("done"))
        whole = own[k].join(done, "node", "left")
        total = _spread(whole.select("path", *(F.coalesce(F.col("done")[c], F.col(c)).alias(c) for c in ("leaves", "saved"))))
        if k:
            total = written(total, "bands")
    return total


def _ends(last: DataFrame) -> DataFrame:
    """node, ends_sha256 of (conv_id, node): SHA-256 of each node's conv_ids, ascending, with commas between.

    The numbers of a range go into one string; a task streams the strings of its nodes in order and holds none of them.
    """
    part = F.shiftright("conv_id", ENDS).alias("part")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    d = last.groupBy("node", part).agg(ids.alias("ids")).select(F.col("node.hi").alias("hi"), F.col("node.lo").alias("lo"), "part", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for hi, lo, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (hi, lo) == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = (hi, lo), hashlib.sha256(ids.encode())
            yield _digests(out)
        if now:
            yield _digests([(*now, digest.hexdigest())])

    d = d.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "part").mapInArrow(run, "hi long, lo long, ends_sha256 string")
    return d.select(F.struct("hi", "lo").alias("node"), "ends_sha256")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    hi, lo, text = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(text, pa.string())], ["hi", "lo", "ends_sha256"])


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node.

    rows: conv_id, depth (1, 2, ... within a conversation), said, size, as `ordered` returns them; convs: conv_id of
    all conversations, those without turns included. A node of depth d is a distinct sequence of first d turns; the root has depth 0. Its conv_id
    is its smallest member's. n_leaves and saved_tokens cover its subtree; saved_tokens adds (members - 1) x size of the
    node's last turn; ends_sha256 covers the members that end there.

    Repeated conv_ids in convs count once; nulls are left out. No conversation at all: no rows.
    """
    p = written(_banded(_prefixes(rows), 1, "block"), "prefixes")
    folds = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("size").alias("size")]
    node = p.groupBy("depth", "node").agg(*folds, *(F.first(c).alias(c) for c in ("parent", "path", "root")))
    node = written(node, "trie")
    deepest = node.agg(F.max("depth")).first()[0] or 0
    upper, band, step = [], p, BAND
    while step < deepest:
        band = _banded(band.where(F.col("depth") % step == 0).select("conv_id", "depth", "node", F.col("root").alias("parent")), step)
        upper.append(band.groupBy("depth", "node").agg(*(F.first(c).alias(c) for c in ("path", "root"))))
        step *= BAND
    kids = node.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    own = node.join(kids, "node", "left").withColumns({"leaves": F.col("n_children").isNull().cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")})
    own = written(own.drop("size"), "trie")
    total = _totals([own.select("node", "depth", "path", "root", "leaves", "saved"), *upper])

    convs = convs.where("conv_id is not null").select("conv_id").distinct()
    none = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.expr(ROOT).alias("node"))
    last = p.select("conv_id", "depth", "node").unionByName(none).groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    stats = total.join(_ends(last), "node", "full").select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
    top = own.agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.sum((F.col("depth") == 1).cast("long")).alias("kids")).first()
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(convs.schema["conv_id"].dataType).alias("parent_conv_id"), "n_convs", F.lit(top["kids"] or 0).cast("long").alias("n_children"), F.expr(ROOT).alias("node"))
    above = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    above = above.unionByName(root.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    d = own.join(above, "parent").select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "node")
    d = d.unionByName(root).join(stats, "node", "left")
    at_root = lambda c, v: F.when(F.col("depth") == 0, F.lit(v).cast("long")).otherwise(F.col(c)).alias(c)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return d.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", at_root("n_leaves", top["leaves"] or 1), at_root("saved_tokens", top["saved"]), F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )
