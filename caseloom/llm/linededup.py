"""Line dedup by a log-template tree: lines with one template that recur across documents are dropped."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.shared import erase, fresh_path, written

#: What stands in a template for a field that varies.
FIELD = b"<*>"
_DIGITS = tuple(b"0123456789"[i : i + 1] for i in range(10))


def masked(line: str) -> list[bytes]:
    """Tokens of the line in lower case, those with a digit as a field."""
    tokens = line.encode("utf-8", "surrogatepass").lower().split()
    if any(map(line.__contains__, "0123456789")):
        tokens = [FIELD if any(d in t for d in _DIGITS) else t for t in tokens]
    return tokens


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def leaf_of(tokens: list[bytes], depth: int) -> int:
    """The leaf of the tree where a line ends up: by its token count, then its leading tokens."""
    return _signed(xxhash.xxh64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:depth])))


class Leaf:
    """The templates of a leaf, each led by the line that began it."""

    def __init__(self, similar: float):
        self.similar = similar
        self.ids: list[int] = []
        self.leaders = np.zeros((0, 0), np.int64)

    def place(self, line: int, tokens: list[bytes]) -> int:
        """The id of the template of a line: the most similar leader, the first of equals, or the line's own id as a new one.

        Similarity: the share of places with the same token. Where members differ from the leader the template has a field.
        """
        code, n = np.fromiter(map(hash, tokens), np.int64, len(tokens)), len(self.ids)
        if n:
            same = (self.leaders[:n] == code).sum(1)
            best = int(np.argmax(same))
            if same[best] >= self.similar * len(tokens) - 1e-9:
                return self.ids[best]
        if n == len(self.leaders):
            self.leaders = np.resize(self.leaders if n else code, (max(4, 2 * n), len(tokens)))
        self.ids.append(line)
        self.leaders[n] = code
        return line


def _found(docs: DataFrame, depth: int, least: int, hold: int) -> DataFrame:
    """A row per line of at least `least` tokens (kind o: doc, line number, the hash of its tokens) and per line new to a task (kind t: its tokens).

    A task knows the lines of about `hold` bytes of text, then starts anew; equal lines among these leave one row of kind t.
    """
    doc = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("kind", T.StringType()), doc, T.StructField("h", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("own", T.LongType()), T.StructField("leaf", T.LongType()), T.StructField("line", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = set(), 0
        for batch in batches:
            kind = batch.column(0).type
            seen: list[tuple] = []
            new: list[tuple] = []
            for doc_id, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for no, line in enumerate((text.as_py() or "").split("\n")):
                    tokens = masked(line)
                    if len(tokens) < least:
                        continue
                    joined = b" ".join(tokens)
                    own = _signed(xxhash.xxh64_intdigest(joined))
                    if own not in known:
                        known.add(own)
                        new.append((own, leaf_of(tokens, depth), joined))
                        held += len(joined)
                    seen.append((doc_id, h, no, own))
                if held > hold:
                    known, held = set(), 0
            if seen:
                a, b, c, d = zip(*seen, strict=True)
                n = len(seen)
                yield pa.RecordBatch.from_arrays([pa.array(["o"] * n), pa.array(a, kind), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema.names)
            if new:
                d, e, f = zip(*new, strict=True)
                n = len(new)
                yield pa.RecordBatch.from_arrays([pa.array(["t"] * n), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(d, pa.int64()), pa.array(e, pa.int64()), pa.array(f, pa.binary())], schema.names)

    return docs.select("doc_id", "h", "text").mapInArrow(run, schema)


def _merged(lines: DataFrame, similar: float) -> DataFrame:
    """(own, into) of the lines that join another one's template. Each distinct line of all tasks is placed once.

    The rows of a leaf come in a row, in the order of their hashes, equal lines of several tasks one after another;
    only its leaders are held. So what a line joins does not depend on how documents are dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, leaf, last, lone = Leaf(similar), None, None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for of, own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if of != leaf:
                    templates, leaf, last, lone = Leaf(similar), of, own, line
                    continue
                if own == last:
                    continue
                if lone is not None:  # most leaves have one line: nothing is done for them
                    templates.place(last, lone.as_py().split(b" "))
                    lone = None
                last = own
                into = templates.place(own, line.as_py().split(b" "))
                if into != own:
                    out.append((own, into))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["own", "into"])

    ordered = lines.select("leaf", "own", "line").repartition("leaf").sortWithinPartitions("leaf", "own")
    return ordered.mapInArrow(run, "own long, into long")


def dropped_lines(docs: DataFrame, depth: int = 5, least: int = 1, similar: float = 0.8, hold: int = 16 << 20) -> DataFrame:
    """(doc_id, h, dropped array<int>) of the documents with lines to drop; docs needs doc_id, text and h, a hash of the text."""
    spark = docs.sparkSession
    path = fresh_path(spark, "lines")
    _found(docs, depth, least, hold).write.partitionBy("kind").parquet(path)
    if not _has(spark, path, "o"):
        return docs.select("doc_id", "h", F.array().cast("array<int>").alias("dropped")).limit(0)
    seen = spark.read.parquet(f"{path}/kind=o")
    lines = spark.read.parquet(f"{path}/kind=t")
    into = written(_merged(lines, similar), "merged")
    erase(lines)
    seen = seen.join(into, "own", "left").select("doc_id", "h", "line_no", F.coalesce("into", "own").alias("template"))
    who = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    first = seen.groupBy("template").agg(F.min(who).alias("a"), F.max(who).alias("z")).where("a <> z").select("template", "a")
    first = written(first, "first")  # a join of its own after it, in which a frequent template's lines can be split
    again = seen.join(first, "template").where(who != F.col("a"))
    return again.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def _has(spark, path: str, kind: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop_lines(docs: DataFrame, depth: int = 5, least: int = 1, similar: float = 0.8) -> DataFrame:
    """docs with the text less its recurring lines, and n_lines, dropped (line numbers from 0).

    Each line of at least `least` tokens goes down a tree of fixed depth, by its number of tokens and its first
    `depth` tokens (those with a digit are fields), to a leaf, and there to the most similar template
    (`similar` of its places equal), or it begins one. A template that occurs in two documents or more recurs:
    its lines stay in the document with the smallest doc_id, and are dropped from all others. Lines that recur
    only inside one document stay, as do blank lines. Under five tokens, lines of a template are equal but for fields.
    A line that is similar to several templates goes to the most similar of those that lines of smaller hash began;
    equal lines always go together, and nothing depends on how the input is split.

    A document is a (doc_id, text) pair, so repeated rows count as one and stay alike. Null and empty texts: no
    lines to drop; null stays null. Null doc_ids come last in order. Empty input: no rows. Columns that clash
    with those added are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "dropped")]
    h = F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    drops = dropped_lines(docs.select("doc_id", "text", h), depth, least, similar).withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    d = docs.select(F.struct(*kept).alias("row"), "text", h)  # columns of docs are kept apart from those used here
    d = d.join(drops, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("dropped", i)), "\n")
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left)
    return d.select(
        *[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in kept],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )
