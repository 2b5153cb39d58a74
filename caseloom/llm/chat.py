"""Chat formatting over a prefix tree: turns that conversations share at their start are emitted once, depth-first."""

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from caseloom.llm.shared import with_offsets, written

#: Strings that steer chat templates. Those of the template here are OPEN and CLOSE.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

#: A control string with any number of backslashes after its first sign: escaping adds one, reading back takes one.
_RAW = re.compile("(" + "|".join(re.escape(c[0]) + r"(?=\\*" + re.escape(c[1:]) + ")" for c in CONTROL) + ")")
_ESCAPED = re.compile("(" + "|".join(re.escape(c[0]) + r"(?=\\+" + re.escape(c[1:]) + ")" for c in CONTROL) + r")\\")


def escape(text: str) -> str:
    """text without any control string: each gets a backslash after its first sign, as do those that have some already."""
    return _RAW.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and where its text begins and ends. A line break in a role is written \\n."""
    head = OPEN + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + CLOSE + "\n", len(head), len(head) + len(body)


def parsed(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, rest = segment[len(OPEN) :].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(rest[: -len(CLOSE) - 1])


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows with conv (the id), seq (from 0 in order of turn, role, text), node and parent (ids of the turn's whole prefix and of that before).

    Rows stream through a task in order of conversation and turn; a task holds one digest, whatever a conversation's length.
    """
    conv = conversations.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv", conv), T.StructField("seq", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("node", "parent", "role", "segment")], T.StructField("text_start", T.IntegerType()), T.StructField("text_end", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, seq, chain = False, None, 0, None
        for batch in batches:
            out: list[tuple] = []
            for key, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or key != now:
                    begun, now, seq, chain = True, key, 0, b""
                segment, a, b = formatted(role, text)
                node = hashlib.blake2b(chain + segment.encode("utf-8", "surrogatepass"), digest_size=12).digest()
                out.append((key, seq, node.hex(), chain.hex(), role, segment, a, b))
                seq, chain = seq + 1, node
            if out:
                columns = zip(*out, strict=True)
                kinds = [batch.column(0).type, pa.int64()] + [pa.string()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema.names)

    blank = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, schema)


def prefix_tree(conversations: DataFrame, tokenizer_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The merged output, written, and where each conversation ends in it.

    segments, a row per node of the prefix tree (a turn and all before it): tree (id of the first turn), node,
    parent, depth, role, loss_from and loss_to (the assistant's text in the formatted turn; null for others), start
    and end (place in the tree's sequence, depth-first, each turn once), run (where the run of turns it is in starts),
    position (that of its first unit in any of its conversations: units of all its ancestors), ancestors
    array<struct<from,to>> (what it may attend to besides itself: a stretch from the start of each run on its path), and
    its units: ids, tokens with tokenizer_path, else segment, the formatted turn itself in characters.
    members: conv_id, leaf (its last turn).

    Each turn belongs to the first conversation that has it; what a conversation owns is one run of turns to its end. In
    depth-first order a run comes whole, then the runs that fork off it, the deepest fork first. Runs are
    laid out level by level, as deep as forks lie within forks; the runs of one fork are summed in two levels, so that a
    first turn that many conversations share is never in one task's memory.

    Order: rows of a conversation by turn, then role, then text, so ties are settled and repeated rows are turns
    of their own. Null roles and texts: empty. Null conv_id: one conversation of that id. Empty input: no rows. Other columns
    are not read.
    """
    rows = written(_turns(conversations).withColumn("c", F.coalesce(F.concat(F.lit("s"), F.col("conv").cast("string")), F.lit("n"))), "turns")
    owner = rows.groupBy("node").agg(F.min("c").alias("owner"))
    own = F.col("c") == F.col("owner")
    owned = rows.join(owner, "node").withColumn("segment", F.when(own, F.col("segment")))
    owned = written(owned, "owned")
    members = owned.groupBy("conv").agg(F.max_by("node", "seq").alias("leaf")).withColumnRenamed("conv", "conv_id")

    nodes = owned.where(own).select("c", "seq", "node", "parent", "role", "segment", "text_start", "text_end")
    if tokenizer_path:
        nodes = nodes.withColumn("ids", _encoder(tokenizer_path)("segment")).withColumn("units", F.size("ids").cast("long"))
    else:
        nodes = nodes.withColumn("units", F.length("segment").cast("long"))
    before = W.partitionBy("c").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    nodes = written(nodes.withColumn("off", F.coalesce(F.sum("units").over(before), F.lit(0))), "nodes")

    runs = nodes.groupBy("c").agg(F.sum("units").alias("own"), F.min_by("node", "seq").alias("first"))
    shared_seq = F.when(~own, F.col("seq"))
    forks = owned.groupBy("c").agg(F.max(shared_seq).alias("fork"), F.max_by("owner", shared_seq).alias("p"))
    ends = nodes.select(F.col("c").alias("p"), F.col("seq").alias("fork"), (F.col("off") + F.col("units")).alias("upto"))
    runs = written(runs.join(forks, "c").join(ends, ["p", "fork"], "left"), "runs")
    laid = _laid_out(runs)

    span = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    start = F.col("run") + F.col("off")
    here = F.when(F.col("off") > 0, F.array(span(F.col("run"), start))).otherwise(F.array().cast(NO_SPANS))
    loss = lambda c: F.when(F.col("role") == "assistant", F.col(c))
    segments = nodes.join(laid, "c").select(
        "tree",
        "node",
        "parent",
        F.col("seq").alias("depth"),
        "role",
        loss("text_start").alias("loss_from"),
        loss("text_end").alias("loss_to"),
        start.alias("start"),
        (start + F.col("units")).alias("end"),
        "run",
        (F.col("base") + F.col("off")).alias("position"),
        F.concat("above", here).alias("ancestors"),
        "ids" if tokenizer_path else "segment",
    )
    return written(segments, "segments"), members


NO_SPANS = "array<struct<from:bigint,to:bigint>>"


def _laid_out(runs: DataFrame) -> DataFrame:
    """(c, tree, run, base, above) of runs (c, own, first, p, fork, upto): p is the run it forks off, after `upto` of its units.

    run: where it starts in the tree's sequence; base: units of all turns before it in its conversations; above: the
    stretches of those turns. One round a level of forks within forks, over the runs of that level.
    """
    levels = [written(runs.where("p is null"), "level")]
    while not levels[-1].isEmpty():
        levels.append(written(runs.join(levels[-1].select(F.col("c").alias("p")), "p").select(runs.columns), "level"))
    levels.pop()
    if not levels:
        return runs.select("c", F.col("first").alias("tree"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("base"), F.array().cast(NO_SPANS).alias("above"))
    totals: list[DataFrame] = []
    for level in reversed(levels):  # units of a run and all runs that fork off it
        t = level.select("c", "p", "fork", "own", "upto", "first").withColumn("total", F.col("own"))
        if totals:
            below = totals[-1].groupBy(F.col("p").alias("c")).agg(F.sum("total").alias("below"))
            t = t.join(below, "c", "left").withColumn("total", F.col("own") + F.coalesce("below", F.lit(0))).drop("below")
        totals.append(written(t, "totals"))
    totals.reverse()
    # Of the runs that fork off one, the deepest fork comes first; those of one fork go by a hash.
    place = (F.pmod(F.xxhash64("c"), F.lit(256)) - 256 * F.col("fork")).alias("_place")
    done = [written(totals[0].select("c", "own", F.col("first").alias("tree"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("base"), F.array().cast(NO_SPANS).alias("above")), "laid")]
    for t in totals[1:]:
        t = with_offsets(t.withColumn("_place", place), ["p"], "_place", F.col("total"), [F.col("c")], "_upto")
        up = done[-1].select(F.col("c").alias("p"), "tree", F.col("own").alias("own_p"), F.col("run").alias("run_p"), F.col("base").alias("base_p"), F.col("above").alias("above_p"))
        t = t.join(up, "p").select(
            "c",
            "own",
            "tree",
            (F.col("run_p") + F.col("own_p") + F.col("_upto") - F.col("total")).alias("run"),
            (F.col("base_p") + F.col("upto")).alias("base"),
            F.concat("above_p", F.array(F.struct(F.col("run_p").alias("from"), (F.col("run_p") + F.col("upto")).alias("to")))).alias("above"),
        )
        done.append(written(t, "laid"))
    return reduce(DataFrame.union, done).drop("own")


def _encoder(path: str):
    """A function from segments to token ids; the tokenizer is read once a worker."""
    import pandas as pd

    def encode(segments: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer.from_file(path)
            _tokenizers[path].encode_special_tokens = True
        return pd.Series([x.ids for x in _tokenizers[path].encode_batch(list(segments), add_special_tokens=False)])

    return F.pandas_udf(encode, "array<int>")


_tokenizers: dict = {}


def _decoded(ids: pa.Array, path: str) -> list[str]:
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return _tokenizers[path].decode_batch(ids.to_pylist(), skip_special_tokens=False)


def read_back(segments: DataFrame, members: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from the merged output alone.

    A conversation's turns are those in the stretches that its last turn may attend to, and that turn, in order of
    position; each stretch begins a run, so that the two meet by (tree, run). Turns are decoded from their tokens and parsed;
    rows stream in order through digests. Positions that do not follow one another raise an error.
    """
    leaf = segments.select(F.col("node").alias("leaf"), "tree", F.col("run").alias("_run"), F.col("end").alias("_end"), "ancestors")
    mine = F.array(F.struct(F.col("_run").alias("from"), F.col("_end").alias("to")))
    spans = members.join(leaf, "leaf").select("conv_id", "tree", F.explode(F.concat(F.filter("ancestors", lambda x: x["from"] != F.col("_run")), mine)).alias("x"))
    spans = spans.select("conv_id", "tree", F.col("x.from").alias("run"), F.col("x.to").alias("_to"))
    body = "ids" if tokenizer_path else "segment"
    rows = spans.join(segments.select("tree", "run", "start", "position", "loss_from", "loss_to", body), ["tree", "run"]).where("start < _to")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", body, "loss_from", "loss_to", "position")
    conv = members.schema["conv_id"].dataType
    kinds = {"n_turns": T.LongType(), "turns_sha256": T.StringType(), "loss_chars": T.LongType(), "loss_sha256": T.StringType(), "formatted_chars": T.LongType()}
    schema = T.StructType([T.StructField("conv_id", conv), *[T.StructField(k, v) for k, v in kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, state = False, None, None

        def batch_of(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], schema.names)

        ended = lambda: (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        kind = None
        for batch in batches:
            done, kind = [], batch.column(0).type
            held = batch.column(1)
            turns = _decoded(held, tokenizer_path) if tokenizer_path else held.to_pylist()
            units = map(len, held.to_pylist())
            for key, segment, n, a, b, position in zip(batch.column(0).to_pylist(), turns, units, *[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True):
                if not begun or key != now:
                    if begun:
                        done.append(ended())
                    begun, now, state = True, key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if position != state[5]:
                    raise ValueError(f"conversation {key}: position {position} after {state[5]} units")
                role, text = parsed(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    learned = unescape(segment[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
                state[5] += n
            if done:
                yield batch_of(done, kind)
        if begun:
            yield batch_of([ended()], kind)

    return rows.mapInArrow(run, schema)
