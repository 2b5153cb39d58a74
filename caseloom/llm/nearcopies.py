"""Near copies by SimHash and whole sets: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

The Golay-code search of simhash finds most links. A fingerprint cannot tell all pairs at 0.8 (they differ in 5 to 12 of
its 64 bits), so a prefix join finds the links between the groups that are left apart. Both are verified on whole sets.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.shared import components, erase, written
from caseloom.llm.simhash import majority, near_links

#: Words in a shingle, and the seed of its hash.
SHINGLE, SEED = 5, 42
#: Least similarity of a link, as a fraction.
UP, DOWN = 4, 5
#: Documents sampled for frequent shingles, how often one is frequent, and how many are held. They set an order of keys, not what is found.
SAMPLE, OFTEN, MOST_FREQUENT = 16_384, 4, 262_144


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted: runs of five words in lower case, or all words of a shorter text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([digest(line, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=False)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, so that a worker holds the shingles of a few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def prefix(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in one order for all texts, so many that texts which share none of them are under the similarity.

    A set of n at similarity s to another shares s * n with it at least, so that their first n - ceil(s * n) + 1 meet.
    Frequent shingles (sorted hashes, with their rank) come last, by rank: they make large groups.
    """
    n = len(hashes)
    if not n:
        return hashes
    r = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        r = np.where(frequent[at] == hashes, rank[at], 0)
    return hashes[np.lexsort((hashes, r))][: n - (UP * n + DOWN - 1) // DOWN + 1]


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of the documents, sorted, and in how many they are."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [shingles(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["k"])

    some = docs.where(F.pmod(F.xxhash64("h", "doc_id"), F.lit(every)) == 0).select("text").mapInArrow(run, "k long")
    top = some.groupBy("k").count().where(F.col("count") >= OFTEN).orderBy(F.col("count").desc(), "k").limit(MOST_FREQUENT).toPandas()  # bounded
    top = top.sort_values("k")
    return top["k"].to_numpy(np.int64), top["count"].to_numpy(np.int64)


def _with_prefix(docs: DataFrame) -> DataFrame:
    """doc_id and h of docs, with s (a hash of the shingle set), n (its size), keys (its prefix) and fingerprint (its SimHash)."""
    held = docs.sparkSession.sparkContext.broadcast(_frequent(docs))
    schema = docs.select("doc_id", "h").schema.add("s", T.LongType()).add("n", T.IntegerType()).add("keys", T.ArrayType(T.LongType())).add("fingerprint", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [shingles(t.as_py()) for t in batch.column(2)]
            s = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
            keys = [prefix(x, *held.value) for x in found]
            columns = [pa.array(s, pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array([majority(x.view(np.uint64)) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema.names)

    return docs.select("doc_id", "h", "text").mapInArrow(run, schema)


def _verified(pairs: DataFrame, slim: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of s whose sets are similar: whole sets, computed again from the texts of the pairs."""
    ends = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct()
    texts = slim.join(ends, "s", "left_semi").groupBy("s").agg(F.min("h").alias("h"))
    texts = docs.select("h", "text").join(texts, "h").dropDuplicates(["s"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [shingles(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["s", "set"])

    got = written(texts.select("s", "text").mapInArrow(sets, "s long, set array<long>"), "sets")
    both = pairs.join(got.withColumnsRenamed({"s": "a", "set": "x"}), "a").join(got.withColumnsRenamed({"s": "b", "set": "y"}), "b")
    similar = F.size(F.array_intersect("x", "y")) * (UP + DOWN) >= (F.size("x") + F.size("y")) * UP
    out = written(both.where(similar).select("a", "b"), "links")
    erase(got)
    return out


def _possible(a: str, b: str, i: str, j: str):
    """Whether sets of sizes a and b with a shingle in common at places i and j (from 0) of their order can be similar."""
    most = F.least(F.col(i), F.col(j)) + 1 + F.least(F.col(a) - F.col(i), F.col(b) - F.col(j)) - 1
    return (F.col(a) * DOWN >= F.col(b) * UP) & (F.col(b) * DOWN >= F.col(a) * UP) & (most * (UP + DOWN) >= (F.col(a) + F.col(b)) * UP)


def _enough(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs (a, b, n, m; a row a common prefix shingle) whose prefixes have enough in common.

    What two sets of n and m have in common beside their prefixes lies in the rest of that whose prefix ends first.
    """
    rest = lambda c: F.floor(F.col(c) * UP / DOWN + (DOWN - 1) / DOWN) - 1  # noqa: E731  what is not in the prefix
    g = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    return g.where((F.col("c") + F.greatest(rest("n"), rest("m"))) * (UP + DOWN) >= (F.col("n") + F.col("m")) * UP).select("a", "b")


def _likely(slim: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints link; sets of one fingerprint meet the smallest of them, which stands for all at its links."""
    prints = slim.where("n > 0").select("s", "fingerprint").distinct()
    heads = prints.groupBy("fingerprint").agg(F.min("s").alias("head"))
    links, _ = near_links(heads)
    same = prints.join(heads, "fingerprint").where("s <> head").select(F.col("head").alias("a"), F.col("s").alias("b"))
    a, b = (heads.select(F.col("fingerprint").alias(c), F.col("head").alias(f"s{c}")) for c in "ab")
    out = written(same.union(links.join(a, "a").join(b, "b").select("sa", "sb")).distinct(), "likely")
    erase(links)
    return out


def near_roots(docs: DataFrame, slim: DataFrame) -> DataFrame:
    """(s, root) of the shingle sets that links join with others; docs needs h and text, slim comes from _with_prefix.

    1. Sets whose SimHash fingerprints link by Golay keys are compared.
    2. Sets with a prefix shingle in common, but not yet of one component, are compared with the smallest of their group. So
       a large group of near copies joins at one row a member and shingle.
    3. Groups that are not joined yet are compared in all pairs of different components. Prefixes lose no link, so
       that the components are those of all links.
    """
    likely = _likely(slim)
    links = _verified(likely, slim, docs)
    home = components(links).withColumnsRenamed({"node": "s", "root": "home"})
    nodes = slim.where("n > 0").dropDuplicates(["s"]).select("s", "n", "keys").join(home, "s", "left")
    nodes = nodes.select("s", "n", F.coalesce("home", "s").alias("home"), F.posexplode("keys").alias("i", "k"))
    heads = nodes.groupBy("k").agg(F.min("s").alias("head"), F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo < hi").select("k", "head")
    met = written(nodes.join(heads.hint("merge"), "k"), "met")  # sizes after explode are not estimated: no broadcast
    lead = met.where("s = head").select("k", F.col("n").alias("m"), F.col("i").alias("j"), F.col("home").alias("home_b"))
    star = met.where("s <> head").join(lead.hint("merge"), "k").where((F.col("home") != F.col("home_b")) & _possible("n", "m", "i", "j"))
    star = written(_enough(star.select(F.col("head").alias("a"), F.col("s").alias("b"), "n", "m")), "stars")
    links = links.union(_verified(star, slim, docs))
    home = components(links).withColumnsRenamed({"node": "s", "root": "home"})
    met2 = met.drop("home").join(home, "s", "left").select("k", "s", "n", "i", F.coalesce("home", "s").alias("home"))
    met2 = written(met2, "homes")
    open_ = met2.groupBy("k").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo < hi").select("k")
    left = met2.join(open_.hint("merge"), "k", "left_semi")
    right = left.select("k", F.col("s").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("home").alias("home_b"))
    rest = left.join(right.hint("merge"), "k").where((F.col("s") < F.col("b")) & (F.col("home") != F.col("home_b")) & _possible("n", "m", "i", "j"))
    done = star.union(likely.select(F.least("a", "b"), F.greatest("a", "b")))
    rest = _enough(rest.select(F.col("s").alias("a"), "b", "n", "m")).join(done, ["a", "b"], "left_anti")
    rest = written(rest, "rest")
    more = _verified(rest, slim, docs)
    out = written(components(links.union(more)).withColumnRenamed("node", "s"), "roots")
    for used in (likely, met, star, met2, rest, links, more):
        erase(used)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of docs, one document of each group of near copies: the one with the smallest doc_id (null last).

    Links: shingle sets with a Jaccard similarity of 0.8 or more, and what follows from them. Texts are taken whole;
    texts without words, null among them, are one group. Rows with the kept doc_id that repeat each other exactly, or
    share it with other texts of the group, are cut to one: the smallest by a hash of the text. Empty input: no rows.
    """
    # Columns of docs are kept apart from those used here.
    d = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    slim = written(_with_prefix(d), "shingles")
    one = slim.select("doc_id", "h", "s").join(near_roots(d, slim), "s", "left").withColumn("root", F.coalesce("root", "s"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    one = one.groupBy("root").agg(F.min(order).alias("w")).select(F.col("w.doc_id").alias("doc_id"), F.col("w.h").alias("h"))
    # The rows to keep are known by 128 bits of hash of doc_id and text; repeated rows of a kept document meet there, and one stays.
    k1, k2 = F.xxhash64(F.lit(1), "doc_id", "h").alias("k1"), F.xxhash64(F.lit(2), "h", "doc_id").alias("k2")
    kept = d.select("row", k1, k2).join(one.select(k1, k2), ["k1", "k2"], "left_semi")
    return kept.dropDuplicates(["k1", "k2"]).select("row.*")
