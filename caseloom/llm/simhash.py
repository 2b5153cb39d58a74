"""Near copies by SimHash: Golay-code keys find fingerprints that differ in a few bits, joins verify them."""

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.shared import components, erase, written

#: Fixed values of the binary Golay code [23, 12, 7]: generator polynomial, lengths.
GENERATOR, LENGTH, CHECKS = 0b101011100011, 23, 11
#: Widths of the three segments of a fingerprint; each is a 23-bit word with zeros in front.
SEGMENTS = (22, 21, 21)
#: Fingerprints link at this many differing bits or fewer: then two segments together differ in at most two.
MOST_BITS = 4


#: Words in a shingle, and the seed of its hash.
SHINGLE, SEED = 4, 42


def fingerprints(texts: pd.Series) -> pd.Series:
    """64-bit SimHash of each text, as a signed long: bit set in over half of the shingles' hashes."""
    shingle, seed = SHINGLE, SEED
    out = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            continue
        if len(words) <= shingle:
            hashes = [digest(b" ".join(words), seed)]
        else:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            n = len(words) - shingle + 1
            hashes = [digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
        out[i] = majority(np.array(hashes, np.uint64))
    return pd.Series(out)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long; 0 of none."""
    h, counts = hashes.astype(">u8"), np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        counts += np.unpackbits(h[k : k + 4096].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h)).view(">u8").astype(np.uint64).view(np.int64)[0])


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator polynomial."""
    r = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - CHECKS)), r)
    return r


def _error_table() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the error patterns of weight up to 4 that have it (1 or 6), and how many."""
    patterns = [sum(1 << b for b in bits) for k in range(5) for bits in combinations(range(LENGTH), k)]
    patterns = np.array(patterns, np.int64)
    s = _syndrome(patterns)
    order = np.argsort(s, kind="stable")
    many = np.bincount(s, minlength=1 << CHECKS)
    table = np.zeros((1 << CHECKS, many.max()), np.int64)
    table[s[order], np.arange(len(order)) - np.repeat(np.cumsum(many) - many, many)] = patterns[order]
    return table, many


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word, in rows, and how many there are.

    The code has a codeword within 3 bits of any word. Two words at most 2 bits apart have a word between them,
    1 from each, whose nearest codeword is within 4 of both: they share an index.
    """
    if not _tables:
        _tables.append(_error_table())
    table, many = _tables[0]
    s = _syndrome(words)
    return (words[:, None] ^ table[s]) >> CHECKS, many[s]


def golay_keys(prints: pd.Series) -> pd.Series:
    """Keys of each fingerprint: for each two of its segments, every pair of codewords near them (3 to 108 keys, 85 in the mean).

    Two fingerprints that differ in 4 bits or fewer share a key: two of the three segments differ in 2 bits at most
    together, so in each of them both have a codeword in common.
    """
    v = prints.to_numpy(np.int64).view(np.uint64)
    shift, parts = 64, []
    for width in SEGMENTS:
        shift -= width
        parts.append(near_codewords(((v >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)))
    out = [[] for _ in v]
    for which, (i, j) in enumerate(combinations(range(3), 2)):
        (a, na), (b, nb) = parts[i], parts[j]
        keys = (which << 24) | (a[:, :, None] << 12) | b[:, None, :]
        for row in range(len(v)):
            out[row].append(keys[row, : na[row], : nb[row]].ravel())
    return pd.Series([np.concatenate(x).astype(np.int32) for x in out])


def with_fingerprint(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """docs with the SimHash of the text as a long: null and empty texts, and white space alone, have 0."""
    return docs.withColumn(column, F.pandas_udf(fingerprints, "long")("text"))


def _apart(a: Column | str, b: Column | str) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def _exact_keys(f: str, pieces: int, together: int) -> Column:
    """Keys of each `together` of so many pieces of a fingerprint, as they stand."""
    edges = [64 * i // pieces for i in range(pieces + 1)]
    parts = [F.shiftrightunsigned(f, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for which, chosen in enumerate(combinations(range(pieces), together)):
        key = F.lit(which).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(parts[i])
        keys.append(key)
    return F.array(*keys)


def _star_links(members: DataFrame, leaders: int) -> DataFrame:
    """(a, b): fingerprints of members (k, f, root) within MOST_BITS of a leader of their group that has another root; one for each two roots.

    Leaders are a few members of a group, drawn by root, so that a large component and a straggler are drawn alike. A
    group makes a row a member at most, not a row a pair. Sizes after explode are not estimated, so that joins are told not to broadcast.
    """
    drawn = []
    for r in range(leaders):
        h = F.xxhash64(F.lit(r), "root")
        drawn += [F.min_by("f", h).alias(f"f{r}"), F.min_by("root", h).alias(f"r{r}")]
    heads = members.groupBy("k").agg(*drawn)
    heads = heads.select("k", F.array_distinct(F.array(*[F.struct(F.col(f"f{r}").alias("f"), F.col(f"r{r}").alias("r")) for r in range(leaders)])).alias("heads"))
    near = F.filter("heads", lambda x: (x["r"] != F.col("root")) & (_apart(F.col("f"), x["f"]) <= MOST_BITS))
    met = members.join(heads.withColumnRenamed("k", "k2").hint("merge"), (F.col("k") == F.col("k2")) & (F.size(near) > 0)).select("f", "root", F.explode(near).alias("x"))
    pair = met.select(F.least("root", "x.r").alias("ra"), F.greatest("root", "x.r").alias("rb"), F.least("f", "x.f").alias("a"), F.greatest("f", "x.f").alias("b"))
    return _one_each(pair)


def _one_each(pairs: DataFrame) -> DataFrame:
    """One link (a, b) for each two roots (ra, rb)."""
    h = F.xxhash64("a", "b")
    return pairs.groupBy("ra", "rb").agg(F.min_by("a", h).alias("a"), F.min_by("b", h).alias("b"))


def near_links(prints: DataFrame, leaders: int = 4) -> tuple[DataFrame, DataFrame]:
    """(links, roots) of the distinct fingerprints in prints: links (a, b) join all that pairs within MOST_BITS join; roots: (fingerprint, root).

    1. Stars: in groups that have one of three segments in common, then two of six, members meet a few leaders
       (_star_links). So a large group of near copies is soon of one root, at a row a member and key.
    2. Golay keys: in groups with a key in common, all pairs of different roots are compared. Two fingerprints within
       MOST_BITS share a key, so that none stay apart that a link joins. Groups of one root are left out before.
    """
    nodes = written(prints.select(F.col("fingerprint").alias("f")).distinct(), "prints")
    first = written(_star_links(nodes.select("f", F.col("f").alias("root"), F.explode(_exact_keys("f", 3, 1)).alias("k")), leaders), "links")
    # One step along these links gives roots for the next stars.
    near = nodes.join(first.groupBy(F.col("b").alias("f")).agg(F.min("a").alias("root")), "f", "left").select("f", F.coalesce("root", "f").alias("root"))
    second = written(_star_links(near.select("f", "root", F.explode(_exact_keys("f", 6, 2)).alias("k")), leaders), "links")
    roots = _rooted(nodes.select("f", F.col("f").alias("root")), components(first.union(second)))
    # The keys are dealt out once: what follows reads the same exchange.
    dealt = roots.select("root", "f", F.explode(F.pandas_udf(golay_keys, "array<int>")("f")).alias("k")).repartition("k")
    closed = dealt.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo = hi and n > 1")
    left = dealt.join(closed.hint("merge"), "k", "left_anti").select("k", F.col("f").alias("a"), F.col("root").alias("ra"))
    right = left.withColumnsRenamed({"a": "b", "ra": "rb"})
    rest = left.join(right.hint("merge"), "k").where((_apart("a", "b") <= MOST_BITS) & (F.col("ra") < F.col("rb")))
    third = written(_one_each(rest.select("ra", "rb", "a", "b")), "links")
    if not third.isEmpty():
        roots = _rooted(roots, components(third, "ra", "rb"))
    links = reduce(DataFrame.union, [x.select("a", "b") for x in (first, second, third)])
    return links, roots.select(F.col("f").alias("fingerprint"), "root")


def _rooted(roots: DataFrame, joined: DataFrame) -> DataFrame:
    """roots (f, root), with the roots that components gives for those it knows."""
    tops = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return written(roots.join(tops, "root", "left").select("f", F.coalesce("top", "root").alias("root")), "roots")


def near_groups(prints: DataFrame, leaders: int = 4) -> DataFrame:
    """(fingerprint, root) of every distinct fingerprint of prints: root is the smallest one reachable by links."""
    return near_links(prints, leaders)[1]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: component_id is the smallest doc_id linked with it, itself included.

    Links: fingerprints that differ in 4 bits or fewer, and what follows from them. Texts are taken whole.
    Texts without words have fingerprint 0 and link like others; null texts count as such. A null doc_id is
    never a component's name unless all its documents have null ids (then null). Repeated rows come out as
    often as they come in. Empty input: no rows. Columns beside doc_id and text are not read.
    """
    slim = written(with_fingerprint(docs.select("doc_id", "text")).drop("text"), "simhash")
    roots = near_groups(slim)
    name = slim.groupBy("fingerprint").agg(F.min("doc_id").alias("m")).join(roots, "fingerprint")
    name = name.select("fingerprint", "root", "m")
    least = name.groupBy("root").agg(F.min("m").alias("component_id"))
    return slim.join(name.select("fingerprint", "root").join(least, "root").drop("root"), "fingerprint").select("doc_id", "fingerprint", "component_id")
