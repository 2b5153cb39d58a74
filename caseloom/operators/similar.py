"""Joining names by their matching-blocks ratio: block by block, under bounds that lose no pair.

The ratio of names x and y is 2 M / (|x| + |y|), M the letters in their matching blocks. These come in the same order in
both names, so M is at most the length of a longest common subsequence, which is at most the letters the names have in
common, which is at most the shorter length. The three bounds are found for a name against a block of names at once, and
only pairs whose bound reaches the wanted ratio (or the best found so far) are compared in full. No q-gram need be shared
below a ratio of 2/3 (a1b2c3 and a4b5c6 reach 1/2), so blocks of names meet, not keys of theirs: a group of any size is
dealt in blocks of BLOCK names, and a name is copied once for each block of the other side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

#: Names of each side that meet in one block of pairs.
BLOCK = 1024


class Names:
    """Names of a block, ready to bound the ratio of another name with each of them."""

    def __init__(self, names: list[str]):
        self.names = names
        self.lengths = np.array(list(map(len, names)), np.int64)
        self.alphabet = {c: k for k, c in enumerate(sorted(set("".join(names))))}
        width = max(1, int(self.lengths.max(initial=0)))
        self.codes = np.full((width, len(names)), len(self.alphabet), np.int32)
        for k, name in enumerate(names):
            self.codes[: len(name), k] = [self.alphabet[c] for c in name]
        self.counts = np.array([letters(n) for n in names], np.int16).reshape(len(names), 64)

    def bounds(self, name: str, least: float) -> np.ndarray:
        """No less than the ratio of name with each of the names; where that is under least, by the cheaper bounds alone."""
        return self.tighter(name, self.cheap(name), least)

    def _share(self, name: str, m: np.ndarray) -> np.ndarray:
        total = self.lengths + len(name)
        return np.where(total > 0, 2 * m / np.maximum(total, 1), 1.0)

    def cheap(self, name: str) -> np.ndarray:
        """Bounds by the letters in common, which are no more than the shorter length."""
        return self._share(name, np.minimum(self.counts, letters(name)).sum(1, dtype=np.int64)) if self.names else np.zeros(0)

    def tighter(self, name: str, bounds: np.ndarray, least: float) -> np.ndarray:
        """The bounds, of those of `least` or more that of the longest common subsequence too."""
        which = np.flatnonzero(bounds >= least)
        if not 0 < len(name) <= 64 or not len(which):
            return bounds
        out = bounds.copy()
        out[which] = np.minimum(out[which], self._share(name, self._subsequences(name, which, self.lengths))[which])
        return out

    def _subsequences(self, name: str, which: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Lengths of longest common subsequences, all bits of a column of the usual table in one word."""
        places = np.zeros(len(self.alphabet) + 1, np.uint64)
        for k, c in enumerate(name):
            if c in self.alphabet:
                places[self.alphabet[c]] |= np.uint64(1 << k)
        row = np.full(len(which), np.uint64(2**64 - 1))
        for codes in self.codes[: int(self.lengths[which].max())]:
            here = row & places[codes[which]]
            row = (row + here) | (row - here)
        out = np.zeros(len(total), np.int64)
        out[which] = np.bitwise_count(~row & np.uint64(2 ** len(name) - 1))
        return out


def letters(name: str) -> np.ndarray:
    """How often signs of each of 64 classes come in the name, at most 32,767 times."""
    codes = np.frombuffer(name.encode("utf-32-le"), np.uint32) % 64
    return np.minimum(np.bincount(codes, minlength=64), 32767).astype(np.int16) if len(name) <= 32767 else np.full(64, 32767, np.int16)


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def dealt(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """left and right with b0 and b1: rows of a group in both are cut into blocks of about BLOCK by a hash, and a row is copied once for each block of the other side, so that equal on, b0 and b1 join each pair once."""
    count = lambda d, own, other: d.groupBy(*on).agg(F.count("*").alias(own), F.lit(0).cast("long").alias(other))
    sizes = count(left, "n_l", "n_r").unionByName(count(right, "n_r", "n_l"))
    blocks = lambda c: F.ceil(F.sum(c) / BLOCK).cast("int").alias(c)
    sizes = sizes.groupBy(*on).agg(blocks("n_l"), blocks("n_r")).where("n_l > 0 and n_r > 0")

    def side(rows: DataFrame, own: str, other: str, which: int) -> DataFrame:
        block = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.col(own)).cast("int")
        d = rows.join(sizes, on).withColumn(f"b{which}", block)
        return d.withColumn(f"b{1 - which}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other)

    return side(left, "n_l", "n_r", 0), side(right, "n_r", "n_l", 1)


def tiled(left: DataFrame, right: DataFrame, on: list[str], score: Callable[[list[tuple], list[tuple]], Iterator[tuple]], fields: str) -> DataFrame:
    """on and the fields of what score makes of each block of left rows against each block of right rows of a group.

    left and right: on and the same further columns, which score gets as lists of tuples; on and fields are `name type`
    columns. A group is cut into blocks of about BLOCK rows by a hash of the row, and a pair of blocks is one unit of work.
    """
    rest = [c for c in left.columns if c not in on]
    left, right = dealt(left, right, on)
    side = lambda d, which: d.select(*on, "b0", "b1", F.lit(which).alias("side"), *rest)
    both = side(left, 0).unionByName(side(right, 1))
    both = both.repartition(*on, "b0", "b1").sortWithinPartitions(*on, "b0", "b1", "side")
    n = len(on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        out = []
        for key, tile in groupby(rows, key=lambda r: r[: n + 2]):
            sides = [], []
            for r in tile:
                sides[r[n + 2]].append(r[n + 3 :])
            out.extend(key[:n] + row for row in score(*sides))
            if len(out) > 10_000:
                yield record(out)
                out = []
        yield record(out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields if f.name in on)
    schema = left.sparkSession.createDataFrame([], f"{kinds}, {fields}").schema
    arrow = to_arrow_schema(schema)

    def record(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return both.mapInArrow(run, schema)


def similar_pairs(names: DataFrame, on: list[str], least: float) -> DataFrame:
    """on, a, b, ratio: names of a group whose ratio, the first one's with the second, is `least` or more; both ways round, and not of a name with itself.

    names: on and name, distinct.
    """

    def score(left: list[tuple], right: list[tuple]) -> Iterator[tuple]:
        block = Names([r[0] for r in right])
        for (a,) in left:
            for k in np.flatnonzero(block.bounds(a, least) >= least).tolist():
                b = block.names[k]
                if a != b and (r := ratio(a, b)) >= least:
                    yield a, b, r

    d = names.select(*on, "name")
    return tiled(d, d, on, score, "a string, b string, ratio double")


def overlapping(left: DataFrame, right: DataFrame, on: list[str], most: int) -> DataFrame:
    """on, id, other, overlap: for each left row the `most` right ones of the largest overlap of their words over 0; ties to the smallest other.

    left: on, id, words; right: on, other, words (distinct words each). overlap: words in common over all words.
    """

    def score(left: list[tuple], right: list[tuple]) -> Iterator[tuple]:
        places: dict[str, list[int]] = {}
        for k, (_, words) in enumerate(right):
            for w in words:
                places.setdefault(w, []).append(k)
        sizes, others = np.array([len(r[1]) for r in right]), np.array([r[0] for r in right])
        for own, words in left:
            met = np.zeros(len(right), np.int64)
            for w in words:
                met[places.get(w, [])] += 1
            found = np.flatnonzero(met)
            share = met[found] / (len(words) + sizes[found] - met[found])
            for k in np.lexsort((others[found], -share))[:most].tolist():
                yield own, int(others[found[k]]), float(share[k])

    d = tiled(left.select(*on, "id", "words"), right.select(*on, F.col("other").alias("id"), "words"), on, score, "id long, other long, overlap double")
    best = F.row_number().over(W.partitionBy(*on, "id").orderBy(F.col("overlap").desc(), "other"))
    return d.withColumn("rank", best).where(F.col("rank") <= most)
