"""Nearest vectors: a hierarchical k-means tree with best-bin-first search, and exact norm-bucketed top-k inner products."""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from caseloom.llm.shared import written


def numbered(vectors: DataFrame, value: Column, zero: bool) -> DataFrame:
    """(row, vec_id, v array<double or long>, query) of the vectors that take part, written: row numbers tell repeated rows apart.

    Left out: null vectors, empty ones, those with null or non-finite components, and zero vectors unless zero. Vectors
    of unequal lengths: the shorter ones get zeros at their ends.
    """
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        fine = fine & F.exists(e, lambda x: x != 0)
    d = vectors.where(e.isNotNull() & (F.size(e) > 0)).where(fine)
    d = d.select("vec_id", value.alias("v"), (F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))).alias("query")).where(F.forall("v", lambda x: x.isNotNull()))
    d = written(d.withColumn("row", F.monotonically_increasing_id()), "vectors")
    low, high = d.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low == high:
        return d
    kind = d.schema["v"].dataType.elementType
    return d.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast(kind), F.lit(high) - F.size("v"))))


def matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


#: Stands for a null vec_id inside tasks.
NO_ID = -(1 << 63)


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy()


def best_of(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores (not -inf), ties to smaller id, then row."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= cut)[0]
    else:
        at = np.arange(len(scores))
    at = at[scores[at] > -np.inf]
    return at[np.lexsort((rows[at], ids[at], -scores[at]))[:k]]


def merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query's rows."""
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    r = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return r.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


FOUND = "query_row long, query_id long, row long, vec_id long, score "


def _rows(parts: list[tuple], score: pa.DataType) -> pa.RecordBatch | None:
    if not parts:
        return None
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    types = [pa.int64()] * 4 + [score]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["query_row", "query_id", "row", "vec_id", "score"])


# ---------------------------------------------------------------- hierarchical k-means tree


@dataclass
class Tree:
    """Centres of each node's children; a child is a node (its number) or, if negative, leaf -1 - number."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaves: int

    def leaf(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at each node."""
        out = np.zeros(len(v), np.int64)
        todo = [(0, np.arange(len(v)))] if self.centres else []
        while todo:
            node, at = todo.pop()
            near = np.argmax(v[at] @ self.centres[node].T, 1)
            for c, child in enumerate(self.children[node]):
                part = at[near == c]
                if len(part) and child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out

    def order(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order, `most` at most: a queue holds what is open by the similarity of its centre."""
        if not self.centres:
            return [0][:most]
        queue, out, tick = [(-2.0, 0, 0)], [], 0
        while queue and len(out) < most:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                continue
            for s, child in zip(self.centres[node] @ q, self.children[node], strict=True):
                tick += 1
                heapq.heappush(queue, (-float(s), tick, child))
        return out


    def branches(self) -> np.ndarray:
        """The branch of the root that each leaf hangs from."""
        out = np.zeros(self.leaves, np.int32)
        todo = [(child, b) for b, child in enumerate(self.children[0])] if self.centres else []
        while todo:
            node, b = todo.pop()
            if node < 0:
                out[-1 - node] = b
            else:
                todo += [(child, b) for child in self.children[node]]
        return out


def grow(sample: np.ndarray, rows: int, branch: int, leaf_rows: int, least: int = 24, turns: int = 8) -> Tree:
    """A tree over unit vectors: a node splits by k-means while it stands for more than leaf_rows rows and has 2 * least samples."""
    rng = np.random.default_rng(7)
    tree = Tree([], [], 0)

    def split(at: np.ndarray) -> int:
        x = sample[at]
        k = min(branch, len(at) // least)
        if k < 2 or len(at) * rows <= leaf_rows * len(sample):
            tree.leaves += 1
            return -tree.leaves
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(turns):
            near = np.argmax(x @ centres.T, 1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
        near = np.argmax(x @ centres.T, 1)
        if np.bincount(near, minlength=k).max() == len(at):
            tree.leaves += 1
            return -tree.leaves
        node = len(tree.centres)
        tree.centres.append(centres)
        tree.children.append([])
        tree.children[node] = [split(at[near == c]) if (near == c).any() else _empty(tree) for c in range(k)]
        return node

    split(np.arange(len(sample)))
    tree.leaves = max(tree.leaves, 1)
    return tree


def _empty(tree: Tree) -> int:
    tree.leaves += 1
    return -tree.leaves


def nearest(vectors: DataFrame, k: int = 5, recall: float = 0.95, sample: int = 16_384, branch: int = 8, leaf_rows: int = 512, trials: int = 128, chunk: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: approximate k nearest by cosine of every query row (vec_id divisible by 50) among all other rows.

    A hierarchical k-means tree is fitted on a sample (at most `sample` rows, smallest by a hash), and every row goes
    to its leaf. A query visits leaves best bin first. How many is calibrated: for `trials` queries the true
    neighbours are found by brute force over all rows, and visits widen until `recall` of them lie in visited leaves.
    Scores are exact cosines in double precision of the vectors as given; ties go to the smaller vec_id.

    The rows under each branch of the root are dealt out in chunks of about `chunk` rows, and their queries likewise, so
    that a much repeated vector is shared by many tasks; in a chunk a query meets the leaves it visits. Null, zero and non-finite vectors take no part (numbered), nor do
    rows with null vec_id as queries; they are candidates. Fewer candidates than k: all of them. Empty input: no rows.
    """
    spark = vectors.sparkSession
    d = numbered(vectors, F.transform("embedding", lambda x: x.cast("double")), zero=False)
    rows = d.count()
    some = d.orderBy(F.xxhash64("row"), "row").limit(sample).select("v").toArrow()
    x = matrix(some.column(0)) if some.num_rows else np.zeros((0, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = grow(x, rows, branch, leaf_rows)
    shared = spark.sparkContext.broadcast(tree)

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(0))
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                leaf = pa.array(shared.value.leaf(v).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), b.column(0), leaf], ["row", "vec_id", "query", "v", "leaf"])

    placed = d.select("v", "row", "vec_id", "query").mapInArrow(to_leaf, "row long, vec_id long, query boolean, v array<double>, leaf int")
    placed = written(placed, "leaves")
    visits = _calibrated(placed, tree, k, recall, trials)

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch_of = shared.value.branches()
        for b in batches:
            at, where, leaves = [], [], []
            for i, u in enumerate(matrix(b.column(2)) if b.num_rows else []):
                seen = np.array(shared.value.order(u / np.linalg.norm(u), visits))
                for branch in np.unique(branch_of[seen]):
                    at.append(i)
                    where.append(int(branch))
                    leaves.append(seen[branch_of[seen] == branch].tolist())
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(at, pa.int64())) for i in range(3)] + [pa.array(where, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["query_row", "query_id", "q", "branch", "leaves"])

    asked = placed.where("query").select("row", "vec_id", "v").mapInArrow(to_visits, "query_row long, query_id long, q array<double>, branch int, leaves array<int>")
    asked = written(asked, "visits")
    stems = F.get(F.lit(tree.branches().tolist()), F.col("leaf")).cast("int")
    held = placed.withColumn("branch", stems)
    # A row for each branch of the root: rows and queries of a branch are dealt out in chunks.
    parts = held.groupBy("branch").agg(F.ceil(F.count("*") / chunk).cast("int").alias("cs"))
    parts = parts.join(asked.groupBy("branch").agg(F.ceil(F.count("*") / chunk).cast("int").alias("qs")), "branch")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(F.broadcast(parts), "branch").select("branch", deal("query_row", "qs").alias("qc"), every("cs").alias("cc"), "query_row", "query_id", "q", "leaves")
    right = held.join(F.broadcast(parts), "branch").select("branch", every("qs").alias("qc"), deal("row", "cs").alias("cc"), "row", "vec_id", "v", "leaf")

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        parts = []
        if q.num_rows and c.num_rows:
            parts = _cosines(*(q[n].to_numpy() for n in ("query_row", "query_id")), matrix(q["q"]), c["row"].to_numpy(), ids_of(c["vec_id"]), matrix(c["v"]), k, c["leaf"].to_numpy(), q["leaves"].to_pylist())
        b = _rows(parts, pa.float64())
        return pa.Table.from_batches([b] if b else [], schema=_found_schema)

    found = left.groupBy("branch", "qc", "cc").cogroup(right.groupBy("branch", "qc", "cc")).applyInArrow(search, FOUND + "double")
    return merged(found, k)


_found_schema = pa.schema([(n, pa.int64()) for n in ("query_row", "query_id", "row", "vec_id")] + [("score", pa.float64())])


def _cosines(query_rows, query_ids, q, rows, ids, v, k: int, leaf=None, visited=None, block: int = 256) -> list[tuple]:
    """The k best candidates of each query, of the leaves it visits if those are given.

    Every cosine is computed in one way, whatever else is in the block.
    """
    if leaf is not None:
        order = np.argsort(leaf, kind="stable")
        rows, ids, v, leaf = rows[order], ids[order], v[order], leaf[order]
        edges = {int(x): (a, b) for x, a, b in zip(*_runs(leaf), strict=True)}
    nq, nv, out = np.sqrt(np.einsum("id,id->i", q, q)), np.sqrt(np.einsum("id,id->i", v, v)), []
    for start in range(0, len(q), block):
        here = slice(start, start + block)
        if leaf is None:
            scores = np.einsum("id,jd->ij", q[here], v) / (nq[here, None] * nv)
        else:
            scores = np.full((len(q[here]), len(v)), -np.inf)
            by_leaf: dict[int, list[int]] = {}
            for i, leaves in enumerate(visited[here]):
                for x in leaves:
                    by_leaf.setdefault(x, []).append(i)
            for x, who in by_leaf.items():
                if x in edges:
                    a, b = edges[x]
                    scores[who, a:b] = np.einsum("id,jd->ij", q[here][who], v[a:b]) / (nq[here][who, None] * nv[a:b])
        scores[query_rows[here, None] == rows] = -np.inf
        for i, s in enumerate(scores):
            at = best_of(s, ids, rows, k)
            n = len(at)
            out.append((np.full(n, query_rows[start + i]), np.full(n, query_ids[start + i]), rows[at], ids[at], s[at]))
    return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted array, and where each begins and ends."""
    found, first = np.unique(values, return_index=True)
    return found, first, np.append(first[1:], len(values))


def _calibrated(placed: DataFrame, tree: Tree, k: int, recall: float, trials: int) -> int:
    """How many leaves to visit so that `recall` of the true neighbours of the trial queries lie in them."""
    trial = placed.where("query").orderBy(F.xxhash64(F.lit("trial"), "row"), "row").limit(trials).select("row", "vec_id", "v").toArrow()
    if not trial.num_rows:
        return 1
    shared = placed.sparkSession.sparkContext.broadcast((trial["row"].to_numpy(), trial["vec_id"].to_numpy(), matrix(trial["v"])))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r = _rows(_cosines(*shared.value, b.column(0).to_numpy(), ids_of(b.column(1)), matrix(b.column(2)), k), pa.float64())
                where = dict(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True))
                leaf = pa.array([where[x] for x in r.column(2).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([*r.columns, leaf], [*r.schema.names, "leaf"])

    found = placed.select("row", "vec_id", "v", "leaf").mapInArrow(brute, FOUND + "double, leaf int")
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    true = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_row", "leaf").collect()  # trials * k rows
    orders = {r: {leaf: i + 1 for i, leaf in enumerate(tree.order(u / np.linalg.norm(u), tree.leaves))} for r, u in zip(*(shared.value[i] for i in (0, 2)), strict=True)}
    ranks = np.sort([orders[r["query_row"]][r["leaf"]] for r in true]) if true else np.ones(1)
    visits = 1
    while (ranks <= visits).mean() < recall:
        visits += 1
    return visits


# ---------------------------------------------------------------- exact inner products, by buckets of norm


def _packed(rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in (rows.astype(np.int64), ids.astype(np.int64), v.astype(np.int64))]


def _unpacked(rows: bytes, ids: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.frombuffer(rows, np.int64)
    return r, np.frombuffer(ids, np.int64), np.frombuffer(v, np.int64).reshape(len(r), -1)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: by doubles or longs while those hold all of them, else by whole numbers of any size."""
    largest = lambda x: max(-float(x.min(initial=0)), float(x.max(initial=0)))
    bound = largest(q) * largest(v) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return np.einsum("id,jd->ij", q, v)
    return q.astype(object) @ v.astype(object).T


def _top_scores(s: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller id, then row. A score among them that no long holds raises OverflowError."""
    if s.dtype == object:
        top = np.array(sorted(range(len(s)), key=lambda i: (-s[i], ids[i], rows[i]))[:k], np.int64)
        if any(not -(2**63) <= s[i] < 2**63 for i in top):
            raise OverflowError("an inner product among the highest does not fit a long")
        return top
    if len(s) <= k:
        return np.arange(len(s))
    top = np.nonzero(s >= np.partition(s, len(s) - k)[len(s) - k])[0]
    return top[np.lexsort((rows[top], ids[top], -s[top]))[:k]]


def candidates(q: np.ndarray, nq: float, theta: float, v: np.ndarray, nv: np.ndarray, steep: float = 0.7, focus: int = 3) -> np.ndarray:
    """Places in a bucket (norms nv falling) that may reach the score theta with the query: none that can is left out.

    The bucket's cosine threshold is theta over the query's norm and the bucket's largest. If it is steep, few directions
    do, and the query's largest coordinates bound the candidate's (coordinate pruning); else norms alone do (length pruning).
    """
    if theta <= 0 or nq == 0 or not len(nv):
        return np.arange(len(nv)) if theta <= 0 else np.zeros(0, np.int64)
    far = int(np.searchsorted(-nv, -(theta / nq) * (1 - 1e-9), "right"))
    if not far:
        return np.zeros(0, np.int64)
    cosine = theta / (nq * nv[0]) * (1 - 1e-9)
    at = np.arange(far)
    if cosine >= steep:
        widest = np.arccos(min(1.0, cosine))
        for f in np.argsort(-np.abs(q))[:focus]:
            # A direction within that angle of the query makes an angle with the axis that differs by no more.
            angle = np.arccos(np.clip(q[f] / nq, -1, 1))
            low, high = np.cos(min(np.pi, angle + widest)), np.cos(max(0.0, angle - widest))
            x = v[at, f] / nv[at]
            at = at[(x >= low - 1e-7) & (x <= high + 1e-7)]
    return at


def top_products(vectors: DataFrame, k: int = 5, scale: int = 256, bucket: int = 2048, most_buckets: int = 4096, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query row (vec_id divisible by 50) with all other rows. Exact.

    Components are floor(scale * x). Rows are grouped by norm, from long to short, a group dealt out in chunks of about `bucket` rows
    (so a norm that most rows have is many chunks). Queries go in blocks. A first pass over a chunk of the longest
    vectors gives each query a score that its k-th best has at least; blocks then meet only the groups whose norm can
    reach it, and inside a chunk each query prunes by coordinates or by length (candidates), then verifies products.
    Pruning only leaves out what cannot reach the threshold; ties are kept, and go to the smaller vec_id.

    Components and scores are exact at any size: a component that no long holds raises an error, as does such a score
    among a query's highest of a chunk.

    Left out as queries and candidates: null vectors and those with null or non-finite components (numbered). Zero vectors take part. Null vec_ids: candidates only, first among ties. Empty input: no rows.
    """
    too_large = F.raise_error(F.lit("a component does not fit a long")).cast("long")
    value = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) * scale < 2.0**63, F.floor(x.cast("double") * scale)).otherwise(too_large))
    d = numbered(vectors, value, zero=True)
    d = d.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    total, queries = d.agg(F.count("*"), F.count_if("query")).first()
    if not total or not queries:
        empty = "query_id long, rank int, vec_id long, score long"
        return d.sparkSession.createDataFrame([], empty)
    buckets = min(most_buckets, -(-total // bucket))
    cuts = sorted(set(d.stat.approxQuantile("norm", [i / buckets for i in range(1, buckets)], 0.25 / buckets)), reverse=True) if buckets > 1 else []
    which = F.size(F.filter(F.lit(cuts).cast("array<double>") if cuts else F.array().cast("array<double>"), lambda c: c > F.col("norm"))) if cuts else F.lit(0)
    d = d.withColumn("bucket", which)
    sizes = d.groupBy("bucket").agg(F.ceil(F.count("*") / bucket).cast("int").alias("chunks"), F.max("norm").alias("longest"))
    sizes = written(sizes, "buckets")  # at most most_buckets rows
    dealt = d.join(F.broadcast(sizes), "bucket").withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks").cast("int"))

    def chunked(t: pa.Table) -> pa.Table:
        v, norm = matrix(t["v"], np.int64), t["norm"].to_numpy()
        ids = ids_of(t["vec_id"])
        order = np.argsort(-norm, kind="stable")
        head = [pa.array([t["bucket"][0].as_py()], pa.int32()), pa.array([t["chunk"][0].as_py()], pa.int32())]
        return pa.Table.from_arrays(head + _packed(t["row"].to_numpy()[order], ids[order], v[order]), ["bucket", "chunk", "rows", "ids", "vs"])

    chunks = dealt.groupBy("bucket", "chunk").applyInArrow(chunked, "bucket int, chunk int, rows binary, ids binary, vs binary")
    chunks = written(chunks, "chunks")
    n_blocks = -(-queries // block)
    asked = d.where("query").withColumn("bucket", F.lit(0)).withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    asked = asked.groupBy("bucket", "chunk").applyInArrow(chunked, "bucket int, chunk int, rows binary, ids binary, vs binary")
    asked = asked.select(F.col("chunk").alias("block"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("vs").alias("qs"))

    first = chunks.orderBy("bucket", "chunk").limit(1).collect()[0]  # one chunk: about `bucket` rows
    seed = d.sparkSession.sparkContext.broadcast((bytes(first["rows"]), bytes(first["ids"]), bytes(first["vs"])))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, _, v = _unpacked(*seed.value)
        for b in batches:
            thetas, needs = [], []
            for i in range(b.num_rows):
                q_rows, _, q = _unpacked(*(b.column(c)[i].as_py() for c in (1, 2, 3)))
                s = _products(q, v).astype(np.float64)
                s[q_rows[:, None] == rows] = -np.inf
                theta = np.partition(s, len(rows) - k, 1)[:, len(rows) - k] if len(rows) > k else np.full(len(q), -np.inf)
                norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                need = np.where(theta > 0, theta / np.where(norm > 0, norm, np.inf), 0.0)
                thetas.append(theta.tobytes())
                needs.append(float(need.min()) * (1 - 1e-9))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(thetas, pa.binary()), pa.array(needs, pa.float64())], [*b.schema.names, "thetas", "need"])

    asked = asked.mapInArrow(thresholds, "block int, q_rows binary, q_ids binary, qs binary, thetas binary, need double")
    asked = written(asked, "blocks")
    lengths = sizes.orderBy("bucket").collect()  # at most most_buckets rows, from long to short
    reached = F.size(F.filter(F.lit([r["longest"] for r in lengths]), lambda x: x >= F.col("need")))
    reach = asked.withColumn("bucket", F.explode(F.slice(F.lit([r["bucket"] for r in lengths]), F.lit(1), reached))).drop("need")
    # A block meets the chunks of a bucket one by one, so that a norm that most vectors have is shared by many tasks.
    reach = reach.join(F.broadcast(sizes.select("bucket", "chunks")), "bucket").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for i in range(b.num_rows):
                q_rows, q_ids, q = _unpacked(*(b.column(c)[i].as_py() for c in (0, 1, 2)))
                thetas = np.frombuffer(b.column(3)[i].as_py(), np.float64)
                rows, ids, v = _unpacked(*(b.column(c)[i].as_py() for c in (4, 5, 6)))
                nq, nv = (np.sqrt((x.astype(np.float64) ** 2).sum(1)) for x in (q, v))
                scores = None
                for j in range(len(q)):
                    at = candidates(q[j], nq[j], thetas[j], v, nv)
                    if not len(at):
                        continue
                    if len(at) > len(v) // 4:  # much of the chunk: one product of matrices serves all such queries
                        scores = _products(q, v) if scores is None else scores
                        s = scores[j, at]
                    else:
                        s = _products(q[j : j + 1], v[at])[0]
                    keep = rows[at] != q_rows[j]
                    at, s = at[keep], s[keep]
                    top = _top_scores(s, ids[at], rows[at], k)
                    n = len(top)
                    parts.append((np.full(n, q_rows[j]), np.full(n, q_ids[j]), rows[at[top]], ids[at[top]], s[top].astype(np.int64)))
            if (r := _rows(parts, pa.int64())) is not None:
                yield r

    pairs = reach.join(chunks, ["bucket", "chunk"]).select("q_rows", "q_ids", "qs", "thetas", "rows", "ids", "vs")
    found = pairs.mapInArrow(verify, FOUND + "long")
    return merged(found, k)
