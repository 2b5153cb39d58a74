"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes."""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.shared import forget, written

#: Lengths of word beginnings that are terms, beside whole words; the first is the shortest.
BEGINNINGS = (4, 5, 6, 7, 8)

_SIGNS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Words of the whole text in lower case, without ASCII signs."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SIGNS).split()


#: How often a term has to occur in a document for the terms that say so.
OFTEN = ((2, b"+"), (4, b"++"))


def terms_of(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings marked by a hyphen."""
    return [word] + [word[:n] + b"-" for n in BEGINNINGS if len(word) >= n]


def counts_of(ws: list[bytes]) -> Counter:
    """How often each word and word beginning is in a document; a frequent term is a second term too."""
    out = Counter()
    for w, k in Counter(ws).items():
        for t in terms_of(w):
            out[t] += k
    for t, k in list(out.items()):
        for least, mark in OFTEN:
            if k >= least:
                out[t + mark] = 1
    return out


def family(ws: list[bytes]) -> int:
    """A number that near copies mostly share: the least hash of their three-word runs."""
    runs = zip(ws, ws[1:], ws[2:], strict=False)
    return min((xxhash.xxh64_intdigest(b" ".join(r)) for r in runs), default=0) >> 1


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a document are kept from learning: CRC-32 of the id as text leaves 2 by 4. Null ids: no."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


#: Numbers of terms, and a value of each.
Sparse = tuple[np.ndarray, np.ndarray]


@dataclass
class Vocabulary:
    """Terms with their numbers: all words of the examples, and the telling terms (words, beginnings, frequent ones)."""

    number: dict[bytes, int]
    telling: list[bytes]
    heads: set[bytes] = field(default_factory=set)

    def __post_init__(self):
        self.heads = {t.rstrip(b"+-")[: BEGINNINGS[0]] for t in self.telling if t.endswith((b"+", b"-"))}
        self.marked = {t for t in self.telling if t.endswith((b"+", b"-"))}

    def counts(self, text: str) -> Sparse:
        """The numbers of the text's terms, and how often each is there. Beginnings are cut only of words that may have a telling one."""
        n, number, out, more = BEGINNINGS[0], self.number, {}, Counter()
        for w, k in Counter(words(text)).items():
            i = number.get(w)
            if i is not None:
                out[i] = k
            if w[:n] in self.heads:
                for t in terms_of(w):
                    more[t] += k
        for t, k in more.items():
            for s in (t, *(t + mark for least, mark in OFTEN if k >= least)):
                if s in self.marked:
                    out[number[s]] = k if s == t else 1
        return np.fromiter(out, np.int32, len(out)), np.fromiter(out.values(), np.float64, len(out))


class Index:
    """Block-max inverted index of example vectors: each term's largest weight in each block of examples, and the block's postings.

    Terms that many examples have are rows of a matrix, so that their products go for many queries at once.
    """

    def __init__(self, vectors: list[Sparse], terms: int, block: int = 512, heavy: float = 1 / 16):
        self.block, self.n, self.terms = block, len(vectors), terms
        blocks = -(-self.n // block)
        t = np.concatenate([np.zeros(0, np.int32), *[t for t, _ in vectors]])
        x = np.concatenate([np.zeros(0), *[x for _, x in vectors]])
        e = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        many = np.nonzero(np.bincount(t, minlength=terms) > max(1, heavy * self.n))[0] if self.n else np.zeros(0, np.int64)
        self.place = np.full(terms + 1, -1, np.int32)
        self.place[many] = np.arange(len(many))
        self.most = np.zeros((terms, blocks), np.float32)
        self.dense = [np.zeros((len(many), min(block, self.n - b * block))) for b in range(blocks)]
        self.first, self.rows, self.weights = [], [], []
        for b in range(blocks):
            here = e // block == b
            tb, xb, eb = t[here], x[here], e[here] - b * block
            # Rounded up: a bound in single precision has to be no less than the weight.
            np.maximum.at(self.most[:, b], tb, np.nextafter(xb.astype(np.float32), np.float32(np.inf)))
            thick = self.place[tb] >= 0
            self.dense[b][self.place[tb[thick]], eb[thick]] = xb[thick]
            order = np.argsort(tb[~thick], kind="stable")
            self.first.append(np.searchsorted(tb[~thick][order], np.arange(terms + 1)).astype(np.int32))
            self.rows.append(eb[~thick][order].astype(np.int32))
            self.weights.append(xb[~thick][order])

    def nearest(self, queries: list[Sparse], k: int, but: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """Of each query the k examples of largest cosine, (cosine, example), ties to the smaller number; exact. Zero cosines are no neighbours.

        A query opens blocks by falling bound until the bound is under its k-th best so far; queries that open the same
        block in a turn do so together. but: an example that each query leaves out.
        """
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in queries]
        if not self.n or not queries:
            return [[] for _ in queries]
        ts, xs = [t for t, _ in queries], [x for _, x in queries]
        bounds = np.stack([x @ self.most[t] if len(t) else np.zeros(self.most.shape[1]) for t, x in zip(ts, xs, strict=True)])
        order = np.argsort(-bounds, 1, kind="stable")
        thick = np.zeros((len(queries), len(self.dense[0])))
        for i, (t, x) in enumerate(zip(ts, xs, strict=True)):
            p = self.place[t]
            thick[i, p[p >= 0]] = x[p >= 0]
            ts[i], xs[i] = t[p < 0], x[p < 0]
        open_ = np.arange(len(queries))
        for turn in range(order.shape[1]):
            b_of = order[open_, turn]
            bound = bounds[open_, b_of]
            floor = np.array([best[i][0][k - 1] if len(best[i][0]) >= k else 0.0 for i in open_])
            go = (bound > 0) & (bound >= floor - 1e-9)
            open_, b_of = open_[go], b_of[go]
            if not len(open_):
                break
            for b in np.unique(b_of):
                who = open_[b_of == b]
                scores = thick[who] @ self.dense[b]
                first, rows, weights = self.first[b], self.rows[b], self.weights[b]
                for i, s in zip(who, scores, strict=True):
                    lo = first[ts[i]]
                    n = first[ts[i] + 1] - lo
                    total = int(n.sum())
                    if total:
                        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
                        s += np.bincount(rows[at], weights[at] * np.repeat(xs[i], n), len(s))
                    if but is not None and but[i] // self.block == b:
                        s[but[i] % self.block] = 0
                    s = s.round(12)
                    old, ids = best[i]
                    floor_i = old[k - 1] if len(old) >= k else 0.0
                    new = np.nonzero((s > 0) & (s >= floor_i))[0]
                    if len(new) > 4 * k:
                        new = new[s[new] >= np.partition(s[new], len(new) - k)[len(new) - k]]
                    if len(new):
                        c, e = np.concatenate((old, s[new])), np.concatenate((ids, new + b * self.block))
                        keep = np.lexsort((e, -c))[:k]
                        best[i] = c[keep], e[keep]
        return [list(zip(c.tolist(), e.tolist(), strict=True)) for c, e in best]


@dataclass
class Model:
    """Everything scoring needs; its size is bounded by the examples."""

    vocabulary: Vocabulary
    weight: np.ndarray
    index: Index
    ids: list
    labels: np.ndarray
    k: int
    base: float
    pull: float
    steps: tuple[np.ndarray, np.ndarray]

    def vector(self, counts: Sparse) -> Sparse:
        """TF-IDF weights of unit length; those of telling terms are stressed."""
        x = (1 + np.log(counts[1])) * self.weight[counts[0]]
        return counts[0][x > 0], x[x > 0] / np.sqrt((x * x).sum())

    def votes(self, counts: list[Sparse], but: list[int] | None = None) -> list[tuple[float, list[tuple[float, int]]]]:
        """Of each document the share of toxic among its neighbours, with `pull` of a vote for the rate among examples without telling terms.

        A neighbour weighs the cube of its cosine, so that one shared term among many makes a weak vote.
        """
        out = []
        for near in self.index.nearest([self.vector(c) for c in counts], self.k, but):
            total = sum(c**3 for c, _ in near)
            toxic = sum(c**3 * self.labels[e] for c, e in near)
            out.append((float((toxic + self.pull * self.base) / (total + self.pull)), near))
        return out

    def calibrated(self, vote: float) -> float:
        """The rate of toxic examples at such a vote, rising with it, and a trace of the vote itself to keep its order."""
        x, y = self.steps
        return float(np.clip(0.99 * np.interp(vote, x, y) + 0.01 * vote, 0, 1)) if len(x) else vote


def rising(votes: np.ndarray, labels: np.ndarray, floor: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: mean vote and rate of steps that rise, from bins of about `floor` examples at least."""
    order = np.argsort(votes, kind="stable")
    bins = [[votes[c].sum(), labels[c].sum(), len(c)] for c in np.array_split(order, max(1, len(order) // floor)) if len(c)]
    out: list[list[float]] = []
    for b in bins:
        out.append(list(b))
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            last = out.pop()
            out[-1] = [p + q for p, q in zip(out[-1], last, strict=True)]
    return np.array([a / n for a, _, n in out]), np.array([b / n for _, b, n in out])


def _terms_in(examples: DataFrame) -> DataFrame:
    """(term, kin, toxic) of all terms of each example: words, beginnings, frequent ones. kin: a number of its family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ws = words(text.as_py() or "")
                found = list(counts_of(ws))
                if found:
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([family(ws)] * n, pa.int64()), pa.array([toxic] * n, pa.int32())], ["term", "kin", "toxic"])

    return examples.select("text", "toxic").mapInArrow(run, "term binary, kin long, toxic int")


def telling_terms(examples: DataFrame, floor: float = 0.005, odds: float = 10.0, doubt: float = 0.01) -> list[bytes]:
    """Terms that tell toxic examples from others: in families of toxic ones at a rate `odds` times that of the others, and not by chance.

    By chance: under a bound of the binomial tail, fewer than `doubt` of all terms asked would do as well. Families of
    toxic documents count, not copies, so that words of one much copied text are not taken for a sign.
    """
    many = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}  # two rows
    p, n = many.get(1, 0), many.get(0, 0)
    if not p or not n:
        return []
    found = _terms_in(examples).groupBy("term").agg(F.count_distinct(F.when(F.col("toxic") == 1, F.col("kin"))).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    found = written(found.where(F.col("a") >= max(4, floor * p)), "terms")
    asked, share = max(1, found.count()), p / (p + n)
    a, b = F.col("a"), F.col("b")
    surprise = a * F.log(a / (a + b) / share) + F.when(b > 0, b * F.log(b / (a + b) / (1 - share))).otherwise(0.0)
    good = found.where(((a + 0.5) / (p + 1) >= odds * (b + 0.5) / (n + 1)) & (surprise >= float(np.log(asked / doubt))))
    return sorted(bytes(r["term"]) for r in good.select("term").collect())  # terms of at most most_examples texts


def _document_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many have each term of the vocabulary: summed in each task, then by term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    m = len(vocabulary.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        v, n, rows = shared.value, np.zeros(m + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                n[v.counts(text.as_py() or "")[0]] += 1
        n[m] = rows
        at = np.nonzero(n)[0]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["t", "n"])

    out = np.zeros(m + 1, np.int64)
    got = docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row a term of the vocabulary
    out[got["t"].to_numpy()] = got["n"].to_numpy()
    return int(out[m]), out[:m]


def _together(counts: list[Sparse], terms: int, clusters: int = 8, turns: int = 6) -> np.ndarray:
    """An order of the examples in which those that share frequent words come together, so that blocks differ and bounds tell."""
    df = np.bincount(np.concatenate([t for t, _ in counts]), minlength=terms)
    top = np.argsort(-df, kind="stable")[:512]
    place = np.full(terms, -1)
    place[top] = np.arange(len(top))
    x = np.zeros((len(counts), len(top)))
    for i, (t, _) in enumerate(counts):
        t = t[place[t] >= 0]
        x[i, place[t]] = np.log((len(counts) + 1) / (df[t] + 1)) + 0.01
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[0]]
    for _ in range(min(clusters, len(x)) - 1):  # each next centre is the example farthest from those there are
        centres.append(x[np.argmin(np.max(x @ np.stack(centres).T, 1))])
    c = np.stack(centres)
    for _ in range(turns):
        near = np.argmax(x @ c.T, 1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return np.lexsort((np.arange(len(x)), np.argmax(x @ c.T, 1)))


def fit(docs: DataFrame, labels: DataFrame, most_examples: int = 4096, most_indexed: int = 2048, k: int = 25, pull: float = 0.5, stress: float = 6.0) -> Model:
    """A model of labelled examples.

    Labels are taken from rows not held out; of these at most most_examples (smallest by a hash of the id) show which
    terms tell, and the first most_indexed of them are the examples that the index holds, the bound of the model's size.
    Terms are all words of these, and the telling terms, which weigh `stress` times as much. Document frequencies are
    counted over all documents.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = written(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples), "toxic-sample")
    examples = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # the sample is bounded
    examples = written(examples.dropDuplicates(["doc_id"]), "toxic-examples")
    telling = telling_terms(examples)
    first = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_indexed).select("doc_id")
    rows = examples.join(F.broadcast(first), "doc_id", "left_semi").orderBy("doc_id").collect()  # at most most_indexed rows
    found = {w for r in rows for w in words(r["text"] or "")} | set(telling)
    vocabulary = Vocabulary({t: i for i, t in enumerate(sorted(found))}, telling)
    m = len(vocabulary.number)
    total, df = _document_counts(docs, vocabulary)
    weight = np.log((total + 1) / (df + 1)) if m else np.zeros(0)
    marks = np.array([vocabulary.number[t] for t in telling], np.int64)
    weight[marks] *= stress

    counts = [vocabulary.counts(r["text"] or "") for r in rows]
    if rows:
        order = _together(counts, max(m, 1))
        rows, counts = [rows[i] for i in order], [counts[i] for i in order]
    labels_of = np.array([r["toxic"] for r in rows], float)
    plain = [r["toxic"] for r, (t, _) in zip(rows, counts, strict=True) if not np.isin(t, marks).any()]
    base = (sum(plain) + 0.5) / (len(plain) + 1 + (not plain))
    model = Model(vocabulary, weight, Index([], m), [r["doc_id"] for r in rows], labels_of, k, float(base), pull, (np.zeros(0), np.zeros(0)))
    model.index = Index([model.vector(c) for c in counts], m)
    if rows:
        own = [v for i in range(0, len(rows), CHUNK) for v, _ in model.votes(counts[i : i + CHUNK], list(range(i, min(i + CHUNK, len(rows)))))]
        model.steps = rising(np.array(own), labels_of)
    return model


#: Documents that are scored together.
CHUNK = 256


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, evidence: int = 3, **how) -> DataFrame:
    """doc_id, h, held_out, score (0 to 1), predicted, terms array<string>, neighbours array<doc_id> of every document.

    A document is the vector of its TF-IDF weights over all terms of the examples (fit); its score is the calibrated vote
    of its k nearest examples by exact cosine. Its telling terms and first neighbours are the evidence. Texts are
    taken whole. Documents that share no term with an example, empty and null texts among them, have no neighbours and the
    score of a vote for the rate among examples without telling terms.

    Null doc_ids have no label and are not held out. Repeated rows come out alike. Documents with several labels
    count as toxic if any says so. No usable labels: no neighbours, and all scores are 0.25. Empty input: no rows. Other
    columns are not read. h is a hash of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    doc = docs.schema["doc_id"]
    schema = T.StructType([doc, T.StructField("h", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("neighbours", T.ArrayType(doc.dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m: Model = shared.value
        names = {m.vocabulary.number[t]: t.decode("utf-8", "replace") for t in m.vocabulary.telling}
        told = np.zeros(len(m.vocabulary.number), bool)
        told[list(names)] = True
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                counts = [m.vocabulary.counts(t.as_py() or "") for t in batch.column(2)]
                votes = m.votes(counts)
                a = [m.calibrated(v) for v, _ in votes]
                b = [sorted(names[t] for t in ts[told[ts]].tolist()) for ts, _ in counts]
                c = [[m.ids[e] for _, e in near[:evidence]] for _, near in votes]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.float64()), pa.array(b, pa.list_(pa.string())), pa.array(c, pa.list_(batch.column(0).type))], schema.names)

    scored = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").mapInArrow(run, schema)
    return scored.select("doc_id", "h", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "terms", "neighbours")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score under the threshold. Same edge cases as score."""
    bad = score(docs, labels, threshold).where("predicted = 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(bad, docs.doc_id.eqNullSafe(bad["_id"]) & (h == bad["_h"]), "left_anti")
