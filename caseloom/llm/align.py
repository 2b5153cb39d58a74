"""Cross-tokenizer alignment: where tokens of two tokenizers end together, found for all documents of a batch in lockstep."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.shared import forget, remembered, written

#: UTF-8 bytes of texts that a worker aligns at a time, and of a lane: a stretch of a document that ends with a word.
BATCH_BYTES, LANE_BYTES = 1 << 20, 1 << 10
#: Documents whose links are counted at a time.
ROWS = 256
#: Words, with the space before them, that a worker remembers at most; beyond that it starts anew.
REMEMBERED = 300_000

#: Signs whose class is the same in every Unicode version, and whose class Python's expressions tell: other texts are encoded whole.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
_PARTS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WORD = re.compile(r"\s+\S*(?:[^\S ]\s*\S*)*")


class Side:
    """Tokens of remembered words for one tokenizer: those of word k are ids, sizes (bytes) from first[k] to first[k + 1].

    encode: ids of each of many words; names: the bytes of each id. exact[k]: the tokens' bytes, joined, are the word's.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], names: list[bytes]):
        self.encode, self.names, self.lengths = encode, names, np.array(list(map(len, names)), np.int32)
        self.ids, self.sizes, self.first, self.exact = array("i"), array("i"), array("q", [0]), bytearray()

    def add(self, words: list[str], found: list[list[int]]) -> None:
        ids = np.fromiter(chain.from_iterable(found), np.int32)
        many = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        sizes = self.lengths[ids]
        upto = np.r_[0, np.cumsum(sizes, dtype=np.int64)][many]
        texts = [w.encode() for w in words]
        joined = b"".join(map(self.names.__getitem__, ids.tolist()))
        bounds = [0, *upto.tolist()]
        self.exact.extend(joined[a:b] == t for a, b, t in zip(bounds[:-1], bounds[1:], texts, strict=True))
        self.first.frombytes((many + len(self.ids)).tobytes())
        self.ids.frombytes(ids.tobytes())
        self.sizes.frombytes(sizes.tobytes())

    def gather(self, words: np.ndarray, many_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, ends in bytes over all, and number of tokens of each document, whose words stand in a row."""
        first = np.frombuffer(self.first, np.int64)
        begin = first[words]
        many = first[words + 1] - begin
        upto = np.r_[0, np.cumsum(many)]
        at = np.repeat(begin - upto[:-1], many) + np.arange(upto[-1])
        n = np.diff(upto[np.r_[0, np.cumsum(many_words)]])
        return np.frombuffer(self.ids, np.int32)[at], np.cumsum(np.frombuffer(self.sizes, np.int32)[at], dtype=np.int64), n


class Pair(dict):
    """Both tokenizers, and the numbers of the words that were met: A byte-level, of space + text; B of word pieces with byte fallback, which adds the space itself.

    A word here ends before a space that follows a sign other than white space: both tokenizers have a token's end there.
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        super().__init__()
        whole = Tokenizer.from_file(a_path)
        whole.encode_special_tokens = True
        pieces = SentencePieceProcessor(model_file=b_path)
        signs = byte_signs()
        level, back, model = dict(enumerate(signs)), {c: b for b, c in enumerate(signs)}, whole.model
        a_names = [b""] * whole.get_vocab_size()
        for token, i in whole.get_vocab().items():
            a_names[i] = bytes(map(back.get, token)) if all(c in back for c in token) else token.encode()
        b_tokens = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
        #: Whether no piece of B goes on with a space after another sign.
        self.splits = not any("\u2581" in t.lstrip("\u2581") for t in b_tokens)
        space = pieces.piece_to_id("\u2581")

        def a_ids(words: list[str]) -> list[list[int]]:
            return [[t.id for part in _PARTS.findall(w) for t in model.tokenize(part.encode().decode("latin-1").translate(level))] for w in words]

        def b_ids(words: list[str]) -> list[list[int]]:  # the space that B adds is the word's own
            found = pieces.encode([w[1:] for w in words], num_threads=1)
            return [ids or [space] for ids in found]

        self.whole_a = lambda text: whole.encode(" " + text, add_special_tokens=False).ids
        self.whole_b = pieces.encode
        self.a, self.b = Side(a_ids, a_names), Side(b_ids, [piece_bytes(t) for t in b_tokens])

    def learn(self, words: list[str]) -> None:
        self.update(zip(words, range(len(self.a.exact), len(self.a.exact) + len(words)), strict=True))
        self.a.add(words, self.a.encode(words))
        self.b.add(words, self.b.encode(words))

    def whole(self, text: str) -> int:
        """The number of a word that is the whole text, which is not looked up again."""
        self.a.add([" " + text], [self.whole_a(text)])
        self.b.add([" " + text], [self.whole_b(text)])
        return len(self.a.exact) - 1

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, tuple, tuple]:
        """Which texts are given back byte for byte by both, and of these (ids, ends, tokens of each text) of A and of B."""
        found = [_WORD.findall(" " + t) if t and self.splits and not _OTHER.search(t) else [] for t in texts]
        self.learn(list(set(chain.from_iterable(found)).difference(self)))
        many = np.fromiter(map(len, found), np.int64, len(found))
        words = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.int64, int(many.sum()))
        exact = np.r_[0, np.cumsum(np.frombuffer(self.a.exact, bool)[words] & np.frombuffer(self.b.exact, bool)[words])]
        ends = np.r_[0, np.cumsum(many)]
        rest = [k for k in np.flatnonzero((np.diff(exact[ends]) < many) | (many == 0)).tolist() if texts[k]]
        if rest:
            parts = [words[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            for k in rest:
                n = self.whole(texts[k])
                parts[k] = np.array([n] if self.a.exact[n] and self.b.exact[n] else [], np.int64)
            words, many = np.concatenate(parts), np.array(list(map(len, parts)))
        good = many > 0
        return good, self.a.gather(words, many[good]), self.b.gather(words, many[good])


def byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in kept else next(others)) for b in range(256)]


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece of B: <0xHH> is a byte, U+2581 a space."""
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


def lanes(text: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of A and B in each lane, and one past the last: documents (by their ends in bytes), long ones cut about every LANE_BYTES.

    A cut lies before a space that follows an ASCII letter or digit, where both have a token's end; where one has none there is no cut.
    """
    word = np.zeros(256, bool)
    word[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    spaces = np.flatnonzero((text[1:] == 32) & word[text[:-1]]) + 1
    wanted = np.searchsorted(spaces, np.arange(LANE_BYTES, len(text), LANE_BYTES))
    cuts = np.union1d(spaces[wanted[wanted < len(spaces)]], documents)
    firsts = []
    for ends in (ends_a, ends_b):
        at = np.searchsorted(ends, cuts, "right")
        firsts.append(at)
        cuts_met = ends[at - 1] == cuts
        cuts, firsts = cuts[cuts_met], [f[cuts_met] for f in firsts]
    return np.r_[0, firsts[0]], np.r_[0, firsts[1]]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of A and of B, whether a token of the other ends with it.

    One state vector holds a pointer into A and into B for each lane. A step compares what the pointers end at, marks
    equal ends, and moves on the pointer that is behind (both, if equal); lanes that are through leave the vector.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    a, b, last = first_a[:-1], first_b[:-1], first_a[1:]
    while len(a):
        x, y = ends_a[a], ends_b[b]
        same = x == y
        cut_a[a[same]] = True
        cut_b[b[same]] = True
        a, b = a + (x <= y), b + (y <= x)
        going = a < last
        if not going.all():
            a, b, last = a[going], b[going], last[going]
    return cut_a, cut_b


def group_texts(a: np.ndarray, cut_a: np.ndarray, n_a: np.ndarray, b: np.ndarray, cut_b: np.ndarray, n_b: np.ndarray, signs: list[str]) -> Iterator[str]:
    """`a1,a2|b1;a3|b2,b3` of each document. signs: `names` of ids up to the largest."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    half = len(signs) // 3
    code = np.r_[a + half * cut_a, b + 2 * half * cut_b]
    code = code[np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")].tolist()
    at = 0
    for n in (n_a + n_b).tolist():
        yield "".join(map(signs.__getitem__, code[at : at + n]))[:-1]
        at += n


OUTPUTS = {
    "n_a": T.LongType(),
    "n_b": T.LongType(),
    "n_groups": T.LongType(),
    "n_links": T.LongType(),
    "groups_sha256": T.StringType(),
    "links": T.ArrayType(T.IntegerType()),
    "groups": T.ArrayType(T.StructType([T.StructField("end", T.LongType()), T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))])),
}


def align(docs: DataFrame, a_path: str, b_path: str, outputs: tuple[str, ...] = ("n_a", "n_b", "n_groups", "n_links", "groups")) -> DataFrame:
    """doc_id and the outputs of every document: tokens of A and B, groups between bytes where tokens of both end, and links.

    A encodes space + text, B the text, to which it adds the space; special tokens' strings are plain text. n_a, n_b:
    tokens. groups: end (bytes of space + text before the cut), a, b (the group's ids). links: a x (ids of B) + b of the two tokens that
    end a group together, in order (tokens are never empty, so each group has one). groups_sha256: hex SHA-256 of
    `a1,a2|b1;a3|b2,b3`, ids in decimal. Texts are aligned whole, in batches bounded by bytes; documents stay in their
    partitions.

    Texts that are null, empty, or that one of the tokenizers does not give back byte for byte have no tokens: zeros,
    empty lists, and '' unhashed. Null doc_ids and repeated rows: documents like any other. Empty input: no rows.
    Columns beside doc_id and text are not read.
    """
    fields = [docs.schema["doc_id"], *(T.StructField(n, OUTPUTS[n]) for n in outputs)]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, begin = 0, 0
            texts = batch.column(1)
            lengths = [n or 0 for n in pc.binary_length(texts).to_pylist()]
            for k in range(len(texts)):
                size += lengths[k]
                if size >= BATCH_BYTES or k == len(texts) - 1:
                    pair = tokenizer_pair(a_path, b_path)
                    columns = _aligned(pair, [t.as_py() or "" for t in texts[begin : k + 1]], outputs)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[begin : k + 1], *columns], names)
                    size, begin = 0, k + 1

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def _aligned(pair: Pair, texts: list[str], outputs: tuple[str, ...]) -> list[pa.Array]:
    """The output columns of a batch of texts."""
    good, (a, ends_a, n_a), (b, ends_b, n_b) = pair.tokens(texts)
    joined = np.frombuffer("".join(" " + t for t, g in zip(texts, good.tolist(), strict=True) if g).encode(), np.uint8)

    def for_all(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        out[good] = values
        return out

    documents = ends_a[np.cumsum(n_a) - 1]
    cut_a, cut_b = lockstep(ends_a, ends_b, *lanes(joined, ends_a, ends_b, documents))
    groups = for_all(np.diff(np.r_[0, np.r_[0, np.cumsum(cut_a)][np.cumsum(n_a)]]))
    starts = pa.array(np.r_[0, np.cumsum(groups)], pa.int32())
    made = {"n_a": lambda: pa.array(for_all(n_a)), "n_b": lambda: pa.array(for_all(n_b)), "n_groups": lambda: pa.array(groups), "n_links": lambda: pa.array(groups)}
    made["links"] = lambda: pa.ListArray.from_arrays(starts, pa.array(a[cut_a] * np.int32(len(pair.b.names)) + b[cut_b], pa.int32()))

    def digests() -> pa.Array:
        texts = group_texts(a, cut_a, n_a, b, cut_b, n_b, group_signs(max(len(pair.a.names), len(pair.b.names))))
        found = (hashlib.sha256(t.encode()).hexdigest() for t in texts)
        return pa.array([next(found) if g else "" for g in good], pa.string())

    def spans() -> pa.Array:
        many = [np.diff(np.r_[-1, np.flatnonzero(c)]) for c in (cut_a, cut_b)]
        lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(m)], pa.int32()), pa.array(ids, pa.int32())) for m, ids in zip(many, (a, b), strict=True)]
        before = np.repeat(np.r_[0, documents][:-1], groups[good])
        return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([pa.array(ends_a[cut_a] - before), *lists], ["end", "a", "b"]))

    made |= {"groups_sha256": digests, "groups": spans}
    return [made[n]() for n in outputs]


def group_signs(n: int) -> list[str]:
    """What an id is written as in a group: n times with a comma, with the bar after a group's A, with the end of a group."""
    return remembered_signs.setdefault(n, [f"{i}{end}" for end in ",|;" for i in range(n)])


remembered_signs: dict[int, list[str]] = {}


def tokenizer_pair(a_path: str, b_path: str) -> Pair:
    """The worker's memory of both tokenizers; emptied when full."""
    name = json.dumps([a_path, b_path])
    pair = remembered(name, lambda: Pair(a_path, b_path))
    if len(pair.a.exact) > REMEMBERED:
        forget()
        pair = remembered(name, lambda: Pair(a_path, b_path))
    return pair


def most_pairs(a_path: str, b_path: str) -> int:
    """How many pairs of ids can be linked at all: of two tokens that end together the shorter one is the end of the longer."""
    pair = Pair(a_path, b_path)
    ids: dict[bytes, tuple[int, int]] = {}
    for k, names in enumerate((pair.a.names, pair.b.names)):
        for name in names:
            old = ids.get(name, (0, 0))
            ids[name] = (old[0] + 1, old[1]) if k == 0 else (old[0], old[1] + 1)
    total = 0
    for name, (a, b) in ids.items():
        total += a * b
        for k in range(1, len(name)):
            other = ids.get(name[k:], (0, 0))
            total += a * other[1] + b * other[0]
    return total


def link_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, count, best of all links: how many links hold the pair, and whether no pair of its B id has more."""
    counts = aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts = written(counts, "links")
    b = F.col("pair") % n_b
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    return counts.withColumn("b", b).join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def with_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """aligned (with links, a written table) with n_best and count_sum in place of links: how often its links are the best of their B id, and how often the corpus holds them.

    The counts of pairs are broadcast: there are at most `most_pairs` of them (some 500,000 for vocabularies of 50,000 and
    32,000 ids), however large the corpus is, and a larger table raises ValueError.
    """
    from sentencepiece import SentencePieceProcessor

    counts = link_counts(aligned, SentencePieceProcessor(model_file=b_path).get_piece_size())
    table = counts.limit(most_pairs(a_path, b_path) + 1).toArrow().sort_by("pair")
    known = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(n).to_numpy() for n in ("pair", "count", "best")))
    rest = [f for f in aligned.schema.fields if f.name != "links"]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the words that the worker keeps from aligning
        pairs, many, best = known.value
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                links = part.column("links")
                at = np.searchsorted(pairs, links.flatten().to_numpy())
                ends = np.r_[0, np.cumsum(links.value_lengths().to_numpy())]
                sums = [pa.array(np.diff(np.r_[0, np.cumsum(v[at], dtype=np.int64)][ends])) for v in (best, many)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *sums], names + ["n_best", "count_sum"])

    return aligned.mapInArrow(run, T.StructType([*rest, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]))
