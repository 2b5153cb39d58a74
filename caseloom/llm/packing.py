"""Packing documents into windows: best-fit decreasing with a segment tree over remaining capacity."""

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caseloom.llm.shared import forget, remembered

#: Word forms that a worker remembers at most; beyond that it starts anew.
REMEMBERED = 600_000

#: ASCII signs that may end a word; the tokenizer makes a piece of its own of a run of them.
ENDINGS = b'.,!?;:*%&$#"()[]{}-_+=/@^~'


class WordIds(dict):
    """Word in UTF-8 -> its number; ids of word k are flat[first[k]:first[k + 1]].

    The tokenizers meant here lower the case, drop white space, cut at it and between letters and signs, and map bytes to
    signs: a text's ids are those of its words in a row.
    A plain word goes to the tokenizer's own model; any other passes through its whole pipeline.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.flat, self.first = array("i"), array("q", [0])
        self.level = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: bytes) -> int:
        self.flat.extend(self.ids_of(word))
        self[word] = k = len(self.first) - 1
        self.first.append(len(self.flat))
        return k

    def ids_of(self, word: bytes) -> list[int] | array:
        text = word.decode("utf-8", "replace")
        stem = word.rstrip(ENDINGS)
        if stem and plain(text[: len(text) - (len(word) - len(stem))]):
            if len(stem) < len(word):  # the stem and the signs at its end are words of their own
                return self.known(stem) + self.known(word[len(stem) :])
            level = text if text.isascii() else self.level.pre_tokenize_str(text)[0][0]
            return [t.id for t in self.tokenizer.model.tokenize(level)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def known(self, word: bytes) -> array:
        k = self[word]
        return self.flat[self.first[k] : self.first[k + 1]]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def gather(self, numbers: np.ndarray, end_id: int) -> np.ndarray:
        """The ids of the words in a row, then end_id."""
        flat, first = np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), np.frombuffer(self.first, np.int64)
        begin = first[numbers]
        many = first[numbers + 1] - begin
        upto = np.cumsum(many)
        n = int(upto[-1]) if len(upto) else 0
        out = np.empty(n + 1, np.int32)
        out[:n] = flat[np.repeat(begin - (upto - many), many) + np.arange(n)]
        out[n] = end_id
        return out


def plain(s: str) -> bool:
    """Letters only, lower case and in normal form already, from the blocks that every Unicode version agrees on."""
    return s.isalpha() and (s.isascii() or max(s) < "ɐ" and unicodedata.is_normalized("NFC", s)) and s == s.lower()


def lowered(text: str) -> list[bytes]:
    """Words of the text, ASCII letters in lower case but where a special token could begin."""
    b = text.encode("utf-8", "replace")
    if b"<|" not in b:
        return b.lower().split()
    return [w if b"<|" in w else w.lower() for w in b.split()]


class Capacities:
    """Open windows by remaining capacity: a segment tree tells the least capacity of some window that is large enough."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, which: int) -> None:
        self.open[capacity].append(which)
        k = self.size + capacity
        while k and not self.some[k]:
            self.some[k] = 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int]:
        """(capacity, window) of the tightest window with room for need, which leaves the tree; (-1, -1) if none has."""
        k = self.size + need
        while not self.some[k]:
            while k & 1:  # a right child: no larger capacity under its parent
                k >>= 1
            if not k:
                return -1, -1
            k += 1
        while k < self.size:
            k = 2 * k if self.some[2 * k] else 2 * k + 1
        capacity = k - self.size
        which = self.open[capacity].pop()
        if not self.open[capacity]:
            while k and not (k < self.size and (self.some[2 * k] or self.some[2 * k + 1])):
                self.some[k] = 0
                k >>= 1
        return capacity, which


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Windows as lists of piece numbers: pieces from long to short, each into the tightest open window."""
    tree, windows = Capacities(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        capacity, w = tree.take(lengths[i])
        if w < 0:
            capacity, w = window, len(windows)
            windows.append([])
        windows[w].append(i)
        if capacity > lengths[i]:
            tree.put(capacity - lengths[i], w)
    return windows


def halves(length: int) -> list[int]:
    """The powers of two that add up to length, from large to small."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def laid_out(docs: list[np.ndarray], window: int, loose: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length). A document over a window is cut into full windows and a rest first.

    A window with more than `loose` ids to spare at the end is cut into sequences of powers of two, which need no padding.
    """
    rests = []
    for d, ids in enumerate(docs):
        n = len(ids)
        for start in range(0, n - n % window, window):
            yield [(d, start, window)]
        if n % window:
            rests.append((d, n - n % window, n % window))
    for pieces in best_fit([r[2] for r in rests], window):
        row = [rests[i] for i in pieces]
        fill = sum(r[2] for r in row)
        if window - fill <= loose:
            yield row
            continue
        for size in halves(fill):
            part = []
            while size:
                d, start, n = row.pop(0)
                k = min(n, size)
                part.append((d, start, k))
                size -= k
                if k < n:
                    row.insert(0, (d, start + k, n - k))
            yield part


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, group_ids: int = 1 << 22, loose: int = 256, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text, then end_id. with_ids adds ids array<int>. Packing runs inside each
    partition, over groups of about group_ids ids (the bound of a task's memory: a document is never held twice),
    so it needs no shuffle; a group leaves less than one window loose, and that is cut into powers of two. The
    tokenizer must drop white space (its file lies at tokenizer_path on every executor).

    Null and empty texts: the end id alone. Null doc_ids and repeated rows: documents like any other. Empty
    input: no rows. Columns beside doc_id and text are not read.
    """
    fields = [docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 32
        held, keys, total, kind = [], [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            out = [[] for _ in names]
            for pieces in laid_out(held, window, loose):
                at = 0
                for d, start, n in pieces:
                    ids = held[d][start : start + n]
                    values = [keys[d], start, n, zlib.crc32(ids.astype("<u4").tobytes()), len(held[d]), next_id, at, ids]
                    for column, value in zip(out, values, strict=False):
                        column.append(value)
                    at += n
                next_id += 1
            types = [kind] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

        for batch in batches:
            kind = batch.column(0).type
            known = word_ids(tokenizer_path)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers = known.numbers(lowered(text.as_py() or ""))
                ids = known.gather(numbers, end_id)
                held.append(ids)
                keys.append(key)
                total += len(ids)
                if total >= group_ids:
                    yield flush()
                    held, keys, total = [], [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def word_ids(path: str) -> WordIds:
    """The worker's memory of words for one tokenizer; emptied when full."""
    known = remembered(path, lambda: WordIds(path))
    if len(known) > REMEMBERED:
        forget()
        known = remembered(path, lambda: WordIds(path))
    return known
