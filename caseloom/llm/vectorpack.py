"""Packing under several capacities at once: vector best-fit over tokens, documents and attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caseloom.llm.packing import lowered, word_ids


def causal_pairs(tokens: np.ndarray | int) -> np.ndarray | int:
    """Attention cost of a piece: the pairs of a token and one not after it."""
    return tokens * (tokens + 1) // 2


def vector_best_fit(demands: np.ndarray, capacity: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, int]:
    """(bin of each item, number of bins): items from large to small, each into the open bin that suits it best.

    demands: items x dimensions, capacity: one number a dimension, all whole. A bin is open to an item that it has room
    for in every dimension. Dimensions are measured in shares of their capacity and weigh by what all items ask of them,
    so that the scarcest leads. rule `norm`: the bin of the smallest weighted norm of what would be left; `dot`: that of
    the largest weighted dot product of its room and the item. Ties go to the oldest bin; an item without an open bin
    opens one. Items go by falling demand in the first dimension, then in the next ones; equal items keep their order.

    Under `norm` a bin that is best for an item stays best for an equal one as long as that fits (what would be left
    only shrinks), so equal items are placed together. An item over a capacity raises ValueError.
    """
    n, width = demands.shape
    if (demands > capacity).any():
        raise ValueError("an item exceeds a capacity")
    where = np.empty(n, np.int64)
    if not n:
        return where, 0
    weight = (demands / capacity).sum(0)
    weight = weight / weight.sum() / capacity.astype(float) ** 2
    order = np.lexsort(tuple(-demands[:, k] for k in range(width - 1, -1, -1)))
    ranked = demands[order]
    begins = np.flatnonzero(np.r_[True, (ranked[1:] != ranked[:-1]).any(1)])
    ends = np.r_[begins[1:], n]
    least = np.minimum.accumulate(ranked[::-1])[::-1]  # the least that this item or a later one asks of each dimension
    room, name, many, bins = np.empty((64, width), np.int64), np.empty(64, np.int64), 0, 0
    for run, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        need = ranked[begin]
        if run % 64 == 63:  # now and then bins that no item fits any more are closed
            useful = (room[:many] >= least[begin]).all(1)
            room[: useful.sum()], name[: useful.sum()] = room[:many][useful], name[:many][useful]
            many = int(useful.sum())
        while begin < end:
            left = room[:many] - need
            fits = (left >= 0).all(1)
            score = (left * left) @ weight if rule == "norm" else -(room[:many] * need) @ weight
            score[~fits] = np.inf
            k = int(score.argmin()) if many else -1
            if k < 0 or not fits[k]:
                if many == len(room):
                    room, name = np.resize(room, (2 * many, width)), np.resize(name, 2 * many)
                k, many = many, many + 1
                room[k], name[k], bins = capacity, bins, bins + 1
            asked = need > 0
            copies = min(end - begin, int((room[k][asked] // need[asked]).min())) if rule == "norm" and asked.any() else 1
            where[order[begin : begin + copies]] = name[k]
            room[k] -= copies * need
            begin += copies
    return where, bins


def pack_vectors(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    most_documents: int | None = None,
    most_cost: int | None = None,
    end_id: int = 0,
    rule: str = "norm",
    group_ids: int = 1 << 22,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds ids.

    A document's ids are those of its text, then end_id. One of more than `window` ids is cut into pieces of `window`;
    the last may be shorter; any other stays whole. A sequence holds at most `window` ids, `most_documents` pieces
    and an attention cost (`causal_pairs`, summed over its pieces) of `most_cost`; the defaults, `window` and the cost of
    one full window, bind no sequence that keeps to the first bound. Sequences are not padded. Packing runs inside each
    partition over groups of about group_ids ids, which bound a task's memory; it needs no shuffle. The tokenizer must
    drop white space (its file lies at tokenizer_path on every executor).

    Null and empty texts: the end id alone. Null doc_ids and repeated rows: documents like any other. Empty input: no
    rows. Columns beside doc_id and text are not read. most_cost under the cost of a full window raises ValueError, as
    a full piece would fit nowhere.
    """
    capacity = np.array([window, most_documents or window, most_cost or causal_pairs(window)])
    if capacity[2] < causal_pairs(window) or capacity[1] < 1:
        raise ValueError("a full piece must fit an empty sequence")
    fields = [docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 32
        held, keys, total, kind = [], [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            sizes = np.array([len(x) for x in held])
            pieces = -(-sizes // window)
            doc = np.repeat(np.arange(len(held)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * window
            length = np.minimum(sizes[doc] - start, window)
            bins, many = vector_best_fit(np.stack([length, np.ones_like(length), causal_pairs(length)], 1), capacity, rule)
            row = np.argsort(bins, kind="stable")
            doc, piece, start, length, bins = doc[row], piece[row], start[row], length[row], bins[row]
            upto = np.cumsum(length)
            first = np.r_[True, bins[1:] != bins[:-1]]
            offset = upto - length - np.maximum.accumulate(np.where(first, upto - length, 0))
            ids = [held[d][s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            crc = [zlib.crc32(x.astype("<u4", copy=False).tobytes()) for x in ids]
            columns = [pa.array(keys, kind).take(pa.array(doc)), *map(pa.array, (piece, start, length)), pa.array(crc, pa.int64()), pa.array(bins + next_id), pa.array(offset)]
            next_id += many
            return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

        for batch in batches:
            kind = batch.column(0).type
            known = word_ids(tokenizer_path)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = known.gather(known.numbers(lowered(text.as_py() or "")), end_id)
                held.append(ids)
                keys.append(key)
                total += len(ids)
                if total >= group_ids:
                    yield flush()
                    held, keys, total = [], [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
