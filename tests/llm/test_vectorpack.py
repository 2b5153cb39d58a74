"""Vector best-fit against the plain rule, and its pieces against the tokenizer."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caseloom.llm import vectorpack
from tests.llm.test_operators import CLASHES, odd_docs, with_clashes

WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_rule(demands, capacity, rule):
    """One item at a time over all bins ever opened."""
    share = (demands / capacity).sum(0)
    weight = share / share.sum() / capacity.astype(float) ** 2
    rooms, where = [], {}
    for i in sorted(range(len(demands)), key=lambda i: (*(-demands[i]).tolist(), i)):
        best = None
        for k, room in enumerate(rooms):
            if (room >= demands[i]).all():
                score = float((room - demands[i]) ** 2 @ weight) if rule == "norm" else -float((room * demands[i]) @ weight)
                if best is None or score < best[0]:
                    best = (score, k)
        if best is None:
            rooms.append(capacity.copy())
            best = (0, len(rooms) - 1)
        rooms[best[1]] = rooms[best[1]] - demands[i]
        where[i] = best[1]
    return [where[i] for i in range(len(demands))], len(rooms)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(100, 100, 5050), (100, 3, 5050), (100, 100, 5050 // 4 + 3000)])
def test_bins_are_those_of_the_plain_rule(rule, capacity):
    rng = np.random.default_rng(3)
    tokens = np.r_[rng.integers(1, 78, 150), np.full(40, 17), np.full(300, 1)]
    rng.shuffle(tokens)
    demands = np.stack([tokens, np.ones_like(tokens), vectorpack.causal_pairs(tokens)], 1)
    got, bins = vectorpack.vector_best_fit(demands, np.array(capacity), rule)
    want, many = plain_rule(demands, np.array(capacity), rule)
    assert bins == many and got.tolist() == want
    for k in range(3):
        assert np.bincount(got, demands[:, k]).max() <= capacity[k]


def test_no_items_and_too_large_ones():
    assert vectorpack.vector_best_fit(np.zeros((0, 3), np.int64), np.array([4, 4, 10]))[1] == 0
    with pytest.raises(ValueError):
        vectorpack.vector_best_fit(np.array([[5, 1, 15]]), np.array([4, 4, 10]))


def pieces_are_right(rows, texts, window, many=None):
    """Every id in one piece, crcs of the tokenizer's ids, sequences gapless and within bounds."""
    tokenizer = Tokenizer.from_file(WORDS)
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for key, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted(docs[key], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // window)))
        for r in mine:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["start"] == window * r["piece"] and r["length"] == len(part) == min(window, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and len(rs) <= (many or window)


def test_pieces_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = vectorpack.pack_vectors(docs, WORDS).collect()
    pieces_are_right(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 2048)
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + docs.rdd.getNumPartitions()


def test_odd_rows_small_groups_and_binding_bounds(spark):
    docs = odd_docs(spark).where("doc_id is null or doc_id <> 5").coalesce(1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for extra in ({}, {"group_ids": 10}, {"most_documents": 2}, {"most_cost": vectorpack.causal_pairs(64), "rule": "dot"}):
        rows = vectorpack.pack_vectors(with_clashes(docs).drop(*CLASHES[:1]), WORDS, window=64, **extra).collect()
        pieces_are_right(rows, texts, 64, extra.get("most_documents"))
    twice = vectorpack.pack_vectors(odd_docs(spark).where("doc_id = 5"), WORDS).collect()
    assert len(twice) == 2 and twice[0]["ids_crc32"] == twice[1]["ids_crc32"]
    assert vectorpack.pack_vectors(docs.limit(0), WORDS).count() == 0
    with pytest.raises(ValueError):
        vectorpack.pack_vectors(docs, WORDS, most_cost=5)


def test_ids_are_those_of_the_pieces(spark):
    rows = vectorpack.pack_vectors(odd_docs(spark), WORDS, window=32, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
