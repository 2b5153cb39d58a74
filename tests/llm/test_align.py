"""Alignment of two tokenizers against sets of token ends."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from caseloom.llm import align
from caseloom.llm.shared import written
from tests.llm.test_operators import with_clashes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a  b ", "a\n\n b\tc", "x▁y", "<|endoftext|> hi </s> <0x41>", "日本語 テキスト 🙂 ok", "é²³½ 12 a_b __ 's 't don't", "\x00a", "a b  c", "a   b\n  c \n", "\n", "é" * 3000]
ODD += ["some words " * 900, "\x1ca\x85b", " ", "\t  \t", "ab\r\n\r\n  cd", "İΣς ﬁ ①"]


@pytest.fixture(scope="module")
def plain():
    """text -> (ids and ends of A, ids and ends of B), or None where there are no tokens; by the tokenizers' own calls on the whole text."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    signs = {c: k for k, c in enumerate(align.byte_signs())}

    def tokens(text):
        if not text:
            return None
        sides, given = [], (" " + text).encode()
        for names in ([(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, align.piece_bytes(b.id_to_piece(i))) for i in b.encode(text)]):
            if b"".join(n for _, n in names) != given:
                return None
            at, ends = 0, []
            for _, n in names:
                at += len(n)
                ends.append(at)
            sides.append(([i for i, _ in names], ends))
        return sides

    return tokens


def expected(plain, texts):
    """key -> (n_a, n_b, n_groups, n_links, sha, groups, links)."""
    out = {}
    for key, text in texts:
        sides = plain(text)
        if not sides:
            out[key] = (0, 0, 0, 0, "", [], [])
            continue
        (a, ends_a), (b, ends_b) = sides
        both, groups, links, i, j = sorted(set(ends_a) & set(ends_b)), [], [], 0, 0
        for end in both:
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((end, a[i:x], b[j:y]))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        sha = hashlib.sha256(";".join(f"{','.join(map(str, g[1]))}|{','.join(map(str, g[2]))}" for g in groups).encode()).hexdigest()
        out[key] = (len(a), len(b), len(groups), len(links), sha, groups, links)
    return out


def fuzz(n):
    rng = random.Random(5)
    parts = ["a", "b", "The", "ing", " ", "  ", "\n", "\t", " ", "é", "1", "23", "_", ".", "!?", "'s", " x", "ö", "-", "▁", "字"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(n)]


def test_groups_links_and_counts(spark, plain, sf):
    texts = ODD + fuzz(400) + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows = [(None if k == 3 else k, t) for k, t in enumerate(texts)]
    want = expected(plain, rows)
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in align.align(docs, A, B, tuple(align.OUTPUTS)).collect()}
    assert len(got) == len(rows)
    pieces = SentencePieceProcessor(model_file=B).get_piece_size()
    for key, w in want.items():
        r = got[key]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == w[:5]
        assert [(g["end"], g["a"], g["b"]) for g in r["groups"]] == w[5]
        assert [divmod(x, pieces) for x in r["links"]] == w[6]
    counts = Counter(x for w in want.values() for x in w[6])
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    aligned = written(align.align(docs, A, B, ("n_a", "links")), "aligned")
    for r in align.with_counts(aligned, A, B).collect():
        links = want[r["doc_id"]][6]
        assert r["n_best"] == sum(counts[x] == top[x[1]] for x in links) and r["count_sum"] == sum(counts[x] for x in links)
    assert len(counts) <= align.most_pairs(A, B)


def test_small_lanes_and_batches(spark, plain, monkeypatch):
    monkeypatch.setattr(align, "LANE_BYTES", 7)
    pair = align.Pair(A, B)
    texts = [t for t in ODD + fuzz(300) if t]
    want = expected(plain, enumerate(texts))
    n_a, sha = align._aligned(pair, texts, ("n_a", "groups_sha256"))
    assert [(n, s) for n, s in zip(n_a.to_pylist(), sha.to_pylist(), strict=True)] == [(w[0], w[4]) for w in want.values()]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(docs, A, B).count() == 0
    none = written(align.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B, ("n_a", "links")), "aligned")
    assert sorted(map(tuple, align.with_counts(none, A, B).collect())) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert align.with_counts(written(align.align(docs, A, B, ("links",)), "aligned"), A, B).count() == 0
