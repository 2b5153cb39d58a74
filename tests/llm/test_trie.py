"""The prefix trie against a plain one: forks, bands, blocks, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from caseloom.llm import queries, trie

TURNS = "conv_id long, turn int, role string, text string"


def sequences(rows):
    """conv_id -> its turns (role, text) in order."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in out.items()}


def plain_trie(convs):
    """Set of the rows that `prefix_trie` returns, by whole prefixes."""
    members, size = defaultdict(list), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            size[tuple(turns[:d])] = len(turns[d - 1][1].encode()) if d else 0
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[k] for k in kids[p]]
        ends = sorted(c for c in members[p] if len(convs[c]) == len(p))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        above = min(members[p[:-1]]) if p else None
        out[p] = (min(members[p]), len(p), above, len(members[p]), len(kids[p]), sum(b[5] for b in below) or 1, (len(members[p]) - 1) * size[p] + sum(b[6] for b in below), sha)
    return sorted(out.values(), key=str)


def made_of(spark, rows):
    turns = spark.createDataFrame(rows, TURNS)
    return sorted(map(tuple, trie.prefix_trie(trie.ordered(turns), turns.select("conv_id")).collect()), key=str)


def test_forks_over_several_bands(spark, monkeypatch):
    monkeypatch.setattr(trie, "BAND", 2)
    monkeypatch.setattr(trie, "BLOCK", 4)
    rng = random.Random(7)
    rows = []
    for c in range(-20, 40):
        depth = rng.choice([1, 2, 3, 5, 9, 18])
        stem = rng.choice(["", "x"])
        fork = rng.randint(0, depth)
        rows += [(c, t, "user" if t % 2 else "assistant", f"{stem}{t}" if t < fork else f"{t} of {rng.randint(0, 1)}") for t in range(depth)]
    rows += [(100, t, "user", "x0" if t == 0 else "é" * (t % 5)) for t in range(33)] + [(101, t, "user", "x0" if t == 0 else "é" * (t % 5)) for t in range(20)]
    rng.shuffle(rows)
    assert made_of(spark, rows) == plain_trie(sequences(rows))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "", ""), (2, 5, "user", "a"), (None, 0, "user", "lost"), (3, 1, "us", "era"), (4, 1, "user", "a"), (4, 2, "a", "")]
    assert made_of(spark, rows) == plain_trie(sequences(rows))
    assert made_of(spark, rows[6:7]) == []
    copies = [(c, t, "user", "same") for c in range(9000) for t in range(2)]
    assert made_of(spark, copies) == plain_trie(sequences(copies))


def test_conversations_without_turns(spark):
    turns = spark.createDataFrame([], TURNS)
    convs = spark.createDataFrame([(5,), (3,), (None,), (5,)], "conv_id long")
    assert [tuple(r) for r in trie.prefix_trie(trie.ordered(turns), convs).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_rebuilt_conversations(spark):
    rng = random.Random(2)
    rows = [(c, t, "user", f"{c} {t}") for c in range(-12, 60) if rng.random() < 0.7 for t in range(rng.randint(1, 12))]
    given = sequences(rows)
    want = {}
    for c, own in given.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        want[c] = given.get(base, [])[:h] + own[h:]
    got = queries.rebuilt(trie.ordered(spark.createDataFrame(rows, TURNS)))
    depths = defaultdict(list)
    for r in got.collect():
        depths[r["conv_id"]].append((r["depth"], r["size"]))
    for c, turns in want.items():
        assert sorted(depths[c]) == [(d + 1, len(t[1])) for d, t in enumerate(turns)]


@pytest.mark.parametrize("deepest", [1, 8, 9, 64, 65])
def test_depths_about_a_band(spark, deepest):
    rows = [(1, t, "user", "a") for t in range(deepest)] + [(2, t, "user", "a" if t < deepest // 2 else "b") for t in range(deepest)]
    assert made_of(spark, rows) == plain_trie(sequences(rows))
