"""Near copies of the pipeline against brute force over all pairs."""

from itertools import combinations

import numpy as np

import corpus_pipeline as P
from caseloom.llm import nearcopies


def _runs(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(rows):
    sets = {i: _runs(t) for i, t in rows}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if (not x and not y) or (x and y and 5 * len(x & y) >= 4 * len(x | y)):
            lo, hi = sorted((root[a], root[b]))
            root = {i: lo if r == hi else r for i, r in root.items()}
    return sorted(set(root.values()))


def test_near_copies_by_jaccard(spark):
    rng = np.random.default_rng(5)
    rows, n = [(9000, ""), (9001, None), (9002, "Two words"), (9003, "two  words")], 0
    common = " ".join(f"c{i}" for i in range(20))
    for _ in range(25):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(30, 250)))]
        for changes in (0, 0, 1, 2, 3, 5, 8):
            copy = list(words)
            for at in rng.integers(0, len(copy), changes):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((n, " ".join(copy) + (" " + common if n % 3 else "")))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute(rows)
    assert 30 < len(want) < len(rows)
    assert sorted(r.doc_id for r in P.near_copy_stage(spark, docs, "").select("doc_id").collect()) == want


def test_chain_and_frequent_shingles(spark):
    """A large group of near copies, each with a change of its own, and a passage that all documents share."""
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"z{i}"] + base[i + 1 :])) for i in range(150)]
    rows += [(1000 + i, " ".join(base[:40] + [f"d{i}_{j}" for j in range(60)])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).select("doc_id").collect()) == _brute(rows)
