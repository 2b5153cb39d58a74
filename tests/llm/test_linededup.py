"""Lines that are similar to several templates, over several tasks."""

import random
from collections import defaultdict

import xxhash

from caseloom.llm import linededup

P = "p1 p2 p3 p4 p5 ".replace("1", "a").replace("2", "b").replace("3", "c").replace("4", "d").replace("5", "e")
A, X, C = P + "a b c d e", P + "x b c y e", P + "x b c y z"


def test_equal_lines_go_together_over_tasks(spark):
    """X is similar to A (8 of 10) and to C (9 of 10), A and C are not (7 of 10)."""
    rows = [(1, f"{A}\n{X}"), (2, f"{C}\n{X}")]
    got = []
    for parts in (spark.sparkContext.parallelize(rows, 2), spark.sparkContext.parallelize(rows, 1)):
        d = spark.createDataFrame(parts, "doc_id long, text string")
        got.append({r.doc_id: r.text for r in linededup.drop_lines(d).collect()})
    assert got[0] == got[1]
    assert got[0][1] == f"{A}\n{X}" and X not in got[0][2]


def test_result_does_not_depend_on_the_split(spark):
    """Many lines of one leaf that are similar in chains."""
    rows = [(i, "\n".join(P + " ".join(f"{'abcdefgh'[(i * k + j) % 8]}" for j in range(10)) for k in range(1, 6))) for i in range(40)]
    got = []
    for n in (1, 3, 4):
        d = spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "doc_id long, text string")
        out = {r.doc_id: (r.dropped, r.text) for r in linededup.drop_lines(d).collect()}
        lines = [line for _, text in out.values() for line in set(text.split("\n")) if line]
        assert len(lines) == len(set(lines))  # no line stays in two documents
        got.append(out)
    assert got[0] == got[1] == got[2]


def test_templates_equal_brute_force(spark):
    """Lines of few words, so that many are similar: greedy templates of each leaf in order of hash, from plain loops."""
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(rng.choice(["a", "b", "c1", "D"]) for _ in range(rng.randint(0, 8))) for _ in range(12))) for i in range(60)]
    key = lambda line: [t if not any(c.isdigit() for c in t) else "<*>" for t in line.lower().split()]
    own = lambda t: (h := xxhash.xxh64_intdigest(" ".join(t).encode())) - (1 << 64 if h >> 63 else 0)
    lines = {own(k): k for _, text in rows for line in text.split("\n") if (k := key(line))}
    leaders, template = defaultdict(list), {}
    for h in sorted(lines):
        k = lines[h]
        leaf = leaders[len(k), tuple(k[:5])]
        near = [(sum(x == y for x, y in zip(lines[m], k, strict=True)), -i, m) for i, m in enumerate(leaf)]
        best = max(near, default=(-1, 0, 0))
        template[h] = best[2] if 5 * best[0] >= 4 * len(k) else h
        if template[h] == h:
            leaf.append(h)
    first = {}
    for i, text in rows:
        for line in text.split("\n"):
            if key(line):
                first.setdefault(template[own(key(line))], i)
    want = {i: "\n".join(x for x in text.split("\n") if not key(x) or first[template[own(key(x))]] == i) for i, text in rows}
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in linededup.drop_lines(d).collect()} == want
    assert len(set(template.values())) < len(template)
