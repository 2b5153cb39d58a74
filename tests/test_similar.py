"""Similarity joins and the merge by components against plain loops over all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from caseloom.operators import matching, similar
from caseloom.sources.scratch import smallest_reachable

WORDS = "supply market of for the wearable os platform search engine advertising app store pc desktop laptop smartphone smartwatch ad-tech national eea worldwide licensable wrist-worn concrete cement ready mix fish".split()


def names(rng, n):
    """Names of a few words, and slips of earlier ones."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            s = list(rng.choice(out))
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(s) + 1)
                s[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "s", " ", "é"])
            out.append("".join(s))
        else:
            out.append(" ".join(rng.choices(WORDS, k=rng.randint(1, 6))))
    return out


def test_bounds_hold_and_lose_no_pair(spark):
    rng = random.Random(1)
    many = [*names(rng, 120), "", "a1b2c3", "a4b5c6", "x" * 300, "x" * 65 + "y", "🙂 é", "ab" * 32, "字" * 64]
    block = similar.Names(many)
    for a in many:
        for least in (0.0, 0.45, 0.75):
            bounds = block.bounds(a, least)
            assert all(u >= SequenceMatcher(None, a, b).ratio() for u, b in zip(bounds, many, strict=True))
    assert similar.Names([]).bounds("a", 0.5).tolist() == []
    d = spark.createDataFrame([(1, n) for n in set(many)] + [(2, "a"), (None, "a"), (None, "ab")], "g int, name string")
    got = {(r.a, r.b): r.ratio for r in similar.similar_pairs(d.where("g = 1"), ["g"], 0.75).collect()}
    want = {(a, b): r for a in set(many) for b in set(many) if a != b and (r := SequenceMatcher(None, a, b).ratio()) >= 0.75}
    assert got == want and len(want) > 20


def plain_reconciled(spark, existing, drafts):
    """All pairs of a case and kind by the column expressions, then the walk from the best draft down."""
    e, d = spark.createDataFrame(existing, "case_id long, kind string, item long, name string"), spark.createDataFrame(drafts, "case_id long, kind string, draft long, draft_name string")
    p = e.join(d, ["case_id", "kind"]).withColumn("s", matching.contextual(F.col("name"), F.col("draft_name"), F.col("kind")))
    p = p.withColumn("o", matching.shared_words(F.col("name"), F.col("draft_name"), matching.GEO_STOP)).collect()
    out = {}
    for c, k, item, _ in existing:
        mine = sorted((-r.s, r.draft, r.o) for r in p if (r.case_id, r.kind, r.item) == (c, k, item))
        out[item] = (None, "unmatched")
        if mine and -mine[0][0] >= 0.75:
            out[item] = (mine[0][1], "matched")
        elif mine and -mine[0][0] >= 0.45:
            walk = [m for m in mine if -m[0] >= 0.45 and (k != "geographic" or m[2] >= 0.30)]
            if walk:
                out[item] = (walk[0][1], "renamed")
    return e, d, out


@pytest.mark.parametrize("block", [1024, 7])
def test_reconciliation_equals_the_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(block)
    existing, drafts = [], []
    for kind in ("product", "geographic", "theory"):
        ns = names(rng, 60)
        existing += [(1, kind, len(existing) + k, n) for k, n in enumerate(ns[:30])]
        drafts += [(1, kind, len(drafts) + k, n) for k, n in enumerate(ns[30:] + ns[:4])]
    existing += [(1, "theory", 900, "abcdefgh"), (1, "theory", 901, "abcdefgh"), (1, "product", 902, None), (2, "theory", 903, "alone"), (3, "theory", 904, "aaaa"), (4, "theory", 905, "a" * 11 + "b" * 9), (5, "theory", 906, "")]
    drafts += [(1, "theory", 900, "abcdefxy"), (1, "theory", 901, "abcdefzz"), (3, "theory", 902, "aaabb"), (4, "theory", 903, "c" * 11 + "b" * 9), (5, "theory", 904, "")]
    e, d, want = plain_reconciled(spark, existing, drafts)
    got = matching.reconciled(e, d).collect()
    assert len(got) == len(existing)
    assert {r.item: (r.draft, r.result) for r in got} == want
    assert {r for _, r in want.values()} == {"matched", "renamed", "unmatched"}
    assert want[900] == want[901] == (900, "matched") and want[905] == (903, "renamed")
    left = {r.draft for r in matching.additions(d, matching.reconciled(e, d)).collect() if r.kind == "theory" and r.case_id == 1}
    assert left == {x[2] for x in drafts if x[:2] == (1, "theory")} - {want[i[2]][0] for i in existing if i[:2] == (1, "theory")}


def test_threshold_cases(spark):
    """Ratios of exactly 0.75 and 0.45 count, one letter less does not; a place needs context, devices cut a product."""
    e = [(1, "t", 1, "abcd"), (1, "u", 2, "abcdefghi" + "j" * 11), (1, "v", 3, "abcdefgh" + "j" * 12), (1, "geographic", 4, "EEA xyzw"), (1, "product", 5, "OSs for PCs")]
    d = [(1, "t", 1, "abce"), (1, "u", 2, "abcdefghi" + "k" * 11), (1, "v", 3, "abcdefgh" + "k" * 12), (1, "geographic", 4, "EEA abcd"), (1, "product", 5, "OSs for smartphones")]
    existing, drafts, want = plain_reconciled(spark, e, d)
    got = {r.item: (r.draft, r.result) for r in matching.reconciled(existing, drafts).collect()}
    assert got == want
    assert [got[k] for k in (1, 2, 3)] == [(1, "matched"), (2, "renamed"), (None, "unmatched")] and got[4][1] == "unmatched"


def plain_merge(items, threshold=0.75):
    """Items in order against all slots; items: (item, name, rank, status, notes, quotes), place or not."""

    def run(rows, place):
        slots, gone = [], {}
        for item, name, rank, status, notes, quotes in sorted(rows):
            near = [(SequenceMatcher(None, name.lower().strip(), s[1].lower().strip()).ratio(), -k) for k, s in enumerate(slots)]
            r, k = max(near, default=(0, 0))
            if near and r >= threshold:
                gone[item], old, new = -k, slots[-k], [item, name, rank, status, notes, quotes]
                win, lose = (new, old) if rank > old[2] else (old, new)
                if place:
                    if lose[4].strip() and lose[4].strip() not in win[4]:
                        win = [*win[:4], win[4].rstrip() + (" | " if win[4].strip() else "") + lose[4].strip(), win[5]]
                    win = [*win[:5], win[5] + [q for q in lose[5] if q[:60] not in {w[:60] for w in win[5]}]]
                slots[-k] = win
            else:
                gone[item] = len(slots)
                slots.append([item, name, rank, status, notes, quotes])
        return {i: slots[k][0] for i, k in gone.items()}, {s[0]: tuple(s[3:]) for s in slots}

    return run(items, False), run(items, True)


def test_merge_by_components_equals_the_plain_loop(spark):
    rng = random.Random(4)
    rows = []
    for item, name in enumerate(names(rng, 150)):
        status = rng.choice(list(matching.STRENGTH))
        notes, quotes = rng.choice(["", " a note ", "note", "another"]), ["q" * 70 + str(rng.randint(0, 3)), f"quote {rng.randint(0, 9)}"]
        rows.append((item, name, rng.randint(0, 3), status, notes, quotes))
    given = [(1, kind, *r) for kind in ("product", "geographic") for r in rows]
    d = spark.createDataFrame(given, "case_id long, kind string, item long, name string, valid int, status string, notes string, quotes array<string>")
    (plain, _), _ = plain_merge(rows)
    _, (places, merged) = plain_merge([(r[0], r[1], matching.STRENGTH[r[3]], *r[3:]) for r in rows])
    got = {(r.kind, r.item): r.kept for r in matching.greedy_merged(d).collect()}
    assert got == {("product", k): v for k, v in plain.items()} | {("geographic", k): v for k, v in places.items()}
    assert len(set(plain.values())) < len(plain)
    kept = {r.item: (r.status, r.notes, r.quotes) for r in matching.merged_items(d).where("kind = 'geographic'").collect()}
    assert kept == merged


def test_nearest_names_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 5)
    rng = random.Random(9)
    e = [(1, k, n) for k, n in enumerate(names(rng, 30))] + [(2, 99, "none")]
    d = [(1, k, n) for k, n in enumerate(names(rng, 40))]
    got = matching.nearest_names(spark.createDataFrame(e, "case_id long, item long, name string"), spark.createDataFrame(d, "case_id long, draft long, draft_name string"))
    tokens = lambda s: {t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split() if len(t) > 1}
    want = []
    for c, i, n in e:
        x = tokens(n)
        scored = sorted((-len(x & tokens(m)) / len(x | tokens(m)), j) for cc, j, m in d if cc == c and x & tokens(m))
        want += [(c, i, j, r, round(-o, 6)) for r, (o, j) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_tables(spark):
    e, d = spark.createDataFrame([], "case_id long, kind string, item long, name string"), spark.createDataFrame([(1, "m", 1, "a")], "case_id long, kind string, draft long, draft_name string")
    assert matching.reconciled(e, d).count() == 0
    assert [r.draft for r in matching.additions(d, matching.reconciled(e, d)).collect()] == [1]
    assert matching.greedy_merged(e.withColumn("valid", F.lit(0))).count() == 0
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 90), (90, 95), (200, 200)]
    got = dict(smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(61)} | {100: 90, 90: 90, 95: 90, 200: 200}
