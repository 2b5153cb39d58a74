"""The operators against brute force, round trips and edge cases on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm import archive, chat, linededup, mixing, nearcopies, packing, sharding, simhash, toxicity, vectors
from caseloom.llm.shared import components, fresh_path, with_offsets

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators add or use inside.
CLASHES = ["size", "target", "finish", "h", "fingerprint", "dropped", "n_lines", "score", "shard", "root", "_h", "k"]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))


def odd_docs(spark):
    rng = random.Random(5)
    long = prose(rng, 9000)
    rows = [(1, long, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "no id here", "en", "a", 3), (4, " \t\n ", "en", "a", 3)]
    rows += [(5, "same text of two rows", "en", "b", 1)] * 2 + [(6, "same text of two rows", "fr", None, 1), (7, "é ü\x0bñ <|endoftext|> İΣς", "es", "b", 1)]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


OPERATORS = {
    "pack": lambda s, d: packing.pack(d, WORDS),
    "shard": lambda s, d: sharding.shard(d),
    "near": lambda s, d: simhash.near_duplicates(d),
    "keep": lambda s, d: nearcopies.keep_one(d),
    "score": lambda s, d: toxicity.score(d, s.createDataFrame([(1, 0, 1), (5, 0, 0), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")),
    "clean": lambda s, d: toxicity.keep_clean(d, s.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")),
    "queue": lambda s, d: mixing.queued(d),
    "shares": lambda s, d: mixing.shares(d),
    "mix": lambda s, d: mixing.mix(d),
    "lines": lambda s, d: linededup.drop_lines(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    plain = OPERATORS[name](spark, odd_docs(spark)).collect()
    more = OPERATORS[name](spark, with_clashes(odd_docs(spark))).collect()
    assert len(plain) == len(more) > 0
    if name in ("shard", "near", "score", "queue", "shares", "lines"):
        assert len(plain) == 9


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, odd_docs(spark).limit(0)).collect() == []


# ------------------------------------------------------------------ shared


def test_offsets_equal_a_running_sum(spark):
    d = spark.range(500).selectExpr("id % 3 AS g", "id % 7 AS b", "id", "id % 5 AS w")
    got = with_offsets(d, ["g"], "b", F.col("w"), [F.col("id")], "upto").collect()
    run, want = defaultdict(int), {}
    for r in sorted(d.collect(), key=lambda r: (r.g, r.b, r.id)):
        run[r.g] += r.w
        want[r.id] = run[r.g]
    assert {r.id: r.upto for r in got} == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got}


# ------------------------------------------------------------------ 1 packing


def test_ids_are_the_tokenizers(spark):
    rng = random.Random(3)
    parts = list("abZ éÉßñİΣς \t\n\x0b\x1c\x85'.,!-<|>_/09½二㍿ﬁǅ̈*%$") + ["'s", "don't ", "<|endoftext|>", "<|ENDOFTEXT|>", "the ", "THE"]
    t, known = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert known.gather(known.numbers(packing.lowered(s)), 2).tolist() == t.encode(s, add_special_tokens=False).ids + [2]


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(4)
    lengths = [rng.randint(1, 64) for _ in range(300)]
    free, want = [], {}
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        fits = [w for w in range(len(free)) if free[w] >= lengths[i]]
        if fits:
            least = min(free[w] for w in fits)
            free[next(w for w in fits if free[w] == least)] -= lengths[i]
        else:
            free.append(64 - lengths[i])
    got = packing.best_fit(lengths, 64)
    assert sorted(64 - sum(lengths[i] for i in w) for w in got) == sorted(free)
    assert sorted(i for w in got for i in w) == list(range(300)) and want == {}


def test_packing_round_trip(spark):
    d = odd_docs(spark)
    rows = packing.pack(d, WORDS, window=256, group_ids=4000, loose=16, with_ids=True).collect()
    t, by_sequence, total = Tokenizer.from_file(WORDS), defaultdict(list), Counter()
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        total[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    spare = 0
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
        n = sum(r.length for r in s)
        assert n <= 256
        spare += 0 if n & (n - 1) == 0 else 256 - n
    assert spare <= 0.05 * sum(total.values())
    for r in d.where("doc_id in (1, 7)").collect():
        ids = [x for p in sorted((p for p in rows if p.doc_id == r.doc_id), key=lambda p: p.start) for x in p.ids]
        assert ids == t.encode(r.text, add_special_tokens=False).ids + [2]


# ------------------------------------------------------------------ 2 sharding


def sharded(spark, rows, parts=4):
    """Rows of the operator, its laws checked, and the texts that are cut."""
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    sizes = Counter(r.shard for r in got)
    held = [sizes[s] for s in range(8)]
    assert len(got) == len(rows) and max(held) - min(held) <= 1 and set(sizes) <= set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    text = dict(rows)
    places = defaultdict(set)
    for r in got:
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        places[text[r.doc_id]].add(r.shard)
    return {r.doc_id: r.shard for r in got}, {t for t, p in places.items() if len(p) > 1}


def need_cuts(sizes, shards=8):
    """A lower bound of groups to cut, by what whole groups of one size leave of each shard."""
    total = sum(sizes)
    linked = Counter(n for n in sizes if n > 1)
    (n, many), = linked.most_common(1)
    return max(0, many - sum((total // shards + (s < total % shards)) // n for s in range(shards)))


@pytest.mark.parametrize("hot", [0, 200, 500])
def test_shards_are_even_and_keep_copies_together(spark, hot):
    rows = [(i, f"own {i}") for i in range(400)] + [(1000 + i, f"twin {i // 3}") for i in range(150)] + [(5000 + i, "hot") for i in range(hot)]
    place, cut = sharded(spark, rows)
    assert cut <= {"hot"}
    if hot:  # larger than a shard: in as few shards as can be, but for one
        assert len({s for i, s in place.items() if i >= 5000}) <= -(-hot // (len(rows) // 8)) + 1
    assert sharded(spark, rows, 1)[0] == place  # whatever the split


def test_no_more_groups_are_cut_than_must_be(spark):
    fours = [(i, f"four {i // 4}") for i in range(6000)]
    assert len(sharded(spark, fours)[1]) == need_cuts([4] * 1500) == 4
    big = [(i, f"big {i // 300}") for i in range(4800)] + [(10_000 + i, f"own {i}") for i in range(1200)]
    assert sharded(spark, big)[1] == set() and need_cuts([300] * 16 + [1] * 1200) == 0
    rng, mixed = random.Random(12), []
    for g in range(120):
        mixed += [(len(mixed) + i, f"mixed {g}") for i in range(rng.randint(2, 60))]
    assert len(sharded(spark, mixed)[1]) < 8


# ------------------------------------------------------------------ 3 near copies


def test_fingerprint_by_hand(spark):
    text = "The quick brown\tFox jumps over\x0bthe lazy dog"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    d = spark.createDataFrame([(1, text), (2, "One  Two"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in simhash.with_fingerprint(d).collect()}
    assert got == {1: want, 2: xxhash.xxh64_intdigest("one two", 42), 3: 0}


def test_golay_keys_share_for_every_close_pair():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(400):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    import pandas as pd

    ka, kb = (simhash.golay_keys(pd.Series(x.view(np.int64))) for x in (a, b))
    assert all(set(x) & set(y) for x, y in zip(ka, kb, strict=True))
    assert np.mean([len(x) for x in ka]) < 100


def test_groups_equal_brute_force_also_in_a_dense_cluster(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = set(rng.integers(0, 1 << 63, 300, dtype=np.uint64).tolist())
    for c in centre:
        for _ in range(250):
            x = int(c)
            for bit in rng.choice(63, rng.integers(1, 8), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    root = {x: x for x in prints}
    find = lambda x: x if root[x] == x else find(root[x])
    v = np.array(prints, np.uint64)
    for i, x in enumerate(prints):
        for j in np.nonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 4)[0]:
            a, b = sorted((find(x), find(prints[i + 1 + int(j)])))
            root[b] = a
    got = {r.fingerprint: r.root for r in simhash.near_groups(spark.createDataFrame([(x,) for x in prints], "fingerprint long")).collect()}
    assert got == {x: find(x) for x in prints}


def test_keep_one_keeps_the_smallest_id(spark):
    d = spark.createDataFrame([(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z q w r")], "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.keep_one(d).collect()) == [1, 2]


# ------------------------------------------------------------------ 4 and 6 vectors


def vector_table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16) * (1 + i % 5)]) for i in range(700)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # many equal vectors: ties
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [None] + [1.0] * 15), (2200, [1.0] * 3), (None, rows[3][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows


def usable(rows, zero):
    out = [(i, np.array(v + [0.0] * (16 - len(v)), np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and (zero or any(v))]
    return [(-(1 << 63) if i is None else i, v) for i, v in out]


def brute(rows, score, k=5):
    ids, best = np.array([i for i, _ in rows]), {}
    m = np.stack([v for _, v in rows])
    for n, (i, v) in enumerate(rows):
        if i % 50 == 0 and i >= 0:
            s = score(v, m).astype(float)
            s[n] = -np.inf
            at = np.lexsort((ids, -s))[:k]
            best[i] = [(int(ids[j]), s[j]) for j in at]
    return best


def test_products_are_exact(spark):
    d, rows = vector_table(spark)
    got = defaultdict(list)
    d = d.select("*", *[F.lit("x").alias(c) for c in ("v", "row", "query", "norm", "bucket", "chunk", "score", "rank")])
    for r in sorted(vectors.top_products(d, bucket=64, block=4).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((-(1 << 63) if r.vec_id is None else r.vec_id, r.score))
    ints = [(i, np.floor(256 * v)) for i, v in usable(rows, True)]
    assert got == brute(ints, lambda v, m: m @ v)


def test_pruning_keeps_all_that_reach_the_threshold():
    rng = np.random.default_rng(9)
    v = rng.integers(-300, 300, (400, 8)) * rng.integers(1, 3, (400, 1))
    nv = np.sqrt((v.astype(float) ** 2).sum(1))
    v, nv = v[np.argsort(-nv)], np.sort(nv)[::-1]
    for _ in range(200):
        q = v[rng.integers(400)] + rng.integers(-30, 30, 8)
        s = v @ q
        theta = float(np.sort(s)[-rng.integers(1, 20)])
        at = vectors.candidates(q, float(np.linalg.norm(q)), theta, v, nv)
        assert set(np.nonzero(s >= theta)[0]) <= set(at.tolist())


def test_nearest_has_recall_and_exact_scores(spark):
    d, rows = vector_table(spark)
    got = defaultdict(list)
    d = d.select("*", *[F.lit("x").alias(c) for c in ("v", "row", "query", "leaf", "branch", "score", "rank")])
    for r in sorted(vectors.nearest(d, leaf_rows=64, chunk=50).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((-(1 << 63) if r.vec_id is None else r.vec_id, r.score))
    use = usable(rows, False)
    want = brute(use, lambda v, m: m @ v / (np.linalg.norm(m, axis=1) * np.linalg.norm(v)))
    by_id = {i: v for i, v in use}
    hit = sum(len({x for x, _ in got[q]} & {x for x, _ in w}) for q, w in want.items())
    assert set(got) == set(want) and hit >= 0.9 * 5 * len(want)
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        for i, s in found:
            a, b = by_id[q], by_id[i]
            assert s == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)


@pytest.mark.parametrize("f", [vectors.nearest, vectors.top_products])
def test_vectors_empty_and_few(spark, f):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in f(few).collect()] == [(0, 1, 1)]
    assert f(few.limit(0)).collect() == []


# ------------------------------------------------------------------ 5 toxicity


def toxic_table(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = prose(rng, 60).split()
        if bad:
            for w in rng.sample(["grumblax", "snorfle", "wizzock", "blarghu"], 3):
                words.insert(rng.randrange(60), w + rng.choice(["", ".", "ish", "!!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    make = spark.createDataFrame
    return make(rows, "doc_id long, text string"), make(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = toxic_table(spark)
    rows = toxicity.score(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.terms and r.neighbours for r in held if r.predicted)


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = toxic_table(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def _unit(v):
    norm = sum(x * x for x in v.values()) ** 0.5
    return {t: x / norm for t, x in v.items()}


@pytest.mark.parametrize("heavy", [0.05, 0.5])
def test_index_is_exact(heavy):
    rng = np.random.default_rng(1)
    vs = [_unit({int(t): float(x) for t, x in zip(rng.choice(30, 4, replace=False), rng.random(4), strict=True)}) for _ in range(700)]
    sparse = lambda v: (np.array(list(v), np.int32), np.array(list(v.values()), float))
    index = toxicity.Index([sparse(v) for v in vs], 30, block=16, heavy=heavy)
    got = index.nearest([sparse(v) for v in [*vs[:60], {}]], 10, but=[*range(60), -1])
    assert got[60] == []
    for i, q in enumerate(vs[:60]):
        want = sorted(((round(sum(x * v.get(t, 0) for t, x in q.items()), 9), -j) for j, v in enumerate(vs) if j != i), reverse=True)[:10]
        assert [round(c, 9) for c, _ in got[i]] == [c for c, _ in want if c]
        assert all(c == pytest.approx(sum(x * vs[e].get(t, 0) for t, x in q.items())) for c, e in got[i])


def test_scores_equal_brute_force(spark):
    """Whole scores from plain loops: document frequencies, cosines with every example, votes, steps."""
    docs, labels, truth = toxic_table(spark)
    docs = docs.union(spark.createDataFrame([(5000, "nothing in common"), (5001, None), (5002, "grumblax")], docs.schema))
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    number, telling = model.vocabulary.number, set(model.vocabulary.telling)
    learn = [i for i in truth if zlib.crc32(str(i).encode()) % 4 != 2]
    assert set(model.ids) == set(learn) and telling
    assert set(number) == {w for i in learn for w in toxicity.words(texts[i])} | telling

    def counts(text):
        own = toxicity.counts_of(toxicity.words(text))
        plain = Counter(toxicity.words(text))
        return {t: own[t] for t in own if t in telling} | {t: n for t, n in plain.items() if t in number}

    every = {i: counts(t) for i, t in texts.items()}
    df = Counter(t for c in every.values() for t in c)
    weight = {t: np.log((len(texts) + 1) / (df[t] + 1)) * (6 if t in telling else 1) for t in number}
    vec = {i: {t: (1 + np.log(n)) * weight[t] for t, n in c.items() if weight[t] > 0} for i, c in every.items()}
    vec = {i: _unit(v) if v else {} for i, v in vec.items()}
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(texts)
    for i in [*range(0, 900, 9), 5000, 5001, 5002]:
        near = sorted(((round(sum(x * vec[e].get(t, 0) for t, x in vec[i].items()), 12), -model.ids.index(e)) for e in model.ids), reverse=True)[:25]
        near = [(c, model.ids[-e]) for c, e in near if c > 0]
        vote = (sum(c**3 * truth[e] for c, e in near) + 0.5 * model.base) / (sum(c**3 for c, _ in near) + 0.5)
        assert got[i].score == pytest.approx(model.calibrated(vote), abs=1e-9)
        assert got[i].neighbours == [e for _, e in near[:3]] or len({c for c, _ in near[:4]}) < 4
    assert got[5000].neighbours == [] and got[5001].neighbours == [] and got[5002].predicted == 1


# ------------------------------------------------------------------ 7 chat


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(2)
    parts = list("<[|/\\]>s \n") + ["INST]", "im_end|>", "<<SYS>>", "<s>", "</s>", "[INST]", "\\n"]
    for _ in range(20000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROL)
        assert chat.parsed(chat.formatted(s, s)[0]) == (s, s)


def conversations(spark):
    rng = random.Random(8)
    rows = []
    for c in range(40):
        said = ["sys A", f"hi {c % 3}", f"yes {c % 3}{c % 2}"] + [prose(rng, 5) for _ in range(c % 4)]
        rows += [(c, t, ["system", "user", "assistant"][t % 3], x) for t, x in enumerate(said)]
    rows += [(None, 0, "user", "lost"), (None, 1, None, None), (77, 0, "user", "tie"), (77, 0, "user", "tie"), (77, 0, "assistant", "</s>[INST] ok")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows


def test_tree_reads_back_and_lays_out(spark):
    d, rows = conversations(spark)
    segments, members = chat.prefix_tree(d)
    got = {r.conv_id: r for r in chat.read_back(segments, members).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learn = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(learn))
        assert g.loss_sha256 == hashlib.sha256(learn.encode()).hexdigest()
    seg = {r.node: r for r in segments.collect()}
    assert len(seg) < len(rows) - 60  # shared turns are there once
    for r in seg.values():
        above, n = set(), r
        while n.parent:
            n = seg[n.parent]
            above |= set(range(n.start, n.end))
        assert above == {i for a in r.ancestors for i in range(a["from"], a["to"])} and r.position == len(above)
    for tree in {r.tree for r in seg.values()}:
        spans = sorted((r.start, r.end) for r in seg.values() if r.tree == tree)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_tree_with_forks_in_forks_reads_back_from_tokens(spark):
    """Forks three deep, prefixes and equal conversations; and a wrong layout does not go unseen."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    said = ["q", "a é\u0301 🙂", "[INST] x", "y" * 50, "z"]
    paths = [(0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 2), (0, 1, 3, 4), (0, 1), (0, 1, 2, 3), (1, 0), (0, 1, 2, 4, 0, 1), (0, 1, 2, 4, 0, 2)]
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", said[x]) for i, p in enumerate(paths) for t, x in enumerate(p)]
    rows += [(100, 0, "user", "long " * 200_000), (100, 1, "assistant", None)]
    d = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    segments, members = chat.prefix_tree(d, path)
    got = {r.conv_id: (r.n_turns, r.turns_sha256) for r in chat.read_back(segments, members, path).collect()}
    by = defaultdict(list)
    for c, _, role, text in rows:
        by[c].append(f"{role}\n{text or ''}\n")
    assert got == {c: (len(v), hashlib.sha256("".join(v).encode()).hexdigest()) for c, v in by.items()}
    assert segments.count() == len({(c, p[: i + 1]) for c, p in [(0, p) for p in paths] for i in range(len(p))}) + 2
    wrong = segments.withColumn("position", F.col("position") + F.when(F.col("depth") == 1, 1).otherwise(0))
    with pytest.raises(Exception, match="position"):
        chat.read_back(wrong, members, path).collect()


def test_chat_empty(spark):
    d, _ = conversations(spark)
    segments, members = chat.prefix_tree(d.limit(0))
    assert segments.count() == 0 and chat.read_back(segments, members).count() == 0


# ------------------------------------------------------------------ 8 archive


def test_archive_round_trip(spark):
    big = "<p>" + "é" * 900
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big)]
    made = archive.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), fresh_path(spark, "warc"))
    got = {r.page_id: r for r in archive.digest_table(spark, made).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        b = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 9) if len(b) >= 1000 and i != 9 else ("response", None))
    assert spark.read.parquet(made.payloads).count() == 3
    whole = archive.record_bytes(archive.read_archive(spark, made)).collect()
    assert all(bytes(r.record).startswith(b"WARC/1.1\r\n") and r.intact for r in whole)
    assert sum(bytes(r.record).count(big.encode()) for r in whole) == 1
    many = [(7, "u", big)] * 3 + [(8, "u", "x" * 3_000_000), (6, "u", "a\r\n\r\nContent-Length: 1\r\n\r\nb")]
    more = archive.write_archive(with_clashes(spark.createDataFrame(many, "page_id long, url string, html string")), fresh_path(spark, "warc"))
    again = archive.digest_table(spark, more).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in again) == sorted((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "response", None) for i, _, h in many)
    spoiled = spark.read.parquet(more.payloads).withColumn("payload", F.concat("payload", F.encode(F.lit("x"), "UTF-8")))
    spoiled.write.parquet(bad := fresh_path(spark, "warc"))
    with pytest.raises(Exception, match="damaged"):
        archive.digest_table(spark, archive.Archive(more.headers, bad)).collect()
    empty = archive.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), fresh_path(spark, "warc"))
    assert archive.digest_table(spark, empty).count() == 0


# ------------------------------------------------------------------ 9 mixing


def test_mix_nears_its_targets(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", rng.choice(["a", "b", "b", "b", "c", None]), 0) for i in range(1500)]
    q = mixing.queued(spark.createDataFrame(rows, DOCS)).collect()
    size, cap, weight = Counter(), {}, dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    for r in q:
        size[r.source] += r.size
        assert r.size == len(r.text.split()) and r.taken in (0, r.size, 2 * r.size)
    budget, open_, target = 1.5 * sum(size.values()), set(size), {}
    while open_:
        left = budget - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else share
        open_ = open_ - full if full else set()
    taken = Counter()
    for r in q:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * 60 for s in size) and cap == {}
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 30
    run = sorted((f + i * r.source_size / r.target, r.source or "~", i, r.size, i < r.times) for r in q for i, f in ((0, r.finish), (1, r.finish)))
    assert [x[4] for x in run] == sorted((x[4] for x in run), reverse=True)  # one cut through one stream
    again = mixing.queued(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in q)
    stream = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert [r.finish for r in stream] == sorted(r.finish for r in stream)
    assert Counter(r.doc_id for r in stream) == Counter({r.doc_id: r.times for r in q if r.times})


# ------------------------------------------------------------------ 10 lines


def test_lines_that_recur_go_but_from_the_first(spark):
    rng = random.Random(10)
    passage = prose(rng, 60)
    varied = "Page 12 of 300 was printed on 2024-01-05 by hand"
    near = passage.split()
    near[30] = "changed"
    own = [prose(rng, 30) for _ in range(6)]
    rows = [(i, f"{own[i]}\n{passage if i < 4 else own[0][::-1]}\nshort line {'abcdef'[i]}") for i in range(6)]
    rows += [(10, f"{varied}\nalone one two three four"), (11, varied.replace("12", "99") + "\nrepeat in one doc only\nrepeat in one doc only"), (12, " ".join(near))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in linededup.drop_lines(d).collect()}
    assert got[0].dropped == [] and got[0].text == rows[0][1]
    assert all(got[i].dropped == [1] and passage not in got[i].text and own[i] in got[i].text for i in (1, 2, 3))
    assert got[4].dropped == [] or got[4].dropped == [1]
    assert got[10].dropped == [] and got[11].dropped == [0] and got[11].text.count("repeat in one doc only") == 2
    assert got[12].text == ""


def test_lines_equal_brute_force_when_templates_are_exact(spark):
    rng = random.Random(11)
    pool = [prose(rng, rng.randint(3, 12)) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(6))) for i in range(80)]
    got = {r.doc_id: r.text for r in linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), similar=1.0).collect()}
    first = {}
    for i, t in rows:
        for line in t.split("\n"):
            first.setdefault(line, i)
    want = {i: "\n".join(x for x in t.split("\n") if first[x] == i) for i, t in rows}
    assert got == want
