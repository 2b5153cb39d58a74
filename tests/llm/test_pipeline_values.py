"""From planted documents to pieces: what each stage keeps, drops and makes, value by value."""

import random
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from caseloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOUL = "vile scum filth wretch vermin loathsome maggot cretin".split()


def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = {i: "\n".join(line(rng.randint(8, 20)) for _ in range(6)) for i in range(60)}
    toxic = {}
    for i in range(100, 160):
        words = line(20).split()
        for _ in range(8):
            words.insert(rng.randrange(len(words)), rng.choice(FOUL))
        toxic[i] = " ".join(words)
    shared = line(12)
    for i in (3, 7, 9):
        texts[i] += "\n" + shared
    words = texts[20].split(" ")
    texts[200] = " ".join([*words[:-1], "changed"])  # a near copy of 20
    texts[201] = texts[21] + " and more"
    texts |= {202: None, 203: ""}
    return texts, toxic, shared


def grams(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def groups(texts):
    """Smallest doc_id of each group of near copies, by all pairs."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in texts.items():
        for j, b in texts.items():
            x, y = grams(a), grams(b)
            if i < j and (x == y or len(x & y) >= 0.8 * len(x | y)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {find(i) for i in texts}


def test_stages_value_by_value(spark, tmp_path):
    texts, toxic, shared = planted()
    sources = ["web", "books", None]
    rows = [(i, t, "en", sources[i % 3], len(t or "")) for i, t in (texts | toxic).items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i in toxic)) for i in [*range(40), *range(100, 145)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = lambda k, d: P.written(P.STAGES[k][1](spark, d, str(tmp_path)), "stage")

    clean = stage(0, docs)
    assert {r.doc_id for r in clean.collect()} == set(texts)

    lined = {r.doc_id: r for r in stage(1, clean).collect()}
    assert set(lined) == set(texts)
    for i, r in lined.items():
        want = "\n".join(x for x in (texts[i] or "").split("\n") if x != shared or i == 3)
        if i < 200:
            assert (r.text or "") == want, i
        else:  # lines of a near copy that its original has go too: what stays are lines of its own
            assert set((r.text or "").split("\n")) <= {"", *(texts[i] or "").split("\n")}, i
        assert r.text is None or r.n_chars == len(r.text)

    given = {i: r.text for i, r in lined.items()}
    one = stage(2, spark.createDataFrame(list(lined.values()), SCHEMA))
    kept = {r.doc_id for r in one.collect()}
    assert kept == groups(given)

    want = {r.doc_id: r.taken // r.size for r in mixing.shares(one).where("size > 0").collect()}
    mixed = stage(3, one)
    rows = Counter(r.doc_id for r in mixed.collect() if (given[r.doc_id] or "").split())  # what has no words costs the mix nothing
    assert rows == {i: n for i, n in want.items() if n} and set(want.values()) <= {0, 1, 2}

    tokenizer, made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for r in P.STAGES[4][1](spark, mixed, str(tmp_path)).collect():
        made[r.doc_id].append((r.start, r.length))
    for i, n in want.items():
        size = len(tokenizer.encode(given[i] or "", add_special_tokens=False).ids) + 1
        places = Counter(p for start, length in made[i] for p in range(start, start + length))
        assert places == (dict.fromkeys(range(size), n) if n else {})
