"""Number words, shares, tolerance, the full-text index and the stateful streams on literal rows."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from caseloom.functions import text as T
from caseloom.operators import catalog
from caseloom.streaming.ingest import ingest, latest_states


def values(spark, f, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in d.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_numbers_in_words(spark):
    texts = [
        "Seven billion and six hundred million", "восемьсот миллионов рублей", "δύο δισεκατομμύρια ή επτά χιλιάδες", "two parties, three years", "", None, "million", "one hundred twenty-three thousand",
        "two million five thousand", "hundred thousand", "zwei Milliarden, two Milliarden, dos", "five milhões", "сто двадцать пять тысяч", "NINE TRILLION", "twenty-one million twenty-one million", "εκατό πενήντα εκατομμύρια",
    ]
    want = [[7e9, 6e8], [8e8], [2e9, 7e3], [], [], [], [], [123e3], [2000005000.0], [1e5], [2e9], [5e6], [125e3], [9e12], [21000021e6], [150e6]]
    assert values(spark, T.spelled_values, texts) == want


def test_shares(spark):
    texts = ["25 % or 33,5 percent", "at least 0.25 of it", "0,5 %", "Three-quarters, one third; two thirds", "one half", "10.5", "1.0 and 100.25", None, "20 τοις εκατο"]
    got = [None if v is None else [round(x, 6) for x in v] for v in values(spark, T.shares, texts)]
    assert got == [[25.0, 33.5], [25.0], [0.5, 50.0], [75.0, 33.333333, 66.666667], [50.0], [], [], None, [20.0]]


def test_any_mention_may_be_the_expected(spark):
    rows = [([1.0, 100.0], 101.0), ([1.0, 100.0], 105.0), ([0.01], 0.0), ([0.5], 0.0), ([], 5.0), ([4.5], 5.0)]
    d = spark.createDataFrame(rows, "v array<double>, e double")
    assert [r.x for r in d.select(T.any_within("v", F.col("e")).alias("x")).collect()] == [True, False, True, False, False, True]
    assert [r.x for r in d.select(T.any_within("v", F.col("e"), floor=0.0).alias("x")).collect()][-1] is False


@pytest.mark.parametrize("block", [4096, 3])
def test_index_gives_the_best_of_all(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(catalog, "BLOCK", block)
    rng = random.Random(block)
    texts = {i: " ".join(rng.choices("alpha beta gamma delta eps Zeta, éta".split(), weights=[9, 5, 2, 1, 9, 1, 1], k=rng.randint(0, 30))) for i in range(80)} | {200: None, 201: ""}
    path = str(tmp_path / "index")
    catalog.full_text_index(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path)
    words = {i: [w for w in (t or "").lower().replace(",", "").split() if w] for i, t in texts.items()}
    n, mean = len(texts), sum(map(len, (w for i, w in words.items() if texts[i] is not None))) / sum(t is not None for t in texts.values())
    for query, k in (("delta", 5), ("Zeta delta  gamma", 7), ("éta alpha", 100), ("none", 3), ("", 3)):
        score = {}
        for t in set(query.lower().split()):
            df = sum(t in w for w in words.values())
            for i, w in words.items():
                if t in w:
                    tf = w.count(t)
                    score[i] = score.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        found = catalog.searched_index(spark, path, query, k)
        got = [(r.doc_id, round(r.score, 9)) for r in sorted(found.collect(), key=lambda r: (-r.score, r.doc_id))]
        want = sorted(((i, round(s, 9)) for i, s in score.items()), key=lambda x: (-x[1], x[0]))[:k]
        assert got == want, query
        assert {f.split("/index/")[1].split("/")[0] for f in found.inputFiles()} <= {"postings", "blocks"}


def test_index_holds_runs_and_reads_the_texts_once(spark, tmp_path):
    """A term's documents of a block are one row where they were read together, and a text's words go through no shuffle."""
    path, reads = str(tmp_path / "index"), spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: reads.add(1) or t)
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), seen(F.concat(F.lit("alpha beta alpha "), F.col("id").cast("string"))).alias("text"))
    catalog.full_text_index(docs, path)
    assert reads.value == 300
    p = spark.read.parquet(f"{path}/postings")
    assert sorted(tuple(r) for r in p.where("term in ('alpha', 'beta', '7', '')").select("term", "block", "df", "most", "least").collect()) == [("", 0, 300, 0, 4), ("7", 0, 1, 1, 4), ("alpha", 0, 300, 2, 4), ("beta", 0, 300, 1, 4)]
    found = catalog.searched_index(spark, path, "alpha")
    assert re.search(r"PartitionFilters: \[[^\]]*folder#\d+ = \d+\)", found._jdf.queryExecution().executedPlan().toString())
    assert [r.doc_id for r in found.collect()] == list(range(20))


def test_runs_of_slices_are_those_of_the_whole(monkeypatch):
    rng = random.Random(5)
    ids = [*rng.sample(range(-50, 60), 40), None, 7, 7]
    words = [None if i % 9 == 8 else rng.choices("a b c d e".split(), k=rng.randint(0, 6)) for i in range(len(ids))]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "words": pa.array(words, pa.list_(pa.string()))})
    want = sorted((w, i or 0, (x or []).count(w), None if x is None else len(x)) for i, x in zip(ids, words, strict=True) for w in {"", *(x or [])})
    for most in (1 << 21, 10, 1):
        monkeypatch.setattr(catalog, "WORDS", most)
        runs = [r for b in catalog._runs(batch, 4) for r in b.to_pylist()]
        got = sorted(((r["term"], i or 0, tf, n) for r in runs for i, tf, n in zip(r["doc_id"], r["tf"], r["n"], strict=True)), key=str)
        assert got == sorted(want, key=str)
        assert all({(i or 0) // 4 for i in r["doc_id"]} == {r["block"]} for r in runs)
    assert len(runs) > 5 and list(catalog._runs(batch.slice(0, 0), 4)) == []


def test_ingest_knows_keys_without_reading_the_target(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = StructType([StructField("key", LongType()), StructField("v", StringType())])
    make = lambda rows, to: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(to)
    make([(7, "before"), (8, None)], target)
    make([(7, "again"), (1, "b"), (1, "a"), (None, "n")], source)
    assert ingest(spark, source, schema, target, "key", mark) == 4
    make([(8, "again"), (1, "again"), (None, "m"), (9, "new")], source)
    assert ingest(spark, source, schema, target, "key", mark) == 5
    assert ingest(spark, source, schema, target, "key", mark) == 5
    rows = sorted(((r.key is None, r.key or 0, r.v) for r in spark.read.schema(schema).parquet(target).collect()), key=str)
    assert rows == sorted([(False, 7, "before"), (False, 8, None), (False, 1, "a"), (False, 9, "new"), (True, 0, "n")], key=str)


def test_latest_states_are_kept_by_the_stream(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = StructType([StructField("key", LongType()), StructField("at", LongType()), StructField("tie", LongType()), StructField("status", StringType())])
    make = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: {r.key: r.status for r in latest_states(spark, source, schema, target, "key", "at", "tie", mark).collect()}
    make([(1, 5, 0, "begun"), (1, 5, 1, "done"), (2, 1, 0, "begun")])
    assert run() == {1: "done", 2: "begun"}
    make([(1, 4, 9, "late"), (2, 2, 0, "failed"), (3, 1, 0, "begun")])
    assert run() == {1: "done", 2: "failed", 3: "begun"}
    assert run() == {1: "done", 2: "failed", 3: "begun"}
