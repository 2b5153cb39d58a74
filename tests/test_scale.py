"""Joins and searches whose work must not grow with the square of their groups."""

import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import drafts, grounding, intake, matching, nearest, rest, screening
from caseloom.plans import entries
from caseloom.plans import rest as more_plans


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def vectors(spark, n, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=dims).tolist()) for i in range(n)], "id long, embedding array<double>")


def test_vector_index_joins_no_rows_and_keeps_recall(spark):
    v = vectors(spark, 3000)
    q = v.where("id % 100 = 0")
    d = rest.approximate(v, q, 10)
    assert "Join" not in plan(d)
    rows = d.collect()
    want = {(r.query_id, r.id) for r in nearest.top_k(v, q, 11, -1.0).collect() if r.query_id != r.id}
    assert len(rows) == 300 and len({(r.query_id, r.id) for r in rows} & want) >= 0.9 * 300
    assert sorted({r["rank"] for r in rows}) == list(range(1, 11))
    assert rest.approximate(v.where("id < 0"), q, 10).count() == 0


def test_top_k_with_many_copies_and_vectors_without_a_direction(spark):
    """Ties go to the smallest ids, task by task; a vector that is not finite has no neighbour and takes none from others."""
    rows = [(i, [1.0, 0.0] if i % 2 else [0.6, 0.8]) for i in range(4000)] + [(4000, [float("nan"), 1.0]), (4001, [float("inf"), 1.0]), (4002, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = nearest.top_k(v, v.where("id in (100, 101, 4000)"), 5, 0.5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(100, i) for i in (0, 2, 4, 6, 8)] + [(101, i) for i in (1, 3, 5, 7, 9)]


def test_best_rows_of_a_task_hold_a_bounded_number(monkeypatch):
    monkeypatch.setattr(nearest, "SLICE", 16)
    best, q = nearest.Best(4, 3, -1.0), np.ones((4, 1))
    for a in range(0, 4096, 256):
        best.meet(np.arange(4), q, np.arange(a, a + 256), np.ones((256, 1)), 0)
        assert best.size <= best.most + 4 * 16
    which, _, ids, *_ = best.fold()
    assert sorted(zip(which.tolist(), ids.tolist(), strict=True)) == [(i, j) for i in range(4) for j in range(3)]


def pairs_met(d):
    """Rows that the joins of a plan made, the largest of them."""
    d.collect()
    most, todo = 0, [d._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return most


def test_items_with_the_same_tokens_meet_once(spark):
    a = spark.createDataFrame([(1, i, f"{'red blue'.split()[i % 2]} bolt the") for i in range(400)] + [(1, 900, None), (1, 901, "the"), (2, 0, "red"), (None, 7, "red")], "case_id long, item long, name string")
    b = spark.createDataFrame([(1, i, f"green {'red anvil'.split()[i % 2]}") for i in range(400)] + [(1, 1000, "Bolt  red RED"), (None, 7, "red")], "case_id long, draft long, name string")
    d = matching.token_pairs(a, b, "item", "draft", ["the"])
    got = {(r.case_id, r.item): r.paired for r in d.collect()}
    red = ",".join(str(i) for i in [*range(0, 400, 2), 1000])
    assert got == {(1, i): red if i % 2 == 0 else "1000" for i in range(400)}
    assert pairs_met(d) < 2000
    o = matching.paired_overlap(a, b.withColumnRenamed("draft", "item"))
    assert {(r.item, r.overlap) for r in o.where("case_id = 1 and item < 2").collect()} == {(0, 1.0), (1, 0.5)}
    assert pairs_met(o) < 2000


def test_a_part_has_few_lists_of_partners(spark):
    """A Parquet column keeps a list once for all its items as long as a part's lists fit its dictionary of 1 MB."""
    a = spark.range(1200).selectExpr("id div 10000 AS case_id", "id AS item", "concat('bolt u', id % 120) AS name")
    b = spark.range(2000).selectExpr("id div 10000 AS case_id", "1000000000L + id AS draft", "if(id < 120, concat('u', id), 'bolt') AS name")
    rows = matching.token_pairs(a, b, "item", "draft", []).select("item", "paired", F.spark_partition_id().alias("part")).collect()
    every = ",".join(str(10**9 + i) for i in range(120, 2000))
    assert {r.item: r.paired for r in rows} == {i: f"{10**9 + i % 120},{every}" for i in range(1200)}
    lists = {}
    for r in rows:
        lists.setdefault(r.part, set()).add(r.paired)
    assert sum(map(len, lists.values())) == 120
    assert max(sum(map(len, x)) for x in lists.values()) <= 1 << 20


def test_nearest_names_take_few_drafts_of_a_set(spark, monkeypatch):
    seen = []
    whole = matching.similar.overlapping
    monkeypatch.setattr(matching.similar, "overlapping", lambda left, right, on, most: seen.append((left.count(), right.count())) or whole(left, right, on, most))
    missed = spark.createDataFrame([(1, i, "old plate" if i % 2 else "plate old") for i in range(50)], "case_id long, item long, name string")
    drafts = spark.createDataFrame([(1, i, "plate ring" if i % 2 else "old plate") for i in range(50)], "case_id long, draft long, draft_name string")
    got = matching.nearest_names(missed, drafts, 3).collect()
    assert sorted((r.item, r["rank"], r.draft, r.overlap) for r in got) == [(i, k, 2 * k - 2, 1.0) for i in range(50) for k in (1, 2, 3)]
    assert seen == [(1, 6)]


def test_gold_items_meet_the_first_draft_of_a_name(spark):
    gold = spark.createDataFrame([(g, "Name", ["other"], ["x"], [3]) for g in range(100)] + [(200, "none", None, None, [5]), (201, None, [None, "b", "name"], [], [])], "gold_id long, name string, aliases array<string>, expected_names array<string>, expected_ids array<long>")
    found = spark.createDataFrame([(i, " name ", 1000 - i) for i in range(1, 100)] + [(5, None, 1), (300, "name", 901)], "draft_id long, name string, seq long")
    d = drafts.gold_matches(gold, found)
    got = {(r.gold_id, r.draft_id, r.tier) for r in d.collect()}
    assert got == {(g, 99, 1) for g in range(100)} | {(200, 5, 4), (201, 99, 2)}
    assert pairs_met(d) < 2000


def test_gold_passages_by_tiers(spark):
    gold = [(1, 10, [11], 1, "red bolt"), (1, 12, [], 1, "red bolt"), (2, 99, [11, 13], 1, "red bolt"), (3, 98, [97], 1, "red bolt"), (3, 98, None, 2, "new anvil"), (4, None, [], 3, "x y")]
    passages = [(100, [10, 12, 12], 5, "no"), (101, [12], 5, "no"), (102, [11, 13], 5, "no"), (103, [], 1, "a red one"), (104, None, 2, "the anvil, new"), (105, [None], 2, "other")]
    g = spark.createDataFrame(gold, "gold_id long, market_id long, alias_ids array<long>, page int, name string")
    p = spark.createDataFrame(passages, "passage long, supports array<long>, page int, quote string")
    got = sorted((r.gold_id, r.passage, r.tier) for r in intake.gold_passages(g, p).collect())
    assert got == [(1, 100, 1), (1, 101, 1), (2, 102, 2), (3, 103, 3), (3, 104, 3)]


def test_gold_passages_do_not_seek_later_tiers_of_what_is_found(spark):
    g = spark.createDataFrame([(i, 1, [2], 1, "red bolt") for i in range(60)], "gold_id long, market_id long, alias_ids array<long>, page int, name string")
    p = spark.createDataFrame([(0, [1], 9, "no")] + [(i, [2], 1, "red bolt") for i in range(1, 60)], "passage long, supports array<long>, page int, quote string")
    d = intake.gold_passages(g, p)
    assert sorted((r.gold_id, r.passage, r.tier) for r in d.collect()) == [(i, 0, 1) for i in range(60)]
    assert pairs_met(d) <= 60


def test_renames_meet_one_draft_of_a_kind(spark, tmp_path):
    spark.range(4000).selectExpr("id AS p_partkey", "1 AS p_size", "'t' AS p_type").write.parquet(str(tmp_path / "part.parquet"))
    d = more_plans.QUERIES["j18_gated_renames"](spark, str(tmp_path))
    assert d.count() == 2000 and pairs_met(d) <= 2000 * 50


def test_only_texts_beyond_ascii_go_through_python_in_small_batches(spark):
    rows = [("Ünïté ﬁn",), ("ABC", ), ("",), (None,), ("Ⅻ é",), ("a\u0000B",)]
    d = spark.createDataFrame(rows, "c string")
    d = d.select("c", T.folded(F.col("c")).alias("f"), T.composed(F.col("c")).alias("n"))
    assert "ArrowEvalPython" not in plan(d)
    for r in d.collect():
        assert r.f == (None if r.c is None else unicodedata.normalize("NFKD", r.c).encode("ascii", "ignore").decode().lower())
        assert r.n == (None if r.c is None else unicodedata.normalize("NFKC", r.c))


def test_section_texts_take_lines_of_documents_as_text(spark, tmp_path):
    lines = "56.187.231.175 Keit in lich\n8.1 Other words \n9.9 Zu te \u0085\n7.2 More"
    spark.createDataFrame([(299, lines)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = entries.QUERIES["w07_section_texts"](spark, str(tmp_path)).collect()
    a, b, c, d = lines.split("\n")
    assert sorted((r.chunk, r.page_number, r.part, r.text) for r in rows) == [(0, 1, "own", f"7.1 Own part\n{a}"), (0, 2, "own", b), (0, 3, "own", c), (0, 4, "spill", "before"), (1, 4, "own", f"7.1 Own part\n{d}")]


def test_texts_with_one_rare_token_of_a_quote_are_not_looked_through(spark):
    words = [f"w{i:02d}" for i in range(20)]
    texts = [(i, f"{words[i % 20]} other words") for i in range(200)] + [(500, "a " + " ".join(words[:18]) + " b"), (501, "x" + " ".join(words) + "y")]
    q = spark.createDataFrame([(1, " ".join(words)), (2, "w00 w01")], "item_id long, quote string")
    near = sorted((r.item_id, r.doc_id) for r in grounding.likely(q, spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert [x for x in near if x[0] == 1] == [(1, 500), (1, 501)] and (2, 500) in near


def test_signs_that_stay_do_not_go_through_python(spark):
    inert = re.compile(f"[{T.INERT}]")
    stay = [chr(i) for i in range(0x80, 0x3000) if inert.match(chr(i))]
    assert len(stay) > 300 and all(unicodedata.normalize("NFKC", x + y) == x + y for x in stay for y in ("e", "é", x))
    rows = spark.createDataFrame([("ascii",), ("é – “ß”",), ("é",), ("ﬁ",), ("a b",), ("𝐀",), (None,)], "c string").select("c", T.changeable(F.col("c")).alias("x")).collect()
    assert [r.x for r in rows] == [False, False, True, True, True, True, False]


def test_quotes_meet_the_pages_of_short_documents_by_one_join(spark, monkeypatch):
    pages = [(d, n, f"page {n} of the text number {d % 3} says  many words on {n * d}") for d in range(6) for n in range(1, 9 if d == 5 else 4)]
    quotes = [(100 * d + i, d, page, q) for d in range(7) for i, (page, q) in enumerate([(2, "age 2 of the te"), (1, "age 2 of the text number"), (9, "says many"), (1, "on"), (1, "nowhere at all in it"), (1, None), (None, "of the text number 2 says many words")])]
    p = spark.createDataFrame(pages, "doc_id long, page_number int, text string")
    q = spark.createDataFrame([*quotes, (900, None, 1, "of")], "passage_id long, doc_id long, page int, quote string")
    status, flat = {}, [(d, n, " ".join(t.split())) for d, n, t in pages]
    for i, d, page, x in [*quotes, (900, None, 1, "of")]:
        hits = [n for e, n, t in flat if e == d and x is not None and x in t]
        known = any(e == d for e, *_ in flat)
        status[i] = ("no_cache", None) if not known else ("ok", page) if page in hits else ("wrong_page", min(hits)) if hits else ("not_found", None)
    read = lambda: {r.passage_id: (r.status, r.found_page) for r in grounding.grounded(q, p).collect()}
    monkeypatch.setattr(grounding, "NEAR", 4)
    assert read() == status
    monkeypatch.setattr(grounding, "NEAR", 8)
    monkeypatch.setattr(grounding, "_word_runs", None)
    assert read() == status


def test_ranked_results_are_worked_out_once(spark):
    d = spark.createDataFrame([(2, "b", "triggered"), (1, "a", "unclear"), (1, "b", "triggered"), (1, "c", "odd")], "deal_id long, rule_id string, status string")
    seen = spark.sparkContext.accumulator(0)
    slow = F.udf(lambda x: seen.add(1) or x)
    r = screening.ranked(d.withColumn("status", slow("status"))).collect()
    assert [(x.deal_id, x.rule_id, x.place) for x in r] == [(1, "b", 0), (1, "a", 1), (1, "c", 3), (2, "b", 0)] and seen.value == 4


def test_findings_are_dealt_in_parts_before_they_are_grouped(spark, monkeypatch):
    """As many parts as the rows make, and no hash map over a share of the input; rows without a unit or a conclusion count as findings."""
    monkeypatch.setattr(rest, "PART", 100)
    rows = [(i % 150, "OF"[i % 2], None if i % 7 == 0 else i % 5, ("defined", "left_open", "other", None)[i % 4]) for i in range(1000)]
    d = rest.finding_stats(spark.createDataFrame(rows, "case_id long, window string, unit long, conclusion string"))
    assert len(re.findall(r"hashpartitioning\([^)]*, 10\), REPARTITION_BY_NUM", plan(d))) == 2
    assert "hashpartitioning" not in re.sub(r"hashpartitioning\([^)]*, 10\)", "", plan(d))
    want = {}
    for case, window, unit, conclusion in rows:
        w = want.setdefault((case, window), [set(), 0, 0, 0])
        w[0] |= {unit} - {None}
        for i, yes in ((1, True), (2, conclusion == "defined"), (3, conclusion == "left_open")):
            w[i] += yes
    got = {(r.case_id, r.window): [r.units, r.findings, r.defined, r.left_open] for r in d.collect()}
    assert got == {k: [len(w[0]), *w[1:]] for k, w in want.items()}
