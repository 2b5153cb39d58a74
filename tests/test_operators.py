"""Semantics of the operators on literal rows."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from caseloom.functions import text as T
from caseloom.operators import catalog, drafts, grounding, intake, matching, nearest, screening, sections
from caseloom.plans import screening as plans
from caseloom.sources import tables
from caseloom.streaming.ingest import ingest


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,value",
    [("1,234.50", 1234.5), ("1.234,50", 1234.5), ("2023 350", None), ("1.234", 1234.0), ("1.5", 1.5), ("2,75", 2.75), ("12", 12.0), ("1 000 000", 1e6), ("1,23,4", None), ("1'000", 1000.0), ("abc", None), ("", None)],
)
def test_numbers(spark, text, value):
    assert one(spark, T.number(F.col("c")), c=text) == value


@pytest.mark.parametrize(
    "text,values",
    [("EUR 2.5 million and $3,000", [2.5e6, 3000.0]), ("150 days", []), ("over 250 million", [250e6]), ("EUR 5 bn", [5e9]), ("", [])],
)
def test_amounts(spark, text, values):
    assert one(spark, T.amounts(F.col("c"), "EUR"), c=text) == values


@pytest.mark.parametrize(
    "a,b,same",
    [("End-customers", "end customers", True), ("Mix — DE", "Mix — Germany", True), ("IT", "Italy", False), ("a / b", "a b", True), ("x — DE", "x — FR", False), (" A ", "a", True)],
)
def test_trivial_equivalence(spark, a, b, same):
    assert one(spark, T.trivially_equal(F.col("a"), F.col("b")), a=a, b=b) is same


def test_html_and_fold(spark):
    html = "<p>a&nbsp;<b>B</b>\n c</p><script>var t='</p>';</script> ‘d’"
    assert one(spark, T.html_text(F.col("c")), c=html) == "a&nbsp; B c 'd'"
    assert one(spark, T.folded(F.col("c")), c="Ünïté ﬁn") == "unite fin"


def test_fragments_in_order(spark):
    text = "the quick brown fox jumps over the lazy dog while the sun sets behind the distant blue hills of home"
    cut = text[:40] + " (sic) " + text[40:80]
    swapped = text[50:] + " xx " + text[:50]
    for quote, want in ((text[5:60], True), (cut, True), ("nothing of this is anywhere in the text at all, truly", False), ("short", False), (swapped, None)):
        got = one(spark, grounding.by_fragments(F.col("q"), F.col("t")), q=quote, t=text)
        if want is not None:
            assert got is want, quote


def test_dense_quotes_equal_a_window_scan(spark):
    rng = random.Random(4)
    vocabulary = ["aa", "bb", "cc", "dd", "ee", "ff", "gg"]
    rows = []
    for i in range(300):
        q = [rng.choice(vocabulary) for _ in range(rng.randint(1, 6))]
        t = [rng.choice(vocabulary + ["zz"] * 6) for _ in range(rng.randint(1, 25))]
        rows.append((i, " ".join(q), " ".join(t)))

    def brute(q, t):
        if q in t:
            return True
        qt, tt = q.split(), t.split()
        if len(tt) < len(qt):
            return False
        w = len(qt) + len(qt) // 2
        spans = [tt] if len(tt) <= w else [tt[i : i + w] for i in range(len(tt) - w + 1)]
        return any(len(set(qt) & set(s)) / len(set(qt)) >= 0.85 for s in spans)

    got = {r.pair_id: r.found for r in grounding.dense(spark.createDataFrame(rows, "pair_id long, quote string, text string")).collect()}
    assert got == {i: brute(q, t) for i, q, t in rows}


def test_heading_stack(spark):
    lines = ["1. Intro", "plain", "1.1 Scope", "1.1.1 Detail", "more", "2. Next", "2.1 Part", "text"]
    d = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(lines)] + [(2, 1, "none")], "doc_id long, page_number int, text string")
    got = {(r.doc_id, r.page_number): r.path for r in sections.heading_paths(d).collect()}
    assert got[1, 2] == "1 Intro" and got[1, 5] == "1 Intro > 1.1 Scope > 1.1.1 Detail" and got[1, 8] == "2 Next > 2.1 Part" and got[2, 1] == ""


def test_mode_goes_to_the_first_seen(spark):
    d = spark.createDataFrame([(1, 1, 10, "X", "a"), (1, 2, 11, " x ", "b"), (2, 1, 20, "x", "b"), (3, 1, 30, "x", "a")], "case_id long, market_id int, seq long, name string, status string")
    r = catalog.market_rollup(d).first()
    assert (r.key, r["name"], r.case_count, r.mentions, r.dominant_status, r.statuses) == ("x", "X", 3, 4, "a", "a:2|b:2")


def test_empty_search_finds_nothing(spark, sf):
    d = spark.createDataFrame([(1, "a")], "case_id long, case_name string")
    assert catalog.searched(d, ["case_name"], "  ").count() == 0


def test_three_valued_screening(spark):
    """A failed condition settles a test whatever else lacks data; a lone missing one leaves it open."""
    met = spark.createDataFrame(
        [(1, "r", "t", "a", False, 10.0, 5.0, False), (1, "r", "t", "b", False, 10.0, None, None), (2, "r", "t", "a", False, 10.0, 11.0, True), (2, "r", "t", "b", False, 10.0, None, None), (3, "r", "t", "a", False, 10.0, 10.5, True), (4, "r", "p", "a", True, 1.0, 5.0, True)],
        "deal_id long, rule_id string, test_id string, condition_id string, pending boolean, value double, actual double, met boolean",
    )
    got = {r.deal_id: (r.status, r.confidence) for r in screening.statuses(screening.tests_fired(met)).collect()}
    assert got == {1: ("not_triggered", "high"), 2: ("data_insufficient", "medium"), 3: ("triggered", "low"), 4: ("not_triggered", "high")}


def test_rules_are_bounded(spark, sf, monkeypatch):
    monkeypatch.setattr(screening, "MOST_CONDITIONS", 3)
    with pytest.raises(ValueError, match="conditions"):
        screening.conditions_met(plans.deals(spark, sf), plans.conditions(spark))


def test_resolution_of_an_unknown_item_fails(spark):
    a = spark.createDataFrame([(1, "x")], "key long, name string")
    with pytest.raises(ValueError, match="cannot be applied"):
        drafts.resolved(a, a, spark.createDataFrame([(9, "drop", None)], "key long, decision string, new long"), "key", "name")


def test_reconciliation_lets_a_draft_serve_twice(spark):
    e = spark.createDataFrame([(1, "m", 1, "ready mix concrete"), (1, "m", 2, "ready-mix concrete"), (1, "m", 3, "zzz")], "case_id long, kind string, item long, name string")
    d = spark.createDataFrame([(1, "m", 7, "Ready mix concrete"), (1, "m", 8, "cement qq")], "case_id long, kind string, draft long, draft_name string")
    got = {r.item: (r.draft, r.result) for r in matching.reconciled(e, d).collect()}
    assert got == {1: (7, "matched"), 2: (7, "matched"), 3: (None, "unmatched")}
    assert [r.draft for r in matching.additions(d, matching.reconciled(e, d)).collect()] == [8]


def test_ratio_equals_the_standard_library(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abc ") for _ in range(8)), "".join(rng.choice("abc ") for _ in range(8))) for _ in range(50)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", matching.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == SequenceMatcher(None, r.a, r.b).ratio() for r in got)


def test_diverse_picks(spark):
    rows = [(1, 1, "a", 1.0), (1, 2, "a", 0.9), (1, 3, "b", 0.7), (1, 4, "c", 0.2)]
    got = matching.diverse(spark.createDataFrame(rows, "case_id long, item long, status string, score double"), 3).collect()
    assert [r.item for r in sorted(got, key=lambda r: r["pick"])] == [1, 3, 2]


def test_greedy_merge_keeps_the_better_supported(spark):
    rows = [(1, "m", 1, "ready mix concrete", 0), (1, "m", 2, "ready mix concretes", 3), (1, "m", 3, "cement", 1)]
    got = {r.item: r.kept for r in matching.greedy_merged(spark.createDataFrame(rows, "case_id long, kind string, item long, name string, valid int")).collect()}
    assert got == {1: 2, 2: 2, 3: 3}


def test_many_query_vectors_go_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    d = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)], "id long, embedding array<double>")
    found = lambda: sorted((r.query_id, r.rank, r.id, round(r.similarity, 9)) for r in nearest.top_k(d, d, 4).collect())
    want = found()
    monkeypatch.setattr(nearest, "BLOCK", 70)
    assert found() == want


SCHEMA = StructType([StructField("case_id", LongType()), StructField("name", StringType())])


def test_scans_tolerant_and_strict(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"case_id": 1, "name": "x"}\n{"case_id": 2, "name": "y", "extra": 1}\nnot json\n')
    rows = tables.records(spark, str(tmp_path), SCHEMA, allowed=["case_id", "name"]).collect()
    assert sorted(r.record.case_id for r in rows if r.record) == [1] and sum(r._corrupt_record is not None for r in rows) == 2
    with pytest.raises(PySparkException, match="bad record"):
        tables.records(spark, str(tmp_path), SCHEMA, strict=True).collect()


def test_last_path_wins(spark):
    d = spark.createDataFrame([(1, "a", "old"), (1, "b", "new"), (2, "a", "only")], "case_id long, path string, v string")
    assert sorted((r.case_id, r.v) for r in tables.last_wins(d, "case_id", "path").collect()) == [(1, "new"), (2, "only")]


def test_ingest_appends_what_is_new(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = StructType([StructField("key", LongType()), StructField("v", StringType())])
    make = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    make([(1, "a"), (1, "a"), (2, "b")])
    assert ingest(spark, source, schema, target, "key", mark) == 2
    make([(2, "again"), (3, "c")])
    assert ingest(spark, source, schema, target, "key", mark) == 3
    assert ingest(spark, source, schema, target, "key", mark) == 3


def test_slug_and_domain(spark):
    assert re.fullmatch(r"[a-z0-9_]+", one(spark, T.slug(F.col("c")), c="Case M.1234 – Foo/Bar (2020)"))
    assert one(spark, T.official(F.col("c"), ["x.eu"]), c="https://a.x.eu/p") is True
    assert one(spark, T.official(F.col("c"), ["x.eu"]), c="https://evilx.eu/p") is False


def test_delimited_sink_and_profiles(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a;b\r\nc,d\n" + "x" * 50)
    text = intake.delimited(spark, str(tmp_path / "f.csv"), 12).first().text
    assert text == "a;b\r\nc,d\nxxx" + intake.TRUNCATED
    (tmp_path / "p.json").write_text('{"profile_id": "eu", "coverage_keywords": {"market": ["x"]}}\n')
    p = intake.profiles(spark, str(tmp_path / "p.json")).first()
    assert p.orphan_policy.default == "warn" and p.jurisdictions == [] and p.coverage_keywords == {"market": ["x"]}
    d = spark.createDataFrame([(1, "a")], "case_id long, v string")
    intake.sink(d, d.groupBy("v").count(), str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/totals")).first()["count"] == 1


def test_drafts_of_several_cases_do_not_merge(spark):
    d = spark.createDataFrame([(1, 10, 1, "x"), (1, 11, 2, "y")], "batch long, case_id long, seq long, v string")
    with pytest.raises(PySparkException, match="several cases"):
        intake.merged_drafts(d, "batch", "case_id", "seq", ["v"], F.lit(False)).collect()


def test_review_set_prefers_paired_names(spark):
    make = lambda rows: spark.createDataFrame(rows, "case_id long, item long, name string, status string, score double")
    products = make([(1, 1, "cement", "a", 1.0), (1, 2, "ready mix concrete", "a", 0.9)])
    places = make([(1, 7, "concrete in Spain", "a", 0.5), (1, 8, "France", "a", 0.6)])
    got = {r["list"]: r.item for r in matching.review_set(products, places, 1).collect()}
    assert got == {"product": 2, "geographic": 7}


# ------------------------------------------------------------------ names, forms, quotes


@pytest.mark.parametrize(
    "a,b,least,most",
    [
        ("Wearable OS / platforms", "Supply of licensable OSs for wrist-worn wearable devices", 0.45, 0.75),
        ("Steel pipes", "steel pipes ", 1.0, 1.0),
        ("Ad-tech", "Advertising technology", 1.0, 1.0),
        ("Market for widgets", "Widgets markets", 1.0, 1.0),
        ("Gas", "Poultry", 0.0, 0.35),
    ],
)
def test_name_similarity(spark, a, b, least, most):
    got = one(spark, matching.similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert least - 1e-9 <= got <= most + 1e-9


def test_devices_and_places_in_reconciliation(spark):
    assert one(spark, matching.device_factor(F.col("a"), F.col("b")), a="OSs for PCs", b="Wrist-worn OS") == 0.55
    assert one(spark, matching.device_factor(F.col("a"), F.col("b")), a="desktop software", b="laptops") == 1.0
    assert one(spark, matching.device_factor(F.col("a"), F.col("b")), a="smartphones", b="smartwatch") == 1.0
    assert one(spark, matching.shared_words(F.col("a"), F.col("b"), matching.GEO_STOP), a="EEA market for wearables", b="Worldwide wearables") == 1.0
    place = one(spark, matching.contextual(F.col("a"), F.col("b"), F.lit("geographic")), a="EEA: search engines", b="National scope of search engines in the UK")
    assert 0.7 < place < 0.75


def test_normal_forms(spark):
    assert one(spark, T.normalized(F.col("c")), c="ﬁrm’s  ½ “ｆｕｌｌ”") == "firm's 1⁄2 \"full\""
    assert one(spark, T.bare(F.col("c")), c="  Éx–ample: Ünï, ﬁn! ") == "example uni fin"
    from caseloom.operators import rest

    assert one(spark, rest.gold_form(F.col("c")), c="The ﬂuo-\n ride’s “co­op”") == "the fluoride's \"coop\""
    assert one(spark, T.is_contents(F.col("c")), c="1 A......3\n2 B....4\n3 C.....5\n4 D........6") is True
    assert one(spark, T.is_contents(F.col("c")), c="One. Two. Three. Four... Five.") is False


@pytest.mark.parametrize(
    "text,outcome,stage",
    [("under Article 8(3) and Article 8(2)", "blocked", "phase2"), ("Article 6(1)(b) with commitments", "cleared_with_conditions", "phase1"), ("ARTICLE 6(1)(b)", "cleared", "phase1"), ("Article 6(1)(c)", "pending", "phase2"), ("It does not raise serious doubts.", "cleared", "unknown"), ("nothing", "unknown", "unknown")],
)
def test_article_outcomes(spark, text, outcome, stage):
    assert tuple(one(spark, T.article_outcome(F.col("c")), c=text)) == (outcome, stage)


def test_long_files_are_cut_and_say_so(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"1,200"\n' * 10)
    (tmp_path / "b.csv").write_text("y" * 50)
    got = {r.path[-5:]: r.text for r in intake.delimited(spark, str(tmp_path), 120).collect()}
    assert got == {"a.csv": 'x,"1,200"\n' * 10, "b.csv": "y" * 50}
    got = {r.path[-5:]: r.text for r in intake.delimited(spark, str(tmp_path), 20).collect()}
    assert got["b.csv"] == "y" * 20 + "\n\n[... document truncated ...]"


def test_quotes_in_texts_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 80)))) for i in range(60)] + [(900, ""), (901, None)]
    quotes = []
    for j in range(80):
        t = texts[rng.randrange(60)][1]
        a = rng.randrange(len(t) + 1)
        q = " ".join(t[a : a + rng.randint(5, 90)].split())
        if j % 3 == 0:
            q = q.replace("a", "b", 2)
        quotes.append((j, q))
    quotes += [(500, None), (501, ""), (502, "a"), (503, "ab"), (504, "c d"), (505, "cde ab"), (506, "zz")]
    want = {(j, i) for j, q in quotes for i, t in texts if q and t and q in t}
    got = grounding.verbatim(spark.createDataFrame(quotes, "item_id long, q string"), spark.createDataFrame(texts, "doc_id long, t string")).collect()
    assert {(r.item_id, r.doc_id) for r in got} == want and len(got) == len(want) > 20

    qs, ts = spark.createDataFrame(quotes, "item_id long, quote string"), spark.createDataFrame(texts, "doc_id long, text string")
    every = qs.crossJoin(ts).withColumn("pair_id", F.struct("item_id", "doc_id"))
    found = {tuple(r.pair_id) for r in grounding.dense(every.select("pair_id", "quote", "text")).where("found").collect()}
    near = {(r.item_id, r.doc_id) for r in grounding.likely(qs, ts).collect()}
    assert found <= near, found - near
    assert 503 in {j for j, _ in found} and len(near) < 85 * 60 * 2 / 3


def test_approximate_neighbours_have_recall(spark):
    from caseloom.operators import rest

    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(i % 7, 1) for _ in range(16)]) for i in range(600)], "id long, embedding array<double>")
    q = v.where("id % 50 = 0")
    want = {(r.query_id, r.id) for r in nearest.top_k(v, q, 6, -1.0).where("query_id <> id").collect()}
    got = {(r.query_id, r.id) for r in rest.approximate(v, q, 5).collect()}
    assert len(got & want) >= 0.9 * len(got) and len(got) == 5 * 12


def deal(**given):
    """A deal with every column of the screening, empty but for what is given."""
    kinds = {"deal_id": "long", "acquirer": "map<string,double>", "target": "map<string,double>", "acquirer_countries": "map<string,double>", "target_countries": "map<string,double>", "acquirer_assets": "double", "target_assets": "double"}
    kinds |= {"acquirer_assets_countries": "map<string,double>", "target_assets_countries": "map<string,double>", "deal_value": "double", "deal_currency": "string", "revenue_currency": "string", "fx_rates": "map<string,double>"}
    kinds |= {"combined_share": "map<string,double>", "acquirer_share": "map<string,double>", "incremental_share": "map<string,double>", "deal_type": "string", "control": "string", "relation": "string", "pct_shares": "double"}
    return tuple(given.get(c, {} if t.startswith("map") else "EUR" if c.endswith("currency") else None) for c, t in kinds.items()), ", ".join(f"{c} {t}" for c, t in kinds.items())


def test_screening_in_the_deals_row(spark):
    """Scope and its note come before the tests; a rule without tests is not triggered; notes of the rule go with its tests."""
    minority = {"deal_type": "minority_stake", "acquirer": {"worldwide": 20.0}}
    given = [deal(deal_id=1, **minority, relation="vertical"), deal(deal_id=2, **minority, relation="horizontal"), deal(deal_id=3, **minority, relation="horizontal", pct_shares=10.0), deal(deal_id=4, deal_type="joint_venture"), deal(deal_id=5, acquirer={"worldwide": 20.0})]
    d = spark.createDataFrame([x[0] for x in given], given[0][1])
    rules = spark.createDataFrame(
        [("a", ["minority_stake", "full_merger"], (True, "percentage_based", [("horizontal", ">=", 25.0)]), ["said"]), ("b", [], None, None)],
        "rule_id string, triggers array<string>, minority struct<applies:boolean,standard:string,rules:array<struct<relation:string,op:string,pct:double>>>, notes array<string>",
    )
    conditions = plans.conditions(spark).where("rule_id = 'us' and condition_id = 'c1'").withColumns({"rule_id": F.lit("a"), "metric": F.lit("revenue"), "value": F.lit(19.0)})
    got = {(r.deal_id, r.rule_id): (r.status, r.triggered_by, r.confidence, r.notes) for r in screening.screened(d, conditions, rules).collect()}
    assert len(got) == 10 and all(got[k, "b"] == ("not_triggered", "", "high", []) for k in range(1, 6))
    assert got[1, "a"] == ("not_triggered", "", "high", [screening.NOTES["other"]])
    assert got[2, "a"] == ("triggered", "t1", "high" if 1 / 19 >= 0.1 else "low", ["said"])
    assert got[3, "a"] == ("not_triggered", "", "high", [screening.NOTES["share"] % (10.0, "horizontal >=25.0%")])
    assert got[4, "a"] == ("not_triggered", "", "high", [screening.NOTES["type"] % ("joint_venture", "minority_stake, full_merger")])
    assert got[5, "a"] == got[2, "a"]
    counts = {r.deal_id: (r.filings, r.unclear) for r in screening.filing_counts(d, conditions, rules).collect()}
    assert counts == {1: (0, 0), 2: (1, 0), 3: (0, 0), 4: (0, 0), 5: (1, 0)}


def test_screening_in_a_row_equals_the_steps(spark, sf):
    d, c = plans.deals(spark, sf), plans.conditions(spark)
    steps = screening.statuses(screening.tests_fired(screening.conditions_met(d, c)))
    assert sorted(map(tuple, screening.deal_statuses(d, c).collect())) == sorted(map(tuple, steps.collect()))
    plan = screening.screened(d, c, plans.rules(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Aggregate" not in plan and plan.count("Join") == 2


def test_assets_of_a_country_stand_for_all(spark):
    row, kinds = deal(deal_id=1, acquirer_assets=9.0, acquirer_assets_countries={"ca": 5.0}, target_assets=8.0, acquirer={"domestic": 0.0}, acquirer_countries={"CA": 3.0}, target_countries={"ca": 4.0})
    d = spark.createDataFrame([row], kinds)
    rules = spark.createDataFrame([("CA",), ("us",)], "rule_id string")
    got = {r.rule_id: (r.acquirer_assets, r.target_assets, r.acquirer["domestic"], r.target.get("domestic")) for r in screening.scoped(d, rules).collect()}
    assert got == {"CA": (5.0, 8.0, 0.0, 4.0), "us": (9.0, 8.0, 0.0, None)}
    assert screening.scoped(d, rules, zero_is_missing=True).where("rule_id = 'CA'").first().acquirer["domestic"] == 3.0
