"""Review sets, editions, links, review texts, statuses, promotion guards and name lists on literal rows."""

from pyspark.sql import functions as F

from caseloom.operators import checks, evals, intake, matching, nearest, pages, sections
from tests.test_operators import one

ITEMS = "case_id long, item long, name string, status string, score double, market_group string, low boolean"


def picks(spark, products, places, count):
    d = matching.review_set(spark.createDataFrame(products, ITEMS), spark.createDataFrame(places, ITEMS), count)
    return [(r["list"], r.item) for r in sorted(d.collect(), key=lambda r: (r["list"], r.pick))]


def test_review_set_pairs_by_group_and_fills_up(spark):
    products = [(1, 1, "alpha", "a", 1.0, "g1", False), (1, 2, "beta", "a", 1.1, "", False), (1, 3, "gamma delta", "b", 0.9, None, None), (1, 4, "low one", "a", 9.0, "", True)]
    places = [(1, 11, "zone", "a", 1.0, "g1", False), (1, 12, "zone beta", "a", 1.3, "", False), (1, 13, "other", "a", 1.2, "", False), (1, 14, "low", "b", 5.0, "", True)]
    # beta 1.1 + 0.4 (all of its word) and 0.25 for its status first; gamma's status is new (1.15), so is not alpha's (1.0 + 0.4)
    assert picks(spark, products, places, 2) == [("geographic", 12), ("geographic", 11), ("product", 2), ("product", 1)]
    # places go by score alone, though all chosen have one status
    assert picks(spark, products, places, 3)[:3] == [("geographic", 12), ("geographic", 11), ("geographic", 13)]
    assert picks(spark, products, places, 5) == [("geographic", 12), ("geographic", 11), ("geographic", 13), ("geographic", 14), ("product", 2), ("product", 1), ("product", 3), ("product", 4)]


def test_reports_are_scored_by_name_and_text(spark):
    rows = [(1, 1, "https://x/a/doc1.pdf", "Final report"), (1, 2, "https://x/a/final-report.pdf", "Appendix to it"), (2, 1, "https://x/a/map.pdf", None), (3, 1, "https://x/12-3.pdf", ""), (4, 1, "https://x/summary.pdf", "")]
    d = spark.createDataFrame(rows, "page_id long, pos int, url string, text string")
    got = {r.page_id: (r.url.split("/")[-1] if r.url else None, r.how) for r in sections.best_reports(d, F.col("url"), F.col("text")).collect()}
    assert got == {1: ("doc1.pdf", "scored"), 2: ("map.pdf", "only"), 3: ("12-3.pdf", "only"), 4: (None, "manual")}
    assert {r.page_id: r.how for r in sections.best_reports(d, F.col("url")).collect()}[3] == "scored"


def test_editions_of_the_register(spark):
    cases = [(1, "cleared", "x/M.5", "2020"), (2, "blocked", "x/M.5", "2020"), (3, None, "x/none", "2020"), (4, "cleared", "x/M.6", "soon"), (5, "cleared", "x/M.7", "2021"), (6, "cleared", "x/M.8", "2021"), (7, "cleared", None, "2021")]
    editions = [("32020M5", "deu", 200, "application/pdf"), ("32020M5", "eng", 200, "text/html"), ("32020M5", "fra", 404, ""), ("32021M7", "eng", 404, ""), ("32021M7", "fra", 503, ""), ("32021M7", "deu", 500, "")]
    d = pages.resolved_edition(spark.createDataFrame(cases, "case_id long, outcome string, source_url string, year string"), spark.createDataFrame(editions, "register_id string, lang string, status int, kind string"))
    got = {r.case_id: (r.how, r.register_id, r.lang, r.reason) for r in d.collect()}
    assert got[1] == ("resolved", "32020M5", "deu", "cellar_celex_32020M5_deu") and got[2] == ("manual", None, None, "phase_ii_not_in_cellar")
    assert [got[k][3] for k in (3, 4, 5, 6, 7)] == ["no_case_number_in_source_url", "no_decision_year", "cellar_no_pdf_status_503", "cellar_no_pdf_status_None", "no_case_number_in_source_url"]


def test_link_classes(spark):
    rows = [(200, None, 0, 1.0), (200, None, 2, 9.0), (403, None, 1, 1.0), (None, "SSL: bad", 0, None), (None, "timed out", 0, 30.0), (404, "", 3, 9.0), (200, None, 0, 8.5)]
    r = checks.link_classes(spark.createDataFrame(rows, "status int, error string, redirects int, seconds double")).first()
    assert r.asDict() == {"links": 7, "broken": 2, "redirected": 1, "bot_protected": 1, "ssl_uncertain": 1, "slow": 2, "ok": 2}


def test_review_texts(spark):
    status = lambda t: one(spark, checks.review_status(F.col("t")), t=t)
    assert [status(t) for t in ("# x\n  **Status: pass**\n**Status: FAIL**", "**Status:** ok", "Status: PASS", "")] == ["PASS", "OK", "UNKNOWN", "UNKNOWN"]
    ready = lambda t: one(spark, checks.packet_readiness(F.col("t")), t=t)
    assert [ready(t) for t in ("x\n## Readiness: warn now", "## readiness:\nPASS", "none")] == ["WARN", "UNKNOWN", "UNKNOWN"]
    record = "id: 1\nproduct_markets_considered:\n- market_id: a\n  - market_id: b\n\nother:\n  - market_id: c\n  product_markets_considered:\n  - market_id: d\n"
    assert one(spark, checks.market_count(F.col("t")), t="product_markets_considered:\n  - market_id: a\n    name: x\n\n  - market_id: b\nother: 1\n  - market_id: c") == 2
    assert one(spark, checks.market_count(F.col("t")), t=record) == 3  # a dash at the margin is an entry too, and a later key begins the list again
    d = spark.createDataFrame([(None,)], "t string").select(checks.review_status(F.col("t")), checks.packet_readiness(F.col("t")), checks.market_count(F.col("t"))).first()
    assert tuple(d) == ("NO_REVIEW", "NO_REVIEW", 0)


def test_definitions(spark):
    values = [*checks.DEFINITIONS, *checks.ON_PROMOTION, "odd", None]
    new, level = checks.merged_definition(F.col("s"))
    rows = spark.createDataFrame([(v,) for v in values], "s string").select("s", new.alias("new"), level.alias("level"), checks.promoted_definition(F.col("s")).alias("up")).collect()
    for r in rows:
        valid = r.s in checks.DEFINITIONS
        assert r.new == (r.s if valid else checks.ON_MERGE.get(r.s, r.s)) and r.level == (None if valid else "INFO" if r.s in checks.ON_MERGE else "WARN") and r.up == checks.ON_PROMOTION.get(r.s, r.s)


def test_guards_of_a_promotion(spark):
    core = lambda i, kind, status, name, case=1: (case, i, kind, "core_assessed", status, name)
    markets = [core(1, "product", "defined", "wearable devices"), core(2, "product", "defined", "phones"), core(3, "product", "left_open", "ads", 2), core(4, "geographic", "defined", "EEA wearable"), core(5, "geographic", "segmented", "EEA"), core(6, "product", "defined", "no page"), (1, 7, "product", "background", "defined", "x"), core(8, "product", "defined", "ads", 2)]
    passages = [(1, "3", "conclusion", [1, 4]), (1, "3", "precedent", [2]), (1, " ", "conclusion", [6]), (2, "1", "commission_assessment", [3, 8])]
    caveats = [(2, "The text is CUT OFF"), (1, "fine"), (1, None)]
    d = evals.promotion_plan(
        spark.createDataFrame(markets, "case_id long, market_id long, kind string, importance string, status string, name string"),
        spark.createDataFrame(passages, "case_id long, page string, role string, supports array<long>"),
        spark.createDataFrame(caveats, "case_id long, caveat string"),
    )
    got = {r.market_id: (r.action, r.guard) for r in d.collect()}
    assert got == {
        1: ("promote_to_canonical", None), 2: ("hold_pending_source_check", "role"), 3: ("hold_pending_source_check", "caveat"), 4: ("promote_to_canonical", None),
        5: ("manual_review_geo_pairing", "pairing"), 6: ("manual_review", None), 7: ("exclude_from_canonical", None), 8: ("promote_to_canonical", None),
    }


def test_names_of_both_arms(spark):
    co = spark.createDataFrame([("b", 2, 5), ("a", 2, 3), ("c", 1, 1)], "key string, shared_cases long, first_seq long")
    hits = spark.createDataFrame([(" B ", 1), ("Me", 2), ("d", 3), ("D", 4), ("e", 5)], "name string, rank int")
    names = lambda n: [(r.key, r.origin[0]) for r in nearest.names_of_both(co, hits, "me", n).collect()]
    assert names(9) == [("a", "c"), ("b", "c"), ("c", "c"), ("d", "s"), ("e", "s")]
    assert names(2) == [("a", "c"), ("b", "c")]


def test_aliases_by_five_patterns(spark):
    quotes = {
        1: "The relevant product market is an online search advertising service, in all.", 2: "an overall market for the wholesale supply of fish. More", 3: "the relevant product market for display ads; and",
        4: "relevant geographic market for smart watches", 5: "There is a market for cloud gaming, perhaps", 6: "market for the purpose of this decision.", 7: "market for things that should be left", 8: "a market for (i) one thing and (ii) another.",
        9: "the relevant market is left open.", 10: "market for ads", 11: "a market for Cloud Gaming.", 12: "the market for its own name.", 13: None, 14: "market for goods as listed: (i",
    }
    passages = spark.createDataFrame([(1, i, q) for i, q in quotes.items()], "market_id int, passage_id int, quote string")
    markets = spark.createDataFrame([(1, " Its Own Name ")], "market_id int, name string")
    got = {(r.alias, r.passage_id) for r in intake.alias_phrases(markets, passages).collect()}
    assert got == {("online search advertising service", 1), ("wholesale supply of fish", 2), ("display ads", 3), ("smart watches", 4), ("cloud gaming", 5)}


def test_quotes_of_chunks(spark):
    long = "A first sentence that is long enough to count. And then one that stops in the"
    pages_ = [("c1", 1, "some words here"), ("c1", 2, "other  words there"), ("c2", 3, long)]
    rows = [("", 1, "some", None, None), ("c1", 1, " ", None, None), ("c1", 0, "some", None, None), ("c2", 3, long, None, None), ("c9", 1, "some", None, None), ("c1", 3, "some words", None, None), ("c1", 1, "some words", "conclusion", "fra"), ("c1", 1, "other words there", "gossip", "french"), ("c1", 2, "no such", "background", None), ("c2", 3, "long enough", None, " deu ")]
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "passage_id int, chunk_id string, page int, quote string, role string, language string")
    langs = spark.createDataFrame([("c1", "eng")], "chunk_id string, language string")
    got = {r.passage_id: (r.verdict, r.page, r.role, r.language) for r in intake.chunk_quotes(p, spark.createDataFrame(pages_, "chunk_id string, page_number int, text string"), langs).collect()}
    assert [got[i][0] for i in range(10)] == ["missing_chunk", "missing_quote", "missing_page", "truncated", "unknown_chunk", "unknown_page", "ok", "corrected", "not_found", "ok"]
    assert got[6][1:] == (1, "conclusion", "fra") and got[7][1:] == (2, "", "eng") and got[8][1:] == (None, "background", "eng") and got[9][1:] == (3, "", "deu")
    own = spark.createDataFrame([(1, "x" * 90), (1, "x" * 80 + "y"), (1, "z"), (2, "z"), (1, None)], "case_id int, quote string")
    left = intake.top_level(own, spark.createDataFrame([(1, "x" * 100), (2, "z")], "case_id int, quote string")).collect()
    assert sorted((r.case_id, r.quote or "") for r in left) == [(1, ""), (1, "z")]
