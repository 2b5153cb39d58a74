"""Queries of the page and passage operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import pages as P
from caseloom.plans.catalog import with_
from caseloom.plans.records import PASSAGES_SQL, passages
from caseloom.plans.text import TOK
from caseloom.sources import adapters as A

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(with_(A.PAGES_SQL) + " SELECT doc_id, count(*) FILTER (contains(lower(text), 'ation') OR contains(lower(text), 'the ')) AS pages FROM text_pages GROUP BY 1")
def p20_relevant_sections(spark, sf):
    return A.text_pages(spark, sf).groupBy("doc_id").agg(F.count_if(P.contains_any(F.col("text"), ["ATION", "the "])).alias("pages"))


@query("""WITH w(kind, phrase, weight) AS (VALUES ('vertical', 'the ', 2), ('vertical', 'ation', 1), ('horizontal', 'que', 3), ('horizontal', 'the ', -1))
    SELECT doc_id, kind, sum(weight)::BIGINT AS score FROM documents JOIN w ON contains(lower(text), phrase) GROUP BY 1, 2""")
def t21_signal_scores(spark, sf):
    w = spark.createDataFrame([("vertical", "the ", 2), ("vertical", "ation", 1), ("horizontal", "que", 3), ("horizontal", "the ", -1)], "kind string, phrase string, weight long")
    return P.signal_scores(A.table(spark, sf, "documents"), "doc_id", "text", w)


#: The values of a list, each where it comes first.
FIRSTS = "list_filter({list}, lambda x, i: list_position({list}, x) = i)"
BONUS, PENALTY = [("market", "the ", 2), ("market", "ation", 1), ("own", "que", 3)], [("market", "der", 2), ("own", "and", 1)]


@query(with_(A.PAGES_SQL) + f""", w AS (SELECT doc_id AS prop_id, doc_id, {FIRSTS.format(list="regexp_extract_all(lower(text), '[a-z]{4,}')")}[:25] AS ks, {FIRSTS.format(list="regexp_extract_all(lower(text), '[a-z]{3,}')")}[:12] AS topic FROM text_pages WHERE page_number = 1),
    t AS (SELECT doc_id, page_number, lower(text) AS t, CASE page_number % 4 WHEN 0 THEN '' WHEN 1 THEN substring(text, 1, 20) ELSE 'one > ' || substring(text, 1, 30) END AS path FROM text_pages WHERE length(text) > 0 AND len(regexp_extract_all(text, '\\.{{4,}}')) < 4),
    d AS (SELECT prop_id, page_number, t, path, topic, len([k for k in ks if contains(t, k)]) AS hits, {FIRSTS.format(list="regexp_extract_all(lower(path), '[a-z]{3,}')")}[:12] AS section FROM w JOIN t USING (doc_id)),
    x AS (SELECT *, {" + ".join(f"CASE WHEN contains(t, '{p}') THEN {v} ELSE 0 END" for _, p, v in BONUS)} AS bonus, {" + ".join(f"CASE WHEN contains(t, '{p}') THEN {v} ELSE 0 END" for _, p, v in PENALTY)} AS penalty, len(list_intersect(topic, section)) AS o FROM d WHERE hits > 0),
    y AS (SELECT *, CASE WHEN len(topic) = 0 OR len(section) = 0 THEN 0 WHEN o >= 2 THEN 6 WHEN o = 1 THEN 3 ELSE 0 END AS topic_bonus, CASE WHEN len(topic) = 0 OR len(section) = 0 OR o > 0 THEN 0 WHEN contains(path, ' > ') THEN 5 ELSE 2 END AS topic_penalty FROM x),
    z AS (SELECT *, CASE WHEN topic_penalty >= 4 THEN hits - 2 * topic_penalty ELSE hits + 2 * bonus - 2 * penalty + 2 * topic_bonus - 3 * topic_penalty END AS score FROM y)
    SELECT prop_id, page_number, hits, bonus, penalty, topic_bonus, topic_penalty, score, row_number() OVER (PARTITION BY prop_id ORDER BY score DESC, page_number)::INT AS rank FROM z QUALIFY rank <= 5""")
def w15_candidate_pages(spark, sf):
    """The first page of each document as a proposition, its pages as candidates, in sections named by their first words."""
    p = A.text_pages(spark, sf)
    words = P.keywords(F.col("text"), [], 25)
    props = p.where("page_number = 1").select(F.col("doc_id").alias("prop_id"), "doc_id", words.alias("keywords"), F.array(F.lit("market"), F.lit("own")).alias("kinds"), F.col("text").alias("name"))
    path = F.expr("case page_number % 4 when 0 then '' when 1 then substring(text, 1, 20) else concat('one > ', substring(text, 1, 30)) end")
    return P.candidate_pages(props, p.withColumn("path", path), BONUS, PENALTY)


@query(with_(PASSAGES_SQL) + """, m AS (SELECT case_id, unnest(supports_markets) AS market_id, unnest([1, 0]) AS direct, role, passage_id AS seq FROM passages)
    SELECT case_id, market_id, seq, row_number() OVER (PARTITION BY case_id, market_id ORDER BY direct DESC, CASE role WHEN 'analysis' THEN 1 WHEN 'conclusion' THEN 2 ELSE 3 END, seq)::INT AS rank FROM m QUALIFY rank <= 2""")
def w14_passage_order(spark, sf):
    p = passages(spark, sf).select("case_id", F.posexplode("supports_markets").alias("i", "market_id"), "role", F.col("passage_id").alias("seq"))
    p = p.withColumn("direct", (F.col("i") == 0).cast("int"))
    return P.ordered_passages(p, ["analysis", "conclusion"], 2).select("case_id", "market_id", "seq", "rank")


@query("""WITH k AS (SELECT item_id, [x for x in regexp_extract_all(lower(text), '[a-z]{4,}') if x <> 'with' AND x <> 'that'] AS w FROM benchmark),
    u AS (SELECT item_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM k), f AS (SELECT item_id, x, min(i) AS i FROM u GROUP BY 1, 2)
    SELECT item_id, string_agg(x, ' ' ORDER BY i) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM f) WHERE r <= 25 GROUP BY 1""")
def t20_keywords(spark, sf):
    return A.table(spark, sf, "benchmark").select("item_id", F.array_join(P.keywords(F.col("text"), ["with", "that"]), " ").alias("keywords"))


@query(f"""WITH t AS (SELECT item_id, list_filter(list_distinct({TOK.format('text')}), lambda x: x <> 'the') AS s FROM benchmark)
    SELECT a.item_id, round(len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)), 6) AS recall FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def t18_min_recall(spark, sf):
    b = A.table(spark, sf, "benchmark")
    o = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(o, "item_id").select("item_id", F.round(P.min_recall(F.col("text"), F.col("other"), ["the"]), 6).alias("recall"))


@query("""WITH c AS (SELECT o_orderkey AS case_id, CASE o_orderstatus WHEN 'P' THEN 'blocked' WHEN 'F' THEN 'cleared' END AS outcome, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS num, CASE WHEN o_orderkey % 13 <> 0 THEN year(o_orderdate::DATE) END AS year FROM orders),
    i AS (SELECT *, '3' || year || 'M' || num AS id FROM c),
    e AS (SELECT case_id AS k, unnest(['ENG', 'FRA', 'DEU']) AS lang, unnest([1, 2, 3]) AS place, unnest([CASE WHEN case_id % 3 = 0 THEN 200 ELSE 404 END, CASE WHEN case_id % 4 = 0 THEN 200 WHEN case_id % 4 = 1 THEN 503 ELSE 404 END, CASE WHEN case_id % 5 = 0 THEN 200 ELSE 404 END]) AS s, CASE WHEN case_id % 7 = 0 THEN 'text/html' ELSE 'application/pdf' END AS kind FROM c),
    g AS (SELECT k, arg_min(lang, place) FILTER (s = 200 AND contains(kind, 'pdf')) AS lang, arg_min(s, CASE WHEN s = 404 THEN 10 ELSE 0 END + place) AS last FROM e GROUP BY 1)
    SELECT case_id, CASE WHEN outcome = 'blocked' THEN 'manual' WHEN lang IS NOT NULL AND id IS NOT NULL THEN 'resolved' ELSE 'missing' END AS how, CASE WHEN coalesce(outcome <> 'blocked', TRUE) THEN id END AS register_id,
      CASE WHEN coalesce(outcome <> 'blocked', TRUE) AND id IS NOT NULL THEN lower(lang) END AS lang,
      CASE WHEN outcome = 'blocked' THEN 'phase_ii_not_in_cellar' WHEN num IS NULL THEN 'no_case_number_in_source_url' WHEN year IS NULL THEN 'no_decision_year' WHEN lang IS NOT NULL THEN 'cellar_celex_' || id || '_' || lower(lang) ELSE 'cellar_no_pdf_status_' || last END AS reason
    FROM i JOIN g ON k = case_id""")
def w20_language_edition(spark, sf):
    o = A.table(spark, sf, "orders")
    link = F.expr("concat('https://x.example/cases/', if(o_orderkey % 11 = 0, 'none', concat('M.', o_orderkey)))")
    year = F.when(F.col("o_orderkey") % 13 != 0, F.year(F.to_date("o_orderdate")))
    cases = o.select(F.col("o_orderkey").alias("case_id"), F.expr("case o_orderstatus when 'P' then 'blocked' when 'F' then 'cleared' end").alias("outcome"), link.alias("source_url"), year.alias("year"))
    status = {"ENG": "if(o_orderkey % 3 = 0, 200, 404)", "FRA": "case when o_orderkey % 4 = 0 then 200 when o_orderkey % 4 = 1 then 503 else 404 end", "DEU": "if(o_orderkey % 5 = 0, 200, 404)"}
    e = o.select(P.register_id(link, year).alias("register_id"), F.expr("if(o_orderkey % 7 = 0, 'text/html', 'application/pdf')").alias("kind"), F.explode(F.array(*[F.struct(F.lit(k).alias("lang"), F.expr(v).alias("status")) for k, v in status.items()])).alias("e"))
    return P.resolved_edition(cases, e.where("register_id is not null").select("register_id", "kind", "e.*"))




@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ((o_orderkey % 9 + 1) * 100 + 20 + (o_orderkey // 10) % 9 + 1) || '000000,' || (o_orderkey % 9 + 1) || '000'
    WHEN 2 THEN (o_orderkey % 9 + 1) * 1000 || '000000,7000' ELSE (800 + o_orderkey % 9 + 1) || '000000' END AS found FROM orders""")
def n04_spelled_numbers(spark, sf):
    """Numbers in words amid other words: none with a scale, two in English, two in Greek, one in Russian."""
    at = lambda words, e: f"element_at(array({', '.join(repr(w) for w in words.split()[:9])}), cast({e} AS int) + 1)"
    english, greek = "one two three four five six seven eight nine", "ενα δυο τρια τεσσερα πεντε εξι επτα οκτω εννεα"
    russian = "один два три четыре пять шесть семь восемь девять"
    text = f"""case o_orderkey % 4 when 0 then concat('about ', {at(english, 'o_orderkey % 9')}, ' of the two parties')
        when 1 then concat('worth ', {at(english, 'o_orderkey % 9')}, ' hundred twenty-', {at(english, 'floor(o_orderkey / 10) % 9')}, ' million euros, of it ', {at(english, 'o_orderkey % 9')}, ' Thousand in cash')
        when 2 then concat({at(greek, 'o_orderkey % 9')}, ' δισεκατομμύρια ευρώ ή επτά χιλιάδες') else concat('свыше восемьсот ', {at(russian, 'o_orderkey % 9')}, ' миллионов рублей') end"""
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{text} AS text")
    return o.select("id", F.array_join(F.transform(T.spelled_values(F.col("text")), lambda v: v.cast("long").cast("string")), ",").alias("found"))


@query(with_(PASSAGES_SQL) + """, n AS (SELECT case_id, unnest(supports_theories) AS theory_id, passage_id FROM passages), i AS (SELECT case_id, market_id AS theory_id FROM items),
    r AS (SELECT case_id, theory_id, list_distinct(list(passage_id)) AS named FROM n GROUP BY 1, 2)
    SELECT case_id, theory_id, array_to_string(list_concat([1], list_filter(list_sort(coalesce(named, [])), lambda x: x <> 1)), ',') AS refs FROM i LEFT JOIN r USING (case_id, theory_id)""")
def a30_back_references(spark, sf):
    from caseloom.plans.records import items

    i = items(spark, sf).select("case_id", F.col("market_id").alias("theory_id"), F.array(F.lit(1)).alias("refs"))
    return P.back_references(passages(spark, sf), i, "supports_theories", "theory_id").withColumn("refs", F.array_join("refs", ","))


@query(with_(A.MARKETS_SQL) + " SELECT case_id, seq, 'pm_' || row_number() OVER (PARTITION BY case_id ORDER BY seq) AS id FROM markets WHERE status <> 'R'")
def g16_draft_ids(spark, sf):
    m = A.markets(spark, sf).select("case_id", "seq", (F.col("status") == "R").alias("not_found"))
    return P.numbered_drafts(m, "pm")


@query("""SELECT url, CASE WHEN NOT contains(substring(html, 1, 1200), '<title>') THEN 'no_marker' WHEN NOT regexp_matches(substring(html, 1, 1200), 'https?://') THEN 'no_url' END AS issue
    FROM pages WHERE NOT contains(substring(html, 1, 1200), '<title>') OR NOT regexp_matches(substring(html, 1, 1200), 'https?://')""")
def g13_source_provenance(spark, sf):
    return P.provenance(A.table(spark, sf, "pages").withColumnRenamed("html", "text"), "<title>")


@query("SELECT p_partkey AS id, p_name NOT LIKE '%ring%' AND p_name NOT LIKE 'hot %' AS unit FROM part")
def p27_unit_labels(spark, sf):
    return A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), P.unit_label(F.col("p_name"), ["ring", "hot"]).alias("unit"))
