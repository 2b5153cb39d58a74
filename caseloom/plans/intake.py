"""Queries of the intake operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import evals as E
from caseloom.operators import intake as I
from caseloom.plans import records as Z
from caseloom.plans.catalog import with_
from caseloom.sources import adapters as A

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT page_id, 'Decision' AS label, 'd' || page_id || '.pdf' AS url, '2024-01-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0') AS day FROM pages")
def s24_dated_links(spark, sf):
    """Pages' own html, then a dated link twice and one without a date; links of the html itself have none after them."""
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0"))
    link = F.concat(F.lit(' <A href="d'), "page_id", F.lit('.pdf"> Decision </a> of '), day)
    html = F.concat(F.coalesce("html", F.lit("")), F.lit('<a href="x">y</a>'), link, link, F.lit('<a href="z">no date</a> at all'))
    return I.dated_links(A.table(spark, sf, "pages").select("page_id", html.alias("html")))


@query("""WITH c AS (SELECT o_custkey AS key, o_orderstatus AS outcome, count(*) AS n, min(o_orderkey) AS seq FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
    SELECT c_custkey AS key, coalesce(arg_max(outcome, n * 1000000000 - seq), 'pending') AS dominant FROM customer LEFT JOIN c ON key = c_custkey GROUP BY 1""")
def a07_dominant_outcome(spark, sf):
    o = A.table(spark, sf, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("seq"))
    return I.dominant_outcome(A.table(spark, sf, "customer").selectExpr("c_custkey AS key").join(o, "key", "left"), "key")


@query("""SELECT n_nationkey AS rule, 'no_rules' AS issue FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey, 'no_source_1' FROM nation WHERE n_nationkey % 3 = 1""")
def a12_minority_blocks(spark, sf):
    block = "case n_nationkey % 3 when 0 then cast(array() AS array<struct<source:string>>) when 1 then array(named_struct('source', 'a'), named_struct('source', '')) else array(named_struct('source', 'b')) end"
    return I.minority_blocks(A.table(spark, sf, "nation").selectExpr("n_nationkey AS rule", "true AS applies", f"{block} AS minority_rules"))


@query("""WITH g AS (SELECT p_partkey AS gold_id, p_partkey % 50 AS market_id, [p_partkey % 70 + 100] AS al, p_size AS page, p_name AS name FROM part WHERE p_partkey % 20 = 0),
    d AS (SELECT p_partkey AS passage, p_partkey % 200 AS ref, p_size AS page, p_name AS quote FROM part WHERE p_partkey % 3 = 1),
    m AS (SELECT gold_id, passage, 1 AS tier FROM g JOIN d ON market_id = ref UNION ALL SELECT gold_id, passage, 2 FROM g JOIN d ON al[1] = ref
          UNION ALL SELECT gold_id, passage, 3 FROM g JOIN d USING (page) WHERE len(list_intersect(string_split(name, ' '), string_split(quote, ' '))) > 0)
    SELECT DISTINCT gold_id, passage, tier::INT AS tier FROM m QUALIFY tier = min(tier) OVER (PARTITION BY gold_id)""")
def j23_gold_passages(spark, sf):
    p = A.table(spark, sf, "part")
    g = p.where("p_partkey % 20 = 0").selectExpr("p_partkey AS gold_id", "p_partkey % 50 AS market_id", "array(p_partkey % 70 + 100) AS alias_ids", "p_size AS page", "p_name AS name")
    d = p.where("p_partkey % 3 = 1").selectExpr("p_partkey AS passage", "array(p_partkey % 200) AS supports", "p_size AS page", "p_name AS quote")
    return I.gold_passages(g, d)


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'type' WHEN o_orderstatus = 'P' THEN 'outcome' WHEN o_orderkey % 5 = 0 THEN 'date' ELSE 'built' END AS lacks, count(*) AS n FROM orders GROUP BY 1""")
def t13_seed_records(spark, sf):
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "if(o_orderkey % 7 = 0, null, 'merger') AS type", "if(o_orderstatus = 'P', null, o_orderstatus) AS outcome", "if(o_orderkey % 5 = 0, null, to_date(o_orderdate)) AS day")
    built, rest = I.seed_records(o)
    return built.select(F.lit("built").alias("lacks")).union(rest.select("lacks")).groupBy("lacks").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, round(o_totalprice / 1000 * 1000000 / CASE o_orderkey % 4 WHEN 0 THEN 0.92 WHEN 1 THEN 1.0 WHEN 2 THEN 0.79 END, 2)::DOUBLE AS dollars FROM orders""")
def n13_unit_scaling(spark, sf):
    currency = F.expr("case o_orderkey % 4 when 0 then 'EUR' when 1 then 'USD' when 2 then 'GBP' else 'XXX' end")
    return A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(I.in_base_units(F.col("o_totalprice") / 1000, currency), 2).alias("dollars"))


@query(r"""SELECT page_id, regexp_matches(lower(url), '/(search|portal|cases)/?(\?|$)') AS portal, regexp_matches(lower(url), '/[0-9]{5,}([/?#]|$)') AS opaque, contains(lower(url), 'tionsh') AS titled FROM pages""")
def n18_url_signs(spark, sf):
    s = I.url_signs(F.col("url"), F.lit("Tionsh a of"))
    return A.table(spark, sf, "pages").select("page_id", s.alias("s")).select("page_id", "s.portal", "s.opaque", "s.titled")


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'link' END, CASE WHEN doc_id % 5 = 0 THEN 'fetch' END, CASE WHEN n_chars < 100 THEN 'pages' END], lambda x: x IS NOT NULL)) AS stage FROM documents""")
def n22_integrity_messages(spark, sf):
    d = A.table(spark, sf, "documents").selectExpr("doc_id", "if(doc_id % 4 = 0, '', 'u') AS url", "if(doc_id % 5 = 0, 404, 200) AS status", "text", "floor(n_chars / 100) AS pages")
    return I.integrity_messages(d)


@query(with_(Z.PASSAGES_SQL) + """, w AS (SELECT case_id, coalesce(string_agg(passage_id::VARCHAR, ',' ORDER BY passage_id::VARCHAR) FILTER (role = ''), '') AS unset_roles,
      coalesce(string_agg(passage_id::VARCHAR, ',' ORDER BY passage_id::VARCHAR) FILTER (page % 3 = 0 AND page % 2 = 0), '') AS untranslated FROM passages GROUP BY 1)
    SELECT * FROM w WHERE unset_roles <> '' OR untranslated <> ''""")
def n25_draft_warnings(spark, sf):
    p = Z.passages(spark, sf).selectExpr("case_id", "passage_id", "role", "if(page % 3 = 0, 'fr', 'en') AS language", "if(page % 2 = 0, '', 'x') AS translation")
    return I.draft_warnings(p)


@query("SELECT kind, sum(n)::BIGINT AS n FROM (SELECT 'dangling' AS kind, count(*) AS n FROM (" + Z.ORACLES["j11_dangling_support"] + ") UNION ALL SELECT 'complaint_only', count(*) FROM (" + Z.ORACLES["j12_complaint_only_support"] + ")) GROUP BY 1")
def g02_semantic_lint(spark, sf):
    a = Z.j11_dangling_support(spark, sf).select(F.lit("dangling").alias("kind"))
    return a.union(Z.j12_complaint_only_support(spark, sf).select(F.lit("complaint_only"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT p_size AS rule, p_partkey % 3 = 0 AS stale, p_partkey AS checked FROM part WHERE p_partkey % 11 = 0), g AS (SELECT rule, NOT bool_or(stale) AS ok, max(checked) AS c FROM r GROUP BY 1)
    SELECT s.rule, CASE WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'fresh' ELSE 'stale' END AS freshness_status, CASE WHEN ok THEN c END AS verified_at FROM (SELECT DISTINCT p_size AS rule FROM part WHERE p_size % 2 = 0) s LEFT JOIN g USING (rule)""")
def g15_rule_freshness(spark, sf):
    p = A.table(spark, sf, "part")
    rules = p.selectExpr("p_size AS rule", "p_size % 2 = 0 AS annual").distinct()
    results = p.where("p_partkey % 11 = 0").selectExpr("p_size AS rule", "if(p_partkey % 3 = 0, 'stale', 'fresh') AS status", "p_partkey AS checked")
    return I.freshness(rules, results)


@query("""SELECT 'document' AS kind, page_id AS owner, 'url' AS field, url FROM pages UNION ALL SELECT 'document', page_id, 'pdf_url', url || '.pdf' FROM pages WHERE page_id % 2 = 0
    UNION ALL SELECT 'event', event_id, 'source_url', 'e/' || event_id FROM events WHERE event_type = 'view'""")
def g17_link_inventory(spark, sf):
    d = A.table(spark, sf, "pages").selectExpr("page_id AS owner", "url", "if(page_id % 2 = 0, concat(url, '.pdf'), '') AS pdf_url")
    e = A.table(spark, sf, "events").selectExpr("event_id AS owner", "if(event_type = 'view', concat('e/', event_id), null) AS source_url")
    return I.link_inventory({"document": d, "event": e}, ["url", "pdf_url", "source_url"])


@query("""SELECT p_partkey AS id, 'status' AS rule FROM part WHERE p_partkey % 6 = 5""")
def g19_merged_validation(spark, sf):
    p = A.table(spark, sf, "part").selectExpr("p_partkey AS id", "case when p_partkey % 6 = 5 then 'odd' when p_partkey % 6 = 4 then 'draft' end AS status", "p_name AS name", "'x' AS _draft_note")
    return I.validated(p, "id", ["_draft_note"], {"status": "draft"}, {"status": F.col("status") == "draft", "name": F.length("name") > 0})


@query(with_(A.PAGES_SQL) + r""", c AS (SELECT doc_id || ':' || (page_number - 1) // 4 AS chunk_id, page_number, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, doc_id * 100000 + page_number AS id, doc_id % 7 AS k FROM text_pages),
    q AS (SELECT id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'none' ELSE chunk_id END AS chunk_id, CASE k WHEN 2 THEN 0 WHEN 3 THEN page_number + 1 WHEN 4 THEN page_number + 4 ELSE page_number END AS page,
             CASE k WHEN 5 THEN text || ' zz' WHEN 6 THEN substring(text, 1, 400) || '. And so it' ELSE text END AS quote, k FROM c WHERE length(text) > 30),
    f AS (SELECT *, CASE WHEN chunk_id = '' THEN 'missing_chunk' WHEN page = 0 THEN 'missing_page'
            WHEN length(trim(quote, ' ')) >= 50 AND regexp_matches(trim(quote, ' '), '[.!?]\s+\S') AND NOT regexp_matches(trim(quote, ' '), '[.!?"”)]\s*$') THEN 'truncated' END AS flaw, trim(regexp_replace(quote, '\s+', ' ', 'g')) AS n FROM q),
    g AS (SELECT f.id, any_value(flaw) AS flaw, any_value(page) AS page, count(c.id) AS pages, coalesce(bool_or(c.page_number = page), FALSE) AS listed, coalesce(bool_or(c.page_number = page AND contains(t, n)), FALSE) AS cited,
            min(c.page_number) FILTER (contains(t, n)) AS other FROM f LEFT JOIN c USING (chunk_id) GROUP BY 1),
    v AS (SELECT *, coalesce(flaw, CASE WHEN pages = 0 THEN 'unknown_chunk' WHEN NOT listed THEN 'unknown_page' WHEN cited THEN 'ok' WHEN other IS NOT NULL THEN 'corrected' ELSE 'not_found' END) AS verdict FROM g)
    SELECT id AS passage_id, verdict, CASE verdict WHEN 'ok' THEN page WHEN 'corrected' THEN other END::INT AS page, CASE WHEN id % 2 = 0 THEN 'precedent' ELSE '' END AS role, CASE WHEN id % 3 = 0 THEN 'fra' ELSE '' END AS language FROM v""")
def g07_chunk_quotes(spark, sf):
    """A quote of each page of some text from its chunk of four pages, with a flaw of each kind in turn."""
    p = A.text_pages(spark, sf).withColumn("chunk_id", F.concat_ws(":", "doc_id", F.floor((F.col("page_number") - 1) / 4)))
    k = "doc_id % 7"
    chunk = f"case {k} when 0 then '' when 1 then 'none' else chunk_id end AS chunk_id"
    page = f"cast(case {k} when 2 then 0 when 3 then page_number + 1 when 4 then page_number + 4 else page_number end AS int) AS page"
    quote = f"case {k} when 5 then concat(text, ' zz') when 6 then concat(substring(text, 1, 400), '. And so it') else text end AS quote"
    said = ("if((doc_id * 100000 + page_number) % 2 = 0, 'precedent', 'hearsay') AS role", "if((doc_id * 100000 + page_number) % 3 = 0, 'fra', 'fr') AS language")
    q = p.where("length(text) > 30").selectExpr("doc_id * 100000 + page_number AS passage_id", chunk, page, quote, *said)
    return I.chunk_quotes(q, p.select("chunk_id", "page_number", "text"))


@query("""SELECT page_id, '/case/' || page_id AS url, 'Case ' || page_id AS title, '2024-02-01' AS day FROM pages WHERE page_id % 3 <> 0""")
def s14_listing_rows(spark, sf):
    row = lambda kind: F.concat(F.lit('<div class="views-row"><a href="/case/'), "page_id", F.lit('">Case '), "page_id", F.lit('</a> <time> 2024-02-01</time><span class="type">'), kind, F.lit("</span></div>"))
    html = F.concat(F.coalesce("html", F.lit("")), row(F.expr("if(page_id % 3 = 0, 'Press', 'Merger')")), F.lit("<p>x</p>"), row(F.lit("Speech")))
    return I.listing_rows(A.table(spark, sf, "pages").select("page_id", html.alias("html")), "Merger")


@query(with_(Z.PARTS_SQL) + """ SELECT case_id AS batch, case_id, count(*) AS drafts, coalesce(arg_min(brand, seq) FILTER (brand <> '' AND draft = 1), arg_min(brand, seq) FILTER (brand <> '')) AS brand FROM d GROUP BY 1""")
def a33_merged_drafts(spark, sf):
    d = Z.part_drafts(spark, sf).withColumn("batch", F.col("case_id"))
    return I.merged_drafts(d, "batch", "case_id", "seq", ["brand"], F.col("draft") == 1)


@query("""SELECT p_size AS unit, count(*) FILTER (p_type IN ('ECONOMY', 'SMALL')) AS known, count(*) FILTER (p_type NOT IN ('ECONOMY', 'SMALL')) AS other FROM part WHERE p_partkey % 4 <> 0 AND p_size % 5 <> 0 GROUP BY 1""")
def g08_unit_findings(spark, sf):
    f = F.collect_list(F.struct(F.col("p_type").alias("kind"), F.expr("if(p_partkey % 4 = 0, ' ', p_name)").alias("description")))
    u = A.table(spark, sf, "part").groupBy(F.col("p_size").alias("unit")).agg(f.alias("findings"), F.expr("if(first(p_size) % 5 = 0, '', 'u')").alias("label"))
    u = I.unit_findings(u, ["ECONOMY", "SMALL"]).select("unit", F.explode("findings").alias("f"))
    return u.groupBy("unit").agg(F.count_if(F.col("f.kind") != "other").alias("known"), F.count_if(F.col("f.kind") == "other").alias("other"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS market_id, p_name || ' supply' AS n, p_partkey % 6 AS k FROM part), d AS (SELECT market_id, lower(n) AS k, min(id) AS id FROM p WHERE k < 4 AND id % 35 <> 1 GROUP BY 1, 2)
    SELECT d.market_id, n AS alias, d.id AS passage_id FROM d JOIN p USING (id) WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size = d.market_id AND o.p_partkey % 7 = 0 AND lower(o.p_name || ' supply') = d.k)""")
def t19_alias_phrases(spark, sf):
    """Parts as passages of markets by size that name a market in one of four ways, are clauses, or run over a list; every seventh part is a market of its own name."""
    quote = """case when p_partkey % 35 = 1 then 'The market for it must be wide.' else case p_partkey % 6 when 0 then concat('Here the relevant product market is a ', p_name, ' supply, as said')
        when 1 then concat('An overall market for the ', p_name, ' supply') when 2 then concat('the relevant geographic market for ', p_name, ' supply; so') when 3 then concat('There is a Market For ', p_name, ' supply.')
        when 4 then concat('a market for ', p_name, ' that would do.') else concat('the market for (i) ', p_name, ' and (ii) more.') end end"""
    p = A.table(spark, sf, "part")
    passages = p.selectExpr("p_size AS market_id", "p_partkey AS passage_id", f"{quote} AS quote")
    return I.alias_phrases(p.where("p_partkey % 7 = 0").selectExpr("p_size AS market_id", "concat(p_name, ' Supply') AS name"), passages)


@query("""WITH m AS (SELECT p_partkey AS id, ['background', 'ancillary', 'core_assessed', 'assessed_no_overlap', 'incomplete_source', ''][1 + p_partkey % 6] AS imp,
      ['defined', 'left_open', 'unknown', 'segmented', 'mentioned'][1 + p_partkey % 5] AS st, p_partkey % 2 = 0 AS refs FROM part)
    SELECT id, CASE WHEN imp = 'background' THEN 'exclude_from_canonical' WHEN imp IN ('ancillary', 'assessed_no_overlap') THEN 'keep_as_context_only' WHEN imp = 'incomplete_source' THEN 'hold_pending_source_check'
      WHEN st = 'unknown' AND NOT refs THEN 'hold_pending_source_check' WHEN st = 'segmented' THEN 'promote_with_uncertainty' WHEN imp = 'core_assessed' AND st IN ('defined', 'left_open') AND refs THEN 'promote_to_canonical' ELSE 'manual_review' END AS action FROM m""")
def n23_promotion_actions(spark, sf):
    imp = F.element_at(F.lit(["background", "ancillary", "core_assessed", "assessed_no_overlap", "incomplete_source", ""]), (1 + F.col("p_partkey") % 6).cast("int"))
    st = F.element_at(F.lit(["defined", "left_open", "unknown", "segmented", "mentioned"]), (1 + F.col("p_partkey") % 5).cast("int"))
    return A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), E.promotion_action(imp, st, F.col("p_partkey") % 2 == 0).alias("action"))


@query("""WITH m AS (SELECT p_size::BIGINT AS c, p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'geographic' ELSE 'product' END AS kind, ['core_assessed', 'core_assessed', 'core_assessed', 'background', ''][1 + p_partkey % 5] AS imp,
      ['defined', 'left_open', 'considered', 'segmented'][1 + (p_partkey // 5) % 4] AS st, lower(p_name) || CASE WHEN p_partkey % 3 = 0 THEN ' zone' || p_partkey ELSE '' END AS name FROM part),
    p AS (SELECT l_partkey AS id, bool_or(l_quantity > 10) AS refs, bool_or(l_returnflag = 'A' AND l_suppkey % 4 = 0) AS firm FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY 1),
    k AS (SELECT (o_orderkey % 60)::BIGINT AS c, bool_or(o_orderkey % 60 % 4 = 0) AS lacks FROM orders GROUP BY 1),
    w AS (SELECT DISTINCT c, unnest(regexp_split_to_array(CASE WHEN id % 3 = 1 THEN name ELSE 'other ' || id END, '\\s+')) AS x FROM m WHERE kind = 'product'),
    g AS (SELECT DISTINCT m.c, m.id FROM (SELECT c, id, unnest(regexp_split_to_array(name, '\\s+')) AS x FROM m WHERE kind = 'geographic') m JOIN w ON w.c = m.c AND w.x = m.x),
    b AS (SELECT m.*, firm, coalesce(lacks, FALSE) AS lacks, g.id IS NOT NULL AS paired, CASE WHEN imp = 'background' THEN 'exclude_from_canonical' WHEN st = 'segmented' THEN 'promote_with_uncertainty'
        WHEN imp = 'core_assessed' AND coalesce(refs, FALSE) THEN 'promote_to_canonical' ELSE 'manual_review' END AS base FROM m LEFT JOIN p USING (id) LEFT JOIN k USING (c) LEFT JOIN g ON g.c = m.c AND g.id = m.id),
    r AS (SELECT *, CASE WHEN base = 'promote_to_canonical' AND firm = FALSE THEN 'role' WHEN base LIKE 'promote%' AND lacks AND st IN ('left_open', 'considered') THEN 'caveat' WHEN base LIKE 'promote%' AND kind = 'geographic' AND NOT paired THEN 'pairing' END AS guard FROM b)
    SELECT c AS case_id, id AS market_id, kind, CASE WHEN guard IN ('role', 'caveat') THEN 'hold_pending_source_check' WHEN guard = 'pairing' THEN 'manual_review_geo_pairing' ELSE base END AS action, guard FROM r""")
def n23_promotion_plan(spark, sf):
    """Parts as draft markets of cases by size, line items as their passages, orders as caveats; every third part is a place."""
    p = A.table(spark, sf, "part")
    pick = lambda values, at: F.element_at(F.lit(values), (1 + at).cast("int"))
    kind = F.expr("if(p_partkey % 3 = 0, 'geographic', 'product')")
    name = F.expr("case p_partkey % 3 when 0 then concat(p_name, ' zone', p_partkey) when 1 then p_name else concat('other ', p_partkey) end")
    m = p.select(
        F.col("p_size").cast("long").alias("case_id"), F.col("p_partkey").alias("market_id"), kind.alias("kind"), pick(["core_assessed", "core_assessed", "core_assessed", "background", ""], F.col("p_partkey") % 5).alias("importance"),
        pick(["defined", "left_open", "considered", "segmented"], F.floor(F.col("p_partkey") / 5) % 4).alias("status"), name.alias("name"),
    )
    li = A.table(spark, sf, "lineitem").where("l_partkey % 7 <> 0").join(p, F.col("l_partkey") == F.col("p_partkey"))
    role = F.expr("if(l_returnflag = 'A' and l_suppkey % 4 = 0, 'conclusion', 'precedent')")
    passages = li.select(F.col("p_size").cast("long").alias("case_id"), F.expr("if(l_quantity > 10, '7', ' ')").alias("page"), role.alias("role"), F.array("l_partkey").alias("supports"))
    caveats = A.table(spark, sf, "orders").selectExpr("o_orderkey % 60 AS case_id", "if(o_orderkey % 60 % 4 = 0, 'The text is Cut Off', 'fine') AS caveat")
    return E.promotion_plan(m, passages, caveats)


@query("""WITH p AS (SELECT l_partkey AS item, count(*) AS n, max(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.6 ELSE 0.2 END) AS role FROM lineitem GROUP BY 1)
    SELECT p_partkey AS item, round(CASE WHEN n > 0 THEN 3.0 ELSE 0 END + 2 * least(coalesce(n, 0) / 3.0, 1) + 2 * coalesce(role, 0) + 1.5 * CASE p_type WHEN 'ECONOMY' THEN 1.0 ELSE 0.3 END + CASE p_brand WHEN 'Brand#1' THEN 1.0 ELSE 0 END
      + 0.5 * 0.5 + 0.25 * least(p_size / 5.0, 1), 6)::DOUBLE AS score FROM part LEFT JOIN p ON item = p_partkey""")
def n24_review_scores(spark, sf):
    w = {"role": {"A": 1.0, "N": 0.6, "default": 0.2}, "importance": {"ECONOMY": 1.0, "default": 0.3}, "status": {"Brand#1": 1.0}, "category": {"x": 0.5}}
    entries = A.table(spark, sf, "part").selectExpr("p_partkey AS item", "p_type AS importance", "p_brand AS status", "'x' AS category", "p_size AS source_refs")
    passages = A.table(spark, sf, "lineitem").selectExpr("l_partkey AS item", "l_returnflag AS role")
    return E.review_score(entries, passages, w).withColumn("score", F.round("score", 6))
