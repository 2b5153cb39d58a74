"""Queries of sources, rule checks, matching and the remaining record operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from caseloom.functions import text as T
from caseloom.operators import catalog as C
from caseloom.operators import checks as K
from caseloom.operators import evals as E
from caseloom.operators import grounding as G
from caseloom.operators import matching as M
from caseloom.operators import nearest as N
from caseloom.operators import sections as S
from caseloom.plans.catalog import with_
from caseloom.plans.text import TOK
from caseloom.sources import adapters as A
from caseloom.sources import tables as R

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ sources


@query("""SELECT o_custkey AS id, arg_min(o_orderstatus, o_orderkey) AS outcome, arg_min(o_orderdate::DATE, o_orderkey) AS day,
    (SELECT string_agg(p, ',' ORDER BY k) FROM (SELECT o_orderpriority AS p, min(o_orderkey) AS k FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY 1)) AS codes FROM orders o GROUP BY o_custkey""")
def s11_folded_rows(spark, sf):
    o = A.table(spark, sf, "orders").selectExpr("o_custkey AS id", "o_orderkey AS seq", "o_orderpriority AS code", "o_orderstatus AS outcome", "to_date(o_orderdate) AS day")
    return R.folded(o, "id", "seq", "code", ["outcome", "day"]).withColumn("codes", F.array_join("codes", ","))


@query("""SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM conversations GROUP BY 1""")
def s16_conversation_history(spark, sf):
    return R.histories(A.table(spark, sf, "conversations")).withColumn("history", F.array_join("history", "\n"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS name, p_brand AS brand FROM part")
def s17_field_upsert(spark, sf):
    p = A.table(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_brand AS brand")
    return R.field_upserted(p, p.where("id % 4 = 0").selectExpr("id", "upper(name) AS name"), "id", "name")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_name END AS name FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 = 0")
def s07_keyed_upsert(spark, sf):
    p = A.table(spark, sf, "part")
    return R.upserted(p.where("p_partkey % 2 = 0").selectExpr("p_partkey AS id", "p_name AS name"), p.where("p_partkey % 5 = 0").selectExpr("p_partkey AS id", "p_type AS name"), "id")


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 4 ELSE 0 END::INT AS tier, CASE WHEN n_nationkey % 3 = 0 THEN 'passed' ELSE 'not_run' END AS regression_status,
    'unknown' AS freshness_status FROM nation""")
def s06_rule_sidecars(spark, sf):
    n = A.table(spark, sf, "nation").selectExpr("n_nationkey AS id")
    side = n.where("id % 3 = 0").selectExpr("id", "cast(id % 4 AS int) AS tier", "'passed' AS regression_status", "cast(null AS string) AS freshness_status")
    return R.with_sidecar(n, side, "id")


@query(with_(A.PAGES_SQL) + " SELECT doc_id, count(*) AS pages, sum(length(text))::BIGINT AS chars FROM text_pages GROUP BY 1")
def s22_page_counts(spark, sf):
    return R.page_counts(A.text_pages(spark, sf))


@query("SELECT CASE WHEN event_type = 'error' THEN 'errors' WHEN value > 20 THEN 'written' WHEN value > 5 THEN 'built' ELSE 'skipped' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def s20_write_outcomes(spark, sf):
    e = A.table(spark, sf, "events")
    return R.outcomes(e, F.when(F.col("event_type") == "error", "errors").when(F.col("value") > 20, "written").when(F.col("value") > 5, "built").otherwise("skipped"))


# ------------------------------------------------------------------ projections


@query(with_(A.CASES_SQL) + " SELECT case_id, case_name, jurisdiction, authority, strftime(decision_date, '%Y-%m-%d') AS decision_date, sector, outcome FROM cases WHERE layer = 'canonical'")
def p10_graph_properties(spark, sf):
    c = A.cases(spark, sf).where("layer = 'canonical'")
    return c.select("case_id", "case_name", "jurisdiction", "authority", F.date_format("decision_date", "yyyy-MM-dd").alias("decision_date"), "sector", "outcome")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE lower(n_name) LIKE '%_1%' ESCAPE '!' AND contains(lower(n_name), '_1')")
def p14_sidebar_filter(spark, sf):
    n = A.table(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_name AS name")
    return n.where(F.contains(F.lower("name"), F.lit("_1"))).orderBy("name")


@query(with_(A.MARKETS_SQL, A.CASES_SQL) + """, m AS (SELECT lower(trim(name)) AS key, list_distinct(list(sector)) AS sectors FROM markets JOIN cases USING (case_id) GROUP BY 1)
    SELECT key, len(sectors) AS n FROM m WHERE list_contains(sectors, '2-HIGH')""")
def p16_sector_view(spark, sf):
    m = A.markets(spark, sf).join(A.cases(spark, sf), "case_id").groupBy(C.name_key(F.col("name")).alias("key")).agg(F.collect_set("sector").alias("sectors"))
    return m.where(F.array_contains("sectors", "2-HIGH")).select("key", F.size("sectors").cast("long").alias("n"))


@query(with_(A.PAGES_SQL) + r""" SELECT doc_id, page_number, length(text) >= 50 AND regexp_matches(text, '[.!?]\s+\S') AND NOT regexp_matches(text, '[.!?"”)]\s*$') AS truncated FROM text_pages""")
def p24_truncated_quotes(spark, sf):
    p = A.text_pages(spark, sf)
    cut = (F.length("text") >= 50) & F.col("text").rlike(r"[.!?]\s+\S") & ~F.col("text").rlike(r'[.!?"”)]\s*$')
    return p.select("doc_id", "page_number", cut.alias("truncated"))


@query(with_(A.PAGES_SQL) + r""" SELECT doc_id, count(*) FILTER (len(regexp_extract_all(replace(text, ' ', '.... '), '\.{4,}')) >= 4) AS toc_like FROM text_pages GROUP BY 1""")
def p23_contents_pages(spark, sf):
    """Each blank of a page's text stands for a leader, as driver text has none."""
    p = A.text_pages(spark, sf).withColumn("text", F.replace("text", F.lit(" "), F.lit(".... ")))
    return p.groupBy("doc_id").agg(F.count_if(T.is_contents(F.col("text"))).alias("toc_like"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'NO_REVIEW' WHEN o_orderkey % 5 = 1 THEN 'UNKNOWN' ELSE CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'WARNINGS' ELSE 'BLOCKED' END END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN 'NO_REVIEW' WHEN o_orderkey % 5 < 3 THEN 'UNKNOWN' ELSE 'WARN' END AS readiness, (o_orderkey % 4)::INT AS markets FROM orders""")
def p31_review_status(spark, sf):
    """Review texts of orders: none, without a status, with one, with a readiness line too; and their records' raw text."""
    word = "case o_orderstatus when 'F' then 'Pass' when 'O' then 'warnings' else 'Blocked' end"
    text = f"""case o_orderkey % 5 when 0 then null when 1 then 'no status here\\nStatus: PASS' when 2 then concat('# Review\\n  **Status: ', {word}, '**\\n**Status: ERROR**')
        else concat('**Status: ', {word}, '**\\nwords\\n## Readiness: warn (2 issues)') end"""
    entry = "repeat('  - market_id: m\\n    name: x\\n', cast(o_orderkey % 4 AS int))"
    record = f"concat('case_id: c\\nproduct_markets_considered:\\n', {entry}, 'geographic_markets_considered:\\n  - market_id: g\\n')"
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{text} AS text", f"{record} AS record")
    return o.select("id", K.review_status(F.col("text")).alias("status"), K.packet_readiness(F.col("text")).alias("readiness"), K.market_count(F.col("record")).alias("markets"))


# ------------------------------------------------------------------ joins and matching


@query(with_(A.MARKETS_SQL) + """, k AS (SELECT *, lower(trim(name)) AS key FROM markets), f AS (SELECT lower(trim(name)) AS q FROM markets ORDER BY seq LIMIT 1),
    s AS (SELECT DISTINCT case_id FROM k, f WHERE key = q), c AS (SELECT key, count(DISTINCT case_id) AS n, min(seq) AS s FROM k, f WHERE key <> q AND case_id IN (FROM s) GROUP BY 1),
    v AS (SELECT vec_id AS id, [x::DOUBLE for x in embedding] AS e FROM embeddings), w AS (SELECT v.id, round(list_cosine_similarity(q.e, v.e), 12) AS s FROM v, (SELECT * FROM v WHERE id = 0) q WHERE v.id <> 0),
    t AS (SELECT * FROM w ORDER BY s DESC, id LIMIT 8), b AS (SELECT lower(trim(p_brand)) AS key, min(rn) AS r FROM (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS rn FROM t) JOIN part ON id = p_partkey GROUP BY 1),
    u AS (SELECT key, 0 AS src, row_number() OVER (ORDER BY n DESC, s) AS r FROM c UNION ALL SELECT key, 1, r FROM b WHERE key NOT IN (SELECT key FROM c) AND key NOT IN (SELECT q FROM f))
    SELECT key, CASE src WHEN 0 THEN 'cooccurrence' ELSE 'semantic' END AS origin FROM u ORDER BY src, r LIMIT 8""")
def j08_similar_names(spark, sf):
    """Markets of the same cases as the first market's, then brands by the nearest vectors to the first vector."""
    m = A.markets(spark, sf)
    name = m.orderBy("seq").first()["name"]
    v = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = N.top_k(v, v.where("id = 0"), 9, -1.0).where("id <> query_id").join(A.table(spark, sf, "part"), F.col("id") == F.col("p_partkey")).select(F.col("p_brand").alias("name"), "rank")
    return N.names_of_both(C.cooccurring(m, name), hits, name, 8)


@query("""WITH c AS (SELECT DISTINCT p_size AS rule, p_partkey % 7 AS cond FROM part WHERE p_partkey % 2 = 0), s AS (SELECT DISTINCT p_size AS rule, p_partkey % 9 AS cond FROM part WHERE p_partkey % 3 = 0)
    SELECT rule, cond, 'orphan' AS issue FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rule = s.rule AND c.cond = s.cond)
    UNION ALL SELECT rule, cond, 'uncovered' FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE c.rule = s.rule AND c.cond = s.cond)""")
def j13_condition_coverage(spark, sf):
    p = A.table(spark, sf, "part")
    conditions = p.where("p_partkey % 2 = 0").selectExpr("p_size AS rule", "p_partkey % 7 AS cond").distinct()
    supports = p.where("p_partkey % 3 = 0").selectExpr("p_size AS rule", "p_partkey % 9 AS cond").distinct()
    lost = supports.join(conditions, ["rule", "cond"], "left_anti").withColumn("issue", F.lit("orphan"))
    return lost.unionByName(conditions.join(supports, ["rule", "cond"], "left_anti").withColumn("issue", F.lit("uncovered")))


def named(spark, sf):
    p = A.table(spark, sf, "part")
    existing = p.where("p_partkey % 2 = 0").selectExpr("cast(p_size AS bigint) AS case_id", "p_type AS kind", "p_partkey AS item", "p_name AS name")
    drafts = p.where("p_partkey % 2 = 1").selectExpr("cast(p_size AS bigint) AS case_id", "p_type AS kind", "p_partkey AS draft", "p_name AS draft_name")
    return existing, drafts


@query()
def j17_reconciliation(spark, sf):
    return M.reconciled(*named(spark, sf))


@query()
def j19_additions(spark, sf):
    existing, drafts = named(spark, sf)
    return M.additions(drafts, M.reconciled(existing, drafts))


@query("""WITH a AS (SELECT p_size::BIGINT AS case_id, p_partkey AS item, unnest(list_distinct(string_split(lower(p_name), ' '))) AS t FROM part WHERE p_partkey % 2 = 0),
    b AS (SELECT p_size::BIGINT AS case_id, p_partkey AS draft, unnest(list_distinct(string_split(lower(p_name), ' '))) AS t FROM part WHERE p_partkey % 2 = 1),
    p AS (SELECT DISTINCT a.case_id, item, draft FROM a JOIN b ON a.case_id = b.case_id AND a.t = b.t WHERE a.t <> 'red')
    SELECT case_id, item, string_agg(draft::VARCHAR, ',' ORDER BY draft) AS paired FROM p GROUP BY 1, 2""")
def j24_token_pairs(spark, sf):
    existing, drafts = named(spark, sf)
    return M.token_pairs(existing.select("case_id", "item", "name"), drafts.withColumnRenamed("draft_name", "name").select("case_id", "draft", "name"), "item", "draft", ["red"])


@query(f"""WITH a AS (SELECT p_size::BIGINT AS case_id, p_partkey AS item, list_distinct({TOK.format('p_name')}) AS x FROM part WHERE p_partkey % 2 = 0),
    b AS (SELECT p_size::BIGINT AS case_id, p_partkey AS draft, list_distinct({TOK.format('p_name')}) AS y FROM part WHERE p_partkey % 2 = 1),
    p AS (SELECT case_id, item, draft, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS o FROM a JOIN b USING (case_id) WHERE len(list_intersect(x, y)) > 0)
    SELECT case_id, item, draft, row_number() OVER (PARTITION BY case_id, item ORDER BY o DESC, draft)::INT AS rank, round(o, 6) AS overlap FROM p QUALIFY rank <= 5""")
def k08_nearest_names(spark, sf):
    existing, drafts = named(spark, sf)
    return M.nearest_names(existing.drop("kind"), drafts.drop("kind"))


@query()
def w16_diverse_picks(spark, sf):
    p = A.table(spark, sf, "part").selectExpr("cast(p_size AS bigint) AS case_id", "p_partkey AS item", "p_type AS status", "p_retailprice / 1000 AS score")
    return M.diverse(p, 4)


@query()
def w18_greedy_merge(spark, sf):
    p = A.table(spark, sf, "part").selectExpr("cast(p_size AS bigint) AS case_id", "p_type AS kind", "p_partkey AS item", "p_name AS name", "cast(p_partkey % 4 AS int) AS valid")
    return M.greedy_merged(p)


@query("""WITH l AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_totalprice AS value, o_totalprice * (1 + (o_orderkey % 4 - 1) / 100.0) AS anchor FROM orders WHERE o_orderkey % 10 < 8)
    SELECT o_orderkey AS id, CASE WHEN l.id IS NULL THEN 'missing' WHEN abs(value - anchor) > greatest(abs(anchor) * 0.005, 1) THEN 'stale' WHEN date_diff('day', day, DATE '1999-01-01') > 700 THEN 'unverified' ELSE 'fresh' END AS status
    FROM orders LEFT JOIN l ON l.id = o_orderkey""")
def j25_anchor_staleness(spark, sf):
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "to_date(o_orderdate) AS day", "o_totalprice AS value")
    anchors = o.where("id % 10 < 8").selectExpr("id", "value * (1 + (id % 4 - 1) / 100.0D) AS anchor")
    d = o.join(anchors, "id", "left")
    status = F.when(F.col("anchor").isNull(), "missing").when(~T.within(F.col("value"), F.col("anchor"), 0.005), "stale").when(T.stale(F.col("day"), F.lit("1999-01-01").cast("date"), 700), "unverified").otherwise("fresh")
    return d.select("id", status.alias("status"))


@query("""WITH u AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS key FROM pages), s AS (SELECT key, CASE WHEN length(key) % 3 = 0 THEN key || '/final' END AS final FROM (SELECT DISTINCT key FROM u))
    SELECT page_id, coalesce(final, url) AS url FROM u JOIN s USING (key)""")
def j26_resolved_urls(spark, sf):
    """Distinct links are resolved once and written back to all that have them."""
    u = A.table(spark, sf, "pages").select("page_id", "url", F.regexp_replace("url", "[?#].*$", "").alias("key"))
    status = u.select("key").distinct().withColumn("final", F.when(F.length("key") % 3 == 0, F.concat("key", F.lit("/final"))))
    return u.join(status, "key", "left").select("page_id", F.coalesce("final", "url").alias("url"))


@query("""WITH k(seq, key, source) AS (VALUES (1, 'blog.', 'blog'), (2, '/fr/', 'french'), (3, 'example.com', 'site'))
    SELECT page_id, coalesce(arg_min(source, seq), 'unsupported') AS source FROM pages LEFT JOIN k ON contains(url, key) GROUP BY 1""")
def j30_source_by_key(spark, sf):
    keys = spark.createDataFrame([(1, "blog.", "blog"), (2, "/fr/", "french"), (3, "example.com", "site")], "seq int, key string, source string")
    p = A.table(spark, sf, "pages").select("page_id", "url").join(F.broadcast(keys), F.contains(F.col("url"), F.col("key")), "left")
    return p.groupBy("page_id").agg(F.coalesce(F.min_by("source", "seq"), F.lit("unsupported")).alias("source"))


@query("""SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_name END, CASE WHEN p_partkey % 3 = 1 THEN p_type END, 'M.' || p_partkey) AS name FROM part""")
def j31_case_name_fallback(spark, sf):
    p = A.table(spark, sf, "part").selectExpr("p_partkey AS id", "if(p_partkey % 3 = 0, concat('Case: ', p_name), 'untitled') AS title")
    filed = A.table(spark, sf, "part").where("p_partkey % 3 = 1").selectExpr("p_partkey AS id", "concat('Notified concentration: ', p_type) AS text")
    named_in = lambda c, mark: F.nullif(F.regexp_extract(c, f"^{mark}: (.*)$", 1), F.lit(""))
    d = p.join(filed, "id", "left")
    return d.select("id", F.coalesce(named_in("title", "Case"), named_in("text", "Notified concentration"), F.concat(F.lit("M."), "id")).alias("name"))


# ------------------------------------------------------------------ aggregates


@query("""SELECT CASE WHEN grouping(p_type) = 1 THEN 'all' ELSE p_type END AS rule, count(*) AS conditions, count(*) FILTER (p_size > 25) AS primary_sources, count(DISTINCT p_brand) AS tests FROM part GROUP BY ROLLUP (p_type)""")
def a09_rule_coverage(spark, sf):
    p = A.table(spark, sf, "part").rollup("p_type").agg(F.count("*").alias("conditions"), F.count_if(F.col("p_size") > 25).alias("primary_sources"), F.count_distinct("p_brand").alias("tests"), F.grouping("p_type").alias("g"))
    return p.select(F.when(F.col("g") == 1, "all").otherwise(F.col("p_type")).alias("rule"), "conditions", "primary_sources", "tests")


@query("""SELECT n_nationkey AS rule, unnest(list_filter([CASE WHEN n_nationkey % 2 = 0 THEN 'needs_suspensory' END, CASE WHEN n_nationkey % 5 = 0 THEN 'needs_fees' END], lambda x: x IS NOT NULL)) AS violation FROM nation""")
def a11_archetype_checks(spark, sf):
    """Rules and the flags of their archetype that they lack."""
    rules = A.table(spark, sf, "nation").selectExpr("n_nationkey AS rule", "n_nationkey % 2 = 1 AS suspensory", "n_nationkey % 5 <> 0 AS fees")
    return _as_violation(rules)


def _as_violation(rules):
    v = K.violations(rules.withColumnRenamed("rule", "id"), "id", {"needs_suspensory": F.col("suspensory"), "needs_fees": F.col("fees")})
    return v.select(F.col("id").alias("rule"), F.col("rule").alias("violation"))


@query("""WITH v AS (SELECT n_nationkey AS rule, (n_nationkey % 2 = 0)::INT + (n_nationkey % 5 = 0)::INT AS n FROM nation)
    SELECT rule, n::BIGINT AS violations, n = 0 AS passed, CASE WHEN n = 0 THEN greatest(rule % 4, 3) ELSE least(rule % 4, 2) END::INT AS tier FROM v""")
def a13_profile_verdict(spark, sf):
    """Passed without violations; that lifts the tier to 3 at least, a violation holds it at 2 at most."""
    rules = A.table(spark, sf, "nation").selectExpr("n_nationkey AS rule", "n_nationkey % 2 = 1 AS suspensory", "n_nationkey % 5 <> 0 AS fees")
    n = _as_violation(rules).groupBy("rule").agg(F.count("*").alias("violations"))
    d = rules.join(n, "rule", "left").withColumn("violations", F.coalesce("violations", F.lit(0)).cast("long"))
    tier = F.when(F.col("violations") == 0, F.greatest(F.col("rule") % 4, F.lit(3))).otherwise(F.least(F.col("rule") % 4, F.lit(2)))
    return d.select("rule", "violations", (F.col("violations") == 0).alias("passed"), tier.cast("int").alias("tier"))


@query("""WITH e AS (SELECT event_type AS kind, CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_type = 'error' THEN [404, 403, 500, 400][1 + event_id % 4] ELSE 200 END AS status,
      CASE WHEN event_id % 46 = 0 THEN 'SSL: no certificate' WHEN event_id % 23 = 0 THEN 'timed out' END AS error, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS r, value / 10 > 8 AS slow FROM events),
    f AS (SELECT *, coalesce(status IN (400, 403), FALSE) AS g, coalesce(contains(error, 'SSL:'), FALSE) AS u FROM e), b AS (SELECT *, NOT g AND NOT u AND (error IS NOT NULL OR coalesce(status >= 400, FALSE)) AS b FROM f)
    SELECT kind, count(*) AS links, count(*) FILTER (b) AS broken, count(*) FILTER (r > 0 AND NOT b AND NOT g) AS redirected, count(*) FILTER (g) AS bot_protected, count(*) FILTER (u) AS ssl_uncertain,
      count(*) FILTER (slow AND NOT b) AS slow, count(*) FILTER (NOT b AND NOT (r > 0 AND NOT g) AND NOT g AND NOT u) AS ok FROM b GROUP BY 1""")
def a45_url_classes(spark, sf):
    """Every event as a check of a link; errors have four statuses, and some checks no answer."""
    status = "case when event_id % 23 = 0 then null when event_type = 'error' then element_at(array(404, 403, 500, 400), cast(1 + event_id % 4 AS int)) else 200 end"
    error = "case when event_id % 46 = 0 then 'SSL: no certificate' when event_id % 23 = 0 then 'timed out' end"
    e = A.table(spark, sf, "events").selectExpr("event_type AS kind", f"{status} AS status", f"{error} AS error", "if(event_id % 3 = 0, 2, 0) AS redirects", "value / 10 AS seconds")
    return K.link_classes(e, "kind")


@query("""WITH d AS (SELECT doc_id, quality, toxic, n_chars > 1500 AS a, n_chars > 2000 AS b FROM documents JOIN labels USING (doc_id))
    SELECT count(*) FILTER (a = b) AS agreed, count(*) FILTER (a <> b) AS conflicts, round(count(*) FILTER (a = b AND a = (quality = 1)) / count(*) FILTER (a = b), 4) AS agreement_precision,
           round(count(*) FILTER (a <> b AND (a <> (quality = 1) OR b <> (quality = 1))) / count(*) FILTER (a <> (quality = 1) OR b <> (quality = 1)), 4) AS conflict_recall,
           count(*) FILTER (a = b AND a <> (quality = 1)) AS blind_spots FROM d""")
def a38_dual_run_calibration(spark, sf):
    d = A.table(spark, sf, "documents").join(A.table(spark, sf, "labels"), "doc_id").selectExpr("n_chars > 1500 AS a", "n_chars > 2000 AS b", "quality = 1 AS g")
    a, b, g = F.col("a"), F.col("b"), F.col("g")
    wrong = (a != g) | (b != g)
    return d.agg(
        F.count_if(a == b).alias("agreed"), F.count_if(a != b).alias("conflicts"),
        F.round(F.try_divide(F.count_if((a == b) & (a == g)), F.count_if(a == b)), 4).alias("agreement_precision"),
        F.round(F.try_divide(F.count_if((a != b) & wrong), F.count_if(wrong)), 4).alias("conflict_recall"),
        F.count_if((a == b) & (a != g)).alias("blind_spots"),
    )


@query("""SELECT l_orderkey AS case_id, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 3 THEN 'reject' WHEN count(*) < 2 THEN 'insufficient_gold' WHEN avg(l_discount) < 0.03 THEN 'needs_review'
    WHEN avg(l_discount) < 0.05 THEN 'accept_with_caveat' ELSE 'auto_accept' END AS gate FROM lineitem GROUP BY 1""")
def a36_evaluation_gate(spark, sf):
    """Gates of orders; a mean of discounts that is exactly on a mark is added in the order of the table."""
    li = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_returnflag", "l_discount", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    counts = [F.count_if(F.col("l_returnflag") == "R").alias("risky"), F.count("*").alias("gold")]
    d = E.ordered_means(li, "case_id", "l_discount", ["file", "row"], [0.03, 0.05], counts)
    reached = lambda mark: F.coalesce(F.col("mean") >= mark, F.lit(True))
    gates = [("reject", F.col("risky") <= 3), ("insufficient_gold", F.col("gold") >= 2), ("needs_review", reached(0.03)), ("accept_with_caveat", reached(0.05))]
    return d.select("case_id", E.first_failure(gates, "auto_accept").alias("gate"))


# ------------------------------------------------------------------ text and sections


@query(with_(A.PAGES_SQL) + """, q AS (SELECT doc_id AS id, text AS t, substring(text, 3, 30) || ' inserted words ' || substring(text, 33, 40) AS q FROM text_pages WHERE length(text) > 90),
    s AS (SELECT id, contains(t, q) AS v, contains(t, substring(q, 1, 28)) AND contains(substring(t, strpos(t, substring(q, 1, 28)) + 28), substring(q, 57, 28)) AS x FROM q)
    SELECT id, count(*) AS pages, count(*) FILTER (v) AS verbatim, count(*) FILTER (x) AS found FROM s GROUP BY 1""")
def t07_fragment_quotes(spark, sf):
    """Quotes of every page with words put in: how many are verbatim, and how many fragments find."""
    p = A.text_pages(spark, sf).where("length(text) > 90")
    q = p.withColumn("quote", F.expr("concat(substring(text, 3, 30), ' inserted words ', substring(text, 33, 40))"))
    found = G.by_fragments(F.col("quote"), F.col("text"))
    return q.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("pages"), F.count_if(F.contains("text", F.col("quote"))).alias("verbatim"), F.count_if(found).alias("found"))


@query(with_(A.PAGES_SQL) + """, h AS (SELECT doc_id, page_number, page_number - (page_number - 1) % 7 AS a, (page_number - 1) % 7 >= 2 AS b, text FROM text_pages)
    SELECT h.doc_id, h.page_number, '1 H ' || x.text || CASE WHEN b THEN ' > 1.2 H ' || y.text ELSE '' END AS path
    FROM h JOIN text_pages x ON x.doc_id = h.doc_id AND x.page_number = a LEFT JOIN text_pages y ON y.doc_id = h.doc_id AND y.page_number = a + 2""")
def w01_heading_paths(spark, sf):
    """The lines of documents, of which one in seven is a heading and the second after it one below it; the path open at each line."""
    p = A.text_pages(spark, sf)
    return S.heading_paths(p.withColumn("text", F.expr("case (page_number - 1) % 7 when 0 then concat('1. H ', text) when 2 then concat('1.2 H ', text) else concat('x ', text) end"))).select("doc_id", "page_number", "path")


@query("""WITH p AS (SELECT p_partkey AS id, ['defined', 'left_open', 'not_conclusive', 'precedent_only', 'possible_segmentation', 'unknown', 'background', 'other'][1 + p_partkey % 8] AS s FROM part)
    SELECT id, CASE s WHEN 'not_conclusive' THEN 'left_open' WHEN 'precedent_only' THEN 'discussed' WHEN 'possible_segmentation' THEN 'discussed' ELSE s END AS status,
      CASE WHEN s IN ('defined', 'left_open') THEN NULL WHEN s IN ('not_conclusive', 'precedent_only', 'possible_segmentation') THEN 'INFO' ELSE 'WARN' END AS warning,
      CASE s WHEN 'not_conclusive' THEN 'left_open' WHEN 'precedent_only' THEN 'considered' WHEN 'possible_segmentation' THEN 'discussed' WHEN 'unknown' THEN 'considered' WHEN 'background' THEN 'considered' ELSE s END AS promoted FROM p""")
def t25_status_remap(spark, sf):
    s = F.element_at(F.lit(["defined", "left_open", "not_conclusive", "precedent_only", "possible_segmentation", "unknown", "background", "other"]), (1 + F.col("p_partkey") % 8).cast("int"))
    status, level = K.merged_definition(s)
    return A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), status.alias("status"), level.alias("warning"), K.promoted_definition(s).alias("promoted"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pdf' ELSE 'html' END AS kind, CASE WHEN regexp_matches(html, '<html lang="[a-z]{2}"') THEN regexp_extract(html, '<html lang="([a-z]{2})"', 1) END AS language FROM pages""")
def t26_content_typing(spark, sf):
    p = A.table(spark, sf, "pages").selectExpr("page_id", "html", "if(page_id % 5 = 0, concat('%PDF-1.7 ', html), html) AS content")
    kind = F.when(F.startswith("content", F.lit("%PDF")), "pdf").otherwise("html")
    return p.select("page_id", kind.alias("kind"), F.nullif(F.regexp_extract("html", '<html lang="([a-z]{2})"', 1), F.lit("")).alias("language"))


@query(r"""SELECT page_id, regexp_matches(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '^/(en|fr)/[0-9]+$') AS shaped FROM pages""")
def n17_url_shape(spark, sf):
    path = F.try_parse_url(F.col("url"), F.lit("PATH"))
    return A.table(spark, sf, "pages").select("page_id", F.coalesce(path.rlike("^/(en|fr)/[0-9]+$"), F.lit(False)).alias("shaped"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def n20_json_replies(spark, sf):
    e = A.table(spark, sf, "events").withColumn("reply", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    bare = F.regexp_replace("reply", "^```[a-z]*\\s*|\\s*```$", "")
    return e.select("event_id", F.from_json(bare, "k long").getField("k").alias("k"))


def markets_by_kind(spark, sf):
    p = A.table(spark, sf, "part")
    columns = ("cast(p_size AS bigint) AS case_id", "p_partkey AS item", "p_name AS name", "p_type AS status", "p_retailprice / 1000 AS score")
    return p.where("p_partkey % 3 > 0").selectExpr(*columns), p.where("p_partkey % 3 = 0").selectExpr(*columns)


@query()
def w17_review_set(spark, sf):
    return M.review_set(*markets_by_kind(spark, sf), 3)


@query("""WITH i AS (SELECT p_size::BIGINT AS case_id, p_partkey AS item, p_name AS name, p_type AS category FROM part),
    w AS (SELECT *, CASE WHEN lower(name) = 'red widget' THEN 1 WHEN category = 'PROMO' THEN 2 WHEN item % 10 = 0 THEN 3 END AS why FROM i),
    d AS (SELECT * FROM w WHERE why IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id, lower(trim(name)) ORDER BY why, item) = 1),
    p AS (SELECT l_partkey AS item, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS ps FROM lineitem GROUP BY 1)
    SELECT case_id, d.item, name, coalesce(ps, '') AS passages FROM d LEFT JOIN p USING (item)""")
def g18_gold_draft(spark, sf):
    p = A.table(spark, sf, "part")
    items = p.selectExpr("cast(p_size AS bigint) AS case_id", "p_partkey AS item", "p_name AS name", "p_type AS category")
    li = A.table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    passages = li.selectExpr("cast(p_size AS bigint) AS case_id", "p_partkey AS item", "cast(l_suppkey AS string) AS passage")
    return M.gold_draft(items, items.where("item % 10 = 0"), ["Red Widget"], ["PROMO"], passages).withColumn("passages", F.array_join("passages", ","))
