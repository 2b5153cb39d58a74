"""Queries of the text, sequence and grounding operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import grounding as G
from caseloom.operators import sections as S
from caseloom.plans.catalog import with_
from caseloom.sources import adapters as A

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def t04_html_text(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


TOK = r"list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) > 1)"


@query(f"""WITH t AS (SELECT item_id, list_distinct({TOK.format('text')}) AS s FROM benchmark), p AS (SELECT a.item_id, b.item_id AS other, a.s AS x, b.s AS y FROM t a JOIN t b ON b.item_id = a.item_id + 1)
    SELECT item_id, other, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END, 6) AS overlap FROM p""")
def t05_token_overlap(spark, sf):
    b = A.table(spark, sf, "benchmark")
    o = b.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("text").alias("b"))
    return b.join(o, "item_id").select("item_id", "other", F.round(T.overlap(F.col("text"), F.col("b")), 6).alias("overlap"))


@query(r"""SELECT page_id, rtrim(substring(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), '_') AS slug FROM pages""")
def t09_slug(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", T.slug(F.col("url"), 40).alias("slug"))


@query("""WITH n AS (SELECT p_partkey AS id, list_filter([trim(x) for x in string_split(p_name || ' and ' || p_brand || ' / ' || p_type, ' / ')], lambda x: x <> '') AS a FROM part),
    m AS (SELECT id, flatten([string_split(x, ' and ') for x in a]) AS names FROM n)
    SELECT id, i::INT AS place, trim(names[i]) AS name, CASE WHEN i = 1 THEN 'acquirer' ELSE 'target' END AS role FROM m, LATERAL (SELECT unnest(range(1, len(names) + 1)) AS i)""")
def t10_party_roles(spark, sf):
    title = F.concat("p_name", F.lit(" and "), "p_brand", F.lit(" / "), "p_type")
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.posexplode(T.parties(title)).alias("i", "x"))
    return p.select("id", (F.col("i") + 1).alias("place"), "x.name", "x.role")


@query("""SELECT p_partkey AS id, CASE WHEN regexp_matches(lower(p_name), 'bolt|gear') THEN 'machinery' WHEN regexp_matches(lower(p_name), 'ring') THEN 'retail' ELSE 'other' END AS sector FROM part""")
def t11_sector_map(spark, sf):
    return A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.sector_by_pattern(F.col("p_name"), [("bolt|gear", "machinery"), ("ring", "retail")]).alias("sector"))


@query("""WITH d AS (SELECT p_partkey AS id, p_name || ' - DE' AS a, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' – Germany' WHEN 1 THEN replace(p_name, ' ', '-') || ' de' WHEN 2 THEN p_name || ' - FR' ELSE 'DE' END AS b FROM part)
    SELECT id, CASE id % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE ELSE FALSE END AS same FROM d""")
def t17_trivial_equivalence(spark, sf):
    b = "case p_partkey % 4 when 0 then concat(upper(p_name), ' – Germany') when 1 then concat(replace(p_name, ' ', '-'), ' de') when 2 then concat(p_name, ' - FR') else 'DE' end"
    p = A.table(spark, sf, "part").selectExpr("p_partkey AS id", "concat(p_name, ' - DE') AS a", f"{b} AS b")
    return p.select("id", T.trivially_equal(F.col("a"), F.col("b")).alias("same"))


@query("""SELECT o_orderkey AS id, round(CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE round(o_totalprice, 2) END, 2) AS value FROM orders""")
def n01_grouped_numbers(spark, sf):
    """The price written in three ways: 1,234.50; 1.234,50; and with a group of two digits, which is no number."""
    o = A.table(spark, sf, "orders")
    us = F.format_number("o_totalprice", 2)
    eu = F.translate(us, ",.", ".,")
    bad = F.concat(F.lit("2023 "), F.lit("35 "), F.lit("1,5"))
    written = F.when(F.col("o_orderkey") % 3 == 0, us).when(F.col("o_orderkey") % 3 == 1, eu).otherwise(bad)
    return o.select(F.col("o_orderkey").alias("id"), F.round(T.number(written), 2).alias("value"))


MONEY = "concat('turnover of EUR ', format_number(o_totalprice, 2), ' and ', o_orderkey % 90, '.5 million in ', o_custkey, ' stores')"


@query("""SELECT o_orderkey AS id, unnest([1, 2]) AS pos, round(unnest([round(o_totalprice, 2), (o_orderkey % 90 + 0.5) * 1000000]), 2)::DOUBLE AS value FROM orders""")
def n03_money_mentions(spark, sf):
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{MONEY} AS text")
    a = o.select("id", F.posexplode(T.amounts(F.col("text"), "EUR")).alias("p", "value"))
    return a.select("id", (F.col("p") + 1).alias("pos"), F.round("value", 2).alias("value"))


@query("""SELECT o_orderkey AS id, round(o_orderkey % 77 + 0.5, 4)::DOUBLE AS first, (CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN o_orderkey % 77 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 0 END)::INT AS n,
    round(CASE WHEN o_orderkey % 2 = 0 THEN 200 / 3.0 WHEN o_orderkey % 3 = 0 THEN 75.0 WHEN o_orderkey % 77 = 0 THEN 50.0 ELSE o_orderkey % 77 + 0.5 END, 4)::DOUBLE AS last FROM orders""")
def n05_share_mentions(spark, sf):
    text = "concat('a share of ', o_orderkey % 77, ',5 % overall', if(o_orderkey % 3 = 0, ', three quarters of it at 0.25 or 0,3', ''), if(o_orderkey % 2 = 0, ' and Two-Thirds of the rest', ''))"
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{text} AS text").withColumn("s", T.shares(F.col("text")))
    return o.select("id", F.round(F.get("s", F.lit(0)), 4).alias("first"), F.size("s").alias("n"), F.round(F.element_at("s", -1), 4).alias("last"))


@query("""WITH e AS (SELECT *, o_totalprice * (1 + (o_orderkey % 5) / 100.0) AS expected FROM orders), t AS (SELECT *, greatest(abs(expected) * 0.02, 1) AS most FROM e)
    SELECT o_orderkey AS id, abs(round(o_totalprice, 2) - expected) <= most OR (o_orderkey % 7 = 0 AND abs(round(o_totalprice * 1.04, 2) - expected) <= most) AS verified FROM t""")
def n06_amount_tolerance(spark, sf):
    """Any of the amounts that a text mentions may be the expected one: every seventh text names a second."""
    text = f"concat({MONEY}, if(o_orderkey % 7 = 0, concat(' or EUR ', format_number(o_totalprice * 1.04D, 2)), ''))"
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{text} AS text", "o_totalprice * (1 + (o_orderkey % 5) / 100.0D) AS expected")
    return o.select("id", T.any_within(T.amounts(F.col("text"), "EUR"), F.col("expected")).alias("verified"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders""")
def n14_date_readers(spark, sf):
    text = "case o_orderkey % 4 when 0 then concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' (as amended)') when 1 then date_format(o_orderdate, 'MMMM d, yyyy') when 2 then concat('on ', date_format(o_orderdate, 'd MMMM yyyy')) else 'undated' end"
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{text} AS text")
    return o.select("id", T.date_of(F.col("text")).alias("day"))


@query(r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS h FROM pages)
    SELECT page_id, (h = 'example.com' OR h LIKE '%.example.com') AS official FROM h""")
def n16_official_domain(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", T.official(F.col("url"), ["example.com"]).alias("official"))


@query("SELECT o_orderkey AS id, date_diff('day', o_orderdate::DATE, DATE '1999-01-01') > 365 AS stale FROM orders")
def n15_staleness(spark, sf):
    o = A.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), T.stale(F.to_date("o_orderdate"), F.lit("1999-01-01").cast("date"), 365).alias("stale"))


@query("SELECT lang, lang || 'g' AS code, count(*) AS n, TRUE AS valid, FALSE AS short FROM documents GROUP BY lang")
def t24_language_codes(spark, sf):
    d = A.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return d.select("lang", F.concat("lang", F.lit("g")).alias("code"), "n", T.is_language(F.concat("lang", F.lit("g"))).alias("valid"), T.is_language(F.col("lang")).alias("short"))


# ------------------------------------------------------------------ sequences of pages


def pages(spark, sf):
    """Pages with a section (first letter of the line) and a score (mentions of `the`)."""
    p = A.text_pages(spark, sf)
    return p.select("doc_id", "page_number", "text", F.lower(F.substring("text", 1, 1)).alias("section"), F.regexp_count("text", F.lit("the")).alias("score"))


SECTIONS_SQL = f"""{A.PAGES_SQL},
pages2 AS (SELECT doc_id, page_number, text, lower(substring(text, 1, 1)) AS section, len(regexp_extract_all(text, 'the')) AS score FROM text_pages)"""


@query(with_(SECTIONS_SQL) + """, p AS (SELECT *, lag(section) OVER w AS b, row_number() OVER w AS r FROM pages2 WHERE length(text) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY page_number)),
    i AS (SELECT *, sum(CASE WHEN r = 1 OR section IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number) AS island FROM p),
    n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, island ORDER BY page_number) - 1) // 2 AS part FROM i),
    g AS (SELECT doc_id, island, part, min(section) AS path, min(page_number) AS first_page, max(page_number) AS last_page, count(*) AS pages FROM n GROUP BY 1, 2, 3)
    SELECT doc_id, 'chunk_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY island, part))::VARCHAR, 3, '0') AS chunk, path, first_page, last_page, pages FROM g""")
def w02_section_chunks(spark, sf):
    return S.chunks(pages(spark, sf), "section", 2)


@query(with_(SECTIONS_SQL) + """, n AS (SELECT *, max(score) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM pages2),
    p AS (SELECT *, lag(page_number) OVER (PARTITION BY doc_id ORDER BY page_number) AS b FROM n WHERE near > 0),
    i AS (SELECT *, sum(CASE WHEN b IS NULL OR page_number - b > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number) AS island FROM p),
    q AS (SELECT *, (page_number - min(page_number) OVER (PARTITION BY doc_id, island)) // 15 AS part FROM i)
    SELECT doc_id, min(page_number) AS first_page, max(page_number) AS last_page, sum(score)::BIGINT AS score FROM q GROUP BY doc_id, island, part""")
def w08_hot_windows(spark, sf):
    return S.hot_windows(pages(spark, sf), "score").withColumn("score", F.col("score").cast("long"))


@query(with_(SECTIONS_SQL) + """, n AS (SELECT *, greatest(coalesce(lag(score) OVER w, 0), coalesce(lead(score) OVER w, 0)) AS beside FROM pages2 WINDOW w AS (PARTITION BY doc_id ORDER BY page_number)),
    k AS (SELECT * FROM n WHERE score >= 2 OR (score >= 1 AND beside >= 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_number) <= 4),
    p AS (SELECT *, lag(page_number) OVER (PARTITION BY doc_id ORDER BY page_number) AS b FROM k),
    i AS (SELECT *, sum(CASE WHEN b IS NULL OR page_number - b > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number)::BIGINT AS island FROM p)
    SELECT doc_id, page_number, island FROM i WHERE island <= 3""")
def w03_fallback_pages(spark, sf):
    return S.fallback_pages(pages(spark, sf), "score", most=4)


@query(ORACLES["w02_section_chunks"].replace("SELECT doc_id, 'chunk_'", ", c AS (SELECT doc_id, 'chunk_'") + """),
    o AS (SELECT *, sum(pages) OVER (PARTITION BY doc_id ORDER BY last_page % 5 DESC, first_page) AS s FROM c)
    SELECT doc_id, chunk, first_page, pages FROM o WHERE s <= 4""")
def w04_page_budget(spark, sf):
    c = S.chunks(pages(spark, sf), "section", 2).withColumn("score", F.col("last_page") % 5)
    return S.under_budget(c, "score", 4).select("doc_id", "chunk", "first_page", "pages")


@query(with_(SECTIONS_SQL) + """, p AS (SELECT *, CASE section WHEN 't' THEN 'market' WHEN 'o' THEN 'theory' WHEN 'a' THEN 'remedy' END AS category FROM pages2),
    b AS (SELECT *, lag(category) OVER w AS c, lag(page_number) OVER w AS n FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_number)),
    i AS (SELECT *, sum(CASE WHEN n IS NULL OR category IS DISTINCT FROM c OR page_number - n > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number) AS island FROM b)
    SELECT doc_id, category, min(page_number) AS page_start, max(page_number) AS page_end FROM i WHERE category IS NOT NULL GROUP BY doc_id, island, category""")
def w11_coverage_plan(spark, sf):
    kind = F.when(F.col("section") == "t", "market").when(F.col("section") == "o", "theory").when(F.col("section") == "a", "remedy")
    return S.coverage(pages(spark, sf).withColumn("category", kind), "category")


LINK = r"""(?i)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>"""


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>')) AS m FROM pages)
    SELECT page_id, regexp_extract(m, '(?i)href="([^"]*)"', 1) AS target, trim(regexp_extract(m, '>([^<]*)<', 1)) AS label, count(*) AS n FROM a GROUP BY ALL""")
def s23_page_links(spark, sf):
    p = A.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(0))).alias("m"))
    p = p.select("page_id", F.regexp_extract("m", LINK, 1).alias("target"), F.trim(F.regexp_extract("m", LINK, 2)).alias("label"))
    return p.groupBy("page_id", "target", "label").agg(F.count("*").alias("n"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS l FROM pages), x AS (SELECT page_id, i AS pos, l[i] AS url, length(l[i]) % 7 AS score FROM a, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
    r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM x WHERE score > 0 WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, pos))
    SELECT page_id, url, score::INT AS score FROM r WHERE n = 1 AND (second IS NULL OR score - second >= 1)""")
def w19_best_link(spark, sf):
    p = A.table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("pos", "url"))
    return S.best_links(p, F.length("url") % 7, lead=1)


# ------------------------------------------------------------------ grounding


def quotes(spark, sf):
    """A passage for each page of some text: its text from the fifth sign on, cited rightly, on the next page, or with a changed word."""
    p = A.text_pages(spark, sf).where("length(text) > 50")
    quote = F.expr("if(doc_id % 3 = 2, concat('zz ', substring(text, 5, 30)), substring(text, 5, 40))")
    passage = (F.col("doc_id") * 100000 + F.col("page_number")).alias("passage_id")
    return p.select(passage, F.expr("if(doc_id % 10 = 7, -1, doc_id)").alias("doc_id"), F.expr("if(doc_id % 3 = 1, page_number + 1, page_number)").alias("page"), quote.alias("quote"))


QUOTES_SQL = r"""quotes AS (SELECT doc_id * 100000 + page_number AS passage_id, CASE WHEN doc_id % 10 = 7 THEN -1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 3 = 1 THEN page_number + 1 ELSE page_number END AS page,
    trim(regexp_replace(CASE WHEN doc_id % 3 = 2 THEN 'zz ' || substring(text, 5, 30) ELSE substring(text, 5, 40) END, '\s+', ' ', 'g')) AS quote FROM text_pages WHERE length(text) > 50),
g AS (SELECT passage_id, any_value(q.page) AS page, count(p.page_number) AS n, coalesce(bool_or(q.page = p.page_number AND contains(trim(regexp_replace(text, '\s+', ' ', 'g')), quote)), FALSE) AS cited,
    min(p.page_number) FILTER (contains(trim(regexp_replace(text, '\s+', ' ', 'g')), quote)) AS hit FROM quotes q LEFT JOIN text_pages p ON q.doc_id = p.doc_id GROUP BY 1),
ground AS (SELECT passage_id, CASE WHEN n = 0 THEN 'no_cache' WHEN cited THEN 'ok' WHEN hit IS NOT NULL THEN 'wrong_page' ELSE 'not_found' END AS status, CASE WHEN cited THEN page ELSE hit END::INT AS found_page FROM g)"""


@query(with_(A.PAGES_SQL, QUOTES_SQL) + " SELECT passage_id, status, found_page FROM ground")
def g04_page_grounding(spark, sf):
    return G.grounded(quotes(spark, sf), A.text_pages(spark, sf))


@query(with_(A.PAGES_SQL, QUOTES_SQL) + " SELECT CASE status WHEN 'ok' THEN 'INFO' WHEN 'wrong_page' THEN 'WARNING' ELSE 'ERROR' END AS level, status, count(*) AS n FROM ground GROUP BY 1, 2")
def g06_quote_report(spark, sf):
    return G.levels(G.grounded(quotes(spark, sf), A.text_pages(spark, sf)))


@query(None)
def t06_dense_quotes(spark, sf):
    """Benchmark passages in documents, verbatim or by most of their tokens; whole passages against all documents. Brute force in SQL is too slow: see the tests."""
    q = A.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    d = A.table(spark, sf, "documents").select("doc_id", "text")
    pairs = G.likely(q, d).join(q, "item_id").join(d, "doc_id").withColumn("pair_id", F.struct("item_id", "doc_id"))
    return G.dense(pairs.select("pair_id", "quote", "text")).where("found").select("pair_id.item_id", "pair_id.doc_id")
