"""Queries of the catalog operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import catalog as C
from caseloom.sources import adapters as A
from caseloom.sources.scratch import fresh_folder

QUERIES, ORACLES = {}, {}
MARK = "-"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def layers(spark, sf):
    c = A.cases(spark, sf)
    return c.where("layer = 'canonical'").drop("layer"), c.where("layer = 'indexed'").drop("layer")


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


CATALOG_SQL = with_(A.CASES_SQL, "catalog AS (SELECT *, layer AS data_layer FROM cases)")
COLUMNS = "case_id, case_name, jurisdiction, authority, decision_date, sector, outcome, data_layer"


@query(with_(A.MARKETS_SQL, """k AS (SELECT *, lower(trim(name)) AS key FROM markets),
    s AS (SELECT key, status, count(*) AS n, min(seq) AS s FROM k GROUP BY 1, 2),
    t AS (SELECT key, string_agg(status || ':' || n, '|' ORDER BY status) AS statuses, sum(n)::BIGINT AS mentions,
                 arg_max(status, n * 1000000000000 - s) AS dominant_status FROM s GROUP BY 1)""") + """
    SELECT key, count(DISTINCT case_id) AS case_count, arg_min(name, seq) AS name, any_value(statuses) AS statuses,
           any_value(dominant_status) AS dominant_status, any_value(mentions) AS mentions FROM k JOIN t USING (key) GROUP BY key""")  # fmt: skip
def a01_market_rollup(spark, sf):
    return C.market_rollup(A.markets(spark, sf)).orderBy(F.col("case_count").desc(), "key")


@query(with_(A.THEORIES_SQL, A.CASES_SQL, """o AS (SELECT lower(trim(name)) AS key, case_id, min(seq) AS seq, arg_min(name, seq) AS name FROM theories GROUP BY 1, 2),
    b AS (SELECT key, outcome, count(*) AS n, min(seq) AS seq, arg_min(o.name, seq) AS name FROM o JOIN cases USING (case_id) GROUP BY 1, 2)""") + """
    SELECT key, arg_min(name, seq) AS name, sum(n)::BIGINT AS case_count, string_agg(outcome || ':' || n, '|' ORDER BY outcome) AS outcomes,
           arg_max(outcome, n * 1000000000000 - seq) AS dominant_outcome FROM b GROUP BY key""")  # fmt: skip
def a02_theory_rollup(spark, sf):
    return C.theory_rollup(A.theories(spark, sf), A.cases(spark, sf))


@query(with_(A.CASES_SQL, A.MARKETS_SQL, """c AS (SELECT case_id, trim(split_part(sector, '-', 1)) AS sector, outcome FROM cases),
    b AS (SELECT sector, outcome, count(*) AS n FROM c GROUP BY 1, 2),
    m AS (SELECT sector, count(DISTINCT lower(trim(name))) AS market_count FROM c JOIN markets USING (case_id) GROUP BY 1)""") + """
    SELECT sector, sum(n)::BIGINT AS case_count, string_agg(outcome || ':' || n, '|' ORDER BY outcome) AS outcomes,
           coalesce(any_value(market_count), 0) AS market_count FROM b LEFT JOIN m USING (sector) GROUP BY sector""")  # fmt: skip
def a03_sector_rollup(spark, sf):
    return C.sector_rollup(A.cases(spark, sf), A.markets(spark, sf), MARK)


@query(with_(A.CASES_SQL, A.MARKETS_SQL) + """
    , c AS (SELECT case_id FROM cases WHERE lower(trim(split_part(sector, '-', 1))) = '1'),
      o AS (SELECT lower(trim(name)) AS key, case_id, min(seq) AS seq, arg_min(name, seq) AS name FROM markets WHERE case_id IN (FROM c) GROUP BY 1, 2)
    SELECT key, arg_min(name, seq) AS name, count(*) AS case_count, string_agg(case_id::VARCHAR, ',' ORDER BY case_id) AS cases FROM o GROUP BY key""")  # fmt: skip
def a04_sector_markets(spark, sf):
    return C.sector_markets(A.cases(spark, sf), A.markets(spark, sf), "1", MARK).withColumn("cases", F.array_join("cases", ","))


@query(with_(A.MARKETS_SQL) + """, f AS (SELECT name AS q FROM markets ORDER BY seq LIMIT 1), k AS (SELECT *, lower(trim(name)) AS key FROM markets),
    s AS (SELECT DISTINCT case_id FROM k, f WHERE key = lower(trim(q)))
    SELECT key, arg_min(name, seq) AS name, count(DISTINCT case_id) AS shared_cases, min(seq) AS first_seq FROM k, f
    WHERE key <> lower(trim(q)) AND case_id IN (FROM s) GROUP BY key""")  # fmt: skip
def a05_cooccurring_markets(spark, sf):
    m = A.markets(spark, sf)
    return C.cooccurring(m, m.orderBy("seq").first()["name"])


@query(CATALOG_SQL + ", " + A.MARKETS_SQL + """
    SELECT count(*) FILTER (data_layer = 'canonical') AS canonical_cases, count(*) FILTER (data_layer = 'indexed') AS indexed_cases,
           (SELECT string_agg(DISTINCT jurisdiction, ',' ORDER BY jurisdiction) FROM catalog) AS jurisdictions,
           (SELECT count(DISTINCT lower(trim(name))) FROM markets) AS markets FROM catalog""")  # fmt: skip
def a08_catalog_stats(spark, sf):
    return C.stats(C.unified(*layers(spark, sf)), A.markets(spark, sf))


@query(CATALOG_SQL + f" SELECT {COLUMNS} FROM catalog")
def p01_catalog_union(spark, sf):
    return C.unified(*layers(spark, sf))


@query(CATALOG_SQL + f""" SELECT {COLUMNS} FROM catalog WHERE upper(jurisdiction) = 'EUROPE' AND lower(sector) LIKE '%high%' AND outcome = 'F'
    AND year(decision_date) BETWEEN 1993 AND 1996""")  # fmt: skip
def p02_catalog_list(spark, sf):
    return C.listed(C.unified(*layers(spark, sf)), "europe", "HIGH", "F", (1993, 1996))


@query(CATALOG_SQL + ", " + A.THEORIES_SQL + f""" SELECT {COLUMNS} FROM catalog WHERE data_layer = 'canonical' AND case_id IN
    (SELECT case_id FROM theories WHERE lower(name) LIKE '%#12%' OR lower(description) LIKE '%#12%' OR lower(description) LIKE '%brand#12%')""")  # fmt: skip
def p03_theory_predicate(spark, sf):
    return C.with_theory(C.unified(*layers(spark, sf)), A.theories(spark, sf), "#12")


@query(CATALOG_SQL + f" SELECT {COLUMNS} FROM catalog WHERE case_id IN (4, 7)")
def p04_layered_lookup(spark, sf):
    canon, index = layers(spark, sf)
    return C.lookup(canon, index, 4).unionByName(C.lookup(canon, index, 7))


@query(CATALOG_SQL + f""" SELECT {COLUMNS} FROM catalog WHERE lower(concat_ws(' ', case_name, jurisdiction, authority, sector, outcome)) LIKE '%1 asia nation_7 1-urgent f%'""")
def p05_keyword_search(spark, sf):
    return C.searched(C.unified(*layers(spark, sf)), ["case_name", "jurisdiction", "authority", "sector", "outcome"], " 1 ASIA Nation_7 1-urgent f ")


@query(with_(A.CASES_SQL) + " SELECT case_id, case_name FROM cases WHERE layer = 'canonical' AND lower(concat_ws(' ', case_name, authority)) LIKE '%00012 %'")
def p06_canonical_search(spark, sf):
    return C.searched(layers(spark, sf)[0], ["case_name", "authority"], "00012 ", trim=False).select("case_id", "case_name")


@query(with_(A.CASES_SQL) + " SELECT case_id, case_name FROM cases WHERE layer = 'indexed' AND lower(concat_ws(' ', case_name, authority, sector)) LIKE '%nation_3 2%'")
def p07_indexed_search(spark, sf):
    return C.searched(layers(spark, sf)[1], ["case_name", "authority", "sector"], "nation_3 2").select("case_id", "case_name")


@query(CATALOG_SQL + ", " + A.MARKETS_SQL + """, m AS (SELECT case_id, count(*) AS n FROM markets GROUP BY 1)
    SELECT c.case_id, case_name, jurisdiction, authority, decision_date, sector, outcome, data_layer, coalesce(n, 0) AS market_count, coalesce(n, 0) AS theory_count,
           CASE data_layer WHEN 'canonical' THEN '/cases/' ELSE '/indexed-cases/' END || c.case_id AS href FROM catalog c LEFT JOIN m ON c.case_id = m.case_id""")  # fmt: skip
def p08_search_hits(spark, sf):
    return C.hits(C.unified(*layers(spark, sf)), A.markets(spark, sf), A.theories(spark, sf))


@query(with_(A.LINES_SQL) + """, d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'case/' || l_partkey ELSE '' END AS c,
                            CASE WHEN l_linenumber % 2 = 0 THEN 'url/' || l_suppkey END AS u FROM lines)
    SELECT l_orderkey AS case_id, coalesce(arg_min(c, l_linenumber) FILTER (length(c) > 0), arg_min(u, l_linenumber) FILTER (length(u) > 0)) AS url FROM d GROUP BY 1""")  # fmt: skip
def p09_first_url(spark, sf):
    d = A.lines(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("case/"), "l_partkey")).otherwise("").alias("case_page_url"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("url/"), "l_suppkey")).alias("url"),
    )
    d = d.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "case_page_url", "url"))).alias("docs"))
    return d.select("case_id", C.first_url(F.col("docs")).alias("url"))


@query(with_(A.MARKETS_SQL, A.CASES_SQL) + """, f AS (SELECT name AS q FROM markets ORDER BY seq LIMIT 1)
    SELECT case_id, arg_min(market_id, seq) AS market_id, arg_min(status, seq) AS status, any_value(case_name) AS case_name
    FROM markets JOIN cases USING (case_id), f WHERE lower(trim(name)) = lower(trim(q)) GROUP BY case_id""")  # fmt: skip
def j05_market_cases(spark, sf):
    m = A.markets(spark, sf)
    return C.entity_cases(m, A.cases(spark, sf), f"  {m.orderBy('seq').first()['name']} ").select("case_id", "market_id", "status", "case_name")


@query(with_(A.THEORIES_SQL, A.CASES_SQL) + """ SELECT case_id, arg_min(theory_id, seq) AS theory_id, any_value(outcome) AS outcome
    FROM theories JOIN cases USING (case_id) WHERE lower(trim(name)) = 'brand#12' GROUP BY case_id""")  # fmt: skip
def j06_theory_cases(spark, sf):
    return C.entity_cases(A.theories(spark, sf), A.cases(spark, sf), "Brand#12").select("case_id", "theory_id", "outcome")


@query(r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 0) AS w FROM documents),
    t AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'rend')) AS a, len(list_filter(w, lambda x: x = 'threlyes')) AS b FROM d),
    c AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM t),
    s AS (SELECT doc_id, ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean))
                       + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM t, c)
    SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 20""")  # fmt: skip
def k05_full_text(spark, sf):
    path = fresh_folder(spark, "postings")
    C.full_text_index(A.table(spark, sf, "documents"), path)
    return C.searched_index(spark, path, "rend threlyes").withColumn("score", F.round("score", 6))
