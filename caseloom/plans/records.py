"""Queries of record checks, draft algebra, evaluation and promotion, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import checks as K
from caseloom.operators import drafts as D
from caseloom.operators import evals as E
from caseloom.plans.catalog import with_
from caseloom.sources import adapters as A

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def passages(spark, sf):
    """A passage per line: its document, role, quote, and what it supports."""
    d = A.lines(spark, sf).join(A.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return d.selectExpr(
        "l_orderkey AS case_id", "l_linenumber AS passage_id", "cast(l_suppkey % 4 AS int) AS doc_id", "cast(l_quantity AS int) AS page", "p_name AS quote",
        "case l_returnflag when 'A' then 'conclusion' when 'N' then 'analysis' else '' end AS role",
        "array(cast(l_linenumber AS bigint), l_partkey % 9) AS supports_markets",
        "if(l_linestatus = 'O', array(l_suppkey % 8), cast(array() AS array<bigint>)) AS supports_theories",
    )


PASSAGES_SQL = f"""{A.LINES_SQL},
passages AS (SELECT l_orderkey AS case_id, l_linenumber AS passage_id, (l_suppkey % 4)::INT AS doc_id, l_quantity::INT AS page, p_name AS quote,
    CASE l_returnflag WHEN 'A' THEN 'conclusion' WHEN 'N' THEN 'analysis' ELSE '' END AS role,
    [l_linenumber::BIGINT, l_partkey % 9] AS supports_markets, CASE WHEN l_linestatus = 'O' THEN [l_suppkey % 8] ELSE []::BIGINT[] END AS supports_theories
    FROM lines JOIN part ON l_partkey = p_partkey),
docs AS (SELECT o_orderkey AS case_id, doc_id::INT AS doc_id, CASE doc_id WHEN 0 THEN 'complaint' WHEN 1 THEN 'decision' ELSE 'press' END AS doc_type
    FROM orders, (SELECT unnest([0, 1, 2]) AS doc_id)),
items AS (SELECT l_orderkey AS case_id, l_linenumber::BIGINT AS market_id, CASE l_returnflag WHEN 'A' THEN 'defined' ELSE 'discussed' END AS status FROM lines)"""


def documents(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("doc_id"))
    return o.withColumn("doc_type", F.when(F.col("doc_id") == 0, "complaint").when(F.col("doc_id") == 1, "decision").otherwise("press"))


def items(spark, sf):
    return A.lines(spark, sf).selectExpr("l_orderkey AS case_id", "cast(l_linenumber AS bigint) AS market_id", "if(l_returnflag = 'A', 'defined', 'discussed') AS status")


@query(with_(PASSAGES_SQL) + " SELECT case_id, passage_id, doc_id FROM passages p WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.case_id = p.case_id AND d.doc_id = p.doc_id)")
def j10_dangling_documents(spark, sf):
    return K.dangling_documents(passages(spark, sf), documents(spark, sf))


@query(with_(PASSAGES_SQL) + """, r AS (SELECT case_id, passage_id, 'markets' AS kind, unnest(supports_markets) AS ref FROM passages
      UNION ALL SELECT case_id, passage_id, 'theories', unnest(supports_theories) FROM passages)
    SELECT case_id, kind, ref, passage_id FROM r WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.case_id = r.case_id AND i.market_id = r.ref)""")  # fmt: skip
def j11_dangling_support(spark, sf):
    known = items(spark, sf).select("case_id", F.col("market_id").alias("ref"))
    return K.dangling_support(passages(spark, sf), {"markets": known, "theories": known})


@query(with_(PASSAGES_SQL) + """, l AS (SELECT case_id, unnest(supports_markets) AS market_id, doc_id FROM passages),
    b AS (SELECT case_id, market_id, bool_and(doc_type = 'complaint') AS alone, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS docs FROM l JOIN docs USING (case_id, doc_id) GROUP BY 1, 2)
    SELECT case_id, market_id, docs FROM items JOIN b USING (case_id, market_id) WHERE status = 'defined' AND alone""")  # fmt: skip
def j12_complaint_only_support(spark, sf):
    return K.complaint_only(items(spark, sf), passages(spark, sf), documents(spark, sf))


@query("SELECT l_orderkey AS case_id, l_linenumber AS test_id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a10_duplicate_ids(spark, sf):
    d = A.table(spark, sf, "lineitem").selectExpr("l_orderkey AS case_id", "l_linenumber AS test_id")
    return K.duplicates(d, "case_id", "test_id")


@query(with_(PASSAGES_SQL) + """ SELECT case_id, trim(quote) AS quote, string_agg(passage_id::VARCHAR, ',' ORDER BY passage_id) AS passages FROM passages
    WHERE trim(quote) <> '' GROUP BY 1, 2 HAVING count(*) > 1""")  # fmt: skip
def a20_duplicate_quotes(spark, sf):
    return K.duplicate_quotes(passages(spark, sf))


@query(with_(PASSAGES_SQL) + """, t AS (SELECT case_id, unnest(supports_theories) AS theory_id, role FROM passages)
    SELECT case_id, theory_id FROM t GROUP BY 1, 2 HAVING bool_and(role IN ('conclusion', '')) AND bool_or(role = 'conclusion')""")  # fmt: skip
def a21_conclusion_only_theories(spark, sf):
    return K.conclusion_only(passages(spark, sf))


@query(with_(PASSAGES_SQL) + " SELECT case_id, passage_id, role FROM passages WHERE len(supports_theories) = 0 AND role NOT IN ('conclusion')")
def a22_orphan_passages(spark, sf):
    p = passages(spark, sf).withColumn("supports_markets", F.array().cast("array<bigint>"))
    return K.orphans(p, ["conclusion"])


@query(with_(PASSAGES_SQL) + " SELECT case_id, string_agg(passage_id::VARCHAR, ',' ORDER BY passage_id) AS passages FROM passages WHERE role IN ('', 'unset') GROUP BY 1")
def a24_unset_roles(spark, sf):
    return K.unset_roles(passages(spark, sf), ["", "unset"])


@query(with_(PASSAGES_SQL) + """, f AS (SELECT case_id, 'ERROR' AS level FROM passages p WHERE doc_id = 3
      UNION ALL SELECT case_id, 'WARNING' FROM passages WHERE len(supports_theories) = 0 AND role NOT IN ('conclusion')
      UNION ALL SELECT case_id, 'INFO' FROM (SELECT DISTINCT case_id FROM passages WHERE role = ''))
    SELECT case_id, count(*) FILTER (level = 'ERROR') AS error, count(*) FILTER (level = 'WARNING') AS warning, count(*) FILTER (level = 'INFO') AS info FROM f GROUP BY 1""")  # fmt: skip
def a25_readiness(spark, sf):
    p = passages(spark, sf)
    q = p.withColumn("supports_markets", F.array().cast("array<bigint>"))
    return K.readiness({"documents": ("ERROR", K.dangling_documents(p, documents(spark, sf))), "orphans": ("WARNING", K.orphans(q, ["conclusion"])), "roles": ("INFO", K.unset_roles(p, [""]))})


@query(with_(PASSAGES_SQL) + """, n AS (SELECT case_id, doc_id, count(*) AS n FROM passages GROUP BY 1, 2), t AS (SELECT case_id, count(*) AS t FROM passages GROUP BY 1)
    SELECT d.case_id, d.doc_id, coalesce(n, 0) AS passages, coalesce(t, 0) AS total FROM docs d LEFT JOIN n USING (case_id, doc_id) LEFT JOIN t USING (case_id)""")  # fmt: skip
def a49_citations(spark, sf):
    return K.citations(passages(spark, sf), documents(spark, sf))


@query(with_(PASSAGES_SQL) + """, l AS (SELECT case_id, unnest(supports_markets) AS market_id, passage_id, page > 25 AS valid FROM passages),
    b AS (SELECT case_id, market_id, bool_or(valid) AS ok, coalesce(string_agg(DISTINCT passage_id::VARCHAR, ',' ORDER BY passage_id::VARCHAR) FILTER (NOT valid), '') AS failed FROM l GROUP BY 1, 2)
    SELECT case_id, market_id, coalesce(failed, '') AS failed FROM items LEFT JOIN b USING (case_id, market_id) WHERE NOT coalesce(ok, FALSE)""")  # fmt: skip
def g09_unsupported_items(spark, sf):
    return K.unsupported(items(spark, sf).drop("status"), "market_id", passages(spark, sf), "supports_markets", F.col("page") > 25)


@query("""SELECT o_orderkey AS case_id, unnest(list_filter([CASE WHEN o_totalprice <= 300000 THEN NULL ELSE 'price_range' END, CASE WHEN o_orderstatus IN ('F', 'O') THEN NULL ELSE 'outcome' END,
    CASE WHEN year(o_orderdate) >= 1993 THEN NULL ELSE 'date' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")  # fmt: skip
def g01_schema_violations(spark, sf):
    o = A.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "case_id")
    return K.violations(o, "case_id", {"price_range": F.col("o_totalprice") <= 300000, "outcome": F.col("o_orderstatus").isin("F", "O"), "date": F.year("o_orderdate") >= 1993})


@query("""WITH s AS (SELECT user_id AS case_id, CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'signup' THEN 'WARN' ELSE 'PASS' END AS status FROM events)
    SELECT case_id, CASE max(CASE status WHEN 'FAIL' THEN 3 WHEN 'WARN' THEN 2 ELSE 1 END) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'WARN' ELSE 'PASS' END AS verdict, count(*) AS items FROM s GROUP BY 1""")  # fmt: skip
def a48_entry_verdict(spark, sf):
    e = A.table(spark, sf, "events")
    return K.verdict(e.selectExpr("user_id AS case_id", "case event_type when 'error' then 'FAIL' when 'signup' then 'WARN' else 'PASS' end AS status"))


@query("""WITH r AS (SELECT event_id, user_id AS doc, CASE WHEN event_id % 2 = 0 THEN 'pdf' ELSE 'case_page' END AS kind, CASE event_type WHEN 'error' THEN 'broken' ELSE 'ok' END AS status
      FROM events),
    o AS (SELECT doc, bool_or(kind = 'pdf' AND status = 'ok') AS ok FROM r GROUP BY 1)
    SELECT event_id, doc, kind, status, CASE WHEN status = 'ok' THEN 'PASS' WHEN kind = 'case_page' AND ok THEN 'WARN' ELSE 'FAIL' END AS level FROM r JOIN o USING (doc)""")  # fmt: skip
def a47_failed_links(spark, sf):
    e = A.table(spark, sf, "events")
    return K.failed_links(e.selectExpr("event_id", "user_id AS doc", "if(event_id % 2 = 0, 'pdf', 'case_page') AS kind", "if(event_type = 'error', 'broken', 'ok') AS status"))


# ------------------------------------------------------------------ drafts: parts by parity of the key


def part_drafts(spark, sf):
    p = A.table(spark, sf, "part")
    return p.selectExpr("cast(p_size AS bigint) AS case_id", "p_partkey AS seq", "p_partkey % 2 AS draft", "lower(p_type) AS key", "p_name AS text", "if(p_partkey % 3 = 0, '', p_brand) AS brand", "array(p_brand, p_type) AS tags")


PARTS_SQL = """d AS (SELECT p_size::BIGINT AS case_id, p_partkey AS seq, p_partkey % 2 AS draft, lower(p_type) AS key, p_name AS text,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS brand, p_brand, p_type FROM part)"""


@query(with_(PARTS_SQL, """m AS (SELECT case_id, key, min(seq) AS first_seq, count(*) - 1 AS collapsed, arg_max(text, length(text) * 1000000000 - seq) AS text,
      arg_min(brand, seq) FILTER (brand <> '') AS brand FROM d GROUP BY 1, 2),
    u AS (SELECT case_id, key, tag, min(seq * 2 + i) AS place FROM (SELECT case_id, key, seq, unnest([p_brand, p_type]) AS tag, unnest([0, 1]) AS i FROM d) GROUP BY 1, 2, 3),
    l AS (SELECT case_id, key, string_agg(tag, ',' ORDER BY place) AS tags FROM u GROUP BY 1, 2)""") + """
    SELECT case_id, key, first_seq, collapsed, text, brand, tags, 'pm_' || row_number() OVER (PARTITION BY case_id ORDER BY first_seq) AS new_id FROM m JOIN l USING (case_id, key)""")  # fmt: skip
def a26_record_merge(spark, sf):
    d = D.merged_records(part_drafts(spark, sf), ["key"], ["text"], ["brand"], ["tags"], "pm")
    return d.withColumn("tags", F.array_join("tags", ","))


@query(with_(PARTS_SQL, """m AS (SELECT case_id, key, min(seq) AS s FROM d GROUP BY 1, 2), n AS (SELECT case_id, key, 'pm_' || row_number() OVER (PARTITION BY case_id ORDER BY s) AS new_id FROM m),
    r AS (SELECT d.case_id, (seq // 7)::VARCHAR AS owner, seq AS pos, CASE WHEN seq % 5 = 0 THEN 'x' || seq ELSE new_id END AS ref FROM d JOIN n USING (case_id, key)),
    f AS (SELECT case_id, owner, ref, min(pos) AS pos FROM r GROUP BY 1, 2, 3)""") + " SELECT case_id, owner, string_agg(ref, ',' ORDER BY pos) AS refs FROM f GROUP BY 1, 2")  # fmt: skip
def a29_reference_rewrite(spark, sf):
    d = part_drafts(spark, sf)
    ids = D.merged_records(d, ["key"], [], [], [], "pm").select("case_id", "key", "new_id")
    old = F.concat(F.lit("x"), "seq")
    known = d.where("seq % 5 <> 0").join(ids, ["case_id", "key"]).select("case_id", "draft", old.alias("old_id"), "new_id")
    refs = d.select("case_id", F.floor(F.col("seq") / 7).cast("string").alias("owner"), F.col("seq").alias("pos"), "draft", old.alias("old_id"))
    return D.rewritten_refs(refs, known).withColumn("refs", F.array_join("refs", ","))


@query(with_(PARTS_SQL) + """ SELECT case_id, coalesce(arg_min(brand, seq) FILTER (brand <> '' AND draft = 1), arg_min(brand, seq) FILTER (brand <> '')) AS brand,
    coalesce(arg_min(text, seq) FILTER (draft = 1), arg_min(text, seq)) AS text FROM d GROUP BY 1""")  # fmt: skip
def a31_scalar_precedence(spark, sf):
    return D.scalar_choice(part_drafts(spark, sf), "case_id", ["brand", "text"], F.col("draft") == 1)


def two_drafts(spark, sf):
    """Two drafts of priced items, a by even keys, b by every third key with some names written otherwise."""
    p = A.table(spark, sf, "part")
    a = p.where("p_partkey % 2 = 0").selectExpr("p_partkey AS key", "p_name AS name", "p_type AS kind", "cast(p_size AS string) AS size")
    b = p.where("p_partkey % 3 = 0").selectExpr("p_partkey AS key", "if(p_partkey % 4 = 0, upper(p_name), p_name) AS name", "if(p_partkey % 5 = 0, p_brand, p_type) AS kind", "cast(p_size AS string) AS size")
    return a, b


TWO_SQL = """a AS (SELECT p_partkey AS key, p_name AS name, p_type AS kind, p_size::VARCHAR AS size FROM part WHERE p_partkey % 2 = 0),
    b AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_type END AS kind, p_size::VARCHAR AS size
          FROM part WHERE p_partkey % 3 = 0)"""


@query(with_(TWO_SQL) + " SELECT key, CASE WHEN b.key IS NULL THEN 'a_only' WHEN a.key IS NULL THEN 'b_only' ELSE 'both' END AS side FROM a FULL JOIN b USING (key)")
def j20_draft_alignment(spark, sf):
    return D.aligned(*two_drafts(spark, sf), "key")


@query(with_(TWO_SQL) + """, j AS (SELECT a.key, unnest(['name', 'kind', 'size']) AS field, unnest([a.name, a.kind, a.size]) AS a, unnest([b.name, b.kind, b.size]) AS b FROM a JOIN b USING (key))
    SELECT key, field, a, b, CASE WHEN a = b THEN 'agreed' WHEN lower(trim(a)) = lower(trim(b)) THEN 'auto_resolved' ELSE 'conflict' END AS outcome FROM j""")  # fmt: skip
def u05_draft_conflicts(spark, sf):
    return D.conflicts(*two_drafts(spark, sf), "key", ["name", "kind", "size"])


@query(with_(TWO_SQL) + """, r AS (SELECT key, CASE key % 12 WHEN 0 THEN 'drop' WHEN 6 THEN 'use_b' END AS decision FROM a JOIN b USING (key))
    SELECT a.key, CASE WHEN decision = 'use_b' THEN b.name ELSE a.name END AS name, 'a' AS origin FROM a LEFT JOIN r USING (key) LEFT JOIN b USING (key) WHERE decision IS DISTINCT FROM 'drop'
    UNION ALL SELECT key, name, 'b' FROM b WHERE key NOT IN (SELECT key FROM a)""")  # fmt: skip
def j27_conflict_resolution(spark, sf):
    a, b = two_drafts(spark, sf)
    r = a.join(b, "key", "left_semi").selectExpr("key", "if(key % 12 = 0, 'drop', 'use_b') AS decision", "cast(null AS bigint) AS new")
    return D.resolved(a, b, r, "key", "name")


@query(with_(TWO_SQL) + " SELECT a.key, coalesce(b.name, a.name) AS name, coalesce(b.kind, a.kind) AS kind, a.size FROM a LEFT JOIN b USING (key)")
def j28_seed_overlay(spark, sf):
    a, b = two_drafts(spark, sf)
    return D.overlaid(a, b, "key", ["name", "kind"])


@query("""WITH g AS (SELECT p_partkey AS gold_id, p_name || '|' || (p_partkey % 5) AS name, [p_name || '|' || (p_partkey % 7)] AS al, [p_brand] AS en, [p_partkey + 1] AS ids FROM part WHERE p_partkey % 10 = 0),
    d AS (SELECT p_partkey AS draft_id, CASE WHEN p_partkey % 9 = 0 THEN lower(p_brand) ELSE p_name || '|' || (p_partkey % 11) END AS name FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 10 = 1),
    m AS (SELECT gold_id, draft_id, 1 AS tier FROM g JOIN d ON lower(g.name) = d.name UNION ALL SELECT gold_id, draft_id, 2 FROM g JOIN d ON lower(al[1]) = d.name
          UNION ALL SELECT gold_id, draft_id, 3 FROM g JOIN d ON lower(en[1]) = d.name UNION ALL SELECT gold_id, draft_id, 4 FROM g JOIN d ON ids[1] = draft_id)
    SELECT gold_id, draft_id, tier::INT AS tier FROM m QUALIFY row_number() OVER (PARTITION BY gold_id ORDER BY tier, draft_id) = 1""")  # fmt: skip
def j21_gold_draft_match(spark, sf):
    p = A.table(spark, sf, "part")
    g = p.where("p_partkey % 10 = 0").selectExpr("p_partkey AS gold_id", "concat(p_name, '|', p_partkey % 5) AS name", "array(concat(p_name, '|', p_partkey % 7)) AS aliases", "array(p_brand) AS expected_names", "array(p_partkey + 1) AS expected_ids")
    d = p.where("p_partkey % 3 = 0 or p_partkey % 10 = 1").selectExpr("p_partkey AS draft_id", "if(p_partkey % 9 = 0, lower(p_brand), concat(p_name, '|', p_partkey % 11)) AS name", "p_partkey AS seq")
    return D.gold_matches(g, d)


# ------------------------------------------------------------------ evaluation and promotion


@query("""WITH j AS (SELECT lang AS key, quality = 1 AS gold, n_chars > 1500 AS draft, lang IN ('fr', 'de') AS partial, doc_id % 2 = 0 AS reviewed FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT key, count(*) FILTER (gold AND draft) AS tp, count(*) FILTER (NOT gold AND draft AND (NOT partial OR reviewed)) AS fp, count(*) FILTER (gold AND NOT draft) AS fn,
          count(*) FILTER (NOT gold AND draft AND partial AND NOT reviewed) AS unjudged FROM j GROUP BY 1)
    SELECT *, round(tp / (tp + fp), 3) AS precision, round(tp / (tp + fn), 3) AS recall, round(2 * tp / (2 * tp + fp + fn), 3) AS f1 FROM c""")  # fmt: skip
def a34_precision_recall(spark, sf):
    d = A.table(spark, sf, "documents").join(A.table(spark, sf, "labels"), "doc_id")
    return E.scores(d.selectExpr("lang AS key", "quality = 1 AS gold", "n_chars > 1500 AS draft", "lang in ('fr', 'de') AS partial", "doc_id % 2 = 0 AS reviewed"), "key")


@query(with_(A.LINES_SQL) + """, c AS (SELECT l_orderkey AS case_id, (l_partkey % 6)::VARCHAR AS k, l_returnflag AS pool FROM lines),
    s AS (SELECT DISTINCT case_id, k FROM c WHERE pool = 'A'), r AS (SELECT DISTINCT case_id, k, 1 AS hit FROM c WHERE pool <> 'A')
    SELECT case_id, count(*) AS safe, count(hit) AS overpromoted, round(count(hit) / count(*), 3) AS ratio FROM s LEFT JOIN r USING (case_id, k) GROUP BY 1""")  # fmt: skip
def a35_overpromotion(spark, sf):
    c = A.lines(spark, sf).selectExpr("l_orderkey AS case_id", "cast(l_partkey % 6 AS string) AS name", "l_returnflag AS pool")
    return E.overpromoted(c, F.col("pool") == "A", F.col("pool") != "A")


@query("""SELECT event_id, CASE WHEN value <= 1 THEN 'schema' WHEN event_type = 'error' THEN 'conflict' WHEN value > 40 THEN 'quotes' WHEN user_id % 9 = 0 THEN 'readiness' ELSE 'promoted' END AS gate FROM events""")
def a43_gate_chain(spark, sf):
    gates = [("schema", F.col("value") > 1), ("conflict", F.col("event_type") != "error"), ("quotes", F.col("value") <= 40), ("readiness", F.col("user_id") % 9 != 0)]
    return A.table(spark, sf, "events").select("event_id", E.first_failure(gates).alias("gate"))


@query("""WITH k AS (SELECT unnest(['click', 'view', 'error', 'refund']) AS event_type) SELECT k.event_type, count(e.event_id) AS n FROM k LEFT JOIN events e USING (event_type) GROUP BY 1""")
def a44_outcome_counts(spark, sf):
    return E.counts_of(A.table(spark, sf, "events"), "event_type", ["click", "view", "error", "refund"])


@query("SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def a42_language_counts(spark, sf):
    return A.table(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n")).orderBy("lang")


@query("""SELECT 'returnflag' AS dimension, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2""")  # fmt: skip
def a39_triage_histograms(spark, sf):
    li = A.table(spark, sf, "lineitem").selectExpr("l_returnflag AS returnflag", "l_linestatus AS linestatus", "l_linenumber AS linenumber")
    return E.triage(li, ["returnflag", "linestatus", "linenumber"])


@query("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS action, CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS kind, count(*) AS n
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")  # fmt: skip
def a40_plan_summary(spark, sf):
    return E.plan_summary(A.table(spark, sf, "lineitem").selectExpr("l_returnflag AS action", "l_linestatus AS kind"), ["action", "kind"])


@query("SELECT count(*) AS cases, count(*) FILTER (quality = 1 AND toxic = 0) AS passed, round(count(*) FILTER (quality = 1 AND toxic = 0) / count(*), 3) AS rate FROM labels")
def a37_benchmark_totals(spark, sf):
    return E.benchmark(A.table(spark, sf, "labels"), (F.col("quality") == 1) & (F.col("toxic") == 0))


@query("SELECT event_id, ts, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def s18_latest_state(spark, sf):
    return E.latest(A.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"), "user_id", "ts", "event_id")


@query("SELECT c_custkey AS item FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def s13_pending_items(spark, sf):
    e = A.table(spark, sf, "events").withColumnRenamed("user_id", "item")
    return E.pending(A.table(spark, sf, "customer").selectExpr("c_custkey AS item"), e, "item", F.col("event_type") == "purchase")


@query("SELECT o_custkey AS case_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END::INT AS priority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY priority, o_orderkey) = 1")
def j29_promotion_candidates(spark, sf):
    return E.candidates(A.table(spark, sf, "orders").selectExpr("o_custkey AS case_id", "o_orderkey AS seq", "case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end AS priority"))


@query("""SELECT o_orderkey AS case_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'not_applicable' WHEN o_orderstatus = 'P' THEN 'phase_2_outcome' WHEN o_orderkey % 7 = 0 THEN 'no_pdf'
    WHEN o_orderkey % 4 = 1 THEN 'already_canonical' ELSE 'eligible' END AS reason FROM orders""")  # fmt: skip
def p17_extraction_queue(spark, sf):
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS case_id", "if(o_orderpriority = '5-LOW', 'not_applicable', 'pending') AS status", "o_orderstatus AS outcome", "if(o_orderkey % 7 = 0, null, 'x.pdf') AS pdf_url")
    canonical = o.where("case_id % 4 = 1").select("case_id", F.lit(True).alias("canonical"))
    return E.queue(o.join(canonical, "case_id", "left")).select("case_id", "reason")


@query("""WITH n AS (SELECT l_orderkey AS case_id, count(*) AS pages FROM lineitem GROUP BY 1),
    s AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 4 = 1 THEN 'extracted' WHEN pages IS NULL THEN 'unknown' WHEN pages <= 2 THEN 'not_applicable' ELSE 'pending' END AS new,
          CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'P' THEN 'unknown' END AS old FROM orders LEFT JOIN n ON o_orderkey = case_id)
    SELECT case_id, CASE WHEN old IS NOT NULL AND old <> 'unknown' AND new <> 'extracted' THEN old WHEN new = 'unknown' AND old IS NOT NULL THEN old ELSE new END AS status FROM s""")  # fmt: skip
def p18_extraction_status(spark, sf):
    n = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count("*").alias("pages"))
    o = A.table(spark, sf, "orders").selectExpr("o_orderkey AS case_id", "o_orderkey % 4 = 1 AS canonical", "case o_orderstatus when 'F' then 'pending' when 'P' then 'unknown' end AS old")
    return E.status_of(o.join(n, "case_id", "left"), 2).select("case_id", "status")
