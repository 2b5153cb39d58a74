"""Queries of the graph and vector operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import graph as G
from caseloom.operators import nearest as N
from caseloom.plans.catalog import with_
from caseloom.sources import adapters as A

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def tables(spark, sf):
    c, m = A.cases(spark, sf), A.markets(spark, sf)
    market = F.concat_ws("/", F.col("case_id").cast("string"), F.col("market_id").cast("string"))
    n = G.nodes({
        "Case": (c, F.col("case_id"), F.col("case_name")),
        "Authority": (c, F.col("authority"), F.col("authority")),
        "Jurisdiction": (c, F.col("jurisdiction"), F.col("jurisdiction")),
        "Party": (c, F.col("case_name"), F.col("case_name")),
        "Market": (m, market, F.col("name")),
    })
    e = G.edges({
        "DECIDED_BY": (c, "Case", F.col("case_id"), "Authority", F.col("authority")),
        "OF": (c, "Authority", F.col("authority"), "Jurisdiction", F.col("jurisdiction")),
        "HAS_PARTY": (c, "Case", F.col("case_id"), "Party", F.col("case_name")),
        "HAS_MARKET": (m, "Case", F.col("case_id"), "Market", market),
    })
    return n, e


GRAPH_SQL = f"""{A.CASES_SQL}, {A.MARKETS_SQL},
nodes AS (SELECT 'Case' AS label, case_id::VARCHAR AS key, min(case_name) AS name FROM cases GROUP BY 2
    UNION ALL SELECT DISTINCT 'Authority', authority, authority FROM cases UNION ALL SELECT DISTINCT 'Jurisdiction', jurisdiction, jurisdiction FROM cases
    UNION ALL SELECT DISTINCT 'Party', case_name, case_name FROM cases UNION ALL SELECT 'Market', case_id || '/' || market_id, min(name) FROM markets GROUP BY 2),
edges AS (SELECT 'DECIDED_BY' AS type, 'Case' AS src_label, case_id::VARCHAR AS src, 'Authority' AS dst_label, authority AS dst FROM cases
    UNION SELECT 'OF', 'Authority', authority, 'Jurisdiction', jurisdiction FROM cases UNION SELECT 'HAS_PARTY', 'Case', case_id::VARCHAR, 'Party', case_name FROM cases
    UNION SELECT 'HAS_MARKET', 'Case', case_id::VARCHAR, 'Market', case_id || '/' || market_id FROM markets)"""


@query(with_(GRAPH_SQL) + " SELECT label, key, name FROM nodes")
def s09_graph_nodes(spark, sf):
    return tables(spark, sf)[0]


@query(with_(GRAPH_SQL) + " SELECT type, src_label, src, dst_label, dst FROM edges")
def s09_graph_edges(spark, sf):
    return tables(spark, sf)[1]


@query("SELECT p_type AS label, p_name AS key, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def s10_broken_keys(spark, sf):
    return G.broken_keys(A.table(spark, sf, "part").selectExpr("p_type AS label", "p_name AS key"))


@query(with_(GRAPH_SQL) + """ SELECT src, type, count(*) AS n, string_agg(DISTINCT name, '|' ORDER BY name) AS names
    FROM edges e JOIN nodes n ON e.dst_label = n.label AND e.dst = n.key WHERE src_label = 'Case' GROUP BY 1, 2""")  # fmt: skip
def j01_neighbourhoods(spark, sf):
    n, e = tables(spark, sf)
    return G.neighbourhoods(e, n, "Case")


@query(with_(GRAPH_SQL) + " SELECT a.src, a.dst AS via, b.dst FROM edges a JOIN edges b ON a.dst = b.src AND a.dst_label = b.src_label WHERE a.type = 'DECIDED_BY' AND b.type = 'OF'")
def j01_two_hops(spark, sf):
    return G.two_hops(tables(spark, sf)[1], "DECIDED_BY", "OF")


@query(with_(GRAPH_SQL, """e2 AS (SELECT type, src, dst_label, dst FROM edges UNION SELECT 'SIMILAR_TO', case_id::VARCHAR, 'Case', (case_id + 3)::VARCHAR FROM cases WHERE case_id % 50 = 0)""") + """
    SELECT src || '->' || dst || ':' || type AS edge_id, dst_label, name, CASE WHEN dst_label = 'Case' AND n.key IS NOT NULL THEN '/cases/' || dst END AS href
    FROM e2 LEFT JOIN nodes n ON dst_label = n.label AND dst = n.key""")  # fmt: skip
def j03_drawn_edges(spark, sf):
    n, e = tables(spark, sf)
    c = A.cases(spark, sf)
    similar = G.edges({"SIMILAR_TO": (c.where("case_id % 50 = 0"), "Case", F.col("case_id"), "Case", F.col("case_id") + 3)})
    return G.drawn(e.unionByName(similar), n, c)


COSINE_SQL = """v AS (SELECT vec_id AS id, [x::DOUBLE for x in embedding] AS e FROM embeddings),
    s AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.e, v.e) AS similarity FROM v, (SELECT * FROM v WHERE id % 100 = 0) q),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, id)::INT AS rank FROM s WHERE similarity >= 0.5)"""


#: The same with a lower floor: few of the given vectors are near one another.
WIDE_SQL = COSINE_SQL.replace(">= 0.5", ">= 0.2")


def vector_hits(spark, sf, k, floor=0.5):
    v = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return N.top_k(v, v.where("id % 100 = 0"), k, floor)


@query(with_(COSINE_SQL) + " SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM h WHERE rank <= 10")
def k01_vector_search(spark, sf):
    return vector_hits(spark, sf, 10).withColumn("similarity", F.round("similarity", 6))


@query(with_(COSINE_SQL) + " SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM h WHERE rank <= 20")
def k02_vector_top_k(spark, sf):
    return vector_hits(spark, sf, 20).withColumn("similarity", F.round("similarity", 6))


@query(with_(A.CASES_SQL, WIDE_SQL) + " SELECT query_id, rank, case_id, case_name, round(similarity, 6) AS similarity FROM h JOIN cases ON id = case_id WHERE rank <= 10 AND layer = 'canonical'")
def j09_semantic_catalog(spark, sf):
    c = A.cases(spark, sf).where("layer = 'canonical'")
    return N.with_catalog(vector_hits(spark, sf, 20, 0.2), c, 10).withColumn("similarity", F.round("similarity", 6))


@query(with_(A.THEORIES_SQL, WIDE_SQL) + """, x AS (SELECT DISTINCT case_id FROM theories WHERE lower(trim(name)) = 'brand#12'),
    m AS (SELECT id AS case_id, min(rank)::INT AS rank FROM h WHERE rank <= 20 GROUP BY 1)
    SELECT case_id, 0 AS rank, 'exact' AS match FROM x UNION ALL SELECT case_id, rank, 'semantic' FROM m WHERE case_id NOT IN (FROM x)""")  # fmt: skip
def j07_exact_then_semantic(spark, sf):
    exact = A.theories(spark, sf).where("lower(trim(name)) = 'brand#12'").select("case_id")
    return N.exact_then_semantic(exact, vector_hits(spark, sf, 20, 0.2).withColumnRenamed("id", "case_id"))


@query("""WITH o AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS size FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey AS id, upper(p_name) AS name, p_type AS brand, p_size + 1 AS size FROM part WHERE p_partkey % 3 = 0)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN o.id IS NULL THEN n.brand ELSE o.brand END AS brand,
           CASE WHEN n.id IS NOT NULL THEN n.size ELSE o.size END AS size FROM o FULL JOIN n ON o.id = n.id""")  # fmt: skip
def s08_vector_upsert(spark, sf):
    p = A.table(spark, sf, "part")
    old = p.where("p_partkey % 2 = 0").selectExpr("p_partkey AS id", "p_name AS name", "p_brand AS brand", "p_size AS size")
    new = p.where("p_partkey % 3 = 0").selectExpr("p_partkey AS id", "upper(p_name) AS name", "p_type AS brand", "p_size + 1 AS size")
    return N.upserted(old, new, "id", ["name", "size"])
