"""Views of the landed tables as the engine's inputs: cases with their markets and theories, deals, quotes, drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, case_name, jurisdiction, authority, decision_date, sector, outcome, layer; one row per order."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    d = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return d.select(
        F.col("o_orderkey").alias("case_id"),
        F.col("c_name").alias("case_name"),
        F.col("r_name").alias("jurisdiction"),
        F.col("n_name").alias("authority"),
        F.to_date("o_orderdate").alias("decision_date"),
        F.col("o_orderpriority").alias("sector"),
        F.col("o_orderstatus").alias("outcome"),
        F.when(F.col("o_orderkey") % 4 == 0, "indexed").otherwise("canonical").alias("layer"),
    )


CASES_SQL = """cases AS (
    SELECT o_orderkey AS case_id, c_name AS case_name, r_name AS jurisdiction, n_name AS authority, o_orderdate::DATE AS decision_date,
           o_orderpriority AS sector, o_orderstatus AS outcome, CASE WHEN o_orderkey % 4 = 0 THEN 'indexed' ELSE 'canonical' END AS layer
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, one for each order and line number: the first by part, supplier, quantity and price."""
    order = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


LINES_SQL = """lines AS (
    SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)"""


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, market_id, seq (load order), name, status, notes; one row per line of a canonical case."""
    li, p = lines(spark, sf_dir).where("l_orderkey % 4 <> 0"), table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("market_id"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.col("p_type").alias("name"),
        F.col("l_returnflag").alias("status"),
        F.col("p_name").alias("notes"),
        F.col("p_partkey").alias("part"),
    )


MARKETS_SQL = f"""{LINES_SQL},
markets AS (
    SELECT l_orderkey AS case_id, l_linenumber AS market_id, l_orderkey * 100 + l_linenumber AS seq, p_type AS name,
           l_returnflag AS status, p_name AS notes, p_partkey AS part
    FROM lines JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 4 <> 0)"""


def theories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, theory_id, seq, name, description; one row per line item of a canonical case."""
    m = markets(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    return m.join(p, "part").select("case_id", F.col("market_id").alias("theory_id"), "seq", F.col("brand").alias("name"), F.col("notes").alias("description"))


THEORIES_ONLY_SQL = """theories AS (
    SELECT case_id, market_id AS theory_id, seq, p_brand AS name, notes AS description FROM markets JOIN part ON part = p_partkey)"""

THEORIES_SQL = f"{MARKETS_SQL},\n{THEORIES_ONLY_SQL}"


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number (from 1), text: the lines of each document as its pages."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page_number"), "text")


PAGES_SQL = """text_pages AS (
    SELECT doc_id, i::INT AS page_number, l[i] AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"""
