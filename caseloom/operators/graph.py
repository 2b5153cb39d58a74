"""The property graph of records as two tables, its key constraints, and one-hop neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nodes(parts: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """Label, key, name of all nodes; parts: label -> (rows, key, name). One row a key, the least name."""
    every = [d.select(F.lit(label).alias("label"), key.cast("string").alias("key"), name.cast("string").alias("name")) for label, (d, key, name) in parts.items()]
    return reduce(DataFrame.union, every).groupBy("label", "key").agg(F.min("name").alias("name"))


def edges(parts: dict[str, tuple[DataFrame, str, Column, str, Column]]) -> DataFrame:
    """Type, src_label, src, dst_label, dst of all edges, once each; parts: type -> (rows, source label, source, target label, target)."""
    every = [
        d.select(F.lit(kind).alias("type"), F.lit(sl).alias("src_label"), s.cast("string").alias("src"), F.lit(tl).alias("dst_label"), t.cast("string").alias("dst"))
        for kind, (d, sl, s, tl, t) in parts.items()
    ]
    return reduce(DataFrame.union, every).distinct()


def broken_keys(nodes: DataFrame) -> DataFrame:
    """Labels and keys that are not unique: none must be."""
    return nodes.groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1")


def neighbourhoods(edges: DataFrame, nodes: DataFrame, src_label: str) -> DataFrame:
    """Per source node and edge type, how many neighbours and their names. Each relation is gathered before any join on the source."""
    e = edges.where(F.col("src_label") == src_label).join(nodes.select(F.col("label").alias("dst_label"), F.col("key").alias("dst"), "name"), ["dst_label", "dst"])
    return e.groupBy("src", "type").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("name")), "|").alias("names"))


def two_hops(edges: DataFrame, first: str, second: str) -> DataFrame:
    """Src, via, dst over two edge types in a row (the jurisdiction through the authority)."""
    a = edges.where(F.col("type") == first).select("src", F.col("dst_label").alias("l"), F.col("dst").alias("via"))
    b = edges.where(F.col("type") == second).select(F.col("src_label").alias("l"), F.col("src").alias("via"), "dst")
    return a.join(b, ["l", "via"]).select("src", "via", "dst")


def drawn(edges: DataFrame, nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Edge id src->dst:TYPE with the target's label and name, and a link where the target is a case of the catalog."""
    d = edges.join(nodes.select(F.col("label").alias("dst_label"), F.col("key").alias("dst"), "name"), ["dst_label", "dst"], "left")
    known = catalog.select(F.col("case_id").cast("string").alias("dst"), F.lit("Case").alias("dst_label"), F.concat(F.lit("/cases/"), "case_id").alias("href"))
    edge_id = F.concat("src", F.lit("->"), "dst", F.lit(":"), "type")
    return d.join(known, ["dst_label", "dst"], "left").select(edge_id.alias("edge_id"), "dst_label", "name", "href")


def from_records(cases: DataFrame, markets: DataFrame) -> DataFrame:
    """Each case's neighbours from the records alone: authority, jurisdiction, how many markets and their names."""
    m = markets.groupBy("case_id").agg(F.count("*").alias("markets"), F.array_join(F.sort_array(F.collect_set("name")), "|").alias("names"))
    d = cases.join(m, "case_id", "left")
    return d.select("case_id", "authority", "jurisdiction", F.coalesce("markets", F.lit(0)).alias("markets"), F.coalesce("names", F.lit("")).alias("names"))
