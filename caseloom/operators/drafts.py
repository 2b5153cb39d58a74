"""Drafts of records: merging by natural key, reference rewriting, alignment, conflicts and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def merged_records(items: DataFrame, keys: list[str], longest: list[str], blanks: list[str], lists: list[str], prefix: str) -> DataFrame:
    """One record per key: lists united in order, the longest text (the first of them), blanks filled by the first value, new ids.

    items have case_id and seq (draft, then place). Ids run within the case in the order of first appearance.
    """
    g = items.groupBy("case_id", *keys)
    aggs = [F.min("seq").alias("first_seq"), F.count("*").alias("collapsed")]
    aggs += [F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col("seq"))).alias(c) for c in longest]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("seq"))).alias(c) for c in blanks]
    aggs += [F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", c))), _field(c)))).alias(c) for c in lists]
    d = g.agg(*aggs)
    number = F.row_number().over(W.partitionBy("case_id").orderBy("first_seq"))
    return d.withColumn("new_id", F.concat(F.lit(f"{prefix}_"), number)).withColumn("collapsed", F.col("collapsed") - 1)


def _field(name: str):
    return lambda x: x[name]


def rewritten_refs(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Refs (case_id, owner, pos, draft, old_id) by ids (case_id, draft, old_id, new_id): lists in order, without repeats; unknown ids stay."""
    d = refs.join(ids, ["case_id", "draft", "old_id"], "left").withColumn("ref", F.coalesce("new_id", "old_id"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"])
    return d.groupBy("case_id", "owner").agg(F.array_distinct(ordered).alias("refs"))


def scalar_choice(drafts: DataFrame, key: str, fields: list[str], preferred: Column) -> DataFrame:
    """Per key and field, the first non-empty value, preferred drafts first."""
    order = F.struct(F.when(preferred, 0).otherwise(1), "seq")
    return drafts.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), order)).alias(f) for f in fields])


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Key, side (both, a_only, b_only) of two drafts' items."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a_only").otherwise("b_only")
    return x.join(y, key, "full").select(key, side.alias("side"))


def conflicts(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Key, field, a, b, outcome (agreed, auto_resolved, conflict): values that differ in case and space alone are resolved."""
    shape = lambda d, side: d.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(side)) for f in fields])).alias("x")).select(key, "x.*")
    d = shape(a, "a").join(shape(b, "b"), [key, "field"])
    plain = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")
    outcome = F.when(F.col("a").eqNullSafe(F.col("b")), "agreed").when(plain("a") == plain("b"), "auto_resolved").otherwise("conflict")
    return d.withColumn("outcome", outcome)


def resolved(a: DataFrame, b: DataFrame, resolutions: DataFrame, key: str, value: str) -> DataFrame:
    """Items of a with the resolutions (key, decision: keep, drop, rename, use_b, with new) applied, and what only b has.

    A resolution of an unknown key or decision is an error.
    """
    known = a.select(key).union(b.select(key)).distinct()
    lost = resolutions.join(known, key, "left_anti").union(resolutions.where(~F.col("decision").isin("keep", "drop", "rename", "use_b")))
    if lost.limit(1).count():
        raise ValueError(f"resolutions that cannot be applied: {lost.limit(3).collect()}")
    d = a.join(resolutions, key, "left").join(b.select(key, F.col(value).alias("b_value")), key, "left").where("decision is null or decision <> 'drop'")
    d = d.select(F.when(F.col("decision") == "rename", F.col("new")).otherwise(F.col(key)).alias(key), F.when(F.col("decision") == "use_b", F.col("b_value")).otherwise(F.col(value)).alias(value), F.lit("a").alias("origin"))
    only_b = b.join(a, key, "left_anti").join(resolutions.where("decision = 'drop'"), key, "left_anti")
    return d.unionByName(only_b.select(key, value, F.lit("b").alias("origin")))


def overlaid(draft: DataFrame, seed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The draft's rows with the seed's value of each field where the seed has one."""
    s = seed.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    d = draft.join(s, key, "left")
    return d.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in draft.columns])


def gold_matches(gold: DataFrame, drafts: DataFrame) -> DataFrame:
    """gold_id, draft_id, tier: exact name, alias, expected name, expected id in that order; the first draft in a tier.

    Of the drafts of one name only the first can be taken, so each key has one draft.

    gold: gold_id, name, aliases, expected_names, expected_ids; drafts: draft_id, name, seq.
    """
    norm = lambda c: F.lower(F.trim(c))
    first = lambda d, key: d.where(f"{key} is not null").groupBy(key).agg(F.min(F.struct("seq", "draft_id")).alias("first"))
    d = drafts.select("draft_id", norm(F.col("name")).alias("k"), "seq")
    g = gold.select("gold_id", F.array(norm(F.col("name"))).alias("t1"), F.transform("aliases", norm).alias("t2"), F.transform("expected_names", norm).alias("t3"), "expected_ids")
    by_name = g.select("gold_id", F.explode(F.array(*[F.struct(F.lit(i).alias("tier"), F.col(f"t{i}").alias("ks")) for i in (1, 2, 3)])).alias("x"))
    by_name = by_name.select("gold_id", "x.tier", F.posexplode("x.ks").alias("pos", "k")).join(first(d, "k"), "k")
    by_id = g.select("gold_id", F.lit(4).alias("tier"), F.posexplode("expected_ids").alias("pos", "id")).join(first(d.withColumn("id", F.col("draft_id")), "id"), "id")
    both = by_name.select("gold_id", "tier", "pos", "first").unionByName(by_id.select("gold_id", "tier", "pos", "first"))
    return both.groupBy("gold_id").agg(F.min(F.struct("tier", "pos", "first")).alias("one")).select("gold_id", "one.first.draft_id", "one.tier")


def known_to_gold(gold: DataFrame, drafts: DataFrame) -> DataFrame:
    """draft_id, known: whether a draft has the name, an alias, an expected name or the expected id of any gold item."""
    norm = lambda c: F.lower(F.trim(c))
    names = gold.select(F.explode(F.concat(F.array("name"), "aliases", "expected_names")).alias("k")).select(norm(F.col("k")).alias("k"))
    ids = gold.select(F.explode("expected_ids").alias("draft_id")).distinct().withColumn("by_id", F.lit(True))
    d = drafts.withColumn("k", norm(F.col("name"))).join(names.distinct().withColumn("by_name", F.lit(True)), "k", "left").join(ids, "draft_id", "left")
    return d.select("draft_id", (F.coalesce("by_name", F.lit(False)) | F.coalesce("by_id", F.lit(False))).alias("known"))


def merged_by_kind(items: DataFrame, by: dict[str, tuple[str, str]], longest: list[str]) -> DataFrame:
    """Items of each kind merged by the key of that kind (kind -> key, prefix of new ids): kind, case_id, key, collapsed, the longest texts."""
    parts = []
    for kind, (key, prefix) in by.items():
        d = merged_records(items.where(F.col("kind") == kind), [key], longest, [], [], prefix)
        parts.append(d.select(F.lit(kind).alias("kind"), "case_id", F.col(key).alias("key"), "collapsed", *longest))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def viewed_together(drafts: DataFrame, key: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """Per key the lists of all drafts one after another, and of other fields the first value that is not empty; drafts by seq."""
    some = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("seq"))
    aggs = [F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", c))), _field(c))).alias(c) for c in lists]
    return drafts.groupBy(key).agg(*aggs, *[F.min_by(c, some(c)).alias(c) for c in scalars])
