"""Smaller operators: rule listings, draft filters, section batching, approximate vector index, verification of rule passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from caseloom.functions import text as T
from caseloom.operators import nearest


def rule_list(rules: DataFrame, tests: DataFrame) -> DataFrame:
    """Rules with the number of their tests, 0 included."""
    n = tests.groupBy("rule").agg(F.count("*").alias("tests"))
    return rules.join(n, "rule", "left").withColumn("tests", F.coalesce("tests", F.lit(0)).cast("long"))


def context(rules: DataFrame, ids: list, dropped: list[str]) -> DataFrame:
    """The chosen rules without some columns, each as JSON."""
    d = rules.where(F.col("rule").isin(ids)).drop(*dropped)
    return d.select("rule", F.to_json(F.struct(*d.columns)).alias("json"))


def in_range(chunks: DataFrame, first: int, last: int) -> DataFrame:
    """Pages of chunks within a range; chunks left without pages drop out."""
    return chunks.where(F.col("page_number").between(first, last) & (F.length("text") > 0))


def guarded(findings: DataFrame, focus: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Findings of the kinds a focus may report, their outcome unknown."""
    return findings.where(F.col("kind").isin(allowed[focus])).withColumn("outcome", F.lit("unknown"))


def cut_alias(c: Column) -> Column:
    """Aliases that are cut enumerations, list marks or claims."""
    return c.rlike(r"(,|;|\band|\bor)\s*$") | c.rlike(r"^\s*(\(?[a-z0-9]{1,2}[.)]|[-•])\s") | c.rlike(r"(?i)\b(may|might|could|should|would)\b")


def promotable(kind: Column, status: Column) -> Column:
    """Full-depth drafts by an approved status, others by one that begins with it."""
    return F.when(kind == "full_depth", status.isin("approved", "ready")).otherwise(F.startswith(status, F.lit("approved")))


def profile_of(explicit: Column, jurisdiction: Column, prefix: Column, by_jurisdiction: dict[str, str], by_prefix: dict[str, str]) -> Column:
    """The explicit profile, else that of the jurisdiction, else that of the id's prefix."""
    pick = lambda d, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), c)
    return F.coalesce(explicit, pick(by_jurisdiction, jurisdiction), pick(by_prefix, prefix), F.lit("default"))


def scaffold(entry: DataFrame) -> DataFrame:
    """A record begun from an index entry: upper-case jurisdiction, one document, language if it is one."""
    lang = F.when(T.is_language(F.col("lang")), F.col("lang"))
    doc = F.struct(F.concat(F.lit("doc_"), "case_id").alias("doc_id"), F.col("url"), lang.alias("language"))
    return entry.select("case_id", F.upper("jurisdiction").alias("jurisdiction"), F.array(doc).alias("documents"), F.lit("draft").alias("status"))


def gated_renames(pairs: DataFrame, floor: float = 0.45, overlap: float = 0.30) -> DataFrame:
    """Per existing item the most similar candidate that also shares enough product context; none: unsupported (null)."""
    ok = pairs.where((F.col("similarity") >= floor) & (F.col("overlap") >= overlap))
    best = ok.groupBy("item").agg(F.max_by("draft", F.struct("similarity", -F.col("draft"))).alias("draft"))
    return pairs.select("item").distinct().join(best, "item", "left")


def unit_merge(units: DataFrame) -> DataFrame:
    """Findings merged inside units by kind and segment (support united), then counted by unit."""
    f = units.groupBy("case_id", "unit", "kind", "segment").agg(F.min("seq").alias("seq"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("seq", "ref"))), lambda x: x["ref"])).alias("refs"))
    return f.groupBy("case_id", "unit").agg(F.count("*").alias("findings"), F.sum(F.size("refs")).alias("refs"), F.min("seq").alias("first_seq"))


#: Rows of a part of findings that a task aggregates at once.
PART = 1 << 18


def finding_stats(findings: DataFrame) -> DataFrame:
    """Per case and window: units, findings, conclusions by kind.

    Nearly every row is a group of its own, so rows are dealt before they are grouped, to as many parts as PART rows
    each make: hash maps hold a part, not a share of the input. A case's units are counted in a second step.
    """
    parts = max(findings.sparkSession.sparkContext.defaultParallelism, -(-findings.count() // PART))
    d = findings.select("case_id", "window", "unit", (F.col("conclusion") == "defined").alias("defined"), (F.col("conclusion") == "left_open").alias("left_open"))
    units = d.repartition(parts, "case_id", "window", "unit").groupBy("case_id", "window", "unit").agg(F.count("*").alias("findings"), F.count_if("defined").alias("defined"), F.count_if("left_open").alias("left_open"))
    return units.repartition(parts, "case_id", "window").groupBy("case_id", "window").agg(F.count("unit").alias("units"), *[F.sum(c).alias(c) for c in ("findings", "defined", "left_open")])


def coverage_gaps(planned: DataFrame, found: DataFrame) -> DataFrame:
    """Categories that a case's plan has sections for and its draft has nothing of."""
    n = found.groupBy("case_id", "category").agg(F.count("*").alias("n"))
    return planned.join(n, ["case_id", "category"], "left").where((F.col("sections") > 0) & F.col("n").isNull()).select("case_id", "category", "sections")


def prefix_batches(chunks: DataFrame, pattern: str) -> DataFrame:
    """Chunks of a document by the prefix of their path's last part, batches in document order."""
    last = F.element_at(F.split("path", " > "), -1)
    g = chunks.withColumn("prefix", F.regexp_extract(last, pattern, 1)).groupBy("doc_id", "prefix").agg(F.min("first_page").alias("first_page"), F.sum("pages").alias("pages"), F.count("*").alias("chunks"))
    return g.withColumn("batch", F.row_number().over(W.partitionBy("doc_id").orderBy("first_page")))


def split_points(windows: DataFrame, most: int = 15) -> DataFrame:
    """Pages in a cluster part at a change of prefix, and after `most` pages of one; doc_id, cluster, part, first_page, last_page."""
    order = W.partitionBy("doc_id", "cluster").orderBy("page_number")
    d = windows.withColumn("before", F.lag("prefix").over(order)).withColumn("segment", F.sum(F.when(F.col("prefix").eqNullSafe(F.col("before")), 0).otherwise(1)).over(order))
    nth = F.row_number().over(W.partitionBy("doc_id", "cluster", "segment").orderBy("page_number")) - 1
    d = d.withColumn("piece", F.floor(nth / most))
    g = d.groupBy("doc_id", "cluster", "segment", "piece").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))
    return g.withColumn("part", F.row_number().over(W.partitionBy("doc_id", "cluster").orderBy("first_page"))).drop("segment", "piece")


def approximate(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = 1.4) -> DataFrame:
    """Approximate neighbours by an index of cells over unit vectors: query_id, id, distance, rank, of those nearer than threshold."""
    near = nearest.indexed_top_k(vectors, queries, k, 1 - threshold * threshold / 2)
    distance = F.sqrt(F.greatest(2 - 2 * F.round("similarity", 12), F.lit(0.0)))
    return near.select("query_id", "id", distance.alias("distance"), "rank").where(F.col("distance") < threshold)


def concept_label(c: Column) -> Column:
    """A concept id as a label: prefix off, words with capitals."""
    return F.initcap(F.replace(F.regexp_replace(c, "^(toh|mkt|rem|proc)_", ""), F.lit("_"), F.lit(" ")))


def gold_form(c: Column) -> Column:
    """Compatibility forms (ligatures) composed; quotes, dashes, soft hyphens and line-end hyphens in one form, lower case, single blanks."""
    s = F.regexp_replace(T.composed(c), r"(\w)-[ \t]*\n[ \t]*(\w)", "$1$2")
    s = F.translate(F.regexp_replace(s, "­", ""), "‘’“”‐‑–—", "''\"\"----")
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def magnitude(unit: Column, stems: dict[str, float]) -> Column:
    """The multiplier of a magnitude word: the word itself, else the longest stem it begins with, else 1."""
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in stems.items() for x in kv]), F.lower(unit))
    begun = F.lit(None).cast("double")
    for stem in sorted(stems, key=len):  # the longest last, so that it is asked first
        begun = F.when(F.startswith(F.lower(unit), F.lit(stem)), stems[stem]).otherwise(begun)
    return F.coalesce(exact, begun, F.lit(1.0))


def nearest_amount(amounts: DataFrame, expected: DataFrame) -> DataFrame:
    """Per condition the mention nearest to what is expected, and whether it is another value."""
    d = expected.join(amounts, "doc_id", "left").groupBy("doc_id", "condition_id").agg(F.min_by("value", F.struct(F.abs(F.col("value") - F.col("expected")), "value")).alias("nearest"), F.first("expected").alias("expected"))
    return d.withColumn("mismatch", F.col("nearest").isNull() | ~T.within(F.col("nearest"), F.col("expected")))


def archived(url: Column) -> Column:
    """An archived link as the link it archives."""
    return F.regexp_replace(url, r"^https?://[^/]*webarchive[^/]*/[^/]+/(https?://.*)$", "$1")


def list_field(c: Column) -> Column:
    """A list written as JSON; null-like words are an empty list, anything else that is no list is null."""
    return F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "null", "none", "n/a", "[]"), F.array().cast("array<string>")).otherwise(F.from_json(c, "array<string>"))


def mislabelled(candidates: DataFrame) -> DataFrame:
    """Propositions whose first three candidates (two at least) all lie in a wrong section."""
    g = candidates.where("rank <= 3").groupBy("prop_id").agg(F.bool_and("wrong").alias("all_wrong"), F.count("*").alias("n"))
    return g.where("all_wrong and n >= 2").select("prop_id")


def verified(conditions: DataFrame, passages: DataFrame, sources: DataFrame) -> DataFrame:
    """Per condition its tier: 2 with a number confirmed in a grounded passage, 1 with a grounded passage, else 0.

    Sources are one row a link; value 0 and annually adjusted values skip the numeric check.
    """
    s = passages.join(sources, "url", "left")
    grounded = F.coalesce(F.contains(T.normalized(F.col("text")), T.normalized(F.col("quote"))), F.lit(False))
    s = s.withColumn("grounded", grounded).select("passage_id", "grounded", "quote", F.explode("supports").alias("condition_id"))
    d = conditions.join(s, "condition_id", "left")
    numeric = F.exists(T.amounts(F.coalesce("quote", F.lit("")), "EUR"), lambda v: T.within(v, F.col("value")))
    skip = (F.col("value") == 0) | F.col("annual")
    tier = F.when(F.coalesce("grounded", F.lit(False)) & ~skip & numeric, 2).when(F.coalesce("grounded", F.lit(False)), 1).otherwise(0)
    return d.groupBy("condition_id").agg(F.max(tier).alias("tier"), F.count("passage_id").alias("passages"))


#: Which list of a new passage names the proposition, by its kind; the confidence of such a passage.
SUPPORTS = {"product_market": "supports_markets", "geographic_market": "supports_geographic_markets", "theory_of_harm": "supports_theories"}
CONFIDENCE = 0.70


def repaired(passages: DataFrame, grounded: DataFrame) -> DataFrame:
    """Passages on a wrong page get the page where the quote is, and their review starts anew."""
    d = passages.join(grounded, "passage_id", "left")
    wrong = F.coalesce(F.col("status") == "wrong_page", F.lit(False))
    return d.select("passage_id", F.when(wrong, F.col("found_page")).otherwise(F.col("page")).alias("page"), F.when(wrong, "unreviewed").otherwise("reviewed").alias("review"))


def added_passages(passages: DataFrame, accepted: DataFrame) -> DataFrame:
    """case_id, passage_id, doc_id, page, quote, review, confidence and the lists of SUPPORTS: a new passage for each accepted candidate.

    passages: case_id, passage_id (string); accepted: case_id, prop_id, kind, doc_id, page, quote, order (in which they are
    written); those without a quote or document are left out. New ids are sp_n: n goes on from the number of passages of the case and
    past ids that are taken; the i-th new passage has the i-th free number.
    """
    a = accepted.where("quote <> '' and doc_id is not null").withColumn("i", F.row_number().over(W.partitionBy("case_id").orderBy("order", "prop_id")))
    have = passages.groupBy("case_id").agg(F.count("*").alias("have"))
    taken = passages.select("case_id", F.regexp_extract("passage_id", r"^sp_([1-9][0-9]{0,8})$", 1).alias("n")).where("n <> ''").select("case_id", F.col("n").cast("long").alias("n")).distinct()
    wanted = a.groupBy("case_id").agg(F.max("i").alias("many")).join(have, "case_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    # The i-th passage begins at have + i and takes the first number past the one before that is free: taken numbers push the rest on.
    over = taken.join(wanted, "case_id").where("n > have").select("case_id", "have", "n")
    over = over.withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy("n"))).withColumn("slots", F.col("n") - F.col("have") - F.col("rank"))
    before = over.select("case_id", "slots").alias("o")
    a = a.join(wanted.select("case_id", "have"), "case_id").alias("a")
    pushed = a.join(before, (F.col("a.case_id") == F.col("o.case_id")) & (F.col("o.slots") < F.col("a.i")), "left").groupBy("a.case_id", "a.i").agg(F.count("o.slots").alias("pushed"))
    d = a.select("a.*").join(pushed, ["case_id", "i"]).withColumn("n", F.col("have") + F.col("i") + F.col("pushed"))
    lists = [F.when(F.col("kind") == kind, F.array("prop_id")).otherwise(F.array().cast(f"array<{accepted.schema['prop_id'].dataType.simpleString()}>")).alias(name) for kind, name in SUPPORTS.items()]
    return d.select("case_id", F.concat(F.lit("sp_"), F.col("n").cast("string")).alias("passage_id"), "doc_id", F.col("page").cast("string").alias("page"), "quote", F.lit("unreviewed").alias("review"), F.lit(CONFIDENCE).alias("confidence"), *lists)
