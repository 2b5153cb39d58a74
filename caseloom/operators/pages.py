"""More on pages and passages: keyword and signal scores, candidate pages, document labels, unit headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from caseloom.functions import text as T


def contains_any(c: Column, phrases: list[str]) -> Column:
    """P20, P25: whether any phrase is in the text, whatever its case."""
    return F.coalesce(F.exists(F.lit([p.lower() for p in phrases]), lambda p: F.contains(F.lower(c), p)), F.lit(False))


def signal_scores(rows: DataFrame, key: str, text: str, weights: DataFrame) -> DataFrame:
    """Key, kind, score: the sum of the weights of the phrases in the text, per kind; weights (kind, phrase, weight) is a short list."""
    hit = rows.join(F.broadcast(weights), F.contains(F.lower(text), F.col("phrase")))
    return hit.groupBy(key, "kind").agg(F.sum("weight").alias("score"))


#: What sections' words add and take, by how many words they share with the proposition and how deep the section is.
TOPIC = {"two": 6, "one": 3, "deep": 5, "shallow": 2, "wrong": 4}


def topic_words(c: Column, stop: list[str], most: int = 12) -> Column:
    """The first distinct words of three letters or more of a name or heading, without its number and stop words."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^\d+(?:\.\d+)*\s*", ""), r"[/\-\u2013\u2014|]+", " ")
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(bare), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(stop))), 1, most)


def _signals(text: Column, kind: Column, signals: list[tuple[str, str, int]]) -> Column:
    """The sum of the weights of a kind's phrases that the lower-case text has."""
    table = F.lit([f"{k}\t{p}\t{w}" for k, p, w in signals]) if signals else F.array().cast("array<string>")
    parts = lambda x: F.split(x, "\t")
    own = F.filter(table, lambda x: (parts(x)[0] == kind) & F.contains(text, parts(x)[1]))
    return F.aggregate(own, F.lit(0), lambda s, x: s + parts(x)[2].cast("int"))


def candidate_pages(propositions: DataFrame, pages: DataFrame, bonus: list[tuple[str, str, int]] = (), penalty: list[tuple[str, str, int]] = (), stop: list[str] = (), k: int = 5) -> DataFrame:
    """prop_id, page_number, hits, bonus, penalty, topic_bonus, topic_penalty, score, rank: the k best pages of a proposition's document, earlier ones first among equals.

    propositions: prop_id, doc_id, keywords array, and where they have them kinds array (its type and subtype), name; pages: doc_id, page_number, text, and path, the
    section it lies in (`heading_paths`). A page counts by its keywords (in any case, inside words too), the
    phrases of the proposition's kinds (bonus and penalty: kind, phrase, weight; twice each), and the words that its section
    shares with the name: 6 for two, 3 for one (twice each); none costs 5 in a section below another and 2 in one at the top (three times each).
    A section that costs 4 or more makes the rest moot: keywords less twice the cost. Pages of contents and pages without a keyword are left out.
    """
    p = propositions
    for c, kind in (("kinds", "array<string>"), ("name", "string")):
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast(kind))
    p = p.select("prop_id", "doc_id", F.transform("keywords", lambda w: F.lower(w)).alias("keywords"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), topic_words(F.coalesce("name", F.lit("")), list(stop)).alias("topic"))
    t = pages if "path" in pages.columns else pages.withColumn("path", F.lit(""))
    t = t.where((F.length("text") > 0) & ~T.is_contents(F.col("text"))).select("doc_id", "page_number", F.lower("text").alias("text"), topic_words(F.coalesce("path", F.lit("")), list(stop)).alias("section"), F.contains(F.coalesce("path", F.lit("")), F.lit(" > ")).alias("deep"))
    d = p.join(t, "doc_id").withColumn("hits", F.size(F.filter("keywords", lambda w: F.contains(F.col("text"), w)))).where("hits > 0")
    add = lambda table: F.aggregate("kinds", F.lit(0), lambda s, kind: s + _signals(F.col("text"), kind, list(table)))
    shared = F.size(F.array_intersect("topic", "section"))
    no_topic = (F.size("topic") == 0) | (F.size("section") == 0)
    good = F.when(no_topic, 0).when(shared >= 2, TOPIC["two"]).when(shared == 1, TOPIC["one"]).otherwise(0)
    bad = F.when(no_topic | (shared > 0), 0).when(F.col("deep"), TOPIC["deep"]).otherwise(TOPIC["shallow"])
    d = d.withColumns({"bonus": add(bonus), "penalty": add(penalty), "topic_bonus": good, "topic_penalty": bad})
    score = F.when(F.col("topic_penalty") >= TOPIC["wrong"], F.col("hits") - 2 * F.col("topic_penalty")).otherwise(F.expr("hits + 2 * bonus - 2 * penalty + 2 * topic_bonus - 3 * topic_penalty"))
    d = d.withColumn("score", score)
    rank = F.row_number().over(W.partitionBy("prop_id").orderBy(F.col("score").desc(), "page_number"))
    return d.withColumn("rank", rank).where(F.col("rank") <= k).select("prop_id", "page_number", "hits", "bonus", "penalty", "topic_bonus", "topic_penalty", "score", "rank")


def ordered_passages(passages: DataFrame, roles: list[str], cap: int = 3) -> DataFrame:
    """Per market the first `cap` passages: direct matches first, then by role in the given order, then as they came."""
    role = F.array_position(F.lit(roles), F.col("role"))
    order = W.partitionBy("case_id", "market_id").orderBy(F.col("direct").desc(), F.when(role == 0, len(roles) + 1).otherwise(role), "seq")
    return passages.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def keywords(c: Column, stop: list[str], most: int = 25) -> Column:
    """The first distinct words of four letters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0))
    return F.slice(F.array_distinct(F.array_except(words, F.lit(stop))), 1, most)


def min_recall(a: Column, b: Column, stop: list[str]) -> Column:
    """Shared name tokens over those of the shorter name."""
    x, y = (F.array_except(F.array_distinct(T.tokens(c)), F.lit(stop)) for c in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))), F.lit(0.0))


#: Outcomes whose decisions are not published in the register; its languages, in order.
MANUAL_OUTCOMES = ["cleared_with_conditions", "blocked", "annulled", "partially_annulled", "under_appeal"]
LANGUAGES = "ENG FRA DEU ITA NLD SPA POL POR SWE DAN FIN CES ELL HUN RON BUL HRV SLK SLV EST LAV LIT GLE MLT".split()


def register_id(source_url: Column, year: Column) -> Column:
    """The id of a decision in the register, by the case number at the end of its link and the year; null without either."""
    number = F.nullif(F.regexp_extract(source_url, r"M\.([0-9]+)$", 1), F.lit(""))
    return F.when(year.cast("string").rlike("^[0-9]+$"), F.concat(F.lit("3"), year.cast("string"), F.lit("M"), number))


def resolved_edition(cases: DataFrame, editions: DataFrame, languages: list[str] = LANGUAGES) -> DataFrame:
    """case_id, how (resolved, manual, missing), register_id, lang, reason: the first language edition in order that the register has as a PDF.

    cases: case_id, outcome, source_url, year; editions: register_id, lang, status (of the link), kind (content type). Phase-2 and
    appeal outcomes are looked up by hand; the reason of a missing one names the first status other than 404, else 404.
    """
    c = cases.withColumn("register_id", register_id(F.col("source_url"), F.col("year")))
    at = F.array_position(F.lit(languages), F.upper("lang"))
    e = editions.withColumn("place", at).where("place > 0")
    good = (F.col("status") == 200) & F.contains("kind", F.lit("pdf"))
    g = e.groupBy("register_id").agg(F.min_by("lang", F.when(good, F.col("place"))).alias("lang"), F.min_by("status", F.struct((F.col("status") == 404).alias("absent"), "place")).alias("last"))
    d = c.join(g, "register_id", "left")
    manual = F.coalesce(F.col("outcome").isin(MANUAL_OUTCOMES), F.lit(False))
    how = F.when(manual, "manual").when(F.col("lang").isNotNull(), "resolved").otherwise("missing")
    reason = (
        F.when(manual, "phase_ii_not_in_cellar")
        .when(F.regexp_extract("source_url", r"M\.([0-9]+)$", 1) == "", "no_case_number_in_source_url")
        .when(F.col("register_id").isNull(), F.when(F.col("source_url").isNull(), "no_case_number_in_source_url").otherwise("no_decision_year"))
        .when(how == "resolved", F.concat(F.lit("cellar_celex_"), "register_id", F.lit("_"), F.lower("lang")))
        .otherwise(F.concat(F.lit("cellar_no_pdf_status_"), F.coalesce(F.col("last").cast("string"), F.lit("None"))))
    )
    return d.select("case_id", how.alias("how"), F.when(~manual, F.col("register_id")).alias("register_id"), F.when(how == "resolved", F.lower("lang")).alias("lang"), reason.alias("reason"))


def edition(editions: DataFrame, languages: list[str]) -> DataFrame:
    """Per document the first available language edition in order of priority, else the first that is not missing, else manual."""
    at = F.array_position(F.lit(languages), F.col("lang"))
    e = editions.withColumn("priority", F.when(at == 0, len(languages) + 1).otherwise(at))
    g = e.groupBy("doc_id").agg(
        F.min_by("lang", F.when(F.col("status") == 200, F.struct("priority", "lang"))).alias("found"),
        F.min_by("lang", F.when(F.col("status") != 404, F.struct("priority", "lang"))).alias("other"),
    )
    return g.select("doc_id", F.coalesce("found", "other", F.lit("manual")).alias("lang"))


def unit_label(c: Column, structural: list[str]) -> Column:
    """A heading of one to four words, none of them structural, is a unit's label."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^a-z\s]", "")), r"\s+")
    return (F.size(words) <= 4) & (F.element_at(words, 1) != "") & ~F.arrays_overlap(words, F.lit(structural))


def back_references(passages: DataFrame, items: DataFrame, supports: str, key: str) -> DataFrame:
    """Items with refs: those they have, then the passages that name them, without repeats."""
    named = passages.select("case_id", F.explode(supports).alias(key), "passage_id").groupBy("case_id", key).agg(F.sort_array(F.collect_set("passage_id")).alias("named"))
    none = F.array().cast("array<int>")
    return items.join(named, ["case_id", key], "left").select("case_id", key, F.array_union("refs", F.coalesce("named", none)).alias("refs"))


def numbered_drafts(found: DataFrame, prefix: str) -> DataFrame:
    """Found items of a draft with ids in a row, items not found left out."""
    n = F.row_number().over(W.partitionBy("case_id").orderBy("seq"))
    return found.where(~F.col("not_found")).withColumn("id", F.concat(F.lit(f"{prefix}_"), n)).drop("not_found")


def provenance(sources: DataFrame, markers: str, head: int = 1200) -> DataFrame:
    """Sources whose first signs lack a source marker or a link, and which of the two."""
    start = F.substring("text", 1, head)
    issue = F.when(~start.rlike(markers), "no_marker").when(~start.rlike("https?://"), "no_url")
    return sources.select("url", issue.alias("issue")).where("issue is not null")
