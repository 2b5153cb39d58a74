"""Evaluation of drafts against gold, promotion gates, and run state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def scores(judged: DataFrame, key: str) -> DataFrame:
    """Per key: tp, fp, fn, unjudged, precision, recall, f1 to three places.

    judged: gold and draft (booleans), partial, reviewed: with partial gold, a draft without gold is false only in a reviewed group.
    """
    only = ~F.col("gold") & F.col("draft")
    false = only & (~F.col("partial") | F.col("reviewed"))
    g = judged.groupBy(key).agg(
        F.count_if(F.col("gold") & F.col("draft")).alias("tp"),
        F.count_if(false).alias("fp"),
        F.count_if(F.col("gold") & ~F.col("draft")).alias("fn"),
        F.count_if(only & ~false).alias("unjudged"),
    )
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return g.select("*", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f1, 3).alias("f1"))


def overpromoted(candidates: DataFrame, safe: Column, risky: Column, name: str = "name") -> DataFrame:
    """Per case: safe names, those also in a risky pool, and their ratio."""
    k = F.lower(F.trim(name))
    s, r = candidates.where(safe).select("case_id", k.alias("k")).distinct(), candidates.where(risky).select("case_id", k.alias("k")).distinct()
    d = s.join(r.withColumn("hit", F.lit(1)), ["case_id", "k"], "left")
    return d.groupBy("case_id").agg(F.count("*").alias("safe"), F.count("hit").alias("overpromoted"), F.round(F.count("hit") / F.count("*"), 3).alias("ratio"))


def first_failure(gates: list[tuple[str, Column]], done: str = "promoted") -> Column:
    """The name of the first gate that does not hold, in order; all hold: done."""
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in gates], F.lit(done))


def ordered_means(rows: DataFrame, key: str, value: str, order: list[str], marks: list[float], others: list[Column]) -> DataFrame:
    """Key, mean, others (aggregates): the mean of value, to be compared with marks, added in the order of the rows where the order of floats can decide.

    order: columns that give the rows of a key their order. Only rows of keys whose mean lies within the error of a sum of
    floats of a mark are sorted; of the other means any order tells the same.
    """
    x, same = F.col(value), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    means = rows.groupBy(key).agg(F.avg(x).alias("any"), (F.count(x) * F.avg(F.abs(x)) * 2.0**-51).alias("error"), *others)
    close = means.where(reduce(lambda a, b: a | b, [F.abs(F.col("any") - m) <= F.col("error") for m in marks])).select(key)
    w = W.partitionBy(key).orderBy(*order)
    d = rows.where(x.isNotNull()).alias("a").join(close.alias("b"), same, "left_semi")
    d = d.select(key, F.row_number().over(w).alias("n"), F.sum(x).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("sum"))
    exact = d.groupBy(key).agg((F.max_by("sum", "n") / F.max("n")).alias("exact"))
    return means.alias("a").join(exact.alias("b"), same, "left").select("a.*", F.coalesce("exact", "any").alias("mean")).drop("any", "error")


def counts_of(rows: DataFrame, column: str, every: list[str]) -> DataFrame:
    """The count of each listed value, 0 included."""
    known = rows.sparkSession.createDataFrame([(x,) for x in every], f"{column} string")
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    return known.join(n, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def triage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Dimension, value, n: a histogram over each column at once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return rows.select(pairs).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def plan_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts over the cube of the columns; 'all' stands for any value."""
    c = rows.cube(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    n = len(columns)
    marked = [F.when(F.col("g").bitwiseAND(F.lit(1 << (n - 1 - i))) != 0, "all").otherwise(F.col(x).cast("string")).alias(x) for i, x in enumerate(columns)]
    return c.select(*marked, "n")


def benchmark(rows: DataFrame, passes: Column) -> DataFrame:
    """Totals of a benchmark: cases, passed, pass rate."""
    return rows.agg(F.count("*").alias("cases"), F.count_if(passes).alias("passed"), F.round(F.try_divide(F.count_if(passes), F.count("*")), 3).alias("rate"))


def latest(state: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest state of each item."""
    return state.groupBy(key).agg(F.max_by(F.struct(*state.columns), F.struct(at, tie)).alias("s")).select("s.*")


def pending(items: DataFrame, state: DataFrame, key: str, finished: Column) -> DataFrame:
    """Items that no finished state names."""
    return items.join(state.where(finished).select(key).distinct(), key, "left_anti")


def candidates(drafts: DataFrame) -> DataFrame:
    """One draft per case: full-depth before market-definition, end-to-end before generic (priority), then seq."""
    return drafts.withColumn("n", F.row_number().over(W.partitionBy("case_id").orderBy("priority", "seq"))).where("n = 1").drop("n")


def queue(entries: DataFrame) -> DataFrame:
    """Entries with the first reason to skip them, or eligible."""
    why = (
        F.when(F.col("status") == "not_applicable", "not_applicable")
        .when(F.col("outcome").isin("phase_2", "P"), "phase_2_outcome")
        .when(F.col("pdf_url").isNull() | (F.col("pdf_url") == ""), "no_pdf")
        .when(F.coalesce("canonical", F.lit(False)), "already_canonical")
        .otherwise("eligible")
    )
    return entries.withColumn("reason", why)


def status_of(entries: DataFrame, cap: int) -> DataFrame:
    """Extracted if canonical, unknown without pages, not_applicable up to cap pages, else pending; a settled old status stays unless the entry is newly canonical."""
    new = F.when(F.coalesce("canonical", F.lit(False)), "extracted").when(F.col("pages").isNull(), "unknown").when(F.col("pages") <= cap, "not_applicable").otherwise("pending")
    d = entries.withColumn("new", new)
    settled = F.col("old").isNotNull() & (F.col("old") != "unknown") & (F.col("new") != "extracted")
    return d.withColumn("status", F.when(settled | (F.col("new") == "unknown") & F.col("old").isNotNull(), F.col("old")).otherwise(F.col("new")))


#: What follows from a market's importance alone.
BY_IMPORTANCE = {"background": "exclude_from_canonical", "ancillary": "keep_as_context_only", "precedent_only": "keep_as_context_only", "incomplete_source": "hold_pending_source_check", "assessed_no_overlap": "keep_as_context_only"}
SEGMENTED, CONCLUSIVE = ["segmented", "possible_segmentation"], ["defined", "left_open", "considered"]


def promotion_action(importance: Column, status: Column, has_refs: Column) -> Column:
    """What to do with a draft market: importance decides first, then a lone unknown status, segmentation, and conclusions with sources."""
    imp, st = F.trim(F.coalesce(importance, F.lit(""))), F.trim(F.coalesce(status, F.lit("")))
    out = F.when(F.lit(False), F.lit(None))
    for name, action in BY_IMPORTANCE.items():
        out = out.when(imp == name, action)
    return (
        out.when(st.isin("unknown", "") & ~has_refs, "hold_pending_source_check")
        .when(st.isin(SEGMENTED), "promote_with_uncertainty")
        .when((imp == "core_assessed") & st.isin(CONCLUSIVE) & has_refs, "promote_to_canonical")
        .otherwise("manual_review")
    )


#: Roles of passages that can carry a promotion; what caveats on a missing conclusion say; statuses that such a caveat holds back.
CONCLUSIVE_ROLES = ["commission_assessment", "conclusion"]
NO_CONCLUSION = ["conclusion", "absent", "missing", "incomplete", "cut off", "not in supplied"]
HELD_BACK = ["left_open", "considered", "not_conclusive"]


def promotion_plan(markets: DataFrame, passages: DataFrame, caveats: DataFrame) -> DataFrame:
    """case_id, market_id, kind, action, guard (role, caveat, pairing or null): what to do with each draft market, after the guards.

    markets: case_id, market_id, kind, importance, status, name; passages: case_id, page, role, supports (array of market_id); caveats:
    case_id, caveat. A market has sources if a passage with a page supports it. Of one to be promoted: role holds it if it has
    passages, none of them conclusive; then caveat, if its case lacks a conclusion and its status is one of HELD_BACK (with
    uncertainty too); then pairing sends a place to review that shares no word of its name with a product of its case.
    """
    p = passages.select("case_id", F.explode("supports").alias("market_id"), (F.trim(F.coalesce("page", F.lit(""))) != "").alias("paged"), F.col("role").isin(CONCLUSIVE_ROLES).alias("firm"))
    p = p.groupBy("case_id", "market_id").agg(F.bool_or("paged").alias("refs"), F.bool_or(F.coalesce("firm", F.lit(False))).alias("firm"))
    said = F.exists(F.lit(NO_CONCLUSION), lambda x: F.contains(F.lower("caveat"), x))
    c = caveats.groupBy("case_id").agg(F.coalesce(F.bool_or(said), F.lit(False)).alias("lacks"))
    words = lambda d: d.select("case_id", "market_id", F.explode(F.filter(F.split(F.lower(F.coalesce("name", F.lit(""))), r"\s+"), lambda w: w != "")).alias("word"))
    product = words(markets.where("kind = 'product'")).select("case_id", "word").distinct()
    paired = words(markets.where("kind = 'geographic'")).join(product, ["case_id", "word"], "left_semi").select("case_id", "market_id").distinct().withColumn("paired", F.lit(True))
    d = markets.join(p, ["case_id", "market_id"], "left").join(c, "case_id", "left").join(paired, ["case_id", "market_id"], "left")
    base = promotion_action(F.col("importance"), F.col("status"), F.coalesce("refs", F.lit(False)))
    d = d.withColumn("base", base)
    sure, promoted = F.col("base") == "promote_to_canonical", F.col("base").isin("promote_to_canonical", "promote_with_uncertainty")
    guard = (
        F.when(sure & F.col("firm").isNotNull() & ~F.col("firm"), "role")
        .when(promoted & F.coalesce("lacks", F.lit(False)) & F.col("status").isin(HELD_BACK), "caveat")
        .when(promoted & (F.col("kind") == "geographic") & F.col("paired").isNull(), "pairing")
    )
    d = d.withColumn("guard", guard)
    action = F.when(F.col("guard").isin("role", "caveat"), "hold_pending_source_check").when(F.col("guard") == "pairing", "manual_review_geo_pairing").otherwise(F.col("base"))
    return d.select("case_id", "market_id", "kind", action.alias("action"), "guard")


def review_score(entries: DataFrame, passages: DataFrame, weights: dict[str, dict[str, float]], refs_scale: float = 5.0) -> DataFrame:
    """Item, score: having passages (3), their number up to three (2), the strongest role (2), importance (1.5), status (1), category (0.5), cited pages (0.25).

    weights: role, importance, status, category -> value -> share of the full mark; `default` for any other value.
    """
    mark = lambda kind, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in weights[kind].items() for x in (k, float(v))]), F.coalesce(c, F.lit(""))), F.lit(float(weights[kind].get("default", 0.0))))
    p = passages.groupBy("item").agg(F.count("*").alias("n"), F.max(mark("role", F.col("role"))).alias("role"))
    d = entries.join(p, "item", "left")
    n = F.coalesce("n", F.lit(0))
    score = (
        F.when(n > 0, 3.0).otherwise(0.0)
        + 2.0 * F.least(n / 3.0, F.lit(1.0))
        + 2.0 * F.coalesce("role", F.lit(0.0))
        + 1.5 * mark("importance", F.col("importance"))
        + mark("status", F.col("status"))
        + 0.5 * mark("category", F.col("category"))
        + 0.25 * F.least(F.col("source_refs") / refs_scale, F.lit(1.0))
    )
    return d.select("item", score.alias("score"))
