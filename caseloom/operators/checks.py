"""Validation of records: references, support, duplicates, readiness; each check is a table of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dangling_documents(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Passages whose document is not in the record."""
    return passages.join(documents, ["case_id", "doc_id"], "left_anti").select("case_id", "passage_id", "doc_id")


def dangling_support(passages: DataFrame, items: dict[str, DataFrame]) -> DataFrame:
    """case_id, kind, ref, passage_id of supports that name no item; items: kind -> (case_id, ref), passages have a column supports_<kind>."""
    parts = []
    for kind, known in items.items():
        refs = passages.select("case_id", "passage_id", F.explode(f"supports_{kind}").alias("ref"))
        parts.append(refs.join(known.select("case_id", "ref"), ["case_id", "ref"], "left_anti").select("case_id", F.lit(kind).alias("kind"), "ref", "passage_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def complaint_only(markets: DataFrame, passages: DataFrame, documents: DataFrame, defined: str = "defined", complaint: str = "complaint") -> DataFrame:
    """Defined markets whose supporting documents are all complaints (at least one)."""
    links = passages.select("case_id", F.explode("supports_markets").alias("market_id"), "doc_id").join(documents, ["case_id", "doc_id"])
    by = links.groupBy("case_id", "market_id").agg(F.bool_and(F.col("doc_type") == complaint).alias("only"), F.array_join(F.sort_array(F.collect_set(F.col("doc_id").cast("string"))), ",").alias("docs"))
    return markets.where(F.col("status") == defined).join(by.where("only"), ["case_id", "market_id"]).select("case_id", "market_id", "docs")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_quotes(passages: DataFrame) -> DataFrame:
    """Quotes that several passages of a case share, with the passages."""
    q = passages.withColumn("quote", F.trim("quote")).where("quote <> ''")
    by = q.groupBy("case_id", "quote").agg(F.sort_array(F.collect_list("passage_id")).alias("ids"))
    return by.where(F.size("ids") > 1).select("case_id", "quote", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("passages"))


def conclusion_only(passages: DataFrame) -> DataFrame:
    """Theories supported by conclusions alone (passages without a role do not count)."""
    t = passages.select("case_id", F.explode("supports_theories").alias("theory_id"), "role")
    by = t.groupBy("case_id", "theory_id").agg(F.collect_set("role").alias("roles"))
    rest = F.array_except("roles", F.array(F.lit("conclusion"), F.lit("")))
    return by.where((F.size(rest) == 0) & F.array_contains("roles", "conclusion")).select("case_id", "theory_id")


def orphans(passages: DataFrame, allowed: list[str]) -> DataFrame:
    """Passages that support nothing, unless their role may."""
    return passages.where((F.size("supports_markets") + F.size("supports_theories") == 0) & ~F.col("role").isin(allowed)).select("case_id", "passage_id", "role")


def unset_roles(passages: DataFrame, unset: list[str]) -> DataFrame:
    """Per case, the passages whose source role is not set."""
    bad = passages.where(F.lower(F.trim(F.coalesce("role", F.lit("")))).isin(unset))
    return bad.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("passage_id")), lambda x: x.cast("string")), ",").alias("passages"))


def readiness(checks: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """case_id and the number of findings of each level; checks: name -> (level, findings)."""
    parts = [d.select("case_id", F.lit(level).alias("level")) for level, d in checks.values()]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("case_id").agg(*[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("ERROR", "WARNING", "INFO")])


def verdict(items: DataFrame) -> DataFrame:
    """The worst of each entry's items: FAIL, then WARN, then PASS."""
    order = ["PASS", "WARN", "FAIL"]
    level = F.array_position(F.lit(order), F.col("status"))
    return items.groupBy("case_id").agg(F.get(F.lit(order), (F.max(level) - 1).cast("int")).alias("verdict"), F.count("*").alias("items"))


def citations(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Passages per document, 0 included, and the case's total."""
    n = passages.groupBy("case_id", "doc_id").agg(F.count("*").alias("passages"))
    total = passages.groupBy("case_id").agg(F.count("*").alias("total"))
    d = documents.join(n, ["case_id", "doc_id"], "left").join(total, "case_id", "left")
    return d.select("case_id", "doc_id", F.coalesce("passages", F.lit(0)).cast("long").alias("passages"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def unsupported(items: DataFrame, key: str, passages: DataFrame, supports: str, valid: Column) -> DataFrame:
    """Items without a valid passage, with the passages that failed."""
    links = passages.select("case_id", F.explode(supports).alias(key), "passage_id", valid.alias("valid"))
    by = links.groupBy("case_id", key).agg(F.bool_or("valid").alias("ok"), F.array_join(F.transform(F.sort_array(F.collect_set(F.when(~F.col("valid"), F.col("passage_id")))), lambda x: x.cast("string")), ",").alias("failed"))
    d = items.join(by, ["case_id", key], "left").where(~F.coalesce("ok", F.lit(False)))
    return d.select("case_id", key, F.coalesce("failed", F.lit("")).alias("failed"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Key, rule for each rule (name -> what must hold; null fails) that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def failed_links(results: DataFrame) -> DataFrame:
    """Link results where a broken case page counts as a warning if the same document's PDF passed."""
    pdf_ok = F.max(F.when((F.col("kind") == "pdf") & (F.col("status") == "ok"), 1).otherwise(0))
    ok = results.groupBy("doc").agg(pdf_ok.alias("pdf_ok"))
    d = results.join(ok, "doc")
    level = F.when(F.col("status") == "ok", "PASS").when((F.col("kind") == "case_page") & (F.col("pdf_ok") == 1), "WARN").otherwise("FAIL")
    return d.withColumn("level", level).drop("pdf_ok")


def gate_folded(sidecars: DataFrame, gate: str, failed: Column, promoted: int) -> DataFrame:
    """A gate's entry in failures replaced by that of its last run; the tier is `promoted` at least if it passed, 1 at most if not."""
    rest = F.filter("failures", lambda x: x != gate)
    out = sidecars.withColumn("failures", F.when(failed, F.concat(rest, F.array(F.lit(gate)))).otherwise(rest))
    return out.withColumn("tier", F.when(failed, F.least("tier", F.lit(1))).otherwise(F.greatest("tier", F.lit(promoted))))


def structure(rows: DataFrame, key: str, errors: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    """Key, issue (level and name) of each rule that a draft breaks; errors block it, warnings do not."""
    return violations(rows, key, {f"ERROR: {k}": c for k, c in errors.items()} | {f"WARNING: {k}": c for k, c in warnings.items()}).withColumnRenamed("rule", "issue")


def sidecar_tiers(passages: DataFrame, key: str) -> DataFrame:
    """Per rule its tier (2 with a number confirmed in a grounded passage, 1 with a grounded one, else 0) and how many passages failed."""
    tier = F.max(F.when(F.col("grounded") & F.col("numbers"), 2).when(F.col("grounded"), 1).otherwise(0))
    return passages.groupBy(key).agg(tier.alias("tier"), F.count_if(~F.col("grounded")).alias("failures"))


#: Statuses of sites that turn scripts away, what errors of certificates say, seconds of a slow answer.
GUARDED, CERTIFICATE, SLOW = [400, 403], ["CERTIFICATE_VERIFY_FAILED", "SSL:", "[SSL"], 8


def link_flags(status: Column, error: Column, redirects: Column, seconds: Column) -> dict[str, Column]:
    """What a link check says: bot_protected and ssl_uncertain links are not broken; a slow one answered, after SLOW seconds; ok is none of the others but slow."""
    guarded = F.coalesce(status.isin(GUARDED), F.lit(False))
    unsure = F.coalesce(F.exists(F.lit(CERTIFICATE), lambda x: F.contains(error, x)), F.lit(False))
    broken = ~guarded & ~unsure & (F.coalesce(error != "", F.lit(False)) | F.coalesce(status >= 400, F.lit(False)))
    moved = (F.coalesce(redirects, F.lit(0)) > 0) & ~broken & ~guarded
    slow = F.coalesce(seconds > SLOW, F.lit(False)) & ~broken
    return {"broken": broken, "redirected": moved, "bot_protected": guarded, "ssl_uncertain": unsure, "slow": slow, "ok": ~broken & ~moved & ~guarded & ~unsure}


def link_classes(checks: DataFrame, *keys: str) -> DataFrame:
    """Counts of each class by keys; checks: keys, status, error, redirects, seconds. A slow link counts in its class too."""
    flags = link_flags(F.col("status"), F.col("error"), F.col("redirects"), F.col("seconds"))
    return checks.groupBy(*keys).agg(F.count("*").alias("links"), *[F.count_if(f).alias(name) for name, f in flags.items()])


def review_status(text: Column) -> Column:
    """The status of a review text: that of the first line that begins with it in bold; UNKNOWN without one, NO_REVIEW without a text."""
    line = F.regexp_extract(text, r"(?m)^[ \t]*\*\*Status:(.*)$", 1)
    found = F.regexp_like(text, F.lit(r"(?m)^[ \t]*\*\*Status:"))
    return F.when(text.isNull(), "NO_REVIEW").when(found, F.upper(F.trim(F.replace(line, F.lit("**"), F.lit(""))))).otherwise("UNKNOWN")


def packet_readiness(text: Column) -> Column:
    """The first word of the readiness line of a review packet; UNKNOWN without one, NO_REVIEW without a text."""
    word = F.regexp_extract(text, r"(?im)^[ \t]*## readiness:[ \t]*(\S*)", 1)
    return F.when(text.isNull(), "NO_REVIEW").otherwise(F.coalesce(F.upper(F.nullif(word, F.lit(""))), F.lit("UNKNOWN")))


def market_count(text: Column) -> Column:
    """Entries of the list of product markets in a record's raw text: those under its key, up to the next line that is not indented."""
    step = lambda inside, n: F.struct(inside.alias("inside"), n.alias("n"))
    of = lambda s, line: (
        F.when(F.startswith(F.trim(line), F.lit("product_markets_considered:")), step(F.lit(True), s["n"]))
        .when(s["inside"] & F.startswith(F.trim(line), F.lit("- market_id:")), step(s["inside"], s["n"] + 1))
        .when(s["inside"] & F.regexp_like(line, F.lit(r"^\S")), step(F.lit(False), s["n"]))
        .otherwise(s)
    )
    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), step(F.lit(False), F.lit(0)), of, lambda s: s["n"])


#: Statuses of definitions; how drafts' others are read when drafts merge, and when one is promoted.
DEFINITIONS = ["defined", "discussed", "segmented", "left_open", "considered"]
ON_MERGE = {"not_conclusive": "left_open", "precedent_only": "discussed", "possible_segmentation": "discussed"}
ON_PROMOTION = {
    "precedent_only": "considered", "not_conclusive": "left_open", "assessed_no_overlap": "considered", "unknown": "considered", "possible_segmentation": "discussed",
    "not_appropriate": "considered", "incomplete_source": "considered", "background": "considered",
}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def merged_definition(status: Column) -> tuple[Column, Column]:
    """A definition status as it stands after a merge, and the level of its warning: none for a valid one, INFO for one read as another, WARN for any other, which stays."""
    new = _mapped(status, ON_MERGE)
    level = F.when(status.isin(DEFINITIONS), F.lit(None).cast("string")).when(new.isNotNull(), "INFO").otherwise("WARN")
    return F.coalesce(new, status), level


def promoted_definition(status: Column) -> Column:
    """A definition status as a promoted record has it."""
    return F.coalesce(_mapped(status, ON_PROMOTION), status)
