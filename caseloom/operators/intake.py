"""Taking records in and out: delimited files, dated links, seed records, draft clean-up, warnings, link inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from caseloom.functions import text as T
from caseloom.operators.grounding import grounded
from caseloom.operators import checks as K
from caseloom.operators import matching, similar
from caseloom.sources.scratch import kept


#: Fixed value: what follows a text that is cut.
TRUNCATED = "\n\n[... document truncated ...]"


def delimited(spark: SparkSession, path: str, most: int = 30_000) -> DataFrame:
    """Path and text of each delimited file, as it stands; over `most` signs it is cut and says so. Files of blanks alone are left out."""
    return clipped(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")).where("trim(text) <> ''"), most)


def clipped(texts: DataFrame, most: int) -> DataFrame:
    return texts.withColumn("text", F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit(TRUNCATED))).otherwise(F.col("text")))


def sink(rows: DataFrame, totals: DataFrame, path: str) -> None:
    """A run's rows and totals as two tables under a path."""
    rows.write.parquet(f"{path}/rows")
    totals.write.parquet(f"{path}/totals")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles landed as JSON, one a line, with defaults filled."""
    schema = "profile_id string, jurisdictions array<string>, coverage_keywords map<string,array<string>>, source_role_mapping map<string,string>, orphan_policy struct<default:string,allow_roles:array<string>>"
    d = spark.read.schema(schema).json(path)
    policy = F.coalesce("orphan_policy", F.struct(F.lit("warn").alias("default"), F.array().cast("array<string>").alias("allow_roles")))
    return d.withColumn("orphan_policy", policy).withColumn("jurisdictions", F.coalesce("jurisdictions", F.array().cast("array<string>")))


def dated_links(pages: DataFrame, date: str = r"(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """page_id, label, url, day of the links of a page with a date in the text after them; both needed, repeats once."""
    parts = pages.select("page_id", F.explode(F.expr("filter(split(html, '(?i)<a '), (x, i) -> i > 0)")).alias("part"))
    url, label = F.regexp_extract("part", 'href="([^"]*)"', 1), F.trim(F.regexp_extract("part", r">([^<]*)</a>", 1))
    tail = F.regexp_extract("part", r"(?s)</a>(.*)$", 1)
    d = parts.select("page_id", label.alias("label"), url.alias("url"), F.regexp_extract(tail, date, 1).alias("day"))
    return d.where("label <> '' and day <> ''").distinct()


def dominant_outcome(counts: DataFrame, key: str) -> DataFrame:
    """Per key the outcome of the highest count, ties to the first; none: pending."""
    return counts.groupBy(key).agg(F.coalesce(F.max_by("outcome", F.when(F.col("outcome").isNotNull(), F.struct("n", -F.col("seq")))), F.lit("pending")).alias("dominant"))


def minority_blocks(rules: DataFrame) -> DataFrame:
    """Rule, issue: a minority block that applies but has no rules, and rules of it without a source."""
    empty = rules.where("applies and size(minority_rules) = 0").select("rule", F.lit("no_rules").alias("issue"))
    bare = rules.select("rule", F.posexplode("minority_rules").alias("i", "r")).where("r.source is null or r.source = ''")
    return empty.union(bare.select("rule", F.concat(F.lit("no_source_"), "i")))


def gold_passages(gold: DataFrame, drafts: DataFrame) -> DataFrame:
    """gold_id, passage, tier: passages that name the gold's id, else an alias id, else lie on its cited page and share a token of its name.

    A tier is sought only for the gold items that the tiers before it have nothing for. Items and passages of an id meet in blocks; a pair that several ids join
    counts at the smallest, so that pairs are made once and need no shuffle.
    """
    ids = lambda c: F.array_distinct(F.array_compact(F.flatten(F.collect_list(c))))
    d = drafts.groupBy("passage").agg(ids("supports").alias("theirs"))
    refs = d.select("passage", "theirs", F.explode("theirs").alias("ref"))
    known, found, left = refs.select("ref").distinct(), [], gold
    for tier, own in ((1, F.array("market_id")), (2, F.col("alias_ids"))):
        g = left.groupBy("gold_id").agg(ids(own).alias("own"))
        g = kept(g.select("gold_id", "own", F.explode("own").alias("ref")).join(known, "ref", "left_semi"), "gold")
        x, y = similar.dealt(g, refs, ["ref"])
        once = (F.size("own") == 1) | (F.size("theirs") == 1) | (F.col("ref") == F.array_min(F.array_intersect("own", "theirs")))
        found.append(x.join(y, ["ref", "b0", "b1"]).where(once).select("gold_id", "passage", F.lit(tier).alias("tier")))
        left = left.join(g.select("gold_id").distinct(), "gold_id", "left_anti")
    words = lambda c, to: F.array_sort(F.array_distinct(T.tokens(F.col(c)))).alias(to)
    x, y = left.select("gold_id", "page", words("name", "tokens")).distinct(), drafts.select("passage", "page", words("quote", "others")).distinct()
    met = matching.sharing_tokens(x.select("page", "tokens").distinct(), y.select("page", "others").distinct(), "page")
    page = x.join(met, ["page", "tokens"]).join(y, ["page", "others"]).select("gold_id", "passage", F.lit(3).alias("tier")).distinct()
    return found[0].union(found[1]).union(page)


def seed_records(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds with type, outcome and date; and the others with the first thing they lack."""
    why = F.when(F.col("type").isNull(), "type").when(F.col("outcome").isNull(), "outcome").when(F.col("day").isNull(), "date")
    d = seeds.withColumn("lacks", why)
    return d.where("lacks is null").drop("lacks"), d.where("lacks is not null")


#: Units of a currency for a US dollar, used where a deal brings no rate.
RATES = {
    "USD": 1.0,
    "EUR": 0.92, "GBP": 0.79, "CNY": 7.24, "CAD": 1.37, "BRL": 5.10,
    "JPY": 150.0, "KRW": 1370.0, "INR": 84.0, "AUD": 1.53, "ZAR": 18.5,
    "TRY": 32.0, "MXN": 17.0, "PLN": 4.0, "ILS": 3.7, "AED": 3.67,
    "SAR": 3.75, "NTD": 32.0, "ARS": 1050.0, "NGN": 1600.0, "NZD": 1.63,
    "RUB": 90.0, "COP": 4200.0, "KES": 130.0, "EGP": 50.0, "SGD": 1.35,
    "HUF": 370.0, "CZK": 23.0, "DKK": 6.9, "SEK": 10.5, "NOK": 10.8,
    "CHF": 0.9, "RON": 4.6,
}


def in_base_units(millions: Column, currency: Column, rates: dict[str, float] = RATES) -> Column:
    """An amount given in millions of a currency, in US dollars; null for an unknown currency."""
    return millions * 1e6 / F.try_element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), currency)


def url_signs(url: Column, title: Column) -> Column:
    """What a link looks like: portal, opaque id, document type named in it, word of the title in it."""
    u = F.lower(url)
    words = F.filter(T.tokens(title), lambda w: F.length(w) > 3)
    return F.struct(
        (u.rlike(r"/(search|portal|cases)/?(\?|$)")).alias("portal"),
        (u.rlike(r"/[0-9]{5,}([/?#]|$)")).alias("opaque"),
        F.nullif(F.regexp_extract(u, r"(decision|notice|press|summary)", 1), F.lit("")).alias("doc_type"),
        F.exists(words, lambda w: F.contains(u, w)).alias("titled"),
    )


def integrity_messages(documents: DataFrame) -> DataFrame:
    """doc_id, stage of each thing wrong with a document's source: no link, fetch failed, empty text, no pages."""
    return K.violations(documents, "doc_id", {
        "link": F.length("url") > 0,
        "fetch": F.col("status") == 200,
        "text": F.length("text") > 0,
        "pages": F.col("pages") > 0,
    }).withColumnRenamed("rule", "stage")


def draft_warnings(passages: DataFrame) -> DataFrame:
    """Per case, passages without a role and foreign quotes without a translation."""
    ids = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("passage_id").cast("string")))), ",")
    role = F.coalesce(F.trim("role"), F.lit("")) == ""
    foreign = (F.col("language") != "en") & (F.coalesce("translation", F.lit("")) == "")
    return passages.groupBy("case_id").agg(ids(role).alias("unset_roles"), ids(foreign).alias("untranslated")).where("unset_roles <> '' or untranslated <> ''")


def freshness(rules: DataFrame, results: DataFrame) -> DataFrame:
    """Rules adjusted yearly with the worst of their anchors' results; verified_at only where all are fresh."""
    g = results.groupBy("rule").agg(F.bool_and(F.col("status") == "fresh").alias("all_fresh"), F.max("checked").alias("checked"))
    d = rules.where("annual").join(g, "rule", "left")
    status = F.when(F.col("all_fresh").isNull(), "unknown").when(F.col("all_fresh"), "fresh").otherwise("stale")
    return d.select("rule", status.alias("freshness_status"), F.when(F.col("all_fresh"), F.col("checked")).alias("verified_at"))


def link_inventory(rows: dict[str, DataFrame], fields: list[str]) -> DataFrame:
    """Owner kind, owner, field, url of every link in the tables; rows: kind -> (owner and the fields it has)."""
    parts = []
    for kind, d in rows.items():
        has = [f for f in fields if f in d.columns]
        links = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("url")) for f in has])).alias("x")
        parts.append(d.select(F.lit(kind).alias("kind"), "owner", links).select("kind", "owner", "x.*").where("url is not null and url <> ''"))
    return reduce(DataFrame.unionByName, parts)


def validated(merged: DataFrame, key: str, draft_only: list[str], defaults: dict[str, str], rules: dict[str, Column]) -> DataFrame:
    """What a merged draft breaks once draft-only columns are dropped and defaults filled."""
    d = merged.drop(*draft_only).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
    return K.violations(d, key, rules)


#: Roles of passages; signs from which a quote may be cut short; signs of a quote that tell whether it is listed elsewhere.
ROLES = ["commission_assessment", "conclusion", "precedent", "notifying_party_view", "market_investigation", "background"]
CUT_FROM, SAME_START = 50, 80


def cut_quote(c: Column) -> Column:
    """A quote of several sentences that ends inside one: CUT_FROM signs or more, a sentence's end with more after it, none at its own end."""
    q = F.trim(c)
    return (F.length(q) >= CUT_FROM) & q.rlike(r"[.!?]\s+\S") & ~q.rlike(r'[.!?"\u201d)]\s*$')


def chunk_quotes(passages: DataFrame, pages: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """passage_id, verdict, page, role, language of quotes that an extraction cites from its chunks.

    passages: passage_id, chunk_id, page, quote, and where they have them role, language; pages: chunk_id, page_number, text; languages:
    chunk_id, language of its document. Verdicts in order: missing chunk_id, quote or page; truncated; unknown_chunk;
    unknown_page (not in the chunk); ok; corrected (the first other page of the chunk that has the quote); not_found. An
    unknown role is empty, as is a language that is no code; an empty one is that of the document.
    """
    p = passages.withColumns({c: F.lit(None).cast("string") for c in ("role", "language") if c not in passages.columns})
    quote, chunk = F.trim(F.coalesce("quote", F.lit(""))), F.coalesce(F.col("chunk_id").cast("string"), F.lit(""))
    flaw = F.when(chunk == "", "missing_chunk").when(quote == "", "missing_quote").when(F.coalesce("page", F.lit(0)) == 0, "missing_page").when(cut_quote(quote), "truncated")
    p = p.withColumn("flaw", flaw)
    here = pages.select("chunk_id", F.col("page_number").alias("page"), F.lit(True).alias("listed")).distinct()
    known = pages.select("chunk_id", F.lit(True).alias("known")).distinct()
    d = p.join(known, "chunk_id", "left").join(here, ["chunk_id", "page"], "left")
    open_ = d.where("flaw is null and listed").select("passage_id", F.col("chunk_id").alias("doc_id"), "page", "quote")
    found = grounded(open_, pages.withColumnRenamed("chunk_id", "doc_id")).select("passage_id", "status", "found_page")
    d = d.join(found, "passage_id", "left")
    verdict = F.coalesce("flaw", F.when(F.col("known").isNull(), "unknown_chunk").when(F.col("listed").isNull(), "unknown_page").when(F.col("status") == "wrong_page", "corrected").otherwise(F.coalesce("status", F.lit("not_found"))))
    role = F.when(F.col("role").isin(ROLES), F.col("role")).otherwise("")
    spoken = F.when(F.coalesce(T.is_language(F.trim("language")), F.lit(False)), F.trim("language")).otherwise("")
    if languages is not None:
        d = d.join(languages.select("chunk_id", F.col("language").alias("document_language")), "chunk_id", "left")
        spoken = F.when(spoken == "", F.coalesce("document_language", F.lit(""))).otherwise(spoken)
    return d.select("passage_id", verdict.alias("verdict"), F.when(verdict.isin("ok", "corrected"), F.col("found_page")).alias("page"), role.alias("role"), spoken.alias("language"))


def top_level(passages: DataFrame, nested: DataFrame) -> DataFrame:
    """Passages of a case's own list whose quote begins as none does that a proposition of the case lists; both: case_id, quote."""
    begin = F.substring(F.coalesce("quote", F.lit("")), 1, SAME_START)
    there = nested.select("case_id", begin.alias("begin")).distinct()
    return passages.withColumn("begin", begin).join(there, ["case_id", "begin"], "left_anti").drop("begin")


def listing_rows(pages: DataFrame, kind: str) -> DataFrame:
    """page_id, url, title, day of the listing rows (class views-row) of one case type."""
    rows = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?s)<div class="views-row">(.*?)</div>'), F.lit(1))).alias("row"))
    get = lambda pattern: F.trim(F.regexp_extract("row", pattern, 1))
    d = rows.select("page_id", get('href="([^"]*)"').alias("url"), get(r"<a [^>]*>([^<]*)</a>").alias("title"), get(r"<time>([^<]*)</time>").alias("day"), get(r'<span class="type">([^<]*)</span>').alias("type"))
    return d.where(F.col("type") == kind).drop("type")


def merged_drafts(drafts: DataFrame, batch: str, case: str, seq: str, fields: list[str], preferred: Column) -> DataFrame:
    """One record a batch of drafts, which must all be of one case (else an error): scalars by precedence, how many drafts."""
    order = F.struct(F.when(preferred, 0).otherwise(1), seq)
    picked = [F.min_by(f, F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), order)).alias(f) for f in fields]
    g = drafts.groupBy(batch).agg(F.min(case).alias(case), F.max(case).alias("_last"), F.count("*").alias("drafts"), *picked)
    mixed = F.raise_error(F.concat(F.lit("drafts of several cases in batch "), F.col(batch).cast("string")))
    return g.withColumn(case, F.when(F.col(case) == F.col("_last"), F.col(case)).otherwise(mixed.cast(g.schema[case].dataType))).drop("_last")


def unit_findings(units: DataFrame, kinds: list[str]) -> DataFrame:
    """Unit assessments with a label, their findings of unknown kind as `other`, findings without a description left out."""
    fixed = F.transform(F.filter("findings", lambda f: F.length(F.trim(f["description"])) > 0), lambda f: F.struct(F.when(f["kind"].isin(kinds), f["kind"]).otherwise("other").alias("kind"), f["description"].alias("description")))
    return units.where(F.length(F.trim("label")) > 0).withColumn("findings", fixed)


#: What names a market in a passage, and names that say nothing, are cut short, run over a list or are clauses.
ALIAS_PATTERNS = [
    r"\bthe relevant (?:product |geographic )?market is (?:an? )?([A-Za-z][^.;\n]{5,79}?)(?=\s*[.,;]|\s*$)",
    r"\b(?:an? |the )?overall market for (?:the )?([A-Za-z][^.;\n]{5,79}?)(?=\s*[.,;]|\s*$)",
    r"\brelevant product market for (?:the )?([A-Za-z][^.;\n]{5,79}?)(?=\s*[.,;]|\s*$)",
    r"\brelevant geographic market for (?:the )?([A-Za-z][^.;\n]{5,79}?)(?=\s*[.,;]|\s*$)",
    r"\bmarket for (?!(?:the purpose|assessing ))(?:the )?([A-Za-z][^.;\n]{5,79}?)(?=\s*[.,;]|\s*$)",
]
GENERIC = (
    "relevant market|relevant markets|relevant product market|relevant geographic market|relevant product markets|relevant geographic markets|product market|product markets|geographic market|geographic markets"
    "|overall market|the market|this market|the relevant market|a relevant market|the product market|the geographic market|left open|not defined"
).split("|")
ALIAS_CUT = r"(?:\(\w*$|:\s*\(\w*$|,\s*\(\w*$|:\s*$)"
ALIAS_LIST = r"(?i)\(\s*(?:i{1,3}|iv|v|ix|x|[a-z])\s*\)"
ALIAS_CLAUSE = r"(?i)\b(?:should|would|could|must|shall|will|cannot|need not|is not|are not|does not|do not|did not|would not|should not|could not)\b"
ALIAS_SHORTEST = 8


def alias_phrases(markets: DataFrame, passages: DataFrame, patterns: list[str] = ALIAS_PATTERNS) -> DataFrame:
    """market_id, alias, passage_id: names that a market's own passages give it, each once whatever its case, with the first passage, pattern and place that has it.

    markets: market_id, name (which is no alias of itself); passages: market_id, passage_id, quote. Left out are generic names,
    those under ALIAS_SHORTEST signs, cut short, running over a list, or with the verb of a clause.
    """
    at = lambda p: F.regexp_extract_all(F.trim("quote"), F.lit(f"(?im){p}"), F.lit(1))
    found = F.flatten(F.array(*[F.coalesce(at(p), F.array().cast("array<string>")) for p in patterns]))
    bare = lambda c: F.rtrim(F.regexp_replace(F.trim(c), "[.,;:]+$", ""))
    d = passages.select("market_id", "passage_id", F.posexplode(found).alias("nth", "said")).withColumn("said", F.regexp_replace(F.trim("said"), "[.,;:]+$", ""))
    d = d.where((F.col("said") != "") & ~F.col("said").rlike(ALIAS_CUT) & ~F.col("said").rlike(ALIAS_LIST) & ~F.col("said").rlike(ALIAS_CLAUSE))
    d = d.withColumn("alias", bare(F.regexp_replace("said", r"(?i)^the market for\s+", ""))).withColumn("k", F.lower("alias"))
    d = d.where((F.length("alias") >= ALIAS_SHORTEST) & ~F.col("k").isin(GENERIC))
    own = markets.select("market_id", F.lower(F.trim("name")).alias("k")).distinct()
    first = F.min_by(F.struct("alias", "passage_id"), F.struct("passage_id", "nth")).alias("x")
    return d.join(own, ["market_id", "k"], "left_anti").groupBy("market_id", "k").agg(first).select("market_id", "x.alias", "x.passage_id")


def aliases(passages: DataFrame, patterns: list[str], cut: Column | None = None) -> DataFrame:
    """market_id, alias: phrases in a market's passages that a pattern's group names, once whatever their case."""
    found = F.explode(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("quote", F.lit(p), F.lit(1)) for p in patterns])))).alias("alias")
    d = passages.select("market_id", found).withColumn("alias", F.trim("alias")).where("alias <> ''")
    if cut is not None:
        d = d.where(~cut)
    return d.groupBy("market_id", F.lower("alias").alias("k")).agg(F.min("alias").alias("alias")).drop("k")
