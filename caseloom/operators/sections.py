"""Sequence operators over the pages of documents: runs, chunks, hot windows, budgets, coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def islands(pages: DataFrame, new: Column, name: str = "island") -> DataFrame:
    """Rows of a document in page order with the number of the run they are in; new says where one begins."""
    order = W.partitionBy("doc_id").orderBy("page_number")
    return pages.withColumn(name, F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))


#: What numbered lines that are no headings have (foot notes and references); most signs and words of a heading, least signs, largest first number.
NO_HEADING = (
    r"(?i)Replies\s+to\s+questionnaire|Commission\s+decision\s+of\s+\d|Non.Horizontal\s+Merger\s+Guideline|Horizontal\s+Merger\s+Guideline|Form\s+CO\b|,\s*paragraph\s+\d"
    r"|\bOJ\s+[LC]\s+\d|\bibid\b|Judgm[ea]nt\s+of|Court\s+of\s+Justice|General\s+Court\b|Case\s+[A-Z]\.\d|^In\b"
    r"|^(?:January|February|March|April|May|June|July|August|September|October|November|December)\b|\bCOMP/[MA]\b|^See\b"
)
LONGEST, MOST_WORDS, SHORTEST, LARGEST = 65, 8, 4, 25


def is_heading(number: Column, title: Column) -> Column:
    """Whether a numbered line reads as a heading: short, of few words, not numbered like a foot note, no reference."""
    top = F.split(number, r"\.")[0]
    size = F.length(title).between(SHORTEST, LONGEST) & (F.size(F.split(title, r"\s+")) <= MOST_WORDS)
    return size & (F.length(top) <= 3) & (top.cast("int") <= LARGEST) & ~F.regexp_like(title, F.lit(NO_HEADING))


def heading_paths(pages: DataFrame, heading: str = r"^\s*([0-9]+(?:\.[0-9]+)*)\.?\s+([A-Z].*)$", fits: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pages with path: the numbered headings open at the end of the page, outermost first; pages without one carry on the last.

    A heading closes those of its depth or deeper. heading: number and title of a line; fits: which of these are headings (`is_heading`,
    or all). One window over a document's headings and pages keeps the last heading of each depth: it is open if no
    shallower one came after it. That is linear in the headings, and there are as many columns as depths.
    """
    at = lambda n: F.regexp_extract_all("text", F.lit(f"(?m){heading}"), F.lit(n))
    found = F.transform(F.arrays_zip(at(1).alias("number"), at(2).alias("title")), lambda x: F.struct(x["number"].alias("number"), (F.trim(x["title"]) if fits else x["title"]).alias("title")))
    heads = F.filter(found, lambda x: fits(x["number"], x["title"])) if fits else found
    p = pages.withColumn("heads", F.coalesce(heads, F.array().cast("array<struct<number:string,title:string>>")))
    depth = lambda number: F.size(F.split(number, r"\."))
    deepest = p.agg(F.max(F.array_max(F.transform("heads", lambda x: depth(x["number"]))))).first()[0] or 0
    d = p.select("*", F.size("heads").alias("n_heads"), F.posexplode_outer("heads").alias("nth", "head")).drop("heads")
    so_far = W.partitionBy("doc_id").orderBy("page_number", "nth").rowsBetween(W.unboundedPreceding, 0)
    mark = F.struct("page_number", "nth", F.concat_ws(" ", "head.number", "head.title").alias("label"))
    last = [F.last(F.when(depth(F.col("head.number")) == k, mark), ignorenulls=True).over(so_far).alias(f"last_{k}") for k in range(1, deepest + 1)]
    d = d.select("*", *last).where("n_heads = 0 or nth = n_heads - 1")
    labels = []
    for k in range(1, deepest + 1):
        above = [F.col(f"last_{j}") for j in range(1, k)]
        later = F.greatest(*above) if len(above) > 1 else above[0] if above else None
        open_ = F.col(f"last_{k}").isNotNull() & (F.lit(True) if later is None else later.isNull() | (F.col(f"last_{k}") > later))
        labels.append(F.when(open_, F.col(f"last_{k}.label")))
    path = F.concat_ws(" > ", *labels) if labels else F.lit("")
    return d.withColumn("path", path).select(*pages.columns, "path")


def chunks(pages: DataFrame, path: str, most: int = 12) -> DataFrame:
    """Runs of pages with one path, split at `most` pages: doc_id, chunk, path, first_page, last_page, pages. Pages without text are left out."""
    order = W.partitionBy("doc_id").orderBy("page_number")
    p = pages.where(F.length("text") > 0).withColumn("before", F.lag(path).over(order))
    p = islands(p, ~F.col(path).eqNullSafe(F.col("before")) | (F.row_number().over(order) == 1))
    nth = F.row_number().over(W.partitionBy("doc_id", "island").orderBy("page_number"))
    p = p.withColumn("part", F.floor((nth - 1) / most))
    g = p.groupBy("doc_id", "island", "part").agg(F.first(path).alias("path"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("pages"))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("island", "part"))
    return g.select("doc_id", F.concat(F.lit("chunk_"), F.lpad(number.cast("string"), 3, "0")).alias("chunk"), "path", "first_page", "last_page", "pages")


def hot_windows(pages: DataFrame, score: str, gap: int = 4, most: int = 15) -> DataFrame:
    """Windows about pages with a score: one page of context, clusters with gaps up to `gap`, split at `most` pages; doc_id, first_page, last_page, score."""
    order = W.partitionBy("doc_id").orderBy("page_number")
    near = F.max(score).over(order.rowsBetween(-1, 1))
    p = pages.withColumn("near", near).where("near > 0").withColumn("before", F.lag("page_number").over(order))
    p = islands(p, F.col("before").isNull() | (F.col("page_number") - F.col("before") > gap))
    first = F.min("page_number").over(W.partitionBy("doc_id", "island"))
    p = p.withColumn("part", F.floor((F.col("page_number") - first) / most))
    return p.groupBy("doc_id", "island", "part").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.sum(score).alias("score")).drop("island", "part")


def fallback_pages(pages: DataFrame, score: str, seed: int = 2, near: int = 1, most: int = 10, gap: int = 2, groups: int = 3) -> DataFrame:
    """Pages scoring `seed` or more, their neighbours from `near`, the best `most` of them, in groups with gaps up to `gap`, the first `groups` of these."""
    order = W.partitionBy("doc_id").orderBy("page_number")
    s = F.col(score)
    beside = F.greatest(F.coalesce(F.lag(score).over(order), F.lit(0)), F.coalesce(F.lead(score).over(order), F.lit(0)))
    p = pages.withColumn("beside", beside).where((s >= seed) | (s >= near) & (F.col("beside") >= seed))
    p = p.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy(s.desc(), "page_number"))).where(F.col("n") <= most)
    p = p.withColumn("before", F.lag("page_number").over(order))
    p = islands(p, F.col("before").isNull() | (F.col("page_number") - F.col("before") > gap))
    return p.where(F.col("island") <= groups).select("doc_id", "page_number", "island")


def under_budget(chunks: DataFrame, score: str, budget: int) -> DataFrame:
    """Chunks by falling score until the pages first pass the budget; all from there on are left out."""
    order = W.partitionBy("doc_id").orderBy(F.col(score).desc(), "first_page")
    d = chunks.withColumn("sum", F.sum("pages").over(order.rowsBetween(W.unboundedPreceding, 0)))
    over = F.max(F.when(F.col("sum") > budget, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("over", over).where("over = 0").drop("over", "sum")


def covering_selection(chunks: DataFrame, fallback: DataFrame, budget: int = 80, least_pages: int = 20, share: float = 0.25, large: int = 30, groups: int = 8) -> DataFrame:
    """doc_id, chunk, how (section, fallback), first_page, pages: the chunks of a document in page order up to the first that passes the budget of pages.

    chunks: doc_id, chunk, focus (boolean), page_numbers array; fallback: doc_id, rank, page_numbers. Chunks in focus are
    taken. Where they have fewer than least_pages, or in a document of `large` pages or more a smaller share than `share`,
    the first `groups` fallback groups (twice as many in such a document) are gone through by rank, and one with a page not covered
    so far is added. A document without focus has its first `groups` fallback groups, with no budget.

    A page is new where it comes first: a group is added if it is the first, after the focus, to hold one of its pages.
    """
    c = chunks.withColumn("pages", F.size("page_numbers"))
    n = c.groupBy("doc_id").agg(F.sum("pages").alias("all"), F.sum(F.when(F.col("focus"), F.col("pages")).otherwise(0)).alias("focused"), F.bool_or(F.col("focus") & (F.col("pages") > 0)).alias("some"))
    big = F.col("all") >= large
    thin = (F.col("focused") < least_pages) | (big & (F.col("focused") < F.lit(share) * F.col("all")))
    n = n.select("doc_id", "some", thin.alias("thin"), F.when(big & F.col("some"), 2 * groups).otherwise(groups).alias("most"))
    own = c.join(n, "doc_id").where("focus and pages > 0").select("doc_id", "chunk", F.lit(0).alias("rank"), "page_numbers", "some")
    more = fallback.join(n, "doc_id").where("(thin or not some) and rank <= most").select("doc_id", F.concat(F.lit("fallback_"), F.lpad(F.col("rank").cast("string"), 3, "0")).alias("chunk"), F.col("rank").cast("int").alias("rank"), "page_numbers", "some")
    every = own.unionByName(more)
    page = every.select("doc_id", "chunk", "rank", F.explode("page_numbers").alias("page"))
    first = F.min("rank").over(W.partitionBy("doc_id", "page"))
    new = page.withColumn("first", first).groupBy("doc_id", "chunk").agg(F.max((F.col("rank") == F.col("first")).cast("int")).alias("adds"))
    taken = every.join(new, ["doc_id", "chunk"]).where("rank = 0 or adds = 1 or not some")
    taken = taken.withColumns({"first_page": F.array_min("page_numbers"), "pages": F.size("page_numbers")})
    order = W.partitionBy("doc_id").orderBy("first_page", "rank", "chunk").rowsBetween(W.unboundedPreceding, 0)
    taken = taken.withColumn("upto", F.sum("pages").over(order))
    passed = F.max(F.when(F.col("some") & (F.col("upto") > budget), 1).otherwise(0)).over(order)
    return taken.withColumn("passed", passed).where("passed = 0").select("doc_id", "chunk", F.when(F.col("rank") == 0, "section").otherwise("fallback").alias("how"), "first_page", "pages")


#: Fixed value: a heading that may end a section: a number of two levels or more, and a capital.
SECTION_HEADING = r"^(\d+(?:\.\d+)+)\.?[ \t]+[A-Z]"


def section_texts(pages: DataFrame, targets: DataFrame, heading: str = SECTION_HEADING) -> DataFrame:
    """doc_id, chunk, page_number, part (own, spill), text: what of its chunk and of the next one belongs to a target section.

    pages: doc_id, chunk (a number, in document order), page_number, text; targets: doc_id, chunk, prefix (8.6 has 8.6.1, not 8.60).
    Of its own chunk: from the first heading of the section on its first page (from the top, if that has none) up to the first
    heading of another one after it; a chunk that begins with another's heading has nothing. Of the next chunk: up to
    the first heading of another section. Pages after the cut are left out; a page cut short loses its blanks at the end, and goes if nothing is left. An empty
    prefix keeps its own pages as they are.
    """
    at = targets.select("doc_id", F.col("chunk").alias("target"), "prefix")
    own = at.withColumns({"chunk": F.col("target"), "part": F.lit("own")})
    nxt = at.where("prefix <> ''").withColumns({"chunk": F.col("target") + 1, "part": F.lit("spill")})
    p = own.unionByName(nxt).join(pages, ["doc_id", "chunk"])
    keys = ["doc_id", "target", "part"]
    p = p.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy("page_number")))
    line = p.select(*keys, "nth", "prefix", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    place = F.sum(F.length("line") + 1).over(W.partitionBy(*keys, "nth").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    head = line.withColumns({"at": F.coalesce(place, F.lit(0)), "number": F.regexp_extract("line", heading, 1)}).where("number <> '' and prefix <> ''")
    head = head.withColumn("inside", (F.col("number") == F.col("prefix")) | F.startswith("number", F.concat("prefix", F.lit("."))))
    start = F.min(F.when(F.col("inside") & (F.col("nth") == 1) & (F.col("part") == "own"), F.col("at"))).over(W.partitionBy(*keys, "nth"))
    head = head.withColumn("start", F.coalesce(start, F.lit(0)))
    cut = head.groupBy(*keys, "nth").agg(F.max("start").alias("start"), F.min(F.when(~F.col("inside") & (F.col("at") >= F.col("start")), F.col("at"))).alias("end"), F.max("inside").alias("met"), F.count_if(~F.col("inside")).alias("foreign"))
    d = p.join(cut, [*keys, "nth"], "left")
    group = W.partitionBy(*keys)
    d = d.withColumn("stop", F.min(F.when(F.col("end").isNotNull(), F.col("nth"))).over(group)).where("stop is null or nth <= stop")
    short = F.regexp_replace(F.substring("text", F.col("start") + 1, (F.col("end") - F.col("start")).cast("int")), r"\s+\z", "")
    whole = F.substring("text", F.coalesce("start", F.lit(0)) + 1, F.length("text"))
    d = d.withColumn("text", F.when(F.col("end").isNotNull(), short).otherwise(whole)).where("end is null or text <> ''")
    return d.select("doc_id", F.col("target").alias("chunk"), "page_number", "part", "text")


def coverage(pages: DataFrame, category: str, gap: int = 2) -> DataFrame:
    """Runs of pages of each category: a page of another kind ends a run, as does a gap over `gap`: doc_id, category, page_start, page_end."""
    order = W.partitionBy("doc_id").orderBy("page_number")
    p = pages.withColumn("before", F.lag(category).over(order)).withColumn("page_before", F.lag("page_number").over(order))
    new = ~F.col(category).eqNullSafe(F.col("before")) | (F.col("page_number") - F.col("page_before") > gap)
    p = islands(p, new | F.col("page_before").isNull()).where(F.col(category).isNotNull())
    return p.groupBy("doc_id", "island", F.col(category).alias("category")).agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end")).drop("island")


def best_links(links: DataFrame, score: Column, lead: int | None = None) -> DataFrame:
    """The link of the highest score of each page, ties to the first; with lead, only if it beats the second by that much."""
    order = W.partitionBy("page_id").orderBy(F.col("score").desc(), "pos")
    d = links.withColumn("score", score).where("score > 0").withColumn("n", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("n = 1")
    if lead is not None:
        d = d.where(F.col("second").isNull() | (F.col("score") - F.col("second") >= lead))
    return d.select("page_id", "url", "score")


def best_dated(links: DataFrame, score: Column) -> DataFrame:
    """The link of the highest score over 0 of each page, then of the latest date, then the first."""
    order = W.partitionBy("page_id").orderBy(F.col("score").desc(), F.col("day").desc(), "pos")
    d = links.withColumn("score", score).where("score > 0").withColumn("n", F.row_number().over(order))
    return d.where("n = 1").select("page_id", "url", "score")


#: What names of reports have, and their scores.
REPORTS = [
    (100, r"final.report"),
    (90, r"(inquiry.report|main.report)"),
    (80, r"provisional.findings.report"),
    (70, r"provisional.findings(?!.*(appendix|appendices|notice|summary))"),
    (60, r"full.text.*(phase.1|phase1)"),
    (50, r"report"),
    (45, r"(ftd|full.?text.?decision|fulltext.decision|full.?text)"),
    (42, r"decision"),
    (42, r"fntq"),
    (38, r"non.confidential"),
    (40, r"^\d[\d\-]+\.pdf$"),
]
#: What names of other papers have.
NO_REPORT = (
    r"(final.order|interim.order|final.undertaking|interim.undertaking"
    r"|notice|summary|appendix|appendices|glossary|annex"
    r"|response|submission|working.paper|issues.statement"
    r"|survey|research|timetable|extension|cancellation"
    r"|news.release|press.rel|press_rel|enforcement.order"
    r"|disclosures?.of.interest"
    r"|explanatory.note|draft.final|draft_final"
    r"|terms.of.reference|ieo|directions|commencement"
    r"|derogation|revocation.order|revocation_order)"
)


def report_score(url: Column, text: Column | None = None) -> Column:
    """The score of the first of REPORTS that a file's name has, or the name and the link's text where that is given; null for other papers, 0 for the rest."""
    name = F.element_at(F.split(url, "/"), -1)
    name = name if text is None else F.concat(name, F.lit(" "), F.coalesce(text, F.lit("")))
    out = F.lit(0)
    for score, pattern in reversed(REPORTS):
        out = F.when(F.regexp_like(name, F.lit(f"(?i){pattern}")), score).otherwise(out)
    return F.when(~F.regexp_like(name, F.lit(f"(?i){NO_REPORT}")), out)


def best_reports(links: DataFrame, url: Column, text: Column | None = None) -> DataFrame:
    """page_id, url, how: the first link of the highest score over 0; else the only one that is no other paper; else none, to be looked up by hand."""
    d = links.withColumn("score", report_score(url, text))
    ours = F.when(F.col("score").isNotNull(), F.col("pos"))
    g = d.groupBy("page_id").agg(F.max("score").alias("top"), F.max_by("url", F.when(F.col("score") > 0, F.struct("score", -F.col("pos")))).alias("best"), F.min_by("url", ours).alias("lone"), F.count("score").alias("n"))
    how = F.when(F.col("top") > 0, "scored").when(F.col("n") == 1, "only").otherwise("manual")
    return g.select("page_id", F.when(how == "scored", F.col("best")).when(how == "only", F.col("lone")).alias("url"), how.alias("how"))
