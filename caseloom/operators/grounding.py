"""Grounding quotes in page text: verbatim, by fragments, or by dense tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from caseloom.functions import text as T
from caseloom.sources.scratch import kept


def by_fragments(quote: Column, text: Column, size: int = 28) -> Column:
    """The quote itself, or two of its fragments of `size` (a step of half of it apart) in order, each after the last."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(quote) - size + 1, F.lit(1)), F.lit(size // 2))
    fragments = F.transform(starts, lambda i: F.substring(quote, i, F.lit(size)))
    found = F.aggregate(
        fragments,
        F.struct(F.lit(0).alias("hits"), F.lit(1).alias("from")),
        lambda s, f: F.when(F.call_function("locate", f, text, s["from"]) > 0, F.struct((s["hits"] + 1).alias("hits"), (F.call_function("locate", f, text, s["from"]) + size).alias("from"))).otherwise(s),
        lambda s: s["hits"],
    )
    return F.contains(text, quote) | ((F.length(quote) >= size) & (found >= 2))


#: Words in a run that a quote and a text must share before they are compared.
RUN = 5


def _word_key(q: Column) -> Column:
    """Hash of a run of words that lie wholly inside a text which holds the quote: the second to sixth, or the second alone; null under three words."""
    ws = F.split(q, " ")
    return F.when(F.size(ws) >= RUN + 2, F.xxhash64(F.array_join(F.slice(ws, 2, RUN), " "))).when(F.size(ws) >= 3, F.xxhash64(F.get(ws, F.lit(1))))


def _word_runs(texts: DataFrame, sizes: tuple[int, ...], *keys: str) -> DataFrame:
    """keys and k: hashes of all runs of so many words of a text t, once each; none in a shorter one."""
    d = texts.select(*keys, F.split("t", " ").alias("w"))
    runs = []
    for size in sizes:
        some = F.transform("w", lambda w: F.xxhash64(w)) if size == 1 else F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, size), " ")))  # noqa: B023
        runs.append(F.when(F.size("w") >= size, some).otherwise(F.array().cast("array<bigint>")))
    return d.select(*keys, F.explode(F.array_distinct(F.concat(*runs))).alias("k"))


#: Pages up to which a document's quotes are looked for in each of its pages.
NEAR = 128


def grounded(passages: DataFrame, pages: DataFrame) -> DataFrame:
    """passage_id, status (ok, wrong_page, not_found, no_cache) and the page where the quote is: the cited one, else the first other.

    passages: passage_id, doc_id, page, quote. Quotes of documents of up to NEAR pages meet all of these pages, by one join on the
    document: at most NEAR for each quote. Those of longer documents go through `_grounded_in_long`.
    """
    def sides(how: str | None) -> tuple[DataFrame, DataFrame]:
        """Passages and pages of long documents (left_semi), of the others (left_anti), or of all, in normal form."""
        p, g = (d.join(long, "doc_id", how) if how else d for d in (passages, pages))
        return p.select("passage_id", "doc_id", "page", T.normalized(F.col("quote")).alias("q")), g.select("doc_id", F.col("page_number").alias("found"), T.normalized(F.col("text")).alias("t"))

    long = kept(pages.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > NEAR).select("doc_id"), "long")
    some = not long.isEmpty()
    q, t = sides("left_anti" if some else None)
    has = F.contains("t", F.col("q"))
    d = q.join(t.withColumn("cached", F.lit(True)), "doc_id", "left").groupBy("passage_id").agg(
        F.bool_or("cached").alias("cached"), F.min(F.when(has & (F.col("found") == F.col("page")), F.col("found"))).alias("found"), F.min(F.when(has, F.col("found"))).alias("other")
    )
    if some:
        d = d.unionByName(_grounded_in_long(*(kept(side, "sides") for side in sides("left_semi"))))
    status = F.when(F.col("cached").isNull(), "no_cache").when(F.col("found").isNotNull(), "ok").when(F.col("other").isNotNull(), "wrong_page").otherwise("not_found")
    return d.select("passage_id", status.alias("status"), F.coalesce("found", "other").alias("found_page"))


def _grounded_in_long(q: DataFrame, t: DataFrame) -> DataFrame:
    """passage_id, cached, found, other of quotes q in pages t of the same documents, all of which have pages.

    Cited pages come first, by an equi-join on document and page. What is still open then looks for its run of words in an index of
    the word runs of those documents (quotes under three words, which have none, in their document's pages), and only pages
    that have it are searched.
    """
    at = (F.col("p.doc_id") == F.col("t.doc_id")) & (F.col("p.page") == F.col("t.found")) & F.contains("t.t", F.col("p.q"))
    first = kept(q.alias("p").join(t.alias("t"), at, "left").select("p.*", "t.found"), "cited")
    open_ = first.where("found is null").withColumn("k", _word_key(F.col("q")))
    several = (F.size(F.split("q", " ")) >= RUN + 2) & F.col("k").isNotNull()
    candidates = []
    for some, size in ((several, RUN), (~several & F.col("k").isNotNull(), 1)):
        o = open_.where(some).select("passage_id", "doc_id", "k", "q")
        index = _word_runs(t.join(o.select("doc_id").distinct(), "doc_id", "left_semi"), (size,), "doc_id", "found")
        candidates.append(index.join(o, ["doc_id", "k"]).select("passage_id", "doc_id", "found", "q"))
    shared = candidates[0].unionByName(candidates[1]).join(t, ["doc_id", "found"])
    short = open_.where("k is null").select("passage_id", "doc_id", "q").join(t, "doc_id")
    hit = shared.unionByName(short.select(*shared.columns)).where(F.contains("t", F.col("q"))).groupBy("passage_id").agg(F.min("found").alias("other"))
    d = first.groupBy("passage_id").agg(F.min("found").alias("found")).join(hit, "passage_id", "left")
    return d.select("passage_id", F.lit(True).alias("cached"), "found", "other")


def levels(grounded: DataFrame) -> DataFrame:
    """Findings with their level, and counts of each."""
    level = F.when(F.col("status") == "ok", "INFO").when(F.col("status") == "wrong_page", "WARNING").otherwise("ERROR")
    return grounded.groupBy(level.alias("level"), "status").agg(F.count("*").alias("n"))


def dense(pairs: DataFrame, recall: float = 0.85) -> DataFrame:
    """pair_id, found of pair_id, quote, text: the quote verbatim, or that share of its tokens within a window of one and a half times its length.

    Tokens of the text that the quote has are rows; a running sum over their positions counts the distinct ones.
    """
    q, t = T.normalized(F.col("quote")), T.normalized(F.col("text"))
    d = pairs.select("pair_id", (F.contains(t, q) & (q != "")).alias("verbatim"), T.tokens(q).alias("qt"), T.tokens(t).alias("tt"))
    d = d.withColumn("qs", F.array_distinct("qt")).withColumn("w", F.size("qt") + F.floor(F.size("qt") / 2))
    p = d.where((F.size("qt") > 0) & (F.size("tt") >= F.size("qt")) & ~F.col("verbatim"))
    p = p.where(F.size(F.array_intersect("qs", "tt")) / F.size("qs") >= recall)  # no window has more of them than the whole text
    p = p.select("pair_id", "qs", "w", F.size("tt").alias("n"), F.posexplode("tt").alias("pos", "tok")).where(F.array_contains("qs", F.col("tok")))
    # A token is inside the windows that begin after its last place before and up to its own: +1 there, -1 past it. The
    # running sum of these is the number of distinct tokens in the window that begins at a place.
    last = F.lag("pos").over(W.partitionBy("pair_id", "tok").orderBy("pos"))
    p = p.withColumn("in", F.greatest(F.col("pos") - F.col("w") + 1, F.coalesce(last + 1, F.lit(0)), F.lit(0)))
    step = F.explode(F.array(F.struct(F.col("in").alias("at"), F.lit(1).alias("by")), F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("by")))).alias("x")
    sums = p.select("pair_id", F.size("qs").alias("of"), step).groupBy("pair_id", "of", "x.at").agg(F.sum("x.by").alias("by"))
    run = F.sum("by").over(W.partitionBy("pair_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    best = sums.withColumn("run", run).groupBy("pair_id").agg(F.max(F.col("run") / F.col("of")).alias("best"))
    d = d.join(best, "pair_id", "left")
    return d.select("pair_id", (F.col("verbatim") | F.coalesce(F.col("best") >= recall, F.lit(False))).alias("found"))


#: First signs by which quotes of one or two words meet texts: a text with the quote has them.
HEAD = 3


def _short_pairs(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (item_id, doc_id) of quotes q under three words that are somewhere in a text t, by its runs of up to HEAD signs."""
    q = quotes.where((F.size(F.split("q", " ")) < 3) & (F.col("q") != "")).select("item_id", "q", F.substring("q", 1, HEAD).alias("k"))
    if q.isEmpty():
        return q.select("item_id").crossJoin(texts.select("doc_id").limit(0))
    heads = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.array(*(F.substring("t", i, F.lit(n)) for n in range(1, HEAD + 1)))))))
    d = texts.where("t <> ''").select("doc_id", heads.alias("k")).join(q, "k").select("item_id", "doc_id", "q")
    return d.join(texts.select("doc_id", "t"), "doc_id").where(F.contains("t", F.col("q"))).select("item_id", "doc_id").distinct()


def verbatim(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, doc_id where the whole quote q is in the whole text t; both sides come in one form, with single blanks.

    A quote's words but for the first and last are words of the text, so that quote and text meet at the second to
    sixth word of it (at the second alone, if it has fewer than seven), by a join on hashes of runs of words. Quotes of one
    or two words meet texts by their first signs. Null and empty quotes are in no text.
    """
    q = quotes.select("item_id", "q", _word_key(F.col("q")).alias("k")).where("k is not null")
    d = _word_runs(texts.where("t <> ''"), (RUN, 1), "doc_id")
    pairs = d.join(q.select("item_id", "k"), "k").select("item_id", "doc_id").distinct()
    pairs = pairs.join(q.select("item_id", "q"), "item_id").join(texts.select("doc_id", "t"), "doc_id").where(F.contains("t", F.col("q"))).select("item_id", "doc_id")
    return pairs.unionByName(_short_pairs(quotes, texts))


#: Tokens that a quote and a text must share, of the quote's rarest: so many more are looked at than may be missing.
SHARED = 3


def likely(quotes: DataFrame, texts: DataFrame, recall: float = 0.85) -> DataFrame:
    """Pairs (item_id, doc_id) of quotes (item_id, quote) and texts (doc_id, text) of which dense may say yes.

    A quote of n distinct tokens has that share of them in the text, or all but two if it is there verbatim: at most
    m = n - ceil(recall * n), or two, are missing. Of its m + SHARED rarest tokens (of all, if it has fewer), all but m are in the
    text, one at least. A quote under four has all of its tokens in the text, or is there verbatim with no whole token: that
    is looked for by its first signs, as by `verbatim`. Texts are taken apart once, and their tokens kept.
    """
    words = lambda d, c, *keys: d.select(*keys, F.array_distinct(T.tokens(T.normalized(F.col(c)))).alias("ts"))
    docs = kept(words(texts, "text", "doc_id"), "tokens").select("doc_id", F.explode("ts").alias("tok"))
    q = words(quotes, "quote", "item_id").select("item_id", F.size("ts").alias("n"), F.explode("ts").alias("tok"))
    df = docs.join(q.select("tok").distinct(), "tok", "left_semi").groupBy("tok").agg(F.count("*").alias("df"))
    missing = F.greatest(F.col("n") - F.ceil(F.lit(recall) * F.col("n") - 1e-9), F.lit(2))
    q = q.join(df, "tok", "left").withColumn("i", F.row_number().over(W.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "tok")))
    q = q.withColumn("most", F.least(missing + SHARED, "n")).where("i <= most").select("item_id", "tok", F.greatest(F.col("most") - missing, F.lit(1)).alias("least"))
    met = docs.join(q, "tok").groupBy("item_id", "doc_id", "least").agg(F.count("*").alias("shared")).where("shared >= least").select("item_id", "doc_id")
    few = words(quotes, "quote", "item_id", "quote").where(F.size("ts") < 4).select("item_id", T.normalized(F.col("quote")).alias("q")).where("q <> ''")
    if few.isEmpty():
        return met
    inner = texts.select("doc_id", T.normalized(F.col("text")).alias("t"))
    return met.unionByName(verbatim(few, inner)).distinct()
