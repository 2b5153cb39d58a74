"""Fuzzy joins of propositions, pairing by tokens, greedy picks."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType
from pyspark.sql.window import Window as W

from caseloom.functions import text as T
from caseloom.operators import similar
from caseloom.sources.scratch import kept, smallest_reachable

#: Similarity from which two names match, and from which one may be a rename of the other.
MATCH, RENAME = 0.75, 0.45


def _ratios(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def ratio(a: Column, b: Column) -> Column:
    """The matching-blocks ratio of two strings, which Spark lacks: in Arrow batches, on blocked pairs only."""

    def of(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return _ratios(pairs)

    return F.pandas_udf(of, DoubleType())(a, b)


#: Synonyms of names, narrower ones first.
SYNONYMS = [
    (r"\bwearable\s+os(?:es?|s)?\b", "wearable operating system"),
    (r"\blicensable\s+os(?:es?|s)?\b", "licensable operating system"),
    (r"\bos(?:es?|s)?\b", "operating system"),
    (r"\bplatform(?:s)?\b", "operating system"),
    (r"\bwrist[-\s]?worn\b", "wearable"),
    (r"\bad[-\s]?tech(?:nology)?\b", "advertising technology"),
    (r"\badtech\b", "advertising technology"),
    (r"\bintermediation\b", "advertising"),
    (r"\bapplication\s+store(?:s)?\b", "app store"),
]
#: Words of names that tell nothing; for names of places, those of regions and scope too.
STOP = "the a an of for and or to in at by on with from within market markets relevant".split()
GEO_STOP = STOP + "eea eu uk us national worldwide global international geographic geographical scope geo regional area territory least along lines excluding china wide eeea".split()
#: Words of each class of device; classes that conflict; what a conflict leaves of a similarity.
DEVICES = {
    "pc": r"\b(?:pc(?:s)?\b|personal\s+computer|desktop|laptop)",
    "mobile": r"\b(?:smart\s+mobile|mobile\s+devices?|smartphone|smart\s*phone|cell\s*phone)",
    "wearable": r"\b(?:wearable|smartwatch|fitness\s+tracker|wristband)",
}
CONFLICTS, CONFLICT_FACTOR = [("pc", "wearable"), ("pc", "mobile")], 0.55
#: Weight of the context of two places, and its least overlap for a rename.
CONTEXT_WEIGHT, CONTEXT_LEAST = 0.85, 0.30


def synonymous(c: Column) -> Column:
    """A name in lower case with its synonyms written one way."""
    out = F.lower(c)
    for pattern, one in SYNONYMS:
        out = F.regexp_replace(out, pattern, one)
    return out


def name_words(c: Column, stop: list[str]) -> Column:
    """Distinct words of a synonymous name, longer than two signs, without stop words and plural endings."""
    ws = F.filter(F.regexp_extract_all(synonymous(c), F.lit(r"(?U)\b\w+\b"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(stop))
    return F.array_distinct(F.transform(ws, lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def shared_words(a: Column, b: Column, stop: list[str]) -> Column:
    """Common words over all words of two names; 0 if either has none."""
    x, y = name_words(a, stop), name_words(b, stop)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """The largest of the ratio of two names, that of their synonymous forms, and the overlap of their words."""
    form = lambda c: F.trim(F.lower(c))
    return F.greatest(ratio(form(a), form(b)), ratio(form(synonymous(a)), form(synonymous(b))), shared_words(a, b, STOP))


def device_factor(a: Column, b: Column) -> Column:
    """What a conflict of the devices that two names are about leaves of their similarity; else 1."""
    has = lambda c, d: F.regexp_like(synonymous(c), F.lit(f"(?i){DEVICES[d]}"))
    clash = F.lit(False)
    for x, y in CONFLICTS:
        some = (has(a, x) | has(a, y)) & (has(b, x) | has(b, y))
        clash = clash | (some & ((has(a, x) != has(b, x)) | (has(a, y) != has(b, y))))
    return F.when(clash, CONFLICT_FACTOR).otherwise(1.0)


def contextual(a: Column, b: Column, kind: Column) -> Column:
    """Similarity by the kind of proposition: products are cut by a conflict of devices, places raised by their shared context."""
    s = similarity(a, b)
    context = F.least(shared_words(a, b, GEO_STOP) * CONTEXT_WEIGHT, F.lit(MATCH - 0.01))
    return F.when(kind == "geographic", F.greatest(s, context)).when(kind == "product", s * device_factor(a, b)).otherwise(s)


def _prepared(rows: DataFrame, id: str, name: str) -> DataFrame:
    """case_id, kind, id (the first of the rows of that name), and what `contextual` compares of a name, once for each distinct name of a case and kind."""
    n = F.col(name)
    bits = [F.when(F.regexp_like(synonymous(n), F.lit(f"(?i){p}")), 1 << k).otherwise(0) for k, p in enumerate(DEVICES.values())]
    rule = F.when(F.col("kind") == "geographic", 2).when(F.col("kind") == "product", 1).otherwise(0)
    d = rows.groupBy("case_id", "kind", name).agg(F.min(F.col(id).cast("long")).alias("id"))
    form = lambda c: F.coalesce(F.trim(F.lower(c)), F.lit(""))
    words = lambda stop: F.coalesce(name_words(n, stop), F.array().cast("array<string>"))
    return d.select("case_id", "kind", "id", rule.alias("rule"), form(n).alias("raw"), form(synonymous(n)).alias("plain"), words(STOP).alias("words"), words(GEO_STOP).alias("places"), F.coalesce(sum(bits[1:], bits[0]), F.lit(0)).alias("devices"))


def _device_factors() -> np.ndarray:
    """`device_factor` of two names by the devices they are about, as sums of powers of two in the order of DEVICES."""
    order, out = list(DEVICES), np.ones((8, 8))
    for a in range(8):
        for b in range(8):
            for pair in CONFLICTS:
                x, y = (tuple(bool(n >> order.index(d) & 1) for d in pair) for n in (a, b))
                if any(x) and any(y) and x != y:
                    out[a, b] = CONFLICT_FACTOR
    return out


class _Overlaps:
    """Word lists of a block, ready to tell the words that another list has in common with each, over all words of the two."""

    def __init__(self, lists: list[list[str]]):
        places: dict[str, list[int]] = {}
        for k, words in enumerate(lists):
            for w in set(words):
                places.setdefault(w, []).append(k)
        self.places = {w: np.array(ks) for w, ks in places.items()}
        self.sizes = np.array([len(set(words)) for words in lists], np.int64)

    def shares(self, words: list[str]) -> np.ndarray:
        own, met = set(words), np.zeros(len(self.sizes), np.int64)
        for w in own & self.places.keys():
            met[self.places[w]] += 1
        return np.where(met > 0, met / np.maximum(len(own) + self.sizes - met, 1), 0.0)


def _best_drafts(existing: list[tuple], drafts: list[tuple]) -> Iterator[tuple]:
    """id, similarity, draft, gated, gated_draft of each existing name of a block that has a draft of RENAME or more: the best one, and the best of those that share enough context."""
    n = len(drafts)
    raw, plain = similar.Names([d[2] for d in drafts]), similar.Names([d[3] for d in drafts])
    changed = np.flatnonzero([d[2] != d[3] for d in drafts])
    some = similar.Names([drafts[k][3] for k in changed])
    devices, factors = np.array([d[6] for d in drafts], np.int64), _device_factors()
    words_of, places_of = (_Overlaps([d[k] for d in drafts]) for k in (4, 5))

    for id, rule, name, form, words, places, device in existing:
        common = words_of.shares(words)
        factor = factors[device][devices] if rule == 1 else np.ones(n)
        context = places_of.shares(places) if rule == 2 else np.zeros(n)
        raised = np.minimum(context * CONTEXT_WEIGHT, MATCH - 0.01)
        together = lambda r, f: np.maximum(np.maximum(np.maximum(r, f), common) * factor, raised)  # noqa: B023, E731
        exact = lambda k: max(max(similar.ratio(name, raw.names[k]), similar.ratio(form, plain.names[k]), common[k]) * factor[k], raised[k])  # noqa: B023, E731

        # Where neither form differs from the name itself, one bound serves both.
        by_name = raw.cheap(name)
        if form == name:
            by_form = by_name.copy()
            by_form[changed] = some.cheap(form)
        else:
            by_form = plain.cheap(form)
        least = RENAME
        if n and rule != 2:  # one pair in full first: what cannot reach it needs no closer look
            least = max(least, exact(int(together(by_name, by_form).argmax())))
        near = by_name if (by_name < least).all() else raw.tighter(name, by_name, least)
        if form == name:
            by_form[changed] = some.tighter(form, by_form[changed], least)
            same = np.ones(n, bool)
            same[changed] = False
            by_form[same] = near[same]
        else:
            by_form = plain.tighter(form, by_form, least)
        bound = together(near, by_form)
        best = gated = (0.0, 0)
        reach = np.flatnonzero(bound >= RENAME)
        for k in reach[np.argsort(-bound[reach], kind="stable")].tolist():
            if bound[k] < best[0] and (rule != 2 or best[0] >= MATCH or bound[k] < gated[0]):
                break
            s = exact(k)
            if s >= RENAME:
                best = max(best, (s, -drafts[k][0])) if best[0] else (s, -drafts[k][0])
                if context[k] >= CONTEXT_LEAST:
                    gated = max(gated, (s, -drafts[k][0])) if gated[0] else (s, -drafts[k][0])
        if best[0]:
            yield id, float(best[0]), -best[1], float(gated[0]) if gated[0] else None, -gated[1] if gated[0] else None


def reconciled(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """Per existing item its best draft of the same case and kind, each on its own (a draft may serve several): matched, renamed or unmatched.

    existing: case_id, kind, item, name; drafts: case_id, kind, draft, draft_name. Similarity is that of `contextual`, ties go to
    the first draft. A place is renamed only to a draft that shares enough context, the best of these. Distinct
    names of a case and kind meet block by block, and only pairs whose bound (`similar.Names`) can win are compared in full.
    """
    on = ["case_id", "kind"]
    fields = "id long, similarity double, draft long, gated double, gated_draft long"
    found = similar.tiled(_prepared(existing, "item", "name"), _prepared(drafts, "draft", "draft_name"), on, _best_drafts, fields)
    top = lambda s, d: F.max(F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("s"), (-F.col(d)).alias("d"))))
    found = found.groupBy(*on, "id").agg(top("similarity", "draft").alias("best"), top("gated", "gated_draft").alias("gated"))
    first = existing.groupBy(*on, "name").agg(F.min(F.col("item").cast("long")).alias("id"))
    same = lambda a, b: (F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}")))
    named = first.join(found, [*on, "id"])
    d = existing.alias("a").join(named.alias("b"), same("case_id", "case_id") & same("kind", "kind") & same("name", "name"), "left")
    sure = F.col("best.s") >= MATCH
    renamed = F.when(F.col("a.kind") == "geographic", F.col("gated.d")).otherwise(F.col("best.d"))
    draft = -F.when(sure, F.col("best.d")).otherwise(renamed)
    how = F.when(sure, "matched").when(draft.isNotNull(), "renamed").otherwise("unmatched")
    return d.select("a.case_id", "a.kind", "a.item", draft.cast(drafts.schema["draft"].dataType).alias("draft"), how.alias("result"))


def additions(drafts: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Drafts that no existing item took."""
    return drafts.join(reconciled.where("draft is not null"), ["case_id", "kind", "draft"], "left_anti").select("case_id", "kind", "draft")


def sharing_tokens(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """on, tokens, others, n: sets of tokens of a group with the further sets that share n tokens with them, by a join on tokens.

    a: on, tokens; b: on, others; distinct rows.
    """
    x, y = a.select(on, "tokens", F.explode("tokens").alias("token")), b.select(on, "others", F.explode("others").alias("token"))
    return x.join(y, [on, "token"]).groupBy(on, "tokens", "others").agg(F.count("*").alias("n"))


#: Characters of different lists of partners in a part of the result, on average: a quarter of what a Parquet column takes into its dictionary.
LISTS_OF_A_PART = 1 << 18


def token_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, stop: list[str]) -> DataFrame:
    """Items of two lists of a case that share a token, by a join on tokens.

    Items with the same tokens have the same partners, so only distinct sets of tokens meet: the partners are written
    once for each set, and each item takes those of its set. Items of a set lie together, in parts of few sets, so that
    a file of the result holds each list once: its size on disk grows with the lists, not with the items that have them.
    """
    words = F.array_except(F.array_distinct(F.split(F.lower("name"), r"\s+")), F.lit(stop))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    x = a.groupBy("case_id", a_id).agg(united(words).alias("tokens"))
    y = b.select("case_id", b_id, F.array_sort(words).alias("others")).groupBy("case_id", "others").agg(F.collect_set(b_id).alias("ids"), F.sum(F.length(F.col(b_id).cast("string")) + 1).alias("chars"))
    met = sharing_tokens(x.select("case_id", "tokens").distinct(), y.select("case_id", "others"), "case_id")
    met = kept(met.join(y.select("case_id", "others", "chars"), ["case_id", "others"]), "sets")
    parts = 1 + (met.agg(F.sum("chars")).first()[0] or 0) // LISTS_OF_A_PART
    together = lambda d: d.repartition(parts, "case_id", "tokens")
    lists = together(met.join(y, ["case_id", "others"]).select("case_id", "tokens", "ids")).groupBy("case_id", "tokens").agg(F.array_join(F.transform(united("ids"), lambda i: i.cast("string")), ",").alias("paired"))
    return together(x).join(lists.hint("merge"), ["case_id", "tokens"]).select("case_id", a_id, "paired")


def nearest_names(missed: DataFrame, drafts: DataFrame, k: int = 5) -> DataFrame:
    """For each missed name of a case, the k drafts of largest token overlap over 0; ties to the first.

    Distinct sets of tokens meet block by block: of the drafts with one set only the first k can be among the nearest, and missed names with one set have the same ones.
    """
    words = lambda d, id, name, to: d.select("case_id", F.col(id).cast("long").alias(to), F.array_sort(F.array_distinct(T.tokens(F.col(name)))).alias("words")).where("size(words) > 0")
    m, d = words(missed, "item", "name", "item"), words(drafts, "draft", "draft_name", "other")
    sets = m.groupBy("case_id", "words").agg(F.min("item").alias("id"))
    first = F.row_number().over(W.partitionBy("case_id", "words").orderBy("other"))
    d = d.withColumn("n", first).where(F.col("n") <= k).drop("n")
    found = similar.overlapping(sets, d, ["case_id"], k).join(sets, ["case_id", "id"]).join(m, ["case_id", "words"])
    kinds = missed.schema["item"].dataType, drafts.schema["draft"].dataType
    return found.select("case_id", F.col("item").cast(kinds[0]).alias("item"), F.col("other").cast(kinds[1]).alias("draft"), "rank", F.round("overlap", 6).alias("overlap"))


def diverse(scored: DataFrame, count: int, bonus: float = 0.25) -> DataFrame:
    """Per case, one at a time, the best item next, with a bonus for a status not yet seen; ties to the first.

    Only the best `count` items of each status can be picked, so that is all a group holds.
    """
    order = W.partitionBy("case_id", "status").orderBy(F.col("score").desc(), "item")
    short = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count).drop("n")

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        left, seen, out = g.sort_values(["score", "item"], ascending=[False, True]).to_dict("records"), set(), []
        while left and len(out) < count:
            best = max(left, key=lambda r: (r["score"] + (0 if r["status"] in seen else bonus), -r["item"]))
            left.remove(best)
            seen.add(best["status"])
            out.append((best["case_id"], best["item"], len(out) + 1))
        return pd.DataFrame(out, columns=["case_id", "item", "pick"])

    return short.select("case_id", "item", "status", "score").groupBy("case_id").applyInPandas(pick, "case_id long, item long, pick int")


#: How strongly a status defines a place.
STRENGTH = {"defined": 6, "left_open": 5, "considered": 4, "not_conclusive": 3, "segmented": 2, "precedent_only": 1, "unknown": 0}
#: Fixed value: quotes that begin with the same so many signs are one.
SAME_QUOTE = 60


def joined_notes(first: str, second: str) -> str:
    """Notes of the stronger of two places, with the other's where they say more."""
    more = second.strip()
    return first.rstrip() + (" | " if first.strip() else "") + more if more and more not in first else first


class Slot:
    """An item kept so far, with what was merged into it."""

    def __init__(self, row: tuple):
        self.item, self.name, self.rank, self.status, self.notes, self.quotes = row

    def take(self, row: tuple, place: bool) -> None:
        """Merge an item: the one of higher rank stands, this one on ties; of places the other's notes and further quotes stay."""
        new = Slot(row)
        win, lose = (new, self) if new.rank > self.rank else (self, new)
        if place:
            seen = {q[:SAME_QUOTE] for q in win.quotes}
            win.notes, win.quotes = joined_notes(win.notes, lose.notes), win.quotes + [q for q in lose.quotes if q[:SAME_QUOTE] not in seen]
        if win is new:
            self.__dict__.update(new.__dict__)


def _fold(rows: Iterator[tuple], place: bool) -> Iterator[tuple]:
    """(item, slot, notes, quotes, status): of each item the slot that it went to, then, with item as the kept one, of each slot.

    rows of one component: first its pairs of names with their ratios, then its items in order. What is held are slots and pairs.
    """
    near: dict[str, list[tuple[str, float]]] = {}
    slots: list[Slot] = []
    by_name: dict[str, list[int]] = {}
    for side, item, name, other, value, status, notes, quotes in rows:
        if side == 0:
            near.setdefault(name, []).append((other, value))
            continue
        row = (item, name, value, status, notes or "", quotes or [])
        met = [(r, -k) for n, r in [(name, 1.0), *near.get(name, [])] for k in by_name.get(n, [])]
        if met:
            k = -max(met)[1]
            before = slots[k].name
            slots[k].take(row, place)
            if slots[k].name != before:
                by_name[before].remove(k)
                by_name.setdefault(slots[k].name, []).append(k)
        else:
            k = len(slots)
            slots.append(Slot(row))
            by_name.setdefault(name, []).append(k)
        yield False, item, k, None, None, None
    for k, s in enumerate(slots):
        yield True, s.item, k, s.notes, s.quotes, s.status


def _merged(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """case_id, kind, item, kept of all items; and case_id, kind, item, status, notes, quotes of the kept ones.

    Items meet only names that are linked with theirs, so each connected component of linked names is folded on its own, in
    order of its items; items are streamed, not gathered.
    """
    on = ["case_id", "kind"]
    d = items.withColumns({c: F.lit(None).cast(t) for c, t in (("status", "string"), ("notes", "string"), ("quotes", "array<string>")) if c not in items.columns})
    place = F.col("kind") == "geographic"
    strength = F.coalesce(F.create_map(*(F.lit(x) for kv in STRENGTH.items() for x in kv))[F.col("status")], F.lit(0))
    d = d.select(*on, F.col("item").cast("long").alias("item"), F.coalesce(F.trim(F.lower("name")), F.lit("")).alias("name"), F.when(place, strength).otherwise(F.coalesce("valid", F.lit(0))).cast("double").alias("value"), "status", "notes", "quotes")
    pairs = kept(similar.similar_pairs(d.select(*on, "name").distinct(), on, threshold), "similar")
    node = lambda c: F.xxhash64(*on, c)
    roots = smallest_reachable(pairs.select(node("a").alias("a"), node("b").alias("b")))
    none = lambda *cs: [F.lit(None).cast(d.schema[c].dataType).alias(c) for c in cs]
    links = pairs.select(*on, F.lit(0).alias("side"), F.lit(None).cast("long").alias("item"), F.col("a").alias("name"), F.col("b").alias("other"), F.col("ratio").alias("value"), *none("status", "notes", "quotes"))
    both = links.unionByName(d.withColumn("side", F.lit(1)).withColumn("other", F.lit(None).cast("string")))
    both = both.withColumn("node", node("name")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keys = [*on, "root"]
    both = both.select(*keys, "side", "item", "name", "other", "value", "status", "notes", "quotes").repartition(*keys).sortWithinPartitions(*keys, "side", "item")
    out = spark_schema(d, on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        made = []
        for key, group in groupby(rows, key=lambda r: r[:3]):
            for row in _fold((r[3:] for r in group), key[1] == "geographic"):
                made.append(key + row)
                if len(made) >= 10_000:
                    yield record(made)
                    made = []
        yield record(made)

    arrow = to_arrow_schema(out)

    def record(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    done = kept(both.mapInArrow(run, out), "merged")
    slots = done.where("stands").withColumnRenamed("item", "kept")
    same = (F.col("a.root") == F.col("b.root")) & (F.col("a.slot") == F.col("b.slot")) & F.col("a.case_id").eqNullSafe(F.col("b.case_id")) & F.col("a.kind").eqNullSafe(F.col("b.kind"))
    members = done.where("not stands").alias("a").join(slots.alias("b"), same)
    kind = items.schema["item"].dataType
    members = members.select("a.case_id", "a.kind", F.col("a.item").cast(kind).alias("item"), F.col("b.kept").cast(kind).alias("kept"))
    return members, slots.select(*on, F.col("kept").cast(kind).alias("item"), "status", "notes", "quotes")


def spark_schema(d: DataFrame, on: list[str]) -> StructType:
    """The rows of a fold: its keys, whether it is a slot, and what `_fold` yields."""
    out = StructType([d.schema[c] for c in on])
    for name, kind in (("root", "long"), ("stands", "boolean"), ("item", "long"), ("slot", "integer"), ("notes", "string"), ("quotes", ArrayType(StringType())), ("status", "string")):
        out = out.add(name, kind)
    return out


def greedy_merged(items: DataFrame, threshold: float = MATCH) -> DataFrame:
    """case_id, kind, item, kept (the item it stands under): per case and kind, items in order join the nearest kept name from the threshold up, ties to the oldest.

    items: case_id, kind, item, name, valid, and for places status, notes, quotes. Of two items the one with more valid
    passages stands, of two places the one of stronger status; the one kept so far on ties. Null names are empty; null counts 0.
    """
    return _merged(items, threshold)[0]


def merged_items(items: DataFrame, threshold: float = MATCH) -> DataFrame:
    """case_id, kind, item, status, notes, quotes of the items that stand. Places keep the notes of both where they differ, and quotes of both once."""
    return _merged(items, threshold)[1]


def paired_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """case_id, item, overlap: for each item of a, the largest share of the shorter name's tokens that it has in common with an item of b of its case.

    a and b: case_id, item, name; distinct sets of tokens meet by a join on tokens, and items take the share of their set.
    """
    words = lambda d, to: d.select("case_id", "item", F.array_sort(F.array_distinct(T.tokens(F.col("name")))).alias(to))
    x, y = words(a, "tokens"), words(b, "others")
    p = sharing_tokens(x.select("case_id", "tokens").distinct(), y.select("case_id", "others").distinct(), "case_id")
    best = p.groupBy("case_id", "tokens").agg(F.max(F.col("n") / F.least(F.size("tokens"), F.size("others"))).alias("overlap"))
    return x.join(best, ["case_id", "tokens"]).groupBy("case_id", "item").agg(F.max("overlap").alias("overlap"))


def _with_pairing(items: DataFrame, partners: DataFrame, bonus: float) -> DataFrame:
    """items with their score raised by the largest signal of a partner of their case: one of their market group counts fully, else the share of name tokens in common."""
    group = partners.where("market_group <> ''").select("case_id", "market_group", F.lit(1.0).alias("same")).distinct()
    d = items.join(paired_overlap(items, partners), ["case_id", "item"], "left").join(group, ["case_id", "market_group"], "left")
    return d.withColumn("score", F.col("score") + bonus * F.coalesce("same", "overlap", F.lit(0.0))).drop("same", "overlap")


def _first_scored(items: DataFrame, count: int) -> DataFrame:
    n = F.row_number().over(W.partitionBy("case_id").orderBy(F.col("score").desc(), "item"))
    return items.select("case_id", "item", n.cast("int").alias("pick")).where(F.col("pick") <= count)


def _filled(chosen: DataFrame, low: DataFrame, count: int) -> DataFrame:
    """chosen, and where a case has fewer than count, its best items of low signal after them."""
    have = chosen.groupBy("case_id").agg(F.count("*").cast("int").alias("have"))
    more = _first_scored(low, count).join(have, "case_id", "left").withColumn("pick", F.col("pick") + F.coalesce("have", F.lit(0)))
    return chosen.select("case_id", "item", "pick").unionByName(more.where(F.col("pick") <= count).select("case_id", "item", "pick"))


def review_set(products: DataFrame, geographies: DataFrame, count: int, bonus: float = 0.4) -> DataFrame:
    """case_id, item, pick, list: products first, each with a bonus by its pairing with a geography; then geographies, with one by the chosen products.

    Both: case_id, item, name, status, score, and where they have them market_group and low (of a category with little signal).
    Products are picked for diversity of status, geographies by score alone; ties go to the first. Items of low signal
    only fill up a case that has too few others, by score.
    """
    default = lambda d: d.withColumns({c: v for c, v in (("market_group", F.lit("")), ("low", F.lit(False))) if c not in d.columns}).withColumns({"market_group": F.coalesce("market_group", F.lit("")), "low": F.coalesce("low", F.lit(False))})
    products, geographies = default(products), default(geographies)
    p = kept(_with_pairing(products, geographies, bonus), "products")
    first = kept(_filled(diverse(p.where("not low"), count), p.where("low"), count), "picked")
    g = kept(_with_pairing(geographies, products.join(first, ["case_id", "item"], "left_semi"), bonus), "places")
    second = _filled(_first_scored(g.where("not low"), count), g.where("low"), count)
    return first.withColumn("list", F.lit("product")).unionByName(second.withColumn("list", F.lit("geographic")))


def gold_draft(items: DataFrame, selected: DataFrame, explicit: list[str], categories: list[str], passages: DataFrame) -> DataFrame:
    """case_id, item, name, passages: items named outright, then those of a category, then the selected ones; one a name, the first of these.

    items: case_id, item, name, category; selected: case_id, item; passages: case_id, item, passage.
    """
    key = F.lower(F.trim("name"))
    chosen = items.join(selected.select("case_id", "item", F.lit(True).alias("picked")).distinct(), ["case_id", "item"], "left")
    why = F.when(key.isin([x.strip().lower() for x in explicit]), 1).when(F.col("category").isin(categories), 2).when(F.col("picked"), 3)
    d = chosen.withColumn("why", why).where("why is not null")
    one = F.row_number().over(W.partitionBy("case_id", key).orderBy("why", "item"))
    d = d.withColumn("n", one).where("n = 1")
    p = passages.groupBy("case_id", "item").agg(F.sort_array(F.collect_set("passage")).alias("passages"))
    return d.join(p, ["case_id", "item"], "left").select("case_id", "item", "name", F.coalesce("passages", F.array().cast(p.schema["passages"].dataType)).alias("passages"))
