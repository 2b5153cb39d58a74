"""Column functions over text: normal forms, tokens, names, numbers, dates, links. All run inside Spark's own expressions but `folded` and `composed` of signs beyond ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Typographic signs and what they stand for.
QUOTES, PLAIN = "‘’“” ", "''\"\" "

#: Country codes that stand for a name in names of several segments.
COUNTRIES = {"de": "germany", "fr": "france", "it": "italy", "es": "spain", "uk": "united kingdom", "us": "united states"}


def beyond_ascii(c: Column) -> Column:
    """Whether a text has a sign beyond ASCII: only such texts go through Python, a hundred at a time, as they may be long."""
    return F.coalesce(c.rlike(r"[^\x00-\x7F]"), F.lit(False))


#: Signs that NFKC leaves alone wherever they stand, apart or side by side, beside those of ASCII: letters of three scripts, dashes and quotes.
INERT = r"À-ıĴ-ľŁ-ňŊ-žα-ώЀ-ҁ‒-‖‘-‣"


def changeable(c: Column) -> Column:
    """Whether a text has a sign that NFKC may change: only such texts go through Python."""
    return F.coalesce(c.rlike(rf"[\x{{80}}-\x{{10FFFF}}&&[^{INERT}]]"), F.lit(False))


@F.udf(StringType(), useArrow=False)
def folded_row(x: str | None) -> str | None:
    return None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()


@F.udf(StringType(), useArrow=False)
def composed_row(x: str | None) -> str | None:
    return None if x is None else unicodedata.normalize("NFKC", x)


def folded(c: Column) -> Column:
    """Compatibility forms apart, accents dropped, ASCII lower case (Spark has no Unicode normaliser)."""
    return F.when(beyond_ascii(c), folded_row(F.when(beyond_ascii(c), c))).otherwise(F.lower(c))


def composed(c: Column) -> Column:
    """Compatibility forms in their plain form, composed (NFKC)."""
    return F.when(changeable(c), composed_row(F.when(changeable(c), c))).otherwise(c)


def plain(c: Column) -> Column:
    """Plain quotes, single blanks."""
    return F.trim(F.regexp_replace(F.translate(c, QUOTES, PLAIN), r"\s+", " "))


def normalized(c: Column) -> Column:
    """Compatibility forms composed, plain quotes, single blanks."""
    return plain(composed(c))


def normalized_rows(d: DataFrame, name: str, to: str) -> DataFrame:
    """d with `to`, the T01 form of column name: only rows with a sign beyond ASCII go through Python, by a split and a union."""
    beyond = F.coalesce(F.col(name).rlike(r"[^\x00-\x7F]"), F.lit(False))
    return d.where(~beyond).withColumn(to, plain(F.col(name))).unionByName(d.where(beyond).withColumn(to, normalized(F.col(name))))


def bare(c: Column) -> Column:
    """ASCII lower case without accents, signs as blanks, single blanks."""
    return F.trim(F.regexp_replace(folded(c), r"[^a-z0-9]+", " "))


def is_contents(c: Column) -> Column:
    """A page with four or more runs of leader dots, each of four dots or more."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\.{4,}")) >= 4, F.lit(False))


#: Operative articles and phrases, in the order in which they decide, with outcome and stage.
ARTICLES = [
    ("article 8(3)", "blocked", "phase2"),
    ("article 8, paragraph 3", "blocked", "phase2"),
    ("article 8(2)", "cleared_with_conditions", "phase2"),
    ("article 8, paragraph 2", "cleared_with_conditions", "phase2"),
    ("article 8(1)", "cleared", "phase2"),
    ("article 8, paragraph 1", "cleared", "phase2"),
    ("article 6(2)", "cleared_with_conditions", "phase1"),
    ("article 6, paragraph 2", "cleared_with_conditions", "phase1"),
    ("article 6(1)(b)", "cleared", "phase1"),
    ("article 6(1)(c)", "pending", "phase2"),
    ("does not raise serious doubts", "cleared", "unknown"),
    ("compatible with the internal market", "cleared", "unknown"),
    ("does not significantly impede effective competition", "cleared", "unknown"),
]
CONDITIONAL = ["condition", "commitment", "undertaking"]


def article_outcome(c: Column) -> Column:
    """Outcome and stage by the first article or phrase of ARTICLES in the text; article 6(1)(b) with a word of CONDITIONAL is cleared with conditions."""
    t, out = F.lower(c), F.struct(F.lit("unknown").alias("outcome"), F.lit("unknown").alias("stage"))
    for phrase, outcome, stage in reversed(ARTICLES):
        said = F.lit(outcome)
        if phrase == "article 6(1)(b)":
            said = F.when(F.exists(F.lit(CONDITIONAL), lambda w: F.contains(t, w)), "cleared_with_conditions").otherwise(outcome)
        out = F.when(F.contains(t, F.lit(phrase)), F.struct(said.alias("outcome"), F.lit(stage).alias("stage"))).otherwise(out)
    return out


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return plain(F.regexp_replace(bare, "<[^>]+>", " "))


def tokens(c: Column) -> Column:
    """Tokens of a-z and digits, longer than one sign, in order."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens; 0 if either has none."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def slug(c: Column, most: int = 60) -> Column:
    """Lower case, runs of other signs as one low line, cut to length."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    return F.rtrim(F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, most), F.lit("_"))


def cache_key(url: Column, most: int = 120) -> Column:
    """Host and path of a link as a name for a file; "source" if nothing is left."""
    place = F.concat(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1), F.lit("_"), F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1))
    s = F.regexp_replace(F.regexp_replace(F.lower(place), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit("source"))


def is_language(c: Column) -> Column:
    """T24."""
    return F.coalesce(c.rlike("^[a-z]{3}$"), F.lit(False))


def sector_by_pattern(c: Column, patterns: list[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first pattern that matches."""
    out = F.when(F.lit(False), F.lit(None))
    for pattern, name in patterns:
        out = out.when(F.lower(c).rlike(pattern), name)
    return out.otherwise(other)


def parties(title: Column) -> Column:
    """Names in a title parted by a slash or by `and`, with roles: the first acquires, the others are targets."""
    names = F.filter(F.transform(F.split(title, r"\s*/\s*|\s+and\s+"), lambda n: F.trim(n)), lambda n: n != "")
    return F.transform(names, lambda n, i: F.struct(n.alias("name"), F.when(i == 0, "acquirer").otherwise("target").alias("role")))


def punct_folded(c: Column) -> Column:
    """Lower case, hyphens, dashes, slashes and commas as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[-‐-―/,]", " "), r"\s+", " "))


def segments(c: Column) -> Column:
    return F.transform(F.split(c, r"\s+[-–—]\s+"), lambda s: F.trim(s))


def trivially_equal(a: Column, b: Column) -> Column:
    """Equal but for case and blanks, for punctuation, or for country codes in names of several segments."""
    names = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    canonical = lambda s: F.coalesce(F.try_element_at(names, F.lower(s)), F.lower(s))
    x, y = F.transform(segments(a), canonical), F.transform(segments(b), canonical)
    many = (F.size(x) == F.size(y)) & (F.size(x) >= 2) & (x == y)
    return (F.lower(F.trim(a)) == F.lower(F.trim(b))) | (punct_folded(a) == punct_folded(b)) | many


def number(c: Column) -> Column:
    """Value of a written number: the last of comma and dot is the decimal sign, one alone before other than three digits too; other signs group by three."""
    s = F.trim(c)
    comma, dot = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    last_comma = F.length(s) - F.locate(",", F.reverse(s)) > F.length(s) - F.locate(".", F.reverse(s))
    alone = lambda sign: (F.regexp_count(s, F.lit(f"[{sign}]")) == 1) & ~s.rlike(rf"[{sign}][0-9]{{3}}$") & s.rlike(rf"[{sign}][0-9]+$")
    decimal = F.when(comma & dot, F.when(last_comma, ",").otherwise(".")).when(comma, F.when(alone(","), ",")).when(dot, F.when(alone("."), "."))
    at = F.length(s) - F.position(F.coalesce(decimal, F.lit("#")), F.reverse(s)) + 1
    whole = F.when(decimal.isNotNull(), F.substring(s, F.lit(1), at - 1)).otherwise(s)
    part = F.when(decimal.isNotNull(), F.substring(s, at + 1, F.length(s))).otherwise("")
    group = "[.,   ’']"
    fine = whole.rlike(rf"^[0-9]{{1,3}}({group}+[0-9]{{3}})*$") | whole.rlike("^[0-9]+$")
    digits = F.regexp_replace(whole, group, "")
    return F.when(fine & part.rlike("^[0-9]*$"), F.concat(digits, F.when(part != "", F.concat(F.lit("."), part)).otherwise("")).try_cast("double"))


#: Magnitude words.
MAGNITUDES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "bn": 1e9, "trillion": 1e12}


def amounts(text: Column, currency: str) -> Column:
    """Values of money named in a text: a number with a magnitude word, and a number after the currency."""
    found = rf"(?i)(?:({currency}|[$€£])\s*)?([0-9](?:[0-9.,]*[0-9])?)(?:\s*({'|'.join(MAGNITUDES)})\b)?"
    every = F.regexp_extract_all(text, F.lit(found), F.lit(0))
    times = F.create_map(*[F.lit(x) for kv in MAGNITUDES.items() for x in kv])
    value = lambda m: number(F.regexp_extract(m, found, 2)) * F.coalesce(F.try_element_at(times, F.lower(F.regexp_extract(m, found, 3))), F.lit(1.0))
    money = lambda m: (F.regexp_extract(m, found, 1) != "") | (F.regexp_extract(m, found, 3) != "")
    return F.filter(F.transform(F.filter(every, money), value), lambda v: v.isNotNull())


def within(value: Column, expected: Column, share: float = 0.02, floor: float = 1.0) -> Column:
    """Whether a value is the expected one, to a share of it or a floor; an expected nothing is met by values up to the share."""
    return F.when(expected == 0, F.abs(value) <= share).otherwise(F.abs(value - expected) <= F.greatest(F.abs(expected) * share, F.lit(floor)))


def any_within(values: Column, expected: Column, share: float = 0.02, floor: float = 1.0) -> Column:
    """Whether any of the values mentioned is the expected one. Shares have no floor."""
    return F.exists(values, lambda v: within(v, expected, share, floor))


#: Fractions in words, as percent.
FRACTIONS = [(r"\bone[- ]quarter\b", 25.0), (r"\bthree[- ]quarters\b", 75.0), (r"\bone[- ]third\b", 100 / 3), (r"\btwo[- ]thirds\b", 200 / 3), (r"\bone[- ]half\b", 50.0)]


def shares(text: Column) -> Column:
    """Shares named in a text, as percent: percentages, then numbers from 0 to 1 with a fraction, then fractions in words."""
    plain = lambda m: F.replace(m, F.lit(","), F.lit(".")).cast("double")
    percent = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(?:%|per cent|percent|τοις εκατο)"), F.lit(1)), plain)
    unit = F.transform(F.regexp_extract_all(text, F.lit(r"\b0[.,][0-9]+\b"), F.lit(0)), lambda m: plain(m) * 100)
    words = F.array_compact(F.array(*[F.when(F.lower(text).rlike(w), F.lit(v)) for w, v in FRACTIONS]))
    return F.concat(percent, unit, words)


@F.pandas_udf(StringType())
def unaccented(s: pd.Series) -> pd.Series:
    """Lower case without accents, in any script (Spark has no Unicode normaliser)."""
    strip = lambda x: "".join(c for c in unicodedata.normalize("NFD", x.lower()) if unicodedata.category(c) != "Mn")
    return s.map(lambda x: x if x is None else x.lower() if x.isascii() else strip(x))


#: Number words in three languages, without accents.
NUMBER_WORDS = [
    ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen", range(1, 20)),
    ("twenty thirty forty fifty sixty seventy eighty ninety hundred", range(20, 101, 10)),
    ("один одна одно два две три четыре пять шесть семь восемь девять десять", [1, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]),
    ("одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать", range(11, 20)),
    ("двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто сто", range(20, 101, 10)),
    ("двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот", range(200, 901, 100)),
    ("ενα δυο τρια τεσσερα πεντε εξι επτα εφτα οκτω οχτω εννεα δεκα", [1, 2, 3, 4, 5, 6, 7, 7, 8, 8, 9, 10]),
    ("εικοσι τριαντα σαραντα πενηντα εξηντα εβδομηντα ογδοντα ενενηντα εκατο", range(20, 101, 10)),
    ("διακοσια τριακοσια τετρακοσια πεντακοσια εξακοσια επτακοσια οκτακοσια εννιακοσια", range(200, 901, 100)),
]
#: Words of scale, and beginnings of words of scale in further forms and languages.
SCALE_WORDS = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12, "χιλιαδες": 10**3}
SCALE_STEMS = {"тысяч": 10**3, "миллион": 10**6, "миллиард": 10**9, "триллион": 10**12, "εκατομμυρ": 10**6, "δισεκατομμυρ": 10**9}
SCALE_STEMS |= {"milliard": 10**9, "miliard": 10**9, "million": 10**6, "milion": 10**6, "millon": 10**6, "milhao": 10**6, "milhoe": 10**6}


def spelled_values(text: Column) -> Column:
    """The values written in words in a text, in order: those with a word of scale; in English, Russian and Greek.

    A fold over the words carries the number so far. Units add up in a group, hundreds multiply it, and a word of scale
    multiplies all of the number before it; any other word ends the number.
    """
    units = {w: float(n) for words, values in NUMBER_WORDS for w, n in zip(words.split(), values, strict=True)}
    as_map = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, float(v))])
    stem = F.lit(None).cast("double")
    stems = f"^({'|'.join(SCALE_STEMS)})"

    def scale(w: Column) -> Column:
        found = stem
        for begin in sorted(SCALE_STEMS, key=len):  # the longest last, so that it is asked first
            found = F.when(F.startswith(w, F.lit(begin)), float(SCALE_STEMS[begin])).otherwise(found)
        return F.when(w.isin(*SCALE_WORDS), F.try_element_at(as_map(SCALE_WORDS), w)).when(w.rlike(stems), found)

    tokens = F.regexp_extract_all(unaccented(text), F.lit("[a-z\u0400-\u04ff\u0370-\u03ff]+"), F.lit(0))
    # (value, of scale) of each word of a number, and null for any other
    read = F.transform(tokens, lambda w: F.when(w.isin(*units), F.struct(F.try_element_at(as_map(units), w).alias("n"), F.lit(False).alias("scale"))).otherwise(F.when(scale(w).isNotNull(), F.struct(scale(w).alias("n"), F.lit(True).alias("scale")))))
    zero = F.lit(0.0)
    state = lambda total, group, scaled, out: F.struct(total.alias("total"), group.alias("group"), scaled.alias("scaled"), out.alias("out"))
    ended = lambda s: F.when(s["scaled"] & (s["total"] + s["group"] > 0), F.concat(s["out"], F.array(s["total"] + s["group"]))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        before = s["total"] + s["group"]
        return (
            F.when(x.isNull(), F.when((before > 0) | s["scaled"], state(zero, zero, F.lit(False), ended(s))).otherwise(s))
            .when(x["scale"], F.when(before > 0, state(before * x["n"], zero, F.lit(True), s["out"])).otherwise(s))
            .when(x["n"] == 100, state(s["total"], F.when(s["group"] > 0, s["group"]).otherwise(1.0) * 100, s["scaled"], s["out"]))
            .otherwise(state(s["total"], s["group"] + x["n"], s["scaled"], s["out"]))
        )

    start = state(zero, zero, F.lit(False), F.array().cast("array<double>"))
    return F.aggregate(F.coalesce(read, F.array().cast(SPELLED)), start, step, ended)


SPELLED = "array<struct<n:double,scale:boolean>>"


def date_of(c: Column) -> Column:
    """A date at the start of a text: ISO, or day and month name."""
    iso = F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    named = lambda pattern, form: F.try_to_timestamp(F.nullif(F.regexp_extract(c, pattern, 0), F.lit("")), F.lit(form)).cast("date")
    return F.coalesce(iso, named("[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}", "MMMM d, yyyy"), named("[0-9]{1,2} [A-Z][a-z]+ [0-9]{4}", "d MMMM yyyy"))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def official(url: Column, allowed: list[str]) -> Column:
    """Whether the host is an allowed domain or under one."""
    h = host(url)
    return F.coalesce(F.exists(F.lit(allowed), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d))), F.lit(False))


def stale(verified: Column, as_of: Column, window: int) -> Column:
    """N15."""
    return F.datediff(as_of, verified) > window
