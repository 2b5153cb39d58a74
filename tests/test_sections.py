"""Heading paths, chunk selection, section texts, page ranking and repair on literal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from caseloom.operators import pages as P
from caseloom.operators import rest, sections


def paths(spark, pages, **how):
    d = spark.createDataFrame(pages, "doc_id long, page_number int, text string")
    return {(r.doc_id, r.page_number): r.path for r in sections.heading_paths(d, **how).collect()}


def test_heading_paths_equal_the_stack(spark):
    rng = random.Random(6)
    pages, want = [], {}
    for doc in range(3):
        stack = []
        for page in range(1, 60):
            lines = []
            for _ in range(rng.randint(0, 3)):
                number = ".".join(str(rng.randint(1, 9)) for _ in range(rng.randint(1, 4)))
                lines += [f"{number} Title {page}", "plain words"]
                depth = number.count(".") + 1
                stack = [s for s in stack if s[0] < depth] + [(depth, f"{number} Title {page}")]
            pages.append((doc, page, "\n".join(lines) if lines else rng.choice(["words", "", None])))
            want[doc, page] = " > ".join(s[1] for s in stack)
    rng.shuffle(pages)
    assert paths(spark, pages) == want
    assert paths(spark, [(1, 1, "no"), (1, 2, None)]) == {(1, 1): "", (1, 2): ""}


def test_numbered_lines_that_are_no_headings(spark):
    lines = ["8. Market definition", "8.1 Form CO, paragraph 5", "8.2 " + "Long " * 20, "99.1 Foot note", "8.3 Abc", "8.4 In the past", "8.5 Online advertising", "2011.309 Report"]
    assert paths(spark, [(1, 1, "\n".join(lines))], fits=sections.is_heading) == {(1, 1): "8 Market definition > 8.5 Online advertising"}


def test_many_headings_of_one_document(spark):
    d = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page_number"), F.expr("concat(if(id % 10 = 0, '1', '1.2'), ' Title')").alias("text"))
    got = sections.heading_paths(d).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in got} == {"1 Title": 10_000, "1 Title > 1.2 Title": 90_000}


def selection(spark, chunks, fallback, **how):
    c = spark.createDataFrame([(1, f"c{i}", focus, pages) for i, (focus, pages) in enumerate(chunks)], "doc_id long, chunk string, focus boolean, page_numbers array<int>")
    f = spark.createDataFrame([(1, i, pages) for i, pages in enumerate(fallback, 1)], "doc_id long, rank int, page_numbers array<int>")
    return [(r.chunk, r.first_page, r.pages) for r in sorted(sections.covering_selection(c, f, **how).collect(), key=lambda r: (r.first_page, r.chunk))]


def test_selection_covers_new_pages_under_a_budget(spark):
    chunks = [(True, [1, 2, 3]), (False, [4, 5, 6, 7]), (True, [8])]
    fallback = [[2, 3], [3, 4], [4], [6, 7]]
    how = {"least_pages": 5, "large": 100, "budget": 80}
    assert selection(spark, chunks, fallback, **how) == [("c0", 1, 3), ("fallback_002", 3, 2), ("fallback_004", 6, 2), ("c2", 8, 1)]
    assert selection(spark, chunks, fallback, **how | {"least_pages": 4}) == [("c0", 1, 3), ("c2", 8, 1)]
    assert selection(spark, chunks, fallback, **how | {"budget": 6}) == [("c0", 1, 3), ("fallback_002", 3, 2)]
    assert selection(spark, chunks, fallback, **how | {"groups": 3}) == [("c0", 1, 3), ("fallback_002", 3, 2), ("c2", 8, 1)]
    # a large document: the share counts too, and twice the groups are gone through
    large = how | {"least_pages": 1, "large": 8, "groups": 2}
    assert selection(spark, chunks, fallback, **large, share=0.5) == [("c0", 1, 3), ("c2", 8, 1)]
    assert selection(spark, chunks, fallback, **large, share=0.51) == [("c0", 1, 3), ("fallback_002", 3, 2), ("fallback_004", 6, 2), ("c2", 8, 1)]


def test_selection_without_focus_takes_the_fallback(spark):
    assert selection(spark, [(False, [1, 2, 3])], [[2], [2, 3], [1]], groups=2, budget=1) == [("fallback_001", 2, 1), ("fallback_002", 2, 2)]
    assert selection(spark, [(False, [1, 2, 3])], []) == []


def sub(number, prefix):
    return number == prefix or number.startswith(prefix + ".")


def plain_section(pages, spill, prefix):
    """Own pages and spill of a section by a walk over headings."""
    heads = lambda t: [(m.start(), m.group(1)) for m in re.finditer(sections.SECTION_HEADING, t, re.M)]
    out = []
    for part, rows in (("own", pages), ("spill", spill)):
        for i, (n, text) in enumerate(rows):
            start = next((at for at, x in heads(text) if sub(x, prefix)), 0) if i == 0 and part == "own" else 0
            end = next((at for at, x in heads(text) if at >= start and not sub(x, prefix)), None)
            if end is None:
                out.append((n, part, text[start:]))
                continue
            if text[start:end].rstrip():
                out.append((n, part, text[start:end].rstrip()))
            break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_section_texts_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    bits = ["8.6 Online ads", "8.6.1 Search", "8.60 Other", "8.7 Next", "words of it", "more  ", "", "8.6. Dotted", "\t"]
    pages, targets, want = [], [], []
    n = 0
    docs = {}
    for chunk in range(12):
        docs[chunk] = []
        for _ in range(rng.randint(1, 3)):
            n += 1
            docs[chunk].append((n, "\n".join(rng.choices(bits, k=rng.randint(1, 5)))))
        pages += [(1, chunk, *p) for p in docs[chunk]]
    for chunk in range(12):
        targets.append((1, chunk, "8.6"))
        want += [(chunk, *r) for r in plain_section(docs[chunk], docs.get(chunk + 1, []), "8.6")]
    got = sections.section_texts(spark.createDataFrame(pages, "doc_id long, chunk int, page_number int, text string"), spark.createDataFrame(targets, "doc_id long, chunk int, prefix string"))
    assert sorted((r.chunk, r.page_number, r.part, r.text) for r in got.collect()) == sorted(want)


def test_section_texts_lead_trail_and_spill(spark):
    pages = [(1, 1, 1, "tail of 8.5\n8.6 Ads\nfirst"), (1, 1, 2, "on\n8.7 Next\nnot this"), (1, 1, 3, "gone"), (1, 2, 3, "spilt\n8.7 Next\nno"), (1, 3, 4, "8.3 Sibling\nnone")]
    d = spark.createDataFrame(pages, "doc_id long, chunk int, page_number int, text string")
    t = spark.createDataFrame([(1, 1, "8.6"), (1, 3, "8.2"), (1, 2, "")], "doc_id long, chunk int, prefix string")
    got = sorted((r.chunk, r.part, r.page_number, r.text) for r in sections.section_texts(d, t).collect())
    assert got == [(1, "own", 1, "8.6 Ads\nfirst"), (1, "own", 2, "on"), (1, "spill", 3, "spilt"), (2, "own", 3, "spilt\n8.7 Next\nno")]


def ranked(spark, pages, **how):
    prop = how.pop("prop", (1, 1, ["fitness", "tracker"], ["market", "sub"], "Fitness trackers"))
    p = spark.createDataFrame([prop], "prop_id long, doc_id long, keywords array<string>, kinds array<string>, name string")
    d = spark.createDataFrame([(1, n, t, path) for n, (t, path) in enumerate(pages, 1)], "doc_id long, page_number int, text string, path string")
    return [(r.page_number, r.score) for r in sorted(P.candidate_pages(p, d, **how).collect(), key=lambda r: r["rank"])]


def test_each_term_changes_the_order_of_pages(spark):
    two = [("A fitness page of words", ""), ("Fitness, and a TRACKER", "")]
    assert ranked(spark, two) == [(2, 2), (1, 1)]
    assert ranked(spark, two, bonus=[("market", "of words", 3), ("other", "and", 9)]) == [(1, 7), (2, 2)]
    assert ranked(spark, two, bonus=[("sub", "a fitness", 1)]) == [(1, 3), (2, 2)]
    assert ranked(spark, two, penalty=[("market", "and a", 1)]) == [(1, 1), (2, 0)]
    assert ranked(spark, [(two[0][0], "8.1 Fitness things"), (two[1][0], "")]) == [(1, 7), (2, 2)]
    assert ranked(spark, [(two[0][0], "8.1 Fitness trackers"), (two[1][0], "8.1 Fitness")])[0] == (1, 13)
    assert ranked(spark, [(two[0][0], ""), (two[1][0], "8.1 Health data")]) == [(1, 1), (2, -4)]
    assert ranked(spark, [(two[0][0], ""), (two[1][0], "8 Big > 8.1 Health data")], bonus=[("market", "and a", 50)]) == [(1, 1), (2, -8)]


def test_contents_and_pages_without_keywords_are_left_out(spark):
    pages = [("fitness ....... 1\nb ..... 2\nc ...... 3\nd ..... 4", ""), ("nothing", ""), (None, ""), ("fitnesses", None)]
    assert ranked(spark, pages) == [(4, 1)]
    assert ranked(spark, pages, prop=(1, 1, [], None, None)) == []
    assert ranked(spark, [("fitness", "")] * 7) == [(n, 1) for n in range(1, 6)]


def test_new_passages_take_free_numbers(spark):
    have = spark.createDataFrame([(1, "sp_1"), (1, "x"), (1, "sp_4"), (1, "sp_6"), (2, "sp_2"), (2, "sp_02"), (4, None)], "case_id long, passage_id string")
    rows = [(1, "m1", "product_market", "d", 3, "q", 1), (1, "t1", "theory_of_harm", "d", 4, "q", 2), (1, "g1", "geographic_market", "d", 5, "q", 3), (2, "m", "product_market", "d", 1, "q", 1), (3, "m", "product_market", "d", 1, "q", 1), (3, "n", "product_market", "d", 1, "", 2), (3, "o", "product_market", None, 1, "q", 3)]
    got = {(r.case_id, r.passage_id): r for r in rest.added_passages(have, spark.createDataFrame(rows, "case_id long, prop_id string, kind string, doc_id string, page int, quote string, order int")).collect()}
    assert set(got) == {(1, "sp_5"), (1, "sp_7"), (1, "sp_8"), (2, "sp_3"), (3, "sp_1")}
    assert got[1, "sp_5"].supports_markets == ["m1"] and got[1, "sp_5"].supports_theories == [] and got[1, "sp_7"].supports_theories == ["t1"] and got[1, "sp_8"].supports_geographic_markets == ["g1"]
    assert got[1, "sp_5"].confidence == 0.7 and got[1, "sp_5"].review == "unreviewed" and got[1, "sp_5"].page == "3"
