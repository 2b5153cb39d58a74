"""s24 and s14 read the pages' own html."""

from caseloom.plans import registry


def test_own_html_is_read(spark, tmp_path):
    link = '<a href="own.pdf">Own</a> of 2020-05-06'
    row = '<div class="views-row"><a href="/own">Own</a><time>2020-05-06</time><span class="type">Merger</span></div>'
    rows = [(3, "u", link + row), (6, "v", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    s24 = {tuple(r) for r in registry.QUERIES["s24_dated_links"](spark, str(tmp_path)).select("page_id", "url").collect()}
    assert s24 >= {(3, "own.pdf"), (3, "d3.pdf"), (6, "d6.pdf")}
    s14 = {tuple(r) for r in registry.QUERIES["s14_listing_rows"](spark, str(tmp_path)).select("page_id", "url").collect()}
    assert s14 == {(3, "/own")}
