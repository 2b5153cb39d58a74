"""Each registered query with SQL gives the rows of that SQL in DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from caseloom.plans import registry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def connect(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    want = connect(sf).sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_gates_add_discounts_in_the_order_of_the_table(spark, tmp_path):
    """Means on a mark as the SQL has them in one thread, over two files; a mean of no values and a missing key too."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE l AS SELECT k AS l_orderkey, (hash(k, n) % 11)::INT / 100 AS l_discount, 'N' AS l_returnflag, n FROM range(3000) a(k), range(7) b(n)")
    con.execute("INSERT INTO l SELECT NULL, x, 'N', n FROM (VALUES (0.01, 0), (0.05, 1), (0.03, 2)) v(x, n) UNION ALL SELECT -1, NULL, 'N', n FROM range(2) c(n)")
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for part, rows in (("a", "n < 3"), ("b", "n >= 3")):
        con.execute(f"COPY (SELECT l_orderkey, l_discount::DOUBLE AS l_discount, l_returnflag FROM l WHERE {rows} ORDER BY n, l_orderkey) TO '{folder}/{part}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    got = registry.QUERIES["a36_evaluation_gate"](spark, str(tmp_path))
    want = con.execute(registry.ORACLES["a36_evaluation_gate"]).fetchall()
    assert rows_of(got.columns, got.collect()) == rows_of(["case_id", "gate"], want)


def test_gold_form_keeps_the_signs_of_a_text_as_its_sql_does(spark, tmp_path):
    """Blank texts, typographic and compatibility signs, blanks beyond ASCII, accents apart, letters whose lower case depends on the engine."""
    texts = ["", "  ", "\n\t", "plain  Text", "a-\n b", "Ünï", "co\u00adop", "“A” – ‘b’ — c‐d", "ﬁrm ½ ™", "\u00a0A\u00a0b\u3000", "e\u0301 E\u0300", "İstanbul ΟΔΟΣ ΑΣ", "a\x0bb\x0c", "\u1680", "|x", None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    got = registry.QUERIES["t03_gold_form"](spark, str(tmp_path))
    want = con.execute(registry.ORACLES["t03_gold_form"]).fetchall()
    assert rows_of(got.columns, got.collect()) == rows_of(["doc_id", "form"], want)
