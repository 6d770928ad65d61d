import duckdb
from pyspark.sql import functions as F

from lineweave.llm import url_templates as U

SCHEMA = "page_id long, url string, html string, host string, n string, template string, verdict string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def oracle(path_or_df):
    con = duckdb.connect()
    if isinstance(path_or_df, str):
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path_or_df}')")
    else:
        table = path_or_df.toArrow()
        con.register("pages", table)
    return sorted(con.execute(U.op6_sql()).fetchall(), key=str)


def test_sql_says_the_same(spark):
    found = U.op6_url_templates(spark, "/root/testdata/sf0.01")
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "template"]
    assert rows_of(found) == oracle("/root/testdata/sf0.01/pages.parquet")




def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://COM", "http://Example.COM/en/1?x=/en/", "https://www.example.com/en/", "http://notcom/a", "x://a.net/fr/", "x://net/es/#a", "x://net#/es/", "a://b://c.com/d", "http://y.org/" + "s/" * 5000, "http://é.com/ü/9", "http://a.com/\nx"]
    urls += [f"http://shop.org/item/slug{chr(97 + i)}x/reviews" for i in range(20)] * 2 + [f"http://shop.net/es/{i}" for i in range(9)]
    rows = [(i, u, None, "clash", "1", "t", "v") for i, u in enumerate(urls)] + [(3, "http://", None, None, None, None, None), (None, "http://q.com/", None, None, None, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA)
    found = {r.page_id: r for r in U.filter_urls(pages).collect()}
    got = lambda i: (found[i].host, found[i].path, found[i].rule, found[i].verdict if found[i].rule else None)
    assert got(0) == got(1) == got(2) == ("", "", None, None)
    assert got(4) == ("com", "", None, None)
    assert got(5) == ("example.com", "/en/1", "example.com/en/", "block")
    assert got(6) == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got(7) == ("notcom", "/a", None, None)
    assert got(8) == ("a.net", "/fr/", "net/fr/", "block")
    assert got(9) == ("net", "/es/", "net/es/", "block")
    assert got(10) == ("net", "", None, None)
    assert got(11) == ("b:", "//c.com/d", None, None)
    assert found[15].template == "/item/*/reviews"
    assert {r.verdict for r in found.values()} == {"allow", "block"}
    assert rows_of(U.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "template")) == oracle(pages)
    assert U.filter_urls(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python(spark):
    plan = U.op6_url_templates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_purity_follows_labels(spark):
    """Hosts without rules take over what the same template has elsewhere."""
    rows = [(i, f"http://a.net/es/{i}/", None, "", "", "", "") for i in range(30)] + [(100 + i, f"http://b.com/news/{i}", None, "", "", "", "") for i in range(30)]
    rows += [(200, "http://c.org/es/7/", None, "", "", "", ""), (201, "http://c.org/news/7", None, "", "", "", "")]
    found = {r.page_id: r.verdict for r in U.filter_urls(spark.createDataFrame(rows, SCHEMA)).where(F.col("page_id") >= 200).collect()}
    assert found == {200: "block", 201: "allow"}
