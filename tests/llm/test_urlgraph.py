import duckdb

from stratavox.llm import urlgraph
from stratavox.llm.urlgraph import OP3_SQL, RULES, Rule, judge, op3_url_filters
from tests.conftest import SF, SF2

COLUMNS = ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def by_sql(pages):
    return sorted(duckdb.sql(OP3_SQL).select(*COLUMNS).fetchall(), key=str)


def test_query_matches_sql(spark):
    for sf in (SF, SF2):
        duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
        assert rows_of(op3_url_filters(spark, sf)) == by_sql("pages")


def link(*urls):
    return "<p>" + "".join(f'<a href="{u}">x</a> <img src={u}>' for u in urls)


PAGES = [
    (1, "http://a.org/x", link("https://shop.net/", "//SHOP.net/1", "http://bad.net")), (2, "HTTPS://Example.ORG/es/1?q", link("http://farm.net/a")),
    (3, "http://farm.net/", link("http://example.org/es/2")), (4, "http://shop.net", link("http://friend.net")), (5, "http://friend.net/p#f", None),
    (6, None, None), (7, "no address", "//not/a/link"), (8, "x://", ""), (9, "http://example.org/en/1", None), (10, "http://w.example.org/en/2", None),
    (11, "http://exampleXorg/es/", None), (12, "http://myexample.org/es/1", None), (13, "http://org", None), (14, "http://org/", None), (15, "http://u@h.org:80/", None),
    (16, "a://b://c/d", None), (17, "http://ÀB.com/de/ä", None), (18, "http://bad.net/", link("http://example.org/es/3", "http://farm.net")), (1, "http://a.org/x", None),
    (None, "http://fr.com/fr/", link("http://friend.net")), (19, "http://farm.net/b", "<a HREF = 'http://Example.org/es/'>"), (20, "ftp://x.y.z.friend.net/a\nb?c", None),
]


def test_odd_rows_match_sql(spark):
    df = spark.createDataFrame([(*p, 1, 2) for p in PAGES], "page_id long, url string, html string, rule int, said int")
    got = rows_of(judge(df.select("page_id", "url", "html")))
    duckdb.sql("CREATE OR REPLACE TABLE odd (page_id BIGINT, url VARCHAR, html VARCHAR)")
    duckdb.executemany("INSERT INTO odd VALUES (?, ?, ?)", [list(p) for p in PAGES])
    duckdb.sql("CREATE OR REPLACE VIEW pages AS SELECT * FROM odd")
    assert got == by_sql("odd")
    assert rows_of(judge(df)) == got
    found = {r[0]: r for r in got}
    assert found[6][1:3] == ("", "") and found[6][4] == "allow"
    assert found[2][3:5] == ("example.org/es/", "block") and found[9][3] == "example.org/en/1" and found[10][3] == "org/"
    assert found[13][3] is None and found[14][3] == "org/" and found[15][3] is None and found[12][3] == "org/"
    # Who links to blocked pages is distrusted; who is linked to from trusted ones is trusted.
    assert found[5][5] > found[5][6] and found[5][4] == found[4][4] == "allow" and found[3][6] > 0
    assert all(r[4] == ("block" if r[6] > r[5] else "allow") for r in got if r[3] is None)
    assert judge(df.limit(0)).count() == 0


def test_brute_force_rules(spark):
    pages = spark.read.parquet(f"{SF2}/pages.parquet")
    for r in judge(pages).collect():
        fits = [x for x in RULES if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert r.rule == (best.name if best else None)
        assert r.verdict == (best.verdict if best else "block" if r.distrust > r.trust else "allow")


def test_links_to_blocked_pages_block_a_host(spark):
    pages = [(1, "http://x.org/", link("http://good.net/")), (2, "http://farm.net/", link("http://example.org/es/")), (3, "http://example.org/es/1", None), (4, "http://good.net/", None)]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow"}


def judged(spark, pages, rules=RULES):
    return {r.page_id: r for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}


def test_scores_under_their_out_weight_pass_on(spark, monkeypatch):
    """A host with more links than units of score still passes on to those that many of its links go to."""
    monkeypatch.setattr(urlgraph, "UNIT", 1000)
    many = link(*["http://good.net/"] * 300, *[f"http://h{i}.net/" for i in range(1000)])
    got = judged(spark, [(1, "http://x.org/", many), (2, "http://good.net/", None), (3, "http://h1.net/", None)])
    assert got[2].trust > 0 and got[3].trust == 0


def test_seeds_by_the_million_reach_as_far(spark):
    """What three hops pass on does not depend on how many other seeds there are."""
    chain = [(1, "http://a.net/", link("http://b.net")), (2, "http://b.net/", link("http://c.net")), (3, "http://c.net/", link("http://bad.test/"))]
    rules = (Rule("block", "bad.test", "/"),)
    few = judged(spark, [*chain, (4, "http://bad.test/", None)], rules)
    seeds = spark.range(1_000_000).selectExpr("id + 10 AS page_id", "concat('http://bad.test/', id) AS url", "CAST(NULL AS STRING) AS html")
    many = {r.page_id: r for r in judge(spark.createDataFrame([*chain], "page_id long, url string, html string").union(seeds), rules).where("page_id < 4").collect()}
    assert [few[k].verdict for k in (1, 2, 3)] == [many[k].verdict for k in (1, 2, 3)] == ["block"] * 3
    assert all(abs(few[k].distrust - many[k].distrust) <= 10 for k in (1, 2, 3))


def test_a_public_suffix_joins_no_strangers(spark):
    rules = (Rule("block", "bad.co.uk", "/"), Rule("block", "10.0.0.1", "/"))
    pages = [(1, "http://bad.co.uk/", None), (2, "http://good.co.uk/", None), (3, "http://shop.example.net/", None), (4, "http://example.net/", link("http://bad.co.uk/")), (5, "http://10.0.0.1/", None), (6, "http://9.0.0.1/", None), (7, "http://0.0.1/", None)]
    got = judged(spark, pages, rules)
    assert {k: got[k].verdict for k in got} == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow"}


def test_joins_without_sending_scores(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sent = rows_of(judge(pages))
    monkeypatch.setattr(urlgraph, "MAX_SENT", 0)
    assert rows_of(judge(pages)) == sent


def test_without_rules_all_are_allowed(spark):
    out = judge(spark.createDataFrame(PAGES, "page_id long, url string, html string"), (Rule("block", "nowhere.test", "/"),))
    assert {r.verdict for r in out.collect()} == {"allow"}


def test_only_dataframe_functions(spark):
    plan = op3_url_filters(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
