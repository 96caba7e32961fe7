import pytest

from karst.llm import urls
from karst.llm.queries import ORACLE, URL_RULES, op12_url_filters

ROWS = [
    (1, "http://example.com/en/1"), (2, "https://www.Example.COM/en/2?x=1#y"), (3, "http://m.example.com/fr/3"), (4, "http://spam-farm.example.org/en/9?utm_source=a&b=2&a=1"),
    (5, "http://www.spam-farm.example.org:80/en/9/?a=1&b=2#top"), (6, "ftp://a.net/es/x"), (7, "http://a.net?x"), (8, "http://notexample.com/en/"), (9, None), (10, ""), (11, "no scheme/net/"),
    (12, "http://"), (13, "http:///en/"), (14, "http://com"), (15, "http://x.org/" + "p" * 50000), (None, "http://x.org/a"), (1, "http://example.com/en/1"), (16, "http://x.org/a\nb?c"), (17, "x://y://z.net/"),
]


def brute(rows, rules, listed):
    def parts(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        path = rest[cut:]
        for c in "?#":
            path = path.split(c)[0]
        return rest[:cut].lower(), path

    for page, u in rows:
        host, path = parts(u)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.host + r.path), default=None)
        yield page, host, path, best and best.host + best.path, best.verdict if best else "block" if (page, u) in listed else "allow"


@pytest.mark.parametrize("limits", [{}, {"max_blocks": 1}, {"max_hits": 0}])
def test_same_as_brute_force(spark, limits):
    pages = spark.createDataFrame(ROWS, "page_id long, url string").selectExpr("*", "'a' as rule", "1 as host", "url as canonical")
    got = urls.judge(pages, URL_RULES, urls.reported(pages), **limits)
    assert sorted(map(repr, (tuple(r)[:5] for r in got.collect()))) == sorted(map(repr, brute(ROWS, URL_RULES, {r for r in ROWS if r[0] in (4, 5)})))


def test_one_spelling(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string").select("page_id", urls.canonical(urls.F.col("url")).alias("c"))
    got = {r.page_id: r.c for r in df.collect()}
    assert got[4] == got[5] == "spam-farm.example.org/en/9?a=1&b=2"
    assert got[2] == "example.com/en/2?x=1" and got[7] == "a.net?x"
    assert [got[i] for i in (9, 10, 11, 12, 13)] == [None] * 5


def test_filter_passes_all_listed_and_few_others(spark):
    both = [spark.range(a, a + 5000).selectExpr("concat('h.org/', id) as canonical") for a in (0, 5000)]
    blocks = 5000 * urls.BITS // 512
    bloom = urls.blocked_filter(both[0], blocks)
    assert bloom.count() <= blocks
    assert urls.may_be_listed(both[0], bloom, blocks).count() == 5000
    assert urls.may_be_listed(both[1], bloom, blocks).count() < 150


def test_empty_tables(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string")
    assert urls.judge(pages.limit(0), URL_RULES, urls.reported(pages)).count() == 0
    got = urls.judge(pages, [], urls.reported(pages.limit(0)))
    assert {r.verdict for r in got.collect()} == {"allow"} and got.count() == len(ROWS)


def test_no_python_in_the_plan(spark):
    plan = op12_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "op12_url_filters" in ORACLE
