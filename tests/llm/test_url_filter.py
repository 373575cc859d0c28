import datetime as dt

from plumbline.llm.queries import ORACLE_SQL, QUERIES
from plumbline.llm.url_filter import filter_urls, intervals

DAY = dt.date(2024, 1, 1)
ENTRIES = "kind string, list string, pattern string, action string, at date, n_block int"


def day(n):
    return DAY + dt.timedelta(n)


def test_as_of_join_with_edges(spark):
    entries = spark.createDataFrame([
        ("domain", "block", "bad.com", "add", day(10), 1), ("domain", "block", "bad.com", "remove", day(20), 1), ("domain", "block", "bad.com", "add", day(30), 1), ("domain", "block", "bad.com", "add", day(30), 1),
        ("domain", "allow", "ok.BAD.com", "add", day(12), 1), ("url", "block", "http://fine.org/x", "add", day(5), 1), ("domain", "block", None, "add", day(1), 1), ("domain", "block", "x.y", "add", None, 1),
        ("domain", "block", "[2001:DB8::1]", "add", day(3), 1), ("domain", "block", "tie.com", "add", day(3), 1), ("domain", "block", "tie.com", "remove", day(3), 1),
    ], ENTRIES)
    cases = [
        (1, "http://bad.com/", day(9), "unlisted"), (2, "http://bad.com/", day(10), "blocked"), (3, "https://user:pw@www.BAD.com:8080/p?q", day(19), "blocked"), (4, "http://bad.com", day(20), "unlisted"), (5, "http://bad.com", day(99), "blocked"),
        (6, "http://ok.bad.com/", day(15), "allowed"), (7, "http://ok.bad.com/", day(11), "blocked"), (8, "http://notbad.com/", day(15), "unlisted"), (9, "http://fine.org/x", day(5), "blocked"), (10, "http://fine.org/y", day(5), "unlisted"),
        (11, None, day(15), "unlisted"), (12, "", day(15), "unlisted"), (13, "http://bad.com", None, "unlisted"), (14, "http://tie.com/", day(3), "unlisted"), (15, "http://bad.com./", day(15), "blocked"), (15, "http://bad.com./", day(15), "blocked"),
        (16, "http://[2001:db8::1]:80/x", day(15), "blocked"), (17, "http://[2001:db8::2]/", day(15), "unlisted"), (18, "http://fine.org/" + "x" * 100_000, day(15), "unlisted"),
    ]
    captures = spark.createDataFrame([(i, u, d, "clash") for i, u, d, _ in cases], "page_id long, url string, fetched date, verdict string")
    got = filter_urls(captures, entries).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == sorted((i, v) for i, *_, v in cases)


def test_empty_sides(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", DAY)], "page_id long, url string, fetched date")
    none = spark.createDataFrame([], ENTRIES)
    assert [r.verdict for r in filter_urls(captures, none).collect()] == ["unlisted"]
    assert filter_urls(captures.limit(0), none).count() == 0 and intervals(none).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = QUERIES["op2_url_filters"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query(same):
    same(QUERIES["op2_url_filters"], ORACLE_SQL["op2_url_filters"])
