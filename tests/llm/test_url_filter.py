import random
from datetime import datetime, timedelta

from compare import assert_same

from lorewright.llm import registry, url_filter as u

SF = "/root/testdata/sf0.01"
T0 = datetime(2024, 1, 1)


def test_oracle(spark):
    assert_same(registry.op9_url_filter(spark, SF), u.oracle_sql(), SF)


def frames(spark, captures, log):
    c = spark.createDataFrame([(i, url, None if t is None else T0 + timedelta(days=t)) for i, (url, t) in enumerate(captures)], "page_id bigint, url string, fetch_time timestamp")
    e = spark.createDataFrame([(d, p, k, T0 + timedelta(days=t), a) for d, p, k, t, a in log], "domain string, path string, category string, at timestamp, action string")
    return c, e


def test_times(spark):
    log = [("bad.com", "", "x", 1, "add"), ("bad.com", "", "x", 3, "remove"), ("bad.com", "", "x", 5, "add"), ("bad.com", "", "x", 5, "remove"), ("sub.ok.org", "/p/", "y", 0, "add"), ("never.com", "", "z", 2, "remove"), ("twice.com", "", "w", 1, "add"), ("twice.com", "", "w", 2, "add"), ("twice.com", "", "w", 3, "remove")]
    captures = [("http://bad.com/", 0), ("http://bad.com/", 1), ("http://www.bad.com:80/a", 2), ("http://bad.com/", 3), ("http://bad.com/", 9), ("http://notbad.com/", 2), ("https://u@a.SUB.ok.org./p/q?x", 1), ("https://sub.ok.org/other", 1), ("http://never.com/", 5), (None, 1), ("nonsense", 1), ("http://bad.com/", None), ("http://twice.com/", 2)]
    c, e = frames(spark, captures, log)
    got = {r.page_id: r.blocked for r in u.evaluate(c, e).collect()}
    assert [got[i] for i in range(len(captures))] == [False, True, True, False, True, False, True, False, False, False, False, False, True]
    assert not u.evaluate(c, e.limit(0)).where("blocked").count() and u.evaluate(c.limit(0), e).count() == 0
    assert u.evaluate(c.union(c), e).count() == 2 * len(captures)
    assert u.evaluate(c.selectExpr("*", "1 AS domain", "2 AS path", "3 AS category", "4 AS _n"), e).where("blocked").count() == 5


def test_against_replay(spark):
    r = random.Random(1)
    log = [(f"{r.choice('abc')}.com", "", r.choice("xy"), r.randrange(30), r.choice(["add", "remove"])) for _ in range(120)]
    captures = [(f"http://{r.choice(['', 'www.', 'm.x.'])}{r.choice('abcd')}.com/", r.randrange(32)) for _ in range(200)]
    c, e = frames(spark, captures, log)
    got = {x.page_id: x.categories for x in u.evaluate(c, e).collect()}
    for i, (url, t) in enumerate(captures):
        host = url.split("/")[2]
        active = set()
        for d, _, k, when, action in sorted(log, key=lambda x: (x[3], x[4] == "add")):
            if when <= t and (host == d or host.endswith("." + d)):
                (active.add if action == "add" else active.discard)(k)
        assert got[i] == ",".join(sorted(active))


def test_one_host_in_every_row_and_long_hosts(spark):
    log = [("hot.com", "", "x", 1, "add"), ("org", "", "tld", 0, "add")]
    long = "a." * 60_000 + "hot.com"
    captures = [("http://hot.com/p", 2)] * 3000 + [(f"http://{long}/", 2), ("http://any.org", 1), ("http://" + "x" * 300_000 + ".org/", 1), ("http://com/", 3)]
    c, e = frames(spark, captures, log)
    got = {x.page_id: x.categories for x in u.evaluate(c, e).collect()}
    assert [got[i] for i in (0, 2999, 3000, 3001, 3002, 3003)] == ["x", "x", "x", "tld", "tld", ""]


def test_unlisted_suffixes_meet_no_list(spark):
    """Only suffixes with as many labels as a listed domain are looked up, so none of ``com`` or ``org``."""
    c, e = frames(spark, [("http://a.b.bad.com/", 2), ("http://com/", 2)], [("bad.com", "", "x", 1, "add"), ("w.x.y.z", "", "y", 1, "add")])
    hosts = c.select(u.host_of(c.url).alias("_host"))
    assert [(x._host, [r.domain for r in x._rules]) for x in u.host_rules(hosts, u.intervals(e)).collect()] == [("a.b.bad.com", ["bad.com"])]
