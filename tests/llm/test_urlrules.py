"""URL rules against a loop over all rules."""

import random
import re

from civitally.config import Skew
from civitally.llm import urlrules

PAGES = "page_id bigint, url string, html string"
URLS = [
    None, "", "no scheme.example.org/es/", "http://", "://example.org/es/", "http://example.org",
    "HTTP://A.Example.ORG/es/x", "https://example.org/es/?q=1", "https://example.org/es",
    "https://x.y.example.org/en/12#a", "https://badexample.org/es/", "http://org/", "http://.org/x",
    "https://a.com/fr/", "https://a.com/fr", "https://a.com?x=/de/", "http://b.com/de/y?z",
    "http://b.com/DE/", "http://example.org/en/1://a.com/de/", "http://a.org./es/", "http://é.org/é",
    "http://a..org/x", "http://org#/es/", "http://a.b.c.d.e.f.g.com/de/" + "x" * 5000,
]


def parts(url):
    rest = (url or "").split("://", 1)
    found = re.match(r"([^/?#]*)([^?#]*)", rest[1] if len(rest) == 2 else "", re.S)
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in found[1])
    return lower, found[2]


def plain(url, rules, default="allow"):
    host, path = parts(url)
    best = None
    for verdict, rule in rules:
        if rule is None or not rule.split("/")[0]:
            continue
        at = rule.find("/") if "/" in rule else len(rule)
        h, p = rule[:at], rule[at:]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(rule), len(h), verdict == "block", verdict, rule))
    return (host, path, best[4], best[3]) if best else (host, path, None, default)


def judged(pages, rules, **options):
    return sorted(map(tuple, urlrules.judge(pages, rules, **options).collect()), key=str)


def test_urls_of_all_kinds(spark):
    rows = [(i, u, "<p>") for i, u in enumerate(URLS)] + [(None, URLS[9], None), (3, URLS[3], "")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr(
        "*", "1 as host", "'x' as rule", "2 as row", "3 as key", "'v' as verdict", "0 as path")
    want = sorted(((i, *plain(u, urlrules.RULES)) for i, u, _ in rows), key=str)
    rules = urlrules.rule_table(spark, urlrules.RULES)
    assert judged(pages, rules) == want
    assert {w[4] for w in want} == {"allow", "block"} and len({w[3] for w in want}) == 6
    assert judged(pages.limit(0), rules) == []
    none = judged(pages, rules.limit(0), default="block")
    assert {(r[3], r[4]) for r in none} == {(None, "block")} and len(none) == len(rows)


def test_nested_and_equal_rules(spark):
    rules = [("allow", "com"), ("block", "com/a"), ("allow", "com/a/b"), ("block", "com/a/b/c"),
             ("allow", "x.com"), ("block", "x.com/a/"), ("allow", "x.com/a/"), ("block", None),
             ("block", "/a"), ("block", ""), ("allow", "y.x.com/a/b/c/d")]
    urls = [f"http://{h}/{p}" for h in ("com", "x.com", "y.x.com", "z.y.x.com", "xcom", "net")
            for p in ("", "a", "a/", "a/b", "a/b/c", "a/b/c/d", "b", "a/bc")]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)
    want = sorted(((i, *plain(u, rules)) for i, u in enumerate(urls)), key=str)
    assert judged(pages, urlrules.rule_table(spark, rules)) == want


def test_hot_hosts_are_salted(spark):
    rng = random.Random(1)
    hosts = ["a.com"] * 5 + ["b.a.com", "c.com", "d.org", "com"]
    word = lambda: "".join(rng.choices("ab/", k=rng.randrange(6)))
    rules = list({f"{rng.choice(hosts)}/{word()}": None for _ in range(80)})
    rules = [(rng.choice(["allow", "block"]), r) for r in rules]
    rows = [(i, f"http://{rng.choice(hosts)}/{word()}", "") for i in range(600)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    want = sorted(((i, *plain(u, rules)) for i, u, _ in rows), key=str)
    table = urlrules.rule_table(spark, rules)
    assert judged(pages, table, skew=Skew(hot_rows=20)) == judged(pages, table) == want


def test_no_python_on_the_path(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "")], PAGES)
    plan = urlrules.judge(pages, urlrules.rule_table(spark, urlrules.RULES))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "InArrow" not in text and "CartesianProduct" not in text
