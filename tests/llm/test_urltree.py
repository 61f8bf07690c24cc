"""URL filters against a plain version of the rules, and the tree on small cases."""

import re

import pytest

from tidelog.llm import queries, urltree

URLS = [
    "http://A.Example.com/en/1?x=/fr/", "https://www.example.com/en/2#a", "http://m.www.example.com/en/", "ftp://example.com", "http://badexample.com/en/1",
    "http://net/es/x", "http://x.net/fr/", "http://x.net/fr", "http://x.org/en/5", "nothing", None, "", "://", "http://?q", "http://ÀB.org/É", "http://x.net/es/1", "http://x.net/es/1",
    "http://x.org/" + "a/" * 40, "http://u@x.com:80/p", "a://b://c.com/en/",
]


def plain(url):
    i = url.find("://") if url else -1
    if i < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url[i + 3 :], re.S)
    return "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]


def plain_rule(host, path):
    fits = []
    for verdict, rule in queries.URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, u, "html", "t", 1.0) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, template string, purity double")
    return {r.page_id: r for r in urltree.judge(pages, queries.URL_RULES).collect()}


def test_hosts_paths_and_rules(judged):
    assert len(judged) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain(u)
        rule, verdict = plain_rule(host, path)
        assert (judged[i].host, judged[i].path, judged[i].rule) == (host, path, rule), u
        assert judged[i].verdict in ("allow", "block")
        if rule:
            assert judged[i].verdict == verdict


def test_variable_segments_become_wildcards_and_labels_decide(spark):
    rows = [(f"http://h.org/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/photo", "block" if i % 7 else None) for i in range(60)]
    rows += [(f"http://h.org/news/{i}.html", "allow") for i in range(60)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, said_by_hand string")
    out = urltree.judge(pages, label="said_by_hand").collect()
    assert {r.template for r in out} == {"/user/*/photo", "/news/{n}.html"}
    assert {(r.template, r.verdict) for r in out} == {("/user/*/photo", "block"), ("/news/{n}.html", "allow")}


def test_empty_table(spark):
    assert urltree.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


@pytest.mark.parametrize("heavy, other", [("block", "allow"), ("allow", "block")])
def test_a_heavy_branch_does_not_judge_pages_seen_once(spark, heavy, other):
    rows = [("http://h.org/spam/page", heavy)] * 900 + [(f"http://h.org/once-{chr(97 + k)}/page", None) for k in range(9)]
    rows += [("http://else.net/page", other)] * 2700
    rows += [("http://h.org/unlike/page", other)] * 30
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, said_by_hand string")
    found = {(r.host, r.path, r.template, r.verdict) for r in urltree.judge(pages, label="said_by_hand").collect()}
    assert {x[2:] for x in found if x[1] == "/spam/page"} == {("/spam/page", heavy)}
    assert {x[2:] for x in found if x[1].startswith("/once")} == {("/*/page", other)}
    assert {x[2:] for x in found if x[1] == "/unlike/page"} == {("/unlike/page", other)}


def test_values_of_a_variable_that_come_again_are_one_template(spark):
    rows = [f"http://h.org/user/name{chr(97 + k % 26)}{chr(97 + k // 26)}/photo" for k in range(200)] * 3
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    assert {r.template for r in urltree.judge(pages).collect()} == {"/user/*/photo"}


def test_the_tree_is_as_deep_as_the_paths(spark):
    deep = "/".join(f"s{k}" for k in range(30))
    rows = [(f"http://h.org/{deep}/name{chr(97 + k % 26)}{chr(97 + k // 26)}/end", "block") for k in range(40)]
    rows += [("http://h.org/" + "x/" * 300, None), ("http://h.org/s0/s1", None), ("http://h.org", None), (None, "allow")]
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, said_by_hand string")
    found = {r.page_id: r for r in urltree.judge(pages, label="said_by_hand").collect()}
    assert len(found) == len(rows)
    assert {found[k].template for k in range(40)} == {f"/{deep}/*/end"} and {found[k].verdict for k in range(40)} == {"block"}
    assert found[40].template == "/x" * 300 + "/{/}" and found[41].template == "/s0/s1" and found[42].template == ""
