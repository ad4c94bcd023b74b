import re

import pytest

from leakscan.llm import queries, url_rules as U

FIXED = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fit = [(len(r), r, v) for r, v in FIXED if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://Sub.EXAMPLE.org/es/1", "https://example.org/en/12?x=1#y", "https://example.org", "http://org/", "http://xorg/",
        "http://a.com/fr/x", "http://com/de/", "ftp://ÄB.com/de", "a://b://c/d", "http://h?/org/", "http://cheap-pills.net/buy?id=3", "http://example.org/en/1"] * 2


def test_split_and_fixed_rules(spark):
    df = spark.createDataFrame([(k, u, "clash", None) for k, u in enumerate(URLS)], "page_id bigint, url string, host string, tokens int").select("page_id", "url")
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support double, lift double, head string")
    for r in U.judge(df, U.fixed_rules(spark, FIXED), none).collect():
        h, p = parts(URLS[r.page_id])
        assert (r.host, r.path) == (h, p)
        assert (r.rule, r.verdict) == (lambda x: (x[0], x[1] or "allow"))(rule(h, p))


def test_mined_rules(spark):
    rows = []
    for k in range(600):
        bad = k % 6 == 0
        rows.append((k, f"http://{'www.' if k % 2 else ''}{'cheap' if bad or k % 50 == 1 else 'site'}.net/{'buy' if bad or k % 7 == 3 else 'page'}/{k}", bad if k < 500 else None))
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    rules = U.mine(U.split(df).select("tokens", "bad"), U.Mining(min_confidence=0.9))
    got = [set(r.tokens) for r in rules.collect()]
    labelled = [(set(r.tokens), r.bad) for r in U.split(df).collect() if r.bad is not None]
    assert got and not any(a < b for a in got for b in got)
    for r in rules.collect():
        hit = [b for t, b in labelled if set(r.tokens) <= t]
        assert r.confidence == pytest.approx(sum(hit) / len(hit)) and r.confidence >= 0.9 and r.head in r.tokens
    for r in U.judge(df, U.fixed_rules(spark, FIXED), rules).join(U.split(df).select("page_id", "tokens"), "page_id").collect():
        assert r.verdict == ("block" if any(g <= set(r.tokens) for g in got) else "allow")


def test_no_labels_and_registered_query(spark):
    empty = spark.createDataFrame([], "tokens array<string>, bad boolean")
    assert U.mine(empty).count() == 0
    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op2_url_rules"](spark, sf).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert (r.host, r.path) == parts(pages[r.page_id]) and r.rule == rule(r.host, r.path)[0]
        assert r.rule is None or r.verdict == rule(r.host, r.path)[1]


def test_pages_are_labelled_by_the_number_in_their_url(spark, tmp_path):
    ends = ["", "/", ".html", "?page=2&ref=x", "#top"]
    hosts = {n: "cheap" if n % 5 == 0 else "site" for n in range(400)}
    pages = [(k, f"http://{hosts[k * 7 % 400]}.net/it/{k * 7 % 400}{ends[k // 3 % 5]}") for k in range(400)]
    pages += [(400, "http://cheap.net/it/"), (401, "http://site.net/it/99999999999999999999"), (402, None)]
    labels = [(n, int(hosts[(n * 3 + 1) % 400 if n > 399 else n] != "cheap"), 0) for n in range(403)]
    # page ids in another order, so that the document of the page's own number says nothing
    spark.createDataFrame([((i * 3) % 403, u) for i, u in pages], "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.QUERIES["op2_url_rules"](spark, str(tmp_path)).collect()
    assert len(out) == 403
    assert all(r.verdict == ("block" if r.host == "cheap.net" else "allow") for r in out)
    numbers = U.document_number(spark.createDataFrame([("/en/12.html",), ("/en/7/",), ("/3",), ("/en",), ("",), ("/a9",), ("/99999999999999999999",)], "path string"))
    assert [r.doc_id for r in numbers.collect()] == [12, 7, 3, None, None, None, None]
