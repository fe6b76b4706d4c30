from collections import Counter
from itertools import combinations

from tidewatch.llm import queries, url_rules

SF = "/root/testdata/sf0.01"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:stop]


def listed(host, path):
    fits = [r for r in url_rules.LIST if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0]) + len(r[1]), default=None)


def tokens(host, path):
    def fold(prefix, items, depth, glue):
        if len(items) >= depth:
            items = items[: depth - 1] + [glue.join(items[depth - 1 :])]
        return {f"{prefix}{i}:{x}" for i, x in enumerate(items)}

    hosts = [x for x in host.split(".")[::-1] if x]
    return fold("h", hosts, url_rules.HOST_DEPTH, ".") | fold("p", [x for x in path.split("/") if x], url_rules.PATH_DEPTH, "/")


def brute(urls):
    rows = [(*parts(u), listed(*parts(u))) for u in urls]
    labelled = [(tokens(h, p), r[2]) for h, p, r in rows if r]
    with_verdict, alone = Counter(), Counter()
    for items, verdict in labelled:
        for size in range(1, len(items) + 1):
            for some in combinations(sorted(items), size):
                alone[some] += 1
                with_verdict[some, verdict] += 1
    rules = [
        (some, verdict, n / alone[some], n)
        for (some, verdict), n in with_verdict.items()
        if n >= url_rules.MIN_SUPPORT * len(labelled) and n / alone[some] >= url_rules.MIN_CONFIDENCE
    ]
    out = []
    for host, path, rule in rows:
        if rule:
            out.append((host, path, rule[0] + rule[1], rule[2]))
            continue
        own = tokens(host, path)
        hits = [(c, n, v == "block") for some, v, c, n in rules if own.issuperset(some)]
        out.append((host, path, None, "block" if hits and max(hits)[2] else "allow"))
    return out


def test_query_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    expected = dict(zip([p["page_id"] for p in pages], brute([p["url"] for p in pages]), strict=True))
    found = queries.QUERIES["op7_url_rules"](spark, SF).collect()
    assert len(found) == len(pages)
    wrong = [(r, expected[r["page_id"]]) for r in found if tuple(r[1:]) != expected[r["page_id"]]]
    assert wrong == []


def test_parts_of_odd_urls(spark):
    urls = [None, "", "example.com/en/", "HTTP://WWW.Example.COM/en/x?y#z", "a://b://c/d", "x://h#f/../", "x://?q", "ftp://ÀB.com", "x://net/es/", "x://com", "x://h/" + "a/" * 5000, "x://a\nb.com/c"]
    rows = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] * 2, "page_id long, url string, verdict string")
    found = url_rules.judge(rows).collect()
    assert len(found) == 2 * len(urls)
    for row in found:
        host, path = parts(urls[row["page_id"]])
        rule = listed(host, path)
        assert (row["host"], row["path"]) == (host, path)
        assert row["rule"] == (rule[0] + rule[1] if rule else None)
        assert row["verdict"] in ("allow", "block") and (rule is None or row["verdict"] == rule[2])


def test_empty_and_unlabelled(spark):
    empty = spark.createDataFrame([], "page_id long, url string, link string")
    assert url_rules.judge(empty).collect() == []
    rows = spark.createDataFrame([(1, "x://org/a", "keep")], "page_id long, url string, link string")
    (row,) = url_rules.judge(rows).collect()
    assert (row["verdict"], row["link"], row["rule"]) == ("allow", "keep", None)
