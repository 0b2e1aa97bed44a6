"""Url filters against a plain version, on planted labels and on odd urls."""

import itertools
import re

from tidemark.llm import url_filters as U

ODD = [
    (1, "http://Shop.Example.COM/en/1"), (2, "https://www.example.com/en/2?x=1"), (3, "http://a.net/es/9"), (4, "http://net/fr/"), (5, None), (6, ""), (7, "no scheme here"), (8, "http://notexample.com/en/1"),
    (9, "http://example.com"), (None, "http://b.net/fr/7"), (1, "http://Shop.Example.COM/en/1"), (10, "://"), (11, "x://host.org?q=1#f"), (12, "http://h.org/" + "a/" * 20_000), (13, "http://com/"), (14, "HTTP://M.X.ORG/en/77.html?page=2#top\n"),
]


def plain_parts(url):
    if not url or "://" not in url:
        return "", "", []
    scheme, rest = url.split("://", 1)
    raw = re.match("[^/?#]*", rest)[0]
    tail = rest[len(raw) :]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host, path = raw.translate(lower), re.match("[^?#]*", tail)[0]
    labels, steps = host.split("."), path.split("/")
    found = lambda p, s: (re.search(p, s) or ["", ""])[1]
    num = lambda s: re.sub("[0-9]+", "#", s)
    parts = [
        "s:" + scheme.translate(lower), "h:" + host, "t:" + found(r"([^.]+)\Z", host), "d:" + found(r"([^.]+\.[^.]+)\Z", host), "l:" + (labels[0] if len(labels) > 2 else ""),
        "1:" + num(steps[1] if len(steps) > 1 else ""), "2:" + num(steps[2] if len(steps) > 2 else ""), "x:" + found(r"\.([A-Za-z0-9]+)\Z", path), "q:" + num(found(r"\A[^?#]*\?([^#]*)", tail)), "f:" + found(r"\A[^#]*#([\s\S]*)\Z", tail),
    ]
    return host, path, [p for p in parts if len(p) > 2]


def plain_rules(labelled, least):
    n, hits = {}, {}
    for tokens, bad in labelled:
        for k in (1, 2, 3):
            for s in itertools.combinations(sorted(tokens), k):
                n[s] = n.get(s, 0) + 1
                hits[s] = hits.get(s, 0) + bad
    base = sum(b for _, b in labelled)
    sure = {s: hits[s] / n[s] for s in n if hits[s] >= least and hits[s] / n[s] >= U.CONFIDENCE and hits[s] * len(labelled) > n[s] * base}
    kept = [s for s in sure if not any(set(p) < set(s) and sure[p] >= sure[s] for p in sure)]
    return sorted(kept, key=lambda s: (-sure[s], -hits[s], s)), sure


def plain_judged(urls, labelled):
    rules, sure = plain_rules([(plain_parts(u)[2], b) for u, b in labelled if u is not None and b is not None], U.LEAST)
    out = []
    for page, url in urls:
        host, path, tokens = plain_parts(url)
        fits = [(len(h + p), h + p, v) for h, p, v in U.GIVEN if (host == h or host.endswith("." + h)) and path.startswith(p)]
        mined = None if fits else next((r for r in rules if set(r) <= set(tokens)), None)
        rule, verdict = max(fits)[1:] if fits else (None, "block" if mined else "allow")
        out.append((page, host, path, rule, verdict, " ".join(mined) if mined else None, sure[mined] if mined else None))
    return sorted(out, key=str)


def check(spark, urls, labelled):
    frame = spark.createDataFrame([(i, u, "clash", 1, 2.0) for i, u in urls], "page_id long, url string, host string, place int, confidence double")
    got = U.judged(frame, spark.createDataFrame(labelled, "url string, bad boolean")).collect()
    assert sorted(map(tuple, got), key=str) == plain_judged(urls, labelled)
    return {r["page_id"]: r["verdict"] for r in got}


def test_planted_combination(spark):
    """Bad are urls of one host in one section; host and section alone are mostly fine."""
    urls = [(1000 + i, f"http://{'ab'[i % 2]}.org/{'xy'[i // 2 % 2]}/{i}") for i in range(200)]
    labelled = [(u, "//a" in u and "/x/" in u) for _, u in urls[::2]] + [(u, False) for _, u in urls[1::2]]
    said = check(spark, urls + ODD, labelled + [(None, True), ("http://a.org/x/1", None)])
    assert said[4] == "block" and said[5] == "allow" and said[8] == "allow"
    assert {i for i, u in urls if said[i] == "block"} >= {i for i, u in urls if "//a" in u and "/x/" in u}


def test_one_host_and_copies(spark):
    """A third of all rows is one url; every set of its tokens is common, and longer sets say nothing new."""
    urls = [(i, "http://hot.org/spam/1.html?a=1#z") for i in range(100)] + [(100 + i, f"http://h{i}.org/ok/{i}") for i in range(60)]
    said = check(spark, urls, [(u, "spam" in u) for _, u in urls])
    assert said[0] == "block" and said[100] == "allow"


def test_without_labels_or_rows(spark):
    assert check(spark, ODD, [])[11] == "allow"
    assert check(spark, [], []) == {}


def test_support_bounds_sets(spark):
    x = U.with_parts(spark.createDataFrame([(f"http://h{i}.org/x/{i}", True) for i in range(50)] + [("http://good.com/y/1", False)] * 3, "url string, bad boolean"))
    rules = U.mined_rules(x.select("tokens", "bad"), support=0.9, most_tokens=2).collect()
    assert rules and all(r["hits"] >= 45 and len(r["tokens"]) <= 2 and r["key"] in r["tokens"] for r in rules)
    assert [r["place"] for r in sorted(rules, key=lambda r: r["place"])] == list(range(1, len(rules) + 1))
