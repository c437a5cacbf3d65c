from __future__ import annotations

import math
from collections import Counter

from runlens.llm import url_model

SCHEMA = "page_id long, url string, rule string"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_model.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_ratio(gram, counts):
    """log P(accepted) - log P(rejected) of the last character, by the recursion itself."""
    logs = []
    for side in (0, 1):
        n = {}
        for g, c in counts.items():
            for k in range(url_model.ORDER + 1):
                s = g[url_model.ORDER - k :]
                n[s] = n.get(s, 0) + c[side]
        total = sum(c[side] for c in counts.values())
        p = (n.get(gram[-1], 0) + 1) / (total + url_model.ALPHABET)
        for k in range(1, url_model.ORDER + 1):
            s = gram[url_model.ORDER - k :]
            seen = [c for g, c in n.items() if len(g) == k + 1 and g[:-1] == s[:-1] and c > 0]
            if seen:
                p = (n.get(s, 0) + len(seen) * p) / (sum(seen) + len(seen))
        logs.append(math.log(p))
    return logs[0] - logs[1]


def test_hosts_paths_and_rules(spark):
    urls = ["HTTPS://WWW.Ü.Example.NET/en/1?x#y", "http://a.net", "http://net/", "x://example.com/de/#/fr/", "http://b.example.com/DE/", None, "",
            "no scheme", "http://q.org/fr/?", "http://xorg/fr/", "a://b://c/d", "http://h?u/v", "http://example.net/en/2"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] * 2, SCHEMA)
    got = url_model.judge_urls(pages).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        host, path = parts(urls[r.page_id])
        told, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, told)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert (r.score is None) == (told is not None)


def test_scores_equal_the_recursion(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40)
    rows = {r.page_id: r.url for r in pages.collect()}
    judged = url_model.with_rule(url_model.with_host_and_path(pages))
    fold = judged.selectExpr("page_id", f"pmod(xxhash64(host, path), {url_model.CALIBRATION}) AS f")
    fold = {r.page_id: r.f for r in fold.collect()}
    counts, per = {}, {}
    for i, url in rows.items():
        host, path = parts(url)
        text = "\x02" * url_model.ORDER + host + path + "\x03"
        per[i] = [text[k : k + url_model.ORDER + 1] for k in range(len(text) - url_model.ORDER)]
        verdict = rule(host, path)[1]
        for g in per[i]:
            c = counts.setdefault(g, [0, 0])
            if verdict and fold[i]:
                c[verdict == "block"] += 1
    mean = {i: sum(brute_ratio(g, counts) * n for g, n in Counter(gs).items()) / len(gs) for i, gs in per.items() if rule(*parts(rows[i]))[1] is None}
    got = {r.page_id: r for r in url_model.judge_urls(pages).collect() if r.rule is None}
    assert set(got) == set(mean)
    cut = {round(mean[i] - r.score, 9) for i, r in got.items()}
    assert len(cut) <= 2 and all((r.verdict == "allow") == (r.score >= 0) for r in got.values())


def test_nothing_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/x", "")], SCHEMA)
    assert url_model.judge_urls(pages).first().verdict == "allow"
    assert url_model.judge_urls(pages.where("false")).count() == 0
    plan = url_model.judge_urls(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
