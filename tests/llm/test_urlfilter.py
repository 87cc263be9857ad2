"""The URL filter: very long hosts, own columns of the same names, many rules against a plain scan of the list."""

import random
import time

from quarry.llm import urlfilter as U


def test_long_hosts_and_paths(spark):
    hosts = [".".join(["a"] * 100_000), "x" * 300_000 + ".com", ".".join(["b"] * 50_000) + ".www.example.com"]
    urls = spark.createDataFrame([(i, f"http://{h}/en/{'p' * 200_000}") for i, h in enumerate(hosts)], "page_id long, url string")
    start = time.time()
    got = {r.page_id: (r.rule, r.verdict, len(r.host)) for r in U.with_verdicts(urls).collect()}
    assert got == {0: (None, "allow", len(hosts[0])), 1: ("com/", "allow", len(hosts[1])), 2: ("www.example.com/en/", "allow", len(hosts[2]))}
    assert time.time() - start < 60
    assert sum(map(len, U.keys_of(hosts[0], "/en/x", [1, 4], 3))) < 60


def plain(host, path, rules, default):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, default)


def test_many_rules_against_a_plain_scan(spark):
    rng = random.Random(8)
    label = lambda: rng.choice(["a", "b", "cc", "d-e", "www", "é"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 6)))
    path = lambda: "/" + "/".join(label() for _ in range(rng.randrange(4)))
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in {(host(), path()) for _ in range(300)}]
    urls = [(i, f"http://{h}{p}", h, p, "own", "own", "own", 1) for i, (h, p) in enumerate((host(), path()) for _ in range(3000))]
    frame = spark.createDataFrame(urls, "page_id long, url string, h string, p string, rule string, verdict string, host string, note int")
    out = U.with_verdicts(frame, rules, "other")
    assert sorted(out.columns) == sorted(["page_id", "url", "h", "p", "note", "host", "path", "rule", "verdict"])
    for r in out.collect():
        assert (r.rule, r.verdict) == plain(r.h, r.p, rules, "other") and (r.host, r.path) == (r.h, r.p)


def test_no_rules(spark):
    urls = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in U.with_verdicts(urls, [], "other").collect()] == [(None, "other")] * 2


def test_own_columns_of_any_name_stay(spark):
    own = spark.createDataFrame([(1, "http://a.net/es/", "mine", "its")], "page_id long, url string, __judged string, ___judged string")
    row = U.with_verdicts(own).first()
    assert (row["__judged"], row["___judged"], row.rule, row.verdict) == ("mine", "its", "net/es/", "block")
