"""Tokens that are on the same labelled pages are mined as one item, and spelled out again."""

import random
from itertools import chain, combinations

from cinesift.llm import url_rules


def tables(spark, urls, bad):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return pages, spark.createDataFrame([(i, None, int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")


def test_a_repeated_url_of_many_tokens_is_one_set(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    urls = ["http://spam.zz/" + "/".join(words)] * 2000 + [f"http://news.yy/{'ab'[i % 2]}" for i in range(2000)]
    pages, labels = tables(spark, urls, [i < 2000 for i in range(4000)])
    got = url_rules.mine(pages, labels, 0.01, 0.5, 1.2).collect()
    assert sorted(tuple(r["items"]) for r in got) == sorted((t,) for t in ["h:spam", "h:zz", *("p:" + w for w in words)])
    assert {(r.confidence, r.pages) for r in got} == {(1.0, 2000)}
    judged = url_rules.judge(pages, labels, 0.01)
    assert {(r.verdict, r.matched) for r in judged.where("page_id < 2000").select("verdict", "matched").distinct().collect()} == {("block", 42)}


def test_rules_over_classes_match_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(240):
        host, path = rng.choice(["a.b", "c", "d.e"]), rng.choice(["x/y", "z", "u/v/w"])
        rows.append(({"h:" + t for t in host.split(".")} | {"p:" + t for t in path.split("/")}, rng.random() < (0.9 if host == "a.b" and path == "x/y" else 0.5 if path == "z" else 0.15), f"http://{host}/{path}"))
    pages, labels = tables(spark, [u for *_, u in rows], [b for _, b, _ in rows])
    least, confidence, lift, n_bad = 5, 0.3, 1.1, sum(b for _, b, _ in rows)
    kept = {}
    tokens = sorted(set().union(*(t for t, *_ in rows)))
    for s in chain.from_iterable(combinations(tokens, k) for k in range(1, 6)):
        on = [b for t, b, _ in rows if t >= set(s)]
        if sum(on) >= least:
            kept[frozenset(s)] = (sum(on) / len(on), sum(on))
    best = lambda s: max((kept[frozenset(p)][0] for k in range(1, len(s)) for p in combinations(s, k)), default=-1.0)
    want = {s: v for s, v in kept.items() if v[0] >= confidence and v[0] * len(rows) / n_bad >= lift and best(s) < v[0]}
    got = {frozenset(r["items"]): (r.confidence, r.pages) for r in url_rules.mine(pages, labels, 0.01, confidence, lift, least).collect()}
    assert got == want and any(len(s) == 2 for s in want)
