"""The index decides: searches by themselves, with a matcher that always says yes or no, and with many copies."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from cinesift.lineage import Scratch
from cinesift.llm import substring_dedup as S

W = 6


def runs_by_hand(rows):
    """(doc, first) -> places of words that a window covers which a smaller doc has."""
    gone = Counter()
    for _, _, doc, _, first, words in rows:
        w = words.split()
        for i in range(len(w) - W + 1):
            if any(o[2] < doc and b" ".join(w[i : i + W]) in windows(o[5]) for o in rows):
                gone.update((doc, first + i + j) for j in range(W))
    return set(gone)


def windows(words):
    w = words.split()
    return {b" ".join(w[i : i + W]) for i in range(len(w) - W + 1)}


def some_route(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice([b"a", b"b", b"c"])
    rows = []
    base = [word() for _ in range(30)]
    for doc in range(8):
        text = base[rng.randint(0, 10) :] if doc % 2 else [word() for _ in range(25)]
        text = [w if rng.random() > 0.08 else b"x" for w in text]
        rows.append((1, S.QUERY, doc, doc * 11, 100 * doc, b" ".join(text)))
    return rows


def searched(rows):
    held = S.Held(W)
    for r in rows:
        held.add(r)
    held.close()
    out = held.search()
    return {(d, p) for d, a, b in zip(*(out.column(i).to_pylist() for i in (0, 2, 3)), strict=True) for p in range(a, b)}


@pytest.mark.parametrize("seed", range(6))
def test_a_route_is_searched_as_by_hand(seed):
    rows = some_route(seed)
    assert searched(rows) == runs_by_hand(rows)


def test_the_matcher_alone_decides(monkeypatch):
    rows = some_route(3)
    right = searched(rows)
    assert right
    monkeypatch.setattr(S, "matched", lambda index, symbols, *_: symbols > 0)
    assert searched(rows) > right
    monkeypatch.setattr(S, "matched", lambda index, symbols, *_: np.zeros(len(symbols), bool))
    assert searched(rows) == set()


def test_repeated_rows_of_a_route_are_held_once():
    rows = some_route(1)
    held = S.Held(W)
    for r in rows:
        for _ in range(50):
            held.add(r)
    assert len(held.route) == len(rows)


def test_copies_of_a_text_meet_in_no_index(spark):
    text = " ".join(f"w{i * 7919 % 1009}" for i in range(400))
    other = "start " + text + " end"
    rows = spark.range(3000).selectExpr("id doc_id", f"'{text}' text").unionByName(spark.createDataFrame([(5000, other), (6000, "short text"), (6001, "short text")], "doc_id long, text string"))
    with Scratch(spark) as scratch:
        texts = S.keyed(rows).selectExpr("doc_id", "_text_hash", "0 base", "text")
        occ = scratch.keep(S.once(S.occurrences(texts, 50, S.GRAM)), "occurrences")
        found = S.passages(texts, S.dealt(occ, 50, True, scratch), 50)
        assert {r.doc_id for r in found.select("doc_id").distinct().collect()} == {0, 5000}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in S.dedup(rows).select("doc_id", "n_words", "n_removed").collect()}
    assert got.pop(0) == (400, 0) and got.pop(5000) == (402, 400) and got.pop(6000) == got.pop(6001) == (2, 0)
    assert set(got.values()) == {(400, 400)}


def test_many_repeats_of_one_id_take_linear_time(spark):
    text = " ".join(f"v{i * 7919 % 1009}" for i in range(300))
    took = []
    for n in (100, 1000):
        rows = spark.range(n).selectExpr("7L doc_id", f"'{text}' text").unionByName(spark.createDataFrame([(8, "x " + text)], "doc_id long, text string"))
        began = time.perf_counter()
        got = Counter((r.doc_id, r.n_removed) for r in S.dedup(rows).select("doc_id", "n_removed").collect())
        took.append(time.perf_counter() - began)
        assert got == {(7, 0): n, (8, 300): 1}
    assert took[1] < 5 * took[0] + 10
