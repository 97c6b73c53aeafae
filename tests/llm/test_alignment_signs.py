"""op12 cuts words where letters meet signs, and encodes many stretches as one text."""

import random

import pytest

from cinesift import lineage
from cinesift.llm import alignment
from tests.llm.test_whitening_alignment_language import brute_alignment, paths

SOME = ["foo", "Bar", "'s", "'", "don't", " ", "  ", "\n", "\n\n", "\t", ".", ",", "12", "é", "日", "ﬁ", "▁", "\x00", "<s>", "<|endoftext|>", "\r\n", "();\r"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(SOME, k=rng.randint(1, 30))) for _ in range(n)]


def test_words_with_signs_are_aligned_once(spark, monkeypatch):
    kept, plain = [], lineage.Scratch.keep

    def keep(self, df, name):
        out = plain(self, df, name)
        if name == "records":
            kept.extend(r.stretch.strip(" ") for r in out.select("stretch").collect())
        return out

    monkeypatch.setattr(lineage.Scratch, "keep", keep)
    words = [f"word{c}" for c in "abcdefgh"]
    rows = [(i, " ".join(w + s for w in words for s in ("", ",", ".", ".\nAnd")) + f" {i}") for i in range(3)]
    found = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *paths()).collect()
    # Words without, with a comma, with a stop and with what is on the next line: four stretches of each before.
    assert sorted(kept) == sorted([*words, ",", ".", ".\n", "And", "0", "1", "2"])
    assert sorted(map(tuple, found)) == [(i, *w) for (i, _), w in zip(rows, brute_alignment([t for _, t in rows]), strict=True)]


@pytest.mark.parametrize("joined", [1, 7, 256])
def test_stretches_have_the_tokens_of_whole_texts(monkeypatch, joined):
    monkeypatch.setattr(alignment, "JOINED", joined)
    both, some = alignment.Tokenizers(*paths()), texts(1500, joined)
    names = sorted({s for t in some for s in alignment.cut(t, 2)})
    assert set(names) == set(alignment.cut_once(some, 2))
    ok, sides = alignment.encode_each(both, names, 2)
    at = {s: i for i, s in enumerate(names)}
    for t in some:
        own = [at[s] for s in alignment.cut(t, 2)]
        assert "".join(names[i] for i in own) == " " + t
        whole = [x[0] for x in both.encode([" " + t])]
        good = all(b"".join(of[i] for i in ids) == (" " + t).encode() for of, ids in zip((both.a_bytes, both.b_bytes), whole, strict=True))
        assert good == ok[own].all()
        if good:
            for (ids, ends), want in zip(sides, whole, strict=True):
                assert [x for i in own for x in ids[ends[i - 1] if i else 0 : ends[i]].tolist()] == want


def test_alignment_if_words_may_not_be_cut(spark, monkeypatch):
    some = texts(60, 3)
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    want = [(i, *w) for i, w in enumerate(brute_alignment(some))]
    assert sorted(map(tuple, alignment.align(df, *paths(), 5, 5).collect())) == want
    monkeypatch.setattr(alignment, "apart", lambda b: False)
    assert sorted(map(tuple, alignment.align(df, *paths(), 5, 5).collect())) == want
