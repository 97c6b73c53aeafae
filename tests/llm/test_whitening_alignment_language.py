"""Whitening, alignment of tokenizers and language identification against brute force."""

import hashlib
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from cinesift.llm import alignment, language_id, whitening
from cinesift.llm.common import held_out

VECTORS = "vec_id long, embedding array<float>, n long, component string, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "own", "own") for i, v in rows], VECTORS)


def some_vectors(d=5, n=60, seed=3):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, d)) * np.arange(1, d + 1)
    data[:, 2] += 5000  # an offset far above the spread
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    return rows + [(100, rows[4][1]), (101, rows[4][1]), (4, rows[4][1]), (None, rows[5][1])]


def integers(v):
    return [int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v]


def expected(rows):
    x = {i: np.array(integers(v)) for i, v in enumerate(v for _, v in rows)}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    centred = fit - fit.mean(axis=0)
    values, components = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, fit, values[::-1], components[:, ::-1]


def test_whitening_equals_a_dense_solve(spark):
    rows = some_vectors()
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [1.0, float("nan"), 1.0, 1.0, 1.0]), (203, [1.0, float("-inf"), 1.0, 1.0, 1.0]), (204, []), (205, [1.0, 2.0]), (206, [3e38, 1.0, 1.0, 1.0, 1.0])]
    found = whitening.whiten(vectors(spark, rows + bad)).collect()
    x, fit, values, components = expected(rows)
    assert len(found) == 5 * len(rows)
    by = defaultdict(list)
    for r in found:
        by[r.vec_id, r.component].append(r)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    for k in range(5):
        of = [(i, (x[j] - fit.mean(axis=0)) @ components[:, k] / np.sqrt(values[k])) for j, (i, _) in enumerate(rows)]
        sign = np.sign(of[0][1] * by[of[0][0], k + 1][0].whitened)
        for j, (i, w) in enumerate(of):
            for r in by[i, k + 1]:
                assert r.whitened == pytest.approx(sign * w, abs=1e-8)
                assert (r.n, r.deviation) == (n, sum((n * int(v) - s) ** 2 for v, s in zip(x[j], sums, strict=True)))
                assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-10)
                assert r.identity_error < 1e-10
    assert len(by[4, 1]) == 2 and len(by[None, 1]) == 1


def test_moments_merge_alike_in_any_tree(spark):
    x = spark.createDataFrame([(v,) for v in {tuple(integers(v)) for _, v in some_vectors()}], "x array<long>").repartition(9)
    a, b = whitening.moments(x), whitening.moments(x, fan_in=2)
    fit = np.array(sorted(tuple(r.x) for r in x.collect()))
    centred = fit - fit.mean(axis=0)
    for m in (a, b):
        assert (m.n, m.sums) == (len(fit), [int(s) for s in fit.sum(axis=0)])
        assert np.allclose(m.products, centred.T @ centred, rtol=1e-11)


@pytest.mark.parametrize(("n", "rank"), [(1, 1), (2, 2), (3, 1), (7, 4), (24, 24)])
def test_eigen_equals_lapack(n, rank):
    b = np.random.default_rng(n).normal(size=(n, rank))
    a = b @ b.T
    values, components = whitening.eigen(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-10)
    assert np.allclose(components.T @ components, np.eye(n), atol=1e-12) and np.allclose(a @ components, components * values, atol=1e-9)


def test_whitening_without_variance_or_rows(spark):
    same = [(i, [1.0, 2.0]) for i in range(3)]
    found = whitening.whiten(vectors(spark, same)).collect()
    assert len(found) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in found)
    flat = [(i, [float(i), 2.0 * i]) for i in range(4)]  # the second component has no variance
    found = whitening.whiten(vectors(spark, flat)).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in found)
    assert whitening.whiten(vectors(spark, [])).collect() == [] and whitening.whiten(vectors(spark, [(1, None)])).collect() == []


def test_deviations_beyond_a_long_are_null():
    model = whitening.Whitening(3, [3 << 50, 0], np.eye(2), np.ones(2), np.ones(2))
    x = np.array([[1 << 50, 2], [1 << 40, 0]])
    assert model.deviations(x) == [36, None]


# alignment


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts):
    """By the definition, over whole texts."""
    both, out, held = alignment.Tokenizers(*paths()), [], Counter()
    for t in texts:
        out.append(None)
        if not t:
            continue
        a, b = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)
        a_bytes, b_bytes = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            continue
        ends = lambda v: [sum(map(len, v[: i + 1])) for i in range(len(v))]
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        cuts = sorted(set(a_ends) & set(b_ends))
        groups = [([], []) for _ in cuts]
        for side, ids, at in ((0, a, a_ends), (1, b, b_ends)):
            for i, e in zip(ids, at, strict=True):
                groups[sum(c < e for c in cuts)][side].append(i)
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        held.update(links.keys())
        out[-1] = a, b, groups, links
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for r in out:
        if r is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = r
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return rows


ODD = [
    "a b", "", None, "  two  spaces here ", "tab\t x\n\n y", "▁ odd", "it's  <|endoftext|> <s> </s> don't", "日本語 テキスト x 한국어", "emoji 😀😀 👍🏽 x", "\x00nul \x01", "a" * 700, " " * 300, "x " * 300, "é é ﬁ ½ Ⅷ",
    "= " * 20 + "=" * 200, "a b", "ß​z 　 w", "\r\n a\r b", "'s 've x'll", "123 456,789 1 2", " a", "a b", "unhappiness internationalization of the antidisestablishmentarianism",
]


@pytest.mark.parametrize("bounds", [(1 << 17, 1 << 18), (3, 2), (0, 0)])
def test_alignment_equals_brute_force(spark, bounds):
    rng = random.Random(5)
    words = "the of and unhappily thereupon, naïve\nLine re-do 3.14 ZÜRICH".split(" ")
    texts = ODD + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(8)]
    rows = [(i, t, "own", 1) for i, t in enumerate(texts)] + [(None, "a b", "own", 1), (0, "a b", "own", 1)]
    found = alignment.align(spark.createDataFrame(rows, "doc_id long, text string, groups string, n_a int"), *paths(), *bounds).collect()
    want = brute_alignment([r[1] for r in rows])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)


def test_alignment_without_sure_cuts_and_without_rows(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD[:9])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, alignment.align(df, *paths()).collect()))
    monkeypatch.setattr(alignment, "certain", lambda a, b: False)
    assert sorted(map(tuple, alignment.align(df, *paths()).collect())) == whole
    assert alignment.align(df.limit(0), *paths()).collect() == []


def test_alignment_of_a_hot_text(spark):
    df = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'the same words again', concat('word', id)) text")
    rows = {tuple(r)[1:] for r in alignment.align(df, *paths()).where("doc_id % 3 = 0").collect()}
    (n_a, n_b, _, n_links, _, count_sum, _) = rows.pop()
    assert not rows and n_a == n_b == n_links == 4 and count_sum == 4000


# language


def test_letters_and_buckets_by_hand():
    assert "".join(map(chr, language_id.letters(" Äb1c!! d"))) == " äb c d "
    assert "".join(map(chr, language_id.letters("x."))) == " x " and not len(language_id.letters("12 .!"))
    code = language_id.letters("abc")
    grams = language_id.buckets(code, 1 << 15)
    assert len(grams) == 5 + 4 + 3 + 2
    assert list(grams[:5]) == list(language_id.buckets(code[:5], 1 << 15)[:5])


def corpus(spark, n=400):
    rng = random.Random(2)
    parts = {"en": ["th", "ing", "er", "on", "ed"], "fr": ["eau", "ment", "é", "ou", "qu"], "de": ["sch", "ein", "ü", "ung", "pf"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 30)))
        rows.append((i, text, lang if i % 7 else None, "x"))
    return rows + [(n, None, "en", "x"), (n + 1, "", "fr", "x"), (n + 2, "12 ! 3", None, "x"), (None, "schein ungpf", "de", "x"), (3, rows[3][1], rows[3][2], "x")]


SCHEMA = "doc_id long, text string, lang string, score string"


def test_language_equals_naive_bayes_written_out(spark):
    rows = corpus(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    out = {bool(r.h): 0 for r in df.select(held_out(df.doc_id).alias("h")).collect()}
    held = {r.doc_id: r.h for r in df.select("doc_id", held_out(df.doc_id).alias("h")).collect()}
    model = language_id.fit(df)
    counts, docs = defaultdict(Counter), Counter()
    for i, text, lang, _ in rows:
        if lang is not None and not held[i]:
            docs[lang] += 1
            counts[lang].update(language_id.buckets(language_id.letters(text or ""), language_id.BUCKETS).tolist())
    assert model.languages == sorted(docs)
    for k, lang in enumerate(model.languages):
        total = sum(counts[lang].values()) + language_id.SMOOTHING * language_id.BUCKETS
        for b in (*list(counts[lang])[:50], 1, 2):
            assert model.weight[b, k] == pytest.approx(np.log((counts[lang][b] + language_id.SMOOTHING) / total))
        assert model.prior[k] == pytest.approx(np.log(docs[lang] / sum(docs.values())))
    right = Counter()
    for r in language_id.identify(df).collect():
        out[r.held_out] += 1
        text = next(t for i, t, _, _ in rows if i == r.doc_id)
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        grams = language_id.buckets(language_id.letters(text), language_id.BUCKETS)
        s = model.prior + model.weight[grams].sum(axis=0)
        assert r.lang_pred == model.languages[int(np.argmax(s))] and r.score == pytest.approx(float(np.exp(s.max() - np.logaddexp.reduce(s))))
        known = next(x for i, _, x, _ in rows if i == r.doc_id)
        if known is not None and r.held_out:
            right[known == r.lang_pred] += 1
    assert min(out.values()) > 40 and right[True] > 0.95 * right.total()


def test_language_of_long_texts_and_without_labels(spark):
    rows = corpus(spark, 60)
    model = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    long = spark.createDataFrame([(1, "eau " * 400_000, None, "x"), (2, "sch", None, "x")], SCHEMA)
    assert {r.doc_id: r.lang_pred for r in language_id.identify(long, model).collect()} == {1: "fr", 2: "de"}
    assert {(r.lang_pred, r.score) for r in language_id.identify(long).collect()} == {("und", 0.0)}
    assert language_id.identify(long.limit(0)).collect() == []


def test_many_languages_share_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", 3 * 256)
    model = language_id.fit(spark.createDataFrame(corpus(spark, 60), SCHEMA))
    assert model.weight.shape == (256, 3) and np.allclose(np.exp(model.weight).sum(axis=0), 1)
