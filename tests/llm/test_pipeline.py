"""Each stage of the pipeline against a brute-force version on a small corpus."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_operators import plain_components, plain_fingerprint, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string, n_words long, hits long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdgklmp" for b in "aeiou" for c in ("n", "r", "st", "lo")]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows, labels = [], []
    for i in range(200):
        t = text(rng.randint(60, 120))
        if i % 5 == 0:
            t = f"you idiot {t} worthless moron"
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        if i % 2 == 0:
            labels.append((i, 1, int(i % 5 == 0)))
    passage, item = text(60), text(25)
    rows += [(300 + i, f"{text(30)} {passage} {text(30)}", "en", "s1", 0) for i in range(4)]
    rows += [(310, rows[3][1], "en", "s0", 0), (311, f"{text(20)} {item} {text(20)}", "en", "s0", 0), (312, None, "en", None, 0), (313, "", "en", "s2", 0)]
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = [(*r, 7.0, "own", -1, -2) for r in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "mixing":
            assert docs.columns == columns
            assert {(r.score, r.kind, r.n_words, r.hits) for r in after.values()} == {(7.0, "own", -1, -2)}
        out[name] = (before, after)

    before, after = out["toxicity"]
    toxic = {i for i in range(200) if i % 5 == 0}
    assert not toxic & set(after) and set(before) - toxic == set(after)

    before, after = out["simhash"]
    ids = sorted(before)
    label = plain_components([plain_fingerprint(before[i].text) for i in ids], 4)
    first = {}
    for i, c in zip(ids, label, strict=True):
        first.setdefault(c, i)
    assert set(after) == set(first.values())

    before, after = out["substring"]
    starts = defaultdict(set)
    for i, r in before.items():
        w = words(r.text)
        for k in range(len(w) - 49):
            starts[tuple(w[k : k + 50])].add(i)
    for i, r in before.items():
        w = words(r.text)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if min(starts[tuple(w[k : k + 50])]) < i:
                gone[k : k + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert (i in after) == (not w or bool(kept))
        if i in after:
            assert words(after[i].text) == kept
            assert after[i].text == r.text or after[i].n_chars == len(after[i].text)

    before, after = out["decontamination"]
    assert set(before) - set(after) == {311}

    before, after = out["mixing"]
    assert all(r.copies > 0 and r.taken == r.copies * r.size and r.size == len(words(before[i].text)) for i, r in after.items())


def test_run_applies_all_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r.copies > 0 for r in rows) and not any(r.doc_id in (0, 5, 310, 311) for r in rows)


def test_one_id_with_two_texts(spark):
    rng = random.Random(5)
    a, b = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(2))
    rows = [(5, a), (9, a), (5, b), (2, b), (7, None), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(5, a), (2, b), (7, None), (None, b)]))
