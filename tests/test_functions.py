"""Column functions against values worked out by hand and plain Python."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinesift import constants as K
from cinesift import prompts
from cinesift.functions import media as M
from cinesift.functions import text as T
from cinesift.functions import vectors as V


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def one(spark, text, column):
    return values(spark, [(text,)], "t string", column)[0]


def test_lexicons_have_their_sizes():
    assert (len(K.TEMPORAL_WORDS), len(K.VAGUE_PHRASES), len(K.SPECIFIC_TERMS), sum(map(len, K.CONCEPT_ALIASES.values()))) == (65, 14, 46, 40)


@pytest.mark.parametrize(("n", "score"), [(0, 0.0), (49, 0.2), (50, 0.4), (65, 0.7), (80, 1.0), (400, 1.0), (500, 0.8), (600, 0.6), (601, 0.4)])
def test_length_score(spark, n, score):
    assert one(spark, " \t" + "x" * n + "\n", T.length_score(T.stripped_length(F.col("t")))) == pytest.approx(score)


@pytest.mark.parametrize(("t", "score"), [("a still room", 0.0), ("She WALKS walks", 0.3), ("walks, then", 0.3), ("then slowly turns", 0.7), ("then slowly turns while after", 0.85), ("then slowly turns while after before", 1.0)])
def test_temporal_score(spark, t, score):
    assert one(spark, t, T.temporal_score(T.words(F.col("t")))) == score


@pytest.mark.parametrize(("t", "score"), [("", 0.5), ("a nicer cleft", 0.45), ("we can see a nice lens", 0.2), ("close-up, bokeh, neon, amber, ivory, azure", 1.0), ("in this video the video shows we can see a nice, really nice", 0.0)])
def test_specificity_score(spark, t, score):
    assert one(spark, t, T.specificity_score(F.lower(F.col("t")))) == pytest.approx(score)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=20))
def test_repeated_trigrams_are_all_less_distinct(spark, texts):
    got = values(spark, [(" ".join(t),) for t in texts], "t string", T.repeated_trigrams(T.words(F.col("t"))))
    tri = [[tuple(t[i : i + 3]) for i in range(len(t) - 2)] for t in texts]
    assert got == [len(x) - len(set(x)) for x in tri]


def test_jaccard_and_anchor(spark):
    rows = [("A cat", "a CAT"), ("a b", "b c"), ("", "x"), ("a", "b")]
    got = values(spark, rows, "a string, b string", T.jaccard(*(F.array_distinct(T.words(F.col(c))) for c in "ab"), F.array_intersect(T.words(F.col("a")), T.words(F.col("b")))))
    assert got == pytest.approx([1.0, 1 / 3, 0.0, 0.0])
    rows = [("A girl walks", "Luna"), ("luna is walking", "Luna"), ("", "Luna"), ("é", "L")]
    assert values(spark, rows, "c string, a string", T.prepend_anchor(F.col("c"), F.col("a"))) == ["Luna, a girl walks", "luna is walking", "Luna, ", "L, é"]


def test_concepts_and_prompts(spark):
    assert values(spark, [(n,) for n in ("Char-acters", " scene_s ", "Looks", "none")], "n string", T.concept_type(F.col("n"))) == ["character", "setting", "style", None]
    got = values(spark, [("character",), (None,)], "u string", T.fill(prompts.template(F.col("u"), "video"), anchor=F.lit("Luna")))
    assert "Luna" in got[0] and "{anchor}" not in got[0] and "{subject}" in got[0]
    with pytest.raises(Exception, match="no such use case"):
        values(spark, [("opera",)], "u string", prompts.template(F.col("u"), "video"))
    assert values(spark, [("opera",)], "u string", prompts.template(F.col("u"), "image")) == [prompts.IMAGE[None]]


@pytest.mark.parametrize(("n", "down"), [(-3, 1), (0, 1), (2, 1), (4, 1), (6, 5), (8, 5), (10, 9), (80, 77), (82, 81), (84, 81), (161, 161)])
def test_snap(spark, n, down):
    assert values(spark, [(n,)], "n long", M.snap_down(F.col("n"))) == [down]
    up = values(spark, [(n,)], "n long", M.snap_up(F.col("n")))[0]
    assert up >= n and (up - 1) % 4 == 0 and up - max(n, 1) < 4


def test_container_fields(spark):
    rates = ["24000/1001", "25", "30/1", "0/0", "N/A", ""]
    assert values(spark, [(r,) for r in rates], "r string", M.frame_rate(F.col("r"))) == [23.976, 25.0, 30.0, 0.0, 0.0, 0.0]
    sars = [None, "N/A", "0:0", "4/3", "1:1"]
    assert values(spark, [(s,) for s in sars], "s string", M.sample_aspect(F.col("s"))) == ["1:1", "1:1", "1:1", "4:3", "1:1"]
    assert values(spark, [(720, 480, "8:9"), (720, 480, "x")], "w int, h int, s string", M.aspect_ratio(F.col("w"), F.col("h"), F.col("s"))) == pytest.approx([4 / 3, 1.5])
    keys = [(333, 245, 17, 16), (854, 480, 1, 16), (10, 10, 1, 16)]
    assert [values(spark, [k], "w int, h int, f int, s int", M.bucket_key(F.col("w"), F.col("h"), F.col("f"), k[3]))[0] for k in keys] == ["320x240x17", "848x480x1", "0x0x1"]
    assert values(spark, [("clip.audit.txt",), (".hidden",), ("a",)], "n string", M.file_stem(F.col("n"))) == ["clip.audit", ".hidden", "a"]
    assert values(spark, [(1.0, 4.0), (2.0, 2.0)], "a double, b double", M.interior_times(F.col("a"), F.col("b"), 2)) == [[2.0, 3.0], []]


def test_pair_starts(spark):
    for n in range(12):
        want = [] if n < 2 else list(range(n - 1)) if n - 1 <= 5 else [int(i * (n - 2) / 5) for i in range(5)]
        assert values(spark, [(n,)], "n long", M.pair_starts(F.col("n"))) == [want]


def test_vectors(spark):
    rows = [([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])]
    schema = "a array<float>, b array<float>"
    assert values(spark, rows, schema, V.dot(F.col("a"), F.col("b"))) == [11.0, 0.0]
    assert values(spark, rows, schema, V.normalised(F.col("a"))) == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]
    assert values(spark, [(0b1011, 0b0010), (-1, 0)], "a long, b long", V.hamming(F.col("a"), F.col("b"))) == [2, 64]
    grid = [float(i % 8) for i in range(64)]
    assert values(spark, [(grid,)], "g array<double>", V.grid_hash(F.col("g"))) == [2**56 - 1]
    assert values(spark, [([5.0] * 64,)], "g array<double>", V.laplacian_variance(F.col("g"), 8, 8)) == [0.0]
