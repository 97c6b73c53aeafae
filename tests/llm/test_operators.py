"""Operators against brute force on small tables, with the cases their docstrings define."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from cinesift.llm import decontamination, fm_index, mixing, quality_qda, quality_rules, simhash, substring_dedup, token_counts, toxicity, url_rules, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits long, score string"


def words(text):
    return WORD.findall(text or "")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "own") for i, t, s in rows], SCHEMA)


def some_rows(seed=1):
    """Texts with copies, near copies, shared passages, nulls, a long one and repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "AND,", "é\u00a0x", "ß"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = text(70)
    rows = [(i, text(rng.randint(1, 160)), f"s{i % 3}") for i in range(40)]
    rows += [(50 + i, text(20) + "\n" + shared + "\t" + text(10), "s0") for i in range(6)]
    near = text(150).split()
    for i in range(6):
        copy = list(near)
        copy[rng.randrange(150)] = "edit"
        rows.append((60 + i, " ".join(copy), "s1"))
    rows += [(70, rows[3][1], "s2"), (71, rows[3][1], None), (72, None, "s0"), (73, "", "s0"), (74, " \n\t ", None), (75, text(3000), "s1"), (None, shared, "s1"), (None, None, None)]
    return rows + [rows[5], rows[50]]


def test_mixing_hits_targets_and_reruns_agree(spark):
    rows = some_rows()
    df = documents(spark, rows)
    a = mixing.mix(df).collect()
    b = mixing.mix(df.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, str(r.source), r.target)
    assert sorted(map(key, a)) == sorted(map(key, b))
    assert len(a) == len(rows)
    size, target, taken, largest = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for r in a:
        assert r.taken in (r.epochs * r.size, (r.epochs + 1) * r.size) and r.taken <= 3 * r.size
        size[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    order = sorted(size, key=lambda s: (s is None, s))
    share = {s: 0.0 for s in order}
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_ = float(sum(size.values())), set(order)
    while open_ and left > 1e-9:  # as the contract tells it: shares, and the excess reshared
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            share[s] += unit * weight[s]
            if share[s] >= 3 * size[s]:
                left += share[s] - 3 * size[s]
                share[s] = 3 * size[s]
                open_.discard(s)
    for s in order:
        assert target[s] == pytest.approx(share[s])
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert mixing.mix(documents(spark, [])).count() == 0


def test_substring_dedup_is_exact(spark):
    rows = some_rows(2)
    got = substring_dedup.dedup(documents(spark, rows), window=12, gram=5).collect()
    starts = defaultdict(set)
    for i, t, _ in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - 11):
                starts[tuple(w[k : k + 12])].add(i)
    want = []
    for i, t, _ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 11):
            if i is not None and min(starts[tuple(w[k : k + 12])]) < i:
                gone[k : k + 12] = [True] * 12
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((str(i), len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert sum(w[2] for w in want) > 300
    for r in got:
        assert hashlib.sha256(" ".join(words(r.kept_text)).encode()).hexdigest() == r.kept_sha256
        assert r.score == "own"
    assert substring_dedup.dedup(documents(spark, [])).count() == 0


def plain_runs(rows, window):
    """doc_id -> covered places, as the contract of op2 tells it."""
    starts = defaultdict(set)
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            starts[tuple(w[k : k + window])].add(i)
    out = defaultdict(set)
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if min(starts[tuple(w[k : k + window])]) < i:
                out[i] |= set(range(k, k + window))
    return out


def runs(df):
    out = defaultdict(set)
    for r in df.collect():
        for h in r._hits:
            out[r.doc_id] |= set(range(h.start, h.stop))
    return out


@pytest.mark.parametrize(("part", "shard"), [(1_000, 100), (60, 400), (400_000, 400_000)])
def test_busy_regions_and_small_indexes_give_the_same(spark, part, shard):
    rows = [(i, " ".join(["x"] * 30 + [f"t{i % 7}"] + ["y"] * 30 + [f"u{i % 5}"] + ["x"] * 20), "s") for i in range(60)]
    got = substring_dedup.repeated(documents(spark, rows), 12, 5, part, shard)
    assert runs(got) == plain_runs(rows, 12)


def test_crowded_anchors_are_dealt_by_whole_windows(spark, monkeypatch):
    """One line in many surroundings: its anchor has a passage for each document."""
    rng = random.Random(8)
    line = [f"l{k}" for k in range(14)]
    text = lambda: [f"w{rng.randrange(10_000)}" for _ in range(15)]
    rows = [(i, " ".join(text() + line + text()), "s") for i in range(400)]
    searched = []
    whole = substring_dedup.found
    monkeypatch.setattr(substring_dedup, "found", lambda df, *a: searched.append(df.count()) or whole(df, *a))
    got = substring_dedup.repeated(documents(spark, rows), 12, 5)
    assert runs(got) == plain_runs(rows, 12)
    assert len(searched) == 2 and searched[1] <= 2 * len(rows)  # not each with all others


def test_long_windows_have_no_limit(spark):
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(700))
    rows = [(1, text, "s"), (2, text, "s"), (3, "a " + text[:1800], "s")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(documents(spark, rows), window=300).collect()}
    assert got == {i: len(w) for i, w in ((1, []), (2, plain_runs(rows, 300)[2]), (3, plain_runs(rows, 300)[3]))}
    with pytest.raises(ValueError):
        substring_dedup.dedup(documents(spark, rows), window=10, gram=11)


def test_fm_index_finds_what_is_there(monkeypatch):
    monkeypatch.setattr(fm_index, "EVERY", 3)
    monkeypatch.setattr(fm_index, "RUNS", (1 << 40, 5, 1))
    rng = np.random.default_rng(0)
    for _ in range(120):
        sigma, least = int(rng.integers(2, 6)), int(rng.integers(3, 9))
        texts = [rng.integers(1, sigma, int(rng.integers(1, 60))) for _ in range(int(rng.integers(2, 12)))]
        for i in range(1, len(texts)):
            if rng.random() < 0.5:
                texts[i] = texts[int(rng.integers(0, i))].copy()
        owner = rng.integers(0, 6, len(texts))
        limit = rng.integers(0, 7, len(texts))
        length = np.array([len(t) for t in texts])
        start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        symbols = np.zeros(int((length + 1).sum()), np.int64)
        for t, s in zip(texts, start, strict=True):
            symbols[s : s + len(t)] = t
        index = fm_index.FMIndex(symbols, np.repeat(owner, length + 1), sigma, int(length.max()), 6)
        got = fm_index.matched(index, symbols, start, length, limit, least)
        for q, t in enumerate(texts):
            other = [o for o in range(len(texts)) if owner[o] < limit[q]]
            has = lambda w: any(w == list(texts[o][k : k + least]) for o in other for k in range(len(texts[o]) - least + 1))
            want = set().union(*(range(p, p + least) for p in range(len(t) - least + 1) if has(list(t[p : p + least]))))
            assert set(np.flatnonzero(got[start[q] : start[q] + length[q]]).tolist()) == want
    assert index.nbytes() > 0


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(w)
    grams = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(fps, radius):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_simhash_matches_brute_force(spark):
    rows = some_rows(3) + [(200 + i, f"a b c d e f g h {'i' if i else 'j'}", "s") for i in range(3)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    label = plain_components(fps, 4)
    least = defaultdict(lambda: None)
    for (i, _, _), c in zip(rows, label, strict=True):
        if i is not None and (least[c] is None or i < least[c]):
            least[c] = i
    want = sorted((str(i), f"{f:016x}", str(least[c])) for (i, _, _), f, c in zip(rows, fps, label, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("group", [3, 4096])
def test_simhash_links_lose_no_component(spark, group):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(25)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, group).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        root[find(e.u)] = find(e.v)
    label = plain_components(fps, 4)
    assert len({(find(f), c) for f, c in zip(signed, label, strict=True)}) == len(set(label)) == len({find(f) for f in signed})


def test_pigeonhole_masks():
    rng = random.Random(1)
    for bands in (5, 6, 7, 8):
        masks = simhash.masks(bands, 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
            assert any(a & m == b & m for m in masks)


def labelled(spark, n=400):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randint(25, 90))
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "1diot", "zorgified", "zorgath"])
        if not good:
            w = [x + rng.choice(["###", "$$$", "%%%"]) for x in w]
        rows.append((i, " ".join(w), "s"))
        labels.append(Row(doc_id=i, quality=int(good), toxic=int(toxic)))
    rows += [(n, None, "s"), (n + 1, "", "s"), (None, "bat", "s"), (n + 2, "a" * 100_000, "s"), rows[1]]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


@pytest.mark.parametrize(("judge", "label"), [(toxicity.score, "toxic"), (quality_qda.classify, "quality")])
def test_classifiers_hold_out(spark, judge, label):
    docs, labels, rows = labelled(spark)
    got = judge(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    import zlib

    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    # Labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 then 1 - quality else quality end as quality", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 then 1 - toxic else toxic end as toxic")
    key = lambda rs: sorted((str(r.doc_id), round(r.score, 9)) for r in rs)
    assert key(judge(docs, flipped).collect()) == key(got)
    none = labels.where("false")
    assert len({r.score for r in judge(docs, none).collect()}) == 1
    assert judge(documents(spark, []), labels).count() == 0


def test_discriminant_is_the_difference_of_log_densities():
    """Against covariances inverted as a whole and densities written out."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)), rng.normal(1, 2, size=(200, 4))])
    y = np.repeat([0, 1], [300, 200])
    model = quality_qda.Discriminant.fit(x, y)
    z = (x - x.mean(0)) / x.std(0)
    cov = [np.cov(z[y == k], rowvar=False, bias=True) for k in (0, 1)]
    pooled = (300 * cov[0] + 200 * cov[1]) / 500
    log = []
    for k in (0, 1):
        c = 0.7 * cov[k] + 0.3 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 0.02 * np.eye(4)
        d = z - z[y == k].mean(0)
        log.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.margin(x), log[1] - log[0])
    both = quality_qda.Discriminant.calibrated(x, y, np.arange(500) % 3)
    assert np.allclose(both.margin(x), model.margin(x)) and both.slope != 1.0


def test_boosted_trees_take_the_best_split():
    """One round of depth 1: the split, and the values of Newton's step, by trying all."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, (200, 3)).astype(float), rng.integers(0, 2, 200)
    y = np.where(x[:, 1] > 2, y, 0)
    model = toxicity.Boosted.fit(x, y, rounds=1, depth=1)
    p = (y.sum() + 1) / 202
    g, h = y - p, p * (1 - p)
    score = lambda m: g[m].sum() ** 2 / (h * m.sum() + 1)
    best = max(((score(x[:, f] <= t) + score(x[:, f] > t), f, t) for f in range(3) for t in range(5) if (x[:, f] <= t).any() and (x[:, f] > t).any()), key=lambda b: b[0])
    left = x[:, best[1]] <= best[2]
    value = np.where(left, g[left].sum() / (h * left.sum() + 1), g[~left].sum() / (h * (~left).sum() + 1))
    assert np.allclose(model.margin(x), np.log(p / (1 - p)) + 0.15 * value)


def test_features_of_several_stem_sets_are_those_of_each(spark):
    rng = random.Random(2)
    sets = [{b"zor": 3.0, b"blo": 2.5}, {}, {b"zorg": 4.0, b"blop": 2.2}]
    words_ = ["you", "zorgify", "Z0RG!", "blopp", "idiot", "fine", "id-iot", "YOU", "word", "ünd"]
    texts = ["", " \n"] + [" ".join(rng.choices(words_, k=rng.randint(1, 25))) for _ in range(60)]
    every = toxicity.Reader(*sets)
    for t in texts:
        assert every.describe_all(t.encode()) == [toxicity.Reader(s).describe(t.encode()) for s in sets]
    near = toxicity.FEATURES.index("near_second_person")
    assert every.describe(b"you fine zorgify fine fine fine fine idiot")[near] == np.log1p(1)


def test_stems_of_folds_are_learned_without_them(spark):
    from cinesift.llm.common import chosen_labels

    rows = [(i, f"some words and zorgified{i % 2 if i % 4 == 0 else ''} here {'blorptastic' if i % 4 == 0 else 'fine'}", "s") for i in range(300)]
    docs = documents(spark, rows + rows[:3])
    labels = spark.createDataFrame([Row(doc_id=i, quality=1, toxic=int(i % 4 == 0)) for i in range(300)])
    chosen = chosen_labels(labels, "toxic", 1000, 2)
    held = {r.doc_id: r.fold for r in chosen.collect()}
    assert set(held.values()) == {0, 1}
    every, *parts = toxicity.learn_stems(docs, chosen, 2)
    for k, stems in enumerate(parts):
        alone = toxicity.learn_stems(docs, chosen.where(f"fold <> {k}"), 2)[0]
        assert stems == alone and stems != every and b"blorpt" in stems


def plain_repeats(w):
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)})


def test_quality_rules(spark):
    docs, labels, rows = labelled(spark)
    more = [(900, "a b c d e f g h " * 5, "s"), (901, "x y\nx y\n\n \nz\nx y ", "s"), (902, "é ñ# | < > & $ % *", "s")]
    docs = docs.union(documents(spark, more))
    got = quality_rules.judge(docs, labels).collect()
    want = []
    for i, t, _ in rows + more:
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        repeats = plain_repeats(w)
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeats, len(w) < 20 or 100 * repeats > 30 * len(w)))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    good = {r.doc_id: r.quality for r in labels.collect()}
    assert not any(r.kept and r.base_failed for r in got)
    assert np.mean([r.kept for r in got if good.get(r.doc_id) == 1]) > 0.95
    assert np.mean([r.kept for r in got if good.get(r.doc_id) == 0]) < 0.5
    assert quality_rules.judge(documents(spark, []), labels).count() == 0


def test_isolation_forest_sets_outliers_apart():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(500, 4)), rng.normal(6, 1, size=(10, 4))])
    s = quality_rules.IsolationForest.fit(x[:500]).score(x)
    assert s[500:].min() > np.quantile(s[:500], 0.95)


def test_isotonic_is_the_nearest_rising_curve():
    x, y = np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 1, 0, 0, 1, 1])
    xs, ys = toxicity.isotonic(x, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()


def library_count(path, text):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    from sentencepiece import SentencePieceProcessor

    return len(SentencePieceProcessor(model_file=path).encode(text))


def test_token_counts_and_cache(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    rows = some_rows(4) + [(300, "<|endoftext|> hello", "s")]
    docs, cache = documents(spark, rows), f"{tmp_path}/cache"
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        got = token_counts.count_tokens(docs, public.path(name), cache).collect()
        want = sorted((str(i), len((t or "").encode()), n, n > 512) for (i, t, _), n in ((r, library_count(public.path(name), r[1] or "")) for r in rows))
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    held = spark.read.parquet(cache)
    assert held.count() == held.distinct().count() == 2 * len({t or "" for _, t, _ in rows})
    token_counts.count_tokens(docs, public.path(name), cache).collect()
    assert spark.read.parquet(cache).count() == held.count()  # nothing is encoded twice


def test_pieces_count_as_the_library_does():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    counter = token_counts.Counter(public.path("byte_bpe_50k.json"))
    assert counter.pieces is not None
    rng = random.Random(6)
    parts = ["the", "The", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "'s", "'S", "''ll", "don't", "é", "Straße", "ñandú", "12", "1,234.5", "²", "½", "...", "—", "“x”", "#$%", "_a_", "\xad", "a" * 300, "東京", "🙂", "\xa0", "\x85", "\x1c", "\u2028", "<|endoftext|>", "<|end"]
    texts = ["".join(rng.choices(parts[: rng.choice((25, len(parts)))], k=rng.randint(0, 40))) for _ in range(1500)]
    assert counter.count(texts) == [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert sum(1 for t in texts if token_counts._SURE.fullmatch(t)) > 300 and len(counter.pieces) > 25
    counter.pieces.MOST = 3  # forgets, and counts the same
    assert counter.count(texts[:50]) == [len(x) for x in library.encode_batch(texts[:50], add_special_tokens=False)]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_url_rules(spark):
    urls = [f"http://{h}.example.{t}/{p}/{i}" for i, (h, t, p) in enumerate((h, t, p) for h in ("spam-farm", "blog", "m") for t in ("com", "org", "net") for p in ("en", "de", "fr")) for _ in range(4)]
    urls += ["HTTP://A.EXAMPLE.NET/en/x?y#z", "nothing", None, "", "://", "x://net", "x://net/", "x://notnet/", "x://fr.org/fr/", "x://example.com/de", "x://example.com/de/?q", "a?b://net/", "x://É.org/fr/\n/q"]
    pages = spark.createDataFrame([(i, u, "<p>", "own") for i, u in enumerate(urls)] + [(None, urls[0], None, "own")], "page_id long, url string, html string, rule string")
    labels = spark.createDataFrame([(i, 0 if u and "spam" in u else 1, 0) for i, u in enumerate(urls[:90])], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge(pages, labels, support=0.05).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        host, path = plain_url(u)
        fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = (max(fits)[1:]) if fits else (None, "block" if "spam" in host else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    none = url_rules.judge(pages, labels.where("false")).collect()
    assert all(r.verdict == "allow" for r in none if r.rule is None)
    assert url_rules.judge(pages.where("false"), labels).count() == 0


def test_mined_rules_match_brute_force(spark):
    from itertools import combinations

    rng = random.Random(21)
    urls, bad = [], []
    for _ in range(300):
        host, path = rng.choice(["spam", "news", "blog"]), rng.choice(["win", "read", "go"]) + "/" + rng.choice(["a", "b"])
        urls.append(f"http://{host}.com/{path}")
        bad.append(rng.random() < (0.9 if "spam" in host and "win" in path else 0.6 if "go" in path else 0.1))
    pages = spark.createDataFrame([(i, u, "bad", 1) for i, u in enumerate(urls)] + [(0, urls[0], "again", 1), (None, urls[1], "x", 1)], "page_id long, url string, items string, freq int")
    labels = spark.createDataFrame([(i, None, int(b)) for i, b in enumerate(bad)] + [(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    bad[1] = True
    rows = [(frozenset(["h:" + x for x in u.split("/")[2].split(".")] + ["p:" + x for x in u.split("/")[3:]]), b) for u, b in [*zip(urls, bad, strict=True), (urls[0], bad[0])]]
    n, n_bad = len(rows), sum(b for _, b in rows)
    sets = {frozenset(c) for items, _ in rows for k in range(1, len(items) + 1) for c in combinations(sorted(items), k)}
    hold = {s: (sum(s <= i and b for i, b in rows), sum(s <= i for i, b in rows)) for s in sets}
    for least in (1, 20):
        sure = {s: (b, b / a) for s, (b, a) in hold.items() if b >= max(least, 0.01 * n)}
        want = {s: c for s, (b, c) in sure.items() if c >= 0.3 and c * n / n_bad >= 1.2 and not any(p < s and q >= c for p, (_, q) in sure.items())}
        got = {frozenset(r["items"]): (r.confidence, r.pages) for r in url_rules.mine(pages, labels, 0.01, 0.3, 1.2, least).collect()}
        assert {s: c for s, (c, _) in got.items()} == pytest.approx(want) and want
        assert all(hold[s][0] == p for s, (_, p) in got.items())


def test_decontamination(spark):
    items = [(0, "A train with 3 carriages leaves Paris for Rome at 40 km per hour and Paris waits for the late train again"), (1, "one two"), (2, None), (None, "the quick brown fox jumps over one lazy dog tonight")]
    item = items[0][1]
    other = item.replace("Paris", "Oslo").replace("Rome", "Bern").replace("3", "17").replace("40 km", "9 miles")
    broken = item.replace("leaves Paris", "leaves Oslo").replace("3", "17")
    rows = [(0, f"Before. {item}. After", "s"), (1, f"Well, {other} and so on", "s"), (2, "nothing to see here at all today", "s"), (3, None, "s"), (4, "", "s"), (5, "they said the quick brown fox jumps over one lazy dog tonight", "s"), (6, "one two " * 30, "s"), (7, item[:50], "s"), (8, broken, "s")]
    rows.append(rows[0])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.flag(documents(spark, rows), bench).collect()}
    assert (got[0].contaminated, got[0].item_id, got[0].kind, got[0].coverage) == (True, 0, "verbatim", 1.0)
    assert (got[1].contaminated, got[1].item_id, got[1].kind) == (True, 0, "reparameterised")
    assert (got[5].contaminated, got[5].item_id) == (True, -1)
    assert not any(got[i].contaminated for i in (2, 3, 4, 6, 7))
    assert got[8].coverage < 1.0  # Paris became Oslo once only
    one = sorted(map(str, decontamination.flag(documents(spark, rows), bench).collect()))
    assert sorted(map(str, decontamination.flag(documents(spark, rows), bench, most_items=1).collect())) == one
    assert decontamination.flag(documents(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.flag(documents(spark, rows), bench.where("false")).collect())


def test_decontamination_of_placeholders_and_short_items(spark):
    items = [(0, "3 5 8 13 21 34 55 89 144"), (1, "Who Wrote The Old Man And The Sea"), (2, "One two"), (3, "...")]
    rows = [(0, "they count 3 5 8 13 21 34 55 89 144 and so on"), (1, "they count 4 6 9 14 22 35 56 90 145 and so on"), (2, "tell me: who wrote the old man and the sea"), (3, "One Two."), (4, "one two three"), (5, "!"), (6, "Tom Met Ann By Lake Como On May Day")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_id, r.kind, r.coverage) for r in decontamination.flag(documents(spark, [(*r, "s") for r in rows]), bench).collect()}
    assert {i: r for i, r in got.items() if r[0]} == {0: (True, 0, "verbatim", 1.0), 2: (True, 1, "verbatim", 1.0), 3: (True, 2, "verbatim", 1.0)}


def test_joined_items_match_each_with_each(spark):
    """Items that share windows, copies of parts of them, and one text with many items."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)] + ["Rome", "Oslo", "7", "12", "km"]
    common = rng.choices(vocabulary, k=9)
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(2, 14)) + (common if i % 3 else []))) for i in range(40)] + [(3, "x y z v w"), (90, "x y z v w"), (91, "Uno dos")]
    rows = []
    for i in range(60):
        own = rng.choice(items)[1].split()
        a = rng.randint(0, len(own) // 2)
        part = own[a : a + rng.randint(3, 14)]
        rows.append((i, " ".join(rng.choices(vocabulary, k=4) + part + rng.choices(vocabulary, k=rng.randint(0, 4))), "s"))
    rows += [(100, " ".join(t for _, t in items), "s"), (101, "uno, DOS!", "s"), (102, " ".join(common), "s"), (103, "x y z v w", "s")]
    bench = spark.createDataFrame([(i, t, "text", 1) for i, t in items], "item_id long, text string, kind string, _t1 int")
    got = {r.doc_id: (r.contaminated, r.n_items, r.item_id, round(r.coverage, 9), r.kind) for r in decontamination.flag(documents(spark, rows), bench).collect()}
    codes = decontamination.Codes()
    for i, text, _ in rows:
        w = text.encode().split()
        c = decontamination.coded(w, codes)
        t, found = decontamination.template_of(c), []
        for k, item in items:
            held = decontamination.Templates([(k, item.encode())])
            if len(w) < 5 or len(item.split()) < 5:
                if len(w) < 5 and decontamination.bare(w) == decontamination.bare(item.encode().split()):
                    found.append((-1.0, k, "verbatim"))
                continue
            share, same = held.check(0, held.hits(t, c & ~decontamination._FLAGS)[0], w, t)
            if share >= 0.5:
                found.append((-share, k, "verbatim" if same else "reparameterised"))
        best = min(found, default=(0.0, None, None))
        assert got[i] == (bool(found), len(found), best[1], round(-best[0], 9), best[2]), (i, text)
    assert got[100][1] > 20 and got[101][0] and got[103][2] == 3


def test_template_windows_match_brute_force():
    rng = random.Random(3)
    vocabulary = ["the", "a", "Rome", "Paris", "12", "7", "km", "kg", "runs", "to.", "from", "and"]
    items = [(i, " ".join(rng.choices(vocabulary, k=12)).encode()) for i in range(6)]
    held, codes = decontamination.Templates(items), decontamination.Codes()
    for _ in range(50):
        t = decontamination.template(" ".join(rng.choices(vocabulary, k=40)).encode().split(), codes)
        want = defaultdict(set)
        for k, own in enumerate(held.templates):
            for j in range(len(own) - 4):
                if decontamination.slots(own[j : j + 5]).sum() * 2 <= 5:
                    for i in range(len(t) - 4):
                        if (own[j : j + 5] == t[i : i + 5]).all():
                            want[k].add((i, j, 5))
        assert held.hits(t) == want


def test_warc_round_trip_and_audit(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{'body ' * (i * 40)}é</p>") for i in range(120)] + [(200, None, None), (None, "u", "h"), (7, "http://x/7", "again")], "page_id long, url string, html string")
    records = warc.from_pages(pages, per_file=50)
    files = defaultdict(list)
    for r in records.collect():
        files[r.file].append((r.offset, bytes(r.record)))
    for name, parts in files.items():
        data = b"".join(b for _, b in sorted(parts))
        assert [(at, data[at : at + n]) for at, n, _, _ in warc.parse(data)] == sorted(parts)
        (tmp_path / f"{name}.warc").write_bytes(data)
    assert warc.read_warc(spark, str(tmp_path)).count() == 123
    from pyspark.sql import functions as F

    broken = records.withColumn("record", F.when(F.col("page_id").isin(3, 77), F.lit(b"rot")).otherwise(F.col("record"))).where("page_id is null or page_id <> 50")
    broken = broken.unionByName(records.where("page_id = 9").withColumn("offset", F.lit(10**9).cast("long")))
    got = warc.fixity(records, broken).collect()
    assert sorted((r.page_id, r.status) for r in got if r.status in ("corrupt", "missing")) == [(3, "corrupt"), (50, "missing"), (77, "corrupt")]
    assert [r.offset for r in got if r.status == "extra"] == [10**9]
    for r in got:
        if r.status != "extra":
            assert r.digest == hashlib.sha256(dict(files[r.file])[r.offset]).hexdigest()
    assert {r.status for r in warc.fixity(records, records).collect()} == {"ok"}
    assert warc.fixity(records.where("false"), records.where("false")).count() == 0


def test_gzip_members_and_clashing_columns(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, f"http://x/{i}", "body" * i, "a", 0) for i in range(9)] + [(None, None, None, "a", 0)] * 2, "page_id long, url string, html string, file string, offset long")
    records = warc.from_pages(pages, per_file=4)
    parts = [bytes(r.record) for r in records.orderBy("file", "offset").collect()]
    packed = [gzip.compress(p) for p in parts]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(packed) + b"rest")
    got = sorted((r.offset, r.length, bytes(r.record)) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert got == [(sum(map(len, packed[:k])), len(packed[k]), parts[k]) for k in range(len(parts))]
    from pyspark.sql import functions as F

    own = records.withColumns({"status": F.lit("mine"), "name": F.lit("n"), "up": F.lit(1), "here": F.lit(2)})
    got = warc.fixity(own, records.where("page_id is null or page_id <> 3")).collect()
    assert sorted((r.page_id or -1, r.status, r.name, r.up) for r in got) == sorted([(-1, "ok", "n", 1)] * 2 + [(i or -1, "missing" if i == 3 else "ok", "n", 1) for i in range(9)])
    assert len({r.file for r in got if r.page_id is None}) == 1 and all(r.file < 0 for r in got if r.page_id is None)


def test_records_without_offset_are_not_verified(spark):
    records = spark.createDataFrame([("f", 0, b"one"), ("f", None, b"two"), (None, None, b"three"), (None, 0, b"four")], "file string, offset long, record binary")
    assert {bytes.fromhex(r.digest): r.status for r in warc.fixity(records, records).collect()} == {hashlib.sha256(x).digest(): s for x, s in ((b"one", "ok"), (b"two", "unchecked"), (b"three", "unchecked"), (b"four", "ok"))}


def test_word_hashes_tell_words_apart(monkeypatch):
    from cinesift.llm import common

    rng = random.Random(7)
    parts = ["a", "ab", "b", "é", "\xa0", "x" * 50] + [f"w{i}" for i in range(300)]
    data = "".join(rng.choice(parts) + rng.choice([" ", "\n", " \t", "\x0b "]) for _ in range(4000)).encode()
    h, at = common.word_hashes(data)
    split = data.split()
    assert [data[a : a + len(w)] for a, w in zip(at.tolist(), split, strict=True)] == split
    assert len({(w, x) for w, x in zip(split, h.tolist(), strict=True)}) == len(set(split)) == len(set(h.tolist()))
    monkeypatch.setattr(common, "_BLOCK", 40)
    assert (common.word_hashes(b"  " + data)[0] == h).all()
    assert len(common.word_hashes(b"")[0]) == len(common.word_hashes(b" \n")[0]) == 0


def test_very_long_texts(spark):
    rng = random.Random(13)
    long = " ".join(f"w{rng.randrange(5_000)}" for _ in range(40_000))
    rows = [(1, long, "s"), (2, "lead " + long, "s"), (3, "x" * 700_000, "s"), (4, "x" * 700_000, None), (5, "same " * 20_000, "s"), (6, "same " * 9_000, "s")]
    docs = documents(spark, rows)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup(docs).collect()}
    assert got == {1: (40_000, 0), 2: (40_001, 40_000), 3: (1, 0), 4: (1, 0), 5: (20_000, 0), 6: (9_000, 9_000)}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[2] == 1 and got[4] == 3 and got[6] == 5
    bench = spark.createDataFrame([(0, " ".join(long.split()[-30:])), (1, "x" * 700_000)], "item_id long, text string")
    got = {r.doc_id: r.item_id for r in decontamination.flag(docs, bench).collect() if r.contaminated}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality_rules.with_statistics(docs).collect()}
    assert got[5] == (20_000, 20_000) and got[3] == (1, 0) and got[1][0] == 40_000
