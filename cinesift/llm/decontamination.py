"""Benchmark decontamination by templates: numbers, names and units are placeholders."""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Scratch
from .common import gram_hashes, map_batches, mix64, utf8

WINDOW = 5
#: Units that count as such right after a number.
UNITS = frozenset(b"m km cm mm mi ft in yd g kg mg lb lbs oz l ml s sec secs min mins h hr hrs day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent cents percent degree degrees km/h mph kb mb gb tb".split())
_EDGE = b".,;:!?\"'()[]{}<>*#&|-_~`/\\%"
_NUMBER = re.compile(rb"[+-]?[$\xc2\xa3\xe2\x82\xac]*\d[\d.,:/]*(?:st|nd|rd|th)?")
_JOINED = re.compile(rb"([+-]?\d[\d.,]*)([a-z/]+)")
_DIGIT = re.compile(rb"\d").search
#: Low bits of a word's code; the others are of a hash of its lower-case form.
NUMBER, UNIT, CAPITAL, ENDS = 1, 2, 4, 8
_FLAGS = np.uint64(15)
NUM, NAME, UNT = np.uint64(0x1E35A7BD00000010), np.uint64(0x5D588B6500000020), np.uint64(0x77A1C7E300000030)


class Codes(dict):
    """word (bytes) -> code; forgotten when MOST words are held."""

    MOST = 100_000

    def __init__(self):
        super().__init__()
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.MOST:
            self.clear()
        core = word.strip(_EDGE)
        low = core.lower()
        number = False
        if _DIGIT(low):
            joined = _JOINED.fullmatch(low)
            number = bool(_NUMBER.fullmatch(low)) or bool(joined and joined[2] in UNITS)
        capital = len(core) > 1 and core[:1].isupper() and core[1:] == core[1:].lower()
        flags = NUMBER * number | UNIT * (low in UNITS) | CAPITAL * capital | ENDS * (word[-1:] in b".!?:")
        out = self[word] = (self.hash(low) & ~15) | flags
        return out


def template(words: list[bytes], codes: Codes) -> np.ndarray:
    """Hashes of a text's words, with one value for all numbers, one for all units
    after a number, and one for all names: capitalised words inside a sentence."""
    return template_of(coded(words, codes))


def coded(words: list[bytes], codes: Codes) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))


def template_of(c: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """first: where texts begin, if the codes are of several, one after the other."""
    flags = (c & _FLAGS).astype(np.uint8)
    out = c & ~_FLAGS
    number, inside = flags & NUMBER > 0, np.zeros(len(c), bool)
    after = np.zeros(len(c), bool)
    inside[1:] = flags[:-1] & ENDS == 0
    after[1:] = number[:-1]
    if first is not None:
        inside[first] = after[first] = False
    out[(flags & CAPITAL > 0) & inside] = NAME
    out[(flags & UNIT > 0) & after] = UNT
    out[number] = NUM
    return out


def bare(words: list[bytes]) -> bytes:
    """The words in lower case without the characters at their edges."""
    return b" ".join(w.strip(_EDGE).lower() for w in words)


def slots(t: np.ndarray) -> np.ndarray:
    return (t == NUM) | (t == NAME) | (t == UNT)


class Templates:
    """The windows of a block of benchmark items, sorted by hash.

    A window holds `window` words, or all of an item that has fewer. Windows of which
    over half are placeholders are too general as templates: they are kept by their
    words themselves, in lower case. Items with under five words have no windows; they
    are kept whole.
    """

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        codes = Codes()
        self.ids = [i for i, _ in items]
        self.words = [t.split() for _, t in items]
        plain = [coded(w, codes) for w in self.words]
        self.templates = [template_of(c) for c in plain]
        self.short: dict[bytes, list[int]] = defaultdict(list)
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        verbatim: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            if len(t) < 5:
                if (key := bare(self.words[k])).strip():
                    self.short[key].append(k)
                continue
            width = min(window, len(t))
            h = gram_hashes(t, width)
            fixed = np.lib.stride_tricks.sliding_window_view(~slots(t), width).sum(1) * 2 >= width
            at = np.flatnonzero(fixed)
            found[width].append((h[at], np.full(len(at), k), at))
            if len(at := np.flatnonzero(~fixed)):
                verbatim[width].append((gram_hashes(plain[k] & ~_FLAGS, width)[at], np.full(len(at), k), at))
        self.by_width, self.verbatim = self.table(found), self.table(verbatim)

    @staticmethod
    def table(found: dict[int, list[tuple[np.ndarray, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
        out = {}
        for width, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            out[width] = (h[order], item[order], at[order])
        return out

    def hits(self, t: np.ndarray, plain: np.ndarray | None = None) -> dict[int, set[tuple[int, int, int]]]:
        """Of each item, (place in the text, place in the item, width) of equal windows;
        plain: the words' own hashes, for windows that are kept by their words."""
        out: dict[int, set] = defaultdict(set)
        tables = [(t, x) for x in self.by_width.items()]
        if plain is not None:
            tables += [(plain, x) for x in self.verbatim.items()]
        for values, (width, (known, item, at)) in tables:
            h = gram_hashes(values, width)
            if not len(h) or not len(known):
                continue
            left = np.searchsorted(known, h)
            here = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == h)
            for i in here.tolist():
                j = int(left[i])
                while j < len(known) and known[j] == h[i]:
                    out[int(item[j])].add((i, int(at[j]), width))
                    j += 1
        return out

    def check(self, k: int, hits: set[tuple[int, int, int]], words: list[bytes], t: np.ndarray) -> tuple[float, bool]:
        """The share of item k's words that lie in windows found, and whether all
        their slots have the item's own values.

        Windows that lie along one shift are one copy. Its slots must be consistent:
        the same value in the item always has the same value in the text, and
        different ones different, in either case; from the first that isn't, the copy
        counts no more.
        """
        n, own = len(self.words[k]), self.words[k]
        covered, same = np.zeros(n, bool), True
        shifts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, j, width in hits:
            shifts[i - j].append((j, j + width))
        slot = slots(self.templates[k])
        for shift in sorted(shifts, key=lambda s: (-len(shifts[s]), s)):
            part = np.zeros(n, bool)
            for a, b in shifts[shift]:
                part[a:b] = True
            there, back = {}, {}
            for j in np.flatnonzero(part & slot).tolist():
                a, b = own[j].strip(_EDGE).lower(), words[shift + j].strip(_EDGE).lower()
                if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                    part[j:] = False
                    break
                same &= a == b
            covered |= part
        return float(covered.mean()) if n else 0.0, same

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """width, keys and places of the windows of the one item that this holds."""
        for kind, tables in ((TEMPLATE, self.by_width), (VERBATIM, self.verbatim)):
            for width, (h, _, at) in tables.items():
                yield width, window_keys(h, kind, width), at


#: Kinds of a window's key: of a template, of words themselves, of a whole short text.
TEMPLATE, VERBATIM, SHORT = 1, 2, 3


def window_keys(h: np.ndarray, kind: int, width: int) -> np.ndarray:
    return mix64(h + np.uint64(kind * 1_000_003 + width * 101)).view(np.int64)


def short_key(words: list[bytes], codes: Codes) -> np.ndarray:
    return window_keys(np.array([codes.hash(bare(words))], np.uint64), SHORT, 0)


def telling(keys: np.ndarray, often: np.ndarray, at: np.ndarray, width: np.ndarray, n: int, least: float) -> np.ndarray:
    """Which windows of an item of n words can't all be missing from a copy: the rarest,
    so many that the others cover less than `least` of its words."""
    covers = np.zeros(n, np.int64)
    for a, w in zip(at.tolist(), width.tolist(), strict=True):
        covers[a : a + w] += 1
    left, out = int((covers > 0).sum()), np.zeros(len(keys), bool)
    for k in np.lexsort((at, keys, often)).tolist():
        if left < least * n:
            break
        out[k] = True
        part = covers[at[k] : at[k] + width[k]]
        part -= 1
        left -= int((part == 0).sum())
    return out


def seeds(items: DataFrame, window: int, least: float) -> DataFrame:
    """key, item of the windows by which items are found. items: item, item_id, text."""

    def make():
        codes = Codes()

        def f(batch):
            out = [[], [], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held = Templates([(0, text)], window)
                found = [(w, k, at) for w, k, at in held.windows() if len(k)]
                found += [(0, short_key(held.words[0], codes), np.zeros(1, np.int64))] if held.short else []
                for width, keys, at in found:
                    for to, x in zip(out, (np.full(len(keys), item), keys, at, np.full(len(keys), width), np.full(len(keys), len(held.words[0]))), strict=True):
                        to.append(x)
            cols = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "key", "at", "width", "n"])

        return f

    rows = map_batches(items.select("item", "text"), make, "item long, key long, at long, width long, n long")
    often = rows.groupBy("key").agg(F.count_distinct("item").alias("often"))
    by_item = rows.join(often, "key").groupBy("item", "n").agg(F.collect_list(F.struct("key", "often", "at", "width")).alias("windows"))

    def choose():
        def f(batch):
            out = [[], []]
            for item, n, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, often, at, width = (np.array([w[c] for w in windows], np.int64) for c in ("key", "often", "at", "width"))
                good = (width == 0) | telling(keys, often, at, width, n, least)
                keys = np.unique(keys[good])
                out[0].append(keys)
                out[1].append(np.full(len(keys), item))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], names=["key", "item"])

        return f

    return map_batches(by_item, choose, "key long, item long")


#: Bits of the sketch of all keys: a megabyte, whatever the benchmark's size.
SKETCH = 1 << 23


def sketch_places(keys: np.ndarray) -> list[np.ndarray]:
    h = keys.view(np.uint64)
    return [(x & np.uint64(SKETCH - 1)).astype(np.int64) for x in (h, h >> np.uint64(23), mix64(h))]


def sketch(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column key. Parts are made in tasks, and only their words that
    aren't zero are added up, so the driver gets a megabyte at most."""

    def run(batches):
        bits = np.zeros(SKETCH, bool)
        for batch in batches:
            for at in sketch_places(batch.column(0).to_numpy(zero_copy_only=False)):
                bits[at] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

    words = keys.select("key").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    out = np.zeros(SKETCH // 64, np.int64)
    out[words["at"].to_numpy()] = words["word"].to_numpy()
    return out


def in_sketch(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in sketch_places(keys):
        out &= (held[at >> 6] >> (at & 63)) & 1 > 0
    return out


def candidates(texts: DataFrame, held: np.ndarray, widths: list[int], window: int) -> DataFrame:
    """_t1, _t2, text, keys of the texts with windows that the sketch may hold."""

    def make():
        codes = Codes()

        def f(batch):
            texts = utf8(batch.column(2))
            words = [t.split() for t in texts]
            size = np.array([len(w) for w in words], np.int64)
            row = np.repeat(np.arange(len(words)), size)
            c = coded([x for w in words for x in w], codes)
            first = (np.cumsum(size) - size)[size > 0]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for kind, values in ((TEMPLATE, template_of(c, first)), (VERBATIM, c & ~_FLAGS)):
                for width in widths:
                    if (n := len(c) - width + 1) <= 0:
                        continue
                    keys = window_keys(gram_hashes(values, width), kind, width)
                    good = np.flatnonzero(in_sketch(held, keys) & (row[:n] == row[width - 1 :]))
                    found.append((row[good], keys[good]))
            short = [i for i, w in enumerate(words) if 0 < len(w) < 5]
            if short:
                keys = np.concatenate([short_key(words[i], codes) for i in short])
                good = in_sketch(held, keys)
                found.append((np.array(short)[good], keys[good]))
            rows, keys = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            order = np.lexsort((keys, rows))
            rows, keys = rows[order], keys[order]
            once = np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]) if len(rows) else np.zeros(0, bool)
            rows, keys = rows[once], keys[once]
            at, n = np.unique(rows, return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(at)) for x in batch.columns), lists], names=["_t1", "_t2", "text", "keys"])

        return f

    return map_batches(texts.select("_t1", "_t2", "text"), make, "_t1 long, _t2 long, text string, keys array<long>", rows=64)


def verified(pairs: DataFrame, window: int, least: float) -> DataFrame:
    """_t1, _t2, n, share, item_id, kind for rows (_t1, _t2, text, items): how many of the
    items the text has a copy of, and of those the one most covered (the smallest id of equals)."""

    def make():
        codes = Codes()

        @functools.lru_cache(maxsize=2_000)
        def item(text: bytes) -> Templates:
            return Templates([(0, text)], window)

        def judge(words, bare_text, items):
            c = coded(words, codes)
            t = template_of(c)
            for i in items:
                held = item(i["text"].encode())
                if len(words) < 5:
                    if bare_text in held.short:
                        yield -1.0, i["item_id"], "verbatim"
                    continue
                for k, hits in held.hits(t, c & ~_FLAGS).items():
                    share, same = held.check(k, hits, words, t)
                    if share >= least:
                        yield -share, i["item_id"], "verbatim" if same else "reparameterised"

        def f(batch):
            out = []
            for t1, t2, text, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                found = list(judge(words, bare(words) if len(words) < 5 else b"", items))
                if found:
                    share, item_id, kind = min(found)
                    out.append((t1, t2, len(found), -share, item_id, kind))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string())
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_t1", "_t2", "n", "share", "item_id", "kind"])

        return f

    return map_batches(pairs.select("_t1", "_t2", "text", "items"), make, "_t1 long, _t2 long, n long, share double, item_id long, kind string")


def copies(texts: DataFrame, benchmark: DataFrame, window: int, least: float, most_items: int) -> DataFrame:
    """_t1, _t2, n, best (share, less, kind) of the texts (_t1, _t2, text) that have a copy of an item."""
    with Scratch(texts.sparkSession) as scratch:
        items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text")).dropna(subset=["text"])
        items = scratch.keep(items.distinct().withColumn("item", F.xxhash64("item_id", "text")), "items")
        keys = scratch.keep(seeds(items, window, least), "seeds")
        found = scratch.keep(candidates(texts, sketch(keys), list(range(min(5, window), window + 1)), window), "candidates")
        # The hash join: keys of texts, each once for a text, with those of items.
        hits = found.select("_t1", "_t2", F.explode("keys").alias("key")).distinct()
        pairs = scratch.keep(hits.join(keys, "key").select("_t1", "_t2", "item").distinct(), "pairs")
        parts = pairs.groupBy("_t1", "_t2").agg(F.ceil(F.count("*") / most_items).cast("int").alias("parts"))
        lists = pairs.join(parts, ["_t1", "_t2"]).withColumn("part", F.pmod("item", F.col("parts").cast("long")))
        lists = lists.join(items, "item").groupBy("_t1", "_t2", "part").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
        whole = found.groupBy("_t1", "_t2").agg(F.first("text").alias("text"))
        rows = verified(lists.join(whole, ["_t1", "_t2"]), window, least)
        best = F.max(F.struct("share", (-F.col("item_id")).alias("less"), "kind"))
        return scratch.result(rows.groupBy("_t1", "_t2").agg(F.sum("n").alias("n"), best.alias("best")), "contaminated")


def flag(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = 0.5, most_items: int = 256, prefix: str = "") -> DataFrame:
    """docs with contaminated, n_items, item_id, coverage and kind (names after `prefix`).

    Contaminated is a text that has windows of an item's template over at least
    `least` of the item's words, with consistent slots; windows of mostly placeholders
    count where their words are equal, in either case.

    Texts are joined with items on hashes of windows: of those of an item, the rarest
    without which no copy can be. Windows of texts that no item has are left out before
    the join by a sketch of a fixed size, which lets more through where a benchmark has
    over a million windows, but loses none. Each pair is checked on the texts themselves,
    with at most about `most_items` items at a time.

    Null and empty texts and items: nothing is found. Items of under five words are
    found in texts that consist of them alone; inside of a longer text they are too
    short to tell. Items with null ids count as id -1; repeated rows of the benchmark are
    one item. Repeated rows are judged alike. No rows: no rows. Columns named like those
    added, or _t1 and _t2, are replaced; other columns stay.
    """
    names = ["n_items", "item_id", "coverage", "kind"]
    docs = docs.drop(*[prefix + c for c in ("contaminated", *names)], "_t1", "_t2")
    keyed = docs.withColumns({"_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit(1), "text")})
    found = copies(keyed.where("text is not null"), benchmark, window, least, most_items)
    rows = keyed.join(found.select("_t1", "_t2", F.col("n").alias("_n"), F.col("best").alias("_best")), ["_t1", "_t2"], "left")
    total = F.coalesce("_n", F.lit(0)).cast("long")
    added = {"contaminated": total > 0, "n_items": total, "item_id": -F.col("_best.less"), "coverage": F.coalesce("_best.share", F.lit(0.0)), "kind": F.col("_best.kind")}
    return rows.select(*docs.columns, *[c.alias(prefix + name) for name, c in added.items()])
