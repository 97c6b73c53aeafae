"""Substring deduplication: FM-indexes of the passages that documents share decide
which windows of words an earlier document has."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Scratch
from .common import gram_hashes, map_batches, mix64, utf8, word_hashes
from .fm_index import FMIndex, matched

#: Words of an anchor. Each window's anchor is the one of its runs of GRAM words
#: with the smallest hash, so equal windows have equal anchors.
GRAM = 16
#: Words of a document whose anchors are dealt to one index.
REGION = 256
#: Words that are searched in one part of a region's passages, and symbols of one index.
PART, SHARD = 100_000, 400_000
#: An anchor whose passages set so many of 64 bits has some 180 different ones or more.
CROWDED = 60
#: What a row of passages() is for: its words are indexed; searched; or dealt anew by whole windows.
OWN, QUERY, CROWD = 0, 1, 2


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest (the first of equals) of each `width` consecutive values is."""
    value, at, have = x, np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        n = max(len(value) - step, 0)
        left = value[:n] <= value[step:]
        value, at, have = np.where(left, value[:n], value[step:]), np.where(left, at[:n], at[step:]), have + step
    return at


def stretches(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """row, anchor, passage, first, n of each stretch of windows of a text that have one
    anchor. passage: a hash of the stretch's words."""
    h, at = word_hashes(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    row = np.searchsorted(ends, at, side="right")
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    g, whole = gram_hashes(h, gram), gram_hashes(h, window)
    at, inside = sliding_argmin(g, window - gram + 1), row[:n] == row[window - 1 :]
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1] | (row[1:n] != row[: n - 1])
    cuts = np.append(np.flatnonzero(new | ~inside), n)
    begins = np.searchsorted(cuts, first := np.flatnonzero(new))
    many = cuts[begins + 1] - first
    # Fewer windows than a window has words, so its first and last window hold the whole stretch.
    passage = mix64(whole[first] * np.uint64(0x9E3779B97F4A7C15) + whole[first + many - 1]) + many.astype(np.uint64)
    return row[first], g[at[first]].view(np.int64), passage.view(np.int64), first - np.searchsorted(row, row[first]), many


def occurrences(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, _text_hash, base, anchor, passage, first, n of every stretch of every text
    (doc_id, _text_hash, base, text)."""

    def make():
        def f(batch):
            row, anchor, passage, first, n = stretches(utf8(batch.column(3)), window, gram)
            own = [batch.column(i).take(pa.array(row)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(anchor), pa.array(passage), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "_text_hash", "base", "anchor", "passage", "first", "n"])

        return f

    return map_batches(texts, make, "doc_id long, _text_hash long, base int, anchor long, passage long, first int, n int")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", docs["doc_id"].cast("long")).withColumn("_text_hash", F.xxhash64("text"))


def copies(docs: DataFrame, occ: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """doc_id, _text_hash, start, stop (all words) of each document whose whole text, of `window`
    words or more, one with a smaller id has, by its digest: all of its windows start there.
    occ: stretches of first documents; the last one of a text ends where it does."""
    rows = docs.select("doc_id", "_text_hash", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    first = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "_text_hash")).alias("first"), F.max("doc_id").alias("high")).where("first.doc_id < high")
    size = occ.groupBy("doc_id", "_text_hash").agg(F.max(F.col("first") + F.col("n") + (window - 1)).alias("stop"))
    # Written, so that the join has a plain exchange on either side and Spark splits a hot digest's rows.
    first = scratch.keep(first.select("digest", "first.*").join(size.hint("merge"), ["doc_id", "_text_hash"]).select("digest", F.col("doc_id").alias("low"), "stop"), "copies")
    rows = rows.join(first.hint("merge"), "digest").where("doc_id > low")
    return rows.select("doc_id", "_text_hash", F.lit(0).alias("start"), "stop")


def once(occ: DataFrame) -> DataFrame:
    """Stretches of a text's first document alone: copies of it are searched nowhere."""
    return occ.groupBy(*[c for c in occ.columns if c != "doc_id"]).agg(F.min("doc_id").alias("doc_id")).select(*occ.columns)


def dealt(occ: DataFrame, window: int, crowds: bool, scratch: Scratch, part: int = PART) -> DataFrame:
    """doc_id, _text_hash, base, spans (array of first, n, region, parts, kind): the
    stretches whose anchor at least two documents have.

    An anchor's region is that of the first document that has it, and where in it, so the
    anchors that a copy shares with it lie in a few regions, as long runs. Anchors so
    common that those of a region have over `part` words to search are dealt in parts; the
    first stretch with each of their passages is then in its spans once more, to be
    indexed in all of them. If `crowds`, anchors with many different passages are of kind
    CROWD.
    """
    place = F.struct("doc_id", "first", "base", "_text_hash")
    spots = F.bit_or(F.expr("shiftleft(1L, cast(passage & 63 as int))"))
    per = occ.groupBy("anchor").agg(F.min(place).alias("low"), F.max("doc_id").alias("high"), spots.alias("spots"), F.sum(F.col("n") + (window - 1)).alias("size")).where("low.doc_id < high")
    region = F.xxhash64("low.doc_id", "low._text_hash", F.expr(f"(low.base + low.first) div {REGION}"))
    # A power of 4, so that neighbours mostly have the same; a region has some 16 anchors.
    over = F.greatest(F.ceil(F.log(4.0, F.col("size") * 16 / part)), F.lit(0))
    parts = F.pow(F.lit(4.0), over).cast("int")
    crowd = (F.bit_count("spots") >= CROWDED) if crowds else F.lit(False)
    # Written, so that joins have a plain exchange on either side, whose hot anchors Spark splits.
    per = scratch.keep(per.select("anchor", region.alias("region"), parts.alias("parts"), crowd.alias("crowd")), "anchors")
    shared = scratch.keep(occ.join(per, "anchor"), "shared")
    quiet = shared.where("not crowd")
    row = ["doc_id", "_text_hash", "base", "first", "n", "region", "parts"]
    first = quiet.where("parts > 1").groupBy("region", "parts", "anchor", "passage").agg(F.min(F.struct("doc_id", "_text_hash", "base", "first", "n")).alias("at"))
    spans = quiet.select(*row, F.lit(QUERY).alias("kind")).unionByName(first.select("at.*", "region", "parts", F.lit(OWN).alias("kind")))
    if crowds:
        crowd = shared.where("crowd").withColumns({"region": F.lit(0).cast("long"), "parts": F.lit(1)})
        spans = spans.unionByName(crowd.select(*row, F.lit(CROWD).alias("kind")))
    return spans.groupBy("doc_id", "_text_hash", "base").agg(F.collect_list(F.struct("first", "n", "region", "parts", "kind")).alias("spans"))


PASSAGES = "route long, kind int, doc_id long, _text_hash long, first int, words binary"


def passages(texts: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """PASSAGES: the words of the runs of stretches that are dealt to one region, which
    begin at word `first` of the document; those of kind OWN once for each part."""
    # Spans and runs grow with the corpus: never broadcast, so plans are alike at every size.
    rows = texts.join(spans.hint("merge"), ["doc_id", "_text_hash", "base"]).select("doc_id", "_text_hash", "base", "text", "spans")

    def make():
        def f(batch):
            docs, hashes, base = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lists = batch.column(4)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at, n, region, parts, kind = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
            order = np.lexsort((at, parts, region, kind, row))
            row, at, n, region, parts, kind = (x[order] for x in (row, at, n, region, parts, kind))
            alike = lambda: np.logical_and.reduce([x[1:] == x[:-1] for x in (row, kind, region, parts)])
            once = np.concatenate([[True], ~(alike() & (at[1:] == at[:-1]))])  # repeated rows
            row, at, n, region, parts, kind = (x[once] for x in (row, at, n, region, parts, kind))
            first = np.flatnonzero(np.concatenate([[True], ~(alike() & (at[1:] == at[:-1] + n[:-1]))])) if len(row) else np.zeros(0, np.int64)
            ends = (at + n + window - 1)[np.append(first[1:], len(row)) - 1] if len(row) else first
            words = [t.split() for t in utf8(batch.column(3))]
            out: list[tuple] = []
            for r, k, a, e, g, p in zip(*(x.tolist() for x in (row[first], kind[first], at[first], ends, region[first], parts[first])), strict=True):
                text = b" ".join(words[r][a:e])
                d, h, a = int(docs[r]), int(hashes[r]), a + int(base[r])
                for j in range(p) if k == OWN else [h % p]:
                    out.append((route(g, p, j), k, d, h, a, text))
                if len(out) >= 1024:
                    yield passages_batch(out)
                    out = []
            if out:
                yield passages_batch(out)

        return f

    return map_batches(rows, make, PASSAGES)


def route(region: int, parts: int, part: int) -> int:
    return region if parts == 1 else int.from_bytes(hashlib.blake2b(f"{region} {parts} {part}".encode(), digest_size=8).digest(), "big", signed=True)


def passages_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["route", "kind", "doc_id", "_text_hash", "first", "words"])


class Held:
    """The passages of some whole routes, each distinct one once, until they are searched."""

    def __init__(self, window: int):
        self.window, self.size = window, 0
        self.texts: dict[bytes, int] = {}
        self.owner: list[int | None] = []  # by text: the smallest doc_id of its rows that are indexed
        self.rows: list[tuple[int, int, int, int]] = []  # text, doc_id, _text_hash, first
        self.low: list[int] = []  # by row: the smallest doc_id that its route indexes
        self.route: list[tuple] = []

    def add(self, row: tuple) -> None:
        if not self.route or row != self.route[-1]:  # repeated rows follow each other
            self.route.append(row)

    def close(self) -> None:
        """The route's rows are all there. Those of kind OWN are indexed; if it has none, all are."""
        if not self.route:
            return
        own = [r for r in self.route if r[1] == OWN] or self.route
        low = min(r[2] for r in own)
        for r in own:
            k = self.text(r[5])
            self.owner[k] = r[2] if self.owner[k] is None else min(self.owner[k], r[2])
        for r in self.route:
            if r[1] == QUERY and r[2] > low:  # the first document of a route has no earlier one
                self.rows.append((self.text(r[5]), r[2], r[3], r[4]))
                self.low.append(low)
        self.route = []

    def text(self, words: bytes) -> int:
        if (k := self.texts.get(words)) is None:
            k = self.texts[words] = len(self.texts)
            self.owner.append(None)
            self.size += words.count(b" ") + 2
        return k

    def search(self) -> pa.RecordBatch:
        """doc_id, _text_hash, start, stop: the runs of words that windows cover which the
        index has in a smaller doc_id.

        Rows with equal words are searched twice at most: for the smallest of their
        documents, and for the others, for which that one counts as well. All of a query's windows
        are searched backwards in the index, which alone decides.
        """
        ids: dict[bytes, int] = {}
        put = ids.setdefault
        coded = [np.array([put(w, len(ids) + 1) for w in t.split(b" ")], np.int64) for t in self.texts]
        length = np.array([len(c) for c in coded], np.int64)
        start = before(length + 1)
        symbols = np.zeros(int((length + 1).sum()), np.int64)
        for c, s in zip(coded, start.tolist(), strict=True):
            symbols[s : s + len(c)] = c
        del coded
        inside = np.array([o is not None for o in self.owner])
        order, rank = np.unique(np.array([o for o in self.owner if o is not None], np.int64), return_inverse=True)
        text, doc, hashed, first = (np.array(x, np.int64) for x in zip(*self.rows, strict=True))
        smallest = np.full(len(length), np.iinfo(np.int64).max)
        np.minimum.at(smallest, text, doc)
        # A query for each distinct text, and for whether its row is of a later document.
        keys, which = np.unique(text * 2 + (doc > smallest[text]), return_inverse=True)
        q, later = keys // 2, keys % 2 == 1
        limit = np.searchsorted(order, smallest[q], side="left") + (later & np.isin(smallest[q], order))

        # All windows of a query are one run; queries without an earlier owner have none to find.
        query = np.flatnonzero(limit > 0)
        begin, size = np.zeros(len(query), np.int64), length[q[query]] + 1  # and the separator
        at = before(size)
        from_ = np.repeat(start[q[query]] + begin - at, size) + np.arange(int(size.sum()))
        held = symbols[from_]
        held[at + size - 1] = 0
        kept = np.repeat(inside, length + 1)
        index = FMIndex(symbols[kept], np.repeat(rank, length[inside] + 1), len(ids) + 1, int(size.max(initial=1)), len(order))
        gone = matched(index, held, at, size - 1, limit[query], self.window)
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        on, off = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a separator ends each query
        run = np.searchsorted(at, on, side="right") - 1
        on, off, query = on - at[run] + begin[run], off - at[run] + begin[run], query[run]
        # Each row gets what its query found.
        n = np.bincount(query, minlength=len(q))
        row = np.repeat(np.arange(len(doc)), n[which])
        found = np.repeat(before(n)[which] - before(n[which]), n[which]) + np.arange(len(row))
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(hashed[row]), pa.array((first[row] + on[found]).astype(np.int32)), pa.array((first[row] + off[found]).astype(np.int32))], names=["doc_id", "_text_hash", "start", "stop"])


def before(n: np.ndarray) -> np.ndarray:
    """The sum of all n before each."""
    return np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)


def searcher(window: int, shard: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, route = Held(window), None
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                for row in zip(*(c.to_pylist() for c in batch.slice(a, 1024).columns), strict=True):
                    if row[0] != route:
                        held.close()
                        if held.size > shard or len(held.rows) > shard // 8:
                            if held.rows:
                                yield held.search()
                            held = Held(window)
                        route = row[0]
                    held.add(row)
        held.close()
        if held.rows:
            yield held.search()

    return run


def found(rows: DataFrame, window: int, shard: int = SHARD) -> DataFrame:
    """doc_id, _text_hash, start, stop of runs of words, from PASSAGES of kinds OWN and QUERY.

    A task packs whole routes into indexes of about `shard` symbols and holds one of
    them at a time, with the rows that are searched in it."""
    rows = rows.repartition("route").sortWithinPartitions("route", "kind", "doc_id", "_text_hash", "first")
    return rows.mapInArrow(searcher(window, shard), "doc_id long, _text_hash long, start int, stop int")


def repeated(docs: DataFrame, window: int = 50, gram: int = GRAM, part: int = PART, shard: int = SHARD) -> DataFrame:
    """doc_id, _text_hash, _hits (array of start, stop): the runs of words of each
    document that windows cover whose word sequence also starts in a document with a
    smaller doc_id. Documents without such windows have no row.

    Hashes deal passages to indexes, and backward search in those decides each window. Only the
    first document of equal texts is searched: the others' windows all start in it. Windows whose anchor has many different
    passages (as a common line in many surroundings) are dealt anew, by a hash of the
    whole window, and those that one document has go no further.
    """
    if not 0 < gram <= window:
        raise ValueError(f"an anchor of {gram} words in a window of {window}")
    with Scratch(docs.sparkSession) as scratch:
        texts = keyed(docs).where("doc_id is not null").select("doc_id", "_text_hash", F.lit(0).alias("base"), F.col("text"))
        occ = scratch.keep(once(occurrences(texts, window, gram)), "occurrences")
        rows = scratch.keep(passages(texts, dealt(occ, window, True, scratch, part), window), "passages")
        runs = [found(rows.where(F.col("kind") != CROWD), window, shard)]
        crowd = rows.where(F.col("kind") == CROWD).select("doc_id", "_text_hash", F.col("first").alias("base"), F.col("words").cast("string").alias("text"))
        if not crowd.isEmpty():
            whole = scratch.keep(once(occurrences(crowd, window, window)), "windows")
            runs.append(found(passages(crowd, dealt(whole, window, False, scratch, part), window), window, shard))
        out = reduce(DataFrame.unionByName, [*runs, copies(texts, occ, window, scratch)])
        hits = out.distinct().groupBy("doc_id", "_text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("_hits"))
        return scratch.result(hits, "repeated")


def covered(n: int, hits: list[dict]) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    for h in hits:
        change[h["start"]] += 1
        change[h["stop"]] -= 1
    return np.cumsum(change)[:n] > 0


def dedup(docs: DataFrame, window: int = 50, gram: int = GRAM, prefix: str = "") -> DataFrame:
    """Every row of docs with n_words, n_removed, kept_sha256 and kept_text (names
    after `prefix`).

    Removed is each word that a window of `window` words covers whose word sequence
    also starts in a document with a smaller doc_id; all are judged on the input.
    Passages that share an anchor are dealt to one FM-index, and backward search in it
    decides each of their windows.
    kept_sha256 is of the kept words joined by one space; kept_text is the text
    itself without the removed words and the white space after them.

    Null texts: no words, kept_text null. Null ids: nothing is removed from such
    rows, and they remove nothing. Repeated rows have equal ids, so they don't
    remove each other. Texts under `window` words stay. No rows: no rows. Columns
    named like those added, and _text_hash and _hits, are replaced; others stay.
    """
    found = repeated(docs, window, gram)
    own = [prefix + c for c in ("n_words", "n_removed", "kept_sha256", "kept_text")]
    rows = keyed(docs.drop(*own, "_text_hash", "_hits"))
    other = [c for c in rows.columns if c != "_text_hash"]
    rows = rows.join(found.hint("merge"), ["doc_id", "_text_hash"], "left").select(*other, "_hits")
    at = other.index("text")

    def make():
        word = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")

        def f(batch):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            n_words, n_removed, sha, kept_text = [], [], [], []
            for text, hits in zip(texts, batch.column(len(other)).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = covered(len(words), hits) if hits else None
                if gone is not None and gone.any():
                    pieces = word.findall(text)
                    head = text[: len(text) - sum(map(len, pieces))]
                    kept_text.append(head + b"".join(p for p, g in zip(pieces, gone, strict=True) if not g))
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                    n_removed.append(int(gone.sum()))
                else:
                    kept_text.append(text)
                    n_removed.append(0)
                n_words.append(len(words) + n_removed[-1])
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            arrays = [*batch.columns[: len(other)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha), pa.array(kept_text, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*other, *own])

        return f

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != "_hits")
    return map_batches(rows, make, kinds + ", " + ", ".join(f"`{c}` {k}" for c, k in zip(own, ("long", "long", "string", "string"), strict=True)))
