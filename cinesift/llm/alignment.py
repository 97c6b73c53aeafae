"""Alignment of two tokenizers' tokens: where tokens of both end cuts a text into groups,
and tokens of one group are linked."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import Scratch
from .common import map_batches

#: Stretches that are broadcast, and bytes of the longest of them; pairs that are broadcast.
#: The others are joined.
FREQUENT, LONGEST, PAIRS = 1 << 17, 32, 1 << 18
#: Both tokenizers begin a token at a space between these.
_BETWEEN = re.compile(" (?=[!-~¡-ɏ])(?<=[^ ] )")
#: A space that they may not begin a token at.
_ODD = re.compile(" (?![!-~¡-ɏ])")
#: Letters; signs, digits and white space that neither tokenizer puts behind a letter in one token; those of
#: them but an apostrophe that none has before a letter.
LETTER, SIGN, BARE = "A-Za-zÀ-ÖØ-öø-ɏ", "\\t\\n\\r!-@\\[-`{-~", "!-&(-@\\[-`{-~"
_SURE = " [!-~¡-ɏ]"
#: A stretch: letters, or signs and at most one line feed (of two before a letter A takes the first alone), up to where
#: tokens surely end; else all up to a space where they do.
_STRETCH = re.compile(f" ?[{LETTER}]++(?=[{SIGN}]|{_SURE}|\\Z)| ?[{BARE}]++\\n?+(?=[{LETTER}]|{_SURE}|\\Z)|(?s:.+?)(?:(?<=[^ ])(?={_SURE})|\\Z)")
#: Characters that are encoded at once, and of texts that are put together at once; stretches that are encoded as one text.
AT_ONCE, TOGETHER, JOINED = 1 << 18, 1 << 20, 256
#: Groups longer than this as text are read one by one, and equal links of a group counted before they are made.
LIGHT = 1024
#: Texts are put together in so many turns, so a part of them at once has its stretches and records on disk.
TURNS = 4


class Tokenizers:
    """A byte-level vocabulary (A) and one of pieces (B), and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        bytes_of = {c: x for x, c in byte_characters().items()}
        n = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(bytes_of.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(n)]
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.vocab_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int32) for v in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of A and B of each text, which begins with a space (that B adds itself)."""
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return a, self.b.encode([t[1:] for t in texts], num_threads=1)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, the others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {x: chr(x) for x in own} | {x: chr(0x100 + i) for i, x in enumerate(sorted(set(range(256)) - set(own)))}


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def certain(a: str, b: str) -> bool:
    """Whether texts can be cut at single spaces before words without changing a token: A splits
    texts there before it merges bytes, and B has no piece with a space behind another character."""
    with open(a, encoding="utf-8") as f:
        made = json.load(f)
    before, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    if not plain or made.get("normalizer") is not None or model.get("type") != "BPE" or model.get("dropout"):
        return False
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=b)
    return not any(re.search("[^▁]▁", pieces.id_to_piece(i)) for i in range(pieces.vocab_size()))


def apart(b: str) -> bool:
    """Whether B has no piece in which a letter meets a sign, so words can be cut there: A splits
    texts at all ends of letters, and before letters if there is neither a space nor an apostrophe."""
    from sentencepiece import SentencePieceProcessor

    of = SentencePieceProcessor(model_file=b)
    pieces = (of.id_to_piece(i) for i in range(of.vocab_size()) if not (of.is_control(i) or of.is_unknown(i) or of.is_byte(i)))
    return not any(re.search(f"[{LETTER}][{SIGN}]|[{BARE}\\t\\n\\r][{LETTER}]", piece) for piece in pieces)


def cut(text: str | None, split: int) -> list[str]:
    """The stretches of a text with a space before it; none of an empty text. split: 0 leaves it
    whole, 1 cuts it at spaces, 2 where letters begin or end as well."""
    if not text:
        return []
    if split > 1:
        return _STRETCH.findall(" " + text)
    if not split:
        return [" " + text]
    return [" " + word for word in (_BETWEEN.split(text) if text[0] == " " or _ODD.search(text) else text.split(" "))]


def cut_once(texts: list[str | None], split: int, known: Iterable[str] = ()) -> list[str]:
    """The stretches of each distinct word of texts that isn't known."""
    words: set[str] = set()
    out: list[str] = []
    for text in texts:
        if split > 1 and text and "\0" not in text and not _ODD.search(" " + text):
            words.update((" " + text).replace(" ", "\0 ").split("\0"))
        else:
            out.extend(set(cut(text, split)))
    # All of these words begin with a space that they may be cut at.
    return out + _STRETCH.findall("".join(words.difference(known)))


def distinct_stretches(docs: DataFrame, split: int) -> DataFrame:
    """stretch, n: each distinct one of all texts; n, by which common ones are found, is in how many words
    it is, where a word is counted once for the texts of a batch."""

    def make():
        def f(batch):
            n = Counter(cut_once(batch.column(0).to_pylist(), split))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["stretch", "n"])

        return f

    return map_batches(docs.select("text"), make, "stretch string, n long", rows=2048).groupBy("stretch").agg(F.sum("n").alias("n"))


TOKENS = "a array<int>, a_len array<int>, b array<int>, b_len array<int>"


_FIRST = frozenset(map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x250))))


def encode_each(both: Tokenizers, stretches: list[str], split: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """ok of each stretch, and for either side the tokens of all and where those of each one end.

    Where tokens surely end, stretches needn't be encoded one by one: JOINED of them are one text, in which
    a word stands before each that has no space. Bytes and ends of tokens are checked; if they aren't
    those of the stretches, these are encoded in halves.
    """
    # Glued to the word before it a stretch is a letter's sign or a sign's letter.
    before = ["" if s[0] == " " else " ." if s[0].isalpha() else " a" for s in stretches]
    inner = [i for i, s in enumerate(stretches) if s[-1] != " " and (s[0] != " " or s[1:2] in _FIRST)] if split else []
    todo = [inner[i : i + JOINED] for i in range(0, len(inner), JOINED)]
    todo += [[i] for i in sorted(set(range(len(stretches))).difference(inner))]
    size = np.array([[len(x) for x in before], [len(s.encode()) for s in stretches]], np.int64).reshape(2, -1)
    ok = np.zeros(len(stretches), bool)
    done: list[tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]] = []
    while todo:
        texts = ["".join(x for i in some for x in (before[i], stretches[i])) for some in todo]
        left = []
        for some, text, *ids in zip(todo, texts, *both.encode(texts), strict=True):
            whole, sides = text.encode(), []
            high = np.cumsum(size[:, some].sum(axis=0))
            low = high - size[1, some]
            for own, of, lengths in zip(ids, (both.a_bytes, both.b_bytes), (both.a_size, both.b_size), strict=True):
                if b"".join(map(of.__getitem__, own)) != whole:
                    break
                own = np.array(own, np.int32)
                ends = np.concatenate([[0], np.cumsum(lengths[own])])
                first, last = np.searchsorted(ends, low), np.searchsorted(ends, high)
                if (ends[first] != low).any() or (ends[last] != high).any():
                    break
                sides.append((own[spread(first, last)], last - first))
            if len(sides) == 2:
                ok[some] = True
                done.append((some, sides))
            elif len(some) > 1:
                left += [some[: len(some) // 2], some[len(some) // 2 :]]
        todo = left
    order = np.array([i for some, _ in done for i in some], np.int64)
    out = []
    for side in (0, 1):
        n = np.concatenate([np.zeros(0, np.int64), *(sides[side][1] for _, sides in done)])
        ids = np.concatenate([np.zeros(0, np.int32), *(sides[side][0] for _, sides in done)])
        of, count = np.zeros((2, len(stretches)), np.int64)
        of[order], count[order] = np.cumsum(n) - n, n
        out.append((ids[spread(of, of + count)], np.cumsum(count)))
    return ok, out


def encoded(stretches: DataFrame, a: str, b: str, split: int) -> DataFrame:
    """stretch, n, ok and TOKENS: the tokens of each stretch with their numbers of bytes; ok: if
    both sides' bytes are those of the stretch, else there are no tokens."""

    def make():
        both = Tokenizers(a, b)

        def f(batch):
            texts, at = batch.column(0).to_pylist(), 0
            while at < len(texts):
                size, end = len(texts[at]), at + 1
                while end < len(texts) and size + len(texts[end]) <= AT_ONCE:
                    size, end = size + len(texts[end]), end + 1
                ok, sides = encode_each(both, texts[at:end], split)
                tokens = [lists(ends, v) for (ids, ends), size_of in zip(sides, (both.a_size, both.b_size), strict=True) for v in (ids, size_of[ids])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], batch.column(1)[at:end], pa.array(ok), *tokens], names=["stretch", "n", "ok", "a", "a_len", "b", "b_len"])
                at = end

        return f

    return map_batches(stretches, make, f"stretch string, n long, ok boolean, {TOKENS}", rows=8192)


@contextlib.contextmanager
def dealt_once(spark: SparkSession) -> Iterator[None]:
    """Joins inside may use rows that are dealt by some of their keys, so they don't deal
    them again; lists are collected from sorted rows, group by group; and the shuffle files
    of a table go when it's written, as no later plan reads them."""
    own = {
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.execution.useObjectHashAggregateExec": "false",
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    held = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def aligned(tokens: DataFrame) -> DataFrame:
    """stretch, n, groups from key and encoded(): the ids of each group, as `a1,a2|b1;a3|b2,b3`;
    null if not ok.

    Relational, and dealt by key once: tokens become rows with running sums of their
    lengths; both sides are joined in full on these ends; where a token of either ends, a
    group does, and the number of such ends before a row is its group; rows of a key and
    group, of both sides, are brought together, which links their tokens.
    """
    named = tokens.select("key", "stretch", "n").repartition("key")
    # One column and one filter for both sides, so all of what is below uses one exchange.
    tokens = tokens.where("ok and key is not null").select("key", F.array("a", "a_len", "b", "b_len").alias("of")).repartition("key")

    def ends(side: int, name: str) -> DataFrame:
        token = F.arrays_zip(F.get("of", F.lit(2 * side)).alias("id"), F.get("of", F.lit(2 * side + 1)).alias("len"))
        rows = tokens.select("key", F.posexplode_outer(token).alias("pos", "token"))
        so_far = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("key", F.col("token.id").alias(name), F.sum("token.len").over(so_far).alias("end"))

    before = Window.partitionBy("key").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    rows = ends(0, "a").join(ends(1, "b").hint("merge"), ["key", "end"], "full")
    rows = rows.withColumn("group", F.coalesce(F.sum(F.expr("int(a is not null and b is not null)")).over(before), F.lit(0)))

    def of(side: str):
        ids = F.sort_array(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", side))))[side]
        return F.array_join(ids.cast("array<string>"), ",")

    both = rows.groupBy("key", "group").agg(F.concat(of("a"), F.lit("|"), of("b")).alias("text"))
    rows = both.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list(F.struct("group", "text")))["text"], ";").alias("groups"))
    return named.join(rows.hint("merge"), "key", "left").drop("key")


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def links(groups: str) -> tuple[list[int], list[int], list[int]]:
    """NUMBERS of groups; their pairs, id of A * 2 ** 32 + id of B, group by group; and how many
    links of a group are of each."""
    numbers, pairs, times = [0, 0, 0, 0], [], []
    for group in groups.split(";"):
        a, b = (side.split(",") for side in group.split("|"))
        for i, n in enumerate((len(a), len(b), 1, len(a) * len(b))):
            numbers[i] += n
        if len(a) == len(b) == 1:
            pairs.append((int(a[0]) << 32) + int(b[0]))
            times.append(1)
            continue
        of_b = Counter(b).items()
        for x, n in Counter(a).items():
            high = int(x) << 32
            pairs.extend(high + int(y) for y, _ in of_b)
            times.extend(n * m for _, m in of_b)
    return numbers, pairs, times


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0] .. high[0] - 1, low[1] .. high[1] - 1, and so on."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of runs of values that end before `ends`; a run may be empty."""
    total = np.concatenate([np.zeros_like(values[:1], shape=(1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return np.diff(total[ends], axis=0, prepend=total[:1])


def all_links(groups: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What links() gives, of many at once: NUMBERS of each, where each one's pairs end, and the
    pairs; equal links of a group are not counted but all there."""
    if not groups:
        return np.zeros((0, len(NUMBERS)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = ";".join(groups).encode()
    ids = np.array(text.translate(bytes.maketrans(b"|;", b",,")).split(b",")).astype(np.int64)
    data = np.frombuffer(text, np.uint8)
    mark = data[(data < ord("0")) | (data > ord("9"))]
    # Which group an id is of, and which side: a group has one bar.
    group = np.concatenate([[0], np.cumsum(mark == ord(";"))])
    of_b = np.concatenate([[0], np.cumsum(mark == ord("|"))]) > group
    n_groups = np.array([g.count(";") + 1 for g in groups])
    n_a, n_b = (np.bincount(group[side], minlength=int(group[-1]) + 1) for side in (~of_b, of_b))
    ends = np.cumsum(n_groups)
    numbers = sums(np.stack([n_a, n_b, np.ones_like(n_a), n_a * n_b], axis=1), ends)
    at, begin = group[~of_b], np.cumsum(n_b) - n_b
    pairs = (np.repeat(ids[~of_b], n_b[at]) << 32) + ids[of_b][spread(begin[at], (begin + n_b)[at])]
    return numbers, np.cumsum(numbers[:, 3]), pairs


class Known:
    """Stretches with their numbers, groups and links; pairs and times are in one array for
    all. A stretch without groups is one whose tokens' bytes aren't its own."""

    def __init__(self, rows: Iterable[tuple[str, str | None]]):
        rows = list(rows)
        self.at = {stretch: i for i, (stretch, _) in enumerate(rows)}
        self.groups = [(groups or "").encode() for _, groups in rows]
        self.ok = np.array([groups is not None for _, groups in rows], bool)
        self.numbers = np.zeros((len(rows), len(NUMBERS)), np.int64)
        self.low, self.high = np.zeros((2, len(rows)), np.int64)
        light = [i for i, (_, groups) in enumerate(rows) if groups is not None and len(groups) <= LIGHT]
        self.numbers[light], self.high[light], pairs = all_links([rows[i][1] for i in light])
        self.low[light] = self.high[light] - self.numbers[light, 3]
        pairs, times = [pairs], [np.ones(len(pairs), np.int64)]
        n = len(pairs[0])
        for i, (_, groups) in enumerate(rows):
            if groups is not None and len(groups) > LIGHT:
                self.numbers[i], more, count = links(groups)
                self.low[i], self.high[i] = n, n + len(more)
                n += len(more)
                pairs.append(np.array(more, np.int64))
                times.append(np.array(count, np.int64))
        self.pairs, self.times = np.concatenate(pairs), np.concatenate(times)
        #: The distinct pairs, and which of them each one is.
        self.kinds, self.kind = np.unique(self.pairs, return_inverse=True)


def rare(stretches: Iterable[str], known: Known) -> list[str]:
    """The distinct stretches that aren't known, in order. Records of them come
    back to their text by their place in it."""
    return sorted(set(stretches).difference(known.at))


def put_together(texts: list[list[str]], known: Known, records: list[list[tuple[int, str | None]]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of texts, as stretches, and the groups of rare() of each by place: NUMBERS and the hash of the
    groups of each; where each one's distinct pairs end, these pairs, and how many links are of each."""
    flat = list(chain.from_iterable(texts))
    ends = np.cumsum([len(t) for t in texts])
    ids = np.fromiter(map(known.at.get, flat, repeat(-1)), np.int64, len(flat))
    missing = np.flatnonzero(ids < 0)
    of_text = np.searchsorted(missing, np.concatenate([[0], ends]))
    names = [flat[i] for i in missing.tolist()]
    found: dict[str, str | None] = {}
    for i, record in enumerate(records):
        if of_text[i] < of_text[i + 1]:
            own_names = sorted(set(names[of_text[i] : of_text[i + 1]]))
            found.update((own_names[place], groups) for place, groups in record)
    own = Known(found.items())
    ids[missing] = np.fromiter(map(own.at.__getitem__, names), np.int64, len(names)) + len(known.at)
    both = lambda name: np.concatenate([getattr(known, name), getattr(own, name)])
    good = (sums((~both("ok")[ids]).astype(np.int64), ends) == 0) & (np.diff(ends, prepend=0) > 0)
    numbers = sums(both("numbers")[ids], ends) * good[:, None]
    groups, shas, low = known.groups + own.groups, [], 0
    pieces = list(map(groups.__getitem__, ids.tolist()))
    for high, fine in zip(ends.tolist(), good.tolist(), strict=True):
        shas.append(hashlib.sha256(b";".join(pieces[low:high])).hexdigest() if fine else "")
        low = high

    # Each link is a whole number of its text and the kind of its pair; equal ones are neighbours when sorted.
    place = np.minimum(np.searchsorted(known.kinds, own.kinds), max(len(known.kinds) - 1, 0))
    new = known.kinds[place] != own.kinds if len(known.kinds) else np.ones(len(own.kinds), bool)
    kinds = np.concatenate([known.kinds, own.kinds[new]])
    place[new] = np.arange(len(known.kinds), len(kinds))
    kind = np.concatenate([known.kind, place[own.kind]])
    low, high = np.concatenate([known.low, own.low + len(known.pairs)])[ids], np.concatenate([known.high, own.high + len(known.pairs)])[ids]
    text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    high = np.where(good[text], high, low)
    at = spread(low, high)
    link, times = np.repeat(text * len(kinds), high - low) + kind[at], both("times")[at]
    order = np.sort(link)
    first = np.flatnonzero(np.diff(order, prepend=-1))
    order, n = order[first], np.diff(first, append=len(order))
    many = np.flatnonzero(times != 1)
    np.add.at(n, np.searchsorted(order, link[many]), times[many] - 1)
    return numbers, shas, np.searchsorted(order, np.arange(1, len(texts) + 1) * len(kinds)), kinds[order % max(len(kinds), 1)], n


def lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def align(docs: DataFrame, a: str, b: str, frequent: int = FREQUENT, frequent_pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of
    docs, for the tokens of the byte-level vocabulary `a` and the pieces of `b`.

    Texts are cut into words at single spaces before them, where tokens of both begin
    (if certain() holds of the vocabularies; else a text is one stretch), words into stretches where
    letters meet signs (if apart() holds; else a word is one), and each
    distinct stretch is encoded and aligned once, in relations (aligned()). Texts are
    put together from their stretches: the `frequent` most common short ones are broadcast, the others
    come by a join on the stretch, and go to their texts in TURNS by a hash of the text. Counts of pairs are over all rows of docs; the
    `frequent_pairs` most common ones are broadcast, the others are joined. Both bounds change only
    what is shuffled.

    Null and empty texts, and texts of which the tokens' bytes differ from the text's, have
    zeros and the hash ''. Null ids stay; repeated rows each give a row and each count as a
    document. A very long text without spaces is one stretch, whose tokens are rows. No
    rows: no rows. Other columns of docs are ignored.
    """
    spark, split = docs.sparkSession, certain(a, b)
    split = 1 + apart(b) if split else 0
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest")
    rows = docs.select("doc_id", "text", digest)
    with Scratch(spark) as scratch, dealt_once(spark):
        tokens = scratch.keep(encoded(distinct_stretches(rows, split), a, b, split).withColumn("key", F.monotonically_increasing_id()), "tokens")
        records = scratch.keep(aligned(tokens), "records")
        scratch.drop(1)
        top = records.where(F.octet_length("stretch") <= LONGEST).orderBy(F.desc("n"), "stretch").limit(frequent).select("stretch", "groups")
        known = spark.sparkContext.broadcast(Known(r for batch in top.toArrow().to_batches(4096) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)))

        def others():
            given = known.value

            def f(batch):
                texts = {d: (i, t) for i, d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
                found = [(n, d, i, s) for d, (n, t) in texts.items() for i, s in enumerate(rare(cut_once([t], split, given.at), given))]
                kinds = {"turn": pa.int32(), "digest": pa.binary(), "place": pa.int32(), "stretch": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds.values())], names=list(kinds))

            return f

        def whole():
            given = known.value

            def f(batch):
                size, at = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist(), 0
                while at < batch.num_rows:
                    n, end = size[at], at + 1
                    while end < batch.num_rows and n + size[end] <= TOGETHER:
                        n, end = n + size[end], end + 1
                    digest, copies, texts, own = batch.slice(at, end - at).columns
                    flat = list(zip(*(c.to_pylist() for c in own.flatten().flatten()), strict=True))
                    upto = np.cumsum(pc.fill_null(pc.list_value_length(own), 0).to_numpy()).tolist()
                    records = [flat[low:high] for low, high in zip([0, *upto], upto, strict=False)]
                    numbers, shas, ends, pairs, times = put_together([cut(t, split) for t in texts.to_pylist()], given, records)
                    yield pa.RecordBatch.from_arrays([digest, copies, *(pa.array(v) for v in numbers.T.copy()), pa.array(shas, pa.string()), lists(ends, pairs), lists(ends, times)], names=["digest", "copies", *NUMBERS, "groups_sha256", "pairs", "times"])
                    at = end

            return f

        turn = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(TURNS)).cast("int").alias("turn")
        wanted = map_batches(docs.select(turn, digest, "text"), others, "turn int, digest binary, place int, stretch string", rows=1024).repartition("stretch").dropDuplicates(["digest", "stretch"])
        # Records are dealt by stretch once; each turn then takes those of its texts.
        own = scratch.keep(wanted.join(records.select("stretch", "groups").hint("merge"), "stretch").select("turn", "digest", "place", "groups"), "own")
        scratch.drop(1)
        parts = []
        for k in range(TURNS):
            some = docs.where(turn == k).select("text", digest)
            theirs = own.where(F.col("turn") == k).groupBy("digest").agg(F.collect_list(F.struct("place", "groups")).alias("own"))
            # Copies of a text are one row from here on; both sides are dealt by digest already.
            texts = some.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
            held = texts.join(theirs.hint("merge"), "digest", "left").select("digest", "copies", "text", "own")
            parts.append(scratch.keep(map_batches(held, whole, "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>", rows=1024), "links"))
        found = functools.reduce(DataFrame.unionByName, parts)
        scratch.drop(TURNS)
        counts = scratch.keep(pair_counts(found), "pairs")
        # Written, so that the join has a plain exchange on either side and Spark splits a hot digest's rows.
        result = scratch.keep(with_counts(found, counts, frequent_pairs), "aligned")
        return scratch.result(rows.select("doc_id", "digest").join(result.hint("merge"), "digest").select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"), "aligned")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n, best: in how many documents a pair is, and whether no pair of its A id is in more."""
    counts = found.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32))))


def with_counts(found: DataFrame, counts: DataFrame, frequent: int) -> DataFrame:
    """The rows with n_best and count_sum: sums over links of what counts says of their pairs."""
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")
    known = found.sparkSession.sparkContext.broadcast([top[c].to_numpy() for c in ("pair", "n", "best")])
    names = [f"{c} {k}" for c, k in found.dtypes if c not in ("pairs", "times")]

    def make():
        pair, n, best = known.value

        def f(batch):
            own = batch.select([x.split()[0] for x in names])
            offsets = batch["pairs"].offsets.to_numpy()
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            pairs, times = batch["pairs"].flatten().to_numpy(), batch["times"].flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
            inside = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            sums = []
            for value in (best.astype(np.int64), n):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, of[inside], times[inside] * value[at[inside]])
                sums.append(pa.array(total))
            left = np.concatenate([[0], np.cumsum(np.bincount(of[~inside], minlength=batch.num_rows))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(left), pa.StructArray.from_arrays([pa.array(pairs[~inside]), pa.array(times[~inside])], ["pair", "times"]))
            yield pa.RecordBatch.from_arrays([*own.columns, *sums, rest], names=[*own.schema.names, "n_best", "count_sum", "rest"])

        return f

    rows = map_batches(found, make, ", ".join([*names, "n_best long, count_sum long, rest array<struct<pair:long,times:long>>"]), rows=1024)
    rest = rows.select("digest", F.explode("rest").alias("one")).select("digest", "one.*")
    rest = rest.join(counts.hint("merge"), "pair").groupBy("digest").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    rows = rows.drop("rest").join(rest.hint("merge"), "digest", "left")
    more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return rows.select("digest", *NUMBERS, more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")
