"""URL filters: written rules, then association rules mined by FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BAD = "label=bad"
#: Bad pages that a mined rule must hold on.
LEAST = 20


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and where there is no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def written_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null if none does."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: h: and the parts of its host between dots and
    dashes, p: and those of its path; runs of digits read 0."""
    zeros = lambda c: F.regexp_replace(F.lower(c), r"\d+", "0")
    pieces = lambda c, mark, at: F.transform(F.filter(F.split(zeros(c), at), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(pieces(host, "h:", r"[.\-:]"), pieces(path, "p:", r"[/.\-_]")))


def classes(known: DataFrame) -> DataFrame:
    """item, tokens: tokens that are on the same rows of known (row, items), under the first of them.
    Equal sets of rows are told by their number and two sums of 64-bit hashes of the rows. A class
    is no longer than a row's tokens."""
    rows = known.select("row", F.explode("items").alias("token"))
    same = rows.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(20,0)")).alias("s"))
    return same.groupBy("n", "x", "s").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(F.get("tokens", F.lit(0)).alias("item"), "tokens")


def spelled(rules: DataFrame, named: DataFrame) -> DataFrame:
    """rules over items, as rules over their tokens: one for each choice of a token for every item."""
    some = rules.withColumn("rule", F.monotonically_increasing_id())
    lists = some.select("rule", F.explode("items").alias("item")).join(named, "item").groupBy("rule").agg(F.collect_list("tokens").alias("lists"))
    none = F.array(F.array().cast("array<string>"))
    chosen = F.aggregate("lists", none, lambda made, one: F.flatten(F.transform(made, lambda m: F.transform(one, lambda t: F.array_append(m, t)))))
    return some.join(lists, "rule").withColumn("items", F.explode(chosen)).withColumn("items", F.array_sort("items")).drop("rule", "lists")


def mine(pages: DataFrame, labels: DataFrame, support: float, confidence: float, lift: float, least: int = LEAST) -> DataFrame:
    """items, confidence, support, pages of rules items -> bad, pruned.

    A page is bad where its id is labelled toxic, or of quality 0; repeated rows of an id
    are bad if one is, and null ids have no label. Item sets are mined by FP-growth; a rule
    must hold on `least` bad pages at least, whatever their share, as of thousands of token
    sets some are bad by chance on fewer. Of rules, those stay that none over some of
    their items matches in confidence. Tokens that are on the same labelled pages are one
    item while sets are mined (classes()), so that a URL which is repeated is one set, not
    one for each choice of its tokens; a rule over two of them never stays, as one does as well.
    """
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.coalesce("toxic", F.lit(0)) > 0) | (F.coalesce("quality", F.lit(1)) <= 0)).cast("int").alias("bad"))
    bad = bad.dropna(subset=["page_id"]).groupBy("page_id").agg(F.max("bad").alias("bad"))
    host, path = parts(F.col("url"))
    with Scratch(pages.sparkSession) as scratch:
        known = pages.select("page_id", tokens(host, path).alias("items")).join(bad, "page_id")
        known = scratch.keep(known.select(F.monotonically_increasing_id().alias("row"), "items", (F.col("bad") > 0).alias("bad")), "labelled")
        n, n_bad = known.agg(F.count("*"), F.count_if("bad")).first()
        empty = pages.sparkSession.createDataFrame([], "items array<string>, confidence double, support double, pages long")
        if not n_bad:
            return empty
        named = scratch.keep(classes(known), "classes")
        of = known.select("row", F.explode("items").alias("token")).join(named.select("item", F.explode("tokens").alias("token")), "token")
        held = known.select("row", "bad").join(of.groupBy("row").agg(F.collect_set("item").alias("items")), "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        held = scratch.keep(held.select(F.when(F.col("bad"), F.array_append("items", BAD)).otherwise(F.col("items")).alias("items")), "baskets")
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n))).fit(held).freqItemsets
        sets = scratch.keep(sets.select(F.array_sort("items").alias("items"), "freq"), "item-sets")
        # Only rules to bad are made: from a set with it, and what is left without it.
        with_bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("pages"))
        rules = with_bad.join(sets, "items").select("items", "pages", (F.col("pages") / F.col("freq")).alias("confidence"))
        # Every set of items that a rule's set holds is frequent with bad as well, so the best
        # confidence below a rule comes up size by size, from the sets with one item less.
        rules = scratch.keep(rules.withColumn("size", F.size("items")), "rules")
        upto = rules.agg(F.max("size")).first()[0] or 0
        level = done = scratch.keep(rules.where("size = 1").withColumn("below", F.lit(-1.0)), "level")
        for size in range(2, upto + 1):
            one_less = rules.where(F.col("size") == size).withColumn("gone", F.explode("items"))
            one_less = one_less.withColumn("part", F.array_remove("items", F.col("gone")))
            smaller = level.select(F.col("items").alias("part"), F.greatest("confidence", "below").alias("best"))
            level = scratch.keep(one_less.join(smaller, "part").groupBy("items", "pages", "confidence", "size").agg(F.max("best").alias("below")), "level")
            done = done.unionByName(level)
        good = done.where((F.col("pages") >= least) & (F.col("confidence") >= confidence) & (F.col("confidence") * n / n_bad >= lift) & (F.col("below") < F.col("confidence")))
        good = spelled(scratch.keep(good, "good"), named)
        return scratch.result(good.select("items", "confidence", (F.col("pages") / n).alias("support"), "pages"), "url-rules")


def judge(pages: DataFrame, labels: DataFrame, support: float = 0.002, confidence: float = 0.5, lift: float = 2.0, rules=RULES, least: int = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict, matched for every row of pages.

    A written rule decides first; then mined rules block pages that hold all tokens
    of at least one (matched: how many), found in an inverted index from token to
    rules; everything else is allowed. Each distinct URL is matched once.

    Null URLs and those without :// have empty host and path and no tokens, so they
    are allowed. Null ids and repeated rows are judged by their URL. Without bad
    labelled pages nothing is mined. No rows: no rows. Other columns are ignored.
    """
    mined = mine(pages, labels, support, confidence, lift, least).withColumn("rule_id", F.xxhash64("items"))
    index = mined.select("rule_id", F.size("items").alias("needs"), F.explode("items").alias("token"))
    host, path = parts(F.col("url"))
    urls = pages.select("url").dropna().distinct().select("url", F.explode(tokens(host, path)).alias("token"))
    hits = urls.join(index, "token").groupBy("url", "rule_id", "needs").agg(F.count("*").alias("has")).where(F.col("has") == F.col("needs"))
    hits = hits.groupBy("url").agg(F.count("*").alias("matched"))
    rule, verdict = written_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.join(hits, "url", "left").withColumn("matched", F.coalesce("matched", F.lit(0)).cast("long"))
    own = F.when(F.col("matched") > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "matched")
