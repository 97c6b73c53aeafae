"""Mixing sources to target weights, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import materialize
from .common import WORD

#: Coarse and fine bins of a sampling key: one source's histogram has at most
#: COARSE, then FINE rows, whatever the number of its documents.
COARSE, FINE = 256, 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A line's end right after a mark that ends a sentence; a line from its first word on.
ENDED, LINE = r"[.!?][\x20\x09\x0B-\x0D]*(\n|\z)", r"[^\x20\x09-\x0D][^\n]*"


def ended_lines_weight(text: Column) -> Column:
    """A document's quality weight, from 1 to 4: 1 plus 3 times the share of its lines
    with words that end in . ! or ?, as lines of prose do and those of lists, menus and
    debris don't. Null texts and those without words weigh 1."""
    share = F.try_divide(F.regexp_count(text, F.lit(ENDED)).cast("double"), F.regexp_count(text, F.lit(LINE)))
    return F.lit(1.0) + F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)) * 3


def targets(sizes: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> and target: all sizes shared by weight, none above
    cap * source_size, the excess shared among the rest.

    Sources weigh `weights` in turn, in code-point order, null last. With sources
    by cap * size / weight, those that stop at their cap come first; the share of
    the others is fixed by what those leave. One row for each source.
    """
    every = Window.partitionBy()
    in_order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") * (6 * cap) / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("w", w).withColumns({
        "all": F.sum("source_size").over(every),
        "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        "capped": F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)),
        "at": F.row_number().over(by_ratio),
    })
    # The first source that its share doesn't fill, were all before it at their cap.
    left = F.col("all") - F.col("capped")
    first = F.min(F.when(left * F.col("w") <= F.col("source_size") * cap * F.col("w_left"), F.struct("at", left.alias("left"), F.col("w_left").alias("w_left")))).over(every)
    rows = rows.withColumn("first", first)
    share = (F.col("first.left") * F.col("w")).cast("double") / F.col("first.w_left")
    capped = F.col("at") < F.coalesce(F.col("first.at"), F.lit(2**31 - 1))
    return rows.select("source", "source_size", F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, quality: Column | None = None, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """doc_id, size, source, source_size, target, epochs, copies, taken for every row of docs.

    Every document is taken floor(target / source_size) times (complete epochs);
    what the target leaves is a fraction of an epoch, filled by weighted sampling
    without replacement: the exponential key -ln(u) / quality weight, u a hash of
    doc_id and seed; the smallest keys whose sizes add up to what is left, the last
    one if at least half of it fits.

    The prefix sums need no sorted source: sizes are summed in COARSE bins of the
    key, then in FINE bins of the one coarse bin in which the budget ends, and only
    that bin's rows are ordered. Results don't depend on partitions; reruns agree.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: the key
    is drawn from the text. Repeated rows each count; rows that tie in key, id and size are
    taken in any order, with the same result. No rows: no rows. Other columns of
    docs are ignored.
    """
    text = F.col("text")
    quality = ended_lines_weight(text) if quality is None else quality
    identity = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    hex13 = F.substring(F.md5(F.concat(identity, F.lit(f":{seed}")).cast("binary")), 1, 13)
    u = (F.conv(hex13, 16, 10).cast("long") + F.lit(1)) / F.lit(float(16**13))
    # key / (1 + key) lies in [0, 1) and is as ordered as the key.
    rows = docs.select("doc_id", F.col("source"), n_words(text).alias("size"), (-F.ln(u) / quality).alias("key"))
    x = F.col("key") / (1 + F.col("key"))
    coarse = F.least(F.floor(x * COARSE), F.lit(COARSE - 1)).cast("int")
    fine = F.least(F.floor((x * COARSE - F.col("coarse")) * FINE), F.lit(FINE - 1)).cast("int")
    rows = materialize(rows.withColumn("coarse", coarse).withColumn("fine", fine), "mix")

    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cap, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per_source = per_source.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))

    def ends(bins: DataFrame, level: str, limit: Column) -> DataFrame:
        """source, level, before: the bin in which the limit ends, and the sum before it."""
        w = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = bins.withColumn("upto", F.sum("n").over(w)).where((F.col("upto") - F.col("n") <= limit) & (limit < F.col("upto")))
        return upto

    hist = rows.groupBy("source", "coarse").agg(F.sum("size").alias("n"))
    s = per_source.alias("s")
    bins = hist.alias("h").join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).select("s.*", "coarse", "n")
    end1 = ends(bins, "coarse", F.col("budget")).select("source", F.col("coarse").alias("end1"), (F.col("upto") - F.col("n")).alias("before1"))
    per_source = per_source.alias("s").join(end1.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left").select("s.*", "end1", "before1")
    per_source = materialize(per_source, "mix-sources")

    near = rows.alias("r").join(per_source.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("coarse") == F.col("end1")))
    hist2 = near.groupBy("s.source", "fine", "budget", "before1").agg(F.sum("size").alias("n"))
    end2 = ends(hist2, "fine", F.col("budget") - F.col("before1")).select("source", F.col("fine").alias("end2"), (F.col("upto") - F.col("n") + F.col("before1")).alias("before2"))
    per_source = materialize(per_source.alias("s").join(end2.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left").select("s.*", "end2", "before2"), "mix-ends")

    joined = rows.alias("r").join(per_source.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    joined = joined.select("r.*", *[f"s.{c}" for c in per_source.columns if c != "source"])
    at_end = (F.col("coarse") == F.col("end1")) & (F.col("fine") == F.col("end2"))
    # Rows before the end are in, after it out; only those of the last bin are ordered.
    before = F.when(F.col("end1").isNull(), F.col("budget") > 0).otherwise((F.col("coarse") < F.col("end1")) | ((F.col("coarse") == F.col("end1")) & (F.col("fine") < F.col("end2"))))
    sure = joined.where(~F.coalesce(at_end, F.lit(False))).withColumn("picked", F.coalesce(before, F.lit(False)))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = joined.where(at_end).withColumn("upto", F.sum("size").over(order) + F.col("before2"))
    last = last.withColumn("picked", F.col("upto") - F.col("size") / 2 <= F.col("budget")).drop("upto")
    copies = (F.col("epochs") + F.col("picked").cast("long")).alias("copies")
    return sure.unionByName(last).select("doc_id", "size", "source", "source_size", "target", "epochs", copies, ((F.col("epochs") + F.col("picked").cast("long")) * F.col("size")).alias("taken"))
