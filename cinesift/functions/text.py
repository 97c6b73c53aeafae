"""Caption text as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CONCEPT_ALIASES, SPECIFIC_TERMS, TEMPORAL_WORDS, TOKENS_PER_WORD, VAGUE_PHRASES

#: Unicode white space; Spark's trim() and \s know less.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0  -     　]"


@dataclass(frozen=True)
class ScoringConfig:
    shortest: int = 50
    short: int = 80
    long: int = 400
    longest: int = 600
    length_weight: float = 0.25
    temporal_weight: float = 0.30
    specificity_weight: float = 0.25
    repetition_weight: float = 0.20
    vague_penalty: float = 0.15
    specific_bonus: float = 0.10


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), f"{SPACE}+"), lambda x: x != "")


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def stripped_length(text: Column) -> Column:
    return F.length(strip(text))


def length_score(n: Column, c: ScoringConfig = ScoringConfig()) -> Column:
    """From stripped_length(): give that a column of its own, as it is used in each branch."""
    n = n.cast("double")
    rising = F.lit(0.4) + F.lit(0.6) * (n - c.shortest) / (c.short - c.shortest)
    falling = F.lit(1.0) - F.lit(0.4) * (n - c.long) / (c.longest - c.long)
    return F.when(n == 0, 0.0).when(n < c.shortest, 0.2).when(n < c.short, rising).when(n <= c.long, 1.0).when(n <= c.longest, falling).otherwise(0.4)


def temporal_score(tokens: Column) -> Column:
    k = F.size(F.array_intersect(tokens, literals(TEMPORAL_WORDS)))
    return F.when(k == 0, 0.0).when(k == 1, 0.3).when(k == 2, 0.5).when(k == 3, 0.7).when(k <= 5, 0.85).otherwise(1.0)


def vague_found(low: Column) -> Column:
    """Vague phrases in a lower-cased text."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), p) for p in VAGUE_PHRASES]))


def specificity_score(low: Column, c: ScoringConfig = ScoringConfig()) -> Column:
    """Of a lower-cased text. A sum of conditions without lambdas, so it is compiled, and the
    text is lower-cased once where that is a column of its own."""
    hits = lambda terms: reduce(Column.__add__, [F.contains(low, F.lit(p)).cast("int") for p in terms])
    raw = F.lit(0.5) - F.lit(c.vague_penalty) * hits(VAGUE_PHRASES) + F.lit(c.specific_bonus) * hits(SPECIFIC_TERMS)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def repeated_trigrams(tokens: Column) -> Column:
    """How many of the runs of three words are repeats of an earlier one. Builds an array:
    give it a column of its own before it is used more than once."""
    n = F.size(tokens)
    tri = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)))
    return F.when(n >= 3, n - 2 - F.size(F.array_distinct(tri))).otherwise(0)


def repetition_score(n: Column, repeated: Column) -> Column:
    """From the number of words and of repeated_trigrams()."""
    ratio = repeated / F.when(n > 2, n - 2).otherwise(1)
    return F.when(n < 4, 1.0).when(ratio == 0, 1.0).when(ratio > 0.3, 0.2).when(ratio > 0.15, 0.5).when(ratio > 0.05, 0.8).otherwise(0.95)


def overall_score(length: Column, temporal: Column, specificity: Column, repetition: Column, c: ScoringConfig = ScoringConfig()) -> Column:
    return length * c.length_weight + temporal * c.temporal_weight + specificity * c.specificity_weight + repetition * c.repetition_weight


def token_estimate(tokens: Column) -> Column:
    return F.floor(F.size(tokens) * F.lit(TOKENS_PER_WORD)).cast("long")


def jaccard(a: Column, b: Column, both: Column) -> Column:
    """Of two arrays of distinct tokens and their intersection; 0 if either has none."""
    any_ = F.size(a) + F.size(b) - F.size(both)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(both) / any_).otherwise(0.0)


def prepend_anchor(caption: Column, anchor: Column) -> Column:
    first = F.substring(caption, 1, 1)
    lowered = F.concat(F.lower(first), F.substring(caption, 2, 2**31 - 1))
    kept = F.startswith(F.lower(caption), F.lower(anchor))
    return F.when(kept, caption).otherwise(F.concat(anchor, F.lit(", "), lowered))


def concept_type(name: Column) -> Column:
    """Type of a folder name by its aliases, null if it is none of them."""
    plain = F.regexp_replace(strip(F.lower(name)), "[-_ ]", "")
    out = None
    for kind, names in CONCEPT_ALIASES.items():
        fits = plain.isin(names)
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out


def fill(template: Column, **values: Column) -> Column:
    """{name} replaced by values; names without a value stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
