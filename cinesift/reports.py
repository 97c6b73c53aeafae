"""Reports as text, from small aggregates that plans have made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(rows: DataFrame, limit: int | None = None) -> list[str]:
    """name: value, ... of each row. The caller has aggregated; a limit is a preview."""
    out = []
    for r in (rows if limit is None else rows.limit(limit)).collect():
        out.append("  " + ", ".join(f"{k}: {v:.2f}" if isinstance(v, float) else f"{k}: {v}" for k, v in r.asDict().items() if v is not None))
    return out


def section(title: str, rows: DataFrame, limit: int | None = None) -> str:
    return "\n".join([title, *(lines(rows, limit) or ["  nothing"])])


def shortened(names: list[str], shown: int = 5) -> str:
    more = f" +{len(names) - shown} more" if len(names) > shown else ""
    return ", ".join(names[:shown]) + more


def scan(counts: DataFrame, groups: DataFrame, shown: int = 50) -> str:
    """Totals, then clips that share the same issues: the commonest first, each with the
    issues of its first clip, and with the names of all where they are few."""
    out = [section("Clips", counts), "", "Issues shared by clips"]
    rows = groups.orderBy(F.desc("n"), "pattern").limit(shown + 1).collect()
    for r in rows[:shown]:
        out.append(f"  {r.first if r.n == 1 else f'{r.n} clips'} ({r.spec})")
        out += [f"    {m.severity.upper()} {m.message}" for m in r.messages]
        out += [f"    files: {r.files}"] if r.files else []
    return "\n".join([*out, *(["  and more"] if len(rows) > shown else []), *(["  nothing"] if not rows else [])])


def captions(summary: DataFrame, worst: DataFrame, shown: int = 10) -> str:
    return section("Captions", summary) + "\n" + section("Worst", worst, shown)


def marked(issue) -> str:
    return f"    {issue.severity.upper()} {issue.code}: {issue.message} ({issue.actual}; expected {issue.expected})"


def each(title: str, rows: DataFrame, name: str, shown: int = 200) -> str:
    """The issues of the first rows (name, issues) that have any, with how many more there are."""
    found = rows.where(F.size("issues") > 0).select(name, "issues")
    first = found.orderBy(name).limit(shown + 1).collect()
    out = [title]
    for r in first[:shown]:
        out += [f"  {r[name]}", *(marked(i) for i in r.issues)]
    return "\n".join(out + (["  and more"] if len(first) > shown else [] if first else ["  nothing"]))


def buckets(groups: DataFrame, step: int, shown: int = 20) -> str:
    """The largest buckets, each with its first names."""
    out = [f"Buckets of {step} pixels"]
    out += [f"  {r.bucket_key}: {r.n} ({shortened(r.names)}{', ...' if r.n > len(r.names) else ''})" for r in groups.select("bucket_key", "n", F.slice("samples", 1, 5).alias("names")).limit(shown).collect()]
    return "\n".join(out if len(out) > 1 else [*out, "  nothing"])


def organized(plan: DataFrame, out_dir: str, layout: str, dry: bool, shown: int = 200) -> str:
    """What goes where, what is left out and why, and both totals."""
    totals = plan.agg(F.count_if(F.col("skip_reason").isNull()).alias("kept"), F.count_if(F.col("skip_reason").isNotNull()).alias("left")).first()
    out = [f"Organizing into {out_dir} ({layout})" + (", files aren't touched" if dry else "")]
    rows = plan.orderBy(F.col("skip_reason").isNotNull(), "stem").select("stem", "skip_reason", "target_dest", "caption_dest", "reference_dest").limit(shown + 1).collect()
    for r in rows[:shown]:
        parts = [p.rsplit("/", 1)[-1] for p in (r.target_dest, r.caption_dest, r.reference_dest) if p]
        out.append(f"  {r.stem}: " + (f"left out, {r.skip_reason}" if r.skip_reason else " + ".join(parts)))
    return "\n".join([*out, *(["  and more"] if len(rows) > shown else []), f"  {totals.kept} organized, {totals.left} left out"])


def dataset(counts: DataFrame, issues: DataFrame, undersized: DataFrame | None = None) -> str:
    out = section("Samples", counts) + "\n" + section("Issues", issues.orderBy("code"))
    return out if undersized is None else out + "\n" + section("Buckets with too few clips", undersized.orderBy("bucket_key"))
