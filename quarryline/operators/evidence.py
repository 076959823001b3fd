"""Code evidence for candidates: line windows, numbered lines and an exact running character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT, MOST_LINES, MOST_CHARS = 12, 200, 100_000
# Names of files that hold secrets.
SENSITIVE = (".env", ".npmrc", ".pypirc", "credentials", "credentials.json", "id_ed25519", "id_rsa")


def allowed_path(path: Column) -> Column:
    """Relative, without .. and not a secrets file."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return ~F.array_contains(parts, "..") & ~path.startswith("/") & ~F.lower(F.element_at(parts, -1)).isin(*SENSITIVE)


def window(lines: Column, count: Column, context: int = CONTEXT, most: int = MOST_LINES) -> Column:
    """struct(first, last) of lines 'a-b' widened by context within 1 to count, most lines from the first; all lines if null or of another form."""
    a = F.expr("0").cast("long") + F.coalesce(F.regexp_extract(lines, "^([0-9]+)-([0-9]+)$", 1).try_cast("long"), F.lit(1))
    b = F.coalesce(F.regexp_extract(lines, "^([0-9]+)-([0-9]+)$", 2).try_cast("long"), count.cast("long"))
    first = F.least(F.greatest(F.lit(1), a - context), F.greatest(F.lit(1), count))
    last = F.least(F.greatest(first, b + context), count)
    return F.struct(first.alias("first"), F.least(last, first + most - 1).alias("last"))


def numbered(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last as 'n: line', joined."""
    rows = F.slice(F.split(text, "\r\n|\n|\r"), first.cast("int"), F.greatest(F.lit(0), last - first + 1).cast("int"))
    return F.array_join(F.transform(rows, lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x)), "\n")


def budgeted(snippets: DataFrame, group: str, place: str, content: str, budget: int = MOST_CHARS) -> DataFrame:
    """group, evidence (array of struct id, place, content): snippets in order of place, each cut to what is left of the budget and
    stripped of blanks at its end; only what stays is charged, empty ones get no id, and nothing follows once the budget is used up.

    A fold over the ordered snippets of a group, which a candidate list's limit keeps short.
    """
    ordered = snippets.where(F.length(content) > 0).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(content).alias("content")))).alias("s"))
    start = F.struct(F.lit(budget).alias("left"), F.expr("CAST(array() AS array<struct<place:long,content:string>>)").alias("kept"))

    def step(state, x):
        cut = F.when(F.length(x.content) > state.left, F.rtrim(F.left(x.content, state.left), F.lit(" \t\r\n"))).otherwise(x.content)
        use = (state.left > 0) & (F.length(cut) > 0)
        return F.struct(F.when(use, state.left - F.length(cut)).otherwise(state.left).alias("left"), F.when(use, F.concat(state.kept, F.array(F.struct(x.place.cast("long").alias("place"), cut.alias("content"))))).otherwise(state.kept).alias("kept"))

    kept = F.aggregate("s", start, step)["kept"]
    return ordered.select(group, F.transform(kept, lambda x, i: F.struct(F.concat(F.lit("E"), (i + 1).cast("string")).alias("id"), x.place.alias("place"), x.content.alias("content"))).alias("evidence"))


def collect_evidence(candidates: DataFrame, sources: DataFrame, budget: int = MOST_CHARS, most_lines: int = MOST_LINES, context: int = CONTEXT) -> DataFrame:
    """issue_id, evidence for candidates (issue_id, rank, path, lines) of sources (path, content)."""
    if budget < 1 or most_lines < 1 or context < 0:
        raise ValueError("budget and most_lines must be positive, context not negative")
    good = sources.where(allowed_path(F.col("path"))).where(~F.contains("content", F.lit("\x00"))).where(F.length("content") > 0)
    met = candidates.join(good, "path").withColumn("n", F.size(F.split(F.regexp_replace("content", "(\r\n|\n|\r)$", ""), "\r\n|\n|\r")))
    met = met.withColumn("w", window(F.col("lines"), F.col("n"), context, most_lines))
    return budgeted(met.withColumn("snippet", numbered(F.col("content"), F.col("w.first"), F.col("w.last"))), "issue_id", "rank", "snippet", budget)
