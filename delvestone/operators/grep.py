"""Search in lines and paths: literal and regular patterns with AND, OR and NOT."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_number, line); null texts have no lines."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).cast("bigint").alias("line_number"), "line")


def matches(column: str | Column, term: str, *, literal: bool = True, ignore_case: bool = True, whole_word: bool = False) -> Column:
    """A predicate.  A literal without word bounds stays a plain substring test, which needs no regex engine."""
    column = F.col(column) if isinstance(column, str) else column
    if literal and not whole_word:
        return F.contains(F.lower(column), F.lit(term.lower())) if ignore_case else F.contains(column, F.lit(term))
    pattern = re.escape(term) if literal else term
    if whole_word:
        pattern = rf"\b(?:{pattern})\b"
    return column.rlike(("(?iu)" if ignore_case else "") + pattern)


def grep(rows: DataFrame, term: str, *, invert: bool = False, column: str = "line", **flags) -> DataFrame:
    hit = matches(column, term, **flags)
    return rows.where(~hit if invert else hit)


def count_only(rows: DataFrame, term: str, key: str = "doc_id", **flags) -> DataFrame:
    return grep(rows, term, **flags).groupBy(key).agg(F.count("*").alias("n_lines"))


def grep_or(rows: DataFrame, terms: list[str], *, literal: bool = True, **flags) -> DataFrame:
    """A line once per literal term that it holds; with regular patterns once.

    One pass whatever the number of terms: the terms that hold are an array, exploded.
    """
    if not literal:
        return grep(rows, "|".join(f"(?:{t})" for t in terms), literal=False, **flags).withColumn("term", F.lit(None).cast("string"))
    held = F.array_compact(F.array(*[F.when(matches("line", t, **flags), F.lit(t)) for t in terms]))
    return rows.withColumn("term", F.explode(held))


def grep_and(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", same_line: bool = False, **flags) -> DataFrame:
    """Lines with the last term, of documents that hold every term (or lines with all of them).

    A document's own text decides, so that nothing is joined or shuffled.
    """
    if same_line:
        rows = lines(docs, key, text)
        for t in terms:
            rows = grep(rows, t, **flags)
        return rows
    for t in terms:
        docs = docs.where(matches(text, t, **flags))
    return grep(lines(docs, key, text), terms[-1], **flags)


def grep_not(docs: DataFrame, positive: str, negatives: list[str], key: str = "doc_id", text: str = "text", **flags) -> DataFrame:
    """Lines with the first term, of documents that hold none of the others."""
    for t in negatives:
        docs = docs.where(~matches(text, t, **flags))
    return grep(lines(docs, key, text), positive, **flags)


def replace(rows: DataFrame, pattern: str, replacement: str, column: str = "line") -> DataFrame:
    """Changed lines only, with the line after the replacement; nothing is written."""
    after = F.regexp_replace(column, pattern, replacement)
    return rows.withColumn("after", after).where(F.col("after") != F.col(column))


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for a glob with *, ** and ?."""
    out = ""
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        out += {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def by_name(paths: DataFrame, patterns: list[str], name: str = "name") -> DataFrame:
    """Rows whose file name matches a pattern, with the first that does; invalid patterns are skipped."""
    good = []
    for p in patterns:
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            continue
    first = F.coalesce(*[F.when(F.col(name).rlike(f"(?iu){p}"), F.lit(p)) for p in good], F.lit(None).cast("string"))
    return paths.withColumn("pattern", first).where(F.col("pattern").isNotNull())


def glob_filter(paths: DataFrame, include: list[str], exclude: list[str], path: str = "path") -> DataFrame:
    keep = F.lit(not include)
    for g in include:
        keep = keep | F.col(path).rlike(glob_pattern(g))
    for g in exclude:
        keep = keep & ~F.col(path).rlike(glob_pattern(g))
    return paths.where(keep)


def in_scope(path: str | Column, files: list[str], folders: list[str]) -> Column:
    """Is a path one of the files or under one of the folders?  An empty scope holds everything."""
    path = F.col(path) if isinstance(path, str) else path
    if not files and not folders:
        return F.lit(True)
    out = path.isin(files) if files else F.lit(False)
    for folder in folders:
        out = out | path.startswith(folder.rstrip("/") + "/")
    return out


#: Lines that are markup or boilerplate.
NOISE = [r"^\s*[#*>=~_\-|]+\s*$", r"^\s*(?:page|seite|página)\s+\d+", r"^\s*\d+\s*$", r"(?i)all rights reserved|cookie policy|click here"]


def good_line(column: str = "line", least: int = 10, alnum: float = 0.3) -> Column:
    """Is a line long enough, no boilerplate, and mostly letters and digits?"""
    c = F.col(column)
    plain = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    out = (F.length(F.trim(c)) >= least) & (plain >= F.length(c) * F.lit(alnum))
    for p in NOISE:
        out = out & ~c.rlike(p)
    return out
