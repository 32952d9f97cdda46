"""Injected steps: model and tool calls behind callables with deterministic defaults, and the routing around them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn

#: Phrases of an answer that refuses.
REFUSALS = ("cannot answer", "not available", "no information", "unable to", "n/a")


def refusal(column: str | Column, head: int = 500, least: int = 20) -> Column:
    """Is an answer too short, or does its head refuse?"""
    c = F.col(column) if isinstance(column, str) else column
    low = F.lower(F.substring(c, 1, head))
    out = F.length(F.trim(c)) < least
    for p in REFUSALS:
        out = out | F.contains(low, F.lit(p))
    return F.coalesce(out, F.lit(True))


def small_talk(column: str | Column) -> Column:
    c = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return c.rlike(r"^(?:hi|hello|hey|thanks|thank you|test|ok|你好|谢谢)[\s!.?。！]*$")


def is_small_talk(query: str) -> bool:
    """The same of one query, on the driver."""
    import re

    return re.match(r"(?:(?:hi|hello|hey|thanks|thank you|test|ok|你好|谢谢)[\s!.?。！]*)\Z", query.strip().lower()) is not None


def keyword_tool(rows: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """(key, first_line, n): the lines that hold any of the terms, taken literally, by document."""
    from .grep import matches

    held = F.lit(False)
    for t in terms:
        held = held | matches("line", t)
    return rows.where(held).groupBy(key).agg(F.min("line_number").alias("first_line"), F.count("*").alias("n"))


def benchmark(items: DataFrame, key: str, gold: str, predicted: str, by: str) -> DataFrame:
    """(by, n, correct, refused, undecided, accuracy): the judge's verdicts on a batch of answers; an undecided one is not correct."""
    own = items.select(by, verdict(predicted, gold).alias("v"))
    return own.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(F.col("v").isin("exact", "numeric")).alias("correct"), F.count_if(F.col("v") == "refused").alias("refused"),
        F.count_if(F.col("v") == "undecided").alias("undecided"), F.round(F.avg(F.col("v").isin("exact", "numeric").cast("double")), 6).alias("accuracy"),
    )


def report(metrics: DataFrame, by: str) -> DataFrame:
    """(line): a benchmark's metrics as lines of text, the best first."""
    part = F.format_string("%s: %d of %d (%.1f %%), %d refused", F.coalesce(by, F.lit("-")), "correct", "n", F.col("accuracy") * 100, "refused")
    return metrics.orderBy(F.desc("accuracy"), by).select(part.alias("line"))


def verdict(predicted: str | Column, gold: str | Column) -> Column:
    """A judge's deterministic part: refusal, equal after normalising, equal as numbers, else undecided."""
    p, g = fn.plain_answer(predicted), fn.plain_answer(gold)
    both = fn.number_of(predicted).isNotNull() & fn.number_of(gold).isNotNull()
    return (
        F.when(refusal(predicted, least=1), "refused").when(p == g, "exact")
        .when(both & fn.near(fn.number_of(predicted), fn.number_of(gold)), "numeric").when(both, "wrong").otherwise("undecided")
    )


def default_summary(column: str | Column, size: int = 200) -> Column:
    """The default of a summarising step: the squeezed head of the text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.substring(F.trim(F.regexp_replace(F.substring(c, 1, size * 3), r"[ \t\n]+", " ")), 1, size)


@dataclass
class Tools:
    """Tools by name.  A tool takes a state and gives rows; an error is kept as text, not raised."""

    tools: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    log: list[tuple[str, str]] = field(default_factory=list)

    def register(self, name: str, tool: Callable[..., DataFrame]) -> None:
        if name in self.tools:
            raise ValueError(f"two tools named {name}")
        self.tools[name] = tool

    def call(self, name: str, **arguments) -> DataFrame | None:
        try:
            out = self.tools[name](**arguments)
            self.log.append((name, "ok"))
            return out
        except Exception as error:  # noqa: BLE001
            self.log.append((name, f"{type(error).__name__}: {error}"))
            return None


def loop(tools: Tools, policy: Callable[[list], tuple[str, dict] | None], most: int = 10, limit: int = 128_000, size: Callable[[DataFrame], int] | None = None) -> list:
    """Call tools as the policy says, until it stops or the calls or the sizes of their results run out."""
    history: list = []
    used = 0
    for _ in range(most):
        step = policy(history)
        if step is None or used >= limit:
            break
        result = tools.call(step[0], **step[1])
        used += size(result) if size and result is not None else 0
        history.append((step[0], step[1], result))
    return history


def cascade(*steps: Callable[[], DataFrame | None]) -> DataFrame | None:
    """The first step's rows that aren't none and not empty."""
    for step in steps:
        df = step()
        if df is not None and not df.isEmpty():
            return df
    return None


def hashed_embedding(column: str | Column, dim: int = 64) -> Column:
    """The default of an embedding step: counts of hashed words, of unit length; zero for a wordless text."""
    words = fn.words(column)
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))
