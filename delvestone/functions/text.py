"""Scalar functions on texts, ids, numbers and vectors, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fingerprint(text: str | Column, whole: int = 16384, part: int = 8192) -> Column:
    """md5 of a short text, or of the head and tail of a long one, and the size in bytes."""
    b = F.encode(_c(text), "utf-8")
    n = F.octet_length(_c(text))
    ends = F.concat(F.substring(b, 1, part), F.substring(b, -part, part))
    return F.concat_ws("_", F.md5(F.when(n <= whole, b).otherwise(ends)), n.cast("string"))


def short_id(prefix: str, text: str | Column, size: int = 10) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(_c(text), 256), 1, size))


def joined_text(*parts: str | Column) -> Column:
    """Non-blank parts, trimmed, with a blank line between."""
    return F.concat_ws("\n\n", *[F.nullif(F.trim(_c(p)), F.lit("")) for p in parts])


def tag(text: str | Column, name: str) -> Column:
    """What stands between the first <name> and </name>, trimmed; empty if there is none."""
    return F.trim(F.regexp_extract(_c(text), f"(?s)<{name}>(.*?)</{name}>", 1))


def tag_body(text: str | Column, name: str) -> Column:
    """Like tag(), without white space of any kind at the ends."""
    return F.regexp_replace(tag(text, name), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def salvage_json(text: str | Column) -> Column:
    """The JSON text of an answer: itself if valid, else from the first to the last brace, else null."""
    text = _c(text)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)


def html_heading(html: str | Column) -> tuple[Column, Column]:
    """Level and title of the first HTML heading; a null level and an empty title where there is none."""
    pattern = r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"
    level = F.regexp_extract(_c(html), pattern, 1)
    return F.when(level != "", level.cast("bigint")), F.trim(F.regexp_replace(F.regexp_extract(_c(html), pattern, 2), "<[^>]+>", ""))


def log_tf(tf: str | Column) -> Column:
    tf = _c(tf)
    return F.when(tf > 0, 1 + F.ln(tf)).otherwise(F.lit(0.0))


def human_size(n: str | Column) -> Column:
    """Bytes, KB or MB with one decimal; ties go to the even digit."""
    n = _c(n).cast("double")
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("bigint")))
        .when(n < 1048576, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / 1048576, 1)))
    )


def head_mid_tail(text: str | Column, budget: int) -> Column:
    """40 % head, 20 % middle, 40 % tail of a text over the budget."""
    text = _c(text)
    a, b = budget * 2 // 5, budget // 5
    mid = F.call_function("substring", text, (F.floor(F.length(text) / 2) - b // 2 + 1).cast("int"), F.lit(b))
    return F.when(F.length(text) <= budget, text).otherwise(F.concat_ws("\n...\n", F.substring(text, 1, a), mid, F.call_function("right", text, F.lit(a))))


def words(text: str | Column, pattern: str = r"[\p{L}\p{N}]+") -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(pattern), F.lit(0))


def n_grams(items: Column, n: int) -> Column:
    """Runs of n items, joined by spaces; none if there are fewer."""
    at = F.sequence(F.lit(1), F.size(items) - (n - 1))
    return F.when(F.size(items) >= n, F.transform(at, lambda i: F.array_join(F.slice(items, i, n), " "))).otherwise(F.array().cast("array<string>"))


def cjk_tokens(text: str | Column) -> Column:
    """Distinct words; of Han runs also the pairs and triples of signs."""
    base = words(text)
    han = F.filter(base, lambda w: w.rlike(r"\p{IsHan}"))

    def parts(n: int) -> Column:
        cut = lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.transform(han, cut))

    return F.array_distinct(F.concat(base, parts(2), parts(3)))


def preprocess(text: str | Column, keep: str = "") -> Column:
    """Lower case, signs other than those to keep to spaces, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), rf"[^\p{{L}}\p{{N}}\s{keep}]", " "), r"\s+", " "))


#: Words that mark a question as comparing, or as asking for a number.
COMPARING = ("compare", "difference", "versus", "between", "trend", "why")
COUNTING = ("how many", "how much", "percent", "total", "average", "number of")


def complexity(query: str | Column) -> Column:
    q = F.lower(_c(query))
    hard = reduce(lambda a, b: a | b, [F.contains(q, F.lit(w)) for w in COMPARING])
    return F.when(hard | (F.length(q) > 120), "complex").when(F.length(q) > 40, "moderate").otherwise("simple")


def quantity(text: str | Column) -> Column:
    """How much a text is about numbers, between 0 and 1."""
    w = words(text)
    digits = F.size(F.filter(w, lambda x: x.rlike("[0-9]")))
    return F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide(digits * 4, F.size(w)), F.lit(0.0))), 6)


def coverage(text: str | Column, terms: list[str]) -> Column:
    """The share of terms that occur in a text."""
    low = F.lower(_c(text))
    return F.round(reduce(lambda a, b: a + b, [F.contains(low, F.lit(t)).cast("int") for t in terms]) / F.lit(float(len(terms))), 6)


def pages_named(text: str | Column) -> Column:
    """Page numbers that a text names: "page 60", "pp. 12-15" (a span of 10 pages at most)."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"(?:pages?|pp?\.)\s*(\d{1,3})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x.cast("int")), lambda n: n.between(1, 500))))


def number_of(text: str | Column) -> Column:
    """The value of a written number: currency and thousands signs, parentheses as minus, percent, magnitude words."""
    t = F.lower(F.trim(_c(text)))
    digits = F.regexp_extract(F.regexp_replace(t, "[,$€£]", ""), r"(\d+(?:\.\d+)?)", 1)
    sign = F.when(t.rlike(r"^\(.*\)$") | t.rlike(r"^-"), -1.0).otherwise(1.0)
    scale = F.when(t.rlike(r"(?:\d|\s)(?:b|bn|billion)\b"), 1e9).when(t.rlike(r"(?:\d|\s)(?:m|mn|million)\b"), 1e6).when(t.rlike(r"(?:\d|\s)(?:k|thousand)\b"), 1e3).when(t.contains("%"), 0.01).otherwise(1.0)
    return F.when(digits != "", sign * digits.cast("double") * scale)


def near(a: str | Column, b: str | Column, relative: float = 0.02, absolute: float = 0.3, small: float = 10.0) -> Column:
    """Equal within a relative tolerance, or an absolute one if both are small."""
    a, b = _c(a), _c(b)
    both = (F.abs(a) < small) & (F.abs(b) < small)
    return F.when(both, F.abs(a - b) <= absolute).otherwise(F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b)))


def plain_answer(text: str | Column) -> Column:
    """An answer without markup, quotes, currency and thousands signs, in lower case."""
    t = F.regexp_replace(_c(text), r"[*_`\"']", "")
    t = F.regexp_replace(t, r"(?i)^\s*(?:answer|final answer)\s*:\s*", "")
    t = F.regexp_replace(t, r"[$€£,]", "")
    return F.lower(F.trim(F.regexp_replace(t, r"(\d+\.\d*?)0+\b", "$1")))


def safe_name(text: str | Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(_c(text), "/"), -1), r"[^A-Za-z0-9._-]", "_")


def token_estimate(text: str | Column, per: float = 3.5) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_c(text)) / F.lit(per))).cast("bigint")


def dot(a: str | Column, b: str | Column) -> Column:
    zipped = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors; null if a length is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def name_score(name: str | Column, query: str) -> Column:
    """How well a file name matches a query: whole, start, inside, or the share of the query's length."""
    name, low, q = _c(name), F.lower(_c(name)), query.lower()
    return (
        F.when(name == query, 1.0).when(low == q, 0.9).when(name.startswith(query), 0.8).when(low.startswith(q), 0.75)
        .when(name.contains(query), 0.6).when(low.contains(q), 0.55)
        .otherwise(F.round(F.lit(0.3) + F.lit(0.2) * F.least(F.lit(1.0), F.lit(float(len(q))) / F.greatest(F.length(name), F.lit(1))), 6))
    )
