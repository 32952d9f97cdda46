"""Ranking of documents: term statistics, BM25, fusion of channels, similarity and sampling."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.lineage import materialise


def line_score(line: str | Column, terms: dict[str, float]) -> Column:
    """Sum over terms of weight times saturated count, doubled where the term stands alone, damped by length."""
    line = F.col(line) if isinstance(line, str) else line
    low, total = F.lower(line), F.lit(0.0)
    for term, weight in terms.items():
        n = (F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / F.lit(float(len(term)))
        alone = F.when(low.rlike(rf"\b{term}\b"), 2.0).otherwise(1.0)
        total = total + F.lit(weight) * (n / (n + 1)) * alone * F.lit(min(1.0, max(0.2, len(term) / 5)))
    return F.round(total / (F.length(line) / F.lit(100.0) + 1), 6)


def _equals(term: str):
    return lambda x: x == F.lit(term)


def _contains(term: str):
    return lambda x: F.contains(x, F.lit(term))


def term_rows(docs: DataFrame, key: str, text: str, terms: list[str], pattern: str = "[a-z]+", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, n, tf, ...): words and counts of the stated terms in each text, written once and read as often as needed.

    The texts are cut into words in one reading; what is kept of each is a few numbers.
    """
    own = docs.where(F.col(text).isNotNull()).select(key, *keep, fn.words(text, pattern).alias("__w"))
    count = [F.size(F.filter("__w", _equals(t))).cast("double") for t in terms]
    return materialise(own.select(key, *keep, F.size("__w").cast("double").alias("n"), F.array(*count).alias("tf")))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.5, b: float = 0.75, pattern: str = "[a-z]+", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, score, ...) of the documents that hold a query token; a repeated token counts as often as it is given."""
    times = {t: query.count(t) for t in query}
    rows = term_rows(docs, key, text, list(times), pattern, keep)
    if not times:
        return rows.limit(0).select(key, F.lit(0.0).alias("score"), *keep)
    total, mean, *found = rows.agg(F.count("*").cast("double"), F.avg("n"), *[F.count_if(F.col("tf")[i] > 0).cast("double") for i in range(len(times))]).first()
    score = F.lit(0.0)
    for i, (t, f) in enumerate(zip(times, found)):
        tf = F.col("tf")[i]
        idf = F.ln((F.lit(total) - f + 0.5) / (F.lit(f) + 0.5) + 1)
        score = score + times[t] * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.lit(mean or 1.0)))
    held = F.exists("tf", lambda x: x > 0)
    return rows.where(held).select(key, F.round(score, 6).alias("score"), *keep)


def fuse(scores: DataFrame, key: str, channels: dict[str, float], missing: float = -3.0) -> DataFrame:
    """Weighted sum of the channels' z-scores, through the logistic function."""
    stats = scores.agg(*[f(c).alias(f"{c}_{n}") for c in channels for n, f in (("m", F.avg), ("s", F.stddev_pop), ("k", F.count))]).first()  # one row of numbers
    total = F.lit(0.0)
    for c, weight in channels.items():
        mean, spread, n = (stats[f"{c}_{x}"] for x in "msk")
        if n < 2:
            z = F.col(c)
        elif spread < 1e-9:
            z = F.lit(0.0)
        else:
            z = (F.col(c) - F.lit(mean)) / F.lit(spread)
        total = total + F.lit(weight) * F.coalesce(z if n >= 2 and spread >= 1e-9 else F.when(F.col(c).isNotNull(), z), F.lit(missing))
    return scores.select(key, F.round(1 / (1 + F.exp(-total)), 6).alias("score"))


#: Words of a query that say nothing, and words that ask for a number.
STOP_WORDS = (
    "the", "is", "a", "an", "of", "in", "for", "to", "and", "or", "what", "how", "which", "does", "was", "were", "has", "have", "had",
    "do", "did", "are", "be", "been", "by", "with", "from", "this", "that", "it", "its", "on", "at", "as", "not", "no",
)
NUMERIC_INTENT = (
    "revenue", "margin", "ratio", "ebitda", "income", "profit", "loss", "cash", "debt", "equity", "eps", "dpo", "growth", "rate",
    "percentage", "amount", "total", "net", "gross", "cost", "expense", "sales", "fy", "fiscal",
)


def query_words(query: str | Column) -> Column:
    """The words of a query that say something, as an array."""
    c = F.lower(F.col(query) if isinstance(query, str) else query)
    return F.filter(F.regexp_extract_all(c, F.lit(r"\b[a-z0-9]{2,}\b"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))


def query_coverage(query: str | Column, evidence: str | Column) -> Column:
    """The share of a query's words that stand in a text; 0 if the query has none."""
    own, low = query_words(query), F.lower(F.coalesce(F.col(evidence) if isinstance(evidence, str) else evidence, F.lit("")))
    return F.coalesce(F.try_divide(F.size(F.filter(own, lambda w: F.contains(low, w))), F.size(own)), F.lit(0.0))


def numeric_evidence(query: str | Column, evidence: str | Column) -> Column:
    """Does the query ask for a number, and has the text an amount, a share or a number with thousands signs?"""
    q = F.lower(F.col(query) if isinstance(query, str) else query)
    e = F.coalesce(F.col(evidence) if isinstance(evidence, str) else evidence, F.lit(""))
    return q.rlike("|".join(NUMERIC_INTENT)) & e.rlike(r"[$€£]\s?\d|(?<![\p{L}\p{N}_])\d[\d,.]*\s?%|(?<![\p{L}\p{N}_])\d{1,3}(?:,\d{3})+")


def acceptance(query: str | Column, evidence: str | Column, complete: Column | None = None, judged: Column | None = None, least: int = 800, share: float = 0.3) -> Column:
    """Why evidence is accepted, or ``reject``: retrieval is complete, a judge accepts it, it is long and covers the query, or it has the numbers asked for."""
    e = F.col(evidence) if isinstance(evidence, str) else evidence
    no = F.lit(False)
    return (
        F.when(F.coalesce(complete if complete is not None else no, no), "complete").when(F.coalesce(judged if judged is not None else no, no), "judged")
        .when((F.length(e) >= least) & (query_coverage(query, evidence) >= share), "coverage")
        .when(numeric_evidence(query, evidence), "numeric").otherwise("reject")
    )


def topic_relevance(name: str | Column, summary: str | Column, query: str, keywords: list[str], in_tree: Column | None = None) -> Column:
    """Between 0 and 10: up to 5 for the keywords in name and summary (a part of a word counts half, the whole query once more), 0.5 for a tree, 1 to 2 for the summary's length."""
    summary = F.coalesce(F.col(summary) if isinstance(summary, str) else summary, F.lit(""))
    name = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    low = F.lower(F.concat(summary, F.lit(" "), name))
    own, hits, total = fn.words(low), F.lit(0.0), 0
    for k in [k.lower() for k in keywords if k]:
        hits = hits + F.when(F.array_contains(own, k), 1.0).when(F.contains(low, F.lit(k)), 0.5).otherwise(0.0)
        total += 1
    whole = F.contains(low, F.lit(query.lower())) if len(query) >= 2 else F.lit(False)
    hits, parts = hits + F.when(whole, 1.0).otherwise(0.0), F.lit(float(total)) + F.when(whole, 1.0).otherwise(0.0)
    if total:
        overlap = hits / parts
    else:  # no keywords: the share of the query's characters
        chars = sum((F.contains(low, F.lit(c)).cast("double") for c in query.lower()), F.lit(0.0)) / max(1, len(query))
        overlap = F.when(whole, F.lit(1.0)).otherwise(chars)
    n = F.length(summary)
    size = F.when(n > 100, 2.0).when(n > 30, 1.5).when(n > 0, 1.0).otherwise(0.0)
    tree = F.when(F.coalesce(in_tree, F.lit(False)), 0.5).otherwise(0.0) if in_tree is not None else F.lit(0.0)
    return F.least(F.lit(10.0), overlap * 5.0 + tree + size)


def rank_files(
    docs: DataFrame, key: str, text: str, keywords: list[str], top_k: int = 5, idfs: dict[str, float] | None = None, query: str = "",
    catalog: DataFrame | None = None, trees: DataFrame | None = None, probed: DataFrame | None = None, names: DataFrame | None = None,
    blend: float = 0.85, boost: float = 3.0,
) -> DataFrame:
    """(key, score) of the files that match best.

    A file's score is the sum over the keywords of their weight times
    1 + ln of the number of lines that hold them.  Where no file holds any, the
    first file whose name (``names``: key, name) does comes out with a score of
    0, else those whose catalogue summary is nearest by BM25, on a scale of 10.
    With a ``catalog`` (key, name, summary) scores are brought to a scale of 10
    and blended with :func:`topic_relevance`, for which ``trees`` (key) have a
    bonus; files that a tree search chose (``probed``: key) are lifted.  What
    is left after pruning by floor and gap comes out, ``top_k`` files at most.
    """
    from .windows import gap_prune

    words = [k.lower() for k in dict.fromkeys(keywords) if k]
    weight = {k: (idfs or {}).get(k, max(0.5, min(1.0, len(k) / 5))) for k in words}
    lines = F.split(F.lower(F.col(text)), "\n")
    tf = F.array(*[F.size(F.filter(lines, _contains(k))).cast("double") for k in words]) if words else F.array().cast("array<double>")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), tf.alias("tf")).where(F.exists("tf", lambda x: x > 0))
    score = sum((F.lit(w) * fn.log_tf(F.col("tf")[i]) for i, w in enumerate(weight.values())), F.lit(0.0))
    found = rows.select("key", score.alias("score"))
    if catalog is not None or names is not None:
        found = materialise(found)  # read again for its greatest score
        if found.isEmpty():
            if names is not None and words:
                held = F.lower("name").rlike("|".join(re.escape(k) for k in words))
                first = names.where(held).select(F.col(key).alias("key"), "name").orderBy("name", "key").limit(1)
                if not first.isEmpty():
                    return first.select(F.col("key").alias(key), F.lit(0.0).alias("score"))
            if catalog is None:
                return found.select(F.col("key").alias(key), "score")
            near = bm25(catalog, key, "summary", re.findall("[a-z]+", query.lower()) or words)
            # of the index's scores the greatest counts 10
            best = near.agg(F.max("score")).first()[0]
            found = near.select(F.col(key).alias("key"), (F.col("score") / (best or 1.0) * 10.0).alias("score"))
    if catalog is not None:
        top = found.agg(F.max("score")).first()[0]
        own = catalog.select(F.col(key).alias("key"), "name", "summary", F.lit(True).alias("__in"))
        found = found.join(own, "key", "left")
        if trees is not None:
            found = found.join(trees.select(F.col(key).alias("key")).distinct().withColumn("__tree", F.lit(True)), "key", "left")
        known = F.coalesce("__in", F.lit(False))
        in_tree = F.col("__tree") if trees is not None else F.lit(False)
        topic = F.when(known, topic_relevance("name", "summary", query, words, in_tree)).otherwise(F.when(F.coalesce(in_tree, F.lit(False)), 0.5).otherwise(0.0))
        scale = 10.0 / top if top and top > 0 else 10.0
        found = found.select("key", (F.lit(blend) * F.col("score") * F.lit(scale) + F.lit(1 - blend) * topic).alias("score"))
    if probed is not None:
        lift = probed.select(F.col(key).alias("key")).distinct().withColumn("__p", F.lit(boost))
        found = found.join(lift, "key", "left").select("key", (F.col("score") + F.coalesce("__p", F.lit(0.0))).alias("score"))
    best = found.select("key", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "key").limit(top_k)  # pruning only cuts this order short
    return gap_prune(best.withColumn("__all", F.lit(0)), ["__all"], "score", "key", most=top_k).select(F.col("key").alias(key), "score")


def select_documents(roots: DataFrame, key: str, name: str, query: str, most: int = 3, few: int = 15, candidates: int = 10, least: float = 0.5, choose=None) -> DataFrame:
    """(key) of the documents that a query asks for, by their names; all of them if there are no more than ``most``.

    Over ``few`` documents are first cut to ``candidates`` by
    :func:`name_overlap`; ``choose(rows)`` (a model; rows are the candidates,
    at most ``few``) gives the places of those it wants, by default the first.
    """
    rows = roots.select(key, name)
    own = rows.withColumn("score", name_overlap(name, query))
    head = rows.orderBy(key).limit(few + 1).collect()
    if len(head) <= most:
        return rows.select(key)
    if len(head) > few:
        best = own.where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(candidates).collect()
        head = best or own.orderBy(F.desc("score"), key).limit(candidates).collect()
        if len(head) <= most:
            choose = None
    places = [i for i in (choose(head) if choose else []) if 0 <= i < len(head)] or range(min(most, len(head)))
    picked = [head[i][key] for i in list(places)[:most]]
    return roots.where(F.col(key).isin(picked)).select(key).distinct()


def name_overlap(name: str | Column, query: str) -> Column:
    """How well a file's name matches a query: 2 for each word in it, 0.5 for a word's first four letters, 3 for each year."""
    stem = F.regexp_replace(F.lower(F.col(name) if isinstance(name, str) else name), r"\.[^.]+$", "")
    own = [t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) >= 2 and t not in STOP_WORDS]
    years = {m[0] for t in own if (m := re.search(r"(?:19|20)\d{2}", t))}
    score = F.lit(0.0)
    for t in dict.fromkeys(t for t in own if t not in years):
        part = F.when(F.contains(stem, F.lit(t[:4])), 0.5) if len(t) >= 4 and t[:4].isalnum() else F.when(F.lit(False), 0.5)
        score = score + F.coalesce(F.when(F.contains(stem, F.lit(t)), 2.0), part, F.lit(0.0))
    for y in sorted(years):
        score = score + F.when(F.contains(stem, F.lit(y)), 3.0).otherwise(0.0)
    return score


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, least: float = -1.0, by_name: str = "cos") -> DataFrame:
    """The k rows most similar to a query vector, then those of at least ``least``."""
    q = F.array(*[F.lit(float(x)) for x in query])
    own = vectors.where(F.size(vector) == len(query)).select(key, F.round(fn.cosine(vector, q), 6).alias(by_name))
    return own.orderBy(F.desc(by_name), key).limit(k).where(F.col(by_name) >= least)


def mmr(candidates: DataFrame, key: str, vector: str, score: str, k: int, balance: float = 0.7) -> list:
    """Greedy choice of k relevant and unlike rows among all candidates.

    Each choice is a top-1 over the rows, which hold their greatest cosine to
    the rows chosen before; only the chosen row comes to the driver.
    """
    rows = candidates.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.col(score).alias("s")).where(F.col("s").isNotNull() & F.col("key").isNotNull())
    rows = materialise(rows.withColumn("like", F.lit(0.0)))
    chosen: list = []
    for _ in range(k):
        value = F.lit(balance) * F.col("s") - F.lit(1 - balance) * F.col("like")
        best = rows.where(~F.col("key").isin(chosen)) if chosen else rows
        best = best.select("key", "v", value.alias("value")).orderBy(F.desc("value"), "key").limit(1).collect()
        if not best:
            break
        chosen.append(best[0]["key"])
        if len(chosen) < k:
            own = F.array(*[F.lit(float(x)) for x in best[0]["v"] or []])
            near = F.coalesce(fn.cosine("v", own), F.lit(0.0)) if best[0]["v"] else F.lit(0.0)
            rows = materialise(rows.withColumn("like", F.greatest("like", near) if len(chosen) > 1 else near))
    return chosen


def stable_uniform(*columns: str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the row's key and the seed only, so that a lost task draws the same again."""
    return (F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def weighted_sample(df: DataFrame, key: str, weight: str | Column, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, by weight: those of the smallest exponential keys."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    return df.withColumn("__k", -F.ln(stable_uniform(key, seed=seed)) / weight).orderBy("__k", key).limit(n).drop("__k")


def stratified_share(df: DataFrame, stratum: str, order: list, n: int) -> DataFrame:
    """Of each stratum its share of n rows, one at least, in order."""
    size = df.groupBy(stratum).agg(F.count("*").alias("__c"))
    total = size.agg(F.sum("__c").alias("__t"))
    w = Window.partitionBy(stratum).orderBy(*order)
    share = F.greatest(F.lit(1), F.floor(F.col("__c") * n / F.col("__t")))
    return df.withColumn("__r", F.row_number().over(w)).join(size, stratum).join(F.broadcast(total)).where(F.col("__r") <= share).drop("__r", "__c", "__t")


def text_windows(df: DataFrame, key: str, text: str, size: int = 500, stride: int = 250) -> DataFrame:
    """Overlapping windows of a text, (key, start, content)."""
    n = F.greatest(F.lit(0), F.length(text) - size)
    own = df.where(F.length(text) > 0).select(key, F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), n, F.lit(stride))).alias("start"))
    return own.select(key, F.col("start").cast("bigint").alias("start"), F.call_function("substring", F.col("__t"), F.col("start") + 1, F.lit(size)).alias("content"))


def roi_windows(
    df: DataFrame, key: str, text: str, terms: list[str], rounds: int = 3, per_round: int = 8, size: int = 500, top: int = 5,
    seeds: int = 2, least: float = 4.0, enough: float = 8.5, whole: int = 100_000, seed: int = 0,
) -> DataFrame:
    """(key, start, end, score) of the best windows of each text, by sampling.

    A text of up to ``whole`` characters is one window.  Of a longer one, the
    first round looks around the places of the terms and at one place in each
    of ``per_round`` strata, no two within half a window; the next ones draw
    around the ``seeds`` best windows of at least ``least``, from a normal
    distribution whose deviation is a twentieth of the text and is halved each
    round, no two within a third of a window.  A window of ``enough`` ends the
    search; the ``top`` best of at least ``least`` come out.  A window's score
    is ten times the share of the terms in it.  Draws depend on key and seed
    only.  The terms' places are found once for each text, in Arrow batches.
    """
    kind = df.schema[key].dataType.simpleString()
    own = [t.lower() for t in terms]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, (k, body) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                for start, end, score in windows_of(k, body, own, np, rounds, per_round, size, top, seeds, least, enough, whole, seed):
                    for column, value in zip(out, (i, start, end, score)):
                        column.append(value)
            arrays = [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "start", "end", "score"])

    return df.where(F.length(text) > 0).select(key, text).mapInArrow(run, f"`{key}` {kind}, start bigint, end bigint, score double")


def windows_of(key, text: str, terms: list[str], np, rounds: int, per_round: int, size: int, top: int, seeds: int, least: float, enough: float, whole: int, seed: int) -> list[tuple[int, int, float]]:
    """Of one text: (start, end, score) of its best sampled windows."""
    low, n = text.lower(), len(text)
    places = []
    for t in terms:
        found, at = [], low.find(t)
        while at >= 0:
            found.append(at)
            at = low.find(t, at + 1)
        places.append(np.array(found, np.int64))

    def score(a: int, b: int) -> float:
        inside = sum(bool(len(p) and (k := int(np.searchsorted(p, a))) < len(p) and p[k] + len(t) <= b) for p, t in zip(places, terms))
        return round(10.0 * inside / max(1, len(terms)), 6)

    if n <= whole or n <= size:
        s = score(0, n)
        return [(0, n, s)] if s >= least else []
    rng = np.random.default_rng(zlib.crc32(f"{key}/{seed}".encode("utf-8", "surrogatepass")))
    seen: list[int] = []
    found: list[tuple[float, int]] = []

    def look(start: int, apart: int) -> None:
        start = max(0, min(n - size, start))
        if all(abs(start - x) >= apart for x in seen):
            seen.append(start)
            found.append((score(start, start + size), start))

    anchors = np.concatenate(places) if places else np.zeros(0, np.int64)
    for at in sorted(anchors.tolist())[:: max(1, len(anchors) // per_round)][:per_round]:
        look(at - size // 2, size // 2)
    step = n // per_round
    for i in range(per_round):
        low_end, high_end = i * step, max(i * step, min((i + 1) * step, n) - size)
        look(int(rng.integers(low_end, high_end + 1)), size // 2)
    for r in range(1, rounds):
        if max((s for s, _ in found), default=0.0) >= enough:
            break
        around = sorted((x for x in found if x[0] >= least), key=lambda x: (-x[0], x[1]))[:seeds]
        for _, start in around:
            for x in rng.normal(start + size // 2, n / 20 / 2 ** (r - 1), -(-per_round // len(around))):
                look(int(x) - size // 2, size // 3)
    best = sorted((x for x in found if x[0] >= least), key=lambda x: (-x[0], x[1]))[:top]
    return [(start, start + size, s) for s, start in best]


def idf_weight(term: str) -> float:
    return max(0.5, min(1.0, len(term) / 5))


def order_keywords(keywords: DataFrame, by: str, word: str, weight: str, order: str, least: float = 7.0) -> DataFrame:
    """Keywords of each group with their place, those of several words first; such a one weighs ``least`` at least."""
    many = F.contains(F.col(word), F.lit(" "))
    place = F.row_number().over(Window.partitionBy(by).orderBy(many.desc(), order)).cast("bigint")
    return keywords.withColumns({"place": place, "weight": F.when(many, F.greatest(F.col(weight), F.lit(least))).otherwise(F.col(weight))})


def overlap_rank(df: DataFrame, key: str, columns: list[str], terms: list[str], k: int) -> DataFrame:
    """(key, overlap) of the k rows whose columns hold most of the terms as words."""
    own = fn.words(F.concat_ws(" ", *columns), r"[\p{L}\p{N}]+")
    n = F.size(F.array_intersect(own, F.array(*[F.lit(t.lower()) for t in terms]))).cast("bigint")
    return df.select(key, n.alias("overlap")).where("overlap > 0").orderBy(F.desc("overlap"), key).limit(k)


def holds_any(columns: list[str], terms: list[str]) -> Column:
    """Does one of the columns hold one of the terms, whatever the case?  Nulls hold none."""
    return F.coalesce(F.greatest(*[F.coalesce(F.contains(F.lower(c), F.lit(t.lower())), F.lit(False)) for c in columns for t in terms], F.lit(False)), F.lit(False))


def relevance_tier(column: str, terms: list[str], prefix: int = 2) -> Column:
    """``high`` if a term is in a name, ``medium`` if a term's first letters are, else ``low``."""
    return F.when(holds_any([column], terms), "high").when(holds_any([column], [t[:prefix] for t in terms]), "medium").otherwise("low")


def merge_hints(parts: list[tuple[DataFrame, str]], key: str, most: int = 15) -> DataFrame:
    """(key, p): an ordered union of hints, each key at the first part that has it, ``most`` in all."""
    out = None
    for i, (df, column) in enumerate(parts, 1):
        one = df.select(F.col(column).alias(key), F.lit(i).cast("bigint").alias("p"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("p").alias("p")).orderBy("p", key).limit(most)


def key_phrases(df: DataFrame, key: str, text: str, n: int = 2, k: int = 5, least: int = 2) -> DataFrame:
    """(key, phrase, times) of the k commonest runs of n words of each text, those of ``least`` occurrences; counted in the text's own row."""
    own = df.where(F.col(text).isNotNull()).select(key, fn.words(text, "[a-z]+").alias("w"))
    own = own.select(key, F.explode(fn.n_grams(F.col("w"), n)).alias("phrase")).groupBy(key, "phrase").agg(F.count("*").alias("times")).where(F.col("times") >= least)
    from .windows import top_per_group

    return top_per_group(own, [key], [F.desc("times"), F.col("phrase")], k).select(key, "phrase", "times")


def evidence_source(table_rows: Column, in_tree: Column, size: Column, hits: Column, small: int = 2000, budget: int = 40_000) -> tuple[Column, Column]:
    """Where a document's evidence comes from, and how many characters at most: its tables, its tree, the whole of a small one, windows around the hits (wide around few), its head."""
    source = (
        F.when(table_rows >= 3, "tables").when(in_tree, "tree").when(size <= small, "whole")
        .when(hits > 2, "windows").when(hits > 0, "wide windows").otherwise("head")
    )
    return source, F.least(size, F.when(source == "head", F.lit(small)).otherwise(F.lit(budget)))
