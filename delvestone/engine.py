"""The search entry point: a query in, ranked documents with evidence out.

``Engine.search`` has three modes.  ``FILENAME_ONLY`` ranks file names.
``FAST`` reuses a stored cluster if one is near enough, else ranks files by
keywords and reads context windows around the hits.  ``DEEP`` unites several
sources of files, samples windows of interest from each, and goes on with what
the evidence doesn't cover, until it is accepted or the rounds are over.

Every step that needs a model is a hook with a deterministic default.  What
the driver sees are the keys and scores of at most ``top_k`` files; texts stay
in frames, and each frame comes from a filter on a few keys.

Results of the edge cases: a blank query, an empty corpus and a query without
hits give no rows; null texts and names never match; a document that several
sources find counts once, at its first source's place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as fn
from .operators import grep, policies, ranking, windows

MODES = ("FAST", "DEEP", "FILENAME_ONLY")


def words_of(query: str) -> list[str]:
    """The default of the keyword step: the query's words that say something, in order."""
    import re

    own = re.findall(r"[a-z0-9]{2,}", query.lower())
    return list(dict.fromkeys(w for w in own if w not in ranking.STOP_WORDS))


def with_history(query: str, history: list[dict]) -> str:
    """The default of the rewriting step: a query of fewer than three words that say something is joined to the user's last one."""
    last = next((m["content"] for m in reversed(history[-6:]) if m.get("role") == "user" and m.get("content")), "")
    return f"{last} {query}" if last and len(words_of(query)) < 3 else query


@dataclass
class Hooks:
    """Steps that a model may take over."""

    keywords: Callable[[str], list[str]] = words_of
    rewrite: Callable[[str, list[dict]], str] = with_history
    chat: Callable[[str], str] = lambda query: ""
    embed: Callable[[str], list[float]] | None = None
    choose: Callable[[list], list[int]] | None = None  # places of the documents wanted, from rows of key and name
    accept: Callable[[str, DataFrame], bool] | None = None  # does the evidence answer the query?


@dataclass
class Engine:
    """``docs`` has a key and a text; the other frames are optional: ``names`` (key, name), ``catalog`` (key, name, summary), ``trees`` (key), ``clusters`` (cluster, vector, file, content)."""

    spark: SparkSession
    docs: DataFrame
    key: str = "doc_id"
    text: str = "text"
    names: DataFrame | None = None
    catalog: DataFrame | None = None
    trees: DataFrame | None = None
    clusters: DataFrame | None = None
    hooks: Hooks = field(default_factory=Hooks)
    log: list[tuple[str, str]] = field(default_factory=list)

    def _empty(self) -> DataFrame:
        kind = self.docs.schema[self.key].dataType
        names = [(self.key, kind), ("place", T.LongType()), ("score", T.DoubleType()), ("source", T.StringType()), ("evidence", T.StringType()), ("reason", T.StringType())]
        return self.spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in names]))

    def search(
        self, query: str, mode: str = "FAST", *, top_k: int = 5, scope: Column | None = None, include: list[str] | None = None, exclude: list[str] | None = None,
        history: list[dict] | None = None, rounds: int = 3, budget: int = 40_000, similar: float = 0.85,
    ) -> DataFrame:
        """(key, place, score, source, evidence, reason), best first by place."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.log = []
        if not query or not query.strip():
            return self._empty()
        docs = self.docs if scope is None else self.docs.where(scope)
        names = self.names
        if names is not None and (include or exclude):
            names = grep.glob_filter(names, include or [], exclude or [], "name")
            docs = docs.join(names.select(self.key).distinct(), self.key, "left_semi")
        if mode == "FILENAME_ONLY":
            return self._by_name(query, names, top_k)
        if history:
            query = self.hooks.rewrite(query, history)
        if policies.is_small_talk(query):
            self.log.append(("chat", query))
            one = self.spark.createDataFrame([(self.hooks.chat(query),)], "evidence string")
            kind = self.docs.schema[self.key].dataType
            return one.select(F.lit(None).cast(kind).alias(self.key), F.lit(1).cast("bigint").alias("place"), F.lit(0.0).alias("score"), F.lit("chat").alias("source"), "evidence", F.lit("chat").alias("reason"))
        reused = self._reuse(query, similar)
        if reused is not None:
            return reused
        return self._fast(query, docs, names, top_k, budget) if mode == "FAST" else self._deep(query, docs, names, top_k, rounds, budget)

    def _by_name(self, query: str, names: DataFrame | None, top_k: int) -> DataFrame:
        words = words_of(query)
        if names is None or not words:
            return self._empty()
        held = F.greatest(*[F.contains(F.lower("name"), F.lit(w)) for w in words], F.lit(False))
        score = F.round(fn.name_score("name", query) + ranking.name_overlap("name", query), 6)
        best = names.where(held).select(self.key, "name", score.alias("score")).distinct().orderBy(F.desc("score"), "name", self.key).limit(top_k)
        return self._placed(best.select(self.key, "score", F.lit("name").alias("source"), F.col("name").alias("evidence"), F.lit("name").alias("reason")))

    def _placed(self, rows: DataFrame, order: list | None = None) -> DataFrame:
        """Places of the few rows that come out."""
        place = F.row_number().over(Window.orderBy(*(order or [F.desc("score")]), self.key)).cast("bigint")
        return rows.withColumn("place", place).select(self.key, "place", "score", "source", "evidence", "reason")

    def _reuse(self, query: str, similar: float) -> DataFrame | None:
        """The files of the nearest of the three nearest clusters, if it is near enough."""
        if self.clusters is None or self.hooks.embed is None:
            return None
        best = ranking.nearest(self.clusters.select("cluster", "vector").distinct(), "cluster", "vector", self.hooks.embed(query), 3, similar).limit(1).collect()
        if not best:
            return None
        self.log.append(("reuse", best[0]["cluster"]))
        own = self.clusters.where(F.col("cluster") == best[0]["cluster"]).select(F.col("file").alias(self.key), F.lit(best[0]["cos"]).alias("score"), F.lit("cluster").alias("source"), F.col("content").alias("evidence"), F.lit("reused").alias("reason"))
        return self._placed(own.where(F.col(self.key).isNotNull()).distinct())

    def rank(self, query: str, keywords: list[str], docs: DataFrame, names: DataFrame | None, top_k: int) -> DataFrame:
        return ranking.rank_files(docs, self.key, self.text, keywords, top_k, query=query, catalog=self.catalog, trees=self.trees, names=names)

    def _fast(self, query: str, docs: DataFrame, names: DataFrame | None, top_k: int, budget: int) -> DataFrame:
        keywords = self.hooks.keywords(query)
        if not keywords:
            return self._empty()
        ranked = self.rank(query, keywords, docs, names, top_k).collect()  # top_k rows
        self.log.append(("keywords", " ".join(keywords)))
        if not ranked:
            return self._empty()
        scores = {r[self.key]: r["score"] for r in ranked}
        rows = self._context(docs.where(F.col(self.key).isin(list(scores))), keywords, budget)
        score = F.coalesce(*[F.when(F.col(self.key) == k, F.lit(s)) for k, s in scores.items()])
        reason = ranking.acceptance(F.lit(query), "evidence")
        return self._placed(rows.select(self.key, score.alias("score"), F.lit("keywords").alias("source"), "evidence", reason.alias("reason")))

    def _context(self, docs: DataFrame, keywords: list[str], budget: int, reach: int = 30, few: int = 2, wide: int = 100) -> DataFrame:
        """(key, evidence): the lines around the hits of a few documents; further around where there are ``few`` hits; the head where there are none."""
        lines = F.split(F.col(self.text), "\n")
        own = docs.select(self.key, lines.alias("l"), F.filter(F.transform(lines, lambda x, i: F.when(F.greatest(*[F.contains(F.lower(x), F.lit(k.lower())) for k in keywords], F.lit(False)), i)), lambda i: i.isNotNull()).alias("h"))
        far = F.when(F.size("h") <= few, F.lit(wide)).otherwise(F.lit(reach))
        own = own.withColumn("far", far)
        kept = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda r: F.exists("h", lambda h: F.abs(h - r["i"]) <= F.col("far")))
        own = own.withColumn("k", kept)
        joined = F.aggregate(
            "k", F.struct(F.lit(-1).alias("last"), F.lit("").alias("out")),
            lambda s, r: F.struct(
                r["i"].alias("last"),
                F.when(s["last"] < 0, r["x"]).when(r["i"] == s["last"] + 1, F.concat(s["out"], F.lit("\n"), r["x"])).otherwise(F.concat(s["out"], F.lit("\n...\n"), r["x"])).alias("out"),
            ),
        )["out"]
        return own.select(self.key, F.substring(F.when(F.size("k") > 0, joined).otherwise(F.array_join(F.slice("l", 1, 2 * reach), "\n")), 1, budget).alias("evidence"))

    def _sources(self, query: str, keywords: list[str], docs: DataFrame, names: DataFrame | None, top_k: int) -> list[tuple[object, float, str]]:
        """(key, score, source) of the files that the sources find, in the sources' order, each file once."""
        found: list[tuple[object, float, str]] = []
        if keywords:
            found += [(r[self.key], r["score"], "keywords") for r in self.rank(query, keywords, docs, names, top_k).collect()]
        if self.catalog is not None and keywords:
            overlap = F.size(F.array_intersect(fn.words(F.concat_ws(" ", "name", "summary"), "[a-z0-9]+"), F.array(*map(F.lit, keywords))))
            best = self.catalog.select(self.key, overlap.cast("double").alias("s")).where("s > 0").orderBy(F.desc("s"), self.key).limit(top_k)
            found += [(r[self.key], r["s"], "catalog") for r in best.collect()]
        if self.trees is not None and names is not None:
            roots = names.join(self.trees.select(self.key).distinct(), self.key, "left_semi").select(self.key, "name").distinct()
            chosen = ranking.select_documents(roots, self.key, "name", query, choose=self.hooks.choose)
            found += [(r[self.key], 0.0, "trees") for r in chosen.orderBy(self.key).limit(top_k).collect()]
        if names is not None and keywords:
            best = names.select(self.key, ranking.name_overlap("name", query).alias("s")).distinct().where("s >= 2").orderBy(F.desc("s"), self.key).limit(top_k)
            found += [(r[self.key], r["s"], "names") for r in best.collect()]
        seen: dict = {}
        for k, s, source in found:
            seen.setdefault(k, (k, s, source))
        return list(seen.values())

    def _deep(self, query: str, docs: DataFrame, names: DataFrame | None, top_k: int, rounds: int, budget: int) -> DataFrame:
        keywords = self.hooks.keywords(query)
        chosen: list[tuple[object, float, str]] = []
        wanted, out = keywords, self._empty()
        for number in range(rounds):
            new = [x for x in self._sources(query, wanted, docs, names, top_k) if x[0] not in {c[0] for c in chosen}][:top_k]
            if not new:
                break
            chosen += new
            self.log.append((f"round {number + 1}", " ".join(wanted)))
            out = self._sampled(query, keywords, docs, chosen, budget)
            reasons = {r["reason"] for r in out.select("reason").distinct().collect()}
            if self.hooks.accept is not None and self.hooks.accept(query, out):
                return out.withColumn("reason", F.when(F.col("reason") == "reject", "judged").otherwise(F.col("reason")))
            if reasons - {"reject"}:
                break
            covered = out.agg(*[F.max(F.contains(F.lower("evidence"), F.lit(k))).alias(f"c{i}") for i, k in enumerate(keywords)]).first() if keywords else ()
            wanted = [k for k, c in zip(keywords, covered) if not c]
            if not wanted:
                break
        return out

    def _sampled(self, query: str, keywords: list[str], docs: DataFrame, chosen: list[tuple[object, float, str]], budget: int) -> DataFrame:
        """Windows of interest of the chosen documents, joined; a document without any shows its head."""
        keys = [c[0] for c in chosen]
        own = docs.where(F.col(self.key).isin(keys) & F.col(self.text).isNotNull()).select(self.key, self.text)
        found = ranking.roi_windows(own, self.key, self.text, keywords or [""], whole=4000, least=min(4.0, 10 / max(1, len(keywords)) - 1e-3))
        parts = own.join(found, self.key, "left").withColumn("part", F.call_function("substring", F.col(self.text), (F.coalesce("start", F.lit(0)) + 1).cast("int"), F.coalesce(F.col("end") - F.col("start"), F.lit(500)).cast("int")))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda r: r["part"]), "\n...\n")
        rows = parts.groupBy(self.key).agg(F.substring(joined, 1, budget).alias("evidence"))
        score = F.coalesce(*[F.when(F.col(self.key) == k, F.lit(float(s))) for k, s, _ in chosen])
        source = F.coalesce(*[F.when(F.col(self.key) == k, F.lit(x)) for k, _, x in chosen])
        order = F.coalesce(*[F.when(F.col(self.key) == k, F.lit(i)) for i, k in enumerate(keys)])
        rows = rows.select(self.key, score.alias("score"), source.alias("source"), "evidence", ranking.acceptance(F.lit(query), "evidence").alias("reason"), order.alias("o"))
        return self._placed(rows, [F.col("o")])

    def paths(self, keywords: list[str]) -> DataFrame:
        """(key, hits) of every document that holds one of the keywords, with the number of its lines that do."""
        found = grep.grep_or(grep.lines(self.docs, self.key, self.text), [k.lower() for k in keywords])
        return found.groupBy(self.key).agg(F.countDistinct("line_number").alias("hits"))
