"""Structure of documents: headings, hierarchy, trees as adjacency tables, tables in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import materialise

#: Words that open a structural heading, by level; lines longer than this aren't numbered headings.
STRUCTURAL = {1: ("PART", "CHAPTER"), 2: ("ITEM", "SECTION", "ARTICLE"), 3: ("APPENDIX", "EXHIBIT", "SCHEDULE", "ANNEX")}
LONGEST = 120


def headings(lines: DataFrame, key: str, column: str = "line") -> DataFrame:
    """Heading lines of three kinds with level, title, and the offset of the line in its text.

    Markdown: one to six marks, the level is their number.  Numbered: the
    number stays in the title, its parts are the level.  Structural: a word of
    ``STRUCTURAL`` and what follows, the word in capitals.
    """
    offset = F.coalesce(F.sum(F.length(column) + 1).over(Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    line = F.col(column)
    marks, after = (F.regexp_extract(line, r"^(#{1,6})[ \t]+(.+)$", i) for i in (1, 2))
    number, text = (F.regexp_extract(line, r"^(\d+(?:\.\d+)*)[. \t]+(.+)$", i) for i in (1, 2))
    opening = "|".join(w for words in STRUCTURAL.values() for w in words)
    word, rest = (F.regexp_extract(line, rf"(?i)^({opening})[ \t]+([\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_ .:\-]*)$", i) for i in (1, 2))
    kind = (
        F.when((marks != "") & (F.trim(after) != ""), "markdown")
        .when((number != "") & (F.trim(text) != "") & (F.length(line) <= LONGEST), "numbered").when(word != "", "structural")
    )
    of_word = F.coalesce(*[F.when(F.upper(word).isin(*words), F.lit(n)) for n, words in STRUCTURAL.items()])
    level = F.when(kind == "markdown", F.length(marks)).when(kind == "numbered", F.size(F.split(number, r"\."))).otherwise(of_word)
    title = F.when(kind == "markdown", F.trim(after)).when(kind == "numbered", F.concat_ws(" ", number, F.trim(text))).otherwise(F.concat_ws(" ", F.upper(word), F.trim(rest)))
    return lines.withColumn("char_start", offset).select(key, "line_number", "char_start", kind.alias("kind"), level.cast("bigint").alias("level"), title.alias("title")).where("kind is not null")


def cascade(found: DataFrame, key: str, kinds: list[str] | None = None) -> DataFrame:
    """Of each document only the headings of the first kind that it has."""
    kinds = kinds or ["markdown", "numbered", "structural"]
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(kinds)])
    return found.withColumn("__k", rank).withColumn("__m", F.min("__k").over(Window.partitionBy(key))).where("__k = __m").drop("__k", "__m")


def outline(found: DataFrame, key: str, least: int = 3) -> DataFrame:
    """The headings of the first kind that a document has, if there are ``least`` of them; a document with fewer has no outline."""
    first = cascade(found, key)
    return first.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where(F.col("__n") >= least).drop("__n")


def depths(nodes: DataFrame, by: str, node: str, parent: str) -> DataFrame:
    """(by, node, depth) of every node below a root, however deep.

    Every node looks twice as far up in each round: its ancestor's ancestor and
    the sum of both distances, so that a tree of depth n takes log n rounds.
    Orphans and cycles have no root and give no row; of several parents of a
    node the smallest counts.  Each round is written to the checkpoint folder.
    """
    up = F.col("__up")
    own = nodes.select(F.col(by).alias("__by"), F.col(node).alias("__node"), F.col(parent).alias("__p")).groupBy("__by", "__node").agg(F.min("__p").alias("__up"))
    state = materialise(own.select("__by", "__node", "__up", F.when(up.isNull(), 0).otherwise(1).cast("bigint").alias("depth")))
    rounds = max(1, state.count()).bit_length() + 1  # a distance over the number of nodes is a cycle's
    for _ in range(rounds):
        todo = state.where(up.isNotNull())
        if todo.isEmpty():
            break
        above = state.select("__by", F.col("__node").alias("__up"), F.col("__up").alias("__next"), F.col("depth").alias("__more"))
        moved = todo.join(above, ["__by", "__up"]).select("__by", "__node", F.col("__next").alias("__up"), (F.col("depth") + F.col("__more")).alias("depth"))
        state = materialise(state.where(up.isNull()).union(moved))
    return state.where(up.isNull()).select(F.col("__by").alias(by), F.col("__node").alias(node), "depth")


def title_paths(nodes: DataFrame, by: str, node: str, parent: str, title: str, between: str = " > ") -> DataFrame:
    """(by, node, path): the titles from the root down to each node; built as ``depths`` is."""
    up = F.col("__up")
    text = F.coalesce(F.trim(F.col(title)), F.lit(""))
    own = nodes.groupBy(F.col(by).alias("__by"), F.col(node).alias("__node")).agg(F.min(parent).alias("__up"), F.min(text).alias("path"))
    state = materialise(own)
    for _ in range(max(1, state.count()).bit_length() + 1):
        todo = state.where(up.isNotNull())
        if todo.isEmpty():
            break
        above = state.select("__by", F.col("__node").alias("__up"), F.col("__up").alias("__next"), F.col("path").alias("__front"))
        moved = todo.join(above, ["__by", "__up"]).select("__by", "__node", F.col("__next").alias("__up"), F.concat_ws(between, "__front", "path").alias("path"))
        state = materialise(state.where(up.isNull()).union(moved))
    return state.where(up.isNull()).select(F.col("__by").alias(by), F.col("__node").alias(node), "path")


def offset_id(offset: str):
    """An id from an offset, of six digits at least; null where there is none."""
    c = F.col(offset).cast("string")
    return F.when(F.col(offset) >= 0, F.concat(F.lit("N"), F.when(F.length(c) < 6, F.lpad(c, 6, "0")).otherwise(c)))


def leaves(nodes: DataFrame, by: str, node: str, parent: str) -> DataFrame:
    inner = nodes.select(by, F.col(parent).alias(node)).where(F.col(node).isNotNull()).distinct()
    return nodes.join(inner, [by, node], "left_anti")


def clean_title(column: str = "title"):
    """A title without marks, padding, links and trailing page references."""
    t = F.regexp_replace(column, r"^\s*#{1,6}\s+|[*_`]{1,3}", "")
    t = F.regexp_replace(t, r"(?:\s*\.{2,}\s*\d+|\s+\(?p{1,2}\.?\s*\d+\)?)\s*$", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def noise_filter(nodes: DataFrame, by: str, title: str, pages: list[str], richness: str, key: str) -> DataFrame:
    """Without untitled nodes, and of nodes of equal title and pages only the richest."""
    w = Window.partitionBy(by, title, *pages).orderBy(F.desc(richness), key)
    return nodes.where(F.coalesce(F.trim(title), F.lit("")) != "").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def pipe_rows(column: str = "line"):
    return F.col(column).rlike(r"^\s*\|.*\|\s*$")


def table_digests(lines: DataFrame, key: str) -> DataFrame:
    """(key, first_line, n_rows, n_cols, header) of the Markdown tables in a text; one column is no table."""
    w = Window.partitionBy(key).orderBy("line_number")
    own = lines.where(pipe_rows() & ~F.col("line").rlike(r"^\s*\|(?:\s*:?-+:?\s*\|)+\s*$"))
    rule = lines.where(F.col("line").rlike(r"^\s*\|(?:\s*:?-+:?\s*\|)+\s*$")).select(key, "line_number", F.lit(1).alias("rule"))
    every = own.select(key, "line_number", "line", F.lit(0).alias("rule")).unionByName(rule.withColumn("line", F.lit(None).cast("string")))
    every = every.withColumn("__g", F.col("line_number") - F.row_number().over(w))
    cells = F.size(F.split(F.trim("line"), r"\|")) - 2
    out = every.groupBy(key, "__g").agg(
        F.min("line_number").alias("first_line"), F.sum(1 - F.col("rule")).alias("n_rows"), F.max(F.when(F.col("rule") == 0, cells)).cast("bigint").alias("n_cols"),
        F.min_by("line", F.when(F.col("rule") == 0, F.col("line_number"))).alias("header"),
    )
    return out.drop("__g").where("n_cols > 1")


def group_pages(df: DataFrame, size: int, key: str, order: str) -> DataFrame:
    return df.withColumn("page", (F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size) + 1).cast("bigint"))


def navigate(nodes: DataFrame, by: str, node: str, terms: list[str], k: int = 3, title: str = "title", summary: str = "summary") -> DataFrame:
    """(by, node, score, r): of each document the k nodes whose titles (2 for each term) and summaries (1) hold most of the terms."""
    low, more = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(summary, F.lit("")))
    score = sum((2 * F.contains(low, F.lit(t.lower())).cast("bigint") + F.contains(more, F.lit(t.lower())).cast("bigint") for t in terms), F.lit(0).cast("bigint"))
    own = nodes.withColumn("score", score).where("score > 0")
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), node)).cast("bigint")
    return own.withColumn("r", r).where(F.col("r") <= k).select(by, node, "score", "r")


def located(docs: DataFrame, key: str, text: str, proposed: DataFrame, title: str = "title") -> DataFrame:
    """Proposed headings (key, title, ...) with the offset where each first stands in its text; those that don't are left out."""
    at = (F.call_function("instr", F.col(text), F.col(title)) - 1).cast("bigint")
    return proposed.join(docs.select(key, text), key).withColumn("char_start", at).where("char_start >= 0").drop(text)


def halves(text: str, start: int, end: int) -> int:
    """The default of the splitting step: the place after the blank line, else line, nearest to the middle."""
    middle = (start + end) // 2
    for mark in ("\n\n", "\n", " "):
        a, b = text.rfind(mark, start + 1, middle), text.find(mark, middle, end - 1)
        near = [x + len(mark) for x in (a, b) if x >= 0 and start < x + len(mark) < end]
        if near:
            return min(near, key=lambda x: (abs(x - middle), x))
    return middle


def recursive_tree(docs: DataFrame, key: str, text: str, leaf: int = 5000, split=halves) -> DataFrame:
    """(key, node_id, parent_id, level, char_start, char_end): each text cut in two until no part is over ``leaf`` characters.

    ``split(text, start, end)`` gives the place to cut at; null and empty texts
    have no node.  A node's id is its parent's and the number of the half.
    """
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            row, out = [], [[], [], [], [], []]
            for i, body in enumerate(batch.column(1).to_pylist()):
                todo = [("N", None, 0, 0, len(body))]
                while todo:
                    own = todo.pop()
                    row.append(i)
                    for column, value in zip(out, own):
                        column.append(value)
                    name, _, level, a, b = own
                    if b - a > leaf and a < (cut := split(body, a, b)) < b:
                        todo += [(f"{name}.1", name, level + 1, a, cut), (f"{name}.2", name, level + 1, cut, b)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(out, kinds))], names=[key, "node_id", "parent_id", "level", "char_start", "char_end"])

    return docs.where(F.length(text) > 0).select(key, text).mapInArrow(run, f"`{key}` {kind}, node_id string, parent_id string, level bigint, char_start bigint, char_end bigint")
