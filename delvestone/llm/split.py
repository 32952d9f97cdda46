"""Cutting oversized items at natural boundaries, with an overlap.

``rule="structure"`` ends each piece at the last boundary of the strongest kind
in its window (headings, then blank lines, sentence ends, white space).  This
is the result that the data's definition of a case asks for.
``rule="cohesion"`` is lexical-cohesion segmentation: at each sentence end of
the window the words of the block before and of the block after are compared,
the depth of the similarity valley is taken against the peaks on both sides,
and the piece ends at the deepest valley.

Results of the edge cases: null, empty, reversed or outside ranges and null or
empty contents give no item; an item within the limit gives no piece unless
``keep_small``; repeated rows count once; a window without any boundary is cut
at exactly the limit; of equally deep valleys the last is taken; only the
named columns are read, others may have any name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

#: Kinds of boundary, strongest first; a match's end is the boundary.
_HEADING = re.compile(r"(?<=\n)(?=#{1,6} )")
_BLANK = re.compile(r"\n{2,}(?!\n)")
_SENTENCE = re.compile(r"[.!?][ \n]+(?![ \n])|[。！？]")
_SPACE = re.compile(r"[ \n]+(?![ \n])")
KINDS = (_HEADING, _BLANK, _SENTENCE, _SPACE)
_WORD = re.compile(r"[^\W\d_]+")


def _last(kind: re.Pattern, text: str, low: int, high: int, context: int) -> int | None:
    """The last boundary of a kind in (low, high].  Runs may begin before the window."""
    found = None
    at = max(0, low - context)
    while m := kind.search(text, at):
        end = m.end()
        if end > high:
            break
        if end > low:
            found = end
        at = end + 1 if end == m.start() else end
    return found


def structural_end(text: str, low: int, high: int) -> int:
    """The end of a piece by the strongest kind of boundary in (low, high]."""
    for kind in KINDS:
        run = low
        while run > 0 and text[run - 1] in " \n.!?":
            run -= 1
        if (end := _last(kind, text, low, high, low - run)) is not None:
            return end
    return high


def cohesion_end(text: str, low: int, high: int, block: int = 2000) -> int:
    """The end of a piece at the deepest valley of lexical cohesion in (low, high].

    Sentences around the window are bags of words, each word weighted by how
    few of them hold it.  At each sentence end the ``block`` characters before
    and after are compared; the similarities are smoothed by their neighbours.
    """
    gaps = [e for m in _SENTENCE.finditer(text, max(0, low - 1)) if low < (e := m.end()) <= high] if high > low else []
    if len(gaps) < 3:
        return structural_end(text, low, high)
    first, last = max(0, low - block), min(len(text), high + block)
    ends = [e for m in _SENTENCE.finditer(text, first) if first < (e := m.end()) < last] + [last]
    bags = [Counter(_WORD.findall(text[a:b].lower())) for a, b in zip([first, *ends], ends)]
    held = Counter(w for bag in bags for w in bag)
    weight = {w: math.log(len(bags) / n) for w, n in held.items()}
    at = [bisect_left(ends, gap) + 1 for gap in gaps]  # sentences before each gap

    def vector(bag: Counter) -> dict[str, float]:
        return {w: math.sqrt(n) * weight[w] for w, n in bag.items()}

    near = []
    for gap, k in zip(gaps, at):
        left, right = Counter(), Counter()
        i = k
        while i > 0 and gap - (ends[i - 2] if i > 1 else first) <= block:
            i -= 1
            left += bags[i]
        j = k
        while j < len(bags) and ends[j] - gap <= block:
            right += bags[j]
            j += 1
        a, b = vector(left or bags[k - 1]), vector(right or bags[min(k, len(bags) - 1)])
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        near.append(sum(v * b.get(w, 0.0) for w, v in a.items()) / norm if norm else 0.0)
    near = [(near[max(0, i - 1)] + 2 * x + near[min(len(near) - 1, i + 1)]) / 4 for i, x in enumerate(near)]
    best, deepest = high, -1.0
    for i, gap in enumerate(gaps):
        depth = max(near[: i + 1]) + max(near[i:]) - 2 * near[i]  # against the highest peak on either side
        if depth >= deepest:
            best, deepest = gap, depth
    return best


def pieces(text: str, limit: int = 4000, least: int = 2000, overlap: int = 200, rule: str = "structure") -> list[tuple[int, int]]:
    """Offsets [start, end) of the pieces of one text."""
    choose = {"structure": structural_end, "cohesion": cohesion_end}[rule]
    start, out = 0, []
    while len(text) - start > limit:
        end = choose(text, start + least, start + limit)
        out.append((start, end))
        start = end - overlap
    out.append((start, len(text)))
    return out


def oversized_leaves(nodes: DataFrame, contents: DataFrame, limit: int, keep_small: bool = False) -> DataFrame:
    """(file_id, node_id, start, item): the text of each leaf node that is longer than the limit.

    Rows are filtered by their range before contents are joined, and only the
    item's own text goes on, so that what moves is bounded by the items'
    sizes.  A file with a large share of all nodes is left to the adaptive
    skew join: its one content row is repeated, its nodes are split.
    """
    require(nodes, "file_id", "node_id", "parent_id", "char_range")
    require(contents, "file_id", "content")
    begin, end = F.col("char_range")[0], F.col("char_range")[1]
    inner = nodes.select("file_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct()
    long_enough = F.lit(True) if keep_small else F.length("content") > limit
    texts = (
        contents.select("file_id", "content").where(F.col("content").isNotNull() & long_enough)
        .groupBy("file_id").agg(F.max("content").alias("content"))
    )
    wide = end - F.greatest(begin, F.lit(0)) > (0 if keep_small else limit)
    leaves = (
        nodes.where((F.size("char_range") == 2) & wide).select("file_id", "node_id", begin.alias("a"), end.alias("b")).distinct()
        .join(inner, ["file_id", "node_id"], "left_anti")
    )
    size = F.length("content").cast("bigint")
    start, stop = F.least(F.greatest("a", F.lit(0)), size), F.least("b", size)
    return (
        leaves.join(texts, "file_id")
        .select("file_id", "node_id", start.alias("start"), stop.alias("stop"), "content")
        .where(F.col("stop") - F.col("start") > (0 if keep_small else limit))
        .select("file_id", "node_id", "start", F.expr("substring(content, cast(start + 1 as int), cast(stop - start as int))").alias("item"))
    )


def split_items(items: DataFrame, limit: int = 4000, least: int = 2000, overlap: int = 200, rule: str = "structure") -> DataFrame:
    """One row (file_id, node_id, char_start, char_end) for each piece of each item."""
    if not 0 <= overlap < least < limit:
        raise ValueError("0 <= overlap < least < limit must hold, so that each piece moves on")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, nodes, a, b = [], [], [], []
            for file, node, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                for x, y in pieces(text or "", limit, least, overlap, rule):
                    files.append(file), nodes.append(node), a.append(start + x), b.append(start + y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), pa.array(nodes, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                names=["file_id", "node_id", "char_start", "char_end"],
            )

    return items.select("file_id", "node_id", "start", "item").mapInArrow(run, "file_id string, node_id string, char_start bigint, char_end bigint")
