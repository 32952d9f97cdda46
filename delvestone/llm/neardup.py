"""Near-duplicate records: a blocked sparse product of records by n-grams.

A record is the bag of its words; the k-th occurrence of a word is a token of
its own, so that the words two records have in common are the tokens in both.
Each record's tokens are put in one fixed random order (by hash).  Its
n-grams are runs of ``n`` tokens in that order: a reordering of the text leaves
them as they are, and an edited word destroys at most ``n`` of them.

The incidence matrix has a row per class of equal bags and a column per
n-gram; long records keep the n-grams whose hash ends in some zero bits, which
are the same ones in any record of a similar size.  Its product with its own
transpose is accumulated column by column, in blocks; a cell is discarded as
soon as an upper bound of the overlap - from the sizes and from the number of
tokens in each of 64 hash classes - is under the threshold.  What is left,
whatever its count, is compared exactly, token by token.

A column with very many records (found in a sample of the records; the
threshold is a parameter) is cut into blocks, and each pair of blocks is a
task's work of its own, so that no task holds a hot column and no pair of it
is lost.  Up to ``few`` such columns are broadcast; more are joined as a table.

Accuracy: pairs that come out are exact.  A pair is lost only if none of its
kept n-grams survives: at a similarity of 0.8 with edits on both sides some
0.155 of the n-grams are expected to survive, of more similar pairs most.
Records under 64 words keep all n-grams; from there on each is kept with a
probability of 1/2, 1/4, ... by its hash, so that their number varies.  See the
README for the loss by length and the measured recall.

Results of the edge cases: null texts count as empty; records under
``min_words`` words take no part; ids that occur in several identical rows
count once; records of equal bags are near-duplicates of each other; an empty
table gives no rows; columns not named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, require

WORD = re.compile(r"[^\W_]+")
CLASSES = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def tokens(texts: list[str], words: dict) -> tuple[np.ndarray, np.ndarray]:
    """(record number, token hash) of all words of a batch, by record and hash."""
    found = [WORD.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    look = words.__getitem__
    h = np.fromiter((x for ws in found for x in map(look, ws)), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(found)), sizes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    at = np.arange(len(h))
    first = np.ones(len(h), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    t = mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((t, doc))
    return doc[order], t[order]


def bags(df: DataFrame, id_col: str, text: Column, min_words: int) -> DataFrame:
    """(id, bag, n, toks): the class, the size and the ordered tokens (32 bits each) of each record."""
    source = df.select(F.col(id_col).cast("string").alias("id"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            doc, t = tokens(texts, words)
            n = np.bincount(doc, minlength=len(texts))
            ends = np.concatenate([[0], np.cumsum(n)])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(t), dtype=np.uint64)])
            bag = mix(sums[ends[1:]] - sums[ends[:-1]] + n.astype(np.uint64))
            short = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((t >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            keep = pa.array(n >= min_words)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(bag.view(np.int64)), pa.array(n, pa.int32()), short], names=["id", "bag", "n", "toks"])
            yield out.filter(keep)

    return source.mapInArrow(run, "id string, bag bigint, n int, toks array<int>")


def incidence(classes: DataFrame, n: int, keep: int, hot: dict[int, int], block: int) -> DataFrame:
    """(gram, bag, n, kept, side, sketch): the kept n-grams of each class.

    ``hot`` holds the columns to cut and their numbers of blocks: a row of such
    a column goes to each pair of blocks that its own block is part of.
    """
    hot_grams = np.array(sorted(hot), np.int64)
    hot_blocks = np.array([hot[g] for g in sorted(hot)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bag, size, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            t = lists.flatten().to_numpy().view(np.uint32)
            doc = np.repeat(np.arange(len(bag)), size)
            sketch = np.minimum(np.bincount(doc * CLASSES + (t & np.uint32(CLASSES - 1)), minlength=len(bag) * CLASSES), 15).astype(np.uint8).reshape(-1, CLASSES)
            packed = sketch[:, ::2] << 4 | sketch[:, 1::2]
            if len(t) < n:
                continue
            m = len(t) - n + 1
            g = np.zeros(m, np.uint64)
            for i in range(n):
                g = mix(g + t[i : i + m].astype(np.uint64) + np.uint64(i + 1))
            level = np.maximum(0, np.floor(np.log2(size / keep))).astype(np.int64)
            whole = doc[:m] == doc[n - 1 :]
            at = np.flatnonzero(whole & ((g >> np.uint64(40)) & ((np.uint64(1) << level[doc[:m]].astype(np.uint64)) - np.uint64(1)) == 0))
            d, g = doc[at], g[at].view(np.int64)
            kept = np.bincount(d, minlength=len(bag))
            side = np.zeros(len(g), np.int8)
            if len(hot_grams) and len(g):
                k = np.minimum(np.searchsorted(hot_grams, g), len(hot_grams) - 1)
                is_hot = hot_grams[k] == g
                parts = [(d[~is_hot], g[~is_hot], side[~is_hot])]
                for x, y, blocks in zip(d[is_hot], g[is_hot], hot_blocks[k[is_hot]]):
                    own = int(bag[x] % blocks)
                    other = np.arange(blocks)
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    key = mix((low * blocks + high).astype(np.uint64) + np.int64(y).view(np.uint64)).view(np.int64)
                    parts.append((np.full(blocks, x), key, np.where(low == high, 0, np.where(own < other, 1, 2)).astype(np.int8)))
                d, g, side = (np.concatenate(c) for c in zip(*parts))
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CLASSES // 2), len(d), [None, pa.py_buffer(np.ascontiguousarray(packed[d]))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(bag[d]), pa.array(size[d], pa.int32()), pa.array(kept[d], pa.int32()), pa.array(side), rows.cast(pa.binary())],
                names=["gram", "bag", "n", "kept", "side", "sketch"],
            )

    return classes.select("bag", "n", "toks").mapInArrow(run, "gram bigint, bag bigint, n int, kept int, side tinyint, sketch binary")


def hot_columns(classes: DataFrame, n: int, keep: int, block: int, rate: int = 64) -> DataFrame:
    """(gram, blocks): columns with more than some ``block`` records, and how many blocks they are cut into.

    They are looked for in the n-grams of one class in ``rate``; that such a
    column is missed is unlikely and costs only time.
    """
    sample = classes.where(F.pmod("bag", F.lit(rate)) == 0)
    seen = incidence(sample, n, keep, {}, block).groupBy("gram").agg((F.count("*") * rate).alias("size"))
    return seen.where(F.col("size") > block).select("gram", F.ceil(F.col("size") / block).alias("blocks"))


def cut_columns(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """The entries, those of hot columns sent to each pair of blocks that their own block is part of; as ``incidence`` does it, by a join."""
    own, other = F.pmod("bag", "blocks"), F.col("other")
    low, high = F.least("own", other), F.greatest("own", other)
    warm = (
        entries.join(hot, "gram").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .withColumn("side", F.when(F.col("own") == other, 0).when(F.col("own") < other, 1).otherwise(2).cast("tinyint"))
        .withColumn("gram", F.xxhash64("gram", low, high))
    )
    return entries.join(hot, "gram", "left_anti").unionByName(warm.select(*entries.columns))


def _pairs(gram, bag, n, kept, side, sketch, share: float) -> tuple[np.ndarray, ...]:
    """Cells of the product from whole columns whose bounds hold: a, b, count, bound."""
    cut = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    ends = np.append(cut[1:], len(gram))
    more = np.repeat(ends, ends - cut) - np.arange(len(gram)) - 1  # later rows of the same column
    out = []
    step = 400_000
    total = np.concatenate([[0], np.cumsum(more)])
    low = 0
    while low < len(gram):
        high = max(low + 1, int(np.searchsorted(total, total[low] + step, "right")) - 1)
        c = more[low:high]
        i = np.repeat(np.arange(low, high), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        ok = (side[i] == 0) | (side[i] != side[j])
        need = share * np.maximum(n[i], n[j])
        ok &= (np.minimum(n[i], n[j]) >= need - 1e-9) & (bag[i] != bag[j])
        i, j, need = i[ok], j[ok], need[ok]
        if len(i):
            common = np.minimum(sketch[i], sketch[j]).sum(1, dtype=np.int32)
            # a class counted up to 15 may hold more; such records are kept
            full = (sketch[i] == 15).any(1) & (sketch[j] == 15).any(1)
            ok = (common >= need - 1e-9) | full
            i, j = i[ok], j[ok]
            swap = bag[i] > bag[j]
            a, b = np.where(swap, bag[j], bag[i]), np.where(swap, bag[i], bag[j])
            out.append((a, b, np.minimum(kept[i], kept[j])))
        low = high
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    a, b, least = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.diff(np.append(first, len(a))), least[first]


def product(entries: DataFrame, share: float) -> DataFrame:
    """(a, b, shared, kept): cells of the blocked product, added up over the blocks."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def columns(batch):
            c = [batch.column(k).to_numpy() for k in range(5)]
            raw = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, CLASSES // 2)
            wide = np.empty((len(raw), CLASSES), np.uint8)
            wide[:, ::2], wide[:, 1::2] = raw >> 4, raw & 15
            return [*c, wide]

        def cells(c):
            a, b, count, kept = _pairs(*c, share)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(count, pa.int32()), pa.array(kept, pa.int32())], names=["a", "b", "shared", "kept"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = columns(batch)
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            whole = int(np.searchsorted(rest[0], rest[0][-1]))
            if whole >= 30_000:
                yield cells([x[:whole] for x in rest])
                rest = [x[whole:] for x in rest]
        if rest is not None:
            yield cells(rest)

    return (
        entries.repartition(parts, "gram").sortWithinPartitions("gram")
        .mapInArrow(run, "a bigint, b bigint, shared int, kept int")
        .groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("kept").alias("kept"))
    )


def near_duplicates(records: DataFrame, share: float = 0.8, n: int = 5, keep: int = 32, block: int = 2000, few: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal bags, and the members of the classes.

    ``records`` is the result of :func:`bags`.  The first result has (a, b)
    for each two classes with at least ``share`` of the larger one's words in
    common; the second (id, bag), each id once.
    """
    require(records, "id", "bag", "n", "toks")
    classes = records.select("bag", "n", "toks").dropDuplicates(["bag"])  # copies collapse before anything else, map side first
    hot = hot_columns(classes, n, keep, block)
    rows = hot.limit(few + 1).collect()
    if len(rows) <= few:  # broadcast with the function
        entries = incidence(classes, n, keep, {r["gram"]: r["blocks"] for r in rows}, block)
    else:
        entries = cut_columns(incidence(classes, n, keep, {}, block), materialise(hot))
    cells = product(entries, share)
    near = cells.select("a", "b")
    left = classes.select(F.col("bag").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = classes.select(F.col("bag").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    links = (
        near.join(left, "a").join(right, "b")
        .where(common >= F.greatest("na", "nb") * F.lit(share) - 1e-9)
        .select("a", "b")
    )
    return links, records.select("id", "bag").distinct()
