"""Evaluation texts that occur in a corpus, by Wu-Manber search.

Each test text is cut into all its runs of ``run`` words, which are the search
strings.  Those of similar lengths are searched at once: a table of blocks of
bytes says how far from a block the nearest possible end of a string is, and
the search jumps so far ahead; where it is zero a hash of the bytes before
chooses a bucket of strings, and direct comparison confirms.  A passage with up
to one changed, dropped or added word in eight always holds such a run.

Of each document and test text the runs found are chained into passages, the
words between two runs being compared word by word, and the passages'
shares of the test text decide.  Case, punctuation, markup, white space,
compatibility forms and invisible signs don't count.

Every document is read and cut into words once, with no shuffle.  The test
texts are a stated set of queries: their tables are made in blocks of
``per_block`` items and broadcast packed (more than ``most`` bytes of them are
an error), and a task searches its documents for one block after the other.

Results of the edge cases: null, empty and wordless texts match nothing; a test
text of fewer than ``run`` words is searched as it is, one of under six letters
is no passage and matches nothing; items with the same text
all come out; a document comes out once for each item, however often it holds
it; repeated rows count once; only the named columns are read.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, require

_WORD = re.compile(r"[^\W_]+")
_UNSEEN = re.compile("[­​-‏⁠﻿]")


def words_of(text: str) -> list[str]:
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


BLOCK, BITS = 8, 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each byte, as a number (a view, nothing is computed)."""
    return np.ndarray((max(0, len(data) - BLOCK + 1),), "<u8", data.tobytes(), strides=(1,))


def _code(numbers: np.ndarray) -> np.ndarray:
    return (numbers * _MIX >> np.uint64(64 - BITS)).astype(np.uint32)


@dataclass
class Needles:
    """Search strings of similar lengths, with their shift table and buckets."""

    strings: list[bytes]

    def __post_init__(self) -> None:
        self.least = m = min(map(len, self.strings))
        self.shift = np.full(1 << BITS, min(255, m - BLOCK + 1), np.uint8)
        heads = np.frombuffer(b"".join(s[:m] for s in self.strings), np.uint8)
        whole, first = blocks(heads), np.arange(len(self.strings)) * m
        for end in range(BLOCK, m + 1):
            np.minimum.at(self.shift, _code(whole[first + end - BLOCK]), min(255, m - end))
        keys = self._keys(heads, first)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[keys >> np.uint64(42)] = True
        self.ranked = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranked]
        self.asked = 0  # positions looked at

    def _keys(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        key = np.zeros(len(starts), np.uint64)
        for i in range(self.least):
            key = (key ^ data[starts + i]) * np.uint64(0x9FB21C651E98DF25)
        return key

    def ends(self, whole: np.ndarray, lane: int = 512) -> np.ndarray:
        """Places of blocks that may end a string's head, found by jumping from block to block.

        The text is walked in lanes of ``lane`` bytes, all of them at once: in
        each, the shift of the block at hand says how far to jump.
        """
        at = np.arange(self.least - BLOCK, len(whole), lane)
        stop = np.minimum(at + lane, len(whole))
        found = []
        while len(at):
            self.asked += len(at)
            jump = self.shift[_code(whole[at])]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def find(self, text: bytes, data: np.ndarray, whole: np.ndarray) -> tuple[list[int], list[int]]:
        """Starts of all occurrences, and the numbers of their strings."""
        starts = self.ends(whole) + BLOCK - self.least
        key = self._keys(data, starts)
        maybe = self.seen[key >> np.uint64(42)]
        starts, key = starts[maybe], key[maybe]
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        places, numbers = [], []
        hit = np.flatnonzero(high > low)
        strings, ranked = self.strings, self.ranked
        for start, a, b in zip(starts[hit].tolist(), low[hit].tolist(), high[hit].tolist()):
            for j in ranked[a:b].tolist():
                if text.startswith(strings[j], start):
                    places.append(start)
                    numbers.append(j)
        return places, numbers


def _distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def passages(doc: list[str], ref: list[str], seeds: list[tuple[int, int]], run: int, every: int = 8, gap: int = 12) -> list[tuple[int, int, int, int]]:
    """Passages (ref from, ref to, doc from, doc to) chained from seeds (doc, ref)."""
    runs: list[list[int]] = []
    open_at: dict[int, list[int]] = {}
    for d, r in sorted(set(seeds)):
        own = open_at.get(d - r)
        if own and d <= own[3]:
            own[1], own[3] = r + run, d + run
        else:
            own = open_at[d - r] = [r, r + run, d, d + run]
            runs.append(own)
    runs.sort(key=lambda x: (x[2], x[0]))
    out: list[tuple[list[int], int]] = []  # passage, its edits
    for own in runs:
        best = None
        for i, (p, edits) in enumerate(out):
            dr, dd = own[0] - p[1], own[2] - p[3]
            if own[1] <= p[1] or own[3] <= p[3] or dr > gap or dd > gap or min(dr, dd) < -run:
                continue
            cut = max(0, -dr, -dd)  # two runs may overlap where a word was added or dropped
            more = _distance(ref[p[1] : own[0] + cut], doc[p[3] : own[2] + cut])
            if every * (edits + more) <= own[1] - p[0] + every - 1 and (best is None or p[1] - p[0] > best[1]):
                best = (i, p[1] - p[0], edits + more)
        if best is not None:
            p = out[best[0]][0]
            out.append(([p[0], own[1], p[2], own[3]], best[2]))
        else:
            out.append((list(own), 0))
    return [tuple(p) for p, _ in out]


def _grow(p: tuple[int, int, int, int], doc: list[str], ref: list[str], every: int = 8) -> tuple[int, int, int, int]:
    """The passage with its edges carried over further edits, one in ``every`` words at most.

    Beyond a changed, added or dropped word two words must agree, or one if
    the test text or the document ends there.
    """
    r0, r1, d0, d1 = p
    while r0 > 0 and d0 > 0:
        if ref[r0 - 1] == doc[d0 - 1]:
            r0, d0 = r0 - 1, d0 - 1
            continue
        for a, b in ((1, 1), (0, 1), (1, 0)):
            n = min(2, r0 - a, d0 - b)
            if n > 0 and ref[r0 - a - n : r0 - a] == doc[d0 - b - n : d0 - b]:
                break
        else:
            break
        e = 1
        while e < every and r0 - a - e > 0 and d0 - b - e > 0 and ref[r0 - a - e - 1] == doc[d0 - b - e - 1]:
            e += 1
        r0, d0 = r0 - a - e, d0 - b - e
        if e < every - 2:  # the next edit would be too near
            break
    while r1 < len(ref) and d1 < len(doc):
        if ref[r1] == doc[d1]:
            r1, d1 = r1 + 1, d1 + 1
            continue
        for a, b in ((1, 1), (0, 1), (1, 0)):
            n = min(2, len(ref) - r1 - a, len(doc) - d1 - b)
            if n > 0 and ref[r1 + a : r1 + a + n] == doc[d1 + b : d1 + b + n]:
                break
        else:
            break
        e = 1
        while e < every and r1 + a + e < len(ref) and d1 + b + e < len(doc) and ref[r1 + a + e] == doc[d1 + b + e]:
            e += 1
        r1, d1 = r1 + a + e, d1 + b + e
        if e < every - 2:
            break
    return r0, r1, d0, d1


def coverage(doc: list[str], ref: list[str], seeds: list[tuple[int, int]], run: int, parts: int, least: int = 8) -> float:
    """The share of the test text in its longest one (or two, in their order) passages."""
    own = sorted({_grow(p, doc, ref) for p in passages(doc, ref, seeds, run)})
    own = [p for p in own if p[1] - p[0] >= min(least, len(ref))]
    best = max((p[1] - p[0] for p in own), default=0)
    if parts > 1:
        for i, (a, b, _, end) in enumerate(own):
            for c, d, begin, _ in own[i + 1 :]:
                if d > b and begin >= end - 2:
                    best = max(best, d - a if c < b else b - a + d - c)
    return best / len(ref) if ref else 0.0


class Texts:
    """Documents in the form in which they are searched."""

    def __init__(self, texts: list[str | None]) -> None:
        self.docs = [words_of(t) if t else [] for t in texts]
        self.text = b"\n".join(f" {' '.join(d)} ".encode("utf-8", "surrogatepass") for d in self.docs)
        self.data = np.frombuffer(self.text, np.uint8)
        self.whole = blocks(self.data)

    @cached_property
    def breaks(self) -> np.ndarray:
        return np.flatnonzero(self.data == 10)

    @cached_property
    def spaces(self) -> np.ndarray:
        return np.flatnonzero(self.data == 32)


@dataclass
class TestTexts:
    """Texts to look for: their words, in how many passages and how much must occur."""

    refs: list[list[str]]
    items: list[list[int]]
    parts: list[int]
    need: list[float]
    run: int = 4

    def __post_init__(self) -> None:
        where: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, ref in enumerate(self.refs):
            for i in range(max(1, len(ref) - self.run + 1)):
                where[f" {' '.join(ref[i : i + self.run])} ".encode("utf-8", "surrogatepass")].append((k, i))
        strings = sorted((s for s in where if len(s) >= BLOCK), key=len)
        sizes = [len(where[s]) for s in strings]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.ref_of, self.at_of = np.array([x for s in strings for x in where[s]], np.int64).reshape(-1, 2).T
        self.sizes = np.array([len(r) for r in self.refs])
        # the shorter the shortest string, the smaller all shifts: each class of lengths has tables of its own
        ends = [0, *(sum(len(s) < n for s in strings) for n in (14, 20, 28)), len(strings)]
        self.needles = [(a, Needles(strings[a:b])) for a, b in zip(ends, ends[1:]) if a < b]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(text, item, share) for all items that leaked into the texts."""
        return self.among(Texts(texts))

    def among(self, own: Texts) -> list[tuple[int, int, float]]:
        docs, text, data, places, numbers = own.docs, own.text, own.data, [], []
        for first, needles in self.needles:
            p, n = needles.find(text, data, own.whole)
            places += p
            numbers += [first + x for x in n]
        if not places:
            return []
        breaks, spaces = own.breaks, own.spaces
        places, numbers = np.array(places), np.array(numbers)
        doc = np.searchsorted(breaks, places)
        word = np.searchsorted(spaces, places) - np.searchsorted(spaces, np.concatenate([[0], breaks + 1])[doc])
        times = self.starts[numbers + 1] - self.starts[numbers]
        entry = np.repeat(self.starts[numbers], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        ref, at = self.ref_of[entry], self.at_of[entry]
        pair, word = np.repeat(doc, times) * len(self.refs) + ref, np.repeat(word, times)
        order = np.argsort(pair, kind="stable")
        pair, word, at = pair[order], word[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        out = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(pair)]):
            d, k = divmod(int(pair[a]), len(self.refs))
            ref, need = self.refs[k], self.need[k]
            size = min(self.run, len(ref))
            # of a passage with one edit in eight more than half lies in unbroken runs
            least = need / 2 * len(ref) - 1
            if (b - a) * size < least or len({i + j for i in set(at[a:b].tolist()) for j in range(size)}) < least:
                continue
            share = coverage(docs[d], ref, list(zip(word[a:b].tolist(), at[a:b].tolist())), size, self.parts[k])
            if share >= need:
                out += [(d, item, share) for item in self.items[k]]
        return out


def test_texts(rows: list, evidence_share: float, question_share: float, run: int) -> TestTexts:
    by: dict[tuple, list[int]] = defaultdict(list)
    for r in rows:
        if ref := words_of(r["evidence_text"] or ""):
            by[tuple(ref), 2, evidence_share].append(r["item_id"])
        if ref := words_of(r["question"] or ""):
            by[tuple(ref), 1, question_share].append(r["item_id"])
    keys = list(by)
    return TestTexts([list(k[0]) for k in keys], [sorted(set(by[k])) for k in keys], [k[1] for k in keys], [k[2] for k in keys], run)


class Blocks:
    """Test texts in blocks, packed; one block at a time is open."""

    def __init__(self, blocks: list[TestTexts]) -> None:
        self.packed = [zlib.compress(pickle.dumps(b), 1) for b in blocks]
        self.open_one: tuple[int, TestTexts] | None = None

    def __iter__(self) -> Iterator[TestTexts]:
        for i, packed in enumerate(self.packed):
            if self.open_one is None or self.open_one[0] != i:
                self.open_one = i, pickle.loads(zlib.decompress(packed))
            yield self.open_one[1]

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "open_one": None}


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    evidence_share: float = 0.5, question_share: float = 0.8, run: int = 4, per_block: int = 5000, most: int = 256 << 20,
) -> DataFrame:
    """(id, item_id, share) of every document and item of which a passage leaked."""
    require(docs, id_col, text_col)
    require(items, "item_id", "question", "evidence_text")
    spark = docs.sparkSession
    wanted = items.select("item_id", "question", "evidence_text").where("item_id is not null").distinct()
    parts = max(1, -(-wanted.count() // per_block))
    kind = docs.schema[id_col].dataType.simpleString()
    made = []
    for part in range(parts):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        made.append(test_texts(bounded(rows, 4 * per_block, "test items of a block"), evidence_share, question_share, run))
    own = Blocks([b for b in made if b.needles])
    if (size := sum(map(len, own.packed))) > most:
        raise ValueError(f"test items: {size} bytes of tables to broadcast, more than {most}; pass the items in several calls")
    shared = spark.sparkContext.broadcast(own)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        step = 1000 if len(tests.packed) < 2 else 10_000  # many blocks are opened for many documents
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                texts = Texts(batch.column(1).to_pylist())
                hits = [h for block in tests for h in block.among(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64())],
                    names=[id_col, "item_id", "share"],
                )

    found = docs.select(id_col, text_col).mapInArrow(search, f"`{id_col}` {kind}, item_id bigint, share double")
    return found.groupBy(id_col, "item_id").agg(F.max("share").alias("share"))
