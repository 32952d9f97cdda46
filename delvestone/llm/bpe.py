"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern; each word's UTF-8 bytes
are merged pair by pair, always the pair of lowest rank and, of several, the
leftmost.  The merge keeps a contiguous array of part boundaries and one of
the ranks of adjacent parts, scans for the minimum, deletes a boundary and
refreshes the two neighbouring ranks.  Very long words (runs of one sign, text
without spaces) use a heap over linked parts, which gives the same ids in
n log n.

Results of the edge cases: a null and an empty text both give an empty list;
strings that look like special tokens are ordinary text; rows are kept as they
are, repeated ids included; columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

#: Fixed value: the word pattern of the vocabulary byte_bpe_50k.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same pattern with explicit classes, for texts of Western European
#: letters, digits and common signs only; the plain engine is some times faster.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", " \t\n\r"
_OTHER = "¡¢£§©«°±·»¿×÷–—‘’“”•…€"
_WESTERN = re.compile(rf"[^{_L}{_N}{_S}!-/:-@\[-`{{-~{_OTHER}]")
_FAST = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

LONG = 400
_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a .tiktoken file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by the contiguous rank array."""
    get = ranks.get
    bounds = list(range(len(word) + 1))
    near = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == _NONE:
            break
        at = near.index(least)
        del bounds[at + 1], near[at]
        if at < len(near):
            near[at] = get(word[bounds[at] : bounds[at + 2]], _NONE)
        if at:
            near[at - 1] = get(word[bounds[at - 1] : bounds[at + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges in the same order, from a heap."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1" * n)

    def pair(i: int) -> int:
        j = after[i]
        return ranks.get(word[i : after[j]], _NONE) if j < n else _NONE

    heap = [(r, i) for i in range(n - 1) if (r := pair(i)) != _NONE]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if not alive[i] or pair(i) != rank:
            continue
        j = after[i]
        alive[j] = 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (r := pair(k)) != _NONE:
                heapq.heappush(heap, (r, k))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Words to ids.  Words seen before are kept, up to ``keep`` of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, keep: int = 400_000):
        super().__init__()
        self.ranks, self.keep = ranks, keep
        self.slow = regex.compile(pattern)
        self.fast = _FAST if pattern == PATTERN else None

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8")
        if (rank := self.ranks.get(raw)) is not None:
            ids: tuple[int, ...] = (rank,)
        else:
            ids = tuple((merge_short if len(raw) <= LONG else merge_long)(raw, self.ranks))
        if len(raw) <= 64:
            if len(self) >= self.keep:
                self.clear()
            self[word] = ids
        return ids

    def words(self, text: str) -> list[str]:
        if self.fast is not None and not _WESTERN.search(text):
            return self.fast.findall(text)
        return self.slow.findall(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.words(text)))) if text else []


def encode_texts(df: DataFrame, id_col: str, text_col: str, ranks: dict[bytes, int], out: str = "ids") -> DataFrame:
    """``id_col`` and the list of token ids of ``text_col``, one row for each row.

    No shuffle; the vocabulary (50,256 entries, under 1 MB) is the only broadcast.
    """
    require(df, id_col, text_col)
    if len(ranks) > 400_000:
        raise ValueError("a vocabulary of more than 400,000 entries is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    source = df.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        look = encoder.__getitem__
        for batch in batches:
            ends, parts = [0], []
            for text in batch.column(1).to_pylist():
                if text:
                    ids = np.fromiter(chain.from_iterable(map(look, encoder.words(text))), dtype=np.int32)
                    parts.append(ids)
                    ends.append(ends[-1] + len(ids))
                else:
                    ends.append(ends[-1])
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, out])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, `{out}` array<int>")
