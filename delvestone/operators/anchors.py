"""Where the heads of stated texts stand in a corpus, by a hash of blocks rolled over each text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, BITS = 8, 20
_FACTORS = np.array([pow(0x9E3779B1, i + 1, 1 << 32) for i in range(BLOCK)], np.uint64)


def _codes(chars: np.ndarray) -> np.ndarray:
    """A hash of the ``BLOCK`` characters that start at each character."""
    n = max(0, len(chars) - BLOCK + 1)
    out = np.zeros(n, np.uint64)
    for i, f in enumerate(_FACTORS):
        out += chars[i : i + n] * f
    return (out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def locate(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, anchor: str, sizes: tuple[int, ...] = (80, 50, 30), most: int = 100_000) -> DataFrame:
    """(item, key, at): the start (from 1) of the line where an item's head first stands in a text.

    The head's first 80 characters are looked for, else 50, else 30.  The items
    are a stated set of queries: more than ``most`` of them raise an error.
    Their blocks are found in a text by hash and then compared; texts that hold
    none cost one pass over their characters.  Heads shorter than a block or
    null have no place; a text comes out once for each item that it holds.
    """
    least = min(sizes)
    rows = items.select(item, F.substring(anchor, 1, max(sizes)).alias("head")).where(F.length("head") >= BLOCK).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"anchors: more than {most} items; pass them in several calls")
    heads: dict[str, list] = defaultdict(list)
    for i, head in rows:
        heads[head].append(i)
    shared = docs.sparkSession.sparkContext.broadcast(dict(heads))
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[str]] = defaultdict(list)  # heads by their shortest anchor
        for head in shared.value:
            by[head[:least]].append(head)
        table = np.zeros(1 << BITS, bool)
        first: dict[int, list[str]] = defaultdict(list)
        for short in by:
            code = int(_codes(_chars(short[:BLOCK]))[0])
            table[code] = True
            first[code].append(short)
        for batch in batches:
            row, found, places = [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                if not body:
                    continue
                codes = _codes(_chars(body))
                seen = set()
                for at in np.flatnonzero(table[codes]).tolist():
                    for short in first[int(codes[at])]:
                        if short not in seen and body.startswith(short, at):
                            seen.add(short)
                            for head in by[short]:
                                place = next(p for n in sizes if (p := body.find(head[:n])) >= 0)
                                for one in shared.value[head]:
                                    row.append(i), found.append(one), places.append(body.rfind("\n", 0, place) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(found, batch_kind), batch.column(0).take(pa.array(row, pa.int64())), pa.array(places, pa.int64())], names=[item, key, "at"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_kind = to_arrow_type(items.schema[item].dataType)
    return docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"`{item}` {kinds[1]}, `{key}` {kinds[0]}, at bigint")
