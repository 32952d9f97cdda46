"""The most similar vectors of every vector, by additive quantisation.

A vector is written as a sum of codewords, one of each of several codebooks of
full dimension; each codebook is learnt on what the ones before left over, and
a vector's codewords are chosen together by a beam search.  The first codebook
(the first two, when it would have over 4,096 words) also names a cell; its
size follows the number of vectors, so that a cell holds some ``per_cell`` of
them however many there are.

Every vector is stored in the cell of its own code, with its codes and the
norm of their sum, and asks in the cells nearest to it: ``probes`` of them, or
as many as it takes to meet a share ``recall`` of the true neighbours of some
200 vectors, which are compared with all others beforehand.  In a cell,
tables of inner products between the asking vectors and all codewords score
the stored codes; the ``shortlist`` best are compared exactly by cosine.

Skew: vectors that are equal bit by bit are collapsed to the ``k + 1`` smallest
ids before anything moves, since no other copy can be among anyone's k most
similar; a cell of more than ``2 * part`` stored vectors, or of more than
``4 * part`` askers, by a count of one vector in sixteen, is cut: both are
divided into parts, and each pair of a part of the one and a part of the other
is a group of its own.

The codebooks are fitted on a bounded sample (``train`` vectors, or 8 for each
cell of the first codebook, at most 2 * 32,768); every vector
is stored and asks.  What goes to the driver is that sample, what is broadcast
are the codebooks; both sizes are fixed.

Results of the edge cases: null vectors, null models, vectors of another
length, with infinite or undefined values or all zero take no part; each id
counts once; equal cosines are ordered by id; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialise, require


def _assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)])


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = _assign(x, c)
        order = np.argsort(a, kind="stable")
        own, first = np.unique(a[order], return_index=True)
        c[own] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
        if len(own) < len(c):  # an unused codeword moves to a random vector
            free = np.setdiff1d(np.arange(len(c)), own)
            c[free] = x[rng.choice(len(x), len(free))]
    return c


@dataclass
class Codebooks:
    words: np.ndarray  # all codewords, one below the other
    starts: np.ndarray  # where each codebook starts

    def __post_init__(self) -> None:
        self.gram = self.words @ self.words.T
        self.sizes = np.diff(np.append(self.starts, len(self.words)))

    @classmethod
    def fit(cls, x: np.ndarray, sizes: list[int], rounds: int = 8, seed: int = 7) -> Codebooks:
        rng, rest, books = np.random.default_rng(seed), x.astype(np.float32), []
        for size in sizes:
            book = k_means(rest, size, rounds, rng)
            books.append(book)
            rest = rest - book[_assign(rest, book)]
        return cls(np.concatenate(books), np.concatenate([[0], np.cumsum([len(b) for b in books])[:-1]]))

    def beam(self, inner: np.ndarray, width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, beams, depth), best first, and their costs, from the inner products with all codewords."""
        n = len(inner)
        codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for m in range(depth):
            a, k = self.starts[m], self.sizes[m]
            own = np.diagonal(self.gram)[a : a + k] - 2 * inner[:, a : a + k]
            new = cost[:, :, None] + own[:, None, :]
            for j in range(m):
                new += 2 * self.gram[codes[:, :, j], a : a + k]
            flat = new.reshape(n, -1)
            w = min(width, flat.shape[1])
            best = np.argpartition(flat, w - 1, axis=1)[:, :w] if w < flat.shape[1] else np.tile(np.arange(w), (n, 1))
            value = np.take_along_axis(flat, best, 1)
            order = np.argsort(value, axis=1, kind="stable")
            best, cost = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k + a)[:, :, None]], axis=2)
        return codes, cost

    @staticmethod
    def cells(codes: np.ndarray, level: int | None = None) -> np.ndarray:
        """The cell that the first one or two codewords name."""
        one, two = codes[..., 0], codes[..., 1] if (level or codes.shape[-1]) > 1 else 0
        return one << 32 | two

    def norms(self, codes: np.ndarray) -> np.ndarray:
        """Squared norm of the sum of each row's codewords."""
        return sum(self.gram[codes[:, i], codes[:, j]] for i in range(codes.shape[1]) for j in range(codes.shape[1])).astype(np.float32)


def _unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)  # no overflow, no loss of very small vectors
    return (wide / np.sqrt((wide * wide).sum(1, keepdims=True))).astype(np.float32)


def _pack(raw: np.ndarray) -> list[bytes]:
    """Without loss: two bytes a value where they hold it exactly, else four."""
    with np.errstate(over="ignore"):
        half = raw.astype(np.float16)
    ok = (half.astype(np.float32) == raw).all(1)
    return [h.tobytes() if o else r.tobytes() for h, r, o in zip(half, raw, ok)]


def _unpack(rows: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.float16 if len(r) == 2 * dim else np.float32).astype(np.float32) for r in rows])


def usable(df: DataFrame, id_col: str, vector_col: str, model_col: str, dim: int) -> DataFrame:
    """(id, model, v) of the vectors that can be compared."""
    require(df, id_col, vector_col, model_col)
    v = F.col(vector_col)
    # one pass per row: an infinite or undefined value makes the sum of v * 0 undefined
    finite = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * F.lit(0.0)) == 0.0
    return (
        df.where(F.col(id_col).isNotNull() & F.col(model_col).isNotNull() & (F.size(v) == dim))
        .where(finite & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0))
        .select(F.col(id_col).cast("string").alias("id"), F.col(model_col).cast("string").alias("model"), v.cast("array<float>").alias("v"))
    )


def _copies(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Ids beyond the first k + 1 of their equal vectors, and the pairs with the first k that they have."""
    keyed = vectors.select("model", F.xxhash64("v").alias("h"), "id")
    many = keyed.groupBy("model", "h").agg(F.count("*").alias("c")).where(F.col("c") > k + 1).select("model", "h")
    own = keyed.join(many, ["model", "h"]).distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    part, whole = Window.partitionBy("model", "h", "salt").orderBy("id"), Window.partitionBy("model", "h").orderBy("id")
    first = (
        own.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
        .withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1).select("model", "h", "id", "r")
    )
    extra = own.join(first.select("model", "h", "id"), ["model", "h", "id"], "left_anti").select("model", "h", "id")
    pairs = extra.join(first.where(F.col("r") <= k).select("model", "h", F.col("id").alias("other")), ["model", "h"])
    return extra.select("id"), pairs.select("id", "other", F.lit(1.0).alias("cos"))


def most_similar(
    df: DataFrame, id_col: str, vector_col: str, model_col: str, dim: int, k: int = 5, min_cos: float = -1.0,
    per_cell: int = 300, probes: int = 3, shortlist: int = 64,
    books: int = 6, size: int = 64, width: int = 8, train: int = 12_000, part: int = 4096, recall: float = 0.95,
) -> DataFrame:
    """(id, other, cos): for each id the k most similar others of its model, of at least ``min_cos``."""
    spark = df.sparkSession
    vectors = usable(df, id_col, vector_col, model_col, dim)
    n = vectors.count()
    schema = "id string, other string, cos double"
    if n == 0:
        return spark.createDataFrame([], schema)
    extra, copied = _copies(vectors, k)
    extra = materialise(extra)  # empty, but where many vectors are equal
    spare = extra.count()
    if spare == 0:
        stored = vectors
    else:
        stored = vectors.join(F.broadcast(extra) if spare <= 200_000 else extra, "id", "left_anti")

    first = min(4096, max(1, round(n / per_cell)))
    second = max(1, round(n / per_cell / first))
    coarse = [first] if second == 1 else [first, second]
    level, train = len(coarse), max(train, 8 * first)
    rate = max(1, n // train)
    rows = vectors.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(rate)) == 0).select("model", "v").limit(2 * train).toArrow()
    bounded(range(rows.num_rows), 2 * train, "training vectors")
    if rows.num_rows == 0:
        rows = vectors.select("model", "v").limit(train).toArrow()
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sample = _unit(np.asarray(flat, np.float32).reshape(-1, dim))
    fitted = Codebooks.fit(sample, coarse + [size] * books)

    depth = level + books
    probes = enough_probes(stored, fitted, dim, n, k, min_cos, width, level, depth, probes, recall)
    parts = hot_cells(stored, spark.sparkContext.broadcast(fitted), dim, width, level, depth, probes, part)
    shared = spark.sparkContext.broadcast((fitted, parts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, cut = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                ids, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                raw = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
                inner = _unit(raw) @ f.words.T
                near = f.cells(f.beam(inner, max(width, probes), level)[0][:, :probes], level)
                code = f.beam(inner, width, depth)[0][:, 0]
                homes, norm, packed = f.cells(code, level), f.norms(code), _pack(raw)
                out: list[list] = [[] for _ in range(8)]
                for i, (x, name) in enumerate(zip(ids, names)):
                    home = int(homes[i])
                    asked = [home, *(c for c in near[i].tolist() if c != home)][: max(probes, 1)]
                    for cell in asked:
                        for group, asks, is_home in places(hash_id(x), *cut.get((name, cell), (1, 1)), cell == home):
                            for column, value in zip(out, (name, cell, group, x, packed[i], code[i].astype(np.int32).tobytes() if is_home else None, float(norm[i]), asks)):
                                column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float32(), pa.bool_()))],
                    names=["model", "cell", "part", "id", "raw", "code", "norm", "asks"],
                )

    def score(group: pa.Table) -> pa.Table:
        f, _ = shared.value
        ids = np.asarray(group.column("id").to_pylist(), dtype=object)
        _, one = np.unique(ids, return_index=True)  # repeated rows of an id are alike
        codes = group.column("code").to_pylist()
        ids, codes = ids[one], [codes[i] for i in one]
        raw = group.column("raw").to_pylist()
        x = _unit(_unpack([raw[i] for i in one], dim))
        norm = group.column("norm").to_numpy()[one]
        kept = np.array([i for i, c in enumerate(codes) if c is not None], np.int64)
        asking = np.flatnonzero(np.asarray(group.column("asks").to_pylist(), bool)[one])
        out: list[list] = [[], [], []]
        if len(kept):
            code = np.stack([np.frombuffer(codes[i], np.int32) for i in kept])
            for at in range(0, len(asking), 512):
                ask = asking[at : at + 512]
                tables = x[ask] @ f.words.T
                dot = tables[:, code[:, 0]]
                for m in range(1, depth):
                    dot += tables[:, code[:, m]]
                near = 2 * dot - norm[kept]  # minus the squared distance, but for a constant of the asker
                near[kept[None, :] == ask[:, None]] = -np.inf
                if shortlist < len(kept):
                    best = np.argpartition(-near, shortlist - 1, axis=1)[:, :shortlist]
                else:
                    best = np.tile(np.arange(len(kept)), (len(ask), 1))
                row, col = np.nonzero(np.take_along_axis(near, best, 1) > -np.inf)
                a, b = ask[row], kept[best[row, col]]
                cos = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 8192]], x[b[i : i + 8192]], dtype=np.float64) for i in range(0, len(a), 8192)]) if len(a) else np.zeros(0)
                ok = cos >= min_cos
                a, b, cos = a[ok], b[ok], cos[ok]
                order = np.lexsort((b, -cos, a))  # positions follow ids, so equal cosines are by id
                a, b, cos = a[order], b[order], cos[order]
                start = np.searchsorted(a, a)
                take = np.arange(len(a)) - start < k
                out[0] += ids[a[take]].tolist()
                out[1] += ids[b[take]].tolist()
                out[2] += cos[take].tolist()
        return pa.table({"id": pa.array(out[0], pa.string()), "other": pa.array(out[1], pa.string()), "cos": pa.array(out[2], pa.float64())})

    found = (
        stored.mapInArrow(encode, "model string, cell bigint, part bigint, id string, raw binary, code binary, norm float, asks boolean")
        .groupBy("model", "cell", "part").applyInArrow(score, schema)
    )
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("cos").desc(), "other"))
    best = found.withColumn("r", rank).where(F.col("r") <= k).drop("r")
    return best.union(copied)


def hash_id(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass"))


def places(h: int, askers: int, parts: int, home: bool) -> Iterator[tuple[int, bool, bool]]:
    """(group, whether it asks there, whether it is stored there) of a vector of hash ``h`` in a cell of so many parts of askers and of stored vectors.

    There is a group for each pair of a part of the one and a part of the other.
    """
    ask, own = h % askers, h % parts
    for part in range(parts):
        yield ask * parts + part, True, home and part == own
    if home:
        for other in range(askers):
            if other != ask:
                yield other * parts + own, False, True


def enough_probes(
    stored: DataFrame, f: Codebooks, dim: int, n: int, k: int, min_cos: float, width: int, level: int, depth: int, least: int, recall: float, ask: int = 200, most: int = 4096,
) -> int:
    """In how many cells a vector must ask so that a share ``recall`` of the true pairs is met, ``least`` at least.

    Some ``ask`` vectors are compared with all others, exactly; of their
    nearest ones it is noted at which place of the asker's cells they lie.
    """
    rate = max(1, n // ask)
    rows = stored.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(rate)) == 0).select("id", "model", "v").limit(4 * ask).collect()
    if not rows:
        return least
    q = _unit(np.asarray([r["v"] for r in rows], np.float32))
    inner = q @ f.words.T
    near = f.cells(f.beam(inner, min(most, int(np.prod(f.sizes[:level]))), level)[0], level)
    homes = f.cells(f.beam(inner, width, depth)[0][:, 0], level)
    places = []
    for home, cells in zip(homes.tolist(), near.tolist()):
        own = {c: i for i, c in enumerate([home, *(c for c in cells if c != home)])}
        places.append(own)
    shared = stored.sparkSession.sparkContext.broadcast((f, q, [r["id"] for r in rows], [r["model"] for r in rows], places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, q, ids, models, places = shared.value
        names, number = np.asarray(models, dtype=object), {x: i for i, x in enumerate(ids)}
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                x = _unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim))
                cos = q @ x.T
                cos[names[:, None] != np.asarray(batch.column(1).to_pylist(), dtype=object)[None, :]] = -2
                for j, i in enumerate(batch.column(0).to_pylist()):
                    if i in number:
                        cos[number[i], j] = -2
                top = np.argpartition(-cos, min(k, len(x)) - 1, axis=1)[:, :k]
                asker, col = np.nonzero(np.take_along_axis(cos, top, 1) >= max(min_cos, -1.0))
                other = top[asker, col]
                kept, back = np.unique(other, return_inverse=True)
                home = f.cells(f.beam(x[kept] @ f.words.T, width, depth)[0][:, 0], level) if len(kept) else np.zeros(0, np.int64)
                place = [places[a].get(int(home[b]), most) for a, b in zip(asker.tolist(), back.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(asker, pa.int32()), pa.array(cos[asker, other], pa.float64()), pa.array(place, pa.int32())], names=["asker", "cos", "place"])

    pairs = stored.select("id", "model", "v").mapInArrow(run, "asker int, cos double, place int")
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("cos"), "place"))).where(F.col("r") <= k)
    found = sorted(r[0] for r in best.select("place").collect())  # k rows for each asker
    if not found:
        return least
    return max(least, min(most, found[min(len(found) - 1, max(0, int(np.ceil(recall * len(found))) - 1))] + 1))


def hot_cells(
    stored: DataFrame, shared, dim: int, width: int, level: int, depth: int, probes: int, part: int, rate: int = 16, most: int = 1_000_000,
) -> dict[tuple[str, int], tuple[int, int]]:
    """In how many parts the askers, and the stored vectors, of each cell with very many of either are cut.

    A cell near the middle of all vectors may be asked by most of them.  Cells
    are counted on one vector in ``rate``, whatever their number, so that a
    cell to be cut is seen some ``2 * part / rate`` times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
                inner = _unit(raw) @ f.words.T
                homes = f.cells(f.beam(inner, width, depth)[0][:, 0], level)
                near = f.cells(f.beam(inner, max(width, probes), level)[0][:, :probes], level)
                row, col = np.nonzero(near != homes[:, None])
                row = np.concatenate([np.arange(len(homes)), row])
                cells = np.concatenate([homes, near[near != homes[:, None]]])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(cells), pa.array(np.arange(len(cells)) < len(homes))], names=["model", "cell", "home"])

    seen = stored.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(rate)) == 0).select("model", "v").mapInArrow(run, "model string, cell bigint, home boolean")
    sizes = seen.groupBy("model", "cell").agg((F.count("*") * rate).alias("asked"), (F.count_if("home") * rate).alias("n"))
    rows = sizes.where((F.col("n") > 2 * part) | (F.col("asked") > 4 * part)).limit(most + 1).collect()
    parts = lambda n, size: max(1, -(-n // size)) if n > 2 * size else 1
    return {(r["model"], r["cell"]): (parts(r["asked"], 2 * part), parts(r["n"], part)) for r in bounded(rows, most, "cells to cut")}
