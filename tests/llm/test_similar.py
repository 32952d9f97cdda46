import numpy as np
from pyspark.sql import functions as F

from delvestone.llm import similar


def data(n=600, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(40, dim))
    x = (centre[rng.integers(0, 40, n)] + 0.35 * rng.normal(size=(n, dim))).astype(np.float32)
    model = np.where(rng.random(n) < 0.7, "a", "b")
    return [(f"v{i:04d}", model[i], [float(v) for v in x[i]]) for i in range(n)]


def brute(rows, k, least):
    out = set()
    for model in {m for _, m, _ in rows}:
        own = sorted({i: v for i, m, v in rows if m == model}.items())
        x = np.array([v for _, v in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        np.fill_diagonal(s, -2)
        for i in range(len(own)):
            for j in np.lexsort((np.arange(len(own)), -s[i]))[:k]:
                if s[i, j] >= least:
                    out.add((own[i][0], own[j][0]))
    return out


SCHEMA = "id string, m string, v array<float>"


def test_recall_against_brute_force(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id, r.other) for r in similar.most_similar(df, "id", "v", "m", 32, k=5, min_cos=0.5, per_cell=60, books=4, size=16).collect()}
    want = brute(rows, 5, 0.5)
    assert len(got & want) >= 0.95 * len(want)


def test_odd_rows_copies_and_ties(spark):
    one = [1.0] + [0.0] * 31
    rows = [("c%02d" % i, "a", one) for i in range(12)] + [("c00", "a", one)]
    rows += [("null", "a", None), ("nomodel", None, one), ("short", "a", one[:5]), ("zero", "a", [0.0] * 32), ("nan", "a", [float("nan")] + one[1:]), ("inf", "a", [float("inf")] + one[1:]), ("hole", "a", [None] + one[1:])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cos", F.lit("a clashing column"))
    got = similar.most_similar(df, "id", "v", "m", 32, k=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r.other)
    assert set(by) == {"c%02d" % i for i in range(12)}
    for i, others in by.items():
        assert sorted(others) == [c for c in ("c00", "c01", "c02", "c03") if c != i][:3]


def test_empty(spark):
    assert similar.most_similar(spark.createDataFrame([], SCHEMA), "id", "v", "m", 32).count() == 0


def test_beam_search_beats_greedy():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    f = similar.Codebooks.fit(x, [8] * 4)
    inner = x @ f.words.T
    wide, cost = f.beam(inner, 8, 4)
    narrow, greedy = f.beam(inner, 1, 4)
    assert cost[:, 0].mean() < greedy[:, 0].mean()
    rebuilt = f.words[wide[:, 0]].sum(1)
    assert np.allclose(f.norms(wide[:, 0]), (rebuilt**2).sum(1), rtol=1e-3)


def test_packing_is_lossless():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 8)).astype(np.float32)
    x[:10] = x[:10].astype(np.float16)
    packed = similar._pack(x)
    assert {len(p) for p in packed[:10]} == {16} and {len(p) for p in packed[10:]} == {32}
    assert (similar._unpack(packed, 8) == x).all()


def test_cut_cells_lose_nothing(spark):
    """One dense cell, cut into parts of stored vectors and of askers, gives the rows that it gives whole."""
    rng = np.random.default_rng(9)
    x = (np.ones(32) + 0.2 * rng.normal(size=(700, 32))).astype(np.float32)
    rows = [(f"v{i:04d}", "a", [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda part: {(r.id, r.other) for r in similar.most_similar(df, "id", "v", "m", 32, k=4, per_cell=10_000, books=4, size=16, shortlist=700, part=part).collect()}
    whole = run(4096)
    assert whole == brute(rows, 4, -1.0)
    assert run(64) == whole


def test_every_pair_meets_once():
    for askers, parts in ((1, 1), (2, 2), (5, 3), (3, 1), (1, 4)):
        for a in range(30):
            for b in range(30):
                ask = {g for g, asks, _ in similar.places(a, askers, parts, False) if asks}
                stored = {g for g, _, home in similar.places(b, askers, parts, True) if home}
                assert len(ask & stored) == 1
        assert sum(1 for _ in similar.places(7, askers, parts, True)) == askers + parts - 1


def test_as_many_cells_are_asked_as_it_takes(spark):
    """Without clusters neighbours lie in many cells; more are asked until enough of them are met."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    rows = [(f"v{i:04d}", "a", [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5, -1.0)
    share = lambda **more: len({(r.id, r.other) for r in similar.most_similar(df, "id", "v", "m", 32, k=5, per_cell=30, books=4, size=16, **more).collect()} & want) / len(want)
    assert share() >= 0.9 > 0.6 > share(recall=0.0)
