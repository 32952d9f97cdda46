import random
import re
from collections import Counter

from pyspark.sql import functions as F

from delvestone.llm import neardup


def fixture():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows = []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        for k in range(4):
            words = list(base)
            for _ in range(int(len(words) * 0.06 * k)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if k == 2:
                rng.shuffle(words)
            rows.append((f"d{g}_{k}", " ".join(words)))
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1]), ("copy1", rows[0][1]), ("short", "a b c"), ("none", None), ("empty", "")]
    return rows


def brute(rows, share=0.8, least=40):
    bag = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows}
    ids = sorted(i for i in bag if sum(bag[i].values()) >= least)
    return {(a, b) for a in ids for b in ids if a < b and sum((bag[a] & bag[b]).values()) >= share * max(sum(bag[a].values()), sum(bag[b].values())) - 1e-9}


def found(records, **more):
    links, members = neardup.near_duplicates(records, **more)
    left, right = members.toDF("x", "a"), members.toDF("y", "b")
    rows = links.join(left, "a").join(right, "b").select("x", "y").union(left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y"))
    return {tuple(sorted(r)) for r in rows.collect()}


def test_all_pairs_of_the_definition(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "id string, text string").withColumn("bag", F.lit("a clashing column"))
    want = brute(rows)
    got = found(neardup.bags(df, "id", F.col("text"), 40))
    assert got <= want
    assert len(got) >= 0.98 * len(want) and len(want) > 50


def test_hot_columns_are_cut_into_blocks_without_loss(spark):
    rng = random.Random(2)
    shared = [f"c{i}" for i in range(30)]
    rows = [(f"r{i}", " ".join(shared + [f"u{i}_{j}" for j in range(6)])) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, text string")
    records = neardup.bags(df, "id", F.col("text"), 30).cache()
    plain = neardup.product(neardup.incidence(records, 5, 32, {}, 1000), 0.8)
    counts = {r[0]: r[1] for r in neardup.incidence(records, 5, 32, {}, 1000).groupBy("gram").count().collect() if r[1] > 10}
    assert counts
    blocks = {g: -(-n // 8) for g, n in counts.items()}
    cut = neardup.product(neardup.incidence(records, 5, 32, blocks, 8), 0.8)
    table = spark.createDataFrame(list(blocks.items()), "gram bigint, blocks bigint")
    joined = neardup.product(neardup.cut_columns(neardup.incidence(records, 5, 32, {}, 1000), table), 0.8)
    a = {(r.a, r.b): r.shared for r in plain.collect()}
    b = {(r.a, r.b): r.shared for r in cut.collect()}
    c = {(r.a, r.b): r.shared for r in joined.collect()}
    assert a == b == c and len(a) == 60 * 59 // 2
    assert rng


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert found(neardup.bags(df, "id", F.col("text"), 40)) == set()


def test_one_shared_gram_is_enough(spark):
    rng = random.Random(3)

    def grams(words):
        t = neardup.tokens([" ".join(words)], neardup._Words())[1]
        return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}

    while True:
        a, b, c = ([f"{x}{rng.randrange(10**9)}" for _ in range(k)] for x, k in (("a", 40), ("b", 10), ("c", 10)))
        if len(grams(a + b) & grams(a + c)) == 1:
            break
    df = spark.createDataFrame([("x", " ".join(a + b)), ("y", " ".join(a + c))], "id string, text string")
    assert found(neardup.bags(df, "id", F.col("text"), 40)) == {("x", "y")}


def test_more_hot_columns_than_are_broadcast(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "id string, text string")
    records = neardup.bags(df, "id", F.col("text"), 40)
    assert neardup.hot_columns(records, 5, 32, 3, rate=1).count() > 5
    old = neardup.hot_columns
    try:
        neardup.hot_columns = lambda *a, **k: old(*a, **k, rate=1)
        assert found(records, block=3, few=5) == found(records, block=3, few=10**6) == found(records)
    finally:
        neardup.hot_columns = old
