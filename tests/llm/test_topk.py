import math

from pyspark.sql import functions as F

from tsrisk.llm import topk
from tsrisk.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, rank int, query int, label int"


def vectors(spark, *rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)


def brute(rows, k, asked):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in whole if asked(i)}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(b) == len(a))
        out += [(q, n + 1, i, min(-s, 2**63 - 1)) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rows = [(i, [((i * 7) % 5) / 4.0, -((i * 3) % 4) / 4.0, 0.5]) for i in range(0, 120)]
    rows += [(200, None), (201, [None, 1.0, 1.0]), (202, [float("nan"), 1.0, 1.0]), (203, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(204, [1.0]), (250, [0.5]), (300, []), (350, [1.0, 0.0, 1.0]), (350, [1.0, 0.0, 1.0])] + [(400 + i, [0.75, 0.0, 0.5]) for i in range(1, 40)]
    df = vectors(spark, *rows).repartition(5)
    assert got(topk.top_k(df, F.col("vec_id") % 50 == 0)) == brute(rows, 5, lambda i: i % 50 == 0)


def test_large_numbers_fewer_rows_and_empty(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**20, -1.0]), (50, [0.25, 3.0])]
    assert got(topk.top_k(vectors(spark, *rows), F.col("vec_id") % 50 == 0)) == brute(rows, 5, lambda i: i % 50 == 0)
    assert topk.top_k(vectors(spark, *rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rows = [(i, [math.sin(i), math.cos(3 * i), math.sin(5 * i), 0.1]) for i in range(60)]
    assert got(topk.top_k(vectors(spark, *rows), F.col("vec_id") % 5 == 0, k=3)) == brute(rows, 3, lambda i: i % 5 == 0)


def test_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert got(QUERIES["op3_top_k"](spark, folder)) == brute(rows, 5, lambda i: i % 50 == 0)


def test_scores_beyond_the_floats_reach_their_own_cutoff(spark):
    big = 7_812_500.0  # 2 * 10^9 after scaling
    rows = [(0, [big, 1 / 256]), (1, [big, 300 / 256]), (2, [big, 299 / 256]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 2):
        got = topk.top_k(df, F.col("vec_id") == 0, k).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(1, 4 * 10**18 + 300), (2, 4 * 10**18 + 299)][:k]
