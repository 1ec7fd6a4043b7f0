import math

import numpy as np
import pytest

from tidemark.llm import queries, topk


def brute(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(ok):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), c) for b, (c, w) in enumerate(ok) if a != b and len(w) == len(v))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op10_threshold_top_k"](spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows)


def test_hostile_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]  # ties everywhere
    rows += [(400, None), (500, []), (600, [1.0, None, 0.0, 0.0]), (700, [float("nan")] * 4), (800, [float("inf")] * 4), (None, [1.0] * 4)]
    rows += [(900, [0.0] * 4), (1000, [1.0, 2.0]), (1001, [3.0, 1.0]), (1100, [5.0])]
    rows += [(1200, [1.0, 0.0, 2.0]), (1200, [0.0, 1.0, 3.0]), (1200, [0.0, 1.0, 3.0]), (1201, [1.0, 1.0, 1.0]), (1300, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "7 as score", "1 as cb")
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_stops_early():
    rows = np.zeros((5000, 2), np.int64)
    rows[:, 0] = np.arange(5000)
    lists = topk.SortedLists(np.arange(5000), rows)
    ids, scores = lists.top(-1, np.array([3, 0]), 2)
    assert ids.tolist() == [4999, 4998] and scores.tolist() == [14997, 14994]
    assert lists.scored <= 4


def test_scores_few_rows_of_skewed_vectors():
    """Components that fall off quickly: a small part is scored, and a floor known from elsewhere makes it smaller."""
    r = np.random.default_rng(3)
    rows = np.floor(1024 * r.standard_normal((8000, 16)) * 0.3 ** np.arange(16)).astype(np.int64)
    lists = topk.SortedLists(np.arange(8000), rows)
    part, floored = [], []
    for i in range(0, 8000, 400):
        scores = rows @ rows[i]
        scores[i] = -(1 << 50)
        want = np.lexsort((np.arange(8000), -scores))[:10]
        ids, found = lists.top(i, rows[i], 10)
        assert ids.tolist() == want.tolist() and found.tolist() == scores[want].tolist()
        part.append(lists.scored / 8000)
        assert lists.top(i, rows[i], 10, int(found[-1]))[0].tolist() == want.tolist()
        floored.append(lists.scored / 8000)
    assert np.mean(part) < 0.4 and np.mean(floored) <= np.mean(part)


def test_products_beyond_64_bits(spark):
    """Partial sums may leave 64 bits, scores and components may not."""
    rows = [(100, [1e12, 1e12, 1.0]), (1, [1e12, -1e12, 2.0]), (2, [1.0, 2.0, 3.0]), (3, [-1e12, 1e12, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == brute(rows)
    for bad in ([1e12, 1e12, 1.0], [1e300, 0.0, 0.0]):
        with pytest.raises(Exception):
            topk.top_k(df.union(spark.createDataFrame([(9, bad)], "vec_id long, embedding array<double>"))).collect()
