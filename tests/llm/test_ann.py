"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm.ann import _best, _compared, neighbours, op4_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, q long"


def brute(ids, vectors, queries, k=20):
    x = np.asarray(vectors, np.float32).astype(float)
    out = {}
    for i in range(len(ids)):
        if queries(ids[i]):
            s = x @ x[i]
            out[ids[i]] = [ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j]))[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append(r.vec_id)
    return out


def test_recall_on_several_blocks(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(i, [float(v) for v in x], 0, 0) for i, x in enumerate(vectors)], SCHEMA)
    want = brute(range(3000), vectors, lambda i: i % 20 == 0)
    got = answers(neighbours(df, F.col("vec_id") % 20 == 0))
    assert got.keys() == want.keys()
    assert np.mean([len({*got[q]} & {*want[q]}) / 20 for q in want]) >= 0.9


def test_copies_ties_and_rows_that_take_no_part(spark):
    same = [(i, [1.0, 2.0], 1, 1) for i in range(40)]
    odd = [(100, None, 0, 0), (101, [0.0, 0.0], 0, 0), (102, [float("nan"), 1.0], 0, 0), (103, [None, 1.0], 0, 0), (104, [1.0], 0, 0), (None, [1.0, 1.0], 0, 0), (105, [], 0, 0), (106, [float("inf"), 1.0], 0, 0)]
    other = [(200, [3.0, -1.0], 0, 0), (200, [3.0, -1.0], 5, 5), (220, [-1.0, 0.5], 0, 0)]
    got = answers(neighbours(spark.createDataFrame(same + odd + other, SCHEMA), F.col("vec_id") % 20 == 0, k=5))
    assert got == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 200: [0, 1, 2, 3, 4], 220: [0, 1, 2, 3, 4]}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = [(20 * i, [1.0, float(i)], 0, 0) for i in range(n)]
    got = answers(neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert got == {q: w for q, w in brute([r[0] for r in rows], [r[1] for r in rows], lambda i: True).items() if w}


def test_query_reaches_all_of_a_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows], lambda i: i % 20 == 0)
    got = answers(op4_nearest_neighbours(spark, "/root/testdata/sf0.001"))
    assert np.mean([len({*got[q]} & {*want[q]}) / 20 for q in want]) >= 0.95


def recall(spark, vectors, k=20):
    vectors = np.asarray(vectors, np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x], 0, 0) for i, x in enumerate(vectors)], SCHEMA)
    want = brute(range(len(vectors)), vectors, lambda i: i % 10 == 0, k)
    got = answers(neighbours(df, F.col("vec_id") % 10 == 0, k))
    assert got.keys() == want.keys()
    return np.mean([len({*got[q]} & {*want[q]}) / k for q in want])


def test_recall_among_near_copies(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(2, 16))
    assert recall(spark, centre[np.arange(2000) % 2] + 1e-3 * rng.normal(size=(2000, 16))) >= 0.9


def test_recall_beside_a_long_vector(spark):
    x = np.random.default_rng(7).normal(size=(2000, 16))
    x[77] *= 100
    assert recall(spark, x) >= 0.9


def test_repeated_offers_do_not_displace_edges(spark):
    """A hub's best pairs, offered again and again, count once."""
    rows = [(1, w, 1.0 - w / 1000, True) for w in range(2, 42) for _ in range(300 if w < 12 else 1)]
    best = _best(spark.createDataFrame(rows, "node long, w long, s double, fresh boolean"), 32).collect()
    assert sorted(r.w for r in best) == list(range(2, 34))


def test_pairs_that_met_before_are_not_compared(spark):
    codes = [np.array([1.0, 0.1 * i + 0.1], "<f8").tobytes() for i in range(5)]
    members = [(i, i == 2, c, 0.0, -2.0) for i, c in enumerate(codes)]
    df = spark.createDataFrame([(members,)], "members array<struct<w:bigint,new:boolean,code:binary,further:double,least:double>>")
    got = df.mapInArrow(_compared(1, 2.0, "<f8"), "node long, w long, s double").collect()
    assert {r.node: r.w for r in got} == {0: 2, 1: 2, 2: 4, 3: 2, 4: 2}
