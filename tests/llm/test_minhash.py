import random

import numpy as np
import pytest

from palaver.llm import minhash, sketch
from palaver.llm.graph import components


def brute(rows):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        n = max(1, len(words) - 4)
        sets.setdefault(doc_id, {tuple(words[i : i + 5]) for i in range(n)} if words else set())
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=1, groups=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 9)):
            t = list(text)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
    # One large group around the threshold.
    text = [rng.choice(words) for _ in range(100)]
    for _ in range(120):
        t = list(text)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append(" ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [256, 7])
def test_components_equal_brute_force(spark, block):
    rows = corpus()
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one  TWO"), (1005, "one two three four five"), (1006, "É é é é é"), (1007, "é é é é é")]
    want = brute(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(want) - 60


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, None)]
    df = spark.createDataFrame([(i, t, 5, "k", b"s", 1) for i, t in rows], "doc_id long, text string, n int, key string, sketch binary, component_id int")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (None, 0, None, True)], key=repr)
    kept = minhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "3", "None", "None"]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 299, 299: 299}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, 800).astype(np.uint64), rng.integers(0, 2**63, 300).astype(np.uint64)
    assert (np.maximum(sketch.registers(a), sketch.registers(b)) == sketch.registers(np.union1d(a, b))).all()
    x, y = np.union1d(a, b), a
    est = sketch.estimate(sketch.registers(x)[None], sketch.registers(y)[None], np.array([1100.0]), np.array([800.0]))[0]
    assert abs(est - 800 / 1100) < 0.1
