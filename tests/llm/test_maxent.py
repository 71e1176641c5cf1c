import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from palaver.llm import maxent as M


def corpus(n=300, seed=1):
    """Words that follow one another: a model that sees the word before does better."""
    rng = random.Random(seed)
    follow = {f"w{i}": [f"w{(i * 7 + k) % 60}" for k in range(3)] for i in range(60)}
    rows = []
    for i in range(n):
        w, text = rng.choice(sorted(follow)), []
        for _ in range(rng.randrange(1, 80)):
            text.append(w if rng.random() > 0.1 else f"rare{rng.randrange(400)}")
            w = rng.choice(follow[w])
        rows.append((i, " ".join(text).title()))
    return rows


def brute(rows):
    cut = lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if i is not None and not out(i) for w in cut(t))
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in cut(t))) for i, t in rows]


@pytest.mark.parametrize("shared", [M.SHARED_WORDS, 40, 0])
def test_base_equals_brute_force(spark, tmp_path, shared, monkeypatch):
    monkeypatch.setattr(M.train, "__defaults__", (M.ROUNDS, shared))
    rows = [*corpus(), (900, None), (901, ""), (None, "w1 w2"), (902, "w1 w1"), (902, "w1 w1"), (903, "é É W1\x0bw2")]
    spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, known int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in M.op9_lm_scoring(spark, str(tmp_path)).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    if shared == M.SHARED_WORDS:
        held = [g for g in got if g[1]]
        assert sum(g[6] for g in held) > 0.93 * sum(g[5] for g in held)  # less negative: the likelier


def chance(model, place, f, token):
    """The product of a word's choices, one by one, as the tree states them."""
    p = 1.0
    for node, slot in zip(model.nodes[place], model.slots[place], strict=True):
        if node < 0:
            break
        key = np.uint64(node) * M._MIX
        rows = [int(((x ^ key) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & (model.rows - 1) for x in f[:, token]]
        z = model.biases[node].astype(float) + sum(model.weights[r].astype(float) for r in rows)
        p *= np.exp(z[slot] - z.max()) / np.exp(z - z.max()).sum()
    return p


@pytest.mark.parametrize("shared", [M.SHARED_WORDS, 40])
def test_score_equals_brute_force_and_chances_add_up_to_one(spark, shared):
    rows = corpus(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = M.train(df, shared_words=shared)
    assert np.abs(model.weights).max() > 0
    h, f = M._contexts([M.hashes_of("w1 w2 w3")])
    with np.errstate(over="ignore"):
        assert abs(sum(chance(model, i, f, 2) for i in range(len(model.words) + 1)) - 1) < 1e-3
        c = {r.word: r.c for r in counts.collect()}
        for r in M.score(df.limit(12), model, counts).collect():
            h, f = M._contexts([M.hashes_of(dict(rows)[r.doc_id])])
            want = 0.0
            for i, (word, place) in enumerate(zip(h, model.find(h), strict=True)):
                want += math.log10(chance(model, place, f, i))
                if place == len(model.words):
                    want += math.log10((c.get(int(word.view(np.int64)), 0) + 1) / model.other)
            assert abs(r.score - want) < 1e-3 * max(1, abs(want))


def test_score_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = []
    for n in (1, 7):
        part = df.repartition(n)
        found.append({r.doc_id: r.score for r in M.score(part, *M.train(part)).collect()})
    assert found[0].keys() == found[1].keys()
    assert all(abs(found[0][i] - found[1][i]) < 1e-3 * max(1, abs(found[0][i])) for i in found[0])


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 300])
def test_tree_reaches_every_leaf_once(n):
    nodes, slots, biases = M.tree(np.arange(1.0, n + 1))
    ways = {tuple(zip(a[a >= 0], b[a >= 0], strict=True)) for a, b in zip(nodes, slots, strict=True)}
    assert len(ways) == n and (nodes[-1] >= 0).sum() == (nodes >= 0).sum(axis=1).min()
    assert np.allclose(np.exp(biases.astype(float)).sum(axis=1), 1, atol=1e-5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model, counts = M.train(none)
    assert M.score(none, model, counts).count() == 0
    [r] = M.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model, counts).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, round(r.score, 6)) == (3, 0, 0, 0.0, 0.0)
