import random
import zlib

import pytest

from palaver.llm import toxicity as T


def corpus(n=900, seed=2):
    """Insults make a text toxic. One group is named mostly in toxic texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        text = [rng.choice(words) for _ in range(rng.randrange(5, 40))]
        if toxic:
            text += rng.choices(["vile", "nasty", "rotten", "foul"], k=2)
        if rng.random() < (0.6 if toxic else 0.03):
            text.append("muslims")
        elif rng.random() < 0.2:
            text.append("christians")
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark, tmp_path):
    docs, labels = corpus()
    d, l = frames(spark, docs, labels)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    l.write.parquet(f"{tmp_path}/labels.parquet")
    got = T.op10_toxicity(spark, str(tmp_path)).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and len(held) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_counterfactual_penalty_frees_the_group_mention(spark):
    d, l = frames(spark, *corpus())
    plain, fair = (T.fit(d, l, fairness=f) for f in (0.0, 50.0))
    of = lambda m, w: m["words"].get(T.word_hash(w), 0.0)
    bias = lambda m: abs(of(m, "muslims") - of(m, "christians"))
    assert bias(plain) > 1 and bias(fair) < 0.25 * bias(plain)
    assert of(fair, "vile") > 2


def test_counterfactual_swaps_within_kind():
    got = T.counterfactual("The Muslims came. Nobody spoke")
    assert "muslims" not in got and any(w in got for w in T.IDENTITY["faiths"])
    assert T.counterfactual("nobody spoke") is None
    assert T.counterfactual("The Muslims came.") == T.counterfactual("The Muslims came.")


#: Words of four languages, their insults, and two groups each, the first named mostly in toxic texts.
LANGUAGES = {
    "English": (["vile", "nasty", "rotten"], ["muslims", "christians"]),
    "German": (["widerlich", "abscheulich", "elend"], ["Türken", "Europäer"]),
    "French": (["ignoble", "infect", "odieux"], ["Arabes", "Européens"]),
    "Spanish": (["vil", "repugnante", "odioso"], ["Musulmanes", "Cristianos"]),
}


def overlay(n=2_400, seed=6):
    """(documents, labels, neutral mentions, insults), both of the latter unlabelled."""
    rng = random.Random(seed)
    docs, labels, neutral, insults = [], [], [], []
    for i in range(n):
        language = rng.choice(sorted(LANGUAGES))
        bad, (hated, other) = LANGUAGES[language]
        text = [f"{language.lower()}{rng.randrange(150)}" for _ in range(rng.randrange(8, 30))]
        toxic = rng.random() < 0.3
        kind = rng.random()
        if i % 6 == 0:
            neutral.append((i, " ".join([*text, hated])))
            insults.append((n + i, " ".join([*text, *rng.sample(bad, 2), rng.choice([hated, other])])))
            continue
        if toxic:
            # Some toxic texts have no insult that the model could know, so the group's name is all there is.
            text += rng.sample(bad, 2) if rng.random() < 0.6 else []
            text += [hated] if kind < 0.8 else []
        elif kind < 0.15:
            text.append(other)
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return docs, labels, neutral, insults


def test_neutral_mentions_in_four_languages_are_left_alone(spark):
    docs, labels, neutral, insults = overlay()
    d, l = frames(spark, docs, labels)
    flagged = {}
    for name, fairness in (("plain", 0.0), ("fair", T.FAIRNESS)):
        model = T.fit(d, l, fairness=fairness)
        for kind, rows in (("neutral", neutral), ("insults", insults)):
            got = T.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
            flagged[name, kind] = sum(r.predicted for r in got) / len(rows)
    print(flagged)
    assert flagged["plain", "neutral"] > 0.9 and flagged["fair", "neutral"] < 0.02
    assert flagged["fair", "insults"] > 0.95


def test_terms_are_of_one_kind_each():
    terms = [w for kind in T.IDENTITY.values() for w in kind]
    assert len(terms) == len(set(terms))
    assert all(w == w.lower() and T._WORD.fullmatch(w) and T.SWAPS[w] for w in terms)
    for language, word in (("German", "Frauen"), ("French", "Chrétiens"), ("Spanish", "árabes")):
        swapped = T.counterfactual(f"x {word} y").split()[1]
        assert any(language in kind and {swapped, word.lower()} <= set(terms) for kind, terms in T.IDENTITY.items())


@pytest.mark.parametrize("labels", [[], [(0, 1, 1)], [(0, 1, 0), (0, 1, 0), (None, 1, 1), (1, None, None)]])
def test_nulls_repeats_and_missing_labels(spark, labels):
    docs = [(0, "a b"), (1, None), (1, None), (2, ""), (None, "x " * 30_000)]
    d, l = frames(spark, docs, labels)
    d = d.selectExpr("*", "1 label", "'q' words", "0.5D score")
    got = T.score(d, T.fit(d, l)).collect()
    assert sorted(repr(r.doc_id) for r in got) == ["0", "1", "1", "2", "None"]
    assert len({r.score for r in got}) == 1
    assert T.score(d.limit(0), T.fit(d.limit(0), l)).count() == 0
    assert T.rejected_removed(d, l).columns == d.columns


def test_scores_equal_brute_force(spark, tmp_path):
    """Every score is the logistic of the bias and the weights of the text's distinct words."""
    import math

    docs, labels = corpus(300)
    docs += [(900, None), (901, ""), (902, "vile VILE vile, w1"), (902, "vile VILE vile, w1")]
    d, l = frames(spark, docs, labels)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    l.write.parquet(f"{tmp_path}/labels.parquet")
    own = lambda rows: [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    model = T.fit(*frames(spark, own(docs), own(labels)))
    want = [(i, 1 / (1 + math.exp(-(model["bias"] + sum(model["words"].get(T.word_hash(w), 0.0) for w in set(T._WORD.findall((t or "").lower()))))))) for i, t in docs]
    got = [(r.doc_id, r.score) for r in T.op10_toxicity(spark, str(tmp_path)).collect()]
    for (i, a), (j, b) in zip(sorted(got), sorted(want), strict=True):
        assert i == j and abs(a - b) < 1e-6


def test_fit_is_at_the_penalised_optimum():
    """No small move of the weights lowers what is minimised."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(rng.random() < 0.3), sorted(rng.choice(6, 3, replace=False).tolist()), None, 1) for _ in range(200)]
    rows = [(y, own, [5 if i == 4 else 4 if i == 5 else i for i in own] if {4, 5} & set(own) else None, c) for y, own, _, c in rows]
    w, b = T._descend(rows, 6, 2.0)

    def loss(w, b):
        fit = sum(math.log1p(math.exp(-(2 * y - 1) * (b + w[own].sum()))) for y, own, _, _ in rows) / len(rows)
        pairs = [(own, other) for _, own, other, _ in rows if other is not None]
        return fit + 0.5 * T.RIDGE * (w**2).sum() + 2.0 * sum((w[a].sum() - w[o].sum()) ** 2 for a, o in pairs) / len(pairs)

    import math

    best = loss(w, b)
    for k in range(6):
        for step in (-0.02, 0.02):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, b) > best - 1e-5
