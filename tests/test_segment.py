import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from palaver.operators import content, segment
from palaver.plans import views

SF = "/root/testdata/sf0.01"


def model_of(seed=1):
    rng = np.random.default_rng(seed)
    steps = rng.random((4, 4)) * segment.ALLOWED
    letters = np.array(sorted(ord(c) for c in "一丁七万"), np.uint32)
    by_tag = rng.random((5, 4))
    pairs = np.array(sorted((int(a) << 21) | int(b) for a in letters[:3] for b in letters[1:]), np.uint64)
    by_pair = np.vstack([rng.random((len(pairs), 4)), np.zeros(4)])
    before = rng.random((5, 4)) * 3
    return segment.Tagger(steps / steps.sum(1, keepdims=True), letters, by_tag / by_tag.sum(0), pairs, by_pair, before)


def paths(run, model):
    """Every row of tags with its chance."""
    chances = model.chances([run])[0]
    for tags in itertools.product(range(4), repeat=len(run)):
        p = segment.FIRST[tags[0]] * segment.LAST[tags[-1]]
        for t, tag in enumerate(tags):
            p *= chances[t, tag] * (model.steps[tags[t - 1], tag] if t else 1)
        yield tags, p


def test_expectations_and_words_equal_all_paths():
    model, runs, weights = model_of(), ["一", "丁七", "一丁七万一", "万万七", "某一某"], np.array([1.0, 2.0, 3.0, 1.0, 5.0])
    steps, tags = segment.expected(runs, weights, model)
    want = np.zeros((4, 4))
    for i, (run, w) in enumerate(zip(runs, weights, strict=True)):
        every = list(paths(run, model))
        total = sum(p for _, p in every)
        mine = np.zeros((len(run), 4))
        for row, p in every:
            for t, tag in enumerate(row):
                mine[t, tag] += p / total
                if t:
                    want[row[t - 1], tag] += w * p / total
        assert np.allclose(tags[i, : len(run)], mine) and not tags[i, len(run) :].any()
        best = max(every, key=lambda x: x[1])[0]
        cuts = [0, *[t for t in range(1, len(run)) if best[t] in (segment.B, segment.S)], len(run)]
        assert segment.decoded(runs, model)[i] == [run[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    assert np.allclose(steps, want)


def test_chances_by_hand():
    model = model_of(2)
    got = model.chances(["一丁", "某"])
    k = int(np.searchsorted(model.pairs, (ord("一") << 21) | ord("丁")))
    i, j = (int(np.searchsorted(model.letters, ord(c))) for c in "一丁")
    assert np.allclose(got[0, 0], model.by_tag[i]) and np.allclose(got[1, 0], model.by_tag[4]) and (got[1, 1] == 1).all()
    assert np.allclose(got[0, 1], (model.by_pair[k] + segment.BACKING * model.by_tag[j]) / (model.before[i] + segment.BACKING))


def f1(rows):
    known, found, right = (sum(r[c] for r in rows) for c in ("known", "found", "right"))
    return 2 * right / (known + found)


def test_better_than_the_lexicon_on_texts_without_blanks(spark):
    fitted = f1(views.segmented(spark, SF).collect())
    rows = views.unspaced(spark, SF)
    lexicon = content.learned_lexicon(rows)
    cut = rows.withColumn("c", content.tokens(F.col("text"), lexicon)).select(views.boundaries(F.col("words")).alias("k"), views.boundaries(F.col("c")).alias("c"))
    plain = f1(cut.select(F.size("k").alias("known"), F.size("c").alias("found"), F.size(F.array_intersect("k", "c")).alias("right")).collect())
    assert fitted > 0.48 and fitted > plain + 0.15, (fitted, plain)


def test_fitting_does_not_depend_on_how_rows_are_dealt(spark):
    rng = random.Random(5)
    words = ["".join(chr(0x4E00 + rng.randrange(60)) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(50)]
    df = spark.createDataFrame([("，".join("".join(rng.choice(words) for _ in range(4)) for _ in range(3)) + " ok",) for _ in range(300)], "text string")
    a, b = segment.fit(df.repartition(1), rounds=3), segment.fit(df.repartition(7), rounds=3)
    assert (a.letters == b.letters).all() and (a.pairs == b.pairs).all() and np.allclose(a.by_pair, b.by_pair) and np.allclose(a.steps, b.steps)


def test_texts_are_read_once_and_a_round_is_one_pass(spark, monkeypatch):
    read, passed, plain = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), segment._expecting

    def counting(model):
        run = plain(model)

        def each(batches):
            def seen():
                for pdf in batches:
                    passed.add(len(pdf))
                    yield pdf

            yield from run(seen())

        return each

    @F.udf("string")
    def noted(text):
        read.add(1)
        return text

    monkeypatch.setattr(segment, "_expecting", counting)
    df = spark.createDataFrame([(chr(0x4E00 + k) + "一丁" * (k % 7),) for k in range(1, 41)], "text string")
    segment.fit(df.select(noted("text").alias("text")), rounds=3)
    assert read.value == 40 and passed.value == 3 * 40, (read.value, passed.value)


def test_many_runs_of_mixed_lengths_equal_single_ones():
    model, rng = model_of(3), random.Random(7)
    runs = ["".join(rng.choice("一丁七万某") for _ in range(rng.choice([1, 1, 2, 3, 9, 40]))) for _ in range(200)]
    weights = np.arange(1.0, 201.0)
    steps, tags = segment.expected(runs, weights, model)
    words = segment.decoded(runs, model)
    want = np.zeros((4, 4))
    for i, run in enumerate(runs):
        s, t = segment.expected([run], weights[i : i + 1], model)
        want += s
        assert np.allclose(tags[i, : len(run)], t[0]) and words[i] == segment.decoded([run], model)[0]
    assert np.allclose(steps, want)


def test_boundaries_by_hand(spark):
    df = spark.createDataFrame([(["丁", "一七", "ab|.", "𠀀"],), (["一 丁"],), (["x"] * 5_000,)], "w array<string>")
    got = [r[0] for r in df.select(views.boundaries(F.col("w"))).collect()]
    assert got == [[1, 3, 7], [], list(range(1, 5_000))]


def test_runs_of_any_kind(spark):
    long = "一丁七" * 2_000
    df = spark.createDataFrame([("一丁 ab1 七万",), (None,), ("",), ("plain",), (long,), ("一丁 ab1 七万",)], "text string")
    model = segment.fit(df, rounds=2)
    got = [r[0] for r in df.select(segment.tokens(F.col("text"), model)).collect()]
    assert got[1] == got[2] == [] and got[3] == ["plain"] and "".join(got[4]) == long and got[0] == got[5] and "".join(got[0]) == "一丁ab1七万"
    none = segment.fit(df.where("text = 'plain'"))
    assert df.select(segment.tokens(F.col("text"), none)).first()[0][-1] and segment.fit(df.limit(0)).letters.size == 0


def test_unknown_words_between_those_of_a_lexicon(spark):
    model = model_of()
    df = spark.createDataFrame([("一丁研究七万一",)], "text string")
    cut = df.select(segment.tokens(F.col("text"), model, {"研究": 5})).first()[0]
    want = [*segment.decoded(["一丁"], model)[0], "研究", *segment.decoded(["七万一"], model)[0]]
    assert cut == want
