import random

from palaver.llm import decontaminate as D


def brute(docs, items):
    """Windows of plain lower-case words, for texts without numbers or names."""
    cut = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    out = set()
    for d, text in docs:
        own = grams(cut(text))
        for i, item in items:
            g = grams(cut(item))
            if g and len(own & g) / len(g) >= 0.5:
                out.add((d, i, len(g), len(own & g)))
    return out


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id, r.n_windows, r.n_found) for r in D.leaks(d, b, **options).collect()}


def case():
    rng = random.Random(4)
    words = [f"{a}{b}é" for a in "bcdfg" for b in ("a", "o", "lu", "mi")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randrange(3, 30))) for i in range(12)]
    docs = []
    for d in range(60):
        text = say(rng.randrange(0, 60))
        if d % 3 == 0:
            item = items[d % 12][1].split()
            if d % 2:
                item[len(item) // 2] = "zzz"
            text += ". " + " ".join(item) + ".\n" + say(9)
        docs.append((d, text))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = case()
    want = brute(docs, items)
    assert len(want) > 10
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, broadcast_windows=0) == want


def test_changed_values_are_caught_and_contradictions_are_not(spark):
    item = "a train with Alice aboard goes 120 km in 2 hours and then Alice walks 120 km more, how far does Alice go in all"
    same = "so: a train with Bob aboard goes 75 km in 3 hours and then Bob walks 75 km more, how far does Bob go in all? yes"
    other = "so: a train with Bob aboard goes 75 km in 3 hours and then Carl walks 19 km more, how far does Dora go in all? yes"
    plain = "nothing of that kind is here at all, only 12 km of words"
    got = {d: n for d, _, _, n in run(spark, [(1, same), (2, other), (3, plain), (4, item)], [(7, item)])}
    assert got[1] == got[4] > got.get(2, 0)
    assert 3 not in got


def test_a_copy_is_found_among_other_values_of_its_template(spark):
    """Whichever occurrence of a window comes first, the consistent copy is judged by itself."""
    say = lambda who, a, b: f"a train with {who} aboard goes {a} km in {b} hours and then {who} walks {a} km more, how far does {who} go in {b} hours"
    item = say("Alice", 120, 2)
    part = lambda k, a: " ".join(say(f"N{chr(97 + k)}o", a, k + 3).split()[k * 3 : k * 3 + 9])
    table = ". ".join(part(k, 30 + 7 * k) for k in range(7))
    copies = [item, say("Bob", 75, 3), say("Bob", 75, 3).replace("and then", "and only then")]
    docs = [(10 * k, f"see: {c}") for k, c in enumerate(copies)]
    docs += [(10 * k + 1, f"{table}. see: {c}") for k, c in enumerate(copies)] + [(10 * k + 2, f"see: {c}. {table}") for k, c in enumerate(copies)]
    got = {d: (n, f) for d, _, n, f in run(spark, [*docs, (99, table)], [(7, item)])}
    assert 99 not in got and {d for d, _ in docs} == got.keys()
    for d, (n, f) in got.items():
        assert f >= got[d // 10 * 10][1] and (d >= 20 or n == f)


def test_two_values_of_an_item_do_not_become_one(spark):
    item = "first Alice gave 12 apples to Carol and then Alice gave 7 apples to Erin before Carol and Erin left"
    same = "now: first Bob gave 30 apples to Dora and then Bob gave 9 apples to Fay before Dora and Fay left. end"
    flat = "now: first Bob gave 30 apples to Bob and then Bob gave 30 apples to Bob before Bob and Bob left. end"
    got = {d: n for d, _, _, n in run(spark, [(1, same), (2, flat), (3, item)], [(7, item)])}
    assert got[1] == got[3] > got.get(2, 0)


def test_results_do_not_depend_on_partitions(spark):
    item = "a train with Alice aboard goes 120 km in 2 hours and then Alice walks 120 km more, how far does Alice go in all"
    docs = [(k, " ".join(item.replace("Alice", f"N{chr(97 + j)}o").replace("120", str(30 + j)) + "." for j in range(k % 5 + 1)) + (" x " + item if k % 2 else "")) for k in range(12)]
    found = []
    for n in (1, 5):
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(n)
        found.append({tuple(r) for r in D.leaks(d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()})
    assert found[0] == found[1] and len(found[0]) == 12


def test_nulls_repeats_and_empty(spark):
    docs = [(1, None), (2, ""), (None, "one two three four five six"), (None, "something else"), (3, "x one two three four five six"), (3, "x one two three four five six")]
    items = [(1, "one two three four five six"), (2, None), (3, ""), (None, "something else")]
    assert run(spark, docs, items) == {(None, 1, 2, 2), (3, 1, 2, 2)}
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()
    df = spark.createDataFrame([(d, t, "q", 1) for d, t in docs], "doc_id long, text string, hash string, item_id int")
    kept = D.decontaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["1", "2", "None"]
