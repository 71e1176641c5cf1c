import hashlib
import random
import re

from pyspark.sql import functions as F

from palaver.llm import secrets as X

KEY = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"


def base_brute(text):
    """The three patterns as stated, matched and then filtered."""
    out = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def linked_brute(text):
    base = X.base_spans(text)
    parts = X.parts(text, base)
    near = lambda p, role: any(q[0] == role and q[2] == p[2] and q is not p for q in parts)
    out = set()
    for p in parts:
        if p[0] == "id" and p[1] and near(p, "secret"):
            out.add((p[3], 3, p[4]))
        if p[0] == "secret" and p[1] and near(p, "id"):
            out.add((p[3], 4, p[4]))
        if p[0] == "endpoint" and near(p, "secret") and near(p, "id"):
            out.add((p[3], 5, p[4]))
    return sorted(base + sorted(out))


def texts():
    rng = random.Random(9)
    bits = ["password=abc", "token = \"abcdefgh1\"", "AKIAABCDEFGHIJKL", "AKIA123", KEY, "client_id: someone", "https://api.example.net/x", "db.example.org:5432", "\n\n", "deadbeef" * 4, "deadbeef" * 3, "the words of a text ", "é🙂 " * 9, "password: token: abcdefgh", "ſecret=abcdefghi", "api_key='", "x" * 150, " "]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 30)))) for i in range(120)]
    return [*rows, (200, None), (201, ""), (None, f"user: someone {KEY}"), (None, None), (202, f"user: someone {KEY}"), (202, f"user: someone {KEY}"), (203, KEY), (204, "client_id: someone")]


def test_spans_equal_brute_force(spark):
    rows = texts()
    got = [(r.doc_id, [tuple(x) for x in r.spans]) for r in X.spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    want = [(i, linked_brute(t or "")) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for i, t in rows:
        assert X.base_spans(t or "") == base_brute(t or "")
    by = dict(want)
    assert by[203] == by[204] == [] and [k for _, k, _ in by[202]] == [3, 4]


def test_query_digests(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in X.op8_secret_scans(spark, str(tmp_path)).collect():
        if r.doc_id is not None:
            base = base_brute(dict(rows)[r.doc_id] or "")
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
            assert r.base_sha256 == hashlib.sha256(",".join(f"{X.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()


def test_redaction(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "q", len(t or "")) for i, t in rows], "doc_id long, text string, cut string, n_chars long")
    got = X.redacted(df)
    assert got.columns == df.columns

    def cut(text):
        if text is None:
            return None
        out, at = [], 0
        merged = []
        for s, _, e in linked_brute(text):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            out.append(text[at:s])
            at = e
        return X.REPLACEMENT.join([*out, text[at:]])

    want = sorted(repr((i, cut(t), len(cut(t) or ""))) for i, t in rows)
    assert sorted(repr((r.doc_id, r.text, r.n_chars)) for r in got.collect()) == want
    assert X.spans(df.limit(0)).count() == 0 and X.redacted(df.where(F.lit(False))).count() == 0


def test_long_and_distant_parts_are_whole(spark):
    name, run = "n" * 200, "Ab1" * 60
    block = f"client_id={name}\n" + "port = 1\n" * 60 + f"{run}\n"
    other = f"client_id={name}\n\n" + "port = 1\n" * 60 + f"{run}\n"
    rows = [(1, block), (2, other), (3, f"a {KEY} user: first {'-' * 40} user: later {KEY}")]
    got = {r.doc_id: r for r in X.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [(block[x.start : x.end], x.kind) for x in got[1].spans]
    assert found == [(name, 3), (run, 4)]
    assert [(x.start, [tuple(y) for y in x.met]) for x in got[1].links] == [(10, [(block.index(run), block.index(run) + 180)]), (block.index(run), [(10, 210)])]
    assert got[2].spans == [] and got[2].links == []
    text = rows[2][1]
    assert [[text[y.start : y.end] for y in x.met] for x in got[3].links] == [["first"], [KEY], [KEY], ["later"]]
    assert name not in X.redacted(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").first().text


def test_clashing_columns_and_ties(spark):
    rows = [(1, f"user: someone {KEY}", 3, "x", 7)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, role int, scope string, start int")
    assert [len(r.spans) for r in X.spans(df).collect()] == [2, 2]
    assert X.redacted(df).columns == df.columns and {r.role for r in X.redacted(df).collect()} == {3}


def test_what_has_no_relation_is_not_linked(spark):
    """Parts far from each other, and paths: on planted logs nothing but whole credentials is reported."""
    rng = random.Random(3)
    line = lambda: f"GET /usr/local/Lib{rng.randrange(9)}/Python3/site{rng.randrange(99)}/Module42File status {rng.randrange(999)}"
    log = "\n".join(["user_id: alice", *(line() for _ in range(60)), "x " * 1_100, f"upload {KEY} done"])
    block = "\n".join(["[service]", "client_id: someone-42", "port = 1", "host = db.example.org:5432", f"value = {KEY}", "", line()])
    planted = [(i, "\n\n".join(rng.sample([block, log, line()], rng.randrange(1, 4)))) for i in range(60)]
    planted += [(900, "client_id: " + "n" * 2_100 + f" {KEY}"), (901, "user_id: alice" + " " * 2_001 + KEY), (902, "user_id: alice" + " " * 2_000 + KEY)]
    hits = right = wrong = 0
    for r in X.spans(spark.createDataFrame(planted, "doc_id long, text string").repartition(3)).collect():
        text = dict(planted)[r.doc_id]
        got = {text[x.start : x.end] for x in r.spans if x.kind > 2}
        want = {"someone-42", "db.example.org:5432", KEY} if block in text else {"n" * 2_100, KEY} if r.doc_id == 900 else {"alice", KEY} if r.doc_id == 902 else set()
        hits, right, wrong = hits + len(got & want), right + len(want), wrong + len(got - want)
    assert hits == right > 50 and wrong == 0
