import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import fim

WORDS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plainly(doc_id, text):
    """The contract, one document at a time."""
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    parts = WORDS.findall(text)
    n = len(parts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def made(n=300, seed=5):
    rng = random.Random(seed)
    pieces = ["a", "word", "  ", "\n", "\t\r\n", "é", "漢字", "😀", "\xa0", " ", "\x00", "<P", ">", "<", "S>", "<M>", "x" * 90, " " * 50, "\x1f", "é"]
    texts = ["", None, " ", "\n\n", "one", " one ", "<P>", "a <S> b", "x" * 200_000, "w " * 150_000, " " * 100_000, "a" + " " * 100_000]
    return [(i, texts[i] if i < len(texts) else "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(n)]


def test_equals_plain_python_and_sql(spark, tmp_path):
    rows = [*made(), *made()[12:20], (None, "a b c"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = fim.op11_fill_in_middle(spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted((plainly(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(fim.SQL)
    assert df.columns == want.columns and got == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("block", [1, 2, 7, 64, 2**20])
def test_parts_of_a_long_text_give_the_tokens_of_the_whole(block):
    for _, text in made(120, seed=block)[12:]:
        want = np.cumsum([len(x) for x in WORDS.findall(text)], dtype=np.int64)
        assert fim.token_ends(text, block=block).tolist() == want.tolist()


def test_a_tail_of_white_space_is_one_token():
    text = "a b" + " " * 12_000_000
    assert fim.token_ends(text).tolist() == [1, 3, len(text)]
    assert fim.token_ends(" " * 12_000_000).tolist() == [12_000_000]


def test_outputs_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, f"some words of {i} and more", "old", -1) for i in range(60)], "doc_id long, text string, output string, n int")
    got = fim.fill_in_middle(df, cut_percent=100, spm_percent=50)
    assert sorted(got.columns) == sorted(["doc_id", "text", "output", "n", "form", "prefix_chars", "middle_chars"])
    rows = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in rows} == {"psm", "spm"} and all(r.back == r.text and r.n == 6 for r in rows)
    for r in rows:
        p, m = r.text[: r.prefix_chars], r.text[r.prefix_chars : r.prefix_chars + r.middle_chars]
        assert f"<P>{p}<" in r.output and r.output.endswith(f"<M>{m}")
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    assert {r.form for r in fim.fill_in_middle(df, cut_percent=0).collect()} == {"plain"}


def test_other_patterns(spark):
    df = spark.createDataFrame([(1, "ab12cd"), (2, "")], "doc_id long, text string")
    assert [r.n for r in fim.fill_in_middle(df, pattern="[0-9]+", cut=None).orderBy("doc_id").collect()] == [3, 0]
