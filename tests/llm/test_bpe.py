import base64
import hashlib
import random

import public_tokenizers as P
import regex
import tiktoken

from palaver.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(rows):
    enc, out = encoding(), []
    for doc_id, text in rows:
        ids = enc.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return out


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in bpe.encode_decode(df, PATH, P.PATTERN, **options).collect()]


def order(rows):
    return sorted(rows, key=repr)


def texts():
    rng = random.Random(3)
    words = ["the", "été", " ", "  ", "\n\n", "don't", "1234", "...", "日本語", "a" * 70, "\t x", "'s", "🙂", "\r\n"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 400)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " " * 500), (103, "z" * 900), (104, "\n" * 300 + "x"), (None, "no id"), (105, "same"), (105, "same")]
    rows += [(106, "long " * 200), (106, "long " * 200), (None, "long " * 100), (107, "'" * 400), (108, "x" * 250 + " " * 250 + "1" * 250)]
    return rows


def test_equals_library_in_one_chunk(spark):
    assert order(got(spark, texts())) == order(expected(texts()))


def test_equals_library_in_many_chunks(spark):
    for chunk, overlap in ((50, 20), (64, 3), (37, 1)):
        assert order(got(spark, texts(), chunk_chars=chunk, overlap_chars=overlap)) == order(expected(texts()))


def test_contractions_around_the_ends_of_chunks():
    """Every offset of a contraction to what a chunk reads, stitched as a task does it."""
    pattern, (chunk, overlap) = regex.compile(P.PATTERN), (24, 8)
    for said in ("they're", "we've", "she'll", "it's", "!'re", "''ll", " 've"):
        for offset in range(70):
            text = ("ab " * 40)[:offset] + said + " and more of the text" * 4
            bounds = [bpe.sure_bounds(pattern, text[a : a + chunk + overlap], a, a + chunk + overlap >= len(text)) for a in range(0, len(text), chunk)]
            assert bpe.stitch(pattern, text, bounds) == [0, *(m.end() for m in pattern.finditer(text))], (said, offset)


def test_random_chunks_stitch_to_the_whole(spark):
    pattern, rng = regex.compile(P.PATTERN), random.Random(11)
    parts = ["'", "'l", "l", "'r", "e", "'v", "'re", "'ve", "'ll", " ", "\n", "  ", "a", "1", "!", "é", "\r\n"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 160)))
        chunk, overlap = rng.randrange(3, 40), rng.randrange(1, 20)
        bounds = [bpe.sure_bounds(pattern, text[a : a + chunk + overlap], a, a + chunk + overlap >= len(text)) for a in range(0, len(text), chunk)]
        assert bpe.stitch(pattern, text, bounds) == [0, *(m.end() for m in pattern.finditer(text))], (text, chunk, overlap)


def test_shipped_sizes_on_long_texts(spark):
    rows = [(k, ("word " * 20_000)[:n] + "xyz'll go " + "word " * 6_000) for k, n in enumerate((65_533, 69_627, 69_630))]
    assert order(got(spark, rows)) == order(expected(rows))


def test_every_long_piece_merges_as_the_library(spark):
    enc, ranks, rng = encoding(), bpe.load_ranks(PATH), random.Random(5)
    for _ in range(300):
        piece = "".join(rng.choice("abcdeé ßñ") for _ in range(rng.randrange(1, 300))).replace(" ", "") or "a"
        assert bpe._merge_long(piece.encode(), ranks) == bpe.merge_piece(piece.encode(), ranks) == enc._core_bpe.encode_single_piece(piece.encode())


def test_ties_take_the_leftmost_pair():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257}
    for n in range(1, 60):
        assert bpe.merge_piece(b"a" * n, ranks) == bpe._merge_long(b"a" * n, ranks) or b"a" * n in ranks


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, start int, part int, ids string")
    assert bpe.encode_decode(df, PATH, P.PATTERN).count() == 0
    df = spark.createDataFrame([(1, "a b " * 30, 9, 9, "q")], "doc_id long, text string, start int, part int, ids string")
    assert bpe.encode_decode(df, PATH, P.PATTERN, chunk_chars=16, overlap_chars=4).count() == 1


def test_every_character_is_cut_as_by_the_library():
    enc = encoding()
    cut = bpe._Coder(bpe.load_ranks(PATH), P.PATTERN)
    odd = []
    for c in range(0x20000):
        if 0xD800 <= c < 0xE000:
            continue
        text = f"a{chr(c)}1 {chr(c)} {chr(c)}"
        if cut.encode(cut.cut(text)) != ",".join(map(str, enc.encode_ordinary(text))):
            odd.append(c)
    # Letters of a later Unicode version than the other library's, if any.
    assert len(odd) < 12_000
    print(len(odd), [hex(x) for x in odd[:20]])
