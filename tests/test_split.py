import json
import random

import pytest

from palaver.sources import exports, split
from tests.test_golden import GOLDEN, message, rows

SAID = ["}", "{", '"', "\\", '\\"', '"}', "[{,", "],", '"messages":[', "\\\\", "é漢😀", " ", "\n", "plain, text", '{"a": "}"}', ""]


def exported(n, seed=0, indent=None, **head):
    rng = random.Random(seed)
    said = lambda: "".join(rng.choice(SAID) for _ in range(rng.randrange(8)))
    found = []
    for i in range(n):
        m = message(f"m{i}", 10**12 + rng.randrange(10**9), said(), rng.choice(["u1", "u2", ""]), rng.choice(["", "me"]), rng.choice(["type_1", "type_17"]), ("text", {"text": said()}), ("face", {"id": i % 9, "name": said()}))
        m["content"]["messages"] = [{"nested": said()}, 1]
        found.append(m)
    return json.dumps({"metadata": {"messages": [1, {"a": "}"}]}, "other": [[{"x": said()}], said()], **GOLDEN, **head, "messages": found, "tail": {"messages": [said()]}}, ensure_ascii=seed % 2 == 0, indent=indent)


@pytest.fixture
def cut_every(spark):
    """Ranges of so many bytes."""

    def set_to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield set_to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def same(spark, path):
    want, got = exports.ingest(spark, path), split.ingest(spark, path)
    for name in ("chats", "messages", "rejects"):
        a, b = getattr(want, name), getattr(got, name)
        assert a.columns == b.columns and a.dtypes == b.dtypes
        assert rows(b, "*") == rows(a, "*"), name
    return got


@pytest.mark.parametrize("size", [300, 10_000_000])
def test_equals_the_reader_of_whole_files(spark, cut_every, tmp_path, size):
    for k, (n, indent) in enumerate([(0, None), (1, 2), (13, None), (7, 1)]):
        (tmp_path / f"chat{k}.json").write_text(exported(n, k, indent) + ["", "\n", " \n\t"][k % 3], encoding="utf-8")
    cut_every(size)
    got = same(spark, str(tmp_path))
    if size < 1_000:
        assert split.ranges(spark, str(tmp_path)).count() > 30


def test_every_cut(spark, cut_every, tmp_path):
    """A file whose ranges begin at each of its bytes in turn."""
    text = exported(3, 5)
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    want = rows(exports.ingest(spark, str(tmp_path)).messages, "*")
    for size in range(401, 441, 7):
        cut_every(size)
        assert rows(split.ingest(spark, str(tmp_path)).messages, "*") == want, size


def test_marks_equal_a_scanner_of_single_bytes():
    rng = random.Random(3)
    for _ in range(400):
        data = "".join(rng.choice('"\\{}[],x') for _ in range(rng.randrange(60))).encode()
        for inside in (False, True):
            at, quotes, within, escaped = [], 0, inside, False
            for i, c in enumerate(data):
                if escaped:
                    escaped = False
                elif c == ord("\\"):
                    escaped = True
                elif c == ord('"'):
                    within, quotes = not within, quotes + 1
                elif not within and chr(c) in "{}[],":
                    at.append(i)
            got, c, n = split.marks(data, inside)
            assert got.tolist() == at and n == quotes and bytes(c.tolist()) == bytes(data[i] for i in at)


@pytest.mark.parametrize("size", [120, 10**6])
def test_rejects(spark, cut_every, tmp_path, size):
    whole = exported(5, 2)
    files = {
        "good": whole,
        "short": whole[:-1],
        "cut": whole[: len(whole) // 2],
        "open": whole[: whole.rindex('"')],
        "bare": '{"messages": []}',
        "lacking": '{"chatInfo": {"name": "x"}}',
        "null": '{"chatInfo": {"name": "x"}, "messages": null}',
        "none": '{"chatInfo": {"name": "x"}, "messages": [ ]}',
        "typed": '{"chatInfo": {"name": "x"}, "messages": [{"timestamp": "soon"}]}',
        "empty_object": '{"chatInfo": {"name": "x"}, "messages": [{}, null]}',
        "words": "no export at all",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    cut_every(size)
    got = same(spark, str(tmp_path))
    assert {r.chat_id for r in got.chats.collect()} == {"good", "none", "empty_object"}
    with pytest.raises(Exception, match="unparseable|invalid format"):
        split.ingest(spark, str(tmp_path), strict=True).chats.collect()


def test_a_large_file_is_read_by_many_tasks(spark, cut_every, tmp_path):
    one = exported(2_000, 9)
    (tmp_path / "big.json").write_text(one, encoding="utf-8")
    cut_every(200_000)
    got = same(spark, str(tmp_path))
    assert got.messages.rdd.getNumPartitions() > 4
    split.land(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "messages")).count() == 2_000
    assert split.ingest(spark, str(tmp_path), skip_marked=True).messages.count() == 2_000


def test_too_many_ranges_are_an_error(spark, cut_every, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text(exported(20, 1), encoding="utf-8")
    cut_every(100)
    monkeypatch.setattr(split, "MOST_RANGES", 3)
    with pytest.raises(ValueError, match="ranges"):
        split.ingest(spark, str(tmp_path))
