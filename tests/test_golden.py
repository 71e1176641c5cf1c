import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from palaver.functions import columns as C
from palaver.operators import activity, content
from palaver.plans import insights, report
from palaver.schema import CONTRACTS
from palaver.sources import exports, results


def message(id, ts, time, uid, name, kind, *elements):
    return {"id": id, "timestamp": ts, "time": time, "sender": {"uid": uid, "name": name, "nickname": "Bobby"}, "type": kind, "content": {"text": "raw", "elements": [{"type": t, "data": d} for t, d in elements]}}


GOLDEN = {
    "chatInfo": {"name": "peer", "selfUid": "u1", "selfName": "me"},
    "statistics": {"totalMessages": 99, "timeRange": {"durationDays": 0}, "senders": [{"uid": "u1", "name": "me"}, {"uid": "u2", "name": "Bob"}]},
    "messages": [
        message("m2", 1758031019000, "2025-09-16 21:56:59", "u2", "", "type_1", ("text", {"text": " emmmm"}), ("text", {"text": " ok "}), ("face", {"id": "14.7"})),
        message("m1", 1758031009000, "2025-09-16 21:56:49", "u1", "me", "type_1", ("text", {"text": "你好"}), ("face", {"id": "14", "name": "/wx"})),
        message("m3", 1758031019000, "2025-09-16 21:56:59", "u1", "me", "type_3", ("reply", {}), ("image", {})),
        message("m4", 1758052619000, "2025-09-17 03:56:59", "u2", "Bob", "type_1", ("text", {"text": "x"})),
        message("m5", 1758074219001, "2025-09-17 09:56:59", "u2", "Bob", "type_1", ("text", {"text": "ab12 hello hello"})),
        message("m6", 1759248000000, "2025-10-01 00:00:00", "u1", "me", "type_11", ("text", {"text": "forward body"})),
    ],
}


@pytest.fixture(scope="module")
def chat(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("exports")
    (d / "golden.json").write_text(json.dumps(GOLDEN), encoding="utf-8")
    (d / "lacking.json").write_text('{"messages": []}')
    (d / "broken.json").write_text('{"chatInfo": {"name"')
    (d / "note.txt").write_text("no export")
    return exports.ingest(spark, str(d)), d


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_ingest(spark, chat):
    x, d = chat
    assert rows(x.rejects, "chat_id", "reason") == [("broken", "unparseable"), ("lacking", "invalid format")]
    assert rows(x.chats, "chat_id", "self_name", "other_name", "other_uid", "total_count", "duration_days") == [("golden", "me", "Bob", "u2", 99, 0)]
    m = x.messages.orderBy("ts_ms", "seq").collect()
    assert [r.id for r in m] == ["m1", "m2", "m3", "m4", "m5", "m6"]
    assert m[1].sender_name == "Bobby" and m[1].text == "emmmm ok" and m[1].face_ids == [] and m[0].face_ids == [14] and m[0].face_names == ["/wx"]
    assert m[2].has_image and m[2].is_reply and not m[2].text
    with pytest.raises(Exception, match="broken|lacking"):
        exports.ingest(spark, str(d), strict=True).messages.collect()
    assert exports.ingest(spark, str(d), max_bytes=10).rejects.count() == 3


def test_face_ids(spark, tmp_path):
    forms = [{"id": 14}, {"id": 14.7}, {"id": "14"}, {"id": "14.7"}, {"id": None}, {}, {"id": True}]
    doc = GOLDEN | {"messages": [message(str(i), i, "", "u2", "B", "t", ("face", f)) for i, f in enumerate(forms)]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = exports.ingest(spark, str(tmp_path)).messages.orderBy("seq").collect()
    assert [r.face_ids for r in got] == [[14], [14], [14], [], [], [0], [1]]


def test_metrics(chat):
    x, _ = chat
    m = x.messages
    assert rows(activity.daily_counts(m), "date", "self", "other") == [("2025-09-16", 2, 1), ("2025-09-17", 0, 2), ("2025-10-01", 1, 0)]
    hours = rows(activity.hourly_distribution(m), "hour", "self", "other")
    assert [r for r in hours if r[1] or r[2]] == [(0, 1, 0), (21, 2, 1), (3, 0, 1), (9, 0, 1)] and len(hours) == 24
    days = rows(activity.weekday_distribution(m), "weekday", "self", "other")
    assert [r for r in days if r[1] or r[2]] == [(1, 2, 1), (2, 1, 2)] and len(days) == 7
    assert rows(activity.heatmap(m), "weekday", "hour", "count") == [(1, 21, 3), (2, 0, 1), (2, 3, 1), (2, 9, 1)]
    assert rows(content.length_stats(m), "person", "avg", "max", "min", "median", "total") == [("other", 8.3, 16, 1, 8, 3), ("self", 4.7, 12, 0, 2, 3)]
    assert rows(content.face_ranking(m), "person", "name", "count") == [("self", "/wx", 1)]
    assert rows(activity.response_times(m), "self_avg_seconds", "other_avg_seconds") == [(0.0, 10805.0)]
    assert rows(activity.exchange_rounds(m), "rounds") == [(5,)]
    o = activity.overview(m, x.chats).first()
    assert (o.total_messages, o.total_days, o.total_images, o.total_faces, o.self_count, o.other_count, o.self_chars, o.other_chars, o.avg_daily, o.exchange_rounds) == (6, 3, 1, 1, 3, 3, 14, 25, 2.0, 5)
    assert rows(activity.month_counts(m), "month", "count") == [("2025-09", 5), ("2025-10", 1)]
    assert rows(activity.months_of_text(m), "months") == [(2,)]
    words = content.word_ranking(m).orderBy("person", "rank").collect()
    assert [(r["person"], r["word"], r["count"]) for r in words] == [("other", "hello", 2), ("other", "emmm", 1), ("other", "ok", 1), ("self", "你好", 1)]
    assert {r["month"]: r["dialog"] for r in content.dialogs(m, x.chats).collect()}["2025-10"] == "[2025-10-01 00:00:00] me: forward body"
    assert {r["person"]: r["utterances"].count("\n") + 1 for r in content.utterances(m, 200, True).collect()}["self"] == 3
    assert {r["person"]: r["utterances"].count("\n") + 1 for r in content.utterances(m, 300, False).collect()}["self"] == 2


def test_lexicon_cuts_along_the_likeliest_path(spark):
    lexicon = {"研究": 50, "研究生": 30, "生命": 40, "命": 5, "起源": 20}
    df = spark.createDataFrame([("研究生命起源 ok",)], "t string")
    assert df.select(content.tokens(F.col("t"), lexicon)).first()[0] == ["研究", "生命", "起源", "ok"]
    assert df.select(content.tokens(F.col("t"))).first()[0][:2] == ["研究", "究生"]


def test_learned_lexicon_finds_the_words_of_the_texts(spark):
    rng = random.Random(8)
    letters = [chr(0x4E00 + 37 * k) for k in range(400)]
    words = ["".join(rng.sample(letters, rng.choice([1, 2, 2, 3]))) for _ in range(80)]
    said = [[rng.choice(words) for _ in range(rng.randrange(3, 12))] for _ in range(600)]
    df = spark.createDataFrame([("".join(s) + " ok",) for s in said], "text string")
    lexicon = content.learned_lexicon(df)
    known = {w for w in words if len(w) > 1}
    assert len(known & lexicon.keys()) > 0.95 * len(known) and len(lexicon.keys() - known) < 0.1 * len(known)
    got = df.select(content.tokens(F.col("text"), lexicon).alias("t")).collect()
    assert sum(r.t == [*s, "ok"] for r, s in zip(got, said, strict=True)) > 0.9 * len(said)
    assert content.learned_lexicon(spark.createDataFrame([("plain",), (None,)], "text string")) == {}


def test_sums_agree_whatever_the_order(spark):
    rng = random.Random(1)
    data = [(f"c{i % 3}", i, rng.randrange(10**9) * 1000, f"u{rng.randrange(3)}", f"w{rng.randrange(9)} " * rng.randrange(4)) for i in range(500)]
    make = lambda d: spark.createDataFrame(d, "chat_id string, seq long, ts_ms long, sender_uid string, text string").withColumn("is_self", F.col("sender_uid") == "u0").withColumn("has_image", F.lit(False)).withColumn("face_ids", F.expr("array(1)")).withColumn("time_str", F.lit("")).withColumn("msg_type", F.lit(""))
    a, b = make(data), make(rng.sample(data, len(data))).repartition(5)
    total = lambda df, *c: sum(r[x] for r in df.collect() for x in c)
    assert {total(f(a), "self", "other") for f in (activity.daily_counts, activity.hourly_distribution, activity.weekday_distribution)} == {500} == {total(activity.heatmap(a), "count")}
    for f in (activity.response_times, activity.exchange_rounds, activity.overview, content.length_stats, content.word_ranking):
        assert rows(f(a), "*") == rows(f(b), "*")
    plain, expect = sorted(data, key=lambda r: (r[0], r[2], r[1])), {}
    for c, _, _, u, _ in plain:
        last, n = expect.get(c, ("", 0))
        expect[c] = (u, n + (u != last))
    assert dict(rows(activity.exchange_rounds(a), "chat_id", "rounds")) == {c: n for c, (_, n) in expect.items()}


class Flaky:
    """Fails as often as told, in one process."""

    def __init__(self, failures):
        self.failures = failures

    def complete(self, system, user):
        self.failures -= 1
        if self.failures >= 0:
            raise OSError("down")
        return "{}"


def test_retries_and_backoff():
    waits = []
    assert insights.attempt(Flaky(2), "s", "u", sleep=waits.append) == "{}" and waits == [1, 2]
    with pytest.raises(OSError):
        insights.attempt(Flaky(3), "s", "u", sleep=waits.append)


def test_analyses(spark, chat, tmp_path):
    class Down:
        def complete(self, system, user):
            raise OSError("down")

    class Silent:
        def complete(self, system, user):
            return ""

    x, _ = chat
    offline = insights.OfflineProvider()
    found = insights.analyze_all(x.messages, x.chats, offline)
    assert sorted({r.dimension for r in found.collect()}) == sorted(CONTRACTS)
    profile = insights.analyze("profile", x.messages, x.chats, offline).collect()
    assert {(r.person, r["name"], r.total_messages, r.result["name"]) for r in profile} == {("self", "me", 3, "me"), ("other", "Bob", 3, "Bob")}
    down = insights.analyze("emotion", x.messages, x.chats, Down(), retries=0).collect()
    assert {r.period for r in down} == {"2025-09", "2025-10"} and all("down" in r.error and r.result is None for r in down)
    assert insights.analyze("emotion", x.messages, x.chats, Silent()).count() == 0
    with pytest.raises(Exception, match="down"):
        insights.analyze("emotion", x.messages, x.chats, Down(), retries=0, fail_fast=True).collect()
    assert not insights.HttpProvider.from_settings(spark).is_configured()
    page = report.build_html(report.sections(report.metrics(x.messages, x.chats), found), "golden")
    assert "hello" in page and "<script" not in page
    report.write_html(spark, page, f"{tmp_path}/html")
    results.store({"rounds": activity.exchange_rounds(x.messages)}, str(tmp_path))
    assert results.load(spark, str(tmp_path), "rounds", "golden").first().rounds == 5
    assert json.loads(results.as_json(activity.exchange_rounds(x.messages)).first().json)["rounds"] == 5


def test_streams(spark, tmp_path):
    from palaver.streaming import activity as live

    data = [("c", i, i * 3_600_000, "a" if i % 3 else "b") for i in range(60)]
    df = spark.createDataFrame(data, "chat_id string, seq long, ts_ms long, sender_uid string").withColumn("is_self", F.col("sender_uid") == "a").withColumn("ts", F.timestamp_millis("ts_ms"))
    # A message of a later batch comes before one of an earlier batch.
    early, late = df.where("seq < 50 and seq <> 48"), df.where("seq >= 50 or seq = 48")
    for k, part in enumerate((early, late)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        days = live.daily_counts(source).writeStream.format("memory").queryName(f"days{k}").outputMode("complete").option("checkpointLocation", f"{tmp_path}/days{k}")
        rounds = live.exchange_rounds(source, "3 hours").writeStream.foreachBatch(lambda batch, i: batch.write.mode("append").parquet(f"{tmp_path}/found")).outputMode("update").option("checkpointLocation", f"{tmp_path}/rounds")
        for q in (days, rounds):
            q.trigger(availableNow=True).start().awaitTermination(120)
    assert sum(r.self + r.other for r in spark.table("days1").collect()) == 60
    # The last batch's watermark lies 3 hours before the last message or, as no later batch moves it, a little further back.
    settled = [rows(activity.exchange_rounds(df.where(F.col("ts_ms") <= k * 3_600_000)), "rounds")[0][0] for k in (54, 56)]
    assert settled[0] <= spark.read.parquet(f"{tmp_path}/found").agg(F.max("rounds")).first()[0] <= settled[1]


def test_word_filters_of_the_fixture(spark):
    """Stop words in lower case, leftovers, signs, identifiers and mixtures fall out; case is kept."""
    said = "Hello hello TM tmd title Title serviceID SERVICEID a 12 345 x1 1W2g ab_cd " + "q" * 16 + " Emmmmm emm em 因为 合并转发 the the don"
    df = spark.createDataFrame([("c", 1, 0, True, said, "type_1"), ("c", 2, 0, True, "skipped words", "type_17"), ("c", 3, 0, True, "x", "type_1")], "chat_id string, seq long, ts_ms long, is_self boolean, text string, msg_type string")
    got = {r["word"]: r["count"] for r in content.word_ranking(df, lexicon={"因为": 1, "合并转发": 1}).collect()}
    assert got == {"Hello": 1, "hello": 1, "serviceID": 1, "SERVICEID": 1, "ab": 1, "cd": 1, "emmm": 2, "em": 1, "the": 2, "don": 1}


def test_one_decimal_is_rounded_as_python_does(spark):
    rng = random.Random(6)
    values = [k / d for k in range(1, 2_000) for d in (20, 40, 200, 3)] + [rng.random() * 10**6 for _ in range(5_000)] + [0.0, -0.25, -0.35]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", C.round1(F.col("v")).alias("r")).collect()
    assert all(r.r == round(r.v, 1) for r in got)
    assert spark.createDataFrame([(None,)], "v double").select(C.round1(F.col("v"))).first()[0] is None


def test_landed_tables_equal_the_exports(spark, chat, tmp_path):
    x, _ = chat
    exports.land(x, str(tmp_path))
    for name in ("chats", "messages", "rejects"):
        assert rows(spark.read.parquet(f"{tmp_path}/{name}"), "*") == rows(getattr(x, name), "*")


def test_newest_share_of_a_month(spark):
    data = [("c" if i % 2 else None, i, i * 40_000_000) for i in range(120)]
    df = spark.createDataFrame(data, "chat_id string, seq long, ts_ms long").repartition(3)
    order = Window.partitionBy("chat_id", C.month(F.col("ts_ms"))).orderBy(F.desc("ts_ms"), F.desc("seq"))
    want = df.withColumn("p", F.percent_rank().over(order)).where("p <= 0.6").drop("p")
    assert rows(content.newest_share(df), "*") == rows(want, "*")


def test_badges_and_log(spark, tmp_path):
    from palaver.plans import logs

    got = spark.createDataFrame([("high",), ("medium",), ("low",), ("?",)], "l string").select(C.badge(F.col("l"))).collect()
    assert [r[0] for r in got] == ["success", "warning", "danger", "secondary"]
    log = logs.to_file(f"{tmp_path}/logs/b.log")
    try:
        assert logs.to_file(f"{tmp_path}/logs/a.log") is log and len(log.handlers) == 2
        insights.log.warning("written")
        written = (tmp_path / "logs" / "a.log").read_text()
        assert "WARNING" in written and written.count("palaver.plans.insights: written") == 1 and not (tmp_path / "logs" / "b.log").read_text()
    finally:
        for handler in list(log.handlers):
            log.removeHandler(handler)


def test_skip_marked_and_guards(spark, tmp_path):
    doc = GOLDEN | {"messages": [message("1", 1, "", "u2", "B", "t", ("text", {"text": "a"})) | {"recalled": True}, message("2", 2, "", "u2", "B", "t")]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    assert exports.ingest(spark, str(tmp_path), skip_marked=True).messages.count() == 1
    x = exports.ingest(spark, str(tmp_path))
    assert x.messages.count() == 2
    with pytest.raises(ValueError, match="key"):
        insights.analyze("emotion", x.messages, x.chats, insights.HttpProvider("", "", ""))
    with pytest.raises(ValueError, match="dimension"):
        insights.analyze("weather", x.messages, x.chats, insights.OfflineProvider())


def test_previous_message_takes_one_pass_of_python_free_operators(spark, chat):
    plan = activity.overview(chat[0].messages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_words_of_messages_are_those_of_one_text_a_person(spark):
    """No run goes over the blank that joins two messages, with bigrams, a lexicon or the model alike."""
    from palaver.operators import segment

    rng = random.Random(7)
    said = ["".join(rng.choice("研究生命起源 ab1，") for _ in range(rng.randrange(12))) for _ in range(200)]
    one = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i long, text string")
    whole = spark.createDataFrame([(" ".join(said),)], "text string")
    model = segment.fit(one, rounds=2)
    for cut in (content.tokens(F.col("text")), content.tokens(F.col("text"), {"研究": 5, "生命": 4}), segment.tokens(F.col("text"), model), segment.tokens(F.col("text"), model, {"研究": 5})):
        parts = [w for r in one.orderBy("i").select(cut.alias("w")).collect() for w in r.w]
        assert parts == whole.select(cut.alias("w")).first().w
