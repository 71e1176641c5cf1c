import random

import pytest
from pyspark.sql import functions as F

from palaver.operators import activity, content
from palaver.plans import states
from palaver.sources import results
from tests.test_golden import rows


def made(spark, n=900, seed=4):
    rng = random.Random(seed)
    data = [
        (rng.choice(["a", "a", "b", None]), i, rng.randrange(9 * 86_400) * 1000 if i % 7 else 5_000_000, f"2025-{i % 12 + 1:02d}-01", rng.choice(["u1", "u2", "u3", ""]), rng.choice(["", "hello you", "emmm ok ok", "word " * 9]), rng.choice(["type_1", "type_17"]), i % 5 == 0, [i % 4] * (i % 3), [["x", "y", ""][i % 3]] * (i % 2))
        for i in range(n)
    ]
    df = spark.createDataFrame(data, "chat_id string, seq long, ts_ms long, time_str string, sender_uid string, text string, msg_type string, has_image boolean, face_ids array<int>, face_names array<string>")
    return df.withColumn("is_self", F.col("sender_uid") == "u1")


METRICS = [
    (states.daily_counts, activity.daily_counts),
    (states.hourly_distribution, activity.hourly_distribution),
    (states.weekday_distribution, activity.weekday_distribution),
    (states.heatmap, activity.heatmap),
    (states.length_stats, content.length_stats),
    (states.face_ranking, content.face_ranking),
    (states.word_ranking, content.word_ranking),
    (states.overview, activity.overview),
    (states.response_times, activity.response_times),
    (states.exchange_rounds, activity.exchange_rounds),
    (states.months_of_text, activity.months_of_text),
]


@pytest.mark.parametrize("split", ["ts_ms < 400000000", "seq % 2 = 0", "chat_id = 'a'", "true"])
def test_merged_states_equal_the_whole(spark, tmp_path, split):
    df = made(spark)
    mine = F.coalesce(F.expr(split), F.lit(False))
    for name, part in (("one", df.where(mine)), ("two", df.where(~mine)), ("one", df.where(mine))):
        states.upsert(part, str(tmp_path), name)
    merged = states.load(spark, str(tmp_path))
    for got, want in METRICS:
        a, b = got(merged), want(df)
        assert sorted(a.columns) == sorted(b.columns)
        order = sorted(b.columns)
        assert rows(a, *order) == rows(b, *order), want.__name__


def test_a_batch_replaces_its_former_self(spark, tmp_path):
    df = made(spark, 60)
    states.upsert(df, str(tmp_path), "x")
    states.upsert(df.where("seq < 20"), str(tmp_path), "x")
    assert rows(states.exchange_rounds(states.load(spark, str(tmp_path))), "*") == rows(activity.exchange_rounds(df.where("seq < 20")), "*")


def test_one_chat_opens_few_files(spark, tmp_path):
    df = spark.range(20_000).select((F.col("id") % 200).cast("string").alias("chat_id"), F.col("id").alias("seq"))
    df = df.union(spark.range(5_000).selectExpr("'77'", "-id - 1")).union(spark.range(9).selectExpr("null", "id"))
    path = f"{tmp_path}/t"
    results.store_by_chat(df, path, 20)
    assert len(spark.read.parquet(path).inputFiles()) >= 15
    for chat in ("0", "123", "77", None, "absent"):
        got = results.load_chat(spark, path, chat)
        assert rows(got, "*") == rows(df.where(F.col("chat_id").eqNullSafe(F.lit(chat))), "*")
        assert len(got.inputFiles()) <= {"77": 8, "absent": 1}.get(chat, 2)
