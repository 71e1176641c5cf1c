import random

import pytest
from pyspark.sql import functions as F

from palaver.operators import activity
from palaver.streaming import replies

pytest.importorskip("google.protobuf")


def test_stream_equals_the_batch_up_to_the_watermark(spark, tmp_path):
    """Three starts of one stream; messages of a later one lie between those of an earlier one."""
    rng = random.Random(6)
    data = [(rng.choice("abc"), i, i * 600_000 + rng.randrange(600_000), rng.choice(["u", "v", ""])) for i in range(400)]
    df = spark.createDataFrame(data, "chat_id string, seq long, ts_ms long, sender_uid string").withColumn("is_self", F.col("sender_uid") == "u").withColumn("ts", F.timestamp_millis("ts_ms")).cache()
    late = (F.col("seq") % 10 == 0) & (F.col("seq") % 150 > 141)
    parts = [df.where((F.floor(F.col("seq") / 150) == k) & ~late | (F.floor(F.col("seq") / 150) == k - 1) & late) for k in range(3)]
    before = spark.conf.get(replies.PROVIDER, None)
    try:
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
            out = replies.response_times(source, "3 hours").writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
            out.trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.set(replies.PROVIDER, before) if before else spark.conf.unset(replies.PROVIDER)
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    lasts = {}
    for r in found:
        if r.chat_id not in lasts or r.upto_ms > lasts[r.chat_id].upto_ms:
            lasts[r.chat_id] = r
    assert set(lasts) == set("abc") and len(found) > 20 and min(r.upto_ms for r in lasts.values()) > 300 * 600_000
    seen = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for chat, r in lasts.items():
        settled = seen.where((F.col("chat_id") == chat) & (F.col("ts_ms") <= r.upto_ms))
        want, rounds = activity.response_times(settled).first(), activity.exchange_rounds(settled).first()
        assert (round(r.self_avg_seconds, 1), round(r.other_avg_seconds, 1), r.rounds) == (want.self_avg_seconds, want.other_avg_seconds, rounds.rounds)
