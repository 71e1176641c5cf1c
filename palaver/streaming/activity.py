"""The activity metrics over a stream of messages (columns as in messages, with ts a timestamp)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(messages: DataFrame, late: str = "1 hour", day_start: str = "16 hours") -> DataFrame:
    """chat_id, start, self, other of each day; day_start 16 hours makes UTC+8 days."""
    days = F.window("ts", "1 day", None, day_start)
    return messages.withWatermark("ts", late).groupBy("chat_id", days.alias("day")).agg(F.count_if("is_self").alias("self"), F.count_if(~F.col("is_self")).alias("other")).select("chat_id", F.col("day.start").alias("start"), "self", "other")


def exchange_rounds(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """chat_id, rounds: of all messages that no earlier one can precede any more.

    Messages wait until the watermark has passed them, so those of a later batch still find their
    place among them; later ones than ``late`` are left out, as in daily_counts. A chat's state is
    its last sender and what waits.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rounds, last, *waiting = state.get if state.exists else (0, "", [], [], [])
        rows = pd.DataFrame(dict(zip(("ts_ms", "seq", "sender_uid"), waiting, strict=True)))
        rows = pd.concat([rows, *[b[["ts_ms", "seq", "sender_uid"]] for b in batches]]).sort_values(["ts_ms", "seq"])
        upto = state.getCurrentWatermarkMs()
        settled, rows = rows[rows.ts_ms <= upto], rows[rows.ts_ms > upto]
        if len(settled):
            uid = settled.sender_uid.fillna("")
            rounds += int((uid != uid.shift(fill_value=last)).sum())
            last = uid.iloc[-1]
        state.update((rounds, last, rows.ts_ms.astype(int).tolist(), rows.seq.astype(int).tolist(), rows.sender_uid.fillna("").tolist()))
        if len(rows):
            state.setTimeoutTimestamp(max(int(rows.ts_ms.min()), upto + 1))
        if len(settled):
            yield pd.DataFrame({"chat_id": [key[0]], "rounds": [rounds]})

    slim = messages.withWatermark("ts", late).select("chat_id", "ts", "ts_ms", "seq", "sender_uid")
    held = "rounds long, last string, ts_ms array<long>, seq array<long>, sender_uid array<string>"
    return slim.groupBy("chat_id").applyInPandasWithState(update, "chat_id string, rounds long", held, "update", GroupStateTimeout.EventTimeTimeout)
