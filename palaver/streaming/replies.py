"""Response times over a stream, with messages that come late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palaver.functions.columns import HOUR_MS
from palaver.operators.activity import REPLY_MS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "ts_ms long, seq long, sender_uid string, is_self boolean"
SUMS = "self_gap long, self_n long, other_gap long, other_n long, rounds long, last_ts long, last_uid string"
OUT = "chat_id string, upto_ms long, self_avg_seconds double, other_avg_seconds double, rounds long"


class Replies(StatefulProcessor):
    """A chat's waiting messages, to which a batch only adds, and sums of those that are settled.

    A message is settled when the watermark has passed the slot in which it lies; a timer for each
    slot that has messages sees to that, so the list is read once a slot and not once a batch.
    """

    def __init__(self, limit_ms: int, slot_ms: int) -> None:
        self.limit_ms, self.slot_ms = limit_ms, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.sums = handle.getValueState("sums", SUMS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        slots: set[int] = set()
        for pdf in rows:
            new = pdf[pdf.ts_ms > upto]
            if len(new):
                self.waiting.appendList(list(zip(new.ts_ms.astype(int).tolist(), new.seq.astype(int).tolist(), new.sender_uid.fillna("").tolist(), new.is_self.fillna(False).astype(bool).tolist(), strict=True)))
                slots |= {-(-int(t) // self.slot_ms) * self.slot_ms for t in new.ts_ms}
        for slot in slots:
            self.handle.registerTimer(slot)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(r) for r in self.waiting.get()]
        settled = sorted(r for r in held if r[0] <= upto)
        if not settled:
            return
        s = list(self.sums.get()) if self.sums.exists() else [0, 0, 0, 0, 0, None, ""]
        for ts, _, uid, own in settled:
            if s[5] is not None and ts - s[5] <= self.limit_ms:
                k = 0 if own else 2
                s[k], s[k + 1] = s[k] + ts - s[5], s[k + 1] + 1
            s[4] += uid != s[6]
            s[5], s[6] = ts, uid
        self.sums.update(tuple(s))
        if rest := [r for r in held if r[0] > upto]:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        mean = lambda total, n: total / (n * 1000) if n else 0.0
        yield pd.DataFrame({"chat_id": [key[0]], "upto_ms": [upto], "self_avg_seconds": [mean(s[0], s[1])], "other_avg_seconds": [mean(s[2], s[3])], "rounds": [s[4]]})

    def close(self) -> None:
        pass


def response_times(messages: DataFrame, late: str = "1 hour", limit_ms: int = REPLY_MS, slot_ms: int = HOUR_MS) -> DataFrame:
    """chat_id, upto_ms, self_avg_seconds, other_avg_seconds, rounds: of all messages up to a time.

    A row whenever messages of a chat are settled, each for all of them so far; the means are not
    rounded. A message that comes after the watermark has passed it is left out. messages has the
    columns of messages and ts, a timestamp. State is kept in RocksDB, which this sets for the session.
    """
    messages.sparkSession.conf.set(PROVIDER, ROCKS)
    slim = messages.withWatermark("ts", late).select("chat_id", "ts", "ts_ms", "seq", "sender_uid", "is_self")
    return slim.groupBy("chat_id").transformWithStateInPandas(Replies(limit_ms, slot_ms), OUT, "Append", "EventTime")
