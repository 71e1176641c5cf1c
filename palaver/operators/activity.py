"""When and how much: counts by day, hour, weekday and month, response times, rounds, overview.

Each takes messages (many chats, keyed by chat_id) and returns a small table. Rows without a chat_id
form a group of their own; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import columns as C

REPLY_MS = 6 * C.HOUR_MS


def _by_person() -> list[Column]:
    return [F.count_if(F.col("is_self")).alias("self"), F.count_if(~F.col("is_self")).alias("other")]


def daily_counts(messages: DataFrame, tz: str = C.TZ) -> DataFrame:
    """chat_id, date, self, other of the days that have messages."""
    return messages.groupBy("chat_id", C.day(F.col("ts_ms"), tz).alias("date")).agg(*_by_person())


def _dense(messages: DataFrame, value: Column, size: int, name: str) -> DataFrame:
    """One aggregate with a counter for each bucket, turned into rows: zeros need no join."""
    cells = [F.struct(F.count_if(F.col("is_self") & (F.col("b") == i)).alias("self"), F.count_if(~F.col("is_self") & (F.col("b") == i)).alias("other")) for i in range(size)]
    rows = messages.select("chat_id", "is_self", value.alias("b")).groupBy("chat_id").agg(F.array(*cells).alias("cells"))
    return rows.select("chat_id", F.posexplode("cells").alias(name, "c")).select("chat_id", name, "c.self", "c.other")


def hourly_distribution(messages: DataFrame, tz: str = C.TZ) -> DataFrame:
    """chat_id, hour, self, other; 24 rows a chat."""
    return _dense(messages, C.hour(F.col("ts_ms"), tz), 24, "hour")


def weekday_distribution(messages: DataFrame, tz: str = C.TZ) -> DataFrame:
    """chat_id, weekday (0 is Monday), self, other, weekday_name; 7 rows a chat."""
    return _dense(messages, C.weekday(F.col("ts_ms"), tz), 7, "weekday").withColumn("weekday_name", C.weekday_name(F.col("weekday")))


def heatmap(messages: DataFrame, tz: str = C.TZ) -> DataFrame:
    """chat_id, weekday, hour, count of the cells that have messages."""
    ts = F.col("ts_ms")
    return messages.groupBy("chat_id", C.weekday(ts, tz).alias("weekday"), C.hour(ts, tz).alias("hour")).agg(F.count("*").alias("count"))


def heatmap_scale(cells: DataFrame) -> DataFrame:
    """chat_id, scale_max: the largest cell, at least 1."""
    return cells.groupBy("chat_id").agg(F.greatest(F.lit(1), F.max("count")).alias("scale_max"))


def month_counts(messages: DataFrame, tz: str = C.TZ) -> DataFrame:
    return messages.groupBy("chat_id", C.month(F.col("ts_ms"), tz).alias("month")).agg(F.count("*").alias("count"))


def months_of_text(messages: DataFrame) -> DataFrame:
    """chat_id, months: distinct months by the written time."""
    return messages.groupBy("chat_id").agg(F.countDistinct(F.substring("time_str", 1, 7)).alias("months"))


def person_totals(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id", _person().alias("person")).agg(F.count("*").alias("total_messages"))


def _person() -> Column:
    return F.when(F.col("is_self"), "self").otherwise("other")


def shares(messages: DataFrame) -> DataFrame:
    """chat_id, person, count, share in percent (one decimal)."""
    counts = person_totals(messages).withColumnRenamed("total_messages", "count")
    total = F.sum("count").over(Window.partitionBy("chat_id"))
    return counts.withColumn("share", F.round(F.try_divide(F.lit(100.0) * F.col("count"), total), 1))


def with_previous(messages: DataFrame, bucket_ms: int = C.DAY_MS) -> DataFrame:
    """messages with prev_ts and prev_uid, those of the message before in its chat.

    A window over (chat, time bucket) finds all but the first of a bucket; for those a table of each
    bucket's last message, a row a bucket, is shifted by one and joined. So a chat that holds a third
    of all messages is spread over many tasks, which a window over the chat would not allow.
    """
    key = F.concat(F.when(F.col("chat_id").isNull(), "-").otherwise("+"), F.coalesce("chat_id", F.lit("")))
    rows = messages.withColumn("__key", key).withColumn("__bucket", F.floor(F.col("ts_ms") / bucket_ms))
    last = rows.groupBy("__key", "__bucket").agg(F.max(F.struct("ts_ms", "seq", "sender_uid")).alias("last"))
    order = Window.partitionBy("__key", "__bucket").orderBy("ts_ms", "seq")
    rows = rows.withColumn("__ts", F.lag("ts_ms").over(order)).withColumn("__uid", F.lag("sender_uid").over(order)).withColumn("__first", F.row_number().over(order) == 1)
    across = Window.partitionBy("__key").orderBy("__bucket")
    edge = last.select("__key", "__bucket", F.lag("last").over(across).alias("__before"))
    joined = rows.join(edge, ["__key", "__bucket"], "left")
    pick = lambda own, name: F.when(F.col("__first"), F.col(f"__before.{name}")).otherwise(F.col(own))
    return joined.withColumn("prev_ts", pick("__ts", "ts_ms")).withColumn("prev_uid", pick("__uid", "sender_uid")).drop("__key", "__bucket", "__ts", "__uid", "__first", "__before")


def response_times(messages: DataFrame, limit_ms: int = REPLY_MS, rounding: str = "exact") -> DataFrame:
    """chat_id, self_avg_seconds, other_avg_seconds: mean gap to the message before, whoever sent it.

    Gaps over the limit don't count; without any the mean is 0.
    """
    gaps = with_previous(messages).withColumn("gap", F.col("ts_ms") - F.col("prev_ts"))
    mean = lambda who: F.coalesce(F.try_divide(F.sum(F.when(who & (F.col("gap") <= limit_ms), F.col("gap"))).cast("double"), F.count_if(who & (F.col("gap") <= limit_ms)) * F.lit(1000)), F.lit(0.0))
    out = gaps.groupBy("chat_id").agg(mean(F.col("is_self")).alias("s"), mean(~F.col("is_self")).alias("o"))
    return out.select("chat_id", C.round1(F.col("s"), rounding).alias("self_avg_seconds"), C.round1(F.col("o"), rounding).alias("other_avg_seconds"))


def exchange_rounds(messages: DataFrame) -> DataFrame:
    """chat_id, rounds: runs of one sender; an empty first uid opens none."""
    return with_previous(messages).groupBy("chat_id").agg(F.count_if(F.col("sender_uid") != F.coalesce("prev_uid", F.lit(""))).alias("rounds"))


def overview(messages: DataFrame, chats: DataFrame | None = None, tz: str = C.TZ, rounding: str = "exact") -> DataFrame:
    """One row a chat of counters; with chats, names and the header's duration too."""
    chars = lambda who: F.coalesce(F.sum(F.when(who, F.length("text"))), F.lit(0)).alias
    own = F.col("is_self")
    counts = with_previous(messages).groupBy("chat_id").agg(
        F.count("*").alias("total_messages"),
        F.count_if(own).alias("self_count"),
        F.count_if(~own).alias("other_count"),
        chars(own)("self_chars"),
        chars(~own)("other_chars"),
        F.count_if(F.col("has_image")).alias("total_images"),
        F.coalesce(F.sum(F.size("face_ids")), F.lit(0)).cast("long").alias("total_faces"),
        F.count_if(F.col("sender_uid") != F.coalesce("prev_uid", F.lit(""))).alias("exchange_rounds"),
        F.countDistinct(C.day_number(F.col("ts_ms"), tz)).alias("active_days"),
    )
    return overview_of(counts, chats, rounding)


def overview_of(counts: DataFrame, chats: DataFrame | None, rounding: str) -> DataFrame:
    """overview() from a row of counters a chat."""
    duration = F.lit(0)
    if chats is not None:
        names = chats.select(F.col("chat_id").alias("__chat"), "self_name", "other_name", "duration_days")
        counts = counts.join(names, F.col("chat_id").eqNullSafe(F.col("__chat")), "left").drop("__chat")
        duration = F.coalesce("duration_days", F.lit(0))
    days = F.when(duration != 0, duration.cast("long")).otherwise(F.greatest("active_days", F.lit(1)))
    out = counts.withColumn("total_days", days).withColumn("avg_daily", C.round1(F.col("total_messages") / F.col("total_days").cast("double"), rounding))
    return out.drop("duration_days")


# Described for the reference but not part of it.


def active_periods(messages: DataFrame, top: int = 3, tz: str = C.TZ) -> DataFrame:
    """The busiest hours of each chat, by rank."""
    counts = messages.groupBy("chat_id", C.hour(F.col("ts_ms"), tz).alias("hour")).agg(F.count("*").alias("count"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("count"), "hour"))).where(F.col("rank") <= top)


def image_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(F.count_if(F.col("has_image") & F.col("is_self")).alias("self"), F.count_if(F.col("has_image") & ~F.col("is_self")).alias("other"))


def initiations(messages: DataFrame, gap_ms: int = REPLY_MS) -> DataFrame:
    """chat_id, self, other, initiator_ratio_self: who opens a conversation after a long gap."""
    opens = with_previous(messages).where(F.col("prev_ts").isNull() | (F.col("ts_ms") - F.col("prev_ts") > gap_ms))
    out = opens.groupBy("chat_id").agg(*_by_person())
    return out.withColumn("initiator_ratio_self", F.col("self") / (F.col("self") + F.col("other")).cast("double"))


def replies(messages: DataFrame, limit_ms: int = REPLY_MS) -> DataFrame:
    """chat_id, person, messages, replies, reply_ratio: what follows a message of somebody else within the limit."""
    rows = with_previous(messages)
    replied = (F.col("sender_uid") != F.col("prev_uid")) & (F.col("ts_ms") - F.col("prev_ts") <= limit_ms)
    out = rows.groupBy("chat_id", _person().alias("person")).agg(F.count("*").alias("messages"), F.count_if(replied).alias("replies"))
    return out.withColumn("reply_ratio", F.col("replies") / F.col("messages").cast("double"))


def sessions(messages: DataFrame, gap_ms: int = REPLY_MS, bucket_ms: int = C.DAY_MS, tz: str = C.TZ) -> DataFrame:
    """chat_id, begin_ms, first_seq, end_ms, messages, self, other, midnights: runs without a longer gap.

    midnights is how many local midnights lie in a session. Each message finds the begin of its session
    among those of its time bucket, or else takes the last begin of the buckets before, a row a
    bucket; so a session may go over many buckets while no task has a whole chat.
    """
    key = F.concat(F.when(F.col("chat_id").isNull(), "-").otherwise("+"), F.coalesce("chat_id", F.lit("")))
    opens = F.col("prev_ts").isNull() | (F.col("ts_ms") - F.col("prev_ts") > gap_ms)
    rows = with_previous(messages, bucket_ms).select("chat_id", key.alias("__key"), F.floor(F.col("ts_ms") / bucket_ms).alias("__bucket"), "ts_ms", "seq", "is_self", F.when(opens, F.struct("ts_ms", "seq")).alias("__opens"))
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = rows.groupBy("__key", "__bucket").agg(F.max("__opens").alias("__last")).select("__key", "__bucket", before.alias("__carried"))
    own = F.last("__opens", ignorenulls=True).over(Window.partitionBy("__key", "__bucket").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__own", own).join(carried, ["__key", "__bucket"]).withColumn("begin", F.coalesce("__own", "__carried"))
    out = rows.groupBy("chat_id", "begin").agg(F.max("ts_ms").alias("end_ms"), F.count("*").alias("messages"), *_by_person())
    midnights = C.day_number(F.col("end_ms"), tz) - C.day_number(F.col("begin_ms"), tz)
    return out.select("chat_id", F.col("begin.ts_ms").alias("begin_ms"), F.col("begin.seq").alias("first_seq"), "end_ms", "messages", "self", "other").withColumn("midnights", midnights)


def session_days(found: DataFrame, tz: str = C.TZ) -> DataFrame:
    """Sessions cut at local midnights: chat_id, begin_ms, first_seq, date, from_ms, to_ms of each part."""
    day = F.explode(F.sequence(C.day_number(F.col("begin_ms"), tz), C.day_number(F.col("end_ms"), tz)))
    rows = found.select("chat_id", "begin_ms", "first_seq", "end_ms", day.alias("day"))
    starts = lambda d: d.cast("long") * C.DAY_MS - C.offset_ms(tz)
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd")
    return rows.select("chat_id", "begin_ms", "first_seq", date.alias("date"), F.greatest("begin_ms", starts(F.col("day"))).alias("from_ms"), F.least("end_ms", starts(F.col("day") + 1)).alias("to_ms"))


def late_nights(found: DataFrame) -> DataFrame:
    """chat_id, cross_late_night (sessions that go over a local midnight), midnights (in all of them)."""
    return found.groupBy("chat_id").agg(F.count_if(F.col("midnights") > 0).alias("cross_late_night"), F.sum("midnights").cast("long").alias("midnights"))
