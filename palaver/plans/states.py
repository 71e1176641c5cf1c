"""Metrics that are merged, not computed anew.

What a batch of messages says about a chat is kept as sums that add up, least values and, where the
order of messages matters, the first and last message of each of its days. A metric of all batches is
then a sum over their states. Gaps between messages are known within a batch's day, and between two of
them from their edges, as long as one begins after the other has ended; only days of a chat in which
batches interleave are looked up in the messages again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions import columns as C
from palaver.operators import activity, content

HOURS = 24
#: Tables of a state: the key that rows are merged by.
KEYS = {
    "days": ["chat_id", "day"],
    "lengths": ["chat_id", "is_self", "n"],
    "faces": ["chat_id", "person", "name"],
    "words": ["chat_id", "person", "word"],
    "months": ["chat_id", "month"],
}


def _segments(messages: DataFrame, tz: str, limit_ms: int) -> DataFrame:
    """A row a chat and local day: counts by hour and person, edges, gaps and rounds between its messages."""
    rows = messages.withColumn("day", C.day_number(F.col("ts_ms"), tz)).withColumn("__hour", C.hour(F.col("ts_ms"), tz))
    rows = rows.withColumn("__key", F.concat(F.when(F.col("chat_id").isNull(), "-").otherwise("+"), F.coalesce("chat_id", F.lit(""))))
    order = Window.partitionBy("__key", "day").orderBy("ts_ms", "seq")
    rows = rows.withColumn("__gap", F.col("ts_ms") - F.lag("ts_ms").over(order)).withColumn("__turn", F.col("sender_uid") != F.lag("sender_uid").over(order))
    own, near = F.col("is_self"), F.col("__gap") <= limit_ms
    hours = lambda who: F.array(*[F.count_if(who & (F.col("__hour") == h)) for h in range(HOURS)])
    edge = F.struct("ts_ms", "seq", "sender_uid", "is_self")
    return rows.groupBy("chat_id", "day").agg(
        hours(own).alias("self"),
        hours(~own).alias("other"),
        F.min(edge).alias("first"),
        F.max(edge).alias("last"),
        F.coalesce(F.sum(F.when(own & near, F.col("__gap"))), F.lit(0)).alias("self_gap"),
        F.count_if(own & near).alias("self_gaps"),
        F.coalesce(F.sum(F.when(~own & near, F.col("__gap"))), F.lit(0)).alias("other_gap"),
        F.count_if(~own & near).alias("other_gaps"),
        F.count_if("__turn").alias("turns"),
        F.coalesce(F.sum(F.when(own, F.length("text"))), F.lit(0)).alias("self_chars"),
        F.coalesce(F.sum(F.when(~own, F.length("text"))), F.lit(0)).alias("other_chars"),
        F.count_if("has_image").alias("images"),
        F.coalesce(F.sum(F.size("face_ids")), F.lit(0)).cast("long").alias("faces"),
    )


def of(messages: DataFrame, tz: str = C.TZ, limit_ms: int = activity.REPLY_MS, **words) -> dict[str, DataFrame]:
    """The states of some messages by table; words goes to content.word_counts()."""
    n = F.length(F.coalesce("text", F.lit("")))
    return {
        "days": _segments(messages, tz, limit_ms),
        "lengths": messages.groupBy("chat_id", "is_self", n.alias("n")).agg(F.count("*").alias("count")),
        "faces": content.face_counts(messages),
        "words": content.word_counts(messages, **words),
        "months": messages.groupBy("chat_id", F.substring("time_str", 1, 7).alias("month")).agg(F.count("*").alias("count")),
    }


def upsert(messages: DataFrame, path: str, batch: str, tz: str = C.TZ, limit_ms: int = activity.REPLY_MS, **words) -> None:
    """Write the states of a batch, and its messages, in place of what is there of a batch of that name.

    A batch that is written again, also after a failure halfway, counts once.
    """
    messages.write.mode("overwrite").parquet(f"{path}/messages/batch={batch}")
    spark = messages.sparkSession
    kept = spark.read.schema(messages.schema).parquet(f"{path}/messages/batch={batch}")
    for name, df in of(kept, tz, limit_ms, **words).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def _settled(days: DataFrame, messages: DataFrame, tz: str, limit_ms: int) -> DataFrame:
    """Segments that follow each other: those of days in which batches interleave are made anew."""
    rows = days.withColumn("__key", F.concat(F.when(F.col("chat_id").isNull(), "-").otherwise("+"), F.coalesce("chat_id", F.lit(""))))
    at = lambda edge: F.struct(F.col(f"{edge}.ts_ms").alias("t"), F.col(f"{edge}.seq").alias("s"))
    before = Window.partitionBy("__key", "day").orderBy(at("first")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__over", F.coalesce(F.max(at("last")).over(before) >= at("first"), F.lit(False)))
    rows = rows.withColumn("__over", F.max("__over").over(Window.partitionBy("__key", "day")))
    mixed = rows.where("__over").select(F.col("chat_id").alias("__chat"), F.col("day").alias("__day")).distinct()
    again = messages.join(mixed, F.col("chat_id").eqNullSafe(F.col("__chat")) & (C.day_number(F.col("ts_ms"), tz) == F.col("__day")), "left_semi")
    return rows.where("not __over").select(days.columns).unionByName(_segments(again, tz, limit_ms))


def load(spark: SparkSession, path: str, tz: str = C.TZ, limit_ms: int = activity.REPLY_MS) -> dict[str, DataFrame]:
    """The merged states of all batches: tz and limit_ms have to be those that they were written with."""
    read = lambda name: spark.read.parquet(f"{path}/{name}").drop("batch")
    out = {"days": _settled(read("days"), read("messages"), tz, limit_ms)}
    for name in ("lengths", "months"):
        out[name] = read(name).groupBy(*KEYS[name]).agg(F.sum("count").alias("count"))
    for name in ("faces", "words"):
        out[name] = read(name).groupBy(*KEYS[name]).agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"))
    return out


# The metrics, as activity and content compute them from messages.


def _all(hours: str) -> Column:
    return F.aggregate(hours, F.lit(0).cast("long"), lambda a, b: a + b)


def daily_counts(states: dict[str, DataFrame]) -> DataFrame:
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd")
    return states["days"].groupBy("chat_id", date.alias("date")).agg(F.sum(_all("self")).alias("self"), F.sum(_all("other")).alias("other"))


def _by_hour(states: dict[str, DataFrame], *keys: str) -> DataFrame:
    cells = states["days"].withColumn("weekday", _weekday()).select("chat_id", *keys, F.posexplode(F.arrays_zip("self", "other")).alias("hour", "c"))
    return cells.groupBy("chat_id", *keys, "hour").agg(F.sum("c.self").alias("self"), F.sum("c.other").alias("other"))


def _weekday() -> Column:
    return F.pmod(F.col("day") + 3, F.lit(7)).cast("int")


def hourly_distribution(states: dict[str, DataFrame]) -> DataFrame:
    return _by_hour(states)


def weekday_distribution(states: dict[str, DataFrame]) -> DataFrame:
    cells = [F.struct(F.coalesce(F.sum(F.when(_weekday() == d, _all("self"))), F.lit(0)).alias("self"), F.coalesce(F.sum(F.when(_weekday() == d, _all("other"))), F.lit(0)).alias("other")) for d in range(7)]
    rows = states["days"].groupBy("chat_id").agg(F.array(*cells).alias("cells"))
    return rows.select("chat_id", F.posexplode("cells").alias("weekday", "c")).select("chat_id", "weekday", "c.self", "c.other", C.weekday_name(F.col("weekday")).alias("weekday_name"))


def heatmap(states: dict[str, DataFrame]) -> DataFrame:
    return _by_hour(states, "weekday").select("chat_id", "weekday", "hour", (F.col("self") + F.col("other")).alias("count")).where("count > 0")


def length_stats(states: dict[str, DataFrame], rounding: str = "exact") -> DataFrame:
    lengths = states["lengths"]
    who = Window.partitionBy("chat_id", "is_self")
    cum = F.sum("count").over(who.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    rows = lengths.withColumn("half", F.when(cum * 2 >= F.sum("count").over(who), F.col("n")))
    of_person = lambda own: F.struct(
        F.lit("self" if own else "other").alias("person"),
        C.round1(F.coalesce(F.sum(F.when(F.col("is_self") == own, F.col("n") * F.col("count"))).cast("double") / F.sum(F.when(F.col("is_self") == own, F.col("count"))), F.lit(0.0)), rounding).alias("avg"),
        F.coalesce(F.max(F.when(F.col("is_self") == own, F.col("n"))), F.lit(0)).alias("max"),
        F.coalesce(F.min(F.when(F.col("is_self") == own, F.col("n"))), F.lit(0)).alias("min"),
        F.coalesce(F.max(F.when(F.col("is_self") == own, F.col("half"))), F.lit(0)).cast("int").alias("median"),
        F.coalesce(F.sum(F.when(F.col("is_self") == own, F.col("count"))), F.lit(0)).alias("total"),
    )
    return rows.groupBy("chat_id").agg(F.array(of_person(True), of_person(False)).alias("p")).select("chat_id", F.inline("p"))


def face_ranking(states: dict[str, DataFrame], top: int = 20) -> DataFrame:
    return content.ranked(states["faces"], top)


def word_ranking(states: dict[str, DataFrame], top: int = 50) -> DataFrame:
    return content.ranked(states["words"], top)


def months_of_text(states: dict[str, DataFrame]) -> DataFrame:
    return states["months"].groupBy("chat_id").agg(F.count("month").alias("months"))


def _joined(states: dict[str, DataFrame], limit_ms: int) -> DataFrame:
    """A row a chat: gaps and rounds within segments and between them."""
    rows = states["days"].withColumn("__key", F.concat(F.when(F.col("chat_id").isNull(), "-").otherwise("+"), F.coalesce("chat_id", F.lit(""))))
    before = F.lag("last").over(Window.partitionBy("__key").orderBy(F.col("first.ts_ms"), F.col("first.seq")))
    rows = rows.withColumn("__before", before)
    gap, own = F.col("first.ts_ms") - F.col("__before.ts_ms"), F.col("first.is_self")
    near = gap <= limit_ms
    add = {"self": F.coalesce(F.when(own & near, gap), F.lit(0)), "other": F.coalesce(F.when(~own & near, gap), F.lit(0))}
    one = {"self": F.coalesce((own & near).cast("long"), F.lit(0)), "other": F.coalesce((~own & near).cast("long"), F.lit(0))}
    sums = [F.sum(F.col(f"{p}_gap") + add[p]).alias(f"{p}_gap") for p in add] + [F.sum(F.col(f"{p}_gaps") + one[p]).alias(f"{p}_gaps") for p in one]
    opens = (F.col("first.sender_uid") != F.coalesce(F.col("__before.sender_uid"), F.lit(""))).cast("long")
    return rows.groupBy("chat_id").agg(
        *sums,
        F.sum(F.col("turns") + F.coalesce(opens, F.lit(0))).alias("exchange_rounds"),
        F.sum(_all("self")).alias("self_count"),
        F.sum(_all("other")).alias("other_count"),
        *[F.sum(c).alias(a) for c, a in (("self_chars", "self_chars"), ("other_chars", "other_chars"), ("images", "total_images"), ("faces", "total_faces"))],
        F.countDistinct("day").alias("active_days"),
    )


def response_times(states: dict[str, DataFrame], limit_ms: int = activity.REPLY_MS, rounding: str = "exact") -> DataFrame:
    mean = lambda p: C.round1(F.coalesce(F.try_divide(F.col(f"{p}_gap").cast("double"), F.col(f"{p}_gaps") * F.lit(1000)), F.lit(0.0)), rounding).alias(f"{p}_avg_seconds")
    return _joined(states, limit_ms).select("chat_id", mean("self"), mean("other"))


def exchange_rounds(states: dict[str, DataFrame]) -> DataFrame:
    return _joined(states, activity.REPLY_MS).select("chat_id", F.col("exchange_rounds").alias("rounds"))


def overview(states: dict[str, DataFrame], chats: DataFrame | None = None, rounding: str = "exact") -> DataFrame:
    """activity.overview() of all batches."""
    counts = _joined(states, activity.REPLY_MS).drop("self_gap", "self_gaps", "other_gap", "other_gaps").withColumn("total_messages", F.col("self_count") + F.col("other_count"))
    return activity.overview_of(counts, chats, rounding)
