"""Several exports of one chat: their messages joined, each once, in one order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import columns as C


def _keyed(messages: DataFrame, side: str) -> DataFrame:
    """A row a message of an export, with what tells it from others.

    That is its id. Of rows with one id the last stays. Without an id it is the time, the sender and the
    text, and of rows alike in all three which one it is, counted in order.
    """
    has_id = F.coalesce("id", F.lit("")) != ""
    same = F.when(has_id, F.concat(F.lit("#"), "id")).otherwise(F.concat_ws("\x00", F.lit("="), F.coalesce("ts_ms", F.lit(0)).cast("string"), F.coalesce("sender_uid", F.lit("")), F.coalesce("text", F.lit(""))))
    chat = F.concat(F.when(F.col("chat_id").isNull(), "-").otherwise("+"), F.coalesce("chat_id", F.lit("")))
    rows = messages.withColumn("__chat", chat).withColumn("__same", F.sha2(same, 256)).withColumn("__has_id", has_id)
    like = Window.partitionBy("__chat", "__same")
    last = F.row_number().over(like.orderBy(F.desc("seq")))
    nth = F.when(F.col("__has_id"), 0).otherwise(F.row_number().over(like.orderBy("seq")))
    rows = rows.withColumn("__last", last).withColumn("__nth", nth).where("not __has_id or __last = 1")
    return rows.select("__chat", "__same", "__nth", F.struct(*messages.columns).alias(side))


def joined(old: DataFrame, new: DataFrame, tz: str = C.TZ) -> DataFrame:
    """The messages of both exports, as those of one, with origin (old, new or both) and edited.

    A message that both have is that of the new export; edited tells that its text differs. seq is
    new, from 0: by time, and within a time in the order of the old export, before what only the new
    one has, in its own order. It is a place within a day after the days before, so no task has a
    whole chat. Both need the same columns; chats that one export lacks are the other's.
    """
    columns = [c for c in new.columns if c != "seq"]
    both = _keyed(old, "old").join(_keyed(new, "new"), ["__chat", "__same", "__nth"], "full_outer")
    in_old, in_new = F.col("old").isNotNull(), F.col("new").isNotNull()
    rows = both.select("__chat", F.coalesce("new", "old").alias("m"), F.col("old.seq").alias("__old"), F.col("new.seq").alias("__new"), F.when(in_old & in_new, "both").when(in_old, "old").otherwise("new").alias("origin"), (in_old & in_new & ~F.col("old.text").eqNullSafe(F.col("new.text"))).alias("edited"))
    rows = rows.withColumn("__ts", F.coalesce("m.ts_ms", F.lit(0))).withColumn("__day", C.day_number(F.col("__ts"), tz))
    days = rows.groupBy("__chat", "__day").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__chat").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("__chat", "__day", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__chat", "__day").orderBy("__ts", F.asc_nulls_last("__old"), "__new")) - 1
    rows = rows.withColumn("__place", place).join(days, ["__chat", "__day"])
    return rows.select(*[F.col(f"m.{c}").alias(c) for c in columns], (F.col("__before") + F.col("__place")).cast("long").alias("seq"), "origin", "edited")
