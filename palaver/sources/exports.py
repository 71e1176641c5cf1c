"""Chat exports to chats, messages and rejected files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.columns import strip
from palaver.schema import EXPORT

#: The name of a peer that the export does not name.
PEER = "peer"


@dataclass
class Exports:
    raw: DataFrame
    chats: DataFrame
    messages: DataFrame
    rejects: DataFrame
    skip_marked: bool = False


def ingest(spark: SparkSession, path: str, strict: bool = False, max_bytes: int | None = None, skip_marked: bool = False) -> Exports:
    """Every .json export of a folder.

    A file that is no JSON, lacks chatInfo or messages, or is larger than max_bytes (no limit, unless given) is in rejects;
    with strict, reading messages raises for it instead. A JSON null counts as missing. skip_marked
    leaves recalled and system messages out.
    """
    raw = spark.read.schema(EXPORT).option("multiLine", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    raw = raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("chat_id"), F.col("_metadata.file_size").alias("bytes"), "*")
    reason = F.when(F.col("_corrupt_record").isNotNull(), "unparseable").when(F.col("chatInfo").isNull() | F.col("messages").isNull(), "invalid format")
    if max_bytes is not None:
        reason = F.when(F.col("bytes") > max_bytes, "too large").otherwise(reason)
    raw = raw.withColumn("reason", reason)
    rejects = raw.where("reason is not null").select("chat_id", "bytes", "reason")
    good = raw.withColumn("ok", F.when(F.col("reason").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.col("chat_id"), F.lit(": "), F.col("reason"))) if strict else F.lit(False))).where("ok")
    return Exports(raw, _chats(good), _messages(good, skip_marked), rejects, skip_marked)


def _elements(kind: str) -> Column:
    return F.filter(F.coalesce(F.col("m.content.elements"), F.expr("cast(array() as array<struct<type:string,data:variant>>)")), lambda e: e["type"] == kind)


def _messages(good: DataFrame, skip_marked: bool) -> DataFrame:
    rows = good.select("chat_id", F.coalesce("chatInfo.selfUid", F.lit("")).alias("self_uid"), F.posexplode("messages").alias("seq", "m"))
    return message_columns(rows, skip_marked)


def message_columns(rows: DataFrame, skip_marked: bool) -> DataFrame:
    """messages from chat_id, self_uid, seq and m, a message as it was exported."""
    if skip_marked:
        rows = rows.where("not coalesce(m.recalled, false) and not coalesce(m.system, false)")
    uid = F.coalesce("m.sender.uid", F.lit(""))
    text = F.array_join(F.transform(_elements("text"), lambda e: F.coalesce(F.try_variant_get(e["data"], "$.text", "string"), F.lit(""))), "")
    ids = F.expr("filter(transform(faces, e -> case when schema_of_variant(variant_get(e.data, '$.id')) = 'VOID' then null when variant_get(e.data, '$.id') is null then 0 else try_variant_get(e.data, '$.id', 'int') end), x -> x is not null)")
    names = F.filter(F.transform("faces", lambda e: F.try_variant_get(e["data"], "$.name", "string")), lambda x: x != "")
    return rows.withColumn("faces", _elements("face")).select(
        "chat_id",
        F.col("seq").cast("long").alias("seq"),
        F.coalesce("m.id", F.lit("")).alias("id"),
        F.coalesce("m.timestamp", F.lit(0)).cast("long").alias("ts_ms"),
        F.coalesce("m.time", F.lit("")).alias("time_str"),
        F.coalesce(F.nullif("m.sender.name", F.lit("")), "m.sender.nickname", F.lit("")).alias("sender_name"),
        uid.alias("sender_uid"),
        (uid == F.col("self_uid")).alias("is_self"),
        strip(text).alias("text"),
        F.coalesce("m.content.text", F.lit("")).alias("raw_text"),
        F.coalesce("m.type", F.lit("")).alias("msg_type"),
        (F.size(_elements("image")) > 0).alias("has_image"),
        (F.size(_elements("reply")) > 0).alias("is_reply"),
        ids.alias("face_ids"),
        names.alias("face_names"),
    )


def _chats(good: DataFrame) -> DataFrame:
    """Header facts. All of a chat is in its one row, so nothing is shuffled for them."""
    uids = F.filter(F.transform("messages", lambda m: F.coalesce(m["sender"]["uid"], F.lit(""))), lambda u: (u != "") & (u != F.coalesce(F.col("chatInfo.selfUid"), F.lit(""))))
    return chat_columns(good, F.coalesce(F.get(uids, F.lit(0)), F.lit("")), F.size("messages").cast("long"))


def chat_columns(good: DataFrame, other_uid: Column, count: Column) -> DataFrame:
    """chats from chat_id and a head, the first other sender and the number of messages."""
    others = F.filter("statistics.senders", lambda s: ~s["uid"].eqNullSafe(F.coalesce(F.col("chatInfo.selfUid"), F.lit(""))) & (s["name"] != ""))
    return good.select(
        "chat_id",
        F.coalesce("chatInfo.name", F.lit("")).alias("chat_name"),
        F.coalesce("chatInfo.selfName", F.lit("")).alias("self_name"),
        F.coalesce(F.get(F.transform(others, lambda s: s["name"]), F.lit(0)), "chatInfo.name", F.lit(PEER)).alias("other_name"),
        F.coalesce("chatInfo.selfUid", F.lit("")).alias("self_uid"),
        other_uid.alias("other_uid"),
        F.coalesce("statistics.totalMessages", count).alias("total_count"),
        F.coalesce("statistics.timeRange.start", F.lit("")).alias("time_start"),
        F.coalesce("statistics.timeRange.end", F.lit("")).alias("time_end"),
        F.coalesce("statistics.timeRange.durationDays", F.lit(0)).alias("duration_days"),
    )


def land(exports: Exports, path: str) -> None:
    """Parquet tables of an ingest, so that nothing reads the JSON again.

    The JSON is parsed once, into the table exports; the others are written from that.
    """
    exports.raw.write.mode("overwrite").parquet(f"{path}/exports")
    staged = exports.raw.sparkSession.read.schema(exports.raw.schema).parquet(f"{path}/exports")
    good = staged.where("reason is null")
    _chats(good).write.mode("overwrite").parquet(f"{path}/chats")
    _messages(good, exports.skip_marked).write.mode("overwrite").parquet(f"{path}/messages")
    staged.where("reason is not null").select("chat_id", "bytes", "reason").write.mode("overwrite").parquet(f"{path}/rejects")
