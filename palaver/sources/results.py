"""Stored results: Parquet by name, rows as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store(metrics: dict[str, DataFrame], path: str) -> None:
    for name, df in metrics.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, name: str, chat_id: str | None = None) -> DataFrame:
    """A stored result; of one chat, the filter reaches the scan."""
    df = spark.read.parquet(f"{path}/{name}")
    return df if chat_id is None else df.where(F.col("chat_id") == chat_id)


def store_by_chat(df: DataFrame, path: str, files: int) -> None:
    """Rows in about so many files, each of a range of chats, and beside them an index of the ranges.

    A chat with more rows than a file holds is spread over several: equal chats are parted by hash.
    """
    spread = F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))])
    rows = df.withColumn("__spread", spread).repartitionByRange(files, "chat_id", "__spread").sortWithinPartitions("chat_id").drop("__spread")
    rows.write.mode("overwrite").parquet(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0)
    index = df.sparkSession.read.parquet(path).select("chat_id", name.alias("file")).groupBy("file").agg(F.min("chat_id").alias("least"), F.max("chat_id").alias("most"), F.count_if(F.col("chat_id").isNull()).alias("nulls"))
    index.repartitionByRange(max(1, files // 10_000), "least").write.mode("overwrite").parquet(f"{path}_index")


def load_chat(spark: SparkSession, path: str, chat_id: str | None) -> DataFrame:
    """The rows of one chat, or of none, from those files alone that hold any of it."""
    index = spark.read.parquet(f"{path}_index")
    holds = F.col("nulls") > 0 if chat_id is None else (F.col("least") <= chat_id) & (F.col("most") >= chat_id)
    files = [f"{path}/{r.file}" for r in index.where(holds).select("file").collect()]
    rows = spark.read.schema(spark.read.parquet(path).schema)
    return (rows.parquet(*files) if files else spark.createDataFrame([], spark.read.parquet(path).schema)).where(F.col("chat_id").eqNullSafe(F.lit(chat_id)))


def as_json(df: DataFrame) -> DataFrame:
    """chat_id and the row as a JSON object."""
    return df.select("chat_id", F.to_json(F.struct(*df.columns)).alias("json"))
