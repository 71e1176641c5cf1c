"""Answers that are paid for once: a table of them, keyed by what was asked.

Prompts whose key the table holds are not asked again. The others are dealt to lanes, each a task that
asks one prompt after the other; a task's answers are in the table as soon as it ends, even if the job
fails later, and no wave of tasks has more than ``lanes`` times ``per_task`` prompts. So a lost executor
costs its own task's calls alone, and a second run asks only what is left.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.sources import folders

SCHEMA = "key string, answered boolean, answer string, error string, asked_ms long"


def key_of(provider: object, system: str, user: Column) -> Column:
    """The sha256 of the model, the instructions and the prompt."""
    model = str(getattr(provider, "model", type(provider).__name__))
    return F.sha2(F.concat_ws("\x00", F.lit(model), F.lit(system), F.coalesce(user, F.lit(""))), 256)


def known(spark: SparkSession, path: str) -> DataFrame:
    """key, answered, answer, error: of what was asked more than once the answer, or else the last error."""
    if not folders.exists(spark, f"{path}/wave-*"):
        return spark.createDataFrame([], SCHEMA).drop("asked_ms")
    # A folder a wave: Spark takes two scans of equal folders for the same, whatever was added between.
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/wave-*")
    last = F.max_by(F.struct("answered", "answer", "error"), F.struct("answered", "asked_ms"))
    return rows.groupBy("key").agg(last.alias("r")).select("key", "r.*")


def _lane(ask: Callable[[str, float], str], wait: float, sleep: Callable[[float], None], clock: Callable[[], float]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = 0.0
        for pdf in batches:
            rows = []
            for key, user in zip(pdf.key, pdf.user, strict=True):
                if wait and due > (now := clock()):
                    sleep(due - now)
                due = clock() + wait
                try:
                    rows.append((key, True, ask(user, wait) or None, None, int(clock() * 1000)))
                except Exception as e:
                    rows.append((key, False, None, f"{type(e).__name__}: {e}", int(clock() * 1000)))
            yield pd.DataFrame(rows, columns=["key", "answered", "answer", "error", "asked_ms"])

    return run


def ask_missing(prompts: DataFrame, path: str, ask: Callable[[str, float], str], lanes: int | None = None, per_task: int = 16, rate: float | None = None, stop_on_error: bool = False, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> int:
    """Ask what the table at path lacks of prompts (key, user); how many that were.

    ask gets a prompt and the seconds that it has to leave before it calls again by itself. rate bounds
    the calls a second of all lanes together: each of them leaves lanes / rate seconds between the
    beginnings of two calls. An error is kept as one and asked again by the next run;
    stop_on_error raises after the wave in which one occurred. Prompts without a key are not asked.
    """
    spark = prompts.sparkSession
    lanes = lanes or spark.sparkContext.defaultParallelism
    done = known(spark, path).where("answered").select("key")
    todo = prompts.where("key is not null").groupBy("key").agg(F.min("user").alias("user")).join(done, "key", "left_anti")
    waiting = folders.temporary(spark, "prompts")
    todo.write.parquet(waiting)
    todo = spark.read.schema(todo.schema).parquet(waiting)
    n = todo.count()
    waves = -(-n // (lanes * per_task))
    wave = F.pmod(F.xxhash64("key"), F.lit(max(1, waves)))
    for k in range(waves):
        rows = todo.where(wave == k).repartition(lanes, "key").mapInPandas(_lane(ask, lanes / rate if rate else 0.0, sleep, clock), SCHEMA)
        # With version 2 a task's files are moved into the table when the task ends, not the job.
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{path}/wave-{uuid.uuid4().hex}")
        if stop_on_error and (bad := known(spark, path).where("not answered").join(todo.select("key"), "key", "left_semi").select("error").first()):
            raise RuntimeError(f"a call failed: {bad.error}")
    return n
