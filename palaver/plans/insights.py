"""Language-model analyses: prompts from dialogs, calls through a provider, answers as structs.

A provider is any picklable object with ``complete(system, user) -> str`` (a JSON object as text, or
an empty text for no answer). Calls run in tasks, a row each; how many run at once is the number of
partitions.
"""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions import columns as C
from palaver.operators import activity, content
from palaver.plans import answers
from palaver.schema import CONTRACTS, MONTHLY, PERSONAL

log = logging.getLogger(__name__)
HABIT_MESSAGES, PROFILE_MESSAGES = 200, 300
PLACEHOLDER_KEYS = ("", "changeme", "your-api-key")
TASKS = {
    "emotion": "Name the main feeling of each side in this month, how strong it is from 1 to 10, and words that show it, and the tone of both together.",
    "topics": "List what this month's talk is about, with weights that add up to 1 at most, a summary, and whether the subjects changed.",
    "relationship": "Judge who starts talks, how the two treat each other, how close they are from 1 to 10, their roles and their support.",
    "habits": "Describe how this person writes: traits, favourite phrases and signs, sentence length, speed and jumps between subjects.",
    "profile": "Draw a portrait of this person from the messages: impression, character, style, feelings, wit, relations, growth and scores.",
}


class Provider(Protocol):
    def complete(self, system: str, user: str) -> str: ...


@dataclass
class OfflineProvider:
    """Answers that fit the contracts and follow from the prompt's length; no network."""

    def complete(self, system: str, user: str) -> str:
        dimension = system.split(":", 1)[0]
        n = len(user)
        mood = ["joy", "calm", "worry", "anger"]
        answers = {
            "emotion": {"self_emotion": mood[n % 4], "self_intensity": n % 10 + 1, "self_keywords": ["a"], "other_emotion": mood[n // 4 % 4], "other_intensity": n // 16 % 10 + 1, "other_keywords": ["b"], "overall_tone": "neutral"},
            "topics": {"topics": [{"name": f"topic{n % 3}", "weight": 0.6, "keywords": ["a"]}, {"name": "other", "weight": 0.4, "keywords": []}], "summary": "s", "topic_shift_detected": bool(n % 2), "shift_description": ""},
            "relationship": {"initiator_tendency": "balanced", "initiator_ratio_self": 0.5, "closeness_score": n % 10 + 1, "relationship_summary": "s"},
            "habits": {"personality_tags": ["brief"], "common_phrases": [], "sentence_length": "short"},
            "profile": {"name": "?", "overall_impression": "i", "fun_facts": ["1", "2", "3", "4"], "scoring": {"humour": str(n % 10)}, "growth_observation": {"has_changed": False}},
        }
        return json.dumps(answers[dimension])


@dataclass
class HttpProvider:
    """An OpenAI-compatible chat endpoint in JSON mode; settings from the session or the environment."""

    url: str
    key: str
    model: str
    temperature: float = 0.3
    max_tokens: int = 2048
    timeout: float = 120.0

    @classmethod
    def from_settings(cls, spark: SparkSession) -> HttpProvider:
        of = lambda name, default="": spark.conf.get(f"spark.palaver.{name}", None) or os.environ.get(f"PALAVER_{name.upper()}", default)
        return cls(of("url"), of("key"), of("model"))

    def is_configured(self) -> bool:
        return bool(self.url) and self.key not in PLACEHOLDER_KEYS

    def complete(self, system: str, user: str) -> str:
        if not self.is_configured():
            return ""
        from urllib.request import Request, urlopen

        body = {"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]


def attempt(provider: Provider, system: str, user: str, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer of at most retries + 1 calls, 1, 2, 4 ... seconds apart; the last failure is raised."""
    for k in range(retries + 1):
        try:
            return provider.complete(system, user)
        except Exception:
            log.warning("call %d of %d failed", k + 1, retries + 1, exc_info=True)
            if k == retries:
                raise
            sleep(2**k)
    raise AssertionError


def system_prompt(dimension: str) -> str:
    return f"{dimension}: {TASKS[dimension]} Answer with one JSON object of this form and nothing else: {CONTRACTS[dimension]}"


def merge_prompt(dimension: str) -> str:
    return f"{dimension}: You get answers to parts of one month's talk, in order. Join them into one answer for the whole month. The parts were asked this: {TASKS[dimension]} Answer with one JSON object of this form and nothing else: {CONTRACTS[dimension]}"


def prompts(dimension: str, messages: DataFrame, chats: DataFrame, tz: str = C.TZ, budget: int | None = None) -> DataFrame:
    """chat_id, period (month or person), part, user: one row for each call.

    With a budget, a month whose dialog has more bytes of UTF-8 has several parts.
    """
    if dimension in MONTHLY:
        rows = content.dialogs(messages, chats, tz).withColumn("part", F.lit(0)) if budget is None else content.dialog_parts(messages, chats, budget, tz)
        return rows.select("chat_id", F.col("month").alias("period"), "part", F.concat(F.lit("Month "), "month", F.lit("\n"), "dialog").alias("user"))
    if dimension in PERSONAL:
        n, keep = (HABIT_MESSAGES, True) if dimension == "habits" else (PROFILE_MESSAGES, False)
        rows = content.utterances(messages, n, keep)
        names = chats.select(F.col("chat_id").alias("__chat"), "self_name", "other_name")
        name = F.coalesce(F.when(F.col("person") == "self", F.col("self_name")).otherwise(F.col("other_name")), F.lit(""))
        rows = rows.join(names, F.col("chat_id").eqNullSafe(F.col("__chat")), "left")
        return rows.select("chat_id", F.col("person").alias("period"), F.lit(0).alias("part"), F.concat(F.lit("Messages of "), name, F.lit("\n"), "utterances").alias("user"))
    raise ValueError(f"no such dimension: {dimension}")


def _calls(provider: Provider, system: str, retries: int, fail_fast: bool, sleep: Callable[[float], None]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said, errors = [], []
            for user in pdf.user:
                answer, error = None, None
                try:
                    answer = attempt(provider, system, user, retries, sleep) or None
                except Exception as e:
                    if fail_fast:
                        raise
                    error = f"{type(e).__name__}: {e}"
                said.append(answer)
                errors.append(error)
            yield pdf[["chat_id", "period", "part"]].assign(answer=said, error=errors)

    return run


def _answered(asked: DataFrame, system: str, provider: Provider, retries: int, fail_fast: bool, tasks: int | None, sleep: Callable[[float], None], store: str | None, rate: float | None) -> DataFrame:
    """chat_id, period, part, answer, error of asked: from calls, or from the table of answers after asking what it lacks."""
    if store is None:
        if tasks:
            asked = asked.repartition(tasks)
        return asked.mapInPandas(_calls(provider, system, retries, fail_fast, sleep), "chat_id string, period string, part int, answer string, error string")
    asked = asked.withColumn("key", answers.key_of(provider, system, F.col("user")))
    answers.ask_missing(asked.select("key", "user"), store, lambda user, wait: attempt(provider, system, user, retries, lambda s: sleep(max(s, wait))), lanes=tasks, rate=rate, stop_on_error=fail_fast)
    return asked.join(answers.known(asked.sparkSession, store), "key").select("chat_id", "period", "part", "answer", "error")


def _merged(rows: DataFrame, parts: int, dimension: str, fan_in: int, ask: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """One answer a period of those to its parts, fan_in neighbours at a time, level by level.

    A part without an answer is left out; an error of a part is one of its period, which is not
    merged. A group with one answer keeps it without another call.
    """
    while parts > 1:
        parts = -(-parts // fan_in)
        groups = rows.groupBy("chat_id", "period", F.floor(F.col("part") / fan_in).cast("int").alias("part")).agg(
            F.expr("listagg(answer, '\n') within group (order by part)").alias("user"), F.count("answer").alias("n"), F.min("error").alias("error")
        )
        several = (F.col("n") > 1) & F.col("error").isNull()
        alone = groups.where(~several).select("chat_id", "period", "part", F.when(F.col("error").isNull(), F.col("user")).alias("answer"), "error")
        head = F.concat(F.lit("Month "), "period", F.lit("\n"))
        rows = alone.unionByName(ask(groups.where(several).select("chat_id", "period", "part", F.concat(head, "user").alias("user")), merge_prompt(dimension)))
    return rows


def analyze(dimension: str, messages: DataFrame, chats: DataFrame, provider: Provider, retries: int = 2, fail_fast: bool = False, tasks: int | None = None, tz: str = C.TZ, sleep: Callable[[float], None] = time.sleep, budget: int | None = None, fan_in: int = 8, store: str | None = None, rate: float | None = None) -> DataFrame:
    """chat_id, the period, result (a struct) and error.

    Monthly dimensions have period and month; personal ones person, name (the chat's, over the
    model's) and total_messages. Calls without an answer give no row. A failed call gives a row with
    its error and no result; with fail_fast it fails the job. An unknown dimension, or a provider that
    says that it is not configured, raises at once.

    With a budget (bytes), longer months are asked in parts, and the parts' answers merged by further
    calls, fan_in at a time. With store, the folder of a table of answers, calls are made at once, what
    the table holds is not asked again, and rate bounds the calls a second; see plans/answers.py.
    """
    if not getattr(provider, "is_configured", lambda: True)():
        raise ValueError("the provider has no address or key")
    asked = prompts(dimension, messages, chats, tz, budget)
    ask = lambda rows, system: _answered(rows, system, provider, retries, fail_fast, tasks, sleep, store, rate)
    rows = ask(asked, system_prompt(dimension))
    if budget is not None and dimension in MONTHLY:
        rows = _merged(rows, (asked.agg(F.max("part")).first()[0] or 0) + 1, dimension, fan_in, ask)
    rows = rows.where("answer is not null or error is not null")
    rows = rows.withColumn("result", F.from_json("answer", CONTRACTS[dimension])).where("result is not null or error is not null")
    if dimension in MONTHLY:
        return rows.select("chat_id", "period", F.col("period").alias("month"), "result", "error")
    totals = activity.person_totals(messages).select(F.col("chat_id").alias("__chat"), F.col("person").alias("__person"), "total_messages")
    names = chats.select(F.col("chat_id").alias("__named"), "self_name", "other_name")
    rows = rows.join(totals, F.col("chat_id").eqNullSafe(F.col("__chat")) & (F.col("period") == F.col("__person")), "left").join(names, F.col("chat_id").eqNullSafe(F.col("__named")), "left")
    name = F.when(F.col("period") == "self", F.col("self_name")).otherwise(F.col("other_name"))
    result = F.when(F.col("result").isNotNull(), F.col("result").withField("name", name)) if dimension == "profile" else F.col("result")
    return rows.select("chat_id", F.col("period").alias("person"), name.alias("name"), "total_messages", result.alias("result"), "error")


def analyze_all(messages: DataFrame, chats: DataFrame, provider: Provider, **options) -> DataFrame:
    """chat_id, dimension, period, result as JSON, error, of all dimensions."""
    out = None
    for dimension in CONTRACTS:
        rows = analyze(dimension, messages, chats, provider, **options)
        period = "period" if dimension in MONTHLY else "person"
        rows = rows.select("chat_id", F.lit(dimension).alias("dimension"), F.col(period).alias("period"), F.to_json("result").alias("result"), "error")
        out = rows if out is None else out.unionByName(rows)
    return out


# What is made of the answers.


def emotion_histogram(emotions: DataFrame) -> DataFrame:
    """chat_id, person, emotion, months."""
    pairs = F.array(F.struct(F.lit("self").alias("person"), F.col("result.self_emotion").alias("emotion")), F.struct(F.lit("other").alias("person"), F.col("result.other_emotion").alias("emotion")))
    return emotions.select("chat_id", F.inline(pairs)).where("emotion is not null").groupBy("chat_id", "person", "emotion").agg(F.count("*").alias("months"))


def topic_weights(topics: DataFrame) -> DataFrame:
    """chat_id, name, value: the weight of each topic over all months in whole percent, largest first by rank."""
    sums = topics.select("chat_id", F.inline("result.topics")).groupBy("chat_id", "name").agg(F.sum("weight").alias("w"))
    rows = sums.select("chat_id", "name", C.percent_half_up(F.col("w")).alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("value"), "name")))


def result_count(results: DataFrame) -> DataFrame:
    return results.groupBy("chat_id").agg(F.count("*").alias("entries"))


def fun_facts(profiles: DataFrame, n: int = 3) -> DataFrame:
    return profiles.select("chat_id", "person", F.slice("result.fun_facts", 1, n).alias("fun_facts"))
