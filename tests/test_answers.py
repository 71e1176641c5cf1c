import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from palaver.operators import content
from palaver.plans import answers, insights
from palaver.sources import exports
from tests.test_golden import GOLDEN, rows


class Counting:
    """Answers like the offline provider and leaves a file for each call."""

    model = "counted"

    def __init__(self, folder, fails="", dies=""):
        self.folder, self.fails, self.dies = str(folder), fails, dies
        os.makedirs(self.folder, exist_ok=True)

    def complete(self, system, user):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(user)
        if self.fails and self.fails in user:
            raise OSError("down")
        if self.dies and self.dies in user:
            os._exit(1)
        return insights.OfflineProvider().complete(system, user)

    def calls(self):
        return [open(f"{self.folder}/{x}").read() for x in os.listdir(self.folder)]


@pytest.fixture(scope="module")
def chat(spark, tmp_path_factory):
    import json

    d = tmp_path_factory.mktemp("exports")
    for k in range(12):
        (d / f"chat{k}.json").write_text(json.dumps(GOLDEN | {"chatInfo": {"name": f"peer{k}", "selfUid": "u1", "selfName": f"me{k}"}}), encoding="utf-8")
    x = exports.ingest(spark, str(d))
    m, c = tmp_path_factory.mktemp("m"), tmp_path_factory.mktemp("c")
    x.messages.write.mode("overwrite").parquet(str(m))
    x.chats.write.mode("overwrite").parquet(str(c))
    return spark.read.parquet(str(m)), spark.read.parquet(str(c))


def plain(df):
    return sorted((tuple(map(str, r)) for r in df.collect()), key=repr)


def test_a_second_run_asks_nothing(spark, chat, tmp_path):
    provider, store = Counting(tmp_path / "calls"), f"{tmp_path}/answers"
    first = insights.analyze("emotion", *chat, provider, store=store, tasks=3)
    assert plain(first) == plain(insights.analyze("emotion", *chat, insights.OfflineProvider()))
    n = len(provider.calls())
    assert n == 24 == first.count()
    assert plain(insights.analyze("emotion", *chat, provider, store=store)) == plain(first) and len(provider.calls()) == n
    insights.analyze("topics", *chat, provider, store=store).collect()
    assert len(provider.calls()) == 2 * n
    provider.model = "another"
    insights.analyze("emotion", *chat, provider, store=store).collect()
    assert len(provider.calls()) == 3 * n


def test_a_lost_worker_costs_its_own_calls_alone(spark, chat, tmp_path):
    store = f"{tmp_path}/answers"
    failing = Counting(tmp_path / "calls", dies="me7: forward")
    with pytest.raises(Exception, match=r"exited|crashed|EOF"):
        insights.analyze("emotion", *chat, failing, store=store, tasks=24)
    asked, kept = failing.calls(), answers.known(spark, store).where("answered").count()
    assert 0 < kept
    healed = Counting(tmp_path / "calls")
    found = insights.analyze("emotion", *chat, healed, store=store, tasks=24)
    again = healed.calls()
    assert len(again) - len(asked) == 24 - kept and plain(found) == plain(insights.analyze("emotion", *chat, insights.OfflineProvider()))


def test_errors_are_rows_and_asked_again(spark, chat, tmp_path):
    store = f"{tmp_path}/answers"
    down = Counting(tmp_path / "calls", fails="me3")
    found = insights.analyze("emotion", *chat, down, retries=0, store=store).collect()
    assert len(found) == 24 and {r.chat_id for r in found if r.error} == {"chat3"} and all(r.result is None for r in found if r.error)
    assert len(down.calls()) == 24
    up = Counting(tmp_path / "more")
    found = insights.analyze("emotion", *chat, up, retries=0, store=store).collect()
    assert len(up.calls()) == 2 and all(r.result and not r.error for r in found)
    with pytest.raises(RuntimeError, match="down"):
        insights.analyze("topics", *chat, down, retries=0, store=store, fail_fast=True)


def test_prompts_alike_are_asked_once(spark, tmp_path):
    df = spark.createDataFrame([("k", "same")] * 50 + [("l", "other"), (None, "no key")], "key string, user string").repartition(5)
    provider = Counting(tmp_path / "calls")
    assert answers.ask_missing(df, f"{tmp_path}/a", lambda user, wait: provider.complete("emotion:", user), lanes=2) == 2
    assert sorted(provider.calls()) == ["other", "same"]
    assert answers.ask_missing(df.limit(0), f"{tmp_path}/b", lambda user, wait: "", lanes=2) == 0 and answers.known(spark, f"{tmp_path}/b").count() == 0


def test_the_rate_bounds_all_lanes_together(spark, tmp_path):
    df = spark.range(24).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("user"))
    begun = time.time()
    answers.ask_missing(df, f"{tmp_path}/a", lambda user, wait: "{}", lanes=4, per_task=6, rate=12.0)
    at = sorted(r.asked_ms for r in spark.read.schema(answers.SCHEMA).parquet(f"{tmp_path}/a/wave-*").collect())
    assert len(at) == 24 and time.time() - begun > 1
    # In no second more calls than the rate, and one of each lane.
    assert max(sum(t <= x < t + 1000 for x in at) for t in at) <= 12 + 4


def talk(spark, n=300):
    said = lambda i: ["", "short", "漢字" * (i % 50), "x" * (i % 211), "😀\n" * (i % 9)][i % 5]
    data = [("c" if i % 3 else None, i, i * 20_000_000, f"t{i}", i % 2 == 0, said(i)) for i in range(n)]
    data += [("c", 7, 7 * 20_000_000, "t7", True, "tied"), ("c", n, 0, None, True, "no time"), ("c", n + 1, 0, "t", True, None)]
    chats = spark.createDataFrame([("c", "me", "you"), (None, "me", None)], "chat_id string, self_name string, other_name string")
    return spark.createDataFrame(data, "chat_id string, seq long, ts_ms long, time_str string, is_self boolean, text string").repartition(4), chats


@pytest.mark.parametrize("budget", [16, 100, 1_000, 10**6])
def test_parts_fit_the_budget_and_give_the_dialog(spark, budget):
    m, chats = talk(spark)
    m = m.where("text <> 'tied' or text is null")
    parts = content.dialog_parts(m, chats, budget).collect()
    assert all(0 < len(r.dialog.encode()) <= budget for r in parts)
    joined = {}
    for r in sorted(parts, key=lambda r: r.part):
        joined.setdefault((r.chat_id, r.month), []).append(r)
    assert all([r.part for r in rs] == list(range(len(rs))) for rs in joined.values())
    want = {(r.chat_id, r.month): r.dialog for r in content.dialogs(m, chats).collect()}
    assert {k: "".join(r.dialog for r in rs) for k, rs in joined.items()} == want


def test_parts_of_tied_and_no_messages(spark):
    m, chats = talk(spark)
    whole = "".join(r.dialog for r in content.dialog_parts(m, chats, 10**6).where("chat_id = 'c' and month = '1970-01'").collect())
    assert whole.count("tied") == 1 and not whole.endswith("\n")
    assert content.dialog_parts(m.limit(0), chats, 64).count() == 0
    with pytest.raises(ValueError, match="budget"):
        content.dialog_parts(m, chats, 15)


def test_answers_of_parts_are_merged_in_order(spark, tmp_path):
    m, chats = talk(spark)
    provider = Counting(tmp_path / "calls")
    parts = content.dialog_parts(m, chats, 700)
    months = {(r.chat_id, r.month): r.n for r in parts.groupBy("chat_id", "month").agg(F.count("*").alias("n")).collect()}
    found = insights.analyze("topics", m, chats, provider, budget=700, fan_in=3, store=f"{tmp_path}/a")
    assert rows(found, "chat_id", "month") == sorted(months, key=repr)
    expected = 0
    for n in months.values():
        expected += n
        while n > 1:
            expected += n // 3 + (n % 3 > 1)
            n = -(-n // 3)
    assert len(provider.calls()) <= expected and max(len(c.encode()) for c in provider.calls()) < 1_000
    lazily = insights.analyze("topics", m, chats, insights.OfflineProvider(), budget=700, fan_in=3)
    assert plain(lazily) == plain(found)
    down = Counting(tmp_path / "down", fails="😀")
    bad = insights.analyze("topics", m, chats, down, retries=0, budget=700, fan_in=3).collect()
    assert any(r.error for r in bad) and all(r.result is None for r in bad if r.error)
