import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palaver.functions import columns as C
from palaver.operators import activity
from palaver.plans import tracking
from tests.test_golden import rows

SCHEMA = "chat_id string, seq long, id string, ts_ms long, sender_uid string, text string"


def by_hand(old, new):
    """Every chat by plain lists."""

    def keyed(messages):
        out, times = {}, defaultdict(int)
        for m in sorted(messages, key=lambda m: m[1]):
            chat, _, id, ts, uid, text = m
            if id:
                out[chat, "#", id] = m
            else:
                same = (chat, ts, uid or "", text or "")
                times[same] += 1
                out[(*same, times[same])] = m
        return out

    a, b, found = keyed(old), keyed(new), []
    for k in a.keys() | b.keys():
        m = b.get(k) or a[k]
        origin = "both" if k in a and k in b else "old" if k in a else "new"
        order = (m[3], (0, a[k][1]) if k in a else (1, b[k][1]))
        found.append((m[0], order, (m[2], m[3], m[4], m[5]), origin, origin == "both" and a[k][5] != b[k][5]))
    out, n = [], defaultdict(int)
    for chat, _, m, origin, edited in sorted(found, key=lambda x: (repr(x[0]), x[1])):
        out.append((chat, n[chat], *m, origin, edited))
        n[chat] += 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_lists(spark, seed):
    rng = random.Random(seed)
    talk = [(rng.choice(["a", "b", None]), i, rng.choice(["", f"m{i}", f"m{i}"]), rng.randrange(40) * 9_000_000, rng.choice(["u", "v"]), rng.choice(["x", "y", ""])) for i in range(120)]
    old = [m for m in talk[:80] if rng.random() < 0.9]
    new = [(*m[:5], m[5] + "!") if rng.random() < 0.1 else m for m in talk[40:] if rng.random() < 0.9]
    renumbered = lambda ms: [(m[0], k, *m[2:]) for k, m in enumerate(ms)]
    old, new = renumbered([*old, *rng.sample(old, 8)]), renumbered([*new, *rng.sample(new, 8)])
    got = tracking.joined(spark.createDataFrame(old, SCHEMA).repartition(3), spark.createDataFrame(new, SCHEMA).repartition(2))
    assert rows(got, "chat_id", "seq", "id", "ts_ms", "sender_uid", "text", "origin", "edited") == by_hand(old, new)


def test_one_export_alone_and_none(spark):
    one = spark.createDataFrame([("a", 5, "m", 1, "u", "x"), ("a", 6, None, None, None, None)], SCHEMA)
    got = tracking.joined(one, one.limit(0))
    assert rows(got, "seq", "origin", "edited") == [(0, "old", False), (1, "old", False)] and set(got.columns) == {*one.columns, "origin", "edited"}
    assert tracking.joined(one.limit(0), one.limit(0)).count() == 0


def test_sessions_equal_a_walk(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), i, rng.choice([0, 1, 1, 1]) * rng.randrange(30 * 86_400) * 1000, rng.choice(["u", "v"])) for i in range(700)]
    data += [("long", i, i * 3_600_000, "u") for i in range(100)]
    df = spark.createDataFrame(data, "chat_id string, seq long, ts_ms long, sender_uid string").withColumn("is_self", F.col("sender_uid") == "u").repartition(5)
    want, chats = [], defaultdict(list)
    for c, i, t, u in data:
        chats[c].append((t, i, u))
    day = lambda t: (t + C.offset_ms()) // C.DAY_MS
    for c, ms in chats.items():
        ms.sort()
        runs = [[ms[0]]]
        for m in ms[1:]:
            if m[0] - runs[-1][-1][0] > activity.REPLY_MS:
                runs.append([])
            runs[-1].append(m)
        want += [(c, r[0][0], r[0][1], r[-1][0], len(r), sum(m[2] == "u" for m in r), day(r[-1][0]) - day(r[0][0])) for r in runs]
    found = activity.sessions(df)
    assert rows(found, "chat_id", "begin_ms", "first_seq", "end_ms", "messages", "self", "midnights") == sorted(want, key=repr)
    parts = activity.session_days(found).collect()
    assert len(parts) == sum(w[-1] + 1 for w in want) and sum(p.to_ms - p.from_ms for p in parts) == sum(w[3] - w[1] for w in want)
    nights = {r.chat_id: (r.cross_late_night, r.midnights) for r in activity.late_nights(found).collect()}
    assert nights["long"] == (1, 4) and activity.sessions(df.limit(0)).count() == 0
