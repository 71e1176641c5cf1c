"""What is said: lengths, faces, words, dialogs, samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import columns as C

#: Forwarded bundles and shop stickers, which only the word ranking leaves out.
NO_WORDS = ("type_11", "type_17")
LAUGH = "emmm"

# Words of two characters and more that are not ranked, compared in lower case.
STOP_WORDS = frozenset(
    "一个 没有 自己 什么 怎么 如果 因为 所以 然后 但是 而且 虽然 我们 确实 这么 觉得 算是 还有 知道 应该 其实 现在 有点 不能 可以 那么 那个 这个 怎么样 为什么 时候 时间 地方 "
    "方式 可能 需要 开始 最后 之后 之前 这些 那些 这样 那样 已经 还是 就是 不是 哈哈 呵呵 嘿嘿 嘻嘻 hhhh hhh hh tm tmd md 吃糖 问题 答案 这种 不会 你们 他们 ''".split()
)
# Leftovers of the export's format; those with capitals never match, as words are compared in lower case.
MEDIA_WORDS = frozenset(
    "jpg png gif bmp jpeg webp uid xml version encoding utf serviceID templateID action brief m_resid tSum flag title color size hr summary source senderName referencedMessageId "
    "msg item layout nickname remark selfUid selfUin selfName chatInfo statistics totalMessages timeRange messageTypes senders resources 图片 表情 回复 合并转发".split()
)
# Signs and digits alone; an identifier; letters and digits mixed.
SIGNS = r"""^[/*《》「」『』【】〔〕（）——……·、，。！？：；""''～~.+=@#$%^|`<>&\s\d\-]+$"""
IDENTIFIER = r"^[a-zA-Z0-9_]{16,}$"
MIXED = r"^(?:\d+[a-zA-Z]+|[a-zA-Z]+\d+)[a-zA-Z0-9]*$"

HAN = r"[一-鿕]"
LATIN = {"ascii": "[a-zA-Z0-9]+", "unicode": r"(?:(?![一-鿕])[\p{L}\p{N}])+"}


def _person() -> Column:
    return F.when(F.col("is_self"), "self").otherwise("other")


def length_stats(messages: DataFrame, rounding: str = "exact") -> DataFrame:
    """chat_id, person, avg, max, min, median (the upper one), total; both persons of every chat.

    A message without text has length 0; a person without messages has zeros.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    each = messages.select("chat_id", "is_self", n.alias("n"))
    stats = lambda who: F.struct(
        F.coalesce(F.avg(F.when(who, F.col("n"))), F.lit(0.0)).alias("avg"),
        F.coalesce(F.max(F.when(who, F.col("n"))), F.lit(0)).alias("max"),
        F.coalesce(F.min(F.when(who, F.col("n"))), F.lit(0)).alias("min"),
        F.count_if(who).alias("total"),
    )
    rows = each.groupBy("chat_id").agg(stats(F.col("is_self")).alias("s"), stats(~F.col("is_self")).alias("o"), F.expr("percentile_disc(0.5) within group (order by n desc) filter (where is_self)").alias("sm"), F.expr("percentile_disc(0.5) within group (order by n desc) filter (where not is_self)").alias("om"))
    one = lambda who, s, m: F.struct(F.lit(who).alias("person"), C.round1(F.col(f"{s}.avg"), rounding).alias("avg"), F.col(f"{s}.max").alias("max"), F.col(f"{s}.min").alias("min"), F.coalesce(F.col(m), F.lit(0)).cast("int").alias("median"), F.col(f"{s}.total").alias("total"))
    return rows.select("chat_id", F.explode(F.array(one("self", "s", "sm"), one("other", "o", "om"))).alias("x")).select("chat_id", "x.*")


def ranked(counts: DataFrame, top: int) -> DataFrame:
    """The most frequent of each person; of equal ones the first seen."""
    order = Window.partitionBy("chat_id", "person").orderBy(F.desc("count"), "first_seen")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("first_seen")


def face_counts(messages: DataFrame) -> DataFrame:
    """chat_id, person, name, count, first_seen. A face is its name; in messages without names, its id."""
    names = F.filter("face_names", lambda x: x != "")
    faces = F.when(F.size(names) > 0, names).otherwise(F.transform("face_ids", lambda x: x.cast("string")))
    rows = messages.select("chat_id", _person().alias("person"), "ts_ms", "seq", F.posexplode(faces).alias("pos", "name"))
    return rows.groupBy("chat_id", "person", "name").agg(F.count("*").alias("count"), F.min(F.struct("ts_ms", "seq", "pos")).alias("first_seen"))


def face_ranking(messages: DataFrame, top: int = 20) -> DataFrame:
    """chat_id, person, name, count, rank."""
    return ranked(face_counts(messages), top)


def _bigrams(run: Column) -> Column:
    return F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))


def best_cut(run: str, weights: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The likeliest words of a run of Han characters; single characters where no word fits."""
    score, step = [0.0] * (len(run) + 1), [1] * (len(run) + 1)
    for i in range(len(run) - 1, -1, -1):
        options = [(weights.get(run[i : i + n], unknown if n == 1 else None), n) for n in range(1, min(longest, len(run) - i) + 1)]
        score[i], step[i] = max((w + score[i + n], n) for w, n in options if w is not None)
    out, i = [], 0
    while i < len(run):
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def path_of(lexicon: dict[str, int]) -> Callable[[str], list[str]]:
    """best_cut() by the frequencies of a lexicon."""
    total = math.log(max(1, sum(lexicon.values())))
    weights = {w: math.log(max(1, n)) - total for w, n in lexicon.items()}
    longest, unknown = max([1, *map(len, weights)]), -total - 1
    return lambda run: best_cut(run, weights, longest, unknown)


def tokens(text: Column, lexicon: dict[str, int] | None = None, latin: str = "ascii") -> Column:
    """Words in order: runs of letters and digits, and Han words.

    With a lexicon (word to frequency) Han runs are cut along the likeliest path, in a pandas UDF;
    without one they give their bigrams, in built-in functions. A lexicon is a user's own file or
    what learned_lexicon() finds; none is shipped.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{HAN}+|{LATIN[latin]}"), F.lit(0))
    if lexicon is None:
        return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^{HAN}"), _bigrams(r)).otherwise(F.array(r))))
    likely = path_of(lexicon)

    @F.pandas_udf("array<string>")
    def cut(rows: pd.Series) -> pd.Series:
        return rows.map(lambda rs: [w for r in rs for w in (likely(r) if "一" <= r[0] <= "鿕" else [r])])

    return cut(runs)


def learned_lexicon(messages: DataFrame, least: int = 5, cohesion: float = 10.0, neighbours: int = 3, longest: int = 4, most: int = 200_000) -> dict[str, int]:
    """Han words that the messages themselves show, with their counts, for tokens().

    A word is a run of 2 to ``longest`` characters that occurs ``least`` times, stands between
    ``neighbours`` different characters on either side, and wherever it is cut in two is
    ``cohesion`` times as frequent as its parts would make by chance. The ``most`` frequent come to
    the driver. Messages without Han characters give none.
    """
    runs = messages.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{HAN}+"), F.lit(0))).alias("run"))
    gram = lambda i, n: F.struct(F.substring("run", i, F.lit(n)).alias("w"), F.when(i > 1, F.substring("run", i - 1, F.lit(1))).otherwise("").alias("before"), F.substring("run", i + n, F.lit(1)).alias("after"))
    of = lambda n: F.when(F.length("run") >= n, F.transform(F.sequence(F.lit(1), F.length("run") - (n - 1)), lambda i: gram(i, n)))
    grams = runs.select(F.inline(F.flatten(F.array_compact(F.array(*[of(n) for n in range(1, longest + 1)])))))
    counts = grams.groupBy("w").agg(F.count("*").alias("c"), F.least(F.approx_count_distinct("before"), F.approx_count_distinct("after")).alias("sides")).where(F.col("c") >= least)
    total = counts.where(F.length("w") == 1).agg(F.sum("c")).first()[0] or 0
    words = counts.where((F.length("w") > 1) & (F.col("sides") >= neighbours))
    cut = words.select("w", "c", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i")).select("w", "c", F.substring("w", F.lit(1), F.col("i")).alias("a"), F.expr("substring(w, i + 1)").alias("b"))
    part = lambda x: counts.select(F.col("w").alias(x), F.col("c").alias(f"c_{x}"))
    chance = cut.join(part("a"), "a").join(part("b"), "b").groupBy("w", "c").agg(F.max(F.col("c_a") * F.col("c_b")).alias("parts"))
    found = chance.where(F.col("c") * float(total) >= cohesion * F.col("parts"))
    return {r.w: r.c for r in found.select("w", "c").orderBy(F.desc("c"), "w").limit(most).collect()}


def _says_something(w: Column, stop: Iterable[str]) -> Column:
    """Long enough, no stop word, not all digits or signs, not an identifier or a mix with digits."""
    noise = w.rlike(f"(?U){SIGNS}") | w.rlike(IDENTIFIER) | w.rlike(f"(?U){MIXED}")
    return (F.length(w) >= 2) & ~F.lower(w).isin(*sorted(stop)) & ~noise


def word_counts(messages: DataFrame, stop: Iterable[str] = STOP_WORDS | MEDIA_WORDS, lexicon: dict[str, int] | None = None, latin: str = "ascii") -> DataFrame:
    """chat_id, person, word, count, first_seen of all words that say something, case kept."""
    text = C.strip(F.col("text"))
    rows = messages.where(~F.coalesce("msg_type", F.lit("")).isin(*NO_WORDS)).where(F.length(text) >= 2)
    rows = rows.select("chat_id", _person().alias("person"), "ts_ms", "seq", F.posexplode(tokens(text, lexicon, latin)).alias("pos", "word"))
    rows = rows.where(_says_something(F.col("word"), stop)).withColumn("word", F.when(F.col("word").rlike("^[Ee]m{2,}$"), LAUGH).otherwise(F.col("word")))
    return rows.groupBy("chat_id", "person", "word").agg(F.count("*").alias("count"), F.min(F.struct("ts_ms", "seq", "pos")).alias("first_seen"))


def word_ranking(messages: DataFrame, top: int = 50, **options) -> DataFrame:
    """chat_id, person, word, count, rank."""
    return ranked(word_counts(messages, **options), top)


def word_sizes(ranking: DataFrame) -> DataFrame:
    """The ranking with a display size by count, from 14 to 48, of each person."""
    w = Window.partitionBy("chat_id", "person")
    return ranking.withColumn("size", C.word_size(F.col("count"), F.min("count").over(w), F.max("count").over(w)))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n of each person."""
    order = Window.partitionBy("chat_id", "is_self").orderBy(F.desc("ts_ms"), F.desc("seq"))
    return messages.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def newest_share(messages: DataFrame, share: float = 0.6, tz: str = C.TZ) -> DataFrame:
    """The newest part of each month, for models that cannot take all of it.

    A message's place in its month is its place in its day after the messages of later days, which
    are counted by day, so no task has a whole month of a large chat.
    """
    rows = messages.withColumn("__month", C.month(F.col("ts_ms"), tz)).withColumn("__day", C.day_number(F.col("ts_ms"), tz))
    rows = rows.withColumn("__key", F.concat(F.when(F.col("chat_id").isNull(), "-").otherwise("+"), F.coalesce("chat_id", F.lit(""))))
    month = Window.partitionBy("__key", "__month")
    days = rows.groupBy("__key", "__month", "__day").agg(F.count("*").alias("__c"))
    later = F.coalesce(F.sum("__c").over(month.orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("__key", "__month", "__day", later.alias("__later"), F.sum("__c").over(month).alias("__all"))
    place = F.row_number().over(Window.partitionBy("__key", "__month", "__day").orderBy(F.desc("ts_ms"), F.desc("seq"))) - 1
    rows = rows.withColumn("__place", place).join(days, ["__key", "__month", "__day"])
    part = (F.col("__later") + F.col("__place")) / F.greatest(F.lit(1), F.col("__all") - 1)
    return rows.where(part <= share).select(messages.columns)


def _named(messages: DataFrame, chats: DataFrame) -> DataFrame:
    names = chats.select(F.col("chat_id").alias("__chat"), "self_name", "other_name")
    return messages.join(names, F.col("chat_id").eqNullSafe(F.col("__chat")), "left").withColumn("speaker", F.when(F.col("is_self"), F.col("self_name")).otherwise(F.col("other_name"))).drop("__chat", "self_name", "other_name")


def dialogs(messages: DataFrame, chats: DataFrame, tz: str = C.TZ) -> DataFrame:
    """chat_id, month, dialog: a line ``[time] name: text`` for each message, in order."""
    line = F.concat(F.lit("["), "time_str", F.lit("] "), F.coalesce("speaker", F.lit("")), F.lit(": "), "text")
    return _named(messages, chats).withColumn("line", line).withColumn("month", C.month(F.col("ts_ms"), tz)).groupBy("chat_id", "month").agg(F.expr("listagg(line, '\n') within group (order by ts_ms, seq)").alias("dialog"))


def dialog_parts(messages: DataFrame, chats: DataFrame, budget: int, tz: str = C.TZ) -> DataFrame:
    """chat_id, month, part, dialog: dialogs() in parts of at most ``budget`` bytes of UTF-8.

    Parts count from 0; one after the other they give the whole dialog, line feeds included. A line
    longer than a 16th of the budget in code points is cut into such pieces. A piece belongs to the
    part in which it begins, and a part begins every three quarters of the budget, so the last piece,
    of a quarter of it at most, still fits. Where a piece begins is a sum of bytes within its day and
    of those of the days before, so no task has a month of a chat, and no string is longer than a part.
    """
    if budget < 16:
        raise ValueError("the budget has to be 16 bytes at least")
    chars = budget // 16
    line = F.concat(F.lit("["), "time_str", F.lit("] "), F.coalesce("speaker", F.lit("")), F.lit(": "), "text")
    rows = _named(messages, chats).withColumn("line", line).where("line is not null").withColumn("month", C.month(F.col("ts_ms"), tz)).withColumn("__day", C.day_number(F.col("ts_ms"), tz))
    rows = rows.withColumn("__key", F.concat(F.when(F.col("chat_id").isNull(), "-").otherwise("+"), F.coalesce("chat_id", F.lit(""))))
    day = Window.partitionBy("__key", "month", "__day")
    rows = rows.select("chat_id", "__key", "month", "__day", F.row_number().over(day.orderBy("ts_ms", "seq", "line")).alias("__at"), F.concat("line", F.lit("\n")).alias("line"))
    days = rows.groupBy("__key", "month", "__day").agg(F.sum(F.octet_length("line")).alias("__bytes"), F.count("*").alias("__lines"))
    before = Window.partitionBy("__key", "month").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("__day") == F.max("__day").over(Window.partitionBy("__key", "month"))
    days = days.select("__key", "month", "__day", F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__before"), F.when(last, F.col("__lines")).alias("__end"))
    rows = rows.join(days, ["__key", "month", "__day"]).withColumn("line", F.when(F.col("__at").eqNullSafe(F.col("__end")), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line")))
    cuts = F.sequence(F.lit(0), F.floor((F.length("line") - 1) / chars).cast("int"))
    pieces = rows.select(*rows.drop("line").columns, F.posexplode(F.transform(cuts, lambda i: F.substring(F.col("line"), i * chars + 1, F.lit(chars)))).alias("piece", "said"))
    begin = F.sum(F.octet_length("said")).over(day.orderBy("__at", "piece").rowsBetween(Window.unboundedPreceding, -1))
    part = F.floor((F.col("__before") + F.coalesce(begin, F.lit(0))) / (budget - 4 * chars)).cast("int")
    pieces = pieces.withColumn("part", part)
    return pieces.groupBy("chat_id", "month", "part").agg(F.expr("listagg(said, '') within group (order by __day, __at, piece)").alias("dialog"))


def utterances(messages: DataFrame, n: int, keep_empty: bool) -> DataFrame:
    """chat_id, person, utterances: the last n of each person as ``[time] text`` lines.

    Empty texts are dropped, where they are, after the last n are taken.
    """
    rows = last_messages(messages, n)
    if not keep_empty:
        rows = rows.where("text <> ''")
    rows = rows.withColumn("line", F.concat(F.lit("["), "time_str", F.lit("] "), "text"))
    return rows.groupBy("chat_id", _person().alias("person")).agg(F.expr("listagg(line, '\n') within group (order by ts_ms, seq)").alias("utterances"))
