"""Three views of the driver's tables as messages, and queries over them with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions import columns as C
from palaver.operators import activity, content, segment
from palaver.plans import insights, report, states, tracking
from palaver.sources import folders, results, split


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _empty(kind: str):
    return F.expr(f"cast(array() as array<{kind}>)")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: chats are users, senders are event types."""
    ts_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    return _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("chat_id"), F.col("event_id").alias("seq"), ts_ms.alias("ts_ms"), F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss").alias("time_str"), F.col("event_type").alias("sender_uid"), (F.col("event_type") == "purchase").alias("is_self"), F.lit("").alias("text"), F.lit("type_1").alias("msg_type"), (F.col("event_type") == "view").alias("has_image"), F.when(k.isNull(), _empty("int")).otherwise(F.array(k)).alias("face_ids"), _empty("string").alias("face_names"))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: no times, so the turn is the order."""
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("chat_id"), F.col("turn").alias("seq"), F.lit(0).cast("long").alias("ts_ms"), F.col("turn").cast("string").alias("time_str"), F.col("role").alias("sender_uid"), (F.col("role") == "user").alias("is_self"), C.strip(F.col("text")).alias("text"), F.lit("type_1").alias("msg_type"), F.lit(False).alias("has_image"), _empty("int").alias("face_ids"), _empty("string").alias("face_names"))


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: many months."""
    return _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("chat_id"), F.col("o_orderkey").alias("seq"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("time_str"), F.col("o_orderpriority").alias("sender_uid"), (F.col("o_orderstatus") == "F").alias("is_self"), F.lit("").alias("text"), F.lit("type_1").alias("msg_type"), F.lit(False).alias("has_image"), _empty("int").alias("face_ids"), _empty("string").alias("face_names"))


def conversation_chats(messages: DataFrame) -> DataFrame:
    return messages.select("chat_id").distinct().select("chat_id", F.lit("user").alias("self_name"), F.lit("peer").alias("other_name"), F.lit(0).alias("duration_days"))


def dated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations, three weeks from turn to turn: several months a chat."""
    return conversation_messages(spark, sf_dir).withColumn("ts_ms", F.col("seq") * F.lit(21 * C.DAY_MS).cast("long"))


def exported_conversations(spark: SparkSession, sf_dir: str) -> str:
    """conversations written as exports of a million conversations each, a file each; their folder."""
    rows = _read(spark, sf_dir, "conversations").withColumn("file", F.floor(F.col("conv_id") / FILE_CHATS))
    data = F.struct(F.lit("text").alias("type"), F.struct("text").alias("data"))
    said = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("turn").alias("timestamp"), F.struct(F.col("role").alias("uid")).alias("sender"), F.struct(F.array(data).alias("elements")).alias("content"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("conv_id", "turn")) == 1
    lines = rows.select("file", F.lit(1).alias("part"), "conv_id", "turn", F.concat(F.when(first, "").otherwise(","), F.to_json(said)).alias("value"))
    ends = [(0, '{"chatInfo": {"name": "conversations", "selfUid": "user", "selfName": "user"}, "messages": ['), (2, "]}")]
    for part, text in ends:
        lines = lines.unionByName(rows.select("file").distinct().select("file", F.lit(part).alias("part"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(text).alias("value")))
    path = folders.temporary(spark, "exports")
    lines.repartition("file").sortWithinPartitions("file", "part", "conv_id", "turn").select("file", "value").write.partitionBy("file").text(path)
    return path


#: Han characters that stand for a to z, so that texts without their blanks are runs to be cut.
LETTERS = "".join(chr(0x4E00 + 97 * k) for k in range(26))


def unspaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations without their blanks: chat_id, seq, place, words and text, a stretch without other signs each."""
    said = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", LETTERS)
    rows = segment.dealt(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select(F.col("conv_id").cast("string").alias("chat_id"), F.col("turn").alias("seq"), F.posexplode(F.regexp_extract_all(said, F.lit(f"[{LETTERS} ]+"), F.lit(0))).alias("place", "said"))
    words = F.filter(F.split("said", " +"), lambda w: w != "")
    return rows.where(F.trim("said") != "").select("chat_id", "seq", "place", words.alias("words")).withColumn("text", F.array_join("words", ""))


def boundaries(words: Column) -> Column:
    """Where words end within their text: the places of marks behind each word, without the marks before them."""
    marked = F.array_join(F.transform(words, lambda w: F.concat(F.repeat(F.lit("."), F.length(w)), F.lit("|"))), "")
    at = F.filter(F.transform(F.split(marked, ""), lambda c, k: F.when(c == "|", k)), lambda k: k.isNotNull())
    return F.slice(F.transform(at, lambda k, marks: k - marks), 1, F.size(words) - 1)


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat_id, seq, place, text, known, found, right: boundaries that the blanks show, that the model finds, and those of both."""
    rows = unspaced(spark, sf_dir)
    model = segment.fit(rows)
    rows = rows.withColumn("cut", segment.tokens(F.col("text"), model)).withColumn("cut", boundaries(F.col("cut"))).withColumn("known", boundaries(F.col("words")))
    return rows.select("chat_id", "seq", "place", "text", F.size("known").alias("known"), F.size("cut").alias("found"), F.size(F.array_intersect("known", "cut")).alias("right"))


#: Conversations of an export file, and bytes of a part of a dialog.
FILE_CHATS, PART_BYTES = 1_000_000, 1_200
STOP = ("the", "of")
_EV = "ev as (select user_id::varchar as chat_id, event_id as seq, epoch_us(ts) // 1000 as ts_ms, strftime(ts, '%Y-%m-%d %H:%M:%S') as time_str, event_type as sender_uid, event_type = 'purchase' as is_self, event_type = 'view' as has_image, (props->>'$.k')::int as k from events)"
_CV = r"cv as (select conv_id::varchar as chat_id, turn as seq, turn::varchar as time_str, role = 'user' as is_self, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from conversations)"
_ORD = "ord as (select o_custkey::varchar as chat_id, o_orderkey as seq, epoch_us(o_orderdate) // 1000 as ts_ms, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as time_str, o_orderpriority as sender_uid, o_orderstatus = 'F' as is_self from orders)"
_LOCAL = "(ts_ms + 28800000)"
_DAY = f"strftime(epoch_ms({_LOCAL}), '%Y-%m-%d')"
_MONTH = f"strftime(epoch_ms({_LOCAL}), '%Y-%m')"
_HOUR = f"(({_LOCAL} // 3600000) % 24)::int"
_WEEKDAY = f"((({_LOCAL} // 86400000) + 3) % 7)::int"
_BY = "(count(*) filter (where is_self))::bigint as self, (count(*) filter (where not is_self))::bigint as other"
_PERSON = "case when is_self then 'self' else 'other' end as person"
_LAGGED = "lagged as (select *, ts_ms - lag(ts_ms) over w as gap, sender_uid <> lag(sender_uid, 1, '') over w as opens from ev window w as (partition by chat_id order by ts_ms, seq))"


def _round1(x: str) -> str:
    """One decimal, half to even on the binary value; see columns.round1."""
    s = "(v * 16::double + v * 4::double)"
    lost = f"((v * 16::double - ({s} - ({s} - v * 16::double))) + (v * 4::double - ({s} - v * 16::double)))"
    return f"list_transform([({x})::double], lambda v: case when {s} % 2 = 1 and {lost} <> 0 then case when {lost} > 0 then ({s} + 1) / 2 else ({s} - 1) / 2 end else round_even({s} / 2, 0) end / 10::double)[1]"


def _mean(who: str) -> str:
    return f"coalesce({_round1(f'sum(gap) filter (where {who} and gap <= 21600000)::double / (count(*) filter (where {who} and gap <= 21600000) * 1000)')}, 0.0)"


def _dense(bucket: str, size: int, name: str, more: str = "") -> str:
    return f"with {_EV}, chats as (select distinct chat_id from ev), scaffold as (select chat_id, b::int as {name} from chats, range({size}) r(b)), c as (select chat_id, {bucket} as {name}, {_BY} from ev group by 1, 2) select chat_id, {name}, coalesce(self, 0) as self, coalesce(other, 0) as other{more} from scaffold left join c using (chat_id, {name})"


_LENGTHS = f"with {_CV}, chats as (select distinct chat_id from cv), people as (select chat_id, person from chats, (values ('self'), ('other')) p(person)), n as (select chat_id, {_PERSON}, length(text) as n from cv) select chat_id, person, coalesce({_round1('avg(n)')}, 0.0) as avg, coalesce(max(n), 0)::int as max, coalesce(min(n), 0)::int as min, coalesce(quantile_disc(n, 0.5 order by n desc), 0)::int as median, count(n)::bigint as total from people left join n using (chat_id, person) group by 1, 2"
_WORDS = rf"with {_CV}, t as (select chat_id, {_PERSON}, seq, unnest(regexp_extract_all(text, '[a-zA-Z0-9]+')) as w, generate_subscripts(regexp_extract_all(text, '[a-zA-Z0-9]+'), 1) as pos from cv where length(text) >= 2), k as (select chat_id, person, case when regexp_full_match(w, '[Ee]m{{2,}}') then 'emmm' else w end as word, seq, pos from t where length(w) >= 2 and lower(w) not in {STOP} and not regexp_full_match(w, '\d+') and not regexp_full_match(w, '[a-zA-Z0-9_]{{16,}}') and not regexp_full_match(w, '(\d+[a-zA-Z]+|[a-zA-Z]+\d+)[a-zA-Z0-9]*')), g as (select chat_id, person, word, count(*)::bigint as count, min({{'seq': seq, 'pos': pos}}) as f from k group by 1, 2, 3), r as (select chat_id, person, word, count, row_number() over (partition by chat_id, person order by count desc, f)::int as rank from g) select chat_id, person, word, count, rank"
_FACES = f"with {_EV}, g as (select chat_id, {_PERSON}, k::varchar as name, count(*)::bigint as count, min({{'t': ts_ms, 's': seq}}) as f from ev where k is not null group by 1, 2, 3) select chat_id, person, name, count, row_number() over (partition by chat_id, person order by count desc, f)::int as rank from g"


_OVERVIEW = f"with {_EV}, {_LAGGED}, a as (select chat_id, count(*)::bigint as total_messages, (count(*) filter (where is_self))::bigint as self_count, (count(*) filter (where not is_self))::bigint as other_count, 0::bigint as self_chars, 0::bigint as other_chars, (count(*) filter (where has_image))::bigint as total_images, count(k)::bigint as total_faces, (count(*) filter (where opens))::bigint as exchange_rounds, count(distinct {_DAY})::bigint as active_days from lagged group by 1) select *, greatest(active_days, 1)::bigint as total_days, {_round1('total_messages / greatest(active_days, 1)::double')} as avg_daily from a"
_DAYS = "(({} + 28800000) // 86400000)"
_SESSIONS = f"with {_EV}, {_LAGGED}, g as (select *, count(*) filter (where gap is null or gap > 21600000) over (partition by chat_id order by ts_ms, seq rows unbounded preceding) as session from lagged), s as (select chat_id, min(ts_ms) as begin_ms, arg_min(seq, {{'t': ts_ms, 's': seq}}) as first_seq, max(ts_ms) as end_ms, count(*)::bigint as messages, {_BY} from g group by chat_id, session)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ev, cv, ord_ = event_messages, conversation_messages, order_messages
    over = lambda view, f: lambda spark, d: f(view(spark, d))
    scale = lambda m: content.word_sizes(activity.month_counts(m).withColumn("person", F.lit("all")))

    def dialog(spark, d):
        m = cv(spark, d)
        return content.dialogs(m, conversation_chats(m)).select("chat_id", "dialog")

    def parts(spark, d):
        m = cv(spark, d)
        return content.dialog_parts(m, conversation_chats(m), PART_BYTES).select("chat_id", "part", "dialog")

    def split_export(spark, d):
        found = split.ingest(spark, exported_conversations(spark, d), glob="*.txt")
        return found.messages.select("id", "seq", "ts_ms", "sender_uid", "is_self", "text")

    def merged_states(spark, d):
        path, m = folders.temporary(spark, "states"), ev(spark, d)
        for k in range(2):
            states.upsert(m.where(F.pmod("seq", F.lit(2)) == k), path, f"half-{k}")
        return states.overview(states.load(spark, path))

    def one_chat(spark, d):
        path, m = folders.temporary(spark, "chats"), ev(spark, d)
        results.store_by_chat(m, path, 16)
        return results.load_chat(spark, path, m.agg(F.min("chat_id")).first()[0]).select("chat_id", "seq", "ts_ms", "sender_uid")

    def tracked(spark, d):
        m = cv(spark, d).withColumn("id", F.concat_ws("-", "chat_id", "seq"))
        later = m.where("seq >= 2").withColumn("text", F.when(F.col("seq") == 3, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")))
        return tracking.joined(m.where("seq <= 3"), later).select("chat_id", "seq", "id", "text", "origin", "edited")

    def of_months(dimension, f):
        def run(spark, d):
            m = dated_messages(spark, d)
            return f(insights.analyze(dimension, m, conversation_chats(m), insights.OfflineProvider()))

        return run

    def asked(dimension):
        def run(spark, d):
            m = cv(spark, d)
            rows = insights.analyze(dimension, m, conversation_chats(m), insights.OfflineProvider())
            return rows.withColumn("result", F.to_json("result"))

        return run

    def everything(spark, d):
        m = cv(spark, d)
        return insights.analyze_all(m, conversation_chats(m), insights.OfflineProvider())

    def of_answers(dimension, f):
        def run(spark, d):
            m = cv(spark, d)
            return f(insights.analyze(dimension, m, conversation_chats(m), insights.OfflineProvider()))

        return run

    drop = lambda *names: lambda df: df.drop(*names)
    return {
        "agg1_daily": over(ev, activity.daily_counts),
        "agg2_hourly": over(ev, activity.hourly_distribution),
        "agg3_weekday": over(ev, activity.weekday_distribution),
        "agg4_heatmap": over(ev, activity.heatmap),
        "agg5_length": over(cv, content.length_stats),
        "agg6_face_topk": over(ev, content.face_ranking),
        "agg7_words": over(cv, lambda m: content.word_ranking(m, 80, stop=STOP)),
        "agg8_overview": over(ev, activity.overview),
        "agg9_response": over(ev, activity.response_times),
        "agg10_rounds": over(ev, activity.exchange_rounds),
        "agg11_month": over(ord_, activity.month_counts),
        "agg12_months": over(ord_, activity.months_of_text),
        "agg13_person_totals": over(cv, activity.person_totals),
        "agg14_dialog": dialog,
        "agg14_parts": parts,
        "udf1_segments": segmented,
        "src1_split_export": split_export,
        "agg16_emotion_months": of_months("emotion", insights.emotion_histogram),
        "agg17_topic_months": of_months("topics", insights.topic_weights),
        "agg15_utterances": over(cv, lambda m: content.utterances(m, insights.HABIT_MESSAGES, True)),
        "agg16_emotions": of_answers("emotion", insights.emotion_histogram),
        "agg17_topics": of_answers("topics", insights.topic_weights),
        "agg18_heat_scale": over(ev, lambda m: activity.heatmap_scale(activity.heatmap(m))),
        "agg20_share": over(ev, activity.shares),
        "agg21_entries": of_answers("habits", insights.result_count),
        "win1_gaps": over(ev, lambda m: activity.with_previous(m).select("chat_id", "seq", "ts_ms", (F.col("ts_ms") - F.col("prev_ts")).alias("gap"))),
        "win3_lastn": over(cv, lambda m: content.last_messages(m, 2).select("chat_id", "seq", "is_self")),
        "sc18_word_scale": over(ord_, lambda m: drop("person")(scale(m))),
        "srt6_top10_faces": over(ev, lambda m: report.top(content.face_ranking(m), report.TOP_FACES_CHART)),
        "srt7_top5_faces": over(ev, lambda m: report.top(content.face_ranking(m), report.TOP_FACES)),
        "srt8_top10_words": over(cv, lambda m: report.top(content.word_ranking(m, 80, stop=STOP), report.TOP_WORDS)),
        "srt10_fun_facts": of_answers("profile", lambda r: insights.fun_facts(r).withColumn("fun_facts", F.to_json("fun_facts"))),
        "udf3_emotion": asked("emotion"),
        "udf4_topics": asked("topics"),
        "udf5_relationship": asked("relationship"),
        "udf6_habits": asked("habits"),
        "udf7_profile": asked("profile"),
        "udf8_all": everything,
        "ext_active_periods": over(ev, activity.active_periods),
        "ext_sessions": over(ev, activity.sessions),
        "ext_session_days": over(ev, lambda m: activity.session_days(activity.sessions(m))),
        "ext_late_nights": over(ev, lambda m: activity.late_nights(activity.sessions(m))),
        "ext_replies": over(ev, activity.replies),
        "snk1_states": merged_states,
        "snk2_one_chat": one_chat,
        "ext_tracking": tracked,
        "ext_images": over(ev, activity.image_stats),
        "ext_initiations": over(ev, activity.initiations),
    }


def _answers() -> dict[str, str]:
    """SQL of what the offline provider answers, as n, the length of a prompt, determines it."""
    mood = "(['joy', 'calm', 'worry', 'anger'])"
    by_month = f"m as (select chat_id, '1970-01' as period, 14 + length(string_agg('[' || time_str || '] ' || case when is_self then 'user' else 'peer' end || ': ' || text, chr(10) order by seq)) as n from cv group by 1)"
    said = lambda n, more="": f"select chat_id, {_PERSON}, 17 + length(string_agg('[' || time_str || '] ' || text, chr(10) order by seq)) as n from (select *, row_number() over (partition by chat_id, is_self order by seq desc) as k from cv) where k <= {n}{more} group by 1, 2"
    people = f"h as ({said(insights.HABIT_MESSAGES)}), p as ({said(insights.PROFILE_MESSAGES, chr(32) + 'and text <> ' + chr(39) * 2)}), t as (select chat_id, {_PERSON}, case when is_self then 'user' else 'peer' end as name, count(*)::bigint as total_messages from cv group by 1, 2, 3)"
    first, second = f"{mood}[n % 4 + 1]", f"{mood}[n // 4 % 4 + 1]"
    emotion = f"""'{{"self_emotion":"' || {first} || '","self_intensity":' || (n % 10 + 1) || ',"self_keywords":["a"],"other_emotion":"' || {second} || '","other_intensity":' || (n // 16 % 10 + 1) || ',"other_keywords":["b"],"overall_tone":"neutral"}}'"""
    topics = """'{"topics":[{"name":"topic' || (n % 3) || '","weight":0.6,"keywords":["a"]},{"name":"other","weight":0.4,"keywords":[]}],"summary":"s","topic_shift_detected":' || case when n % 2 = 1 then 'true' else 'false' end || ',"shift_description":""}'"""
    relationship = """'{"initiator_tendency":"balanced","initiator_ratio_self":0.5,"closeness_score":' || (n % 10 + 1) || ',"relationship_summary":"s"}'"""
    habits = """'{"personality_tags":["brief"],"common_phrases":[],"sentence_length":"short"}'"""
    profile = """'{"name":"' || name || '","overall_impression":"i","fun_facts":["1","2","3","4"],"growth_observation":{"has_changed":false},"scoring":{"humour":"' || (n % 10) || '"}}'"""
    month = lambda result: f"with {_CV}, {by_month} select chat_id, period, period as month, {result} as result, null::varchar as error from m"
    person = lambda of, result: f"with {_CV}, {people} select chat_id, person, name, total_messages, {result} as result, null::varchar as error from {of} join t using (chat_id, person)"
    dated = f"strftime(epoch_ms(seq * {21 * C.DAY_MS} + 28800000), '%Y-%m')"
    months = f"m as (select chat_id, {dated} as period, 14 + length(string_agg('[' || time_str || '] ' || case when is_self then 'user' else 'peer' end || ': ' || text, chr(10) order by seq)) as n from cv group by 1, 2)"
    each = {"emotion": ("m", emotion), "topics": ("m", topics), "relationship": ("m", relationship), "habits": ("h", habits), "profile": ("p", profile)}
    all_ = " union all ".join(f"select chat_id, '{d}' as dimension, {'period' if of == 'm' else 'person as period'}, {result} as result, null::varchar as error from {of}{'' if of == 'm' else ' join t using (chat_id, person)'}" for d, (of, result) in each.items())
    return {
        "agg16_emotions": f"with {_CV}, {by_month}, e as (select chat_id, 'self' as person, {first} as emotion from m union all select chat_id, 'other', {second} from m) select chat_id, person, emotion, count(*)::bigint as months from e group by 1, 2, 3",
        "agg17_topics": f"with {_CV}, {by_month} select chat_id, 'topic' || (n % 3) as name, 60::int as value, 1::int as rank from m union all select chat_id, 'other', 40::int, 2::int from m",
        "agg16_emotion_months": f"with {_CV}, {months}, e as (select chat_id, 'self' as person, {first} as emotion from m union all select chat_id, 'other', {second} from m) select chat_id, person, emotion, count(*)::bigint as months from e group by 1, 2, 3",
        "agg17_topic_months": f"with {_CV}, {months}, t as (select chat_id, 'topic' || (n % 3) as name, 0.6::double as w from m union all select chat_id, 'other', 0.4::double from m), s as (select chat_id, name, floor(sum(w) * 100 + 0.5)::int as value from t group by 1, 2) select chat_id, name, value, row_number() over (partition by chat_id order by value desc, name)::int as rank from s",
        "agg21_entries": f"with {_CV}, {people} select chat_id, count(*)::bigint as entries from h group by 1",
        "srt10_fun_facts": f"""with {_CV}, {people} select chat_id, person, '["1","2","3"]' as fun_facts from p""",
        "udf3_emotion": month(emotion),
        "udf4_topics": month(topics),
        "udf5_relationship": month(relationship),
        "udf6_habits": person("h", habits),
        "udf7_profile": person("p", profile),
        "udf8_all": f"with {_CV}, {by_month}, {people} {all_}",
    }


def oracle_sql() -> dict[str, str]:
    share = "round(100.0 * count(*) / sum(count(*)) over (partition by chat_id), 1)"
    monthly = f"with {_ORD} select chat_id, {_MONTH} as month, count(*)::bigint as count from ord group by 1, 2"
    return {
        **_answers(),
        "agg1_daily": f"with {_EV} select chat_id, {_DAY} as date, {_BY} from ev group by 1, 2",
        "agg2_hourly": _dense(_HOUR, 24, "hour"),
        "agg3_weekday": _dense(_WEEKDAY, 7, "weekday", ", (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[weekday + 1] as weekday_name"),
        "agg4_heatmap": f"with {_EV} select chat_id, {_WEEKDAY} as weekday, {_HOUR} as hour, count(*)::bigint as count from ev group by 1, 2, 3",
        "agg5_length": _LENGTHS,
        "agg6_face_topk": f"select * from ({_FACES}) where rank <= 20",
        "agg7_words": f"{_WORDS} from r where rank <= 80",
        "agg8_overview": _OVERVIEW,
        "agg9_response": f"with {_EV}, {_LAGGED} select chat_id, {_mean('is_self')} as self_avg_seconds, {_mean('not is_self')} as other_avg_seconds from lagged group by 1",
        "agg10_rounds": f"with {_EV}, {_LAGGED} select chat_id, (count(*) filter (where opens))::bigint as rounds from lagged group by 1",
        "agg11_month": monthly,
        "agg12_months": f"with {_ORD} select chat_id, count(distinct substr(time_str, 1, 7))::bigint as months from ord group by 1",
        "agg13_person_totals": f"with {_CV} select chat_id, {_PERSON}, count(*)::bigint as total_messages from cv group by 1, 2",
        "agg14_dialog": f"with {_CV} select chat_id, string_agg('[' || time_str || '] ' || case when is_self then 'user' else 'peer' end || ': ' || text, chr(10) order by seq) as dialog from cv group by 1",
        "agg14_parts": f"with {_CV}, l as (select chat_id, seq, '[' || time_str || '] ' || case when is_self then 'user' else 'peer' end || ': ' || text || case when seq = max(seq) over (partition by chat_id) then '' else chr(10) end as line from cv), c as (select *, unnest(range(0, ceil(length(line) / {PART_BYTES // 16}.0)::int)) as i from l), p as (select chat_id, seq, i, substr(line, (i * {PART_BYTES // 16} + 1)::int, {PART_BYTES // 16}) as piece from c), b as (select *, (coalesce(sum(strlen(piece)) over (partition by chat_id order by seq, i rows between unbounded preceding and 1 preceding), 0) // {PART_BYTES - PART_BYTES // 16 * 4})::int as part from p) select chat_id, part, string_agg(piece, '' order by seq, i) as dialog from b group by 1, 2",
        "src1_split_export": rf"select conv_id::varchar || '-' || turn::varchar as id, row_number() over (partition by conv_id // {FILE_CHATS} order by conv_id, turn) - 1 as seq, turn as ts_ms, role as sender_uid, role = 'user' as is_self, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from conversations",
        "agg15_utterances": f"with {_CV}, r as (select *, row_number() over (partition by chat_id, is_self order by seq desc) as n from cv) select chat_id, {_PERSON}, string_agg('[' || time_str || '] ' || text, chr(10) order by seq) as utterances from r where n <= 200 group by 1, 2",
        "agg18_heat_scale": f"with {_EV}, c as (select chat_id, count(*) as count from ev group by chat_id, {_WEEKDAY}, {_HOUR}) select chat_id, greatest(1, max(count))::bigint as scale_max from c group by 1",
        "agg20_share": f"with {_EV} select chat_id, {_PERSON}, count(*)::bigint as count, {share} as share from ev group by 1, 2",
        "win1_gaps": f"with {_EV}, {_LAGGED} select chat_id, seq, ts_ms, gap from lagged",
        "win3_lastn": f"with {_CV}, r as (select *, row_number() over (partition by chat_id, is_self order by seq desc) as n from cv) select chat_id, seq, is_self from r where n <= 2",
        "sc18_word_scale": f"with m as ({monthly}), s as (select *, min(count) over (partition by chat_id) as a, max(count) over (partition by chat_id) as b from m) select chat_id, month, count, 14.0::double + 34.0::double * (count - a)::double / (case when a = b then 1 else b - a end)::double as size from s",
        "srt6_top10_faces": f"select * from ({_FACES}) where rank <= 10",
        "srt7_top5_faces": f"select * from ({_FACES}) where rank <= 5",
        "srt8_top10_words": f"{_WORDS} from r where rank <= 10",
        "ext_active_periods": f"with {_EV}, c as (select chat_id, {_HOUR} as hour, count(*)::bigint as count from ev group by 1, 2), r as (select *, row_number() over (partition by chat_id order by count desc, hour)::int as rank from c) select * from r where rank <= 3",
        "ext_sessions": f"{_SESSIONS} select *, ({_DAYS.format('end_ms')} - {_DAYS.format('begin_ms')})::int as midnights from s",
        "ext_session_days": f"{_SESSIONS}, d as (select *, unnest(range({_DAYS.format('begin_ms')}, {_DAYS.format('end_ms')} + 1)) as day from s) select chat_id, begin_ms, first_seq, strftime(epoch_ms(day * 86400000), '%Y-%m-%d') as date, greatest(begin_ms, day * 86400000 - 28800000) as from_ms, least(end_ms, (day + 1) * 86400000 - 28800000) as to_ms from d",
        "ext_late_nights": f"{_SESSIONS}, n as (select *, {_DAYS.format('end_ms')} - {_DAYS.format('begin_ms')} as m from s) select chat_id, (count(*) filter (where m > 0))::bigint as cross_late_night, sum(m)::bigint as midnights from n group by 1",
        "ext_replies": f"with {_EV}, l as (select *, ts_ms - lag(ts_ms) over w as gap, lag(sender_uid) over w as prev from ev window w as (partition by chat_id order by ts_ms, seq)) select chat_id, {_PERSON}, count(*)::bigint as messages, (count(*) filter (where sender_uid <> prev and gap <= 21600000))::bigint as replies, (count(*) filter (where sender_uid <> prev and gap <= 21600000)) / count(*)::double as reply_ratio from l group by 1, 2",
        "snk1_states": _OVERVIEW,
        "snk2_one_chat": f"with {_EV} select chat_id, seq, ts_ms, sender_uid from ev where chat_id = (select min(chat_id) from ev)",
        "ext_tracking": f"with {_CV} select chat_id, row_number() over (partition by chat_id order by seq) - 1 as seq, chat_id || '-' || seq as id, case when seq = 3 then text || ' (edited)' else text end as text, case when seq < 2 then 'old' when seq > 3 then 'new' else 'both' end as origin, seq = 3 as edited from cv",
        "ext_images": f"with {_EV} select chat_id, (count(*) filter (where has_image and is_self))::bigint as self, (count(*) filter (where has_image and not is_self))::bigint as other from ev group by 1",
        "ext_initiations": f"with {_EV}, {_LAGGED} select chat_id, {_BY}, (count(*) filter (where is_self)) / count(*)::double as initiator_ratio_self from lagged where gap is null or gap > 21600000 group by 1",
    }
