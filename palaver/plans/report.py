"""The report of one chat: its small tables as one HTML page, or rows of JSON."""

from __future__ import annotations

import html
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions import columns as C
from palaver.operators import activity, content

TOP_FACES_CHART, TOP_FACES, TOP_WORDS, APP_WORDS = 10, 5, 10, 80


def metrics(messages: DataFrame, chats: DataFrame, tz: str = C.TZ, words: int = APP_WORDS) -> dict[str, DataFrame]:
    """All local metrics by name, of all chats."""
    return {
        "daily": activity.daily_counts(messages, tz),
        "hourly": activity.hourly_distribution(messages, tz),
        "weekly": activity.weekday_distribution(messages, tz),
        "heatmap": activity.heatmap(messages, tz),
        "lengths": content.length_stats(messages),
        "faces": content.face_ranking(messages),
        "words": content.word_ranking(messages, words),
        "response": activity.response_times(messages),
        "rounds": activity.exchange_rounds(messages),
        "overview": activity.overview(messages, chats, tz),
        "shares": activity.shares(messages),
    }


def top(ranking: DataFrame, n: int) -> DataFrame:
    return ranking.where(F.col("rank") <= n)


def sections(all_metrics: dict[str, DataFrame], insights: DataFrame | None = None) -> dict[str, DataFrame]:
    """What the report shows of each metric, in its order."""
    out = {
        "overview": all_metrics["overview"],
        "shares": all_metrics["shares"].orderBy("person"),
        "lengths": all_metrics["lengths"].orderBy("person"),
        "response": all_metrics["response"],
        "daily": all_metrics["daily"].orderBy("date"),
        "hourly": all_metrics["hourly"].orderBy("hour"),
        "weekly": all_metrics["weekly"].orderBy("weekday"),
        "heatmap": all_metrics["heatmap"].orderBy("weekday", "hour"),
        "faces": top(all_metrics["faces"], TOP_FACES).orderBy("person", "rank"),
        "words": top(all_metrics["words"], TOP_WORDS).orderBy("person", "rank"),
    }
    if insights is not None:
        out["insights"] = insights.orderBy("dimension", "period")
    return out


def build_html(shown: dict[str, DataFrame], chat_id: str, now: datetime | None = None) -> str:
    """The page of one chat. Its tables have a bounded number of rows; every value is escaped."""
    now = now or datetime.now(timezone.utc)
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(chat_id)}</title><style>@media print{{nav{{display:none}}}} td,th{{padding:2px 8px}}</style></head><body>", f"<h1>{html.escape(chat_id)}</h1><p>{now:%Y-%m-%d %H:%M}</p>"]
    for name, df in shown.items():
        columns = [c for c in df.columns if c != "chat_id"]
        rows = df.where(F.col("chat_id") == chat_id).select(*[F.col(c).cast("string") for c in columns]).collect()
        cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else v)}</{tag}>" for v in values) + "</tr>"
        parts.append(f"<h2>{html.escape(name)}</h2><table>{cells('th', columns)}{''.join(cells('td', r) for r in rows)}</table>")
    return "".join([*parts, "</body></html>"])


def write_html(spark, page: str, path: str) -> None:
    """One HTML file, wherever Spark can write."""
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
