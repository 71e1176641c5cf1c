"""One export of any size, read by many tasks.

Spark parses a multi-line JSON file in one task and holds its messages in one row. Here the file is
read as text whose lines end with a closing brace, which Spark splits by byte ranges on any file
system that it knows. Where a range begins nobody knows whether a brace stands in a string or how deep
it lies; three passes find out:

1. each range counts its quotes, and by how much it deepens if it begins outside or inside a string;
   the parity of all quotes before a range tells which of the two holds, and the sum of those its depth;
2. from its true state each range lists the values that open on the top level and counts the commas
   between elements, which shows where the array of messages lies and the number of each range's first;
3. each range cuts its messages out. Only those that cross the edge of a range are put together by
   a shuffle.

What passes 1 and 2 keep is a row a range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.schema import EXPORT_HEAD, MESSAGE
from palaver.sources import exports

#: Ranges, a row of some 100 bytes each, that are broadcast at most; with 128 MB each, 64 TB.
MOST_RANGES = 500_000
#: Chats up to which their heads are broadcast to the messages.
MOST_HEADS = 50_000
QUOTE, SLASH, COMMA = ord('"'), ord("\\"), ord(",")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_MARKS = _STEP != 0
_MARKS[[QUOTE, SLASH, COMMA]] = True


def marks(data: bytes, inside: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and bytes of the commas, braces and brackets outside strings, and the number of quotes.

    inside: data begins within a string. It does not begin behind an escaping backslash.
    """
    a = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_MARKS[a])
    c = a[at]
    slashes = at[c == SLASH]
    if len(slashes):
        run = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        place = np.arange(len(slashes)) - np.repeat(run, np.diff(run, append=len(slashes)))
        plain = ~np.isin(at, slashes[place % 2 == 0] + 1, assume_unique=True) & (c != SLASH)
        at, c = at[plain], c[plain]
    quotes = c == QUOTE
    outside = ~quotes & ((np.cumsum(quotes) + inside) % 2 == 0)
    return at[outside], c[outside], int(quotes.sum())


def fragments(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file, start, file_size, value: the text between closing braces, in order within each range."""
    rows = spark.read.option("lineSep", "}").option("pathGlobFilter", glob).text(path)
    meta = F.col("_metadata")
    return rows.select(meta.getField("file_path").alias("file"), meta.getField("file_block_start").alias("start"), meta.getField("file_size").alias("file_size"), F.col("value").cast("binary").alias("value"))


def _pieces(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[tuple, bytes]]:
    """Of a task's rows, in order, the range's key and values of more, and the bytes that belong to it."""
    for batch in batches:
        files, starts = batch.column("file"), batch.column("start").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(starts)) + 1
        names = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        edges = sorted({0, batch.num_rows, *cuts.tolist(), *(np.flatnonzero(np.diff(names)) + 1).tolist()})
        values, others = batch.column("value"), [batch.column(x) for x in more]
        for a, b in zip(edges, edges[1:], strict=False):
            yield (files[a].as_py(), int(starts[a]), *(x[a].as_py() for x in others)), b"}".join([*values.slice(a, b - a).to_pylist(), b""])


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 1."""
    sums: dict[tuple, list[int]] = {}
    for key, data in _pieces(batches, "file_size"):
        s = sums.setdefault(key, [0, 0, 0, 0])
        quotes = 0
        for k in (0, 1):
            # What stands outside a string if the range began outside, and if it began inside one.
            _, c, quotes = marks(data, (k + s[0]) % 2 == 1)
            s[1 + k] += int(_STEP[c].sum())
        s[0] += quotes
        s[3] += len(data)
    rows = [(*k, *v) for k, v in sums.items()]
    yield pa.RecordBatch.from_pandas(_frame(rows, ["file", "start", "file_size", "quotes", "outside", "inside", "bytes"]), preserve_index=False)


def _key_before(data: bytes, begin: int, end: int) -> str | None:
    """The key whose value opens at end; what comes before it since the last mark is all its own."""
    text = data[begin:end].strip()
    try:
        return json.loads(text[:-1]) if text.endswith(b":") else None
    except ValueError:
        return None


def _top_values(data: bytes, inside: bool, depth: int) -> tuple[list[tuple[int, bool]], np.ndarray, np.ndarray, np.ndarray, bool]:
    """Where values open on the top level, and whether that is the array of messages; of all marks the
    positions, bytes and depths behind them; whether data ends within a string."""
    at, c, quotes = marks(data, inside)
    after = depth + np.cumsum(_STEP[c], dtype=np.int64)
    opens = np.flatnonzero((_STEP[c] == 1) & (after == 2))
    found = [(int(at[k]), int(c[k]) == ord("[") and _key_before(data, int(at[k - 1]) + 1 if k else 0, int(at[k])) == "messages") for k in opens]
    return found, at, c, after, (inside + quotes) % 2 == 1


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 2: of each range, the last value that opens on top, the commas of what it begins in and of the messages that open in it."""
    state: dict[tuple, dict] = {}
    for (file, start, inside, depth), data in _pieces(batches, "in_string", "depth"):
        s = state.setdefault((file, start), {"inside": inside, "depth": depth, "now": None, "carried": 0, "own": 0, "arrays": 0})
        found, at, c, after, s["inside"] = _top_values(data, s["inside"], s["depth"])
        commas = at[(c == COMMA) & (after == 2)]
        edges = [-1, *(p for p, _ in found), len(data)]
        for k in range(len(edges) - 1):
            if k:
                s["now"] = found[k - 1][1]
                s["arrays"] += s["now"]
            n = int(np.searchsorted(commas, edges[k + 1]) - np.searchsorted(commas, edges[k]))
            s["carried" if s["now"] is None else "own"] += n if s["now"] is not False else 0
        s["depth"] = int(after[-1]) if len(after) else s["depth"]
    rows = [(*k, s["now"], s["carried"], s["own"], s["arrays"]) for k, s in state.items()]
    yield pa.RecordBatch.from_pandas(_frame(rows, ["file", "start", "now", "carried", "own", "arrays"]), schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("now", pa.bool_()), ("carried", pa.int64()), ("own", pa.int64()), ("arrays", pa.int64())]), preserve_index=False)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 3: elements of messages (seq from 0), and with seq -1 what stands around them."""
    out: list[tuple] = []
    size = 0
    now: dict | None = None

    def put(seq: int, edge: bool, text: bytes) -> None:
        nonlocal size
        out.append((now["file"], now["start"], seq, edge, text.decode("utf-8", "replace")))
        size += len(text)

    def batch() -> pa.RecordBatch:
        nonlocal size
        rows = pa.RecordBatch.from_pandas(_frame(out, ["file", "start", "seq", "edge", "text"]), schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("edge", pa.bool_()), ("text", pa.string())]), preserve_index=False)
        out.clear()
        size = 0
        return rows

    def over() -> None:
        """The end of a range."""
        if now is not None:
            if now["messages"]:
                put(now["seq"], True, b"".join(now["held"]))
            if now["around"]:
                put(-1, True, b"".join(now["around"]))

    for (file, start, inside, depth, within, seq), data in _pieces(batches, "in_string", "depth", "within", "seq"):
        if now is None or (now["file"], now["start"]) != (file, start):
            over()
            now = {"file": file, "start": start, "inside": inside, "depth": depth, "messages": within, "seq": seq, "held": [], "around": [], "first": within}
        found, at, c, after, now["inside"] = _top_values(data, now["inside"], now["depth"])
        arrays = {p for p, is_messages in found if is_messages}
        # Between these nothing changes: commas between elements, and where the array opens and closes.
        steps = at[((c == COMMA) & (after == 2)) | ((_STEP[c] == -1) & (after == 1)) | np.isin(at, list(arrays))]
        begin = 0
        for p in steps.tolist():
            if p in arrays:
                now["around"].append(data[begin : p + 1])
                now["messages"], begin = True, p + 1
            elif now["messages"]:
                put(now["seq"], now["first"], b"".join([*now["held"], data[begin:p]]))
                now["held"], now["first"], begin = [], False, p + 1
                if data[p] == COMMA:
                    now["seq"] += 1
                else:
                    now["messages"], begin = False, p
                    now["seq"] += 1
        now["held" if now["messages"] else "around"].append(data[begin:])
        now["depth"] = int(after[-1]) if len(after) else now["depth"]
        if size > 2**23:
            yield batch()
    over()
    yield batch()


def ranges(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """A row a range: its state where it begins, and what is known of its file. Passes 1 and 2."""
    parts = fragments(spark, path, glob)
    lexed = parts.mapInArrow(_lexed, "file string, start long, file_size long, quotes long, outside long, inside long, bytes long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    lexed = lexed.withColumn("in_string", F.pmod(sum_before(F.col("quotes")), F.lit(2)) == 1)
    lexed = lexed.withColumn("step", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))).withColumn("depth", sum_before(F.col("step")))
    # A file that ends with anything but a brace has one in its last fragment that is not there.
    lexed = lexed.withColumn("lacks", F.sum("bytes").over(whole) - F.col("file_size"))
    ends = F.sum("step").over(whole) + F.when(F.pmod(F.sum("quotes").over(whole), F.lit(2)) == 0, F.col("lacks")).otherwise(1)
    lexed = lexed.withColumn("ends", ends).select("file", "start", "file_size", "in_string", "depth", "ends")
    lexed = _few(lexed)
    listed = _begun(parts, lexed, "in_string", "depth").mapInArrow(_listed, "file string, start long, now boolean, carried long, own long, arrays long")
    rows = lexed.join(F.broadcast(_few(listed)), ["file", "start"])
    rows = rows.withColumn("within", (F.col("depth") >= 2) & F.coalesce(F.last("now", ignorenulls=True).over(before), F.lit(False)))
    commas = F.col("own") + F.when(F.col("within"), F.col("carried")).otherwise(0)
    rows = rows.withColumn("seq", sum_before(commas)).withColumn("commas", F.sum(commas).over(whole)).withColumn("arrays", F.sum("arrays").over(whole))
    return _few(rows.select("file", "start", "file_size", "in_string", "depth", "within", "seq", "commas", "arrays", "ends"))


def _few(rows: DataFrame) -> DataFrame:
    """A row a range, computed once; it comes to the driver, which is why their number is bounded."""
    found = rows.limit(MOST_RANGES + 1).collect()
    if len(found) > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges: raise spark.sql.files.maxPartitionBytes")
    return rows.sparkSession.createDataFrame(found, rows.schema)


def _begun(parts: DataFrame, known: DataFrame, *more: str) -> DataFrame:
    """Fragments with the state of their range; the join keeps their order, as the ranges are broadcast.

    Spark may divide a file otherwise when the number of cores changes between two passes; a range that
    is not known then is an error, not a wrong result.
    """
    known = known.select(F.col("file").alias("__file"), F.col("start").alias("__start"), *more)
    rows = parts.join(F.broadcast(known), (F.col("file") == F.col("__file")) & (F.col("start") == F.col("__start")), "left")
    sure = F.when(F.col("__file").isNotNull(), F.col(more[0])).otherwise(F.raise_error(F.lit("the file was divided otherwise before: set spark.sql.files.minPartitionNum")))
    return rows.select("file", "start", "value", sure.alias(more[0]), *more[1:])


def ingest(spark: SparkSession, path: str, strict: bool = False, skip_marked: bool = False, glob: str = "*.json") -> exports.Exports:
    """What exports.ingest() gives, raw apart, for files of any size; a message has to fit a task, not the file.

    The first two passes run at once; messages, chats and rejects read the file when they are used. A
    file that doesn't close what it opens, whose head or any of whose messages is no JSON, is rejected.
    An array of messages that stands in the file twice is read as one. A file without any brace has
    no range that says something and is rejected like others that are no JSON.
    """
    known = ranges(spark, path, glob)
    parts = _begun(fragments(spark, path, glob), known, "in_string", "depth", "within", "seq")
    cut = parts.mapInArrow(_cut, "file string, start long, seq long, edge boolean, text string")
    # Pieces of one element lie in neighbouring ranges; there are two a range at most.
    joined = cut.where("edge").groupBy("file", "seq").agg(F.expr("listagg(text, '') within group (order by start)").alias("text"))
    files = known.groupBy("file").agg(F.first("file_size").alias("bytes"), F.first("ends").alias("ends"), F.first("arrays").alias("arrays"), F.first("commas").alias("commas"))
    files = files.withColumn("chat_id", F.regexp_replace(F.regexp_replace("file", "^.*/", ""), r"\.[^.]*$", ""))
    heads = files.join(joined.where("seq = -1").select("file", F.from_json("text", EXPORT_HEAD, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("h")), "file", "left").select("*", "h.*").drop("h")
    elements = cut.where("not edge").select("file", "seq", "text").unionByName(joined.where("seq >= 0").select("file", "seq", "text"))
    elements = elements.join(F.broadcast(files.select("file", "commas")) if known.count() <= MOST_HEADS else files.select("file", "commas"), "file")
    elements = elements.withColumn("text", F.trim(F.regexp_replace("text", r"^[\s]+|[\s]+$", ""))).where("text <> '' or commas > 0")
    elements = elements.withColumn("m", F.from_json("text", MESSAGE, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    wrong = (F.col("text") != "null") & (F.col("m._corrupt_record").isNotNull() | ~F.col("text").startswith("{"))
    broken = elements.where(wrong).select("file").distinct().withColumn("broken", F.lit(True))
    reason = F.when((F.col("ends") != 0) | F.col("broken") | F.col("_corrupt_record").isNotNull(), "unparseable").when(F.col("chatInfo").isNull() | (F.col("arrays") == 0), "invalid format")
    heads = heads.join(broken, "file", "left").withColumn("reason", reason)
    rejects = heads.where("reason is not null").select("chat_id", "bytes", "reason")
    good = heads.withColumn("ok", F.when(F.col("reason").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.col("chat_id"), F.lit(": "), F.col("reason"))) if strict else F.lit(False))).where("ok")
    own = good.select("file", "chat_id", F.coalesce("chatInfo.selfUid", F.lit("")).alias("self_uid"))
    rows = elements.select("file", "seq", F.when(F.col("text") != "null", F.col("m")).alias("m")).join(F.broadcast(own) if known.count() <= MOST_HEADS else own, "file")
    uid = F.coalesce("m.sender.uid", F.lit(""))
    sums = rows.groupBy("file").agg(F.count("*").alias("n_messages"), F.min_by(F.when((uid != "") & (uid != F.col("self_uid")), uid), F.when((uid != "") & (uid != F.col("self_uid")), F.col("seq"))).alias("first_other"))
    chats = exports.chat_columns(good.join(sums, "file", "left"), F.coalesce("first_other", F.lit("")), F.coalesce("n_messages", F.lit(0)))
    return exports.Exports(heads, chats, exports.message_columns(rows.select("chat_id", "self_uid", "seq", "m"), skip_marked), rejects, skip_marked)


def land(found: exports.Exports, path: str) -> None:
    """Parquet tables of an ingest, as exports.land() writes them, table by table."""
    for name in ("chats", "messages", "rejects"):
        getattr(found, name).write.mode("overwrite").parquet(f"{path}/{name}")
