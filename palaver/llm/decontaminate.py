"""Benchmark decontamination by template windows, in DataFrame operations alone.

Numbers, units after numbers and names (capitalised words inside a sentence) become typed
placeholders. Windows of five template words of the documents are hash-joined with those of the
benchmark. Where an item has placeholders, each value of a slot must stand for one value in a copy,
and that for no other of the item: every occurrence is judged among those of its alignment, of its place and of the whole document, and
windows whose slots contradict the values that most of a group agree on are not counted. So a
question asked again with other numbers is caught, wherever else the document has its template, and
chance matches of bare templates are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import stored, table

WINDOW = 5
#: Share of an item's distinct windows that makes a document contaminated.
SHARE = 0.5
#: Windows up to which the benchmark's side is broadcast, at 28 bytes a window some 14 MB; more are shuffled.
BROADCAST_WINDOWS = 500_000

#: Placeholders are control characters, which a text's words are freed of first.
NUM, UNIT, NAME = "\u0001", "\u0002", "\u0003"
#: Units of measure that may follow a number.
UNITS = "km|cm|mm|m|mi|miles?|ft|feet|inch(?:es)?|kg|g|mg|lbs?|pounds?|tons?|l|ml|litres?|liters?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|percent|euros?|dollars?|cents?|degrees?"
# Each pattern begins with what is rare, so that most positions of a text fail at once.
_NUMBER = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
_UNIT = rf"({NUM}[^ ]+) +({UNITS})(?![\p{{L}}\p{{N}}])"
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;:]\s\p{Lu})\p{Ll}+"
_GAP = r"[^\p{L}\p{N}\u0001-\u0003\u0007]+"
_MARKS = "[\u0001-\u0007]"


def _marked(text: Column) -> Column:
    """The text with its values marked: each a word that begins with its placeholder."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(text.rlike(_MARKS), F.regexp_replace(text, _MARKS, " ")).otherwise(text)
    text = F.regexp_replace(text, _NUMBER, f" {NUM}$0 ")
    return F.regexp_replace(text, _NAME, f" {NAME}$0 ")


def _plain(marked: Column) -> Column:
    """Lower-case words of letters, digits and marks, a space between them."""
    return F.trim(F.regexp_replace(F.lower(marked), _GAP, " "))


def _units(marked: Column) -> Column:
    return F.when(F.contains(marked, F.lit(NUM)), F.regexp_replace(marked, _UNIT, f"$1 {UNIT}$2 ")).otherwise(marked)


def _values(df: DataFrame, name: str) -> DataFrame:
    """df with the words of text as the column ``name``, values as they stand, in line with _template."""
    df = df.withColumn(name, _marked(F.col("text"))).withColumn(name, _units(F.col(name)))
    return df.withColumn(name, F.split(_plain(F.regexp_replace(name, r"(?<=\p{Nd})[.,:/](?=\p{Nd})", "\u0007")), " "))


def _template(df: DataFrame, name: str) -> DataFrame:
    """df with the template of text as the column ``name``."""
    df = df.withColumn(name, _marked(F.col("text"))).withColumn(name, _units(F.col(name)))
    some = F.contains(name, F.lit(NUM)) | F.contains(name, F.lit(NAME))
    return df.withColumn(name, F.when(some, F.regexp_replace(name, "([\u0001-\u0003])[^ ]+", "$1")).otherwise(F.col(name))).withColumn(name, _plain(F.col(name)))


def _windows(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, at, hash of the window at each word of template; fewer words are one window, none none.

    The words are zipped with themselves shifted, which makes a row of each window without a
    function call for it. Nothing is filtered before: the optimiser would move that filter below
    the steps that make the template, and run them twice.
    """
    words = df.select(*keys, F.split("template", " ").alias("words"))
    shifted = [F.slice("words", k, F.size("words")).alias(f"word{k}") for k in range(1, size + 1)]
    rows = words.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("at", "window"))
    return rows.where(F.col(f"window.word{size}").isNotNull() | ((F.col("at") == 0) & (F.col("window.word1") != ""))).select(*keys, "at", F.xxhash64("window").alias("hash"))


def _slots(pairs: DataFrame, docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """key, n_found: of matched windows of items that have slots, those whose values agree.

    Every occurrence of a window takes part. Occurrences are judged in groups: those of one
    alignment (place in the text minus place in the item), those that begin within one item's
    length, by two dealings, as words put in or left out shift an alignment, and all of the
    document. In each group every value of the item has the value that most of it agrees on, and the
    other way round. The best group
    counts, so a consistent copy is found whatever else the document has of the template.
    """
    key = ["doc_id", "text_key", "item_id"]
    same = lambda p, names: [F.col(c).eqNullSafe(F.col(f"{p}_{c}")) for c in names]
    renamed = lambda df, p, names, *more: df.select(*[F.col(c).alias(f"{p}_{c}") for c in names], *more)
    of = ["doc_id", "text_key", "text_hash"]
    texts = docs.join(renamed(pairs, "t", of).distinct(), same("t", of), "left_semi").dropDuplicates(of)
    rows = pairs.join(renamed(_values(texts, "doc_words"), "t", of, "doc_words"), same("t", of))
    rows = rows.select(*key, "text_hash", "hash", "at", "item_at", F.slice("doc_words", F.col("at") + 1, size).alias("doc_part"))
    rows = rows.join(items.select("item_id", F.col("values").alias("item_words")), "item_id")
    both = F.arrays_zip(F.slice("item_words", F.col("item_at") + 1, size).alias("i"), F.col("doc_part").alias("d"))
    begin, length = F.col("at") - F.col("item_at"), F.size("item_words")
    near = lambda shift: F.floor((begin + shift) / length).cast("int")
    group = lambda kind, text, n: F.struct(F.lit(kind).alias("kind"), text.alias("text"), n.alias("n"))
    text, none = F.col("text_hash"), F.lit(None)
    groups = F.array(group(0, text, begin), group(1, text, near(F.lit(0))), group(2, text, near(length / 2)), group(3, none.cast("long"), none.cast("int")))
    rows = rows.select(*key, F.explode(groups).alias("group"), "text_hash", "hash", "at", "item_at", F.filter(both, lambda x: x["i"].rlike("^[\\u0001-\\u0003]")).alias("slots"))
    key = [*key, "group"]
    each = rows.select(*key, "text_hash", "hash", "at", "item_at", F.explode("slots").alias("slot")).select(*key, "text_hash", "hash", "at", "item_at", "slot.i", "slot.d")
    pairs_ = each.groupBy(*key, "i", "d").agg(F.count("*").alias("c"))
    agreed = renamed(pairs_.groupBy(*key, "i").agg(F.max_by("d", F.struct("c", "d")).alias("agreed")), "a", (*key, "i"), "agreed")
    back = renamed(pairs_.groupBy(*key, "d").agg(F.max_by("i", F.struct("c", "i")).alias("back")), "b", (*key, "d"), "back")
    place = [*key, "text_hash", "hash", "at", "item_at"]
    judged = each.join(agreed, same("a", (*key, "i"))).join(back, same("b", (*key, "d")))
    wrong = renamed(judged.where("d <> agreed or i <> back"), "w", place).distinct()
    out = rows.join(wrong, same("w", place), "left_anti").select(*key, "hash").distinct()
    return out.groupBy(*key).agg(F.count("*").alias("n")).groupBy(*key[:-1]).agg(F.max("n").alias("n_found"))


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: float = SHARE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Documents that hold a benchmark item, by template.

    Returns doc_id, item_id, n_windows (distinct windows of the item), n_found (those that the
    document has, with agreeing slots), share; a row where n_found / n_windows >= share. A document
    or item without words matches nothing; one of fewer words than a window is one window. Rows
    that repeat a doc_id count together; rows without a doc_id are told apart by their text, and
    reported with a null doc_id. Items with a null item_id are left out; rows that repeat an
    item_id count together. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_key"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    items = benchmark.where("item_id is not null").select("item_id", "text")
    items = stored(_values(_template(items, "template"), "values").drop("text"), "benchmark")
    items = items.withColumn("slotted", F.col("template").rlike("[\u0001-\u0003]"))
    windows = _windows(items, ["item_id", "slotted"], size)
    windows = windows.groupBy("item_id", "hash").agg(F.collect_set("at").alias("item_ats"), F.max("slotted").alias("slotted"))
    windows = stored(windows, "benchmark-windows")
    totals = windows.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    few = windows.count() <= broadcast_windows
    side = F.broadcast if few else lambda df: df

    key = ["doc_id", "text_key", "item_id"]
    exploded = _windows(_template(docs, "template"), ["doc_id", "text_key", "text_hash"], size)
    matched = exploded.join(side(windows), "hash")
    counted = lambda df: df.select(*key, "hash").distinct().groupBy(*key).agg(F.count("*").alias("n_found"))
    ratio = F.col("n_found") / F.col("n_windows")
    if windows.where("slotted").isEmpty():
        found = counted(matched)
    else:
        matched = stored(matched.select(*key, "text_hash", "hash", "at", "item_ats", "slotted"), "matched")
        slotted = matched.where("slotted")
        # Slots only take windows away: pairs with too few are done with.
        enough = counted(matched).join(side(totals), "item_id").where(ratio >= share).select(*[F.col(c).alias(f"e_{c}") for c in key])
        slotted = slotted.join(enough, [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in key], "left_semi")
        slotted = slotted.select(*key, "text_hash", "hash", "at", F.explode("item_ats").alias("item_at")).distinct()
        slotted = stored(slotted, "slotted")
        found = counted(matched.where("not slotted")).unionByName(_slots(slotted, docs, items.dropDuplicates(["item_id"]), size))
        found = found.groupBy(*key).agg(F.sum("n_found").alias("n_found"))
    return found.join(side(totals), "item_id").where(ratio >= share).select(*key, "n_windows", "n_found", ratio.alias("share"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    gone = stored(leaks(docs, benchmark).select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key")).distinct(), "leaks")
    key = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & key.eqNullSafe(F.col("__gone_key")), "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of documents that holds an item of benchmark, and the item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
