"""Language identification by bit-sliced Bloom filters of character n-grams.

One table serves all languages: a slot holds a bit for each, so that one look-up, the AND of an
n-gram's slots, gives every language that has the n-gram. A text's n-grams are looked up, each
language's bits are counted, and the counts are corrected for the hits that its share of set slots
gives by chance. The language with the largest corrected share is the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import dropped, fold, small_batches, stored, table

#: Rows of each language that the filters learn from, at most; taken by a hash of the id.
SAMPLE_ROWS = 3_000
#: Lengths of n-grams, of which one character at most is a gap between words.
SIZES = (3, 4)
#: An n-gram belongs to a language if this share of its rows has it, and as many rows at least.
MIN_SHARE, MIN_ROWS = 0.01, 2
#: Slots of the filters, a power of two, and hashes of each n-gram.
SLOTS, HASHES = 2**19, 2
#: Code points looked up at once.
PIECE = 2**18
UNKNOWN = "und"


class _Letters:
    """Code points to lower-case letters, all else to a gap; made once for each worker."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, text: str) -> np.ndarray:
        if cls.table is None:
            to = np.full(0x110000, 32, np.int64)
            for c in range(len(to)):
                s = chr(c)
                if s.isalpha():
                    low = s.lower()
                    to[c] = ord(low) if len(low) == 1 else c
            cls.table = to
        return cls.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _hashed(letters: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of the n-gram at each place, and whether it counts."""
    size = max(0, len(letters) - n + 1)
    h = np.full(size, n, np.uint64)
    gaps = np.zeros(size, np.int8)
    for i in range(n):
        part = letters[i : i + size]
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        gaps += part == 32
    return h, gaps <= 1


def _framed(text: str) -> np.ndarray:
    return np.concatenate([[32], _Letters.of(text), [32]])


def _slots(h: np.ndarray, k: int, slots: int) -> np.ndarray:
    h = (h ^ np.uint64((k * 0xD6E8FEB86659FD93) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) & np.uint64(slots - 1)).astype(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each row, with its language."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 64):
            part, found = batch.slice(begin, 64), []
            for text in part.column("text").to_pylist():
                letters = _framed(text)
                found.append(np.unique(np.concatenate([h[ok] for h, ok in (_hashed(letters, n) for n in SIZES)])))
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(rows)), pa.array(np.concatenate(found).view(np.int64))], names=["lang", "gram"])


def _placed(slots: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = pdf["gram"].to_numpy(np.int64).view(np.uint64)
            yield pd.concat([pd.DataFrame({"lang": pdf["lang"], "slot": _slots(h, k, slots)}) for k in range(HASHES)])

    return run


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, slots: int = SLOTS) -> dict:
    """The languages, the slots' bits (slots by 64-bit words), and each language's share of them.

    Learns from rows with a text and a language. The n-grams are counted and the slots filled by
    Spark; the driver gets no more than the languages, which are taken to be few enough for a bit of
    every slot, and the filled slots.
    """
    small_batches(docs.sparkSession)
    known = docs.where("text is not null and lang is not null")
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    langs = sorted(r.lang for r in counts.select("lang").collect())
    if not langs:
        return {"langs": [], "bits": np.zeros((1, 1), np.uint64), "fill": np.zeros(0)}
    rows = F.least("n", F.lit(sample_rows))
    limits = F.broadcast(counts.select("lang", F.floor(1_000_000 * rows / F.col("n")).alias("share"), F.least("n", F.greatest(F.lit(MIN_ROWS), F.floor(MIN_SHARE * rows))).alias("least")))
    sample = known.join(limits.select("lang", "share"), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share")).select("lang", "text")
    grams = sample.mapInArrow(_grams, "lang string, gram long").groupBy("lang", "gram").count().join(limits.select("lang", "least"), "lang").where(F.col("count") >= F.col("least"))
    filled = grams.select("lang", "gram").mapInPandas(_placed(slots), "lang string, slot long")
    place = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1
    words = filled.withColumn("place", place.cast("int")).select("slot", F.floor(F.col("place") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, place % 64)").alias("bit"))
    rows = words.groupBy("slot", "word").agg(F.bit_or("bit").alias("bits")).toPandas()
    dropped(counts)
    bits = np.zeros((slots, (len(langs) + 63) // 64), np.uint64)
    bits[rows["slot"], rows["word"]] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([((bits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return {"langs": langs, "bits": bits, "fill": fill}


def _hits(model: dict, letters: np.ndarray) -> tuple[np.ndarray, int]:
    """Of a text's n-grams, how many each language has; and their number."""
    bits, langs = model["bits"], len(model["langs"])
    hits, total = np.zeros(langs, np.int64), 0
    for at in range(0, len(letters), PIECE):
        for n in SIZES:
            h, ok = _hashed(letters[at : at + PIECE + n - 1], n)
            h = h[ok]
            total += len(h)
            mask = bits[_slots(h, 0, len(bits))]
            for k in range(1, HASHES):
                mask = mask & bits[_slots(h, k, len(bits))]
            for word in range(bits.shape[1]):
                own = mask[:, word]
                here = min(64, langs - 64 * word)
                if here <= 12:
                    kinds = np.bincount(own.astype(np.int64), minlength=2**here)
                    for i in range(here):
                        hits[64 * word + i] += kinds.reshape(-1, 2, 2**i)[:, 1].sum()
                else:
                    for i in range(here):
                        hits[64 * word + i] += int(((own >> np.uint64(i)) & np.uint64(1)).sum())
    return hits, total


def identify(model: dict, text: str | None) -> tuple[str, float]:
    """A learned language and its share of the corrected hits; und for a text without letters."""
    if not text or not model["langs"]:
        return UNKNOWN, 0.0
    letters = _framed(text)
    if not (letters != 32).any():
        return UNKNOWN, 0.0
    hits, total = _hits(model, letters)
    chance = model["fill"] ** HASHES
    real = np.maximum(0.0, (hits / max(total, 1) - chance) / np.maximum(1 - chance, 1e-9))
    best = int(real.argmax())
    return model["langs"][best], float(real[best] / real.sum()) if real.sum() > 0 else 0.0


def _identified(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [identify(model.value, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of every document, from its whole text.

    A null text, one without letters, or a model without languages gives und and a score of 0.
    Repeated rows and null ids give one row each. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_identified(shared), "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of documents, by filters of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
