"""Toxicity: a word classifier that must not react to which group a sentence names.

Labelled documents give words that tell the classes apart. Each sentence that names a group gives
a counterfactual, with the term swapped for another of its kind. A logistic model is fitted to the
labels plus a penalty on the squared change of its score between a document and its counterfactual,
so that insults count and the mention of a group does not.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import fold, small_batches, table

#: Labelled rows of each class that the model is fitted to, at most; taken by a hash of the id.
SAMPLE_ROWS = 12_000
#: Words of the model, at most, and in how many labelled documents one must be.
FEATURES, MIN_DOCS = 4_096, 3
#: How far a word's rate must differ between the classes, in standard errors.
MIN_Z = 4.5
THRESHOLD = 0.7
RIDGE, FAIRNESS, STEPS, RATE = 1e-5, 1.0, 400, 0.2

#: Terms by kind; a swap takes another of the same kind, so of the same language and
#: form. A word that two languages write alike is listed in one of them.
IDENTITY = {
    "gender": ["women", "men", "girls", "boys"],
    "one": ["woman", "man", "girl", "boy"],
    "faith": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    "faiths": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    "origin": ["african", "asian", "european", "mexican", "american", "arab"],
    "colour": ["black", "white", "latino"],
    "love": ["gay", "straight", "lesbian", "bisexual", "heterosexual", "queer"],
    "body": ["disabled", "blind", "deaf", "transgender"],
    "gender, German": ["frauen", "männer", "mädchen", "jungen"],
    "one, German": ["frau", "mann"],
    "faith, German": ["christ", "jude"],
    "faiths, German": ["muslime", "christen", "juden", "buddhisten", "atheisten"],
    "origin, German": ["afrikaner", "asiaten", "europäer", "mexikaner", "amerikaner", "araber", "türken"],
    "colour, German": ["schwarze", "weiße"],
    "love, German": ["schwule", "lesben", "bisexuelle", "heterosexuelle"],
    "body, German": ["behinderte", "blinde", "gehörlose"],
    "gender, French": ["femmes", "hommes", "filles", "garçons"],
    "one, French": ["femme", "homme", "fille", "garçon"],
    "faith, French": ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"],
    "faiths, French": ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    "origin, French": ["africains", "asiatiques", "européens", "mexicains", "américains", "arabes"],
    "colour, French": ["noirs", "blancs"],
    "love, French": ["homosexuels", "bisexuels", "hétérosexuels"],
    "body, French": ["handicapés", "aveugles", "sourds"],
    "gender, Spanish": ["mujeres", "hombres", "chicas", "chicos"],
    "one, Spanish": ["mujer", "hombre", "chica", "chico"],
    "faith, Spanish": ["musulmán", "cristiano", "judío", "hindú", "budista", "ateo"],
    "faiths, Spanish": ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    "origin, Spanish": ["africanos", "asiáticos", "europeos", "mexicanos", "estadounidenses", "árabes"],
    "colour, Spanish": ["negros", "blancos"],
    "love, Spanish": ["homosexuales", "bisexuales", "heterosexuales"],
    "body, Spanish": ["discapacitados", "ciegos", "sordos"],
}
SWAPS = {w: [x for x in kind if x != w] for kind in IDENTITY.values() for w in kind}

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def counterfactual(text: str) -> str | None:
    """The text with the identity terms of each sentence swapped; None if it has none.

    Which other term of its kind a term becomes follows from the sentence, so that the same text
    always gives the same counterfactual.
    """
    changed = False
    out = []
    for sentence in _SENTENCE.findall(text.lower()):
        pick = xxhash.xxh3_64_intdigest(sentence)

        def swap(m: re.Match, pick: int = pick) -> str:
            nonlocal changed
            others = SWAPS.get(m[0])
            if not others:
                return m[0]
            changed = True
            return others[pick % len(others)]

        out.append(_WORD.sub(swap, sentence))
    return ".".join(out) if changed else None


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        own, other = [], []
        for text in pdf.text:
            words = words_of(text)
            swapped = counterfactual(text) if any(w in SWAPS for w in words) else None
            own.append([word_hash(w) for w in words])
            other.append(None if swapped is None else [word_hash(w) for w in words_of(swapped)])
        yield pd.DataFrame({"label": pdf.label, "words": own, "swapped": other})


def sampled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(label, text): distinct labelled texts, at most about ``rows`` of each label.

    Which are taken follows from a hash of the id, so the same tables give the same sample. Its ids
    are broadcast: ``rows`` bounds their number.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("label")).dropDuplicates(["l_id"])
    share = F.lit(0)
    for label, n in known.groupBy("label").count().collect():
        share = F.when(F.col("label") == label, F.lit(1_000_000 * min(rows, n) // n)).otherwise(share)
    taken = known.where(F.pmod(F.xxhash64("l_id"), F.lit(1_000_000)) < share)
    texts = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("l_id"), "text")
    return texts.join(F.broadcast(taken), "l_id").select("label", "text").dropDuplicates(["text"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, fairness: float = FAIRNESS) -> dict:
    """Weights by word hash, and a bias, from labelled documents.

    Only the sample's chosen words come to the driver, so what it gets is bounded by sample_rows
    and features. Without rows of both labels the model is the share of label 1.
    """
    spark = docs.sparkSession
    small_batches(spark)
    data = sampled(docs, labels, sample_rows).mapInPandas(_featured, "label int, words array<long>, swapped array<long>").persist()
    try:
        sizes = {r.label: r["count"] for r in data.groupBy("label").count().collect()}
        n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
        if not n0 or not n1:
            return {"words": {}, "bias": float(np.log((n1 + 0.5) / (n0 + 0.5)))}
        counts = data.select("label", F.explode("words").alias("w")).groupBy("w").agg(F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0")).where(F.col("c1") + F.col("c0") >= MIN_DOCS)
        rate = (F.col("c1") + F.col("c0")) / float(n0 + n1)
        z = (F.col("c1") / float(n1) - F.col("c0") / float(n0)) / F.sqrt(rate * (1 - rate) * (1 / n0 + 1 / n1) + 1e-12)
        chosen = [r.w for r in counts.select("w", z.alias("z")).where(F.abs("z") >= MIN_Z).orderBy(F.abs("z").desc(), "w").limit(features).collect()]
        chosen = list(dict.fromkeys([*chosen, *(word_hash(w) for w in SWAPS)]))
        place = {w: i for i, w in enumerate(chosen)}
        shared = spark.sparkContext.broadcast(place)

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = shared.value
            pick = lambda ws: None if ws is None else sorted(at[w] for w in ws if w in at)
            for pdf in batches:
                yield pd.DataFrame({"label": pdf.label, "own": [pick(w) for w in pdf.words], "swapped": [pick(w) for w in pdf.swapped]})

        # Equal rows are counted, so copies and clean texts without any of the words come once.
        rows = data.mapInPandas(placed, "label int, own array<int>, swapped array<int>").groupBy("label", "own", "swapped").count().orderBy("label", "own", "swapped").collect()
    finally:
        data.unpersist()
    weights, bias = _descend([(r.label, r.own, r.swapped, r["count"]) for r in rows], len(chosen), fairness)
    return {"words": {w: float(weights[i]) for i, w in enumerate(chosen) if weights[i]}, "bias": bias}


class _Sparse:
    """Rows of places, as one flat array."""

    def __init__(self, rows: list, n: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.at = np.array([i for r in rows for i in r], int)
        self.rows, self.n = len(rows), n

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.row], self.n)


def _descend(rows: list[tuple], n: int, fairness: float) -> tuple[np.ndarray, float]:
    """Gradient steps, scaled by their own running size, on the penalised likelihood."""
    label = np.array([r[0] for r in rows], float)
    mass = np.array([r[3] for r in rows], float)
    total = mass.sum()
    own = _Sparse([r[1] for r in rows], n)
    paired = [k for k, r in enumerate(rows) if r[2] is not None]
    a, b = _Sparse([rows[k][1] for k in paired], n), _Sparse([rows[k][2] for k in paired], n)
    pair_mass = mass[paired] if paired else np.empty(0)
    w, bias = np.zeros(n), float(np.log((label * mass).sum() / ((1 - label) * mass).sum()))
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(own.dot(w) + bias, -30, 30)))
        err = (p - label) * mass / total
        slope = own.back(err) + RIDGE * w
        if paired:
            gap = 2 * fairness * (a.dot(w) - b.dot(w)) * pair_mass / pair_mass.sum()
            slope += a.back(gap) - b.back(gap)
        slope = np.append(slope, err.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = RATE * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def _scored(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value["words"], model.value["bias"]
        known: dict[str, float] = {}
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                z = bias
                for w in sorted(words_of(text)):
                    c = known.get(w)
                    if c is None:
                        if len(known) > 1_000_000:
                            known.clear()
                        c = known[w] = weights.get(word_hash(w), 0.0)
                    z += c
                scores.append(1 / (1 + float(np.exp(-min(30.0, max(-30.0, z))))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every document; a null text scores as an empty one.

    Rows are scored one by one: repeated rows and null ids give one row each. Other columns are
    not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_scored(shared), "doc_id long, text string, score double")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def training_part(docs: DataFrame) -> DataFrame:
    """Rows whose crc32 of the id, modulo 3, is not 1."""
    return docs.where(fold("doc_id", 3) != 1)


def rejected_removed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not call toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_part(docs), training_part(labels)))
    flag = _flagging(model, THRESHOLD)
    return docs.where(~flag(F.coalesce("text", F.lit(""))))


def _flagging(model, threshold: float):
    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        texts = (pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["text"]) for x in batches)
        for out in _scored(model)(texts):
            yield pd.Series(out.column("score").to_numpy(zero_copy_only=False) >= threshold)

    return toxic


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, by a model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(training_part(docs), training_part(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
