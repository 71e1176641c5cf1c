"""Near-duplicate documents: SetSketch registers, bands, likelihood, then the full sets.

Texts of equal shingle sets are one class, so exact copies cost nothing further. The sketches of
the classes are banded. Then:

1. Star: in each bucket of a band every class is paired with the bucket's least; a class keeps the
   pair that most bands propose. Pairs whose likeliest similarity comes near the threshold are
   confirmed on the full sets and linked.
2. Rest: in buckets whose classes are not yet all connected, every class outside the bucket's
   largest component meets all others, block by block, on sketches. A pair counts in the first
   band that it shares. Those members that have a likely partner meet again with their full sets,
   and a spanning forest of the confirmed links leaves each block.

So each pair that shares a band is either connected or confirmed or refuted on full sets, yet the
pairs of a group of near copies are never written out. A pair at the threshold shares no band with
probability ``(1 - 0.75**6)**72``, less than one in a million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import sketch as S
from palaver.llm.common import dropped, kept, scratch, small_batches, stored, table
from palaver.llm.graph import components

#: Link where SHARE[0] * intersection >= SHARE[1] * union.
SHARE = (100, 75)
#: How far below the threshold the likeliest similarity may lie: over five standard deviations.
MARGIN = 0.11
#: Members of a bucket that meet at once.
BLOCK = 256

_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sketch", pa.binary())])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ns, keys, sketches = [], [], []
        for text in batch.column("text").to_pylist():
            hashes = S.shingles(text)
            ns.append(len(hashes))
            keys.append(S.set_key(hashes))
            sketches.append(S.registers(hashes).tobytes() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], schema=_SKETCHED)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keys = [S.band_keys(np.frombuffer(x, np.uint16)) for x in batch.column("sketch").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64).reshape(-1)), pa.array(np.repeat(ids, S.BANDS))], names=["bucket", "doc_id"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [S.shingles(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array(sets, pa.binary())], names=["doc_id", "n", "shingles"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, share: tuple[int, int] = SHARE) -> bool:
    both = _common(a, b)
    return share[0] * both >= share[1] * (len(a) + len(b) - both)


def _near(na: np.ndarray, nb: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """What sizes alone allow: the intersection is at most the smaller, the union at least the larger."""
    return share[0] * np.minimum(na, nb) >= share[1] * np.maximum(na, nb)


def _confirmed(share: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share) for x, y in zip(pdf.set_a, pdf.set_b, strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _estimated(share: tuple[int, int], margin: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(-1, S.REGISTERS) for c in ("sketch_a", "sketch_b"))
                est = S.estimate(a, b, pdf.n_a.to_numpy(float), pdf.n_b.to_numpy(float))
                yield pdf.loc[est >= share[1] / share[0] - margin, ["a", "b"]]

    return run


def _blocks_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal keys of rows that come sorted by them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        values = pdf[keys].to_numpy()
        cuts = (np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist()
        if held and (held[-1][keys].iloc[-1].to_numpy() != values[0]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        begin = 0
        for cut in cuts:
            part = pdf.iloc[begin:cut]
            yield pd.concat([*held, part]) if held else part
            held, begin = [], cut
        held.append(pdf.iloc[begin:])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _likely_pairs(block: pd.DataFrame, share: tuple[int, int], margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a block that this band is the first to propose and the sketches allow."""
    left = np.flatnonzero(block["left"].to_numpy())
    right = np.flatnonzero(block["right"].to_numpy())
    ids, n, comp = (block[c].to_numpy() for c in ("doc_id", "n", "comp"))
    sketch = np.frombuffer(b"".join(block["sketch"]), np.uint16).reshape(-1, S.REGISTERS)
    band, found = int(block["bucket"].iloc[0]) & 127, [(np.empty(0, int), np.empty(0, int))]
    rows = max(1, 30_000 // max(1, len(right)))
    for at in range(0, len(left), rows):
        own = left[at : at + rows]
        meets = (comp[own][:, None] != comp[right][None, :]) & _near(n[own][:, None], n[right][None, :], share)
        # Two outside the largest component meet twice, in either order; once is enough.
        meets &= (ids[own][:, None] < ids[right][None, :]) | ~block["left_too"].to_numpy()[right][None, :]
        i, j = np.nonzero(meets)
        i, j = own[i], right[j]
        same = sketch[i] == sketch[j]
        first = same.reshape(-1, S.BANDS, S.BAND_ROWS).all(axis=2).argmax(axis=1) == band
        i, j = i[first], j[first]
        if len(i):
            likely = S.estimate(sketch[i], sketch[j], n[i].astype(float), n[j].astype(float)) >= share[1] / share[0] - margin
            found.append((i[likely], j[likely]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _likely(share: tuple[int, int], margin: float) -> Callable:
    """Members of a block that have a likely partner in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks_of(batches, ["bucket", "i", "j"]):
            some = np.unique(np.concatenate(_likely_pairs(block, share, margin)))
            if len(some):
                yield block.iloc[some][["bucket", "i", "j", "doc_id"]]

    return run


def _forest(share: tuple[int, int], margin: float) -> Callable:
    """Confirmed links of a block, without those between members already connected."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks_of(batches, ["bucket", "i", "j"]):
            above: dict[int, int] = {}

            def root(x: int, above=above) -> int:
                while (up := above.get(x, x)) != x:
                    above[x] = above.get(up, up)
                    x = up
                return x

            ids, comp = block.doc_id.to_numpy(), block.comp.to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in block.shingles]
            out = []
            for i, j in zip(*_likely_pairs(block, share, margin), strict=True):
                a, b = root(comp[i]), root(comp[j])
                if a != b and linked(sets[i], sets[j], share):
                    above[a] = b
                    out.append((ids[i], ids[j]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _in_blocks(members: DataFrame, size: int) -> DataFrame:
    """Rows (bucket, doc_id, comp) dealt to blocks (bucket, i, j).

    Members outside the bucket's largest component are in left block i, all members in right block
    j. Only buckets of several components come in.
    """
    counts = members.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    buckets = counts.groupBy("bucket").agg(F.count("*").alias("comps"), F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("main")).where("comps > 1")
    rows = members.join(buckets, "bucket").withColumn("outside", F.col("comp") != F.col("main"))
    rows = rows.withColumn("lefts", F.ceil((F.col("all") - F.col("most")) / size).cast("int")).withColumn("rights", F.ceil(F.col("all") / size).cast("int"))
    own = F.xxhash64("doc_id")
    rows = rows.withColumn("own_i", F.pmod(own, "lefts").cast("int")).withColumn("own_j", F.pmod(F.shiftright(own, 20), "rights").cast("int"))
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    struct = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    as_left = F.when(F.col("outside"), F.transform(spread("rights"), lambda j: struct(F.col("own_i"), j))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    as_right = F.transform(spread("lefts"), lambda i: struct(i, F.col("own_j")))
    at = F.explode(F.array_union(as_left, as_right)).alias("at")
    rows = rows.select("bucket", "doc_id", "comp", "outside", "own_i", "own_j", at)
    return rows.select("bucket", "doc_id", "comp", F.col("at.i").alias("i"), F.col("at.j").alias("j"), (F.col("outside") & (F.col("own_i") == F.col("at.i"))).alias("left"), (F.col("own_j") == F.col("at.j")).alias("right"), (F.col("outside") & (F.col("own_j") == F.col("at.j"))).alias("left_too"))


def _together(df: DataFrame) -> DataFrame:
    return df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def near_duplicates(docs: DataFrame, share: tuple[int, int] = SHARE, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked are documents with share[0] * intersection >= share[1] * union of their sets of distinct
    five-word shingles. A null text, or one without words, has an empty set and is linked with
    nothing. Rows of one doc_id are one document; a row with a null doc_id is linked with nothing,
    has a null component and is kept. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    with scratch(spark):
        sizes, final = _linked(docs, share, margin, block)
        classes = sizes.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
        names = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
        # A written table, so that the join below is of two plain shuffles: Spark can split it where
        # one class has a large part of all rows.
        sizes, names = kept(sizes), kept(stored(names, "names"))
    out = sizes.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("key")).alias("key")).join(names, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _linked(docs: DataFrame, share: tuple[int, int], margin: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key) of every row, and (node, component) of the classes' first documents.

    Sketches are the widest thing here. Those of copies, and of classes that share no bucket, are
    left behind before anything is joined with them.
    """
    base = stored(docs.mapInArrow(_sketched, "doc_id long, n long, key binary, sketch binary"), "sketches")
    sizes = stored(base.drop("sketch"), "sizes")
    classes = sizes.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    classes = classes.groupBy("doc_id").agg(F.min("key").alias("key"))
    reps = stored(base.join(classes, ["key", "doc_id"]).select("doc_id", "n", "sketch").dropDuplicates(["doc_id"]), "classes")
    dropped(base)

    bands = reps.mapInArrow(_banded, "bucket long, doc_id long")
    tops = bands.groupBy("bucket").agg(F.min("doc_id").alias("top"), F.count("*").alias("c")).where("c > 1").select("bucket", "top")
    shared = stored(bands.join(tops, "bucket"), "buckets")
    near = stored(reps.join(shared.select("doc_id").distinct(), "doc_id", "left_semi"), "near")
    dropped(reps)

    proposed = shared.where("doc_id <> top").groupBy("doc_id", "top").agg(F.count("*").alias("bands"))
    stars = proposed.groupBy("doc_id").agg(F.max(F.struct("bands", (-F.col("top")).alias("top"))).alias("best")).select(F.col("doc_id").alias("a"), (-F.col("best.top")).alias("b"))
    of = lambda side: near.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    stars = stored(stars.join(of("a"), "a").join(of("b"), "b").mapInPandas(_estimated(share, margin), "a long, b long"), "stars")

    texts = docs.join(near.select("doc_id", "n"), "doc_id").mapInArrow(_sets, "doc_id long, n long, shingles binary")
    sets = stored(texts.where(F.length("shingles") == 8 * F.col("n")).select("doc_id", "shingles").dropDuplicates(["doc_id"]), "sets")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
    links = stored(stars.join(side("a"), "a").join(side("b"), "b").mapInPandas(_confirmed(share), "a long, b long"), "links")
    first = stored(components(links), "components")

    members = shared.select("bucket", "doc_id").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    members = stored(_in_blocks(members, block), "blocks")
    dropped(shared, stars, links)
    with_sketch = members.join(near, "doc_id")
    likely = stored(_together(with_sketch).mapInPandas(_likely(share, margin), "bucket long, i int, j int, doc_id long"), "likely")
    again = with_sketch.join(likely, ["bucket", "i", "j", "doc_id"]).join(sets, "doc_id")
    rest = stored(_together(again).mapInPandas(_forest(share, margin), "a long, b long"), "rest")
    known = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return sizes, stored(components(known.unionByName(rest)), "linked")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each group that with the least doc_id stays.

    Rows that repeat a doc_id are one document, of which one row stays; rows without a doc_id stay.
    """
    with scratch(docs.sparkSession):
        found = kept(stored(near_duplicates(docs), "near-duplicates"))
    gone = found.where("not kept").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return rest
    return rest.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(rest.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of documents with its group of near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))
