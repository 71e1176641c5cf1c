"""Approximate nearest neighbours by largest inner product: NN-descent, then greedy graph search.

Equal vectors are one node. A further component makes all nodes equally long, so that near nodes of
one node are near each other. A first graph comes from small blocks. Then in each round every node
gathers its neighbours and some of those that have it as a neighbour; of a gathering, those that came
anew with the round before are compared with all, and each keeps the best that it meets: neighbours
of neighbours become neighbours. A node with nothing new gathers no more.

Queries walk the graph together. A round expands the best nodes of each query that are not expanded
yet, and a query ends when its best nodes all are. Only nodes that a query has not met go on to have
their vectors compared. Graph and walk compare the vectors themselves, in
double precision and with the further component apart, so neither near copies nor a few long vectors
blur the others. All nodes of a query that summing in another order could bring into its answer are
ranked again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.llm.common import dropped, kept, scratch, small_batches, stored, table

#: Neighbours of a node, and how many of those that it is a neighbour of join them.
DEGREE, REVERSE = 32, 32
#: Rounds go on until this share of a graph's edges is new, at most.
CHANGED = 0.01
#: Rows of a block of the first graph, and dealings into blocks: one random, the others by direction.
BLOCK, DEALINGS = 512, 3
#: New neighbours that one gathering offers to a member.
OFFERED = 3
#: Best nodes that a query remembers, and nodes that it expands in a round, at most.
BEAM, EXPANDED = 250, 64
#: Bytes of the queries' vectors up to which they are broadcast; more are shuffled.
BROADCAST_BYTES = 2**25
NEAREST = 20


def _coded(dim: int, longest: float, bits: int, kind: str, as_query: bool) -> Callable:
    """Vectors as bytes of numpy's type ``kind``; of nodes the further component and their sides too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.Generator(np.random.PCG64(41)).normal(size=(DEALINGS - 1, bits, dim))
        for batch in batches:
            x = np.asarray(batch.column("vector").flatten()).reshape(-1, dim)
            out = [batch.column("node"), pa.array([c.tobytes() for c in x.astype(kind)], pa.binary())]
            names = ["node", "code"]
            if not as_query:
                scaled = x / longest
                sides = [((x @ p.T > 0) * (1 << np.arange(bits))).sum(axis=1).astype(np.int64) for p in planes]
                out += [pa.array(np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))), pa.array(np.stack(sides, axis=1).tolist(), pa.list_(pa.int64()))]
                names += ["further", "sides"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _compared(offered: int, longest: float, kind: str) -> Callable:
    """Of each gathering (array of w, new, code, further, least), the pairs that raise a member's least score.

    Pairs without a new member are left out: they met before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            # Alike sizes together, so that little is padded; a wide gathering goes with few others.
            order, begin, starts = np.argsort(sizes), 0, np.cumsum([0, *sizes])
            flat = lists.flatten()
            w, new, further, least = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("w", "new", "further", "least"))
            codes = flat.field("code").to_pylist()
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            while begin < len(order):
                width = int(sizes[order[begin]])
                end = begin + 1
                while end < len(order) and (sizes[order[end]] <= width + 8) and (end - begin + 1) * int(sizes[order[end]]) ** 2 <= 2**21:
                    end += 1
                own = order[begin:end]
                begin, width = end, int(sizes[own].max(initial=0))
                if width < 2:
                    continue
                group = np.repeat(np.arange(len(own)), sizes[own])
                place = np.concatenate([np.arange(n) for n in sizes[own]])
                at = starts[own][group] + place
                vectors = np.frombuffer(b"".join([codes[i] for i in at]), kind).reshape(len(at), -1)
                x = np.zeros((len(own), width, vectors.shape[1] + 1))
                x[group, place, :-1] = vectors / longest
                x[group, place, -1] = further[at]
                ids, floor = np.full(x.shape[:2], -1, np.int64), np.full(x.shape[:2], np.inf)
                real, fresh = np.zeros(x.shape[:2], bool), np.zeros(x.shape[:2], bool)
                ids[group, place], floor[group, place], real[group, place], fresh[group, place] = w[at], least[at], True, new[at]
                scores = x @ x.transpose(0, 2, 1)
                scores[(ids[:, :, None] == ids[:, None, :]) | ~real[:, None, :] | ~(fresh[:, :, None] | fresh[:, None, :])] = -np.inf
                k = min(offered, width - 1)
                best = np.argpartition(-scores, k - 1, axis=2)[:, :, :k]
                s = np.take_along_axis(scores, best, axis=2)
                g, i, j = np.nonzero((s > floor[:, :, None]) & (s > -np.inf))
                found.append((ids[g, i], ids[g, best[g, i, j]], s[g, i, j]))
            node, other, s = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(s)], names=["node", "w", "s"])

    return run


def _scored(kind: str) -> Callable:
    """Scores of pairs of a query and a node that may be among the query's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.float64)  # noqa: B023, E731
                s = np.einsum("ij,ij->i", of("code"), of("q_code"))
                keep = pa.array(s >= batch.column("least").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column("q").filter(keep), batch.column("w").filter(keep), pa.array(s).filter(keep)], names=["q", "w", "s"])

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector (array of double) of the rows that take part.

    Rows with a null id, a null, empty or zero vector, null or non-finite components, or another
    number of components than most rows take no part; of rows that repeat an id the one with the
    least vector stays.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    most = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("vector") == (most.dim if most else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` best of node, w, s, fresh for each node.

    Rows of one pair are merged first, wherever they lie. Spark then cuts ranks before rows are
    dealt out, so a node that many gatherings offer to is no hot key.
    """
    by = W.partitionBy("node").orderBy(F.desc("s"), "w")
    merged = edges.groupBy("node", "w").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    return merged.withColumn("r", F.row_number().over(by)).where(F.col("r") <= degree).drop("r")


def _gatherings(edges: DataFrame, reverse: int, seed: int) -> DataFrame:
    """at, w, new: each node's neighbours, and ``reverse`` of those that it is a neighbour of.

    Which of these, where there are more, a hash decides anew in each round. All others still have
    the node among their own neighbours.
    """
    back = edges.select(F.col("w").alias("at"), F.col("node").alias("w"), "fresh")
    some = back.withColumn("r", F.row_number().over(W.partitionBy("at").orderBy(F.xxhash64("at", "w", F.lit(seed)), "w"))).where(F.col("r") <= reverse).drop("r")
    return edges.select(F.col("node").alias("at"), "w", "fresh").unionByName(some).groupBy("at", "w").agg(F.max("fresh").alias("new"))


def graph(nodes: DataFrame, longest: float, kind: str, degree: int = DEGREE, reverse: int = REVERSE, changed: float = CHANGED, block: int = BLOCK) -> DataFrame:
    """node, w, s, fresh: the nearest other nodes found for each of nodes (node, code, further, sides).

    Rounds go on until no more than the share ``changed`` of the edges is new (fresh). No nodes
    give no rows, a lone one none either.
    """
    spark = nodes.sparkSession
    pair = "node long, w long, s double"
    met_in = lambda gathered, offered: gathered.mapInArrow(_compared(offered, longest, kind), pair).withColumn("fresh", F.lit(True))
    member = F.struct(F.col("node").alias("w"), F.lit(True).alias("new"), "code", "further", F.lit(-2.0).alias("least"))
    n = nodes.count()
    blocks = max(1, -(-n // block))
    random = nodes.select(F.lit(-1).alias("deal"), F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("block"), F.lit(0).alias("part"), member.alias("member"))
    sided = nodes.select("node", member.alias("member"), F.posexplode("sides").alias("deal", "block"))
    parts = sided.groupBy("deal", "block").agg(F.ceil(F.count("*") / (2 * block)).alias("parts"))
    sided = sided.join(parts, ["deal", "block"]).select("deal", "block", F.pmod(F.xxhash64("node", "deal"), "parts").cast("int").alias("part"), "member")
    dealt = random.unionByName(sided).groupBy("deal", "block", "part").agg(F.collect_list("member").alias("members")).select("members")
    edges = stored(_best(met_in(dealt, degree), degree), "graph")
    k = 0
    # An edge is only given up for a better one, so the rounds come to an end.
    while n > block:
        own = edges.groupBy("node").agg(F.when(F.count("*") >= degree, F.min("s")).otherwise(-2.0).alias("least"))
        known = nodes.join(own, "node", "left").select(F.col("node").alias("w"), "code", "further", F.coalesce("least", F.lit(-2.0)).alias("least"))
        # Places with something new, before any vector is joined with them.
        places = _gatherings(edges, reverse, k).groupBy("at").agg(F.collect_list(F.struct("w", "new")).alias("pairs")).where(F.exists("pairs", lambda x: x["new"]))
        met = places.select("at", F.inline("pairs")).join(known, "w").groupBy("at").agg(F.collect_list(F.struct("w", "new", "code", "further", "least")).alias("members")).select("members")
        after = stored(_best(edges.withColumn("fresh", F.lit(False)).unionByName(met_in(met, OFFERED)), degree), "graph")
        dropped(edges)
        edges, k = after, k + 1
        fresh, all_ = edges.agg(F.count_if("fresh"), F.count("*")).first()
        if fresh <= changed * all_:
            break
    return edges


def _adjacent(edges: DataFrame, reverse: int) -> DataFrame:
    """node, near: the ids of its neighbours and of some that it is a neighbour of."""
    return _gatherings(edges, reverse, 0).groupBy(F.col("at").alias("node")).agg(F.collect_list("w").alias("near"))


def _found(s: Column, w: Column, done: Column) -> Column:
    """In the answer's order, from the last on: by score, and of equal ones the smaller id is better."""
    return F.struct(s.alias("s"), F.negative(w).alias("order"), w.alias("w"), done.alias("done"))


def walk(queries: DataFrame, adjacent: DataFrame, nodes: DataFrame, kind: str, beam: int = BEAM, expanded: int = EXPANDED) -> DataFrame:
    """q, found (best first: s, order, w, done) of queries (q, q_code), each from its own node on."""
    none = F.lit(float("-inf"))
    codes = nodes.select(F.col("node").alias("w"), "code")
    few = queries.agg(F.sum(8 + F.length("q_code"))).first()[0] or 0
    asked = F.broadcast(queries) if few <= BROADCAST_BYTES else queries
    now = stored(queries.select("q", F.array(_found(none, F.col("q"), F.lit(False))).alias("found")), "beam")
    while True:
        open_ = F.filter("found", lambda x: ~x["done"])
        todo = F.slice(open_, F.lit(1), F.greatest(F.lit(1), F.least(F.lit(expanded), (F.size("found") / 4).cast("int"))))
        state = now.select("q", "found", F.transform(todo, lambda x: x["w"]).alias("todo"))
        if state.where(F.size("todo") > 0).isEmpty():
            return now
        front = state.select("q", F.explode("todo").alias("node")).join(adjacent, "node").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        least = F.when(F.size("found") >= beam, F.element_at("found", -1)["s"]).otherwise(none)
        new = state.join(front, "q").select("q", least.alias("least"), F.explode(F.array_except("near", F.transform("found", lambda x: x["w"]))).alias("w"))
        hits = new.join(codes, "w").join(asked, "q").select("q", "w", "least", "code", "q_code").mapInArrow(_scored(kind), "q long, w long, s double")
        met = hits.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(_found(F.col("s"), F.col("w"), F.lit(False))), False), 1, beam).alias("met"))
        old = F.transform("found", lambda x: _found(x["s"], x["w"], x["done"] | F.array_contains("todo", x["w"])))
        both = F.concat(old, F.coalesce("met", F.array().cast("array<struct<s:double,order:bigint,w:bigint,done:boolean>>")))
        after = stored(state.join(met, "q", "left").select("q", F.slice(F.sort_array(both, False), 1, beam).alias("found")), "beam")
        dropped(now)
        now = after


def neighbours(embeddings: DataFrame, queries: Column, k: int = NEAREST, degree: int = DEGREE, reverse: int = REVERSE, changed: float = CHANGED, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that ``queries`` chooses.

    ``queries`` is a condition on vec_id. A query's own row is no candidate, copies of its vector
    are. Rows that take no part (see usable) are neither queries nor candidates. Ties go to the
    smaller vec_id; with fewer than k candidates all are returned, with none no row. Other columns
    are not read.
    """
    small_batches(embeddings.sparkSession)
    with scratch(embeddings.sparkSession):
        return _searched(embeddings, queries, k, degree, reverse, changed, beam)


def _searched(embeddings: DataFrame, queries: Column, k: int, degree: int, reverse: int, changed: float, beam: int) -> DataFrame:
    spark = embeddings.sparkSession
    rows = stored(usable(embeddings), "vectors")
    classes = stored(rows.groupBy("vector").agg(F.min("vec_id").alias("node")), "nodes")
    first = classes.select(F.size("vector").alias("dim")).first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    longest, n = classes.agg(F.max(size), F.count("*")).first()
    bits = max(0, int(np.log2(max(1, n / BLOCK))))
    # Components are kept as they came, in single precision only where they were so.
    kind = "<f4" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    coded = lambda df, as_query: df.select("node", "vector").mapInArrow(_coded(first.dim, longest, bits, kind, as_query), "node long, code binary" + ("" if as_query else ", further double, sides array<bigint>"))
    nodes = stored(coded(classes, False), "codes")
    edges = graph(nodes, longest, kind, degree, reverse, changed)
    adjacent = stored(_adjacent(edges, reverse), "adjacent")
    dropped(edges)

    members = rows.join(classes, "vector").select("node", "vec_id")
    chosen = kept(stored(members.where(queries).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")), "queries"))
    asked = classes.join(chosen.select(F.col("q").alias("node")).distinct(), "node", "left_semi")
    asked = stored(coded(asked, True).select(F.col("node").alias("q"), F.col("code").alias("q_code")), "asked")
    found = walk(asked, adjacent, nodes, kind, beam)

    # The own node first, whatever its score, as its copies may be nearest. Of the others, all that
    # the order of summing could bring among the best k + 1, ties among them.
    doubt = 8 * first.dim * float(np.finfo(float).eps) * longest**2
    edge = F.element_at("found", F.least(F.lit(k + 1), F.size("found")))["s"] - doubt
    able = F.transform(F.filter("found", lambda x: x["s"] >= edge), lambda x: x["w"])
    pairs = found.select("q", F.explode(F.array_union(F.array("q"), able)).alias("w"))
    vector = lambda c: classes.select(F.col("node").alias(c), F.col("vector").alias(f"{c}_vector"))
    dot = F.aggregate(F.zip_with("q_vector", "w_vector", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.join(vector("q"), "q").join(vector("w"), "w").select("q", "w", dot.alias("score"))
    # Of equal vectors the k + 1 smallest ids can be in an answer.
    copies = members.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1).select(F.col("node").alias("w"), "vec_id")
    near = scored.join(copies, "w").withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).select("q", "vec_id", "score")
    near = kept(stored(near, "near"))
    out = chosen.join(near, "q").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return out


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of embeddings for each of its rows whose vec_id is divisible by 20."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
