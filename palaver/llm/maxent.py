"""Log-linear language model with hashed features and a class-factored softmax.

All shared words are leaves of a tree of classes, built from their counts so that frequent words lie
near its root; words beyond the shared ones are one leaf more. The chance of a word is the product
of the choices on its way down. Each choice is a softmax over weights that hashes of the class
chosen so far with the word before, the two words before, and the word before that one (a skip)
select. Within the last leaf a word has its smoothed unigram share, so that all chances add up to 1.

Counts come first, over the whole training part. The words that are shared, the rows of the table
of weights and the number of walks follow from them. A walk takes the shared weights through its own
texts in gradient steps; the moves of a row are averaged over the walks by how often each used it,
and shared again. Rounds deal the walks among them: each text is used once. Which texts a walk has,
and in which order, follows from their hashes, so the model does not depend on the partitions.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import dropped, fold, small_batches, stored, table
from palaver.llm.words import word_hashes

#: Choices at each class of the tree.
BRANCHES = 16
#: Rows of the table of weights, by training words for each row; powers of two within bounds.
WORDS_A_ROW, LEAST_ROWS, MOST_ROWS = 4, 2**14, 2**18
FEATURES = 3
#: Of eight pairs of a rate and of first squares the best, learned and measured within training rows.
ROUNDS, RATE = 2, 0.1
#: What a row's sum of squared slopes begins with.
FIRST_SQUARES = 1.0
#: Tokens of a gradient step.
STEP = 2**15
#: Tokens, or table rows, that a step's arithmetic goes over at once: their slots stay in a core's cache.
AT_ONCE = 2**12
#: Uses of a row in a step that are added up rank by rank.
RANKS = 8
#: Tokens of a walk, about.
WALK_TOKENS = 2**22
#: Words whose counts are broadcast, at most, at 16 bytes each, and as many for their ways.
SHARED_WORDS = 200_000
#: Parts that the weights are averaged in, partial sums of each at least, and walks for one more.
BLOCKS, SALTS, WALKS_A_SALT = 128, 8, 64
#: Distinct words that a task counts before it passes them on.
COUNTED = 500_000

END = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def hashes_of(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, then the end."""
    return np.append(word_hashes(text), END)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "c"])

    words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for batch in batches:
        texts = [hashes_of(t) for t in batch.column("text").to_pylist()]
        if not texts:
            continue
        own, c = np.unique(np.concatenate(texts), return_counts=True)
        merged, at = np.unique(np.concatenate([words, own]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, c]), len(merged)).astype(np.int64)
        words = merged
        if len(words) > COUNTED:
            yield out(words, counts)
            words, counts = words[:0], counts[:0]
    if len(words):
        yield out(words, counts)


def tree(mass: np.ndarray, branches: int = BRANCHES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, slots, biases) of a tree with a leaf for each mass, the heaviest nearest to its root.

    nodes and slots hold each leaf's way down, ended by -1; biases the log shares of a node's slots,
    very low where there is none. The lightest subtrees are put together first.
    """
    n = len(mass)
    heap = [(float(m), i) for i, m in enumerate(mass)]
    heapq.heapify(heap)
    # The first node takes as many as leave full ones above it.
    take, inner = 2 + (n - 2) % (branches - 1) if n > 1 else 1, []
    while len(heap) > 1 or not inner:
        own = [heapq.heappop(heap) for _ in range(min(take, len(heap)))]
        inner.append(own)
        heapq.heappush(heap, (sum(m for m, _ in own), n + len(inner) - 1))
        take = branches
    inner.reverse()  # the root first, so that a way is known before those that go on from it
    biases = np.full((len(inner), branches), -1e4, np.float32)
    ways: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    way_of = {n + len(inner) - 1: []}
    for k, own in enumerate(inner):
        way, all_ = way_of.pop(n + len(inner) - 1 - k), sum(m for m, _ in own)
        for slot, (m, child) in enumerate(sorted(own, key=lambda x: (-x[0], x[1]))):
            biases[k, slot] = np.log(m / all_)
            if child < n:
                ways[child] = [*way, (k, slot)]
            else:
                way_of[child] = [*way, (k, slot)]
    depth = max(map(len, ways))
    nodes, slots = np.full((n, depth), -1, np.int32), np.full((n, depth), -1, np.int8)
    for i, way in enumerate(ways):
        nodes[i, : len(way)], slots[i, : len(way)] = zip(*way, strict=True)
    return nodes, slots, biases


class Model:
    """Shared counts, ways and weights: what the tasks need, of bounded size."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int):
        self.words, self.counts, self.tokens, self.distinct = words, counts, tokens, distinct
        self.index: np.ndarray | None = None
        self.total = float(tokens + distinct + 1)
        #: Mass of the words that are not shared, unseen ones included; at least that of one.
        self.other = max(1.0, self.total - float((counts + 1.0).sum()))
        nodes, slots, self.biases = tree(np.append(counts + 1.0, self.other))
        # A level of all ways lies together, as steps go level by level.
        self.nodes, self.slots = np.asfortranarray(nodes), np.asfortranarray(slots)
        self.rows = int(min(MOST_ROWS, max(LEAST_ROWS, 2 ** int(np.ceil(np.log2(max(1, distinct / WORDS_A_ROW)))))))
        self.weights = np.zeros((self.rows, BRANCHES), np.float32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each word among the shared ones, or their number.

        A table of leading bits answers most look-ups; what it does not hold is searched for.
        """
        n = len(self.words)
        if not n:
            return np.zeros(len(h), np.int64)
        if self.index is None:
            self.index = np.zeros(2**20, np.int32)
            self.index[self.words >> np.uint64(44)] = np.arange(n)
        at = self.index[h >> np.uint64(44)]
        rest = np.flatnonzero(self.words[at] != h)
        more = np.searchsorted(self.words, h[rest])
        more[more == n] = 0
        at[rest] = np.where(self.words[more] == h[rest], more, n)
        return at


def _contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words in a row, and for each the hashes of its features; texts don't see each other."""
    h = np.concatenate(texts)
    one, two = np.zeros_like(h), np.zeros_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    starts = np.cumsum([0, *map(len, texts[:-1])])
    one[starts] = 0
    two[starts] = 0
    second = starts + 1
    two[second[second < len(h)]] = 0
    seeds = (one * np.uint64(3) + np.uint64(1), (one ^ (two * _MIX)) * np.uint64(5) + np.uint64(2), two * np.uint64(7) + np.uint64(3))
    f = np.stack([(s ^ (s >> np.uint64(31))) * _MIX for s in seeds])
    return h, f ^ (f >> np.uint64(29))


def _aligned(table: np.ndarray) -> np.ndarray:
    """A copy in which each row of 16 single-precision numbers is one line of the cache, not parts of two."""
    room = np.empty(table.nbytes + 64, np.uint8)
    begin = -room.ctypes.data % 64
    out = room[begin : begin + table.nbytes].view(table.dtype).reshape(table.shape)
    out[...] = table
    return out


def _choices(model: Model, weights: np.ndarray, biases: np.ndarray, place: np.ndarray, f: np.ndarray) -> Iterator[tuple]:
    """For each level of the tree: the tokens that have one, their slots, the rows that their features
    select, and the chances of all slots."""
    at = np.arange(len(place))
    selected = np.empty((min(AT_ONCE, len(place)), BRANCHES), np.float32)
    for level in range(model.nodes.shape[1]):
        node = model.nodes[:, level].take(place.take(at))
        if level:
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                return
        key = node.astype(np.uint64) * _MIX
        rows = ((((f.take(at, axis=1) if level else f) ^ key) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int32) & np.int32(model.rows - 1)
        chances = np.empty((len(at), BRANCHES), np.float32)
        for begin in range(0, len(at), AT_ONCE):
            z = chances[begin : begin + AT_ONCE]
            # Rows are in bounds; to clip them spares a copy of what is taken.
            np.take(biases, node[begin : begin + AT_ONCE], axis=0, out=z, mode="clip")
            for x in rows[:, begin : begin + AT_ONCE]:
                z += np.take(weights, x, axis=0, out=selected[: len(x)], mode="clip")
            np.exp(np.minimum(z, 60, out=z), out=z)
            z /= np.einsum("ij->i", z)[:, None]
        yield at, model.slots[:, level].take(place.take(at)), rows, chances


def _sorted_order(flat: np.ndarray) -> np.ndarray:
    """Where the values would lie in order: sorts of 16 bits are linear, so one or two of them."""
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    return order if flat.max() < 2**16 else order.take(np.argsort((flat.take(order) >> 16).astype(np.uint16), kind="stable"))


def _scattered(rows: np.ndarray, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table rows in use, their sums of slopes over all features together, and how often each is.

    Most rows are used once or twice, so first uses are taken together, then second ones, and so on;
    what rows of many uses have beyond is summed row by row. Rows come by falling numbers of uses.
    """
    flat = rows.reshape(-1)
    order = _sorted_order(flat)
    at = flat.take(order)
    order %= len(slopes)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[starts, len(at)])
    by = np.argsort(RANKS - np.minimum(n, RANKS + 1) + 1, kind="stable")
    starts, n = starts.take(by), n.take(by)
    sums = np.empty((len(n), BRANCHES), np.float32)
    with_more = [int((n > k).sum()) for k in range(RANKS + 1)]
    for begin in range(0, len(n), AT_ONCE):
        own, of = sums[begin : begin + AT_ONCE], starts[begin : begin + AT_ONCE]
        np.take(slopes, order.take(of), axis=0, out=own, mode="clip")
        for k in range(1, RANKS):
            m = with_more[k] - begin
            if m <= 0:
                break
            own[:m] += slopes.take(order.take(of[:m] + k), axis=0)
    if many := with_more[RANKS]:
        left = n[:many] - RANKS
        ends = np.cumsum(left)
        rest = np.arange(ends[-1]) + np.repeat(starts[:many] + RANKS - (ends - left), left)
        sums[:many] += np.add.reduceat(slopes.take(order.take(rest), axis=0).view(np.complex64), ends - left, axis=0).view(np.float32)
    return at.take(starts), sums, n


class _Walk:
    """Shared weights on their way through texts, in steps of equally many tokens."""

    def __init__(self, model: Model):
        self.model, self.weights, self.biases = model, _aligned(model.weights), _aligned(model.biases)
        self.squares = np.full(model.rows, FIRST_SQUARES, np.float32)
        self.used = np.zeros(model.rows, np.float32)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, texts: list[np.ndarray]) -> None:
        h, f = _contexts(texts)
        self.waiting.append((self.model.find(h), f))
        self.held += len(h)
        if self.held >= STEP:
            self.steps(self.held // STEP * STEP)

    def steps(self, upto: int) -> None:
        place, f = np.concatenate([x[0] for x in self.waiting]), np.concatenate([x[1] for x in self.waiting], axis=1)
        for at in range(0, upto, STEP):
            self.step(place[at : at + STEP], f[:, at : at + STEP])
        self.waiting, self.held = [(place[upto:], f[:, upto:])], len(place) - upto

    def step(self, place: np.ndarray, f: np.ndarray) -> None:
        """One gradient step; a row's rate falls with the squares of its own slopes."""
        for _, slot, rows, slopes in _choices(self.model, self.weights, self.biases, place, f):
            slopes.reshape(-1)[np.arange(0, slopes.size, BRANCHES) + slot] -= 1
            at, sums, n = _scattered(rows, slopes)
            self.used[at] += n
            for begin in range(0, len(at), AT_ONCE):
                own, g = at[begin : begin + AT_ONCE], sums[begin : begin + AT_ONCE]
                squares = self.squares.take(own) + np.einsum("ij,ij->i", g, g) / BRANCHES
                self.squares[own] = squares
                g *= (RATE / np.sqrt(squares))[:, None]
                self.weights[own] = np.subtract(self.weights.take(own, axis=0), g, out=g)

    def moved(self, walk: int, salts: int) -> pa.RecordBatch:
        if self.held:
            self.steps(self.held)
        moves = np.column_stack([(self.weights - self.model.weights) * self.used[:, None], self.used])
        parts = np.array_split(moves.astype(np.float32), BLOCKS)
        return pa.RecordBatch.from_arrays([pa.array([walk % salts] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["salt", "block", "moved"])


def _trained(shared, salts: int) -> Callable:
    """(salt, block, moves times uses, with the uses) of each walk; rows come sorted by walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, of = None, None
        for batch in batches:
            walks = batch.column("walk").to_numpy(zero_copy_only=False)
            texts = batch.column("text").to_pylist()
            cuts = [0, *(np.flatnonzero(walks[1:] != walks[:-1]) + 1).tolist(), len(texts)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if walks[begin] != of:
                    if walk:
                        yield walk.moved(int(of), salts)
                    walk, of = _Walk(shared.value), walks[begin]
                walk.add([hashes_of(t) for t in texts[begin:end]])
        if walk:
            yield walk.moved(int(of), salts)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums by block: memory does not depend on how many rows there are."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, moved in zip(batch.column("block").to_pylist(), batch.column("moved").to_pylist(), strict=True):
            part = np.frombuffer(moved, np.float32)
            sums[block] = sums[block] + part if block in sums else part.astype(np.float64)
    if sums:
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(keys), pa.int32()), pa.array(keys, pa.int32()), pa.array([sums[k].astype(np.float32).tobytes() for k in keys], pa.binary())], names=["salt", "block", "moved"])


def train(docs: DataFrame, rounds: int = ROUNDS, shared_words: int = SHARED_WORDS) -> tuple[Model, DataFrame]:
    """The model, and the table (word, c) of all counts, from the whole texts of docs.

    The driver gets the shared words and, in each round, one table of weights; both are bounded.
    Sums are taken in single precision, so their order may show in the last digits of a score.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", "text")
    counts = stored(texts.select("text").mapInArrow(_counted, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    # The least count of which so many words are shared, from a histogram by eighths of a power of 2.
    step = F.floor(F.log2("c") * 8).cast("int")
    bins = sorted(((r.b, r.n) for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = None, shared_words
    for b, n in bins:
        room -= n
        if room < 0:
            break
        least = b
    tokens, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    shared = counts.where(step >= (least if least is not None else 10**6)).toPandas()
    words = shared["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    model = Model(words[order], shared["c"].to_numpy(np.int64)[order], int(tokens or 0), int(distinct))
    walks = rounds * max(1, -(-model.tokens // (WALK_TOKENS * rounds)))
    salts = max(SALTS, walks // WALKS_A_SALT)
    place = F.xxhash64("doc_id", "text")
    dealt = texts.select("text", place.alias("place"), F.pmod(place, F.lit(walks)).cast("int").alias("walk"))
    for r in range(rounds if len(words) else 0):
        own = spark.sparkContext.broadcast(model)
        part = dealt.where(F.col("walk") % rounds == r).repartitionById(walks // rounds, F.floor(F.col("walk") / rounds).cast("int")).sortWithinPartitions("walk", "place").select("walk", "text")
        kind = "salt int, block int, moved binary"
        sums = part.mapInArrow(_trained(own, salts), kind).repartition(BLOCKS * salts // 4, "block", "salt").mapInArrow(_summed, kind).repartition(BLOCKS, "block").mapInArrow(_summed, kind)
        sums = stored(sums, "moves")
        moved = {x.block: np.frombuffer(x.moved, np.float32).reshape(-1, BRANCHES + 1) for x in sums.collect()}
        dropped(sums)
        if moved:
            moves = np.concatenate([moved[b] for b in range(BLOCKS)])
            model.weights = model.weights + moves[:, :BRANCHES] / np.maximum(1, moves[:, BRANCHES:])
        own.unpersist()
    return model, counts


_SCORED = "row long, doc_id long, n_tokens long, known long, logs double, model double, rare array<struct<word:bigint,n:bigint>>"


def _scored(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        with_c = np.log10(np.append(model.counts, 0) + 1.0)
        weights, biases = _aligned(model.weights), _aligned(model.biases)
        for batch in batches:
            texts = [hashes_of(t) for t in batch.column("text").to_pylist()]
            if not texts:
                continue
            h, f = _contexts(texts)
            place = model.find(h)
            logp = np.zeros(len(h))
            for at in range(0, len(h), STEP):
                for own, slot, _, chances in _choices(model, weights, biases, place[at : at + STEP], f[:, at : at + STEP]):
                    logp[at + own] += np.log10(np.maximum(chances.reshape(-1).take(np.arange(0, chances.size, BRANCHES) + slot), 1e-30))
            starts = np.cumsum([0, *map(len, texts[:-1])])
            total = lambda v: np.add.reduceat(v, starts)
            known = place < len(model.words)
            logs = with_c[place]
            at = np.flatnonzero(~known)
            of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[at]
            offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            words = pa.StructArray.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.ones(len(at), np.int64))], ["word", "n"])
            rare = pa.ListArray.from_arrays(pa.array(offsets), words)
            columns = [batch.column("row"), batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(total(known.astype(np.int64))), pa.array(total(logs)), pa.array(total(logp)), rare]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "known", "logs", "model", "rare"])

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document.

    Words beyond the shared ones are joined with the table of counts. Those not in it are no
    training words; they need no partner, so a word that only these texts repeat is no hot key of
    the result. A null text is an empty one: the end alone. Repeated rows and null ids give one row
    each. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    # Written once, so that a row keeps its number whatever is run again.
    found = stored(rows.mapInArrow(_scored(shared), _SCORED), "scored")
    rare = found.select("row", F.inline("rare"))
    known = rare.join(counts, "word").groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    out = found.join(known, "row", "left")
    more = F.coalesce("rare_logs", F.lit(0.0))
    beyond = F.col("n_tokens") - F.col("known")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(np.log10(model.total)))).alias("base_score"),
        (F.col("model") + more - beyond * F.lit(float(np.log10(model.other)))).alias("score"),
    )


def held_out_part() -> Column:
    return F.coalesce(fold("doc_id", 7) == 2, F.lit(False))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, by a model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model, counts = train(docs.where(fold("doc_id", 7) != 2))
    return score(docs, model, counts).withColumn("held_out", held_out_part()).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
