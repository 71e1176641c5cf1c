"""Han words that no lexicon knows: a hidden Markov model of four tags, fitted to the texts themselves.

A character begins a word (B), stands within one (M), ends one (E) or is one (S). It depends on its tag
and on the character before it. Spark fits the model by forward-backward passes over the distinct runs
of Han characters: each task returns the counts that it expects, which are summed by character before
they reach the driver, so what comes there follows the alphabet and not the texts. Words are read off
the likeliest tags by Viterbi decoding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.content import HAN, LATIN, path_of

B, M, E, S = range(4)
#: What may follow what; a run begins with B or S and ends with E or S.
ALLOWED = np.array([[0, 1, 1, 0], [0, 1, 1, 0], [1, 0, 0, 1], [1, 0, 0, 1]], float)
FIRST, LAST = np.array([1, 0, 0, 1], float), np.array([0, 0, 1, 1], float)
#: Observations that the chance of a character by its tag counts for beside that by its neighbour too.
BACKING = 2.0
#: Runs are passed in batches of about so many cells.
CELLS = 200_000
#: Characters of a piece of a longer run.
LONGEST_RUN = 2_000
#: Pairs of neighbours that the driver keeps, the most frequent ones; the others are seen by their tag alone.
MOST_PAIRS = 500_000


def _codes(runs: list[str]) -> np.ndarray:
    """The code points of all runs, one behind the other."""
    return np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)


def _keys(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each character its pair with the one before it, whose place is 0 where a run begins."""
    before = np.concatenate([[0], codes[:-1]]).astype(np.uint64)
    before[begins] = 0
    return (before << np.uint64(21)) | codes


def _place(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each key is in the sorted known ones; their number where it is not."""
    at = np.searchsorted(known, keys)
    return np.where(known[np.minimum(at, len(known) - 1)] == keys, at, len(known)) if len(known) else np.zeros(len(keys), np.int64)


def _inverse(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the place of each key among them."""
    place, known = pd.factorize(keys)
    return known, place


class Packed:
    """Runs side by side, longer ones first: all first characters, then all second ones, and so on.

    So the runs that reach place t are the first ones of those that reach the place before it, and
    nothing is stored or computed beyond a run's end. order has the places of the runs as they were
    given, begins that of the first character of each place (and the number of all), cell that of each
    character, run by run in this order; ends those of the runs' last characters.
    """

    def __init__(self, runs: list[str]):
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.text = "".join([runs[i] for i in self.order])
        self.first = np.cumsum(self.sizes) - self.sizes
        reach = len(runs) - np.cumsum(np.bincount(sizes))[:-1]
        self.begins = np.concatenate([[0], np.cumsum(reach)])
        run = np.repeat(np.arange(len(runs)), self.sizes)
        self.cell = self.begins[np.arange(len(run)) - self.first[run]] + run
        self.ends = self.begins[self.sizes - 1] + np.arange(len(runs))

    def keys(self) -> np.ndarray:
        """By cell."""
        out = np.empty(len(self.cell), np.uint64)
        out[self.cell] = _keys(_codes([self.text]), self.first)
        return out

    def places(self) -> list[tuple[int, int, int, int]]:
        """Of each place: where the one before it begins, where it begins and ends, and how many runs go on."""
        b = self.begins.tolist()
        return [(b[max(t - 1, 0)], b[t], b[t + 1], b[t + 2] - b[t + 1] if t + 2 < len(b) else 0) for t in range(len(b) - 1)]


@dataclass
class Tagger:
    """Chances of steps between tags and of letters (sorted code points) by tag, counts of pairs by tag.

    The arrays by letter and by pair have a last row for those that are not known.
    """

    steps: np.ndarray
    letters: np.ndarray
    by_tag: np.ndarray
    pairs: np.ndarray
    by_pair: np.ndarray
    before: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        """keys x tags; each key is a character with the one before it."""
        found = self.by_tag[_place((keys & np.uint64(2**21 - 1)).astype(np.uint32), self.letters)]
        if len(self.pairs):
            before = (keys >> np.uint64(21)).astype(np.uint32)
            seen = self.by_pair[_place(keys, self.pairs)]
            came = self.before[_place(before, self.letters)]
            found = np.where(before[:, None] > 0, (seen + BACKING * found) / (came + BACKING), found)
        return found

    def chances(self, runs: list[str]) -> np.ndarray:
        """runs x length x tags; 1 beyond a run's end."""
        sizes = np.array([len(r) for r in runs])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out = np.ones((len(runs), int(sizes.max()), 4))
        out[np.arange(out.shape[1]) < sizes[:, None]] = self.of(_keys(_codes(runs), begins))
        return out


def _edged(packed: Packed, chances: np.ndarray) -> np.ndarray:
    """tags x cells, without the tags that no run begins or ends with."""
    chances[:, : len(packed.order)] *= FIRST[:, None]
    chances[:, packed.ends] *= LAST[:, None]
    return chances


def _forward_backward(packed: Packed, weights: np.ndarray, chances: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected steps (tags x tags), and the chance of each tag of each cell (tags x cells); weights: by packed run."""
    forward, scale, places = np.empty_like(chances), np.empty(chances.shape[1]), packed.places()
    for before, a, b, _ in places:
        now = (steps.T @ forward[:, before : before + b - a]) * chances[:, a:b] if a else chances[:, a:b]
        scale[a:b] = np.maximum(now.sum(0), 1e-300)
        np.divide(now, scale[a:b], out=forward[:, a:b])
    chances /= scale
    tags, taken, back = forward.copy(), np.zeros((4, 4)), np.empty((4, 0))
    for before, a, b, more in reversed(places):
        tags[:, a : a + more] *= back
        if a:
            after = chances[:, a:b]
            after[:, :more] *= back
            taken += (forward[:, before : before + b - a] * weights[: b - a]) @ after.T
            back = steps @ after
    return taken * steps, tags


def expected(runs: list[str], weights: np.ndarray, model: Tagger) -> tuple[np.ndarray, np.ndarray]:
    """Expected steps (tags x tags), and the chance of each tag of each character (runs x length x tags)."""
    packed = Packed(runs)
    steps, tags = _forward_backward(packed, weights[packed.order], _edged(packed, model.of(packed.keys()).T.copy()), model.steps)
    run = np.repeat(packed.order, packed.sizes)
    out = np.zeros((len(runs), int(packed.sizes[0]), 4))
    out[run, np.arange(len(run)) - np.repeat(packed.first, packed.sizes)] = tags[:, packed.cell].T
    return steps, out


def decoded(runs: list[str], model: Tagger) -> list[list[str]]:
    """The words of the likeliest tags of each run."""
    packed = Packed(runs)
    known, place = _inverse(packed.keys())
    with np.errstate(divide="ignore"):
        chances, steps = np.log(_edged(packed, model.of(known).T[:, place])), np.log(model.steps)
    places = packed.places()
    came, last = np.zeros(chances.shape, np.int8), np.empty(len(runs), np.int8)
    now = np.empty((4, 0))
    for _, a, b, more in places:
        if a:
            then, now = now[:, : b - a], chances[:, a:b].copy()
            for tag, (one, other) in enumerate(((E, S), (B, M), (B, M), (E, S))):
                x, y = then[one] + steps[one, tag], then[other] + steps[other, tag]
                came[tag, a:b] = np.where(y > x, other, one)
                now[tag] += np.maximum(x, y)
        else:
            now = chances[:, a:b]
        last[more : b - a] = np.where(now[S, more:] > now[E, more:], S, E)
    begin, tag = np.empty(chances.shape[1], bool), np.empty(0, np.int8)
    for _, a, b, more in reversed(places):
        tag = np.concatenate([tag, last[more : b - a]])
        begin[a:b] = (tag == B) | (tag == S)
        tag = came[tag, np.arange(a, b)]
    begin[: len(runs)] = True
    cuts = np.append(np.flatnonzero(begin[packed.cell]), len(packed.text)).tolist()
    words = [packed.text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    ends = np.searchsorted(cuts, packed.first + packed.sizes).tolist()
    out: list[list[str]] = [[] for _ in runs]
    for i, a, b in zip(packed.order.tolist(), [0, *ends], ends, strict=False):
        out[i] = words[a:b]
    return out


def _batches(runs: list[str]) -> Iterator[np.ndarray]:
    """Places of runs, neighbours in length together."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    order = np.argsort(sizes, kind="stable")
    if len(order):
        yield from np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // CELLS)) + 1)


def han_runs(messages: DataFrame) -> DataFrame:
    """run, n: the distinct runs of Han characters and how often they occur; long ones in pieces."""
    pieces = F.flatten(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{HAN}+"), F.lit(0)), lambda r: F.regexp_extract_all(r, F.lit(f".{{1,{LONGEST_RUN}}}"), F.lit(0))))
    return messages.select(F.explode(pieces).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


#: Sums by key and tag.
_COUNTS = "key long, t0 double, t1 double, t2 double, t3 double"
_TAGS = ["t0", "t1", "t2", "t3"]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and their counts (tags x keys)."""
    known, place = _inverse(keys)
    return known, np.stack([np.bincount(place, c, len(known)) for c in counts])


def _frame(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"key": keys.astype(np.int64)} | dict(zip(_TAGS, counts, strict=True)))


def _expecting(model: Tagger) -> Callable:
    """Expected counts by tag: of each pair of neighbours, and under the keys -1 to -4 of steps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = np.zeros((4, 4))
        for pdf in batches:
            runs, weights = pdf.run.tolist(), pdf.n.to_numpy(float)
            found = []
            for at in _batches(runs):
                packed = Packed([runs[i] for i in at])
                own = weights[at][packed.order]
                known, place = _inverse(packed.keys())
                s, tags = _forward_backward(packed, own, _edged(packed, model.of(known).T[:, place]), model.steps)
                steps += s
                for _, a, b, _ in packed.places():
                    tags[:, a:b] *= own[: b - a]
                found.append((known, np.stack([np.bincount(place, c, len(known)) for c in tags])))
            if found:
                yield _frame(*_summed(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found], 1)))
        yield _frame(np.array([-1, -2, -3, -4]), steps.T)

    return run


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each character how often it occurs, begins a run and ends one."""
    for pdf in batches:
        if len(pdf):
            codes, weights = _codes(pdf.run.tolist()).astype(np.int64), pdf.n.to_numpy(float)
            ends = np.cumsum(pdf.run.str.len().to_numpy())
            counts = np.zeros((4, len(codes)))
            counts[0] = np.repeat(weights, np.diff(ends, prepend=0))
            counts[1, np.concatenate([[0], ends[:-1]])] = weights
            counts[2, ends - 1] = weights
            yield _frame(*_summed(codes, counts))


def _sums(runs: DataFrame, counting: Callable) -> DataFrame:
    return runs.mapInPandas(counting, _COUNTS).groupBy("key").agg(*[F.sum(t).alias(t) for t in _TAGS])


def _model(sums: DataFrame, most_pairs: int) -> Tagger:
    """The model of summed counts: those of letters come whole, those of pairs the most frequent."""
    steps = np.zeros((4, 4))
    for r in sums.where("key < 0").collect():
        steps[-1 - r.key] = r[1:]
    steps = (steps + 0.1) * ALLOWED
    letter = F.pmod("key", F.lit(2**21)).alias("letter")
    letters = sums.where("key >= 0").groupBy(letter).agg(*[F.sum(t).alias(t) for t in _TAGS]).orderBy("letter").collect()
    by_tag = np.array([list(r[1:]) for r in letters] + [[0.0] * 4]) + 0.01
    pairs = sums.where(F.col("key") >= 2**21).orderBy(F.desc(F.col("t0") + F.col("t1") + F.col("t2") + F.col("t3")), "key").limit(most_pairs).orderBy("key").collect()
    codes, keys = np.array([r.letter for r in letters], np.uint32), np.array([r.key for r in pairs], np.uint64)
    by_pair, before = np.array([list(r[1:]) for r in pairs] + [[0.0] * 4]), np.zeros((len(letters) + 1, 4))
    np.add.at(before, _place((keys >> np.uint64(21)).astype(np.uint32), codes), by_pair[:-1])
    return Tagger(steps / steps.sum(1, keepdims=True), codes, by_tag / by_tag.sum(0), keys, by_pair, before)


def _started(runs: DataFrame, mean_length: float, singles: float) -> Tagger:
    """What is sure without any word: a run's first character begins a word and its last one ends one."""
    rows = _sums(runs, _edges).orderBy("key").collect()
    by_tag = np.array([[r.t1 + 0.01 * r.t0, r.t0, r.t2 + 0.01 * r.t0, r.t0] for r in rows] + [[0.01] * 4], float)
    end = 1 / max(1.0, mean_length - 1)
    steps = np.array([[0, 1 - end, end, 0], [0, 1 - end, end, 0], [1 - singles, 0, 0, singles], [1 - singles, 0, 0, singles]])
    return Tagger(steps, np.array([r.key for r in rows], np.uint32), by_tag / by_tag.sum(0), np.empty(0, np.uint64), np.zeros((1, 4)), np.zeros((len(rows) + 1, 4)))


def dealt(rows: DataFrame) -> DataFrame:
    """rows in even parts for all cores: what follows takes its time by character, not by byte of a file."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def fit(messages: DataFrame, rounds: int = 6, mean_length: float = 3.0, singles: float = 0.1, most_pairs: int = MOST_PAIRS) -> Tagger:
    """A model of the texts of messages.

    It starts from the edges of runs and from how long words of more than one character are and how
    often one is a single character; both are fitted too. Each round is one pass over the distinct
    runs, which are found once and kept meanwhile; the first one sees characters by their tag alone.
    Without Han characters it takes every character for a word.
    """
    runs = dealt(han_runs(messages)).persist()
    try:
        model = _started(runs, mean_length, singles)
        for _ in range(rounds if len(model.letters) else 0):
            sums = _sums(runs, _expecting(model)).persist()
            try:
                model = _model(sums, most_pairs)
            finally:
                sums.unpersist()
    finally:
        runs.unpersist()
    return model


def tokens(text: Column, model: Tagger, lexicon: dict[str, int] | None = None, latin: str = "ascii") -> Column:
    """Words in order, as content.tokens() gives them, Han runs cut by the model.

    With a lexicon, runs are cut along its likeliest path first, and the model cuts what that leaves in
    neighbouring single characters.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{HAN}+|{LATIN[latin]}"), F.lit(0))
    likely = path_of(lexicon) if lexicon else None

    @F.pandas_udf("array<string>")
    def cut(rows: pd.Series) -> pd.Series:
        # Of each row the words that are sure, and None and the place of a piece where the model decides.
        pieces: list[str] = []
        plan: list[list[tuple[str | None, int]]] = []

        def unknown(run: str, to: list) -> None:
            for k in range(0, len(run), LONGEST_RUN):
                to.append((None, len(pieces)))
                pieces.append(run[k : k + LONGEST_RUN])

        for rs in rows:
            own: list[tuple[str | None, int]] = []
            for r in rs:
                if not "一" <= r[0] <= "鿕":
                    own.append((r, 0))
                elif likely is None:
                    unknown(r, own)
                else:
                    for single, words in groupby(likely(r), lambda w: len(w) == 1):
                        words = list(words)
                        if single and len(words) > 1:
                            unknown("".join(words), own)
                        else:
                            own += [(w, 0) for w in words]
            plan.append(own)
        found: list[list[str]] = [[] for _ in pieces]
        for at in _batches(pieces):
            for k, w in zip(at, decoded([pieces[k] for k in at], model), strict=True):
                found[k] = w
        return pd.Series([[w for sure, k in own for w in ([sure] if sure is not None else found[k])] for own in plan], dtype=object)

    return cut(runs)
