"""Embedding whitening by cyclic Jacobi rotations.

Three passes over the vectors, each summed within its task before anything is shuffled: counts and
sums, the scatter around the mean, and, once the components are known, the covariance of what they
make of the vectors. The driver gets dims x dims sums alone, whatever the number of vectors, turns the
covariance until nothing is left off its diagonal, and broadcasts the sorted components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.common import table

# An entry c becomes floor(64 c) + 1,000,000.
STEPS, SHIFT = 64, 1_000_000
#: Components that are returned.
MOST = 32
#: Entries beyond this have no such number in a long that can be summed.
LARGEST = 2.0**40
#: Share of the largest eigenvalue under which one is rounding alone, for each dimension.
NOTHING = 4 * np.finfo(float).eps
SWEEPS = 60
#: Rows of a matrix product.
ROWS = 4096
#: Up to this, a sum of squares in double precision proves that the exact one fits a long.
SURE = 9.2e18


def jacobi(a: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    A sweep turns every pair of axes once, in the rounds of a tournament whose pairs share no axis and
    so turn together. An entry counts as gone when it is lost beside the diagonal entries of its own
    row and column, not beside the largest, which keeps small eigenvalues accurate. At least one sweep
    without a turn ends it.
    """
    a = np.array(a, float)
    d = len(a)
    v, players = np.eye(d), list(range(d + d % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = [sorted(x) for x in zip(players[:half], reversed(players[half:]), strict=True) if max(x) < d]
            players.insert(1, players.pop())
            if not pairs:
                continue
            p, q = np.array(pairs).T
            off, low, high = a[p, q], a[p, p], a[q, q]
            on = np.abs(off) > np.finfo(float).eps * np.sqrt(np.abs(low)) * np.sqrt(np.abs(high))
            p, q, off, low, high = p[on], q[on], off[on], low[on], high[on]
            if not len(p):
                continue
            turned = True
            with np.errstate(over="ignore"):
                theta = (high - low) / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[p, q] = a[q, p] = 0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


@dataclass
class Whitening:
    """Fitted numbers: n vectors, sums of their x, covariance, eigenvalues and components by row."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def scaled(self) -> np.ndarray:
        """dims x components: the projection, over the root of the eigenvalue; NaN where that is none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.components / np.sqrt(self.values)[:, None]).T

    @property
    def middle(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and what is left, so that centring by both loses nothing."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, whole, strict=True)])


def whole(vector: Column) -> Column:
    """The entries as longs; null for those that have none, as Spark may look before it leaves rows out."""
    return F.transform(vector, lambda c: F.when(F.abs(c) <= LARGEST, F.floor(c.cast("double") * STEPS) + F.lit(SHIFT).cast("long")))


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with x, the entries as longs, of the rows whose vector is whole, finite and small enough.

    Vectors of another length than most are left out (of equally frequent lengths the smallest
    stays); so are null ones and those with null, non-finite or absolutely larger entries than
    LARGEST. A column x of df is replaced.
    """
    v = F.col(vector)
    good = df.where(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)))
    lengths = good.groupBy(F.size(v).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    good = good.where(F.size(v) == (lengths["size"] if lengths else 0))
    return good.withColumn("x", whole(v))


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    """The vectors of a task, some rows at a time, as matrices of longs."""
    for batch in batches:
        flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        for k in range(0, len(flat), ROWS):
            yield flat[k : k + ROWS]


def _summed(rows: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[int, np.ndarray]:
    """How many vectors there are, and the sum over them all of part(matrix), a matrix of that width.

    Each task sends one partial matrix, row by row.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for m in _matrices(batches, dims):
            n, total = n + len(m), total + part(m)
        if n:
            yield pa.RecordBatch.from_pydict({"i": range(len(total)), "n": [n] * len(total), "row": list(total)}, pa.schema([("i", pa.int32()), ("n", pa.int64()), ("row", pa.list_(pa.float64()))]))

    cells = rows.mapInArrow(partial, "i int, n long, row array<double>").select("i", "n", F.posexplode("row").alias("j", "v"))
    found = cells.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    out = np.zeros((1 + max((r.i for r in found), default=-1), width))
    for r in found:
        out[r.i, r.j] = r.v
    return (found[0].n if found else 0), out


def fit(rows: DataFrame, most: int = MOST) -> Whitening | None:
    """Components of the x of rows; None where there is no vector or none with an entry."""
    dims = (rows.select(F.size("x").alias("d")).first() or [0])[0]
    if not dims:
        return None
    sums = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    n, by_place = sums[0].n, {r.i: int(r.s) for r in sums}
    out = Whitening(n, [by_place[i] for i in range(dims)], *[np.empty(0)] * 4)
    mean, rest = out.middle

    def scatter(m: np.ndarray) -> np.ndarray:
        y = (m - mean) - rest
        return y.T @ y

    _, total = _summed(rows.select("x"), dims, scatter, dims)
    out.covariance = (total + total.T) / (2 * n)
    values, vectors = jacobi(out.covariance)
    trace, k = np.trace(out.covariance), min(most, dims)
    none = values[:k] <= NOTHING * dims * max(values[0], 0)
    out.values, out.components = np.where(none, np.nan, values[:k]), vectors[:, :k].T
    out.explained = np.where(none, 0.0, values[:k]) / trace if trace > 0 else np.full(k, np.nan)
    return out


def project(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """rows with whitened, an array of the components' values (null for one without variance), in place of x."""
    sent = rows.sparkSession.sparkContext.broadcast((*fitted.middle, fitted.scaled))
    fields = rows.drop("x").schema.fields

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, rest, scaled = sent.value
        for batch in batches:
            parts = [((m - mean) - rest) @ scaled for m in _matrices([batch], len(mean))]
            flat = np.concatenate(parts).ravel() if parts else np.empty(0)
            values = pa.array(flat, pa.float64(), mask=np.isnan(flat))
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * scaled.shape[1])
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(at, values)], names=[*names, "whitened"])

    schema = T.StructType([*fields, T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.select(*[f.name for f in fields], "x").mapInArrow(projected, schema)


def identity_error(rows: DataFrame, fitted: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors of rows, less the identity.

    It is measured on all of them, around their own mean; components without variance don't count.
    """
    mean, rest = fitted.middle
    scaled = fitted.scaled[:, ~np.isnan(fitted.values)]
    if not scaled.shape[1]:
        return None

    def moments(m: np.ndarray) -> np.ndarray:
        w = ((m - mean) - rest) @ scaled
        w = np.hstack([w, np.ones((len(w), 1))])
        return w.T @ w

    _, total = _summed(rows.select("x"), fitted.dims, moments, scaled.shape[1] + 1)
    centre = total[-1, :-1] / fitted.n
    return float(np.abs(total[:-1, :-1] / fitted.n - np.outer(centre, centre) - np.eye(len(centre))).max())


def deviation(x: Column, fitted: Whitening) -> Column:
    """The sum over dimensions of (n x - sum)^2: exact, or null where it may not fit a long.

    n x - sum is n (x - mean) less a remainder; in double precision first, which shows whether it fits.
    """
    mean = [int(m) for m in fitted.middle[0]]
    left = [s - fitted.n * m for s, m in zip(fitted.sums, mean, strict=True)]
    place = F.arrays_zip(x.alias("x"), F.array(*[F.lit(m).cast("long") for m in mean]).alias("m"), F.array(*[F.lit(r).cast("long") for r in left]).alias("r"))
    n = F.lit(fitted.n).cast("long")
    rough = F.aggregate(place, F.lit(0.0), lambda s, p: s + F.pow((p["x"] - p["m"]).cast("double") * n - p["r"], F.lit(2.0)))
    step = lambda p: (p["x"] - p["m"]) * n - p["r"]
    return F.when(rough <= SURE, F.aggregate(place, F.lit(0).cast("long"), lambda s, p: s + step(p) * step(p)))


def whitened(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row a vector and component.

    Rows that usable() leaves out give none; so does a table without vectors. Repeated rows count as
    often as they stand there; a null id stays null. A component without variance has whitened null
    and explains 0; where no vector differs, explained and identity_error are null as well.
    deviation is null where it is too large for a long, from some 2e9 vectors on as a rule.
    """
    rows = usable(df.select(vec_id, vector), vector).select(vec_id, "x")
    fitted = fit(rows, most)
    if fitted is None:
        return df.sparkSession.createDataFrame([], f"`{vec_id}` {dict(df.dtypes)[vec_id]}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(rows, fitted)
    out = project(rows.select(vec_id, deviation(F.col("x"), fitted).alias("deviation"), "x"), fitted)
    share = F.array(*[F.lit(None if np.isnan(e) else float(e)).cast("double") for e in fitted.explained])
    out = out.select(vec_id, "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select(vec_id, (F.col("k") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened vectors of the whole table, fitted to all of it."""
    return whitened(table(spark, sf_dir, "embeddings"))
