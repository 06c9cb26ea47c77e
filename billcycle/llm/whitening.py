"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers (a fixed grid), and the vectors fitted are the distinct ones. Their centred rows X are never formed as a matrix:
each step is a pass for X v and the transpose times u, in which every task works on its own rows and returns sums as wide as a vector.
The left vector u has an entry for every row, so it isn't stored: u = X w for a w as wide as a vector, and a task makes the
entries of u, and of all earlier left vectors for the full reorthogonalisation, from its rows. Right vectors are reorthogonalised on
the driver. Where the process ends early (a step leaves nothing) it goes on with a random vector orthogonal to all before, so that equal
eigenvalues are all found. It ends when the wanted components are found and the variance outside of the right vectors is too small to hide
another, or when these span the whole space: as many passes as a vector has entries at most. X V = U B with a small upper bidiagonal B, whose singular
value decomposition gives the components V q and the deviations s / sqrt(n).

Sums of the whole numbers, and the deviation of each row, are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billcycle.llm.common import scratch, table

GRID = 256
COMPONENTS = 4
#: Sums of so many tasks are added on the driver; those of more tasks are added by position in a shuffle first.
DIRECT = 512
#: A step that leaves less than this part of the largest deviation leaves nothing.
NOTHING = 1e-13
#: Whole numbers from here on are not told apart from their neighbours in a long.
LARGEST = float(1 << 62)


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The column x as a matrix of longs."""
    column = batch.column("x")
    return np.asarray(column.flatten()).reshape(len(column), width)


def summed(rows: DataFrame, width: int, tasks: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``part`` makes of the rows of a batch: ``size`` doubles (or longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_rows(batch, width))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "value"])

    kind = "long" if part(np.zeros((1, width), np.int64)).dtype == np.int64 else "double"
    parts = rows.select("x").mapInArrow(run, f"place int, value {kind}")
    if tasks > DIRECT:
        parts = parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value")).alias("value"))
    total = np.zeros(size, object if kind == "long" else float)
    found = parts.toArrow()
    for place, value in zip(found.column("place").to_pylist(), found.column("value").to_pylist(), strict=True):
        total[place] += int(value) if kind == "long" else value
    return total


class Centre:
    """The exact mean of whole-numbered rows: total / n = whole + part / n."""

    def __init__(self, n: int, total: list[int]) -> None:
        self.n = n
        self.whole = np.array([s // n for s in total], np.int64)
        self.part = [s % n for s in total]
        self.fraction = np.array([r / n for r in self.part])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - total)^2 of each row; None where it is beyond a long."""
        y = x - self.whole
        most = int(max(y.max(initial=0), -y.min(initial=0))) * self.n + self.n
        if most * most * x.shape[1] < 1 << 63:
            return ((y * self.n - np.array(self.part, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((v * self.n - r) ** 2 for v, r in zip(row, self.part, strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def bidiagonalised(rows: DataFrame, width: int, tasks: int, centre: Centre, trace: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """V with orthonormal columns and the upper bidiagonal B of X V = U B, for the centred rows X whose squares add up to ``trace``."""
    random = np.random.default_rng(width)
    right, b = np.zeros((width, 0)), np.zeros((0, 0))
    left, images = np.zeros((width, 0)), np.zeros((width, 0))  # w of each left vector, and the transpose's product with it
    largest, rest = 0.0, np.zeros(width)

    def orthogonal(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    for k in range(width):
        beta = float(np.linalg.norm(rest))
        if beta <= NOTHING * largest:
            beta, rest = 0.0, orthogonal(random.standard_normal(width))
        v = rest / np.linalg.norm(rest)
        w = v - beta * left[:, -1] if beta else v

        def products(x: np.ndarray, w=w, left=left) -> np.ndarray:
            c = centre.centred(x)
            u = c @ w
            return np.concatenate([[u @ u], (c @ left).T @ u, c.T @ u])

        size, *found = summed(rows, width, tasks, 1 + k + width, products)
        inside, image = np.array(found[:k]), np.array(found[k:])
        # u without what it holds of earlier left vectors; the same for its product, which is linear in u
        w, image = w - left @ inside, image - images @ inside
        alpha = float(np.sqrt(max(size - inside @ inside, 0.0)))
        largest = max(largest, alpha, beta)
        b = np.pad(b, (0, 1))
        b[k, k], b[k - 1, k] = (alpha, beta if k else alpha)
        right = np.column_stack([right, v])
        if alpha <= NOTHING * largest:  # the rows have nothing in this direction
            b[k, k] = 0.0
            left, images, rest = np.column_stack([left, np.zeros(width)]), np.column_stack([images, np.zeros(width)]), np.zeros(width)
            continue
        left, images = np.column_stack([left, w / alpha]), np.column_stack([images, image / alpha])
        rest = orthogonal(image / alpha - alpha * v)
        if _found(b, float(np.linalg.norm(rest)), trace, wanted):
            break
    return right, b


def _found(b: np.ndarray, beta: float, trace: float, wanted: int) -> bool:
    """Whether the wanted components are found to double precision, and nothing outside of V can be larger.

    An eigenvalue that isn't found is at most the largest one of the others in V and all the variance outside of V together.
    """
    if len(b) <= wanted:
        return False
    p, s, _ = np.linalg.svd(b)
    outside = max(trace - float((s**2).sum()), 0.0) + trace * 1e-12
    return bool((beta * np.abs(p[-1, :wanted]) <= NOTHING * s[0]).all() and s[wanted] ** 2 + outside < s[wanted - 1] ** 2)


class Whitening:
    """The fitted components (width, k), their eigenvalues, the trace, and the centre."""

    def __init__(self, rows: DataFrame, width: int, components: int) -> None:
        tasks = rows.select(F.spark_partition_id().alias("task")).distinct().count()
        low = (1 << 31) - 1
        halves = summed(rows, width, tasks, 2 * width + 1, lambda x: np.concatenate([(x >> 31).sum(axis=0), (x & low).sum(axis=0), [len(x)]]))
        n = int(halves[-1])
        self.centre = Centre(n, [(int(halves[i]) << 31) + int(halves[width + i]) for i in range(width)])
        self.width, self.n = width, n
        squares = float(summed(rows, width, tasks, 1, lambda x, centre=self.centre: np.array([np.square(centre.centred(x)).sum()]))[0])
        self.trace = squares / n
        right, b = bidiagonalised(rows, width, tasks, self.centre, squares, components)
        _, deviations, q = np.linalg.svd(b)
        some = int((deviations > NOTHING * max(deviations[0], 1e-300) * width).sum())
        k = min(components, some)
        vectors = right @ q.T[:, :k]
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
        self.vectors, self.values = vectors * signs, deviations[:k] ** 2 / n
        self.error = self._error(rows, tasks) if k else 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)

    def _error(self, rows: DataFrame, tasks: int) -> float:
        """Largest entry of the whitened rows' covariance minus the identity."""
        k = len(self.values)

        def part(x: np.ndarray) -> np.ndarray:
            y = self.whitened(x)
            return np.concatenate([y.sum(axis=0), (y.T @ y).reshape(-1)])

        total = summed(rows, self.width, tasks, k + k * k, part) / self.n
        mean = total[:k]
        return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, grid: int = GRID) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row of vectors (vec_id, embedding) and component.

    Entries become floor(grid * entry). Fitted are the distinct vectors, n of them. whitened is the centred vector's product with the component
    over the square root of its eigenvalue, explained the eigenvalue's share of the variance. deviation is null where it is
    beyond a long. Components without variance are left out, so vectors that are all equal give no rows, nor do empty vectors.
    Rows whose vector is null or holds null or non-finite entries, or entries beyond a long on the grid, are left out. Vectors of each length are
    fitted on their own, one length after the other. Every other row counts, also one that repeats another's id or has none;
    more columns of vectors are ignored, and an empty table gives an empty result.
    """
    values = F.col("embedding").cast("array<double>")
    usable = F.coalesce(F.forall(values, lambda v: v.isNotNull() & (F.abs(v * grid) < LARGEST)), F.lit(False))
    # adding nothing: -0.0 becomes a whole 0 like 0.0
    x = F.transform(values, lambda v: F.floor(v * grid).cast("long"))
    rows = vectors.select("vec_id", F.when(usable, values).alias("embedding")).where("embedding is not null")
    rows = scratch(rows.select("vec_id", x.alias("x")))
    found = vectors.sparkSession.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {SCHEMA}")
    widths = [r["width"] for r in rows.groupBy(F.size("x").alias("width")).count().collect()]
    distinct = scratch(rows.select("x").distinct())
    for width in sorted(w for w in widths if w):
        own = F.size("x") == width
        fitted = Whitening(distinct.where(own), width, components)
        found = found.unionByName(_transformed(rows.where(own), fitted))
    return found


def _transformed(rows: DataFrame, fitted: Whitening) -> DataFrame:
    k = len(fitted.values)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        names = ["vec_id", *SCHEMA.replace(" int", "").replace(" long", "").replace(" double", "").split(", ")]
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _rows(batch, fitted.width)
            times = batch.num_rows * k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(batch.num_rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(times, fitted.n)),
                    pa.array([v for v in fitted.centre.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(fitted.whitened(x).reshape(-1)),
                    pa.array(np.tile(fitted.values / fitted.trace, batch.num_rows) if k else np.empty(0)),
                    pa.array(np.full(times, fitted.error)),
                ],
                names=names,
            )

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {SCHEMA}")


def op13_whitening(spark, folder) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
