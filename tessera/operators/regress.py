"""Linear regressions as aggregations, and scoring by a table of coefficients."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import checkpointed


def inverse_weight(y: Column, small: float = 1e-6) -> Column:
    """1 / (y + small): least squares with it goes for relative errors."""
    return F.try_divide(F.lit(1.0), y + small)


def line_fit(df: DataFrame, x: str, y: str, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., slope, intercept) of weighted least squares on one feature; null where x does not vary."""
    w = F.lit(1.0) if weight is None else weight
    t = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), w.alias("_w")).dropna(subset=["_x", "_y", "_w"])
    m = t.groupBy(*by).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_x")).alias("x"), F.sum(F.col("_w") * F.col("_y")).alias("y"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_w") * F.col("_x") * F.col("_y")).alias("xy"))
    slope = F.try_divide(F.col("w") * F.col("xy") - F.col("x") * F.col("y"), F.col("w") * F.col("xx") - F.col("x") * F.col("x"))
    return m.withColumn("slope", slope).select(*by, "slope", F.try_divide(F.col("y") - F.col("slope") * F.col("x"), F.col("w")).alias("intercept"))


def ols(df: DataFrame, features: Sequence[str], y: str, weight: Column | None = None) -> list[tuple[str, float]]:
    """(feature, coefficient) of least squares, the intercept last, by Spark's own solver."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    cols = [F.col(f).cast("double").alias(f) for f in features]
    rows = df.select(*cols, F.col(y).cast("double").alias("_y"), (F.lit(1.0) if weight is None else weight).alias("_w")).dropna()
    data = VectorAssembler(inputCols=list(features), outputCol="_f").transform(rows)
    solver = "normal" if len(features) <= 4096 else "l-bfgs"
    m = LinearRegression(featuresCol="_f", labelCol="_y", weightCol="_w", solver=solver, regParam=0.0).fit(data)
    return [*zip(features, (float(c) for c in m.coefficients), strict=True), ("(intercept)", float(m.intercept))]


#: Features of a sparse fit at most, those that are fitted by their moments at most (over STEPPED only where steps do not get there),
#: rows and columns of a block of moments, blocks that a task holds, places of a piece of a vector.
MOST_FEATURES, MOST_MOMENTS, STEPPED, BLOCK, HELD, PIECE = 500_000, 8192, 2048, 512, 64, 8192
#: Steps of a fit at most, and the share of the first residual at which it ends.
STEPS, CLOSE = 500, 1e-13


def feature_numbers(long: DataFrame, feature: str = "feature") -> dict[str, int]:
    """The distinct features of (key, feature, value) rows by text, numbered; over MOST_FEATURES are an error."""
    names = [r[0] for r in long.select(feature).where(F.col(feature).isNotNull()).distinct().limit(MOST_FEATURES + 1).collect()]
    if len(names) > MOST_FEATURES:
        raise ValueError("too many features for a sparse fit")
    return {n: i for i, n in enumerate(sorted(names))}


def _added(parts: DataFrame) -> DataFrame:
    """Rows (i, j, cells): the sum of the numbers of each place, of which tasks give any number of rows."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            for c in b.column("cells").to_pylist():
                total = total + np.frombuffer(c)
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([total.tobytes()], pa.binary())], names=["i", "j", "cells"])

    return parts.groupBy("i", "j").applyInArrow(add, _CELLS)


_CELLS = "i int, j int, cells binary"


def _moments(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted moments of sparse rows (at, value, y, w): X'WX and X'Wy, of which the last feature is the constant 1.

    Tasks add up blocks of BLOCK features by BLOCK and send those that have values; a group adds up the
    blocks of one place. The driver gets one block a place.
    """
    size = n + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[i] for k in held], pa.int32()) for i in (0, 1)] + [pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["i", "j", "cells"])
            held.clear()
            return out

        for b in batches:
            for at, value, y, w in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                at, value = np.array([*at, n]), np.array([*value, 1.0])
                order = np.argsort(at)
                at, value = at[order], value[order]
                cuts = np.flatnonzero(np.diff(at // BLOCK)) + 1
                pieces = list(zip(np.split(at, cuts), np.split(value, cuts), strict=True))
                for k, (p, u) in enumerate(pieces):
                    for q, v in pieces[k:]:
                        block = held.setdefault((p[0] // BLOCK, q[0] // BLOCK), np.zeros((BLOCK, BLOCK)))
                        block[np.ix_(p % BLOCK, q % BLOCK)] += w * np.outer(u, v)
                    target = held.setdefault((p[0] // BLOCK, -1), np.zeros(BLOCK))
                    target[p % BLOCK] += w * y * u
                if len(held) > HELD:
                    yield sent()
        yield sent()

    whole, target = np.zeros((-(-size // BLOCK) * BLOCK,) * 2), np.zeros(-(-size // BLOCK) * BLOCK)
    for r in _added(rows.mapInArrow(part, _CELLS)).toLocalIterator():
        cells = np.frombuffer(r.cells)
        if r.j < 0:
            target[r.i * BLOCK : (r.i + 1) * BLOCK] = cells
        else:
            square = cells.reshape(BLOCK, BLOCK)
            whole[r.i * BLOCK : (r.i + 1) * BLOCK, r.j * BLOCK : (r.j + 1) * BLOCK] = square
            if r.i != r.j:
                whole[r.j * BLOCK : (r.j + 1) * BLOCK, r.i * BLOCK : (r.i + 1) * BLOCK] = square.T
    return whole[:size, :size], target[:size]


def _packed(rows: DataFrame) -> DataFrame:
    """Sparse rows (at, value, y, w) as blocks: the arrays of a batch of rows, each as its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, value = b.column(0), b.column(1)
            of = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(at.offsets.to_numpy()))
            arrays = [of, at.flatten().to_numpy(), value.flatten().to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["of", "at", "value", "y", "w"])

    return checkpointed(rows.mapInArrow(run, "of binary, at binary, value binary, y binary, w binary"))


def _passed(blocks: DataFrame, n: int, of_rows: Sequence[Callable]) -> list[np.ndarray]:
    """For each function of a block's (of, at, value, y, w) to amounts by row: the amounts times the rows, added up, and last their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(n + 1) for _ in of_rows]
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of, at = (np.frombuffer(x, dtype=np.int32) for x in row[:2])
                value, y, w = (np.frombuffer(x) for x in row[2:])
                for total, f in zip(held, of_rows, strict=True):
                    amount = f(of, at, value, y, w)
                    total[:n] += np.bincount(at, value * amount[of], n)
                    total[n] += amount.sum()
        places = [(i, j) for i in range(len(held)) for j in range(0, n + 1, PIECE)]
        cells = [held[i][j : j + PIECE].tobytes() for i, j in places]
        yield pa.RecordBatch.from_arrays([*(pa.array([p[k] for p in places], pa.int32()) for k in (0, 1)), pa.array(cells, pa.binary())], names=["i", "j", "cells"])

    out = [np.zeros(n + 1) for _ in of_rows]
    for r in _added(blocks.mapInArrow(run, _CELLS)).toLocalIterator():
        out[r.i][r.j : r.j + PIECE] = np.frombuffer(r.cells)
    return out


def _stepped(rows: DataFrame, n: int) -> tuple[np.ndarray, float] | None:
    """(coefficients, intercept) of sparse rows (at, value, y, w) by conjugate gradients about the means; None if STEPS do not get there.

    From zero the steps stay among the combinations of rows, so that the end is of least norm. Steps
    begin anew from the residual of the rows themselves until that is CLOSE to nothing, or gets no smaller.
    """
    blocks = _packed(rows)
    ones, squares, of_y = _passed(blocks, n, [lambda of, at, v, y, w: w, lambda of, at, v, y, w: w * np.bincount(of, v * v, len(w)), lambda of, at, v, y, w: w * y])
    total = ones[n]
    if total <= 0:
        return np.zeros(n), 0.0
    mean, mean_y = ones[:n] / total, of_y[n] / total

    def fitted(p: np.ndarray) -> Callable:
        shift = float(mean @ p)
        return lambda of, at, v, y, w: np.bincount(of, v * p[at], len(w)) - shift

    def about(sums: np.ndarray) -> np.ndarray:
        return sums[:n] - mean * sums[n]

    def residual(x: np.ndarray) -> np.ndarray:
        f = fitted(x)
        return about(_passed(blocks, n, [lambda of, at, v, y, w: w * (y - mean_y - f(of, at, v, y, w))])[0])

    x, steps = np.zeros(n), 0
    r = residual(x)
    first = last = float(np.linalg.norm(r))
    while last > CLOSE * first:
        p, size, step = r.copy(), float(r @ r), np.zeros(n)
        while np.sqrt(size) > 1e-9 * last:
            if steps >= STEPS:
                return None
            f = fitted(p)
            q = about(_passed(blocks, n, [lambda of, at, v, y, w, f=f: w * f(of, at, v, y, w)])[0])
            along = float(p @ q)
            if along <= 0:  # nothing but rounding is left
                break
            step += size / along * p
            r = r - size / along * q
            size, before = float(r @ r), size
            p = r + size / before * p
            steps += 1
        r = residual(x + step)
        now = float(np.linalg.norm(r))
        if now > 0.5 * last:
            break
        x, last = x + step, now
    return (x, mean_y - float(mean @ x)) if last <= 1e-9 * first else None


def sparse_ols(long: DataFrame, targets: DataFrame, key: str, y: str, weight: Column | None = None) -> list[tuple[str, float]]:
    """(feature, coefficient) of least squares on sparse rows (key, feature, value), the intercept last.

    `targets` has a row a key with y; a feature that a key lacks is 0 there, and values of one feature
    that a key has twice are added. Rows with a null in any of these are left out. Up to STEPPED
    features are fitted by their moments, more by conjugate gradients, whose passes over the rows send
    one vector a task; where those do not get there, by moments up to MOST_MOMENTS features, else it is
    an error. Where features depend on each other, the coefficients are those of least norm about the
    means. No rows give an intercept of 0.
    """
    numbers = feature_numbers(long)
    place = F.broadcast(long.sparkSession.createDataFrame(list(numbers.items()), "feature string, at int"))
    cells = long.where(F.col("value").isNotNull()).join(place, "feature").groupBy(key, "at").agg(F.sum(F.col("value").cast("double")).alias("value"))
    lists = cells.groupBy(key).agg(F.collect_list(F.struct("at", "value")).alias("x"))
    w = (F.lit(1.0) if weight is None else weight).cast("double").alias("_w")
    rows = targets.select(key, F.col(y).cast("double").alias("_y"), w).dropna().join(lists, key, "left")
    none = F.array().cast("array<struct<at: int, value: double>>")
    n = len(numbers)
    rows = rows.select(F.coalesce("x", none).alias("x"), "_y", "_w").select("x.at", "x.value", "_y", "_w")
    if n > STEPPED:
        fit = _stepped(rows, n)
        if fit is not None:
            return [*zip(numbers, map(float, fit[0]), strict=True), ("(intercept)", float(fit[1]))]
        if n > MOST_MOMENTS:
            raise ValueError("a fit of so many features did not get there")
    both, target = _moments(rows, n)
    total = both[n, n]
    if total <= 0:
        return [*((f, 0.0) for f in numbers), ("(intercept)", 0.0)]
    mean, mean_y = both[:n, n] / total, target[n] / total
    centred, right = both[:n, :n] - total * np.outer(mean, mean), target[:n] - total * mean * mean_y
    scale = np.sqrt(np.maximum(np.diag(centred), 0))
    flat = scale <= 1e-9 * np.sqrt(np.maximum(np.diag(both)[:n], 1e-300))  # features that do not vary
    scale[flat] = 1.0
    scaled = centred / np.outer(scale, scale)
    scaled[flat], scaled[:, flat] = 0.0, 0.0
    right = np.where(flat, 0.0, right)
    values, vectors = np.linalg.eigh(scaled)
    if len(values) and values[0] > 1e-10 * values[-1]:
        coef = vectors @ (vectors.T @ (right / scale) / values) / scale
    else:  # of least norm in the features' own units
        keep = ~flat
        coef = np.zeros(n)
        coef[keep] = np.linalg.pinv(centred[np.ix_(keep, keep)], rcond=1e-11, hermitian=True) @ right[keep]
    return [*zip(numbers, map(float, coef), strict=True), ("(intercept)", float(mean_y - mean @ coef))]


def coefficient_table(spark, coefficients: Sequence[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(list(coefficients), "feature string, coef double")


def score(long: DataFrame, coefficients: DataFrame, key: str) -> DataFrame:
    """Rows (key, pred): sum of value * coefficient over (key, feature, value), plus the intercept; a feature
    without a coefficient adds nothing."""
    b = coefficients.where("feature = '(intercept)'").agg(F.coalesce(F.max("coef"), F.lit(0.0)).alias("_b"))
    c = coefficients.where("feature <> '(intercept)'")
    return long.join(c, "feature", "left").groupBy(key).agg(F.sum(F.col("value") * F.coalesce("coef", F.lit(0.0))).alias("_s")).join(F.broadcast(b)).select(key, (F.col("_s") + F.col("_b")).alias("pred"))


def project_classes(coefficients: DataFrame, dim: DataFrame) -> DataFrame:
    """Class coefficients as coefficients of the classes' opcodes; the intercept stays."""
    ops = coefficients.join(dim.select("opname", F.col("class").alias("feature")), "feature").select(F.col("opname").alias("feature"), "coef")
    return ops.unionByName(coefficients.where("feature = '(intercept)'"))
