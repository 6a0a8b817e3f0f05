"""Histograms: fixed edges, equal widths, two dimensions on log scales, densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import exact_percentiles


def edge_bin(value: Column, edges: Sequence[float]) -> Column:
    """0-based bin [a, b) of the edges, the last [a, b]; null outside and for null."""
    out = F.lit(None).cast("int")
    last = len(edges) - 2
    for i in range(last + 1):
        upper = value <= edges[i + 1] if i == last else value < edges[i + 1]
        out = F.when((value >= edges[i]) & upper, i).otherwise(out)
    return out


def fixed_histogram(df: DataFrame, col: str, edges: Sequence[float]) -> DataFrame:
    """Rows (bin, low, high, n) for every bin, empty ones too."""
    sums = df.agg(*[F.count_if(edge_bin(F.col(col), edges) == i).alias(f"c{i}") for i in range(len(edges) - 1)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(edges[i])).alias("low"), F.lit(float(edges[i + 1])).alias("high"), F.col(f"c{i}").alias("n")) for i in range(len(edges) - 1)])))


def equal_bin(value: Column, low: Column, high: Column, bins: Column | int) -> Column:
    """0-based bin of `bins` equal ones over [low, high]; the top value is in the last."""
    n = F.lit(bins) if isinstance(bins, int) else bins
    place = F.floor((value - low) * n / (high - low))
    return F.when((value < low) | (value > high), None).when(high == low, 0).otherwise(F.least(place, n - 1)).cast("int")


def equal_histogram(df: DataFrame, col: str, bins: int, upper_share: float | None = None, density: bool = False) -> DataFrame:
    """Rows (bin, low, high, n[, density]) of equal bins over the column's range, or over [0, percentile]."""
    c = F.col(col)
    if upper_share is not None:
        span = exact_percentiles(df, col, [upper_share]).select(F.lit(0.0).alias("_lo"), F.get("v", F.lit(0)).alias("_hi"))
    else:
        span = df.agg(F.min(c).cast("double").alias("_lo"), F.max(c).cast("double").alias("_hi"))
    binned = df.join(F.broadcast(span)).select("_lo", "_hi", equal_bin(c, F.col("_lo"), F.col("_hi"), bins).alias("bin")).where("bin is not null")
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = span.select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    out = grid.join(counts, "bin", "left").select("bin", (F.col("_lo") + width * F.col("bin")).alias("low"), (F.col("_lo") + width * (F.col("bin") + 1)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
    if not density:
        return out
    total = counts.agg(F.sum("n").alias("_t"))
    return out.join(F.broadcast(total)).withColumn("density", F.try_divide(F.col("n"), F.col("_t") * (F.col("high") - F.col("low")))).drop("_t")


def auto_bins(df: DataFrame, col: str) -> DataFrame:
    """One row `bins`: the greater of Sturges' number and Freedman and Diaconis'."""
    s = df.agg(F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).join(F.broadcast(exact_percentiles(df, col, [0.25, 0.75]).withColumnRenamed("v", "q")))  # one row each
    span = F.col("hi") - F.col("lo")
    sturges = F.ceil(F.log2("n") + 1)
    wide = 2 * (F.col("q")[1] - F.col("q")[0]) / F.cbrt(F.col("n"))
    return s.select(F.greatest(sturges, F.coalesce(F.ceil(F.try_divide(span, wide)), F.lit(1))).cast("int").alias("bins"))


def log_histogram_2d(df: DataFrame, x: str, y: str, bins: int = 50, inner: bool = True) -> DataFrame:
    """Rows (bx, by, n) of the non-empty cells of log10 values.

    Both axes span the greater (or the less, if not inner) of the minima to the less of the maxima;
    values outside, zero and below are left out.
    """
    logs = df.select(F.log10(F.col(x)).alias("x"), F.log10(F.col(y)).alias("y")).where("x is not null and y is not null")
    low = (F.greatest if inner else F.least)(F.min("x"), F.min("y"))
    span = logs.agg(low.alias("_lo"), F.least(F.max("x"), F.max("y")).alias("_hi"))
    cell = lambda c: equal_bin(F.col(c), F.col("_lo"), F.col("_hi"), bins)
    return logs.join(F.broadcast(span)).select(cell("x").alias("bx"), cell("y").alias("by")).where("bx is not null and by is not null").groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))


def kernel_density(df: DataFrame, group: str, metric: str, points: int = 100, cut: float = 2.0, cells: int = 1 << 14) -> DataFrame:
    """Rows (group, place, x, density): a Gaussian kernel density at `points` places from `cut` widths below
    the least value of a group to as many above its greatest.

    The width is Scott's, the sample deviation times n to the power of -1/5. Values are dealt linearly to
    the two cells beside them, of `cells` in a group; a cell then adds its kernel to the places within
    nine widths of it. So after one pass over the values there are at most cells * points small rows a
    group. Nulls are left out, and groups of fewer than two different values have no density.
    """
    v = df.select(F.col(group).alias("group"), F.col(metric).cast("double").alias("v")).where("v is not null")
    s = v.groupBy("group").agg(F.count(F.lit(1)).cast("double").alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("hi > lo")
    s = s.withColumn("h", F.col("s") * F.pow("n", F.lit(-0.2))).select("group", "n", "h", (F.col("lo") - cut * F.col("h")).alias("lo"), (F.col("hi") + cut * F.col("h")).alias("hi"))
    place = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells
    cell = F.least(F.floor(place), F.lit(cells - 1))
    two = F.array(F.struct(cell.alias("cell"), (1 - (place - cell)).alias("w")), F.struct((cell + 1).alias("cell"), (place - cell).alias("w")))
    dealt = v.join(s, "group").select("group", F.explode(two).alias("x")).groupBy("group", "x.cell").agg(F.sum("x.w").alias("w"))
    at = F.col("lo") + F.col("cell") * ((F.col("hi") - F.col("lo")) / cells)
    gap = (F.col("hi") - F.col("lo")) / (points - 1)
    first, last = (F.greatest(F.lit(0), F.ceil((at - 9 * F.col("h") - F.col("lo")) / gap)), F.least(F.lit(points - 1), F.floor((at + 9 * F.col("h") - F.col("lo")) / gap)))
    near = dealt.join(s, "group").withColumn("place", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    x = F.col("lo") + F.col("place") * gap
    kernel = F.exp(F.pow((x - at) / F.col("h"), F.lit(2.0)) * -0.5) * F.col("w") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    sums = near.groupBy("group", "place").agg(F.sum(kernel).alias("density"))
    grid = s.select("group", "lo", gap.alias("gap"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("place"))
    out = grid.join(sums, ["group", "place"], "left")
    return out.select(F.col("group").alias(group), "place", (F.col("lo") + F.col("place") * F.col("gap")).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))


def log_density(df: DataFrame, group: str, metric: str, per_decade: int = 4, shift: float = 1e-15, most: float = 10.0) -> DataFrame:
    """Rows (group, bin, n, density): bins of 1/per_decade in log10(metric + shift), for metrics up to `most`."""
    kept = df.where(F.col(metric) <= most).select(group, F.floor(F.round(F.log10(F.col(metric) + shift) * per_decade, 9)).cast("int").alias("bin")).where("bin is not null")
    cells = kept.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(group).agg(F.sum("n").alias("_t"))
    return cells.join(totals, group).select(group, "bin", "n", (F.col("n") * per_decade / F.col("_t")).alias("density"))
