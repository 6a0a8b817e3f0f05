"""Statistics of runs and of columns: trials in an array, percentiles, normal quantiles, normaliser fits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import checkpointed, running_total


def array_mean(a: Column) -> Column:
    """Mean of an array; null for null or empty."""
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a).cast("double"))


def array_stddev(a: Column, sample: bool = False) -> Column:
    """Population (or sample) standard deviation of an array; null where it has none."""
    m = array_mean(a)
    squares = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.sqrt(F.try_divide(squares, (F.size(a) - (1 if sample else 0)).cast("double")))


def trimmed(a: Column) -> Column:
    """The array in order, without one least and one greatest value; null if none is left."""
    return F.when(F.size(a) > 2, F.slice(F.sort_array(a), F.lit(2), F.greatest(F.size(a) - 2, F.lit(1))))


def trial_stats(runs: DataFrame, key: str, trial: str) -> DataFrame:
    """One row per key of a long table of trials: n, mean, population stdev, coefficient of variation, mean/stdev."""
    out = runs.groupBy(key).agg(F.count(trial).alias("n"), F.avg(trial).alias("mean"), F.stddev_pop(trial).alias("stdev"))
    return out.withColumn("cv", F.try_divide(F.col("stdev"), F.col("mean"))).withColumn("inverse_cv", F.try_divide(F.col("mean"), F.col("stdev")))


def trial_arrays(runs: DataFrame, key: str, trial: str) -> DataFrame:
    """One row per key with its trials, in order, as an array: the runs' own layout."""
    return runs.groupBy(key).agg(F.sort_array(F.collect_list(trial)).alias("trials"))


#: Distinct values whose percentiles are taken in one buffer.
SMALL_COUNTS = 1_000_000


def exact_percentiles(df: DataFrame, col: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., v): an array of linear percentiles of the column, nulls left out; null if there is no value.

    Values are counted. Up to SMALL_COUNTS distinct ones are put in order in a buffer; beyond, running
    totals over the counts, by ranges, tell which values have the two ranks about each point, so that
    no buffer holds a large column's or group's values.
    """
    counts = checkpointed(df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n")))  # once, for both ways
    if counts.limit(SMALL_COUNTS + 1).count() <= SMALL_COUNTS:
        return counts.groupBy(*by).agg(F.percentile(F.col(col).cast("double"), [float(p) for p in points], F.col("_n")).alias("v"))
    upto = running_total(counts, by, col, "_n", "_upto")
    total = upto.groupBy(*by).agg(F.max("_upto").alias("_t"))
    if by:
        total = total.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_t")
        rows = upto.join(total, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]))
    else:
        rows = upto.join(F.broadcast(total))  # one row
    found = []
    for i, p in enumerate(points):
        place = (F.col("_t") - 1) * float(p)
        for name, k in ((f"lo{i}", F.floor(place)), (f"hi{i}", F.ceil(place))):
            found.append(F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - F.col("_n") <= k), F.col(col).cast("double"))).alias(name))
    sums = rows.groupBy(*by).agg(F.max("_t").alias("_t"), *found)
    part = lambda p: (F.col("_t") - 1) * float(p) - F.floor((F.col("_t") - 1) * float(p))
    return sums.select(*by, F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * part(p) for i, p in enumerate(points)]).alias("v"))


def percentiles(df: DataFrame, col: str, points: Sequence[float], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Rows (point, value): linear percentiles, or approximate ones in one pass, right to a share of 1/accuracy of the ranks."""
    v = exact_percentiles(df, col, points) if exact else df.agg(F.percentile_approx(col, [float(p) for p in points], accuracy).alias("v"))
    return v.select(F.inline(F.arrays_zip(F.array(*[F.lit(float(p)) for p in points]).alias("point"), F.col("v").alias("value"))))


def share_up_to(df: DataFrame, col: str, cuts: Sequence[float]) -> DataFrame:
    """Rows (cut, share): the share of all rows whose value is at most the cut; nulls count as rows."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(col) <= c).alias(f"c{i}") for i, c in enumerate(cuts)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.try_divide(F.col(f"c{i}"), F.col("n")).alias("share")) for i, c in enumerate(cuts)])))


#: Coefficients of Acklam's rational approximation of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile; null at 0 and 1 and outside."""

    def poly(coefficients, x, last=None):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out if last is None else out * x + F.lit(last)

    q = F.sqrt(F.lit(-2.0) * F.ln(F.least(p, F.lit(1.0) - p)))
    tail = poly(ACKLAM_C, q) / poly(ACKLAM_D, q, 1.0)
    r = (p - 0.5) * (p - 0.5)
    middle = poly(ACKLAM_A, r) * (p - 0.5) / poly(ACKLAM_B, r, 1.0)
    return F.when((p > 0) & (p < 0.02425), tail).when((p > 0.97575) & (p < 1), -tail).when((p >= 0.02425) & (p <= 0.97575), middle)


def qq_normal(runs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows (key, i, value, expected): sorted values against the normal quantiles i/n of the key's mean and
    population stdev, i from 0; the first has none. A key's values must fit a task; they are its trials."""
    w = Window.partitionBy(key)
    out = runs.select(key, F.col(value).alias("value"), (F.row_number().over(w.orderBy(value, order)) - 1).alias("i"), F.count(value).over(w).alias("_n"), F.avg(value).over(w).alias("_m"), F.stddev_pop(value).over(w).alias("_s"))
    return out.select(key, "i", "value", (F.col("_m") + F.col("_s") * inverse_normal(F.col("i") / F.col("_n"))).alias("expected"))


def fit_normaliser(df: DataFrame, col: str) -> DataFrame:
    """One row: n, mean (0 if there is none), sample stdev (0 for up to one value)."""
    return df.agg(F.count(col).alias("n"), F.coalesce(F.avg(col), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias("stdev"))


def target_spread(df: DataFrame, col: str) -> DataFrame:
    """One row: population mean, variance, stdev."""
    return df.agg(F.avg(col).alias("mean"), F.var_pop(col).alias("variance"), F.stddev_pop(col).alias("stdev"))


def best_constant_guess(df: DataFrame, col: str) -> DataFrame:
    """One row: errors of guessing the mean: mse (the variance), rmse, mape (zeros left out)."""
    mean = df.agg(F.avg(col).alias("_m"))
    y = F.col(col)
    out = df.join(F.broadcast(mean)).agg(F.avg(F.pow(y - F.col("_m"), F.lit(2.0))).alias("mse"), F.avg(F.try_divide(F.abs(y - F.col("_m")), F.abs(y))).alias("mape"))
    return out.select("mse", F.sqrt("mse").alias("rmse"), "mape")


def first_per_key(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The columns of each key's row of least `order`: one aggregation, no window."""
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_r")).select(key, "_r.*")


def groups_by_median(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Rows (group, median, place): groups by the median of a metric; place from 1, nulls last."""
    values = df.select(group).distinct().join(exact_percentiles(df, metric, [0.5], by=[group]).withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")), "left")
    out = values.select(group, F.get("v", F.lit(0)).alias("median"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("median").asc_nulls_last(), group)))  # one row a group
