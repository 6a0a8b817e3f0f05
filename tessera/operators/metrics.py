"""Error metrics of predictions: overall and by range, by method and split, rank correlation, deviations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import checkpointed, global_rank, running_total

#: The ranges of the measured value, half open; values elsewhere are in none.
RANGES = ((0.0, 1e-4), (1e-4, 1e-3), (1e-3, 1e-2), (1e-2, 1e-1), (1e-1, 1e10))


def range_label(real: Column, ranges: Sequence[tuple[float, float]] = RANGES) -> Column:
    out = F.lit(None).cast("string")
    for low, high in ranges:
        out = F.when((real >= low) & (real < high), f"{low:g}..{high:g}").otherwise(out)
    return out


def errors(real: Column, pred: Column) -> list[Column]:
    """Aggregates rmse, mae, mape; a zero measurement has no relative error, and no rows give null."""
    d = pred - real
    return [F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(F.try_divide(F.abs(d), F.abs(real))).alias("mape")]


def metric_suite(df: DataFrame, real: str, pred: str, ranges=RANGES, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., range, n, rmse, mae, mape): all rows (`overall`) and every range, empty ones with nulls."""
    labels = ["overall", *(f"{a:g}..{b:g}" for a, b in ranges)]
    tagged = df.select(*by, real, pred, F.explode(F.array(F.lit("overall"), range_label(F.col(real), ranges))).alias("range")).where("range is not null")
    found = tagged.groupBy(*by, "range").agg(F.count(F.lit(1)).alias("n"), *errors(F.col(real), F.col(pred)))
    heads = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = heads.select(*by, F.explode(F.array(*[F.lit(x) for x in labels])).alias("range"))
    return grid.join(found, [*by, "range"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def metric_matrix(df: DataFrame, row: str, columns: Sequence[str], values: Sequence[str], real: str, pred: str, metric: str = "mape") -> DataFrame:
    """One metric as a table: a row per `row`, a column per value of the joined `columns`."""
    tagged = df.withColumn("_c", F.concat_ws("_", *columns))
    pick = next(e for e, n in zip(errors(F.col(real), F.col(pred)), ("rmse", "mae", "mape"), strict=True) if n == metric)
    return tagged.groupBy(row).pivot("_c", list(values)).agg(pick)


def average_ranks(df: DataFrame, value: str, by: Sequence[str], name: str, times: Column | None = None) -> DataFrame:
    """Rows (by..., value, name): the average rank of each distinct value within `by`; a row counts `times`, or once.

    Ranks are running totals over counts of distinct values, by ranges: one row for each value, and
    no task that sorts a group.
    """
    counts = df.groupBy(*by, value).agg(F.sum(F.lit(1) if times is None else times).alias("_n"))
    upto = running_total(counts, by, value, "_n", "_upto")
    return upto.select(*by, value, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))


def spearman(df: DataFrame, by: Sequence[str], real: str, pred: str) -> DataFrame:
    """Rows (by..., spearman): rank correlation with average ranks for ties; NaN where one does not vary, null for one row.

    Rows are read once, and equal pairs are one from then on, with their number.
    """
    pairs = checkpointed(df.groupBy(*by, real, pred).agg(F.count(F.lit(1)).alias("_times")))
    a, b = (average_ranks(pairs, c, by, name, F.col("_times")) for c, name in ((real, "_ra"), (pred, "_rb")))
    ranked = pairs.join(a, [*by, real]).join(b, [*by, pred])
    total = lambda *cols: F.sum(reduce(mul, map(F.col, cols), F.col("_times").cast("double")))
    sums = {"n": total(), "a": total("_ra"), "b": total("_rb"), "aa": total("_ra", "_ra"), "bb": total("_rb", "_rb"), "ab": total("_ra", "_rb")}
    m = ranked.groupBy(*by).agg(*[s.alias(f"_{k}") for k, s in sums.items()], *[(F.min(c) < F.max(c)).alias(f"_varies{c}") for c in ("_ra", "_rb")])
    both = lambda x, y, xy: F.col(xy) / F.col("_n") - F.col(x) / F.col("_n") * (F.col(y) / F.col("_n"))
    r = both("_a", "_b", "_ab") / F.sqrt(both("_a", "_a", "_aa") * both("_b", "_b", "_bb"))
    out = F.when(F.col("_varies_ra") & F.col("_varies_rb"), r).when(F.col("_n") > 1, F.lit(float("nan")))
    return m.select(*by, out.alias("spearman"))


def relative_squared_error(real: str, pred: str) -> Column:
    d = F.col(pred) - F.col(real)
    return F.avg(F.try_divide(d * d, F.col(real)))


def both_domains(df: DataFrame, real: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """A row for each of `by`: mse, mae, mape of the values and of their inverses (zeros left out)."""
    out = []
    for name, r, p in (("time", F.col(real), F.col(pred)), ("rate", F.try_divide(F.lit(1.0), F.col(real)), F.try_divide(F.lit(1.0), F.col(pred)))):
        d = p - r
        out += [F.avg(d * d).alias(f"{name}_mse"), F.avg(F.abs(d)).alias(f"{name}_mae"), F.avg(F.try_divide(F.abs(d), F.abs(r))).alias(f"{name}_mape")]
    return df.groupBy(*by).agg(*out)


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed; rows with a null key are left out, as NOT IN leaves them out."""
    return df.where(F.col(key).isNotNull()).join(keys.select(key), key, "left_anti")


def deviation_census(df: DataFrame, group: str, key: str, value: str, base) -> DataFrame:
    """Rows (group, original, deviated): keys of each other group whose sum equals the base group's, or not."""
    sums = df.groupBy(group, key).agg(F.sum(value).alias("_v"))
    of_base = sums.where(F.col(group) == base).select(key, F.col("_v").alias("_b"))
    return sums.where(F.col(group) != base).join(of_base, key).groupBy(group).agg(F.count_if(F.col("_v") == F.col("_b")).alias("original"), F.count_if(F.col("_v") != F.col("_b")).alias("deviated"))


def relative_deviation(df: DataFrame, group: str, key: str, value: str, base) -> DataFrame:
    """Rows (group, key, deviation): |sum - base's sum| / base's sum; null where the base's is 0."""
    sums = df.groupBy(group, key).agg(F.sum(value).alias("_v"))
    of_base = sums.where(F.col(group) == base).select(key, F.col("_v").alias("_b"))
    return sums.where(F.col(group) != base).join(of_base, key).select(group, key, F.try_divide(F.abs(F.col("_v") - F.col("_b")), F.abs(F.col("_b"))).alias("deviation"))


def order_by_base(df: DataFrame, group: str, key: str, value: str, groups: Sequence) -> DataFrame:
    """Rows (key, a column per group, ordinal): group means, keys in the order of the first group's mean.

    Only keys that every group has are there. Equal means go by the key; a mean of whole numbers does
    not hang on the order in which they are added, one of fractions does in its last digits.
    """
    wide = df.groupBy(key).pivot(group, list(groups)).agg(F.avg(value)).dropna()
    return global_rank(wide, F.col(f"`{groups[0]}`"), key, name="ordinal")


def deviation_report(df: DataFrame, key: str, real: str, methods: Sequence[str]) -> DataFrame:
    """Rows (key, real, <method>, <method>_pct, ordinal): each method's prediction and its signed error in percent."""
    pct = [F.try_divide((F.col(m) - F.col(real)) * 100, F.col(real)).alias(f"{m}_pct") for m in methods]
    return global_rank(df.select(key, real, *methods, *pct), real, key, name="ordinal")
