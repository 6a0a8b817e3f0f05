"""Reproducible splits: by rows, by groups, of families, and their verification."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import cell_counts, kth, seeded


def ratio_split(df: DataFrame, key: str, seed: int, shares: Sequence[float], names: Sequence[str], ceil: bool = False) -> DataFrame:
    """Rows (key, split): distinct keys in seeded order; each split takes floor (or ceil) of its share of
    their number, the last takes the rest.

    The sizes are exact: a selection finds the keys that stand at the splits' ends, and the split is a
    filter by them. Nothing is sorted, and null keys are in no split.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", seeded(seed, key))
    cells = cell_counts(keys, "_h")
    total, upto = sum(cells.values()), []
    for s in shares:
        upto.append((upto[-1] if upto else 0) + (math.ceil if ceil else math.floor)(round(total * s, 9)))
    ends = [min(n, total) for n in upto]
    found = dict(zip([n for n in ends if n > 0], kth(keys, "_h", key, [n for n in ends if n > 0], cells), strict=True))
    out = F.lit(names[-1])
    for n, name in reversed(list(zip(ends, names, strict=False))):
        out = F.when(_upto(key, *found[n]), name).otherwise(out) if n > 0 else out
    return keys.select(key, out.alias("split"))


def _upto(key: str, h: str, value) -> Column:
    """Whether a row stands no later than (h, value) in seeded order."""
    return (F.col("_h") < h) | ((F.col("_h") == h) & (F.col(key) <= F.lit(value)))


def verify_split(split: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """Rows (key, problem) where two assignments differ: missing, new or moved. Empty if they agree."""
    a, b = split.select(key, F.col("split").alias("_a")), frozen.select(key, F.col("split").alias("_b"))
    both = a.join(b, key, "full_outer")
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "new").when(F.col("_a") != F.col("_b"), "moved")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def sample_of_group(df: DataFrame, by: Sequence[str], key: str, seed: int, n: int) -> DataFrame:
    """n rows of each group, those first in seeded order; groups with fewer are left out.

    A task keeps the first n rows of each of its groups before the shuffle (Spark's limit by group, for
    n up to spark.sql.optimizer.windowGroupLimitThreshold), so that a hot group costs n rows a task.
    """
    w = Window.partitionBy(*by)
    first = df.withColumn("pick", F.row_number().over(w.orderBy(seeded(seed, key), key))).where(F.col("pick") <= n)
    return first.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == n).drop("_n")


def sample_rows(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows, those first in seeded order, by selection of the n-th; all if there are fewer. Of rows that
    are last with one key, as many as there is room for are taken; rows without a key are not drawn."""
    rows = df.where(F.col(key).isNotNull()).withColumn("_h", seeded(seed, key))
    cells = cell_counts(rows, "_h")
    if n <= 0 or n >= sum(cells.values()):
        return rows.drop("_h") if n > 0 else rows.limit(0).drop("_h")
    h, value = kth(rows, "_h", key, [n], cells)[0]
    last = (F.col("_h") == h) & (F.col(key) == F.lit(value))
    before = rows.where(_upto(key, h, value) & ~last)
    return before.unionByName(rows.where(last).limit(n - before.count())).drop("_h")


def restrict_to_train(extra: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """Rows of `extra` whose key is in the train split; the test split is never added to."""
    return extra.join(split.where("split = 'train'").select(key).distinct(), key, "left_semi")
