"""Coverage: which keys succeeded, in which groups, and what is missing where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Groups that a report may have; they are broadcast.
MOST_GROUPS = 10_000


def key_flags(runs: DataFrame, key: str, ok: Column, traced: Column, canonical: Column) -> DataFrame:
    """One row per key with booleans: any_ok, all_ok, any_traced, all_traced (ok and traced), and the same over canonical runs."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    ok, traced, canonical = yes(ok), yes(traced), yes(canonical)
    every = lambda c, where: (F.count_if(where) > 0) & (F.count_if(where & ~c) == 0)
    some = F.lit(True)
    return runs.groupBy(key).agg(
        F.bool_or(ok).alias("any_ok"), every(ok, some).alias("all_ok"), F.bool_or(ok & traced).alias("any_traced"), every(ok & traced, some).alias("all_traced"),
        F.bool_or(ok & canonical).alias("any_ok_canonical"), every(ok, canonical).alias("all_ok_canonical"), F.bool_or(ok & traced & canonical).alias("any_traced_canonical"), every(ok & traced, canonical).alias("all_traced_canonical"),
    )


def summarise_flags(flags: DataFrame, key: str) -> DataFrame:
    """One row: the number of keys and of keys with each flag."""
    return flags.agg(F.count(F.lit(1)).alias("n_keys"), *[F.count_if(F.col(c)).alias(c) for c in flags.columns if c != key])


def in_all_groups(df: DataFrame, key: str, group: str, strict: bool = True) -> DataFrame:
    """Keys that every group present has; not strict: keys with as many rows as there are groups."""
    total = df.agg(F.count_distinct(group).alias("_total"))
    n = F.count_distinct(group) if strict else F.count(F.lit(1))
    return df.groupBy(key).agg(n.alias("_n")).join(F.broadcast(total)).where("_n = _total").select(key)


def coverage_gaps(df: DataFrame, key: str, group: str, errors: str) -> DataFrame:
    """Rows (key, group, status) for the keys that some group lacks or failed: ok, not found, error n or multiple.

    The grid is those keys by the groups present, at most MOST_GROUPS, else an error.
    """
    groups = df.select(group).distinct()
    if groups.limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"a coverage report takes up to {MOST_GROUPS} groups")
    cells = df.groupBy(key, group).agg(F.count(F.lit(1)).alias("_n"), F.max(errors).alias("_e"))
    total = df.agg(F.count_distinct(group).alias("_total"))
    good = cells.groupBy(key).agg(F.count_if((F.col("_n") == 1) & (F.col("_e") == 0)).alias("_ok"))
    failing = good.join(F.broadcast(total)).where("_ok < _total").select(key)
    grid = failing.join(F.broadcast(groups))
    status = F.when(F.col("_n").isNull(), "not found").when(F.col("_n") > 1, "multiple").when(F.col("_e") > 0, F.concat(F.lit("error "), F.col("_e").cast("string"))).otherwise("ok")
    return grid.join(cells, [key, group], "left").select(key, group, status.alias("status"))


def lookup_unique(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, value, problem): the one value of a key, or null and why: `n` rows."""
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(n.alias("n"), F.min(value).alias("_v")).select(key, F.when(F.col("n") == 1, F.col("_v")).alias(value), F.when(F.col("n") != 1, F.concat(F.col("n").cast("string"), F.lit(" rows"))).alias("problem"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that are there more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
