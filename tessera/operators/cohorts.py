"""Cohorts: labels by named filters, selection by clauses of labels, funnels, lattices, snapshots.

A filter puts each row into one of its groups, or none (null). It is a column of labels, so that a
selection is one predicate and every count of groups is one pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that a filter may have in a lattice, whose grid is broadcast.
MOST_LABELS = 1000
Clauses = Sequence[Sequence[tuple[str, str]]]


class Labels:
    """A registry of filters: name -> function of a DataFrame that gives a label column."""

    def __init__(self):
        self.filters: dict[str, Callable[[DataFrame], Column]] = {}

    def register(self, label: Callable[[DataFrame], Column], name: str | None = None) -> None:
        name = name or label.__name__
        if name in self.filters:
            raise ValueError(f"a filter named {name} is registered")
        self.filters[name] = label

    def apply(self, df: DataFrame) -> DataFrame:
        """df with a column label_<name> for each filter."""
        return df.withColumns({f"label_{n}": f(df) for n, f in self.filters.items()})


def label_value(prefix: str, col: str) -> Column:
    """<prefix><value>; null for null."""
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def label_pair(a: str, b: str, pattern: str = "{}-{}") -> Column:
    """Both values in a pattern, such as `{}cycles-{}trials`; null if either is."""
    first, middle, last = pattern.split("{}")
    return F.concat(F.lit(first), F.col(a).cast("string"), F.lit(middle), F.col(b).cast("string"), F.lit(last))


def label_present(col: str, present: str = "haveTrace", absent: str = "noTrace") -> Column:
    return F.when(F.col(col).isNull(), absent).otherwise(present)


def label_in(col: str, values: Sequence, inside: str = "victimHash", outside: str = "normalHash") -> Column:
    """inside or outside; null for null, which is in neither."""
    return F.when(F.col(col).isNull(), None).when(F.col(col).isin(list(values)), inside).otherwise(outside)


def label_threshold(value: Column | str, limit: float, below: str, above: str, missing: str | None = None) -> Column:
    """below (value <= limit) or above; missing for null."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c.isNull(), missing).when(c <= limit, f"{below}{limit}").otherwise(f"{above}{limit}")


def constant_frame_hash(byte: str, width: Column, height: Column) -> Column:
    """SHA-256 of width * height * 4 bytes of one value, given as two hex digits."""
    return F.sha2(F.unhex(F.repeat(F.lit(byte), (4 * width * height).cast("int"))), 256)


def label_constant_frame(df: DataFrame, image_hash: str, width: str, height: str) -> DataFrame:
    """df with label_frame: victimHash if the hash is that of an all-white or all-zero frame of any size present.

    The frames are hashed once per size; null hashes get no label.
    """
    sizes = df.select(F.col(width).alias("w"), F.col(height).alias("h")).distinct()
    frames = sizes.select(F.explode(F.array(*[constant_frame_hash(b, F.col("w"), F.col("h")) for b in ("ff", "00")])).alias("_hash")).distinct().withColumn("_hit", F.lit(True))
    out = df.join(frames, F.col(image_hash) == F.col("_hash"), "left")
    return out.withColumn("label_frame", F.when(F.col(image_hash).isNull(), None).when(F.col("_hit"), "victimHash").otherwise("normalHash")).drop("_hash", "_hit")


def label_lists(df: DataFrame, key: str, lists: DataFrame, name: str, group: str = "group") -> DataFrame:
    """df with label_<name> from a table of (key, group); keys of no list get null.

    A key twice in the lists, in one group or in two, is an error that fails the job.
    """
    once = lists.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(group).alias("_g"))
    checked = once.select(key, F.when(F.col("_n") == 1, F.col("_g")).otherwise(F.raise_error(F.concat(F.lit("listed twice: "), F.col(key).cast("string"))).cast("string")).alias(f"label_{name}"))
    return df.join(checked, key, "left")


def overlapping_groups(groups: DataFrame, key: str, group: str = "group") -> DataFrame:
    """Keys in more than one group, with the number of groups; empty if the groups are disjoint."""
    return groups.groupBy(key).agg(F.count_distinct(group).alias("n_groups")).where("n_groups > 1")


def clause_predicate(clauses: Clauses) -> Column:
    """AND over clauses, each an OR over (filter, label); never null."""
    one = lambda f, label: F.coalesce(F.col(f"label_{f}") == label, F.lit(False))
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [one(f, x) for f, x in c]) for c in clauses], F.lit(True))


def select_cohort(df: DataFrame, clauses: Clauses) -> DataFrame:
    """The rows that all clauses take. A filter that df has no labels of is an error."""
    for f, _ in itertools.chain(*clauses):
        if f"label_{f}" not in df.columns:
            raise ValueError(f"no filter is named {f}")
    return df.where(clause_predicate(clauses))


def funnel(df: DataFrame, clauses: Clauses) -> DataFrame:
    """Rows (step, label, n): what remains after each clause (label null), and how many of the rows before
    it each of its labels takes. One pass."""
    counts, keys = [], []
    for i, clause in enumerate([[], *clauses]):
        counts.append(F.count_if(clause_predicate(clauses[:i])))
        keys.append((i, None))
        for f, label in clause:
            counts.append(F.count_if(clause_predicate([*clauses[: i - 1], [(f, label)]])))
            keys.append((i, f"{f}:{label}"))
    sums = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)])
    rows = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(x).cast("string").alias("label"), F.col(f"c{i}").alias("n")) for i, (s, x) in enumerate(keys)])
    return sums.select(F.inline(rows))


def lattice(df: DataFrame, filters: Sequence[str], most: int = 2) -> DataFrame:
    """Rows (labels..., n): the size of every intersection of groups of up to `most` filters, zeros too.

    One aggregation by grouping sets; the grid of labels supplies the zeros. A filter with more than
    MOST_LABELS labels is an error: its grid would grow with the square of their number.
    """
    names = [f"label_{f}" for f in filters]
    sets = [s for k in range(1, most + 1) for s in itertools.combinations(names, k)]
    counted = df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in names])
    sizes = df.agg(*[F.count_distinct(c).alias(c) for c in names]).first()
    if any(sizes[c] > MOST_LABELS for c in names):
        raise ValueError(f"a lattice takes filters of up to {MOST_LABELS} labels")
    grids = []
    for s in sets:
        grid = None
        for c in s:
            values = df.select(c).where(F.col(c).isNotNull()).distinct()
            grid = values if grid is None else grid.join(F.broadcast(values))
        grids.append(grid.select(*[F.col(c) if c in s else F.lit(None).cast("string").alias(c) for c in names], *[F.lit(int(c not in s)).alias(f"g_{c}") for c in names]))
    full = reduce(DataFrame.unionByName, grids)
    on = [full[c].eqNullSafe(counted[c]) & (full[f"g_{c}"] == counted[f"g_{c}"]) for c in names]
    return full.join(counted, reduce(lambda a, b: a & b, on), "left").select(*[full[c] for c in names], F.coalesce(counted["n"], F.lit(0)).alias("n"))


def pair_overlap(df: DataFrame, pairs: Sequence[tuple[tuple[str, str], tuple[str, str]]]) -> DataFrame:
    """Rows (a, b, n): rows that both labels of a pair take."""
    sums = df.agg(*[F.count_if(clause_predicate([[a], [b]])).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(":".join(a)).alias("a"), F.lit(":".join(b)).alias("b"), F.col(f"c{i}").alias("n")) for i, (a, b) in enumerate(pairs)])))


def label_length(df: DataFrame, lengths: DataFrame, key: str, limit: int, name: str = "length") -> DataFrame:
    """df with label_<name> by a table (key, length): belowOrEqualThreshold or aboveThreshold, failedTokenize where
    the length is null or missing; rows with a null key get no label."""
    once = lengths.groupBy(key).agg(F.max("length").alias("_length"))
    label = F.when(F.col("_length") <= limit, f"belowOrEqualThreshold{limit}").when(F.col("_length") > limit, f"aboveThreshold{limit}").otherwise("failedTokenize")
    return df.join(once, key, "left").withColumn(f"label_{name}", F.when(F.col(key).isNotNull(), label)).drop("_length")


def group_sizes(df: DataFrame, filters: Sequence[str], key: str) -> DataFrame:
    """Rows (filter, label, n, distinct_keys, consistent): the size of each group, and whether its rows are as many
    as its keys; rows without a label are in no group."""
    cells = F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"label_{f}").alias("label")) for f in filters])
    out = df.select(key, F.explode(cells).alias("c")).where("c.label is not null").groupBy("c.filter", "c.label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("distinct_keys"))
    return out.withColumn("consistent", F.col("n") == F.col("distinct_keys"))


def dedup_report(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Rows (by[0], accepted, rejected): how many of its rows keep_first keeps and drops."""
    runs = df.groupBy(*by).agg(F.count(order).alias("_n"))
    return runs.groupBy(by[0]).agg(F.count(F.lit(1)).alias("accepted"), F.sum(F.col("_n") - 1).alias("rejected"))


def keep_first(df: DataFrame, by: Sequence[str | Column], order: str) -> DataFrame:
    """Of rows with equal `by` (nulls are equal) the one with the least `order`."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def assign_splits(df: DataFrame, splits: Mapping[str, Clauses]) -> DataFrame:
    """df with `split`; a row that several splits take is there once for each."""
    taken = F.filter(F.array(*[F.when(clause_predicate(c), n) for n, c in splits.items()]), lambda x: x.isNotNull())
    return df.select("*", F.explode(taken).alias("split"))


def snapshot(df: DataFrame, path: str, splits: Mapping[str, Clauses], columns: Sequence[str], post: Sequence[Callable[[DataFrame], DataFrame]] = (), test_from: str | None = None) -> None:
    """Write the splits of df, after the post-processors, to Parquet in a folder for each split.

    `test_from`: a snapshot whose test split is taken over instead of this one's.
    """
    out = assign_splits(df, splits)
    for f in post:
        out = f(out)
    out = out.select(*columns, "split")
    if test_from:
        old = df.sparkSession.read.parquet(test_from).where("split = 'test'").select(*columns, "split")
        out = out.where("split <> 'test'").unionByName(old)
    out.write.partitionBy("split").parquet(path)
