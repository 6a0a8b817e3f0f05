"""Training samples: projections with normalisers, families of variants, cohorts by device, token pairs, named data sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import normalise, scalar
from tessera.sources import store

from . import cohorts, filters, hierarchy, metrics, splits
from .ordinal import global_rank, running_total, seeded

#: Places of one counter that a task spreads out.
RUN = 100_000


def successful_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("errors") == filters.NONE)


def to_be_run(runs: DataFrame, augmentation: int | None = None, traced: bool = False) -> DataFrame:
    """Variants that are stored but not run, optionally of one step; with `traced`, those that have no trace yet."""
    out = runs.where(F.col("errors") == filters.NOT_RUN)
    out = out if augmentation is None else out.where(F.col("augmentation") == augmentation)
    return out.where(F.col("trace").isNull()) if traced else out


def traced_runs(runs: DataFrame, environment, cycles: int, trials: int, blacklist: DataFrame, key: str = "shader") -> DataFrame:
    """Traced runs of an environment at fixed counts, without the listed keys."""
    good = runs.where((F.col("environment") == environment) & F.col("trace").isNotNull() & (F.col("num_cycles") == cycles) & (F.col("num_trials") == trials) & (F.col("errors") == filters.NONE))
    return filters.not_listed(good, key, blacklist)


def project(samples: DataFrame, ids: str, target: str, kind: str = "traced", target_norm: normalise.Pair | None = None, trace: str | None = None, trace_norm: normalise.Pair | None = None, rate: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep..., input_ids, trace_labels, labels): the projections that models are trained on.

    kind: `plain` has no trace, `constant` ones, `traced` the normalised counters. `rate`: the target
    is a frame rate and its inverse is learned. Columns in `keep`, such as a data set's index, go along.
    """
    y = F.col(target).cast("double")
    y = F.try_divide(F.lit(1.0), y) if rate else y
    y = y if target_norm is None else target_norm[0](y)
    t = {"plain": F.lit(None).cast("array<double>"), "constant": scalar.constant_like(F.col(ids)).cast("array<double>")}.get(kind)
    if t is None:
        f = (lambda c: c) if trace_norm is None else trace_norm[0]
        t = F.transform(F.col(trace), lambda c: f(c.cast("double")))
    return samples.select(*keep, F.col(ids).alias("input_ids"), t.alias("trace_labels"), y.alias("labels"))


def family_snapshot(nodes: DataFrame, roots: DataFrame, seed: int, cap: int, share: float = 0.8, id: str = "id", parent: str = "parent") -> DataFrame:
    """Rows (root, members, split): families of a root and its descendants, at most `cap` of them, first by depth.

    ceil(share) of the roots train and the rest test; families of fewer than two are left out.
    """
    family = hierarchy.descendants(nodes, roots, id, parent, cap)
    split = splits.ratio_split(roots.select(F.col(id).alias("root")), "root", seed, [share], ["train", "test"], ceil=True)
    rows = family.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", id))), lambda x: x[id]).alias("members"))
    return rows.where(F.size("members") >= 2).join(split, "root")


def cohort_plan(df: DataFrame, devices: Mapping[str, cohorts.Clauses], more: Mapping[str, cohorts.Clauses], parts: Mapping[str, cohorts.Clauses]) -> DataFrame:
    """Rows (device, split, n): for each device its own clauses, those added for it, and those of each split."""
    found = []
    for device, base in devices.items():
        chosen = cohorts.select_cohort(df, [*base, *more.get(device, [])])
        found.append(cohorts.assign_splits(chosen, parts).groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit(device).alias("device"), "split", "n"))
    return reduce(DataFrame.unionByName, found)


def token_pairs(members: DataFrame, tokens: DataFrame, family: str, key: str, seed: int) -> DataFrame:
    """Rows (family, label, left, right): the tokens of two members of each family, with a label of its id."""
    two = splits.sample_of_group(members, [family], key, seed, 2)
    with_ids = two.join(tokens, key)
    left, right = (F.max(F.when(F.col("pick") == i, F.col("ids"))).alias(n) for i, n in ((1, "left"), (2, "right")))
    return with_ids.groupBy(family).agg(left, right).withColumn("label", scalar.id_label(F.col(family).cast("string")))


def distance_and_time(pairs: DataFrame, opcodes: str, root_opcodes: str, trials: str, root_trials: str) -> DataFrame:
    """pairs with distance, ratio, and mean time of the variant over that of its root."""
    from .stats import array_mean

    d = scalar.opcode_distance(F.col(opcodes), F.col(root_opcodes))
    return pairs.withColumn("distance", d).withColumn("ratio", F.try_divide(F.col("distance"), F.size(root_opcodes))).withColumn("relative_time", F.try_divide(array_mean(F.col(trials)), array_mean(F.col(root_trials))))


def both_spaces(df: DataFrame, real: str, pred: str, pair: normalise.Pair) -> DataFrame:
    """Rows (space, rmse, mae, mape): errors of normalised values, and of values taken back."""
    out = []
    for name, f in (("normalised", lambda c: c), ("original", pair[1])):
        out.append(df.agg(*metrics.errors(f(F.col(real)), f(F.col(pred)))).select(F.lit(name).alias("space"), "*"))
    return out[0].unionByName(out[1])


def flat_counters(df: DataFrame, counters: str) -> DataFrame:
    """Rows (n, greatest, least) over all counters of all arrays."""
    c = df.select(F.explode(counters).alias("c"))
    return c.agg(F.count("c").alias("n"), F.max("c").alias("greatest"), F.min("c").alias("least"))


def sorted_counters(df: DataFrame, counters: str) -> DataFrame:
    """Rows (counter, place): all counters of all arrays in order.

    Distinct counters are ranked by ranges, with the number of their occurrences; each is then dealt
    over parts of RUN places and spread out there, so that no task holds all rows of a frequent one.
    """
    counts = df.select(F.explode(counters).alias("counter")).where("counter is not null").groupBy("counter").agg(F.count(F.lit(1)).alias("_n"))
    ends = running_total(counts, [], "counter", "_n", "_end")
    first = F.col("_end") - F.col("_n") + 1
    parts = ends.select("counter", first.alias("_first"), "_end", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))).alias("_part"))
    begin = F.col("_first") + F.col("_part") * RUN
    dealt = parts.select("counter", begin.alias("_from"), F.least("_end", begin + RUN - 1).alias("_upto"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "_from").select("counter", F.explode(F.sequence("_from", "_upto")).alias("place"))


def regression_grid(data: DataFrame, features: Mapping[str, Sequence[str]], weights: Mapping[str, Column | None], real: str, split: str, key: str) -> DataFrame:
    """Rows (features, weight, split, n, rmse, mae, mape): every feature set with every weight, fitted on `train`.

    The fits are a loop over the grid; predictions are stacked and measured in one pass.
    """
    from .regress import ols

    stacked = []
    for name, cols in features.items():
        for weight, w in weights.items():
            coef = dict(ols(data.where(F.col(split) == "train"), cols, real, w))
            pred = sum((F.col(c) * F.lit(coef[c]) for c in cols), F.lit(coef["(intercept)"]))
            stacked.append(data.select(F.lit(name).alias("features"), F.lit(weight).alias("weight"), split, key, F.col(real).cast("double").alias("_y"), pred.alias("_p")))
    return reduce(DataFrame.unionByName, stacked).groupBy("features", "weight", split).agg(F.count(F.lit(1)).alias("n"), *metrics.errors(F.col("_y"), F.col("_p")))


def write_coefficients(coefficients: DataFrame, path: str, kind: str) -> None:
    coefficients.withColumn("kind", F.lit(kind)).write.json(path)


def read_coefficients(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The table that was written as this kind; another kind fails the job."""
    got = spark.read.schema("feature string, coef double, kind string").json(path)
    checked = F.when(F.col("kind") == kind, F.col("feature")).otherwise(F.raise_error(F.concat(F.lit("coefficients of kind "), "kind")).cast("string"))
    return got.select(checked.alias("feature"), "coef")


class Catalog:
    """Named data sets, tokenisers and maps: a name gives a function of the session, or of a DataFrame."""

    def __init__(self):
        self.maps: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.datasets: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.tokenisers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add_snapshot(self, name: str, path: str) -> None:
        self._add(self.datasets, name, lambda spark, split: store.read_split(spark, path, split))

    def add_tokeniser(self, name: str, f: Callable[[DataFrame], DataFrame]) -> None:
        self._add(self.tokenisers, name, f)

    def add_map(self, name: str, f: Callable[[DataFrame], DataFrame]) -> None:
        self._add(self.maps, name, f)

    def mapped(self, df: DataFrame, *names: str) -> DataFrame:
        """df after the named maps, one after the other."""
        return reduce(lambda d, n: d.transform(self.maps[n]), names, df)

    @staticmethod
    def _add(where: dict, name: str, f) -> None:
        if name in where:
            raise ValueError(f"{name} is registered")
        where[name] = f

    def dataset(self, spark: SparkSession, name: str, split: str) -> DataFrame:
        return self.datasets[name](spark, split)

    def tokenise(self, name: str, df: DataFrame) -> DataFrame:
        return self.tokenisers[name](df)


def epoch_sample(df: DataFrame, key: str, seed: int, epoch: int, size: int) -> DataFrame:
    """`size` rows drawn with replacement, with `draw` from 1: draw i takes the row whose place, by key, is a hash's
    remainder. The same draws on every cluster; none if df has no rows."""
    ranked = global_rank(df, key, name="_place")
    total = ranked.agg(F.count(F.lit(1)).alias("_t"))
    number = lambda i: F.conv(F.substring(seeded(seed, F.lit(epoch), i), 1, 15), 16, 10).cast("long")
    draws = df.sparkSession.range(1, size + 1).withColumnRenamed("id", "draw").join(F.broadcast(total.where("_t > 0")))  # one row
    draws = draws.select("draw", (number(F.col("draw")) % F.col("_t") + 1).alias("_place"))
    return ranked.join(draws, "_place").drop("_place")
