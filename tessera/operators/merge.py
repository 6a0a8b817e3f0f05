"""Merging stores: dimensions by natural key, facts with remapped keys, differences, keyed updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import checkpointed, global_rank


def _same(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])


def merge_dimension(target: DataFrame, source: DataFrame, natural: Sequence[str], id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(merged, id map): rows of source that target lacks get ids after its greatest, in the order of source ids.

    Natural keys are equal also where null. Source rows with equal natural keys become one row. The
    map has (old_id, new_id) for each source id; a source row that is there twice counts once, and two
    different rows of one id fail the job.
    """
    source = one_each(source, id, [c for c in source.columns if c != id])
    keys = source.groupBy(*natural).agg(F.min(id).alias("_first"))
    old = target.groupBy(*natural).agg(F.min(id).alias("_id"))
    missing = keys.join(old, _same(keys, old, natural), "left_anti")
    top = target.agg(F.coalesce(F.max(id), F.lit(0)).alias("_top"))
    fresh = global_rank(missing, "_first", name="_rank").join(F.broadcast(top)).withColumn("_id", F.col("_top") + F.col("_rank"))
    rows = source.join(fresh.select(F.col("_first").alias(id), "_id"), id).select(F.col("_id").alias(id), *[c for c in source.columns if c != id])
    ids = old.unionByName(fresh.select(*natural, "_id"))
    mapped = source.join(ids, _same(source, ids, natural)).select(source[id].alias("old_id"), F.col("_id").alias("new_id"))
    return target.unionByName(rows), mapped


def salted_join(big: DataFrame, small: DataFrame, on: str, spread: str, salts: int = 32) -> DataFrame:
    """big inner-joined to small on a column of which one value may hold much of big.

    Rows of big are dealt over `salts` parts of each value by the hash of `spread`, and those of small
    are in all of them, so that no task gets all rows of a value.
    """
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    every = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(every, [on, "_salt"]).drop("_salt")


def content_hash(cols: Sequence[str]) -> Column:
    """SHA-256 over columns, null apart from any text."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def conflicting(a: DataFrame, b: DataFrame, id: str, cols: Sequence[str]) -> DataFrame:
    """Ids that both have with different content."""
    x, y = a.select(id, content_hash(cols).alias("_a")), b.select(id, content_hash(cols).alias("_b"))
    return x.join(y, id).where("_a <> _b").select(id)


def one_each(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Rows (key, cols...), one for each key: equal rows count once, and different rows of one key fail the job."""
    row = F.struct(*cols)
    both = df.groupBy(key).agg(F.min(row).alias("_a"), F.max(row).alias("_z"))
    safe = F.when(F.col("_a").eqNullSafe(F.col("_z")), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("different rows of one key: "), F.col(key).cast("string"))).cast(df.schema[key].dataType))
    return both.select(safe.alias(key), *[F.col("_a")[c].alias(c) for c in cols])


def remap(facts: DataFrame, maps: Mapping[str, DataFrame]) -> DataFrame:
    """facts with each key column replaced through its (old_id, new_id) map; null stays null and a key
    without a new id becomes null. Repeated rows of a map count once; two new ids for one old id fail the job."""
    for col, m in maps.items():
        ids = one_each(m.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new")), "_old", ["_new"])
        facts = facts.join(ids, F.col(col) == F.col("_old"), "left").withColumn(col, F.col("_new")).drop("_old", "_new")
    return facts


def import_facts(target: DataFrame, source: DataFrame, maps: Mapping[str, DataFrame], id: str = "id", parent: str = "parent") -> DataFrame:
    """target with source's rows appended: new ids first, then all keys and the parent remapped, in any order."""
    top = target.agg(F.coalesce(F.max(id), F.lit(0)).alias("_top"))
    ids = global_rank(source.select(id), id, name="_r").join(F.broadcast(top)).select(F.col(id).alias("old_id"), (F.col("_top") + F.col("_r")).alias("new_id"))
    return target.unionByName(remap(source, {**maps, parent: ids, id: ids}).select(*target.columns))


#: Leading bits of a key's hash that make a range of the first and of the second level; ranges up to which their list is broadcast.
RANGE_BITS, BROADCAST_RANGES = (12, 24), 1_000_000


def _range_of(key: str, level: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - RANGE_BITS[level])


def differing_ranges(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Rows (range): the second level's ranges of key hashes whose rows differ between a and b.

    A range's checksum is its number of rows and the sum of their hashes. The first level's, 4,096 a
    table, tell which ranges to look at on the second; each task sends one row a range at most, and
    rows themselves are not shuffled. Rows with null keys are in no range.
    """

    def sums(df: DataFrame, level: int) -> DataFrame:
        row = F.xxhash64(key, *cols).cast("decimal(38,0)")
        return df.where(F.col(key).isNotNull()).groupBy(_range_of(key, level).alias("range")).agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("sum"))

    def apart(x: DataFrame, y: DataFrame, level: int) -> DataFrame:
        one, two = sums(x, level), sums(y, level).select(F.col("range").alias("_range"), F.col("n").alias("_n"), F.col("sum").alias("_sum"))
        both = one.join(two, F.col("range") == F.col("_range"), "full_outer")
        return both.where(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("sum").eqNullSafe(F.col("_sum")))).select(F.coalesce("range", "_range").alias("range"))

    wide = [r.range for r in apart(a, b, 0).collect()]
    inside = _range_of(key, 0).isin(wide) if wide else F.lit(False)
    return apart(a.where(inside), b.where(inside), 1)


def _in_ranges(df: DataFrame, ranges: DataFrame, key: str, how: str) -> DataFrame:
    """The rows of df in (left_semi) or outside (left_anti) the ranges."""
    return df.where(F.col(key).isNotNull()).withColumn("_range", _range_of(key, 1)).join(ranges.select(F.col("range").alias("_range")), "_range", how).drop("_range")


def _few(ranges: DataFrame) -> DataFrame:
    """The ranges, cut from their lineage, and broadcast where they are few."""
    ranges = checkpointed(ranges)
    return F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges


def table_diff(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Rows (key, status): added, removed, changed or same, from a to b, for tables of distinct keys.

    Only rows of ranges that differ are joined; those of other ranges are the same. A row with a null
    key has no partner.
    """
    ranges = _few(differing_ranges(a, b, key, cols))
    part = lambda df, name: _in_ranges(df, ranges, key, "left_semi").select(key, content_hash(cols).alias(name))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    joined = part(a, "_a").join(part(b, "_b"), key, "full_outer").select(key, status.alias("status"))
    rest = _in_ranges(a, ranges, key, "left_anti").select(key, F.lit("same").alias("status"))
    alone = lambda df, name: df.where(F.col(key).isNull()).select(key, F.lit(name).alias("status"))
    return joined.unionByName(rest).unionByName(alone(a, "removed")).unionByName(alone(b, "added"))


def missing_keys(online: DataFrame, offline: DataFrame, key: str, distinct: bool = False) -> DataFrame:
    """Distinct keys of online that offline lacks, but for null.

    With `distinct`, for stores whose keys are known to be distinct, only ranges of keys that differ are
    compared, as by table_diff.
    """
    a, b = online.select(key), offline.select(key)
    if distinct:
        ranges = _few(differing_ranges(a, b, key, []))
        a, b = (_in_ranges(df, ranges, key, "left_semi") for df in (a, b))
    return a.where(F.col(key).isNotNull()).distinct().join(b, key, "left_anti")


def upsert(target: DataFrame, updates: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """target with the columns that an update has (not null) replaced, by key; different updates of one key fail the job."""
    new = one_each(updates.select(key, *[F.col(c).alias(f"_{c}") for c in cols]), key, [f"_{c}" for c in cols])
    out = target.join(new, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in target.columns])


def attach(runs: DataFrame, traces: DataFrame, key: str, value: str, hash_col: str) -> DataFrame:
    """runs with the trace's value and hash_mismatch: whether the trace run's hash differs; null without a trace.

    Different traces of one key fail the job.
    """
    t = one_each(traces.select(key, F.col(value).alias(value), F.col(hash_col).alias("_h")), key, [value, "_h"])
    return runs.drop(value).join(t, key, "left").withColumn("hash_mismatch", F.col("_h") != F.col(hash_col)).drop("_h")


def sync_children(facts: DataFrame, tree: DataFrame, natural: Sequence[str], id: str = "id", parent: str = "parent") -> DataFrame:
    """Tree nodes to insert: those whose parent is in facts and has no child of equal `natural` columns there.

    Tree and facts share node ids through `id`; equal includes null.
    """
    have = facts.select(F.col(parent).alias("_p"), *[F.col(c).alias(f"_{c}") for c in natural])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in natural], F.col(parent) == F.col("_p"))
    return tree.join(facts.select(F.col(id).alias(parent)), parent, "left_semi").join(have, same, "left_anti")


def sync_tree(facts: DataFrame, tree: DataFrame, root_key: str, natural: Sequence[str], kind: str, kinds: Mapping[int, Sequence], depth: int, status: int, id: str = "id", parent: str = "parent") -> DataFrame:
    """Rows (tree_id, id, parent, natural..., status) to insert so that facts has the tree, level by level.

    A tree root stands for the one fact root of its `root_key`; with no match or several, its tree is
    left out. On each level down to `depth`, a child is there already if a fact below its mapped parent
    has equal `natural` columns (null equals null); else it is inserted with the next id, in the order
    of tree ids. Of several children of one parent with equal columns the one of least tree id is
    inserted, and the others are mapped to it. `kinds` limits the kinds of a level, for the levels
    (from 1) that it has; children of what is left out are not walked.
    """
    f = facts.select(F.col(id).alias("_fid"), F.col(parent).alias("_fparent"), *[F.col(c).alias(f"_{c}") for c in natural])
    heads = facts.where(F.col(parent).isNull()).groupBy(root_key).agg(F.min(id).alias("_fact"), F.count(F.lit(1)).alias("_n")).where("_n = 1")
    mapped = checkpointed(tree.where(F.col(parent).isNull()).join(heads, root_key).select(F.col(id).alias("_above"), "_fact"))
    top, fresh = facts.agg(F.coalesce(F.max(id), F.lit(0)).alias("top")).first().top, None
    for level in range(1, depth + 1):
        allowed = tree.where(F.col(kind).isin(list(kinds[level]))) if level in kinds else tree
        children = allowed.join(mapped, F.col(parent) == F.col("_above")).select(F.col(id).alias("tree_id"), F.col("_fact").alias("_under"), *natural)
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in natural], F.col("_under") == F.col("_fparent"))
        there = children.join(f, same, "left").groupBy("tree_id", "_under", *natural).agg(F.min("_fid").alias("_fact"))
        there = checkpointed(there)
        absent = there.where("_fact is null")
        first = absent.groupBy("_under", *natural).agg(F.min("tree_id").alias("tree_id"))
        new = global_rank(first, "tree_id", name="_r").select("tree_id", (F.col("_r") + top).alias(id), F.col("_under").alias(parent), *natural, F.lit(status).alias("status"))
        new = checkpointed(new)
        made = new.select(F.col(id).alias("_made"), F.col(parent).alias("_made_under"), *[F.col(c).alias(f"_made_{c}") for c in natural])
        twin = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_made_{c}")) for c in natural], F.col("_under") == F.col("_made_under"))
        top += new.count()
        fresh = new if fresh is None else fresh.unionByName(new)
        mapped = checkpointed(there.where("_fact is not null").select(F.col("tree_id").alias("_above"), "_fact").unionByName(absent.join(made, twin).select(F.col("tree_id").alias("_above"), F.col("_made").alias("_fact"))))
        if mapped.isEmpty():
            break
    return fresh


def candidate_steps(nodes: DataFrame, taken: DataFrame, steps: Sequence[str], excluded: Sequence[str], seed: int, n: int, id: str = "id", parent: str = "parent", step: str = "step") -> DataFrame:
    """Rows (id, step): n steps of each node, in seeded order, among those neither excluded nor taken by a child."""
    from pyspark.sql import Window

    from .ordinal import seeded

    free = [s for s in steps if s not in set(excluded)]
    grid = nodes.select(id, F.explode(F.array(*[F.lit(s) for s in free])).alias(step))
    left = grid.join(taken.select(F.col(parent).alias(id), step).distinct(), [id, step], "left_anti")
    return left.withColumn("_r", F.row_number().over(Window.partitionBy(id).orderBy(seeded(seed, id, step), step))).where(F.col("_r") <= n).drop("_r")
