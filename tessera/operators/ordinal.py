"""Reproducible order: seeded hashes, and ranks over a whole table without one task that sorts it."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share.

    Where it is unset, a folder of our own if Spark runs in one process (local masters), else an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage through a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def seeded(seed: int | str, *keys: Column | str) -> Column:
    """A hash of seed and keys that orders rows alike on every cluster and in other engines."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]).cast("binary"))


#: Hexadecimal digits by which a selection looks closer, and rows of a cell that the driver may order itself.
DIGITS, CELL_ROWS = 4, 20_000


def cell_counts(df: DataFrame, hashed: str) -> dict[str, int]:
    """Rows by the leading DIGITS of a hexadecimal hash, 65,536 counts at most."""
    cell = F.substring(hashed, 1, DIGITS).alias("cell")
    return {r.cell: r.n for r in df.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).collect()}


def kth(df: DataFrame, hashed: str, key: str, ranks: Sequence[int], cells: dict[str, int] | None = None) -> list[tuple]:
    """For each 1-based rank the (hash, key) that stands there in the order of a hexadecimal hash and the key.

    Counts of leading digits tell in which cell a rank lies; that cell alone is counted by further
    digits, until it is small. No row is sorted or shuffled for it but the few of the last cells. Ranks
    are between 1 and the number of rows. `cells` are the first counts, where they are known.
    """
    cells = cell_counts(df, hashed) if cells is None else cells
    places = {}
    for rank in set(ranks):
        places[rank] = _cell_of(cells, rank)
    digits = DIGITS
    while any(n > CELL_ROWS for _, _, n in places.values()) and digits < 32:
        digits += DIGITS
        wide = sorted({c for c, _, n in places.values() if n > CELL_ROWS})
        inner = df.where(F.substring(hashed, 1, len(wide[0])).isin(wide)).groupBy(F.substring(hashed, 1, digits).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        counts: dict[str, dict[str, int]] = {c: {} for c in wide}
        for r in inner.collect():
            counts[r.cell[: len(wide[0])]][r.cell] = r.n
        places = {k: (_cell_of(counts[c], left) if n > CELL_ROWS else (c, left, n)) for k, (c, left, n) in places.items()}
    last = sorted({c for c, _, _ in places.values()})
    here = reduce(lambda a, b: a | b, [F.startswith(F.col(hashed), F.lit(c)) for c in last]) if last else F.lit(False)
    rows = sorted((r[0], r[1]) for r in df.where(here).select(hashed, key).collect())
    inside = {c: [r for r in rows if r[0].startswith(c)] for c in last}
    return [inside[places[k][0]][places[k][1] - 1] for k in ranks]


def _cell_of(cells: dict[str, int], rank: int) -> tuple[str, int, int]:
    """The cell that holds a rank, the rank within it, and its rows."""
    for cell in sorted(cells):
        if rank <= cells[cell]:
            return cell, rank, cells[cell]
        rank -= cells[cell]
    raise ValueError("the rank is past the last row")


def running_total(df: DataFrame, by: Sequence[str], order: str, amount: str, name: str) -> DataFrame:
    """df with `name`, the sum of `amount` up to and with the row, in the order of `order` within `by`.

    Rows are dealt by ranges of (by, order); the sums of each range and group, a few rows a range, give
    the offsets that are added to the sums within a range. So no task sorts a whole group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(n, *by, order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part", *by).agg(F.sum(amount).alias("_s"))
    w = Window.partitionBy(*by).orderBy("_part") if by else Window.orderBy("_part")
    before = sums.select("_part", *[F.col(c).alias(f"_by_{c}") for c in by], (F.sum("_s").over(w) - F.col("_s")).alias("_before"))
    local = F.sum(amount).over(Window.partitionBy("_part", *by).orderBy(order))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], dealt["_part"] == before["_part"])
    return dealt.withColumn("_local", local).join(before, same).select(*df.columns, (F.col("_before") + F.col("_local")).alias(name))


def global_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with 1-based `name`, its place in `order` over the whole table.

    Rows are dealt by ranges of the order; ranges' counts, one row each, give the offsets that are
    added to the ranks within a range. Equal order values get ranks in no fixed order: add a key.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(n, *cols).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*cols))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + local).drop("_part", "_before")
