"""Trees kept as (id, parent): levels, descendants, roots, nearest ancestors, by one join per level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import checkpointed


def ancestors(nodes: DataFrame, id: str = "id", parent: str = "parent", stop: Column | None = None, most: int = 1000) -> DataFrame:
    """Rows (id, ancestor, distance): each node with itself (0) and all nodes above it.

    `stop`: a predicate on a node; a walk ends at the first ancestor that fulfils it. A parent that is
    not there ends the walk. A walk of over `most` steps is a cycle, and an error.
    """
    up = nodes.select(F.col(id).alias("_id"), F.col(parent).alias("_parent"), (F.lit(False) if stop is None else F.coalesce(stop, F.lit(False))).alias("_stop"))
    front = checkpointed(up.select(F.col("_id").alias(id), F.col("_id").alias("ancestor"), F.lit(0).alias("distance"), F.col("_parent").alias("_next")))
    out = front.drop("_next")
    for step in range(1, most + 1):
        front = checkpointed(front.where("_next is not null").join(up, F.col("_next") == F.col("_id")).select(id, F.col("_id").alias("ancestor"), F.lit(step).alias("distance"), F.when(~F.col("_stop"), F.col("_parent")).alias("_next")))
        if front.isEmpty():
            return out
        out = out.unionByName(front.drop("_next"))
    raise ValueError("the parents form a cycle")


def levels(nodes: DataFrame, id: str = "id", parent: str = "parent") -> DataFrame:
    """Rows (id, level, problem): roots have level 0; `dangling` below a missing parent, `cycle` on or below a cycle.

    Levels are given from the roots down, so that the loop ends on cycles too.
    """
    plain = nodes.select(F.col(id).alias("_id"), F.col(parent).alias("_parent"))
    known = plain.select(F.col("_id").alias("_known"))
    start = plain.join(known, F.col("_parent") == F.col("_known"), "left")
    front = checkpointed(start.where("_known is null").select(F.col("_id").alias(id), F.lit(0).alias("level"), F.when(F.col("_parent").isNotNull(), "dangling").alias("problem")))
    out, step = front, 0
    while not front.isEmpty():
        step += 1
        front = checkpointed(front.join(plain, F.col(id) == F.col("_parent")).select(F.col("_id").alias(id), F.lit(step).alias("level"), "problem"))
        out = out.unionByName(front)
    lost = plain.join(out.select(F.col(id).alias("_known")), F.col("_id") == F.col("_known"), "left_anti")
    return out.unionByName(lost.select(F.col("_id").alias(id), F.lit(None).cast("int").alias("level"), F.lit("cycle").alias("problem")))


def descendants(nodes: DataFrame, roots: DataFrame, id: str = "id", parent: str = "parent", cap: int | None = None, most: int = 1000) -> DataFrame:
    """Rows (root, id, depth, place): each root's tree in the order of (depth, id), the root first.

    Only nodes of `nodes` are walked. `cap` keeps the first so many, the root counted: what lies past
    it is not walked. A walk of over `most` levels is a cycle, and an error.
    """
    down = nodes.select(F.col(id).alias("_id"), F.col(parent).alias("_parent"))
    front = checkpointed(roots.select(F.col(id).alias("root"), F.col(id).alias(id), F.lit(0).alias("depth"), F.lit(1).alias("place")))
    out = front
    for depth in range(1, most + 1):
        taken = front.groupBy("root").agg(F.max("place").alias("_taken"))
        below = front.select("root", F.col(id).alias("_above")).join(down, F.col("_above") == F.col("_parent")).join(taken, "root")
        place = F.col("_taken") + F.row_number().over(Window.partitionBy("root").orderBy("_id"))
        below = below.select("root", F.col("_id").alias(id), F.lit(depth).alias("depth"), place.alias("place"))
        front = checkpointed(below if cap is None else below.where(F.col("place") <= cap))
        if front.isEmpty():
            return out if cap is None else out.where(F.col("place") <= cap)
        out = out.unionByName(front)
    raise ValueError("the parents form a cycle")


def with_parent(nodes: DataFrame, columns: list[str], id: str = "id", parent: str = "parent") -> DataFrame:
    """Each node that has a parent, with the parent's columns as parent_<name>."""
    above = nodes.select(F.col(id).alias("_id"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return nodes.join(above, F.col(parent) == F.col("_id")).drop("_id")


def root_ancestor(nodes: DataFrame, id: str = "id", parent: str = "parent", most: int = 1_000_000) -> DataFrame:
    """Rows (id, root, distance): the farthest ancestor of each node.

    Every node jumps to its parent, then by two, four, ... steps at once: one row a node, and as many
    rounds as the depth has binary digits. A distance of over `most` is a cycle, and an error.
    """
    known = nodes.select(F.col(id).alias("_known"))
    up = nodes.select(F.col(id).alias(id), F.col(parent).alias("_parent")).join(known, F.col("_parent") == F.col("_known"), "left")
    jumps = checkpointed(up.select(id, F.coalesce("_known", id).alias("root"), F.col("_known").isNotNull().cast("int").alias("distance")))
    while True:
        step = jumps.select(F.col(id).alias("_at"), F.col("root").alias("_to"), F.col("distance").alias("_by"))
        after = checkpointed(jumps.join(step, F.col("root") == F.col("_at")).select(id, F.col("_to").alias("root"), (F.col("distance") + F.col("_by")).alias("distance"), F.col("_by").alias("_moved")))
        moved = after.agg(F.max("_moved").alias("m"), F.max("distance").alias("d")).first()
        jumps = after.drop("_moved")
        if not moved.m:
            return jumps
        if moved.d > most:
            raise ValueError("the parents form a cycle")


def nearest_with(nodes: DataFrame, has: Column, step: str, id: str = "id", parent: str = "parent", most: int = 1_000_000) -> DataFrame:
    """Rows (id, nearest, steps): the nearest proper ancestor that fulfils `has`, and the chain of `step` values
    from below it down to the node; nodes without such an ancestor are left out.

    Every node points to its parent and then, as long as it points to no node that fulfils `has`, to
    where that one points, with both chains joined: one row a node, and as many rounds as the depth has
    binary digits. A parent that is not there ends a chain. A chain of over `most` steps is a cycle, and
    an error.
    """
    own = nodes.select(F.col(id).alias("_known"), F.coalesce(has, F.lit(False)).alias("_hit"))
    up = nodes.select(F.col(id).alias("_id"), F.col(parent).alias("_at"), F.array(F.col(step)).alias("_steps"))
    start = up.join(own, F.col("_at") == F.col("_known")).select("_id", "_at", "_steps", "_hit")
    walks = checkpointed(start)
    done = walks.where("_hit")
    open_ = walks.where("not _hit")
    while not open_.isEmpty():
        if open_.agg(F.max(F.size("_steps"))).first()[0] > most:
            raise ValueError("the parents form a cycle")
        further = walks.select(F.col("_id").alias("_at"), F.col("_at").alias("_to"), F.col("_steps").alias("_above"), F.col("_hit").alias("_end"))
        moved = checkpointed(open_.join(further, "_at").select("_id", F.col("_to").alias("_at"), F.concat("_above", "_steps").alias("_steps"), F.col("_end").alias("_hit")))
        done, open_ = done.unionByName(moved.where("_hit")), moved.where("not _hit")
        walks = open_.unionByName(done)
    return done.select(F.col("_id").alias(id), F.col("_at").alias("nearest"), F.col("_steps").alias("steps"))
