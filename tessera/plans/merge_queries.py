"""Merging stores, trees and keyed updates over suppliers, customers, orders and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import hierarchy, merge
from tessera.operators.ordinal import shared_base
from tessera.sources import store

from .registry import query, table


def scratch(spark, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def _stores(spark, sf_dir):
    """Two stores of (id, nation, segment) with overlapping content under other ids."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    a = c.where("id % 2 = 0").groupBy("nation", "segment").agg(F.min("id").alias("id")).select("id", "nation", "segment")
    return a, c.where("id % 2 = 1").select("id", "nation", "segment")


_STORES = """a AS (SELECT min(c_custkey) AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 0 AND KEEP GROUP BY 2, 3), b AS (SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 1),
k AS (SELECT min(b.id) AS f, b.nation, b.segment FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.nation = b.nation AND a.segment = b.segment) GROUP BY 2, 3), n AS (SELECT (SELECT max(id) FROM a) + row_number() OVER (ORDER BY f) AS id, nation, segment FROM k)""".replace("KEEP", "c_nationkey < 12")


@query(f"WITH {_STORES} SELECT * FROM a UNION ALL SELECT * FROM n")
def dim_merge(spark, sf_dir):
    a, b = _stores(spark, sf_dir)
    return merge.merge_dimension(a.where("nation < 12"), b, ["nation", "segment"])[0]


@query(f"""WITH {_STORES}, i AS (SELECT * FROM a UNION ALL SELECT * FROM n), m AS (SELECT b.id AS old_id, i.id AS new_id FROM b JOIN i USING (nation, segment))
SELECT o_orderkey, new_id AS o_custkey FROM orders LEFT JOIN m ON o_custkey = old_id""")
def fact_remap(spark, sf_dir):
    a, b = _stores(spark, sf_dir)
    ids = merge.merge_dimension(a.where("nation < 12"), b, ["nation", "segment"])[1]
    return merge.remap(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), {"o_custkey": ids})


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, role FROM conversations), a AS (SELECT * FROM t WHERE id % 3000 < 1000), b AS (SELECT * FROM t WHERE id % 3000 >= 1000),
m AS (SELECT id AS old, (SELECT coalesce(max(id), 0) FROM a) + row_number() OVER (ORDER BY id) AS new FROM b)
SELECT * FROM a UNION ALL SELECT m.new, p.new, role FROM b JOIN m ON m.old = b.id LEFT JOIN m p ON p.old = b.parent""")
def fact_import(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return merge.import_facts(t.where("id % 3000 < 1000"), t.where("id % 3000 >= 1000"), {})


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"), "role")


@query("""SELECT s_suppkey, CASE WHEN b.k IS NULL THEN 'removed' WHEN a.s_suppkey IS NULL THEN 'added' WHEN a.s_nationkey <> b.n THEN 'changed' ELSE 'same' END AS status FROM
(SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 5 <> 0) a FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS n FROM supplier WHERE s_suppkey % 3 <> 0) b ON a.s_suppkey = b.k""".replace("SELECT s_suppkey, CASE", "SELECT coalesce(a.s_suppkey, b.k) AS s_suppkey, CASE", 1))
def table_diff(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    b = s.where("s_suppkey % 3 <> 0").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 7 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")))
    return merge.table_diff(s.where("s_suppkey % 5 <> 0"), b, "s_suppkey", ["s_nationkey"])


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0")
def conflicting_ids(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    b = s.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 7 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")))
    return merge.conflicting(s, b, "s_suppkey", ["s_nationkey"])


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_keys(spark, sf_dir):
    """Customers that the store of urgent orders lacks."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return merge.missing_keys(table(spark, sf_dir, "customer"), urgent, "c_custkey")


@query("SELECT o_orderkey, CASE WHEN n > 3 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, coalesce(t, o_totalprice) AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_extendedprice) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def outcome_upsert(spark, sf_dir):
    got = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.count(F.lit(1)) > 3, "F").alias("o_orderstatus"), F.max("l_extendedprice").alias("o_totalprice"))
    return merge.upsert(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), got, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("SELECT o_orderkey, t AS trace, CASE WHEN h IS NOT NULL THEN h <> o_orderstatus END AS hash_mismatch FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS t, min(l_linestatus) AS h FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def attach_traces(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("h"), F.lit(None).cast("long").alias("trace"))
    traces = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("trace"), F.min("l_linestatus").alias("h"))
    return merge.attach(runs, traces, "o_orderkey", "trace", "h").select("o_orderkey", "trace", "hash_mismatch")


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, role FROM conversations), f AS (SELECT * FROM t WHERE id % 1000 < 3 AND id % 7 <> 0)
SELECT id, parent, role FROM t WHERE EXISTS (SELECT 1 FROM f WHERE f.id = t.parent) AND NOT EXISTS (SELECT 1 FROM f WHERE f.parent = t.parent AND f.role IS NOT DISTINCT FROM t.role)""")
def tree_sync(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return merge.sync_children(t.where("id % 1000 < 3 AND id % 7 <> 0"), t, ["role"]).select("id", "parent", "role")


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn // 3 END AS parent, role, turn, conv_id FROM conversations),
f AS (SELECT * FROM t WHERE conv_id % 3 <> 0 AND (turn = 0 OR turn <= 3 AND (conv_id + turn) % 3 <> 0)),
l1 AS (SELECT t.id, t.role, t.parent AS up, (SELECT min(f.id) FROM f WHERE f.parent = t.parent AND f.role = t.role) AS fact FROM t JOIN f r ON r.turn = 0 AND r.id = t.parent WHERE t.turn > 0),
m1 AS (SELECT *, CASE WHEN fact IS NULL THEN min(id) OVER (PARTITION BY up, role) END AS made FROM l1),
l2 AS (SELECT t.id, t.role, m1.fact AS up, m1.made, CASE WHEN m1.fact IS NOT NULL THEN (SELECT min(f.id) FROM f WHERE f.parent = m1.fact AND f.role = t.role) END AS fact FROM t JOIN m1 ON m1.id = t.parent WHERE t.role <> 'user'),
m2 AS (SELECT *, min(id) OVER (PARTITION BY up, made, role) AS first FROM l2)
SELECT id AS tree_id, role, 5 AS status, 1 AS level FROM m1 WHERE made = id UNION ALL SELECT id, role, 5, 2 FROM m2 WHERE fact IS NULL AND first = id""")
def tree_sync_levels(spark, sf_dir):
    """Two levels of a tree against a store that lacks some nodes and whole trees; roots match by the conversation.

    Children of one node with one role are twins, and on the second level users' turns are left out.
    """
    c = table(spark, sf_dir, "conversations")
    t = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.floor(F.col("turn") / 3)).alias("parent"), "role", "turn", "conv_id")
    facts = t.where("conv_id % 3 <> 0 AND (turn = 0 OR turn <= 3 AND (conv_id + turn) % 3 <> 0)")
    kind = t.withColumn("other", F.col("role") != "user")
    out = merge.sync_tree(facts, kind, "conv_id", ["role"], "other", {2: [True]}, 2, 5)
    depth = t.select(F.col("id").alias("tree_id"), F.when(F.col("turn") <= 2, 1).otherwise(2).alias("level"))
    return out.join(depth, "tree_id").select("tree_id", "role", "status", "level")


@query("""WITH g AS (SELECT c_custkey AS id, step FROM customer, (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW']) AS step)), l AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = id AND o_orderpriority = step)),
r AS (SELECT id, step, row_number() OVER (PARTITION BY id ORDER BY md5('9-' || id || '-' || step), step) AS k FROM l) SELECT id, step FROM r WHERE k <= 2""")
def candidate_steps(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    taken = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("step"))
    return merge.candidate_steps(nodes, taken, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], ["4-NOT SPECIFIED"], 9, 2)


_TREE = "t AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, role FROM conversations)"


@query(f"""WITH RECURSIVE {_TREE}, d(root, id, depth) AS (SELECT id, id, 0 FROM t WHERE parent IS NULL UNION ALL SELECT root, t.id, depth + 1 FROM d JOIN t ON t.parent = d.id),
r AS (SELECT root, id, depth, row_number() OVER (PARTITION BY root ORDER BY depth, id) AS place FROM d) SELECT root, id, depth, place FROM r WHERE place <= 5""")
def descendants(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return hierarchy.descendants(t, t.where("parent IS NULL"), cap=5)


@query(f"WITH RECURSIVE {_TREE}, d(id, root, distance) AS (SELECT id, id, 0 FROM t WHERE parent IS NULL UNION ALL SELECT t.id, root, distance + 1 FROM d JOIN t ON t.parent = d.id) SELECT id, root, distance FROM d")
def root_ancestor(spark, sf_dir):
    return hierarchy.root_ancestor(_turns(spark, sf_dir))


@query(f"WITH RECURSIVE {_TREE}, d(id, level) AS (SELECT id, 0 FROM t WHERE parent IS NULL UNION ALL SELECT t.id, level + 1 FROM d JOIN t ON t.parent = d.id) SELECT id, level, CAST(NULL AS VARCHAR) AS problem FROM d")
def level_order(spark, sf_dir):
    return hierarchy.levels(_turns(spark, sf_dir))


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS id, turn, conv_id, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)
SELECT id, CASE WHEN conv_id % 5 = 0 OR conv_id % 7 <> 3 THEN turn END AS level, CASE WHEN conv_id % 5 = 0 THEN 'dangling' WHEN conv_id % 7 = 3 THEN 'cycle' END AS problem FROM c WHERE first = 0""")
def level_problems(spark, sf_dir):
    """Turns below a parent that is not there, and conversations whose first turn answers their last."""
    c = table(spark, sf_dir, "conversations")
    ends = c.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last")).where("first = 0")
    above = F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).when(F.col("conv_id") % 5 == 0, -1 - F.col("conv_id")).when(F.col("conv_id") % 7 == 3, F.col("conv_id") * 1000 + F.col("last"))
    return hierarchy.levels(c.join(ends, "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), above.alias("parent")))


@query(f"WITH {_TREE} SELECT t.id, p.id AS parent_id, t.role, p.role AS parent_role FROM t JOIN t p ON t.parent = p.id")
def parent_pair(spark, sf_dir):
    return hierarchy.with_parent(_turns(spark, sf_dir), ["id", "role"]).select("id", "parent_id", "role", "parent_role")


@query(f"""WITH {_TREE}, g AS (SELECT t.id, max(a.id) AS nearest FROM t JOIN t a ON a.id // 1000 = t.id // 1000 AND a.id < t.id AND a.role = 'user' GROUP BY 1)
SELECT id, nearest, (SELECT string_agg(role, '>' ORDER BY x.id) FROM t x WHERE x.id > nearest AND x.id <= g.id) AS steps FROM g""")
def nearest_ancestor(spark, sf_dir):
    got = hierarchy.nearest_with(_turns(spark, sf_dir), F.col("role") == "user", "role")
    return got.select("id", "nearest", F.array_join("steps", ">").alias("steps"))


@query("""SELECT 'customer' AS name, count(*) AS rows, (SELECT string_agg(c_custkey || c_name, ',' ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)) AS first FROM customer
UNION ALL SELECT 'supplier', count(*), (SELECT string_agg(s_suppkey || s_name, ',' ORDER BY s_suppkey) FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 3)) FROM supplier""")
def export_tables(spark, sf_dir):
    """The report's samples are the rows of the three least keys."""
    out = store.export_tables({"customer": (table(spark, sf_dir, "customer"), "c_custkey"), "supplier": (table(spark, sf_dir, "supplier"), "s_suppkey")}, scratch(spark, "export"))
    value = lambda j, a: F.coalesce(F.get_json_object(j, f"$.c_{a}"), F.get_json_object(j, f"$.s_{a}"))
    key = lambda j: F.coalesce(F.get_json_object(j, "$.c_custkey"), F.get_json_object(j, "$.s_suppkey"))
    return out.select("name", "rows", F.array_join(F.transform("samples", lambda j: F.concat(key(j), value(j, "name"))), ",").alias("first"))


@query("SELECT o_orderkey, CAST(0 AS INT) AS \"datasetIdx\", 'train' AS \"datasetSplit\" FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 1, 'test' FROM orders WHERE o_orderstatus <> 'F'")
def snapshots_combined(spark, sf_dir):
    path = scratch(spark, "snapshots")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "train").otherwise("test").alias("split"))
    orders.write.partitionBy("split").parquet(path)
    return store.combine(spark, [(0, path, "train"), (1, path, "test")]).select("o_orderkey", "datasetIdx", "datasetSplit")


@query("SELECT o_orderstatus AS split, count(*) AS n, o_orderstatus <> 'O' AS same FROM orders GROUP BY 1")
def snapshot_audit(spark, sf_dir):
    """A snapshot written, with one value of split O damaged, read again and compared with the manifest made before."""
    path = scratch(spark, "audited")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("split"))
    manifest = store.audit(orders)
    one = orders.where("split = 'O'").agg(F.max("o_orderkey").alias("_damaged"))
    price = F.when(F.col("o_orderkey") == F.col("_damaged"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    orders.join(F.broadcast(one)).select("o_orderkey", price.alias("o_totalprice"), "split").write.partitionBy("split").parquet(path)
    back = spark.read.parquet(path)
    bad = store.audit_problems(back, manifest).withColumn("_bad", F.lit(True))
    return manifest.join(bad, "split", "left").select("split", "n", F.col("_bad").isNull().alias("same"))
