"""Cohorts, splits and coverage over orders (runs), line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cohorts, coverage, filters, splits

from .registry import query, table

LIMIT = 150000.0
CLAUSES = [[("error", "errorO"), ("error", "errorF")], [("environment", "EnvId1-URGENT"), ("environment", "EnvId2-HIGH")], [("mean", "meanBelowOrEqualThreshold150000.0")]]


def labelled_orders(spark, sf_dir):
    labels = cohorts.Labels()
    labels.register(lambda df: cohorts.label_value("error", "o_orderstatus"), "error")
    labels.register(lambda df: cohorts.label_value("EnvId", "o_orderpriority"), "environment")
    labels.register(lambda df: cohorts.label_threshold("o_totalprice", LIMIT, "meanBelowOrEqualThreshold", "meanAboveThreshold", "NaN"), "mean")
    return labels.apply(table(spark, sf_dir, "orders"))


_LABELS = f"""l AS (SELECT *, 'error' || o_orderstatus AS label_error, 'EnvId' || o_orderpriority AS label_environment,
  CASE WHEN o_totalprice IS NULL THEN 'NaN' WHEN o_totalprice <= {LIMIT} THEN 'meanBelowOrEqualThreshold150000.0' ELSE 'meanAboveThreshold150000.0' END AS label_mean FROM orders)"""
_A, _B, _C = "label_error IN ('errorO', 'errorF')", "label_environment IN ('EnvId1-URGENT', 'EnvId2-HIGH')", "label_mean = 'meanBelowOrEqualThreshold150000.0'"


@query(f"WITH {_LABELS} SELECT o_orderkey, label_error, label_environment, label_mean FROM l WHERE {_A} AND {_B} AND {_C}")
def cohort_cnf(spark, sf_dir):
    return cohorts.select_cohort(labelled_orders(spark, sf_dir), CLAUSES).select("o_orderkey", "label_error", "label_environment", "label_mean")


@query(f"""WITH {_LABELS}
SELECT 0 AS step, CAST(NULL AS VARCHAR) AS label, count(*) AS n FROM l UNION ALL
SELECT 1, NULL, count(*) FILTER (WHERE {_A}) FROM l UNION ALL
SELECT 1, 'error:errorO', count(*) FILTER (WHERE label_error = 'errorO') FROM l UNION ALL
SELECT 1, 'error:errorF', count(*) FILTER (WHERE label_error = 'errorF') FROM l UNION ALL
SELECT 2, NULL, count(*) FILTER (WHERE {_A} AND {_B}) FROM l UNION ALL
SELECT 2, 'environment:EnvId1-URGENT', count(*) FILTER (WHERE {_A} AND label_environment = 'EnvId1-URGENT') FROM l UNION ALL
SELECT 2, 'environment:EnvId2-HIGH', count(*) FILTER (WHERE {_A} AND label_environment = 'EnvId2-HIGH') FROM l UNION ALL
SELECT 3, NULL, count(*) FILTER (WHERE {_A} AND {_B} AND {_C}) FROM l UNION ALL
SELECT 3, 'mean:meanBelowOrEqualThreshold150000.0', count(*) FILTER (WHERE {_A} AND {_B} AND {_C}) FROM l""")
def cohort_funnel(spark, sf_dir):
    return cohorts.funnel(labelled_orders(spark, sf_dir), CLAUSES)


@query(f"""WITH {_LABELS}, e AS (SELECT DISTINCT label_error FROM l), v AS (SELECT DISTINCT label_environment FROM l), m AS (SELECT DISTINCT label_mean FROM l)
SELECT label_error, CAST(NULL AS VARCHAR) AS label_environment, CAST(NULL AS VARCHAR) AS label_mean, count(*) AS n FROM l GROUP BY 1 UNION ALL
SELECT NULL, label_environment, NULL, count(*) FROM l GROUP BY 2 UNION ALL
SELECT NULL, NULL, label_mean, count(*) FROM l GROUP BY 3 UNION ALL
SELECT e.label_error, v.label_environment, NULL, (SELECT count(*) FROM l WHERE l.label_error = e.label_error AND l.label_environment = v.label_environment) FROM e, v UNION ALL
SELECT e.label_error, NULL, m.label_mean, (SELECT count(*) FROM l WHERE l.label_error = e.label_error AND l.label_mean = m.label_mean) FROM e, m UNION ALL
SELECT NULL, v.label_environment, m.label_mean, (SELECT count(*) FROM l WHERE l.label_mean = m.label_mean AND l.label_environment = v.label_environment) FROM v, m""")
def cohort_lattice(spark, sf_dir):
    return cohorts.lattice(labelled_orders(spark, sf_dir), ["error", "environment", "mean"])


@query(f"""WITH {_LABELS} SELECT 'error:errorO' AS a, 'environment:EnvId1-URGENT' AS b, count(*) FILTER (WHERE label_error = 'errorO' AND label_environment = 'EnvId1-URGENT') AS n FROM l UNION ALL
SELECT 'error:errorP', 'environment:EnvId5-LOW', count(*) FILTER (WHERE label_error = 'errorP' AND label_environment = 'EnvId5-LOW') FROM l""")
def cohort_overlap(spark, sf_dir):
    return cohorts.pair_overlap(labelled_orders(spark, sf_dir), [(("error", "errorO"), ("environment", "EnvId1-URGENT")), (("error", "errorP"), ("environment", "EnvId5-LOW"))])


@query("""SELECT l_returnflag AS shader, l_linestatus, count(*) AS n FROM (SELECT *, CASE WHEN l_tax IS NULL THEN NULL WHEN l_tax IN (0.0, 0.08) THEN 'victimHash' ELSE 'normalHash' END AS f,
 l_linenumber || 'cycles-' || CAST(l_quantity AS INT) || 'trials' AS r, CASE WHEN l_discount > 0.05 THEN 'haveTrace' ELSE 'noTrace' END AS t FROM lineitem) WHERE f = 'normalHash' AND t = 'haveTrace' AND r IN ('1cycles-10trials', '2cycles-20trials') GROUP BY 1, 2""")
def cohort_labels(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int")).withColumn("trace", F.when(F.col("l_discount") > 0.05, 1))
    labels = cohorts.Labels()
    labels.register(lambda df: cohorts.label_pair("l_linenumber", "q", "{}cycles-{}trials"), "runs")
    labels.register(lambda df: cohorts.label_present("trace"), "trace")
    labels.register(lambda df: cohorts.label_in("l_tax", [0.0, 0.08]), "frame")
    got = cohorts.select_cohort(labels.apply(items), [[("frame", "normalHash")], [("trace", "haveTrace")], [("runs", "1cycles-10trials"), ("runs", "2cycles-20trials")]])
    return got.groupBy(F.col("l_returnflag").alias("shader"), "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN n_name IN ('NATION_1', 'NATION_2') THEN 'europe' WHEN n_name IN ('NATION_3', 'NATION_4') THEN 'asia' END AS label_region
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def cohort_lists(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    lists = nation.where(F.col("n_name").isin("NATION_1", "NATION_2", "NATION_3", "NATION_4")).select("n_nationkey", F.when(F.col("n_name").isin("NATION_1", "NATION_2"), "europe").otherwise("asia").alias("group"))
    runs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("n_nationkey"))
    return cohorts.label_lists(runs, "n_nationkey", lists, "region").select("o_orderkey", "label_region")


@query("SELECT c_custkey, count(DISTINCT o_orderstatus) AS n_groups FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def cohort_disjoint(spark, sf_dir):
    return cohorts.overlapping_groups(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("group")), "c_custkey")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, total ORDER BY o_orderkey) AS k FROM s) SELECT o_custkey, o_orderkey, total FROM r WHERE k = 1""")
def trace_dedup(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))
    return cohorts.keep_first(runs.join(sums, "o_orderkey"), ["o_custkey", "total"], "o_orderkey").select("o_custkey", "o_orderkey", "total")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, sum(CAST(l_quantity AS BIGINT)) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT o_custkey, count(DISTINCT total) AS accepted, CAST(count(*) - count(DISTINCT total) AS BIGINT) AS rejected FROM s GROUP BY 1""")
def trace_dedup_report(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))
    return cohorts.dedup_report(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(sums, "o_orderkey"), ["o_custkey", "total"], "o_orderkey")


@query(f"""WITH {_LABELS} SELECT 'error' AS filter, label_error AS label, count(*) AS n, count(DISTINCT o_custkey) AS distinct_keys, count(*) = count(DISTINCT o_custkey) AS consistent FROM l GROUP BY 2
UNION ALL SELECT 'environment', label_environment, count(*), count(DISTINCT o_custkey), count(*) = count(DISTINCT o_custkey) FROM l GROUP BY 2""")
def group_sizes(spark, sf_dir):
    return cohorts.group_sizes(labelled_orders(spark, sf_dir), ["error", "environment"], "o_custkey")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE l_returnflag WHEN 'R' THEN sha256(unhex(repeat('ff', 4 * (l_suppkey % 3 + 1) * l_linenumber))) WHEN 'A' THEN sha256(unhex(repeat('00', 4 * (l_suppkey % 3 + 1) * l_linenumber))) WHEN 'N' THEN CASE WHEN l_quantity > 10 THEN sha256(CAST(l_partkey AS VARCHAR)) END END AS hash FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN hash IS NULL THEN NULL WHEN l_returnflag IN ('R', 'A') THEN 'victimHash' ELSE 'normalHash' END AS label_frame FROM f""")
def cohort_frames(spark, sf_dir):
    """Runs whose image is all white or all zero, by the hash of such a frame of their size."""
    items = table(spark, sf_dir, "lineitem").withColumns({"w": F.col("l_suppkey") % 3 + 1, "h": F.col("l_linenumber").cast("long")})
    frame = lambda byte: cohorts.constant_frame_hash(byte, F.col("w"), F.col("h"))
    image = F.when(F.col("l_returnflag") == "R", frame("ff")).when(F.col("l_returnflag") == "A", frame("00")).when((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 10), F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256))
    return cohorts.label_constant_frame(items.withColumn("hash", image), "hash", "w", "h").select("l_orderkey", "l_linenumber", "label_frame")


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND n_name = 'NATION_3' AND c_acctbal >= 0")
def node_runs(spark, sf_dir):
    """Runs of one node with their program, without those of a blacklist."""
    runs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    runs = runs.select("o_orderkey", F.col("c_nationkey").alias("environment"), F.col("c_custkey").alias("shader"), F.when(F.col("o_orderpriority") == "1-URGENT", 30).alias("num_cycles"), F.lit(10).alias("num_trials"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("errors"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("node"))
    shaders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("shader_id"))
    black = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_name").alias("shader_id"))
    return filters.node_runs(runs, nodes, shaders, "NATION_3", 30, 10, black).select("o_orderkey")


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 10 = 0 OR c_acctbal > 5000")
def resource_or_none(spark, sf_dir):
    """Runs whose resource fulfils a predicate, and those without one."""
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("resource"))
    res = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "resource")
    return filters.restrict_resources(runs, res, F.col("c_acctbal") > 5000, keep_null=True).select("o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_7', 'NATION_19')")
def listed_exactly(spark, sf_dir):
    return filters.listed_exactly(table(spark, sf_dir, "nation"), "n_name", ["NATION_1", "NATION_7", "NATION_19"]).select("n_nationkey", "n_name")


@query("""WITH d AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
SELECT 'train' AS split, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM d WHERE k = 1 UNION ALL SELECT 'test', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderpriority = '3-MEDIUM'""")
def cohort_post(spark, sf_dir):
    """A snapshot after a post-processor that keeps a customer's first run, its test split taken over from another snapshot."""
    from .merge_queries import scratch

    rows, columns = labelled_orders(spark, sf_dir), ["o_orderkey", "o_custkey"]
    old, new = scratch(spark, "old-snapshot"), scratch(spark, "new-snapshot")
    cohorts.snapshot(rows, old, {"test": SPLITS["test"]}, columns)
    parts = {"train": SPLITS["train"], "test": [[("environment", "EnvId5-LOW")]]}
    cohorts.snapshot(rows, new, parts, columns, post=[lambda df: cohorts.keep_first(df, ["split", "o_custkey"], "o_orderkey")], test_from=old)
    return spark.read.parquet(new).groupBy(F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


SPLITS = {"train": [[("environment", "EnvId1-URGENT"), ("environment", "EnvId2-HIGH")]], "test": [[("environment", "EnvId3-MEDIUM")]], "val": [[("error", "errorP")]]}


@query("""SELECT 'train' AS split, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') UNION ALL
SELECT 'test', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderpriority = '3-MEDIUM' UNION ALL SELECT 'val', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderstatus = 'P'""")
def cohort_snapshot(spark, sf_dir):
    """Written as a snapshot in the shared folder, read back, and audited."""
    from .merge_queries import scratch

    path = scratch(spark, "snapshot")
    cohorts.snapshot(labelled_orders(spark, sf_dir), path, SPLITS, ["o_orderkey", "o_totalprice"])
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def _ranked(seed: int, key: str, source: str) -> str:
    return f"k AS (SELECT {key}, row_number() OVER (ORDER BY md5('{seed}-' || {key}), {key}) AS r, count(*) OVER () AS t FROM (SELECT DISTINCT {key} FROM {source}))"


@query(f"WITH {_ranked(7, 'o_orderkey', 'orders')} SELECT o_orderkey, CASE WHEN r <= floor(t * 0.8) THEN 'train' ELSE 'test' END AS split FROM k")
def split_seeded(spark, sf_dir):
    return splits.ratio_split(table(spark, sf_dir, "orders"), "o_orderkey", 7, [0.8], ["train", "test"])


@query(f"""WITH {_ranked(2021, 'o_custkey', 'orders')}, s AS (SELECT o_custkey, CASE WHEN r <= floor(t * 0.8) THEN 'train' WHEN r <= floor(t * 0.8) + floor(t * 0.05) THEN 'val' ELSE 'test' END AS split FROM k)
SELECT split, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_groups, round(sum(o_totalprice), 2) AS total FROM orders JOIN s USING (o_custkey) GROUP BY 1""")
def split_group_aware(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    split = splits.ratio_split(orders, "o_custkey", 2021, [0.8, 0.05], ["train", "val", "test"])
    return orders.join(split, "o_custkey").groupBy("split").agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_groups"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"WITH {_ranked(3, 'c_custkey', 'customer')} SELECT c_custkey, CASE WHEN r <= ceil(t * 0.8) THEN 'train' ELSE 'test' END AS split FROM k")
def split_roots(spark, sf_dir):
    return splits.ratio_split(table(spark, sf_dir, "customer"), "c_custkey", 3, [0.8], ["train", "test"], ceil=True)


@query(f"""WITH {_ranked(7, 'c_custkey', 'customer')}, a AS (SELECT c_custkey, CASE WHEN r <= floor(t * 0.8) THEN 'train' ELSE 'test' END AS s FROM k),
b AS (SELECT c_custkey, CASE WHEN r <= floor(t * 0.7) THEN 'train' ELSE 'test' END AS s FROM k WHERE c_custkey % 50 <> 0)
SELECT a.c_custkey, CASE WHEN b.s IS NULL THEN 'new' ELSE 'moved' END AS problem FROM a LEFT JOIN b USING (c_custkey) WHERE a.s IS DISTINCT FROM b.s""")
def split_verified(spark, sf_dir):
    """An assignment against a frozen one that was made with another share and without some keys."""
    customers = table(spark, sf_dir, "customer")
    frozen = splits.ratio_split(customers, "c_custkey", 7, [0.7], ["train", "test"]).where("c_custkey % 50 <> 0")
    return splits.verify_split(splits.ratio_split(customers, "c_custkey", 7, [0.8], ["train", "test"]), frozen, "c_custkey")


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY md5('5-' || (conv_id * 1000 + turn)), conv_id * 1000 + turn) AS pick, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, pick FROM r WHERE pick <= 2 AND n >= 2""")
def pair_examples(spark, sf_dir):
    members = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return splits.sample_of_group(members, ["conv_id"], "id", 5, 2).select("conv_id", "turn", "pick")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' ORDER BY md5('11-' || (l_orderkey * 10 + l_linenumber)), l_orderkey * 10 + l_linenumber LIMIT 1000")
def sample_runs(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return splits.sample_rows(items, "id", 11, 1000).select("l_orderkey", "l_linenumber")


@query(f"""WITH {_ranked(2021, 'o_custkey', 'orders')}, s AS (SELECT o_custkey FROM k WHERE r <= floor(t * 0.8))
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT o_custkey FROM s)""")
def deviating_rows_added(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    split = splits.ratio_split(orders, "o_custkey", 2021, [0.8], ["train", "test"])
    return splits.restrict_to_train(orders.where("o_orderstatus = 'P'"), split, "o_custkey").select("o_orderkey")


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_discount", "l_quantity")


@query("""WITH f AS (SELECT l_orderkey, bool_or(ok) AS any_ok, bool_and(ok) AS all_ok, bool_or(ok AND tr) AS any_traced, bool_and(ok AND tr) AS all_traced, bool_or(ok AND ca) AS any_ok_canonical,
  count(*) FILTER (WHERE ca) > 0 AND count(*) FILTER (WHERE ca AND NOT ok) = 0 AS all_ok_canonical, bool_or(ok AND tr AND ca) AS any_traced_canonical, count(*) FILTER (WHERE ca) > 0 AND count(*) FILTER (WHERE ca AND NOT (ok AND tr)) = 0 AS all_traced_canonical
  FROM (SELECT l_orderkey, l_linestatus = 'F' AS ok, l_discount > 0 AS tr, l_quantity >= 10 AS ca FROM lineitem) GROUP BY 1)
SELECT count(*) AS n_keys, count(*) FILTER (WHERE any_ok) AS any_ok, count(*) FILTER (WHERE all_ok) AS all_ok, count(*) FILTER (WHERE any_traced) AS any_traced, count(*) FILTER (WHERE all_traced) AS all_traced,
 count(*) FILTER (WHERE any_ok_canonical) AS any_ok_canonical, count(*) FILTER (WHERE all_ok_canonical) AS all_ok_canonical, count(*) FILTER (WHERE any_traced_canonical) AS any_traced_canonical, count(*) FILTER (WHERE all_traced_canonical) AS all_traced_canonical FROM f""")
def coverage_summary(spark, sf_dir):
    flags = coverage.key_flags(_runs(spark, sf_dir), "l_orderkey", F.col("l_linestatus") == "F", F.col("l_discount") > 0, F.col("l_quantity") >= 10)
    return coverage.summarise_flags(flags, "l_orderkey")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def coverage_all_groups(spark, sf_dir):
    return coverage.in_all_groups(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, max(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) AS e FROM orders GROUP BY 1, 2),
f AS (SELECT o_custkey FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE n = 1 AND e = 0) < (SELECT count(DISTINCT o_orderpriority) FROM orders))
SELECT f.o_custkey, g.o_orderpriority, CASE WHEN n IS NULL THEN 'not found' WHEN n > 1 THEN 'multiple' WHEN e > 0 THEN 'error ' || e ELSE 'ok' END AS status
FROM f CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) g LEFT JOIN c ON c.o_custkey = f.o_custkey AND c.o_orderpriority = g.o_orderpriority""")
def coverage_gaps(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").withColumn("e", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2))
    return coverage.coverage_gaps(runs, "o_custkey", "o_orderpriority", "e")


@query("SELECT CAST(floor(o_totalprice) AS BIGINT) AS price, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS o_orderkey, CASE WHEN count(*) <> 1 THEN count(*) || ' rows' END AS problem FROM orders GROUP BY 1")
def reverse_lookup(spark, sf_dir):
    """The order of each price in whole units, where there is just one."""
    return coverage.lookup_unique(table(spark, sf_dir, "orders").select(F.floor("o_totalprice").alias("price"), "o_orderkey"), "price", "o_orderkey")


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_runs(spark, sf_dir):
    return coverage.duplicates(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def keys_difference(spark, sf_dir):
    listed = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return filters.not_listed(table(spark, sf_dir, "customer"), "c_custkey", listed).select("c_custkey")


@query("""SELECT o_orderkey, o_orderstatus FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND c_mktsegment = 'BUILDING' AND c_nationkey = 3""")
def canonical_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", 30).alias("num_cycles"), F.lit(10).alias("num_trials"), F.lit(1024).alias("width"), F.when(F.col("c_mktsegment") == "BUILDING", 768).alias("height"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("errors"), F.lit(None).cast("long").alias("trace"), F.col("c_nationkey").alias("environment"))
    return filters.canonical_runs(runs, environment=3, untraced=True).select("o_orderkey", "o_orderstatus")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE n_chars <= 2000) AS kept, count(*) FILTER (WHERE n_chars <= 2000) / count(*) AS share FROM documents")
def length_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return filters.kept_share(docs.select("doc_id"), docs.select("doc_id", F.col("n_chars").alias("length")), "doc_id", 2000)


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE (c_acctbal > 5000 AND c_mktsegment = 'MACHINERY')")
def resource_semi(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "resource")
    res = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "resource")
    return filters.restrict_resources(runs, res, (F.col("c_acctbal") > 5000) & (F.col("c_mktsegment") == "MACHINERY")).select("o_orderkey")


@query("SELECT e, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 ELSE 100 END AS e FROM events) GROUP BY 1")
def outcome_counts(spark, sf_dir):
    """Messages classified by the text that they have, counted by outcome."""
    t = F.col("event_type")
    message = F.when(t == "click", "ShaderResultInconsistencyException: frames").when(t == "purchase", "ShaderCompilationException").when(t != "view", t)
    return table(spark, sf_dir, "events").select(filters.error_number(message).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'bld' WHEN 'MACHINERY' THEN 'mach' END AS short, c_custkey || '-' || c_mktsegment AS brief FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def device_names(spark, sf_dir):
    got = filters.short_names(table(spark, sf_dir, "customer"), "c_mktsegment", {"BUILDING": "bld", "MACHINERY": "mach"})
    return got.select("c_custkey", "short", filters.describe("c_custkey", "c_mktsegment", short=True).alias("brief"))


@query("SELECT event_type, 'event_type: ' || event_type || ' / day: ' || day AS description, count(*) AS n FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY 1, 2")
def groups_present(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy("event_type", filters.describe("event_type", "day").alias("description")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') INTERSECT SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def set_algebra(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    either = orders.where("o_orderstatus = 'F' OR o_totalprice > 200000").select("o_orderkey")
    return either.intersect(orders.join(returned, "o_orderkey", "left_semi").select("o_orderkey"))
