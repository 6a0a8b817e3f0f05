"""Training samples, families, grids and named data sets over orders, line items, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import normalise
from tessera.operators import regress, samples
from tessera.operators.programs import opcode_stream

from .cohort_queries import labelled_orders
from .merge_queries import _turns, scratch
from .registry import query, table
from .stat_queries import _r


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    errors = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 5).otherwise(1)
    return o.select("o_orderkey", F.col("o_custkey").alias("shader"), errors.alias("errors"), (F.col("o_orderkey") % 3).alias("augmentation"), F.when(F.col("o_totalprice") > 100000, F.lit(1)).alias("trace"), F.col("o_orderpriority").alias("environment"), F.lit(30).alias("num_cycles"), F.lit(10).alias("num_trials"))


@query("""SELECT 'done' AS list, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 1
UNION ALL SELECT 'untraced', count(*) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice <= 100000 UNION ALL SELECT 'traced', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority = '5-LOW' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def work_lists(spark, sf_dir):
    runs = _orders(spark, sf_dir)
    black = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("shader"))
    lists = {"done": samples.successful_runs(runs), "open": samples.to_be_run(runs, 1), "untraced": samples.to_be_run(runs, traced=True), "traced": samples.traced_runs(runs, "5-LOW", 30, 10, black)}
    out = None
    for name, df in lists.items():
        one = df.agg(F.lit(name).alias("list"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT l_orderkey, CAST(l_returnflag = 'R' AS INT) AS "datasetIdx", count(*) AS n_ids, round(sum(ln(1 + l_quantity)), 6) AS trace_sum, round((1 / max(l_extendedprice) - 0.0001) / 0.001, 6) AS labels FROM lineitem GROUP BY 1, 2""")
def sample_projection(spark, sf_dir):
    """Frame rates inverted and scaled, counters on a log scale, with the data set's index."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("datasetIdx")).agg(F.collect_list("l_partkey").alias("ids"), F.sort_array(F.collect_list("l_quantity")).alias("counts"), F.max("l_extendedprice").alias("fps"))
    out = samples.project(rows, "ids", "fps", "traced", normalise.normaliser("zscore", mean=0.0001, stdev=0.001), "counts", normalise.normaliser("log1p"), rate=True, keep=["l_orderkey", "datasetIdx"])
    total = F.aggregate("trace_labels", F.lit(0.0), lambda s, x: s + x)
    return _r(out.select("l_orderkey", "datasetIdx", F.size("input_ids").cast("long").alias("n_ids"), total.alias("trace_sum"), "labels"), "trace_sum", "labels")


@query("""WITH c AS (SELECT conv_id * 1000 AS root, conv_id * 1000 + turn AS id, turn FROM conversations), k AS (SELECT root, row_number() OVER (ORDER BY md5('4-' || root), root) AS r, count(*) OVER () AS t FROM (SELECT DISTINCT root FROM c WHERE turn = 0)),
f AS (SELECT root, string_agg(id, ',' ORDER BY id) AS members, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY turn) AS place FROM c) WHERE place <= 4 GROUP BY 1)
SELECT root, members, CASE WHEN r <= ceil(t * 0.8) THEN 'train' ELSE 'test' END AS split FROM f JOIN k USING (root) WHERE n >= 2""")
def family_snapshot(spark, sf_dir):
    t = _turns(spark, sf_dir)
    out = samples.family_snapshot(t, t.where("parent IS NULL"), 4, 4)
    return out.select("root", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "split")



@query("""SELECT device, split, n FROM (
SELECT 'urgent' AS device, 'train' AS split, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O') AND o_totalprice <= 150000 UNION ALL
SELECT 'urgent', 'test', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O') AND o_totalprice > 150000 UNION ALL
SELECT 'low', 'train', count(*) FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'O' AND o_totalprice <= 150000 UNION ALL
SELECT 'low', 'test', count(*) FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'O' AND o_totalprice > 150000) WHERE n > 0""")
def cohort_plan(spark, sf_dir):
    good = [("error", "errorF"), ("error", "errorO")]
    devices = {"urgent": [[("environment", "EnvId1-URGENT")], good], "low": [[("environment", "EnvId5-LOW")], good]}
    parts = {"train": [[("mean", "meanBelowOrEqualThreshold150000.0")]], "test": [[("mean", "meanAboveThreshold150000.0")]]}
    return samples.cohort_plan(labelled_orders(spark, sf_dir), devices, {"low": [[("error", "errorO")]]}, parts)


@query("""WITH r AS (SELECT conv_id, conv_id * 1000 + turn AS id, strlen(role) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY md5('8-' || (conv_id * 1000 + turn)), conv_id * 1000 + turn) AS pick, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, max(s) FILTER (WHERE pick = 1) AS left_size, max(s) FILTER (WHERE pick = 2) AS right_size, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(strlen(CAST(conv_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), 1 + i, 1)) AS BIGINT))), lambda a, c: a * 128 + c) AS label FROM r WHERE pick <= 2 AND n >= 2 GROUP BY 1""")
def token_pairs(spark, sf_dir):
    from tessera.operators.vocab import byte_ids

    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), byte_ids(F.col("role")).alias("ids"))
    out = samples.token_pairs(c.select("conv_id", "id"), c.select("id", "ids"), "conv_id", "id", 8)
    return out.select("conv_id", F.size("left").cast("long").alias("left_size"), F.size("right").cast("long").alias("right_size"), "label")


@query("""WITH s AS (SELECT l_orderkey, string_agg(chr(CAST(33 + l_linenumber * 3 + l_quantity % 3 AS INT)), '' ORDER BY l_linenumber, l_quantity) AS a, count(*) AS n, avg(l_extendedprice) AS t FROM lineitem GROUP BY 1)
SELECT x.l_orderkey, levenshtein(x.a, y.a) AS distance, round(levenshtein(x.a, y.a) / y.n, 6) AS ratio, round(x.t / y.t, 6) AS relative_time FROM s x JOIN s y ON y.l_orderkey = x.l_orderkey - x.l_orderkey % 10 WHERE x.l_orderkey % 10 > 0""")
def distance_and_time(spark, sf_dir):
    """Each order's opcodes and mean time against those of the order of its ten."""
    items = table(spark, sf_dir, "lineitem")
    stream = opcode_stream(items.select("l_orderkey", F.struct("l_linenumber", "l_quantity").alias("inst_no"), (100 + F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 3).alias("opcode")), "l_orderkey")
    one = stream.join(items.groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("trials")), "l_orderkey")
    root = one.select(F.col("l_orderkey").alias("root"), F.col("opcodes").alias("root_opcodes"), F.col("trials").alias("root_trials"))
    pairs = one.where("l_orderkey % 10 > 0").join(root, F.col("l_orderkey") - F.col("l_orderkey") % 10 == F.col("root"))
    out = samples.distance_and_time(pairs, "opcodes", "root_opcodes", "trials", "root_trials")
    return _r(out.select("l_orderkey", F.col("distance").cast("long").alias("distance"), "ratio", "relative_time"), "ratio", "relative_time")


@query("""SELECT 'normalised' AS space, round(sqrt(avg((p - r) ** 2)), 6) AS rmse, round(avg(abs(p - r)), 6) AS mae, round(avg(abs(p - r) / abs(r)), 6) AS mape FROM (SELECT ln(1 + l_extendedprice) AS r, ln(1 + l_quantity * 1500) AS p FROM lineitem) UNION ALL
SELECT 'original', round(sqrt(avg((p - r) ** 2)), 2), round(avg(abs(p - r)), 2), round(avg(abs(p - r) / abs(r)), 6) FROM (SELECT l_extendedprice AS r, l_quantity * 1500 AS p FROM lineitem)""")
def metrics_both_spaces(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.log1p("l_extendedprice").alias("r"), F.log1p(F.col("l_quantity") * 1500).alias("p"))
    out = samples.both_spaces(items, "r", "p", normalise.normaliser("log1p"))
    places = lambda c: F.when(F.col("space") == "normalised", F.round(c, 6)).otherwise(F.round(c, 2))
    return out.select("space", places("rmse").alias("rmse"), places("mae").alias("mae"), F.round("mape", 6).alias("mape"))


@query("SELECT count(*) AS n, max(l_quantity) AS greatest, min(l_quantity) AS least FROM lineitem")
def flat_counters(spark, sf_dir):
    return samples.flat_counters(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("c")), "c")


@query()
def regression_grid(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("split", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train"))
    grid = samples.regression_grid(items, {"one": ["l_quantity"], "three": ["l_quantity", "l_discount", "l_tax"]}, {"plain": None, "relative": regress.inverse_weight(F.col("l_extendedprice"))}, "l_extendedprice", "split", "l_orderkey")
    return _r(grid, "rmse", "mae", "mape", places=4)


@query("""WITH t AS (SELECT *, 1 / (l_extendedprice + 1e-6) AS w FROM lineitem WHERE l_orderkey % 5 <> 0),
c AS (SELECT weight, feature, sum(CASE weight WHEN 'plain' THEN 1 ELSE w END * CASE feature WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount WHEN 'l_tax' THEN l_tax ELSE 1 END * l_extendedprice) AS m
  FROM t, (SELECT unnest(['plain', 'relative']) AS weight), (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', '(intercept)']) AS feature) GROUP BY 1, 2)
SELECT 'three' AS features, weight, feature, round(m, CASE weight WHEN 'plain' THEN 0 ELSE 4 END) AS moment FROM c UNION ALL SELECT 'one', weight, feature, round(m, CASE weight WHEN 'plain' THEN 0 ELSE 4 END) FROM c WHERE feature IN ('l_quantity', '(intercept)')""")
def regression_moments(spark, sf_dir):
    """The fits of a grid of features and weights, by the moments of what they fit on `train`."""
    from .stat_queries import _fitted_moments

    train = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").select(*[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")])
    out = []
    for name, cols in (("one", ["l_quantity"]), ("three", ["l_quantity", "l_discount", "l_tax"])):
        for weight, w in (("plain", None), ("relative", regress.inverse_weight(F.col("l_extendedprice")))):
            fit = regress.ols(train, cols, "l_extendedprice", w)
            m = _fitted_moments(train, cols, fit, w).select(F.lit(name).alias("features"), F.lit(weight).alias("weight"), "feature", F.round("moment", 0 if weight == "plain" else 4).alias("moment"))
            out.append(m)
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem WHERE l_orderkey % 5 <> 0)
SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, round(sqrt(avg((a * l_quantity + b - l_extendedprice) ** 2)), 3) AS rmse, round(avg(abs(a * l_quantity + b - l_extendedprice) / l_extendedprice), 6) AS mape FROM lineitem, m GROUP BY 1""")
def regression_heuristic(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("split", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train"))
    grid = samples.regression_grid(items, {"one": ["l_quantity"]}, {"plain": None}, "l_extendedprice", "split", "l_orderkey")
    return _r(_r(grid.select("split", "n", "rmse", "mape"), "rmse", places=3), "mape")


@query("SELECT o_orderkey, strlen(o_orderpriority) AS n_tokens FROM orders WHERE o_orderstatus = 'F'")
def tokenised_snapshot(spark, sf_dir):
    """A data set by name and split, tokenised by name, written and read again."""
    from tessera.operators.vocab import byte_ids

    path, out, catalog = scratch(spark, "named"), scratch(spark, "tokens"), samples.Catalog()
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "train").otherwise("test").alias("split")).write.partitionBy("split").parquet(path)
    catalog.add_snapshot("orders", path)
    catalog.add_tokeniser("bytes", lambda df: df.select("o_orderkey", byte_ids(F.col("o_orderpriority")).alias("ids")))
    catalog.tokenise("bytes", catalog.dataset(spark, "orders", "train")).write.parquet(out)
    return spark.read.parquet(out).select("o_orderkey", F.size("ids").cast("long").alias("n_tokens"))


@query("SELECT p_brand AS feature, round(avg(p_retailprice), 6) AS coef FROM part GROUP BY 1 UNION ALL SELECT '(intercept)', 2.0::DOUBLE")
def coefficients_stored(spark, sf_dir):
    """A coefficient a brand, written, and read as the kind that it was written as."""
    path = scratch(spark, "coefficients")
    n = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.avg("p_retailprice"), 6).alias("coef"))
    samples.write_coefficients(n.unionByName(regress.coefficient_table(spark, [("(intercept)", 2.0)])), path, "linear")
    return samples.read_coefficients(spark, path, "linear")


@query("""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS place, count(*) OVER () AS t FROM part), n AS (SELECT max(t) AS t FROM p),
d AS (SELECT i, CAST('0x' || substr(md5('6-0-' || i), 1, 15) AS BIGINT) % t AS place FROM n, (SELECT unnest(range(1, 1501)) AS i)) SELECT p_partkey, count(*) AS draws FROM p JOIN d USING (place) GROUP BY 1""")
def epoch_sample(spark, sf_dir):
    """An epoch of 1,500 rows drawn with replacement: the epoch's size is the feature."""
    return samples.epoch_sample(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 6, 0, 1500).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("draws"))


@query("SELECT l_quantity AS counter, row_number() OVER (ORDER BY l_quantity) AS place FROM lineitem")
def counters_sorted(spark, sf_dir):
    """Counters of all arrays in order, a row each."""
    arrays = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("c"))
    return samples.sorted_counters(arrays, "c")


@query("""SELECT l_orderkey, count(*) AS n_ids, count(*)::DOUBLE AS ones, true AS plain FROM lineitem GROUP BY 1""")
def constant_trace(spark, sf_dir):
    """The projections without a trace and with a constant one."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids"), F.max("l_extendedprice").alias("fps"))
    constant = samples.project(rows, "ids", "fps", "constant", keep=["l_orderkey"])
    plain = samples.project(rows, "ids", "fps", "plain", keep=["l_orderkey"]).select("l_orderkey", F.col("trace_labels").isNull().alias("plain"))
    return constant.select("l_orderkey", F.size("input_ids").cast("long").alias("n_ids"), F.aggregate("trace_labels", F.lit(0.0), lambda s, x: s + x).alias("ones")).join(plain, "l_orderkey")


@query("""SELECT l_returnflag AS dataset, l_linestatus AS split, count(*) AS n, round(avg(abs(l_quantity * 1500 - l_extendedprice) / l_extendedprice), 6) AS mape FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def predictions_stored(spark, sf_dir):
    """Prediction pairs written by data set and method, and those of one read back and measured."""
    from tessera.operators.metrics import errors
    from tessera.sources import store

    items, path = table(spark, sf_dir, "lineitem"), scratch(spark, "predictions")
    rows = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("sample_id"), F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("split"), F.col("l_extendedprice").alias("real"), F.inline(F.array(F.struct(F.lit("flat").alias("method"), (F.col("l_quantity") * 1500).alias("pred")), F.struct(F.lit("none").alias("method"), F.lit(0.0).alias("pred")))))
    store.write_predictions(rows, path)
    back = store.read_predictions(spark, path, dataset="R", method="flat")
    return _r(back.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"), *errors(F.col("real"), F.col("pred"))).drop("rmse", "mae"), "mape")


@query("SELECT o_orderkey, round((o_totalprice - 150000) / 80000, 9) AS o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def split_normalised(spark, sf_dir):
    """One split of a snapshot, its target as a z-score."""
    from tessera.sources import store

    path = scratch(spark, "zscore")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", "train").otherwise("test").alias("split")).write.partitionBy("split").parquet(path)
    return _r(store.read_split(spark, path, "train", ("o_totalprice", 150000.0, 80000.0)).select("o_orderkey", "o_totalprice"), "o_totalprice", places=9)


@query("SELECT s_suppkey AS id, s_name AS node, CAST(NULL AS VARCHAR) AS os, 'gpu' || s_nationkey AS gpu FROM supplier")
def table_scan(spark, sf_dir):
    """A base table read with its declared schema; a column that the files lack is null."""
    from tessera.sources import store

    path = scratch(spark, "base")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("node"), F.concat(F.lit("gpu"), F.col("s_nationkey").cast("string")).alias("gpu")).write.parquet(f"{path}/environment")
    return store.read_table(spark, path, "environment").select("id", "node", "os", "gpu")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey AS first, CAST(l_quantity AS BIGINT) AS second, l_linenumber = 7 AS cut FROM lineitem".replace("l_partkey AS part, l_suppkey AS first, CAST(l_quantity AS BIGINT) AS second", "CASE WHEN l_linenumber <> 7 THEN l_partkey END AS part, CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS first, CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS BIGINT) END AS second"))
def uniforms_decoded(spark, sf_dir):
    """A packed column of an integer and an array of two as a struct; binaries of another length are null."""
    from tessera.sources import store

    word = lambda c: F.concat(*[F.substring(F.lpad(F.hex(c.cast("long")), 8, "0"), 7 - 2 * k, 2) for k in range(4)])  # noqa: E731  little-endian
    packed = F.unhex(F.concat(word(F.col("l_partkey")), word(F.col("l_suppkey")), F.when(F.col("l_linenumber") == 7, "").otherwise(word(F.col("l_quantity")))))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", packed.alias("u"))
    out = rows.select("l_orderkey", "l_linenumber", store.unpack_struct("u", [("part", "<u4", ()), ("pair", "<u4", (2,))]).alias("s"))
    return out.select("l_orderkey", "l_linenumber", F.col("s.part").alias("part"), F.get("s.pair", F.lit(0)).alias("first"), F.get("s.pair", F.lit(1)).alias("second"), F.col("s").isNull().alias("cut"))


@query("SELECT o_orderkey, length(o_orderstatus || '!') AS n FROM orders WHERE o_orderstatus = 'F'")
def maps_by_name(spark, sf_dir):
    catalog = samples.Catalog()
    catalog.add_map("finished", lambda df: df.where("o_orderstatus = 'F'"))
    catalog.add_map("marked", lambda df: df.withColumn("n", F.length(F.concat("o_orderstatus", F.lit("!"))).cast("long")))
    return catalog.mapped(table(spark, sf_dir, "orders"), "finished", "marked").select("o_orderkey", "n")
