"""Statistics, histograms, metrics, normalisers and regressions over line items, events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import normalise, scalar
from tessera.operators import histogram, metrics, regress, stats
from tessera.operators.ordinal import global_rank

from .registry import query, table


def _r(df, *cols, places=6):
    """Columns rounded, for engines whose sums differ in the last bits."""
    return df.withColumns({c: F.round(c, places) for c in cols})


@query("""SELECT l_orderkey, count(l_extendedprice) AS n, round(avg(l_extendedprice), 7) AS mean, round(stddev_pop(l_extendedprice), 4) AS stdev,
 round(stddev_pop(l_extendedprice) / avg(l_extendedprice), 6) AS cv FROM lineitem GROUP BY 1""")
def trial_stats(spark, sf_dir):
    out = stats.trial_stats(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice").drop("inverse_cv")
    return _r(_r(_r(out, "mean", places=7), "stdev", places=4), "cv")


@query("""WITH t AS (SELECT l_orderkey, list_sort(list(l_extendedprice)) AS a FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, CASE WHEN len(a) > 2 THEN a[2:len(a) - 1] END AS a FROM t)
SELECT l_orderkey, round(list_avg(a), 7) AS mean, round(list_stddev_pop(a), 4) AS stdev FROM s""")
def trial_trimmed(spark, sf_dir):
    runs = stats.trial_arrays(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice")
    a = stats.trimmed(F.col("trials"))
    return runs.select("l_orderkey", F.round(stats.array_mean(a), 7).alias("mean"), F.round(stats.array_stddev(a), 4).alias("stdev"))


@query("SELECT l_suppkey, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv, round(CASE WHEN stddev_pop(l_quantity) > 0 THEN avg(l_quantity) / stddev_pop(l_quantity) END, 6) AS inverse_cv FROM lineitem GROUP BY 1")
def trial_cv(spark, sf_dir):
    return _r(stats.trial_stats(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity"), "cv", "inverse_cv").select("l_suppkey", "cv", "inverse_cv")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_per_key(spark, sf_dir):
    return stats.first_per_key(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_id", "event_type", "value"])


_EDGES = [0.0, 1.0, 5.0, 10.0, 50.0, 100.0]


@query("SELECT b AS bin, e[b + 1] AS low, e[b + 2] AS high, (SELECT count(*) FROM events WHERE value >= e[b + 1] AND (value < e[b + 2] OR (b = 4 AND value = e[b + 2]))) AS n FROM (SELECT CAST(unnest(range(5)) AS INT) AS b, [0.0::DOUBLE, 1, 5, 10, 50, 100] AS e)")
def hist_fixed(spark, sf_dir):
    return histogram.fixed_histogram(table(spark, sf_dir, "events"), "value", _EDGES)


@query("""WITH s AS (SELECT 0.0::DOUBLE AS lo, quantile_cont(value, 0.95) AS hi FROM events), b AS (SELECT least(CAST(floor(value * 20 / hi) AS INT), 19) AS bin FROM events, s WHERE value BETWEEN 0 AND hi), c AS (SELECT bin, count(*) AS n FROM b GROUP BY 1)
SELECT g.bin, round(hi / 20 * g.bin, 6) AS low, round(hi / 20 * (g.bin + 1), 6) AS high, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM c) / (hi / 20), 6) AS density FROM (SELECT CAST(unnest(range(20)) AS INT) AS bin) g CROSS JOIN s LEFT JOIN c ON c.bin = g.bin""")
def hist_equal(spark, sf_dir):
    return _r(histogram.equal_histogram(table(spark, sf_dir, "events"), "value", 20, upper_share=0.95, density=True), "low", "high", "density")


@query("""WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT CAST(greatest(ceil(log2(n) + 1), ceil((hi - lo) / (2 * (b - a) / cbrt(n)))) AS INT) AS bins FROM s""")
def hist_auto_bins(spark, sf_dir):
    return histogram.auto_bins(table(spark, sf_dir, "events"), "value")


def _predictions(spark, sf_dir):
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    j = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    real = (F.col("l_extendedprice") / 1e6).alias("real")
    methods = F.array(F.struct(F.lit("retail").alias("method"), (F.col("l_quantity") * F.col("p_retailprice") / 1e6).alias("pred")), F.struct(F.lit("flat").alias("method"), (F.col("l_quantity") * 1500.0 / 1e6).alias("pred")))
    return j.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("split"), real, F.explode(methods).alias("m")).select("*", "m.*").drop("m")


_PRED = """p AS (SELECT l_orderkey, l_linenumber, l_returnflag AS dataset, l_linestatus AS split, l_extendedprice / 1e6 AS real, method, CASE method WHEN 'retail' THEN l_quantity * p_retailprice / 1e6 ELSE l_quantity * 1500.0::DOUBLE / 1e6 END AS pred
 FROM lineitem JOIN part ON l_partkey = p_partkey CROSS JOIN (SELECT unnest(['retail', 'flat']) AS method))"""
_E = "round(sqrt(avg((pred - real) ** 2)), 8) AS rmse, round(avg(abs(pred - real)), 8) AS mae, round(avg(CASE WHEN real <> 0 THEN abs(pred - real) / abs(real) END), 6) AS mape"


@query(f"""WITH {_PRED}, r(range, lo, hi) AS (VALUES ('0..0.0001', 0, 1e-4), ('0.0001..0.001', 1e-4, 1e-3), ('0.001..0.01', 1e-3, 1e-2), ('0.01..0.1', 1e-2, 1e-1), ('0.1..1e+10', 1e-1, 1e10)),
m AS (SELECT DISTINCT method FROM p)
SELECT method, 'overall' AS range, count(*) AS n, {_E} FROM p GROUP BY 1 UNION ALL
SELECT m.method, r.range, count(real) AS n, {_E} FROM m CROSS JOIN r LEFT JOIN p ON p.method = m.method AND real >= lo AND real < hi GROUP BY 1, 2""")
def metric_suite(spark, sf_dir):
    return _r(_r(metrics.metric_suite(_predictions(spark, sf_dir), "real", "pred", by=["method"]), "rmse", "mae", places=8), "mape")


@query(f"""WITH {_PRED} SELECT dataset, {', '.join(f"round(avg(abs(pred - real) / abs(real)) FILTER (WHERE method = '{m}' AND split = '{s}'), 6) AS {m}_{s}" for m in ('retail', 'flat') for s in 'FO')} FROM p GROUP BY 1""")
def metric_matrix(spark, sf_dir):
    names = ["retail_F", "retail_O", "flat_F", "flat_O"]
    return _r(metrics.metric_matrix(_predictions(spark, sf_dir), "dataset", ["method", "split"], names, "real", "pred"), *names)


@query(f"""WITH {_PRED}, r AS (SELECT method, rank() OVER (PARTITION BY method ORDER BY real) + (count(*) OVER (PARTITION BY method, real) - 1) / 2 AS a, rank() OVER (PARTITION BY method ORDER BY pred) + (count(*) OVER (PARTITION BY method, pred) - 1) / 2 AS b FROM p)
SELECT method, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def spearman(spark, sf_dir):
    return _r(metrics.spearman(_predictions(spark, sf_dir), ["method"], "real", "pred"), "spearman")


@query(f"WITH {_PRED} SELECT method, round(avg((pred - real) ** 2 / real), 8) AS rse FROM p GROUP BY 1")
def relative_squared_error(spark, sf_dir):
    return _r(_predictions(spark, sf_dir).groupBy("method").agg(metrics.relative_squared_error("real", "pred").alias("rse")), "rse", places=8)


@query(f"""WITH {_PRED} SELECT method, round(avg((pred - real) ** 2), 9) AS time_mse, round(avg(abs(pred - real)), 8) AS time_mae, round(avg(abs(pred - real) / real), 6) AS time_mape,
 round(avg((1 / pred - 1 / real) ** 2), 4) AS rate_mse, round(avg(abs(1 / pred - 1 / real)), 5) AS rate_mae, round(avg(abs(1 / pred - 1 / real) / (1 / real)), 6) AS rate_mape FROM p GROUP BY 1""")
def both_domains(spark, sf_dir):
    out = metrics.both_domains(_predictions(spark, sf_dir), "real", "pred", by=["method"])
    for places, cols in ((9, ["time_mse"]), (8, ["time_mae"]), (6, ["time_mape", "rate_mape"]), (4, ["rate_mse"]), (5, ["rate_mae"])):
        out = _r(out, *cols, places=places)
    return out


@query(f"WITH {_PRED} SELECT method, {_E} FROM p WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def metrics_excluding(spark, sf_dir):
    listed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = metrics.without_keys(_predictions(spark, sf_dir), listed, "l_orderkey")
    return _r(_r(kept.groupBy("method").agg(*metrics.errors(F.col("real"), F.col("pred"))), "rmse", "mae", places=8), "mape")


@query(f"""WITH {_PRED}, w AS (SELECT l_orderkey * 10 + l_linenumber AS id, real, max(pred) FILTER (WHERE method = 'retail') AS retail, max(pred) FILTER (WHERE method = 'flat') AS flat FROM p GROUP BY 1, 2)
SELECT id, round(real, 8) AS real, round((retail - real) * 100 / real, 4) AS retail_pct, round((flat - real) * 100 / real, 4) AS flat_pct, row_number() OVER (ORDER BY real, id) AS ordinal FROM w""")
def deviation_report(spark, sf_dir):
    p = _predictions(spark, sf_dir).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    wide = p.groupBy("id", "real").pivot("method", ["retail", "flat"]).agg(F.max("pred"))
    out = metrics.deviation_report(wide, "id", "real", ["retail", "flat"]).drop("retail", "flat")
    return _r(_r(out, "real", places=8), "retail_pct", "flat_pct", places=4)


@query(f"""WITH {_PRED}, l AS (SELECT log10(real) AS x, log10(pred) AS y FROM p WHERE real > 0 AND pred > 0), s AS (SELECT greatest(min(x), min(y)) AS lo, least(max(x), max(y)) AS hi FROM l)
SELECT CAST(least(floor((x - lo) * 50 / (hi - lo)), 49) AS INT) AS bx, CAST(least(floor((y - lo) * 50 / (hi - lo)), 49) AS INT) AS by, count(*) AS n FROM l, s WHERE x BETWEEN lo AND hi AND y BETWEEN lo AND hi GROUP BY 1, 2""")
def hist_2d_log(spark, sf_dir):
    return histogram.log_histogram_2d(_predictions(spark, sf_dir).where("real > 0 AND pred > 0"), "real", "pred")


@query("SELECT point, quantile_cont(n_chars, point) AS value FROM documents, (SELECT unnest([0.5, 0.85, 0.95, 0.99]::DOUBLE[]) AS point) GROUP BY point".replace("quantile_cont(n_chars, point)", "CASE point WHEN 0.5 THEN quantile_cont(n_chars, 0.5) WHEN 0.85 THEN quantile_cont(n_chars, 0.85) WHEN 0.95 THEN quantile_cont(n_chars, 0.95) ELSE quantile_cont(n_chars, 0.99) END"))
def percentiles(spark, sf_dir):
    return _r(stats.percentiles(table(spark, sf_dir, "documents"), "n_chars", [0.5, 0.85, 0.95, 0.99]), "value")


@query("SELECT cut, (SELECT count(*) FILTER (WHERE n_chars <= cut) / count(*) FROM documents) AS share FROM (SELECT unnest([1000.0, 4096.0]::DOUBLE[]) AS cut)")
def coverage_cut(spark, sf_dir):
    return stats.share_up_to(table(spark, sf_dir, "documents"), "n_chars", [1000.0, 4096.0])


def _poly(coefficients, x, last=None):
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in [*coefficients[1:], *([last] if last is not None else [])]:
        out = f"(({out}) * {x} + {c!r}::DOUBLE)"
    return out


@query(f"""WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS i, count(value) OVER (PARTITION BY user_id) AS n, avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS s FROM events),
p AS (SELECT *, i / n AS p FROM s), q AS (SELECT *, sqrt(-2 * ln(CASE WHEN p > 0 THEN least(p, 1 - p) END)) AS q, (p - 0.5) * (p - 0.5) AS r FROM p)
SELECT user_id, CAST(i AS INT) AS i, value, round(m + s * CASE WHEN p > 0 AND p < 0.02425 THEN {_poly(stats.ACKLAM_C, "q")} / {_poly(stats.ACKLAM_D, "q", 1.0)} WHEN p > 0.97575 AND p < 1 THEN -({_poly(stats.ACKLAM_C, "q")} / {_poly(stats.ACKLAM_D, "q", 1.0)})
 WHEN p >= 0.02425 AND p <= 0.97575 THEN {_poly(stats.ACKLAM_A, "r")} * (p - 0.5) / {_poly(stats.ACKLAM_B, "r", 1.0)} END, 6) AS expected FROM q""")
def qq_normal(spark, sf_dir):
    return _r(stats.qq_normal(table(spark, sf_dir, "events"), "user_id", "value", "event_id"), "expected")


@query("""SELECT l_returnflag, floor(round(log10(v + 1e-15) * 4, 9))::INT AS bin, count(*) AS n, round(count(*) * 4 / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS density
FROM (SELECT l_returnflag, l_discount * 100 + l_tax AS v FROM lineitem) WHERE v <= 10 GROUP BY 1, 2""")
def log_density(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_discount") * 100 + F.col("l_tax"))
    return _r(histogram.log_density(items, "l_returnflag", "v"), "density")


@query("SELECT p_brand, median(p_retailprice) AS median, row_number() OVER (ORDER BY median(p_retailprice), p_brand)::INT AS place FROM part GROUP BY 1")
def groups_by_median(spark, sf_dir):
    return stats.groups_by_median(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev FROM events")
def normalizer_fit(spark, sf_dir):
    return _r(stats.fit_normaliser(table(spark, sf_dir, "events"), "value"), "mean", "stdev")


@query("SELECT round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS stdev FROM events")
def target_spread(spark, sf_dir):
    return _r(stats.target_spread(table(spark, sf_dir, "events"), "value"), "mean", "variance", "stdev")


@query("SELECT round(var_pop(value), 6) AS mse, round(stddev_pop(value), 6) AS rmse, round(avg(abs(value - m) / nullif(abs(value), 0)), 6) AS mape FROM events, (SELECT avg(value) AS m FROM events)")
def best_guess(spark, sf_dir):
    return _r(stats.best_constant_guess(table(spark, sf_dir, "events"), "value"), "mse", "rmse", "mape")


@query("SELECT event_id, round((value - 10) / 4, 6) AS z, round(CASE WHEN value > 0 THEN ln(value) END, 6) AS logged, round(ln(1 + value), 6) AS logged1, value AS back FROM events")
def normalize_roundtrip(spark, sf_dir):
    z, unz = normalise.normaliser("zscore", mean=10.0, stdev=4.0)
    log, unlog = normalise.normaliser("log1p")
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(z(v), 6).alias("z"), F.round(normalise.normaliser("log")[0](F.when(v > 0, v)), 6).alias("logged"), F.round(log(v), 6).alias("logged1"), F.round((unz(z(v)) + unlog(log(v))) / 2, 6).alias("back"))


@query("SELECT l_orderkey, round(sum(ln(1 + l_extendedprice)), 6) AS logs, round(sum(l_extendedprice), 4) AS back FROM lineitem GROUP BY 1")
def normalize_arrays(spark, sf_dir):
    """Arrays of prices normalised element by element and taken back."""
    f, g = (normalise.on_array(x) for x in normalise.normaliser("log1p"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    arrays = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_extendedprice").cast("double")).alias("a")).withColumn("n", f(F.col("a")))
    return _r(_r(arrays.select("l_orderkey", total("n").alias("logs"), total(g(F.col("n"))).alias("back")), "logs"), "back", places=4)


@query("""WITH s AS (SELECT event_type, user_id, sum(CAST(round(value * 100) AS BIGINT) % 50) AS v FROM events GROUP BY 1, 2), b AS (SELECT user_id, v FROM s WHERE event_type = 'click')
SELECT event_type, count(*) FILTER (WHERE s.v = b.v) AS original, count(*) FILTER (WHERE s.v <> b.v) AS deviated FROM s JOIN b USING (user_id) WHERE event_type <> 'click' GROUP BY 1""")
def deviation_census(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.round(F.col("value") * 100).cast("long") % 50)
    return metrics.deviation_census(e, "event_type", "user_id", "v", "click")


@query("""WITH s AS (SELECT event_type, user_id, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY 1, 2), b AS (SELECT user_id, v FROM s WHERE event_type = 'click')
SELECT event_type, user_id, round(CASE WHEN b.v <> 0 THEN abs(s.v - b.v) / abs(b.v) END, 6) AS deviation FROM s JOIN b USING (user_id) WHERE event_type <> 'click'""")
def relative_deviation(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.round(F.col("value") * 100).cast("long"))
    return _r(metrics.relative_deviation(e, "event_type", "user_id", "v", "click"), "deviation")


@query("""WITH v AS (SELECT user_id, event_type, CAST(round(value * 1000000) AS BIGINT) AS v FROM events),
w AS (SELECT user_id, avg(v) FILTER (WHERE event_type = 'click') AS click, avg(v) FILTER (WHERE event_type = 'view') AS view FROM v GROUP BY 1)
SELECT user_id, round(click) / 1000000 AS click, round(view) / 1000000 AS view, row_number() OVER (ORDER BY click, user_id) AS ordinal FROM w WHERE click IS NOT NULL AND view IS NOT NULL""")
def order_by_base(spark, sf_dir):
    """Means of whole millionths: equal means are equal in whatever order their values are added, and their users stand by number."""
    e = table(spark, sf_dir, "events").withColumn("v", F.round(F.col("value") * 1000000).cast("long"))
    out = metrics.order_by_base(e, "event_type", "user_id", "v", ["click", "view"])
    return out.select("user_id", (F.round("click") / 1000000).alias("click"), (F.round("view") / 1000000).alias("view"), "ordinal")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS ordinal FROM orders")
def order_ordinal(spark, sf_dir):
    return global_rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", name="ordinal").select("o_orderkey", "ordinal")


@query("(SELECT o_orderkey, 'head' AS part FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) UNION ALL (SELECT o_orderkey, 'tail' FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100)")
def top_head_tail(spark, sf_dir):
    """The feature is a report of the first and last hundred."""
    o = table(spark, sf_dir, "orders")
    head = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", F.lit("head").alias("part"))
    return head.unionByName(o.orderBy("o_totalprice", "o_orderkey").limit(100).select("o_orderkey", F.lit("tail").alias("part")))


_W = "(1 / (l_extendedprice + 1e-6))"


@query(f"""WITH m AS (SELECT l_returnflag, sum({_W}) AS w, sum({_W} * l_quantity) AS x, sum({_W} * l_extendedprice) AS y, sum({_W} * l_quantity * l_quantity) AS xx, sum({_W} * l_quantity * l_extendedprice) AS xy FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((w * xy - x * y) / (w * xx - x * x), 3) AS slope, round((y - (w * xy - x * y) / (w * xx - x * x) * x) / w, 2) AS intercept FROM m""")
def ols_weighted(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    out = regress.line_fit(items, "l_quantity", "l_extendedprice", regress.inverse_weight(F.col("l_extendedprice")), by=["l_returnflag"])
    return _r(_r(out, "slope", places=3), "intercept", places=2)


def _fitted_moments(wide, names, coefficients, weight=None):
    """Rows (feature, moment): sums of weight * feature * fitted value; least squares makes them those of the real values."""
    coef, w = dict(coefficients), F.lit(1.0) if weight is None else weight
    fitted = sum((F.col(n) * F.lit(coef[n]) for n in names), F.lit(coef["(intercept)"]))
    sums = wide.agg(*[F.sum(w * (F.col(n) if n in coef and n != "(intercept)" else F.lit(1.0)) * fitted).alias(n) for n in [*names, "(intercept)"]])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("moment")) for n in [*names, "(intercept)"]])))


_DIMENSIONS = " UNION ALL ".join([f"SELECT 'x{i:02d}' AS feature, round(sum(embedding[{i + 1}]::DOUBLE * label), 4) AS moment FROM embeddings" for i in range(64)] + ["SELECT '(intercept)', round(sum(label)::DOUBLE, 4) FROM embeddings"])


@query(_DIMENSIONS)
def ols_features(spark, sf_dir):
    """Least squares of the label on the 64 dimensions of each embedding: the moments of what it fits are those of the labels."""
    e = table(spark, sf_dir, "embeddings")
    names = [f"x{i:02d}" for i in range(64)]
    wide = e.select(F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return _r(_fitted_moments(wide, names, regress.ols(wide, names, "label")), "moment", places=4)


@query("""WITH o AS (SELECT o_orderkey, o_totalprice AS y, 1 / (o_totalprice + 1e-6) AS w FROM orders), x AS (SELECT l_orderkey, 's' || l_suppkey AS feature, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT feature, round(sum(w * v * y), 4) AS moment FROM x JOIN o ON o_orderkey = l_orderkey GROUP BY 1 UNION ALL SELECT '(intercept)', round(sum(w * y), 4) FROM o""")
def ols_sparse(spark, sf_dir):
    """Weighted least squares of an order's price on the quantities that it has of each supplier."""
    long = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("feature"), F.col("l_quantity").cast("double").alias("value"))
    y = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("y"))
    weight = regress.inverse_weight(F.col("y"))
    coef = regress.coefficient_table(spark, regress.sparse_ols(long, y, "l_orderkey", "y", weight))
    none = y.select("l_orderkey", F.lit("no supplier").alias("feature"), F.lit(0.0).alias("value"))
    fitted = regress.score(long.unionByName(none), coef, "l_orderkey").join(y, "l_orderkey").select("l_orderkey", (F.col("pred") * weight).alias("wp"))
    moments = long.join(fitted, "l_orderkey").groupBy("feature").agg(F.sum(F.col("value") * F.col("wp")).alias("moment"))
    return _r(moments.unionByName(fitted.agg(F.lit("(intercept)").alias("feature"), F.sum("wp").alias("moment"))), "moment", places=4)


@query("SELECT p_name AS feature, round(coef, 6) AS coef FROM (SELECT DISTINCT p_name, p_brand FROM part) JOIN (SELECT p_brand, avg(p_size) AS coef FROM part GROUP BY 1) USING (p_brand) UNION ALL SELECT '(intercept)', round(avg(p_retailprice), 6) FROM part")
def coefficients_projected(spark, sf_dir):
    """Coefficients of classes as those of the instructions of each class."""
    p = table(spark, sf_dir, "part")
    classes = p.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("coef")).unionByName(p.agg(F.lit("(intercept)").alias("feature"), F.avg("p_retailprice").alias("coef")))
    return _r(regress.project_classes(classes, p.select(F.col("p_name").alias("opname"), F.col("p_brand").alias("class")).distinct()), "coef")


_CELLS = 1 << 14


@query(f"""WITH v AS (SELECT l_returnflag AS g, l_extendedprice::DOUBLE AS v FROM lineitem WHERE l_extendedprice IS NOT NULL),
s AS (SELECT g, n, h, lo - 2 * h AS lo, hi + 2 * h AS hi FROM (SELECT g, count(*)::DOUBLE AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*)::DOUBLE, -0.2) AS h FROM v GROUP BY 1)),
p AS (SELECT g, (v - lo) / (hi - lo) * {_CELLS} AS place FROM v JOIN s USING (g)), q AS (SELECT g, place, least(floor(place), {_CELLS - 1}) AS cell FROM p),
c AS (SELECT g, cell, sum(w) AS w FROM (SELECT g, cell, 1 - (place - cell) AS w FROM q UNION ALL SELECT g, cell + 1, place - cell FROM q) GROUP BY 1, 2),
x AS (SELECT *, unnest(range(100)) AS place FROM s), y AS (SELECT *, lo + place * ((hi - lo) / 99) AS x FROM x)
SELECT g AS l_returnflag, place::INT AS place, round(any_value(y.x), 4) AS x, round(sum(w * exp(-0.5 * ((y.x - (lo + cell * ((hi - lo) / {_CELLS}))) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 11) AS density
FROM y JOIN c USING (g) GROUP BY g, place""")
def kernel_density(spark, sf_dir):
    """The density of prices by return flag, at a hundred places."""
    out = histogram.kernel_density(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return _r(_r(out, "x", places=4), "density", places=11)


def _residuals(names) -> str:
    """SQL of least-squares coefficients of three features: each is the slope on what the other two leave of it."""
    parts = []
    for j in range(3):
        x, p, q = names[j], names[(j + 1) % 3], names[(j + 2) % 3]
        parts.append(f"""SELECT '{x}' AS feature, regr_slope(y, e) AS coef FROM (SELECT y, u - (SELECT regr_slope(u, v) FROM (SELECT {x} - (SELECT regr_slope({x}, {p}) FROM d) * {p} AS u, {q} - (SELECT regr_slope({q}, {p}) FROM d) * {p} AS v FROM d)) * v AS e
 FROM (SELECT y, {x} - (SELECT regr_slope({x}, {p}) FROM d) * {p} AS u, {q} - (SELECT regr_slope({q}, {p}) FROM d) * {p} AS v FROM d))""")
    return " UNION ALL ".join(parts)


@query(f"""WITH d AS (SELECT l_quantity, l_discount, l_tax, l_extendedprice AS y FROM lineitem), c AS ({_residuals(["l_quantity", "l_discount", "l_tax"])})
SELECT feature, round(coef, 2) AS coef FROM c UNION ALL SELECT '(intercept)', round((SELECT avg(y) FROM d) - sum(coef * CASE feature WHEN 'l_quantity' THEN (SELECT avg(l_quantity) FROM d) WHEN 'l_discount' THEN (SELECT avg(l_discount) FROM d) ELSE (SELECT avg(l_tax) FROM d) END), 2) FROM c""")
def ols_three(spark, sf_dir):
    """Least squares of prices on three features."""
    out = regress.coefficient_table(spark, regress.ols(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))
    return _r(out, "coef", places=2)


@query("SELECT p_partkey, round(2.5::DOUBLE * p_size - 0.1::DOUBLE * p_retailprice + 7, 6) AS pred FROM part")
def score_by_coef(spark, sf_dir):
    coef = regress.coefficient_table(spark, [("p_size", 2.5), ("p_retailprice", -0.1), ("(intercept)", 7.0)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in ("p_size", "p_retailprice", "p_partkey")])
    return _r(regress.score(table(spark, sf_dir, "part").select("p_partkey", F.inline(cells)), coef, "p_partkey"), "pred")


@query("SELECT o_orderkey, (o_orderkey >> 0) & 1 AS b0, (o_orderkey >> 3) & 1 AS b3, (o_orderkey >> 10) & 1 AS b10, 0 AS b63 FROM orders")
def onehot_bits(spark, sf_dir):
    bits = scalar.base2_digits(F.col("o_orderkey"), 64)
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.alias("b")).select("o_orderkey", *[F.col("b")[i].alias(f"b{i}") for i in (0, 3, 10, 63)])


@query("SELECT CAST(b AS INT) AS bit, (SELECT count(*) FROM orders WHERE (o_orderkey >> b) & 1 = 1) AS n FROM (SELECT unnest(range(63)) AS b)")
def bit_occupancy(spark, sf_dir):
    from tessera.operators.programs import bit_occupancy as occupancy

    return occupancy(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT o_orderkey, o_orderkey % 10 AS d0, (o_orderkey // 10) % 10 AS d1, (o_orderkey // 1000) % 10 AS d3, o_orderkey AS back FROM orders")
def digits(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", scalar.digits(F.col("o_orderkey"), 10, 8).alias("d"))
    return d.select("o_orderkey", *[F.col("d")[i].alias(f"d{i}") for i in (0, 1, 3)], scalar.from_digits(F.col("d"), 10).alias("back"))


@query("SELECT o_orderkey, round(o_totalprice * 10 / 1e9 / 30, 12) AS seconds, round(1 / (o_totalprice * 10 / 1e9 / 30), 4) AS fps FROM orders")
def ticks_to_time(spark, sf_dir):
    s = scalar.ticks_to_seconds(F.col("o_totalprice"), F.lit(10.0), F.lit(30.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(s, 12).alias("seconds"), F.round(scalar.frames_per_second(s), 4).alias("fps"))


@query("SELECT l_orderkey, count(DISTINCT sha256(l_returnflag)) = 1 AS consistent FROM lineitem GROUP BY 1")
def consistent_frames(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("h", F.sha2(F.col("l_returnflag").cast("binary"), 256))
    return items.groupBy("l_orderkey").agg(scalar.consistent(F.col("h")).alias("consistent"))
