"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df):
    df = df.reindex(sorted(df.columns), axis=1)
    for c in df.columns:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float).round(6)
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype(str)
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_sql_gives(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 9
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _same(spark, folder, name):
    """A query against its SQL over a folder that has just the tables it reads."""
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}/**/*.parquet')")
    got, want = QUERIES[name](spark, f"file://{folder}").toPandas(), con.sql(ORACLES[name]).df()
    assert normal(got) == normal(want)
    return got


def test_runs_that_come_late_are_there_once(spark, tmp_path):
    """Each file has early and late events, so that after the first batch every other has some of weeks before."""
    for i in range(8):
        spark.sql(f"SELECT id AS event_id, timestamp'2024-01-01' + make_dt_interval(CAST(20 * (id % 2) AS INT), {i}) AS ts, 7L AS user_id, IF(id % 3 = 0, 'error', 'click') AS event_type, 1.5D AS value, '' AS props FROM range({10 * i}, {10 * i + 10})").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
    assert sum(_same(spark, tmp_path, "ingest_runs").n) == 80


def test_equal_means_stand_by_their_key(spark, tmp_path):
    """The same values in other orders have equal means, whose users stand in the order of their numbers."""
    values = [0.1, 0.2, 0.3, 0.7, 1.1, 122.79, 29.27]
    rows_ = [(u, t, values[(k * (1 + u % 6) + u) % 7]) for u in range(60) for t in ("click", "view") for k in range(7)]
    spark.createDataFrame(rows_, "user_id long, event_type string, value double").coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    got = _same(spark, tmp_path, "order_by_base")
    assert list(got.sort_values("ordinal").user_id) == list(range(60))


def test_a_program_with_an_id_past_the_range_has_no_tokens(spark, tmp_path):
    spark.sql("SELECT CAST(id % 4 AS BIGINT) AS l_orderkey, id AS l_partkey, 19997 + id % 4 AS l_suppkey, CAST(1 + id DIV 4 AS INT) AS l_linenumber, 3D AS l_quantity, 'A' AS l_returnflag FROM range(12)").coalesce(1).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    got = _same(spark, tmp_path, "program_tokens").set_index("l_orderkey")
    assert got.tokens.isna().to_dict() == {0: False, 1: False, 2: False, 3: True}
