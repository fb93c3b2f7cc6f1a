from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

from cadenza import catalog_queries
from cadenza import fixtures as X
from cadenza.operators import dealing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["playlist_audit", "m3u8_lines", "m3u8_round_trip"])
def test_parts_follow_the_stored_tables(spark, monkeypatch, name):
    """Large tables are dealt over more parts than the session's setting, no set of all items is held, and the rows stay those of the SQL."""
    monkeypatch.setattr(dealing, "PART_BYTES", 10_000)
    df = catalog_queries.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    numbers = {int(n) for n in re.findall(r"hashpartitioning\([^)]*?, (\d+)\), REPARTITION_BY_NUM", plan)}
    assert numbers and min(numbers) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert not re.search(r"HashAggregate\(keys=\[l_orderkey", plan) and "BroadcastHashJoin" not in plan
    db = duckdb.connect()
    for table in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.execute(catalog_queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(want.fetchall())


def test_items_pass_over_repeated_lines(spark, tmp_path):
    rows = [(1, 7), (1, 3), (1, 7), (2, 5), (1, 3), (2, 5), (3, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in X.items(spark, str(tmp_path)).collect())
    assert got == [(1, 0, "00000003"), (1, 1, "00000007"), (2, 0, "00000005"), (3, 0, "00000001")]


@pytest.mark.parametrize("name", ["playlist_audit", "m3u8_lines", "m3u8_round_trip"])
def test_parts_do_not_wait_for_the_number_of_shuffle_partitions(spark, monkeypatch, name):
    """With Spark's 200 shuffle partitions, which adaptive execution merges, tables of fewer parts are dealt out too, and tracks aren't broadcast."""
    monkeypatch.setattr(dealing, "PART_BYTES", 10_000)
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "200")
    df = catalog_queries.queries()[name](session, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    numbers = [int(n) for n in re.findall(r"hashpartitioning\([^)]*?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert len(numbers) > 1 and spark.sparkContext.defaultParallelism < min(numbers) < 200
    assert "BroadcastHashJoin" not in plan
    assert Counter(df.collect()) == Counter(catalog_queries.queries()[name](spark, SF).collect())


def test_a_large_catalog_is_not_broadcast(spark, monkeypatch, tmp_path):
    spark.range(1000).selectExpr("cast(id AS string) AS k", "id AS v").write.parquet(f"{tmp_path}/known")
    known, rows = spark.read.parquet(f"{tmp_path}/known"), spark.createDataFrame([("7", 1), ("x", 2), ("7", 3)], "k string, n int")
    assert "BroadcastHashJoin" in dealing.look_up(rows, known, "k")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(dealing, "PART_BYTES", 4_000)
    found = dealing.look_up(rows, known, "k")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.n, r.v) for r in found.collect()) == [(1, 7), (2, None), (3, 7)]
