"""The SQL of the operators against their queries on the smallest tables, and on a block of a dialogue above its bound."""

from __future__ import annotations

import os

import duckdb
import pytest

from asofspark.llm import queries

DATA = "/root/testdata/sf0.001"


def compared(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}')")
    answer = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in answer.description]
    want = sorted(map(str, answer.fetchall()))
    df = queries.queries()[name](spark, str(folder))
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == want and want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op4_chat_rotation", "op12_periodic_runs", "op13_structure_repair"])
def test_query_matches_sql(spark, name):
    compared(spark, DATA, name)


def test_a_block_above_its_bound(spark, tmp_path):
    rows = spark.range(5_000).selectExpr("1L as conv_id", "id % 3 as turn", "case when id % 2 = 0 then 'user' else 'assistant' end as role", "concat('t', id % 700) as text")
    rows.unionByName(spark.sql("select cast(null as bigint) as conv_id, cast(null as bigint) as turn, cast(null as string) as role, cast(null as string) as text")).write.parquet(f"{tmp_path}/conversations.parquet")
    compared(spark, tmp_path, "op4_chat_rotation")
