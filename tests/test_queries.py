"""Every query against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from eventloom.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
            return "null"
        return f"{float(v) + 0.0:.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_legs_from_a_price_of_zero_are_null_in_both_engines(spark, tmp_path):
    # week 0 begins at zero, week 1 doesn't: slots 0, 8 and 20 hold the three anchors
    spark.sql("""SELECT id AS event_id, timestamp_micros((id div 3 * 28 + element_at(array(0, 8, 20), cast(id % 3 + 1 AS int))) * 21600000000) AS ts, 1L AS user_id,
        'view' AS event_type, if(id = 0, 0.0D, 2.0D + id) AS value, '{"k": 1}' AS props FROM range(6)""").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got, want = (rows(x) for x in (QUERIES["w46_named_anchor_legs"](spark, str(tmp_path)).toPandas(), con.execute(SQL["w46_named_anchor_legs"]).df()))
    assert got == want and [r[0] for r in got] == ["0.2", "null"] and got[1][1] != "null"
