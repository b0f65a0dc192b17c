"""Registry of named queries, each with the SQL that gives the same rows in DuckDB (none where SQL cannot)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common table expressions for the SQL twins of the shared readers.
EV = "ev AS (SELECT event_id, user_id AS symbol, epoch_us(ts) AS us, value AS price, event_type AS wt, TRY_CAST(props->>'$.k' AS INTEGER) AS k FROM events)"
BARS = EV + """, bars AS (SELECT symbol, us // 21600000000 AS slot, arg_min(price, us) AS o, max(price) AS h, min(price) AS l, arg_max(price, us) AS c,
  sum(k)::BIGINT AS v, sum(price * k) AS qv, count(*) AS trades, coalesce(sum(k) FILTER (wt IN ('purchase', 'signup')), 0)::BIGINT AS taker_v,
  coalesce(sum(price * k) FILTER (wt IN ('purchase', 'signup')), 0.0) AS taker_qv FROM ev GROUP BY ALL)"""
PANEL = EV + """, panel AS (SELECT *, us // 86400000000 AS day, lead(price) OVER w / nullif(price, 0) - 1 AS f1, lead(price, 3) OVER w / nullif(price, 0) - 1 AS f3 FROM ev
  WINDOW w AS (PARTITION BY symbol ORDER BY us, event_id))"""
XS = """m0 AS (SELECT l_suppkey AS s, year(l_shipdate) * 12 + month(l_shipdate) AS m, sum(round(l_discount * 100)::BIGINT)::BIGINT AS sd, sum(round(l_tax * 100)::BIGINT)::BIGINT AS st, count(*) AS n,
    sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS px FROM lineitem GROUP BY ALL),
  xs AS (SELECT s, m, n, sd::DOUBLE / n AS score, st::DOUBLE / n AS alt, px, lead(px) OVER (PARTITION BY s ORDER BY m) / nullif(px, 0) - 1 AS f1 FROM m0)"""
ORD = "ord AS (SELECT o_orderkey AS id, o_custkey AS key, epoch_us(o_orderdate) AS us, o_totalprice AS value, o_orderpriority AS priority FROM orders)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
