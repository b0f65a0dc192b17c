"""Queries over streams (T rows): the event table is replayed as a stream of files, and each result equals its batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ret
from ..operators.bars import DAY, HOUR
from ..sources import tables
from ..streaming import ladder as L
from ..streaming import runs as R
from ..streaming.progress import heartbeat, staleness
from .registry import EV, query
from .windows import RUNGS

_LAG = "2 hours"
_CLOSED = "(SELECT max(us) FROM ev) - 7200000000"


def stream(spark, d):
    # a glob, as a stream source wants files of a folder; replayed in order of time
    return R.event_stream(spark, *R.in_order(spark, f"{d}/events.parque[t]"))


#: A day and a half at full rate, then a sample for six hours up to five days.
RING = L.Ring(36 * HOUR, 6 * HOUR, 5 * DAY)


def _kept(times: str, gap: int) -> str:
    return f"list_reduce(list_transform({times}, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] >= {gap} THEN list_concat(acc, x) ELSE acc END)"


def _rung(name, window, least):
    """Hits of a rung in SQL: the last tick at or before the window if it is in the short ring, else the last thinned one if that is in the long ring."""
    past = f"CASE WHEN e.us - s.us <= {RING.short} THEN s.price WHEN e.l - g.us <= {RING.long} THEN g.price END"
    return f"""SELECT e.event_id, e.symbol, e.us, '{name}' AS rung FROM (SELECT *, us - {window} AS t FROM newest) e ASOF LEFT JOIN ev s ON e.symbol = s.symbol AND e.t >= s.us
  ASOF LEFT JOIN thin g ON e.symbol = g.symbol AND e.t >= g.us WHERE abs(round((e.price / nullif({past}, 0) - 1) * 100, 4)) >= {least}"""


LADDER = f"""{EV}, thin AS (SELECT symbol, us, price FROM ev JOIN (SELECT symbol, unnest({_kept("list_sort(list(us))", RING.step)}) AS us FROM ev GROUP BY symbol) USING (symbol, us)),
newest AS (SELECT e.*, t.us AS l FROM ev e ASOF JOIN thin t ON e.symbol = t.symbol AND e.us >= t.us),
hits AS ({" UNION ALL ".join(_rung(*r) for r in RUNGS)})"""


@query("t01_streaming_ladder_with_cooldown", f"""WITH {LADDER}, k AS (SELECT symbol, rung, unnest({_kept("list_sort(list(us))", 12 * HOUR)}) AS us FROM hits GROUP BY symbol, rung)
SELECT event_id, symbol, us, rung FROM hits JOIN k USING (symbol, rung, us)""")
def t01(spark, d):
    return L.drained(L.alerts(stream(spark, d), RUNGS, RING, 12 * HOUR, 12 * HOUR, _LAG)).drop("pushed")


@query("t02_store_and_push_cooldowns", f"""WITH {LADDER}, g AS (SELECT symbol, rung, {_kept("list_sort(list(us))", 6 * HOUR)} AS kept FROM hits GROUP BY symbol, rung), p AS (SELECT symbol, rung, unnest(kept) AS us, {_kept("kept", 2 * DAY)} AS pushes FROM g)
SELECT event_id, rung, list_contains(pushes, us) AS pushed FROM hits JOIN p USING (symbol, rung, us)""")
def t02(spark, d):
    # what the first cooldown lets through is stored; of that, the second lets less through to be pushed
    return L.drained(L.alerts(stream(spark, d), RUNGS, RING, 6 * HOUR, 2 * DAY, _LAG)).select("event_id", "rung", "pushed")


@query("t03_stream_static_enrichment", f"WITH {EV} SELECT event_id, symbol, c_mktsegment AS segment FROM ev LEFT JOIN customer ON symbol = c_custkey")
def t03(spark, d):
    static = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("segment"))
    return R.drain(R.enriched(stream(spark, d).select("event_id", "symbol"), static, "symbol"))


@query("t04_sliding_change", f"WITH {EV}, w AS (SELECT *, unnest([us // 21600000000, us // 21600000000 - 1, us // 21600000000 - 2, us // 21600000000 - 3]) * 21600000000 AS start FROM ev) SELECT symbol, start, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN arg_max(price, us) / nullif(arg_min(price, us), 0) - 1 END, 6) AS change FROM w GROUP BY ALL HAVING start + 86400000000 <= {_CLOSED}")
def t04(spark, d):
    out = R.drain(R.change_over_snapshots(stream(spark, d), "24 hours", "6 hours", _LAG))
    return out.select("symbol", "start", "n", F.round("change", 6).alias("change"))


@query("t05_tumbling_bars", f"WITH {EV} SELECT symbol, us // 86400000000 * 86400000000 AS start, arg_min(price, us) AS o, max(price) AS h, min(price) AS l, arg_max(price, us) AS c, count(*) AS trades FROM ev GROUP BY symbol, us // 86400000000 HAVING us // 86400000000 * 86400000000 + 86400000000 <= {_CLOSED}")
def t05(spark, d):
    return R.drain(R.tumbling_bars(stream(spark, d), "1 day", _LAG))


@query("t07_exactly_once", f"WITH {EV} SELECT DISTINCT symbol, us // 3600000000 AS hour FROM ev")
def t07(spark, d):
    s = stream(spark, d).select("ts", "symbol", F.floor(F.col("us") / HOUR).alias("hour"))
    return R.drain(R.once(s, ["symbol", "hour"], "40 days").select("symbol", "hour"))


@query("t08_late_repair", f"WITH {EV}, t AS (SELECT symbol, us // 86400000000 AS day, min(us) AS us FROM ev WHERE event_id % 4 = 0 GROUP BY ALL), n AS (SELECT symbol, us // 86400000000 AS day, min(us) AS us FROM ev GROUP BY ALL) SELECT symbol, day, coalesce(t.us, n.us) AS us FROM n LEFT JOIN t USING (symbol, day)")
def t08(spark, d):
    day = F.floor(F.col("us") / DAY).alias("day")
    table = tables.ticks(spark, d).where("event_id % 4 = 0").groupBy("symbol", day).agg(F.min("us").alias("us"))
    return R.repaired(stream(spark, d).select("symbol", day, "us"), table, ["symbol", "day"])


@query("t09_maturity_gate", f"WITH {EV}, e AS (SELECT event_id, symbol, us, price FROM ev WHERE wt = 'purchase' AND us + 259200000000 <= (SELECT max(us) FROM ev)) SELECT e.event_id, round(x.price / nullif(e.price, 0) - 1, 6) AS ret FROM (SELECT *, us + 172800000000 AS target FROM e) e ASOF LEFT JOIN ev x ON e.symbol = x.symbol AND e.target <= x.us")
def t09(spark, d):
    from ..operators.asof import first_after

    t = tables.ticks(spark, d)
    now = t.agg(F.max("us")).first()[0] or 0
    e = t.where((F.col("wt") == "purchase") & (F.col("us") + 3 * DAY <= now)).select("event_id", "symbol", F.col("price").alias("px"), (F.col("us") + 2 * DAY).alias("us"))
    return first_after(e, t.select("symbol", "us", "price"), "symbol", "us", ["price"]).select("event_id", F.round(ret("price", "px"), 6).alias("ret"))


@query("t10_heartbeat", f"WITH {EV} SELECT count(*) AS n, max(us) AS newest FROM ev")
def t10(spark, d):
    return heartbeat(stream(spark, d), "wt", []).agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))


@query("t10_source_staleness", f"WITH {EV} SELECT wt AS source, count(*) AS n, max(us) AS newest, (SELECT max(us) FROM ev) - max(us) AS age FROM ev WHERE wt IN ('view', 'purchase', 'error', 'signup', 'click') GROUP BY wt")
def t10_sources(spark, d):
    return staleness(heartbeat(stream(spark, d), "wt", ["view", "purchase", "error", "signup", "click"]))


@query("t11_alert_routing", f"WITH {EV} SELECT 'archive' AS sink, count(*) AS n, count(DISTINCT us // 86400000000) AS days FROM ev UNION ALL SELECT 'push', count(*), count(DISTINCT us // 86400000000) FROM ev WHERE k >= 90")
def t11(spark, d):
    both = R.routed(stream(spark, d).select("event_id", "us", "k"), "k >= 90")
    one = lambda df, name: df.agg(F.lit(name).alias("sink"), F.count("*").alias("n"), F.countDistinct(F.floor(F.col("us") / DAY)).alias("days"))
    return one(both[0], "archive").unionByName(one(both[1], "push"))


@query("t12_session_windows", f"WITH {EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY us)), s AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY us) AS sid FROM g) SELECT symbol, min(us) AS start, max(us) + 21600000000 AS \"end\", count(*) AS n FROM s GROUP BY symbol, sid HAVING max(us) + 21600000000 <= {_CLOSED}")
def t12(spark, d):
    return R.drain(R.sessions(stream(spark, d), "6 hours", _LAG))


@query("t13_live_breadth", f"WITH {EV} SELECT us // 3600000000 * 3600000000 AS start, count(*) AS n FROM ev GROUP BY 1 HAVING start + 3600000000 <= {_CLOSED}")
def t13(spark, d):
    return R.drain(R.breadth(stream(spark, d), "1 hour", _LAG))
