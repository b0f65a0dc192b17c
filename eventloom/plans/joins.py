"""Queries over joins (J rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ret
from ..operators import bars as B
from ..operators.asof import asof, asof_chain, first_after, prefix_sum_at
from ..operators.detect import first_per
from ..operators.ranges import interval_sum, nearest, points_in_intervals
from ..sources import tables
from .panels import bars, panel, rounded
from .registry import BARS, EV, ORD, PANEL, query

#: Line items as events: key is the customer of their order, time the shipping date.
SHIP = ORD + ", e AS (SELECT l_orderkey AS oid, l_linenumber AS line, key, epoch_us(l_shipdate) AS us FROM lineitem JOIN ord ON l_orderkey = id)"
_SIDES = EV + ", e AS (SELECT event_id, symbol, us FROM ev WHERE wt = 'purchase'), q AS (SELECT symbol, us, price, k FROM ev WHERE wt = 'view')"
MIN, HOUR, DAY = B.MINUTE, B.HOUR, B.DAY


def shipments(spark, d):
    o = tables.metric(spark, d)
    items = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("oid"), F.col("l_linenumber").alias("line"), tables.micros("l_shipdate").alias("us"))
    return items.join(o.select(F.col("id").alias("oid"), "key"), "oid").select("oid", "line", "key", "us"), o


def sides(spark, d):
    t = tables.ticks(spark, d)
    return t.where("wt = 'purchase'").select("event_id", "symbol", "us"), t.where("wt = 'view'").select("symbol", "us", "price", "k")


@query("j01_asof_backward", f"WITH {SHIP}, f AS (SELECT key, us, max(value) AS value FROM ord GROUP BY ALL) SELECT oid, line, e.us, f.us AS known_at, f.value FROM e ASOF LEFT JOIN f ON e.key = f.key AND e.us >= f.us")
def j01(spark, d):
    e, o = shipments(spark, d)
    # a key with most of the rows is cut along its time line
    return asof(e, o.select("key", "us", "value"), "key", "us", ["value"], slices=360 * DAY).select("oid", "line", "us", "known_at", "value")


@query("j02_asof_strict", f"WITH {SHIP}, f AS (SELECT key, us, max(value) AS value FROM ord GROUP BY ALL) SELECT oid, line, f.us AS known_at, f.value FROM e ASOF LEFT JOIN f ON e.key = f.key AND e.us > f.us")
def j02(spark, d):
    e, o = shipments(spark, d)
    return asof(e, o.select("key", "us", "value"), "key", "us", ["value"], allow_exact=False, slices=360 * DAY).select("oid", "line", "known_at", "value")


@query("j03_asof_with_tolerance", f"WITH {_SIDES} SELECT event_id, CASE WHEN e.us - q.us <= 86400000000 THEN q.us END AS known_at, CASE WHEN e.us - q.us <= 86400000000 THEN price END AS price FROM e ASOF LEFT JOIN q ON e.symbol = q.symbol AND e.us >= q.us")
def j03(spark, d):
    e, q = sides(spark, d)
    return asof(e, q, "symbol", "us", ["price"], tolerance=DAY).select("event_id", "known_at", "price")


@query("j04_first_bar_after", f"WITH {BARS}, e AS (SELECT event_id, symbol, us FROM ev WHERE wt = 'purchase'), b AS (SELECT symbol, (slot + 1) * 21600000000 AS ends, slot, c FROM bars) SELECT event_id, CASE WHEN ends - us <= 64800000000 THEN slot END AS slot, CASE WHEN ends - us <= 64800000000 THEN c END AS c FROM e ASOF LEFT JOIN b ON e.symbol = b.symbol AND e.us < b.ends")
def j04(spark, d):
    # the first bar that ends after the event
    b = bars(spark, d).select("symbol", ((F.col("slot") + 1) * 6 * HOUR).alias("us"), "slot", "c")
    return first_after(sides(spark, d)[0], b, "symbol", "us", ["slot", "c"], allow_exact=False, tolerance=18 * HOUR).select("event_id", "slot", "c")


@query("j05_nearest_in_window", f"WITH {_SIDES}, p AS (SELECT event_id, q.us AS near_at, price, row_number() OVER (PARTITION BY event_id ORDER BY abs(q.us - e.us), q.us) AS r FROM e JOIN q ON e.symbol = q.symbol AND q.us BETWEEN e.us - 43200000000 AND e.us + 43200000000) SELECT event_id, near_at, price FROM p WHERE r = 1")
def j05(spark, d):
    e, q = sides(spark, d)
    return nearest(e, q, "event_id", "symbol", "us", ["price"], 12 * HOUR, 12 * HOUR)


_FILL = f"""WITH {_SIDES}, t AS (SELECT symbol, us, price FROM ev WHERE wt = 'click'), a AS (SELECT event_id, e.symbol, e.us, t.us AS in_at, t.price AS in_px FROM e ASOF LEFT JOIN t ON e.symbol = t.symbol AND e.us < t.us),
b AS (SELECT event_id, a.us, in_at, in_px, t.us AS out_at, t.price AS out_px, a.in_at + 172800000000 AS target FROM a ASOF LEFT JOIN t ON a.symbol = t.symbol AND a.in_at + 172800000000 <= t.us)
SELECT event_id, CASE WHEN in_at IS NULL THEN 'no entry' WHEN in_at - us > 172800000000 THEN 'late entry' WHEN out_at IS NULL THEN 'no exit' WHEN out_at - target > 172800000000 THEN 'late exit' WHEN in_px <= 0 THEN 'bad price' ELSE 'filled' END AS status,
round(CASE WHEN in_at - us <= 172800000000 AND out_at - target <= 172800000000 THEN out_px / nullif(in_px, 0) - 1 END, 6) AS ret FROM b"""


def fills(spark, d):
    t = tables.ticks(spark, d).where("wt = 'click'").select("symbol", "us", "price")
    a = first_after(sides(spark, d)[0], t, "symbol", "us", ["price"], allow_exact=False, known="at", prefix="in_")
    a = a.withColumn("target", F.col("in_at") + 2 * DAY)
    b = first_after(a, t.withColumnRenamed("us", "target"), "symbol", "target", ["price"], known="at", prefix="out_")
    late_in, late_out = F.col("in_at") - F.col("us") > 2 * DAY, F.col("out_at") - F.col("target") > 2 * DAY
    status = F.when(F.col("in_at").isNull(), "no entry").when(late_in, "late entry").when(F.col("out_at").isNull(), "no exit").when(late_out, "late exit").when(F.col("in_price") <= 0, "bad price").otherwise("filled")
    return b.select("event_id", status.alias("status"), F.when(~late_in & ~late_out, ret("out_price", "in_price")).alias("ret"))


@query("j06_fill_pairs", _FILL)
def j06(spark, d):
    return rounded(fills(spark, d))


@query("a43_drop_reasons", f"SELECT status, count(*) AS n FROM ({_FILL}) GROUP BY 1")
def a43(spark, d):
    return fills(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("j07_interval_flows", f"WITH {_SIDES} SELECT event_id, coalesce(sum(k), 0)::BIGINT AS sum_k FROM e LEFT JOIN q ON e.symbol = q.symbol AND q.us > e.us AND q.us <= e.us + 259200000000 GROUP BY 1")
def j07(spark, d):
    e, q = sides(spark, d)
    e = e.withColumns({"low": F.col("us"), "high": F.col("us") + 3 * DAY})
    return prefix_sum_at(e, q, "symbol", "us", "k", "low", "high").select("event_id", F.col("sum_k").cast("long").alias("sum_k"))


@query("j08_exact_times", f"WITH {BARS}, b AS (SELECT symbol, slot, count(*) AS n FROM (SELECT symbol, us // 21600000000 AS slot FROM ev WHERE wt = 'error') GROUP BY ALL) SELECT symbol, slot, trades, n FROM bars JOIN b USING (symbol, slot)")
def j08(spark, d):
    errors = tables.ticks(spark, d).where("wt = 'error'").groupBy("symbol", F.floor(F.col("us") / (6 * HOUR)).alias("slot")).agg(F.count("*").alias("n"))
    return bars(spark, d).join(errors, ["symbol", "slot"]).select("symbol", "slot", "trades", "n")


@query("j09_left_zero_fill", f"WITH {BARS}, b AS (SELECT symbol, us // 21600000000 AS slot, count(*) AS n FROM ev WHERE wt = 'error' GROUP BY ALL) SELECT symbol, slot, coalesce(n, 0) AS n FROM bars LEFT JOIN b USING (symbol, slot)")
def j09(spark, d):
    errors = tables.ticks(spark, d).where("wt = 'error'").groupBy("symbol", F.floor(F.col("us") / (6 * HOUR)).alias("slot")).agg(F.count("*").alias("n"))
    return bars(spark, d).select("symbol", "slot").join(errors, ["symbol", "slot"], "left").fillna(0, ["n"])


@query("j10_universe_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def j10(spark, d):
    rich = tables.read(spark, d, "customer").where("c_acctbal > 5000")
    return tables.read(spark, d, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("j11_unseen_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j11(spark, d):
    seen = tables.read(spark, d, "orders").where("o_totalprice > 400000")
    return tables.read(spark, d, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j12_dimension_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j12(spark, d):
    # 25 nations and 5 regions at every scale
    nation = tables.read(spark, d, "nation").join(F.broadcast(tables.read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return tables.read(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("j13_next_global_period", f"WITH {BARS}, g AS (SELECT symbol, slot // 4 AS day, arg_max(c, slot) AS c FROM bars GROUP BY ALL), n AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT day FROM g)) SELECT g.symbol, g.day, round(x.c / nullif(g.c, 0) - 1, 6) AS ret FROM g JOIN n USING (day) LEFT JOIN g x ON x.symbol = g.symbol AND x.day = n.nxt")
def j13(spark, d):
    g = bars(spark, d).groupBy("symbol", F.floor(F.col("slot") / 4).alias("day")).agg(F.max_by("c", "slot").alias("c"))
    calendar = g.select("day").distinct().withColumn("nxt", F.lead("day").over(Window.orderBy("day")))  # a row per day
    later = g.select("symbol", F.col("day").alias("nxt"), F.col("c").alias("then"))
    return rounded(g.join(calendar, "day").join(later, ["symbol", "nxt"], "left").select("symbol", "day", (ret("then", "c")).alias("ret")))


@query("j14_event_path_windows", f"WITH {EV}, e AS (SELECT event_id, symbol, us FROM ev WHERE wt = 'signup'), p AS (SELECT e.event_id, (x.us - e.us) // 86400000000 AS day, x.price FROM e JOIN ev x ON e.symbol = x.symbol AND x.us BETWEEN e.us - 172800000000 AND e.us + 172800000000) SELECT event_id, count(*) AS n, round(avg(price), 6) AS mean FROM p GROUP BY 1 HAVING count(*) >= 3")
def j14(spark, d):
    t = tables.ticks(spark, d)
    e = t.where("wt = 'signup'").select("event_id", "symbol", (F.col("us") - 2 * DAY).alias("low"), (F.col("us") + 2 * DAY).alias("high"))
    path = points_in_intervals(e, t.select("symbol", "us", "price"), "symbol", "low", "high", "us", 4 * DAY)
    return rounded(path.groupBy("event_id").agg(F.count("*").alias("n"), F.avg("price").alias("mean")).where("n >= 3"))


_UNIVERSE = f"WITH {BARS}, r AS (SELECT symbol, slot, c/ nullif(o, 0) - 1 AS ret FROM bars), e AS (SELECT event_id, symbol, us // 21600000000 AS slot FROM ev WHERE k >= 95), s AS (SELECT slot, sum(ret) AS total, count(*) AS n FROM r GROUP BY 1)"


@query("j15_event_against_universe", _UNIVERSE + " SELECT event_id, round((total - coalesce(r.ret, 0)) / (n - (r.ret IS NOT NULL)::INT), 6) AS others, n - (r.ret IS NOT NULL)::INT AS names FROM e JOIN s USING (slot) LEFT JOIN r ON r.symbol = e.symbol AND r.slot = e.slot WHERE n - (r.ret IS NOT NULL)::INT >= 5")
def j15(spark, d):
    # sums per slot first, then each event takes itself out
    r = bars(spark, d).select("symbol", "slot", (ret("c", "o")).alias("ret"))
    e = tables.ticks(spark, d).where("k >= 95").select("event_id", "symbol", F.floor(F.col("us") / (6 * HOUR)).alias("slot"))
    x = e.join(r.groupBy("slot").agg(F.sum("ret").alias("total"), F.count("*").alias("n")), "slot").join(r, ["symbol", "slot"], "left")
    names = F.col("n") - F.col("ret").isNotNull().cast("int")
    return rounded(x.select("event_id", ((F.col("total") - F.coalesce("ret", F.lit(0.0))) / names).alias("others"), names.alias("names")).where("names >= 5"))


@query("j16_leave_one_out_market", _UNIVERSE.replace(", e AS (SELECT event_id, symbol, us // 21600000000 AS slot FROM ev WHERE k >= 95)", "") + " SELECT symbol, slot, round(ret - (total - ret) / (n - 1), 6) AS excess FROM r JOIN s USING (slot) WHERE n >= 4")
def j16(spark, d):
    r = bars(spark, d).select("symbol", "slot", (ret("c", "o")).alias("ret"))
    s = r.groupBy("slot").agg(F.sum("ret").alias("total"), F.count("*").alias("n")).where("n >= 4")
    return rounded(r.join(s, "slot").select("symbol", "slot", (F.col("ret") - (F.col("total") - F.col("ret")) / (F.col("n") - 1)).alias("excess")))


@query("j17_cross_confirmation", f"WITH {EV} SELECT event_id, EXISTS (SELECT 1 FROM ev x WHERE x.symbol = e.symbol AND x.wt <> e.wt AND x.us BETWEEN e.us - 7200000000 AND e.us + 7200000000) AS confirmed FROM ev e")
def j17(spark, d):
    # a set of at most five kinds per event, from one window: dense stretches make no pairs
    t = tables.ticks(spark, d).select("event_id", "symbol", "us", "wt")
    around = Window.partitionBy("symbol").orderBy("us").rangeBetween(-2 * HOUR, 2 * HOUR)
    return t.select("event_id", (F.size(F.array_remove(F.collect_set("wt").over(around), F.col("wt"))) > 0).alias("confirmed"))


@query("j18_recall_between_feeds", f"WITH {_SIDES}, w(hours) AS (VALUES (1), (6), (24)) SELECT hours, count(*) AS n, round(avg((EXISTS (SELECT 1 FROM q WHERE q.symbol = e.symbol AND q.us BETWEEN e.us - hours * 3600000000 AND e.us + hours * 3600000000))::INT), 6) AS recall FROM e, w GROUP BY 1")
def j18(spark, d):
    e, q = sides(spark, d)
    n, parts = e.count(), []
    for hours in (1, 6, 24):
        spans = e.withColumns({"low": F.col("us") - hours * HOUR, "high": F.col("us") + hours * HOUR}).drop("us")
        hit = points_in_intervals(spans, q, "symbol", "low", "high", "us", 2 * hours * HOUR, how="left_semi")
        parts.append(hit.agg(F.lit(hours).alias("hours"), F.lit(n).alias("n"), F.round(F.count("*") / max(n, 1), 6).alias("recall")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("j19_calendar_windows", f"WITH {EV}, w(name, a, b) AS (VALUES ('w1', 1704067200000000, 1704672000000000), ('w2', 1704672000000000, 1705276800000000), ('w3', 1705276800000000, 1705881600000000), ('w4', 1705881600000000, 1706486400000000)) SELECT name, count(*) AS n, round(sum(price), 4) AS total FROM ev JOIN w ON us >= a AND us < b GROUP BY 1")
def j19(spark, d):
    week = 7 * DAY
    windows = spark.createDataFrame([(f"w{i + 1}", 1704067200000000 + i * week, 1704067200000000 + (i + 1) * week) for i in range(4)], "name string, a long, b long")
    t = tables.ticks(spark, d).join(F.broadcast(windows), (F.col("us") >= F.col("a")) & (F.col("us") < F.col("b")))  # four windows
    return t.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("total"))


@query("j20_last_two_values", f"WITH {_SIDES}, q2 AS (SELECT symbol, us, price, lag(price) OVER (PARTITION BY symbol ORDER BY us) AS before FROM q) SELECT event_id, price, before, round(price / nullif(before, 0) - 1, 6) AS chg FROM e ASOF LEFT JOIN q2 ON e.symbol = q2.symbol AND e.us >= q2.us")
def j20(spark, d):
    e, q = sides(spark, d)
    q = q.withColumn("before", F.lag("price").over(Window.partitionBy("symbol").orderBy("us")))
    return rounded(asof(e, q, "symbol", "us", ["price", "before"]).select("event_id", "price", "before", (ret("price", "before")).alias("chg")))


@query("j21_paired_days", f"WITH {PANEL}, a AS (SELECT day, avg(f1) AS m FROM panel WHERE k >= 80 GROUP BY 1), b AS (SELECT day, avg(f1) AS m FROM panel WHERE k < 20 GROUP BY 1) SELECT day, round(a.m - b.m, 6) AS excess FROM a JOIN b USING (day)")
def j21(spark, d):
    p = panel(spark, d)
    a = p.where("k >= 80").groupBy("day").agg(F.avg("f1").alias("a"))
    return rounded(a.join(p.where("k < 20").groupBy("day").agg(F.avg("f1").alias("b")), "day").select("day", (F.col("a") - F.col("b")).alias("excess")))


@query("j22_parameter_grid", f"WITH {PANEL}, t(thr) AS (VALUES (20), (50), (80)), s(side) AS (VALUES (1), (-1)) SELECT thr, side, count(*) AS n, round(avg(side * f1), 6) AS mean FROM panel, t, s WHERE k >= thr AND f1 IS NOT NULL GROUP BY ALL")
def j22(spark, d):
    grid = spark.createDataFrame([(t, s) for t in (20, 50, 80) for s in (1, -1)], "thr int, side int")
    p = panel(spark, d).where("f1 IS NOT NULL").join(F.broadcast(grid), F.col("k") >= F.col("thr"))  # six parameter rows
    return rounded(p.groupBy("thr", "side").agg(F.count("*").alias("n"), F.avg(F.col("side") * F.col("f1")).alias("mean")))


@query("j23_asof_chain", f"WITH {_SIDES}, c AS (SELECT symbol, us, price FROM ev WHERE wt = 'click'), r AS (SELECT symbol, us, k FROM ev WHERE wt = 'error') SELECT event_id, q.price AS view_price, q.us AS view_known_at, c.price AS click_price, c.us AS click_known_at, r.k AS error_k, r.us AS error_known_at FROM e ASOF LEFT JOIN q ON e.symbol = q.symbol AND e.us >= q.us ASOF LEFT JOIN c ON e.symbol = c.symbol AND e.us >= c.us ASOF LEFT JOIN r ON e.symbol = r.symbol AND e.us >= r.us")
def j23(spark, d):
    t = tables.ticks(spark, d)
    kind = lambda w: t.where(F.col("wt") == w)
    e = kind("purchase").select("event_id", "symbol", "us")
    return asof_chain(e, {"view": (kind("view"), ["price"]), "click": (kind("click"), ["price"]), "error": (kind("error"), ["k"])}, "symbol", "us").drop("symbol", "us")


@query("j24_basis", f"WITH {_SIDES}, x AS (SELECT symbol, us, price, k FROM q WHERE k > 0) SELECT event_id, round((price - k) / k, 6) AS basis FROM e ASOF LEFT JOIN x ON e.symbol = x.symbol AND e.us >= x.us")
def j24(spark, d):
    e, q = sides(spark, d)
    return rounded(asof(e, q.where("k > 0"), "symbol", "us", ["price", "k"]).select("event_id", ((F.col("price") - F.col("k")) / F.col("k")).alias("basis")))


@query("j25_anti_interval", f"WITH {_SIDES} SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.symbol = e.symbol AND q.us BETWEEN e.us - 21600000000 AND e.us + 21600000000)")
def j25(spark, d):
    e, q = sides(spark, d)
    spans = e.withColumns({"low": F.col("us") - 6 * HOUR, "high": F.col("us") + 6 * HOUR}).drop("us")
    return points_in_intervals(spans, q, "symbol", "low", "high", "us", 12 * HOUR, how="left_anti").select("event_id")


@query("j26_source_priority", f"WITH {BARS}, a AS (SELECT symbol, slot // 4 AS day, avg(price) AS px FROM (SELECT symbol, us // 21600000000 AS slot, price FROM ev WHERE wt = 'purchase') GROUP BY ALL), b AS (SELECT symbol, slot // 4 AS day, avg(c) AS px FROM bars GROUP BY ALL) SELECT symbol, day, round(coalesce(a.px, b.px), 6) AS px FROM b LEFT JOIN a USING (symbol, day)")
def j26(spark, d):
    # one pass: the first source's rows win where a key has any
    first = tables.ticks(spark, d).where("wt = 'purchase'").groupBy("symbol", F.floor(F.col("us") / DAY).alias("day")).agg(F.avg("price").alias("px"))
    second = bars(spark, d).groupBy("symbol", F.floor(F.col("slot") / 4).alias("day")).agg(F.avg("c").alias("px"))
    both = first.withColumn("rank", F.lit(0)).unionByName(second.withColumn("rank", F.lit(1)))
    return rounded(first_per(both, ["symbol", "day"], [F.col("rank")]).select("symbol", "day", "px"))


@query("j27_symmetric_volume", f"WITH {_SIDES} SELECT event_id, coalesce(sum(q.k), 0)::BIGINT AS volume, coalesce(sum(q.k), 0) >= 100 AS executable FROM e LEFT JOIN q ON q.symbol = e.symbol AND q.us BETWEEN e.us - 86400000000 AND e.us + 86400000000 GROUP BY 1")
def j27(spark, d):
    e, q = sides(spark, d)
    spans = e.select("event_id", "symbol", (F.col("us") - DAY).alias("low"), (F.col("us") + DAY).alias("high"))
    sums = interval_sum(spans, q, ["event_id"], "symbol", "low", "high", "us", F.col("k"), 2 * DAY, "volume")
    return sums.select("event_id", "volume", (F.col("volume") >= 100).alias("executable"))


@query("j28_asof_with_lag_and_age", f"WITH {_SIDES} SELECT event_id, CASE WHEN e.us - q.us <= 172800000000 THEN price END AS price FROM e ASOF LEFT JOIN q ON e.symbol = q.symbol AND e.us >= q.us + 3600000000")
def j28(spark, d):
    # known an hour after it was taken, and at most two days old
    e, q = sides(spark, d)
    return asof(e, q, "symbol", "us", ["price"], lag=HOUR, tolerance=47 * HOUR).select("event_id", "price")
