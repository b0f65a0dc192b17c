"""Queries over ordered analytics (W rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ret
from ..operators import bars as B
from ..operators import detect as D
from ..operators import outcomes as O
from ..operators.asof import asof, first_after
from ..operators.ranks import quantiles, with_trailing_rank, with_weight_before
from ..sources import tables
from .panels import bars, panel, rounded
from .registry import BARS, EV, PANEL, query

_W = "WINDOW w AS (PARTITION BY symbol ORDER BY slot)"
def _by():
    return Window.partitionBy("symbol").orderBy("slot")



@query("w01_row_returns", f"WITH {BARS} SELECT symbol, slot, round(c / nullif(lag(c, 1) OVER w, 0) - 1, 6) AS r1, round(c / nullif(lag(c, 5) OVER w, 0) - 1, 6) AS r5 FROM bars {_W}")
def w01(spark, d):
    return rounded(bars(spark, d).select("symbol", "slot", B.change("c", "symbol", "slot", 1).alias("r1"), B.change("c", "symbol", "slot", 5).alias("r5")))


def _change_sql(name, us):
    return f"round((price / nullif(arg_max(price, us) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {us} PRECEDING), 0) - 1) * 100, 4) AS {name}"


@query("w02_time_anchored_change", f"WITH {EV} SELECT event_id, {_change_sql('d1', 86400000000)}, {_change_sql('d3', 259200000000)} FROM ev")
def w02(spark, d):
    t = tables.ticks(spark, d)
    return rounded(t.select("event_id", D.change_over(F.col("price"), "symbol", "us", B.DAY).alias("d1"), D.change_over(F.col("price"), "symbol", "us", 3 * B.DAY).alias("d3")), 4)


_LADDER = f"""WITH {EV}, c AS (SELECT *, {_change_sql('a', 21600000000)}, {_change_sql('b', 86400000000)}, {_change_sql('e', 259200000000)} FROM ev),
l AS (SELECT event_id, symbol, us, 'h6' AS rung, a AS change FROM c WHERE abs(a) >= 50 UNION ALL SELECT event_id, symbol, us, 'd1', b FROM c WHERE abs(b) >= 100 UNION ALL SELECT event_id, symbol, us, 'd3', e FROM c WHERE abs(e) >= 200)"""
RUNGS = [("h6", 6 * B.HOUR, 50.0), ("d1", B.DAY, 100.0), ("d3", 3 * B.DAY, 200.0)]


def ladder(spark, d):
    return D.ladder(tables.ticks(spark, d).select("event_id", "symbol", "us", "price"), "symbol", "us", "price", RUNGS).drop("price")


@query("w03_threshold_ladder", _LADDER + " SELECT * FROM l")
def w03(spark, d):
    return ladder(spark, d)


@query("w04_price_or_metric_trigger", f"WITH {EV}, c AS (SELECT event_id, symbol, us, coalesce({_change_sql('x', 3600000000).rpartition(' AS ')[0]}, 0.0) AS chg FROM ev), q AS (SELECT symbol, us, k FROM ev WHERE wt = 'view') SELECT event_id, chg, q.k FROM c ASOF LEFT JOIN q ON c.symbol = q.symbol AND c.us >= q.us WHERE abs(chg) >= 80 OR q.k >= 90")
def w04(spark, d):
    t = tables.ticks(spark, d)
    c = t.select("event_id", "symbol", "us", F.coalesce(F.round(D.change_over(F.col("price"), "symbol", "us", B.HOUR), 4), F.lit(0.0)).alias("chg"))
    return asof(c, t.where("wt = 'view'").select("symbol", "us", "k"), "symbol", "us", ["k"]).where("abs(chg) >= 80 OR k >= 90").select("event_id", "chg", "k")


@query("w05_z_scores", f"""WITH {BARS} SELECT symbol, slot, round(CASE WHEN count(*) OVER a = 20 THEN (v - avg(v) OVER a) / nullif(stddev_samp(v) OVER a, 0) END, 5) AS z20, round(CASE WHEN count(*) OVER b = 30 THEN (v - avg(v) OVER b) / nullif(stddev_pop(v) OVER b, 0) END, 5) AS z30
FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def w05(spark, d):
    return rounded(bars(spark, d).select("symbol", "slot", B.z_score("v", "symbol", "slot", 20, with_current=True).alias("z20"), B.z_score("v", "symbol", "slot", 30, with_current=False).alias("z30")), 5)


@query("w06_breakouts", f"WITH {BARS} SELECT symbol, slot, CASE WHEN count(*) OVER a = 20 THEN max(h) OVER a END AS high20, CASE WHEN count(*) OVER a = 20 THEN c > max(h) OVER a END AS breakout, round(c / nullif(max(h) OVER b, 0) - 1, 6) AS from_high, round(c / nullif(min(l) OVER b, 0) - 1, 6) AS from_low FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 28 PRECEDING AND CURRENT ROW)")
def w06(spark, d):
    a, b = B.by_rows("symbol", "slot", -20, -1), B.by_rows("symbol", "slot", -28, 0)
    high = B.full(F.max("h").over(a), a, 20)
    return rounded(bars(spark, d).select("symbol", "slot", high.alias("high20"), (F.col("c") > high).alias("breakout"), ret("c", F.max("h").over(b)).alias("from_high"), ret("c", F.min("l").over(b)).alias("from_low")))


@query("w08_atr_and_rsi", f"""WITH {BARS}, t AS (SELECT *, greatest(h - l, abs(h - coalesce(lag(c) OVER w, c)), abs(l - coalesce(lag(c) OVER w, c))) AS tr, c - lag(c) OVER w AS d FROM bars {_W})
SELECT symbol, slot, round(CASE WHEN count(*) OVER a = 10 THEN avg(tr) OVER a / nullif(c, 0) END, 6) AS atr, round(CASE WHEN count(d) OVER a < 10 THEN 50 WHEN sum(greatest(-d, 0)) OVER a = 0 THEN 100 ELSE 100 - 100 / (1 + sum(greatest(d, 0)) OVER a / sum(greatest(-d, 0)) OVER a) END, 5) AS rsi
FROM t WINDOW a AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def w08(spark, d):
    b = B.with_rsi(B.with_atr(bars(spark, d), "symbol", "slot", 10), "symbol", "slot", 10)
    return b.select("symbol", "slot", F.round("atr", 6).alias("atr"), F.round("rsi", 5).alias("rsi"))


@query("w10_ema_cross", f"""WITH RECURSIVE {BARS}, r AS (SELECT symbol, slot, c, row_number() OVER w AS i FROM bars {_W}),
e AS (SELECT symbol, slot, i, c AS f, c AS s FROM r WHERE i = 1 UNION ALL SELECT r.symbol, r.slot, r.i, e.f + (r.c - e.f) * 2 / 6, e.s + (r.c - e.s) * 2 / 13 FROM e JOIN r ON r.symbol = e.symbol AND r.i = e.i + 1)
SELECT symbol, slot, round(f, 5) AS ema_5, round(s, 5) AS ema_12, CASE WHEN abs(f - s) < 1e-6 THEN NULL ELSE f > s END AS above FROM e""")
def w10(spark, d):
    b = B.with_ema(B.with_ema(bars(spark, d).select("symbol", "slot", "c"), "symbol", "slot", "c", 5), "symbol", "slot", "c", 12)
    return rounded(b.select("symbol", "slot", "ema_5", "ema_12", F.when(F.abs(F.col("ema_5") - F.col("ema_12")) >= 1e-6, F.col("ema_5") > F.col("ema_12")).alias("above")), 5)


@query("w11_cumulative_vwap", f"WITH {BARS} SELECT symbol, slot, round(sum(qv) OVER w / nullif(sum(v) OVER w, 0), 6) AS vwap, round(c / nullif(sum(qv) OVER w / nullif(sum(v) OVER w, 0), 0) - 1, 6) + 0.0 AS gap FROM bars {_W}")
def w11(spark, d):
    vwap = F.sum("qv").over(_by()) / F.nullif(F.sum("v").over(_by()), F.lit(0))
    # adding zero turns a negative zero into a plain one
    return bars(spark, d).select("symbol", "slot", F.round(vwap, 6).alias("vwap"), (F.round(ret("c", vwap), 6) + 0.0).alias("gap"))


@query("w12_forward_and_excursions", f"WITH {BARS} SELECT symbol, slot, round(lead(c, 4) OVER w / nullif(c, 0) - 1, 6) AS f4, round(max(h) OVER a / nullif(c, 0) - 1, 6) AS mfe, round(min(l) OVER a / nullif(c, 0) - 1, 6) AS mae FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot), a AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)")
def w12(spark, d):
    mfe, mae = B.excursions("symbol", "slot", 8)
    return rounded(bars(spark, d).select("symbol", "slot", B.forward("c", "symbol", "slot", 4).alias("f4"), mfe.alias("mfe"), mae.alias("mae")))


@query("w13_forward_by_time", f"WITH {EV} SELECT e.event_id, round(CASE WHEN x.us - e.target <= 86400000000 THEN x.price / nullif(e.price, 0) - 1 END, 6) AS f2d FROM (SELECT *, us + 172800000000 AS target FROM ev) e ASOF LEFT JOIN ev x ON e.symbol = x.symbol AND e.target <= x.us")
def w13(spark, d):
    t = tables.ticks(spark, d).select("event_id", "symbol", "price", "us")
    e = t.select("event_id", "symbol", F.col("price").alias("px"), (F.col("us") + 2 * B.DAY).alias("us"))
    return rounded(first_after(e, t, "symbol", "us", ["price"], tolerance=B.DAY).select("event_id", (ret("price", "px")).alias("f2d")))


@query("w15_trailing_counts", f"""WITH {EV} SELECT event_id, count(*) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS n24h, us - lag(us) OVER (PARTITION BY symbol ORDER BY us) AS since,
row_number() OVER (PARTITION BY symbol, us // 86400000000 ORDER BY us) = 1 AS first_of_day, count(*) OVER (PARTITION BY us // 3600000000) AS breadth FROM ev""")
def w15(spark, d):
    # an hour of all symbols is counted by an aggregate, a row per hour, and looked up
    w, t = Window.partitionBy("symbol").orderBy("us"), tables.ticks(spark, d)
    return t.select(
        "event_id", F.count(F.lit(1)).over(w.rangeBetween(-B.DAY, -1)).alias("n24h"), (F.col("us") - F.lag("us").over(w)).alias("since"),
        (F.row_number().over(Window.partitionBy("symbol", F.floor(F.col("us") / B.DAY)).orderBy("us")) == 1).alias("first_of_day"), F.floor(F.col("us") / B.HOUR).alias("hour"),
    ).join(t.groupBy(F.floor(F.col("us") / B.HOUR).alias("hour")).agg(F.count("*").alias("breadth")), "hour").drop("hour")


@query("w17_ranks_in_bucket", f"WITH {EV}, p AS (SELECT *, us // 3600000000 AS hour FROM ev) SELECT event_id, round((rank() OVER w + (count(*) OVER t - 1) / 2.0) / count(*) OVER n, 6) AS pct, row_number() OVER (PARTITION BY hour ORDER BY price DESC, event_id) AS place, round(cume_dist() OVER w, 6) AS share FROM p WINDOW w AS (PARTITION BY hour ORDER BY price), t AS (PARTITION BY hour, price), n AS (PARTITION BY hour)")
def w17(spark, d):
    # an hour of all symbols is a large group: its distinct prices are ranked slice by slice, and rows are only numbered among equal prices
    p = tables.ticks(spark, d).select("event_id", "price", F.floor(F.col("us") / B.HOUR).alias("hour"))
    placed = with_weight_before(p.groupBy("hour", "price").agg(F.count("*").alias("n")), ["hour"], "price", "n")
    x = p.join(placed, ["hour", "price"])
    among = F.row_number().over(Window.partitionBy("hour", "price").orderBy("event_id"))
    place = (F.col("__total") - F.col("__before") - F.col("n") + among).cast("int")
    return rounded(x.select("event_id", ((F.col("__before") + (F.col("n") + 1) / 2.0) / F.col("__total")).alias("pct"), place.alias("place"), ((F.col("__before") + F.col("n")) / F.col("__total")).alias("share")))


@query("w18_quantile_bins", f"WITH {EV}, b AS (SELECT wt, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3 FROM ev WHERE us < 1705363200000000 GROUP BY 1) SELECT wt, 1 + (price > q1)::INT + (price > q2)::INT + (price > q3)::INT AS bin, count(*) AS n FROM ev JOIN b USING (wt) GROUP BY ALL")
def w18(spark, d):
    # bounds come from the development part alone and are frozen; they are a row per kind
    t = tables.ticks(spark, d)
    names = ["q1", "q2", "q3"]
    bounds = quantiles(t.where("us < 1705363200000000"), ["wt"], "price", [0.25, 0.5, 0.75], names)
    above = sum(((F.col("price") > F.col(q)).cast("int") for q in names), F.lit(1))
    return t.join(bounds, "wt").groupBy("wt", above.alias("bin")).agg(F.count("*").alias("n"))


_WAVES = f"WITH {BARS}, m AS (SELECT *, c / nullif(lag(c) OVER w, 0) - 1 AS r FROM bars {_W}), h AS (SELECT *, CASE WHEN slot - lag(slot) OVER w > 4 THEN 1 ELSE 0 END AS new FROM m WHERE abs(r) >= 0.5 {_W}), g AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY slot) AS wave FROM h)"


def waves(spark, d):
    m = bars(spark, d).withColumn("r", B.change("c", "symbol", "slot", 1))
    return D.waves(m, "symbol", "slot", F.abs("r") >= 0.5, 4)


@query("w19_waves", _WAVES + " SELECT symbol, wave::BIGINT AS wave, min(slot) AS start, max(slot) AS \"end\", count(*) AS n, arg_max(slot, abs(r)) AS peak, round(arg_max(r, abs(r)), 6) AS peak_r FROM g GROUP BY ALL")
def w19(spark, d):
    g = waves(spark, d).groupBy("symbol", "wave")
    return rounded(g.agg(F.min("slot").alias("start"), F.max("slot").alias("end"), F.count("*").alias("n"), F.max_by("slot", F.abs("r")).alias("peak"), F.max_by("r", F.abs("r")).alias("peak_r")))


@query("w20_wave_context", _WAVES + ", x AS (SELECT symbol, slot, avg(v) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) / nullif(avg(v) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 15 PRECEDING AND 6 PRECEDING), 0) AS build, lead(c, 4) OVER w / nullif(c, 0) - 1 AS after FROM bars " + _W + ") SELECT symbol, wave::BIGINT AS wave, round(arg_min(build, slot), 6) AS build, round(arg_max(after, slot), 6) AS after FROM g JOIN x USING (symbol, slot) GROUP BY ALL")
def w20(spark, d):
    near, far = B.by_rows("symbol", "slot", -5, -1), B.by_rows("symbol", "slot", -15, -6)
    x = bars(spark, d).withColumns({"r": B.change("c", "symbol", "slot", 1), "build": F.avg("v").over(near) / F.nullif(F.avg("v").over(far), F.lit(0.0)), "after": B.forward("c", "symbol", "slot", 4)})
    g = D.waves(x, "symbol", "slot", F.abs("r") >= 0.5, 4).groupBy("symbol", "wave")
    # like the SQL twin, the first and last value that is there
    return rounded(g.agg(F.min_by("build", F.when(F.col("build").isNotNull(), F.col("slot"))).alias("build"), F.max_by("after", F.when(F.col("after").isNotNull(), F.col("slot"))).alias("after")))


@query("w21_run_lengths", f"WITH {BARS}, m AS (SELECT symbol, slot, coalesce(c > o, false) AS up FROM bars), g AS (SELECT *, sum((NOT up)::INT) OVER w AS grp FROM m {_W}) SELECT symbol, slot, least(sum(up::INT) OVER (PARTITION BY symbol, grp ORDER BY slot), 15)::BIGINT AS run FROM g")
def w21(spark, d):
    return D.run_length(bars(spark, d).select("symbol", "slot", "c", "o"), "symbol", "slot", F.col("c") > F.col("o"), 15).select("symbol", "slot", "run")


@query("w22_greedy_cooldown", f"""WITH {EV}, e AS (SELECT symbol, wt, us FROM ev WHERE k >= 40), l AS (SELECT symbol, wt, list_sort(list(us)) AS t FROM e GROUP BY ALL),
k AS (SELECT symbol, wt, list_reduce(list_transform(t, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] >= 172800000000 THEN list_concat(acc, x) ELSE acc END) AS kept FROM l) SELECT symbol, wt, unnest(kept) AS us FROM k""")
def w22(spark, d):
    return D.cooled_down(tables.ticks(spark, d).where("k >= 40").select("symbol", "wt", "us"), ["symbol", "wt"], "us", 2 * B.DAY)


@query("w23_keep_first_and_last", f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, us // 86400000000 ORDER BY us, event_id) AS a, row_number() OVER (PARTITION BY symbol, us // 86400000000 ORDER BY us DESC, event_id DESC) AS b FROM ev) SELECT symbol, us // 86400000000 AS day, max(event_id) FILTER (a = 1) AS first_id, max(event_id) FILTER (b = 1) AS last_id FROM r GROUP BY ALL")
def w23(spark, d):
    g = tables.ticks(spark, d).groupBy("symbol", F.floor(F.col("us") / B.DAY).alias("day"))
    return g.agg(F.min_by("event_id", F.struct("us", "event_id")).alias("first_id"), F.max_by("event_id", F.struct("us", "event_id")).alias("last_id"))


@query("w25_capacity", f"WITH {EV} SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY us // 21600000000 ORDER BY us, event_id) AS r FROM ev) WHERE r <= 3")
def w25(spark, d):
    return D.first_per(tables.ticks(spark, d).select("event_id", "us", F.floor(F.col("us") / (6 * B.HOUR)).alias("slot")), ["slot"], [F.col("us"), F.col("event_id")], 3).select("event_id")


@query("w26_grid_fill", f"WITH {BARS}, s AS (SELECT symbol, unnest(range(min(slot), max(slot) + 1)) AS slot FROM bars GROUP BY 1) SELECT symbol, slot, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM s LEFT JOIN bars USING (symbol, slot)")
def w26(spark, d):
    return B.on_grid(bars(spark, d), "symbol", "slot", "c", fill=True)


@query("w27_next_open_and_gaps", f"""WITH {BARS}, g AS (SELECT symbol, slot // 4 AS day, arg_min(o, slot) AS o, arg_max(c, slot) AS c, count(*) AS n FROM bars GROUP BY ALL HAVING count(*) >= 2)
SELECT symbol, day, lead(o) OVER w AS next_open, round(o / nullif(lag(c) OVER w, 0) - 1, 6) AS overnight, day - lag(day) OVER w AS gap_days, coalesce(day - lag(day) OVER w >= 3, false) AS long_gap, row_number() OVER w - 1 AS since_first FROM g WINDOW w AS (PARTITION BY symbol ORDER BY day)""")
def w27(spark, d):
    g = bars(spark, d).groupBy("symbol", F.floor(F.col("slot") / 4).alias("day")).agg(F.min_by("o", "slot").alias("o"), F.max_by("c", "slot").alias("c"), F.count("*").alias("n")).where("n >= 2")
    w = Window.partitionBy("symbol").orderBy("day")
    gap = F.col("day") - F.lag("day").over(w)
    return rounded(g.select("symbol", "day", F.lead("o").over(w).alias("next_open"), ret("o", F.lag("c").over(w)).alias("overnight"), gap.alias("gap_days"), F.coalesce(gap >= 3, F.lit(False)).alias("long_gap"), (F.row_number().over(w) - 1).alias("since_first")))


@query("w29_trailing_percentile", f"WITH {EV} SELECT a.event_id, count(b.us) AS n, round(avg((b.price <= a.price)::INT), 6) AS pct, round((any_value(a.price) - avg(b.price)) / nullif(stddev_samp(b.price), 0), 5) AS z FROM ev a LEFT JOIN ev b ON a.symbol = b.symbol AND b.us >= a.us - 604800000000 AND b.us < a.us GROUP BY 1")
def w29(spark, d):
    w = Window.partitionBy("symbol").orderBy("us").rangeBetween(-7 * B.DAY, -1)
    t = tables.ticks(spark, d).select("event_id", "symbol", "us", "price", F.avg("price").over(w).alias("m"), F.stddev_samp("price").over(w).alias("sd"))
    x = with_trailing_rank(t, "event_id", "symbol", "us", "price", 7 * B.DAY)
    return x.select("event_id", "n", F.round(F.try_divide(F.col("below"), F.col("n")), 6).alias("pct"), F.round((F.col("price") - F.col("m")) / F.nullif("sd", F.lit(0.0)), 5).alias("z"))


@query("w30_squeeze_breakout", f"""WITH {BARS}, x AS (SELECT *, stddev_pop(c) OVER b / nullif(avg(c) OVER b, 0) AS band, max(h) OVER b AS top, avg(v) OVER b AS mv, count(*) OVER b AS n FROM bars WINDOW b AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
t AS (SELECT symbol, slot FROM x WHERE n = 10 AND band < 1.0 AND c > top AND v > mv) SELECT symbol, slot FROM (SELECT symbol, slot, slot - lag(slot) OVER w AS d FROM t {_W}) WHERE d IS NULL OR d > 4""")
def w30(spark, d):
    b = B.by_rows("symbol", "slot", -10, -1)
    n = F.count(F.lit(1)).over(b)
    x = bars(spark, d).select("symbol", "slot", "c", "v", (F.stddev_pop("c").over(b) / F.nullif(F.avg("c").over(b), F.lit(0.0))).alias("band"), F.max("h").over(b).alias("top"), F.avg("v").over(b).alias("mv"), n.alias("n"))
    t = D.waves(x, "symbol", "slot", F.expr("n = 10 AND band < 1.0 AND c > top AND v > mv"), 4)
    return t.groupBy("symbol", "wave").agg(F.min("slot").alias("slot")).select("symbol", "slot")


@query("w31_spikes_and_flips", f"WITH {BARS}, f AS (SELECT symbol, slot, v / nullif(lag(v) OVER w, 0) - 1.0 AS dv, c - o AS x, lag(c - o) OVER w AS y FROM bars {_W}) SELECT symbol, slot, coalesce(dv >= 1.5, false) AS spike, coalesce(x * y < 0, false) AS flip FROM f WHERE dv >= 1.5 OR x * y < 0")
def w31(spark, d):
    x = F.col("c") - F.col("o")
    f = bars(spark, d).select("symbol", "slot", (F.col("v") / F.nullif(F.lag("v").over(_by()), F.lit(0)) - 1).alias("dv"), (x * F.lag(x).over(_by())).alias("xy"))
    return f.where("dv >= 1.5 OR xy < 0").select("symbol", "slot", F.coalesce(F.col("dv") >= 1.5, F.lit(False)).alias("spike"), F.coalesce(F.col("xy") < 0, F.lit(False)).alias("flip"))


@query("w32_squeeze_trigger", f"WITH {BARS}, r AS (SELECT symbol, slot, c / nullif(lag(c, 5) OVER w, 0) - 1 AS r5 FROM bars {_W}), q AS (SELECT symbol, us // 21600000000 AS slot, max(k) AS k FROM ev WHERE wt = 'view' GROUP BY ALL) SELECT r.symbol, r.slot, CASE WHEN k >= 80 THEN 'long' ELSE 'short' END AS side FROM r ASOF LEFT JOIN q ON r.symbol = q.symbol AND r.slot >= q.slot WHERE (k >= 80 AND r5 <= -0.3) OR (k <= 20 AND r5 >= 0.3)")
def w32(spark, d):
    r = bars(spark, d).select("symbol", "slot", B.change("c", "symbol", "slot", 5).alias("r5"))
    q = tables.ticks(spark, d).where("wt = 'view'").groupBy("symbol", F.floor(F.col("us") / (6 * B.HOUR)).alias("slot")).agg(F.max("k").alias("k"))
    return asof(r, q, "symbol", "slot", ["k"]).where("(k >= 80 AND r5 <= -0.3) OR (k <= 20 AND r5 >= 0.3)").select("symbol", "slot", F.when(F.col("k") >= 80, "long").otherwise("short").alias("side"))


@query("w33_rolling_event_counts", f"WITH {BARS}, b AS (SELECT symbol, us // 21600000000 AS slot, count(*) AS n FROM ev WHERE wt = 'error' GROUP BY ALL) SELECT symbol, slot, sum(coalesce(n, 0)) OVER (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS n5 FROM bars LEFT JOIN b USING (symbol, slot)")
def w33(spark, d):
    # errors are counted in the pass that makes the bars, so no join is needed
    n = tables.ticks(spark, d).groupBy("symbol", F.floor(F.col("us") / (6 * B.HOUR)).alias("slot")).agg(F.count_if(F.col("wt") == "error").alias("n"))
    return n.select("symbol", "slot", F.sum("n").over(B.by_rows("symbol", "slot", -4, 0)).alias("n5"))


@query("w34_non_overlapping", f"WITH {BARS} SELECT symbol, slot FROM (SELECT symbol, slot, row_number() OVER w - 1 AS i FROM bars {_W}) WHERE i % 5 = 0")
def w34(spark, d):
    return bars(spark, d).select("symbol", "slot", (F.row_number().over(_by()) - 1).alias("i")).where("i % 5 = 0").select("symbol", "slot")


@query("w35_regime", f"WITH {BARS}, m AS (SELECT slot, avg(c) AS c FROM bars GROUP BY 1), r AS (SELECT slot, CASE WHEN c / nullif(lag(c, 4) OVER (ORDER BY slot), 0) - 1 > 0.05 THEN 2 WHEN c / nullif(lag(c, 4) OVER (ORDER BY slot), 0) - 1 < -0.05 THEN 0 ELSE 1 END AS regime FROM m) SELECT event_id, regime FROM (SELECT event_id, us // 21600000000 - 1 AS slot FROM ev) e ASOF LEFT JOIN r ON e.slot >= r.slot")
def w35(spark, d):
    # the market is a row per slot; events look up the last slot that had ended
    m = bars(spark, d).groupBy("slot").agg(F.avg("c").alias("c"))
    chg = ret("c", F.lag("c", 4).over(Window.orderBy("slot")))
    r = m.select(F.lit(0).alias("all"), "slot", F.when(chg > 0.05, 2).when(chg < -0.05, 0).otherwise(1).alias("regime"))
    e = tables.ticks(spark, d).select("event_id", (F.floor(F.col("us") / (6 * B.HOUR)) - 1).alias("slot"))
    slots = asof(e.select(F.lit(0).alias("all"), "slot").distinct(), r, "all", "slot", ["regime"]).select("slot", "regime")
    return e.join(slots, "slot").select("event_id", "regime")


@query("w36_entry_lag_stress", f"WITH {BARS}, l AS (SELECT symbol, slot, {', '.join(f'lead(c, {k + 4}) OVER w / nullif(lead(c, {k}) OVER w, 0) - 1 AS r{k}' for k in (0, 1, 2, 5))} FROM bars {_W}), v AS (SELECT * FROM l WHERE r5 IS NOT NULL), u AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, r{k} AS r FROM v" for k in (0, 1, 2, 5)) + ") SELECT lag, count(*) AS n, round(avg(r), 6) AS mean FROM u GROUP BY 1")
def w36(spark, d):
    lags = (0, 1, 2, 5)
    at = lambda k: F.lead("c", k).over(_by()) if k else F.col("c")
    v = bars(spark, d).select(*(ret(at(k + 4), at(k)).alias(f"r{k}") for k in lags)).where("r5 IS NOT NULL")
    long = v.select(F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in lags))).alias("x")).select("x.*")
    return rounded(long.groupBy("lag").agg(F.count("*").alias("n"), F.avg("r").alias("mean")))


@query("w37_median_split", f"WITH {BARS}, m AS (SELECT slot, median(v) AS mid FROM bars GROUP BY 1) SELECT v >= mid AS high, count(*) AS n, round(avg(c/ nullif(o, 0) - 1), 6) AS mean FROM bars JOIN m USING (slot) GROUP BY 1")
def w37(spark, d):
    b = bars(spark, d)
    m = quantiles(b, ["slot"], "v", [0.5], ["mid"])
    return rounded(b.join(m, "slot").groupBy((F.col("v") >= F.col("mid")).alias("high")).agg(F.count("*").alias("n"), F.avg(ret("c", "o")).alias("mean")))


_PATH = f"WITH {BARS}, r AS (SELECT *, row_number() OVER w AS i FROM bars {_W}), p AS (SELECT a.symbol, a.slot AS entry, a.c AS px, b.i - a.i AS off, b.h, b.l, b.c FROM r a JOIN r b ON a.symbol = b.symbol AND b.i > a.i AND b.i <= a.i + 12 WHERE a.trades >= 2)"


def paths(spark, d):
    return O.paths(bars(spark, d), "symbol", "slot", 12, F.col("trades") >= 2)


@query("w38_first_touch", _PATH + """, m AS (SELECT symbol, entry, min(off) FILTER (h / nullif(px, 0) - 1 >= 0.5) AS t, min(off) FILTER (1 - l / nullif(px, 0) >= 0.3) AS s, arg_max(c / nullif(px, 0) - 1, off) AS e, max(off) AS n FROM p GROUP BY ALL)
SELECT symbol, entry, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN 'stop' WHEN t IS NOT NULL THEN 'take' ELSE 'time' END AS status, (CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN s WHEN t IS NOT NULL THEN t ELSE n END)::INT AS held,
round(CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN -0.3 WHEN t IS NOT NULL THEN 0.5 ELSE e END, 6) AS result FROM m""")
def w38(spark, d):
    return rounded(O.first_touch(paths(spark, d), "symbol", 0.5, 0.3))


_BEST = ", b AS (SELECT *, c / nullif(px, 0) - 1 AS now, max(h / nullif(px, 0) - 1) OVER (PARTITION BY symbol, entry ORDER BY off) AS best FROM p)"


@query("w39_trailing_giveback", _PATH + _BEST + ", x AS (SELECT *, CASE WHEN now <= -0.4 THEN 'stop' WHEN best >= 0.3 AND now <= best * (1 - 0.25) THEN 'trail' WHEN off = 12 THEN 'time' END AS why FROM b) SELECT symbol, entry, arg_min(why, off) AS status, min(off)::INT AS held, round(arg_min(now, off), 6) AS result FROM x WHERE why IS NOT NULL GROUP BY ALL")
def w39(spark, d):
    return rounded(O.trailing(paths(spark, d), "symbol", 0.3, 0.25, 0.4, 12))


@query("w40_tiered_trailing", _PATH + _BEST + """, f AS (SELECT *, best * (1 - CASE WHEN best >= 1.0 THEN 0.15 WHEN best >= 0.5 THEN 0.25 WHEN best >= 0.2 THEN 0.4 END) AS fl FROM b),
x AS (SELECT *, CASE WHEN off = 12 THEN 'time' WHEN now <= -0.35 THEN 'stop' WHEN fl IS NOT NULL AND now <= fl AND off > 1 AND h - l > 0 THEN 'trail' END AS why FROM f)
SELECT symbol, entry, arg_min(why, off) AS status, min(off)::INT AS held, round(arg_min(CASE WHEN why = 'trail' THEN fl ELSE now END, off), 6) AS result FROM x WHERE why IS NOT NULL GROUP BY ALL""")
def w40(spark, d):
    return rounded(O.tiered(paths(spark, d), "symbol", [(0.2, 0.4), (0.5, 0.25), (1.0, 0.15)], F.lit(0.35), F.col("h") - F.col("l") > 0, 1, 12))


_EXT = f"WITH {BARS}, x AS (SELECT lead(c, 8) OVER w / nullif(c, 0) - 1 AS f, max(h) OVER a / nullif(c, 0) - 1 AS mfe, min(l) OVER a / nullif(c, 0) - 1 AS mae FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot), a AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING))"


@query("w41_bracket_bounds", _EXT + " SELECT count(*) AS n, round(avg(CASE WHEN mae <= -0.5 THEN -0.5 WHEN mfe >= 1.0 THEN 1.0 ELSE f END), 6) AS worst, round(avg(CASE WHEN mfe >= 1.0 THEN 1.0 WHEN mae <= -0.5 THEN -0.5 ELSE f END), 6) AS best, round(avg(CASE WHEN mfe >= 0.8 THEN 0.8 ELSE f END), 6) AS locked FROM x WHERE f IS NOT NULL")
def w41(spark, d):
    mfe, mae = B.excursions("symbol", "slot", 8)
    x = bars(spark, d).select(B.forward("c", "symbol", "slot", 8).alias("f"), mfe.alias("mfe"), mae.alias("mae")).where("f IS NOT NULL")
    both = [F.avg(O.bracket(F.col("mfe"), F.col("mae"), F.col("f"), 1.0, 0.5, w)) for w in (True, False)]
    return rounded(x.agg(F.count("*").alias("n"), both[0].alias("worst"), both[1].alias("best"), F.avg(F.when(F.col("mfe") >= 0.8, 0.8).otherwise(F.col("f"))).alias("locked")))


@query("w43_rule_entries", f"WITH {BARS}, x AS (SELECT symbol, slot, c / nullif(lag(c) OVER w, 0) - 1 AS r1, c > max(h) OVER a AS brk, v / nullif(lag(v) OVER w, 0)::DOUBLE AS vr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot), a AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT symbol, slot, 'burst' AS rule FROM x WHERE r1 >= 1 AND coalesce(vr >= 1, true) UNION ALL SELECT symbol, slot, 'breakout' FROM x WHERE brk AND coalesce(vr >= 1, true) UNION ALL SELECT symbol, slot, 'crash' FROM x WHERE r1 <= -0.7")
def w43(spark, d):
    x = bars(spark, d).select("symbol", "slot", B.change("c", "symbol", "slot", 1).alias("r1"), (F.col("c") > F.max("h").over(B.by_rows("symbol", "slot", -10, -1))).alias("brk"), (F.col("v") / F.nullif(F.lag("v").over(_by()), F.lit(0))).alias("vr"))
    busy = F.coalesce(F.col("vr") >= 1, F.lit(True))
    rules = {"burst": (F.col("r1") >= 1) & busy, "breakout": F.col("brk") & busy, "crash": F.col("r1") <= -0.7}
    return x.select("symbol", "slot", F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda r: r.isNotNull())).alias("rule"))


@query("w45_event_path_mean", f"WITH {BARS}, r AS (SELECT *, row_number() OVER w AS i, c/ nullif(o, 0) - 1 AS ret FROM bars {_W}), p AS (SELECT b.i - a.i AS off, avg(b.ret) AS m FROM r a JOIN r b ON a.symbol = b.symbol AND b.i BETWEEN a.i AND a.i + 5 WHERE a.trades >= 3 GROUP BY 1) SELECT off, round(m, 6) AS mean, round(sum(m) OVER (ORDER BY off), 6) AS path FROM p")
def w45(spark, d):
    w = B.by_rows("symbol", "slot", 0, 5)
    hits = bars(spark, d).withColumn("ret", ret("c", "o")).withColumn("p", F.collect_list(F.struct("ret")).over(w)).where("trades >= 3")
    m = hits.select(F.posexplode("p").alias("off", "x")).groupBy("off").agg(F.avg("x.ret").alias("m"))
    return rounded(m.select("off", F.col("m").alias("mean"), F.sum("m").over(Window.orderBy("off")).alias("path")))  # six rows


@query("w46_named_anchor_legs", f"WITH {BARS}, g AS (SELECT symbol, slot // 28 AS week, max(c) FILTER (slot % 28 < 4) AS a, max(c) FILTER (slot % 28 BETWEEN 8 AND 11) AS b, max(c) FILTER (slot % 28 BETWEEN 20 AND 23) AS c FROM bars GROUP BY ALL) SELECT symbol, week, round(b / nullif(a, 0) - 1, 6) AS leg1, round(c/ nullif(b, 0) - 1, 6) AS leg2, round(c/ nullif(a, 0) - 1, 6) AS whole FROM g")
def w46(spark, d):
    part = F.col("slot") % 28
    anchors = {"a": part < 4, "b": part.between(8, 11), "x": part.between(20, 23)}
    g = bars(spark, d).groupBy("symbol", F.floor(F.col("slot") / 28).alias("week")).agg(*(F.max(F.when(when, F.col("c"))).alias(n) for n, when in anchors.items()))
    return rounded(g.select("symbol", "week", (ret("b", "a")).alias("leg1"), (ret("x", "b")).alias("leg2"), (ret("x", "a")).alias("whole")))


@query("w47_horizon_table", f"WITH {PANEL}, h AS (SELECT event_id, symbol, us, price, unnest([1, 2, 4]) AS days FROM panel WHERE wt = 'purchase'), t AS (SELECT *, us + days * 86400000000 AS target FROM h) SELECT t.event_id, days, round(x.price / nullif(t.price, 0) - 1, 6) AS ret FROM t ASOF LEFT JOIN ev x ON t.symbol = x.symbol AND t.target <= x.us")
def w47(spark, d):
    t = tables.ticks(spark, d)
    e = t.where("wt = 'purchase'").select("event_id", "symbol", F.col("price").alias("px"), "us", F.explode(F.array(*map(F.lit, (1, 2, 4)))).alias("days"))
    e = e.withColumn("us", F.col("us") + F.col("days") * B.DAY)
    return rounded(first_after(e, t.select("symbol", "us", "price"), "symbol", "us", ["price"]).select("event_id", "days", (ret("price", "px")).alias("ret")))
