"""Queries over single steps that others also have inside them: sinks, casts, labels, costs, indicators, cooldowns and callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import stats
from ..operators import bars as B
from ..operators.asof import asof
from ..sources import merge, tables
from ..streaming import runs as R
from .aggregates import _CELLS, P1, cells, returns
from .joins import _SIDES, sides
from .panels import bars, panel, rounded
from .registry import BARS, EV, PANEL, query
from .streams import _CLOSED, stream

_BY = "WINDOW w AS (PARTITION BY symbol ORDER BY slot)"


@query("s03_bad_rows", "SELECT event_id, substr(props, 1, 4) AS line FROM events WHERE event_id % 7 = 0")
def s03(spark, d):
    lines = tables.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("line"))
    return tables.parsed_lines(lines, "line", "k INT").where("parse_status = 'bad'").select("event_id", "line")


@query("s04_files_by_suffix", "SELECT unnest(['csv', 'json', 'parquet']) AS suffix, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders")
def s04(spark, d):
    folder, o = R.shared_folder(spark), tables.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    parts = []
    for suffix in ("csv", "json", "parquet"):
        o.write.option("header", True).format(suffix).save(f"{folder}/orders.{suffix}")
        read = tables.read(spark, folder, f"orders.{suffix}")
        parts.append(read.agg(F.lit(suffix).alias("suffix"), F.count("*").alias("n"), F.sum(F.col("o_custkey").cast("long")).alias("keys")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s06_optional_table", "SELECT c_custkey, c_acctbal, NULL::DOUBLE AS rating FROM customer")
def s06(spark, d):
    ratings = tables.optional(spark, d, "ratings", "c_custkey long, rating double")
    return tables.read(spark, d, "customer").select("c_custkey", "c_acctbal").join(ratings, "c_custkey", "left")


_JOINED = f"WITH {_SIDES}, j AS (SELECT event_id, q.us AS known_at, price, k FROM e ASOF LEFT JOIN q ON e.symbol = q.symbol AND e.us >= q.us)"


@query("s13_registered_features", _JOINED + " SELECT 'event_id' AS feature, 'bigint' AS type, count(event_id) AS filled FROM j UNION ALL SELECT 'known_at', 'bigint', count(known_at) FROM j UNION ALL SELECT 'price', 'double', count(price) FROM j UNION ALL SELECT 'k', 'int', count(k) FROM j")
def s13(spark, d):
    e, q = sides(spark, d)
    folder = R.shared_folder(spark)
    merge.write_registered(asof(e, q, "symbol", "us", ["price", "k"]), f"{folder}/features", f"{folder}/registry", ["symbol", "us"])
    # the registry names what the table is asked for
    registry, table = spark.read.schema("feature string, type string").json(f"{folder}/registry"), spark.read.parquet(f"{folder}/features")
    filled = table.agg(*(F.count(c).alias(c) for c in table.columns)).unpivot([], table.columns, "feature", "filled")
    return registry.join(filled, "feature")


@query("s15_result_sinks", "WITH g AS (SELECT event_type AS wt, round(avg(value) / 100, 6) AS p FROM events GROUP BY 1) SELECT 'csv' AS kind, * FROM g UNION ALL SELECT 'json', * FROM g")
def s15(spark, d):
    g = tables.read(spark, d, "events").groupBy(F.col("event_type").alias("wt")).agg(F.round(F.avg("value") / 100, 6).alias("p"))
    folder, parts = R.shared_folder(spark), []
    for kind in ("csv", "json"):
        merge.write_results(g, f"{folder}/{kind}", "p", kind)
        parts.append(spark.read.schema(g.schema).option("header", True).format(kind).load(f"{folder}/{kind}").select(F.lit(kind).alias("kind"), "wt", "p"))
    return parts[0].unionByName(parts[1])


@query("s16_daily_append", f"WITH {EV} SELECT strftime(make_timestamp(us), '%Y-%m-%d') AS dt, count(*) AS n, sum(k)::BIGINT AS k FROM ev GROUP BY 1")
def s16(spark, d):
    t, folder = tables.ticks(spark, d).select("event_id", "us", "k"), f"{R.shared_folder(spark)}/alerts"
    for half in (0, 1):
        merge.append_daily(t.where(F.col("event_id") % 2 == half), folder, "us")
    rows = spark.read.schema("event_id long, us long, k int, dt string").json(folder)
    return rows.groupBy("dt").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("s21_dated_snapshots", f"WITH {EV} SELECT 'n' || (symbol % 3)::VARCHAR AS name, strftime(make_timestamp(us), '%Y-%m-%d') AS dt, CASE WHEN symbol % 3 = 0 THEN 2 ELSE 1 END AS version, count(*) AS n FROM ev GROUP BY ALL")
def s21(spark, d):
    # the second run holds only some of the names, and replaces their days alone
    t = tables.ticks(spark, d).select("event_id", F.concat(F.lit("n"), (F.col("symbol") % 3).cast("string")).alias("name"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("dt"))
    folder = f"{R.shared_folder(spark)}/documents"
    merge.write_snapshot(t.withColumn("version", F.lit(1)), folder, ["name", "dt"])
    merge.write_snapshot(t.where("name = 'n0'").withColumn("version", F.lit(2)), folder, ["name", "dt"])
    return spark.read.schema("event_id long, version int, name string, dt string").parquet(folder).groupBy("name", "dt", "version").agg(F.count("*").alias("n"))


@query("p02_swap_symbols", "WITH s AS (SELECT p_partkey, upper(replace(p_brand, '#', '')) || CASE WHEN p_partkey % 3 = 0 THEN '-USD-SWAP' ELSE '-USDT-SWAP' END AS inst FROM part) SELECT p_partkey, CASE WHEN inst LIKE '%-USDT-SWAP' THEN split_part(inst, '-', 1) || 'USDT' END AS symbol FROM s")
def p02(spark, d):
    inst = F.concat(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))), F.when(F.col("p_partkey") % 3 == 0, "-USD-SWAP").otherwise("-USDT-SWAP"))
    return tables.read(spark, d, "part").select("p_partkey", S.swap_symbol(inst).alias("symbol"))


@query("p04_detected_columns", "SELECT event_id, epoch_us(ts) AS us, value AS px FROM events")
def p04(spark, d):
    e = tables.read(spark, d, "events")
    at, px = tables.column_of(e, ("timestamp", "time", "ts")), tables.column_of(e, ("price", "close", "value"))
    return e.select("event_id", tables.micros(at).alias("us"), F.col(px).alias("px"))


@query("p07_safe_casts", "WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' || value::VARCHAR || ' ' WHEN 2 THEN 'n/a' ELSE (event_id % 100)::VARCHAR END AS v FROM events) SELECT event_id, TRY_CAST(trim(v) AS DOUBLE) AS number, coalesce(TRY_CAST(trim(v) AS DOUBLE), 0) AS filled FROM s")
def p07(spark, d):
    i = F.col("event_id") % 5
    v = F.when(i == 0, "").when(i == 1, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).when(i == 2, "n/a").otherwise((F.col("event_id") % 100).cast("string"))
    return tables.read(spark, d, "events").select("event_id", S.number(v).alias("number"), S.number(v, F.lit(0.0)).alias("filled"))


@query("p13_calendar_parts", "SELECT o_orderkey, (isodow(o_orderdate) - 1)::INT AS weekday, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%G-W%V') AS iso_week FROM orders")
def p13(spark, d):
    week = F.concat(F.expr("extract(YEAROFWEEK FROM o_orderdate)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"))
    return tables.read(spark, d, "orders").select("o_orderkey", F.weekday("o_orderdate").alias("weekday"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), week.alias("iso_week"))


#: New Year's Day and Martin Luther King Day of the tables' month, on which the exchange is closed.
HOLIDAYS = ("2024-01-01", "2024-01-15")


@query("p15_session_labels", f"""WITH e AS (SELECT value, hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) AS m, isodow(ts - INTERVAL 5 HOUR) - 1 AS w, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') IN {HOLIDAYS} AS off FROM events),
s AS (SELECT value, CASE WHEN off OR w >= 5 THEN 'weekend' WHEN m >= 570 AND m < 960 THEN 'rth' WHEN m >= 960 AND m < 1320 THEN 'afterhours' WHEN w = 4 AND m >= 1320 THEN 'weekend' WHEN w = 0 AND m < 240 THEN 'weekend' ELSE 'overnight' END AS session FROM e) SELECT session, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY 1""")
def p15(spark, d):
    # all events lie in January, when New York is five hours behind; holidays come as a table, a row per day
    at = F.col("ts").cast("timestamp")
    off = spark.createDataFrame([(h,) for h in HOLIDAYS], "day string").select(F.to_date("day").alias("day"), F.lit(True).alias("off"))
    e = tables.read(spark, d, "events").select("value", at.alias("at"), F.to_date(F.from_utc_timestamp(at, "America/New_York")).alias("day")).join(F.broadcast(off), "day", "left")
    e = e.select("value", S.session(F.col("at"), F.coalesce("off", F.lit(False))).alias("session"))
    return rounded(e.groupBy("session").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("p19_net_by_side", f"WITH {PANEL} SELECT event_id, round(CASE WHEN wt = 'error' THEN -1 ELSE 1 END * f1 * 100 - 0.14, 6) AS net FROM panel WHERE f1 IS NOT NULL")
def p19(spark, d):
    side = F.when(F.col("wt") == "error", -1).otherwise(1)
    return rounded(panel(spark, d).where("f1 IS NOT NULL").select("event_id", S.net(F.col("f1") * 100, F.lit(0.14), side).alias("net")))


@query("p21_fill_prices", f"WITH {EV} SELECT event_id, round(price * (1 + k / 10000.0), 6) AS long_in, round(price * (1 - k / 10000.0), 6) AS long_out, round(price * (1 - k / 10000.0), 6) AS short_in, round(price * (1 + k / 10000.0), 6) AS short_out FROM ev")
def p21(spark, d):
    px, half = F.col("price"), F.col("k") / 10000.0
    legs = {f"{name}_{leg}": S.filled(px, half, side, leg == "in") for name, side in (("long", 1), ("short", -1)) for leg in ("in", "out")}
    return rounded(tables.ticks(spark, d).select("event_id", *(v.alias(n) for n, v in legs.items())))


@query("p26_alert_messages", f"WITH {PANEL} SELECT event_id, concat_ws(' | ', '#' || symbol::VARCHAR, upper(wt), CASE WHEN f1 IS NOT NULL THEN 'moved ' || floor(f1 * 100)::BIGINT::VARCHAR || '%' END, CASE WHEN k > 50 THEN 'k=' || k::VARCHAR END) AS message FROM panel")
def p26(spark, d):
    moved = F.when(F.col("f1").isNotNull(), F.concat(F.lit("moved "), F.floor(F.col("f1") * 100).cast("string"), F.lit("%")))
    message = F.concat_ws(" | ", F.concat(F.lit("#"), F.col("symbol").cast("string")), F.upper("wt"), moved, F.when(F.col("k") > 50, F.concat(F.lit("k="), F.col("k").cast("string"))))
    return panel(spark, d).select("event_id", message.alias("message"))


@query("p29_freshness_tiers", f"WITH {_SIDES}, j AS (SELECT event_id, e.us - q.us AS age FROM e ASOF LEFT JOIN q ON e.symbol = q.symbol AND e.us >= q.us) SELECT event_id, CASE WHEN age IS NULL THEN 'missing' WHEN age <= 28800000000 THEN 'strong' WHEN age <= 43200000000 THEN 'weak' ELSE 'stale' END AS tier FROM j")
def p29(spark, d):
    e, q = sides(spark, d)
    age = F.col("us") - F.col("known_at")
    return asof(e, q, "symbol", "us", ["price"]).select("event_id", S.freshness(age, 8 * B.HOUR, 12 * B.HOUR).alias("tier"))


@query("p31_taker_share", f"WITH {BARS} SELECT symbol, slot, round(coalesce(taker_v::DOUBLE / nullif(v, 0), 0.5), 6) AS share, round(abs(coalesce(taker_v::DOUBLE / nullif(v, 0), 0.5) - 0.5) * 2, 6) AS divergence FROM bars")
def p31(spark, d):
    share = S.ratio(F.col("taker_v"), F.col("v"), 0.5)
    return rounded(bars(spark, d).select("symbol", "slot", share.alias("share"), S.divergence(share).alias("divergence")))


@query("p37_mid_and_spread", f"WITH {BARS}, m AS (SELECT symbol, slot, l, h, CASE WHEN l <> 0 AND h <> 0 THEN (l + h) / 2 ELSE 0 END AS mid FROM bars) SELECT symbol, slot, round(mid, 6) AS mid, round(coalesce((h - l) / nullif(mid, 0) * 10000, 0), 4) AS spread FROM m")
def p37(spark, d):
    bid, ask = F.col("l"), F.col("h")
    return bars(spark, d).select("symbol", "slot", F.round(S.mid_price(bid, ask), 6).alias("mid"), F.round(S.spread_bp(bid, ask), 4).alias("spread"))


@query("a07_step_up_flags", _CELLS + ", l AS (SELECT *, unnest([0.1, 0.5]) AS level FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY wt, level ORDER BY pv, tier) AS r, count(*) OVER (PARTITION BY wt, level) AS m FROM l) SELECT wt, tier, level::DOUBLE AS level, coalesce(r <= max(CASE WHEN pv <= r * level / m THEN r END) OVER (PARTITION BY wt, level), false) AS pass FROM r")
def a07(spark, d):
    c = cells(spark, d)
    flags = [stats.bh(c, "pv", ["wt"], level, ["tier"]).select("wt", "tier", F.lit(level).alias("level"), "pass") for level in (0.1, 0.5)]
    return flags[0].unionByName(flags[1])


@query("a42_coverage_ratios", f"WITH {PANEL} SELECT wt, count(*) AS n, {', '.join(f'round(count({c})::DOUBLE / count(*), 6) AS {c}' for c in ('price', 'k', 'f1', 'f3'))} FROM panel GROUP BY 1")
def a42(spark, d):
    share = [(F.count(c) / F.count("*")).alias(c) for c in ("price", "k", "f1", "f3")]
    return rounded(panel(spark, d).groupBy("wt").agg(F.count("*").alias("n"), *share))


@query("w07_distance_to_extremes", f"WITH {BARS} SELECT symbol, slot, round(c / nullif(max(h) OVER b, 0) - 1, 6) AS from_high, round(c / nullif(min(l) OVER b, 0) - 1, 6) AS from_low FROM bars WINDOW b AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def w07(spark, d):
    day = B.by_rows("symbol", "slot", -4, 0)
    return rounded(bars(spark, d).select("symbol", "slot", S.ret("c", F.max("h").over(day)).alias("from_high"), S.ret("c", F.min("l").over(day)).alias("from_low")))


@query("w09_rsi", f"""WITH {BARS}, t AS (SELECT *, c - lag(c) OVER w AS d FROM bars {_BY})
SELECT symbol, slot, round(CASE WHEN count(d) OVER a < 14 THEN 50 WHEN sum(greatest(-d, 0)) OVER a = 0 THEN 100 ELSE 100 - 100 / (1 + sum(greatest(d, 0)) OVER a / nullif(sum(greatest(-d, 0)) OVER a, 0)) END, 5) AS rsi FROM t WINDOW a AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def w09(spark, d):
    return B.with_rsi(bars(spark, d), "symbol", "slot", 14).select("symbol", "slot", F.round("rsi", 5).alias("rsi"))


@query("w14_excursions", f"WITH {BARS} SELECT symbol, slot, round(max(h) OVER a / nullif(c, 0) - 1, 6) AS mfe, round(min(l) OVER a / nullif(c, 0) - 1, 6) AS mae FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)")
def w14(spark, d):
    mfe, mae = B.excursions("symbol", "slot", 6)
    return rounded(bars(spark, d).select("symbol", "slot", mfe.alias("mfe"), mae.alias("mae")))


@query("w16_since_previous", f"WITH {EV} SELECT event_id, (us - lag(us) OVER w) // 60000000 AS minutes, row_number() OVER (PARTITION BY symbol, us // 86400000000 ORDER BY us, event_id) = 1 AS first_of_day FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY us, event_id)")
def w16(spark, d):
    w, day = Window.partitionBy("symbol").orderBy("us", "event_id"), Window.partitionBy("symbol", F.floor(F.col("us") / B.DAY)).orderBy("us", "event_id")
    return tables.ticks(spark, d).select("event_id", F.floor((F.col("us") - F.lag("us").over(w)) / B.MINUTE).alias("minutes"), (F.row_number().over(day) == 1).alias("first_of_day"))


@query("w24_keep_last", f"WITH {EV} SELECT symbol, wt, event_id, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, wt ORDER BY us DESC, event_id DESC) AS r FROM ev) WHERE r = 1")
def w24(spark, d):
    last = F.max_by(F.struct("event_id", "price"), F.struct("us", "event_id")).alias("x")
    return tables.ticks(spark, d).groupBy("symbol", "wt").agg(last).select("symbol", "wt", "x.*")


@query("w28_gap_days", f"""WITH {BARS}, g AS (SELECT symbol, slot // 4 AS day, arg_min(o, slot) AS o, arg_max(c, slot) AS c FROM bars GROUP BY ALL HAVING count(*) >= 2)
SELECT symbol, day, lag(c) OVER w AS before, round(o / nullif(lag(c) OVER w, 0) - 1, 6) AS overnight, day - lag(day) OVER w AS gap_days FROM g WINDOW w AS (PARTITION BY symbol ORDER BY day)""")
def w28(spark, d):
    # sessions with too few bars are no sessions: what is before is the last valid one
    g = bars(spark, d).groupBy("symbol", F.floor(F.col("slot") / 4).alias("day")).agg(F.min_by("o", "slot").alias("o"), F.max_by("c", "slot").alias("c"), F.count("*").alias("n")).where("n >= 2")
    w = Window.partitionBy("symbol").orderBy("day")
    return g.select("symbol", "day", F.lag("c").over(w).alias("before"), F.round(S.ret("o", F.lag("c").over(w)), 6).alias("overnight"), (F.col("day") - F.lag("day").over(w)).alias("gap_days"))


@query("t06_close_lag", f"WITH {EV} SELECT symbol, us // 21600000000 * 21600000000 AS start, count(*) AS trades FROM ev GROUP BY symbol, us // 21600000000 HAVING us // 21600000000 * 21600000000 + 21600000000 <= {_CLOSED.replace('7200000000', '43200000000')}")
def t06(spark, d):
    # a bar counts as closed once the newest tick is twelve hours past its end
    return R.drain(R.tumbling_bars(stream(spark, d), "6 hours", "12 hours")).select("symbol", "start", "trades")


def evaluated(p: DataFrame, keep: Column | None) -> DataFrame:
    """n and mean of the returns that a filter, given as a column, lets through."""
    own = F.col("f1") if keep is None else F.when(keep, F.col("f1"))
    return p.agg(F.count(own).alias("n"), F.avg(own).alias("mean"))


@query("f03_row_filters", f"WITH {P1} SELECT 'all' AS filter, count(*) AS n, round(avg(f1), 6) AS mean FROM p UNION ALL SELECT 'strong', count(*), round(avg(f1), 6) FROM p WHERE k >= 70 UNION ALL SELECT 'night', count(*), round(avg(f1), 6) FROM p WHERE us % 86400000000 < 21600000000")
def f03(spark, d):
    filters = {"all": None, "strong": F.col("k") >= 70, "night": F.col("us") % B.DAY < 6 * B.HOUR}
    parts = [evaluated(returns(spark, d), keep).select(F.lit(n).alias("filter"), "n", F.round("mean", 6).alias("mean")) for n, keep in filters.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def builder(side: int, least: int, horizon: str) -> Callable[[DataFrame], DataFrame]:
    """A cell's way to make its trades from the panel."""

    def build(p: DataFrame) -> DataFrame:
        return p.where((F.col("k") >= least) & F.col(horizon).isNotNull()).select("wt", (side * F.col(horizon) - 0.001).alias("r"))

    return build


@query("f04_trade_builders", f"WITH {PANEL} SELECT 'long1' AS cell, wt, count(*) AS n, round(avg(f1 - 0.001), 6) AS mean FROM panel WHERE k >= 20 AND f1 IS NOT NULL GROUP BY wt UNION ALL SELECT 'short3', wt, count(*), round(avg(-f3 - 0.001), 6) FROM panel WHERE k >= 60 AND f3 IS NOT NULL GROUP BY wt")
def f04(spark, d):
    p, specs = panel(spark, d), {"long1": builder(1, 20, "f1"), "short3": builder(-1, 60, "f3")}
    trades = [build(p).withColumn("cell", F.lit(n)) for n, build in specs.items()]
    return rounded(trades[0].unionByName(trades[1]).groupBy("cell", "wt").agg(F.count("*").alias("n"), F.avg("r").alias("mean")))


@query("f06_cell_statistics", f"WITH {P1}, g AS (SELECT wt, day, sum(f1) AS s, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT wt, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS rest FROM g WINDOW w AS (PARTITION BY wt)), o AS (SELECT wt, min(rest) AS worst FROM r GROUP BY 1) SELECT wt, count(*) AS n, round(avg(f1) / nullif(stddev_samp(f1) / sqrt(count(*)), 0), 5) AS t, round(any_value(worst), 5) AS worst_day_out FROM p JOIN o USING (wt) GROUP BY 1")
def f06(spark, d):
    p = returns(spark, d)
    out = stats.leave_one_out(p, ["wt"], "day", "f1").select("wt", F.col("worst_mean").alias("worst_day_out"))
    return rounded(p.groupBy("wt").agg(F.count("*").alias("n"), stats.one_sample_t("f1").alias("t")).join(out, "wt"), 5)


@query("f07_payload_rows", f"WITH {EV} SELECT symbol, us // 86400000000 AS day, (row_number() OVER (PARTITION BY symbol, us // 86400000000 ORDER BY us, event_id) - 1)::INT AS place, event_id, k FROM ev WHERE k % 2 = 0")
def f07(spark, d):
    # one payload a symbol and day; its entries become rows, with their places
    t = tables.ticks(spark, d).where("k % 2 = 0")
    payload = F.to_json(F.array_sort(F.collect_list(F.struct("us", "event_id", "k")))).alias("j")
    docs = t.groupBy("symbol", F.floor(F.col("us") / B.DAY).alias("day")).agg(payload)
    entries = F.from_json("j", "array<struct<us:long,event_id:long,k:int>>")
    return docs.select("symbol", "day", F.posexplode(entries).alias("place", "x")).select("symbol", "day", "place", "x.event_id", "x.k")
