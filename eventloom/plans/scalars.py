"""Queries over projections, filters and scalar functions (P and F rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bars as B
from ..operators.asof import asof
from ..sources import tables
from .panels import bars, panel, rounded
from .registry import BARS, EV, PANEL, query


_NAMES = "CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || '/USDT:USDT' WHEN 2 THEN lower(p_brand) || '/usdt' WHEN 3 THEN p_brand || 'USDC' WHEN 4 THEN p_brand || '-USDT' WHEN 5 THEN p_brand || '-PERPETUAL' ELSE ' / ' END"


@query("p01_symbols", f"""WITH s AS (SELECT p_partkey, regexp_replace(replace(replace(upper(trim({_NAMES})), '/USDT:USDT', 'USDT'), '/USDT', 'USDT'), '[^A-Z0-9]', '', 'g') AS x, p_brand || '-USDT-SWAP' AS inst FROM part)
SELECT p_partkey, CASE WHEN length(x) = 0 THEN NULL WHEN x NOT LIKE '%USDT' AND length(x) <= 12 THEN x || 'USDT' ELSE x END AS symbol, CASE WHEN regexp_matches(inst, '^[A-Z0-9]+-USDT-SWAP$') THEN string_split(inst, '-')[1] || 'USDT' END AS swap FROM s""")
def p01(spark, d):
    return tables.read(spark, d, "part").select("p_partkey", S.symbol(F.expr(_NAMES)).alias("symbol"), S.swap_symbol(F.concat("p_brand", F.lit("-USDT-SWAP"))).alias("swap"))


@query("p03_time_units", f"WITH {EV}, s AS (SELECT event_id, us // 1000000 AS t FROM ev) SELECT event_id, CASE WHEN (SELECT median(t) FROM s) BETWEEN 1e9 AND 2e10 - 1 THEN t * 1000 ELSE t END AS ms FROM s")
def p03(spark, d):
    s = tables.ticks(spark, d).select("event_id", F.floor(F.col("us") / 1_000_000).alias("t"))
    # one row, so the broadcast has a fixed size
    return s.join(F.broadcast(s.agg(F.percentile_approx("t", 0.5).alias("median")))).select("event_id", S.as_millis(F.col("t"), F.col("median")).alias("ms"))


@query("p05_array_payloads", f"WITH {EV} SELECT event_id, us AS open_at, price AS px, k AS size FROM ev WHERE k % 4 <> 0")
def p05(spark, d):
    # every fourth payload is too short and is rejected
    t = tables.ticks(spark, d)
    payload = F.when(F.col("k") % 4 == 0, F.to_json(F.array(F.col("us").cast("string")))).otherwise(F.to_json(F.array(F.col("us").cast("string"), F.col("price").cast("string"), F.col("k").cast("string"))))
    a = F.from_json("payload", "array<string>")
    rows = t.select("event_id", payload.alias("payload")).withColumn("a", a).where(F.size("a") >= 3)
    return rows.select("event_id", F.get("a", F.lit(0)).try_cast("long").alias("open_at"), F.get("a", F.lit(1)).try_cast("double").alias("px"), F.get("a", F.lit(2)).try_cast("int").alias("size"))


@query("p06_object_payloads", f"WITH {EV} SELECT event_id, price AS long_share, CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS oi FROM ev")
def p06(spark, d):
    # one spelling of the share or the other; blanks are null
    t = tables.ticks(spark, d)
    body = F.to_json(F.struct(F.when(F.col("k") % 2 == 0, F.col("price").cast("string")).alias("longAccount"), F.when(F.col("k") % 2 == 1, F.col("price").cast("string")).alias("longPosition"), F.when(F.col("k") % 3 == 0, "").otherwise(F.col("k").cast("string")).alias("oi")))
    x = t.select("event_id", F.from_json(body, "longAccount string, longPosition string, oi string").alias("x"))
    return x.select("event_id", S.number(F.coalesce("x.longAccount", "x.longPosition")).alias("long_share"), S.number(F.col("x.oi")).cast("int").alias("oi"))


@query("p08_nested_events", f"WITH {EV}, a AS (SELECT symbol, 'one' AS venue, 'SELL' AS side, price, k AS qty FROM ev WHERE wt = 'error'), b AS (SELECT symbol, 'two', 'BUY', price, k FROM ev WHERE wt IN ('purchase', 'signup')) SELECT symbol, venue, side, round(sum(price * qty), 4) AS notional, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE qty > 0 AND price > 0 GROUP BY ALL")
def p08(spark, d):
    t = tables.ticks(spark, d)
    one = t.where("wt = 'error'").select(F.to_json(F.struct(F.struct("symbol", F.lit("SELL").alias("side"), "price", F.col("k").alias("qty")).alias("o"))).alias("j"))
    one = one.select(F.from_json("j", "o struct<symbol:long,side:string,price:double,qty:int>").alias("x")).select("x.o.*", F.lit("one").alias("venue"))
    two = t.where("wt IN ('purchase', 'signup')").groupBy("symbol", F.floor(F.col("us") / B.DAY)).agg(F.to_json(F.struct(F.col("symbol").alias("inst"), F.collect_list(F.struct(F.lit("buy").alias("side"), "price", F.col("k").alias("qty"))).alias("data"))).alias("j"))
    two = two.select(F.from_json("j", "inst long, data array<struct<side:string,price:double,qty:int>>").alias("x")).select(F.col("x.inst").alias("symbol"), F.explode("x.data").alias("e")).select("symbol", F.upper("e.side").alias("side"), "e.price", "e.qty", F.lit("two").alias("venue"))
    rows = one.unionByName(two).where("qty > 0 AND price > 0")
    return rows.groupBy("symbol", "venue", "side").agg(F.round(F.sum(F.col("price") * F.col("qty")), 4).alias("notional"), F.count("*").alias("n"))


@query("p10_html_text", r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[\s]*', chr(10), 'g'), ' ') AS text FROM c""")
def p10(spark, d):
    return tables.read(spark, d, "pages").select("page_id", S.clean_html(F.col("html")).alias("text"))


@query("p11_text_features", r"""SELECT conv_id, turn, nullif(regexp_extract(text, '([0-9]+)', 1), '') AS first_number, len(regexp_extract_all(text, '[A-Z][a-z]+'))::INT AS capitalised,
CASE WHEN regexp_matches(text, '(?i)\bup\b') AND regexp_matches(text, '(?i)\bdown\b') THEN NULL WHEN regexp_matches(text, '(?i)\bup\b') THEN 1 WHEN regexp_matches(text, '(?i)\bdown\b') THEN -1 END AS direction FROM conversations""")
def p11(spark, d):
    up, down = F.col("text").rlike(r"(?i)\bup\b"), F.col("text").rlike(r"(?i)\bdown\b")
    return tables.read(spark, d, "conversations").select(
        "conv_id", "turn", F.nullif(F.regexp_extract("text", "([0-9]+)", 1), F.lit("")).alias("first_number"), F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("capitalised"),
        F.when(up & down, F.lit(None)).when(up, 1).when(down, -1).alias("direction"),
    )


@query("p12_calendar", """WITH e AS (SELECT event_id, epoch_us(ts) AS us, ts FROM events) SELECT event_id, us - us % 300000000 AS slot, (us - 5000000) - (us - 5000000) % 300000000 - 300000000 AS closed, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday,
strftime(ts, '%Y-%m') AS month, isoyear(ts)::INT AS iso_year, week(ts)::INT AS iso_week FROM e""")
def p12(spark, d):
    e = tables.read(spark, d, "events").select("event_id", tables.micros("ts").alias("us"), "ts")
    return e.select("event_id", S.floored(F.col("us"), 300_000_000).alias("slot"), S.latest_closed(F.col("us"), 300_000_000, 5_000_000).alias("closed"), F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"),
                    F.date_format("ts", "yyyy-MM").alias("month"), F.expr("extract(YEAROFWEEK FROM ts)").alias("iso_year"), F.weekofyear("ts").alias("iso_week"))


@query("p14_wall_clock_sessions", """WITH e AS (SELECT event_id, ts - INTERVAL 5 HOUR AS l, hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) AS m, isodow(ts - INTERVAL 5 HOUR) - 1 AS w FROM events)
SELECT event_id, hour(l)::INT AS et_hour, CASE WHEN w >= 5 THEN 'weekend' WHEN m BETWEEN 570 AND 959 THEN 'rth' WHEN m BETWEEN 960 AND 1319 THEN 'afterhours' WHEN (w = 4 AND m >= 1320) OR (w = 0 AND m < 240) THEN 'weekend' ELSE 'overnight' END AS session FROM e""")
def p14(spark, d):
    # all events lie in January, when New York is five hours behind
    ts = F.col("ts").cast("timestamp")
    return tables.read(spark, d, "events").select("event_id", F.hour(F.from_utc_timestamp(ts, "America/New_York")).alias("et_hour"), S.session(ts).alias("session"))


@query("p16_next_trading_day", "WITH c AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE isodow(o_orderdate) <= 5), n AS (SELECT d, lead(d) OVER (ORDER BY d) AS n1 FROM c) SELECT year(d)::INT AS year, count(*) AS days, max(n1 - d)::INT AS longest_gap FROM n GROUP BY 1")
def p16(spark, d):
    # the calendar is a dimension with a row per day, whatever the size of the data
    days = tables.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).where(F.weekday("d") < 5).distinct()
    n = days.withColumn("n1", F.lead("d").over(Window.orderBy("d")))
    return n.groupBy(F.year("d").alias("year")).agg(F.count("*").alias("days"), F.max(F.datediff("n1", "d")).alias("longest_gap"))


@query("p17_buckets", f"WITH {EV}, b AS (SELECT CASE WHEN price < 10 THEN '<10' WHEN price < 50 THEN '10-50' WHEN price < 200 THEN '50-200' ELSE '>=200' END AS bucket FROM ev) SELECT bucket, count(*) AS n FROM b GROUP BY 1")
def p17(spark, d):
    return tables.ticks(spark, d).groupBy(S.bucket(F.col("price"), [10, 50, 200]).alias("bucket")).agg(F.count("*").alias("n"))


_COST = "CASE WHEN coalesce({0}, 0) < 1.5 THEN {1} * 0.14 WHEN {0} < 3.0 THEN {1} * 0.94 ELSE {1} * 1.34 END"


@query("p18_costs_and_net", f"WITH {PANEL} SELECT event_id, round(f1 * 100 - {_COST.format('k / 20.0', '1.0')}, 6) AS net_long, round(-f1 * 100 - {_COST.format('k / 20.0', '1.0')}, 6) AS net_short, round(price * (1 + k / 10000.0), 6) AS bought, round(price * (1 - k / 10000.0), 6) AS sold FROM panel")
def p18(spark, d):
    atr, raw, half = F.col("k") / 20.0, F.col("f1") * 100, F.col("k") / 10000.0
    cost = S.round_trip_cost(atr)
    return rounded(panel(spark, d).select("event_id", S.net(raw, cost, 1).alias("net_long"), S.net(raw, cost, -1).alias("net_short"), S.filled(F.col("price"), half, 1, True).alias("bought"), S.filled(F.col("price"), half, 1, False).alias("sold")))


@query("p20_spread_fallback", f"WITH {EV}, q AS (SELECT symbol, us, k / 10000.0 AS hs FROM ev WHERE wt = 'view'), e AS (SELECT * FROM ev WHERE wt = 'purchase'), m AS (SELECT symbol, median(hs) AS med FROM q GROUP BY 1) SELECT e.event_id, round(coalesce(q.hs, med, 0.0005), 8) AS half_spread FROM e ASOF LEFT JOIN q ON e.symbol = q.symbol AND e.us >= q.us LEFT JOIN m ON e.symbol = m.symbol")
def p20(spark, d):
    t = tables.ticks(spark, d)
    q = t.where("wt = 'view'").select("symbol", "us", (F.col("k") / 10000.0).alias("hs"))
    e = asof(t.where("wt = 'purchase'").select("event_id", "symbol", "us"), q, "symbol", "us", ["hs"])
    out = e.join(q.groupBy("symbol").agg(F.median("hs").alias("med")), "symbol", "left")
    return rounded(out.select("event_id", F.coalesce("hs", "med", F.lit(0.0005)).alias("half_spread")), 8)


@query("p22_rules_and_reasons", f"WITH {EV} SELECT event_id, CASE WHEN price < 5 THEN 'too cheap' WHEN k < 10 THEN 'too small' WHEN wt = 'error' THEN 'bad kind' ELSE 'accepted' END AS reason, CASE WHEN wt = 'purchase' THEN 1 WHEN wt = 'error' THEN -1 ELSE 0 END AS stance, CASE wt WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.8 ELSE 0.5 END AS weight FROM ev")
def p22(spark, d):
    reason = S.first_match([("too cheap", F.col("price") < 5), ("too small", F.col("k") < 10), ("bad kind", F.col("wt") == "error")], "accepted")
    weight = F.coalesce(F.try_element_at(F.create_map(F.lit("purchase"), F.lit(1.0), F.lit("signup"), F.lit(0.8)), F.col("wt")), F.lit(0.5))
    return tables.ticks(spark, d).select("event_id", reason.alias("reason"), F.when(F.col("wt") == "purchase", 1).when(F.col("wt") == "error", -1).otherwise(0).alias("stance"), weight.alias("weight"))


@query("p24_lifecycle", f"WITH {EV}, s AS (SELECT symbol, min(us) AS a, max(us) AS b FROM ev GROUP BY 1), f AS (SELECT ev.symbol, avg((us < a + (b - a) / 2.0)::INT) AS early FROM ev JOIN s USING (symbol) WHERE k >= 80 GROUP BY 1) SELECT symbol, round(early, 6) AS early, CASE WHEN early >= 0.75 THEN 'early' WHEN early <= 0.25 THEN 'late' ELSE 'spread' END AS lifecycle FROM f")
def p24(spark, d):
    w = Window.partitionBy("symbol")
    t = tables.ticks(spark, d).withColumn("mid", F.min("us").over(w) + (F.max("us").over(w) - F.min("us").over(w)) / 2.0)
    f = t.where("k >= 80").groupBy("symbol").agg(F.avg((F.col("us") < F.col("mid")).cast("int")).alias("early"))
    return rounded(f.withColumn("lifecycle", F.when(F.col("early") >= 0.75, "early").when(F.col("early") <= 0.25, "late").otherwise("spread")))


@query("p25_push_and_format", f"WITH {PANEL} SELECT event_id, greatest(abs(f1), abs(f3)) >= CASE wt WHEN 'error' THEN 0.5 ELSE 1.0 END AS push, concat_ws(' | ', symbol::VARCHAR, wt, CASE WHEN k > 50 THEN 'k=' || k END) AS message FROM panel")
def p25(spark, d):
    least = F.coalesce(F.try_element_at(F.create_map(F.lit("error"), F.lit(0.5)), F.col("wt")), F.lit(1.0))
    strength = F.greatest(F.abs("f1"), F.abs("f3"))
    message = F.concat_ws(" | ", F.col("symbol").cast("string"), "wt", F.when(F.col("k") > 50, F.concat(F.lit("k="), F.col("k").cast("string"))))
    return panel(spark, d).select("event_id", (strength >= least).alias("push"), message.alias("message"))


@query("p28_guards_and_ratios", f"WITH {PANEL} SELECT event_id, round(CASE WHEN k = 0 THEN NULL ELSE price / k END, 6) AS ratio, round(CASE WHEN k = 0 THEN 0.5 ELSE k::DOUBLE / (k + 50) END, 6) AS share, round(abs(k::DOUBLE / (k + 50) - 0.5) * 2, 6) AS divergence, CASE WHEN k <= 5 THEN 'strong' WHEN k <= 10 THEN 'weak' ELSE 'stale' END AS freshness FROM panel")
def p28(spark, d):
    k = F.col("k").cast("double")
    share = S.ratio(k, k + 50)
    return rounded(panel(spark, d).select(
        "event_id", S.ratio(F.col("price"), k).alias("ratio"), F.when(k == 0, 0.5).otherwise(share).alias("share"), (F.abs(share - 0.5) * 2).alias("divergence"),
        F.when(k <= 5, "strong").when(k <= 10, "weak").otherwise("stale").alias("freshness"),
    ))


@query("p30_candles", f"WITH {BARS} SELECT symbol, slot, round((h - greatest(o, c))/ nullif(c, 0), 6) AS upper_wick, round(c/ nullif(o, 0) - 1, 6) AS body, round((h - l)/ nullif(c, 0), 6) AS range, round(coalesce(taker_v::DOUBLE / nullif(v, 0), 0.5), 6) AS taker_share, CASE WHEN l > 0 AND h > 0 THEN round((h - l) / ((h + l) / 2) * 10000, 4) ELSE 0 END AS spread_bp FROM bars")
def p30(spark, d):
    bp = F.when((F.col("l") > 0) & (F.col("h") > 0), F.round((F.col("h") - F.col("l")) / ((F.col("h") + F.col("l")) / 2) * 10000, 4)).otherwise(0.0)
    b = bars(spark, d)
    return rounded(b.select("symbol", "slot", S.share(F.col("h") - F.greatest("o", "c"), "c").alias("upper_wick"), (S.ret("c", "o")).alias("body"), S.share(F.col("h") - F.col("l"), "c").alias("range"), S.ratio(F.col("taker_v"), F.col("v"), 0.5).alias("taker_share"), bp.alias("spread_bp")))


@query("p33_surprise", "SELECT p_partkey, round((p_retailprice - (900 + p_size)) / nullif(abs(900 + p_size), 0), 6) AS surprise FROM part")
def p33(spark, d):
    est = 900 + F.col("p_size")
    return rounded(tables.read(spark, d, "part").select("p_partkey", S.ratio(F.col("p_retailprice") - est, F.abs(est)).alias("surprise")))


@query("p34_json_round_trip", f"WITH {EV} SELECT event_id, symbol, k, wt FROM ev")
def p34(spark, d):
    t = tables.ticks(spark, d).select(F.to_json(F.struct("event_id", "symbol", "k", "wt")).alias("j"))
    return t.select(F.from_json("j", "event_id long, symbol long, k int, wt string").alias("x")).select("x.*")


@query("p35_position_and_leverage", f"WITH {PANEL}, g(pos, lev) AS (VALUES (0.1, 2.0), (0.2, 5.0), (0.3, 10.0)) SELECT pos, lev, count(*) AS n, round(sum(CASE WHEN f1 <= -1 / lev THEN -pos ELSE (f1 - 0.001) * pos * lev END), 4) AS pnl, count(*) FILTER (f1 <= -1 / lev) AS liquidated FROM panel, g WHERE f1 IS NOT NULL GROUP BY ALL")
def p35(spark, d):
    grid = spark.createDataFrame([(0.1, 2.0), (0.2, 5.0), (0.3, 10.0)], "pos double, lev double")
    dead = F.col("f1") <= -1 / F.col("lev")
    x = panel(spark, d).where("f1 IS NOT NULL").crossJoin(F.broadcast(grid))  # three parameter rows
    return x.groupBy("pos", "lev").agg(F.count("*").alias("n"), F.round(F.sum(F.when(dead, -F.col("pos")).otherwise((F.col("f1") - 0.001) * F.col("pos") * F.col("lev"))), 4).alias("pnl"), F.count_if(dead).alias("liquidated"))


@query("p36_predicate_sets", f"WITH {PANEL} SELECT event_id, coalesce(price >= 20 AND price <= 300 AND k >= 30 AND f1 <= 2, false) AS passes FROM panel")
def p36(spark, d):
    return panel(spark, d).select("event_id", S.within({"price": (20, 300), "k": (30, None), "f1": (None, 2)}).alias("passes"))


@query("p38_settlement_grid", f"WITH {EV} SELECT event_id, unnest(range((us // 28800000000 + 1) * 28800000000, us + 86400000000 + 1, 28800000000)) AS settles FROM ev WHERE wt = 'purchase'")
def p38(spark, d):
    step = 8 * B.HOUR
    return tables.ticks(spark, d).where("wt = 'purchase'").select("event_id", F.explode(F.sequence((F.floor(F.col("us") / step) + 1) * step, F.col("us") + B.DAY, F.lit(step))).alias("settles"))


@query("p39_cost_and_latency_grid", f"WITH {PANEL}, t(tier, scale) AS (VALUES ('base', 1.0), ('stressed', 1.5)), g(lag_s) AS (VALUES (0), (10), (30)) SELECT tier, lag_s, round(avg(f1 * 100 - {_COST.format('k / 20.0', 'scale')} - lag_s * 0.001), 6) AS net FROM panel, t, g WHERE f1 IS NOT NULL GROUP BY ALL")
def p39(spark, d):
    grid = spark.createDataFrame([(t, s, g) for t, s in (("base", 1.0), ("stressed", 1.5)) for g in (0, 10, 30)], "tier string, scale double, lag_s int")
    x = panel(spark, d).where("f1 IS NOT NULL").crossJoin(F.broadcast(grid))  # six parameter rows
    cost = S.round_trip_cost(F.col("k") / 20.0) * F.col("scale")
    return rounded(x.groupBy("tier", "lag_s").agg(F.avg(F.col("f1") * 100 - cost - F.col("lag_s") * 0.001).alias("net")))


@query("f01_named_predicates", f"WITH {PANEL} SELECT 'high' AS bucket, count(*) AS n, round(avg(f1), 6) AS mean FROM panel WHERE k >= 80 UNION ALL SELECT 'low', count(*), round(avg(f1), 6) FROM panel WHERE k < 20 UNION ALL SELECT 'all', count(*), round(avg(f1), 6) FROM panel")
def f01(spark, d):
    # a row joins every bucket whose predicate holds; buckets may overlap
    predicates = {"high": F.col("k") >= 80, "low": F.col("k") < 20, "all": F.lit(True)}
    member = F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in predicates.items())), lambda x: x.isNotNull()))
    return rounded(panel(spark, d).select(member.alias("bucket"), "f1").groupBy("bucket").agg(F.count("*").alias("n"), F.avg("f1").alias("mean")))


@query("f05_direction_function", f"WITH {PANEL}, s AS (SELECT *, CASE WHEN wt = 'error' THEN -1 WHEN k >= 50 THEN 1 END AS side FROM panel) SELECT wt, count(side) AS n, round(avg(side * f1), 6) AS mean FROM s GROUP BY 1")
def f05(spark, d):
    side = F.when(F.col("wt") == "error", -1).when(F.col("k") >= 50, 1)
    return rounded(panel(spark, d).groupBy("wt").agg(F.count(side).alias("n"), F.avg(side * F.col("f1")).alias("mean")))


@query("f09_string_predicates", f"WITH {PANEL} SELECT 'calm' AS archetype, count(*) AS n, round(avg(f1), 6) AS mean FROM panel WHERE price < 100 AND k < 50 UNION ALL SELECT 'wild', count(*), round(avg(f1), 6) FROM panel WHERE price >= 100 AND k >= 50")
def f09(spark, d):
    allowed, registry = {"price", "k"}, {"calm": "price < 100 AND k < 50", "wild": "price >= 100 AND k >= 50"}
    p = panel(spark, d)
    parsed = {n: F.expr(c) for n, c in registry.items()}
    # a predicate may only name vetted columns: it must resolve against those alone
    for c in parsed.values():
        p.select(*allowed).where(c)
    member = F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in parsed.items())), lambda x: x.isNotNull()))
    return rounded(p.select(member.alias("archetype"), "f1").groupBy("archetype").agg(F.count("*").alias("n"), F.avg("f1").alias("mean")))
