"""Queries over scans, merges and set operations (S and U rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ret
from ..operators.detect import first_per
from ..sources import daily, merge, tables
from ..sources.shared import shared_folder
from .panels import bars, rounded
from .registry import BARS, EV, ORD, query


@query("s01_json_lines_audit", "SELECT event_type, count(*) AS total, count(*) FILTER (event_id % 7 = 0) AS bad, sum(CASE WHEN event_id % 7 <> 0 THEN (props->>'$.k')::INT END)::BIGINT AS k FROM events GROUP BY event_type")
def s01(spark, d):
    # every seventh line is cut short, as a torn write leaves it
    lines = tables.read(spark, d, "events").select("event_type", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("line"))
    out = tables.parsed_lines(lines, "line", "k INT").groupBy("event_type")
    return out.agg(F.count("*").alias("total"), F.count_if(F.col("parse_status") == "bad").alias("bad"), F.sum(F.when(F.col("parse_status") == "ok", F.col("k"))).alias("k"))


@query("s02_date_pruned_scan", "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-20' GROUP BY 1")
def s02(spark, d):
    rows = tables.read(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-20'")
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("dt")).agg(F.count("*").alias("n"))


def _daily_lines(spark, d):
    """The events as folders of JSON lines by day; every seventh line is cut short, as a torn write leaves it."""
    e = tables.read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("dt"), F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("line"))
    folder = shared_folder(spark)
    e.select("dt", F.when(F.col("event_id") % 7 == 0, F.expr("substr(line, 1, length(line) - 3)")).otherwise(F.col("line")).alias("value")).write.partitionBy("dt").text(folder)
    return folder


_LINE = "event_id LONG, kind STRING, value DOUBLE, k INT"


@query("s01_daily_line_files", "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS total, count(*) FILTER (event_id % 7 = 0) AS bad, sum(CASE WHEN event_id % 7 <> 0 THEN (props->>'$.k')::INT END)::BIGINT AS k FROM events GROUP BY 1")
def s01_files(spark, d):
    rows = daily.day_folders(spark, _daily_lines(spark, d), "2000-01-01", "2099-12-31", _LINE)
    return daily.audited(rows, ["dt"], F.sum(F.when(F.col("_bad").isNull(), F.col("k"))).alias("k"))


@query("s02_pruned_daily_files", "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-20' AND event_id % 7 <> 0 GROUP BY 1")
def s02_files(spark, d):
    rows = daily.day_folders(spark, _daily_lines(spark, d), "2024-01-10", "2024-01-19", _LINE).where("_bad IS NULL")
    return rows.groupBy("dt").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("s05_range_scan_with_missing_columns", f"WITH {ORD} SELECT key, us, value, NULL::DOUBLE AS open_interest FROM ord WHERE us BETWEEN 820454400000000 AND 852076800000000 AND key IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def s05(spark, d):
    keys = tables.read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return tables.range_scan(tables.metric(spark, d), ["value", "open_interest"], keys, "key", "us", 820454400000000, 852076800000000)


@query("s09_upsert_first_wins", "WITH t AS (SELECT o_custkey AS key, min(o_orderkey) AS id FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS key, min(o_orderkey) AS id FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT key, id FROM t UNION ALL SELECT key, id FROM n WHERE key NOT IN (SELECT key FROM t)")
def s09(spark, d):
    o = tables.metric(spark, d).select("key", "id")
    old = o.where("id % 2 = 0").groupBy("key").agg(F.min("id").alias("id"))
    return merge.first_wins(old, o.where("id % 2 = 1"), ["key"], [F.col("id")])


@query("s10_upsert_last_wins", "SELECT key, id FROM (SELECT o_custkey AS key, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey % 2 DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def s10(spark, d):
    o = tables.metric(spark, d)
    latest = lambda x: first_per(x, ["key"], [F.desc("us"), F.desc("id")]).select("key", "us", "id")
    return merge.last_wins(latest(o.where("id % 2 = 0")), latest(o.where("id % 2 = 1")), ["key"], [F.col("us")]).select("key", "id")


@query("s10_upsert_by_partition", "SELECT key, us, id FROM (SELECT o_custkey AS key, epoch_us(o_orderdate) AS us, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def s10_partitions(spark, d):
    # the target lies in 64 parts of the keys; a batch rewrites those that it has keys of
    o = tables.metric(spark, d).select("key", "us", "id", F.pmod(F.xxhash64("key"), F.lit(64)).alias("part"))
    order, path = [F.col("us"), F.col("id")], shared_folder(spark)
    merge.write_snapshot(merge.last_wins(o.where("id % 2 = 0"), o.limit(0), ["key"], order), path, ["part"])
    merge.upsert(spark, path, o.where("id % 2 = 1"), ["key"], order, "part", last=True)
    return spark.read.parquet(path).select("key", "us", "id")


@query("s11_upsert_accumulate", """WITH o AS (SELECT o_custkey AS key, o_orderkey AS id, epoch_us(o_orderdate) AS us, o_orderkey % 3 = 0 AS ok FROM orders), s AS (SELECT key, max(us::HUGEINT * 100000000 + id) FILTER (ok) AS last FROM o GROUP BY 1)
SELECT key, count(*) AS n, sum(id % 5)::BIGINT AS fetched, count(*) FILTER (NOT ok AND (last IS NULL OR us::HUGEINT * 100000000 + id > last)) AS errors FROM o JOIN s USING (key) GROUP BY 1""")
def s11(spark, d):
    # a success sets the count of errors to zero, counters only grow; two batches, one after the other in time
    o = tables.metric(spark, d).select("key", "us", "id", (F.col("id") % 3 == 0).alias("ok"), F.lit(1).alias("n"), (F.col("id") % 5).alias("fetched"))
    none = spark.createDataFrame([], "key long, n long, fetched long, errors long")
    step = lambda target, new: merge.record(target, new, ["key"], [F.col("us"), F.col("id")], "ok", ["n", "fetched"])
    return step(step(none, o.where("us < 852076800000000")), o.where("us >= 852076800000000"))


@query("s12_dimension_maintenance", f"WITH {EV}, a AS (SELECT symbol, min(us) AS f FROM ev WHERE us < 1704672000000000 GROUP BY 1), b AS (SELECT symbol, min(us) AS f FROM ev WHERE us >= 1706400000000000 GROUP BY 1) SELECT coalesce(a.symbol, b.symbol) AS symbol, least(a.f, b.f) AS first_seen, CASE WHEN b.f IS NULL THEN 0 ELSE 1 END AS active FROM a FULL JOIN b ON a.symbol = b.symbol")
def s12(spark, d):
    t = tables.ticks(spark, d)
    seen = lambda x: x.groupBy("symbol").agg(F.min("us").alias("first_seen"))
    return merge.maintain(seen(t.where("us < 1704672000000000")), seen(t.where("us >= 1706400000000000")), "symbol")


@query("s14_split_rows", "SELECT CASE WHEN ts < '2024-01-16' THEN 'dev' WHEN ts < '2024-01-23' THEN 'val' ELSE 'holdout' END AS split, count(*) AS n, count(DISTINCT user_id) AS symbols FROM events WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY 1")
def s14(spark, d):
    rows = tables.read(spark, d, "events").withColumn("split", tables.split_of(F.to_date("ts"))).where("split IS NOT NULL")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("symbols"))


@query("s17_ledger_append", f"WITH {EV} SELECT event_id, symbol, price FROM ev WHERE us < 1705276800000000 AND event_id % 3 <> 0")
def s17(spark, d):
    # what a second run adds: matured events that the ledger doesn't hold
    t = tables.ticks(spark, d).select("event_id", "symbol", "price", "us")
    return merge.unseen(t.where("event_id % 3 = 0"), t.where("us < 1705276800000000"), ["event_id"], [F.col("us")]).select("event_id", "symbol", "price")


@query("s17_ledger_by_day", f"WITH {EV} SELECT event_id, symbol, price, strftime(make_timestamp(us), '%Y-%m-%d') AS day FROM ev WHERE us < 1705276800000000 OR event_id % 3 = 0")
def s17_days(spark, d):
    # the same batch twice: the second run adds nothing; only days that it has are read, and none is rewritten
    t = tables.ticks(spark, d).select("event_id", "symbol", "price", "us", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("day"))
    path = shared_folder(spark)
    t.where("event_id % 3 = 0").write.partitionBy("day").parquet(path)
    for _ in range(2):
        merge.append_unseen(spark, path, t.where("us < 1705276800000000"), ["event_id"], [F.col("us")], "day")
    return spark.read.schema(t.schema).parquet(path).select("event_id", "symbol", "price", "day")


@query("s18_gap_list", f"WITH {EV}, s AS (SELECT symbol, min(us // 3600000000) AS a, max(us // 3600000000) + 1 AS b FROM ev GROUP BY 1), g AS (SELECT symbol, 'head' AS gap, 473352 AS start, a AS \"end\" FROM s UNION ALL SELECT symbol, 'tail', b, 474072 FROM s) SELECT * FROM g WHERE start < \"end\"")
def s18(spark, d):
    hours = tables.ticks(spark, d).withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    return merge.gaps(hours, ["symbol"], "hour", 473352, 474072, 1)


@query("s19_coverage", "SELECT event_type AS metric, count(*) AS n, count(value)::DOUBLE / count(*) AS value_share, count(props)::DOUBLE / count(*) AS props_share FROM events GROUP BY 1")
def s19(spark, d):
    share = lambda c: (F.count(c) / F.count("*")).alias(f"{c}_share")
    return tables.read(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), share("value"), share("props"))


_JOURNAL = f"""WITH {EV}, j AS (SELECT symbol AS trade, us, price, CASE WHEN wt = 'signup' THEN 'entry' WHEN wt = 'purchase' THEN 'exit' WHEN wt = 'view' THEN 'partial_exit' END AS action FROM ev),
f AS (SELECT trade, arg_min(price, us) FILTER (action = 'entry') AS entry_px, min(us) FILTER (action = 'entry') AS entry_at, arg_max(price, us) FILTER (action IN ('exit', 'partial_exit')) AS exit_px,
max(us) FILTER (action IN ('exit', 'partial_exit')) AS exit_at, count(*) FILTER (action IN ('exit', 'partial_exit')) AS n_exits FROM j GROUP BY 1)
SELECT * FROM f WHERE entry_at IS NOT NULL AND exit_at >= entry_at"""


@query("s20_journal_fold", _JOURNAL)
def s20(spark, d):
    action = F.when(F.col("wt") == "signup", "entry").when(F.col("wt") == "purchase", "exit").when(F.col("wt") == "view", "partial_exit")
    return merge.fold_journal(tables.ticks(spark, d).select(F.col("symbol").alias("trade"), "us", "price", action.alias("action")), "trade", "action", "us")


@query("s22_parse_status_coverage", "SELECT user_id AS symbol, count(*) AS n, count(*) FILTER (event_id % 7 <> 0)::DOUBLE / count(*) AS ok_share FROM events GROUP BY 1")
def s22(spark, d):
    lines = tables.read(spark, d, "events").select(F.col("user_id").alias("symbol"), F.when(F.col("event_id") % 7 == 0, F.lit("{")).otherwise(F.col("props")).alias("line"))
    out = tables.parsed_lines(lines, "line", "k INT").groupBy("symbol")
    return out.agg(F.count("*").alias("n"), (F.count_if(F.col("parse_status") == "ok") / F.count("*")).alias("ok_share"))


@query("u01_union_of_sources", f"WITH {EV}, {ORD} SELECT 'tick' AS venue, count(*) AS n, round(sum(price), 2) AS total, NULL::VARCHAR AS priority FROM ev UNION ALL SELECT 'order', count(*), round(sum(value), 2), min(priority) FROM ord")
def u01(spark, d):
    a = tables.ticks(spark, d).select(F.lit("tick").alias("venue"), F.col("price").alias("value"))
    b = tables.metric(spark, d).select(F.lit("order").alias("venue"), "value", "priority")
    return a.unionByName(b, allowMissingColumns=True).groupBy("venue").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("priority").alias("priority"))


@query("u02_concatenate_live_wins", f"WITH {BARS}, s AS (SELECT symbol, slot, c FROM bars) SELECT symbol, slot, round(CASE WHEN slot % 4 = 0 THEN c * 2 ELSE c END, 6) AS c FROM s")
def u02(spark, d):
    local = bars(spark, d).select("symbol", "slot", "c")
    live = local.where("slot % 4 = 0").withColumn("c", F.col("c") * 2)
    return rounded(merge.last_wins(local.withColumn("src", F.lit(0)), live.withColumn("src", F.lit(1)), ["symbol", "slot"], [F.col("src")]).drop("src"))


@query("u03_universe_algebra", f"WITH {EV} SELECT symbol FROM ((SELECT symbol FROM ev WHERE price > 300 UNION SELECT symbol FROM ev WHERE wt = 'error') EXCEPT SELECT symbol FROM ev WHERE k > 97) WHERE symbol % 10 <> 3")
def u03(spark, d):
    t = tables.ticks(spark, d)
    pick = lambda c: t.where(c).select("symbol")
    return pick("price > 300").union(pick("wt = 'error'")).distinct().exceptAll(pick("k > 97").distinct().intersect(pick("price > 300").union(pick("wt = 'error'")))).where("symbol % 10 <> 3")


@query("u04_samples_in_all", f"WITH {EV} SELECT symbol, us // 86400000000 AS day, count(DISTINCT wt) AS kinds FROM ev GROUP BY ALL HAVING count(DISTINCT wt) >= 3")
def u04(spark, d):
    return tables.ticks(spark, d).groupBy("symbol", F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(F.countDistinct("wt").alias("kinds")).where("kinds >= 3")


@query("u05_split_complement", f"WITH {BARS} SELECT symbol, count(*) FILTER (slot < 78896) AS dev, count(*) FILTER (slot BETWEEN 78900 AND 78927) AS val, count(*) FILTER (slot >= 78932) AS holdout FROM bars GROUP BY 1")
def u05(spark, d):
    # four slots between splits stay unused
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return bars(spark, d).groupBy("symbol").agg(n("slot < 78896", "dev"), n("slot BETWEEN 78900 AND 78927", "val"), n("slot >= 78932", "holdout"))


@query("k01_leaderboard", f"WITH {BARS} SELECT symbol, round(sum(qv), 4) AS qv, sum(trades)::BIGINT AS trades FROM bars GROUP BY 1")
def k01(spark, d):
    return bars(spark, d).groupBy("symbol").agg(F.round(F.sum("qv"), 4).alias("qv"), F.sum("trades").alias("trades")).orderBy(F.desc("qv"), F.desc("trades"), "symbol")


@query("k02_global_top", f"WITH {BARS} SELECT symbol, n, round(m, 6) AS m FROM (SELECT symbol, count(*) AS n, avg(c/ nullif(o, 0) - 1) AS m FROM bars GROUP BY 1 HAVING count(*) >= 20) ORDER BY m DESC, symbol LIMIT 15")
def k02(spark, d):
    return rounded(bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.avg(ret("c", "o")).alias("m")).where("n >= 20").orderBy(F.desc("m"), "symbol").limit(15))


@query("k03_top_per_group", f"WITH {BARS}, g AS (SELECT slot // 28 AS week, symbol, sum(v)::BIGINT AS v FROM bars GROUP BY ALL) SELECT week, symbol, v FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY v DESC, symbol) AS r FROM g) WHERE r <= 5")
def k03(spark, d):
    g = bars(spark, d).groupBy(F.floor(F.col("slot") / 28).alias("week"), "symbol").agg(F.sum("v").alias("v"))
    return first_per(g, ["week"], [F.desc("v"), F.col("symbol")], 5)


@query("k04_most_active", f"WITH {BARS}, g AS (SELECT slot // 4 AS day, symbol, round(max(qv), 4) AS qv FROM bars GROUP BY ALL) SELECT day, symbol, qv FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY qv DESC, symbol) AS r FROM g) WHERE r <= 10")
def k04(spark, d):
    g = bars(spark, d).groupBy(F.floor(F.col("slot") / 4).alias("day"), "symbol").agg(F.round(F.max("qv"), 4).alias("qv"))
    return first_per(g, ["day"], [F.desc("qv"), F.col("symbol")], 10)


@query("k05_top_movers", f"WITH {BARS}, m AS (SELECT symbol, slot, c / nullif(lag(c, 4) OVER (PARTITION BY symbol ORDER BY slot), 0) - 1 AS chg FROM bars), l AS (SELECT symbol, arg_max(chg, slot) AS chg FROM m GROUP BY 1) SELECT symbol, round(chg, 6) AS chg FROM l WHERE chg IS NOT NULL ORDER BY chg DESC, symbol LIMIT 20")
def k05(spark, d):
    chg = ret("c", F.lag("c", 4).over(Window.partitionBy("symbol").orderBy("slot")))
    last = bars(spark, d).withColumn("chg", chg).groupBy("symbol").agg(F.max_by("chg", "slot").alias("chg")).where("chg IS NOT NULL")
    return rounded(last.orderBy(F.desc("chg"), "symbol").limit(20))


@query("k06_arg_extremes", f"WITH {EV} SELECT symbol, arg_max(event_id, (price, -event_id)) AS high_id, arg_min(event_id, (price, event_id)) AS low_id, max(price) AS high, min(price) AS low FROM ev GROUP BY 1")
def k06(spark, d):
    return tables.ticks(spark, d).groupBy("symbol").agg(
        F.max_by("event_id", F.struct("price", F.negate("event_id"))).alias("high_id"), F.min_by("event_id", F.struct("price", "event_id")).alias("low_id"), F.max("price").alias("high"), F.min("price").alias("low")
    )

