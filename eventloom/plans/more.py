"""Further queries: nested payloads, derived fields, cleaning, within-cluster shuffles, listing age, pluggable exits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import stats
from ..operators import bars as B
from ..operators import outcomes as O
from ..operators.shuffles import dealt, dealt_sql
from ..sources import daily, tables
from ..sources.shared import shared_folder
from .aggregates import P1, returns
from .panels import bars, panel, rounded
from .registry import BARS, EV, PANEL, query


@query("s07_nested_day_documents", f"WITH {EV} SELECT event_id, symbol, us // 86400000000 AS day, price FROM ev WHERE k >= 50")
def s07(spark, d):
    # one document a day and symbol, its list opened again
    t = tables.ticks(spark, d).where("k >= 50")
    docs = t.groupBy("symbol", F.floor(F.col("us") / B.DAY).alias("day")).agg(F.to_json(F.struct(F.collect_list(F.struct("event_id", "price")).alias("rows"))).alias("doc"))
    x = docs.select("symbol", "day", F.explode(F.from_json("doc", "rows array<struct<event_id:long,price:double>>")["rows"]).alias("r"))
    return x.select("r.event_id", "symbol", "day", "r.price")


@query("s07_day_document_files", f"WITH {EV} SELECT event_id, symbol, strftime(make_timestamp(us), '%Y-%m-%d') AS day, price FROM ev WHERE us >= 1704844800000000 AND us < 1705708800000000 AND k >= 50")
def s07_files(spark, d):
    # documents of a day lie in files that carry its date; days outside the range are not opened
    t = tables.ticks(spark, d).where("k >= 50").withColumn("day", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd"))
    docs = t.groupBy("symbol", "day").agg(F.to_json(F.struct("symbol", F.collect_list(F.struct("event_id", "price")).alias("rows"))).alias("value"))
    folder = shared_folder(spark)
    daily.write_day_files(docs.select("value", "day"), folder, "day", "text", ".json")
    docs = daily.day_files(spark, folder, "2024-01-10", "2024-01-19", "symbol long, rows array<struct<event_id:long,price:double>>")
    return docs.select("symbol", "day", F.explode("rows").alias("r")).select("r.event_id", "symbol", "day", "r.price")


@query("s08_json_map_dimension", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def s08(spark, d):
    # the map has a row per nation, 25 at every scale
    nation = tables.read(spark, d, "nation").where("n_nationkey < 20")
    text = nation.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))).alias("m"))
    dim = text.select(F.explode(F.from_json("m", "map<string,string>")).alias("key", "n_name")).select(F.col("key").cast("int").alias("c_nationkey"), "n_name")
    return tables.read(spark, d, "customer").join(F.broadcast(dim), "c_nationkey", "left").select("c_custkey", "n_name")


@query("p09_price_arrays", f"WITH {EV} SELECT event_id, symbol, price, coalesce(CASE WHEN k % 5 <> 0 THEN us END, 1704067200000000) AS at FROM ev WHERE k % 7 <> 0")
def p09(spark, d):
    # rows without a price are skipped one by one; a missing time falls back to that of the poll
    t = tables.ticks(spark, d)
    one = F.struct("event_id", F.col("symbol").cast("string").alias("s"), F.when(F.col("k") % 7 == 0, "bad").otherwise(F.col("price").cast("string")).alias("p"), F.when(F.col("k") % 5 != 0, F.col("us")).alias("E"))
    # a poll a symbol and hour
    polls = t.groupBy("symbol", F.floor(F.col("us") / B.HOUR)).agg(F.to_json(F.collect_list(one)).alias("payload"))
    x = polls.select(F.explode(F.from_json("payload", "array<struct<event_id:long,s:string,p:string,E:long>>")).alias("r")).select("r.*")
    return x.select("event_id", F.col("s").cast("long").alias("symbol"), S.number(F.col("p")).alias("price"), F.coalesce("E", F.lit(1704067200000000)).alias("at")).where("price IS NOT NULL")


@query("p23_first_match_sizes", f"WITH {PANEL} SELECT event_id, CASE WHEN k >= 90 THEN 'r1' WHEN price < 20 THEN 'r2' WHEN wt = 'error' THEN 'r3' END AS rule, CASE WHEN k >= 90 THEN 2.0 WHEN price < 20 THEN 0.5 WHEN wt = 'error' THEN 1.0 ELSE 0.0 END AS size, CASE WHEN k >= 90 THEN -1 WHEN price < 20 THEN 1 WHEN wt = 'error' THEN -1 ELSE 0 END AS direction FROM panel")
def p23(spark, d):
    rules = [(F.col("k") >= 90, "r1", 2.0, -1), (F.col("price") < 20, "r2", 0.5, 1), (F.col("wt") == "error", "r3", 1.0, -1)]
    hit = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(0.0).alias("size"), F.lit(0).alias("direction"))
    for when, name, size, side in reversed(rules):
        hit = F.when(when, F.struct(F.lit(name).alias("rule"), F.lit(size).alias("size"), F.lit(side).alias("direction"))).otherwise(hit)
    return panel(spark, d).select("event_id", hit.alias("h")).select("event_id", "h.*")


@query("p27_derived_fields", f"WITH {EV}, c AS (SELECT c_custkey, c_acctbal FROM customer) SELECT event_id, CASE WHEN k = 0 THEN 0.0 WHEN c_acctbal IS NULL OR c_acctbal = 0 THEN NULL ELSE round(k / c_acctbal * 100, 6) END AS ratio FROM ev LEFT JOIN c ON symbol = c_custkey")
def p27(spark, d):
    c = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), "c_acctbal")
    return tables.ticks(spark, d).join(c, "symbol", "left").select("event_id", F.when(F.col("k") == 0, 0.0).otherwise(F.round(F.try_divide(F.col("k"), F.col("c_acctbal")) * 100, 6)).alias("ratio"))


@query("p32_cleaning", f"WITH {EV}, z AS (SELECT symbol, avg((k % 10 = 0)::INT) AS zeros FROM ev GROUP BY 1) SELECT event_id, CASE WHEN k % 10 = 0 AND zeros > 0.1 THEN NULL ELSE k % 10 END AS value FROM ev JOIN z USING (symbol) WHERE abs(ln(nullif(price, 0) / 100)) <= 3")
def p32(spark, d):
    # a zero counts as missing for symbols that have many; extreme logarithms go
    w = Window.partitionBy("symbol")
    x = tables.ticks(spark, d).withColumn("v", F.col("k") % 10).withColumn("zeros", F.avg((F.col("v") == 0).cast("int")).over(w))
    return x.where(F.abs(S.finite(F.log(F.col("price") / 100))) <= 3).select("event_id", F.when((F.col("v") == 0) & (F.col("zeros") > 0.1), F.lit(None)).otherwise(F.col("v")).alias("value"))


_TIER = "CASE WHEN k >= 67 THEN 'high' WHEN k >= 34 THEN 'mid' ELSE 'low' END"


@query("a14_within_cluster_shuffle", f"""WITH RECURSIVE {P1}, b AS (SELECT event_id, day, f1, {_TIER} AS tier FROM p), {dealt_sql("b", "day", "event_id", "tier", 30, "within")},
m AS (SELECT rep, dealt, avg(f1) / (stddev_samp(f1) / sqrt(count(*))) AS t FROM rows_dealt GROUP BY ALL) SELECT rep, round(max(abs(t)), 5) AS max_t FROM m GROUP BY 1""")
def a14(spark, d):
    # tiers of the rate are dealt out anew among the events of a day
    s = dealt(returns(spark, d).select("event_id", "day", "f1", F.expr(_TIER).alias("tier")), ["day"], "event_id", "tier", 30, "within")
    m = s.groupBy("rep", "dealt").agg(stats.one_sample_t("f1").alias("t"))
    return rounded(m.groupBy("rep").agg(F.max(F.abs("t")).alias("max_t")), 5)


@query("a39_breadth", f"WITH {EV} SELECT event_id, count(*) OVER (PARTITION BY us // 60000000) AS minute_count, count(*) OVER (PARTITION BY us // 3600000000) AS hour_count FROM ev")
def a39(spark, d):
    # minutes are counted by an aggregate, hours from minutes, and both looked up
    t = tables.ticks(spark, d).select("event_id", F.floor(F.col("us") / B.MINUTE).alias("minute"))
    minutes = t.groupBy("minute").agg(F.count("*").alias("minute_count"))
    minutes = minutes.withColumn("hour_count", F.sum("minute_count").over(Window.partitionBy(F.floor(F.col("minute") / 60))))
    return t.join(minutes, "minute").select("event_id", "minute_count", "hour_count")


_EXT = f"WITH {BARS}, x AS (SELECT symbol, slot, lead(c, 8) OVER w / nullif(c, 0) - 1 AS f, max(h) OVER a / nullif(c, 0) - 1 AS mfe FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot), a AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))"


@query("w42_one_sided_lock", _EXT + " SELECT symbol, slot, round(CASE WHEN mfe >= 0.5 THEN 0.5 ELSE f END, 6) AS result FROM x WHERE f IS NOT NULL")
def w42(spark, d):
    mfe = B.excursions("symbol", "slot", 4)[0]
    x = bars(spark, d).select("symbol", "slot", B.forward("c", "symbol", "slot", 8).alias("f"), mfe.alias("mfe")).where("f IS NOT NULL")
    return rounded(x.select("symbol", "slot", F.when(F.col("mfe") >= 0.5, 0.5).otherwise(F.col("f")).alias("result")))


@query("w44_age_and_batch", f"WITH {BARS}, g AS (SELECT DISTINCT symbol, slot // 4 AS day FROM bars) SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS age, min(day) OVER (PARTITION BY symbol) AS batch FROM g")
def w44(spark, d):
    g = bars(spark, d).select("symbol", F.floor(F.col("slot") / 4).alias("day")).distinct()
    w = Window.partitionBy("symbol")
    return g.select("symbol", "day", (F.row_number().over(w.orderBy("day")) - 1).alias("age"), F.min("day").over(w).alias("batch"))


_CONFIG = "(VALUES ('fast', 0.2, 0.2), ('slow', 1.0, 0.5)) cfg(name, take, stop)"


@query("f08_pluggable_exits", f"WITH {BARS}, r AS (SELECT *, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot)), p AS (SELECT a.symbol, a.slot AS entry, b.i - a.i AS off, b.h / nullif(a.c, 0) - 1 AS up, 1 - b.l / nullif(a.c, 0) AS down FROM r a JOIN r b ON a.symbol = b.symbol AND b.i > a.i AND b.i <= a.i + 12 WHERE a.trades >= 3), m AS (SELECT name, symbol, entry, min(off) FILTER (up >= take) AS t, min(off) FILTER (down >= stop) AS s FROM p, {_CONFIG} GROUP BY ALL) SELECT name, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN 'stop' WHEN t IS NOT NULL THEN 'take' ELSE 'time' END AS status, count(*) AS n FROM m GROUP BY ALL")
def f08(spark, d):
    # exits come as parameter rows; the paths are made once
    path = O.paths(bars(spark, d), "symbol", "slot", 12, F.col("trades") >= 3)
    configs = {"fast": (0.2, 0.2), "slow": (1.0, 0.5)}
    parts = [O.first_touch(path, "symbol", take, stop).select(F.lit(n).alias("name"), "status") for n, (take, stop) in configs.items()]
    return parts[0].unionByName(parts[1]).groupBy("name", "status").agg(F.count("*").alias("n"))


@query("f02_named_bins_by_anchor", f"WITH {PANEL} SELECT 'f1' AS anchor, CASE WHEN f1 < 0 THEN 'down' ELSE 'up' END AS bin, count(*) AS n, round(avg(f3), 6) AS mean FROM panel WHERE f1 IS NOT NULL GROUP BY ALL UNION ALL SELECT 'k', CASE WHEN k < 50 THEN 'down' ELSE 'up' END, count(*), round(avg(f3), 6) FROM panel GROUP BY ALL")
def f02(spark, d):
    bins = {"f1": lambda c: F.when(c < 0, "down").otherwise("up"), "k": lambda c: F.when(c < 50, "down").otherwise("up")}
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("anchor"), F.when(F.col(a).isNotNull(), b(F.col(a))).alias("bin")) for a, b in bins.items())))
    x = panel(spark, d).select("f3", rows.alias("r")).select("f3", "r.*").where("bin IS NOT NULL")
    return rounded(x.groupBy("anchor", "bin").agg(F.count("*").alias("n"), F.avg("f3").alias("mean")))
