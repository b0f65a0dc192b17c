"""Literal cases and invariants of the operators."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.functions import scalars as S
from eventloom.functions import stats
from eventloom.operators import bars as B
from eventloom.operators import detect, outcomes
from eventloom.operators.asof import asof, first_after, prefix_sum_at
from eventloom.operators.ranges import nearest, points_in_intervals
from eventloom.sources import merge, tables


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def pair(spark):
    e = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 5), (4, "c", 1)], "id int, key string, at long")
    f = spark.createDataFrame([("a", 10, 1.0), ("a", 15, 2.0), ("b", 6, 3.0), (None, 1, 9.0)], "key string, at long, v double")
    return e, f


def test_asof_ties_and_bounds(pair):
    e, f = pair
    for slices in (None, 7):
        assert values(asof(e, f, "key", "at", ["v"], slices=slices), "id", "v", "known_at") == [(1, 1.0, 10), (2, 2.0, 15), (3, None, None), (4, None, None)]
        assert values(asof(e, f, "key", "at", ["v"], allow_exact=False, slices=slices), "id", "v") == [(1, None), (2, 2.0), (3, None), (4, None)]
    assert values(asof(e, f, "key", "at", ["v"], tolerance=4), "id", "v")[1] == (2, None)
    assert values(asof(e, f, "key", "at", ["v"], lag=5), "id", "v", "known_at")[:2] == [(1, None, None), (2, 2.0, 15)]


def test_asof_never_looks_ahead(spark, data):
    t = tables.ticks(spark, data)
    out = asof(t.select("event_id", "symbol", "us"), t.where("wt = 'view'").select("symbol", "us", "price"), "symbol", "us", ["price"])
    assert out.where("known_at > us").count() == 0
    assert out.count() == t.count()


def test_first_after(pair):
    e, f = pair
    assert values(first_after(e, f, "key", "at", ["v"]), "id", "v") == [(1, 1.0), (2, None), (3, 3.0), (4, None)]
    assert values(first_after(e, f, "key", "at", ["v"], allow_exact=False), "id", "v")[0] == (1, 2.0)


def test_half_open_interval_sums(pair):
    e, f = pair
    x = e.withColumns({"low": F.col("at"), "high": F.col("at") + 5})
    assert values(prefix_sum_at(x, f, "key", "at", "v", "low", "high"), "id", "sum_v") == [(1, 2.0), (2, 0.0), (3, 3.0), (4, 0.0)]


def test_range_joins(pair, spark):
    e, f = pair
    spans = e.select("id", "key", (F.col("at") - 5).alias("low"), (F.col("at") + 5).alias("high"))
    assert values(points_in_intervals(spans, f, "key", "low", "high", "at", 3), "id", "v") == [(1, 1.0), (1, 2.0), (2, 2.0), (3, 3.0)]
    assert values(points_in_intervals(spans, f, "key", "low", "high", "at", 3, how="left_anti"), "id") == [(4,)]
    g = spark.createDataFrame([("a", 8), ("a", 12)], "key string, at long").withColumn("v", F.col("at"))
    assert values(nearest(e.where("id = 1"), g, "id", "key", "at", ["v"], 5, 5), "near_at") == [(8,)]


def test_cooldown_compares_with_last_kept(spark):
    e = spark.createDataFrame([("a", t) for t in (0, 6, 10, 12, 19, 20, 40)], "key string, at long")
    assert [r[1] for r in values(detect.cooled_down(e, ["key"], "at", 10), "key", "at")] == [0, 10, 20, 40]
    assert [r[1] for r in values(detect.cooled_down(e, ["key"], "at", 10, strict=True), "key", "at")] == [0, 12, 40]


def test_change_guards(spark):
    t = spark.createDataFrame([("a", 4000, 100.0), ("a", 7000, 100.0), ("a", 8000, 105.0), ("a", 10000, 110.0), ("b", 1, float("nan")), ("b", 5000, 1.0)], "key string, at long, px double")
    out = {(r.key, r.at): r.c for r in t.select("*", detect.change_over(F.col("px"), "key", "at", 3000).alias("c")).collect()}
    assert out[("a", 10000)] == pytest.approx(10.0)
    assert out[("a", 4000)] is None and out[("b", 5000)] is None


def test_first_touch_stop_before_take(spark):
    path = spark.createDataFrame([("a", 1, 100.0, 1, 120.0, 80.0, 100.0), ("b", 1, 100.0, 1, 120.0, 99.0, 100.0), ("c", 1, 100.0, 1, 101.0, 99.0, 100.5)], "k string, entry int, px double, offset int, h double, l double, c double")
    assert values(outcomes.first_touch(path, "k", 0.1, 0.1), "k", "status") == [("a", "stop"), ("b", "take"), ("c", "time")]


def test_ema_equals_pandas(spark):
    x = [math.sin(i) + 2 for i in range(700)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "key string, at long, c double")
    got = [r[0] for r in B.with_ema(df, "key", "at", "c", 3).orderBy("at").select("ema_3").collect()]
    assert got == pytest.approx(pd.Series(x).ewm(span=3, adjust=False).mean().tolist())


def test_bh_is_step_up(spark):
    c = spark.createDataFrame([("g", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.9])], "g string, i int, p double")
    out = {r.i: (round(r.q, 4), r["pass"]) for r in stats.bh(c, "p", ["g"], 0.06, ["i"]).collect()}
    assert out == {0: (0.04, True), 2: (0.0533, True), 1: (0.0533, True), 3: (0.9, False)}


def test_q_is_at_least_p_and_uniform_range(spark):
    c = spark.range(200).select(F.lit("g").alias("g"), F.col("id").alias("i"), stats.uniform(F.lit("s"), "id").alias("p"))
    out = stats.bh(c, "p", ["g"], 0.1, ["i"])
    assert out.where("q < p OR p < 0 OR p >= 1").count() == 0


def test_leave_one_out_identity(spark):
    df = spark.createDataFrame([("c", d, float(v)) for d, v in ((1, 1), (1, 3), (2, 5), (3, 7))], "cell string, day int, x double")
    r = stats.leave_one_out(df, ["cell"], "day", "x").first()
    assert (r.groups, r.worst_mean, r.best_mean) == (3, 3.0, 6.0)


def test_symbols_and_buckets(spark):
    cases = {" btc-usdt ": "BTCUSDT", "1000PEPEUSDT": "1000PEPEUSDT", "": None, None: None, "BTC/USDT:USDT": "BTCUSDT", "btc/usdt": "BTCUSDT", "ABCDEFGHIJKLMUSDT": "ABCDEFGHIJKLMUSDT", "BTCUSDC": "BTCUSDCUSDT", "eth": "ETHUSDT", "ABCDEFGHIJKL": "ABCDEFGHIJKLUSDT", "ABCDEFGHIJKLM": "ABCDEFGHIJKLM", " / ": None}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert {r.s: r.x for r in df.select("s", S.symbol(F.col("s")).alias("x")).collect()} == cases
    assert [r[0] for r in df.limit(1).select(S.bucket(F.lit(10.0), [10, 50])).collect()] == ["10-50"]


def test_costs_at_thresholds(spark):
    df = spark.createDataFrame([(None,), (1.4,), (1.5,), (3.0,)], "atr double")
    assert [r[0] for r in df.select(S.round_trip_cost(F.col("atr"))).collect()] == [0.14, 0.14, 0.94, 1.34]


def test_sessions_follow_daylight_saving(spark):
    df = spark.createDataFrame([("2026-03-06 14:30:00",), ("2026-03-09 13:30:00",), ("2026-03-07 12:00:00",), ("2026-10-30 13:29:00",), ("2026-11-02 14:30:00",)], "t string")
    assert [r[0] for r in df.select(S.session(F.to_timestamp("t"))).collect()] == ["rth", "rth", "weekend", "overnight", "rth"]


def test_session_edges_and_holidays(spark):
    # New York is five hours behind; 2024-01-05 is a Friday, 2024-01-15 a holiday
    cases = [("2024-01-05 14:29", "overnight"), ("2024-01-05 14:30", "rth"), ("2024-01-05 20:59", "rth"), ("2024-01-05 21:00", "afterhours"), ("2024-01-06 02:59", "afterhours"), ("2024-01-06 03:00", "weekend"), ("2024-01-07 16:00", "weekend"),
             ("2024-01-08 08:59", "weekend"), ("2024-01-08 09:00", "overnight"), ("2024-01-10 03:00", "overnight"), ("2024-01-15 15:00", "weekend"), ("2024-01-16 04:30", "weekend"), ("2024-01-16 05:00", "overnight")]
    df = spark.createDataFrame(cases, "t string, want string").withColumn("at", F.to_timestamp("t"))
    off = F.to_date(F.from_utc_timestamp("at", "America/New_York")) == F.lit("2024-01-15").cast("date")
    assert [(r.t, r.got) for r in df.select("t", S.session(F.col("at"), off).alias("got")).collect()] == cases


def test_merges(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 10, "b")], "k int, at int, v string")
    new = spark.createDataFrame([(2, 10, "c"), (3, 5, "d"), (3, 6, "e")], "k int, at int, v string")
    assert values(merge.first_wins(old, new, ["k"], [F.col("at")]), "k", "v") == [(1, "a"), (2, "b"), (3, "d")]
    assert values(merge.last_wins(old, new, ["k"], [F.col("at")]), "k", "v") == [(1, "a"), (2, "c"), (3, "e")]


def test_sinks(spark, tmp_path, data):
    e = tables.read(spark, data, "events").withColumn("split", tables.split_of(F.to_date("ts"))).where("split IS NOT NULL")
    merge.write_split(e, f"{tmp_path}/panel")
    dev, holdout = (spark.read.parquet(f"{tmp_path}/panel/split={s}") for s in ("dev", "holdout"))
    assert dev.join(holdout, "event_id").count() == 0 and dev.count() + holdout.count() > 0
    day = e.select("event_id", F.lit("x").alias("name"), F.to_date("ts").alias("dt"))
    merge.write_snapshot(day, f"{tmp_path}/snap", ["name", "dt"])
    merge.write_snapshot(day.where("dt = (SELECT max(dt) FROM VALUES (DATE '2024-01-05') t(dt))"), f"{tmp_path}/snap", ["name", "dt"])
    assert spark.read.parquet(f"{tmp_path}/snap").count() == e.count()
    merge.write_results(e.groupBy("event_type").agg(F.max("value").alias("p")), f"{tmp_path}/cells", "p")
    p = [r.p for r in spark.read.json(f"{tmp_path}/cells").collect()]
    assert len(p) == 5


def test_csv_and_json_reads(spark, tmp_path, data):
    tables.read(spark, data, "nation").write.option("header", True).csv(f"{tmp_path}/nation.csv")
    assert tables.read(spark, str(tmp_path), "nation.csv").count() == 25
    assert tables.column_of(tables.read(spark, data, "nation"), ("x", "n_name")) == "n_name"
    with pytest.raises(ValueError):
        tables.column_of(tables.read(spark, data, "nation"), ("x",))


def test_no_python_in_plans(spark, data):
    from eventloom.plans import QUERIES

    for name in ("flagship_event_study", "j23_asof_chain", "w22_greedy_cooldown", "a09_cluster_bootstrap"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_returns_of_prices_that_are_no_prices(spark):
    rows = [(0.0, 1.0), (2.0, 0.0), (2.0, None), (float("nan"), 1.0), (1.0, float("nan")), (float("inf"), 1.0), (1.0, float("inf")), (None, 1.0), (3.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert [r[0] for r in df.select(S.ret("a", "b")).collect()] == [-1.0, *[None] * 7, 0.5]
    ticks = spark.createDataFrame([(i, "a", i, p) for i, p in enumerate([1.0, 0.0, float("nan"), float("inf"), 2.0, 4.0])], "event_id long, symbol string, us long, price double")
    bars = B.roll_up(ticks, "symbol", "us", 1, "price", F.lit(1), F.lit(True))
    assert values(bars.select("slot", B.change("c", "symbol", "slot", 1).alias("r")), "slot", "r")[1:] == [(1, -1.0), (2, None), (3, None), (4, None), (5, 1.0)]
    path = outcomes.paths(bars, "symbol", "slot", 2, F.lit(True))
    assert outcomes.first_touch(path, "symbol", 0.5, 0.3).where("entry = 1").first().status == "time"


def test_correlation_without_spread_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 3.0), ("b", 3.0, None)], "g string, x double, y double")
    assert values(df.groupBy("g").agg(F.round(stats.correlation("x", "y"), 6).alias("r")).where("g = 'b'"), "r") == [(1.0,)]
    assert df.groupBy("g").agg(stats.correlation("x", "y").alias("r")).where("g = 'a'").first().r is None


def test_quantiles_are_exact(spark):
    import random

    from eventloom.operators.ranks import quantiles

    r = random.Random(8)
    rows = [(g, float(r.choice((1, 2, r.randrange(1000))))) for g in "aabbbbbc" for _ in range(60)] + [("d", 5.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {x.g: (x.a, x.b, x.c) for x in quantiles(df, ["g"], "x", [0.0, 0.37, 1.0], ["a", "b", "c"]).collect()}
    want = {x.g: tuple(x.q) for x in df.where("x IS NOT NULL").groupBy("g").agg(F.percentile("x", F.array(F.lit(0.0), F.lit(0.37), F.lit(1.0))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_replay_of_files_out_of_order(spark, tmp_path, data):
    from eventloom.plans import streams

    e = spark.read.parquet(f"{data}/events.parquet")
    e.orderBy(F.xxhash64("event_id")).repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    whole = R_rows(streams.t05(spark, data))
    assert R_rows(streams.R.drain(streams.R.tumbling_bars(streams.R.event_stream(spark, *streams.R.in_order(spark, f"{tmp_path}/events.parquet")), "1 day", "2 hours"))) == whole and whole


def R_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_unknown_suffix(spark, data):
    with pytest.raises(ValueError):
        tables.read(spark, data, "events.xlsx")


def plain_tree(rows, depth, least):
    """Predictions by cell of a tree on (codes, label, weight, n) cells: at each node the split with the largest loss of weighted Gini impurity."""

    def gini(cells):
        total = sum(w for _, _, w, _ in cells)
        one = sum(w for _, y, w, _ in cells if y)
        return 0.0 if not total else total * 2 * (one / total) * (1 - one / total)

    def grow(cells, left):
        best = None
        for f in range(len(cells[0][0])):
            # sets of values are the beginnings of their order by weight of ones, as the library has it
            rate = {v: sum(c[2] for c in cells if c[0][f] == v and c[1]) for v in {c[0][f] for c in cells}}
            order = sorted(rate, key=rate.get)
            for k in range(1, len(order)):
                low, high = [c for c in cells if c[0][f] in order[:k]], [c for c in cells if c[0][f] in order[k:]]
                if min(sum(c[3] for c in low), sum(c[3] for c in high)) >= least:
                    gain = gini(cells) - gini(low) - gini(high)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, low, high
        if best is None or not left:
            one, total = sum(w for _, y, w, _ in cells if y), sum(w for _, _, w, _ in cells)
            return {c[0]: float(2 * one > total) for c in cells}
        return {**grow(best[1], left - 1), **grow(best[2], left - 1)}

    return grow(rows, depth)


def test_decision_tree_equals_a_plain_one(spark, data):
    from eventloom.plans import QUERIES
    from eventloom.plans.aggregates import features

    x = features(spark, data).toPandas()
    names, share = ["kind", "tier", "hour"], x.win.mean()
    codes = {f: {v: i for i, v in enumerate(sorted(x[f].unique(), key=lambda v, f=f: (-(x[f] == v).sum(), v)))} for f in names}
    cells = [(tuple(codes[f][v] for f, v in zip(names, key[:3], strict=True)), key[3], len(g) * (0.5 / share if key[3] else 0.5 / (1 - share)), len(g)) for key, g in x.groupby([*names, "win"])]
    want = plain_tree(cells, 4, 10)
    got = {tuple(codes[f][r[f]] for f in names): r.prediction for r in QUERIES["a50_decision_tree"](spark, data).collect()}
    assert got == want and len(set(want.values())) == 2


def test_bootstrap_weighs_digests_as_uniforms_in_many_tasks(spark):
    import math

    from eventloom.functions import stats

    bounds, p, total = [], 0.36787944117144233, 0.0
    for k in range(7):
        total += p
        bounds.append(total)
        p /= k + 1
    edges = sorted({0, 2**32 - 1} | {math.ceil(b * 2**32) + d for b in bounds for d in (-1, 0, 1)})
    digests = spark.createDataFrame([(v, f"{v:08x}" + tail) for v in edges for tail in ("0" * 24, "f" * 24)], "v long, digest string")
    got = digests.select("v", stats._poisson(F.col("digest")).alias("w")).collect()
    assert all(r.w == sum(r.v / 2**32 >= b for b in bounds) for r in got)
    # few bytes, much work: a table of one partition is dealt out
    rows = spark.range(0, 3000, 1, 1).select("id", F.lit("c").alias("c"), (F.col("id") % 7 - 2.5).alias("x"))
    out = stats.row_bootstrap(rows, ["c"], "id", "x", 5, "s")
    spread = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("u", stats.uniform(F.lit("s"), "rep", "id"))
    weight = sum((F.col("u") >= b).cast("int") for b in bounds)
    means = [r.m for r in spread.withColumn("w", weight).groupBy("rep").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m")).collect()]
    r = out.first()
    assert r.reps == 5 and abs(r.p - sum(m <= 0 for m in means) / 5) < 1e-9 and min(means) - 1e-9 <= r.low <= r.high <= max(means) + 1e-9
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
