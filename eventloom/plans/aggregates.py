"""Queries over cell statistics, resampling and table profiles (A rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.scalars import bucket, ret, share
from ..operators import bars as B
from ..operators.ranks import quantiles, weighted_quantiles, with_weight_before
from ..operators.shuffles import dealt, dealt_sql
from ..operators.slices import joined_back
from ..sources import tables
from .panels import bars, panel, rounded
from .registry import BARS, EV, PANEL, query

P1 = PANEL + ", p AS (SELECT * FROM panel WHERE f1 IS NOT NULL)"


def returns(spark, d):
    return panel(spark, d).where("f1 IS NOT NULL")


def erfc_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * ({x})))"
    return f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({x}) * ({x})))"


def uniform_sql(*parts: str) -> str:
    hexed = f"substr(md5(concat_ws('|', {', '.join(f'({p})::VARCHAR' for p in parts)})), 1, 8)"
    return f"(('0x' || {hexed})::BIGINT::DOUBLE / 4294967296.0)"


@query("a01_cell_summary", f"WITH {P1} SELECT wt, count(*) AS n, round(avg(f1), 6) AS mean, round(median(f1), 6) AS median, round(avg((f1 > 0)::INT), 6) AS win FROM p GROUP BY 1 HAVING count(*) >= 5")
def a01(spark, d):
    # a kind holds a fifth of all rows, so its median is not left to one task
    p = panel(spark, d).select("wt", "f1")
    g = p.groupBy("wt").agg(*S.summary("f1")).where("n >= 5")
    return rounded(g.join(quantiles(p, ["wt"], "f1", [0.5], ["median"]), "wt").select("wt", "n", "mean", "median", "win"))


@query("a02_one_sample_t", f"WITH {P1} SELECT symbol, count(*) AS n, round(CASE WHEN stddev_samp(f1) > 0 THEN avg(f1) / (stddev_samp(f1) / sqrt(count(*))) END, 5) AS t FROM p GROUP BY 1")
def a02(spark, d):
    return rounded(returns(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), S.one_sample_t("f1").alias("t")), 5)


@query("a03_cluster_robust_t", f"WITH {P1}, m AS (SELECT wt, avg(f1) AS m, count(*) AS n FROM p GROUP BY 1), g AS (SELECT wt, day, sum(f1 - m) AS e FROM p JOIN m USING (wt) GROUP BY ALL) SELECT wt, any_value(n) AS n, count(*) AS clusters, round(any_value(m), 6) AS mean, round(any_value(m) / (sqrt(sum(e * e)) / any_value(n)), 5) AS t FROM g JOIN m USING (wt) GROUP BY 1")
def a03(spark, d):
    return S.clustered_t(returns(spark, d), ["wt"], "day", "f1").select("wt", "n", "clusters", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


@query("a04_cluster_mean_t", f"WITH {P1}, g AS (SELECT wt, day, avg(f1) AS m FROM p GROUP BY ALL) SELECT wt, count(*) AS clusters, round(avg(m), 6) AS mean, round(CASE WHEN count(*) >= 3 THEN avg(m) / (stddev_samp(m) / sqrt(count(*))) END, 5) AS t FROM g GROUP BY 1")
def a04(spark, d):
    return S.cluster_mean_t(returns(spark, d), ["wt"], "day", "f1").select("wt", "clusters", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


_CELLS = "WITH " + P1 + f", c AS (SELECT wt, symbol % 10 AS tier, count(*) AS n, avg(x) / nullif(stddev_samp(x) / sqrt(count(x)), 0) AS t FROM (SELECT *, ln(nullif(1 + f1, 0)) AS x FROM p) GROUP BY ALL HAVING count(*) >= 30), z AS (SELECT *, round({erfc_sql('abs(t) / sqrt(2.0)')}, 6) AS pv FROM c)"


def cells(spark, d):
    p = returns(spark, d).withColumn("x", F.log(1 + F.col("f1")))
    c = p.groupBy("wt", (F.col("symbol") % 10).alias("tier")).agg(F.count("*").alias("n"), S.one_sample_t("x").alias("t")).where("n >= 30")
    return c.withColumn("pv", F.round(S.normal_p(F.col("t")), 6))


@query("a05_normal_p_values", _CELLS + " SELECT wt, tier, n, round(t, 5) AS t, pv FROM z")
def a05(spark, d):
    return cells(spark, d).select("wt", "tier", "n", F.round("t", 5).alias("t"), "pv")


@query("a06_fdr", _CELLS + ", r AS (SELECT *, row_number() OVER (PARTITION BY wt ORDER BY pv, tier) AS r, count(*) OVER (PARTITION BY wt) AS m FROM z) SELECT wt, tier, round(least(1.0, min(pv * m / r) OVER (PARTITION BY wt ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q, coalesce(r <= max(CASE WHEN pv <= r * 0.5 / m THEN r END) OVER (PARTITION BY wt), false) AS pass FROM r")
def a06(spark, d):
    # a row per cell, so each window is as small as the grid
    return S.bh(cells(spark, d), "pv", ["wt"], 0.5, ["tier"]).select("wt", "tier", F.round("q", 6).alias("q"), "pass")


_POISSON = []
_p, _total = 0.36787944117144233, 0.0
for _k in range(7):
    _total += _p
    _POISSON.append(f"WHEN u < {_total!r} THEN {_k}")
    _p /= _k + 1


def _bootstrap_sql(cluster: str, seed: str) -> str:
    return f"""WITH {P1}, g AS (SELECT wt, {cluster} AS cl, sum(f1) AS s, count(f1) AS n FROM p GROUP BY ALL), x AS (SELECT *, unnest(range(1, 101)) AS rep FROM g), y AS (SELECT *, {uniform_sql("'" + seed + "'", 'rep', 'cl')} AS u FROM x),
w AS (SELECT *, CASE {' '.join(_POISSON)} ELSE 7 END AS w FROM y), m AS (SELECT wt, rep, sum(s * w) / nullif(sum(n * w), 0) AS m FROM w GROUP BY ALL)
SELECT wt, count(m) AS reps, round(avg((m <= 0)::INT), 6) AS p, round(quantile_cont(m, 0.05), 5) AS low, round(quantile_cont(m, 0.95), 5) AS high FROM m GROUP BY 1"""


@query("a08_bootstrap", _bootstrap_sql("event_id", "rows"))
def a08(spark, d):
    return S.row_bootstrap(returns(spark, d), ["wt"], "event_id", "f1", 100, "rows").select("wt", "reps", F.round("p", 6).alias("p"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("a09_cluster_bootstrap", _bootstrap_sql("symbol", "symbols"))
def a09(spark, d):
    return S.cluster_bootstrap(returns(spark, d), ["wt"], "symbol", "f1", 100, "symbols").select("wt", "reps", F.round("p", 6).alias("p"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("a10_block_bootstrap", f"""WITH {P1}, s AS (SELECT wt, day, avg(f1) AS x FROM p GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY wt ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY wt) AS n FROM s),
k AS (SELECT wt, n, rep, unnest(range(0, (n + 4) // 5)) AS b FROM (SELECT DISTINCT wt, n FROM i), range(1, 51) r(rep)), st AS (SELECT *, floor({uniform_sql("'block'", 'rep', 'b', 'wt')} * n)::BIGINT AS a FROM k), pk AS (SELECT wt, rep, (a + o) % n AS i FROM st, range(0, 5) z(o) WHERE b * 5 + o < n),
m AS (SELECT wt, rep, avg(x) AS m FROM pk JOIN i USING (wt, i) GROUP BY ALL), e AS (SELECT wt, any_value(n) AS n, corr(x, l) AS rho FROM (SELECT *, lag(x) OVER (PARTITION BY wt ORDER BY i) AS l FROM i) GROUP BY 1)
SELECT wt, round(avg((m <= 0)::INT), 6) AS p, round(any_value(least(n, n / greatest(1 + 2 * rho, 1e-9))), 4) AS n_eff FROM m JOIN e USING (wt) GROUP BY 1""")
def a10(spark, d):
    # a series of day means per kind: blocks of five days from hashed starts, as many as fill the series' length, joined by index
    s = returns(spark, d).groupBy("wt", "day").agg(F.avg("f1").alias("x"))
    w = Window.partitionBy("wt")
    i = s.select("wt", "x", (F.row_number().over(w.orderBy("day")) - 1).alias("i"), F.count("*").over(w).alias("n"), F.lag("x").over(w.orderBy("day")).alias("l"))
    sizes = i.groupBy("wt").agg(F.max("n").alias("n"), S.correlation("x", "l").alias("rho"))
    starts = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("b", F.explode(F.sequence(F.lit(0), ((F.col("n") + 4) / 5).cast("int") - 1)))
    at = starts.withColumn("a", F.floor(S.uniform(F.lit("block"), "rep", "b", "wt") * F.col("n"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("b * 5 + o < n").select("wt", "rep", ((F.col("a") + F.col("o")) % F.col("n")).alias("i"))
    m = at.join(i.select("wt", "i", "x"), ["wt", "i"]).groupBy("wt", "rep").agg(F.avg("x").alias("m"))
    out = m.groupBy("wt").agg(F.avg((F.col("m") <= 0).cast("int")).alias("p")).join(sizes, "wt")
    return out.select("wt", F.round("p", 6).alias("p"), F.round(F.least(F.col("n"), F.col("n") / F.greatest(1 + 2 * F.col("rho"), F.lit(1e-9))), 4).alias("n_eff"))


def _flips_sql(cluster: str, reps: int, seed: str, cell: str = "wt") -> str:
    return f"g AS (SELECT {cell} AS cell, {cluster} AS cl, sum(f1) AS s FROM p GROUP BY ALL), x AS (SELECT *, unnest(range(0, {reps + 1})) AS rep FROM g), t AS (SELECT cell, rep, sum(s * CASE WHEN rep = 0 OR {uniform_sql(chr(39) + seed + chr(39), 'rep', 'cl')} < 0.5 THEN 1 ELSE -1 END) AS total, sqrt(sum(s * s)) AS norm FROM x GROUP BY ALL)"


@query("a11_sign_flip_permutation", f"WITH {P1}, {_flips_sql('day', 200, 'flip')} SELECT a.cell AS wt, round((sum((abs(b.total) >= abs(a.total) - 1e-9)::INT) + 1) / 201.0, 6) AS p FROM t a JOIN t b ON a.cell = b.cell AND a.rep = 0 AND b.rep > 0 GROUP BY 1")
def a11(spark, d):
    t = S.sign_flips(returns(spark, d), ["wt"], "day", "f1", 200, "flip")
    own = F.max(F.when(F.col("rep") == 0, F.abs("total"))).over(Window.partitionBy("wt"))
    t = t.withColumn("own", own).where("rep > 0")
    return rounded(t.groupBy("wt").agg(((F.count_if(F.abs("total") >= F.col("own") - 1e-9) + 1) / 201.0).alias("p")))


@query("a12_label_shuffle_in_group", f"""WITH RECURSIVE {P1}, b AS (SELECT event_id, day, f1, (k >= 50)::INT AS high FROM p), {dealt_sql("b", "day", "event_id", "high", 20, "shuffle")}
SELECT rep, round(avg(CASE WHEN dealt = 1 THEN f1 END) - avg(CASE WHEN dealt = 0 THEN f1 END), 6) AS spread FROM rows_dealt GROUP BY 1""")
def a12(spark, d):
    # labels are dealt out anew inside each day, with as many in each leg as before
    b = returns(spark, d).select("event_id", "day", "f1", (F.col("k") >= 50).cast("int").alias("high"))
    leg = lambda n: F.avg(F.when(F.col("dealt") == n, F.col("f1")))
    return rounded(dealt(b, ["day"], "event_id", "high", 20, "shuffle").groupBy("rep").agg((leg(1) - leg(0)).alias("spread")))


@query("a13_max_t_over_cells", f"WITH {P1}, {_flips_sql('day', 100, 'maxt', 'wt || (symbol % 3)::VARCHAR')}, z AS (SELECT rep, max(abs(total / nullif(norm, 0))) AS mx FROM t GROUP BY 1) SELECT a.cell, round(a.total / nullif(a.norm, 0), 5) AS t, round((sum((b.mx >= abs(a.total / nullif(a.norm, 0)) - 1e-9)::INT) + 1) / 101.0, 6) AS p FROM t a JOIN z b ON a.rep = 0 AND b.rep > 0 GROUP BY ALL")
def a13(spark, d):
    p = returns(spark, d).withColumn("cell", F.concat("wt", (F.col("symbol") % 3).cast("string")))
    t = S.sign_flips(p, ["cell"], "day", "f1", 100, "maxt").withColumn("t", F.try_divide("total", "norm"))
    null = t.where("rep > 0").groupBy("rep").agg(F.max(F.abs("t")).alias("mx"))  # a row per replicate
    x = t.where("rep = 0").select("cell", "t").crossJoin(F.broadcast(null))
    return x.groupBy("cell", "t").agg(F.round((F.count_if(F.col("mx") >= F.abs("t") - 1e-9) + 1) / 101.0, 6).alias("p")).select("cell", F.round("t", 5).alias("t"), "p")


@query("a15_placebo_times", f"WITH {EV}, e AS (SELECT event_id, symbol, us, price, unnest([0, -2, 2]) AS shift FROM ev WHERE wt = 'purchase'), t AS (SELECT *, us + shift * 86400000000 AS t0 FROM e), x AS (SELECT t.*, a.price AS p0 FROM t ASOF LEFT JOIN ev a ON t.symbol = a.symbol AND t.t0 >= a.us), y AS (SELECT x.*, b.price AS p1 FROM (SELECT *, t0 + 86400000000 AS t1 FROM x) x ASOF LEFT JOIN ev b ON x.symbol = b.symbol AND x.t1 >= b.us) SELECT shift, count(*) AS n, round(avg(p1 / nullif(p0, 0) - 1), 6) AS mean FROM y WHERE p0 IS NOT NULL GROUP BY 1")
def a15(spark, d):
    from ..operators.asof import asof

    t = tables.ticks(spark, d)
    e = t.where("wt = 'purchase'").select("event_id", "symbol", F.col("us").alias("own"), F.explode(F.array(*map(F.lit, (0, -2, 2)))).alias("shift"))
    q = t.select("symbol", "us", "price")
    x = asof(e.withColumn("us", F.col("own") + F.col("shift") * B.DAY), q, "symbol", "us", ["price"], known="k0", prefix="a_").withColumn("us", F.col("us") + B.DAY)
    y = asof(x, q, "symbol", "us", ["price"], known="k1", prefix="b_").where("a_price IS NOT NULL")
    return rounded(y.groupBy("shift").agg(F.count("*").alias("n"), F.avg(ret("b_price", "a_price")).alias("mean")))


_LOO = "WITH " + P1 + ", g AS (SELECT wt, day, sum(f1) AS s, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, (sum(s) OVER (PARTITION BY wt) - s) / nullif(sum(n) OVER (PARTITION BY wt) - n, 0) AS rest FROM g)"


@query("a16_leave_one_group_out", _LOO + " SELECT wt, count(*) AS groups, round(min(rest), 6) AS worst_mean, arg_min(day, rest) AS worst_group, round(max(rest), 6) AS best_mean, round(arg_max(rest, s), 6) AS drop_top_mean FROM r GROUP BY 1")
def a16(spark, d):
    return rounded(S.leave_one_out(returns(spark, d), ["wt"], "day", "f1"))


@query("a17_concentration", "WITH " + P1 + ", g AS (SELECT wt, symbol, sum(f1) AS s FROM p GROUP BY ALL) SELECT wt, arg_max(symbol, s) AS top_group, round(max(s) / sum(s), 6) AS signed_share, round(max(abs(s)) / sum(abs(s)), 6) AS absolute_share, round(max(greatest(s, 0)) / sum(greatest(s, 0)), 6) AS positive_share FROM g GROUP BY 1")
def a17(spark, d):
    return rounded(S.concentration(returns(spark, d), ["wt"], "symbol", "f1"))


@query("a18_day_statistics", f"WITH {P1}, g AS (SELECT wt, day, avg(f1) AS m FROM p GROUP BY ALL) SELECT wt, count(*) AS days, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(avg((m > 0)::INT), 6) AS positive, arg_min(day, m) AS worst_day, arg_max(day, m) AS best_day FROM g GROUP BY 1")
def a18(spark, d):
    g = returns(spark, d).groupBy("wt", "day").agg(F.avg("f1").alias("m")).groupBy("wt")
    return rounded(g.agg(F.count("*").alias("days"), F.avg("m").alias("mean"), F.median("m").alias("median"), F.avg((F.col("m") > 0).cast("int")).alias("positive"), F.min_by("day", "m").alias("worst_day"), F.max_by("day", "m").alias("best_day")))


@query("a19_monthly_breakdown", "SELECT o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg(o_totalprice), 2) AS mean, count(*) >= 30 AS counted FROM orders GROUP BY ALL")
def a19(spark, d):
    o = tables.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return o.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"), (F.count("*") >= 30).alias("counted"))


@query("a20_paired_excess", f"WITH {P1} SELECT day, round(avg(f1) FILTER (k >= 80) - avg(f1), 6) AS excess, count(*) FILTER (k >= 80) AS n FROM p GROUP BY 1")
def a20(spark, d):
    own = F.when(F.col("k") >= 80, F.col("f1"))
    return rounded(returns(spark, d).groupBy("day").agg((F.avg(own) - F.avg("f1")).alias("excess"), F.count(own).alias("n")))


@query("a21_cohort_excess", f"WITH {P1} SELECT wt, round(avg(f1) - (SELECT avg(f1) FROM p), 6) AS excess FROM p GROUP BY 1")
def a21(spark, d):
    # sums per cohort give the baseline too
    g = returns(spark, d).groupBy("wt").agg(F.sum("f1").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy()
    return rounded(g.select("wt", (F.col("s") / F.col("n") - F.sum("s").over(w) / F.sum("n").over(w)).alias("excess")))


@query("a22_imputation_bounds", f"WITH {PANEL}, q AS (SELECT least(quantile_cont(f1, 0.01), -0.5) AS worst FROM panel), s AS (SELECT wt, unnest(['dropped', 'zero', 'worst']) AS scenario, f1, worst FROM panel, q) SELECT wt, scenario, count(CASE WHEN scenario = 'dropped' THEN f1 ELSE 1 END) AS n, round(avg(CASE scenario WHEN 'dropped' THEN f1 WHEN 'zero' THEN coalesce(f1, 0) ELSE coalesce(f1, worst) END), 6) AS mean FROM s GROUP BY ALL")
def a22(spark, d):
    p = panel(spark, d).select("wt", "f1")
    q = quantiles(p, [], "f1", [0.01], ["low"]).select(F.least("low", F.lit(-0.5)).alias("worst"))  # one row
    fills = F.array(*(F.struct(F.lit(n).alias("scenario"), v.alias("x")) for n, v in (("dropped", F.col("f1")), ("zero", F.coalesce("f1", F.lit(0.0))), ("worst", F.coalesce("f1", "worst")))))
    s = p.crossJoin(F.broadcast(q)).select("wt", F.explode(fills).alias("s")).select("wt", "s.*")
    return rounded(s.groupBy("wt", "scenario").agg(F.count("x").alias("n"), F.avg("x").alias("mean")))


@query("a23_distribution_profile", f"WITH {P1} SELECT wt, round(quantile_cont(f1, 0.05), 6) AS p5, round(quantile_cont(f1, 0.25), 6) AS p25, round(quantile_cont(f1, 0.5), 6) AS p50, round(quantile_cont(f1, 0.75), 6) AS p75, round(quantile_cont(f1, 0.95), 6) AS p95, round(avg((f1 > 0)::INT), 6) AS positive FROM p GROUP BY 1")
def a23(spark, d):
    points, names = [0.05, 0.25, 0.5, 0.75, 0.95], ["p5", "p25", "p50", "p75", "p95"]
    p = returns(spark, d).select("wt", "f1")
    g = p.groupBy("wt").agg(F.avg((F.col("f1") > 0).cast("int")).alias("positive"))
    return rounded(quantiles(p, ["wt"], "f1", points, names).join(g, "wt").select("wt", *names, "positive"))


@query("a24_trimmed_and_winsorised", f"WITH {P1}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY f1, event_id) AS r, floor(count(*) OVER (PARTITION BY day) * 0.05) AS cut, count(*) OVER (PARTITION BY day) AS n FROM p), q AS (SELECT day, quantile_cont(f1, 0.1) AS a, quantile_cont(f1, 0.9) AS b FROM p GROUP BY 1) SELECT day, round(avg(f1) FILTER (r > cut AND r <= n - cut), 6) AS trimmed, round(avg(least(greatest(f1, a), b)), 6) AS winsorised FROM r JOIN q USING (day) GROUP BY 1")
def a24(spark, d):
    # rows are counted per value, and a value keeps as many as lie between the cuts
    p = returns(spark, d).select("day", "f1")
    placed = with_weight_before(p.groupBy("day", "f1").agg(F.count("*").alias("n")), ["day"], "f1", "n")
    cut = F.floor(F.col("__total") * 0.05)
    kept = F.greatest(F.least(F.col("__before") + F.col("n"), F.col("__total") - cut) - F.greatest("__before", cut), F.lit(0))
    x = placed.withColumn("kept", kept).join(quantiles(p, ["day"], "f1", [0.1, 0.9], ["a", "b"]), "day")
    mean = lambda v, n: F.try_divide(F.sum(v * F.col(n)), F.sum(n))
    return rounded(x.groupBy("day").agg(mean(F.col("f1"), "kept").alias("trimmed"), mean(F.least(F.greatest("f1", "a"), "b"), "n").alias("winsorised")))


_RANKED = P1 + ", k AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY k) + (count(*) OVER (PARTITION BY day, k) - 1) / 2.0 AS a, rank() OVER (PARTITION BY day ORDER BY f1) + (count(*) OVER (PARTITION BY day, f1) - 1) / 2.0 AS b FROM p)"


@query("a25_spearman_by_day", f"WITH {_RANKED} SELECT day, count(*) AS n, round(corr(a, b), 6) AS ic FROM k GROUP BY 1 HAVING count(*) >= 6")
def a25(spark, d):
    r = S.with_average_ranks(returns(spark, d), ["day"], ["k", "f1"])
    return rounded(r.groupBy("day").agg(F.count("*").alias("n"), S.correlation("rank_k", "rank_f1").alias("ic")).where("n >= 6"))


@query("a26_mean_rank_ic", f"WITH {_RANKED}, i AS (SELECT day, corr(a, b) AS ic FROM k GROUP BY 1 HAVING count(*) >= 6) SELECT count(*) AS days, round(avg(ic), 6) AS mean_ic, round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 5) AS t FROM i")
def a26(spark, d):
    r = S.with_average_ranks(returns(spark, d), ["day"], ["k", "f1"])
    i = r.groupBy("day").agg(F.count("*").alias("n"), S.correlation("rank_k", "rank_f1").alias("ic")).where("n >= 6")
    return i.agg(F.count("*").alias("days"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(S.one_sample_t("ic"), 5).alias("t"))


@query("a27_regression", f"WITH {P1} SELECT wt, round(corr(f1, k), 6) AS r, round(regr_slope(f1, k), 6) AS slope, round(regr_intercept(f1, k), 6) AS intercept, round(regr_r2(f1, k), 6) AS r2 FROM p GROUP BY 1")
def a27(spark, d):
    g = returns(spark, d).groupBy("wt")
    return rounded(g.agg(S.correlation("f1", "k").alias("r"), F.regr_slope("f1", "k").alias("slope"), F.regr_intercept("f1", "k").alias("intercept"), F.regr_r2("f1", "k").alias("r2")))


_MKT = BARS + ", r AS (SELECT symbol, slot, c/ nullif(o, 0) - 1 AS x FROM bars), s AS (SELECT slot, sum(x) AS t, count(*) AS n FROM r GROUP BY 1), y AS (SELECT symbol, slot, x, (t - x) / (n - 1) AS m FROM r JOIN s USING (slot) WHERE n >= 10)"


def market(spark, d):
    r = bars(spark, d).select("symbol", "slot", (ret("c", "o")).alias("x"))
    s = r.groupBy("slot").agg(F.sum("x").alias("t"), F.count("*").alias("n")).where("n >= 10")
    return r.join(s, "slot").select("symbol", "slot", "x", ((F.col("t") - F.col("x")) / (F.col("n") - 1)).alias("m"))


@query("a28_betas", f"WITH {_MKT} SELECT symbol, count(*) AS n, round(CASE WHEN count(*) >= 30 AND regr_slope(x, m) IS NOT NULL THEN least(greatest(regr_slope(x, m), -0.5), 3.0) ELSE 1.0 END, 5) AS beta FROM y GROUP BY 1")
def a28(spark, d):
    slope = F.regr_slope("x", "m")
    return rounded(market(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.when((F.count("*") >= 30) & slope.isNotNull(), F.least(F.greatest(slope, F.lit(-0.5)), F.lit(3.0))).otherwise(1.0).alias("beta")), 5)


@query("a30_beta_variants", f"WITH {_MKT}, b AS (SELECT symbol, least(greatest(coalesce(regr_slope(x, m), 1.0), -0.5), 3.0) AS beta FROM y GROUP BY 1) SELECT y.symbol, round(avg(x), 6) AS raw, round(avg(x - m), 6) AS beta_one, round(avg(x - beta * m), 5) AS own_beta FROM y JOIN b USING (symbol) GROUP BY 1")
def a30(spark, d):
    y = market(spark, d)
    b = y.groupBy("symbol").agg(F.least(F.greatest(F.coalesce(F.regr_slope("x", "m"), F.lit(1.0)), F.lit(-0.5)), F.lit(3.0)).alias("beta"))
    g = y.join(b, "symbol").groupBy("symbol")
    return g.agg(F.round(F.avg("x"), 6).alias("raw"), F.round(F.avg(F.col("x") - F.col("m")), 6).alias("beta_one"), F.round(F.avg(F.col("x") - F.col("beta") * F.col("m")), 5).alias("own_beta"))


@query("a31_market_mean", f"WITH {BARS} SELECT slot, count(*) AS names, round(avg(c/ nullif(o, 0) - 1), 6) AS market FROM bars GROUP BY 1")
def a31(spark, d):
    return rounded(bars(spark, d).groupBy("slot").agg(F.count("*").alias("names"), F.avg(ret("c", "o")).alias("market")))


@query("a32_lead_lag", f"WITH {_MKT}, l AS (SELECT symbol, m, x AS x0, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM y WINDOW w AS (PARTITION BY symbol ORDER BY slot)), u AS (SELECT symbol, unnest([0, 1, 2]) AS lag, m, unnest([x0, x1, x2]) AS x FROM l), c AS (SELECT symbol, lag, count(x) AS n, corr(m, x) AS r FROM u WHERE x IS NOT NULL GROUP BY ALL HAVING count(x) >= 20) SELECT lag, sum(n)::BIGINT AS n, round(sum(n * r) / sum(n), 6) AS pooled FROM c GROUP BY 1")
def a32(spark, d):
    w = Window.partitionBy("symbol").orderBy("slot")
    y = market(spark, d)
    y = y.withColumns({"x0": F.col("x"), "x1": F.lead("x", 1).over(w), "x2": F.lead("x", 2).over(w)})
    leads = F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"x{k}").alias("x")) for k in (0, 1, 2)))
    u = y.select("symbol", "m", F.explode(leads).alias("l")).select("symbol", "m", "l.*").where("x IS NOT NULL")
    c = u.groupBy("symbol", "lag").agg(F.count("x").alias("n"), S.correlation("m", "x").alias("r")).where("n >= 20")
    return rounded(c.groupBy("lag").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("r")) / F.sum("n")).alias("pooled")))


@query("a37_cell_grid", f"WITH {PANEL}, u AS (SELECT wt, CASE WHEN k >= 67 THEN 'high' WHEN k >= 34 THEN 'mid' ELSE 'low' END AS tier, unnest([1, 3]) AS horizon, unnest([f1, f3]) AS f FROM panel), s AS (SELECT *, unnest([1, -1]) AS side FROM u WHERE f IS NOT NULL) SELECT coalesce(wt, 'ALL') AS wt, coalesce(tier, 'ALL') AS tier, horizon, side, count(*) AS n, round(avg(side * f), 6) AS mean FROM s GROUP BY GROUPING SETS ((wt, tier, horizon, side), (wt, horizon, side), (tier, horizon, side), (horizon, side))")
def a37(spark, d):
    tier = F.when(F.col("k") >= 67, "high").when(F.col("k") >= 34, "mid").otherwise("low")
    h = F.explode(F.array(*(F.struct(F.lit(i).alias("horizon"), F.col(f"f{i}").alias("f")) for i in (1, 3))))
    u = panel(spark, d).select("wt", tier.alias("tier"), h.alias("h")).select("wt", "tier", "h.*").where("f IS NOT NULL")
    u = u.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    keys = ["wt", "tier", "horizon", "side"]
    g = u.groupingSets([keys, ["wt", "horizon", "side"], ["tier", "horizon", "side"], ["horizon", "side"]], *keys)
    return rounded(g.agg(F.count("*").alias("n"), F.avg(F.col("side") * F.col("f")).alias("mean")).withColumns({c: F.coalesce(c, F.lit("ALL")) for c in ("wt", "tier")}))


@query("a38_distinct_counts", f"WITH {EV} SELECT wt, count(DISTINCT symbol) AS symbols, count(DISTINCT us // 86400000000) AS days, count(*) AS n FROM ev GROUP BY 1")
def a38(spark, d):
    return tables.ticks(spark, d).groupBy("wt").agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct(F.floor(F.col("us") / B.DAY)).alias("days"), F.count("*").alias("n"))


@query("a40_roll_up", f"WITH {BARS} SELECT symbol, slot, o, h, l, c, v, round(qv, 4) AS qv, trades, taker_v, round(taker_qv, 4) AS taker_qv FROM bars")
def a40(spark, d):
    return rounded(bars(spark, d), 4).select("symbol", "slot", *(F.col(c) for c in ("o", "h", "l", "c", "v", "qv", "trades", "taker_v", "taker_qv")))


@query("a41_session_panel", f"WITH {EV}, d AS (SELECT symbol, us // 86400000000 AS day, count(*) AS n, arg_min(price, us) AS open, arg_max(price, us) AS close, arg_min(price, us) FILTER (us % 86400000000 >= 43200000000) AS noon, sum(price * k) AS qv FROM ev GROUP BY ALL HAVING count(*) >= 2) SELECT symbol, day, open, close, noon, round(qv, 4) AS qv, round(close / nullif(open, 0) - 1, 6) AS r_open_close, round(open / nullif(lag(close) OVER w, 0) - 1, 6) AS overnight FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)")
def a41(spark, d):
    t = tables.ticks(spark, d)
    late = F.when(F.col("us") % B.DAY >= 12 * B.HOUR, F.col("us"))
    s = t.groupBy("symbol", F.floor(F.col("us") / B.DAY).alias("day")).agg(F.count("*").alias("n"), F.min_by("price", "us").alias("open"), F.max_by("price", "us").alias("close"), F.min_by("price", late).alias("noon"), F.round(F.sum(F.col("price") * F.col("k")), 4).alias("qv")).where("n >= 2")
    w = Window.partitionBy("symbol").orderBy("day")
    return s.select("symbol", "day", "open", "close", "noon", "qv", F.round(ret("close", "open"), 6).alias("r_open_close"), F.round(ret("open", F.lag("close").over(w)), 6).alias("overnight"))


_EQ = P1 + ", s AS (SELECT wt, day, sum(f1) AS r FROM p GROUP BY ALL), c AS (SELECT *, sum(r) OVER w AS eq, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY wt ORDER BY day)), k AS (SELECT *, greatest(0.0, max(eq) OVER (PARTITION BY wt ORDER BY day)) AS peak FROM c)"


@query("a44_equity_statistics", f"WITH {_EQ} SELECT wt, count(*) AS n, round(sum(r), 5) AS total, round(max(peak - eq), 5) AS drawdown, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*)), 5) AS sharpe, round(max(r), 5) AS best, round(min(r), 5) AS worst FROM k GROUP BY 1")
def a44(spark, d):
    s = returns(spark, d).groupBy("wt", "day").agg(F.sum("f1").alias("r"))
    w = Window.partitionBy("wt").orderBy("day")
    k = s.withColumn("eq", F.sum("r").over(w)).withColumn("peak", F.greatest(F.lit(0.0), F.max("eq").over(w)))
    return rounded(k.groupBy("wt").agg(F.count("*").alias("n"), F.sum("r").alias("total"), F.max(F.col("peak") - F.col("eq")).alias("drawdown"), (F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.count("*"))).alias("sharpe"), F.max("r").alias("best"), F.min("r").alias("worst")), 5)


@query("a45_concurrent_positions", f"WITH {EV}, m AS (SELECT wt, us AS t0, 1 AS d FROM ev UNION ALL SELECT wt, us + 86400000000, -1 FROM ev), s AS (SELECT wt, sum(d) OVER (PARTITION BY wt ORDER BY t0, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM m) SELECT wt, max(open)::BIGINT AS most FROM s GROUP BY 1")
def a45(spark, d):
    # opens and closes are summed per instant first; closes come before opens at the same one. A day's balance is carried over as one row, so the
    # running sums are those of a kind's day, never of a kind
    t = tables.ticks(spark, d)
    moves = t.select("wt", F.col("us").alias("at"), F.lit(1).alias("d")).unionByName(t.select("wt", (F.col("us") + B.DAY).alias("at"), F.lit(-1).alias("d")))
    g = moves.groupBy("wt", "at", "d").agg(F.sum("d").alias("n"))
    g = g.withColumn("day", F.floor(F.col("at") / B.DAY))
    days = g.groupBy("wt", "day").agg(F.sum("n").alias("net"))
    days = days.select("wt", "day", (F.sum("net").over(Window.partitionBy("wt").orderBy("day")) - F.col("net")).alias("start"))
    within = F.sum("n").over(Window.partitionBy("wt", "day").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0))
    peaks = g.select("wt", "day", within.alias("open")).groupBy("wt", "day").agg(F.max("open").alias("open"))
    return peaks.join(days, ["wt", "day"]).groupBy("wt").agg(F.max(F.col("start") + F.col("open")).alias("most"))


@query("a46_composite_score", f"WITH {BARS}, g AS (SELECT symbol, sum(v)::BIGINT AS v, sum(trades)::BIGINT AS t FROM bars GROUP BY 1), r AS (SELECT *, dense_rank() OVER (ORDER BY v) AS rv, dense_rank() OVER (ORDER BY t) AS rt FROM g) SELECT symbol, round(0.6 * (rv - 1) / nullif((SELECT max(rv) FROM r) - 1, 0) + 0.4 * (rt - 1) / nullif((SELECT max(rt) FROM r) - 1, 0), 6) AS score FROM r")
def a46(spark, d):
    # ranks over distinct values: they are ranked alone, a row per value and slice by slice, and joined back
    g = bars(spark, d).groupBy("symbol").agg(F.sum("v").alias("v"), F.sum("trades").alias("t"))
    for c in ("v", "t"):
        ranked = with_weight_before(g.select(c).distinct().withColumn("__one", F.lit(1)), [], c, "__one")
        g = g.join(ranked.select(c, F.coalesce(F.try_divide(F.col("__before"), F.col("__total") - 1), F.lit(0.5)).alias(f"p_{c}")), c)
    return rounded(g.select("symbol", (0.6 * F.col("p_v") + 0.4 * F.col("p_t")).alias("score")))


@query("a47_activity_metrics", f"WITH {BARS}, r AS (SELECT *, row_number() OVER w AS i, abs(c / nullif(lag(c) OVER w, 0) - 1) AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot)), k AS (SELECT symbol, (i - 1) // 10 AS chunk, max(h) / nullif(min(l), 0) - 1 AS range, count(*) FILTER (m >= 0.5) AS big, sum(v) AS v FROM r GROUP BY ALL) SELECT symbol, round(max(range), 5) AS max_range, sum(big)::BIGINT AS big_moves, arg_max(v, chunk)::BIGINT AS last_volume FROM k GROUP BY 1")
def a47(spark, d):
    w = Window.partitionBy("symbol").orderBy("slot")
    r = bars(spark, d).select("symbol", "h", "l", "v", F.floor((F.row_number().over(w) - 1) / 10).alias("chunk"), F.abs(ret("c", F.lag("c").over(w))).alias("m"))
    k = r.groupBy("symbol", "chunk").agg(ret(F.max("h"), F.min("l")).alias("range"), F.count_if(F.col("m") >= 0.5).alias("big"), F.sum("v").alias("v"))
    return rounded(k.groupBy("symbol").agg(F.max("range").alias("max_range"), F.sum("big").alias("big_moves"), F.max_by("v", "chunk").alias("last_volume")), 5)


_FEATURES = P1 + ", x AS (SELECT event_id, (f1 > 0)::INT AS win, unnest(['kind', 'tier', 'hour']) AS f, unnest([wt, CASE WHEN k >= 67 THEN 'high' WHEN k >= 34 THEN 'mid' ELSE 'low' END, (us // 21600000000 % 4)::VARCHAR]) AS v FROM p)"


def features(spark, d):
    tier = F.when(F.col("k") >= 67, "high").when(F.col("k") >= 34, "mid").otherwise("low")
    f = {"kind": F.col("wt"), "tier": tier, "hour": (F.floor(F.col("us") / (6 * B.HOUR)) % 4).cast("string")}
    return returns(spark, d).select("event_id", (F.col("f1") > 0).cast("int").alias("win"), *(v.alias(n) for n, v in f.items()))


@query("a48_single_feature_lift", f"WITH {_FEATURES} SELECT f, v, count(*) AS n, round(avg(win), 6) AS rate, round(avg(win) - (SELECT avg((f1 > 0)::INT) FROM p), 6) AS lift FROM x GROUP BY ALL HAVING count(*) >= 5")
def a48(spark, d):
    x = features(spark, d).unpivot(["event_id", "win"], ["kind", "tier", "hour"], "f", "v")
    g = x.groupBy("f", "v").agg(F.count("*").alias("n"), F.sum("win").alias("s"))
    # each feature's values cover all rows, so the baseline is that of any one
    w = Window.partitionBy("f")
    return rounded(g.select("f", "v", "n", (F.col("s") / F.col("n")).alias("rate"), (F.col("s") / F.col("n") - F.sum("s").over(w) / F.sum("n").over(w)).alias("lift")).where("n >= 5"))


@query("a49_feature_pair_lift", f"WITH {_FEATURES} SELECT a.f AS f1, a.v AS v1, b.f AS f2, b.v AS v2, count(*) AS n, round(avg(a.win), 6) AS rate FROM x a JOIN x b ON a.event_id = b.event_id AND a.f < b.f GROUP BY ALL HAVING count(*) >= 5")
def a49(spark, d):
    # all pairs of a row's features from one array, so no self join
    names = sorted(["kind", "tier", "hour"])
    pairs = F.array(*(F.struct(F.lit(a).alias("f1"), F.col(a).alias("v1"), F.lit(b).alias("f2"), F.col(b).alias("v2")) for i, a in enumerate(names) for b in names[i + 1 :]))
    x = features(spark, d).select("win", F.explode(pairs).alias("p")).select("win", "p.*")
    return rounded(x.groupBy("f1", "v1", "f2", "v2").agg(F.count("*").alias("n"), F.avg("win").alias("rate")).where("n >= 5"))


@query("a50_decision_tree")
def a50(spark, d):
    """Depth-4 tree on bucketed features with balanced weights; gives its prediction counts (no SQL twin)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    x = features(spark, d)
    share = x.agg(F.avg("win")).first()[0] or 0.5
    x = x.withColumn("weight", F.when(F.col("win") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))).withColumn("label", F.col("win").cast("double"))
    names = ["kind", "tier", "hour"]
    x = StringIndexer(inputCols=names, outputCols=[f"{n}_i" for n in names], handleInvalid="keep").fit(x).transform(x)
    x = VectorAssembler(inputCols=[f"{n}_i" for n in names], outputCol="features").transform(x)
    tree = DecisionTreeClassifier(maxDepth=4, minInstancesPerNode=10, weightCol="weight", seed=1).fit(x)
    return tree.transform(x).groupBy("kind", "tier", "hour", "prediction").agg(F.count("*").alias("n"))


@query("a51_dose_response", f"WITH {P1} SELECT thr, count(*) AS n, round(avg(f1), 6) AS mean FROM p, (VALUES (10), (30), (50), (70), (90)) t(thr) WHERE k >= thr GROUP BY 1")
def a51(spark, d):
    # nested thresholds from disjoint bins: one pass, then sums from the top over five rows
    edges = [10, 30, 50, 70, 90]
    bin_of = F.lit(None).cast("int")
    for e in edges:
        bin_of = F.when(F.col("k") >= e, e).otherwise(bin_of)
    g = returns(spark, d).groupBy(bin_of.alias("thr")).agg(F.sum("f1").alias("s"), F.count("*").alias("n")).where("thr IS NOT NULL")
    w = Window.orderBy(F.desc("thr"))
    return rounded(g.select("thr", F.sum("n").over(w).alias("n"), (F.sum("s").over(w) / F.sum("n").over(w)).alias("mean")))


@query("a52_train_test_grid", f"WITH {P1}, c AS (SELECT quantile_disc(us, 0.7) AS cut FROM p), g AS (SELECT thr, us <= cut AS train, count(*) AS n, avg(f1) AS m FROM p, c, (VALUES (20), (50), (80)) t(thr) WHERE k >= thr GROUP BY ALL) SELECT a.thr, a.n AS n_train, b.n AS n_test, round(a.m, 6) AS m_train, round(b.m, 6) AS m_test, sign(a.m) = sign(b.m) AS agrees FROM g a JOIN g b ON a.thr = b.thr AND a.train AND NOT b.train")
def a52(spark, d):
    p = returns(spark, d)
    cut = quantiles(p, [], "us", [0.7], ["cut"], discrete=True)  # one row
    thr = F.explode(F.filter(F.array(*map(F.lit, (20, 50, 80))), lambda x: x <= F.col("k")))
    x = p.crossJoin(F.broadcast(cut)).select("f1", (F.col("us") <= F.col("cut")).alias("train"), thr.alias("thr"))
    own = lambda t: F.when(F.col("train") == t, F.col("f1"))
    g = x.groupBy("thr").agg(F.count(own(True)).alias("n_train"), F.count(own(False)).alias("n_test"), F.avg(own(True)).alias("m_train"), F.avg(own(False)).alias("m_test"))
    return rounded(g.withColumn("agrees", F.signum("m_train") == F.signum("m_test")))


_GATES = "WITH " + P1 + ", c AS (SELECT wt, symbol % 5 AS tier, us < 1705363200000000 AS dev, count(*) AS n, avg(f1) AS m, median(f1) AS md FROM p WHERE us < 1705968000000000 GROUP BY ALL)"


@query("a53_gates", _GATES + " SELECT a.wt, a.tier, a.n >= 100 AND a.m > 0 AND a.md > 0 AS dev_pass, a.n >= 100 AND a.m > 0 AND a.md > 0 AND b.m > 0 AS confirmed FROM c a JOIN c b ON a.wt = b.wt AND a.tier = b.tier AND a.dev AND NOT b.dev")
def a53(spark, d):
    p = returns(spark, d).where("us < 1705968000000000").withColumn("dev", F.col("us") < 1705363200000000)
    own = lambda t: F.when(F.col("dev") == t, F.col("f1"))
    p = p.withColumn("tier", F.col("symbol") % 5)
    g = p.groupBy("wt", "tier").agg(F.count(own(True)).alias("n"), F.avg(own(True)).alias("m"), F.avg(own(False)).alias("vm")).where("vm IS NOT NULL AND n > 0")
    g = g.join(quantiles(p.where("dev"), ["wt", "tier"], "f1", [0.5], ["md"]), ["wt", "tier"])
    return g.select("wt", "tier", F.expr("n >= 100 AND m > 0 AND md > 0").alias("dev_pass"), F.expr("n >= 100 AND m > 0 AND md > 0 AND vm > 0").alias("confirmed"))


@query("a54_acceptance", f"WITH {P1} SELECT symbol, CASE WHEN count(*) < 60 THEN NULL ELSE avg(f1) > 0.5 END AS accepted FROM p GROUP BY 1")
def a54(spark, d):
    return returns(spark, d).groupBy("symbol").agg(F.when(F.count("*") >= 60, F.avg("f1") > 0.5).alias("accepted"))


@query("a55_carry", f"WITH {EV}, r AS (SELECT symbol, (k - 50) / 1000.0 AS rate, row_number() OVER (PARTITION BY symbol ORDER BY us) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ev) SELECT symbol, round(avg(rate) * 3 * 365, 5) AS yearly, round(avg(rate) FILTER (2 * i > n) - avg(rate) FILTER (2 * i <= n), 6) AS decay, count(*) FILTER (rate < 0) AS negative, round(stddev_samp(rate) * sqrt(count(*)), 6) AS swing FROM r GROUP BY 1")
def a55(spark, d):
    w = Window.partitionBy("symbol")
    r = tables.ticks(spark, d).select("symbol", ((F.col("k") - 50) / 1000.0).alias("rate"), (2 * F.row_number().over(w.orderBy("us")) > F.count("*").over(w)).alias("late"))
    half = lambda t: F.avg(F.when(F.col("late") == t, F.col("rate")))
    g = r.groupBy("symbol").agg(F.round(F.avg("rate") * 3 * 365, 5).alias("yearly"), F.round(half(True) - half(False), 6).alias("decay"), F.count_if(F.col("rate") < 0).alias("negative"), F.round(F.stddev_samp("rate") * F.sqrt(F.count("*")), 6).alias("swing"))
    return g


@query("a56_roll_spread", f"WITH {BARS}, d AS (SELECT symbol, slot, c - lag(c) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot)), l AS (SELECT symbol, d, lag(d) OVER (PARTITION BY symbol ORDER BY slot) AS e FROM d), v AS (SELECT symbol, covar_samp(d, e) AS v FROM l GROUP BY 1) SELECT symbol, round(CASE WHEN v < 0 THEN 2 * sqrt(-v) ELSE 0 END, 4) AS spread FROM v")
def a56(spark, d):
    w = Window.partitionBy("symbol").orderBy("slot")
    x = bars(spark, d).select("symbol", "slot", (F.col("c") - F.lag("c").over(w)).alias("d")).withColumn("e", F.lag("d").over(w))
    v = F.covar_samp("d", "e")
    return rounded(x.groupBy("symbol").agg(F.when(v < 0, 2 * F.sqrt(-v)).otherwise(0.0).alias("spread")), 4)


@query("a57_reconciliation", f"WITH {EV}, a AS (SELECT wt, sum(price) AS x FROM ev GROUP BY 1), b AS (SELECT event_type AS wt, round(sum(value) * CASE WHEN event_type = 'view' THEN 1.2 ELSE 1.01 END, 2) AS target FROM events GROUP BY 1) SELECT wt, round(x / nullif(target, 0) - 1, 5) AS diff, abs(x / nullif(target, 0) - 1) <= 0.1 AS ok FROM a JOIN b USING (wt)")
def a57(spark, d):
    a = tables.ticks(spark, d).groupBy("wt").agg(F.sum("price").alias("x"))
    target = tables.read(spark, d, "events").groupBy(F.col("event_type").alias("wt")).agg(F.sum("value").alias("s")).select("wt", F.round(F.col("s") * F.when(F.col("wt") == "view", 1.2).otherwise(1.01), 2).alias("target"))
    diff = ret("x", "target")
    return rounded(a.join(target, "wt").select("wt", diff.alias("diff"), (F.abs(diff) <= 0.1).alias("ok")), 5)


@query("a59_capture", f"WITH {BARS}, x AS (SELECT symbol, lead(c, 8) OVER w / nullif(c, 0) - 1 AS f, max(h) OVER a / nullif(c, 0) - 1 AS mfe FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot), a AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)) SELECT symbol, round(avg(f) / nullif(avg(mfe), 0), 5) AS capture, round(avg((f <= 0 AND mfe > 0)::INT), 5) AS gave_back FROM x WHERE f IS NOT NULL GROUP BY 1")
def a59(spark, d):
    x = bars(spark, d).select("symbol", B.forward("c", "symbol", "slot", 8).alias("f"), B.excursions("symbol", "slot", 8)[0].alias("mfe")).where("f IS NOT NULL")
    return rounded(x.groupBy("symbol").agg((F.avg("f") / F.nullif(F.avg("mfe"), F.lit(0.0))).alias("capture"), F.avg(((F.col("f") <= 0) & (F.col("mfe") > 0)).cast("int")).alias("gave_back")), 5)


@query("a60_liquidity_profile", f"WITH {BARS} SELECT slot % 4 AS session, CASE WHEN symbol % 3 = 0 THEN 'big' ELSE 'small' END AS tier, count(*) AS bars, round(median((h - l)/ nullif(c, 0)), 6) AS range, round(avg(v), 4) AS volume FROM bars GROUP BY ALL")
def a60(spark, d):
    g = bars(spark, d).groupBy((F.col("slot") % 4).alias("session"), F.when(F.col("symbol") % 3 == 0, "big").otherwise("small").alias("tier"))
    return g.agg(F.count("*").alias("bars"), F.round(F.median(share(F.col("h") - F.col("l"), "c")), 6).alias("range"), F.round(F.avg("v"), 4).alias("volume"))


@query("a61_leaderboard_pivot", f"WITH {P1} SELECT symbol % 10 AS family, {', '.join(f'round(avg(f1) FILTER (wt = {chr(39)}{w}{chr(39)}), 6) AS {w}' for w in ('click', 'error', 'purchase', 'signup', 'view'))} FROM p GROUP BY 1")
def a61(spark, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return rounded(returns(spark, d).groupBy((F.col("symbol") % 10).alias("family")).pivot("wt", kinds).agg(F.avg("f1")))


@query("a62_strategy_clusters", f"WITH {PANEL}, c AS (SELECT symbol, wt, count(*) AS n, round(avg(price), 4) AS s FROM panel GROUP BY ALL), f AS (SELECT *, sha256(concat_ws('|', wt, (n // 5)::VARCHAR)) AS fp FROM c) SELECT symbol, wt, fp FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY s DESC, symbol) AS r FROM f) WHERE r <= 2")
def a62(spark, d):
    from ..operators.detect import first_per

    c = panel(spark, d).groupBy("symbol", "wt").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("s"))
    f = c.withColumn("fp", F.sha2(F.concat_ws("|", "wt", F.floor(F.col("n") / 5).cast("string")), 256))
    return first_per(f, ["fp"], [F.desc("s"), F.col("symbol")], 2).select("symbol", "wt", "fp")


@query("a63_concentration_grade", f"WITH {P1}, g AS (SELECT wt, symbol, sum(greatest(f1, 0)) AS s FROM p GROUP BY ALL) SELECT wt, round(max(s) / sum(s), 6) AS top_share, CASE WHEN max(s) / sum(s) <= 0.05 THEN 'A' WHEN max(s) / sum(s) <= 0.2 THEN 'B' ELSE 'C' END AS grade FROM g GROUP BY 1")
def a63(spark, d):
    g = returns(spark, d).groupBy("wt", "symbol").agg(F.sum(F.greatest("f1", F.lit(0.0))).alias("s")).groupBy("wt").agg(F.try_divide(F.max("s"), F.sum("s")).alias("top_share"))
    return rounded(g.withColumn("grade", F.when(F.col("top_share") <= 0.05, "A").when(F.col("top_share") <= 0.2, "B").otherwise("C")))


@query("a64_structure_map", f"WITH {PANEL} SELECT wt, us // 21600000000 % 4 AS win, count(f1) AS n, round(avg(f1), 6) AS mean, round(median(f1), 6) AS median, round(avg(abs(f1)), 6) AS mean_abs, round(avg((sign(f1) = sign(f3))::INT), 6) AS continues FROM panel GROUP BY ALL")
def a64(spark, d):
    g = panel(spark, d).groupBy("wt", (F.floor(F.col("us") / (6 * B.HOUR)) % 4).alias("win"))
    return rounded(g.agg(F.count("f1").alias("n"), F.avg("f1").alias("mean"), F.median("f1").alias("median"), F.avg(F.abs("f1")).alias("mean_abs"), F.avg((F.signum("f1") == F.signum("f3")).cast("int")).alias("continues")))


@query("a65_own_reference", f"WITH {EV} SELECT symbol, round(avg(k) FILTER (wt = 'error') - avg(k) FILTER (wt <> 'error'), 6) AS abnormal FROM ev GROUP BY 1 HAVING count(*) FILTER (wt = 'error') >= 2 AND count(*) FILTER (wt <> 'error') >= 6")
def a65(spark, d):
    own = lambda t: F.when((F.col("wt") == "error") == t, F.col("k"))
    g = tables.ticks(spark, d).groupBy("symbol").agg((F.avg(own(True)) - F.avg(own(False))).alias("abnormal"), F.count_if(F.col("wt") == "error").alias("a"), F.count_if(F.col("wt") != "error").alias("b"))
    return rounded(g.where("a >= 2 AND b >= 6").select("symbol", "abnormal"))


@query("a66_cost_stress", f"WITH {P1} SELECT wt, mult, round(avg(f1) - 0.01 * mult, 6) AS net, round(avg(f1), 6) AS break_even FROM p, (VALUES (1.0::DOUBLE), (1.5), (2.0)) m(mult) GROUP BY wt, mult")
def a66(spark, d):
    g = returns(spark, d).groupBy("wt").agg(F.avg("f1").alias("gross")).withColumn("mult", F.explode(F.array(*map(F.lit, (1.0, 1.5, 2.0)))))
    return rounded(g.select("wt", "mult", (F.col("gross") - 0.01 * F.col("mult")).alias("net"), F.col("gross").alias("break_even")))


@query("a69_bucket_cube", f"WITH {P1} SELECT coalesce(wt, 'ALL') AS wt, coalesce(CASE WHEN k < 34 THEN '<34' WHEN k < 67 THEN '34-67' ELSE '>=67' END, 'ALL') AS tier, count(*) AS n, round(quantile_cont(f1, 0.1), 5) AS p10, round(quantile_cont(f1, 0.9), 5) AS p90 FROM p GROUP BY CUBE (wt, CASE WHEN k < 34 THEN '<34' WHEN k < 67 THEN '34-67' ELSE '>=67' END)")
def a69(spark, d):
    x = returns(spark, d).withColumn("tier", bucket(F.col("k"), [34, 67]))
    # values are counted once per cell; the cube is taken over those counts
    counts = x.groupBy("wt", "tier", "f1").agg(F.count("*").alias("c")).cube("wt", "tier", "f1").agg(F.sum("c").alias("c"), F.grouping("f1").alias("g"))
    n = counts.where("g = 1").select("wt", "tier", F.col("c").alias("n"))
    q = weighted_quantiles(counts.where("g = 0 AND f1 IS NOT NULL").select("wt", "tier", "f1", "c"), ["wt", "tier"], "f1", "c", [0.1, 0.9], ["p10", "p90"])
    both = joined_back(n, q, ["wt", "tier"])
    return both.select(F.coalesce("wt", F.lit("ALL")).alias("wt"), F.coalesce("tier", F.lit("ALL")).alias("tier"), "n", F.round("p10", 5).alias("p10"), F.round("p90", 5).alias("p90"))


@query("a70_layer_comparison", f"WITH {P1}, u AS (SELECT 'none' AS layer, f1 AS r FROM p UNION ALL SELECT 'strong', f1 FROM p WHERE k >= 50 UNION ALL SELECT 'fade', -f1 FROM p WHERE k >= 80) SELECT layer, count(*) AS trades, round(sum(r), 4) AS total, round(max(r), 5) AS best, round(min(r), 5) AS worst, count(*) FILTER (r <= -0.5) AS tail FROM u GROUP BY 1")
def a70(spark, d):
    layers = {"none": F.col("f1"), "strong": F.when(F.col("k") >= 50, F.col("f1")), "fade": F.when(F.col("k") >= 80, -F.col("f1"))}
    u = returns(spark, d).select(F.explode(F.array(*(F.struct(F.lit(n).alias("layer"), v.alias("r")) for n, v in layers.items()))).alias("x")).select("x.*").where("r IS NOT NULL")
    return u.groupBy("layer").agg(F.count("*").alias("trades"), F.round(F.sum("r"), 4).alias("total"), F.round(F.max("r"), 5).alias("best"), F.round(F.min("r"), 5).alias("worst"), F.count_if(F.col("r") <= -0.5).alias("tail"))


@query("a71_fold_consistency", f"WITH {P1}, f AS (SELECT symbol % 10 AS g, least((us - 1704067200000000) // 864000000000, 2) AS fold, avg(f1) AS m FROM p GROUP BY ALL) SELECT g, count(*) AS folds, count(DISTINCT sign(m - 2.0)) = 1 AS same_sign FROM f GROUP BY 1")
def a71(spark, d):
    f = returns(spark, d).groupBy((F.col("symbol") % 10).alias("g"), F.least(F.floor((F.col("us") - 1704067200000000) / (10 * B.DAY)), F.lit(2)).alias("fold")).agg(F.avg("f1").alias("m"))
    return f.groupBy("g").agg(F.count("*").alias("folds"), (F.countDistinct(F.signum(F.col("m") - 2.0)) == 1).alias("same_sign"))


@query("a72_keyword_outcomes", r"WITH w AS (SELECT DISTINCT d.doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id), g AS (SELECT word, count(*) AS n, avg(quality) AS rate FROM w GROUP BY 1 HAVING count(*) >= 30) SELECT word, n, round(rate, 6) AS rate FROM g")
def a72(spark, d):
    docs = tables.read(spark, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("words"))
    x = docs.join(tables.read(spark, d, "labels").select("doc_id", "quality"), "doc_id").select("quality", F.explode("words").alias("word"))
    return rounded(x.groupBy("word").agg(F.count("*").alias("n"), F.avg("quality").alias("rate")).where("n >= 30"))


@query("a73_shuffled_baselines", f"""WITH RECURSIVE {P1}, b AS (SELECT event_id, day, f1, wt FROM p), {dealt_sql("b", "day", "event_id", "wt", 1, "base")}
SELECT dealt AS wt, round(avg(f1) FILTER (rep = 0), 6) AS real, round(avg(f1) FILTER (rep = 1), 6) AS shuffled FROM rows_dealt GROUP BY 1""")
def a73(spark, d):
    x = dealt(returns(spark, d).select("event_id", "day", "f1", "wt"), ["day"], "event_id", "wt", 1, "base")
    mean = lambda n: F.avg(F.when(F.col("rep") == n, F.col("f1")))
    return rounded(x.groupBy(F.col("dealt").alias("wt")).agg(mean(0).alias("real"), mean(1).alias("shuffled")))


@query("a74_table_profile", f"WITH {BARS} SELECT symbol, count(*) AS n, arg_min(c, slot) AS first, arg_max(c, slot) AS last, max(h) AS high, arg_max(slot, (h, -slot)) AS high_at, min(l) AS low, arg_min(slot, (l, slot)) AS low_at FROM bars GROUP BY 1")
def a74(spark, d):
    return bars(spark, d).groupBy("symbol").agg(
        F.count("*").alias("n"), F.min_by("c", "slot").alias("first"), F.max_by("c", "slot").alias("last"), F.max("h").alias("high"), F.max_by("slot", F.struct("h", F.negate("slot"))).alias("high_at"), F.min("l").alias("low"), F.min_by("slot", F.struct("l", "slot")).alias("low_at")
    )


@query("a77_composite_strategy_score", f"WITH {P1} SELECT symbol, round(avg(f1) + quantile_cont(f1, 0.1) + least(0, avg(f1) / 2), 6) AS score FROM p GROUP BY 1")
def a77(spark, d):
    m = F.avg("f1")
    p = returns(spark, d)
    g = p.groupBy("symbol").agg(m.alias("m")).join(quantiles(p, ["symbol"], "f1", [0.1], ["low"]), "symbol")
    return rounded(g.select("symbol", (F.col("m") + F.col("low") + F.least(F.lit(0.0), F.col("m") / 2)).alias("score")))


@query("a78_scorecard", f"""WITH {P1}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us) AS i, row_number() OVER (PARTITION BY symbol ORDER BY f1 DESC, us) AS top, sum((f1 > 0)::INT) OVER (PARTITION BY symbol ORDER BY us) AS isle FROM p),
l AS (SELECT symbol, max(n) AS streak FROM (SELECT symbol, isle, count(*) FILTER (f1 <= 0) AS n FROM o GROUP BY ALL) GROUP BY 1)
SELECT symbol, count(*) AS n, round(sum(greatest(f1, 0)) / nullif(-sum(least(f1, 0)), 0), 5) AS profit_factor, any_value(streak) AS streak, round(avg(f1) FILTER (top > 1), 6) AS without_top, count(*) < 20 OR coalesce(sum(greatest(f1, 0)) / nullif(-sum(least(f1, 0)), 0) < 1.2, false) OR median(f1) <= 0 AS rejected FROM o JOIN l USING (symbol) GROUP BY 1""")
def a78(spark, d):
    w = Window.partitionBy("symbol")
    o = returns(spark, d).select("symbol", "f1", F.row_number().over(w.orderBy(F.desc("f1"), "us")).alias("top"), F.sum((F.col("f1") > 0).cast("int")).over(w.orderBy("us")).alias("isle"))
    # a losing streak is the stretch of losses behind one win
    o = o.withColumn("run", F.sum((F.col("f1") <= 0).cast("int")).over(Window.partitionBy("symbol", "isle")))
    factor = F.sum(F.greatest("f1", F.lit(0.0))) / F.nullif(-F.sum(F.least("f1", F.lit(0.0))), F.lit(0.0))
    g = o.groupBy("symbol").agg(F.count("*").alias("n"), F.round(factor, 5).alias("profit_factor"), F.max("run").alias("streak"), F.round(F.avg(F.when(F.col("top") > 1, F.col("f1"))), 6).alias("without_top"),
                                ((F.count("*") < 20) | F.coalesce(factor < 1.2, F.lit(False)) | (F.median("f1") <= 0)).alias("rejected"))
    return g


@query("a79_outcome_quartiles", f"WITH {PANEL}, u AS (SELECT wt, unnest([1, 3]) AS horizon, unnest([f1, f3]) AS f FROM panel), s AS (SELECT *, unnest([1, -1]) AS side FROM u WHERE f IS NOT NULL) SELECT wt, horizon, side, count(*) AS n, round(quantile_cont(side * f, 0.25), 6) AS q1, round(quantile_cont(side * f, 0.5), 6) AS q2, round(quantile_cont(side * f, 0.75), 6) AS q3 FROM s GROUP BY ALL")
def a79(spark, d):
    h = F.explode(F.array(*(F.struct(F.lit(i).alias("horizon"), F.lit(s).alias("side"), (s * F.col(f"f{i}")).alias("f")) for i in (1, 3) for s in (1, -1))))
    u = panel(spark, d).select("wt", h.alias("h")).select("wt", "h.*").where("f IS NOT NULL")
    cells, names = ["wt", "horizon", "side"], ["q1", "q2", "q3"]
    q = quantiles(u, cells, "f", [0.25, 0.5, 0.75], names)
    return rounded(u.groupBy(*cells).agg(F.count("*").alias("n")).join(q, cells).select(*cells, "n", *names))
