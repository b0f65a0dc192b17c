"""Queries over cross-sectional portfolios and event studies (A rows), and the flagship study."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.scalars import net, ret, round_trip_cost
from ..operators import bars as B
from ..operators import crosssection as X
from .panels import bars, cross_section, panel, rounded
from .registry import BARS, PANEL, XS, query

_LEGS = XS + ", v AS (SELECT * FROM xs WHERE f1 IS NOT NULL), r AS (SELECT *, count(*) OVER (PARTITION BY m) AS names, row_number() OVER (PARTITION BY m ORDER BY score, s) AS lo, row_number() OVER (PARTITION BY m ORDER BY score DESC, s) AS hi FROM v), g AS (SELECT *, CASE WHEN hi <= names // 3 THEN 1 WHEN lo <= names // 3 THEN -1 ELSE 0 END AS leg FROM r WHERE names >= 9)"
_SPREAD = _LEGS + ", d AS (SELECT m, avg(f1) FILTER (leg = 1) AS l, avg(f1) FILTER (leg = -1) AS s FROM g GROUP BY 1)"


def valid(spark, d):
    return cross_section(spark, d).where("f1 IS NOT NULL")


def legs(spark, d, score="score"):
    return X.with_legs(valid(spark, d), ["m"], "s", score, 3, 9)


@query("a33_long_short_spread", f"WITH {_SPREAD} SELECT m, round(l, 6) AS long, round(s, 6) AS short, round(l - s - 0.004, 6) AS spread FROM d")
def a33(spark, d):
    return rounded(X.spread(legs(spark, d), ["m"], "f1", 0.002).select("m", "long", "short", "spread"))


@query("a34_leg_attribution", f"WITH {_LEGS}, c AS (SELECT m, leg, count(*) AS k FROM g WHERE leg <> 0 GROUP BY ALL), x AS (SELECT g.s, sum(leg * f1 / k) AS pnl, count(*) AS months FROM g JOIN c USING (m, leg) GROUP BY 1) SELECT s, round(pnl, 6) AS pnl, months FROM x")
def a34(spark, d):
    g = legs(spark, d).where("leg <> 0").withColumn("k", F.count("*").over(Window.partitionBy("m", "leg")))
    return rounded(g.groupBy("s").agg(F.sum(F.col("leg") * F.col("f1") / F.col("k")).alias("pnl"), F.count("*").alias("months")))


@query("a35_leg_turnover", f"WITH {_LEGS}, h AS (SELECT m, s, leg FROM g WHERE leg <> 0), c AS (SELECT m, lead(m) OVER (ORDER BY m) AS n FROM (SELECT DISTINCT m FROM h)) SELECT h.m, h.leg, round(avg((k.s IS NOT NULL)::INT), 6) AS kept FROM h JOIN c USING (m) LEFT JOIN h k ON k.m = c.n AND k.s = h.s AND k.leg = h.leg WHERE c.n IS NOT NULL GROUP BY ALL")
def a35(spark, d):
    return rounded(X.turnover(legs(spark, d), "m", "s"))


def _ranks(a, b, by):
    part = f"PARTITION BY {by}"
    return ", ".join(f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({part}, {c}) - 1) / 2.0 AS {n}" for c, n in ((a, "ra"), (b, "rb")))


@query("a36_persistence", f"WITH {XS}, y AS (SELECT s, m, score, lead(score) OVER (PARTITION BY s ORDER BY m) AS nxt, lead(m) OVER (PARTITION BY s ORDER BY m) AS nm FROM xs), z AS (SELECT m, {_ranks('score', 'nxt', 'm')} FROM y WHERE nm = m + 1) SELECT m, count(*) AS n, round(corr(ra, rb), 6) AS ic FROM z GROUP BY 1 HAVING count(*) >= 8")
def a36(spark, d):
    w = Window.partitionBy("s").orderBy("m")
    y = cross_section(spark, d).withColumns({"nxt": F.lead("score").over(w), "nm": F.lead("m").over(w)}).where("nm = m + 1")
    return rounded(X.rank_correlation(y, ["m"], "score", "nxt", 8))


@query("a58_two_sided_book", f"WITH {PANEL}, w AS (SELECT us // 604800000000 AS week, avg(f1) FILTER (wt = 'purchase') AS l, avg(f1) FILTER (wt = 'error') AS s FROM panel GROUP BY 1) SELECT week, round(0.5 * l - 0.5 * s, 6) AS book FROM w WHERE l IS NOT NULL AND s IS NOT NULL")
def a58(spark, d):
    side = lambda k: F.avg(F.when(F.col("wt") == k, F.col("f1")))
    w = panel(spark, d).groupBy(F.floor(F.col("us") / (7 * B.DAY)).alias("week")).agg(side("purchase").alias("l"), side("error").alias("s"))
    return rounded(w.where("l IS NOT NULL AND s IS NOT NULL").select("week", (0.5 * F.col("l") - 0.5 * F.col("s")).alias("book")))


@query("a67_control_neutral_spread", f"""WITH {XS}, v AS (SELECT * FROM xs WHERE f1 IS NOT NULL), b AS (SELECT m, coalesce(covar_pop(f1, alt) / nullif(var_pop(alt), 0), 0) AS sl, avg(alt) AS ma, avg(f1) AS mf FROM v GROUP BY 1), e AS (SELECT v.*, f1 - mf - sl * (alt - ma) AS res FROM v JOIN b USING (m)),
r AS (SELECT *, count(*) OVER (PARTITION BY m) AS names, row_number() OVER (PARTITION BY m ORDER BY score, s) AS lo, row_number() OVER (PARTITION BY m ORDER BY score DESC, s) AS hi FROM e) SELECT m, round(avg(res) FILTER (hi <= names // 3) - avg(res) FILTER (hi > names // 3 AND lo <= names // 3), 5) AS spread FROM r WHERE names >= 9 GROUP BY 1""")
def a67(spark, d):
    e = X.residuals(valid(spark, d), ["m"], "f1", "alt", "res")
    return rounded(X.spread(X.with_legs(e, ["m"], "s", "score", 3, 9), ["m"], "res").select("m", "spread"), 5)


@query("a68_leave_one_name_out", f"""WITH {XS}, w AS (SELECT * FROM xs WHERE f1 IS NOT NULL), v AS (SELECT w.*, dr.x AS dropped FROM w, (SELECT DISTINCT s AS x FROM w) dr WHERE s <> dr.x), r AS (SELECT *, count(*) OVER (PARTITION BY dropped, m) AS names, row_number() OVER (PARTITION BY dropped, m ORDER BY score, s) AS lo, row_number() OVER (PARTITION BY dropped, m ORDER BY score DESC, s) AS hi FROM v),
d AS (SELECT dropped, m, avg(f1) FILTER (hi <= names // 3) - avg(f1) FILTER (hi > names // 3 AND lo <= names // 3) AS sp FROM r WHERE names >= 9 GROUP BY ALL) SELECT dropped, count(*) AS months, round(avg(sp), 6) AS spread FROM d GROUP BY 1""")
def a68(spark, d):
    """Every name is dropped in turn and the legs formed anew.

    Without a name, each leg of its months is that of the ranks up to k, or up to k + 1 less the name where it was among them. So two sums per
    month and leg, and the totals over all months, give every name's result without a copy of the table per name.
    """
    w = Window.partitionBy("m")
    r = valid(spark, d).select("s", "m", "f1", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy(F.desc("score"), "s")).alias("hi"), F.row_number().over(w.orderBy("score", "s")).alias("lo"))
    r = r.withColumns({"k": F.floor(F.col("n") / 3), "j": F.floor((F.col("n") - 1) / 3)})
    top = lambda rank, to: F.coalesce(F.sum(F.when(F.col(rank) <= to, F.col("f1"))), F.lit(0.0))
    months = r.groupBy("m", "n", "k", "j").agg(*(top(rank, F.col(c) + extra).alias(f"{rank}_{c}{extra}") for rank in ("hi", "lo") for c, extra in (("k", 0), ("j", 0), ("j", 1))))
    months = months.withColumn("whole", F.when(F.col("n") >= 9, F.try_divide(F.col("hi_k0") - F.col("lo_k0"), F.col("k"))))
    leg = lambda rank: F.when(F.col(rank) <= F.col("j"), F.col(f"{rank}_j1") - F.col("f1")).otherwise(F.col(f"{rank}_j0"))
    own = r.join(months.drop("n", "k", "j"), "m").withColumn("without", F.when(F.col("n") >= 10, F.try_divide(leg("hi") - leg("lo"), F.col("j"))))
    per = own.groupBy(F.col("s").alias("dropped")).agg(*(f(c).alias(f"{n}_{c}") for c in ("whole", "without") for n, f in (("n", F.count), ("t", lambda c: F.coalesce(F.sum(c), F.lit(0.0))))))
    every = months.agg(F.count("whole").alias("n"), F.sum("whole").alias("t"))  # one row
    x = per.crossJoin(F.broadcast(every)).withColumn("months", F.col("n") - F.col("n_whole") + F.col("n_without")).where("months > 0")
    return rounded(x.select("dropped", "months", ((F.col("t") - F.col("t_whole") + F.col("t_without")) / F.col("months")).alias("spread")))


@query("a75_demeaned_correlation", f"WITH {XS}, v AS (SELECT *, count(*) OVER (PARTITION BY m) AS names FROM xs WHERE f1 IS NOT NULL), e AS (SELECT score - avg(score) OVER (PARTITION BY m) AS a, f1 - avg(f1) OVER (PARTITION BY m) AS b FROM v WHERE names >= 6) SELECT count(*) AS n, round(corr(a, b), 6) AS r FROM e")
def a75(spark, d):
    v = valid(spark, d).withColumn("names", F.count("*").over(Window.partitionBy("m"))).where("names >= 6")
    e = v.select(X.demeaned("score", ["m"]).alias("a"), X.demeaned("f1", ["m"]).alias("b"))
    return rounded(e.agg(F.count("*").alias("n"), S.correlation("a", "b").alias("r")))


@query("a76_score_difference", f"""WITH {XS}, u AS (SELECT s, m, f1, unnest(['score', 'alt']) AS which, unnest([score, alt]) AS x FROM xs WHERE f1 IS NOT NULL), r AS (SELECT *, count(*) OVER (PARTITION BY which, m) AS names, row_number() OVER (PARTITION BY which, m ORDER BY x, s) AS lo, row_number() OVER (PARTITION BY which, m ORDER BY x DESC, s) AS hi FROM u),
d AS (SELECT which, m, avg(f1) FILTER (hi <= names // 3) - avg(f1) FILTER (hi > names // 3 AND lo <= names // 3) AS sp FROM r WHERE names >= 9 GROUP BY ALL) SELECT m, round(max(sp) FILTER (which = 'score'), 6) AS score, round(max(sp) FILTER (which = 'alt'), 6) AS alt, round(max(sp) FILTER (which = 'score') - max(sp) FILTER (which = 'alt'), 6) AS diff FROM d GROUP BY 1""")
def a76(spark, d):
    u = valid(spark, d).unpivot(["s", "m", "f1"], ["score", "alt"], "which", "x")
    sp = X.spread(X.with_legs(u, ["which", "m"], "s", "x", 3, 9), ["which", "m"], "f1")
    p = sp.groupBy("m").pivot("which", ["score", "alt"]).agg(F.max("spread"))
    return rounded(p.withColumn("diff", F.col("score") - F.col("alt")))


@query("a29_leave_one_out_market_beta", f"WITH {BARS}, r AS (SELECT symbol, slot, c/ nullif(o, 0) - 1 AS x, trades FROM bars), s AS (SELECT slot, sum(x) AS t, count(*) AS n FROM r GROUP BY 1) SELECT symbol, count(*) AS n, round(regr_slope(x, (t - x) / (n - 1)), 5) AS beta FROM r JOIN s USING (slot) WHERE n >= 10 AND trades < 3 GROUP BY 1 HAVING count(*) >= 20")
def a29(spark, d):
    r = bars(spark, d).select("symbol", "slot", (ret("c", "o")).alias("x"), "trades")
    s = r.groupBy("slot").agg(F.sum("x").alias("t"), F.count("*").alias("k")).where("k >= 10")
    # busy slots are events; betas come from the quiet ones
    y = r.join(s, "slot").where("trades < 3").groupBy("symbol")
    return rounded(y.agg(F.count("*").alias("n"), F.regr_slope("x", (F.col("t") - F.col("x")) / (F.col("k") - 1)).alias("beta")).where("n >= 20"), 5)


_STUDY = BARS + """, m AS (SELECT *, c / nullif(lag(c) OVER w, 0) - 1 AS r1, lead(c, 4) OVER w / nullif(c, 0) - 1 AS f4, max(h) OVER a / nullif(c, 0) - 1 AS mfe, min(l) OVER a / nullif(c, 0) - 1 AS mae FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY slot), a AS (PARTITION BY symbol ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
e AS (SELECT *, CASE WHEN r1 > 0 THEN 'up' ELSE 'down' END AS kind, slot // 4 AS day FROM m WHERE abs(r1) >= 0.3 AND f4 IS NOT NULL),
s AS (SELECT *, unnest([1, -1]) AS side FROM e), n AS (SELECT *, side * f4 * 100 - CASE WHEN abs(r1) < 1.5 THEN 0.14 WHEN abs(r1) < 3.0 THEN 0.94 ELSE 1.34 END AS net FROM s),
g AS (SELECT kind, side, day, sum(net) AS gs, count(*) AS gn FROM n GROUP BY ALL), t AS (SELECT kind, side, sum(gs) / sum(gn) AS mean, sum(gn)::BIGINT AS n, count(*) AS days FROM g GROUP BY ALL),
z AS (SELECT kind, side, sqrt(sum(pow(gs - gn * mean, 2))) AS spread, min((mean * n - gs) / nullif(n - gn, 0)) AS worst FROM g JOIN t USING (kind, side) GROUP BY ALL),
q AS (SELECT kind, side, median(net) AS med, avg((net > 0)::INT) AS win, avg(mfe) AS mfe, avg(mae) AS mae FROM n GROUP BY ALL)
SELECT kind, side, n, days, round(mean, 5) AS mean, round(med, 5) AS median, round(win, 5) AS win, round(mean / (spread / n), 4) AS t, round(worst, 5) AS worst_day_out, round(mfe, 5) AS mfe, round(mae, 5) AS mae FROM t JOIN z USING (kind, side) JOIN q USING (kind, side)"""


@query("flagship_event_study", f"WITH {_STUDY}")
def flagship(spark, d):
    """Bars, threshold events, forward outcomes net of cost, and cells with clustered t and leave-one-day-out."""
    mfe, mae = B.excursions("symbol", "slot", 4)
    m = bars(spark, d).select("symbol", "slot", B.change("c", "symbol", "slot", 1).alias("r1"), B.forward("c", "symbol", "slot", 4).alias("f4"), mfe.alias("mfe"), mae.alias("mae"))
    e = m.where("abs(r1) >= 0.3 AND f4 IS NOT NULL").select("*", F.when(F.col("r1") > 0, "up").otherwise("down").alias("kind"), F.floor(F.col("slot") / 4).alias("day"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"))
    n = e.withColumn("net", net(F.col("f4") * 100, round_trip_cost(F.abs("r1")), F.col("side")))
    cells = ["kind", "side"]
    q = n.groupBy(*cells).agg(F.median("net").alias("median"), F.avg((F.col("net") > 0).cast("int")).alias("win"), F.avg("mfe").alias("mfe"), F.avg("mae").alias("mae"))
    t = S.clustered_t(n, cells, "day", "net").withColumnRenamed("clusters", "days")
    lodo = S.leave_one_out(n, cells, "day", "net").select(*cells, F.col("worst_mean").alias("worst_day_out"))
    out = t.join(q, cells).join(lodo, cells)
    r = lambda c, k: F.round(c, k).alias(c)
    return out.select(*cells, "n", "days", r("mean", 5), r("median", 5), r("win", 5), r("t", 4), r("worst_day_out", 5), r("mfe", 5), r("mae", 5))

