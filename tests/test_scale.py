"""Large groups: what is cut into slices or levels equals what is not, whatever the cut, and no part is larger than stated."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import asof, bars, detect, ranges, ranks, shuffles, slices


@pytest.fixture
def small(monkeypatch):
    """Every table counts as large and 50 rows as many."""
    monkeypatch.setattr(slices, "SLICE_ROWS", 50)
    monkeypatch.setattr(slices, "SMALL_BYTES", 0)


def rows_of(df, *order):
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """Events and features; one key has nine tenths of the rows, some keys and times are null, times repeat."""
    rng = random.Random(7)
    key = lambda: "hot" if rng.random() < 0.9 else rng.choice(("a", "b", "c", None))
    events = spark.createDataFrame([(i, key(), rng.choice((None, *range(0, 5000, 3))) if i % 40 == 0 else rng.randrange(5000)) for i in range(900)], "id long, key string, at long")
    features = spark.createDataFrame([(key(), rng.choice((None, 5)) if i % 50 == 0 else rng.randrange(4000), rng.random(), i) for i in range(700)], "key string, at long, x double, y long")
    return events, features


def test_width_leaves_no_large_slice(small, skewed):
    events, _ = skewed
    width = slices.slice_width(events, ["key"], "at")
    largest = events.where("at IS NOT NULL").groupBy("key", F.floor(F.col("at") / width)).count().agg(F.max("count")).first()[0]
    assert largest <= 50 < events.groupBy("key").count().agg(F.max("count")).first()[0]
    assert slices.slice_width(events.limit(40), ["key"], "at") is None


def test_joins_of_a_hot_key(small, skewed):
    events, features = skewed
    for more in ({}, {"allow_exact": False}, {"tolerance": 30}):
        for join in (asof.asof, asof.first_after):
            plain, cut = (join(events, features, "key", "at", ["x", "y"], slices=s, **more) for s in (None, asof.AUTO))
            assert rows_of(plain) == rows_of(cut) and plain.count() == events.count()
    assert rows_of(asof.asof(events, features, "key", "at", ["x"], lag=40, slices=None)) == rows_of(asof.asof(events, features, "key", "at", ["x"], lag=40))
    both = {"one": (features, ["x"]), "two": (features.where("y % 3 = 0"), ["x", "y"]), "none": (features.where("y < 0"), ["y"])}
    assert rows_of(asof.asof_chain(events, both, "key", "at", slices=None)) == rows_of(asof.asof_chain(events, both, "key", "at"))
    spans = events.where("key IS NOT NULL AND at IS NOT NULL").withColumn("low", F.col("at") - 100).withColumn("high", F.col("at") + 50)
    flows = features.where("at IS NOT NULL")
    cut = rows_of(asof.prefix_sum_at(spans, flows, "key", "at", "y", "low", "high"))
    assert cut == rows_of(asof.prefix_sum_at(spans, flows, "key", "at", "y", "low", "high", slices=None))
    plain = {r.id: r.s for r in spans.alias("s").join(flows.alias("f"), F.expr("s.key = f.key AND f.at > s.low AND f.at <= s.high"), "left").groupBy("id").agg(F.coalesce(F.sum("y"), F.lit(0)).alias("s")).collect()}
    assert {int(r[0]): int(r[-1]) for r in cut} == plain


def test_following_rows_of_a_hot_key(small, skewed):
    events = skewed[0].where("at IS NOT NULL")
    plain, cut = (slices.following(events, ["key"], ["at", "id"], ["id", "at"], [1, 3], w) for w in (None, 70))
    assert rows_of(plain) == rows_of(cut)


@pytest.mark.parametrize("span", [3, 20])
def test_exponential_mean_over_chunks(spark, small, span):
    rng = random.Random(span)
    rows = [(k, i * 7, rng.choice((1e30, 1.0, 5.0)) if k == "wild" else rng.random()) for k, n in (("long", 3000), ("short", 1), ("wild", 900)) for i in range(n)]
    want = {}
    for k, at, c in rows:
        want[k, at] = c if at == 0 else want[k, at - 7] + 2 / (span + 1) * (c - want[k, at - 7])
    got = bars.with_ema(spark.createDataFrame(rows, "key string, at long, c double"), "key", "at", "c", span)
    assert got.columns == ["key", "at", "c", f"ema_{span}"]
    for r in got.collect():
        assert r[3] == pytest.approx(want[r.key, r.at], rel=1e-9)


def plain_cooldown(rows, gap, strict):
    kept, last = [], {}
    for key, at in sorted(set(rows), key=lambda r: (str(r[0]), r[1])):
        if key not in last or (at - last[key] > gap if strict else at - last[key] >= gap):
            last[key] = at
            kept.append((key, at))
    return kept


@pytest.mark.parametrize("strict", [False, True])
def test_cooldown_of_dense_keys(spark, small, monkeypatch, strict):
    monkeypatch.setattr(detect, "FOLD", 20)
    monkeypatch.setattr(detect, "FOLD_BYTES", 0)
    rng = random.Random(3)
    rows = [("dense", i) for i in range(3000)] + [("mixed", int(t)) for t in np.cumsum([rng.choice((1, 2, 3, 40)) for _ in range(800)])] + [("few", 5), ("few", 6), ("few", 500), (None, 1), (None, 2), (None, 90)]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate([*rows, *rows[:50]])], "key string, at long, id long")
    got = sorted({(str(r.key), r.at) for r in detect.cooled_down(df, ["key"], "at", 17, strict=strict).collect()})
    assert got == sorted((str(k), t) for k, t in plain_cooldown(rows, 17, strict)) and detect.cooled_down(df, ["key"], "at", 17, strict=strict).count() > len(got)


def test_quantiles_of_any_numbers(spark):
    rng = np.random.default_rng(4)
    groups = {"wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 300), -(10.0 ** rng.uniform(-300, 300, 300)), [0.0, -0.0]]), "close": 1 + rng.integers(0, 50, 400) * 2.0**-52, "one": [5.0], "ties": rng.integers(0, 3, 300).astype(float), None: [1.0, 2.0, 4.0]}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("one", None)], "g string, x double")
    points, names = [0.0, 0.1, 0.5, 0.93, 1.0], list("abcde")
    for discrete in (False, True):
        got = {r.g: r for r in ranks.quantiles(df, ["g"], "x", points, names, discrete=discrete).collect()}
        assert got.keys() == groups.keys()
        for k, v in groups.items():
            v = np.sort(v)
            want = [v[max(1, math.ceil(p * len(v))) - 1] for p in points] if discrete else np.quantile(v, points)
            assert [got[k][n] for n in names] == pytest.approx(list(want), rel=1e-12), k


def test_places_of_large_whole_numbers(spark):
    rows = [(g, x) for g in (1, 2) for x in random.Random(g).sample(range(-(10**15), 10**15), 200)] + [(1, 2**62), (1, 2**62 + 1), (1, 0)]
    got = ranks.with_place(spark.createDataFrame(rows, "g long, x long"), ["g"], "x").collect()
    for g in (1, 2):
        assert [r.x for r in sorted((r for r in got if r.g == g), key=lambda r: r["__place"])] == sorted(x for k, x in rows if k == g)
        assert {r["__size"] for r in got if r.g == g} == {sum(k == g for k, _ in rows)}


def test_trailing_ranks(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), rng.randrange(300), float(rng.randrange(20))) for i in range(400)]
    got = {r.id: (r.n, r.below) for r in ranks.with_trailing_rank(spark.createDataFrame(rows, "id long, key string, at long, v double"), "id", "key", "at", "v", 60).collect()}
    for i, k, t, v in rows:
        near = [x for _, q, s, x in rows if q == k and t - 60 <= s < t]
        assert got[i] == (len(near), sum(x <= v for x in near))
    assert len(got) == len(rows)


def test_intervals_with_nulls_beside_them(spark):
    spans = spark.createDataFrame([("a", 0, 9, None), ("a", 20, 29, None), ("a", 20, 29, None), ("b", 0, 9, "x")], "key string, low long, high long, note string")
    points = spark.createDataFrame([("a", 5)], "key string, at long")
    anti = ranges.points_in_intervals(spans, points, "key", "low", "high", "at", 10, how="left_anti")
    semi = ranges.points_in_intervals(spans, points, "key", "low", "high", "at", 10, how="left_semi")
    assert sorted(r.low for r in anti.collect()) == [0, 20, 20] and [(r.key, r.low) for r in semi.collect()] == [("a", 0)]


def test_few_rows_of_a_group_are_kept_before_the_shuffle(spark):
    plan = detect.first_per(spark.range(100).selectExpr("id % 3 AS g", "id"), ["g"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_permuted_places_are_a_bijection(spark):
    sizes = [1, 2, 3, 5, 7, 12, 50, 97, 1000, 4099]
    df = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "n long, i long").withColumn("rep", F.explode(F.array(F.lit(1), F.lit(2))))
    got = {}
    for r in df.select("n", "rep", "i", shuffles.permuted(F.col("i"), F.col("n"), F.lit("s"), F.col("rep")).alias("p")).collect():
        got.setdefault((r.n, r.rep), {})[r.i] = r.p
    for (n, _), places in got.items():
        assert sorted(places.values()) == list(range(n))
    assert got[1000, 1] != got[1000, 2] and 300 < np.mean(np.abs(np.array([got[1000, 1][i] for i in range(1000)]) - np.arange(1000))) < 370


def test_dealt_labels_keep_their_numbers(spark):
    rng = random.Random(2)
    rows = [(i, g, rng.choice("xyz"), float(i)) for i, g in enumerate(rng.choices((1, 2, None), (80, 15, 5), k=400))]
    out = shuffles.dealt(spark.createDataFrame(rows, "id long, g long, label string, v double"), ["g"], "id", "label", 5, "seed")
    counts = {(r.rep, r.g, r.dealt): r["count"] for r in out.groupBy("rep", "g", "dealt").count().collect()}
    assert len(counts) == 6 * 9 and all(counts[rep, g, x] == counts[0, g, x] for rep, g, x in counts)
    assert out.where("rep = 0 AND dealt <> label").count() == 0 and out.where("rep = 1 AND dealt <> label").count() > 100
