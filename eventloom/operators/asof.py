"""As-of, first-after and interval joins per key: one union, one shuffle on the key and one ordered window; no row pairs are made.

A key that holds much of the data would make a long window. `slices`, a width of time, cuts its line: windows then run per key and slice, and a row
per key and slice carries on what others end with. "auto" looks for such keys in large tables; None never cuts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import carried, running_sum, slice_width

AUTO = "auto"
Slices = int | str | None


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _width(slices: Slices, both: DataFrame, keys: list[str]) -> int | None:
    return slice_width(both.select(*keys, "__at"), keys, "__at") if slices == AUTO else slices


def _tagged(events: DataFrame, features: dict[str, DataFrame], keys: list[str], at: str, features_first: bool) -> DataFrame:
    """Rows of all tables under each other: keys, __at, __side, __row (an event) and a column for each of `features`, whose rows hold it as `f`."""
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    e = events.select(*keys, F.col(at).alias("__at"), F.lit(1 if features_first else 0).alias("__side"), F.struct(*events.columns).alias("__row"))
    parts = [e.select("*", *(null(f, "f").alias(n) for n, f in features.items()))]
    for name, f in features.items():
        known = f.where(reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col(at).isNotNull()))
        parts.append(known.select(*keys, F.col(at).alias("__at"), F.lit(0 if features_first else 1).alias("__side"), null(e, "__row").alias("__row"), *((F.col("f") if n == name else null(o, "f")).alias(n) for n, o in features.items())))
    return reduce(DataFrame.unionByName, parts)


def _as_feature(table: DataFrame, keys: list[str], at: str, values: list[str], known: str) -> DataFrame:
    return table.select(*keys, at, F.struct(F.col(at).alias(known), *values).alias("f"))


def _opened(joined: DataFrame, values: list[str], known: str, prefix: str, keep: Column | None) -> DataFrame:
    out = joined.where("__row IS NOT NULL")
    if keep is not None:
        out = out.withColumn("__f", F.when(keep, F.col("__f")))
    return out.select("__row.*", F.col(f"__f.{known}").alias(f"{prefix}{known}"), *(F.col(f"__f.{v}").alias(f"{prefix}{v}") for v in values))


def asof(events: DataFrame, features: DataFrame, key: str | list[str], at: str, values: list[str], *, allow_exact: bool = True, tolerance: int | None = None, lag: int = 0, known: str = "known_at", prefix: str = "", slices: Slices = AUTO) -> DataFrame:
    """Every event with the latest feature at or before it (before it, without allow_exact) and the time that was known.

    lag: a feature counts from its time plus lag on. tolerance: features older than that give nulls. Among features of one time the one with
    the largest values (as a struct) counts. Events keep all columns; unmatched ones get nulls.
    """
    keys = _keys(key)
    features = features.withColumn(at, F.col(at) + lag) if lag else features
    both = _tagged(events, {"__f": _as_feature(features, keys, at, values, known)}, keys, at, features_first=allow_exact)
    joined = carried(both, keys, ["__at", "__side", "__f"], ["__f"], _width(slices, both, keys))
    keep = None if tolerance is None else F.col("__at") - F.col(f"__f.{known}") <= tolerance
    out = _opened(joined, values, known, prefix, keep)
    return out.withColumn(f"{prefix}{known}", F.col(f"{prefix}{known}") - lag) if lag else out


def first_after(events: DataFrame, features: DataFrame, key: str | list[str], at: str, values: list[str], *, allow_exact: bool = True, tolerance: int | None = None, known: str = "known_at", prefix: str = "", slices: Slices = AUTO) -> DataFrame:
    """Every event with the first feature at or after it (after it, without allow_exact), null beyond the tolerance."""
    keys = _keys(key)
    both = _tagged(events, {"__f": _as_feature(features, keys, at, values, known)}, keys, at, features_first=not allow_exact)
    joined = carried(both, keys, ["__at", "__side", "__f"], ["__f"], _width(slices, both, keys), backward=True)
    keep = None if tolerance is None else F.col(f"__f.{known}") - F.col("__at") <= tolerance
    return _opened(joined, values, known, prefix, keep)


def asof_chain(events: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], key: str | list[str], at: str, *, slices: Slices = AUTO) -> DataFrame:
    """Latest row at or before each event of several tables, columns `<table>_<value>`: all tables share one union and one sort."""
    keys = _keys(key)
    both = _tagged(events, {f"__{n}": _as_feature(t, keys, at, values, "known_at") for n, (t, values) in tables.items()}, keys, at, features_first=True)
    names = [f"__{n}" for n in tables]
    joined = carried(both, keys, ["__at", "__side", *names], names, _width(slices, both, keys)).where("__row IS NOT NULL")
    return joined.select("__row.*", *(F.col(f"__{n}.{v}").alias(f"{n}_{v}") for n, (_, values) in tables.items() for v in ("known_at", *values)))


def prefix_sum_at(events: DataFrame, flows: DataFrame, key: str, at: str, value: str, low: str, high: str, *, slices: Slices = AUTO) -> DataFrame:
    """Sum of `value` over flows with low < at <= high for each event, by running sums and two as-of lookups; zero without any."""
    totals = flows.groupBy(key, at).agg(F.sum(value).alias("__v"))
    width = slice_width(flows.select(key, at), [key], at) if slices == AUTO else slices
    totals = running_sum(totals, [key], [at], "__v", "__total", width).select(key, F.col(at).alias("__t"), "__total")
    out = events
    for end, name in ((low, "__low"), (high, "__high")):
        looked = asof(out.withColumn("__t", F.col(end)), totals, key, "__t", ["__total"], known="__k", prefix="__p", slices=slices)
        out = looked.withColumnRenamed("__p__total", name).drop("__p__k", "__t")
    return out.withColumn(f"sum_{value}", F.coalesce("__high", F.lit(0)) - F.coalesce("__low", F.lit(0))).drop("__low", "__high")
