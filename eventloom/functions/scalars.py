"""Scalar expressions: normalisation of keys, times and payloads, costs, tiers and rules."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffix of symbols, and the longest name that it is added to.
SUFFIX, LONGEST = "USDT", 12
#: Fixed values: (largest ATR percent below which a tier holds, round-trip cost in percent), and the cost above.
COST_TIERS, COST_TOP = ((1.5, 0.14), (3.0, 0.94)), 1.34


def symbol(v: Column) -> Column:
    """Upper case; a pair written with a slash, with or without its settlement, as one word; no other signs; the common suffix where it isn't there
    already and the name is short enough. Null and empty names are null."""
    s = F.regexp_replace(F.regexp_replace(F.upper(F.trim(v)), f"/{SUFFIX}(:{SUFFIX})?", SUFFIX), "[^A-Z0-9]", "")
    return F.when(F.length(s) == 0, F.lit(None)).when(~s.endswith(SUFFIX) & (F.length(s) <= LONGEST), F.concat(s, F.lit(SUFFIX))).otherwise(s)


def swap_symbol(v: Column) -> Column:
    """AAA-USDT-SWAP as AAAUSDT; null for other instruments."""
    return F.when(v.rlike("^[A-Z0-9]+-USDT-SWAP$"), F.concat(F.split(v, "-")[0], F.lit("USDT")))


def as_millis(v: Column, median: Column) -> Column:
    """Epoch milliseconds; the unit of the column is told by its median (from 1e9 to below 2e10 means seconds)."""
    return F.when((median >= 1e9) & (median < 2e10), v * 1000).otherwise(v)


def number(v: Column, blank: Column | None = None) -> Column:
    """A double or, if the text isn't one, `blank` (null by default)."""
    d = F.trim(v).try_cast("double")
    return d if blank is None else F.coalesce(d, blank)


def floored(at: Column, step: int) -> Column:
    return at - F.pmod(at, F.lit(step))


def latest_closed(now: Column, step: int, lag: int) -> Column:
    """Opening time of the last bar that had closed `lag` before now."""
    return floored(now - lag, step) - step


def to_utc(local: Column, zone: str = "America/New_York") -> Column:
    return F.to_utc_timestamp(local, zone)


def session(at: Column, holiday: Column | bool = False, zone: str = "America/New_York") -> Column:
    """rth (9:30 to 16:00), afterhours (to 22:00), overnight or weekend by the zone's wall clock.

    Holidays and Saturdays and Sundays are weekend whole, Fridays from 22:00 and Mondays before 4:00.
    """
    local = F.from_utc_timestamp(at, zone)
    minute, day = F.hour(local) * 60 + F.minute(local), F.weekday(local)
    edge = ((day == 4) & (minute >= 1320)) | ((day == 0) & (minute < 240))
    out = F.when(minute.between(570, 959), "rth").when(minute.between(960, 1319), "afterhours").when(edge, "weekend").otherwise("overnight")
    return F.when((F.lit(holiday) if isinstance(holiday, bool) else holiday) | (day >= 5), "weekend").otherwise(out)


def bucket(v: Column, edges: list[float]) -> Column:
    """Label of the left-closed bucket: <a, a-b, ..., >=z."""
    f = lambda x: f"{x:g}"
    out = F.when(v >= edges[-1], f">={f(edges[-1])}")
    for a, b in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
        out = F.when((v >= a) & (v < b), f"{f(a)}-{f(b)}").otherwise(out)
    return F.when(v < edges[0], f"<{f(edges[0])}").otherwise(out)


def round_trip_cost(atr: Column, scale: float = 1.0) -> Column:
    """Cost in percent by volatility tier; thresholds belong to the upper tier, and a null counts as calm."""
    out = F.lit(COST_TOP * scale)
    for least, cost in reversed(COST_TIERS):
        out = F.when(F.coalesce(atr, F.lit(0.0)) < least, F.lit(cost * scale)).otherwise(out)
    return out


def net(raw: Column, cost: Column, side: int | Column) -> Column:
    return side * raw - cost


def filled(px: Column, half_spread: Column, side: int, entry: bool) -> Column:
    """Price after paying half the spread on this leg."""
    return px * (1 + half_spread * (side if entry else -side))


def finite(c: Column) -> Column:
    """c, null where it is null, NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def share(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is zero or either is null, NaN or infinite."""
    a, b = (finite(F.col(x) if isinstance(x, str) else x) for x in (a, b))
    return F.try_divide(a, b)


def ret(a: Column | str, b: Column | str) -> Column:
    """The return from price b to price a, guarded like share."""
    return share(a, b) - 1


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b; the default where b is zero or something is null."""
    r = F.try_divide(a, b)
    return r if default is None else F.coalesce(r, F.lit(default))


def freshness(age: Column, strong: int, weak: int) -> Column:
    """strong up to one age, weak up to another, stale beyond; missing where there is none."""
    return F.when(age.isNull(), "missing").when(age <= strong, "strong").when(age <= weak, "weak").otherwise("stale")


def mid_price(bid: Column, ask: Column) -> Column:
    """The middle of both sides; zero when one is missing."""
    return F.when((F.coalesce(bid, F.lit(0.0)) != 0) & (F.coalesce(ask, F.lit(0.0)) != 0), (bid + ask) / 2).otherwise(0.0)


def spread_bp(bid: Column, ask: Column) -> Column:
    """The spread in basis points of the middle; zero without one."""
    return F.coalesce(F.try_divide(ask - bid, F.nullif(mid_price(bid, ask), F.lit(0.0))) * 1e4, F.lit(0.0))


def divergence(share: Column) -> Column:
    """How far a share is from one half, from 0 to 1."""
    return F.abs(share - 0.5) * 2


def first_match(rules: list[tuple[str, Column]], default: str) -> Column:
    """Name of the first rule that holds."""
    out = F.lit(default)
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def within(limits: dict[str, tuple[float | None, float | None]]) -> Column:
    """All columns inside their (least, most); a null fails."""
    tests = [t for c, (a, b) in limits.items() for t in ((F.col(c) >= a) if a is not None else None, (F.col(c) <= b) if b is not None else None) if t is not None]
    return F.coalesce(functools.reduce(operator.and_, tests, F.lit(True)), F.lit(False))


def clean_html(html: Column) -> Column:
    """Text of a fragment: breaks become newlines, tags go, entities are resolved, white space is folded."""
    t = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "(?i)<br\\s*/?>", "\n"), "<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), " ?\\n[\\s]*", "\n"))
