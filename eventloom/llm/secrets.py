"""Secrets in texts: exact base spans per kind, and weak candidates that count only beside the other parts of a credential.

All steps are DataFrame functions. Matches become rows once; places are running sums of the lengths between them, and parts are linked by an
interval join on pieces of SCOPE characters.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textcols import stored

BASE = ("assign", "access", "hex")
#: Characters within which the parts of a credential belong together.
SCOPE = 400
#: Patterns of the parts; the number is the group whose length (base kinds) or mix of characters (weak) decides.
_PATTERNS = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]{32,}+", 0, 32),
    "ident": ("(?i:user_?(?:name|id)?|login|client_?id|account|access_?key_?(?:id)?)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9@._-]+", 0, 1),
    "weak": ("[A-Za-z0-9+/_-]{20,}+", 0, 20),
    "endpoint": ("(?i:https?|ftp|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\\x20\\x09-\\x0D\"'<>]+|(?i:host|endpoint|server|region)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9.-]+", 0, 1),
}
#: Signs of which every match of a pattern has one; a text without them is not searched by it.
_SIGNS = {"assign": (":", "="), "access": ("AKIA",), "ident": (":", "="), "endpoint": (":", "=")}
_KIND = {name: k for k, name in enumerate(_PATTERNS)}


def _parts(text: Column, name: str) -> Column:
    """Matches of a kind in order: (kind, number, characters since the last match, length, whether it holds)."""
    pattern, group, least = _PATTERNS[name]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    holds = lambda v: F.length(v) >= least
    if name == "weak":
        holds = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    rows = F.transform(
        F.arrays_zip(hits.alias("hit"), own.alias("own"), F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap")),
        lambda x, i: F.struct(F.lit(_KIND[name]).alias("kind"), i.alias("number"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), holds(x["own"]).alias("holds")),
    )
    none = F.array().cast("array<struct<kind:int,number:int,gap:int,size:int,holds:boolean>>")
    found = text.rlike(pattern)
    if signs := _SIGNS.get(name):
        found = functools.reduce(operator.or_, (text.contains(s) for s in signs)) & found
    return F.when(found, rows).otherwise(none)


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row per document: row, doc_id, whether it has parts; a row per part: row, doc_id, kind, start, end, holds)."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*(_parts(text, name) for name in _PATTERNS)).alias("parts"))
    found = stored(found.select("row", "doc_id", F.explode_outer("parts").alias("part")).select("row", "doc_id", "part.*"))
    so_far = Window.partitionBy("row", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    parts = found.where("kind IS NOT NULL").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    return found.where("kind IS NULL").select("row", "doc_id"), parts.select("row", "doc_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "holds")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, doc_id, start, end) of weak candidates with the rest of a credential within `scope` characters.

    That is an access key, or an identifier and an endpoint. Candidates inside a base span or an endpoint stay away. Each candidate looks into
    all pieces of text from `scope` before its start to `scope` behind its end, so a row meets at most what those can hold.
    """
    weak = parts.where((F.col("kind") == _KIND["weak"]) & F.col("holds"))
    weak = weak.select("row", "doc_id", "start", "end", F.explode(F.sequence(F.floor((F.col("start") - 1) / scope) - 1, F.floor(F.col("end") / scope) + 1)).alias("piece"))
    others = parts.where((F.col("kind") != _KIND["weak"]) & F.col("holds"))
    others = others.select("row", F.col("kind").alias("other"), F.col("start").alias("low"), F.col("end").alias("high"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))).alias("piece"))
    near = weak.join(others, ["row", "piece"]).where((F.col("low") <= F.col("end") + scope) & (F.col("high") >= F.col("start") - scope))
    has = lambda *names: F.max(F.col("other").isin(*(_KIND[n] for n in names)).cast("int")) == 1
    inside = F.max((F.col("other").isin(*(_KIND[n] for n in (*BASE, "endpoint", "ident"))) & (F.col("low") < F.col("end")) & (F.col("start") < F.col("high"))).cast("int")) == 0
    groups = near.groupBy("row", "doc_id", "start", "end").agg((has("access") | (has("ident") & has("endpoint"))).alias("whole"), inside.alias("free"))
    return groups.where("whole AND free").select("row", "doc_id", "start", "end")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kinds assign, access, hex, and weak for linked candidates) of every row.

    Null and empty texts have none, texts of any length are searched whole; repeated rows each get their row; columns other than doc_id and text
    are ignored.
    """
    without, parts = _placed(docs)
    parts = stored(parts)
    own = parts.select("row", "doc_id", "kind", "start", "end", F.when(F.col("kind") < len(BASE), F.col("holds")).otherwise(F.lit(False)).alias("holds"))
    every = own.unionByName(linked(parts).select("row", "doc_id", F.lit(len(BASE)).alias("kind"), "start", "end", F.lit(True).alias("holds")))
    name = F.element_at(F.array(*(F.lit(x) for x in (*BASE, "weak"))), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("span"))
    text_of = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: x["span"]), ",")
    base = F.col("holds") & (F.col("kind") < len(BASE))
    counts = [F.count_if(F.col("holds") & (F.col("kind") == k)).alias(f"n_{x}") for k, x in enumerate(BASE)]
    found = every.groupBy("row", "doc_id").agg(*counts, F.collect_list(F.when(base, span)).alias("base"), F.collect_list(F.when(F.col("holds"), span)).alias("every"))
    found = found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.col("every")).alias("spans"))
    none = without.select("doc_id", *(F.lit(0).cast("long").alias(f"n_{x}") for x in BASE), F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return found.unionByName(none)
