"""URL filters: fixed host and path rules, and beyond them templates of paths that are rejected by the purity of their labelled pages.

All steps are DataFrame functions. A tree of path templates is grown per host, level by level, over counts of (host, normalised path); pages
themselves meet only the verdicts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textcols import stored

#: (host and path, verdict); the longest that fits wins.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: A node's children are one variable segment if there are more than KIDS of them, and more than one for every two of its pages.
KIDS = 8
#: Two branches of a node are similar if their shares of blocked pages, and of kinds of segments that follow, are within so many standard errors.
SIMILAR = 2.0
#: Branches of a node, largest first, that one round looks through for anchors; rounds go on until each branch is in a group.
BATCH = 64
#: A template counts as if half of PRIOR more pages were blocked, so one without labels is not rejected; PURITY and more is.
PRIOR, PURITY = 4.0, 0.8
#: With fewer pages nothing is rejected, so branches under it need not be told apart, and the tree ends there.
LEAST = math.ceil(PRIOR * (PURITY - 0.5) / (1 - PURITY) - 1e-9)
#: Templates with more than one in HOT of all pages, fewer than HOT in number, are broadcast to their pages.
HOT = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host is the page's or a parent domain of it, and the page's path starts with its path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        out = F.when(((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest), F.lit(rule)).otherwise(out)
    return out


def _sum(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


#: What can follow a segment: the end, a number, a word with digits, a word.
_FOLLOWS = ("ends", "numbers", "mixed", "words")


def _kind_counts(segments: str, at: Column) -> list[Column]:
    """n, blocked and labelled, and the pages by the kind of their segment at a place, as sums."""
    x = F.get(segments, at)
    kind = F.when(x.isNull(), 0).when(x == "*", 1).when(x.contains("*"), 2).otherwise(3)
    return [*_sum("n", "blocked", "labelled"), *(F.sum(F.when(kind == k, F.col("n")).otherwise(0)).alias(name) for k, name in enumerate(_FOLLOWS))]


def _apart(a: Column, b: Column) -> Column:
    """Whether two branches' shares of anything differ by more than SIMILAR standard errors; where one has no pages to tell, they don't."""

    def differ(hits: str, of: str) -> Column:
        x, n, y, m = a[hits], a[of], b[hits], b[of]
        share = (x + y + 1) / (n + m + 2)
        error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), m)))
        return F.coalesce(F.abs(F.try_divide(x, n) - F.try_divide(y, m)) > SIMILAR * error, F.lit(False))

    out = differ("blocked", "labelled")
    for name in _FOLLOWS:
        out = out | differ(name, "n")
    return out


def _grown(level: DataFrame) -> DataFrame:
    """The parts (host, template, segment, part) that the branches of each open node add to its template.

    Variable segments become *. Of other branches, the one with most labels is an anchor, and those similar to it join it; then the same among
    the rest, until none is left. Branches of fewer than LEAST pages, of which nothing can be told, stay on their own. A round finds all anchors
    among the BATCH largest open branches of each node, and every open branch joins the first of them that it is similar to.
    """
    node = ["host", "template"]
    children = stored(level.groupBy(*node, F.get("segments", F.col("depth")).alias("segment")).agg(*_kind_counts("segments", F.col("depth") + 1)))
    totals = children.groupBy(*node).agg(F.count("*").alias("kids"), F.sum("n").alias("all_n"))
    variable = (F.col("kids") > KIDS) & (2 * F.col("kids") > F.col("all_n"))
    own = F.when(variable, F.lit("/*")).when(F.col("n") < LEAST, F.concat(F.lit("/"), "segment"))
    branch = F.struct("labelled", "n", "segment", "blocked", *_FOLLOWS)
    rest = children.join(totals, node).select(*node, "segment", branch.alias("branch"), own.alias("part"))
    largest, met = Window.partitionBy(*node).orderBy(F.desc("branch")), 0
    while True:
        heads = rest.where("part IS NULL").withColumn("__r", F.row_number().over(largest)).where(F.col("__r") <= BATCH)
        heads = heads.groupBy(*node).agg(F.reverse(F.array_sort(F.collect_list("branch"))).alias("heads"))
        none = F.array().cast(heads.schema["heads"].dataType)
        anchors = F.aggregate("heads", none, lambda acc, x: F.when(F.exists(acc, lambda a: ~_apart(a, x)), acc).otherwise(F.concat(acc, F.array(x))))
        rest = rest.join(heads.select(*node, anchors.alias("anchors")), node, "left")
        first = F.array_position(F.transform("anchors", lambda a: ~_apart(a, F.col("branch"))), True)
        joins = F.col("part").isNull() & (first > 0)
        rest = stored(rest.withColumn("part", F.when(joins, F.concat(F.lit("/~"), (first + met).cast("string"))).otherwise(F.col("part"))).drop("anchors"))
        if not rest.where("part IS NULL").head(1):
            return rest.drop("branch")
        met += BATCH


def _straight(level: DataFrame) -> DataFrame:
    """`level` with straight: how many segments all pages of an open node have in common from its depth on, as its smallest and largest rest have."""
    node = ["host", "template"]
    rest = F.slice("segments", F.col("depth") + 1, F.size("segments") - F.col("depth"))
    ends = level.groupBy(*node).agg(F.min(rest).alias("low"), F.max(rest).alias("high"))
    differ = F.array_position(F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    common = F.when(differ == 0, F.size("low")).otherwise(differ - 1).cast("int")
    return level.join(ends.select(*node, common.alias("straight")), node)


def template_verdicts(counts: DataFrame) -> DataFrame:
    """(host, shape, n, template, purity) from counts (host, shape, n, blocked, labelled); shape is a path's normalised segments joined by /.

    A branch is followed while it has LEAST pages and any of them goes on, however deep. Where all its pages go the same way it is followed to the
    next fork in one round, so rounds grow with forks and not with depth. A page's template ends where its path or its branch does.
    """
    node = ["host", "template"]
    segments = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))
    level, done = counts.withColumns({"segments": segments, "template": F.lit(""), "depth": F.lit(0)}), []
    columns = level.columns
    while True:
        size = level.groupBy(*node).agg(F.sum("n").alias("node_n"))
        level = stored(level.join(size, node).withColumn("open", (F.size("segments") > F.col("depth")) & (F.col("node_n") >= LEAST)).drop("node_n"))
        # what ends here and what a small branch still has are told apart from what goes on by their templates
        done.append(level.where("NOT open").select("host", "shape", "n", "blocked", "labelled", "template"))
        level = level.where("open").drop("open")
        if not level.head(1):
            break
        level = stored(_straight(level))
        # an only branch is its node's anchor and joins itself
        ahead = level.where("straight > 0").withColumns({"template": F.concat("template", F.expr("repeat('/~1', straight)")), "depth": F.col("depth") + F.col("straight")})
        forks = level.where("straight = 0")
        if forks.head(1):
            forks = forks.withColumn("segment", F.get("segments", F.col("depth"))).join(_grown(forks), [*node, "segment"])
            forks = forks.withColumns({"template": F.concat("template", "part"), "depth": F.col("depth") + 1})
        level = ahead.select(*columns).unionByName(forks.select(*columns))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    every = stored(every)
    purity = (F.sum("blocked") + PRIOR / 2) / (F.sum("labelled") + PRIOR)
    return every.join(every.groupBy(*node).agg(purity.alias("purity")), node).select("host", "shape", "n", "template", "purity")


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages` (page_id, url); other columns are ignored.

    Pages under a rule get its verdict and are the labelled ones; the others are blocked if their template is. Urls that are null or have no
    :// have empty host and path and are judged like any other; paths of any length count whole; repeated rows count each.
    """
    url = F.col("url")
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "*"))
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    seen = seen.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "shape": F.array_join(segments, "/")})
    verdict = F.element_at(F.create_map(*(F.lit(x) for r in rules for x in r)), F.col("rule"))
    seen = stored(seen.withColumn("verdict", F.when(F.col("rule").isNotNull(), verdict)))
    keys = ["host", "shape"]
    counts = stored(seen.groupBy(keys).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count("verdict").alias("labelled")))
    told = stored(template_verdicts(counts).select(*keys, "n", F.when(F.col("purity") >= PURITY, "block").otherwise("allow").alias("told")))
    total = told.agg(F.sum("n")).first()[0] or 0
    hot = told.where(F.col("n") * HOT > total).select(*keys, F.col("told").alias("hot"))
    told = told.where(F.col("n") * HOT <= total).drop("n")
    rest = seen.where("rule IS NULL").join(F.broadcast(hot), keys, "left")  # fewer than HOT rows
    out = ["page_id", "host", "path", "rule"]
    frequent = rest.where("hot IS NOT NULL").select(*out, F.col("hot").alias("verdict"))
    rare = rest.where("hot IS NULL").drop("hot").join(told, keys, "left").select(*out, F.coalesce("told", F.lit("allow")).alias("verdict"))
    return seen.where("rule IS NOT NULL").select(*out, "verdict").unionByName(frequent).unionByName(rare)
