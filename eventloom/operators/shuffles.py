"""Shuffles inside groups of any size without sorting them: a keyed bijection of places deals labels out anew."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import with_place
from .slices import joined_back

#: Rounds of the bijection.
ROUNDS = 4
#: The modulus and multipliers of two well-known multiplicative generators, which mix a round's half with its key.
PRIME, FIRST, SECOND = 2147483647, 48271, 69621


def places(place: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Bijections of 0..size-1, one for each seed (a text) and size.

    Places lie on a rectangle of about root by root, whose sides are shifted in turn by hashes of each other, and a place outside the group goes on
    until it is inside. The keys of the rounds are the words of the seed's md5.
    """
    codes, names = pd.factorize(seed)
    keys = np.frombuffer(b"".join(hashlib.md5(str(s).encode()).digest() for s in names), ">u4").reshape(-1, ROUNDS).astype(np.int64)[codes]
    wide = np.ceil(np.sqrt(size)).astype(np.int64)
    high = (size + wide - 1) // wide
    x, outside = place.astype(np.int64), np.arange(len(place))
    while len(outside):
        left, right = np.divmod(x[outside], high[outside])
        for i in range(ROUNDS):
            half = right if i % 2 == 0 else left
            mixed = (half + keys[outside, i]) % PRIME * FIRST % PRIME
            mixed = (mixed ^ mixed // 8192) % PRIME * SECOND % PRIME
            if i % 2 == 0:
                left = (left + mixed) % wide[outside]
            else:
                right = (right + mixed) % high[outside]
        x[outside] = left * high[outside] + right
        outside = outside[x[outside] >= size[outside]]
    return x


def permuted(place: Column, size: Column, *seed: Column) -> Column:
    """`places` as a column: a loop that ends row by row, which built-in functions have no form for; batches of Arrow, no row by row Python."""

    @F.pandas_udf("long")
    def run(place: pd.Series, size: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series(places(place.to_numpy(), size.to_numpy(), seed.to_numpy()))

    return run(place.cast("long"), size.cast("long"), F.concat_ws("|", *(p.cast("string") for p in seed)))


def dealt(rows: DataFrame, group: list[str], row_id: str, label: str, reps: int, seed: str) -> DataFrame:
    """`rows` with columns rep and dealt: the label of each row itself (rep 0) and as dealt out anew inside its group (reps 1 to `reps`).

    Rows are numbered in their group by a unique whole number. In a replicate a row's place is permuted, and the place tells the label, as if the
    group's labels lay in order. So no replicate sorts or shuffles anything; what follows can aggregate where the rows are. Labels are few.
    """
    counts = rows.groupBy(*group, label).agg(F.count("*").alias("__n"))
    held = F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col("__n").alias("n"))))  # an entry per label
    upto = F.aggregate(held, F.array().cast(f"array<struct<upto:bigint,label:{rows.schema[label].dataType.simpleString()}>>"), lambda acc, x: F.concat(acc, F.array(F.struct((F.coalesce(F.try_element_at(acc, F.lit(-1))["upto"], F.lit(0)) + x["n"]).alias("upto"), x["label"].alias("label")))))
    labels = counts.groupBy(*group).agg(upto.alias("__labels"))
    placed = joined_back(with_place(rows, group, row_id), labels, group)
    x = placed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    x = x.withColumn("__to", permuted(F.col("__place"), F.col("__size"), F.lit(seed), F.col("rep"), *(F.col(g) for g in group)))
    new = F.get(F.filter("__labels", lambda s: F.col("__to") < s["upto"]), F.lit(0))["label"]
    return x.withColumn("dealt", F.when(F.col("rep") == 0, F.col(label)).otherwise(new)).drop("__place", "__size", "__labels", "__to")


def _mixed_sql(half: str, key: str) -> str:
    x = f"(({half} + {key}) % {PRIME} * {FIRST} % {PRIME})"
    return f"(xor({x}, {x} // 8192) % {PRIME} * {SECOND} % {PRIME})"


def dealt_sql(table: str, group: str, row_id: str, label: str, reps: int, seed: str) -> str:
    """Common table expressions for `dealt` (with WITH RECURSIVE): `rows_dealt` has the columns of `table`, rep and dealt."""
    digest = f"md5(concat_ws('|', '{seed}', rep::VARCHAR, {group}::VARCHAR))"
    keys = ", ".join(f"('0x' || substr({digest}, {8 * i + 1}, 8))::BIGINT AS d_k{i}" for i in range(ROUNDS))

    def once(source: str) -> str:
        out = f"SELECT *, d_x // d_high AS d_l, d_x % d_high AS d_r FROM ({source})"
        for i in range(ROUNDS):
            side = f"(d_l + {_mixed_sql('d_r', f'd_k{i}')}) % d_wide AS d_l" if i % 2 == 0 else f"(d_r + {_mixed_sql('d_l', f'd_k{i}')}) % d_high AS d_r"
            out = f"SELECT * REPLACE ({side}) FROM ({out})"
        return f"SELECT * EXCLUDE (d_l, d_r) FROM (SELECT * REPLACE (d_l * d_high + d_r AS d_x) FROM ({out}))"

    return f"""dl AS (SELECT {group}, {label} AS label, sum(count(*)) OVER (PARTITION BY {group} ORDER BY {label}) AS upto FROM {table} GROUP BY {group}, {label}),
dp AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {row_id}) - 1 AS d_x, count(*) OVER (PARTITION BY {group}) AS d_size, ceil(sqrt(count(*) OVER (PARTITION BY {group})))::BIGINT AS d_wide FROM {table}),
dr AS (SELECT *, (d_size + d_wide - 1) // d_wide AS d_high, unnest(range(1, {reps + 1})) AS rep FROM dp),
dw AS ({once(f"SELECT *, {keys} FROM dr")} UNION ALL {once("SELECT * FROM dw WHERE d_x >= d_size")}),
rows_dealt AS (SELECT * EXCLUDE (d_x, d_size, d_wide, d_high, {", ".join(f"d_k{i}" for i in range(ROUNDS))}), (SELECT arg_min(label, upto) FROM dl WHERE dl.{group} = dw.{group} AND dw.d_x < dl.upto) AS dealt FROM dw WHERE d_x < d_size UNION ALL SELECT *, 0 AS rep, {label} AS dealt FROM {table})"""
