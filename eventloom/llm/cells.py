"""Centroid clustering by a VA-file: vectors as few-bit cells, distance intervals from look-up tables, full vectors only where intervals overlap."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import WRITTEN, prepare_workers, release, shared_folder, stored

#: Components of a vector, what they are multiplied by, centroids, rounds, and the number that seeds the choice of the first centroids.
DIMENSION, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: A component's cell takes BITS bits; cell borders are quantiles of the SAMPLE vectors with the smallest hashes.
BITS, SAMPLE = 6, 4096
#: Whole numbers up to this keep squared distances of DIMENSION components within 64 bits; beyond it sums are taken in Python's integers.
NARROW = 1 << 27
#: Rows of a full row's copies that one array holds.
COPIES = 10_000
#: Bits of a part of a sum, so that parts of any sum can be added as longs.
LIMB = 30


# -- whole numbers of any size


def packed(vectors: np.ndarray) -> list[bytes]:
    """Rows of whole numbers in doubles as bytes: 2 or 4 for each component where they fit, else the 8 of the double."""
    most = np.abs(vectors).max(axis=1, initial=0.0)
    kinds = np.where(most < 2**15, 2, np.where(most < 2**31, 4, 8))
    out: list[bytes] = [b""] * len(vectors)
    for width, kind in ((2, "<i2"), (4, "<i4"), (8, "<f8")):
        at = np.flatnonzero(kinds == width)
        raw, size = vectors[at].astype(kind).tobytes(), width * vectors.shape[1]
        for k, i in enumerate(at.tolist()):
            out[i] = raw[k * size : (k + 1) * size]
    return out


def unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of whole numbers in doubles, from what `packed` gave."""
    raw = column.to_pylist()
    out = np.zeros((len(raw), dimension))
    for width, kind in ((2, "<i2"), (4, "<i4"), (8, "<f8")):
        at = [i for i, x in enumerate(raw) if len(x) == width * dimension]
        if at:
            out[at] = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(-1, dimension)
    return out


def integers(row: np.ndarray) -> list[int]:
    return [int(x) for x in row.tolist()]


def squared(vectors: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances, exact: int64 where all numbers are narrow, else an object array of Python integers."""
    narrow = not len(vectors) or np.abs(vectors).max(initial=0) <= NARROW
    if narrow and all(abs(x) <= NARROW for c in centroids for x in c):
        whole = vectors.astype(np.int64)
        return np.stack([((whole - np.array(c, np.int64)) ** 2).sum(axis=1) for c in centroids], axis=1)
    out = np.empty((len(vectors), len(centroids)), object)
    for i, row in enumerate(map(integers, vectors)):
        for k, c in enumerate(centroids):
            out[i, k] = sum((x - y) ** 2 for x, y in zip(row, c, strict=True))
    return out


class Sums:
    """Exact component sums of each centroid's vectors, from batches of weighted rows."""

    def __init__(self, centroids: int, dimension: int) -> None:
        self.totals = [[0] * (dimension + 1) for _ in range(centroids)]  # the components, then the count

    def add(self, cluster: np.ndarray, vectors: np.ndarray, copies: np.ndarray) -> None:
        wide = np.abs(vectors).max(axis=1, initial=0) > NARROW
        wide |= np.abs(copies) >= 1 << 20
        for k in np.unique(cluster).tolist():
            mine, total = cluster == k, self.totals[k]
            rows = vectors[mine & ~wide].astype(np.int64)
            weights = copies[mine & ~wide]
            for low in range(0, len(rows), 1 << 15):  # 2 ** 15 rows of 2 ** 27 times 2 ** 20 copies stay within 64 bits
                part = (rows[low : low + (1 << 15)] * weights[low : low + (1 << 15), None]).sum(axis=0)
                for j, x in enumerate(part.tolist()):
                    total[j] += x
            for row, n in zip(map(integers, vectors[mine & wide]), copies[mine & wide].tolist(), strict=True):
                for j, x in enumerate(row):
                    total[j] += x * n
            total[-1] += int(copies[mine].sum())

    def limbs(self) -> Iterator[tuple[int, int, int, int]]:
        """(centroid, component, place, value) with the sum of value * 2 ** (LIMB * place) as total: values that Spark can add as longs."""
        for k, total in enumerate(self.totals):
            for j, x in enumerate(total):
                place, sign, x = 0, -1 if x < 0 else 1, abs(x)
                while x:
                    yield k, j, place, sign * (x & (1 << LIMB) - 1)
                    x >>= LIMB
                    place += 1


# -- the approximation


class Grid(NamedTuple):
    """Cells of each component: cell i holds the whole numbers from border i - 1 to below border i; the first and last cell have no end."""

    borders: list[np.ndarray]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, vectors[:, j], side="right") for j, b in enumerate(self.borders)], axis=1).astype(np.uint8)

    def tables(self, centroids: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each component: lower and upper bounds of (x - c) ** 2, a row per cell and a column per centroid, rounded outwards."""
        out = []
        for low, high, c, slack in self._parts(centroids):
            outside = np.maximum(np.maximum(low - c, c - high) - slack, 0.0)
            farthest = np.maximum(np.abs(low - c), np.abs(high - c)) + slack
            out.append((outside * outside, farthest * farthest))
        return out

    def leads(self, centroids: list[list[int]], best: int) -> list[np.ndarray]:
        """For each component: the least that (x - c) ** 2 - (x - b) ** 2 can be, where b is the best centroid. It is linear in x, so far closer than bounds of both squares."""
        out = []
        for low, high, c, _ in self._parts(centroids):
            b = c[best]
            slope, rest = 2 * (b - c), (c - b) * (c + b)
            ends = np.where(slope == 0, 0.0, np.minimum(slope * np.where(slope == 0, 0, low), slope * np.where(slope == 0, 0, high)))
            out.append(ends + rest)
        return out

    def _parts(self, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Low and high ends of each component's cells, its centroids as doubles, and what that may change them by."""
        for j, b in enumerate(self.borders):
            c = np.array([float(x[j]) for x in centroids])
            yield np.append(-np.inf, b)[:, None], np.append(b - 1, np.inf)[:, None], c, np.abs(c) * 2.0**-52


def grid(sample: np.ndarray, bits: int = BITS) -> Grid:
    """Borders of each component from the smallest value of the sample to behind its largest, as narrow on average as 2 ** bits cells can be.

    A cell's width costs as often as values fall in it, so widths go by one over the root of the density. Values outside the sample's fall in the
    cells without an end, which leave all centroids possible.
    """
    borders = []
    for column in sample.T:
        value, n = np.unique(column, return_counts=True)
        mass = np.cumsum(np.sqrt(n[:-1] * np.diff(value))) if len(value) > 1 else np.zeros(0)
        at = np.searchsorted(mass, np.linspace(0, mass[-1], (1 << bits) - 1)[1:-1]) + 1 if len(mass) else np.zeros(0, int)
        borders.append(np.unique(np.concatenate([value[:1], value[at], value[-1:] + 1])))
    return Grid(borders)


def packed_cells(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A row of bytes for each row of cells, `bits` bits for each."""
    spread = np.unpackbits(cells[:, :, None], axis=2, bitorder="little", count=bits)
    return np.packbits(spread.reshape(len(cells), -1), axis=1, bitorder="little")


def unpacked_cells(column: pa.Array, dimension: int, bits: int = BITS) -> np.ndarray:
    size = (dimension * bits + 7) // 8
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)
    spread = np.unpackbits(raw, axis=1, bitorder="little", count=dimension * bits).reshape(len(raw), dimension, bits)
    return np.packbits(spread, axis=2, bitorder="little")[:, :, 0]


class Judge:
    """Which centroids may be nearest, by cells alone; a row with one candidate needs no full vector.

    Look-up tables add up to an interval of the squared distance to each centroid: those that begin above the smallest upper end are out. Where
    several are left, tables of differences to the likeliest one give intervals of how much farther the others are: those farther for certain are
    out, and equal ones if their number is larger.
    """

    def __init__(self, grid: Grid, centroids: list[list[int]]) -> None:
        self.grid, self.centroids, self.tables, self.leads = grid, centroids, grid.tables(centroids), {}
        # differences are exact in doubles while all parts are whole numbers far below 2 ** 53; wider ones are left to the first test
        ends = [np.abs(b).max(initial=0) for b in grid.borders] + [float(max(map(abs, c))) for c in centroids]
        self.narrow = max(ends) <= 1 << 20

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        k = len(self.centroids)
        low, high = np.zeros((len(cells), k)), np.zeros((len(cells), k))
        for j, (under, over) in enumerate(self.tables):
            low += under[cells[:, j]]
            high += over[cells[:, j]]
        # sums of whole numbers below 2 ** 53 are exact; beyond, each addition and square errs by 2 ** -53 of its result at most
        margin = np.where(high.min(axis=1, initial=np.inf) < 2.0**53, 0.0, 2.0**-44)[:, None]
        out = low * (1 - margin) <= (high * (1 + margin)).min(axis=1)[:, None]
        if self.narrow:
            likely = (low + np.minimum(high, 2.0**60)).argmin(axis=1)
            several = out.sum(axis=1) > 1
            for b in np.unique(likely[several]).tolist():
                at = np.flatnonzero(several & (likely == b))
                lead = np.zeros((len(at), k))
                for j, table in enumerate(self.leads.get(b) or self._lead(b)):
                    lead += table[cells[at, j]]
                farther = np.where(np.arange(k) > b, lead >= 0, lead > 0)
                farther[:, b] = False
                out[at] &= ~farther
        return out

    def _lead(self, b: int) -> list[np.ndarray]:
        self.leads[b] = self.grid.leads(self.centroids, b)
        return self.leads[b]


def nearest(vectors: np.ndarray, mask: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """(nearest candidate, its exact squared distance) of each row; of equally near ones the smallest number."""
    cluster, distance = np.zeros(len(vectors), np.int32), [0] * len(vectors)
    wide = np.abs(vectors).max(axis=1, initial=0) > NARROW
    for part in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        if not len(part):
            continue
        d = squared(vectors[part], centroids)
        if d.dtype == object:
            for i, row, may in zip(part.tolist(), d, mask[part], strict=True):
                cluster[i] = min(np.flatnonzero(may).tolist(), key=lambda k: (row[k], k))
                distance[i] = row[cluster[i]]
        else:
            d = np.where(mask[part], d, np.iinfo(np.int64).max)
            cluster[part] = d.argmin(axis=1)
            for i, x in zip(part.tolist(), d.min(axis=1).tolist(), strict=True):
                distance[i] = x
    return cluster, distance


def _bits_of(mask: np.ndarray) -> np.ndarray:
    return (mask.astype(np.int64) << np.arange(mask.shape[1])).sum(axis=1)


def _mask_of(bits: np.ndarray, k: int) -> np.ndarray:
    return (bits[:, None] >> np.arange(k) & 1).astype(bool)


# -- the passes over Spark tables

_KEY = ["k1", "k2"]
_SUMS = "centroid int, component int, place int, value long"


def usable(vectors: DataFrame, dimension: int, scale: int) -> DataFrame:
    """vec_id and x of the rows whose vector has `dimension` components that stay finite when scaled."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < F.lit(math.inf)))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where((F.size("x") == dimension) & finite)


def whole(rows: DataFrame, dimension: int, scale: int) -> DataFrame:
    """vec_id and `vector`, the packed numbers floor(scale * x)."""

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.floor(scale * b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(packed(values), pa.binary())], ["vec_id", "vector"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(packing, f"vec_id {id_type}, vector binary")


def _updated(found: DataFrame, before: list[list[int]], sums: dict[tuple[int, int], int]) -> list[list[int]]:
    """Centroids after a round: floor of sum by count for each that has vectors; `sums` keeps the running sums, to which the round's changes are added."""
    changes = found.where("centroid IS NOT NULL").groupBy("centroid", "component", "place").agg(F.sum("value").alias("value"))
    for r in changes.collect():  # at most centroids x components x places rows
        sums[r.centroid, r.component] = sums.get((r.centroid, r.component), 0) + r.value * (1 << LIMB * r.place)
    dimension = len(before[0])
    out = []
    for k, old in enumerate(before):
        n = sums.get((k, dimension), 0)
        out.append([sums.get((k, j), 0) // n for j in range(dimension)] if n else old)
    return out


class Clusters(NamedTuple):
    rows: DataFrame  #: vec_id, cluster, distance (null where it exceeds a long)
    centroids: list[list[int]]
    fetched: list[int]  #: distinct vectors read in full in each round after the first, counted from the VA-file's decisions


def clustered(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, bits: int = BITS, sample: int = SAMPLE) -> Clusters:
    """Exact k-means of `vectors` (vec_id, embedding) over whole numbers floor(scale * x), read through a VA-file.

    The table of full vectors is written once, in buckets of a key, with the count of equal rows. The VA-file holds `bits` bits for each
    component and the row's present centroid. A round reads only that: look-up tables turn cells into distance intervals for each centroid, and
    a row whose intervals leave one candidate is assigned. Only rows whose intervals overlap, or that moved (their components must leave one sum
    and join another), meet their full vector: their keys are shuffled to the buckets, the vectors are not. Centroids follow from running sums.
    The last assignment meets every vector, as it reports exact distances.

    Rows whose vector is null, has another length or a component that is null, not finite or not finite after scaling take no part. Whole numbers
    of any size count exactly; a distance beyond a long is null. Repeated rows each count and get their row; rows without an id take part, but
    come last as first centroids. With fewer vectors than `centroids` there are as many centroids as vectors. Other columns are ignored.
    """
    spark, mark = vectors.sparkSession, len(WRITTEN)
    prepare_workers(spark)
    rows = usable(vectors, dimension, scale)
    total = rows.count()
    if not total:
        return Clusters(spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), [], [])
    now = [integers(np.floor(scale * np.array(x))) for x in _first(rows, centroids, total, seed)]
    spread = F.xxhash64("vec_id", "x")
    near = rows.select("x", spread.alias("h")).where(spread.cast("double") <= (min(1.0, sample / total) - 0.5) * 2.0**64).dropDuplicates(["h"])
    cells = grid(np.floor(scale * np.array([r.x for r in near.select("x").collect()]).reshape(-1, dimension)), bits)

    table, path = f"cells_{uuid.uuid4().hex}", shared_folder(spark)
    keyed = whole(rows, dimension, scale).select(F.xxhash64(F.lit(1), "vec_id", "vector").alias("k1"), F.xxhash64(F.lit(2), "vec_id", "vector").alias("k2"), "vec_id", "vector")
    distinct = keyed.groupBy(*_KEY).agg(F.first("vec_id").alias("vec_id"), F.first("vector").alias("vector"), F.count("*").alias("copies"))
    distinct.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *_KEY).sortBy(*_KEY).option("path", path).saveAsTable(table)
    WRITTEN.append(path)
    full = spark.table(table)

    sums: dict[tuple[int, int], int] = {}
    found = stored(full.select(*_KEY, "vector", "copies").mapInArrow(_opening(cells, now, bits), f"k1 long, k2 long, cells binary, cluster int, {_SUMS}"))
    file, fetched = found.where("centroid IS NULL").select(*_KEY, "cells", "cluster"), []
    for _ in range(rounds - 1):
        now = _updated(found, now, sums)
        judged = stored(file.mapInArrow(_judging(cells, now, bits), "k1 long, k2 long, cells binary, old int, candidates long, cluster int"))
        settled = F.col("cluster") == F.col("old")  # cluster is -1 where several candidates are left
        wanted = judged.where(~settled).select(*_KEY, "cells", "old", "candidates")
        found = stored(wanted.hint("shuffle_hash").join(full.select(*_KEY, "vector", "copies"), _KEY).mapInArrow(_moving(now), f"k1 long, k2 long, cells binary, cluster int, {_SUMS}"))
        file = judged.where(settled).select(*_KEY, "cells", "cluster").unionByName(found.where("centroid IS NULL").select(*_KEY, "cells", "cluster"))
        fetched.append(wanted.count())
    now = _updated(found, now, sums)
    judged = file.mapInArrow(_judging(cells, now, bits), "k1 long, k2 long, cells binary, old int, candidates long, cluster int").select(*_KEY, "candidates")
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    last = judged.hint("shuffle_hash").join(full.select(*_KEY, "vec_id", "vector", "copies"), _KEY).mapInArrow(_measuring(now), f"vec_id {id_type}, copies long, cluster int, distance long")
    done = stored(last)
    spark.sql(f"DROP TABLE {table}")
    release(spark, WRITTEN[mark:-1])
    return Clusters(_expanded(done), now, fetched)


def _first(rows: DataFrame, n: int, total: int, seed: int) -> list[list[float]]:
    """The n vectors with the smallest SHA-256 of seed and id, in that order; of equal ids the smaller vector first, null ids last.

    Where enough rows lie below a bound that some hundreds are expected below, no others are sorted.
    """
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    drawn = rows.select(draw.alias("draw"), "x")
    bound = f"{min(2**32 - 1, (n * 32 << 32) // total):08x}"
    for some in (drawn.where(F.substring("draw", 1, 8) <= bound), drawn):
        found = some.orderBy(F.asc_nulls_last("draw"), "x").limit(n).collect()
        if len(found) == n:
            break
    return [r.x for r in found]


def _expanded(done: DataFrame) -> DataFrame:
    """vec_id, cluster, distance of each copy; rows with many copies are dealt out in blocks of COPIES before they are repeated."""
    block = F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / COPIES).cast("int")))
    many = done.where(F.col("copies") > COPIES).withColumn("block", block).repartition("vec_id", "block")
    many = many.withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("block") * COPIES)).drop("block")
    both = done.where(F.col("copies") <= COPIES).unionByName(many.withColumn("copies", F.col("copies").cast("long")))
    return both.select("vec_id", "cluster", "distance", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")).drop("_")


def _sum_rows(sums: Sums) -> pa.RecordBatch:
    limbs = list(zip(*sums.limbs(), strict=True)) or [(), (), (), ()]
    none = [pa.nulls(len(limbs[0]), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int32())]
    return pa.RecordBatch.from_arrays([*none, *(pa.array(x, pa.int32()) for x in limbs[:3]), pa.array(limbs[3], pa.int64())], ["k1", "k2", "cells", "cluster", "centroid", "component", "place", "value"])


def _file_rows(batch: pa.RecordBatch, cells: pa.Array, cluster: np.ndarray) -> pa.RecordBatch:
    n = batch.num_rows
    none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]
    return pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), cells, pa.array(cluster, pa.int32()), *none], ["k1", "k2", "cells", "cluster", "centroid", "component", "place", "value"])


Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _opening(grid: Grid, centroids: list[list[int]], bits: int) -> Pass:
    """Writes the VA-file, whose cells are made from the vectors, with the first assignment; then the task's sums."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, sums = Judge(grid, centroids), Sums(len(centroids), len(centroids[0]))
        for b in batches:
            vectors = unpacked(b.column("vector"), len(centroids[0]))
            cells = grid.cells(vectors)
            mask = judge(cells)
            cluster, open_rows = mask.argmax(axis=1).astype(np.int32), np.flatnonzero(mask.sum(axis=1) > 1)
            cluster[open_rows] = nearest(vectors[open_rows], mask[open_rows], centroids)[0]
            sums.add(cluster, vectors, b.column("copies").to_numpy())
            yield _file_rows(b, pa.array([x.tobytes() for x in packed_cells(cells, bits)], pa.binary()), cluster)
        yield _sum_rows(sums)

    return rows


def _judging(grid: Grid, centroids: list[list[int]], bits: int) -> Pass:
    """Candidates of each row of the VA-file as bits, and the cluster where there is but one, else -1."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(grid, centroids)
        for b in batches:
            mask = judge(unpacked_cells(b.column("cells"), len(centroids[0]), bits))
            cluster = np.where(mask.sum(axis=1) == 1, mask.argmax(axis=1), -1)
            columns = [b.column("k1"), b.column("k2"), b.column("cells"), b.column("cluster"), pa.array(_bits_of(mask)), pa.array(cluster, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "cells", "old", "candidates", "cluster"])

    return rows


def _moving(centroids: list[list[int]]) -> Pass:
    """Decides between the candidates by the full vectors; then the changes of the sums by rows that moved."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(len(centroids), len(centroids[0]))
        for b in batches:
            vectors, old, copies = unpacked(b.column("vector"), len(centroids[0])), b.column("old").to_numpy(), b.column("copies").to_numpy()
            cluster, _ = nearest(vectors, _mask_of(b.column("candidates").to_numpy(), len(centroids)), centroids)
            moved = cluster != old
            sums.add(cluster[moved], vectors[moved], copies[moved])
            sums.add(old[moved], vectors[moved], -copies[moved])
            yield _file_rows(b, b.column("cells"), cluster)
        yield _sum_rows(sums)

    return rows


def _measuring(centroids: list[list[int]]) -> Pass:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance = nearest(unpacked(b.column("vector"), len(centroids[0])), _mask_of(b.column("candidates").to_numpy(), len(centroids)), centroids)
            long = pa.array([x if x < 2**63 else None for x in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("copies"), pa.array(cluster, pa.int32()), long], ["vec_id", "copies", "cluster", "distance"])

    return rows


def with_inertia(clusters: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256; sums that exceed a long, or hold a distance that does, are null."""
    spark = clusters.rows.sparkSession
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)")))
    per = {r.cluster: None if r.s is None else int(r.s) for r in clusters.rows.groupBy("cluster").agg(total.alias("s")).collect()}  # a row per centroid
    every = None if None in per.values() else sum(per.values())
    long = lambda x: x if x is not None and x < 2**63 else None
    table = [(k, long(s), long(every), hashlib.sha256(",".join(map(str, clusters.centroids[k])).encode()).hexdigest()) for k, s in sorted(per.items())]
    sums = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clusters.rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
