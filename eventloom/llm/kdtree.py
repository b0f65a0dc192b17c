"""Exact top-k inner products: a k-d tree per shard of the candidates, searched best first with a bound that is handed on.

Shards are cells of a coarse k-d split of the whole space, so their bounding boxes differ, and a query only travels to shards whose box can hold
something as good as what it already knows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textcols import prepare_workers, runs, stored

#: Rows of a shard, of a leaf of its tree and of a block of queries, and shards whose boxes a block of queries meets in one go.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS, BOXES = 8192, 256, 512, 512
#: Rows that the coarse split is cut by, those with the smallest hash of the id, and rows of them that a cell has at least; cells that would need
#: more shards are dealt out by hash. Vector lengths that get a split of their own, the most frequent; others are dealt out by hash alone.
SAMPLE, CELL_ROWS, LENGTHS = 8192, 16, 16
SCALE = 256
#: Scores beyond a long count as the nearest long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Shards of wide vectors, whose numbers need Python's integers, have numbers from here on.
WIDE = 1 << 30


def usable(df: DataFrame) -> DataFrame:
    """vec_id and x, the components as doubles, of rows with an id and a vector whose components are all finite, also when scaled."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * SCALE) < F.lit(math.inf)))
    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & finite)


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("x")
        ends = lists.offsets.to_numpy()
        scaled = np.floor(SCALE * lists.values.to_numpy(zero_copy_only=False))
        vectors = [_bytes(scaled[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.diff(ends).astype(np.int32)), pa.array(vectors, pa.binary())], ["vec_id", "size", "vector"])


def _bytes(numbers: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three widths that holds them; the widest, doubles, holds all that come from doubles."""
    most = np.abs(numbers).max(initial=0)
    return numbers.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64).tobytes()


def _matrix(body: bytes, rows: int, size: int) -> np.ndarray:
    """Rows of whole numbers: int64, or Python's integers where they are wide."""
    kind = {2: np.int16, 4: np.int32}.get(len(body) // max(1, rows * size), np.float64)
    found = np.frombuffer(body, kind).reshape(rows, size)
    if kind is not np.float64 or not size:
        return found.astype(np.int64)
    out = np.empty(found.shape, object)
    out[:] = [[int(x) for x in row] for row in found.tolist()]
    return out


def _clipped(score: int) -> int:
    return min(MOST, max(LEAST, score))


def _parts(vectors: np.ndarray) -> list[np.ndarray]:
    """Places of the rows that int64 holds, and of the others, so that a few wide rows don't slow down all."""
    if vectors.dtype != object:
        return [np.arange(len(vectors))]
    wide = np.array([any(abs(x) >= 1 << 31 for x in row) for row in vectors.tolist()], bool)
    return [p for p in (np.flatnonzero(~wide), np.flatnonzero(wide)) if len(p)]


def _exact(points: np.ndarray, queries: np.ndarray) -> type:
    """The number type in which all inner products are exact: doubles below 2 ** 53, else Python's integers."""
    most = max(1, int(np.abs(points).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0)))
    return np.float64 if most * max(1, points.shape[1]) < 2**53 else object


class _Tree:
    """Nodes in preorder with tight bounding boxes; leaves hold ranges of the reordered points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order, nodes = np.arange(len(ids)), []

        def build(low: int, high: int) -> int:
            own = points[order[low:high]]
            node = len(nodes)
            nodes.append([own.min(0), own.max(0), low, high, -1])
            spread = nodes[node][1] - nodes[node][0]
            ranked = (lambda c, m: np.argsort(c, kind="stable")) if own.dtype == object else np.argpartition
            if high - low > LEAF_ROWS and points.shape[1] and spread.max() > 0:
                axis, middle = int(spread.argmax()), (low + high) // 2
                order[low:high] = order[low:high][ranked(own[:, axis], middle - low)]
                build(low, middle)
                nodes[node][4] = build(middle, high)
            return node

        build(0, len(ids))
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.range, self.right = [(n[2], n[3]) for n in nodes], [n[4] for n in nodes]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(query, vec_id, score) of the k best points of each query, nodes with the highest bounds first.

        least: a score that k points are known to reach; only points at or above it count, and it prunes nodes from the start. One point that has
        the query's id and vector is the query itself and is passed over.
        """
        for part in _parts(queries):
            own = queries[part]
            own = own if own.dtype != object or self.points.dtype == object or np.abs(own).max() >= 1 << 31 else own.astype(np.int64)
            kind = _exact(self.points, own)
            q, points = own.astype(kind), self.points.astype(kind)
            bounds = np.maximum(q, 0) @ self.high.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
            for i, place in enumerate(part.tolist()):
                yield from self._best(int(query_ids[place]), q[i], points, bounds[i], k, int(least[place]))

    def _best(self, me: int, query: np.ndarray, points: np.ndarray, bound: np.ndarray, k: int, limit: int) -> Iterator[tuple[int, int, int]]:
        top: list[tuple[int, int]] = []
        passed = False
        open_nodes = [(-bound[0], 0)]
        while open_nodes:
            most, node = heapq.heappop(open_nodes)
            if _clipped(int(-most)) < limit:
                break
            if self.right[node] >= 0:
                for child in (node + 1, self.right[node]):
                    if _clipped(int(bound[child])) >= limit:
                        heapq.heappush(open_nodes, (-bound[child], child))
                continue
            a, b = self.range[node]
            scores = points[a:b] @ query
            for x in np.flatnonzero(scores >= limit) if limit > LEAST and limit < MOST else range(b - a):
                score, other = _clipped(int(scores[x])), int(self.ids[a + x])
                if score < limit:
                    continue
                if other == me and not passed and (points[a + x] == query).all():
                    passed = True
                    continue
                entry = (score, -other)
                if len(top) < k:
                    heapq.heappush(top, entry)
                elif entry > top[0]:
                    heapq.heapreplace(top, entry)
                if len(top) == k:
                    limit = max(limit, top[0][0])
        yield from ((me, -v, s) for s, v in top)


#: Below every score: what a query knows before its first shard.
NOTHING = LEAST


def _search(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tree = None, None
        for batch in batches:
            for now, size, ids, body, least in zip(*(batch.column(c) for c in ("place", "size", "ids", "body", "least")), strict=True):
                numbers = ids.values.to_numpy()
                vectors = _matrix(body.as_py(), len(numbers), size.as_py())
                if not least.is_valid:
                    place, tree = now.as_py(), _Tree(numbers, vectors)
                elif now.as_py() == place:
                    found = list(zip(*tree.search(numbers, vectors, k, least.values.to_numpy()), strict=True)) or [()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"])

    return rows


_BLOCK = "place long, size int, ids array<long>, body binary, least array<long>"


def _block(place: int, ids: list[int], vectors: np.ndarray, least: list[int] | None) -> tuple:
    return place, vectors.shape[1], ids, _bytes(vectors), least


def _rows(blocks: list[tuple]) -> pa.RecordBatch:
    place, size, ids, body, least = list(zip(*blocks, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((place, size, ids, body, least), kinds, strict=True)], ["place", "size", "ids", "body", "least"])


def _gathered(queries: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "place"):
            place = table.column("place").combine_chunks().to_numpy()
            bounds = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            own, size, vector = table.column("vec_id").to_pylist(), table.column("size").to_pylist(), table.column("vector").to_pylist()
            known = table.column("least").to_pylist() if queries else None
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                points = np.stack([_matrix(v, 1, size[a])[0] for v in vector[a:b]])
                yield _rows([_block(int(place[a]), own[a:b], points, known[a:b] if queries else None)])

    return rows


class _Split:
    """A k-d split of a sample into cells: node i sends a vector to its right child if component axis[i] is above value[i]."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.value, self.left, self.right, self.cells = [], [], [], [], 0

        def build(rows: np.ndarray, cells: int) -> int:
            """The number of the node, or -1 - number of the cell."""
            spread = rows.max(0) - rows.min(0) if rows.size else np.zeros(1)
            axis = int(spread.argmax())
            cut = np.partition(rows[:, axis], (len(rows) - 1) // 2)[(len(rows) - 1) // 2] if rows.size else 0
            high = rows[:, axis] > cut if rows.size else np.zeros(0, bool)
            if cells < 2 or len(rows) < 2 * CELL_ROWS or not high.any():
                self.cells += 1
                return -self.cells
            node = len(self.axis)
            for column, x in ((self.axis, axis), (self.value, cut), (self.left, 0), (self.right, 0)):
                column.append(x)
            self.left[node] = build(rows[~high], (cells + 1) // 2)
            self.right[node] = build(rows[high], cells // 2)
            return node

        self.root = build(sample, cells)
        self.axis, self.value, self.left, self.right = (np.array(x, np.int64) for x in (self.axis, self.value, self.left, self.right))

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        at = np.full(len(vectors), self.root)
        while (live := np.flatnonzero(at >= 0)).size:
            node = at[live]
            at[live] = np.where(vectors[live, self.axis[node]] > self.value[node], self.right[node], self.left[node])
        return -1 - at


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard the tight bounding box, as a block of two rows whose ids name the shard."""
    for batch in batches:
        out = []
        for place, size, ids, body in zip(*(batch.column(c).to_pylist() for c in ("place", "size", "ids", "body")), strict=True):
            points = _matrix(body, len(ids), size)
            out.append(_block(place, [place, place], np.stack([points.min(0), points.max(0)]), None))
        yield _rows(out)


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of queries and each shard of its place the queries that the shard's box may hold something for."""
    now, boxes, held = None, None, []
    for batch in batches:
        for place, size, ids, body, least in zip(*(batch.column(c).to_pylist() for c in ("place", "size", "ids", "body", "least")), strict=True):
            if place != now:
                now, boxes, held = place, None, []
            vectors = _matrix(body, len(ids), size)
            if least is None:
                held.append((ids[0], vectors))
                continue
            if boxes is None and held:
                boxes = []
                for part in (True, False):
                    if some := [h for h in held if (h[1].dtype == object) == part]:
                        boxes.append(([h[0] for h in some], np.stack([h[1][0] for h in some]), np.stack([h[1][1] for h in some])))
            for shards, low, high in boxes or ():
                for part in _parts(vectors):
                    own = vectors[part]
                    kind = _exact(np.concatenate([low, high]), own)
                    q = own.astype(kind)
                    bound = np.maximum(q, 0) @ high.astype(kind).T + np.minimum(q, 0) @ low.astype(kind).T
                    known = np.array([least[i] for i in part], object if kind is object else np.int64)[:, None]
                    # bounds that exceed a long stand for scores that count as the nearest long
                    reach = (bound >= known) | (known == MOST) & (bound >= MOST) | (known == LEAST)
                    for k, shard in enumerate(shards):
                        if len(hit := part[np.flatnonzero(reach[:, k])]):
                            yield _rows([_block(shard, [ids[i] for i in hit], vectors[hit], [least[i] for i in hit])])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: for each id of `queries` the k rows of `vectors` (vec_id, embedding) with the highest integer scores.

    Components x count as floor(256 * x). Vectors that are null, hold null or non-finite components (also when scaled) or have no id take no part;
    only vectors of one length meet. Whole numbers of any size count exactly; a score beyond a long is given, and ranked, as the nearest long.
    Every row but the query's own is a candidate, so repeated rows count each, also those of the query's id; of several query rows with one id the
    one with the smallest vector asks. Ties go to the smaller vec_id. Other columns are ignored.

    A coarse k-d split, cut by a sample, deals candidates into shards; each shard's tree is built in one task, once for each of two rounds. First
    every query visits the shard of its own cell, which gives it a k-th score. With that as bound it is held against the boxes of all shards, in
    blocks, and visits those that can hold something.
    """
    spark = vectors.sparkSession
    prepare_workers(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def quantised(df: DataFrame) -> DataFrame:
        return df.select("vec_id", "x").mapInArrow(_quantised, "vec_id long, size int, vector binary")

    # of equal rows no more than k + 1 can matter
    copies = F.explode(F.array_repeat(F.lit(0), F.least("count", F.lit(k + 1)).cast("int")))
    points = stored(quantised(usable(vectors)).groupBy("vec_id", "size", "vector").count().select("vec_id", "size", "vector", copies.alias("_")).drop("_"))
    asked = stored(quantised(usable(queries).groupBy("vec_id").agg(F.min(F.struct(F.size("x"), "x")).alias("v")).select("vec_id", "v.x")))
    points_wide = (F.col("size") > 0) & (F.length("vector") == 8 * F.col("size"))
    wide = math.ceil(points.where(points_wide).count() / SHARD_ROWS)
    lengths = points.groupBy("size").count().orderBy(F.desc("count"), "size").limit(LENGTHS).collect()
    total = points.count()
    splits, most = {}, max(1, math.ceil((total - sum(r["count"] for r in lengths)) / SHARD_ROWS))
    rest = most
    for r in lengths:
        shards = math.ceil(r["count"] / SHARD_ROWS)
        sample = points.where((F.col("size") == r["size"]) & ~points_wide).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect() if shards > 1 else []
        split = _Split(np.stack([_matrix(x.vector, 1, r["size"])[0] for x in sample]) if sample else np.zeros((0, r["size"]), np.int64), shards)
        splits[r["size"]] = split, max(1, math.ceil(shards / split.cells))
        most = max(most, split.cells * splits[r["size"]][1] + wide)
    sent = spark.sparkContext.broadcast(splits)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its place: the length, so that only vectors of one length meet, and the shard."""
        for batch in batches:
            size, ids, shard = batch.column("size").to_numpy(), batch.column("vec_id").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for n in np.unique(size).tolist():
                own = np.flatnonzero(size == n)
                split, ways = sent.value.get(n, (None, rest))
                body = batch.column("vector").take(pa.array(own)).to_pylist()
                big = np.array([len(v) == 8 * n > 0 for v in body], bool)
                mixed = ids[own].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(32)
                shard[own] = np.where(big, WIDE + (mixed % np.uint64(max(1, wide))).astype(np.int64), (mixed % np.uint64(ways)).astype(np.int64))
                if split is not None and n and not big.all():
                    shard[own[~big]] += split.cell(np.stack([_matrix(v, 1, n)[0] for v, b in zip(body, big.tolist(), strict=True) if not b])) * ways
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((size.astype(np.int64) << 32) + shard)], [*batch.schema.names, "place"])

    def gathered(df: DataFrame, queries: bool) -> DataFrame:
        placed = df.repartition(max(1, min(most, 10 * tasks)), "place").sortWithinPartitions("place", "vec_id")
        return placed.mapInArrow(_gathered(queries), _BLOCK)

    def blocks(df: DataFrame) -> DataFrame:
        n = max(1, math.ceil(df.count() / BLOCK_ROWS))
        return gathered(df.withColumn("place", F.col("size").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), F.lit(n))), True)

    shards = stored(gathered(points.mapInArrow(dealt, "vec_id long, size int, vector binary, place long"), False))

    def visited(some: DataFrame) -> DataFrame:
        both = shards.unionByName(some).repartition(max(1, min(most, 10 * tasks)), "place")
        # a shard has no bounds, and nulls come first
        return both.sortWithinPartitions("place", F.asc_nulls_first("least")).mapInArrow(_search(k), "query_id long, vec_id long, score long")

    own = asked.mapInArrow(dealt, "vec_id long, size int, vector binary, place long").withColumn("least", F.lit(NOTHING))
    known = visited(gathered(own, True)).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(NOTHING)).alias("least"))
    bounded = stored(asked.join(known.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(NOTHING))))
    # boxes lie in groups of BOXES; a block of queries is held against each group of its length
    groups = max(1, math.ceil(most / BOXES))
    chunk = lambda c: F.col("size").cast("long") * (1 << 32) + c
    boxes = shards.mapInArrow(_boxes, _BLOCK).withColumn("place", chunk(F.pmod(F.xxhash64("place"), F.lit(groups))))
    spread = blocks(bounded).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("place", chunk(F.col("chunk"))).drop("chunk")
    both = boxes.unionByName(spread).repartition(max(1, min(groups, 10 * tasks)), "place").sortWithinPartitions("place", F.asc_nulls_first("least"))
    found = visited(stored(both.mapInArrow(_routed, _BLOCK)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
