"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary-trie self-join under a Hamming budget.

near_duplicates() links by the fingerprints alone. deduplicated() takes five-word shingles and a wider budget, and holds each link that the trie
join proposes against the exact Jaccard similarity of the two texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .textcols import joined_words, passes, prepare_workers, runs, split_words, stored, text_buffer

SHINGLE, BUDGET, SEED = 3, 3, 42
#: deduplicated(): words of a shingle, bits within which a pair is looked at, and the similarity (a fraction) from which it is a link. Sets of one
#: size at that similarity have a cosine of 8/9, so a bit differs with a chance of 0.15: 9.7 bits of 64 on average, 13 or fewer in 0.91 of all cases.
WIDE_SHINGLE, WIDE_BUDGET, SIMILARITY = 5, 13, (4, 5)
#: Ratio of the sizes of neighbouring bands of sets; sets at the similarity differ by 1.25 at most, so they are in one band or in neighbours.
BAND = 1.26
#: Rows of a group from which it is dealt out once more by further bits, and from which it is cut into chunks of which all pairs meet.
GROUP_ROWS, CHUNK_ROWS = 20_000, 100_000
#: Rows that one task of the join gets on average at most, whatever spark.sql.shuffle.partitions says.
TASK_ROWS = 500_000
#: Large groups whose keys are broadcast; were there more, they would be joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Node pairs of the trie join that are open at once, and the size product from which a node pair is compared one by one.
OPEN_PAIRS, LEAF = 1 << 17, 256
#: Rows behind it that each row is held against first, so that dense groups are connected before the trie is followed down.
NEXT = 4
#: Bits of a document's parity map, of which two sets differ in no more than they have shingles that are not in both.
MAP_BITS = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A nibble's bits in four 16-bit lanes, so that one addition counts four bits.
_LANES = np.array([sum(((x >> b) & 1) << (16 * b) for b in range(4)) for x in range(16)], np.uint64)


def _majority(h: np.ndarray, doc: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each document the bits that over half of its hashes have; place: each hash's number in its document, count: hashes per document."""
    if not len(h):
        return np.zeros(len(count), np.uint64)
    # lanes hold 65,535 at most: longer documents are counted in several segments
    cut = np.flatnonzero(place % 60_000 == 0)
    ones = np.zeros((len(count), 64), np.int64)
    for nibble in range(16):
        lanes = np.add.reduceat(_LANES[(h >> np.uint64(4 * nibble)) & np.uint64(15)], cut)
        for b in range(4):
            ones[:, 4 * nibble + b] = np.bincount(doc[cut], ((lanes >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.float64), len(count))
    bits = 2 * ones > count[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def fingerprints(column: pa.Array) -> np.ndarray:
    """The SimHash of each text as uint64; texts without words have 0."""
    data, offsets = text_buffer(column)
    words = split_words(_LOWER[data], offsets)
    n, doc_at = len(words.values), words.doc_offsets
    if not n:
        return np.zeros(len(column), np.uint64)
    joined, start, end = joined_words(words)
    count = np.diff(doc_at)
    shingles = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), shingles)
    first = np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles) + doc_at[doc]
    last = np.minimum(first + SHINGLE, doc_at[doc + 1]) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
    return _majority(h, doc, first - doc_at[doc], shingles)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in passes(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text")).view(np.int64))], ["doc_id", "fp"])


class _Forest:
    """Rows that are connected so far, and the pairs that connected them."""

    def __init__(self, n: int, root: np.ndarray | None = None):
        self.root = np.arange(n) if root is None else root
        self.pairs: list[np.ndarray] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Connects i and j; of many pairs only those are kept that connect something new."""
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((low, high))
            one = order[np.append(True, high[order][1:] != high[order][:-1])]
            self.pairs.append(np.stack([i[one], j[one]]))
            self.root[high[one]] = low[one]
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


def trie_join(
    group: np.ndarray, fp: np.ndarray, budgets: np.ndarray, alike: Callable | None = None, root: np.ndarray | None = None, band: np.ndarray | None = None
) -> np.ndarray:
    """Pairs (2 x n) of rows of one group whose fingerprints differ in budgets[64] bits at most and that are alike(i, j).

    Without `root` the pairs are a spanning forest of all such pairs; with it they are all of those whose roots differ. With `band` only rows of
    one band or of neighbouring bands meet. `group`, within it `band`, and within that `fp` (uint64) must be sorted: a trie node is then a range of
    rows that share their leading bits. Pairs of nodes are followed down together; a bit in which they part adds one to their error, and pairs
    beyond budgets[d], the budget of the d leading bits, are dropped, as are pairs of nodes that are connected already.
    """
    n = len(fp)
    forest, found = _Forest(n, root), []

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        apart = (np.bitwise_count(fp[i] ^ fp[j]) <= budgets[64]) & (forest.root[i] != forest.root[j])
        i, j = i[apart], j[apart]
        if alike is not None and len(i):
            near = alike(i, j)
            i, j = i[near], j[near]
        if root is None:
            forest.add(i, j)
        elif len(i):
            found.append(np.stack([i, j]))

    band = np.zeros(n, np.int64) if band is None else band
    low = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (band[1:] != band[:-1]))[:n])
    high = np.append(low[1:], n)[: len(low)]
    if root is None:
        ends = np.repeat(high, high - low)
        for k in range(1, NEXT + 1):
            i = np.flatnonzero(np.arange(n) + k < ends)
            meet(i, i + k)
    many = high - low > 1
    beside = np.flatnonzero((group[low[1:]] == group[low[:-1]]) & (band[low[1:]] == band[low[:-1]] + 1))
    first = np.concatenate([np.stack([low, high, low, high])[:, many], np.stack([low[beside], high[beside], low[beside + 1], high[beside + 1]])], 1)
    stack = [(first, np.zeros(first.shape[1], np.int8), 0)]
    while stack:
        pair, error, depth = stack.pop()
        if pair.shape[1] > OPEN_PAIRS:
            half = pair.shape[1] // 2
            stack += [(pair[:, :half], error[:half], depth), (pair[:, half:], error[half:], depth)]
            continue
        if n:
            change = np.append(0, np.cumsum(forest.root[1:] != forest.root[:-1]))
            one = (change[pair[0]] == change[pair[1] - 1]) & (change[pair[2]] == change[pair[3] - 1]) & (forest.root[pair[0]] == forest.root[pair[2]])
            pair, error = pair[:, ~one], error[~one]
        sizes = (pair[1] - pair[0]) * (pair[3] - pair[2])
        leaf = (sizes <= LEAF) | (depth == 64)
        leaves, total = pair[:, leaf], sizes[leaf]
        for some in np.array_split(np.arange(leaves.shape[1]), max(1, int(total.sum()) >> 18)) if leaves.shape[1] else []:
            a_low, a_high, b_low, b_high = leaves[:, some]
            rows = a_high - a_low
            which = np.repeat(np.arange(len(some)), rows)
            a = np.arange(len(which)) + (a_low - np.cumsum(rows) + rows)[which]
            wide = (b_high - b_low)[which]
            ends = np.cumsum(wide)
            j = np.arange(ends[-1]) + np.repeat(b_low[which] - ends + wide, wide)
            near = np.flatnonzero(np.bitwise_count(np.repeat(fp[a], wide) ^ fp[j]) <= budgets[64])
            i, j = a[np.searchsorted(ends, near, side="right")], j[near]
            meet(i[i < j], j[i < j])
        pair, error = pair[:, ~leaf], error[~leaf]
        if not pair.shape[1]:
            continue
        mask, parts = np.uint64(1) << np.uint64(63 - depth), []
        ends = [_first_set(fp, pair[2 * x], pair[2 * x + 1], mask) for x in (0, 1)]
        halves = [((pair[2 * x], ends[x]), (ends[x], pair[2 * x + 1])) for x in (0, 1)]
        itself = (pair[0] == pair[2]) & (pair[1] == pair[3])
        for x in (0, 1):
            for y in (0, 1):
                e = error + (x != y)
                keep = (e <= budgets[depth + 1]) & (halves[0][x][0] < halves[0][x][1]) & (halves[1][y][0] < halves[1][y][1]) & ~(itself & (x > y))
                parts.append((np.stack([*halves[0][x], *halves[1][y]])[:, keep], e[keep]))
        stack.append((np.concatenate([p for p, _ in parts], 1), np.concatenate([e for _, e in parts]), depth + 1))
    pairs = forest.pairs if root is None else found
    return np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each fingerprint the index of a root, equal for fingerprints of one group that links within `budget` bits connect."""
    forest = _Forest(len(fp))
    forest.add(*trie_join(group, fp, np.full(65, budget)))
    return forest.root


def _first_set(fp: np.ndarray, low: np.ndarray, high: np.ndarray, mask: np.uint64) -> np.ndarray:
    """The first row of each range that has the bit, by bisection in all ranges together."""
    low, high = low.copy(), high.copy()
    while (live := low < high).any():
        mid = (low + high) // 2
        has = np.zeros(len(mid), bool)
        has[live] = (fp[mid[live]] & mask) != 0
        high = np.where(live & has, mid, high)
        low = np.where(live & ~has, mid + 1, low)
    return low


class _Part(NamedTuple):
    """A turn of the fingerprint; any two within the budget keep to all of `budgets` in at least one part."""

    turn: int  #: bits by which the fingerprint is turned to the left
    exact: int  #: leading bits that agree
    near: int  #: leading bits in which no more than `errors` differ
    errors: int
    budgets: np.ndarray  #: how many of the d leading bits may differ, for d from 0 to 64


def _parts(budget: int) -> list[_Part]:
    """One part for each of the stretches that the 64 bits are cut into, in which the order begins with that stretch.

    Of n stretches in a ring with `budget` errors, one is such that it and those that follow never hold more errors than their share: i of them
    floor(i * budget / n) at most, whatever i (the cycle lemma). With budget + 1 stretches those are 0, 1, 2, ... errors.
    """
    n = max(budget + 1, 4)
    edges = [64 * k // n for k in range(n + 1)]
    out = []
    for k in range(n):
        widths = [edges[(k + i) % n + 1] - edges[(k + i) % n] for i in range(n)]
        budgets = np.append(0, np.repeat([(i + 1) * budget // n for i in range(n)], widths))
        near = 64 if budget <= 3 else sum(widths[:3])
        out.append(_Part(edges[k], widths[0], near, int(budgets[near]), budgets))
    return out


def _arranged(part: _Part) -> Column:
    """fp as a part turns it."""
    return F.shiftleft("fp", part.turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - part.turn)) if part.turn else F.col("fp")


def _keyed(nodes: DataFrame, budget: int) -> DataFrame:
    """`nodes` once for each group that they meet others in: columns key, part and fp as that part has it.

    A group is given by the part and its exact bits. Larger ones are dealt out by the same argument over the bits that follow: of the errors left
    there, one of so many stretches has none. What is larger still, as its fingerprints hardly differ, is cut into chunks, and all pairs of chunks
    become groups.
    """
    parts = _parts(budget)
    own = F.array(*(F.struct(F.lit(k).alias("part"), _arranged(p).alias("fp"), (F.shiftrightunsigned(_arranged(p), 64 - p.exact) + (k << 16)).alias("key")) for k, p in enumerate(parts)))
    rest = [c for c in nodes.columns if c != "fp"]
    keyed = nodes.select(*rest, F.explode(own).alias("g")).select(*rest, "g.*")

    def sized(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
        """df with the rows of its group where those are more than `rows`, and whether there are such groups; if not, nothing is joined."""
        large = stored(df.groupBy("key").count().where(F.col("count") > rows).withColumnRenamed("count", "rows"))
        n = large.count()
        return df.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, "key", "left") if n else df, n > 0

    again = F.array("key")
    for k, p in enumerate(parts):
        edges = [p.exact + (p.near - p.exact) * j // (p.errors + 1) for j in range(p.errors + 2)]
        keys = [(F.col("key") + 1) * (1 << 24) + (j << 16) + F.shiftrightunsigned("fp", 64 - b).bitwiseAND((1 << (b - a)) - 1) for j, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
        again = F.when(F.col("part") == k, F.array(*keys)).otherwise(again)
    keyed, some = sized(keyed, GROUP_ROWS)
    if some:
        keyed = keyed.withColumn("key", F.explode(F.when(F.col("rows").isNull(), F.array("key")).otherwise(again))).drop("rows")
    chunks = F.ceil(F.col("rows") / CHUNK_ROWS).cast("long")
    own = F.pmod(F.xxhash64("node", "key"), chunks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda x: F.xxhash64(F.col("key"), F.least(x, own), F.greatest(x, own)))
    keyed, some = sized(keyed, 2 * CHUNK_ROWS)
    return keyed.withColumn("key", F.explode(F.when(F.col("rows").isNull(), F.array("key")).otherwise(pairs))).drop("rows") if some else keyed


def _bands(n: np.ndarray) -> np.ndarray:
    """Bands of set sizes; sets that are alike are in one band or in neighbouring ones."""
    return np.floor(np.log(n) / math.log(BAND)).astype(np.int64)


def _met(budget: int, rows_alike: Callable | None, rooted: bool = False):
    parts = _parts(budget)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "key"):
            key, part, fp, node = (table.column(c).to_numpy() for c in ("key", "part", "fp", "node"))
            fp = fp.view(np.uint64)
            for k in np.unique(part).tolist():
                own = np.flatnonzero(part == k)
                band = _bands(table.column("n").to_numpy()) if "n" in table.column_names else np.zeros(len(key), np.int64)
                own = own[np.lexsort((fp[own], band[own], key[own]))]
                alike = rows_alike(table.take(pa.array(own))) if rows_alike else None
                root = np.unique(table.column("root").to_numpy()[own], return_inverse=True)[1] if rooted else None
                i, j = trie_join(key[own], fp[own], parts[k].budgets, alike, root, band[own])
                yield pa.RecordBatch.from_arrays([pa.array(node[own[i]]), pa.array(node[own[j]])], ["u", "v"])

    return rows


def links(nodes: DataFrame, budget: int = BUDGET, alike: Callable | None = None) -> DataFrame:
    """Edges (u, v) between the nodes of `nodes` (node, fp and what `alike` needs) that connect all fingerprints within `budget` bits of each other.

    Each group gives a spanning forest, never all of its pairs. With a column root it gives all pairs whose roots differ. With a column n, the sizes
    of sets, only sets in one band of sizes or in neighbouring ones meet.
    """
    count = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(count, math.ceil(nodes.count() * len(_parts(budget)) / TASK_ROWS))
    met = _met(budget, alike, "root" in nodes.columns)
    return _keyed(nodes, budget).repartition(count, "key").sortWithinPartitions("key").mapInArrow(met, "u long, v long")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id for every row of `docs` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links. Null and wordless texts have fingerprint 0 and are linked like any other. Rows
    repeated with one doc_id each get their row. Null ids are passed over: such a row gets the id of its group, null if that has none.
    """
    prepare_workers(docs.sparkSession)
    prints = stored(docs.select("doc_id", "text").mapInArrow(_fingerprint_rows, "doc_id long, fp long"))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes.where("node IS NOT NULL")))
    ids = stored(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)


def shingle_sets(column: pa.Array, shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets): the sorted distinct shingle hashes (uint64) of each text, in lower case.

    A text under `shingle` words is one shingle, a text without words the shingle 0.
    """
    data, offsets = text_buffer(column)
    words = split_words(_LOWER[data], offsets)
    n, at = len(words.values), words.doc_offsets
    count = np.diff(at)
    coded = words.values.dictionary_encode()
    own = np.append(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy()], np.uint64(0))
    shingles = np.maximum(count - shingle + 1, 1)
    doc = np.repeat(np.arange(len(count)), shingles)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + at[doc]
    h = np.zeros(len(doc), np.uint64)
    for k in range(shingle):
        live = first + k < at[doc + 1]
        h = np.where(live, _mixed(h) + own[np.minimum(first + k, n)], h)
    h = _mixed(h ^ (h >> np.uint64(32)))
    h ^= h >> np.uint64(31)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.append(0, np.cumsum(np.bincount(doc[new], minlength=len(count))))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, shingles, offsets, node): node is a hash of the set, so equal sets are one node."""
    for batch in batches:
        for part in passes(batch):
            values, at = shingle_sets(part.column("text"))
            raw, ends = values.tobytes(), (8 * at).tolist()
            node = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)), np.int64)
            yield part, values, at, node


def set_fingerprints(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The SimHash of each set of shingle hashes (uint64)."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return _majority(values, doc, np.arange(len(values)) - at[doc], np.diff(at))


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, values, at, node in _set_rows(batches):
        doc = np.repeat(np.arange(len(node)), np.diff(at))
        count = np.zeros(len(node) * MAP_BITS, np.uint8)
        np.add.at(count, doc * MAP_BITS + (values % np.uint64(MAP_BITS)).astype(np.int64), np.uint8(1))
        bits = pa.array([x.tobytes() for x in np.packbits(count.reshape(-1, MAP_BITS) & 1, axis=1)], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(node), pa.array(set_fingerprints(values, at).view(np.int64)), pa.array(np.diff(at)), bits], ["doc_id", "node", "fp", "n", "bits"])


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, values, at, node in _set_rows(batches):
        sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.diff(at)), sets], ["node", "n", "shingles"])


def _maps_alike(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether the parity maps of rows i and j let their sets be alike; the maps of sets that are alike always do."""
    n = table.column("n").to_numpy()
    maps = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), bool)
        for a in range(0, len(i), 1 << 16):
            x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            apart = np.bitwise_count(maps[x] ^ maps[y]).sum(1, dtype=np.int64)
            out[a : a + len(x)] = (SIMILARITY[0] + SIMILARITY[1]) * apart <= (SIMILARITY[1] - SIMILARITY[0]) * (n[x] + n[y])
        return out

    return alike


def _checked(pairs: DataFrame, docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes, each once, and whether their sets are alike; only documents that are in one are read."""
    pairs = stored(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    ids = prints.join(nodes, "node", "left_semi").select("doc_id")
    sets = stored(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_whole_rows, "node long, n long, shingles array<long>").dropDuplicates(["node"]))
    one = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}"))
    both, (p, q) = F.size(F.array_intersect("s_u", "s_v")), SIMILARITY
    return stored(pairs.join(one("u"), "u").join(one("v"), "v").select("u", "v", ((p + q) * both >= p * (F.col("n_u") + F.col("n_v"))).alias("alike")))


def similar_groups(docs: DataFrame, budget: int = WIDE_BUDGET) -> DataFrame:
    """doc_id and component_id for every row of `docs` (doc_id, text; other columns are ignored) with an id.

    component_id is the smallest doc_id that can be reached over links: pairs of texts whose fingerprints of five-word shingles are within
    `budget` bits and whose Jaccard similarity is SIMILARITY and more. Null and wordless texts are alike, whatever their ids.

    The trie join gives a spanning forest of the pairs that their parity maps let be alike, and its pairs are checked. Where a check fails, the
    join runs again over the documents around it and gives all pairs across what the other links leave apart.
    """
    prepare_workers(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    prints = stored(docs.mapInArrow(_node_rows, "doc_id long, node long, fp long, n long, bits binary"))
    nodes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("fp", "n", "bits"))))
    checked = _checked(links(nodes.select("node", "fp", "n", "bits"), budget, _maps_alike), docs, nodes)
    edges = checked.where("alike").select("u", "v")
    found = components(edges)
    if checked.where("NOT alike").head(1):
        whole = components(checked.select("u", "v")).withColumnRenamed("component", "family")
        torn = checked.where("NOT alike").select(F.col("u").alias("node")).join(whole, "node").select("family").distinct()
        some = whole.join(torn, "family", "left_semi").select("node").join(nodes, "node").join(found, "node", "left")
        some = stored(some.select("node", "fp", "n", "bits", F.coalesce("component", "node").alias("root")))
        more = _checked(links(some, budget, _maps_alike), docs, nodes).where("alike").select("u", "v")
        found = components(edges.unionByName(more))
    roots = stored(nodes.join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("root")))
    ids = roots.join(roots.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("node", "component_id")
    return prints.join(ids, "node").select("doc_id", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` without the documents that have a linked one with a smaller doc_id; all columns stay, and so do rows without an id.

    Rows with one id stay or go together: they go if the text of any has a linked one with a smaller id.
    """
    gone = similar_groups(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
