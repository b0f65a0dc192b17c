"""Near-duplicates of the pipeline's stage: exact for its definition of a link, and how many pairs of similar texts that finds."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from eventloom.llm import simhash

from .test_texts import WORD, awkward, brute_groups  # noqa: F401


def sets_of(rows):
    out = []
    for _, text in rows:
        w = WORD.findall((text or "").lower())
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    return out


def prints_of(rows):
    return [int(simhash.set_fingerprints(*simhash.shingle_sets(pa.array([t], pa.string())))[0]) for _, t in rows]


def brute_kept(rows, budget):
    """(ids without a smaller one in their group, links, pairs at the similarity, fingerprints of texts within reach)."""
    sets, prints = sets_of(rows), prints_of(rows)
    similar = [(i, j) for i in range(len(rows)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    pairs = [(i, j) for i, j in similar if (prints[i] ^ prints[j]).bit_count() <= budget]
    root = list(range(len(rows)))
    for _ in rows:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(i, least.get(r, i))
    return {i for (i, _), r in zip(rows, root, strict=True) if least[r] == i}, pairs, similar


def drifting(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    line = rng.sample(vocabulary, 12)
    rows = [(900, None), (901, " "), (902, "one two"), (903, "One  two"), (904, "one two three")]
    for k in range(40):
        text = rng.choices(vocabulary, k=rng.choice((30, 60, 150))) + line
        rows.append((k, " ".join(text)))
        # copies on both sides of the border, and a group larger than NEXT whose members drift apart
        for c in range(12 if k == 0 else 2):
            copy = list(text)
            for at in rng.sample(range(len(copy)), rng.choice((0, 1, 2, 3))):
                copy[at] = "x"
            rows.append((1000 + 20 * k + c, " ".join(copy)))
    return rows


@pytest.mark.parametrize(("group_rows", "chunk_rows"), [(20_000, 100_000), (0, 100_000), (0, 1)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, group_rows, chunk_rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(simhash, "CHUNK_ROWS", chunk_rows)
    rows = drifting(5)
    want, pairs, similar = brute_kept(rows, simhash.WIDE_BUDGET)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == want and len(pairs) > 40 and len(want) < len(rows) - 30


def test_most_similar_pairs_are_links():
    found = total = 0
    for seed in range(4):
        _, pairs, similar = brute_kept(drifting(seed), simhash.WIDE_BUDGET)
        found, total = found + len(pairs), total + len(similar)
    assert found >= 0.9 * total > 100


def similar_pairs(values, at):
    """All pairs of different sets at the similarity, by the shingles that are rarest: similar sets share one of the first fifth of them."""
    sets = list({values[a:b].tobytes(): values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)}.values())
    code, count = np.unique(np.concatenate(sets), return_counts=True)
    having, out = {}, set()
    for k, one in enumerate(sets):
        often = count[np.searchsorted(code, one)]
        first = one[np.lexsort((one, often))[: len(one) - -(-4 * len(one) // 5) + 1]]
        for x in first[count[np.searchsorted(code, first)] > 1].tolist():
            for other in having.setdefault(x, []):
                if (k, other) not in out and 9 * len(np.intersect1d(one, sets[other], True)) >= 4 * (len(one) + len(sets[other])):
                    out.add((k, other))
            having[x].append(k)
    return sets, out


def test_nine_of_ten_similar_pairs_of_all_documents_are_links():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").combine_chunks()
    sets, similar = similar_pairs(*simhash.shingle_sets(texts))
    prints = simhash.set_fingerprints(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])))
    found = sum(int(prints[i] ^ prints[j]).bit_count() <= simhash.WIDE_BUDGET for i, j in similar)
    assert found >= 0.9 * len(similar) > 0


@pytest.mark.parametrize("budget", [0, 1, 2, 3, 5, 11, 13])
def test_errors_within_the_budget_keep_to_one_part(budget):
    r = random.Random(budget)
    for _ in range(3000):
        # errors are spread or close together
        span = r.choice((budget + 1, 20, 64))
        start = r.randrange(64)
        errors = {(start + x) % 64 for x in r.sample(range(max(span, budget)), budget)}
        for p in simhash._parts(budget):
            turned = [(p.turn + d) % 64 in errors for d in range(64)]
            if all(a <= b for a, b in zip(np.cumsum(turned), p.budgets[1:], strict=True)):
                assert not any(turned[: p.exact]) and sum(turned[: p.near]) <= p.errors
                break
        else:
            raise AssertionError(sorted(errors))


def test_bands_hold_all_sizes_that_can_be_alike():
    for n in [*range(1, 3000), 10**6, 10**9]:
        largest = 5 * n // 4
        low, high = simhash._bands(np.array([n, largest]))
        assert low <= high <= low + 1


def test_rows_meet_those_of_neighbouring_bands():
    r = np.random.default_rng(8)
    fp = (r.integers(0, 1 << 10, 400).astype(np.uint64) << np.uint64(50)) | r.integers(0, 16, 400).astype(np.uint64)
    group, band = r.integers(0, 3, 400), r.integers(0, 6, 400)
    order = np.lexsort((fp, band, group))
    group, band, fp = group[order], band[order], fp[order]
    i, j = simhash.trie_join(group, fp, np.full(65, 3), None, np.arange(400), band)
    near = lambda a, b: group[a] == group[b] and abs(band[a] - band[b]) <= 1 and int(fp[a] ^ fp[b]).bit_count() <= 3
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(a, b) for a in range(400) for b in range(a + 1, 400) if near(a, b)]


@pytest.mark.parametrize("budget", [3, 5, 11, 13])
def test_every_link_meets_in_a_group(spark, budget):
    r = random.Random(budget)
    base = [r.getrandbits(64) for _ in range(8)]
    prints = set(base)
    for _ in range(150):
        x = r.choice(base)
        for at in r.sample(range(64), r.randint(0, budget)):
            x ^= 1 << at
        prints.add(x)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)], "node long, fp long")
    root = list(range(len(prints)))
    edges = [(e.u, e.v) for e in simhash.links(nodes, budget).collect()]
    assert all((prints[u] ^ prints[v]).bit_count() <= budget for u, v in edges)
    for _ in prints:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    want = list(range(len(prints)))
    for _ in prints:
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= budget:
                    want[i] = want[j] = min(want[i], want[j])
    assert root == want


def test_links_across_roots_are_all_of_them():
    r = np.random.default_rng(3)
    fp = np.unique((r.integers(0, 1 << 10, 60).astype(np.uint64) << np.uint64(50)) | r.integers(0, 16, 60).astype(np.uint64))
    root = np.arange(len(fp)) % 3
    i, j = simhash.trie_join(np.zeros(len(fp), np.int64), fp, np.full(65, 4), None, root.copy())
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if root[a] != root[b] and int(fp[a] ^ fp[b]).bit_count() <= 4}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want


def test_near_duplicates_of_awkward_texts(spark, awkward):  # noqa: F811
    kept = [r.doc_id for r in simhash.deduplicated(awkward).collect()]
    assert kept.count(None) == 2 and {1, 4, 6, 7, 10, 11, 12} <= set(kept) and not {2, 3, 5, 8} & set(kept)
    assert simhash.deduplicated(awkward).columns == awkward.columns and simhash.deduplicated(awkward.limit(0)).count() == 0


def test_failed_checks_lose_no_links(spark, monkeypatch):
    # parity maps that say nothing: every pair within the budget becomes a candidate, and those that fail leave the others to the second join
    monkeypatch.setattr(simhash, "_maps_alike", lambda table: lambda i, j: np.ones(len(i), bool))
    rows = drifting(11)
    want, _, _ = brute_kept(rows, 25)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.similar_groups(docs, 25).where(F.col("component_id") == F.col("doc_id"))
    assert {r.doc_id for r in kept.collect()} == want
