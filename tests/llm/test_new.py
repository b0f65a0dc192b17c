"""Centroid clustering, fill-in-middle and language ID against plain versions, and on awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import cells, language, middle
from eventloom.llm.wavelet import Wavelet

PIECES = public_tokenizers.path("piece_bpe_32k.model")


# -- op11


def plain_clusters(rows, dimension=64, k=16, rounds=3):
    good = []
    for i, x in rows:
        if x is not None and len(x) == dimension and all(v is not None and math.isfinite(v) and math.isfinite(64 * float(v)) for v in x):
            good.append((i, [math.floor(64 * float(v)) for v in x], x))
    first = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    now = [r[1] for r in first[:k]]
    near = lambda v: min(((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now)))  # noqa: E731, B023
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in good:
            groups[near(v)[1]].append(v)
        now = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(now)]
    found = [(i, near(v)) for i, v, _ in good]
    return Counter((i, j, d if d < 2**63 else None) for i, (d, j) in found), now


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<double>, text string, k1 int")


def test_clusters_equal_the_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(rng.integers(4) / 2, 0.4, 64).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 430)] + [rows[3]] * 25 + [(5, rows[9][1])]
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 63 + [None]), (604, [1.0] * 63 + [math.nan]), (605, [1.0] * 63 + [-math.inf]), (606, [1.7e308] * 64)]
    rows += [(None, rng.normal(size=64).tolist()), (700, [0.0] * 64), (701, [0.0] * 64)]
    want, centroids = plain_clusters(rows)
    got = cells.clustered(vectors(spark, rows))
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got.rows.collect()) == want and got.centroids == centroids


def test_clusters_of_vectors_of_any_size(spark):
    rng = random.Random(2)
    big = lambda: [rng.choice((0.25, -3.0, 2.0**21, -(2.0**40), 1e17, 3e38)) * rng.random() for _ in range(64)]
    rows = [(i, big()) for i in range(60)] + [(100 + i, [rng.random() for _ in range(64)]) for i in range(60)]
    want, centroids = plain_clusters(rows)
    got = cells.clustered(vectors(spark, rows))
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got.rows.collect()) == want and got.centroids == centroids
    assert any(d is None for _, _, d in want)
    table = cells.with_inertia(got).collect()
    assert all(r.inertia is None for r in table) and {len(r.centroid_sha256) for r in table} == {64}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = [(i, [i / 64] * 64) for i in range(n)] + [(99, None)]
    got = cells.with_inertia(cells.clustered(vectors(spark, rows))).collect()
    want, _ = plain_clusters(rows)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == want and len(got) == n


def test_vectors_are_not_shuffled_after_the_first_write(spark, monkeypatch):
    plans, real = [], cells.stored

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(cells, "stored", noted)
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*(F.rand(k) for k in range(64))).alias("embedding"))
    assert len(cells.clustered(df).fetched) == 2
    joins = [p for p in plans if "ShuffledHashJoin" in p]
    assert len(joins) == 3 and all(p.count("Exchange") == 1 and "Bucketed: true" in p for p in joins)


def test_many_copies_of_a_row_travel_as_one(spark, monkeypatch):
    monkeypatch.setattr(cells, "COPIES", 100)
    df = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("vec_id"), F.array_repeat(F.when(F.col("id") < 3000, 0.5).otherwise(F.rand(3)), 64).alias("embedding"))
    assert cells.clustered(df).rows.where("vec_id = 7").count() == 3000


def test_intervals_never_leave_out_the_nearest():
    rng = np.random.default_rng(1)
    for scale in (3, 300, 2**30):
        data = np.floor(rng.normal(0, scale, (500, 8)))
        centroids = [cells.integers(x) for x in data[:7]]
        grid = cells.grid(data[:200], 4)
        mask = cells.Judge(grid, centroids)(grid.cells(data))
        best = cells.nearest(data, np.ones(mask.shape, bool), centroids)[0]
        assert mask[np.arange(len(data)), best].all() and mask.sum() < mask.size


def test_packing_of_numbers_and_cells():
    rows = np.array([[0, -5, 7], [2**15, 1, -(2**15)], [2.0**100, -1, 3]])
    assert [len(x) for x in cells.packed(rows)] == [6, 12, 24]
    assert (cells.unpacked(pa.array(cells.packed(rows), pa.binary()), 3) == rows).all()
    held = np.random.default_rng(0).integers(0, 32, (9, 13)).astype(np.uint8)
    raw = pa.array([x.tobytes() for x in cells.packed_cells(held, 5)], pa.binary())
    assert (cells.unpacked_cells(raw, 13, 5) == held).all()


# -- op12


def plain_middle(doc_id, text, seed=7, rate=100, spm=50, pattern=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(pattern, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "pattern"), [("line", r"[^\n]*\n|[^\n]+"), ("sentence", r"[^\n.!?]*[\n.!?]|[^\n.!?]+"), ("word", r"[^\x20\t-\r]*[\x20\t-\r]|[^\x20\t-\r]+")])
def test_middles_equal_the_plain_version(spark, unit, pattern):
    rng = random.Random(9)
    signs = ["a", "b\n", "\n", "é", "😀 ", "x.", "<", "P>", "<S", " ", "\r\n", "\t", "\x00"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for i in range(500)]
    rows += [(None, "no id\nat all"), (None, None), (7, None), (7, ""), (8, "a<M>b\n"), (9, "<P"), (9, "<P"), (10, "é" * 300_000 + "\n" + "line\n" * 100_000), (11, "\n" * 9)]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n int, output string")
    for rate, spm in ((100, 50), (40, 90)):
        out = middle.fill_in_middle(df, rate=rate, spm=spm, unit=unit).withColumn("text", middle.restored("output", "form")).collect()
        want = Counter(plain_middle(i, t, rate=rate, spm=spm, pattern=pattern) for i, t in rows)
        assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out) == want
        assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t or "") for i, t in rows)
        assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}


def test_middles_of_an_empty_table(spark):
    assert middle.cut_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), unit="page")


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        classes = rng.integers(0, 8, n).astype(np.uint8)
        matrix, places = Wavelet(classes, 3), np.arange(n + 1)
        for c in range(8):
            assert matrix.rank(c, places).tolist() == [int((classes[:i] == c).sum()) for i in range(n + 1)]


# -- op13


def plain_score(word, logs):
    """Log of the summed probabilities of all segmentations of a word, by trying each."""
    total, text = 0.0, b" " + word
    for n in range(len(text)):
        for cut in itertools.combinations(range(1, len(text)), n):
            parts = [text[a:b] for a, b in itertools.pairwise((0, *cut, len(text)))]
            if all(p in logs for p in parts):
                total += math.exp(sum(logs[p] for p in parts))
    return math.log(total)


def test_words_sum_over_all_segmentations():
    rng = random.Random(4)
    pieces = sorted({bytes([b]) for b in b" abc"} | {b" a", b" ab", b"ab", b"bc", b"abc", b"cab", b"aa", b"aaa"})
    trie = language.trie(pieces)
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 3))
    words = [bytes(rng.choices(b"abc", k=rng.randrange(1, 10))) for _ in range(60)]
    got = language.word_scores(pa.array(words, pa.large_binary()), trie, logs)
    want = [[plain_score(w, dict(zip(pieces, row, strict=True))) for row in logs] for w in words]
    assert np.allclose(got, want)


def test_expected_counts_are_those_of_all_segmentations():
    pieces = sorted({bytes([b]) for b in b" ab"} | {b" a", b"ab", b"ba", b"aba"})
    trie, logs = language.trie(pieces), np.log(np.random.default_rng(2).dirichlet(np.ones(7), 2))
    words, own, n = [b"abab", b"ba", b"a"], np.array([0, 1, 1]), np.array([3, 1, 2])
    want = np.zeros(logs.shape)
    for word, k, copies in zip(words, own, n, strict=True):
        text, found = b" " + word, []
        for size in range(len(text)):
            for cut in itertools.combinations(range(1, len(text)), size):
                parts = [text[a:b] for a, b in itertools.pairwise((0, *cut, len(text)))]
                if all(p in pieces for p in parts):
                    found.append(([pieces.index(p) for p in parts], math.exp(sum(logs[k, pieces.index(p)] for p in parts))))
        for parts, p in found:
            for i in parts:
                want[k, i] += copies * p / sum(x for _, x in found)
    got = language.expected_counts(pa.array(words, pa.large_binary()), own, n, trie, logs) / language.UNIT
    assert np.allclose(got, want, atol=1e-5)


def test_words_are_runs_of_letters():
    texts = ["Ab1cd  é—x\n", None, "", "42", "B" * 2500, "end"]
    words, offsets = language.words_of(pa.array(texts, pa.string()))
    assert words.to_pylist() == [b"ab", b"cd", "é—x".encode(), b"b" * 1024, b"b" * 1024, b"b" * 452, b"end"] and offsets.tolist() == [0, 3, 3, 3, 3, 6, 7]


def _speech(rng, kind):
    return " ".join(rng.choice(kind) + rng.choice(("", "s", "en")) for _ in range(rng.randrange(3, 60)))


@pytest.fixture(scope="module")
def speeches():
    rng, kinds = random.Random(6), {"xx": ["the", "house", "walk", "green"], "yy": ["der", "haus", "gehen", "grün"], "zz": ["la", "maison", "marche", "vert"]}
    return [(i, _speech(rng, kinds[k]), k) for i, k in ((i, rng.choice(list(kinds))) for i in range(400))]


def test_language_is_learnt_from_other_folds_alone(spark, speeches):
    odd = [(900, None, "xx"), (901, "", "xx"), (902, "12 34 — …", "yy"), (903, "the house " * 300_000, None), (904, "GRÜN", None), (None, "maison", "zz"), (5, "der der", "yy"), (5, "der der", "yy")]
    schema = "doc_id long, text string, lang string, score string"
    rows = [(*r, "s") for r in speeches + odd]
    got = {(r.doc_id, r.lang_pred, r.held_out, r.score) for r in language.language(spark.createDataFrame(rows, schema), PIECES).collect()}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    assert {(i, h) for i, _, h, _ in got} == {(i, held(i)) for i, *_ in rows} and all(0 <= s <= 1 for *_, s in got)
    pred = {i: p for i, p, *_ in got}
    assert [pred[i] for i in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "xx", "yy", "zz"]
    assert np.mean([pred[i] == k for i, _, k in speeches if held(i)]) > 0.97
    # other labels of the held-out rows, and other values of columns that are no input, change nothing
    turned = [(i, t, "zz" if held(i) else k, "other") for i, t, k, _ in rows]
    again = {(r.doc_id, r.lang_pred, r.held_out, r.score) for r in language.language(spark.createDataFrame(turned, schema).repartition(3), PIECES).collect()}
    assert again == got


def test_language_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "xx")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score) for r in language.language(df, PIECES).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert language.language(df.limit(0), PIECES).collect() == []


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.language(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 100 and sum(r.lang_pred == r.lang for r in found) / len(found) >= 0.97
