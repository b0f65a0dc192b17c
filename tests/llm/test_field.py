"""The semi-Markov field against sums and maxima over all segmentations, and personal data of awkward tables."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import pii

from .test_texts import awkward, brute_pii  # noqa: F401


def fields_of(text):
    return [(m.start(), m.end(), m.group()) for m in pii._FIELD.finditer(text)]


def segmentations(fields):
    """All segmentations as lists of (first field, end, state)."""
    begins, ends, marks = pii._bounds(fields)
    n, out = len(fields), []

    def grow(at, path):
        if at == n:
            out.append(list(path))
            return
        grow(at + 1, [*path, (at, at + 1, 0)])
        for j in range(at + 1, min(n, at + pii.MAX_FIELDS) + 1):
            if begins[at] and ends[j - 1] and marks[j] > marks[at]:
                for y in range(1, len(pii._MOVES)):
                    grow(j, [*path, (at, j, y)])

    grow(0, [])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_sums_and_best_equal_exhaustive_search(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["12", "7", "ab", ".", "@", "-", "+"]) for _ in range(6))
    fields = fields_of(text)
    names = {}
    lattice = pii.Lattice(fields, names)
    rng = np.random.default_rng(seed)
    w, move = rng.normal(size=(len(names), len(pii.KINDS))), rng.normal(size=(len(pii._MOVES),) * 2)
    scores = w[lattice.features].sum(1) if len(lattice.low) else np.zeros((0, len(pii.KINDS)))
    at = {(int(a), int(b)): m for m, (a, b) in enumerate(zip(lattice.low, lattice.high, strict=True))}

    def value(path):
        states = [0, *(y for _, _, y in path)]
        return sum(scores[at[a, b], y - 1] for a, b, y in path if y) + sum(move[x, y] for x, y in zip(states[:-1], states[1:], strict=True))

    every = segmentations(fields)
    values = [value(p) for p in every]
    total, share, moves = lattice.sums(scores, move)
    assert total == pytest.approx(math.log(sum(map(math.exp, values))))
    want, want_moves = np.zeros_like(scores), np.zeros_like(move)
    for path, v in zip(every, values, strict=True):
        states = [0, *(y for _, _, y in path)]
        for a, b, y in path:
            if y:
                want[at[a, b], y - 1] += math.exp(v - total)
        for x, y in zip(states[:-1], states[1:], strict=True):
            want_moves[x, y] += math.exp(v - total)
    assert np.allclose(share, want) and np.allclose(moves, want_moves)
    field = pii.Field({**{f: w[i].tolist() for f, i in names.items()}, **dict(zip(pii._MOVES, move.tolist(), strict=True))})
    best = every[int(np.argmax(values))]
    assert [(s, k, e) for s, k, e, _ in field.decode(fields)] == [(fields[a][0], y - 1, fields[b - 1][1]) for a, b, y in best if y]
    # the gain of an entity is what the whole segmentation loses without it
    for s, k, e, gain in field.decode(fields):
        rest = [x for a, b, y in best for x in ([(i, i + 1, 0) for i in range(a, b)] if y and (fields[a][0], y - 1, fields[b - 1][1]) == (s, k, e) else [(a, b, y)])]
        assert gain == pytest.approx(max(values) - value(rest))


def test_field_learns_moves_and_likelihood_grows():
    texts = [f"ip 10.0.0.{i} card 4111 1111 1111 1111 mail u{i}@a.example.org" for i in range(30)]
    examples = [(fields, pii._labels(fields, pii.base_spans(t))) for t in texts for _, fields in pii.clusters(t)]
    weights = pii.learn(examples)
    assert set(pii._MOVES) <= set(weights)
    field = pii.Field(weights)
    assert all([x[:3] for x in field.decode(f)] == sorted(g) for f, g in examples)


def test_digits_of_other_scripts_are_no_digits(spark):
    texts = ["4111²1111²1111²1111", "٤١١١ ١١١١ 4111 1111 1111 1111", "+1 (²12) 555-0199 x@y.z", "½ 10.0.0.1 ①②③"]
    field = pii.Field(pii.learn([(f, []) for t in texts for _, f in pii.clusters(t)]))
    for t in texts:
        assert set(brute_pii(t)) <= set(pii.all_spans(t, field)[1]) and pii.base_spans(t) == brute_pii(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.personal_data(docs).count() == len(texts) == pii.redacted(docs).count()


def test_long_texts_have_the_same_clusters():
    r = random.Random(9)
    for _ in range(2000):
        text = "".join(r.choice(["1", "a", "@", " ", "  ", "\n", "\t", ".", "é"]) for _ in range(r.randrange(30)))
        assert [(m.start(), m.group()) for m in pii._CLUSTER.finditer(text)] == [(s.start(), s.group()) for s in pii._clusters_of_long(text)]


def test_personal_data_of_awkward_tables(spark, awkward):  # noqa: F811
    out = pii.personal_data(awkward)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    assert ids(out) == ids(awkward)
    rows = {r.doc_id: r for r in out.collect()}
    assert (rows[12].n_email, rows[12].n_ip, rows[12].n_card, rows[12].n_phone) == (1, 1, 1, 1) and rows[1].spans == rows[2].spans == ""
    assert pii.personal_data(awkward.limit(0)).count() == 0 and pii.redacted(awkward.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "7 " * 30_000 + "10.0.0.1" + " 7" * 30_000), (2, "1" * 100_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_ip for r in pii.personal_data(long).collect()} == {1: 1, 2: 0}
    wide = awkward.withColumn("wide", F.repeat(F.lit("y"), 30_000))
    assert pii.redacted(wide).select("doc_id", "text").exceptAll(pii.redacted(awkward).select("doc_id", "text")).count() == 0


def test_added_spans_are_the_best_segmentation_outside_base_spans(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    field, found = pii.Field(pii.fit(docs)), {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    for r in docs.collect():
        base = brute_pii(r.text or "")
        want = set(base)
        for m in pii._CLUSTER.finditer(r.text or ""):
            shifted = [(m.start() + a, m.start() + b, t) for a, b, t in fields_of(m.group())]
            want |= {(s, k, e) for s, k, e, gain in field.decode(shifted) if gain >= pii.MARGIN and all(e <= a or b <= s for a, _, b in base)}
        assert found[r.doc_id] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(want))
        assert not re.search("[^a-z0-9:,]", found[r.doc_id])
