"""Cases in which an operator once did less than the whole job."""

import random

import pytest

from eventloom.llm import pii, secrets, substrings


def test_substring_batches_do_not_depend_on_other_columns(spark):
    rng = random.Random(3)
    vocabulary = [f"word{k}" for k in range(5000)]
    shared = [rng.choices(vocabulary, k=20) for _ in range(50)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=3000) + shared[i % 50] + rng.choices(vocabulary, k=rng.randrange(1500))), i) for i in range(400)]
    first, want = set(), {}
    for i, text, _ in rows:
        w, gone = text.split(), set()
        own = [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
        for k, x in enumerate(own):
            if x in first:
                gone |= set(range(k, k + 13))
        first |= set(own)
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    docs = substrings.stored(spark.createDataFrame(rows, "doc_id long, text string, other long").coalesce(1))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "300000")
    try:
        got = {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sum(len(t) for _, t, _ in rows) > 2 * substrings.BATCH_BYTES and got == want


def test_linked_secrets_do_not_depend_on_the_offset(spark):
    weak, scope, rng, rows = secrets._KIND["weak"], 100, random.Random(1), []
    kinds = {n: secrets._KIND[n] for n in ("access", "ident", "endpoint", "assign")}
    for row in range(600):
        start = rng.randrange(700)
        end = start + rng.choice((20, 40, 250))
        rows.append((row, row, weak, start, end, True))
        for n, k in kinds.items():
            if rng.random() < 0.5:
                low = rng.choice((start - scope - 10, start - scope - 11, end + scope, end + scope + 1, end + 60, start + 210))
                rows.append((row, row, k, max(0, low), max(0, low) + 10, True))
    want = set()
    for row, _, k, start, end, _ in rows:
        if k == weak:
            near = {o[2] for o in rows if o[0] == row and o[2] != weak and o[3] <= end + scope and o[4] >= start - scope}
            free = all(o[4] <= start or end <= o[3] for o in rows if o[0] == row and o[2] != weak)
            if free and (kinds["access"] in near or {kinds["ident"], kinds["endpoint"]} <= near):
                want.add((row, row, start, end))
    parts = spark.createDataFrame(rows, "row long, doc_id long, kind int, start long, end long, holds boolean")
    assert {tuple(r) for r in secrets.linked(parts, scope).collect()} == want and 50 < len(want) < 500


@pytest.mark.parametrize("lead", range(192, 202))
def test_personal_data_across_long_clusters(lead):
    field = pii.Field({})
    field.scores = lambda span: [0.0, 5.0 if span == "10-20-30-40" else 0.0, 0.0, 0.0]
    text = "7 " * lead + "10-20-30-40" + " 7" * 300
    assert pii.all_spans(text, field)[1] == [(2 * lead, 1, 2 * lead + 11)]
