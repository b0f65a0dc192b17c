"""The pipeline against its stages done by brute force, each on its own input."""

import re

import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from eventloom.llm import pii, simhash, toxicity

from .test_near import brute_kept
from .test_texts import WORD, awkward, check_packing, reference_encoding  # noqa: F401


@pytest.fixture(scope="module")
def stages(spark, data):
    """What each stage is given, and what the last returns."""
    docs = [spark.read.parquet(f"{data}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(corpus_pipeline.stored(stage(spark, docs[-1], data)))
    return docs


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "pii", "packing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    assert "pipeline" in __spark_entry__.queries()


def test_toxic_documents_go(spark, data, stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    score = toxicity.scorer(spark, toxicity.fit(stages[0], spark.read.parquet(f"{data}/labels.parquet"), ~toxicity.held_out()))
    want = {i for i, s in zip(before, score(pa.array([r.text for r in before.values()], pa.string())), strict=True) if s < toxicity.THRESHOLD}
    assert set(after) == want and all(after[i] == before[i] for i in want)


def test_one_of_each_near_duplicate_group_stays(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    want, links, similar = brute_kept([(i, r.text) for i, r in before.items()], simhash.WIDE_BUDGET)
    assert set(after) == want and len(after) < len(before) and all(after[i] == before[i] for i in want)
    # what brute force over all pairs at the similarity would take out as well
    assert len(links) >= 0.9 * len(similar)


def test_repeated_windows_go(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    first = {}
    for i in sorted(before):
        w = WORD.findall(before[i].text or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    cut = 0
    for i, row in before.items():
        w, gone = WORD.findall(row.text or ""), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        cut += bool(gone)
        assert after[i].text == (" ".join(x for k, x in enumerate(w) if k not in gone) if gone else row.text)
        assert after[i].n_chars == (len(after[i].text) if gone else row.n_chars)
    assert cut and set(before) == set(after)


def test_personal_data_is_masked(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert set(before) == set(after)
    for i, row in before.items():
        spans = pii.base_spans(row.text or "")
        assert bool(spans) <= (after[i].text != row.text)
        assert not pii.base_spans(re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "#", after[i].text or ""))


def test_everything_is_packed(stages):
    assert check_packing(stages[5].collect(), reference_encoding().encode_ordinary, {r.doc_id: r.text for r in stages[4].collect()}) > 0.95


def test_run_gives_the_last_stage(spark, data, stages):
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert corpus_pipeline.run(spark, data).select(*columns).exceptAll(stages[5].select(*columns)).count() == 0


@pytest.mark.parametrize("rows", ["all", "none"])
def test_stages_on_awkward_tables(spark, awkward, tmp_path, rows):  # noqa: F811
    docs = awkward if rows == "all" else awkward.limit(0)
    labels = spark.createDataFrame([(i, int(i == 10)) for i in range(1, 15)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert after.columns == docs.columns and after.count() <= docs.count()
            docs = after
    tokens = {r.doc_id for r in after.collect()}
    assert tokens == {r.doc_id for r in docs.collect()} and (rows == "none" or {1, 4, 7, 12, None} <= tokens)
