"""Daily files that are pruned by their paths, merges that touch only what changes, and state that a success resets."""

import os

from pyspark.sql import functions as F

from eventloom.sources import daily, merge

LINE = "id LONG, v DOUBLE"


def lines(spark):
    rows = [(f"2024-01-{d:02d}", f'{{"id": {d * 10 + i}, "v": {i}.5}}' if i != d % 4 else '{"id": 1, "v"') for d in range(1, 11) for i in range(4)]
    return spark.createDataFrame(rows, "dt string, value string")


def opened(df):
    """Files that the scan of a plan has opened, after a run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    while leaf.getClass().getSimpleName() != "FileSourceScanExec":
        leaf = (leaf.executedPlan() if hasattr(leaf, "executedPlan") and leaf.getClass().getSimpleName().startswith("Adaptive") else leaf.plan()).collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


def test_days_outside_the_range_are_not_opened(spark, tmp_path):
    lines(spark).coalesce(1).write.partitionBy("dt").text(f"{tmp_path}/days")
    some = daily.day_folders(spark, f"{tmp_path}/days", "2024-01-03", "2024-01-05", LINE)
    assert "PartitionFilters: [isnotnull(dt" in some._jdf.queryExecution().executedPlan().toString() and opened(some.select("id", "dt")) == 3
    got = {r.dt: (r.total, r.bad, r.v) for r in daily.audited(some, ["dt"], F.sum("v").alias("v")).collect()}
    assert got == {f"2024-01-{d:02d}": (4, 1, 8.0 - (d % 4 + 0.5)) for d in (3, 4, 5)}


def test_day_from_the_name_of_a_file(spark, tmp_path):
    daily.write_day_files(lines(spark).coalesce(1), f"{tmp_path}/files", "dt", "text")
    names = [n for n in os.listdir(f"{tmp_path}/files") if n.endswith(".jsonl")]
    assert sorted(n[:10] for n in names) == [f"2024-01-{d:02d}" for d in range(1, 11)] and not os.path.exists(f"{tmp_path}/files.tmp")
    some = daily.day_files(spark, f"{tmp_path}/files", "2024-01-09", "2024-01-10", LINE)
    assert opened(some.select("id", "day")) == 2
    assert {(r.day, r.id) for r in some.where("_bad IS NULL").collect()} == {(f"2024-01-{d:02d}", d * 10 + i) for d in (9, 10) for i in range(4) if i != d % 4}


def ages(path):
    return {p: max(os.stat(f"{path}/{p}/{f}").st_mtime_ns for f in os.listdir(f"{path}/{p}")) for p in os.listdir(path) if "=" in p}


def test_upsert_rewrites_only_touched_parts(spark, tmp_path):
    path, schema = f"{tmp_path}/table", "key long, at long, v string, part long"
    rows = [(k, 10, "old", k % 8) for k in range(40)]
    merge.write_snapshot(spark.createDataFrame(rows, schema), path, ["part"])
    before = ages(path)
    batch = [(3, 11, "new", 3), (11, 5, "late", 3), (11, 10, "tie", 3), (43, 1, "first", 3), (43, 2, "second", 3), (4, 9, "late", 4)]
    merge.upsert(spark, path, spark.createDataFrame(batch, schema), ["key"], [F.col("at")], "part", last=True)
    want = {k: "old" for k in range(40)} | {3: "new", 11: "tie", 43: "second"}
    assert {r.key: r.v for r in spark.read.parquet(path).collect()} == want
    after = ages(path)
    assert {p for p in after if after[p] != before[p]} == {"part=3", "part=4"}
    merge.upsert(spark, path, spark.createDataFrame([(5, 99, "again", 5), (45, 2, "b", 5), (45, 1, "a", 5)], schema), ["key"], [F.col("at")], "part", last=False)
    assert {r.key: r.v for r in spark.read.parquet(path).collect()} == want | {45: "a"}


def test_append_adds_each_key_once(spark, tmp_path):
    path, schema = f"{tmp_path}/ledger", "id long, at long, day string"
    spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], schema).write.partitionBy("day").parquet(path)
    before = ages(path)
    batch = spark.createDataFrame([(1, 9, "a"), (3, 2, "a"), (3, 1, "a"), (4, 1, "c")], schema)
    for _ in range(2):
        merge.append_unseen(spark, path, batch, ["id"], [F.col("at")], "day")
    assert sorted((r.id, r.at, r.day) for r in spark.read.parquet(path).collect()) == [(1, 1, "a"), (2, 2, "b"), (3, 1, "a"), (4, 1, "c")]
    assert ages(path)["day=b"] == before["day=b"]


def test_success_resets_the_count_of_errors(spark):
    schema = "key string, at long, ok boolean, n long"
    none = spark.createDataFrame([], "key string, n long, errors long")
    one = spark.createDataFrame([("a", 1, False, 1), ("a", 2, False, 1), ("b", 1, False, 1), ("b", 2, True, 1), ("c", 1, False, 1)], schema)
    two = spark.createDataFrame([("a", 3, True, 1), ("a", 4, False, 1), ("b", 3, False, 1), ("d", 1, True, 5)], schema)
    state = merge.record(merge.record(none, one, ["key"], [F.col("at")], "ok", ["n"]), two, ["key"], [F.col("at")], "ok", ["n"])
    assert {r.key: (r.n, r.errors) for r in state.collect()} == {"a": (4, 1), "b": (3, 1), "c": (1, 1), "d": (5, 0)}
