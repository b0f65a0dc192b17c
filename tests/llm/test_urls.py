"""URL templates: depth, variable segments, similar branches and purity, and awkward tables."""

from pyspark.sql import functions as F

from eventloom.llm import urls


def verdicts(spark, rows, rules=urls.RULES):
    return {r.page_id: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}


def templates(spark, rows):
    """Template and purity by shape, from (shape, pages, blocked, labelled) of one host."""
    counts = spark.createDataFrame([("h", *r) for r in rows], "host string, shape string, n long, blocked long, labelled long")
    return {r.shape: (r.template, r.purity) for r in urls.template_verdicts(counts).collect()}


def test_similar_branches_share_their_labels(spark):
    # two blocked sections, one without labels that looks like them, one that is allowed, one that looks different
    out = templates(spark, [("es/*", 40, 40, 40), ("fr/*", 20, 19, 20), ("pt/*", 25, 0, 0), ("ok/*", 30, 0, 30), ("shop/cart/list", 40, 0, 0)])
    assert out["es/*"][0] == out["fr/*"][0] == out["pt/*"][0] and out["pt/*"][1] == (59 + 2) / (60 + 4)
    assert out["ok/*"][0] != out["es/*"][0] != out["shop/cart/list"][0] and out["ok/*"][1] < 0.1 and out["shop/cart/list"][1] == 0.5


def test_too_few_pages_tell_nothing(spark):
    out = templates(spark, [("es/*", 30, 30, 30), ("de/*", 5, 0, 0)])
    assert out["de/*"] != out["es/*"] and out["de/*"][1] == 0.5


def test_variable_segments_become_one(spark):
    out = templates(spark, [(f"user/name{chr(97 + k)}x/photo", 1, 1, 1) for k in range(20)] + [("user/special/photo", 1, 0, 0)])
    assert {t for t, _ in out.values()} == {"/~1/*/~1"} and out["user/special/photo"][1] > 0.8


def test_paths_are_followed_to_their_end(spark):
    deep = "/".join("abcdefgh")
    out = templates(spark, [(f"{deep}/bad/x", 20, 20, 20), (f"{deep}/good/y/z", 20, 0, 20), (f"{deep}/good/y", 10, 0, 10)])
    assert out[f"{deep}/bad/x"][1] > 0.9 and out[f"{deep}/good/y/z"][1] < 0.1
    rows = [(i, f"http://h.net/{deep}/bad/{i}") for i in range(20)] + [(i, f"http://h.net/{deep}/good/{i}") for i in range(20, 40)] + [(99, f"http://x.h.net/{deep}/bad/7")]
    rules = (("com/", "allow"), (f"h.net/{deep}/bad/1", "block"), (f"h.net/{deep}/good/", "allow"))
    got = verdicts(spark, rows, rules)
    # eleven of twenty pages are labelled; the others share their template's purity
    assert {got[i] for i in range(20)} == {"block"} and {got[i] for i in range(20, 40)} == {"allow"} and got[99] == "allow"


def test_long_paths_take_no_more_rounds(spark):
    import time

    deep = "/".join(f"s{chr(97 + i % 26)}" for i in range(500))
    began = time.time()
    out = templates(spark, [(f"{deep}/bad/{deep}", 20, 20, 20), (f"{deep}/good/{deep}", 20, 0, 20), (f"{deep}/good", 10, 0, 10), (deep, 8, 0, 0)])
    assert time.time() - began < 90
    assert out[f"{deep}/bad/{deep}"][1] > 0.9 and out[f"{deep}/good/{deep}"][1] < 0.1 and out[f"{deep}/good"][1] < 0.2 and out[deep][1] == 0.5
    assert out[deep][0] == "/~1" * 500 and out[f"{deep}/bad/{deep}"][0].count("/") == 1001


def test_least_is_the_smallest_number_that_can_be_rejected():
    purity = lambda n: (n + urls.PRIOR / 2) / (n + urls.PRIOR)
    assert purity(urls.LEAST) >= urls.PURITY > purity(urls.LEAST - 1)


def test_purity_blocks_real_pages(spark, data):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    out = urls.judged(pages)
    assert out.where("rule IS NULL AND verdict = 'block'").count() > 0 and out.where("rule IS NULL AND verdict = 'allow'").count() > 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_awkward_pages(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "://"), (4, "http:///"), (None, "http://a.net/es/1"), (5, "http://a.net/" + "x/" * 5000), (6, "http://a.net/es/1?u=http://b.com/"), (7, "http://A.NET#/es/"), (8, "http://" + "é" * 300 + "/\n\t/1")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "shape", "template", "segments", "n", "told", "hot")})
    out = urls.judged(df)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"] and out.count() == len(rows)
    got = {r.page_id: r for r in out.collect()}
    assert (got[1].host, got[1].path, got[3].host, got[6].path, got[7].host, got[7].path) == ("", "", "", "/es/1", "a.net", "")
    assert got[None].verdict == "block" and got[1].verdict == "allow" and got[5].path.count("x") == 5000
    assert urls.judged(df.limit(0)).count() == 0


def test_every_similar_branch_finds_its_group(spark, monkeypatch):
    # four kinds of siblings, told apart by what follows; each kind has one blocked section and one without labels
    follow = {"ends": "", "numbers": "/*", "mixed": "/a*", "words": "/word"}
    sizes = {"ends": 60, "numbers": 50, "mixed": 40, "words": 30}
    rows = [(f"{name}{who}{follow[name]}", n, n if who == "x" else 0, n if who == "x" else 0) for name, n in sizes.items() for who in "xy"]
    out = templates(spark, rows)
    assert len({t for t, _ in out.values()}) == 4
    for name in sizes:
        x, y = (out[f"{name}{who}{follow[name]}"] for who in "xy")
        assert x == y and x[1] > 0.8
    # the same whatever a round looks through
    monkeypatch.setattr(urls, "BATCH", 1)
    again = templates(spark, rows)
    assert {k: p for k, (_, p) in again.items()} == {k: p for k, (_, p) in out.items()} and [again[a][0] == again[b][0] for a in out for b in out] == [out[a][0] == out[b][0] for a in out for b in out]
