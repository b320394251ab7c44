"""What is counted per run needs one exchange of the rows as they are."""

from stagesignal.operators import overlap


def _exchanges(df):
    return str(df._jdf.queryExecution().executedPlan().toString()).count("Exchange ")


def _tables(spark):
    trace = spark.createDataFrame([(1, "\tred  tea pot\n", "HTTPS://a@Shop.Example.com:80/x/#s"), (1, "red tea pot", "no url"), (1, " ", None), (2, "the cup", "")], "run long, query string, link string")
    return trace, spark.createDataFrame([(1, "red red tea"), (3, None)], "run long, text string")


def test_search_mechanism(spark):
    trace, briefs = _tables(spark)
    out = overlap.search_mechanism_rows(trace, briefs)
    assert _exchanges(out) == 1
    got = {r["run"]: r for r in out.collect()}
    assert set(got) == {1, 2, 3} and (got[3]["queries"], got[3]["brief_entropy"]) == (0, 0.0)
    assert [got[1][c] for c in ("queries", "unique_queries", "chars", "hosts", "share_unknown", "token_count", "unique_tokens", "type_token_ratio", "entropy", "brief_entropy")] == [2, 2, 23, 2, 0.5, 6, 3, 0.5, 1.58496, 0.9183]


def test_bucket_retention(spark):
    trace, briefs = _tables(spark)
    buckets = spark.createDataFrame([(1, "who", ["red", "cup"]), (1, "who", ["red", "tea"]), (1, "what", ["pot"]), (2, "who", []), (2, "what", ["cup", "the"])], "run long, bucket string, tokens array<string>")
    out = overlap.bucket_retention(trace.select("run", "query"), briefs, buckets)
    assert _exchanges(out) == 1
    assert sorted(map(tuple, out.collect())) == [(1, "what", 1, 0.0, 1.0, -1.0), (1, "who", 3, 0.666667, 0.666667, 0.0), (2, "what", 2, 0.0, 0.5, -0.5)]
