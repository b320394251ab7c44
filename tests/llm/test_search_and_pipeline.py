import importlib

import numpy as np
from pyspark.sql import functions as F

from stagesignal.llm import components, knn

COLUMNS = "vec_id long, embedding array<float>, score int"


def brute(rows, k=10):
    """rows of (vec_id, vector): each row whose id is divisible by 100 asks, all other rows are candidates."""
    fit = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max({len(v) for _, v in fit}, key=lambda n: (sum(len(v) == n for _, v in fit), n))
    fit = [(i, v) for i, v in fit if len(v) == width]
    out = []
    for at, (q, asked) in enumerate(fit):
        if q % 100 == 0:
            best = sorted((-int(asked @ v), i) for other, (i, v) in enumerate(fit) if other != at)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(knn, "SLICE", 150)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(700, 900)]  # one common vector: ties
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [float("nan")] * 8), (1003, [1.0]), (1100, []), (None, rows[0][1]), (3, rows[5][1]), (600, rows[600][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], COLUMNS)
    got = sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute(rows)
    dealt = knn.top_k(df, F.col("vec_id") % 100 == 0, pivots=2, part=1)  # each group's queries in several parts
    assert sorted(tuple(r) for r in dealt.collect()) == got
    named = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("score").alias("row"))
    assert sorted(tuple(r) for r in knn.top_k(named, F.col("id") % 100 == 0, "id", "v").collect()) == got


def test_top_k_by_the_sql_with_repeated_ids(spark, tmp_path):
    import duckdb

    from stagesignal.llm.queries import ORACLE

    rng = np.random.default_rng(1)
    rows = [(i % 150, rng.normal(size=5).astype(np.float32).tolist()) for i in range(400)] + [(0, [1.0, 2.0, 0.0, 0.0, 0.0]), (100, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "e"))
    got = sorted(tuple(r) for r in knn.top_k(spark.read.parquet(str(tmp_path / "e")), F.col("vec_id") % 100 == 0).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert got == sorted(con.execute(ORACLE["op9_top_k"]).fetchall()) == brute(rows)


def test_top_k_of_groups_that_need_little_of_the_data(spark):
    rng = np.random.default_rng(5)
    centres = 50 * np.eye(40)[:8]
    rows = [(i, (centres[i % 8] * (1 + i % 3) + 0.01 * rng.normal(size=40)).astype(np.float32).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 100 == 0).collect()) == brute(rows)


def test_top_k_of_wide_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (1e5 * rng.normal(size=3000)).astype(np.float32).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 100 == 0).collect()) == brute(rows)


def test_top_k_small_and_empty(spark):
    assert knn.top_k(spark.createDataFrame([], COLUMNS), F.col("vec_id") % 100 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0, -1.5], 0)], COLUMNS)
    assert [tuple(r) for r in knn.top_k(two, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 0)]
    big = spark.createDataFrame([(0, [3e6, 2.0], 0), (1, [3e6, -1.5], 0), (2, [3e6, 1.0], 0)], "vec_id long, embedding array<double>, x int")
    assert [r["vec_id"] for r in knn.top_k(big, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [2, 1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (201, 202), (300, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200, 300: 0}


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr("stagesignal.llm.common.HOT_ROWS", 4)
    edges = [(50, i) for i in range(60, 160)] + [(i, i + 1) for i in range(200, 230)] + [(100, 215), (1, 2)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {50: 50, **{i: 50 for i in range(60, 160)}, **{i: 50 for i in range(200, 231)}, 1: 1, 2: 1}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", "src0", 0), (10_002, "12 34", "en", "src1", 5)], docs.schema)
    docs = docs.union(odd).union(docs.limit(5))
    ids = {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            docs = out.cache()
            left = {r["doc_id"] for r in docs.collect()}
            assert left and left <= ids, name
            if name == "language ID":
                assert not left & {10_000, 10_001, 10_002} and len(left) > 0.97 * (len(ids) - 3)
            if "dedup" in name:
                assert docs.count() == len(left)
            ids = left
    assert out.where("not parity or not round_trip").count() == 0
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run
