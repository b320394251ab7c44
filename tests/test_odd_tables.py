"""Queries held against their SQL on small tables with odd rows."""

import duckdb

import __spark_entry__

DOCUMENTS = "doc_id long, text string, lang string, source string"


def held(spark, folder, name):
    """The query's rows and those of its SQL over the tables of a folder."""
    got = __spark_entry__.queries()[name](spark, str(folder))
    db = duckdb.connect()
    for table in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}/*.parquet')")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    order = lambda rows: sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
    return order(map(tuple, got.collect())), order(want)


def documents(spark, folder, texts):
    rows = [(k, t, "en", "web") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(folder / "documents.parquet"))
    return folder


def test_blank_searches_are_dropped_by_query_and_sql(spark, tmp_path):
    got, want = held(spark, documents(spark, tmp_path, ["one two", " ", "\u00e4\u00f6\u00fc" * 50, "", "a" * 200, "\u4e2d" * 120 + "late"]), "r020_search_views")
    assert got == want and len(got) == 6 + 2


def test_a_run_without_compressed_text_has_an_empty_block(spark, tmp_path):
    got, want = held(spark, documents(spark, tmp_path, [f"text {k}" for k in range(6)]), "r020_stage_text")
    assert got == want and ("pilot_task1_User1_seed0", "compress", 13) in [r[:3] for r in got]


def test_findings_of_a_run_without_compressed_text(spark, tmp_path):
    got, want = held(spark, documents(spark, tmp_path, [f"text {k}" for k in range(6)]), "r024_findings_text")
    assert got == want and all(digest for _, digest in got)
