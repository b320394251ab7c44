"""Files are written by as many tasks as their number asks for."""

from collections import Counter
from pathlib import Path

from stagesignal.plans import files


def test_one_task_does_not_write_all_files(spark, tmp_path, monkeypatch):
    """The table is one file, thus one task's input."""
    n = 3 * files.FILES
    spark.range(n).selectExpr("id AS s_suppkey", "concat('Supplier ', id) AS s_name").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(files, "_folder", lambda spark: f"{tmp_path}/out")
    rows = {r["name"]: r["length"] for r in files.r042_file_inventory(spark, str(tmp_path)).collect()}
    assert rows == {f"supplier-{k}": len(f"Supplier {k}") + 1 for k in range(n)}
    tasks = Counter(f.name.split("-")[1] for f in Path(tmp_path, "out").glob("name=*/part-*"))
    assert sum(tasks.values()) == n and len(tasks) == 3 and max(tasks.values()) < 2 * files.FILES


def test_small_decisions_go_many_to_a_file(spark, tmp_path, monkeypatch):
    n = 3000
    spark.range(n).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'O' AS o_orderstatus", "'1' AS o_orderpriority", "1.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(files, "_folder", lambda spark: f"{tmp_path}/out")
    got = files.r004_read_matches(spark, str(tmp_path))
    want = files.matches(spark, str(tmp_path)).select(got.columns)
    assert got.count() == 4 * n and got.exceptAll(want).isEmpty()
    assert len(list(Path(tmp_path, "out").glob("part-*"))) <= -(-4 * n // files.ROWS)
