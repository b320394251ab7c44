"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java regular expression (also what bytes.split() splits on).
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a group from which on it may count as hot, and hot groups at most (in a table of any size).
HOT_ROWS, HOT_GROUPS = 64, 20_000


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the cluster's shared folder: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) that only the values of cols decide."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double")
    return (bits + 0.5) / float(1 << 53)


def small(df: DataFrame, rows: int, most: int = 20_000) -> DataFrame:
    """df marked for broadcast when it is known to have few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def group_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, n: int) -> DataFrame:
    """rows joined with groups(keys, size, ..), which has one row per group and the number of its rows; n: all rows.

    Rows of hot groups stay where they are: there are HOT_GROUPS of those at most, so they are broadcast. Only groups of
    a bounded share of all rows are shuffled. rows and groups are read twice and should be cut before."""
    hot = max(HOT_ROWS, n // HOT_GROUPS)
    large = F.broadcast(groups.where(F.col(size) > hot))
    rest = rows.join(large.select(*keys), list(keys), "left_anti").join(groups.where(F.col(size) <= hot), list(keys))
    return rows.join(large, list(keys)).unionByName(rest)
