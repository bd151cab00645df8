"""Session-level helpers shared by every operator: reading tables, cutting lineage, size checks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast up to so many rows; beyond it the join is left to Spark's own choice.
BROADCAST_ROWS = 2_000_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context: they may run where it is not on the path."""
    sc = spark.sparkContext
    if getattr(sc, "_newsloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    name = os.path.join(tempfile.mkdtemp(prefix="newsloom-"), "newsloom.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(name)
    sc._newsloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back; its lineage ends there.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop)
    a temporary folder takes its place.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="newsloom-"))
    return df.checkpoint(eager=True)


def sized_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when its counted ``rows`` stay within ``limit``; unmarked otherwise."""
    return F.broadcast(df) if rows <= limit else df


def blank(col: str):
    """True for null and for texts of white space alone."""
    return F.col(col).isNull() | (F.regexp_replace(F.col(col), r"(?U)\s+", "") == "")
