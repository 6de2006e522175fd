"""What operators over large tables share: settled tables, checked broadcasts, and
positions in an order that no single task sees whole."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once, unless their PYTHONPATH has it."""
    sc = spark.sparkContext
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in paths or sc.applicationId in _shipped:
        return
    name = Path(tempfile.mkdtemp(prefix="sluice-code-")) / "sluice_code.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((ROOT / "sluice").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(name))
    _shipped.add(sc.applicationId)


def scratch_ready(spark: SparkSession) -> None:
    """Names a checkpoint folder where the session has none.

    A cluster names a shared folder in spark.checkpoint.dir, which is used as it
    is. Only a session in one local process, as in tests, gets a folder of its own; on
    a cluster without that setting what a lost executor held would be gone, so that
    is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sluice-ck-"))


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, lineage cut.

    A checkpoint takes its plan's size estimate and constraints along. Where a loop
    joins a table with itself these would double with every round, so the result is
    a frame of the written rows and the schema alone. Spark deletes the files when
    the frame is collected if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    scratch_ready(spark)
    kept = df.checkpoint(eager=True)
    rows = kept._jdf.queryExecution().analyzed().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most so many rows, without counting further than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def hinted(df: DataFrame, most_rows: int) -> DataFrame:
    """df marked for broadcast if a count proves it small; else as it is, for a
    shuffled join whose skewed partitions adaptive execution splits."""
    return F.broadcast(df) if small_enough(df, most_rows) else df


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with right on the columns of on, null equal to null."""
    renamed = right.withColumnsRenamed({c: f"__sl_on_{c}" for c in on})
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"__sl_on_{c}"))
    return left.join(renamed, match, how).drop(*[f"__sl_on_{c}" for c in on])


def pieces(df: DataFrame, *order: Column, parts: int | None = None) -> DataFrame:
    """df, settled in the given order: range-partitioned, sorted within, with __sl_at,
    whose upper bits number the partition and whose lower 33 bits the row in it."""
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return settled(dealt.sortWithinPartitions(*order).withColumn("__sl_at", F.monotonically_increasing_id()))


def piece_of(at: str = "__sl_at") -> Column:
    return F.shiftright(at, 33)


def ranked(df: DataFrame, *order: Column, name: str = "rank", parts: int | None = None) -> DataFrame:
    """df with its rank from 0 in the given order, found without one task seeing
    all rows: rows are range-partitioned and numbered within each partition, and
    the partitions' sizes, as few as there are partitions, give the offsets."""
    rows = pieces(df, *order, parts=parts)
    sizes = rows.groupBy(piece_of().alias("__sl_part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__sl_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__sl_part", before.alias("__sl_before"))
    return (
        rows.withColumn("__sl_part", piece_of())
        .join(F.broadcast(offsets), "__sl_part")
        .withColumn(name, F.col("__sl_before") + F.col("__sl_at").bitwiseAND((1 << 33) - 1))
        .drop("__sl_part", "__sl_at", "__sl_before")
    )
