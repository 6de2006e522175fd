"""What the corpus operators share: sessions, scratch data, word rules, ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import hinted, ranked, scratch_ready, settled, ship_package, small_enough  # noqa: F401

#: White space that parts words, and a word, as Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Matches only white space that isn't already one single space.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, which here are whole texts. A session that sets another number than Spark's default keeps it.
BATCH_ROWS, DEFAULT_ROWS = 1000, 10_000


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors unless their PYTHONPATH has it, and keeps
    Arrow batches small: they lie in memory beside the heap, several a task."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == DEFAULT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship_package(spark)


def process_cache(name: str) -> dict:
    """A dict that this Python worker keeps from task to task, for one operator at a
    time: a worker that serves another one lets the last one's go, so that a job of
    many operators holds no more than its largest."""
    store = sys.modules.setdefault("sluice_process_cache", type(sys)("sluice_process_cache")).__dict__
    kept = store.setdefault("kept", {})
    if name not in kept:
        if kept:
            kept.clear()
            gc.collect()
            release_memory()
        kept[name] = {}
    return kept[name]


def release_memory() -> None:
    """Gives back to the system what this Python worker has freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def let_go(spark: SparkSession) -> None:
    """Collects the driver's garbage, in Python and in the JVM. With a long row of jobs
    that also lets Spark remove the shuffles, broadcasts and checkpoints of finished
    steps, which it does once their handles are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    release_memory()


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], cache: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """step, giving memory back after every batch: workers share an executor's with its
    JVM. cache names the operator whose cache step uses; others' are let go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache(cache)
        for b in step(batches):
            yield b
            del b
            release_memory()

    return run


def one_spaced(text: Column) -> Column:
    """Every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def lower_ascii(text: Column) -> Column:
    """text with A-Z in lower case, and no other letter changed."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's UTF-8 bytes end to end, and where each row begins; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of all rows begin."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    before = np.empty_like(space)
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(before & ~space)


def word_counts(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    return np.diff(np.searchsorted(word_starts(data, offsets), offsets))
