"""The first rows of each group, where one group may hold most of the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import ship_package

#: Rows that a task holds before it cuts its groups down.
HELD_ROWS = 50_000
#: Tasks' rows of a group are first put together in so many parts.
MERGES = 64


def _sort_keys(table: pa.Table, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> tuple[pa.Table, list[tuple[str, str]]]:
    """table with what Arrow needs to sort it as Spark does: nulls last in the order,
    not-a-number greater than all numbers."""
    spec = []
    for i, c in enumerate(keys):
        table = table.append_column(f"__n{i}", pc.is_null(table[c]).cast(pa.int8()))
        spec += [(f"__n{i}", "ascending"), (c, "ascending")]
    for i, (c, down) in enumerate(order):
        table = table.append_column(f"__o{i}", pc.is_null(table[c]).cast(pa.int8()))
        spec.append((f"__o{i}", "ascending"))
        if pa.types.is_floating(table[c].type):
            table = table.append_column(f"__f{i}", pc.fill_null(pc.is_nan(table[c]), False).cast(pa.int8()))
            spec.append((f"__f{i}", "descending" if down else "ascending"))
        spec.append((c, "descending" if down else "ascending"))
    return table, spec


def first_of_each(table: pa.Table, keys: Sequence[str], order: Sequence[tuple[str, bool]], k: int) -> pa.Table:
    """The first k rows of each group of table, sorted by group and order."""
    wide, spec = _sort_keys(table, keys, order)
    rows = table.take(pc.sort_indices(wide, sort_keys=spec))
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in keys:
        column = rows[c].combine_chunks()
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    return rows.filter(pa.array(place < k))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], k: int, name: str = "rank") -> DataFrame:
    """df's first k rows of each group, with their rank from 1. order: columns, and whether
    each descends; nulls come last.

    A task keeps k rows of each of its groups, so that at most that many are shuffled for
    a group and task (more only where it has more groups than it can hold); they are put
    together in MERGES parts and last by group.

    Defined cases: a null key is a group. Rows that tie in all of the order have any
    order, so name one that is unique where that matters. An empty table and k = 0 give an
    empty result. Keys and order may be of any type that Arrow can sort.
    """
    ship_package(df.sparkSession)
    kind = StructType([*df.schema.fields, StructField("__sl_part", IntegerType())])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % MERGES
        kept: list[pa.RecordBatch] = []
        size = 0

        def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.append_column("__sl_part", pa.array(np.full(len(table), part), pa.int32()))
            yield from table.combine_chunks().to_batches()

        for b in batches:
            kept.append(b)
            size += b.num_rows
            if size > HELD_ROWS:
                table = first_of_each(pa.Table.from_batches(kept), keys, order, k)
                if len(table) > HELD_ROWS // 2:
                    # Too many groups to hold: these go on as they are.
                    yield from sent(table)
                    table = table.slice(0, 0)
                kept, size = table.to_batches(), len(table)
        if size:
            yield from sent(first_of_each(pa.Table.from_batches(kept), keys, order, k))

    few = df.mapInArrow(held, kind)
    by: list[Column] = [(F.desc_nulls_last if down else F.asc_nulls_last)(c) for c, down in order]
    place = lambda *parts: F.row_number().over(Window.partitionBy(*parts).orderBy(*by))
    merged = few.withColumn(name, place(*keys, "__sl_part")).where(F.col(name) <= k)
    return merged.withColumn(name, place(*keys)).where(F.col(name) <= k).drop("__sl_part")
