"""Blocks of ordered rows, and scans over them: a recurrence over a long stream as many tasks.

A recurrence whose steps are maps that can be composed (affine maps of a filter's state, caps of a limiter, max-plus
matrices) is done in three steps: each block of rows gives the map of all its steps, the maps are scanned, and each
block is replayed from the state that comes before it.  No task holds more than a block, or ``FAN`` maps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FAN = 1024
BATCH_ROWS = 20_000

Columns = dict[str, list]


def with_halo(df: DataFrame, i: str, size: int, before: int, after: int) -> DataFrame:
    """Adds ``block`` (``i`` div ``size``) and ``own``; rows near an edge also go to the neighbour, as context (``own`` false).

    A block gets the ``before`` rows ahead of it and the ``after`` rows behind it; both are at most ``size``.
    """
    block, at = F.floor(F.col(i) / size), F.pmod(F.col(i), F.lit(size))
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    left = F.when((at < after) & (block > 0), F.struct((block - 1).alias("block"), F.lit(False).alias("own")))
    right = F.when(at >= size - before, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))
    spread = df.withColumn("__to", F.explode(F.filter(F.array(own, left, right), lambda x: x.isNotNull())))
    return spread.withColumn("block", F.col("__to.block")).withColumn("own", F.col("__to.own")).drop("__to")


def key_starts(keys: pa.Array) -> np.ndarray:
    """Where a run of equal keys begins; a key may be a struct."""
    if pa.types.is_struct(keys.type):
        fields = [key_starts(f) for f in keys.flatten()]
        return np.unique(np.concatenate(fields)) if fields else np.zeros(min(1, len(keys)), dtype=np.int64)
    if len(keys) < 2:
        return np.zeros(len(keys), dtype=np.int64)
    now, before = keys.slice(1), keys.slice(0, len(keys) - 1)
    other = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(now.is_null(), before.is_null()))
    return np.r_[0, np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1]


def each_block(df: DataFrame, keys: list[str], order: str, run: Callable, schema: str, carried: DataFrame | None = None, arrays: bool = False) -> DataFrame:
    """``run(columns, before)`` for each block, its rows in order; gives rows of ``schema``.

    ``carried`` (keys, before) has at most one row for each block, whose value is handed to ``run``.  Blocks are dealt by hash and
    sorted, so a task holds one at a time, and small ones cost no call of Spark each.  With ``arrays``, columns are numpy arrays and
    ``run`` gives a column or a single value for each field.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))
    carries = carried is not None
    if carries:
        df = df.join(carried.select(*keys, F.col("before").alias("__before")), keys, "left")
    names = df.columns

    def found(block: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(block)
        before = table.column("__before")[0].as_py() if carries else None
        if not arrays:
            rows = run({c: x.to_pylist() for c, x in zip(names, table.columns, strict=True)}, before)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(out)
        else:
            plain = {c: x.combine_chunks() for c, x in zip(names, table.columns, strict=True) if c != "__before"}
            made = run({c: x.to_pylist() if pa.types.is_nested(x.type) else x.to_numpy(zero_copy_only=False) for c, x in plain.items()}, before)
            n = max(len(x) for x in made if isinstance(x, (np.ndarray, list)))
            columns = [x if isinstance(x, (np.ndarray, list)) else [x] * n for x in made]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.Table] = []
        key, made = None, []
        for batch in batches:
            ids = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            cuts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            table = pa.Table.from_batches([batch])
            for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                if ids[a] != key and block:
                    made.append(found(block))
                    block = []
                key = ids[a]
                block.append(table.slice(a, b - a))
            if sum(x.num_rows for x in made) >= BATCH_ROWS:
                yield from pa.concat_tables(made).combine_chunks().to_batches(BATCH_ROWS)
                made = []
        if block:
            made.append(found(block))
        if made:
            yield from pa.concat_tables(made).combine_chunks().to_batches(BATCH_ROWS)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(each, schema)


def exclusive_scan(maps: DataFrame, key: str, at: str, value: str, compose: Callable) -> DataFrame:
    """(key, at, before): the maps (``value``, arrays of doubles) of all rows before, composed in order; null for the first.

    ``at`` numbers a key's rows from 0.  Keys of more than ``FAN`` rows are scanned over chunks first, level by level.
    """
    kind = dict(maps.dtypes)[key]
    maps = maps.select(key, at, value)
    most = maps.agg(F.max(at)).first()[0] or 0
    chunk = f"__{at}"
    dealt = maps.withColumn(chunk, F.floor(F.col(at) / FAN))

    def local(columns: Columns, now) -> list[tuple]:
        rows = []
        for k, i, v in zip(columns[key], columns[at], columns[value], strict=True):
            rows.append((k, i, now))
            now = v if now is None else [float(x) for x in compose(now, v)]
        return rows

    schema = f"{key} {kind}, {at} bigint, before array<double>"
    if most < FAN:
        return each_block(dealt, [key, chunk], at, local, schema)

    def whole(columns: Columns, _) -> list[tuple]:
        now = columns[value][0]
        for v in columns[value][1:]:
            now = [float(x) for x in compose(now, v)]
        return [(columns[key][0], columns[chunk][0], now)]

    chunks = each_block(dealt, [key, chunk], at, whole, f"{key} {kind}, {chunk} bigint, value array<double>")
    return each_block(dealt, [key, chunk], at, local, schema, exclusive_scan(chunks, key, chunk, "value", compose))
