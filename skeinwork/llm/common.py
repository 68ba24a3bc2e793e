"""What the operators of this subpackage share: byte texts and Arrow batches."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.storage import checkpointed, discard, scratch, shared_dir, stored

__all__ = ["BLANKS", "arrow_schema", "as_bytes", "checkpointed", "discard", "give_back", "map_rows", "read_table", "released", "scratch", "shared_dir", "stored", "widened"]

#: ASCII white space, the separators of words: space and tab to carriage return.
BLANKS = " \t\n\x0b\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def as_bytes(text: str | Column) -> Column:
    """The UTF-8 bytes of a text column; null gives no bytes."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("binary"), F.lit(b""))


def arrow_schema(ddl_types: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(ddl_types.items()))


def widened(df: DataFrame, **fields: str) -> T.StructType:
    """The schema of df with more fields after it."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in fields.items():
        schema.add(name, kind)
    return schema


def give_back() -> None:
    """Hands freed memory back to the system: Python workers live on between tasks, and the allocator would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc; elsewhere there is none
        trim(0)


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task for mapInArrow that gives freed memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def map_rows(
    df: DataFrame,
    row: Callable[[], Callable],
    fields: dict[str, tuple[str, pa.DataType]],
    flush_rows: int = 4096,
    flush_bytes: int = 8 << 20,
    group_bytes: int = 0,
) -> DataFrame:
    """mapInArrow with a small helper: row() is called once a task and returns what turns a row's tuple into tuples.

    With group_bytes the helper gets lists of rows, each of about so many bytes of text or one row.
    """
    ddl = ", ".join(f"`{n}` {t}" for n, (t, _) in fields.items())
    schema = arrow_schema({n: t for n, (_, t) in fields.items()})

    def units(batch: pa.RecordBatch) -> Iterator:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        if not group_bytes:
            yield from rows
            return
        group, weight = [], 0
        for values in rows:
            group.append(values)
            weight += _weight(values)
            if weight >= group_bytes:
                yield group
                group, weight = [], 0
        if group:
            yield group

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, held, weight = row(), [], 0
        for batch in batches:
            for unit in units(batch):
                for out in one(unit):
                    held.append(out)
                    weight += _weight(out)
                    if len(held) >= flush_rows or weight >= flush_bytes:
                        yield _batch(held, schema)
                        held, weight = [], 0
        if held:
            yield _batch(held, schema)

    return df.mapInArrow(released(task), ddl)


def _weight(values: tuple) -> int:
    return sum(len(v) for v in values if isinstance(v, (bytes, str)))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
