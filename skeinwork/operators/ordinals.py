"""Global ordinals: the place of each row in an order of the whole frame, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.storage import stored

#: monotonically_increasing_id keeps the row's number within its partition in so many low bits.
ROW_BITS = 33


def with_ordinals(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """df with `name`, from 0 in the order of the columns (nulls first); a column so named is replaced.

    Rows are range-partitioned and sorted by the order and stored with their partition and their place in it; the
    partitions' counts, one for each, give the offsets. Rows that tie lie in one partition, in any order, so an order
    that has many ties needs more columns. The result is a table: reading it again gives the same ordinals.
    """
    dealt = df.drop(name).repartitionByRange(*order).sortWithinPartitions(*order)
    seen = F.monotonically_increasing_id()
    part, row = F.shiftright(seen, ROW_BITS).cast("int"), seen.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    placed = stored(dealt.select("*", part.alias("part of order"), row.alias("row of part")), "ordered")
    counts = placed.groupBy("part of order").count().collect()  # one row for each partition
    offsets, before = [], 0
    for r in sorted(counts):
        offsets.append((r[0], before))
        before += r[1]
    schema = T.StructType([T.StructField("part of order", T.IntegerType()), T.StructField("rows before", T.LongType())])
    known = df.sparkSession.createDataFrame(offsets, schema)
    return placed.join(F.broadcast(known), "part of order").select(*(c for c in df.columns if c != name), (F.col("rows before") + F.col("row of part")).alias(name))
