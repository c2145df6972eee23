"""Serial ids without a sequence: a prefix sum over sorted partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: ``monotonically_increasing_id`` has the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def _sortable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _sortable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_sortable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def with_serial_ids(df: DataFrame, order_by, start: int = 0, id_col: str = "id") -> DataFrame:
    """``df`` with ids ``start`` + 1, + 2, ... without a gap, in the order of
    ``order_by`` (nulls last) and, of equals, of all other columns that can be
    sorted, so that every run gives a row the same id; only rows alike in all of
    these may change places.

    The rows are sorted over all partitions and written once to the checkpoint
    folder with their partition and place; the rows of each partition are
    counted, the counts summed up in the partitions' order, and each row adds
    its own place. No task sees more than its partition, and the sums have one
    row for each."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    rows = df.drop(id_col)
    rest = [f.name for f in rows.schema.fields if f.name not in keys and _sortable(f.dataType)]
    at = F.monotonically_increasing_id()
    placed = cut_lineage(rows.orderBy(*(F.col(c).asc_nulls_last() for c in keys + rest)).withColumn("_at", at))
    part = F.shiftright("_at", _PLACE_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sums = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = placed.withColumn("_part", part).join(sums, "_part")
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return out.select((F.lit(int(start) + 1) + F.col("_before") + place).cast("bigint").alias(id_col), *rows.columns)


def last_id(df: DataFrame, id_col: str = "id") -> int:
    """The largest id of a table, 0 for an empty one: where the next ids start."""
    return df.agg(F.max(id_col)).first()[0] or 0
