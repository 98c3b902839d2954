"""Turns of conversations in order, read in one pass by tasks that hold a bounded part of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that become Python values at a time, and rows (or characters) of a batch that goes back.
AT_ONCE, ROWS_OUT, CHARS_OUT = 256, 4096, 8_000_000


def text_of(column: str) -> Column:
    """A column as text; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def in_order(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with all rows of a ``key`` in one partition, sorted by key and ``order`` (nulls first).

    The sort spills, and what reads it afterwards sees one row after another, so a key with a third of all rows costs
    its task time but no memory.
    """
    return rows.repartition(key).sortWithinPartitions(key, *order)


def stream(rows: DataFrame, schema: str, step: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """``step`` over the rows of each partition, in their order, as tuples; it yields the tuples of ``schema``.

    Neither side holds more than a slice of an Arrow batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(start, AT_ONCE)
                    yield from zip(*[c.to_pylist() for c in part.columns], strict=True)

        held, size = [], 0
        for row in step(values()):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if len(held) >= ROWS_OUT or size >= CHARS_OUT:
                yield _batch(held, target)
                held, size = [], 0
        if held:
            yield _batch(held, target)

    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


#: DuckDB's text for the unsigned CRC-32 of an ASCII expression, by the polynomial's table; the statement needs CRC_TABLE.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i)))"""


def crc_sql(text: str) -> str:
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(ascii(substr({text}, k, 1)) AS BIGINT))"
    start = f"list_prepend(CAST(4294967295 AS BIGINT), {codes})"
    return f"xor(list_reduce({start}, lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295)"
