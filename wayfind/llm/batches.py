"""Arrow batches in, Arrow batches out: the shape of the Python stages here.

A stage keeps one batch of whole texts in memory at a time. Batches of texts have few rows,
as the JVM and the worker each hold one and keep its memory, and are cut again by bytes, so
that a run of very long texts does not add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from wayfind.session import share_code

BATCH_BYTES = 2 << 20
BATCH_ROWS = 500
_ROWS, _USUAL = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def map_texts(rows: DataFrame, each: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``rows.mapInArrow``, with small batches unless the session has its own size of them."""
    share_code(rows.sparkSession)
    conf = rows.sparkSession.conf
    if conf.get(_ROWS, _USUAL) == _USUAL:
        conf.set(_ROWS, BATCH_ROWS)
    return rows.mapInArrow(each, schema)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``, in order."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        first = held = 0
        for k, text in enumerate(pa.compute.binary_length(sizes).to_pylist()):
            if held and held + (text or 0) > most:
                yield batch.slice(first, k - first)
                first, held = k, 0
            held += text or 0
        if batch.num_rows > first:
            yield batch.slice(first)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The values of a string column as UTF-8, without decoding them."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
