"""What the operators of this subpackage share: table access, durable cuts of lineage, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import durable

__all__ = ["durable", "map_batches", "pieces", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bytes of Arrow columns that are turned into Python lists at a time, unless a single row is larger.
PIECE_BYTES = 1 << 22


def pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows, halved while they hold more than ``PIECE_BYTES``."""
    for at in range(0, batch.num_rows, rows):
        work = [batch.slice(at, rows)]
        while work:
            piece = work.pop()
            if piece.num_rows > 1 and piece.nbytes > PIECE_BYTES:
                half = piece.num_rows // 2
                work += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


def map_batches(
    df: DataFrame,
    schema: str,
    start: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    rows: int = 512,
) -> DataFrame:
    """mapInArrow over Python lists: ``start()`` runs once a task and returns the function of a batch.

    Batches hold at most ``rows`` rows and ``PIECE_BYTES``, so that very long texts do not pile up in a worker.
    """
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for piece in pieces(batch, rows):
                out = step({n: piece.column(i).to_pylist() for i, n in enumerate(piece.schema.names)})
                arrays = [
                    out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
        # workers outlive their tasks; what the pool still holds would count against the executor
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
