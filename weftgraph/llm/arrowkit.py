"""Small helpers around Arrow batches, shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: whole texts are long, so batches stay small.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that workers stay small at any text length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts_of(df: DataFrame, *keep: str) -> DataFrame:
    """The named columns and the text, null as empty; extra columns are left behind."""
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return batch.column(name).to_pylist()


def emit(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[f.name], type=f.type) for f in schema], schema=schema
    )


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
