"""Run a stream over a table's own files and wait until all of them are processed.

Used by the registered streaming queries: the stream reads the input files
(no copy), its tables and checkpoint lie under the session's checkpoint folder
(shared storage on a cluster), and the trigger is ``availableNow``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storelens.session import ensure_checkpoint_dir
from storelens.sources.tables import table_path


def streamed(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """The table as a stream of its files (same signature as ``read_table``)."""
    path = table_path(sf_dir, name)
    schema = spark.read.parquet(path).schema
    # as a pattern: a table may be one file, which a stream doesn't take as its folder
    df = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return df.select(*columns) if columns else df


def new_root(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def run_all(stream: DataFrame, step: Callable[[DataFrame, int], None], root: str) -> None:
    """Apply ``step(batch, batch_id)`` to everything that is there."""
    q = (stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream under {root} failed: {q.exception()}")
