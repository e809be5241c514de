"""Parallelism of CPU-bound row jobs over few input files.

A Parquet file with a single row group is one scan task, so a 10,000-row text
table would run its regex chain on one core.  ``spread`` is applied once, at the
scan: a table of fewer files than the cluster has cores is hash-partitioned on
a unique id over them; any other is left as it is.  Only the file listing is
looked at, no job runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, key: str, per_core: int = 2) -> DataFrame:
    """Spread the rows of a table scan over the cores if it has fewer files than cores."""
    if scan.isStreaming:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if len(scan.inputFiles()) >= cores else scan.repartition(cores * per_core, key)
