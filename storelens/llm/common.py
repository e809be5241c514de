"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the word rule `[^\x20\x09-\x0D]+`, as literal characters.
SPACES = " \t\n\x0b\f\r"
FILE_ROWS = 8000  # of a kept table with a bound on its files, where it is large
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text (null: none), split at space and U+0009 to U+000D."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+"), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; its own folder only in a local session without one."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
        d = tempfile.mkdtemp(prefix="llm-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


_passing: list[list[str]] = []


def file_parts(spark: SparkSession, rows: int) -> int:
    """Partitions to write a table of ``rows`` narrow rows in: two a core at least, and more as it grows."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def keep(df: DataFrame, lasting: bool = False, parts: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    The lineage ends here, the files survive lost executors, and later reads
    prune columns, which a checkpoint of rows does not.  Inside ``passing`` the
    folder goes at the end unless it is ``lasting``.  At most ``parts`` files are
    written, if given: on a local file system the JVM starts several processes a
    file (chmod), each of them a copy of the executor for a moment.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    if _passing and not lasting:
        _passing[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Folders that ``keep`` writes inside are deleted at the end: what is returned must rest on lasting ones."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def by_bytes(batches, column: str, limit: int):
    """Cut Arrow batches so that the values of ``column`` in one piece stay near ``limit`` bytes.

    A single larger value forms a piece of its own; nothing is dropped.
    """
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        import pyarrow.compute as pc
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        if sizes.sum() <= limit:
            yield batch
            continue
        total, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < n:
            base = int(total[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
