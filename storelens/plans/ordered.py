"""Skew-safe scans over per-key ordered series (lag, running totals,
carry-forward, trailing range windows).

A window ``partitionBy(app_id)`` sends every row of an app to one task; when
one app owns a third of a 100 TB table that task never finishes.  These
helpers partition by ``(key, time bucket)`` instead, so a hot key is spread
over as many tasks as it has buckets, and stitch bucket boundaries back
together through a per-(key, bucket) summary that has one row per bucket
(tiny next to the data):

* ``with_prev``      value of the previous row            (W2, L5)
* ``running_totals`` cumulative sums from the series start (W1, W6, W5)
* ``last_non_null``  most recent non-null value so far     (J7, W6)

Trailing range windows (W3) are differences of running totals read at probe
rows (see ``operators.prices.offers``), so they need no lookback-sized bucket.

All results are exact; bucket width only trades task size for summary size.
The width is a parameter (``DEFAULT_WIDTH_US`` unless given), so building a plan
starts no job; ``auto_width`` is for callers who measure it once and keep it.
The big side is shuffled once on ``(key, bucket)``; the summary join reuses
that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US
BUCKET = "_bucket"

MIN_WIDTH_US = MINUTE_US
MAX_WIDTH_US = 28 * DAY_US
TARGET_ROWS_PER_BUCKET = 2_000_000
DEFAULT_WIDTH_US = 7 * DAY_US


def auto_width(df: DataFrame, keys: list[str], ts: str, target_rows: int = TARGET_ROWS_PER_BUCKET) -> int:
    """Bucket width (microseconds, whole minutes) giving about ``target_rows`` rows
    per (key, bucket) for the densest key-day; one partial aggregation, and
    only a single number reaches the driver."""
    densest = (df.groupBy(*keys, F.date_trunc("day", F.col(ts)).alias("_day")).count()
                 .agg(F.max("count")).first()[0]) or 1
    w = DAY_US * target_rows // densest
    return int(min(MAX_WIDTH_US, max(MIN_WIDTH_US, w // MINUTE_US * MINUTE_US)))


INTEGRAL_WIDTH = 4096  # default bucket width when the order column is an integer (e.g. a version)


def _is_integral(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def _width(df, keys, ts, width_us):
    if width_us is not None:
        return width_us
    return INTEGRAL_WIDTH if _is_integral(df, ts) else DEFAULT_WIDTH_US


def _bucket(df: DataFrame, ts: str, width: int) -> Column:
    """Time bucket for timestamps, value bucket for integral order columns."""
    if _is_integral(df, ts):
        v = F.col(ts).cast("long")
        return F.floor((v - F.pmod(v, F.lit(width))) / F.lit(width)).cast("long")
    return bucket_of(ts, width)


def epoch_us(ts: str) -> Column:
    """Microseconds since epoch of a TIMESTAMP_NTZ read as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def bucket_of(ts: str, width_us: int) -> Column:
    """floor(epoch_us / width) with integer arithmetic (exact, also before 1970)."""
    m = epoch_us(ts)
    return F.floor((m - F.pmod(m, F.lit(width_us))) / F.lit(width_us)).cast("long")


def _order_struct(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _zero(dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType):
        return F.lit("")
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.lit("1970-01-01 00:00:00").cast(dt)
    return F.lit(0).cast(dt)


def _safe_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Null-safe partition keys: (isnull(k), coalesce(k, zero)) per key.  A window
    groups NULL keys together; these columns let the summary join use plain
    equality (so its partitioning matches the window's) without losing the
    NULL-key series."""
    out = []
    for i, k in enumerate(keys):
        dt = df.schema[k].dataType
        df = (df.withColumn(f"_kn{i}", F.col(k).isNull())
                .withColumn(f"_kv{i}", F.coalesce(F.col(k), _zero(dt))))
        out += [f"_kn{i}", f"_kv{i}"]
    return df, out


def with_prev(df: DataFrame, keys: list[str], ts: str, order: list[str], values: list[str],
              width_us: int | None = None, out: str = "prev") -> DataFrame:
    """Add ``out`` = struct(values) of the previous row in ``order`` within ``keys``
    (NULL for a key's first row).  ``order`` must be a total order (end with a
    unique id) and start with ``ts``."""
    d, sk = _safe_keys(df.withColumn(BUCKET, _bucket(df, ts, _width(df, keys, ts, width_us))), keys)
    w_in = Window.partitionBy(*sk, BUCKET).orderBy(*order)
    d = d.withColumn("_lag", F.lag(F.struct(*values)).over(w_in))
    tails = d.groupBy(*sk, BUCKET).agg(F.max_by(F.struct(*values), _order_struct(order)).alias("_tail"))
    carry = tails.select(*sk, BUCKET, F.lag("_tail").over(Window.partitionBy(*sk).orderBy(BUCKET)).alias("_carry"))
    j = d.join(carry, [*sk, BUCKET], "left")
    return j.withColumn(out, F.coalesce(F.col("_lag"), F.col("_carry"))).drop("_lag", "_carry", BUCKET, *sk)


def running_totals(df: DataFrame, keys: list[str], ts: str, sums: dict[str, Column],
                   width_us: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Add cumulative sums of ``sums`` (name -> numeric Column) from the start of
    each key's series up to the current row.

    ``order=None``: RANGE frame on ``ts`` (rows with equal ts share the value,
    like SQL's default window frame).  ``order=[ts, ..., id]``: ROWS frame in
    that total order.
    """
    d, sk = _safe_keys(df.withColumn(BUCKET, _bucket(df, ts, _width(df, keys, ts, width_us))), keys)
    for n, c in sums.items():
        d = d.withColumn(f"_v_{n}", c)
    if order is None:
        w_in = Window.partitionBy(*sk, BUCKET).orderBy(ts)  # default RANGE frame
    else:
        w_in = (Window.partitionBy(*sk, BUCKET).orderBy(*order)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for n in sums:
        d = d.withColumn(f"_in_{n}", F.sum(f"_v_{n}").over(w_in))
    per_bucket = d.groupBy(*sk, BUCKET).agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums])
    w_b = Window.partitionBy(*sk).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_bucket.select(*sk, BUCKET, *[F.sum(f"_b_{n}").over(w_b).alias(f"_p_{n}") for n in sums])
    j = d.join(prefix, [*sk, BUCKET], "left")
    for n in sums:
        j = j.withColumn(n, F.coalesce(F.col(f"_p_{n}"), F.lit(0)) + F.col(f"_in_{n}"))
    return j.drop(BUCKET, *sk, *[f"_{p}_{n}" for n in sums for p in ("v", "in", "p")])


def last_non_null(df: DataFrame, keys: list[str], ts: str, order: list[str], value: str,
                  out: str, width_us: int | None = None) -> DataFrame:
    """Add ``out`` = the most recent non-null ``value`` at or before the current
    row (in ``order``) within ``keys``."""
    d, sk = _safe_keys(df.withColumn(BUCKET, _bucket(df, ts, _width(df, keys, ts, width_us))), keys)
    w_in = (Window.partitionBy(*sk, BUCKET).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_in", F.last(value, ignorenulls=True).over(w_in))
    tails = d.groupBy(*sk, BUCKET).agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), _order_struct(order))).alias("_tail"))
    w_b = Window.partitionBy(*sk).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*sk, BUCKET, F.last("_tail", ignorenulls=True).over(w_b).alias("_carry"))
    j = d.join(carry, [*sk, BUCKET], "left")
    return j.withColumn(out, F.coalesce(F.col("_in"), F.col("_carry"))).drop("_in", "_carry", BUCKET, *sk)
