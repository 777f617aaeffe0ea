"""Ordered scans in pieces: prefix sums, last values and lags along an order without a task that holds all of a key.

The caller cuts the order into buckets by a monotone expression of it (a position or a line number
over a width). Rows are scanned within (keys, bucket), each bucket leaves one row of totals, the
totals are scanned along the buckets, and each row adds what the buckets before its own carry. The
bucket comes from values and not from partitions, so that a task that runs again gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a bucket, where the caller names none.
WIDTH = 1 << 16


def bucket_of(order: Column, width: int = WIDTH) -> Column:
    """The bucket of an integer order; null, which sorts first, has a bucket of its own."""
    return F.coalesce(F.floor(order / width), F.lit(-(1 << 62)))


def along(df: DataFrame, bucket: Column, order: list, *, keys: tuple[str, ...] = (), sums: dict | None = None, xors: dict | None = None, lasts: dict | None = None, lags: dict | None = None) -> DataFrame:
    """df with a column for each entry of sums, xors, lasts and lags (name: column).

    sums and xors run up to and with the row (nulls count as nothing, 0 before the first value); lasts is
    the last value that is not null up to the row; lags is the value of the row before, null for a key's first.
    `order` must be total within a key for a defined result, and `bucket` must not fall along it; with lasts or lags
    its entries are ascending columns. df is read twice: what is costly to make should be a table first.
    """
    sums, xors, lasts, lags = (x or {} for x in (sums, xors, lasts, lags))
    by = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket).withColumns({f"_v_{n}": c for kind in (sums, xors, lasts, lags) for n, c in kind.items()})
    value = lambda n: F.col(f"_v_{n}")
    here = Window.partitionBy(*by).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    inner = {f"_i_{n}": F.sum(value(n)).over(upto) for n in sums} | {f"_i_{n}": F.bit_xor(value(n)).over(upto) for n in xors}
    inner |= {f"_i_{n}": F.last(value(n), ignorenulls=True).over(upto) for n in lasts}
    inner |= {f"_i_{n}": F.lag(F.struct(value(n).alias("v"))).over(here) for n in lags}
    scanned = rows.withColumns(inner)
    newest = F.struct(*[F.struct(c.isNotNull(), c) for c in map(_plain, order)]) if lasts or lags else None
    totals = [F.sum(value(n)).alias(f"_t_{n}") for n in sums] + [F.bit_xor(value(n)).alias(f"_t_{n}") for n in xors]
    totals += [F.max_by(value(n), F.when(value(n).isNotNull(), newest)).alias(f"_t_{n}") for n in lasts]
    totals += [F.max_by(F.struct(value(n).alias("v")), newest).alias(f"_t_{n}") for n in lags]
    each = rows.groupBy(*by).agg(*totals)
    over = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    carried = {f"_c_{n}": F.sum(f"_t_{n}").over(over) for n in sums} | {f"_c_{n}": F.bit_xor(F.col(f"_t_{n}")).over(over) for n in xors}
    carried |= {f"_c_{n}": F.last(f"_t_{n}", ignorenulls=True).over(over) for n in (*lasts, *lags)}
    before = each.select(*by, *[c.alias(n) for n, c in carried.items()])
    met = scanned.join(before.withColumnsRenamed({k: f"_k_{k}" for k in by}), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = {n: zero(F.col(f"_i_{n}")) + zero(F.col(f"_c_{n}")) for n in sums}
    out |= {n: zero(F.col(f"_i_{n}")).bitwiseXOR(zero(F.col(f"_c_{n}"))) for n in xors}
    out |= {n: F.coalesce(F.col(f"_i_{n}"), F.col(f"_c_{n}")) for n in lasts}
    out |= {n: F.coalesce(F.col(f"_i_{n}"), F.col(f"_c_{n}"))["v"] for n in lags}
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def _plain(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numbered(df: DataFrame, bucket: Column, order: list, name: str, keys: tuple[str, ...] = (), start: int = 0) -> DataFrame:
    """df with the rank of each row along the order."""
    return along(df, bucket, order, keys=keys, sums={name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + (start - 1))
