"""Exact ranks and running sums without a window over all rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of an ordering, by quantiles of its values, and values of one piece of a list.
BUCKETS, PIECE = 256, 20_000


def grouped_rank(df: DataFrame, keys: list[str], hashed: Column, tie: Column, digits: int = 3) -> DataFrame:
    """Adds ``rank`` (from 1) and ``of`` (rows) within ``keys``, ordered by a hexadecimal hash, then ``tie``.

    The leading digits of the hash part each key's rows evenly; the parts' counts are summed over the parts before.
    """
    bucketed = df.withColumn("_b", F.substring(hashed, 1, digits))
    sizes = bucketed.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    sizes = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("of"))
    own = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(hashed, tie))
    same = lambda c: F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    left = bucketed.withColumn("_own", own).alias("l").hint("merge")
    joined = left.join(sizes.alias("r").hint("merge"), [same(c) for c in (*keys, "_b")])
    return joined.select(*(F.col(f"l.{c}").alias(c) for c in df.columns), (F.col("_own") + F.col("_before")).alias("rank"), F.col("of"))


def running_sums(df: DataFrame, keys: list[str], order: str, sums: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds ``cum_*`` for each of ``sums``: totals over rows of ``keys`` whose ``order`` is as large or larger.

    ``order`` is distinct within ``keys``. Rows fall into buckets at approximate quantiles (any edges give the exact
    result), each bucket's total is summed over those above, and windows run inside buckets only.
    """
    edges = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001) or []))
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col(order) >= e)) if edges else F.lit(0)
    parted = df.withColumn("_b", at)
    totals = parted.groupBy(*keys, "_b").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    above = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", *(F.coalesce(F.sum(f"_t_{c}").over(above), F.lit(0)).alias(f"_a_{c}") for c in sums))
    own = Window.partitionBy(*keys, "_b").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, "_b")]
    joined = parted.alias("l").hint("merge").join(totals.alias("r").hint("merge"), same).select("l.*", *(F.col(f"r._a_{c}") for c in sums))
    return joined.select(*df.columns, *((F.sum(c).over(own) + F.col(f"_a_{c}")).alias(f"cum_{c}") for c in sums))


def ordered_hash(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n, hash``: rows of each key, and the SHA-256 of its values (whole numbers) in ascending order, joined by commas; nulls are counted, not hashed.

    Values are sorted by ranges, which many tasks share; each range sends a key's values on in a few long pieces, and these are hashed in order as
    a stream. So a key of any size needs bounded memory, and its rows never meet.
    """
    kind = df.schema[key].dataType
    struct = T.StructType([T.StructField("key", kind), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("text", T.StringType())])
    out = T.StructType([T.StructField(key, kind), T.StructField("n", T.LongType()), T.StructField("hash", T.StringType())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({str(i): list(c) for i, c in enumerate(zip(*rows))})

    def listed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        n, seq = 0, 0
        rows = lambda: batch([(k, part, seq, count, ",".join(map(str, ids))) for (k, part), (count, ids) in held.items()])
        for b in source:
            for k, part, value in zip(*(c.to_pylist() for c in b.columns)):
                own = held.setdefault((k, part), [0, []])
                own[0] += 1
                if value is not None:
                    own[1].append(value)
            n += b.num_rows
            if n >= PIECE:
                yield _typed(rows(), struct)
                held, n, seq = {}, 0, seq + 1
        if held:
            yield _typed(rows(), struct)

    def hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # key, rows, hash, whether it has a value
        done: list[tuple] = []
        for b in source:
            for k, _, _, n, text in zip(*(c.to_pylist() for c in b.columns)):
                if not now or now[0] != k:
                    if now:
                        done.append((now[0], now[1], now[2].hexdigest()))
                    now = [k, 0, hashlib.sha256(), False]
                now[1] += n
                if text:
                    now[2].update((b"," if now[3] else b"") + text.encode())
                    now[3] = True
            if done:
                yield _typed(batch(done), out)
                done = []
        if now:
            yield _typed(batch([(now[0], now[1], now[2].hexdigest())]), out)

    ids = df.select(F.col(key).alias("key"), F.col(value).cast("bigint").alias("value")).repartitionByRange("value").sortWithinPartitions("value")
    pieces = ids.select("key", F.spark_partition_id().alias("part"), "value").mapInArrow(listed, struct)
    return pieces.repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(hashed, out)


def _typed(batch: pa.RecordBatch, struct: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(struct)
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)
