"""Helpers shared by the operators: written intermediate tables, Arrow batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, in rows and in bytes, so that a batch of long texts fits beside the others in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; on one machine, one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/plumbline-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends here, and sizes are real."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_plumbline_path", None)
        if path:
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text (null: empty), under fixed names, so that other columns can't clash."""
    return documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def batches(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """Applies ``fn``: dict of Python lists by column -> dict of lists or arrays, to each Arrow batch."""
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = arrow_schema(struct)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def arrow_schema(struct: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """Smallest reachable node of each node that has a link, as ``(node, component)``.

    ``edges`` has columns ``u`` and ``v`` of one orderable type; loops and nulls are ignored. Alternates the
    large-star and small-star steps of Kiveris et al. (2014): each round sends every node's larger neighbours, and
    then its smaller ones, to the smallest node it knows, until only stars are left. The minimum is a map-side
    aggregate joined back, so that a hub's neighbours aren't gathered into one task. Every round is written to the
    shared folder; nothing but the test for stars, one row, reaches the driver.
    """

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # Dealt anew, both sides of the join are plain exchanges, and Spark can split a hub's rows among tasks.
        joined = pairs.hint("merge").join(least.hint("rebalance").hint("merge"), "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m").select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def settled(pairs: DataFrame) -> bool:
        """True for a forest of stars: no node has two centres, and none with a centre is one. A further round changes nothing then."""
        ends = pairs.select("u", F.lit(1).alias("held"), F.lit(0).alias("centre")).union(pairs.select("v", F.lit(0), F.lit(1)))
        per = ends.groupBy("u").agg(F.sum("held").alias("held"), F.max("centre").alias("centre"))
        return per.where("held > 1 OR held = 1 AND centre = 1").isEmpty()

    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = written(now, label)
    while not settled(now):
        last = now
        now = written(stars(stars(last, True), False), label)
        discard(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
