"""Readers and writers with explicit schemas; nothing is inferred."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to a new shared folder and reads it back, so that several jobs don't each make it anew."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._plumbline_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes under which a table may be one row group, and so one task: it is dealt to all cores before dear expressions.
ONE_SPLIT = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table, dealt to all cores; a larger one stays as its files are split. Spark's own estimate of a scan is its files' size."""
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < ONE_SPLIT else df


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir``; on one machine, in its temporary folder where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root}/plumbline-{label}-{uuid.uuid4().hex}"


def read_csv_corpus(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One partitioned table; a split is a partition, so reading one prunes the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, name: str, text: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == name).withColumn(text, F.coalesce(text, F.lit("")))


def read_eval_items(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Items, and the lines that aren't JSON of the schema; blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("item"), F.expr("try_parse_json(value)").isNotNull().alias("ok"))
    return parsed.where("ok").select("item.*"), parsed.where("NOT ok").select(F.col("value").alias("line"))


def read_appeals(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Appeals without malformed lines; empty where nothing was ever written."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_appeals(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def aligned(items: DataFrame, scores: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Items with their scores, and the keys that only one side has."""
    joined = items.join(scores, key)
    stray = items.select(key).join(scores.select(key, F.lit(1).alias("_s")), key, "full_outer").where("_s IS NULL").select(key).union(scores.select(key).join(items.select(key), key, "left_anti"))
    return joined, stray


def metrics_table(metrics: DataFrame) -> DataFrame:
    """Markdown rows, best average precision first."""
    row = F.format_string("| %s | %.4f | %.4f |", "model", "average_precision", "roc_auc")
    return metrics.orderBy(F.desc("average_precision"), "model").select(row.alias("line"))


def manifest(df: DataFrame, report: DataFrame, checksums: DataFrame, seed: int) -> DataFrame:
    """One JSON object for all splits."""
    held = report.join(checksums.select("split", "checksum"), "split")
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", F.struct("n", "positives", "checksum")))))
    return held.agg(entries.alias("splits")).select(F.to_json(F.struct(F.lit(seed).alias("seed"), "splits")).alias("manifest"))
