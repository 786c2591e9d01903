"""Labelled corpora: checks, samples, deterministic splits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import build_document, word_count
from plumbline.operators.dims import check_columns
from plumbline.operators.metrics import percentiles
from plumbline.operators.prefix import grouped_rank, ordered_hash

#: Shares of the splits, and how far a split's rate may be from the corpus's.
SPLITS = (("train", 0.7), ("val", 0.1), ("calib", 0.1), ("test", 0.1))
RATE_TOLERANCE = 0.005
TOKENS_PER_WORD, MIN_WORDS = 1.35, 5


def validate_source(df: DataFrame, columns: list[str], label: str, rows: int | None = None, positives: int | None = None) -> DataFrame:
    """One row: counts and an array of problems (columns, rows, label domain, positives)."""
    lacking = sorted(set(columns) - set(df.columns))
    unknown = sorted(set(df.columns) - set(columns))
    y = F.col(label)
    counts = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.when(y == 1, 1).otherwise(0)), F.lit(0)).alias("n_positive"), F.count_if(y.isNull() | ~y.isin(0, 1)).alias("n_bad_label"))
    checks = [F.lit(f"missing columns: {', '.join(lacking)}") if lacking else F.lit(None), F.lit(f"unknown columns: {', '.join(unknown)}") if unknown else F.lit(None), F.when(F.col("n_bad_label") > 0, "label outside 0 and 1")]
    checks += [F.when(F.col("n_rows") != rows, "row count") if rows is not None else F.lit(None), F.when(F.col("n_positive") != positives, "positive count") if positives is not None else F.lit(None)]
    return counts.withColumn("problems", F.array_compact(F.array(*(c.cast("string") for c in checks))))


def seeded(key: Column, seed: int) -> Column:
    """The order of a seed: the same in every engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 42, splits=SPLITS) -> DataFrame:
    """Adds ``split``: within each label, rows in seeded order are cut at the splits' cumulated shares.

    The rank within a label comes from groups of bounded size (labels are few, and one may hold nearly all rows).
    """
    ranked = grouped_rank(df.withColumn("_h", seeded(F.col(key), seed)), [label], F.col("_h"), F.col(key))
    total, rule = 0.0, None
    for name, size in splits[:-1]:
        total += size
        # Cuts are compared as whole rows, so that no rounding of shares matters.
        test = F.col("rank") <= F.bround(F.col("of") * F.lit(round(total, 6)), 0)
        rule = F.when(test, name) if rule is None else rule.when(test, name)
    return ranked.withColumn("split", rule.otherwise(splits[-1][0])).drop("rank", "of", "_h")


def split_soundness(df: DataFrame, key: str, label: str, tolerance: float = RATE_TOLERANCE) -> DataFrame:
    """``split, n, rate, base_rate, off`` and, on each row, ids that occur in several splits."""
    twice = df.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").agg(F.count("*").alias("overlap"))
    base = df.agg(F.avg(F.col(label).cast("double")).alias("base_rate"))
    per = df.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
    return per.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(twice)).withColumn("off", F.abs(F.col("rate") - F.col("base_rate")) > tolerance)  # one row each


def split_checksum(df: DataFrame, key: str) -> DataFrame:
    """``split, n, checksum``: the hash of ascending ids, 16 digits, at any size of a split; see ``ordered_hash``."""
    return ordered_hash(df, "split", key).select("split", "n", F.substring("hash", 1, 16).alias("checksum"))


def split_fingerprint(df: DataFrame, key: str) -> DataFrame:
    """``split, n, fingerprint``: like the checksum, for any size: the MD5 hashes of ids are combined without an order, map-side."""
    part = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("bigint")
    return df.groupBy("split").agg(F.count("*").alias("n"), F.bit_xor(part).alias("fingerprint"))


def model_frame(df: DataFrame, key: str, fields: list[str], label: str, forbidden: set[str], fused: bool = True, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """``key, text, label, n_words`` of the rows that a model may learn from, and of those with fewer than ``min_words`` words.

    Raises before any job if a field is forbidden, and again if a forbidden column were to reach the result.
    """
    check_columns(fields, forbidden)
    text = build_document([F.col(f) for f in fields], fused)
    out = df.select(key, text.alias("text"), F.col(label).cast("int").alias(label)).withColumn("n_words", word_count(F.col("text")))
    check_columns([c for c in out.columns if c not in (key, "text", label, "n_words")], forbidden)
    return out.where(F.col("n_words") >= min_words), out.where(F.col("n_words") < min_words)


def split_report(df: DataFrame, label: str, words: str) -> DataFrame:
    """Rows, positives and word percentiles by split."""
    q = percentiles(df, words, ["split"], (0.5, 0.95)).select(F.col("split").alias("_s"), F.col("p50").cast("int").alias("median_words"), F.col("p95").cast("int").alias("p95_words"))
    per = df.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    return per.join(F.broadcast(q), F.col("split") == F.col("_s")).drop("_s")  # a row per split


def prep_report(df: DataFrame, label: str, words: str) -> DataFrame:
    """Word percentiles, estimated tokens, and the weight of a positive."""
    shares = (0.5, 0.9, 0.95, 0.99)
    q = percentiles(df, words, [], shares).drop("mean")
    out = df.agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate")).crossJoin(F.broadcast(q))  # one row each
    names = [f"p{round(p * 100)}" for p in shares]
    return out.select("n", "rate", *(F.floor(c).cast("bigint").alias(f"{c}_words") for c in names), *(F.floor(F.col(c) * TOKENS_PER_WORD).cast("bigint").alias(f"{c}_tokens") for c in names), ((1 - F.col("rate")) / F.col("rate")).alias("pos_weight"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) in seeded order: a top-n, not a full sort."""
    return df.orderBy(seeded(F.col(key), seed), key).limit(n)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, balanced, pos_weight``."""
    per = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("n0"), F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("n1"))
    return per.crossJoin(F.broadcast(total)).select("label", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("balanced"), (F.col("n0") / F.col("n1")).alias("pos_weight"))  # one row
