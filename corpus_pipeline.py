"""From raw documents to packed sequences: quality, near-duplicates, secrets, mixing, packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import mixing, packing, quality, secrets, simhash
from plumbline.llm.common import session, written
from plumbline.sources.readers import spread

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones that aren't held out.

    Null and empty texts are scored as empty ones; ids may be null or repeat (such rows are no labelled ones); an empty table stays empty.
    """
    model = quality.fit(docs, session(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(*COLUMNS).where(quality.score(model, F.col("text"), spark) >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (0.8 of their five-word shingles or more): the one with the smallest id.

    Rows without an id are linked like others, and one of them stays where its group has no id. Rows are told apart by id and text;
    of rows that repeat both one stays.
    """
    docs = docs.select(*COLUMNS)
    first = written(simhash.similar_groups(session_docs(spark, docs)).where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "kept")
    keyed = docs.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))

    def of(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("id"), "text_hash").hint("merge")
        return keyed.hint("merge").join(keys, (F.col("hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    kept = of(first.where("n = 1")).select(*COLUMNS)
    repeated = first.where("n > 1")
    return kept if repeated.isEmpty() else kept.unionByName(of(repeated).dropDuplicates(["doc_id", "hash"]).select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span replaced by a mark, and their new length.

    A null text stays null and keeps its ``n_chars``; other columns are as they were, null or not.
    """
    docs = session_docs(spark, docs).withColumn("had", F.col("text").isNotNull())
    clean = secrets.secret_spans(docs, redacted=True, keep=("lang", "source", "n_chars", "had"))
    clean = clean.select("doc_id", F.when(F.col("had"), F.col("text")).alias("text"), "lang", "source", "n_chars")
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null sources are one source, the last; null and empty texts have size 0 and are taken at their source's rate.
    """
    mixed = mixing.mix(session_docs(spark, docs), keep=("text", "lang", "n_chars")).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' tokens; a null text is the end mark alone, and ids may be null."""
    return packing.pack(session_docs(spark, docs))


def session_docs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    session(spark)
    return docs


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mix", mix_sources), ("pack", pack_documents)]
#: Not expressible in SQL: a fitted model, shingle sets and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's result is written and read again by the next."""
    docs = spread(session(spark).read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
