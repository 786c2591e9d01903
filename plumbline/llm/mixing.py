"""Mixing sources to target weights by systematic sampling of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, written

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one rank window takes, on average, if a single group held them all.
GROUP_ROWS = 200_000


def unit_hash(value: Column) -> Column:
    """A number from 0 to 2**32 - 1, from the MD5 of a string."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``(source, source_size)``.

    Sources take the weights in turn, by code point with null last, and share the sum of all sizes in proportion.
    A target stops at ``cap`` times its source's size, and what is over is shared anew by weight among the others,
    until none is above. Each round is one aggregate over the sources; only its sums reach the driver.
    """
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = sources.withColumn("weight", turn.cast("double"))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("source_size") * cap
        row = table.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size") * cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (total - float(row[1] or 0)) / row[2]
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(float(cap))))


def mix(documents: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, source_size, target, copies`` and ``keep``.

    Systematic sampling: within its source a document's expected number of copies is target / source size. The
    prefix sum of these, plus one random offset of the source, crosses an integer boundary once for each copy. The
    order within a source is by size class first, so that the words taken come near the target whatever the sizes.

    A source, an id and a group of equal rows may hold any share of the rows: rows are dealt to (source, size class, salt), and
    within these counted by (size, id, lot), a row of a written table each where they differ, and lots of equal rows where they don't.
    Windows run over these counts, in groups of bounded size, and then over the rows of one lot. The number of salts and lots follows the
    number of rows. The offset and salts are MD5 hashes of the seed, source and id, so reruns agree but for which of equal rows is taken.
    Null texts and those without words have size 0 and take part; null sources form one source, the last; repeated rows and
    ids are documents of their own; an empty table gives an empty result. Columns of other names are not read.
    """
    sized = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    sized = written(sized.withColumn("lot", F.monotonically_increasing_id()), "sized")
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    salts = max(64, -(-rows // GROUP_ROWS))
    goals = written(targets(totals.select("source", "source_size"), list(weights), cap), "targets")
    discard(totals)
    # Size classes: four to a doubling, so sizes in a class differ by a fifth at most.
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    grouped = sized.withColumns({
        "class": F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 4)).otherwise(F.lit(-1)).cast("long"), "salt": F.pmod(unit_hash(id_key), F.lit(salts)), "lot": F.pmod(F.xxhash64("lot"), F.lit(salts)),
        "source_key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), "id_key": F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")),
    })
    lots = grouped.groupBy("source_key", "class", "salt", "size", "id_key", "lot").agg(F.count("*").alias("n"), F.min("doc_id").alias("id"))
    inside = Window.partitionBy("source_key", "class", "salt").orderBy("size", "id", "lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.select("source_key", "class", "salt", "size", "id_key", "lot", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("within"))
    counts = grouped.groupBy("source_key", "class", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_key").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.pmod(unit_hash(F.concat(F.lit(f"{seed}:"), F.col("source_key"))), F.lit(65536)) / F.lit(65536.0)
    goals = goals.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("source_key"), "source_size", "target")
    counts = counts.select("source_key", "class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), offset.alias("offset")).hint("merge").join(goals.hint("merge"), "source_key")
    lots = lots.hint("merge").join(counts.hint("merge"), ["source_key", "class", "salt"])
    key = ["source_key", "class", "salt", "size", "id_key", "lot"]
    ranked = grouped.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))).hint("merge").join(lots.hint("merge"), key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = lambda k: F.floor(rate * k.cast("double") + F.col("offset"))
    k = F.col("before") + F.col("within") + F.col("rank")
    copies = F.least(crossed(k) - crossed(k - 1), F.ceil(F.lit(float(cap)))).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *(F.col(f"kept_{c}").alias(c) for c in keep))


def mix_digest(documents: DataFrame) -> DataFrame:
    mixed = mix(documents)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in DuckDB; only the recursion that shares the excess anew is spelled differently, by sorted caps.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
classed AS (
  SELECT *, CASE WHEN size > 0 THEN floor(log2(size::DOUBLE) * 4)::BIGINT ELSE -1 END AS class,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
           % greatest(64, (SELECT ((count(*) + 199999) // 200000)::BIGINT FROM documents)) AS salt
  FROM sized),
sources AS (
  SELECT source_key, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         (SELECT sum(size) FROM sized)::DOUBLE AS total
  FROM sources),
shared AS (
  SELECT *, source_size * 3.0::DOUBLE / weight AS fill,
         (total - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY source_size / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source_key, source_size, least(weight * (SELECT max(level) FROM shared WHERE level <= fill), source_size * 3.0::DOUBLE) AS target,
         ('0x' || substr(md5('42:' || source_key), 1, 8))::BIGINT % 65536 / 65536.0::DOUBLE AS off
  FROM shared),
ranked AS (
  SELECT doc_id, size, source_key, row_number() OVER (PARTITION BY source_key ORDER BY class, salt, size, doc_id)::DOUBLE AS k FROM classed)
SELECT doc_id, size, source_size, target,
       (size * least(floor((CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END) * k + off) - floor((CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END) * (k - 1) + off), 3))::BIGINT AS taken
FROM ranked JOIN goals USING (source_key)
"""
