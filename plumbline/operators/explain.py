"""Occlusion: what each sentence adds to a text's margin, by leaving it out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.spans import let
from plumbline.functions.text import sentences

#: Sentences that get a variant, sentences shown, and the shortest sentence that counts.
CAP, TOP, SHORTEST = 12, 5, 12


def variant(text: Column, start: Column, end: Column) -> Column:
    """The text without a span: one blank at the seam, blanks squeezed."""
    cut = F.concat(F.substring(text, F.lit(1), start), F.lit(" "), F.substring(text, end + 1, F.length(text)))
    return F.trim(F.regexp_replace(cut, r"[ \t]+", " "))


def _shown(s: Column, delta: Column) -> Column:
    return F.struct((-F.abs(delta)).alias("order"), s["sent_no"].alias("sent_no"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), delta.alias("delta"))


def _scorable(text: Column, split: Callable[[Column], Column]) -> Column:
    """The numbered sentences of SHORTEST characters or more; null for a text of one sentence."""
    numbered = lambda parts: F.filter(F.transform(parts, lambda s, i: F.struct(i.alias("sent_no"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"))), lambda s: F.length(s["text"]) >= SHORTEST)
    return let(split(text), lambda parts: F.when(F.size(parts) >= 2, numbered(parts)))


def _after(parts: Column, cap: int) -> Column:
    return F.transform(F.slice(parts, F.lit(cap + 1), F.greatest(F.size(parts) - cap, F.lit(0))), lambda s: _shown(s, F.lit(0.0).cast("double")))


def evidence(text: Column, margin: Callable[[Column], Column], top: int = TOP, cap: int | None = CAP, split: Callable[[Column], Column] = sentences) -> Column:
    """``array<struct<order,sent_no,text,start,end,delta>>`` of the ``top`` sentences by effect, for a ``margin`` of Spark's own; see ``occlusion``. Without a ``cap`` all sentences are scored."""

    def of(x: Column) -> Column:
        """``x`` has the text, its sentences and its margin; whatever is asked for twice is bound, so that it is computed once."""
        delta = lambda s: F.round(x["base"] - let(variant(x["whole"], s["start"], s["end"]), margin), 4).cast("double")
        scored = lambda parts: F.transform(parts, lambda s: let(delta(s), lambda d: _shown(s, d)))
        found = scored(x["parts"]) if cap is None else F.concat(scored(F.slice(x["parts"], 1, cap)), _after(x["parts"], cap))
        return F.slice(F.array_sort(found), 1, top)

    return let(text, lambda whole: let(F.struct(whole.alias("whole"), _scorable(whole, split).alias("parts"), margin(whole).alias("base")), of))


def occlusion(df: DataFrame, key: str, text: str, margin: Callable[[Column], Column], top: int = TOP, cap: int = CAP, split: Callable[[Column], Column] = sentences, native: bool = True) -> DataFrame:
    """``key, sent_no, text, start, end, delta, polarity`` of the ``top`` sentences by effect.

    Texts of one sentence have no evidence, nor have sentences under SHORTEST characters. The first ``cap`` of the others are scored by leaving
    each out; those after them are neutral. ``margin`` maps a text column to a number. If it is ``native``, an expression of Spark's own,
    all happens inside the row's array; a Python scorer gets the variants as rows, in one pass, and their deltas are put together by key.
    """
    base = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("whole"))
    if native:
        found = base.select(key, evidence(F.col("whole"), margin, top, cap, split).alias("e"))
    else:
        base = base.withColumn("parts", _scorable(F.col("whole"), split)).where(F.size("parts") > 0).select(key, "whole", F.slice("parts", 1, cap).alias("parts"), _after(F.col("parts"), cap).alias("rest"))
        # A row for the whole text (null) and for each variant; only these carry a text.
        forms = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("n"), F.col("whole").alias("form"))), F.transform("parts", lambda s, n: F.struct(n.alias("n"), variant(F.col("whole"), s["start"], s["end"]).alias("form"))))
        rows = base.select(key, "parts", "rest", F.inline(forms))
        rows = rows.select(key, "n", margin(F.col("form")).cast("double").alias("m"), F.when(F.col("n").isNull(), F.col("parts")).alias("parts"), F.when(F.col("n").isNull(), F.col("rest")).alias("rest"))
        per = rows.groupBy(key).agg(F.max(F.when(F.col("n").isNull(), F.col("m"))).alias("base"), F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "m")))).alias("ms"), F.first("parts", True).alias("parts"), F.first("rest", True).alias("rest"))
        scored = F.zip_with("parts", "ms", lambda s, m: _shown(s, F.round(F.col("base") - m["m"], 4)))
        found = per.select(key, F.slice(F.array_sort(F.concat(scored, F.col("rest"))), 1, top).alias("e"))
    # Outer, and then filtered: else Spark would test the array's size first, and make it twice.
    return found.select(key, F.inline_outer("e")).where("sent_no IS NOT NULL").select(key, F.col("sent_no").cast("int"), "text", "start", "end", "delta", F.when(F.col("delta") > 0, "risk").otherwise("safe").alias("polarity"))


def top_terms(vocabulary: list[str], coefficients: list[float], spark, k: int = 20) -> DataFrame:
    """The ``k`` terms that raise a linear model's margin most."""
    rows = spark.createDataFrame(list(zip(vocabulary, map(float, coefficients))), "term string, weight double")
    return rows.where("weight > 0").orderBy(F.desc("weight"), "term").limit(k)
