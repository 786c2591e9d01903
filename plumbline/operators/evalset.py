"""Evaluation data: row checks, duplicates, agreement of raters, and the queue of appeals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import sanitize, text_key

MIN_TEXT, COMMENT_CHARS, CONTACT_CHARS = 30, 2000, 200
TARGET_GAP = 0.15
#: Columns that only appeals have.
APPEAL_COLUMNS = frozenset({"report_id", "correction", "reported_label", "reported_score", "reviewed", "review_note"})


def row_problems(id_: Column, text: Column, label: Column, source: Column, provenance: Column, sources: list[str]) -> Column:
    """What is wrong with one item, as an array."""
    checks = [
        F.when(id_.isNull(), "no id"), F.when(text.isNull() | (F.length(text) < MIN_TEXT), "text too short"), F.when(label.isNull() | ~label.isin(0, 1), "bad label"),
        F.when(source.isNull() | ~source.isin(sources), "unknown source"), F.when(provenance.isNull(), "no provenance"),
    ]
    return F.array_compact(F.array(*checks))


def resolver_problem(label_a: Column, label_b: Column, resolved_by: Column) -> Column:
    return F.when((label_a != label_b) & resolved_by.isNull(), "disagreement without a resolver")


def synthetic_problem(id_: Column, synthetic: Column) -> Column:
    return F.when(F.startswith(id_, F.lit("SYNTHETIC-")) != F.coalesce(synthetic, F.lit(False)), "id and flag disagree")


def unknown_fields(line: Column, known: list[str]) -> Column:
    """Fields of a JSON line that the schema doesn't have."""
    return F.array_sort(F.array_except(F.json_object_keys(line), F.array(*map(F.lit, known))))


def repeated_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """Second and later rows of an id."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n > 1").drop("_n")


def duplicate_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, first_id`` of rows whose text, but for case and white space, an earlier id has.

    The first id of a text is a map-side minimum joined back by hash, so a text that very many rows share isn't gathered.
    """
    hashed = df.select(key, F.sha2(text_key(F.col(text)), 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min(key).alias("first_id"))
    return hashed.hint("merge").join(first.hint("merge"), "h").where(F.col(key) > F.col("first_id")).select(key, "first_id")


def taint(df: DataFrame, synthetic: str) -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(synthetic), F.lit(False)).alias("blocked"))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """``n, agreement, kappa`` of two raters; kappa is null without rows or where chance alone agrees fully."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = F.col(a) == 1, F.col(b) == 1
    out = rows.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"), F.avg(x.cast("double")).alias("pa"), F.avg(y.cast("double")).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return out.select("n", "agreement", F.when(chance < 1, (F.col("agreement") - chance) / (1 - chance)).alias("kappa"))


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, value, n``: several histograms from one pass over the rows."""
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(rows)).groupBy("field", "value").agg(F.count("*").alias("n"))


def advice(df: DataFrame, label: str, rows: int, rate: float) -> DataFrame:
    """Size and balance against their targets; advice, not errors."""
    out = df.agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
    return out.withColumn("advice", F.array_compact(F.array(F.when(F.col("n") < rows, "too few items"), F.when(F.abs(F.col("rate") - rate) > TARGET_GAP, "unbalanced"))))


def validate_eval_set(
    df: DataFrame, key: str, text: str, label: str, required: list[str], vocabularies: dict[str, list[str]], rows: int, rate: float, gap: float = TARGET_GAP
) -> DataFrame:
    """``level, problem, item, n``: all that is wrong with an evaluation set (``error``) and what it still needs (``advice``), one row each.

    Errors: a required field without a value, an id that several rows have (``n`` of them), a label other than 0 and 1. Advice: short texts, texts that an
    item with a smaller id has but for case and white space, values outside a field's vocabulary (nulls are no values), fewer than ``rows`` items (``n``
    are lacking), a share of positives that is farther than ``gap`` from ``rate``. Items without an id are named by null. Rows are looked at once for all that
    they show by themselves; ids and texts are counted map-side.
    """
    one = lambda level, problem, when: F.when(when, F.struct(F.lit(level).alias("level"), problem.alias("problem")))
    y, body = F.col(label), F.coalesce(F.col(text), F.lit(""))
    checks = [one("error", F.lit(f"missing required field {f}"), F.col(f).isNull()) for f in required]
    checks += [one("error", F.lit("label is not 0 or 1"), y.isNull() | ~y.isin(0, 1)), one("advice", F.lit("text too short"), F.length(F.trim(body)) < MIN_TEXT)]
    checks += [one("advice", F.concat(F.lit(f"{f} outside its vocabulary: "), F.col(f).cast("string")), F.col(f).isNotNull() & ~F.col(f).isin(*words)) for f, words in vocabularies.items()]
    item = F.col(key).cast("string").alias("item")
    out = df.select(item, F.inline(F.array_compact(F.array(*checks)))).select("level", "problem", "item", F.lit(1).cast("bigint").alias("n"))
    repeated = df.groupBy(item).agg(F.count("*").alias("n")).where("item IS NOT NULL AND n > 1")
    copies = duplicate_texts(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias(text)), key, text)
    whole = df.agg(F.count("*").alias("n"), F.count_if(y == 1).alias("positive"))
    lacking = whole.where(F.col("n") < rows).select(F.lit("advice"), F.lit("more items are needed"), F.lit(None).cast("string"), rows - F.col("n"))
    uneven = whole.where((F.col("n") > 0) & (F.abs(F.try_divide("positive", "n") - rate) > gap)).select(F.lit("advice"), F.lit("share of positives is far from its target"), F.lit(None).cast("string"), F.col("positive"))
    for more in (repeated.select(F.lit("error"), F.lit("repeated id"), "item", "n"), copies.select(F.lit("advice"), F.concat(F.lit("text of "), F.col("first_id").cast("string")), item, F.lit(1).cast("bigint")), lacking, uneven):
        out = out.union(more)
    return out


def passes(problems: DataFrame, lenient: bool = False) -> bool:
    """Whether a validated set may be used: without errors, or in any case if ``lenient``."""
    return lenient or problems.where("level = 'error'").isEmpty()


def annotation_report(df: DataFrame, label: str, a: str, b: str, synthetic: str, histograms_of: list[str]) -> DataFrame:
    """One row: items, positives, negatives and their share, items that two raters judged and where they differ, kappa, and a map of counts for each of ``histograms_of``.

    One pass: grouping sets give the whole and each histogram. Synthetic items count as items, but not for the raters' agreement; kappa is null where it is undefined. Values of null are counted as ``null``.
    """
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(f"_h{i}") for i, c in enumerate(histograms_of)]
    made = F.coalesce(F.col(synthetic), F.lit(False))
    both = ~made & F.col(a).isNotNull() & F.col(b).isNotNull()
    rows = df.select(F.col(label).alias("_y"), both.alias("_both"), F.col(a).alias("_a"), F.col(b).alias("_b"), made.alias("_made"), *fields)
    names = [f"_h{i}" for i in range(len(histograms_of))]
    sums = [F.count("*").alias("n"), F.count_if(F.col("_y") == 1).alias("positive"), F.count_if(F.col("_y") == 0).alias("negative"), F.count_if("_both").alias("twice"), F.bool_or("_made").alias("made")]
    sums += [F.count_if(F.col("_both") & cond).alias(n) for n, cond in (("same", F.col("_a") == F.col("_b")), ("a1", F.col("_a") == 1), ("b1", F.col("_b") == 1))]
    sets = rows.groupingSets([[], *([n] for n in names)], *names).agg(F.grouping_id().alias("set"), *sums)
    alone = [(1 << len(names)) - 1 - (1 << (len(names) - 1 - i)) for i in range(len(names))]
    whole = lambda c: F.coalesce(F.max(F.when(F.col("set") == (1 << len(names)) - 1, F.col(c))), F.lit(0))
    maps = [F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("set") == bit, F.struct(F.col(n).alias("value"), F.col("n").alias("n")))))).alias(c) for n, bit, c in zip(names, alone, histograms_of)]
    out = sets.agg(F.coalesce(F.max(F.when(F.col("set") == (1 << len(names)) - 1, F.col("made"))), F.lit(False)).alias("is_synthetic"), *(whole(c).alias(c) for c in ("n", "positive", "negative", "twice", "same", "a1", "b1")), *maps)
    share = lambda c: F.try_divide(F.col(c), F.col("twice"))
    pa, pb = share("a1"), share("b1")
    chance, seen = pa * pb + (1 - pa) * (1 - pb), share("same")
    kappa = F.when((F.col("twice") > 0) & (chance < 1), F.try_divide(seen - chance, 1 - chance))
    return out.select("is_synthetic", F.col("n").alias("n_items"), F.col("positive").alias("n_positive"), F.col("negative").alias("n_negative"), F.coalesce(F.try_divide("positive", "n"), F.lit(0.0)).alias("rate"), F.col("twice").alias("n_double"), (F.col("twice") - F.col("same")).alias("n_disagreements"), kappa.alias("kappa"), *histograms_of)


def next_ids(new: DataFrame, order: str, existing: DataFrame, key: str, prefix: str) -> DataFrame:
    """Adds sequential ids after the largest one, in the order of ``order``, then of its hash; ranks come from parts of bounded size."""
    top = existing.agg(F.coalesce(F.max(F.regexp_extract(key, r"(\d+)$", 1).try_cast("int")), F.lit(0)).alias("top"))
    counts = new.groupBy(F.col(order).alias("_o")).agg(F.count("*").alias("_n"))
    codes = counts.select(F.substring(F.hex(F.col("_o").cast("string").cast("binary")), 1, 4).alias("_b"), "_n").groupBy("_b").agg(F.sum("_n").alias("_n"))
    before = codes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per two leading bytes
    parted = new.withColumn("_b", F.substring(F.hex(F.col(order).cast("string").cast("binary")), 1, 4))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(F.col(order).cast("string").cast("binary")))
    numbered = parted.withColumn("_own", own).alias("l").join(F.broadcast(before).alias("r"), F.col("l._b").eqNullSafe(F.col("r._b"))).crossJoin(F.broadcast(top))  # 65,536 rows at most, and one
    return numbered.select("l.*", F.concat(F.lit(prefix), F.lpad((F.col("_own") + F.col("_before") + F.col("top")).cast("string"), 4, "0")).alias(key)).drop("_b", "_own")


def appeals(df: DataFrame, text: str, comment: str, contact: str, version: str) -> DataFrame:
    """Sanitised, cut to size and stamped; not reviewed, and keyed by content so that a replay adds nothing new."""
    clean = sanitize(df, text).withColumn(text, F.col("sanitized")).drop("sanitized", "removed", "runs", "meaningful", "analysable")
    cut = clean.withColumns({comment: F.substring(comment, 1, COMMENT_CHARS), contact: F.nullif(F.trim(F.substring(contact, 1, CONTACT_CHARS)), F.lit(""))})
    return cut.withColumns({"report_id": F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cut.columns)), 256), "reviewed": F.lit(False), "model_version": F.lit(version)})


def review_queue(df: DataFrame, correction: str, reviewed: Column | None = None) -> DataFrame:
    """``correction, n, unreviewed``."""
    open_ = F.lit(True) if reviewed is None else ~F.coalesce(reviewed, F.lit(False))
    return df.groupBy(F.coalesce(correction, F.lit("unknown")).alias("correction")).agg(F.count("*").alias("n"), F.count_if(open_).alias("unreviewed"))


def not_for_training(df: DataFrame) -> DataFrame:
    """The frame itself, unless it holds appeals: these are reports about the model and must never teach it. Raises before any job."""
    if held := sorted(APPEAL_COLUMNS & set(df.columns)):
        raise ValueError(f"appeals never train a model: {held}")
    return df
