"""From rule outcomes and a probability to a score, a label and a record per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.spans import scan
from plumbline.operators.fixed import FEATURES, MAX_SHIFT, WEIGHTS

#: Bands that hold until thresholds are fitted.
LOW, HIGH = 40, 70


def contributions(weights: dict[str, float] = WEIGHTS, order: tuple[str, ...] = FEATURES) -> Column:
    """``array<struct<feature_id,c>>`` of a wide row: severity times weight of what fired, in the fixed order."""
    return F.array_compact(F.array(*(F.when(F.col(f)["available"] & (F.col(f)["severity"] > 0), F.struct(F.lit(f).alias("feature_id"), (F.col(f)["severity"] * weights[f]).alias("c"))) for f in order)))


def contribution(wide: DataFrame, key: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``key, shift, contributions`` of each wide row: the sum of what fired, and a map of it; nothing is shuffled."""
    parts = contributions(weights)
    return wide.select(key, total(parts).alias("shift"), F.map_from_arrays(F.transform(parts, lambda p: p["feature_id"]), F.transform(parts, lambda p: p["c"])).alias("contributions"))


def total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["c"])


def clip_shift(shift: Column) -> Column:
    return F.least(F.greatest(shift, F.lit(-MAX_SHIFT)), F.lit(MAX_SHIFT))


def score(p_model: Column, shift: Column, advisory: bool = True) -> Column:
    """0 (risky) to 100, from the model's probability of risk and the rules' shift; halves go to the even number."""
    applied = F.lit(0.0) if advisory else F.least(F.greatest(shift, F.lit(0.0)), F.lit(MAX_SHIFT))
    fused = F.least(F.greatest(p_model + applied, F.lit(0.0)), F.lit(1.0))
    return F.bround((1 - fused) * 100, 0).cast("int")


def points(part: Column, advisory: bool = True) -> Column:
    return F.lit(0.0) if advisory else F.round(part * 100, 2)


def label(value: Column, low: int = LOW, high: int = HIGH) -> Column:
    """Band of an integer score; thresholds that aren't 0 <= low <= high <= 100 give way to the defaults."""
    if not 0 <= low <= high <= 100:
        low, high = LOW, HIGH
    return F.when(value < low, "high_risk").when(value >= high, "low_risk").otherwise("medium_risk")


def summary(band: Column, hits: Column) -> Column:
    """A sentence on the band and the rules that fired."""
    named = F.array_join(hits, "; ")
    return F.when(F.size(hits) == 0, F.format_string("Assessed as %s; no rule fired.", band)).otherwise(F.format_string("Assessed as %s: %s.", band, named))


def highlight(rule_spans: Column, sentence_spans: Column) -> Column:
    """Spans to show: rule spans by start (longer first), then sentence spans; what is empty or overlaps is left out.

    Three sweeps over sorted spans, each with one number in hand: rule spans against the last one kept, then from the right where the next rule span begins, then
    sentences against both sides.
    """
    kind = "struct<start:int,neg_end:int,kind:int,next:int,stays:boolean>"
    tagged = lambda spans, n: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), F.lit(n).alias("kind"), F.lit(2**31 - 1).alias("next"), F.lit(True).alias("stays")))
    ordered = lambda spans: F.array_sort(F.filter(spans, lambda s: -s["neg_end"] > s["start"]))
    marked = lambda s, **now: F.struct(*(now.get(c, s[c]).alias(c) for c in ("start", "neg_end", "kind", "next", "stays")))

    def fits(last: Column, s: Column) -> tuple[Column, Column]:
        ok = (s["kind"] == 0) & s["stays"] | (s["start"] >= last) & (-s["neg_end"] <= s["next"])
        return F.when(ok, F.greatest(last, -s["neg_end"])).otherwise(last), marked(s, stays=ok)

    def rule(last: Column, s: Column) -> tuple[Column, Column]:
        ok = s["start"] >= last
        return F.when(ok, -s["neg_end"]).otherwise(last), marked(s, stays=ok)

    def ahead(first: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["kind"] == 0, s["start"]).otherwise(first), marked(s, next=first)

    kept = lambda spans: F.filter(spans, lambda s: s["stays"])
    rules = kept(scan(ordered(tagged(rule_spans, 0)), F.lit(0), rule, kind))
    # From the right, rule spans come before sentences that begin at the same place, which they overlap.
    both = F.array_sort(F.concat(rules, ordered(tagged(sentence_spans, 1))), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["kind"] != b["kind"], b["kind"] - a["kind"]).otherwise(a["neg_end"] - b["neg_end"]))
    nexts = F.reverse(scan(F.reverse(both), F.lit(2**31 - 1), ahead, kind))
    shown = kept(scan(nexts, F.lit(0), fits, kind))
    return F.transform(shown, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["neg_end"]).alias("end")))


def score_documents(
    df: DataFrame, key: str, text: str, lexicon: DataFrame, scorer, settings=None, advisory: bool = True, thresholds: tuple[int, int] = (LOW, HIGH), wages: DataFrame | None = None, requested: str | None = None, patterns=None, minimum: str | None = None,
    margin=None, split=None, compose: bool = True,
) -> DataFrame:
    """One record per document: cleaning, gate, locale, mentions, rules, probability, score, band and summary, and what they rest on.

    ``scorer`` maps a text column to a probability column. With ``wages``, rules follow each text's locale: the ``requested`` column's if
    it is usable, else the detected one; without, ``minimum`` may name a column. Rejected texts keep their reason, aren't analysed and have no score. Texts are
    composed first (``compose``), and offsets are those of ``analysed``, the text as it was read.

    ``hits`` are the rules that fired, by contribution, ``unassessed`` those that couldn't be judged, ``evidence`` those of all sentences with most effect on ``margin`` (a column of a text column, of Spark's own; empty
    without one), ``spans`` the places of both to show. Everything happens on the row: dimensions are broadcast, and nothing is shuffled, so it runs alike on a stream.
    """
    from plumbline.functions import text as tx
    from plumbline.operators import explain
    from plumbline.operators.dims import detect_language, resolve_locale
    from plumbline.operators.extract import Patterns, extract_mentions
    from plumbline.operators.rules import SETTINGS, Settings, evaluate_rules, hits_of

    columns = [key, text, *([requested] if requested else [])] + ([F.col(minimum).alias("minimum")] if minimum else [])
    ready = df.select(*columns).withColumn("_reason", tx.reject_reason(F.col(text)))
    clean = tx.sanitize(ready.withColumn("_text", F.when(F.col("_reason").isNull(), F.col(text))), "_text", compose)
    clean = clean.withColumn("reject", F.coalesce("_reason", F.when(~F.col("analysable"), "not_analysable")))
    clean = clean.withColumn("sanitized", F.when(F.col("reject").isNull(), F.col("sanitized")).otherwise(""))
    if wages is not None:
        asked = F.col(requested) if requested else F.lit(None).cast("string")
        clean = clean.withColumn("locale", resolve_locale(asked, detect_language(F.col("sanitized")), list(SETTINGS), "en"))
        wide = evaluate_rules(extract_mentions(clean, "sanitized", patterns or Patterns()), key, "sanitized", lexicon, settings or SETTINGS, locale="locale", wages=wages)
    else:
        wide = evaluate_rules(extract_mentions(clean, "sanitized", patterns or Patterns()), key, "sanitized", lexicon, settings or Settings())
    parts = contributions()
    scored = F.col("reject").isNull()
    out = wide.withColumns({"p_model": F.when(scored, scorer(F.col("sanitized"))), "shift": F.when(scored, total(parts)), "fired": F.when(scored, F.transform(parts, lambda p: p["feature_id"]))})
    out = out.withColumn("score", F.when(scored, score(F.col("p_model"), F.col("shift"), advisory)))
    out = out.withColumn("band", F.when(F.col("score").isNotNull(), label(F.col("score"), *thresholds)))
    none = F.expr("cast(array() as array<struct<order:double,sent_no:int,text:string,start:int,end:int,delta:double>>)")
    shown = none if margin is None else F.coalesce(F.when(scored, explain.evidence(F.col("sanitized"), margin, cap=None, split=split or tx.sentences)), none)
    out = out.withColumns({"fired_rules": F.when(scored, hits_of(advisory)), "evidence": shown})
    places = lambda spans: F.transform(F.filter(spans, lambda s: s["start"].isNotNull()), lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    risky = F.filter("evidence", lambda s: s["delta"] != 0)
    out = out.withColumn("spans", F.when(scored, highlight(places(F.col("fired_rules")), places(risky))))
    unassessed = F.when(scored, F.array_compact(F.array(*(F.when(~F.col(f)["available"], F.lit(f)) for f in FEATURES))))
    held = ["emails", "urls", "phones", "title"] + (["locale"] if wages is not None else [])
    return out.select(
        key, "reject", "p_model", "shift", "fired", "score", "band", F.when(F.col("band").isNotNull(), summary(F.col("band"), F.col("fired"))).alias("summary"), *held,
        F.when(scored, F.col("sanitized")).alias("analysed"), F.col("fired_rules").alias("hits"), unassessed.alias("unassessed"), "evidence", "spans",
    )
