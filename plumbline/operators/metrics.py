"""Ranking metrics with exact treatment of ties, thresholds, calibration and ablation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.prefix import running_sums

#: Targets of the bands, bins of the calibration table, and the clip of probabilities.
PRECISION, RECALL, BINS, EPS = 0.85, 0.95, 10, 1e-7


def curve(df: DataFrame, score: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """``keys, threshold, pos, n, tp, flagged, total_pos, total, precision, recall``: one row per distinct score."""
    keys = keys or []
    ties = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    cum = running_sums(ties.withColumn("_all", F.lit(1)), [*keys, "_all"], "threshold", ["pos", "n"]).withColumnsRenamed({"cum_pos": "tp", "cum_n": "flagged"})
    totals = ties.groupBy(*keys).agg(F.sum("pos").alias("total_pos"), F.sum("n").alias("total"))
    out = cum.hint("merge").join(totals.hint("merge"), keys) if keys else cum.crossJoin(F.broadcast(totals))  # one row
    return out.drop("_all").withColumns({"precision": F.col("tp") / F.col("flagged"), "recall": F.try_divide(F.col("tp"), F.col("total_pos"))})


def ranking(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``average_precision, roc_auc, best_f1, best_threshold`` (0.5 without positives) from a curve."""
    keys = keys or []
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    neg, above = F.col("n") - F.col("pos"), (F.col("flagged") - F.col("n")) - (F.col("tp") - F.col("pos"))
    total_neg = F.col("total") - F.col("total_pos")
    # Each positive beats the negatives below it, and half of those it ties with.
    wins = F.col("pos") * (total_neg - above - neg + neg / 2)
    out = points.groupBy(*keys).agg(
        F.sum(F.col("pos") * F.col("precision")).alias("_ap"), F.sum(wins).alias("_wins"), F.max("total_pos").alias("_p"), F.max(total_neg).alias("_n"),
        F.max_by(F.struct(f1.alias("f1"), F.col("threshold").alias("t")), F.struct(f1, -F.col("threshold"))).alias("_best"),
    )
    return out.select(*keys, F.try_divide("_ap", "_p").alias("average_precision"), F.try_divide(F.col("_wins"), F.col("_p") * F.col("_n")).alias("roc_auc"), F.coalesce(F.col("_best")["f1"], F.lit(0.0)).alias("best_f1"), F.coalesce(F.col("_best")["t"], F.lit(0.5)).alias("best_threshold"))


def threshold_for_precision(points: DataFrame, target: float = PRECISION) -> DataFrame:
    """Lowest threshold with that precision, or null."""
    return points.agg(F.min(F.when(F.col("precision") >= target, F.col("threshold"))).alias("threshold"))


def threshold_for_recall(points: DataFrame, target: float = RECALL) -> DataFrame:
    """Highest threshold with that recall, or null."""
    return points.agg(F.max(F.when(F.col("recall") >= target, F.col("threshold"))).alias("threshold"))


def fit_bands(points: DataFrame, precision: float = PRECISION, recall: float = RECALL) -> DataFrame:
    """``t_high, t_low, high_below, low_from, problem``: score bounds of the bands for probabilities of risk."""
    out = threshold_for_precision(points, precision).withColumnRenamed("threshold", "t_high").crossJoin(threshold_for_recall(points, recall).withColumnRenamed("threshold", "t_low"))  # one row each
    bound = lambda t: F.bround((1 - F.col(t)) * 100, 0).cast("int")
    out = out.withColumns({"high_below": bound("t_high"), "low_from": bound("t_low")})
    return out.withColumn("problem", F.when(F.col("t_high").isNull() | F.col("t_low").isNull(), "target not reached").when(F.col("high_below") > F.col("low_from"), "bands inverted"))


def confusion(df: DataFrame, score: Column, y: Column, threshold: Column | float, keys: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall, F1 (0 where undefined), accuracy, the majority's accuracy and the Brier score."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    flag, pos = score >= t, y == 1
    p = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    out = df.groupBy(*(keys or [])).agg(F.count_if(flag & pos).alias("tp"), F.count_if(flag & ~pos).alias("fp"), F.count_if(~flag & pos).alias("fn"), F.count_if(~flag & ~pos).alias("tn"), F.avg(F.pow(p - y.cast("double"), F.lit(2.0))).alias("brier"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return out.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        "accuracy": ratio(F.col("tp") + F.col("tn"), n), "majority": ratio(F.greatest(F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")), n),
    })


def stats_at(df: DataFrame, score: Column, y: Column, threshold: float) -> DataFrame:
    """Counts, precision and recall at one threshold, in four decimals; a ratio without cases is 0."""
    out = confusion(df, score, y, threshold)
    ratio = lambda a, b: F.round(F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1)), 4)
    return out.select(F.lit(threshold).alias("threshold"), "tp", "fp", "fn", "tn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def evaluate_models(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ranking metrics of ``(model, score, y)``, best average precision first."""
    keys = keys or ["model"]
    return ranking(curve(long, "score", "y", keys), keys).orderBy(F.desc("average_precision"), *keys)


def top_errors(df: DataFrame, key: str, score: str, y: str, threshold: float, k: int = 10) -> DataFrame:
    """The ``k`` false positives of highest and the ``k`` false negatives of lowest score."""
    wrong = df.withColumn("kind", F.when((F.col(score) >= threshold) & (F.col(y) == 0), "fp").when((F.col(score) < threshold) & (F.col(y) == 1), "fn"))
    fp = wrong.where("kind = 'fp'").orderBy(F.desc(score), key).limit(k)
    fn = wrong.where("kind = 'fn'").orderBy(score, key).limit(k)
    return fp.union(fn).select("kind", key, score)


def percentiles(df: DataFrame, value: str, keys: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``keys, p50, p95, p99, mean`` (names follow ``shares``), exact and interpolated between neighbours; nulls are left out.

    Equal values are counted first, running counts are taken in quantile buckets, and each share asks for the two values around its
    place: no group's values meet in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_all", F.lit(1))
    named = {c: f"_k{i}" for i, c in enumerate(keys)}
    sums = running_sums(counts.withColumnsRenamed(named), [*named.values(), "_all"], "_v", ["_n"])
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean")).withColumnsRenamed(named)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in named.values()]
    held = sums.alias("l").hint("merge").join(totals.alias("r").hint("merge"), same).select("r.*", "_v", "_n", "cum__n") if keys else sums.crossJoin(F.broadcast(totals))  # one row
    first, last = F.col("_total") - F.col("cum__n"), F.col("_total") - F.col("cum__n") + F.col("_n") - 1  # ascending places of a value, from 0
    at = lambda p: F.lit(p) * (F.col("_total") - 1)
    around = lambda place: F.max(F.when((first <= place) & (place <= last), F.col("_v")))
    wanted = [f(F.floor(at(p)) if low else F.ceil(at(p))).alias(f"_{'lo' if low else 'hi'}{i}") for i, p in enumerate(shares) for low in (True, False) for f in (around,)]
    out = held.groupBy(*named.values()).agg(*wanted, F.max("_total").alias("_total"), F.max("mean").alias("mean"))
    mixed = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at(p) - F.floor(at(p)))).alias(f"p{round(p * 100)}") for i, p in enumerate(shares)]
    return out.select(*(F.col(v).alias(k) for k, v in named.items()), *mixed, "mean")


def calibration_bins(df: DataFrame, p: str, y: str, n: int = BINS) -> DataFrame:
    """``bin, lo, hi, count, mean_p, rate``: equal bins open below, 0 in the first; empty ones stay.

    A range join with the bins' own edges, whose list is broadcast, so no rounding moves a value.
    """
    edges = [i / n for i in range(n + 1)]
    bins = df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(n)], "bin int, lo double, hi double")
    fits = lambda i: (F.col(p) > edges[i]) & (F.col(p) <= edges[i + 1]) if i else (F.col(p) >= 0.0) & (F.col(p) <= edges[1])
    which = F.coalesce(*(F.when(fits(i), i) for i in range(n)))
    held = df.select(which.alias("bin"), F.col(p).alias("p"), F.col(y).cast("double").alias("y")).groupBy("bin").agg(F.count("*").alias("count"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    return bins.join(held, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def calibration_error(bins: DataFrame) -> DataFrame:
    """``ece, mce`` from a bin table."""
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return bins.agg((F.sum(F.coalesce(gap, F.lit(0.0)) * F.col("count")) / F.sum("count")).alias("ece"), F.coalesce(F.max(gap), F.lit(0.0)).alias("mce"))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y.cast("double"), F.lit(2.0)))


def to_margin(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.ln(clipped / (1 - clipped))


def platt_apply(margin: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(a * margin + b)))


def platt_fit(df: DataFrame, margin: str, y: str, steps: int = 100, tol: float = 1e-10) -> tuple[float, float]:
    """Unregularised logistic fit of one margin, ``(a, b)``: Newton steps of one aggregate each, halved while they don't lower the loss.

    Margins are centred and scaled first. Raises without both classes; where classes are apart, it stops after ``steps``.
    """
    m, t = F.col(margin).cast("double"), F.col(y).cast("double")
    rows = df.where(m.isNotNull() & t.isNotNull())
    n, positives, mean, spread = rows.agg(F.count("*"), F.sum(t), F.avg(m), F.stddev_pop(m)).first()
    if not n or positives in (0, n):
        raise ValueError("both classes are needed")
    scale = spread if spread and spread > 0 else 1.0
    x = (m - mean) / scale

    def at(a: float, b: float) -> tuple:
        z = a * x + b
        p = 1 / (1 + F.exp(-z))
        w = p * (1 - p)
        # ln(1 + e^z) - t z, so that large margins don't overflow.
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z
        return tuple(rows.agg(F.avg(loss), F.avg((p - t) * x), F.avg(p - t), F.avg(w * x * x), F.avg(w * x), F.avg(w)).first())

    share = positives / n
    a, b = 0.0, math.log(share / (1 - share))
    now = at(a, b)
    for _ in range(steps):
        loss, ga, gb, haa, hab, hbb = now
        if abs(ga) + abs(gb) < tol:
            break
        det = haa * hbb - hab * hab
        if det <= 1e-14 * max(haa * hbb, 1e-300):  # a flat direction: margins are constant, or classes far apart
            da, db = (0.0, gb / hbb) if hbb > 1e-12 else (ga, gb)
        else:
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = 1.0
        while True:
            now = at(a - step * da, b - step * db)
            if now[0] <= loss or step < 1e-6:
                break
            step /= 2
        if now[0] > loss:
            break
        a, b = a - step * da, b - step * db
    return a / scale, b - a * mean / scale


def bands(df: DataFrame, p: str, y: str, t_high: float, t_low: float) -> DataFrame:
    """``band, n, positives`` of the three bands, by probability; empty ones stay."""
    band = F.when(F.col(p) >= t_high, "high_risk").when(F.col(p) < t_low, "low_risk").otherwise("medium_risk")
    held = df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("positives"))
    names = df.sparkSession.createDataFrame([("high_risk",), ("medium_risk",), ("low_risk",)], "band string")
    return names.join(held, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positives", F.lit(0)).alias("positives"))


def ablation(df: DataFrame, y: str, scores: list[str]) -> DataFrame:
    """The same metrics for several score columns of one table, in one pass."""
    rows = F.array(*(F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in scores))
    return evaluate_models(df.select(F.inline(rows), F.col(y).alias("y")))


def rule_behaviour(outcomes: DataFrame, labels: DataFrame, key: str, y: str) -> DataFrame:
    """``feature_id, fired, fired_pos, precision`` of each rule alone; rules that never fire have a row, too."""
    held = outcomes.select(key, "feature_id", (F.col("available") & (F.col("severity") > 0)).alias("hit")).hint("merge").join(labels.select(key, F.col(y).alias("y")).hint("merge"), key)
    per = held.groupBy("feature_id").agg(F.count_if("hit").alias("fired"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("y").cast("bigint"))), F.lit(0)).alias("fired_pos"))
    return per.withColumn("precision", F.try_divide(F.col("fired_pos"), F.col("fired")))


def class_behaviour(rows: DataFrame, labels: DataFrame, key: str, y: str) -> DataFrame:
    """``y, n, mean_fired, any_fired, mean_shift`` by class, from ``rows(key, n_fired, shift)``."""
    held = rows.select(key, "n_fired", "shift").hint("merge").join(labels.select(key, F.col(y).alias("y")).hint("merge"), key)
    return held.groupBy("y").agg(F.count("*").alias("n"), F.avg(F.col("n_fired").cast("double")).alias("mean_fired"), F.count_if(F.col("n_fired") > 0).alias("any_fired"), F.avg("shift").alias("mean_shift"))


def learnability(outcomes: DataFrame, labels: DataFrame, key: str, y: str) -> DataFrame:
    """Verdict per feature: absent, constant, unsafe (availability differs by class) or derivable."""
    held = outcomes.hint("merge").join(labels.select(key, F.col(y).alias("y")).hint("merge"), key)
    fired = (F.col("available") & (F.col("severity") > 0)).cast("double")
    per = held.groupBy("feature_id").agg(F.avg(fired).alias("fire_rate"), F.avg(F.when(F.col("y") == 1, F.col("available").cast("double"))).alias("a1"), F.avg(F.when(F.col("y") == 0, F.col("available").cast("double"))).alias("a0"))
    gap = F.abs(F.coalesce(F.col("a1") - F.col("a0"), F.lit(0.0)))
    return per.select("feature_id", "fire_rate", gap.alias("gap"), F.when(F.col("fire_rate") < 0.05, "absent").when(F.col("fire_rate") > 0.95, "constant").when(gap > 0.03, "unsafe").otherwise("derivable").alias("verdict"))


def deltas(metrics: DataFrame, baseline: str) -> DataFrame:
    """Each model's average precision against the baseline's."""
    base = metrics.where(F.col("model") == baseline).select(F.col("average_precision").alias("base"))
    return metrics.crossJoin(F.broadcast(base.limit(1))).select("model", (F.col("average_precision") - F.col("base")).alias("delta"))  # one row


def rank_in(df: DataFrame, key: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(*order))


def confound(df: DataFrame, length: str, y: str, limit: float = 0.10) -> DataFrame:
    """How far length alone ranks above chance; sound while that is under the limit."""
    points = curve(df, length, y)
    base = points.agg((F.max("total_pos") / F.max("total")).alias("base"))
    out = ranking(points).crossJoin(F.broadcast(base)).withColumn("excess", F.col("average_precision") - F.col("base"))  # one row each
    return out.select("excess", (F.col("excess") < limit).alias("sound"))


def at_half(long: DataFrame) -> DataFrame:
    """Counts at 0.5 for each model; null where scores are constant or only one class is there."""
    bounds = long.groupBy("model").agg(((F.max("score") == F.min("score")) | (F.max("y") == F.min("y"))).alias("flat"))
    out = confusion(long, F.col("score"), F.col("y"), 0.5, ["model"]).join(bounds, "model")
    return out.select("model", *(F.when(~F.col("flat"), F.col(c)).alias(c) for c in ("tp", "fp", "fn", "tn", "precision", "recall", "f1")))


def calibration_report(df: DataFrame, p: str, y: str, gate: float = 0.05) -> DataFrame:
    """Brier score and calibration error before and after a Platt fit; passed if the error is small and no worse."""
    rows = df.select(F.col(p).alias("raw"), F.col(y).alias("y"), to_margin(F.col(p)).alias("m"))
    a, b = platt_fit(rows, "m", "y")
    parts = []
    for stage, c in (("before", F.col("raw")), ("after", platt_apply(F.col("m"), a, b))):
        held = rows.select(c.alias("p"), "y")
        parts.append(calibration_error(calibration_bins(held, "p", "y")).crossJoin(F.broadcast(held.agg(brier(F.col("p"), F.col("y")).alias("brier")))).withColumn("stage", F.lit(stage)))  # one row each
    both = parts[0].unionByName(parts[1])
    before = F.max(F.when(F.col("stage") == "before", F.col("ece"))).over(Window.partitionBy(F.lit("all")))  # two rows
    return both.withColumn("passed", (F.col("ece") <= gate) & (F.col("ece") <= before))


def recalibrated(df: DataFrame, margin: str, y: str, a: float, b: float) -> DataFrame:
    """Mean and range of probabilities under given parameters and under ones refitted on this data."""
    a2, b2 = platt_fit(df, margin, y)
    rows = F.array(*(F.struct(F.lit(n).alias("fit"), platt_apply(F.col(margin), x, z).alias("p")) for n, x, z in (("given", a, b), ("refit", a2, b2))))
    return df.select(F.inline(rows)).groupBy("fit").agg(F.avg("p").alias("mean_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p"))


def evaluated_once(ledger: DataFrame, checksum: str, force: bool = False) -> None:
    """Raises if a test split with this checksum is in the ledger already."""
    if not force and not ledger.where(F.col("split_checksum") == checksum).isEmpty():
        raise ValueError("this test split was evaluated before")


def refused(splits: DataFrame, ledger: DataFrame) -> DataFrame:
    """``split, refused`` of ``splits(split, checksum)``: whether the ledger holds an evaluation of just these rows."""
    known = ledger.select(F.col("split_checksum").alias("checksum"), F.lit(True).alias("_known")).distinct()
    return splits.join(known.hint("merge"), "checksum", "left").select("split", F.coalesce("_known", F.lit(False)).alias("refused"))
