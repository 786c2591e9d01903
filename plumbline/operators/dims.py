"""Dimension tables (markers, lexicon, wages, host classes, weights) and what looks them up on each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.spans import let
from plumbline.operators.fixed import FEATURES, LOCALES, MAX_SHIFT, MAX_WEIGHT, WEIGHTS

#: A dimension with more rows than this isn't broadcast; lookups that test each of its rows on each text then refuse it.
MAX_ROWS = 5_000

#: Small seeds with the shapes that the operators take. Real ones are inputs: ``sources.dimensions`` reads them.
MARKERS = {
    "en": (" the ", " and ", " with ", " this ", " that ", " for ", " was ", " of the "),
    "fr": (" le ", " les ", " des ", " une ", " pour ", " avec ", " dans ", " est "),
    "de": (" der ", " die ", " und ", " das ", " mit ", " nicht ", " auf ", " den "),
    "es": (" el ", " los ", " que ", " una ", " para ", " con ", " por ", " del "),
}
LEXICON = [
    ("en", "license", 1.0, "apache license", 0.4), ("en", "license", 1.0, "mit license", 0.3), ("en", "license", 1.0, "general public license", 0.5), ("en", "license", 1.0, "cc by", 0.6),
    ("en", "abuse", 1.2, "idiot", 0.5), ("en", "abuse", 1.2, "moron", 0.6), ("en", "abuse", 1.2, "worthless", 0.3), ("en", "abuse", 1.2, "clown", 0.2),
    ("en", "payment", 1.0, "registration fee", 0.8), ("en", "payment", 1.0, "token", 0.4), ("en", "payment", 1.0, "password", 0.7),
]
HOST_CLASSES = [("example.com", "free"), ("example.org", "disposable"), ("example.net", "shortener")]


def markers(spark: SparkSession, table: dict[str, tuple[str, ...]] = MARKERS) -> DataFrame:
    return spark.createDataFrame([(lang, m) for lang, ms in table.items() for m in ms], "lang string, marker string")


def lexicon(spark: SparkSession, rows: list = LEXICON) -> DataFrame:
    """``locale, grp, phrase, weight``: phrases in lower case, weights times their group's multiplier, 1 at most."""
    return weighed(spark.createDataFrame(rows, "locale string, grp string, multiplier double, phrase string, weight double"))


def weighed(raw: DataFrame) -> DataFrame:
    """A lexicon from ``locale, grp, multiplier, phrase, weight``; empty phrases are left out."""
    return raw.select("locale", "grp", F.lower(F.trim("phrase")).alias("phrase"), F.least(F.col("weight") * F.col("multiplier"), F.lit(1.0)).alias("weight")).where("phrase <> ''")


def host_classes(spark: SparkSession, rows: list = HOST_CLASSES) -> DataFrame:
    return spark.createDataFrame(rows, "host string, class string")


def small(dim: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """A dimension, marked for broadcast after its size is checked."""
    if dim.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: too large for a lookup that compares every row with every text")
    return F.broadcast(dim)


def beside(df: DataFrame, dim: DataFrame, name: str) -> DataFrame:
    """Adds all rows of a small dimension as one array to each row: a broadcast of one row, no shuffle. An empty one is an empty array."""
    held = small(dim).agg(F.collect_list(F.struct(*dim.columns)).alias(name))
    return df.crossJoin(F.broadcast(held))


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def detect_language(text: Column, table: dict[str, tuple[str, ...]] | None = None, fallback: str = "en") -> Column:
    """The language most of whose distinct markers the text holds, in lower case between two blanks; on a tie the fallback."""
    table = table or {code: known["markers"] for code, known in LOCALES.items()}
    if len(table) == 1:
        return F.lit(next(iter(table)))
    counts = let(padded(text), lambda low: F.array(*(F.size(F.filter(F.array(*map(F.lit, ms)), lambda m: F.contains(low, m))) for ms in table.values())))
    most = lambda votes: F.filter(F.transform(votes, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: x["v"] == F.array_max(votes))
    first = let(counts, most)
    return let(first, lambda top: F.when(F.size(top) == 1, F.get(F.array(*map(F.lit, table)), F.get(top, F.lit(0))["i"])).otherwise(F.lit(fallback)))


def resolve_locale(requested: Column, detected: Column, usable: list[str], fallback: str) -> Column:
    """The requested locale if it is usable, else the detected one if that is, else the fallback."""
    return F.coalesce(F.when(requested.isin(usable), requested), F.when(detected.isin(usable), detected), F.lit(fallback))


def capabilities(markers: DataFrame, lexicon: DataFrame, wages: DataFrame) -> DataFrame:
    """Locales, whether each is usable (has a lexicon), and which resources it lacks."""
    held = [t.select(F.col(c).alias("locale"), F.lit(kind).alias("kind")).distinct() for t, c, kind in ((markers, "lang", "markers"), (lexicon, "locale", "lexicon"), (wages, "locale", "wages"))]
    kinds = reduce(DataFrame.unionByName, held).groupBy("locale").agg(F.collect_set("kind").alias("kinds"))
    lacking = F.array_sort(F.array_except(F.array(F.lit("lexicon"), F.lit("markers"), F.lit("wages")), F.col("kinds")))
    return kinds.select("locale", F.array_contains("kinds", "lexicon").alias("usable"), lacking.alias("missing"))


def held_word(low: Column, word: Column) -> Column:
    """True where the text holds the word as a whole; containment is tested before the boundary pattern."""
    return F.contains(low, word) & F.regexp_like(low, F.concat(F.lit(r"(?U)\b\Q"), word, F.lit(r"\E\b")))


def lookup(df: DataFrame, key: str, text: str, names: DataFrame, locale: Column | None = None) -> DataFrame:
    """``key, name, amount`` of each row: the first kind, then longest name, that the text holds as a word, else the fallback, else null.

    ``names(name, amount, fallback)`` may have ``kind`` (1 before 2: aliases before regions) and ``locale``, which must be the row's own. It is
    small, and one broadcast row of arrays; there is no shuffle. Names without an amount are passed over.
    """
    extra = {"kind": F.lit(1), "locale": F.lit(None).cast("string")}
    names = names.select(F.lower("name").alias("name"), "amount", F.coalesce("fallback", F.lit(False)).alias("fallback"), *(F.col(c) if c in names.columns else v.alias(c) for c, v in extra.items()))
    rows = df.select(F.col(key).alias("_key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"), (F.lit(None).cast("string") if locale is None else locale).alias("_locale"))
    rows = beside(rows, names, "_names")
    mine = lambda n: n["locale"].isNull() | n["locale"].eqNullSafe(F.col("_locale"))
    hits = let(F.col("_low"), lambda low: F.filter("_names", lambda n: ~n["fallback"] & n["amount"].isNotNull() & mine(n) & held_word(low, n["name"])))
    best = F.array_min(F.transform(hits, lambda n: F.struct(n["kind"].alias("kind"), (-F.length(n["name"])).alias("size"), n["name"].alias("name"), n["amount"].alias("amount"))))
    rest = F.get(F.filter("_names", lambda n: n["fallback"] & mine(n)), F.lit(0))
    return rows.select(F.col("_key").alias(key), F.coalesce(best["name"], rest["name"]).alias("name"), F.coalesce(best["amount"], rest["amount"]).alias("amount"))


def minimum_wage(df: DataFrame, text: str, wages: DataFrame, locale: str = "locale") -> DataFrame:
    """Adds ``minimum`` and ``region``: the row's wage by ``wages(locale, name, amount, fallback, kind)``; null for a locale without wages."""
    rows = beside(df, wages.select(F.col("locale").alias("locale"), F.lower("name").alias("name"), F.col("amount").cast("bigint").alias("amount"), F.coalesce("fallback", F.lit(False)).alias("fallback"), "kind"), "_wages")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    mine = F.filter("_wages", lambda n: n["locale"] == F.col(locale))
    hits = let(low, lambda text: F.filter(mine, lambda n: ~n["fallback"] & n["amount"].isNotNull() & held_word(text, n["name"])))
    best = F.array_min(F.transform(hits, lambda n: F.struct(n["kind"].alias("kind"), (-F.length(n["name"])).alias("size"), n["name"].alias("name"), n["amount"].alias("amount"))))
    rest = F.get(F.filter(mine, lambda n: n["fallback"]), F.lit(0))
    return rows.withColumns({"minimum": F.coalesce(best["amount"], rest["amount"]), "region": F.coalesce(best["name"], rest["name"])}).drop("_wages")


def check_weights(weights: dict[str, float] = WEIGHTS, order: tuple[str, ...] = FEATURES) -> None:
    """Raises unless weights cover the features exactly, none is negative or over MAX_WEIGHT, and they sum to MAX_SHIFT at most."""
    if set(weights) != set(order):
        raise ValueError(f"weights and features differ: {sorted(set(weights) ^ set(order))}")
    if bad := [k for k, w in weights.items() if not 0 <= w <= MAX_WEIGHT + 1e-9]:
        raise ValueError(f"weights out of range: {bad}")
    if sum(weights.values()) > MAX_SHIFT + 1e-9:
        raise ValueError("weights sum to more than the largest shift")


def check_columns(columns: list[str], forbidden: set[str]) -> None:
    """Raises if a column that a model must not see is among ``columns``; call it before any fit."""
    if held := sorted(set(columns) & forbidden):
        raise ValueError(f"columns that must not reach the model: {held}")


def first_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
