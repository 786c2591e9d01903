"""Readers of locale files: phrase lexicons (YAML) and wage tables (JSON), as dimension tables. A missing file is an empty table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.dims import weighed

LEXICON = "locale string, grp string, phrase string, weight double"
WAGES = "locale string, name string, amount bigint, fallback boolean, kind int"
#: Weight of a phrase, and multiplier of a group, that give none.
WEIGHT, MULTIPLIER = 0.5, 1.0


def whole(spark: SparkSession, path: str) -> DataFrame | None:
    """``value``: a file's whole text, or None where there is no file."""
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def loaded(text: str) -> object:
    """A YAML document's value. Without a YAML library only ``lines`` is understood; other shapes are errors, never passed over."""
    try:
        import yaml
    except ImportError:
        return lines(text)
    return yaml.safe_load(text)


def lines(text: str) -> dict:
    """A lexicon that has ``groups:``, names of groups, ``weight_multiplier: n``, ``phrases:`` and ``- {text: "...", weight: n}``, each on a line of its own."""
    groups, name = {}, None
    for n, line in enumerate(text.splitlines(), 1):
        bare = line.strip()
        phrase = re.fullmatch(r"""-\s*\{\s*text:\s*(["'])([^"'\\]*)\1\s*(?:,\s*weight:\s*(\d*\.?\d+)\s*)?\}\s*(?:#.*)?""", bare)
        key = re.fullmatch(r"""([\w-]+):(?:\s+(["']?)([\w.]+)\2)?\s*(?:#.*)?""", bare)
        if not bare or bare.startswith("#"):
            continue
        if phrase and name is not None:
            groups[name]["phrases"].append({"text": phrase[2], **({"weight": float(phrase[3])} if phrase[3] else {})})
        elif key and name is not None and key[1] == "weight_multiplier" and key[3]:
            groups[name]["weight_multiplier"] = float(key[3])
        elif key and line[0].isspace() and not key[3]:
            if key[1] != "phrases":
                name = key[1]
                groups[name] = {"phrases": []}
        elif not (key and not line[0].isspace() and (key[3] or key[1] == "groups")):
            raise ValueError(f"line {n} of a lexicon isn't understood without a YAML library: {bare}")
    return {"groups": groups}


def entries(value: object) -> Iterator[tuple[str, float, str, float]]:
    """``group, multiplier, phrase, weight`` of a lexicon's value. An empty file, no groups and no phrases are none; other shapes raise."""

    def held(x: object, kind: type, where: str):
        if x is not None and not isinstance(x, kind):
            raise ValueError(f"{where} of a lexicon should be a {kind.__name__}, not {x!r:.80}")
        return x or kind()

    def number(x: object, default: float, where: str) -> float:
        if isinstance(x, bool) or not isinstance(x, int | float | None):
            raise ValueError(f"{where} of a lexicon should be a number, not {x!r:.80}")
        return default if x is None else float(x)

    for name, group in held(held(value, dict, "the whole").get("groups"), dict, "groups").items():
        group = held(group, dict, f"group {name}")
        for phrase in held(group.get("phrases"), list, f"phrases in {name}"):
            if not isinstance(phrase, dict) or not isinstance(phrase.get("text"), str):
                raise ValueError(f"a phrase of group {name} should have a text: {phrase!r:.80}")
            yield str(name), number(group.get("weight_multiplier"), MULTIPLIER, f"weight_multiplier of {name}"), phrase["text"], number(phrase.get("weight"), WEIGHT, f"weight of {phrase['text']}")


def read_lexicon(spark: SparkSession, path: str, locale: str) -> DataFrame:
    """``locale, grp, phrase, weight`` of a YAML lexicon of any valid shape (blocks, flows, quotes, anchors, comments).

    ``groups`` maps names to groups; one has ``weight_multiplier`` (1 if there is none) and ``phrases``, a list of ``text`` and ``weight`` (0.5 if there is
    none). Spark reads the file, so the path may be remote, and a worker parses it. What isn't a lexicon raises.
    """
    file = whole(spark, path)
    if file is None:
        return spark.createDataFrame([], LEXICON)

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for text in batch["value"] for x in entries(loaded(text))], columns=["grp", "multiplier", "phrase", "weight"])

    found = file.mapInPandas(parsed, "grp string, multiplier double, phrase string, weight double")
    return weighed(found.select(F.lit(locale).alias("locale"), "grp", "multiplier", "phrase", "weight"))


def read_wages(spark: SparkSession, path: str, locale: str) -> DataFrame:
    """``locale, name, amount, fallback, kind`` of a wage file: aliases (kind 1), regions (kind 2), and the fallback if the file has one.

    The file is a JSON object: ``regions`` or ``provinces`` map names to amounts, ``aliases`` or ``city_aliases`` map names to
    regions, and ``_meta`` may hold ``fallback`` or ``national_median_fallback``, and ``fallback_label``.
    """
    file = whole(spark, path)
    if file is None:
        return spark.createDataFrame([], WAGES)
    parts = file.select(F.from_json("value", "map<string,string>").alias("m"))
    either = lambda *names: F.coalesce(*(F.try_element_at("m", F.lit(n)) for n in names), F.lit("{}"))
    parts = parts.select(
        F.from_json(either("regions", "provinces"), "map<string,bigint>").alias("regions"), F.from_json(either("aliases", "city_aliases"), "map<string,string>").alias("aliases"), F.from_json(either("_meta"), "map<string,string>").alias("meta")
    )
    regions = F.transform(F.map_entries("regions"), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("amount"), F.lit(False).alias("fallback"), F.lit(2).alias("kind")))
    aliases = F.transform(F.map_entries("aliases"), lambda e: F.struct(F.lower(e["key"]).alias("name"), F.try_element_at("regions", e["value"]).alias("amount"), F.lit(False).alias("fallback"), F.lit(1).alias("kind")))
    rest = F.coalesce(F.try_element_at("meta", F.lit("fallback")), F.try_element_at("meta", F.lit("national_median_fallback"))).try_cast("bigint")
    label = F.coalesce(F.try_element_at("meta", F.lit("fallback_label")), F.lit("national median"))
    default = F.when(rest.isNotNull(), F.array(F.struct(label.alias("name"), rest.alias("amount"), F.lit(True).alias("fallback"), F.lit(3).alias("kind"))))
    rows = F.concat(aliases, regions, F.coalesce(default, F.expr("cast(array() as array<struct<name:string,amount:bigint,fallback:boolean,kind:int>>)")))
    return parts.select(F.inline(rows)).select(F.lit(locale).alias("locale"), "name", "amount", "fallback", "kind").where("fallback OR amount IS NOT NULL")


def read_locales(spark: SparkSession, lexicons: dict[str, str], wages: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Lexicon and wages of several locales, from paths by locale."""
    lex, pay = spark.createDataFrame([], LEXICON), spark.createDataFrame([], WAGES)
    for code, path in lexicons.items():
        lex = lex.unionByName(read_lexicon(spark, path, code))
    for code, path in wages.items():
        pay = pay.unionByName(read_wages(spark, path, code))
    return lex, pay
