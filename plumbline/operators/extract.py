"""Mentions of people and firms in texts: addresses, links, phones, company names and fields, with offsets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.spans import find_spans, outside_of
from plumbline.operators.fixed import COMPANY, EMAIL, PHONE, TITLE_CHARS, URL


@dataclass(frozen=True)
class Patterns:
    """Patterns that depend on the country."""

    phone: str = PHONE
    company: str = COMPANY


def urls(text: Column) -> Column:
    """Links, without the punctuation that ends a sentence."""
    trimmed = lambda s: F.regexp_replace(s["text"], r"[.,;:!?)]+$", "")
    low = F.lower(text)
    found = find_spans(text, URL, F.contains(low, F.lit("://")) | F.contains(low, F.lit("www.")))
    return F.transform(found, lambda s: F.struct(trimmed(s).alias("text"), s["start"].alias("start"), (s["start"] + F.length(trimmed(s))).alias("end")))


def emails(text: Column) -> Column:
    return find_spans(text, EMAIL, F.contains(text, F.lit("@")))


def extract_mentions(df: DataFrame, text: str, patterns: Patterns = Patterns()) -> DataFrame:
    """Adds ``urls, emails, phones, companies, redactions, title, company`` and ``has_redaction``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("urls", urls(raw))
    out = out.withColumn("emails", outside_of(emails(raw), F.col("urls")))
    out = out.withColumn("phones", outside_of(outside_of(find_spans(raw, patterns.phone), F.col("urls")), F.col("emails")))
    out = out.withColumns({"companies": find_spans(raw, patterns.company), "redactions": tx.redactions(raw), "title": title(raw)})
    return out.withColumns({"company": F.get("companies", F.lit(0))["text"], "has_redaction": F.size("redactions") > 0})


def title(text: Column) -> Column:
    """The first line that isn't blank, cut to TITLE_CHARS."""
    return F.substring(F.trim(F.regexp_extract(text, r"[^\n]*\S[^\n]*", 0)), 1, TITLE_CHARS)


def contact_rates(df: DataFrame, text: str) -> DataFrame:
    """Share of texts with an address, a link, a marker of a redaction."""
    raw = F.coalesce(F.col(text), F.lit(""))
    share = lambda regex: F.avg(F.regexp_like(raw, F.lit(regex)).cast("double"))
    return df.agg(F.count("*").alias("n"), share(EMAIL).alias("with_email"), share(URL).alias("with_url"), share(tx.REDACTION).alias("with_redaction"))
