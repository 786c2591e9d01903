"""Spans: matches of a pattern with their code-point offsets, as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for the row, however often ``body`` asks for it, also for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SPAN = "struct<text:string,start:int,end:int>"
_EMPTY = f"cast(array() as array<{_SPAN}>)"


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Array of what ``step(state, item) -> (state, out)`` gives for each item in order; ``kind`` is the type of ``out``.

    A fold that appends copies what it has. So the items are cut into about as many pieces as a piece has items, a fold over each piece appends to
    a short array, and a fold over the pieces appends those: a million items copy a few hundred short arrays each, not each other.
    """
    none = lambda depth: F.expr(f"cast(array() as {'array<' * depth}{kind}{'>' * depth})")

    def piece(state: Column, some: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            now, out = step(acc["state"], x)
            return F.struct(now.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

        return F.aggregate(some, F.struct(state.alias("state"), none(1).alias("out")), add)

    def over(held: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(held))).cast("int")
        firsts = F.when(F.size(held) > 0, F.sequence(F.lit(1), F.size(held), width)).otherwise(F.expr("cast(array() as array<int>)"))
        more = lambda acc, first: let(piece(acc["state"], F.slice(held, first, width)), lambda p: F.struct(p["state"].alias("state"), F.concat(acc["out"], F.array(p["out"])).alias("out")))
        return F.flatten(F.aggregate(firsts, F.struct(start.alias("state"), none(2).alias("out")), more)["out"])

    return let(items, over)


def find_spans(text: Column, regex: str, needs: Column | None = None) -> Column:
    """``array<struct<text,start,end>>`` of all matches; the pattern must not match the empty string.

    Matches and the pieces between them are laid end to end, and a scan carries the position. ``needs`` is a cheap test
    that every text with a match passes: others aren't searched.
    """
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pairs = let(hits, lambda found: F.zip_with(F.slice(F.split(text, regex, -1), F.lit(1), F.size(found)), found, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"))))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        begin = at + pair["gap"]
        end = begin + F.length(pair["hit"])
        return end, F.struct(pair["hit"].alias("text"), begin.alias("start"), end.alias("end"))

    found = scan(pairs, F.lit(0), step, _SPAN)
    found = found if needs is None else F.when(needs, found)
    return F.coalesce(found, F.expr(_EMPTY))


def outside_of(spans: Column, outers: Column) -> Column:
    """The spans that don't lie wholly in one of ``outers``, by start: one pass over both, which carries the farthest end of an outer so far."""
    tag = lambda held, kind: F.transform(held, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["text"].alias("text")))

    def step(reach: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["kind"] == 0, F.greatest(reach, s["end"])).otherwise(reach), F.struct(((s["kind"] == 1) & (s["end"] > reach)).alias("stays"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"))

    marked = scan(F.array_sort(F.concat(tag(outers, 0), tag(spans, 1))), F.lit(-1), step, "struct<stays:boolean,text:string,start:int,end:int>")
    kept = F.transform(F.filter(marked, lambda s: s["stays"]), lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when((F.size(spans) > 0) & (F.size(outers) > 0), kept).otherwise(spans)


def span_texts(spans: Column) -> Column:
    return F.transform(spans, lambda s: s["text"])


def spelled(spans: Column) -> Column:
    """Spans as ``start:end`` joined by commas, for comparing results."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
