"""Secret scan: fixed patterns, and guess-cost segmentation of the values that stand in credential contexts."""

from __future__ import annotations

import math
import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, discard, texts, written
from plumbline.operators.prefix import running_sums

#: The kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|secret|auth)[_-]?(?:key|token)|client[_-]?secret|bearer)["']?\s{0,4}(?:[:=]{1,2}|=>)\s{0,4}["']?"""
#: Where a credential may stand: a name, a separator, then a value without blanks or quotes that isn't a variable's name.
CONTEXT = re.compile(rf"""(?ai)(?<![a-z0-9]){_NAMES}((?![$%{{])[^\s"'<>]{{8,}})""")
#: A password before a host, of any length, with or without a user. Both stretches end at a slash at the latest, so that scanning is linear.
USERINFO = re.compile(r"(?a)://[^\s/:@]*+:([^\s/@]{8,}+)@")
#: Guesses, as a power of ten, from which a value counts as a secret.
THRESHOLD = 10.0
#: Frequent words of passwords, most frequent first: they come before a dictionary's words.
PASSWORDS = (
    "password admin welcome login letmein secret master dragon monkey shadow sunshine princess football baseball superman batman "
    "test user guest root default change changeme temp pass hello love summer winter spring autumn monday friday january march "
    "example sample demo your here token key value string none null true false dummy placeholder redacted xxxx company office"
).split()
#: What counts as a word: so many letters; longer runs are no words. And words of a dictionary that is given, at most (it is broadcast).
SHORTEST, LONGEST, MAX_WORDS = 3, 32, 100_000
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(row[i], row[j]) for row in _ROWS for i in range(len(row)) for j in (i - 1, i + 1) if 0 <= j < len(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._](?:0[1-9]|1[0-2])[-/._](?:19|20)\d\d")
_LEET = str.maketrans("430157$@", "aeoistsa")
_SWITCH = math.log10(2)


def word_ranks(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, cost`` of every word of all ``documents``, but for values that stand in credential contexts.

    A word that people write often is guessed early, whatever the language: its cost is the power of ten of its rank, behind the frequent
    words of passwords; words as frequent as each other share the best of their ranks. Counting is a map-side aggregate over all texts, ranks are running sums over
    the table of frequencies, and nothing is cut off. Null texts have no words.
    """
    # Outer: else Spark would test the array's size first, and split each text twice.
    bare = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), rf"""(?i){_NAMES}[^\s"'<>]+""", " ")
    words = documents.select(F.explode_outer(F.split(F.lower(bare), r"[^\p{L}]+", -1)).alias("word")).where(F.length("word").between(SHORTEST, LONGEST))
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    classes = written(counts.groupBy("n").agg(F.count("*").alias("words")), "classes")
    ranks = running_sums(classes.withColumn("all", F.lit(0)), ["all"], "n", ["words"])
    cost = F.log10((F.col("cum_words") - F.col("words") + 1 + len(PASSWORDS)).cast("double"))
    return counts.hint("merge").join(ranks.select(F.col("n").alias("n"), cost.alias("cost")).hint("rebalance").hint("merge"), "n").select("word", "cost")


def dictionary(words: list[str]) -> dict[str, float]:
    """Powers of ten of guesses by word: those of passwords first, then ``words``, most frequent first."""
    if len(words) > MAX_WORDS:
        raise ValueError(f"{len(words)} words; a broadcast dictionary takes {MAX_WORDS} at most")
    known = dict.fromkeys([*PASSWORDS, *(w for w in map(str.lower, words) if SHORTEST <= len(w) <= LONGEST)])
    return {w: math.log10(i + 1) for i, w in enumerate(known)}


_OWN = dictionary([])


def _cardinality(value: str) -> int:
    sizes = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
    return sum(n for test, n in sizes if any(map(test, value))) + 33 * any(not c.isalnum() for c in value)


def guess_cost(value: str, words: dict[str, float] = _OWN) -> tuple[float, list[tuple[str, int, int]]]:
    """Least power of ten of guesses over all segmentations of ``value``, and the segments ``(kind, start, end)``.

    Dynamic programming over end positions. A segment is a known word (also with digits for letters), a date, a
    repeated character, a walk along a keyboard row or the alphabet, or one character by brute force (adjacent
    ones are merged); each change of segment costs a factor of two. Time is linear in the length of the value.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer: such letters stay as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    forms = ((low, 0.0),) if plain == low else ((low, 0.0), (plain, 0.5))
    each = math.log10(max(2, _cardinality(value)))
    best = [0.0] + [math.inf] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    repeat = walk = 0  # where the present run of each kind begins

    def offer(kind: str, start: int, end: int, cost: float) -> None:
        total = best[start] + cost + (_SWITCH if kind != "brute" else 0.0)
        if total < best[end]:
            best[end], back[end] = total, (kind, start)

    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            for end in {m.end(), i + 4} if value[i : i + 4].isdigit() else {m.end()}:
                dates.setdefault(end, []).append(i)
    for end in range(1, n + 1):
        offer("brute", end - 1, end, each)
        for start in range(max(0, end - LONGEST), end - SHORTEST + 1):
            for form, extra in forms:
                if (rank := words.get(form[start:end])) is not None:
                    offer("word", start, end, rank + extra + (0.5 if value[start:end] != low[start:end] else 0.0))
        for start in dates.get(end, ()):
            offer("date", start, end, math.log10(365 * 100))
        if end > 1:
            if low[end - 1] != low[end - 2]:
                repeat = end - 1
            if (low[end - 2], low[end - 1]) not in _NEXT:
                walk = end - 1
            for kind, start, base in (("repeat", repeat, 95), ("walk", walk, 47)):
                if end - start >= 3:
                    offer(kind, start, end, math.log10(base * (end - start)))
    out: list[tuple[str, int, int]] = []
    at = n
    while at:
        kind, start = back[at]
        if kind == "brute" and out and out[-1][0] == "brute":
            out[-1] = (kind, start, out[-1][2])
        else:
            out.append((kind, start, at))
        at = start
    return best[n], out[::-1]


class _AnyWord:
    """A dictionary in which every run of letters is the first guess."""

    def get(self, word: str) -> float | None:
        return 0.0 if word.isalpha() else None


def verdict(value: str) -> bool | None:
    """Whether a value is a secret where no dictionary can change that: too cheap without one, or too dear if each run of letters were a word."""
    if guess_cost(value)[0] < THRESHOLD:
        return False
    return True if guess_cost(value, _AnyWord())[0] >= THRESHOLD else None


def parts_of(value: str) -> set[str]:
    """All stretches of a value that a dictionary may hold, also with letters for digits."""
    low = value.lower()
    if len(low) != len(value):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return {p for form in {low, low.translate(_LEET)} for size in range(SHORTEST, LONGEST + 1) for i in range(len(form) - size + 1) if (p := form[i : i + size]).isalpha()}


def fixed_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Spans of the fixed patterns ``(start, kind number, end)``, and places of values in credential contexts that no assignment holds."""
    found, values = [], []
    if ":" in text or "=" in text:
        taken = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        found += [(a, 0, b) for a, b in taken]
        starts = [a for a, _ in taken]  # ascending, and the spans don't overlap
        for pattern in (CONTEXT, USERINFO):
            for m in pattern.finditer(text):
                value = m[1].rstrip(".,;:!?)]}")
                start, end = m.start(1), m.start(1) + len(value)
                before = bisect_right(starts, start) - 1
                if len(value) >= 8 and not (before >= 0 and end <= taken[before][1]):
                    values.append((start, end))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found, values


def find_secrets(text: str, words: dict[str, float] = _OWN) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` in code points, sorted; kinds as in KINDS. Time is linear in the length of the text.

    A value in a credential context that no fixed pattern holds is a secret if guessing it costs THRESHOLD or more.
    """
    found, values = fixed_spans(text)
    return sorted({*found, *((a, 3, b) for a, b in values if guess_cost(text[a:b], words)[0] >= THRESHOLD)})


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each stretch that spans cover (overlapping ones joined) replaced by ``mark``."""
    out, at, stretch = [], 0, -1
    for start, _, end in spans:
        if start >= stretch:
            out += [text[at:start], mark]
        stretch = max(stretch, end)
        at = stretch
    return "".join(out) + text[at:]


_SPANS = "array<struct<kind: string, start: long, end: long>>"


def _kinds(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]


def secret_spans(documents: DataFrame, words: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Secrets of every whole text as ``spans array<struct<kind,start,end>>``; ``keep`` names other columns to hold on to.

    ``words`` is a ranked dictionary, most frequent first; it is broadcast, and more than MAX_WORDS raise. Without it, the ranks of all words
    of the documents count (``word_ranks``): a narrow pass decides all values that no dictionary can change; texts with
    others are written, and the few parts of those values are joined to the table of words, which is never broadcast or cut.

    Offsets are code points, end exclusive. With ``redacted``, also the text without them. Null and empty texts have
    no spans. Ids may be null or repeat; other columns are not read; an empty table gives an empty result.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.lit(0).alias("none")).alias("kept"))
    known = documents.sparkSession.sparkContext.broadcast(None if words is None else dictionary(words))
    kept = next(f.dataType.simpleString() for f in rows.schema if f.name == "kept")
    schema = f"doc_id long, spans {_SPANS}, kept {kept}" + ", text string" * redacted

    def settled(rows: dict) -> list[tuple]:
        """Of each text its spans so far, and the places and values that are open."""
        out = []
        for text in rows["text"]:
            spans, values = fixed_spans(text)
            still = []
            for a, b in values:
                sure = verdict(text[a:b]) if known.value is None else guess_cost(text[a:b], known.value)[0] >= THRESHOLD
                if sure is None:
                    still.append((a, b))
                elif sure:
                    spans.append((a, 3, b))
            out.append((sorted(set(spans)), still))
        return out

    def shut(rows: dict) -> dict:
        ready = [(i, spans) for i, (spans, still) in enumerate(settled(rows)) if not still]
        out = {"doc_id": [rows["doc_id"][i] for i, _ in ready], "kept": [rows["kept"][i] for i, _ in ready], "spans": [_kinds(spans) for _, spans in ready]}
        return out | ({"text": [redact(rows["text"][i], spans) for i, spans in ready]} if redacted else {})

    def open_(rows: dict) -> dict:
        left = [(i, spans, still) for i, (spans, still) in enumerate(settled(rows)) if still]
        out = {c: [rows[c][i] for i, _, _ in left] for c in ("doc_id", "kept", "text")}
        return out | {"spans": [_kinds(s) for _, s, _ in left], "values": [[{"start": a, "end": b, "value": rows["text"][i][a:b]} for a, b in still] for i, _, still in left]}

    done = batches(rows, shut, schema)
    if words is not None:
        return _opened(done, keep)
    # Only texts with a name of a credential, or a password in a URL, can be open.
    likely = rows.where(F.regexp_like("text", F.lit(rf"(?i){_NAMES}")) | F.contains("text", F.lit("://")))
    left = written(batches(likely, open_, f"doc_id long, spans {_SPANS}, kept {kept}, text string, values array<struct<start: long, end: long, value: string>>").withColumn("uid", F.monotonically_increasing_id()), "opened")
    asked = left.select("uid", F.explode("values").alias("x")).select("uid", "x.start", "x.end", "x.value")
    secret = _dear(asked.select("value").distinct(), word_ranks(documents, text_col)).where("secret")
    hits = asked.hint("merge").join(secret.select("value").hint("rebalance").hint("merge"), "value").groupBy("uid").agg(F.collect_list(F.struct(F.lit(KINDS[3]).alias("kind"), "start", "end")).alias("more"))

    def finish(rows: dict) -> dict:
        spans = [sorted({(x["start"], KINDS.index(x["kind"]), x["end"]) for x in [*a, *(b or ())]}) for a, b in zip(rows["spans"], rows["more"])]
        out = {"doc_id": rows["doc_id"], "kept": rows["kept"], "spans": [_kinds(s) for s in spans]}
        return out | ({"text": [redact(t, s) for t, s in zip(rows["text"], spans)]} if redacted else {})

    rest = batches(left.hint("merge").join(hits.hint("merge"), "uid", "left").select("doc_id", "kept", "spans", "text", "more"), finish, schema)
    return _opened(done.unionByName(rest), keep)


def _opened(found: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return found.select("doc_id", *(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(keep)), *(c for c in found.columns if c not in ("doc_id", "kept")))


def _dear(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """``value, secret`` of distinct values, by the costs of all words that they hold."""
    values = written(values, "values")
    split = lambda rows: {"value": [v for v in rows["value"] for _ in parts_of(v)], "part": [p for v in rows["value"] for p in parts_of(v)]}
    parts = written(batches(values, split, "value string, part string"), "parts")
    known = parts.select(F.col("part").alias("word")).distinct().hint("merge").join(ranks.hint("merge"), "word").select(F.col("word").alias("part"), "cost")
    held = parts.hint("merge").join(known.hint("rebalance").hint("merge"), "part").groupBy("value").agg(F.collect_list(F.struct("part", "cost")).alias("words"))

    def decide(rows: dict) -> dict:
        return {"value": rows["value"], "secret": [guess_cost(v, {w["part"]: w["cost"] for w in words or ()} | _OWN)[0] >= THRESHOLD for v, words in zip(rows["value"], rows["words"])]}

    return batches(values.hint("merge").join(held.hint("merge"), "value", "left").select("value", "words"), decide, "value string, secret boolean")


def secret_digest(documents: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Counts by kind, the hash of the fixed patterns' spans, and all spans as text."""
    spans = secret_spans(documents, words)
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return spans.select("doc_id", kind("assign").alias("n_assign"), kind("access").alias("n_access"), kind("hex").alias("n_hex"), F.sha2(said(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
