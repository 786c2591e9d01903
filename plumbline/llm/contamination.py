"""Benchmark decontamination: one Aho-Corasick automaton over the items' windows of words scans each text once."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, written

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Words of a piece that an item is cut into, and bytes of pieces that one automaton holds; it takes about 250 times as much memory.
PIECE_WORDS, MAX_BYTES = 1000, 1 << 19
#: Letters of the automaton's alphabet for each of a word's two places.
LETTERS = 512
# Bytes of words stay (letters in lower case); all others become blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
OTHER = "\0\0"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in order, in lower case; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _letters(n: int) -> str:
    """Two letters for the ``n``-th word; first and second letters differ, so that matches begin at words."""
    if n >= LETTERS * LETTERS:
        raise ValueError(f"an automaton takes {LETTERS * LETTERS} different words at most; give it fewer bytes")
    return chr(1 + n // LETTERS) + chr(1 + LETTERS + n % LETTERS)


class Windows:
    """The windows of pieces ``(item, words)``; the automaton is built once in each Python worker.

    It reads words, not characters: two letters stand for each word that an item has, and OTHER for the rest.
    """

    def __init__(self, pieces: Iterable[tuple[str | None, str]], window: int = WINDOW):
        self.pieces, self.window, self._built = list(pieces), window, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_built": None}

    @property
    def built(self) -> tuple:
        """Letters by word, the automaton (None without windows), and the items of each window."""
        if self._built is None:
            import ahocorasick

            letters: dict[bytes, str] = {}
            owners: dict[str, set[str]] = {}
            for item, words in self.pieces:
                spelled = "".join(letters.setdefault(w, _letters(len(letters))) for w in words.encode("utf-8", "surrogatepass").split(b" "))
                for at in range(0, max(2, len(spelled) - 2 * self.window + 2), 2):
                    held = owners.setdefault(spelled[at : at + 2 * self.window], set())
                    if item is not None:
                        held.add(item)
            automaton = ahocorasick.Automaton()
            for key in owners:
                automaton.add_word(key, key)
            automaton.make_automaton()
            self._built = letters, automaton if owners else None, owners
        return self._built

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """Words of ``text``, its runs of hit words ``(from, to, start, end)``, and the items with windows in it, sorted.

        ``from`` and ``to`` number words, ``start`` and ``end`` are code points of the original text; ends are exclusive.
        """
        letters, automaton, owners = self.built
        words = words_of(text)
        if automaton is None or not words:
            return len(words), [], []
        runs: list[list[int]] = []
        found = set()
        for end, key in automaton.iter("".join(map(letters.get, words, repeat(OTHER)))):
            end = (end + 1) // 2
            start = end - len(key) // 2
            found.add(key)
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append([start, end])
        if not runs:
            return len(words), [], []
        places = [m.span() for m in _WORD.finditer(text)]
        items = set().union(*(owners[key] for key in found))
        return len(words), [(a, b, places[a][0], places[b - 1][1]) for a, b in runs], sorted(items)


def merged(runs: Iterable[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of words that touch or overlap, joined."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, start, end in sorted(runs):
        if out and a <= out[-1][1]:
            last = out.pop()
            a, b, start, end = last[0], max(b, last[1]), last[2], max(end, last[3])
        out.append((a, b, start, end))
    return out


def pieces_of(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item, words``: the items' words in pieces of bounded length, which overlap so that no window is lost."""

    def cut(rows: dict) -> dict:
        out: dict = {"item": [], "words": []}
        for item, text in zip(rows["item"], rows["text"]):
            words = words_of(text)
            for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                out["item"].append(item)
                out["words"].append(b" ".join(words[at : at + PIECE_WORDS + window - 1]).decode("utf-8", "surrogatepass"))
        return out

    return batches(benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")), cut, "item string, words string")


_RUNS = "runs array<struct<from: long, to: long, start: long, end: long>>, items array<string>"


def _spelled(found: list[tuple]) -> dict:
    return {"runs": [[dict(zip(("from", "to", "start", "end"), r)) for r in f[1]] for f in found], "items": [f[2] for f in found]}


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs array<struct<from,to,start,end>>, items array<string>`` of every whole text.

    Each window of ``window`` words of an item (questions and answers alike) is a pattern of one automaton that is broadcast, and a
    text is scanned once, in time linear in its length, with no shuffle. ``runs`` are the stretches of hit words, also as code points of the original text. If the
    items take more than ``max_bytes``, they are dealt to several automata of that size at most; each scans the documents in turn, and what they find
    is joined by row, so neither the driver nor a worker holds more than one of them.

    Null and empty texts have no words; an item without words has no windows. Items are named once, whatever the number of their
    rows; an item whose id is null hits words but isn't named. Document ids may be null or repeat (each row counts); other
    columns aren't read; an empty table gives an empty result, an empty benchmark no hits.
    """
    pieces = written(pieces_of(benchmark, item_col, item_text, window), "windows")
    size = pieces.agg(F.sum(F.octet_length("words") + 8)).first()[0] or 0
    lots = max(1, -(-size // max_bytes))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    context = documents.sparkSession.sparkContext

    def automaton(lot: int):
        mine = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(lots)) == lot)
        return context.broadcast(Windows([(r["item"], r["words"]) for r in mine.collect()], window))

    if lots == 1:
        known = automaton(0)

        def scan(batch: dict) -> dict:
            found = [known.value.scan(t) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "n_words": [f[0] for f in found]} | _spelled(found)

        return batches(rows, scan, f"doc_id long, n_words long, {_RUNS}")

    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "scanned")
    parts = None
    for lot in range(lots):
        known = automaton(lot)

        def part(batch: dict, known=known) -> dict:
            found = [(i, known.value.scan(t)) for i, t in zip(batch["uid"], batch["text"])]
            found = [(i, f) for i, f in found if f[1]]
            return {"uid": [i for i, _ in found]} | _spelled([f for _, f in found])

        hits = written(batches(rows.select("uid", "text"), part, f"uid long, {_RUNS}"), "hits")
        parts = hits if parts is None else parts.unionByName(hits)
    joined = parts.groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def finish(batch: dict) -> dict:
        found = [(len(words_of(t)), merged(tuple(r.values()) for r in runs or ()), items or []) for t, runs, items in zip(batch["text"], batch["runs"], batch["items"])]
        return {"doc_id": batch["doc_id"], "n_words": [f[0] for f in found]} | _spelled(found)

    return batches(rows.hint("merge").join(joined.hint("merge"), "uid", "left").select("doc_id", "text", "runs", "items"), finish, f"doc_id long, n_words long, {_RUNS}")


def contamination_digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts of words, hit words and items, the hash of the items' ids, and whether anything was hit."""
    found = contamination(documents, benchmark)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


#: The same in DuckDB: all windows of items, and all runs of as many words in documents. Documents are told apart by row.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS nr, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (
  SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(list_slice(words, p, p + least(len(words), 10) - 1), ' ') AS gram
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM b WHERE len(words) > 0)),
n AS (SELECT nr, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
t AS (SELECT nr, pos, list(word) OVER (PARTITION BY nr ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM n),
g AS (
  SELECT nr, pos, size, array_to_string(list_slice(ahead, 1, size), ' ') AS gram
  FROM t JOIN (SELECT DISTINCT size FROM w) ON len(ahead) >= size),
m AS (SELECT g.nr, g.pos, g.size, w.item FROM g JOIN w ON g.gram = w.gram AND g.size = w.size),
h AS (SELECT nr, count(DISTINCT hit) AS n_hit FROM (SELECT nr, unnest(range(pos, pos + size)) AS hit FROM m) GROUP BY nr),
i AS (SELECT nr, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT nr, item FROM m WHERE item IS NOT NULL) GROUP BY nr)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (nr) LEFT JOIN i USING (nr)
"""
