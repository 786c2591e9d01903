"""Licence scan: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame

from plumbline.llm.common import batches, texts

#: The phrases whose places are counted, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices, which add labels only; a parameter of ``license_scan``.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl", "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "european union public licence": "eupl", "common development and distribution license": "cddl",
    "bsd license": "bsd", "isc license": "isc", "zlib license": "zlib", "artistic license": "artistic", "boost software license": "bsl", "python software foundation license": "psf",
    "sil open font license": "ofl", "microsoft public license": "ms-pl", "postgresql license": "postgresql", "do what the fuck you want to public license": "wtfpl",
    "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "creative commons zero": "cc0", "cc0": "cc0",
    "released into the public domain": "public-domain", "the unlicense": "unlicense", "all rights reserved": "reserved",
}
#: How freely a text under each licence family may be used, 0 to 1; a parameter of ``license_scan``. Other identifiers count as UNKNOWN, under one label.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "0bsd": 1.0, "isc": 1.0, "zlib": 1.0, "bsl": 1.0, "psf": 1.0, "python": 1.0, "postgresql": 1.0, "unlicense": 1.0, "wtfpl": 1.0,
    "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9, "ofl": 0.9, "artistic": 0.8, "ms-pl": 0.8, "mpl": 0.6, "epl": 0.6, "cddl": 0.6, "cc-by-sa": 0.6, "eupl": 0.5, "lgpl": 0.5,
    "gfdl": 0.4, "gpl": 0.2, "agpl": 0.1, "cc-by-nd": 0.1, "cc-by-nc": 0.1, "licenseref": 0.3, "other": 0.3, "reserved": 0.0,
}
UNKNOWN, EXCEPTION_BONUS, OTHER = 0.3, 0.2, "other"
#: Notices and families at most: they are broadcast.
MAX_PHRASES = 100_000
TAG = "spdx-license-identifier"
_EXPRESSION = re.compile(r"[\x20\t]*:[\x20\t]*([A-Za-z0-9.+()\x20\t-]+)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_RANK = {"with": 3, "and": 2, "or": 1}
# Bytes of words stay (letters in lower case); all others become blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Licences:
    """Notices, families and their freedom, with the automaton that finds notices and tags; built once in each Python worker."""

    def __init__(self, notices: Mapping[str, str] = NOTICES, freedom: Mapping[str, float] = FREEDOM):
        if len(notices) + len(freedom) > MAX_PHRASES:
            raise ValueError(f"{len(notices) + len(freedom)} notices and families; a broadcast table takes {MAX_PHRASES} at most")
        if lacking := sorted({*notices.values(), *BASE_PHRASES.values()} - set(freedom)):
            raise ValueError(f"labels without a freedom: {lacking}")
        self.notices, self.freedom = {**notices, **BASE_PHRASES}, dict(freedom)
        self._found = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None}

    @property
    def automaton(self):
        if self._found is None:
            import ahocorasick

            self._found = ahocorasick.Automaton()
            for phrase, label in self.notices.items():
                self._found.add_word(f" {phrase} ", (phrase, label))
            self._found.add_word(" spdx license identifier ", (TAG, None))
            self._found.make_automaton()
        return self._found

    def family(self, identifier: str) -> str | None:
        """Licence family of an identifier: ``GPL-3.0-or-later`` -> ``gpl``; None if no family fits it."""
        name = identifier.lower().rstrip("+.")
        while name:
            if name in self.freedom:
                return name
            name = name.rpartition("-")[0]
        return None

    def evaluate(self, expression: str) -> tuple[set[str], float]:
        """Families named in an expression, and its freedom: ``and`` takes the least, ``or`` the most, ``with`` adds a bonus.

        A shunting-yard parser that applies operators as it goes, in one pass. The rest of a sentence may follow: the longest
        leading part that is an expression counts, and words that are no licence end it. A tag whose first identifier fits no family
        is one of OTHER. If there is no such part, no label and freedom 0.
        """
        values: list[float] = []
        stack: list[str] = []
        names: list[str] = []
        depth, operand, excepted, done = 0, True, False, (0, 0.0)
        for match in _TOKEN.finditer(expression):
            token = match[0]
            low = token.lower()
            if token == "(":
                if not operand or excepted:
                    break
                stack.append(token)
                depth += 1
                continue
            if token == ")":
                if operand or not depth:
                    break
                while stack[-1] != "(":
                    _apply(stack.pop(), values)
                stack.pop()
                depth -= 1
            elif low in _RANK:
                if operand:
                    break
                while stack and _RANK.get(stack[-1], 0) >= _RANK[low]:
                    _apply(stack.pop(), values)
                stack.append(low)
                operand, excepted = True, low == "with"
                continue
            else:
                if not operand:
                    break
                if excepted:  # what follows "with" is an exception, not a licence
                    values.append(0.0)
                else:
                    name = self.family(token) or (OTHER if not names and not depth else None)
                    if name is None:
                        break
                    names.append(name)
                    values.append(self.freedom.get(name, UNKNOWN))
                operand = excepted = False
            if not depth:  # a complete expression so far: at most one operator of each rank is pending
                held = values[-len(stack) - 1 :]
                for op in reversed(stack):
                    _apply(op, held)
                done = (len(names), held[0])
        return set(names[: done[0]]), done[1]

    def scan(self, text: str) -> dict:
        """Words, base places and labels of one text; word numbers run from 0."""
        words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        joined = b" " + b" ".join(words) + b" "
        joined = joined.decode("latin-1")
        starts: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        freedom: list[float] = []
        tagged = False
        seen = word = 0
        for end, (phrase, label) in self.automaton.iter(joined):
            start = end - len(phrase) - 1
            if phrase == TAG:
                tagged = True
                continue
            labels.add(label)
            freedom.append(self.freedom[label])
            if phrase in BASE_PHRASES:
                base.add(label)
                # Matches come by their ends, and none of the base phrases contains another: starts ascend.
                word += joined.count(" ", seen, start + 1) if start >= seen else -joined.count(" ", start + 1, seen)
                seen = start + 1
                starts.append(word - 1)
        for m in re.finditer("(?ai)" + TAG, text) if tagged else ():
            if expression := _EXPRESSION.match(text, m.end()):
                names, value = self.evaluate(expression[1])
                if names:
                    labels |= names
                    freedom.append(value)
        return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": sorted(base), "labels": sorted(labels | base), "score": min(freedom, default=0.0)}


def _apply(op: str, values: list[float]) -> None:
    b, a = values.pop(), values.pop()
    values.append(min(1.0, a + EXCEPTION_BONUS) if op == "with" else min(a, b) if op == "and" else max(a, b))


def license_scan(documents: DataFrame, notices: Mapping[str, str] = NOTICES, freedom: Mapping[str, float] = FREEDOM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence evidence of every whole text: one narrow pass, no shuffle, linear in a text's length.

    ``notices`` maps phrases (lower-case words with one blank between) to labels, ``freedom`` maps labels to 0 to 1; both are broadcast, and
    more than MAX_PHRASES raise. ``score`` is the freedom of the strictest statement found (0 if none is found): notices count by their
    family, tags by evaluating their expression. Null and empty texts have no words and no labels. Ids may be null or repeat; extra
    columns are not read; an empty table gives an empty result.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"
    known = documents.sparkSession.sparkContext.broadcast(Licences(notices, freedom))

    def run(rows: dict) -> dict:
        found = [known.value.scan(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"]} | {k: [f[k] for f in found] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}

    return batches(texts(documents, id_col, text_col), run, schema)
