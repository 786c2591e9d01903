"""Tokenizer files inside tasks: exact splitting of texts into pre-tokens, and ids through a bounded cache of them."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: The pre-token pattern of the word-end BPE, restricted to lower-case Latin-1.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t\n\r a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")
_UNUSUAL = re.compile(r"[^\t\n\r -~¡-¬®-ÿ]")
_BLANKS = re.compile(r"[\t\n\r ]+")
#: Cached pre-tokens of each of two generations, and pre-tokens of one call to the library.
CACHED, JOINED = 400_000, 128


def default_path() -> str:
    """The public word-end BPE vocabulary; any other tokenizers file can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _word_ends(path: str) -> bool:
    """True for the kind of file whose pre-tokens _PIECES gives: lower case, white space dropped, word ends marked."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    steps = [x.get("type") for x in (d.get("normalizer") or {}).get("normalizers", [])]
    return steps == ["NFC", "Replace", "Lowercase"] and d["model"].get("end_of_word_suffix") == "</w>" and d.get("post_processor") is None


class Encoder:
    """One tokenizer in a Python worker. Texts become pre-tokens whose ids, put together, are the text's ids.

    For the word-end BPE, Latin-1 text is split by pattern; other words, and those with special strings, are left as the
    library's own input. For any other file the whole text is its only pre-token, so results are the library's there, too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = _word_ends(path)
        if self.split:
            self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.final[i] = token.endswith("</w>")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if not self.split:
            return [text]
        if not _UNUSUAL.search(text) and "<|" not in text:
            return _PIECES.findall(text.lower())
        out: list[str] = []
        for word in _BLANKS.split(text):
            if _UNUSUAL.search(word) or "<|" in word:
                out.append(word)
            else:
                out += _PIECES.findall(word.lower())
        return out

    def ids(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each pre-token. Plain ones go to the library many at a time; their word ends part them again."""
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if self.split and p and not _UNUSUAL.search(p) and "<|" not in p]
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            got = np.array(self.tokenizer.encode(" ".join(pieces[i] for i in some), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.final[got]) + 1
            if len(ends) == len(some):
                for i, x in zip(some, np.split(got, ends[:-1])):
                    out[i] = x
        for i, x in enumerate(out):
            if x is None:
                out[i] = np.array(self.tokenizer.encode(pieces[i], add_special_tokens=False).ids, dtype="<u4")
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = [self.pieces(t) for t in texts]
        needed = set().union(*split) - self.new.keys()
        if len(self.new) + len(needed) > CACHED:
            self.old, self.new = self.new, {}
            needed = set().union(*split)
        self.new.update((p, self.old[p]) for p in needed & self.old.keys())
        missing = list(needed - self.old.keys())
        self.new.update(zip(missing, (x.tobytes() for x in self.ids(missing))))
        return [b"".join(map(self.new.__getitem__, p)) for p in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
