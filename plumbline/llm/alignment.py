"""Cross-tokenizer alignment: two tokenizers' tokens of a text are parted at shared cuts, by divide and conquer."""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import arrow_schema, texts, written
from plumbline.llm.token_counts import _packed, _unpacked

#: Characters of text from which a block of documents is closed; stretches cached in each of two generations, and the longest of them; stretches of one call to a library.
BLOCK_CHARS, CACHED, CACHED_CHARS, JOINED = 8_000_000, 250_000, 100, 1024
#: A pair of ids is ``a << SHIFT | b``.
SHIFT = 32
# A blank between two characters that aren't white space: both tokenizers end a token before it, whatever the rest of the text.
_CUT = re.compile(r"(?<=\S)(?=\x20\S)")
_UNEVEN = re.compile(r"\s\x20|\x20\s|^\x20|\x20$")
_BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, sizes array<long>, places binary, counts binary, widths binary, links binary, pairs array<long>, held array<long>"


def groups(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int, int, int]]:
    """Token ranges ``(a_from, a_to, b_from, b_to)`` between all shared ends, in order; both lists ascend to the same last end.

    An interval is divided at the shared end nearest to its middle: ends of the side with fewer tokens are looked up by bisection in the
    other's, from the middle outwards. An interval without one is a group.
    """
    out = []
    todo = [(0, len(a_ends), 0, len(b_ends))] if a_ends else []
    while todo:
        a, a2, b, b2 = todo.pop()
        cut = None
        if a2 - a > 1 and b2 - b > 1:
            fewer_a = a2 - a <= b2 - b
            few, lo, hi, some, lo2, hi2 = (a_ends, a, a2 - 1, b_ends, b, b2 - 1) if fewer_a else (b_ends, b, b2 - 1, a_ends, a, a2 - 1)
            right = (lo + hi) // 2
            left = right - 1
            while right < hi or left >= lo:
                if right < hi:
                    j = bisect_left(some, few[right], lo2, hi2)
                    if j < hi2 and some[j] == few[right]:
                        cut = right + 1, j + 1
                        break
                    right += 1
                if left >= lo:
                    j = bisect_left(some, few[left], lo2, hi2)
                    if j < hi2 and some[j] == few[left]:
                        cut = left + 1, j + 1
                        break
                    left -= 1
        if cut is None:
            out.append((a, a2, b, b2))
        else:
            at, bt = cut if fewer_a else (cut[1], cut[0])
            todo.append((at, a2, bt, b2))
            todo.append((a, at, b, bt))
    return out


def overlaps(a_ends: list[int], b_ends: list[int], group: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Places of all tokens of a group whose byte ranges overlap."""
    a, a2, b, b2 = group
    if a2 - a == 1:
        return [(a, j) for j in range(b, b2)]
    if b2 - b == 1:
        return [(i, b) for i in range(a, a2)]
    out = []
    while a < a2 and b < b2:
        out.append((a, b))
        x, y = a_ends[a], b_ends[b]
        a, b = a + (x <= y), b + (y <= x)
    return out


class Aligner:
    """Both tokenizers in a Python worker. A stretch ``s`` of a text is encoded as blank + ``s`` by A, and as ``s`` by B, which adds the blank."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        # The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in plain} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in plain)}
        vocabulary = self.a.get_vocab()
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        #: Whether texts may be parted at blanks: no piece of B goes on behind one.
        self.parted = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_first = {i for i, x in enumerate(self.a_bytes) if x.startswith(b" ")}
        self.b_first = {i for i, x in enumerate(self.b_bytes) if x.startswith(b" ")}
        self.same: dict[int, tuple[int, str]] = {}  # groups of one token each, and how they are spelled; emptied with the cache
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def stretches(self, text: str) -> list[str]:
        """The text, divided at shared cuts that are known beforehand; without the blanks at which it is."""
        if not self.parted or "▁" in text:
            return [text]
        if not _UNEVEN.search(text):
            return text.split(" ")
        return [s[1:] for s in _CUT.split(" " + text)]

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        """``(spelled groups, n_a, n_b, n_groups, pairs of ids)`` of one stretch; None where tokens' bytes differ from its own."""
        whole = b" " + text.encode("utf-8", "surrogatepass")
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        a_ends, b_ends = list(accumulate(map(self.a_sizes.__getitem__, a))), list(accumulate(map(self.b_sizes.__getitem__, b)))
        parts, said, pairs = groups(a_ends, b_ends), [], []
        for part in parts:
            i, i2, j, j2 = part
            if i2 - i == 1 and j2 - j == 1:
                pair = a[i] << SHIFT | b[j]
                one = self.same.get(pair)
                if one is None:
                    one = self.same[pair] = pair, f"{a[i]}|{b[j]}"
                pairs.append(one[0])
                said.append(one[1])
            else:
                said.append(f"{','.join(map(str, a[i:i2]))}|{','.join(map(str, b[j:j2]))}")
                pairs += [a[x] << SHIFT | b[y] for x, y in overlaps(a_ends, b_ends, part)]
        return ";".join(said), len(a), len(b), len(parts), tuple(pairs)

    def entries(self, stretches: set[str]) -> dict[str, tuple | None]:
        """What ``aligned`` gives, of each stretch; those met lately are kept, bounded in number and length."""
        if len(self.new) > CACHED:
            self.old, self.new, self.same = self.new, {}, {}
        out: dict[str, tuple | None] = {}
        missing = []
        for s in stretches:
            if (x := self.new.get(s, self)) is self and (x := self.old.get(s, self)) is self:
                missing.append(s)
            else:
                out[s] = x
        plain = [s for s in missing if self.parted and " " not in s and "▁" not in s and s and not s[0].isspace() and not s[-1].isspace()]
        ids: dict[str, tuple[list[int], list[int]]] = {}
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            joined = " ".join(some)
            a = _split(self.a.encode_batch_fast([" " + joined], add_special_tokens=False)[0].ids, self.a_first)
            b = _split(self.b.encode(joined), self.b_first)
            if len(a) == len(b) == len(some):
                ids.update(zip(some, zip(a, b)))
        for s in missing:
            a, b = ids.get(s) or (self.a.encode_batch_fast([" " + s], add_special_tokens=False)[0].ids, self.b.encode(s))
            out[s] = self.aligned(s, a, b)
            if len(s) <= CACHED_CHARS:
                self.new[s] = out[s]
        return out


def _split(ids: list[int], first: set[int]) -> list[list[int]]:
    """Runs of ids, each begun by one of ``first``."""
    at = [i for i, x in enumerate(ids) if x in first]
    return [ids[i:j] for i, j in zip(at, [*at[1:], len(ids)])] if at and at[0] == 0 else []


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def default_paths() -> tuple[str, str]:
    """Two public vocabularies: byte-level BPE, and BPE of pieces with byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class _Block:
    """Documents of a block: their digests, the distinct stretches of each, and the distinct pairs of ids of them all."""

    def __init__(self, tools: Aligner):
        self.tools, self.chars = tools, 0
        self.place: dict[str, int] = {}
        self.said: list[str] = []
        self.numbers = np.zeros((0, 4), np.int64)
        self.links: list[int] = []
        self.pair_at: dict[int, int] = {}
        self.docs: list[tuple] = []
        self.at: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: list[int | None], texts: list[str]) -> None:
        orders = [self.tools.stretches(t) if t else [] for t in texts]
        wrong = self._place(set().union(*orders))
        for i in [i for i, order in enumerate(orders) if wrong and not wrong.isdisjoint(order)]:  # a stretch's bytes differ: the text as a whole decides
            orders[i] = [] if self._place({texts[i]}) else [texts[i]]
        for doc_id, text, order in zip(ids, texts, orders):
            self._add(doc_id, order)
            self.chars += len(text)

    def _place(self, found: set[str]) -> set[str]:
        """Gives places to stretches that have none yet; returns those whose bytes differ."""
        entries = self.tools.entries({s for s in found if s not in self.place})
        numbers, wrong = [], set()
        for s, entry in entries.items():
            if entry is None:
                wrong.add(s)
                continue
            said, n_a, n_b, n_groups, pairs = entry
            self.place[s] = len(self.said)
            self.said.append(said)
            numbers.append((n_a, n_b, n_groups, len(pairs)))
            self.links += [self.pair_at.setdefault(p, len(self.pair_at)) for p in pairs]
        self.numbers = np.concatenate([self.numbers, np.array(numbers, np.int64).reshape(-1, 4)])
        return wrong

    def _add(self, doc_id: int | None, order: list[str]) -> None:
        sha = ""
        places = list(map(self.place.__getitem__, order))
        if places:
            hashed = hashlib.sha256()
            for i in range(0, len(places), 10_000):
                hashed.update((";" * bool(i) + ";".join(map(self.said.__getitem__, places[i : i + 10_000]))).encode())
            sha = hashed.hexdigest()
        at, times = np.unique(np.array(places, np.int64), return_counts=True)
        self.docs.append((doc_id, *(times @ self.numbers[at]).tolist(), sha, len(at)))
        self.at.append(np.diff(at, prepend=0))
        self.times.append(times)

    def row(self, number: int) -> list:
        widths = self.numbers[:, 3]
        links = np.array(self.links, np.int64)
        uses = np.zeros(len(self.numbers), np.int64)
        for at, times in zip(self.at, self.times):
            uses[np.cumsum(at)] += times
        held = np.bincount(links, weights=np.repeat(uses, widths).astype(np.float64), minlength=len(self.pair_at)).astype(np.int64)
        columns = [list(c) for c in zip(*self.docs)]
        return [number, *columns, _packed(np.concatenate(self.at)), _packed(np.concatenate(self.times)), _packed(widths), _packed(links), list(self.pair_at), held]


def aligned_blocks(rows: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of documents with what one text's tokens say, and how often the block links each pair of ids."""
    struct = T._parse_datatype_string(_BLOCKS)
    schema = arrow_schema(struct)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        block = _Block(tools)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(block.row(number), schema)], schema=schema)

        for batch in source:
            block.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if block.chars >= block_chars:
                yield closed()
                number += 1
                block = _Block(tools)
        if block.docs:
            yield closed()

    return rows.mapInArrow(run, struct)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each pair of ids in the whole corpus, and whether none of its B id has more."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))
    held = written(held, "pairs").withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    most = held.groupBy("b").agg(F.max("n").alias("most"))
    return held.hint("merge").join(most.hint("merge"), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every whole text.

    A encodes blank + text (tokenizers file), B the text (sentencepiece file, which adds the blank). Texts are divided at blanks between words, where both
    are known to end tokens; each distinct stretch is encoded once in a block, and divided further at the byte offsets
    where tokens of both end. Links are all overlapping tokens of A and B. How often the corpus links a pair of ids comes from the
    blocks' own counts, a row per block and pair, summed and sent back; a text's pairs are never rows.

    Null and empty texts, and those whose tokens' bytes aren't their own (U+2581 in a text), have no tokens: zeros and an empty
    hash. Ids may be null or repeat (each row counts); other columns aren't read; an empty table gives an empty result.
    """
    default = default_paths() if a_path is None or b_path is None else (None, None)
    blocks = written(aligned_blocks(texts(documents, id_col, text_col), a_path or default[0], b_path or default[1]), "aligned")
    counts = written(pair_counts(blocks), "paircounts")
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.hint("merge").join(counts.hint("rebalance").hint("merge"), "pair").select("block", "place", "n", "best")

    def sums(known: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in block.itertuples():
            n, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            n[known["place"].to_numpy()] = known["n"].to_numpy()
            best[known["place"].to_numpy()] = known["best"].to_numpy()
            links = _unpacked(row.links).astype(np.int64)
            ends = np.cumsum(_unpacked(row.widths).astype(np.int64))
            sizes = np.asarray(row.sizes, np.int64)
            last = np.cumsum(sizes)
            total = np.cumsum(_unpacked(row.places).astype(np.int64))
            at = total - np.repeat(np.concatenate([[0], total])[last - sizes], sizes)
            times = _unpacked(row.counts).astype(np.int64)

            def per_doc(values: np.ndarray) -> np.ndarray:
                running = np.concatenate([[0], np.cumsum(values[links])])
                each = np.diff(running[np.concatenate([[0], ends])])[at] * times
                running = np.concatenate([[0], np.cumsum(each)])
                return running[last] - running[last - sizes]

            fixed = {k: np.asarray(getattr(row, k), np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
            out.append(pd.DataFrame({"doc_id": pd.array(row.doc_id, dtype="Int64"), **fixed, "n_best": per_doc(best), "count_sum": per_doc(n), "groups_sha256": list(row.sha)}))
        return pd.concat(out)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    whole = blocks.select(F.col("block").alias("block"), *(c for c in blocks.columns if c not in ("block", "pairs", "held")))  # both sides are of one table
    return answers.groupBy("block").cogroup(whole.groupBy("block")).applyInPandas(sums, schema)
