"""Token counts of whole texts: pieces are counted once per distinct pre-token and joined to pre-token frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import arrow_schema, texts, written
from plumbline.llm.tokens import default_path, encoder

#: Characters of text from which a block of documents is closed, and blocks whose rows of one pre-token meet in one task, on average.
BLOCK_CHARS, MET_BLOCKS = 16_000_000, 2048
_BLOCKS = "block long, pretokens array<string>, doc_id array<long>, n_bytes array<long>, sizes array<long>, places binary, counts binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def frequencies(rows: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of documents: their distinct pre-tokens, and for each document the places there and how often each occurs."""
    struct = T._parse_datatype_string(_BLOCKS)
    schema = arrow_schema(struct)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number = encoder(path), TaskContext.get().partitionId() << 32

        def closed() -> pa.RecordBatch:
            values = [number, list(place), ids, sizes_in, sizes, _packed(np.concatenate(places)), _packed(np.concatenate(counts))]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, schema)], schema=schema)

        place, ids, sizes_in, sizes, places, counts, chars = {}, [], [], [], [], [], 0
        for batch in source:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(enc.pieces(text))
                at = np.fromiter((place.setdefault(p, len(place)) for p in found), np.int64, len(found))
                order = np.argsort(at)
                places.append(np.diff(at[order], prepend=0))
                counts.append(np.fromiter(found.values(), np.int64, len(found))[order])
                ids.append(doc_id)
                sizes_in.append(len(text.encode("utf-8", "surrogatepass")))
                sizes.append(len(found))
                chars += len(text)
                if chars >= block_chars:
                    yield closed()
                    number += 1
                    place, ids, sizes_in, sizes, places, counts, chars = {}, [], [], [], [], [], 0
        if ids:
            yield closed()

    return rows.mapInArrow(run, struct)


def count_pieces(pretokens: DataFrame, path: str, lots: int = 1) -> DataFrame:
    """Adds ``n``, the tokens of each row's pre-token, to rows ``(pretoken, block, place)`` dealt out by pre-token and lot of blocks.

    Rows are sorted by pre-token within their partition, so equal ones meet, and the library sees each only once in each lot. A
    pre-token that every block holds has ``lots`` tasks.
    """
    struct = T._parse_datatype_string("block long, place int, n int")
    schema = arrow_schema(struct)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(path), (None, 0)
        for batch in source:
            names = batch.column(0).to_pylist()
            new = [i for i, name in enumerate(names) if name != (names[i - 1] if i else last[0])]
            sizes = [len(x) for x in enc.ids([names[i] for i in new])]
            spans = np.diff([*new, len(names)])
            n = np.concatenate([np.full(new[0] if new else len(names), last[1]), np.repeat(np.array(sizes, np.int64), spans)])
            if names:
                last = (names[-1], int(n[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(n, type=pa.int32())], schema=schema)

    dealt = pretokens.select("pretoken", "block", "place").repartition("pretoken", F.pmod(F.xxhash64("block"), F.lit(lots))).sortWithinPartitions("pretoken")
    return dealt.mapInArrow(run, struct)


def token_counts(documents: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, for the tokenizers file at ``path``.

    Documents are gathered into blocks; a block sends each of its distinct pre-tokens once, so a word that all
    documents hold makes one row per block, not per document. Their pieces are counted where equal pre-tokens meet,
    come back to the block, and are summed by the frequencies of its documents; no text's ids are ever put together.
    The blocks are a written table: their numbers stay the same when a task is run again. Null and empty texts have
    0 tokens; ids may be null or repeat (each row is counted); an empty table gives an empty result; other columns
    are not read.
    """
    path = path or default_path()
    blocks = written(frequencies(texts(documents, id_col, text_col), path), "pretokens")
    pretokens = blocks.select("block", F.posexplode("pretokens").alias("place", "pretoken"))
    counted = count_pieces(pretokens, path, max(1, -(-blocks.count() // MET_BLOCKS)))

    def sums(sizes: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in block.itertuples():
            n = np.zeros(len(sizes), np.int64)
            n[sizes["place"].to_numpy()] = sizes["n"].to_numpy()
            lengths = np.asarray(row.sizes, np.int64)
            deltas, ends = _unpacked(row.places).astype(np.int64), np.cumsum(lengths)
            total = np.cumsum(deltas)
            base = np.concatenate([[0], total])[ends - lengths]
            each = n[total - np.repeat(base, lengths)] * _unpacked(row.counts) if len(total) else np.zeros(0, np.int64)
            running = np.concatenate([[0], np.cumsum(each)])
            tokens = running[ends] - running[ends - lengths]
            out.append(pd.DataFrame({"doc_id": pd.array(row.doc_id, dtype="Int64"), "n_bytes": np.asarray(row.n_bytes, np.int64), "n_tokens": tokens, "over_limit": tokens > limit}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_bytes": [], "n_tokens": [], "over_limit": []})

    whole = blocks.select("block", "doc_id", "n_bytes", "sizes", "places", "counts")
    return counted.groupBy("block").cogroup(whole.groupBy("block")).applyInPandas(sums, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
