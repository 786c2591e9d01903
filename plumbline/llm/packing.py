"""Packing documents into sequences by cutting-stock column generation over a histogram of lengths."""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import arrow_schema, texts, written
from plumbline.llm.tokens import default_path, encoder

#: One remainder in FILLER is kept with its ids and cut freely to fill what the patterns leave open.
FILLER = 16
#: Fillers that one group of gaps gets, on average.
FILL_GROUP = 16
#: Rows of one rank window, on average, if a single length held them all.
GROUP_ROWS = 200_000
#: The linear program ends when its value is so near to the lower bound.
GAP = 2e-3
_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, kind int, slot long, ids binary"


def top_length(length: int) -> int:
    """Largest length of a histogram bin: exact up to 32, then 16 bins to each doubling."""
    if length <= 32:
        return length
    width = 1 << ((length - 1).bit_length() - 5)
    return -(-length // width) * width


def pieces_of(rows: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """Cuts each document into full sequences (kind 0) and a remainder (kind 1, or 2 with its ids: a filler)."""
    struct = T._parse_datatype_string(_PIECES)
    schema = arrow_schema(struct)
    last = np.array([end_id], "<u4").tobytes()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, slot, seen = encoder(path), TaskContext.get().partitionId() << 33, 0
        for batch in source:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.texts(batch.column(1).to_pylist())):
                ids += last
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    length = len(part) // 4
                    kind = 0
                    if length < size:
                        kind, seen = (1 if seen % FILLER else 2), seen + 1
                    out.append((doc_id, start, length, zlib.crc32(part), n, kind, slot, part if kind == 2 else None))
                    slot += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], type=f.type) for f in schema], schema=schema)

    return rows.mapInArrow(run, struct)


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over capacities: the dearest pattern at these prices, as counts."""
    best = np.zeros(capacity + 1)
    order = np.flatnonzero(prices > 1e-12)
    for i in order:
        weight, value = int(sizes[i]), prices[i]
        while weight <= capacity:  # one, two, four ... more of this size: any number of them
            np.maximum(best[weight:], best[:-weight] + value, out=best[weight:])
            weight, value = weight * 2, value * 2
    counts, room = np.zeros(len(sizes), np.int64), capacity
    weights, values = sizes[order], prices[order]
    while room > 0:
        fits = weights <= room
        worth = np.where(fits, best[np.where(fits, room - weights, 0)] + values, -1.0)
        i = int(worth.argmax()) if len(worth) else 0
        if not len(worth) or worth[i] < best[room] - 1e-9 or worth[i] <= 0:
            room -= 1
        else:
            counts[order[i]] += 1
            room -= weights[i]
    return float(best[capacity]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Patterns ``(times, counts by size)`` that hold ``demand[i]`` items of each size exactly.

    Column generation: a revised simplex over the patterns, whose duals price sizes; the knapsack gives the next
    pattern until the value is within GAP of Farley's bound; a surplus column lets a size be held too often, which rounding cuts. The solution is rounded down, and what is left over (a
    few items of each size) goes into patterns of its own by first fit on the histogram.
    """
    m = len(sizes)
    if not m:
        return []
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(m)]
    inverse = np.diag([1.0 / columns[i][i] for i in range(m)])
    basis, cost = list(range(m)), np.ones(m)
    x = inverse @ demand
    for _ in range(50 * m):
        prices = cost @ inverse
        enters = 1.0
        if prices.min() < -1e-9:  # holding one item too many of a size costs nothing
            pattern, enters = -np.eye(m, dtype=np.int64)[int(prices.argmin())], 0.0
        else:
            worth, pattern = best_pattern(sizes, np.maximum(prices, 0.0), capacity)
            if worth <= 1 + 1e-9 or 1 - 1 / worth <= GAP:
                break
        direction = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-10, x / direction, np.inf)
        row = int(ratio.argmin())
        step = ratio[row]
        x = np.maximum(x - step * direction, 0.0)
        x[row] = step
        inverse[row] /= direction[row]
        others = np.arange(m) != row
        inverse[others] -= np.outer(direction[others], inverse[row])
        columns.append(pattern)
        basis[row], cost[row] = len(columns) - 1, enters
    else:
        warnings.warn(f"the linear program stopped {50 * m} columns on, before it came within {GAP} of its bound", stacklevel=2)
    left, out = demand.astype(np.int64).copy(), []
    for row, times in zip(basis, x):
        pattern = columns[row]
        if pattern.min() < 0:
            continue
        times = int(min([np.floor(times + 1e-9), *(left[pattern > 0] // pattern[pattern > 0])]))
        if times > 0:
            out.append((times, pattern))
            left -= times * pattern
    while left.any():
        room, pattern = capacity, np.zeros(m, np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((times, pattern))
        left -= times * pattern
    return out


def slots(pieces: DataFrame, size: int) -> DataFrame:
    """Adds ``sequence`` to remainders: patterns of lengths go to documents ranked within their length."""
    spark = pieces.sparkSession
    bins = [top_length(n) for n in range(size)]
    rest = pieces.where("kind = 1").withColumn("bin", F.element_at(F.array(*map(F.lit, bins)), F.col("length") + 1))
    histogram = sorted((r["bin"], r["n"]) for r in rest.groupBy("bin").agg(F.count("*").alias("n")).collect())  # a row per bin: under size of them
    salts = max(64, -(-sum(n for _, n in histogram) // GROUP_ROWS))
    patterns = cutting_stock(np.array([b for b, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64), size)
    first, taken, ranges = 0, dict.fromkeys((b for b, _ in histogram), 0), []
    for times, counts in patterns:
        for (b, _), each in zip(histogram, counts.tolist()):
            if each:
                ranges.append((b, taken[b], taken[b] + each * times, times, first))
                taken[b] += each * times
        first += times
    # A row per pattern and length in it: bounded by the number of bins, whatever the input.
    ranges = spark.createDataFrame(ranges, "bin int, low long, high long, times long, first long")
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("slot"), F.lit(salts)))
    before = Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = rest.groupBy("bin", "salt").agg(F.count("*").alias("n")).select("bin", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bin", "salt").orderBy(F.desc("length"), "slot")) - 1
    ranked = rest.withColumn("rank", rank).join(counts.hint("merge"), ["bin", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.join(F.broadcast(ranges.withColumnRenamed("bin", "of")), (F.col("bin") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return ranked.withColumn("sequence", F.col("first") + F.pmod(F.col("rank") - F.col("low"), F.col("times")))


def fill(gaps: DataFrame, fillers: DataFrame, size: int) -> DataFrame:
    """Cuts fillers to fill the gaps of their group; what is over makes sequences of its own, the last ones powers of two."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(holes: pd.DataFrame, stock: pd.DataFrame) -> pd.DataFrame:
        stock, holes = stock.sort_values("slot"), holes.sort_values(["gap", "sequence_id"])
        over = int(stock["length"].sum())
        places: list[tuple[int, int, int]] = []  # sequence, offset, room
        for sequence, used, gap in zip(holes["sequence_id"].tolist(), holes["used"].tolist(), holes["gap"].tolist()):
            if gap > over:
                break
            places.append((sequence, used, gap))
            over -= gap
        # Numbered by group: a group may make more sequences than lie between its slots and another group's.
        fresh = (int(stock["deal"].iloc[0]) << 24) * 4 + 2 if len(stock) else 0
        while over:
            room = size if over >= size else 1 << (over.bit_length() - 1)
            places.append((fresh, 0, room))
            fresh, over = fresh + 4, over - room
        out, at = [], iter(places)
        sequence = offset = room = 0
        for doc_id, start, length, tokens, ids in zip(stock["doc_id"].tolist(), stock["start"].tolist(), stock["length"].tolist(), stock["doc_tokens"].tolist(), stock["ids"].tolist()):
            done = 0
            while done < length:
                if not room:
                    sequence, offset, room = next(at)
                cut = min(room, length - done)
                part = bytes(ids[4 * done : 4 * (done + cut)])
                out.append((None if pd.isna(doc_id) else int(doc_id), start + done, cut, zlib.crc32(part), tokens, sequence, offset))
                done, offset, room = done + cut, offset + cut, room - cut
        frame = pd.DataFrame(out, columns=names)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return gaps.groupBy("deal").cogroup(fillers.groupBy("deal")).applyInPandas(run, schema)


def pack(documents: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``size`` tokens; one row per piece of a document.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. A document is its ids and ``end_id``; it is cut
    into full sequences and a remainder. The remainders' lengths, in bins, are a cutting-stock problem, solved by
    column generation over 16 bins per doubling, so the driver's work doesn't grow with the input. The
    rounded patterns take the ranked documents of each bin. One remainder in FILLER stays out of the patterns and
    is cut freely instead: it fills the gaps that bins and rounding leave, and the rest of it makes sequences whose
    lengths are ``size`` or powers of two, which need no padding.

    Cut pieces are a written table, so that a task run again finds the same slots. Ranks come from (bin, salt) groups of
    bounded size and gaps are dealt out with their fillers, so no group grows with the input. Null and empty texts are
    ``end_id`` alone; ids may be null or repeat (each row is a document); an empty table gives an empty result; other
    columns are not read.
    """
    if size > 2048:
        raise ValueError("the histogram is made for sequences of up to 2048 tokens")
    return place(written(pieces_of(texts(documents, id_col, text_col), path or default_path(), size, end_id), "pieces"), size)


def place(pieces: DataFrame, size: int) -> DataFrame:
    """Sequences and offsets of cut pieces, a written table: full ones alone, remainders by patterns, fillers into the gaps."""
    columns = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens"]
    whole = pieces.where("kind = 0").select(*columns, (F.col("slot") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    own = Window.partitionBy("sequence")
    # The written table is compact; the window's rows leave out the ids, which remainders of this kind don't have.
    placed = slots(pieces.drop("ids"), size)
    placed = written(placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "slot"), "placed")
    so_far = F.sum("length").over(own.orderBy(F.desc("length"), "slot").rowsBetween(Window.unboundedPreceding, 0))
    rest = placed.select(*columns, (F.col("sequence") * 4 + 1).alias("sequence_id"), (so_far - F.col("length")).alias("offset"))
    used = placed.groupBy("sequence").agg(F.sum("length").alias("used")).where((F.col("used") < size) & (F.expr("used & (used - 1)") != 0))
    fillers = pieces.where("kind = 2").select("doc_id", "start", "length", "doc_tokens", "slot", "ids")
    groups = max(64, -(-fillers.count() // FILL_GROUP))
    gaps = used.select((F.col("sequence") * 4 + 1).alias("sequence_id"), "used", (F.lit(size) - F.col("used")).alias("gap"), F.pmod(F.xxhash64("sequence"), F.lit(groups)).alias("deal"))
    filled = fill(gaps, fillers.withColumn("deal", F.pmod(F.xxhash64("slot"), F.lit(groups))), size)
    return whole.unionByName(rest).unionByName(filled)
