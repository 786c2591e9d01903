"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata."""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches

#: Labelled rows that the model is fitted on, at most; scores and everything else cover all rows.
SAMPLE = 12_000
#: Hash buckets of words, factors, passes over the sample, rows of a step, and step size.
BUCKETS, FACTORS, PASSES, STEP_ROWS, RATE = 1 << 15, 8, 6, 128, 0.1
# Bytes of letters and digits become one class each; all others stay.
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
STATISTICS = 16
#: Features of the rows that are scored at once.
TOGETHER = 16_000


def words_and_shapes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words and word shapes, and their weights (logarithmic counts, of length one)."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_SHAPE), np.uint8)
    found = Counter(text.lower().split())
    # Runs of one class of letters or of digits become one.
    runs = (data[1:] == data[:-1]) & ((data[1:] == 97) | (data[1:] == 65) | (data[1:] == 48))
    shapes = Counter(np.concatenate([data[:1], data[1:][~runs]]).tobytes().split())
    keys = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in found] + [zlib.crc32(b"shape " + s) % BUCKETS for s in shapes]
    if not keys:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    weights = 1 + np.log(np.fromiter((*found.values(), *shapes.values()), np.float64, len(keys)))
    weights[: len(found)] /= np.sqrt((weights[: len(found)] ** 2).sum())
    weights[len(found) :] /= np.sqrt((weights[len(found) :] ** 2).sum())
    return np.array(keys, np.int32), weights.astype(np.float32)


def statistics(text: str) -> list[float]:
    """Structure of a text, and its size."""
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    data = text.encode("utf-8", "surrogatepass").translate(_SHAPE)
    letters, capitals, digits = data.count(b"a"), data.count(b"A"), data.count(b"0")
    blanks = sum(map(text.count, " \n\t\r"))
    return [
        np.log1p(n), np.log1p(m), np.log1p(len(lines)), len(text) / m, capitals / max(1, letters + capitals), digits / n,
        max(0, len(data) - letters - capitals - digits - blanks) / n, len(set(words)) / m, len(set(lines)) / max(1, len(lines)), len(data) / n - 1,
        text.count("|") / m, text.count("!") / m, text.count(".") / m, text.count(",") / m, sum(map(text.count, "#$%&*")) / m, float(not words),
    ]


class Machine:
    """y = w0 + w.x + sum of v_i.v_j x_i x_j over pairs, in time linear in the features of a row.

    The pairs' sum is half of (sum of v_i x_i) squared less the sum of (v_i x_i) squared, factor by factor.
    """

    def __init__(self, prior: float = 0.0, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.bias = np.array([prior])
        self.w = np.zeros(BUCKETS + STATISTICS)
        self.v = rng.normal(0, 0.02, (BUCKETS + STATISTICS, FACTORS))
        self.mean, self.scale = np.zeros(STATISTICS), np.ones(STATISTICS)

    def row(self, keys: np.ndarray, weights: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = np.clip((np.asarray(stats, np.float64) - self.mean) / self.scale, -3, 3) * 0.3
        return np.concatenate([keys, np.arange(BUCKETS, BUCKETS + STATISTICS)]), np.concatenate([weights, scaled])

    def margins(self, i: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins of rows whose features lie end to end from ``starts``, and the terms that gradients need."""
        vx = self.v[i] * x[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        return self.bias[0] + np.add.reduceat(self.w[i] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts)), vx, total

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of many texts, some of them at a time, so that memory is bounded by TOGETHER and one text."""
        out: list[np.ndarray] = [np.zeros(0)]
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for n, text in enumerate(texts):
            rows.append(self.row(*words_and_shapes(text), statistics(text)))
            held += len(rows[-1][0])
            if held >= TOGETHER or n == len(texts) - 1:
                ends = np.cumsum([len(i) for i, _ in rows])
                starts = np.concatenate([[0], ends[:-1]])
                margin = self.margins(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)[0]
                out.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
                rows, held = [], 0
        return np.concatenate(out)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 42) -> None:
        """Logistic loss by adaptive gradient steps over small batches, in an order that the seed fixes."""
        stats = np.array([r[2] for r in rows], np.float64)
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        share = np.clip(y.mean(), 0.01, 0.99)
        self.bias[0] = np.log(share / (1 - share))
        data = [self.row(*r) for r in rows]
        rng, past = np.random.default_rng(seed), [np.full(self.w.shape, 1e-4), np.full(self.v.shape, 1e-4)]
        for _ in range(PASSES):
            order = rng.permutation(len(data))
            for at in range(0, len(order), STEP_ROWS):
                chosen = order[at : at + STEP_ROWS]
                sizes = np.array([len(data[r][0]) for r in chosen])
                starts = np.cumsum(sizes) - sizes
                i, x = np.concatenate([data[r][0] for r in chosen]), np.concatenate([data[r][1] for r in chosen])
                owner = np.repeat(np.arange(len(chosen)), sizes)
                margin, vx, total = self.margins(i, x, starts)
                error = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y[chosen]
                slope = error[owner] / len(chosen)
                touched, place = np.unique(i, return_inverse=True)
                gw = np.bincount(place, weights=slope * x, minlength=len(touched)) + 1e-6 * self.w[touched]
                step = slope[:, None] * x[:, None] * (total[owner] - vx)
                gv = np.stack([np.bincount(place, weights=step[:, f], minlength=len(touched)) for f in range(FACTORS)], 1) + 1e-5 * self.v[touched]
                for values, g, seen, rate in ((self.w, gw, past[0], RATE), (self.v, gv, past[1], RATE / 5)):
                    seen[touched] += g * g
                    values[touched] -= rate * g / np.sqrt(seen[touched])
                self.bias[0] -= RATE * 0.1 * error.mean()

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, bias=self.bias, w=self.w.astype(np.float32), v=self.v.astype(np.float32), mean=self.mean, scale=self.scale)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Machine:
        self = cls.__new__(cls)
        held = np.load(io.BytesIO(data))
        self.bias, self.w, self.v, self.mean, self.scale = held["bias"], held["w"].astype(np.float64), held["v"].astype(np.float64), held["mean"], held["scale"]
        return self


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """A fitted machine from ``labels.quality`` (0 or 1) of at most ``sample`` rows, none of them held out.

    The sample's ids come from the labels alone, by hash order, and are broadcast (their number is the bound). An id gives one row,
    however often it is repeated: the least of its texts, by a map-side minimum, so no task gathers more than ``sample`` rows. One task
    fits the machine on these and only its weights reach the driver.
    Ids with several labels count with the largest; null ids, and labels other than 0 and 1, are left out. Without labels of
    both classes, the machine's scores are their share (0.5 if there are none).
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").cast("int").alias("y")).select("text", "y")

    def features(rows: dict) -> dict:
        made = [words_and_shapes(t) for t in rows["text"]]
        return {"keys": [k for k, _ in made], "weights": [w for _, w in made], "stats": [statistics(t) for t in rows["text"]], "y": rows["y"]}

    def train(made: pd.DataFrame) -> pd.DataFrame:
        # The order makes reruns agree.
        made = made.assign(order=[zlib.crc32(np.asarray(k).tobytes()) for k in made["keys"]]).sort_values(["order", "y"])
        y = made["y"].to_numpy(np.float64)
        machine = Machine()
        if 0 < y.mean() < 1:
            machine.fit(list(zip(made["keys"], made["weights"], made["stats"])), y)
        else:
            machine.bias[0] = np.log(0.99 / 0.01) * (1 if y.mean() else -1)
        return pd.DataFrame({"model": [machine.dump()]})

    made = batches(rows, features, "keys array<int>, weights array<float>, stats array<double>, y int")
    found = made.groupBy(F.lit("all")).applyInPandas(train, "model binary").collect()
    return bytes(found[0]["model"]) if found else Machine().dump()


def score(model: bytes, text: Column, spark) -> Column:
    """Score of each text (null: empty), as a column: one narrow pass wherever it is used."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Machine.load(held.value)
        for part in parts:
            yield pd.Series(machine.scores(part.tolist()), dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def quality_scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; only the text is an input of the score.

    Empty texts are scored like others. Ids may repeat or be null (then not held out); an empty table gives an empty
    result; other columns are not read.
    """
    model = fit(documents, labels, sample)
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text"), documents.sparkSession).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
