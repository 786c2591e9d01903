"""Terms, vocabulary and TF-IDF as relations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fewest documents of a term, and size of the vocabulary.
MIN_DF, MAX_TERMS = 3, 50_000
_FROM, _TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Bytes and rows of texts whose terms are counted at once (a longer text alone), and rows of a batch that a worker sends back.
CHUNK, CHUNK_ROWS, SENT = 2 << 20, 10_000, 500_000


def spaced(text: Column) -> Column:
    """A text in lower case, with one blank for whatever lies between its words."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", " ")


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of neighbours that have CHUNK bytes and CHUNK_ROWS rows together at most; a longer text is alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, min(int(np.searchsorted(ends, before + CHUNK, "right")), start + CHUNK_ROWS))
        yield start, end
        start = end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of ``spaced`` texts: two or more characters, without accents. And each place's text and word, in order."""
    split = pc.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = split.flatten().dictionary_encode()
    # Letters stand for letters, so words may be told apart first, and only distinct ones lose their accents: all at once, as lines.
    lines = "\n".join(coded.dictionary.to_pylist())
    for accented, plain in zip(_FROM, _TO):
        lines = lines.replace(accented, plain)
    folded = pa.array(lines.split("\n"), pa.string()).dictionary_encode()
    code = folded.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64) if len(row) else np.zeros(0, np.int64)
    kept = pc.greater_equal(pc.utf8_length(folded.dictionary), 2).to_numpy(zero_copy_only=False)[code] if len(row) else np.zeros(0, bool)
    return folded.dictionary, row[kept], code[kept]


def pairs_of(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of neighbouring words, and both words."""
    same = row[1:] == row[:-1]
    return row[1:][same], code[:-1][same], code[1:][same]


def runs(values: np.ndarray) -> np.ndarray:
    """Where equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def counted(texts: pa.Array, ngrams: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and for each term of each text the term's number, the text and how often it occurs; by term, then text.

    Numbers below that of words are words; the others are pairs, first and second word as digits.
    """
    words, row, term = words_of(texts)
    width = len(words)
    if ngrams > 1:
        of, a, b = pairs_of(row, term)
        row, term = np.concatenate([row, of]), np.concatenate([term, width + a * width + b])
    held = np.sort(term * len(texts) + row)
    first = runs(held)
    return words, held[first] // len(texts), held[first] % len(texts), np.diff(np.append(first, len(held)))


def named(words: pa.Array, terms: np.ndarray) -> pa.Array:
    """The terms of ascending numbers of ``counted``."""
    single, width = int(np.searchsorted(terms, len(words))), max(1, len(words))
    pairs = terms[single:] - len(words)
    spelled = pc.binary_join_element_wise(words.take(pa.array(pairs // width)), words.take(pa.array(pairs % width)), " ")
    return pa.concat_arrays([words.take(pa.array(terms[:single])), spelled])


def _texts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    for start, end in chunks(column):
        yield start, column.slice(start, end - start)


def parted(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and the others, if there are any. Only keys are looked at to find out."""
    repeated = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    if repeated.isEmpty():
        return df, None
    of = lambda kind: df.hint("merge").join(repeated.hint("merge"), F.col(key).eqNullSafe(F.col("_key")), kind)
    return of("left_anti"), of("left_semi")


def row_counts(df: DataFrame, key: str, text: str, ngrams: int = 2) -> DataFrame:
    """``key, term, tf`` of each row by itself: a row's terms are counted where it is read, and nothing moves."""
    kind = df.schema[key].dataType
    struct = T.StructType([T.StructField(key, kind), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _texts(batch.column(1)):
                words, term, row, tf = counted(texts, ngrams)
                first = runs(term)
                own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term))))
                for at in range(0, len(term), SENT):
                    some = own[at : at + SENT]
                    names = named(words, term[first[some[0] : some[-1] + 1]]).take(pa.array(some - some[0]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at : at + SENT] + start)), names, pa.array(tf[at : at + SENT], pa.int64())], [key, "term", "tf"])

    return df.select(key, spaced(F.col(text)).alias("_words")).mapInArrow(run, struct)


def term_counts(df: DataFrame, key: str, text: str, ngrams: int = 2) -> DataFrame:
    """``key, term, tf``: words of two or more word characters, lower case and without accents, and pairs of neighbours.

    Rows are counted by themselves; only those of keys that repeat are then summed by key.
    """
    own, others = parted(df.select(key, text), key)
    out = row_counts(own, key, text, ngrams)
    return out if others is None else out.unionByName(row_counts(others, key, text, ngrams).groupBy(key, "term").agg(F.sum("tf").alias("tf")))


def row_frequencies(df: DataFrame, text: str, ngrams: int = 2) -> DataFrame:
    """``term, df, cf``, each as a task's rows have it, in parts that are to be summed: texts are counted chunk by chunk, and pairs spelled once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _texts(batch.column(0)):
                words, term, _, tf = counted(texts, ngrams)
                first = runs(term)
                docs, all_ = np.diff(np.append(first, len(term))), np.add.reduceat(tf, first) if len(first) else tf
                for at in range(0, len(first), SENT):
                    yield pa.RecordBatch.from_arrays([named(words, term[first[at : at + SENT]]), pa.array(docs[at : at + SENT], pa.int64()), pa.array(all_[at : at + SENT], pa.int64())], ["term", "df", "cf"])

    return df.select(spaced(F.col(text)).alias("_words")).mapInArrow(run, "term string, df long, cf long")


def vocabulary(df: DataFrame, text: str, key: str | None = None, ngrams: int = 2, min_df: int = MIN_DF, max_terms: int = MAX_TERMS) -> DataFrame:
    """``term, df, cf``: the most frequent terms of those that enough documents hold; without ``key``, each row is a document."""
    own, others = (df, None) if key is None else parted(df.select(key, text), key)
    parts = row_frequencies(own, text, ngrams)
    if others is not None:
        summed = row_counts(others, key, text, ngrams).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
        parts = parts.unionByName(summed.select("term", F.lit(1).cast("long").alias("df"), F.col("tf").alias("cf")))
    per = parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where(F.col("df") >= min_df)
    return per.orderBy(F.desc("cf"), "term").limit(max_terms)


def tfidf(df: DataFrame, key: str, text: str, ngrams: int = 2, min_df: int = MIN_DF, max_terms: int = MAX_TERMS) -> DataFrame:
    """``key, term, weight``: (1 + ln tf) times (ln((1 + n) / (1 + df)) + 1), each document of length one.

    A row is weighted where it is read; only rows of keys that repeat are put together first.
    """
    df = df.select(key, text)
    model = fitted(vocabulary(df, text, key, ngrams, min_df, max_terms), df.count(), text, ngrams)
    own, others = parted(df, key)
    out = named_weights(model, model.transform(own), key)
    if others is None:
        return out
    known = F.broadcast(df.sparkSession.createDataFrame(list(zip(model.terms, model.idf)), "term string, idf double"))  # at most max_terms rows
    counts = row_counts(others, key, text, ngrams).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    raw = counts.join(known, "term").select(F.col(key), "term", ((1 + F.ln(F.col("tf").cast("double"))) * F.col("idf")).alias("w"))
    norms = raw.groupBy(F.col(key).alias("_key")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    met = raw.hint("merge").join(norms.hint("merge"), F.col(key).eqNullSafe(F.col("_key")))
    return out.unionByName(met.select(key, "term", (F.col("w") / F.col("norm")).alias("weight")))


def fitted(known: DataFrame, n: int, text: str, ngrams: int) -> TermWeightsModel:
    """The model of a ``vocabulary`` over ``n`` documents; the vocabulary has max_terms rows at most."""
    rows = sorted(known.collect(), key=lambda r: (-r["cf"], r["term"]))
    return TermWeightsModel(text, ngrams, [r["term"] for r in rows], [math.log((1 + n) / (1 + r["df"])) + 1 for r in rows])


def named_weights(model: TermWeightsModel, weighted: DataFrame, key: str) -> DataFrame:
    """``key, term, weight`` of rows with ``_i`` and ``_v``."""
    # Outer, and then filtered: else Spark would test the array's size first, and make it twice.
    rows = weighted.select(key, F.explode_outer(F.arrays_zip("_i", "_v")).alias("x")).where("x IS NOT NULL")
    terms = weighted.sparkSession.createDataFrame(list(enumerate(model.terms)), "i int, term string")  # max_terms rows at most
    return rows.join(F.broadcast(terms), F.col("x._i") == F.col("i")).select(key, "term", F.col("x._v").alias("weight"))


class TermWeights(Estimator):
    """Learns the vocabulary and the weights of ``tfidf`` from a text column; ``fit`` gives a ``TermWeightsModel``."""

    def __init__(self, text: str, ngrams: int = 2, min_df: int = MIN_DF, max_terms: int = MAX_TERMS):
        super().__init__()
        self.text, self.ngrams, self.min_df, self.max_terms = text, ngrams, min_df, max_terms

    def _fit(self, dataset: DataFrame) -> TermWeightsModel:
        known = vocabulary(dataset, self.text, None, self.ngrams, self.min_df, self.max_terms)
        return fitted(known, dataset.count(), self.text, self.ngrams)


class TermWeightsModel(Model):
    """Adds ``_i array<int>`` and ``_v array<double>``: places in the vocabulary and weights of each text's terms, as rows of ``tfidf`` have them.

    Terms are looked up by numbers of their words, chunk by chunk. Null and empty texts have no terms.
    """

    def __init__(self, text: str, ngrams: int, terms: list[str], idf: list[float]):
        super().__init__()
        self.text, self.ngrams, self.terms, self.idf = text, ngrams, terms, idf

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ngrams, state = self.ngrams, dataset.sparkSession.sparkContext.broadcast(Places(self.terms, self.idf))

        @F.arrow_udf("struct<i:array<int>,v:array<double>>")
        def weights(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in parts:
                yield pa.concat_arrays([state.value.weights(texts, ngrams) for _, texts in _texts(column)]) if len(column) else pa.array([], _WEIGHTS)

        held = dataset.withColumn("_held", weights(spaced(F.col(self.text))))
        return held.withColumns({"_i": F.col("_held.i"), "_v": F.col("_held.v")}).drop("_held")


_WEIGHTS = pa.struct([("i", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))])


class Places:
    """A vocabulary by its words: the place of each word that is a term, and the sorted pairs of words that are terms."""

    def __init__(self, terms: list[str], idf: list[float]):
        parts = [t.split(" ") for t in terms]
        words = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
        self.words, self.idf = pa.array(list(words), pa.string()), np.array(idf, float)
        self.single = np.full(len(words) + 1, -1)
        pairs = {}
        for place, p in enumerate(parts):
            if len(p) == 1:
                self.single[words[p[0]]] = place
            else:
                pairs[words[p[0]] * len(words) + words[p[1]]] = place
        self.pairs = np.array(sorted(pairs), np.int64)
        self.places = np.array([pairs[k] for k in sorted(pairs)], np.int64)

    def weights(self, texts: pa.Array, ngrams: int) -> pa.Array:
        words, row, code = words_of(texts)
        unknown, n = len(self.words), len(texts)
        number = pc.fill_null(pc.index_in(words, self.words), unknown).to_numpy(zero_copy_only=False).astype(np.int64)
        code = number[code]
        at, of = self.single[code], row
        if ngrams > 1 and len(self.pairs):
            pair_of, a, b = pairs_of(row, code)
            met = (a < unknown) & (b < unknown)
            asked = a[met] * unknown + b[met]
            spot = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
            at, of = np.concatenate([at, np.where(self.pairs[spot] == asked, self.places[spot], -1)]), np.concatenate([of, pair_of[met]])
        width = max(1, len(self.idf))
        held = np.sort(of[at >= 0] * width + at[at >= 0])
        first = runs(held)
        row, place = held[first] // width, held[first] % width
        w = (1 + np.log(np.diff(np.append(first, len(held))))) * self.idf[place]
        w /= np.sqrt(np.bincount(row, w * w, n))[row]
        ends = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w))], fields=list(_WEIGHTS))


def term_audit(df: DataFrame, key: str, text: str, labels: DataFrame, y: str, terms: list[str]) -> DataFrame:
    """``term, docs, rate``: how many labelled documents hold a term, and their share of positives."""
    low = df.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    held = low.hint("merge").join(labels.select(key, F.col(y).alias("y")).hint("merge"), key)
    found = held.select("y", F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains("low", t))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("docs"), F.avg(F.col("y").cast("double")).alias("rate"))
