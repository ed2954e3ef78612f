"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's lower-cased characters give hashed n-grams of one to three characters over the whole text. Weights are
trained by follow-the-regularised-leader (proximal) with elastic-net penalties, so most are exactly zero; a
temperature fitted on rows kept aside calibrates the scores. The classifier is fitted on a bounded sample of
labelled rows: at most `sample` rows (parameter), shared evenly by the languages, picked by a hash of the id.
Predictions use the text only.

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled row every text
is `und`; equal texts give equal results; ties go to the first language in order; repeated rows come back once
each; an empty table gives an empty table; other columns pass unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

UNKNOWN = "und"
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
LENGTHS = (1, 2, 3)
#: Labelled rows that the classifier is fitted on, at most; and the least share of a language.
SAMPLE, LEAST_PER_LANG = 2400, 20
#: Languages that are learnt, at most: those with the most labelled rows, ties in order of their names.
LANGS = 1000
#: Characters that are turned into n-grams at a time.
PIECE = 1 << 20
_WORD_SIGN = re.compile(r"[^\W\d_]")
_FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category; signs such as fractions and superscripts are words' signs, but no letters."""
    return any(m[0].isalpha() for m in _WORD_SIGN.finditer(text))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and their counts, by vectorised hashing; the text is read in pieces."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    longest = LENGTHS[-1]
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE + longest - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            h = (h[:size] ^ part[n - 1 : n - 1 + size]) * _FACTORS[n - 1]
            h ^= h >> np.uint32(15)
            counts += np.bincount(h[:PIECE] >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-9)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*ngrams(text)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, aside: int = 5) -> Model:
    """rows: language, buckets, counts. Every `aside`-th row is kept for the temperature."""
    langs = sorted({r[0] for r in rows})
    seen = np.zeros(BUCKETS)
    for _, at, _ in rows:
        seen[at] += 1
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    model = Model(langs, idf, np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs), np.float32), 1.0)
    if len(langs) < 2:
        return model
    number = {x: i for i, x in enumerate(langs)}
    order = np.random.default_rng(7).permutation(len(rows))
    kept = [rows[i] for i in order[::aside]] if len(rows) >= 5 * aside else []
    learnt = [i for k, i in enumerate(order) if not kept or k % aside]
    # the last feature is the bias
    z, n = np.zeros((BUCKETS + 1, len(langs))), np.zeros((BUCKETS + 1, len(langs)))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) > l1, w, 0)

    vectors = {i: np.append(model.vector(rows[i][1], rows[i][2]), 1.0) for i in learnt}
    places = {i: np.append(rows[i][1], BUCKETS) for i in learnt}
    for _ in range(epochs):
        for i in learnt:
            at, x = places[i], vectors[i]
            w = weights(at)
            error = _softmax(x @ w)
            error[number[rows[i][0]]] -= 1
            g = x[:, None] * error[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    full = weights(slice(None))
    model.weights, model.bias = full[:-1].astype(np.float32), full[-1].astype(np.float32)
    if kept:
        logits = np.array([model.logits(r[1], r[2]) for r in kept])
        truth = np.array([number[r[0]] for r in kept])

        # smoothed targets, as in Platt scaling: rows without an error don't drive the temperature to zero
        soft = 1 / (len(kept) + 2)

        def loss(log_t: float) -> float:
            s = logits / np.exp(log_t)
            s = s - s.max(1, keepdims=True)
            p = s - np.log(np.exp(s).sum(1))[:, None]
            right = p[np.arange(len(s)), truth]
            return float(-((1 - soft) * right + soft * (p.sum(1) - right) / (len(langs) - 1)).mean())

        low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def train(docs: DataFrame, learn: Column, doc: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, langs: int = LANGS) -> Model:
    """Fit on at most `sample` rows (or LEAST_PER_LANG of each language, if that is more) of docs where `learn` holds.

    The `langs` languages with the most rows are learnt, so that a dirty column brings no more to the driver.
    """
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}"))
    labelled = rows.select(F.col(doc).alias("doc"), F.col(lang).alias("lang"))
    # a row a language, `langs` at most
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()}
    if not counts:
        return Model([], np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    each = max(LEAST_PER_LANG, sample // len(counts))
    # only rows whose hash is low enough to be among the first `each` of their language, with a wide margin, are ranked
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (2 * each + 100) / n)))])
    # (a language that is not learnt has no share)
    low = (F.xxhash64("doc").cast("double") / 2.0**64 + 0.5) <= share[F.col("lang")]
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc"), "doc")
    picked = labelled.where(low).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= each).select("doc", "lang").distinct()
    chosen = rows.select(F.col(doc).alias("doc"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(picked, ["doc", "lang"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, counts = zip(*(ngrams(t.as_py()) for t in b.column(2)), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["doc", "lang", "at", "counts"])

    schema = T.StructType([chosen.schema["doc"], chosen.schema["lang"], T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.FloatType()))])
    found = chosen.mapInArrow(run, schema).toArrow().sort_by([("lang", "ascending"), ("doc", "ascending")])
    # a repeated id may bring more rows than were picked: the bound holds for them too
    got, held = [], {}
    for k, a, c in zip(found.column("lang").to_pylist(), found.column("at"), found.column("counts"), strict=True):
        held[k] = held.get(k, 0) + 1
        if held[k] <= each:
            got.append((k, a.values.to_numpy(), c.values.to_numpy()))
    return fit(got)


def identify(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its calibrated probability; columns of these names are replaced."""
    docs = docs.drop(pred, score)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*b.schema.names, pred, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def fold(doc: str = "doc_id") -> Column:
    """Remainder by three of the CRC-32 of the id as text."""
    return F.crc32(F.col(doc).cast("string").cast("binary")) % 3


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, fold() != 1)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score")
