"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of 1 to 3 characters (letters lower-cased, everything else
one blank), hashed to ``BUCKETS``; their document frequencies are counted over
all documents that may be learnt from and have a language. Training is
follow-the-regularised-leader with elastic-net penalties on a bounded sample of
these, in ``SHARDS`` parts whose states are averaged after every epoch. Every
language gives its share of ``MAX_LABELLED`` documents, but ``LEAST`` or all it has where that
is less, and the documents of a language with fewer than ``LEAST`` are shown again and again, so that a
rare one is learnt from whatever the size of the corpus. A further part of the sample sets the temperature. The size of the model is set by
the number of languages.

Defined cases: a text that is null or holds no letter is ``und`` with score 0.
Without any label to learn from every text is ``und``. Very long texts are read
whole. Equal probabilities go to the smaller language code. Repeated rows get a
row each. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.llm.frames import discard, keep_in_folder, pick

BUCKETS = 1 << 15
MAX_LABELLED = 20_000  # labelled documents that the classifier is fitted on, about, besides those of rare languages
LEAST = 200  # documents of a language that are taken, if there are as many
CALIBRATE = 10  # one of so many of them sets the temperature instead
SHARDS, EPOCHS = 8, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5  # step size and elastic-net penalties
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of a whole text; empty if it holds no letter."""
    chars = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[chars]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters the first stays, as a blank
    x = np.concatenate([[32], np.where(letter, chars, 32)[keep], [32]]).astype(np.uint32)
    out = []
    for n in (1, 2, 3):
        h = np.full(len(x) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ x[i : len(x) - n + 1 + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        out.append((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 15))
    return np.concatenate(out).astype(np.int64)


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(grams(text), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets + 1 (the constant) by languages
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[at]
        return v / max(np.linalg.norm(v), 1e-12)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.weights[BUCKETS]

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = _counts(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(at, counts) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, *, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents and, for every bucket, in how many it occurs, over all rows."""

    def count(batches):
        found, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                at, _ = _counts(t.as_py())
                found[at] += 1
                n += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], names=["bucket", "n"])

    rows = pick(docs, text=text).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    at, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _follow(z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, label: int) -> None:
    """One step of the regularised leader on one document."""
    w = _weights(z[at], n[at])
    p = _softmax(x @ w)
    p[label] -= 1
    g = x[:, None] * p
    before = n[at]
    n[at] = before + g * g
    z[at] += g - (np.sqrt(n[at]) - np.sqrt(before)) / ALPHA * w


def _pack(a: np.ndarray) -> bytes:
    return a.astype(np.float32).tobytes()


def fit(docs: DataFrame, may_learn: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        max_labelled: int = MAX_LABELLED, least: int = LEAST, epochs: int = EPOCHS, shards: int = SHARDS) -> Model:
    """Fit on a sample of the documents with a language among those that ``may_learn`` (over doc_id) names.

    The sample has about ``max_labelled`` documents and up to ``least`` more of each language.
    """
    labelled = pick(docs, doc_id=doc_id, text=text, lang=lang).where(may_learn & F.col("lang").isNotNull())
    total, frequency = document_frequencies(labelled)
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)
    pace = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    each = labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each language, as the model has columns
    share = F.greatest(F.lit(max_labelled / max(total, 1)), least / F.col("_n"))
    times = F.greatest(F.lit(1), F.ceil(least / F.col("_n"))).cast("int")  # documents of a language that has few are shown again
    quota = F.broadcast(each.select("_lang", times.alias("times"), F.ceil(F.least(F.lit(1.0), share) * 1_000_003).alias("_quota")))
    chosen = labelled.join(quota, F.col("lang") == F.col("_lang")).where(pace < F.col("_quota")).withColumn("pace", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)).cast("int"))

    def features(batches):
        for batch in batches:
            made = [_counts(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), batch.column(2), batch.column(3), pa.array([a.astype(np.uint16).tobytes() for a, _ in made], pa.binary()),
                pa.array([c.astype(np.uint32).tobytes() for _, c in made], pa.binary())], names=["lang", "pace", "times", "at", "counts"])

    sample = keep_in_folder(chosen.select("text", "lang", "pace", "times").mapInArrow(features, "lang string, pace int, times int, at binary, counts binary"), "langid-sample")
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().toLocalIterator())
    model = Model(langs, idf, np.zeros((BUCKETS + 1, len(langs)), np.float32))
    if len(langs) < 2:
        return model
    shape, number = model.weights.shape, {v: i for i, v in enumerate(langs)}
    z, n = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    seen = sample.where((F.col("pace") % CALIBRATE != 0) | (F.col("times") > 1)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    train = seen.withColumn("shard", (F.col("pace") + F.col("copy")) % shards)
    spark = docs.sparkSession
    for epoch in range(epochs):
        state = spark.sparkContext.broadcast((z, n))

        def learn(table):
            z, n = (a.copy() for a in state.value)
            rows = sorted(table.to_pylist(), key=lambda r: ((r["pace"] + r["copy"]) * 2654435761 + epoch * 40503) % (1 << 31))
            for r in rows:
                at = np.frombuffer(r["at"], np.uint16).astype(np.int64)
                x = model.vector(at, np.frombuffer(r["counts"], np.uint32))
                _follow(z, n, np.append(at, BUCKETS), np.append(x, np.float32(1)), number[r["lang"]])
            return pa.table({"z": pa.array([_pack(z)], pa.binary()), "n": pa.array([_pack(n)], pa.binary())})

        states = train.groupBy("shard").applyInArrow(learn, "z binary, n binary").collect()  # at most ``shards`` rows of fixed size
        z, n = (np.mean([np.frombuffer(s[k], np.float32).reshape(shape) for s in states], axis=0) for k in ("z", "n"))
    model.weights = _weights(z, n).astype(np.float32)
    held = sample.where(F.col("pace") % CALIBRATE == 0).toArrow().to_pandas()
    logits = np.array([model.logits(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(c, np.uint32)) for a, c in zip(held["at"], held["counts"])])
    discard(sample)
    model.temperature = temperature(logits, np.array([number[v] for v in held["lang"]], int))
    return model


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which the labels are likeliest; 1 if there are none."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / t)[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    return float(min(np.geomspace(0.05, 10, 200), key=loss))


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred and score, the probability of that language."""
    kept = pick(docs, doc_id=doc_id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    schema = kept.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return kept.mapInArrow(run, schema)
