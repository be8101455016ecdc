"""Toxicity by class-conditional Kneser-Ney word models.

Two models, toxic and ordinary, give every word a probability after the word
before it. Counts are numbers of labelled documents. Both models interpolate
discounted pair counts with discounted word counts, and those with one shared
distribution: continuation counts (different words seen before a word) of both
classes together. The weights of these steps are shared as well, so that an
expression too rare to say anything has the same probability in both models and
adds nothing. A word's evidence is the log ratio of the two probabilities.

A text's evidence is normalised by its length in words. Besides the mean, the
mean of what exceeds ``MARGIN`` is taken: small ratios of very many common
words come from the mix of languages and sources, not from toxicity. A logistic
curve over these numbers, fitted on labelled documents that were not counted,
gives the score.

The models are fitted on at most ``MAX_LABELLED`` labelled documents and hold at
most ``MAX_ENTRIES`` words and as many pairs. Every document is scored, by its
whole text, in one pass without a shuffle.

Defined cases: a null or empty text has no evidence and is scored by the curve
alone. Without labels of both classes the score is the share of toxic labels (0
if there are none). A label other than 0 or 1 is not learnt. A document with
several labels counts as each. Repeated rows get a row each. Other columns are
not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.llm.frames import discard, keep_in_folder, pick
from grainfold.llm.words import mix, tokenise

MAX_LABELLED = 60_000  # labelled documents that the classifier is fitted on, at most
MAX_ENTRIES = 400_000  # words, and word pairs, that a model holds at most
CALIBRATE = 4  # one of so many labelled documents fits the curve instead of the models
DISCOUNT, MARGIN = 2.5, 1.5
_EPS = 3e-3


def _pair(prior: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of a word with the word before it."""
    return mix(prior * np.uint64(0x9E3779B97F4A7C15) ^ word)


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part), np.float64), where=whole > 0)


@dataclass
class Model:
    """Sorted hashes with the log ratios that the two models give; fixed arrays, so that a worker only looks up."""

    words: np.ndarray
    toxic: np.ndarray  # P(word) in the toxic model, and in the ordinary one
    ordinary: np.ndarray
    pairs: np.ndarray
    pair_toxic: np.ndarray  # what a pair adds: (1 - weight of the history) times its discounted share
    pair_ordinary: np.ndarray
    histories: np.ndarray
    backoff: np.ndarray  # weight of the word model after a history
    curve: np.ndarray | None = None  # mean, deviation, weights and constant of the logistic curve
    rate: float = 0.0

    def evidence(self, words) -> np.ndarray:
        """Log ratio of every word of a slice."""
        h, n = words.hash, len(words.hash)
        if not n or not len(self.words):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        p1, p0 = np.where(known, self.toxic[at], 1.0), np.where(known, self.ordinary[at], 1.0)
        if len(self.histories):
            # Only a known word can stand in a known pair.
            inner = np.flatnonzero(known[1:] & (words.doc[1:] == words.doc[:-1])) + 1
            prior = h[inner - 1]
            place = np.minimum(np.searchsorted(self.histories, prior), len(self.histories) - 1)
            follows = self.histories[place] == prior
            inner, place = inner[follows], place[follows]
            pair = _pair(h[inner - 1], h[inner])
            where = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
            met = self.pairs[where] == pair
            weight = self.backoff[place]
            p1[inner] = weight * p1[inner] + np.where(met, self.pair_toxic[where], 0)
            p0[inner] = weight * p0[inner] + np.where(met, self.pair_ordinary[where], 0)
        return np.log(p1 / p0)

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: mean evidence, mean excess, its logarithm, logarithm of the length."""
        out = np.zeros((len(texts), 4))
        for lo, hi, words in tokenise(texts):
            e = self.evidence(words)
            n = np.diff(words.bounds)
            for i, values in enumerate((e, np.maximum(e - MARGIN, 0))):
                out[lo:hi, i] = _ratio(np.bincount(words.doc, values, hi - lo), n)
            out[lo:hi, 3] = np.log1p(n)
        out[:, 2] = np.log(out[:, 1] + _EPS)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(features), self.rate)
        mean, deviation, weights = self.curve
        z = ((features - mean) / deviation) @ weights[:-1] + weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _count_task(batches):
    """(word before, word, documents of class 0, of class 1) of pairs, and of words with no word before; summed within the task now and then."""
    held: list[tuple] = []

    def flush():
        pair, prior, word, label = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.lexsort((word, prior, pair))
        pair, prior, word, label = pair[order], prior[order], word[order], label[order]
        first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (prior[1:] != prior[:-1]) | (pair[1:] != pair[:-1])))
        ones = np.add.reduceat(label, first)
        sizes = np.diff(np.append(first, len(word)))
        return pa.RecordBatch.from_arrays([
            pa.array(prior[first].view(np.int64), mask=~pair[first]), pa.array(word[first].view(np.int64)),
            pa.array((sizes - ones).astype(np.int32)), pa.array(ones.astype(np.int32))], names=["prior", "word", "ordinary", "toxic"])

    rows = 0
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
        for lo, _, words in tokenise(batch.column(0)):
            h = words.hash
            if not len(h):
                continue
            inner = np.flatnonzero(np.append(False, words.doc[1:] == words.doc[:-1]))
            for pair, take in ((False, np.arange(len(h))), (True, inner)):
                key = _pair(h[take - 1], h[take]) if pair else h
                own = mix(key + words.doc[take].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
                take = take[np.unique(own, return_index=True)[1]]  # once for every document
                prior = h[take - 1] if pair else np.zeros(len(take), np.uint64)
                held.append((np.full(len(take), pair), prior, h[take], labels[lo + words.doc[take]]))
                rows += len(take)
            if rows > 800_000:
                yield flush()
                rows = 0
    if held:
        yield flush()


def count(labelled: DataFrame) -> DataFrame:
    """Document counts of words (prior is null) and of pairs, by class, from columns text and toxic."""
    rows = labelled.select("text", "toxic").mapInArrow(_count_task, "prior bigint, word bigint, ordinary int, toxic int")
    return rows.groupBy("prior", "word").agg(F.sum("ordinary").cast("int").alias("ordinary"), F.sum("toxic").cast("int").alias("toxic"))


def _model(counts: DataFrame, max_entries: int) -> Model:
    """The two models. What is gathered is bounded: entries whose counts exceed the discount, the commonest if too many."""
    d = F.lit(DISCOUNT)
    both = F.col("ordinary") + F.col("toxic")
    strong = (F.col("ordinary") > d) | (F.col("toxic") > d)
    totals = counts.where("prior IS NULL").agg(F.sum(both).alias("n"), F.sum(F.least(F.col("ordinary"), d) + F.least(F.col("toxic"), d)).alias("held")).first()

    def gather(df: DataFrame, size: Column, *columns: Column | str):
        spread = df.groupBy(F.least(size.cast("int"), F.lit(1000)).alias("s")).count().toArrow().to_pandas().sort_values("s", ascending=False)
        fits = spread[spread["count"].cumsum() <= max_entries]["s"]
        least = int(fits.min()) if len(fits) else 1001
        return df.where(size >= least).select(*columns).toArrow().to_pandas()

    # Shared backoff: how many different words were seen before a word, in either class.
    met = counts.where("prior IS NOT NULL")
    before = met.groupBy("word").agg(F.count(F.lit(1)).alias("before"))
    words = counts.where(F.col("prior").isNull() & strong).drop("prior").join(before, "word", "left")
    table = gather(words, F.greatest("ordinary", "toxic"), "word", "ordinary", "toxic", F.coalesce("before", F.lit(1)).alias("before")).set_index("word")
    after = met.groupBy("prior").agg(F.sum(both).alias("total"))
    pairs = gather(met.where(strong).join(after, "prior"), F.greatest("ordinary", "toxic"), "prior", "word", "ordinary", "toxic", "total")
    empty = np.zeros(0)
    none = np.zeros(0, np.uint64)
    if not len(table) or not (table["toxic"] > DISCOUNT).any() or not (table["ordinary"] > DISCOUNT).any():
        return Model(none, empty, empty, none, empty, empty, none, empty)
    shared = table["before"].to_numpy(np.float64) / max(met.count(), 1)
    weight = float(totals["held"]) / float(totals["n"])
    prob = []
    for c in ("toxic", "ordinary"):
        left = np.maximum(table[c].to_numpy(np.float64) - DISCOUNT, 0)
        prob.append((1 - weight) * left / left.sum() + weight * shared)
    keys = table.index.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    # Histories: only those with a discounted pair in both classes bend the word model.
    h, one, at = np.unique(pairs["prior"].to_numpy(np.int64).view(np.uint64), return_index=True, return_inverse=True)
    left = {c: np.maximum(pairs[c].to_numpy(np.float64) - DISCOUNT, 0) for c in ("toxic", "ordinary")}
    mass = {c: np.bincount(at, left[c], len(h)) for c in left}
    kept = (mass["toxic"] + mass["ordinary"]) / np.maximum(pairs["total"].to_numpy(np.float64)[one], 1)
    good = (mass["toxic"] > 0) & (mass["ordinary"] > 0)
    backoff = np.where(good, 1 - kept, 1.0)
    share = {c: np.where(good[at], (1 - backoff[at]) * left[c] / np.maximum(mass[c][at], 1e-12), 0) for c in left}
    pair_keys = _pair(*(pairs[c].to_numpy(np.int64).view(np.uint64) for c in ("prior", "word")))
    po = np.argsort(pair_keys)
    return Model(keys[order], prob[0][order], prob[1][order], pair_keys[po], share["toxic"][po], share["ordinary"][po], h[good], backoff[good])


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.append(np.full(x.shape[1], 0.1), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        w += np.linalg.solve(hessian, z.T @ (y - p) - ridge * w)
    return mean, deviation, w


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic",
        max_labelled: int = MAX_LABELLED, max_entries: int = MAX_ENTRIES) -> Model:
    """Fit on at most ``max_labelled`` labelled documents among those that ``may_learn`` (over doc_id) names."""
    known = pick(labels, doc_id=label_id, toxic=label).where(may_learn & F.col("toxic").isin(0, 1))
    there = known.count()
    share = min(1.0, max_labelled / max(there, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # At most max_labelled small rows, counted above, hence a broadcast.
    sample = pick(docs, doc_id=doc_id, text=text).join(F.broadcast(known), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(CALIBRATE)))
    counts = keep_in_folder(count(sample.where("fold <> 0")), "toxicity-counts")
    model = _model(counts, max_entries)
    discard(counts)
    rates = known.agg(F.avg("toxic").alias("r")).first()["r"]
    model.rate = float(rates or 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        for batch in batches:
            f = shared.value.features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(f[:, i]) for i in range(4)] + [batch.column(1)], names=["f0", "f1", "f2", "f3", "toxic"])

    held = sample.where("fold = 0").select("text", "toxic").mapInArrow(features, "f0 double, f1 double, f2 double, f3 double, toxic int").toArrow().to_pandas()
    y = held["toxic"].to_numpy(np.float64)
    if len(model.words) and 0 < y.sum() < len(y):
        model.curve = _curve(held[["f0", "f1", "f2", "f3"]].to_numpy(), y)
    return model


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, score (probability of the toxic label), evidence (mean log ratio a word) and excess."""
    kept = pick(docs, doc_id=doc_id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            f = shared.value.features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(f)), pa.array(f[:, 0]), pa.array(f[:, 1])], names=["doc_id", "score", "evidence", "excess"])

    schema = kept.select("doc_id", *[F.lit(0.0).alias(c) for c in ("score", "evidence", "excess")]).schema
    return kept.mapInArrow(run, schema)
