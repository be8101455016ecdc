"""Ranked lexical search for a stated set of items over all documents, with equal bags scored once.

Only words of the items can score, so a document is reduced to its bag: the
items' words in it with their counts, sorted, as bytes. Documents whose bag and
whose length norm m are the same get the same score for every item and form one
class. Classes meet by a 64-bit hash and are told apart by the bag itself. A
class is scored once and carries its least doc_ids, as many as an item can take;
they take their places by ascending doc_id when the class is ranked.

    w(term) = floor(1000 ln((2N + 2) / (2 df + 1)))
    m(document) = 100 - 25 + 25 n N div L
    score = sum of w * (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included

N counts the documents that have terms, L all their terms, n a document's terms,
df the documents that hold a term, tf its occurrences. Scores are 64-bit
integers. Counts cover all documents.

The items go out in blocks of a bounded number of words, each block over all
documents, so neither the driver nor a task holds more than a block. A task
keeps the best places of every item only; the rest meets by item.

Words are runs of digits, letters A-Z / a-z and characters outside ASCII, A-Z
read as a-z. They are recognised by a 64-bit hash and their length.

Defined cases: a null, empty or wordless text has no terms and is in no count.
Rows that repeat a doc_id are documents of their own; equal scores go by
ascending doc_id, null after all others. Every row of items is an item, also
with a null or repeated id; one without words has no result. Very long texts are
one slice each. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfold.llm.frames import discard, keep_in_folder, pick
from grainfold.llm.words import tokenise

TOP = 20
BLOCK_WORDS = 400_000  # words of the items, with repeats, that are sent to the tasks at a time
CELLS = 1 << 20  # scores that a task works out at a time
_EXACT = 1 << 53


class Vocabulary:
    """The terms of a block of items and, for each term, the items that hold it."""

    def __init__(self, texts: list[str]):
        hashes, sizes, owners = [], [], []
        for lo, _, w in tokenise(pa.array(texts, pa.string())):
            hashes.append(w.hash)
            sizes.append(w.end - w.start)
            owners.append(w.doc + lo)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.hash, first, term = np.unique(join(hashes, np.uint64), return_index=True, return_inverse=True)
        self.size = join(sizes, np.int64)[first]
        self.items = len(texts)
        pairs, self.repeats = np.unique(term * max(1, self.items) + join(owners, np.int64), return_counts=True)
        self.item = pairs % max(1, self.items)
        self.bounds = np.searchsorted(pairs // max(1, self.items), np.arange(len(self.hash) + 1))

    def __len__(self) -> int:
        return len(self.hash)

    def find(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are terms, and which terms they are."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, words.hash), len(self) - 1)
        hit = np.flatnonzero((self.hash[at] == words.hash) & (self.size[at] == words.end - words.start))
        return hit, at[hit]


def bags(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (its terms) and bag: (term, count) pairs of 32-bit numbers in order; rows without terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n"), F.lit(b"").alias("bag")).schema

    def reduced(batches):
        vocabulary = shared.value
        for batch in batches:
            for lo, hi, w in tokenise(batch.column(1)):
                n = np.bincount(w.doc, minlength=hi - lo)
                hit, term = vocabulary.find(w)
                keys, count = np.unique(w.doc[hit] * max(1, len(vocabulary)) + term, return_counts=True)
                pairs = np.stack([keys % max(1, len(vocabulary)), count], 1).astype("<u4")
                ends = np.searchsorted(keys // max(1, len(vocabulary)), np.arange(hi - lo + 1)) * 8
                bag = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(pairs.tobytes())])
                own = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), bag.cast(pa.binary())], names=["doc_id", "n", "bag"])
                yield own.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(reduced, schema)


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every pair of the bags."""
    size = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    flat = np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(column)), size // 8), flat[:, 0], flat[:, 1]


def document_counts(kept: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term; a task gives its counts, at most one row for each term of the block."""

    def count(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(_pairs(batch.column(0))[1], minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    for r in kept.select("bag").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(c) + 1))) for c in df], np.int64)


def classes(kept: DataFrame, documents: int, length: int, top: int) -> DataFrame:
    """bag, m and the ``top`` least doc_ids of every class of equal bags and norms.

    The window drops all but ``top`` rows of a class before the shuffle, so a class of a third of all documents moves a few rows a task.
    """
    norm = F.expr(f"75 + cast(cast(25 * n as decimal(24, 0)) * {documents}BD div {length}BD as bigint)")
    keyed = kept.where(F.octet_length("bag") > 0).select("doc_id", "bag", norm.alias("m")).withColumn("key", F.xxhash64("bag", "m"))
    same = ["key", "bag", "m"]
    least = Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last())
    few = keyed.withColumn("place", F.row_number().over(least)).where(F.col("place") <= top)
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    return few.groupBy(*same).agg(F.transform(F.sort_array(F.collect_list(member)), lambda x: x["doc_id"]).alias("members")).select("bag", "m", "members")


class _Best:
    """The best places of every item so far: (item, score, doc_id), no more than ``top`` an item."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)  # a score must be above 0
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.no_id = np.zeros(0, bool)

    def add(self, scores: np.ndarray, members: pa.Array) -> None:
        """Scores of some classes (rows) for all items (columns), and the classes' doc_ids."""
        if len(scores) > self.top:  # no class below the best classes of this slice can get a place
            floor = np.maximum(self.least, np.partition(scores, len(scores) - self.top, axis=0)[-self.top])
        else:
            floor = self.least
        row, item = np.nonzero(scores >= floor)
        ends = members.offsets.to_numpy()
        flat = members.values
        size = np.diff(ends)[row]
        at = np.repeat(ends[row], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        no_id = flat.is_null().to_numpy(zero_copy_only=False)[at]
        doc = flat.fill_null(0).to_numpy()[at]
        item, score = np.repeat(item, size), np.repeat(scores[row, item], size)
        both = [np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.no_id, no_id))]
        order = np.lexsort((both[2], both[3], -both[1], both[0]))
        both = [x[order] for x in both]
        begins = np.searchsorted(both[0], np.arange(len(self.least) + 1))
        keep = np.arange(len(order)) - begins[both[0]] < self.top
        self.item, self.score, self.doc, self.no_id = (x[keep] for x in both)
        begins = np.searchsorted(self.item, np.arange(len(self.least) + 1))
        filled = np.diff(begins) == self.top
        self.least[filled] = self.score[begins[1:][filled] - 1]


def _ranked(found: DataFrame, vocabulary: Vocabulary, weight: np.ndarray, item_ids: list, top: int, id_type) -> DataFrame:
    """item (number within the block), doc_id and score: the best of every task."""
    shared = found.sparkSession.sparkContext.broadcast((vocabulary, weight))
    # sums of products of at most 10^6 with the weights of an item's words; below 2^53 they are exact as doubles too
    repeats = int(np.bincount(vocabulary.item, vocabulary.repeats, minlength=1).max()) if len(vocabulary) else 0
    exact = repeats * int(weight.max(initial=0)) * 10**6 < _EXACT

    def best(batches):
        vocabulary, weight = shared.value
        each = np.diff(vocabulary.bounds)
        best = _Best(vocabulary.items, top)
        rows = max(top, CELLS // max(1, vocabulary.items))
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                row, term, tf = _pairs(part.column(0))
                m = part.column(1).to_numpy()[row]
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
                n = each[term]
                at = np.repeat(vocabulary.bounds[term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cell = np.repeat(row, n) * vocabulary.items + vocabulary.item[at]
                amount = np.repeat(value, n) * vocabulary.repeats[at]
                if exact:
                    scores = np.bincount(cell, amount, part.num_rows * vocabulary.items).astype(np.int64)
                else:
                    scores = np.zeros(part.num_rows * vocabulary.items, np.int64)
                    np.add.at(scores, cell, amount)
                best.add(scores.reshape(part.num_rows, vocabulary.items), part.column(2))
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), pa.array(best.doc, mask=best.no_id), pa.array(best.score)], names=["item", "doc_id", "score"])

    places = found.select("bag", "m", "members").mapInArrow(best, "item int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    final = places.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = found.sparkSession.createDataFrame(list(enumerate(item_ids)), f"item int, item_id {id_type.simpleString()}")
    return final.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block of items


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           top: int = TOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per item its ``top`` best documents: item_id, rank, doc_id, score. Ids of documents are integers."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    items = pick(items, item_id=item_id, text=item_text)
    id_type = items.schema["item_id"].dataType
    size = items.agg(F.sum(F.octet_length("text") + 1)).head()[0] or 0
    blocks = max(1, -(-size // (2 * block_words)))  # a word takes a byte and a separator at least
    if blocks > 1:  # dealt once, so that every block reads its own rows
        items = keep_in_folder(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    out = []
    documents = length = None
    for number in range(blocks):
        own = (items.where(F.col("block") == number) if blocks > 1 else items).where("text IS NOT NULL").select("item_id", "text").collect()  # a block
        if not own:
            continue
        vocabulary = Vocabulary([r["text"] for r in own])
        kept = keep_in_folder(bags(docs, vocabulary), "bags")
        if documents is None:
            total = kept.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).head()
            documents, length = total["documents"], total["length"]
        if documents and len(vocabulary):
            weight = weights(document_counts(kept, len(vocabulary)), documents)
            found = classes(kept, documents, length, top)
            out.append(keep_in_folder(_ranked(found, vocabulary, weight, [r["item_id"] for r in own], top, id_type), "ranked"))
        discard(kept)
    if blocks > 1:
        discard(items)
    if not out:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionAll, out)
