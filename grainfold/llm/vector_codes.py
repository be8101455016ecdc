"""Compression of vectors to codes: one codebook per part, found over a lexicographic trie of the distinct parts.

A component x becomes the integer floor(4096 x); a vector is cut into equal
consecutive parts. Different parts of a position are counted once for the whole
table, sorted, and kept; in this order they are the leaves of a trie whose
levels are the dimensions. The traversal goes over the leaves depth first: the
vector of a node's distances to all entries, summed over the dimensions so far,
is made once from its parent's and shared by all leaves below it. It runs a
block of leaves at a time, a level of the block in one step; the path that is
open at a block's end is carried into the next. A leaf takes the nearest entry
and adds its part, weighted by its count, to that entry's sums. Sums of a task
are one row for each entry and dimension, so a round moves codebooks only.
All arithmetic is on 64-bit integers.

Codes of the vectors come from the same traversal over the parts of a batch of
vectors, without a shuffle.

Defined cases: a vector that is null, empty, or holds a null or a component that
is not finite is dropped, and so is one of another length than most of the
others have (of equally common lengths the shorter stays). A length that the
parts do not divide is filled up with zeros. Scaled components are held within
2^25 either way, so that sums of squares fit. With fewer rows than entries the
codebooks have fewer entries; equal rows may give equal entries, of which the
first is taken. Repeated rows count each time; rows of one id are ordered by
their vector; a null id comes after all others. An empty table gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.llm.frames import BROADCAST_ROWS, discard, keep_in_folder, parts, pick

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 1 << 25  # of a scaled component
BLOCK = 1 << 13  # leaves that are worked on at a time
SALTS = 16


class Trie:
    """Distances of sorted parts to the entries of one codebook, by a traversal that goes on from block to block."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        dims = entries.shape[1]
        self.last = None  # the leaf before
        self.path = np.zeros((dims + 1, len(entries)), np.int64)  # vectors of the nodes above it, root first

    def nearest(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of every leaf; equal neighbours are one leaf."""
        before = np.concatenate([leaves[:1] if self.last is None else self.last[None], leaves[:-1]])
        opens = np.zeros(len(leaves), bool)  # leaves at which a node of this level begins
        opens[0] = self.last is None
        node, vectors = np.zeros(len(leaves), np.int64), self.path[:1]
        for level in range(leaves.shape[1]):
            opens |= leaves[:, level] != before[:, level]
            first = np.flatnonzero(opens)
            step = leaves[first, level][:, None] - self.entries[:, level]
            vectors = np.concatenate([self.path[level + 1 : level + 2], vectors[node[first]] + step * step])
            node = np.cumsum(opens)  # node 0 is the one that was open
            self.path[level + 1] = vectors[node[-1]]
        self.last = leaves[-1].copy()
        entry = vectors.argmin(1)  # of equal distances the first
        return entry[node], vectors[np.arange(len(vectors)), entry][node]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def scaled(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and the integer components ``x`` of the usable vectors."""
    kept = pick(vectors, vec_id=vec_id, vector=vector, label=label)
    usable = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * SCALE)))
    return kept.where(F.coalesce(usable, F.lit(False))).select("vec_id", "label", F.transform("vector", held).alias("x"))


def common_length(rows: DataFrame) -> int:
    """The length of most vectors; 0 for an empty table."""
    found = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return found["n"] if found else 0


def distinct_parts(rows: DataFrame, length: int, n_parts: int) -> DataFrame:
    """position, part and the number of vectors that hold it, in the order of a trie per position; written."""
    size = -(-length // n_parts)
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), size * n_parts - length))
    each = F.posexplode(F.array(*[F.slice(filled, 1 + i * size, size) for i in range(n_parts)])).alias("position", "part")
    counted = rows.select(each).groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight"))
    ordered = counted.repartitionByRange(parts(rows.sparkSession), "position", "part").sortWithinPartitions("position", "part")
    return keep_in_folder(ordered, "trie-leaves")


def _sums(leaves: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """(position, entry) -> weight and weighted sum of the parts nearest to it."""
    shared = leaves.sparkSession.sparkContext.broadcast(books)
    dims = books[0].shape[1]

    def walk(batches):
        books = shared.value
        weight = np.zeros((len(books), len(books[0])), np.int64)
        total = np.zeros((len(books), len(books[0]), dims), np.int64)
        open_at, trie = -1, None
        for batch in batches:
            position, weights, part = (batch.column(c) for c in ("position", "weight", "part"))
            position, weights, part = position.to_numpy(), weights.to_numpy(), _matrix(part, dims)
            cuts = np.flatnonzero(np.diff(position)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(position))):
                for lo in range(a, b, BLOCK):
                    hi = min(b, lo + BLOCK)
                    if position[lo] != open_at:
                        open_at = int(position[lo])
                        trie = Trie(books[open_at])
                    entry, _ = trie.nearest(part[lo:hi])
                    np.add.at(weight[open_at], entry, weights[lo:hi])
                    np.add.at(total[open_at], entry, part[lo:hi] * weights[lo:hi, None])
        p, e = np.nonzero(weight)
        for k in range(dims):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(np.full(len(p), k), pa.int32()), pa.array(weight[p, e]), pa.array(total[p, e, k])],
                                             names=["position", "entry", "dim", "weight", "total"])

    found = leaves.mapInArrow(walk, "position int, entry int, dim int, weight bigint, total bigint")
    rows = found.groupBy("position", "entry", "dim").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total")).collect()  # codebooks in size
    out: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for r in rows:
        out.setdefault((r["position"], r["entry"]), (r["weight"], np.zeros(dims, np.int64)))[1][r["dim"]] = r["total"]
    return out


def train(rows: DataFrame, *, n_parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, list[np.ndarray]]:
    """The length of the vectors and a codebook for each part position; ``rows`` as ``scaled`` gives them."""
    length = common_length(rows)
    if not length:
        return 0, []
    size = -(-length // n_parts)
    own = rows.where(F.size("x") == length)
    first = [r["x"] + [0] * (size * n_parts - length) for r in own.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()]
    books = [np.array([x[i * size : (i + 1) * size] for x in first], np.int64) for i in range(n_parts)]
    leaves = distinct_parts(own, length, n_parts)
    for _ in range(rounds):
        for (position, entry), (weight, total) in _sums(leaves, books).items():
            books[position][entry] = total // weight  # rounds down
    discard(leaves)
    return length, books


def encode(rows: DataFrame, length: int, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (an entry for each part) and error, the sum of the squared distances."""
    rows = rows.where(F.size("x") == length)
    schema = rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).schema
    if not books:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    dims = books[0].shape[1]

    def walk(batches):
        books = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.zeros((batch.num_rows, dims * len(books)), np.int64)
            x[:, :length] = _matrix(batch.column("x"), length)
            code, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for i, book in enumerate(books):
                part = x[:, i * dims : (i + 1) * dims]
                order = np.lexsort(part.T[::-1])
                trie = Trie(book)
                for lo in range(0, len(order), BLOCK):
                    at = order[lo : lo + BLOCK]
                    code[at, i], distance = trie.nearest(part[at])
                    error[at] += distance
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=schema.names)

    return rows.select("vec_id", "label", "x").mapInArrow(walk, schema)


def with_label_error(coded: DataFrame, sent_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds the error summed over equal labels, nulls together. ``coded`` is read twice, so it should be a written table.

    Sums of up to ``sent_rows`` labels are sent to the rows; more are joined by label and a salt, so that a label of very many rows spans many tasks.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("l"), "label_error")
    if sums.limit(sent_rows + 1).count() <= sent_rows:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("l"))).drop("l")
    salted = sums.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt: Column = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    return coded.withColumn("salt", salt).join(salted, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s"))).drop("l", "s", "salt")


def digest(books: list[np.ndarray]) -> str:
    """Checksum of all components by part, entry and position, as decimal numbers."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", n_parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error and label_error of every usable vector, and the codebooks; at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    rows = keep_in_folder(scaled(vectors, vec_id=vec_id, vector=vector, label=label), "scaled-vectors")
    length, books = train(rows, n_parts=n_parts, entries=entries, rounds=rounds)
    coded = keep_in_folder(encode(rows, length, books), "vector-codes")
    discard(rows)
    return with_label_error(coded), books
