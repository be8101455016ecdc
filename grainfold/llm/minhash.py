"""Near duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

Shingles are runs of five words (a text of fewer words is one shingle), weighted
by how often they occur. Each shingle is a Poisson process whose rate is its
weight: its arrivals fall on random registers, and the earliest arrival of a
register names the shingle in the signature. A shingle stops as soon as its next
arrival comes later than all registers hold. Two signatures agree in a register
with the probability Jaccard similarity of the texts. A text that repeats a shingle has a
second signature in which every weight is 1; in second signatures (for other texts the only one)
two texts agree with their plain Jaccard similarity.

Equal texts are one node, so copies cost one aggregation. Bands of registers
make buckets. In a bucket every member is compared with one centre only, first one
chosen by a hash, then the member with most links so far (the middle of its
group), which makes as many pairs as members. Buckets that then still hold
several components go on: small ones compare all members of different components;
the members of larger ones meet by their rarest shingles, as many as two texts
at the threshold must share one of, so nothing is left out there: those that share one
are compared by sketches of 2,048 bits inside of a task, and what cannot reach the threshold stays there. Pairs whose signatures could reach the threshold are verified on the shingles
themselves: a link needs 0.8 of probability Jaccard, or of plain Jaccard over the
different shingles. Classes are the connected components of the links.

Defined cases: a text that is null or has no word is alone in its class; so is a
row whose id is null (its class is null). Equal texts are one class. Repeated rows
get a row each. Very long texts are read whole. An empty table gives an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.llm.frames import discard, keep_in_folder, keep_narrow, parts, pick, sent, tidy
from grainfold.llm.graph import components
from grainfold.llm.words import mix, tokenise, windows

SHINGLE, THRESHOLD = 5, 0.8
REGISTERS = 80
BAND = 4  # registers of a band; the bands are disjoint, and at the threshold all of them miss a pair with chance 3e-5
MARGIN = 0.25  # a pair whose signatures of either kind agree in less than threshold - margin of the registers is not verified
SMALL = 16  # members of a bucket up to which all pairs of different components are compared
RARITY = 1 << 20  # counters that shingles share to be ordered by how many texts hold them
BITS = 2048  # bits of a sketch, which texts in open buckets are compared by before their shingles are
BLOCK = 256  # members of a shingle in one block, about
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array):
    """(first text, last text, number of the text, hash, weight) of the different shingles, slice by slice."""
    for lo, hi, words in tokenise(texts):
        found = [windows(words.hash, words.doc, SHINGLE)]
        count = np.diff(words.bounds)
        for n in range(1, SHINGLE):
            key, at = windows(words.hash, words.doc, n)
            whole = count[words.doc[at]] == n
            found.append((key[whole], at[whole]))
        key, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        doc = words.doc[at]
        _, first, weight = np.unique(mix(key + doc.astype(np.uint64) * _GOLD), return_index=True, return_counts=True)
        yield lo, hi, doc[first], key[first], weight


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """texts x registers of 32-bit shingle names; rows of texts without a shingle mean nothing."""
    least = np.full(texts * registers, np.iinfo(np.uint64).max, np.uint64)
    time = np.zeros(len(key))
    arrival = 0
    while len(key):
        arrival += 1
        random = mix(key + np.uint64(arrival * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log((random >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight
        register = (mix(random ^ np.uint64(0xA5A5A5A5)) % np.uint64(registers)).astype(np.int64)
        # Positive floats sort as their bits do: time above, name of the shingle below.
        packed = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (key >> np.uint64(32))
        np.minimum.at(least, doc * registers + register, packed)
        present, place = np.unique(doc, return_inverse=True)
        latest = least.reshape(texts, registers)[present].max(axis=1)[place]
        go = packed < latest
        doc, key, weight, time = doc[go], key[go], weight[go], time[go]
    return (least & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(texts, registers)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard of two sorted arrays of shingle names, repeated by weight."""
    names = np.union1d(a, b)
    x = (np.searchsorted(a, names, "right") - np.searchsorted(a, names)).astype(float)
    y = (np.searchsorted(b, names, "right") - np.searchsorted(b, names)).astype(float)
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0, 0.0
    ratio = np.divide(y, x, out=np.full(len(x), np.inf), where=x > 0)
    order = np.argsort(ratio, kind="stable")
    upto = np.searchsorted(ratio[order], ratio[both], "right")  # y/x not above the shingle's own: x counts there
    xs, ys = np.append(0, np.cumsum(x[order])), np.append(0, np.cumsum(y[order]))
    return float((1 / (xs[upto] / x[both] + (ys[-1] - ys[upto]) / y[both])).sum()), float(both.sum() / len(names))


def _sides(sigs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signatures by weight, and by different shingles (the same where a text repeats none)."""
    raw = sigs.to_pylist()
    return tuple(np.frombuffer(b"".join(r[part] for r in raw), np.uint32).reshape(-1, REGISTERS) for part in (slice(4 * REGISTERS), slice(-4 * REGISTERS, None)))


def _sign(kept: DataFrame) -> DataFrame:
    """id, key of the text and signature (null without a word, two in a row where the text repeats a shingle), for all rows."""

    @tidy
    def run(batches):
        for batch in batches:
            out: list = []
            for lo, hi, doc, key, weight in shingles(batch.column(1)):
                rows, there = signatures(doc, key, weight, hi - lo), np.bincount(doc, minlength=hi - lo) > 0
                again = np.unique(doc[weight > 1])
                second = dict.fromkeys(range(hi - lo), b"")
                if len(again):
                    inside = np.isin(doc, again)
                    plain = signatures(np.searchsorted(again, doc[inside]), key[inside], np.ones(inside.sum(), np.int64), len(again))
                    second |= {int(d): r.tobytes() for d, r in zip(again, plain)}
                out += [r.tobytes() + second[n] if t else None for n, (r, t) in enumerate(zip(rows, there))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["id", "same", "sig"])

    schema = kept.select("id", F.lit(None).cast("string").alias("same"), F.lit(None).cast("binary").alias("sig")).schema
    return kept.select("id", "text", F.md5("text").alias("same")).mapInArrow(run, schema)


def _bands(signed: DataFrame) -> DataFrame:
    """(key, id) of the bands, which cut the registers of either signature into disjoint parts.

    Both signatures share their keys, so that a text that repeats a shingle meets one that does not.
    """
    bands = np.arange(REGISTERS).reshape(-1, BAND)

    @tidy
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            keys, at = [], []
            for n, band in enumerate(bands):
                both = []
                for sig in _sides(batch.column(1)):
                    h = np.full(len(sig), (n + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF, np.uint64)
                    for r in band:
                        h = mix(h ^ sig[:, r].astype(np.uint64)) * _GOLD
                    both.append(h.view(np.int64))
                second = np.flatnonzero(both[0] != both[1])
                keys += [both[0], both[1][second]]
                at += [np.arange(len(both[0])), second]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(np.concatenate(at)))], names=["key", "id"])

    return signed.select("id", "sig").mapInArrow(run, signed.select(F.lit(0).cast("long").alias("key"), "id").schema)


def _texts_per_counter(names: DataFrame) -> np.ndarray:
    """In how many texts the shingles of each counter occur, from (id, names)."""

    @tidy
    def run(batches):
        count = np.zeros(RARITY, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                count += np.bincount(np.unique(np.frombuffer(raw.as_py(), np.uint32)) % RARITY, minlength=RARITY)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["at", "n"])

    # At most RARITY rows, whatever the corpus.
    rows = names.select("names").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def prefix(raw: np.ndarray, count: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest shingles of a text: of two texts that reach the threshold both hold one of these.

    Plain Jaccard t needs t of the different shingles of either text in common, probability
    Jaccard t needs t of the weight of either (it is at most the sum of the smaller shares). So once
    less than t is left of both, in an order that all texts share, what is left cannot be all that two texts share.
    """
    name, weight = np.unique(raw, return_counts=True)
    order = np.lexsort((name, count[name % RARITY]))
    name, weight = name[order], weight[order]
    least = threshold - 1e-9
    open_ = (np.arange(len(name), 0, -1) >= least * len(name)) | (weight[::-1].cumsum()[::-1] >= least * len(raw))
    name = name[open_]
    return name[count[name % RARITY] > 1]  # a shingle that is alone meets no other


def sketches(names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of ``BITS`` bits for each text, as 64-bit words: one bit of each register of a long signature by different shingles, and by weight."""
    plain, weighted = (np.zeros((len(names), BITS // 64), np.uint64) for _ in range(2))
    for lo in range(0, len(names), 256):
        part = [np.unique(n, return_counts=True) for n in names[lo : lo + 256]]
        doc = np.repeat(np.arange(len(part)), [len(n) for n, _ in part])
        key, weight = (np.concatenate([x[k] for x in part]) for k in (0, 1))
        key = key.astype(np.uint64) << np.uint64(32)
        bits = lambda sig: np.packbits(mix(sig.astype(np.uint64)) & np.uint64(1) > 0, axis=1).view(np.uint64)
        own = bits(signatures(doc, key, np.ones(len(key), np.int64), len(part), BITS))
        plain[lo : lo + 256] = weighted[lo : lo + 256] = own
        again = np.unique(doc[weight > 1])
        if len(again):
            inside = np.isin(doc, again)
            weighted[lo + again] = bits(signatures(np.searchsorted(again, doc[inside]), key[inside], weight[inside], len(again), BITS))
    return plain, weighted


def differing(threshold: float, deviations: float = 5) -> int:
    """Bits in which the sketches of two texts at the threshold differ at most, but for one pair in three million (at five deviations)."""
    share = (1 - threshold) / 2  # half of the registers that differ agree in their bit
    return math.ceil(BITS * share + deviations * math.sqrt(BITS * share * (1 - share)))


def _sharing(names: DataFrame, owned: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, gap) of different roots that share a shingle of their prefixes and whose sketches differ in ``gap`` bits, each once; from (id, names) and (id, root).

    Members of a shingle are compared inside of a task; a pair counts at the rarest shingle that both hold, and only pairs that can be links leave the task.
    """
    spark, id_type = names.sparkSession, names.schema["id"].dataType.simpleString()
    count, most = spark.sparkContext.broadcast(_texts_per_counter(names)), differing(threshold)

    @tidy
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            held = [np.frombuffer(raw.as_py(), np.uint32) for raw in batch.column(1)]
            found = [prefix(raw, count.value, threshold) for raw in held]
            plain, weighted = sketches(held)
            for lo in range(0, len(held), 64):  # every row repeats its sketches: few texts at a time
                at = np.repeat(np.arange(lo, min(lo + 64, len(held))), [len(f) for f in found[lo : lo + 64]])
                if len(at):
                    about = pa.array([found[i].tobytes() + plain[i].tobytes() + weighted[i].tobytes() for i in range(lo, min(lo + 64, len(held)))], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[lo : lo + 64]).astype(np.int64)), batch.column(0).take(pa.array(at)), about.take(pa.array(at - lo))], names=["name", "id", "about"])

    schema = names.select(F.lit(0).cast("long").alias("name"), "id", F.lit(b"").alias("about")).schema
    rows = keep_in_folder(names.mapInArrow(run, schema).join(owned, "id"), "prefixes")
    several = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    # A common shingle is cut into blocks, and a task gets pairs of blocks, so that none holds all its members.
    dealt = rows.join(several.select("name", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "name").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("name", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root", "about")
    dealt = dealt.repartition(parts(spark), "name", "i", "j").sortWithinPartitions("name", "i", "j")

    @tidy
    def compare(batches):
        open_, key = [], None
        for batch in batches:
            at = [batch.column(c).to_numpy() for c in range(3)]
            cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in at], axis=0)) + 1 if len(batch) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                if hi > lo:
                    now = tuple(int(x[lo]) for x in at)
                    if now != key:
                        yield from met(key, open_)
                        open_, key = [], now
                    open_.append(batch.slice(lo, hi - lo))
        yield from met(key, open_)

    def met(key, held):
        rows = pa.Table.from_batches(held) if held else None
        if rows is None or len(rows) < 2:
            return
        name, i, j = key
        ids, roots, about = (rows.column(c).to_pylist() for c in ("id", "root", "about"))
        own = rows.column("own").to_numpy()
        root = np.unique(roots, return_inverse=True)[1]
        bits = np.frombuffer(b"".join(x[-BITS // 4 :] for x in about), np.uint64).reshape(len(ids), 2, -1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = []
        for a in left:
            b = right[right > a] if i == j else right
            b = b[root[b] != root[a]]
            if len(b):
                gap = np.bitwise_count(bits[b] ^ bits[a]).sum(axis=2, dtype=np.int64).min(axis=1)
                out += [(a, x, g) for x, g in zip(b[gap <= most], gap[gap <= most]) if _first(about[a], about[x]) == name]
        if out:
            ends = [(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b, _ in out]
            yield pa.RecordBatch.from_arrays([*[pa.array([e[k] for e in ends], rows.schema.field("id").type) for k in (0, 1)], pa.array([g for *_, g in out], pa.int64())], names=["a", "b", "gap"])

    pairs = keep_in_folder(dealt.mapInArrow(compare, f"a {id_type}, b {id_type}, gap bigint"), "sharing")
    discard(rows)
    return pairs


def _first(a: bytes, b: bytes) -> int:
    """The rarest shingle that is in the prefixes of both; prefixes are in one order."""
    x, y = (np.frombuffer(v[: -BITS // 4], np.uint32) for v in (a, b))
    both = np.isin(x, y, assume_unique=True)
    return int(x[both.argmax()]) if both.any() else -1


class _Proof:
    """Verifies pairs; the shingles of a document are made once, when a pair first needs them."""

    def __init__(self, kept: DataFrame, signed: DataFrame, threshold: float):
        self.kept, self.signed, self.threshold = kept, signed, threshold
        self.id_type = signed.schema["id"].dataType.simpleString()
        self.names: DataFrame | None = None
        self.written: list[DataFrame] = []

    def _make(self, ids: DataFrame) -> None:
        """Shingle names of the documents that have none yet."""
        missing = keep_narrow(ids if self.names is None else ids.join(self.names.select("id"), "id", "left_anti"), "shingle-ids")
        count = missing.count()
        if self.names is not None and not count:
            discard(missing)
            return

        @tidy
        def sets(batches):
            for batch in batches:
                out = []
                for lo, hi, doc, key, weight in shingles(batch.column(1)):
                    name = np.repeat((key >> np.uint64(32)).astype(np.uint32), weight)
                    doc = np.repeat(doc, weight)
                    order = np.lexsort((name, doc))
                    ends = np.searchsorted(doc[order], np.arange(hi - lo + 1))
                    out += [name[order[x:y]].tobytes() for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "names"])

        texts = self.kept.join(sent(missing, count), "id", "left_semi").select("id", "text")
        made = keep_in_folder(texts.mapInArrow(sets, f"id {self.id_type}, names binary").dropDuplicates(["id"]), "shingle-sets")
        self.written.append(made)
        self.names = made if self.names is None else self.names.unionByName(made)
        discard(missing)

    def names_of(self, ids: DataFrame) -> DataFrame:
        """(id, names) of these documents."""
        self._make(ids)
        return self.names.join(ids, "id", "left_semi")

    def __call__(self, pairs: DataFrame, sketched: bool = False) -> DataFrame:
        """The pairs (a, b) whose similarity reaches the threshold, as a table; ``sketched`` pairs have been compared by more than their signatures."""
        agree, threshold = int((self.threshold - MARGIN) * REGISTERS), self.threshold

        @tidy
        def could(batches):
            for batch in batches:
                if len(batch):
                    (a, plain_a), (b, plain_b) = (_sides(batch.column(i)) for i in (2, 3))
                    good = ((a == b).sum(axis=1) >= agree) | ((plain_a == plain_b).sum(axis=1) >= agree)
                    yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good))

        @tidy
        def meet(batches):
            for batch in batches:
                a, b = (batch.column(i).to_pylist() for i in (2, 3))
                good = [max(similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))) >= threshold - 1e-12 for x, y in zip(a, b)]
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

        def beside(rows: DataFrame, side: DataFrame, what: str) -> DataFrame:
            of = lambda end: side.select(F.col("id").alias(end), F.col(what).alias(f"{what}_{end}"))
            return rows.join(of("b"), "b").join(of("a"), "a").select("a", "b", f"{what}_a", f"{what}_b")

        schema = f"a {self.id_type}, b {self.id_type}"
        near = keep_narrow(pairs if sketched else beside(pairs, self.signed, "sig").mapInArrow(could, schema), "near-pairs")
        self._make(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct())
        met = keep_narrow(beside(near, self.names, "names").mapInArrow(meet, schema), "links")
        discard(near)
        return met


def linked(kept: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between different texts that join all components, and (node, root) of their ends.

    ``signed`` holds id and sig of one row for every text.
    """
    proof, found, roots, rooted = _Proof(kept, signed, threshold), None, None, 0

    def add(pairs: DataFrame, sketched: bool = False) -> bool:
        nonlocal found, roots, rooted
        new = proof(pairs, sketched)
        if found is not None and new.isEmpty():
            discard(new)
            return False
        older = found, roots
        found = new if found is None else keep_narrow(found.unionByName(new), "links")
        stars = components(found)
        roots = keep_narrow(stars, "roots")
        discard(stars, *older, *([new] if found is not new else []))
        rooted = roots.count()
        return True

    def opened(members: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with their root and their number of links."""
        degree = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        known = roots.select(F.col("node").alias("id"), "root").join(degree, "id", "left")
        owned = members.join(sent(known, rooted), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
        mixed = owned.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max_by(F.struct("id", "root"), F.struct("degree", F.xxhash64("id", "key"))).alias("centre")).where("x <> y")
        return keep_narrow(owned.join(mixed.select("key", "centre"), "key"), "open-buckets")

    keys = keep_narrow(_bands(signed), "bands")
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.xxhash64("id", "key")).alias("first")).where("n > 1")
    members = keep_narrow(keys.join(buckets, "key"), "buckets")
    # One centre a bucket, by a hash, so that the bands of a group do not all take the same.
    add(members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    # Then the member with most links so far, which is in the middle of its group.
    open_ = opened(members)
    if add(open_.where("root <> centre.root").select(F.col("centre.id").alias("a"), F.col("id").alias("b")).distinct()):
        discard(open_)
        open_ = opened(members)
    small = open_.where(F.col("n") <= SMALL)
    other = small.select("key", F.col("id").alias("b"), F.col("root").alias("root_b"))
    add(small.select("key", F.col("id").alias("a"), "root").join(other, "key").where("a < b AND root <> root_b").select("a", "b").distinct())
    large = keep_narrow(open_.where(F.col("n") > SMALL).select("id").distinct(), "open-ids")
    discard(keys, members, open_)
    if not large.isEmpty():
        owned = large.join(sent(roots.withColumnRenamed("node", "id"), rooted), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        pairs = _sharing(proof.names_of(large), owned, threshold)
        # The likely links first: what they join needs no further look.
        likely = differing(threshold, 1)
        add(pairs.where(F.col("gap") <= likely).select("a", "b"), True)
        root = lambda end: sent(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), rooted)
        rest = pairs.where(F.col("gap") > likely).join(root("a"), "a", "left").join(root("b"), "b", "left")
        add(rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), True)
        discard(pairs)
    discard(large, *proof.written)
    return found, roots


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, rep_id (least id of the same text) and class_id (least id of its class)."""
    kept = pick(docs, id=doc_id, text=text)
    all_rows = keep_in_folder(_sign(kept), "signatures")
    worded = all_rows.where("sig IS NOT NULL AND id IS NOT NULL")
    first = worded.groupBy("same").agg(F.min(F.struct("id", "sig")).alias("r"))
    signed = keep_in_folder(first.select(F.col("r.id").alias("id"), F.col("r.sig").alias("sig"), "same"), "texts")
    found, roots = linked(kept, signed.drop("same"), threshold)
    discard(found)
    classes = signed.select("same", F.col("id").alias("rep")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    keyed = all_rows.select("id", F.when(F.col("sig").isNotNull() & F.col("id").isNotNull(), F.col("same")).alias("same"))
    # Rows without a word keep a key of their own in the join, so that they do not meet in one task.
    keyed = keyed.withColumn("same", F.coalesce("same", F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    joined = keyed.join(classes, "same", "left")
    out = joined.select(F.col("id").alias("doc_id"), F.coalesce("rep", "id").alias("rep_id"), F.coalesce("root", "rep", "id").alias("class_id"))
    out._parts = (all_rows, signed, roots)  # what it reads
    return out


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose id is the least of their class, with all columns; rows without an id stay."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, threshold=threshold)
    gone = keep_narrow(found.where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-copies")
    discard(*found._parts)
    side = sent(gone, gone.count())
    return docs.join(side, docs[doc_id] == side["_gone"], "left_anti")
