"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words build one automaton. Words of a text are streamed through it;
at every word the automaton knows the longest run of words, ending there, that
occurs in some item. A run of ``window`` words (or a whole shorter item) is an
occurrence; its words are hit. Only stretches of a text whose words and word
pairs all occur in items are streamed, because no match crosses their borders.

The automaton is built from at most ``block_words`` words at a time. A larger
benchmark is worked on in several blocks, one pass over the texts each, so what
is sent to the workers has a fixed bound.

Defined cases: a null or empty text has no words, no hits and is not
contaminated. A null or wordless item has no window. A null item id is the
string ``null``. Items with the same id count once. Repeated rows of documents
get a row each. An empty benchmark leaves every text as it is. Other columns of
either table are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.llm.frames import keep_in_folder, numbered, pick, tidy
from grainfold.llm.words import LOWER_BYTES, Words, buffers, tokenise, words_of

WINDOW, BLOCK_WORDS = 13, 100_000


def split_words(text: str | None) -> list[bytes]:
    data, offsets = buffers(pa.array([text], pa.string()))
    words = words_of(data, offsets)
    raw = data.tobytes().translate(LOWER_BYTES)
    return [raw[a:b] for a, b in zip(words.start, words.end)]


@dataclass
class ItemAutomaton:
    """Suffix automaton over the words of several items, with the items of every window."""

    window: int = WINDOW
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    @classmethod
    def build(cls, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> ItemAutomaton:
        self = cls(window)
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.names = sorted({name for name, _ in coded})
        number = {name: i for i, name in enumerate(self.names)}
        #: state of a full window -> items; state of a whole short item -> (its length, item)
        self.full: dict[int, set[int]] = {}
        short: dict[int, set[tuple[int, int]]] = {}
        for name, codes in coded:
            size, state = min(window, len(codes)), 0
            for i, c in enumerate(codes):
                state = self.step[state][c]
                if i + 1 >= size:
                    at = self._state_of(state, size)
                    if size == window:
                        self.full.setdefault(at, set()).add(number[name])
                    else:
                        short.setdefault(at, set()).add((size, number[name]))
        #: for every state, the short items that end there, with those of its suffixes
        self.short: dict[int, list[tuple[int, int]]] = {}
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            found = [*short.get(s, ()), *self.short.get(self.link[s], ())]
            if found:
                self.short[s] = found
        self.least = min((min(window, len(c)) for _, c in coded), default=0)
        pairs = {a * len(self.vocabulary) + b for _, c in coded for a, b in zip(c, c[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.spelling = list(self.vocabulary)
        joined = words_of(*buffers(pa.array([b" ".join(self.spelling).decode("utf-8", "replace")], pa.string())))
        order = np.argsort(joined.hash, kind="stable")
        self.hashes, self.codes = joined.hash[order], order.astype(np.int64)
        return self

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        twin = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    def _state_of(self, state: int, size: int) -> int:
        """The state that holds the suffix of ``size`` words."""
        while self.length[self.link[state]] >= size and state:
            state = self.link[state]
        return state

    def stream(self, codes: list[int]):
        """(place of the last word, first word of the occurrence, items) for all occurrences in a run of words."""
        state, matched = 0, 0
        for i, c in enumerate(codes):
            while c not in self.step[state] and state:
                state = self.link[state]
                matched = self.length[state]
            if c in self.step[state]:
                state, matched = self.step[state][c], matched + 1
            else:
                matched = 0
            if matched >= self.window:
                yield i, i - self.window + 1, self.full.get(self._state_of(state, self.window), ())
            for size, item in self.short.get(state, ()):
                if size <= matched:
                    yield i, i - size + 1, (item,)

    def runs(self, words: Words) -> list[tuple[int, int, list[int]]]:
        """Stretches of words that could hold an occurrence: first word, word after the last, their codes."""
        if not self.least or not len(words.hash):
            return []
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        known = self.hashes[at] == words.hash
        code = np.where(known, self.codes[at], -1)
        joins = np.zeros(len(code), bool)  # word i goes on from word i - 1
        both = np.flatnonzero(known[1:] & known[:-1] & (words.doc[1:] == words.doc[:-1])) + 1
        if len(both) and len(self.pairs):
            pair = code[both - 1] * len(self.spelling) + code[both]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joins[both] = self.pairs[place] == pair
        first = np.flatnonzero(known & ~joins)
        after = np.flatnonzero(known & ~np.append(joins[1:], False)) + 1
        raw, out = words.data, []
        for a, b in zip(first[long := after - first >= self.least].tolist(), after[long].tolist()):
            codes = code[a:b].tolist()
            spelt = all(raw[words.start[a + i] : words.end[a + i]].tobytes().translate(LOWER_BYTES) == self.spelling[c] for i, c in enumerate(codes))
            if spelt:  # equal hashes of different words would be caught here
                out.append((a, b, codes))
        return out

    def hits(self, words: Words, texts: int) -> list[tuple[list[tuple[int, int]], set[int]] | None]:
        """For every text, its hit stretches (words counted over the slice, united and ordered) and its items."""
        out: list = [None] * texts
        for a, _, codes in self.runs(words):
            for last, first, items in self.stream(codes):
                d = int(words.doc[a])
                spans, found = out[d] = out[d] or ([], set())
                spans.append((a + first, a + last + 1))
                found.update(items)
        return [h and (united(h[0]), h[1]) for h in out]


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_words: int):
    """Items in blocks of at most so many bytes that a block has no more than the given words."""
    items = pick(benchmark, item=item_id, text=item_text).select(
        F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = max(1, -(-total // (2 * block_words)))
    if count == 1:
        yield [(r["item"], r["text"]) for r in items.toLocalIterator()]
        return
    # An item's words stay together; a hash deals the items out evenly.
    dealt = keep_in_folder(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(2 * count))), "benchmark")
    for b in range(2 * count):
        yield [(r["item"], r["text"]) for r in dealt.where(F.col("block") == b).toLocalIterator()]


@dataclass
class _Found:
    """What a pass holds of one text: number of words, hit words, hit bytes, items."""

    n: int = 0
    words: list[tuple[int, int]] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    items: set[str] = field(default_factory=set)

    @property
    def n_hit(self) -> int:
        return sum(b - a for a, b in self.words)


def _find(automaton: ItemAutomaton, texts: pa.Array, before: list[_Found] | None) -> list[_Found]:
    out = before or [_Found() for _ in range(len(texts))]
    for lo, hi, words in tokenise(texts):
        bounds = words.bounds
        for d, n in enumerate(np.diff(bounds).tolist()):
            out[lo + d].n = n
        for d, hit in enumerate(automaton.hits(words, hi - lo)):
            if hit:
                at, found = int(bounds[d]), out[lo + d]
                found.words = united([*found.words, *((a - at, b - at) for a, b in hit[0])])
                begin = words.offsets[d]
                found.spans = [(int(words.start[at + a] - begin), int(words.end[at + b - 1] - begin)) for a, b in found.words]
                found.items |= {automaton.names[i] for i in hit[1]}
    return out


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_FOUND = "struct<n:bigint,n_hit:bigint,words:array<struct<begin:bigint,end:bigint>>,spans:array<struct<begin:bigint,end:bigint>>,items:array<string>>"


def _column(found: list[_Found]) -> pa.Array:
    pairs = lambda spans: [{"begin": a, "end": b} for a, b in spans]
    return pa.StructArray.from_arrays([
        pa.array([f.n for f in found], pa.int64()), pa.array([f.n_hit for f in found], pa.int64()),
        pa.array([pairs(f.words) for f in found], _SPANS), pa.array([pairs(f.spans) for f in found], _SPANS),
        pa.array([sorted(f.items) for f in found], pa.list_(pa.string())),
    ], names=["n", "n_hit", "words", "spans", "items"])


def _read(column: pa.Array) -> list[_Found]:
    spans = lambda rows: [(r["begin"], r["end"]) for r in rows]
    return [_Found(r["n"], spans(r["words"]), spans(r["spans"]), set(r["items"])) for r in column.to_pylist()]


def _over_blocks(docs: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str, window: int, block_words: int):
    """The documents with one more last column: what all blocks of the benchmark found in the text."""
    spark, place, width, out = docs.sparkSession, docs.columns.index(text), len(docs.columns), docs
    schema = out.limit(0).select("*", F.lit(None).cast(_FOUND).alias("found")).schema
    for n, block in enumerate(_blocks(benchmark, item_id, item_text, block_words)):
        automaton = spark.sparkContext.broadcast(ItemAutomaton.build([(i, split_words(t)) for i, t in block], window))

        def work(batches, automaton=automaton, first=n == 0):
            for batch in batches:
                found = _find(automaton.value, batch.column(place), None if first else _read(batch.column(width)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], _column(found)], names=[str(i) for i in range(width + 1)])

        if n:  # one automaton at a time in a worker
            out = keep_in_folder(out, "decontaminate")
        out = out.mapInArrow(_renamed(work, [f.name for f in schema]), schema)
    return out


def _renamed(work, names: list[str]):
    @tidy
    def run(batches):
        for batch in work(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    return run


def scan(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items that occur, and the hit byte ranges ``spans`` of its text."""
    found = _over_blocks(pick(docs, doc_id=doc_id, text=text), "text", benchmark, item_id, item_text, window, block_words)
    return found.select("doc_id", F.col("found.n").alias("n_words"), "found.n_hit", "found.items", "found.spans")


def is_contaminated(n_words: F.Column, n_hit: F.Column, coverage: int = 20) -> F.Column:
    """At least one word of ``coverage`` is hit."""
    return (n_hit > 0) & (n_hit * coverage >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", coverage: int = 20, item_id: str = "item_id",
          item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with the hit spans of contaminated ones cut out of the text; a text left without a word goes.

    A cut is closed with a line break. Uncontaminated rows and all other columns stay as they are.
    """
    place, names = docs.columns.index(text), docs.columns
    found = _over_blocks(numbered(docs), f"c{place}", benchmark, item_id, item_text, window, block_words)

    @tidy
    def cut(batches):
        for batch in batches:
            out, keep = batch.column(place).to_pylist(), []
            for i, f in enumerate(batch.column(len(names)).to_pylist()):
                hit = f["n_hit"] > 0 and f["n_hit"] * coverage >= f["n"]
                keep.append(not (hit and f["n_hit"] == f["n"]))
                if hit:
                    raw, at, rest = out[i].encode(), 0, []
                    for span in f["spans"]:
                        rest.append(raw[at : span["begin"]])
                        at = span["end"]
                    out[i] = b"\n".join([*rest, raw[at:]]).decode()
            columns = [pa.array(out, pa.string()) if i == place else c for i, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return found.mapInArrow(cut, docs.schema)
