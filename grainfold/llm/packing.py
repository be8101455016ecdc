"""Best-fit packing of tokenised documents into sequences, by bin completion with branch and bound.

Every text becomes token ids and a final id 0. Only what is longer than a
sequence is cut. The lengths of all pieces are counted; the plan is made over
these counts, at most one number per length, whatever the corpus. Bin
completion takes the largest piece left, enumerates the undominated fillings of
the rest of its sequence, and branches over them; a filling is repeated as often
as its lengths allow. A branch ends when its waste exceeds what a better plan
may waste. Best-fit decreasing gives the first incumbent and completes every
branch. Real pieces are then dealt to the places of the plan by their position
among the pieces of their length.

The search stops when it meets the lower bound, or after ``MAX_NODES`` branches
with the best plan so far; no piece is ever left out.

Defined cases: a null or empty text is one piece of the single id 0. Very long
texts are cut. Ties and repeated rows get places of their own. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.llm.frames import keep_in_folder, pick, tidy
from grainfold.llm.words import LOWER, Rolling, Words, buffers, slices
from grainfold.operators.ordering import add_position

SEQUENCE, END_ID = 2048, 0
MAX_NODES, MAX_FILLINGS, MAX_STEPS = 400, 24, 4_000  # limits of the search, not of the pieces
_CACHED_CHUNKS = 400_000
#: Strings that the tokenizer takes as one id wherever they stand; texts that hold one are coded whole.
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_BLANK, _ALNUM, _PUNCT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = _BLANK
_KIND[[c for c in range(128) if chr(c).isalnum()]] = _ALNUM
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _PUNCT


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of bytes that the tokenizer codes by themselves, with A-Z read as a-z, as its normaliser does.

    None of its words spans white space, nor goes from an ASCII letter or digit on to ASCII punctuation or back
    (an apostrophe, which may begin a short form, and characters outside ASCII are not parted from their neighbours).
    """
    kind = _KIND[data]
    inside = kind != _BLANK
    begins = np.ones(len(data) + 1, bool)  # nothing goes on from the byte before
    begins[1:-1] = ~inside[:-1] | (np.minimum(kind[1:], kind[:-1]) == _ALNUM) & (np.maximum(kind[1:], kind[:-1]) == _PUNCT)
    begins[offsets] = True
    start = np.flatnonzero(inside & begins[:-1])
    after = begins[1:].copy()
    after[:-1] |= ~inside[1:]
    end = np.flatnonzero(inside & after) + 1
    return Words(data, offsets, start, end, np.searchsorted(offsets, start, side="right") - 1, Rolling(LOWER[data]).of(start, end))


class Encoder:
    """Token ids of texts; every different chunk of a worker's texts is coded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = self.tokenizer.token_to_id(_SPECIAL[1])
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode(self, chunks: list[str]) -> list[np.ndarray]:
        """One call for many chunks, with an id between them that none of them holds."""
        if self.cut is None:
            return [self._ids(c) for c in chunks]
        ids = self._ids(_SPECIAL[1].join(chunks))
        ends = np.append(np.flatnonzero(ids == self.cut), len(ids))
        return [ids[a:b] for a, b in zip(np.append(0, ends[:-1] + 1), ends)]

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        coded = []
        for i in range(0, len(chunks), 10_000):
            coded += self._encode(chunks[i : i + 10_000])
        size = np.array([len(c) for c in coded], np.int64)
        start = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, *coded])
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        self.hashes, self.start, self.size = both[order], np.concatenate([self.start, start])[order], np.concatenate([self.size, size])[order]

    def texts(self, column: pa.Array):
        """Token ids of every text in turn."""
        data, offsets = buffers(column)
        for lo, hi in slices(offsets):
            a, b = offsets[lo], offsets[hi]
            part = data[a:b]
            chunks = chunks_of(part, offsets[lo : hi + 1] - a)
            raw = part.tobytes()
            special = any(s.encode() in raw for s in _SPECIAL)
            different, first, which = np.unique(chunks.hash, return_index=True, return_inverse=True)
            if len(self.hashes) > _CACHED_CHUNKS:
                self._forget()
            at = np.minimum(np.searchsorted(self.hashes, different), max(len(self.hashes) - 1, 0))
            new = np.ones(len(different), bool) if not len(self.hashes) else self.hashes[at] != different
            if new.any():
                self._learn(different[new], [raw[chunks.start[i] : chunks.end[i]].decode("utf-8", "replace") for i in first[new].tolist()])
            place = np.searchsorted(self.hashes, different)
            size, start = self.size[place][which], self.start[place][which]
            ends = np.cumsum(size)
            ids = self.pool[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.append(0, ends)[chunks.bounds]
            for d in range(hi - lo):
                own = raw[chunks.offsets[d] : chunks.offsets[d + 1]] if special else b""
                yield self._ids(own.decode("utf-8", "replace")) if any(s.encode() in own for s in _SPECIAL) else ids[bounds[d] : bounds[d + 1]]


def pieces_of(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; the path of the tokenizer is read by the workers."""
    kept = pick(docs, doc_id=doc_id, text=text)

    @tidy
    def cut(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, check = [], [], [], [], []
            for i, ids in enumerate(encoder.texts(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for n, at in enumerate(range(0, len(ids), sequence)):
                    part = ids[at : at + sequence]
                    row.append(i)
                    piece.append(n)
                    start.append(at)
                    length.append(len(part))
                    check.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, check)],
            ], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    names = {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint"}
    schema = kept.select("doc_id", *[F.lit(0).cast(t).alias(n) for n, t in names.items()]).schema
    return kept.mapInArrow(cut, schema)


Filling = tuple[tuple[int, int], ...]  # (length, how many), lengths falling


def best_fit(counts: dict[int, int], room: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts: equal sequences are kept together, with how many there are."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}  # room left -> (filling, how many)
    rests: list[int] = []  # the rooms left, sorted
    import bisect

    def put(rest: int, filling: dict[int, int], times: int) -> None:
        if rest not in groups:
            groups[rest] = []
            bisect.insort(rests, rest)
        groups[rest].append((filling, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rests, length)
            if at == len(rests):
                fit = room // length
                if left >= fit:  # new sequences, best fit fills each before the next
                    put(room - fit * length, {length: fit}, left // fit)
                if left % fit:
                    put(room - left % fit * length, {length: left % fit}, 1)
                break
            rest = rests[at]
            filling, times = groups[rest].pop()
            if not groups[rest]:
                del groups[rest]
                rests.pop(at)
            each = min(rest // length, left)
            take = min(times, left // each)
            put(rest - each * length, filling | {length: filling.get(length, 0) + each}, take)
            if times > take:
                put(rest, filling, times - take)
            left -= each * take
    return [(tuple(sorted(f.items(), reverse=True)), n) for same in groups.values() for f, n in same]


def lower_bound(counts: dict[int, int], room: int) -> int:
    """Sequences that any plan needs: by volume, and by the large pieces that cannot share one (for every threshold)."""
    if not counts:
        return 0
    n, volume = np.zeros(room + 1, np.int64), np.zeros(room + 1, np.int64)
    for length, c in counts.items():
        n[length], volume[length] = c, c * length
    upto, filled = np.cumsum(n), np.cumsum(volume)
    best, half = -(-int(filled[-1]) // room), room // 2
    for k in range(0, half + 1):
        alone = int(upto[-1] - upto[room - k])
        large = int(upto[room - k] - upto[half])
        free = large * room - int(filled[room - k] - filled[half])
        small = int(filled[half] - (filled[k - 1] if k else 0))
        best = max(best, alone + large + max(0, -(-(small - free) // room)))
    return best


def fillings(counts: dict[int, int], rest: int, waste: int) -> list[Filling]:
    """Undominated fillings of ``rest`` that waste no more than allowed, the least waste and the fewest pieces first.

    A filling is dominated if one of its pieces, or two together, can be exchanged
    for one larger piece that is there and fits: the smaller pieces fit wherever
    the larger one would have gone.
    """
    kinds = sorted((k for k in counts if k <= rest), reverse=True)
    smallest = kinds[-1] if kinds else rest + 1
    found: list[tuple[int, int, Filling]] = []
    steps = 0

    def dominated(chosen: list[tuple[int, int]], over: int) -> bool:
        if not over:
            return False
        used = dict(chosen)
        spare = [k for k in kinds if counts[k] > used.get(k, 0)]
        flat = [k for k, n in chosen for _ in range(min(n, 2))]
        singles = set(flat) | {a + b for i, a in enumerate(flat) for b in flat[i + 1 :]}
        return any(s < x <= s + over for s in singles for x in spare)

    def go(i: int, left: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal steps
        steps += 1
        if steps > MAX_STEPS or len(found) >= 4 * MAX_FILLINGS:
            return
        while i < len(kinds) and kinds[i] > left:
            i += 1
        if i == len(kinds):
            if left <= waste and not (left >= smallest and any(k <= left and counts[k] > dict(chosen).get(k, 0) for k in kinds)) and not dominated(chosen, left):
                found.append((left, sum(n for _, n in chosen), tuple(chosen)))
            return
        for n in range(min(counts[kinds[i]], left // kinds[i]), -1, -1):
            go(i + 1, left - n * kinds[i], [*chosen, (kinds[i], n)] if n else chosen)

    go(0, rest, [])
    # what fills exactly is often out of reach of the order above: pairs and triples that fit to the last place
    there = set(kinds)
    for a in kinds[:200]:
        b = rest - a
        if b in there and b <= a and (a != b or counts[a] > 1):
            found.append((0, 2, ((a, 2),) if a == b else ((a, 1), (b, 1))))
    return [f for _, _, f in sorted(set(found))[:MAX_FILLINGS]]


def plan(counts: dict[int, int], room: int = SEQUENCE, max_nodes: int = MAX_NODES) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used, for all pieces, in as few sequences as the search finds."""
    counts = {k: c for k, c in counts.items() if c > 0}
    total, least = sum(k * c for k, c in counts.items()), lower_bound(counts, room)
    best = best_fit(counts, room)
    size = lambda p: sum(n for _, n in p)
    nodes = 0

    def planned(link) -> list[tuple[Filling, int]]:
        out = []
        while link:
            link, step = link
            out.append(step)
        return out

    # A branch: the pieces before it, what is planned before it as a chain, the step it takes, and its waste. The pieces
    # after the step are worked out when the branch is looked at, so that waiting branches cost nothing.
    stack: list = [(counts, None, None, 0)]
    while stack and size(best) > least and nodes < max_nodes:
        before, chain, step, wasted = stack.pop()
        nodes += 1
        allowed = (size(best) - 1) * room - total - wasted
        if allowed < 0:
            continue
        left = before
        if step:
            uses, times = dict(step[0]), step[1]
            left = {k: c - times * uses.get(k, 0) for k, c in before.items() if c > times * uses.get(k, 0)}
            chain = (chain, step)
        whole = planned(chain) + best_fit(left, room)
        if size(whole) < size(best):
            best = whole
            allowed = (size(best) - 1) * room - total - wasted
        if not left or allowed < 0:
            continue
        largest = max(left)
        rest = {k: c - (k == largest) for k, c in left.items() if c - (k == largest) > 0}
        branches = []
        for filling in fillings(rest, room - largest, allowed):
            uses = dict(filling)
            uses[largest] = uses.get(largest, 0) + 1
            over = room - sum(k * n for k, n in uses.items())
            times = min(left[k] // n for k, n in uses.items())
            if over:
                times = min(times, allowed // over)
            if times >= 1:
                branches.append((left, chain, (tuple(sorted(uses.items(), reverse=True)), times), wasted + over * times))
        stack += branches[::-1]  # the first filling is looked at first
    return best


@dataclass
class Places:
    """For every length, the runs of places that the plan has for it."""

    sequence: int
    first_free: int = 0
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)  # (first place, in each sequence, first sequence, offset)

    @classmethod
    def of(cls, planned: list[tuple[Filling, int]], room: int) -> Places:
        out, taken = cls(room), {}
        for filling, times in planned:
            offset = 0
            for length, n in filling:
                out.runs.setdefault(length, []).append((taken.get(length, 0), n, out.first_free, offset))
                taken[length] = taken.get(length, 0) + n * times
                offset += n * length
            out.first_free += times
        return out

    def find(self, length: int, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of the pieces of one length at these positions among them."""
        if length >= self.sequence:
            return self.first_free + position, np.zeros(len(position), np.int64)
        first, each, sequence, offset = np.array(self.runs[length], np.int64).T
        run = np.searchsorted(first, position, side="right") - 1
        inside = position - first[run]
        return sequence[run] + inside // each[run], offset[run] + inside % each[run] * length


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = keep_in_folder(pieces_of(docs, tokenizer, doc_id=doc_id, text=text, sequence=sequence, end_id=end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most one row for every length
    places = Places.of(plan({k: c for k, c in counts.items() if k < sequence}, sequence), sequence)
    before, first = 0, {}
    for length in sorted(counts):
        first[length] = before
        before += counts[length]
    shared = docs.sparkSession.sparkContext.broadcast((places, first))
    placed = add_position(pieces, ["length", "doc_id", "piece"], "position")

    @tidy
    def deal(batches):
        places, first = shared.value
        for batch in batches:
            length, position = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "position"))
            sequence_id, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                sequence_id[at], offset[at] = places.find(int(k), position[at] - first[int(k)])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence_id), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = pieces.limit(0).select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return placed.mapInArrow(deal, schema)
