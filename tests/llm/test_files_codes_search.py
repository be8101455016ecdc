"""Token files, vector codes and lexical search against brute force, on small tables with nulls, ties, copies, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainfold.llm import lexical_search, token_files, vector_codes
from grainfold.llm.queries import QUERIES, tokenizer_path

CLASH = ("file", "part", "tokens", "first", "row", "tie", "n", "bag", "m", "key", "place", "score", "item", "x", "code", "weight", "position", "l", "s", "salt")


def with_clash(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


# token files


def encode(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]


def plain_tokens(rows):
    """(doc_id, start, n_tokens, ids_crc32) of rows in ascending order of their ids, null first; rows of one id in any order."""
    start, out = 0, []
    for (i, _), ids in zip(rows, encode([t for _, t in rows])):
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    say = lambda n: " ".join("".join(r.choice("abcdeéñß日") for _ in range(r.randint(1, 6))) for _ in range(n))
    return [(i, say(r.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, " \n\t"), (1 << 60, say(9_000)), (103, "# !\" <|endoftext|> #"), (-5, "first"), (104, "same"), (105, "same")]


def test_tokens_come_back_from_the_files(spark, texts):
    docs = with_clash(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5))
    manifest = token_files.write(docs, tokenizer_path(), sequence=64, batch_rows=4)
    assert manifest.count() > 1
    want = plain_tokens(sorted(texts))
    assert sorted(tuple(r) for r in token_files.read(manifest).collect()) == want
    index = sorted(tuple(r) for r in token_files.index(manifest).collect())
    assert [(i, s, n) for i, _, _, s, n in index] == [(i, s, n) for i, s, n, _ in want]


def test_files_hold_all_ids_in_order_and_masks_mark_the_padding(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    manifest = token_files.write(docs, tokenizer_path(), sequence=64, batch_rows=4, pad_id=7)
    found, lost = [], 0
    for r in manifest.orderBy("part").collect():
        file = token_files.Sequences(r["tokens"])
        for i in range(len(file)):
            ids, mask = file[i]
            real = mask.to_numpy(zero_copy_only=False)
            assert len(ids) == len(real) == 64 and (i == len(file) - 1 or real.all())
            assert (ids[~real] == 7).all() and real[: real.sum()].all()
            found.append(ids[real])
            lost += (~real).sum()
        assert lost < 64 * manifest.count()
        with pytest.raises(IndexError):
            file[len(file)]
    assert np.concatenate(found).tolist() == np.concatenate(encode([t for _, t in sorted(texts)])).tolist()


def test_a_sequence_is_a_view_of_the_mapped_file(tmp_path):
    path = str(tmp_path / "x.arrows")
    with pa.OSFile(path, "wb") as sink:
        writer = token_files.SequenceWriter(sink, token_files.id_type(1 << 17), sequence=8, rows=16)
        writer.add(np.arange(8 * 16 * 50 + 3))
        writer.close()
    file = token_files.Sequences(path)
    assert len(file) == 801
    before = pa.total_allocated_bytes()
    held = [file[i][0] for i in (799, 0, 400, 800)]
    assert pa.total_allocated_bytes() == before and not any(h.flags.owndata for h in held)
    assert [h[0] for h in held] == [6392, 0, 3200, 6400] and held[-1].tolist() == [6400, 6401, 6402, 0, 0, 0, 0, 0]
    assert np.concatenate([*file.span(5, 6000)]).tolist() == [*range(5, 6005)]
    with pa.OSFile(path, "rb") as source:  # any reader of the format can read it
        assert sum(b.num_rows for b in pa.ipc.open_stream(source)) == 801


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 256, 257, 512])
def test_sizes_around_the_borders_of_sequences_and_batches(tmp_path, n):
    path = str(tmp_path / "x.arrows")
    with pa.OSFile(path, "wb") as sink:
        writer = token_files.SequenceWriter(sink, np.dtype("<u2"), sequence=64, rows=4)
        for i in range(n):
            writer.add(np.array([i]))
        writer.close()
    file = token_files.Sequences(path)
    assert len(file) == -(-n // 64)
    assert [x for i in range(len(file)) for x in file[i][0][file[i][1].to_numpy(zero_copy_only=False)].tolist()] == [*range(n)]
    assert np.concatenate([*file.span(0, n), np.zeros(0)]).tolist() == [*range(n)]


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    rows = [(None, "a b"), (None, "a b"), (4, "c"), (4, "c"), (4, "d e f"), (4, None)] + [(9, "copy of it")] * 300
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id bigint, text string"), tokenizer_path())
    got = token_files.read(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 4, 4, 4, 4] + [9] * 300
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got[:-1]]]).tolist()
    assert Counter(r["ids_crc32"] for r in got) == Counter(w[3] for w in plain_tokens(rows))
    assert manifest.where("n_documents > 250").isEmpty()  # copies of one id lie in several files
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_files.read(token_files.write(none, tokenizer_path())).isEmpty()


def test_the_query_over_the_whole_table(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_token_files"](spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == plain_tokens(sorted(docs))


# vector codes


def plain_codes(rows, n_parts=8, entries=16, rounds=6):
    """(vec_id, code, error) sorted, and the codebooks, in Python integers; rows are usable and of one length."""
    rows = sorted(([math.floor(4096 * x) for x in v], i) for i, v in rows)
    rows.sort(key=lambda r: r[1])
    size = len(rows[0][0]) // n_parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for v, _ in rows[:entries]] for p in range(n_parts)]
    near = lambda part, book: min((gap(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for v, _ in rows:
                groups.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            for k, members in groups.items():
                book[k] = [sum(c) // len(members) for c in zip(*members)]
    found = [[near(cut(v, p), books[p]) for p in range(n_parts)] for v, _ in rows]
    return sorted((i, bytes(k for _, k in f), sum(d for d, _ in f)) for (_, i), f in zip(rows, found)), books


def vectors(n, dims=16, seed=1, grid=8):
    """Components on a coarse grid, so that distances tie and prefixes are shared."""
    r = random.Random(seed)
    return [(i, [r.randrange(-grid, grid) / 64 for _ in range(dims)]) for i in range(n)]


VECTORS = "vec_id bigint, embedding array<float>, label int"


def coded(spark, rows, **how):
    out, books = vector_codes.compress(with_clash(spark.createDataFrame([(i, v, i % 3 if i is not None and i % 4 else None) for i, v in rows], VECTORS)), **how)
    return [tuple(r) for r in out.select("vec_id", "label", "code", "error", "label_error").collect()], books


def test_codes_are_those_of_brute_force(spark):
    rows = vectors(150) + [(500 + k, vectors(1)[0][1]) for k in range(90)]  # a vector of more than a third of all rows
    got, books = coded(spark, rows)
    want, want_books = plain_codes(rows)
    assert sorted((i, bytes(c), e) for i, _, c, e, _ in got) == want
    assert [b.tolist() for b in books] == want_books
    by_label = Counter()
    for _, label, _, error, _ in got:
        by_label[label] += error
    assert all(total == by_label[label] for _, label, _, _, total in got)


@pytest.mark.parametrize("block", [1, 3, 50])
def test_the_trie_gives_plain_distances_whatever_the_blocks(block):
    r = np.random.default_rng(2)
    leaves = r.integers(-2, 2, (200, 5))
    leaves = leaves[np.lexsort(leaves.T[::-1])]
    entries = r.integers(-3, 3, (7, 5))
    want = ((leaves[:, None] - entries) ** 2).sum(2)
    trie = vector_codes.Trie(entries)
    found = [trie.nearest(leaves[lo : lo + block]) for lo in range(0, 200, block)]
    assert (np.concatenate([e for e, _ in found]) == want.argmin(1)).all()
    assert (np.concatenate([d for _, d in found]) == want.min(1)).all()


def test_the_trie_shares_vectors_of_common_prefixes():
    """The open path goes on over the border of a block: its vectors are not made again."""
    trie = vector_codes.Trie(np.array([[0, 0, 0], [5, 5, 5]]))
    trie.nearest(np.array([[1, 2, 3]]))
    trie.path[2] += 1000  # mark the vector of the prefix (1, 2)
    assert trie.nearest(np.array([[1, 2, 4]]))[1].tolist() == [1021]
    assert trie.nearest(np.array([[1, 3, 0]]))[1].tolist() == [10]


def test_unusable_vectors_are_dropped(spark):
    good = vectors(20)
    bad = [(100, None), (101, []), (102, [None] + [0.5] * 15), (103, [float("nan")] + [0.5] * 15), (104, [float("inf")] + [0.5] * 15), (105, [0.5] * 15), (106, [-float("inf")] * 16)]
    got, books = coded(spark, good + bad)
    want, want_books = plain_codes(good)
    assert sorted((i, bytes(c), e) for i, _, c, e, _ in got) == want and [b.tolist() for b in books] == want_books


def test_few_rows_repeated_rows_and_null_ids(spark):
    same = [(1, [0.25] * 8), (1, [0.25] * 8), (2, [0.5] * 8)]
    got, books = coded(spark, same)
    assert [b.tolist() for b in books] == [[[1024], [1024], [2048]]] * 8
    assert sorted(bytes(c) for _, _, c, _, _ in got) == [bytes(8), bytes(8), bytes([2] * 8)] and all(e == 0 for *_, e, _ in got)
    got, books = coded(spark, [(None, [0.0] * 8), (3, [1.0] * 8)], entries=1)
    assert books[0].tolist() == [[2048]] and len(got) == 2
    got, books = coded(spark, [(1, [0.25] * 9), (2, [0.5] * 9)])  # filled up to 16
    assert [b.shape for b in books] == [(2, 2)] * 8 and len(got) == 2
    huge = coded(spark, [(1, [3e38] * 8), (2, [-3e38] * 8)])
    assert huge[1][0].tolist() == [[1 << 25], [-(1 << 25)]]
    assert coded(spark, []) == ([], [])


def test_label_sums_are_the_same_without_broadcast(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else i % 5, bytes([i % 7]), i) for i in range(200)], "vec_id bigint, label int, code binary, error bigint")
    sent, dealt = (sorted(map(str, vector_codes.with_label_error(rows, n).collect())) for n in (1000, 2))
    assert sent == dealt and len(sent) == 200


def test_codebooks_and_codes_of_the_query(spark, folder):
    r = QUERIES["op12_vector_codes"](spark, folder).head()
    vecs = [(v["vec_id"], v["embedding"]) for v in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, books = plain_codes(vecs)
    assert r["codebooks_sha256"] == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert {w[0]: w[1].hex() for w in want}[r["vec_id"]] == r["code"]


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def plain_search(docs, items, top=20):
    bags = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    bags = [b for b in bags if b[2]]
    n_docs, length = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for i, bag, n in bags:
            m = 100 - 25 + 25 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms_of(text) if t in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if no else i, -s) for rank, (s, no, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def ranked(docs, items, **how):
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **how).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    lexicon = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(120)]
    say = lambda n: " ".join(r.choice(lexicon).upper() if r.random() < 0.2 else r.choice(lexicon) for _ in range(n))
    docs = [(i, say(r.randint(1, 40))) for i in range(120)]
    docs += [(200 + i, docs[7][1]) for i in range(130)]  # a class of more than half of all rows
    docs += [(400 + i, docs[8][1] + " unseen" + str(i)) for i in range(5)]  # equal bags of different texts
    docs += [(None, docs[7][1]), (500, None), (501, ""), (502, " .,-\n"), (503, say(20_000)), (7, docs[7][1]), (504, "x" * 50_000), (505, "ДОМ дом É é")]
    items = [(i, say(r.randint(1, 30))) for i in range(12)] + [(20, None), (21, ""), (22, "nothing#like-it"), (23, docs[7][1]), (24, "a a a a a b"), (25, "ДОМ É"), (None, "b c")]
    return docs, items


def tables(spark, corpus):
    docs, items = corpus
    return with_clash(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)), with_clash(spark.createDataFrame(items, "item_id bigint, text string"))


@pytest.mark.parametrize("top", [3, 20])
def test_ranking_is_that_of_brute_force(spark, corpus, top):
    docs, items = tables(spark, corpus)
    assert ranked(docs, items, top=top) == plain_search(*corpus, top)


def test_blocks_of_items_and_of_scores_change_nothing(spark, corpus, monkeypatch):
    docs, items = tables(spark, corpus)
    assert ranked(docs, items, block_words=100) == plain_search(*corpus)
    monkeypatch.setattr(lexical_search, "CELLS", 64)
    monkeypatch.setattr(lexical_search, "_EXACT", 0)  # the way with integers only
    assert ranked(docs, items) == plain_search(*corpus)


def test_equal_bags_are_one_class_with_its_least_ids(spark, corpus):
    docs, items = corpus
    vocabulary = lexical_search.Vocabulary([t for _, t in items if t is not None])
    kept = lexical_search.bags(spark.createDataFrame(docs, "doc_id bigint, text string"), vocabulary)
    n, length = sum(1 for _, t in docs if terms_of(t)), sum(len(terms_of(t)) for _, t in docs)
    found = lexical_search.classes(kept, n, length, 20).collect()
    words = {t for _, text in items for t in terms_of(text)}
    want = {}
    for i, t in docs:
        bag = Counter(w for w in terms_of(t) if w in words)
        if bag:
            want.setdefault((frozenset(bag.items()), 75 + 25 * len(terms_of(t)) * n // length), []).append(i)
    least = sorted(sorted(m, key=lambda i: (i is None, i))[:20] for m in want.values())
    assert sorted(r["members"] for r in found) == least and len(found) < len(docs) - 130


def test_empty_tables_have_no_ranking(spark, corpus):
    docs, items = tables(spark, corpus)
    assert ranked(docs.limit(0), items) == [] == ranked(docs, items.limit(0))
    assert ranked(docs.where("doc_id in (500, 501, 502)"), items) == []


def test_the_search_query_over_the_whole_tables(spark, folder):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted((tuple(r) for r in QUERIES["op13_lexical_search"](spark, folder).collect()), key=repr) == plain_search(docs, items)
