"""The corpus operators against brute force, on small tables with nulls, ties, copies, long texts and clashing columns."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from grainfold.llm import anchors, bwt, decontaminate, html_text, langid, licenses, minhash, packing, quality, suffix_dedup, toxicity, urls, words
from grainfold.llm.frames import held_out
from grainfold.llm.graph import components
from grainfold.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.oracle import connect, difference

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: names that the operators use themselves
CLASH = {"_slice": 1, "_copy": 2, "id": "x", "found": "y", "key": 3, "hits": 4, "n_words": 5, "kept": "z", "sig": "s", "block": 6}


def plain_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def documents(spark, rows, **extra):
    names = ["doc_id", "text", *extra]
    kinds = ", ".join(["doc_id bigint", "text string", *[f"`{k}` {'int' if isinstance(v, int) else 'string'}" for k, v in extra.items()]])
    return spark.createDataFrame([(i, t, *extra.values()) for i, t in rows], kinds).select(*names)


@pytest.fixture(scope="module")
def rows():
    """Texts with shared passages, exact and near copies, repeated rows, nulls, blanks, other scripts and a long text."""
    r = random.Random(7)
    lexicon = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(2, 6))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(lexicon) for _ in range(n))
    passage = say(40)
    out = []
    for i in range(40):
        out.append((i, say(r.randint(5, 90)) + (". " + passage if i % 5 == 0 else "") + ".\n" + say(20)))
    base = say(150).split()
    for i in range(40, 60):  # near copies: one word changed
        w = list(base)
        w[r.randrange(150)] = "changed"
        out.append((i, " ".join(w)))
    out += [(60, out[3][1]), (61, out[3][1]), (62, None), (63, ""), (64, " \n\t "), (65, "word"), (66, "word"), (67, "日本語 テキスト ДОМ"), (68, say(30_000)), (3, out[3][1]), (None, out[4][1]), (69, "x" * 200_000), (70, "\n".join(["a line that is said again and again here"] * 12))]
    return out


def test_words_are_those_of_the_pattern(rows):
    texts = [t for _, t in rows]
    found = [[] for _ in texts]
    for lo, _, w in words.tokenise(pa.array(texts, pa.string()), limit=4_000):
        raw = w.data.tobytes().translate(words.LOWER_BYTES)
        for a, b, d in zip(w.start, w.end, w.doc):
            found[lo + d].append(raw[a:b].decode())
    assert found == [plain_words(t) for t in texts]
    seen = {}
    for lo, _, w in words.tokenise(pa.array(texts, pa.string()), limit=50_000):
        for h, word in zip(w.hash.tolist(), [w.data[a:b].tobytes().translate(words.LOWER_BYTES) for a, b in zip(w.start, w.end)]):
            assert seen.setdefault(word, h) == h


# -- decontamination ---------------------------------------------------------------------------------------------------


def brute_contamination(rows, items, window=13):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for p in range(len(w) - min(window, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + min(window, len(w))]), set()).add(str(item) if item is not None else "null")
    sizes = {len(k) for k in windows}
    out = []
    for i, text in rows:
        w = plain_words(text)
        hit, names = set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                at = windows.get(tuple(w[p : p + size]))
                if at:
                    hit.update(range(p, p + size))
                    names |= at
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [100_000, 20])
def test_decontamination_equals_brute_force(spark, rows, block_words):
    w = plain_words(rows[0][1])
    items = [(1, " ".join(w[:20])), (2, " ".join(w[5:25])), (3, " ".join(w[2:6])), (4, None), (5, ""), (6, "WORD"), (None, " ".join(w[30:44])), (1, " ".join(w[:20])),
             (7, " ".join(["again"] * 15))]
    rows = [*rows, (80, " ".join(["again"] * 40)), (81, "pre " + " ".join(w[1:16]).upper() + " post")]
    bench = spark.createDataFrame(items, "item_id int, text string").withColumn("found", F.lit(1))
    docs = documents(spark, rows, **CLASH)
    got = decontaminate.scan(docs, bench, block_words=block_words).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=repr) == brute_contamination(rows, items)
    clean = decontaminate.clean(docs, bench, block_words=block_words)
    assert clean.columns == docs.columns
    left = [(r.doc_id, r.text) for r in clean.collect()]
    want = {i: (n, h) for i, n, h, _ in brute_contamination(rows, items)}
    for i, text in left:
        n, h = want[i]
        assert len(plain_words(text)) == (n - h if h and 20 * h >= n else n)
    assert {i for i, _ in left} == {i for i, (n, h) in want.items() if not (h and h == n)}


def test_decontamination_of_empty_tables(spark, rows):
    empty = spark.createDataFrame([], "item_id int, text string")
    got = decontaminate.scan(documents(spark, rows), empty).collect()
    assert len(got) == len(rows) and all(r.n_hit == 0 and r["items"] == [] for r in got)
    assert decontaminate.scan(documents(spark, []), empty).collect() == []


# -- quality -----------------------------------------------------------------------------------------------------------


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, cover = {}, set()
    for p in range(len(w) - 7):
        seen.setdefault(tuple(w[p : p + 8]), []).append(p)
    for at in seen.values():
        if len(at) > 1:
            cover |= {q for p in at for q in range(p, p + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality_measures_and_verdicts(spark, rows):
    rows = [*rows, (90, "# $ % word | word < word > " * 10), (91, "1 2 3 4 5 6 7 8 9 10 " * 3 + "11 12 13 14 15 16 17 18 19 20 21 22 23")]
    docs = documents(spark, rows, **CLASH)
    got = quality.judge(docs, sample_rows=10)
    want = sorted([(i, *brute_quality(t)) for i, t in rows], key=repr)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted([tuple(r[n] for n in names) for r in got.collect()], key=repr) == want
    verdicts = sorted([(r.doc_id, r.kept) for r in got.collect()], key=repr)
    other = quality.judge(docs, rules=quality.RULES[::-1], sample_rows=3)
    assert sorted([(r.doc_id, r.kept) for r in other.collect()], key=repr) == verdicts
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, k in verdicts if k), key=repr)
    assert quality.judge(documents(spark, [])).collect() == []


# -- packing -----------------------------------------------------------------------------------------------------------


def test_packing_is_an_exact_round_trip(spark, rows):
    from tokenizers import Tokenizer

    rows = [*rows, (95, "a <|endoftext|> b<|endoftext|>c"), (96, "e\u0301 É İSTANBUL I'll we've '' 12,5")]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(documents(spark, rows, piece="p", length="l", _pos=1), tokenizer_path()).toPandas()
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    assert sorted([(None if np.isnan(a) else int(a), *map(int, r)) for a, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist()], key=repr) == sorted(want, key=repr)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == g.length.cumsum().to_numpy() - g.length.to_numpy()).all() and g.length.sum() <= 2048
    full = int((got.length == 2048).sum())
    counts = got[got.length < 2048].length.value_counts().to_dict()
    assert got.sequence_id.nunique() - full == packing.lower_bound(counts, 2048)
    assert packing.pack(documents(spark, []), tokenizer_path()).collect() == []


def fewest_bins(sizes, room):
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in sorted(set(bins)):
            if k >= sizes[i]:
                rest = list(bins)
                rest.remove(k)
                go(i + 1, [*rest, k - sizes[i]])
        go(i + 1, [*bins, room - sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(30))
def test_plan_uses_every_piece_in_the_fewest_sequences(seed):
    r = random.Random(seed)
    sizes = [r.randint(3, 15) for _ in range(r.randint(1, 11))]
    counts = {s: sizes.count(s) for s in sizes}
    plan = packing.plan(counts, 20)
    used: dict = {}
    for filling, times in plan:
        assert sum(k * n for k, n in filling) <= 20
        for k, n in filling:
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    assert packing.lower_bound(counts, 20) <= sum(n for _, n in plan) == fewest_bins(sizes, 20)


def test_plan_beats_best_fit_where_that_wastes():
    counts = {44: 2, 30: 2, 26: 2, 50: 1, 25: 2}  # best fit leaves room that a completion fills
    assert sum(n for _, n in packing.plan(counts, 100)) == packing.lower_bound(counts, 100) == 3


# -- licences ----------------------------------------------------------------------------------------------------------


def test_licences_follow_ordered_rules(spark):
    s = licenses.SENTENCES
    mit = f"{s[3].upper()}: {s[4]}."
    rows = [(1, "Intro. Released under the MIT License."), (2, mit), (3, f"{s[19]}:\n{s[20]}.\n{s[21]}.\n{s[22]}."), (4, f"{s[19]}. {s[20]}. something else. {s[21]}."),
            (5, f"{s[19]}. All rights reserved. {s[20]}. {s[21]}."), (6, None), (7, ""), (8, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0!"), (2, mit), (None, "SPDX-License-Identifier: MIT")]
    got = licenses.scan(documents(spark, rows, **CLASH))
    found = sorted([(r.doc_id, tuple(r.licences), r.n_known) for r in got.collect()], key=repr)
    assert found == sorted([
        (1, ("MIT",), 1), (2, ("MIT",), 2), (2, ("MIT",), 2), (3, ("BSD-3-Clause",), 4), (4, ("BSD-2-Clause",), 3), (5, ("LicenseRef-all-rights-reserved",), 4), (6, (), 0), (7, (), 0),
        (8, ("Apache-2.0", "CC-BY-NC-4.0"), 2), (None, ("MIT",), 1)], key=repr)
    assert licenses.scan(documents(spark, [])).collect() == []


MIT = """MIT License

Copyright (c) 2024 The Authors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */
int main() { return 0; }
"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


@pytest.mark.parametrize("text,licences,sequence", [
    (MIT, ["MIT"], 3), (MIT.replace("\n", "\r\n"), ["MIT"], 3), (BSD_2, ["BSD-2-Clause"], 3), (BSD_3, ["BSD-3-Clause"], 4), (APACHE, ["Apache-2.0"], 4), (GPL, ["GPL-3.0-or-later"], 2),
    ("// SPDX-License-Identifier: MIT\n#include <x.h>", ["MIT"], 1), ("# SPDX-License-Identifier: Apache-2.0\n\nimport x", ["Apache-2.0"], 1),
    ("/* SPDX-License-Identifier: GPL-3.0-or-later */", ["GPL-3.0-or-later"], 1), ("SPDX-License-Identifier: MIT-0", [], 0),
    ("a line\nReleased under the MIT License\nand another", ["MIT"], 1), ("It is not released under the MIT license.", [], 0),
    ("Released under the ~ | MIT | license.", ["MIT"], 1), ("日本語。\n\nAll rights reserved.", ["LicenseRef-all-rights-reserved"], 1),
])
def test_wrapped_licences_headers_and_tags(spark, text, licences, sequence):
    found = licenses.scan(documents(spark, [(1, text), (2, "Words before. " + text + "\n\nWords after.")])).orderBy("doc_id").collect()
    assert [r.licences for r in found] == [licences] * 2 and [r.n_known for r in found] == [sequence] * 2


# -- URLs --------------------------------------------------------------------------------------------------------------

URL_RULES = (urls.HostRule("block", "net", "/"), urls.HostRule("allow", "example.net", "/en/"), urls.HostRule("allow", "org", "/fr/"))


def brute_urls(pages, listed):
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        return host.translate({c: c + 32 for c in range(65, 91)}), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]

    def canonical(host, path):
        return (re.sub(":(80|443)$", "", re.sub(r"^www\.", "", host)), path.strip("/")) if host else None

    known, out = {canonical(*split(u)) for u in listed} - {None}, []
    for i, url in pages:
        host, path = split(url)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        out.append((i, host, path, best and best.text, best.verdict if best else "block" if canonical(host, path) in known else "allow"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_urls_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", broadcast)
    r = random.Random(3)
    pages = [(i, f"http{r.choice(['', 's'])}://{r.choice(['', 'www.', 'M.'])}h{r.randrange(30)}.{r.choice(['com', 'org', 'net', 'example.net', 'Xnet'])}{r.choice(['', '/', '/en/1', '/fr/2/', '/p?q=/en/', '#x'])}") for i in range(400)]
    pages += [(1000 + i, "http://hot.com/a") for i in range(300)] + [(2000, None), (2001, "no scheme/en/"), (2002, "http://"), (2003, ""), (2004, "x://a.net"), (0, pages[0][1]), (None, "http://h1.com/")]
    listed = ["http://www.HOT.com:80/a/", "https://h1.com", "https://h2.org/en/1", None, "", "nothing", "https://h1.com"]
    table = spark.createDataFrame(pages, "page_id bigint, url string").withColumn("block", F.lit(1)).withColumn("key", F.lit("k")).withColumn("listed", F.lit(1))
    got = urls.judge(table, spark.createDataFrame([(u,) for u in listed], "url string"), URL_RULES)
    assert sorted([(x.page_id, x.host, x.path, x.rule, x.verdict) for x in got.collect()], key=repr) == brute_urls(pages, listed)
    none = urls.judge(table, spark.createDataFrame([], "url string"), ())
    assert {x.verdict for x in none.collect()} == {"allow"} and none.count() == len(pages)


# -- languages ---------------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = langid.fit(docs, ~held_out("doc_id"))
    found = langid.predict(docs, model).join(docs, "doc_id").where(held_out("doc_id"))
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count()
    odd = langid.predict(documents(spark, [(1, None), (2, ""), (3, "12 34 !"), (4, "der die das und"), (None, "the of and")], score=1, lang_pred="x"), model).collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in odd)


def test_language_without_labels(spark):
    docs = documents(spark, [(1, "abc"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs, F.lit(True))).collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0), F.lit(True))).collect() == []


def test_held_out_texts_leave_no_trace_in_the_model(spark):
    r = random.Random(2)
    say = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(12))
    rows = [(i, say("abcd" if i % 2 else "wxyz"), "one" if i % 2 else "two") for i in range(300)]
    models = []
    for changed in (lambda t: t, lambda t: "ÄÖÜ " + t[::-1], lambda t: None):
        out = [(i, t if zlib.crc32(str(i).encode()) % 3 != 1 else changed(t), v) for i, t, v in rows] + [(1000, changed("no language"), None)]
        models.append(langid.fit(spark.createDataFrame(out, "doc_id bigint, text string, lang string"), ~held_out("doc_id")))
    for m in models[1:]:
        assert (m.idf == models[0].idf).all() and (m.weights == models[0].weights).all() and m.temperature == models[0].temperature


def test_a_rare_language_is_learnt_from_a_large_table(spark):
    r = random.Random(6)
    say = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(20))
    rows = [(i, say("abcdef" if i % 2 else "uvwxyz"), "one" if i % 2 else "two") for i in range(20_000)] + [(10**6 + i, say("жзийкл"), "rare") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True), max_labelled=300, least=50)
    assert model.langs == ["one", "rare", "two"]
    asked = documents(spark, [(1, say("жзийкл")), (2, say("abcdef")), (3, say("uvwxyz"))])
    assert [x.lang_pred for x in langid.predict(asked, model).orderBy("doc_id").collect()] == ["rare", "one", "two"]


def test_temperature_lowers_the_loss():
    r = np.random.default_rng(1)
    logits = r.normal(size=(500, 3))
    labels = np.array([r.choice(3, p=langid._softmax(x / 2)) for x in logits])
    assert 1.2 < langid.temperature(logits, labels) < 4


# -- toxicity ----------------------------------------------------------------------------------------------------------


def test_toxicity_ranks_held_out_documents(spark, folder):
    path = folder.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(path + "/documents.parquet"), spark.read.parquet(path + "/labels.parquet")
    model = toxicity.fit(docs, labels, ~held_out("doc_id"))
    found = toxicity.score(docs, model).join(labels, "doc_id").where(held_out("doc_id")).toPandas()
    rank, toxic = found.score.rank().to_numpy(), found.toxic.to_numpy() == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.93
    flagged = found.score >= 0.7
    assert (flagged & toxic).sum() >= 0.75 * toxic.sum() and (flagged & ~toxic).sum() <= 0.1 * flagged.sum() + 3
    odd = toxicity.score(documents(spark, [(1, None), (2, ""), (3, "idiot " * 50_000), (1, None)], score="s"), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd) and odd[0].score == odd[1].score


def test_toxicity_without_labels(spark, rows):
    docs = documents(spark, rows)
    none = spark.createDataFrame([(1, None), (2, 7)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, one, F.lit(True))).collect()} == {1.0}


# -- repeated strings --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(25))
def test_transform_and_prefixes_equal_a_sort(seed):
    r = random.Random(seed)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 12))]
    data, length = np.frombuffer(b"".join(strings) + b"x", np.uint8), np.array([len(s) for s in strings])
    transform, prefix = bwt.build(data, np.cumsum(length) - length, length, 4)
    string, offset = bwt.suffixes(transform, len(strings), length)
    order = [strings[s][o:] for s, o in zip(string, offset)]
    assert order == sorted(order) and len({*zip(string.tolist(), offset.tolist())}) == len(order) == sum(length) + len(strings)
    for a, b, p in zip(order, order[1:], prefix[1:]):
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert p == min(common, 4)
    assert [int(t) - 1 for t in transform] == [strings[s][o - 1] if o else -1 for s, o in zip(string, offset)]


def test_transform_is_rewritten_in_its_files(monkeypatch):
    opened = []
    monkeypatch.setattr(bwt, "open", lambda path, mode: opened.append(mode) or open(path, mode), raising=False)
    files = bwt._Files()
    for values in (b"abcdef", b"xyz", b"", b"lmnopqrst"):
        files.write("transform", np.frombuffer(values, np.uint8))
        assert files.read("transform").tobytes() == values
    files.close()
    assert opened == ["w+b"] and not os.path.exists(files.folder.name)


def test_tables_of_powers_stay_where_they_were_made():
    buffer = np.arange(1 << 20, dtype=np.uint64).astype(np.uint8)
    here = words.Rolling(buffer)  # the driver has the tables now
    sent = cloudpickle.dumps(words.Rolling)
    assert len(sent) < 100_000
    place = np.array([0, 7, 1000])
    assert (cloudpickle.loads(sent)(buffer).of(place, place + 50) == here.of(place, place + 50)).all()


def test_equal_windows_have_one_anchor():
    r = random.Random(2)
    same = bytes(r.choice(b"abcd ") for _ in range(300))
    texts = [bytes(r.choice(b"abcd ") for _ in range(n)) + same + b"tail" * n for n in (0, 3, 70)] + [b"short"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found = anchors.segments(data, offsets, limit=100)
    windows = {}
    for t, a, b, k in zip(found.text, found.start, found.end, found.anchor):
        for p in range(a, b - 49):
            assert offsets[t] <= p and p + 50 <= offsets[t + 1]
            assert windows.setdefault(data[p : p + 50].tobytes(), k) == k
    assert sum(b - a - 49 for a, b in zip(found.start, found.end)) == sum(max(len(t) - 49, 0) for t in texts)


def brute_removed(rows, window=50):
    first: dict = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for p in range(len(raw) - window + 1):
                w = raw[p : p + window]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for p in range(len(raw) - window + 1):
                if first[raw[p : p + window]] < i:
                    gone[p : p + window] = b"\x01" * window
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slice_bytes", [20_000, 16 << 20])
def test_removed_bytes_equal_brute_force(spark, rows, slice_bytes):
    docs = documents(spark, rows, id="c", n_bytes="d", found="e", bytes="f")
    got = suffix_dedup.measure(docs, slice_bytes=slice_bytes)
    want = brute_removed(rows)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want
    left = suffix_dedup.remove(docs, slice_bytes=slice_bytes)
    assert left.columns == docs.columns
    assert len(left.collect()) == len(rows) - sum(n > 0 and n == g for _, n, g, _, _ in want)


def test_an_anchor_with_many_strings_is_ordered_in_several_collections(spark):
    r = random.Random(8)
    say = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    common = say(45)  # every text has it, in surroundings of its own or of a few others
    around = [(say(30), say(30)) for _ in range(60)]
    rows = [(i, say(20) + r.choice(around)[0] + common + r.choice(around)[1] + say(20)) for i in range(400)] + [(1000 + i, say(60) + common + say(60)) for i in range(100)]
    got = suffix_dedup.measure(documents(spark, rows), collection_bytes=2_000)
    assert sorted([tuple(x) for x in got.collect()], key=repr) == brute_removed(rows)
    whole = suffix_dedup.measure(documents(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_collections_part_only_an_anchor_that_holds_too_much():
    anchor, size, alone = np.array([1, 1, 2, 3, 3, 3, 3, 4, 5]), np.array([3, 3, 9, 4, 4, 4, 4, 2, 2]), np.array([0, 0, 1, 0, 0, 0, 0, 0, 0], bool)
    assert [*suffix_dedup._collections(anchor, size, alone, 8)] == [[(0, 3)], [(3, 5), (5, 7)], [(7, 9)]]
    assert [*suffix_dedup._collections(anchor, size, alone, 1)] == [[(0, 1), (1, 2)], [(3, 4), (4, 5), (5, 6), (6, 7)], [(7, 8)], [(8, 9)]]


def test_more_slices_than_spark_allows_buckets_and_no_table_left_behind(spark, rows):
    before = {t.name for t in spark.catalog.listTables()}
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "4")
    try:
        got = suffix_dedup.measure(documents(spark, rows, **CLASH), slice_bytes=10_000)
        assert sorted([tuple(x) for x in got.collect()], key=repr) == brute_removed(rows)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    assert {t.name for t in spark.catalog.listTables()} == before


def test_ids_above_the_whole_numbers_of_a_double_beside_null_ids(spark):
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(300))
    big = 1 << 60
    rows = [(big + 1, "x" + text), (big, "y" + text), (big + 2, "z" + text[100:]), (None, text), (None, None)]
    got = suffix_dedup.measure(documents(spark, rows))
    assert sorted([tuple(x) for x in got.collect()], key=repr) == brute_removed(rows)


def test_removed_bytes_of_an_empty_table(spark):
    assert suffix_dedup.measure(documents(spark, [])).collect() == []


# -- near duplicates ---------------------------------------------------------------------------------------------------


def brute_classes(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = plain_words(t)
        if w and i is not None:
            grams = [tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))]
            sets[i] = {g: grams.count(g) for g in set(grams)} if len(grams) < 500 else dict.fromkeys(grams, 1)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                x, y = sets[a], sets[b]
                plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
                prob = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
                if max(plain, prob) >= threshold - 1e-12 and find(a) != find(b):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("small", [64, 2])
def test_classes_equal_brute_force(spark, rows, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    docs = documents(spark, rows, **CLASH)
    got = minhash.near_duplicates(docs).collect()
    want = brute_classes(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id in want} == want
    assert all(r.class_id == r.doc_id for r in got if r.doc_id not in want)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i is None or want.get(i, i) == i}
    assert minhash.near_duplicates(documents(spark, [])).collect() == []


def family(seed, size, words, changed, further):
    """Texts of one template that are pairwise below the threshold, but for (2i, 2i + 1), which differ in ``further`` words."""
    r = random.Random(seed)
    template = [f"w{i}" for i in range(words)]
    out = []
    for i in range(0, size, 2):
        one = list(template)
        for p in r.sample(range(10, words - 10), changed):
            one[p] = f"x{i}y{p}"
        two = list(one)
        for p in r.sample([p for p in range(10, words - 10) if one[p][0] == "w"], further):
            two[p] = f"z{i}y{p}"
        out += [(i, " ".join(one)), (i + 1, " ".join(two))]
    return out


def plain_classes(texts, threshold=0.8):
    """Classes of texts without a repeated shingle, by all pairs."""
    grams = [{tuple(w[p : p + 5]) for p in range(len(w) - 4)} for w in (t.split() for _, t in texts)]
    least = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(grams[a] & grams[b]) >= (threshold - 1e-12) * len(grams[a] | grams[b]) and least[a] != least[b]:
            x, y = sorted((least[a], least[b]))
            least = [x if v == y else v for v in least]
    return least


def test_pairs_of_one_template_are_found_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    texts = family(5, 600, 300, 7, 6)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    want = plain_classes(texts)
    assert 250 < len(set(want)) < 600
    assert [got[i] for i in range(600)] == want


def test_prefixes_of_similar_texts_meet():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.sort(r.integers(0, 60, 80).astype(np.uint32))
        b = np.sort(np.concatenate([a[r.random(len(a)) < 0.85], r.integers(0, 60, 8).astype(np.uint32)]))
        count = np.full(minhash.RARITY, 2)
        count[:60] = r.integers(2, 9, 60)
        if max(minhash.similarity(a, b)) >= 0.8:
            assert set(minhash.prefix(a, count, 0.8)) & set(minhash.prefix(b, count, 0.8))


def test_sketches_of_similar_texts_are_near():
    r = np.random.default_rng(4)
    most, far = minhash.differing(0.8), 0
    for _ in range(60):
        a = r.integers(0, 1 << 32, 400, dtype=np.uint32)
        b = np.concatenate([a[:356], r.integers(0, 1 << 32, 44, dtype=np.uint32)])  # 356 of 444 in common
        c = np.concatenate([a[:270], r.integers(0, 1 << 32, 130, dtype=np.uint32)])  # half in common
        weighted = np.repeat(a, r.integers(1, 3, 400))
        plain, heavy = minhash.sketches([np.sort(x) for x in (a, b, c, weighted)])
        gap = lambda x, y: int(np.bitwise_count(x ^ y).sum())
        assert gap(plain[0], plain[1]) <= most and gap(plain[0], plain[3]) == 0 and gap(heavy[0], heavy[3]) > 0
        far += gap(plain[0], plain[2]) > most
    assert far == 60


def test_a_repeated_block_does_not_part_near_copies(spark):
    names = [f"v{i}" for i in range(200)]
    texts = [(i, " ".join(w)) for i, w in enumerate((names, names + names[:24] * 20, names[:100] + names[60:100] * 15 + names[100:], ["other", *names[:24]]))]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert brute_classes(texts) == got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_bands_share_no_register(spark):
    sigs = np.zeros((minhash.REGISTERS + 1, minhash.REGISTERS), np.uint32)
    sigs[1:] += np.eye(minhash.REGISTERS, dtype=np.uint32)  # each differs from the first in one register
    signed = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "id bigint, sig binary")
    keys = {}
    for r in minhash._bands(signed).collect():
        keys.setdefault(r["id"], set()).add(r["key"])
    bands = minhash.REGISTERS // minhash.BAND
    assert all(len(keys[0] & keys[i]) == bands - 1 for i in range(1, len(sigs)))


def test_signatures_estimate_probability_jaccard():
    key = words.mix(np.arange(1000, dtype=np.uint64))
    a, b = np.arange(0, 700), np.arange(300, 1000)
    weight = 1 + (np.arange(1000) % 3)
    doc = np.repeat([0, 1], 700)
    sig = minhash.signatures(doc, np.concatenate([key[a], key[b]]), np.concatenate([weight[a], weight[b]]), 2, 2000)
    names = [np.sort(np.repeat((key[x] >> np.uint64(32)).astype(np.uint32), weight[x])) for x in (a, b)]
    prob, plain = minhash.similarity(*names)
    assert abs(plain - 0.4) < 0.01 and abs((sig[0] == sig[1]).mean() - prob) < 0.05


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (200, 150)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 150: 150, 200: 150}


# -- pages -------------------------------------------------------------------------------------------------------------


def test_pages_are_laid_out():
    page = ("<html><head><title>T &amp; x</title><style>.ad, i#q{display:none} p{margin:0}</style></head><body><h1>Head<p>one  two <b>bold</b><br>next<p>three"
            "<ul><li>a<li>b<ol start=3><li>x</li><li>y</ol><li>c</ul><div class='z ad'>hid</div><div hidden>no</div><i id=q>no</i><span style='display : none'>no</span>"
            "<table><caption>Cap</caption><tr><th>Name<th>Value<tr><td>longer cell<td>1<tr><td colspan=2>both</table><pre>\n a  b\n   c</pre><details><summary>S</summary>closed</details>"
            "<script>if (a < b) '</p>'</script><noscript>plain</noscript><blockquote>q</blockquote>end<!-- x --> tail &lt;b&gt;")
    out = html_text.render(page)
    assert out.title == "T & x" and (out.items, out.tables) == (5, 1)
    assert "\n".join(out.lines) == ("Head\n\none two bold\nnext\n\nthree\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nCap\nName        | Value\nlonger cell | 1\nboth\n\n a  b\n   c\n\nS\nplain\n\n  q\n\nend tail <b>")


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "deep", "<table><tr><td>" * 500 + "deep", "<ul><li>" * 500 + "deep", "<b" * 5_000 + ">deep", "deep<a href='" + "x" * 10_000, "deep<!-- <p>", "</p></div>deep<br/",
                                  "<p>" * 50_000 + "deep", "<a '" * 2_000 + ">deep"])
def test_odd_pages_keep_their_text(page):
    assert "deep" in "\n".join(html_text.render(page).lines) or "<b" in page or "<a '" in page


def test_pages_of_the_table_keep_every_visible_word(spark, folder):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("head", "script", "style")

        def handle_endtag(self, tag):
            self.off -= tag in ("head", "script", "style")

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    pages = spark.read.parquet(folder + "/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages.withColumn("text", F.lit(1))).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        assert re.sub(r"[\s-]+", "", got[r.page_id].text) == re.sub(r"[\s-]+", "", "".join(plain.out)), r.page_id
    odd = html_text.extract(spark.createDataFrame([(1, None), (2, ""), (2, "")], "page_id int, html string")).collect()
    assert [r.text for r in odd] == [None, "", ""]
    assert html_text.extract(pages.limit(0)).collect() == []


# -- registered queries ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), connect(folder).sql(ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_a_row_for_every_row(spark, folder, name):
    table = "pages" if name.startswith("op10") else "documents"
    found = QUERIES[name](spark, folder)
    ids = found.select(found.columns[0]).distinct().count()
    assert ids == spark.read.parquet(f"{folder}/{table}.parquet").count()
