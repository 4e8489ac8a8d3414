"""Each operator against a brute-force version or its oracle, and odd inputs:
nulls, empty and long texts, ties, repeated rows, empty tables, further columns
with names that the operators use inside."""

import collections
import hashlib
import math
import random
import re
import time
import weakref
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import oracle, rows
from conftest import DATA
from gneiss.llm import bpe, common, fm, licenses, mixing, neardup, ppm, quality, queries, repeats, sharding, topk

SF = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, cls long, n int, key string, kept string"
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(1, 7))) for _ in range(400)]


def text(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def _odd_texts():
    base, long = text(120), text(9000)
    near = base.split()
    near[60] = "changed"
    passage = text(110)
    out = [None, "", " \n\t ", "one", "One", "two words", base, base, " ".join(near), long, long + " end"]
    out += [text(40) + " " + passage + " " + text(40) for _ in range(3)] + ["aaaa" * 300, "ab " * 400, "x\x1cy  z   é中文😀 " * 30, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."]
    return out


ODD = _odd_texts()


def odd_texts():
    return list(ODD)


def frame(spark, texts, repeat=True):
    data = [(i, t, "en", [None, "b", "a", "ä"][i % 4], 1, 2, 3, 4, 5, "k", "v") for i, t in enumerate(texts)]
    if repeat and data:
        data.append(data[6])  # a whole row again
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_texts()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pdf(df, by="doc_id"):
    return df.toPandas().sort_values(by).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(oracle(queries.oracle_sql()[name], SF))


# 1. Sharding.


def test_shards(spark, odd, empty):
    out = pdf(sharding.shard_by_bytes(odd, shards=4))
    texts = dict(enumerate(odd_texts()))
    for r in out.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert len(out) == odd.count() and sharding.shard_by_bytes(empty).count() == 0


def test_shards_are_near_equal_under_a_hot_text(spark):
    docs = frame(spark, [text(30) if i % 3 else "hot " * 30 for i in range(3000)])
    out = pdf(sharding.shard_by_bytes(docs, shards=24))
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() < 1.03 * sizes.mean() and sizes.min() > 0.97 * sizes.mean()
    assert (out.groupby("text_crc32").shard.nunique() > 1).sum() <= 1


# 2. Repeated strings.


def brute_repeats(texts, least):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("members", [1, 3, 1000])  # few members: groups are split into parts
def test_repeats(spark, odd, members, monkeypatch):
    monkeypatch.setattr(repeats, "MEMBERS", members)
    texts = [r.text for r in odd.orderBy("doc_id").collect()]
    out = pdf(repeats.remove_repeats(odd, 400))
    assert list(out[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == brute_repeats(texts, 400)


def test_repeats_of_random_overlaps(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MEMBERS", 4)
    r = random.Random(9)
    pool = ["".join(r.choice("ab") for _ in range(r.randint(20, 160))) for _ in range(6)]
    texts = ["".join(r.choice(pool)[r.randint(0, 15) :] for _ in range(r.randint(1, 5))) for _ in range(60)]
    out = pdf(repeats.remove_repeats(frame(spark, texts, repeat=False), 60))
    assert list(out[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == brute_repeats(texts, 60)


def test_maximal_repeats_give_all_occurrences():
    after = [b"commonXX1", b"commonXX2", b"commonYY", b"other"]
    found = {(back, ahead, tuple(sorted(own))) for back, ahead, own in repeats.maximal_repeats([b"a", b"b", b"c", b"d"], after, 6)}
    assert found == {(0, 8, (0, 1)), (0, 6, (0, 1, 2))}


def test_repeats_of_nothing(empty):
    assert repeats.remove_repeats(empty, 400).count() == 0


# 3. PPM.


def brute_ppm(train, texts):
    order = ppm.ORDER
    count = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    padded = lambda t: bytes([255]) * order + (t or "").encode().lower() + bytes([255])
    for t in train:
        s = padded(t)
        for i in range(order, len(s)):
            for m in range(order + 1):
                count[m][s[i - m : i]][s[i]] += 1
    out = []
    for t in texts:
        s, total = padded(t), 0.0
        for i in range(order, len(s)):
            seen = set()
            for m in range(order, -1, -1):
                near = {c: 2 * n - 1 for c, n in count[m].get(s[i - m : i], {}).items() if c not in seen}
                if not near:
                    continue
                if s[i] in near:
                    total += math.log10(near[s[i]] / (sum(near.values()) + len(near)))
                    break
                total += math.log10(len(near) / (sum(near.values()) + len(near)))
                seen |= set(near)
            else:
                total -= math.log10(256 - len(seen))
        out.append(total)
    return out


def test_ppm_and_its_base(spark, odd):
    for most_words in (400_000, 3):  # all words broadcast, or nearly all joined
        out = pdf(ppm.score(odd, F.col("doc_id") % 3 != 0, most_words))
        texts = [r.text for r in odd.orderBy("doc_id").collect()]
        ids = [r.doc_id for r in odd.orderBy("doc_id").collect()]
        train = [t for i, t in zip(ids, texts) if i % 3]
        words = lambda t: [*(t or "").encode().lower().split(), None]
        count = collections.Counter(w for t in train for w in words(t))
        total = sum(count.values())
        scale = math.log10(total + 0.1 * (len(count) + 1))
        assert (out.held_out == [i % 3 == 0 for i in ids]).all() and (out.train_tokens == total).all()
        assert list(out.n_tokens) == [len(words(t)) for t in texts]
        assert list(out.n_known) == [sum(count[w] > 0 for w in words(t)) for t in texts]
        assert np.allclose(out.base_score, [sum(math.log10(count[w] + 0.1) - scale for w in words(t)) for t in texts])
        assert np.allclose(out.score, brute_ppm(train, texts))


@pytest.mark.parametrize("most_grams", [0, 1, 40])
def test_ppm_scores_by_all_grams(spark, odd, most_grams):
    out = pdf(ppm.score(odd, F.col("doc_id") % 3 != 0, most_grams=most_grams))
    data = odd.orderBy("doc_id").collect()
    assert np.allclose(out.score, brute_ppm([r.text for r in data if r.doc_id % 3], [r.text for r in data]))


def test_ppm_fits_part_by_part(spark, odd):
    counts = ppm.count(odd.select("text", (F.col("doc_id") % 3 != 0).alias("learn"))).cache()
    whole, parts = ({r.key: r.value for r in ppm.fit(counts, chunk).collect()} for chunk in (500_000, 1))
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-9 for k in whole)


def test_ppm_tables_take_little_more_than_they_hold():
    import tracemalloc

    keys = np.unique(np.concatenate([[0, 1], np.random.RandomState(1).randint(2, 2**62, 400_000)]).astype(np.uint64))
    values = np.arange(len(keys)) * 1.0
    tracemalloc.start()
    table = ppm.Table(keys, values)
    size, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < size + 10e6
    assert np.array_equal(table(keys), values)
    few = ppm.Table(keys[1:4], np.array([5.0, -1.0, 0.0]))
    found = few(keys[:1000])
    assert np.isnan(found[[0, *range(4, 1000)]]).all() and found[1:4].tolist() == [5, -1, 0]
    assert np.isnan(ppm.Table(keys[:0], np.empty(0))(keys[:9])).all()


def test_ppm_without_training(odd, empty):
    assert ppm.score(empty, F.lit(True)).count() == 0
    out = pdf(ppm.score(odd, F.lit(False)))
    assert np.allclose(out.score, -math.log10(256) * np.array([len((r.text or "").encode()) + 1 for r in odd.orderBy("doc_id").collect()]))


def test_ppm_learns_more_than_words(spark):
    out = pdf(ppm.score(spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0))
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


# 4. Quality rules.


def brute_quality(t):
    t = t or ""
    raw = t.encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    words = [raw[a:b] for a, b in spans]
    chars = [len(w.decode()) for w in words]

    def cover(n, first):
        at = collections.defaultdict(list)
        for i in range(len(words) - n + 1):
            at[tuple(words[i : i + n])].append(i)
        return {i + k for p in at.values() if len(p) > 1 for i in p[0 if first else 1 :] for k in range(n)}

    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    repeat = len(cover(8, True))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    size = lambda xs: sum(len(x.encode()) for x in xs)
    bad = failed or any(sum(chars[i] for i in cover(n, False)) > limit * sum(chars) for n, limit in quality.WINDOW_LIMITS.items())
    bad = bad or size(dup) > quality.LINE_CHAR_LIMIT * size(lines) or len(dup) > quality.LINE_LIMIT * len(lines)
    return len(words), sum(chars), sum(c in "#*$%&|<>" for c in t), len(dup), repeat, failed, not bad


def test_quality(spark, odd, empty):
    line = text(9)
    extra = [text(60) + "\n" + line + "\n" + text(50) + "\n" + line, "\n".join([line] * 4), text(30) + " # * | <b>", " ".join(text(12) for _ in range(3)) + " " + (text(6) + " ") * 5]
    docs = frame(spark, odd_texts() + extra)
    out = pdf(quality.score(docs))
    want = [brute_quality(r.text) for r in docs.orderBy("doc_id").collect()]
    assert list(out[[*quality.FIELDS, "base_failed", "kept"]].itertuples(index=False, name=None)) == want
    assert quality.score(empty).count() == 0 and quality.keep(empty).columns == empty.columns
    assert quality.keep(docs).count() == sum(w[-1] for w in want)


# 5. Licences.


def test_licences(spark, empty):
    notice = "Licensed under the Apache License, Version 2.0 . You may not use this file except in compliance with the License.\n" + licenses.SENTENCES[7] + "\n" + licenses.SENTENCES[8]
    texts = [None, "", "A. B! C?", "Released under the MIT License.", notice, notice + "\nx y\nLicensed under the Apache License, Version 2.0.", "All rights reserved", "unreleased under the mit license", "x: Licensed under CC BY-NC 4.0.\n" * 2]
    out = pdf(licenses.recognise(frame(spark, texts, repeat=False)))
    assert list(out.licenses) == ["", "", "", "mit", "apache-2.0-notice", "apache-2.0,apache-2.0-notice", "proprietary", "", "cc-by-nc-4.0"]
    assert list(out.n_sentences)[:4] == [0, 0, 3, 1] and out.sentence_ids[8] == "4,4"
    assert licenses.recognise(empty).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
BSD_2 = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD_3 = BSD_2 + """
3. Neither the name of the University of
   California nor the names of its contributors may be used to endorse or
   promote products derived from this software without specific prior written
   permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software."""
CC = """This work is licensed under a Creative Commons
Attribution-ShareAlike 4.0 International License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


@pytest.mark.parametrize("notice,name,kind", [(APACHE, "apache-2.0-notice", "permissive"), (MIT, "mit-text", "permissive"), (BSD_2, "bsd-2-clause", "permissive"), (BSD_3, "bsd-3-clause", "permissive"), (GPL, "gpl-3.0", "copyleft"), (ISC, "isc", "permissive"), (MPL, "mpl-2.0", "copyleft"), (ZLIB, "zlib", "permissive"), (CC, "cc-by-sa-4.0", "copyleft"), (GPL.replace("version 3", "version 2").replace(":", ";"), "gpl-2.0", "copyleft"), (GPL.replace("General", "Affero General"), "agpl-3.0", "copyleft"), (GPL.replace("General", "Lesser General"), "lgpl", "copyleft")])
def test_published_notices(spark, notice, name, kind):
    comment = "".join(f" * {x}\r\n" for x in notice.split("\n"))
    texts = [notice, " ".join(notice.split()), comment, "Some title\n" + notice + "\nMore text", notice.replace(" ", "\n")]
    out = pdf(licenses.recognise(frame(spark, texts, repeat=False)))
    assert list(out.licenses) == [name] * len(texts) and set(out.license_class) == {kind}


def test_a_notice_twice_is_no_shorter_rule(spark):
    short = APACHE.replace("You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n", "")
    texts = [short + "\n\n" + short, APACHE * 3, short + "\n\nLicensed under the Apache License, Version 2.0.\n\n" + short]
    out = pdf(licenses.recognise(frame(spark, texts, repeat=False)))
    assert out.sentence_ids[0] == "1,6,8,1,6,8"
    assert list(out.licenses) == ["apache-2.0-notice-short", "apache-2.0-notice", "apache-2.0,apache-2.0-notice-short"]


def test_licences_need_whole_sentences(spark):
    texts = ["They may be licensed under the MIT License.", "Licensed under the MIT License of old.", "Released under.\nThe MIT License."]
    assert set(pdf(licenses.recognise(frame(spark, texts, repeat=False))).licenses) == {""}


def test_licences_stay_native(spark):
    plan = licenses.recognise(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# 6. Top-k.


def test_top_k(spark):
    r = np.random.default_rng(3)
    data = [(int(i), [float(x) for x in r.normal(size=16)]) for i in range(300)]
    data += [(300, None), (301, [1.0, None] + [0.0] * 14), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (304, [1e5] * 16), (5, data[5][1]), (305, data[5][1]), (306, []), (310, [])]
    out = pdf(topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, block=64), ["query_id", "rank"])
    v = {i: [math.floor(256 * x) for x in e] for i, e in data if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in sorted(v):
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))[:5]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(best, 1)]
    assert [tuple(r) for r in out.itertuples(index=False)] == want


def test_top_k_beyond_exact_doubles(spark):
    step, far = 2.0**-8, 2.0**22
    data = [(0, [far, step])] + [(i, [far, step * (4 - i)]) for i in (1, 2, 3)] + [(4, [2.0**24, 1.0]), (5, [2.0**53, 1.0]), (50, [2.0**-8] * 2)]
    data += [(i, [2.0**-4 * r, 1.0]) for i, r in zip(range(60, 80), np.random.default_rng(2).integers(-9, 9, 20).tolist())]
    out = pdf(topk.top_k(spark.createDataFrame(data[:5] + data[6:], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block=8), ["query_id", "rank"])
    v = {i: [math.floor(256 * x) for x in e] for i, e in data if i != 5}
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:5]
        want += [(q, k, c, -s) for k, (s, c) in enumerate(best, 1)]
    assert [tuple(r) for r in out.itertuples(index=False)] == want
    q, x = np.array([[2.0**61, 3.0]]), np.array([[2.0, 5.0], [2.0, 7.0]])
    assert topk.best(q, np.array([9]), np.array([-np.inf]), x, np.array([1, 2]), 2)[2].tolist() == [2**62 + 21, 2**62 + 15]


def test_top_k_prunes(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(40, 64))
    x = np.floor(256 * (centres[r.integers(0, 40, 4000)] + 0.1 * r.normal(size=(4000, 64))))
    q, ids, count = x[:100], np.arange(4000), []
    low = np.sort(q @ x[:1000].T, axis=1)[:, -6].astype(float)
    at, found, score = topk.best(q, ids[:100], low, x, ids, 5, count=count)
    whole = q @ x.T
    whole[np.arange(100), np.arange(100)] = -np.inf
    assert sorted(score[at == 7].tolist()) == np.sort(whole[7])[-5:].tolist()
    assert sum(c for _, c in count) < 0.5 * sum(n for n, _ in count)


def test_top_k_bound_holds():
    r = np.random.default_rng(1)
    q, x = np.floor(r.normal(0, 60, (20, 64))), np.floor(r.normal(0, 60, (50, 64)))
    for parts in topk.LEVELS:
        assert (topk.segment_stats(q, parts) @ topk.segment_stats(x, parts).T >= q @ x.T - 1e-6).all()


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


# 7. Mixing.


def test_targets():
    assert mixing.fill_to_caps([10, 100, 1000], (1, 2, 3), 3) == [30.0, 300.0, 780.0]
    assert mixing.fill_to_caps([100, 100, 100], (1, 1, 1), 3) == [100.0] * 3


def test_flow_spreads_before_it_deepens():
    sent = mixing.min_cost_flow([10, 10], [15, 15], [[0], [0, 1]], 3)
    assert sum(x.get(0, 0) for x in sent) == 15 and sent[1][1] == 15
    through = [sum(x.values()) for x in sent]
    cost = lambda n: sum(max(0, n - 10 * e) for e in (1, 2))
    best = min(cost(a) + cost(30 - a) for a in range(0, 31) if a <= 15 and 30 - a <= 30)
    assert sum(through) == 30 and sum(map(cost, through)) == best


def test_mix(spark, odd, empty):
    docs = frame(spark, odd_texts() + [text(R.randint(1, 80)) for _ in range(800)])
    out = pdf(mixing.mix(docs, rows_at_edge=50), "id")
    again = pdf(mixing.mix(docs.repartition(7), rows_at_edge=50), "id")
    assert out.drop(columns="pattern").equals(again.drop(columns="pattern"))
    out["source"] = [p[0] for p in out.pattern]
    assert (out.taken <= 3 * out["size"]).all() and len(out) == docs.count()
    for _, g in out.fillna({"source": "-"}).groupby("source"):
        assert g["size"].sum() == g.source_size.iloc[0] and abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert mixing.mix(empty).count() == 0


def test_mix_of_overlapping_sources(spark):
    docs = frame(spark, [text(20) for _ in range(200)], repeat=False)
    both = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    out = pdf(mixing.mix(docs, sources=both), "id")
    assert out.taken.sum() == pytest.approx(out["size"].sum(), rel=0.05)
    assert all(len(s) * n == t for s, n, t in zip(out.serves, out["size"], out.taken))
    served = collections.Counter(s for x in out.serves for s in x)
    want = {p[0]: t for p, t in zip(out.pattern, out.target)}
    assert set(served) == {"a", "b"} and served["a"] * 20 == pytest.approx(want["a"], rel=0.25)


def test_flow_is_the_cheapest_and_quick():
    r = random.Random(7)
    for _ in range(30):  # against all whole-word flows, by dynamic programming over patterns
        n_s = r.randint(1, 3)
        member = [sorted(r.sample(range(n_s), r.randint(1, n_s))) for _ in range(r.randint(1, 4))]
        supply, quota = [r.randint(0, 4) for _ in member], [r.randint(0, 6) for _ in range(n_s)]
        sent = mixing.min_cost_flow(supply, quota, member, 3)
        cost = lambda p, n: sum(max(0, min(n - supply[p] * e, supply[p])) * e for e in range(3))
        best = {tuple(quota): (0, 0)}
        for p, own in enumerate(member):
            after = {}
            for left, (words, spent) in best.items():
                splits = [()]
                for s in own:
                    splits = [x + (k,) for x in splits for k in range(left[s] + 1)]
                for x in splits:
                    if sum(x) <= 3 * supply[p]:
                        to = tuple(v - dict(zip(own, x)).get(s, 0) for s, v in enumerate(left))
                        got = (words - sum(x), spent + cost(p, sum(x)))
                        after[to] = min(after.get(to, got), got)
            best = after
        through = [sum(x.values()) for x in sent]
        assert (-sum(through), sum(cost(p, n) for p, n in enumerate(through))) == min(best.values())
    many = [sorted(r.sample(range(40), r.randint(1, 4))) for _ in range(20_000)]
    sent = mixing.min_cost_flow([r.randint(1, 1000) for _ in many], [500_000] * 40, many, 3)
    assert sum(sum(x.values()) for x in sent) == 40 * 500_000


def test_mix_sums_digits_until_few_rows_are_left(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 7), "s") for i in range(3000)], "doc_id long, text string, source string")
    docs = docs.union(docs.select(F.col("doc_id") + 5000, "text", F.lit("t")))
    a, b = (pdf(mixing.mix(docs, rows_at_edge=n), "id") for n in (10_000, 3))
    assert (a.taken == b.taken).all()


# 8. Quality classifier.


def test_pairs_in_linear_time():
    r = np.random.default_rng(0)
    model = fm.Model(32, np.zeros((fm.STATS, fm.BINS - 1)), 0.3, r.normal(size=32 + fm.STATS * fm.BINS), r.normal(size=(32 + fm.STATS * fm.BINS, 4)))
    f, x = np.array([1, 5, 9, 40]), np.array([0.5, 1.0, 2.0, 0.5])
    brute = model.bias + (x * model.w[f]).sum() + sum(x[i] * x[j] * model.v[f[i]] @ model.v[f[j]] for i in range(4) for j in range(i))
    assert model.logits(np.zeros(4, int), f, x, 1)[0] == pytest.approx(brute)


def test_classifier_on_held_out_rows(spark):
    folder = f"{DATA}/sf0.1"
    out = queries.queries()["op8_factorisation_machine"](spark, folder).toPandas()
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    held = out[out.held_out].merge(labels, on="doc_id")
    rank, good = held.score.rank(), held.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert len(out) == 10_000 and out.score.between(0, 1).all() and auc > 0.97 and (held.predicted == held.quality).mean() > 0.93


def test_classifier_on_odd_input(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1), (6, 0), (7, 1), (9, 0), (None, 1), (8, None)], "doc_id long, quality int")
    assert fm.predict(odd, fm.train(odd, labels, F.lit(True))).where("score between 0 and 1").count() == odd.count()
    none = labels.where("false")
    assert fm.predict(empty, fm.train(empty, none, F.lit(True))).count() == 0
    assert {r.score for r in fm.predict(odd, fm.train(odd, none, F.lit(True))).collect()} != set()


def test_factorisation_machine_learns_from_metadata(spark):
    docs = spark.createDataFrame([(i, "the same text", ["a", "b", None][i % 3], "z") for i in range(300)], "doc_id long, text string, `odd name.x` string, met string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 2).cast("int").alias("quality"))
    model = fm.train(docs, labels, F.col("doc_id") < 200, metadata=("odd name.x", "met"))
    out = pdf(fm.predict(docs, model))
    assert ((out.score > 0.5) == (out.doc_id % 3 == 2)).all()
    without = pdf(fm.predict(docs, fm.train(docs, labels, F.col("doc_id") < 200)))
    assert without.score.nunique() == 1


# 9. BPE.


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        tokens = bpe.read_ranks(f.read())
    return tokens, bpe.Coder(tokens, P.PATTERN, most=50), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_bpe_cuts_a_remembered_piece_no_more(coder, monkeypatch):
    tokens, _, theirs = coder
    coder, cut = bpe.Coder(tokens, bpe.SPACED), []
    monkeypatch.setattr(bpe.Coder, "_cut", lambda self, piece, old=bpe.Coder._cut: cut.append(piece) or old(self, piece))
    text = "The word's, ends.\nHere it's ''so 12 (x3)...\t\nand done"
    assert coder.encode(text) == coder.encode(text) == theirs.encode_ordinary(text)
    assert len(cut) == len(set(cut)) > 5
    # Pieces and matches are remembered together: a match is its only match.
    rng = random.Random(5)
    for _ in range(3000):
        found = coder.find("".join(rng.choice("ab1\u00b2\u00e9' .,\t\n\u00a0slrev\u0301") for _ in range(12)))
        assert all(coder.find(m) == [m] == coder._cut(m) for m in found)


def test_bpe_equals_the_library(coder):
    tokens, own, library = coder
    r = random.Random(2)
    letters = "abcdefgh  \n\t\r\x0b\x1c\x85  éß中文😀'sdtrevml0123½٣.,!#<|endoftext|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += [t or "" for t in odd_texts()] + list(pd.read_parquet(f"{SF}/documents.parquet").text)
    for t in texts:
        assert own.encode(t) == library.encode_ordinary(t)


def test_bpe_in_little_memory_and_by_other_patterns(coder):
    import regex
    import tiktoken

    tokens, _, library = coder
    own = bpe.Coder(tokens, bpe.SPACED, most=3)
    own.fst.most = 20
    r = random.Random(6)
    texts = ["".join(r.choice("abcdeé 中😀") for _ in range(r.randint(200, 400))) for _ in range(20)] + ["x" * 3000, "ab" * 2000]
    for t in texts:
        assert own.encode(t) == library.encode_ordinary(t) and own.fst.made() <= 20
    other = r"\S+\s?|\s+"
    library = tiktoken.Encoding("other", pat_str=other, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    own = bpe.Coder(tokens, other)
    assert regex.findall(other, texts[0]) and all(own.encode(t) == library.encode_ordinary(t) for t in texts)


def test_coders_outlive_tasks(spark):
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    assert bpe.coder_of(ranks, P.PATTERN) is bpe.coder_of(ranks, P.PATTERN) and P.PATTERN == bpe.SPACED
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(4)], "doc_id long, text string").coalesce(1)

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._KEPT)])], ["n"])

    for _ in range(2):
        bpe.tokenize(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert max(r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()) == 1


def test_what_is_kept_goes_when_nobody_asks(monkeypatch):
    import time

    monkeypatch.setattr(common, "IDLE", 0.2)
    made = []
    assert [common.kept("a", lambda: made.append(1) or len(made)) for _ in range(3)] == [1, 1, 1]
    time.sleep(0.6)
    assert "a" not in common._KEPT and common.kept("a", lambda: made.append(1) or len(made)) == 2
    assert common.kept("b", lambda: "b") == "b" and list(common._KEPT) == ["b"]


def test_what_is_forgotten_is_freed_and_given_back(monkeypatch):
    class Large:
        pass

    freed = []
    monkeypatch.setattr(common, "IDLE", 0.2)
    ref = weakref.ref(common.kept("large", Large))
    monkeypatch.setattr(common, "trim", lambda: freed.append(ref() is None))
    for _ in range(100):
        time.sleep(0.05)
        if freed:
            break
    assert freed == [True]


def test_a_task_gives_back_at_its_end(monkeypatch):
    import pyarrow as pa

    given = []
    monkeypatch.setattr(common, "trim", lambda: given.append(1))
    batches = [pa.RecordBatch.from_arrays([pa.array(["a", "bc", None])], ["text"]), pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])]
    assert [part.num_rows for part, _, _ in common.pieces(iter(batches), "text", 1)] == [1, 1, 1] and given == [1]
    assert list(common.pieces(iter([]), "text")) == [] and given == [1, 1]


def test_little_is_written_in_few_files(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id % 1000 as k").write.parquet(str(tmp_path / "in"))
    base = spark.read.parquet(str(tmp_path / "in"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = common.materialize(base.groupBy("k").agg(F.sum("id").alias("s")))
        # What reads much for so many partitions is written as it is.
        large = spark.range(1 << 32)
        assert common._dealt(large) is large
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = len(spark.read.parquet(out._gneiss_path).inputFiles())
    assert files <= 2 * spark.sparkContext.defaultParallelism and out.count() == 1000
    assert {(r.k, r.s) for r in out.collect()} == {(k, 5 * k + 10000) for k in range(1000)}
    common.release(out)


def test_streaming_decode(coder):
    tokens, own, _ = coder
    decoder, t = bpe.StreamDecoder(tokens), "naïve 中文 😀 ß" * 20
    parts = [decoder.feed([i]) for i in own.encode(t)]
    assert b"".join(parts) + decoder.end() == t.encode()
    for p in parts:
        p.decode()
    assert decoder.feed([own.fst.ids[b"\xe4"]]) == b"" and decoder.end().decode() == "�"
    assert (decoder.feed([own.fst.ids[b"\xff"]]) + decoder.end()).decode() == "�"


def test_tokenize(odd, empty, coder):
    import public_tokenizers as P

    out = pdf(bpe.tokenize(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    for r, src in zip(out.itertuples(), odd.orderBy("doc_id").collect()):
        ids = coder[2].encode_ordinary(src.text or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((src.text or "").encode()).hexdigest()
    assert bpe.tokenize(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# 10. Near-duplicates.


def brute_near(texts, ids, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(ids[a]), root(ids[b])))
                up[y] = x
    return [(len(s), root(i)) for s, i in zip(sets, ids)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    r = random.Random(size)
    texts = odd_texts()
    for _ in range(12):  # originals with copies of ever more edits, and copies of copies
        base = text(R.randint(60, 200)).split()
        for k in range(10):
            copy = list(base)
            for _ in range(k):
                copy[r.randrange(len(copy))] = f"new{r.random()}"
            texts.append(" ".join(copy))
            base = copy if k % 4 == 3 else base
    docs = frame(spark, texts)
    own = docs.orderBy("doc_id").collect()
    out = pdf(neardup.near_duplicates(docs, size, percent))
    assert list(zip(out.n_shingles, out.component_id)) == brute_near([x.text for x in own], [x.doc_id for x in own], size, percent)
    assert (out.kept == (out.doc_id == out.component_id)).all()


def test_a_large_group_of_near_copies(spark):
    r = random.Random(1)
    base, texts = text(150).split(), []
    for k in range(300):
        copy = list(base)
        for at in r.sample(range(len(copy)), r.randint(0, 10)):
            copy[at] = f"w{r.random()}"
        texts.append(" ".join(copy))
    docs = frame(spark, texts)
    own = docs.orderBy("doc_id").collect()
    out = pdf(neardup.near_duplicates(docs, 3, 85))
    assert list(zip(out.n_shingles, out.component_id)) == brute_near([x.text for x in own], [x.doc_id for x in own], 3, 85)


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).count() == 0


def test_ids_that_are_no_integers(spark):
    with pytest.raises(TypeError):
        neardup.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    a, b = text(80), text(80)
    docs = spark.createDataFrame([("x", a), ("y", a), ("z", b)], "doc_id string, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == {"x", "z"}


def test_near_duplicates_without_ids(spark):
    a = text(50)
    docs = spark.createDataFrame([(None, a), (None, a), (4, a), (2, a), (None, None)], "doc_id long, text string")
    out = sorted(((r.doc_id or 0, r.component_id or 0, r.kept, r.n_shingles > 0) for r in neardup.near_duplicates(docs).collect()))
    assert out == [(0, 0, True, False), (0, 0, True, True), (0, 0, True, True), (2, 2, True, True), (4, 2, False, True)]


# Texts of more than the parts that the operators work in.


@pytest.mark.parametrize("span", [700, 4096])
def test_seams_change_nothing(span, monkeypatch):
    r = random.Random(3)
    passage = text(80, r)
    texts = [" ".join(text(r.randint(1, 60), r) if r.random() < 0.7 else passage for _ in range(r.randint(1, 20))).encode() for _ in range(30)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = [common.words(data, off), repeats.places(data, off, 400, 200), quality.measure(data, off)]
    monkeypatch.setattr(common, "_SPAN", span)
    monkeypatch.setattr(repeats, "_SPAN", span)
    parts = [common.words(data, off), repeats.places(data, off, 400, 200), quality.measure(data, off)]
    for a, b in zip(whole[:2], parts[:2]):
        assert all((x == y).all() for x, y in zip(a, b))
    assert all((whole[2][k] == parts[2][k]).all() for k in whole[2])


@pytest.fixture(scope="module")
def huge():
    """Texts of some megabytes, of which two share their middle, beside short ones."""
    r = random.Random(11)
    middle = text(120_000, r)
    return [text(150_000, r) + "\n" + middle + "\nend", "begin " + middle + " " + text(150_000, r), "short", None, "x" * 1_500_000, text(60, r)]


def test_huge_texts_by_bytes_and_words(spark, huge):
    docs = frame(spark, huge, repeat=False)
    raw = [(t or "").encode() for t in huge]
    assert max(map(len, raw)) > 1 << 20
    out = pdf(sharding.shard_by_bytes(docs, shards=3))
    assert list(out["size"]) == [len(b) + 8 for b in raw] and list(out.text_crc32) == [zlib.crc32(b) for b in raw]
    out = pdf(quality.score(docs))
    assert list(out.n_words) == [len(b.split()) for b in raw] and list(out.word_chars) == [sum(map(len, b.split())) for b in raw]
    out = pdf(neardup.near_duplicates(docs, 3, 85))
    want = [len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else ()) for w in (b.lower().split() for b in raw)]
    assert list(out.n_shingles) == want
    out = pdf(mixing.mix(docs), "id")
    assert list(out["size"]) == [len(b.split()) for b in raw]


def test_huge_texts_by_model(spark, huge):
    docs = frame(spark, huge, repeat=False)
    out = pdf(ppm.score(docs, F.col("doc_id") != 1))
    assert list(out.n_tokens) == [len((t or "").split()) + 1 for t in huge] and np.isfinite(out.score).all()
    labels = spark.createDataFrame([(0, 1), (1, 0), (5, 1)], "doc_id long, quality int")
    assert fm.predict(docs, fm.train(docs, labels, F.lit(True))).where("score between 0 and 1").count() == len(huge)


def test_repeats_of_huge_texts(spark, huge):
    out = pdf(repeats.remove_repeats(frame(spark, huge, repeat=False), 400))
    at, to = huge[0].index("\n") + 1, huge[0].rindex("\n")
    middle = to - at
    gone = out.n_removed
    assert middle <= gone[0] <= middle + 2 and middle <= gone[1] <= middle + 2 and out.n_spans[0] == out.n_spans[1] == 1
    assert gone[4] == 1_500_000 and list(gone[[2, 3, 5]]) == [0, 0, 0]


# The pipeline.


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(4)
    passage = text(70)
    clean = [text(R.randint(60, 150)) for _ in range(40)]
    near = clean[0].split()
    near[5] = "other"
    texts = [*clean, clean[0], " ".join(near), None, "", (text(5) + " ") * 30] + [text(60) + " " + passage + " " + text(60) for _ in range(4)]
    docs = frame(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialize(stage(spark, now, str(tmp_path)), name)
        if name != "encode":
            assert now.columns == docs.columns
        seen[name] = now.toPandas()
    good = {i for i, t in enumerate(texts) if brute_quality(t)[-1]}
    assert set(seen["quality_rules"].doc_id) == good and set(range(40)) <= good
    order = sorted(good)
    near = brute_near([texts[i] for i in order], order, 5, 80)
    assert sorted(seen["near_duplicates"].doc_id) == [i for i, (_, c) in zip(order, near) if i == c]
    kept = dict(zip(seen["repeated_passages"].doc_id, seen["repeated_passages"].text))
    assert all(kept[i] == texts[i] for i in range(40)) and not any(passage in t for t in kept.values())
    assert set(seen["mix_sources"].doc_id) <= set(kept) and seen["mix_sources"].doc_id.value_counts().max() <= 3
    assert sorted(seen["encode"].doc_id) == sorted(seen["mix_sources"].doc_id)
    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(zip(whole.doc_id, whole.ids_sha256)) == sorted(zip(seen["encode"].doc_id, seen["encode"].ids_sha256))


def test_pipeline_without_clear_ids(spark):
    r = random.Random(8)
    a, b, c, d, e = (text(90, r) for _ in range(5))
    near = a.split()
    near[40] = "changed"
    data = [(None, a), (None, a), (None, " ".join(near)), (None, b), (7, b), (3, c), (3, d), (3, d), (9, e), (9, e), (2, e), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, 4, 5, "k", "v") for i, t in data], SCHEMA).repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and len(got) == 6
    assert sorted(x for x in got if x[0]) == sorted([(7, b), (3, c), (3, d), (2, e)])
    texts = [t for i, t in got if i is None]
    assert None in texts and (a in texts) + (" ".join(near) in texts) == 1
    cut = {r.text for r in corpus_pipeline.repeated_passages(spark, corpus_pipeline.materialize(out, "near"), SF).collect()}
    assert {b, c, d, e} <= cut


def test_pipeline_of_nothing(spark, empty, tmp_path):
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.count() == 0
