"""The training-data operators on small fixtures, against brute force: edges, ties, repeated rows, clashing names."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat_format, components, exact_dedup, jaccard, leaf_pairs, licenses, line_dedup, mixing, polyhash, rp_forest, sentencepiece_bpe, shingles, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, rep string, size string, key string"
WORDS = [a + b for a in "ka lo mi re tu wa ze ny".split() for b in "ba co di fu ge ha".split()]


def corpus() -> list[tuple]:
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [None, "", "  \n ", "one", "two words", "Ünïcödé ﬁ 漢字 " + say(12), "x" * 300, " " * 250]
    passage = say(60)
    for _ in range(12):
        base = say(rng.randint(20, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
        texts.append(say(15) + "\n" + passage + "\n" + say(9))
    texts += [texts[8], texts[8], texts[9], "", "line of twenty letters a\nline of twenty letters b\nsame", "same\nline of twenty letters ab\nshort", "y" * 90_000 + passage]
    return [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", "r", "z", "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(found):
    return {r.doc_id: r for r in found.collect()}


def test_exact_dedup(docs, rows, none):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    got = by_id(exact_dedup.dedup_decisions(docs, block_bytes=64))
    for i, t, *_ in rows:
        own = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(own), len(own), i == max(own))
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(map(max, groups.values()))
    assert exact_dedup.dedup_decisions(none).count() == 0


def test_exact_dedup_repeated_ids(spark):
    twice = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "a", "y")], "doc_id long, text string, n string")
    assert exact_dedup.keep_one(twice).count() == 1 and exact_dedup.dedup_decisions(twice).count() == 3


def _sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def test_jaccard(docs, rows, none):
    sets = _sets(rows)
    links, root = collections.Counter(), {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    for split, block in ((256, 1024), (2, 2)):  # the second: every path of the code
        got = {r.id: r for r in jaccard.link_classes(docs, split=split, block=block).collect()}
        assert {i: (got[i].links, got[i].component) for i in sets} == {i: (links[i], top(i)) for i in sets}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if top(i) == i)
    assert jaccard.decisions(none).count() == 0


def test_jaccard_repeated_ids(spark):
    """Two texts of one id are rows of their own; equal rows are copies."""
    one, two = " ".join(WORDS[:30]), " ".join(WORDS[10:48])
    rows = [(1, one), (1, two), (1, one), (2, one + " end"), (3, two + " end"), (4, "other words"), (None, one)]
    found = sorted((r.doc_id or 0, r.n_links, r.component_id or 0, r.kept) for r in jaccard.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_leaf_counts_pairs_once():
    """Random leaves and links against counting pair by pair."""
    rng = np.random.default_rng(6)
    leaves = [sorted(rng.choice(12, rng.integers(1, 6), replace=False).tolist()) for _ in range(60)]
    sizes = rng.integers(1, 5, 60)
    close = np.triu(rng.random((60, 60)) < 0.2, 1)
    close |= close.T
    counts = np.zeros(60, np.int64)
    for leaf in range(12):
        own = np.array([i for i in range(60) if leaf in leaves[i]])
        found, root = leaf_pairs.tally(leaf, pa.array([leaves[i] for i in own], pa.list_(pa.int64())), sizes[own], close[np.ix_(own, own)])
        counts[own] += found
        assert (root == _components(range(len(own)), close[np.ix_(own, own)])).all()
    meet = np.array([[bool(set(x) & set(y)) for y in leaves] for x in leaves])
    assert (counts == (close & meet) @ sizes).all()


def test_groups_of_batches():
    keys = np.sort(np.random.default_rng(2).integers(0, 9, 50))
    table = pa.table({"a": keys, "b": keys % 2, "n": np.arange(50)})
    for size in (1, 7, 50):
        found = list(leaf_pairs.groups(iter(table.to_batches(max_chunksize=size)), 2))
        assert [set(g.column(0).to_pylist()) for g in found] == [{k} for k in np.unique(keys)] and sum(map(len, found)) == 50
    assert not list(leaf_pairs.groups(iter([table.to_batches()[0].slice(0, 0)]), 2))


def test_shingles_do_not_cross_texts():
    texts = ["a b c d e f", "", None, "g h", "a b c d e"]
    found = list(shingles.shingle_sets(pa.array(texts)))
    assert [len(x) for x in found] == [2, 0, 0, 1, 1] and found[4][0] in found[0]


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (3, 5), (5, 3), (2, 2), (6, 1), (None, 4)], "a long, b long")
    assert {(r.node, r.component) for r in components.components(links).collect()} == {(9, 1), (8, 1), (7, 1), (6, 1), (1, 1), (5, 3), (3, 3)}
    assert components.components(links.limit(0)).count() == 0


def _repeats(rows):
    seen, out = set(), {}
    for i, t, *_ in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(data[p : p + 100])
        out[i] = (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "bits"), [(50_000, 64), (1, 64), (50_000, 1)])
def test_suffix_dedup(docs, rows, none, monkeypatch, hot, bits):
    """Also with nearly every context of a gram taken for equal by its hash: the bytes decide."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SORTED_ROWS", 7)
    got = by_id(suffix_dedup.decisions(docs, bits))
    assert {i: tuple(got[i])[1:] for i in got} == _repeats(rows)
    assert suffix_dedup.decisions(none).count() == 0


def test_contexts_are_compared_by_bytes():
    data = np.frombuffer(bytes(range(33, 127)) * 8, np.uint8).copy()
    start, end = np.array([0, 0, 0, 0]), np.array([150, 150, 150, 168])
    other = np.array([94, 95, 188, 94])
    data[188 + 140] = 1
    assert suffix_dedup._equal_contexts(data, start, end, other, other + np.array([150, 150, 150, 167])).tolist() == [True, False, False, False]


def test_runs_that_differ_are_sorted(spark):
    """Texts of one gram in several partitions, all contexts taken for equal by a hash of one bit."""
    part = " ".join(WORDS[:40])
    texts = [f"{i % 7} " * 60 + part + f" {i % 5}" * 60 for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = by_id(suffix_dedup.decisions(docs, 1))
    assert {i: tuple(got[i])[1:] for i in got} == _repeats(enumerate(texts))


def test_suffix_dedup_repeated_ids(spark):
    text = " ".join(WORDS[:40])
    twice = spark.createDataFrame([(1, text), (1, text), (None, "z" + text), (2, text)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_removed > 0) for r in suffix_dedup.decisions(twice).collect())
    assert found == [(0, False), (1, True), (1, True), (2, True)]


def test_suffix_dedup_hot_windows_are_not_sorted(monkeypatch):
    """A passage within many texts of different surroundings: its windows go around the sort."""
    passage, n = bytes(range(33, 127)).decode() + "0123456789" * 3, 400
    texts = [f"{i:>05}<" * 30 + passage + f">{i * 7:>05}" * 30 for i in range(n)]
    novel = [[{"start": 180 + 46, "gram": 5, "hot": True}, {"start": 3, "gram": i, "hot": False}] for i in range(n)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("gram", pa.int64()), ("hot", pa.bool_())]))
    sorted_, suffixes = [], suffix_dedup.Suffixes
    monkeypatch.setattr(suffix_dedup, "FETCHED_ROWS", 500)
    monkeypatch.setattr(suffix_dedup, "Suffixes", lambda *x: sorted_.append(len(x[0])) or suffixes(*x))
    batches = []
    for part in (slice(0, n, 2), slice(1, n, 2)):
        ids = list(range(n))[part]
        batches.append(pa.RecordBatch.from_arrays([pa.array(ids), pa.array([0] * len(ids)), pa.array(texts[part]), pa.array(novel[part], kind)], ["k", "tie", "text", "novel"]))
    fetched = pa.Table.from_batches(list(suffix_dedup._fetch(iter(batches)))).sort_by([(x, "ascending") for x in ("gram", "bytes", "k", "tie", "at")])
    gone = np.zeros((n, len(texts[0])), bool)
    for found in suffix_dedup._sort_suffixes(iter(fetched.to_batches(max_chunksize=64))):
        for k, _, start, end in zip(*(found.column(i).to_pylist() for i in range(4)), strict=True):
            gone[k, start:end] = True
    assert sum(sorted_) == n  # the contexts of the grams that are not hot, and no window
    assert not gone[0].any() and all(gone[1:, 180 : 180 + len(passage)].all(axis=1))
    seen = set()
    for i, text in enumerate(texts):
        for p in range(180 + 46 - 68, 180 + 46 + 1):
            again = text[p : p + 100] in seen
            assert not again or gone[i, p : p + 100].all()
            seen.add(text[p : p + 100])


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(1)
    n = 60
    texts = [bytes(rng.integers(97, 99, rng.integers(100, 169), dtype=np.uint8)) for _ in range(n)]
    left = np.array([min(68, len(t) - 100) for t in texts])
    s = suffix_dedup.Suffixes(np.repeat([1, 2, 3], 20), left, pa.array(texts, pa.binary()))
    order = s.sort()
    keys = [(i // 20, texts[i][left[i] :]) for i in range(n)]
    assert [keys[i] for i in order] == sorted(keys)


def test_line_dedup(docs, rows, none):
    earlier, expected = [], {}
    for i, t, *_ in rows:
        kept, dropped = [], 0
        for line in (t or "").split("\n"):
            near = line.strip() != "" and any(line == e or abs(len(e) - len(line)) <= 1 and _within_one(line, e) for e in earlier)
            dropped += near
            if not near:
                kept.append(line)
            if line.strip():
                earlier.append(line)
        expected[i] = (dropped, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = by_id(line_dedup.decisions(docs))
    assert {i: (r.n_dropped, r.kept_sha256) for i, r in got.items()} == expected
    assert sum(x for x, _ in expected.values()) > 15 and line_dedup.decisions(none).count() == 0


def _within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_near_lines(spark):
    base = "the quick brown fox jumps over it"
    lines = [base, base[:5] + "X" + base[6:], base[:9] + base[10:], "Q" + base, base[:3] + "ZZ" + base[5:], "é" + base[1:], base + "s"]
    found = by_id(line_dedup.decisions(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")))
    assert [found[i].n_dropped for i in range(7)] == [0, 1, 1, 1, 0, 1, 1]


def test_blank_and_short_lines(spark):
    text = "one line\r\n\r\n\t\n\u3000\n\r\nab\nac\nabc\nxyz\nq\n"
    rows = [(1, text), (1, text), (2, "a\r\n\r\nq"), (2, "other"), (None, "xyz"), (3, None)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, line int")
    found = sorted(((r.doc_id or 0, r.n_lines, r.n_dropped) for r in line_dedup.decisions(frame).collect()))
    # xyz is in the text without an id, which comes first; ac and abc are an edit from ab, and "a\r" and q from earlier lines.
    assert found == [(0, 1, 0), (1, 11, 3), (1, 11, 3), (2, 1, 0), (2, 3, 2), (3, 1, 0)]
    loose = sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.clean(frame, least_chars=4).select("doc_id", "n_dropped").collect())
    assert loose == [(0, 0), (1, 1), (1, 1), (2, 0), (2, 1), (3, 0)]


def test_variants_are_the_deletions():
    for line in ("aab", "é漢a", "x" * 5):
        keys, at = line_dedup.variants(line)
        assert list(at) == list(range(-1, len(line)))
        assert [int(k) for k in keys[1:]] == [int(line_dedup.variants(line[:i] + line[i + 1 :])[0][0]) for i in range(len(line))]


def test_mixing(docs, none):
    found = mixing.schedule(docs).collect()
    times = collections.Counter(r.doc_id for r in found)
    assert set(times) == {r.doc_id for r in docs.collect()} and max(times.values()) <= 2 + 1
    mixed = mixing.mixture(docs, evenness=None, max_repeats=1.5)
    assert 0 <= mixed.exponent <= 1 and mixing.mixed(docs).columns == docs.columns
    total = docs.agg(F.sum(mixing.n_tokens())).first()[0]
    used = mixing.schedule(docs, budget_tokens=total / 2, max_repeats=4.0).agg(F.sum("n_tokens")).first()[0]
    assert used >= total / 2  # each source ends within a block of its share
    assert mixing.schedule(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixing_meets_the_limits(spark):
    sizes = {"a": 6000, "b": 600, "c": 150}
    rows = [(i, "w " * 9 + "w", s) for s, n in sizes.items() for i in range(n // 10)]
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    e = mixing.mixture(docs, evenness=0.8, max_repeats=1e9)
    p = np.array([n / 6750 for n in sizes.values()]) ** e.exponent
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 0.8 * np.log(3)) < 1e-6
    r = mixing.mixture(docs, evenness=None, max_repeats=3.0)
    assert abs((6000 / 150) ** (1 - r.exponent) - 3.0) < 1e-6
    done = mixing.schedule(docs, evenness=None, max_repeats=3.0).groupBy("source").count().collect()
    assert {x.source: x["count"] for x in done}["a"] == 600 and abs({x.source: x["count"] for x in done}["c"] - 45) <= 2


def test_chat_format(spark):
    text = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (2, 0, "us:er <#", None), (2, 0, "a", "b\\"), (2, 2, "assistant", "é\n漢"), (3, 0, None, ""), (3, 1, "assistant", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(frame).collect()}
    for key in (1, 2, 3):
        turns = sorted((t, r or "", x or "") for k, t, r, x in rows if k == key)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert got[key].n_turns == len(turns) and got[key].loss_chars == len(learned)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[key].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat_format.digests(frame.limit(0)).count() == 0


def test_layouts(spark):
    records = [
        ('{"prompt":"a","response":"b"}', ["a", "b"]),
        ('{"output":"o","instruction":"i","input":"x"}', ["i\n\nx", "o"]),
        ('{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":null}]}', ["x", ""]),
        ('{"messages":[{"role":"user","content":"q"}]}', ["q"]),
        ('{"other":1}', None),
        ('{"id":1,"meta":{"a":[{"b":2}],"c":"x"},"messages":[{"role":"user","content":"q","weight":1},{"role":"user","content":7,"weight":null}],"split":"train"}', ["q", "7"]),
        ('{"id":"p","prompt":"a","response":"b","zz":null}', ["a", "b"]),
        ('{"messages":[]}', None),
        ("nope", None),
        (None, None),
    ]
    found = chat_format.canonical_turns(spark.createDataFrame(records, "record string, want array<string>")).collect()
    assert all((None if r.turns is None else [t.text for t in r.turns]) == r.want for r in found)


def test_long_conversations_stay(spark):
    """One text of more characters than a JSON parser takes at first, and one conversation of very many turns."""
    long = 20_000_001
    texts = spark.range(2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.expr(f"if(id = 0, 'q', repeat('a', {long}))").alias("text"))
    many = spark.range(60_000).select(F.lit(2).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit('say "x": {'), F.col("id").cast("string")).alias("text"))
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.turns_sha256) for r in chat_format.digests(texts.unionByName(many)).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got == {
        1: (2, long + 1, digest([("assistant", "q"), ("assistant", "a" * long)])),
        2: (60_000, 0, digest(("user", f'say "x": {{{i}') for i in range(60_000))),
    }


def test_outlines_have_the_same_fingerprint(spark, monkeypatch):
    tail = '"x\\\\\\"},{:[é 漢\\n"'
    records = [f'{{"prompt":{tail}, "response" : {tail}}}', f'{{"a:\\"b":[{tail},{tail}],"c":[{{"d":{tail}}} , {{"d":1}},{{"d":null}},{{"d":{tail}}}]}}', '{"messages":[]}', "[1]", '"s"', "nope", '{"a":"b"', "", None]
    records += ['{"messages":[' + ",".join(['{"role":"user","content":"q"}'] * 5) + "]}", '{"messages":[{"role":"user","content":"q"},{"role":"user","x":"q"}]}']
    frame = spark.createDataFrame([(r,) for r in records], "record string")
    short = [r[0] for r in frame.select(chat_format.fingerprint(F.col("record"))).collect()]
    monkeypatch.setattr(chat_format, "WHOLE", 0)
    assert [r[0] for r in frame.select(chat_format.fingerprint(F.col("record"))).collect()] == short and len(set(short)) > 6
    test_layouts(spark)
    bad = spark.createDataFrame([('{"prompt":"\\q","response":"b"}',)], "record string")
    assert chat_format.canonical_turns(bad).first().turns is None


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    texts = [mit, "Text\nReleased under the MIT License.\nMore", "Licensed under CC BY-NC 4.0. All rights reserved.", None, "", "no licence", "Licensed under the Apache License, Version 2.0", "All rights reserved. All rights reserved!"]
    found = by_id(licenses.decisions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [(found[i].licenses, found[i].n_matches) for i in range(8)] == [("MIT", 1), ("MIT", 1), ("CC-BY-NC-4.0,Proprietary", 2), ("", 0), ("", 0), ("", 0), ("Apache-2.0", 1), ("Proprietary", 2)]


def _linked_vectors(vectors, label):
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    return linked


def _components(ids, linked):
    root = np.array(ids)
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], root.max()).min(axis=1))
        if (least == root).all():
            return root
        root = least


def test_licence_texts(spark, none):
    """Notices of several licences, edges, and a table without rows."""
    bsd = "Copyright (c) 2020, X\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    gpl = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.\n"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    cases = [
        (bsd.replace("1. ", "* ").replace("2. ", "* "), "BSD-2-Clause"),
        ("All rights reserved.\n" + bsd.split("reserved.")[0], "Proprietary"),
        (gpl.format("program", "", 2), "GPL-2.0"),
        (gpl.format("program", "", 3), "GPL-3.0"),
        (gpl.format("library", "Lesser ", "2.1"), "LGPL-2.1"),
        (gpl.format("program", "Affero ", 3), "AGPL-3.0"),
        ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
        (isc, "ISC"),
        ("x | All rights reserved", "Proprietary"),
        ("y" * 300_000 + "\nLicensed under the ISC license.\n", "ISC"),
        ("licences and permissions of software", ""),
        (None, ""),
    ]
    rows = [(i, t, "MIT", i) for i, (t, _) in enumerate(cases)] * 2
    found = licenses.decisions(spark.createDataFrame(rows, "doc_id int, text string, licenses string, a int")).collect()
    assert len(found) == 2 * len(cases)
    assert [(r.doc_id, r.licenses) for r in found if r.licenses != cases[r.doc_id][1]] == []
    assert licenses.decisions(none).count() == 0
    assert by_id(licenses.decisions(spark.createDataFrame([(1, mpl)], "doc_id int, text string")))[1].licenses in ("MPL-2.0", "")


def test_mixing_repeated_rows(spark):
    """Rows that share an id, ties and clashing names: every row as often as its block is taken."""
    rows = [(1, "a b c", "s", "x", 1), (1, "a b c", "s", "x", 1), (1, "other words here", "s", "y", 2), (None, "q", None, "z", 3), (5, None, "t", "z", 4), (6, "a " * 500, "u", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block string, pass int")
    found = mixing.mixed(docs)
    assert found.columns == docs.columns
    times = collections.Counter(tuple(r) for r in found.collect())
    plan = collections.Counter((r.doc_id, r.source) for r in mixing.schedule(docs).collect())
    assert set(times) == set(rows) and times[rows[0]] == 2 * times[rows[2]]
    assert plan[(1, "s")] == 3 * times[rows[2]] and plan[(None, None)] == times[rows[3]]


def test_bisection_is_a_bisection(spark):
    """Five halvings at once come to the place that fifty single ones come to."""
    sizes = [70_000, 9_000, 1_200, 40]
    l = [float(np.log(n / sum(sizes))) for n in sizes]  # noqa: E741
    shares = spark.createDataFrame([(x,) for x in l], "l double")
    for evenness, most in ((0.97, 2.0), (0.6, 1e9), (None, 30.0), (0.1, 1e9)):
        low, high = 0.0, 1.0
        for _ in range(50):
            m = (low + high) / 2
            z, s = sum(np.exp(m * x) for x in l), sum(x * np.exp(m * x) for x in l)
            flat = np.exp((1 - m) * (max(l) - min(l))) > most or (evenness is not None and np.log(z) - m * s / z > evenness * np.log(4))
            low, high = (m, high) if flat else (low, m)
        assert abs(mixing._exponent(shares, 4, float(sum(sizes)), evenness, most, None) - high) < 1e-8


def test_forest(spark):
    """Against brute force, with leaves so small that every label's trees have several levels, and one dense group."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(900, 32))
    vectors = [*base, *(base[:300] + rng.normal(size=(300, 32)) * 0.12), *(base[0] + rng.normal(size=(150, 32)) * 0.03), base[1], base[1] * 2]
    rows = [(i, [float(x) for x in v], i % 2 if i < 900 else 0, "key", 1) for i, v in enumerate(vectors)]
    odd = [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, rows[0][1], None), (904, [], 0), (905, [1.0, None], 0), (906, [1.0, 0.0], 0)]
    n = len(vectors)
    frame = spark.createDataFrame(rows + [(n + i, v, x, "key", 1) for i, v, x in odd], "vec_id long, embedding array<double>, label int, key string, node int").repartition(5)
    got = {r.vec_id: r for r in rp_forest.near_duplicates(frame, leaf=100, block=64).collect()}
    assert len(got) == n + 7
    linked = _linked_vectors(vectors, np.array([r[2] for r in rows]))
    mine = np.array([got[i].n_links for i in range(n)])
    assert (mine <= linked.sum(axis=1)).all() and mine.sum() >= 0.99 * linked.sum() and linked.sum() > 20_000
    right = _components(range(n), linked)
    assert np.mean([got[i].component_id == right[i] for i in range(n)]) > 0.99
    assert all(got[n + i].n_links == 0 and got[n + i].component_id == n + i and got[n + i].kept for i in range(900, 907))
    assert rp_forest.near_duplicates(frame.limit(0)).count() == 0


def test_forest_splits(spark):
    """The trees of the test above do split, and every vector comes to a leaf of each tree."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v], 5) for i, v in enumerate(rng.normal(size=(700, 32)))]
    found = rp_forest._grow(spark.createDataFrame(rows, "key long, vec array<double>, node long"), 100).toPandas()
    assert found.node.nunique() > 8 and set(found.key) == set(range(700)) and found.n.max() <= 400


def test_forest_repeated_ids(spark):
    """Two vectors of one id are rows of their own."""
    one, two, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.01]
    frame = spark.createDataFrame([(1, one, 0), (1, two, 0), (2, near, 0), (3, one, 1), (1, one, 0)], "vec_id long, embedding array<double>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rp_forest.near_duplicates(frame).collect())
    assert found == [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def _ends(tree: int, x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The leaves of a tree of as many rounds as it takes."""
    out, open_ = [], [(tree, np.arange(len(x)))]
    while open_:
        node, own = open_.pop()
        cuts = rp_forest._fit(node, x[own], float(len(own)), leaf)
        if np.isnan(cuts[0]):
            out.append(own)
            continue
        inside, names = rp_forest._route(node, x[own], cuts)
        open_ += [(int(name), own[inside[names == name]]) for name in np.unique(names)]
    return out


def _parted(pairs: int, tree: int) -> np.ndarray:
    """Of pairs of vectors at the threshold, in 64 dimensions: whether a tree of many levels parts them."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    one, other = unit(rng.normal(size=(pairs, 64))), rng.normal(size=(pairs, 64))
    other = unit(other - (other * one).sum(axis=1, keepdims=True) * one)
    x = np.concatenate([one, rp_forest.THRESHOLD * one + (1 - rp_forest.THRESHOLD**2) ** 0.5 * other])
    met = np.zeros(pairs, bool)
    for inside in _ends(tree, x, 64):
        met[np.intersect1d(inside[inside < pairs], inside[inside >= pairs] - pairs)] = True
    return ~met


def test_forest_rarely_parts_pairs():
    parted = np.array([_parted(4000, tree) for tree in range(1, rp_forest.TREES + 1)])
    assert parted.mean() < 0.05 and not parted.all(axis=0).any()


def test_sentencepiece(docs, rows, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(sentencepiece_bpe.encode_documents(docs, path))
    for i, t, *_ in rows:
        ids = [*lib.encode(t or ""), lib.eos_id()]
        assert got[i].n_tokens == len(ids) and got[i].agenda_agrees
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert sentencepiece_bpe.encode_documents(none, path).count() == 0


def test_agenda_on_odd_texts():
    """Cuts at odd places: marks in the text, runs of spaces, every control character in use, long words; and a table that is full again and again."""
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    signs = [" ", "  ", "\n", "\n\n", "▁", "▁▁", ".", "a.", "é!", "漢,", "\t", "\r\n", "the ", "people", "x" * 30, "😀", "\x00", "\x01", "ing", "?!", " ▁", "\u00a0", "Ünï", "0", "1,2"]
    texts = ["", " ", "\n", "▁", "  a", "a  ", "".join(map(chr, range(9))) + " all signs. a b", "w" * 5000, *("".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(600))]
    agenda = sentencepiece_bpe.Agenda(lib)
    for start in range(0, len(texts), 50):
        part = texts[start : start + 50]
        assert agenda.encode(part) == lib.encode(part)
    small = sentencepiece_bpe.Agenda(lib, cache=40)
    assert [small.encode([t])[0] for t in texts] == lib.encode(texts)


def test_sentencepiece_repeated_ids(spark):
    """Rows that share an id stay apart, and other columns are not read."""
    import public_tokenizers

    frame = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (1, None, 6), (None, "c", 7)], "doc_id long, text string, n_tokens int")
    found = sentencepiece_bpe.encode_documents(frame, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 2), (1, 1), (1, 3), (1, 3)] and all(r.agenda_agrees for r in found)


def test_sentencepiece_ids_are_the_agendas(monkeypatch):
    ours, theirs = [[1, 2], [3], [4]], [[1, 2], [3], [5]]

    class Stub:
        encode = lambda self, texts, num_threads=1: theirs
        decode = lambda self, ids, num_threads=1: given.extend(ids) or ["t"] * len(ids)
        eos_id = lambda self: 9

    given, agenda = [], type("A", (), {"encode": lambda self, texts: list(ours)})()
    monkeypatch.setattr(sentencepiece_bpe, "_loaded", lambda model: (Stub(), agenda, str))
    rows = sentencepiece_bpe.encode_batch(["a", "b", "c"], b"")
    assert given[0] is ours[0] and given[1] is ours[1] and given[2] is theirs[2]  # the library's only where they differ
    assert [(n, same) for n, _, _, same in rows] == [(3, True), (2, True), (2, False)]
    assert [h for _, h, _, _ in rows] == [hashlib.sha256(x).hexdigest() for x in (b"1 2 9", b"3 9", b"5 9")]


def test_toxicity(spark, none):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        words = [rng.choice(WORDS) for _ in range(30)] + (["zanky", "people"] if bad else [rng.choice(["zanky", "people"])] if i % 4 == 1 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    rows += [(600, None, None), (601, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic")
    found = by_id(toxicity.decisions(frame.select("doc_id", "text"), labels))
    held = [r for r in rows if found[r[0]].held_out and r[2] is not None]
    right = sum(found[r[0]].predicted == r[2] for r in held) / len(held)
    assert right > 0.9 and all(0 <= r.score <= 1 for r in found.values()) and len(found) == 602
    assert toxicity.keep_clean(frame.select("doc_id", "text"), labels).columns == ["doc_id", "text"]
    assert toxicity.decisions(none.select("doc_id", "text"), labels.limit(0)).count() == 0


def test_toxicity_scores_are_the_pairwise_sums(spark):
    """Scores against a plain factorization machine: the double sum over all pairs of terms, with terms cut by plain string code."""
    import re
    import zlib

    rng = random.Random(4)
    rows = []
    for i in range(500):
        bad = i % 3 == 0
        words = [rng.choice(WORDS) for _ in range(25)] + (["zanky", "peoples"] if bad else [rng.choice(["zanky", "peoples", "Été"])])
        rng.shuffle(words)
        rows.append((i, ", ".join(words).capitalize(), int(bad)))
    rows += [(500, None, None), (501, "", 0), (502, "zanky-peoples" * 3, None), (None, "zanky peoples", 1), (7, rows[7][1] + " peoples zanky", 0)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int, score int")
    machine = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    place = {h: i for i, h in enumerate(machine.hashes.tolist())}

    def plain(text):
        found = set()
        for word in re.split(r"[^\w]+|_", (text or "").lower()):
            found |= {zlib.crc32(x.encode()) for x in [word] * bool(word) + [f"{word[:n]}~{n}" for n in (4, 5, 6) if len(word) >= n]}
        own = [place[h] for h in found if h in place]
        raw = machine.bias + sum(machine.weights[i] * machine.values[i] for i in own)
        for a in range(len(own)):
            for b in range(a):
                i, j = own[a], own[b]
                raw += float(machine.factors[i] @ machine.factors[j]) * machine.values[i] * machine.values[j]
        return 1 / (1 + np.exp(-raw))

    found = toxicity.decisions(frame, frame.select("doc_id", "toxic")).collect()
    want = sorted((repr(i), round(float(plain(t)), 9)) for i, t, _ in rows)
    assert len(machine.hashes) > 5 and sorted((repr(r.doc_id), round(r.score, 9)) for r in found) == want
    assert all(r.predicted == (r.score >= 0.5) for r in found)
    assert next(r.held_out for r in found if r.doc_id is None) is True
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)


def test_toxicity_one_class(spark):
    frame = spark.createDataFrame([(i, "some words", 1) for i in range(20)], "doc_id long, text string, toxic int")
    assert {r.predicted for r in toxicity.decisions(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).collect()} == {1}
    assert {r.predicted for r in toxicity.decisions(frame.select("doc_id", "text"), frame.select("doc_id", F.lit(0).alias("toxic"))).collect()} == {0}


def test_prefix_hashes():
    poly = polyhash.Poly(1)
    data = np.frombuffer(b"abcabcabc", np.uint8)
    h = poly.prefix(data)
    same = poly.stretch(h, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert len(set(same.tolist())) == 1 and poly.stretch(h, np.array([1]), np.array([4]))[0] != same[0]


def _pipeline_by_hand(rows, rejected):
    """The documents that all stages but the mixture keep, found by comparing all pairs."""
    stay = [r for r in rows if r[0] not in rejected]
    last = {}
    for i, t in stay:
        last[t or ""] = max(i, last.get(t or "", -1))
    stay = sorted(last.values())
    sets = {i: x for i, x in _sets(rows).items() if i in set(stay)}
    root = {i: i for i in stay}
    for a in stay:
        for b in stay:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return sorted(set(root.values()))


def _check_pipeline(spark, folder, docs):
    """All rows that come out, as often as the mixture takes them, with the library's counts and digests."""
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = dict(rows)
    rejected = {r.doc_id for r in toxicity.decisions(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.predicted}
    stay = _pipeline_by_hand(rows, rejected)
    times = collections.Counter(r.doc_id for r in mixing.schedule(docs.where(F.col("doc_id").isin(stay))).collect())
    assert set(times) == set(stay)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter(r.doc_id for r in found) == times
    for r in found:
        ids = [*lib.encode(texts[r.doc_id] or ""), lib.eos_id()]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    _check_pipeline(spark, folder, spark.read.parquet(f"{folder}/documents.parquet"))


def test_pipeline_edges(spark, tmp_path):
    """Null and empty texts, repeated texts, a null source, columns that clash; then no rows at all."""
    import corpus_pipeline

    docs = spark.createDataFrame(corpus(), SCHEMA)
    labels = spark.createDataFrame([(1, 0), (9, None)], "doc_id long, toxic int")
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
    _check_pipeline(spark, str(tmp_path / "some"), spark.read.parquet(str(tmp_path / "some" / "documents.parquet")))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
