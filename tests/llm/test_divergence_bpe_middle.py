"""Source divergence, byte-level BPE and fill-in-middle against plain Python and the tokenizer library."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, fill_in_middle, source_divergence
from millrace.llm.fill_in_middle import Marks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(RANKS, "rb") as file:
    BLOB = file.read()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BLOB), special_tokens={})
EXTRA = "doc_id long, text string, lang string, source string, ids string, term string, digest string, output string, `a.b` string"


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(*r, "i", "t", "d", "o", "x") for r in rows], EXTRA).repartition(3)


# Source divergence


def plain_audit(rows, least, top=10):
    docs = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        frequency = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in frequency.items() if n >= least)
        counts = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}
        whole = sum(counts.values(), collections.Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = [(o, sum(f(share(c, t), share(x, t)) for t in kept)) for o, x in counts.items() if o != s]
            terms = [(t, f(share(c, t), share(whole, t))) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def audit_rows():
    rng = random.Random(2)
    words = ["Ärger", "ärger", "The", "the", "naïve", "x1y", "漢字", "don't", "ⅷ", "A\x00B", "zz", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = [(i, " ".join(rng.choice(words[: 5 + i % 26]) for _ in range(rng.randint(0, 40))), ["en", "de", None][i % 3], [None, "a", "b", "hot", "hot", "hot"][rng.randrange(6)]) for i in range(90)]
    rows += [(200, None, "fr", "only"), (201, "", "fr", "other"), (202, "... 12 !", "en", "bare"), (203, "once", "it", "alone"), (200, None, "fr", "only"), (None, "the the", "en", "a")]
    return rows


@pytest.mark.parametrize("least", [1, 3, 10])
def test_audit_equals_plain_sums(spark, least):
    rows = audit_rows()
    found = source_divergence.audit(table(spark, rows), least_docs=least)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, least)


def test_audit_edges(spark):
    rows = audit_rows()
    shorter = source_divergence.audit(table(spark, rows), least_docs=3, top=2)
    assert sorted(map(tuple, shorter.collect())) == plain_audit(rows, 3, 2)
    assert source_divergence.audit(table(spark, rows).where("false")).count() == 0
    long = [(1, "Word other " * 200_000, "en", "a"), (2, "word", "en", "b")]
    assert sorted(map(tuple, source_divergence.audit(table(spark, long), least_docs=1).collect())) == plain_audit(long, 1)


def test_shares_beyond_64_bits(spark):
    """Counts of a hundred billion and more: ten digits more would not fit a long."""
    n, total, kept = 987_654_321_012, 12_345_678_901_234, 5_000_000
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long")
    got = row.select(source_divergence._share("n", "total", "kept").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)
    p, q = 10**9 + 1, 1
    got = row.select(source_divergence.distance(F.lit(p).cast("long"), F.lit(q).cast("long")).alias("f")).first().f
    assert got == (p - q) ** 2 // (p + q)


# Byte-level BPE


def encoded(texts):
    data, cuts = byte_bpe.byte_view(pa.array(texts, pa.large_string()))
    return data, cuts, *byte_bpe.encode_stretch(data, cuts, BLOB)


SIGNS = st.text(st.sampled_from(list("''''ssttrreevvmmllddaB  \n\t\r\x0b\x1c 　​5½²٣!.-é漢́😀\U000105c0\U00010d40")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(SIGNS, st.text(max_size=30)), max_size=8))
def test_bpe_equals_library_and_comes_back(texts):
    data, cuts, ids, ends, first = encoded(texts)
    for i, text in enumerate(texts):
        own = ids[first[i] : first[i + 1]].tolist()
        assert own == LIBRARY.encode_ordinary(text)
        assert ends[first[i] : first[i + 1]].tolist() == np.cumsum([len(LIBRARY.decode_single_token_bytes(t)) for t in own]).tolist()
    back, places = byte_bpe.decode_stretch(ids, ends, first, BLOB)
    assert back.tobytes() == data.tobytes() and places.tolist() == cuts.tolist()


def test_bpe_classes_of_all_code_points():
    """Every code point between letters, as its own text, as the library cuts it."""
    texts = [f"a{chr(i)} b" for i in range(0, 0x110000, 7) if not 0xD800 <= i < 0xE000]
    _, _, ids, _, first = encoded(texts)
    expected = LIBRARY.encode_ordinary_batch(texts, num_threads=2)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == expected


@pytest.mark.parametrize("width", [3, 7, 64, 1000])
def test_bpe_windows_end_at_ends_of_pieces(width):
    rng = random.Random(width)
    text = "".join(rng.choice(["'", "'re", "'l", " ", "  ", "\n", "word", "é", "漢", "12", "!", "x" * 90]) for _ in range(3000))
    data, _ = byte_bpe.byte_view(pa.array([text]))
    whole = byte_bpe.piece_starts(data, np.array([0, len(data)]))
    found = [at + s for at, bounds in byte_bpe.windows(data, width) for s in bounds[:-1].tolist()]
    assert found == whole.tolist()


@pytest.mark.parametrize("text", ["a" * 5000, "xyz" * 700 + "é" * 300, "0" * 1234, " " * 999 + "x", "漢字" * 800, "!?" * 600])
def test_bpe_long_pieces(text):
    assert encoded([text])[2].tolist() == LIBRARY.encode_ordinary(text)


def test_bpe_queries(spark):
    texts = [None, "", " ", "It's here, they're   gone\n\n 12", "Ünïcödé 漢字 😀", "a" * 70_000, "word " * 300_000, "It's here, they're   gone\n\n 12"]
    rows = [(None if i == 4 else min(i, 6), t, "en", "s") for i, t in enumerate(texts)]
    docs = table(spark, rows)
    got = byte_bpe.digests(docs, RANKS)
    expected = []
    for i, t, *_ in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert byte_bpe.digests(docs.where("false"), RANKS).count() == 0
    one = byte_bpe.encode_documents(docs.where("doc_id = 3"), RANKS)
    assert one.columns == ["doc_id", "n_tokens", "ids", "ends"] and np.frombuffer(one.first().ends, "<u4")[-1] == len(texts[3])
    moved = one.withColumn("ends", F.reverse("ends"))
    with pytest.raises(Exception, match="do not fit"):
        byte_bpe.decode_documents(moved, RANKS).collect()


def test_bpe_refuses_ranks_without_all_bytes(spark, tmp_path):
    (tmp_path / "few.tiktoken").write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(Exception, match="bytes without a rank"):
        byte_bpe.encode_documents(table(spark, [(1, "ab", "en", "s")]), str(tmp_path / "few.tiktoken")).collect()


# Fill-in-middle


def plain_middle(i, text):
    text = text or ""
    n, digest = len(text), sha(f"1:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, sha(text), sha(text)
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return i, n, form, a, b - a, sha(out), sha(text)


def test_middle_equals_plain_cutting(spark):
    rng = random.Random(4)
    texts = [None, "", "x", "<P>", "a<S>b", "<M", "<<<>>>PSM", "Ünï 漢字 😀\U0010ffff", "<P" * 30, "y" * 700_000, "\n\n"]
    texts += ["".join(rng.choice("<>PSM ab\né😀") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i - 5, t, "en", "s") for i, t in enumerate(texts)] + [(None, "no id", "en", "s"), (7, "twice", "en", "s"), (7, "twice", "en", "s")]
    docs = table(spark, rows)
    found = fill_in_middle.decisions(docs)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain_middle(i, t) for i, t, *_ in rows), key=repr)
    assert {"plain", "psm", "spm"} == {r.form for r in found.select("form").distinct().collect()}
    assert fill_in_middle.decisions(docs.where("false")).count() == 0


@pytest.mark.parametrize("unit, cut", [("word", r"\s+|\S+"), ("line", r"[^\n]*\n|[^\n]+"), ("char", r"(?s).")])
def test_middle_units(spark, unit, cut):
    """Cuts fall on units, all of them may be cut, and texts come back."""
    rng = random.Random(9)
    texts = ["".join(rng.choice(["ab", " ", "\n", "é", " ", "x y"]) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    made = fill_in_middle.transformed(docs, unit=unit, percent=100, percent_spm=50, seed="s", marks=Marks("[p]", "{s}", "<m>"))
    rows = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), Marks("[p]", "{s}", "<m>"))).collect()
    for r in rows:
        units = re.findall(cut, texts[r.doc_id])
        ends = np.cumsum([0, *map(len, units)]).tolist()
        h = [int(sha(f"s:{r.doc_id}")[8 * k : 8 * k + 8], 16) % (len(units) + 1) for k in range(2)]
        assert r.n == len(units) and r.back == texts[r.doc_id]
        assert (r.prefix_chars, r.prefix_chars + r.middle_chars) == (ends[min(h)], ends[max(h)])


def test_middle_boundaries_across_blocks(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "BLOCK", 5)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab  \n\n") for _ in range(rng.randint(1, 40)))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        for unit, cut in (("word", r"\s+|\S+"), ("line", r"[^\n]*\n|[^\n]+"), ("char", r"(?s).")):
            ends = np.cumsum([0, *map(len, re.findall(cut, text))]).tolist()
            a, b = rng.randrange(100), rng.randrange(100)
            x, y = sorted((a % len(ends), b % len(ends)))
            assert fill_in_middle.cut_points(codes, unit, a, b) == (len(ends) - 1, ends[x], ends[y])


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<PS>", "<"), ("aba", "<S>", "<M>"), ("<P>", "S<", "<M>")])
def test_middle_refuses_unclear_marks(marks):
    with pytest.raises(ValueError, match="marks"):
        fill_in_middle.restored(F.lit("x"), F.lit("psm"), Marks(*marks))


def test_share_of_forms(spark):
    """Nine in ten are no plain ones, a fifth of these spm."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    n = {r.form: r["count"] for r in fill_in_middle.transformed(docs).groupBy("form").count().collect()}
    assert math.isclose(n["plain"] / 4000, 0.1, abs_tol=0.02) and math.isclose(n["spm"] / 4000, 0.18, abs_tol=0.02)
