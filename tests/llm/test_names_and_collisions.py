"""Column names that get in the way, and texts that a polynomial modulo a power of two cannot tell apart."""

import hashlib
import random
import tracemalloc


import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, jaccard, line_dedup, mixing, polyhash, rp_forest

SCHEMA = "doc_id long, text string, source string, `_mr_hash` string, `a.b` string, c0 int, `_mr_drop` string"
ROWS = [(i, t, "s", "x", "dot", 7, "d") for i, t in enumerate(["same words here and there again", "same words here and there again", "other", None, ""])]


def morse(letters: str, n: int = 12) -> str:
    """The Thue-Morse word of 2**n letters."""
    return "".join(letters[i.bit_count() & 1] for i in range(1 << n))


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for kept in (exact_dedup.keep_one(docs), jaccard.keep_one(docs), mixing.mixed(docs)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and {tuple(r)[2:] for r in rows} == {("s", "x", "dot", 7, "d")}
        assert {(r.doc_id, r.text) for r in rows} <= {r[:2] for r in ROWS}
    assert sorted(r.doc_id for r in exact_dedup.keep_one(docs).collect()) == [1, 2, 4]
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [0, 2, 3, 4]


def test_poly_cannot_tell_and_residues_can():
    """Why long stretches have another hash."""
    a, b = morse("ab"), morse("ba")
    for seed in range(3):
        poly = polyhash.Poly(seed)
        ends = [poly.prefix(np.frombuffer(x.encode(), "u1"))[-1] for x in (a, b)]
        assert ends[0] == ends[1]
    assert not {x[0] for x in line_dedup.hashed_variants(a)[:2]} & {x[0] for x in line_dedup.hashed_variants(b)[:2]}


def test_line_whose_partner_a_collision_would_hide(spark):
    a, b = morse("ab"), morse("ba")
    near = b[:2000] + b[2001:]
    texts = [a, b, near]
    for ids in ([0, 1, 2], [1, 2], [0, 2]):
        docs = spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string")
        dropped = {r.doc_id for r in line_dedup.dropped_lines(docs).collect() if r.gone}
        assert dropped == ({2} if 1 in ids else set())


def test_variants_are_the_lines_without_a_character():
    for line in ("", "a", "aé漢😀b", "xyxy" * 30):
        one, two, at = line_dedup.hashed_variants(line)
        assert at.tolist() == list(range(-1, len(line)))
        for i in range(len(line)):
            other = line_dedup.hashed_variants(line[:i] + line[i + 1 :])
            assert (one[i + 1], two[i + 1]) == (other[0][0], other[1][0])


def test_words_that_a_collision_would_make_one_class(spark):
    docs = spark.createDataFrame([(0, morse("ab")), (1, morse("ba")), (2, morse("ab"))], "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.decisions(docs).collect()} == {0: (0, 1), 1: (1, 0), 2: (0, 1)}
    digests = {hashlib.sha256(r.text.encode()).hexdigest() for r in docs.where(F.col("doc_id") < 2).collect()}
    assert len(digests) == 2


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_blocks_of_a_long_line(block):
    line = "aé漢😀xyz " * 9
    whole = [np.concatenate(x) for x in zip(*line_dedup._HASHES.deletions(np.frombuffer(line.encode(), "u1")))]
    parts = [np.concatenate(x) for x in zip(*line_dedup._HASHES.deletions(np.frombuffer(line.encode(), "u1"), block))]
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_a_line_of_many_megabytes_needs_little_memory():
    line = "word " * 2_000_000
    tracemalloc.start()
    n = sum(len(x[0]) for x in line_dedup.variant_blocks(line))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(line) + 1 and peak < 80e6


def test_runs_follow_threshold_and_recall(spark):
    assert jaccard.runs_for(0.8, 0.999) == 10 and jaccard.runs_for(0.5, 0.999) == 52 and jaccard.runs_for(1.0, 0.9) == 1
    for bad in ((0.0, 0.9), (1.1, 0.9), (0.8, 1.0)):
        with pytest.raises(ValueError, match="between 0 and 1"):
            jaccard.runs_for(*bad)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(60)]
        near = list(base)
        near[30] = "other"  # five of 56 shingles change: similarity 51 / 61
        far = base[:46] + [rng.choice(words) for _ in range(14)]  # 42 of 70 at least
        texts += [" ".join(x) for x in (base, near, far)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    for threshold in (0.5, 0.8):
        links = {i: sum(j != i and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) for j in range(len(sets))) for i in range(len(sets))}
        # All buckets are split to the last level.
        found = {r.id: r.links for r in jaccard.link_classes(docs, threshold=threshold, split=1).collect()}
        assert found == links and sum(links.values()) >= 80


def test_labels_whose_roots_share_a_number(spark, monkeypatch):
    """Were all roots one node, labels would still be kept apart; and the spill follows the threshold."""
    rows = [(i, [1.0, i * 1e-3], label) for i in range(6) for label in (1, 2)]
    table = spark.createDataFrame([(2 * i + label, v, label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
    whole = rp_forest.F.xxhash64
    monkeypatch.setattr(rp_forest.F, "xxhash64", lambda *c: whole(F.lit("same"), *c[1:]) if isinstance(c[0], str) and c[0] == "kind" else whole(*c))
    assert {r.n_links for r in rp_forest.near_duplicates(table).collect()} == {5}
    monkeypatch.undo()
    assert {r.n_links for r in rp_forest.near_duplicates(table).collect()} == {5}
    assert rp_forest.spill_for(0.93) == rp_forest.SPILL and rp_forest.spill_for(0.72) == pytest.approx(2 * rp_forest.SPILL)
    with pytest.raises(ValueError, match="threshold"):
        rp_forest.spill_for(1.5)
