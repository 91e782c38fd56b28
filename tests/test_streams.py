"""Row groups, flat shards, composing digests, and the packed stream, against plain Python and NumPy."""

import collections
import hashlib
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators import corpora, digests, stream
from millrace.operators import tokens as K
from millrace.sources import flat_shards, shards
from millrace.sources.readers import GateError
from millrace.sources.row_groups import read_row_groups

SPLITS = ("train", "validation", "test")


def texts(n=60):
    rng = random.Random(n)
    return [(SPLITS[min(rng.randrange(5), 2)], i, rng.choice(["", "A", "héllo", "漢字 " * rng.randint(1, 40), "word " * rng.randint(0, 90)])) for i in range(n)]


def packed(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, f"f{r[1] % 4}") for r in rows], "split string, record_id long, text string, family_id string").repartition(parts)
    return docs.select("split", "record_id", "family_id", K.packed_base(F.col("text")).alias("r")).select("split", "record_id", "family_id", "r.tokens", "r.mask")


def plain(rows, split):
    """The stream of a split and its mask."""
    tokens, mask = [], []
    for _, _, text in sorted((r for r in rows if r[0] == split), key=lambda r: r[1]):
        body = list((text or "").encode())
        tokens += [256, *body, 257]
        mask += [0] + [1] * (len(body) + 1)
    return np.array(tokens, "<u2"), np.array(mask, "u1")


# Row groups


@pytest.fixture
def grouped(tmp_path):
    for name, n in (("a", 100), ("b", 37)):
        rows = pa.table({"id": range(n), "text": [None if i % 9 == 0 else f"{name}{i}" for i in range(n)], "at": pa.array([10**6 * i for i in range(n)], pa.timestamp("us", "UTC")), "wide": ["x" * 500] * n})
        pq.write_table(rows, tmp_path / f"{name}.parquet", row_group_size=16)
    return str(tmp_path)


def test_listed_groups_only(spark, grouped):
    a, b = f"{grouped}/a.parquet", f"file:{grouped}/b.parquet"
    rows = read_row_groups(spark, {a: [0, 6], b: [2]}, ["text", "id"])
    assert rows.columns == ["text", "id", "_file", "_row_group", "_row_index"]
    got = sorted((os.path.basename(r._file), r._row_group, r._row_index, r.id, r.text) for r in rows.collect())
    want = [("a.parquet", g, i - 16 * g, i, None if i % 9 == 0 else f"a{i}") for g in (0, 6) for i in range(16 * g, min(100, 16 * g + 16))]
    want += [("b.parquet", 2, i - 32, i, None if i % 9 == 0 else f"b{i}") for i in range(32, 37)]
    assert got == sorted(want)
    assert rows.rdd.getNumPartitions() == 3  # a task for each group


def test_groups_and_rows_as_the_footers_say(spark, grouped):
    found = read_row_groups(spark, {f"{grouped}/a.parquet": None, f"{grouped}/b.parquet": None}, ["id"])
    counts = sorted((r._file, r._row_group, r["count"]) for r in found.groupBy("_file", "_row_group").count().collect())
    told = duckdb.sql(f"SELECT DISTINCT file_name, CAST(row_group_id AS INTEGER), row_group_num_rows FROM parquet_metadata('{grouped}/*.parquet')").fetchall()
    assert counts == sorted(told) and len(told) == 10


def test_times_and_no_columns(spark, grouped):
    path = f"{grouped}/b.parquet"
    whole = read_row_groups(spark, {path: None})
    assert whole.columns[:4] == ["id", "text", "at", "wide"]
    expected = {r.id: r["at"] for r in spark.read.parquet(path).collect()}
    assert {r.id: r["at"] for r in whole.collect()} == expected
    assert read_row_groups(spark, {path: [1]}, []).count() == 16


@pytest.mark.parametrize("groups", [[], [1, 0], [0, 0], [-1], [True], ["0"]])
def test_unclear_groups(spark, grouped, groups):
    with pytest.raises(GateError, match="row groups"):
        read_row_groups(spark, {f"{grouped}/a.parquet": groups})


def test_group_that_is_not_there(spark, grouped):
    with pytest.raises(Exception, match="has 7 row groups, not"):
        read_row_groups(spark, {f"{grouped}/a.parquet": [6, 7]}, ["id"]).collect()


# Flat shards


def test_packed_base_golden(spark):
    row = packed(spark, [("train", 1, "A")]).first()
    assert np.frombuffer(row.tokens, "<u2").tolist() == [256, 65, 257] and list(row.mask) == [0, 1, 1]
    assert bytes(row.tokens) == b"\x00\x01\x41\x00\x01\x01"
    row = packed(spark, [("train", 1, None)]).first()
    assert np.frombuffer(row.tokens, "<u2").tolist() == [256, 257] and list(row.mask) == [0, 1]


@pytest.mark.parametrize("parts", [1, 5])
def test_flat_files_are_the_stream(spark, tmp_path, parts):
    rows, folder = texts(), f"file://{tmp_path}/corpus"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        flat_shards.publish_flat(packed(spark, rows), folder)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    manifest = flat_shards.verify_flat(spark, folder)
    assert sorted(os.listdir(tmp_path)) == ["corpus"]
    for split in SPLITS:
        tokens, mask = plain(rows, split)
        assert (np.fromfile(tmp_path / "corpus" / f"{split}.tokens.bin", "<u2") == tokens).all()
        assert (np.fromfile(tmp_path / "corpus" / f"{split}.loss.bin", "u1") == mask).all()
        told = manifest["splits"][split]
        digest = digests.Digest()
        for r in sorted((r for r in packed(spark, rows).collect() if r.split == split), key=lambda r: r.record_id):
            digest = digest.then(hashlib.sha256(bytes(r.tokens) + bytes(r.mask)).hexdigest())
        # The digest does not depend on how the stream was dealt to partitions.
        assert (told["tokens"], told["targets"], told["records"], told["digest"]) == (len(tokens), int(mask.sum()), digest.n, digest.hex())
    with pytest.raises(GateError, match="exists"):
        flat_shards.publish_flat(packed(spark, rows), folder)


def test_any_damage_is_found(spark, tmp_path):
    rows, folder = texts(12), f"{tmp_path}/corpus"
    flat_shards.publish_flat(packed(spark, rows), folder, splits=SPLITS)
    rng = random.Random(6)
    for name in [f"{s}.{k}.bin" for s in SPLITS for k in ("tokens", "loss")]:
        path = tmp_path / "corpus" / name
        whole = path.read_bytes()
        at = rng.randrange(len(whole))
        path.write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(GateError, match="flat shards"):
            flat_shards.verify_flat(spark, folder)
        path.write_bytes(whole[:-1])
        with pytest.raises(GateError, match="bytes of the manifest"):
            flat_shards.verify_flat(spark, folder)
        path.write_bytes(whole)
    flat_shards.verify_flat(spark, folder)
    (tmp_path / "corpus" / "manifest.json").unlink()
    with pytest.raises(GateError, match="no manifest"):
        flat_shards.verify_flat(spark, folder)


def test_nothing_is_left_of_a_failed_publication(spark, tmp_path):
    rows = texts()
    good = packed(spark, rows)
    wide = F.when(F.col("record_id") == 31, F.lit(b"\x08\x01" * 3)).otherwise(F.col("tokens"))  # 264 is no token
    cases = [
        (good.withColumn("tokens", wide).withColumn("mask", F.when(F.col("record_id") == 31, F.lit(b"\x00\x01\x01")).otherwise(F.col("mask"))), "outside the vocabulary"),
        (good.withColumn("mask", F.when(F.col("record_id") == 7, F.lit(b"\x00\x02")).otherwise(F.col("mask"))), "mask|length"),
        (good.unionByName(good.where("record_id = 5")), "repeated records"),
        (good.where("split <> 'test'"), "splits without records"),
        (good.withColumn("split", F.when(F.col("record_id") == 3, "other").otherwise(F.col("split"))), "no split is named other"),
    ]
    for bad, message in cases:
        with pytest.raises(Exception, match=message):
            flat_shards.publish_flat(bad, f"{tmp_path}/corpus")
        assert os.listdir(tmp_path) == []
    with pytest.raises(GateError, match="mounted"):
        flat_shards.publish_flat(good, "s3://bucket/corpus")


def test_ranges_are_read_where_they_stand(spark, tmp_path):
    rows, folder = texts(), f"{tmp_path}/corpus"
    flat_shards.publish_flat(packed(spark, rows), folder)
    tokens, mask = plain(rows, "train")
    wanted = [("train", s, n, f"k{s}") for s, n in [(0, 5), (3, 0), (len(tokens) - 7, 7), (11, 400)]]
    ranges = spark.createDataFrame(wanted, "split string, start long, n long, key string")
    for r in flat_shards.read_ranges(ranges, folder).collect():
        assert r.key == f"k{r.start}"
        assert np.frombuffer(r.tokens, "<u2").tolist() == tokens[r.start : r.start + r.n].tolist() and list(r.mask) == mask[r.start : r.start + r.n].tolist()
    for bad in [("train", len(tokens) - 1, 2), ("train", -1, 1), ("dev", 0, 1)]:
        with pytest.raises(Exception, match="has no tokens"):
            flat_shards.read_ranges(spark.createDataFrame([bad], "split string, start long, n long"), folder).collect()


def test_parquet_shards_agree_with_their_manifest(spark, tmp_path):
    rows = texts(20)
    shards.publish(packed(spark, rows), f"{tmp_path}/p")
    loaded = shards.load(spark, f"{tmp_path}/p")
    assert {(r.record_id, bytes(r.tokens)) for r in loaded.collect()} == {(r.record_id, bytes(r.tokens)) for r in packed(spark, rows).collect()}
    # A record swapped for another of the same counts is told by the order-aware digest.
    moved = packed(spark, [(s, 19 - i if i in (0, 19) else i, t) for s, i, t in rows])
    shards.publish(moved, f"{tmp_path}/q")
    os.rename(tmp_path / "q" / "records", tmp_path / "q" / "other")
    os.rename(tmp_path / "p" / "records", tmp_path / "q" / "records")
    with pytest.raises(GateError):
        shards.load(spark, f"{tmp_path}/q")


# Digests


def digest_of(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "g string, o long, m string").repartition(parts)
    return {r.g: (r.records, r.digest) for r in digests.stream_digests(df, "g", "o", F.sha2("m", 256)).collect()}


def test_digest_tells_order_copies_and_exchanges(spark):
    rows = [("x", i, f"row {i}") for i in range(50)] + [("y", i, f"row {i}") for i in range(50)]
    one = digest_of(spark, rows)
    assert one["x"] == one["y"] and one == digest_of(spark, rows, 7)
    expected = digests.Digest()
    for i in range(50):
        expected = expected.then(hashlib.sha256(f"row {i}".encode()).hexdigest())
    assert one["x"] == (50, expected.hex())
    swapped = [("x", {3: 4, 4: 3}.get(o, o), m) for _, o, m in rows[:50]]
    twice = [*rows[:50], ("x", 7, "row 7")]
    instead = [("x", o, "row 7" if o == 8 else m) for _, o, m in rows[:50]]
    seen = {d["x"] for d in (one, *(digest_of(spark, v) for v in (swapped, twice, instead, rows[:49])))}
    assert len(seen) == 5
    assert digest_of(spark, []) == {}


def test_digest_composes():
    marks = [hashlib.sha256(bytes([i])).hexdigest() for i in range(20)]
    whole = digests.Digest()
    for m in marks:
        whole = whole.then(m)
    for cut in range(21):
        left, right = digests.Digest(), digests.Digest()
        for m in marks[:cut]:
            left = left.then(m)
        for m in marks[cut:]:
            right = right.then(m)
        assert left.before(right) == whole


def test_extension_that_changes_a_frozen_split(spark):
    rows = spark.createDataFrame([(s, i, f"t{i}") for i, s in enumerate(["train", "test", "validation", "test"])], "split string, k long, text string")
    new = spark.createDataFrame([("train", 9, "n"), ("test", 10, "no")], rows.schema)
    whole, check = corpora.extended(rows, new, "k", F.sha2("text", 256))
    assert whole.count() == 5 and {r.split: r.unchanged for r in check.collect()} == {"train": False, "test": True, "validation": True}


# The stream


@pytest.mark.parametrize("parts", [1, 2, 9])
def test_next_tokens_across_all_borders(spark, parts):
    rows = texts(40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = {(r.split, r.token, r.target): (r.n, r.n_eligible) for r in stream.next_tokens(packed(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    n, eligible = collections.Counter(), collections.Counter()
    for split in SPLITS:
        tokens, mask = plain(rows, split)
        for a, b, m in zip(tokens[:-1].tolist(), tokens[1:].tolist(), mask[1:].tolist()):
            n[split, a, b] += 1
            eligible[split, a, b] += m
    assert found == {k: (v, eligible[k]) for k, v in n.items()}


def test_next_tokens_edges(spark):
    assert stream.next_tokens(packed(spark, texts(3)).where("false")).count() == 0
    none = packed(spark, [("train", 1, "A")]).withColumn("tokens", F.lit(b"")).withColumn("mask", F.lit(b""))
    mixed = none.withColumn("record_id", F.lit(2).cast("long")).unionByName(packed(spark, [("train", 1, "A"), ("train", 3, "")]))
    got = sorted((r.token, r.target, r.n, r.n_eligible) for r in stream.next_tokens(mixed).collect())
    assert got == [(65, 257, 1, 1), (256, 65, 1, 1), (256, 257, 1, 1), (257, 256, 1, 0)]
    with pytest.raises(Exception, match="outside the vocabulary"):
        stream.next_tokens(packed(spark, [("train", 1, "A")]), vocabulary=200).collect()


def test_windows_equal_ranges_and_have_targets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "CELL", 16)
    rows = texts()
    # Most records are no targets, so that some draws need several attempts.
    records = packed(spark, rows).withColumn("mask", F.when(F.col("record_id") % 6 == 0, F.col("mask")).otherwise(F.lpad(F.lit(b""), F.length("mask"), F.lit(b"\x00"))))
    found = stream.training_windows(records, "s", 25, block=12).collect()
    assert collections.Counter(r.split for r in found) == dict.fromkeys(SPLITS, 25) and max(r.attempt for r in found) > 0
    flat_shards.publish_flat(records, f"{tmp_path}/c")
    ranges = spark.createDataFrame([(r.split, r.draw, r.start, 13) for r in found], "split string, draw int, start long, n long")
    there = {(r.split, r.draw): (bytes(r.tokens), bytes(r.mask)) for r in flat_shards.read_ranges(ranges, f"{tmp_path}/c").collect()}
    assert {(r.split, r.draw): (bytes(r.tokens), bytes(r.mask)) for r in found} == there
    assert all(1 in r.mask[1:] for r in found)
    again = stream.training_windows(records.repartition(5), "s", 25, block=12).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_windows_that_cannot_be(spark):
    short = packed(spark, [("train", 1, "abc")])
    assert stream.training_windows(short, "s", 4, block=4).count() == 4
    assert stream.training_windows(short, "s", 0, block=4).count() == 0
    for bad, message in [(short, "no windows"), (short.unionByName(short), "repeated records"), (short.withColumn("mask", F.lit(b"\x00" * 5)), "no windows")]:
        with pytest.raises(GateError, match=message):
            stream.training_windows(bad, "s", 1, block=5 if message == "no windows" and bad is short else 4)


# Smaller gates


def test_pins_are_compared_path_by_path(spark, tmp_path):
    paths = []
    for name in ("a", "b"):
        pq.write_table(pa.table({"x": [name]}), tmp_path / f"{name}.parquet")
        paths.append(f"{tmp_path}/{name}.parquet")
    sha = [hashlib.sha256(open(p, "rb").read()).hexdigest() for p in paths]
    assert shards.pinned_parquet(spark, dict(zip(paths, sha))).count() == 2
    for wrong in (reversed(sha), [sha[0], sha[0]], [sha[0], "0" * 64]):
        with pytest.raises(GateError, match="pinned digest"):
            shards.pinned_parquet(spark, dict(zip(paths, wrong)))


def test_messages_without_an_id_are_not_folded(spark):
    schema = "message_id string, parent_id string, message_tree_id string, role string, text string, lang string, review_result boolean, tree_state string, synthetic boolean, deleted boolean, rank int, labels struct<name: array<string>, value: array<double>>"
    labels = (["quality"], [1.0])
    root = ("r", None, "r", "prompter", "Why?", "en", True, "ready_for_export", False, False, None, labels)
    answer = lambda i, text: (i, "r", "r", "assistant", text, "en", True, "ready_for_export", False, False, 0, labels)
    rows = [root, answer("a", "One."), answer(None, "Two."), answer(None, "Three."), answer(None, "Two."), answer("a", "One.")]
    found = corpora.dialogue_pairs(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.message_id or "", r.answer, r.reason) for r in found) == [("", "Three.", "accepted"), ("", "Two.", "accepted"), ("", "Two.", "accepted"), ("a", "One.", "accepted")]


def test_numbers_that_do_not_fit_a_width(spark):
    from millrace.sources.sinks import u8, u16_le

    rows = spark.createDataFrame([([256, 65, 257],), ([],), (None,)], "t array<int>")
    assert [None if r[0] is None else bytes(r[0]) for r in rows.select(u16_le(F.col("t"))).collect()] == [b"\x00\x01A\x00\x01\x01", b"", None]
    for bad, f in (([65_536], u16_le), ([-1], u16_le), ([256], u8), ([1, None], u8)):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([(bad,)], "t array<int>").select(f(F.col("t"))).collect()
