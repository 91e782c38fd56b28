"""Operators on small fixtures: edges, negatives, restatements in plain Python."""

import hashlib
import json
import re
import struct
import unicodedata
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import calculations as C
from millrace.functions import text as T
from millrace.operators import corpora, rollouts
from millrace.operators import measures as M
from millrace.operators import quantise as Q
from millrace.operators import selection as S
from millrace.operators import tokens as K
from millrace.sources import readers, shards, sinks


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_last_decimal(spark):
    cases = {"First 3, then 1,200.50.": "1200.5", "The force is -84.0 N.": "-84", "No number.": None, "1/2": None, "NaN": None, "-0": "0", "a1": None, "x 7": "7", "1 / 2 and 3": None, "12,34": "34", "": None, "12345678901234567890123456789.0": "12345678901234567890123456789", "+000.10000000000000000000010": "0.1000000000000000000001"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", T.last_decimal(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases


def test_repeated_phrase(spark):
    cases = {"the state of the state of the state of the state": True, "a b c a b c": False, "": False, "one two three four five six seven eight nine": False, "a a a a a a a a a": True}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", T.repeats_phrase(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases


def test_fingerprint_and_bucket(spark):
    text = "Same\r\ntext  "
    plain = json.dumps({"kind": "base", "text": "Same\ntext"}, separators=(",", ":"), ensure_ascii=False)
    assert one(spark, text, T.fingerprint) == hashlib.sha256(plain.encode()).hexdigest()
    assert one(spark, "ﬁ①Ａ", T.normalise) == unicodedata.normalize("NFKC", "ﬁ①Ａ")
    assert one(spark, "k", lambda x: T.bucket("s", x)) == int.from_bytes(hashlib.sha256(b"s:k").digest()[:8], "big") % 10_000
    edges = spark.createDataFrame([(8999,), (9000,), (9499,), (9500,)], "b int").select(T.split_of(F.col("b"))).collect()
    assert [r[0] for r in edges] == ["train", "validation", "validation", "test"]


def test_gates(spark):
    assert one(spark, "a\x00b", T.has_control) and one(spark, "�", T.has_control) and not one(spark, "a\n\tb", T.has_control)
    assert one(spark, "sk-" + "a" * 16, T.has_secret) and not one(spark, "sk-short", T.has_secret)
    assert one(spark, "so <eos>", T.leaks_special)
    assert one(spark, "12 m/s.", lambda x: T.has_unit(x, F.lit("m/s"))) and not one(spark, "12 ms", lambda x: T.has_unit(x, F.lit("m")))


@pytest.mark.parametrize(
    "annotation, result",
    [("3*(4+5)=27", "27"), ("1/4=0.25", "0.25"), ("-2 - -3 = 1", "1"), ("1,000/8=125", "125"), ("0.1+0.2=0.3", "0.3"), ("1/3=0.33", None), ("2*3=7", None), ("1/0=1", None), ("1=1=1", None), ("((((1))))=1", None), ("2**3=8", None), ("", None)],
)
def test_annotations(annotation, result):
    if result is None:
        with pytest.raises(C.BadCalculation):
            C.verify(annotation)
    else:
        assert C.verify(annotation)[1] == result


@settings(max_examples=60, deadline=None)
@given(st.integers(-500, 500), st.integers(1, 400), st.sampled_from("+-*"))
def test_evaluate_matches_python(a, b, op):
    assert C.evaluate(f"({a}) {op} {b}")[1] == {"+": Fraction(a + b), "-": Fraction(a - b), "*": Fraction(a * b)}[op]


def test_tokens_and_packing(spark):
    tokens, mask = K.base_record(F.col("x"))
    row = spark.createDataFrame([("A",)], "x string").select(tokens.alias("t"), mask.alias("m"), sinks.u16_le(tokens).alias("p"), K.text_of(K.byte_ids(F.col("x"))).alias("b")).first()
    assert row.t == [256, 65, 257] and row.m == [0, 1, 1] and bytes(row.p) == struct.pack("<3H", 256, 65, 257) and row.b == "A"
    for reasoning, expected in ((None, [256, 258, 112, 259, 262, 102, 257]), ("r", [256, 258, 112, 259, 261, 114, 262, 102, 257])):
        t, m = K.response_record(F.lit("p"), F.lit("f"), F.lit(reasoning).cast("string"))
        row = spark.range(1).select(t.alias("t"), m.alias("m")).first()
        # the direct cue stands among the tokens that are no targets
        assert row.t == expected and len(row.m) == len(row.t)
        assert row.m == ([0] * 5 + [1, 1] if reasoning is None else [0] * 5 + [1, 1, 1, 1])


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "q"), (4, 0, "user", "q"), (4, 1, "user", "q"), (5, 0, "user", ""), (5, 1, "assistant", "a"), (6, 0, "system", "s"), (6, 1, "user", "q")]
    found = K.conversation_gate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id for r in found if r.valid} == {1}
    assert next((r.n_tokens, r.n_targets) for r in found if r.conv_id == 1) == (6, 2)


def test_greedy_budget_walk(spark):
    """Against a plain walk: repeated contents count once, rows that do not fit are passed over, and the walk goes on."""
    rows = []
    for g in ("a", "b", None):
        for i in range(300):
            content = i % 90 if i % 3 == 0 else i  # of equal contents, the first in hash order counts
            rows.append((g, i, (content * 7919) % 400 + 1, f"{content}"))
    rows.append(("c", 1, 10**6, "large"))
    frame = spark.createDataFrame(rows, "g string, k long, s long, c string").repartition(5)
    for most, budget in ((50, 3000), (3, 10_000), (1000, 200), (0, 100), (1000, 10**5)):
        expected = set()
        for g in ("a", "b", None, "c"):
            used, n, seen = 0, 0, set()
            for _, k, size, content in sorted((hashlib.sha256(f"s:{k}".encode()).hexdigest(), k, s, c) for gg, k, s, c in rows if gg == g):
                if content in seen:
                    continue
                seen.add(content)
                if n < most and used + size <= budget:
                    used, n = used + size, n + 1
                    expected.add((g, k))
        got = [(r.g, r.k) for r in S.within_budget(frame, "s", "g", "k", "s", "c", most, budget).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_running_offset(spark):
    keys = [3, 5000, 17, 2_000_000, 1_048_577, 1024]
    found = S.running_offset(spark.createDataFrame([(k, k % 7) for k in keys], "k long, n long"), "k", F.col("n")).collect()
    assert {r.k: r.offset for r in found} == {k: sum(x % 7 for x in keys if x < k) for k in keys}


def test_windows_cover_every_target_once(spark):
    rows = [(i, (i * 37) % 500) for i in range(40)]
    found = K.windows(spark.createDataFrame(rows, "k long, n long"), "k", F.col("n"), 64).collect()
    assert sum(r.n_targets for r in found) == sum(n for _, n in rows) - 1 and max(r.n_targets for r in found) == 64
    assert sorted(r.window for r in found) == list(range(len(found)))


def test_advantages_and_gates(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 4.0), ("b", 4.0), ("c", 1.0)], "g string, r double")
    got = sorted((r.g, round(r.advantage, 3)) for r in M.advantages(rows, "g", "r").collect())
    assert got == [("a", -1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("c", 0.0)]
    assert rows.where("g = 'b'").agg(M.pearson("r", "r")).first()[0] is None
    assert M.mixed_groups(rows.where("false"), "g", F.col("r") > 0).first().n_groups == 0


def test_quantise(spark):
    row = spark.createDataFrame([([7.0, -3.5, 0.4, 0.0, 0.0],)], "x array<double>").select(Q.quantised(F.col("x"), 4, 7).alias("p"), Q.packed_nibbles(F.array(F.lit(7), F.lit(-7), F.lit(1))).alias("n")).first()
    assert [p.codes for p in row.p] == [[7, -4, 0, 0], [0, 0, 0, 0]] and row.p[1].scale == 1.0 and row.n == [151, 1]


def test_conflicts_and_first(spark):
    rows = spark.createDataFrame([("k", "a", 2), ("k", "b", 1), ("l", "a", 3), (None, "a", 4)], "key string, payload string, at long")
    assert [r.key for r in S.conflicts(rows, "key", "payload").collect()] == ["k"]
    assert {(r.key, r.payload) for r in S.first_of_group(rows, ["key"], ["at"]).collect()} == {("k", "b"), ("l", "a"), (None, "a")}


def test_readers_and_sinks(spark, tmp_path):
    lines = [{"question": "q", "answer": "a\n#### 1,200"}, {"question": "q", "answer": "none"}, {"question": "", "answer": "#### 1"}, {"question": "q" * 300, "answer": "#### 1"}]
    (tmp_path / "w.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n\n")
    found = readers.word_problems(spark, str(tmp_path / "w.jsonl")).collect()
    assert sorted(r.reason for r in found) == ["accepted", "invalid_json", "missing_field", "no_final_answer", "too_long"]
    assert next(r.final for r in found if r.reason == "accepted") == "1200"
    good = {"task": "t", "prompt": "p", "expected_answer": "1", "family_id": "f", "source_id": "s"}
    (tmp_path / "e.jsonl").write_text(json.dumps(good))
    assert readers.evaluation_set(spark, str(tmp_path / "e.jsonl"), ["t"]).count() == 1
    (tmp_path / "f.jsonl").write_text("\n".join([json.dumps(good)] * 2))
    with pytest.raises(readers.GateError):
        readers.evaluation_set(spark, str(tmp_path / "f.jsonl"), ["t"])
    source = {"source_id": "s", "name": "n", "url": "u", "revision": "r", "subset": "x", "license_id": "l", "policy": "eligible", "notes": "", "stages": ["base"], "allowed_row_licenses": []}
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": 1, "sources": [source]}))
    assert readers.registry(spark, str(tmp_path / "r.json")).first().source_id == "s"
    (tmp_path / "x.json").write_text(json.dumps({"schema_version": 1, "sources": [source | {"policy": "excluded"}]}))
    with pytest.raises(readers.GateError):
        readers.registry(spark, str(tmp_path / "x.json"))
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, p string")
    assert sinks.append_new(rows, str(tmp_path / "c"), "k", "p") == 2
    assert sinks.append_new(rows.union(spark.createDataFrame([("c", "3")], "k string, p string")), str(tmp_path / "c"), "k", "p") == 1
    with pytest.raises(readers.GateError):
        sinks.append_new(spark.createDataFrame([("a", "9")], "k string, p string"), str(tmp_path / "c"), "k", "p")
    text = spark.createDataFrame([(None, 1)], "b string, a int").select(sinks.canonical_json(["b", "a"])).first()[0]
    assert text == '{"a":1,"b":null}'
    rows = spark.createDataFrame([(2, ("y", [1.5]), None)], "b int, a struct<z: string, c: array<double>>, n string")
    assert rows.select(sinks.canonical_rows(rows)).first()[0] == '{"a":{"c":[1.5],"z":"y"},"b":2,"n":null}'
    with pytest.raises(Exception, match="no finite number"):
        nan = spark.createDataFrame([(float("nan"),)], "x double")
        nan.select(sinks.canonical_rows(nan)).collect()
    assert sinks.allowed(rows, ["b"], ["n", "missing"]).columns == ["b", "n"]
    with pytest.raises(readers.GateError):
        sinks.allowed(rows, ["missing"], [])


def _published(spark, folder):
    rows = [("train", "r1", "f", [256, 65, 257], [0, 1, 1]), ("test", "r2", "f", [256, 257], [0, 1]), ("validation", "r3", "g", [256, 258, 195, 169, 257], [0, 0, 0, 1, 1])]
    packed = spark.createDataFrame(rows, "split string, record_id string, family_id string, tokens array<int>, mask array<int>")
    shards.publish(packed, folder)
    return packed


def test_shards(spark, tmp_path):
    folder = f"file://{tmp_path}/pub"
    packed = _published(spark, folder)
    found = {r.record_id: (bytes(r.tokens), bytes(r.mask), r.n_targets) for r in shards.load(spark, folder).collect()}
    assert found["r3"] == (struct.pack("<5H", 256, 258, 195, 169, 257), b"\x00\x00\x00\x01\x01", 2) and len(found) == 3
    with pytest.raises(readers.GateError, match="exists"):
        shards.publish(packed, folder)
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]
    with pytest.raises(Exception, match="out of range"):
        shards.publish(packed.withColumn("tokens", F.array(F.lit(70_000))), f"{folder}-2")
    assert not (tmp_path / "pub-2").exists()
    shards.replace_corpus(spark, folder)
    assert not (tmp_path / "pub").exists()
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "notes.txt").write_text("x")
    with pytest.raises(readers.GateError, match="no published corpus"):
        shards.replace_corpus(spark, f"file://{tmp_path}/mine")


@pytest.mark.parametrize("change", ["tokens", "mask", "drop", "count"])
def test_shards_notice_damage(spark, tmp_path, change):
    folder = f"file://{tmp_path}/pub"
    _published(spark, folder)
    rows = spark.read.parquet(f"{folder}/records")
    if change == "tokens":  # an unknown id, with a digest that fits it
        bad = rows.withColumn("tokens", F.unhex(F.regexp_replace(F.hex("tokens"), "^0001", "0901"))).withColumn("tokens_sha256", F.sha2("tokens", 256))
    elif change == "mask":
        bad = rows.withColumn("mask", F.unhex(F.regexp_replace(F.hex("mask"), "^00", "02"))).withColumn("mask_sha256", F.sha2("mask", 256))
    elif change == "drop":
        bad = rows.where("record_id <> 'r1'")
    else:
        bad = rows.withColumn("n_targets", F.col("n_targets") + 1)
    other = f"file://{tmp_path}/bad"
    bad.write.partitionBy("split").parquet(f"{other}/records")
    spark.read.json(f"{folder}/manifest").write.json(f"{other}/manifest")
    with pytest.raises(readers.GateError):
        shards.load(spark, other)


def test_pins_and_whole_texts(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    file = next(p for p in (tmp_path / "p").iterdir() if p.name.startswith("part"))
    digest = hashlib.sha256(file.read_bytes()).hexdigest()
    assert shards.pinned_parquet(spark, {str(file): digest}).count() == 3
    with pytest.raises(readers.GateError):
        shards.pinned_parquet(spark, {str(file): "0" * 64})
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("é\nb".encode())
    assert [r.text for r in shards.whole_texts(spark, str(tmp_path / "t")).collect()] == ["é\nb"]
    with pytest.raises(readers.GateError, match="too large"):
        shards.whole_texts(spark, str(tmp_path / "t"), 3)
    (tmp_path / "t" / "b.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception):
        shards.whole_texts(spark, str(tmp_path / "t")).collect()
    shards.write_json(spark, f"file://{tmp_path}/t", "m.json", '{"a":1}')
    shards.write_json(spark, f"file://{tmp_path}/t", "m.json", '{"a":2}')
    assert (tmp_path / "t" / "m.json").read_text() == '{"a":2}' and not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".m.json.") and "crc" not in p.name]


def test_registry_keys_and_pins(spark, tmp_path):
    source = {"source_id": "s", "name": "n", "url": "u", "revision": "r", "subset": "x", "license_id": "l", "policy": "eligible", "notes": "", "stages": ["base"], "allowed_row_licenses": []}
    for i, (file, what) in enumerate([
        ({"schema_version": 2, "sources": [source]}, "version"), ({"schema_version": 1, "sources": [source], "more": 1}, "keys"), ({"schema_version": 1, "sources": [source | {"more": 1}]}, "keys of a source"),
        ({"schema_version": 1, "sources": [{k: v for k, v in source.items() if k != "notes"}]}, "keys of a source"), ({"schema_version": 1, "sources": [source | {"notes": "sk-" + "a" * 20}]}, "secret"),
    ]):
        (tmp_path / f"{i}.json").write_text(json.dumps(file))
        with pytest.raises(readers.GateError, match=what):
            readers.registry(spark, str(tmp_path / f"{i}.json"))
    good = {"revision": "a" * 40, "path": "data/x.parquet", "row_groups": [0, 3]}
    assert readers.snapshot_errors(good) == []
    assert readers.snapshot_errors({"revision": "A" * 40, "path": "../x.parquet", "row_groups": [3, 3]}) == ["revision", "path", "row_groups"]
    records, sources = spark.createDataFrame([("s", "l1")], "source_id string, license_id string"), spark.createDataFrame([("s", "l", "row-filtered", ["l1"])], "source_id string, license_id string, policy string, allowed_row_licenses array<string>")
    assert [readers.licence_gate(records, sources, only).first().reason for only in (False, True)] == ["accepted", "not_eligible"]


def test_corpora_gates(spark):
    rows = spark.createDataFrame([("train", "f", 1, 2), ("test", "f", 1, 1)], "split string, family_id string, n_tokens long, n_targets long")
    with pytest.raises(readers.GateError, match="validation"):
        corpora.manifest(rows)
    with pytest.raises(readers.GateError, match="repeated records"):
        corpora.union_records([("a", rows), ("b", rows)], "split")
    cache = spark.createDataFrame([("k", "1"), ("k", "2")], "request string, answer string")
    with pytest.raises(readers.GateError, match="several answers"):
        corpora.probed(cache.select("request"), cache)
    labels = spark.createDataFrame([((["quality", "x"], [0.7, 0.1]),), ((["quality"], [0.7, 0.1]),), (None,)], "l struct<name: array<string>, value: array<double>>")
    assert [r[0] for r in labels.select(corpora.label_value(F.col("l"), "quality")).collect()] == [0.7, None, None]


def test_offsets_of_groups(spark):
    rows = [(i % 3 == 0, None if i == 7 else i * 1_000_003 % 500, i) for i in range(300)]
    found = S.running_offset(spark.createDataFrame(rows, "g boolean, k int, n int").repartition(7), "k", F.col("n"), ["g"]).collect()
    for g in (True, False):
        total = 0
        for r in sorted((r for r in found if r.g == g), key=lambda r: (-1 if r.k is None else r.k, r.n)):
            assert r.offset == total
            total += r.n
    assert len(found) == 300


def test_stable_ids(spark):
    value = {"a": "é\"漢\n😀", "b": 1}
    plain = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    want = hashlib.sha256(json.dumps(value, ensure_ascii=True, separators=(",", ":")).encode()).hexdigest()[:24]
    assert one(spark, plain, lambda x: T.stable_id("gsm8k", x)) == f"gsm8k-{want}"


def test_rollout_edges(spark):
    cases = [("think", 3, []), ("think", 3, [K.EOS]), ("think", 3, [1, K.FINAL, 2, K.FINAL]), ("direct", 3, [1, K.FINAL]), ("think", 9, [1, 2, 3, 4]), ("direct", 1, [5] * 20)]
    rows = spark.createDataFrame(cases, "mode string, n_prompt int, generated array<int>")
    found = [(r.reasoning, r.final, r.terminated, r.special_token_leak, r.final_transition, r.context_exhausted, r.budget_exhausted, r.n_generated) for r in rollouts.split_generated(rows, 10, 6).collect()]
    assert found == [
        ([], [], False, False, False, False, False, 0), ([], [], True, False, False, False, False, 1), ([1], [2], False, True, True, False, False, 4), ([], [1], False, True, False, False, False, 2),
        ([1, 2], [], False, False, False, True, False, 2), ([], [5] * 6, False, False, False, False, True, 6),
    ]


def test_numbers_restated(spark):
    pattern = re.compile(r"(?<![\w/])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?![\w/])")
    texts = ["1 2 2.0 3,000", "é9 ٣ 4/5 6", "", "-1 +1"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", F.size(T.numbers(F.col("x"))).alias("n")).collect()
    assert {r.x: r.n for r in rows} == {t: len({Fraction(m.group(0).replace(",", "")) for m in pattern.finditer(t)} if "٣" not in t else {1, 2}) for t in texts}
