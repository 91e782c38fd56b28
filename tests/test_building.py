"""Schedules, the answer cache, observed writes, conversations, composed corpora, compact problems, generated ones, budgets."""

import hashlib
import os
import random
import threading
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import corpora, generate, measures, schedule, selection
from millrace.operators import tokens as K
from millrace.sources import flat_shards, sinks
from millrace.sources.cache import AnswerCache, canonical_payload
from millrace.sources.readers import GateError, strict_lines


@pytest.fixture
def parts(spark):
    """Run with so many shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


# Schedules


def pool(spark, n=60):
    return spark.createDataFrame([(f"f{i:03d}", schedule.TASKS[i % 2]) for i in range(n)] + [("f000", schedule.TASKS[0]), ("other", "poetry")], "family_id string, task string")


def test_schedule_is_balanced_for_any_partitions(spark, parts):
    found = sorted(map(tuple, schedule.prompt_schedule(pool(spark), "s", 12).collect()))
    parts(9)
    assert sorted(map(tuple, schedule.prompt_schedule(pool(spark), "s", 12).collect())) == found
    assert len(found) == 48 and [r[:2] for r in found] == [(u, s) for u in range(1, 13) for s in range(4)]
    assert found[0][2] == "policy-s:update-01:slot-0" and found[-1][2] == "policy-s:update-12:slot-3"
    assert all(sorted((r[3], r[4]) for r in found[4 * u : 4 * u + 4]) == sorted((t, m) for t in schedule.TASKS for m in schedule.MODES) for u in range(12))
    rank = lambda f: hashlib.sha256(f"s:{f}".encode()).hexdigest()
    for i, task in enumerate(schedule.TASKS):
        wanted = sorted((f"f{k:03d}" for k in range(i, 60, 2)), key=rank)[:24]
        assert sorted(r[5] for r in found if r[3] == task) == sorted(wanted)
    assert schedule.schedule_errors(schedule.prompt_schedule(pool(spark), "s", 12), 12).count() == 0
    with pytest.raises(GateError, match="too few families"):
        schedule.prompt_schedule(pool(spark), "s", 16)


def test_validator_finds_each_violation(spark):
    good = schedule.prompt_schedule(pool(spark), "s", 5).collect()
    rows = [r.asDict() for r in good]
    change = lambda i, **new: [{**r, **new} if k == i else r for k, r in enumerate(rows)]
    first = rows[0]
    mate = next(i for i, r in enumerate(rows) if r["update"] == first["update"] and r["mode"] != first["mode"])
    alien = next(i for i, r in enumerate(rows) if r["update"] == first["update"] and r["task"] != first["task"])
    cases = {
        frozenset({"size", "update_size", "mode_balance", "task_balance"}): rows[1:],
        frozenset({"repeated_id"}): change(1, schedule_id=first["schedule_id"]),
        frozenset({"repeated_family"}): change(1, family_id=first["family_id"]),
        frozenset({"update_size", "mode_balance", "task_balance"}): change(0, update=2 if first["update"] != 2 else 3),
        frozenset({"mode_balance"}): change(mate, mode=first["mode"]),
        frozenset({"task_balance"}): change(alien, task=first["task"]),
    }
    for reasons, bad in cases.items():
        assert {r.reason for r in schedule.schedule_errors(spark.createDataFrame(bad), 5).collect()} == reasons
    late = [{**r, "update": 6} if r["update"] == 5 else r for r in rows]
    assert [tuple(r) for r in schedule.schedule_errors(spark.createDataFrame(late), 5).collect()] == [("update_size", 2)]
    empty = spark.createDataFrame(rows).where("false")
    assert {r.reason: r.n for r in schedule.schedule_errors(empty, 5).collect()} == {"size": 20, "update_size": 5}


# The cache


def answers(spark, ids, version="v"):
    return spark.createDataFrame([(hashlib.sha256(str(i).encode()).hexdigest(), f"{version}{i}") for i in ids], "request string, payload string")


def test_two_writers_at_once_keep_both(spark, tmp_path):
    cache, results = AnswerCache(spark, f"file://{tmp_path}/c", 4), {}

    def put(name, ids):
        try:
            results[name] = AnswerCache(spark, f"file://{tmp_path}/c").append(answers(spark, ids))
        except Exception as error:
            results[name] = error

    writers = [threading.Thread(target=put, args=(k, range(10 * k, 10 * k + 15))) for k in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sum(results.values()) == 35 and cache.version() == 3
    assert sorted(map(tuple, cache.read().collect())) == sorted(map(tuple, answers(spark, range(35)).collect()))
    # Only what manifests name is there, and each request once.
    assert len(os.listdir(tmp_path / "c" / "segments")) == 3 and cache.read(0).count() == 0


def test_cache_conflicts_and_repetition(spark, tmp_path):
    cache = AnswerCache(spark, f"file://{tmp_path}/c", 2)
    assert cache.append(answers(spark, [1, 2, 2])) == 2 and cache.append(answers(spark, [2, 1])) == 0
    for bad, message in [(answers(spark, [3]).unionByName(answers(spark, [2], "w")), "another payload"), (answers(spark, [4]).unionByName(answers(spark, [4], "w")), "several payloads"), (answers(spark, [5]).withColumn("payload", F.lit(None).cast("string")), "without request")]:
        with pytest.raises(GateError, match=message):
            cache.append(bad)
    assert cache.version() == 1 and cache.read().count() == 2
    assert AnswerCache(spark, f"file://{tmp_path}/c", 64).buckets == 2


def test_probe_does_not_move_the_cache(spark, tmp_path):
    cache = AnswerCache(spark, f"file://{tmp_path}/c", 4)
    cache.append(answers(spark, range(20)))
    cache.append(answers(spark, range(15, 40)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        asked = answers(spark, range(30, 50)).select("request", F.lit(1).alias("more"))
        probe = cache.probe(asked)
        plan = probe._jdf.queryExecution().sparkPlan().toString() + probe._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan[plan.index("FileScan") - 400 : plan.index("FileScan")].count("Exchange") == 0
        assert probe.where("payload IS NOT NULL").count() == 10 and probe.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_canonical_payload(spark):
    rows = spark.sql("SELECT 'k' AS request, 2 AS b, named_struct('z', 'é', 'a', CAST(NULL AS INT)) AS a, array(named_struct('y', 1, 'x', map('q', 2, 'p', 3))) AS c")
    assert tuple(canonical_payload(rows, "request").first()) == ("k", '{"a":{"a":null,"z":"\\u00e9"},"b":2,"c":[{"x":{"p":3,"q":2},"y":1}]}')


# Observed writes


def test_account_of_what_was_written(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "train").otherwise("test").alias("split"), F.when(F.col("id") % 7 == 0, "short").otherwise("accepted").alias("reason"), (F.col("id") * 2).alias("tokens"))
    account, totals = sinks.write_with_account(rows, f"{tmp_path}/w", "split", ["train", "validation", "test"], ["tokens"], ["short", "long"])
    assert {tuple(r) for r in account.collect()} == {("accepted", 857), ("short", 143)}
    kept = [i for i in range(1000) if i % 7]
    assert {tuple(r) for r in totals.collect()} == {("train", sum(i % 3 == 0 for i in kept), sum(2 * i for i in kept if i % 3 == 0)), ("validation", 0, 0), ("test", sum(i % 3 > 0 for i in kept), sum(2 * i for i in kept if i % 3))}
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/w").collect()) == kept
    with pytest.raises(Exception, match="not known"):
        sinks.write_with_account(rows.withColumn("reason", F.lit("odd")), f"{tmp_path}/x", "split", ["train", "test"], ["tokens"], [])
    none = sinks.write_with_account(rows.where("false"), f"{tmp_path}/y", "split", ["train"], ["tokens"], [])
    assert none[0].count() == 0 and [tuple(r) for r in none[1].collect()] == [("train", 0, 0)]


# Conversations and modes


def talk(spark, turns):
    return spark.createDataFrame([("c", i, role, text) for i, (role, text) in enumerate(turns)], "conv_id string, turn long, role string, text string")


def test_conversation_golden(spark):
    row = K.conversation_records(talk(spark, [("user", "A"), ("assistant", "é"), ("user", "B"), ("assistant", "C")])).first()
    assert row.reason == "accepted" and np.frombuffer(row.tokens, "<u2").tolist() == [256, 258, 65, 259, 195, 169, 258, 66, 259, 67, 257]
    assert list(row.mask) == [0, 0, 0, 0, 1, 1, 0, 0, 0, 1, 1]
    shuffled = talk(spark, [("user", "A"), ("assistant", "b")]).orderBy(F.desc("turn"))
    assert np.frombuffer(K.conversation_records(shuffled).first().tokens, "<u2").tolist() == [256, 258, 65, 259, 98, 257]


@pytest.mark.parametrize(
    "turns, reason",
    [([("assistant", "A"), ("user", "B")], "starts_with_user"), ([("user", "A"), ("user", "B")], "alternates"), ([("user", "A"), ("system", "B")], "alternates"), ([("user", ""), ("assistant", "B")], "empty_turn"),
     ([("user", "A"), ("assistant", None)], "empty_turn"), ([("user", "A")], "ends_with_assistant"), ([("user", "A"), ("assistant", "B" * 8)], "too_long"), ([(None, "A"), ("assistant", "B")], "starts_with_user")],
)
def test_conversation_reasons(spark, turns, reason):
    row = K.conversation_records(talk(spark, turns), context=12).first()
    assert (row.reason, row.tokens, row.mask) == (reason, None, None)


def test_packed_modes_equal_the_arrays(spark):
    rows = spark.createDataFrame([("a", "f", "Why?", "Because é.", "So."), ("b", "f", "", "", ""), ("c", "g", "漢", "x", "y" * 300)], "record_id string, family_id string, prompt string, reasoning string, final string")
    arrays = {(r.record_id, r.mode): (r.tokens, r["mask"]) for r in corpora.mode_records(rows).collect()}
    packed = {(r.record_id, r.mode): (np.frombuffer(r.tokens, "<u2").tolist(), list(r["mask"])) for r in corpora.packed_modes(rows).collect()}
    assert packed == arrays and len(packed) == 6


def test_composed_corpus_is_its_parts_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["train", "test"]), i, "x" * rng.randrange(50)) for i in range(30)] + [("train", 40, "t"), ("test", 41, "u"), ("train", 42, "t"), ("test", 43, "u")]
    docs = spark.createDataFrame(rows, "split string, record_id long, text string").select("split", "record_id", K.packed_base("text").alias("r")).select("split", "record_id", "r.tokens", "r.mask")
    sides, folders = ("train", "test"), {name: f"{tmp_path}/{name}" for name in ("new", "general_replay")}
    flat_shards.publish_flat(docs.where("record_id % 2 = 0 OR record_id = 41"), folders["new"], sides)
    flat_shards.publish_flat(docs.where("record_id % 2 = 1"), folders["general_replay"], sides)
    manifest = flat_shards.compose_flat(spark, folders, f"{tmp_path}/all", replay="general_replay")
    assert flat_shards.verify_flat(spark, f"{tmp_path}/all") == manifest
    for name in ("train.tokens.bin", "train.loss.bin", "test.tokens.bin", "test.loss.bin"):
        assert (tmp_path / "all" / name).read_bytes() == b"".join((tmp_path / part / name).read_bytes() for part in folders)
    told = {c["name"]: c for c in manifest["components"]}
    assert told["new"]["manifest_sha256"] == hashlib.sha256((tmp_path / "new" / "manifest.json").read_bytes()).hexdigest()
    assert manifest["replay_train_fraction"] == told["general_replay"]["tokens"]["train"] / manifest["splits"]["train"]["tokens"]
    # The other order is another corpus.
    turned = flat_shards.compose_flat(spark, dict(reversed(folders.items())), f"{tmp_path}/turned")
    assert turned["splits"]["train"]["digest"] != manifest["splits"]["train"]["digest"] and turned["splits"]["train"]["tokens"] == manifest["splits"]["train"]["tokens"]
    path = tmp_path / "new" / "train.tokens.bin"
    path.write_bytes(b"\x01" + path.read_bytes()[1:])
    with pytest.raises(GateError, match="flat shards"):
        flat_shards.compose_flat(spark, folders, f"{tmp_path}/bad")
    assert not (tmp_path / "bad").exists() and not [n for n in os.listdir(tmp_path) if "staging" in n]


# Problems


def test_compact_problem_reasons(spark):
    step = "<<2*3=6>>"
    cases = [
        (" How  many? ", f"Two threes {step}.\n#### 6", "accepted"), ("", f"{step}\n#### 6", "missing_field"), ("Q", None, "missing_field"), ("Q", f"{step}\nsix", "no_final_answer"), ("Q", "Six.\n#### 6", "annotation_count"),
        ("Q", f"{step * 5}\n#### 6", "annotation_count"), ("Q", "<<2*3=7>>\n#### 7", "invalid_annotation"), ("Q", f"{step}\n#### 7", "final_mismatch"), ("Q", "<<" + "+".join(["1000000"] * 22) + "=22000000>>\n#### 22000000", "reasoning_too_long"),
    ]
    rows = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(cases)], "i int, question string, answer string")
    found = sorted(corpora.compact_problems(rows).collect(), key=lambda r: r.i)
    assert [r.reason for r in found] == [c[2] for c in cases]
    one = found[0]
    assert (one.reasoning, one.final_answer, one.exact_answer, one.n_steps) == ("Compute 2 * 3 = 6.", "The answer is 6.", "6", 1)
    assert one.family_id == "gsm8k-" + hashlib.sha256(b'{"question":"how many?"}').hexdigest()[:24] and found[7].family_id is None


def test_generated_problems(spark, parts):
    quotas = spark.createDataFrame([("integer", 30), ("decimal", 7), ("nested", 0)], "route string, quota int")
    none = spark.createDataFrame([], "family_id string")
    free = generate.problems(quotas, none, "s").collect()
    frozen = spark.createDataFrame([(r.family_id,) for r in free[::2]], "family_id string")
    rows = generate.problems(quotas, frozen, "s").collect()
    parts(7)
    assert sorted(map(tuple, generate.problems(quotas, frozen, "s").collect())) == sorted(map(tuple, rows))
    assert {route: sum(r.route == route for r in rows) for route in generate.ROUTES} == {"integer": 30, "decimal": 7, "nested": 0}
    assert len({r.family_id for r in rows}) == 37 and not {r.family_id for r in rows} & {r.family_id for r in free[::2]}
    # What was not frozen stays, by counter.
    for route in ("integer", "decimal"):
        kept = sorted(r.counter for r in free[1::2] if r.route == route)
        assert set(kept) <= {r.counter for r in rows if r.route == route}
    nested = generate.problems(spark.createDataFrame([("nested", 200)], "route string, quota int"), none, "s").collect()
    for r in [*rows, *nested]:
        exact = eval(__import__("re").sub(r"\d+(?:\.\d+)?", lambda m: f"Fraction('{m[0]}')", r.expression), {"Fraction": Fraction})
        assert exact == Fraction(r.answer) and r.worked.endswith(f" = {r.answer}.")
    with pytest.raises(GateError, match="unknown routes"):
        generate.problems(spark.createDataFrame([("poem", 1)], "route string, quota int"), none, "s")


def test_signs_probes_and_overlap(spark):
    text = "".join(T.SIGNS) + " é"
    assert spark.createDataFrame([(text,)], "t string").select(T.ascii_maths(F.col("t"))).first()[0] == "".join(T.SIGNS.values()) + " é"
    rows = spark.sql("SELECT array(1.0D, 2.0D) AS a, array(1.0D, 2.0001D) AS b, array(1.0D) AS short")
    gate = lambda x, y, p, q: rows.select(*measures.probe_gate(F.col(x), F.col(y), F.lit(p), F.lit(q))).first()
    assert not gate("a", "b", 1, 1).passed and gate("a", "a", 1, 1).passed and not gate("a", "a", 1, 2).passed
    assert abs(gate("a", "b", 1, 1).max_error - 1e-4) < 1e-12
    with pytest.raises(Exception, match="different lengths"):
        gate("a", "short", 1, 1)
    seeds = spark.createDataFrame([(5.0, 5.0, 1.0, 1.0)] * 3, "primary double, challenge double, format_rate double, mode_rate double")
    families = lambda *x: spark.createDataFrame([(f,) for f in x], "family_id string")
    assert measures.seed_gate(seeds, 1.0, 1.0, families("a", "b"), families("c")).first().improved
    closed = measures.seed_gate(seeds, 1.0, 1.0, families("a", "b", "b"), families("b", "c")).first()
    assert not closed.improved and closed.n_overlap == 1


# Budgets


def walked(rows, seed, most, budget):
    """The walk, row by row."""
    chosen = []
    for g in {r[0] for r in rows}:
        seen, used, n = set(), 0, 0
        for _, k, s, c in sorted((r for r in rows if r[0] == g), key=lambda r: (hashlib.sha256(f"{seed}:{r[1]}".encode()).hexdigest(), r[1])):
            if c in seen:
                continue
            seen.add(c)
            if n < most and used + s <= budget:
                used, n = used + s, n + 1
                chosen.append((g, k, s))
    return sorted(chosen, key=repr)


@pytest.mark.parametrize("hot", [10**6, 40, 0])
def test_budget_walk_and_rounds_choose_alike(spark, monkeypatch, hot):
    rng = random.Random(hot)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i, rng.choice([0, 1, 5, 30, 90, 500]), f"c{rng.randrange(150)}") for i in range(240)]
    df = spark.createDataFrame(rows, "g string, k long, s long, c string").repartition(5)
    rounds = []
    if hot:
        whole = selection.running_offset
        monkeypatch.setattr(selection, "running_offset", lambda *a, **k: rounds.append(1) or whole(*a, **k))
    for most, budget in ((1000, 400), (6, 10**6), (1000, 0)) if hot else ((9, 300),):
        found = selection.within_budget(df, "s", "g", "k", "s", "c", most, budget, hot=hot)
        assert sorted(map(tuple, found.collect()), key=repr) == walked(rows, "s", most, budget)
    # Groups of usual size need no rounds at all; a hot one a few, however many rows it has.
    assert len(rounds) == 0 if hot == 10**6 else len(rounds) <= 60


def test_budget_walk_across_batches(spark):
    """One group over many Arrow batches is walked on from where the last one ended."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [("g" if i % 4 else "h", i, (i * 7) % 11, f"c{i}") for i in range(60)]
        df = spark.createDataFrame(rows, "g string, k long, s long, c string")
        found = selection.within_budget(df, "s", "g", "k", "s", "c", 12, 55)
        assert sorted(map(tuple, found.collect()), key=repr) == walked(rows, "s", 12, 55)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_exactly_so_many_of_each_group(spark, parts):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)] + [(100, "other")], "k long, g string")
    found = sorted(map(tuple, selection.exactly_per_group(rows, "s", "k", "g", {"a": 5, "b": 3}).collect()))
    parts(7)
    assert sorted(map(tuple, selection.exactly_per_group(rows, "s", "k", "g", {"a": 5, "b": 3}).collect())) == found
    rank = lambda k: hashlib.sha256(f"s:{k}".encode()).hexdigest()
    wanted = [(k, g) for g, n in (("a", 5), ("b", 3)) for k in sorted(sorted((k for k in range(40) if "ab"[k % 2] == g), key=rank)[:n])]
    assert sorted(found, key=lambda r: r[2]) == [(*w, i) for i, w in enumerate(wanted)]
    with pytest.raises(GateError, match="not enough"):
        selection.exactly_per_group(rows, "s", "k", "g", {"a": 21})
    with pytest.raises(GateError, match="chosen twice"):
        selection.exactly_per_group(rows.unionByName(rows), "s", "k", "g", {"a": 40})


@pytest.mark.parametrize("line, message", [('{"a": "x"}', "FAILFAST|Malformed|malformed|parse"), ("[1]", "no objects"), ("nonsense", "no objects"), ('{"a": 1, "z": 2}', "unknown fields"), ('{"b": "x"}', "required"), ('{"a": 2}', "repeated")])
def test_strict_lines_stop_at_the_first_bad_one(spark, tmp_path, line, message):
    (tmp_path / "good.json").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert strict_lines(spark, f"{tmp_path}/good.json", "a long, b string", ["a"], "a").count() == 2
    (tmp_path / "bad.json").write_text(line + "\n")
    with pytest.raises(Exception, match=message):
        strict_lines(spark, str(tmp_path), "a long, b string", ["a"], "a").collect()
