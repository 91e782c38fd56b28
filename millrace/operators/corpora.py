"""Building corpora: gates on web texts and dialogues, paired modes, manifests, composing and extending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import calculations
from millrace.functions import text as T
from millrace.operators import tokens as K
from millrace.operators.digests import stream_digests
from millrace.operators.selection import conflicts, running_offset
from millrace.sources.readers import GateError, demand_none, first_reason

# The limits of a public text and of its scores.
LEAST_BYTES, MOST_BYTES, LEAST_LANGUAGE, LEAST_EDUCATION = 256, 65_536, 0.9, 4
SPLITS = ["train", "validation", "test"]


def web_reason(text: Column, url: Column, scored: Column, language: Column, language_score: Column, education: Column) -> Column:
    """Why a web text is refused, or accepted. Only rows of a scored source have their scores checked; NaN is no score."""
    size = F.octet_length(text)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = [
        ("missing_text", blank(text)),
        ("missing_url", blank(url)),
        ("language", scored & ~language.eqNullSafe("en")),
        ("language_score", scored & ~F.coalesce(language_score.between(LEAST_LANGUAGE, 1e308), F.lit(False))),
        ("education", scored & ~F.coalesce(education >= LEAST_EDUCATION, F.lit(False))),
        ("replacement_character", F.contains(text, F.lit("�"))),
        ("control_character", T.has_control(text)),
        ("too_short", size < LEAST_BYTES),
        ("too_long", size > MOST_BYTES),
    ]
    return first_reason(rules)


def label_value(labels: Column, name: str) -> Column:
    """The value of a label in labels: struct<name: array<string>, value: array<double>>; null if the arrays do not match."""
    pairs = F.filter(F.arrays_zip(labels["name"].alias("name"), labels["value"].alias("value")), lambda p: (p["name"] == name) & p["value"].isNotNull())
    return F.when(F.size(labels["name"]) == F.size(labels["value"]), F.try_element_at(pairs, F.lit(1))["value"])


def dialogue_pairs(messages: DataFrame, context: int = 256) -> DataFrame:
    """Assistant messages with their parents: message_id, tree, question, answer and reason (accepted, or the first rule against the pair).

    messages: message_id, parent_id, message_tree_id, role, text, lang, review_result, tree_state,
    synthetic, deleted, rank, labels. A missing parent is a reason, so the join is an outer one. One
    message_id with several contents is an error.
    """
    demand_none(conflicts(messages.withColumn("_all", F.xxhash64(*messages.columns)).where("message_id IS NOT NULL"), "message_id", "_all"), "messages with one id and several contents")
    # A message without an id is no copy of another one without.
    messages = messages.where("message_id IS NOT NULL").dropDuplicates(["message_id"]).unionByName(messages.where("message_id IS NULL"))
    asked = messages.where("message_id IS NOT NULL").select(*[F.col(c).alias(f"p_{c}") for c in messages.columns])
    pairs = messages.where("role = 'assistant'").join(asked, F.col("parent_id") == F.col("p_message_id"), "left")
    question, answer = T.normalise_lines(F.coalesce("p_text", F.lit(""))), T.normalise_lines(F.coalesce("text", F.lit("")))
    both = lambda name, value: F.col(name).eqNullSafe(value) & F.col(f"p_{name}").eqNullSafe(value)
    pairs = pairs.withColumns({"question": question, "answer": answer, "quality": label_value(F.col("labels"), "quality"), "toxicity": label_value(F.col("labels"), "toxicity")})
    rules = [
        ("parent", F.col("p_message_id").isNull()),
        ("review", ~both("review_result", True)),
        ("tree_state", ~both("tree_state", "ready_for_export")),
        ("synthetic", ~both("synthetic", False)),
        ("quality", ~F.coalesce(F.col("quality") >= 0.5, F.lit(False))),
        ("toxicity", F.col("toxicity") > 0.5),
        ("prompt_role", ~F.col("p_role").eqNullSafe("prompter")),
        ("language", ~both("lang", "en")),
        ("deleted", ~both("deleted", False)),
        ("rank", ~F.col("rank").eqNullSafe(0)),
        ("tree", ~F.col("message_tree_id").eqNullSafe(F.col("p_message_tree_id"))),
        ("root", F.col("p_parent_id").isNotNull()),
        ("empty", (F.col("question") == "") | (F.col("answer") == "")),
        ("context", F.octet_length("question") + F.octet_length("answer") + 5 > context),
    ]
    return pairs.withColumn("reason", first_reason(rules)).select("message_id", F.col("message_tree_id").alias("tree"), "question", "answer", "reason")


def paired_fit(examples: DataFrame, frozen: DataFrame, context: int = 256) -> tuple[DataFrame, DataFrame]:
    """Of examples (family_id, prompt, reasoning, final) those that fit in both modes and whose family is not frozen; and the account in one row."""
    direct, think = K.response_lengths(F.col("prompt"), F.col("final"), F.col("reasoning"))
    known = frozen.select("family_id").distinct().withColumn("_frozen", F.lit(True))
    marked = examples.join(known, "family_id", "left").withColumns({"_frozen": F.coalesce("_frozen", F.lit(False)), "_direct": direct > context, "_think": think > context})
    open_ = ~F.col("_frozen")
    account = marked.agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if("_frozen").alias("n_frozen"),
        F.count_if(open_ & F.col("_direct")).alias("direct_rejects"),
        F.count_if(open_ & F.col("_think")).alias("think_rejects"),
        F.count_if(open_ & ~F.col("_direct") & ~F.col("_think")).alias("n_eligible"),
    )
    return marked.where(open_ & ~F.col("_direct") & ~F.col("_think")).select(*examples.columns), account


# Steps of a compact solution, and its bytes.
MOST_STEPS, MOST_REASONING_BYTES = 4, 160


def compact_problems(problems: DataFrame) -> DataFrame:
    """problems (question, answer and others) with exact_answer, n_steps, reasoning, final_answer, family_id and reason.

    reason is accepted, or the first rule against a problem: missing_field, no_final_answer, annotation_count (one to four),
    invalid_annotation, final_mismatch (the last step is not the answer), reasoning_too_long. The reasoning
    of an accepted one is made of its verified annotations alone; of a refused one it is null.
    """
    question = T.squeeze(F.coalesce("question", F.lit("")))
    rows = problems.withColumns({"_q": question, "_f": T.final_number(F.col("answer")), "_a": T.annotations(F.coalesce("answer", F.lit("")))})
    checked = F.array(*[calculations.verified(F.try_element_at("_a", F.lit(i + 1))) for i in range(MOST_STEPS)])
    rows = rows.withColumn("_s", F.slice(checked, 1, F.least(F.size("_a"), F.lit(MOST_STEPS))))
    text = F.array_join(F.transform("_s", lambda x: F.concat(F.lit("Compute "), x["expression"], F.lit(" = "), x["result"], F.lit("."))), " ")
    rows = rows.withColumn("_r", text)
    rules = [
        ("missing_field", (F.col("_q") == "") | (F.coalesce(F.trim("answer"), F.lit("")) == "")),
        ("no_final_answer", F.col("_f").isNull()),
        ("annotation_count", ~F.size("_a").between(1, MOST_STEPS)),
        ("invalid_annotation", F.exists("_s", lambda x: x["error"].isNotNull())),
        ("final_mismatch", ~F.try_element_at("_s", F.lit(-1))["result"].eqNullSafe(F.col("_f"))),
        ("reasoning_too_long", F.octet_length("_r") > MOST_REASONING_BYTES),
    ]
    rows = rows.withColumn("reason", first_reason(rules))
    good = lambda c: F.when(F.col("reason") == "accepted", c)
    family = T.stable_id("gsm8k", F.to_json(F.struct(F.lower("_q").alias("question"))))
    return rows.select(
        *problems.columns, F.col("_f").alias("exact_answer"), F.size("_a").alias("n_steps"), good(F.col("_r")).alias("reasoning"),
        good(F.concat(F.lit("The answer is "), "_f", F.lit("."))).alias("final_answer"), good(family).alias("family_id"), "reason",
    )


def packed_modes(examples: DataFrame) -> DataFrame:
    """mode_records with tokens and mask as binary, made by NumPy in Arrow batches: record_id, family_id, mode, tokens, mask."""
    each = F.explode(F.array(F.struct(F.lit("direct").alias("mode"), F.lit(None).cast("string").alias("reasoning")), F.struct(F.lit("think").alias("mode"), F.col("reasoning")))).alias("m")
    rows = examples.select("record_id", "family_id", "prompt", "final", each)
    packed = rows.select("record_id", "family_id", "m.mode", K.packed_response(F.col("prompt"), F.col("final"), F.col("m.reasoning")).alias("r"))
    return packed.select("record_id", "family_id", "mode", "r.tokens", "r.mask")


def mode_records(examples: DataFrame) -> DataFrame:
    """Every example (record_id, family_id, prompt, reasoning, final) as a direct and a thinking record: record_id, family_id, mode, tokens, mask."""
    parts = []
    for mode, reasoning in (("direct", F.lit(None).cast("string")), ("think", F.col("reasoning"))):
        tokens, mask = K.response_record(F.col("prompt"), F.col("final"), reasoning)
        parts.append(examples.select("record_id", "family_id", F.lit(mode).alias("mode"), tokens.alias("tokens"), mask.alias("mask")))
    return parts[0].unionByName(parts[1])


def manifest(records: DataFrame) -> DataFrame:
    """split (null: all), is_total, records, families, tokens, targets of records (split, family_id, n_tokens, n_targets). A split without records is an error."""
    table = records.rollup("split").agg(
        F.grouping("split").cast("int").alias("is_total"), F.count(F.lit(1)).alias("records"), F.countDistinct("family_id").alias("families"),
        F.sum("n_tokens").alias("tokens"), F.sum("n_targets").alias("targets"),
    )
    there = {r.split for r in table.where("is_total = 0").select("split").collect()}  # a row for each split
    if missing := set(SPLITS) - there:
        raise GateError(f"splits without records: {sorted(missing)}")
    return table


def placed_records(records: DataFrame) -> DataFrame:
    """records (split, record_id, n_tokens, ...) with offset: where each starts in its split's stream, in record_id order."""
    return running_offset(records, "record_id", F.col("n_tokens"), ["split"])


def union_records(parts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """All parts with the column component; one key in two rows is an error."""
    whole = None
    for name, part in parts:
        part = part.withColumn("component", F.lit(name))
        whole = part if whole is None else whole.unionByName(part)
    demand_none(whole.groupBy(key).count().where("count > 1"), "repeated records")
    return whole


def composed(whole: DataFrame, replay: str) -> DataFrame:
    """split, component_records, tokens, targets, replay_fraction: what a composed corpus consists of, the share of the replay component in its targets."""
    targets = F.sum("n_targets")
    share = F.try_divide(F.sum(F.when(F.col("component") == replay, F.col("n_targets")).otherwise(0)), targets)
    return whole.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.sum("n_tokens").alias("tokens"), targets.alias("targets"), F.round(share, 9).alias("replay_fraction"))


def extended(reference: DataFrame, new: DataFrame, key: str, mark: Column) -> tuple[DataFrame, DataFrame]:
    """The reference with the new training rows, and the check: split, records, digest, unchanged (validation and test stay as they are).

    mark (SHA-256 of a row's bytes) names a row; the digest is that of each split's rows in the order of key.
    """
    whole = reference.unionByName(new.where("split = 'train'"))
    before = stream_digests(reference, "split", key, mark).select("split", F.col("records").alias("_r"), F.col("digest").alias("_d"))
    after = stream_digests(whole, "split", key, mark).join(before, "split", "left")
    same = F.col("records").eqNullSafe(F.col("_r")) & F.col("digest").eqNullSafe(F.col("_d"))
    return whole, after.select("split", "records", "digest", same.alias("unchanged"))


def probed(requests: DataFrame, cache: DataFrame, key: str = "request") -> DataFrame:
    """requests with answer and status: hit (the cache has the key) or miss. One key with several answers in the cache is an error."""
    demand_none(conflicts(cache, key, "answer"), "keys with several answers")
    known = cache.dropDuplicates([key]).select(key, "answer", F.lit(True).alias("_hit"))
    return requests.join(known, key, "left").withColumn("status", F.when(F.col("_hit"), "hit").otherwise("miss")).drop("_hit")


def aligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """n_both, n_left_only, n_right_only of two lists that should go together, by key and never by order."""
    marks = left.select(*keys).withColumn("_l", F.lit(1)).join(right.select(*keys).withColumn("_r", F.lit(1)), keys, "full")
    left_in, right_in = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return marks.agg(F.count_if(left_in & right_in).alias("n_both"), F.count_if(~right_in).alias("n_left_only"), F.count_if(~left_in).alias("n_right_only"))
