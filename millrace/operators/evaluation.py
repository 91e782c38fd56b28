"""Evaluation of completions: mode grammar, full metric groups, losses by position, combining modes, judges, choice of a start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import text as T
from millrace.operators.measures import consistent, rate, scored
from millrace.sources.readers import first_reason


def mode_scored(rows: DataFrame) -> DataFrame:
    """rows (mode, reasoning_text, final_text, final_transition, terminated, special_token_leak, expected_answer, expected_unit) with the parts of their score.

    A direct answer has a final text and no transition; a thinking one has reasoning, the transition and
    a final text; neither leaks a special token. Only a compliant answer counts as terminated and correct.
    """
    there = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    direct = (F.col("mode") == "direct") & there("final_text") & ~F.col("final_transition")
    think = (F.col("mode") == "think") & there("reasoning_text") & F.col("final_transition") & there("final_text")
    rows = rows.withColumn("mode_compliant", ~F.col("special_token_leak") & (direct | think)).withColumn("_t", F.col("terminated"))
    rows = scored(rows.withColumn("completion", F.col("final_text")).withColumn("terminated", F.col("_t") & F.col("mode_compliant")))
    return rows.withColumn("task_correct", F.col("task_correct") & F.col("mode_compliant")).withColumn("terminated", F.col("_t")).drop("_t", "completion")


def uses_prompt_number(prompt: Column, reasoning: Column, final: Column) -> Column:
    """Whether a number of the prompt stands in the reasoning or in the final text."""
    return F.arrays_overlap(T.numbers(prompt), F.array_union(T.numbers(reasoning), T.numbers(final)))


def group_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All measures over all rows and by each key alone: group ("all" or the key's name), the keys, and the measures.

    rows: what mode_scored gives, with prompt, n_generated, n_reasoning, n_final, budget_exhausted,
    context_exhausted and ordinal (of equally common finals the first counts).
    """
    marked = rows.select(
        *keys, "budget_exhausted", "context_exhausted", "final_transition", "format_valid", "mode_compliant", "numeric_correct", "special_token_leak", "task_correct", "unit_correct",
        "n_generated", "n_reasoning", "n_final", "ordinal", F.coalesce("final_text", F.lit("")).alias("final"), consistent(F.col("reasoning_text"), F.col("final_text")).alias("agrees"),
        uses_prompt_number(F.col("prompt"), F.col("reasoning_text"), F.col("final_text")).alias("uses_number"),
    )
    # grouping_id tells a null key in the data from a key that is not grouped by.
    names = F.element_at(F.array(F.lit("all"), *map(F.lit, keys)), F.lit(1) + sum(((1 - F.grouping(k)) * (i + 1) for i, k in enumerate(keys)), F.lit(0)).cast("int"))
    correct = F.sum(F.col("task_correct").cast("long"))
    r9 = lambda c: F.round(c, 9)
    sets = [[], *[[k] for k in keys]]
    sums = marked.groupingSets(sets, *keys).agg(
        names.alias("group"),
        F.count(F.lit(1)).alias("count"),
        correct.alias("correct"),
        F.sum("n_generated").alias("generated_tokens"),
        r9(F.try_divide(correct * F.lit(1000.0), F.sum("n_generated"))).alias("correct_per_1000"),
        *[r9(rate(F.col(c))).alias(f"{n}_rate") for c, n in (("budget_exhausted", "budget_truncation"), ("context_exhausted", "context_truncation"), ("final_transition", "final_transition"))],
        *[r9(rate(F.col(c))).alias(f"{n}_rate") for c, n in (("format_valid", "format_valid"), ("mode_compliant", "mode_compliance"), ("special_token_leak", "role_leak"), ("uses_number", "prompt_number_use"))],
        *[r9(rate(F.col(c))).alias(n) for c, n in (("numeric_correct", "numeric_accuracy"), ("task_correct", "task_accuracy"), ("unit_correct", "unit_accuracy"), ("agrees", "consistency_rate"))],
        r9(F.avg("n_final")).alias("mean_final_tokens"),
        r9(F.avg("n_reasoning")).alias("mean_reasoning_tokens"),
        F.countDistinct("final").alias("unique_finals"),
    )
    # The most common final: counted by (group, final) first, so a group's finals never meet in one task.
    each = marked.groupingSets([[*s, "final"] for s in sets], *keys, "final").agg(names.alias("group"), F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    top = each.groupBy("group", *keys).agg(F.max_by(F.struct("final", "n"), F.struct("n", -F.col("first"))).alias("t"))
    same = F.lit(True)
    for c in ["group", *keys]:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = sums.alias("a").join(top.alias("b"), same)
    return joined.select("a.*", F.col("t.final").alias("common_final"), F.col("t.n").alias("common_count"), r9(F.col("t.n") / F.col("a.count")).alias("common_rate"))


def throughput(tokens: str, seconds: str) -> Column:
    """Tokens in a second over all rows; null without time."""
    return F.try_divide(F.sum(tokens).cast("double"), F.sum(seconds))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def combined_modes(rows: DataFrame, group: str) -> DataFrame:
    """From rates by mode (group, mode, n, accuracy, format_rate) to one row for each group; an accuracy that encodes no whole count is null in exact."""
    count = F.col("accuracy") * F.col("n")
    rows = rows.withColumn("_c", F.round(count)).withColumn("_ok", F.abs(count - F.round(count)) <= 1e-8)
    found = rows.groupBy(group).agg(F.sum("n").alias("examples"), F.sum("_c").cast("long").alias("_correct"), F.bool_and("_ok").alias("exact"), F.round(weighted_mean("format_rate", "n"), 9).alias("format_rate"))
    correct = F.when(F.col("exact"), F.col("_correct"))
    return found.select(group, "examples", correct.alias("correct"), "exact", "format_rate", F.round(F.try_divide(correct.cast("double"), F.col("examples")), 9).alias("accuracy"))


def loss_measures(loss_sum: Column, targets: Column) -> list[Column]:
    """loss, bits_per_token and perplexity of a sum of losses; null without targets."""
    loss = F.try_divide(loss_sum, targets)
    return [F.round(loss, 9).alias("loss"), F.round(loss / F.log(F.lit(2.0)), 9).alias("bits_per_token"), F.round(F.exp(loss), 9).alias("perplexity")]


def position_losses(rows: DataFrame, boundary: int) -> DataFrame:
    """bucket (before, after the boundary), eligible_targets, loss_sum, loss, bits_per_token, perplexity of rows (position, loss, eligible)."""
    found = rows.groupBy(F.when(F.col("position") < boundary, "before").otherwise("after").alias("bucket")).agg(
        F.count_if("eligible").alias("eligible_targets"), F.coalesce(F.sum(F.when(F.col("eligible"), F.col("loss"))), F.lit(0.0)).alias("s")
    )
    return found.select("bucket", "eligible_targets", F.round("s", 6).alias("loss_sum"), *loss_measures(F.col("s"), F.col("eligible_targets")))


def judged(rows: DataFrame) -> DataFrame:
    """rows (request, candidates, response) with scores (map of candidate to score / 4), preferred and reason.

    A response is {"preferred", "scores"} with exactly these keys; scores is a list of {candidate_id,
    score} or an object; its candidates are those that were asked about; scores are 0 to 4; the
    preferred candidate has the largest.
    """
    listed = F.from_json("response", "preferred string, scores array<struct<candidate_id: string, score: int>>")["scores"]
    mapped = F.from_json("response", "preferred string, scores map<string, int>")["scores"]
    kind = F.substring(F.ltrim(F.get_json_object("response", "$.scores")), 1, 1)
    pairs = F.when(kind == "[", listed).when(kind == "{", F.transform(F.map_entries(mapped), lambda e: F.struct(e["key"].alias("candidate_id"), e["value"].alias("score"))))
    rows = rows.withColumns({"_keys": F.json_object_keys("response"), "_pairs": pairs, "preferred": F.get_json_object("response", "$.preferred")})
    score = F.col("_pairs.score")
    best = F.filter("_pairs", lambda p: p["candidate_id"] == F.col("preferred"))
    rules = [
        ("invalid_json", F.col("_keys").isNull()),
        ("keys", ~F.array_sort("_keys").eqNullSafe(F.array(F.lit("preferred"), F.lit("scores"))) | F.col("_pairs").isNull()),
        ("candidates", ~F.array_sort("_pairs.candidate_id").eqNullSafe(F.array_sort("candidates"))),
        ("score_range", ~F.forall(score, lambda s: F.coalesce(s.between(0, 4), F.lit(False)))),
        ("preferred", ~F.coalesce(F.try_element_at(best, F.lit(1))["score"] == F.array_max(score), F.lit(False))),
    ]
    scores = F.map_from_entries(F.transform("_pairs", lambda p: F.struct(p["candidate_id"], p["score"] / 4)))
    reason = first_reason(rules)
    return rows.withColumn("reason", reason).withColumn("scores", F.when(F.col("reason") == "accepted", scores)).drop("_keys", "_pairs")


def transcript(mode: Column, reasoning: Column, final: Column, flags: list[str], leaked: Column) -> Column:
    """What a judge sees: the answer with its marks, or <EMPTY>, and a line of states. flags: names of boolean columns."""
    body = F.when(mode == "think", F.concat(F.lit("<THINK>"), reasoning, F.lit("<FINAL>"), final)).otherwise(final)
    states = F.concat_ws(" ", F.lit("STATUS"), *[F.concat(F.lit(f"{f}="), F.coalesce(F.col(f), F.lit(False)).cast("string")) for f in flags], F.concat(F.lit("leaked_token="), leaked))
    return F.concat(F.when(body == "", "<EMPTY>").otherwise(body), F.lit("\n"), states)


def start_choice(rows: DataFrame, candidate: str, group: str) -> DataFrame:
    """The measures of each candidate and whether it is chosen: the largest share of mixed groups, then of correct rows, then the smallest share of invalid ones, then the larger name.

    rows: candidate, group, task_correct, format_valid, mode_compliant. Groups are summed first, so a
    candidate's rows never meet in one task.
    """
    valid = F.col("format_valid") & F.col("mode_compliant")
    groups = rows.groupBy(candidate, group).agg(F.count(F.lit(1)).alias("n"), F.count_if("task_correct").alias("c"), F.count_if(~valid).alias("i"))
    mixed = (F.col("c") > 0) & (F.col("c") < F.col("n"))
    each = groups.groupBy(candidate).agg(
        F.sum("n").alias("completions"), F.round(F.sum("c") / F.sum("n"), 9).alias("exact_rate"), F.round(F.sum("i") / F.sum("n"), 9).alias("invalid_rate"), F.round(F.avg(mixed.cast("int")), 9).alias("mixed_fraction")
    )
    best = each.agg(F.max_by(candidate, F.struct("mixed_fraction", "exact_rate", -F.col("invalid_rate"), candidate)).alias("_best"))  # one row
    return each.join(F.broadcast(best)).withColumn("chosen", F.col(candidate) == F.col("_best")).drop("_best")


def preferred_is_best(rows: DataFrame, request: str) -> DataFrame:
    """rows (request, score, preferred) with is_best: whether the score is the largest of its request."""
    return rows.withColumn("is_best", F.col("score") == F.max("score").over(W.partitionBy(request)))


def audit_groups(rows: DataFrame, group: str, reward: str, cached: str, attempts: str) -> DataFrame:
    """One row: groups, groups without variance, cache hits and attempts."""
    each = rows.groupBy(group).agg(F.stddev_pop(reward).alias("s"), F.count_if(F.col(cached)).alias("h"), F.sum(attempts).alias("a"))
    return each.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("s") <= 1e-6).alias("n_flat_groups"), F.sum("h").alias("cache_hits"), F.sum("a").alias("attempts"))
