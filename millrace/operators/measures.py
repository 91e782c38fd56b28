"""Scores, metric groups, rewards, advantages, audits and gates over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import text as T


def rate(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def scored(rows: DataFrame) -> DataFrame:
    """rows (completion, expected_answer, expected_unit, terminated, special_token_leak) with the parts of their score."""
    text = F.coalesce("completion", F.lit(""))
    rows = rows.withColumn("parsed_answer", T.last_decimal(text)).withColumn("repeated_phrase", T.repeats_phrase(text))
    rows = rows.withColumn("numeric_correct", F.coalesce(F.col("parsed_answer") == T.plain_decimal(F.col("expected_answer")), F.lit(False)))
    rows = rows.withColumn("unit_correct", T.has_unit(text, F.col("expected_unit")))
    fine = (F.trim(text) != "") & F.col("terminated") & ~F.col("special_token_leak") & ~F.col("repeated_phrase") & F.col("parsed_answer").isNotNull()
    rows = rows.withColumn("format_valid", fine)
    return rows.withColumn("task_correct", F.col("numeric_correct") & F.col("unit_correct") & F.col("format_valid"))


def consistent(reasoning: Column, final: Column) -> Column:
    """Whether the last decimals agree; null without reasoning."""
    same = T.last_decimal(reasoning) == T.last_decimal(F.coalesce(final, F.lit("")))
    return F.when(F.trim(reasoning) != "", F.coalesce(same, F.lit(False)))


def metric_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics over all rows and by each key alone (one pass, grouping sets). A null key means: not grouped by it."""
    sums = [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("correct").cast("long")).alias("n_correct"),
        F.sum("generated").alias("n_generated"),
        F.round(rate(F.col("correct")), 9).alias("accuracy"),
        F.round(F.avg("generated"), 9).alias("mean_generated"),
        F.round(F.try_divide(F.sum(F.col("correct").cast("long")) * F.lit(1000.0), F.sum("generated")), 9).alias("correct_per_1000"),
        F.round(rate(F.col("consistent")), 9).alias("consistency"),
        F.countDistinct("final").alias("n_finals"),
    ]
    return rows.groupingSets([[], *[[k] for k in keys]], *keys).agg(*sums)


def most_common(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The most common value of each group with its count; of equals the one that came first."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    line = W.partitionBy(group).orderBy(F.desc("n"), "first")
    return counts.withColumn("r", F.row_number().over(line)).where("r = 1").select(group, value, "n")


def advantages(rows: DataFrame, group: str, reward: str, epsilon: float = 1e-6) -> DataFrame:
    """rows with advantage: the reward standardised within its group, 0 where the group hardly varies.

    The sums of a group are combined on the map side and joined back; no task holds a group.
    """
    sums = rows.groupBy(group).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"))
    joined = rows.join(sums, group)
    return joined.withColumn("advantage", F.when(F.col("_s") <= epsilon, 0.0).otherwise((F.col(reward) - F.col("_m")) / (F.col("_s") + epsilon))).drop("_m", "_s")


def verifier_reward(numeric: Column, unit: Column, fine: Column) -> Column:
    part = lambda flag, worth: F.when(flag, worth).otherwise(0.0)
    return part(numeric, 0.8) + part(numeric & unit, 0.15) + part(fine, 0.05)


def combined_reward(verifier: Column, ai: Column) -> Column:
    return verifier + 0.2 * ai


def direct_reward(fine: Column, ai: Column) -> Column:
    return F.when(fine, ai).otherwise(0.0)


def mixed_groups(rows: DataFrame, group: str, correct: str) -> DataFrame:
    """n_groups, n_mixed, fraction: groups with some but not all rows correct."""
    each = rows.groupBy(group).agg((F.bool_or(correct) & ~F.bool_and(correct)).alias("mixed"))
    return each.agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("mixed").cast("long")).alias("n_mixed"), F.round(rate(F.col("mixed")), 9).alias("fraction"))


def pearson(left: str, right: str) -> Column:
    """The correlation, null with fewer than two rows or without variance."""
    spread = F.stddev_pop(left) * F.stddev_pop(right)
    return F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.covar_pop(left, right), spread))


def reward_audit(rows: DataFrame, ai: str, numeric: str, correct: str) -> DataFrame:
    """One row: where the judge and the checker disagree."""
    high, low = (F.col(ai) >= 0.75) & ~F.col(numeric), (F.col(ai) <= 0.25) & F.col(numeric)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(correct)).alias("n_exact"),
        F.count_if(F.coalesce(high, F.lit(False))).alias("high_ai_wrong"),
        F.count_if(F.coalesce(low, F.lit(False))).alias("low_ai_correct"),
        F.round(F.avg(ai), 9).alias("ai_mean"),
    )


def seed_gate(seeds: DataFrame, base_primary: float, base_challenge: float, trained: DataFrame | None = None, holdout: DataFrame | None = None) -> DataFrame:
    """One row: means and spreads over seeds (primary, challenge, format_rate, mode_rate), and the gates that all must hold.

    holdout, if given: the families of the holdout (family_id), and trained those of the training data; one in both closes the gate.
    """
    both = (F.col("primary") > base_primary) & (F.col("challenge") > base_challenge)
    row = seeds.agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg("primary").alias("primary_mean"),
        F.stddev_pop("primary").alias("primary_std"),
        F.avg("challenge").alias("challenge_mean"),
        F.stddev_pop("challenge").alias("challenge_std"),
        F.count_if(both).alias("n_improving"),
        F.least(F.min("format_rate"), F.min("mode_rate")).alias("least_rate"),
    )
    gate = (F.col("n_seeds") == 3) & (F.col("primary_mean") > base_primary) & (F.col("challenge_mean") > base_challenge) & (F.col("n_improving") >= 2) & (F.col("least_rate") >= 0.95)
    if trained is None or holdout is None:
        return row.withColumn("improved", gate)
    both = trained.select("family_id").distinct().join(holdout.select("family_id").distinct(), "family_id")
    overlap = both.agg(F.count(F.lit(1)).alias("n_overlap"))  # one row
    return row.withColumn("improved", gate).join(overlap).withColumn("improved", F.col("improved") & (F.col("n_overlap") == 0))


# The largest error and root mean square of a probe.
MOST_ERROR, MOST_RMSE = 2e-4, 5e-5


def probe_gate(reference: Column, candidate: Column, reference_best: Column, candidate_best: Column, most_error: float = MOST_ERROR, most_rmse: float = MOST_RMSE) -> list[Column]:
    """max_error, rmse, same_best, passed of two arrays of logits and of the tokens chosen greedily from them; arrays of different lengths are an error."""
    gap = F.when(F.size(reference) == F.size(candidate), F.zip_with(reference, candidate, lambda a, b: a - b)).otherwise(F.raise_error(F.lit("logits of different lengths")).cast("array<double>"))
    top = F.array_max(F.transform(gap, F.abs))
    rmse = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) / F.size(reference))
    same = reference_best.eqNullSafe(candidate_best)
    return [top.alias("max_error"), rmse.alias("rmse"), same.alias("same_best"), ((top <= most_error) & (rmse <= most_rmse) & same).alias("passed")]


def answer_reason(rows: DataFrame) -> DataFrame:
    """rows (task, prompt, expected_answer, expected_unit, final_answer, unit, answer_text) with reason: the first check that an external answer fails, or verified."""
    from millrace.sources.readers import first_reason

    maths = T.squeeze(T.ascii_maths(F.col("answer_text")))
    rows = rows.withColumn("_t", F.coalesce(maths, F.lit(""))).withColumn("_e", T.plain_decimal(F.col("expected_answer"))).withColumn("_f", T.plain_decimal(F.trim("final_answer")))
    rules = [
        ("invalid_final_answer", F.col("_e").isNull() | F.col("_f").isNull()),
        ("final_answer_mismatch", F.col("_e") != F.col("_f")),
        ("unexpected_unit", (F.col("task") == "arithmetic") & F.col("unit").isNotNull()),
        ("unit_mismatch", (F.col("task") != "arithmetic") & ~F.col("unit").eqNullSafe(F.col("expected_unit"))),
        ("non_ascii_or_empty_answer", (F.col("_t") == "") | F.col("_t").rlike(r"[^\x00-\x7F]")),
        ("role_token_leak", T.leaks_special(F.col("_t"))),
        ("final_answer_missing_from_text", ~F.contains(F.col("_t"), F.col("final_answer"))),
        ("unit_missing_from_text", ~F.contains(F.col("_t"), F.col("expected_unit"))),
        ("conversation_exceeds_context_or_is_invalid", (F.octet_length("prompt") + F.octet_length("_t") + 4 > 256) | (F.coalesce(F.trim("prompt"), F.lit("")) == "")),
    ]
    return rows.withColumn("reason", first_reason(rules, "verified")).drop("_t", "_e", "_f")


def learning_rate(step: Column, highest: float, lowest: float, warm: int, last: int) -> Column:
    """Linear warm-up, then a cosine down to the lowest."""
    share = (step - warm) / (last - warm)
    falling = lowest + 0.5 * (1 + F.cos(F.pi() * share)) * (highest - lowest)
    return F.when(step <= warm, highest * step / warm).when(step >= last, F.lit(lowest)).otherwise(falling)


def alibi_slope(head: Column, heads: int) -> Column:
    """The slope of a head (from 0): powers for the nearest power of two, then every other one of twice as many."""
    near = 1 << (heads.bit_length() - 1)
    own = F.pow(F.lit(2.0), -8.0 * (head + 1) / near)
    extra = F.pow(F.lit(2.0), -4.0 * (2 * (head - near) + 1) / near)
    return F.when(head < near, own).otherwise(extra)


def kv_cache_bytes(layers: Column, context: Column, heads: int, width: int, bytes_each: int) -> Column:
    """Keys and values of every layer, position and head."""
    return 2 * layers * context * heads * width * bytes_each


def parameters(layers: Column, context: Column, width: int, tokens: int) -> Column:
    """Weights of a decoder with a fourfold feed-forward part, biases and two norms a layer, and the embeddings."""
    return layers * (12 * width * width + 13 * width) + tokens * width + context * width
