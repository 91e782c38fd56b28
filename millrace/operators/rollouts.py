"""Generated tokens: what they say, how they are padded for training, and their losses, within arrays and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.tokens import EOS, FINAL, PAD


def split_generated(rows: DataFrame, block: int, most_new: int) -> DataFrame:
    """rows (mode, n_prompt, generated: array<int>) with reasoning, final (bytes as arrays), and how the generation ended.

    It ends at the end token, at a special token (in thinking mode the first FINAL token turns to the
    final part instead), when the context is full, or when the budget is used. What stands behind the
    end is not seen. The places are found by searching the array, so no token is walked through.
    """
    g, think = F.col("generated"), F.col("mode") == "think"
    at = lambda values, rule: F.coalesce(F.try_element_at(F.filter(F.transform(values, lambda x, i: F.when(rule(x, i), i + 1)), lambda x: x.isNotNull()), F.lit(1)), F.lit(1 << 30))
    # Place (from 1) of the first FINAL token, of the first end token, of the first other special token.
    rows = rows.withColumn("_turn", F.when(think, at(g, lambda x, i: x == FINAL)).otherwise(F.lit(1 << 30)))
    rows = rows.withColumn("_end", at(g, lambda x, i: x == EOS)).withColumn("_leak", at(g, lambda x, i: (x > 255) & (x != EOS) & (i + 1 != F.col("_turn"))))
    room = F.lit(block + 1) - F.col("n_prompt")
    stop = F.least("_end", "_leak", room, F.lit(most_new), F.size(g))
    rows = rows.withColumn("_stop", stop).withColumn("_seen", F.slice(g, 1, F.greatest(F.col("_stop"), F.lit(0))))
    reached = lambda c: F.col(c) <= F.col("_stop")
    rows = rows.withColumns({"terminated": reached("_end"), "special_token_leak": reached("_leak"), "final_transition": reached("_turn"), "n_generated": F.size("_seen")})
    rows = rows.withColumn("leaked_token", F.when(F.col("special_token_leak"), F.try_element_at(g, F.col("_leak"))))
    active = ~F.col("terminated") & ~F.col("special_token_leak")
    rows = rows.withColumn("context_exhausted", active & (F.col("n_prompt") + F.col("n_generated") > block))
    rows = rows.withColumn("budget_exhausted", active & ~F.col("context_exhausted") & (F.col("n_generated") == most_new))
    plain = lambda first: F.filter(F.col("_seen"), lambda x, i: (x < 256) & ((i + 1 < F.col("_turn")) if first else (i + 1 > F.col("_turn"))))
    none = F.array().cast("array<int>")
    final = F.when(think, plain(False)).otherwise(F.filter("_seen", lambda x: x < 256))
    return rows.withColumn("reasoning", F.when(think, plain(True)).otherwise(none)).withColumn("final", final).drop("_turn", "_end", "_leak", "_stop", "_seen")


def collated(rows: DataFrame, batch: str) -> DataFrame:
    """Trajectories (batch, prompt, generated, log_probs) as padded rows: input_ids, target_ids, mask, old_log_probs, all as long as the longest of their batch."""
    whole = F.concat("prompt", "generated")
    rows = rows.withColumn("_n", F.size("prompt") + F.size("generated") - 1)
    longest = rows.groupBy(batch).agg(F.max("_n").alias("_most"))
    rows = rows.join(longest, batch)
    pad = lambda c, n, value: F.concat(c, F.array_repeat(value, n))
    before, behind = F.size("prompt") - 1, F.col("_most") - F.col("_n")
    ones = F.array_repeat(F.lit(1), F.size("generated"))
    return rows.withColumns({
        "input_ids": pad(F.slice(whole, 1, F.col("_n")), behind, F.lit(PAD)),
        "target_ids": pad(F.slice(whole, 2, F.col("_n")), behind, F.lit(PAD)),
        "mask": pad(F.concat(F.array_repeat(F.lit(0), before), ones), behind, F.lit(0)),
        "old_log_probs": pad(F.concat(F.array_repeat(F.lit(0.0), before), "log_probs"), behind, F.lit(0.0)),
    }).drop("_n", "_most")


def policy_loss(tokens: DataFrame, groups: list[str], clip: float, beta: float) -> DataFrame:
    """Clipped surrogate with a sampled divergence from the reference, over tokens (current, old, reference log probabilities, advantage) that are generated."""
    delta = F.col("reference") - F.col("current")
    rows = tokens.withColumns({"_r": F.exp(F.col("current") - F.col("old")), "_kl": F.exp(delta) - delta - 1})
    limited = F.least(F.greatest(F.col("_r"), F.lit(1 - clip)), F.lit(1 + clip))
    rows = rows.withColumn("_s", F.least(F.col("_r") * F.col("advantage"), limited * F.col("advantage")))
    r6 = lambda c: F.round(c, 6)
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("generated_tokens"),
        r6(-F.avg(F.col("_s") - beta * F.col("_kl"))).alias("loss"),
        r6(F.avg("_s")).alias("surrogate"),
        r6(F.avg("_r")).alias("mean_ratio"),
        r6(F.avg((F.abs(F.col("_r") - 1) > clip).cast("int"))).alias("clip_fraction"),
        r6(F.avg("_kl")).alias("reference_kl"),
        r6(F.avg(F.col("old") - F.col("current"))).alias("behavior_kl"),
    )


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Log probabilities of logits, with the largest subtracted first."""
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.exp(x))
    shifted = once(F.array_max(logits), lambda top: F.transform(logits, lambda x: (x - top) / temperature))
    return once(shifted, lambda c: once(F.log(total(c)), lambda z: F.transform(c, lambda x: x - z)))


def boundary_weighted(loss: Column, target: Column, eligible: Column, weight: float) -> Column:
    """The mean loss of eligible targets, in which FINAL and end tokens weigh more."""
    w = F.when(eligible, F.when(target.isin(FINAL, EOS), weight).otherwise(1.0)).otherwise(0.0)
    return F.try_divide(F.sum(loss * w), F.sum(w))


def distillation(student: Column, teacher: Column, temperature: float) -> Column:
    """KL of the teacher's distribution from the student's at a temperature, times its square."""
    s, t = log_softmax(student, temperature), log_softmax(teacher, temperature)
    return F.aggregate(F.zip_with(t, s, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda x, y: x + y) * temperature**2
