"""Queries over results, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import evaluation as V
from millrace.operators import measures as M
from millrace.plans.registry import as_long, query, table

# Results made of events: prompts, reasonings and finals with numbers that sometimes agree.
_COMPLETIONS_SQL = """c AS (SELECT event_id AS ordinal, user_id % 4 AS slice, CASE WHEN event_id % 50 <> 7 THEN event_type END AS task, CASE WHEN event_id % 2 = 0 THEN 'think' ELSE 'direct' END AS mode,
      event_id % 9 AS p, event_id % 7 AS r, event_id % 5 AS f, CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN 'so ' || (event_id % 7) ELSE '' END AS reasoning, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'it is ' || (event_id % 5) || ' N' END AS final,
      event_id % 2 = 0 AND event_id % 8 <> 0 AS final_transition, event_id % 11 <> 0 AS terminated, event_id % 17 = 0 AS leak, event_id % 6 AS expected, CASE WHEN event_id % 4 = 1 THEN 'm' ELSE 'N' END AS unit,
      event_id % 97 AS n_generated, event_id % 31 AS n_reasoning, event_id % 11 AS n_final, event_id % 19 = 0 AS budget, event_id % 23 = 0 AS context FROM events),
    m AS (SELECT *, NOT leak AND ((mode = 'direct' AND final <> '' AND NOT final_transition) OR (mode = 'think' AND reasoning <> '' AND final_transition AND final <> '')) AS compliant FROM c),
    s AS (SELECT *, final <> '' AND f = expected AS numeric_ok, contains(final, unit) AS unit_ok, final <> '' AND terminated AND compliant AND NOT leak AS fine FROM m),
    t AS (SELECT *, numeric_ok AND unit_ok AND fine AND compliant AS correct FROM s)"""


def _completions(spark, d) -> DataFrame:
    k = F.col("event_id")
    think = k % 2 == 0
    return V.mode_scored(table(spark, d, "events").select(
        k.alias("ordinal"), (F.col("user_id") % 4).alias("slice"), F.when(k % 50 != 7, F.col("event_type")).alias("task"), F.when(think, "think").otherwise("direct").alias("mode"),
        F.concat(F.lit("What of "), k % 9, F.lit("?")).alias("prompt"), F.when(think & (k % 3 != 0), F.concat(F.lit("so "), k % 7)).otherwise("").alias("reasoning_text"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("it is "), k % 5, F.lit(" N"))).alias("final_text"), (think & (k % 8 != 0)).alias("final_transition"), (k % 11 != 0).alias("terminated"),
        (k % 17 == 0).alias("special_token_leak"), (k % 6).cast("string").alias("expected_answer"), F.when(k % 4 == 1, "m").otherwise("N").alias("expected_unit"), as_long(k % 97).alias("n_generated"),
        as_long(k % 31).alias("n_reasoning"), as_long(k % 11).alias("n_final"), (k % 19 == 0).alias("budget_exhausted"), (k % 23 == 0).alias("context_exhausted"),
    ))


@query(f"WITH {_COMPLETIONS_SQL} SELECT ordinal, compliant AS mode_compliant, numeric_ok AS numeric_correct, unit_ok AS unit_correct, fine AS format_valid, correct AS task_correct FROM t")
def mode_scores(spark, d):
    """Every completion against the grammar of its mode and the expected answer."""
    return _completions(spark, d).select("ordinal", "mode_compliant", "numeric_correct", "unit_correct", "format_valid", "task_correct")


def _rate(expression: str, name: str) -> str:
    return f"round(avg(CAST({expression} AS INTEGER)), 9) AS {name}"


@query(
    f"""WITH {_COMPLETIONS_SQL}, g AS (SELECT CASE WHEN grouping(slice) = 0 THEN 'slice' WHEN grouping(task) = 0 THEN 'task' ELSE 'all' END AS "group", slice, task, count(*) AS count, CAST(sum(CAST(correct AS BIGINT)) AS BIGINT) AS correct,
      CAST(sum(n_generated) AS BIGINT) AS generated_tokens, round(sum(CAST(correct AS BIGINT)) * 1000.0 / CAST(nullif(sum(n_generated), 0) AS DOUBLE), 9) AS correct_per_1000, {_rate("budget", "budget_truncation_rate")}, {_rate("context", "context_truncation_rate")},
      {_rate("final_transition", "final_transition_rate")}, {_rate("fine", "format_valid_rate")}, {_rate("compliant", "mode_compliance_rate")}, {_rate("leak", "role_leak_rate")},
      {_rate("(reasoning <> '' AND p = r) OR (final <> '' AND p = f)", "prompt_number_use_rate")}, {_rate("numeric_ok", "numeric_accuracy")}, {_rate("correct", "task_accuracy")}, {_rate("unit_ok", "unit_accuracy")},
      {_rate("CASE WHEN reasoning <> '' THEN final <> '' AND r = f END", "consistency_rate")}, round(avg(n_final), 9) AS mean_final_tokens, round(avg(n_reasoning), 9) AS mean_reasoning_tokens, count(DISTINCT final) AS unique_finals
      FROM t GROUP BY GROUPING SETS ((), (slice), (task))),
    n AS (SELECT 'all' AS g, NULL AS slice, NULL AS task, final, count(*) AS n, min(ordinal) AS o FROM t GROUP BY final UNION ALL SELECT 'slice', slice, NULL, final, count(*), min(ordinal) FROM t GROUP BY slice, final
      UNION ALL SELECT 'task', NULL, task, final, count(*), min(ordinal) FROM t GROUP BY task, final),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, slice, task ORDER BY n DESC, o) AS k FROM n) WHERE k = 1)
    SELECT g.*, f.final AS common_final, f.n AS common_count, round(f.n / CAST(g.count AS DOUBLE), 9) AS common_rate FROM g JOIN f ON g."group" = f.g AND g.slice IS NOT DISTINCT FROM f.slice AND g.task IS NOT DISTINCT FROM f.task"""
)
def challenge_metrics(spark, d):
    """All measures of a run, over all rows, by slice and by task (some rows have no task, which is a group of its own)."""
    return V.group_metrics(_completions(spark, d), ["slice", "task"])


@query(
    f"""WITH {_COMPLETIONS_SQL} SELECT ordinal, CASE WHEN mode = 'think' THEN '<THINK>' || reasoning || '<FINAL>' || final WHEN final = '' THEN '<EMPTY>' ELSE final END || chr(10) || 'STATUS terminated=' || terminated || ' special_token_leak=' || leak
    || ' budget_exhausted=' || budget || ' context_exhausted=' || context || CASE WHEN leak THEN ' leaked_token=<USER>' ELSE '' END AS rendered FROM t"""
)
def judge_transcript(spark, d):
    rows = _completions(spark, d)
    leaked = F.when(F.col("special_token_leak"), "<USER>")
    return rows.select("ordinal", V.transcript(F.col("mode"), F.col("reasoning_text"), F.col("final_text"), ["terminated", "special_token_leak", "budget_exhausted", "context_exhausted"], leaked).alias("rendered"))


@query(
    """SELECT event_type AS task, CAST(sum(event_id % 97) AS BIGINT) AS n_tokens, round(sum(event_id % 97) / CAST(nullif(sum(CASE WHEN event_type = 'view' THEN 0 ELSE value / 10 END), 0) AS DOUBLE), 6) AS tokens_per_second,
    round(sum(value * (event_id % 10)) / nullif(sum(event_id % 10), 0), 6) AS weighted FROM events GROUP BY 1"""
)
def throughput(spark, d):
    """Tokens in a second by task (null where no time is told), and a weighted mean."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("task"), as_long(F.col("event_id") % 97).alias("n"), F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value") / 10).alias("seconds"), "value", (F.col("event_id") % 10).alias("weight"))
    return rows.groupBy("task").agg(F.sum("n").alias("n_tokens"), F.round(V.throughput("n", "seconds"), 6).alias("tokens_per_second"), F.round(V.weighted_mean("value", "weight"), 6).alias("weighted"))


@query(
    f"""WITH {_COMPLETIONS_SQL}, m2 AS (SELECT slice, mode, count(*) AS n, avg(CAST(correct AS INTEGER)) AS a, avg(CAST(fine AS INTEGER)) AS f FROM t GROUP BY ALL)
    SELECT slice, CAST(sum(n) AS BIGINT) AS examples, CAST(round(sum(a * n)) AS BIGINT) AS correct, true AS exact, round(sum(f * n) / sum(n), 9) AS format_rate, round(round(sum(a * n)) / sum(n), 9) AS accuracy FROM m2 GROUP BY slice"""
)
def combined_modes(spark, d):
    """Rates of both modes put together, with the exact count found again in them."""
    rows = _completions(spark, d).groupBy("slice", "mode").agg(F.count(F.lit(1)).alias("n"), M.rate(F.col("task_correct")).alias("accuracy"), M.rate(F.col("format_valid")).alias("format_rate"))
    return V.combined_modes(rows, "slice")


@query(
    """WITH r AS (SELECT l_partkey % 512 AS position, l_discount * 10 + l_tax AS loss, l_linenumber <> 2 AS ok FROM lineitem),
    s AS (SELECT CASE WHEN position < 256 THEN 'before' ELSE 'after' END AS bucket, count(*) FILTER (ok) AS n, CAST(sum(loss) FILTER (ok) AS DOUBLE) AS s FROM r GROUP BY 1)
    SELECT bucket, n AS eligible_targets, round(s, 6) AS loss_sum, round(s / n, 9) AS loss, round(s / n / ln(2), 9) AS bits_per_token, round(exp(s / n), 9) AS perplexity FROM s"""
)
def position_losses(spark, d):
    loss = F.col("l_discount").cast("double") * 10 + F.col("l_tax").cast("double")
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 512).alias("position"), loss.alias("loss"), (F.col("l_linenumber") != 2).alias("eligible"))
    return V.position_losses(rows, 256)


@query(
    """WITH g AS (SELECT event_type, user_id, count(*) AS n, count(*) FILTER (value > 50) AS c, count(*) FILTER (NOT (value > 10 AND event_id % 9 <> 0)) AS i FROM events GROUP BY ALL),
    e AS (SELECT event_type AS candidate, CAST(sum(n) AS BIGINT) AS completions, round(sum(c) / CAST(sum(n) AS DOUBLE), 9) AS exact_rate, round(sum(i) / CAST(sum(n) AS DOUBLE), 9) AS invalid_rate, round(avg(CAST(c > 0 AND c < n AS INTEGER)), 9) AS mixed_fraction FROM g GROUP BY 1)
    SELECT *, row_number() OVER (ORDER BY mixed_fraction DESC, exact_rate DESC, invalid_rate, candidate DESC) = 1 AS chosen FROM e"""
)
def start_choice(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("candidate"), F.col("user_id").alias("schedule"), (F.col("value") > 50).alias("task_correct"), (F.col("value") > 10).alias("format_valid"), (F.col("event_id") % 9 != 0).alias("mode_compliant"))
    return V.start_choice(rows, "candidate", "schedule")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS score, l_linenumber = 1 AS preferred, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top FROM lineitem)
    SELECT count(*) AS n_requests, count(*) FILTER (score = top) AS n_consistent, round(avg(CAST(score AS DOUBLE) / 50), 9) AS mean_score FROM r WHERE preferred"""
)
def preferred_scores(spark, d):
    """How often the preferred candidate has the largest score of its request, and the mean of scaled scores."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("score"), (F.col("l_linenumber") == 1).alias("preferred"))
    best = V.preferred_is_best(rows, "l_orderkey").where("preferred")
    return best.agg(F.count(F.lit(1)).alias("n_requests"), F.count_if("is_best").alias("n_consistent"), F.round(F.avg(F.col("score") / 50), 9).alias("mean_score"))


@query(
    """WITH g AS (SELECT user_id, stddev_pop(floor(value / 50)) AS s, count(*) FILTER (event_id % 3 = 0) AS h, sum(1 + event_id % 2) AS a FROM events GROUP BY user_id)
    SELECT count(*) AS n_groups, count(*) FILTER (s <= 1e-6) AS n_flat_groups, CAST(sum(h) AS BIGINT) AS cache_hits, CAST(sum(a) AS BIGINT) AS attempts FROM g"""
)
def audit_groups(spark, d):
    rows = table(spark, d, "events").select("user_id", F.floor(F.col("value") / 50).cast("double").alias("reward"), (F.col("event_id") % 3 == 0).alias("cached"), as_long(1 + F.col("event_id") % 2).alias("attempts"))
    return V.audit_groups(rows, "user_id", "reward", "cached", "attempts")


@query(
    """SELECT l_returnflag AS provider, CAST(sum(l_partkey % 100) AS BIGINT) AS prompt_tokens, CAST(sum(l_suppkey % 50) AS BIGINT) AS completion_tokens, CAST(sum(l_partkey % 100 + l_suppkey % 50) AS BIGINT) AS total_tokens,
    count(*) FILTER (l_linenumber < 5) AS accepted, count(*) AS n_rows FROM lineitem GROUP BY 1"""
)
def usage_totals(spark, d):
    prompt, completion = as_long(F.col("l_partkey") % 100), as_long(F.col("l_suppkey") % 50)
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("provider")).agg(
        F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"), F.sum(prompt + completion).alias("total_tokens"), F.count_if(F.col("l_linenumber") < 5).alias("accepted"), F.count(F.lit(1)).alias("n_rows")
    )


@query(
    """SELECT c.role, max(octet_length(encode(coalesce(c.text, '')))) AS longest, round(avg(octet_length(encode(coalesce(c.text, '')))), 6) AS mean_bytes FROM conversations c GROUP BY c.role"""
)
def reasoning_length(spark, d):
    size = as_long(F.octet_length(F.coalesce("text", F.lit(""))))
    return table(spark, d, "conversations").groupBy("role").agg(F.max(size).alias("longest"), F.round(F.avg(size), 6).alias("mean_bytes"))


@query(
    """WITH r AS (SELECT CASE WHEN value > 50 THEN 0.8 ELSE 0 END AS a, CASE WHEN value > 50 AND event_id % 3 = 0 THEN 0.15 ELSE 0 END AS b, CASE WHEN event_id % 4 <> 0 THEN 0.05 ELSE 0 END AS c FROM events)
    SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_wrong, round(CAST(sum(a + b + c) AS DOUBLE), 6) AS total FROM r"""
)
def component_check(spark, d):
    """The parts of every verifier reward add up to it."""
    flags = [F.col("value") > 50, F.col("event_id") % 3 == 0, F.col("event_id") % 4 != 0]
    part = lambda flag, worth: F.when(flag, worth).otherwise(0.0)
    parts = part(flags[0], 0.8) + part(flags[0] & flags[1], 0.15) + part(flags[2], 0.05)
    rows = table(spark, d, "events").select(M.verifier_reward(*flags).alias("total"), parts.alias("parts"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("total") - F.col("parts")) > 1e-9).alias("n_wrong"), F.round(F.sum("total"), 6).alias("total"))


@query(
    """SELECT p_partkey, CAST(l AS BIGINT) AS layers, CAST(c AS BIGINT) AS context, CAST(2 * l * c * 4 * 32 * 2 AS BIGINT) AS kv_bytes, CAST(l * (12 * 128 * 128 + 13 * 128) + 264 * 128 + c * 128 AS BIGINT) AS parameters
    FROM (SELECT p_partkey, 2 + p_size % 6 AS l, 256 << CAST(p_partkey % 4 AS INTEGER) AS c FROM part)"""
)
def model_budget(spark, d):
    """Bytes of the key-value cache and number of parameters of models whose layers and context lengths the parts name (heads 4 of 32, width 128, two bytes)."""
    rows = table(spark, d, "part").select("p_partkey", as_long(2 + F.col("p_size") % 6).alias("layers"), F.expr("shiftleft(256L, CAST(p_partkey % 4 AS INT))").alias("context"))
    cache, weights = M.kv_cache_bytes(F.col("layers"), F.col("context"), 4, 32, 2), M.parameters(F.col("layers"), F.col("context"), 128, 264)
    return rows.select("p_partkey", "layers", "context", as_long(cache).alias("kv_bytes"), as_long(weights).alias("parameters"))
