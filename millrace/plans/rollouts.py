"""Queries over generated tokens, losses and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import quantise as Q
from millrace.operators import rollouts as R
from millrace.operators import tokens as K
from millrace.plans.catalog import _quantised_sql
from millrace.plans.corpora import _BODY_SQL
from millrace.plans.registry import as_long, query, table

_BLOCK, _MOST = 160, 120
_GENERATED_SQL = f"""g AS (SELECT item_id AS k, CASE WHEN item_id % 2 = 0 THEN 'think' ELSE 'direct' END AS mode, CAST(20 + item_id % 50 AS INTEGER) AS n_prompt, {_BODY_SQL.format("text")} AS b FROM benchmark),
    h AS (SELECT k, mode, n_prompt, b[1:30] || CASE WHEN k % 3 = 0 THEN [262] ELSE [] END || b[31:60] || CASE WHEN k % 5 = 0 THEN [258] ELSE [] END || b[61:110] || CASE WHEN k % 7 <> 0 THEN [257] ELSE [] END || b[111:] AS g FROM g)"""


def _generated(spark, d) -> DataFrame:
    k = F.col("item_id")
    b = table(spark, d, "benchmark").select(k.alias("k"), F.when(k % 2 == 0, "think").otherwise("direct").alias("mode"), (20 + k % 50).cast("int").alias("n_prompt"), K.byte_ids(F.col("text")).alias("b"))
    some = lambda rule, token: F.when(rule, F.array(F.lit(token))).otherwise(F.array().cast("array<int>"))
    k = F.col("k")
    whole = F.concat(F.slice("b", 1, 30), some(k % 3 == 0, K.FINAL), F.slice("b", 31, 30), some(k % 5 == 0, K.USER), F.slice("b", 61, 50), some(k % 7 != 0, K.EOS), F.slice("b", 111, F.size("b")))
    return b.select("k", "mode", "n_prompt", whole.alias("generated"))


@query(
    f"""WITH {_GENERATED_SQL}, p AS (SELECT *, CASE WHEN mode = 'think' THEN coalesce(nullif(list_position(g, 262), 0), 999999) ELSE 999999 END AS turn, coalesce(nullif(list_position(g, 257), 0), 999999) AS fin FROM h),
    q AS (SELECT *, coalesce(list_min(list_filter(range(1, len(g) + 1), lambda i: g[i] > 255 AND g[i] <> 257 AND i <> turn)), 999999) AS leak FROM p),
    s AS (SELECT *, least(fin, leak, {_BLOCK + 1} - n_prompt, {_MOST}, len(g)) AS stop FROM q),
    v AS (SELECT *, g[1:stop] AS seen, NOT (fin <= stop) AND NOT (leak <= stop) AS active FROM s)
    SELECT k, fin <= stop AS terminated, leak <= stop AS special_token_leak, turn <= stop AS final_transition, CAST(stop AS INTEGER) AS n_generated, active AND n_prompt + stop > {_BLOCK} AS context_exhausted,
    active AND NOT (n_prompt + stop > {_BLOCK}) AND stop = {_MOST} AS budget_exhausted, CASE WHEN leak <= stop THEN g[leak] END AS leaked_token,
    CASE WHEN mode = 'think' THEN array_to_string(list_filter(g[1:least(stop, turn - 1)], lambda x: x < 256), ',') ELSE '' END AS reasoning,
    array_to_string(list_filter(CASE WHEN mode = 'think' THEN CASE WHEN turn < stop THEN g[turn + 1:stop] ELSE [] END ELSE seen END, lambda x: x < 256), ',') AS final FROM v"""
)
def rollout_split(spark, d):
    """Generated tokens parted into reasoning and final part, and the way in which each generation ended."""
    found = R.split_generated(_generated(spark, d), _BLOCK, _MOST)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    flags = ["terminated", "special_token_leak", "final_transition", "n_generated", "context_exhausted", "budget_exhausted", "leaked_token"]
    return found.select("k", *flags, text("reasoning"), text("final"))


@query(
    f"""WITH {_GENERATED_SQL}, t AS (SELECT k, k % 20 AS batch, g[1:10] AS p, g[11:] AS o FROM h), m AS (SELECT *, p || o AS w, len(p) + len(o) - 1 AS n FROM t),
    x AS (SELECT *, max(n) OVER (PARTITION BY batch) - n AS behind FROM m)
    SELECT k, array_to_string(w[1:n] || list_transform(range(0, behind), lambda i: 263), ',') AS inputs, array_to_string(w[2:n + 1] || list_transform(range(0, behind), lambda i: 263), ',') AS targets,
    repeat('0', len(p) - 1) || repeat('1', len(o)) || repeat('0', behind) AS mask, round(-0.01 * len(o) * (len(o) + 1) / 2, 6) AS log_prob_sum FROM x"""
)
def trajectory_batches(spark, d):
    """Trajectories padded to the longest of their batch, with targets shifted by one and log probabilities in their places."""
    k = F.col("k")
    rows = _generated(spark, d).select("k", (k % 20).alias("batch"), F.slice("generated", 1, 10).alias("prompt"), F.slice("generated", 11, F.size("generated")).alias("generated"))
    rows = rows.withColumn("log_probs", F.transform("generated", lambda x, i: -0.01 * (i + 1)))
    text = lambda c, by: F.array_join(F.transform(c, lambda x: x.cast("string")), by)
    total = F.aggregate("old_log_probs", F.lit(0.0), lambda s, x: s + x)
    return R.collated(rows, "batch").select("k", text("input_ids", ",").alias("inputs"), text("target_ids", ",").alias("targets"), text("mask", "").alias("mask"), F.round(total, 6).alias("log_prob_sum"))


@query(
    """WITH t AS (SELECT l_returnflag, -CAST(l_discount AS DOUBLE) * 10 AS current, -CAST(l_tax AS DOUBLE) * 10 AS old, -0.3 AS reference, (l_linenumber - 3) / 2.0 AS advantage FROM lineitem),
    r AS (SELECT *, exp(current - old) AS r, exp(reference - current) - (reference - current) - 1 AS kl FROM t),
    s AS (SELECT *, least(r * advantage, least(greatest(r, 0.8), 1.2) * advantage) AS s FROM r)
    SELECT l_returnflag, count(*) AS generated_tokens, round(-avg(s - 0.04 * kl), 6) AS loss, round(avg(s), 6) AS surrogate, round(avg(r), 6) AS mean_ratio, round(avg(CAST(abs(r - 1) > 0.2 AS INTEGER)), 6) AS clip_fraction,
    round(avg(kl), 6) AS reference_kl, round(avg(old - current), 6) AS behavior_kl FROM s GROUP BY l_returnflag"""
)
def policy_loss(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_returnflag", (-F.col("l_discount").cast("double") * 10).alias("current"), (-F.col("l_tax").cast("double") * 10).alias("old"), F.lit(-0.3).alias("reference"), ((F.col("l_linenumber") - 3) / 2.0).alias("advantage")
    )
    return R.policy_loss(rows, ["l_returnflag"], 0.2, 0.04)


@query(
    """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS top, max(x / 2) OVER (PARTITION BY vec_id) AS htop FROM v),
    z AS (SELECT vec_id, any_value(label) AS label, ln(sum(exp(x - top))) + any_value(top) AS z, ln(sum(exp(x / 2))) AS zt, ln(sum(exp(-x / 2))) AS zs, max(x) FILTER (i = vec_id % 64) AS picked FROM m GROUP BY vec_id),
    k AS (SELECT m.vec_id, sum(exp(m.x / 2 - z.zt) * (m.x / 2 - z.zt - (-m.x / 2 - z.zs))) * 4 AS kl FROM m JOIN z ON m.vec_id = z.vec_id GROUP BY m.vec_id)
    SELECT z.label, count(*) AS n_targets, round(sum((z - picked) * CASE WHEN z.vec_id % 5 = 0 THEN 0 WHEN z.vec_id % 3 = 0 THEN 4 ELSE 1 END) / sum(CASE WHEN z.vec_id % 5 = 0 THEN 0 WHEN z.vec_id % 3 = 0 THEN 4 ELSE 1 END), 6) AS weighted_loss,
    round(avg(kl), 6) AS distillation FROM z JOIN k ON z.vec_id = k.vec_id GROUP BY z.label"""
)
def token_losses(spark, d):
    """Vectors as logits: the loss in which boundary tokens weigh four times, and the distance from a teacher with opposite logits."""
    k = F.col("vec_id")
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    loss = -F.element_at(R.log_softmax(F.col("x")), (k % 64 + 1).cast("int"))
    kl = R.distillation(F.transform("x", lambda v: -v), F.col("x"), 2.0)
    rows = rows.select("label", loss.alias("loss"), kl.alias("kl"), F.when(k % 3 == 0, K.FINAL).otherwise(0).alias("target"), (k % 5 != 0).alias("eligible"))
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_targets"), F.round(R.boundary_weighted(F.col("loss"), F.col("target"), F.col("eligible"), 4.0), 6).alias("weighted_loss"), F.round(F.avg("kl"), 6).alias("distillation")
    )


@query(
    _quantised_sql(7, 16)
    + """, l AS (SELECT vec_id, list(CAST(code AS INTEGER) ORDER BY g, i) AS c FROM (SELECT vec_id, g, code, row_number() OVER (PARTITION BY vec_id, g) AS i FROM q) GROUP BY vec_id)
    SELECT vec_id, CAST(sum(code) AS BIGINT) AS code_sum, CAST(sum(CASE WHEN code < 0 THEN code + 16 ELSE code END) AS BIGINT) AS half_sum, count(*) AS n_codes, true AS same FROM q GROUP BY vec_id"""
)
def int4_packing(spark, d):
    """Codes packed two to a byte and read again."""
    packed = Q.quantised(F.col("embedding").cast("array<double>"), 16, 7)
    rows = table(spark, d, "embeddings").select("vec_id", F.flatten(F.transform(packed, lambda p: p["codes"])).alias("codes"))
    rows = rows.withColumn("packed", Q.packed_nibbles(F.col("codes"))).withColumn("back", Q.unpacked_nibbles(F.col("packed"), F.size("codes")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    halves = F.aggregate("packed", F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(15) + F.shiftright(x, 4))
    return rows.select("vec_id", total("codes").alias("code_sum"), halves.alias("half_sum"), as_long(F.size("codes")).alias("n_codes"), (F.col("codes") == F.col("back")).alias("same"))


@query(
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(list_reverse(embedding))::DOUBLE AS y, unnest(range(0, len(embedding))) AS i FROM embeddings),
    s AS (SELECT *, i // 16 AS g, max(abs(x)) OVER w / 7 AS a, max(abs(y)) OVER w / 127 AS b FROM v WINDOW w AS (PARTITION BY vec_id, i // 16)),
    c AS (SELECT vec_id, g, CASE WHEN a = 0 THEN 1 ELSE a END AS a, CASE WHEN b = 0 THEN 1 ELSE b END AS b, x, y FROM s)
    SELECT vec_id, round(sum(greatest(-7, least(7, round_even(x / a, 0))) * greatest(-127, least(127, round_even(y / b, 0))) * a * b), 6) AS product FROM c GROUP BY vec_id"""
)
def mixed_product(spark, d):
    """4-bit weights times 8-bit activations: whole-number products within groups, scaled and summed."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    weights, activations = Q.quantised(F.col("x"), 16, 7), Q.quantised(F.reverse("x"), 16, 127)
    return rows.select("vec_id", F.round(Q.mixed_product(weights, activations), 6).alias("product"))


@query(
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)
    SELECT vec_id, round(sum(x * (i % 3)), 6) AS first, round(sum(x * ((i + 1) % 3)), 6) AS second, round(sum(0.5 * x * (1 + (exp(2 * u) - 1) / (exp(2 * u) + 1))), 6) AS gelu_sum
    FROM (SELECT *, sqrt(2 / pi()) * (x + 0.044715 * x * x * x) AS u FROM v) GROUP BY vec_id"""
)
def vector_products(spark, d):
    """A matrix of two rows times each vector, and the sum of its activations."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    row = lambda k: F.transform("x", lambda v, i: ((i + k) % 3).cast("double"))
    rows = rows.select("vec_id", Q.matvec(F.array(row(0), row(1)), F.col("x")).alias("y"), F.aggregate(F.transform("x", Q.gelu), F.lit(0.0), lambda s, v: s + v).alias("g"))
    return rows.select("vec_id", F.round(F.col("y")[0], 6).alias("first"), F.round(F.col("y")[1], 6).alias("second"), F.round("g", 6).alias("gelu_sum"))


@query(
    _quantised_sql(7, 16)
    + """ SELECT label, CAST(grouping(label) AS INTEGER) AS is_total, round(max(abs(x - code * scale)), 9) AS max_error, round(sqrt(avg(pow(x - code * scale, 2))), 9) AS rmse FROM q JOIN embeddings e ON q.vec_id = e.vec_id GROUP BY ROLLUP (label)"""
)
def tensor_errors(spark, d):
    """Errors of quantising by label, and over all vectors."""
    x = F.col("embedding").cast("array<double>")
    gap = F.zip_with(x, F.slice(Q.restored(Q.quantised(x, 16, 7)), 1, F.size(x)), lambda a, b: a - b)
    rows = table(spark, d, "embeddings").select("label", gap.alias("e")).select("label", F.array_max(F.transform("e", F.abs)).alias("m"), Q.dot(F.col("e"), F.col("e")).alias("s"), F.size("e").alias("n"))
    return rows.rollup("label").agg(F.grouping("label").cast("int").alias("is_total"), F.round(F.max("m"), 9).alias("max_error"), F.round(F.sqrt(F.sum("s") / F.sum("n")), 9).alias("rmse"))


@query(
    f"""WITH b AS (SELECT {_BODY_SQL.format("text")} AS b FROM benchmark), t AS (SELECT [256] || b || [257] AS t FROM b), p AS (SELECT t, unnest(range(1, len(t))) AS i FROM t)
    SELECT t[i] AS token, t[i + 1] AS target, count(*) AS n FROM p GROUP BY ALL"""
)
def next_tokens(spark, d):
    """Every token with the one that follows it: the targets of a language model, counted."""
    tokens, _ = K.base_record(F.col("text"))
    rows = table(spark, d, "benchmark").select(tokens.alias("t"))
    pairs = F.zip_with("t", F.slice("t", 2, F.size("t")), lambda a, b: F.struct(a.alias("token"), b.alias("target")))
    return rows.select(F.explode(pairs).alias("p")).select("p.*").where("target IS NOT NULL").groupBy("token", "target").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT doc_id, octet_length(encode(text)) + 2 AS n, sum(octet_length(encode(text)) + 2) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS e FROM documents), x AS (SELECT CAST(max(e) AS BIGINT) - 1 AS targets FROM t)
    SELECT CAST(targets // 256 AS BIGINT) AS n_full, CAST(targets // 256 * 256 AS BIGINT) AS covered, targets AS n_targets FROM x"""
)
def full_windows(spark, d):
    """Windows that are full, the targets they cover, and all targets of the stream (its first token is none)."""
    docs = table(spark, d, "documents")
    size = as_long(F.octet_length("text") + 2)
    full = K.windows(docs, "doc_id", size, full_only=True).agg(F.count(F.lit(1)).alias("n_full"), F.sum("n_targets").alias("covered"))
    return full.join(docs.agg((F.sum(size) - 1).alias("n_targets")))  # one row each


@query(
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) // 4 AS g FROM embeddings), m AS (SELECT vec_id, g, avg(x) AS m FROM v GROUP BY ALL)
    SELECT vec_id, count(*) AS n_groups, round(max(m), 9) AS largest, round(min(m), 9) AS smallest FROM m GROUP BY vec_id"""
)
def shared_heads(spark, d):
    """Neighbouring values shared by their mean, four at a time."""
    rows = table(spark, d, "embeddings").select("vec_id", Q.group_means(F.col("embedding").cast("array<double>"), 4).alias("m"))
    return rows.select("vec_id", as_long(F.size("m")).alias("n_groups"), F.round(F.array_max("m"), 9).alias("largest"), F.round(F.array_min("m"), 9).alias("smallest"))
