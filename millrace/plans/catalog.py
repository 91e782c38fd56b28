"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.calculations import verified
from millrace.operators import measures as M
from millrace.operators import quantise as Q
from millrace.operators import selection as S
from millrace.operators import tokens as K
from millrace.plans.registry import as_long as _long
from millrace.plans.registry import query, table
from millrace.sources.readers import counted, first_reason, licence_gate

SEED = "split-v1"

BUCKET_SQL = f"CAST(CAST('0x' || substr(sha256('{SEED}:' || CAST({{}} AS VARCHAR)), 1, 16) AS UBIGINT) % 10000 AS INTEGER)"
SPLIT_SQL = "CASE WHEN {0} < 9000 THEN 'train' WHEN {0} < 9500 THEN 'validation' ELSE 'test' END"
BYTES_SQL = "CAST(octet_length(encode(text)) AS BIGINT)"


@query(f"SELECT doc_id, {BUCKET_SQL.format('doc_id')} AS bucket, {SPLIT_SQL.format(BUCKET_SQL.format('doc_id'))} AS split FROM documents")
def split_bucket(spark, d):
    b = T.bucket(SEED, F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", b.alias("bucket"), T.split_of(b).alias("split"))


_NORMAL_SQL = "regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[^\\S\\n]+\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(
    f"""WITH g AS (SELECT doc_id, source, {_NORMAL_SQL} AS t, {BYTES_SQL} AS b FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS r FROM g WHERE b BETWEEN 256 AND 65536),
    s AS (SELECT *, {SPLIT_SQL.format(BUCKET_SQL.format('source'))} AS split FROM k WHERE r = 1)
    SELECT split, count(*) AS records, count(DISTINCT source) AS families, CAST(sum(b) AS BIGINT) AS bytes FROM s GROUP BY ROLLUP (split)"""
)
def split_report(spark, d):
    """Gate by length, first of equal texts, split by family, totals (null split: all)."""
    docs = table(spark, d, "documents").withColumn("bytes", _long(F.octet_length("text"))).where(F.col("bytes").between(256, 65536))
    marked = docs.select("doc_id", "source", "bytes", T.fingerprint(F.col("text")).alias("mark"))
    first = S.first_of_group(marked, ["mark"], ["doc_id"])
    return first.withColumn("split", T.split_of(T.bucket(SEED, F.col("source")))).rollup("split").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("source").alias("families"), F.sum("bytes").alias("bytes")
    )


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM (SELECT doc_id, {_NORMAL_SQL} AS t FROM documents) GROUP BY t")
def dedup_first(spark, d):
    marked = table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("mark"))
    return marked.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies")).drop("mark")


@query("SELECT sha256(text) AS mark, count(DISTINCT source) AS n_payloads, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def family_conflict(spark, d):
    marked = table(spark, d, "documents").select(F.sha2("text", 256).alias("mark"), "source")
    return S.conflicts(marked, "mark", "source")


@query(
    f"""SELECT CASE WHEN lang <> 'en' THEN 'language' WHEN text IS NULL OR text = '' THEN 'empty' WHEN {BYTES_SQL} < 256 THEN 'too_short' WHEN {BYTES_SQL} > 65536 THEN 'too_long'
    WHEN regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}\\x{{FFFD}}]') THEN 'control_character' WHEN regexp_matches(text, 'sk-[A-Za-z0-9]{{16,}}') THEN 'secret' ELSE 'accepted' END AS reason,
    count(*) AS n_rows FROM documents GROUP BY 1"""
)
def reject_reasons(spark, d):
    text, size = F.col("text"), F.octet_length("text")
    rules = [
        ("language", F.col("lang") != "en"),
        ("empty", text.isNull() | (text == "")),
        ("too_short", size < 256),
        ("too_long", size > 65536),
        ("control_character", T.has_control(text)),
        ("secret", T.has_secret(text)),
    ]
    return counted(table(spark, d, "documents"), first_reason(rules))


@query(
    """SELECT CASE WHEN l.quality IS NULL OR l.quality < 0.5 THEN 'quality' WHEN l.toxic > 0.5 THEN 'toxicity' ELSE 'accepted' END AS reason, count(*) AS n_rows
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"""
)
def label_gate(spark, d):
    """A missing quality refuses a row, a missing toxicity does not."""
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    rules = [("quality", F.col("quality").isNull() | (F.col("quality") < 0.5)), ("toxicity", F.col("toxic") > 0.5)]
    return counted(joined, first_reason(rules))


@query(
    """WITH s AS (SELECT 'src' || i AS source_id, CASE WHEN i % 7 = 3 THEN 'excluded' WHEN i % 7 = 5 THEN 'row-filtered' ELSE 'eligible' END AS policy, 'l' || (i % 4) AS l FROM range(0, 18) t(i)),
    r AS (SELECT source AS source_id, 'l' || (doc_id % 4) AS l FROM documents)
    SELECT CASE WHEN s.policy IS NULL THEN 'unknown_source' WHEN s.policy = 'excluded' THEN 'excluded_source' WHEN s.policy = 'eligible' AND r.l <> s.l THEN 'licence_mismatch'
    WHEN s.policy = 'row-filtered' AND r.l NOT IN ('l1', 'l2') THEN 'row_licence' ELSE 'accepted' END AS reason, count(*) AS n_rows FROM r LEFT JOIN s ON r.source_id = s.source_id GROUP BY 1"""
)
def source_join(spark, d):
    """Licence gate against a registry of 18 sources; it is small by construction."""
    i = F.col("id")
    policy = F.when(i % 7 == 3, "excluded").when(i % 7 == 5, "row-filtered").otherwise("eligible")
    sources = spark.range(18).select(F.concat(F.lit("src"), i).alias("source_id"), policy.alias("policy"), F.concat(F.lit("l"), i % 4).alias("license_id"), F.array(F.lit("l1"), F.lit("l2")).alias("allowed_row_licenses"))
    records = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.concat(F.lit("l"), F.col("doc_id") % 4).alias("license_id"))
    return counted(licence_gate(records, F.broadcast(sources)), F.col("reason"))


@query(f"SELECT source, count(*) AS n_documents, CAST(sum({BYTES_SQL}) AS BIGINT) AS n_bytes FROM documents GROUP BY source")
def source_bytes(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(_long(F.octet_length("text"))).alias("n_bytes"))


@query("SELECT doc_id, lang, CAST(r AS INTEGER) AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('rank-1:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 25")
def hash_topk(spark, d):
    return S.top_by_hash(table(spark, d, "documents").select("doc_id", "lang"), "rank-1", "doc_id", 25, ["lang"]).select("doc_id", "lang", "rank")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY h, doc_id) AS INTEGER) AS rank FROM (SELECT doc_id, sha256('rank-2:' || CAST(doc_id AS VARCHAR)) AS h FROM documents) ORDER BY h, doc_id LIMIT 100")
def global_topk(spark, d):
    return S.top_by_hash(table(spark, d, "documents").select("doc_id"), "rank-2", "doc_id", 100).select("doc_id", "rank")


@query(
    f"""WITH RECURSIVE t AS (SELECT source, doc_id, {BYTES_SQL} AS b, sha256(text) AS c, sha256('budget-1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
    u AS (SELECT *, row_number() OVER (PARTITION BY source, c ORDER BY h, doc_id) AS r FROM t),
    o AS (SELECT source, doc_id, b, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS k FROM u WHERE r = 1),
    w(source, k, used, n, id, b) AS (
      SELECT DISTINCT source, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM o
      UNION ALL
      SELECT w.source, o.k, CASE WHEN w.n < 50 AND w.used + o.b <= 20000 THEN w.used + o.b ELSE w.used END, CASE WHEN w.n < 50 AND w.used + o.b <= 20000 THEN w.n + 1 ELSE w.n END,
             CASE WHEN w.n < 50 AND w.used + o.b <= 20000 THEN o.doc_id END, CASE WHEN w.n < 50 AND w.used + o.b <= 20000 THEN o.b END
      FROM w JOIN o ON o.source = w.source AND o.k = w.k + 1)
    SELECT source, id AS doc_id, b AS bytes FROM w WHERE id IS NOT NULL"""
)
def greedy_budget(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("mark"))
    return S.within_budget(docs, "budget-1", "source", "doc_id", "bytes", "mark", 50, 20_000)


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark)")
def anti_benchmark(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("mark"))
    return docs.join(table(spark, d, "benchmark").select(F.sha2("text", 256).alias("mark")), "mark", "left_anti").select("doc_id")


@query(
    f"""WITH s AS (SELECT source, {SPLIT_SQL.format(BUCKET_SQL.format('doc_id'))} AS split FROM documents)
    SELECT source FROM s WHERE split = 'train' INTERSECT SELECT source FROM s WHERE split = 'test'"""
)
def leak_intersect(spark, d):
    """Families on both sides of a split by document: what a split by family must not show."""
    rows = table(spark, d, "documents").select("source", T.split_of(T.bucket(SEED, F.col("doc_id"))).alias("split"))
    return rows.where("split = 'train'").select("source").intersect(rows.where("split = 'test'").select("source"))


_PAIRS_SQL = """p AS (SELECT a.conv_id, a.turn, u.text AS q, a.text AS a FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE a.role = 'assistant' AND u.role = 'user')"""


def _pairs(spark, d) -> DataFrame:
    rows = table(spark, d, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    return rows.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("a")).join(asked, ["conv_id", "turn"])


@query(f"WITH {_PAIRS_SQL} SELECT conv_id, turn, CAST(octet_length(encode(q)) + octet_length(encode(a)) + 5 AS BIGINT) AS n_tokens, octet_length(encode(q)) + octet_length(encode(a)) + 5 <= 256 AS fits FROM p")
def pair_turns(spark, d):
    size = F.octet_length("q") + F.octet_length("a") + 5
    return _pairs(spark, d).select("conv_id", "turn", _long(size).alias("n_tokens"), (size <= 256).alias("fits"))


@query(
    f"""WITH {_PAIRS_SQL}, n AS (SELECT conv_id, turn, octet_length(encode(q)) AS q, octet_length(encode(a)) AS a FROM p)
    SELECT conv_id, turn, 'direct' AS mode, CAST(q + a + 5 AS BIGINT) AS n_tokens FROM n UNION ALL SELECT conv_id, turn, 'think', CAST(q + 2 * a + 6 AS BIGINT) FROM n"""
)
def union_modes(spark, d):
    """Every pair as a direct and as a thinking example (the answer stands for the reasoning)."""
    direct, think = K.response_lengths(F.col("q"), F.col("a"), F.col("a"))
    modes = F.array(F.struct(F.lit("direct").alias("mode"), _long(direct).alias("n_tokens")), F.struct(F.lit("think").alias("mode"), _long(think).alias("n_tokens")))
    return _pairs(spark, d).select("conv_id", "turn", F.explode(modes).alias("m")).select("conv_id", "turn", "m.*")


@query(
    f"""WITH {_PAIRS_SQL}, n AS (SELECT octet_length(encode(q)) AS q, octet_length(encode(a)) AS a FROM p)
    SELECT CASE WHEN q + a + 5 > 512 THEN 'direct_context' WHEN q + 2 * a + 6 > 512 THEN 'think_context' ELSE 'accepted' END AS reason, count(*) AS n_rows FROM n GROUP BY 1"""
)
def context_fit(spark, d):
    direct, think = K.response_lengths(F.col("q"), F.col("a"), F.col("a"))
    return counted(_pairs(spark, d), first_reason([("direct_context", direct > 512), ("think_context", think > 512)]))


@query(f"SELECT doc_id, {BYTES_SQL} + 2 AS n_tokens, {BYTES_SQL} + 1 AS n_targets FROM documents")
def byte_tokens(spark, d):
    tokens, mask = K.base_record(F.col("text"))
    return table(spark, d, "documents").select("doc_id", _long(F.size(tokens)).alias("n_tokens"), _long(F.aggregate(mask, F.lit(0), lambda s, x: s + x)).alias("n_targets"))


@query(
    """WITH c AS (SELECT conv_id, role, coalesce(octet_length(encode(text)), 0) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations)
    SELECT conv_id, count(*) AS n_turns, bool_and(b > 0 AND role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END) AND count(*) % 2 = 0 AS valid,
    CAST(2 + sum(1 + b) AS BIGINT) AS n_tokens, CAST(1 + sum(CASE WHEN role = 'assistant' THEN b ELSE 0 END) AS BIGINT) AS n_targets FROM c GROUP BY conv_id"""
)
def conversation_gate(spark, d):
    return K.conversation_gate(table(spark, d, "conversations"))


@query(
    f"""WITH t AS (SELECT doc_id, {BYTES_SQL} + 2 AS n, sum({BYTES_SQL} + 2) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - {BYTES_SQL} - 2 AS o FROM documents),
    s AS (SELECT greatest(o, 1) - 1 AS a, o + n - 2 AS b FROM t),
    w AS (SELECT a, b, unnest(range(CAST(a // 256 AS BIGINT), CAST(b // 256 AS BIGINT) + 1)) AS win FROM s WHERE b >= a)
    SELECT win AS "window", CAST(sum(least(b, win * 256 + 255) - greatest(a, win * 256) + 1) AS BIGINT) AS n_targets, count(*) AS n_records FROM w GROUP BY win"""
)
def pack_windows(spark, d):
    return K.windows(table(spark, d, "documents"), "doc_id", _long(F.octet_length("text") + 2))


@query(
    """WITH h AS (SELECT hex(encode(text)) AS h FROM documents), p AS (SELECT h, unnest(range(1, length(h), 2)) AS i FROM h),
    c AS (SELECT CAST(('0x' || substr(h, i, 2)) AS INTEGER) AS token, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 256, count(*) FROM documents UNION ALL SELECT 257, count(*) FROM documents),
    t AS (SELECT sum(n) AS total FROM c)
    SELECT token, n, round(-ln((n + 1) / (CAST(total AS DOUBLE) + 264)), 9) AS nll FROM c, t"""
)
def unigram_nll(spark, d):
    return K.unigram_loss(K.token_counts(table(spark, d, "documents")))


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 9),
    c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY doc_id, g)
    SELECT d.doc_id, coalesce(max(c.n) >= 3, false) AS repeated FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id"""
)
def repeated_trigram(spark, d):
    return table(spark, d, "documents").select("doc_id", T.repeats_phrase(F.col("text")).alias("repeated"))


_RESULTS_SQL = """r AS (SELECT event_id, user_id % 4 AS slice, event_type AS task, value, CAST(event_id % 97 AS BIGINT) AS generated, value > 50 AS correct,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 <> 0 END AS consistent, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS final FROM events)"""


def _results(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    consistent = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 5 != 0)
    return e.select(
        "event_id", (F.col("user_id") % 4).alias("slice"), F.col("event_type").alias("task"), "value", _long(F.col("event_id") % 97).alias("generated"), (F.col("value") > 50).alias("correct"),
        consistent.alias("consistent"), F.floor(F.col("value") / 10).cast("string").alias("final"),
    )


@query(f"WITH {_RESULTS_SQL} SELECT task, count(*) AS n_rows, round(avg(CAST(correct AS INTEGER)), 9) AS accuracy FROM r GROUP BY ROLLUP (task)")
def rates_by_task(spark, d):
    return _results(spark, d).rollup("task").agg(F.count(F.lit(1)).alias("n_rows"), F.round(M.rate(F.col("correct")), 9).alias("accuracy"))


@query(
    f"""WITH {_RESULTS_SQL} SELECT slice, task, count(*) AS n_rows, CAST(sum(CAST(correct AS BIGINT)) AS BIGINT) AS n_correct, CAST(sum(generated) AS BIGINT) AS n_generated,
    round(avg(CAST(correct AS INTEGER)), 9) AS accuracy, round(avg(generated), 9) AS mean_generated,
    round(CASE WHEN sum(generated) = 0 THEN NULL ELSE sum(CAST(correct AS BIGINT)) * 1000.0 / CAST(sum(generated) AS DOUBLE) END, 9) AS correct_per_1000,
    round(avg(CAST(consistent AS INTEGER)), 9) AS consistency, count(DISTINCT final) AS n_finals FROM r GROUP BY GROUPING SETS ((), (slice), (task))"""
)
def metric_groups(spark, d):
    return M.metric_groups(_results(spark, d), ["slice", "task"])


@query(
    f"""WITH {_RESULTS_SQL}, c AS (SELECT task, final, count(*) AS n, min(event_id) AS f FROM r GROUP BY ALL)
    SELECT task, final, n FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, f) AS k FROM c) WHERE k = 1"""
)
def mode_value(spark, d):
    return M.most_common(_results(spark, d), "task", "final", "event_id")


def _decimals_sql(text: str) -> str:
    """All decimals of a text, plain. There is no look-behind: marks are set around each character that may stand
    beside a number, and a number goes from mark to mark."""
    marked = rf"chr(1) || regexp_replace({text}, '([^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}/])', chr(2) || '\1' || chr(1), 'g') || chr(2)"
    number = r"\x01(?:\x02[-+]\x01)?(?:\p{Nd}{1,3}(?:\x02,\x01\p{Nd}{3})+|\p{Nd}+)(?:\x02\.\x01\p{Nd}+)?\x02"
    plain = r"regexp_replace(regexp_replace(x, '[\x01\x02,+]', '', 'g'), '^(-?)0+(\p{Nd})', '\1\2')"
    plain = rf"regexp_replace(regexp_replace({plain}, '(\.\p{{Nd}}*?)0+$', '\1'), '\.$', '')"
    return f"list_transform(regexp_extract_all({marked}, '{number}'), lambda x: coalesce(nullif({plain}, '-0'), '0'))"


def _last_decimal_sql(text: str) -> str:
    blank = r"[\s\x0B\x85\p{Z}]*"
    return rf"CASE WHEN NOT regexp_matches({text}, '\p{{Nd}}{blank}/{blank}[-+]?\p{{Nd}}') THEN ({_decimals_sql(text)})[-1] END"


@query(f"SELECT doc_id, {_last_decimal_sql('text')} AS last_decimal, CAST(len(list_distinct({_decimals_sql("coalesce(text, '')")})) AS BIGINT) AS n_numbers FROM documents")
def last_decimal(spark, d):
    return table(spark, d, "documents").select("doc_id", T.last_decimal(F.col("text")).alias("last_decimal"), _long(F.size(T.numbers(F.col("text")))).alias("n_numbers"))


@query(
    """WITH g AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY user_id)
    SELECT event_id, round(CASE WHEN s <= 1e-6 THEN 0.0 ELSE (value - m) / (s + 1e-6) END, 6) AS advantage FROM events e JOIN g ON e.user_id = g.user_id"""
)
def group_advantage(spark, d):
    return M.advantages(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query(
    """WITH g AS (SELECT user_id, bool_or(value > 50) AND NOT bool_and(value > 50) AS m FROM events GROUP BY user_id)
    SELECT count(*) AS n_groups, CAST(sum(CAST(m AS BIGINT)) AS BIGINT) AS n_mixed, round(avg(CAST(m AS INTEGER)), 9) AS fraction FROM g"""
)
def mixed_groups(spark, d):
    return M.mixed_groups(table(spark, d, "events").select("user_id", (F.col("value") > 50).alias("c")), "user_id", F.col("c"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n_rows FROM lineitem GROUP BY l_returnflag")
def pearson(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(M.pearson("l_quantity", "l_extendedprice"), 6).alias("r"), F.count(F.lit(1)).alias("n_rows"))


@query(
    f"""WITH {_RESULTS_SQL} SELECT count(*) AS n_rows, count(*) FILTER (correct AND consistent) AS n_exact, count(*) FILTER (value / 100 >= 0.75 AND NOT coalesce(consistent, false)) AS high_ai_wrong,
    count(*) FILTER (value / 100 <= 0.25 AND coalesce(consistent, false)) AS low_ai_correct, round(avg(value / 100), 6) AS ai_mean FROM r"""
)
def reward_audit(spark, d):
    rows = _results(spark, d).select((F.col("value") / 100).alias("ai"), F.coalesce("consistent", F.lit(False)).alias("numeric"), (F.col("correct") & F.col("consistent")).alias("exact"))
    return M.reward_audit(rows, "ai", "numeric", "exact").withColumn("ai_mean", F.round("ai_mean", 6))


@query(
    f"""WITH {_RESULTS_SQL}, s AS (SELECT CAST(sum(CAST(correct AS BIGINT)) AS DOUBLE) AS a, CAST(sum(CAST(coalesce(consistent, false) AS BIGINT)) AS DOUBLE) AS b, avg(CAST(generated >= 2 AS INTEGER)) AS f FROM r GROUP BY event_id % 3)
    SELECT count(*) AS n_seeds, round(avg(a), 6) AS primary_mean, round(stddev_pop(a), 6) AS primary_std, round(avg(b), 6) AS challenge_mean, round(stddev_pop(b), 6) AS challenge_std,
    count(*) FILTER (a > 100 AND b > 100) AS n_improving, round(min(f), 9) AS least_rate,
    count(*) = 3 AND avg(a) > 100 AND avg(b) > 100 AND count(*) FILTER (a > 100 AND b > 100) >= 2 AND min(f) >= 0.95 AS improved FROM s"""
)
def seed_gate(spark, d):
    """Three seeds, between which all results are dealt."""
    rows = _results(spark, d).groupBy((F.col("event_id") % 3).alias("seed")).agg(
        F.count_if("correct").cast("double").alias("primary"), F.count_if(F.coalesce("consistent", F.lit(False))).cast("double").alias("challenge"), M.rate(F.col("generated") >= 2).alias("format_rate")
    )
    gate = M.seed_gate(rows.withColumn("mode_rate", F.col("format_rate")), 100.0, 100.0)
    six = ["primary_mean", "primary_std", "challenge_mean", "challenge_std"]
    return gate.withColumns({c: F.round(c, 6) for c in six} | {"least_rate": F.round("least_rate", 9)})


@query(
    f"""WITH {_RESULTS_SQL} SELECT event_id, round(CASE WHEN correct THEN 0.8 ELSE 0 END + CASE WHEN correct AND generated > 10 THEN 0.15 ELSE 0 END + CASE WHEN generated > 5 THEN 0.05 ELSE 0 END + 0.2 * value / 100, 6) AS combined,
    round(CASE WHEN generated > 5 THEN value / 100 ELSE 0 END, 6) AS direct FROM r"""
)
def reward_compose(spark, d):
    fine, ai = F.col("generated") > 5, F.col("value") / 100
    total = M.combined_reward(M.verifier_reward(F.col("correct"), F.col("generated") > 10, fine), ai)
    return _results(spark, d).select("event_id", F.round(total, 6).alias("combined"), F.round(M.direct_reward(fine, ai), 6).alias("direct"))


def _quantised_sql(top: int, size: int) -> str:
    return f"""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    s AS (SELECT *, i // {size} AS g, max(abs(x)) OVER (PARTITION BY vec_id, i // {size}) / {top} AS m FROM v),
    c AS (SELECT vec_id, g, x, CASE WHEN m = 0 THEN 1.0 ELSE m END AS scale FROM s),
    q AS (SELECT *, greatest(-{top}, least({top}, round_even(x / scale, 0))) AS code FROM c)"""


@query(_quantised_sql(7, 16) + " SELECT vec_id, g AS \"group\", round(any_value(scale), 9) AS scale, CAST(sum(code) AS BIGINT) AS code_sum FROM q GROUP BY vec_id, g")
def int4_quant(spark, d):
    packed = Q.quantised(F.col("embedding").cast("array<double>"), 16, 7)
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(packed).alias("g", "p"))
    return rows.select("vec_id", _long("g").alias("group"), F.round("p.scale", 9).alias("scale"), F.aggregate("p.codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"))


@query(_quantised_sql(127, 32) + " SELECT vec_id, g AS \"group\", round(any_value(scale), 9) AS scale, CAST(sum(code) AS BIGINT) AS code_sum FROM q GROUP BY vec_id, g")
def int8_quant(spark, d):
    packed = Q.quantised(F.col("embedding").cast("array<double>"), 32, 127)
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(packed).alias("g", "p"))
    return rows.select("vec_id", _long("g").alias("group"), F.round("p.scale", 9).alias("scale"), F.aggregate("p.codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"))


@query(_quantised_sql(7, 16) + " SELECT vec_id, round(max(abs(x - code * scale)), 9) AS max_error, round(sqrt(avg(pow(x - code * scale, 2))), 9) AS rmse FROM q GROUP BY vec_id")
def quant_error(spark, d):
    x = F.col("embedding").cast("array<double>")
    gap = F.zip_with(x, F.slice(Q.restored(Q.quantised(x, 16, 7)), 1, F.size(x)), lambda a, b: F.abs(a - b))
    rows = table(spark, d, "embeddings").select("vec_id", gap.alias("e"))
    return rows.select("vec_id", F.round(F.array_max("e"), 9).alias("max_error"), F.round(F.sqrt(Q.dot(F.col("e"), F.col("e")) / F.size("e")), 9).alias("rmse"))


@query(
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    s AS (SELECT *, max(x) OVER w AS top, avg(x) OVER w AS mean, stddev_pop(x) OVER w AS sd FROM v WINDOW w AS (PARTITION BY vec_id))
    SELECT vec_id, CAST(min(i) FILTER (x = top) AS INTEGER) AS best, round(1 / sum(exp(x - top)), 9) AS best_share, round(max((x - mean) / sqrt(sd * sd + 1e-5)), 6) AS best_norm FROM s GROUP BY vec_id"""
)
def vector_head(spark, d):
    """Argmax, its softmax share, and the largest value after layer normalisation."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rows.select("vec_id", Q.argmax(F.col("x")).alias("best"), F.round(F.array_max(Q.softmax(F.col("x"))), 9).alias("best_share"), F.round(F.array_max(Q.layer_norm(F.col("x"))), 6).alias("best_norm"))


@query(
    """WITH g AS (SELECT DISTINCT p_size % 21 AS l, p_partkey % 21 AS r, ['+', '-', '*'][p_partkey // 21 % 3 + 1] AS op FROM part),
    a AS (SELECT l, r, op, CASE op WHEN '+' THEN l + r WHEN '-' THEN l - r ELSE l * r END AS answer, sha256('easy-1:' || l || op || r) AS h FROM g)
    SELECT CAST(l AS BIGINT) AS left_value, op, CAST(r AS BIGINT) AS right_value, CAST(answer AS BIGINT) AS answer FROM a ORDER BY h LIMIT 256"""
)
def easy_grid(spark, d):
    """The small sums, differences and products that the parts name; the 256 with the smallest hashes."""
    k = F.col("p_partkey")
    op = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("*")), (F.floor(k / 21) % 3 + 1).cast("int"))
    rows = table(spark, d, "part").select(_long(F.col("p_size") % 21).alias("left_value"), op.alias("op"), _long(k % 21).alias("right_value")).distinct()
    answer = F.when(F.col("op") == "+", F.col("left_value") + F.col("right_value")).when(F.col("op") == "-", F.col("left_value") - F.col("right_value")).otherwise(F.col("left_value") * F.col("right_value"))
    rows = rows.withColumn("answer", answer).withColumn("h", T.seeded("easy-1", F.concat("left_value", "op", "right_value")))
    return rows.orderBy("h").limit(256).drop("h")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_orderkey % 11 = 0 AS off FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN NOT off THEN l_linenumber || ' * (' || q || ' + 3)' END AS expression, CASE WHEN NOT off THEN CAST(l_linenumber * (q + 3) AS VARCHAR) END AS result,
    CASE WHEN off THEN 'wrong result' END AS error FROM a"""
)
def annotation_verify(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _long("l_quantity").alias("q"))
    right = F.col("l_linenumber") * (F.col("q") + 3) + F.when(F.col("l_orderkey") % 11 == 0, 1).otherwise(0)
    text = F.concat("l_linenumber", F.lit("*("), "q", F.lit("+3)="), right)
    return rows.select("l_orderkey", "l_linenumber", verified(text).alias("v")).select("l_orderkey", "l_linenumber", "v.*")


@query(
    """WITH c AS (SELECT event_type, user_id, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY ALL)
    SELECT sha256(event_type || ':' || user_id) AS request, n AS n_requests, n - 1 AS n_hits FROM c"""
)
def cache_probe(spark, d):
    """Requests by their hash: the first is computed, the others are hits."""
    request = F.sha2(F.concat_ws(":", "event_type", "user_id"), 256).alias("request")
    return table(spark, d, "events").groupBy(request).agg(F.count(F.lit(1)).alias("n_requests")).withColumn("n_hits", F.col("n_requests") - 1)


@query(
    """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'arithmetic' ELSE 'physics' END AS task, p_size AS e FROM part),
    r AS (SELECT CASE WHEN k % 13 = 0 THEN 'invalid_final_answer' WHEN k % 7 = 0 THEN 'final_answer_mismatch' WHEN task = 'arithmetic' AND k % 5 = 0 THEN 'unexpected_unit' WHEN task = 'physics' AND k % 3 = 0 THEN 'unit_mismatch'
      WHEN k % 17 = 0 THEN 'non_ascii_or_empty_answer' WHEN k % 19 = 0 THEN 'role_token_leak' WHEN k % 23 = 0 THEN 'final_answer_missing_from_text' ELSE 'verified' END AS reason FROM p)
    SELECT reason, count(*) AS n_rows FROM r GROUP BY reason"""
)
def teacher_verify(spark, d):
    """Answers made from the part table so that every check has something to refuse."""
    k, e = F.col("p_partkey"), F.col("p_size").cast("string")
    arithmetic = F.col("p_size") % 2 == 0
    unit = F.when(arithmetic, F.when(k % 5 == 0, "m")).otherwise(F.when(k % 3 == 0, "kg").otherwise("N"))
    final = F.when(k % 13 == 0, "about").when(k % 7 == 0, (F.col("p_size") + 1).cast("string")).otherwise(e)
    text = F.when(k % 17 == 0, "é").when(k % 19 == 0, "<user> 1").when(k % 23 == 0, "no number N").otherwise(F.concat(F.lit("It is  "), e, F.lit(" N.")))
    rows = table(spark, d, "part").select(
        F.when(arithmetic, "arithmetic").otherwise("physics").alias("task"), F.lit("What is it?").alias("prompt"), e.alias("expected_answer"), F.when(~arithmetic, "N").alias("expected_unit"),
        final.alias("final_answer"), unit.alias("unit"), text.alias("answer_text"),
    )
    return counted(M.answer_reason(rows), F.col("reason"))


@query("SELECT CASE WHEN greatest(abs(l_quantity), abs(l_extendedprice)) < 10 THEN '<10' WHEN greatest(abs(l_quantity), abs(l_extendedprice)) < 100 THEN '<100' WHEN greatest(abs(l_quantity), abs(l_extendedprice)) < 1000 THEN '<1000' ELSE '>=1000' END AS magnitude, count(*) AS n_rows FROM lineitem GROUP BY 1")
def magnitudes(spark, d):
    top = F.greatest(F.abs("l_quantity"), F.abs("l_extendedprice"))
    return table(spark, d, "lineitem").groupBy(F.when(top < 10, "<10").when(top < 100, "<100").when(top < 1000, "<1000").otherwise(">=1000").alias("magnitude")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT ch, CAST(row_number() OVER (ORDER BY encode(ch)) - 1 AS INTEGER) AS id, n FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch)")
def vocabulary(spark, d):
    """Characters by code point; as many rows as the alphabet has."""
    return K.vocabulary(table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")).select("ch", "id", "n")


@query(
    """SELECT event_id, round(CASE WHEN i <= 100 THEN 3e-4 * i / 100 WHEN i >= 1000 THEN 3e-5 ELSE 3e-5 + 0.5 * (1 + cos(pi() * (i - 100) / 900.0)) * (3e-4 - 3e-5) END, 12) AS rate
    FROM (SELECT event_id, event_id + 1 AS i FROM events)"""
)
def learning_rate(spark, d):
    """Every event as a step."""
    return table(spark, d, "events").select("event_id", F.round(M.learning_rate(F.col("event_id") + 1, 3e-4, 3e-5, 100, 1000), 12).alias("rate"))


@query(
    """SELECT p_partkey, CAST(i AS BIGINT) AS head, round(CASE WHEN i < 8 THEN pow(2, -8.0 * (i + 1) / 8) ELSE pow(2, -4.0 * (2 * (i - 8) + 1) / 8) END, 12) AS slope
    FROM (SELECT p_partkey, p_partkey % 12 AS i FROM part)"""
)
def alibi_slopes(spark, d):
    """Parts as heads of twelve."""
    return table(spark, d, "part").select("p_partkey", _long(F.col("p_partkey") % 12).alias("head")).select("p_partkey", "head", F.round(M.alibi_slope(F.col("head"), 12), 12).alias("slope"))


@query(f"WITH t AS (SELECT CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'validation' END AS part, {BYTES_SQL} AS b FROM documents) SELECT part, count(*) AS n_rows, CAST(sum(b) AS BIGINT) AS n_bytes FROM t GROUP BY part")
def head_split(spark, d):
    """The first nine tenths in order and the rest; ranks come from sums over stretches."""
    docs = table(spark, d, "documents").select("doc_id", _long(F.octet_length("text")).alias("b"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))  # one row
    ranked = S.running_offset(docs, "doc_id", F.lit(1)).join(total)
    return ranked.groupBy(F.when(F.col("offset") < F.floor(F.col("total") * 0.9), "train").otherwise("validation").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("b").alias("n_bytes"))


@query(
    f"""WITH {_PAIRS_SQL}, s AS (SELECT conv_id, turn, coalesce(a, '') AS a, {_last_decimal_sql("coalesce(a, '')")} AS parsed_answer, coalesce({_last_decimal_sql('q')}, '0') AS expected,
    regexp_extract_all(lower(coalesce(a, '')), '[a-z0-9'']+') AS w FROM p),
    g AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM s),
    f AS (SELECT *, len(w) >= 9 AND list_max(map_values(list_aggregate(g, 'histogram'))) >= 3 AS repeated_phrase, coalesce(parsed_answer = expected, false) AS numeric_correct,
    list_bool_or(list_transform({T.SPECIAL_NAMES}, lambda n: contains(upper(a), n))) AS leak FROM g),
    v AS (SELECT *, trim(a) <> '' AND NOT leak AND NOT repeated_phrase AND parsed_answer IS NOT NULL AS format_valid FROM f)
    SELECT conv_id, turn, parsed_answer, repeated_phrase, numeric_correct, true AS unit_correct, format_valid, numeric_correct AND format_valid AS task_correct FROM v"""
)
def score_answers(spark, d):
    """Every assistant turn scored against the last decimal of its question."""
    rows = _pairs(spark, d).select("conv_id", "turn", F.col("a").alias("completion"), F.coalesce(T.last_decimal(F.col("q")), F.lit("0")).alias("expected_answer"), F.lit(None).cast("string").alias("expected_unit"))
    rows = rows.withColumn("terminated", F.lit(True)).withColumn("special_token_leak", T.leaks_special(F.coalesce("completion", F.lit(""))))
    return M.scored(rows).select("conv_id", "turn", "parsed_answer", "repeated_phrase", "numeric_correct", "unit_correct", "format_valid", "task_correct")
