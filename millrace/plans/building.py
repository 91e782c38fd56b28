"""Queries that schedule, publish, compose, generate and cache, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import corpora as C
from millrace.operators import digests as D
from millrace.operators import generate as G
from millrace.operators import measures as M
from millrace.operators import quantise as Q
from millrace.operators import schedule as P
from millrace.operators import selection as S
from millrace.operators import tokens as K
from millrace.plans.catalog import _RESULTS_SQL, BYTES_SQL, _quantised_sql, _results
from millrace.plans.corpora import _DIGEST_SQL, _EXAMPLES_SQL, _RECORDS_SQL, _examples, _split
from millrace.plans.registry import as_long, query, table
from millrace.plans.streams import _packed
from millrace.sources import flat_shards, shards, sinks
from millrace.sources.cache import AnswerCache, canonical_payload
from millrace.sources.readers import counted, demand_none, first_reason, licence_gate, strict_lines

_UPDATES = 100
_WIDE = "regexp_replace(hex(encode({0})), '(..)', '\\100', 'g')"


@query(
    f"""WITH p AS (SELECT DISTINCT o_orderkey AS family_id, CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 1 END AS t FROM orders),
    h AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY sha256('lessons:' || family_id)) - 1 AS r FROM p),
    u AS (SELECT *, r // 2 + 1 AS u FROM h WHERE r < {2 * _UPDATES}),
    s AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY sha256('lessons:slots:' || family_id), t) - 1 AS slot FROM u)
    SELECT CAST(u AS INTEGER) AS "update", CAST(slot AS INTEGER) AS slot, 'policy-lessons:update-' || CASE WHEN u < 10 THEN '0' ELSE '' END || u || ':slot-' || slot AS schedule_id,
    CASE t WHEN 0 THEN 'arithmetic' ELSE 'physics_numeric' END AS task, CASE WHEN (r + u + t + 1) % 2 = 0 THEN 'direct' ELSE 'think' END AS mode, family_id FROM s"""
)
def prompt_schedule(spark, d):
    """Families of orders dealt to updates of two tasks and two modes; the validator has nothing against it."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("family_id"), F.when(F.col("o_custkey") % 2 == 0, P.TASKS[0]).otherwise(P.TASKS[1]).alias("task"))
    found = P.prompt_schedule(orders, "lessons", _UPDATES)
    demand_none(P.schedule_errors(found, _UPDATES), "a schedule out of balance")
    return found


@query(
    """WITH q AS (SELECT DISTINCT sha256(event_type || ':' || user_id) AS request, user_id, event_type FROM events),
    a AS (SELECT request, '{"event":"' || event_type || '","user":' || user_id || '}' AS payload FROM q WHERE user_id % 4 <> 1)
    SELECT q.request, sha256(a.payload) AS payload_sha256, CASE WHEN a.request IS NULL THEN 'miss' ELSE 'hit' END AS status FROM q LEFT JOIN a USING (request)"""
)
def cache_append(spark, d):
    """Two overlapping appends of canonical answers, then a probe of all requests. Requests of one user in four were never answered."""
    request = F.sha2(F.concat_ws(":", "event_type", "user_id"), 256).alias("request")
    asked = table(spark, d, "events").select(request, F.col("user_id").alias("user"), F.col("event_type").alias("event")).distinct()
    answers = canonical_payload(asked, "request").join(asked.where("user % 4 <> 1").select("request"), "request", "left_semi")
    cache = AnswerCache(spark, shards.scratch_folder(spark, "answers"), buckets=8)
    even = F.substring("request", 1, 1).isin(*"02468ace")
    cache.append(answers.where(even))
    cache.append(answers.where(~even | (F.substring("request", 2, 1) == "0")))
    return cache.probe(asked.select("request")).select("request", F.sha2("payload", 256).alias("payload_sha256"), F.when(F.col("payload").isNull(), "miss").otherwise("hit").alias("status"))


_REASONS = ["too_short", "too_long", "accepted"]


@query(
    f"""WITH {_RECORDS_SQL}, a AS (SELECT *, CASE WHEN b < 256 THEN 'too_short' WHEN b > 65536 THEN 'too_long' ELSE 'accepted' END AS reason FROM r)
    SELECT 'reason' AS part, reason AS name, count(*) AS n_rows, CAST(NULL AS BIGINT) AS tokens, CAST(NULL AS BIGINT) AS targets FROM a GROUP BY reason
    UNION ALL SELECT 'split', s.name, count(a.doc_id), CAST(coalesce(sum(b + 2), 0) AS BIGINT), CAST(coalesce(sum(b + 1), 0) AS BIGINT)
    FROM (VALUES ('train'), ('validation'), ('test')) s(name) LEFT JOIN a ON a.split = s.name AND reason = 'accepted' GROUP BY s.name"""
)
def observed_write(spark, d):
    """The gate's account and the manifest's totals, counted while the accepted records are written."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _split("doc_id").alias("split"))
    size = as_long(F.octet_length("text"))
    reason = first_reason([("too_short", size < 256), ("too_long", size > 65_536)])
    rows = docs.withColumns({"tokens": size + 2, "targets": size + 1, "reason": reason})
    account, totals = sinks.write_with_account(rows, shards.scratch_folder(spark, "observed"), "split", ["train", "validation", "test"], ["tokens", "targets"], _REASONS)
    nothing = F.lit(None).cast("long")
    counts = account.select(F.lit("reason").alias("part"), F.col("reason").alias("name"), "n_rows", nothing.alias("tokens"), nothing.alias("targets"))
    return counts.unionByName(totals.select(F.lit("split").alias("part"), F.col("split").alias("name"), F.col("rows").alias("n_rows"), "tokens", "targets"))


_ROLE = "CASE role WHEN 'user' THEN '0201' ELSE '0301' END"


@query(
    f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations),
    n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, t)),
    j AS (SELECT conv_id, CASE WHEN bool_or(i = 1 AND role <> 'user') THEN 'starts_with_user' WHEN bool_or(role <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END) THEN 'alternates'
      WHEN bool_or(t = '') THEN 'empty_turn' WHEN bool_or(i = n AND role <> 'assistant') THEN 'ends_with_assistant' WHEN sum(octet_length(encode(t)) + 1) + 2 > 4096 THEN 'too_long' ELSE 'accepted' END AS reason,
      '0001' || string_agg({_ROLE} || {_WIDE.format("t")}, '' ORDER BY i) || '0101' AS tokens, '00' || string_agg('00' || repeat(CASE role WHEN 'assistant' THEN '01' ELSE '00' END, octet_length(encode(t))), '' ORDER BY i) || '01' AS mask
      FROM n GROUP BY conv_id)
    SELECT conv_id, reason, CASE WHEN reason = 'accepted' THEN sha256(unhex(tokens)) END AS tokens_sha256, CASE WHEN reason = 'accepted' THEN sha256(unhex(mask)) END AS mask_sha256 FROM j"""
)
def conversation_tokens(spark, d):
    """Conversations as tokens with the mask of what assistants say, or why not."""
    found = K.conversation_records(table(spark, d, "conversations"), context=4096)
    return found.select("conv_id", "reason", F.sha2("tokens", 256).alias("tokens_sha256"), F.sha2("mask", 256).alias("mask_sha256"))


def _mode_rows(spark, d) -> DataFrame:
    """Pairs of turns in both modes as packed records, by half of their conversation."""
    rows = C.packed_modes(_examples(spark, d))
    side = F.when(F.col("family_id") % 2 == 0, "train").otherwise("test")
    return rows.select(side.alias("split"), F.concat_ws(":", "record_id", "mode").alias("record_id"), "tokens", "mask")


_SIDES = ("train", "test")
_MODES_SQL = f"""{_EXAMPLES_SQL}, t AS (SELECT record_id || ':direct' AS doc_id, family_id, '00010201' || {_WIDE.format("q")} || '03010601' || {_WIDE.format("a")} || '0101' AS tokens,
      repeat('00', octet_length(encode(q)) + 4) || repeat('01', octet_length(encode(a)) + 1) AS mask FROM e
      UNION ALL SELECT record_id || ':think', family_id, '00010201' || {_WIDE.format("q")} || '03010501' || {_WIDE.format("a")} || '0601' || {_WIDE.format("a")} || '0101',
      repeat('00', octet_length(encode(q)) + 4) || repeat('01', 2 * octet_length(encode(a)) + 2) FROM e),
    m AS (SELECT doc_id, CASE WHEN family_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, length(mask) // 2 AS n, length(replace(mask, '00', '')) // 2 AS ones, sha256(unhex(tokens || mask)) AS m FROM t)"""


@query(f"WITH {_MODES_SQL} SELECT split, count(*) AS records, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(ones) AS BIGINT) AS targets, {_DIGEST_SQL} AS digest FROM m GROUP BY split")
def mode_shards(spark, d):
    """Both modes of every pair published as flat files: what the manifest says, after every byte was verified."""
    folder = shards.scratch_folder(spark, "modes")
    flat_shards.publish_flat(_mode_rows(spark, d), folder, _SIDES)
    return _told(spark, flat_shards.verify_flat(spark, folder))


def _told(spark, manifest: dict) -> DataFrame:
    """A row for each split of a manifest."""
    rows = [(split, x["records"], x["tokens"], x["targets"], x["digest"]) for split, x in manifest["splits"].items()]
    return spark.createDataFrame(rows, "split string, records long, tokens long, targets long, digest string")


@query(
    f"""WITH {_RECORDS_SQL}, k AS (SELECT doc_id AS id, CASE WHEN split = 'train' THEN 'train' ELSE 'test' END AS split, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS part, b, sha256(unhex('0001' || {_WIDE.format("text")} || '0101' || '00' || repeat('01', b + 1))) AS m FROM r),
    m AS (SELECT split, b, part, m, row_number() OVER (ORDER BY part, id) AS doc_id FROM k)
    SELECT split, count(*) AS records, CAST(sum(b + 2) AS BIGINT) AS tokens, CAST(sum(b + 1) AS BIGINT) AS targets, {_DIGEST_SQL} AS digest,
    CASE WHEN split = 'train' THEN round(sum(CASE WHEN part = 0 THEN b + 2 ELSE 0 END) / CAST(sum(b + 2) AS DOUBLE), 9) END AS replay_fraction FROM m GROUP BY split"""
)
def composed_shards(spark, d):
    """Two published corpora behind each other, English after the replay of the other languages: one corpus, verified, with a digest composed of theirs."""
    rows = _packed(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "lang"), "record_id")
    rows = rows.withColumn("split", F.when(F.col("split") == "train", "train").otherwise("test"))
    english = F.col("lang").eqNullSafe("en")
    parts = {name: shards.scratch_folder(spark, name) for name in ("replay", "english")}
    flat_shards.publish_flat(rows.where(~english), parts["replay"], _SIDES)
    flat_shards.publish_flat(rows.where(english), parts["english"], _SIDES)
    manifest = flat_shards.compose_flat(spark, parts, shards.scratch_folder(spark, "composed"), replay="replay")
    share = F.when(F.col("split") == "train", F.round(F.lit(manifest["replay_train_fraction"]), 9))
    return _told(spark, manifest).withColumn("replay_fraction", share)


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
    r AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'missing_field' WHEN k % 13 = 0 THEN 'no_final_answer' WHEN k % 7 = 0 THEN 'annotation_count' WHEN k % 11 = 0 THEN 'invalid_annotation' WHEN k % 5 = 0 THEN 'final_mismatch' ELSE 'accepted' END AS early FROM a),
    t AS (SELECT *, 'Compute ' || n || ' * ' || q || ' = ' || (n * q) || '. Compute ' || (n * q) || ' + 1 = ' || (n * q + 1) || '.' AS one FROM r),
    u AS (SELECT *, CASE WHEN k % 3 = 0 THEN one || ' ' || one ELSE one END AS reasoning FROM t)
    SELECT l_orderkey, l_linenumber, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 5 = 0 THEN CAST(n * q + 2 AS VARCHAR) ELSE CAST(n * q + 1 AS VARCHAR) END AS exact_answer,
    CASE WHEN early = 'accepted' THEN sha256(reasoning) END AS reasoning_sha256, CASE WHEN early = 'accepted' THEN 'The answer is ' || (n * q + 1) || '.' END AS final_answer,
    CASE WHEN early = 'accepted' THEN 'gsm8k-' || substr(sha256('{"question":"how many are ' || n || ' times ' || q || ' and one? ' || k || '"}'), 1, 24) END AS family_id, early AS reason FROM u"""
)
def compact_problems(spark, d):
    """Worked problems of order lines, every rule with rows against it: compact solutions of verified steps."""
    n, q, k = F.col("l_linenumber"), F.col("q"), F.col("l_orderkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", as_long("l_quantity").alias("q"))
    first, last = n * q, n * q + 1
    steps = F.concat(F.lit("Take <<"), n, F.lit("*"), q, F.lit("="), first + F.when(k % 11 == 0, 1).otherwise(0), F.lit(">> and one: <<"), first, F.lit("+1="), last, F.lit(">>.\n"))
    steps = F.when(k % 7 == 0, F.lit("No steps.\n")).when(k % 3 == 0, F.concat(steps, steps)).otherwise(steps)
    answer = F.when(k % 13 == 0, steps).otherwise(F.concat(steps, F.lit("#### "), last + F.when(k % 5 == 0, 1).otherwise(0)))
    question = F.when(k % 17 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" How many are "), n, F.lit("  times "), q, F.lit(" and one? "), k))
    found = C.compact_problems(rows.select("l_orderkey", "l_linenumber", question.alias("question"), answer.alias("answer")))
    return found.select("l_orderkey", "l_linenumber", "exact_answer", F.sha2("reasoning", 256).alias("reasoning_sha256"), "final_answer", "family_id", "reason")


_DRAW = "CAST('0x' || substr(h, {0}, 8) AS BIGINT)"
_PLAIN_SQL = "regexp_replace(regexp_replace(CAST(CAST({0} AS DECIMAL(30, 6)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
_SIGN_SQL = "['+', '-', '*', '/'][{0} + 1]"
_OP_SQL = "CASE {0} WHEN '+' THEN {1} + {2} WHEN '-' THEN {1} - {2} WHEN '*' THEN CAST({1} * {2} AS DECIMAL(30, 6)) ELSE CAST(CAST({1} AS BIGINT) // greatest(CAST({2} AS BIGINT), 1) AS DECIMAL(30, 6)) END"


@query(
    f"""WITH n AS (SELECT count(*) AS quota FROM supplier),
    f AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) || ' * ' || l_linenumber || '00' AS expression FROM lineitem UNION SELECT DISTINCT CAST(l_quantity AS BIGINT) || ' + ' || (l_partkey % 1000) FROM lineitem),
    c AS (SELECT r.route, i.i AS counter, sha256('made:' || r.route || ':' || i.i) AS h FROM (VALUES ('integer'), ('decimal'), ('nested')) r(route), (SELECT unnest(range(0, (SELECT 6 * quota + 600 FROM n))) AS i) i),
    o AS (SELECT *, CASE route WHEN 'integer' THEN {_SIGN_SQL.format(_DRAW.format(1) + " % 4")} ELSE {_SIGN_SQL.format(_DRAW.format(1) + " % 3")} END AS op FROM c),
    b AS (SELECT *, CASE WHEN op = '/' THEN {_DRAW.format(17)} % 99 + 1 ELSE {_DRAW.format(17)} % 1000 END AS bb FROM o),
    a AS (SELECT *, CASE WHEN op = '/' THEN ({_DRAW.format(9)} % 99 + 1) * bb ELSE {_DRAW.format(9)} % 1000 END AS aa FROM b),
    x AS (SELECT route, counter, op, CAST(CASE route WHEN 'decimal' THEN CAST(aa AS DECIMAL(12, 2)) / 100 ELSE aa END AS DECIMAL(12, 2)) AS a, CAST(CASE route WHEN 'decimal' THEN CAST(bb AS DECIMAL(12, 2)) / 100 ELSE bb END AS DECIMAL(12, 2)) AS b,
      CASE route WHEN 'nested' THEN {_SIGN_SQL.format(_DRAW.format(25) + " % 3")} END AS oo, CAST({_DRAW.format(33)} % 100 AS DECIMAL(12, 2)) AS c FROM a),
    y AS (SELECT *, {_OP_SQL.format("op", "a", "b")} AS inside FROM x),
    z AS (SELECT *, CASE WHEN oo IS NULL THEN inside ELSE {_OP_SQL.format("oo", "inside", "c")} END AS result, {_PLAIN_SQL.format("a")} || ' ' || op || ' ' || {_PLAIN_SQL.format("b")} AS text FROM y),
    e AS (SELECT route, counter, CASE WHEN oo IS NULL THEN text ELSE '(' || text || ') ' || oo || ' ' || {_PLAIN_SQL.format("c")} END AS expression, {_PLAIN_SQL.format("result")} AS answer,
      text || ' = ' || {_PLAIN_SQL.format("inside")} || '.' || CASE WHEN oo IS NULL THEN '' ELSE ' ' || {_PLAIN_SQL.format("inside")} || ' ' || oo || ' ' || {_PLAIN_SQL.format("c")} || ' = ' || {_PLAIN_SQL.format("result")} || '.' END AS worked FROM z),
    w AS (SELECT *, row_number() OVER (PARTITION BY expression ORDER BY route, counter) AS first FROM e WHERE expression NOT IN (SELECT expression FROM f)),
    k AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY counter) AS place FROM w WHERE first = 1)
    SELECT route, counter, expression, answer, worked, 'arith-' || substr(sha256('{{"expression":"' || expression || '"}}'), 1, 20) AS family_id FROM k, n WHERE place <= quota"""
)
def generated_problems(spark, d):
    """Problems of three routes, as many of each as there are suppliers, none of a family that the order lines name."""
    lines = table(spark, d, "lineitem")
    whole = F.col("l_quantity").cast("long")
    named = [F.concat_ws(" ", whole, F.lit("*"), F.concat("l_linenumber", F.lit("00"))), F.concat_ws(" ", whole, F.lit("+"), F.col("l_partkey") % 1000)]
    frozen = lines.select(F.explode(F.array(*named)).alias("e")).distinct().select(G.family(F.col("e")).alias("family_id"))
    routes = F.explode(F.array(*map(F.lit, G.ROUTES))).alias("route")
    quotas = table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("quota")).select(routes, "quota")
    return G.problems(quotas, frozen, "made")


@query(
    f"""WITH {_RESULTS_SQL}, s AS (SELECT event_id % 3 AS seed, CAST(sum(CAST(correct AS BIGINT)) AS DOUBLE) AS a, CAST(sum(CAST(coalesce(consistent, false) AS BIGINT)) AS DOUBLE) AS b, 1.0 AS f FROM r GROUP BY 1),
    o AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') x JOIN (SELECT DISTINCT user_id FROM events WHERE value > 99.5) y USING (user_id)),
    g AS (SELECT count(*) AS n_seeds, count(*) FILTER (a > 1 AND b > 1) AS n_improving, count(*) = 3 AND avg(a) > 1 AND avg(b) > 1 AND count(*) FILTER (a > 1 AND b > 1) >= 2 AS good FROM s)
    SELECT h.holdout, n_seeds, n_improving, CASE h.holdout WHEN 'shared' THEN o.n ELSE 0 END AS n_overlap, good AND (h.holdout <> 'shared' OR o.n = 0) AS improved FROM g, o, (VALUES ('shared'), ('apart')) h(holdout)"""
)
def holdout_gate(spark, d):
    """The gate over three seeds with a holdout that shares families with the training data, and with one that does not."""
    seeds = _results(spark, d).groupBy((F.col("event_id") % 3).alias("seed")).agg(
        F.count_if("correct").cast("double").alias("primary"), F.count_if(F.coalesce("consistent", F.lit(False))).cast("double").alias("challenge"), F.lit(1.0).alias("format_rate"), F.lit(1.0).alias("mode_rate")
    )
    events = table(spark, d, "events")
    trained = events.where("event_type = 'purchase'").select(F.col("user_id").alias("family_id"))
    apart = events.select(F.col("user_id").alias("family_id")).join(trained.distinct(), "family_id", "left_anti")
    shared = events.where("value > 99.5").select(F.col("user_id").alias("family_id"))
    parts = [M.seed_gate(seeds, 1.0, 1.0, trained, held).select(F.lit(name).alias("holdout"), "n_seeds", "n_improving", "n_overlap", "improved") for name, held in (("shared", shared), ("apart", apart))]
    return parts[0].unionByName(parts[1])


@query(
    _quantised_sql(127, 32)
    + """, g AS (SELECT vec_id, max(abs(code * scale - x)) AS e, sqrt(avg(pow(code * scale - x, 2))) AS r, arg_max(i, x) AS best, arg_max(i, code * scale) AS near FROM (SELECT *, row_number() OVER (PARTITION BY vec_id) AS i FROM q) GROUP BY vec_id)
    SELECT vec_id, round(e, 9) AS max_error, round(r, 9) AS rmse, e <= 0.02 AND r <= 0.01 AS passed FROM g"""
)
def probe_gate(spark, d):
    """Vectors as logits, and the same after quantising to eight bits: errors and whether they are within limits made for that."""
    x = F.col("embedding").cast("array<double>")
    back = F.slice(Q.restored(Q.quantised(x, 32, 127)), 1, F.size(x))
    rows = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", x.alias("x"), back.alias("y"))
    found = rows.select("vec_id", *M.probe_gate(F.col("x"), F.col("y"), F.lit(1), F.lit(1), 0.02, 0.01))
    return found.select("vec_id", F.round("max_error", 9).alias("max_error"), F.round("rmse", 9).alias("rmse"), "passed")


_SIGNS_SQL = "t"
for _sign, _plain in T.SIGNS.items():
    _SIGNS_SQL = f"replace({_SIGNS_SQL}, '{_sign}', '{_plain.replace(chr(39), chr(39) * 2)}')"


@query(
    f"""WITH s AS (SELECT ['{"', '".join(T.SIGNS)}'] AS signs), d AS (SELECT doc_id, coalesce(text, '') || ' ' || signs[doc_id % {len(T.SIGNS)} + 1] || ' 4' AS t FROM documents, s),
    m AS (SELECT doc_id, trim(regexp_replace({_SIGNS_SQL}, '\\s+', ' ', 'g')) AS t FROM d)
    SELECT doc_id, sha256(t) AS maths_sha256, length(t) = octet_length(encode(t)) AS is_ascii FROM m"""
)
def ascii_maths(spark, d):
    """Texts with a typographic sign behind them: all signs in ASCII, white space as single blanks, and whether all is ASCII then."""
    sign = F.element_at(F.array(*map(F.lit, T.SIGNS)), (F.col("doc_id") % len(T.SIGNS) + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), sign, F.lit(" 4")).alias("t"))
    plain = T.squeeze(T.ascii_maths(F.col("t")))
    return docs.select("doc_id", plain.alias("t")).select("doc_id", F.sha2("t", 256).alias("maths_sha256"), (F.length("t") == F.octet_length("t")).alias("is_ascii"))


@query(
    """WITH s AS (SELECT DISTINCT source AS source_id, CASE CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 3 WHEN 0 THEN 'eligible' WHEN 1 THEN 'row-filtered' ELSE 'excluded' END AS policy FROM documents WHERE doc_id % 5 > 0 AND source <> 'src1'),
    r AS (SELECT source AS source_id, 'l' || (doc_id % 2) AS l FROM documents)
    SELECT CASE WHEN s.policy IS NULL THEN 'unknown_source' WHEN s.policy = 'excluded' THEN 'excluded_source' WHEN s.policy <> 'eligible' THEN 'not_eligible' WHEN r.l <> 'l1' THEN 'licence_mismatch' ELSE 'accepted' END AS reason, count(*) AS n_rows
    FROM r LEFT JOIN s ON r.source_id = s.source_id GROUP BY 1"""
)
def eligible_gate(spark, d):
    """The gate that refuses row-filtered sources too, against a registry made of the sources that there are."""
    docs = table(spark, d, "documents")
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int") % 3
    policy = F.when(number == 0, "eligible").when(number == 1, "row-filtered").otherwise("excluded")
    known = docs.where("doc_id % 5 > 0 AND source <> 'src1'").select(F.col("source").alias("source_id"), policy.alias("policy"), F.lit("l1").alias("license_id"), F.array(F.lit("l0")).alias("allowed_row_licenses")).distinct()
    records = docs.select(F.col("source").alias("source_id"), F.concat(F.lit("l"), F.col("doc_id") % 2).alias("license_id"))
    return counted(licence_gate(records, known, eligible_only=True), F.col("reason"))


_TRAIN_SQL = "CAST(CAST('0x' || substr(sha256('split-v1:' || CAST(p_partkey AS VARCHAR)), 1, 16) AS UBIGINT) % 10000 AS INTEGER) < 9000"


@query(
    f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'arithmetic' ELSE 'physics' END AS task FROM part WHERE {_TRAIN_SQL} AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)),
    r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY sha256('teacher:' || p_partkey), p_partkey) AS r FROM p)
    SELECT p_partkey, task, row_number() OVER (ORDER BY task, p_partkey) - 1 AS position FROM r WHERE r <= CASE task WHEN 'arithmetic' THEN 20 ELSE 15 END"""
)
def teacher_selection(spark, d):
    """Problems for a teacher: of the training split, of no frozen family, exactly so many of each task."""
    task = F.when(F.col("p_size") % 2 == 0, "arithmetic").otherwise("physics")
    frozen = table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    pool = table(spark, d, "part").select("p_partkey", task.alias("task"), _split("p_partkey").alias("split")).where("split = 'train'")
    return S.exactly_per_group(pool.join(frozen, "p_partkey", "left_anti"), "teacher", "p_partkey", "task", {"arithmetic": 20, "physics": 15})


@query(
    """SELECT event_id, sha256('{"messages":[{"content":"' || event_type || '","role":"user"},{"content":"caf\\u00e9","role":"assistant"}],"model":"m-' || (user_id % 3) || '","stop":null}') AS request FROM events"""
)
def request_hashes(spark, d):
    """Requests named by the hash of their canonical bodies: fields in order at every level, nulls kept, ASCII only."""
    events = table(spark, d, "events")
    turn = lambda role, content: F.named_struct(F.lit("role"), F.lit(role), F.lit("content"), content)
    body = events.select(F.lit(None).cast("string").alias("stop"), F.concat(F.lit("m-"), F.col("user_id") % 3).alias("model"), F.array(turn("user", F.col("event_type")), turn("assistant", F.lit("café"))).alias("messages"), "event_id")
    sent = body.select("event_id", sinks.canonical_rows(body.drop("event_id")).alias("body"))
    return sent.select("event_id", T.request_hash(F.col("body")).alias("request"))


@query(
    """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"facts":{"a":{"n":' || c_nationkey || ',"s":null},"z":{"n":1,"s":"' || c_mktsegment || '"}}}') AS row_sha256 FROM customer"""
)
def canonical_maps(spark, d):
    """Rows with a map of structs as canonical JSON: keys and fields in order."""
    fact = lambda n, s: F.struct(s.alias("s"), n.alias("n"))
    facts = F.create_map(F.lit("z"), fact(F.lit(1), F.col("c_mktsegment")), F.lit("a"), fact(F.col("c_nationkey"), F.lit(None).cast("string")))
    rows = table(spark, d, "customer").select(facts.alias("facts"), "c_custkey")
    return rows.select("c_custkey", F.sha2(sinks.canonical_rows(rows), 256).alias("row_sha256"))


@query("SELECT item_id, sha256(text || chr(10)) AS text_sha256, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS n_bytes FROM benchmark WHERE text IS NOT NULL")
def whole_files(spark, d):
    """Texts written as files of their own and read back whole, with their sizes and encoding checked."""
    folder = shards.scratch_folder(spark, "texts")
    table(spark, d, "benchmark").where("text IS NOT NULL").repartition("item_id").write.partitionBy("item_id").text(folder)
    found = shards.whole_texts(spark, f"{folder}/*/*.txt")
    item = as_long(F.regexp_extract("path", r"item_id=(-?\d+)", 1)).alias("item_id")
    return found.select(item, F.sha2("text", 256).alias("text_sha256"), as_long(F.octet_length("text")).alias("n_bytes"))


@query("SELECT count(*) AS n_rows, CAST(sum(c_custkey) AS BIGINT) AS keys, count(c_acctbal) AS n_balances FROM customer")
def strict_records(spark, d):
    """Published fields written as JSON lines and read back by a reader that stops at the first bad line."""
    rows = table(spark, d, "customer").withColumn("private", F.lit("x"))
    kept = sinks.allowed(rows, ["c_custkey", "c_name"], ["c_acctbal", "c_never"])
    folder = shards.scratch_folder(spark, "lines")
    kept.write.json(folder)
    read = strict_lines(spark, folder, "c_custkey long, c_name string, c_acctbal double", ["c_custkey", "c_name"], "c_custkey")
    return read.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c_custkey").alias("keys"), F.count("c_acctbal").alias("n_balances"))


@query(f"WITH {_RECORDS_SQL} SELECT split, count(*) AS records, CAST(sum(b + 2) AS BIGINT) AS tokens FROM r WHERE doc_id % 2 = 1 GROUP BY split")
def replaced_corpus(spark, d):
    """A published corpus replaced by another one under the same name; a note beside it is replaced too."""
    rows, folder = _packed(spark, d), shards.scratch_folder(spark, "replaced")
    shards.publish(rows.where("record_id % 2 = 0"), folder)
    shards.replace_corpus(spark, folder)
    shards.publish(rows.where("record_id % 2 = 1"), folder)
    for text in ('{"part":"even"}', '{"part":"odd"}'):
        shards.write_json(spark, folder, "note.json", text)
    demand_none(spark.read.json(f"{folder}/note.json").where("part <> 'odd'"), "an old note")
    return shards.load(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("records"), as_long(F.sum("n_tokens")).alias("tokens"))
