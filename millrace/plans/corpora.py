"""Queries that build and compare corpora, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import calculations
from millrace.functions import text as T
from millrace.operators import corpora as C
from millrace.operators import digests as D
from millrace.operators import selection as S
from millrace.operators import tokens as K
from millrace.plans.catalog import _NORMAL_SQL, _PAIRS_SQL, BUCKET_SQL, BYTES_SQL, SEED, SPLIT_SQL, _pairs
from millrace.plans.registry import as_long, query, table
from millrace.sources import shards, sinks
from millrace.sources import readers
from millrace.sources.readers import counted, first_reason

_BODY_SQL = "list_transform(range(1, length(hex(encode({0}))), 2), lambda i: CAST('0x' || substr(hex(encode({0})), i, 2) AS INTEGER))"
_SPLIT = SPLIT_SQL.format(BUCKET_SQL.format("{0}"))


def _split(key: str):
    return T.split_of(T.bucket(SEED, F.col(key)))


@query(
    f"""WITH d AS (SELECT doc_id, regexp_replace({_NORMAL_SQL}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS t, doc_id % 3 <> 0 AS scored, lang,
      CASE WHEN doc_id % 37 = 0 THEN NULL ELSE (doc_id % 41) / 40.0 END AS score, CASE WHEN doc_id % 29 <> 0 THEN doc_id % 7 END AS edu, CASE WHEN doc_id % 23 = 0 THEN ' ' ELSE 'u' END AS url FROM documents)
    SELECT scored, CASE WHEN trim(coalesce(t, '')) = '' THEN 'missing_text' WHEN trim(url) = '' THEN 'missing_url' WHEN scored AND lang IS DISTINCT FROM 'en' THEN 'language'
      WHEN scored AND coalesce(score < 0.9, true) THEN 'language_score' WHEN scored AND coalesce(edu < 4, true) THEN 'education' WHEN contains(t, chr(65533)) THEN 'replacement_character'
      WHEN regexp_matches(t, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}]') THEN 'control_character' WHEN octet_length(encode(t)) < 256 THEN 'too_short' WHEN octet_length(encode(t)) > 65536 THEN 'too_long'
      ELSE 'accepted' END AS reason, count(*) AS n_rows FROM d GROUP BY ALL"""
)
def web_gate(spark, d):
    """Scores are made of the id so that every rule has something to refuse; NaN stands for a missing one."""
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        T.normalise_public(F.col("text")).alias("text"), (k % 3 != 0).alias("scored"), "lang", F.when(k % 37 == 0, float("nan")).otherwise((k % 41) / 40).alias("score"),
        F.when(k % 29 != 0, k % 7).alias("edu"), F.when(k % 23 == 0, " ").otherwise("u").alias("url"),
    )
    reason = C.web_reason(*(F.col(c) for c in ("text", "url", "scored", "lang", "score", "edu")))
    return rows.groupBy("scored", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def _messages(spark, d) -> DataFrame:
    k, t = F.col("conv_id"), F.col("turn")
    name = F.concat(k, F.lit("-"), t)
    quality, toxic = ((k * 7 + t) % 10) / 10, F.when(k % 3 != 0, ((k * 3 + t) % 10) / 10)
    labels = F.struct(
        F.when(k % 13 == 0, F.array(F.lit("quality"))).otherwise(F.array(F.lit("spam"), F.lit("quality"), F.lit("toxicity"))).alias("name"), F.array(F.lit(0.0), quality, toxic).alias("value")
    )
    return table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select(
        name.alias("message_id"), F.when(t > 0, F.when(k % 11 == 0, "gone").otherwise(F.concat(k, F.lit("-"), t - 1))).alias("parent_id"),
        F.when(k % 19 == 0, F.concat(k, F.lit("/"), t)).otherwise(k.cast("string")).alias("message_tree_id"),
        F.when(F.col("m.role") == "user", "prompter").otherwise(F.col("m.role")).alias("role"), F.col("m.text").alias("text"), F.when(k % 5 == 0, "de").otherwise("en").alias("lang"),
        F.when(k % 7 != 3, k % 17 != 4).alias("review_result"), F.when(k % 23 == 1, "growing").otherwise("ready_for_export").alias("tree_state"), (k % 29 == 2).alias("synthetic"),
        (k % 31 == 3).alias("deleted"), F.when(k % 37 != 4, k % 41 % 2).alias("rank"), labels.alias("labels"),
    )


_LINES_SQL = "regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), ' ' || chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"
_MESSAGES_SQL = f"""m AS (SELECT conv_id AS k, turn AS t, min(ROW(role, text)) AS m FROM conversations GROUP BY ALL),
    p AS (SELECT a.k, a.t, {_LINES_SQL.format("struct_extract_at(u.m, 2)")} AS question, {_LINES_SQL.format("struct_extract_at(a.m, 2)")} AS answer, CASE WHEN u.k IS NULL OR a.k % 11 = 0 THEN 'parent' WHEN a.k % 7 = 3 OR a.k % 17 = 4 THEN 'review'
      WHEN a.k % 23 = 1 THEN 'tree_state' WHEN a.k % 29 = 2 THEN 'synthetic' WHEN a.k % 13 = 0 OR ((a.k * 7 + a.t) % 10) / 10.0 < 0.5 THEN 'quality' WHEN a.k % 3 <> 0 AND ((a.k * 3 + a.t) % 10) / 10.0 > 0.5 THEN 'toxicity'
      WHEN struct_extract_at(u.m, 1) IS DISTINCT FROM 'user' THEN 'prompt_role' WHEN a.k % 5 = 0 THEN 'language' WHEN a.k % 31 = 3 THEN 'deleted' WHEN a.k % 37 = 4 OR a.k % 41 % 2 <> 0 THEN 'rank' WHEN a.k % 19 = 0 THEN 'tree'
      WHEN u.t > 0 THEN 'root' END AS early FROM m a LEFT JOIN m u ON a.k = u.k AND a.t = u.t + 1 WHERE struct_extract_at(a.m, 1) = 'assistant'),
    r AS (SELECT k, t, coalesce(early, CASE WHEN question = '' OR answer = '' THEN 'empty' WHEN octet_length(encode(question)) + octet_length(encode(answer)) + 5 > 256 THEN 'context' ELSE 'accepted' END) AS reason FROM p)"""


@query(f"WITH {_MESSAGES_SQL} SELECT reason, count(*) AS n_rows FROM r GROUP BY reason")
def dialogue_rejects(spark, d):
    return counted(C.dialogue_pairs(_messages(spark, d)), F.col("reason"))


#: Few texts of the tables are so short that a pair fits into 256 tokens: the selection is made with more room.
SELECTED_CONTEXT = 8192
_ROOMY_SQL = _MESSAGES_SQL.replace("> 256", f"> {SELECTED_CONTEXT}")


@query(f"WITH {_ROOMY_SQL} SELECT k || '-' || t AS message_id, CAST(row_number() OVER (ORDER BY sha256('oasst:' || k || '-' || t), k || '-' || t) AS INTEGER) AS rank FROM r WHERE reason = 'accepted' ORDER BY rank LIMIT 40")
def dialogue_selected(spark, d):
    accepted = C.dialogue_pairs(_messages(spark, d), SELECTED_CONTEXT).where("reason = 'accepted'")
    return S.top_by_hash(accepted.select("message_id"), "oasst", "message_id", 40).select("message_id", "rank")


def _examples(spark, d) -> DataFrame:
    rows = _pairs(spark, d)
    return rows.select(F.concat("conv_id", F.lit("-"), "turn").alias("record_id"), F.col("conv_id").alias("family_id"), F.coalesce("q", F.lit("")).alias("prompt"), F.coalesce("a", F.lit("")).alias("reasoning"), F.coalesce("a", F.lit("")).alias("final"))


_EXAMPLES_SQL = f"{_PAIRS_SQL}, e AS (SELECT conv_id || '-' || turn AS record_id, conv_id AS family_id, coalesce(q, '') AS q, coalesce(a, '') AS a FROM p)"


@query(
    f"""WITH {_EXAMPLES_SQL}, n AS (SELECT family_id % 17 = 0 AS frozen, octet_length(encode(q)) + octet_length(encode(a)) + 5 > 256 AS x, octet_length(encode(q)) + 2 * octet_length(encode(a)) + 6 > 256 AS y FROM e)
    SELECT count(*) AS n_input, count(*) FILTER (frozen) AS n_frozen, count(*) FILTER (NOT frozen AND x) AS direct_rejects, count(*) FILTER (NOT frozen AND y) AS think_rejects,
    count(*) FILTER (NOT frozen AND NOT x AND NOT y) AS n_eligible FROM n"""
)
def paired_fit(spark, d):
    examples = _examples(spark, d)
    return C.paired_fit(examples, examples.where("family_id % 17 = 0").select("family_id"))[1]


@query(
    f"""WITH {_EXAMPLES_SQL}, b AS (SELECT *, {_BODY_SQL.format("q")} AS x, {_BODY_SQL.format("a")} AS y FROM e),
    t AS (SELECT record_id, family_id, 'direct' AS mode, [256, 258] || x || [259, 262] || y || [257] AS tokens, len(y) + 1 AS ones FROM b
      UNION ALL SELECT record_id, family_id, 'think', [256, 258] || x || [259, 261] || y || [262] || y || [257], 2 * len(y) + 2 FROM b)
    SELECT record_id, mode, {_SPLIT.format("family_id")} AS split, sha256(array_to_string(tokens, ',')) AS tokens_sha256, sha256(repeat('0', len(tokens) - ones) || repeat('1', ones)) AS mask_sha256 FROM t"""
)
def corpus_modes(spark, d):
    """Every pair in both modes: digests of the tokens themselves and of the loss mask."""
    records = C.mode_records(_examples(spark, d))
    mark = lambda c, by: F.sha2(F.array_join(F.transform(c, lambda x: x.cast("string")), by), 256)
    return records.select("record_id", "mode", _split("family_id").alias("split"), mark("tokens", ",").alias("tokens_sha256"), mark("mask", "").alias("mask_sha256"))


def _records(spark, d) -> DataFrame:
    """Documents as base records by split of their source's hash and id."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("record_id"), F.col("source").alias("family_id"), _split("doc_id").alias("split"))
    size = as_long(F.octet_length("text"))
    return docs.withColumns({"n_tokens": size + 2, "n_targets": size + 1})


_RECORDS_SQL = f"r AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_SPLIT.format('doc_id')} AS split, octet_length(encode(coalesce(text, ''))) AS b FROM documents)"


@query(
    f"""WITH {_RECORDS_SQL} SELECT split, CAST(grouping(split) AS INTEGER) AS is_total, count(*) AS records, count(DISTINCT source) AS families, CAST(sum(b + 2) AS BIGINT) AS tokens,
    CAST(sum(b + 1) AS BIGINT) AS targets FROM r GROUP BY ROLLUP (split)"""
)
def corpus_manifest(spark, d):
    return C.manifest(_records(spark, d))


@query(f"WITH {_RECORDS_SQL} SELECT doc_id AS record_id, split, CAST(sum(b + 2) OVER (PARTITION BY split ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - b - 2 AS BIGINT) AS \"offset\", b + 2 AS n_tokens FROM r")
def record_offsets(spark, d):
    return C.placed_records(_records(spark, d).select("record_id", "split", "n_tokens")).select("record_id", "split", "offset", "n_tokens")


@query(
    f"""WITH {_RECORDS_SQL}, h AS (SELECT doc_id, split, b, hex(encode(text)) AS h FROM r),
    u AS (SELECT *, '0001' || regexp_replace(h, '(..)', '\\100', 'g') || '0101' AS w FROM h)
    SELECT doc_id AS record_id, split, b + 2 AS n_tokens, b + 1 AS n_targets, sha256(unhex(w)) AS tokens_sha256 FROM u"""
)
def packed_shards(spark, d):
    """All records published as packed shards, loaded again and verified."""
    rows = _records(spark, d).select("split", "record_id", "family_id", K.packed_base(F.col("text")).alias("r"))
    folder = shards.scratch_folder(spark, "shards")
    shards.publish(rows.select("split", "record_id", "family_id", "r.tokens", "r.mask"), folder)
    return shards.load(spark, folder).select("record_id", "split", "n_tokens", "n_targets", "tokens_sha256")


@query(
    f"""WITH {_RECORDS_SQL} SELECT split, count(*) AS records, CAST(sum(b + 2) AS BIGINT) AS tokens, CAST(sum(b + 1) AS BIGINT) AS targets,
    round(sum(CASE WHEN lang = 'en' THEN 0 ELSE b + 1 END) / CAST(sum(b + 1) AS DOUBLE), 9) AS replay_fraction FROM r GROUP BY split"""
)
def compose_corpora(spark, d):
    """Two corpora put together split by split: English as the new one, the other languages as replay."""
    rows = _records(spark, d)
    whole = C.union_records([("new", rows.where("lang <=> 'en'")), ("replay", rows.where("NOT lang <=> 'en'"))], "record_id")
    return C.composed(whole, "replay")


_FOLD_SQL = "list_reduce(list_prepend(CAST(0 AS HUGEINT), list(CAST(CAST('0x' || substr(m, {0}, 15) AS BIGINT) AS HUGEINT) ORDER BY doc_id, m)), lambda h, x: (h * {1} + x) % {2})"
_DIGEST_SQL = "format('{{:016x}}', CAST({} AS BIGINT)) || format('{{:016x}}', CAST({} AS BIGINT))".format(*(_FOLD_SQL.format(15 * i + 1, base, D.PRIME) for i, base in enumerate(D.BASES)))


@query(
    f"""WITH {_RECORDS_SQL}, m AS (SELECT doc_id, split, sha256(text) AS m FROM r)
    SELECT split, count(*) AS records, {_DIGEST_SQL} AS digest, split <> 'train' AS unchanged FROM m WHERE doc_id % 2 = 0 OR split = 'train' GROUP BY split"""
)
def extend_corpus(spark, d):
    """New rows reach the training split only; the other splits stay the same to the byte."""
    rows = _records(spark, d)
    return C.extended(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "record_id", F.sha2("text", 256))[1]


@query("SELECT user_id AS family_id FROM events WHERE value > 99 UNION SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0")
def exclusion_union(spark, d):
    """Families that any of three frozen sets names."""
    sets = [
        table(spark, d, "events").where("value > 99").select(as_long("user_id").alias("family_id")),
        table(spark, d, "orders").where("o_orderkey % 50 = 0").select(as_long("o_custkey").alias("family_id")),
        table(spark, d, "customer").where("c_custkey % 10 = 0").select(as_long("c_custkey").alias("family_id")),
    ]
    return sets[0].union(sets[1]).union(sets[2]).distinct()


@query(
    """WITH c AS (SELECT conv_id, list(DISTINCT role) AS f FROM conversations WHERE role IS NOT NULL GROUP BY conv_id)
    SELECT conv_id, array_to_string(list_sort(list_filter(['assistant', 'system', 'user'], lambda x: NOT list_contains(f, x))), ',') AS missing,
    array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(['assistant', 'system', 'user'], x))), ',') AS unknown FROM c"""
)
def key_difference(spark, d):
    """Keys that should be there and are not, and those that should not."""
    known = F.array(*map(F.lit, ("assistant", "system", "user")))
    found = table(spark, d, "conversations").where("role IS NOT NULL").groupBy("conv_id").agg(F.collect_set("role").alias("f"))
    join = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return found.select("conv_id", join(known, F.col("f")).alias("missing"), join(F.col("f"), known).alias("unknown"))


@query(
    """WITH k AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY sha256('audit:' || user_id), user_id LIMIT 20)
    SELECT event_type, count(*) AS n_rows, round(sum(value), 4) AS total FROM events WHERE user_id IN (SELECT user_id FROM k) GROUP BY event_type"""
)
def selected_audit(spark, d):
    """A semi-join: the examples of the selected families only."""
    events = table(spark, d, "events")
    chosen = S.top_by_hash(events.select("user_id").distinct(), "audit", "user_id", 20).select("user_id")
    return events.join(chosen, "user_id", "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """WITH q AS (SELECT DISTINCT sha256(event_type || ':' || user_id) AS request, user_id FROM events), c AS (SELECT request, user_id * 3 AS answer FROM q WHERE user_id % 4 <> 1)
    SELECT q.request, c.answer, CASE WHEN c.request IS NULL THEN 'miss' ELSE 'hit' END AS status FROM q LEFT JOIN c USING (request)"""
)
def cache_hits(spark, d):
    """Requests joined with the cache: hits bring their answer, misses have yet to be computed."""
    request = F.sha2(F.concat_ws(":", "event_type", "user_id"), 256).alias("request")
    asked = table(spark, d, "events").select(request, "user_id").distinct()
    cache = asked.where("user_id % 4 <> 1").select("request", (as_long("user_id") * 3).alias("answer"))
    return C.probed(asked.select("request"), cache)


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 5 <> 0), b AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 3)
    SELECT count(*) FILTER (a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL) AS n_both, count(*) FILTER (b.l_orderkey IS NULL) AS n_left_only, count(*) FILTER (a.l_orderkey IS NULL) AS n_right_only
    FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"""
)
def answer_alignment(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return C.aligned(rows.where("l_orderkey % 5 <> 0"), rows.where("l_linenumber <> 3"), ["l_orderkey", "l_linenumber"])


@query(
    """SELECT l_orderkey, l_linenumber, 'C' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY sha256('alias:' || l_orderkey || '-' || l_linenumber)) - 1) AS alias FROM lineitem"""
)
def candidate_alias(spark, d):
    """Candidates under names that say nothing of their place."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    line = W.partitionBy("l_orderkey").orderBy(T.seeded("alias", F.concat("l_orderkey", F.lit("-"), "l_linenumber")))
    return rows.select("l_orderkey", "l_linenumber", F.concat(F.lit("C"), F.row_number().over(line) - 1).alias("alias"))


@query(
    """WITH c AS (SELECT event_type AS task, count(*) AS n FROM events GROUP BY 1) SELECT task, n AS n_available, least(n, 30) AS n_selected, n >= 30 AS complete FROM c"""
)
def exactly_k(spark, d):
    """So many of each task, and whether there were enough before the rest was cut off."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("task"), "event_id")
    chosen = S.top_by_hash(rows, "k", "event_id", 30, ["task"]).groupBy("task").agg(F.count(F.lit(1)).alias("n_selected"))
    found = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n_available")).join(chosen, "task")
    return found.select("task", "n_available", "n_selected", (F.col("n_available") >= 30).alias("complete"))


@query(f"SELECT doc_id, sha256(source || chr(0) || 'rev-1' || chr(0) || 'documents.parquet' || chr(0) || doc_id) AS identity, sha256(text) AS text_sha256, {BYTES_SQL} AS n_bytes FROM documents")
def provenance(spark, d):
    """Where each document is from, without its text."""
    docs = table(spark, d, "documents")
    mark = T.identity(F.col("source"), F.lit("rev-1"), F.lit("documents.parquet"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", mark.alias("identity"), F.sha2("text", 256).alias("text_sha256"), as_long(F.octet_length("text")).alias("n_bytes"))


@query(
    f"""SELECT doc_id, sha256(regexp_replace({_NORMAL_SQL}, '\\n{{3,}}', chr(10) || chr(10), 'g')) AS public_sha256, sha256({_LINES_SQL.format("text")}) AS lines_sha256,
    sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS single_sha256 FROM documents"""
)
def normal_forms(spark, d):
    """Three normal forms of the texts."""
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id", F.sha2(T.normalise_public(F.col("text")), 256).alias("public_sha256"), F.sha2(T.normalise_lines(F.col("text")), 256).alias("lines_sha256"), F.sha2(T.squeeze(F.col("text")), 256).alias("single_sha256")
    )


@query(
    """SELECT c_custkey, 'gsm8k-' || substr(sha256('{"answer":"' || c_name || '","question":"' || c_mktsegment || '"}'), 1, 24) AS record_id, 'arith-' || substr(sha256('{"key":' || c_custkey || '}'), 1, 20) AS variant_id FROM customer"""
)
def stable_ids(spark, d):
    rows = table(spark, d, "customer")
    row = F.to_json(F.struct(F.col("c_name").alias("answer"), F.col("c_mktsegment").alias("question")))
    return rows.select("c_custkey", T.stable_id("gsm8k", row).alias("record_id"), T.stable_id("arith", F.to_json(F.struct(F.col("c_custkey").alias("key"))), 20).alias("variant_id"))


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, l_orderkey % 11 = 0 AS off, l_orderkey % 13 = 0 AS bare FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN bare THEN NULL ELSE CAST(n * q + 1 AS VARCHAR) END AS final, CASE WHEN bare THEN NULL ELSE 'Take ' || n || ' times ' || q || ' = ' || (n * q) || ' and add one: ' || (n * q + 1) || '.' END AS reasoning,
    CAST(2 AS BIGINT) AS n_annotations, CASE WHEN off OR bare THEN NULL ELSE n || ' * ' || q || ' = ' || (n * q) || '; ' || (n * q) || ' + 1 = ' || (n * q + 1) END AS steps FROM a"""
)
def worked_answers(spark, d):
    """Worked answers: the final number, the reasoning without annotations, and the steps if each is right and the last is the answer."""
    n, q, k = F.col("l_linenumber"), F.col("q"), F.col("l_orderkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", as_long("l_quantity").alias("q"))
    first, last = n * q, n * q + 1
    shown = first + F.when(k % 11 == 0, 1).otherwise(0)
    answer = F.concat(F.lit("Take  "), n, F.lit(" times "), q, F.lit(" = <<"), n, F.lit("*"), q, F.lit("="), shown, F.lit(">>"), first, F.lit("\nand add one: <<"), first, F.lit("+1="), last, F.lit(">>"), last, F.lit(".\n"))
    rows = rows.withColumn("answer", F.when(k % 13 == 0, answer).otherwise(F.concat(answer, F.lit("#### "), last)))
    rows = rows.withColumn("found", T.annotations(F.col("answer")))
    # An answer has four steps at most; more are not verified and refuse it.
    checked = F.array(*[calculations.verified(F.try_element_at("found", F.lit(i))) for i in range(1, 5)])
    rows = rows.withColumn("s", F.slice(checked, 1, F.size("found")))
    final = T.final_number(F.col("answer"))
    right = F.forall("s", lambda x: x["error"].isNull()) & F.size("found").between(1, 4) & F.try_element_at("s", F.lit(-1))["result"].eqNullSafe(final)
    text = F.array_join(F.transform("s", lambda x: F.concat(x["expression"], F.lit(" = "), x["result"])), "; ")
    return rows.select("l_orderkey", "l_linenumber", final.alias("final"), T.worked_answer(F.col("answer")).alias("reasoning"), as_long(F.size("found")).alias("n_annotations"), F.when(right, text).alias("steps"))


# Formula, unit of the result, operation.
FORMULAS = [
    ("density", "rho = m / V", "kg/m^3", "divide"),
    ("force", "F = m a", "N", "multiply"),
    ("kinetic-energy", "K = 1/2 m v^2", "J", "kinetic"),
    ("momentum", "p = m v", "kg*m/s", "multiply"),
    ("ohms-law", "V = I R", "V", "multiply"),
    ("power", "P = E / t", "W", "divide"),
    ("pressure", "p = F / A", "Pa", "divide"),
    ("speed", "v = d / t", "m/s", "divide"),
    ("wave-speed", "v = f lambda", "m/s", "multiply"),
    ("weight", "W = m g", "N", "multiply"),
]
_FORMULAS_SQL = "f(i, formula, symbol, unit, op) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}', '{e}')" for i, (a, b, c, e) in enumerate(FORMULAS)) + ")"
_TRIM_SQL = "regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


@query(
    f"""WITH {_FORMULAS_SQL}, p AS (SELECT p_partkey, p_size AS l, [1, 2, 4, 5, 8][p_partkey % 5 + 1] AS r, f.* FROM part JOIN f ON p_partkey % 10 = f.i),
    x AS (SELECT *, CASE op WHEN 'multiply' THEN CAST(l * r AS DECIMAL(18, 3)) WHEN 'divide' THEN CAST(l / r AS DECIMAL(18, 3)) ELSE CAST(l * r * r / 2 AS DECIMAL(18, 3)) END AS v FROM p)
    SELECT p_partkey, formula, {_TRIM_SQL.format("v")} AS answer, p_partkey % 6 <> 0 AS verified, 'Use ' || symbol || '. Substitute ' || CASE op WHEN 'kinetic' THEN '0.5 * ' || l || ' * ' || r || '^2' WHEN 'divide' THEN l || ' / ' || r
      ELSE l || ' * ' || r END || ' = ' || {_TRIM_SQL.format("v")} || ' ' || unit || '.' AS reasoning, {_TRIM_SQL.format("v + 1")} || ' ' || unit AS negative FROM x"""
)
def physics_verify(spark, d):
    """Answers of ten formulas computed again in decimals, their reasoning and a wrong answer near by. The formulas are ten rows."""
    rows = [(i, *f) for i, f in enumerate(FORMULAS)]
    formulas = F.broadcast(spark.createDataFrame(rows, "i int, formula string, symbol string, unit string, op string"))
    r = F.element_at(F.array(*map(F.lit, (1, 2, 4, 5, 8))), (F.col("p_partkey") % 5 + 1).cast("int"))
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("decimal(10,0)").alias("l"), r.cast("decimal(10,0)").alias("r"), (F.col("p_partkey") % 10).cast("int").alias("i"))
    left, right = F.col("l"), F.col("r")
    value = F.when(F.col("op") == "multiply", (left * right).cast("decimal(38,18)")).when(F.col("op") == "divide", (left / right).cast("decimal(38,18)")).otherwise((left * right * right / 2).cast("decimal(38,18)"))
    part = part.join(formulas, "i").withColumn("v", value)
    given = F.col("v") + F.when(F.col("p_partkey") % 6 == 0, 1).otherwise(0)
    shown = F.when(F.col("op") == "kinetic", F.concat(F.lit("0.5 * "), left, F.lit(" * "), right, F.lit("^2"))).when(F.col("op") == "divide", F.concat(left, F.lit(" / "), right)).otherwise(F.concat(left, F.lit(" * "), right))
    answer = T.plain_decimal(F.col("v"))
    reasoning = F.concat(F.lit("Use "), "symbol", F.lit(". Substitute "), shown, F.lit(" = "), answer, F.lit(" "), "unit", F.lit("."))
    return part.select("p_partkey", "formula", answer.alias("answer"), (given == F.col("v")).alias("verified"), reasoning.alias("reasoning"), F.concat(T.plain_decimal(F.col("v") + 1), F.lit(" "), "unit").alias("negative"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey % 9 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    s AS (SELECT l_orderkey AS request, k, n, max((i * 3 + l_orderkey) % 5) AS best, min(i) FILTER ((i * 3 + l_orderkey) % 5 = 4) AS top FROM r GROUP BY ALL)
    SELECT request, CASE WHEN k = 1 THEN 'invalid_json' WHEN k = 2 THEN 'keys' WHEN k = 3 THEN 'candidates' WHEN k = 4 THEN 'score_range' WHEN k = 5 AND best > 0 AND (SELECT (0 * 3 + request) % 5) <> best THEN 'preferred' ELSE 'accepted' END AS reason FROM s"""
)
def judge_responses(spark, d):
    """Answers of a judge, as lists and as objects: exact keys, the same candidates, scores from 0 to 4, the preferred one among the best."""
    from millrace.operators.evaluation import judged

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    at = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    rows = rows.select(F.col("l_orderkey").alias("request"), at.alias("i"), ((at * 3 + F.col("l_orderkey")) % 5).alias("score"))
    each = rows.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("i", "score"))).alias("s"))  # seven candidates at most
    k = F.col("request") % 9
    names = F.transform("s", lambda x: F.concat(F.lit("C"), x["i"]))
    scores = F.transform("s", lambda x: F.when(k == 4, x["score"] + 5).otherwise(x["score"]))
    asked = F.when(k == 3, F.concat(names, F.array(F.lit("C99")))).otherwise(names)
    listed = F.to_json(F.transform(F.arrays_zip(names.alias("candidate_id"), scores.alias("score")), lambda x: F.struct(x["candidate_id"].alias("candidate_id"), x["score"].alias("score"))))
    mapped = F.to_json(F.map_from_arrays(names, scores))
    best = F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))
    preferred = F.when(k == 5, "C0").otherwise(best)
    body = F.concat(F.lit('{"preferred":"'), preferred, F.lit('","scores":'), F.when(k % 2 == 0, listed).otherwise(mapped), F.when(k == 2, ',"more":1}').otherwise("}"))
    return judged(each.select("request", asked.alias("candidates"), F.when(k == 1, F.lit("{no")).otherwise(body).alias("response"))).select("request", "reason")


@query(
    """WITH r AS (SELECT 'physics' AS task, p_partkey AS k, '{"id":' || p_partkey || ',"prompt":"' || p_name || '"}' AS body FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 10 <> 0
      UNION ALL SELECT 'arithmetic', p_partkey, '{"id":' || p_partkey || ',"prompt":"' || p_name || '"}' FROM part WHERE p_partkey % 2 = 1),
    s AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY sha256('plan:' || k), k) AS n FROM r)
    SELECT task, count(*) AS n_requests, CAST(sum(octet_length(encode(body))) AS BIGINT) AS n_bytes, max(octet_length(encode(body))) AS largest, sum(octet_length(encode(body))) <= 4000 AND count(*) <= 64 AS within_budget FROM s WHERE n <= 64 GROUP BY task"""
)
def request_plan(spark, d):
    """Which problems to ask: not frozen, the first of each task by hash, and whether the requests stay within the budget of bytes."""
    part = table(spark, d, "part")
    task = F.when(F.col("p_partkey") % 2 == 0, "physics").otherwise("arithmetic")
    frozen = part.where("p_partkey % 10 = 0").select("p_partkey")
    rows = part.join(frozen, "p_partkey", "left_anti").select(task.alias("task"), F.col("p_partkey").alias("k"), F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"))).alias("body"))
    size = as_long(F.octet_length("body"))
    return S.top_by_hash(rows, "plan", "k", 64, ["task"]).groupBy("task").agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum(size).alias("n_bytes"), F.max(size).alias("largest"), ((F.sum(size) <= 4000) & (F.count(F.lit(1)) <= 64)).alias("within_budget")
    )


@query(
    """WITH v AS (SELECT ch, row_number() OVER (ORDER BY encode(ch)) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark) WHERE ch <> ''),
    c AS (SELECT item_id, unnest(string_split(text, '')) AS ch FROM benchmark)
    SELECT item_id, count(*) AS n_tokens, CAST(sum(id) AS BIGINT) AS id_sum, CAST(max(id) AS BIGINT) AS largest FROM c JOIN v USING (ch) GROUP BY item_id"""
)
def char_ids(spark, d):
    """Texts as ids of a character vocabulary; the vocabulary has as many rows as the alphabet and its size is checked."""
    chars = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    vocabulary = K.vocabulary(chars.select("ch"))
    return chars.join(vocabulary, "ch").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(as_long("id")).alias("id_sum"), F.max(as_long("id")).alias("largest"))


@query("SELECT CASE WHEN regexp_matches(coalesce(text, ''), '[^\\x00-\\x7f]') THEN 'unicode' ELSE 'ascii' END AS kind, count(*) AS n_rows, count(*) AS n_same, CAST(0 AS BIGINT) AS n_special FROM documents GROUP BY 1")
def byte_roundtrip(spark, d):
    """Bytes become the text again, and a special token among them is refused."""
    docs = table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text")).withColumn("ids", K.byte_ids(F.col("text")))
    docs = docs.select("text", K.text_of(F.col("ids")).alias("back"), K.text_of(F.concat("ids", F.array(F.lit(K.EOS)))).alias("special"))
    kind = F.when(F.col("text").rlike(r"[^\x00-\x7f]"), "unicode").otherwise("ascii")
    return docs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("back") == F.col("text")).alias("n_same"), F.count("special").alias("n_special"))


@query(
    """SELECT CASE WHEN p_name IS NULL OR p_name = '' THEN 'empty' WHEN p_size % 2 = 0 AND p_partkey % 9 = 0 THEN 'unit' WHEN p_size % 2 = 1 AND p_partkey % 7 = 0 THEN 'formula' ELSE 'accepted' END AS reason, count(*) AS n_rows FROM part GROUP BY 1"""
)
def field_rules(spark, d):
    """Invariants of a problem: a prompt in ASCII, and a unit and a formula for physics only."""
    even = F.col("p_size") % 2 == 0
    rows = table(spark, d, "part").select(
        F.when(even, "physics").otherwise("arithmetic").alias("task"), F.col("p_name").alias("prompt"), F.when(even & (F.col("p_partkey") % 9 != 0), "N").alias("unit"),
        F.when(even | (F.col("p_partkey") % 7 == 0), "force").alias("formula"),
    )
    physics = F.col("task") == "physics"
    rules = [
        ("empty", F.coalesce(F.col("prompt"), F.lit("")) == ""),
        ("not_ascii", F.col("prompt").rlike(r"[^\x00-\x7F]")),
        ("unit", physics != F.col("unit").isNotNull()),
        ("formula", physics != F.col("formula").isNotNull()),
    ]
    return counted(rows, first_reason(rules))


@query("SELECT conv_id, sha256('{\"kind\":\"conversation\",\"turns\":[' || string_agg('{\"content\":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',\"role\":' || CAST(to_json(role) AS VARCHAR) || '}', ',' ORDER BY turn, role, text) || ']}') AS mark FROM conversations GROUP BY conv_id")
def conversation_marks(spark, d):
    """The fingerprint of each conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return rows.select("conv_id", T.turns_fingerprint(F.col("t")).alias("mark"))


@query("SELECT c_custkey, '{\"a\":' || CAST(to_json(c_name) AS VARCHAR) || ',\"b\":' || c_nationkey || ',\"c\":null}' AS line FROM customer")
def canonical_lines(spark, d):
    """Canonical JSON: names in order, nulls kept, NaN refused."""
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("b"), F.col("c_name").alias("a"), F.lit(None).cast("double").alias("c"))
    return rows.select("c_custkey", sinks.canonical_rows(rows.select("c", "b", "a")).alias("line"))


@query(
    """WITH r AS (SELECT p_partkey AS k, p_size AS n FROM part)
    SELECT CASE WHEN k % 11 = 0 THEN 'invalid_json' WHEN k % 7 = 0 THEN 'missing_field' WHEN k % 5 = 0 THEN 'no_final_answer' WHEN k % 3 = 0 THEN 'too_long' ELSE 'accepted' END AS reason, count(*) AS n_rows,
    CAST(sum(CASE WHEN k % 11 <> 0 AND k % 7 <> 0 AND k % 5 <> 0 THEN n * 1000 END) AS BIGINT) AS total FROM r GROUP BY 1"""
)
def word_problem_rejects(spark, d):
    """Lines of word problems made of parts, with why each is refused and the sum of the final answers that were read."""
    k = F.col("p_partkey")
    number = F.concat(F.lit("some steps\n#### "), F.col("p_size"), F.lit(",000"))
    question = F.when(k % 7 == 0, "").when(k % 3 == 0, F.repeat(F.lit("long "), 60)).otherwise("How many?")
    line = F.to_json(F.struct(question.alias("question"), F.when(k % 5 == 0, "no number").otherwise(number).alias("answer")))
    rows = readers.parsed_problems(table(spark, d, "part").select(F.when(k % 11 == 0, "{").otherwise(line).alias("value")))
    final = F.when(F.col("reason").isin("accepted", "too_long"), F.col("final").cast("long"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(final).alias("total"))


@query("SELECT task, count(*) AS n_rows, count(DISTINCT family_id) AS n_families FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'arithmetic' ELSE 'physics' END AS task, c_custkey AS family_id FROM customer) GROUP BY task")
def evaluation_gate(spark, d):
    """An evaluation set that passes all its gates: fields, tasks and a family of its own for each row."""
    k = F.col("c_custkey").cast("string")
    rows = table(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, "arithmetic").otherwise("physics").alias("task"), F.col("c_name").alias("prompt"), k.alias("expected_answer"), k.alias("family_id"), F.col("c_mktsegment").alias("source_id")
    )
    return readers.gated_evaluation(rows, ["arithmetic", "physics"]).groupBy("task").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("family_id").alias("n_families"))


_GRID_SQL = """g AS (SELECT i // 63 AS l, (i // 3) % 21 AS r, ['+', '-', '*'][i % 3 + 1] AS op FROM range(0, 1323) t(i)), f AS (SELECT l, r, op, l || op || r AS family FROM g)"""


@query(
    f"""WITH {_GRID_SQL}, t AS (SELECT DISTINCT l_linenumber || '*' || (l_partkey % 21) AS family FROM lineitem),
    h AS (SELECT family, sha256('holdout:' || family) AS h FROM f WHERE {BUCKET_SQL.format("family")} >= 9500 AND family NOT IN (SELECT family FROM t))
    SELECT family, CAST(row_number() OVER (ORDER BY h, family) AS INTEGER) AS rank FROM h ORDER BY rank LIMIT 32"""
)
def easy_holdout(spark, d):
    """Small calculations of the test split that no training family has, the first by hash."""
    i = F.col("id")
    left, right, op = F.floor(i / 63), F.floor(i / 3) % 21, F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("*")), (i % 3 + 1).cast("int"))
    grid = spark.range(21 * 21 * 3).select(F.concat(left, op, right).alias("family"))
    seen = table(spark, d, "lineitem").select(F.concat("l_linenumber", F.lit("*"), F.col("l_partkey") % 21).alias("family")).distinct()
    held = grid.where(_split("family") == "test").join(seen, "family", "left_anti")
    return S.top_by_hash(held, "holdout", "family", 32).select("family", "rank")


@query(
    """SELECT 'flag' AS counter, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'steps', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'tax', CAST(l_partkey % 5 AS VARCHAR), count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'operator', ['+', '-', '*', '/'][l_suppkey % 4 + 1], count(*) FROM lineitem GROUP BY 2"""
)
def value_counters(spark, d):
    """Five counters in one pass over the rows."""
    rows = table(spark, d, "lineitem")
    op = F.element_at(F.array(*map(F.lit, "+-*/")), (F.col("l_suppkey") % 4 + 1).cast("int"))
    parts = {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "steps": F.col("l_linenumber").cast("string"), "tax": (F.col("l_partkey") % 5).cast("string"), "operator": op}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("counter"), c.alias("value")) for name, c in parts.items()]))
    return rows.select(each.alias("c")).groupBy("c.counter", "c.value").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH a AS (SELECT l_partkey AS p, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 9 AS k FROM lineitem),
    s AS (SELECT CASE k WHEN 0 THEN '- (' || n || ' - ' || q || ') * 2' WHEN 1 THEN q || ' / 8' WHEN 2 THEN q || ' / 1000 + ' || n WHEN 8 THEN '((' || n || ' + 1)) * 1,000' END AS expression,
      CASE k WHEN 0 THEN CAST((q - n) * 2 AS VARCHAR) WHEN 1 THEN regexp_replace(regexp_replace(CAST(CAST(q / 8.0 AS DECIMAL(18, 3)) AS VARCHAR), '0+$', ''), '\.$', '') WHEN 2 THEN regexp_replace(regexp_replace(CAST(CAST(q / 1000.0 + n AS DECIMAL(18, 3)) AS VARCHAR), '0+$', ''), '\.$', '')
      WHEN 8 THEN CAST((n + 1) * 1000 AS VARCHAR) END AS result,
      CASE k WHEN 3 THEN 'no finite decimal' WHEN 4 THEN 'division by zero' WHEN 5 THEN 'syntax' WHEN 6 THEN 'nesting' WHEN 7 THEN 'one equals sign' END AS error FROM a)
    SELECT expression, result, error, count(*) AS n FROM s GROUP BY ALL"""
)
def annotation_shapes(spark, d):
    """Annotations of many shapes: signs, brackets, separators, decimals, and each way to be wrong."""
    n, q, k = F.col("l_linenumber"), F.col("q"), F.col("l_suppkey") % 9
    rows = table(spark, d, "lineitem").select("l_linenumber", "l_suppkey", as_long("l_quantity").alias("q"))
    join = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    text = (
        F.when(k == 0, join("-(", n, "-", q, ")*2=", (q - n) * 2))
        .when(k == 1, join(q, "/8=", (q / 8).cast("decimal(18,3)")))
        .when(k == 2, join(q, "/1000+", n, "=", (q / 1000 + n).cast("decimal(18,3)")))
        .when(k == 3, "1/3=0.33").when(k == 4, join(q, "/(1-1)=0")).when(k == 5, join(q, "**2=4")).when(k == 6, "((((1))))=1").when(k == 7, "1+1")
        .otherwise(join("((", n, "+1))*1,000=", (n + 1) * 1000))
    )
    return rows.select(calculations.verified(text).alias("v")).select("v.*").groupBy("expression", "result", "error").agg(F.count(F.lit(1)).alias("n"))
