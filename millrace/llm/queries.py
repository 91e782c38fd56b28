"""The thin queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    byte_bpe,
    chat_format,
    exact_dedup,
    fill_in_middle,
    jaccard,
    licenses,
    line_dedup,
    mixing,
    rp_forest,
    sentencepiece_bpe,
    source_divergence,
    suffix_dedup,
    toxicity,
)
from millrace.llm.report_sql import OP11_SQL, OP13_SQL
from millrace.llm.search_sql import OP3_SQL, OP4_SQL, OP6_SQL, OP9_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)").withColumn("text", text)
    return chat_format.digests(rows.unionByName(extra))


def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.decisions(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.decisions(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.decisions(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_decisions(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.decisions(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.decisions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.decisions(_table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS block,
         trim(regexp_replace(coalesce(text, ''), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')) AS t
  FROM documents),
n AS (SELECT doc_id, source, block, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END AS n_tokens FROM d),
b AS (SELECT source, block, sum(n_tokens) AS tokens FROM n GROUP BY ALL),
s AS (SELECT source, CAST(sum(tokens) AS DOUBLE) AS total FROM b GROUP BY ALL),
a AS (SELECT source, total, total / sum(total) OVER () AS share FROM s),
r(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN flat THEN (lo + hi) / 2 ELSE lo END, CASE WHEN flat THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT r.step, r.lo, r.hi,
               (SELECT exp((1 - (r.lo + r.hi) / 2) * (max(ln(share)) - min(ln(share)))) > 2.0
                    OR ln(sum(exp((r.lo + r.hi) / 2 * ln(share)))) - (r.lo + r.hi) / 2 * sum(ln(share) * exp((r.lo + r.hi) / 2 * ln(share))) / sum(exp((r.lo + r.hi) / 2 * ln(share)))
                       > 0.97 * ln(count(*)) FROM a WHERE total > 0) AS flat
        FROM r WHERE r.step < 50)),
e AS (SELECT round(max(hi), 9) AS x FROM r WHERE step = 50),
z AS (SELECT e.x, sum(exp(e.x * ln(a.share))) AS z, max(ln(a.share)) AS top, sum(a.total) AS whole FROM a, e WHERE a.total > 0 GROUP BY e.x),
w AS (SELECT a.source, a.total, exp(z.x * ln(a.share)) / z.z AS weight,
             round(exp(z.x * ln(a.share)) / z.z * z.whole * z.z * exp((1 - z.x) * z.top) / a.total, 9) AS repeats FROM a, z),
p AS (SELECT b.source, b.block, b.tokens, w.total, w.weight, w.repeats, unnest(range(1, CAST(ceil(w.repeats) AS BIGINT) + 1)) AS pass
      FROM b JOIN w ON b.source IS NOT DISTINCT FROM w.source),
q AS (SELECT *, (pass - 1) * total + sum(tokens) OVER (PARTITION BY source, pass ORDER BY md5(concat_ws('|', 'mix-1', CAST(pass AS VARCHAR), source, block)), block ROWS UNBOUNDED PRECEDING) - tokens AS used FROM p),
k AS (SELECT * FROM q WHERE pass <= floor(repeats) OR used < repeats * total)
SELECT n.doc_id, n.source, CAST(n.n_tokens AS BIGINT) AS n_tokens, CAST(k.pass AS INTEGER) AS pass, k.block, round(k.weight, 9) AS weight, round(k.used / (k.repeats * k.total), 9) AS position
FROM n JOIN k ON n.block = k.block AND n.source IS NOT DISTINCT FROM k.source
"""

OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' ORDER BY turn, r, t)) AS loss_sha256,
       CAST(sum(15 + 2 * length(t) - length(regexp_replace(t, '[\\#<]', '', 'g')) + 2 * length(r) - length(regexp_replace(r, '[\\#<:]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def _license_sql() -> str:
    """The sentence table and the chain of rules as SQL."""
    known = ", ".join(f"('{s}', '<{name}>')" for name, sentences in licenses.SENTENCES.items() for s in sentences)
    steps, times, names = [], [], {}
    for i, (name, sequence) in enumerate(licenses.RULES):
        pattern = "".join(f"<{x}>" for x in sequence)
        steps.append(f"replace(r{i}, '{pattern}', '#') AS r{i + 1}")
        times.append(f"(length(r{i}) - length(r{i + 1})) // {len(pattern) - 1} AS t{i}")
        names.setdefault(name, []).append(i)
    found = ", ".join(f"CASE WHEN {' + '.join(f't{i}' for i in which)} > 0 THEN '{name}' END" for name, which in names.items())
    holder = licenses.HOLDER.replace("(?:(?!nor the names)[a-z0-9 ])+", "[a-z0-9 ]+?")
    return f"""
WITH k(s, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS row, doc_id,
             regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), '{licenses.TAG}', '{licenses.TAG.replace("-", " ").replace(":", " ")}'), '\\bv\\.[ \\t\\n\\f\\r\\x0B]+', 'v ', 'g'), '\\b(inc|ltd|co|corp)\\.[ \\t\\n\\f\\r\\x0B]+nor\\b', '\\1 nor', 'g') AS t FROM documents),
e AS (SELECT row, string_split_regex(t, '\\n[ \\t\\n\\f\\r\\x0B]*\\n') AS parts FROM d),
p AS (SELECT row, unnest(parts) || chr(10) AS t, unnest(range(1, len(parts) + 1)) AS part FROM e),
c AS (SELECT row, part, 'a' AS cut, regexp_replace(t, '[.!?;:]+[ \\t\\f\\r\\x0B]*\\n|[.!?;:]+[ \\t\\f\\r\\x0B]|\\n', '|', 'g') AS x FROM p
      UNION ALL SELECT row, part, 'b', regexp_replace(t, '[.!?;:]+[ \\t\\n\\f\\r\\x0B]', '|', 'g') FROM p),
w AS (SELECT row, part, cut, string_split(regexp_replace(regexp_replace(x, '[^a-z0-9|]+', ' ', 'g'), '{holder}', '{licenses.HOLDER_KNOWN}', 'g'), '|') AS parts FROM c),
u AS (SELECT row, part, cut, unnest(parts) AS s, unnest(range(1, len(parts) + 1)) AS at FROM w),
i AS (SELECT u.row, u.part, u.cut, string_agg(k.id, '' ORDER BY u.at) AS ids FROM u JOIN k ON trim(u.s) = k.s GROUP BY u.row, u.part, u.cut),
b AS (SELECT row, part, arg_max(ids, 2 * length(ids) + CASE cut WHEN 'a' THEN 1 ELSE 0 END) AS ids FROM i GROUP BY row, part),
r AS (SELECT row, string_agg(ids, '' ORDER BY part) AS r0 FROM b GROUP BY row),
m AS (SELECT row, {", ".join(steps)}, {", ".join(times)} FROM r)
SELECT d.doc_id, CAST(coalesce({" + ".join(f"t{i}" for i in range(len(times)))}, 0) AS BIGINT) AS n_matches, concat_ws(',', {found}) AS licenses
FROM d LEFT JOIN m ON d.row = m.row
"""


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_chat_format": op2_chat_format,
    "op3_rp_forest": op3_rp_forest,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op1_mixing": OP1_SQL,
    "op2_chat_format": OP2_SQL,
    "op3_rp_forest": OP3_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op5_license_scan": _license_sql(),
    "op6_suffix_dedup": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_source_divergence": OP11_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
