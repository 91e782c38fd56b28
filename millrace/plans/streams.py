"""Queries over row groups, flat shards and the packed stream, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import stream
from millrace.operators import tokens as K
from millrace.plans.corpora import _RECORDS_SQL, _split
from millrace.plans.registry import as_long, query, table
from millrace.sources import flat_shards, shards
from millrace.sources.readers import first_reason
from millrace.sources.row_groups import read_row_groups

#: Rows of a row group and buckets of the files that row_group_scan writes, and the groups that it reads of each file.
GROUP_ROWS, BUCKETS, GROUPS = 32, 8, [0, 2]


@query(
    f"""WITH d AS (SELECT doc_id, doc_id % {BUCKETS} AS bucket, octet_length(encode(coalesce(text, ''))) AS b, (row_number() OVER (PARTITION BY doc_id % {BUCKETS} ORDER BY doc_id) - 1) AS i FROM documents),
    g AS (SELECT *, i // {GROUP_ROWS} AS row_group, i % {GROUP_ROWS} AS row_index FROM d)
    SELECT bucket, CAST(row_group AS INTEGER) AS row_group, CASE WHEN b < 256 THEN 'too_short' WHEN b > 65536 THEN 'too_long' ELSE 'accepted' END AS reason, count(*) AS n_rows,
    CAST(sum(row_index) AS BIGINT) AS places, CAST(sum(doc_id) AS BIGINT) AS ids FROM g WHERE row_group IN ({", ".join(map(str, GROUPS))}) GROUP BY ALL"""
)
def row_group_scan(spark, d):
    """Listed row groups of each file are read and no others, with what is accepted and refused in each."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % BUCKETS).alias("bucket"))
    folder = shards.scratch_folder(spark, "groups")
    sorted_ = docs.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "doc_id")
    sorted_.write.partitionBy("bucket").option("parquet.block.row.count.limit", GROUP_ROWS).parquet(folder)
    counts = spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    # A row for each file; a short file has fewer groups.
    wanted = {r.file: [g for g in GROUPS if g * GROUP_ROWS < r.n] for r in counts.collect()}
    rows = read_row_groups(spark, {f: g for f, g in wanted.items() if g}, ["doc_id", "text"])
    size = F.octet_length("text")
    reason = first_reason([("too_short", size < 256), ("too_long", size > 65_536)])
    bucket = as_long(F.regexp_extract("_file", r"bucket=(-?\d+)", 1)).alias("bucket")
    found = rows.groupBy(bucket, F.col("_row_group").alias("row_group"), reason.alias("reason"))
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_row_index").alias("places"), F.sum("doc_id").alias("ids"))


def _packed(spark, d) -> DataFrame:
    """Documents as packed base records by split of their id."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("family_id"), _split("doc_id").alias("split"), K.packed_base(F.col("text")).alias("r"))
    return docs.select("split", "record_id", "family_id", "r.tokens", "r.mask")


_STREAM_SQL = f"""{_RECORDS_SQL}, h AS (SELECT doc_id, split, b, hex(encode(text)) AS h FROM r),
    u AS (SELECT doc_id, split, b, '0001' || regexp_replace(h, '(..)', '\\100', 'g') || '0101' AS w, '00' || repeat('01', b + 1) AS m FROM h)"""


@query(
    f"""WITH {_STREAM_SQL} SELECT split, doc_id AS record_id, CAST(sum(b + 2) OVER (PARTITION BY split ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - b - 2 AS BIGINT) AS start, CAST(b + 2 AS BIGINT) AS n,
    sha256(unhex(w)) AS tokens_sha256, sha256(unhex(m)) AS mask_sha256 FROM u"""
)
def flat_shards_read(spark, d):
    """All records written as flat files, every byte verified, and each record read back from where it stands."""
    records = _packed(spark, d)
    folder = shards.scratch_folder(spark, "flat")
    flat_shards.publish_flat(records, folder)
    flat_shards.verify_flat(spark, folder)
    narrow = records.select("split", "record_id", as_long(F.length("mask")).alias("n"))
    placed = stream.running_offset(narrow, "record_id", F.col("n"), ["split"]).select("split", "record_id", F.col("offset").alias("start"), "n")
    back = flat_shards.read_ranges(placed, folder)
    return back.select("split", "record_id", "start", "n", F.sha2("tokens", 256).alias("tokens_sha256"), F.sha2("mask", 256).alias("mask_sha256"))


@query(
    f"""WITH {_RECORDS_SQL}, t AS (SELECT split, doc_id, unnest([256] || list_transform(range(1, length(hex(encode(text))), 2), lambda i: CAST('0x' || substr(hex(encode(text)), i, 2) AS INTEGER)) || [257]) AS token,
      unnest(range(0, b + 2)) AS pos FROM r),
    n AS (SELECT split, token, lead(token) OVER w AS target, lead(pos) OVER w > 0 AS eligible FROM t WINDOW w AS (PARTITION BY split ORDER BY doc_id, pos))
    SELECT split, token, target, count(*) AS n, count(*) FILTER (eligible) AS n_eligible FROM n WHERE target IS NOT NULL GROUP BY ALL"""
)
def stream_next_tokens(spark, d):
    """What follows on each token in the packed stream, borders of records included."""
    return stream.next_tokens(_packed(spark, d))


_DRAWS, _BLOCK = 40, 256


def _turn_records(spark, d) -> DataFrame:
    """Turns as base records of which only assistants' are targets, in two streams."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    turns = table(spark, d, "conversations").select("conv_id", "turn", blank("role"), blank("text")).distinct()
    places = [F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("conv_id", 12), ("turn", 6))]
    made = turns.select(
        F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("split"), F.concat_ws("-", *places, "role", F.sha2("text", 256)).alias("record_id"),
        K.packed_base("text").alias("r"), (F.col("role") == "assistant").alias("answer"),
    )
    unseen = F.lpad(F.lit(b""), F.length("r.mask"), F.lit(b"\x00"))
    return made.select("split", "record_id", "r.tokens", F.when(F.col("answer"), F.col("r.mask")).otherwise(unseen).alias("mask"))


@query(
    f"""WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations),
    c AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS split, lpad(CAST(conv_id AS VARCHAR), 12, '0') || '-' || lpad(CAST(turn AS VARCHAR), 6, '0') || '-' || role || '-' || sha256(t) AS id,
      role, t, octet_length(encode(t)) + 2 AS n FROM t),
    s AS (SELECT split, string_agg('0001' || regexp_replace(hex(encode(t)), '(..)', '\\100', 'g') || '0101', '' ORDER BY id) AS tokens,
      string_agg(CASE WHEN role = 'assistant' THEN '0' || repeat('1', n - 1) ELSE repeat('0', n) END, '' ORDER BY id) AS mask, sum(n) AS total FROM c GROUP BY split),
    x AS (SELECT s.*, d.draw, a.attempt, CAST('0x' || substr(sha256('windows:' || s.split || ':' || d.draw || ':' || a.attempt), 1, 15) AS BIGINT) % CAST(s.total - {_BLOCK} AS BIGINT) AS start
      FROM s, (SELECT unnest(range(0, {_DRAWS})) AS draw) d, (SELECT unnest(range(0, 40)) AS attempt) a),
    y AS (SELECT *, contains(substr(mask, start + 2, {_BLOCK}), '1') AS good FROM x),
    z AS (SELECT split, draw, min(attempt) AS attempt FROM y WHERE good GROUP BY ALL)
    SELECT y.split, CAST(y.draw AS INTEGER) AS draw, CAST(y.attempt AS INTEGER) AS attempt, y.start, sha256(unhex(substr(y.tokens, 4 * y.start + 1, 4 * {_BLOCK + 1}))) AS tokens_sha256,
    CAST(length(replace(substr(y.mask, y.start + 2, {_BLOCK}), '0', '')) AS BIGINT) AS n_targets FROM y JOIN z USING (split, draw, attempt)"""
)
def window_draws(spark, d):
    """Seeded training windows over the streams of turns: each has a target at least."""
    found = stream.training_windows(_turn_records(spark, d), "windows", _DRAWS, _BLOCK)
    ones = F.length(F.replace(F.substring("mask", 2, _BLOCK).cast("string"), F.lit("\x00"), F.lit("")))
    return found.select("split", "draw", "attempt", "start", F.sha2("tokens", 256).alias("tokens_sha256"), as_long(ones).alias("n_targets"))
