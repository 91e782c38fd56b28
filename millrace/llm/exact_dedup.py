"""Exact deduplication by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name, given
by sorting the distinct blocks; then adjacent pairs of names are named in the same way, again and
again, until one name is left for each document. Blocks and pairs are compared themselves, never
only their hashes, so two documents share a name exactly if their bytes are equal.

Before that, documents whose (byte length, 64-bit hash) occurs once are set aside: equal texts have
equal hashes, so these are certainly alone. What is left are the contenders. Everything is built of
DataFrame operations. Aggregations combine on the map side, so a text with a third of all rows
arrives at the shuffle once for each map task; the joins back are by (name) and left to AQE's skew
handling, or broadcast where the written side is measured to be small.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import numbered, small, write

#: Bytes of a block.
BLOCK_BYTES = 16384


class ExactGroups(NamedTuple):
    """settled: rows that are alone. grouped: the other rows with _mr_keep_id, _mr_size, _mr_kept."""

    settled: DataFrame
    grouped: DataFrame


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def _named(keys: DataFrame, columns: list[str], spread: Column) -> DataFrame:
    """The distinct keys with integer names in sort order within hash-dealt partitions.

    The names are the ids of rows sorted inside a fixed partitioning, so a task that runs again
    gives the same names; the table is written at once.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.distinct().withColumn("_mr_spread", spread).repartition(parts, "_mr_spread").sortWithinPartitions("_mr_spread", *columns)
    return small(write(ordered.select(*columns, F.monotonically_increasing_id().alias("_mr_name")), "names"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> ExactGroups:
    """Group the rows of docs by their whole text; null counts as empty.

    All columns are kept (own columns start with _mr_, and no column of docs may). Of each group the row
    with the largest doc_id stays (null is the smallest); if that id occurs in several rows, exactly
    one of them stays. Empty texts are equal to each other. An empty table gives two empty frames.
    """
    spark = docs.sparkSession
    signed = docs.withColumns({"_mr_len": F.length(_bytes(text)), "_mr_hash": F.xxhash64(_bytes(text))})
    repeated = small(
        write(signed.groupBy("_mr_len", "_mr_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_mr_len", "_mr_hash"), "repeated")
    )
    settled = signed.join(repeated, ["_mr_len", "_mr_hash"], "left_anti").select(*docs.columns)
    contenders = write(
        signed.join(repeated, ["_mr_len", "_mr_hash"], "left_semi").select(*docs.columns, F.monotonically_increasing_id().alias("_mr_row")),
        "contenders",
    ).df

    whole = _bytes(text)
    count = F.greatest(F.lit(1), F.ceil(F.length(whole) / block_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(whole, i * block_bytes + 1, F.lit(block_bytes)))
    blocks = contenders.select("_mr_row", F.posexplode(cut).alias("_mr_at", "_mr_block"))
    names = _named(blocks.select("_mr_block"), ["_mr_block"], F.xxhash64("_mr_block"))
    level, done = 0, None
    symbols = write(blocks.join(names, "_mr_block").select("_mr_row", "_mr_at", "_mr_name"), "level").df
    while True:
        # A document whose symbols are one in number has its identity: (level, name).
        counted = symbols.groupBy("_mr_row").agg(F.max("_mr_at").alias("_mr_last"))
        state = write(symbols.where("_mr_at = 0").join(counted, "_mr_row").select("_mr_row", "_mr_name", "_mr_last"), "state").df
        ended = state.where("_mr_last = 0").select("_mr_row", F.lit(level).alias("_mr_level"), "_mr_name")
        done = ended if done is None else done.unionByName(ended)
        if state.where("_mr_last > 0").isEmpty():
            break
        going = symbols.join(state.where("_mr_last > 0").select("_mr_row"), "_mr_row", "left_semi")
        # A last symbol without a partner is paired with -1, which is no name.
        side = lambda odd: F.coalesce(F.max(F.when(F.col("_mr_at") % 2 == odd, F.col("_mr_name"))), F.lit(-1))
        pairs = going.groupBy("_mr_row", F.floor(F.col("_mr_at") / 2).cast("int").alias("_mr_at")).agg(side(0).alias("_mr_a"), side(1).alias("_mr_b"))
        pairs = write(pairs, "pairs").df
        names = _named(pairs.select("_mr_a", "_mr_b"), ["_mr_a", "_mr_b"], F.xxhash64("_mr_a", "_mr_b"))
        symbols = write(pairs.join(names, ["_mr_a", "_mr_b"]).select("_mr_row", "_mr_at", "_mr_name"), "level").df
        level += 1

    identity = write(
        contenders.select("_mr_row", F.col(doc_id).alias("_mr_doc")).join(done, "_mr_row").select("_mr_row", "_mr_doc", "_mr_level", "_mr_name"), "identity"
    ).df
    groups = small(
        write(
            identity.groupBy("_mr_level", "_mr_name").agg(F.max(F.struct("_mr_doc", "_mr_row")).alias("_mr_top"), F.count(F.lit(1)).alias("_mr_size")), "groups"
        )
    )
    decided = write(
        identity.join(groups, ["_mr_level", "_mr_name"]).select(
            "_mr_row", F.col("_mr_top._mr_doc").alias("_mr_keep_id"), "_mr_size", (F.col("_mr_top._mr_row") == F.col("_mr_row")).alias("_mr_kept")
        ),
        "decided",
    )
    grouped = contenders.join(small(decided), "_mr_row").drop("_mr_row")
    return ExactGroups(settled, grouped)


def dedup_decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    found = exact_groups(docs.select(doc_id, text), doc_id, text, block_bytes)
    digest = F.sha2(_bytes(text), 256).alias("text_sha256")
    alone = found.settled.select(
        F.col(doc_id).alias("doc_id"), F.col(doc_id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest
    )
    others = found.grouped.select(F.col(doc_id).alias("doc_id"), F.col("_mr_keep_id").alias("keep_id"), F.col("_mr_size").alias("group_size"), F.col("_mr_kept").alias("kept"), digest)
    return alone.unionByName(others)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs, whatever their names."""
    plain, own = numbered(docs)
    found = exact_groups(plain, own[doc_id], own[text])
    return found.settled.unionByName(found.grouped.where("_mr_kept").select(*plain.columns)).toDF(*docs.columns)
