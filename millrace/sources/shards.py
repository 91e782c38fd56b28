"""Packed corpora on disk: published whole or not at all, loaded only if every record agrees with the manifest."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType

from millrace.operators.digests import stream_digests
from millrace.operators.tokens import VOCABULARY
from millrace.sources.flat_shards import wrong_value
from millrace.sources.readers import GateError, demand_none
from millrace.sources.row_groups import opened
from millrace.sources.sinks import u8, u16_le
from millrace.sources.staging import shared_folder

#: Bytes of a file read at once.
READ_BYTES = 1 << 20


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A folder of its own in the shared one, not yet there."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def publish(records: DataFrame, folder: str) -> None:
    """Write records (split, record_id, family_id, tokens, mask) and their manifest; the folder appears when all is written.

    tokens and mask are arrays, or binary as the packed form has them (two bytes a token, the low one first). Everything goes to a sibling folder first, which is then renamed. A folder that exists is refused.
    """
    spark = records.sparkSession
    files, target = _place(spark, folder)
    if files.exists(target):
        raise GateError(f"{folder} exists")
    staging = f"{folder}.staging-{uuid.uuid4().hex}"
    binary = isinstance(records.schema["tokens"].dataType, BinaryType)
    body = [F.col("tokens"), F.col("mask")] if binary else [u16_le(F.col("tokens")).alias("tokens"), u8(F.col("mask")).alias("mask")]
    packed = records.select("split", "record_id", "family_id", *body)
    packed = packed.withColumns({"n_tokens": F.length("mask"), "n_targets": ones(F.col("mask")), "tokens_sha256": F.sha2("tokens", 256), "mask_sha256": F.sha2("mask", 256)})
    packed.repartitionByRange("split", "record_id").sortWithinPartitions("split", "record_id").write.partitionBy("split").parquet(f"{staging}/records")
    totals(spark.read.parquet(f"{staging}/records")).coalesce(1).write.json(f"{staging}/manifest")
    if not files.rename(_place(spark, staging)[1], target):
        raise GateError(f"{folder} could not be published")


@F.arrow_udf(IntegerType())
def ones(masks: pa.Array) -> pa.Array:
    """How many bytes of a mask are 1."""
    return pa.array([None if m is None else m.count(1) for m in masks.to_pylist()], pa.int32())


@F.arrow_udf(StringType())
def unsound(tokens: pa.Array, masks: pa.Array) -> pa.Array:
    """What is wrong with packed tokens and their mask; null if nothing is."""
    pairs = zip(tokens.to_pylist(), masks.to_pylist(), strict=True)
    odd = "tokens of half a number"
    return pa.array([odd if len(t) % 2 else wrong_value(np.frombuffer(t, "<u2"), np.frombuffer(m, "u1"), VOCABULARY) for t, m in pairs], pa.string())


def totals(packed: DataFrame) -> DataFrame:
    """split, records, families, tokens, targets, digest (of the records in the order of their ids)."""
    counts = packed.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("family_id").alias("families"), F.sum("n_tokens").alias("tokens"), F.sum("n_targets").alias("targets")
    )
    digests = stream_digests(packed, "split", "record_id", F.sha2(F.concat("tokens_sha256", "mask_sha256"), 256))
    return counts.join(digests.select("split", "digest"), "split")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a published folder; an error unless lengths, digests, token ids, masks and all totals agree with the manifest."""
    files, path = _place(spark, f"{folder}/manifest")
    if not files.exists(path):
        raise GateError(f"{folder} has no manifest")
    packed = spark.read.parquet(f"{folder}/records")
    wrong = (F.length("mask") != F.col("n_tokens")) | (ones(F.col("mask")) != F.col("n_targets")) | unsound(F.col("tokens"), F.col("mask")).isNotNull()
    wrong |= (F.sha2("tokens", 256) != F.col("tokens_sha256")) | (F.sha2("mask", 256) != F.col("mask_sha256"))
    demand_none(packed.where(wrong).select("split", "record_id"), "records that do not agree with themselves")
    told = spark.read.schema("split string, records long, families long, tokens long, targets long, digest string").json(f"{folder}/manifest")
    found = totals(packed).select("split", "records", "families", "tokens", "targets", "digest")
    demand_none(told.exceptAll(found).unionByName(found.exceptAll(told)), "totals that do not agree with the manifest")
    return packed


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256 of files of any size: a task for each file, which reads it a MB at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                system, place = opened(path)
                sha = hashlib.sha256()
                with system.open_input_stream(place) as stream:
                    while data := stream.read(READ_BYTES):
                        sha.update(data)
                found.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "sha256"])

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1), "path")
    return rows.mapInArrow(digest, "path string, sha256 string")


def pinned_parquet(spark: SparkSession, pins: dict[str, str]) -> DataFrame:
    """The Parquet files of pins, path -> SHA-256 of the file; an error if one file does not have its own digest."""
    told = spark.createDataFrame(list(pins.items()), "path string, pin string")
    wrong = told.join(file_digests(spark, list(pins)), "path", "left").where(~F.col("pin").eqNullSafe(F.col("sha256")))
    demand_none(wrong.select("path"), "files without their pinned digest")
    return spark.read.parquet(*pins)


def whole_texts(spark: SparkSession, path: str, most_bytes: int = 8 << 20) -> DataFrame:
    """path, text of UTF-8 text files; an error if one is larger than most_bytes or no valid UTF-8."""
    found = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    demand_none(found.where(F.col("length") > most_bytes).select("path"), "files that are too large")
    text = found.select("path", F.try_validate_utf8(F.decode("content", "UTF-8")).alias("text"), F.col("content"))
    demand_none(text.where(F.col("text").isNull() | (F.encode("text", "UTF-8") != F.col("content"))).select("path"), "files that are no UTF-8")
    return text.select("path", "text")


def replace_corpus(spark: SparkSession, folder: str) -> None:
    """Remove a published folder so that it can be published anew. Only a folder with records and a manifest, and nothing else, is removed."""
    files, path = _place(spark, folder)
    if not files.exists(path):
        return
    names = sorted(s.getPath().getName() for s in files.listStatus(path))
    if names != ["manifest", "records"]:
        raise GateError(f"{folder} is no published corpus: {names}")
    files.delete(path, True)


def write_json(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """One small JSON file, written beside its place and renamed to it."""
    files, target = _place(spark, f"{folder}/{name}")
    _, staging = _place(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = files.create(staging)
    stream.write(bytearray(text.encode()))
    stream.close()
    files.delete(target, False)
    if not files.rename(staging, target):
        raise GateError(f"{name} could not be written")
