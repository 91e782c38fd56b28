"""Packed corpora as flat files that a loader maps into memory: {split}.tokens.bin and {split}.loss.bin.

A split's file is the stream of its records in record_id order: tokens as little-endian unsigned numbers of
16 bits, and a byte 0 or 1 for each token that says whether it is a target. Records are compressed on the way, for
they take three bytes for each byte of text, and dealt by ranges of (split, record_id). From the partitions' sums each partition knows where its stretch of a file
begins, and writes it there; a task that runs again writes the same bytes to the same place. What the
tasks have to tell (a row for each stretch) becomes the manifest at the commit, and only then the
folder appears. The place must be a mounted file system that driver and executors share; elsewhere
use the Parquet form of millrace.sources.shards.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from millrace.operators.digests import Digest
from millrace.operators.tokens import VOCABULARY
from millrace.sources.readers import GateError, demand_none
from millrace.sources.staging import settle

#: How records are compressed between tasks.
CODEC = "zstd"
#: Tokens read at once when files are checked.
READ_TOKENS = 1 << 19
#: Partitions whose sums the driver holds at most (a row for each and split).
MOST_PARTITIONS = 100_000


def mounted(folder: str) -> str:
    """The path of a folder on a mounted file system."""
    path = folder.removeprefix("file:")
    if not path.startswith("/"):
        raise GateError(f"{folder} is on no mounted file system")
    return "/" + path.lstrip("/")


def _names(split: str) -> tuple[str, str]:
    return f"{split}.tokens.bin", f"{split}.loss.bin"


@dataclass
class Stretch:
    """What a task wrote of one split: tokens from start on."""

    split: str
    start: int
    tokens: int = 0
    records: int = 0
    targets: int = 0
    tokens_sha256: str = ""
    loss_sha256: str = ""
    digest: Digest = Digest()


@dataclass
class Written(WriterCommitMessage):
    stretches: list[Stretch]


def values(column: pa.Array, dtype: str) -> np.ndarray:
    """The numbers in all binary values of a column, one after the other."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]].view(dtype)


def wrong_value(tokens: np.ndarray, mask: np.ndarray, vocabulary: int) -> str | None:
    """What is wrong with tokens and their mask."""
    if len(tokens) != len(mask):
        return "tokens and mask differ in length"
    if len(tokens) and int(tokens.max()) >= vocabulary:
        return "a token outside the vocabulary"
    return "a mask that is not 0 or 1" if len(mask) and int(mask.max()) > 1 else None


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(split, record_id, n, body): tokens and mask of a record behind each other, compressed."""
    for batch in batches:
        n, bodies = [], []
        for tokens, mask in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if len(tokens) != 2 * len(mask):
                raise GateError("tokens and mask differ in length")
            n.append(len(mask))
            bodies.append(pa.compress(tokens + mask, CODEC, asbytes=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(bodies, pa.binary())], ["split", "record_id", "n", "body"])


class FlatWriter(DataSourceArrowWriter):
    """Rows (_part, split, record_id, n, body) in the order of the stream."""

    def __init__(self, options: dict):
        self.staging, self.folder = options["staging"], options["folder"]
        self.starts = {(part, split): start for part, split, start in json.loads(options["starts"])}
        self.totals: dict[str, int] = json.loads(options["totals"])
        self.vocabulary = int(options["vocabulary"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[Stretch] = []
        key, last, files = None, None, []
        try:
            for batch in iterator:
                parts, splits, ids = (batch.column(i).to_pylist() for i in range(3))
                at = 0
                for own, run in groupby(zip(parts, splits, strict=True)):
                    n = len(list(run))
                    if own != key:
                        self._close(done, files)
                        start, key, last = self.starts[own], own, None
                        done.append(Stretch(own[1], start))
                        files = [(open(f"{self.staging}/{name}", "r+b"), hashlib.sha256()) for name in _names(own[1])]
                        for (file, _), width in zip(files, (2, 1), strict=True):
                            file.seek(start * width)
                    if any(a == b for a, b in zip([last, *ids[at : at + n]], ids[at : at + n])):
                        raise GateError("repeated records")
                    last = ids[at + n - 1]
                    self._append(done[-1], files, batch.slice(at, n))
                    at += n
        finally:
            self._close(done, files)
        return Written(done)

    def _append(self, stretch: Stretch, files: list, rows: pa.RecordBatch) -> None:
        for n, body in zip(rows.column(3).to_pylist(), rows.column(4), strict=True):
            whole = pa.decompress(body.as_buffer(), 3 * n, CODEC, asbytes=True)
            tokens, mask = np.frombuffer(whole, "<u2", n), np.frombuffer(whole, "u1", n, 2 * n)
            if error := wrong_value(tokens, mask, self.vocabulary):
                raise GateError(error)
            for (file, sha), data in zip(files, (tokens, mask), strict=True):
                file.write(data.data)
                sha.update(data.data)
            stretch.digest = stretch.digest.then(hashlib.sha256(whole).hexdigest())
            stretch.records += 1
            stretch.tokens += n
            stretch.targets += int(mask.sum())

    @staticmethod
    def _close(done: list[Stretch], files: list) -> None:
        for file, _ in files:
            file.flush()
            os.fsync(file.fileno())
            file.close()
        if files:
            done[-1].tokens_sha256, done[-1].loss_sha256 = (sha.hexdigest() for _, sha in files)
        files.clear()

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest of all stretches, then the folder under its name."""
        stretches = sorted((s for m in messages if m for s in m.stretches), key=lambda s: (s.split, s.start))
        splits = {}
        for split, total in self.totals.items():
            own, end, digest = [s for s in stretches if s.split == split], 0, Digest()
            for s in own:
                if s.start != end:
                    raise GateError(f"{split}: a stretch begins at {s.start}, not at {end}")
                end, digest = end + s.tokens, digest.before(s.digest)
            if end != total:
                raise GateError(f"{split}: {end} tokens, not {total}")
            told = [{"start": s.start, "tokens": s.tokens, "tokens_sha256": s.tokens_sha256, "loss_sha256": s.loss_sha256} for s in own]
            splits[split] = {"tokens": end, "records": sum(s.records for s in own), "targets": sum(s.targets for s in own), "digest": digest.hex(), "stretches": told}
        manifest = {"schema_version": 1, "vocabulary": self.vocabulary, "splits": splits}
        with open(f"{self.staging}/manifest.json", "x") as file:
            file.write(json.dumps(manifest, sort_keys=True, separators=(",", ":")))
            file.flush()
            os.fsync(file.fileno())
        os.rename(self.staging, self.folder)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class FlatShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flat_shards"

    def writer(self, schema: StructType, overwrite: bool) -> FlatWriter:
        return FlatWriter(dict(self.options))


def publish_flat(records: DataFrame, folder: str, splits: tuple[str, ...] = ("train", "validation", "test"), vocabulary: int = VOCABULARY) -> None:
    """Write records (split, record_id, tokens, mask as binary) as flat files with a manifest; the folder appears when all is written.

    A folder that exists, a split without records or of another name, two rows of one record_id in a split, a token
    outside the vocabulary, and a mask that does not fit are errors; then nothing is left. Other columns are not read.
    """
    spark, target = records.sparkSession, mounted(folder)
    if os.path.exists(target):
        raise GateError(f"{folder} exists")
    kind = records.schema["record_id"].dataType.simpleString()
    rows = records.select("split", "record_id", "tokens", "mask").mapInArrow(_squeezed, f"split string, record_id {kind}, n long, body binary")
    ordered = settle(rows.repartitionByRange("split", "record_id").sortWithinPartitions("split", "record_id").select(F.spark_partition_id().alias("_part"), "*"))
    sums = ordered.groupBy("split", "_part").agg(F.sum("n").alias("n"))
    # A row for each partition and split, no more than the partitions Spark itself keeps track of.
    found = sums.orderBy("split", "_part").limit(MOST_PARTITIONS + 1).collect()
    if len(found) > MOST_PARTITIONS:
        raise GateError("too many partitions")
    starts, totals = [], dict.fromkeys(splits, 0)
    for r in found:
        if r.split not in totals:
            raise GateError(f"no split is named {r.split}")
        starts.append((r._part, r.split, totals[r.split]))
        totals[r.split] += r.n or 0
    if empty := [s for s in splits if not totals[s]]:
        raise GateError(f"splits without records: {empty}")
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    os.makedirs(staging)
    for split, n in totals.items():
        for name, width in zip(_names(split), (2, 1), strict=True):
            with open(f"{staging}/{name}", "wb") as file:
                file.truncate(n * width)
    spark.dataSource.register(FlatShards)
    options = {"staging": staging, "folder": target, "starts": json.dumps(starts), "totals": json.dumps(totals), "vocabulary": str(vocabulary)}
    try:
        ordered.write.format("flat_shards").options(**options).mode("append").save()
    except Exception:
        shutil.rmtree(staging, ignore_errors=True)
        raise


def read_manifest(folder: str) -> dict:
    """The manifest, after the sizes of all files were compared with it."""
    path = mounted(folder)
    if not os.path.exists(f"{path}/manifest.json"):
        raise GateError(f"{folder} has no manifest")
    with open(f"{path}/manifest.json") as file:
        manifest = json.load(file)
    for split, told in manifest["splits"].items():
        for name, width in zip(_names(split), (2, 1), strict=True):
            if not os.path.exists(f"{path}/{name}") or os.path.getsize(f"{path}/{name}") != told["tokens"] * width:
                raise GateError(f"{name} does not have the bytes of the manifest")
    return manifest


def verify_flat(spark: SparkSession, folder: str) -> dict:
    """The manifest; an error unless every byte agrees with it: each stretch is read by a task, a MB at a time."""
    manifest, path = read_manifest(folder), mounted(folder)
    vocabulary = manifest["vocabulary"]
    told = [(split, s["start"], s["tokens"], s["tokens_sha256"], s["loss_sha256"]) for split, x in manifest["splits"].items() for s in x["stretches"]]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrong = []
            for split, start, n, *expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                error, shas = None, (hashlib.sha256(), hashlib.sha256())
                for tokens, mask in _stretch(path, split, start, n):
                    error = error or wrong_value(tokens, mask, vocabulary)
                    for sha, data in zip(shas, (tokens, mask), strict=True):
                        sha.update(data.data)
                if [s.hexdigest() for s in shas] != expected:
                    error = "bytes that do not agree with the manifest"
                wrong.append(error and f"{split} from {start}: {error}")
            yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.string())], ["error"])

    stretches = spark.createDataFrame(told, "split string, start long, tokens long, tokens_sha256 string, loss_sha256 string")
    errors = stretches.repartition(len(told), "split", "start").mapInArrow(check, "error string").where("error IS NOT NULL")
    demand_none(errors, "flat shards")
    return manifest


def _stretch(path: str, split: str, start: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and mask of a stretch, piece by piece."""
    with open(f"{path}/{_names(split)[0]}", "rb") as tokens, open(f"{path}/{_names(split)[1]}", "rb") as mask:
        tokens.seek(2 * start)
        mask.seek(start)
        for done in range(0, n, READ_TOKENS):
            size = min(READ_TOKENS, n - done)
            yield np.frombuffer(tokens.read(2 * size), "<u2"), np.frombuffer(mask.read(size), "u1")


def read_ranges(ranges: DataFrame, folder: str) -> DataFrame:
    """ranges (split, start, n and others) with tokens and mask: n tokens from start on, read where they stand. A range beyond the end is an error."""
    manifest, path = read_manifest(folder), mounted(folder)
    totals = {split: x["tokens"] for split, x in manifest["splits"].items()}
    names = ranges.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        try:
            for batch in batches:
                found: list[list[bytes]] = [[], []]
                for split, start, n in zip(*(batch.column(names.index(c)).to_pylist() for c in ("split", "start", "n")), strict=True):
                    if split not in totals or start < 0 or n < 0 or start + n > totals[split]:
                        raise GateError(f"{split} has no tokens {start} to {start + n}")
                    if split not in files:
                        files[split] = [open(f"{path}/{name}", "rb") for name in _names(split)]
                    for out, file, width in zip(found, files[split], (2, 1), strict=True):
                        out.append(os.pread(file.fileno(), n * width, start * width))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.binary()) for x in found)], [*names, "tokens", "mask"])
        finally:
            for pair in files.values():
                for file in pair:
                    file.close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema.fields)
    return ranges.mapInArrow(read, f"{kinds}, tokens binary, mask binary")


def compose_flat(spark: SparkSession, components: dict[str, str], folder: str, replay: str | None = None) -> dict:
    """One corpus out of published ones, split by split, the streams of the components behind each other; returns its manifest.

    Every component is verified first, and all need the same splits and vocabulary. Stretches are copied by tasks to their
    places. The digest of a split is composed of the components' digests. The manifest tells tokens, targets and
    the manifest's SHA-256 of each component, and which share of the training tokens the component replay has.
    """
    target = mounted(folder)
    if os.path.exists(target):
        raise GateError(f"{folder} exists")
    if not components or (replay is not None and replay not in components):
        raise GateError("no components, or none that is replayed")
    found = {name: verify_flat(spark, place) for name, place in components.items()}
    if len({(m["vocabulary"], tuple(sorted(m["splits"]))) for m in found.values()}) > 1:
        raise GateError("components of other splits or vocabularies")
    first = next(iter(found.values()))
    splits = {s: {"tokens": 0, "records": 0, "targets": 0, "digest": Digest(), "stretches": []} for s in first["splits"]}
    copies, told = [], []
    for name, manifest in found.items():
        path = mounted(components[name])
        for split, own in manifest["splits"].items():
            whole = splits[split]
            for s in own["stretches"]:
                copies.append((path, split, s["start"], s["tokens"], whole["tokens"] + s["start"]))
                whole["stretches"].append({**s, "start": whole["tokens"] + s["start"]})
            whole["digest"] = whole["digest"].before(Digest(own["records"], int(own["digest"][:16], 16), int(own["digest"][16:], 16)))
            for c in ("tokens", "records", "targets"):
                whole[c] += own[c]
        with open(f"{path}/manifest.json", "rb") as file:
            sha = hashlib.sha256(file.read()).hexdigest()
        told.append({"name": name, "manifest_sha256": sha, **{c: {split: x[c] for split, x in manifest["splits"].items()} for c in ("tokens", "targets")}})
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    os.makedirs(staging)
    try:
        for split, whole in splits.items():
            for name, width in zip(_names(split), (2, 1), strict=True):
                with open(f"{staging}/{name}", "wb") as file:
                    file.truncate(whole["tokens"] * width)
            whole["digest"] = whole["digest"].hex()
        rows = spark.createDataFrame(copies, "path string, split string, start long, n long, to long")
        rows.repartition(max(len(copies), 1), "path", "split", "start").mapInArrow(lambda batches: _copied(batches, staging), "n long").agg(F.sum("n")).collect()
        manifest = {"schema_version": 1, "vocabulary": first["vocabulary"], "splits": splits, "components": told}
        if replay is not None and "train" in splits:
            share = next(c["tokens"]["train"] for c in told if c["name"] == replay)
            manifest["replay_train_fraction"] = share / splits["train"]["tokens"] if splits["train"]["tokens"] else 0.0
        with open(f"{staging}/manifest.json", "x") as file:
            file.write(json.dumps(manifest, sort_keys=True, separators=(",", ":")))
            file.flush()
            os.fsync(file.fileno())
        verify_flat(spark, staging)
        os.rename(staging, target)
    except Exception:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return manifest


def _copied(batches: Iterator[pa.RecordBatch], staging: str) -> Iterator[pa.RecordBatch]:
    """Stretches copied to their places, a MB at a time; a second copy writes the same bytes."""
    for batch in batches:
        for path, split, start, n, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with open(f"{staging}/{_names(split)[0]}", "r+b") as tokens, open(f"{staging}/{_names(split)[1]}", "r+b") as mask:
                tokens.seek(2 * to)
                mask.seek(to)
                for t, m in _stretch(path, split, start, n):
                    tokens.write(t.data)
                    mask.write(m.data)
                for file in (tokens, mask):
                    file.flush()
                    os.fsync(file.fileno())
        yield pa.RecordBatch.from_arrays([batch.column(3)], ["n"])
