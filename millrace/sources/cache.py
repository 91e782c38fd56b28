"""An append-only cache of answers by request, which several writers may extend at once.

A folder holds segments and numbered manifests. An append writes a segment of its own, which nobody reads
yet, and then tries to create the next manifest, which names all segments that count. Creating it is
atomic: of two writers of one number one wins, and the other reads what was added and tries again. A
reader takes the newest manifest, so it sees each append whole or not at all.

Segments are bucketed by the request, all in the same number of buckets, so that a probe moves the
requests to the cache and never the cache.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.selection import conflicts
from millrace.sources.flat_shards import mounted
from millrace.sources.readers import GateError, demand_none
from millrace.sources.sinks import canonical_rows
from millrace.sources.staging import settle

#: Columns of a segment, and tries before an append gives up.
COLUMNS, TRIES = "request string, payload string", 100


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this text appear at once, unless there is one: whether it was us.

    On a mounted file system a link to a finished file is made, which fails if the name is taken. Elsewhere
    (HDFS) a finished file is renamed, which fails likewise.
    """
    draft = f"{path}.{uuid.uuid4().hex}"
    if path.startswith(("file:", "/")):
        with open(mounted(draft), "x") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(mounted(draft), mounted(path))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(mounted(draft))
    files, place = _place(spark, draft)
    stream = files.create(place, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.rename(place, _place(spark, path)[1]):
        return True
    files.delete(place, False)
    return False


class AnswerCache:
    """The cache in a folder, created with its number of buckets by whoever comes first."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder = spark, folder.rstrip("/")
        files, place = _place(spark, f"{self.folder}/manifests")
        files.mkdirs(place)
        _create(spark, self._path(0), json.dumps({"buckets": buckets, "segments": []}))
        self.buckets: int = self._manifest(0)["buckets"]

    def _path(self, version: int) -> str:
        return f"{self.folder}/manifests/{version:012d}.json"

    def _manifest(self, version: int) -> dict:
        files, place = _place(self.spark, self._path(version))
        stream = files.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> int:
        """The number of the newest manifest."""
        files, place = _place(self.spark, f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in files.listStatus(place)]
        return max(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _table(self, name: str, location: str, partition: str = "") -> str:
        """A table over a folder of bucketed files, known to this session."""
        columns = COLUMNS + (", segment string" if partition else "")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {partition} CLUSTERED BY (request) INTO {self.buckets} BUCKETS LOCATION '{location}'")
        return name

    def read(self, version: int | None = None) -> DataFrame:
        """request, payload of all segments that a manifest (default: the newest) names, bucketed by request.

        The table that is read stays in the session's catalog, a name for each version; its files are not its own.
        """
        version = self.version() if version is None else version
        segments = self._manifest(version)["segments"]
        if not segments:
            return self.spark.createDataFrame([], COLUMNS)
        name = f"answers_{hashlib.sha256(self.folder.encode()).hexdigest()[:16]}_{version}"
        self._table(name, f"{self.folder}/segments", "PARTITIONED BY (segment)")
        named = " ".join(f"PARTITION (segment='{s}') LOCATION '{self._segment(s)}'" for s in segments)
        self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {named}")
        return self.spark.table(name).select("request", "payload")

    def _segment(self, segment: str) -> str:
        return f"{self.folder}/segments/segment={segment}"

    def append(self, rows: DataFrame) -> int:
        """Add rows (request, payload) whose request is not there yet, and say how many were added.

        A request with another payload than the one that is there, or with two payloads, stops the whole
        append. Rows that are there already are passed over, so an append may be repeated. A null
        request or payload is an error.
        """
        fresh = settle(rows.select("request", "payload").distinct())
        demand_none(fresh.where("request IS NULL OR payload IS NULL"), "rows without request or payload")
        demand_none(conflicts(fresh, "request", "payload"), "requests with several payloads")
        for _ in range(TRIES):
            version = self.version()
            there = self.read(version).withColumnRenamed("payload", "known")
            demand_none(there.join(fresh, "request").where("payload <> known").select("request"), "requests that are there with another payload")
            missing = settle(fresh.join(there, "request", "left_anti"))
            if not (n := missing.count()):
                return 0
            segment = uuid.uuid4().hex
            files, place = _place(self.spark, self._segment(segment))
            files.mkdirs(place)
            name = self._table(f"answers_{segment}", self._segment(segment))
            try:
                missing.repartition(self.buckets, "request").write.insertInto(name)
            finally:
                self.spark.sql(f"DROP TABLE {name}")
            segments = self._manifest(version)["segments"]
            if _create(self.spark, self._path(version + 1), json.dumps({"buckets": self.buckets, "segments": [*segments, segment]})):
                return n
            files.delete(place, True)  # another append came first
        raise GateError("other appends always came first")

    def probe(self, requests: DataFrame) -> DataFrame:
        """requests (request and others) with payload, null where the cache has none. Requests are moved to the cache's buckets."""
        return requests.join(self.read(), "request", "left")


def canonical_payload(rows: DataFrame, request: str, schema: StructType | None = None) -> DataFrame:
    """request, payload: the other columns of a row (or those of schema) as canonical JSON, names in order at every level and ASCII only."""
    from millrace.functions.text import ascii_json

    names = schema.names if schema is not None else [c for c in rows.columns if c != request]
    body = rows.select(F.col(request).alias("request"), canonical_rows(rows.select(*names)).alias("payload"))
    return body.select("request", ascii_json(F.col("payload")).alias("payload"))  # a step of its own: no lambda may stand in its argument
