"""Publishing: packed shards, canonical JSON, manifests, append without repetition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.readers import GateError
from millrace.sources.staging import settle


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON of the columns in the order of their names, nulls included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def _sorted(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of all structs, and the entries of all maps, in the order of their names; NaN and infinity are errors."""
    if isinstance(kind, T.StructType):
        fields = [x for f in sorted(kind.fields, key=lambda f: f.name) for x in (F.lit(f.name), _sorted(value[f.name], f.dataType))]
        return F.when(value.isNotNull(), F.named_struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_entries(value)), lambda e: F.struct(e["key"].alias("key"), _sorted(e["value"], kind.valueType).alias("value")))
        return F.when(value.isNotNull(), F.map_from_entries(entries))
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit("no finite number"))).otherwise(value)
    return value


def canonical_rows(rows: DataFrame) -> Column:
    """Canonical JSON of whole rows: names in order at every level, nulls kept, only finite numbers."""
    fields = [_sorted(F.col(f.name), f.dataType).alias(f.name) for f in sorted(rows.schema.fields, key=lambda f: f.name)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _numbers(rows: pa.Array, dtype: str, least: int, most: int, wrong: str) -> pa.Array:
    """Arrays of numbers as binary values of a type of fixed width; null stays null."""
    out = []
    for row in rows.to_numpy(zero_copy_only=False):
        if row is not None and len(row) and not (least <= row.min() and row.max() <= most):  # a null among them is no number
            raise GateError(wrong)
        out.append(None if row is None else np.asarray(row).astype(dtype).tobytes())
    return pa.array(out, pa.binary())


@F.arrow_udf(T.BinaryType())
def u16_le(tokens: pa.Array) -> pa.Array:
    """Tokens as binary, two bytes each, the low one first; a token outside 0 to 65535 is an error."""
    return _numbers(tokens, "<u2", 0, 65_535, "token out of range")


@F.arrow_udf(T.BinaryType())
def u8(values: pa.Array) -> pa.Array:
    """Small numbers as binary, a byte each; a number outside 0 to 255 is an error."""
    return _numbers(values, "u1", 0, 255, "number out of range")


def allowed(rows: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """The columns that may be published; an error if a required one is missing."""
    if missing := [c for c in required if c not in rows.columns]:
        raise GateError(f"missing fields: {missing}")
    return rows.select(*required, *[c for c in optional if c in rows.columns])


def write_with_account(rows: DataFrame, folder: str, group: str, values: list[str], sums: list[str], reasons: list[str], keep: str = "accepted", by: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Write the rows whose reason is keep, and give the account of all, taken while they pass: nothing is read a second time.

    rows: with a reason, a group (such as split) out of values, and numbers to sum. Returned are (reason, n_rows), and for each
    group (group, rows, sums) of what was written. Counting happens in the writing stage itself, where Spark counts a
    partition once however often it runs. A reason that is not in the rows is no row, a group outside values an error.
    """
    reasons = sorted({*reasons, keep})
    known = F.col(by).isin(reasons) & F.col(group).isin(values)
    checked = rows.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.lit("a reason or group that is not known"))))
    seen, told = Observation(), Observation()
    passing = checked.observe(seen, *[F.count_if(F.col(by) == r).alias(f"r{i}") for i, r in enumerate(reasons)]).where(F.col(by) == keep)
    each = [F.count_if(F.col(group) == v).alias(f"v{i}") for i, v in enumerate(values)]
    each += [F.sum(F.when(F.col(group) == v, F.col(c)).otherwise(0)).cast("long").alias(f"v{i}_{j}") for i, v in enumerate(values) for j, c in enumerate(sums)]
    passing.observe(told, *each).drop(by).write.parquet(folder)
    spark = rows.sparkSession
    account = [(r, seen.get[f"r{i}"]) for i, r in enumerate(reasons) if seen.get[f"r{i}"]]
    totals = [(v, told.get[f"v{i}"], *[told.get[f"v{i}_{j}"] or 0 for j in range(len(sums))]) for i, v in enumerate(values)]
    schema = f"`{group}` string, rows long" + "".join(f", `{c}` long" for c in sums)
    return spark.createDataFrame(account, "reason string, n_rows long"), spark.createDataFrame(totals, schema)


def append_new(rows: DataFrame, folder: str, key: str, payload: str) -> int:
    """Append the rows whose key is not there yet. The same key with another payload stops the whole append."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key, payload])
    if fresh.groupBy(key).count().where("count > 1").count():
        raise GateError("one key with several payloads")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        fresh = settle(fresh)
        fresh.write.parquet(folder)
        return fresh.count()
    there = spark.read.parquet(folder)
    if not fresh.alias("n").join(there.alias("o"), key).where(f"n.`{payload}` <> o.`{payload}`").isEmpty():
        raise GateError("a key is there with another payload")
    missing = settle(fresh.join(there, key, "left_anti"))
    missing.write.mode("append").parquet(folder)
    return missing.count()
