"""Line deduplication with a deletion-neighbourhood join.

A line is dropped if an earlier line (smaller doc_id, or the same document and a smaller line number)
is equal, or within one edit (insertion, deletion or substitution of a character), whether that earlier
line itself stays or not: so a chain of lines, each an edit from the one before, leaves its first. Blank
lines (of white space in any script, a carriage return too) always stay.

1. Equal lines are grouped by 128 bits of hash; each distinct line has its first place.
2. Two lines within one edit agree in the first or in the second half (of the shorter one). Distinct
   lines that share neither half with another line are settled; on real text this leaves few.
3. The others emit all variants within the bound: the line itself and the line without each one of its
   characters, as hashed keys with the place of the deletion. A line is one deletion away from another
   if that one's key is among its variants; two lines are a substitution apart if they agree after a
   deletion at the same place. A key has two hashes of residues modulo a prime, 124 bits together, so that
   no stranger's key hides a partner. Keys are joined with the earliest line of the key, which is enough to
   know that an earlier line exists; pairs are never emitted, so a key that many lines share stays linear.
4. The edit distance of each line found and its earlier partner is verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.polyhash import Residues
from millrace.llm.scratch import small, write

_HASHES = Residues(91)
_KEY = ["key", "key2"]
_PLACE = ["k", "tie", "at"]
_NO_ID = -(1 << 63)
#: A line with this is not blank.
_INK = r"(?U)[^\s\p{Zs}\p{Zl}\p{Zp}\x1c-\x1f]"


def variant_blocks(line: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Two hashes each of a line and of the line without its character i, and the places (-1, 0, 1, ...), block by block."""
    at = -1
    for one, two in _HASHES.deletions(np.frombuffer(line.encode(), np.uint8)):
        yield one.view(np.int64), two.view(np.int64), np.arange(at, at + len(one), dtype=np.int32)
        at += len(one)


def hashed_variants(line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All blocks together."""
    return tuple(np.concatenate(x) for x in zip(*variant_blocks(line), strict=True))


def variants(line: str) -> tuple[np.ndarray, np.ndarray]:
    """The first hash of each variant, and the places."""
    one, _, at = hashed_variants(line)
    return one, at


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A line's variants leave in blocks, so a long line needs little more than its own bytes."""
    for batch in batches:
        held, size = [], 0
        for i, line in zip(batch.column(0), batch.column(1), strict=True):
            for found in variant_blocks(line.as_py()):
                held.append((*found, np.full(len(found[0]), i.as_py())))
                size += len(found[0])
                if size > 100_000:
                    yield _variant_batch(held)
                    held, size = [], 0
        yield _variant_batch(held)


def _variant_batch(held: list) -> pa.RecordBatch:
    kinds = [np.int64, np.int64, np.int32, np.int64]
    columns = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, k) for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*_KEY, "at", "id"])


def _halves(line: Column, n: Column) -> list[Column]:
    """Hashes of the two halves, for a partner as long or longer (size n) and for a shorter one (size n - 1)."""
    out = []
    for size in (n, n - 1):
        half = F.floor(size / 2).cast("int")
        out += [F.xxhash64(F.lit(0), size, F.substring(line, F.lit(1), half)), F.xxhash64(F.lit(1), size, F.substring(line, n - size + half + 1, n))]
    return out


def near_lines(first: DataFrame, keyed: DataFrame, least_chars: int = 1) -> DataFrame:
    """Of distinct lines (a, b, n, halves, k, tie, at of the first place) those with an earlier line within one edit: (a, b).

    keyed: (k, tie, text), to read the lines that are not settled.
    """
    spread = first.where(F.col("n") >= least_chars).select("a", "b", F.explode("halves").alias("half"))
    shared = small(write(spread.groupBy("half").count().where("count > 1").select("half"), "shared"))
    some = spread.join(shared, "half").select("a", "b").distinct()
    places = first.join(some, ["a", "b"], "left_semi").select("a", "b", *_PLACE)
    # Ids in the order of first places: sorted, numbered in the order of partitions and written once.
    places = write(places.orderBy(*_PLACE).withColumn("id", F.monotonically_increasing_id()), "contenders")
    lists = small(write(places.df.groupBy("k", "tie").agg(F.collect_list(F.struct("at", "id", "a", "b")).alias("lines")), "wanted"))
    split = keyed.join(lists, ["k", "tie"]).select(F.split("text", "\n").alias("all"), F.explode("lines").alias("one"))
    texts = write(split.select("one.id", "one.a", "one.b", F.col("all")[F.col("one.at")].alias("line")).dropDuplicates(["id"]), "texts")
    rows = write(texts.df.select("id", "line").mapInArrow(_emit, "key long, key2 long, at int, id long"), "variants").df
    by_place = rows.groupBy(*_KEY, "at").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("c"))
    by_key = by_place.groupBy(*_KEY).agg(F.sum("c").alias("c"), F.min(F.when(F.col("at") >= 0, F.col("m"))).alias("cut"), F.min(F.when(F.col("at") < 0, F.col("m"))).alias("own"))
    several = small(write(by_key.where("c > 1").select(*_KEY, "cut", "own"), "keys"))
    near = rows.join(several, _KEY)
    same = small(write(by_place.where("c > 1 AND at >= 0").select(*_KEY, "at", F.col("m").alias("same")), "same"))
    near = near.join(same, [*_KEY, "at"], "left")
    partner = F.explode(F.when(F.col("at") < 0, F.array("cut")).otherwise(F.array("own", "same"))).alias("partner")
    pairs = near.select("id", partner).where("partner < id").distinct()
    earlier = texts.df.select(F.col("id").alias("partner"), F.col("line").alias("other"))
    checked = pairs.join(texts.df, "id").join(earlier, "partner").where(F.levenshtein("line", "other", 1) >= 0)
    return checked.select("a", "b").distinct()


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 1) -> DataFrame:
    """(doc_id, text, gone): each row of docs and the numbers (from 0) of its lines that go, null for none.

    Lines end at \\n. Lines of fewer than least_chars characters match only when equal. A null text is
    empty. A null id counts as the smallest. Rows that share id and text count as one place and are
    treated alike; rows that share the id only go by a hash of their text. Other columns, whatever their
    names, are not read. An empty table gives an empty frame.
    """
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("k"), F.xxhash64(F.col(text)).alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = keyed.select("k", "tie", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(_INK))
    n = F.length("line")
    marks = [F.xxhash64(F.lit(1), "line").alias("a"), F.xxhash64(F.lit(2), "line").alias("b")]
    places = lines.select(*_PLACE, *marks, n.alias("n"), F.when(n >= least_chars, F.array(*_halves(F.col("line"), n))).alias("halves"))
    first = places.groupBy("a", "b").agg(F.min(F.struct(*_PLACE)).alias("first"), F.any_value("n").alias("n"), F.any_value("halves").alias("halves"))
    first = write(first.select("a", "b", "n", "halves", "first.*"), "first")
    near = write(near_lines(first.df, keyed, least_chars), "near")
    stays = first.df.join(small(near), ["a", "b"], "left_anti").select(*_PLACE)
    gone = places.select(*_PLACE).distinct().join(stays, _PLACE, "left_anti")
    lists = write(gone.groupBy("k", "tie").agg(F.array_sort(F.collect_list("at")).alias("gone")), "gone")
    found = keyed.join(small(lists), ["k", "tie"], "left")
    return found.select(F.when(F.col("k") != _NO_ID, F.col("k")).alias("doc_id"), "text", "gone")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 1) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): the texts without the lines that go."""
    found = dropped_lines(docs, doc_id, text, least_chars)
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i))
    return found.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(F.split("text", "\n")).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"),
    )


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    return clean(docs).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
