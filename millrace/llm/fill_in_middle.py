"""Fill-in-middle: a text is cut in three and its parts are put in another order, with marks between.

Which form a document takes and where it is cut follows from SHA-256 of its id, in SQL functions. The
cutting itself is done in Arrow batches: the text becomes an array of UTF-32 code points, each gets a
class, neighbours of different class have a boundary between them (flatnonzero), the two chosen ranks
index the boundaries, and the slices are encoded again. Boundaries of long texts are counted block by
block, so beside the text and its code points no array grows with it.

Forms: plain is the text itself; psm is prefix, suffix, middle; spm is suffix, prefix, middle. Each
part follows its mark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import lean

#: Code points whose boundaries are found at once.
BLOCK = 1 << 18
#: Texts of this many characters together make an output batch (one longer text is a batch of its own).
BATCH_CHARS = 1 << 20
#: The code points that Unicode calls white space.
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


class Marks(NamedTuple):
    """What stands before prefix, suffix and middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _checked(marks: Marks) -> Marks:
    """No mark can come into being where a mark meets a text: a first character occurs nowhere else in them."""
    firsts = {m[:1] for m in marks}
    if any(not m or firsts & set(m[1:]) for m in marks) or any(a != b and a.startswith(b) for a in marks for b in marks) or len(set(marks)) < 3:
        raise ValueError("marks must differ, none may begin another, and their first characters may occur nowhere else in them")
    return marks


def classes(codes: np.ndarray, unit: str, at: int = 0) -> np.ndarray:
    """A class for each code point, the first of which stands at place at; a unit is a run of one class.

    char: each code point for itself. word: white space or not. line: a line with its end.
    """
    if unit == "char":
        return (np.arange(at, at + len(codes)) & 1).astype(np.int64)
    if unit == "word":
        return np.isin(codes, WHITE).astype(np.int64)
    if unit == "line":
        ended = codes == 10
        return np.cumsum(ended) - ended
    raise ValueError(f"unknown unit {unit}")


def _blocks(codes: np.ndarray, unit: str) -> Iterator[np.ndarray]:
    """The boundaries inside a text, block by block: before which code points a new unit begins."""
    for start in range(0, len(codes), BLOCK):
        first = max(start - 1, 0)  # the neighbour on the left is looked at again
        kind = classes(codes[first : start + BLOCK], unit, first)
        yield np.flatnonzero(kind[1:] != kind[:-1]) + first + 1


def cut_points(codes: np.ndarray, unit: str, a: int, b: int) -> tuple[int, int, int]:
    """n units, and the code points before the ends of prefix and middle: the smaller and the larger of a and b modulo n + 1 units."""
    if not len(codes):
        return 0, 0, 0
    n = 1 + sum(len(x) for x in _blocks(codes, unit))
    ends, passed = {0: 0, n: len(codes)}, 0
    wanted = sorted((a % (n + 1), b % (n + 1)))
    if any(0 < x < n for x in wanted):
        for found in _blocks(codes, unit):
            for x in wanted:  # the end of unit x is boundary x, counted from 1
                if passed < x <= passed + len(found) and x < n:
                    ends[x] = int(found[x - passed - 1])
            passed += len(found)
    return n, ends[wanted[0]], ends[wanted[1]]


def rearranged(text: str, form: str, a: int, b: int, unit: str, marks: Marks) -> tuple[int, int | None, int | None, str]:
    """n units, code points of prefix and middle (None if plain), and the output."""
    coded = text.encode("utf-32-le")
    n, first, last = cut_points(np.frombuffer(coded, np.uint32), unit, a, b)
    if form == "plain":
        return n, None, None, text
    prefix, middle, suffix = (coded[4 * i : 4 * j].decode("utf-32-le") for i, j in ((0, first), (first, last), (last, len(coded) // 4)))
    parts = [marks.prefix, prefix, marks.suffix, suffix] if form == "psm" else [marks.suffix, suffix, marks.prefix, prefix]
    return n, first, last - first, "".join([*parts, marks.middle, middle])


def transformed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "char", percent: int = 90, percent_spm: int = 20, seed: str = "1", marks: Marks = Marks()
) -> DataFrame:
    """One row for each row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    Of the hexadecimal SHA-256 of seed:doc_id the four first groups of eight digits are h1 to h4. Of
    the n units of a text the prefix has the smaller of h1 and h2 modulo n + 1, prefix and middle
    the larger. h3 modulo 100 below percent makes the document no plain one, h4 modulo 100 below
    percent_spm makes it spm. A text that is empty or holds a mark is plain. Null text counts as empty, a
    null id has no digits; rows of one id are alike in their numbers, and stay apart. Other columns,
    whatever their names, are not read. An empty table gives an empty frame.
    """
    marks = _checked(marks)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), digest.alias("digest"))
    held = F.lit(False)
    for mark in marks:
        held |= F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | held | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < percent_spm, "spm").otherwise("psm")
    kind = docs.schema[doc_id].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, chars, first = batch.column(0), [], 0, 0
            given = zip(*(batch.column(i) for i in range(1, 5)), strict=True)
            for row, values in enumerate(given):
                whole, name, a, b = (v.as_py() for v in values)
                held.append((name, *rearranged(whole, name, a, b, unit, marks)))
                chars += len(whole)
                if chars >= BATCH_CHARS:
                    yield _out(ids.slice(first, row + 1 - first), held)
                    held, chars, first = [], 0, row + 1
            yield _out(ids.slice(first), held)

    return rows.select("doc_id", "text", form.alias("form"), h[0].alias("a"), h[1].alias("b")).mapInArrow(
        run, f"doc_id {kind}, form string, n long, prefix_chars long, middle_chars long, output string"
    )


def _out(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    form, n, prefix, middle, output = zip(*rows, strict=True) if rows else [()] * 5
    longs = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
    return pa.RecordBatch.from_arrays([ids, pa.array(form, pa.string()), *longs, pa.array(output, pa.string())], ["doc_id", "form", "n", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    marks = _checked(marks)
    middle = F.substring_index(output, marks.middle, -1)
    before = F.substring_index(output, marks.middle, 1)
    # What two marks begin: the part after the second one, and the part between the two.
    parts = lambda first, second: (F.substring(F.substring_index(before, second, 1), len(first) + 1, 1 << 30), F.substring_index(before, second, -1))
    (p, s), (t, q) = parts(marks.prefix, marks.suffix), parts(marks.suffix, marks.prefix)
    return F.when(form == "psm", F.concat(p, middle, s)).when(form == "spm", F.concat(q, middle, t)).otherwise(output)


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text restored from it."""
    made = transformed(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
