"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier (smaller doc_id, or the
same document and an earlier start). Only suffixes at anchors enter the sort. An anchor is a position
whose GRAM-byte hash is the smallest in some window of LENGTH bytes, so equal windows hold equal anchors
at equal places, about one for 35 bytes; the context of an anchor is what windows around it can reach,
68 bytes before and 100 after it.

1. Anchors go by the hash of their gram to one partition and are sorted there. A context with the hashes
   of an earlier one is covered if its bytes are equal too. Within an Arrow batch this is checked before
   the shuffle, so a text with a third of all rows arrives once for each batch. Across batches,
   contexts that touch and repeat one document at one distance form a run; the bytes of both sides of a
   run are joined and compared. Contexts of a run that differs go into the sort, with those they
   were taken for.
2. What is left are first contexts whose gram also occurs in others: edges of copies. Their bytes are
   fetched, and their suffixes sorted by a mergesort whose comparisons find the common extension of
   two suffixes by binary search over prefix polynomial hashes. Suffixes that start one byte earlier
   follow by one stable pass over that byte. Neighbours that agree in LENGTH bytes, checked byte by
   byte, are repeats; the earliest of them stays. So a sorted group has at most HOT contexts. The
   windows of a gram with more stay out of the sort: each goes to the partition of its own hash, once
   for a stretch of an Arrow batch, and of equal windows, which follow each other in document order
   there, all but the first are repeats. No task holds them.
3. Covers are gathered for each document and applied to its bytes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.polyhash import Poly, byte_view, chunks, mix
from millrace.llm.scratch import small, write

LENGTH = 100
GRAM = 32
LEFT = LENGTH - GRAM
SPAN = LEFT + LENGTH
#: Grams with more first contexts than this are split by window.
HOT = 50_000
#: Windows of such grams and contexts fetched at once.
FETCHED_ROWS = 20_000
#: Contexts sorted at once (a group is never divided).
SORTED_ROWS = 8000
#: Contexts of a batch compared at once.
COMPARED_ROWS = 1 << 16
_FIRST, _SECOND = Poly(61), Poly(62)
_NO_ID = -(1 << 63)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over all windows of so many elements."""
    size = 1
    while size * 2 <= width:
        x, size = op(x[:-size], x[size:]), size * 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts between cuts: positions of anchors in data, their texts, hashes of grams and of contexts."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = _FIRST.prefix(data)
    gram = np.maximum(mix((prefix[GRAM:] - prefix[:-GRAM]) * _FIRST.down[: n - GRAM + 1]), np.uint64(1))
    least = _slide(gram, LEFT + 1, np.minimum)
    for cut in cuts[1:-1]:  # windows that reach into the next text count for nothing
        least[max(0, cut - LENGTH + 1) : cut] = 0
    most = _slide(np.pad(least, LEFT), LEFT + 1, np.maximum)
    at = np.flatnonzero(gram == most)
    text = np.searchsorted(cuts, at, side="right") - 1
    start, end = np.maximum(cuts[text], at - LEFT), np.minimum(cuts[text + 1], at + LENGTH)
    shape = ((at - start) * 256 + (end - at)).astype(np.uint64)
    context = mix(_SECOND.stretch(_SECOND.prefix(data), start, end) ^ mix(shape))
    return at, text, gram[at], context


def _merged(start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of intervals sorted by (key, start) with equal lengths: the places where a new stretch begins."""
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > end[:-1])
    return np.flatnonzero(new)


def _equal_contexts(data: np.ndarray, start: np.ndarray, end: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether the bytes of data from start to end are those of the other stretch. Contexts have LENGTH to SPAN bytes,
    so their first and last LENGTH bytes are all of them."""
    equal = end - start == other_end - other_start
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    for i in range(0, len(start), COMPARED_ROWS):
        part = slice(i, i + COMPARED_ROWS)
        equal[part] &= (windows[start[part]] == windows[other_start[part]]).all(axis=1)
        equal[part] &= (windows[end[part] - LENGTH] == windows[other_end[part] - LENGTH]).all(axis=1)
    return equal


def _find_anchors(batches: Iterator[pa.RecordBatch], bits: int = 64) -> Iterator[pa.RecordBatch]:
    """From (k, tie, text) to (route, context, k, tie, start, end): anchors with end 0, and covers that the batch knows.

    bits: how many the hash of a context has.
    """
    for batch in batches:
        ids, ties = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        data, offsets = byte_view(batch.column(2))
        parts = []
        for first, last in chunks(offsets):
            cuts = offsets[first : last + 1] - offsets[first]
            at, text, gram, context = anchors(data[offsets[first] : offsets[last]], cuts)
            parts.append((at - cuts[text], text + first, gram, context >> np.uint64(64 - bits)))
        at, text, gram, context = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ties, ids))] = np.arange(len(ids))
        order = np.lexsort((at, rank[text], context))
        at, text, gram, context = at[order], text[order], gram[order], context[order]
        sizes = np.diff(offsets)
        again = np.zeros(len(at), bool)
        again[1:] = (context[1:] == context[:-1]) & (gram[1:] == gram[:-1])
        if again.any():
            at_first = np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
            x = np.flatnonzero(again)
            y = at_first[x]
            begins = [offsets[text[i]] + np.maximum(at[i] - LEFT, 0) for i in (x, y)]
            ends = [offsets[text[i]] + np.minimum(at[i] + LENGTH, sizes[text[i]]) for i in (x, y)]
            again[x] = _equal_contexts(data, begins[0], ends[0], begins[1], ends[1])
        here, of = at[again], text[again]
        order = np.lexsort((here, of))
        here, of = here[order], of[order]
        low, high = np.maximum(here - LEFT, 0), np.minimum(here + LENGTH, sizes[of])
        new = _merged(low, high, of)
        ends = np.append(new[1:], len(here)) - 1 if len(new) else new
        at, text, gram, context = at[~again], text[~again], gram[~again], context[~again]
        owner = np.concatenate([text, of[new]])
        start = np.concatenate([at, low[new]])
        route = np.concatenate([gram, mix((ids[of[new]] * 31 + low[new]).astype(np.uint64))])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(route.astype(np.int64)),
                pa.array(np.concatenate([context.astype(np.int64), np.zeros(len(new), np.int64)])),
                pa.array(ids[owner], pa.int64()),
                pa.array(ties[owner], pa.int64()),
                pa.array(start, pa.int32()),
                pa.array(np.concatenate([np.zeros(len(at), np.int64), high[ends]]), pa.int32()),
            ],
            ["route", "context", "k", "tie", "start", "end"],
        )


def _split_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted anchors to (k, tie, start, end, gram, of_k, of_tie, shift).

    With end above 0: covers. With end 0: first contexts whose gram has others. With end -1: contexts with the
    hashes of an earlier one, which is shift bytes before them if both texts are laid one over the other.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    names = ["k", "tie", "start", "end", "gram", "of_k", "of_tie", "shift"]

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    before = None  # gram and context of the last anchor, and (k, tie, start) of the first one like it
    waiting = None  # the only context so far of its gram
    for batch in batches:
        route, context, k, tie, start, end = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        known = end > 0
        none = np.zeros(int(known.sum()), np.int64)
        done = [x[known] for x in (k, tie, start, end, route)] + [none] * 3
        route, context, k, tie, start = (x[~known] for x in (route, context, k, tie, start))
        if not len(route):
            yield out(done)
            continue
        new_gram, new_context = np.ones(len(route), bool), np.ones(len(route), bool)
        new_gram[1:] = route[1:] != route[:-1]
        new_context[1:] = new_gram[1:] | (context[1:] != context[:-1])
        if before and before[0] == route[0]:
            new_gram[0] = False
            new_context[0] = before[1] != context[0]
        again, first = np.flatnonzero(~new_context), np.flatnonzero(new_context)
        # The first context of each: of this batch, or (-1) of an earlier batch.
        which = np.maximum.accumulate(np.where(new_context, np.arange(len(route)), -1))
        of = [np.where(which < 0, b, x[np.maximum(which, 0)]) for x, b in zip((k, tie, start), before[2] if before else (0, 0, 0), strict=True)]
        some = [k[again], tie[again], start[again], np.full(len(again), -1), route[again], of[0][again], of[1][again], start[again] - of[2][again]]
        zero = np.zeros(len(first), np.int64)
        rows = [x[first] for x in (k, tie, start)] + [zero, route[first]] + [zero] * 3
        opens = new_gram[first]
        followed = np.append(~opens[1:], False)
        keep = ~opens | followed
        if waiting is not None and len(first) and not opens[0] and waiting[4] == rows[4][0]:
            some = [np.append(a, b) for a, b in zip(some, waiting, strict=True)]
        if len(first):
            waiting = tuple(x[-1] for x in rows) if opens[-1] else None
        before = (route[-1], context[-1], tuple(x[-1] for x in of))
        yield out([np.concatenate([a, b, c[keep]]) for a, b, c in zip(done, some, rows, strict=True)])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (k, tie, text, novel) to (gram, k, tie, at, left, bytes, end): contexts with end 0.

    Of hot grams every window, with left -1; those that the stretch has seen become covers (end > 0).
    """
    names = ["gram", "k", "tie", "at", "left", "bytes", "end"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        ids, ties = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        rows: list[tuple] = []
        seen: set[bytes] = set()  # windows of the stretch; texts come in document order
        for i in np.lexsort((ties, ids)).tolist():
            k, tie, data = int(ids[i]), int(ties[i]), (batch.column(2)[i].as_py() or "").encode()
            begin, low, high = 0, -1, -1  # the next window, and the stretch of bytes known to be covered
            for one in sorted(batch.column(3)[i].as_py(), key=lambda x: x["start"]):
                at = one["start"]
                if not one["hot"]:
                    rows.append((one["gram"], k, tie, at, min(at, LEFT), data[max(0, at - LEFT) : at + LENGTH], 0))
                    continue
                for start in range(max(begin, at - LEFT), min(at, len(data) - LENGTH) + 1):
                    begin = start + 1
                    window = data[start : start + LENGTH]
                    if window in seen:
                        if start > high:
                            if high > 0:
                                rows.append((low * 31 + k >> 1, k, tie, low, 0, b"", high))
                            low = start
                        high = start + LENGTH
                        continue
                    seen.add(window)
                    group = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                    rows.append((group, k, tie, start, -1, window, 0))
                    if len(rows) >= FETCHED_ROWS:
                        yield out(rows)
                        rows, seen = [], set()
            if high > 0:
                rows.append((low * 31 + k >> 1, k, tie, low, 0, b"", high))
            if len(rows) >= FETCHED_ROWS:
                yield out(rows)
                rows, seen = [], set()
        yield out(rows)


class Suffixes:
    """Contexts in rows of SPAN bytes, grouped by gram and in document order within a group.

    place: a number that rises with the place of the anchor; rows of equal documents share it.
    """

    def __init__(self, gram: np.ndarray, left: np.ndarray, contexts: pa.Array, place: np.ndarray | None = None):
        self.place = np.arange(len(gram)) if place is None else place
        data, offsets = byte_view(contexts)
        n = len(gram)
        size = np.diff(offsets)
        self.left, self.right = left.astype(np.int64), size - left
        self.bytes = np.zeros((n, SPAN), np.uint8)
        row = np.repeat(np.arange(n), size)
        self.bytes[row, np.arange(len(data)) - np.repeat(offsets[:-1], size) + np.repeat(LEFT - self.left, size)] = data
        self.flat = self.bytes.ravel()
        self.prefix = _FIRST.prefix(self.flat)
        self.base = np.arange(n) * SPAN + LEFT
        new = np.ones(n, bool)
        new[1:] = gram[1:] != gram[:-1]
        self.group = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], n)
        self.begin, self.end = begins[self.group], ends[self.group]
        self.largest = int((ends - begins).max()) if n else 0

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by binary search over prefix hashes."""
        a, b = self.base[x], self.base[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.right[x], self.right[y])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = _FIRST.stretch(self.prefix, a, a + mid) == _FIRST.stretch(self.prefix, b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Below, at or above 0 as suffix x sorts before, with or after suffix y."""
        n = self.common(x, y)
        ended = n == np.minimum(self.right[x], self.right[y])
        last = len(self.flat) - 1
        one, two = self.flat[np.minimum(self.base[x] + n, last)].astype(np.int64), self.flat[np.minimum(self.base[y] + n, last)].astype(np.int64)
        return np.where(ended, self.right[x] - self.right[y], one - two)

    def sort(self) -> np.ndarray:
        """The suffixes at the anchors in order within each group: mergesort, all merges of a level at once.

        An element's place after a merge is its place in its own run and the number of elements of the
        other run that sort before it, found by binary search.
        """
        order, width = np.arange(len(self.group)), 1
        while width < self.largest:
            p = np.flatnonzero(self.end - self.begin > width)
            begin, end, mine = self.begin[p], self.end[p], order[p]
            run, place = np.divmod(p - begin, width)
            right = run % 2 == 1
            start = np.minimum(begin + (run ^ 1) * width, end)
            low, high = start.copy(), np.minimum(start + width, end)
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) >> 1
                sign = self.compare(order[mid], mine[open_])
                after = (sign < 0) | (right[open_] & (sign == 0))
                low[open_], high[open_] = np.where(after, mid + 1, low[open_]), np.where(after, high[open_], mid)
            order[begin + (run // 2) * 2 * width + place + low - start] = mine
            width *= 2
        return order

    def repeats(self) -> np.ndarray:
        """For each context and each number of bytes before its anchor: whether the window there occurs earlier."""
        found = np.zeros((len(self.group), LEFT + 1), bool)
        order = self.sort()
        for back in range(LEFT + 1):
            if back:
                order = order[self.left[order] >= back]
                order = order[np.argsort(self.group[order] * 256 + self.bytes[order, LEFT - back], kind="stable")]
            whole = order[self.right[order] >= LENGTH - back]
            if len(whole) < 2:
                continue
            start = self.base[whole] - back
            key = _FIRST.stretch(self.prefix, start, start + LENGTH)
            same = (key[1:] == key[:-1]) & (self.group[whole[1:]] == self.group[whole[:-1]])
            i = np.flatnonzero(same)
            columns = slice(LEFT - back, LEFT - back + LENGTH)
            equal = (self.bytes[whole[i], columns] == self.bytes[whole[i + 1], columns]).all(axis=1)
            if not equal.all():  # equal hashes of different bytes: this step is done on the bytes
                whole = np.array(sorted(whole, key=lambda r: (self.group[r], self.bytes[r, columns].tobytes())))
                same = (self.group[whole[1:]] == self.group[whole[:-1]]) & (self.bytes[whole[1:], columns] == self.bytes[whole[:-1], columns]).all(axis=1)
            begins = np.flatnonzero(np.concatenate([[True], ~same]))
            place = self.place[whole]
            earliest = np.repeat(np.minimum.reduceat(place, begins), np.diff(np.append(begins, len(whole))))
            found[whole[place > earliest], back] = True
        return found


def _sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From what _fetch gives, sorted by (gram, window if hot, k, tie, at), to covers (k, tie, start, end)."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["k", "tie", "start", "end"])

    def covers(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        gram, k, tie, at, left = (table.column(i).to_numpy() for i in range(5))
        contexts = table.column(5).combine_chunks() if table.column(5).num_chunks != 1 else table.column(5).chunk(0)
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (k[1:] != k[:-1]) | (tie[1:] != tie[:-1]) | (at[1:] != at[:-1])
        found = np.pad(Suffixes(gram, left, contexts, np.cumsum(new)).repeats(), ((0, 0), (1, 1))).astype(np.int8)
        change = np.diff(found, axis=1)
        row, first = np.nonzero(change == 1)  # from so many bytes before the anchor
        _, last = np.nonzero(change == -1)  # up to less than so many
        return out([k[row], tie[row], at[row] - last + 1, at[row] - first + LENGTH])

    held: list[pa.RecordBatch] = []
    rows = 0
    before = b""  # the last hot window
    for batch in batches:
        left, end = batch.column(4).to_numpy(), batch.column(6).to_numpy()
        known, hot = end > 0, left < 0
        if known.any():
            yield out([batch.column(i).to_numpy()[known] for i in (1, 2, 3, 6)])
        if hot.any():
            some = batch.filter(pa.array(hot))
            windows = byte_view(some.column(5))[0].reshape(-1, LENGTH)
            again = np.empty(len(windows), bool)
            again[0] = windows[0].tobytes() == before
            again[1:] = (windows[1:] == windows[:-1]).all(axis=1)
            before = windows[-1].tobytes()
            k, tie, at = (some.column(i).to_numpy()[again] for i in (1, 2, 3))
            yield out([k, tie, at, at + LENGTH])
        if (known | hot).any():
            batch = batch.filter(pa.array(~(known | hot)))
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < SORTED_ROWS:
            continue
        table = pa.Table.from_batches(held)
        gram = table.column(0).to_numpy()
        cut = int(np.flatnonzero(gram != gram[-1]).max(initial=-1)) + 1
        if cut:
            yield covers(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows -= cut
    if rows:
        yield covers(pa.Table.from_batches(held))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (k, text, covers) to (k, n_bytes, kept, spans)."""
    for batch in batches:
        rows = []
        for k, text, covers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = (text or "").encode()
            if not covers:
                rows.append((k, len(data), data, 0))
                continue
            edges = np.zeros(len(data) + 1, np.int64)
            for c in covers:
                edges[min(c["start"], len(data))] += 1
                edges[min(c["end"], len(data))] -= 1
            gone = np.cumsum(edges)[:-1] > 0
            spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            rows.append((k, len(data), np.frombuffer(data, np.uint8)[~gone].tobytes(), spans))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["k", "n_bytes", "kept", "n_spans"])


def _compare_runs(alike: DataFrame, single: DataFrame) -> DataFrame:
    """Runs of contexts alike by hash, with the stretch (start, end) of each and whether its bytes are equal (same)."""
    keys = ["k", "tie", "of_k", "of_tie", "shift"]
    ordered = Window.partitionBy(*keys).orderBy("start")
    apart = (F.col("start") - F.lag("start").over(ordered) > SPAN).cast("int")
    runs = alike.select(*keys, "start", F.coalesce(apart, F.lit(0)).alias("apart")).withColumn("run", F.sum("apart").over(ordered))
    runs = runs.groupBy(*keys, "run").agg(F.greatest(F.min("start") - LEFT, F.lit(0)).alias("start"), (F.max("start") + LENGTH).alias("end"))
    texts = single.select("k", "tie", F.col("text").cast("binary").alias("bytes"))
    size = F.col("end") - F.col("start")
    earlier = F.when(F.col("start") >= F.col("shift"), F.substring("bytes", F.col("start") - F.col("shift") + 1, size))
    runs = runs.join(texts.withColumnsRenamed({"k": "of_k", "tie": "of_tie"}), ["of_k", "of_tie"]).select(*keys, "start", "end", earlier.alias("earlier"))
    same = F.substring("bytes", F.col("start") + 1, size).eqNullSafe(F.col("earlier"))
    return runs.join(texts, ["k", "tie"]).select(*keys, "start", "end", same.alias("same"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, kept binary, n_spans): one row for each row of docs, kept are the bytes that stay.

    doc_id is a whole number; null counts as the smallest. Null texts are empty; texts under LENGTH bytes
    stay whole. Rows that share id and text are one document; rows that share the id only are ordered by
    a hash of their text. An empty table gives an empty frame. bits of a context's hash are used: with
    fewer, more contexts are taken for equal and then told apart by their bytes, and the result is the same.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("k"), F.col(text).alias("text"))
    unique = plain.groupBy("k").count().where("count > 1").isEmpty()
    keyed = plain.select("k", (F.lit(0) if unique else F.xxhash64("text")).cast("long").alias("tie"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id and text are one document.
    single = keyed if unique else keyed.dropDuplicates(["k", "tie"])
    found = single.mapInArrow(functools.partial(_find_anchors, bits=bits), "route long, context long, k long, tie long, start int, end int")
    found = found.repartition(parts, "route").sortWithinPartitions("route", "context", "k", "tie", "start")
    kinds = "k long, tie long, start int, end int, gram long, of_k long, of_tie long, shift int"
    split = write(found.mapInArrow(_split_contexts, kinds), "contexts").df
    alike = split.where("end < 0")
    runs = write(_compare_runs(alike, single), "runs").df
    differ = write(runs.where("not same").drop("same").withColumnsRenamed({"start": "low", "end": "high"}), "differ")
    wrong = alike.join(small(differ), ["k", "tie", "of_k", "of_tie", "shift"]).where("start between low and high")
    sides = F.array(F.struct("k", "tie", "start"), F.struct(F.col("of_k").alias("k"), F.col("of_tie").alias("tie"), (F.col("start") - F.col("shift")).alias("start")))
    wrong = wrong.select("gram", F.explode(sides).alias("one")).select("one.*", "gram").distinct()
    novel = split.where("end = 0").select("k", "tie", "start", "gram").unionByName(wrong)
    hot = write(novel.groupBy("gram").count().where(F.col("count") > HOT).select("gram", F.lit(True).alias("hot")), "hot")
    novel = novel.join(small(hot), "gram", "left").select("k", "tie", F.struct("start", "gram", F.coalesce("hot", F.lit(False)).alias("hot")).alias("one"))
    lists = novel.groupBy("k", "tie").agg(F.collect_list("one").alias("novel"))
    fetched = single.join(lists, ["k", "tie"]).select("k", "tie", "text", "novel").mapInArrow(_fetch, "gram long, k long, tie long, at int, left int, bytes binary, end int")
    fetched = fetched.repartition(parts, "gram").sortWithinPartitions("gram", F.when(F.col("left") < 0, F.col("bytes")), "k", "tie", "at")
    sorted_ = fetched.mapInArrow(_sort_suffixes, "k long, tie long, start int, end int")
    equal = split.where("end > 0").unionByName(runs.where("same"), allowMissingColumns=True).select("k", "tie", "start", "end")
    covers = equal.unionByName(sorted_)
    covers = write(covers.groupBy("k", "tie").agg(F.collect_list(F.struct("start", "end")).alias("covers")), "covers").df
    applied = keyed.join(covers, ["k", "tie"], "left").select("k", "text", "covers").mapInArrow(_apply, "k long, n_bytes long, kept binary, n_spans long")
    return applied.select(F.when(F.col("k") != _NO_ID, F.col("k")).alias("doc_id"), "n_bytes", "kept", "n_spans")


def decisions(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    found = remove_repeats(docs, bits=bits)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
