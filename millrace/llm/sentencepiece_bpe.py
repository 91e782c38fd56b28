"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model says (here: spaces become the mark, one is put in front), cut
between any two characters that no piece holds side by side, and each segment is merged by a score-ordered agenda: all adjacent
symbol pairs that form a piece wait in a heap, the best score goes first and the leftmost of equals;
a merge adds the pairs with both neighbours. Symbols that are no piece fall back to bytes.

Segments repeat, so each worker keeps the ids of those it has seen, in flat arrays of bounded size; when
they are full, the segments seen again stay. Texts are cut on their code points, segments are numbered by
Arrow, and the ids of a stretch of texts are gathered at once. The
new short segments of a batch are merged together: their agendas are the columns of one array, of which
every round takes each column's best pair. Long segments have a heap each. Each Arrow batch is checked
against the sentencepiece library: where a text's ids differ, the library's ids are returned and
agenda_agrees is false.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.polyhash import byte_view, chunks
from millrace.llm.scratch import lean

#: The mark that stands for a space.
MARK = "▁"
#: Segments that a worker remembers.
CACHE_SEGMENTS = 250_000
#: Segments up to this many characters are merged in arrays.
SHORT = 24
#: Segments merged in one array, which then stays in the processor's cache.
LEARN_ROWS = 4_000
#: Bits of a place in a segment of SHORT characters.
PLACE_BITS = 5
#: Classes of characters; those beyond share the last one, and are cut less.
CLASSES = 2048
#: Code points looked up at once.
STRETCH = 1 << 20
#: Ids of symbols that are no piece: this and the code point.
LONE = 1 << 21
#: The score rank of a pair that forms no piece.
NEVER = np.iinfo(np.int32).max
#: Texts given to the library at once hold about this many characters.
CHUNK_CHARS = 500_000

OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string, agenda_agrees boolean"


class Agenda:
    """The ids of texts. Known segments are rows of flat arrays: rows[segment], and its ids from starts[row] on, sizes[row] of them."""

    def __init__(self, processor, cache: int = CACHE_SEGMENTS):
        self.cache = cache
        self.clear()
        n = processor.get_piece_size()
        plain = [i for i in range(n) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
        self.ids = {processor.id_to_piece(i): i for i in plain}
        # A lower rank is a better score.
        self.rank = {processor.id_to_piece(i): -processor.get_score(i) for i in plain}
        self.bytes = {int(processor.id_to_piece(i)[1:-1], 16): i for i in range(n) if processor.is_byte(i)}
        self.unknown = processor.unk_id()
        merged = [p for p in self.ids if len(p) > 1]
        self._neighbours(merged)

        # The symbol of each code point.
        self.single = np.arange(LONE, LONE + 0x110000, dtype=np.int32)
        for piece in self.ids:
            if len(piece) == 1:
                self.single[ord(piece)] = self.ids[piece]
        self.single[ord(" ")] = self.single[ord(MARK)]
        self._pairs(merged)

    def _neighbours(self, merged: list[str]) -> None:
        """Which characters stand side by side in a piece. Others are never merged into one, so texts may be cut between them.

        Characters of no longer piece have class 0.
        """
        self.classes = np.zeros(0x110000, np.uint16)
        for i, char in enumerate(sorted(set("".join(merged)))):
            self.classes[ord(char)] = min(i + 1, CLASSES - 1)
        self.classes[ord(" ")] = self.classes[ord(MARK)]
        self.joined = np.zeros(CLASSES * CLASSES, bool)
        beside = {piece[i : i + 2] for piece in merged for i in range(len(piece) - 1)}
        for left, right in beside:
            self.joined[int(self.classes[ord(left)]) * CLASSES + int(self.classes[ord(right)])] = True

    def _pairs(self, merged: list[str]) -> None:
        """All pairs of symbols that form a piece: their keys, ranks and ids, in a hash table with open places."""
        found = []
        for piece in merged:
            for i in range(1, len(piece)):
                left, right = piece[:i], piece[i:]
                if all(len(x) == 1 or x in self.ids for x in (left, right)):
                    found.append((self._symbol(left) << 22 | self._symbol(right), self.rank[piece], self.ids[piece]))
        found.sort()
        # Equal scores must stay equal, so that the leftmost pair wins.
        scores = sorted({x[1] for x in found})
        place = {x: i for i, x in enumerate(scores)}
        bits = max(8, (4 * len(found)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.pair_keys = np.full(1 << bits, -1, np.int64)
        self.pair_ranks = np.full(1 << bits, NEVER, np.int32)
        self.pair_ids = np.zeros(1 << bits, np.int32)
        keys = np.array([x[0] for x in found], np.int64)
        for at, (key, score, piece) in zip(self._slot(keys).tolist(), found, strict=True):
            while self.pair_keys[at] >= 0:
                at = (at + 1) & (len(self.pair_keys) - 1)
            self.pair_keys[at], self.pair_ranks[at], self.pair_ids[at] = key, place[score], piece

    def _symbol(self, symbol: str) -> int:
        return self.ids[symbol] if symbol in self.ids else LONE + ord(symbol)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that two symbols form; a symbol of -1 forms none."""
        key = (left.astype(np.int64) << 22) | right
        key[(left | right) < 0] = -1  # as open places, which are NEVER
        at = self._slot(key)
        found = self.pair_keys[at]
        further = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        while len(further):
            at[further] = (at[further] + 1) & (len(self.pair_keys) - 1)
            found = self.pair_keys[at[further]]
            further = further[(found != key[further]) & (found >= 0)]
        ranks = self.pair_ranks[at]
        ranks[self.pair_keys[at] != key] = NEVER
        return ranks, self.pair_ids[at]

    def clear(self) -> None:
        """Forget all segments. The empty one has no ids."""
        self.rows = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.again = np.zeros(1 << 14, bool)

    def trim(self) -> None:
        """Forget the segments that came in one call only; all of them, if that leaves over half of the table."""
        stay = self.again[: len(self.rows)]
        stay[0] = True  # the empty one
        which = np.flatnonzero(stay)
        sizes = self.sizes[which].astype(np.int64)
        segments = np.array(list(self.rows), object)[which].tolist()
        starts, flat = self.starts[which], self.flat
        self.clear()
        if 2 * len(which) <= self.cache and sizes.sum() <= 8 * self.cache:
            ends = np.cumsum(sizes)
            self._store(segments[1:], sizes[1:], flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])])

    def _store(self, segments: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Append segments and their ids, one after the other."""
        first, last = len(self.rows), len(self.rows) + len(segments)
        if last > len(self.starts):
            self.starts, self.sizes, self.again = (np.resize(x, 2 * last) for x in (self.starts, self.sizes, self.again))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.sizes[first:last] = sizes
        self.again[first:last] = False
        self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.rows.update(zip(segments, range(first, last), strict=True))

    def learn(self, segments: list[str]) -> None:
        """Put new short segments of one length range into the table, all merged together."""
        n = len(segments)
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, segments), np.int64, n)
        width, ends = int(lengths.max()), np.cumsum(lengths)
        column = np.repeat(np.arange(n), lengths)
        line = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
        # A symbol in line i of its column; the line after the last one stands for what is beyond both ends.
        place = line * n + column
        chars = self.single[codes]
        symbols = np.full((width + 1) * n, -1, np.int32)
        symbols[place] = chars
        following = np.append(chars[1:], np.int32(-1))
        following[ends - 1] = -1
        # The agenda: rank and line of the pair that begins here, the id of its piece, and its neighbours' lines.
        agenda, pieces = np.full((width + 1) * n, NEVER, np.int32), np.zeros((width + 1) * n, np.int32)
        ranks, pieces[place] = self._look(chars, following)
        agenda[place] = self._due(ranks, line)
        lines = np.arange(width + 1)
        after, before = np.repeat(lines + 1, n), np.repeat(lines - 1, n)
        after[place[ends - 1]] = width
        before[:n] = width
        table = agenda.reshape(width + 1, n)
        while True:
            best = table.min(axis=0)  # the leftmost of equal ranks
            active = np.flatnonzero(best != NEVER)
            if not len(active):
                break
            at = best[active] & ((1 << PLACE_BITS) - 1)
            here = at * n + active
            right = after[here] * n + active
            beyond = after[right]
            next_, last = beyond * n + active, before[here]
            previous = last * n + active
            symbols[here], symbols[right], agenda[right] = pieces[here], -1, NEVER
            after[here], before[next_] = beyond, at
            sides = np.concatenate([previous, here])
            ranks, pieces[sides] = self._look(symbols[sides], symbols[np.concatenate([here, next_])])
            agenda[sides] = self._due(ranks, np.concatenate([last, at]))
        left = symbols.reshape(width + 1, n).T
        there, odd = left >= 0, (left >= LONE).any(axis=1)
        plain = ~odd
        self._store([segments[i] for i in np.flatnonzero(plain).tolist()], there[plain].sum(axis=1), left[plain][there[plain]])
        for i in np.flatnonzero(odd).tolist():
            self._store_one(segments[i], [x for s in left[i][there[i]].tolist() for x in ([s] if s < LONE else self._fallback(chr(s - LONE)))])

    @staticmethod
    def _due(ranks: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Ranks with their lines, so that the least is the leftmost of the best."""
        return np.where(ranks == NEVER, NEVER, (ranks << PLACE_BITS) | lines)

    def _store_one(self, segment: str, ids: list[int]) -> None:
        self._store([segment], np.array([len(ids)]), np.array(ids, np.int32))

    def _fallback(self, symbol: str) -> list[int]:
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    def merge(self, segment: str) -> list[str]:
        """The symbols left when no adjacent pair forms a piece."""
        symbols: list[str] = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, heap = self.rank, []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = pair, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (new := symbols[left] + symbols[right]) in rank:
                    heapq.heappush(heap, (rank[new], left, new))
        return [s for s in symbols if s]

    def learn_long(self, segment: str) -> None:
        """Put one long segment into the table, merged by a heap of its own."""
        ids: list[int] = []
        for symbol in self.merge(segment.replace(" ", MARK)):
            ids += [self.ids[symbol]] if symbol in self.ids else self._fallback(symbol)
        self._store_one(segment, ids)

    def cut(self, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where the segments begin in code points, of which texts begin at firsts."""
        begins = np.ones(len(codes), bool)
        for low in range(0, len(codes) - 1, STRETCH):
            kinds = self.classes[codes[low : low + STRETCH + 1]].astype(np.int32)
            np.logical_not(self.joined[kinds[:-1] * CLASSES + kinds[1:]], out=begins[low + 1 : low + len(kinds)])
        begins[firsts[firsts < len(codes)]] = True
        return np.flatnonzero(begins)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        spaced = [" " + x if x else "" for x in texts]
        whole = "".join(spaced)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        firsts = np.cumsum([0, *map(len, spaced)])
        begins = self.cut(codes, firsts)
        coded = _strings(whole, codes, begins).dictionary_encode()
        segments = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.rows.get, segments, repeat(-1)), np.int64, len(segments))
        for forget in (self.trim, self.clear):
            if len(self.rows) + (known < 0).sum() > self.cache or self.used > 16 * self.cache:
                forget()
                known = np.fromiter(map(self.rows.get, segments, repeat(-1)), np.int64, len(segments))
        self.again[known[known >= 0]] = True
        open_ = np.flatnonzero(known < 0)
        new = [segments[i] for i in open_.tolist()]
        long = [x for x in new if len(x) > SHORT]
        # Those of about one length are merged together.
        short = sorted((x for x in new if len(x) <= SHORT), key=len)
        for start in range(0, len(short), LEARN_ROWS):
            self.learn(short[start : start + LEARN_ROWS])
        for segment in long:
            self.learn_long(segment)
        known[open_] = np.fromiter(map(self.rows.__getitem__, new), np.int64, len(new))
        row = known[coded.indices.to_numpy()]
        size = self.sizes[row].astype(np.int64)
        ends = np.cumsum(size)
        at = np.repeat(self.starts[row] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.flat[at].tolist()
        cuts = np.append(0, ends)[np.searchsorted(begins, firsts)].tolist()
        return [ids[first:last] for first, last in zip(cuts, cuts[1:])]


def _strings(whole: str, codes: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The segments of a text, which share its bytes; codes are its code points."""
    data = whole.encode()
    if len(data) == len(codes):
        places = np.append(begins, len(codes))
    else:
        widths = np.ones(len(codes), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            widths += codes >= least
        places = np.append(0, np.cumsum(np.add.reduceat(widths, begins, dtype=np.int64)))
    return pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data))


@lru_cache(maxsize=2)
def _loaded(model: bytes):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    return processor, Agenda(processor), [str(i) for i in range(processor.get_piece_size())].__getitem__


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@contextmanager
def _no_collector() -> Iterator[None]:
    """Nothing here makes reference cycles, and the collector would walk the whole table again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@_no_collector()
def encode_batch(texts: list[str], model: bytes) -> list[tuple[int, str, str, bool]]:
    """For each text: count of ids with the end id, digest of the ids, digest of the decoded text, agreement.

    The ids are the agenda's; the library's encoding is the check after it, and stands in where they differ.
    """
    processor, agenda, digits = _loaded(model)
    rows, start = [], 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars + len(texts[end]) <= CHUNK_CHARS):
            chars += len(texts[end])
            end += 1
        chunk = texts[start:end]
        found, agrees = agenda.encode(chunk), []
        for i, theirs in enumerate(processor.encode(chunk, num_threads=1)):
            agrees.append(found[i] == theirs)
            if not agrees[i]:
                found[i] = theirs
            found[i].append(processor.eos_id())
        for ids, decoded, same in zip(found, processor.decode(found, num_threads=1), agrees, strict=True):
            rows.append((len(ids), _hex(" ".join(map(digits, ids))), _hex(decoded), same))
        start = end
    return rows


def encode_documents(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, agenda_agrees.

    Null counts as empty; an empty text has the end id alone. Rows with the same id stay apart. The
    model file is read on the driver (half a MB) and goes to the tasks with the function.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    kind = docs.schema[doc_id].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], batch.column(1)
            for first, last in chunks(byte_view(texts)[1], CHUNK_CHARS):
                rows += encode_batch(texts.slice(first, last - first).to_pylist(), model)
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agenda_agrees"],
            )

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, {OUT}")
