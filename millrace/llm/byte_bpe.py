"""Byte-level BPE, encoding and decoding, for rank files.

Texts are cut into pieces without a regular expression. Each code point has a class; a class is a
function from states of a small automaton to states. Functions are composed by an associative scan:
code points are dealt to lanes, all lanes are composed step by step at once, then the lanes' totals are
composed in the same way, and the state before and after each code point is known. Two states (and
what follows) tell whether a piece begins there. Only few different functions exist, so each is a number
of one byte, and composing two is one look-up.

Pieces that repeat are merged once: each worker keeps the ids of those it has seen, in flat arrays of
bounded size. New short pieces are merged together, as rows of one array of which every round merges
each row's best pair; long ones have a heap each. Each token's end in the text is kept beside its id, and decoding writes by these ends.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.polyhash import byte_view, chunks
from millrace.llm.scratch import lean

#: Bytes of texts handled at once; a longer text is cut at ends of pieces.
CHUNK_BYTES = 1 << 20
#: Pieces and ids that a worker remembers, and the longest piece among them.
CACHE_PIECES, CACHE_IDS, CACHE_PIECE_BYTES = 250_000, 4_000_000, 512
#: Pieces up to so many bytes are merged in arrays, so many at once; longer ones with a heap.
SHORT_BYTES, LEARN_ROWS = 32, 4_000
#: Code points of a lane of the scan, at most.
LANE = 256
#: The rank of a pair that is no token, and the symbol right of a piece's end.
NEVER, NOTHING = np.iinfo(np.int32).max, -1

# States: before a text; in a run of letters, numbers or others; after white space, of which the blank
# goes with what follows; after an apostrophe that begins a piece; after 'r or 'v; after 'l; after a contraction.
START, LETTER, NUMBER, OTHER, WHITE, BLANK, APOSTROPHE, WANTS_E, WANTS_L, CONTRACTED = range(10)
STATES = 10
# Classes of code points. LETTERS are those in no contraction.
LETTERS, NUMBERS, OTHERS, WHITES, BLANKS, APOSTROPHES, ENDERS, E, L, R_OR_V = range(10)
CLASSES = 10
NOT_WHITE = [c not in (WHITES, BLANKS) for c in range(CLASSES)]


def _next(state: int, kind: int) -> int:
    """The state after a code point."""
    if kind in (NUMBERS, OTHERS, WHITES, BLANKS):
        return {NUMBERS: NUMBER, OTHERS: OTHER, WHITES: WHITE, BLANKS: BLANK}[kind]
    if kind == APOSTROPHES:
        return OTHER if state in (OTHER, APOSTROPHE, BLANK) else APOSTROPHE
    if state == APOSTROPHE:
        return {ENDERS: CONTRACTED, R_OR_V: WANTS_E, L: WANTS_L}.get(kind, LETTER)
    return CONTRACTED if (state, kind) in ((WANTS_E, E), (WANTS_L, L)) else LETTER


# Whether a piece begins between two states: no, yes, if no white space follows, if it becomes no contraction.
NO, YES, IF_INK, IF_PLAIN = range(4)


def _begins(before: int, after: int) -> int:
    if after in (WHITE, BLANK):
        # Of several white spaces the last one stands apart, if something follows.
        return IF_INK if before in (WHITE, BLANK) else YES
    if before in (START, WHITE, BLANK):
        return NO if before == BLANK else YES
    if after == NUMBER:
        return NO if before == NUMBER else YES
    if after in (OTHER, APOSTROPHE):
        return NO if before in (OTHER, APOSTROPHE) else YES
    if before == APOSTROPHE:
        return {CONTRACTED: NO, LETTER: YES}.get(after, IF_PLAIN)
    return NO if before in (LETTER, WANTS_E, WANTS_L) else YES


class Automaton:
    """The functions that classes make and all that come of composing them, by number."""

    def __init__(self):
        same = tuple(range(STATES))
        steps = [tuple(_next(s, c) for s in range(STATES)) for c in range(CLASSES)]
        # The first code point of a text forgets what was before.
        steps += [tuple(_next(START, c) for _ in range(STATES)) for c in range(CLASSES)]
        known, todo = {same: 0}, [same]
        while todo:
            f = todo.pop()
            for g in steps:
                made = tuple(g[x] for x in f)
                if made not in known:
                    known[made] = len(known)
                    todo.append(made)
        if len(known) > 256:
            raise ValueError("too many functions for a byte")
        self.size = len(known)
        self.of_class = np.array([known[f] for f in steps], np.uint8)
        self.composed = np.array([known[tuple(g[x] for x in f)] for f in known for g in known], np.uint8)
        self.applied = np.array(list(known), np.uint8)
        self.begins = np.array([_begins(a, b) for a in range(STATES) for b in range(STATES)], np.uint8)
        self.ink = np.array([*NOT_WHITE, *([False] * CLASSES)])

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        return self.composed[first.astype(np.uint16) * np.uint16(self.size) + then]

    def scan(self, functions: np.ndarray) -> np.ndarray:
        """At each place the composition of all functions up to it."""
        n = len(functions)
        if n <= 1:
            return functions
        steps = min(LANE, max(2, int(n**0.5)))
        lanes = -(-n // steps)
        padded = np.zeros(lanes * steps, np.uint8)
        padded[:n] = functions
        held = np.ascontiguousarray(padded.reshape(lanes, steps).T)
        for j in range(1, steps):
            held[j] = self.compose(held[j - 1], held[j])
        if lanes > 1:
            totals = self.scan(held[-1])
            held[:, 1:] = self.compose(np.broadcast_to(totals[:-1], (steps, lanes - 1)), held[:, 1:])
        return np.ascontiguousarray(held.T).reshape(-1)[:n]

    def boundaries(self, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Before which code points pieces begin; firsts: the places of first code points of texts."""
        if not len(kinds):
            return np.zeros(0, np.int64)
        kinds = kinds.copy()
        kinds[firsts] += CLASSES
        state = self.applied[self.scan(self.of_class[kinds]), START]
        before = np.concatenate([[np.uint8(START)], state[:-1]])
        case = self.begins[before * np.uint8(STATES) + state]
        ink_next = np.append(self.ink[kinds[1:]], False)
        plain_next = np.append(state[1:] != CONTRACTED, True)
        found = (case == YES) | ((case == IF_INK) & ink_next) | ((case == IF_PLAIN) & plain_next)
        found[firsts] = True
        return np.flatnonzero(found)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point. Which are letters, numbers and white space the tokenizer library says, whose Unicode may be newer than Python's."""
    import tiktoken

    table = np.full(0x110000, OTHERS, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    for pattern, kind in ((r"\p{L}", LETTERS), (r"\p{N}", NUMBERS), (r"\s", WHITES)):
        asked = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(asked.encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    for signs, kind in ((" ", BLANKS), ("'", APOSTROPHES), ("stmd", ENDERS), ("e", E), ("l", L), ("rv", R_OR_V)):
        table[[ord(c) for c in signs]] = kind
    return table


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton()


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the code points of UTF-8 bytes, and where each begins."""
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return class_table()[codes], np.flatnonzero((data & 0xC0) != 0x80)


def piece_starts(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """In UTF-8 bytes of texts, cut at cuts (one more than texts), where pieces begin."""
    kinds, starts = _code_points(data)
    texts = cuts[:-1][cuts[:-1] < cuts[1:]]
    return starts[automaton().boundaries(kinds, np.searchsorted(starts, texts))]


def windows(data: np.ndarray, width: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in stretches that end where a piece ends: where each begins, and its pieces' starts with the end of the last.

    A piece may begin where only the code point before and the next one are known, so a stretch ends
    at a start that is not its last code point; one without such a start is looked at with twice the width.
    """
    at, wide = 0, width
    while at < len(data):
        end = min(at + wide, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        kinds, starts = _code_points(data[at:end])
        begins = automaton().boundaries(kinds, np.zeros(1, np.int64))
        if end < len(data):
            begins = begins[begins < len(kinds) - 1]
            if len(begins) < 2:
                wide *= 2
                continue
            yield at, starts[begins]
            at, wide = at + int(starts[begins[-1]]), width
        else:
            yield at, np.append(starts[begins], end - at)
            at = end


class Merger:
    """The ids of pieces. Known pieces are rows of flat arrays: rows[piece], and its ids from starts[row] on, sizes[row] of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        # All pairs of tokens that make a token, by left and right one.
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.pair_keys = np.array([p[0] for p in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([p[1] for p in pairs] or [NEVER], np.int32)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that two make, which is its id too."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_ranks[at], np.int32(NEVER))

    def merge_rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has. The pair of the lowest rank becomes one token, the leftmost of equals."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        columns = np.arange(sizes.max() + 1)
        inside = columns < sizes[:, None]
        symbols = np.full(inside.shape, NOTHING, np.int32)
        symbols[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), len(columns) - 1), NEVER, np.int32)
        pair = inside[:, 1:]
        ranks[pair] = self._look(symbols[:, :-1][pair], symbols[:, 1:][pair])
        done = np.full(inside.shape, NOTHING, np.int32)
        rows, place = np.arange(len(pieces)), columns[:-1]
        while len(rows):
            at = ranks.argmin(axis=1)
            n = np.arange(len(rows))
            best = ranks[n, at]
            if (over := best == NEVER).any():
                done[rows[over]] = symbols[over]
                on = ~over
                rows, symbols, ranks, at, best = rows[on], symbols[on], ranks[on], at[on], best[on]
                n = np.arange(len(rows))
            symbols[n, at] = best
            # What stands right of the new token moves one place to the left.
            right = place > at[:, None]
            np.copyto(symbols[:, :-1], symbols[:, 1:], where=right)
            np.copyto(ranks[:, :-1], ranks[:, 1:], where=right[:, :-1])
            symbols[:, -1], ranks[:, -1] = NOTHING, NEVER
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._look(symbols[left, at[left] - 1], symbols[left, at[left]])
            ranks[n, at] = self._look(symbols[n, at], symbols[n, at + 1])
        there = done >= 0
        return done[there], there.sum(axis=1)

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one piece, with a heap of rank and place in one number; a pair that has changed meanwhile is passed over."""
        n, get = len(piece), self.ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        room = n.bit_length()
        heap = [r << room | i for i in range(n - 1) if (r := get(piece[i : i + 2], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & ((1 << room) - 1)
            j = after[i]
            if j >= n or j < 0 or get(piece[i : after[j]], NEVER) != top >> room:
                continue
            after[i], after[j] = after[j], -1
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (mid := after[left]) < n and (r := get(piece[left : after[mid]], NEVER)) != NEVER:
                    heapq.heappush(heap, r << room | left)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _store(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append pieces and their ids, one after the other."""
        first, last, total = len(self.rows), len(self.rows) + len(pieces), len(ids)
        if last > len(self.starts):
            self.starts, self.sizes = (np.resize(x, 2 * last) for x in (self.starts, self.sizes))
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + total))
        self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:last] = sizes
        self.flat[self.used : self.used + total] = ids
        self.used += total
        self.rows.update(zip(pieces, range(first, last), strict=True))

    def learn(self, pieces: list[bytes]) -> None:
        """Put new pieces into the table. One that is a token is that token, whatever its merges would give."""
        whole, short, long = [], {8: [], 16: [], SHORT_BYTES: []}, []
        for p in pieces:
            if p in self.ranks:
                whole.append(p)
            elif len(p) <= SHORT_BYTES:
                short[8 if len(p) <= 8 else 16 if len(p) <= 16 else SHORT_BYTES].append(p)
            else:
                long.append(p)
        self._store(whole, np.fromiter(map(self.ranks.__getitem__, whole), np.uint32, len(whole)), np.ones(len(whole), np.int64))
        for some in short.values():
            for start in range(0, len(some), LEARN_ROWS):
                part = some[start : start + LEARN_ROWS]
                self._store(part, *self.merge_rows(part))
        for p in long:
            ids = self.merge_long(p)
            self._store([p], np.array(ids, np.uint32), np.array([len(ids)]))

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and ends (places in data) of the tokens of all pieces, and how many tokens each piece has; bounds: starts of pieces, and the end."""
        n = len(bounds) - 1
        if n < 1:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        bounds = np.ascontiguousarray(bounds, np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.rows.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(self.rows) + int((known < 0).sum()) > CACHE_PIECES or self.used > CACHE_IDS:
            self.clear()
            known[:] = -1
        open_ = np.flatnonzero(known < 0)
        new = [distinct[i] for i in open_.tolist()]
        self.learn(new)
        known[open_] = np.fromiter(map(self.rows.__getitem__, new), np.int64, len(new))
        row = known[coded.indices.to_numpy()]
        size = self.sizes[row]
        done = np.cumsum(size)
        ids = self.flat[np.repeat(self.starts[row] - done + size, size) + np.arange(done[-1])]
        if max(map(len, new), default=0) > CACHE_PIECE_BYTES:
            self.clear()
        # Pieces follow each other without a gap, so do tokens.
        return ids, np.cumsum(self.lengths[ids]) + bounds[0], size


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base 64 and a number in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, blob.splitlines()))}


@lru_cache(maxsize=2)
def _loaded(blob: bytes) -> tuple[Merger, np.ndarray, np.ndarray]:
    """The merger, and the bytes of all tokens in one buffer with their starts."""
    ranks = read_ranks(blob)
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing}")
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    return Merger(ranks), np.frombuffer(b"".join(tokens), np.uint8), starts


def encode_stretch(data: np.ndarray, cuts: np.ndarray, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and ends (each counted from its text's begin) of texts in one buffer, and the place of each text's first token (one more than texts)."""
    merger = _loaded(blob)[0]
    if len(cuts) == 2 and len(data) > CHUNK_BYTES:
        ids, ends = [], []
        for at, bounds in windows(data):
            some, stops, _ = merger.encode(data[at:], bounds)
            ids.append(some)
            ends.append((stops + at).astype(np.uint32))
        ids, ends = np.concatenate(ids), np.concatenate(ends)
        return ids, ends, np.array([0, len(ids)])
    bounds = np.append(piece_starts(data, cuts), len(data))
    ids, ends, size = merger.encode(data, bounds)
    done = np.concatenate([[0], np.cumsum(size)])
    first = done[np.searchsorted(bounds[:-1], cuts)]
    return ids, (ends - np.repeat(cuts[:-1], np.diff(first))).astype(np.uint32), first


def _binary(values: np.ndarray, places: np.ndarray) -> pa.Array:
    """Slices of an array as binary values."""
    size = values.dtype.itemsize
    if len(values) * size >= 1 << 31:
        raise ValueError("a text has ids of 2 GB or more")
    offsets = np.ascontiguousarray(places * size, np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def encode_documents(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids, ends.

    ids and ends are binary, little-endian unsigned numbers of 32 bits: the tokens, and where each ends in
    the UTF-8 bytes of the text. Null counts as empty, an empty text has no tokens. Rows with the
    same id stay apart; other columns are not read; an empty table gives an empty frame. Texts of
    any length are cut into stretches of about a MB at ends of pieces. A single piece (a run of letters
    without a break) is merged whole, which takes about 75 bytes for each of its bytes. The rank
    file is read on the driver (under a MB) and goes to the tasks with the function.
    """
    with open(ranks_path, "rb") as file:
        blob = file.read()
    kind = docs.schema[doc_id].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            for first, last in chunks(offsets, CHUNK_BYTES):
                cuts = offsets[first : last + 1]
                ids, ends, places = encode_stretch(data[cuts[0] : cuts[-1]], cuts - cuts[0], blob)
                counts = pa.array(np.diff(places), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), counts, _binary(ids, places), _binary(ends, places)], ["doc_id", "n_tokens", "ids", "ends"])

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, ends binary")


def decode_stretch(ids: np.ndarray, ends: np.ndarray, first: np.ndarray, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts and where each begins; ids and ends as encode_stretch gives them, first: each text's first token (one more than texts)."""
    _, flat, starts = _loaded(blob)
    sizes = starts[ids.astype(np.int64) + 1] - starts[ids]
    lengths = np.zeros(len(first) - 1, np.int64)
    some = np.diff(first) > 0
    lengths[some] = ends[first[1:][some] - 1]
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    stops = ends.astype(np.int64) + np.repeat(cuts[:-1], np.diff(first))
    if len(stops) and ((np.diff(stops, prepend=0) != sizes).any() or stops[-1] != cuts[-1]):
        raise ValueError("ends do not fit the tokens")
    at = np.repeat(starts[ids] - stops + sizes, sizes) + np.arange(cuts[-1])
    return flat[at], cuts


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids, ends and others) with decoded, the bytes of all tokens. Ends that do not fit the tokens are an error."""
    with open(ranks_path, "rb") as file:
        blob = file.read()
    names = [c for c in encoded.columns if c not in ("ids", "ends")]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cuts = byte_view(batch.column(len(names)))
            ends, _ = byte_view(batch.column(len(names) + 1))
            for first, last in chunks(cuts, CHUNK_BYTES):
                a, b = cuts[first], cuts[last]
                data, places = decode_stretch(ids[a:b].view("<u4"), ends[a:b].view("<u4"), (cuts[first : last + 1] - a) // 4, blob)
                kept = [batch.column(i).slice(first, last - first) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, _binary(data, places)], [*names, "decoded"])

    return encoded.select(*names, "ids", "ends").mapInArrow(run, f"{schema}, decoded binary")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs."""
    encoded = encode_documents(docs, ranks_path).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode_documents(encoded, ranks_path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
