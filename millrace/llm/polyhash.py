"""Prefix polynomial hashes over byte buffers, in arrays.

h[i] = sum over j < i of table[byte j] * BASE**j, modulo 2**64. The hash of any stretch follows from
two of them, because BASE is odd and so has an inverse. Modulo a power of two some texts of a thousand
bytes and more share a hash whatever the base (a Thue-Morse word and its complement), so Poly is for
stretches of LONG_STRETCH bytes at most, or where bytes are compared after. Residues has several
residues modulo the prime 2**31 - 1, which no text defeats for all bases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, for bounded arrays (one longer text is handled alone).
CHUNK_BYTES = 1 << 18
#: Powers that a polynomial keeps after a task.
KEPT_POWERS = 1 << 20

#: Stretches of so many bytes or more need another hash than Poly.
LONG_STRETCH = 256

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


class Poly:
    """One polynomial: a random table of byte values and a random odd base, both fixed by the seed."""

    known: list[Poly] = []

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 32, 1 << 62)) | 1
        self.up = self.down = np.ones(1, np.uint64)
        Poly.known.append(self)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                step = np.full(n, base, np.uint64)
                step[0] = 1
                setattr(self, name, np.multiply.accumulate(step))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """The prefix hashes, one more than bytes."""
        self.powers(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def stretch(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of the bytes from start to end, not mixed."""
        return (prefix[end] - prefix[start]) * self.down[start]


_P = np.uint64((1 << 31) - 1)
_SHIFT = np.uint64(31)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**63 modulo the prime."""
    for _ in range(2):
        x = (x & _P) + (x >> _SHIFT)
    x[x == _P] = 0
    return x


class Residues:
    """Four polynomials modulo 2**31 - 1: a random table of byte values and a random base each, fixed by the seed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.tables = rng.integers(1, int(_P), (4, 256), dtype=np.uint64)
        self.bases = [int(x) for x in rng.integers(1 << 20, int(_P) - 1, 4)]

    def _powers(self, i: int, n: int) -> np.ndarray:
        out, done = np.ones(n, np.uint64), 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = _reduced(out[:more] * np.uint64(pow(self.bases[i], done, int(_P))))
            done += more
        return out

    def deletions(self, data: np.ndarray, block: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Two hashes (of two residues each) of all UTF-8 bytes, and then of the bytes without each character in turn, block by block."""
        n, edges = len(data), [0]
        while edges[-1] < n:
            end = min(edges[-1] + block, n)
            while end < n and data[end] & 0xC0 == 0x80:
                end += 1
            edges.append(end)
        powers = [self._powers(i, max(np.diff(edges, append=0).max(), 0) + 1) for i in range(4)]
        # The residues of what stands before each block, and of the whole.
        before = np.zeros((4, len(edges)), np.uint64)
        for b, (first, last) in enumerate(zip(edges, edges[1:])):
            for i in range(4):
                own = _reduced(self.tables[i][data[first:last]] * powers[i][: last - first]).sum()
                own = _reduced(np.array([own], np.uint64)) * np.uint64(pow(self.bases[i], first, int(_P)))
                before[i, b + 1] = _reduced(before[i, b] + own)[0]
        yield self._joined(before[:, -1:], np.array([n], np.uint64))
        for b, (first, last) in enumerate(zip(edges, edges[1:])):
            own = data[first:last]
            starts = np.flatnonzero((own & 0xC0) != 0x80)
            width = np.diff(starts, append=len(own))
            keys = np.empty((4, len(starts)), np.uint64)
            for i in range(4):
                shift = np.uint64(pow(self.bases[i], first, int(_P)))
                prefix = np.zeros(len(own) + 1, np.uint64)
                np.cumsum(_reduced(self.tables[i][own] * powers[i][: len(own)]), out=prefix[1:])
                prefix = _reduced(_reduced(_reduced(prefix) * shift) + before[i, b])
                # What stands right of a gap moves to the left by its width.
                back = np.array([1, *(pow(self.bases[i], -w, int(_P)) for w in range(1, 5))], np.uint64)[width]
                rest = _reduced(_reduced(before[i, -1] + _P - prefix[starts + width]) * back)
                keys[i] = _reduced(prefix[starts] + rest)
            yield self._joined(keys, (n - width).astype(np.uint64))

    @staticmethod
    def _joined(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = mix(sizes)
        return mix((keys[0] << _SHIFT | keys[1]) ^ sizes), mix((keys[2] << _SHIFT | keys[3]) ^ sizes)


def forget_powers() -> None:
    """Let go of the powers that one very long text needed."""
    for poly in Poly.known:
        if len(poly.up) > KEPT_POWERS:
            poly.up = poly.down = np.ones(1, np.uint64)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) in one buffer, and where each begins (one more than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together hold about limit bytes."""
    start = 0
    while start < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(offsets) - 1)
        yield start, end
        start = end
