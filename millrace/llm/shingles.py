"""Word shingles of texts as 64-bit hashes, in arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from millrace.llm.polyhash import LONG_STRETCH, Poly, byte_view, chunks, mix

#: Words of a shingle.
WORDS = 5

_POLY = Poly(11)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WEIGHTS = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int = WORDS):
    """For each text in turn its distinct shingles, sorted.

    Words are what ASCII white space separates. A text of fewer words has one shingle of them all;
    a null, empty or blank text has none.
    """
    data, offsets = byte_view(texts)
    for first, last in chunks(offsets):
        own = data[offsets[first] : offsets[last]]
        cuts = offsets[first : last + 1] - offsets[first]
        space = _SPACE[own]
        begins, ends = ~space, ~space
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        inner = cuts[(cuts > 0) & (cuts < len(own))]  # texts end here: no word reaches across
        begins[inner] = ~space[inner]
        ends[inner - 1] = ~space[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        word = mix(_POLY.stretch(_POLY.prefix(own), start, end))
        for i in np.flatnonzero(end - start >= LONG_STRETCH).tolist():
            word[i] = int.from_bytes(hashlib.blake2b(own[start[i] : end[i]].tobytes(), digest_size=8).digest())
        text = np.searchsorted(cuts, start, side="right") - 1
        total = np.zeros(len(word), np.uint64)
        for j in range(min(words, len(word))):
            same = text[j:] == text[: len(text) - j]
            total[: len(word) - j] += np.where(same, word[j:] * _WEIGHTS[j], np.uint64(0))
        whole = np.zeros(len(word), bool)
        n = len(word) - words + 1
        if n > 0:
            whole[:n] = text[words - 1 :] == text[:n]
        whole[np.flatnonzero(np.diff(text, prepend=-1))] = True
        shingle, text = mix(total[whole]), text[whole]
        at = np.searchsorted(text, np.arange(last - first + 1))
        for i in range(last - first):
            yield np.unique(shingle[at[i] : at[i + 1]])
