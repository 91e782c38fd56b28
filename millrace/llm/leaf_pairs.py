"""What one leaf of a search says: each linked pair counted once over all leaves, and who is connected.

Every member knows the leaves it is in. A pair that is linked counts in the smallest leaf that both are
in, so counts over all leaves add up without a table of pairs. All is done on m x m matrices of a leaf
(or of a pair of its blocks), so the work does not depend on how many pairs are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of a matrix multiplied at once.
STRIPE = 256


def tally(leaf: int, leaves: pa.ListArray, sizes: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member: rows linked with it through pairs that count here, and the first member it is connected with here.

    leaves: for each member the leaves it is in; sizes: rows for which it stands; linked: a symmetric
    matrix without diagonal.
    """
    m = len(sizes)
    root = np.arange(m)
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], m).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    values, member = leaves.flatten().to_numpy(), np.repeat(np.arange(m), leaves.value_lengths().to_numpy())
    earlier = values < leaf
    values, member = values[earlier], member[earlier]
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    place = (np.cumsum(times > 1) - 1)[column]
    inside = np.zeros((m, int((times > 1).sum())), np.float32)
    inside[member[shared], place[shared]] = 1
    counts = np.zeros(m, np.int64)
    weights = sizes.astype(np.float64)
    for start in range(0, m, STRIPE):
        own = slice(start, start + STRIPE)
        fresh = linked[own] & (inside[own] @ inside.T == 0)
        counts[own] = np.rint(fresh.astype(np.float64) @ weights).astype(np.int64)
    return counts, root


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """From batches sorted by their first columns, the rows of each key together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(len(batch), bool)
        new[0] = not held or any(held[-1].column(i)[-1].as_py() != c[0] for i, c in enumerate(columns))
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new).tolist()
        if starts[:1] != [0]:
            starts.insert(0, 0)
        elif held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        for first, last in zip(starts, [*starts[1:], len(batch)], strict=True):
            if first and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def results(key: np.ndarray, counts: np.ndarray, root: np.ndarray, linked: np.ndarray) -> pa.RecordBatch:
    """(key, links, root) of the members with links."""
    touched = linked.any(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(key[touched]), pa.array(counts[touched]), pa.array(key[root[touched]])], ["key", "links", "root"])
