"""Near duplicates among embeddings by a forest of random-projection trees.

Vectors are compared only with those of the same label and dimension. Each of TREES trees splits its
vectors again and again by a random direction at the median of the projections, with spill: vectors
within SPILL of the split go to both sides, so that a pair above the threshold is rarely parted. A
split that would not lessen the comparisons is not made. Every leaf is compared whole, and pairs at or
above the threshold in double precision are links.

Vectors move between tasks in cells of up to FLOATS numbers, each vector once for each cell. The trees
over a cell grow in the memory of its task, so their copies are places in an array and never reach the
disk. A label that fits a cell is one cell. A larger label is cut into cells by a forest of its own,
whose trees grow in rounds: every node that is too large is given a subtree of up to DEPTH levels,
fitted on about SAMPLE of its vectors chosen by a hash. Cells that cannot be split are compared in pairs
of blocks. Cells are dealt out in waves of about one copy of the input, and the shuffle files of a wave
go when it is written: the disk holds the vectors about twice, however many there are.

A pair counts once: in the first tree that does not part it, where its midpoint ends. That needs no
list of leaves beside a vector.

Equal vectors (same label) are one class with a size and are never expanded into pairs.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components, smallest_ids
from millrace.llm.leaf_pairs import groups
from millrace.llm.polyhash import mix
from millrace.llm.scratch import lean, small, write

THRESHOLD = 0.93
TREES = 8
LEAF = 1024
#: Numbers in the vectors of a cell (100,000 vectors of 64): a task holds them about six times over.
FLOATS = 6_400_000
#: A wave has at least so many numbers (0.2 GB).
WAVE = 8 * FLOATS
SAMPLE, DEPTH, ROUNDS = 4096, 6, 16
#: Products looked at at once, and linked pairs.
STRIPE, PAIRS = 1 << 22, 1 << 20
#: Inner places of a subtree; the children of place p are 2p + 1 and 2p + 2.
INNER = 2**DEPTH - 1
#: Half the width of the spill zone at THRESHOLD, for unit vectors (a pair at the threshold is 0.37 apart;
#: its projections differ by 0.05 in 64 dimensions). At another threshold it is as many times as wide as
#: pairs are farther apart, so that a split parts them as rarely.
SPILL = 0.045
#: A node is dense if its sides would take more than this share of its comparisons.
DENSE = 0.95
#: Fewer sampled vectors than this are not split.
LEAST_SAMPLE = 64


def _unit(lists: pa.ListArray) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _directions(root: int, dims: int) -> np.ndarray:
    """The random directions of a subtree, one for each inner place: the root's number is the seed."""
    x = np.random.default_rng(root & 0x7FFFFFFFFFFFFFFF).normal(size=(INNER, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _names(root: int) -> np.ndarray:
    """The numbers of all places of the subtree at root."""
    return np.append(np.int64(root), mix(np.arange(1, 2 * INNER + 1, dtype=np.uint64) * np.uint64(2654435761) ^ np.uint64(root & (1 << 64) - 1)).astype(np.int64))


def spill_for(threshold: float) -> float:
    """Half the width of the spill zone for pairs at a threshold."""
    if not -1 < threshold <= 1:
        raise ValueError("the threshold must lie between -1 and 1")
    return SPILL * ((1 - threshold) / (1 - THRESHOLD)) ** 0.5


def _fit(root: int, x: np.ndarray, rows: float, leaf: int, spill: float = SPILL) -> np.ndarray:
    """The cuts of the subtree at root, NaN where it ends: medians of the sample x, which stands for rows vectors."""
    at = x @ _directions(root, x.shape[1]).T
    cuts = np.full(INNER, np.nan, np.float32)
    held = {0: (np.arange(len(x)), rows)}
    for place in range(INNER):
        own, n = held.pop(place, (np.zeros(0, np.int64), 0.0))
        if n <= leaf or len(own) < LEAST_SAMPLE:
            continue
        here = at[own, place]
        cut = np.float32(np.median(here))
        left, right = here <= cut + spill, here >= cut - spill
        if left.mean() ** 2 + right.mean() ** 2 > DENSE:
            continue
        cuts[place] = cut
        held[2 * place + 1], held[2 * place + 2] = (own[left], n * left.mean()), (own[right], n * right.mean())
    return cuts


def _route(root: int, x: np.ndarray, cuts: np.ndarray, spill: float = SPILL) -> tuple[np.ndarray, np.ndarray]:
    """The rows of x and the numbers of their end nodes; a row within the spill zone has several."""
    at = x @ _directions(root, x.shape[1]).T
    cuts = np.append(cuts, np.full(INNER + 1, np.nan))
    rows, places = np.arange(len(x)), np.zeros(len(x), np.int64)
    ended = []
    while len(rows):
        cut = cuts[places]
        ends = np.isnan(cut)
        ended.append((rows[ends], places[ends]))
        rows, places, cut = rows[~ends], places[~ends], cut[~ends]
        here = at[rows, places]
        left, right = here <= cut + spill, here >= cut - spill
        rows, places = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * places[left] + 1, 2 * places[right] + 2])
    rows, places = (np.concatenate(z) for z in zip(*ended, strict=True))
    return rows, _names(root)[places]


def _send(x: np.ndarray, root: int, grown: dict[int, np.ndarray], spill: float) -> list[tuple[int, np.ndarray]]:
    """The end nodes of the tree at root and the rows of x in each: subtree after subtree, by the cuts in grown."""
    ended, going = [], [(root, np.arange(len(x)))]
    while going:
        node, own = going.pop()
        if node not in grown:
            ended.append((node, own))
            continue
        inside, names = _route(node, x[own], grown[node], spill)
        order = np.argsort(names, kind="stable")
        names, inside = names[order], own[inside[order]]
        going += [(int(names[rows[0]]), inside[rows]) for rows in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names)) + 1) if len(rows)]
    return ended


def _meet(x: np.ndarray, one: np.ndarray, two: np.ndarray, root: int, grown: dict[int, np.ndarray], spill: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows of x: the end node of their midpoint, and whether a split on its way parts the two.

    A split that does not part two vectors sends both to the side of their midpoint: were one of them
    outside that side's zone, the other would lie as far on the other side. So each pair has one end node in
    a tree, and is in it or parted.
    """
    found, parted = np.full(len(one), root, np.int64), np.zeros(len(one), bool)
    going = [(root, np.arange(len(one)))]
    while going:
        node, own = going.pop()
        found[own] = node
        if node not in grown or not len(own):
            continue
        used = np.zeros(len(x), bool)
        used[one[own]] = used[two[own]] = True
        at = x[used] @ _directions(node, x.shape[1]).T
        row = np.cumsum(used) - 1
        cuts, names = np.append(grown[node], np.full(INNER + 1, np.nan)).astype(np.float32), _names(node)
        places = np.zeros(len(own), np.int64)
        live = np.arange(len(own))
        while len(live := live[~np.isnan(cuts[places[live]])]):
            cut, p, q = cuts[places[live]], at[row[one[own[live]]], places[live]], at[row[two[own[live]]], places[live]]
            left = (p + q) / 2 <= cut
            apart = np.where(left, np.maximum(p, q) > cut + spill, np.minimum(p, q) < cut - spill)
            parted[own[live[apart]]] = True
            places[live] = 2 * places[live] + np.where(left, 1, 2)
            live = live[~apart]
        whole = ~parted[own]
        own, ends = own[whole], names[places[whole]]
        order = np.argsort(ends, kind="stable")
        own, ends = own[order], ends[order]
        going += [(int(ends[rows[0]]), own[rows]) for rows in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends)) + 1) if len(rows)]
    return found, parted


def _plant(rows: DataFrame, leaf: int, spill: float = SPILL) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """From (key, vec, node) of the roots: the cuts of every subtree, and the end nodes with the number of their vectors.

    Only cuts and counts come to the driver, a few bytes for each leaf of vectors. Nothing is written: each
    round sends the vectors down again.
    """
    grown: dict[int, np.ndarray] = {}
    dense: set[int] = set()

    def fit(found: pd.DataFrame) -> pd.DataFrame:
        node = int(found["node"].iloc[0])
        x = np.stack(found["vec"].to_numpy()).astype(np.float64)
        cuts = _fit(node, x / np.linalg.norm(x, axis=1, keepdims=True), float(found["n"].iloc[0]), leaf, spill)
        return pd.DataFrame({"node": [node], "cuts": [None if np.isnan(cuts[0]) else cuts]})

    for _ in range(ROUNDS):
        sizes = {r["node"]: r["n"] for r in _sent(rows, grown, spill, None).groupBy("node").agg(F.sum("n").alias("n")).collect()}
        large = {node: n for node, n in sizes.items() if n > leaf and node not in dense}
        if not large:
            break
        cuts = {r["node"]: r["cuts"] for r in _sent(rows, grown, spill, large).groupBy("node").applyInPandas(fit, "node long, cuts array<float>").collect()}
        # Dense nodes have no split: leaves as they are.
        dense |= {node for node in large if cuts.get(node) is None}
        grown |= {node: np.array(c, np.float32) for node, c in cuts.items() if c is not None}
    return grown, sizes


def _sent(rows: DataFrame, grown: dict[int, np.ndarray], spill: float, large: dict[int, int] | None) -> DataFrame:
    """(node, n) with the vectors of each batch in each end node, or (node, n, vec) with a sample of the large ones."""
    kind = rows.schema["vec"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, own in _by(batch.column(2).to_numpy()):
                lists, key = batch.column(1).take(pa.array(own)), batch.column(0).to_numpy()[own]
                for node, inside in _send(_unit(lists), root, grown, spill):
                    if large is None:
                        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([len(inside)])], ["node", "n"])
                    elif node in large:
                        # Each vector by its own hash, so a sample needs no sort and no window over its node.
                        chance = mix(key[inside].astype(np.uint64) ^ np.uint64(node & (1 << 64) - 1)).astype(np.float64) / 2.0**64
                        inside = inside[chance < SAMPLE / large[node]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(inside), node)), pa.array(np.full(len(inside), large[node])), lists.take(pa.array(inside))], ["node", "n", "vec"])

    return rows.select("key", "vec", "node").mapInArrow(run, "node long, n long" + (f", vec {kind}" if large is not None else ""))


def _by(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value and its rows."""
    order = np.argsort(values, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
        if len(own):
            yield int(values[own[0]]), own


def _grow(rows: DataFrame, leaf: int, spill: float = SPILL) -> DataFrame:
    """From (key, vec, node) of the roots to (key, node, n) of the leaves: n members."""
    grown, sizes = _plant(rows, leaf, spill)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, own in _by(batch.column(2).to_numpy()):
                for node, inside in _send(_unit(batch.column(1).take(pa.array(own))), root, grown, spill):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[inside])), pa.array(np.full(len(inside), node)), pa.array(np.full(len(inside), sizes[node]))], ["key", "node", "n"])

    return rows.select("key", "vec", "node").mapInArrow(run, "key long, node long, n long")


def _linked(x: np.ndarray, single: np.ndarray, own: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs among the rows own of x at or above the threshold in double precision.

    Products in single precision, wrong by less than band, decide all pairs but those next to the threshold.
    """
    band = (x.shape[1] + 8) * 2.0**-23
    held, stripe = single[own], max(1, min(256, STRIPE // len(own)))
    for start in range(0, len(own), stripe):
        at = held[start : start + stripe] @ held[start:].T
        row, column = np.divmod(np.flatnonzero(at >= np.float32(threshold - 2 * band)), at.shape[1])
        later = column > row
        row, column = row[later], column[later]
        near = at[row, column] < threshold + 2 * band
        one, two = own[start + row], own[start + column]
        keep = ~near
        keep[near] = np.einsum("ij,ij->i", x[one[near]], x[two[near]]) >= threshold
        if keep.any():
            yield one[keep], two[keep]


def _search(x: np.ndarray, sizes: np.ndarray, block: np.ndarray | None, above: list[tuple[int, dict, int | None]], trees: int, leaf: int, spill: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the vectors of one cell: for each, the rows linked with it, and the first vector it is connected with here.

    A pair counts in the first tree that does not part it, at the end node of its midpoint. above has the trees
    that made the cell: of earlier ones, which must have parted the pair, and of its own, with the cell that
    must be the pair's. block: only pairs of different blocks.
    """
    counts, first = np.zeros(len(x)), np.arange(len(x))
    single = x.astype(np.float32)
    before: list[tuple[int, dict]] = []
    held: list[tuple[np.ndarray, np.ndarray, int]] = []

    def settle() -> None:
        one, two = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        ends = np.repeat([h[2] for h in held], [len(h[0]) for h in held])
        held.clear()
        if block is not None:
            other = block[one] != block[two]
            one, two, ends = one[other], two[other], ends[other]
        for root, cuts, where in [(tree, grown, ends), *((*b, None) for b in before), *above]:
            if not cuts or not len(one):  # the whole of it is one leaf
                continue
            at, parted = _meet(x, one, two, root, cuts, spill)
            fresh = parted if where is None else ~parted & (at == where)
            one, two = one[fresh], two[fresh]
        if not len(one):
            return
        counts[:] += np.bincount(one, sizes[two], len(x)) + np.bincount(two, sizes[one], len(x))
        while len(one):
            a, b = first[one], first[two]
            apart = a != b
            one, two, a, b = one[apart], two[apart], a[apart], b[apart]
            np.minimum.at(first, np.maximum(a, b), np.minimum(a, b))
            while (first[first] != first).any():
                first[:] = first[first]

    for tree in range(1, trees + 1):
        grown: dict[int, np.ndarray] = {}
        going, ended = [(tree, np.arange(len(x)))], []
        while going:
            node, own = going.pop()
            cuts = _fit(node, x[own[:: -(-len(own) // SAMPLE)]], float(len(own)), leaf, spill) if len(own) > leaf else [np.nan]
            if np.isnan(cuts[0]):
                ended.append((node, own))
                continue
            grown[node] = cuts
            inside, names = _route(node, x[own], cuts, spill)
            going += [(name, own[inside[rows]]) for name, rows in _by(names)]
        waiting = 0
        for node, own in ended:
            for one, two in _linked(x, single, own, threshold):
                held.append((one, two, node))
                waiting += len(one)
                if waiting >= PAIRS:
                    settle()
                    waiting = 0
        if held:
            settle()
        before.append((tree, grown))
        if not grown:  # compared whole
            break
    return np.rint(counts).astype(np.int64), first


def _compare(rows: DataFrame, above: dict[int, list[tuple[int, dict, int | None]]], trees: int, leaf: int, spill: float, threshold: float) -> DataFrame:
    """rows: cell, one, two, root, block, key, size, vec, kind; sorted by (cell, one, two) within partitions."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for together in groups(batches, 3):
            cell, one, two, root = (together.column(i)[0].as_py() for i in range(4))
            kinds = together.column(8).dictionary_encode()
            for _, own in _by(kinds.indices.to_numpy()):  # another label whose cell has the same number
                if len(own) < 2:
                    continue
                held = together if len(own) == len(together) else together.take(pa.array(own))
                block, key, size = (held.column(i).to_numpy() for i in range(4, 7))
                trail = [(r, cuts, cell if r == root else None) for r, cuts in above.get(root, [])]
                counts, first = _search(_unit(held.column(7)), size, block if one != two else None, trail, trees, leaf, spill, threshold)
                touched = counts > 0
                if touched.any():
                    yield pa.RecordBatch.from_arrays([pa.array(key[touched]), pa.array(counts[touched]), pa.array(key[first[touched]])], ["key", "links", "root"])

    return rows.mapInArrow(run, "key long, links long, root long")


def _deal(classes: DataFrame, forest: dict[str, list[int]], grown: dict[int, np.ndarray], blocks: dict[int, int], spill: float, trees: range, wave: int, waves: int) -> DataFrame:
    """Of the cells of some trees, those of a wave: each class in each of its cells, as _compare reads them."""
    kind = classes.schema["vec"].dataType.simpleString()
    names = ["cell", "one", "two", "root", "block", "key", "size", "vec", "kind"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(3).dictionary_encode()
            for code, own in _by(kinds.indices.to_numpy()):
                name = kinds.dictionary[code].as_py()
                placed = []
                if name not in forest:
                    if 0 in trees and zlib.crc32(name.encode()) % waves == wave:
                        placed.append((_number(0, name), _number(0, name), own))
                else:
                    x = _unit(batch.column(2).take(pa.array(own)))
                    for root in forest[name][trees.start : trees.stop]:
                        placed += [(root, cell, own[inside]) for cell, inside in _send(x, root, grown, spill) if cell % waves == wave]
                for root, cell, rows in placed:
                    key, parts = batch.column(0).to_numpy()[rows], blocks.get(cell, 1)
                    block = (mix(key.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
                    take = pa.array(rows)
                    same = [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take)]
                    for other in range(parts):
                        one, two = np.minimum(block, np.int32(other)), np.maximum(block, np.int32(other))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), cell)), pa.array(one), pa.array(two), pa.array(np.full(len(rows), root)), pa.array(block), *same], names)

    return classes.select("key", "size", "vec", "kind").mapInArrow(run, f"cell long, one int, two int, root long, block int, key long, size long, vec {kind}, kind string")


def _number(tree: int, kind: str) -> int:
    """The root of a tree over the vectors of a kind."""
    return int.from_bytes(hashlib.sha256(f"{tree} {kind}".encode()).digest()[:8], "big", signed=True)


def _found(classes: DataFrame, threshold: float, trees: int, leaf: int, block: int | None) -> DataFrame:
    """(key, links, root): what each cell found, for the classes with links there."""
    spark, spill = classes.sparkSession, spill_for(threshold)
    room = F.lit(block) if block else F.greatest(F.lit(leaf), F.floor(F.lit(FLOATS) / F.col("dims")))
    kinds = write(classes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("vec")).alias("dims")).withColumn("room", room.cast("long")), "kinds").df
    labels, total = kinds.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") * F.col("dims")), F.lit(0))).first()
    forest: dict[str, list[int]] = {}
    grown: dict[int, np.ndarray] = {}
    sizes: dict[int, int] = {}
    blocks: dict[int, int] = {}
    whole = total
    for (room, wide), of in _rooms(kinds):
        whole -= wide * sum(of.values())
        planted = {kind: [_number(tree, kind) for tree in range(1, trees + 1)] for kind in of}
        roots = spark.createDataFrame([(kind, root) for kind, own in planted.items() for root in own], "kind string, node long")
        more, ends = _plant(classes.join(F.broadcast(roots), "kind").select("key", "vec", "node"), room, spill)
        grown |= more
        blocks |= {cell: math.ceil(2 * n / room) for cell, n in ends.items() if n > 1.25 * room}
        sizes |= {cell: n * wide for cell, n in ends.items()}
        # A tree without a split compares the whole label: then no other is needed.
        forest |= {kind: next(([root] for root in own if root not in more), own) for kind, own in planted.items()}
    trail = {root: [(r, grown) for r in own[: i + 1]] for own in forest.values() for i, root in enumerate(own)}
    above = {root: of for root, of in trail.items() if root in grown}
    ends = _ends_of(forest, grown)
    ended = [[cell for own in forest.values() if tree < len(own) for cell in ends[own[tree]]] for tree in range(max([1, *map(len, forest.values())]))]
    copies = [sum(sizes[cell] * blocks.get(cell, 1) for cell in cells) + whole * (tree == 0) for tree, cells in enumerate(ended)]
    cells = [sum(blocks.get(cell, 1) ** 2 for cell in cells) + labels * (tree == 0) for tree, cells in enumerate(ended)]
    out, start, most = None, 0, max(total, WAVE)
    while start < len(copies):
        stop = start + 1
        while stop < len(copies) and sum(copies[start : stop + 1]) <= most:
            stop += 1
        waves = max(1, math.ceil(sum(copies[start:stop]) / most))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, 4 * sum(cells[start:stop]) // waves if sum(copies[start:stop]) > FLOATS else 0))
        for wave in range(waves):
            dealt = _deal(classes, forest, grown, blocks, spill, range(start, stop), wave, waves).repartition(parts, "cell", "one", "two").sortWithinPartitions("cell", "one", "two")
            found = write(_compare(dealt, above, trees, leaf, spill, threshold), "found", tidy=True).df
            out = found if out is None else out.unionByName(found)
        start = stop
    return out


def _rooms(kinds: DataFrame) -> Iterator[tuple[tuple[int, int], dict[str, int]]]:
    """The labels that are larger than a cell and their vectors, by the vectors that a cell of theirs takes and their length."""
    by: dict[tuple[int, int], dict[str, int]] = {}
    for r in kinds.where("n > room").collect():
        by.setdefault((r["room"], r["dims"]), {})[r["kind"]] = r["n"]
    yield from by.items()


def _ends_of(forest: dict[str, list[int]], grown: dict[int, np.ndarray]) -> dict[int, list[int]]:
    """The end nodes of each tree."""
    out: dict[int, list[int]] = {}
    for root in (root for own in forest.values() for root in own):
        going, out[root] = [root], []
        while going:
            node = going.pop()
            if node not in grown:
                out[root].append(node)
                continue
            cuts, names = np.append(grown[node], np.full(INNER + 1, np.nan)), _names(node)
            places = [0]
            while places:
                place = places.pop()
                if np.isnan(cuts[place]):
                    going.append(int(names[place]))
                else:
                    places += [2 * place + 1, 2 * place + 2]
    return out


def near_duplicates(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, block: int | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of the table.

    vec_id is a whole number. n_links: other rows linked directly; component_id: the smallest id
    reachable. Rows with a null id, a null label, or a vector that is null, empty, zero or holds null or
    non-finite components link with nothing: 0 links, their own component, kept. Rows that share an id
    are rows of their own, each with its own vector and label; kept says that the row's id is its
    component's. Equal vectors (of one label, by 128 bits of hash) are linked and never compared. Other columns, whatever their names, are
    not read. An empty table gives an empty frame. block: vectors in a cell, by default as many as FLOATS allows.
    """
    # Single precision stays as it is while stored and sent; all arithmetic is in double precision.
    single = table.schema[embedding].dataType.simpleString() == "array<float>"
    vec = F.col(embedding).cast("array<float>" if single else "array<double>")
    fine = F.col(vec_id).isNotNull() & F.coalesce(F.size(vec) > 0, F.lit(False))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine &= F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    # Length and label themselves, so that no two labels are taken for one.
    kind = F.to_json(F.struct(F.size(vec).alias("n"), F.col(label).alias("label"))) if label else F.size(vec).cast("string")
    if label:
        fine &= F.col(label).isNotNull()
    plain = table.select(F.col(vec_id).cast("long").alias("id"), vec.alias("vec"), kind.alias("kind"), fine.alias("fine"))
    mark = [F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b")]
    marked = plain.select("id", "vec", "kind", "fine", *mark)
    found = marked.where("fine").groupBy("kind", "a", "b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.any_value("vec").alias("vec"))
    # The number of a class is its own: two vectors of one id are two classes. Written once, so it stays.
    classes = write(found.withColumn("key", F.monotonically_increasing_id()), "classes", tidy=True).df
    compared = _found(classes, threshold, trees, leaf, block)
    links = compared.groupBy("key").agg(F.sum("links").alias("links"))
    component = smallest_ids(components(compared.select(F.col("key").alias("a"), F.col("root").alias("b"))), classes)
    decided = write(classes.select("kind", "a", "b", "key", "rep", "size").join(links, "key", "left").join(component, "key", "left"), "decided", tidy=True)
    rows = marked.select("id", "kind", "a", "b", "fine").join(small(decided), ["kind", "a", "b"], "left")
    found = F.when(F.col("fine"), F.coalesce("component", "rep")).otherwise(F.col("id"))
    return rows.select(
        F.col("id").alias("vec_id"),
        F.when(F.col("fine"), F.coalesce("links", F.lit(0)) + F.col("size") - 1).otherwise(0).cast("long").alias("n_links"),
        found.alias("component_id"),
        found.eqNullSafe(F.col("id")).alias("kept"),
    )
