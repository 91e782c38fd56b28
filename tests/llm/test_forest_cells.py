"""The forest's cells: every pair once, and no more on disk than a few times the vectors."""

from pathlib import Path

import numpy as np

from millrace.llm import rp_forest, scratch


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_forest_disk_and_counts(spark, tmp_path, monkeypatch):
    """What is written follows the vectors, not their copies in trees; pairs of several trees and cells count once."""
    rng = np.random.default_rng(11)
    base = _unit(rng.normal(size=(2500, 64)))
    near = [_unit(base[:1000] + s * _unit(rng.normal(size=(1000, 64)))) for s in (0.1, 0.3, 0.39)]
    group = _unit(base[:1] + 0.1 * _unit(rng.normal(size=(300, 64))))
    x = np.concatenate([base, *near, group]).astype(np.float32)
    exact = _unit(x.astype(np.float64))
    linked = exact @ exact.T >= rp_forest.THRESHOLD
    right = linked.sum(axis=1) - 1
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").repartition(4)
    tidy = spark.conf.get(scratch.TIDY, None)
    for block in ({}, {"block": 1500}):
        folder = tmp_path / str(len(block))
        monkeypatch.setattr(scratch, "shared_folder", lambda _, folder=folder: f"file://{folder}")
        got = {r.vec_id: r.n_links for r in rp_forest.near_duplicates(frame, **block).collect()}
        assert [got[i] for i in range(len(x))] == right.tolist()
        assert sum(p.stat().st_size for p in Path(folder).rglob("*.parquet")) < 2.5 * x.nbytes
    assert spark.conf.get(scratch.TIDY, None) == tidy


def test_a_pair_meets_once():
    """Two vectors that share leaves of a tree, and no split on the way of their midpoint parts, meet in one leaf that both are in."""
    rng = np.random.default_rng(12)
    x = _unit(rng.normal(size=(3000, 64)))
    x[1500:] = _unit(x[:1500] + 0.35 * _unit(rng.normal(size=(1500, 64))))
    grown, going = {}, [(7, np.arange(3000))]
    while going:
        node, own = going.pop()
        cuts = rp_forest._fit(node, x[own], float(len(own)), 100)
        if not np.isnan(cuts[0]):
            grown[node] = cuts
            inside, names = rp_forest._route(node, x[own], cuts)
            going += [(int(n), own[inside[names == n]]) for n in np.unique(names)]
    leaves = dict(rp_forest._send(x, 7, grown, rp_forest.SPILL))
    one, two = np.arange(1500), np.arange(1500, 3000)
    at, parted = rp_forest._meet(x, one, two, 7, grown, rp_forest.SPILL)
    assert len(grown) >= 1 and len(leaves) > 20 and 0 < parted.mean() < 0.1
    for i in np.flatnonzero(~parted):
        assert {one[i], two[i]} <= set(leaves[int(at[i])].tolist())
