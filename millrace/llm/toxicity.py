"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum of w over the terms + sum over pairs of terms of <v, v'>)

The terms of a text are its distinct lower-case words and their first four, five and six letters,
hashed to 32 bits; the model keeps the hashes whose counts differ clearly between the classes, and
a term's value is its log odds. The pair weights come from factors of each term, so that an insult
together with the mention of a group can weigh more (or less) than the two alone.

Training reads a bounded sample of labelled rows, at most ROWS_PER_CLASS of either class, chosen by
the hash of doc_id among rows whose crc32(doc_id as text) mod 5 is not 0. Everything else reads all
documents whole. Label, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.polyhash import byte_view, chunks
from millrace.llm.scratch import lean

#: Rows of either class that training reads at most.
ROWS_PER_CLASS = 2500
#: Bytes of text whose words are held at once.
PART_BYTES = 1 << 20
BUCKETS = 1 << 32
#: A term is kept if it stands in so many sampled texts and its counts are so many deviations apart.
LEAST_TEXTS, LEAST_Z = 3, 2.5
FACTORS = 4
PREFIXES = (4, 5, 6)
EPOCHS = 15
BATCH = 32
RATE = 0.15
L2 = 1e-5
SEED = 7


class Machine(NamedTuple):
    """bias; then for the kept terms: hashes in order, values, weights, factors (terms x FACTORS)."""

    bias: float
    hashes: np.ndarray
    values: np.ndarray
    weights: np.ndarray
    factors: np.ndarray


def _hashes(words: pa.Array) -> np.ndarray:
    """The hash of each of the distinct strings."""
    return np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.int64, len(words))


def _word_terms(words: pa.Array) -> np.ndarray:
    """For each distinct word the hashes of its terms, -1 where it has none."""
    named = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    columns = [np.where(named > 0, _hashes(words), -1)]
    for n in PREFIXES:
        start = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), pa.scalar(f"~{n}", pa.large_string()), pa.scalar("", pa.large_string())).dictionary_encode()
        of = _hashes(start.dictionary)[start.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        columns.append(np.where(named >= n, of, -1))
    return np.stack(columns, axis=1)


def terms(texts: pa.Array, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text, and where each text's begin (one more than texts). Null counts as empty.

    Terms are hashes; with kept (hashes in order) only those, as places in kept.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    lists = pc.split_pattern_regex(texts, r"[^\pL\pM\pN]+")
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    table, codes = _word_terms(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    if kept is not None:
        at = np.minimum(np.searchsorted(kept, table), max(0, len(kept) - 1))
        table = np.where(kept[at] == table, at, -1) if len(kept) else np.full_like(table, -1)
        of_use = (table >= 0).any(axis=1)[codes]
        doc, codes = doc[of_use], codes[of_use]
    width = max(1, len(table))
    doc, codes = np.divmod(np.unique(doc * width + codes), width)
    ids = table[codes]
    doc, ids = np.divmod(np.unique((doc[:, None] * BUCKETS + ids)[ids >= 0]), BUCKETS)
    return ids, np.searchsorted(doc, np.arange(len(texts) + 1))


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in stretches of about PART_BYTES, so that a batch of long texts needs no more memory than a short one."""
    _, offsets = byte_view(texts)
    for first, last in chunks(offsets, PART_BYTES):
        yield texts.slice(first, last - first)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows between starts, also of empty ranges."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def _forward(bias: float, x: np.ndarray, w: np.ndarray, v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The raw scores of the texts and the sums of their factors."""
    v = v * x[:, None]
    s = _sums(np.concatenate([(w * x)[:, None], v, v * v], axis=1), starts)
    k = v.shape[1]
    return bias + s[:, 0] + 0.5 * (s[:, 1 : k + 1] ** 2 - s[:, k + 1 :]).sum(axis=1), s[:, 1 : k + 1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _chosen(ids: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms to keep, in order, and their values: log odds, smoothed."""
    of = np.repeat(labels, np.diff(starts))
    hashes, back = np.unique(ids, return_inverse=True)
    both, bad = np.bincount(back, minlength=len(hashes)), np.bincount(back, of, minlength=len(hashes))
    n, n_bad = len(labels), labels.sum()
    share = n_bad / n
    z = (bad - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 1e-9))
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((both - bad + 0.5) / (n - n_bad + 1))
    good = np.flatnonzero((both >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z))
    return hashes[good], np.clip(odds[good], -5, 5)


def train(ids: np.ndarray, starts: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """AdaGrad on the log loss in small batches; the same input gives the same machine.

    Without rows the score of every text is 0; with one class only it is that class's.
    """
    none = np.zeros(0)
    if not len(labels) or labels.min() == labels.max():
        return Machine(35.0 if len(labels) and labels[0] else -35.0, none.astype(np.int64), none, none, np.zeros((0, FACTORS)))
    rng = np.random.default_rng(SEED)
    hashes, values = _chosen(ids, starts, labels)
    # Each text's kept terms, as places in hashes.
    at = np.minimum(np.searchsorted(hashes, ids), max(0, len(hashes) - 1))
    use = hashes[at] == ids if len(hashes) else np.zeros(len(ids), bool)
    starts = np.concatenate([[0], np.cumsum(use)])[starts]
    ids = at[use]
    both = np.concatenate([np.full((len(hashes), 1), 0.1), rng.normal(0, 0.01, (len(hashes), FACTORS))], axis=1)
    # The classes weigh the same in the loss, within reason.
    balance = float(np.clip((1 - labels).sum() / labels.sum(), 1, 10))
    seen, bias, seen_bias = np.full(both.shape, 0.1), 0.0, 0.1
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for rows in np.array_split(order, max(1, len(order) // BATCH)):
            own = np.concatenate([ids[starts[r] : starts[r + 1]] for r in rows])
            cuts = np.concatenate([[0], np.cumsum([starts[r + 1] - starts[r] for r in rows])])
            of = np.repeat(np.arange(len(rows)), np.diff(cuts))
            x, v = values[own], both[own, 1:]
            raw, sums = _forward(bias, x, both[own, 0], v, cuts)
            error = (sigmoid(raw) - labels[rows]) * np.where(labels[rows] > 0, balance, 1.0) / len(rows)
            which, back = np.unique(own, return_inverse=True)
            slope = (error[of] * x)[:, None] * np.concatenate([np.ones((len(own), 1)), sums[of] - v * x[:, None]], axis=1)
            slope = np.stack([np.bincount(back, slope[:, j], len(which)) for j in range(FACTORS + 1)], axis=1) + L2 * both[which]
            seen[which] += slope**2
            both[which] -= RATE * slope / np.sqrt(seen[which])
            seen_bias += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(seen_bias)
    return Machine(float(bias), hashes, values, both[:, 0], both[:, 1:])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5. A null id counts as the empty text: held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_class: int = ROWS_PER_CLASS) -> Machine:
    """Fit on the labelled rows outside the held-out fold (toxic null: not labelled; repeated labels: the largest).

    Of rows of docs that share an id one is read, that with the largest hash of its text.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [usable.where(is_toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for is_toxic in (F.col("toxic") > 0, F.col("toxic") <= 0)]
    chosen = some[0].unionByName(some[1]).select(F.col("doc_id").alias("_mr_id"), F.col("toxic").alias("_mr_toxic"))
    # Broadcast: no more than 2 * rows_per_class rows of two numbers.
    texts = docs.select(F.col(doc_id).alias("_mr_id"), F.col(text).alias("_mr_text")).join(F.broadcast(chosen), "_mr_id")
    texts = texts.groupBy("_mr_id", "_mr_toxic").agg(F.max_by("_mr_text", F.struct(F.xxhash64("_mr_text"), "_mr_text")).alias("_mr_text"))

    @lean
    def buckets(batches):
        for batch in batches:
            start = 0
            for part in _parts(batch.column(1)):
                ids, starts = terms(part)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array((ids - (BUCKETS >> 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), batch.column(2).slice(start, len(part)), lists], ["id", "toxic", "ids"])
                start += len(part)

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = texts.select("_mr_id", "_mr_text", F.col("_mr_toxic").cast("int")).mapInArrow(buckets, f"id {kind}, toxic int, ids array<int>").toArrow()
    rows = rows.sort_by([("id", "ascending")]).combine_chunks()
    lists = rows.column("ids").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64) + (BUCKETS >> 1) if len(lists) else np.zeros(0, np.int64)
    starts = offsets - offsets[0] if len(lists) else np.zeros(1, np.int64)
    return train(values, starts, (rows.column("toxic").to_numpy() > 0).astype(float))


def score(docs: DataFrame, machine: Machine, text: str = "text") -> Column:
    """A column of scores from 0 to 1 for the text column of docs; null and empty texts get the bias."""
    # A machine's terms stand in LEAST_TEXTS or more of the bounded sample of training rows.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(machine))

    @F.arrow_udf("double")
    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = Machine(*shared.value)
        for texts in batches:
            out = []
            for part in _parts(texts):
                ids, starts = terms(part, machine.hashes)
                raw, _ = _forward(machine.bias, machine.values[ids], machine.weights[ids], machine.factors[ids], starts)
                out.append(sigmoid(raw))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return run(F.col(text))


def decisions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Null and empty texts get the machine's bias; a null id is held out; rows that share an id are each
    scored. Without labelled rows all scores are about 0, with labels of one class that class's. Other
    columns, whatever their names, are not read. An empty table gives an empty frame.
    """
    machine = fit(docs, labels)
    scored = docs.select("doc_id", score(docs, machine).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with the columns of docs."""
    machine = fit(docs, labels)
    return docs.where(score(docs, machine) < 0.5)
