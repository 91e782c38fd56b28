"""Byte tokens, conversations, loss masks, windows over the packed stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from millrace.operators.selection import running_offset
from millrace.sources.readers import first_reason

# Ids above the bytes.
BOS, EOS, USER, ASSISTANT, TOOL, THINK, FINAL, PAD = range(256, 264)
VOCABULARY = 264

#: A record as binary.
PACKED = StructType([StructField("tokens", BinaryType()), StructField("mask", BinaryType())])


@F.arrow_udf(ArrayType(IntegerType()))
def byte_ids(texts: pa.Array) -> pa.Array:
    """The UTF-8 bytes of texts as numbers; null stays null."""
    return pa.array([None if t is None else np.frombuffer(t.encode(), np.uint8).astype(np.int32) for t in texts.to_pylist()], pa.list_(pa.int32()))


@F.arrow_udf(StringType())
def text_of(tokens: pa.Array) -> pa.Array:
    """The text of byte tokens; null if there are special tokens or no valid UTF-8."""
    out = []
    for row in tokens.to_pylist():
        try:
            out.append(None if row is None else bytes(row).decode())
        except (ValueError, UnicodeDecodeError):
            out.append(None)
    return pa.array(out, pa.string())


@F.arrow_udf(PACKED)
def packed_base(texts: pa.Array) -> pa.Array:
    """The base record of each text (null: empty) as binary: little-endian tokens of 16 bits, and a byte for each that says whether it is a target."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(texts)
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    cuts = starts - starts[0] + 2 * np.arange(n + 1)
    tokens, mask = np.empty(cuts[-1], "<u2"), np.ones(cuts[-1], np.uint8)
    inner = np.ones(cuts[-1], bool)
    inner[cuts[:-1]] = inner[cuts[1:] - 1] = False
    tokens[cuts[:-1]], tokens[cuts[1:] - 1], mask[cuts[:-1]] = BOS, EOS, 0
    tokens[inner] = body
    fields = [slices(tokens, cuts), slices(mask, cuts)]
    return pa.StructArray.from_arrays(fields, ["tokens", "mask"])


def slices(numbers: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values."""
    offsets = np.ascontiguousarray(cuts * numbers.dtype.itemsize, np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])
    return whole.cast(pa.binary())


def _ids(*ids: int) -> Column:
    return F.array(*map(F.lit, ids))


def base_record(text: Column) -> tuple[Column, Column]:
    """Tokens and mask of a base text: all but the first token are targets."""
    body = byte_ids(text)
    return F.concat(_ids(BOS), body, _ids(EOS)), F.concat(_ids(0), F.array_repeat(F.lit(1), F.size(body) + 1))


def response_record(prompt: Column, final: Column, reasoning: Column) -> tuple[Column, Column]:
    """Tokens and mask of an answer; with reasoning (not null) the thinking comes first. The cue of the mode is no target."""
    p, f, r = byte_ids(prompt), byte_ids(final), byte_ids(reasoning)
    ones = lambda n: F.array_repeat(F.lit(1), n)
    zeros = F.array_repeat(F.lit(0), F.size(p) + 4)
    think = F.concat(_ids(THINK), r, _ids(FINAL))
    tokens = F.concat(_ids(BOS, USER), p, _ids(ASSISTANT), F.when(reasoning.isNull(), _ids(FINAL)).otherwise(think), f, _ids(EOS))
    tail = ones(F.when(reasoning.isNull(), F.size(f) + 1).otherwise(F.size(r) + F.size(f) + 2))
    return tokens, F.concat(zeros, tail)


def response_lengths(prompt: Column, final: Column, reasoning: Column) -> tuple[Column, Column]:
    """Tokens of the direct and of the thinking form."""
    direct = F.octet_length(prompt) + F.octet_length(final) + 5
    return direct, direct + F.octet_length(reasoning) + 1


def conversation_gate(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_turns, valid, n_tokens, n_targets: a valid conversation alternates from user to assistant and has no empty turn.

    Turns get their place from a window, which spills; what follows are sums, combined on the map side.
    """
    rows = turns.select(key, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    at = F.row_number().over(W.partitionBy(key).orderBy("turn", "role", "size"))
    rows = rows.withColumn("good", (F.col("size") > 0) & (F.col("role") == F.when(at % 2 == 1, "user").otherwise("assistant")))
    answered = F.when(F.col("role") == "assistant", F.col("size")).otherwise(0)
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg(n.alias("n_turns"), (F.bool_and("good") & (n % 2 == 0)).alias("valid"), (F.sum(F.col("size") + 1) + 2).alias("n_tokens"), (F.sum(answered) + 1).alias("n_targets"))


@F.arrow_udf(PACKED)
def _packed_turns(turns: pa.Array) -> pa.Array:
    """Tokens and mask of alternating turns, array<struct<role, text>>; null stays null."""
    rows = []
    for turn in turns.to_pylist():
        if turn is None:
            rows.append(None)
            continue
        bodies = [(USER if t["role"] == "user" else ASSISTANT, np.frombuffer(t["text"].encode(), np.uint8)) for t in turn]
        tokens, mask = [np.array([BOS])], [np.zeros(1, np.uint8)]
        for role, body in bodies:
            tokens += [np.array([role]), body]
            mask += [np.zeros(1, np.uint8), np.full(len(body), role == ASSISTANT, np.uint8)]
        tokens, mask = np.concatenate([*tokens, np.array([EOS])]).astype("<u2"), np.concatenate([*mask, np.ones(1, np.uint8)])
        rows.append({"tokens": tokens.tobytes(), "mask": mask.tobytes()})
    return pa.array(rows, pa.struct([("tokens", pa.binary()), ("mask", pa.binary())]))


def conversation_records(turns: DataFrame, key: str = "conv_id", context: int | None = None) -> DataFrame:
    """key, reason, tokens, mask of each conversation (key, turn, role, text): assistants' bytes and the end are targets.

    reason is accepted, or the first rule against it: starts_with_user, alternates, empty_turn, ends_with_assistant,
    too_long (more than context tokens); then tokens and mask are null. Turns of one number go by role and text. A
    record is one value, so a conversation is gathered in one row.
    """
    rows = turns.select(key, F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    role = lambda i: F.element_at("turns", F.lit(i))["role"]
    right = F.transform("turns", lambda t, i: t["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    size = F.aggregate("turns", F.lit(2).cast("long"), lambda n, t: n + 1 + F.octet_length(t["text"]))
    rules = [
        ("starts_with_user", role(1) != "user"),
        ("alternates", F.exists(right, lambda x: ~x)),
        ("empty_turn", F.exists("turns", lambda t: t["text"] == "")),
        ("ends_with_assistant", role(-1) != "assistant"),
        ("too_long", F.lit(context is not None) & (size > (context or 0))),
    ]
    judged = held.withColumn("reason", first_reason(rules))
    packed = judged.withColumn("r", _packed_turns(F.when(F.col("reason") == "accepted", F.col("turns"))))
    return packed.select(key, "reason", "r.tokens", "r.mask")


def packed_response(prompt: Column, final: Column, reasoning: Column) -> Column:
    """The record of an answer as binary, struct<tokens, mask>: as response_record has it, but built by NumPy in Arrow batches."""
    return _packed_response(prompt, final, reasoning)


@F.arrow_udf(PACKED)
def _packed_response(prompts: pa.Array, finals: pa.Array, reasonings: pa.Array) -> pa.Array:
    rows = []
    for prompt, final, reasoning in zip(prompts.to_pylist(), finals.to_pylist(), reasonings.to_pylist(), strict=True):
        p, f = (np.frombuffer((x or "").encode(), np.uint8) for x in (prompt, final))
        body = [[FINAL], f] if reasoning is None else [[THINK], np.frombuffer(reasoning.encode(), np.uint8), [FINAL], f]
        tokens = np.concatenate([np.asarray(x, "<u2") for x in ([BOS, USER], p, [ASSISTANT], *body, [EOS])])
        # The cue of the mode is the last token that is no target.
        mask = np.zeros(len(tokens), np.uint8)
        mask[len(p) + 4 :] = 1
        rows.append({"tokens": tokens.tobytes(), "mask": mask.tobytes()})
    return pa.array(rows, pa.struct([("tokens", pa.binary()), ("mask", pa.binary())]))


def windows(records: DataFrame, key: str, n_tokens: Column, block: int = 256, full_only: bool = False) -> DataFrame:
    """window, n_targets, n_records: windows of block predictions over the records packed in key order, each target in one window.

    full_only leaves the short window at the end of the stream out.
    """
    placed = running_offset(records.select(key, n_tokens.alias("_n")), key, F.col("_n"))
    # The first token of the stream is no target; target i stands in window (i - 1) div block.
    first, last = F.greatest(F.col("offset"), F.lit(1)) - 1, F.col("offset") + F.col("_n") - 2
    spread = placed.where(last >= first).select(first.alias("a"), last.alias("b"), F.explode(F.sequence(F.floor(first / block), F.floor(last / block))).alias("window"))
    part = F.least(F.col("b"), F.col("window") * block + block - 1) - F.greatest(F.col("a"), F.col("window") * block) + 1
    found = spread.groupBy("window").agg(F.sum(part).alias("n_targets"), F.count(F.lit(1)).alias("n_records"))
    return found.where(F.col("n_targets") == block) if full_only else found


def token_counts(records: DataFrame, text: str = "text") -> DataFrame:
    """token, n: how often each byte and the marks at both ends of a record occur. Each batch sends at most VOCABULARY rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(VOCABULARY, np.int64)
            found[[BOS, EOS]] = len(batch)
            for value in batch.column(0).to_pylist():
                found[:256] += np.bincount(np.frombuffer((value or "").encode(), np.uint8), minlength=256)
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(found[used])], ["token", "n"])

    return records.select(text).mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def unigram_loss(counts: DataFrame) -> DataFrame:
    """token, n, nll under add-one smoothing over the vocabulary."""
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(total).select("token", "n", F.round(-F.log((F.col("n") + 1) / (F.coalesce("total", F.lit(0)) + VOCABULARY)), 9).alias("nll"))


def vocabulary(chars: DataFrame) -> DataFrame:
    """ch, n, id: the characters by code point with dense ids; as many rows as the alphabet has."""
    counts = chars.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("id", F.row_number().over(W.orderBy("ch")) - 1)
