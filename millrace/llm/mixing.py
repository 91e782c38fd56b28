"""Mixing sources to target weights.

The token shares of the sources are raised to an exponent between 0 (all sources alike) and 1 (as they
are) and normalised. The exponent is found by bisection: the smallest one at which the entropy of the
weights is not above its target and no source is repeated more often than the limit. Then the weights
are realised: the documents of a source fall into BLOCKS blocks by a hash of their id, every pass over
a source takes its blocks in another permutation, and passes go on until the source's share of the
token budget is used; the last pass ends within a block of it.

Everything is DataFrame and SQL operations. What is computed for each document is its token count and
its block. Windows and the bisection see sums only: at most BLOCKS rows for each source and pass, and
one row for each source, however large a source is and however many there are. A source with a third
of all rows is summed on the map side, and its rows join by (source, block), never by source alone.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.scratch import numbered, small, write

#: Blocks of a source: two hexadecimal digits.
DIGITS = 2
BLOCKS = 16**DIGITS
#: Halvings of the bisection, and how many of them are done at once.
STEPS, LEVELS = 50, 5
#: The default target: entropy as a share of the highest possible.
EVENNESS = 0.97
MAX_REPEATS = 2.0
SEED = "mix-1"


class Mixture(NamedTuple):
    """exponent, budget (tokens) and the passes: source, block, pass, weight, position of the block in the whole mixture (0 to 1)."""

    exponent: float
    budget: float
    passes: DataFrame


def n_tokens(text: str = "text") -> Column:
    """Words separated by white space; null, empty and blank texts have none."""
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\t\n\x0B\f\r ]+", " "))
    return F.when(clean == "", 0).otherwise(F.length(clean) - F.length(F.replace(clean, F.lit(" "))) + 1).cast("long")


def _block(doc_id: str) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, DIGITS)


def _counted(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(id, source, block, n) of each row: all that the mixture needs to know of a text."""
    return docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), _block(doc_id).alias("block"), n_tokens(text).alias("n"))


def _exponent(shares: DataFrame, sources: int, total: float, evenness: float | None, max_repeats: float, budget_tokens: float | None) -> float:
    """The smallest exponent in 0 to 1 that is not too flat, by bisection over shares, (l): the logarithm of each source's share.

    Every round tries all places that the next LEVELS halvings can come to, in one aggregation over the
    sources; the driver sees a row for each of them.
    """
    low, high = 0.0, 1.0
    places = 2**LEVELS
    for _ in range(STEPS // LEVELS):
        tries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(low + (high - low) * i / places).alias("m")) for i in range(1, places)])
        each = shares.select("l", F.explode(tries).alias("x")).select("l", "x.i", "x.m")
        power = F.exp(F.col("m") * F.col("l"))
        sums = each.groupBy("i", "m").agg(F.sum(power).alias("z"), F.sum(F.col("l") * power).alias("s"), F.min("l").alias("least"), F.max("l").alias("most"))
        flat = 0
        for r in sorted(sums.collect(), key=lambda r: r.i):
            repeats = math.exp((1 - r.m) * (r.most - r.least)) if budget_tokens is None else math.exp((r.m - 1) * r.least) * budget_tokens / (r.z * total)
            entropy = math.log(r.z) - r.m * r.s / r.z
            if flat == r.i - 1 and (repeats > max_repeats or (evenness is not None and entropy > evenness * math.log(sources))):
                flat = r.i
        low, high = low + (high - low) * flat / places, low + (high - low) * (flat + 1) / places
    return round(high, 9)


def mixture(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", evenness: float | None = EVENNESS, max_repeats: float = MAX_REPEATS, budget_tokens: float | None = None
) -> Mixture:
    """The exponent, the budget and the passes over the blocks.

    evenness: the target entropy as a share of the highest possible; None: as even as the limit allows.
    budget_tokens: None for the smallest budget with which every source is seen once as a whole. A null
    source is a source of its own. Sources without tokens have weight 0, and one pass if the budget is
    None. Rows that share an id share a block and are taken together. An empty table gives no passes.
    """
    return _mixture(_counted(docs, doc_id, text, source), evenness, max_repeats, budget_tokens)


def _mixture(counted: DataFrame, evenness: float | None, max_repeats: float, budget_tokens: float | None) -> Mixture:
    blocks = write(counted.groupBy("source", "block").agg(F.sum("n").alias("tokens")), "blocks").df
    totals = write(blocks.groupBy("source").agg(F.sum("tokens").alias("total")), "totals").df
    total, sources = totals.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count(F.when(F.col("total") > 0, 1))).first()
    share = F.log(F.col("total") / F.lit(float(total or 1)))
    shares = totals.where("total > 0").select(share.alias("l"))
    exponent = _exponent(shares, sources, float(total), evenness, max_repeats, budget_tokens) if sources > 1 else 1.0
    z, largest = shares.agg(F.coalesce(F.sum(F.exp(F.lit(exponent) * F.col("l"))), F.lit(0.0)), F.coalesce(F.max("l"), F.lit(0.0))).first()
    # Every source once: the source that is thinned out most, the largest, sets the budget.
    budget = float(budget_tokens) if budget_tokens is not None else (total * z * math.exp((1 - exponent) * largest) if total else 0.0)
    weight = F.exp(F.lit(exponent) * share) / F.lit(z or 1.0)
    weighted = totals.withColumn("weight", F.when(F.col("total") > 0, weight).otherwise(0.0))
    quota = F.col("weight") * F.lit(budget)
    again = F.when(F.col("total") > 0, F.round(quota / F.col("total"), 9)).otherwise(1.0 if budget_tokens is None else 0.0)
    weighted = weighted.withColumn("repeats", again).where("repeats > 0")
    left, right = blocks.alias("b"), weighted.alias("w")
    passes = F.explode(F.sequence(F.lit(1), F.ceil("repeats").cast("int"))).alias("pass")
    each = left.join(right, F.col("b.source").eqNullSafe(F.col("w.source"))).select("b.source", "block", "tokens", "total", "weight", "repeats", passes)
    order = F.md5(F.concat_ws("|", F.lit(SEED), "pass", "source", "block"))
    line = W.partitionBy("source", "pass").orderBy(order, "block")
    each = each.withColumn("before", F.sum("tokens").over(line.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("tokens"))
    used = (F.col("pass") - 1) * F.col("total") + F.col("before")
    each = each.where((F.col("pass") <= F.floor("repeats")) | (used < F.col("repeats") * F.col("total")))
    position = F.when(F.col("total") > 0, F.round(used / (F.col("repeats") * F.col("total")), 9)).otherwise(0.0)
    return Mixture(exponent, budget, write(each.select("source", "block", "pass", "weight", position.alias("position")), "passes").df)


def _schedule(passes: DataFrame) -> DataFrame:
    return small(write(passes.select(*[F.col(c).alias(f"_mr_{c}") for c in passes.columns]), "schedule"))


def schedule(docs: DataFrame, evenness: float | None = EVENNESS, max_repeats: float = MAX_REPEATS, budget_tokens: float | None = None) -> DataFrame:
    """One row for each document and pass: doc_id, source, n_tokens, pass, block, weight (of the source), position (order of the mixture).

    The words of a text are counted once, into a narrow table that is written.
    """
    counted = write(_counted(docs, "doc_id", "text", "source"), "counted").df
    table = _schedule(_mixture(counted, evenness, max_repeats, budget_tokens).passes)
    found = counted.join(table, (F.col("block") == F.col("_mr_block")) & F.col("source").eqNullSafe(F.col("_mr_source")))
    return found.select(
        F.col("id").alias("doc_id"),
        "source",
        F.col("n").alias("n_tokens"),
        F.col("_mr_pass").alias("pass"),
        F.col("_mr_block").alias("block"),
        F.round("_mr_weight", 9).alias("weight"),
        F.col("_mr_position").alias("position"),
    )


def mixed(docs: DataFrame, evenness: float | None = EVENNESS, max_repeats: float = MAX_REPEATS, budget_tokens: float | None = None) -> DataFrame:
    """The rows of docs, each as often as the passes take it, with the columns of docs, whatever their names."""
    plain, own = numbered(docs)
    doc_id, text, source = (own[c] for c in ("doc_id", "text", "source"))
    found = mixture(plain, doc_id, text, source, evenness, max_repeats, budget_tokens)
    blocks = plain.withColumn("_mr_own", _block(doc_id))
    joined = blocks.join(_schedule(found.passes), (F.col("_mr_own") == F.col("_mr_block")) & F.col(source).eqNullSafe(F.col("_mr_source")))
    return joined.select(*plain.columns).toDF(*docs.columns)
